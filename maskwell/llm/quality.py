"""Quality scores by co-training: a naive Bayes classifier of the text and one of the page metadata teach each other.

The text view sees content (words and pairs of words in a row, hashed to 2**16 cells) and form (12 measures in bins: shares
of capitals, punctuation, table bars, digits, repeated words and lines, lengths). The metadata view sees language, source,
both together and recorded length, each value hashed to a cell of its own. A class's counts of cells are all that a view
learns, so Spark adds them up over all documents and only their sums, whose number is fixed, reach the driver.

Both views start from the labelled documents. In every round each view, calibrated on labelled rows kept aside, labels all
documents of the corpus that it is sure of for the other, which counts them beside the labelled ones; all pseudo-labels of
a class weigh no more than its labelled rows. In the end both are calibrated again and their log odds are combined by a
small regression on labelled rows that neither training nor calibration has seen.

Labelled rows are a sample by a hash of the key, about ``train_rows`` at most; everything else reads all documents. A
document's cells are stored once, and the rounds read those.

Defined results: null texts are empty, null metadata is a value of its own; without labels, or with one kind of
label only, the score is the labels' share (0.5 without any); repeated rows are scored each; an empty table gives an
empty result; null labels don't train; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.llm import logistic, textkit
from maskwell.llm.common import stored, whole_text
from maskwell.llm.toxicity import held_out

WORDS = 1 << 16  # cells of words and of pairs
WIDTH = 12  # measures of form
BINS = 32  # of each measure
KINDS = 4  # values of metadata
META = 1 << 12  # cells of those
FORM_AT = WORDS
META_AT = FORM_AT + WIDTH * BINS
TOTALS = META_AT + META  # documents counted by the text view, by the metadata view
CELLS = TOTALS + 2


def per_text(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[off[1:]] - total[off[:-1]]


def tokens(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of bytes that are inside, cut at the ends of texts."""
    first = np.zeros(len(inside), bool)
    first[off[:-1][np.diff(off) > 0]] = True
    before = np.concatenate([[False], inside[:-1]])
    start = np.flatnonzero(inside & (~before | first))
    last = np.concatenate([first[1:], [True]]) if len(first) else first
    after = np.concatenate([inside[1:], [False]])
    return start, np.flatnonzero(inside & (~after | last)) + 1


def form(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The measures of every text of a slice."""
    n = np.maximum(1, np.diff(off))
    upper = (buf >= 65) & (buf <= 90) | (buf == 0xC3) & np.concatenate([(buf[1:] >= 0x80) & (buf[1:] <= 0x9E), [False]])[: len(buf)]
    digit = (buf >= 48) & (buf <= 57)
    mark = (buf > 32) & (buf < 127) & ~digit & ~(((buf | 32) >= 97) & ((buf | 32) <= 122))
    double = mark & np.concatenate([[False], mark[:-1]])
    hasher = textkit.Hasher(buf)

    def shares(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many, how many different, how many like the one before."""
        owned = textkit.owners(off, start)
        doc = np.repeat(np.arange(len(n)), owned)
        h = hasher.of(start, end)
        order = np.lexsort((h, doc))
        h2, d2 = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h2[1:] != h2[:-1]) | (d2[1:] != d2[:-1])
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        return owned, np.bincount(d2, new, minlength=len(n)), np.bincount(doc, same, minlength=len(n))

    words, different, again = shares(*tokens(buf > 32, off))
    lines, other_lines, _ = shares(*tokens(buf != 10, off))
    letters = per_text(buf > 32, off)
    size = np.log1p(n)
    distinct = different / np.maximum(1, words)
    return np.column_stack([
        size, per_text(upper, off) / n, per_text(mark, off) / n, per_text(double, off) / n, per_text(digit, off) / n, per_text(buf == 124, off) / n,
        distinct, distinct * size, letters / np.maximum(1, words), again / np.maximum(1, words), lines / n * 100, other_lines / np.maximum(1, lines),
    ]).astype(np.float32)


def content(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells of every text's words and pairs of words in a row, ASCII letters in lower case; and where each
    text's cells begin."""
    low = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
    start, end = tokens(low > 32, off)
    doc = np.repeat(np.arange(len(off) - 1), textkit.owners(off, start))
    one = textkit.Hasher(low).of(start, end)
    two = textkit.mix(one[:-1] * np.uint64(3) + one[1:])
    within = doc[1:] == doc[:-1]
    cell = (np.concatenate([one, two[within]]) >> np.uint64(48)).astype(np.int64)
    both = np.unique((np.concatenate([doc, doc[1:][within]]) << 16) | cell)
    return both & (WORDS - 1), np.searchsorted(both >> 16, np.arange(len(off)))


def metadata() -> Column:
    """The cells of a row's metadata; xxhash64 passes over nulls, which so get a cell of their own."""
    length = F.col("n_chars").cast("long")
    size = F.floor(F.log2(F.when(length > 0, length).when(length <= 0, 0) + 1) * 2)
    lang, source = F.col("lang").cast("string"), F.col("source").cast("string")
    return F.array(*(F.pmod(F.xxhash64(F.lit(name), *values), F.lit(META)).cast("int") for name, *values in (("lang", lang), ("source", source), ("n_chars", size), ("both", F.to_json(F.struct(lang.alias("l"), source.alias("s")))))))


def featured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, words (distinct cells, two bytes each), form, meta: what the views see of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, buf, off in textkit.slices(batch.column(1)):
                cell, at = content(buf, off)
                raw = cell.astype("<u2").tobytes()
                words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), end - row, [None, pa.py_buffer((at * 2).astype("<i8").tobytes()), pa.py_buffer(raw)]).cast(pa.binary())
                measures = pa.FixedSizeListArray.from_arrays(pa.array(form(buf, off).ravel()), WIDTH).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), words, measures, batch.column(2).slice(row, end - row)], ["id", "words", "form", "meta"])

    rows = docs.select(F.col(key).cast("long").alias("id"), whole_text(text).alias("text"), metadata().alias("meta"))
    return rows.mapInArrow(run, "id long, words binary, form array<float>, meta array<int>")


@dataclass
class Seen:
    """A batch of featured documents: cells of all words, where each document's begin, cells of measures and metadata."""

    words: np.ndarray
    at: np.ndarray
    form: np.ndarray
    meta: np.ndarray


def seen(batch: pa.RecordBatch, edges: np.ndarray) -> Seen:
    words = batch.column("words").cast(pa.large_binary())
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    measures = batch.column("form").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
    bins = np.column_stack([FORM_AT + k * BINS + np.searchsorted(edges[k], measures[:, k], "right") for k in range(WIDTH)])
    meta = batch.column("meta").flatten().to_numpy(zero_copy_only=False).reshape(-1, KINDS)
    return Seen(raw.view("<u2").astype(np.int64), (at - at[0]) // 2, bins, META_AT + meta)


@dataclass
class View:
    """The calibration of a view: a regression on its log-count ratios."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> View:
        mean, scale = x.mean(0), x.std(0)
        scale = np.where(scale > 1e-9, scale, 1.0)
        return cls(mean, scale, logistic.fit(np.clip((x - mean) / scale, -6, 6), y))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights[:-1] + self.weights[-1]


@dataclass
class Model:
    edges: np.ndarray  # of the bins of each measure
    ratios: np.ndarray  # of each cell
    views: tuple[View, View] | None = None  # text, metadata
    mixed: np.ndarray = field(default_factory=lambda: np.zeros(3))  # of the two log odds, and an offset
    rounds: list[tuple[int, int]] = field(default_factory=list)  # pseudo-labels that text and metadata gave in each round

    def inputs(self, docs: Seen) -> tuple[np.ndarray, np.ndarray]:
        """The log-count ratios that the two views go by."""
        n = np.maximum(1, np.diff(docs.at))
        words = per_text(self.ratios[docs.words], docs.at)
        return np.column_stack([words / n, words / np.sqrt(n), self.ratios[docs.form]]), self.ratios[docs.meta]

    def log_odds(self, docs: Seen) -> tuple[np.ndarray, np.ndarray]:
        return tuple(view.log_odds(x) for view, x in zip(self.views, self.inputs(docs), strict=True))

    def combined(self, docs: Seen) -> np.ndarray:
        z = np.full(len(docs.form), self.mixed[-1])
        if self.views:
            text, meta = self.log_odds(docs)
            z = z + self.mixed[0] * text + self.mixed[1] * meta
        return z


def counted(rows: DataFrame, edges: np.ndarray, label: Callable[[pa.RecordBatch, Seen], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """How many documents of label 0 and of label 1 hold each cell. ``label`` gives the labels that count for the text view
    and for the metadata view, -1 for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, CELLS), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            docs = seen(batch, edges)
            for_text, for_meta = label(batch, docs)
            of_word = np.repeat(for_text, np.diff(docs.at))
            for k in (0, 1):
                text, meta = for_text == k, for_meta == k
                for cells in (docs.words[of_word == k], docs.form[text].ravel(), docs.meta[meta].ravel()):
                    counts[k] += np.bincount(cells, minlength=CELLS)
                counts[k, TOTALS] += text.sum()
                counts[k, TOTALS + 1] += meta.sum()
        cell = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(counts[0, cell]), pa.array(counts[1, cell])], ["cell", "zeros", "ones"])

    sums = rows.mapInArrow(run, "cell long, zeros long, ones long").groupBy("cell").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toArrow()
    out = np.zeros((2, CELLS))
    for k, name in enumerate(("zeros", "ones")):
        out[k, sums.column("cell").to_numpy()] = sums.column(name).to_numpy()
    return out


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """The log ratio of how often documents of label 1 and of label 0 hold each cell."""
    of = np.repeat(counts[:, TOTALS:], [META_AT, CELLS - META_AT], axis=1)
    share = (counts + 1) / (of + 2)
    return np.log(share[1]) - np.log(share[0])


def taught(labelled: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Counts of labelled rows and of pseudo-labels, which together weigh as much as a class's labelled rows at most."""
    weight = np.minimum(1, labelled[:, TOTALS:] / np.maximum(1, given[:, TOTALS:]))
    return labelled + given * np.repeat(weight, [META_AT, CELLS - META_AT], axis=1)


def picked(labels: DataFrame, train_rows: int, key: str, label: str) -> DataFrame:
    """_key, y, turn of the labelled rows that train; turn 6 is kept for calibrating, turn 7 for combining."""
    usable = labels.filter(F.col(label).isNotNull() & ~held_out(key)).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("y"))
    share = min(1.0, train_rows / max(1, usable.count()))
    part = F.pmod(F.xxhash64("_key", F.lit("train")), F.lit(1 << 20)) < int(share * (1 << 20))
    return usable.filter(part).withColumn("turn", F.pmod(F.xxhash64("_key", F.lit("turn")), F.lit(8)).cast("int"))


def train(features: DataFrame, labels: DataFrame, train_rows: int = 20_000, rounds: int = 3, sure: float = 0.95, key: str = "doc_id", label: str = "quality") -> Model:
    """Co-train on featured documents, best a stored table: every round reads all of them."""
    rows = stored(features.join(F.broadcast(picked(labels, train_rows, key, label)), F.col("id") == F.col("_key")).drop("_key"), "quality-train")
    small = rows.select("form", "y", "turn").toArrow()
    y, turn = (small.column(c).to_numpy() for c in ("y", "turn"))
    no_edges = np.zeros((WIDTH, BINS - 1))
    if len(y) == 0 or y.min() == y.max():
        prior = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
        return Model(no_edges, np.zeros(CELLS), mixed=np.array([0.0, 0.0, np.log(prior / (1 - prior))]))
    measures = small.column("form").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
    edges = np.quantile(measures, np.arange(1, BINS) / BINS, axis=0).T.astype(np.float32)
    parted = all(len(set(y[on])) == 2 for on in (turn < 6, turn == 6, turn == 7))  # else all rows serve for everything

    def own(batch: pa.RecordBatch, docs: Seen) -> tuple[np.ndarray, np.ndarray]:
        of = batch.column("y").to_numpy().copy()
        if parted:
            of[batch.column("turn").to_numpy() >= 6] = -1
        return of, of

    def inputs_of(model: Model, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = np.column_stack(model.inputs(seen(batch, edges)))
                    yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

        aside = rows.filter(F.col("turn") == turn) if parted else rows
        got = aside.mapInArrow(run, "y int, x array<double>").toArrow()
        x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(got.num_rows, -1)
        return x[:, :-KINDS], x[:, -KINDS:], got.column("y").to_numpy().astype(float)

    def learned(counts: np.ndarray) -> Model:
        model = Model(edges, log_ratios(counts))
        text, meta, truth = inputs_of(model, 6)
        model.views = View.fit(text, truth), View.fit(meta, truth)
        return model

    labelled = counted(rows, edges, own)
    model, history, limit = learned(labelled), [], np.log(sure / (1 - sure))
    for _ in range(rounds):

        def confident(batch: pa.RecordBatch, docs: Seen, model: Model = model) -> tuple[np.ndarray, np.ndarray]:
            by_text, by_meta = (np.where(z >= limit, 1, np.where(z <= -limit, 0, -1)) for z in model.log_odds(docs))
            return by_meta, by_text

        given = counted(features, edges, confident)
        history.append((int(given[:, TOTALS + 1].sum()), int(given[:, TOTALS].sum())))
        model = learned(taught(labelled, given))
    text, meta, truth = inputs_of(model, 7)
    model.mixed = logistic.fit(np.column_stack([model.views[0].log_odds(text), model.views[1].log_odds(meta)]), truth, penalty=0.1)
    model.rounds = history
    return model


def score(features: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """key, score: the combined, calibrated probability of good quality."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(logistic.sigmoid(model.combined(seen(batch, model.edges))))], ["id", "score"])

    return features.mapInArrow(run, "id long, score double").withColumnRenamed("id", key)


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """One row per document: key, held_out, score, predicted, kept (predicted = 1)."""
    features = stored(featured(docs, key, text), "quality-features")
    model = train(features, labels, key=key, **parameters)
    good = F.col("score") >= 0.5
    return score(features, model, key).select(key, held_out(key).alias("held_out"), "score", good.cast("int").alias("predicted"), good.alias("kept"))
