"""Toxicity scores from character n-grams scaled by naive Bayes log-count ratios.

A text's features are the character n-grams that it holds at all, of its lower-cased form, hashed to 2**bits
cells. Over the training documents every cell gets the log ratio of how often toxic and other documents hold it;
cells with enough documents and the strongest ratios become columns, and a linear classifier is trained on the
presence of each column times its ratio.

Training uses at most about ``train_rows`` labelled documents (a bounded sample by a hash of the key); everything
else reads all rows. Only the texts are inputs of a score.

Defined results: null and empty texts score as a text without features; without labels every score is 0.5
(predicted 1) and with one label only the prior decides; repeated rows are scored each; an empty table gives an
empty result; null labels don't train; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.llm import logistic, textkit
from maskwell.llm.common import stored, whole_text

RANGES = 16
SLICE = 3 << 18  # bytes of text at a time: a slice's n-grams take some 100 times as much


@dataclass(frozen=True)
class Model:
    cells: np.ndarray  # sorted
    weights: np.ndarray
    bias: float
    bits: int
    orders: tuple[int, ...]


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of the key as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def cells(buf: np.ndarray, off: np.ndarray, orders: tuple[int, ...], bits: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and the distinct cells each text holds; only those that ``wanted`` (a mask) has."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    prefix = textkit.running(buf)
    _, inverse = textkit.powers(len(prefix))
    owned = textkit.owners(off, at)
    text = np.repeat(np.arange(len(owned)), owned)
    left = np.repeat(np.cumsum(owned), owned) - np.arange(len(at))  # characters from here to the text's end
    ends = np.append(at, len(buf))
    found = []
    for n in orders:
        on = np.flatnonzero(left >= n)
        start, end = at[on], ends[on + n]
        h = textkit.mix((prefix[end] - prefix[start]) * inverse[start] + np.uint64(n)) >> np.uint64(64 - bits)
        h = h.astype(np.int64)
        if wanted is not None:
            hit = wanted[h]
            on, h = on[hit], h[hit]
        found.append((text[on] << bits) | h)
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both >> bits, both & ((1 << bits) - 1)


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))


def count_cells(train: DataFrame, orders: tuple[int, ...], bits: int, least: int) -> DataFrame:
    """cell, toxic, other: numbers of training documents that hold the cell; cells of fewer than ``least`` go."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << bits), np.int32)
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            for row, _, buf, off in textkit.slices(lowered(batch.column(1)), SLICE):
                doc, cell = cells(buf, off, orders, bits)
                for k in (0, 1):
                    counts[k] += np.bincount(cell[y[row + doc] == k], minlength=1 << bits).astype(np.int32)
        parts = counts.reshape(2, RANGES, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(RANGES), pa.int32()), pa.array([parts[1, k].tobytes() for k in range(RANGES)], pa.binary()), pa.array([parts[0, k].tobytes() for k in range(RANGES)], pa.binary())], ["part", "toxic", "other"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        toxic, other = (sum(np.frombuffer(x, np.int32).astype(np.int64) for x in pdf[c]) for c in ("toxic", "other"))
        k = np.flatnonzero(toxic + other >= least)
        return pd.DataFrame({"cell": k + (int(pdf["part"].iloc[0]) << bits) // RANGES, "toxic": toxic[k], "other": other[k]})

    return train.select("y", "text").mapInArrow(count, "part int, toxic binary, other binary").groupBy("part").applyInPandas(add, "cell long, toxic long, other long")


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 16_000, columns: int = 8192, orders: tuple[int, ...] = (4, 5), bits: int = 20, least: int = 4, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on labelled documents that aren't held out. The driver gets the columns' ratios and a sparse matrix of at
    most ``train_rows`` rows, both bounded by the parameters."""
    known = labels.filter(F.col(label).isNotNull() & ~held_out(key)).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("y"))
    n = known.count()
    share = min(1.0, train_rows / max(1, n))
    known = known.filter(F.pmod(F.xxhash64("_key", F.lit("train")), F.lit(1 << 20)) < int(share * (1 << 20)))  # all rows at a share of 1
    rows = stored(docs.select(F.col(key).alias("_key"), whole_text(text).alias("text")).join(F.broadcast(known), "_key").select("y", "text"), "toxicity-train")
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not other:
        bias = 0.0 if toxic == other else (35.0 if toxic else -35.0)
        return Model(np.zeros(0, np.int64), np.zeros(0), bias, bits, orders)
    ratio = F.log((F.col("toxic") + 1) / (toxic + 2)) - F.log((F.col("other") + 1) / (other + 2))
    counted = count_cells(rows, orders, bits, least).withColumn("ratio", ratio)
    best = counted.orderBy(F.desc(F.abs("ratio") * F.sqrt(F.least(F.col("toxic") + F.col("other"), F.lit(400)))), "cell").limit(columns)
    picked = sorted((r["cell"], r["ratio"]) for r in best.select("cell", "ratio").collect())
    names, ratios = np.array([c for c, _ in picked], np.int64), np.array([r for _, r in picked])

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << bits, bool)
        wanted[names] = True
        for batch in batches:
            for row, end, buf, off in textkit.slices(lowered(batch.column(1)), SLICE):
                doc, cell = cells(buf, off, orders, bits, wanted)
                edge = np.searchsorted(doc, np.arange(end - row + 1))
                col = np.searchsorted(names, cell).astype("<u4")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array([col[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary())], ["y", "columns"])  # noqa: B905

    got = rows.mapInArrow(matrix, "y int, columns binary").collect()
    lists = [np.frombuffer(r["columns"], "<u4").astype(np.int64) for r in got]
    at, col = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate([np.zeros(0, np.int64), *lists])
    w = logistic.fit_sparse(at, col, ratios[col], np.array([r["y"] for r in got], float), len(names))
    return Model(names, w[:-1] * ratios, float(w[-1]), bits, orders)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score: probability of the label, from the text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights = np.zeros(1 << model.bits, bool), np.zeros(1 << model.bits)
        wanted[model.cells], weights[model.cells] = True, model.weights
        for batch in batches:
            for row, end, buf, off in textkit.slices(lowered(batch.column(1)), SLICE):
                doc, cell = cells(buf, off, model.orders, model.bits, wanted)
                z = np.bincount(doc, weights[cell], minlength=end - row) + model.bias
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(logistic.sigmoid(z))], ["id", "score"])

    return docs.select(F.col(key).cast("long").alias("id"), whole_text(text).alias("text")).mapInArrow(run, "id long, score double").withColumnRenamed("id", key)


def keep_below(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores under the threshold; nothing is shuffled."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights = np.zeros(1 << model.bits, bool), np.zeros(1 << model.bits)
        wanted[model.cells], weights[model.cells] = True, model.weights
        for batch in batches:
            for row, end, buf, off in textkit.slices(lowered(batch.column(at)), SLICE):
                doc, cell = cells(buf, off, model.orders, model.bits, wanted)
                z = np.bincount(doc, weights[cell], minlength=end - row) + model.bias
                yield batch.slice(row, end - row).filter(pa.array(logistic.sigmoid(z) < threshold))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", **parameters) -> DataFrame:
    """One row per document: key, held_out, score, predicted (1 from a score of 0.5)."""
    model = train(docs, labels, key=key, **parameters)
    return score(docs, model, key).select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
