"""Grouping of spelling variants by permuterm rotations.

One pass over the texts finds runs of letters, edits the runs that the contract deletes a letter of, and counts words: each
slice of texts counts its own, Spark adds up. Every word, marked with a terminator that no word holds, is then rotated to
every letter. A rotation b$a names the text around an edited place: words a?b have rotations b$a? that begin with it, and the
word ab, with no letter there, is the rotation itself. So all words that differ at one place, by another letter or by none,
are one range of the sorted rotations. A scan of the ranges emits, for each word in one, how many others are near and the
largest of them: not the pairs. A range holds one row for each letter at most, whatever the corpus; a word has one range for
each place. Roots follow by pointer doubling: each step to a form multiplies the count by ``factor``, so their number is
bounded by the largest count.

Defined results: null and empty texts have no words; repeated rows count each; a null key is the empty string where the key
is hashed; ties of counts go to the smallest word in code-point order; an empty table gives an empty result; other columns
are not read. A very long text is a slice of its own; a word that is counted takes room in the
square of its length. A link by a doubled letter (aab and ab) counts once.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.llm import textkit
from maskwell.llm.common import stored

MARK = "$"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
LATIN = 0xC3  # the lead byte of U+00C0 to U+00FF, and of nothing else
RANGES = "word string, k long, top long, top_word string"


class Joined:
    """crc32 of a prefix and a run from the crc32 of each: linear in the prefix's, by a table for each length of the run."""

    def __init__(self):
        self.tables = np.zeros((0, 4, 256), np.uint32)

    def upto(self, size: int) -> np.ndarray:
        for n in range(len(self.tables), size + 1):
            zeros = bytes(n)
            none = zlib.crc32(zeros)
            table = [[zlib.crc32(zeros, v << 8 * byte) ^ none for v in range(256)] for byte in range(4)]
            self.tables = np.concatenate([self.tables, np.array([table], np.uint32)])
        return self.tables

    def of(self, before: np.ndarray, run: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = run.astype(np.uint32)
        usual = np.flatnonzero(size < 64)
        tables, v, n = self.upto(63), before[usual], size[usual]
        for byte in range(4):
            out[usual] ^= tables[n, byte, (v >> np.uint32(8 * byte)) & np.uint32(255)]
        for k in np.flatnonzero(size >= 64).tolist():
            zeros = bytes(int(size[k]))
            out[k] ^= zlib.crc32(zeros, int(before[k])) ^ zlib.crc32(zeros)
        return out


def runs(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of every maximal run of letters; texts border each other."""
    inside = LETTER[buf]
    lead = np.flatnonzero(buf == LATIN)
    inside[lead] = True
    inside[lead + 1] = True
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    finish[:-1] &= ~inside[1:]
    edge = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(buf))]
    begin[edge] = inside[edge]
    finish[edge - 1] = inside[edge - 1]
    return np.flatnonzero(begin), np.flatnonzero(finish) + 1


def slice_words(keys: list[str], buf: np.ndarray, off: np.ndarray, every: int, least: int, joined: Joined) -> pa.RecordBatch:
    """word, n of one slice: words of at least ``least`` code points."""
    buf = LOWER[buf]
    start, end = runs(buf, off)
    if not len(start):
        return pa.RecordBatch.from_arrays([pa.array([], pa.string()), pa.array([], pa.int64())], ["word", "n"])
    _, where, code = textkit.distinct(buf, start, end)
    doc = np.repeat(np.arange(len(off) - 1), textkit.owners(off, start))
    pair, times = np.unique(doc * len(where) + code, return_counts=True)
    doc, code = np.divmod(pair, len(where))
    raw, first, last = buf.tobytes(), start[where], end[where]
    crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint32, len(where))
    before = np.fromiter((zlib.crc32(f"{k}:".encode()) for k in keys), np.uint32, len(keys))
    h = joined.of(before[doc], crc[code], (last - first)[code])
    hit = h % np.uint32(every) == 0
    n = np.bincount(code[~hit], times[~hit], minlength=len(where)).astype(np.int64)
    heads = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    long = (heads[last] - heads[first] >= least) & (n > 0)
    words = [raw[a:b].decode() for a, b in zip(first[long].tolist(), last[long].tolist(), strict=True)]
    counts = n[long].tolist()
    for k in np.flatnonzero(hit).tolist():
        word = raw[first[code[k]] : last[code[k]]].decode()
        at = int(h[k]) % len(word)
        if len(word) > least:
            words.append(word[:at] + word[at + 1 :])
            counts.append(int(times[k]))
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])


def words(docs: DataFrame, every: int = 199, shortest: int = 6, least: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: the distinct words of at least ``shortest`` code points that occur ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = Joined()
        for batch in batches:
            keys = pc.fill_null(batch.column(0), "").to_pylist()
            for row, end, buf, off in textkit.slices(batch.column(1)):
                yield slice_words(keys[row:end], buf, off, every, shortest, joined)

    each = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def rotations(vocabulary: DataFrame) -> DataFrame:
    """around, letter, n: each rotation as a whole (letter is empty), and cut before its last letter, which stood at the edited place."""
    marked = F.concat("word", F.lit(MARK))
    turn = lambda k: F.concat(F.substring(marked, k + 1, F.length(marked)), F.substring(marked, F.lit(1), k))
    turned = vocabulary.select("n", F.explode(F.transform(F.sequence(F.lit(0), F.length("word")), turn)).alias("turned"))
    whole = F.struct(F.col("turned").alias("around"), F.lit("").alias("letter"))
    cut = F.struct(F.substring("turned", F.lit(1), F.length("turned") - 1).alias("around"), F.substring("turned", -1, 1).alias("letter"))
    return turned.select("n", F.explode(F.array(whole, cut)).alias("r")).select("r.*", "n").filter(F.col("letter") != MARK)


def scanned(around: str, letters: list[str], counts: list[int]) -> Iterator[tuple[str, int, int, str]]:
    """word, k, top, top_word: for each word of a range the near ones in it and the largest of them.

    letters are in order. The word without a letter there is near to those whose letter differs from the one before the place:
    a letter doubled is the same edit at the place before.
    """
    after, before = around.split(MARK)
    own = [(-n, before + c + after, c) for c, n in zip(letters, counts, strict=True)]
    rank = sorted(own)
    bare = own[0] if letters[0] == "" else None
    for x in own:
        rival = lambda y: y is not x and not ((x is bare and before.endswith(y[2])) or (y is bare and before.endswith(x[2])))  # noqa: B023, E731
        near = len(own) - 1
        if before and bare:
            doubled = before[-1]
            near -= sum(c == doubled for c in letters) if x is bare else int(x[2] == doubled)
        if near:
            top = next(y for y in rank if rival(y))
            yield x[1], near, -top[0], top[1]


def ranges(rows: DataFrame) -> DataFrame:
    """The scan: rows come sorted by what is around the place, so that a range is a run of rows; one range is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def scan(batch: pa.Table) -> pa.RecordBatch:
            around = batch["around"].combine_chunks()
            same = pc.equal(around[1:], around[:-1]).to_numpy(zero_copy_only=False) if len(around) > 1 else np.zeros(0, bool)
            edge = np.concatenate([[0], np.flatnonzero(~same) + 1, [len(around)]])
            many = np.flatnonzero(np.diff(edge) > 1)
            take = textkit.spread(edge[many], np.diff(edge)[many])
            letters, counts = batch["letter"].take(take).to_pylist(), batch["n"].take(take).to_pylist()
            out, at = [], 0
            for name, size in zip(around.take(edge[many]).to_pylist(), np.diff(edge)[many].tolist(), strict=True):
                out.extend(scanned(name, letters[at : at + size], counts[at : at + size]))
                at += size
            columns = list(zip(*out, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "k", "top", "top_word"])

        for batch in batches:
            if not batch.num_rows:
                continue
            around = batch.column(0)
            last = around[-1]
            # the last range of a batch may go on in the next one
            n = int(pc.index(around, last).as_py())
            if n:
                yield scan(pa.Table.from_batches([*held, batch[:n]]))
                held = []
            elif held and held[0].column(0)[0] != last:
                yield scan(pa.Table.from_batches(held))
                held = []
            held.append(batch[n:])
        if held:
            yield scan(pa.Table.from_batches(held))

    return rows.repartition("around").sortWithinPartitions("around", "letter").mapInArrow(run, RANGES)


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """word, root of words that have a form: after k rounds a pointer has gone 2**k steps, or stands at a root."""
    out = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(1, steps)))):
        out = stored(out, "spelling-roots")
        ahead = out.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        out = out.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"))
    return out


def variants(docs: DataFrame, every: int = 199, shortest: int = 6, least: int = 5, factor: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    vocabulary = stored(words(docs, every, shortest, least, key, text), "spelling-words")
    best = F.min(F.struct((-F.col("top")).alias("top"), "top_word")).alias("best")
    near = ranges(rotations(vocabulary)).groupBy("word").agg(F.sum("k").alias("n_near"), best)
    form_n = F.when(-F.col("best.top") >= factor * F.col("n"), -F.col("best.top"))
    found = vocabulary.join(near, "word", "left").select("word", F.when(form_n.isNotNull(), F.col("best.top_word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form_n.cast("long").alias("form_n"))
    found = stored(found, "spelling-forms")
    most = found.agg(F.max("n")).first()[0] or 1
    rooted = roots(found.filter("form is not null"), int(math.log(max(1, most), factor)) + 1)
    return found.join(rooted, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
