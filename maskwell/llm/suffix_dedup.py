"""Removal of long repeated strings: sorted shards of windows merged by interleave refinement.

A byte goes when a string of ``window`` bytes that covers it also starts anywhere else. Strings are compared as
sequences of wide symbols: the symbol at a byte is a hash of the next half window, and the suffix there goes on half a
window later, so a window is two symbols, and an interval of suffixes with a common prefix of two symbols is a
repeated string.

1. Equal texts go as one, with their number. Every window has an anchor, its leftmost smallest ``GRAM`` bytes by hash.
   Equal windows have equal anchors, so only stretches around anchors that occur twice or more can repeat: the rest of
   the corpus is done.
2. The stretches (all windows of one anchor in a text) are dealt by anchor; an anchor with more than ``slice_rows``
   different stretches is dealt to as many slices as that takes. A task cuts its stretches into shards and sorts the
   suffixes of each by two symbols into a transform: the suffixes in order, their first symbols, and the symbols of
   what follows.
3. Transforms are merged two by two. The interleave of two transforms starts as one after the other and is refined
   symbol by symbol: each side keeps its order, and a suffix moves by the number of the other side's suffixes that
   come before it, so nothing is sorted again. The borders that a step adds are the places where the common prefix
   ends; what is left in one block after both steps is a repeated interval.
4. Of anchors in several slices, each slice's transform is cut at ranges of the first symbol, and the parts of a range
   are merged in the same way by another task, so no task holds all of an anchor that many documents share.
5. Ranges are joined back to the texts that hold a stretch, merged, and cut out.

Within a task, windows of one interval are compared byte by byte with its first; across slices two 64-bit symbols
decide. Texts are equal by SHA-256.

Defined results: null text is empty; texts shorter than the window lose nothing to others; repeated rows repeat each
other; overlapping occurrences in one text count; an empty table gives an empty result; null keys stay null; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.llm import textkit
from maskwell.llm.common import looked_up, shuffle_partitions, stored, whole_text

GRAM = 100
WINDOWS = "range int, firsts binary, seconds binary, ids binary, places binary, numbers binary"


def sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` values in a row."""
    done, out = 1, x
    while done * 2 <= size:
        out = np.minimum(out[: len(out) - done], out[done:])
        done *= 2
    if done < size:
        out = np.minimum(out[: len(x) - size + 1], out[size - done :])
    return out


def anchors(buf: np.ndarray, off: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first and last window start (within the text) and hash of every anchor."""
    none = np.zeros(0, np.int64)
    if len(buf) < window:
        return none, none, none, none
    gram = textkit.Hasher(buf).all_of(min(GRAM, window))
    n = len(gram)
    bits = np.uint64(max(22, int(len(buf)).bit_length()))
    least = sliding_least((gram >> bits << bits) | np.arange(n, dtype=np.uint64), window - min(GRAM, window) + 1)
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    size = np.diff(off)
    ok = np.flatnonzero(size >= window)
    if not len(ok):
        return none, none, none, none
    starts = textkit.spread(off[:-1][ok], size[ok] - window + 1)
    doc = np.repeat(ok, size[ok] - window + 1)
    a = at[starts]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.append(first[1:], len(starts)) - 1
    return doc[first], starts[first] - off[doc[first]], starts[last] - off[doc[first]], gram[a[first]].view(np.int64)


def found_anchors(docs: DataFrame, window: int) -> DataFrame:
    """doc, low, high, anchor of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a byte takes some 60 here
            for row, end, buf, off in textkit.slices(batch.column(1), 1 << 20):
                doc, low, high, h = anchors(buf, off, window)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row).take(pa.array(doc)), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(h)], ["doc", "low", "high", "anchor"])

    return docs.mapInArrow(run, "doc binary, low int, high int, anchor long")


def packed(docs: DataFrame) -> DataFrame:
    """doc, raw: texts compressed one by one, for the shuffles and tables that they go through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([small.compress(x.as_py().encode()) for x in batch.column(1)], pa.binary())], ["doc", "raw"])

    return docs.mapInArrow(run, "doc binary, raw binary")


def stretches(candidates: DataFrame, window: int, most: int = 1 << 23) -> DataFrame:
    """One row for each different stretch of a run of texts: its id, anchor, bytes, the places (doc, low) that hold it, and
    their number with all copies of the texts. A run ends where its stretches take about ``most`` bytes, or with its batch."""

    def rows(at: dict[tuple[int, bytes], int], places: array, doc: pa.Array, copies: np.ndarray, serial: int) -> pa.RecordBatch:
        stretch, row, low = np.frombuffer(places, np.int64).reshape(-1, 3).T
        order = np.argsort(stretch, kind="stable")
        row, low = row[order], low[order].astype(np.int32)
        edge = np.searchsorted(stretch[order], np.arange(len(at) + 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays([
            pa.array(range(serial, serial + len(at)), pa.int64()),
            pa.array([k[0] for k in at], pa.int64()),
            pa.array([k[1] for k in at], pa.binary()),
            pa.array(np.add.reduceat(copies[row], edge[:-1]), pa.int64()),
            pa.ListArray.from_arrays(pa.array(edge), doc.take(pa.array(row))),
            pa.ListArray.from_arrays(pa.array(edge), pa.array(low)),
        ], ["stretch", "anchor", "body", "number", "docs", "lows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 40
        small, whole = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        for batch in batches:
            doc, texts, copies, found = batch.columns
            copies = copies.to_numpy()
            # compressed, as unlike bytes never compress to like ones; text by text, as Python's objects take many times Arrow's room
            at: dict[tuple[int, bytes], int] = {}
            places, size = array("q"), 0
            for row in range(len(batch)):
                raw = whole.decompress(texts[row].as_buffer())
                for x in found[row].as_py():
                    own = (x["anchor"], small.compress(raw[x["low"] : x["high"] + window]))
                    if own not in at:
                        at[own] = len(at)
                        size += len(own[1]) + 250  # its key and entry
                    places.extend((at[own], row, x["low"]))
                    size += 24
                if at and (size >= most or row + 1 == len(batch)):
                    yield rows(at, places, doc, copies, serial)
                    serial += len(at)
                    at, places, size = {}, array("q"), 0

    return candidates.mapInArrow(run, "stretch long, anchor long, body binary, number long, docs array<binary>, lows array<int>")


def merged_list(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two sorted lists of different values as one, and where the values of each are in it."""
    at = np.searchsorted(x, y)
    known = np.zeros(len(y), bool)
    known[at < len(x)] = x[at[at < len(x)]] == y[at < len(x)]
    new = y[~known]
    into_x = np.arange(len(x)) + np.searchsorted(new, x)
    into_y = np.empty(len(y), np.int64)
    into_y[~known] = np.arange(len(new)) + at[~known]
    into_y[known] = into_x[at[known]]
    out = np.empty(len(x) + len(new), x.dtype)
    out[into_x], out[into_y] = x, y
    return out, into_x, into_y


def interleave(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the elements of two ordered lists go in their interleave, the first list first among equals; its blocks."""
    into_x = np.arange(len(x)) + np.searchsorted(y, x, "left")
    into_y = np.arange(len(y)) + np.searchsorted(x, y, "right")
    both = np.empty(len(x) + len(y), np.int64)
    both[into_x], both[into_y] = x, y
    return into_x, into_y, np.cumsum(np.concatenate([np.zeros(min(1, len(both)), bool), both[1:] != both[:-1]]))


@dataclass
class Transform:
    """The windows of a shard in the order of their symbols."""

    symbols: np.ndarray  # sorted
    first: np.ndarray  # the number of each window's first symbol, in order
    after: np.ndarray  # that of the symbol that follows
    entry: np.ndarray  # which window

    @classmethod
    def of(cls, first: np.ndarray, after: np.ndarray, entry: np.ndarray) -> Transform:
        symbols, number = np.unique(np.concatenate([first, after]), return_inverse=True)
        first, after = number[: len(first)], number[len(first) :]
        order = np.argsort(first * len(symbols) + after, kind="stable")
        return cls(symbols, first[order], after[order], entry[order])

    def merge(self, other: Transform) -> Transform:
        symbols, mine, theirs = merged_list(self.symbols, other.symbols)
        first, first_ = mine[self.first], theirs[other.first]
        after, after_ = mine[self.after], theirs[other.after]
        # one symbol: blocks of equal first symbols; then each block by what follows
        x, y, block = interleave(first, first_)
        x, y, _ = interleave(block[x] * len(symbols) + after, block[y] * len(symbols) + after_)
        n = len(x) + len(y)
        out = []
        for a, b in ((first, first_), (after, after_), (self.entry, other.entry)):
            both = np.empty(n, np.int64)
            both[x], both[y] = a, b
            out.append(both)
        return Transform(symbols, *out)

    def common(self) -> np.ndarray:
        """How many symbols each window has in common with the one before it."""
        out = np.zeros(len(self.first), np.int64)
        same = self.first[1:] == self.first[:-1]
        out[1:] = same.astype(np.int64) + (same & (self.after[1:] == self.after[:-1]))
        return out

    def intervals(self) -> np.ndarray:
        """The number of each window's interval of windows with both symbols in common."""
        return np.cumsum(self.common() < 2) - 1


def merge_all(parts: list[Transform]) -> Transform:
    while len(parts) > 1:
        parts = [parts[k].merge(parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


class Windows:
    """The windows of many stretches: where each begins in the joined bytes, and its stretch."""

    def __init__(self, bodies: list[bytes], window: int):
        self.window, self.buf = window, np.frombuffer(b"".join(bodies), np.uint8)
        size = np.fromiter(map(len, bodies), np.int64, len(bodies))
        self.begin = np.cumsum(size) - size
        self.number = np.maximum(0, size - window + 1)
        self.at = textkit.spread(self.begin, self.number)
        self.stretch = np.repeat(np.arange(len(bodies)), self.number)

    def transforms(self, shards: int) -> list[Transform]:
        """One transform for each shard of stretches."""
        half = self.window // 2
        symbol = textkit.Hasher(self.buf).all_of(half)
        edge = np.concatenate([[0], np.cumsum(self.number)])[np.linspace(0, len(self.begin), min(shards, len(self.begin)) + 1).astype(int)]
        return [Transform.of(symbol[self.at[a:b]], symbol[self.at[a:b] + self.window - half], np.arange(a, b)) for a, b in zip(edge, edge[1:])]  # noqa: B905

    def intervals(self, shards: int) -> np.ndarray:
        """The interval of each window, proved by its bytes."""
        order = merge_all(self.transforms(shards))
        out = np.empty(len(self.at), np.int64)
        out[order.entry] = order.intervals()
        _, first = np.unique(out, return_index=True)
        leader = self.at[first][out]
        # windows in a row whose leaders are in a row are compared as one string
        move = leader - self.at
        new = np.ones(len(move), bool)
        new[1:] = (move[1:] != move[:-1]) | (self.at[1:] != self.at[:-1] + 1)
        start = np.flatnonzero(new)
        run = np.diff(np.append(start, len(new)))
        moved = move[start] != 0
        start, run = start[moved], run[moved]
        wrong = ~textkit.same_bytes(self.buf, self.at[start], self.buf, leader[start], run + self.window - 1)
        if wrong.any():  # unlike windows with like symbols: tell the windows of those runs' intervals apart by bytes
            raw, own, seen = self.buf.tobytes(), np.isin(out, out[textkit.spread(start[wrong], run[wrong])]), {}
            fresh = int(out.max()) + 1
            for k in np.flatnonzero(own).tolist():
                out[k] = seen.setdefault(raw[self.at[k] : self.at[k] + self.window], fresh + len(seen))
        return out


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def row_runs(ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last of every run of places in a row with one id; both sorted."""
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(ids)), bool), (ids[1:] != ids[:-1]) | (place[1:] != place[:-1] + 1)]))
    return first, np.append(first[1:], len(ids))[: len(first)] - 1


def slabs(pdf: pd.DataFrame, most: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """Rows of whole anchors and slices, of about ``most`` bytes of compressed bodies at a time."""
    pdf = pdf.sort_values(["anchor", "slice"], kind="stable")
    size = pdf["body"].map(len).cumsum().to_numpy() // most
    new = ((pdf["anchor"].diff() != 0) | (pdf["slice"].diff() != 0)).to_numpy()
    group = np.maximum.accumulate(np.where(new, size, 0))
    for _, part in pdf.groupby(group, sort=False):
        yield part


def by_anchor(rows: DataFrame, buckets: int, window: int, shards: int) -> DataFrame:
    """stretch, start, end of repeated ranges, for anchors of one slice."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part in slabs(pdf):
            at: dict[bytes, int] = {}
            of = np.array([at.setdefault(zstandard.decompress(b), len(at)) for b in part["body"]])
            numbers = np.bincount(of, part["number"].to_numpy(float))
            w = Windows(list(at), window)
            interval = w.intervals(shards)
            hit = np.bincount(interval, numbers[w.stretch])[interval] > 1
            first, last = row_runs(w.stretch[hit], (w.at - w.begin[w.stretch])[hit])
            stretch, place = w.stretch[hit], (w.at - w.begin[w.stretch])[hit]
            edge = np.searchsorted(stretch[first], np.arange(len(at) + 1))
            for name, k in zip(part["stretch"], of, strict=True):
                mine = slice(edge[k], edge[k + 1])
                out.extend(zip([name] * (edge[k + 1] - edge[k]), place[first[mine]].tolist(), (place[last[mine]] + window).tolist(), strict=True))
        return pd.DataFrame(out, columns=["stretch", "start", "end"]).astype("int64")

    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets))).withColumn("slice", F.lit(0))
    return dealt.select("bucket", "anchor", "slice", "stretch", "body", "number").groupBy("bucket").applyInPandas(run, "stretch long, start long, end long")


def by_slice(rows: DataFrame, buckets: int, ranges: int, window: int, shards: int) -> DataFrame:
    """The same for anchors of several slices: the slices' transforms meet by ranges of the first symbol."""

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part in slabs(pdf):
            w = Windows([zstandard.decompress(b) for b in part["body"]], window)
            ids, number = part["stretch"].to_numpy(np.int64), part["number"].to_numpy(np.int64)
            order = merge_all(w.transforms(shards))
            first, after = order.symbols[order.first], order.symbols[order.after]
            of = w.stretch[order.entry]
            columns = (first, after, ids[of], (w.at - w.begin[w.stretch])[order.entry].astype(np.int32), np.minimum(number[of], 2).astype(np.int8))
            edge = np.searchsorted((first >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1))
            for r in np.flatnonzero(np.diff(edge)).tolist():
                out.append((r, *(np.ascontiguousarray(x[edge[r] : edge[r + 1]]).tobytes() for x in columns)))
        return pd.DataFrame(out, columns=["range", "firsts", "seconds", "ids", "places", "numbers"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        parts, ids, place, number, at = [], [], [], [], 0
        for row in pdf.itertuples():
            first, after = np.frombuffer(row.firsts, np.uint64), np.frombuffer(row.seconds, np.uint64)
            parts.append(Transform.of(first, after, np.arange(at, at + len(first))))
            ids.append(np.frombuffer(row.ids, np.int64))
            place.append(np.frombuffer(row.places, np.int32))
            number.append(np.frombuffer(row.numbers, np.int8))
            at += len(first)
        order = merge_all(parts)
        ids, place, number = (np.concatenate(x)[order.entry] for x in (ids, place, number))
        interval = order.intervals()
        hit = np.bincount(interval, number)[interval] > 1
        ids, place = ids[hit], place[hit]
        # what was found goes back by stretch, packed: one row for each share of the stretches
        share = (textkit.mix(ids.view(np.uint64)) % np.uint64(ranges)).astype(np.int64)
        order = np.argsort(share, kind="stable")
        ids, place, share = ids[order], place[order], share[order]
        edge = np.searchsorted(share, np.arange(ranges + 1))
        keep = np.flatnonzero(np.diff(edge)).tolist()
        cut = lambda x: [np.ascontiguousarray(x[edge[b] : edge[b + 1]]).tobytes() for b in keep]
        return pd.DataFrame({"share": keep, "ids": cut(ids), "places": cut(place)})

    def back(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, place = (np.concatenate([np.frombuffer(x, t) for x in pdf[c]]) for c, t in (("ids", np.int64), ("places", np.int32)))
        order = np.lexsort((place, ids))
        ids, place = ids[order], place[order].astype(np.int64)
        first, last = row_runs(ids, place)
        return pd.DataFrame({"stretch": ids[first], "start": place[first], "end": place[last] + window})

    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("anchor", "slice"), F.lit(buckets)))
    dealt = dealt.select("bucket", "anchor", "slice", "stretch", "body", "number").groupBy("bucket").applyInPandas(deal, WINDOWS)
    return dealt.groupBy("range").applyInPandas(meet, "share int, ids binary, places binary").groupBy("share").applyInPandas(back, "stretch long, start long, end long")


def cut_out(texts: DataFrame) -> DataFrame:
    """doc, n_removed, n_spans, kept_sha256, spans (start, end in bytes) for texts with ranges to remove."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text, starts, ends in zip(pdf["doc"], pdf["raw"], pdf["starts"], pdf["ends"], strict=True):
                raw = zstandard.decompress(text)
                step = np.zeros(len(raw) + 1, np.int64)
                np.add.at(step, np.asarray(starts), 1)
                np.add.at(step, np.asarray(ends), -1)
                gone = np.cumsum(step)[:-1] > 0
                a, b = runs(gone)
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((doc, int(gone.sum()), len(a), hashlib.sha256(kept).hexdigest(), [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]))
            yield pd.DataFrame(out, columns=["doc", "n_removed", "n_spans", "kept_sha256", "spans"])

    return texts.mapInPandas(run, "doc binary, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")


def repeats(docs: DataFrame, window: int = 400, slice_rows: int = 1000, shards: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_bytes, n_removed, n_spans, kept_sha256, spans."""
    if window % 2 or window < 16:
        raise ValueError("a window is two symbols of eight bytes at least")
    partitions = shuffle_partitions(docs.sparkSession)
    named = docs.select(F.col(key).alias("id"), whole_text(text).alias("text")).select("id", "text", F.unhex(F.sha2("text", 256)).alias("doc"))
    found = stored(found_anchors(named.select("doc", "text"), window), "anchors")
    number = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    lists = looked_up(found, "anchor", number, found.count()).groupBy("doc").agg(F.collect_set(F.struct("low", "high", "anchor")).alias("found"))
    own = packed(named.select("doc", "text")).groupBy("doc").agg(F.first("raw").alias("raw"), F.count(F.lit(1)).alias("copies"))
    texts = stored(own.join(lists, "doc").select("doc", "raw", "copies", "found"), "texts")
    held = stored(stretches(texts, window), "stretches")
    rows = held.select("stretch", "anchor", "body", "number")
    many = stored(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > slice_rows).select("anchor", F.ceil(F.col("n") / slice_rows).cast("int").alias("slices")), "many-slices")
    sliced = looked_up(rows, "anchor", many, rows.count()).withColumn("slice", F.pmod(F.xxhash64("stretch"), F.col("slices")).cast("int"))
    ranges = by_anchor(rows.join(many, "anchor", "left_anti"), 4 * partitions, window, shards).unionByName(by_slice(sliced, 4 * partitions, partitions, window, shards))
    placed = ranges.join(held.select("stretch", F.explode(F.arrays_zip("docs", "lows")).alias("x")), "stretch")
    placed = placed.select(F.col("x.docs").alias("doc"), (F.col("x.lows") + F.col("start")).alias("start"), (F.col("x.lows") + F.col("end")).alias("end"))
    of = placed.groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    changed = cut_out(texts.select("doc", "raw").join(of, "doc"))
    base = named.select("id", "doc", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    none = F.array().cast("array<struct<start:long,end:long>>")
    return base.join(changed, "doc", "left").select(
        F.col("id").alias(key),
        "n_bytes",
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_removed", "n_spans")],
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        F.coalesce("spans", none).alias("spans"),
    )
