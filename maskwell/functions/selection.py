"""Choices that need a search in what was chosen before: spans by score, chunks by budget."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def disjoint(starts: list[int], ends: list[int], scores: list[float]) -> list[int]:
    """Places of spans kept by score, then by place: those that overlap none kept before.

    Kept spans that take up room are disjoint, so a search by start finds the one or two that a span can meet. An empty span
    lies within another or in none.
    """
    order = sorted(range(len(starts)), key=lambda k: (-scores[k], k))
    begin: list[int] = []  # of kept spans, in order, with their ends
    finish: list[int] = []
    empty: list[int] = []
    kept = []
    for k in order:
        a, b = starts[k], ends[k]
        at = bisect.bisect_left(begin, b)
        if at and finish[at - 1] > a and begin[at - 1] < b:
            continue
        # an empty span that is kept bars those around it
        if (e := bisect.bisect_right(empty, a)) < len(empty) and empty[e] < b:
            continue
        kept.append(k)
        if a < b:
            begin.insert(at, a)
            finish.insert(at, b)
        else:
            bisect.insort(empty, a)
    return kept


def by_score(spans: Column) -> Column:
    """The spans that disjoint() keeps, in its order."""

    @F.arrow_udf("array<int>")
    def run(rows: pa.Array) -> pa.Array:
        out = []
        for row in rows:
            x = row.as_py() or []
            out.append(disjoint([s["start"] for s in x], [s["end"] for s in x], [s["confidence"] for s in x]))
        return pa.array(out, pa.list_(pa.int32()))

    both = F.struct(spans.alias("spans"), run(spans).alias("kept"))
    return F.element_at(F.transform(F.array(both), lambda x: F.transform(x["kept"], lambda k: F.get(x["spans"], k))), 1)


def filled(sizes: np.ndarray, budget: int, overlap: int) -> list[tuple[int, int]]:
    """(first, end) of chunks of as many elements as fit, at least one; the next one begins ``overlap`` before the end."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    out, first, n = [], 0, len(sizes)
    while first < n:
        end = max(int(np.searchsorted(upto, upto[first] + budget, "right")) - 1, first + 1)
        out.append((first, end))
        first = n if end >= n else max(first + 1, end - overlap)
    return out


def chunks(costs: Column, budget: int, overlap: int) -> Column:
    """filled() of an array of costs."""
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf("array<struct<first:int,end:int>>")
    def run(rows: pa.Array) -> pa.Array:
        out = []
        for row in rows:
            sizes = row.values.fill_null(0).to_numpy() if row.is_valid else np.zeros(0, np.int64)
            out.append([{"first": a, "end": b} for a, b in filled(sizes.astype(np.int64), budget, overlap)])
        return pa.array(out, kind)

    return run(costs)
