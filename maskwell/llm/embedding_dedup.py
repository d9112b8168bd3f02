"""Near-duplicate vectors: int8 tile products with error bounds, and full precision for pairs in doubt.

Equal vectors go as one, with their number. The others are cut into tiles, and a tile holds its vectors as int8 values
q, a scale s, and the length e of what quantisation lost. For unit vectors x = q / s + r the product of the quantised
vectors differs from the cosine by at most e_x * |q_y / s_y| + e_y (Cauchy-Schwarz, with |x| = 1).

1. Every pair of tiles is a task of its own, which gets the two tiles as int8 values only. Pairs whose product plus that
   bound (and a margin for rounding) stays below the threshold are no links, those whose product less the bound is
   above it are links, and the numbers of the rest are kept.
2. The vectors of such pairs, and no others, go to a second task of the same pair of tiles, which computes their cosines
   in double precision.

Both return numbers of links by vector and a spanning forest of the links, packed in a row, so a crowded group gives few
rows, not all pairs.

Work grows with the square of the number of distinct vectors, as an exact search over all pairs does; a tile pair's
memory doesn't grow.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing, nor do rows
without an id (they come back with a null component, not kept); vectors of different lengths are not compared with each
other (each length is a search of its own); equal vectors link with each other; repeated rows are vectors of their own;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.llm.common import looked_up, shuffle_partitions, stored
from maskwell.llm.components import components, forest

EMPTY = len(zstandard.compress(b""))
MARGIN = 1e-6  # for rounding, in double and single precision
TILE = "dims int, tile long, tiles long, ids binary, numbers binary, values binary, scales binary, norms binary, errors binary"
FOUND = "dims int, low long, high long, ids binary, counts binary, a binary, b binary, left binary, right binary"


def sound(vector: Column) -> Column:
    """Whether a vector can be compared at all."""
    x = F.transform(vector, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows as int8 values, scales, lengths of the quantised rows, and lengths of what was lost."""
    scale = 127 / np.abs(x).max(1)
    q = np.rint(x * scale[:, None]).astype(np.int8)
    back = q / scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


@dataclass
class Tile:
    ids: np.ndarray
    numbers: np.ndarray
    q: np.ndarray
    scale: np.ndarray
    norm: np.ndarray
    error: np.ndarray

    @classmethod
    def of(cls, row: pd.Series, dims: int) -> Tile:
        ids, numbers = (np.frombuffer(row[c], np.int64) for c in ("ids", "numbers"))
        return cls(ids, numbers, np.frombuffer(row["values"], np.int8).reshape(-1, dims), *(np.frombuffer(row[c]) for c in ("scales", "norms", "errors")))


def compare(x: Tile, y: Tile, same: bool, threshold: float, block: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of pairs that are links, and of pairs in doubt (in order where a tile meets itself)."""
    # one bound for the whole tile, and one for single precision, rule out most pairs by a single product
    dims = x.q.shape[1]
    floor = np.float32(threshold - x.error.max() * y.norm.max() - y.error.max() - MARGIN - dims * 2.0**-22 - 1e-6)
    other = (y.q / y.scale[:, None]).astype(np.float32).T
    sure: list[tuple] = []
    doubt: list[tuple] = []
    for at in range(0, len(x.q), block):
        part = (x.q[at : at + block] / x.scale[at : at + block, None]).astype(np.float32)
        i, j = np.nonzero(part @ other >= floor)
        i = i + at
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 14):
            a, b = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
            cosine = np.einsum("ij,ij->i", x.q[a].astype(np.int64), y.q[b].astype(np.int64)) / (x.scale[a] * y.scale[b])
            bound = x.error[a] * y.norm[b] + y.error[b] + MARGIN
            yes = cosine - bound >= threshold
            maybe = ~yes & (cosine + bound >= threshold)
            sure.append((a[yes], b[yes]))
            doubt.append((a[maybe], b[maybe]))
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate([empty, *[p[k] for p in found]]).astype(np.int64) for found in (sure, doubt) for k in (0, 1))


def tiles_of(distinct: DataFrame, tile: int) -> tuple[DataFrame, int]:
    """Tiles of about ``tile`` quantised vectors of one length each, dealt by a hash of the vector; the number of pairs."""
    sizes = [(r["dims"], -(-r["n"] // tile)) for r in distinct.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).collect()]
    many = distinct.sparkSession.createDataFrame(sizes or [(0, 1)], "dims int, tiles long")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(pdf["v"])
        columns = (pdf["id"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), *quantise(x))
        return pd.DataFrame([(*key, *(c.tobytes() for c in columns))], columns=[f.split()[0] for f in TILE.split(", ")])

    dealt = distinct.join(many, "dims").withColumn("tile", F.pmod(F.xxhash64("id", "v"), F.col("tiles")))
    return dealt.select("dims", "tile", "tiles", "id", "n", "v").groupBy("dims", "tile", "tiles").applyInPandas(run, TILE), sum(n * (n + 1) // 2 for _, n in sizes)


def unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def totals(ids: np.ndarray, numbers: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Ids with links and how many, and a spanning forest of the links."""
    count = np.bincount(i, numbers[j], len(ids)) + np.bincount(j, numbers[i], len(ids))
    some, kept = np.flatnonzero(count), forest(i, j, len(ids))
    return ids[some].tobytes(), count[some].astype(np.int64).tobytes(), ids[i[kept]].tobytes(), ids[j[kept]].tobytes()


def links(distinct: DataFrame, threshold: float = 0.9, tile: int = 2048) -> DataFrame:
    """a, b, n: rows with b null tell how many vectors a is linked to in one tile pair; others are spanning links."""
    partitions = shuffle_partitions(distinct.sparkSession)
    made, number = tiles_of(distinct, tile)
    tiles = stored(made, "tiles")
    # a tile goes to the pairs (k, tile) with k <= tile and (tile, k) with k >= tile, once each
    paired = tiles.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).drop("tiles")
    paired = paired.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other")).drop("other")
    # a count of its own keeps small tiles from being put into a few tasks
    tasks = max(partitions, number // 8)
    names = [f.split()[0] for f in FOUND.split(", ")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tile")
        sides = [Tile.of(pdf.iloc[k], int(key[0])) for k in range(len(pdf))]
        same = key[1] == key[2]
        if len(sides) < 2 - same:  # one of the two tiles has no rows
            return pd.DataFrame([], columns=names)
        i, j, left, right = compare(sides[0], sides[-1], same, threshold)
        ids, numbers = (np.concatenate([getattr(t, c) for t in sides]) for c in ("ids", "numbers"))
        shift = 0 if same else len(sides[0].ids)
        pairs = (ids[left].tobytes(), ids[right + shift].tobytes())
        return pd.DataFrame([(*key, *totals(ids, numbers, i, j + shift), *map(zstandard.compress, pairs))], columns=names)

    found = stored(paired.repartition(tasks, "dims", "low", "high").groupBy("dims", "low", "high").applyInPandas(run, FOUND), "tile-links")

    def wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                ids = np.unique(np.concatenate([np.frombuffer(zstandard.decompress(x), np.int64) for x in (row.left, row.right)]))
                yield pd.DataFrame({"dims": row.dims, "low": row.low, "high": row.high, "id": ids})

    def settle(key: tuple, pairs: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if pairs.empty or vectors.empty:
            return pd.DataFrame([], columns=["ids", "counts", "a", "b"])
        left, right = (np.frombuffer(zstandard.decompress(pairs[c].iloc[0]), np.int64) for c in ("left", "right"))
        vectors = vectors.sort_values("id")
        ids, numbers, x = vectors["id"].to_numpy(np.int64), vectors["n"].to_numpy(np.int64), unit(vectors["v"])
        i, j = np.searchsorted(ids, left), np.searchsorted(ids, right)
        on = np.zeros(len(i), bool)
        for k in range(0, len(i), 1 << 14):
            part = slice(k, k + (1 << 14))
            on[part] = np.einsum("ij,ij->i", x[i[part]], x[j[part]]) >= threshold
        return pd.DataFrame([totals(ids, numbers, i[on], j[on])], columns=["ids", "counts", "a", "b"])

    doubts = found.filter(F.octet_length("left") > EMPTY).select("dims", "low", "high", "left", "right")
    vectors = doubts.mapInPandas(wanted, "dims int, low long, high long, id long").join(distinct.select("id", "n", "v"), "id").repartition(tasks, "dims", "low", "high")
    exact = doubts.repartition(tasks, "dims", "low", "high").groupBy("dims", "low", "high").cogroup(vectors.groupBy("dims", "low", "high")).applyInPandas(settle, "ids binary, counts binary, a binary, b binary")

    def flat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                ids, counts, a, b = (np.frombuffer(x, np.int64) for x in (row.ids, row.counts, row.a, row.b))
                yield pd.DataFrame({"a": np.concatenate([ids, a]), "b": pd.array([*[pd.NA] * len(ids), *b], "Int64"), "n": np.concatenate([counts, np.zeros(len(a), np.int64)])})

    return found.select("ids", "counts", "a", "b").unionByName(exact).mapInPandas(flat, "a long, b long, n long")


def near_vectors(vectors: DataFrame, threshold: float = 0.9, tile: int = 2048, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector: key, n_links, component_id (smallest key reachable), kept (key = component_id)."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v0"))
    rows = rows.select("id", F.when(sound(F.col("v0")), F.transform("v0", lambda x: x.cast("double") + F.lit(0.0))).alias("v"))
    good = rows.filter("v is not null and id is not null")
    # equal vectors as one: the smallest id stands for them; partial aggregation combines them in every task
    distinct = stored(good.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).select("id", "n", "v", F.size("v").alias("dims")), "vectors")
    found = stored(links(distinct, threshold, tile), "vector-links")
    labels = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "id")
    numbers = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "id")
    of = distinct.join(numbers, "id", "left").join(labels, "id", "left")
    of = of.select("v", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    hashed = F.xxhash64("v").alias("h")
    rows = rows.withColumn("v", F.when(F.col("id").isNotNull(), F.col("v"))).select("*", hashed)
    out = looked_up(rows, "h", of.select("*", hashed), rows.count(), "left", also=("v",)).select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


ORACLE_SQL = """
WITH RECURSIVE v AS (
SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0
  AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
link AS (
SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
reach AS (
SELECT vec_id AS a, vec_id AS b FROM embeddings
UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT a AS vec_id, (SELECT count(*) FROM link WHERE link.a = reach.a) AS n_links, min(b) AS component_id, a = min(b) AS kept
FROM reach GROUP BY a
"""
