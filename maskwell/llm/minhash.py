"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

Shingles are five words in a row (a text of fewer words is one shingle); words are runs of letters, digits, _
and non-ASCII characters of the lower-cased text. A shingle weighs tf * idf with idf = 1 + ln(N / df) / (4 ln(N)),
N and df counted over all documents. The range from 1 to 1.25 is flat on purpose: what an edit changes has a df of 1
and so the highest weight, and with a steep idf two copies of a large group, whose common shingles weigh least, would
need a far higher plain similarity than two copies of a small one (see README). Two texts are linked when their
weighted Jaccard similarity is at least the threshold (up to 1e-9, for rounding).

1. Every document's shingle hashes go to buckets of hashes; a bucket counts df. Documents of one block with the
   same words go as one, with their number.
2. Back by block, a document knows its weight and how much of it lies on shingles of other documents. The
   similarity to any other document is at most that share, so documents under the threshold are done: nothing
   is lost. Of the others, equal word sequences (by a 128-bit digest) go on as one.
3. Each draws ``bands * rows`` consistent samples. A shingle that no other document has can't give an equal
   sample, so all such shingles of a document draw their smallest value at once, from its exact distribution.
4. Bands that agree make buckets. Every member is verified against its bucket's head, the member with the largest
   share of shingles that others have too (an original, where a group is copies of one).
5. Buckets that still have members of several components make families, connected by their buckets. All pairs of a
   family whose components differ are compared exactly, tile by tile inside tasks: a family of at most ``tile`` texts
   is one tile, a larger one is dealt to tiles and each pair of tiles is a task's work. Tiles travel packed, and a
   task returns a spanning forest of the links, so rows don't grow with the square of a group.
6. Connected components of the verified links are the classes.

Defined results: null is empty; texts without words (empty, or marks alone) are linked only when equal in full; repeated
rows are one class; an empty table gives an empty result; ties go to the smallest key; a null key stays null and gives
its class no id: such a row is kept only where its whole class has no key (class_id is null then); other columns are not
read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.llm import textkit
from maskwell.llm.common import looked_up, shuffle_partitions, stored, whole_text
from maskwell.llm.components import components, forest
from maskwell.llm.token_counts import from_planes, planes

WORD_BYTE = np.array([chr(b).isalnum() or b == 95 if b < 128 else True for b in range(256)])


SLACK = 1e-9  # of a similarity, for the order of sums
TILE = "family binary, tiles int, tile int, blob binary"
LINK = "a binary, b binary, similarity double"


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in a buffer; a text's end must not be a word byte's neighbour (see shingles)."""
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = WORD_BYTE[buf]
    edge = np.diff(inside.view(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def digests(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 128-bit digest of each text's words in order; of the whole text where it has no words."""
    inside = WORD_BYTE[buf]
    after = np.concatenate([[False], inside[:-1]])
    kept = inside | after
    plain = np.where(inside, buf, np.uint8(32))[kept].tobytes()
    edge = np.concatenate([[0], np.cumsum(kept)])[off].tolist()
    raw, at = buf.tobytes(), off.tolist()
    out = b"".join(
        hashlib.blake2b(plain[a:b], digest_size=16).digest() if b > a else hashlib.blake2b(raw[c:d], digest_size=16, person=b"no words").digest()
        for a, b, c, d in zip(edge, edge[1:], at, at[1:])  # noqa: B905
    )
    return np.frombuffer(out, np.uint64).reshape(-1, 2)


def shingles(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text number of every shingle, and each text's digest.

    Texts must be separated by a byte that no word holds.
    """
    start, end = words(buf)
    word = textkit.Hasher(buf).of(start, end)
    owned = textkit.owners(off, start)
    doc = np.repeat(np.arange(len(owned)), owned)
    first = np.cumsum(owned) - owned
    place = np.arange(len(word)) - first[doc]
    grams = np.maximum(owned - size + 1, np.minimum(owned, 1))
    head = np.flatnonzero(place < grams[doc])
    out = np.zeros(len(head), np.uint64)
    for k in range(size):
        ok = place[head] + k < owned[doc[head]]
        out = textkit.mix(out * np.uint64(31) + np.where(ok, word[np.minimum(head + k, len(word) - 1)], np.uint64(k)))
    return out, doc[head], digests(buf, off)


def separated(texts: pa.Array) -> pa.Array:
    """Lower-cased texts that end with a line feed."""
    wide = pa.large_string()
    return pc.binary_join_element_wise(pc.utf8_lower(pc.fill_null(texts.cast(wide), "")), pa.scalar("\n", wide), pa.scalar("", wide))


def sequences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, seq (16 bytes): documents with the same words in the same order have the same seq."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, buf, off in textkit.slices(separated(batch.column(1))):
                seq = digests(buf, off)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array([x.tobytes() for x in seq], pa.binary())], ["id", "seq"])

    return docs.select(F.col(key).cast("long").alias("id"), whole_text(text).alias("text")).mapInArrow(run, "id long, seq binary")


def idf(df: np.ndarray, total: int) -> np.ndarray:
    return 1 + np.log(np.maximum(1.0, total / df)) / (4 * math.log(max(total, 2)))


def low_bytes(h: np.ndarray) -> bytes:
    """48 bits of each hash; the bucket keeps the highest ones."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_low_bytes(raw: bytes, bucket: int = 0) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel() | np.uint64((bucket & 0xFFFF) << 48)


def dealt(docs: DataFrame, buckets: int, size: int, key: str, text: str) -> DataFrame:
    """For each block and bucket: text numbers, how many documents each text is, its entries, their hashes and term
    frequencies. One row of a block has the table of its texts' seqs."""
    schema = "block long, bucket int, table binary, docs binary, copies binary, entries binary, hashes binary, tfs binary"
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 6]

    def block(name: int, buf: np.ndarray, off: np.ndarray) -> list[tuple]:
        h, doc, seq = shingles(buf, off, size)
        _, one, copies = np.unique(seq.view("V16").ravel(), return_index=True, return_counts=True)
        rank = np.full(len(seq), -1)
        rank[one] = np.arange(len(one))
        on = rank[doc] >= 0
        h, doc = h[on], rank[doc[on]]
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
        tf = np.diff(np.append(first, len(h)))
        h, doc = h[first], doc[first]
        bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        h, doc, tf, bucket = h[order], doc[order], tf[order], bucket[order]
        edge = np.searchsorted(bucket, np.arange(buckets + 1))
        table, rows = seq[one].tobytes(), []
        for b in np.flatnonzero(np.diff(edge)).tolist():
            x, y = edge[b], edge[b + 1]
            who, entries = np.unique(doc[x:y], return_counts=True)
            rows.append((name, b, table, planes(np.diff(who, prepend=0)), planes(copies[who]), planes(entries), low_bytes(h[x:y]), planes(tf[x:y])))
            table = None
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            for _, _, buf, off in textkit.slices(separated(batch.column(0))):
                if rows := block(name, buf, off):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                name += 1

    return docs.select(whole_text(text).alias("text")).mapInArrow(run, schema)


def weighted(deals: DataFrame) -> DataFrame:
    """Each bucket counts df and gives every block back the entries that other texts have too, and sums of the rest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hs = [from_low_bytes(x) for x in pdf["hashes"]]
        entries = [from_planes(x) for x in pdf["entries"]]
        copies = [np.repeat(from_planes(c), e) for c, e in zip(pdf["copies"], entries, strict=True)]
        _, inverse = np.unique(np.concatenate(hs), return_inverse=True)
        dfs = np.bincount(inverse, np.concatenate(copies)).astype(np.int64)[inverse]
        texts = np.bincount(inverse)[inverse]  # entries, each a text of a block
        at, out = 0, []
        for h, e, row in zip(hs, entries, pdf.itertuples(), strict=True):
            df, shared, tf = dfs[at : at + len(h)], texts[at : at + len(h)] > 1, from_planes(row.tfs)
            at += len(h)
            doc = np.repeat(np.arange(len(e)), e)
            alone = np.bincount(doc, np.where(shared, 0, tf), minlength=len(e))
            out.append((row.block, row.bucket, row.table, row.docs, row.copies, planes(alone), planes(np.bincount(doc, shared, minlength=len(e))), low_bytes(h[shared]), planes(tf[shared]), planes(df[shared])))
        return pd.DataFrame(out, columns=["block", "bucket", "table", "docs", "copies", "alone", "entries", "hashes", "tfs", "dfs"])

    return deals.groupBy("bucket").applyInPandas(run, "block long, bucket int, table binary, docs binary, copies binary, alone binary, entries binary, hashes binary, tfs binary, dfs binary")


_tables: list[np.ndarray] = []


def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1), and their logarithms, as tables: 1 - (1 + x) exp(-x) = u solved by Newton steps."""
    if not _tables:
        u = (np.arange(1 << 16) + 0.5) / (1 << 16)
        x = np.where(u < 0.26, np.sqrt(2 * u), 1 - np.log1p(-u) * 1.1)
        for _ in range(60):
            x = np.maximum(1e-9, x - np.clip((1 - (1 + x) * np.exp(-x) - u) / (x * np.exp(-x)), -1, 1))
        _tables.extend([x, np.log(x)])
    return _tables[0], _tables[1]


def samples(h: np.ndarray, w: np.ndarray, alone: float, seq: bytes, keys: np.ndarray) -> np.ndarray:
    """One sample for each of the keys: the shingle and step with the smallest value, or a value of its own."""
    gamma, log_gamma = _draws()
    own = np.frombuffer(seq, np.uint64)
    out = textkit.mix(keys ^ own[0]) + own[1]  # what no other text has
    u = (textkit.mix(out ^ keys).astype(np.float64) + 0.5) / 2.0**64
    best = np.log(-np.log(u)) - math.log(alone) if alone > 0 else np.full(len(keys), np.inf)
    log_w = np.log(w)
    step = max(1, (1 << 18) // len(keys))
    for at in range(0, len(h), step):
        x = textkit.mix(h[at : at + step, None] ^ keys[None, :])
        r = gamma[(x & np.uint64(0xFFFF)).astype(np.int32)]
        beta = (x >> np.uint64(32)).astype(np.float64) / 2.0**32
        t = np.floor(log_w[at : at + step, None] / r + beta)
        value = log_gamma[((x >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int32)] - r * (t - beta) - r
        k = value.argmin(0)
        low = value[k, np.arange(len(keys))]
        found = textkit.mix(h[at + k] + t[k, np.arange(len(keys))].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out = np.where(low < best, found, out)
        best = np.minimum(best, low)
    return out


def signed(parts: DataFrame, total: int, threshold: float, bands: int, rows: int) -> DataFrame:
    """Documents that can have a partner: seq, weight, share of shared shingles, their hashes, tfs and dfs, band keys."""
    keys = textkit.mix(np.arange(1, bands * rows + 1, dtype=np.uint64))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.frombuffer(next(x for x in pdf["table"] if x is not None), "V16")
        of, copies, alone, h, tf, df = [], np.ones(len(names)), np.zeros(len(names)), [], [], []
        for row in pdf.itertuples():
            who = np.cumsum(from_planes(row.docs))
            copies[who] = from_planes(row.copies)
            alone[who] += from_planes(row.alone)
            of.append(np.repeat(who, from_planes(row.entries)))
            h.append(from_low_bytes(row.hashes, row.bucket))
            tf.append(from_planes(row.tfs))
            df.append(from_planes(row.dfs))
        alone *= idf(copies, total)  # what no other text has occurs in as many documents as the text itself
        of, h, tf, df = (np.concatenate(x) for x in (of, h, tf, df))
        w = tf * idf(df, total)
        shared = np.bincount(of, w, minlength=len(names))
        order = np.lexsort((h, of))
        of, h, w, tf, df = of[order], h[order], w[order], tf[order], df[order]
        edge = np.searchsorted(of, np.arange(len(names) + 1))
        out = []
        for k in np.flatnonzero((shared > 0) & (shared >= threshold * (shared + alone) * (1 - 1e-9))).tolist():
            x, y = edge[k], edge[k + 1]
            seq = names[k].tobytes()
            drawn = samples(h[x:y], w[x:y], float(alone[k]), seq, keys).reshape(bands, rows)
            band = np.zeros(bands, np.uint64)
            for column in drawn.T:
                band = textkit.mix(band * np.uint64(31) + column)
            weight = float(shared[k] + alone[k])
            out.append((seq, weight, float(shared[k]) / weight, h[x:y].tobytes(), planes(tf[x:y]), planes(df[x:y]), band.view(np.int64)))
        return pd.DataFrame(out, columns=["seq", "weight", "share", "hashes", "tfs", "dfs", "bands"])

    schema = "seq binary, weight double, share double, hashes binary, tfs binary, dfs binary, bands array<long>"
    return parts.groupBy("block").applyInPandas(run, schema)


def verified(pairs: DataFrame, vectors: DataFrame, total: int) -> DataFrame:
    """a, b, similarity for pairs of seqs, by weighted Jaccard similarity of all their shingles."""
    v = vectors.select("seq", "weight", "hashes", "tfs", "dfs")
    both = pairs
    for side in "ab":
        both = both.join(v.select(F.col("seq").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("weight", "hashes", "tfs", "dfs")]), side)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for x in pdf.itertuples():
                _, i, j = np.intersect1d(np.frombuffer(x.hashes_a, np.uint64), np.frombuffer(x.hashes_b, np.uint64), assume_unique=True, return_indices=True)
                # a shingle has one df: the smaller weight is that of the smaller term frequency
                common = (np.minimum(from_planes(x.tfs_a)[i], from_planes(x.tfs_b)[j]) * idf(from_planes(x.dfs_a)[i], total)).sum()
                out.append(common / (x.weight_a + x.weight_b - common))
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "similarity": out})

    return both.mapInPandas(run, LINK)


class Tile:
    """Texts of a family: seqs, labels of their components, weights, and their shingles as one sorted list."""

    def __init__(self, seq: list[bytes], label: list[bytes], weight: np.ndarray, h: np.ndarray, of: np.ndarray, tf: np.ndarray, df: np.ndarray):
        self.seq, self.label, self.weight, self.h, self.of, self.tf, self.df = seq, label, weight, h, of, tf, df

    @classmethod
    def of_rows(cls, rows: pd.DataFrame) -> Tile:
        h = [np.frombuffer(x, np.uint64) for x in rows["hashes"]]
        of = np.repeat(np.arange(len(h)), [len(x) for x in h])
        tf, df = (np.concatenate([from_planes(x) for x in rows[c]]) for c in ("tfs", "dfs"))
        flat = np.concatenate(h)
        order = np.argsort(flat, kind="stable")
        return cls(list(rows["seq"]), list(rows["label"]), rows["weight"].to_numpy(float), flat[order], of[order], tf[order], df[order])

    def pack(self) -> bytes:
        own, first, number = np.unique(self.h, return_index=True, return_counts=True)
        parts = [b"".join(self.seq), b"".join(self.label), self.weight.tobytes(), own.tobytes(), planes(self.df[first]), planes(number), planes(self.of), planes(self.tf)]
        return zstandard.compress(b"".join(len(x).to_bytes(8, "little") + x for x in parts), 1)

    @classmethod
    def unpack(cls, blob: bytes) -> Tile:
        raw, at, parts = zstandard.decompress(blob), 0, []
        while at < len(raw):
            size = int.from_bytes(raw[at : at + 8], "little")
            parts.append(raw[at + 8 : at + 8 + size])
            at += 8 + size
        keys = lambda x: [x[k : k + 16] for k in range(0, len(x), 16)]
        number = from_planes(parts[5])
        return cls(keys(parts[0]), keys(parts[1]), np.frombuffer(parts[2]), np.repeat(np.frombuffer(parts[3], np.uint64), number), from_planes(parts[6]), from_planes(parts[7]), np.repeat(from_planes(parts[4]), number))


def common_weight(x: Tile, y: Tile | None, total: int, rare: int = 16) -> np.ndarray:
    """The sums of smaller weights of all pairs of x and y (of x alone without y).

    A shingle that occurs t times in a text counts as t features, so that the smaller weight is a product of 0s and 1s.
    Features of a few texts are added pair by pair, the others as dense products.
    """
    n = len(x.seq)
    tiles = [x] if y is None else [x, y]
    of = np.concatenate([t.of + k * n for k, t in enumerate(tiles)])
    h, tf, df = (np.concatenate([getattr(t, c) for t in tiles]) for c in ("h", "tf", "df"))
    level = textkit.spread(np.zeros(len(tf), np.int64), tf)
    h, of, df = (np.repeat(v, tf) for v in (h, of, df))
    order = np.lexsort((of, level, h))
    h, level, of, w = h[order], level[order], of[order], idf(df[order], total)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (level[1:] != level[:-1])
    feature = np.cumsum(new) - 1
    number = np.bincount(feature)
    side = np.bincount(feature, of < n) if y is not None else number
    useful = (number > 1) & (side > 0) & ((side < number) if y is not None else True)
    on = useful[feature] & (number[feature] <= rare)
    f, d, v = feature[on], of[on], w[on]
    shape = (n, n if y is None else len(y.seq))
    out = np.zeros(shape[0] * shape[1])
    for gap in range(1, rare):
        same = np.flatnonzero(f[gap:] == f[:-gap]) if len(f) > gap else np.zeros(0, np.int64)
        if not len(same):
            break
        i, j = d[same], d[same + gap]  # in order of the text's number
        if y is not None:
            cross = (i < n) & (j >= n)
            same, i, j = same[cross], i[cross], j[cross] - n
        out += np.bincount(i * shape[1] + j, v[same], minlength=len(out))
    out = out.reshape(shape)
    on = useful[feature] & (number[feature] > rare)
    f, d, v = np.unique(feature[on], return_inverse=True)[1], of[on], w[on]
    for at in range(0, int(f[-1]) + 1 if len(f) else 0, 2048):
        low, high = np.searchsorted(f, [at, at + 2048])
        block = np.zeros((shape[0] + (shape[1] if y is not None else 0), 2048))
        block[d[low:high], f[low:high] - at] = np.sqrt(v[low:high])
        out += block[:n] @ (block[:n] if y is None else block[n:]).T
    return out


def spanning(x: Tile, y: Tile | None, total: int, threshold: float) -> list[tuple[bytes, bytes, float]]:
    """Links between texts of different components, as few as connect what all of them connect."""
    common = common_weight(x, y, total)
    z = x if y is None else y
    similarity = common / (x.weight[:, None] + z.weight[None, :] - common)
    number = {c: k for k, c in enumerate(dict.fromkeys([*x.label, *z.label]))}
    cx, cz = (np.array([number[c] for c in t.label]) for t in (x, z))
    hit = (similarity >= threshold - SLACK) & (cx[:, None] != cz[None, :])
    i, j = np.nonzero(np.triu(hit, 1) if y is None else hit)
    kept = forest(cx[i], cz[j], len(number))
    return [(x.seq[i[k]], z.seq[j[k]], float(similarity[i[k], j[k]])) for k in kept]


def within_families(families: DataFrame, labels: DataFrame, vectors: DataFrame, total: int, threshold: float, tile: int = 1024, tile_bytes: int = 8 << 20) -> DataFrame:
    """Spanning links (a, b, similarity) of the texts of each family (node, component)."""
    spark = families.sparkSession
    partitions = shuffle_partitions(spark)
    of = families.select(F.col("node").alias("seq"), F.col("component").alias("family"))
    own = labels.select(F.col("node").alias("seq"), F.col("component").alias("label"))
    rows = of.join(own, "seq", "left").join(vectors.drop("bands", "share"), "seq").withColumn("label", F.coalesce("label", "seq"))
    rows = stored(rows, "near-families")
    size = F.octet_length("hashes").cast("long")
    sizes = rows.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / tile), F.ceil(F.sum(size) / tile_bytes)).cast("int").alias("tiles"))
    rows = stored(rows.join(sizes, "family").withColumn("tile", F.pmod(F.xxhash64("seq"), F.col("tiles")).cast("int")), "near-tiles")
    small = rows.filter("tiles = 1")
    bins = int(max(partitions, (small.agg(F.sum(size)).first()[0] or 0) // tile_bytes))

    def alone(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [link for _, own in pdf.groupby("family", sort=False) for link in spanning(Tile.of_rows(own), None, total, threshold)]
        return pd.DataFrame(out, columns=["a", "b", "similarity"])

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], key[1], key[2], Tile.of_rows(pdf).pack())], columns=["family", "tiles", "tile", "blob"])

    def paired(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tiles = [Tile.unpack(x) for x in pdf.sort_values("tile")["blob"]]
        if len(tiles) < 1 + (key[1] != key[2]):  # one of the two has no rows
            return pd.DataFrame([], columns=["a", "b", "similarity"])
        return pd.DataFrame(spanning(tiles[0], tiles[1] if len(tiles) > 1 else None, total, threshold), columns=["a", "b", "similarity"])

    found = small.withColumn("bin", F.pmod(F.xxhash64("family"), F.lit(bins))).repartition(bins, "bin").groupBy("bin").applyInPandas(alone, LINK)
    tiles = stored(rows.filter("tiles > 1").groupBy("family", "tiles", "tile").applyInPandas(packed, TILE), "near-packed")
    pairs = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("family", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "blob")
    large = pairs.repartition(4 * partitions, "family", "low", "high").groupBy("family", "low", "high").applyInPandas(paired, LINK)
    return found.unionByName(large)


def classes(docs: DataFrame, threshold: float = 0.8, size: int = 5, bands: int = 32, rows: int = 7, tile: int = 1024, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Membership (id, seq) of all documents, and verified links (a, b, similarity) that connect the seqs of a class."""
    total = docs.count()
    deals = dealt(docs, shuffle_partitions(docs.sparkSession), size, key, text)
    vectors = stored(signed(weighted(deals), total, threshold, bands, rows).dropDuplicates(["seq"]), "near-vectors")
    keyed = stored(vectors.select("seq", "share", F.posexplode("bands").alias("band", "k")), "near-bands")
    buckets = keyed.groupBy("band", "k").agg(F.max(F.struct("share", "seq"))["seq"].alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    member = stored(keyed.join(buckets, ["band", "k"]).select("band", "k", "seq", "head"), "near-members")
    stars = member.filter("seq <> head").select(F.col("head").alias("a"), F.col("seq").alias("b")).distinct()
    links = stored(verified(stars, vectors, total).filter(F.col("similarity") >= threshold - SLACK), "near-stars")
    labels = components(links.select("a", "b"))
    # a bucket whose members are one component has nothing left to find
    rest = member.join(labels.withColumnRenamed("node", "seq"), "seq", "left").withColumn("c", F.coalesce("component", "seq"))
    rest = stored(rest.select("band", "k", "seq", "head", "c"), "near-rest")
    open_ = rest.groupBy("band", "k").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("band", "k")
    families = components(rest.join(open_, ["band", "k"], "left_semi").select(F.col("head").alias("a"), F.col("seq").alias("b")).distinct())
    more = stored(within_families(families, labels, vectors, total, threshold, tile), "near-links")
    return sequences(docs, key, text), links.unionByName(more)


def near_dedup(docs: DataFrame, threshold: float = 0.8, size: int = 5, bands: int = 32, rows: int = 7, tile: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, class_id (smallest key of its class), class_size, kept (key = class_id)."""
    members, links = classes(docs, threshold, size, bands, rows, tile, key, text)
    labels = components(links.select("a", "b")).withColumnRenamed("node", "seq")
    members = stored(members, "near-documents")
    # the smallest key and the number of a word sequence's documents, then of a class
    texts = members.groupBy("seq").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    texts = stored(texts.join(labels, "seq", "left").withColumn("component", F.coalesce("component", "seq")), "near-texts")
    of_class = texts.groupBy("component").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_size"))
    by_seq = stored(looked_up(texts, "component", of_class, texts.count()).select("seq", "class_id", "class_size"), "near-classes")
    return looked_up(members, "seq", by_seq, members.count()).select(F.col("id").alias(key), "class_id", "class_size", F.coalesce(F.col("id") == F.col("class_id"), F.col("class_id").isNull()).alias("kept"))


def keep_rows(docs: DataFrame, threshold: float = 0.8, size: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, the one with the smallest key, with all its columns; all rows without a key stay
    if one of them does."""
    kept = near_dedup(docs, threshold, size, key=key, text=text).filter("kept").select(F.col(key).alias("_kept_id")).dropDuplicates()
    return docs.join(kept, docs[key].eqNullSafe(kept["_kept_id"]), "left_semi")
