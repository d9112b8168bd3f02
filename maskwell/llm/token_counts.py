"""Token counts of a piece vocabulary without token ids.

No piece of the vocabulary goes on past the end of a word into the next space, so a text's pieces are those
of its pre-tokens (a run of spaces and the word after it). One pass splits the texts and leaves, for each
block of a few megabytes, the block's distinct pre-tokens and its documents' pre-token frequencies. The
distinct pre-tokens (told apart by their bytes) meet by hash and each is counted once with the library; the counts go back to the blocks
that asked, are joined to the frequencies there and summed by document. A pre-token that every document has
is one row a block at most, whatever its frequency.

Defined results: null and empty texts have 0 tokens; repeated rows are counted each; an empty table gives an
empty result; null keys stay null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.llm import textkit
from maskwell.llm.common import shuffle_partitions, stored, whole_text

PARTS = "block long, bucket int, docs binary, sizes binary, words binary, lengths binary, codes binary, freqs binary"
KNOWN_BYTES = 96 << 20
_models: dict[str, object] = {}


def planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values, compressed with their bytes apart: small values leave runs of zeros."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def word_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin: each text's first byte, and spaces after other bytes.

    A literal U+2581 is a space to the library, so the space after one begins nothing.
    """
    space = buf == 32
    start = space.copy()
    start[1:] &= ~space[:-1]
    mark = np.flatnonzero((buf[:-3] == 0xE2) & (buf[1:-2] == 0x96) & (buf[2:-1] == 0x81)) if len(buf) > 3 else []
    start[np.asarray(mark, np.int64) + 3] = False
    start[off[:-1][np.diff(off) > 0]] = True
    return np.flatnonzero(start)


def split(docs: DataFrame, buckets: int, key: str, text: str) -> DataFrame:
    """For each block one row with its documents' frequencies (bucket -1), and one a bucket with distinct pre-tokens."""

    def block(ids: np.ndarray, unnamed: np.ndarray, buf: np.ndarray, off: np.ndarray) -> Iterator[dict]:
        start = word_starts(buf, off)
        end = np.append(start[1:], len(buf))[: len(start)]
        owned = textkit.owners(off, start)
        # the library puts a space before a text: a text's first pre-token is whole, others go without their first space
        inner = np.ones(len(start), np.int64)
        inner[np.searchsorted(start, off[:-1][np.diff(off) > 0])] = 0
        lead = start + inner
        keys, where, code = textkit.distinct(buf, lead, end)
        doc = np.repeat(np.arange(len(owned)), owned)
        pair, freq = np.unique(doc * len(keys) + code, return_counts=True) if len(keys) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        doc, code = np.divmod(pair, max(1, len(keys)))
        step = np.diff(code, prepend=0)
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        step[first] = code[first]
        name = xxhash.xxh3_64_intdigest(ids.tobytes() + buf.tobytes()) >> 1
        sizes = np.concatenate([np.diff(off), np.bincount(doc, minlength=len(owned)), unnamed])
        yield {"block": name, "bucket": -1, "docs": ids.astype("<i8").tobytes(), "sizes": planes(sizes), "codes": planes(step), "freqs": planes(freq)}
        bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        size = (end - lead)[where]
        words = buf[textkit.spread(lead[where], size)]
        at = np.concatenate([[0], np.cumsum(size)])
        edge = np.searchsorted(bucket, np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edge)).tolist():
            x, y = edge[b], edge[b + 1]
            yield {"block": name, "bucket": b, "words": zstandard.compress(words[at[x] : at[y]].tobytes(), 3), "lengths": planes(size[x:y])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in PARTS.split(", ")]
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 6]
        for batch in batches:
            ids, unnamed = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for row, end, buf, off in textkit.slices(batch.column(1)):
                rows = list(block(ids[row:end], unnamed[row:end], buf, off))
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    return docs.select(F.col(key).cast("long").alias("id"), whole_text(text).alias("text")).mapInArrow(run, PARTS)


def _count(model: str, words: list[str]) -> list[int]:
    """How many pieces each pre-token has, without its leading space."""
    if model not in _models:
        import sentencepiece

        _models[model] = sentencepiece.SentencePieceProcessor(model_file=model)
    sp = _models[model]
    one = 1 if sp.piece_to_id("▁") != sp.unk_id() else 3  # a space that nothing follows
    return [len(ids) if word else one for ids, word in zip(sp.encode(words, num_threads=1), words, strict=True)]


def piece_counts(parts: DataFrame, model: str) -> DataFrame:
    """block, bucket, counts: for each bucket of a block, the pieces of its pre-tokens in order.

    A task sees all rows of its buckets and counts a distinct pre-token when it first comes; what it knows is held up
    to KNOWN_BYTES, and counted again when it comes after that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        held = 0
        for batch in batches:
            counts = []
            for words, lengths in zip(batch.column(2), batch.column(3), strict=True):
                raw, size = zstandard.decompress(words.as_py()), from_planes(lengths.as_py())
                at = np.concatenate([[0], np.cumsum(size)]).tolist()
                own = [raw[a:b] for a, b in zip(at, at[1:])]  # noqa: B905
                if held > KNOWN_BYTES:
                    known.clear()
                    held = 0
                if new := [w for w in dict.fromkeys(own) if w not in known]:
                    held += sum(map(len, new)) + 150 * len(new)
                    known.update(zip(new, _count(model, [w.decode() for w in new]), strict=True))
                counts.append(planes(np.fromiter((known[w] for w in own), np.uint32, len(own))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.binary())], ["block", "bucket", "counts"])

    rows = parts.filter("bucket >= 0").select("block", "bucket", "words", "lengths")
    return rows.repartition(shuffle_partitions(parts.sparkSession), "bucket").mapInArrow(run, "block long, bucket int, counts binary")


def token_counts(docs: DataFrame, model: str, limit: int = 4096, buckets: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_bytes, n_tokens, over_limit (n_tokens > limit).

    buckets: how many shares the distinct pre-tokens are dealt to; the shuffle partitions unless given.
    """
    parts = stored(split(docs, buckets or shuffle_partitions(docs.sparkSession), key, text), "token-parts")

    def sums(blocks: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        counts = counts.drop_duplicates("bucket").sort_values("bucket")
        pieces = np.concatenate([np.zeros(0, np.int64), *map(from_planes, counts["counts"])])
        out = []
        for docs_, sizes, codes, freqs in zip(blocks["docs"], blocks["sizes"], blocks["codes"], blocks["freqs"], strict=True):
            ids, (n_bytes, owned, unnamed) = np.frombuffer(docs_, "<i8"), from_planes(sizes).reshape(3, -1)
            step = from_planes(codes)
            doc = np.repeat(np.arange(len(ids)), owned)
            total = np.cumsum(step)
            begin = np.cumsum(owned) - owned
            base = np.where(owned > 0, np.concatenate([[0], total])[begin], 0)
            code = total - base[doc]
            n = np.bincount(doc, pieces[code] * from_planes(freqs), minlength=len(ids)).astype(np.int64)
            out.append(pd.DataFrame({"id": pd.arrays.IntegerArray(ids.copy(), unnamed > 0), "n_bytes": n_bytes, "n_tokens": n, "over_limit": n > limit}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "n_bytes": [], "n_tokens": [], "over_limit": []}).astype({"id": int, "n_bytes": int, "n_tokens": int, "over_limit": bool})

    blocks = parts.filter("bucket < 0").select("block", "docs", "sizes", "codes", "freqs")
    joined = blocks.groupBy("block").cogroup(piece_counts(parts, model).groupBy("block")).applyInPandas(sums, "id long, n_bytes long, n_tokens long, over_limit boolean")
    return joined.withColumnRenamed("id", key)
