"""Alignment of two tokenizers' tokens by the byte offsets where both end, on Arrow arrays.

A (byte-level BPE) and B (pieces) encode the same bytes, a space and the text. Slices of a megabyte of texts become
list arrays of ids. Flattened, with the parent index of each element as its document, their tokens' byte lengths are summed
up within documents; the two tables of token ends meet in a hash join on (document, end). The joined rows are the links and
cut both sides into groups. A slice counts its pairs of ids by a group-by; Spark adds these partial counts up, finds the
highest of each B id, and sends the counts back to the slices that asked, where they are joined to the documents' pairs.
A pair that every document holds is one row a slice at most. Stored slices are read by TOGETHER, so a task's memory doesn't
depend on how many it has.

Defined results: null and empty texts, and those whose joined bytes of A or B differ from the space and the text (a literal
U+2581, say), have no tokens; special strings in texts are plain text; repeated rows are aligned each, and each counts; an
empty table gives an empty result; null keys stay null; other columns are not read. A very long text is a slice of its own,
and a task's memory grows with the longest text, not with their number.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwell.llm import textkit
from maskwell.llm.common import stored
from maskwell.llm.token_counts import word_starts

BITS = 15  # of a B id within a pair: fewer than 32,768 pieces
PARTS = "block long, ids array<long>, n_a array<int>, n_b array<int>, n_links array<int>, sha array<string>, docs array<int>, codes array<long>, freqs array<int>, pairs array<long>, counts array<long>"
OUT = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
ARROW_PARTS = pa.schema(
    [("block", pa.int64()), ("ids", pa.list_(pa.int64()))]
    + [(c, pa.list_(pa.int32())) for c in ("n_a", "n_b", "n_links")]
    + [("sha", pa.list_(pa.string())), ("docs", pa.list_(pa.int32())), ("codes", pa.list_(pa.int64())), ("freqs", pa.list_(pa.int32()))]
    + [(c, pa.list_(pa.int64())) for c in ("pairs", "counts")]
)
ARROW_OUT = pa.schema([("id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", pa.string())])
CACHE_BYTES, SLICE_BYTES, TOGETHER = 32 << 20, 1 << 20, 4
COMMA, BAR, SEMICOLON = (pa.scalar(x, pa.large_string()) for x in (",", "|", ";"))


class Vocabulary:
    """The bytes and the decimal name of every id."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.at = np.cumsum(self.sizes) - self.sizes
        self.raw = np.frombuffer(b"".join(tokens), np.uint8)
        self.names = pa.array(map(str, range(len(tokens))), pa.large_string())

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.raw[textkit.spread(self.at[ids], self.sizes[ids])]


@dataclass
class Side:
    """One tokenizer: where its pre-tokens begin, the cache of their ids, and its vocabulary."""

    starts: object
    lead: int  # how many bytes of a pre-token the encoder puts there itself
    cache: textkit.PieceCache
    vocabulary: Vocabulary

    def lists(self, buf: np.ndarray, off: np.ndarray) -> pa.ListArray:
        """The ids of each text."""
        start = self.starts(buf, off)
        at, sizes = self.cache.look_up(buf, start + self.lead, np.append(start[1:], len(buf))[: len(start)])
        ids = self.cache.ids[textkit.spread(at, sizes)]
        bound = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(textkit.owners(off, start))])]
        return pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(ids, pa.int32()))


_sides: dict[tuple, Side] = {}


def byte_side(vocabulary: str, ranks: str) -> Side:
    """A byte-level vocabulary, kept by the worker process."""
    if (name := (vocabulary, ranks)) not in _sides:
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=r"\S+", mergeable_ranks=table, special_tokens={})
        classes = textkit.Classes(Tokenizer.from_file(vocabulary).pre_tokenizer.pre_tokenize_str)
        cache = textkit.PieceCache(textkit.one_by_one(fast._core_bpe.encode_single_piece), CACHE_BYTES)
        _sides[name] = Side(lambda buf, off: textkit.byte_bpe_starts(buf, off, classes), 0, cache, Vocabulary(sorted(table, key=table.get)))
    return _sides[name]


def piece_side(model: str) -> Side:
    """A piece vocabulary, kept by the worker process."""
    if (name := (model,)) not in _sides:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        if sp.get_piece_size() > 1 << BITS:
            raise ValueError(f"{model} has more than {1 << BITS} pieces")
        b = Vocabulary([bytes([int(p[3:5], 16)]) if sp.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(map(sp.id_to_piece, range(sp.get_piece_size())))])
        space = [sp.piece_to_id("▁")]

        def pieces(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            # a space that nothing follows is a piece; as a text of its own it is none
            ids = [own if word else space for own, word in zip(sp.encode([w.decode() for w in words], num_threads=1), words, strict=True)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum())), sizes

        _sides[name] = Side(word_starts, 1, textkit.PieceCache(pieces, CACHE_BYTES), b)
    return _sides[name]


def same_texts(lists: pa.ListArray, vocabulary: Vocabulary, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Of each text, whether its tokens' bytes are the text."""
    ids = lists.flatten().to_numpy()
    joined = vocabulary.joined(ids)
    if np.array_equal(joined, buf):
        at = np.concatenate([[0], np.cumsum(vocabulary.sizes[ids])])[lists.offsets.to_numpy()]
        if np.array_equal(at, off):
            return np.ones(len(off) - 1, bool)
    at = np.concatenate([[0], np.cumsum(vocabulary.sizes[ids])])[lists.offsets.to_numpy()]
    return np.array([np.array_equal(joined[a:b], buf[x:y]) for a, b, x, y in zip(at[:-1], at[1:], off[:-1], off[1:], strict=True)], bool)


def ends(lists: pa.ListArray, vocabulary: Vocabulary, name: str) -> pa.Table:
    """doc, end (bytes from the document's begin), the id under ``name`` and its place among all."""
    ids, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    total = pc.cumulative_sum(pc.take(pa.array(vocabulary.sizes), ids))
    before = pa.array(np.concatenate([[0], total.to_numpy()])[lists.offsets.to_numpy()[:-1]])
    return pa.table({"doc": doc, "end": pc.subtract(total, pc.take(before, doc)), name: ids, f"{name}_at": pa.array(np.arange(len(ids)))})


def cut(ids: pa.Array, last: np.ndarray, vocabulary: Vocabulary) -> pa.Array:
    """The names of the ids, comma-joined, of groups that end with these places."""
    groups = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], last + 1]), pa.int64()), pc.take(vocabulary.names, ids))
    return pc.binary_join(groups, COMMA)


def aligned(buf: np.ndarray, off: np.ndarray, a: Side, b: Side) -> dict:
    """Columns of one slice: for each document its counts and digest, for each document and pair its links, and the slice's pairs."""
    n = len(off) - 1
    x, y = a.lists(buf, off), b.lists(buf, off)
    good = same_texts(x, a.vocabulary, buf, off) & same_texts(y, b.vocabulary, buf, off)
    if not good.all():
        keep = pa.array(good)
        x, y = (pc.if_else(keep, lists, pa.array([[]], pa.list_(pa.int32()))[0]) for lists in (x, y))
    left, right = ends(x, a.vocabulary, "a"), ends(y, b.vocabulary, "b")
    links = left.join(right, ["doc", "end"], join_type="inner", use_threads=False).sort_by("a_at").combine_chunks()
    doc = links["doc"].to_numpy()
    n_links = np.bincount(doc, minlength=n)
    both = pc.binary_join_element_wise(cut(left["a"].combine_chunks(), links["a_at"].to_numpy(), a.vocabulary), cut(right["b"].combine_chunks(), links["b_at"].to_numpy(), b.vocabulary), BAR)
    whole = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_links)]), pa.int64()), both), SEMICOLON)
    code = pc.add(pc.multiply(links["a"].cast(pa.int64()), 1 << BITS), links["b"].cast(pa.int64()))
    own = pa.table({"doc": links["doc"], "code": code}).group_by(["doc", "code"], use_threads=False).aggregate([([], "count_all")])
    pairs = own.group_by("code", use_threads=False).aggregate([("count_all", "sum")])
    return {
        "n_a": pc.list_value_length(x), "n_b": pc.list_value_length(y), "n_links": n_links,
        "sha": [hashlib.sha256(s.as_buffer()).hexdigest() if k else "" for s, k in zip(whole, n_links.tolist(), strict=True)],
        "docs": own["doc"], "codes": own["code"], "freqs": own["count_all"], "pairs": pairs["code"], "counts": pairs["count_all_sum"],
    }


def spaced(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each that isn't empty, and their offsets."""
    some = np.diff(off) > 0
    return np.insert(buf, off[:-1][some], 32), off + np.concatenate([[0], np.cumsum(some)])


def parts(docs: DataFrame, vocabulary: str, ranks: str, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each slice of documents; its number is the task's and the slice's in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_side(vocabulary, ranks), piece_side(model)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for row, end, buf, off in textkit.slices(batch.column(1), SLICE_BYTES):
                made = {"block": block, "ids": batch.column(0)[row:end]} | aligned(*spaced(buf, off), a, b)
                yield pa.RecordBatch.from_arrays([pa.array([made[f.name]], f.type) if f.name == "block" else one_list(made[f.name], f.type) for f in ARROW_PARTS], schema=ARROW_PARTS)
                block += 1
                del made
                pa.default_memory_pool().release_unused()

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PARTS)


def one_list(values, kind: pa.ListType) -> pa.ListArray:
    """A list array with these values as its one element."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    flat = (values if isinstance(values, pa.Array) else pa.array(values)).cast(kind.value_type)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def pair_counts(slices: DataFrame) -> DataFrame:
    """pair, n (links corpus-wide), best (whether n is the highest of its B id)."""
    each = slices.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.counts").alias("k"))
    total = each.groupBy("pair").agg(F.sum("k").alias("n"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND((1 << BITS) - 1))
    return total.withColumn("best", F.col("n") == F.max("n").over(of_b))


def scored(own: pa.Table, counts: pa.Table) -> pa.Table:
    """A slice's documents with the sums over their links; counts: what the slice has asked for."""
    row = {name: own[name].combine_chunks()[0].values for name in own.column_names if name != "block"}
    pairs = pa.table({"doc": row["docs"], "pair": row["codes"], "k": row["freqs"].cast(pa.int64())})
    found = pairs.join(counts.select(["pair", "n", "best"]), "pair", join_type="inner", use_threads=False)
    found = found.append_column("sum", pc.multiply(found["k"], found["n"])).append_column("top", pc.if_else(found["best"], found["k"], 0))
    sums = found.group_by("doc", use_threads=False).aggregate([("sum", "sum"), ("top", "sum")])
    columns = {}
    for name in ("sum_sum", "top_sum"):
        whole = np.zeros(len(row["ids"]), np.int64)
        whole[sums["doc"].to_numpy()] = sums[name].to_numpy()
        columns[name] = whole
    links = row["n_links"]
    return pa.Table.from_arrays([pa.array(c).cast(f.type) for c, f in zip((row["ids"], row["n_a"], row["n_b"], links, links, columns["top_sum"], columns["sum_sum"], row["sha"]), ARROW_OUT, strict=True)], schema=ARROW_OUT)


def alignment(docs: DataFrame, vocabulary: str, ranks: str, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Token ends within a text are all different, so every group of tokens ends with its one link.
    """
    slices = stored(parts(docs, vocabulary, ranks, model, key, text), "alignment", TOGETHER)
    asked = slices.select(F.col("block").alias("slice"), F.explode("pairs").alias("pair"))
    found = asked.join(pair_counts(slices), "pair").select("slice", "pair", "n", "best")
    own = slices.drop("pairs", "counts")
    # a slice without links has nothing to ask for, and still its documents
    return own.groupBy("block").cogroup(found.groupBy("slice")).applyInArrow(scored, OUT).withColumnRenamed("id", key)
