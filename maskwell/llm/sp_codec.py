"""SentencePiece encoding and decoding by a max-plus scan over boundary states.

The model merges pairs (its scores are merge priorities), so an encoding is not the segmentation with the best sum of
scores. It is a path all the same: pieces s1 s2 ... are the encoding of their text exactly when every two neighbours
are (merging the text of s, t alone gives s, t), since the first merge across a border would happen in the pair alone
as well. So a lattice has a step from s to t worth 0 where that holds and minus infinity elsewhere, and the encoding is
its only path worth more than minus infinity; scores add along paths and the larger of two is kept.

A text of more than ``chunk`` characters is cut anywhere. The state at a cut is the piece that holds the character
before it, with how far it begins before and ends after the cut. Each chunk by itself yields a transfer matrix
from the states at its left cut to those at its right cut (all rows in one sweep). The matrices are combined
associatively in a tree: every level joins up to ``FAN`` neighbours, by Spark groups of (text, node), so a text of any
number of chunks takes as many levels as the logarithm says and no task holds all of its chunks. At the root both ends
are known; going down, each node's states at its inner cuts follow from those at its two ends, which leaves one state
for each cut, and every chunk is then traced back by itself between its two states.

Pieces don't go on from a word into the next space, so between words the lattice has one state. Each distinct word is
solved once a worker, as long as the cache of bounded size holds it: words of up to 40 characters by merging pairs, all
words of a slice at a time, and longer ones by walking the lattice, which takes linear time.

Ids are those of the library; decoding gives the text back (a literal U+2581 as a space, as in the library).

Defined results: null and empty texts have one chunk without ids; repeated rows are encoded each (a text of several
chunks is named by its key and text); an empty table gives an empty result; null keys stay
null; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.llm import textkit
from maskwell.llm.common import shuffle_partitions, stored, whole_text
from maskwell.llm.token_counts import word_starts

MARK = "▁"
FAN = 16
SHORT = 40  # characters
JOINS = 100_000
SLICE = 1 << 20  # bytes of text that a worker has in hand; it takes some 50 times as much
_codecs: dict[str, Codec] = {}
State = tuple[int, int]  # characters of the piece before the cut, and after it


class Codec:
    """The vocabulary, the lattice over it, and caches; one a worker."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        self.ids = {sp.id_to_piece(i): i for i in range(n) if not special[i]}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in range(n) if not special[i]}
        self.longest = max(map(len, self.ids))
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        raw = [b"" if special[i] else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte_ids):
            raw[i] = bytes([b])
        self.sizes = np.fromiter(map(len, raw), np.int64, n)
        self.at = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.joins: dict[tuple[str | None, str], bool] = {}
        self.words = textkit.PieceCache(self.encode_words)
        # symbols are the characters of pieces and the pieces; merges are the pairs of symbols that make a piece
        chars = sorted({c for piece in self.ids for c in piece})
        self.chars = np.array([ord(c) for c in chars], np.int64)
        self.symbols = chars + [p for p in self.ids if len(p) > 1]
        number = {x: k for k, x in enumerate(self.symbols)}
        best = {s: k for k, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        merges = sorted((number[p[:k]] * (len(number) + 1) + number[p[k:]], best[s], number[p]) for p, s in self.score.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number)
        self.pairs, self.ranks, self.makes = (np.array(x, np.int64) for x in zip(*merges, strict=True))
        flat = [self.piece_ids(x) for x in self.symbols]
        self.symbol_sizes = np.fromiter(map(len, flat), np.int64, len(flat))
        self.symbol_at = np.cumsum(self.symbol_sizes) - self.symbol_sizes
        self.symbol_ids = np.array([i for x in flat for i in x], np.int64)

    def merge(self, text: str) -> list[str]:
        """Merge the pair with the best score, the leftmost of equals, until no pair is a piece."""
        parts = list(text)
        while True:
            best, at = -np.inf, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and s > best:
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def joined(self, s: str | None, t: str) -> bool:
        """Whether the step from s to t is worth 0; s is None where nothing can merge across."""
        key = (s, t)
        known = self.joins.get(key)
        if known is None:
            if s is not None and t[0] == MARK and s[-1] != MARK:
                known = self.joined(None, t)
            else:
                known = self.merge(t) == [t] if s is None else self.merge(s + t) == [s, t]
            if len(self.joins) > JOINS:
                self.joins.clear()
            self.joins[key] = known
        return known

    def piece_ids(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [i] if i is not None else [self.byte_ids[b] for b in piece.encode()]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words with their spaces, one after the other, and how many each has."""
        texts = [w.decode().replace(" ", MARK) for w in words]
        short = [k for k, t in enumerate(texts) if len(t) <= SHORT]
        ids: list = [None] * len(texts)
        for k, t in enumerate(texts):
            if len(t) > SHORT:
                ids[k] = np.array(self.walk(t), np.int64)
        flat, sizes = self.merge_all([texts[k] for k in short])
        edge = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        if len(short) == len(texts):
            return flat, sizes
        for n, k in enumerate(short):
            ids[k] = flat[edge[n] : edge[n + 1]]
        return np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids))

    def merge_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Merge the best pair of every text, the leftmost of equals, until none has a pair that is a piece."""
        code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        of = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
        k = np.minimum(np.searchsorted(self.chars, code), len(self.chars) - 1)
        n = len(self.symbols)
        symbol = np.where(self.chars[k] == code, k, n)  # n: a character that no piece has
        done = []
        while len(symbol):
            pair = symbol[:-1] * (n + 1) + symbol[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            ok = np.flatnonzero((self.pairs[at] == pair) & (of[:-1] == of[1:]))
            worth = self.ranks[at[ok]] * len(symbol) + ok
            first = np.flatnonzero(np.diff(of[ok], prepend=-1))
            pick = np.minimum.reduceat(worth, first) % len(symbol) if len(ok) else ok
            go = np.zeros(len(texts), bool)
            go[of[pick]] = True
            symbol[pick] = self.makes[at[pick]]
            stay = np.ones(len(symbol), bool)
            stay[pick + 1] = False
            more = go[of]
            done.append((of[~more], symbol[~more], code[~more]))
            of, symbol, code = of[stay & more], symbol[stay & more], code[stay & more]
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        of, symbol, code = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(of, kind="stable")
        of, symbol, code = of[order], symbol[order], code[order]
        known = symbol < n
        size = np.ones(len(symbol), np.int64)
        size[known] = self.symbol_sizes[symbol[known]]
        odd = [[self.byte_ids[b] for b in chr(c).encode()] for c in code[~known].tolist()]
        size[~known] = np.fromiter(map(len, odd), np.int64, len(odd))
        begin = np.cumsum(size) - size
        ids = np.empty(int(size.sum()), np.int64)
        ids[textkit.spread(begin[known], size[known])] = self.symbol_ids[textkit.spread(self.symbol_at[symbol[known]], size[known])]
        ids[textkit.spread(begin[~known], size[~known])] = [i for x in odd for i in x]
        return ids, np.bincount(of, size, minlength=len(texts)).astype(np.int64)

    def walk(self, text: str) -> list[int]:
        """The ids of a word: its lattice has one piece that can end at each character."""
        n, ids, joins, longest = len(text), self.ids, self.joins, self.longest
        last: list[str | None] = [None] * (n + 1)
        for j in range(1, n + 1):
            for k in range(max(0, j - longest), j):
                piece = text[k:j]
                if (piece in ids or j - k == 1) and (k == 0 or last[k] is not None):
                    ok = joins.get((last[k], piece))
                    if ok if ok is not None else self.joined(last[k], piece):
                        last[j] = piece
                        break
        out: list[str] = []
        j = n
        while j:
            out.append(last[j])
            j -= len(out[-1])
        return [i for piece in reversed(out) for i in self.piece_ids(piece)]

    def sweep(self, text: str, begin: list[tuple[int, str | None]], cut: int) -> list[dict[str | None, int]]:
        """For each end, the pieces that end there with the set (as bits) of begins that lead there.

        begin: where paths start and the piece before. Pieces begin before ``cut``; they may end after it.
        """
        nodes: list[dict[str | None, int]] = [{} for _ in range(len(text) + 1)]
        for bit, (at, piece) in enumerate(begin):
            nodes[at][piece] = nodes[at].get(piece, 0) | 1 << bit
        for k in range(min(cut, len(text))):
            if not nodes[k]:
                continue
            for j in range(k + 1, min(len(text), k + self.longest) + 1):
                piece = text[k:j]
                if piece in self.ids or j - k == 1:
                    bits = 0
                    for s, b in nodes[k].items():
                        if self.joined(s, piece):
                            bits |= b
                    if bits:
                        nodes[j][piece] = nodes[j].get(piece, 0) | bits
        return nodes

    def trace(self, text: str, begin: tuple[int, str | None], end: int, last: str) -> list[int]:
        """The ids of the only path from begin to the piece ``last`` that ends at ``end``."""
        nodes = self.sweep(text, [begin], end)
        out: list[str] = []
        at, piece = end, last
        while True:
            out.append(piece)
            at -= len(piece)
            if at <= begin[0]:
                break
            piece = next(s for s in nodes[at] if self.joined(s, piece))
        return [i for p in reversed(out) for i in self.piece_ids(p)]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[textkit.spread(self.at[ids], self.sizes[ids])].tobytes()


def codec(model: str) -> Codec:
    if model not in _codecs:
        _codecs[model] = Codec(model)
    return _codecs[model]


def word_edges(text: str) -> list[int]:
    """Where words begin: spaces after other characters."""
    return [m.start() for m in re.finditer(f"(?<=[^{MARK}]){MARK}", text)]


def cut_states(c: Codec, left: str, right: str) -> list[State]:
    """Every state that the characters around a cut allow."""
    out = []
    for a in range(1, min(len(left), c.longest) + 1):
        for b in range(0, min(len(right), c.longest - a) + 1):
            if a + b == 1 or left[len(left) - a :] + right[:b] in c.ids:
                out.append((a, b))
    return out


def transfer(c: Codec, left: str, body: str, right: str) -> list[tuple[State, State]]:
    """The cells of a chunk's matrix that are worth 0: (state at the left cut, state at the right cut).

    A text's first cut has the state (0, 0) alone; its last cut has no piece beyond it.
    """
    text = body + right
    entries = cut_states(c, left, text) if left else [(0, 0)]
    begin = [(b, left[len(left) - a :] + text[:b] if a else None) for a, b in entries]
    edges = word_edges(left[-1:] + body)
    edges = [e - len(left[-1:]) for e in edges]

    def exits(nodes: list) -> list[tuple[State, int]]:
        return [((len(p) - (j - len(body)), j - len(body)), bits) for j in range(len(body), len(text) + 1) for p, bits in nodes[j].items() if p is not None and len(p) > j - len(body)]

    if not edges:
        out = exits(c.sweep(text, begin, len(body)))
        return [(entries[k], state) for state, bits in out for k in range(len(entries)) if bits >> k & 1]
    first, last = edges[0], edges[-1]
    # words don't mix: entries that reach the first edge, and exits from the last one, in any combination
    bits = 0
    for b in c.sweep(text[:first], [x for x in begin if x[0] <= first], first)[first].values():
        bits |= b
    inside = [e for e, x in zip(entries, begin, strict=True) if x[0] <= first]
    good = [e for k, e in enumerate(inside) if bits >> k & 1]
    tail = text[last:]
    found = c.sweep(tail, [(0, None)], len(body) - last)
    states = [((len(p) - (j + last - len(body)), j + last - len(body)), b) for j in range(len(body) - last, len(tail) + 1) for p, b in found[j].items() if p is not None and len(p) > j + last - len(body)]
    return [(e, s) for e in good for s, _ in states]


def combine(x: list[tuple[State, State]], y: list[tuple[State, State]]) -> list[tuple[State, State]]:
    """The max-plus product of two matrices of 0 and minus infinity."""
    by: dict[State, set[State]] = {}
    for a, b in y:
        by.setdefault(a, set()).add(b)
    return sorted({(a, z) for a, b in x for z in by.get(b, ())})


def to_bytes(cells: list[tuple[State, State]]) -> bytes:
    return np.array(cells, "<i2").tobytes()


def from_bytes(raw: bytes) -> list[tuple[State, State]]:
    return [((a, b), (y, z)) for a, b, y, z in np.frombuffer(raw, "<i2").reshape(-1, 4).tolist()]


def inner_states(matrices: list[list[tuple[State, State]]], begin: State, end: State) -> list[State]:
    """The states at all cuts of neighbours whose two ends are known: forward products, then back from the end."""
    reach: list[set[State]] = [{begin}]
    for m in matrices:
        reach.append({b for a, b in m if a in reach[-1]})
    out = [end]
    for k in range(len(matrices) - 1, -1, -1):
        out.append(next(a for a, b in matrices[k] if b == out[-1] and a in reach[k]))
    return out[::-1]


STATES = "doc binary, node int, a int, b int, y int, z int"


def scan(cells: DataFrame, last: int, partitions: int) -> DataFrame:
    """The states at both ends of every chunk (STATES, node: the chunk), from the chunks' matrices (doc, node, cells).

    last: the largest chunk number of any text.
    """
    up = F.expr(f"node div {FAN}").cast("int")

    def binned(rows: DataFrame) -> DataFrame:
        return rows.withColumn("bin", F.pmod(F.xxhash64("doc", "parent"), F.lit(8 * partitions))).repartition(partitions, "bin")

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (doc, parent), own in pdf.sort_values("node").groupby(["doc", "parent"], sort=False):
            out.append((doc, parent, to_bytes(reduce(combine, map(from_bytes, own["cells"])))))
        return pd.DataFrame(out, columns=["doc", "node", "cells"])

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (doc, _), own in pdf.sort_values("node").groupby(["doc", "parent"], sort=False):
            x = own.iloc[0]
            states = inner_states([from_bytes(c) for c in own["cells"]], (x.a, x.b), (x.y, x.z))
            out.extend((doc, node, *s, *t) for node, s, t in zip(own["node"], states, states[1:]))  # noqa: B905
        return pd.DataFrame(out, columns=["doc", "node", "a", "b", "y", "z"])

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(x.doc, x.node, *next(c for c in from_bytes(x.cells) if c[0] == (0, 0) and c[1][1] == 0)) for x in pdf.itertuples()]
        return pd.DataFrame([(doc, node, *a, *b) for doc, node, a, b in out], columns=["doc", "node", "a", "b", "y", "z"])

    levels = [cells]
    while last > 0:
        last //= FAN
        joined = binned(levels[-1].withColumn("parent", up)).groupBy("bin").applyInPandas(product, "doc binary, node int, cells binary")
        levels.append(stored(joined, "products"))
    states = levels.pop().mapInPandas(lambda parts: map(ends, parts), STATES)
    while levels:
        above = states.select("doc", F.col("node").alias("parent"), "a", "b", "y", "z")
        rows = levels.pop().withColumn("parent", up).join(above, ["doc", "parent"])
        states = binned(rows).groupBy("bin").applyInPandas(down, STATES)
    return states


def encode_bodies(c: Codec, texts: pa.Array) -> Iterator[tuple[np.ndarray, bytes]]:
    """The ids and bytes of texts that begin and end between words (empty ones have none)."""
    for _, _, buf, off in textkit.slices(texts, SLICE):
        start = word_starts(buf, off)
        end = np.append(start[1:], len(buf))[: len(start)]
        at, sizes = c.words.look_up(buf, start, end) if len(start) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        ids = c.words.ids[textkit.spread(at, sizes)]
        pieces = np.concatenate([[0], np.cumsum(sizes)])
        bound = pieces[np.concatenate([[0], np.cumsum(textkit.owners(off, start))])].tolist()
        raw = buf.tobytes()
        for k in range(len(off) - 1):
            yield ids[bound[k] : bound[k + 1]], raw[off[k] : off[k + 1]]


def chunks(docs: DataFrame, chunk: int, context: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Texts of one chunk (id, text), and the chunks of longer ones (id, doc, chunk, left, body, right)."""
    rows = docs.select(F.col(key).cast("long").alias("id"), whole_text(text).alias("text")).withColumn("n", F.length("text"))
    long = rows.filter(F.col("n") > chunk).select("id", F.unhex(F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("-")), F.lit(" "), "text"))).alias("doc"), "text", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / chunk).cast("int"))).alias("chunk"))
    at = F.col("chunk") * chunk
    before = F.greatest(at - context, F.lit(0))
    piece = lambda start, size: F.substring(F.col("text"), (start + 1).cast("int"), size.cast("int"))
    parts = long.select(
        "id",
        "doc",
        "chunk",
        F.when(F.col("chunk") > 0, piece(before, at - before)).otherwise("").alias("left"),
        piece(at, F.lit(chunk)).alias("body"),
        piece(at + chunk, F.lit(context)).alias("right"),
    )
    return rows.filter(F.col("n") <= chunk).select("id", "text"), parts


ENCODED = "id long, chunk int, ids array<int>, exact boolean"


def encode(docs: DataFrame, model: str, chunk: int = 16_384, context: int = 32, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per chunk: id, chunk, ids, and whether decoding them gives the chunk's text back."""
    if min(chunk, context) < codec(model).longest:
        raise ValueError("chunk and context must be as long as the longest piece at least")
    short, parts = chunks(docs, chunk, context, key, text)

    def lead(texts: pa.Array) -> pa.Array:
        """Texts as the library takes them: with a space before what isn't empty."""
        texts, wide = texts.cast(pa.large_string()), pa.large_string()
        return pc.binary_join_element_wise(pc.if_else(pc.equal(texts, ""), pa.scalar("", wide), pa.scalar(" ", wide)), texts, pa.scalar("", wide))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for row, end, _, _ in textkit.slices(batch.column(1), SLICE):
                ids, exact = [], []
                for own, raw in encode_bodies(c, lead(batch.column(1).slice(row, end - row))):
                    ids.append(pa.array(own.astype(np.int32)))
                    exact.append(c.decode(own) == raw.replace(MARK.encode(), b" "))
                yield out(batch.column(0).slice(row, end - row), [0] * len(ids), ids, exact)

    def out(keys: pa.Array, number: list[int], ids: list, exact: list[bool]) -> pa.RecordBatch:
        edge = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        flat = pa.concat_arrays([pa.array([], pa.int32()), *[x if isinstance(x, pa.Array) else pa.array(x, pa.int32()) for x in ids]])
        return pa.RecordBatch.from_arrays([keys, pa.array(number, pa.int32()), pa.ListArray.from_arrays(pa.array(edge), flat), pa.array(exact)], ["id", "chunk", "ids", "exact"])

    def marked(left: str, body: str, right: str, number: int) -> tuple[str, str, str]:
        left, body, right = (x.replace(" ", MARK) for x in (left, body, right))
        return ("", MARK + body, right) if number == 0 else ((MARK + left)[-context:], body, right)

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        rows = max(1, SLICE // chunk)
        return (batch.slice(k, rows).to_pandas(integer_object_nulls=True) for batch in batches for k in range(0, len(batch), rows))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for pdf in few(batches):
            cells = [to_bytes(transfer(c, *marked(x.left, x.body, x.right, x.chunk))) for x in pdf.itertuples()]
            yield pa.RecordBatch.from_arrays([pa.array(pdf["doc"], pa.binary()), pa.array(pdf["chunk"], pa.int32()), pa.array(cells, pa.binary())], ["doc", "node", "cells"])

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for pdf in few(batches):
            ends, middles = [], []
            for x in pdf.itertuples():
                left, body, right = marked(x.left, x.body, x.right, x.chunk)
                text = body + right
                begin = (x.b, left[len(left) - x.a :] + text[: x.b] if x.a else None)
                end = len(body) + x.z
                last = (left + text)[len(left) + end - x.y - x.z : len(left) + end]
                edges = [e - len(left[-1:]) for e in word_edges(left[-1:] + body)]
                edges = [e for e in edges if e >= x.b]
                if end <= x.b:  # the piece before covers the chunk
                    ends.append(([], [], x.b, x.b, text))
                elif not edges:
                    ends.append((c.trace(text, begin, end, last), [], end, end, text))
                else:
                    first, final = edges[0], edges[-1]
                    head: list[int] = []
                    if first > begin[0]:
                        nodes = c.sweep(text[:first], [begin], first)
                        head = c.trace(text[:first], begin, first, next(iter(nodes[first])))
                    ends.append((head, c.trace(text[final:], (0, None), end - final, last), first, final, text))
                middles.append(ends[-1][4][ends[-1][2] : ends[-1][3]].replace(MARK, " "))
            ids, exact = [], []
            for (head, tail, first, final, text), x, (own, _) in zip(ends, pdf.itertuples(), encode_bodies(c, pa.array(middles, pa.large_string())), strict=True):
                all_ids = np.concatenate([np.array(head, np.int64), own.astype(np.int64), np.array(tail, np.int64)])
                end = (len(text) - len(x.right)) + x.z
                ids.append(all_ids.astype(np.int32))
                exact.append(c.decode(all_ids) == text[x.b : max(end, x.b)].replace(MARK, " ").encode())
            yield out(pa.array(pdf["id"], pa.int64()), pdf["chunk"].tolist(), ids, exact)

    partitions = shuffle_partitions(docs.sparkSession)
    held = stored(parts.repartition(partitions, "doc", "chunk"), "chunks")
    last = held.agg(F.max("chunk")).first()[0]
    cells = held.select("doc", "chunk", "left", "body", "right").mapInArrow(matrices, "doc binary, node int, cells binary")
    states = scan(stored(cells.dropDuplicates(["doc", "node"]), "cells"), last or 0, partitions).withColumnRenamed("node", "chunk")
    encoded = held.join(states, ["doc", "chunk"]).select("id", "chunk", "left", "body", "right", "a", "b", "y", "z").mapInArrow(traced, ENCODED)
    return short.mapInArrow(whole, ENCODED).unionByName(encoded)


def decode(encoded: DataFrame, model: str, key: str = "id") -> DataFrame:
    """key, text of rows (key, chunk, ids): chunks are decoded each and joined in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            raw = [c.decode(np.asarray(x.as_py() or [], np.int64)) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], ["id", "chunk", "raw"])

    rows = encoded.select(F.col(key).alias("id"), "chunk", "ids").mapInArrow(run, "id long, chunk int, raw binary")
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "raw")))
    joined = F.aggregate(ordered, F.unhex(F.lit("")), lambda acc, x: F.concat(acc, x["raw"]))
    # the space before a text goes
    return rows.groupBy("id").agg(joined.alias("raw")).select(F.col("id").alias(key), F.decode(F.expr("substring(raw, 2)"), "UTF-8").alias("text"))


def summary(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, chunk, start (ids of the text before), n_tokens, ids_crc32 (little-endian 32-bit ids), round_trip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = [zlib.crc32(np.asarray(x.values, "<i4").tobytes()) if len(x) else 0 for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in batch.column(2)], pa.int64()), pa.array(crcs, pa.int64()), batch.column(3)], ["id", "chunk", "n_tokens", "ids_crc32", "round_trip"])

    return encoded.mapInArrow(run, "id long, chunk int, n_tokens long, ids_crc32 long, round_trip boolean").withColumnRenamed("id", key)
