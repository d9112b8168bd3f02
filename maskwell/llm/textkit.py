"""Vectorised text helpers that run inside tasks: pieces of a batch of texts, their hashes, bounded caches.

A batch of texts is one UTF-8 buffer with offsets, as Arrow holds it. Everything works on slices of a few
megabytes, so a task's memory doesn't depend on how many texts it gets; a single longer text is a slice of
its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 3 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
SHORT = np.uint64(0x5851F42D4C957F2D)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, (1 << 20) + 1), base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def running(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial in the bytes; element i covers buf[:i]. For the cells of features, not for identity."""
    out = np.zeros(len(buf) + 1, np.uint64)
    p, _ = powers(len(buf) + 1)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[:-1], out=out[1:])
    return out


class Hasher:
    """64-bit hashes of stretches of a buffer, the same wherever the bytes stand.

    Every eight bytes in a row are mixed to a value before they are summed as a polynomial, so that no pattern of the
    bytes cancels out in the sum. Equal hashes are no proof: see distinct().
    """

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        wide = np.zeros(n + 8, np.uint8)
        wide[:n] = buf
        self.words = np.ndarray((n + 1,), "<u8", wide, strides=(1,))
        p, self.inverse = powers(n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(self.words[:n].copy()) * p[:n], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        whole = (self.prefix[np.maximum(start, end - 7)] - self.prefix[start]) * self.inverse[start]
        short = self.words[start] & MASKS[np.minimum(size, 8)]
        return mix(np.where(size >= 8, whole, short ^ SHORT) + size.astype(np.uint64))

    def all_of(self, size: int) -> np.ndarray:
        """Of every stretch of ``size`` bytes, at least eight."""
        n = max(0, len(self.prefix) - size)
        return mix((self.prefix[size - 7 : size - 7 + n] - self.prefix[:n]) * self.inverse[:n] + np.uint64(size))


def same_bytes(a: np.ndarray, start: np.ndarray, b: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[start : start + size] equals b[other : other + size], for each."""
    if not len(size):
        return np.zeros(0, bool)
    differ = np.concatenate([[0], np.cumsum(a[spread(start, size)] != b[spread(other, size)])])
    at = np.concatenate([[0], np.cumsum(size)])
    return differ[at[1:]] == differ[at[:-1]]


def distinct(buf: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different stretches by their bytes, in order of their hashes: hash, number of a stretch, and the number in
    this list of each. Stretches with one hash are compared with its first; different ones get entries of their own."""
    keys = Hasher(buf).of(start, end) if keys is None else keys
    own, where, inverse = np.unique(keys, return_index=True, return_inverse=True)
    first = where[inverse]
    size = end - start
    equal = size == size[first]
    again = np.flatnonzero(equal & (first != np.arange(len(first))))
    equal[again] = same_bytes(buf, start[again], buf, start[first[again]], size[again])
    odd = np.flatnonzero(~equal)
    if not len(odd):
        return own, where, inverse
    seen: dict[bytes, int] = {}
    raw, extra = buf.tobytes(), []
    for k in odd.tolist():
        n = seen.setdefault(raw[start[k] : end[k]], len(own) + len(extra))
        if n == len(own) + len(extra):
            extra.append(k)
        inverse[k] = n
    own, where = np.concatenate([own, keys[extra]]), np.concatenate([where, extra])
    order = np.argsort(own, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return own[order], where[order], rank[inverse]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of at most ``most`` bytes: first row, end row, their bytes, offsets from 0. Null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + most, "right")) - 1)
        yield row, end, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def owners(off: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many of the sorted positions lie in each text."""
    cut = np.searchsorted(starts, off)
    return np.diff(cut)


SPACE, LETTER, NUMBER, OTHER, UNSEEN, NONE = 0, 1, 2, 3, 8, 9


class Classes:
    """The class of every character as a library's splitter has it, asked once for each character that occurs.

    split: the pieces of a text. A character goes on after a letter, a digit or a mark of its own class only.
    """

    def __init__(self, split: Callable[[str], list]):
        self.split = split
        self.table = np.full(0x110000, UNSEEN, np.uint8)

    def ask(self, code: int) -> int:
        kinds = (("a", LETTER), ("1", NUMBER), ("!", OTHER))
        return next((kind for before, kind in kinds if len(self.split(before + chr(code))) == 1), SPACE)

    def of(self, codes: np.ndarray) -> np.ndarray:
        out = self.table[codes]
        if (out == UNSEEN).any():
            for code in np.unique(codes[out == UNSEEN]).tolist():
                self.table[code] = self.ask(code)
            out = self.table[codes]
        return out


def codes_at(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code point of the character that begins at each position."""
    lead = buf[at]
    out = lead.astype(np.int32)
    for low, high, size in ((0xC0, 0xE0, 2), (0xE0, 0xF0, 3), (0xF0, 0xFF, 4)):
        k = np.flatnonzero((lead >= low) & (lead < high))
        if len(k):
            p = at[k]
            code = buf[p].astype(np.int32) & (0xFF >> (size + 1))
            for j in range(1, size):
                code = (code << 6) | (buf[p + j] & 0x3F)
            out[k] = code
    return out


def byte_bpe_starts(buf: np.ndarray, off: np.ndarray, classes: Classes) -> np.ndarray:
    """Where the pre-tokens of byte_bpe_50k begin: contractions, runs of one class with a space before, white space."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    if not len(at):
        return at
    c = classes.of(codes_at(buf, at))
    space = buf[at] == 32
    first = np.zeros(len(at) + 1, bool)
    first[np.searchsorted(at, off[:-1][np.diff(off) > 0])] = True
    first[-1] = True
    before = np.empty_like(c)
    before[1:], before[0] = c[:-1], NONE
    before[first[:-1]] = NONE
    after = np.empty_like(c)
    after[:-1], after[-1] = c[1:], NONE
    after[first[1:]] = NONE
    spaced = np.empty_like(space)
    spaced[1:], spaced[0] = space[:-1], False
    spaced[first[:-1]] = False
    white = c == SPACE
    start = np.where(white, (before != SPACE) | ((after != SPACE) & (after != NONE)), (c != before) & ~spaced)
    quote = np.flatnonzero((buf[at] == 39) & start & (after == LETTER))
    if len(quote):
        wide = np.concatenate([buf[at], np.zeros(3, np.uint8)])
        one, two = wide[quote + 1], wide[quote + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        ends = np.concatenate([first, np.ones(2, bool)])
        long &= ~short & ~ends[quote + 2]
        start[quote[short | long] + 1] = False
        for k in (quote[short] + 2, quote[long] + 3):
            start[k[k < len(start)]] = True
    return at[start]


class PieceCache:
    """Ids of distinct pre-tokens; each is encoded once until the cache holds ``most`` bytes and begins anew.

    A pre-token is found by its hash and then compared with the bytes that are kept; one that differs is encoded
    for the slice alone. encode: the ids of many pre-tokens, one after the other, and how many each has.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 24 << 20):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.sizes, self.raw_at, self.raw_sizes = (np.zeros(0, np.int64) for _ in range(4))
        self.ids = np.zeros(0, np.uint32)
        self.raw = np.zeros(0, np.uint8)

    def held(self) -> int:
        return 40 * len(self.keys) + 4 * len(self.ids) + len(self.raw)

    def look_up(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pre-token, where its ids are in self.ids and how many; good until the next call."""
        keys, where, inverse = distinct(buf, start, end)
        if self.held() > self.most:
            self.clear()
        size = (end - start)[where]
        k = np.searchsorted(self.keys, keys)
        found = np.zeros(len(keys), bool)
        if len(self.keys):
            near = np.minimum(k, len(self.keys) - 1)
            may = np.flatnonzero((self.keys[near] == keys) & (self.raw_sizes[near] == size))
            found[may] = same_bytes(buf, start[where[may]], self.raw, self.raw_at[near[may]], size[may])
        at, sizes = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at[found], sizes[found] = self.at[k[found]], self.sizes[k[found]]
        miss = np.flatnonzero(~found)
        if len(miss):
            raw, w = buf.tobytes(), where[miss]
            new, sizes[miss] = self.encode([raw[a:b] for a, b in zip(start[w].tolist(), end[w].tolist(), strict=True)])
            at[miss] = len(self.ids) + np.cumsum(sizes[miss]) - sizes[miss]
            self.ids = np.concatenate([self.ids, new.astype(np.uint32)])
            # the first of a hash is kept for later slices
            first = miss[np.concatenate([[True], keys[miss][1:] != keys[miss][:-1]])]
            first = first[(k[first] == len(self.keys)) | (self.keys[np.minimum(k[first], len(self.keys) - 1)] != keys[first])] if len(self.keys) else first
            into, w = k[first], where[first]
            raw_at = len(self.raw) + np.cumsum(size[first]) - size[first]
            self.raw = np.concatenate([self.raw, buf[spread(start[w], size[first])]])
            for name, values in (("keys", keys[first]), ("at", at[first]), ("sizes", sizes[first]), ("raw_at", raw_at), ("raw_sizes", size[first])):
                setattr(self, name, np.insert(getattr(self, name), into, values))
        return at[inverse], sizes[inverse]


def one_by_one(encode: Callable[[bytes], list[int]]) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    def run(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [encode(x) for x in pieces]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum())), sizes

    return run


def spread(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """at[0], at[0]+1, ... (sizes[0] of them), then at[1], ...: the elements of many runs."""
    total = int(sizes.sum())
    begin = np.cumsum(sizes) - sizes
    return np.arange(total) + np.repeat(at - begin, sizes)
