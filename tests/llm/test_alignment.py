import bisect
import collections
import hashlib

import public_tokenizers
import sentencepiece
from test_text_operators import JSON, MODEL, RANKS, SCHEMA, texts
from tokenizers import Tokenizer

from maskwell.llm import alignment


def by_library(rows):
    """What the contract says, token by token."""
    a = Tokenizer.from_file(JSON)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    visible = {}
    codes = [*range(33, 127), *range(161, 173), *range(174, 256)]
    for k in range(256):
        visible[chr(k if k in codes else 256 + len([x for x in range(k) if x not in codes]))] = k
    made = {}
    for at, (_, text) in enumerate(rows):
        made[at] = ([], [], [])
        if not text:
            continue
        raw = f" {text}".encode()
        x = [(i, bytes(visible[c] for c in t)) for e in [a.encode(" " + text, add_special_tokens=False)] for i, t in zip(e.ids, e.tokens, strict=True)]
        y = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
        if b"".join(t for _, t in x) != raw or b"".join(t for _, t in y) != raw:
            continue
        ends = []
        for side in (x, y):
            at_byte, own = 0, {}
            for i, t in side:
                at_byte += len(t)
                own[at_byte] = i
            ends.append(own)
        common = sorted(ends[0].keys() & ends[1].keys())
        groups = [[[], []] for _ in common]
        for k, own in enumerate(ends):
            for e, i in own.items():
                groups[bisect.bisect_left(common, e)][k].append(str(i))
        groups = ["|".join(map(",".join, g)) for g in groups]
        made[at] = ([*ends[0]], [*ends[1]], [(ends[0][e], ends[1][e]) for e in common], ";".join(groups))
    count = collections.Counter(p for m in made.values() for p in m[2])
    best = collections.defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    return sorted(
        (rows[k][0], len(m[0]), len(m[1]), len(m[2]), len(m[2]), sum(count[p] == best[p[1]] for p in m[2]), sum(count[p] for p in m[2]), hashlib.sha256(m[3].encode()).hexdigest() if m[2] else "")
        for k, m in made.items()
    )


def got(docs):
    return sorted(tuple(r) for r in alignment.alignment(docs, JSON, RANKS, MODEL).collect())


def test_alignment_is_the_libraries_alignment(spark):
    rows = [*texts(), *texts(40), (9100, "say <|endoftext|> and </s>"), (9101, "it's  we've\n\n x "), (9102, "a▁b"), (9103, "é ﬁ ퟿")]
    docs = spark.createDataFrame([(*r, "e", "i", 1) for r in rows], SCHEMA).repartition(3)
    assert got(docs) == by_library(rows)


def test_several_slices(spark, monkeypatch):
    rows = [(k, t) for k, (_, t) in enumerate(texts(80, seed=5))]
    whole = got(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert whole == by_library(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(40)) == whole


def test_null_keys_empty_tables_clashing_columns(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (0, None, 2)], "doc_id long, text string, pair int")
    out = alignment.alignment(docs, JSON, RANKS, MODEL).collect()
    assert {(r["doc_id"], r["n_a"], r["n_b"], r["groups_sha256"] == "") for r in out} == {(None, 2, 2, False), (0, 0, 0, True)}
    assert alignment.alignment(docs.limit(0), JSON, RANKS, MODEL).count() == 0


def test_a_text_beyond_a_slice(spark):
    from maskwell.llm import textkit

    text = "the quick brown fox's 42 jumps " * (textkit.SLICE_BYTES // 31 + 100)
    docs = spark.createDataFrame([(1, text), (2, "the fox")], "doc_id long, text string")
    assert got(docs) == by_library([(1, text), (2, "the fox")])


def test_slices_are_stored_and_read_a_few_at_a_time(spark, monkeypatch):
    import glob

    import pyarrow.parquet as pq

    from maskwell.llm import common

    monkeypatch.setattr(alignment, "SLICE_BYTES", 300)
    rows = [(k, t) for k, (_, t) in enumerate(texts(150, seed=7))]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)) == by_library(rows)
    (file,) = glob.glob(f"{common._stored[-1].removeprefix('file://')}/*.parquet")
    meta = pq.ParquetFile(file).metadata
    groups = [meta.row_group(k).num_rows for k in range(meta.num_row_groups)]
    assert sum(groups) > 20 and max(groups) <= 4, groups


def test_a_space_before_each_text_that_is_not_empty():
    import numpy as np

    rows = [b"", b"ab", b"", b" c", b"\xc3\xa9", b""]
    off = np.cumsum([0, *map(len, rows)])
    buf, off = alignment.spaced(np.frombuffer(b"".join(rows), np.uint8), off)
    assert [buf[a:b].tobytes() for a, b in zip(off, off[1:], strict=False)] == [b"", b" ab", b"", b"  c", b" \xc3\xa9", b""]
    assert [x.tolist() for x in alignment.spaced(np.zeros(0, np.uint8), np.zeros(3, np.int64))] == [[], [0, 0, 0]]
