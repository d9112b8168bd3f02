import collections
import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from maskwell.llm import exact_dedup, packing, secret_scan, sp_codec, suffix_dedup, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "the", "ing", " ", "  ", "é", "▁", "\n", "中文", "😀", "tional", "'s", "'re", "0", "<s>", "<|endoftext|>", "\x00", "\t"]
SCHEMA = "doc_id long, text string, extra string, id string, n int"


def thue_morse(n=1024):
    """Two texts that a polynomial modulo a power of two can't tell apart."""
    a = "".join("ab"[bin(k).count("1") & 1] for k in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def texts(n=300, seed=1):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choices(PARTS, k=rng.randint(0, 30)))) for i in range(n)]
    return rows + [(9000, None), (9001, ""), (9002, " "), (9003, "a "), (9004, "the " * 3000), (9005, "x" * 5000), *zip((9006, 9007), thue_morse(), strict=True)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "e", "i", 1) for r in texts()], SCHEMA).cache()


def test_token_counts_are_the_library_s(docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(docs, MODEL, limit=20).collect()}
    want = {i: (len((t or "").encode()), n := len(sp.encode(t or "")), n > 20) for i, t in texts()}
    assert got == want


def test_equal_hashes_are_compared_by_their_bytes():
    import numpy as np

    from maskwell.llm import textkit

    buf = np.frombuffer(b"aa bb aa cc", np.uint8)
    start, end = np.array([0, 3, 6, 9]), np.array([2, 5, 8, 11])
    _, where, code = textkit.distinct(buf, start, end, np.zeros(4, np.uint64))
    assert len(where) == 3 and code[0] == code[2] and len({*code[[0, 1, 3]].tolist()}) == 3
    a, b = (np.frombuffer(x.encode(), np.uint8) for x in thue_morse())
    whole = np.array([0]), np.array([1024])
    assert textkit.Hasher(a).of(*whole) != textkit.Hasher(b).of(*whole)


def test_null_keys_stay_null(spark):
    docs = spark.createDataFrame([(None, "a b"), (0, "c")], "doc_id long, text string")
    assert {(r["doc_id"], r["n_tokens"]) for r in token_counts.token_counts(docs, MODEL).collect()} == {(None, 2), (0, 1)}


def test_splits_are_the_library_s_for_every_character():
    import pyarrow as pa

    library = Tokenizer.from_file(JSON)
    step = 7  # every seventh character of the code space; all of them take half a minute
    codes = [c for c in range(0, 0x110000, step) if not 0xD800 <= c < 0xE000] + [0x1C89, 0x11BE9, *range(0x13581, 0x13E48, 50)]
    own = ["".join(map(chr, codes[k : k + 40])) for k in range(0, len(codes), 40)]
    for t, ids in zip(own, packing.tokenise(pa.array(own), JSON, RANKS, 1), strict=True):
        assert library.encode(t, add_special_tokens=False).ids == ids[:-1].tolist()


def test_token_counts_of_an_empty_table(docs):
    assert token_counts.token_counts(docs.limit(0), MODEL).count() == 0


def test_codec_is_the_library_s_and_turns_back(docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for chunk in (16, 16_384):
        encoded = sp_codec.encode(docs, MODEL, chunk=chunk)
        parts = collections.defaultdict(dict)
        for r in encoded.collect():
            assert r["exact"]
            parts[r["id"]][r["chunk"]] = r["ids"]
        assert {i: [x for _, ids in sorted(p.items()) for x in ids] for i, p in parts.items()} == {i: sp.encode(t or "") for i, t in texts()}
    back = {r["id"]: r["text"] for r in sp_codec.decode(encoded, MODEL).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in texts()}


def test_codec_of_an_empty_table_and_other_columns(spark):
    schema = "doc_id long, text string, id string, doc string, chunk int, n int"
    assert sp_codec.encode(spark.createDataFrame([], schema), MODEL).count() == 0
    rows = [(1, "a b " * 30, "x", "y", 1, 2), (2, None, "x", "y", 1, 2)]
    assert {r["id"] for r in sp_codec.encode(spark.createDataFrame(rows, schema), MODEL, chunk=16).collect()} == {1, 2}


def test_long_texts_take_several_levels_of_the_scan(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(8)
    rows = [(1, "".join(rng.choices(PARTS + ["ing tion al"], k=9000))), (2, "x" * 9000), (3, "".join(rng.choice("中文字😀") for _ in range(5000))), (4, "".join(thue_morse(2000))), (None, "the end " * 700)]
    parts = collections.defaultdict(dict)
    for r in sp_codec.encode(spark.createDataFrame(rows, "doc_id long, text string"), MODEL, chunk=16).collect():
        assert r["exact"]
        parts[r["id"]][r["chunk"]] = r["ids"]
    assert max(parts[1]) >= sp_codec.FAN**2
    assert {i: [x for _, ids in sorted(p.items()) for x in ids] for i, p in parts.items()} == {i: sp.encode(t) for i, t in rows}


def test_words_are_merged_as_the_library_does():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghinostr éß中😀'0", k=rng.randint(1, 60))).replace(" ", "") or "a" for _ in range(5000)]
    ids, sizes = sp_codec.codec(MODEL).encode_words([f" {w}".encode() for w in words])
    edge = [0, *sizes.cumsum().tolist()]
    assert [ids[a:b].tolist() for a, b in zip(edge, edge[1:])] == sp.encode(words)  # noqa: B905


def test_packing_covers_every_id_once(docs):
    library = Tokenizer.from_file(JSON)
    rows = packing.packing(docs, JSON, RANKS, windows=4).collect()
    of = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in rows:
        of[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, t in texts():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted(of[i], key=lambda r: r["start"])
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        assert sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
        for r in own:
            raw = b"".join(x.to_bytes(4, "little") for x in ids[r["start"] : r["start"] + r["length"]])
            assert zlib.crc32(raw) == r["ids_crc32"]
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == [sum(x["length"] for x in pieces[:k]) for k in range(len(pieces))]
        assert sum(r["length"] for r in pieces) <= 2048
    tokens = sum(r["length"] for r in rows)
    assert len(sequences) * 2048 - tokens < 0.1 * tokens + 5 * 2048


def test_packing_of_an_empty_table_and_other_columns(spark):
    schema = "doc_id long, text string, id string, start string, length int, g int"
    assert packing.packing(spark.createDataFrame([], schema), JSON, RANKS).count() == 0
    got = packing.packing(spark.createDataFrame([(1, "a b", "x", "y", 1, 2)], schema), JSON, RANKS).collect()
    assert [(r["doc_id"], r["start"], r["doc_tokens"]) for r in got] == [(1, 0, 3)]


def test_differencing_raises_the_number_of_windows():
    import numpy as np

    window = packing.windows_of(np.array([7, 7, 7]), 10)
    assert sorted(window) == [0, 1, 2]
    assert packing.windows_of(np.array([8, 7, 6, 5, 4]), 30).max() == 0


def test_exact_dedup(spark):
    rows = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, "a "), (6, "a ")]
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 5, 2, False), (5, 5, 2, True), (6, 6, 2, True), (6, 6, 2, True)]
    clashing = spark.createDataFrame([(*r, "d", "b", 1, 2) for r in rows], "doc_id long, text string, digest string, body string, n int, id int")
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(clashing).collect()) == got
    assert exact_dedup.exact_dedup(clashing.limit(0)).count() == 0
    kept = exact_dedup.keep_rows(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5, 6, 6]


def test_exact_dedup_deals_hot_texts_to_cells(spark):
    rows = spark.range(0, 4000, 1, 6).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 8 == 1, "warm").otherwise(F.col("id").cast("string")).alias("text"))
    rows = rows.unionByName(spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.lit("hot").alias("text")))
    got = exact_dedup.exact_dedup(rows)
    assert got.count() == 4500
    by_text = {(r["keep_id"], r["group_size"]): r["count"] for r in got.groupBy("keep_id", "group_size").count().collect()}
    assert by_text[3998, 2500] == 2500 and by_text[3993, 500] == 500 and sum(n == 1 for _, n in by_text) == 1500
    assert got.filter("kept").count() == 1502
    sizes = exact_dedup.cells(spark.createDataFrame([(b"a", 600), (b"b", 250), (b"c", 1)], "digest binary, group_size long"), 8)
    assert [r["cells"] for r in sizes.orderBy("digest").collect()] == [6, 3, 1]
    ids = rows.filter("text = 'hot'").select(F.col("doc_id").alias("id"), F.lit(b"h").alias("digest"))
    dealt = exact_dedup.met(ids, spark.createDataFrame([(b"h", 1, 2500)], "digest binary, keep_id long, group_size long"), 16)
    assert dealt.count() == 2500 and set(dealt.columns) == {"id", "digest", "keep_id", "group_size"}


def test_secrets_and_ledger(spark):
    text = "😀 api_key = 'abcdef123' token: x secret=token: abcdefgh AKIA" + "Z" * 20 + " " + "0a" * 12 + " " + "f" * 23
    docs = spark.createDataFrame([(1, text), (2, text), (3, None), (4, "password=123456")], "doc_id long, text string")
    ledger = secret_scan.SecretLedger(spark)
    ledger.update(docs.filter("doc_id < 4"))
    ledger.update(docs)
    assert ledger.rows().count() == 3  # a blob is scanned once
    got = {r["doc_id"]: r for r in secret_scan.digest(ledger.findings(docs)).collect()}
    key, access, run = text.index("api_key"), text.index("AKIA"), text.index("0a0a")
    assert got[1]["spans"] == f"assign:{key}:{key + 20},access:{access}:{access + 24},hex:{run}:{run + 24}"
    assert got[1]["base_sha256"] == hashlib.sha256(got[1]["spans"].encode()).hexdigest()
    assert got[2]["spans"] == got[1]["spans"] and got[3]["spans"] == "" and got[4]["n_assign"] == 1
    ledger.rows().write.mode("append").parquet(ledger.path + "-copy")
    twice = secret_scan.SecretLedger(spark, ledger.path + "-copy")
    for _ in range(2):  # as if two updates had scanned at once
        ledger.rows().write.mode("append").parquet(twice.path)
    clashing = docs.selectExpr("*", "'a' as spans", "'b' as _blob", "'c' as blob", "'d' as version")
    found = twice.findings(clashing)
    assert found.count() == 4 and set(found.columns) == {*docs.columns, "spans", "_blob", "blob", "version"}
    assert ledger.findings(docs.limit(0)).count() == 0
    newer = secret_scan.SecretLedger(spark, ledger.path, version="base-2")
    newer.update(docs.filter("doc_id = 1"))
    assert newer.rows().count() == 4


def test_merged_transforms_are_what_sorting_gives():
    import numpy as np

    rng = np.random.default_rng(4)
    first, after = rng.integers(0, 9, 500).astype(np.uint64), rng.integers(0, 9, 500).astype(np.uint64)
    edge = [0, 100, 101, 350, 500]
    parts = [suffix_dedup.Transform.of(first[a:b], after[a:b], np.arange(a, b)) for a, b in zip(edge, edge[1:])]  # noqa: B905
    merged, direct = suffix_dedup.merge_all(parts), suffix_dedup.Transform.of(first, after, np.arange(500))
    for name in ("symbols", "first", "after", "entry"):
        assert (getattr(merged, name) == getattr(direct, name)).all()
    assert (merged.common()[1:] == (first[merged.entry][1:] == first[merged.entry][:-1]) * (1 + (after[merged.entry][1:] == after[merged.entry][:-1]))).all()


def test_windows_with_one_hash_are_told_apart(monkeypatch):
    import numpy as np

    monkeypatch.setattr(suffix_dedup.textkit.Hasher, "all_of", lambda self, size: np.zeros(len(self.prefix) - size, np.uint64))
    bodies = [b"0123456789abcdefgh", b"x0123456789abcdefg", b"y" * 20]
    own = suffix_dedup.Windows(bodies, 16)
    interval = own.intervals(2)
    raw = b"".join(bodies)
    text = [raw[k : k + 16] for k in own.at.tolist()]
    assert all((interval[i] == interval[j]) == (text[i] == text[j]) for i in range(len(text)) for j in range(len(text)))


def test_repeats_against_brute_force(spark):
    rng = random.Random(5)
    passages = ["".join(rng.choices("abé d", k=n)) for n in (40, 55, 120)]
    rows = []
    for i in range(60):
        t = "".join(rng.choices("xyzw", k=rng.randint(0, 60)))
        for _ in range(rng.randint(0, 3)):
            t += rng.choice(passages) + "".join(rng.choices("qrst", k=rng.randint(0, 9)))
        rows.append((i, t))
    rows += [(100, None), (101, ""), (102, "z" * 100), (5, rows[5][1])]
    counts = collections.Counter(r[k : k + 40] for _, t in rows for r in [(t or "").encode()] for k in range(len(r) - 39))
    want = collections.defaultdict(list)
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 39):
            if counts[raw[k : k + 40]] > 1:
                gone[k : k + 40] = b"\1" * 40
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        want[i].append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for slice_rows in (2, 1000):
        got = collections.defaultdict(list)
        for r in suffix_dedup.repeats(df, window=40, slice_rows=slice_rows).collect():
            got[r["doc_id"]].append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
        assert got == want


def test_stretches_leave_a_batch_by_parts(monkeypatch):
    """What a task holds doesn't grow with its batch; every place is in one row, with all copies of its text."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa
    import zstandard

    monkeypatch.setattr(suffix_dedup, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    run = suffix_dedup.stretches(SimpleNamespace(mapInArrow=lambda f, schema: f), 400)
    rng = random.Random(2)
    texts = [rng.randbytes(8000) for _ in range(2600)]
    texts[7] = texts[2500] = texts[5]
    found = [[{"low": k * 500, "high": k * 500 + 100, "anchor": k % 3} for k in range(15)]] * len(texts)
    docs = [b"%d" % k for k in range(len(texts))]
    copies = [1 + k % 4 for k in range(len(texts))]
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32()), ("anchor", pa.int64())])))
    columns = (docs, [zstandard.compress(x) for x in texts], copies, found)
    batch = pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], ["doc", "raw", "copies", "found"])
    places, ids, largest = [], [], 0
    tracemalloc.start()
    for out in run(iter([batch])):
        largest = max(largest, tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        for r in out.to_pylist():
            assert r["number"] == sum(copies[int(d)] for d in r["docs"])
            body = zstandard.decompress(r["body"])
            assert all(texts[int(d)][low : low + 500] == body and low // 500 % 3 == r["anchor"] for d, low in zip(r["docs"], r["lows"], strict=True))
            places += zip(r["docs"], r["lows"], strict=True)
            ids.append(r["stretch"])
        tracemalloc.start()
    tracemalloc.stop()
    assert sorted(places) == sorted((d, 500 * k) for d in docs for k in range(15))
    assert len(set(ids)) == len(ids) and min(ids) == 3 << 40
    assert 15 * (len(texts) - 2) <= len(ids) <= 15 * len(texts)
    assert largest < 20_000_000, largest


def test_texts_beyond_a_slice(spark):
    """A text of more bytes than a task takes at a time is a slice of its own."""
    from maskwell.llm import minhash, textkit

    rng = random.Random(11)
    text = " ".join("".join(rng.choices("abcdefghé", k=rng.randint(2, 9))) for _ in range(520_000))
    assert len(text.encode()) > textkit.SLICE_BYTES
    passage = "".join(rng.choices("mnopqr ", k=1000))
    other = text[:1_000_000].replace("a", "b") + passage
    docs = spark.createDataFrame([(1, text + passage), (2, other), (3, text[:-30] + " new words"), (4, "short")], "doc_id long, text string")
    sp, library = sentencepiece.SentencePieceProcessor(model_file=MODEL), Tokenizer.from_file(JSON)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, MODEL).collect()} == {i: len(sp.encode(t)) for i, t in rows.items()}
    assert {r["doc_id"]: r["doc_tokens"] for r in packing.packing(docs, JSON, RANKS).collect()} == {i: 1 + len(library.encode(t).ids) for i, t in rows.items()}
    removed = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.repeats(docs).collect()}
    assert removed[2] == 1000 and removed[4] == 0 and removed[1] == len(text[:-30].encode()) + 1000 and removed[3] == len(text[:-30].encode())
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_dedup(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}
    encoded = [r for r in sp_codec.encode(docs.filter("doc_id = 2"), MODEL).orderBy("chunk").collect()]
    assert [x for r in encoded for x in r["ids"]] == sp.encode(other)


def secrets_by_hand(text):
    found = []
    for m in re.finditer(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE):
        if len(m.group(1)) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(found)


def blanked_by_hand(text, spans):
    at, out = 0, []
    for start, _, stop, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, stop)
    return "".join(out) + text[at:]


def test_secrets_of_a_text_with_many_hits(spark):
    parts = lambda i: f"é token={i:08x}z secret: {i} AKIA{'Q' * (i % 30)} 😀{i:030x} password={'0a' * (i % 20)}"
    text = " ".join(map(parts, range(4000)))
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "token=abc"), (5, "token=abcdef")], "doc_id long, text string")
    body = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", body.alias("text"), secret_scan.scan(body).alias("spans")).withColumn("blanked", secret_scan.redact(F.col("text"), F.col("spans"))).collect()
    for r in rows:
        spans = [tuple(s) for s in r["spans"]]
        assert spans == secrets_by_hand(r["text"])
        assert r["blanked"] == blanked_by_hand(r["text"], spans)
    assert max(len(r["spans"]) for r in rows) >= 10_000


def test_findings_of_a_hot_text(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("token=abcdef")).otherwise(F.concat(F.lit("x"), "id")).alias("text"), F.lit(1).alias("spans"))
    ledger = secret_scan.SecretLedger(spark)
    ledger.update(docs)
    got = ledger.findings(docs).select("doc_id", F.size("spans").alias("n")).collect()
    assert sorted(map(tuple, got)) == [(i, int(i % 3 == 0)) for i in range(3000)]
    assert ledger.findings(docs, out="found").columns == ["doc_id", "text", "spans", "found"]
