"""Results where keys, texts or batches are larger than in the test tables."""

import time
from dataclasses import replace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskwell.functions import spans as S
from maskwell.functions import windows
from maskwell.plans import catalogue
from maskwell.rules import catalogue as rules
from maskwell.rules import needs


def pl_regon(v: str) -> bool:
    d = [int(x) for x in v]
    weights, last = ([8, 9, 2, 3, 4, 5, 6, 7], 8) if len(d) == 9 else ([2, 4, 8, 5, 0, 9, 7, 3, 6, 1, 2, 4, 8], 13)
    return sum(a * b for a, b in zip(d, weights, strict=False)) % 11 % 10 == d[last]


def test_identifiers_of_keys_whose_products_exceed_a_long(spark, tmp_path):
    keys = [0, 1, 149_999, 899_999, 900_000, 35_999_999, 36_000_000, 10**12 + 1]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["o_orderkey"]: (r["v"], r["ok"]) for r in catalogue.queries()["check_pl_regon"](spark, str(tmp_path)).collect()}
    want = {k: str((k * 123456787 + 123456787 % 997) % 10**9).zfill(9) if k % 2 == 0 else str((k * 12345678512347 + 12345678512347 % 997) % 10**14).zfill(14) for k in keys}
    assert got == {k: (v, pl_regon(v)) for k, v in want.items()}


@pytest.mark.parametrize("name", ["segment_overlaps", "rewrite_segments"])
def test_conversations_about_the_shortest_that_has_a_span(spark, tmp_path, name):
    rows = [(n, 0, "x" * n) for n in (209, 210, 211, 212, 260, 261, 262)] + [(1000, 0, "y" * 100), (1000, 1, "z" * 110)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    df = catalogue.queries()[name](spark, str(tmp_path))
    rel = con.sql(catalogue.oracle_sql()[name])
    at = [rel.columns.index(c) for c in df.columns]
    assert sorted(tuple(r) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())


def test_words_are_read_once_and_by_the_same_pattern(spark, tmp_path):
    odd = ["", " ", "a", "é ñ 中文字 b", "​﻿x　😀y\tz\r\n", "~!\x7f\x00 \x1f", "w " * 149 + "w", "w " * 151, "w " * 371]
    spark.createDataFrame([(k, x) for k, x in enumerate(odd)] + [(99, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("fixed_chunks", "words_by_space_of_documents"):
        df = catalogue.queries()[name](spark, str(tmp_path))
        rel = con.sql(catalogue.oracle_sql()[name])
        at = [rel.columns.index(c) for c in df.columns]
        assert sorted(tuple(r) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all(") == 1 and "[!-~[^" in plan


def test_windows_leave_the_worker_group_by_group(spark, tmp_path):
    line = "mail a1@example.com or +44 20 7946 0958; "
    batch = pa.array([line * 5000] * 40 + [None, ""])
    parts = [len(x) for x in windows.in_parts(iter([batch]), rules.named("universal:email", "universal:phone_intl"))]
    assert sum(parts) == len(batch) and max(parts) * len(line) * 5000 <= windows.CHARACTERS + len(line) * 5000
    spark.createDataFrame([(k, "Customer") for k in range(3)], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    plan = catalogue.queries()["scan_de"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    # an iterator's function, and letters made within an array's function
    assert "[parts(text" in plan and "transform(array(struct(" in plan


def windows_of(texts, which):
    """Windows by rule, all texts together."""
    plain = tuple(replace(r, check=None) for r in which)
    edges = np.cumsum([0, *[len(x) + 1 for x in texts]])
    rule = needs.gate(plain).windows("".join(x + "\0" for x in texts), edges)[1]
    return {which[k].detector: n for k, n in enumerate(np.bincount(rule, minlength=len(which)).tolist())}


def test_rules_read_few_windows_of_letters():
    con = duckdb.connect()
    con.execute("CREATE VIEW customer AS SELECT k AS c_custkey, 'Customer#' || lpad(k::VARCHAR, 9, '0') AS c_name FROM range(100) t(k)")
    letters = [r[1] for r in con.execute(catalogue.LETTERS).fetchall()]
    for region, most in (("de", 70), ("it", 20), ("se", 60), ("pt", 20)):
        got = windows_of(letters, tuple(r for r in rules.RULES if r.region == region and r.re2))
        assert sum(got.values()) <= most * len(letters), got
    got = windows_of(letters, tuple(r for r in rules.RULES if not r.re2))
    assert sum(got.values()) <= 50 * len(letters), got


def test_letters_that_fold_to_ascii_and_marks_change_no_span(spark):
    # long s, Kelvin sign, dotted and dotless i stand for ASCII letters of rules that fold; the last texts have the mark itself
    odd = ["ſtr. 5, Hauptſtraße 12/3", "xVİA ROMA, 12", "in the ſum of ten doLLarſ", "1 Parſ  Sıde Roaſ Rd", "K2 1AB, ſW1A 2AA", "12ſs May 2024, ſept 3, 2001", "GB29 NWBK 6016 1331 9268 19"]
    odd += [f"{S.MARK}a@b.example.com{S.MARK}, 12.03.2001{S.MARK} 10.0.0.1 10.0.0.2 via Roma 5"] + [f"a@b.example.com {x} 10.0.0.1" for x in (S.MARK, "$0", "\\1")]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(odd)], "k int, text string")
    which = tuple(r for r in rules.RULES if r.detector.endswith(("street", "email", "ipv4", "date_numeric", "postcode", "date_month_first", "iban", "us:currency_words")))
    of = lambda gated: {r["k"]: [tuple(s) for s in r["s"]] for r in docs.select("k", S.scan(F.col("text"), which, gated).alias("s")).collect()}
    got = of(True)
    assert got == of(False) and sum(map(len, got.values())) > 10


def test_windows_begin_where_a_match_may_begin():
    text = "long prose before it, " * 200 + "at Rua Augusta Nova 5"
    which = rules.named("pt:street")
    doc, rule, begin, end = needs.gate(which).windows(text + "\0", np.array([0, len(text) + 1]))
    assert len(begin) == 1 and text[begin[0] : end[0]] == " Rua Augusta Nova 5"


def test_redaction_of_many_spans_reads_a_text_in_blocks(spark):
    n = 30_000
    docs = spark.createDataFrame([(0, "é ab " * 10 * n), (1, "ab"), (2, "x ab ab y")], "k int, text string")
    one = lambda at: F.struct(at.cast("int").alias("start"), (at + 2).cast("int").alias("end"), F.lit("OTHER").alias("type"), F.lit("ab").alias("value"), F.lit(0.9).cast("double").alias("confidence"), F.lit("d").alias("detector"), F.lit(0).cast("int").alias("ord"))
    spans = F.when(F.col("k") == 0, F.transform(F.reverse(F.sequence(F.lit(0), F.lit(n - 1))), lambda i: one(i * 50 + 2))).when(F.col("k") == 1, F.array(one(F.lit(0)))).otherwise(F.array(one(F.lit(2)), one(F.lit(5))))
    entries = F.array(F.struct(F.lit(1).cast("int").alias("ord"), F.lit("ab").alias("original"), F.lit("<<1>>").alias("placeholder"), F.lit("OTHER").alias("entity_type")))
    begin = time.time()
    got = {r["k"]: r["r"] for r in docs.select("k", S.redact(F.col("text"), spans, entries).alias("r")).collect()}
    assert got == {0: ("é <<1>> " + "é ab " * 9) * n, 1: "<<1>>", 2: "x <<1>> <<1>> y"} and time.time() - begin < 12


@pytest.mark.parametrize(("name", "table", "rows"), [("scan_pages_by_catalogue", "pages", "page_id long, url string, html string"), ("redact_by_catalogue", "documents", "doc_id long, url string, text string")])
def test_scans_by_the_whole_catalogue_are_dealt_out_by_bytes(spark, tmp_path, monkeypatch, name, table, rows):
    # as many files as there are cores, which were one task each
    spark.createDataFrame([(k, "", f"mail a{k}@example.com") for k in range(64)], rows).repartition(8).write.parquet(f"{tmp_path}/{table}.parquet")
    size = sum(x.stat().st_size for x in (tmp_path / f"{table}.parquet").glob("*.parquet"))
    monkeypatch.setattr(catalogue, "SHARE", 500, raising=False)
    df = catalogue.queries()[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert f"Repartition {-(-size // 500)}, true" in plan
