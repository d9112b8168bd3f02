import os

import pytest
from pyspark.sql import functions as F

from maskwell.operators import corpus
from maskwell.operators.views import attach
from maskwell.rules import catalogue
from maskwell.sources import redacted

EMAIL = catalogue.named("universal:email", "universal:ipv4")
DOCS = [(1, "a@b.co at 10.1.2.3, a@b.co"), (2, None), (3, "  "), (4, "nothing"), (5, "c@d.eu")]


def docs_of(spark, rows=DOCS):
    # other columns with the names of the views' own
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit("x"), "start": F.lit(1), "dictionary": F.lit("y")}).repartition(3)


def redact(spark, rows=DOCS):
    return corpus.redacted(corpus.detected(docs_of(spark, rows).select("doc_id", "text"), EMAIL))


def test_views_say_what_the_operators_give(spark):
    assert attach(spark, docs_of(spark), "t", EMAIL) == ["t_spans", "t_redacted", "t_dictionary"]
    spans = spark.sql('SELECT doc_id, idx, start, `end`, value, region FROM t_spans ORDER BY doc_id, idx').collect()
    assert [tuple(r) for r in spans] == [
        (1, 0, 0, 6, "a@b.co", "universal"), (1, 1, 10, 18, "10.1.2.3", "universal"), (1, 2, 20, 26, "a@b.co", "universal"), (5, 0, 0, 6, "c@d.eu", "universal"),
    ]
    assert spark.sql("SELECT count(*) AS n FROM t_redacted").first()["n"] == 5
    joined = spark.sql("SELECT d.original, count(*) AS n FROM t_dictionary d JOIN t_spans s ON d.doc_id = s.doc_id AND d.original = s.value GROUP BY ALL ORDER BY 1").collect()
    assert [tuple(r) for r in joined] == [("10.1.2.3", 1), ("a@b.co", 2), ("c@d.eu", 1)]
    attach(spark, docs_of(spark, [(0, "")]).limit(0), "t", EMAIL)
    assert [spark.table(v).count() for v in ("t_spans", "t_redacted", "t_dictionary")] == [0, 0, 0]


def test_two_tables_are_written_at_once(spark, tmp_path):
    path = str(tmp_path / "out")
    out = redact(spark)
    redacted.save(out, path)
    expected = {r["doc_id"]: (r["redacted"], r["dictionary"]) for r in out.collect()}
    texts = {r["doc_id"]: r["redacted"] for r in redacted.read(spark, path, "redacted").collect()}
    entries = {r["doc_id"]: r["dictionary"] for r in redacted.read(spark, f"file://{path}", "dictionary").collect()}
    assert {k: (texts[k], entries[k]) for k in texts} == expected and set(entries) == set(texts)
    redacted.save(redact(spark, [(9, "e@f.gh")]), path)
    assert redacted.read(spark, path, "redacted").count() == 6
    redacted.save(redact(spark, [(7, "e@f.gh")]), path, mode="overwrite")
    assert [r["doc_id"] for r in redacted.read(spark, path, "dictionary").collect()] == [7]
    redacted.vacuum(path)
    assert [r["redacted"] for r in redacted.read(spark, path, "redacted").collect()] == ["<<REDACTED_1>>"]
    assert sum(len(f) for _, _, f in os.walk(path) if f) == 3


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "out")
    broken = redact(spark).withColumn("redacted", F.when(F.col("doc_id") == 5, F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("redacted")))
    with pytest.raises(Exception, match="broken"):
        redacted.save(broken, path)
    with pytest.raises(FileNotFoundError):
        redacted.read(spark, path, "redacted")
    redacted.save(redact(spark), path)
    with pytest.raises(Exception, match="broken"):
        redacted.save(broken, path, mode="overwrite")
    assert redacted.read(spark, path, "redacted").count() == 5


def test_empty_tables_keep_their_columns(spark, tmp_path):
    path = str(tmp_path / "out")
    redacted.save(redact(spark).limit(0), path)
    assert redacted.read(spark, path, "dictionary").columns == ["doc_id", "dictionary"]
    assert redacted.read(spark, path, "redacted").count() == 0
