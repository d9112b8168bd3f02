import zipfile

from pyspark.sql import functions as F

from maskwell.operators import corpus
from maskwell.rules import catalogue
from maskwell.sources import text as sources
from maskwell.sources.word_files import read_word_files
from maskwell.streaming import redaction

EMAIL = catalogue.named("universal:email")


def word_file(path, body, header=None):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        if header:
            z.writestr("word/header1.xml", header)


def test_word_files(spark, tmp_path):
    word_file(tmp_path / "a.docx", "<w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>you</w:t></w:r></w:p><w:p><w:r><w:t>Bye</w:t></w:r></w:p>", header="<broken")
    (tmp_path / "b.docx").write_bytes(b"not a zip")
    (tmp_path / "c.txt").write_text("other")
    rows, rejects = read_word_files(spark, str(tmp_path))
    assert sorted((r["paragraph"], r["seq"], r["text"]) for r in rows.collect()) == [(0, 0, "Hello "), (0, 1, "you"), (1, 0, "Bye")]
    assert [r["path"].rsplit("/", 1)[1] for r in rejects.collect()] == ["b.docx"]


def test_sinks_keep_texts_and_dictionaries_apart(spark, tmp_path):
    docs = spark.createDataFrame([(1, "mail a@b.co")], "doc_id long, text string")
    sources.write_redacted(corpus.redacted(corpus.detected(docs, EMAIL)), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/redacted")).first()["redacted"] == "mail <<REDACTED_1>>"
    assert spark.read.parquet(str(tmp_path / "out/dictionary")).first()["dictionary"][0]["original"] == "a@b.co"


def stream_of(spark, tmp_path, rows, schema, name):
    spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / name))
    return spark.readStream.schema(schema).parquet(str(tmp_path / name))


def drain(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_redact_stream_equals_batch(spark, tmp_path):
    rows = [(1, "a@b.co and c@d.eu"), (2, "nothing")]
    got = drain(spark, redaction.redact_stream(stream_of(spark, tmp_path, rows, "doc_id long, text string", "m"), EMAIL).select("doc_id", "redacted"), "t1")
    batch = corpus.redacted(corpus.detected(spark.createDataFrame(rows, "doc_id long, text string"), EMAIL)).select("doc_id", "redacted").collect()
    assert sorted(got) == sorted(batch)


def test_session_stream_keeps_placeholders(spark, tmp_path):
    schema = "conv_id long, turn long, text string"
    path = str(tmp_path / "c")
    spark.createDataFrame([(1, 0, "a@b.co"), (2, 0, "x@y.zz")], schema).write.parquet(path)
    out = redaction.session_stream(spark.readStream.schema(schema).parquet(path), EMAIL)
    q = out.writeStream.format("memory").queryName("t2").start()
    q.processAllAvailable()
    spark.createDataFrame([(1, 1, "c@d.eu then a@b.co")], schema).write.mode("append").parquet(path)
    q.processAllAvailable()
    q.stop()
    got = {(r["conv_id"], r["turn"]): r["redacted"] for r in spark.table("t2").collect()}
    assert got == {(1, 0): "<<REDACTED_1>>", (2, 0): "<<REDACTED_1>>", (1, 1): "<<REDACTED_2>> then <<REDACTED_1>>"}


def test_latest_version_wins(spark, tmp_path):
    merge = redaction.latest_wins(str(tmp_path / "s"), ["k"], ["v"])
    merge(spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, v int, t string"), 0)
    merge(spark.createDataFrame([(1, 2, "c"), (2, 4, "d")], "k int, v int, t string"), 1)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "s/1")).collect()) == [(1, 2, "c"), (2, 5, "b")]


def test_counts_by_window(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:05:00", "a@b.co c@d.eu"), ("2024-01-01 01:05:00", "e@f.gh")], "ts string, text string").select(F.to_timestamp("ts").alias("ts"), "text")
    rows.write.parquet(str(tmp_path / "w"))
    got = drain(spark, redaction.counts_by_window(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "w")), EMAIL), "t4", "complete")
    assert sorted(r["n"] for r in got) == [1, 2]
