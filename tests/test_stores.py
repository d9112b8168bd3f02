import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from maskwell.rules import catalogue
from maskwell.streaming.sessions import SessionDictionary, session_sink
from maskwell.streaming.store import BucketedStore

EMAIL = catalogue.named("universal:email")
SCHEMA = StructType().add("k", "long").add("v", "long").add("t", "string")


def store_at(spark, path, buckets=16):
    return BucketedStore(spark, f"file://{path}", SCHEMA, ["k"], ["v"], buckets)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def data_files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path / "data") for f in fs if f.endswith(".parquet")}


def test_store_keeps_the_latest_and_leaves_other_buckets_alone(spark, tmp_path):
    store = store_at(spark, tmp_path)
    assert store.number() == -1 and rows_of(store.read()) == []
    store.merge(spark.range(400).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("v"), F.lit("old").alias("t")), 0)
    before = data_files(tmp_path)
    assert len(before) == 16
    store.merge(spark.createDataFrame([(7, 2, "new"), (7, 3, "newer"), (9, 0, "late")], SCHEMA), 1)
    got = {r["k"]: (r["v"], r["t"]) for r in store.read().collect()}
    assert len(got) == 400 and got[7] == (3, "newer") and got[9] == (1, "old") and got[11] == (1, "old")
    assert 1 <= len(data_files(tmp_path) - before) <= 2


def test_store_ignores_replays_and_unfinished_merges(spark, tmp_path, monkeypatch):
    store = store_at(spark, tmp_path)
    store.merge(spark.createDataFrame([(1, 1, "a")], SCHEMA), 0)
    store.merge(spark.createDataFrame([(1, 5, "other")], SCHEMA), 0)
    assert rows_of(store.read()) == [(1, 1, "a")]
    lost = lambda *_: (_ for _ in ()).throw(OSError("lost"))
    with monkeypatch.context() as m:
        m.setattr(spark, "createDataFrame", lost)
        with pytest.raises(OSError):
            store.merge(spark.range(1).select(F.lit(1).cast("long").alias("k"), F.lit(2).cast("long").alias("v"), F.lit("b").alias("t")), 1)
    assert store.number() == 0 and rows_of(store.read()) == [(1, 1, "a")]
    store.merge(spark.createDataFrame([(1, 2, "b")], SCHEMA), 1)
    assert rows_of(store.read()) == [(1, 2, "b")]


def test_store_nulls_repeats_empty_batches_and_old_states(spark, tmp_path):
    store = store_at(spark, tmp_path, 4)
    store.merge(spark.createDataFrame([(None, 1, "n"), (None, 2, None), (3, None, "x"), (3, None, "x")], SCHEMA), 0)
    store.merge(spark.createDataFrame([], SCHEMA), 1)
    store.merge(spark.createDataFrame([(3, 0, "y", "extra")], "k long, v long, t string, z string"), 5)
    assert rows_of(store.read()) == sorted([(None, 2, None), (3, 0, "y")], key=repr)
    store.merge(spark.createDataFrame([(4, 0, "z")], SCHEMA), 6)
    assert sorted(os.listdir(tmp_path / "manifest")) == ["5", "6"]
    assert len(rows_of(store.read())) == 3


def values(spark, rows):
    return spark.createDataFrame(rows, "session string, original string, at long").select("session", "original", F.struct("at").alias("first"))


def test_three_batches_give_the_numbers_of_one_run(spark, tmp_path):
    rows = [("s" if i % 3 else "hot", f"v{i * i % 101}", i) for i in range(600)]
    one = SessionDictionary(spark, f"file://{tmp_path}/one", 8)
    one.add(values(spark, rows), 0)
    three = SessionDictionary(spark, f"file://{tmp_path}/three", 8)
    for n in range(3):
        three.add(values(spark, rows[n * 200 : (n + 1) * 200]), n)
        three.add(values(spark, rows[n * 200 : (n + 1) * 200]), n)
    assert rows_of(one.read()) == rows_of(three.read())
    want = {}
    for session, value, _ in rows:
        own = want.setdefault(session, {})
        own.setdefault(value, len(own) + 1)
    assert rows_of(one.read()) == sorted(((s, v, n) for s, own in want.items() for v, n in own.items()), key=repr)


def test_sessions_nulls_and_empty_batches(spark, tmp_path):
    d = SessionDictionary(spark, f"file://{tmp_path}/d", 4)
    d.add(values(spark, []), 0)
    d.add(values(spark, [("a", None, 1), ("a", "x", 2), ("a", "x", 2), ("a", "w", 2)]), 1)
    assert rows_of(d.read()) == [("a", "w", 1), ("a", "x", 2)]


def test_session_sink_over_streams(spark, tmp_path):
    schema = "conv_id long, turn long, text string"
    source, out = str(tmp_path / "in"), f"file://{tmp_path}/out"
    sink = session_sink(SessionDictionary(spark, f"file://{tmp_path}/d", 4), out, EMAIL)

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()

    spark.createDataFrame([(1, 0, "a@b.co"), (2, 0, "x@y.zz"), (None, 0, "n@n.nn"), (2, 1, None), (2, 2, "")], schema).write.parquet(source)
    run()
    spark.createDataFrame([(1, 1, "c@d.eu then a@b.co"), (1, 1, "c@d.eu then a@b.co")], schema).write.mode("append").parquet(source)
    run()
    got = rows_of(spark.read.parquet(f"{out}/rows").select("conv_id", "turn", "redacted"))
    again = (1, 1, "<<REDACTED_2>> then <<REDACTED_1>>")
    one = "<<REDACTED_1>>"
    assert got == sorted([(1, 0, one), (2, 0, one), (None, 0, one), (2, 1, None), (2, 2, ""), again, again], key=repr)
