"""Sessions that outlive a job: each value of a session keeps its number, whatever batch it comes in.

``SessionDictionary`` holds (session, original, ord) in a BucketedStore, and in the same store one counter row a session (with
a null original), so that numbers and counters are committed together. New values of a batch are numbered by first appearance,
range by range: a session that holds a third of all values is spread over ranges, whose sizes are summed up per session. What is
read and written is the buckets of the batch's values.

Defined results: null sessions are one session; null values have no number; repeated rows count once; ties of first appearance go
by the value; an empty batch changes nothing but the batch number.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from maskwell.functions import spans as S
from maskwell.operators import corpus
from maskwell.rules.base import Rule
from maskwell.streaming.store import BucketedStore

ENTRY = StructType().add("session", "string").add("original", "string").add("ord", "long")


def session_name(*key: str) -> Column:
    """A session's key as text that is never null."""
    return F.to_json(F.struct(*key))


class SessionDictionary:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path
        self.store = BucketedStore(spark, path, ENTRY, ["session", "original"], ["ord"], buckets)

    def read(self) -> DataFrame:
        """session, original, ord."""
        return self.store.read().filter("original is not null")

    def add(self, values: DataFrame, number: int) -> None:
        """values: session, original, first (a struct that tells the order of appearance). Values without a number get one."""
        if number <= self.store.number():
            return
        firsts = values.filter("original is not null").groupBy("session", "original").agg(F.min("first").alias("first"))
        stage = f"{self.path}/stage/{number}-{uuid.uuid4().hex}"
        firsts.write.parquet(f"{stage}/firsts")
        firsts = self.spark.read.parquet(f"{stage}/firsts")
        asked = firsts.select("session", "original").unionByName(firsts.select("session", F.lit(None).cast("string").alias("original")).distinct())
        known = self.store.near(asked)
        new = firsts.join(known.filter("original is not null"), ["session", "original"], "left_anti")
        # written, as what the ranges were must not be found anew: numbers of two samplings could clash
        new.repartitionByRange("session", "first", "original").withColumn("part", F.spark_partition_id()).write.parquet(f"{stage}/ranged")
        ranged = self.spark.read.parquet(f"{stage}/ranged")
        ranked = ranged.withColumn("k", F.row_number().over(Window.partitionBy("session", "part").orderBy("first", "original")))
        # a row for each range that a session reaches into
        earlier = Window.partitionBy("session").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sizes = ranged.groupBy("session", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        counters = known.filter("original is null").select("session", F.col("ord").alias("base"))
        offsets = sizes.join(counters, "session", "left").select("session", "part", (F.coalesce("base", F.lit(0)) + F.col("before")).alias("offset"), "n")
        fresh = ranked.join(offsets.drop("n"), ["session", "part"]).select("session", "original", (F.col("offset") + F.col("k")).cast("long").alias("ord"))
        ends = offsets.groupBy("session").agg(F.max(F.col("offset") + F.col("n")).cast("long").alias("ord")).select("session", F.lit(None).cast("string").alias("original"), "ord")
        self.store.merge(fresh.unionByName(ends), number)
        at = self.spark._jvm.org.apache.hadoop.fs.Path(stage)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def numbered(self, values: DataFrame) -> DataFrame:
        """values with ``ord``, read from the buckets that the values are in."""
        return values.join(self.store.near(values), ["session", "original"], "left")


def session_sink(dictionary: SessionDictionary, out: str, rules: tuple[Rule, ...], key: str = "conv_id", order: str = "turn", text: str = "text") -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: writes key, order, redacted to ``out/batch=<number>``, with placeholders that hold over the session.

    Values are numbered by order of their messages, and in a message from the last span back. A replayed batch writes the same
    rows to the same place. Texts are not shuffled with spans: each message meets the entries of its own values.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, stage = batch.sparkSession, f"{out}/stage/{number}"
        named = batch.select(key, order, text).withColumns({"_session": session_name(key), "_message": session_name(key, order)})
        corpus.detected(named, rules, text).write.mode("overwrite").parquet(stage)
        found = spark.read.parquet(stage)
        rows = corpus.each(found, F.col("spans"), "s", "_session", "_message", order)
        spans = rows.select(F.col("_session").alias("session"), "_message", F.col("s.value").alias("original"), F.struct(order, (-F.col("s.start")).alias("back")).alias("first"))
        dictionary.add(spans.select("session", "original", "first"), number)
        label = F.concat(F.lit("<<REDACTED_"), F.col("ord").cast("string"), F.lit(">>"))
        placed = dictionary.numbered(spans.select("session", "_message", "original").distinct())
        entries = placed.groupBy("_message").agg(F.collect_list(F.struct("original", label.alias("placeholder"))).alias("_entries"))
        filled = F.when(F.col("_entries").isNull(), F.col(text)).otherwise(S.redact(F.col(text), F.col("spans"), F.col("_entries")))
        done = found.join(entries, "_message", "left").select(key, order, filled.alias("redacted"))
        done.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        at = spark._jvm.org.apache.hadoop.fs.Path(stage)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    return write
