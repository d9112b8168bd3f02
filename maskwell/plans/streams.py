"""Registered queries that run as finite streams (available-now) over the given tables, into stores of the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from maskwell.plans import sql
from maskwell.plans.catalogue import DOCS, FOUR, query, table
from maskwell.streaming import redaction
from maskwell.streaming.sessions import SessionDictionary, session_sink
from maskwell.streaming.store import BucketedStore, shared_folder

# what the writer of an event says, from the event's keys
_SAID = "concat('from user', user_id, '@example.com at 10.1.', event_id % 200, '.', user_id % 250, ' to user', (user_id * 7 + event_id) % 90, '@example.com')"
_SPANS = sql.resolved(sql.scan(f"SELECT event_id AS doc_id, {_SAID} AS text FROM events", FOUR))


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # a pattern, as the source takes a plain path for a folder
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def drained(rows: DataFrame, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """All that is there goes through the sink, in micro-batches; returns when it is in."""
    begun = rows.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", shared_folder(rows.sparkSession, "stream"))
    begun.trigger(availableNow=True).start().awaitTermination()


# T1
@query(sql.redacted(DOCS, sql.numbered(sql.resolved(sql.scan(DOCS, FOUR)))))
def redact_stream_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stream_of(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = shared_folder(spark, "redacted")
    rows = redaction.redact_stream(docs, FOUR).select("doc_id", F.size("spans").cast("long").alias("n_spans"), "redacted")
    drained(rows, lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"))
    return spark.read.parquet(out).select("doc_id", "n_spans", "redacted")


# An event's user is the session
@query(f"""
WITH k AS (SELECT x.*, user_id FROM ({_SPANS}) x JOIN events ON doc_id = event_id),
n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY min((doc_id, -s))) AS n FROM k GROUP BY user_id, value)
SELECT doc_id AS event_id, redacted FROM ({sql.redacted(f"SELECT event_id AS doc_id, {_SAID} AS text FROM events", "SELECT k.*, n FROM k JOIN n USING (user_id, value)")})""")  # fmt: skip
def session_stream_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = stream_of(spark, sf_dir, "events").select("user_id", "event_id", F.expr(_SAID).alias("text"))
    out = shared_folder(spark, "sessions")
    drained(said, session_sink(SessionDictionary(spark, f"{out}/numbers"), f"{out}/messages", FOUR, "user_id", "event_id"))
    return spark.read.parquet(f"{out}/messages/rows").select("event_id", "redacted")


# T3
@query("SELECT user_id, arg_max(event_id, ts) AS event_id, max(ts) AS ts FROM events GROUP BY user_id")
def latest_version_by_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream_of(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    store = BucketedStore(spark, shared_folder(spark, "latest"), rows.schema, ["user_id"], ["ts", "event_id"])
    drained(rows, store.merge)
    return store.read()


# T4: counts only grow, so the largest is a window's latest
@query(f"SELECT date_trunc('hour', ts) AS window_start, type, count(*) AS n FROM ({_SPANS}) JOIN events ON doc_id = event_id GROUP BY ALL")
def span_counts_by_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = stream_of(spark, sf_dir, "events").select(F.col("ts").cast("timestamp"), F.expr(_SAID).alias("text"))
    schema = StructType().add("window_start", "timestamp").add("type", "string").add("n", "long")
    store = BucketedStore(spark, shared_folder(spark, "counts"), schema, ["window_start", "type"], ["n"])
    drained(redaction.counts_by_window(said, FOUR), store.merge, "update")
    return store.read().withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
