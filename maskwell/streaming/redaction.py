"""Redaction of message streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from maskwell.functions import spans as S
from maskwell.operators import corpus
from maskwell.rules.base import Rule


def redact_stream(messages: DataFrame, rules: tuple[Rule, ...], text: str = "text", mode: str = "labelled") -> DataFrame:
    """Each message by itself, without state or shuffle: the batch functions on a stream."""
    return corpus.redacted(corpus.detected(messages, rules, text), text, mode)


def session_stream(messages: DataFrame, rules: tuple[Rule, ...], key: str = "conv_id", order: str = "turn", text: str = "text", idle: str | None = None) -> DataFrame:
    """Stable placeholders over a conversation: key, order, redacted. The state is a value's number, per conversation.

    Values of a message are numbered from its last span back. With ``idle`` (such as "30 minutes") a conversation that
    is quiet for so long is forgotten, and begins anew from 1.
    """
    ready = corpus.detected(messages, rules, text).select(key, order, text, "spans")
    schema = messages.select(key, order).schema
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", redacted string"

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        numbers = dict(zip(*state.get, strict=True)) if state.exists else {}
        pdf = pd.concat(batches).sort_values(order)
        done = []
        for body, spans in zip(pdf[text], pdf["spans"], strict=True):
            for s in sorted(spans, key=lambda s: -s["start"]):
                label = f"<<REDACTED_{numbers.setdefault(s['value'], len(numbers) + 1)}>>"
                body = body[: s["start"]] + label + body[s["end"] :]
            done.append(body)
        state.update((list(numbers), list(numbers.values())))
        if idle:
            state.setTimeoutDuration(pd.Timedelta(idle) // pd.Timedelta("1ms"))
        yield pdf[[key, order]].assign(redacted=done)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return ready.groupBy(key).applyInPandasWithState(run, out, "vals array<string>, nums array<int>", "append", timeout)


def latest_wins(store: str, key: list[str], version: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: the store keeps, of every key, the row with the highest version, in numbered snapshots."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch if number == 0 else batch.unionByName(spark.read.schema(batch.schema).parquet(f"{store}/{number - 1}"))
        corpus.latest(rows, key, version).write.mode("overwrite").parquet(f"{store}/{number}")

    return merge


def counts_by_window(messages: DataFrame, rules: tuple[Rule, ...], time: str = "ts", text: str = "text", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Spans per time window and type; rows later than the watermark are dropped."""
    found = messages.withWatermark(time, late).withColumn("spans", S.resolve(S.scan(F.col(text), rules)))
    rows = corpus.each(found, F.col("spans"), "s", time)
    return rows.groupBy(F.window(time, width).alias("w"), F.col("s.type").alias("type")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "type", "n")
