"""What the corpus operators share: the cluster's shared folder, stored tables, partition counts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a session on this machine alone gets one of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='maskwell-')}"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


_stored: list[str] = []


def stored(df: DataFrame, name: str, together: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and lost executors lose nothing.

    together: how many rows a row group holds at most, for rows of megabytes. Spark decodes all rows of a row group (up to
    4,096) at once, and Parquet's writer holds a hundred rows before it looks at their size.
    """
    path = f"{shared_dir(df.sparkSession)}/maskwell/{name}-{uuid.uuid4().hex}"
    few = {f"parquet.{k}": together for k in ("block.row.count.limit", "block.size.row.check.min", "page.size.row.check.min")} if together else {}
    df.write.options(**few).parquet(path)
    _stored.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_stored(spark: SparkSession) -> None:
    """Delete the tables that this driver has stored; for when their results have been written or are not wanted."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    while _stored:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_stored.pop())
        at.getFileSystem(hadoop).delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def looked_up(rows: DataFrame, on: str, table: DataFrame, total: int, how: str = "inner", also: tuple[str, ...] = ()) -> DataFrame:
    """Rows joined to a table with one row a key at most; keys are not null. Keys that hold more than a thousandth of
    the ``total`` rows, so fewer than a thousand keys, meet a broadcast copy of their rows of the table and aren't shuffled.
    ``also``: further columns that have to be equal, where ``on`` is but a hash of them."""
    counts = rows.groupBy(on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > total / 1000)
    hot = [r[0] for r in counts.select(on).collect()]
    if not hot:
        return rows.join(table, [on, *also], how)
    few = F.col(on).isin(hot)
    return rows.filter(few).join(F.broadcast(table.filter(few)), [on, *also], how).unionByName(rows.filter(~few).join(table.filter(~few), [on, *also], how))


def whole_text(text: str = "text") -> Column:
    """The text column as an operator sees it: null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
