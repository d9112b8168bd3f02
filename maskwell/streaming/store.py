"""Keyed tables in the shared folder that batches and streams are merged into.

``BucketedStore`` keeps, of every key, the row with the highest version. Rows are dealt to buckets by a hash of the key, and
a merge rewrites the buckets that the batch touches, each in one task; the others stay where they are. A manifest, a small
table of one row a bucket, names the folders that make up the store after a merge, and is written last: a merge that fails
leaves the store as it was, and readers of the state before are not disturbed. Merges go by a batch number that grows; a
number that is in already changes nothing, so a replayed micro-batch is harmless. One writer at a time.

Defined results: null keys are keys like others; a null version loses; of equal versions the row with the larger other columns
stays; repeated rows count once; an empty batch is merged like others and touches no bucket; columns beyond the schema are left
out; long texts are values like others.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from maskwell.operators import corpus

BUCKET = "_bucket"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that spark.checkpoint.dir names; a session on this machine alone may leave that unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='maskwell-')}"
        spark.sparkContext.setCheckpointDir(at)
    return f"{at.rstrip('/')}/maskwell/{name}-{uuid.uuid4().hex}"


class BucketedStore:
    """buckets: fixed for the life of a store; choose it so that a task can sort a bucket."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: Sequence[str], version: Sequence[str], buckets: int = 64, keep: int = 2):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.key, self.version, self.buckets, self.keep = list(key), list(version), buckets, keep

    def number(self) -> int:
        """The number of the last batch that is in, -1 before the first."""
        return max(self._committed(), default=-1)

    def read(self) -> DataFrame:
        """The store as it stands."""
        return self._rows(self._folders(self.number()).values())

    def near(self, keys: DataFrame) -> DataFrame:
        """The rows of all buckets that hold any of the keys; a superset of the keys' own rows."""
        found = self._folders(self.number())
        return self._rows(found[b] for b in self._touched(keys.select(self._bucket().alias(BUCKET))) if b in found)

    def merge(self, batch: DataFrame, number: int) -> None:
        """Merge a batch; the signature is that of a foreachBatch function."""
        last = self.number()
        if number <= last:
            return
        before, folder = self._folders(last), f"{self.path}/data/{number}-{uuid.uuid4().hex}"
        own = corpus.latest(batch.select(self.schema.names), self.key, self.version)
        # the batch is computed once, combined by key
        own.write.parquet(f"{folder}/batch")
        staged = self.spark.read.schema(self.schema).parquet(f"{folder}/batch").withColumn(BUCKET, self._bucket())
        touched = self._touched(staged)
        if touched:
            old = self._rows(before[b] for b in touched if b in before).withColumn(BUCKET, self._bucket())
            # one shuffle: rows that are dealt by bucket are dealt by bucket and key
            dealt = staged.unionByName(old).repartition(min(len(touched), self.buckets), BUCKET)
            corpus.latest(dealt, [BUCKET, *self.key], self.version).write.partitionBy(BUCKET).parquet(f"{folder}/rows")
        after = before | {b: f"{folder}/rows/{BUCKET}={b}" for b in touched}
        manifest = self.spark.createDataFrame(sorted(after.items()), "bucket int, folder string")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{number}")
        self._clear(f"{folder}/batch")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> list[int]:
        # as many numbers as there are buckets at most
        return sorted(r[0] for r in rows.select(BUCKET).distinct().collect())

    def _rows(self, folders) -> DataFrame:
        paths = list(folders)
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _folders(self, number: int) -> dict[int, str]:
        """Bucket and folder, a row each, as of a batch."""
        return {} if number < 0 else dict(map(tuple, self.spark.read.parquet(f"{self.path}/manifest/{number}").collect()))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _files(self):
        return self._path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        files, at = self._files(), self._path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []

    def _committed(self) -> list[int]:
        # a manifest counts once Spark has marked it as whole
        files = self._files()
        return [int(n) for n in self._names("manifest") if files.exists(self._path(f"{self.path}/manifest/{n}/_SUCCESS"))]

    def _clear(self, staged: str) -> None:
        """Delete what none of the last ``keep`` states needs."""
        files, numbers = self._files(), sorted(self._committed())
        files.delete(self._path(staged), True)
        held = {f for n in numbers[-self.keep :] for f in self._folders(n).values()}
        for name in self._names("data"):
            for bucket in self._names(f"data/{name}/rows"):
                at = f"{self.path}/data/{name}/rows/{bucket}"
                if bucket.startswith(BUCKET) and at not in held:
                    files.delete(self._path(at), True)
            if not any(f.startswith(f"{self.path}/data/{name}/") for f in held):
                files.delete(self._path(f"{self.path}/data/{name}"), True)
        for n in numbers[: -self.keep]:
            files.delete(self._path(f"{self.path}/manifest/{n}"), True)
