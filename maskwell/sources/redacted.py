"""A sink that writes redacted texts and their dictionaries as two tables, in one pass and with one commit.

Each task writes a Parquet file for either table, with the same rows in the same order, below a folder of the run. The driver then
names the files of both tables in a manifest, which is put in place by one rename: until then, and after a failure, a reader sees
neither table (or what was there before). Files of attempts that were lost or repeated are named nowhere. The tables lie in
folders of their own, as the dictionary is the secret.

``path`` is any that pyarrow's file systems open and that all executors share. Modes: append adds to what is there, overwrite
replaces it (older files stay until ``vacuum``). One writer at a time: of two that commit at once, the later one wins.

Defined results: an empty table gives two empty tables with their columns; repeated rows, null texts and null dictionaries are
written as they are; columns other than the key's, ``redacted`` and ``dictionary`` are left out.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "maskwell_redacted"
TABLES = ("redacted", "dictionary")
MANIFEST = "manifest.json"


@dataclass
class Written(WriterCommitMessage):
    file: str | None


def opened(path: str) -> tuple[fs.FileSystem, str]:
    files, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return files, at.rstrip("/")


def manifest(path: str) -> dict | None:
    """schema (of each table) and files, or None where nothing was committed."""
    files, at = opened(path)
    if files.get_file_info(f"{at}/{MANIFEST}").type == fs.FileType.NotFound:
        return None
    with files.open_input_stream(f"{at}/{MANIFEST}") as f:
        return json.loads(f.read())


class TwoTables(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex
        keys = [f.name for f in schema if f.name not in TABLES]
        self.columns = {table: [*keys, table] for table in TABLES}
        self.schemas = {table: StructType([schema[c] for c in own]).jsonValue() for table, own in self.columns.items()}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, at = opened(self.path)
        name = f"{self.run}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.parquet"
        writers: dict[str, pq.ParquetWriter] = {}
        with ExitStack() as stack:
            for batch in iterator:
                for table, own in self.columns.items():
                    part = batch.select(own)
                    if table not in writers:
                        files.create_dir(f"{at}/{table}/{self.run}", recursive=True)
                        writers[table] = stack.enter_context(pq.ParquetWriter(f"{at}/{table}/{name}", part.schema, filesystem=files))
                    writers[table].write_batch(part)
        return Written(name if writers else None)

    def commit(self, messages: list[Written | None]) -> None:
        files, at = opened(self.path)
        before = None if self.overwrite else manifest(self.path)
        if before and before["schemas"] != self.schemas:
            raise ValueError(f"{self.path} holds tables of other columns")
        named = [*(before["files"] if before else []), *sorted(m.file for m in messages if m and m.file)]
        files.create_dir(at, recursive=True)
        with files.open_output_stream(f"{at}/{self.run}.json") as f:
            f.write(json.dumps({"schemas": self.schemas, "files": named}).encode())
        files.move(f"{at}/{self.run}.json", f"{at}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        files, at = opened(self.path)
        for table in TABLES:
            if files.get_file_info(f"{at}/{table}/{self.run}").type == fs.FileType.Directory:
                files.delete_dir(f"{at}/{table}/{self.run}")


class RedactedTables(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> TwoTables:
        return TwoTables(self.options["path"], schema, overwrite)


def save(docs: DataFrame, path: str, key: str = "doc_id", mode: str = "append") -> None:
    """Redacted documents into the two tables at ``path``; mode is append or overwrite."""
    docs.sparkSession.dataSource.register(RedactedTables)
    docs.select(key, *TABLES).write.format(FORMAT).mode(mode).save(path)


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One of the two tables, by Spark's own Parquet reader over the files that were committed."""
    found = manifest(path)
    if found is None:
        raise FileNotFoundError(f"no tables were committed at {path}")
    schema = StructType.fromJson(found["schemas"][table])
    names = [f"{path.rstrip('/')}/{table}/{f}" for f in found["files"]]
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)


def vacuum(path: str) -> None:
    """Delete the files that the manifest doesn't name; not while a writer is at work."""
    files, at = opened(path)
    kept = set((manifest(path) or {"files": []})["files"])
    for table in TABLES:
        root = f"{at}/{table}"
        for info in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.type == fs.FileType.File and info.path[len(root) + 1 :] not in kept:
                files.delete_file(info.path)
