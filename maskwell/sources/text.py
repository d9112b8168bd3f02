"""Sources and sinks of text corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The extensions of word-processor files
WORD_FILES = ("docx", "doc")


def read_texts(spark: SparkSession, path: str, fmt: str = "parquet", key: str = "doc_id", text: str = "text", schema: str | None = None, **options) -> DataFrame:
    """(key, text) of a corpus in any format that Spark reads; a schema spares a pass over JSON or CSV."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path).select(key, text)


def extension(name: Column) -> Column:
    """What follows the last dot of a file name, in lower case; nothing without a dot."""
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def supported(name: Column) -> Column:
    return extension(name).isin(*WORD_FILES)


def redacted_name(name: Column) -> Column:
    """base.ext becomes base_redacted.ext."""
    return F.when(name.contains("."), F.regexp_replace(name, r"\.([^.]*)$", "_redacted.$1")).otherwise(F.concat(name, F.lit("_redacted")))


def control_characters(text: Column) -> Column:
    """Line ends as line feeds, bells as tabs, vertical tabs and form feeds as line feeds, other control characters dropped."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    drop = "".join(chr(c) for c in (*range(7), 8, *range(0x0E, 0x20)))
    return F.translate(text, "\x07\x0b\x0c" + drop, "\t\n\n")


def write_redacted(docs: DataFrame, path: str, key: str = "doc_id") -> None:
    """Redacted texts and dictionaries in two tables: the second is the secret."""
    docs.select(key, "redacted").write.parquet(f"{path}/redacted")
    docs.select(key, "dictionary").write.parquet(f"{path}/dictionary")
