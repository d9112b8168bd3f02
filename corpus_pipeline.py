"""The corpus pipeline: documents without toxic texts, copies, near copies and secrets, packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.llm import exact_dedup, minhash, packing, secret_scan, toxicity
from maskwell.llm.common import documents, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the classifier learns from the labels of these documents."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_below(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.keep_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the document with the smallest id."""
    return minhash.keep_rows(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; what the ledger has found in a text is replaced by its kind, and n_chars follows."""
    ledger = secret_scan.SecretLedger(spark)
    ledger.update(docs)
    own = "spans"
    while own in docs.columns or own + "size" in docs.columns:
        own += "_"
    size = own + "size"
    found = ledger.findings(docs, out=own).withColumn(own, F.coalesce(own, F.array().cast(f"array<{secret_scan.SPAN}>")))
    clean = found.select(*[secret_scan.redact(F.col("text"), F.col(own)).alias(c) if c == "text" else F.col(c) for c in docs.columns], F.size(own).alias(size))
    return clean.withColumn("n_chars", F.when(F.col(size) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    path = public_tokenizers.path
    return packing.packing(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("secret_scans", redact_secrets),
    ("packing", pack),
]

# KK differencing, a trained classifier and a library's token ids are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of a folder."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
