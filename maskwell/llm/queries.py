"""The registered queries of the corpus operators and their oracle SQL."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from maskwell.llm import alignment, chat, embedding_dedup, exact_dedup, minhash, packing, quality, secret_scan, sp_codec, spelling, suffix_dedup, token_counts, toxicity
from maskwell.llm.common import documents


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return packing.packing(documents(spark, sf_dir), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ledger = documents(spark, sf_dir), secret_scan.SecretLedger(spark)
    ledger.update(docs)
    return secret_scan.digest(ledger.findings(docs.select("doc_id", "text")))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(documents(spark, sf_dir)).drop("spans")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_codec.summary(sp_codec.encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(documents(spark, sf_dir))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    turns = turns.unionByName(spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string"))
    return chat.read_back(chat.windows(turns, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return alignment.alignment(documents(spark, sf_dir), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), path("piece_bpe_32k.model"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_counts, op2_exact_dedup, op3_packing, op4_secret_scans, op5_suffix_dedup, op6_toxicity, op7_sentencepiece, op8_embedding_dedup, op9_quality, op10_minhash_dedup, op11_chat_formatting, op12_spelling_variants, op13_tokenizer_alignment)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return {"op2_exact_dedup": exact_dedup.ORACLE_SQL, "op4_secret_scans": secret_scan.ORACLE_SQL, "op8_embedding_dedup": embedding_dedup.ORACLE_SQL}
