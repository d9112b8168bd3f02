"""Registered queries over the SQL views and the sink of two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.functions import spans as S
from maskwell.operators import corpus
from maskwell.operators.views import attach
from maskwell.plans import sql
from maskwell.plans.catalogue import DOCS, FOUR, query, spread, table, texts
from maskwell.sources import redacted
from maskwell.streaming.store import shared_folder

_KEPT = sql.resolved(sql.scan(DOCS, FOUR))
_NUMBERED = sql.numbered(_KEPT)


# U4
@query(f"""
SELECT lang, type, split_part(detector, ':', 2) AS region, count(*) AS n, count(DISTINCT doc_id) AS n_docs, count(DISTINCT value) AS n_values
FROM ({_KEPT}) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY ALL""")
def spans_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    attach(spark, spread(texts(spark, sf_dir)), "corpus", FOUR)
    langs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return spark.sql(
        "SELECT lang, type, region, count(*) AS n, count(DISTINCT doc_id) AS n_docs, count(DISTINCT value) AS n_values FROM corpus_spans JOIN {langs} USING (doc_id) GROUP BY lang, type, region",
        langs=langs,
    )


# S6
@query(f"SELECT doc_id, redacted, text AS restored FROM ({sql.redacted(DOCS, _NUMBERED)}) JOIN ({DOCS}) USING (doc_id)")
def two_tables_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "redacted-tables")
    redacted.save(corpus.redacted(corpus.detected(spread(texts(spark, sf_dir)), FOUR)), path)
    rows = redacted.read(spark, path, "redacted").join(redacted.read(spark, path, "dictionary"), "doc_id")
    return rows.select("doc_id", "redacted", S.restore(F.col("redacted"), F.col("dictionary")).alias("restored"))
