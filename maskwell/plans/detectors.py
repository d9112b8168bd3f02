"""Registered queries over detectors that are picked by name."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.operators import corpus
from maskwell.operators.detectors import Detector, Registry, detected
from maskwell.plans import sql
from maskwell.plans.catalogue import DOCS, FOUR, query, spread, texts


def long_words():
    """A scorer that stands for a model: words of fourteen letters and more, surer the longer they are."""
    word = re.compile("[a-z]{14,}")
    return lambda text: [(m.start(), m.end(), "TERM", len(m.group()) / 32) for m in word.finditer(text)]


# a table's spans stand for scores from elsewhere: the sixth to the tenth character of each third document
_TABLE = "SELECT doc_id, 5 AS s, 10 AS e FROM documents WHERE doc_id % 3 = 0"
_NAMED = f"""
SELECT doc_id, -2 AS ord, 1 AS i, s, e, 'PERSON' AS type, substr(text, s + 1, e - s) AS value, 0.9::DOUBLE AS confidence, 'scores' AS detector FROM ({_TABLE}) JOIN ({DOCS}) USING (doc_id) WHERE length(text) >= e
UNION ALL
SELECT doc_id, -1, i, (upto - length(v))::INT, upto::INT, 'TERM', v, length(v) / 32.0::DOUBLE, 'words'
FROM (SELECT *, sum(length(gap) + length(v)) OVER (PARTITION BY doc_id ORDER BY i) AS upto
      FROM (SELECT doc_id, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS v, unnest(gaps[1:len(hits)]) AS gap
            FROM (SELECT doc_id, regexp_extract_all(text, '[a-z]{{14,}}') AS hits, regexp_split_to_array(text, '[a-z]{{14,}}') AS gaps FROM ({DOCS}))))
WHERE length(v) / 32.0 >= 0.5
UNION ALL {sql.scan(DOCS, FOUR)}"""


@query(f'SELECT doc_id, s AS start, e AS "end", type, value, confidence, detector FROM ({sql.resolved(_NAMED)})')
def detectors_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(texts(spark, sf_dir))
    scores = docs.filter("doc_id % 3 = 0").select("doc_id", F.lit(5).alias("start"), F.lit(10).alias("end"), F.lit("PERSON").alias("type"), F.lit(0.9).alias("confidence"))
    known = Registry().add(Detector("rules", rules=FOUR)).add(Detector("words", batches=long_words, threshold=0.5)).add(Detector("scores", table=scores)).add(Detector("unused", column=lambda t: F.lit(None)))
    return corpus.exploded(detected(docs, known.pick("scores", "words", "rules"), propagated=False)).drop("idx")
