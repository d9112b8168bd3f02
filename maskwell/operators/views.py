"""SQL over a corpus: temporary views of what the rules find in a table, to be queried, joined and grouped by plain SQL.

``attach(spark, docs, "letters", catalogue.select("de"))`` makes three views, which are plans that run when they are queried:

* ``letters_spans``: one row a span: key, idx, start, end, type, value, confidence, detector, region
* ``letters_redacted``: one row a document: key, redacted
* ``letters_dictionary``: one row a placeholder: key, ord, original, placeholder, entity_type

Defined results: null and blank texts have no spans and no placeholders, and are redacted as they are; an empty table gives
empty views; other columns of the table are not in the views, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.operators import corpus
from maskwell.rules.base import Rule

SPAN = ("start", "end", "type", "value", "confidence", "detector")
ENTRY = ("ord", "original", "placeholder", "entity_type")


def attach(spark: SparkSession, docs: DataFrame, name: str, rules: tuple[Rule, ...], key: str = "doc_id", text: str = "text", mode: str = "labelled") -> list[str]:
    """The names of the views; those of an earlier call with this name are replaced."""
    found = corpus.detected(docs.select(key, text), rules, text)
    spans = found.select(key, F.posexplode("spans").alias("idx", "s"))
    # a detector's name holds its region: kind, region, rule
    region = F.split("s.detector", ":")[1]
    entries = corpus.redacted(found, text, mode)
    views = {
        f"{name}_spans": spans.select(key, "idx", *[F.col(f"s.{c}").alias(c) for c in SPAN], region.alias("region")),
        f"{name}_redacted": entries.select(key, "redacted"),
        f"{name}_dictionary": entries.select(key, F.explode("dictionary").alias("e")).select(key, *[F.col(f"e.{c}").alias(c) for c in ENTRY]),
    }
    for view, rows in views.items():
        rows.createOrReplaceTempView(view)
    return list(views)
