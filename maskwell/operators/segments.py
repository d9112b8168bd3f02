"""Documents as ordered runs of text: flattening, and rewriting spans so that runs stay apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def flattened(segments: DataFrame, key: str = "doc_id", order: tuple[str, ...] = ("part", "paragraph", "seq"), text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, placed segments): runs of a paragraph join without a separator, paragraphs and parts by line feeds.

    Placed segments have flat_start and flat_end. Empty runs (and so empty parts) are left out.
    """
    rows = segments.filter(F.length(text) > 0)
    along = Window.partitionBy(key).orderBy(*order)
    same = F.lag(F.struct(*[F.col(c) for c in order[:-1]])).over(along) == F.struct(*[F.col(c) for c in order[:-1]])
    rows = rows.withColumn("sep", F.when(F.row_number().over(along) == 1, 0).when(same, 0).otherwise(1))
    upto = F.sum(F.col("sep") + F.length(text)).over(along.rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("flat_end", upto.cast("int")).withColumn("flat_start", (F.col("flat_end") - F.length(text)).cast("int"))
    runs = F.array_sort(F.collect_list(F.struct("flat_start", "sep", text)))
    joined = F.array_join(F.transform(runs, lambda x: F.concat(F.when(x["sep"] == 1, "\n").otherwise(""), x[text])), "")
    return placed.groupBy(key).agg(joined.alias("text")), placed.drop("sep")


# width of the bins that runs and spans are dealt to, in characters
BIN = 4096


def binned(rows: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Rows once for each bin that their half-open range reaches, with ``bin`` and ``first_bin``; empty ranges lie where they begin."""
    at = lambda c: F.floor(c / width).cast("long")
    last = at(F.greatest(F.col(end) - 1, F.col(start)))
    return rows.withColumn("first_bin", at(F.col(start))).withColumn("bin", F.explode(F.sequence("first_bin", last)))


def overlaps(placed: DataFrame, spans: DataFrame, key: str = "doc_id", width: int = BIN) -> DataFrame:
    """Segments with the spans that touch them (half-open ranges), within a document.

    Both sides are dealt to bins of offsets and meet by document and bin, so a run meets the spans near it and a long document
    is many keys. A pair that shares several bins is kept in the first of them: where the later one of the two begins.
    """
    own = [c for c in spans.columns if c not in (key, "start", "end")]
    s = binned(spans.select(F.col(key).alias("_key"), "start", "end", *own).filter(F.col("end") > F.col("start")), "start", "end", width)
    s = s.withColumnsRenamed({"bin": "_bin", "first_bin": "_first_bin"})
    p = binned(placed, "flat_start", "flat_end", width)
    touching = (p["flat_end"] > s["start"]) & (p["flat_start"] < s["end"])
    once = p["bin"] == F.greatest(p["first_bin"], s["_first_bin"])
    return p.join(s, (p[key] == s["_key"]) & (p["bin"] == s["_bin"]) & once & touching).drop("_key", "_bin", "_first_bin", "bin", "first_bin")


def rewritten(placed: DataFrame, spans: DataFrame, key: str = "doc_id", order: tuple[str, ...] = ("part", "paragraph", "seq"), text: str = "text") -> DataFrame:
    """Segments with their text after replacing spans (start, end, placeholder) that don't overlap each other.

    The first run of a span gets the placeholder and what follows the span in its last run; runs between are emptied.
    Applied right to left, a run can give its tail to an earlier one: pieces follow the chain of spans to its first run.
    """
    touched = overlaps(placed.select(key, *order, "flat_start", "flat_end", text), spans.select(key, "start", "end", "placeholder"), key)
    of_span = Window.partitionBy(key, "start", "end").orderBy(*order)
    wide = Window.partitionBy(key, "start", "end")
    touched = touched.withColumn("nth", F.row_number().over(of_span)).withColumn("runs", F.count(F.lit(1)).over(wide))
    # per run: the spans in it, in order; a run whose first span began in an earlier run gives away all it has
    lists = F.array_sort(F.collect_list(F.struct("start", "end", "placeholder", "nth", "runs")))
    own = touched.groupBy(key, *order).agg(lists.alias("spans"))
    rows = placed.join(own, [key, *order], "left")
    begin = F.struct(F.col("flat_start").alias("at"), F.lit("").alias("kept"))

    def step(acc, s):
        gap = F.substring(F.col(text), acc["at"] - F.col("flat_start") + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        shown = F.when(s["nth"] == 1, s["placeholder"]).otherwise("")
        return F.struct(F.least(s["end"], F.col("flat_end")).alias("at"), F.concat(acc["kept"], gap, shown).alias("kept"))

    folded = F.aggregate("spans", begin, step, lambda acc: F.concat(acc["kept"], F.substring(F.col(text), acc["at"] - F.col("flat_start") + 1, F.length(text))))
    rows = rows.withColumn("body", F.when(F.col("spans").isNull(), F.col(text)).otherwise(folded))
    gives = F.coalesce(F.exists("spans", lambda s: s["nth"] > 1), F.lit(False))
    # runs that give their text away belong to the run where the chain of spans began
    along = Window.partitionBy(key).orderBy(*order)
    rows = rows.withColumn("head", F.sum((~gives).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("gives", gives)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "body")).over(Window.partitionBy(key, "head"))), lambda x: x["body"]), "")
    return rows.select(key, *order, F.when(F.col("gives"), F.lit("")).otherwise(whole).alias(text))
