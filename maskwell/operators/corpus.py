"""Detection, resolution, redaction and restoration over DataFrames.

Keys are columns of the caller's choice; a document's spans travel as one array, so the main path has no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwell.functions import spans as S
from maskwell.functions.propagation import repeated
from maskwell.rules.base import Rule
from maskwell.rules.catalogue import RULES

# Limits of a threshold, the defaults of the two model families, and the lengths of short values
LOWEST, HIGHEST, SHORTEST = 0.05, 0.95, 3
THRESHOLDS = {"spans": 0.35, "tags": 0.5}


def detected(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", model: str | None = None, propagated: bool = True, gated: bool = True) -> DataFrame:
    """docs with ``spans``: the two-pass pipeline (found, resolved, propagated, resolved again); ``model`` names a column of externally scored spans."""
    first = S.first_pass(F.col(text), rules, F.col(model) if model else None, gated)
    if not propagated:
        return docs.withColumn("spans", first)
    return with_repeats(docs, first, text, keep=True, finish=S.resolve)


def with_repeats(docs: DataFrame, spans: Column, text: str = "text", keep: bool = False, finish=lambda x: x) -> DataFrame:
    """docs with ``spans``: where each document repeats, between boundary characters, what the given resolved spans found; after
    these with ``keep``. The input of the search is a column of its own, as one function's input can't hold another's output in a fold.
    """
    own = "_parts"
    while own in docs.columns:
        own += "_"
    ready = docs.withColumn(own, S.once(S.to_propagate(F.col(text), spans)))
    return ready.withColumn("spans", S.once(finish(repeated(F.col(own), S.SPAN, keep)))).drop(own)


def each(docs: DataFrame, elements: Column, name: str, *keep: str) -> DataFrame:
    """keep, name: one row per element of an array whose elements are never null.

    The outer form with a filter above it: for the inner one the optimizer adds filters on the array below the
    generator, and computes a costly array once for each of them.
    """
    return docs.select(*keep, F.explode_outer(elements).alias(name)).filter(F.col(name).isNotNull())


def exploded(docs: DataFrame, key: str = "doc_id", spans: str = "spans") -> DataFrame:
    """One row per span: key, idx (its place), start, end, type, value, confidence, detector."""
    rows = docs.select(key, F.posexplode_outer(spans).alias("idx", "s")).filter("idx is not null")
    return rows.select(key, "idx", *[F.col(f"s.{c}").alias(c) for c in ("start", "end", "type", "value", "confidence", "detector")])


def collected(rows: DataFrame, key: str = "doc_id", order: str = "ord") -> DataFrame:
    """key, spans: rows of spans as one array for each document."""
    fields = F.struct(*[F.col(c) for c in ("start", "end", "type", "value", "confidence", "detector")], F.col(order).cast("int").alias("ord"))
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), fields.alias("s")))), lambda x: x["s"]).alias("spans"))


def redacted(docs: DataFrame, text: str = "text", mode: str = "labelled") -> DataFrame:
    """docs (with spans) with ``dictionary`` and ``redacted``."""
    out = docs.withColumn("dictionary", S.dictionary(F.col("spans"), mode))
    return out.withColumn("redacted", S.redact(F.col(text), F.col("spans"), F.col("dictionary")))


def restored(responses: DataFrame, dictionaries: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Responses with ``restored``: each joined to its document's dictionary (key, dictionary); without one it stays."""
    joined = responses.join(dictionaries.select(key, "dictionary"), key, "left")
    return joined.withColumn("restored", F.when(F.col("dictionary").isNull(), F.col(text)).otherwise(S.restore(F.col(text), F.col("dictionary")))).drop("dictionary")


def listing(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The dictionaries as rows: key, ord, original, placeholder, entity_type."""
    return each(docs, F.col("dictionary"), "e", key).select(key, "e.*")


def clamped(threshold: float | Column) -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.least(F.greatest(t, F.lit(LOWEST)), F.lit(HIGHEST))


def sure_enough(rows: DataFrame, threshold: float, rules_too: bool = False) -> DataFrame:
    """Model spans of at least the threshold; rule spans are kept as they are unless asked."""
    good = F.col("confidence") >= clamped(threshold)
    return rows.filter(good if rules_too else good | F.col("detector").startswith("regex:"))


def long_enough(rows: DataFrame) -> DataFrame:
    """Without model spans whose trimmed value is too short."""
    return rows.filter(F.col("detector").startswith("regex:") | (F.length(S.trimmed(F.col("value"))) >= SHORTEST))


def band(confidence: Column) -> Column:
    return F.when(confidence > 0.8, "high").when(confidence > 0.5, "mid").otherwise("low")


def percent(confidence: Column) -> Column:
    return F.floor(confidence * 100 + 0.5).cast("int")


def excluded(rows: DataFrame, exclusions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans without the occurrences that (key, idx) rows name."""
    return rows.join(exclusions, [key, "idx"], "left_anti")


def removed(rows: DataFrame, removals: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same, and the indexes above a removed one move down."""
    left = excluded(rows, removals, key)
    return left.withColumn("idx", (F.row_number().over(Window.partitionBy(key).orderBy("idx")) - 1).cast("int"))


def with_manual(docs: DataFrame, manual: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans united with manual tags (key, start, end, type), which outrank what they overlap."""
    tag = F.struct("start", "end", "type").alias("tag")
    tags = manual.groupBy(key).agg(F.array_sort(F.collect_list(tag)).alias("tags"))

    def made(t: Column, body: Column) -> Column:
        return F.struct(
            t["start"].cast("int").alias("start"), t["end"].cast("int").alias("end"), t["type"].alias("type"), F.substring(body, t["start"] + 1, t["end"] - t["start"]).alias("value"),
            F.lit(1.0).alias("confidence"), F.lit("manual").alias("detector"), F.lit(0).alias("ord"),
        )

    joined = docs.join(tags, key, "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<struct<start:int,end:int,type:string>>")))
    free = F.filter("spans", lambda s: ~F.exists("tags", lambda t: (s["start"] < t["end"]) & (s["end"] > t["start"])))
    both = F.concat(F.transform("tags", lambda t: made(t, F.col(text))), free)
    return joined.withColumn("spans", S.resolve(both)).drop("tags")


def renamed(entries: DataFrame, renames: DataFrame, key: str = "doc_id") -> DataFrame:
    """Dictionary rows with (key, original, label, at) applied: the latest label of an original wins, blank ones don't count.

    ``current`` tells whose original a label restores to when several share it: the latest renamed one's.
    """
    label = S.trimmed(F.col("label"))
    usable = renames.filter(F.length(label) > 0).withColumn("label", F.concat(F.lit("<<"), label, F.lit(">>")))
    latest = usable.withColumn("r", F.row_number().over(Window.partitionBy(key, "original").orderBy(F.desc("at")))).filter("r = 1").drop("r")
    out = entries.join(latest, [key, "original"], "left").withColumn("placeholder", F.coalesce("label", "placeholder"))
    owner = F.row_number().over(Window.partitionBy(key, "placeholder").orderBy(F.desc_nulls_last("at"), F.desc("ord")))
    return out.withColumn("current", owner == 1).drop("label", "at")


def looked_up(rows: DataFrame, entries: DataFrame, key: str = "doc_id", unknown: str | None = "—") -> DataFrame:
    """Spans with their placeholder; an unknown value gets ``unknown``, or itself where that is None."""
    known = entries.select(key, F.col("original").alias("value"), "placeholder")
    return rows.join(known, [key, "value"], "left").withColumn("placeholder", F.coalesce("placeholder", F.lit(unknown) if unknown is not None else F.col("value")))


def placeholders(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every placeholder-like string of a text: key, idx, placeholder."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"<<[^<>]+>>"), F.lit(0))
    return docs.select(key, F.posexplode_outer(found).alias("idx", "placeholder")).filter("idx is not null")


def answer_check(responses: DataFrame, entries: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, placeholder, state: known (in both), invented (not in the dictionary), lost (not in the response)."""
    seen = placeholders(responses, key, text).select(key, "placeholder").distinct()
    known = entries.select(key, "placeholder").distinct().join(responses.select(key).distinct(), key, "left_semi")
    both = seen.withColumn("s", F.lit(1)).join(known.withColumn("k", F.lit(1)), [key, "placeholder"], "full")
    return both.select(key, "placeholder", F.when(F.col("s").isNull(), "lost").when(F.col("k").isNull(), "invented").otherwise("known").alias("state"))


def session_numbers(values: DataFrame, stored: DataFrame, order: list[str]) -> DataFrame:
    """One session over many documents: original, ord. Known values keep their number, new ones go on from the largest.

    New values are numbered by ``order``, their first appearance. Numbers are given range by range, so that no task
    has to hold all new values. The ranges are checkpointed where the session has a checkpoint folder.
    """
    context = values.sparkSession.sparkContext
    # what the ranges were must not be found anew: numbers of two samplings could clash
    settled = lambda df: df.checkpoint() if context.getCheckpointDir() else df
    new = values.groupBy("original").agg(F.min(F.struct(*order)).alias("first")).join(stored.select("original"), "original", "left_anti")
    ranged = settled(new.repartitionByRange(F.col("first"), F.col("original")).withColumn("part", F.spark_partition_id()))
    ranked = ranged.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("first", "original")))
    sizes = ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # one row a range
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    base = stored.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("base"))
    fresh = ranked.join(F.broadcast(before), "part").crossJoin(F.broadcast(base)).select("original", (F.col("base") + F.col("before") + F.col("k")).cast("long").alias("ord"))
    return stored.select("original", F.col("ord").cast("long").alias("ord")).unionByName(fresh)


def latest(rows: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """The row of each key with the highest version."""
    every = F.struct(*[F.col(c) for c in version], *[F.col(c) for c in rows.columns if c not in version])
    return rows.groupBy(*key).agg(F.max(every).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in rows.columns])
