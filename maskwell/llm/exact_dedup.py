"""Exact deduplication by skew-safe combining.

Three combining steps, each of which groups by digest *and* whole text: every map task deduplicates its
own rows first (the partial aggregation before the shuffle), rows of the same salt meet next, and the
winners of all salts meet last. However often one text occurs, a combining step receives at most one row
for it from each task or salt. Rows then look up their group's winner; groups beyond a partition's share of the rows are
copied to as many cells as they hold such shares, and their rows are dealt to the cells. Only DataFrame functions are used.

Defined results: null text counts as empty; a null key loses against every other key; repeated rows are
members like any others; an empty table gives an empty result; other columns, whatever their names, are
not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.llm.common import shuffle_partitions, stored, whole_text


def winners(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = 32) -> DataFrame:
    """One row per distinct text: digest, text, keep_id (the largest key), group_size."""
    rows = docs.select(F.col(key).cast("long").alias("id"), whole_text(text).alias("body"))
    rows = rows.select("id", "body", F.unhex(F.sha2("body", 256)).alias("digest"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    by_salt = rows.groupBy("digest", "body", "salt").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return by_salt.groupBy("digest", "body").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))


def cells(groups: DataFrame, partitions: int) -> DataFrame:
    """groups with ``cells``: the number of partitions' shares of all rows that a group holds, 1 at least.

    Groups of several cells hold more than a share each, so there are fewer of them than partitions.
    """
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0)).alias("n")).first()["n"]
    return groups.withColumn("cells", F.greatest(F.lit(1), F.ceil(F.col("group_size") * partitions / F.lit(max(total, 1)))).cast("int"))


def met(rows: DataFrame, groups: DataFrame, partitions: int) -> DataFrame:
    """rows (id, digest) with their group's columns; no partition gets more than about a share of the rows of one group."""
    counted = cells(groups, partitions)
    split = counted.filter("cells > 1").select("digest", "cells")
    dealt = rows.join(F.broadcast(split), "digest", "left")
    # any cell of the group is right, so rows of one key may be dealt by where they lie
    dealt = dealt.withColumn("cell", F.coalesce(F.pmod(F.xxhash64("id", F.spark_partition_id()), F.col("cells")).cast("int"), F.lit(0))).drop("cells")
    copies = counted.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).drop("cells")
    return dealt.join(copies, ["digest", "cell"]).drop("cell")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = 32) -> DataFrame:
    """One row per document, dropped ones too: key, keep_id, group_size, kept, text_sha256.

    Membership is joined by digest. Texts that differ under one digest would show in the winners (they are
    grouped by whole text); such digests, if there are any, are joined by digest and text instead.
    Repeated rows of the winning key are all marked as kept.
    """
    found = winners(docs, key, text, salts)
    groups = stored(found.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")), "exact-groups")
    rows = docs.select(F.col(key).cast("long").alias("id"), whole_text(text).alias("body")).withColumn("digest", F.unhex(F.sha2("body", 256)))
    one = groups.filter("texts = 1").select("digest", "keep_id", "group_size")
    out = met(rows.select("id", "digest"), one, shuffle_partitions(docs.sparkSession)).select("id", "digest", "keep_id", "group_size")
    if not groups.filter("texts > 1").isEmpty():
        shared = groups.filter("texts > 1").select("digest")
        out = out.unionByName(rows.join(found.join(shared, "digest", "left_semi"), ["digest", "body"]).select("id", "digest", "keep_id", "group_size"))
    return out.select(
        F.col("id").alias(key),
        "keep_id",
        "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = 32) -> DataFrame:
    """The documents that stay, with all their columns: of equal texts the largest key's row (all of its rows, if a
    key is repeated)."""
    kept = exact_dedup(docs, key, text, salts).filter("kept").select(F.col(key).alias("_kept_id")).dropDuplicates()
    return docs.join(kept, docs[key].eqNullSafe(kept["_kept_id"]), "left_semi")


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
