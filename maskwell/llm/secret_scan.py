"""Secret scanning through an incremental ledger of content-addressed blobs.

A document is a path (or one historical version of it); its text is a blob, addressed by its SHA-256.
The ledger is a table of (blob, rule set version, spans). ``SecretLedger.update`` looks for blobs that
have no ledger row of the current version, scans each of them once, and appends the rows; ``findings``
joins the ledger back to all paths. A text that a third of all documents hold is scanned once, and the
shuffle that finds distinct blobs combines in every map task first. Only DataFrame functions are used.

Defined results: null text is the empty blob, which has no spans; ties of spans are ordered by kind as
listed in RULES; repeated rows each get their findings; an empty table gives an empty result; other columns
come back as they are, but for one that has the name of the findings. Offsets count code points, the end is
exclusive. A text of many hits takes little more than time in proportion to them (arrays grow in blocks), in one task. Rows of a
text that more than a thousandth of all rows hold are not shuffled to one task: they meet a copy of its ledger row.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.functions import spans as S
from maskwell.llm.common import looked_up, shared_dir, whole_text

# The three base patterns and the least lengths of what they find.
RULES_VERSION = "base-1"


@dataclass(frozen=True)
class SecretRule:
    """pattern: matched leftmost, without overlaps; the match fails where the group is shorter than least."""

    kind: str
    pattern: str
    group: int
    least: int
    gate: str


RULES = (
    SecretRule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    # runs of 24 and more are what is left of all runs once short ones are dropped, as a run is maximal
    SecretRule("hex", r"[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}"),
)

SPAN = "struct<start:int,rank:int,stop:int,kind:string>"


def rule_spans(text: Column, rule: SecretRule, rank: int) -> Column:
    """Spans of one rule: running sums of the texts between matches give the offsets, failing matches go afterwards."""
    pattern = F.lit(rule.pattern)
    hits, parts = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))

    def placed(x: Column) -> Column:
        rows = F.arrays_zip(S.ends_of(x["gaps"], x["hits"]).alias("stop"), x["hits"].alias("hit"), x["parts"].alias("part"))
        good = F.filter(rows, lambda r: F.length(r["part"]) >= rule.least)
        return F.transform(good, lambda r: F.struct((r["stop"] - F.length(r["hit"])).cast("int").alias("start"), F.lit(rank).alias("rank"), r["stop"].cast("int").alias("stop"), F.lit(rule.kind).alias("kind")))

    found = F.struct(F.split(text, rule.pattern, -1).alias("gaps"), hits.alias("hits"), parts.alias("parts"))
    return F.when(text.rlike(rule.gate), S.bound(found, placed)).otherwise(S.none(SPAN))


def scan(text: Column, rules: tuple[SecretRule, ...] = RULES) -> Column:
    """All spans of a text, by start and then by the order of the rules."""
    return F.array_sort(F.concat(*[rule_spans(text, rule, k) for k, rule in enumerate(rules)]))


class SecretLedger:
    """A ledger table in the shared folder; one row for each scanned blob and rule set version."""

    def __init__(self, spark: SparkSession, path: str | None = None, rules: tuple[SecretRule, ...] = RULES, version: str = RULES_VERSION):
        self.spark, self.rules, self.version = spark, rules, version
        self.path = path or f"{shared_dir(spark)}/maskwell/secret-ledger-{uuid.uuid4().hex}"
        self.schema = f"blob binary, version string, spans array<{SPAN}>"

    def rows(self) -> DataFrame:
        """The ledger as it stands; a ledger that nothing was added to yet is empty."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], self.schema)
        # two updates at a time may both have scanned a blob
        return self.spark.read.schema(self.schema).parquet(self.path).dropDuplicates(["blob", "version"])

    def update(self, docs: DataFrame, text: str = "text") -> None:
        """Scan the blobs of docs that have no row of this version and append what is found."""
        blobs = docs.select(whole_text(text).alias("body")).select(F.unhex(F.sha2("body", 256)).alias("blob"), "body").dropDuplicates(["blob", "body"])
        known = self.rows().filter(F.col("version") == self.version).select("blob")
        if not known.isEmpty():
            blobs = blobs.join(known, "blob", "left_anti")
        blobs.select("blob", F.lit(self.version).alias("version"), scan(F.col("body"), self.rules).alias("spans")).write.mode("append").parquet(self.path)

    def findings(self, docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
        """docs with a column ``out``, in the place of one of that name: what the ledger holds for each row's blob."""
        blob = "_blob"
        while blob in docs.columns:
            blob += "_"
        ledger = self.rows().filter(F.col("version") == self.version).select(F.col("blob").alias(blob), F.col("spans").alias(out))
        own = docs.withColumn(blob, F.unhex(F.sha2(whole_text(text), 256)))
        return looked_up(own.drop(out), blob, ledger, docs.count(), "left").drop(blob)


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by <kind>; of overlapping spans, the first names the gap they leave.

    Spans are taken in blocks of about the root of their number, each with its own part of the text, as finding a place in a text
    takes time in proportion to what stands before it.
    """
    gap = "struct<at:int,start:int,kind:string>"

    def step(at: Column, s: Column) -> Column:
        named = F.struct(at.cast("int").alias("at"), s["start"].alias("start"), s["kind"].alias("kind"))
        return F.struct(F.greatest(at, s["stop"]).alias("state"), F.when(s["start"] >= at, named).alias("out"))

    def block(x: Column) -> Column:
        first = x["gaps"][0]["at"]
        return F.array_join(F.transform(x["gaps"], lambda g: F.concat(F.substring(x["part"], g["at"] - first + 1, g["start"] - g["at"]), F.lit("<"), g["kind"], F.lit(">"))), "")

    def blocks(x: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(x["gaps"]))).cast("int")

        def own(k: Column) -> Column:
            part = F.slice(x["gaps"], k, size)
            begin = part[0]["at"]
            return F.struct(part.alias("gaps"), F.substring(x["text"], begin + 1, F.element_at(part, -1)["start"] - begin).alias("part"))

        done = F.transform(F.sequence(F.lit(1), F.size(x["gaps"]), size), lambda k: S.bound(own(k), block))
        return F.concat(F.array_join(done, ""), F.substring(x["text"], x["last"] + 1, F.length(x["text"])))

    def run(x: Column) -> Column:
        last = F.array_max(F.transform(x["spans"], lambda s: s["stop"]))
        return S.bound(F.struct(S.in_blocks(x["spans"], F.lit(0), gap, step).alias("gaps"), x["text"].alias("text"), last.alias("last")), blocks)

    return F.when(F.size(spans) > 0, S.bound(F.struct(text.alias("text"), spans.alias("spans")), run)).otherwise(text)


def span_list(spans: Column) -> Column:
    """kind:start:end by start, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def digest(found: DataFrame, key: str = "doc_id", rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """Counts by kind, the base spans' digest and the list of all spans."""
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    listed = span_list(F.col("spans"))
    return found.select(key, *[count(rule.kind).alias(f"n_{rule.kind}") for rule in rules], F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans"))


def _sql_kind(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""
SELECT doc_id, {rank} AS k, '{kind}' AS kind, hits[i] AS hit, parts[i] AS part,
       list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS s
FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i
      FROM (SELECT doc_id, regexp_split_to_array(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS hits,
                   regexp_extract_all(t, '{pattern}', {group}) AS parts
            FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)))
WHERE length(parts[i]) >= {least}"""


_WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ORACLE_SQL = f"""
WITH found AS ({" UNION ALL ".join([
    _sql_kind("assign", 0, rf'''({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)''', 2, 6),
    _sql_kind("access", 1, "AKIA[A-Z0-9]+", 0, 20),
    _sql_kind("hex", 2, "[0-9a-f]+", 0, 24),
])}),
listed AS (
SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
       string_agg(kind || ':' || s::BIGINT || ':' || (s::BIGINT + length(hit)), ',' ORDER BY s, k) AS spans
FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN listed USING (doc_id)
"""
