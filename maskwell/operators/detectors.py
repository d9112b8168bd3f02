"""Detectors by name: a registry from which a run picks the ones it wants, composed into one plan.

Each detector is of one of four kinds:

* ``rules``: a set of rules, scanned together with the rules of every other such detector that is picked, in one pass;
* ``column``: a function from the text column to an array of spans;
* ``table``: rows (key, start, end, type, confidence) scored elsewhere, joined by key;
* ``batches``: a function that makes a scorer, which is called once a Python worker; the scorer gives the spans of a text.

Spans keep the order in which detectors are picked, which is the last tie-break of resolution; their detector is the picked
name, but for rules, which have names of their own. Null and blank texts have no spans of rules and batches; what a column or
a table says of them is kept. Spans of a table or a scorer that are empty or do not lie within the text are dropped. Rows of a
repeated key all get the key's spans; an empty table of spans, or none picked, gives empty arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.functions import spans as S
from maskwell.operators import corpus
from maskwell.rules.base import Rule

Scorer = Callable[[str], list[tuple[int, int, str, float]]]
FOUND = "array<struct<start:int,end:int,type:string,confidence:double>>"


@dataclass(frozen=True)
class Detector:
    """threshold: spans below it are dropped; None keeps all (rules have fixed confidences)."""

    name: str
    rules: tuple[Rule, ...] = ()
    column: Callable[[Column], Column] | None = None
    table: DataFrame | None = None
    batches: Callable[[], Scorer] | None = None
    threshold: float | None = None


@dataclass
class Registry:
    known: dict[str, Detector] = field(default_factory=dict)

    def add(self, detector: Detector) -> Registry:
        kinds = [bool(detector.rules), detector.column is not None, detector.table is not None, detector.batches is not None]
        if sum(kinds) != 1:
            raise ValueError(f"{detector.name} must be of one kind")
        if detector.name in self.known:
            raise ValueError(f"{detector.name} is registered already")
        self.known[detector.name] = detector
        return self

    def pick(self, *names: str) -> list[Detector]:
        """The named detectors, in the order given; a name counts once."""
        unknown = [n for n in names if n not in self.known]
        if unknown:
            raise KeyError(f"no detector named {', '.join(unknown)}; there are {', '.join(self.known)}")
        return [self.known[n] for n in dict.fromkeys(names)]


def completed(found: Column, text: Column, name: str) -> Column:
    """Whole spans from their offsets, those within the text."""

    def whole(x: Column) -> Column:
        inside = F.filter(x["found"], lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(x["text"])))
        return F.transform(inside, lambda s: F.struct(
            s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["type"].alias("type"), F.substring(x["text"], s["start"] + 1, s["end"] - s["start"]).alias("value"),
            s["confidence"].cast("double").alias("confidence"), F.lit(name).alias("detector"), F.lit(0).alias("ord"),
        ))

    return F.coalesce(S.bound(F.struct(found.alias("found"), text.alias("text")), whole), S.none(S.SPAN))


def named(spans: Column, name: str) -> Column:
    """Whole spans under a name, with their fields in order."""
    fields = ("start", "end", "type", "value", "confidence")
    return F.coalesce(F.transform(spans, lambda s: F.struct(*[s[c].alias(c) for c in fields], F.lit(name).alias("detector"), F.lit(0).alias("ord"))), S.none(S.SPAN))


def sure(spans: Column, threshold: float) -> Column:
    return F.filter(spans, lambda s: s["confidence"] >= corpus.clamped(threshold))


def of_rules(spans: Column, names: list[str]) -> Column:
    return F.filter(spans, lambda s: s["detector"].isin(names))


def scored(detector: Detector) -> Callable[[Column], Column]:
    made = detector.batches

    @F.pandas_udf(FOUND)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = made()
        for texts in batches:
            yield pd.Series([[dict(zip(("start", "end", "type", "confidence"), s, strict=True)) for s in scorer(t)] if t and t.strip() else [] for t in texts])

    return run


def detected(docs: DataFrame, picked: list[Detector], key: str = "doc_id", text: str = "text", propagated: bool = True) -> DataFrame:
    """docs with ``spans``: what the picked detectors find, united in their order, resolved, and propagated if asked."""
    body, parts, own = F.col(text), [], []
    for k, d in enumerate(picked):
        name = f"_detector_{k}"
        if d.table is not None:
            rows = d.table.select(F.col(key).alias("_key"), F.struct("start", "end", "type", F.col("confidence").cast("double").alias("confidence")).alias("s"))
            lists = rows.groupBy("_key").agg(F.array_sort(F.collect_list("s")).alias(name))
            docs = docs.join(lists, docs[key] == lists["_key"], "left").drop("_key")
            found = completed(F.col(name), body, d.name)
        elif d.batches is not None:
            docs = docs.withColumn(name, scored(d)(body))
            found = completed(F.col(name), body, d.name)
        elif d.column is not None:
            found = named(d.column(body), d.name)
        else:
            continue
        if d.threshold is not None:
            found = sure(found, d.threshold)
        own.append(name)
        parts.append((k, found))
    rules = tuple(dict.fromkeys(r for d in picked for r in d.rules))
    if rules:
        # one pass for all rules, dealt back to their detectors' places
        docs = docs.withColumn("_rules", S.once(S.scan(body, rules)))
        own.append("_rules")
        for k, d in enumerate(picked):
            if d.rules:
                earlier = {r.detector for e in picked[:k] for r in e.rules}
                names = [r.detector for r in d.rules if r.detector not in earlier]
                parts.append((k, of_rules(F.col("_rules"), names)))
    united = F.concat(*[c for _, c in sorted(parts, key=lambda p: p[0])]) if parts else S.none(S.SPAN)
    ready = docs.withColumn("_united", S.once(S.resolve(united.cast(f"array<{S.SPAN}>"))))
    out = corpus.with_repeats(ready, F.col("_united"), text, keep=True, finish=S.resolve) if propagated else ready.withColumn("spans", F.col("_united"))
    return out.drop(*own, "_united")
