"""The windows of texts that can hold a match of a rule, found in one pass over each batch of texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwell.rules.base import Rule
from maskwell.rules.needs import gate

WINDOWS = "array<struct<rule:int,start:int,text:string>>"
KIND = pa.struct([("rule", pa.int32()), ("start", pa.int32()), ("text", pa.string())])
CHARACTERS = 1 << 20


def groups(texts: pa.Array) -> Iterator[list[str]]:
    """Runs of texts of about a million characters; null is empty."""
    own: list[str] = []
    size = 0
    for x in texts:
        own.append(x.as_py() or "")
        size += len(own[-1])
        if size >= CHARACTERS:
            yield own
            own, size = [], 0
    if own:
        yield own


def found(own: list[str], rules: tuple[Rule, ...]) -> pa.Array:
    """The windows of each of some texts."""
    body = "\0".join(own) + "\0"
    edges = np.concatenate([[0], np.cumsum([len(x) + 1 for x in own])])
    doc, rule, begin, end = gate(rules).windows(body, edges)
    values = pa.StructArray.from_arrays(
        [pa.array(rule, pa.int32()), pa.array(begin - edges[doc], pa.int32()), pa.array([body[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.string())],
        fields=list(KIND),
    )
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(own) + 1)), pa.int32()), values)


def in_parts(batches: Iterator[pa.Array], rules: tuple[Rule, ...]) -> Iterator[pa.Array]:
    """The windows of batches of texts, group by group: no more is held at once, whatever a batch has."""
    for texts in batches:
        for own in groups(texts):
            yield found(own, rules)


def windows(text: Column, rules: tuple[Rule, ...], alone: bool = True) -> Column:
    """rule (its place in ``rules``), start and text of each window, by rule and start.

    alone: windows leave the worker group by group, so it holds those of a million characters, whatever a batch has; such a
    function has a worker of its own. Without it, those of one projection share a worker, which holds a batch's windows.
    """
    plain = tuple(replace(r, check=None) for r in rules)

    @F.arrow_udf(WINDOWS)
    def whole(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], pa.list_(KIND)), *in_parts(iter([texts]), plain)])

    @F.arrow_udf(WINDOWS)
    def parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from in_parts(batches, plain)

    return (parts if alone else whole)(text)
