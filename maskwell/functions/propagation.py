"""Where a document repeats what its spans found: all its terms by one automaton, in one pass over the text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwell.rules.needs import WHITE_CODES

# The characters that may stand around a propagated value besides white space; what the new spans say
AROUND = frozenset(".,;:!?()\"'„-–—/") | {chr(c) for c in WHITE_CODES}
CONFIDENCE, DETECTOR = 0.95, "propagated"
# texts whose spans a worker holds at once
ROWS = 256
KIND = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("value", pa.string()), ("confidence", pa.float64()), ("detector", pa.string()), ("ord", pa.int32())])


def repeats(text: str, low: str, taken: set[tuple[int, int]], terms: list[dict]) -> list[tuple]:
    """Every place of a term between boundary characters that no span holds exactly; by term, then by place.

    Of terms that are equal in folded case, and of terms at one place, the first wins.
    """
    first: dict[str, int] = {}
    for k, t in enumerate(terms):
        first.setdefault(t["low"], k)
    automaton = ahocorasick.Automaton()
    for word, k in first.items():
        automaton.add_word(word, (k, len(word)))
    automaton.make_automaton()
    found, n = [], len(text)
    for last, (k, size) in automaton.iter(low):
        start, end = last + 1 - size, last + 1
        if (start == 0 or text[start - 1] in AROUND) and (end >= n or text[end] in AROUND) and (start, end) not in taken:
            found.append((k, start, end))
    return [(a, b, terms[k]["type"], text[a:b], CONFIDENCE, DETECTOR, 0) for k, a, b in sorted(found)]


def repeated(parts: Column, span: str, keep: bool = False) -> Column:
    """New spans from struct(text, low, spans, terms), after the spans themselves with ``keep``; terms are (low, type). Null gives none."""

    def of(row: pa.Scalar) -> list[dict]:
        x = row.as_py()
        own = repeats(x["text"], x["low"], {(s["start"], s["end"]) for s in x["spans"]}, x["terms"]) if x and x["terms"] else []
        return [*(x["spans"] if x and keep else []), *(dict(zip(KIND.names, s, strict=True)) for s in own)]

    @F.arrow_udf(f"array<{span}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            for at in range(0, len(rows), ROWS):
                yield pa.array([of(row) for row in rows.slice(at, ROWS)], pa.list_(KIND))

    return run(parts)
