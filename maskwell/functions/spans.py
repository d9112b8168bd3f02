"""Span work on arrays, as Column expressions: no shuffle, the same on batches and streams.

Offsets count code points from 0, the end is exclusive. A span's ord is its place in the input, the last tie-break.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwell.functions.selection import by_score
from maskwell.functions.windows import windows
from maskwell.rules.base import WHITE, Rule
from maskwell.rules.catalogue import ORDER

SPAN = "struct<start:int,end:int,type:string,value:string,confidence:double,detector:string,ord:int>"
TERM = "struct<low:string,type:string>"
# The characters that end a word
WORD_END = r"[.,;:!?()]+$"
BLANK = "________"
# of private use; texts that hold it are read by another way
MARK = "\ue000"


def none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def bound(value: Column, use) -> Column:
    """use(x) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")


def blank(text: Column) -> Column:
    # reads up to the first character that counts, where trimming reads them all
    return ~F.coalesce(text.rlike(f"[^{WHITE}]"), F.lit(False))


def in_blocks(xs: Column, zero: Column, kind: str, step) -> Column:
    """A fold that makes at most one element a step: step(state, x) is a struct of state and out (an element, or null for none).

    Elements are gathered in blocks of about the root of the length, so that no long array is copied for every element.
    """
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(xs)))).cast("int")
    starts = F.when(F.size(xs) > 0, F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), size)).otherwise(F.array().cast("array<int>"))

    def element(acc: Column, x: Column) -> Column:
        return bound(step(acc["state"], x), lambda y: F.struct(y["state"].alias("state"), F.when(y["out"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(y["out"]))).alias("out")))

    def block(acc: Column, at: Column) -> Column:
        done = F.aggregate(F.slice(xs, at, size), F.struct(acc["state"].alias("state"), none(kind).alias("out")), element)
        return bound(done, lambda y: F.struct(y["state"].alias("state"), F.concat(acc["out"], F.array(y["out"])).alias("out")))

    start = F.struct(zero.alias("state"), none(f"array<{kind}>").alias("out"))
    return F.aggregate(starts, start, block, lambda acc: F.flatten(acc["out"]))


def running(sizes: Column) -> Column:
    """Sums up to each element; none is null."""
    return bound(sizes, lambda xs: in_blocks(xs, F.lit(0), "int", lambda at, x: F.struct((at + x).cast("int").alias("state"), (at + x).cast("int").alias("out"))))


def ends_of(gaps: Column, hits: Column) -> Column:
    """Where matches end, from the texts before them (and one after the last) and the matches."""
    # zipped, as what stands in a fold's function is computed for every element; the last text has no match after it
    sizes = F.transform(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), lambda p: (F.length(p["gap"]) + F.length(p["hit"])).cast("int"))
    return running(F.filter(sizes, lambda n: n.isNotNull()))


def spans_of(text: Column, hits: Column, pattern: Column | str, lead, made, good) -> Column:
    """Spans of a pattern's matches: lead(hit) is the value, made(start, value) the span, good(value) keeps it."""

    def spans(x: Column) -> Column:
        placed = F.transform(F.arrays_zip(x["ends"].alias("end"), x["hits"].alias("hit")), lambda p: F.struct(p["end"].alias("end"), lead(p["hit"]).alias("value")))
        kept = placed if good is None else F.filter(placed, lambda s: good(s["value"]))
        return F.transform(kept, lambda s: made((s["end"] - F.length(s["value"])).cast("int"), s["value"]))

    return bound(F.struct(ends_of(F.split(text, pattern, -1), hits).alias("ends"), hits.alias("hits")), spans)


def spots_of(text: Column, pattern: Column) -> Column:
    """(at, hit): a pattern's matches and where they begin.

    One pass sets each match between marks, where the text has none of its own; a split at a single character needs no pattern.
    """
    spot = lambda at, hit: F.struct(at.cast("int").alias("at"), hit.alias("hit"))

    def several(pieces: Column) -> Column:
        places = lambda ends: F.transform(F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)), lambda i: spot(F.get(ends, i - 1), F.get(pieces, i)))
        return bound(running(F.transform(pieces, lambda p: F.length(p))), places)

    def between(marked: Column) -> Column:
        # text and match by turns, a text last
        return bound(F.split(marked, MARK, -1), lambda p: F.when(F.size(p) == 3, F.array(spot(F.length(F.get(p, F.lit(0))), F.get(p, F.lit(1))))).otherwise(several(p)))

    def plain(hits: Column) -> Column:
        pairs = F.arrays_zip(ends_of(F.split(text, pattern, -1), hits).alias("end"), hits.alias("hit"))
        return F.transform(pairs, lambda p: spot(p["end"] - F.length(p["hit"]), p["hit"]))

    nothing = none("struct<at:int,hit:string>")
    marked = bound(F.regexp_replace(text, pattern, F.lit(f"{MARK}$0{MARK}")), lambda m: F.when(m.contains(MARK), between(m)).otherwise(nothing))
    return F.when(text.contains(MARK), bound(F.regexp_extract_all(text, pattern, F.lit(0)), lambda h: F.when(F.size(h) > 0, plain(h)).otherwise(nothing))).otherwise(marked)


def scan_rule(text: Column, rule: Rule) -> Column:
    """All matches of a rule, left to right without overlaps; a match that its check rejects still uses up its text."""

    def made(start: Column, value: Column) -> Column:
        return F.struct(
            start.alias("start"), (start + F.length(value)).cast("int").alias("end"), F.lit(rule.type).alias("type"), value.alias("value"), F.lit(rule.confidence).cast("double").alias("confidence"),
            F.lit(rule.detector).alias("detector"), F.lit(ORDER.get(rule.detector, len(ORDER))).cast("int").alias("ord"),
        )

    lead = (lambda hit: F.regexp_replace(hit, rule.java_lead, "")) if rule.lead else (lambda hit: hit)
    hits = F.regexp_extract_all(text, F.lit(rule.java), F.lit(0))
    return bound(F.struct(text.alias("text"), hits.alias("hits")), lambda x: F.when(F.size(x["hits"]) > 0, spans_of(x["text"], x["hits"], rule.java, lead, made, rule.check)).otherwise(none(SPAN)))


def scan_windows(found: Column, rules: tuple[Rule, ...]) -> Column:
    """The spans of the rules in their windows; the pattern, and what its spans say, is looked up by the window's rule."""
    # one literal each, for the planner's sake
    table = lambda values, kind="string": F.split(F.lit("\x1e".join(map(str, values))), "\x1e", -1).cast(f"array<{kind}>")
    patterns, leads = table([r.java for r in rules]), table([r.java_lead for r in rules])
    types, confidences, detectors = table([r.type for r in rules]), table([r.confidence for r in rules], "double"), table([r.detector for r in rules])
    ords = table([ORDER.get(r.detector, len(ORDER)) for r in rules], "int")
    by_check: dict = {}
    for k, r in enumerate(rules):
        if r.check:
            by_check.setdefault(r.check, []).append(k)
    checked = [k for own in by_check.values() for k in own]

    def in_window(w: Column) -> Column:
        def good(value: Column) -> Column:
            out = F.lit(True)
            for check, own in by_check.items():
                out = F.when(w["rule"].isin(own), check(value)).otherwise(out)
            return out

        def made(start: Column, value: Column) -> Column:
            at, of = w["start"] + start, lambda column: F.get(column, w["rule"])
            return F.struct(
                at.cast("int").alias("start"), (at + F.length(value)).cast("int").alias("end"), of(types).alias("type"), value.alias("value"), of(confidences).alias("confidence"),
                of(detectors).alias("detector"), of(ords).alias("ord"),
            )

        def cut(spot: Column) -> Column:
            value = F.when(F.get(leads, w["rule"]) == "", spot["hit"]).otherwise(F.regexp_replace(spot["hit"], F.get(leads, w["rule"]), F.lit("")))
            return bound(value, lambda v: F.struct((spot["at"] + F.length(spot["hit"]) - F.length(v)).alias("start"), v.alias("value")))

        def spans(spots: Column) -> Column:
            cuts = F.transform(spots, cut)
            kept = F.when(w["rule"].isin(checked), F.filter(cuts, lambda c: good(c["value"]))).otherwise(cuts) if checked else cuts
            return F.transform(kept, lambda c: made(c["start"], c["value"]))

        return bound(spots_of(w["text"], F.get(patterns, w["rule"])), lambda x: F.when(F.size(x) > 0, spans(x)).otherwise(none(SPAN)))

    return F.flatten(F.transform(found, in_window))


def scan(text: Column, rules: tuple[Rule, ...], gated: bool = True, alone: bool = True) -> Column:
    """The spans of all rules, by the order of the rules and then by position; blank texts have none.

    gated: rules read only the windows of the text that can hold a match of theirs; else each reads the text. alone: as in
    windows(); not for many scans in one projection.
    """
    if not rules:
        return none(SPAN)
    if gated:
        return F.when(blank(text), none(SPAN)).otherwise(scan_windows(windows(text, rules, alone), rules))
    # the text is bound once: as an expression it would be computed again for every rule
    return bound(text, lambda t: F.when(blank(t), none(SPAN)).otherwise(F.flatten(F.array(*[scan_rule(t, rule) for rule in rules]))))


def numbered(spans: Column) -> Column:
    """Spans with their place as ord."""
    return F.transform(spans, lambda s, i: s.withField("ord", i.cast("int")))


def by_position(spans: Column) -> Column:
    """Start first, then the longer, the surer, and input order."""
    keyed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), (-s["confidence"]).alias("c"), i.alias("d"), s.alias("span")))
    return F.transform(F.array_sort(keyed), lambda x: x["span"])


def resolve(spans: Column) -> Column:
    """Overlap resolution, position first: keep a span if it begins where the last kept one has ended."""

    def step(at: Column, s: Column) -> Column:
        fits = s["start"] >= at
        return F.struct(F.when(fits, s["end"]).otherwise(at).alias("state"), F.when(fits, s).alias("out"))

    return bound(by_position(spans), lambda x: in_blocks(x, F.lit(0), SPAN, step))


def greedy(spans: Column, result_by_start: bool = False) -> Column:
    """Greedy selection, score first: keep a span if it overlaps none of those kept; spans is a column as once() gives it."""
    kept = by_score(spans)
    return F.array_sort(kept) if result_by_start else kept


def folded(text: Column) -> Column:
    """Lower case that keeps every offset: the one letter that would grow is mapped to one letter."""
    # few texts have it, and translating takes several times as long as lower case
    return F.when(text.contains("İ"), F.lower(F.translate(text, "İ", "i"))).otherwise(F.lower(text))


def terms(spans: Column) -> Column:
    """What a document's spans say elsewhere: whole values, and longer words of values of several words; (low, type)."""

    def own(s: Column) -> Column:
        value = trimmed(s["value"])
        term = lambda t: F.struct(folded(t).alias("low"), s["type"].alias("type"))
        whole = F.when(F.length(value) >= 3, F.array(term(value))).otherwise(none(TERM))
        cut = F.transform(F.split(value, f"[{WHITE}]+"), lambda w: F.regexp_replace(w, WORD_END, ""))
        return F.concat(whole, F.when(value.contains(" "), F.transform(F.filter(cut, lambda w: F.length(w) >= 4), term)).otherwise(none(TERM)))

    return F.flatten(F.transform(spans, own))


def once(column: Column) -> Column:
    """The same values, in a projection that the optimizer merges with no other: what it holds is computed once.

    A Python function's input has to be such a column, or one of a table: Spark doesn't extract functions whose input holds folds
    with inner variables.
    """
    return F.when(F.spark_partition_id() >= 0, column)


def to_propagate(text: Column, spans: Column) -> Column:
    """What repeated() asks for; null where there are no spans."""
    parts = lambda x: F.struct(x["text"].alias("text"), folded(x["text"]).alias("low"), x["spans"].alias("spans"), terms(x["spans"]).alias("terms"))
    return bound(F.struct(text.alias("text"), spans.alias("spans")), lambda x: F.when(F.size(x["spans"]) > 0, parts(x)))


def first_pass(text: Column, rules: tuple[Rule, ...], model: Column | None = None, gated: bool = True) -> Column:
    """The union of model and rule spans, resolved."""
    found = scan(text, rules, gated)
    return resolve(F.concat(model, found) if model is not None else found)


def values(spans: Column) -> Column:
    """Different values, in the order in which they get their numbers: from the last span back."""
    return F.array_distinct(F.transform(F.reverse(F.array_sort(spans)), lambda s: s["value"]))


def dictionary(spans: Column, mode: str = "labelled") -> Column:
    """ord, original, placeholder, entity_type (that of the value's right-most span)."""

    def entries(x: Column) -> Column:
        back = F.reverse(x)
        named = F.transform(back, lambda s: s["value"])
        label = (lambda i: F.lit(BLANK)) if mode == "blanked" else (lambda i: F.concat(F.lit("<<REDACTED_"), (i + 1).cast("string"), F.lit(">>")))
        return F.transform(
            F.array_distinct(named),
            lambda v, i: F.struct(
                (i + 1).cast("int").alias("ord"),
                v.alias("original"),
                label(i).alias("placeholder"),
                F.element_at(back, F.array_position(named, v).cast("int"))["type"].alias("entity_type"),
            ),
        )

    return bound(F.array_sort(spans), entries)


def redact(text: Column, spans: Column, entries: Column) -> Column:
    """The text with each span replaced by its value's placeholder; spans don't overlap."""

    def run(x: Column) -> Column:
        known = F.transform(x["entries"], lambda e: e["original"])
        size = F.ceil(F.sqrt(F.size(x["spans"]))).cast("int")
        state = lambda at: F.struct(at.cast("int").alias("at"), none("string").alias("out"))

        def block(acc: Column, place: Column) -> Column:
            own = F.slice(x["spans"], place, size)
            end = F.element_at(own, -1)["end"]

            def filled(y: Column) -> Column:
                def step(inner: Column, s: Column) -> Column:
                    label = F.element_at(x["entries"], F.array_position(known, s["value"]).cast("int"))["placeholder"]
                    return F.struct(s["end"].alias("at"), F.concat(inner["out"], F.array(F.substring(y["body"], inner["at"] - y["base"] + 1, s["start"] - inner["at"]), label)).alias("out"))

                done = F.aggregate(y["own"], state(y["base"]), step, lambda z: F.array_join(z["out"], ""))
                return F.struct(y["end"].alias("at"), F.concat(y["out"], F.array(done)).alias("out"))

            body = F.substring(x["text"], acc["at"] + 1, end - acc["at"])
            return bound(F.struct(own.alias("own"), end.alias("end"), body.alias("body"), acc["at"].alias("base"), acc["out"].alias("out")), filled)

        # a place in a text is found by reading up to it: once for a block of spans, and within the block's own text for each of them
        places = F.sequence(F.lit(1), F.size(x["spans"]), size)
        return F.aggregate(places, state(F.lit(0)), block, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(x["text"], acc["at"] + 1, F.length(x["text"]))))

    return F.when(F.size(spans) == 0, text).otherwise(bound(F.struct(text.alias("text"), F.array_sort(spans).alias("spans"), entries.alias("entries")), run))


def restore(text: Column, entries: Column) -> Column:
    """Every placeholder replaced by its original, the longest first, one after another; others stay.

    Of entries with one placeholder (blank mode) the last one's original is used, as a map would keep it.
    """
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda later: later["placeholder"] == e["placeholder"]))
    keyed = F.transform(last, lambda e, i: F.struct((-F.length(e["placeholder"])).alias("a"), i.alias("b"), e.alias("e")))
    return F.aggregate(F.array_sort(keyed), text, lambda acc, x: F.replace(acc, x["e"]["placeholder"], x["e"]["original"]))


def quick(pattern: str) -> str:
    """The same pattern for Java's engine, which looks for printable ASCII before it goes through the list of white space."""
    return pattern.replace(f"[^{WHITE}]", f"[!-~[^{WHITE}]]")


def tokens(text: Column, pattern: str) -> Column:
    """Matches of a token pattern with their offsets: array of (idx, word, start, end)."""
    pattern = quick(pattern)

    def run(x: Column) -> Column:
        pairs = F.arrays_zip(ends_of(F.split(x["text"], pattern, -1), x["hits"]).alias("end"), x["hits"].alias("word"))
        return F.transform(pairs, lambda p, i: F.struct(i.cast("int").alias("idx"), p["word"].alias("word"), (p["end"] - F.length(p["word"])).cast("int").alias("start"), p["end"].alias("end")))

    kind = "struct<idx:int,word:string,start:int,end:int>"
    return bound(F.struct(text.alias("text"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")), lambda x: F.when(F.size(x["hits"]) > 0, run(x)).otherwise(none(kind)))


# What a word is to the two model families
WORDS_A = r"[\p{L}\p{N}]+(?:[-_][\p{L}\p{N}]+)*|[^" + WHITE + "]"
WORDS_B = f"[^{WHITE}]+"
