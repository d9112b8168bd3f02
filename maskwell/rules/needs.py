"""What a rule's matches are made of, derived from its pattern, and the windows of a text that can hold one.

A match is a run of characters that the pattern can take. So it lies within one maximal run of such characters, and it holds
as many of each kind, and one of the literals, as every way through the pattern asks for. The runs that do are the rule's
windows, each with one more character on both sides for what the pattern sees there; no match is outside of them, and no
match of one touches another, so scanning the windows and scanning the text find the same.

One pass over a text classifies its characters and finds literals by an automaton over those of all rules. Of the runs that are
left, a rule reads those that hold its outlines: parts of its pattern between repeats without an end, as patterns of bounded length.
"""

from __future__ import annotations

import functools
import re
import re._constants as op
import re._parser as parser
import sys
from dataclasses import dataclass, replace
from itertools import product

import ahocorasick
import numpy as np

from maskwell.rules.base import WHITE, Rule

LETTER_SIGN, WHITE_SIGN = "", ""  # stand for classes in parsed patterns
LETTER, DIGIT, SPACE = 1, 2, 3
MOST = 400  # strings of a literal's alternatives


@dataclass(frozen=True)
class Needs:
    """takes: the classes of characters that matches consist of, None for any; counts: (classes, least number) pairs; literals:
    one of these strings, folded if ``folded``; empty where there is no such demand; gram: classes of characters that stand side by
    side; outlines: patterns each of which is found; head: the one that a match begins with, if there is one."""

    takes: frozenset[int] | None
    counts: tuple[tuple[frozenset[int], int], ...]
    literals: frozenset[str]
    folded: bool
    gram: tuple[frozenset[int], ...] = ()
    outlines: tuple[str, ...] = ()
    head: str = ""


def fold(c: str) -> str:
    """One character for all that differ by case, as the regex engine compares them."""
    up = c.upper()
    low = (up if len(up) == 1 else c).lower()
    return low if len(low) == 1 else {"İ": "i"}.get(c, c)


def _white() -> list[int]:
    """The code points of WHITE."""
    items = parser.parse("[" + re.sub(r"\\x\{(\w+)\}", r"\\u\1", WHITE) + "]")[0][1]
    return [c for kind, value in items for c in (range(value[0], value[1] + 1) if kind is op.RANGE else [value])]


WHITE_CODES = _white()
WHITE_SET = frozenset(WHITE_CODES) | {ord(WHITE_SIGN)}
EVERY = np.arange(sys.maxunicode + 1, dtype=np.uint32).view("<U1")


class Alphabet:
    """Classes of code points: letters, digits, white space, and one for each other character that rules name; 0 for the rest."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.table = np.zeros(sys.maxunicode + 1, np.uint8)
        self.table[np.strings.isalpha(EVERY)] = LETTER
        self.table[[*range(48, 58)]] = DIGIT
        self.table[WHITE_CODES] = SPACE
        self.known = 4
        for rule in rules:
            for c in rule.template + rule.first + rule.lead:
                if self.table[ord(c)] == 0 and ord(c) >= 32:
                    self.table[ord(c)] = self.known
                    self.known += 1

    def of(self, code: int) -> int:
        return {LETTER_SIGN: LETTER, WHITE_SIGN: SPACE}.get(chr(code)) or int(self.table[code])


def tree(template: str):
    """A template as the standard library parses it."""
    for short, long in (("%b", r"\b"), ("%S", WHITE_SIGN), ("%s", WHITE_SIGN), ("%L", LETTER_SIGN), (r"\z", r"\Z")):
        template = template.replace(short, long)
    return parser.parse(template)


@dataclass(frozen=True)
class Way:
    """Demands of a part of a pattern: least numbers by set of classes; all its strings, if they are few; strings one of which it
    begins with; strings one of which it holds, if there is such a set."""

    counts: dict
    whole: frozenset[str] | None
    lead: frozenset[str]
    literals: frozenset[str] | None


class Walk:
    """Demands of a parsed pattern."""

    def __init__(self, alphabet: Alphabet, folded: bool):
        self.alphabet, self.folded = alphabet, folded
        self.takes: set[int] = set()
        self.any = False

    def one(self, kind, value) -> tuple[frozenset[int] | None, frozenset[str] | None]:
        """(classes, characters if they are few) of a pattern of one character."""
        if kind is op.LITERAL:
            classes = frozenset([self.alphabet.of(value)])
            if chr(value) == LETTER_SIGN:
                return classes, None
            # in what the automaton reads, all white space is a space
            return classes, frozenset([" " if classes == {SPACE} else fold(chr(value)) if self.folded else chr(value)])
        if kind is op.CATEGORY:
            classes = {op.CATEGORY_DIGIT: [DIGIT], op.CATEGORY_WORD: [DIGIT, LETTER, self.alphabet.of(95)]}.get(value)
            return (frozenset(classes), None) if classes else (None, None)
        if kind is op.RANGE:
            spread = range(value[0], value[1] + 1)
            return frozenset(self.alphabet.of(c) for c in spread), None
        if kind is op.IN:
            parts = [(None, None) if k is op.NEGATE else self.one(k, v) for k, v in value]
            if any(p[0] is None for p in parts):
                return None, None
            few = None if any(p[1] is None for p in parts) or len(parts) > 4 else frozenset().union(*[p[1] for p in parts])
            return frozenset().union(*[p[0] for p in parts]), few
        return None, None

    def sequence(self, items) -> Way:
        counts: dict = {}
        best: list[frozenset[str]] = []
        run, lead = frozenset([""]), None
        for kind, value in items:
            way = self.node(kind, value)
            for k, n in way.counts.items():
                counts[k] = counts.get(k, 0) + n
            if way.literals:
                best.append(way.literals)
            if way.whole is not None and len(run) * len(way.whole) <= MOST:
                run = frozenset(a + b for a, b in product(run, way.whole))
                continue
            start = way.whole if way.whole is not None else way.lead
            run = frozenset(a + b for a, b in product(run, start)) if len(run) * len(start) <= MOST else run
            best.append(run)
            lead = run if lead is None else lead
            run = frozenset([""])
        best.append(run)
        good = [x for x in best if min(map(len, x)) >= 2]
        return Way(counts, run if lead is None else None, run if lead is None else lead, max(good, key=lambda x: (min(map(len, x)), -len(x)), default=None))

    def either(self, ways: list[Way]) -> Way:
        sets = set().union(*[w.counts for w in ways])
        counts = {k: n for k in sets if (n := min(sum(m for x, m in w.counts.items() if x <= k) for w in ways))}
        whole = None if any(w.whole is None for w in ways) else frozenset().union(*[w.whole for w in ways])
        lead = frozenset().union(*[w.lead for w in ways])
        return Way(counts, whole, lead if len(lead) <= MOST else frozenset([""]), None if any(w.literals is None for w in ways) else frozenset().union(*[w.literals for w in ways]))

    def node(self, kind, value) -> Way:
        nothing = Way({}, frozenset([""]), frozenset([""]), None)
        if kind in (op.LITERAL, op.IN, op.NOT_LITERAL, op.ANY):
            classes, few = self.one(kind, value)
            if classes is None or 0 in classes:
                self.any = True
                return Way({}, None, frozenset([""]), None)
            self.takes |= classes
            return Way({classes: 1}, few, few or frozenset([""]), None)
        if kind is op.AT:
            return nothing
        if kind in (op.ASSERT, op.ASSERT_NOT):
            # what is seen beyond the match lies in the window if it could be taken; a single character always does
            if value[1].getwidth()[1] > 1:
                self.sequence(value[1])
            return nothing
        if kind is op.SUBPATTERN:
            return self.sequence(value[3])
        if kind is op.BRANCH:
            return self.either([self.sequence(way) for way in value[1]])
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, inner = value
            way = self.sequence(inner)
            whole = None
            if way.whole is not None and most <= 2:
                whole = frozenset().union(*[frozenset("".join(p) for p in product(way.whole, repeat=n)) for n in range(least, int(most) + 1)])
            counts = {k: n * least for k, n in way.counts.items() if least}
            return Way(counts, whole if whole and len(whole) <= MOST else None, way.lead if least else frozenset([""]), way.literals if least else None)
        self.any = True
        return Way({}, None, frozenset([""]), None)


class Outline:
    """Parts of a parsed pattern as patterns of bounded length for Python's engine, over texts whose white space is all blanks and
    that are folded for a rule that folds. Each is found in every match: what a part can't say (look-around, negated sets) is any
    character or nothing."""

    BOUNDARY = "(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
    LETTER = r"[^\W\d_]"

    def __init__(self, folded: bool):
        self.folded = folded

    def characters(self, codes) -> str:
        own = {" " if c in WHITE_SET else fold(chr(c)) if self.folded else chr(c) for c in codes}
        return "[" + "".join(re.escape(c) for c in sorted(own)) + "]"

    def one(self, kind, value) -> str:
        """A pattern of one character."""
        if kind is op.LITERAL:
            return {LETTER_SIGN: self.LETTER, WHITE_SIGN: " "}.get(chr(value)) or self.characters([value])
        if kind is op.CATEGORY and value in (op.CATEGORY_DIGIT, op.CATEGORY_WORD):
            return "[0-9]" if value is op.CATEGORY_DIGIT else "[0-9a-z_]" if self.folded else "[0-9A-Za-z_]"
        if kind is op.RANGE and value[1] - value[0] < 256:
            return self.characters(range(value[0], value[1] + 1))
        if kind is op.IN and all(k is not op.NEGATE for k, _ in value):
            plain = [v for k, v in value if k is op.LITERAL and chr(v) not in (LETTER_SIGN, WHITE_SIGN)]
            rest = [self.one(k, v) for k, v in value if not (k is op.LITERAL and v in plain)]
            parts = [*([self.characters(plain)] if plain else []), *dict.fromkeys(rest)]
            return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
        return "."

    def whole(self, items) -> tuple[str, int] | None:
        """(pattern, least length) of a sequence, None where it has no longest match."""
        out, least = [], 0
        for kind, value in items:
            if kind is op.AT:
                out.append(self.BOUNDARY if value is op.AT_BOUNDARY else "")
            elif kind in (op.ASSERT, op.ASSERT_NOT):
                pass
            elif kind is op.SUBPATTERN or kind is op.BRANCH:
                ways = [self.whole(way) for way in (value[1] if kind is op.BRANCH else [value[3]])]
                if None in ways:
                    return None
                out.append(f"(?:{'|'.join(w[0] for w in ways)})")
                least += min(w[1] for w in ways)
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
                way = self.whole(value[2])
                if way is None or value[1] is op.MAXREPEAT or value[1] > 40:
                    return None
                out.append(f"(?:{way[0]}){{{value[0]},{value[1]}}}")
                least += value[0] * way[1]
            elif kind in (op.LITERAL, op.IN, op.NOT_LITERAL, op.ANY):
                out.append(self.one(kind, value))
                least += 1
            else:
                return None
        return "".join(out), least

    def parts(self, items) -> list[tuple[str, int]]:
        """The parts of a sequence; a repeat without an end gives its least number to the parts on both sides."""
        done, own, least = [], "", 0
        for kind, value in items:
            if kind is op.ASSERT and value[0] < 0:
                # what is seen before a place is followed by what is taken there
                done.append((own, least))
                own, least = self.whole(value[1]) or ("", 0)
                continue
            if (way := self.whole([(kind, value)])) is not None:
                own, least = own + way[0], least + way[1]
                continue
            edge = self.whole(value[2]) if kind in (op.MAX_REPEAT, op.MIN_REPEAT) else None
            edge = (f"(?:{edge[0]}){{{value[0]}}}", value[0] * edge[1]) if edge and value[0] <= 40 else ("", 0)
            done.append((own + edge[0], least + edge[1]))
            if kind is op.SUBPATTERN:
                done += self.parts(value[3])
            own, least = edge
        return [*done, (own, least)]

    def head(self, template: str) -> str:
        """The part that a match begins with; none where a match depends on more than one character before it."""
        items = tree(template)
        behind = any(kind in (op.ASSERT, op.ASSERT_NOT) and value[0] < 0 and value[1].getwidth()[1] > 1 for kind, value in items)
        part, least = self.parts(items)[0]
        return part if least and not behind else ""

    def of(self, templates: list[str]) -> tuple[str, ...]:
        """The longest parts of a template; of several templates, one part of any."""
        best = [sorted((x for x in self.parts(tree(t)) if x[1]), key=lambda x: -x[1]) for t in templates]
        if not all(best):
            return ()
        return tuple(x[0] for x in best[0][:3]) if len(best) == 1 else ("|".join(f"(?:{x[0][0]})" for x in best),)


def side_by_side(walk: Walk, items) -> list[frozenset[int] | None]:
    """The classes of a sequence's characters one after another; None where others may stand between."""
    out: list[frozenset[int] | None] = []
    for kind, value in items:
        if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            continue
        if kind in (op.LITERAL, op.IN):
            classes = walk.one(kind, value)[0]
            out.append(None if classes is None or 0 in classes else classes)
        elif kind is op.SUBPATTERN:
            out += side_by_side(walk, value[3])
        elif kind is op.BRANCH:
            ways = [side_by_side(walk, way) for way in value[1]]
            same = min(map(len, ways))
            merge = lambda column: None if None in column else frozenset().union(*column)
            if all(len(w) == same for w in ways):
                out += [merge(c) for c in zip(*ways, strict=True)]
            else:
                out += [*(merge(c) for c in zip(*[w[:same] for w in ways], strict=True)), None, *(merge(c) for c in zip(*[w[len(w) - same :] for w in ways], strict=True))]
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] <= 40:
            own = side_by_side(walk, value[2]) * value[0]
            out += own if value[0] == value[1] else [*own, None, *own]
        else:
            out.append(None)
    return out


def gram(walk: Walk, template: str) -> tuple[frozenset[int], ...]:
    """The run of classes that is rarest in prose; empty if none is rare."""
    weight = lambda c: 0.3 if LETTER in c else 2 if DIGIT in c else 1 if c == {SPACE} else 3
    runs: list[list[frozenset[int]]] = [[]]
    for c in side_by_side(walk, tree(template)):
        runs.append([]) if c is None else runs[-1].append(c)
    best = max(runs, key=lambda r: sum(map(weight, r)))
    return tuple(best) if sum(map(weight, best)) >= 3 else ()


def needs(rule: Rule, alphabet: Alphabet) -> Needs:
    walk = Walk(alphabet, bool(rule.flags))
    way = walk.either([walk.sequence(tree(t)) for t in (rule.template, rule.first) if t])
    walk.takes |= {alphabet.of(ord(c)) for c in rule.lead.replace("%s", WHITE_SIGN)}
    # sets with letters say little about prose
    sharp = tuple(sorted(((k, n) for k, n in way.counts.items() if LETTER not in k and k != {SPACE}), key=lambda x: (sorted(x[0]), x[1])))
    literals = way.literals if way.literals and not any(DIGIT in k for k, _ in sharp) else frozenset()
    own = gram(walk, rule.template) if not literals and not rule.first else ()
    outlines = Outline(bool(rule.flags)).of([t for t in (rule.template, rule.first) if t])
    # matches of rules with lead begin before what is kept of them
    head = "" if rule.lead or rule.first else Outline(bool(rule.flags)).head(rule.template)
    return Needs(None if walk.any else frozenset(walk.takes), sharp, literals, bool(rule.flags), own, outlines, head if head in outlines else "")


class Gate:
    """Windows of many rules at once; kept by a worker process."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.alphabet = Alphabet(rules)
        self.needs = [needs(r, self.alphabet) for r in rules]
        self.lower = np.arange(sys.maxunicode + 1, dtype=np.uint32)
        for c in np.flatnonzero(np.strings.isalpha(EVERY)).tolist():
            self.lower[c] = ord(fold(chr(c)))
        # rules of one demand share their windows, and demands on the same characters share their runs
        self.by_takes: dict = {}
        for k, need in enumerate(self.needs):
            self.by_takes.setdefault(need.takes, {}).setdefault(replace(need, outlines=(), head=""), {}).setdefault((need.outlines, need.head), []).append(k)
        self.outlines = {x: re.compile(x, re.DOTALL) for need in self.needs for x in need.outlines}
        # where one of these stands for an ASCII letter, a boundary of the folded text is none of the text
        self.odd = re.compile("[" + "".join(re.escape(chr(c)) for c in np.flatnonzero(self.lower < 128).tolist() if c >= 128) + "]")
        self.literal_sets: dict[tuple, int] = {}
        self.automata = []
        for folded in (False, True):
            owners: dict[str, list[int]] = {}
            for need in self.needs:
                if need.literals and need.folded == folded:
                    number = self.literal_sets.setdefault((need.literals, folded), len(self.literal_sets))
                    for s in need.literals:
                        if number not in owners.setdefault(s, []):
                            owners[s].append(number)
            automaton = ahocorasick.Automaton()
            for s, numbers in owners.items():
                automaton.add_word(s, (len(s), numbers))
            if owners:
                automaton.make_automaton()
            self.automata.append(automaton if owners else None)

    def literal_places(self, texts: list[str]) -> list[np.ndarray]:
        """For each set of literals, where one begins."""
        places: list[list[int]] = [[] for _ in self.literal_sets]
        for text, automaton in zip(texts, self.automata, strict=True):
            if automaton is not None:
                for end, (size, numbers) in automaton.iter(text):
                    for number in numbers:
                        places[number].append(end + 1 - size)
        return [np.array(sorted(x), np.int64) for x in places]

    def windows(self, body: str, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """text, rule, begin, end of the windows in texts that stand one after another with one NUL between; by text, rule, begin."""
        codes = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.alphabet.table[codes]
        raw = kinds.tobytes()
        present = np.bincount(kinds, minlength=256) > 0
        plain = np.where(kinds == SPACE, np.uint32(32), codes)
        texts = [x.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass") for x in (plain, self.lower[plain])]
        literal = self.literal_places(texts)
        odd = bool(self.odd.search(body))
        where: dict = {}
        masks: dict = {}

        def mask(classes: frozenset[int]) -> np.ndarray:
            if classes not in masks:
                member = bytearray(256)
                for c in classes:
                    member[c] = 1
                masks[classes] = np.frombuffer(raw.translate(bytes(member)), bool)
            return masks[classes]

        def places_of(key) -> np.ndarray:
            """Where a character of some classes stands, or characters of several one after another."""
            if key not in where:
                size = max(len(kinds) - len(key) + 1, 0) if isinstance(key, tuple) else len(kinds)
                own = np.ones(size, bool)
                for k, classes in enumerate(key if isinstance(key, tuple) else [key]):
                    own &= mask(classes)[k : k + size]
                where[key] = np.flatnonzero(own)
            return where[key]

        def holding(breaks: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
            """Numbers of the runs, each by the break after it, that hold n of some places."""
            if len(at) > len(breaks):
                return np.flatnonzero(np.diff(np.searchsorted(at, breaks)) >= n) + 1
            run, times = np.unique(np.searchsorted(breaks, at), return_counts=True)
            return run[times >= n]

        found: list[tuple[np.ndarray, np.ndarray, list[int]]] = []
        for takes, demands in self.by_takes.items():
            asked = [need for need in demands if all(any(present[c] for c in k) for k, _ in need.counts) and (not need.literals or len(literal[self.literal_sets[need.literals, need.folded]]))]
            asked = [need for need in asked if not need.gram or len(places_of(need.gram))]
            if not asked:
                continue
            if takes is None:
                breaks = np.append(edges[1:] - 1, len(codes))
                breaks = np.unique(np.concatenate([edges[:-1] - 1, breaks]))
            else:
                breaks = np.concatenate([[-1], np.flatnonzero(~mask(takes)), [len(codes)]])
            for need in asked:
                good = None
                # a gram says more than counts, which the outlines ask for too
                places = [(places_of(need.gram), 1)] if need.gram else [(places_of(k), n) for k, n in need.counts]
                if need.literals:
                    places.append((literal[self.literal_sets[need.literals, need.folded]], 1))
                for at, n in places:
                    own = holding(breaks, at, n)
                    good = own if good is None else np.intersect1d(good, own, assume_unique=True)
                if good is None:
                    good = np.flatnonzero(np.diff(breaks) > 1) + 1
                good = good[(good > 0) & (good < len(breaks))]
                begin, end = breaks[good - 1] + 1, breaks[good]
                # one more character on both sides, of the same text
                text = np.searchsorted(edges, begin, "right") - 1
                begin, end = np.maximum(begin - 1, edges[text]), np.minimum(end + 1, edges[text + 1] - 1)
                odds = odd and need.folded
                text = texts[need.folded]
                for (outlines, head), own in demands[need].items():
                    pairs = list(zip(begin.tolist(), end.tolist(), strict=True))
                    # the head last, as what comes before it and the character that it sees is left out
                    for outline in sorted(outlines, key=lambda x: x == head):
                        search = self.outlines[outline].search
                        if outline == head:
                            own_odd = {a for a, b in pairs if self.odd.search(body, a, b)} if odds else ()
                            hits = [(a, b, None if a in own_odd else search(text, a, b)) for a, b in pairs]
                            pairs = [(max(a, hit.start() - 1) if hit else a, b) for a, b, hit in hits if hit or a in own_odd]
                        else:
                            pairs = [(a, b) for a, b in pairs if search(text, a, b) or (odds and self.odd.search(body, a, b))]
                    both = np.array(pairs, np.int64).reshape(-1, 2)
                    found.append((both[:, 0], both[:, 1], own))
        begin = np.concatenate([np.tile(b, len(k)) for b, _, k in found] or [np.zeros(0, np.int64)])
        end = np.concatenate([np.tile(e, len(k)) for _, e, k in found] or [np.zeros(0, np.int64)])
        rule = np.concatenate([np.repeat(k, len(b)) for b, _, k in found] or [np.zeros(0, np.int64)]).astype(np.int64)
        text = np.searchsorted(edges, begin, "right") - 1
        order = np.lexsort((begin, rule, text))
        return text[order], rule[order], begin[order], end[order]


@functools.cache
def gate(rules: tuple[Rule, ...]) -> Gate:
    return Gate(rules)
