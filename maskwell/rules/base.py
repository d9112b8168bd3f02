"""What a rule is, and the template language of its pattern.

One template serves two regex engines, Java's (Spark) and RE2 (the oracle SQL): %b is a boundary between ASCII word
characters and others, %s the content of a class of white space (Unicode's included), %S one such character, %L a letter
of any script. Patterns of rules that begin with a run of a class (``lead``) are anchored for Java to where a run begins,
because a search from every letter of a run takes time in its square; the first letter of a run is where the leftmost
match begins if the run has one at all, so matches are the same.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column

WHITE = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
JAVA_BOUNDARY = "(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"


def expand(template: str, boundary: str) -> str:
    for short, long in (("%b", boundary), ("%S", f"[{WHITE}]"), ("%s", WHITE), ("%L", r"\p{L}")):
        template = template.replace(short, long)
    return template


@dataclass(frozen=True)
class Rule:
    region: str
    name: str
    type: str
    confidence: float
    template: str
    domains: tuple[str, ...]
    check: Callable[[Column], Column] | None = None
    flags: str = ""  # i: ASCII letters in either case; iu: letters of any script
    lead: str = ""  # the class of the run that the pattern begins with, without letters
    first: str = ""  # with lead: what is tried first, where it begins anywhere in a run
    examples: tuple[str, ...] = field(default=())

    @property
    def detector(self) -> str:
        return f"regex:{self.region}:{self.name}"

    @property
    def java(self) -> str:
        """The pattern for Spark; with lead, matches may begin with characters of the class, which are not part of them."""
        prefix = {"": "", "i": "(?i)", "iu": "(?iu)"}[self.flags]
        body = self.template
        if self.lead:
            both = f"(?:{self.first}|{body})" if self.first else body
            body = f"(?:(?<![%L{self.lead}])|\\G)[{self.lead}]*+{both}"
            if self.first:
                body = f"{body}|(?:{self.first})"
        return prefix + expand(body, JAVA_BOUNDARY)

    @property
    def java_lead(self) -> str:
        """The pattern of what a match may begin with beyond itself."""
        return expand(f"^[{self.lead}]+", "") if self.lead else ""

    @property
    def re2(self) -> str | None:
        """The pattern for the oracle; None where RE2 lacks the means (look-around)."""
        if "(?<" in self.template or "(?=" in self.template or "(?!" in self.template:
            return None
        body = f"(?:{self.first})|(?:{self.template})" if self.first else self.template
        return ("(?i)" if self.flags else "") + expand(body, r"\b")
