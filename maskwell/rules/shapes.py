"""Builders of patterns that many rules share."""

from __future__ import annotations

GAP = "%S?"
DASH = "[%s-]?"
#: the country code of a phone number: a plus if there is one, or nothing at all
PLUS = r"\+?"


def groups(*sizes: int | str, by: str = GAP) -> str:
    """Groups of so many digits with what stands between them."""
    return by.join(rf"\d{{{n}}}" for n in sizes)


def word(body: str) -> str:
    return f"%b{body}%b"


def place(code: str, more: str = "") -> str:
    """A postal code and the words after it."""
    return word(f"{code}%S+%L[%L%s{more}-]+")


def phone(country: str, rest: str, trunk: bool = False) -> str:
    """A national number: its country code is optional, or else a leading zero stands for it."""
    code = rf"{PLUS}{country}{DASH}"
    return word((f"(?:{code}|0)" if trunk else f"(?:{code})?") + rest)


def amount_words(before: str, units: str, more: str = "") -> str:
    """A phrase, a run of words, and a unit of money."""
    return f"(?:{before})[%L%s{more}-]+(?:{units})%b"


def named_street(kinds: str, number: str = r"\d+%L?", more: str = "") -> str:
    """A name that ends with a kind of street, and a house number; begins with a run of letters."""
    return f"%L[%L%s{more}-]*(?:{kinds})%S+{number}"


def company(forms: str, more: str = "&.'", comma: bool = False, end: str = "%b", space: bool = True) -> str:
    """A run of words and a legal form; begins with a run of letters."""
    between = ("(?:,?%S+)?" if comma else "(?:%S+)?") if space else ""
    return f"%L[%L%s{more}]+{between}(?:{forms}){end}"
