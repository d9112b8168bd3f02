import re

import duckdb
import pytest

from maskwell.plans import catalogue, sql
from maskwell.rules import catalogue as rules
from maskwell.rules.base import JAVA_BOUNDARY, WHITE

# values that none of the rules of the small queries find
PLANTED = {
    "iban": "GB29 NWBK 6016 1331 9268 19", "ssn": "123-45-6789", "pesel": "89052310002", "dni": "12345678Z", "street": "Lange Straße 5a", "company": "Acme Foods Ltd",
    "currency": "1 200,50 zł", "labelled": "AB 123456", "number": "1234567890",
}
TEXTS = [
    (1, "en", "Pay GB29 NWBK 6016 1331 9268 19, SSN 123-45-6789; write to a.b@mail.example.co.uk. (Acme Foods Ltd) on 12 March 2024"),
    (2, "de", "Herr Berger wohnt: Lange Straße 5a, Steuer 12 345 678 903; cena 1 200,50 zł"),
    (3, "es", "El DNI es 12345678Z y 10.0.0.1; tel. +34 612 345 678, casa."),
    (4, None, "pesel 89052310002, Ref: AB 123456 and no 1234567890 but .123456789 not"),
    (5, "fr", "la rue Haute 12, et (212) 555-0123; 1 85 05 78 049 013 36"),
    (8, "en", "Acme Foods Ltd wrote; ACME paid, Foods (acme) came. Acmes stay; card 4532 0151 1283 0366 ends 0366, not 10366."),
    (6, "en", " \n"),
    (7, "en", None),
]


LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"


def around(text, rule):
    """Matches of a rule with look-around, by Python's engine; what lies behind may have any length."""
    pattern = rule.template.replace(r"\z", r"\Z")
    white = re.sub(r"\\x\{(\w{4})\}", r"\\u\1", WHITE)
    for short, long in (("[%L%s]", f"[{LETTERS}{white}]"), ("%b", JAVA_BOUNDARY), ("%S", f"[{white}]"), ("%s", white), ("%L", f"[{LETTERS}]")):
        pattern = pattern.replace(short, long)
    behind = ""
    if rule.name == "labeled_id":
        behind, pattern = re.fullmatch(r"\(\?<=(.*?)\)(\[A-Z0-9.*)", pattern, re.DOTALL).groups()
    body, before = re.compile(pattern, re.IGNORECASE if rule.flags else 0), re.compile(f"(?:{behind})\\Z")
    out, at = [], 0
    while at < len(text):
        m = body.match(text, at)
        if m and before.search(text[:at]):
            out.append((at, m.end(), m[0]))
        at = max(at + 1, out[-1][1] if out else 0)
    return out


def brute(which, table="documents", key="doc_id", text="text", rows=TEXTS):
    """(key, order, start, end, value, confidence, detector) of all matches: RE2 by DuckDB, look-around by Python."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE {table} ({key} BIGINT, lang VARCHAR, {text} VARCHAR)")
    con.executemany(f"INSERT INTO {table} VALUES (?, ?, ?)", rows)
    found = sql.scan(f"SELECT {key}, coalesce({text}, '') AS text FROM {table}", tuple(r for r in which if r.re2), key)
    out = con.sql(f"SELECT {key}, ord, s, e, value, confidence, detector FROM ({found})").fetchall()
    for rule in (r for r in which if not r.re2):
        assert rule.check is None
        out += [(k, rules.ORDER[rule.detector], a, b, v, rule.confidence, rule.detector) for k, _, body in rows for a, b, v in around(body or "", rule)]
    return out


def resolved(found):
    kept = []
    for s in sorted(found, key=lambda s: (s[2], -s[3], -s[5], s[1])):
        if not kept or s[2] >= kept[-1][3]:
            kept.append(s)
    return kept


def propagated(text, spans):
    """Resolved spans and what they lead to elsewhere, resolved again."""
    white = re.sub(r"\\x\{(\w{4})\}", r"\\u\1", WHITE)
    edge = lambda p: not 0 <= p < len(text) or re.match(f"[{white}" + r".,;:!?()\"'„\-–—/]", text[p])
    terms, places = {}, {}
    for s in spans:
        value = s[4].strip()
        words = [re.sub(r"[.,;:!?()]+$", "", w) for w in re.split(f"[{white}]+", value)] if " " in value else []
        for term in [value] * (len(value) >= 3) + [w for w in words if len(w) >= 4]:
            terms.setdefault(term.lower(), None)
    for t in terms:
        for p in range(len(text) - len(t) + 1):
            if text.lower().startswith(t, p) and edge(p - 1) and edge(p + len(t)) and all((s[2], s[3]) != (p, p + len(t)) for s in spans):
                places.setdefault((p, p + len(t)), None)
    new = [(None, None, a, b, text[a:b], 0.95, "propagated") for a, b in places]
    return resolved([(s[0], i, *s[2:]) for i, s in enumerate([*spans, *new])])


def rewritten(text, spans):
    numbers = {}
    for s in reversed(spans):
        numbers.setdefault(s[1], len(numbers) + 1)
    out = text
    for a, value, b in reversed(spans):
        out = out[:a] + f"<<REDACTED_{numbers[value]}>>" + out[b:]
    return out


@pytest.fixture(scope="module")
def found():
    return brute(rules.RULES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole"))
    docs = spark.createDataFrame(TEXTS, "doc_id long, lang string, text string")
    docs.write.parquet(f"{at}/documents.parquet")
    docs.selectExpr("doc_id AS page_id", "concat('<p>', text, '</p>') AS html").write.parquet(f"{at}/pages.parquet")
    return at


def test_documents_are_redacted_by_all_rules(spark, folder, found):
    got = {r["doc_id"]: r for r in catalogue.queries()["redact_by_catalogue"](spark, folder).collect()}
    for k, _, text in TEXTS:
        spans = [(s[2], s[4], s[3]) for s in propagated(text or "", resolved([s for s in found if s[0] == k]))]
        assert (got[k]["n_spans"], got[k]["redacted"]) == (len(spans), rewritten(text or "", spans))
    clear = " ".join(r["redacted"] for r in got.values())
    assert not [n for n, v in PLANTED.items() if v in clear]
    assert not re.search(r"(?i)\bacme\b|\bfoods\b|\b0366\b", clear) and "Acmes stay" in clear


TWO_PASS = ["redact", "blank", "dictionary", "round_trip", "responses", "spans_per_type", "summary"]


@pytest.mark.parametrize("name", TWO_PASS)
def test_two_passes_equal_their_oracle(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    df = catalogue.queries()[f"two_pass_{name}"](spark, folder)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    rel = con.sql(catalogue.oracle_sql()[f"two_pass_{name}"])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
    if name == "redact":
        assert any("ends <<REDACTED_2>>, not <<REDACTED_1>>." in str(r) for r in got)


def test_pages_are_scanned_by_all_rules(spark, folder):
    got = sorted((r["page_id"], r["detector"], r["start"], r["end"], r["value"]) for r in catalogue.queries()["scan_pages_by_catalogue"](spark, folder).collect())
    rows = [(k, None, None if text is None else f"<p>{text}</p>") for k, _, text in TEXTS]
    assert got == sorted((s[0], s[6], s[2], s[3], s[4]) for s in brute(rules.RULES, "pages", "page_id", "html", rows))


def test_every_language_has_its_regions(spark, folder, found):
    assert set(catalogue.LANGUAGES) == set(rules.REGIONS)
    got = sorted((r["doc_id"], r["detector"], r["start"]) for r in catalogue.queries()["region_by_language_by_catalogue"](spark, folder).collect())
    lang = {k: x for k, x, _ in TEXTS}
    regions = {"en": {"gb", "ie", "us"}, "de": {"de", "at", "ch", "be"}, "es": {"es", "us"}, "fr": {"fr", "be", "ch"}, None: set(rules.REGIONS)}
    assert got == sorted((s[0], s[6], s[2]) for s in found if s[6].split(":")[1] in {"universal", *regions[lang[s[0]]]})
