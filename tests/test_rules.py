import re

import pytest
from pyspark.sql import functions as F

from maskwell.functions import checks
from maskwell.functions import spans as S
from maskwell.rules import catalogue
from maskwell.rules.examples import EXAMPLES

ACCEPTED = {
    "iban": "GB29 NWBK 6016 1331 9268 19", "luhn": "4532 0151 1283 0366", "gb_nhs": "943 476 5919", "pl_pesel": "89052310002", "pl_id_card": "ABC 523456", "pl_nip": "123-456-78-19",
    "pl_regon": "123456785", "de_steuerid": "12 345 678 903", "fr_nir": "1 85 05 78 049 013 36", "es_dni": "12345678Z", "pt_nif": "123456789", "se_personnummer": "850523-0006",
    "no_fodselsnummer": "01019912368", "it_codice_fiscale": "RSSMRA85M01H501Q", "it_partita_iva": "IT12345678903", "nl_bsn": "123456782", "be_national_register": "85.07.15-123.97",
    "at_svnr": "1237 010180", "ch_ahv": "756.1234.5678.97", "ie_pps": "1234567T", "fi_hetu": "131052-308T", "us_aba": "021000021", "us_npi": "1234567893", "us_dea": "BJ1234563",
}
FOUND = {
    "universal:email": ("write to a.b+c@mail.example.co.uk.", ["a.b+c@mail.example.co.uk"]),
    "universal:long_number": ("no 1234567890 but .123456789 not", ["1234567890"]),
    "universal:labeled_id": ("Ref: AB 123456 and 123456", ["AB 123456"]),
    "universal:currency_symbol_suffix": ("cena 1 200,50 zł, 5 złote", ["1 200,50 zł"]),
    "us:ssn": ("123-45-6789 000-12-3456 666-12-3456", ["123-45-6789"]),
    "pl:phone": ("call +48 123 456 789", ["48 123 456 789"]),
    "es:company": ("Gran Casa S.A. de", ["Gran Casa S.A"]),
    "de:street": ("wohnt Lange Straße 5a und Am Weg 7", ["wohnt Lange Straße 5a", "und Am Weg 7"]),
    "gb:company": ("(Acme Foods Ltd, Other Ltd) x Ltd", ["Acme Foods Ltd", "Other Ltd", "x Ltd"]),
    "us:company": ("Foo Bar, Inc. then Big Corp", ["Foo Bar, Inc", "then Big Corp"]),
    "be:street": ("rue Haute 12, Korte Laan 3", ["rue Haute 12", "Korte Laan 3"]),
    "us:phone": ("(212) 555-0123 or 212-555-0124", ["(212) 555-0123", "212-555-0124"]),
}


def test_catalogue_is_whole():
    assert len(catalogue.RULES) == 147
    assert sum(r.check is not None for r in catalogue.RULES) == 28
    assert len({r.detector for r in catalogue.RULES}) == 147
    assert all(0 < r.confidence <= 1 and r.domains and r.type in catalogue.TYPES for r in catalogue.RULES)
    assert sum(r.re2 is None for r in catalogue.RULES) == 4


def test_checks_accept_and_reject(spark):
    row = spark.createDataFrame([tuple(ACCEPTED.values())], list(ACCEPTED))
    assert all(row.select(*[getattr(checks, n)(F.col(n)).alias(n) for n in ACCEPTED]).first())
    changed = {n: re.sub(r"\d(?=\D*$)", lambda m: str((int(m[0]) + 1) % 10), v) for n, v in ACCEPTED.items()}
    bad = spark.createDataFrame([tuple(changed.values())], list(changed))
    assert not any(bad.select(*[getattr(checks, n)(F.col(n)).alias(n) for n in ACCEPTED]).first())


@pytest.mark.parametrize("name", FOUND)
def test_rule_finds(spark, name):
    text, values = FOUND[name]
    rows = spark.createDataFrame([(text,)], "text string").select(S.scan(F.col("text"), catalogue.named(name)).alias("s")).first()["s"]
    assert [x["value"] for x in rows] == values
    assert all(text[x["start"] : x["end"]] == x["value"] for x in rows)


def test_every_rule_finds_its_example_whole(spark):
    """The example of labeled_id needs a label before it."""
    assert len(EXAMPLES) == 147 and all(f"{r.region}:{r.name}" in EXAMPLES for r in catalogue.RULES)
    rows = [(r.detector, f"; {'Ref: ' if r.name == 'labeled_id' else ''}{x}; or", x) for r in catalogue.RULES for x in r.examples]
    table = spark.createDataFrame(rows, "detector string, text string, example string").repartition(4)
    gated = table.withColumn("spans", S.scan(F.col("text"), catalogue.RULES))
    found = gated.select("detector", "example", F.transform(F.filter("spans", lambda s: s["detector"] == F.col("detector")), lambda s: s["value"]).alias("values")).collect()
    assert {r["detector"]: (r["example"], r["values"]) for r in found if r["values"] != [r["example"]]} == {}


def test_domains():
    assert {d for r in catalogue.RULES for d in r.domains} == set(catalogue.DOMAINS)


def test_runs_take_linear_time(spark):
    text = "word and " * 40_000
    names = ("gb:company", "de:street", "be:street")
    assert spark.createDataFrame([(text,)], "text string").select(F.size(S.scan(F.col("text"), catalogue.named(*names)))).first()[0] == 0


def test_regions():
    assert {r.region for r in catalogue.select("de")} == {"universal", "de"}
    assert all("medical" in r.domains for r in catalogue.select(domains=("medical",)))
