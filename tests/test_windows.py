import random
import time

import pytest
from pyspark.sql import functions as F

from maskwell.functions import spans as S
from maskwell.functions.propagation import repeats
from maskwell.functions.selection import disjoint
from maskwell.operators import corpus, decode, segments
from maskwell.rules import catalogue
from maskwell.rules.needs import gate

# what the rules' literals, digits and separators are made of, so that many windows begin, end and touch
PARTS = [
    "12", "1234", "00", "AB", "C", "x", "Ltd", "GmbH", "Sp. z o.o.", "S.L.", "Calle", "straße ", "STRASSE", "Road", "via ", "rue", "euros", "pounds", "in the amount of ", "słownie: ", "somme de ", "Ref: ", "@", "a.b", ".com",
    ":", "-", "/", ".", ",", " ", " ", " ", "\n", " ", "$", "€", "zł", "(", ")", "+", "'", "&", "é", "ß", "İ", "ſ", "K", "😀", "May ", "USD", "_", "\0", "º",
]


def noise(n, seed):
    rng = random.Random(seed)
    return [(k, "".join(rng.choices(PARTS, k=rng.choice([1, 5, 40, 120])))) for k in range(n)] + [(9000, None), (9001, ""), (9002, " \n"), (9003, "1"), (9004, "Acme Ltd")]


def found(docs, rules, gated):
    return {r["k"]: [tuple(s) for s in r["s"]] for r in docs.select("k", S.scan(F.col("text"), rules, gated).alias("s")).collect()}


def test_windows_lose_and_add_no_match(spark):
    docs = spark.createDataFrame(noise(500, 1), "k int, text string").repartition(4)
    got = found(docs, catalogue.RULES, True)
    assert sum(map(len, got.values())) > 500
    # by turns, as the plain way plans a fold for every rule
    for part in range(0, len(catalogue.RULES), 49):
        own = catalogue.RULES[part : part + 49]
        names = {r.detector for r in own}
        assert {k: [s for s in v if s[5] in names] for k, v in got.items()} == found(docs, own, False)


@pytest.mark.parametrize("name", ["email", "iban", "ipv4", "date_iso"])
def test_prose_has_no_windows(name):
    rules = catalogue.named(f"universal:{name}")
    body = "plain words without figures, and more of them. " * 10 + "\0"
    assert not len(gate(rules).windows(body, __import__("numpy").array([0, len(body)]))[0])


def test_demands_are_derived_from_patterns():
    g = gate(catalogue.RULES)
    by_name = dict(zip([r.detector for r in catalogue.RULES], g.needs, strict=True))
    assert {n for _, n in by_name["regex:universal:credit_card"].counts} == {13}
    assert by_name["regex:gb:company"].literals >= {"Ltd", "PLC", "LLP"}
    assert all(n.counts or n.literals for n in by_name.values())


def test_many_hits_in_one_text_take_linear_time(spark):
    text = " ".join(f"10.{k % 256}.{k // 256 % 256}.7," for k in range(40_000))
    docs = spark.createDataFrame([(1, text)], "k int, text string")
    begin = time.time()
    got = found(docs, catalogue.named("universal:ipv4"), True)[1]
    assert len(got) == 40_000 and all(text[s[0] : s[1]] == s[3] for s in got[::997]) and time.time() - begin < 40


def test_resolution_of_many_spans(spark):
    text = "ab " * 30_000
    spans = [(3 * k, 3 * k + 2, "OTHER", "ab", 0.9, "d", k) for k in range(30_000)] + [(0, 5, "OTHER", "ab ab", 0.9, "d", 30_000)]
    df = spark.createDataFrame([(text, spans)], f"text string, spans array<{S.SPAN}>")
    begin = time.time()
    assert df.select(F.size(S.resolve(F.col("spans"))).alias("n")).first()["n"] == 29_999 and time.time() - begin < 30


def test_propagation_of_many_terms_takes_linear_time():
    text = " ".join(f"name{k}" for k in range(20_000)) * 2
    terms = [{"low": f"name{k}", "type": "PERSON"} for k in range(20_000)]
    begin = time.time()
    got = repeats(text, text, set(), terms)
    assert len(got) == 39_998 and time.time() - begin < 10


def test_first_term_wins_in_folded_case():
    terms = [{"low": "anna", "type": "PERSON"}, {"low": "anna", "type": "OTHER"}, {"low": "anna b", "type": "COMPANY"}]
    got = repeats("Anna B, anna x-ANNA annas", "anna b, anna x-anna annas", {(8, 12)}, terms)
    assert [(a, b, kind, value) for a, b, kind, value, *_ in got] == [(0, 4, "PERSON", "Anna"), (15, 19, "PERSON", "ANNA"), (0, 6, "COMPANY", "Anna B")]


def test_propagated_spans_survive(spark):
    text = "Acme Foods Ltd wrote; ACME paid. Foods (acme) came, acmes stay."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rules = catalogue.named("gb:company")
    both, one = (corpus.detected(docs, rules, propagated=p).first()["spans"] for p in (True, False))
    assert [s["value"] for s in one] == ["Acme Foods Ltd"]
    assert [(s["value"], s["detector"]) for s in both[1:]] == [("ACME", "propagated"), ("Foods", "propagated"), ("acme", "propagated")]


def plain_greedy(spans):
    kept = []
    for k in sorted(range(len(spans)), key=lambda k: (-spans[k][2], k)):
        a, b, _ = spans[k]
        if all(not (a < y and b > x) for x, y, _ in (spans[j] for j in kept)):
            kept.append(k)
    return kept


def test_greedy_equals_the_fold():
    rng = random.Random(3)
    for n in (0, 1, 30, 300, 2_000):
        spans = [(a := rng.randrange(4 * n + 1), a + rng.choice([0, 1, 3, 10, n // 10]), rng.choice([0.5, 0.7, 0.9])) for _ in range(n)]
        assert disjoint(*map(list, zip(*spans, strict=True))) == plain_greedy(spans) if n else True
    many = [(k, k + 7, (k * 7919 % 1000) / 1000) for k in range(20_000)]
    begin = time.time()
    disjoint(*map(list, zip(*many, strict=True)))
    assert time.time() - begin < 5


def test_words_of_a_long_text(spark):
    text = "".join(f"wörd{k} " for k in range(60_000))
    begin = time.time()
    got = decode.words(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(got) == 60_000 and time.time() - begin < 40
    assert all(text[r["start"] : r["end"]] == r["word"] for r in got[::501])


def test_binned_overlaps_equal_a_plain_join(spark):
    rng = random.Random(8)
    runs, spans = [], []
    for d in range(4):
        at = 0
        for k in range(300):
            n = rng.choice([1, 5, 40, 900])
            runs.append((d, k, at, at + n, "t"))
            at += n
        spans += [(d, a := rng.randrange(at), a + rng.choice([0, 1, 30, 3_000])) for _ in range(80)]
    placed = spark.createDataFrame(runs, "doc_id int, seq int, flat_start int, flat_end int, text string")
    cuts = spark.createDataFrame(spans, "doc_id int, start int, end int")
    want = sorted((d, k, s, e) for d, k, x, y, _ in runs for c, s, e in spans if c == d and y > s and x < e and e > s)
    for width in (7, 64, 4096):
        assert sorted(tuple(r) for r in segments.overlaps(placed, cuts, width=width).select("doc_id", "seq", "start", "end").collect()) == want


def test_many_runs_and_spans_of_one_document(spark):
    placed = spark.range(100_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("seq"), (F.col("id") * 8).cast("int").alias("flat_start"), (F.col("id") * 8 + 8).cast("int").alias("flat_end"))
    cuts = spark.range(10_000).select(F.lit(1).alias("doc_id"), (F.col("id") * 80 + 4).cast("int").alias("start"), (F.col("id") * 80 + 14).cast("int").alias("end"))
    begin = time.time()
    assert segments.overlaps(placed, cuts).count() == 20_000 and time.time() - begin < 60
