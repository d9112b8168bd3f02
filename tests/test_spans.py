import random

from pyspark.sql import functions as F

from maskwell.functions import spans as S
from maskwell.operators import corpus, decode, segments
from maskwell.rules import catalogue

SPANS = f"array<{S.SPAN}>"


def span(text, start, end, kind="OTHER", confidence=0.9, detector="d", order=0):
    return (start, end, kind, text[start:end], float(confidence), detector, order)


def one(spark, text, spans):
    return spark.createDataFrame([(1, text, spans)], f"doc_id long, text string, spans {SPANS}")


def test_session_goldens(spark):
    for text, places, want in (
        ("Contact john@acme.com or call 555-123-4567.", [(8, 21), (30, 42)], "Contact <<REDACTED_2>> or call <<REDACTED_1>>."),
        ("John Smith called john@test.com SSN 123-45-6789", [(0, 10), (18, 31), (36, 47)], "<<REDACTED_3>> called <<REDACTED_2>> SSN <<REDACTED_1>>"),
        ("Call John at john@test.com", [(5, 9), (13, 26)], "Call <<REDACTED_2>> at <<REDACTED_1>>"),
        ("a b a", [(0, 1), (2, 3), (4, 5)], "<<REDACTED_1>> <<REDACTED_2>> <<REDACTED_1>>"),
    ):
        docs = corpus.redacted(one(spark, text, [span(text, a, b) for a, b in places]))
        row = docs.first()
        assert row["redacted"] == want
        back = corpus.restored(docs.select("doc_id", F.col("redacted").alias("text")), docs).first()
        assert back["restored"] == text


def test_blank_mode_restores_the_last_numbered_value(spark):
    text = "A and B"
    docs = corpus.redacted(one(spark, text, [span(text, 0, 1), span(text, 6, 7)]), mode="blanked")
    assert docs.first()["redacted"] == "________ and ________"
    assert corpus.restored(docs.select("doc_id", F.col("redacted").alias("text")), docs).first()["restored"] == "A and A"


def test_restore_is_literal_and_longest_first(spark):
    entries = [(1, "$1 \\ $$", "<<A>>", "OTHER"), (2, "x", "<<A>>B", "OTHER")]
    df = spark.createDataFrame([("<<A>>B <<A>> <<C>>", entries)], "text string, e array<struct<ord:int,original:string,placeholder:string,entity_type:string>>")
    assert df.select(S.restore(F.col("text"), F.col("e"))).first()[0] == "x $1 \\ $$ <<C>>"


def fold(spans, by_score=False):
    order = sorted(spans, key=(lambda s: -s[4]) if by_score else (lambda s: (s[0], s[0] - s[1], -s[4])))
    kept = []
    for s in order:
        if all(not (s[0] < k[1] and s[1] > k[0]) for k in kept):
            kept.append(s)
    return [(s[0], s[1], s[6]) for s in kept]


def test_resolution_against_a_plain_fold(spark):
    rng = random.Random(4)
    text = "x" * 60
    rows = []
    for k in range(60):
        spans = [span(text, a, a + rng.randint(1, 12), confidence=rng.choice([0.3, 0.5, 0.9]), order=i) for i, a in enumerate(rng.choices(range(45), k=rng.randint(0, 12)))]
        rows.append((k, text, spans))
    df = spark.createDataFrame(rows, f"doc_id long, text string, spans {SPANS}")
    got = df.select("doc_id", S.resolve(F.col("spans")).alias("p"), S.greedy(F.col("spans")).alias("g")).collect()
    for r in got:
        spans = rows[r["doc_id"]][2]
        assert [(s["start"], s["end"], s["ord"]) for s in r["p"]] == fold(spans)
        assert [(s["start"], s["end"], s["ord"]) for s in r["g"]] == fold(spans, True)


def test_propagation(spark):
    text = "Anna Berger met ANNA. Annabel, (berger) ab-ab-ab x"
    spans = [span(text, 0, 11, "PERSON"), span(text, 40, 45, "OTHER")]
    rows = corpus.with_repeats(one(spark, text, spans), F.col("spans")).first()["spans"]
    assert [(p["value"], p["start"], p["type"]) for p in rows] == [("Anna", 0, "PERSON"), ("ANNA", 16, "PERSON"), ("Berger", 5, "PERSON"), ("berger", 32, "PERSON"), ("ab-ab", 43, "OTHER")]


def test_detection_handles_nulls_and_blanks(spark):
    df = spark.createDataFrame([(1, None), (2, "  \n"), (3, ""), (4, "a@b.co a@b.co")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in corpus.redacted(corpus.detected(df, catalogue.named("universal:email"))).collect()}
    assert rows[1]["redacted"] is None and rows[2]["redacted"] == "  \n" and rows[3]["redacted"] == ""
    assert rows[4]["redacted"] == "<<REDACTED_1>> <<REDACTED_1>>"


def test_segments_flatten_and_rewrite(spark):
    runs = [(1, 0, 0, 0, "Hello "), (1, 0, 0, 1, "Anna "), (1, 0, 0, 2, ""), (1, 0, 0, 3, "Berger!"), (1, 0, 1, 0, "Bye"), (1, 1, 0, 0, "foot")]
    df = spark.createDataFrame(runs, "doc_id long, part int, paragraph int, seq int, text string")
    docs, placed = segments.flattened(df)
    assert docs.first()["text"] == "Hello Anna Berger!\nBye\nfoot"
    for cuts, want in (
        ([(6, 17, "<<1>>")], ["Hello ", "<<1>>!", "", "Bye", "foot"]),
        ([(0, 2, "<<2>>")], ["<<2>>llo ", "Anna ", "Berger!", "Bye", "foot"]),
        ([(16, 20, "<<3>>"), (3, 8, "<<4>>")], ["Hel<<4>>na ", "", "Berge<<3>>ye", "", "foot"]),
        ([(3, 8, "<<5>>"), (9, 13, "<<6>>")], ["Hel<<5>>n<<6>>rger!", "", "", "Bye", "foot"]),
    ):
        spans = spark.createDataFrame([(1, *c) for c in cuts], "doc_id long, start int, end int, placeholder string")
        got = [r["text"] for r in segments.rewritten(placed, spans).orderBy("part", "paragraph", "seq").collect()]
        assert got == want, cuts


def test_tags(spark):
    tags = ["B-x", "I-x", "B-x", "I-y", "I-x", "B-x", "B-x", "O"]
    rows = [(1, i, t, 0.5, i * 2, i * 2 + 1) for i, t in enumerate(tags)]
    df = spark.createDataFrame(rows, "doc_id long, idx int, tag string, confidence double, start int, end int")
    got = sorted((r["first"], r["last"]) for r in decode.tag_spans(df, ["doc_id"]).collect())
    assert got == [(0, 1), (2, 2), (5, 5), (6, 6)]
    assert decode.tag_spans(df, ["doc_id"], 0.51).count() == 0


def test_chunks(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 150, 151, 260, 261, 1000)], "n int")
    for r in df.select("n", decode.fixed_chunks(F.col("n")).alias("c")).collect():
        want, at = [0], 0
        while at + 150 < r["n"]:
            at += 110
            want.append(at)
        assert r["c"] == want
    assert decode.active_labels([" Shoe ", "", "person name"])[-1] == "shoe"


def test_session_numbers_go_on(spark):
    stored = spark.createDataFrame([("a", 1), ("b", 7)], "original string, ord long")
    values = spark.createDataFrame([("c", 2, 0), ("a", 1, 0), ("d", 1, 5), ("c", 9, 9)], "original string, doc_id long, start int")
    got = {r["original"]: r["ord"] for r in corpus.session_numbers(values, stored, ["doc_id", "start"]).collect()}
    assert got == {"a": 1, "b": 7, "d": 8, "c": 9}
