import os

import duckdb
import pytest
from pyspark.sql import functions as F

from maskwell.operators import corpus
from maskwell.operators.detectors import Detector, Registry, detected
from maskwell.plans import catalogue, detectors, streams  # noqa: F401
from maskwell.rules import catalogue as rules

EMAIL, IPV4 = rules.named("universal:email"), rules.named("universal:ipv4")
SF = "/root/testdata/sf0.001"




def all_known(spark):
    # made here, as workers can't import a test module
    def names_scorer():
        return lambda text: [(text.index("Ann"), text.index("Ann") + 3, "PERSON", 0.4), (0, 10**6, "PERSON", 0.9)] if "Ann" in text else []

    spans = spark.createDataFrame([(1, 0, 3, "TABLE", 0.9), (1, 2, 2, "EMPTY", 0.9), (1, 5, 9999, "OUT", 0.9), (9, 0, 1, "NOBODY", 0.9)], "doc_id long, start int, end int, type string, confidence double")
    column = lambda t: F.when(t.contains("!"), F.array(F.struct((F.locate("!", t) - 1).alias("start"), F.locate("!", t).alias("end"), F.lit("MARK").alias("type"), F.lit("!").alias("value"), F.lit(1.0).alias("confidence"))))
    r = Registry().add(Detector("mail", rules=EMAIL)).add(Detector("net", rules=EMAIL + IPV4)).add(Detector("marks", column=column))
    return r.add(Detector("scores", table=spans)).add(Detector("names", batches=names_scorer)).add(Detector("sure names", batches=names_scorer, threshold=0.5))


def found(spark, docs, *names):
    out = detected(docs, all_known(spark).pick(*names), propagated=False)
    assert out.columns == [*docs.columns, "spans"]
    return sorted((r["doc_id"], r["start"], r["end"], r["type"], r["detector"], r["value"]) for r in corpus.exploded(out).collect())


def test_detectors_of_every_kind(spark):
    docs = spark.createDataFrame([(1, "Bob and Ann write a@b.co from 10.0.0.1!", "x"), (2, None, "y"), (3, "", "z"), (4, "nothing", None)], "doc_id long, text string, score string")
    mail, net = (1, 18, 24, "EMAIL", "regex:universal:email", "a@b.co"), (1, 30, 38, "regex:universal:ipv4", "10.0.0.1")
    got = found(spark, docs, "scores", "names", "mail", "net", "marks")
    assert got[:2] == [(1, 0, 3, "TABLE", "scores", "Bob"), (1, 8, 11, "PERSON", "names", "Ann")]
    assert got[2][:3] == mail[:3] and got[2][4:] == mail[4:]
    assert got[3][:3] == net[:3] and got[3][4:] == net[3:]
    assert got[4] == (1, 38, 39, "MARK", "marks", "!") and len(got) == 5
    assert found(spark, docs, "sure names") == [] and found(spark, docs) == []
    assert found(spark, docs.filter("false"), "scores", "names", "mail") == []


def test_the_order_of_names_breaks_ties(spark):
    docs = spark.createDataFrame([(1, "abc def")], "doc_id long, text string")
    make = lambda kind: lambda: lambda text: [(0, 3, kind, 0.8)]
    known = Registry().add(Detector("a", batches=make("A"))).add(Detector("b", batches=make("B")))
    first = lambda *names: detected(docs, known.pick(*names), propagated=False).first()["spans"][0]["type"]
    assert first("a", "b") == "A" and first("b", "a", "b") == "B"


def test_registry_refuses(spark):
    known = all_known(spark)
    with pytest.raises(KeyError, match="no detector named other"):
        known.pick("mail", "other")
    with pytest.raises(ValueError, match="already"):
        known.add(Detector("mail", rules=EMAIL))
    with pytest.raises(ValueError, match="one kind"):
        known.add(Detector("none"))


def test_rules_by_name_equal_rules(spark):
    docs = spark.createDataFrame([(1, "a@b.co, A@B.co and 10.0.0.1; b@c.de"), (2, "10.0.0.2")], "doc_id long, text string")
    by_name = detected(docs, all_known(spark).pick("net")).select("doc_id", "spans").collect()
    assert sorted(by_name) == sorted(corpus.detected(docs, EMAIL + IPV4).select("doc_id", "spans").collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["detectors_by_name", "session_stream_of_events", "latest_version_by_stream", "span_counts_by_stream", "redact_stream_of_documents"])
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = catalogue.queries()[name](spark, SF)
    rel = con.sql(catalogue.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
