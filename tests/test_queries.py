import os

import duckdb
import pytest

from maskwell.plans import catalogue, surfaces  # noqa: F401  (adds its queries to the catalogue's)

SF = "/root/testdata/sf0.001"
NAMES = ["redact_documents", "resolve_overlaps", "two_pass_detection", "dictionary_listing", "fixed_chunks", "segment_overlaps", "check_luhn", "check_iban", "decode_tags", "file_names", "spans_by_sql", "two_tables_round_trip"]


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = con.sql(catalogue.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_entry_imports():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and "redact_documents" in names
