"""Registered queries of the engine and their oracle SQL.

Inputs are the given tables, or texts that a query derives from their keys in the same words for both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.functions import checks
from maskwell.functions import spans as S
from maskwell.operators import corpus, decode, segments
from maskwell.plans import sql
from maskwell.rules import catalogue as rules
from maskwell.rules.base import WHITE
from maskwell.sources import text as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FOUR = rules.named("universal:email", "universal:phone_intl", "universal:credit_card", "universal:ipv4")
SEVERAL = rules.named(
    "universal:email", "universal:phone_intl", "universal:credit_card", "universal:ipv4", "universal:postal_city", "us:phone", "us:zip_plus4", "gb:sort_code", "gb:bank_account", "de:phone", "fr:cni"
)
DOCS = "SELECT doc_id, coalesce(text, '') AS text FROM documents"

# one line for a customer, with a number in most formats of the rules; k is the key
_K = "c_custkey"


def _pad(factor: int, n: int) -> str:
    return f"lpad(concat(({_K} * {factor} + {factor % 1000}) % {10**n}), {n}, '0')"


LETTER = "concat(" + ", ".join([
    "c_name", "' Trading Ltd, '", f"{_K} % 97 + 1", "' Green Park Road, AB'", f"{_K} % 10", f"' {{k9}}CD; AA '".replace("{k9}", "4"), _pad(7, 2), "' '", _pad(13, 2), "' '", _pad(17, 2), "' B; NHS '",
    _pad(104729, 3), "' '", _pad(7919, 3), "' '", _pad(6007, 4), "'; '", _pad(99991, 9), "'; GB'", _pad(31, 3), "' '", _pad(37, 4), "' '", _pad(41, 2), "'; 0'", _pad(6661, 4), "' '", _pad(123457, 6),
    "'; 07'", _pad(331, 3), "' '", _pad(654321, 6), "'; pay the sum of twenty pounds, in the amount of ten dollars; '",
    "'PESEL '", _pad(7, 2), "'0'", _pad(3, 1), "'1'", _pad(765432, 6), "'; ABC '", _pad(345671, 6), "'; '", _pad(211, 3), "'-'", _pad(223, 3), "'-'", _pad(19, 2), "'-'", _pad(23, 2), "'; 00-'", _pad(101, 3),
    "' Nowa Wola; słownie: sto złotych; ul. Długa Nowa '", _pad(3, 2), "'/'", _pad(7, 1), "'; Jasna Firma Sp. z o.o.; IV K '", _pad(3, 2), "'/19; '", _pad(9001, 4), "'/'", _pad(86028157, 8), "'/'", _pad(7001, 4),
    "'; C'", _pad(11, 2), "'FGH12'", _pad(3, 1), "'4; '", _pad(23, 2), "' '", _pad(557, 3), "' '", _pad(563, 3), "' '", _pad(569, 3), "'; DE'", _pad(982451, 9), "'; +49 30 '", _pad(7654321, 7), "'; 10'", _pad(101, 3),
    "' Berlin Mitte; in Höhe von zehn Euro, Lange Hauptstraße '", f"{_K} % 90 + 1", "'a; Blaue Werke GmbH; J'", _pad(3, 2), "'.1 G; '", _pad(7, 2), "'010180B'", _pad(401, 3), "'; '",
    "'1 '", _pad(7, 2), "' 05 78 '", _pad(49, 3), "' '", _pad(13, 3), "' '", _pad(97, 2), "'; '", _pad(7, 2), "'AB'", _pad(54321, 5), "'; 01'", "' 23 45 67 '", _pad(89, 2), "'; 750'", _pad(7, 2), "' Paris Nord; somme de dix euros, '",
    f"{_K} % 50 + 1", "' rue de la Paix; Beau Monde SARL; '", _pad(12345677, 8), "substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST(" + _K + " % 23 + 1 AS INT), 1)", "'; X'", _pad(7654321, 7), "'L; B'", _pad(1234567, 7), "'J; cantidad de diez euros, Calle Mayor Alta '",
    _pad(3, 2), "'; Gran Casa S.L.; '", _pad(123456789, 9), "' AB1; 1000-'", _pad(205, 3), "' Lisboa; quantia de dez euros, Rua Augusta '", _pad(3, 2), "'; Boa Casa Lda; '",
    _pad(850523, 6), "'-'", _pad(7919, 4), "'; 1985'", _pad(1023, 4), "'-'", _pad(7907, 4), "'; 08-123 45 '", _pad(67, 2), "'; 114 '", _pad(55, 2), "' Stockholm; summan tio kronor, Stora Gatan '", _pad(3, 2), "'; Fina Saker AB; '",
    _pad(10199, 6), "' '", _pad(12368, 5), "'; '", _pad(998877665, 9), "' MVA; 22 33 44 '", _pad(55, 2), "'; 0150 Oslo; summen ti kroner, Karl Johans gate '", _pad(3, 2), "'; Gode Ting AS; RSSMRA'", _pad(85, 2), "'M01H'", _pad(501, 3),
    "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(" + _K + " % 26 + 1 AS INT), 1)", "'; IT'", _pad(12345678903, 11), "'; 347 123 '", _pad(4567, 4), "'; via Roma Nuova '", _pad(3, 2), "'; Bella Cosa S.r.l.; 06 1234 '", _pad(5678, 4), "'; 1012 AB; Lange Gracht '", _pad(3, 2), "'; Mooi Huis B.V.; '",
    _pad(7, 2), "'.07.15-'", _pad(123, 3), "'.'", _pad(97, 2), "'; 02 123 45 '", _pad(67, 2), "'; 1000 Brussel; Korte Laan '", _pad(3, 2), "'; rue Haute '", _pad(3, 2), "'; '", f"{_K} % 9 + 1", _pad(237, 3), "' 010180; 756.'", _pad(1234, 4), "'.'", _pad(5678, 4), "'.'", _pad(97, 2), "'; '",
    _pad(1234567, 7), "substr('ABCDEFGHIJKLMNOPQRSTUVW', CAST(" + _K + " % 23 + 1 AS INT), 1)", "'; D02 AF'", _pad(30, 2), "'; 010180-'", _pad(1234, 4), "'; 131052-'", _pad(308, 3), "substr('0123456789ABCDEFHJKLMNPRSTUVWXY', CAST(" + _K + " % 31 + 1 AS INT), 1)",
    "'; 123-45-'", _pad(6789, 4), "'; 9'", _pad(12, 2), "'-70-'", _pad(1234, 4), "'; 12-'", _pad(3456789, 7), "'; 1EG4TE5MK'", _pad(73, 2), "'; BJ'", _pad(1234563, 7), "'; '", _pad(1234567893, 10), "'; 0'", _pad(21000021, 8), "'; (212) 555-'", _pad(123, 4), "'; 90210-'", _pad(1234, 4),
    "'; '", f"{_K} % 900 + 1", "' North Main Street; Big Deal, Inc; GB29 NWBK 6016 1331 '", _pad(9268, 4), "' '", _pad(19, 2), "'; 4532 0151 1283 '", _pad(366, 4), "'; $1,'", _pad(234, 3), "'.50; 1 '", _pad(500, 3), "' EUR; 10.0.'", f"{_K} % 300", "'.1; 2001:db8:0:0:0:0:0:'", _pad(1, 3), "'; 00:1b:44:11:3a:'", _pad(7, 2),
    "'; 03.04.'", _pad(1999, 4), "'; 2024-05-'", _pad(7, 2), "'; 7 March '", _pad(2001, 4), "'; March 7, '", _pad(2001, 4), "'; mail a'", _K, "'@example.com or +44 20 7946 '", _pad(958, 4), "'.'",
]) + ")"
# bytes of a table's files that are one task's to scan by the whole catalogue
SHARE = 4 << 20
LETTERS = f"SELECT c_custkey AS doc_id, {LETTER} AS text FROM customer"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", *columns, F.coalesce("text", F.lit("")).alias("text")))


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    # scanning by many rules takes far more time than moving the keys that letters are made from
    keys = table(spark, sf_dir, "customer").select("c_custkey", "c_name").repartition(spark.sparkContext.defaultParallelism)
    # within a function of an array: as a projection's own code it is one method too long for the JVM to compile
    own = LETTER.replace("c_custkey", "k.c_custkey").replace("c_name", "k.c_name")
    return keys.select(F.col("c_custkey").alias("doc_id"), F.expr(f"element_at(transform(array(struct(c_custkey, c_name)), k -> {own}), 1)").alias("text"))


def spread(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Rows dealt out where the files have fewer splits than there are cores: a scan takes far more time than moving
    its texts. A large table has more splits, and nothing is moved; but with a path to the table's files, for scans by the whole
    catalogue, there is a partition at least for each 4 MB of them, as a row group of 128 MB would be one task of half an hour."""
    cores, splits = docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions()
    least = 4 * cores if splits < cores else 0
    if path:
        size = docs.sparkSession.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
        least = max(least, -(-size // SHARE))
    return docs.repartition(least) if splits < least else docs


def query(oracle: str | None = None, name: str = ""):
    def add(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return add


def with_rules(source: Callable, which: tuple) -> Callable[[SparkSession, str], DataFrame]:
    """Rows of all matches of rules over a source."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = source(spark, sf_dir).withColumn("spans", S.scan(F.col("text"), which))
        return corpus.exploded(found).select("doc_id", "detector", "start", "end", "type", "value", "confidence")

    return run


def scan_oracle(source: str, which: tuple) -> str:
    return f'SELECT doc_id, detector, s AS start, e AS "end", type, value, confidence FROM ({sql.scan(source, which)})'


# every rule, by region, over derived letters; and the universal ones over documents and pages
for _region in ("universal", *rules.REGIONS):
    _own = tuple(r for r in rules.RULES if r.region == _region and r.re2)
    query(scan_oracle(LETTERS, _own), f"scan_{_region}")(with_rules(letters, _own))
_AROUND = tuple(r for r in rules.RULES if not r.re2)
query(None, "scan_with_lookaround")(with_rules(letters, _AROUND))
_OVER = tuple(r for r in rules.select("universal") if r.region == "universal" and r.re2)
query(scan_oracle(DOCS, _OVER), "scan_documents")(with_rules(texts, _OVER))


@query(f'SELECT page_id, detector, s AS start, e AS "end", value FROM ({sql.scan("SELECT page_id, coalesce(html, chr(32)) AS text FROM pages", FOUR, "page_id")})')
def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit(" ")).alias("text")))
    return corpus.exploded(pages.withColumn("spans", S.scan(F.col("text"), FOUR)), "page_id").select("page_id", "detector", "start", "end", "value")


@query()
def scan_pages_by_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit(" ")).alias("text")), f"{sf_dir}/pages.parquet")
    return corpus.exploded(pages.withColumn("spans", S.scan(F.col("text"), rules.RULES)), "page_id").select("page_id", "detector", "start", "end", "value")


# §2.4: each check over identifiers from keys, accepted or not
def _check(function: Callable, template: str) -> None:
    name = f"check_{function.__name__}"
    # products of large keys with factors of 14 digits are more than a long holds
    exact = template.replace("o_orderkey", "CAST(o_orderkey AS DECIMAL(19, 0))")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(exact).alias("v"))
        return rows.select("o_orderkey", "v", function(F.col("v")).alias("ok"))

    QUERIES[name] = run
    ORACLES[name] = f"SELECT o_orderkey, v, {sql.CHECKS[function.__name__]} AS ok FROM (SELECT o_orderkey, {template} AS v FROM orders)"


def _n(factor: int, n: int) -> str:
    return f"lpad(concat((o_orderkey * {factor} + {factor % 997}) % {10**n}), {n}, '0')"


def _c(letters_: str, factor: int = 1) -> str:
    return f"substr('{letters_}', CAST((o_orderkey * {factor}) % {len(letters_)} + 1 AS INT), 1)"


ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
for _f, _t in (
    (checks.luhn, f"concat({_n(7919, 8)}, '-', {_n(104729, 8)})"),
    (checks.iban, f"concat('GB', {_n(7, 2)}, 'NWBK', {_n(86028157, 8)}, {_n(12343, 6)})"),
    (checks.ipv4, "concat('10.', o_orderkey % 300, '.0.', o_orderkey % 256)"),
    (checks.gb_nino, f"concat({_c(ABC)}, {_c(ABC, 3)}, {_n(123457, 6)}, 'A')"),
    (checks.gb_nhs, _n(1234567891, 10)),
    (checks.pl_pesel, _n(12345678911, 11)),
    (checks.pl_nip, _n(1234563217, 10)),
    (checks.pl_id_card, f"concat({_c(ABC)}, {_c(ABC, 3)}, {_c(ABC, 5)}, {_n(123457, 6)})"),
    (checks.pl_regon, f"CASE WHEN o_orderkey % 2 = 0 THEN {_n(123456787, 9)} ELSE {_n(12345678512347, 14)} END"),
    (checks.de_steuerid, _n(12345678903, 11)),
    (checks.fr_nir, f"concat(o_orderkey % 3 + 1, {_n(123457, 6)}, {_n(123457, 6)}, {_n(97, 2)})"),
    (checks.es_dni, f"concat({_n(12345677, 8)}, {_c('TRWAGMYFPDXBNJZSQVHLCKE')})"),
    (checks.pt_nif, _n(123456787, 9)),
    (checks.se_personnummer, f"concat({_n(123457, 6)}, CASE WHEN o_orderkey % 3 = 0 THEN '+' ELSE '-' END, {_n(7919, 4)})"),
    (checks.se_samordningsnummer, f"concat({_n(123457, 6)}, '-', {_n(7919, 4)})"),
    (checks.no_fodselsnummer, _n(12345678917, 11)),
    (checks.no_d_nummer, _n(12345678917, 11)),
    (checks.it_codice_fiscale, f"concat('RSSMRA', {_n(85, 2)}, 'M', {_n(1, 2)}, 'H', {_n(501, 3)}, {_c(ABC)})"),
    (checks.it_partita_iva, f"concat('IT', {_n(12345678903, 11)})"),
    (checks.nl_bsn, _n(123456787, 9)),
    (checks.be_national_register, f"concat({_n(123457, 6)}, '-', {_n(7919, 3)}, '.', {_n(97, 2)})"),
    (checks.at_svnr, f"concat({_n(7919, 4)}, ' ', {_n(123457, 6)})"),
    (checks.ch_ahv, f"concat('756.', {_n(7919, 4)}, '.', {_n(6007, 4)}, '.', {_n(97, 2)})"),
    (checks.ie_pps, f"concat({_n(1234567, 7)}, {_c(ABC[:23])}, CASE WHEN o_orderkey % 2 = 0 THEN 'W' ELSE '' END)"),
    (checks.fi_hetu, f"concat({_n(123457, 6)}, '-', {_n(7919, 3)}, {_c('0123456789ABCDEFHJKLMNPRSTUVWXY')})"),
    (checks.us_aba, _n(123456787, 9)),
    (checks.us_npi, _n(1234567891, 10)),
    (checks.us_dea, f"concat('B', {_c(ABC)}, {_n(1234567, 7)})"),
):
    _check(_f, _t)

# The main path over documents: F1, F2, F5, O1, R0, R1
FOUND = sql.scan(DOCS, FOUR)
KEPT = sql.resolved(FOUND)
SOME = sql.scan(DOCS, SEVERAL)
SOME_KEPT = sql.resolved(SOME)
NUMBERED = sql.numbered(SOME_KEPT)


def several(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.detected(texts(spark, sf_dir), SEVERAL, propagated=False)


def several_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.listing(corpus.redacted(several(spark, sf_dir)))


def dictionary_sql(numbered: str) -> str:
    return f"SELECT DISTINCT doc_id, n AS ord, value AS original, '<<REDACTED_' || n || '>>' AS placeholder, arg_max(type, s) OVER (PARTITION BY doc_id, value) AS entity_type FROM ({numbered})"


@query(sql.redacted(DOCS, sql.numbered(KEPT)))
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.redacted(corpus.detected(texts(spark, sf_dir), FOUR, propagated=False))
    return docs.select("doc_id", F.size("spans").cast("long").alias("n_spans"), "redacted")


# Both passes by the whole catalogue; RE2 lacks look-around and DuckDB takes too long for so many rules: no oracle, tests by brute force
@query()
def redact_by_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = corpus.redacted(corpus.detected(spread(rows, f"{sf_dir}/documents.parquet")))
    return docs.select("doc_id", F.size("spans").cast("long").alias("n_spans"), "redacted")


@query(f'SELECT doc_id, s AS start, e AS "end", type, value, confidence, detector FROM ({SOME_KEPT})')
def resolve_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.exploded(several(spark, sf_dir)).drop("idx")


_BY_SCORE = """
SELECT doc_id, x.s AS start, x.e AS "end", x.detector AS detector
FROM (SELECT doc_id, unnest(list_reduce(l, lambda a, x: CASE WHEN len(list_filter(a, lambda k: x.s < k.e AND x.e > k.s)) = 0 THEN list_append(a, x) ELSE a END, l[1:0])) AS x
      FROM (SELECT doc_id, list({'s': s, 'e': e, 'detector': detector} ORDER BY confidence DESC, ord, i) AS l FROM (%s) GROUP BY doc_id))
""" % SOME  # noqa: UP031


@query(_BY_SCORE)
def greedy_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir).withColumn("spans", S.once(S.scan(F.col("text"), SEVERAL))).withColumn("spans", S.greedy(F.col("spans")))
    return corpus.exploded(docs).select("doc_id", "start", "end", "detector")


_SPREAD = sql.propagated(DOCS, SOME_KEPT)


@query(f'SELECT doc_id, s AS start, e AS "end", type, value FROM ({_SPREAD})')
def propagate_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.with_repeats(several(spark, sf_dir), F.col("spans"))
    return corpus.exploded(docs).select("doc_id", "start", "end", "type", "value")


_TWICE = sql.resolved(f"SELECT doc_id, 0 AS ord, s AS i, s, e, type, value, confidence, detector FROM ({SOME_KEPT}) UNION ALL SELECT doc_id, ord, i, s, e, type, value, confidence, detector FROM ({_SPREAD})")


@query(f'SELECT doc_id, s AS start, e AS "end", type, value, confidence, detector FROM ({_TWICE})')
def two_pass_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.exploded(corpus.detected(texts(spark, sf_dir), SEVERAL)).drop("idx")


# What is found by both passes is numbered, redacted, restored and counted
_TWICE_NUMBERED = sql.numbered(_TWICE)


def two_pass(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    docs = texts(spark, sf_dir, *columns)
    return corpus.detected(docs, SEVERAL)


@query(sql.redacted(DOCS, _TWICE_NUMBERED))
def two_pass_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.redacted(two_pass(spark, sf_dir))
    return docs.select("doc_id", F.size("spans").cast("long").alias("n_spans"), "redacted")


@query(sql.redacted(DOCS, _TWICE_NUMBERED, label="'________'"))
def two_pass_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.redacted(two_pass(spark, sf_dir), mode="blanked")
    return docs.select("doc_id", F.size("spans").cast("long").alias("n_spans"), "redacted")


@query(dictionary_sql(_TWICE_NUMBERED))
def two_pass_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.listing(corpus.redacted(two_pass(spark, sf_dir))).withColumn("ord", F.col("ord").cast("long"))


@query("SELECT doc_id, coalesce(text, '') AS restored, true AS same FROM documents")
def two_pass_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.redacted(two_pass(spark, sf_dir))
    back = corpus.restored(docs.select("doc_id", F.col("redacted").alias("text")), docs)
    return back.join(texts(spark, sf_dir).withColumnRenamed("text", "original"), "doc_id").select("doc_id", "restored", (F.col("restored") == F.col("original")).alias("same"))


@query(f"""
SELECT d.doc_id, 'See ' || coalesce((SELECT any_value(value) FROM ({_TWICE_NUMBERED}) n WHERE n.doc_id = d.doc_id AND n.n = 1), '<<REDACTED_1>>') || ' and <<REDACTED_999>>.' AS restored
FROM documents d""")  # fmt: skip
def two_pass_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.redacted(two_pass(spark, sf_dir))
    responses = docs.select("doc_id", F.lit("See <<REDACTED_1>> and <<REDACTED_999>>.").alias("text"))
    return corpus.restored(responses, docs).select("doc_id", "restored")


@query(f"SELECT doc_id, type, count(*) AS n FROM ({_TWICE}) GROUP BY ALL")
def two_pass_spans_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.exploded(two_pass(spark, sf_dir)).groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT lang, type, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM ({_TWICE}) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY ROLLUP (lang, type)")
def two_pass_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.each(two_pass(spark, sf_dir, "lang"), F.col("spans"), "s", "doc_id", "lang").select("doc_id", "lang", "s.type")
    return rows.rollup("lang", "type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query(dictionary_sql(NUMBERED))
def dictionary_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return several_entries(spark, sf_dir).withColumn("ord", F.col("ord").cast("long"))


@query(sql.redacted(DOCS, sql.numbered(SOME_KEPT), label="'________'"))
def redact_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.redacted(several(spark, sf_dir), mode="blanked")
    return docs.select("doc_id", F.size("spans").cast("long").alias("n_spans"), "redacted")


@query("SELECT doc_id, coalesce(text, '') AS restored, true AS same FROM documents")
def restore_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.redacted(several(spark, sf_dir))
    back = corpus.restored(docs.select("doc_id", F.col("redacted").alias("text")), docs)
    return back.join(texts(spark, sf_dir).withColumnRenamed("text", "original"), "doc_id").select("doc_id", "restored", (F.col("restored") == F.col("original")).alias("same"))


@query(f"""
SELECT d.doc_id, 'See ' || coalesce((SELECT any_value(value) FROM ({NUMBERED}) n WHERE n.doc_id = d.doc_id AND n.n = 1), '<<REDACTED_1>>') || ' and <<REDACTED_999>>.' AS restored
FROM documents d""")  # fmt: skip
def restore_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.redacted(several(spark, sf_dir))
    responses = docs.select("doc_id", F.lit("See <<REDACTED_1>> and <<REDACTED_999>>.").alias("text"))
    return corpus.restored(responses, docs).select("doc_id", "restored")


@query(f"""
WITH e AS ({dictionary_sql(NUMBERED)}), said AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(['<<REDACTED_1>>', '<<REDACTED_999>>']) AS p FROM documents)),
known AS (SELECT DISTINCT doc_id, placeholder AS p FROM e)
SELECT doc_id, p AS placeholder, CASE WHEN said.p IS NULL THEN 'lost' WHEN known.p IS NULL THEN 'invented' ELSE 'known' END AS state
FROM (SELECT doc_id, p FROM said UNION SELECT doc_id, p FROM known) LEFT JOIN said USING (doc_id, p) LEFT JOIN known USING (doc_id, p)""".replace("said.p IS NULL", "s IS NULL").replace("known.p IS NULL", "k IS NULL").replace(
    "LEFT JOIN said USING", "LEFT JOIN (SELECT *, 1 AS s FROM said) USING").replace("LEFT JOIN known USING", "LEFT JOIN (SELECT *, 1 AS k FROM known) USING"))
def response_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = several(spark, sf_dir)
    responses = docs.select("doc_id", F.lit("See <<REDACTED_1>> and <<REDACTED_999>>.").alias("text"))
    return corpus.answer_check(responses, several_entries(spark, sf_dir))


@query(f"""
WITH e AS ({dictionary_sql(NUMBERED)})
SELECT doc_id, ord, original, CASE WHEN ord = 2 THEN '<<CLIENT>>' WHEN ord = 1 THEN '<<CLIENT>>' ELSE placeholder END AS placeholder,
       CASE WHEN ord = 1 THEN NOT EXISTS (SELECT 1 FROM e x WHERE x.doc_id = e.doc_id AND x.ord = 2) ELSE true END AS current
FROM e""")  # fmt: skip
def rename_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = several_entries(spark, sf_dir).withColumn("ord", F.col("ord").cast("long"))
    first = entries.filter("ord <= 2").select("doc_id", "original", F.lit(" CLIENT ").alias("label"), F.col("ord").alias("at"))
    renames = first.unionByName(entries.filter("ord = 1").select("doc_id", "original", F.lit("OLD").alias("label"), F.lit(0).cast("long").alias("at"))).unionByName(
        entries.filter("ord = 3").select("doc_id", "original", F.lit("  ").alias("label"), F.lit(9).cast("long").alias("at"))
    )
    return corpus.renamed(entries, renames).select("doc_id", "ord", "original", "placeholder", "current")


_PLACED = f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS idx FROM ({SOME_KEPT})"


@query(f'SELECT doc_id, idx, s AS start, e AS "end", value FROM ({_PLACED}) WHERE idx % 2 = 0')
def exclude_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.exploded(several(spark, sf_dir)).withColumn("idx", F.col("idx").cast("long"))
    return corpus.excluded(rows, rows.filter("idx % 2 = 1").select("doc_id", "idx")).select("doc_id", "idx", "start", "end", "value")


@query(f'SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1)::INT AS idx, s AS start, e AS "end", value FROM ({_PLACED}) WHERE idx % 2 = 0')
def remove_and_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.exploded(several(spark, sf_dir))
    return corpus.removed(rows, rows.filter("idx % 2 = 1").select("doc_id", "idx")).select("doc_id", "idx", "start", "end", "value")


# After an exclusion the session is built anew, so numbers close up
@query(sql.redacted(DOCS, sql.numbered(f"SELECT * FROM ({_PLACED}) WHERE idx % 2 = 0")))
def rebuild_after_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = several(spark, sf_dir)
    rows = corpus.exploded(docs)
    left = corpus.collected(corpus.excluded(rows, rows.filter("idx % 2 = 1").select("doc_id", "idx")), order="idx")
    out = corpus.redacted(docs.drop("spans").join(left, "doc_id", "left").withColumn("spans", F.coalesce("spans", S.none(S.SPAN))))
    return out.select("doc_id", F.size("spans").cast("long").alias("n_spans"), "redacted")


# O3: spans of a model stand-in, the first twelve characters and twenty later ones, united with those of rules
_SCORED = f"""SELECT doc_id, -1 AS ord, 0 AS i, 0 AS s, 12 AS e, 'PERSON' AS type, substr(text, 1, 12) AS value, 0.8::DOUBLE AS confidence, 'model' AS detector FROM ({DOCS}) WHERE length(text) >= 12
UNION ALL SELECT doc_id, -1, 1, 6, 40, 'COMPANY', substr(text, 7, 34), 0.6::DOUBLE, 'model' FROM ({DOCS}) WHERE length(text) >= 40
UNION ALL SELECT doc_id, -1, 2, 50, 70, 'ADDRESS', substr(text, 51, 20), 0.7::DOUBLE, 'model' FROM ({DOCS}) WHERE length(text) >= 70"""


@query(f"""
SELECT doc_id, s AS start, e AS "end", type, value, confidence, detector
FROM ({sql.resolved(f"SELECT doc_id, ord, i, s, e, type, value, confidence, detector FROM ({SOME}) UNION ALL {_SCORED}")})""")  # fmt: skip
def model_and_rule_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    def span(start: int, end: int, kind: str, confidence: float):
        cells = {"start": F.lit(start), "end": F.lit(end), "type": F.lit(kind), "value": F.substring("text", start + 1, end - start), "confidence": F.lit(confidence), "detector": F.lit("model"), "ord": F.lit(0)}
        return F.when(F.length("text") >= end, F.array(F.struct(*[v.alias(k) for k, v in cells.items()]))).otherwise(S.none(S.SPAN))

    scored = F.concat(span(0, 12, "PERSON", 0.8), span(6, 40, "COMPANY", 0.6), span(50, 70, "ADDRESS", 0.7))
    docs = texts(spark, sf_dir).withColumn("scored", scored)
    return corpus.exploded(corpus.detected(docs, SEVERAL, model="scored", propagated=False)).drop("idx")


@query(f"SELECT doc_id, s AS start, value, CASE WHEN n <= 2 THEN '<<REDACTED_' || n || '>>' ELSE '—' END AS placeholder FROM ({NUMBERED})")
def dictionary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.exploded(several(spark, sf_dir))
    return corpus.looked_up(rows, several_entries(spark, sf_dir).filter("ord <= 2")).select("doc_id", "start", "value", "placeholder")


_TAGS = "SELECT doc_id, 5 AS s, 12 AS e FROM documents WHERE length(text) > 20"


@query(f"""
SELECT doc_id, s AS start, e AS "end", type, value, confidence, detector FROM ({SOME_KEPT}) k WHERE NOT EXISTS (SELECT 1 FROM ({_TAGS}) t WHERE t.doc_id = k.doc_id AND k.s < t.e AND k.e > t.s)
UNION ALL SELECT t.doc_id, t.s, t.e, 'PERSON', substr(d.text, 6, 7), 1.0::DOUBLE, 'manual' FROM ({_TAGS}) t JOIN documents d USING (doc_id)""")  # fmt: skip
def manual_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = several(spark, sf_dir)
    tags = docs.filter(F.length("text") > 20).select("doc_id", F.lit(5).alias("start"), F.lit(12).alias("end"), F.lit("PERSON").alias("type"))
    return corpus.exploded(corpus.with_manual(docs, tags)).drop("idx")


# spans of a model stand-in: every seventh word of a text, scored from its offsets
_MODEL = f"SELECT doc_id, s, e, value, (s % 100) / 100.0::DOUBLE AS confidence, 'model:' || (s % 3) AS detector FROM ({{}}) WHERE idx % 7 = 0"


def words_sql(pattern: str, source: str = DOCS) -> str:
    p = sql.quote(pattern)
    return f"""
SELECT doc_id, (i - 1)::INT AS idx, hits[i] AS value, s::INT AS s, (s + length(hits[i]))::INT AS e
FROM (SELECT *, list_sum([length(x) for x in gaps[1:i]]) + coalesce(list_sum([length(x) for x in hits[1:i - 1]]), 0) AS s
      FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, {p}) AS gaps, regexp_extract_all(text, {p}) AS hits FROM ({source}))))"""


def words_of(pattern: str, source: str = DOCS) -> str:
    """The same by running sums."""
    p = sql.quote(pattern)
    return f"""
SELECT doc_id, (i - 1)::INT AS idx, hit AS value, (upto - length(hit))::INT AS s, upto::INT AS e
FROM (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS upto
      FROM (SELECT doc_id, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap
            FROM (SELECT doc_id, regexp_split_to_array(text, {p}) AS gaps, regexp_extract_all(text, {p}) AS hits FROM ({source}))))"""


SHORT = "SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations WHERE text IS NOT NULL"
_MODEL_SQL = _MODEL.format(words_sql(S.WORDS_B, SHORT))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = decode.words(messages(spark, sf_dir)).filter("idx % 7 = 0")
    return words.select("doc_id", "start", "end", F.col("word").alias("value"), ((F.col("start") % 100) / 100.0).cast("double").alias("confidence"), F.concat(F.lit("model:"), F.col("start") % 3).alias("detector"))


@query(f'SELECT doc_id, idx, value AS word, s AS start, e AS "end" FROM ({words_sql(S.WORDS_B, SHORT)})')
def words_by_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.words(messages(spark, sf_dir), S.WORDS_B)


@query(f'SELECT doc_id, idx, value AS word, s AS start, e AS "end" FROM ({words_sql(S.WORDS_A, SHORT)})')
def words_by_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.words(messages(spark, sf_dir), S.WORDS_A)


# F11, F12 over whole documents
@query(f'SELECT doc_id, idx, value AS word, s AS start, e AS "end" FROM ({words_of(S.WORDS_B)})')
def words_by_space_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.words(texts(spark, sf_dir), S.WORDS_B)


@query(f'SELECT doc_id, idx, value AS word, s AS start, e AS "end" FROM ({words_of(S.WORDS_A)})')
def words_by_letters_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.words(texts(spark, sf_dir), S.WORDS_A)


@query(f"SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '[^{WHITE}]') THEN len(regexp_extract_all(text, '[^{WHITE}]+')) ELSE 0 END::INT AS n_words FROM documents")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", decode.word_count(F.col("text")).alias("n_words"))


@query(f"""SELECT doc_id, s AS start, confidence, CASE WHEN confidence > 0.8 THEN 'high' WHEN confidence > 0.5 THEN 'mid' ELSE 'low' END AS band, floor(confidence * 100 + 0.5)::INT AS percent
FROM ({_MODEL_SQL}) WHERE confidence >= 0.35 AND length(value) >= 3""")
def model_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.long_enough(corpus.sure_enough(model_rows(spark, sf_dir), decode_threshold()))
    return rows.select("doc_id", "start", "confidence", corpus.band(F.col("confidence")).alias("band"), corpus.percent(F.col("confidence")).alias("percent"))


def decode_threshold() -> float:
    return corpus.THRESHOLDS["spans"]


_LABEL_CASE = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {**decode.SPAN_LABELS, **decode.TAG_LABELS}.items()) + " ELSE 'OTHER' END"
_ALL_LABELS = [*decode.SPAN_LABELS, *decode.TAG_LABELS, "AUTH_SECRET", "shoe size"]


@query(f"SELECT o_orderkey, label, {_LABEL_CASE} AS type FROM (SELECT o_orderkey, list_extract({_ALL_LABELS!r}, (o_orderkey % {len(_ALL_LABELS)} + 1)::INT) AS label FROM orders)")
def label_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in _ALL_LABELS])
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(names, (F.col("o_orderkey") % len(_ALL_LABELS) + 1).cast("int")).alias("label"))
    return decode.typed(rows, {**decode.SPAN_LABELS, **decode.TAG_LABELS})


@query("""SELECT doc_id, unnest(CASE WHEN n <= 150 THEN [0] ELSE range(0, (ceil((n - 150) / 110.0) * 110 + 1)::BIGINT, 110) END)::INT AS first
FROM (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^%s]+')) AS n FROM documents)""" % WHITE)  # noqa: UP031
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.regexp_extract_all("text", F.lit(S.quick(S.WORDS_B)), F.lit(0)))
    return corpus.each(texts(spark, sf_dir), S.bound(n, lambda k: decode.fixed_chunks(k)), "first", "doc_id")


def with_costs(docs: DataFrame) -> DataFrame:
    """Words cost a token per four letters."""
    return docs.withColumn("costs", S.once(F.transform(S.tokens(F.col("text"), S.WORDS_B), lambda t: F.ceil(F.length(t["word"]) / 4.0).cast("int"))))


# Messages with small budgets
@query(f"""
WITH RECURSIVE w AS (SELECT doc_id, idx, ceil(length(value) / 4.0)::INT AS cost FROM ({words_sql(S.WORDS_B, SHORT)})),
u AS (SELECT doc_id, idx, sum(cost) OVER (PARTITION BY doc_id ORDER BY idx)::BIGINT AS upto, cost, count(*) OVER (PARTITION BY doc_id) AS n FROM w),
step AS (SELECT a.doc_id, a.idx AS first, a.n, greatest(a.idx + 1, coalesce(max(b.idx), -1) + 1) AS stop FROM u a LEFT JOIN u b ON a.doc_id = b.doc_id AND b.upto - a.upto + a.cost <= 20 GROUP BY a.doc_id, a.idx, a.n),
c AS (SELECT doc_id, first, stop, n FROM step WHERE first = 0
      UNION ALL SELECT s.doc_id, s.first, s.stop, s.n FROM c JOIN step s ON c.doc_id = s.doc_id AND s.first = greatest(c.first + 1, c.stop - 4) AND c.stop < c.n)
SELECT doc_id, first::INT AS first, stop::INT AS "end" FROM c""")  # fmt: skip
def budget_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.each(with_costs(messages(spark, sf_dir)), decode.budget_chunks(F.col("costs"), 20, 4), "c", "doc_id").select("doc_id", "c.first", "c.end")


# the model's own budget over whole documents: a word fits the chunks from the words that at most ``budget`` tokens lie before its end
_COSTS = f"SELECT doc_id, idx, ceil(length(value) / 4.0)::INT AS cost FROM ({words_of(S.WORDS_B)})"


@query(f"""
WITH RECURSIVE u AS MATERIALIZED (SELECT doc_id, idx::BIGINT AS idx, cost, sum(cost) OVER (PARTITION BY doc_id ORDER BY idx)::BIGINT AS upto, count(*) OVER (PARTITION BY doc_id) AS n FROM ({_COSTS})),
step AS MATERIALIZED (SELECT a.doc_id, a.idx AS first, a.n, greatest(a.idx, coalesce(b.idx, -1)) + 1 AS stop FROM u a ASOF LEFT JOIN u b ON a.doc_id = b.doc_id AND a.upto - a.cost + {decode.SUBTOKENS_PER_CHUNK} >= b.upto),
c AS (SELECT doc_id, first, stop, n FROM step WHERE first = 0
      UNION ALL SELECT s.doc_id, s.first, s.stop, s.n FROM c JOIN step s ON c.doc_id = s.doc_id AND s.first = greatest(c.first + 1, c.stop - {decode.SUBTOKEN_OVERLAP}) AND c.stop < c.n)
SELECT doc_id, first::INT AS first, stop::INT AS "end" FROM c""")  # fmt: skip
def budget_chunks_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.each(with_costs(texts(spark, sf_dir)), decode.budget_chunks(F.col("costs")), "c", "doc_id").select("doc_id", "c.first", "c.end")


# tags of words, from their offsets: B or I of two names, or none
_TAG = "CASE WHEN s % 5 = 0 THEN 'B-X' WHEN s % 5 IN (1, 2) THEN 'I-X' WHEN s % 5 = 3 THEN 'I-Y' ELSE 'O' END"


@query(f"""
WITH t AS (SELECT doc_id, idx, s, e, tag, confidence, CASE WHEN tag <> 'O' THEN substr(tag, 3) END AS name FROM (SELECT doc_id, idx, s, e, {_TAG} AS tag, (s % 64) / 64.0::DOUBLE AS confidence FROM ({words_sql(S.WORDS_B, SHORT)}))),
g AS (SELECT *, sum(CASE WHEN tag[1:2] = 'I-' AND coalesce(lag_name = name, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY idx) AS island FROM (SELECT *, lag(name) OVER (PARTITION BY doc_id ORDER BY idx) AS lag_name FROM t))
SELECT doc_id, any_value(name) AS name, min(idx) AS first, max(idx) AS last, min(s) AS start, max(e) AS "end", avg(confidence) AS confidence
FROM g GROUP BY doc_id, island HAVING arg_min(tag, idx)[1:2] = 'B-' AND avg(confidence) >= 0.5""")  # fmt: skip
def decode_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = decode.words(messages(spark, sf_dir))
    m = F.col("start") % 5
    tag = F.when(m == 0, "B-X").when(m.isin(1, 2), "I-X").when(m == 3, "I-Y").otherwise("O")
    tags = words.select("doc_id", "idx", "start", "end", tag.alias("tag"), ((F.col("start") % 64) / 64.0).cast("double").alias("confidence"))
    return decode.tag_spans(tags, ["doc_id"])


@query(f"""
WITH t AS (SELECT doc_id, label, idx, ((s * (7 + l)) % 64) / 64.0::DOUBLE AS a, ((s * (11 + l)) % 64) / 64.0::DOUBLE AS b, ((s * (13 + l)) % 64) / 64.0::DOUBLE AS c
           FROM (SELECT *, 'L' || l AS label FROM ({words_sql(S.WORDS_B, SHORT)}), (SELECT unnest([0, 1]) AS l)))
SELECT x.doc_id, x.label, x.idx AS first, y.idx AS last, avg(z.c) AS score
FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.label = y.label AND y.idx >= x.idx AND x.a >= 0.35 AND y.b >= 0.35
JOIN t z ON z.doc_id = x.doc_id AND z.label = x.label AND z.idx BETWEEN x.idx AND y.idx
GROUP BY ALL HAVING min(z.c) >= 0.35""")  # fmt: skip
def decode_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda k: (((F.col("start") * (k + F.col("l"))) % 64) / 64.0).cast("double")
    rows = decode.words(messages(spark, sf_dir)).withColumn("l", F.explode(F.array(F.lit(0), F.lit(1))))
    scores = rows.select("doc_id", F.concat(F.lit("L"), "l").alias("label"), "idx", p(7).alias("p_start"), p(11).alias("p_end"), p(13).alias("p_inside"))
    return decode.score_spans(scores, ["doc_id"])


@query(f"""SELECT doc_id, (sum(begins) OVER (PARTITION BY doc_id ORDER BY idx) - 1)::INT AS word, idx AS pos, token
FROM (SELECT doc_id, idx, token, CASE WHEN token[1] = '▁' OR idx = 0 THEN 1 ELSE 0 END AS begins FROM (SELECT doc_id, idx, CASE WHEN s % 3 = 0 THEN value ELSE '▁' || value END AS token FROM ({words_sql(S.WORDS_B, SHORT)})))""")  # fmt: skip
def align_subtokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decode.words(messages(spark, sf_dir)).select("doc_id", F.col("idx").alias("pos"), F.when(F.col("start") % 3 == 0, F.col("word")).otherwise(F.concat(F.lit("▁"), "word")).alias("token"))
    return decode.aligned(rows, ["doc_id"]).select("doc_id", "word", "pos", "token")


@query("""SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS label, round(1 / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - m::DOUBLE))), 6) AS confidence, round(1 / (1 + exp(-embedding[1]::DOUBLE)), 6) AS first_p
FROM (SELECT *, list_max(embedding) AS m FROM embeddings)""")
def best_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("b", decode.best_label(F.col("embedding")))
    return rows.select("vec_id", "b.label", F.round("b.confidence", 6).alias("confidence"), F.round(decode.sigmoid(F.col("embedding")[0].cast("double")), 6).alias("first_p"))


_PIECES = f"""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS r, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM ({SOME_KEPT})),
p AS (SELECT k.doc_id, 2 * r AS o, substr(d.text, before + 1, s - before) AS text, NULL AS type FROM k JOIN documents d USING (doc_id)
      UNION ALL SELECT doc_id, 2 * r + 1, value, type FROM k
      UNION ALL SELECT d.doc_id, 1000000, substr(coalesce(d.text, ''), coalesce(x.e, 0) + 1), NULL FROM documents d LEFT JOIN (SELECT doc_id, max(e) AS e FROM k GROUP BY doc_id) x USING (doc_id))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1)::INT AS idx, text, type FROM p WHERE length(text) > 0"""


@query(_PIECES)
def review_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = several(spark, sf_dir).select("doc_id", F.posexplode_outer(decode.pieces(F.col("text"), F.col("spans"))).alias("idx", "p")).filter("idx is not null")
    return rows.select("doc_id", "idx", "p.text", "p.type")


# A1, A3, A4
@query(f"SELECT doc_id, type, count(*) AS n FROM ({SOME_KEPT}) GROUP BY ALL")
def spans_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.exploded(several(spark, sf_dir)).groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT lang, type, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM ({SOME_KEPT}) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY ROLLUP (lang, type)")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.detected(texts(spark, sf_dir, "lang"), SEVERAL, propagated=False)
    rows = corpus.each(docs, F.col("spans"), "s", "doc_id", "lang").select("doc_id", "lang", "s.type")
    return rows.rollup("lang", "type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query(f"SELECT detector, count(*) AS n, count(DISTINCT value) AS n_values, avg(confidence) AS confidence FROM ({SOME}) GROUP BY detector")
def rule_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.exploded(texts(spark, sf_dir).withColumn("spans", S.scan(F.col("text"), SEVERAL)))
    return rows.groupBy("detector").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_values"), F.avg("confidence").alias("confidence"))


_DOMAINS = " UNION ALL ".join(f"SELECT '{r.detector}' AS detector, '{r.region}' AS region, '{d}' AS domain" for r in SEVERAL for d in r.domains)


def rule_table(spark: SparkSession) -> DataFrame:
    """The catalogue as a dimension: ord, detector, type, confidence, region, domains."""
    rows = [(k, r.detector, r.type, r.confidence, r.region, list(r.domains)) for k, r in enumerate(rules.RULES)]
    return spark.createDataFrame(rows, "ord int, detector string, type string, confidence double, region string, domains array<string>")


@query(f"SELECT lang, region, domain, count(*) AS n FROM ({SOME}) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) JOIN ({_DOMAINS}) USING (detector) WHERE domain IN ('contact', 'financial') GROUP BY ALL")
def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "lang").withColumn("spans", S.scan(F.col("text"), SEVERAL))
    rows = corpus.each(docs, F.col("spans"), "s", "lang").select("lang", "s.detector")
    wanted = F.array(F.lit("contact"), F.lit("financial"))
    tags = rule_table(spark).filter(F.arrays_overlap("domains", wanted)).select("detector", "region", F.explode("domains").alias("domain")).filter(F.col("domain").isin("contact", "financial"))
    return rows.join(F.broadcast(tags), "detector").groupBy("lang", "region", "domain").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, lang, detector, s AS start FROM ({sql.scan(DOCS, tuple(r for r in SEVERAL if r.region == 'universal'))}) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) UNION ALL SELECT doc_id, lang, detector, s FROM ({sql.scan(DOCS, rules.named('de:phone', 'fr:cni'))}) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) WHERE detector[7:8] = lang")
def region_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "lang")
    of = lambda region: S.scan(F.col("text"), tuple(r for r in SEVERAL if r.region in ("universal", region)))
    chosen = F.when(F.col("lang") == "de", of("de")).when(F.col("lang") == "fr", of("fr")).otherwise(of("universal"))
    rows = corpus.each(docs.withColumn("spans", chosen), F.col("spans"), "s", "doc_id", "lang")
    return rows.select("doc_id", "lang", "s.detector", "s.start")


# the languages that are written in each region
LANGUAGES = {
    "gb": ("en",), "pl": ("pl",), "de": ("de",), "fr": ("fr",), "es": ("es",), "pt": ("pt",), "se": ("sv",), "no": ("no", "nb", "nn"), "it": ("it",), "nl": ("nl",), "be": ("nl", "fr", "de"),
    "at": ("de",), "ch": ("de", "fr", "it"), "ie": ("en",), "dk": ("da",), "fi": ("fi", "sv"), "us": ("en", "es"),
}


# a document has the universal rules and those of all regions of its language; of any region if the language is none of these
@query()
def region_by_language_by_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "lang")
    known = sorted({x for spoken in LANGUAGES.values() for x in spoken})
    of = lambda region: S.scan(F.col("text"), tuple(r for r in rules.RULES if r.region == region), alone=False)
    here = lambda spoken: F.coalesce(F.col("lang").isin(*spoken) | ~F.col("lang").isin(*known), F.lit(True))
    regional = [F.when(here(LANGUAGES[region]), of(region)).otherwise(S.none(S.SPAN)) for region in rules.REGIONS]
    rows = corpus.each(docs.withColumn("spans", F.concat(of("universal"), *regional)), F.col("spans"), "s", "doc_id", "lang")
    return rows.select("doc_id", "lang", "s.detector", "s.start")


# F17
@query("SELECT conv_id, turn, unnest(range(0, len(p)))::INT AS idx, unnest(p) AS placeholder FROM (SELECT conv_id, turn, regexp_extract_all(text || ' <<A_' || turn || '>> <<>> <<B>> <C>', '<<[^<>]+>>') AS p FROM conversations)")
def placeholder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", F.lit(" <<A_"), "turn", F.lit(">> <<>> <<B>> <C>")).alias("text"))
    return corpus.placeholders(rows.withColumn("k", F.struct("conv_id", "turn")), "k").select("k.conv_id", "k.turn", "idx", "placeholder")


# A conversation is a document, a turn a paragraph, its runs are cut at every 40 characters
_RUNS = """SELECT conv_id AS doc_id, 0 AS part, turn AS paragraph, i AS seq, substr(text, (i * 40 + 1)::BIGINT, 40) AS text
FROM (SELECT *, unnest(range(0, (length(text) + 39) // 40)) AS i FROM conversations WHERE length(text) > 0)"""
_FLAT = f"""SELECT *, (sum(sep + length(text)) OVER (PARTITION BY doc_id ORDER BY paragraph, seq))::INT AS flat_end
FROM (SELECT *, CASE WHEN coalesce(lag(paragraph) OVER (PARTITION BY doc_id ORDER BY paragraph, seq), paragraph) <> paragraph THEN 1 ELSE 0 END AS sep FROM ({_RUNS}))"""


def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter(F.length("text") > 0)
    rows = turns.select("conv_id", "turn", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 40).cast("int"))).alias("i"))
    return rows.select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("part"), F.col("turn").alias("paragraph"), F.col("i").cast("long").alias("seq"), F.substring("text", F.col("i") * 40 + 1, F.lit(40)).alias("text"))


@query("SELECT conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE length(text) > 0 GROUP BY conv_id")
def flatten_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.flattened(run_rows(spark, sf_dir))[0]


@query(f"SELECT doc_id, paragraph, seq, (flat_end - length(text))::INT AS flat_start, flat_end FROM ({_FLAT})")
def place_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.flattened(run_rows(spark, sf_dir))[1].select("doc_id", "paragraph", "seq", "flat_start", "flat_end")


# spans of five characters every thirty, and a long one over several runs
_CUTS = f"""SELECT doc_id, s::INT AS start, (s + w)::INT AS "end", '<<' || s || '>>' AS placeholder FROM (SELECT doc_id, unnest(range(10, n - 200, 150)) AS s, 5 AS w FROM (SELECT doc_id, max(flat_end) AS n FROM ({_FLAT}) GROUP BY doc_id)
UNION ALL SELECT doc_id, unnest(range(60, n - 200, 150)), 90 FROM (SELECT doc_id, max(flat_end) AS n FROM ({_FLAT}) GROUP BY doc_id))"""


def cut_rows(placed: DataFrame) -> DataFrame:
    n = placed.groupBy("doc_id").agg(F.max("flat_end").alias("n")).filter("n > 210")
    every = lambda first, w: n.filter(F.col("n") - 201 >= first).select("doc_id", F.explode(F.sequence(F.lit(first), F.col("n") - 201, F.lit(150))).alias("start")).withColumn("end", F.col("start") + w)
    return every(10, 5).unionByName(every(60, 90)).withColumn("placeholder", F.concat(F.lit("<<"), "start", F.lit(">>")))


@query(f'SELECT f.doc_id, paragraph, seq, start, "end" FROM ({_FLAT}) f JOIN ({_CUTS}) c ON f.doc_id = c.doc_id AND flat_end > start AND flat_end - length(text) < "end"')
def segment_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = segments.flattened(run_rows(spark, sf_dir))[1]
    return segments.overlaps(placed, cut_rows(placed)).select("doc_id", "paragraph", "seq", "start", "end")


# character by character: what no span covers stays in its run, a span's placeholder stands in its first run, and a run
# that a span reaches from an earlier one gives all it has to the run where the chain of such spans begins
_REWRITTEN = f"""
WITH f AS (SELECT *, flat_end - length(text) AS flat_start FROM ({_FLAT})), c AS ({_CUTS}),
touched AS (SELECT f.doc_id, paragraph, seq, start, placeholder, row_number() OVER (PARTITION BY f.doc_id, start ORDER BY paragraph, seq) AS nth
            FROM f JOIN c ON f.doc_id = c.doc_id AND flat_end > start AND flat_start < "end"),
letters AS (SELECT doc_id, paragraph, seq, flat_start + k AS p, substr(text, k + 1, 1) AS x FROM (SELECT *, unnest(range(0, length(text))) AS k FROM f)),
left_over AS (SELECT l.doc_id, l.paragraph, l.seq, l.p, l.x FROM letters l ASOF LEFT JOIN c ON l.doc_id = c.doc_id AND l.p >= c.start WHERE c."end" IS NULL OR l.p >= c."end"),
body AS (SELECT doc_id, paragraph, seq, string_agg(x, '' ORDER BY p) AS body
         FROM (SELECT * FROM left_over UNION ALL SELECT doc_id, paragraph, seq, start, placeholder FROM touched WHERE nth = 1) GROUP BY ALL),
runs AS (SELECT doc_id, paragraph, seq, coalesce(body, '') AS body, EXISTS (SELECT 1 FROM touched t WHERE t.doc_id = f.doc_id AND t.paragraph = f.paragraph AND t.seq = f.seq AND nth > 1) AS gives
         FROM f LEFT JOIN body USING (doc_id, paragraph, seq)),
chains AS (SELECT *, sum((NOT gives)::INT) OVER (PARTITION BY doc_id ORDER BY paragraph, seq) AS head FROM runs)
SELECT doc_id, paragraph, seq, CASE WHEN gives THEN '' ELSE (SELECT string_agg(y.body, '' ORDER BY y.paragraph, y.seq) FROM chains y WHERE y.doc_id = x.doc_id AND y.head = x.head) END AS text FROM chains x"""


@query(_REWRITTEN)
def rewrite_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = segments.flattened(run_rows(spark, sf_dir))[1]
    return segments.rewritten(placed, cut_rows(placed)).select("doc_id", "paragraph", "seq", "text")


# One session over the corpus, with numbers for every third value already stored
_VALUES = f"SELECT value AS original, min((doc_id, s)) AS first FROM ({SOME_KEPT}) GROUP BY value"


@query(f"""
WITH v AS ({_VALUES}), old AS (SELECT original, row_number() OVER (ORDER BY original) AS ord FROM v WHERE length(original) % 3 = 0)
SELECT original, ord FROM old UNION ALL SELECT original, (SELECT coalesce(max(ord), 0) FROM old) + row_number() OVER (ORDER BY first, original) FROM v ANTI JOIN old USING (original)""")  # fmt: skip
def session_across_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpus.exploded(several(spark, sf_dir)).select(F.col("value").alias("original"), "doc_id", "start")
    none = found.select("original", F.lit(0).cast("long").alias("ord")).filter("false")
    old = corpus.session_numbers(found.filter(F.length("original") % 3 == 0).withColumn("by", F.col("original")), none, ["by"])
    return corpus.session_numbers(found, old, ["doc_id", "start"])


# The model's labels and those that users add, here the market segments and part types
_DEFAULTS = " UNION ALL ".join(f"SELECT '{x}' AS label" for x in decode.SPAN_LABELS)


@query(f"""
SELECT label, CASE WHEN label IN (SELECT label FROM ({_DEFAULTS})) THEN 'default' ELSE 'custom' END AS origin
FROM (SELECT label FROM ({_DEFAULTS}) UNION SELECT lower(trim(c_mktsegment)) FROM customer UNION SELECT lower(trim(p_type)) FROM part) WHERE label <> ''""")  # fmt: skip
def active_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("label")).unionByName(table(spark, sf_dir, "part").select(F.col("p_type").alias("label")))
    return decode.active_label_rows(own)


# T3, and the file helpers
@query("SELECT user_id, arg_max(event_id, ts) AS event_id, max(ts) AS ts FROM events GROUP BY user_id")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"])


_NAME = "concat(p_name, CASE WHEN p_partkey % 4 = 0 THEN '.DOCX' WHEN p_partkey % 4 = 1 THEN '.v2.doc' WHEN p_partkey % 4 = 2 THEN '.pdf' ELSE '' END)"


@query(f"""SELECT p_partkey, name, CASE WHEN contains(name, '.') THEN lower(regexp_extract(name, '[^.]*$')) ELSE '' END AS extension,
       lower(regexp_extract(name, '[^.]*$')) IN ('docx', 'doc') AND contains(name, '.') AS supported,
       CASE WHEN contains(name, '.') THEN regexp_replace(name, '\\.([^.]*)$', '_redacted.\\1') ELSE name || '_redacted' END AS redacted_name
FROM (SELECT p_partkey, {_NAME} AS name FROM part)""")  # fmt: skip
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_NAME).alias("name"))
    return rows.select("p_partkey", "name", sources.extension(F.col("name")).alias("extension"), sources.supported(F.col("name")).alias("supported"), sources.redacted_name(F.col("name")).alias("redacted_name"))


@query("""SELECT conv_id, turn, regexp_replace(translate(regexp_replace(t, '\\r\\n?', chr(10), 'g'), chr(7) || chr(11) || chr(12), chr(9) || chr(10) || chr(10)), '[\\x01-\\x06\\x08\\x0e-\\x1f]', '', 'g') AS clean
FROM (SELECT conv_id, turn, replace(replace(text, ' ', chr(13) || chr(10) || chr(7) || chr(1)), ',', chr(11) || chr(13) || chr(12) || chr(31)) AS t FROM conversations)""")
def control_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.replace(F.replace("text", F.lit(" "), F.lit("\r\n\x07\x01")), F.lit(","), F.lit("\x0b\r\x0c\x1f"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", sources.control_characters(noisy).alias("clean"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


