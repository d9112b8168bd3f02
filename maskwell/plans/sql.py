"""Pieces of oracle SQL: scanning by rules, checks, overlap resolution, numbering, rewriting."""

from __future__ import annotations

from maskwell.functions.checks import CODICE_ODD, DNI_LETTERS, HETU_CHARACTERS
from maskwell.rules.base import WHITE, Rule
from maskwell.rules.catalogue import ORDER

DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"


def quote(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _d(i: int, v: str = "d") -> str:
    return f"substr({v}, {i + 1}, 1)::INT"


def _sum(weights: list[int], v: str = "d", skip: int = -1) -> str:
    return "(" + " + ".join(f"{_d(i, v)} * {w}" for i, w in enumerate(weights) if i != skip) + ")"


def _double(x: str) -> str:
    return f"(CASE WHEN {x} > 4 THEN {x} * 2 - 9 ELSE {x} * 2 END)"


def _luhn(v: str) -> str:
    return f"list_sum([CASE WHEN i % 2 = 0 THEN {_double('substr(reverse(%s), i, 1)::INT' % v)} ELSE substr(reverse({v}), i, 1)::INT END for i in range(1, length({v}) + 1)]) % 10 = 0"


def _let(expressions: dict[str, str], condition: str, result: str) -> str:
    """CASE WHEN condition THEN result with names bound by nested lambdas over one-element lists."""
    body = f"CASE WHEN {condition} THEN {result} ELSE false END"
    for name, value in reversed(expressions.items()):
        body = f"list_transform([{value}], lambda {name}: {body})[1]"
    return f"coalesce({body}, false)"


def _letter(c: str) -> str:
    return f"(CASE WHEN {c} BETWEEN '0' AND '9' THEN ascii({c}) - 48 ELSE ascii({c}) - 55 END)"


_CODICE = " + ".join(
    f"(CASE WHEN {c} BETWEEN '0' AND '9' THEN {f'[{",".join(map(str, CODICE_ODD))}][ascii({c}) - 47]' if i % 2 == 0 else f'ascii({c}) - 48'} ELSE {f'[{",".join(map(str, CODICE_ODD))}][ascii({c}) - 64]' if i % 2 == 0 else f'ascii({c}) - 65'} END)"
    for i in range(15)
    for c in [f"substr(d, {i + 1}, 1)"]
)
_ISO = "list_reduce([substr(d, i, 1)::INT for i in range(1, 11)], lambda p, x: CASE WHEN (x + p) % 10 = 0 THEN 20 % 11 ELSE (x + p) % 10 * 2 % 11 END, 10)"
CHECKS = {
    "luhn": _let({"d": "regexp_replace(v, '[\\s-]', '', 'g')"}, "regexp_full_match(d, '[0-9]+')", _luhn("d")),
    "iban": _let(
        {"d": "upper(regexp_replace(v, '\\s', '', 'g'))", "t": "substr(d, 5) || substr(d, 1, 4)"},
        "length(d) BETWEEN 5 AND 34",
        f"list_reduce([{_letter('substr(t, i, 1)')} for i in range(1, length(t) + 1)], lambda a, x: (a * CASE WHEN x < 10 THEN 10 ELSE 100 END + x) % 97, 0) = 1",
    ),
    "ipv4": "len(list_filter(string_split(v, '.'), lambda x: x::INT > 255)) = 0",
    "gb_nino": _let({"d": "upper(regexp_replace(v, '\\s', '', 'g'))"}, "true", "NOT regexp_matches(d, '^[DFIQUV]') AND NOT regexp_matches(d, '^.[DFIOQU]') AND substr(d, 1, 2) NOT IN ('BG','GB','NK','KN','TN','NT','ZZ')"),
    "gb_nhs": _let({"d": DIGITS, "s": f"11 - {_sum([10, 9, 8, 7, 6, 5, 4, 3, 2])} % 11"}, "length(d) = 10", f"s <> 10 AND s % 11 = {_d(9)}"),
    "pl_pesel": _let({"d": DIGITS}, "length(d) = 11", f"(10 - {_sum([1, 3, 7, 9, 1, 3, 7, 9, 1, 3])} % 10) % 10 = {_d(10)}"),
    "pl_nip": _let({"d": DIGITS}, "length(d) = 10", f"{_sum([6, 5, 7, 2, 3, 4, 5, 6, 7])} % 11 = {_d(9)}"),
    "pl_id_card": _let({"d": "upper(regexp_replace(v, '\\s', '', 'g'))"}, "length(d) = 9", "(" + " + ".join(f"{_letter(f'substr(d, {i + 1}, 1)')} * {w}" for i, w in enumerate([7, 3, 1, 0, 7, 3, 1, 7, 3]) if i != 3) + f") % 10 = {_d(3)}"),
    "pl_regon": _let({"d": DIGITS}, "length(d) IN (9, 14)", f"CASE WHEN length(d) = 9 THEN {_sum([8, 9, 2, 3, 4, 5, 6, 7])} % 11 % 10 = {_d(8)} ELSE {_sum([2, 4, 8, 5, 0, 9, 7, 3, 6, 1, 2, 4, 8])} % 11 % 10 = {_d(13)} END"),
    "de_steuerid": _let({"d": DIGITS}, "length(d) = 11 AND substr(d, 1, 1) <> '0'", f"(11 - {_ISO}) % 10 = {_d(10)}"),
    "fr_nir": _let({"d": DIGITS}, "length(d) = 15 AND substr(d, 1, 1) IN ('1', '2')", "97 - substr(d, 1, 13)::BIGINT % 97 = substr(d, 14, 2)::BIGINT"),
    "es_dni": _let({"d": "upper(regexp_replace(v, '[\\s-]', '', 'g'))"}, "true", f"substr('{DNI_LETTERS}', (left(d, length(d) - 1)::BIGINT % 23 + 1)::INT, 1) = right(d, 1)"),
    "pt_nif": _let({"d": DIGITS, "s": f"{_sum([9, 8, 7, 6, 5, 4, 3, 2])} % 11"}, "length(d) = 9", f"substr(d, 1, 1) NOT IN ('0','3','4','7') AND CASE WHEN s < 2 THEN 0 ELSE 11 - s END = {_d(8)}"),
    "se_personnummer": _let(
        {"d": "regexp_replace(v, '[\\s-]', '', 'g')", "l": "right(d, 10)"},
        "length(d) >= 10 AND NOT contains(v, '+')",
        f"substr(regexp_replace(v, '[-+]', '', 'g'), 5, 2)::INT < 61 AND (10 - ({' + '.join(_double(_d(i, 'l')) if i % 2 == 0 else _d(i, 'l') for i in range(9))}) % 10) % 10 = {_d(9, 'l')}",
    ),
    "se_samordningsnummer": _let({"d": "regexp_replace(v, '[-+]', '', 'g')"}, "length(d) >= 10", "substr(d, 5, 2)::INT >= 61"),
    "no_fodselsnummer": _let(
        {"d": DIGITS, "a": f"(11 - {_sum([3, 7, 6, 1, 8, 9, 4, 5, 2])} % 11) % 11", "b": f"(11 - {_sum([5, 4, 3, 2, 7, 6, 5, 4, 3, 2])} % 11) % 11"},
        "length(d) = 11",
        f"substr(d, 1, 2)::INT < 41 AND a <> 10 AND a = {_d(9)} AND b <> 10 AND b = {_d(10)}",
    ),
    "no_d_nummer": _let({"d": DIGITS}, "length(d) = 11", "substr(d, 1, 2)::INT BETWEEN 41 AND 71"),
    "it_codice_fiscale": _let({"d": "upper(v)"}, "length(d) = 16", f"chr((({_CODICE}) % 26 + 65)::INT) = substr(d, 16, 1)"),
    "it_partita_iva": _let({"d": "regexp_replace(upper(v), '^IT', '')"}, "regexp_full_match(d, '[0-9]{11}')", "(" + " + ".join(_double(_d(i)) if i % 2 else _d(i) for i in range(11)) + ") % 10 = 0"),
    "nl_bsn": _let({"d": "v", "s": _sum([9, 8, 7, 6, 5, 4, 3, 2, -1])}, "regexp_full_match(d, '[0-9]{9}')", "s > 0 AND s % 11 = 0"),
    "be_national_register": _let({"d": "regexp_replace(v, '[\\s.-]', '', 'g')"}, "regexp_full_match(d, '[0-9]{11}')", "97 - substr(d, 1, 9)::BIGINT % 97 = substr(d, 10, 2)::BIGINT OR 97 - ('2' || substr(d, 1, 9))::BIGINT % 97 = substr(d, 10, 2)::BIGINT"),
    "at_svnr": _let({"d": "regexp_replace(v, '\\s', '', 'g')", "s": f"{_sum([3, 7, 9, 0, 5, 8, 4, 2, 1, 6], skip=3)} % 11"}, "regexp_full_match(d, '[0-9]{10}')", f"substr(d, 1, 3)::INT >= 100 AND s <> 10 AND s = {_d(3)}"),
    "ch_ahv": _let({"d": "regexp_replace(v, '[\\s.]', '', 'g')"}, "length(d) = 13 AND d[1:3] = '756'", f"(10 - {_sum([1, 3] * 6)} % 10) % 10 = {_d(12)}"),
    "ie_pps": _let({"d": "upper(v)", "r": f"({_sum([8, 7, 6, 5, 4, 3, 2])} + CASE WHEN length(d) > 8 AND substr(d, 9, 1) <> 'W' THEN (ascii(substr(d, 9, 1)) - 64) * 9 ELSE 0 END) % 23"}, "true", "substr(d, 8, 1) = CASE WHEN r = 0 THEN 'W' ELSE chr((r + 64)::INT) END"),
    "fi_hetu": _let({"d": "upper(v)"}, "true", f"substr('{HETU_CHARACTERS}', ((substr(d, 1, 6) || substr(d, 8, 3))::BIGINT % 31 + 1)::INT, 1) = substr(d, 11, 1)"),
    "us_aba": _let({"d": DIGITS}, "length(d) = 9", f"{_sum([3, 7, 1] * 3)} % 10 = 0"),
    "us_npi": _let({"d": DIGITS}, "length(d) = 10", _luhn("('80840' || d)")),
    "us_dea": _let({"d": "substr(v, 3, 7)"}, "regexp_full_match(upper(v), '[ABCDEFGHJKLMPRSTUX][A-Z][0-9]{7}')", f"({_d(0)} + {_d(2)} + {_d(4)} + 2 * ({_d(1)} + {_d(3)} + {_d(5)})) % 10 = {_d(6)}"),
}


def scan(source: str, rules: tuple[Rule, ...], key: str = "doc_id") -> str:
    """A SELECT of key, ord (of the rule), i, s, e, type, value, confidence, detector; source has (key, text)."""
    parts = []
    for rule in rules:
        check = CHECKS[rule.check.__name__] if rule.check else "true"
        p = quote(rule.re2)
        parts.append(f"""
SELECT {key}, {ORDER[rule.detector]} AS ord, i, s::INT AS s, (s + length(v))::INT AS e, '{rule.type}' AS type, v AS value,
       {rule.confidence}::DOUBLE AS confidence, '{rule.detector}' AS detector
FROM (SELECT {key}, i, hits[i] AS v,
             list_sum([length(x) for x in gaps[1:i]]) + coalesce(list_sum([length(x) for x in hits[1:i - 1]]), 0) AS s
      FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i
            FROM (SELECT {key}, regexp_split_to_array(text, {p}) AS gaps, regexp_extract_all(text, {p}) AS hits
                  FROM ({source}) WHERE regexp_matches(text, {p}))))
WHERE {check}""")
    return " UNION ALL ".join(parts)


def resolved(found: str, key: str = "doc_id") -> str:
    """A SELECT of key, s, e, type, value, confidence, detector: position first; found as by scan()."""
    return f"""
SELECT {key}, x.s AS s, x.e AS e, x.type AS type, x.value AS value, x.confidence AS confidence, x.detector AS detector
FROM (SELECT {key}, unnest(list_reduce(l, lambda a, x: CASE WHEN x.s >= a.at THEN {{'at': x.e, 'o': list_append(a.o, x)}} ELSE a END,
                                      {{'at': 0, 'o': l[1:0]}}).o) AS x
      FROM (SELECT {key}, list({{'s': s, 'e': e, 'type': type, 'value': value, 'confidence': confidence, 'detector': detector}}
                               ORDER BY s, e DESC, confidence DESC, ord, i) AS l
            FROM ({found}) GROUP BY {key}))"""


def numbered(spans: str, key: str = "doc_id") -> str:
    """Spans with n: the number of their value, in order of the values' last places, from the end."""
    return f"SELECT *, dense_rank() OVER (PARTITION BY {key} ORDER BY last_s DESC) AS n FROM (SELECT *, max(s) OVER (PARTITION BY {key}, value) AS last_s FROM ({spans}))"


def redacted(source: str, spans: str, label: str = "'<<REDACTED_' || n || '>>'", key: str = "doc_id") -> str:
    """A SELECT of key, n_spans, redacted; spans as by numbered(), without overlaps."""
    return f"""
SELECT d.{key}, count(x.s) AS n_spans,
       CASE WHEN count(x.s) = 0 THEN any_value(d.text)
            ELSE string_agg(substr(d.text, x.before + 1, x.s - x.before) || x.label, '' ORDER BY x.s) || any_value(substr(d.text, x.last_e + 1)) END AS redacted
FROM ({source}) d LEFT JOIN (
  SELECT {key} AS k, s, coalesce(lag(e) OVER w, 0) AS before, max(e) OVER (PARTITION BY {key}) AS last_e, {label} AS label
  FROM ({spans}) WINDOW w AS (PARTITION BY {key} ORDER BY s)) x ON d.{key} = x.k
GROUP BY d.{key}"""


def propagated(source: str, spans: str, key: str = "doc_id") -> str:
    """A SELECT of found spans (as by scan()) that a document's resolved spans lead to elsewhere in it."""
    boundary = quote("[" + WHITE + r".,;:!?()\"'„\-–—/]")
    white = quote(f"[{WHITE}]+")
    trim = f"regexp_replace(value, {quote(f'^[{WHITE}]+|[{WHITE}]+$')}, '', 'g')"
    return f"""
SELECT {key}, 1000 + term_no AS ord, p AS i, p::INT AS s, (p + length(term))::INT AS e, type, substr(text, p + 1, length(term)) AS value, 0.95::DOUBLE AS confidence, 'propagated' AS detector
FROM (
  SELECT h.*, row_number() OVER (PARTITION BY h.{key}, p, length(term) ORDER BY term_no) AS turn
  FROM (
    SELECT t.{key}, t.term, t.type, t.term_no, d.text, unnest(list_filter(range(0, length(d.text)), lambda q: substr(lower(d.text), q + 1, length(t.term)) = lower(t.term))) AS p
    FROM (
      SELECT {key}, term, type, row_number() OVER (PARTITION BY {key} ORDER BY s, part) AS term_no
      FROM (
        SELECT *, row_number() OVER (PARTITION BY {key}, lower(term) ORDER BY s, part) AS r
        FROM (
          SELECT {key}, s, 0 AS part, {trim} AS term, type FROM ({spans}) WHERE length({trim}) >= 3
          UNION ALL
          SELECT {key}, s, part, regexp_replace(w, '[.,;:!?()]+$', '') AS term, type
          FROM (SELECT {key}, s, type, unnest(regexp_split_to_array(v, {white})) AS w, unnest(range(1, 1 + len(regexp_split_to_array(v, {white})))) AS part
                FROM (SELECT {key}, s, type, {trim} AS v FROM ({spans})) WHERE contains(v, ' '))
          WHERE length(regexp_replace(w, '[.,;:!?()]+$', '')) >= 4))
      WHERE r = 1) t
    JOIN ({source}) d USING ({key})) h
  ANTI JOIN ({spans}) o ON h.{key} = o.{key} AND h.p = o.s AND h.p + length(h.term) = o.e
  WHERE (p = 0 OR regexp_matches(substr(text, p, 1), {boundary}))
    AND (p + length(term) >= length(text) OR regexp_matches(substr(text, (p + length(term) + 1)::BIGINT, 1), {boundary})))
WHERE turn = 1"""
