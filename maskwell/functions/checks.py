"""Checksums of identifiers as Column predicates: digit arithmetic only, no Python at run time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def digit(v: Column, i: int) -> Column:
    """The i-th character, from 0, as a number."""
    return F.substring(v, i + 1, 1).try_cast("int")


def total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def weighted(v: Column, weights: list[int], skip: int = -1) -> Column:
    """Sum of digits times weights; at ``skip`` stands the check digit itself."""
    return total([digit(v, i) * w for i, w in enumerate(weights) if i != skip])


def sized(v: Column, n: int) -> Column:
    return F.length(v) == n


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def doubled(d: Column) -> Column:
    """Twice a digit, by its digit sum."""
    return F.when(d > 4, d * 2 - 9).otherwise(d * 2)


def luhn_sum(v: Column) -> Column:
    """Luhn sum of a string of digits of any length: every second one from the right counts double."""
    back = F.transform(F.split(F.reverse(v), ""), lambda x, i: F.when(i % 2 == 1, doubled(x.try_cast("int"))).otherwise(x.try_cast("int")))
    return F.aggregate(back, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))


def luhn(v: Column) -> Column:
    d = F.regexp_replace(v, r"[\s-]", "")
    return sure(d.rlike("^[0-9]+$") & (luhn_sum(d) % 10 == 0))


def letter_value(c: Column) -> Column:
    """A digit as it is, A as 10 and on to Z as 35."""
    return F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)


def iban(v: Column) -> Column:
    """The remainder by 97 of the rearranged number is 1."""
    clean = F.upper(F.regexp_replace(v, r"\s", ""))
    turned = F.concat(F.substring(clean, 5, 34), F.substring(clean, 1, 4))
    step = lambda acc, c: (acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + letter_value(c)) % 97
    return sure(F.length(clean).between(5, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c)).try_cast("int")) == 1))


def ipv4(v: Column) -> Column:
    return sure(F.forall(F.split(v, r"\."), lambda x: x.try_cast("int").between(0, 255)))


def gb_nino(v: Column) -> Column:
    clean = F.upper(F.regexp_replace(v, r"\s", ""))
    # Letters and prefixes that are never issued
    return ~clean.rlike("^[DFIQUV]") & ~clean.rlike("^.[DFIOQU]") & ~F.substring(clean, 1, 2).isin("BG", "GB", "NK", "KN", "TN", "NT", "ZZ")


def gb_nhs(v: Column) -> Column:
    d = digits(v)
    rest = 11 - weighted(d, [10, 9, 8, 7, 6, 5, 4, 3, 2]) % 11
    return sure(sized(d, 10) & (rest != 10) & (rest % 11 == digit(d, 9)))


def pl_pesel(v: Column) -> Column:
    d = digits(v)
    return sure(sized(d, 11) & ((10 - weighted(d, [1, 3, 7, 9, 1, 3, 7, 9, 1, 3]) % 10) % 10 == digit(d, 10)))


def pl_nip(v: Column) -> Column:
    d = digits(v)
    return sure(sized(d, 10) & (weighted(d, [6, 5, 7, 2, 3, 4, 5, 6, 7]) % 11 == digit(d, 9)))


def pl_id_card(v: Column) -> Column:
    clean = F.upper(F.regexp_replace(v, r"\s", ""))
    weights = [7, 3, 1, 0, 7, 3, 1, 7, 3]
    s = total([letter_value(F.substring(clean, i + 1, 1)) * w for i, w in enumerate(weights) if i != 3])
    return sure(sized(clean, 9) & (s % 10 == digit(clean, 3)))


def pl_regon(v: Column) -> Column:
    d = digits(v)
    short = weighted(d, [8, 9, 2, 3, 4, 5, 6, 7]) % 11 % 10 == digit(d, 8)
    long = weighted(d, [2, 4, 8, 5, 0, 9, 7, 3, 6, 1, 2, 4, 8]) % 11 % 10 == digit(d, 13)
    return sure(F.when(sized(d, 9), short).when(sized(d, 14), long).otherwise(False))


def de_steuerid(v: Column) -> Column:
    """ISO 7064 mod 11, 10."""
    d = digits(v)

    def step(product: Column, x: Column) -> Column:
        s = (x.try_cast("int") + product) % 10
        return (F.when(s == 0, 10).otherwise(s) * 2 % 11).try_cast("int")

    product = F.aggregate(F.slice(F.split(d, ""), 1, 10), F.lit(10), step)
    return sure(F.when(sized(d, 11) & (digit(d, 0) != 0), (11 - product) % 10 == digit(d, 10)).otherwise(False))


def fr_nir(v: Column) -> Column:
    d = digits(v)
    key = 97 - F.substring(d, 1, 13).try_cast("long") % 97
    return sure(sized(d, 15) & F.substring(d, 1, 1).isin("1", "2") & (key == F.substring(d, 14, 2).try_cast("long")))


# The control letters by remainder
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
HETU_CHARACTERS = "0123456789ABCDEFHJKLMNPRSTUVWXY"


def letter_at(letters: str, i: Column) -> Column:
    return F.substring(F.lit(letters), i.try_cast("int") + 1, 1)


def es_dni(v: Column) -> Column:
    clean = F.upper(F.regexp_replace(v, r"[\s-]", ""))
    number = F.regexp_replace(clean, ".$", "").try_cast("long")
    return sure(letter_at(DNI_LETTERS, number % 23) == F.right(clean, F.lit(1)))


def pt_nif(v: Column) -> Column:
    d = digits(v)
    r = weighted(d, [9, 8, 7, 6, 5, 4, 3, 2]) % 11
    return sure(sized(d, 9) & ~digit(d, 0).isin(0, 3, 4, 7) & (F.when(r < 2, 0).otherwise(11 - r) == digit(d, 8)))


def se_personnummer(v: Column) -> Column:
    """Luhn over the last ten characters; a + survives the clean-up, so numbers with one fail."""
    clean = F.regexp_replace(v, r"[\s-]", "")
    day = F.substring(F.regexp_replace(v, r"[-+]", ""), 5, 2).try_cast("int")
    last = F.right(clean, F.lit(10))
    s = total([doubled(digit(last, i)) if i % 2 == 0 else digit(last, i) for i in range(9)])
    return sure((F.length(clean) >= 10) & (day < 61) & ((10 - s % 10) % 10 == digit(last, 9)))


def se_samordningsnummer(v: Column) -> Column:
    d = F.regexp_replace(v, r"[-+]", "")
    return sure((F.length(d) >= 10) & (F.substring(d, 5, 2).try_cast("int") >= 61))


def no_fodselsnummer(v: Column) -> Column:
    d = digits(v)
    one = (11 - weighted(d, [3, 7, 6, 1, 8, 9, 4, 5, 2]) % 11) % 11
    two = (11 - weighted(d, [5, 4, 3, 2, 7, 6, 5, 4, 3, 2]) % 11) % 11
    return sure(sized(d, 11) & (F.substring(d, 1, 2).try_cast("int") < 41) & (one != 10) & (one == digit(d, 9)) & (two != 10) & (two == digit(d, 10)))


def no_d_nummer(v: Column) -> Column:
    d = digits(v)
    return sure(sized(d, 11) & F.substring(d, 1, 2).try_cast("int").between(41, 71))


# What letters A to Z count at odd places of a fiscal code; digits count as the letters A to J
CODICE_ODD = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]


def it_codice_fiscale(v: Column) -> Column:
    code = F.upper(v)
    odd = F.array(*[F.lit(x) for x in CODICE_ODD])

    def value(i: int) -> Column:
        c = F.substring(code, i + 1, 1)
        n = F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 65)
        return F.try_element_at(odd, (n + 1).try_cast("int")) if i % 2 == 0 else n

    return sure(sized(code, 16) & (F.chr(total([value(i) for i in range(15)]) % 26 + 65) == F.substring(code, 16, 1)))


def it_partita_iva(v: Column) -> Column:
    d = F.regexp_replace(F.upper(v), "^IT", "")
    s = total([doubled(digit(d, i)) if i % 2 else digit(d, i) for i in range(11)])
    return sure(d.rlike("^[0-9]{11}$") & (s % 10 == 0))


def nl_bsn(v: Column) -> Column:
    s = weighted(v, [9, 8, 7, 6, 5, 4, 3, 2, -1])
    return sure(v.rlike("^[0-9]{9}$") & (s > 0) & (s % 11 == 0))


def be_national_register(v: Column) -> Column:
    d = F.regexp_replace(v, r"[\s.-]", "")
    check = F.substring(d, 10, 2).try_cast("long")
    before = 97 - F.substring(d, 1, 9).try_cast("long") % 97
    since = 97 - F.concat(F.lit("2"), F.substring(d, 1, 9)).try_cast("long") % 97
    return sure(d.rlike("^[0-9]{11}$") & ((before == check) | (since == check)))


def at_svnr(v: Column) -> Column:
    d = F.regexp_replace(v, r"\s", "")
    s = weighted(d, [3, 7, 9, 0, 5, 8, 4, 2, 1, 6], skip=3) % 11
    return sure(d.rlike("^[0-9]{10}$") & (F.substring(d, 1, 3).try_cast("int") >= 100) & (s != 10) & (s == digit(d, 3)))


def ch_ahv(v: Column) -> Column:
    d = F.regexp_replace(v, r"[\s.]", "")
    return sure(sized(d, 13) & d.startswith("756") & ((10 - weighted(d, [1, 3] * 6) % 10) % 10 == digit(d, 12)))


def ie_pps(v: Column) -> Column:
    up = F.upper(v)
    suffix = F.substring(up, 9, 1)
    more = F.when((F.length(up) > 8) & (suffix != "W"), (F.ascii(suffix) - 64) * 9).otherwise(0)
    r = (weighted(up, [8, 7, 6, 5, 4, 3, 2]) + more) % 23
    return sure(F.substring(up, 8, 1) == F.when(r == 0, "W").otherwise(F.chr(r + 64)))


def fi_hetu(v: Column) -> Column:
    up = F.upper(v)
    number = F.concat(F.substring(up, 1, 6), F.substring(up, 8, 3)).try_cast("long")
    return sure(letter_at(HETU_CHARACTERS, number % 31) == F.substring(up, 11, 1))


def us_aba(v: Column) -> Column:
    d = digits(v)
    return sure(sized(d, 9) & (weighted(d, [3, 7, 1] * 3) % 10 == 0))


def us_npi(v: Column) -> Column:
    """Luhn with the prefix 80840 before the first nine digits."""
    d = digits(v)
    return sure(sized(d, 10) & (luhn_sum(F.concat(F.lit("80840"), d)) % 10 == 0))


def us_dea(v: Column) -> Column:
    d = F.substring(v, 3, 7)
    s = digit(d, 0) + digit(d, 2) + digit(d, 4) + 2 * (digit(d, 1) + digit(d, 3) + digit(d, 5))
    return sure(F.upper(v).rlike("^[ABCDEFGHJKLMPRSTUX][A-Z][0-9]{7}$") & (s % 10 == digit(d, 6)))
