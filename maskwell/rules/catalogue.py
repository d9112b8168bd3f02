"""The rules in order; their order is the last tie-break of overlap resolution.

Fixed values: word lists, prefixes, formats and confidences below are those that results depend on.
"""

from __future__ import annotations

from maskwell.functions import checks as check
from maskwell.rules.base import Rule
from maskwell.rules.examples import EXAMPLES
from maskwell.rules.shapes import DASH, GAP, amount_words, company, groups, named_street, phone, place, word

DOMAINS = ("financial", "medical", "legal", "hr", "identity", "contact", "technical", "general")
TYPES = ("PERSON", "EMAIL", "PHONE", "ADDRESS", "SSN", "CREDIT_CARD", "IBAN", "DATE", "IP_ADDRESS", "COMPANY", "CURRENCY", "OTHER")
REGIONS = ("gb", "pl", "de", "fr", "es", "pt", "se", "no", "it", "nl", "be", "at", "ch", "ie", "dk", "fi", "us")

AMOUNT = r"\d{1,3}(?:[,.%s]\d{3})*(?:[.,]\d{1,2})?"
SIGNS = "$€£¥₹₽₩₺₴"
CODES = (
    "USD EUR GBP CHF JPY PLN SEK NOK DKK CZK HUF RON BGN HRK RUB UAH TRY BRL ARS MXN COP CLP PEN INR CNY KRW AUD CAD NZD ZAR SGD HKD TWD THB MYR IDR PHP VND "
    "AED SAR QAR KWD BHD OMR ILS EGP NGN KES GHS TZS UGX"
)
LOCAL_UNITS = r"zł kr Kč lei лв Ft kn ₽ грн ₺ R\$ S/\. руб ₹ 元 圆 円 원 ر\.س ر\.ق د\.إ ₪ ₦ ₵ ₱ ₫ ₸ ₼ ₾ ฿ RM Rp đ"
MONTHS = "Jan(?:uary)? Feb(?:ruary)? Mar(?:ch)? Apr(?:il)? May June? July? Aug(?:ust)? Sep(?:tember)? Oct(?:ober)? Nov(?:ember)? Dec(?:ember)?"
OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
DAY, MONTH = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|1[0-2])"
PAYABLE = "in%S+(?:the%S+)?(?:amount|sum)%S+of|pay(?:able)?(?:%S+the%S+(?:amount|sum))?%S+of"
GB_STREETS = (
    "Street St Road Rd Avenue Ave Lane Ln Drive Dr Close Cl Crescent Cres Terrace Terr Place Pl Gardens Gdns Grove Way Court Ct Square Sq Mews Row Rise Hill Park "
    "Gate Walk Green Parade Wharf"
)
US_STREETS = (
    "Street St Road Rd Avenue Ave Boulevard Blvd Lane Ln Drive Dr Court Ct Circle Cir Place Pl Square Sq Terrace Ter Trail Trl Parkway Pkwy Highway Hwy Way Plaza "
    "Plz Loop Alley Aly Crossing Xing Expressway Expy Freeway Fwy"
)
GERMAN_ID = "CFGHJKLMNPRTVWXYZ"


def any_of(words: str) -> str:
    return f"(?:{'|'.join(words.split())})"


def _rules(region: str, *rows: tuple) -> list[Rule]:
    """rows: name, type, confidence, template, domains, then check and flags or lead or first by name."""
    return [Rule(region, n, t, c, p, tuple(d.split()), examples=(EXAMPLES[f"{region}:{n}"],), **(more[0] if more else {})) for n, t, c, p, d, *more in rows]


UNIVERSAL = _rules(
    "universal",
    ("email", "EMAIL", 0.95, r"[0-9A-Za-z._%+-]+@[0-9A-Za-z.-]+\.[A-Za-z]{2,}", "contact"),
    ("phone_intl", "PHONE", 0.85, r"\+\d[\d%s()-]{7,18}\d", "contact"),
    ("iban", "IBAN", 0.9, word(rf"[A-Z]{{2}}{GAP}\d{{2}}{GAP}[A-Z\d%s]{{10,30}}"), "financial", {"check": check.iban}),
    ("credit_card", "CREDIT_CARD", 0.9, word(groups(4, 4, 4, "1,7", by=DASH)), "financial", {"check": check.luhn}),
    ("currency_symbol_prefix", "CURRENCY", 0.8, f"[{SIGNS}]{GAP}{AMOUNT}%b", "financial"),
    ("currency_code_suffix", "CURRENCY", 0.8, word(f"{AMOUNT}{GAP}{any_of(CODES)}"), "financial"),
    ("currency_symbol_suffix", "CURRENCY", 0.85, rf"%b{AMOUNT}{GAP}{any_of(LOCAL_UNITS)}(?=%S|\z|[.,;:!?)}}\]])", "financial"),
    ("ipv4", "IP_ADDRESS", 0.9, word(rf"(?:{OCTET}\.){{3}}{OCTET}"), "technical", {"check": check.ipv4}),
    ("ipv6", "IP_ADDRESS", 0.9, word("(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"), "technical"),
    ("mac_address", "OTHER", 0.85, word("[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}"), "technical"),
    ("date_numeric", "DATE", 0.75, word(r"\d{1,2}[./]\d{1,2}[./]\d{4}"), "general"),
    ("date_iso", "DATE", 0.8, word(groups(4, 2, 2, by="-")), "general"),
    ("date_word", "DATE", 0.8, word(r"\d{1,2}%S+%L{3,}%S+\d{4}"), "general"),
    ("date_month_first", "DATE", 0.85, word(rf"{any_of(MONTHS)}%S+\d{{1,2}},?%S+\d{{4}}"), "general", {"flags": "i"}),
    ("labeled_id", "SSN", 0.7, rf"(?<=%L[%L%s]{{0,30}}[:#]%S?)[A-Z0-9]{{2,4}}{DASH}\d{{4,}}(?:[%s-]\d+)*", "identity general", {"flags": "iu"}),
    ("long_number", "SSN", 0.5, rf"(?<![.\d]){word(r'\d[\d%s-]{7,}\d')}(?![.\d])", "identity financial"),
    ("postal_city", "ADDRESS", 0.65, word(rf"\d{{2,5}}{DASH}\d{{2,4}}%S+%L%L+"), "contact"),
)

GB = _rules(
    "gb",
    ("nino", "SSN", 0.9, word(rf"[A-Z]{{2}}{GAP}{groups(2, 2, 2)}{GAP}[A-D]"), "identity hr financial", {"check": check.gb_nino, "flags": "i"}),
    ("nhs", "SSN", 0.6, word(groups(3, 3, 4)), "medical identity", {"check": check.gb_nhs}),
    ("passport", "SSN", 0.4, word(groups(9)), "identity"),
    ("sort_code", "OTHER", 0.65, word(groups(2, 2, 2, by="-")), "financial"),
    ("bank_account", "OTHER", 0.3, word(groups("7,8")), "financial"),
    ("vat", "SSN", 0.75, word(rf"(?:GB)?{groups(3, 4, 2)}(?:{GAP}\d{{3}})?"), "financial legal", {"flags": "i"}),
    ("phone_landline", "PHONE", 0.8, word(f"0{groups(4, 6)}"), "contact"),
    ("phone_mobile", "PHONE", 0.85, word(f"07{groups(3, 6)}"), "contact"),
    ("postcode", "ADDRESS", 0.8, word(rf"[A-Z]{{1,2}}\d[A-Z\d]?{GAP}\d[A-Z]{{2}}"), "contact", {"flags": "i"}),
    ("currency_words", "CURRENCY", 0.9, amount_words(rf"(?:{PAYABLE})%S+", "pounds?|pence|sterling"), "financial", {"flags": "iu"}),
    ("street", "ADDRESS", 0.85, rf"%b\d{{1,4}}[A-Z]?%S+[A-Z]\w+(?:%S+[A-Z]\w+)*%S+{any_of(GB_STREETS)}\.?%b", "contact", {"flags": "i"}),
    ("company", "COMPANY", 0.85, company(r"Ltd\.?|PLC|LLP|L\.L\.P\.", comma=True), "legal financial", {"lead": "%s&.'"}),
)

PL = _rules(
    "pl",
    ("pesel", "SSN", 0.9, word(r"\d{2}[0-3]\d[0-3]\d{6}"), "identity hr medical", {"check": check.pl_pesel}),
    ("id_card", "SSN", 0.8, word(rf"[A-Z]{{3}}{GAP}\d{{6}}"), "identity", {"check": check.pl_id_card}),
    ("passport", "SSN", 0.7, word(rf"[A-Z]{{2}}{GAP}\d{{7}}"), "identity"),
    ("nip", "SSN", 0.85, word(groups(3, 3, 2, 2, by="-?")), "financial legal", {"check": check.pl_nip}),
    ("regon", "SSN", 0.6, word(r"\d{9}(?:\d{5})?"), "financial legal", {"check": check.pl_regon}),
    ("bank_account", "OTHER", 0.85, word(groups(*[4] * 6, 2)), "financial"),
    ("phone", "PHONE", 0.8, phone("48", groups(3, 3, 3, by=DASH)), "contact"),
    ("postal", "ADDRESS", 0.8, place(r"\d{2}-\d{3}"), "contact"),
    ("currency_words", "CURRENCY", 0.9, r"słownie:%S*[%L%s]+(?:złot(?:ych|y|e)|groszy|grosze?)%b", "financial", {"flags": "iu"}),
    ("street", "ADDRESS", 0.9, r"(?:ul|al|pl|os)\.%S+%L[%L%s]+%S+\d+%L?(?:%S*[/\\]%S*\d+%L?)?", "contact"),
    ("company", "COMPANY", 0.9, company(r"Sp(?:ółka)?%S*z%S*o\.?%S*o\.?|Spółka%S+z%S+ograniczon%L+%S+odpowiedzialno%L+|Sp\.%S*j\.|S\.A\.|Sp\.%S*k\.", more="", end="", space=False), "legal financial", {"lead": "%s"}),
    ("court_case", "OTHER", 0.9, word(rf"[IVXLCDM]+%S+{any_of('K C Ca Cz Co Gz Ga GCo GC')}%S+\d+/\d{{2,4}}"), "legal"),
    ("krs", "OTHER", 0.9, word(groups(4, 8, 4, by="/")), "legal financial"),
)

DE = _rules(
    "de",
    ("personalausweis", "SSN", 0.75, word(rf"[{GERMAN_ID}]\d{{2}}[{GERMAN_ID}0-9]{{6}}\d"), "identity"),
    ("passport", "SSN", 0.75, word(rf"[{GERMAN_ID}]\d{{2}}[{GERMAN_ID}0-9]{{5}}\d[A-Z]\d{{7}}"), "identity"),
    ("steuernummer", "SSN", 0.6, word(groups("2,3", 3, "4,5", by="/?")), "financial"),
    ("steuerid", "SSN", 0.8, word(groups(2, 3, 3, 3)), "financial identity", {"check": check.de_steuerid}),
    ("vat", "SSN", 0.65, word(r"(?:DE)?\d{9}"), "financial legal", {"flags": "i"}),
    ("phone", "PHONE", 0.7, phone("49", rf"\(?\d{{2,5}}\)?{DASH}\d{{3,10}}"), "contact"),
    ("postal", "ADDRESS", 0.8, place(r"\d{5}"), "contact"),
    ("currency_words", "CURRENCY", 0.9, amount_words("in%S+(?:Höhe|Worten?)%S+(?:von%S+)?|(?:Betrag|Summe)%S+von%S+", "Euro|Cent"), "financial", {"flags": "iu"}),
    ("street", "ADDRESS", 0.9, named_street(r"straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer|chaussee", r"\d+%L?(?:%S*[/\\]%S*\d+)?"), "contact", {"flags": "iu", "lead": "%s-"}),
    ("company", "COMPANY", 0.9, company(r"GmbH|AG|KG|OHG|e\.?%S?V\.?|GbR|UG|mbH|KGaA", more="&."), "legal financial", {"lead": "%s&."}),
    ("icd10gm", "OTHER", 0.55, word(rf"[A-Z]\d{{2}}(?:\.\d{{1,2}})?(?:{GAP}[GLRAZ])?"), "medical"),
    ("sozialversicherung", "SSN", 0.75, word(rf"\d{{2}}{DAY}{MONTH}\d{{2}}[A-Z]\d{{3}}"), "hr identity", {"flags": "i"}),
)

FR = _rules(
    "fr",
    ("nir", "SSN", 0.9, word(rf"[12]{GAP}{groups(2, 2, 2, 3, 3)}(?:{GAP}\d{{2}})?"), "identity medical hr", {"check": check.fr_nir}),
    ("passport", "SSN", 0.75, word(r"\d{2}[A-Z]{2}\d{5}"), "identity"),
    ("cni", "SSN", 0.4, word(groups(12)), "identity"),
    ("siret", "SSN", 0.65, word(rf"{groups(3, 3, 3)}(?:{GAP}\d{{5}})?"), "financial legal"),
    ("vat", "SSN", 0.75, word(f"(?:FR)?{groups(2, 9)}"), "financial legal", {"flags": "i"}),
    ("phone", "PHONE", 0.85, word(rf"0[1-9](?:{GAP}\d{{2}}){{4}}"), "contact"),
    ("postal", "ADDRESS", 0.8, place(r"\d{5}", "'"), "contact"),
    ("currency_words", "CURRENCY", 0.9, amount_words(r"(?:soit|montant)%S+(?:en%S+)?(?:lettres?|toutes?%S+lettres?)%S*:%S*|(?:la%S+)?somme%S+de%S+", "euros?|centimes?", "'"), "financial", {"flags": "iu"}),
    ("street", "ADDRESS", 0.9, r"%b\d{1,5}(?:%S*(?:bis|ter))?%S*,?%S*(?:rue|avenue|av\.|boulevard|bd\.?|place|pl\.|impasse|allée|passage|chemin|route|quai|cours|square|voie|sentier|résidence)%S+%L[%L%s'-]+", "contact", {"flags": "iu"}),
    ("company", "COMPANY", 0.9, company("SARL|SAS|SA|EURL|SCI|SNC|SASU"), "legal financial", {"lead": "%s&.'"}),
    ("carte_vitale", "OTHER", 0.7, word(groups(1, 2, 2, 3, 3)), "medical"),
)

ES = _rules(
    "es",
    ("dni", "SSN", 0.9, word(rf"\d{{8}}{DASH}[A-Z]"), "identity", {"check": check.es_dni, "flags": "i"}),
    ("nie", "SSN", 0.9, word(rf"[XYZ]{DASH}\d{{7}}{DASH}[A-Z]"), "identity", {"flags": "i"}),
    ("cif", "SSN", 0.8, word(r"[A-H]\d{7}[0-9A-J]"), "financial legal", {"flags": "i"}),
    ("cuenta_bancaria", "SSN", 0.8, word(f"(?:ES)?{groups(2, *[4] * 5)}"), "financial", {"flags": "i"}),
    ("phone", "PHONE", 0.8, phone("34", rf"[6789]{groups(2, 3, 3, by=DASH)}"), "contact"),
    ("postal", "ADDRESS", 0.75, place(r"\d{5}", "'"), "contact"),
    ("currency_words", "CURRENCY", 0.9, amount_words(r"(?:en%S+)?(?:letras?|palabras?)%S*:%S*|(?:la%S+)?(?:cantidad|suma)%S+de%S+", "euros?|céntimos?|pesos?|centavos?"), "financial", {"flags": "iu"}),
    ("street", "ADDRESS", 0.85, r"(?:C(?:alle)?|Av(?:enida|da)?|Avda|Pza|Plaza|Pl|Paseo|P\.º|Ronda|Ctra|Carretera|Camino|Travesía|Glorieta)\.?%S+%L[%L%s'-]+(?:,?%S*(?:n\.?º?%S*)?\d+)?", "contact", {"flags": "iu"}),
    ("company", "COMPANY", 0.9, company(r"S\.L\.U\.|S\.L\.U|S\.L\.|S\.L|S\.A\.U\.|S\.A\.U|S\.A\.|S\.A|S\.C\."), "legal financial", {"lead": "%s&.'"}),
    ("nuss", "SSN", 0.75, word(groups(2, 8, 2, by="[-/]?")), "medical hr"),
)

PT = _rules(
    "pt",
    ("cc", "SSN", 0.85, word(rf"\d{{9}}{GAP}[A-Z]{{2}}\d"), "identity", {"flags": "i"}),
    ("nif", "SSN", 0.8, word(groups(9)), "financial identity", {"check": check.pt_nif}),
    ("phone", "PHONE", 0.8, phone("351", groups(3, 3, 3, by=DASH)), "contact"),
    ("postal", "ADDRESS", 0.85, place(r"\d{4}-\d{3}", "'"), "contact"),
    ("currency_words", "CURRENCY", 0.9, amount_words(r"(?:por%S+)?extenso%S*:%S*|(?:a%S+)?(?:quantia|importância|soma)%S+de%S+", "euros?|cêntimos?|reais|centavos?"), "financial", {"flags": "iu"}),
    ("street", "ADDRESS", 0.85, r"(?:Rua|R\.|Avenida|Av\.|Praça|Pç\.|Travessa|Tv\.|Largo|Lg\.|Alameda|Al\.|Estrada|Est\.)%S+%L[%L%s'-]+(?:,?%S*(?:n\.?º?%S*)?\d+)?", "contact", {"flags": "iu"}),
    ("company", "COMPANY", 0.9, company(r"Lda\.?|S\.A\.?|SGPS"), "legal financial", {"lead": "%s&.'"}),
)

SE = _rules(
    "se",
    ("personnummer", "SSN", 0.85, word(groups(6, 4, by="[-+]?")), "identity hr medical", {"check": check.se_personnummer}),
    ("personnummer_12", "SSN", 0.9, word(f"(?:19|20){groups(6, 4, by='[-+]?')}"), "identity hr medical"),
    ("samordningsnummer", "SSN", 0.7, word(groups(6, 4, by="[-+]?")), "identity", {"check": check.se_samordningsnummer}),
    ("organisationsnummer", "SSN", 0.6, word(groups(6, 4, by="-?")), "financial legal"),
    ("phone", "PHONE", 0.75, phone("46", f"0?{groups('1,3', '2,3', 2, 2, by=DASH)}"), "contact"),
    ("postal", "ADDRESS", 0.8, place(groups(3, 2)), "contact"),
    ("currency_words", "CURRENCY", 0.9, amount_words("(?:med%S+)?(?:bokstäver|ord)%S*:%S*|(?:summan|beloppet)%S+", "kronor|öre"), "financial", {"flags": "iu"}),
    ("street", "ADDRESS", 0.9, named_street("gatan|vägen|stigen|torget|platsen|gränd|backen|liden|ängen"), "contact", {"flags": "iu", "lead": "%s-"}),
    ("company", "COMPANY", 0.8, company("AB|HB|KB", more="&."), "legal financial", {"lead": "%s&."}),
)

NO = _rules(
    "no",
    ("fodselsnummer", "SSN", 0.8, word(groups(6, 5)), "identity hr medical", {"check": check.no_fodselsnummer}),
    ("d_nummer", "SSN", 0.4, word(groups(6, 5)), "identity", {"check": check.no_d_nummer}),
    ("orgnr", "SSN", 0.6, word(rf"\d{{9}}{GAP}(?:MVA)?"), "financial legal"),
    ("phone", "PHONE", 0.8, phone("47", groups(2, 2, 2, 2, by=DASH)), "contact"),
    ("postal", "ADDRESS", 0.8, place(r"\d{4}"), "contact"),
    ("currency_words", "CURRENCY", 0.9, amount_words("(?:med%S+)?(?:bokstaver|ord)%S*:%S*|(?:summen|beløpet)%S+", "kroner|øre"), "financial", {"flags": "iu"}),
    ("street", "ADDRESS", 0.9, named_street("gata|gaten|gate|veien|vegen|vei|veg|stien|torget|plassen|plass|allé|alleen"), "contact", {"flags": "iu", "lead": "%s-"}),
    ("company", "COMPANY", 0.8, company("AS|ASA|ANS|DA"), "legal financial", {"lead": "%s&.'"}),
)

IT = _rules(
    "it",
    ("codice_fiscale", "SSN", 0.9, word(r"[A-Z]{6}\d{2}[A-EHLMPRST]\d{2}[A-Z]\d{3}[A-Z]"), "identity hr medical", {"check": check.it_codice_fiscale, "flags": "i"}),
    ("partita_iva", "SSN", 0.75, word(r"IT\d{11}"), "financial legal", {"check": check.it_partita_iva, "flags": "i"}),
    ("phone_mobile", "PHONE", 0.8, phone("39", f"3{groups(2, 3, 4, by=DASH)}"), "contact"),
    ("phone_landline", "PHONE", 0.7, phone("39", f"0{groups('1,3', '4,8', by=DASH)}"), "contact"),
    ("street", "ADDRESS", 0.9, r"(?:via|viale|v\.le|piazza|p\.zza|piazzale|corso|c\.so|largo|vicolo|borgo|salita)%S+%L[%L%s'.,-]+%S*(?:,?%S*n[°.]?%S*)?\d{1,5}%L?", "contact", {"flags": "iu"}),
    ("postal", "ADDRESS", 0.8, place(r"\d{5}"), "contact"),
    ("company", "COMPANY", 0.9, company(r"S\.?r\.?l\.?|S\.?p\.?A\.?|S\.?a\.?s\.?|S\.?n\.?c\.?|S\.?a\.?p\.?a\.?"), "legal financial", {"lead": "%s&.'"}),
)

NL = _rules(
    "nl",
    ("bsn", "SSN", 0.85, word(groups(9)), "identity hr", {"check": check.nl_bsn}),
    ("phone_mobile", "PHONE", 0.85, phone("31", rf"6{DASH}{groups(4, 4, by=DASH)}", trunk=True), "contact"),
    ("phone_landline", "PHONE", 0.75, phone("31", rf"[1-5]{groups(1, 3, 4, by=DASH)}", trunk=True), "contact"),
    ("postal", "ADDRESS", 0.8, word(rf"\d{{4}}{GAP}[A-Z]{{2}}"), "contact"),
    ("street", "ADDRESS", 0.85, named_street("straat|weg|laan|plein|gracht|kade|singel|dijk|steeg|dreef|hof|markt", r"\d{1,5}%L?", "'"), "contact", {"flags": "iu", "lead": "%s'-"}),
    ("company", "COMPANY", 0.9, company(r"B\.?V\.?|N\.?V\.?|V\.?O\.?F\.?|C\.?V\.?"), "legal financial", {"lead": "%s&.'"}),
)

BE = _rules(
    "be",
    ("national_register", "SSN", 0.9, word(r"\d{2}[.%s]?\d{2}[.%s]?\d{2}[-.%s]?\d{3}[.%s]?\d{2}"), "identity hr", {"check": check.be_national_register}),
    ("phone", "PHONE", 0.8, phone("32", rf"(?:4{groups(2, 2, 2, 2, by=DASH)}|[1-9]{groups('0,1', 3, 2, 2, by=DASH)})", trunk=True), "contact"),
    ("postal", "ADDRESS", 0.75, place(r"[1-9]\d{3}", "'"), "contact"),
    ("street", "ADDRESS", 0.85, named_street("straat|laan|weg|plein|steenweg|lei|dreef", r"\d{1,5}%L?", "'"), "contact",
     {"flags": "iu", "lead": "%s'-", "first": r"(?:straat|laan|weg|plein|steenweg|lei|dreef|boulevard|avenue|rue|place|chaussée)[%L%s'-]+\d{1,5}%L?"}),
)

AT = _rules(
    "at",
    ("svnr", "SSN", 0.85, word(rf"[1-9]\d{{3}}{GAP}{DAY}{MONTH}\d{{2}}"), "identity hr medical", {"check": check.at_svnr}),
    ("phone", "PHONE", 0.75, phone("43", groups("1,4", "4,10", by=DASH), trunk=True), "contact"),
    ("postal", "ADDRESS", 0.8, place(r"\d{4}"), "contact"),
    ("street", "ADDRESS", 0.85, named_street(r"straße|strasse|str\.|gasse|weg|platz|ring|allee", r"\d+%L?(?:%S*[/\\]%S*\d+)?"), "contact", {"flags": "iu", "lead": "%s-"}),
)

CH = _rules(
    "ch",
    ("ahv-avs-number", "SSN", 0.95, word(rf"756[.%s]?{groups(4, 4, 2, by='[.%s]?')}"), "identity hr medical", {"check": check.ch_ahv}),
    ("phone", "PHONE", 0.8, phone("41", rf"[1-9]{groups(1, 3, 2, 2, by=DASH)}", trunk=True), "contact"),
    ("postal-city", "ADDRESS", 0.8, place(r"\d{4}"), "contact"),
    ("street-german", "ADDRESS", 0.85, named_street(r"strasse|str\.|weg|gasse|platz|allee|rain|matte"), "contact", {"flags": "iu", "lead": "%s-"}),
    ("street-french", "ADDRESS", 0.85, r"(?:rue|avenue|chemin|route|place|boulevard)%S+%L[%L%s'-]+%S*\d+", "contact", {"flags": "iu"}),
)

IE = _rules(
    "ie",
    ("pps-number", "SSN", 0.9, word(r"\d{7}[A-W][ABWTXZ]?"), "identity hr", {"check": check.ie_pps, "flags": "i"}),
    ("phone", "PHONE", 0.8, phone("353", rf"[1-9]{groups('0,1', 3, '3,4', by=DASH)}", trunk=True), "contact"),
    ("eircode", "ADDRESS", 0.8, word(rf"[A-Z]\d{{2}}{GAP}[A-Z0-9]{{4}}"), "contact", {"flags": "i"}),
)

DK = _rules(
    "dk",
    ("cpr-number", "SSN", 0.8, word(rf"{DAY}{MONTH}\d{{2}}{DASH}\d{{4}}"), "identity hr"),
    ("phone", "PHONE", 0.75, phone("45", groups(2, 2, 2, 2, by=DASH)), "contact"),
    ("postal-city", "ADDRESS", 0.8, place(r"\d{4}"), "contact"),
)

FI = _rules(
    "fi",
    ("hetu", "SSN", 0.9, word(rf"{DAY}{MONTH}\d{{2}}[ABCDEFYXWVU+-]\d{{3}}[\dA-FHJK-NPR-Y]"), "identity hr", {"check": check.fi_hetu, "flags": "i"}),
    ("phone", "PHONE", 0.8, phone("358", rf"[1-9]{groups('0,1', '3,4', '3,4', by=DASH)}", trunk=True), "contact"),
    ("postal-city", "ADDRESS", 0.8, place(r"\d{5}"), "contact"),
)

US = _rules(
    "us",
    ("ssn", "SSN", 0.92, r"%b(?!000|666|9\d{2})[0-8]\d{2}-(?!00)\d{2}-(?!0000)\d{4}%b", "identity hr financial"),
    ("itin", "SSN", 0.85, word(r"9\d{2}-(?:5\d|6[0-5]|7\d|8[0-8]|9[0-24-9])-\d{4}"), "identity financial"),
    ("ein", "SSN", 0.8, word(r"(?:0[1-6]|1[0-6]|2[0-7]|[35]\d|[468][0-8]|7[1-7]|9[0-58-9])-\d{7}"), "financial legal"),
    ("passport", "SSN", 0.35, word(r"[A-Z]?\d{8,9}"), "identity"),
    ("mbi", "SSN", 0.95, word(r"[1-9][A-HJ-NP-Z][A-HJ-NP-Z0-9]\d[A-HJ-NP-Z][A-HJ-NP-Z0-9]\d[A-HJ-NP-Z]{2}\d{2}"), "medical identity"),
    ("dea", "SSN", 0.92, word(r"[ABCDEFGHJKLMPRSTUX][A-Z]\d{7}"), "medical", {"check": check.us_dea}),
    ("npi", "SSN", 0.9, word(groups(10)), "medical", {"check": check.us_npi}),
    ("routing", "OTHER", 0.9, word(r"(?:0\d|1[0-2]|2[1-9]|3[0-2]|6[1-9]|7[0-2]|80)\d{7}"), "financial", {"check": check.us_aba}),
    ("phone", "PHONE", 0.85, r"(?:\+1[-.%s]?)?(?:\([2-9]\d{2}\)[-.%s]?|[2-9]\d{2}[-.%s])[2-9]\d{2}[-.%s]\d{4}%b", "contact"),
    ("zip_plus4", "ADDRESS", 0.8, word(groups(5, 4, by="-")), "contact"),
    ("street", "ADDRESS", 0.85, rf"%b\d{{1,5}}[A-Z]?%S+(?:[NSEW]\.?%S+|(?:North|South|East|West)%S+)?[A-Z]\w*(?:%S+[A-Z]\w*)*%S+{any_of(US_STREETS)}%b\.?", "contact", {"flags": "i"}),
    ("currency_words", "CURRENCY", 0.9, amount_words(rf"(?:{PAYABLE})%S+", "dollars?|cents?"), "financial", {"flags": "iu"}),
    ("company", "COMPANY", 0.85, company(r"Inc\.?|LLC|L\.L\.C\.|Corp\.?|Corporation|Co\.|Company|Ltd\.?|LP|L\.P\.|LLP|L\.L\.P\.|PLLC|P\.C\.", comma=True), "legal financial", {"lead": "%s&.'"}),
)

RULES: tuple[Rule, ...] = tuple([*UNIVERSAL, *GB, *PL, *DE, *FR, *ES, *PT, *SE, *NO, *IT, *NL, *BE, *AT, *CH, *IE, *DK, *FI, *US])
ORDER = {rule.detector: k for k, rule in enumerate(RULES)}


def select(region: str = "all", domains: tuple[str, ...] = ()) -> tuple[Rule, ...]:
    """Rules of a region (with the universal ones; all of them for "all") that have any of the domains, if some are given."""
    return tuple(r for r in RULES if (region == "all" or r.region in ("universal", region)) and (not domains or set(domains) & set(r.domains)))


def named(*detectors: str) -> tuple[Rule, ...]:
    """Rules by region:name, in catalogue order."""
    wanted = {f"regex:{d}" for d in detectors}
    return tuple(r for r in RULES if r.detector in wanted)
