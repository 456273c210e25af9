"""The detectors: metadata, and for each the shapes of what it finds.

The shapes are put together from what public documents say of each format, named beside
them; ``veilframe.functions.patterns`` turns all of them into one expression. All but
``person_name`` are column expressions; that one is a Python function on the rows
that may hold a name (``veilframe.operators.names``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column

from ..functions import validators as V
from ..functions.lexicon import DEFAULT, ORG_SUFFIXES
from ..functions.patterns import CHECKS, LEFT, RIGHT, W, WS, WSC, Shape, hint_pattern, literal, spans
from ..functions.validators import bind, quoted
from ..options import Lexicon

Scan = Callable[[Column, Lexicon], Column]


@dataclass(frozen=True)
class Detector:
    """``shapes`` for what patterns can find, or ``scan``, a function from a text column to array<SPAN>."""

    id: str
    label: str
    group: str
    priority: int
    risk: str
    default: bool
    scan: Scan | None = None
    shapes: tuple[Shape, ...] = ()

    @property
    def type(self) -> str:
        return token_name(self.id)


# Token names that are not the id in upper case, weights of risks.
TOKEN_NAMES = {
    "person_name": "PERSON", "org_name": "ORG", "nhs_number": "NHS", "routing_number": "ROUTING", "secret_assignment": "SECRET",
    "bearer": "CREDENTIAL", "driver_license": "DRIVER_LICENCE", "tfn_abn": "TAX_ID_AU", "swift_bic": "SWIFT", "crypto_wallet": "CRYPTO",
}
RISK_WEIGHT = {"critical": 12, "high": 7, "medium": 3, "low": 1}


def token_name(detector_id: str) -> str:
    return TOKEN_NAMES.get(detector_id, detector_id.upper())


# ---------------------------------------------------------------- building blocks of shapes


def one_of(words: Iterable[str]) -> str:
    """Any of the phrases, the longest first; a blank in one stands for one or two of any kind."""
    return "(?:" + "|".join(literal(w).replace(" ", f"{WS}{{1,2}}") for w in sorted(words, key=lambda w: (-len(w), w))) + ")"


def grouped(sizes: Iterable[int], divider: str) -> str:
    """Groups of so many digits with a divider between them."""
    return divider.join(f"[0-9]{{{n}}}" for n in sizes)


def lone(first: str, rest: str) -> str:
    """A value beside no word character. Its first character is tried before what stands ahead of it, as it fails sooner."""
    return f"{first}(?<!{W}{first}){rest}{RIGHT}"


def digits(n: str, **more) -> Shape:
    """So many digits in a row, alone."""
    least = n.split(",")[0]
    return Shape(lone("[0-9]", f"[0-9]{{{','.join(str(int(x) - 1) for x in n.split(','))}}}"), quick=f"[0-9]{{{least}}}", **more)


#: What may stand between a label and its value: a word for "number", blanks and one or two marks.
_NO = f"(?:{WS}{{0,4}}(?:number|num|no|#))?\\.?"
_LINK = f"{WS}{{0,8}}[:#=-]?{WS}{{0,8}}"


def labelled(labels: Iterable[str], value: str, number: bool = False, link: str = _LINK, right: str = RIGHT, **more) -> Shape:
    """A value of any case after one of the labels."""
    labels = tuple(labels)
    needs = more.pop("needs", tuple(sorted({w.split(" ")[0].rstrip(".") for w in labels})))
    return Shape(f"(?i)({LEFT}{one_of(labels)}{_NO if number else ''}{link})({value}){right}", needs=needs, lead=True, **more)


def _listed(words: Iterable[str]) -> str:
    return ", ".join(quoted(w) for w in sorted(words))


for _name in ("iban", "routing", "ssn", "sin", "abn", "tfn", "nhs", "npi", "vin", "nino"):
    CHECKS[_name] = lambda v, ahead, words, rule=V.RULES[_name]: rule(v)
_digits_of = "length(regexp_replace({}, '[^0-9]', ''))"
_all_digits = "{} rlike '^[0-9]+$'"

# ISO/IEC 7812: 13 to 19 digits, the first of a payment network, with a check digit
CHECKS["card"] = lambda v, ahead, words: bind("c", f"regexp_replace({v}, '[^0-9]', '')", (
    f"length(c) between 13 and 19 and left(c, 1) between '2' and '6' and c <> repeat(left(c, 1), length(c)) and {V.luhn_sql('c')}"))
# ITU-T E.164: 15 digits at most
CHECKS["phone_digits"] = lambda v, ahead, words: f"{_digits_of.format(v)} between 8 and 15"
CHECKS["uk_digits"] = lambda v, ahead, words: f"{_digits_of.format(v)} between 10 and 11"
CHECKS["divided"] = lambda v, ahead, words: f"not {_all_digits.format(v)}"
CHECKS["mixed_case"] = lambda v, ahead, words: f"{V.base58_sql(v)} and {v} rlike '[A-Z]' and {v} rlike '[a-z]' and {v} rlike '[0-9]'"
CHECKS["has_digit"] = lambda v, ahead, words: f"{v} rlike '[0-9]'"
# RFC 5321, 4.5.3.1.3: a path is 256 characters with its brackets
CHECKS["mail_length"] = lambda v, ahead, words: f"length({v}) <= 254"
CHECKS["handle"] = lambda v, ahead, words: f"lower({v}) not in ({_listed(words)})" if words else "true"
CHECKS["calendar"] = lambda v, ahead, words: f"coalesce(year(try_cast({v} as date)) between 1900 and 2100, false)"


def _earth(v: str, ahead: str, words: frozenset) -> str:
    """Degrees of latitude and longitude."""
    at = lambda i: f"abs(cast(regexp_replace(split({v}, ',')[{i}], {quoted(WS)}, '') as double))"
    return f"{at(0)} <= 90 and {at(1)} <= 180"


def _ipv4(v: str, ahead: str, words: frozenset) -> str:
    """RFC 791 octets; neither unspecified nor broadcast, nor the number of a version or section."""
    octet = "b rlike '^(?:0|[1-9][0-9]{0,2})$' and cast(b as int) <= 255"
    version = f"right({ahead}, 12) rlike {quoted(f'(?:(?<!{W})v|version{WS}*)$')}"
    host = f"right({ahead}, 32) rlike {quoted(hint_pattern(('ip', 'host', 'addr', 'server', 'gateway', 'dns', 'ping')))}"
    real = f"forall(o, b -> {octet}) and {v} not in ('0.0.0.0', '255.255.255.255') and not {version}"
    return bind("o", f"split({v}, '[.]')", f"{real} and (exists(o, b -> cast(b as int) > 20) or {host})")


CHECKS["earth"], CHECKS["ipv4"] = _earth, _ipv4

# Words that a secret's name is made of, and values that say there is none (as long as a value must be).
_SECRET_NAMES = (
    "password passwd pwd passphrase secret token credential apikey api_key api-key api_secret api-secret secret_key secret-key access_token access-token "
    "refresh_token refresh-token auth_token auth-token client_secret client-secret private_key private-key"
).split()
_NOT_SECRETS = (
    "undefined placeholder example changeme redacted hidden required invalid incorrect correct missing unknown protected enabled disabled optional "
    "expired revoked rotated pending unchanged"
).split()


def _secret(v: str, ahead: str, words: frozenset) -> str:
    """Neither prose nor a mask, a template or a token."""
    dummy = quoted(r"(?i)^(?:x+|\*+|\.+|[<${%].*|\[[A-Z_]+_[0-9]+\])$")
    return f"lower({v}) not in ({_listed(_NOT_SECRETS)}) and not {v} rlike {dummy}"


CHECKS["secret"] = _secret


# ---------------------------------------------------------------- formats

_ALNUM, _UPPER, _HEX, _LOWHEX, _BASE64URL = "A-Za-z0-9", "A-Z0-9", "A-Fa-f0-9", "a-f0-9", "A-Za-z0-9_-"
# Prefixes that issuers document for their keys, the characters after them and how many. Each row is
# searched apart: in one alternation a match would hide an overlapping one of another issuer.
KEY_FORMATS = (
    ("AKIA ASIA AGPA AIDA AROA AIPA ANPA ANVA ABIA ACCA", _UPPER, "16"),
    ("ghp_ gho_ ghu_ ghs_ ghr_", _ALNUM, "36,255"),
    ("github_pat_", _ALNUM + "_", "22,255"),
    ("xoxb- xoxa- xoxp- xoxr- xoxs- xoxe-", _ALNUM + "-", "10,"),
    ("sk_live_ sk_test_", _ALNUM, "10,"),
    ("rk_live_ rk_test_", _ALNUM, "10,"),
    ("whsec_", _ALNUM, "24,"),
    ("sk-ant-", _BASE64URL, "20,"),
    ("sk- sk-proj- sk-svcacct-", _BASE64URL, "20,"),
    ("AIza", _BASE64URL, "35"),
    ("ya29.", _BASE64URL, "20,"),
    ("AC SK", _HEX, "32"),
    ("npm_", _ALNUM, "36"),
    ("key-", _LOWHEX, "32"),
    ("glpat-", _BASE64URL, "20,"),
    ("dop_v1_", _LOWHEX, "64"),
    ("shpat_", _HEX, "32"),
    ("EAACEdEose0cBA", _ALNUM, "1,"),
    ("figd_", _BASE64URL, "40,"),
    ("hf_", _ALNUM, "34,"),
)


def _key(prefixes: str, chars: str, n: str) -> Shape:
    names = prefixes.split()
    short = len(names[0]) < 3
    return Shape(f"{LEFT}{one_of(names)}[{chars}]{{{n}}}(?<={W}){RIGHT}", needs=() if short else tuple(sorted({p.lower() for p in names})),
                 quick=f"(?:{'|'.join(names)})[{chars}]{{32}}" if short else "")


_API_KEYS = (*(_key(*f) for f in KEY_FORMATS), Shape(f"{LEFT}SG(?:\\.[{_BASE64URL}]{{16,}}+){{2}}(?<={W}){RIGHT}", needs=("sg.",)))
# RFC 7468 for the block; RFC 7515 for the three parts of a token; RFC 6750 and 7617 for the schemes; RFC 3986 for URLs.
_PEM_LINE = "(?:[A-Z0-9]{1,16} ){0,4}PRIVATE KEY(?: BLOCK)?-----"
_URL_CHAR = "[^" + WSC + "<>\"'`]"
_FIRST_URL = f"((?<!{_URL_CHAR})(?>{_URL_CHAR}*?{LEFT}(?=https?://)))"
_STORES = (
    "postgres postgresql mysql mariadb mongodb mongodb+srv redis rediss amqp amqps mssql sqlserver clickhouse cassandra"
).split()
_QUERY_KEYS = "token key apikey api_key accesstoken access_token auth password secret sig signature session code".split()
# RFC 5322 atext, RFC 1035 labels: an address is entered at the start of a dotted run, so no run is walked twice.
_ATEXT = r"[A-Za-z0-9!#$%\&'*+/=?^_`{|}~-]"
_LABEL = "[A-Za-z0-9][A-Za-z0-9-]{0,62}+(?<!-)"
_EMAIL = f"(?:\\G|(?<!{_ATEXT})(?<!{_ATEXT}\\.)){_ATEXT}++(?:\\.{_ATEXT}++)*+@(?:{_LABEL}\\.){{1,126}}[A-Za-z]{{2,24}}"
_HOST = (
    f"(?i)(?<![a-z0-9_-])(?<![a-z0-9]\\.)(?:{_LABEL}\\.){{1,126}}{one_of('internal local corp lan intranet test dev staging prod'.split())}{RIGHT}"
)
# ITU-T E.123: a plus, the country, an area perhaps in parentheses, groups; the North American and British plans.
_SEP = f"[{WSC}.-]?"
# Numbers under +1 have ten more digits; others end by the 15th, and no address of dotted octets after a blank is their end.
_OCTETS = r"(?![0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))"
_HOME = f"1{_SEP}(?:\\([0-9]{{3}}\\)|[0-9]{{3}}){_SEP}[0-9]{{3}}{_SEP}[0-9]{{4}}{RIGHT}"
_ABROAD = (
    f"(?<![A-Za-z0-9_.])\\+(?:{_HOME}|[0-9]{{1,3}}(?:{_SEP}\\([0-9]{{1,4}}\\))?{_SEP}[0-9]{{1,4}}"
    f"(?:(?:[.-]?|{WS}{_OCTETS})[0-9]{{2,4}}){{1,4}}{RIGHT}(?<!{'[0-9][^0-9+]{0,2}' * 16}))"
)
_NANP = f"(?<![A-Za-z0-9_.-])(?:[2-9][0-9]{{2}}|\\([2-9][0-9]{{2}}\\)){_SEP}[2-9][0-9]{{2}}{_SEP}[0-9]{{4}}(?![0-9-])"
_TRUNK = f"0(?<![A-Za-z0-9_.]0)[0-9]{{2,4}}[{WSC}-][0-9]{{3,4}}[{WSC}-]?[0-9]{{3,4}}{RIGHT}"
# Kinds of streets and of units by the postal handbooks, with their short forms; months; VAT countries.
_STREETS = (
    "Street St Avenue Ave Road Rd Boulevard Blvd Drive Dr Lane Ln Court Ct Circle Cir Place Pl Terrace Ter Trail Trl Parkway Pkwy Highway Hwy "
    "Way Square Sq Close Crescent Cres Gardens Gdns Row Walk Mews"
).split()
_UNITS = "# Apt Apartment Suite Ste Unit Floor Fl Room Rm".split()
_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
_VAT = "GB DE FR IT ES NL BE PL SE DK IE AT PT FI CZ RO GR HU".split()
_ADDRESS = (
    f"{LEFT}[0-9]{{1,6}}(?:[-\\x{{2013}}][0-9]{{1,6}})?{WS}{{1,4}}(?:[A-Z][A-Za-z.'-]{{1,40}}{WS}{{1,4}}){{0,4}}{one_of(_STREETS)}{RIGHT}\\.?"
    f"(?:{WS}{{0,4}}{one_of(_UNITS)}\\.?{WS}{{0,4}}[A-Za-z0-9-]{{1,40}})?"
)
_DEGREES = "[-+]?(?:{0}\\.[0-9]{{4,12}}|{1}(?:\\.0{{1,12}})?)"
_PLACE = f"(?<![A-Za-z0-9_.]){_DEGREES.format('[0-9]{1,2}', 90)}{WS}{{0,4}},{WS}{{0,4}}{_DEGREES.format('[0-9]{1,3}', 180)}(?![A-Za-z0-9_.])"
_DAY, _MONTH_NAME = "[0-9]{1,2}", f"(?:{'|'.join(_MONTHS)})[a-z]{{0,6}}\\.?"
_DATES = "|".join((
    f"{_DAY}[/.-]{_DAY}[/.-][0-9]{{2,4}}", "[0-9]{4}-[0-9]{2}-[0-9]{2}", f"{_DAY}(?:st|nd|rd|th)?[ -]{_MONTH_NAME},?[ -]?[0-9]{{4}}",
    f"{_MONTH_NAME} {_DAY},? [0-9]{{4}}",
))
_GROUP6 = "[0-9A-Fa-f]{1,4}"  # RFC 4291: eight groups, or one run of zero groups left out
_CODE = "[A-Z0-9][A-Z0-9-]{3,19}"
_FIRM = f"{LEFT}(?:[A-Z][A-Za-z0-9\\&'\\x{{2019}}-]{{0,60}}\\.?{WS}{{1,4}}){{1,4}}{one_of(ORG_SUFFIXES)}(?![A-Za-z])"
_BANK = ("account", "acct", "acc", "a/c", "iban", "swift", "bic", "sortcode", "routing", "aba")


def _d(*args, **more) -> Detector:
    return Detector(*args[:6], shapes=args[6:], **more)


CREDENTIALS = (
    _d("private_key", "Private key block", "Credentials", 100, "critical", True,
       Shape(f"(?s)-----BEGIN {_PEM_LINE}.*?-----END {_PEM_LINE}", needs=("private key",), quick=f"-----END {_PEM_LINE}")),
    _d("api_key", "API key / access token", "Credentials", 96, "critical", True, *_API_KEYS),
    _d("jwt", "JSON Web Token", "Credentials", 94, "critical", True,
       Shape(f"{LEFT}eyJ[{_BASE64URL}]{{8,}}+(?:\\.[{_BASE64URL}]{{8,}}){{2}}(?<={W}){RIGHT}", needs=("eyj",))),
    _d("secret_assignment", "Secret in assignment", "Credentials", 92, "critical", True, Shape(
        f"(?i)((?<![A-Za-z0-9]){one_of(_SECRET_NAMES)}{RIGHT}[\"'\\]]?{WS}*+(?:=>|[:=]){WS}*+[\"'`]?)([^{WSC}\"'`,;)\\]}}]{{6,200}})",
        0.9, needs=("passw", "pwd", "passphrase", "secret", "token", "credential", "key"), quick="[:=]", lead=True, check="secret")),
    _d("bearer", "Bearer / Basic credential", "Credentials", 92, "critical", True,
       Shape(f"({LEFT}(?:Bearer|Token){WS}{{1,8}})([A-Za-z0-9._~+/=-]{{16,}})", needs=("bearer", "token"), lead=True),
       Shape(f"({LEFT}Basic{WS}{{1,8}})([A-Za-z0-9+/=]{{16,}})", needs=("basic",), lead=True),
       Shape(f"({LEFT}[a-z][a-z0-9+.-]{{0,30}}://[^{WSC}:@/]++:)([^{WSC}:@/]{{3,}}+)(?=@)", needs=("://",), lead=True)),
    _d("connection_string", "Database connection string", "Credentials", 91, "critical", True,
       Shape(f"{LEFT}{one_of(_STORES)}://{_URL_CHAR}++", needs=("://",), trim=True)),
    _d("url_with_secret", "URL containing a secret", "Credentials", 90, "high", True, Shape(
        f"(?i){_FIRST_URL}(https?://(?={_URL_CHAR}*?[?\\&]{one_of(_QUERY_KEYS)}=[^{WSC}\\&<>\"'`]){_URL_CHAR}++)", needs=("://",), quick="[?&]", lead=True, trim=True)),
)
FINANCIAL = (
    _d("credit_card", "Payment card number", "Financial", 86, "critical", True,
       Shape("[0-9](?<![0-9.-][0-9])(?:[ -]?[0-9]){12,18}(?![0-9-])", quick="[0-9](?:[ -]?[0-9]){12}", check="card")),
    _d("iban", "IBAN", "Financial", 85, "critical", True,  # ISO 13616: country, check digits, groups of four in print
       Shape(lone("[A-Z]", "[A-Z][0-9]{2}(?: ?[A-Z0-9]{4}){2,7} ?[A-Z0-9]{1,4}"), quick="[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", check="iban")),
    _d("swift_bic", "SWIFT / BIC code", "Financial", 78, "high", True,  # ISO 9362: bank, country, place, branch
       Shape(lone("[A-Z]", "[A-Z]{5}[A-Z0-9]{2}(?:[A-Z0-9]{3})?"), 0.7, needs=("swift", "bic", "bank code", "wire"), quick="[A-Z]{6}",
             hint=("swift", "bic", "bank code", "wire"), window=48)),
    _d("routing_number", "ABA routing number", "Financial", 77, "high", True,
       digits("9", check="routing", needs=("routing", "aba", "rtn", "transit", "wire", "ach"), hint=("routing", "aba", "rtn", "transit", "wire", "ach"), window=48)),
    _d("bank_account", "Bank account number", "Financial", 76, "critical", True,
       digits("7,17", confidence=0.75, needs=_BANK, hint=_BANK, window=32)),
    _d("crypto_wallet", "Crypto wallet address", "Financial", 80, "high", True,  # EIP-55, BIP-173, base58check, CryptoNote
       Shape(f"{LEFT}0x[a-fA-F0-9]{{40}}{RIGHT}", needs=("0x",)),
       Shape(f"{LEFT}bc1[02-9ac-hj-np-z]{{11,71}}{RIGHT}", needs=("bc1",)),
       Shape(lone("[13]", "[1-9A-HJ-NP-Za-km-z]{25,34}"), 0.75, quick="[13][1-9A-HJ-NP-Za-km-z]{25}", check="mixed_case"),
       Shape(lone("4", "[0-9AB][0-9A-Za-z]{93}"), quick="4[0-9AB][0-9A-Za-z]{93}")),
    _d("card_expiry", "Card expiry date", "Financial", 75, "high", True, labelled(
        ("exp", "expiry", "expires", "expire", "expiration", "exp date", "exp. date", "expiry date", "expiration date", "valid thru", "validthru",
         "valid thru date", "good thru", "goodthru"),
        f"[0-9]{{1,2}}{WS}{{0,4}}[/-]{WS}{{0,4}}[0-9]{{2,4}}", link=f"\\.?{_LINK}", needs=("exp", "thru"), quick=f"[0-9]{WS}{{0,4}}[/-]")),
    _d("cvv", "Card security code", "Financial", 75, "critical", True, labelled(
        ("cvv", "cvv2", "cvc", "cvc2", "cv2", "csc", "security code", "security value", "verification code", "verification value", "card security code",
         "card verification value", "card verification code"), "[0-9]{3,4}", needs=("cv", "csc", "security", "verification"), quick="[0-9]{3}")),
)
GOVERNMENT = (
    _d("ssn", "US Social Security number", "Government ID", 84, "critical", True,
       Shape(lone("[0-9]", "[0-9]{2}-[0-9]{2}-[0-9]{4}"), quick=grouped((3, 2, 4), "-"), check="ssn"),
       Shape(lone("[0-9]", f"[0-9]{{2}}{WS}[0-9]{{2}}{WS}[0-9]{{4}}"), quick=grouped((3, 2, 4), WS), check="ssn"),
       digits("9", confidence=0.85, check="ssn", needs=("ssn", "soc", "s.s.n", "ss#"), hint=("ssn", "social security", "soc sec", "s.s.n", "ss#"), window=40)),
    _d("nino", "UK National Insurance number", "Government ID", 83, "critical", True,
       Shape(lone("[A-Z]", f"[A-Z](?:{WS}?[0-9]{{2}}){{3}}{WS}?[A-D]?"), 0.9, quick=f"[A-Z]{{2}}(?:{WS}?[0-9]{{2}}){{3}}", check="nino")),
    _d("sin", "Canadian SIN", "Government ID", 83, "critical", True,
       Shape(lone("[0-9]", f"[0-9]{{2}}[ -]{grouped((3, 3), '[ -]')}"), quick=grouped((3, 3, 3), "[ -]"), check="sin")),
    _d("tfn_abn", "Australian TFN / ABN", "Government ID", 83, "critical", True,
       Shape(lone("[0-9]", f"[0-9]{WS}?{grouped((3, 3, 3), f'{WS}?')}"), quick=grouped((2, 3, 3, 3), f"{WS}?"), check="abn"),
       Shape(lone("[0-9]", f"[0-9]{{2}}{WS}?{grouped((3, 3), f'{WS}?')}"), 0.8, needs=("tfn", "tax file"), check="tfn", hint=("tfn", "tax file"), window=48)),
    _d("passport", "Passport number", "Government ID", 74, "critical", True, labelled(("passport",), "[A-Z0-9]{6,9}", number=True)),
    _d("driver_license", "Driver's licence number", "Government ID", 74, "critical", True, labelled(
        [f"{who} licen{c}e" for who in ("driver", "drivers", "driver's", "driving") for c in "cs"] + ["dl"], "[A-Z0-9][A-Z0-9-]{4,17}", number=True,
        needs=("licen", "dl"))),
    _d("tax_id", "Tax ID (EIN / VAT / UTR)", "Government ID", 74, "high", True,
       Shape(lone("[0-9]", "[0-9]-[0-9]{7}"), 0.85, needs=("ein", "employer id", "federal tax", "tax id"), quick="[0-9]{2}-[0-9]{7}",
             hint=("ein", "employer id", "federal tax", "fein", "tax id"), window=48),
       Shape(f"{LEFT}{one_of(_VAT)} ?[0-9]{{8,12}}{RIGHT}", 0.8, needs=("vat", "tax"), quick="[A-Z]{2} ?[0-9]{8}", hint=("vat", "tax"), window=48),
       labelled(("utr", "unique taxpayer reference"), "[0-9]{10}", quick="[0-9]{10}")),
)
HEALTH = (
    _d("nhs_number", "NHS number", "Health", 83, "critical", True,
       Shape(lone("[0-9]", f"[0-9]{{2}}[ -]?{grouped((3, 4), '[ -]?')}"), quick=grouped((3, 3, 4), "[ -]?"), check="nhs",
             needs=("nhs", "patient", "health", "hospital", "gp", "surgery"), hint=("nhs", "patient", "health", "hospital", "gp", "surgery"), window=40)),
    _d("npi", "US NPI (provider ID)", "Health", 79, "high", True,
       Shape(lone("[12]", "[0-9]{9}"), 0.85, quick="[12][0-9]{9}", check="npi", needs=("npi", "provider", "clinician", "physician"),
             hint=("npi", "provider", "clinician", "physician"), window=40)),
    _d("mrn", "Medical record number", "Health", 74, "critical", True, labelled(
        ["mrn", "patient id"] + [f"{of} {no}" for of in ("medical record", "patient", "chart") for no in ("number", "no", "no.", "#")], _CODE,
        needs=("mrn", "medical", "patient", "chart"))),
)
IDENTIFIERS = (
    _d("record_id", "Policy / claim / employee ID", "Identifiers", 72, "high", True, labelled(
        ("policy", "claim", "member", "subscriber", "employee", "staff", "badge", "case", "reference", "customer", "client", "account holder", "ticket",
         "matter", "file"), _CODE, link=f"{WS}{{0,4}}(?:id|no\\.?|number|#|ref)?{_LINK}", confidence=0.9, quick="[0-9]", check="has_digit")),
    _d("vin", "Vehicle VIN", "Identifiers", 79, "medium", True,  # ISO 3779: no I, O or Q
       Shape(lone("[0-9A-HJ-NPR-Z]", "[0-9A-HJ-NPR-Z]{16}"), quick="[0-9A-HJ-NPR-Z]{17}", check="vin")),
)
CONTACT = (
    _d("email", "Email address", "Contact", 82, "high", True, Shape(_EMAIL, needs=("@",), quick=r"@[A-Za-z0-9-]{1,63}\.", check="mail_length")),
    _d("phone", "Phone number", "Contact", 70, "high", True,
       Shape(_ABROAD, needs=("+",), quick=r"\+[0-9]", check="phone_digits"),
       Shape(_NANP, quick=f"[2-9][0-9]{{2}}\\)?{_SEP}[2-9][0-9]{{2}}{_SEP}[0-9]{{4}}", check="divided"),
       Shape(_TRUNK, 0.85, quick=f"0[0-9]{{2,4}}[{WSC}-][0-9]{{3}}", check="uk_digits"),
       Shape("[0-9](?<![A-Za-z0-9_.][0-9])[0-9]{9,10}" + RIGHT, 0.7, needs=("phone", "tel", "mobile", "cell", "fax", "contact number", "call"), quick="[0-9]{10}",
             hint=("phone", "tel", "mobile", "cell", "fax", "contact number", "call"), window=28)),
    _d("address", "Street address", "Contact", 60, "high", True,
       Shape(_ADDRESS, 0.9, needs=tuple(sorted({s.lower() for s in _STREETS})), quick=f"[0-9]{WS}{{1,4}}[A-Z]")),
    _d("postal_code", "Postal code", "Contact", 50, "medium", True,
       Shape(lone("[A-Z]", f"[A-Z]?[0-9][A-Z0-9]?{WS}?[0-9][A-Z]{{2}}"), 0.9, quick=f"[A-Z][0-9][A-Z0-9]?{WS}?[0-9][A-Z]{{2}}"),
       Shape(lone("[ABCEGHJ-NPRSTVXY]", "[0-9][A-Z][ -]?[0-9][A-Z][0-9]"), 0.9, quick="[0-9][A-Z][ -]?[0-9][A-Z][0-9]"),
       Shape(lone("[0-9]", "[0-9]{4}-[0-9]{4}"), 0.85, quick=grouped((5, 4), "-")),
       digits("5", confidence=0.7, needs=("zip", "postal", "post code", "postcode"), hint=("zip", "postal", "post code", "postcode"), window=24)),
    _d("coordinates", "GPS coordinates", "Contact", 65, "high", True, Shape(_PLACE, quick=f"[0-9]{WS}{{0,4}},{WS}{{0,4}}[-+]?[0-9]{{1,3}}\\.?", check="earth")),
    _d("social_handle", "Social handle", "Contact", 40, "medium", True,
       Shape(r"((?<![A-Za-z0-9_@/.])@)([A-Za-z][A-Za-z0-9_.]{2,29})(?![A-Za-z0-9_@.])", 0.8, needs=("@",), lead=True, check="handle")),
)
NETWORK = (
    _d("ip_address", "IP address", "Network", 75, "medium", True,
       Shape(rf"[0-9](?<![A-Za-z0-9_.][0-9])[0-9]{{0,2}}(?:\.[0-9]{{1,3}}){{3}}{RIGHT}(?!\.[0-9])", 0.95, quick=r"[0-9]\.[0-9]{1,3}\.[0-9]", check="ipv4"),
       Shape(f"(?<![A-Za-z0-9_:]){_GROUP6}(?::{_GROUP6}){{7}}(?![A-Za-z0-9_:])", quick=f":{_GROUP6}:{_GROUP6}:"),
       Shape(f"(?<![A-Za-z0-9_:])(?:{_GROUP6}:){{1,7}}:(?:{_GROUP6}(?::{_GROUP6}){{0,6}})?(?![A-Za-z0-9_:])", 0.85, needs=("::",))),
    _d("mac_address", "MAC address", "Network", 75, "medium", True,
       Shape(lone("[0-9A-Fa-f]", "[0-9A-Fa-f](?:[:-][0-9A-Fa-f]{2}){5}"), quick="[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}")),
    _d("url", "Web address (any URL)", "Network", 68, "low", False, Shape(f"{LEFT}https?://{_URL_CHAR}++", needs=("://",), trim=True)),
    _d("hostname", "Internal hostname", "Network", 45, "medium", False, Shape(
        _HOST, needs=("internal", "local", "corp", "lan", "intranet", "test", "dev", "staging", "prod"), quick=r"[A-Za-z0-9]\.[A-Za-z]")),
)
PEOPLE = (
    Detector("person_name", "Person name", "People", 42, "high", True),
    _d("org_name", "Organisation name", "People", 41, "medium", False, Shape(_FIRM, 0.85, needs=tuple(sorted({s.lower().rstrip(".") for s in ORG_SUFFIXES})))),
    _d("date_of_birth", "Date of birth", "People", 64, "critical", True, labelled(
        ("dob", "d.o.b", "d.o.b.", "date of birth", "birthdate", "birth date", "birthday", "born", "born on"), _DATES, right="", link=f"{WS}{{0,8}}[:=-]?{WS}{{0,8}}",
        needs=("dob", "d.o.b", "birth", "born"), quick="[0-9]{2}")),
    _d("date", "Any date", "People", 30, "low", False,
       Shape(lone("[0-9]", "[0-9]{3}-[0-9]{2}-[0-9]{2}"), quick=grouped((4, 2, 2), "-"), check="calendar"),
       Shape(lone("[0-9]", "[0-9]?/[0-9]{1,2}/[0-9]{2,4}"), quick="[0-9]/[0-9]{1,2}/[0-9]{2}")),
)
DETECTORS: tuple[Detector, ...] = (*CREDENTIALS, *FINANCIAL, *GOVERNMENT, *HEALTH, *IDENTIFIERS, *CONTACT, *NETWORK, *PEOPLE)
BY_ID = {d.id: d for d in DETECTORS}
DEFAULT_ENABLED = tuple(d.id for d in DETECTORS if d.default)
_ADDED: dict[str, Detector] = {}


def register_detector(detector: Detector) -> None:
    """Add a detector of one's own; it takes part where it is enabled by id or default."""
    if detector.id in BY_ID:
        raise ValueError(f"{detector.id} is built in")
    if not detector.shapes and detector.scan is None:
        raise ValueError(f"{detector.id} has neither shapes nor a scan")
    _ADDED[detector.id] = detector


def all_detectors() -> tuple[Detector, ...]:
    return (*DETECTORS, *_ADDED.values())


def detect_column(text: Column, detector_id: str, lexicon: Lexicon = DEFAULT) -> Column:
    """The spans of one detector in a text column: array<struct<start,end,value,confidence>>."""
    found = {d.id: d for d in all_detectors()}[detector_id]
    if found.shapes:
        return spans(text, *found.shapes, words=lexicon.stopwords)
    if found.scan is None:
        raise ValueError(f"{detector_id} is no column expression; use veilframe.plans.engine.detect")
    return found.scan(text, lexicon)
