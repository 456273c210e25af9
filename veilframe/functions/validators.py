"""Check rules of identifiers as expressions. Each is total: null in, false out.

A rule is SQL text over the text of an argument, so that the detectors put all of them into one
expression that is parsed once; as functions of columns they are called by their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lengths of IBANs by country (ISO 13616 registry).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27,
    "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
# Weights of the published check-digit rules.
ROUTING_WEIGHTS = (3, 7, 1, 3, 7, 1, 3, 7, 1)
NHS_WEIGHTS = (10, 9, 8, 7, 6, 5, 4, 3, 2)
TFN_WEIGHTS = (1, 4, 3, 7, 5, 8, 6, 9, 10)
ABN_WEIGHTS = (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19)
VIN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
# Letters of a VIN by their digit, and barred prefixes of National Insurance numbers.
VIN_LETTERS, VIN_DIGITS = "ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789"
NINO_BARRED = ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ")


Sql = Callable[[str], str]


def quoted(text: str) -> str:
    """A string of SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bind(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` for a value that is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def apply(body: str, **columns: Column) -> Column:
    """SQL text as a column, with columns for names in it."""
    given = F.struct(*[c.alias(n) for n, c in columns.items()])
    return F.element_at(F.call_function("transform", F.array(given), F.expr(f"_a -> {body}")), 1)


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def _rule(value: str, body: str) -> str:
    """A test of ``s``, a form of the argument."""
    return f"coalesce({bind('s', value, body)}, false)"


def _weighted(weights: tuple[int, ...], of: str = "s") -> str:
    """Sum of the first digits of ``of`` times their weights."""
    return (
        f"aggregate(zip_with(slice(split({of}, ''), 1, {len(weights)}), array({', '.join(map(str, weights))}), (c, w) -> cast(c as int) * w), 0, (n, x) -> n + x)"
    )


_LUHN = (
    "if(length({0}) >= 2, aggregate(transform(sequence(1, length({0})), i -> cast(substring({0}, -i, 1) as int) * if(i % 2 = 0, 2, 1)), 0, "
    "(n, x) -> n + if(x > 9, x - 9, x)) % 10 = 0, false)"
)
_LENGTHS = "map(" + ", ".join(f"'{c}', {n}" for c, n in IBAN_LENGTHS.items()) + ")"
_IBAN_MOD = (
    "aggregate(split(concat(substring(s, 5), substring(s, 1, 4)), ''), 0, "
    "(n, c) -> if(c >= 'A', (n * 100 + ascii(c) - 55) % 97, (n * 10 + ascii(c) - 48) % 97))"
)
_COMPACT = r"upper(regexp_replace({}, '[\\s\\x{{A0}}-]', ''))"


def luhn_sql(v: str) -> str:
    return _rule(_digits(v), _LUHN.format("s"))


def iban_sql(v: str) -> str:
    fits = f"coalesce(try_element_at({_LENGTHS}, substring(s, 1, 2)) = length(s), true)"
    return _rule(_COMPACT.format(v), f"if(s rlike '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{10,30}}\\\\z' and {fits}, {_IBAN_MOD} = 1, false)")


def ssn_sql(v: str) -> str:
    given = "substring(s, 1, 3) not in ('000', '666') and substring(s, 1, 1) <> '9' and substring(s, 4, 2) <> '00' and substring(s, 6, 4) <> '0000'"
    return _rule(_digits(v), f"length(s) = 9 and {given} and s <> repeat(substring(s, 1, 1), 9)")


def routing_sql(v: str) -> str:
    return _rule(_digits(v), f"if(length(s) = 9 and s <> '000000000', {_weighted(ROUTING_WEIGHTS)} % 10 = 0, false)")


def nhs_sql(v: str) -> str:
    # a check of ten is no digit, so nothing equals it
    check = f"(11 - {_weighted(NHS_WEIGHTS)} % 11) % 11 = cast(substring(s, 10, 1) as int)"
    return _rule(_digits(v), f"if(length(s) = 10 and s <> repeat(substring(s, 1, 1), 10), {check}, false)")


def npi_sql(v: str) -> str:
    return _rule(_digits(v), f"if(length(s) = 10 and substring(s, 1, 1) in ('1', '2'), {_LUHN.format("concat('80840', s)")}, false)")


def sin_sql(v: str) -> str:
    return _rule(_digits(v), f"if(length(s) = 9 and substring(s, 1, 1) not in ('0', '8') and s <> repeat(substring(s, 1, 1), 9), {_LUHN.format('s')}, false)")


def tfn_sql(v: str) -> str:
    return _rule(_digits(v), f"case length(s) when 9 then {_weighted(TFN_WEIGHTS)} % 11 = 0 when 8 then {_weighted(TFN_WEIGHTS[:8])} % 11 = 0 else false end")


def abn_sql(v: str) -> str:
    return _rule(_digits(v), f"if(length(s) = 11, ({_weighted(ABN_WEIGHTS)} - {ABN_WEIGHTS[0]}) % 89 = 0, false)")


def vin_sql(v: str) -> str:
    rest = f"{_weighted(VIN_WEIGHTS, f"translate(s, '{VIN_LETTERS}', '{VIN_DIGITS}')")} % 11"
    check = f"substring(s, 9, 1) = {bind('k', rest, "if(k = 10, 'X', cast(k as string))")}"
    return _rule(f"upper(regexp_replace({v}, '[ \\\\t-]', ''))", f"if(s rlike '^[A-HJ-NPR-Z0-9]{{17}}\\\\z', {check}, false)")


def nino_sql(v: str) -> str:
    barred = ", ".join(f"'{p}'" for p in NINO_BARRED)
    return _rule(_COMPACT.format(v), f"s rlike '^[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z][0-9]{{6}}[A-D]?\\\\z' and substring(s, 1, 2) not in ({barred})")


def base58_sql(v: str) -> str:
    return f"coalesce({v} rlike '^[1-9A-HJ-NP-Za-km-z]+\\\\z', false)"


def entropy_sql(v: str) -> str:
    share = "size(filter(chars, x -> x = c)) / cast(size(chars) as double)"
    bits = f"aggregate(array_sort(array_distinct(chars)), cast(0 as double), (n, c) -> n - {share} * log2({share}))"
    return f"if(length({v}) > 0, {bind('chars', f"split({v}, '')", bits)}, cast(0 as double))"


def looks_random_sql(v: str, least: float = 3.2) -> str:
    return f"coalesce(length({v}) >= 12 and {v} rlike '[0-9]' and {v} rlike '[^0-9]' and not {v} rlike '\\\\s' and {entropy_sql(v)} >= {least}, false)"


RULES: dict[str, Sql] = {
    "luhn": luhn_sql, "iban": iban_sql, "ssn": ssn_sql, "routing": routing_sql, "nhs": nhs_sql, "npi": npi_sql, "sin": sin_sql, "tfn": tfn_sql,
    "abn": abn_sql, "vin": vin_sql, "nino": nino_sql, "base58": base58_sql, "looks_random": looks_random_sql,
}


def _column(rule: Sql) -> Callable[[Column], Column]:
    def run(value: Column) -> Column:
        return apply(rule("_a.v"), v=value)

    return run


VALIDATORS = {name: _column(rule) for name, rule in RULES.items()}
luhn, iban, ssn, routing, nhs, npi, sin, tfn, abn, vin, nino, base58, looks_random = VALIDATORS.values()


def entropy(value: Column) -> Column:
    """Shannon bits for each character; 0 for an empty text."""
    return apply(entropy_sql("_a.v"), v=value)


def valid_date(year: Column, month: Column, day: Column) -> Column:
    """Whether a day of the years 1900 to 2100 is in the calendar."""
    inside = "_a.y between 1900 and 2100 and _a.m between 1 and 12 and _a.d between 1 and 31"
    return apply(f"coalesce(if({inside}, _a.d <= day(last_day(make_date(_a.y, _a.m, 1))), false), false)", y=year, m=month, d=day)


def hash32(value: Column) -> Column:
    """FNV-1a over UTF-16 units, each as one step, 32 bits unsigned."""
    units = "transform(sequence(1, length(u), 4), i -> cast(conv(substring(u, i, 4), 16, 10) as bigint))"
    folded = bind("u", "hex(encode(_a.v, 'UTF-16BE'))", f"aggregate({units}, 2166136261L, (h, x) -> ((h ^ x) * 16777619L) & 4294967295L)")
    return apply(f"case when length(_a.v) > 0 then {folded} when _a.v is not null then 2166136261L end", v=value)
