"""Format-preserving pseudonyms for personal numbers and dates (Feistel).

Found and validated in whole texts: payment cards (13-19 digits, Luhn), IBANs
(mod 97), social security numbers (issued areas), IPv4 addresses (octets up to
255), phone numbers (8-15 digits), calendar dates of 1900-2099 (yyyy-mm-dd,
dd.mm.yyyy, mm/dd/yyyy, dd/mm/yyyy), and the local parts of e-mail addresses.
What fails its validation stays as it is.

A value becomes a short list of symbols, each with a radix (digits, letters,
octets, parts of a day number ...). A keyed Feistel network permutes the lists:
in each round one half is shifted, symbol by symbol, by a SHA-256 stream of the
other half. The list is written back in the value's own layout with its check
digits renewed, so the result is valid again, equal values get equal pseudonyms
in every document, and different values of one format get different ones (but
for slash dates, whose two readings share their pseudonyms). Dates stay in
their century, letters letters, digits digits; a phone number keeps its country
code, found by the code's own digits, so its layouts share one pseudonym.

DataFrame and SQL functions only; everything is row-local. Null texts stay null
with 0 values; texts without values are unchanged; repeated rows change alike;
an empty table gives an empty result. Extra columns are kept; the operator's
own columns replace columns of the same name. The key is a literal in the plan
(as its SHA-256): keep plans as private as the key.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, functions as F

ROUNDS = 10
KINDS = ("email", "ip", "date", "ssn", "phone", "iban", "card")
#: What each kind looks like; [0-9] and the like, so that no escape depends on the SQL dialect. Repeats without
#: a bound are possessive: a plain repeated group would cost stack space for each repeat.
PATTERNS = {
    "email": "(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]++(?:[.][A-Za-z0-9-]++)++",
    "ip": "(?<![0-9A-Za-z.])[0-9]{1,3}(?:[.][0-9]{1,3}){3}(?![0-9A-Za-z]|[.][0-9])",
    "date": "(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[.][0-9]{2}[.][0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})"
            "(?![0-9A-Za-z]|[./-][0-9])",
    "ssn": "(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "phone": "(?<![0-9A-Za-z+])(?:[+][0-9]{1,3}[ .-]?(?:[(][0-9]{1,4}[)]|[0-9]{1,4})(?:[ .-]?[0-9]{2,5}){1,4}"
             "|[(][0-9]{3}[)] ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}[.][0-9]{3}[.][0-9]{4})(?![0-9A-Za-z])",
    "iban": "(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "card": "(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
}
#: Country codes of two digits (fixed value); those of one digit are 1 and 7, all others have three.
TWO_DIGIT_CODES = "2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
ANY = "|".join(f"(?:{PATTERNS[k]})" for k in KINDS)


def _let(name: str, value: str, body: str) -> str:
    """Bind a value once inside a lambda."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _feistel(symbols: str, radices: str, tweak: str, key: str) -> str:
    other = "IF(r % 2 = 0, slice(acc, size(acc) DIV 2 + 1, size(acc)), slice(acc, 1, size(acc) DIV 2))"
    stream = "CAST(conv(substr(sha2(concat(d, ':', i), 256), 1, 12), 16, 10) AS BIGINT)"
    shift = f"IF((i < size(acc) DIV 2) = (r % 2 = 0), CAST(pmod(x + {stream}, radix[i]) AS INT), x)"
    digest = f"sha2(concat('{key}|{tweak}|', r, '|', array_join({other}, ',')), 256)"
    return _let("radix", radices, f"aggregate(sequence(0, {ROUNDS - 1}), {symbols}, (acc, r) -> "
                + _let("d", digest, f"transform(acc, (x, i) -> {shift})") + ")")


def _fill(text: str, symbol: str, values: str) -> str:
    """``text`` with its symbols replaced, in order."""
    return (f"array_join(zip_with(split({text}, '{symbol}', -1), {values}, "
            "(p, s) -> concat(p, coalesce(CAST(s AS STRING), ''))), '')")


def _digits(text: str) -> str:
    return f"transform(regexp_extract_all({text}, '([0-9])', 1), c -> CAST(c AS INT))"


def _radices(symbols: str, radix: int) -> str:
    return f"array_repeat({radix}, size({symbols}))"


def _luhn(digits: str, doubled: int) -> str:
    return (f"aggregate(transform(reverse({digits}), (x, i) -> IF(i % 2 = {doubled}, IF(x > 4, 2 * x - 9, 2 * x), x)), "
            "0, (a, x) -> a + x)")


def _alphanumerics(text: str, values: str) -> str:
    """Letters and digits of ``text`` from symbol values, each in its own class."""
    return _let("cs", f"regexp_extract_all({text}, '([A-Za-z0-9])', 1)", _fill(text, "[A-Za-z0-9]", (
        f"zip_with(cs, {values}, (c, v) -> chr(v + CASE WHEN c RLIKE '[0-9]' THEN 48 WHEN c RLIKE '[A-Z]' THEN 65 ELSE 97 END))")))


def _alnum_symbols(text: str) -> str:
    return (f"transform(regexp_extract_all({text}, '([A-Za-z0-9])', 1), c -> ascii(c) - "
            "CASE WHEN c RLIKE '[0-9]' THEN 48 WHEN c RLIKE '[A-Z]' THEN 65 ELSE 97 END)")


def _alnum_radices(text: str) -> str:
    return f"transform(regexp_extract_all({text}, '([A-Za-z0-9])', 1), c -> IF(c RLIKE '[0-9]', 10, 26))"


def _mod97(text: str) -> str:
    """Remainder of the number spelled by digits and letters (A = 10 ... Z = 35)."""
    return (f"aggregate(regexp_extract_all({text}, '([A-Z0-9])', 1), 0, (a, c) -> IF(c RLIKE '[0-9]', "
            "(a * 10 + CAST(c AS INT)) % 97, (a * 100 + ascii(c) - 55) % 97))")


def _card(key: str) -> str:
    body = _let("q", _feistel("p", _radices("p", 10), "card", key),
                _fill("m", "[0-9]", f"concat(q, array(pmod(10 - {_luhn('q', 0)}, 10)))"))
    return _let("ds", _digits("m"), f"IF({_luhn('ds', 1)} % 10 = 0, "
                + _let("p", "slice(ds, 1, size(ds) - 1)", body) + ", m)")


def _ip(key: str) -> str:
    permuted = _feistel("o", "array_repeat(256, 4)", "ip", key)
    return _let("o", "transform(split(m, '[.]'), x -> CAST(x AS INT))",
                f"IF(forall(o, x -> x < 256), array_join(transform({permuted}, x -> CAST(x AS STRING)), '.'), m)")


def _ssn(key: str) -> str:
    area = "CAST(substr(m, 1, 3) AS INT)"
    symbols = f"array({area} - IF({area} > 666, 2, 1), CAST(substr(m, 5, 2) AS INT) - 1, CAST(substr(m, 8) AS INT) - 1)"
    valid = f"{area} BETWEEN 1 AND 899 AND {area} <> 666 AND substr(m, 5, 2) <> '00' AND substr(m, 8) <> '0000'"
    text = "concat(lpad(CAST(q[0] + IF(q[0] >= 665, 2, 1) AS STRING), 3, '0'), '-', lpad(CAST(q[1] + 1 AS STRING), 2, '0'), " \
           "'-', lpad(CAST(q[2] + 1 AS STRING), 4, '0'))"
    return f"IF({valid}, " + _let("q", _feistel(symbols, "array(898, 99, 9999)", "ssn", key), text) + ", m)"


def _phone(key: str) -> str:
    # the country code by its first digits, so that every layout of a number has the same pseudonym
    code = f"CASE WHEN m NOT LIKE '+%' THEN 0 WHEN m RLIKE '^[+][17]' THEN 1 WHEN m RLIKE '^[+](?:{TWO_DIGIT_CODES})' THEN 2 ELSE 3 END"
    body = _let("p", "slice(ds, n + 1, size(ds))", _fill(
        "m", "[0-9]", f"concat(slice(ds, 1, n), {_feistel('p', _radices('p', 10), 'phone', key)})"))
    return _let("ds", _digits("m"), f"IF(size(ds) BETWEEN 8 AND 15, {_let('n', code, body)}, m)")


def _date(key: str) -> str:
    def part(a, b):
        return f"CAST(substr(m, {a}, {b}) AS INT)"
    y = f"IF(m RLIKE '-', {part(1, 4)}, {part(7, 4)})"
    first_is_month = f"m RLIKE '/' AND {part(1, 2)} <= 12"
    mo = f"IF(m RLIKE '-', {part(6, 2)}, IF({first_is_month}, {part(1, 2)}, {part(4, 2)}))"
    d = f"IF(m RLIKE '-', {part(9, 2)}, IF({first_is_month}, {part(4, 2)}, {part(1, 2)}))"
    leap = "(t[0] % 4 = 0 AND (t[0] % 100 <> 0 OR t[0] % 400 = 0))"
    month_days = f"array(31, IF({leap}, 29, 28), 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)"
    valid = (f"IF(t[0] BETWEEN 1900 AND 2099 AND t[1] BETWEEN 1 AND 12 AND t[2] >= 1, "
             f"t[2] <= {month_days}[t[1] - 1], false)")
    # Days of a century as two symbols: 92 x 397 days in 1900-1999, 75 x 487 in 2000-2099.
    start, low, high = "IF(t[0] < 2000, DATE'1900-01-01', DATE'2000-01-01')", "IF(t[0] < 2000, 92, 75)", "IF(t[0] < 2000, 397, 487)"
    number = f"datediff(make_date(t[0], t[1], t[2]), {start})"
    layout = f"CASE WHEN m RLIKE '-' THEN 'yyyy-MM-dd' WHEN m RLIKE '[.]' THEN 'dd.MM.yyyy' WHEN {first_is_month} " \
             "THEN 'MM/dd/yyyy' ELSE 'dd/MM/yyyy' END"
    symbols = _let("w", number, f"array(w % {low}, w DIV {low})")
    symbols = f"transform({symbols}, x -> CAST(x AS INT))"
    out = _let("q", _feistel(symbols, f"array({low}, {high})", "date", key),
               f"date_format(date_add({start}, q[0] + {low} * q[1]), {layout})")
    return _let("t", f"array({y}, {mo}, {d})", f"IF({valid}, {out}, m)")


def _iban(key: str) -> str:
    valid = f"{_mod97('concat(substr(m, 5), substr(m, 1, 4))')} = 1"
    body = _let("b", "substr(m, 5)", _alphanumerics("b", _feistel(_alnum_symbols("b"), _alnum_radices("b"), "iban", key)))
    check = _let("n", body, f"concat(substr(m, 1, 2), lpad(CAST(98 - {_mod97('concat(n, substr(m, 1, 2), 0, 0)')} AS STRING), 2, '0'), n)")
    return f"IF({valid}, {check}, m)"


def _email(key: str) -> str:
    local = "substring_index(m, '@', 1)"
    return _let("l", local, "concat(" + _alphanumerics("l", _feistel(
        _alnum_symbols("l"), _alnum_radices("l"), "email", key)) + ", substr(m, length(l) + 1))")


def _pseudonym(key: str) -> str:
    made = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "iban": _iban, "card": _card}
    return "CASE " + " ".join(f"WHEN m RLIKE '^(?:{PATTERNS[k]})$' THEN {made[k](key)}" for k in KINDS) + " ELSE m END"


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """docs with pseudonyms in ``text``, and n_replaced, the values replaced."""
    digest = hashlib.sha256(key.encode()).hexdigest()
    changed = _let("ms", f"regexp_extract_all(text, '({ANY})', 1)", "IF(size(ms) = 0, named_struct('t', text, 'n', 0), " + _let(
        "ps", f"transform(ms, m -> {_pseudonym(digest)})",
        f"named_struct('t', array_join(zip_with(split(text, '{ANY}', -1), ps, (a, b) -> concat(a, coalesce(b, ''))), ''), "
        "'n', size(filter(zip_with(ms, ps, (a, b) -> a <> b), x -> x)))") + ")")
    rows = docs.drop("n_replaced").withColumn("_made", F.expr(f"CASE WHEN text IS NOT NULL THEN {changed} END"))
    kept = [F.col("_made.t").alias("text") if c == "text" else F.col(f"`{c}`") for c in rows.columns if c != "_made"]
    return rows.select(*kept, F.coalesce(F.col("_made.n"), F.lit(0)).alias("n_replaced"))
