"""Format-preserving Feistel pseudonyms for personal data, with DataFrame functions only.

Values are found by pattern, validated, and permuted by a keyed Feistel network: characters within
their own classes (digits to digits, letters to letters), numbers with a range of their own (dates,
social security numbers) by modular addition on their two parts, which never leaves the range. So a
card number stays a card number with a right check digit, a date a date, and equal values get equal
pseudonyms in every document. The key is data, a column from a table of one row: it stands in no
plan, event log or user interface.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwood.llm.shared import few_rows

#: Its name makes Spark redact the value wherever it shows settings.
KEY_SETTING = "spark.tarnwood.pii.secret"
_MADE: dict[str, str] = {}


def key_of(spark: SparkSession) -> str:
    """The key that the session's settings hold.

    Where they hold none, a random one is made for the application: values are then linked within
    its runs, not to those of other applications.
    """
    return spark.conf.get(KEY_SETTING, None) or _MADE.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


_EDGE = r"(?<![\p{L}\p{N}])"
_END = r"(?![\p{L}\p{N}])"
#: A time may follow a date, as in 2024-02-29T10:00:00Z.
_DATE_END = r"(?!\p{N}|(?![Tt][0-9]{2})\p{L})"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: kind -> pattern, in the order in which they are tried at a place.
KINDS: dict[str, str] = {
    "email": _EDGE + r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}" + _END,
    "secret": _EDGE + r"(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64})" + _END,
    "date": _EDGE + r"(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2})" + _DATE_END,
    "ip": r"(?<![\p{L}\p{N}.])" + _OCTET + r"(?:\." + _OCTET + r"){3}(?!\.?[\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}" + _END + r"|\+[1-9][0-9]{0,2}(?:[ .-]?[0-9]{2,4}){2,4}" + _END,
    "ssn": _EDGE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END,
    "card": _EDGE + r"[0-9](?:[ -]?[0-9]){12,18}" + _END,
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
_ROUNDS = 8
#: Country calling codes: those of one and two digits; all others have three.
_COUNTRY = "[+](?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _shift(tweak: str, *parts: str) -> str:
    """SQL for a number that the key, the kind of value and ``parts`` decide."""
    return f"cast(conv(substring(sha2(concat_ws('|', _pii_key, {tweak}, {', '.join(parts)}), 256), 1, 12), 16, 10) as bigint)"


def _feistel(value: str, tweak: str, alphabets: tuple[str, ...]) -> str:
    """SQL for a keyed permutation of the string ``value``; other characters stay in place."""
    half = "cast(length(s) div 2 as int)"
    shift = _shift(tweak, "length(s)", "r", "i", f"if(r % 2 = 0, substring(s, {half} + 1), substring(s, 1, {half}))")
    turn = "c"
    for letters in alphabets:
        turn = f"if(locate(c, '{letters}') > 0, substring('{letters}', cast(pmod(locate(c, '{letters}') - 1 + {shift}, {len(letters)}) + 1 as int), 1), {turn})"
    step = f"array_join(transform(split(s, ''), (c, i) -> if((i < {half}) = (r % 2 = 0), {turn}, c)), '')"
    return f"aggregate(sequence(0, {_ROUNDS - 1}), {value}, (s, r) -> {step})"


def _number(value: str, tweak: str, low: int, high: int) -> str:
    """SQL for a keyed permutation of the numbers 0 to low * high - 1."""
    left = f"if(r % 2 = 0, pmod(s.a + {_shift(tweak, 'r', 's.b')}, {low}L), s.a)"
    right = f"if(r % 2 = 1, pmod(s.b + {_shift(tweak, 'r', 's.a')}, {high}L), s.b)"
    start = f"named_struct('a', cast({value} div {high} as bigint), 'b', cast({value} % {high} as bigint))"
    return f"aggregate(sequence(0, {_ROUNDS - 1}), {start}, (s, r) -> named_struct('a', {left}, 'b', {right}), s -> s.a * {high}L + s.b)"


_DIGITS = "0123456789"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def _luhn_sum(digits: str) -> str:
    """SQL for the Luhn sum of a digit string to which one check digit follows."""
    doubled = "cast(d as int) * if((length({0}) - k) % 2 = 1, 2, 1)".format(digits)
    return f"aggregate(transform(split({digits}, ''), (d, k) -> ({doubled}) div 10 + ({doubled}) % 10), 0L, (a, b) -> a + b)"


def _refill(shape: str, digits: str) -> str:
    """SQL: the characters of ``shape`` with its digits replaced in turn by those of ``digits``."""
    at = f"length(regexp_replace(substring({shape}, 1, j), '[^0-9]', '')) + 1"
    return f"array_join(transform(split({shape}, ''), (g, j) -> if(g between '0' and '9', substring({digits}, {at}, 1), g)), '')"


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _day(value: str, form: str) -> str:
    return f"cast(try_to_timestamp({value}, '{form}') as date)"


def pseudonym_sql(m: str) -> str:
    """SQL for what takes the place of a match; what fails its check stays as it is."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    head = f"concat(substring(q, 1, 1), {_feistel('substring(q, 2, length(q) - 2)', "'card'", (_DIGITS,))})"
    card = _let(
        digits,
        "q",
        f"if(({_luhn_sum('substring(q, 1, length(q) - 1)')} + cast(right(q, 1) as int)) % 10 = 0, "
        + _let(head, "w", _refill(m, f"concat(w, cast((10 - {_luhn_sum('w')} % 10) % 10 as string))"))
        + f", {m})",
    )
    # A known country code stays; the national digits are permuted, without a known code all digits,
    # as those of North America, so that a number is linked to itself with and without its code.
    phone = _let(
        f"regexp_extract({m}, '^({_COUNTRY})', 1)",
        "p",
        f"concat(p, {_let(f'substring({m}, length(p) + 1)', 'n', _refill('n', _feistel("regexp_replace(n, '[^0-9]', '')", "if(p = '', '+1', p)", (_DIGITS,))))})",
    )
    # Areas 001-899 without 666, groups 01-99, serials 0001-9999: every number is a valid one.
    area = f"(cast(substring({digits}, 1, 3) as bigint) - if(substring({digits}, 1, 3) > '666', 2, 1))"
    number = f"(({area} * 99 + cast(substring({digits}, 4, 2) as bigint) - 1) * 9999 + cast(substring({digits}, 6) as bigint) - 1)"
    spelt = "format_string('%03d-%02d-%04d', x div 989901 + if(x div 989901 >= 665, 2, 1), x div 9999 % 99 + 1, x % 9999 + 1)"
    ssn = f"if({m} rlike '^(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)', {_let(_number(number, "'ssn'", 898 * 99, 9999), 'x', spelt)}, {m})"
    email = f"concat({_feistel(f"substring_index({m}, '@', 1)", f"lower(substring_index({m}, '@', -1))", (_DIGITS, _LOWER, _LOWER.upper()))}, '@', substring_index({m}, '@', -1))"
    # Upper case gets what lower case gets, in upper case; in mixed case each class stays within itself.
    hexed = _let(_feistel(f"lower({m})", "'secret'", (_DIGITS + "abcdef",)), "x", f"if({m} rlike '[A-F]', upper(x), x)")
    secret = f"if({m} rlike '[a-f]' and {m} rlike '[A-F]', {_feistel(m, "'secret'", (_DIGITS, "abcdef", "ABCDEF"))}, {hexed})"
    # An address is four bytes: eight hexadecimal digits.
    packed = f"array_join(transform(split({m}, '[.]'), o -> lower(lpad(hex(cast(o as bigint)), 2, '0'))), '')"
    ip = _let(_feistel(packed, "'ip'", (_DIGITS + "abcdef",)), "a", "array_join(transform(array(1, 3, 5, 7), b -> conv(substring(a, b, 2), 16, 10)), '.')")
    # Days of 1900-2099 are numbered: 73049 of them, one less than 150 * 487. That one more is permuted on,
    # which ends inside: it can't be its own successor once another day has led to it.
    forms = f"case when {m} rlike '^[0-9]{{4}}-' then 'yyyy-MM-dd' when {m} like '%.%' then 'dd.MM.yyyy' when {_day(m, 'dd/MM/yyyy')} is null then 'MM/dd/yyyy' else 'dd/MM/yyyy' end"
    day = "datediff(y, date'1900-01-01')"
    walk = _let(_number(day, "'date'", 150, 487), "x", f"if(x = 73049, {_number('73049', "'date'", 150, 487)}, x)")
    date = _let(
        forms,
        "f",
        _let(
            f"case f when 'yyyy-MM-dd' then {_day(m, 'yyyy-MM-dd')} when 'dd.MM.yyyy' then {_day(m, 'dd.MM.yyyy')} when 'MM/dd/yyyy' then {_day(m, 'MM/dd/yyyy')} else {_day(m, 'dd/MM/yyyy')} end",
            "y",
            f"if(y is null, {m}, date_format(date_add(date'1900-01-01', cast({walk} as int)), f))",
        ),
    )
    made = {"email": email, "secret": secret, "date": date, "ip": ip, "phone": phone, "ssn": ssn, "card": card}
    whens = " ".join(f"when {m} rlike {_sql('^(?:' + p.replace(_EDGE, '').replace(_END, '') + ')$')} then {made[k]}" for k, p in KINDS.items())
    return f"case {whens} else {m} end"


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced and ``n_replaced`` int added.

    Covers e-mail addresses (the local part), payment cards (Luhn), telephone numbers, IPv4
    addresses, US social security numbers, calendar dates of 1900-2099 and long hexadecimal secrets.
    A value that fails its check stays. A null text stays null with ``n_replaced`` 0; an empty one
    stays empty; long ones are searched whole. Rows are treated alone, so repeated rows and null ids
    come out alike. A column named ``n_replaced`` is replaced; an empty table gives an empty table.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    spark, text = docs.sparkSession, F.col(text_col)
    worth = text.rlike("[0-9@]")
    found = F.when(worth, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    secret = F.broadcast(few_rows(spark, [(key,)], T.StructType([T.StructField("_pii_key", T.StringType())])))  # one row
    out = docs.drop("n_replaced").withColumn("_pii_found", found).join(secret, F.lit(True))
    some = F.size("_pii_found") > 0
    out = out.withColumn("_pii_new", F.when(some, F.expr(f"transform(_pii_found, m -> {pseudonym_sql('m')})")))
    between = F.split(text, PATTERN, -1)
    joined = F.array_join(F.zip_with(between, F.concat("_pii_new", F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    changed = F.expr("size(filter(sequence(1, size(_pii_found)), i -> element_at(_pii_found, i) <> element_at(_pii_new, i)))")
    return out.withColumns({text_col: F.when(some, joined).otherwise(text), "n_replaced": F.coalesce(F.when(some, changed), F.lit(0)).cast("int")}).drop("_pii_found", "_pii_new", "_pii_key")
