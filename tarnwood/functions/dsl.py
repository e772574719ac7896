"""A small text query language, compiled to a Spark column.

``size_bytes>=1k category:a,b name~report created_at>-7d "free text"``. Terms are separated by
blanks; a term that can't be read becomes an error, never an exception. The compiled filter is an
ordinary column expression, so Catalyst pushes it down to the scan.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TERM = re.compile(r"([A-Za-z_][\w.]*)(!=|!:|>=|<=|[:~^$<>])(.*)", re.S)
_SIZE = re.compile(r"(\d+(?:\.\d+)?)([kmgt])(?:i?b)?", re.I)
_AGO = re.compile(r"-(\d+(?:\.\d+)?)([mhdwy])")
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}(?:[T ].*)?")
_NUMBER = re.compile(r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?")
_SECONDS = {"m": 60, "h": 3600, "d": 86400, "w": 7 * 86400, "y": 365 * 86400}
_OPS = {":": "eq", "!=": "ne", "!:": "ne", "~": "contains", "^": "starts_with", "$": "ends_with", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}
_SUGAR = ("col", "dim", "pii", "attr", "format", "datatype")


@dataclass(frozen=True)
class Term:
    kind: str  # search, filter or one of the sugar names
    value: str
    field: str = ""
    op: str = ""


@dataclass
class Query:
    terms: list[Term] = field(default_factory=list)
    errors: list[tuple[int, str]] = field(default_factory=list)


def tokens(text: str) -> list[tuple[int, str]]:
    """(position, token); a double quote switches whether blanks separate."""
    out, start, quoted = [], None, False
    for at, c in enumerate(text + " "):
        if c.isspace() and (not quoted or at == len(text)):
            if start is not None:
                out.append((start, text[start:at]))
                start = None
        else:
            start = at if start is None else start
            quoted ^= c == '"'
    return out


def _bare(text: str) -> tuple[str, bool]:
    """The text without its quotes, and whether it had any."""
    if not text.startswith('"'):
        return text, False
    if len(text) < 2 or not text.endswith('"'):
        raise ValueError("unclosed quote")
    return text[1:-1], True


def _term(raw: str) -> Term:
    if raw.startswith('"'):
        return Term("search", _bare(raw)[0])
    match = _TERM.fullmatch(raw)
    if not match:
        if set(raw) & set(':<>"'):
            raise ValueError("could not parse term")
        return Term("search", raw)
    name, sign, rest = match.groups()
    if sign == ":" and name in _SUGAR:
        key, rest = (rest.split("=", 1) if "=" in rest else ("", "")) if name == "attr" else ("", rest)
        if name == "attr" and not key:
            raise ValueError("attr term requires KEY=VALUE")
        value = _bare(rest)[0]
        if not value:
            raise ValueError("missing value")
        return Term(name, value, key)
    if not rest:
        raise ValueError("missing value")
    value, quoted = _bare(rest)
    op = _OPS[sign]
    if not quoted and op == "eq" and value in ("null", "*"):
        return Term("filter", "", name, "is_null" if value == "null" else "is_not_null")
    if not quoted and op in ("eq", "ne") and "," in value:
        op = {"eq": "in", "ne": "not_in"}[op]
    if op in ("gt", "gte", "lt", "lte"):
        fits = _NUMBER.fullmatch(value) or (name.endswith("_bytes") and _SIZE.fullmatch(value)) or (name.endswith("_at") and (_AGO.fullmatch(value) or _DATE.fullmatch(value)))
        if not fits:
            raise ValueError(f'non-numeric value "{value}" for comparison on field "{name}"')
    return Term("filter", value, name, op)


def parse(text: str) -> Query:
    query = Query()
    for at, raw in tokens(text):
        try:
            query.terms.append(_term(raw))
        except ValueError as e:
            query.errors.append((at, str(e)))
    return query


def coerced(name: str, value: str, now: datetime) -> str:
    """Byte suffixes of ``*_bytes`` fields and relative dates of ``*_at`` fields, in terms of ``now``."""
    if name.endswith("_bytes") and (m := _SIZE.fullmatch(value)):
        return str(math.floor(float(m[1]) * 1024 ** ("kmgt".index(m[2].lower()) + 1) + 0.5))
    if name.endswith("_at") and (m := _AGO.fullmatch(value)):
        when = now - timedelta(seconds=float(m[1]) * _SECONDS[m[2]])
        return when.strftime("%Y-%m-%dT%H:%M:%S.") + f"{when.microsecond // 1000:03d}Z"
    return value


def _literal(value: str, kind: T.DataType) -> Column:
    """The value in the field's own type; what doesn't fit becomes null and matches nothing."""
    text = F.lit(value)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.try_to_timestamp(F.regexp_replace(text, "Z$", "")).cast(kind)
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.IntegralType) and not re.fullmatch(r"[+-]?\d+", value):
        return text.try_cast("double")
    return text.try_cast(kind)


def _filter(term: Term, target: Column, kind: T.DataType, now: datetime) -> Column:
    text = target.cast("string")
    if term.op == "is_null":
        return target.isNull()
    if term.op == "is_not_null":
        return target.isNotNull()
    # The pattern signs % and _ in these three keep their meaning.
    if term.op in ("contains", "starts_with", "ends_with"):
        before, after = term.op != "starts_with", term.op != "ends_with"
        return text.ilike("%" * before + term.value + "%" * after)
    if term.op in ("in", "not_in"):
        found = target.isin(*(_literal(v.strip(), kind) for v in term.value.split(",")))
        return found if term.op == "in" else ~found
    right = _literal(coerced(term.field, term.value, now), kind)
    return {"eq": target == right, "ne": target != right, "gt": target > right, "gte": target >= right, "lt": target < right, "lte": target <= right}[term.op]


def compile_query(
    query: Query, schema: T.StructType, now: datetime, search: tuple[str, ...] = (), datatypes: dict[str, list[str]] | None = None, meta: dict[str, Column] | None = None,
    virtual: dict[str, tuple[Column, T.DataType]] | None = None, open_keys: dict[str, Callable[[str], Column]] | None = None,
) -> Column:
    """One boolean column: all terms joined by AND; search texts match any of the ``search`` columns.

    ``meta`` names the columns of the metadata sugar: col (array), dim (array), pii (array), attr
    (map), format (string), schema (string). ``virtual`` adds fields by name as (column, type),
    ``open_keys`` families of text fields by prefix. An unknown field or data type matches nothing.
    """
    meta = meta or {}
    fields = {f.name: (F.col(f"`{f.name}`"), f.dataType) for f in schema.fields} | (virtual or {})
    parts: list[Column] = []
    for term in query.terms:
        if term.kind == "search":
            parts.append(reduce(lambda a, b: a | b, (F.col(c).cast("string").ilike(f"%{term.value}%") for c in search), F.lit(False)))
        elif term.kind == "filter":
            family = next((p for p in open_keys or {} if term.field.startswith(p)), None)
            if family and term.field not in fields:
                fields[term.field] = (open_keys[family](term.field[len(family):]), T.StringType())
            parts.append(_filter(term, *fields[term.field], now) if term.field in fields else F.lit(False))
        elif term.kind == "datatype":
            digests = (datatypes or {}).get(term.value) or [""]
            parts.append(meta["schema"].isin(*digests) if "schema" in meta else F.lit(False))
        elif term.kind not in meta:
            parts.append(F.lit(False))
        elif term.kind == "attr":
            parts.append(meta["attr"][term.field] == term.value)
        elif term.kind == "format":
            parts.append(F.lower(meta["format"]) == term.value.lower())
        else:
            parts.append(F.array_contains(meta[term.kind], term.value))
    return reduce(lambda a, b: a & b, parts, F.lit(True))
