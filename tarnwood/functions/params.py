"""Bracket query strings: ``filter[size][gte]=5&sort=-created_at&page=2&size=50``."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import parse_qsl

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwood.functions.dsl import Query, Term

_KNOWN = ("eq", "ne", "gt", "gte", "lt", "lte", "contains", "starts_with", "ends_with", "in", "not_in", "is_null", "is_not_null")
_FILTER = re.compile(r"filter\[([^\]]+)\](?:\[([^\]]+)\])?")


@dataclass
class Params:
    query: Query = field(default_factory=Query)
    sort: list[str] = field(default_factory=list)
    page: int = 0
    size: int = 50
    warnings: list[str] = field(default_factory=list)


def snake(name: str) -> str:
    """camelCase to snake_case; dots stay."""
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


def parse_params(text: str) -> Params:
    """An unknown operator drops its filter with a warning; without one a filter means equality."""
    out = Params()
    for key, value in parse_qsl(text, keep_blank_values=True):
        found = _FILTER.fullmatch(key)
        if found:
            op = found[2] or "eq"
            if op in _KNOWN:
                out.query.terms.append(Term("filter", value, snake(found[1]), op))
            else:
                out.warnings.append(f"unknown operator {op!r}")
        elif key == "sort":
            out.sort += [s for s in value.split(",") if s]
        elif key in ("page", "size"):
            if value.isascii() and value.isdigit():
                setattr(out, key, int(value))
            else:
                out.warnings.append(f"{key} is not a number")
    return out


def sort_columns(sort: list[str], allowed: tuple[str, ...], tie: str) -> list[Column]:
    """Order of the allowed fields, ``-`` descending, nulls last; ``tie`` makes the order total."""
    out = []
    for s in sort:
        name = snake(s.lstrip("+-"))
        if name in allowed:
            out.append(F.desc_nulls_last(name) if s.startswith("-") else F.asc_nulls_last(name))
    return [*out, F.col(tie)]
