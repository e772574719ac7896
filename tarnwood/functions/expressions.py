"""Column helpers that several operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size classes by upper bound, age cohorts by days, histogram bounds in seconds,
# chart steps in seconds.
SIZE_CLASSES = (("<1K", 1 << 10), ("1K-1M", 1 << 20), ("1-16M", 1 << 24), ("16-256M", 1 << 28), ("256M-1G", 1 << 30), ("1-4G", 1 << 32))
SIZE_TOP = ">=4G"
AGES = (("<7d", 7), ("7-30d", 30), ("30-90d", 90), ("90d-1y", 365), ("1-2y", 730))
AGE_TOP = ">2y"
LATENCY_BOUNDS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)
STEPS = (1, 5, 15, 30, 60, 300, 900, 1800, 3600, 7200, 21600, 43200, 86400)


def _ladder(value: Column, rungs, top: str, strict: bool) -> Column:
    out = F.when(value.isNull(), "unknown")
    for label, bound in rungs:
        out = out.when(value < bound if strict else value <= bound, label)
    return out.otherwise(top)


def size_class(size: Column) -> Column:
    """A bound belongs to the next class."""
    return _ladder(size, SIZE_CLASSES, SIZE_TOP, True)


def age_cohort(days: Column) -> Column:
    return _ladder(days, AGES, AGE_TOP, False)


def extension(path: Column) -> Column:
    found = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9_~#-]{1,16})$", 1))
    return F.nullif(found, F.lit(""))


def under(path: Column, prefix: str) -> Column:
    """True below a folder; no character of the prefix is a wildcard."""
    return F.ltrim(path, F.lit("/")).startswith(prefix.strip("/") + "/") if prefix.strip("/") else F.lit(True)


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def bucket_start(ts: Column, width: int, origin: int = 0) -> Column:
    """Start, in epoch seconds, of the bucket of ``width`` seconds counted from ``origin``."""
    s = epoch_seconds(ts)
    return s - F.pmod(s - origin, F.lit(width))


def chart_step(window: int, points: int) -> int:
    """Seconds per point for a chart, 0 for raw points."""
    ideal = window // points if window > 0 and points > 0 else 0
    return 0 if ideal <= 1 else next((s for s in STEPS if s >= ideal), STEPS[-1])


def schema_fingerprint(fields: list[tuple[str, str, bool]]) -> str:
    """Order-free 64-bit FNV-1a of name, type and nullability."""
    state = 0xCBF29CE484222325
    for byte in "|".join(sorted(f"{n}:{t}:{str(bool(x)).lower()}" for n, t, x in fields)).encode():
        state = ((state ^ byte) * 0x100000001B3) % (1 << 64)
    return f"{state:016x}"


_GO_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0}


def go_seconds(text: str) -> float:
    """Seconds of a duration like ``1h30m``."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h|d)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"not a duration: {text!r}")
    return sum(float(a) * _GO_UNITS[b] for a, b in parts)


def human_bytes(size: Column) -> Column:
    out = F.format_string("%d B", size)
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(size >= 1024**power, F.format_string(f"%.1f {unit}", size / float(1024**power))).otherwise(out)
    return F.when(size.isNull(), None).otherwise(out)


def satisfies(capabilities: Column, constraints: list[tuple[str, str, str, object]]) -> Column:
    """All of (capability, field, op, value) hold over a map of maps of strings; anything unknown fails."""
    out = F.lit(True)
    for capability, name, op, value in constraints:
        have = F.try_element_at(F.try_element_at(capabilities, F.lit(capability)), F.lit(name))
        number = have.try_cast("double")
        if op == "exists":
            test = have.isNotNull()
        elif op in ("eq", "neq"):
            same = number == float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else have == str(value)
            test = same if op == "eq" else ~same
        elif op == "in" and isinstance(value, (list, tuple)):
            test = have.isin(*map(str, value))
        elif op in ("gt", "gte", "lt", "lte") and isinstance(value, (int, float)):
            test = {"gt": number > value, "gte": number >= value, "lt": number < value, "lte": number <= value}[op]
        else:
            test = F.lit(False)
        out = out & F.coalesce(test, F.lit(False))
    return out
