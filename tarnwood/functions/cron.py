"""Cron schedules as Spark columns."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields with their ranges and names; week days count from Sunday = 1.
FIELDS = (
    ("second", 0, 59, ()),
    ("minute", 0, 59, ()),
    ("hour", 0, 23, ()),
    ("day", 1, 31, ()),
    ("month", 1, 12, ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")),
    ("dayofweek", 1, 7, ("sun", "mon", "tue", "wed", "thu", "fri", "sat")),
)


def _values(text: str, low: int, high: int, names: tuple[str, ...]) -> set[int]:
    def number(word: str) -> int:
        if word[:3].lower() in names:
            return low + names.index(word[:3].lower())
        if not word.isdigit() or not low <= int(word) <= high:
            raise ValueError(f"{word!r} is outside of {low}-{high}")
        return int(word)

    found: set[int] = set()
    for part in text.split(","):
        m = re.fullmatch(r"(\*|\?|\w+)(?:-(\w+))?(?:/(\d+))?", part)
        if not m or m[3] == "0":
            raise ValueError(f"not a cron field: {part!r}")
        first = low if m[1] in "*?" else number(m[1])
        last = number(m[2]) if m[2] else high if m[1] in "*?" or m[3] else first
        if last < first:
            raise ValueError(f"range runs backwards: {part!r}")
        found.update(range(first, last + 1, int(m[3] or 1)))
    return found


def parse_cron(text: str) -> list[set[int]]:
    """Allowed values of second, minute, hour, day, month and week day; with five fields second 0."""
    words = text.split()
    if len(words) not in (5, 6):
        raise ValueError(f"a schedule has 5 or 6 fields: {text!r}")
    return [_values(w, low, high, names) for w, (_, low, high, names) in zip(["0"] * (6 - len(words)) + words, FIELDS)]


def cron_matches(ts: Column, text: str, zone: str = "UTC") -> Column:
    """True at the instants (UTC, without zone) at which the schedule fires in ``zone``; all fields must fit."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))
    out = F.lit(True)
    for (name, low, high, _), values in zip(FIELDS, parse_cron(text)):
        if len(values) <= high - low:
            out = out & getattr(F, name)(local).isin(*sorted(values))
    return out


def fire_times(spark: SparkSession, text: str, after: datetime, until: datetime, zone: str = "UTC") -> DataFrame:
    """Every fire (column ``at``, UTC) later than ``after`` and not later than ``until``."""
    first, last = (int(t.replace(tzinfo=timezone.utc).timestamp()) for t in (after, until))
    step = 60 if parse_cron(text)[0] == {0} else 1
    seconds = spark.range((first // step + 1) * step, last + 1, step)
    at = F.timestamp_seconds("id").cast("timestamp_ntz")
    return seconds.select(F.convert_timezone(F.current_timezone(), F.lit("UTC"), at).alias("at")).where(cron_matches(F.col("at"), text, zone))


def catch_up(spark: SparkSession, text: str, last: datetime, now: datetime, fire_missed: bool, zone: str = "UTC") -> DataFrame:
    """After a pause: the first missed fire, once, or nothing where missed fires are skipped."""
    missed = fire_times(spark, text, last, now, zone)
    return missed.agg(F.min("at").alias("at")).where("at is not null") if fire_missed else missed.limit(0)
