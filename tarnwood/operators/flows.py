"""Steps of a flow over tokens: splits, calls of other flows, mappings, channels and look-ups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split(tokens: DataFrame, branches: list, branch: str = "branch") -> DataFrame:
    """Each token once on every branch."""
    return tokens.withColumn(branch, F.explode(F.array(*map(F.lit, branches))))


def call(tokens: DataFrame, child: Callable[[DataFrame], DataFrame], key: str, inputs: dict[str, str]) -> DataFrame:
    """What ``child`` makes of the mapped inputs, with the caller's other columns.

    ``inputs`` maps the child's columns to SQL expressions; ``key`` travels along and identifies the
    caller's token, of which the child may keep, drop or multiply rows. Columns that the child makes
    replace the caller's of the same name.
    """
    made = child(tokens.select(key, *(F.expr(e).alias(c) for c, e in inputs.items())))
    return tokens.drop(*(c for c in made.columns if c != key)).join(made, key)


def mapped(rows: DataFrame, fields: dict[str, str], *kept: str) -> DataFrame:
    """``kept`` and one column for each field, by SQL expressions: a result or a trigger's payload."""
    return rows.select(*kept, *(F.expr(e).alias(c) for c, e in fields.items()))


def each_item(messages: DataFrame, kind: str = "kind") -> DataFrame:
    """Items of a control channel one by one; opens and closes are left out."""
    return messages.where(F.col(kind) == "item").drop(kind)


def latest_value(messages: DataFrame, channel: str, order: str, value: str) -> DataFrame:
    """The last value of each channel; of equal ``order`` the largest."""
    return messages.groupBy(channel).agg(F.max(order).alias(order), F.max_by(value, F.struct(order, value)).alias(value))


def looked_up(tokens: DataFrame, catalogue: DataFrame, key: str, order: str) -> DataFrame:
    """Tokens with the newest catalogue row of their key under ``found``, null where there is none.

    The catalogue is brought to one row a key before the join, so no key multiplies tokens.
    """
    others = [c for c in catalogue.columns if c != key]
    newest = catalogue.groupBy(key).agg(F.max(F.struct(order, *(c for c in others if c != order))).alias("found"))
    return tokens.join(newest, key, "left")


def sample_cap(rows: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """At most ``most`` rows, as many as statistics of a file look at, and whether there were more."""
    return rows.limit(most), rows.limit(most + 1).count() > most
