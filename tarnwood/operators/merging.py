"""Merges of old and new facts, and verdicts over several copies of them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upgraded(old: Column, new: Column, rich: Column) -> Column:
    """The new metadata where the old is empty, or where the old is degraded and the new is ``rich``.

    A degraded document has an object under ``format`` that names an unknown format.
    """
    degraded = F.get_json_object(old, "$.format.unknown").isNotNull()
    return F.when(old.isNull() | (old == "{}") | (degraded & rich), F.coalesce(new, old)).otherwise(old)


def last_wins_object(rows: DataFrame, keys: list[str], name: str, value: str, order: str) -> DataFrame:
    """One map per key: of the values of one name the last by ``order``, nulls in it last of all."""
    rank = F.struct(F.col(order).isNull().alias("open"), F.col(order).alias("at"), F.col(value).alias("tie"))
    last = rows.groupBy(*keys, name).agg(F.max_by(value, rank).alias("_v"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, "_v")))).alias("object"))


def metering(deliveries: DataFrame, key: str, order: str, fixed: list[str], terminal: list[str]) -> DataFrame:
    """One row per request: ``fixed`` fields of its first delivery, ``terminal`` fields of its last."""
    return deliveries.groupBy(key).agg(*(F.min_by(c, order).alias(c) for c in fixed), *(F.max_by(c, order).alias(c) for c in terminal))


def endpoint_verdicts(seen: DataFrame, siblings: DataFrame) -> DataFrame:
    """Per endpoint: paths sampled, passed and mismatched, and verified, mismatch or conflict.

    ``seen``: endpoint, path, hash (null: the path is missing there), expected. ``siblings``: path,
    sibling_hash of other endpoints, one row per path. A conflict is a wrong hash that a sibling's
    hash contradicts too.
    """
    rows = seen.join(siblings, "path", "left")
    wrong = F.col("hash").isNotNull() & ~F.col("hash").eqNullSafe(F.col("expected"))
    counts = rows.groupBy("endpoint").agg(
        F.count("*").alias("sampled"), F.count_if(F.col("hash").isNotNull() & ~wrong).alias("passed"), F.count_if(wrong).alias("mismatched"),
        F.count_if(F.col("hash").isNull()).alias("missing"), F.count_if(wrong & (F.col("sibling_hash") != F.col("hash"))).alias("_torn"),
    )
    verdict = F.when(F.col("_torn") > 0, "conflict").when(F.col("mismatched") > 0, "mismatch").otherwise("verified")
    return counts.withColumn("verdict", verdict).drop("_torn")


def _patched(old, new):
    if not isinstance(new, dict):
        return new
    out = dict(old) if isinstance(old, dict) else {}
    for k, v in new.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = _patched(out.get(k), v)
    return out


@F.pandas_udf(T.StringType())
def merge_patch(old: pd.Series, new: pd.Series) -> pd.Series:
    """JSON merge patch (RFC 7396): objects merge, null deletes, all else replaces; a null text changes nothing.

    Keys of the result are sorted.
    """
    made = [a if b is None else json.dumps(_patched(json.loads(a) if a else {}, json.loads(b)), separators=(",", ":"), ensure_ascii=False, sort_keys=True) for a, b in zip(old, new)]
    return pd.Series(made, dtype=object)


def reply_routes(tokens: DataFrame, binding: str, route: str) -> DataFrame:
    """Bindings whose tokens agree on the reply route, with it; tokens without one agree with all."""
    found = tokens.groupBy(binding).agg(F.min(route).alias("route"), F.max(route).alias("_other"))
    return found.where(F.col("route").eqNullSafe(F.col("_other"))).drop("_other")


def channel_gather(messages: DataFrame, episode: str, kind: str, index: str, value: str) -> DataFrame:
    """Items of each episode whose close message's count they reach, in order; a count of 0 gives ``[]``."""
    closed = messages.where(F.col(kind) == "close").groupBy(episode).agg(F.max(value).alias("expected")).where("expected is not null")
    # Only as many items as are asked for are gathered, however many an episode has.
    turn = F.row_number().over(Window.partitionBy(episode).orderBy(index, value))
    items = messages.where(F.col(kind) == "item").withColumn("_turn", turn).join(closed, episode).where("_turn <= expected")
    got = items.groupBy(episode).agg(F.sort_array(F.collect_list(F.struct(index, value))).alias("_items"))
    whole = closed.join(got, episode, "left").where((F.col("expected") <= 0) | (F.size("_items") == F.col("expected")))
    empty = F.array().cast(T.ArrayType(messages.schema[value].dataType))
    return whole.select(episode, "expected", F.coalesce(F.transform("_items", lambda i: i[value]), empty).alias("vals"))


def expired(seen: DataFrame, key: str, at: str, now: int, ttl: int) -> DataFrame:
    """Keys last seen longer than ``ttl`` before ``now``."""
    return seen.groupBy(key).agg(F.max(at).alias("last_seen")).where(F.col("last_seen") < now - ttl)


def refreshed(rollup: DataFrame, rows: DataFrame, touched: DataFrame, keys: list[str], made) -> DataFrame:
    """The rollup with the touched keys computed anew by ``made``; running it again changes nothing."""
    anew = made(rows.join(touched.select(*keys).distinct(), keys, "left_semi"))
    return rollup.join(touched.select(*keys).distinct(), keys, "left_anti").unionByName(anew)
