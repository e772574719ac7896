"""Stateful folds that give the same rows over a stream as over a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

_STATE = T.StructType([T.StructField("last_seq", T.LongType()), T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType())])
_OUT = T.StructType([T.StructField("key", T.StringType()), T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("last_seq", T.LongType())])


def fold_rows(state: tuple[int, float, int], rows: pd.DataFrame) -> tuple[int, float, int]:
    """Adds the rows above the last sequence; a sequence seen before is passed over, gaps are normal."""
    last, total, n = state
    fresh = rows[rows["seq"] > last].drop_duplicates("seq").sort_values("seq")
    if len(fresh):
        last, total, n = int(fresh["seq"].iloc[-1]), total + float(fresh["value"].sum()), n + len(fresh)
    return last, total, n


def fold_stream(events: DataFrame) -> DataFrame:
    """Running (key, total, n, last_seq) of a stream of (key, seq, value); one row per key and batch.

    Equal to ``fold_batch`` where a key's events come in order over the batches; later ones count as seen.
    """

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        # Sequences of one key may be spread over chunks of a batch, so they are joined first.
        now = fold_rows(state.get if state.exists else (-1, 0.0, 0), pd.concat(list(chunks)))
        state.update(now)
        yield pd.DataFrame([(key[0], now[1], now[2], now[0])], columns=_OUT.names)

    return events.groupBy("key").applyInPandasWithState(step, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def fold_batch(events: DataFrame) -> DataFrame:
    """The same fold as an aggregation: Spark combines before it shuffles."""
    fresh = events.groupBy("key", "seq").agg(F.first("value").alias("value"))
    return fresh.groupBy("key").agg(F.sum("value").alias("total"), F.count("*").alias("n"), F.max("seq").alias("last_seq"))


def dedup_stream(events: DataFrame, keys: list[str], ts: str, window: str) -> DataFrame:
    """Drops repeats of a key within the window."""
    return events.withWatermark(ts, window).dropDuplicatesWithinWatermark(keys)


def windowed_stream(events: DataFrame, ts: str, late: str, width: str) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), "key").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def gather_stream(results: DataFrame) -> DataFrame:
    """Counted barrier over a stream of (key, expected, idx, value): fires once, with the first results."""
    state = T.StructType([T.StructField("idx", T.ArrayType(T.LongType())), T.StructField("value", T.ArrayType(T.DoubleType())), T.StructField("fired", T.BooleanType())])
    out = T.StructType([T.StructField("key", T.StringType()), T.StructField("vals", T.ArrayType(T.DoubleType()))])

    def step(key: tuple, chunks: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        idx, value, fired = held.get if held.exists else ([], [], False)
        idx, value = list(idx), list(value)
        expected = 0
        for rows in chunks:
            expected = max(expected, int(rows["expected"].max()))
            idx += rows["idx"].tolist()
            value += rows["value"].tolist()
        if not fired and 0 < expected <= len(idx):
            first = sorted(zip(idx[:expected], value[:expected]))
            idx, value, fired = [], [], True
            yield pd.DataFrame({"key": [key[0]], "vals": [[v for _, v in first]]})
        held.update((idx, value, fired))

    return results.groupBy("key").applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout)


def coalesce_stream(triggers: DataFrame) -> DataFrame:
    """One run at a time per key: triggers missed while active make one follow-up with the last payload.

    Rows are (key, kind, payload); kind is fire or done.
    """
    state = T.StructType([T.StructField("active", T.BooleanType()), T.StructField("dirty", T.BooleanType()), T.StructField("last", T.StringType())])
    out = T.StructType([T.StructField("key", T.StringType()), T.StructField("started", T.StringType())])

    def step(key: tuple, chunks: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        active, dirty, last = held.get if held.exists else (False, False, None)
        begun = []
        for row in pd.concat(list(chunks)).sort_values("seq").itertuples():
            if row.kind == "done":
                active = dirty
                if dirty:
                    begun.append(last)
                dirty = False
            elif active:
                dirty, last = True, row.payload
            else:
                active = True
                begun.append(row.payload)
        held.update((active, dirty, last))
        yield pd.DataFrame({"key": [key[0]] * len(begun), "started": begun})

    return triggers.groupBy("key").applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout)


def subscriptions(entries: DataFrame, queries: dict[str, Callable]) -> DataFrame:
    """Every entry against all saved filters in one pass: (subscription, entry_id)."""
    hits = F.array(*(F.when(made(entries), F.lit(name)) for name, made in queries.items()))
    return entries.select("entry_id", F.explode(F.array_compact(hits)).alias("subscription"))
