"""What becomes of triggers that fire while a run is active, in batch and over streams.

Rows are (key, seq, kind, payload); kind is fire or done.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

POLICIES = ("allow", "skip", "queue")


def started(triggers: DataFrame, policy: str) -> DataFrame:
    """(key, seq, started): the payloads that begin a run, and the event that lets each begin.

    allow: every fire. skip: fires while a run is active are lost. queue: they wait, and each end
    lets the next begin. Windows over a key's events, no state by hand.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    fires = triggers.where("kind = 'fire'")
    if policy == "allow":
        return fires.select("key", "seq", F.col("payload").alias("started"))
    by_key = Window.partitionBy("key").orderBy("seq")
    if policy == "skip":
        # A fire leaves its key active, whether it began or was lost; an end leaves it idle.
        before = triggers.withColumn("_before", F.lag("kind").over(by_key))
        return before.where("kind = 'fire' and not _before <=> 'fire'").select("key", "seq", F.col("payload").alias("started"))
    # Runs active or waiting: the sum of steps, lifted by the lowest point below zero so far.
    total = F.sum(F.when(F.col("kind") == "fire", 1).otherwise(-1)).over(by_key)
    held = triggers.withColumn("_sum", total).withColumn("_held", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(by_key)))
    slots = held.where("(kind = 'fire' and _held = 1) or (kind = 'done' and _held >= 1)").select("key", "seq", F.row_number().over(by_key).alias("_n"))
    waiting = fires.select("key", F.col("payload").alias("started"), F.row_number().over(by_key).alias("_n"))
    return slots.join(waiting, ["key", "_n"]).select("key", "seq", "started")


def started_stream(triggers: DataFrame, policy: str) -> DataFrame:
    """The same rows over a stream whose events of a key come in order over the batches."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        active, waiting = state.get if state.exists else (False, [])
        waiting, begun = list(waiting), []
        for row in pd.concat(list(chunks)).sort_values("seq").itertuples():
            if row.kind == "done":
                active = bool(waiting)
                if waiting:
                    begun.append((row.seq, waiting.pop(0)))
            elif policy == "allow" or not active:
                active = True
                begun.append((row.seq, row.payload))
            elif policy == "queue":
                waiting.append(row.payload)
        state.update((active, waiting))
        yield pd.DataFrame([(key[0], *b) for b in begun], columns=["key", "seq", "started"])

    made = f"key {triggers.schema['key'].dataType.simpleString()}, seq long, started string"
    return triggers.groupBy("key").applyInPandasWithState(step, made, "active boolean, waiting array<string>", "append", GroupStateTimeout.NoTimeout)
