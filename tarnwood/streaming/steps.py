"""States of steps over a stream of run events, as the batch gives them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

_NEW = {"last": -1, "end": None, "tokens": {}, "next": {}, "rows": {}}


def _open(state: dict, node: str, at: int) -> dict:
    """The row of a node's current iteration, made where there is none."""
    k = max(state["next"].get(node, 0) - 1, 0)
    return state["rows"].setdefault(f"{k}|{node}", {"node": node, "iteration": k, "state": "pending", "started": at, "done": None, "last": 0})


def fold_steps(state: dict, events: pd.DataFrame) -> list[dict]:
    """Takes in the events above the last sequence of a run, in order, and gives the rows that changed."""
    changed = {}
    for e in events[events["sequence"] > state["last"]].drop_duplicates("sequence").sort_values("sequence").itertuples():
        state["last"], at, node = int(e.sequence), int(pd.Timestamp(e.ts).value), e.node
        if e.kind in ("run_end", "run_failed"):
            if state["end"] is None:
                state["end"] = ["failed" if e.kind == "run_failed" else "skipped", at]
                changed.update(state["rows"])
            continue
        if node is None or e.kind not in ("enter", "fire", "output", "error_output", "fail"):
            continue
        if e.kind == "enter":
            seen = state["tokens"].setdefault(node, [])
            if not pd.isna(e.token):
                if int(e.token) in seen:
                    continue
                seen.append(int(e.token))
            state["next"][node] = state["next"].get(node, 0) + 1
            row = _open(state, node, at)
        else:
            fresh = not state["next"].get(node) and f"0|{node}" not in state["rows"]
            row = _open(state, node, at)
            if fresh and e.kind != "fail":
                state["next"][node] = 1
            row["last"] = state["last"]
            if e.kind in ("fail", "error_output"):
                row["state"], row["done"] = "failed", at
            elif row["state"] != "failed" and e.kind == "output":
                row["state"], row["done"] = "completed", at
            elif row["state"] == "pending":
                row["state"] = "running"
        changed[f"{row['iteration']}|{node}"] = row
    return list(changed.values())


def step_stream(events: DataFrame, late: str = "1 hour", keep: int = 3_600_000) -> DataFrame:
    """Rows of ``projections.step_executions`` as they change; the highest ``seen`` of a step is its newest row.

    The events of a run come in order over the batches; those at or below its last sequence are replays
    and change nothing. The state of an ended run goes once the watermark, ``late`` behind the newest
    event, is ``keep`` milliseconds past its end.
    """
    ts = events.schema["ts"].dataType
    out = T.StructType([
        T.StructField("run_id", events.schema["run_id"].dataType), T.StructField("node", T.StringType()), T.StructField("iteration", T.LongType()), T.StructField("state", T.StringType()),
        T.StructField("started_at", ts), T.StructField("completed_at", ts), T.StructField("last_sequence", T.LongType()), T.StructField("seen", T.LongType()),
    ])

    def step(key: tuple, chunks: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state = json.loads(held.get[0]) if held.exists else json.loads(json.dumps(_NEW))
        rows = fold_steps(state, pd.concat(list(chunks)))
        held.update((json.dumps(state),))
        if state["end"]:
            held.setTimeoutTimestamp(max(held.getCurrentWatermarkMs(), state["end"][1] // 1_000_000) + keep)
        made = []
        for r in rows:
            closed = state["end"] if state["end"] and r["state"] in ("pending", "running") else [r["state"], r["done"]]
            made.append((key[0], r["node"], r["iteration"], closed[0], pd.Timestamp(r["started"]), pd.NaT if closed[1] is None else pd.Timestamp(closed[1]), r["last"], state["last"]))
        yield pd.DataFrame(made, columns=out.names).astype({"started_at": "datetime64[ns]", "completed_at": "datetime64[ns]"})

    marked = events.withColumn("_mark", F.col("ts").cast("timestamp")).withWatermark("_mark", late)
    return marked.groupBy("run_id").applyInPandasWithState(step, out, "state string", "update", GroupStateTimeout.EventTimeTimeout)
