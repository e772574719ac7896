"""Queries that run a stream to its end; they join the same registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwood import graph_queries  # noqa: F401  (its twins are used here)
from tarnwood.catalog_queries import ORACLE_SQL, STEP_EVENTS, STEP_SQL, columns, query
from tarnwood.operators import inventory
from tarnwood.streaming import folds, policies, runs, steps
from tarnwood.views import view


def _stream(spark, sf_dir, name):
    return view(spark, sf_dir, name, runs.table_stream)


@query("stream_fold", "SELECT CAST(process_id AS STRING) AS key, round(SUM(value), 4) AS total, COUNT(*) AS n, MAX(event_id) AS last_seq FROM v_metrics GROUP BY 1")
def stream_fold(spark, sf_dir):
    events = _stream(spark, sf_dir, "metrics").selectExpr("cast(process_id as string) as key", "event_id as seq", "value")
    got = runs.finished(folds.fold_stream(events), "update")
    return inventory.latest_per(got, ["key"], [F.desc("last_seq")]).select("key", F.round("total", 4).alias("total"), "n", "last_seq")


@query("stream_steps", STEP_SQL)
def stream_steps(spark, sf_dir):
    events = _stream(spark, sf_dir, "metrics").selectExpr(*columns(STEP_EVENTS))
    got = runs.finished(steps.step_stream(events), "update")
    return inventory.latest_per(got, ["run_id", "node", "iteration"], [F.desc("seen")]).drop("seen")


@query("stream_dedup", "SELECT DISTINCT process_id, key FROM v_metrics")
def stream_dedup(spark, sf_dir):
    """The window spans all events, so that one row of each key stays however the files are cut."""
    events = _stream(spark, sf_dir, "metrics").select("process_id", "key", F.col("ts").cast("timestamp").alias("ts"))
    return runs.finished(folds.dedup_stream(events, ["process_id", "key"], "ts", "36500 days"), "append").select("process_id", "key")


def _triggers(policy):
    def run(spark, sf_dir):
        return runs.finished(policies.started_stream(_stream(spark, sf_dir, "triggers"), policy), "append")

    return run


for _policy in ("skip", "queue"):
    query(f"stream_trigger_{_policy}")(_triggers(_policy))
    ORACLE_SQL[f"stream_trigger_{_policy}"] = ORACLE_SQL[f"trigger_{_policy}"]
