"""Run, node and request rollups and their time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwood.functions.expressions import LATENCY_BOUNDS, bucket_start


def outcome() -> Column:
    """A completed run whose result is not ok counts as failure; runs that go on have no outcome."""
    return F.when((F.col("status") == "completed") & ~F.col("result_ok"), "failure").when(F.col("status") == "completed", "success").when(F.col("status") == "failed", "failure")


def run_rollup(runs: DataFrame, width: int = 3600) -> DataFrame:
    """Hour grain: runs, summed duration and number of known durations per template and outcome."""
    done = runs.withColumn("outcome", outcome()).where("outcome is not null")
    return done.groupBy("template", "outcome", bucket_start(F.col("created_at"), width).alias("bucket")).agg(F.count("*").alias("n_runs"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("sum_ms"), F.count("duration_ms").alias("n_ms"))


def run_series(rollup: DataFrame, width: int) -> DataFrame:
    """The rollup in wider buckets, with the guarded mean."""
    wide = rollup.groupBy("template", (F.col("bucket") - F.pmod("bucket", F.lit(width))).alias("bucket"))
    count = lambda o: F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col("n_runs"))), F.lit(0))
    return wide.agg(count("success").alias("n_success"), count("failure").alias("n_failure"), F.try_divide(F.sum("sum_ms"), F.sum("n_ms")).alias("mean_ms"))


def percentiles(runs: DataFrame, value: str, keys: list[str], accuracy: int | None = None) -> DataFrame:
    """Median and 95th percentile per group. Exact ones hold a group's distinct values in one buffer;
    with ``accuracy`` they come from a sketch of that size."""
    at = (lambda p: F.percentile(value, p)) if accuracy is None else (lambda p: F.percentile_approx(value, p, accuracy))
    return runs.groupBy(*keys).agg(F.count(value).alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"))


def node_rollup(steps: DataFrame) -> DataFrame:
    done = steps.where(F.col("status").isin("completed", "failed"))
    return done.groupBy("node").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.coalesce(F.sum("ms"), F.lit(0)).alias("sum_ms"), F.count("ms").alias("n_ms"))


def hotspots(rollup: DataFrame, most: int = 5) -> DataFrame:
    """The slowest and the most failing nodes, ``most`` of each."""
    rows = rollup.withColumn("mean_ms", F.try_divide("sum_ms", "n_ms"))
    slow = rows.where("mean_ms is not null").orderBy(F.desc("mean_ms"), "node").limit(most).withColumn("kind", F.lit("slow"))
    failing = rows.where("n_failed > 0").orderBy(F.desc("n_failed"), "node").limit(most).withColumn("kind", F.lit("failing"))
    return slow.union(failing)


def metric_summary(metrics: DataFrame) -> DataFrame:
    last = F.max_by("value", F.struct("ts", "event_id"))
    return metrics.groupBy("key").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), last.alias("last"))


def metric_series(metrics: DataFrame, width: int, since: str, until: str) -> DataFrame:
    """Mean per bucket over the half-open interval [since, until)."""
    scope = metrics.where((F.col("ts") >= F.lit(since).cast("timestamp_ntz")) & (F.col("ts") < F.lit(until).cast("timestamp_ntz")))
    return scope.groupBy("key", bucket_start(F.col("ts"), width).alias("bucket")).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def request_series(requests: DataFrame, width: int) -> DataFrame:
    done = F.col("status") == "completed"
    return requests.groupBy("model", bucket_start(F.col("started_at"), width).alias("bucket")).agg(
        F.count("*").alias("n"), F.count_if(done).alias("n_completed"), F.count_if(F.col("status") == "upstream_error").alias("n_errors"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("n_tokens"), F.percentile(F.when(done, F.col("seconds")), 0.5).alias("p50"), F.percentile(F.when(done, F.col("seconds")), 0.95).alias("p95"),
    )


def status_counters(requests: DataFrame) -> DataFrame:
    """Requests by status per model; a status of another name still adds its tokens."""
    names = ("completed", "unmetered", "cancelled", "upstream_error")
    return requests.groupBy("model").agg(*(F.count_if(F.col("status") == s).alias(s) for s in names), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


def latency_histogram(requests: DataFrame) -> DataFrame:
    """Cumulative counts per model and upper bound; values above the last bound count in the total only."""
    sums = requests.groupBy("model").agg(*(F.count_if(F.col("seconds") <= b).alias(f"b{k}") for k, b in enumerate(LATENCY_BOUNDS)), F.count("*").alias("n"))
    rungs = F.array(*(F.struct(F.lit(b).alias("le"), F.col(f"b{k}").alias("cumulative")) for k, b in enumerate(LATENCY_BOUNDS)))
    return sums.select("model", "n", F.inline(rungs))


def rollup_users(runs: DataFrame) -> DataFrame:
    at = bucket_start(F.col("created_at"), 1)
    return runs.groupBy("template", "user_id").agg(F.count("*").alias("n"), F.min(at).alias("first_run"), F.max(at).alias("last_run"))


def merge_rollup(old: DataFrame, new: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Incremental merge: counts and sums of both sides add up."""
    return old.unionByName(new).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))
