"""Folds of an append-only event log into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def marking(produced: DataFrame, consumed: DataFrame) -> DataFrame:
    """Tokens that are there: produced and not consumed."""
    return produced.join(consumed.select("token_id").distinct(), "token_id", "left_anti")


def guarded_upsert(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The row with the highest sequence of each key; replays and late duplicates change nothing."""
    others = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max(F.struct(sequence, *(c for c in others if c != sequence))).alias("_s"))
    return newest.select(*keys, *(F.col(f"_s.{c}").alias(c) for c in others))


_FIRES = ("fire", "output", "error_output")
_FAILS = ("fail", "error_output")


def step_iterations(events: DataFrame) -> DataFrame:
    """Events that count for a node, each with the iteration it belongs to.

    Columns: run_id, node, sequence, kind, token, ts. An ``enter`` opens the next iteration unless its
    token came before; other events belong to the one open. A node that fires before anything entered
    has had iteration 0. Windows are per (run, node).
    """
    known = events.where(F.col("node").isNotNull() & F.col("kind").isin("enter", "fail", *_FIRES))
    again = F.row_number().over(Window.partitionBy("run_id", "node", "kind", "token").orderBy("sequence")) > 1
    rows = known.withColumn("_again", (F.col("kind") == "enter") & F.col("token").isNotNull() & again).where("not _again").drop("_again")
    order = Window.partitionBy("run_id", "node").orderBy("sequence")
    entered = F.count_if(F.col("kind") == "enter").over(order.rowsBetween(Window.unboundedPreceding, 0))
    before = F.first("kind").over(order.rowsBetween(Window.unboundedPreceding, 0)).isin(*_FIRES).cast("long")
    return rows.withColumn("iteration", F.when(entered == 0, F.lit(0).cast("long")).otherwise(entered - 1 + before))


def step_executions(events: DataFrame) -> DataFrame:
    """State of each (run, node, iteration): pending, running, completed, failed or skipped.

    A failure stays whatever follows, an output completes, a firing runs, an arrival alone waits. The
    first end of the run closes what is still open: failed for ``run_failed``, skipped for ``run_end``.
    Which of them came first within an iteration doesn't matter, so one aggregation does it.
    """
    seen = lambda kinds: F.bool_or(F.col("kind").isin(*kinds))
    last = lambda kinds: F.max_by("ts", F.when(F.col("kind").isin(*kinds), F.col("sequence")))
    state = F.when(seen(_FAILS), "failed").when(seen(("output",)), "completed").when(seen(_FIRES), "running").otherwise("pending")
    rows = step_iterations(events).groupBy("run_id", "node", "iteration").agg(
        state.alias("state"), F.min_by("ts", "sequence").alias("started_at"), F.coalesce(last(_FAILS), last(("output",))).alias("completed_at"),
        F.coalesce(F.max(F.when(F.col("kind") != "enter", F.col("sequence"))), F.lit(0)).cast("long").alias("last_sequence"),
    )
    still = F.col("state").isin("pending", "running") & F.col("end_state").isNotNull()
    closed = {"state": F.when(still, F.col("end_state")).otherwise(F.col("state")), "completed_at": F.when(still, F.coalesce("completed_at", "end_at")).otherwise(F.col("completed_at"))}
    return rows.join(run_ends(events), "run_id", "left").withColumns(closed).drop("end_state", "end_at")


def run_ends(events: DataFrame) -> DataFrame:
    """The first end of each run: run_id, end_state of what it closes, end_at."""
    ends = events.where(F.col("kind").isin("run_end", "run_failed")).groupBy("run_id").agg(F.min_by(F.struct("kind", "ts"), "sequence").alias("e"))
    return ends.select("run_id", F.when(F.col("e.kind") == "run_failed", "failed").otherwise("skipped").alias("end_state"), F.col("e.ts").alias("end_at"))


def unreached(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes (run_id, node) of ended runs that no event reached, as skipped rows of iteration 0."""
    ended = nodes.join(run_ends(events).select("run_id"), "run_id", "left_semi")
    reached = events.where(F.col("kind").isin("enter", "fail", *_FIRES)).select("run_id", "node")
    none = F.lit(None).cast(events.schema["ts"].dataType)
    return ended.join(reached, ["run_id", "node"], "left_anti").select("run_id", "node", F.lit(0).cast("long").alias("iteration"), F.lit("skipped").alias("state"), none.alias("started_at"), none.alias("completed_at"), F.lit(0).cast("long").alias("last_sequence"))


# What a job's last status makes of its grant.
JOB_STATES = {"completed": "released", "failed": "failed", "lost": "failed", "cancelled": "released", "timed_out": "expired"}


def first_holders(releases: DataFrame, held: DataFrame) -> DataFrame:
    """(alloc_id, sequence, grant): the first grant that held a released alloc_id at that sequence.

    A grant holds alloc_id after ``_from`` and before ``_to``, or for good where that is null. What it
    holds is cut into blocks of 2^level whole numbers, at most two of each level, and a block keeps
    its first grant; a release lies in one block of each level. So rows grow with the events times
    the levels, however many grants hold the same alloc_id at once.
    """
    ends = F.broadcast(releases.agg(F.min("sequence").alias("_least"), F.max("sequence").alias("_most")))  # one row
    levels = lambda size: F.explode(F.sequence(F.lit(0), F.length(F.bin(size)) - 1)).alias("_level")
    within = held.join(ends).select("alloc_id", "grant", F.greatest(F.col("_from") + 1, "_least").alias("_low"), F.least("_to", F.col("_most") + 1).alias("_high")).where("_low < _high")
    scaled = within.select("alloc_id", "grant", "_low", "_high", levels(F.col("_high") - F.col("_low"))).withColumns({"_low": F.expr("-shiftright(-_low, _level)"), "_high": F.expr("shiftright(_high, _level)")})
    loose = F.array_compact(F.array(F.expr("if((_low & 1) = 1, _low, null)"), F.expr("if((_high & 1) = 1, _high - 1, null)")))
    blocks = scaled.where("_low < _high").select("alloc_id", "grant", "_level", F.explode(loose).alias("_block")).groupBy("alloc_id", "_level", "_block").agg(F.min("grant").alias("grant"))
    asked = releases.select("alloc_id", "sequence").distinct().join(ends).select("alloc_id", "sequence", levels(F.col("_most") + 1 - F.col("_least"))).withColumn("_block", F.expr("shiftright(sequence, _level)"))
    return asked.join(blocks, ["alloc_id", "_level", "_block"]).groupBy("alloc_id", "sequence").agg(F.min("grant").alias("grant"))


def allocations(events: DataFrame) -> DataFrame:
    """Each grant as its events leave it: held, released, failed or expired.

    Columns: grant, alloc_id, sequence (long), kind (acquire, release, account), job_status, cpu_seconds, ts. A
    release without a grant goes to the first grant that held its alloc_id then. Accounts before the
    grant is known are dropped; the last final job status overrules a release, and nothing goes back to held.
    """
    named = events.where("grant is not null")
    later = F.lead("sequence").over(Window.partitionBy("grant").orderBy("sequence"))
    held = named.where("kind = 'acquire' and alloc_id is not null").select("grant", "alloc_id", F.col("sequence").alias("_from"), later.alias("_to"))
    lost = events.where("grant is null and kind = 'release' and alloc_id is not null").drop("grant")
    found = lost.distinct().join(first_holders(lost, held), ["alloc_id", "sequence"])
    known = named.unionByName(found.select(*named.columns))

    opened = F.min(F.when(F.col("kind") != "account", F.col("sequence"))).over(Window.partitionBy("grant"))
    rows = known.withColumn("_open", opened).where("_open is not null and (kind <> 'account' or sequence > _open)")
    final = F.when(F.col("kind") == "account", F.element_at(F.create_map(*(F.lit(x) for kv in JOB_STATES.items() for x in kv)), F.col("job_status")))
    rows = rows.withColumn("_final", final)
    newest = lambda value, test: F.max_by(value, F.when(test, F.col("sequence")))
    acquired, released = F.col("kind") == "acquire", F.col("kind") == "release"
    return rows.groupBy("grant").agg(
        F.coalesce(newest("_final", F.col("_final").isNotNull()), F.when(F.bool_or(released), "released"), F.lit("held")).alias("state"),
        newest("alloc_id", acquired & F.col("alloc_id").isNotNull()).alias("alloc_id"),
        F.min_by("ts", F.when(acquired, F.col("sequence"))).alias("acquired_at"),
        F.coalesce(newest("ts", released), F.min_by("ts", F.when(F.col("_final").isNotNull(), F.col("sequence")))).alias("released_at"),
        newest("cpu_seconds", (F.col("kind") == "account") & F.col("cpu_seconds").isNotNull()).alias("cpu_seconds"),
        newest("job_status", (F.col("_final") == "failed")).alias("last_error"),
        F.max("sequence").alias("last_sequence"),
    )


def chain_breaks(log: DataFrame) -> DataFrame:
    """Events whose own hash, link to the one before or sequence number is wrong."""
    w = Window.partitionBy("net").orderBy("sequence")
    link = F.concat_ws("|", F.col("net").cast("string"), F.col("sequence").cast("string"), "body", F.coalesce("previous_hash", F.lit("")))
    rows = log.withColumns({"_hash": F.lag("hash").over(w), "_seq": F.lag("sequence").over(w), "_own": F.sha2(link, 256)})
    bad = ~F.col("_own").eqNullSafe(F.col("hash")) | (F.col("_seq").isNotNull() & ~F.col("_hash").eqNullSafe(F.col("previous_hash"))) | (F.col("_seq").isNotNull() & (F.col("sequence") != F.col("_seq") + 1))
    return rows.where(bad).drop("_hash", "_seq", "_own")
