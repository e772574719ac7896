"""Streams over file sources give the rows of the batch."""

from datetime import datetime

import pandas as pd

from tarnwood.operators import projections
from tarnwood.streaming import folds, steps


def run(spark, tmp_path, rows, schema, made, mode):
    """All rows that a stream emits whose source are two files in order."""
    folder, half = tmp_path / "in", len(rows) // 2
    for k, part in enumerate((rows[:half], rows[half:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = made(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)))
    name = f"out{abs(hash(str(tmp_path)))}"
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination()
    return spark.table(name)


def test_fold_equals_batch(spark, tmp_path):
    rows = [("ab"[k % 2], k, float(k % 7)) for k in range(60)]
    rows = rows[:40] + rows[10:20] + rows[40:]
    schema = "key string, seq long, value double"
    got = run(spark, tmp_path, rows, schema, folds.fold_stream, "update").groupBy("key").agg({"last_seq": "max", "total": "max", "n": "max"})
    want = folds.fold_batch(spark.createDataFrame(rows, schema))
    assert {(r[0], r["max(total)"], r["max(n)"], r["max(last_seq)"]) for r in got.collect()} == {(r.key, r.total, r.n, r.last_seq) for r in want.collect()}


def test_fold_skips_what_it_has_seen():
    rows = pd.DataFrame({"seq": [3, 5, 5, 9], "value": [1.0, 2.0, 2.0, 4.0]})
    assert folds.fold_rows((4, 10.0, 1), rows) == (9, 16.0, 3)
    assert folds.fold_rows((9, 16.0, 3), rows) == (9, 16.0, 3)


def test_gather_fires_once(spark, tmp_path):
    rows = [("a", 3, 2, 20.0), ("b", 2, 0, 1.0), ("a", 3, 0, 0.0), ("a", 3, 1, 10.0), ("a", 3, 9, 90.0), ("z", 0, 0, 5.0)]
    got = run(spark, tmp_path, rows, "key string, expected long, idx long, value double", folds.gather_stream, "append")
    assert [(r.key, r.vals) for r in got.collect()] == [("a", [0.0, 10.0, 20.0])]


def test_coalesce_makes_one_follow_up(spark, tmp_path):
    rows = [("k", 1, "fire", "p1"), ("k", 2, "fire", "p2"), ("k", 3, "fire", "p3"), ("k", 4, "done", ""), ("k", 5, "done", ""), ("k", 6, "fire", "p4")]
    got = run(spark, tmp_path, rows, "key string, seq long, kind string, payload string", folds.coalesce_stream, "append")
    assert [r.started for r in got.collect()] == ["p1", "p3", "p4"]


def test_dedup_within_window(spark, tmp_path):
    rows = [("k", i % 3, datetime(2024, 1, 1, 0, 0, i)) for i in range(9)]
    got = run(spark, tmp_path, rows, "place string, id long, ts timestamp", lambda s: folds.dedup_stream(s, ["place", "id"], "ts", "2 minutes"), "append")
    assert sorted(r.id for r in got.collect()) == [0, 1, 2]


def _at(k):
    return datetime(2024, 1, 1, 0, 0, k)


STEP = "run_id string, node string, sequence long, kind string, token long, ts timestamp"


def test_steps_by_the_states_they_go_through(spark, tmp_path):
    rows = [
        ("r", "a", 1, "enter", 7, _at(1)), ("r", "a", 2, "enter", 7, _at(2)), ("r", "a", 3, "fire", None, _at(3)), ("r", "a", 4, "output", None, _at(4)),
        ("r", "a", 5, "enter", 8, _at(5)), ("r", "a", 6, "fail", None, _at(6)), ("r", "a", 7, "output", None, _at(7)), ("r", "b", 8, "fire", None, _at(8)),
        ("r", "b", 9, "enter", 9, _at(9)), ("s", "a", 10, "enter", None, _at(10)), ("r", None, 11, "run_failed", None, _at(11)), ("r", None, 12, "run_end", None, _at(12)),
        ("t", "c", 13, "fail", None, _at(13)), ("t", "c", 14, "enter", 1, _at(14)), ("t", None, 15, "run_end", None, _at(15)),
    ]
    want = {
        ("r", "a", 0, "completed", _at(1), _at(4), 4), ("r", "a", 1, "failed", _at(5), _at(6), 7), ("r", "b", 0, "failed", _at(8), _at(11), 8),
        ("r", "b", 1, "failed", _at(9), _at(11), 0), ("s", "a", 0, "pending", _at(10), None, 0), ("t", "c", 0, "failed", _at(13), _at(13), 13),
    }
    events = spark.createDataFrame(rows, STEP)
    names = ["run_id", "node", "iteration", "state", "started_at", "completed_at", "last_sequence"]
    assert {tuple(r) for r in projections.step_executions(events).select(*names).collect()} == want
    nodes = spark.createDataFrame([(r, n) for r in "rs" for n in "az"], "run_id string, node string")
    assert [(r.run_id, r.node, r.state) for r in projections.unreached(events, nodes).collect()] == [("r", "z", "skipped")]
    # Rows that come again in a later batch change nothing.
    again = rows[:7] + rows[2:7] + rows[7:]
    got = run(spark, tmp_path, again, STEP, steps.step_stream, "update").collect()
    newest = {(r.run_id, r.node, r.iteration): r for r in sorted(got, key=lambda r: r.seen)}
    assert {tuple(r[n] for n in names) for r in newest.values()} == want


def test_first_holders_without_pairs(spark):
    """Ten thousand grants hold one allocation at 500 releases; no join compares sequences, which would form the pairs."""
    held = spark.range(10000).selectExpr("concat('g', id) as grant", "1L as alloc_id", "id % 700 - 350 as _from", "if(id % 3 = 0, null, id % 700 - 350 + id % 97) as _to")
    releases = spark.range(500).selectExpr("1L as alloc_id", "id * 2 - 400 as sequence")
    found = projections.first_holders(releases, held)
    want = {}
    spans = [(r.grant, r._from, r._to) for r in held.collect()]
    for at in (r.sequence for r in releases.collect()):
        holding = [g for g, a, b in spans if a < at and (b is None or at < b)]
        if holding:
            want[at] = min(holding)
    assert {r.sequence: r.grant for r in found.collect()} == want and found.count() == len(want)
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x and "rightHint" not in x]  # one row has the hint
    assert joins and not any(" < " in x or " > " in x for x in joins)
    assert projections.first_holders(releases.limit(0), held).count() == 0 and projections.first_holders(releases, held.limit(0)).count() == 0


def test_grants(spark):
    rows = [
        ("g1", 5, 1, "acquire", None, None, 1), ("g1", None, 2, "account", "running", 3, 2), (None, 5, 3, "release", None, None, 3), ("g1", None, 4, "account", "lost", None, 4),
        ("g2", None, 5, "account", "failed", 9, 5), ("g2", 6, 6, "acquire", None, None, 6), ("g3", None, 7, "release", None, None, 7), ("g3", 8, 8, "acquire", None, None, 8),
        (None, 99, 9, "release", None, None, 9), ("g4", None, 10, "account", "timed_out", None, 10), ("g5", 1, 11, "acquire", None, None, 11), ("g5", None, 12, "account", "timed_out", 4, 12),
    ]
    events = spark.createDataFrame([(*r[:6], _at(r[6])) for r in rows], "grant string, alloc_id long, sequence long, kind string, job_status string, cpu_seconds long, ts timestamp")
    got = {r.grant: (r.state, r.alloc_id, r.acquired_at, r.released_at, r.cpu_seconds, r.last_error, r.last_sequence) for r in projections.allocations(events).collect()}
    assert got == {
        "g1": ("failed", 5, _at(1), _at(3), 3, "lost", 4), "g2": ("held", 6, _at(6), None, None, None, 6),
        "g3": ("released", 8, _at(8), _at(7), None, None, 8), "g5": ("expired", 1, _at(11), _at(12), 4, None, 12),
    }
