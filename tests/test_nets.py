"""Schedules, trigger policies, metadata documents and nets that SQL twins don't cover."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tarnwood.functions import cron, metadata
from tarnwood.operators import causality, inventory, nets, profiling, provenance, ranking
from tarnwood.sources import metric_results
from tarnwood.streaming import policies
from tests.test_streams import run


def test_cron_fields():
    assert cron.parse_cron("*/20 0 1-5/2 * Feb ?")[:3] == [{0, 20, 40}, {0}, {1, 3, 5}] and cron.parse_cron("5 * * * *")[:2] == [{0}, {5}]
    assert cron.parse_cron("30 */20 0 1-5/2 Feb Sun,Sat")[3:] == [{1, 3, 5}, {2}, {1, 7}]
    for bad in ("* * * *", "60 * * * *", "5-1 * * * *", "*/0 * * * *", "* * * Foo *", "* * * * 0"):
        with pytest.raises(ValueError):
            cron.parse_cron(bad)


def test_fire_times_follow_the_zone(spark):
    got = [r.at for r in cron.fire_times(spark, "0 9 * * *", datetime(2024, 3, 30), datetime(2024, 4, 1), "Europe/Berlin").orderBy("at").collect()]
    # Summer time begins on the 31st.
    assert got == [datetime(2024, 3, 30, 8), datetime(2024, 3, 31, 7)]


def test_missed_fires_run_once(spark):
    span = datetime(2024, 1, 1, 0, 30), datetime(2024, 1, 1, 5)
    assert [r.at for r in cron.catch_up(spark, "0 * * * *", *span, True).collect()] == [datetime(2024, 1, 1, 1)]
    assert cron.catch_up(spark, "0 * * * *", *span, False).count() == 0
    assert cron.catch_up(spark, "0 0 * * *", *span, True).count() == 0


TRIGGERS = [("k", 1, "done", ""), ("k", 2, "fire", "a"), ("k", 3, "fire", "b"), ("m", 4, "fire", "x"), ("k", 5, "fire", "c"), ("k", 6, "done", ""), ("k", 7, "fire", "d"), ("k", 8, "done", ""), ("k", 9, "done", ""), ("k", 10, "done", ""), ("k", 11, "fire", "e")]
SCHEMA = "key string, seq long, kind string, payload string"


@pytest.mark.parametrize("policy,want", [("allow", "abcdex"), ("skip", "adex"), ("queue", "abcdex")])
def test_policies_over_a_stream_equal_the_batch(spark, tmp_path, policy, want):
    batch = {tuple(r) for r in policies.started(spark.createDataFrame(TRIGGERS, SCHEMA), policy).collect()}
    stream = {tuple(r) for r in run(spark, tmp_path, TRIGGERS, SCHEMA, lambda s: policies.started_stream(s, policy), "append").collect()}
    assert batch == stream and "".join(sorted(r[2] for r in batch)) == want


def test_queued_runs_wait_for_ends(spark):
    got = {r.started: r.seq for r in policies.started(spark.createDataFrame(TRIGGERS, SCHEMA), "queue").collect()}
    assert got == {"a": 2, "b": 6, "c": 8, "d": 9, "e": 11, "x": 4}
    with pytest.raises(ValueError):
        policies.started(spark.createDataFrame(TRIGGERS, SCHEMA), "never")


def test_json_types(spark):
    docs = ['{"n":null,"i":1,"e":[],"l":[1.5,2]}', "broken", '{"n":3,"i":2.0,"l":[2.5],"s":{"b":[true],"a":null}}', "[1]", None, '{"n":4,"i":null,"l":[1]}']
    rows = spark.createDataFrame(list(enumerate(docs)), "i long, doc string")
    got = {r.column: (r.type, r.nullable) for r in profiling.infer_json_types(rows, "doc", "i").collect()}
    assert got == {"n": ("string", True), "i": ("float64", True), "e": ("list<string>", True), "l": ("string", True), "s": ("struct<a:string,b:list<bool>>", True)}
    assert profiling.infer_json_types(rows.limit(0), "doc", "i").count() == 0


def test_footers_answer_counts(spark, tmp_path):
    spark.createDataFrame([(1, None, "a"), (2, 5.5, None), (None, -1.0, "c")], "i int, d double, s string").write.parquet(str(tmp_path / "p"))
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    got = profiling.parquet_statistics(spark, str(tmp_path / "p"))
    assert {tuple(r) for r in got.collect()} == {("i", 3, 1, 1.0, 2.0), ("d", 3, 1, -1.0, 5.5)}
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    assert "PushedAggregation: [" in got._jdf.queryExecution().toString() and "COUNT(i)" in got._jdf.queryExecution().toString()


def test_details_view(spark):
    text = '{"duration_secs":3725.4,"total_byte_size":2048,"codec":{"bitrate_kbps":320,"lossless":true,"name":null},"empty":[],"tags":["a",1],"row_groups":[{"rows":1},{"rows":2,"kind":{"unknown":"x"}}]}'
    rows = spark.createDataFrame([(text,), (None,), ("[1]",), ("oops",)], "d string")
    first, *others = [r.v for r in rows.select(metadata.details_view("d").alias("v")).collect()]
    assert [tuple(f) for f in first.fields] == [("duration", "1:02:05", None), ("total byte", "2.0 KB", None), ("bitrate", "320", "kbps"), ("lossless", "true", None), ("tags", "a, 1", None)]
    assert [(t.title, t.columns, t.cells) for t in first.tables] == [("row groups", ["rows", "kind"], [["1", ""], ["2", "x"]])]
    assert all(v.fields == [] and v.tables == [] for v in others)


def test_metadata_fields(spark):
    docs = ['{"format":{"unknown":"fasta"},"num_rows":"many"}', '{"format":"csv","num_rows":12,"format_specific":{"details":{"has_header":true}}}', "{}", None]
    fields = metadata.metadata_fields(F.col("d"))
    got = spark.createDataFrame([(d,) for d in docs], "d string").select(*(fields[f"meta.{n}"][0].alias(n) for n in ("format", "num_rows", "has_header"))).collect()
    assert [tuple(r) for r in got] == [("fasta", None, None), ("csv", 12, True), (None, None, None), (None, None, None)]
    assert metadata.applies_to("compression")[:2] == ("parquet", "jpeg") and metadata.applies_to("schema") == () and len(fields) == 33


def test_scalar_of_one_sample(spark):
    rows = [("q1", "scalar", '[1,"2"]'), ("q2", "vector", '[{"metric":{},"value":[1,"3"]},{"metric":{},"value":[1,"4"]}]'), ("q3", "vector", '[{"metric":{},"value":[1,"NaN"]}]'), ("q4", "matrix", '[{"metric":{},"values":[[1,"3"]]}]'), ("q5", "vector", "[]")]
    samples = metric_results.flat_samples(spark.createDataFrame(rows, "q string, kind string, result string"))
    assert {tuple(r) for r in metric_results.scalar_of(samples, "q").collect()} == {("q1", "2"), ("q2", None), ("q3", "NaN"), ("q4", None)}


def test_parents_in_a_circle_end(spark):
    nodes = spark.createDataFrame([("g", "a", "b", "map"), ("g", "b", "a", "step"), ("h", "x", None, "step"), ("h", "y", "x", "sub_workflow")], "graph string, node string, parent string, kind string")
    got = {r.graph: r for r in nets.graph_shape(spark, nodes, spark.createDataFrame([("g",)], "graph string")).collect()}
    assert (got["g"].depth, got["g"].has_loops, got["g"].n_edges) == (3, True, 1)
    assert (got["h"].depth, got["h"].n_sub, got["h"].n_edges, got["h"].kinds) == (1, 1, 0, {"step": 1, "sub_workflow": 1})


def test_several_tags_share_one_cause(spark):
    events = spark.createDataFrame([("n", 1, "TransitionFired"), ("n", 2, "TransitionFired"), ("n", 3, "TokenCreated"), ("n", 4, "TokenCreated"), ("o", 0, "TransitionFired")], "net string, seq long, kind string")
    tokens = spark.createDataFrame([("n", k, f"t{k}", "produced", "sig_x" if k == 3 else "p", None) for k in (1, 2, 3, 4)] + [("o", 0, "t0", "produced", "p", None)], "net string, seq long, token string, role string, place string, data string")
    none = spark.createDataFrame([], "signal_key string, egress_net string, egress_seq long, ingress_net string, ingress_seq long")
    tags = spark.createDataFrame([("t1", "a"), ("t2", "b"), ("t3", "a"), ("t3", "b"), ("t4", "b"), ("t0", "a")], "token string, process string")
    got = causality.cause_links(events, tokens, none, none, tags)
    assert {tuple(r) for r in got.collect()} == {("n", 3, "process", "n", 2), ("n", 4, "process", "n", 2)}


def test_attach_keeps_what_is_held(spark):
    make = lambda *rows: spark.createDataFrame(rows, "digest string, type_id int, attached int")
    got = inventory.attach(make(("a", 1, 1), ("b", 1, 2)), make(("a", 2, 3), ("c", 2, 4)), make(("b", 1, 2)))
    assert {tuple(r) for r in got.collect()} == {("a", 1, 1), ("c", 2, 4)}


def test_reached_survives_circles_and_diamonds(spark):
    # 30 diamonds in a row have 2**30 paths; the last link closes a circle.
    rows = [(f"n{k}", f"{side}{k}") for k in range(30) for side in "ab"] + [(f"{side}{k}", f"n{k + 1}") for k in range(30) for side in "ab"] + [("n30", "n0")]
    links = spark.createDataFrame(rows, "node string, cause string").coalesce(1)
    got = {r.node: r.depth for r in provenance.reached(links, spark.createDataFrame([("r", "n0")], "root string, node string"), 9).collect()}
    assert got == {f"n{k}": 2 * k for k in range(5)} | {f"{side}{k}": 2 * k + 1 for k in range(5) for side in "ab"}
    two = spark.createDataFrame([("x", "y"), ("y", "x")], "node string, cause string")
    assert provenance.reached(two, spark.createDataFrame([("r", "x")], "root string, node string"), 50).count() == 2


def test_folders_above_all_paths_without_nested_loops(spark):
    folders = spark.createDataFrame([("/a", 1, "r"), ("/a/b", 2, "w"), ("/ab", 9, "x"), ("", 0, "all"), ("/c/d", 3, "y")], "folder string, rank int, role string")
    paths = [("/a/b/f",), ("/a/bc",), ("/ab",), ("/c/d/e/g",), ("/z",), ("no",), (None,)]
    chain = ranking.ancestor_folders(folders, spark.createDataFrame(paths, "home string"))
    assert {r.home: r.folders for r in chain.collect()} == {"/a/b/f": ["/a/b", "/a", ""], "/a/bc": ["/a", ""], "/ab": ["/ab", ""], "/c/d/e/g": ["/c/d", ""], "/z": [""]}
    grants = ranking.best_grant(folders, spark.createDataFrame(paths, "path string"))
    assert {r.path: r.role for r in grants.collect()} == {"/a/b/f": "w", "/a/bc": "r", "/ab": "x", "/c/d/e/g": "y", "/z": "all"}
    for found in (chain, grants):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ancestry_of_all_nodes_to_the_end(spark):
    links = spark.createDataFrame([(f"1:{k}", f"1:{k - 1}") for k in range(1, 9)], "node string, cause string")
    seen = provenance.reached(links, links.selectExpr("node as root", "node"))
    assert {(r.root, r.node, r.depth) for r in seen.collect()} == {(f"1:{a}", f"1:{b}", a - b) for a in range(1, 9) for b in range(a + 1)}
    assert provenance.edges_within(links, seen).count() == 36
