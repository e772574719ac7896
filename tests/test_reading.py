"""Reads and flow steps on small tables: nulls, ties, empty tables and edges of pages."""

import pytest
from pyspark.sql import functions as F

from tarnwood.operators import flows, reading


def test_tenant_leaves_no_column(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "workspace string, n int")
    kept = reading.tenant(rows, "a")
    assert kept.columns == ["n"] and [r.n for r in kept.collect()] == [1]


def test_given_ignores_none(spark):
    rows = spark.createDataFrame([("x", 1), ("y", 2)], "s string, n int")
    assert rows.where(reading.given()).count() == 2
    assert [r.n for r in rows.where(reading.given(s="y", n=None)).collect()] == [2]


def test_pluck_missing_steps(spark):
    rows = spark.createDataFrame([('{"a":[{"b":5}]}',), ('{"a":[]}',), ("no json",), (None,)], "d string")
    assert [r[0] for r in rows.select(reading.pluck(F.col("d"), "$.a[0].b", "int")).collect()] == [5, None, None, None]


@pytest.mark.parametrize("number, size, ids, more", [(0, 2, [0, 1], True), (2, 2, [4], False), (9, 2, [], False), (0, 900, [0, 1, 2, 3, 4], False)])
def test_pages(spark, number, size, ids, more):
    rows, total, follows = reading.with_page(spark.range(5), [F.col("id")], number, size)
    assert ([r.id for r in rows.collect()], total, follows) == (ids, 5, more)


def test_lineage_ways(spark):
    entries = spark.createDataFrame([(1, "p", None, None, "h1"), (2, None, "p:fit:x", None, "h2"), (3, None, "p", None, None), (4, None, None, "k", "h3"), (5, None, None, None, "h4"), (6, None, None, None, "h5")], "entry_id long, process_id string, job_id string, signal_key string, content_hash string")
    cross = spark.createDataFrame([("k", "n", 7)], "signal_key string, egress_net string, egress_seq long")
    tokens = spark.createDataFrame([("n", 7, "t")], "net string, seq long, token string")
    tags = spark.createDataFrame([("t", "p")], "token string, process string")
    producers = spark.createDataFrame([("h4", "p", None), ("h5", None, "m")], "content_hash string, process_id string, source_net string")
    processes = spark.createDataFrame([("p", "m")], "process_id string, net_id string")
    got = {(r.process_id, r.entry_id) for r in reading.lineages(entries, cross, tokens, tags, producers, processes).collect()}
    assert got == {("p", 1), ("p", 2), ("p:fit", 2), ("p", 4), ("p", 5), ("p", 6)}
    empty = [d.limit(0) for d in (entries, cross, tokens, tags, producers, processes)]
    assert reading.lineages(*empty).count() == 0


def test_lineages_pair_each_entry_and_process_once(spark):
    """Entries that come twice, with the same content, with another or without an id, and ways that overlap."""
    rows = [(k % 40 or None, f"p{k % 5}" if k % 3 else None, f"p{k % 4}:x" if k % 7 else None, f"k{k % 6}", f"h{k % 9}" if k % 8 else None) for k in range(120)]
    entries = spark.createDataFrame(rows, "entry_id long, process_id string, job_id string, signal_key string, content_hash string")
    cross = spark.createDataFrame([(f"k{k}", "n", k) for k in range(5)], "signal_key string, egress_net string, egress_seq long")
    tokens = spark.createDataFrame([("n", k, f"t{k % 3}") for k in range(4)] * 2, "net string, seq long, token string")
    tags = spark.createDataFrame([("t0", "p0"), ("t1", "p1"), ("t1", "p9"), ("t2", None)], "token string, process string")
    producers = spark.createDataFrame([(f"h{k % 8}" if k else None, f"p{k % 6}" if k % 2 else None, f"m{k % 3}") for k in range(30)], "content_hash string, process_id string, source_net string")
    processes = spark.createDataFrame([("p1", "m0"), ("p7", "m1"), (None, "m2")], "process_id string, net_id string")
    makers = {(h, p) for h, p, _ in producers.collect()} | {(h, p) for h, _, m in producers.collect() for p, n in processes.collect() if m == n}
    signals = {(s, p) for s, _, q in cross.collect() for _, at, t in tokens.collect() for u, p in tags.collect() if q == at and t == u}
    want = set()
    for e, own, job, signal, content in rows:
        found = {own, job and job.split(":")[0]} | {p for s, p in signals if s == signal} | {p for h, p in makers if h == content and h}
        want |= {(p, e) for p in found if p}
    got = [tuple(r) for r in reading.lineages(entries, cross, tokens, tags, producers, processes).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_lineages_by_content_go_through_no_aggregation(spark):
    """Two hundred processes made what two hundred entries hold: the 40,000 pairs are not dealt out again."""
    entries = spark.range(200).selectExpr("id as entry_id", "cast(null as string) as process_id", "cast(null as string) as job_id", "cast(null as string) as signal_key", "'h' as content_hash")
    none = spark.createDataFrame([], "signal_key string, egress_net string, egress_seq long, net string, seq long, token string, process string, process_id string, net_id string")
    producers = spark.range(200).selectExpr("'h' as content_hash", "concat('p', id) as process_id", "cast(null as string) as source_net")
    found = reading.lineages(entries, none, none, none, producers, none)
    plan = found._jdf.queryExecution().optimizedPlan()
    assert plan.getClass().getSimpleName() == "Union" and not plan.children().head().getClass().getSimpleName().startswith("Aggregate")
    assert found.count() == 40000 == found.distinct().count()


def test_classified(spark):
    observed = spark.createDataFrame([("s", "a", 1, None, 0), ("s", "a", 2, " ", 1), ("s", "b", 3, "x", 0), ("s", "c", 4, None, 0)], "server string, path string, size long, hash string, ord int")
    legacy = spark.createDataFrame([("s", "a", 1, 2, "la"), ("s", "b", 2, None, "lb"), ("s", "b", 3, 3, "late")], "server string, path string, legacy_key long, legacy_size long, legacy_hash string")
    got = {r.path: (r.status, r.content_hash, r.legacy_size) for r in reading.classified(observed, legacy).collect()}
    assert got == {"a": ("verified", "la", None), "b": ("mismatch", "x", None), "c": ("orphan_disk", None, None)}


def test_register_needs_hashes(spark):
    known = spark.createDataFrame([("h",)], "content_hash string")
    files = spark.createDataFrame([("s", "a", "h", 1, 0), ("s", "b", None, 1, 1)], "server string, path string, content_hash string, size_bytes long, ord int")
    with pytest.raises(ValueError):
        reading.register(known, files)
    new, copies = reading.register(known, files.where("content_hash is not null"))
    assert new.count() == 0 and copies.count() == 1


def test_ordinality_of_unlike_lengths(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], [5]), (2, None, [6])], "k int, x array<string>, y array<int>")
    assert [tuple(r) for r in reading.with_ordinality(rows, "x", "y").orderBy("ord").collect()] == [(1, 1, "a", 5), (1, 2, "b", None)]


def test_facets_without_metadata(spark):
    rows = spark.createDataFrame([(None, None, None, None, 3, None), ("", "m", "n", "s", None, '{"format":"csv","columns":7,"column_names":"a"}')], "category string, mime_type string, source_net string, process_step string, size_bytes long, meta string")
    got = {(r.dim, r.key): (r.n, r.bytes) for r in reading.all_facets(rows, "meta").collect()}
    assert got[("category", "uncategorized")] == (2, 3) and got[("format", "csv")] == (1, 0) and got[("format", "unknown")] == (1, 3)
    assert not [k for k in got if k[0] in ("column", "classification")]


def test_call_and_lookup(spark):
    tokens = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, None, 7)], "id int, key string, v int")
    child = lambda rows: rows.where("x > 5").withColumn("v", F.col("x") * 2)
    assert {(r.id, r.key, r.v) for r in flows.call(tokens, child, "id", {"x": "v"}).collect()} == {(2, "b", 12), (3, None, 14)}
    catalogue = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), (None, 9, "none")], "key string, at int, name string")
    assert {(r.id, r.found.name if r.found else None) for r in flows.looked_up(tokens, catalogue, "key", "at").collect()} == {(1, "new"), (2, None), (3, None)}


def test_sample_cap(spark):
    rows, cut = flows.sample_cap(spark.range(5), 3)
    assert rows.count() == 3 and cut
    assert not flows.sample_cap(spark.range(3), 3)[1]
