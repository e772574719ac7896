from pyspark.sql import functions as F

from tarnwood.operators import dataflow
from tarnwood.sources import files, sinks


def test_crawl_and_formats(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, text in (("a/x.CSV", "1"), ("a/y.parquet", "22"), ("z", "333"), ("w.odd", "4444")):
        (tmp_path / name).write_text(text)
    got = {r.path.split("/")[-1]: (r.length, r.format) for r in files.crawl(spark, str(tmp_path)).collect()}
    assert got == {"x.CSV": (1, "csv"), "y.parquet": (2, "parquet"), "z": (3, None), "w.odd": (4, "unknown:odd")}
    first = sorted(r.path for r in files.crawl(spark, str(tmp_path)).collect())[0]
    assert files.crawl(spark, str(tmp_path), after=first).count() == 3


def test_exposition(spark):
    lines = ["# HELP x", 'reqs{model="a",zone="z"} 12 1700000', "up 1", "bad line here now", 'nan_one{} NaN']
    got = {r.name: (r.labels, r.value) for r in files.exposition(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got["reqs"] == ({"model": "a", "zone": "z"}, 12.0) and got["up"] == (None, 1.0) and set(got) == {"reqs", "up", "nan_one"}


def test_exposition_labels_hold_commas_and_quotes(spark):
    rows = [(r'm{a="x,y=1",b="say \"hi\"",c="a\\n",d="e\nf"} 1',)]
    assert files.exposition(spark.createDataFrame(rows, "value string")).first().labels == {"a": "x,y=1", "b": 'say "hi"', "c": "a\\n", "d": "e\nf"}


def test_bounded_query(spark):
    rows, more = files.bounded_query(spark, "select id from range(:n)", {"n": 7}, 5)
    assert rows.count() == 5 and more
    assert not files.bounded_query(spark, "select id from range(:n)", {"n": 5}, 5)[1]


def test_range_query(spark):
    samples = spark.createDataFrame([("s", 0, 1.0), ("s", 50, 2.0), ("t", 400, 3.0)], "series string, t long, value double")
    got = {(r.series, r["at"]): r.value for r in files.range_query(samples, 0, 600, 60, stale=100).collect()}
    assert got == {("s", 0): 1.0, ("s", 60): 2.0, ("s", 120): 2.0, ("t", 420): 3.0, ("t", 480): 3.0}


def test_first_match_equals_nested_loops(spark):
    left = spark.createDataFrame([(k, k % 3, float(k)) for k in range(12)], "l long, lk long, lv double")
    right = spark.createDataFrame([(k, float(k % 3), float(20 - k)) for k in range(12)], "r long, rk double, rv double")
    got = {x.l: x.r for x in dataflow.first_match(left, right, (F.col("lk") == F.col("rk")) & (F.col("rv") > F.col("lv")), "l", "r").collect()}
    want = {}
    for a in range(12):
        for b in range(12):
            if a % 3 == b % 3 and 20 - b > a:
                want.setdefault(a, b)
    assert got == want


def test_first_above_equals_first_match_without_pairs(spark):
    """Ties, nulls, NaN and zeros of both signs; one key over many ranges."""
    odd = [None, float("nan"), 0.0, -0.0, 2.0]
    left = spark.createDataFrame([(k, k % 2 or None, odd[k // 2 % 5] if k % 4 < 2 else float(k * 7 % 31)) for k in range(200)], "l long, k long, v double")
    right = spark.createDataFrame([(k, k % 3 % 2, odd[k // 3 % 4] if k % 6 < 3 else float(k * 5 % 29)) for k in range(90, 300)], "r long, k long, v double")
    renamed = right.selectExpr("r", "k as rk", "v as rv")
    want = {tuple(x) for x in dataflow.first_match(left, renamed, (F.col("k") == F.col("rk")) & (F.col("rv") > F.col("v")), "l", "r").collect()}
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        for way in ("true", "false"):  # without it the ranges stay apart
            spark.conf.set("spark.sql.adaptive.enabled", way)
            found = dataflow.first_above(left, right, "k", "v", "l", "r")
            assert len(want) > 50 and {tuple(x) for x in found.collect()} == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    assert joins and not any(" < " in x or " > " in x for x in joins)
    assert dataflow.first_above(left, right.limit(0), "k", "v", "l", "r").count() == 0


def test_imports_replace_and_read_gzip(spark, tmp_path):
    import gzip

    (tmp_path / "a.json.gz").write_bytes(gzip.compress(b'{"k":"x","n":1}\n{"k":"y","n":"oops"}\n'))
    (tmp_path / "b.tsv").write_text("k\tn\nz\t3\n")
    for _ in range(2):
        got = sinks.import_dump(spark, str(tmp_path / "a.json.gz"), "k string, n long", str(tmp_path / "t"))
    assert {tuple(r) for r in got.collect()} == {("x", 1), ("y", None)}
    assert [tuple(r) for r in sinks.import_dump(spark, str(tmp_path / "b.tsv"), "k string, n long", str(tmp_path / "t"), "tsv").collect()] == [("z", 3)]


def test_a_sink_goes_on_where_it_stopped(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for rows in ([("a", 1, 1.0), ("b", 2, 2.0)], [("a", 5, 9.0), ("b", 1, 7.0)], []):
        if rows:
            spark.createDataFrame(rows, "k string, seq long, v double").write.mode("append").parquet(folder)
        sinks.keyed_sink(spark.readStream.schema("k string, seq long, v double").parquet(folder), out, state).awaitTermination()
    assert {tuple(r) for r in sinks.current(spark, out, ["k"], "seq").collect()} == {("a", 5, 9.0), ("b", 2, 2.0)}
    assert spark.read.parquet(out).count() == 4


def test_a_day_that_comes_again_is_replaced(spark, tmp_path):
    for day, n in (("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-01", 3)):
        sinks.daily(spark.createDataFrame([(f"{day} 05:00:00", n)], "at string, n long"), "at", str(tmp_path / "s"))
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [2, 3]
