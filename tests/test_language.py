"""The query language with a fixed now, and small helpers."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tarnwood.functions import dsl, params
from tarnwood.functions.expressions import chart_step, go_seconds, satisfies, schema_fingerprint, size_class
from tarnwood.operators.profiling import merged_type

NOW = datetime(2026, 6, 10, 12)


@pytest.mark.parametrize(
    "text,kind,name,op,value",
    [
        ("report", "search", "", "", "report"), ('"two words"', "search", "", "", "two words"), ("category:model", "filter", "category", "eq", "model"), ("x!=1", "filter", "x", "ne", "1"), ("x!:1", "filter", "x", "ne", "1"),
        ("name^pre", "filter", "name", "starts_with", "pre"), ("name$post", "filter", "name", "ends_with", "post"), ("filename~report", "filter", "filename", "contains", "report"), ("name:null", "filter", "name", "is_null", ""),
        ("name:*", "filter", "name", "is_not_null", ""), ('name:"null"', "filter", "name", "eq", "null"), ("category:a,b", "filter", "category", "in", "a,b"), ("category!:a,b", "filter", "category", "not_in", "a,b"),
        ("size_bytes>=1.5g", "filter", "size_bytes", "gte", "1.5g"), ("col:email", "col", "", "", "email"), ("attr:k=v", "attr", "k", "", "v"), ("datatype:invoice", "datatype", "", "", "invoice"),
    ],
)
def test_terms(text, kind, name, op, value):
    query = dsl.parse(text)
    assert not query.errors and query.terms == [dsl.Term(kind, value, name, op)]


@pytest.mark.parametrize("text", ["size_bytes>abc", "attr:novalue", "attr:=v", "field:", "a<", 'name:"open', "created_at>soon", ":x"])
def test_errors_are_collected(text):
    query = dsl.parse("ok " + text)
    assert [t.value for t in query.terms] == ["ok"] and [e[0] for e in query.errors] == [3]


def test_coercions():
    assert dsl.coerced("size_bytes", "1.5g", NOW) == str(3 << 29) and dsl.coerced("size_bytes", "10kib", NOW) == "10240" and dsl.coerced("n", "10k", NOW) == "10k"
    assert dsl.coerced("created_at", "-7d", NOW) == "2026-06-03T12:00:00.000Z" and dsl.coerced("created_at", "-90m", NOW) == "2026-06-10T10:30:00.000Z"


def test_filters_reach_the_scan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    test = dsl.compile_query(dsl.parse("n_chars>100 source:src1"), docs.schema, NOW)
    plan = docs.where(test).select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(n_chars,100)" in plan and "EqualTo(source,src1)" in plan and "text" not in plan.split("ReadSchema")[1]


def test_size_classes(spark):
    sizes = [None, 0, 1023, 1024, (1 << 20) - 1, 1 << 20, 1 << 24, 1 << 28, 1 << 30, (1 << 32) - 1, 1 << 32]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in sizes], "s long").select(size_class(F.col("s"))).collect()]
    assert got == ["unknown", "<1K", "<1K", "1K-1M", "1K-1M", "1-16M", "16-256M", "256M-1G", "1-4G", "1-4G", ">=4G"]


def test_small_helpers(spark):
    assert [chart_step(3600, n) for n in (3600, 100, 3, 0)] == [0, 60, 1800, 0]
    assert go_seconds("1h30m") == 5400 and go_seconds("250ms") == 0.25
    with pytest.raises(ValueError):
        go_seconds("soon")
    fields = [("b", "int", True), ("a", "string", False)]
    assert schema_fingerprint(fields) == schema_fingerprint(fields[::-1]) != schema_fingerprint(fields[:1])
    assert [merged_type(*p) for p in (("int64", "float64"), ("int64", None), ("bool", "int64"))] == ["float64", "int64", "string"]
    caps = spark.createDataFrame([({"gpu": {"n": "5", "kind": "a"}},)], "c map<string,map<string,string>>")
    tests = [[("gpu", "n", "eq", 5.0)], [("gpu", "n", "gte", 6)], [("gpu", "kind", "in", ["a", "b"])], [("gpu", "x", "exists", None)], [], [("gpu", "n", "near", 5)]]
    assert caps.select(*(satisfies(F.col("c"), t).alias(str(k)) for k, t in enumerate(tests))).first() == (True, False, True, False, True, False)


def test_bracket_params():
    got = params.parse_params("filter[createdAt][gt]=2024-01-01&filter[meta.numRows]=5&filter[x][near]=1&sort=-createdAt,%2Bname&page=3&size=900&size=many")
    assert got.query.terms == [dsl.Term("filter", "2024-01-01", "created_at", "gt"), dsl.Term("filter", "5", "meta.num_rows", "eq")]
    assert got.sort == ["-createdAt", "+name"] and (got.page, got.size) == (3, 900) and len(got.warnings) == 2
    assert [params.snake(n) for n in ("name", "sizeBytes", "a.bC")] == ["name", "size_bytes", "a.b_c"]
