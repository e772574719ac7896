"""Dataset profiling: inferred types, statistics, quality, classes, schema differences."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The patterns by which string columns are classified.
PATTERNS: dict[str, str] = {
    "email": r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$",
    "phone": r"^(\+?\d{1,3}[-.\s]?)?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}$",
    "ip_address": r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$",
    "credit_card": r"^(?:\d[ \-]*?){13,19}$",
    "ssn": r"^\d{3}-\d{2}-\d{4}$",
    "url": r"^https?://[^\s<>\"{}|\\^\x60]+$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "iso_date": r"^\d{4}-\d{2}-\d{2}$",
    "iso_datetime": r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}",
    "hex_color": r"^#([0-9a-fA-F]{3}|[0-9a-fA-F]{6})$",
    "semver": r"^\d+\.\d+\.\d+",
    "file_path": r"^(/[^\x00]+)+$|^[A-Za-z]:\\",
    "json_string": r"^\{.*\}$|^\[.*\]$",
    "base64": r"^[A-Za-z0-9+/]{20,}={0,2}$",
    "md5_hash": r"^[0-9a-fA-F]{32}$",
    "sha256_hash": r"^[0-9a-fA-F]{64}$",
    "ipv6_address": r"^([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$",
    "mac_address": r"^([0-9a-fA-F]{2}[:\-]){5}[0-9a-fA-F]{2}$",
}

# Category, name pattern, integer or float, range.
SEMANTIC = (
    ("latitude", "(?i)^lat(itude)?$", "float", -90.0, 90.0),
    ("longitude", "(?i)^lon(g(itude)?)?$", "float", -180.0, 180.0),
    ("percentage", "(?i)(pct|percent|ratio|rate)", "float", 0.0, 100.0),
    ("unix_timestamp", "(?i)(created|updated|modified)_at|timestamp", "int", 0.0, 8589934592.0),
    ("boolean_int", "(?i)^(is_|has_|flag)", "int", 0.0, 1.0),
    ("year", "(?i)^year$", "int", 1900.0, 2100.0),
    ("age", "(?i)^age$", "int", 0.0, 150.0),
)


def _long(df: DataFrame) -> DataFrame:
    """(column, value): every cell as text, one row per cell, from one scan."""
    cells = F.create_map(*(x for c in df.columns for x in (F.lit(c), F.col(c).cast("string"))))
    return df.select(F.explode(cells).alias("column", "value"))


def column_statistics(df: DataFrame) -> DataFrame:
    """Rows, nulls, exact distinct count and numeric range per column; an empty string counts as null."""
    cells = _long(df).withColumn("value", F.nullif("value", F.lit("")))
    number = F.expr("try_cast(value as double)")
    # Counted per distinct value first, so that a frequent value shrinks before the shuffle.
    values = cells.groupBy("column", "value").agg(F.count("*").alias("n")).withColumn("number", number)
    return values.groupBy("column").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"), F.count("value").alias("n_distinct"),
        F.min("number").alias("low"), F.max("number").alias("high"), F.try_divide(F.sum(F.col("number") * F.col("n")), F.sum(F.when(F.col("number").isNotNull(), F.col("n")))).alias("mean"),
    )


def column_quality(stats: DataFrame) -> DataFrame:
    """Completeness, distinctness and their mean; null for an empty table."""
    full = 1 - F.try_divide("n_null", "n_rows")
    distinct = F.least(F.lit(1.0), F.coalesce(F.try_divide("n_distinct", F.col("n_rows") - F.col("n_null")), F.lit(0.0)))
    return stats.select("column", full.alias("completeness"), distinct.alias("distinctness"), ((full + distinct) / 2).alias("score"))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def infer_types(df: DataFrame) -> DataFrame:
    """Type of string columns: bool, int, float or string by what all non-empty values parse as."""
    cells = _long(df)
    some = F.col("value") != ""
    whole, part = F.expr("try_cast(value as bigint)"), F.expr("try_cast(value as double)")
    sums = cells.groupBy("column").agg(
        F.count_if(some).alias("n"), F.count_if(some & F.col("value").isin("true", "false")).alias("b"), F.count_if(some & F.col("value").rlike("^[+-]?[0-9]+$") & whole.isNotNull()).alias("i"),
        F.count_if(some & F.col("value").rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$") & part.isNotNull()).alias("f"), F.bool_or(~F.coalesce(some, F.lit(False))).alias("nullable"),
    )
    kind = F.when(F.col("n") == 0, "string").when(F.col("b") == F.col("n"), "bool").when(F.col("i") == F.col("n"), "int64").when(F.col("f") == F.col("n"), "float64").otherwise("string")
    return sums.select("column", kind.alias("type"), "nullable")


def merged_type(a: str | None, b: str | None) -> str | None:
    """Type of a field seen as both: null never overrides, integers widen to floats, else string."""
    if a is None or b is None or a == b:
        return a or b
    return "float64" if {a, b} == {"int64", "float64"} else "string"


def _json_type(value) -> str:
    """An array has the type of its first element; an empty one and null are text."""
    if isinstance(value, dict):
        return "struct<" + ",".join(f"{k}:{_json_type(v)}" for k, v in sorted(value.items())) + ">"
    if isinstance(value, list):
        return f"list<{_json_type(value[0]) if value else 'string'}>"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "int64" if isinstance(value, int) and -(1 << 63) <= value < 1 << 63 else "float64"
    return "string"


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType()), T.StructField("empty", T.BooleanType())])))
def _json_fields(texts: pd.Series) -> pd.Series:
    def fields(text):
        try:
            found = json.loads(text or "")
        except ValueError:
            return None
        return [{"name": k, "type": _json_type(v), "empty": v is None} for k, v in found.items()] if isinstance(found, dict) else None

    return pd.Series([fields(t) for t in texts], dtype=object)


def infer_json_types(rows: DataFrame, text: str, order: str) -> DataFrame:
    """column, type, nullable of the top fields of JSON objects; what is no object is passed over.

    Integers and decimals make float64, any other two types string. A field that is null at its
    first sight (by ``order``) stays a string. Strings, and fields that some object lacks or holds
    as null, are nullable.
    """
    objects = rows.select(order, _json_fields(F.col(text)).alias("_f")).where("_f is not null")
    # The row without a name counts the objects.
    seen = objects.select(order, F.explode(F.concat(F.col("_f"), F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit("").alias("type"), F.lit(True).alias("empty")))))).select(order, "col.*")
    kinds = seen.groupBy("name", "type", "empty").agg(F.count("*").alias("n"), F.min(order).alias("at"))
    full = ~F.col("empty")
    names = kinds.groupBy("name").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(full, F.col("n"))), F.lit(0)).alias("n_full"), F.min_by("empty", F.struct("at", "empty")).alias("empty_first"),
        F.count_if(full).alias("n_types"), F.min(F.when(full, F.col("type"))).alias("a"), F.max(F.when(full, F.col("type"))).alias("b"),
    )
    total = names.where("name is null").select(F.col("n").alias("total"))
    mixed = (F.col("n_types") == 2) & (F.col("a") == "float64") & (F.col("b") == "int64")
    kind = F.when(F.col("empty_first"), "string").when(F.col("n_types") == 1, F.col("a")).when(mixed, "float64").otherwise("string")
    typed = names.where("name is not null").join(F.broadcast(total)).withColumn("type", kind)  # one row
    return typed.select(F.col("name").alias("column"), "type", ((F.col("n_full") < F.col("total")) | (F.col("type") == "string")).alias("nullable"))


def parquet_statistics(spark, path: str) -> DataFrame:
    """n_rows, n_null, low and high of every numeric column of Parquet files.

    The counts are pushed into the scan and answered from the footers. The ranges are read, as
    Spark refuses footers of row groups that hold only nulls. The session's switch for pushing
    aggregates stays on; it acts on no other reader of Parquet.
    """
    key = "spark.sql.sources.useV1SourceList"
    before = spark.conf.get(key)
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    spark.conf.set(key, ",".join(s for s in before.split(",") if s != "parquet"))
    try:
        footers = spark.read.parquet(path)
    finally:
        spark.conf.set(key, before)
    names = [f.name for f in footers.schema.fields if isinstance(f.dataType, T.NumericType) and not isinstance(f.dataType, T.DecimalType)]
    cells = [(k, F.col(f"`{c}`")) for k, c in enumerate(names)]
    counts = footers.agg(F.count("*").alias("n"), *(F.count(c).alias(f"c{k}") for k, c in cells))
    ranges = spark.read.parquet(path).agg(*(x for k, c in cells for x in (F.min(c).alias(f"l{k}"), F.max(c).alias(f"h{k}"))))
    rows = [F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), (F.col("n") - F.col(f"c{k}")).alias("n_null"), F.col(f"l{k}").cast("double").alias("low"), F.col(f"h{k}").cast("double").alias("high")) for k, c in enumerate(names)]
    return counts.join(F.broadcast(ranges)).select(F.inline(F.array(*rows)))  # one row each


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    return df.limit(n)


def classify_patterns(df: DataFrame, least: float) -> DataFrame:
    """Share of non-empty values that match each pattern, where it is at least ``least``."""
    cells = _long(df.select(*(f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)))).where("value <> ''")
    counts = cells.groupBy("column").agg(F.count("*").alias("n"), *(F.count_if(F.col("value").rlike(p)).alias(k) for k, p in PATTERNS.items()))
    rows = F.array(*(F.struct(F.lit(k).alias("category"), F.col(k).alias("matches")) for k in PATTERNS))
    return counts.select("column", "n", F.inline(rows)).withColumn("confidence", F.col("matches") / F.col("n")).where(F.col("confidence") >= least)


def classify_semantic(stats: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Rules by name, type and range: 0.9 for all three, 0.6 without the name, 0.5 without statistics."""
    kind = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    rules = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(p).alias("pattern"), F.lit(k).alias("kind"), F.lit(a).alias("least"), F.lit(b).alias("most")) for c, p, k, a, b in SEMANTIC))
    rows = stats.withColumn("r", F.explode(rules)).where(F.try_element_at(kind, F.col("column")) == F.col("r.kind"))
    name = F.expr("column rlike r.pattern")
    known = F.col("low").isNotNull()
    fits = F.coalesce((F.col("low") >= F.col("r.least")) & (F.col("high") <= F.col("r.most")), F.lit(False))
    sure = F.when(name & fits, 0.9).when(~name & fits, 0.6).when(name & ~known, 0.5)
    return rows.select("column", F.col("r.category").alias("category"), sure.alias("confidence")).where("confidence is not null")


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full outer join of two column lists (column, type, nullable): what was added, removed, changed."""
    o, n = (d.select("column", F.col("type").alias(f"{p}_type"), F.col("nullable").alias(f"{p}_nullable")) for d, p in ((old, "old"), (new, "new")))
    change = F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed").when(F.col("old_type") != F.col("new_type"), "type").when(F.col("old_nullable") != F.col("new_nullable"), "nullability")
    return o.join(n, "column", "full").withColumn("change", change).where("change is not null")


def columns_of(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields], "column string, type string, nullable boolean")


def assertion(value: Column, op: str, expected=None) -> Column:
    """One check over a text value: exists, eq, neq, gt, gte, lt, lte, matches, contains."""
    number = value.try_cast("double")
    tests = {
        "exists": lambda: value.isNotNull(), "not_exists": lambda: value.isNull(), "eq": lambda: value == str(expected), "neq": lambda: value != str(expected), "matches": lambda: value.rlike(expected),
        "contains": lambda: value.contains(expected), "gt": lambda: number > expected, "gte": lambda: number >= expected, "lt": lambda: number < expected, "lte": lambda: number <= expected,
    }
    return F.coalesce(tests[op](), F.lit(False))
