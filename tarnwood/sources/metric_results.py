"""Results of metric servers as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SERIES = "array<struct<metric:map<string,string>,value:array<string>,values:array<array<string>>>>"


def flat_samples(results: DataFrame, kind: str = "kind", result: str = "result") -> DataFrame:
    """One row per sample: labels, ts (seconds), value (null where not finite) and raw value.

    ``result`` is JSON: vector, matrix, or a pair for scalar and string; other kinds give no rows.
    The columns of ``results`` stay.
    """
    series = F.from_json(F.when(F.col(kind).isin("vector", "matrix"), F.col(result)), _SERIES)
    lone = F.from_json(F.when(F.col(kind).isin("scalar", "string"), F.col(result)), "array<string>")
    sample = lambda labels, pair: F.struct(labels.alias("labels"), F.try_element_at(pair, F.lit(1)).try_cast("double").alias("ts"), F.coalesce(F.try_element_at(pair, F.lit(2)), F.lit("")).alias("raw"))
    vector = F.transform(F.filter(series, lambda s: s["value"].isNotNull()), lambda s: sample(s["metric"], s["value"]))
    matrix = F.flatten(F.transform(F.filter(series, lambda s: s["values"].isNotNull()), lambda s: F.transform(s["values"], lambda p: sample(s["metric"], p))))
    pairs = F.when(F.col(kind) == "vector", vector).when(F.col(kind) == "matrix", matrix).when(lone.isNotNull(), F.array(sample(F.create_map().cast("map<string,string>"), lone)))
    rows = results.withColumn("_s", F.explode(pairs)).select(*results.columns, "_s.labels", "_s.ts", "_s.raw")
    return rows.withColumn("value", finite(F.col("raw")))


def finite(raw: Column) -> Column:
    number = raw.try_cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)


def scalar_of(samples: DataFrame, query: str, kind: str = "kind") -> DataFrame:
    """The raw value per query whose scalar or vector result has exactly one sample, else null."""
    n = samples.groupBy(query, kind).agg(F.count("*").alias("n"), F.min("raw").alias("_raw"))
    return n.select(query, F.when((F.col("n") == 1) & F.col(kind).isin("scalar", "vector"), F.col("_raw")).alias("scalar"))
