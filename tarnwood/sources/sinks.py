"""Imports and sinks that can be run again without doubling rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwood.operators.projections import guarded_upsert


def import_dump(spark: SparkSession, source: str, schema: str, target: str, kind: str = "json") -> DataFrame:
    """A dump of JSON lines or of tab-separated text (``kind`` tsv), plain or gzip, as the whole content of ``target``.

    Lines that don't fit the schema become rows of nulls where they don't fit.
    """
    reader = spark.read.schema(schema)
    rows = reader.json(source) if kind == "json" else reader.option("sep", "\t").option("header", True).csv(source)
    rows.write.mode("overwrite").parquet(target)
    return spark.read.schema(schema).parquet(target)


def keyed_sink(rows: DataFrame, folder: str, checkpoint: str):
    """A started query that keeps each micro-batch of a stream as a partition of ``folder``.

    The cursor is the query's checkpoint; it moves on only after the batch is written, and a batch
    that runs again replaces its own partition. ``current`` reads the merged rows.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return rows.writeStream.foreachBatch(store).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()


def current(spark: SparkSession, folder: str, keys: list[str], sequence: str) -> DataFrame:
    """The rows of a keyed sink: per key that of the highest sequence."""
    return guarded_upsert(spark.read.parquet(folder).drop("batch"), keys, sequence)


def daily(snapshots: DataFrame, at: str, folder: str) -> None:
    """Snapshots added to ``folder``, partitioned by day; a day that comes again is replaced."""
    days = snapshots.withColumn("day", F.to_date(at)).repartition("day")
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(folder)
