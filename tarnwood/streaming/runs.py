"""Streams run to the end of what is there, with their rows as a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path where ``spark.checkpoint.dir`` says; a temporary one only on one machine without that setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(named or 'file://' + tempfile.mkdtemp(prefix='tarnwood-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet files of one table of a folder as a stream."""
    path = f"{folder}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """All rows that the stream emits for the files there are; each batch is written once, also after a restart."""
    spark = stream.sparkSession
    home = shared_folder(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/rows/batch={number}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{home}/state").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/rows/batch=*")
