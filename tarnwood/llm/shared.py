"""Where intermediate tables are kept, and the sizes that depend on the session."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset, as in
    tests on one machine, a temporary folder takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="tarnwood-"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few_rows(spark: SparkSession, rows: list[tuple], kind: T.StructType) -> DataFrame:
    """``rows`` of the driver as a DataFrame, handed over by Arrow: executors start no Python workers for them."""
    columns = zip(*rows) if rows else [()] * len(kind.fields)
    table = pa.table([pa.array(c) if any(v is not None for v in c) else pa.nulls(len(c)) for c in map(list, columns)], names=kind.names)
    return spark.createDataFrame(table, kind)


def in_small_batches(docs: DataFrame, rows: int = 1000) -> DataFrame:
    """``docs``, after telling its session to hand at most ``rows`` rows at once to Python.

    Texts can be long; the usual ten thousand of them need not fit a Python worker's memory.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return docs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
