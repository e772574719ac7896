"""File listings, formats and text expositions as sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwood.plans import lineage

# Format by file name suffix.
FORMATS: dict[str, str] = {
    **dict.fromkeys(("csv", "tsv", "tab"), "csv"), **dict.fromkeys(("parquet", "pq"), "parquet"), **dict.fromkeys(("json", "jsonl", "ndjson"), "json"), **dict.fromkeys(("arrow", "arrows", "ipc", "feather"), "arrow"),
    **dict.fromkeys(("h5", "hdf5", "he5"), "hdf5"), **dict.fromkeys(("nc", "nc4", "netcdf"), "netcdf"), **dict.fromkeys(("jpg", "jpeg", "jpe"), "jpeg"), **dict.fromkeys(("tif", "tiff"), "tiff"), "png": "png", "gif": "gif",
    **dict.fromkeys(("gz", "gzip", "tgz"), "gzip"), **dict.fromkeys(("zip", "jar", "war"), "zip"), "tar": "tar", **dict.fromkeys(("yaml", "yml"), "yaml"), **dict.fromkeys(("md", "markdown"), "markdown"),
    **dict.fromkeys(("xml", "xsl", "xsd", "svg"), "xml"), **dict.fromkeys(("html", "htm", "xhtml"), "html"), **dict.fromkeys(("txt", "text", "log"), "txt"), **dict.fromkeys(("xlsx", "xlsm", "xlsb"), "xlsx"), "xls": "xls",
}


def format_of(path: Column) -> Column:
    """Format by the suffix; an unknown suffix names itself, a path without one is null."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    known = F.create_map(*(F.lit(x) for kv in FORMATS.items() for x in kv))
    return F.when(suffix != "", F.coalesce(F.try_element_at(known, suffix), F.concat(F.lit("unknown:"), suffix)))


def crawl(spark: SparkSession, root: str, after: str = "", hashes: bool = False) -> DataFrame:
    """path, length, modification time of all files below ``root`` behind the cursor ``after``.

    Contents are read only for ``hashes``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("path") > after)
    kept = files.select("path", "length", "modificationTime", *([F.sha2("content", 256).alias("content_hash")] if hashes else []))
    return kept.withColumn("format", format_of(F.col("path")))


def exposition(lines: DataFrame) -> DataFrame:
    """name, labels and value of a text exposition; comments and broken lines are left out."""
    form = r"^([a-zA-Z_:][\w:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+\d+)?$"
    got = lines.select(*(F.regexp_extract("value", form, k).alias(n) for k, n in ((1, "name"), (2, "labels"), (3, "v"))))
    pair = r'([a-zA-Z_]\w*)\s*=\s*"((?:[^"\\]|\\.)*)"'
    part = lambda k: F.regexp_extract_all("labels", F.lit(pair), k)
    plain = lambda v: F.regexp_replace(F.regexp_replace(v, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"), r"\\(.)", "$1")
    pairs = F.when(F.col("labels") != "", F.map_from_arrays(part(1), F.transform(part(2), plain)))
    return got.where("name <> ''").select("name", pairs.alias("labels"), F.expr("try_cast(v as double)").alias("value"))


def bounded_query(spark: SparkSession, sql: str, args: dict, most: int) -> tuple[DataFrame, bool]:
    """A parametrised statement with at most ``most`` rows, and whether more were there."""
    rows = lineage.cut(spark.sql(sql, args=args).limit(most + 1))
    return rows.limit(most), rows.count() > most


def range_query(samples: DataFrame, start: int, end: int, step: int, stale: int = 300) -> DataFrame:
    """The latest sample of each series not older than ``stale`` seconds at every step."""
    steps = F.sequence(F.greatest(F.lit(start), F.ceil((F.col("t") - start) / step) * step + start).cast("long"), F.least(F.lit(end), F.col("t") + stale).cast("long"), F.lit(step).cast("long"))
    fits = samples.where((F.col("t") <= end) & (F.col("t") + stale >= F.greatest(F.lit(start), F.ceil((F.col("t") - start) / step) * step + start)))
    return fits.select("series", "t", "value", F.explode(steps).alias("at")).groupBy("series", "at").agg(F.max_by("value", "t").alias("value"))
