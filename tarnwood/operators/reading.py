"""Reads of the catalogue and the inventory: tenants, pages, facets, lineage, statistics and lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tenant(rows: DataFrame, workspace: str, column: str = "workspace") -> DataFrame:
    """Rows of one workspace. The column is gone afterwards, so no filter of a user reaches it."""
    return rows.where(F.col(column) == workspace).drop(column)


def given(**values: object) -> Column:
    """Equality with every parameter that is not None; true without any."""
    return reduce(lambda a, b: a & b, (F.col(c) == v for c, v in values.items() if v is not None), F.lit(True))


def pluck(document: Column, path: str, kind: str = "string") -> Column:
    """The value at a path of keys and array indices, e.g. ``$.a[0].b``; null where any step is missing or the text is no JSON."""
    return F.try_variant_get(F.try_parse_json(document), path, kind)


def with_page(rows: DataFrame, order: list[Column], number: int, size: int) -> tuple[DataFrame, int, bool]:
    """A page of at most 500 rows, the number of all rows, and whether more follow."""
    total, size = rows.count(), min(size, 500)
    return rows.orderBy(*order).offset(number * size).limit(size), total, total > (number + 1) * size


_CLASSES = T.ArrayType(T.StructType([T.StructField("classifications", T.ArrayType(T.StructType([T.StructField("category", T.StringType())])))]))


def facet_keys(metadata: Column) -> Column:
    """(dim, key) of all eight dimensions of an entry, for one pass over the entries.

    Columns and classes yield one pair for each element, a class only once; what is no array yields none.
    """
    part = lambda path: F.get_json_object(metadata, path)
    plain = {
        "format": F.coalesce(part("$.format.unknown"), F.when(~part("$.format").startswith("{"), part("$.format")), F.lit("unknown")),
        "category": F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("uncategorized")),
        "mime_type": F.coalesce("mime_type", F.lit("unknown")),
        "source_net": F.coalesce("source_net", F.lit("none")),
        "process_step": F.coalesce("process_step", F.lit("none")),
        "schema": F.coalesce(part("$.schema_fingerprint.digest"), F.lit("none")),
    }
    pair = lambda dim, key: F.struct(F.lit(dim).alias("dim"), key.alias("key"))
    names = F.from_json(part("$.column_names"), T.ArrayType(T.StringType()))
    classes = F.flatten(F.transform(F.filter(F.from_json(part("$.columns"), _CLASSES), lambda c: c["classifications"].isNotNull()), lambda c: c["classifications"]["category"]))
    lists = {"column": names, "classification": F.array_distinct(classes)}
    each = lambda dim, keys: F.transform(keys, lambda key: pair(dim, key))
    none = F.array().cast("array<struct<dim:string,key:string>>")
    return F.concat(F.array(*(pair(d, k) for d, k in plain.items())), *(F.coalesce(each(d, ks), none) for d, ks in lists.items()))


def all_facets(entries: DataFrame, metadata: str, most: int | None = None) -> DataFrame:
    """(dim, key, n, bytes), with ``most`` only the largest buckets of each dimension."""
    pairs = entries.select("size_bytes", F.explode(facet_keys(F.col(metadata))).alias("f")).select("f.dim", "f.key", "size_bytes")
    out = pairs.groupBy("dim", "key").agg(F.count("*").alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    if most is None:
        return out
    w = Window.partitionBy("dim").orderBy(F.desc("n"), "key")
    return out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def lineages(entries: DataFrame, cross: DataFrame, tokens: DataFrame, tags: DataFrame, producers: DataFrame, processes: DataFrame) -> DataFrame:
    """(process_id, entry_id) of every process, by four ways.

    An entry names the process, or its job does in front of a colon, or the event that sent its
    signal touched a token of the process, or the process or its net produced the same content.
    """
    parts = F.split("job_id", ":")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.when(n < F.size(parts), F.array_join(F.slice(parts, 1, n), ":")))
    own = entries.select("process_id", "entry_id")
    by_job = entries.where("job_id is not null").select(F.explode(above).alias("process_id"), "entry_id")
    touched = cross.select("signal_key", F.col("egress_net").alias("net"), F.col("egress_seq").alias("seq")).join(tokens.select("net", "seq", "token"), ["net", "seq"]).select("signal_key", "token").distinct()
    sent = touched.join(tags.select("token", F.col("process").alias("process_id")), "token").select("signal_key", "process_id").distinct()
    by_signal = entries.select("signal_key", "entry_id").join(sent, "signal_key").select("process_id", "entry_id")
    by_net = producers.join(processes.select("net_id", F.col("process_id").alias("_p")), F.col("source_net") == F.col("net_id")).select("content_hash", F.col("_p").alias("process_id"))
    made = producers.select("content_hash", "process_id").union(by_net).where("content_hash is not null and process_id is not null").distinct()
    return _by_content(entries, made, reduce(DataFrame.union, [own, by_job, by_signal]).where("process_id is not null"))


def _by_content(entries: DataFrame, made: DataFrame, others: DataFrame) -> DataFrame:
    """Distinct (process_id, entry_id) of ``others`` and of entries with content that a process ``made``.

    Most pairs come by content, each entry with all makers of its content. Those of an entry with one
    content are distinct as they are and go through no shuffle; only other ways' pairs are looked up among them.
    """
    known = entries.where("content_hash is not null and entry_id is not null").groupBy("entry_id").agg(F.min("content_hash").alias("content_hash"), F.max("content_hash").alias("_last"))
    single = known.where("content_hash = _last").select("entry_id", "content_hash")
    several = entries.select("entry_id", "content_hash").join(known.where("content_hash <> _last").select("entry_id"), "entry_id", "left_semi").distinct()
    nameless = entries.where("entry_id is null").select("entry_id", "content_hash").distinct()
    more = several.union(nameless).join(made, "content_hash").select("process_id", "entry_id")
    seen = others.join(single, "entry_id", "left").join(made.withColumn("_made", F.lit(True)), ["content_hash", "process_id"], "left").where("_made is null").select("process_id", "entry_id")
    return single.join(made, "content_hash").select("process_id", "entry_id").union(seen.union(more).distinct())


def lineage(entries: DataFrame, members: DataFrame, process: str, categories: list[str] = (), since: str | None = None, until: str | None = None, most: int = 5000) -> DataFrame:
    """The oldest 1 to 5000 entries of one process; an empty list or None filters nothing."""
    rows = entries.join(members.where(F.col("process_id") == process).select("entry_id"), "entry_id", "left_semi")
    if categories:
        rows = rows.where(F.col("category").isin(*categories))
    if since is not None:
        rows = rows.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        rows = rows.where(F.col("created_at") < F.lit(until).cast("timestamp_ntz"))
    return rows.orderBy("created_at", "entry_id").limit(max(1, min(most, 5000)))


def net_statistics(entries: DataFrame, net: str, at: str) -> DataFrame:
    return entries.groupBy(net).agg(F.count("*").alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def inventory_statistics(files: DataFrame) -> DataFrame:
    """(dim, key, n): all files, by status and by server, in one pass."""
    dims = F.create_map(F.lit("total"), F.lit(""), F.lit("status"), F.col("status"), F.lit("server"), F.col("server"))
    return files.select(F.explode(dims).alias("dim", "key")).groupBy("dim", "key").agg(F.count("*").alias("n"))


def classified(observed: DataFrame, legacy: DataFrame) -> DataFrame:
    """The last observation of each path with its status, hash and the legacy size where that differs.

    ``observed``: server, path, size, hash, ord; ``legacy``: server, path, legacy_key, legacy_size,
    legacy_hash. A hash that was observed, blanks aside, wins over the legacy one; a legacy row
    without a size is a mismatch.
    """
    last = observed.groupBy("server", "path").agg(F.max_by(F.struct("size", "hash"), "ord").alias("o"))
    first = legacy.groupBy("server", "path").agg(F.min_by(F.struct("legacy_size", "legacy_hash"), "legacy_key").alias("l"))
    rows = last.join(first, ["server", "path"], "left")
    same = F.col("l.legacy_size") == F.col("o.size")
    status = F.when(F.col("l").isNull(), "orphan_disk").when(same, "verified").otherwise("mismatch")
    seen = F.nullif(F.trim("o.hash"), F.lit(""))
    noted = F.when(F.col("l").isNotNull() & ~F.col("l.legacy_size").eqNullSafe(F.col("o.size")), F.col("l.legacy_size"))
    return rows.select("server", "path", F.col("o.size").alias("size"), F.coalesce(seen, "l.legacy_hash").alias("content_hash"), status.alias("status"), noted.alias("legacy_size"))


def with_ordinality(rows: DataFrame, *arrays: str) -> DataFrame:
    """Parallel arrays as rows, with the place ``ord`` from 1; a shorter array gives nulls."""
    kept = [c for c in rows.columns if c not in arrays]
    out = rows.select(*kept, F.posexplode(F.arrays_zip(*arrays)).alias("_at", "_z"))
    return out.select(*kept, (F.col("_at") + 1).alias("ord"), *(F.col(f"_z.{a}").alias(a) for a in arrays))


def register(contents: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new contents, copies) for files with a hash; the oldest name of a content not known yet stays.

    Raises ValueError, before anything is returned, where a file has no hash: both halves or none.
    """
    if not files.where("content_hash is null or trim(content_hash) = ''").isEmpty():
        raise ValueError("each file needs a content_hash")
    named = files.groupBy("content_hash").agg(F.min_by(F.struct("path", "size_bytes"), "ord").alias("f")).select("content_hash", F.col("f.path").alias("name"), "f.size_bytes")
    copies = files.groupBy("server", "path").agg(F.max_by("content_hash", "ord").alias("content_hash"))
    return named.join(contents.select("content_hash"), "content_hash", "left_anti"), copies
