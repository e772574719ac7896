"""Breakdown, snapshots, reconciliation and duplicates of a file inventory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwood.functions.expressions import age_cohort, extension, size_class, under


def dimension(name: str, depth: int = 1, prefix: str = "") -> Column:
    if name == "directory":
        rest = F.ltrim("path", F.lit("/"))
        if prefix.strip("/"):
            rest = F.substr(rest, F.lit(len(prefix.strip("/")) + 2))
        return F.array_join(F.slice(F.split(rest, "/"), 1, depth), "/")
    return {
        "server": F.col("server"),
        "extension": F.coalesce(extension(F.col("path")), F.lit("none")),
        "size_class": size_class(F.col("size_bytes")),
        "age": age_cohort(F.col("age_days")),
        "owner": F.coalesce(F.col("uid").cast("string"), F.lit("unknown")),
        "status": F.col("status"),
    }[name]


def breakdown(files: DataFrame, by: str, depth: int = 1, prefix: str = "", most: int | None = None) -> DataFrame:
    """key, n_files, bytes (largest first); for directories also whether all files end at this level."""
    scope = files.where(under(F.col("path"), prefix))
    aggs = [F.count("*").alias("n_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")]
    if by == "directory":
        rest = F.ltrim("path", F.lit("/"))
        if prefix.strip("/"):
            rest = F.substr(rest, F.lit(len(prefix.strip("/")) + 2))
        aggs.append(F.bool_and(F.size(F.split(rest, "/")) <= depth).alias("is_leaf"))
    out = scope.groupBy(dimension(by, depth, prefix).alias("key")).agg(*aggs)
    return out if most is None else out.orderBy(F.desc("bytes"), "key").limit(most)


def snapshot(files: DataFrame) -> DataFrame:
    """Counts and bytes per (workspace, server) by four dimensions in one pass of grouping sets."""
    top = F.split_part(F.ltrim("path", F.lit("/")), F.lit("/"), F.lit(1))
    rows = files.select("workspace", "server", "size_bytes", F.explode(F.create_map(F.lit("total"), F.lit(""), F.lit("extension"), F.coalesce(extension(F.col("path")), F.lit("none")), F.lit("top_dir"), top, F.lit("status"), F.col("status"))).alias("dim", "key"))
    return rows.groupBy("workspace", "server", "dim", "key").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def latest_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def reconcile(observed: DataFrame, legacy: DataFrame) -> DataFrame:
    """Each observed file with its verdict against the first legacy row of the same server and path."""
    first = latest_per(legacy, ["server", "path"], [F.col("legacy_key")])
    status = F.when(F.col("legacy_key").isNull(), "orphan_disk").when(F.col("legacy_size") == F.col("size_bytes"), "verified").otherwise("mismatch")
    return observed.join(first, ["server", "path"], "left").withColumn("verdict", status)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """Copy-on-write merge. Rules per column: new (overwrite), fill (keep old where new is null), old."""
    o, n = old.select(*keys, *(F.col(c).alias(f"_o_{c}") for c in rules), F.lit(True).alias("_in_old")), new.select(*keys, *(F.col(c).alias(f"_n_{c}") for c in rules), F.lit(True).alias("_in_new"))
    both = o.join(n, keys, "full")
    pick = {"new": lambda c: F.when(F.col("_in_new"), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")), "fill": lambda c: F.coalesce(f"_n_{c}", f"_o_{c}"), "old": lambda c: F.coalesce(f"_o_{c}", f"_n_{c}")}
    return both.select(*keys, *(pick[rule](c).alias(c) for c, rule in rules.items()))


def duplicate_groups(files: DataFrame) -> DataFrame:
    """The copies of contents held more than once: a row each, with their content's count and whether one is canonical.

    Counts are combined before the shuffle, and the join back may be split where one content has very many copies.
    """
    held = files.where("content_hash is not null")
    groups = held.groupBy("content_hash").agg(F.count("*").alias("n_copies"), F.bool_or("is_canonical").alias("has_canonical")).where("n_copies > 1")
    return held.select("content_hash", "server", "path").join(groups, "content_hash")


def canonical_changes(files: DataFrame) -> DataFrame:
    """Rows whose canonical mark changes when the first (server, path) of each repeated content has it."""
    w = Window.partitionBy("content_hash")
    ranked = files.where("content_hash is not null").withColumns({"_n": F.count("*").over(w), "_rank": F.row_number().over(w.orderBy("server", "path"))})
    return ranked.where("_n > 1").withColumn("now_canonical", F.col("_rank") == 1).where("now_canonical <> is_canonical").drop("_n", "_rank")


def retire_eligible(files: DataFrame, server: str) -> DataFrame:
    """Files of a server with a verified copy of the same content on another one."""
    safe = files.where((F.col("server") != server) & (F.col("status") == "verified")).select("content_hash").distinct()
    return files.where(F.col("server") == server).join(safe, "content_hash", "left_semi")


def import_duplicates(files: DataFrame) -> DataFrame:
    """One row per content: the first name by age (nulls last), largest size, least first sight."""
    first = F.min(F.struct(F.col("age_days").isNull().alias("late"), F.col("age_days").alias("age"), F.col("path").alias("path")))
    return files.groupBy("content_hash").agg(first.alias("f"), F.max("size_bytes").alias("size_bytes"), F.min("first_seen").alias("first_seen"), F.count("*").alias("n")).select("content_hash", F.col("f.path").alias("path"), "size_bytes", "first_seen", "n")


def facets(rows: DataFrame, key: Column, placeholder: str, most: int | None = None) -> DataFrame:
    out = rows.groupBy(F.coalesce(key.cast("string"), F.lit(placeholder)).alias("key")).agg(F.count("*").alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    return out if most is None else out.orderBy(F.desc("n"), "key").limit(most)


def facet_elements(rows: DataFrame, elements: Column, once_per_row: bool = False) -> DataFrame:
    """Facet over array elements; a row without elements counts nowhere."""
    return facets(rows.withColumn("_e", F.explode(F.array_distinct(elements) if once_per_row else elements)), F.col("_e"), "unknown")


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of at most 500 rows; the offset counts pages of the asked, not the clamped, size."""
    return rows.orderBy(*order).offset(number * size).limit(min(size, 500))


def any_of(*parts: DataFrame, on: str) -> DataFrame:
    """Distinct ids that any membership path yields."""
    return reduce(lambda a, b: a.union(b), (p.select(on) for p in parts)).distinct()


def migration_rows(files: DataFrame, server: str, content_hash: str | None = None, target: str | None = None) -> DataFrame:
    """Rows to move off a server: those of one content, else all canonical ones, with ``target`` only those meant for it."""
    here = files.where(F.col("server") == server)
    if content_hash is not None:
        return here.where(F.col("content_hash") == content_hash)
    chosen = here.where("is_canonical")
    return chosen if target is None else chosen.where(F.col("migration_target") == target)


def data_types(types: DataFrame, digests: DataFrame, entries: DataFrame) -> DataFrame:
    """Each data type with its digests in the order they were attached and the entries that have one of them.

    Types: type_id, ...; digests: digest, type_id, attached; entries: digest.
    """
    n = entries.where("digest is not null").groupBy("digest").agg(F.count("*").alias("n"))
    held = digests.join(n, "digest", "left").groupBy("type_id").agg(F.sort_array(F.collect_list(F.struct("attached", "digest"))).alias("_d"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_entries"))
    rows = types.join(held, "type_id", "left").na.fill(0, ["n_entries"])
    return rows.withColumn("digests", F.coalesce(F.transform("_d", lambda d: d["digest"]), F.array().cast("array<string>"))).drop("_d")


def attach(digests: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Digests after detaching ``removed`` (digest) and attaching ``added``; one already held stays where it is."""
    kept = digests.join(removed.select("digest"), "digest", "left_anti")
    return kept.unionByName(added.join(kept.select("digest"), "digest", "left_anti"))


def backfill(entries: DataFrame, test: Column, at: str, key: str, most: int = 1000) -> DataFrame:
    """The oldest entries that a saved filter matches."""
    return entries.where(test).orderBy(at, key).limit(most)
