"""Ranked choices: grants, routes, placement, samples by stratum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_folders(rows: DataFrame, path: str, folders: DataFrame) -> DataFrame:
    """``rows`` with each row of ``folders`` whose folder is ``path`` or lies above it, by equality of prefixes."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return rows.withColumn("_above", F.explode(above)).join(folders, F.col("_above") == F.col("folder")).drop("_above")


def best_grant(grants: DataFrame, resources: DataFrame) -> DataFrame:
    """The strongest grant over each path: rank, then the deepest folder, then the role."""
    depth = F.size(F.split("folder", "/"))
    order = F.max(F.struct("rank", depth.alias("depth"), "role"))
    return with_folders(resources, "path", grants).groupBy("path").agg(order.alias("g")).select("path", "g.rank", "g.role")


def ancestor_folders(folders: DataFrame, homes: DataFrame) -> DataFrame:
    """Folders above each home, longest first."""
    return with_folders(homes, "home", folders).groupBy("home").agg(F.sort_array(F.collect_list(F.struct(F.length("folder").alias("n"), "folder")), asc=False).alias("a")).select("home", F.transform("a", lambda x: x["folder"]).alias("folders"))


def stratified(rows: DataFrame, stratum: Column, order: Column, k: int) -> DataFrame:
    """Round robin over strata: the first of each, then the second of each, up to ``k`` rows."""
    ranked = rows.withColumn("stratum", stratum)
    ranked = ranked.withColumn("turn", F.row_number().over(Window.partitionBy("stratum").orderBy(order)))
    return ranked.orderBy("turn", "stratum").limit(k)


def routes(access: DataFrame) -> DataFrame:
    """The best way to each endpoint: priority, then cost of the method, then verified ones."""
    cost = F.when(F.col("method") == "local", 0).when(F.col("method") == "mount", 1).otherwise(2)
    w = Window.partitionBy("endpoint").orderBy(F.desc("priority"), cost, F.desc("verified"), "access_id")
    return access.where("routable").withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def place(demand: DataFrame, hosts: DataFrame) -> DataFrame:
    """For each base the hosts with most headroom, as many as are still needed."""
    w = Window.partitionBy("base").orderBy(F.desc("headroom"), "host")
    fit = demand.join(hosts, "base").where("headroom >= least").withColumn("rank", F.row_number().over(w))
    return fit.where("rank <= need").select("base", "host", "headroom", "rank")


def least_loaded(replicas: DataFrame, zone: str | None = None) -> DataFrame:
    """The live replica of each model with most free permits."""
    live = replicas.where("live") if zone is None else replicas.where("live").where(F.col("zone") == zone)
    return live.groupBy("model").agg(F.max_by("replica", F.struct("free", F.negative("replica"))).alias("replica"), F.max("free").alias("free"))


def prefer_own(rows: DataFrame, keys: list[str], owner: str, mine: str) -> DataFrame:
    """The own row of each key, else the platform's."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.col(owner) == mine), owner)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
