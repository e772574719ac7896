"""Ancestry over an event graph and membership of lineages."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwood.plans.lineage import cut


def reached(links: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """(root, node, depth) of everything reached from ``start`` (root, node) within ``depth`` steps, by default all.

    ``links`` is (node, cause); several kinds of links are unioned before. Each step follows only
    what the step before found for the first time, so neither circles nor the many paths through
    one node multiply rows. Ends early where nothing new is found.
    """
    links = cut(links.select("node", "cause").distinct())
    newest = seen = cut(start.select("root", "node").distinct().withColumn("depth", F.lit(0)))
    for step in itertools.count(1) if depth is None else range(1, depth + 1):
        further = newest.join(links, "node").select("root", F.col("cause").alias("node")).distinct()
        newest = cut(further.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(step)))
        if newest.isEmpty():
            break
        seen = seen.union(newest)
    return seen


def edges_within(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links with both ends among a root's nodes."""
    ends = nodes.select("root", F.col("node"))
    inner = links.join(ends, "node")
    return inner.join(ends.select(F.col("root"), F.col("node").alias("cause")), ["root", "cause"], "left_semi").select("root", "node", "cause")


def propagate_tags(links: DataFrame, tags: DataFrame, depth: int) -> DataFrame:
    """Tags (node, tag) flow from causes to the nodes they produce, at most ``depth`` steps."""
    forward = links.select(F.col("cause").alias("node"), F.col("node").alias("cause"))
    return reached(forward, tags.select(F.col("tag").alias("root"), "node"), depth).select("node", F.col("root").alias("tag"))


def lineage_steps(rows: DataFrame) -> DataFrame:
    """Artifacts grouped into steps: the step's name, else the job's suffix, else unknown."""
    step = F.coalesce("process_step", F.nullif(F.substring_index("job", "/", -1), F.lit("")), F.lit("unknown"))
    iteration = F.regexp_extract(step, r"-([0-9]+)$", 1).try_cast("int")
    return rows.withColumns({"step": step, "iteration": iteration}).groupBy("step", "iteration").agg(F.count("*").alias("n"), F.min("entry_id").alias("first_seen"))
