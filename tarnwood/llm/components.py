"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwood.llm.shared import written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("src", "dst") % 1_000_003), F.lit(0))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("dst", "src"))
    least = both.groupBy(F.col("src").alias("hub")).agg(F.min("dst").alias("low")).withColumn("low", F.least("hub", "low"))
    up = both.where("dst > src")
    return up.join(least, F.col("src") == F.col("hub")).select(F.col("dst").alias("src"), F.col("low").alias("dst"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.where("src > dst")
    least = down.groupBy(F.col("src").alias("hub")).agg(F.min("dst").alias("low"))
    moved = down.join(least, F.col("src") == F.col("hub")).select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return moved.union(least.select(F.col("hub").alias("src"), F.col("low").alias("dst"))).where("src > dst")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst); component: the smallest node reachable.

    Each round is written to the shared folder; it ends when a round changes nothing, after about
    log2 of the longest path. Self-loops and repeated edges are allowed; nulls are dropped. A node
    that many edges share is handled by partial aggregation and by joins that Spark may split.
    """
    ids = written(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src is not null and dst is not null"), "links")
    loops = ids.where("src = dst").select(F.col("src").alias("node")).distinct()
    now = written(ids.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        now = written(_small_star(_large_star(now).distinct()).distinct(), "edges")
        before, mark = mark, _mark(now)
        if before == mark:
            break
    linked = now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    known = linked.union(roots)
    alone = loops.join(known.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return known.union(alone)


def star_of(links: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that join what the index pairs ``links`` (k x 2) join; root: least by ``weights``.

    Label spreading with pointer jumping over the pairs of one tile.
    """
    n = len(weights)
    rank = np.empty(n, dtype=np.int64)
    rank[np.argsort(weights, kind="stable")] = np.arange(n)
    label = rank.copy()
    back = np.argsort(rank)
    a, b = links[:, 0], links[:, 1]
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, back[label[a]], low)
        np.minimum.at(new, back[label[b]], low)
        new = new[back[new]]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != rank)
    return moved, back[label[moved]]
