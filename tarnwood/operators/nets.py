"""Nets of places and transitions as tables: choice, routing, checks and shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwood.plans import lineage


def select_transition(candidates: DataFrame) -> DataFrame:
    """Per net the transition that fires next: enabled first, then most inputs, then highest priority, then id.

    Columns: net, transition, enabled_at (null: not enabled), n_inputs, priority (null: lowest).
    """
    order = F.struct("enabled_at", -F.col("n_inputs"), F.col("priority").isNull(), -F.col("priority"), "transition")
    return candidates.where("enabled_at is not null").groupBy("net").agg(F.min_by("transition", order).alias("transition"))


def match_key(value: Column) -> Column:
    """Join key under which 1 equals 1.0; for numbers only. Whole numbers keep all their digits."""
    real = value.cast("double")
    whole = (real % 1 == 0) & (F.abs(real) < 9e18)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(real.cast("string"))


def guarded_join(first: DataFrame, others: list[tuple[DataFrame, str]], key: str, guard: Column, seqs: list[str]) -> DataFrame:
    """For each token of ``first`` the first combination, in token order, with equal keys for which the guard holds.

    ``others``: (place, its key column). The keys become hash joins; the guard is checked on what they let through.
    """
    rows = first.withColumn("_key", match_key(F.col(key)))
    for place, column in others:
        rows = rows.join(place.withColumn("_key", match_key(F.col(column))).drop(*({column} & {key})), "_key")
    return rows.where(guard).groupBy(seqs[0]).agg(F.min(F.struct(*seqs[1:])).alias("_c")).select(seqs[0], "_c.*")


def route_outputs(tokens: DataFrame, places: DataFrame, valid: Column) -> DataFrame:
    """Where each produced token goes: its place, a bridge's target, its reply address, nowhere, or an error.

    Tokens: place, reply_to; places: place, kind, target. ``valid`` is the schema check of a token.
    """
    kind = F.col("kind")
    to = (
        F.when(kind.isNull() | ~F.coalesce(valid, F.lit(False)), "error").when(kind == "sink", "discard").when(kind == "bridge_out", F.coalesce(F.col("target"), F.lit("error")))
        .when(kind == "bridge_reply", F.coalesce(F.col("reply_to"), F.lit("error"))).otherwise(F.col("place"))
    )
    return tokens.join(places, "place", "left").withColumn("destination", to).drop("kind", "target")


def terminal_results(marking: DataFrame, places: DataFrame) -> DataFrame:
    """(net, token, result) of nets with a token in a terminal place: its exit code, else its whole body."""
    ended = marking.join(places.where("kind = 'terminal'").select("place"), "place", "left_semi")
    first = ended.groupBy("net").agg(F.min_by(F.struct("token", "body"), F.struct("seq", "token")).alias("t"))
    return first.select("net", "t.token", F.coalesce(F.get_json_object("t.body", "$.exit_code"), F.col("t.body")).alias("result"))


def topology_issues(places: DataFrame, arcs: DataFrame, ports: DataFrame) -> DataFrame:
    """(element, code, level) of all that looks wrong in a net.

    Places: place, kind. Arcs: place, transition, port, direction (in: to the transition), weight.
    Ports: transition, port, direction, single (one token at a time), optional (may stay open).
    """
    degree = arcs.groupBy("place").agg(F.count_if(F.col("direction") == "out").alias("fed"), F.count_if(F.col("direction") == "in").alias("read"))
    rows = places.join(degree, "place", "left").na.fill(0, ["fed", "read"])
    place_code = F.when(F.col("kind").isin("internal", "bridge_out", "terminal", "sink") & (F.col("fed") == 0), "UNREACHABLE").when(F.col("kind").isin("signal", "bridge_in") & (F.col("read") == 0), "UNUSED_SIGNAL")
    place_issues = rows.select(F.concat(F.lit("place:"), "place").alias("element"), place_code.alias("code"))

    wired = arcs.groupBy("transition", "port", "direction").agg(F.count_if(F.col("weight") > 1).alias("heavy"))
    joined = ports.join(wired, ["transition", "port", "direction"], "left")
    open_code = F.when(F.col("direction") == "in", "DISCONNECTED_INPUT").when(~F.col("optional"), "DISCONNECTED_OUTPUT")
    codes = F.when(F.col("heavy").isNull(), F.array(open_code)).when((F.col("direction") == "in") & F.col("single"), F.array_repeat(F.lit("CARDINALITY_MISMATCH"), F.col("heavy").cast("int")))
    port_issues = joined.select(F.concat_ws(":", "transition", "port").alias("element"), F.explode(codes).alias("code"))
    level = F.when(F.col("code").isin("DISCONNECTED_INPUT", "CARDINALITY_MISMATCH"), "error").otherwise("warning")
    return place_issues.union(port_issues).where("code is not null").withColumn("level", level)


def graph_shape(spark, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per graph: nodes, edges, sub-workflows, deepest nesting and whether it loops; kinds as a map.

    Nodes: graph, node, parent, kind; edges: graph. A chain of parents that runs in a circle counts
    as one deeper than the graph has nodes.
    """
    kinds = nodes.groupBy("graph", "kind").agg(F.count("*").alias("n"))
    counts = kinds.groupBy("graph").agg(
        F.sum("n").alias("n_nodes"), F.sum(F.when(F.col("kind") == "sub_workflow", F.col("n")).otherwise(0)).alias("n_sub"), F.bool_or(F.col("kind").isin("loop", "map")).alias("has_loops"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("kinds"),
    )
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    up = spark.sql(
        """WITH RECURSIVE up(graph, parent, depth, most) AS (
             SELECT n.graph, n.parent, 1, c.n_nodes FROM {nodes} n JOIN {counts} c ON n.graph = c.graph WHERE n.parent IS NOT NULL
             UNION ALL
             SELECT u.graph, n.parent, u.depth + 1, u.most FROM up u JOIN {nodes} n ON n.graph = u.graph AND n.node = u.parent WHERE n.parent IS NOT NULL AND u.depth <= u.most)
           SELECT graph, max(depth) AS depth FROM up GROUP BY graph""",
        nodes=nodes, counts=counts,
    )
    try:  # The limit is read when the recursion runs, and no other query is to see it lifted.
        spark.conf.set(limit, "-1")
        depth = lineage.cut(up)
    finally:
        spark.conf.set(limit, before)
    wires = edges.groupBy("graph").agg(F.count("*").alias("n_edges"))
    return counts.join(depth, "graph", "left").join(wires, "graph", "left").na.fill(0, ["depth", "n_edges"])


def delayed(tokens: DataFrame, at: str, milliseconds: Column) -> DataFrame:
    """Tokens with the time (milliseconds) at which a delay lets them go; a negative delay is none."""
    return tokens.withColumn("due", F.col(at) + F.greatest(F.lit(0), F.coalesce(milliseconds, F.lit(0))))
