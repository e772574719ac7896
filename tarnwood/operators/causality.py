"""Causes of events: four kinds of links, token details, and the ways from artifacts and signals to processes.

Logs are (net, seq, kind), tokens (net, seq, token, role, place, data), cross links and signal
lineage (signal_key, egress_net, egress_seq, ingress_net, ingress_seq), tags (token, process).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cause_links(events: DataFrame, tokens: DataFrame, cross: DataFrame, signals: DataFrame, tags: DataFrame) -> DataFrame:
    """(net, seq, path, cause_net, cause_seq): the events one step before each event.

    ``token``: the producer of a consumed token. ``bridge`` and ``signal``: for a created token the
    known other end. ``process``: for a created token with neither, the latest earlier event of the
    net that shares a process tag, other created signal tokens aside.
    """
    made = tokens.where("role = 'produced'")
    used = tokens.where("role = 'consumed'").select("net", "seq", "token")
    by_token = used.join(made.select("token", F.col("net").alias("cause_net"), F.col("seq").alias("cause_seq")), "token").select("net", "seq", F.lit("token").alias("path"), "cause_net", "cause_seq")

    created = events.where("kind = 'TokenCreated'").select("net", "seq")
    known = [
        links.select(F.col("ingress_net").alias("net"), F.col("ingress_seq").alias("seq"), F.lit(path).alias("path"), F.col("egress_net").alias("cause_net"), F.col("egress_seq").alias("cause_seq"))
        for links, path in ((cross, "bridge"), (signals, "signal"))
    ]
    ends = [k.join(created, ["net", "seq"], "left_semi") for k in known]

    loose = reduce(lambda rows, k: rows.join(k, ["net", "seq"], "left_anti"), known, created)
    # One sorted pass per (net, process) finds the event before; pairs of its events are never formed.
    marked = made.join(tags, "token").join(events.select("net", "seq", "kind"), ["net", "seq"]).join(loose.withColumn("loose", F.lit(True)), ["net", "seq"], "left")
    structural = ~((F.col("kind") == "TokenCreated") & F.col("place").rlike("^sig."))
    earlier = Window.partitionBy("net", "process").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    before = marked.withColumn("before", F.max(F.when(structural, F.col("seq"))).over(earlier)).where("loose and before is not null")
    by_process = before.groupBy("net", "seq").agg(F.max("before").alias("cause_seq")).select("net", "seq", F.lit("process").alias("path"), F.col("net").alias("cause_net"), "cause_seq")
    return reduce(DataFrame.unionByName, [by_token, *ends, by_process]).distinct()


def node(net: Column, seq: Column) -> Column:
    return F.concat_ws(":", net, seq.cast("string"))


def token_details(tokens: DataFrame) -> DataFrame:
    """Tokens of every event; where one has no data of its own, that of its producer."""
    held = tokens.where("role = 'produced' and data is not null").groupBy("token").agg(F.min_by("data", "seq").alias("_made"))
    return tokens.join(held, "token", "left").withColumn("data", F.coalesce("data", "_made")).drop("_made")


def signal_keys(events: DataFrame, cross: DataFrame, dispatches: DataFrame, own: Column) -> DataFrame:
    """(net, seq, signal_key): of the event's cross link, else of its dispatch, else ``own`` of its result."""
    first = [d.groupBy(F.col("egress_net").alias("net"), F.col("egress_seq").alias("seq")).agg(F.min("signal_key").alias(n)) for d, n in ((cross, "_cross"), (dispatches, "_sent"))]
    rows = reduce(lambda e, d: e.join(d, ["net", "seq"], "left"), first, events.withColumn("_own", own))
    return rows.select("net", "seq", F.coalesce("_cross", "_sent", "_own").alias("signal_key"))


def process_of_signal(cross: DataFrame, tokens: DataFrame, tags: DataFrame) -> DataFrame:
    """(signal_key, process) through the tokens that the sending event consumed; the smallest of several."""
    used = tokens.where("role = 'consumed'").select(F.col("net").alias("egress_net"), F.col("seq").alias("egress_seq"), "token")
    return cross.join(used, ["egress_net", "egress_seq"]).join(tags, "token").groupBy("signal_key").agg(F.min("process").alias("process"))


def artifact_tokens(artifacts: DataFrame, tokens: DataFrame, cross: DataFrame) -> DataFrame:
    """(artifact, net, token) where its provenance begins: by its event, or without one by its signal."""
    made = tokens.where("role = 'produced'").groupBy("net", "seq").agg(F.min("token").alias("token"))
    direct = artifacts.where("source_seq is not null").select("artifact", "net", F.col("source_seq").alias("seq"))
    sent = artifacts.where("source_seq is null").join(cross, "signal_key").groupBy("artifact").agg(F.min(F.struct(F.col("egress_net").alias("net"), F.col("egress_seq").alias("seq"))).alias("s"))
    return direct.unionByName(sent.select("artifact", "s.net", "s.seq")).join(made, ["net", "seq"]).select("artifact", "net", "token")


def first_produced(tokens: DataFrame) -> DataFrame:
    """The first token that each net put into each place."""
    return tokens.where("role = 'produced'").groupBy("net", "place").agg(F.min_by(F.struct("token", "data"), F.struct("seq", "token")).alias("t")).select("net", "place", "t.token", "t.data")
