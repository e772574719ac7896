"""Token dataflow as DataFrame steps: joins, barriers, scatter, loops, decisions and timer races."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwood.plans.lineage import cut


def _numbered(place: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return place.withColumn("_turn", F.row_number().over(Window.partitionBy(*keys).orderBy(seq)))


def fifo_join(left: DataFrame, right: DataFrame, on: str, seq: str = "seq") -> DataFrame:
    """Each token is used once: the n-th token of a key pairs with the n-th of the other place."""
    return _numbered(left, [on], seq).join(_numbered(right, [on], seq).withColumnRenamed(seq, f"other_{seq}"), [on, "_turn"]).drop("_turn")


def first_match(left: DataFrame, right: DataFrame, guard: Column, left_seq: str, right_seq: str) -> DataFrame:
    """For each left token the earliest right token for which the guard holds.

    Both orders are total; equality parts of the guard become join keys. Any guard will do, so the
    pairs of equal keys are formed; ``first_above`` is for one comparison and forms none.
    """
    found = left.join(right, guard).groupBy(left_seq).agg(F.min(right_seq).alias(right_seq))
    return found


def first_above(left: DataFrame, right: DataFrame, key: str, value: str, left_seq: str, right_seq: str) -> DataFrame:
    """``first_match`` where the keys are equal and the right ``value`` is greater.

    Both places stand in one order, greatest value first and left before right where values are
    equal: the least ``right_seq`` so far is the match. Spark deals that order out by ranges, so a
    frequent key is many tasks' work; what the ranges before hold of a key is one row for each range.
    """
    none = lambda side, c: F.lit(None).cast(side.schema[c].dataType).alias(c)
    lefts = left.select(key, value, left_seq, none(right, right_seq), F.lit(False).alias("_right"))
    rights = right.select(key, value, none(left, left_seq), right_seq, F.lit(True).alias("_right"))
    tokens = lefts.unionByName(rights).where(F.col(key).isNotNull() & F.col(value).isNotNull())
    # Kept in files: the ranges are drawn anew whenever the plan runs.
    ranged = cut(tokens.repartitionByRange(key, F.desc(value), "_right", left_seq, right_seq).withColumn("_range", F.spark_partition_id()))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy(key, "_range").agg(F.min(right_seq).alias("_least")).withColumn("_before", F.min("_least").over(earlier)).drop("_least")
    here = Window.partitionBy(key, "_range").orderBy(F.desc(value), "_right").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranged.withColumn("_here", F.min(right_seq).over(here)).where("not _right").join(before, [key, "_range"])
    found = rows.select(left_seq, F.least("_here", "_before").alias(right_seq)).where(F.col(right_seq).isNotNull())
    return found.groupBy(left_seq).agg(F.min(right_seq).alias(right_seq))


def latest_read(events: DataFrame, place: DataFrame, value: str, seq: str = "seq") -> DataFrame:
    """Every event with the newest token of a place; the token stays. One row is broadcast."""
    newest = place.agg(F.max_by(value, seq).alias("latest"))
    return events.join(F.broadcast(newest))


def and_join(branches: list[DataFrame], on: str) -> DataFrame:
    return reduce(lambda a, b: a.join(b, on), branches)


def xor_join(branches: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), branches)


def gather(results: DataFrame, coordinators: DataFrame, key: str, index: str, value: str, seq: str) -> DataFrame:
    """Counted barrier: fires for a key once ``expected`` results are there, with the first of them.

    The values come in the order of their index; an expected count of 0 never fires.
    """
    ranked = _numbered(results, [key], seq).join(coordinators.where("expected > 0"), key).where("_turn <= expected")
    grouped = ranked.groupBy(key, "expected").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).alias("v")))).alias("got"))
    return grouped.where("n = expected").select(key, "n", F.transform("got", lambda g: g["v"]).alias("vals"))


def drain(place: DataFrame, key: str, most: int, seq: str = "seq") -> DataFrame:
    """Batches of up to ``most`` tokens in order."""
    batch = F.floor((F.col("_turn") - 1) / most)
    return _numbered(place, [key], seq).groupBy(key, batch.alias("batch")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(seq)).alias("seqs"))


def scatter(tokens: DataFrame, array: str) -> DataFrame:
    """One token per element, in order; a null array is an error of the whole run."""
    checked = F.when(F.col(array).isNull(), F.raise_error(F.lit("scatter needs an array"))).otherwise(F.col(array))
    return tokens.select("*", F.posexplode(checked).alias("idx", "item")).drop(array)


def map_reduce(tokens: DataFrame, array: str, body, zero, merge) -> DataFrame:
    """Body over every element and a fold of the results, without a shuffle; empty arrays give ``zero``."""
    return tokens.withColumn("result", F.aggregate(F.transform(array, body), zero, merge))


def loop(tokens: DataFrame, start: Column, step: str, most: int) -> DataFrame:
    """Body at most ``most`` + 1 times while its condition holds: ``step`` is SQL over s (n, acc)."""
    return tokens.withColumn("_s", start).withColumn("_s", F.expr(f"aggregate(sequence(0, {int(most)}), _s, (s, i) -> {step})"))


def decide(tokens: DataFrame, branches: list[tuple[str, Column]], default: str | None = None) -> DataFrame:
    """The first branch whose guard is true; without one the default, or an error."""
    label = reduce(lambda acc, b: acc.when(b[1], b[0]), branches[1:], F.when(branches[0][1], branches[0][0]))
    return tokens.withColumn("branch", label.otherwise(F.lit(default) if default else F.raise_error(F.lit("no branch fits")).cast("string")))


def timer_race(scheduled: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Exactly one of body and timer wins: the body if it ends before ``at`` + ``limit``."""
    first = done.groupBy(key).agg(F.min("done_at").alias("done_at"))
    wins = F.coalesce(F.col("done_at") < F.col("at") + F.col("limit"), F.lit(False))
    return scheduled.join(first, key, "left").withColumn("winner", F.when(wins, "body").otherwise("timeout"))


def enabled(places: DataFrame, needs: DataFrame) -> DataFrame:
    """Transitions all of whose places hold at least the weight of their arcs."""
    have = places.groupBy("place").agg(F.count("*").alias("n"))
    ok = needs.join(have, "place", "left").withColumn("ok", F.coalesce(F.col("n") >= F.col("weight"), F.lit(False)))
    return ok.groupBy("transition").agg(F.bool_and("ok").alias("enabled")).where("enabled").select("transition")
