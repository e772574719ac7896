"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Every document of a source expects ``target / source_size`` copies. Within the source the documents
stand in the order of their size, expected copies are summed along that order, one random offset is
added, and a document is emitted once for each whole number that its stretch of the sum crosses.

The order is cut into cells (size class, then hash bucket), so a source that holds a third of all
rows, or one size shared by a third of them, is ranked by many tasks: rank = documents in earlier
cells + row number in the own cell.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwood.llm.shared import few_rows

WORD = r"[^\x20\x09-\x0D]+"
_CELL_ROWS = 100_000


def word_count(text) -> F.Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict:
    """Target of each source: ``share`` of all sizes by weight, none above ``most`` times its own size.

    Sources take the weights in turn by code point, null last. What a source can't take is shared
    among the others by weight until none is above its limit.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, left, free = {}, share * sum(sizes.values()), list(order)
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if unit * weight[s] > most * sizes[s]]
        if not over:
            return out | {s: unit * weight[s] for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
    id_col: str = "doc_id",
    source_col: str = "source",
    size_col: str = "size",
) -> DataFrame:
    """``docs`` (which has ``size_col``) with source_size, target, copies and taken.

    Rows with a null source form a source of their own. Empty documents and null sizes count as size
    0 and may be emitted. Repeated rows are separate documents. Where ``docs`` has columns named
    like the results, the results replace them. An empty table gives an empty table. Only one row
    per source comes to the driver.
    """
    spark = docs.sparkSession
    docs = docs.drop("source_size", "target", "copies", "taken").withColumn(size_col, F.coalesce(F.col(size_col).cast("long"), F.lit(0)))
    rows = docs.groupBy(source_col).agg(F.sum(size_col).alias("size"), F.count("*").alias("n")).collect()
    target = targets({r[0]: int(r["size"] or 0) for r in rows}, weights, share, most)

    def offset(source) -> float:
        name = hashlib.sha256(f"{seed}|{source!r}".encode()).digest()
        return int.from_bytes(name[:4], "big") % (1 << 20) / (1 << 20)

    kind = T.StructType(
        [T.StructField("_s", T.IntegerType()), T.StructField("_source", docs.schema[source_col].dataType), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("_each", T.DoubleType()), T.StructField("_offset", T.DoubleType()), T.StructField("_buckets", T.LongType())]
    )
    plan = few_rows(
        spark, [(k, r[0], int(r["size"] or 0), float(target[r[0]]), float(min(most, target[r[0]] / r["size"])) if r["size"] else 0.0, offset(r[0]), max(8, r["n"] // _CELL_ROWS)) for k, r in enumerate(rows)], kind
    )
    # One row per source, counted above.
    small = F.broadcast(plan) if len(rows) <= 100_000 else plan
    # The source's number, never null, stands for it from here: ranking and the join that follows deal rows alike, in one shuffle.
    cell = ["_s", "_class", "_bucket"]
    placed = (
        docs.join(small, F.col(source_col).eqNullSafe(F.col("_source")))
        .withColumn("_class", F.floor(8 * F.log2(F.col(size_col) + 1)).cast("int"))
        .withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(size_col)), F.col("_buckets")))
    )
    counts = placed.groupBy(*cell).agg(F.count("*").alias("_in_cell"))
    earlier = Window.partitionBy("_s").orderBy("_class", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_in_cell").over(earlier), F.lit(0))).select(*cell, "_before")
    ranked = placed.withColumn("_row", F.row_number().over(Window.partitionBy(*cell).orderBy(size_col, id_col)))
    rank = F.col("_row") + F.col("_before")
    upto = lambda n: F.floor(n * F.col("_each") + F.col("_offset"))
    copies = F.least(upto(rank) - upto(rank - 1), F.lit(int(-(-most // 1)))).cast("int")
    out = ranked.join(before, cell).withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col(size_col))
    return out.select(*docs.columns, "source_size", "target", "copies", "taken")
