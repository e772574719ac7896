"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors are turned into the basis of their principal components, largest first. Blocks are boxes in
the leading components and in the length of what is left: cut points come from a bounded sample, the
boxes themselves are exact. A vector goes to the pairs of its own block with every block whose box is
near enough that some cosine can reach the threshold. In a pair of blocks the products of the leading
dimensions are summed first; the rest of a product is at most the product of the two suffix norms,
and a pair whose sum plus that bound stays below the threshold is dropped. What is left is decided on
the full vectors in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwood.llm.components import connected_components, star_of
from tarnwood.llm.shared import written

_BLOCK = (1024, 65536)
_SUB = (512, 2048)
_SLACK = 1e-5
_STEPS = (0.25, 0.5, 0.75)
_LEADING = 8
_SAMPLE = 20_000
_TILE = T.StructType([T.StructField(n, T.LongType()) for n in ("node", "links", "root")])


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dims)


def _usable(vec) -> F.Column:
    """Not null, no null or non-finite component, not zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one; scaling by the largest component first keeps tiny and huge rows finite."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, dims: int) -> np.ndarray:
    """Orthonormal axes (columns), most variance first, from sums of products over all rows."""
    kind = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("value", T.DoubleType())])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            m = _unit(_matrix(batch.column(0), dims))
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims), pa.int32()), pa.array(total.ravel())], names=kind.names)

    summed = vectors.select("vec").mapInArrow(products, kind).groupBy("cell").agg(F.sum("value").alias("value")).collect()
    square = np.zeros(dims * dims)
    for r in summed:
        square[r["cell"]] = r["value"]
    square = square.reshape(dims, dims)
    _, axes = np.linalg.eigh((square + square.T) / 2)
    return np.ascontiguousarray(axes[:, ::-1])


@dataclass(frozen=True)
class Blocks:
    """A tree of cuts, each half of the rows on either side, and the block's number at each leaf."""

    axis: np.ndarray
    cut: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, blocks: int) -> Blocks:
        """Cuts the widest side of each part at its median, until there are ``blocks`` of them (a power of two)."""
        axis, cut, parts = [], [], [sample]
        while len(parts) < blocks:
            halves = []
            for m in parts:
                k = int(np.argmax(np.ptp(m, axis=0))) if len(m) else 0
                at = float(np.median(m[:, k])) if len(m) else 0.0
                axis.append(k)
                cut.append(at)
                halves += [m[m[:, k] < at], m[m[:, k] >= at]]
            parts = halves
        return cls(np.array(axis, dtype=np.int64), np.array(cut))

    def place(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        for _ in range(int(math.log2(len(self.axis) + 1))):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] >= self.cut[node])
        return node - len(self.axis)


def _points(m: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Leading components and the length of what is left: nearer than the vectors themselves, if anything."""
    turned = m @ axes[:, :_LEADING]
    rest = np.sqrt(np.maximum(0.0, 1 - (turned * turned).sum(axis=1)))
    return np.concatenate([turned, rest[:, None]], axis=1)


def tile_links(a: np.ndarray, b: np.ndarray, axes: np.ndarray, least: float, same: bool, sub: tuple[int, int] = _SUB) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index arrays (x, y) of pairs with cosine >= ``least``; with ``same`` (a is b) each pair once."""
    dims = a.shape[1]
    cuts = sorted({max(1, int(dims * s)) for s in _STEPS})

    def leading(m: np.ndarray) -> list[np.ndarray]:
        """Leading dimensions up to each cut and the norm of the rest: one product gives sum and bound."""
        turned = m @ axes
        return [np.concatenate([turned[:, :c], np.sqrt((turned[:, c:] ** 2).sum(axis=1, keepdims=True))], axis=1).astype(np.float32) for c in cuts]

    low = (leading(a), leading(b))
    begin = 0  # the first cut that left few pairs in the tile before
    for i in range(0, len(a), sub[0]):
        for j in range(i if same else 0, len(b), sub[1]):
            rows, cols = slice(i, i + sub[0]), slice(j, j + sub[1])
            for k in range(begin, len(cuts)):
                may = low[0][k][rows] @ low[1][k][cols].T >= np.float32(least - _SLACK)
                if same:
                    may &= np.arange(i, i + may.shape[0])[:, None] < np.arange(j, j + may.shape[1])[None, :]
                share = np.count_nonzero(may) / may.size
                if share <= 0.002:
                    break
            begin = k if share else max(0, k - 1)
            if share > 0.02:
                x, y = np.nonzero(may & (a[rows] @ b[cols].T >= least))
            elif share:
                x, y = np.nonzero(may)
                keep = np.concatenate([(a[i + x[s : s + 8192]] * b[j + y[s : s + 8192]]).sum(axis=1) >= least for s in range(0, len(x), 8192)])
                x, y = x[keep], y[keep]
            else:
                continue
            if len(x):
                yield x + i, y + j


def near_vectors(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", block: int | None = None, sub: tuple[int, int] = _SUB) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    Two vectors link when their cosine in double precision is at least ``least``. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing, and vectors of
    different lengths don't link with each other. Equal vectors are compared once, with their count
    as weight, so a vector that a third of all rows share costs what one does. Rows are told apart by
    their vectors: rows that repeat a vec_id or have none are vectors of their own. A null vec_id
    names no component: its row gets the smallest vec_id that it reaches, null if it reaches none, and
    is not kept then unless it is alone. Other columns are ignored; an empty table gives an empty
    table. ``block`` (rows of a block) and ``sub`` (rows and columns of one matrix product) change
    only the time.
    """
    vec = F.col("vec")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    if rows.schema["vec"].dataType != T.ArrayType(T.FloatType()):
        rows = rows.withColumn("vec", vec.cast("array<double>"))
    # Two 64-bit hashes stand for the vector where only equality counts.
    rows = rows.withColumns({"k1": F.when(_usable(vec), F.xxhash64(vec)), "k2": F.when(_usable(vec), F.xxhash64(F.lit(7), vec))})
    classes = rows.where("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"), F.first("vec").alias("vec"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    # One pass for each vector length that occurs; embeddings of one model have one.
    sizes = [(r[0], r[1]) for r in classes.groupBy(F.size("vec")).count().collect()]
    found = classes.sparkSession.createDataFrame([], _TILE)
    for dims, n in sorted(sizes):
        found = found.union(_links_of_length(classes.where(F.size("vec") == dims), dims, n, least, block, sub))
    found = written(found, "vector-links")
    parts = connected_components(found.where("root is not null").select(F.col("node").alias("src"), F.col("root").alias("dst"))).withColumnRenamed("node", "_node")
    counts = found.where("links is not null").groupBy(F.col("node").alias("id")).agg(F.sum("links").alias("links"))
    small = classes.select("node", "k1", "k2", "low", "weight")
    members = written(parts.join(small, F.col("_node") == F.col("node")).select("_node", "component", "low"), "members")
    tops = members.join(members.groupBy("component").agg(F.min("low").alias("top")), "component").select("_node", "top")
    named = small.join(counts, F.col("node") == F.col("id"), "left").join(tops, F.col("node") == F.col("_node"), "left")
    named = named.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("top", "low").alias("component_id"))
    out = rows.select("vec_id", "k1", "k2").join(named, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("n_links") == 0))


def _links_of_length(classes: DataFrame, dims: int, n: int, least: float, block: int | None, sub: tuple[int, int]) -> DataFrame:
    axes = principal_axes(classes, dims)
    # About six blocks, more only where they would outgrow a task: a row is sent once for every block near it.
    rows_of = block or int(np.clip(n // 6, *_BLOCK))
    blocks = 1 << max(0, math.ceil(math.log2(n / rows_of)))
    if blocks > 1:
        sample = classes.orderBy(F.xxhash64("node")).limit(_SAMPLE).select("vec").toArrow().column(0).combine_chunks()
        tree = Blocks.fit(_points(_unit(_matrix(sample, dims)), axes), blocks)
    else:
        tree = Blocks(np.zeros(0, np.int64), np.zeros(0))
    width = min(_LEADING, dims) + 1
    side = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("axis", T.IntegerType()), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full((blocks, width), np.inf), np.full((blocks, width), -np.inf)
        for batch in batches:
            points = _points(_unit(_matrix(batch.column(0), dims)), axes)
            at = tree.place(points)
            np.minimum.at(low, at, points)
            np.maximum.at(high, at, points)
        at, k = np.nonzero(low <= high)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(k, pa.int32()), pa.array(low[at, k]), pa.array(high[at, k])], names=side.names)

    # Exact boxes: a few numbers for each block of thousands of vectors.
    low, high = np.full((blocks, width), np.inf), np.full((blocks, width), -np.inf)
    for r in classes.select("vec").mapInArrow(bounds, side).groupBy("block", "axis").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        low[r["block"], r["axis"]], high[r["block"], r["axis"]] = r["low"], r["high"]
    reach = 2 - 2 * least + _SLACK  # squared distance of two vectors at the threshold
    real = np.float32 if classes.schema["vec"].dataType.elementType == T.FloatType() else np.float64
    kind = T.StructType([T.StructField("node", T.LongType()), T.StructField("weight", T.LongType()), T.StructField("vec", T.BinaryType()), T.StructField("block", T.IntegerType()), T.StructField("near", T.ArrayType(T.IntegerType()))])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                m = _matrix(part.column(2), dims)
                points = _points(_unit(m), axes)
                own = tree.place(points)
                far = np.zeros((len(points), blocks))
                for k in range(width):
                    p = points[:, k, None]
                    far += np.maximum(0.0, np.maximum(low[None, :, k] - p, p - high[None, :, k])) ** 2
                near = far <= reach
                near[np.arange(len(points)), own] = True
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(near.sum(axis=1))]), pa.int32()), pa.array(np.nonzero(near)[1], pa.int32()))
                raw = m.astype(real)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(own, pa.int32()), lists], names=kind.names)

    spread = classes.select("node", "weight", "vec").mapInArrow(meet, kind)
    pairs = F.transform("near", lambda j: F.struct(F.least(j, "block").alias("low"), F.greatest(j, "block").alias("high"), (j < F.col("block")).alias("second")))
    dealt = spread.select("node", "weight", "vec", F.explode(pairs).alias("at")).select("node", "weight", "vec", "at.*")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        ids, weight, second = (table.column(c).to_numpy() for c in ("node", "weight", "second"))
        same = key[0].as_py() == key[1].as_py()
        at_a, at_b = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(~second), np.flatnonzero(second))
        count = np.zeros(len(ids), dtype=np.int64)
        stars = [np.zeros((0, 2), np.int64)]
        if len(at_a) and len(at_b):
            m = _unit(np.frombuffer(b"".join(table.column("vec").to_pylist()), real).reshape(-1, dims).astype(np.float64))
            for x, y in tile_links(m[at_a], m[at_b], axes, least, same, sub):
                x, y = at_a[x], at_b[y]
                count += np.bincount(x, weights=weight[y], minlength=len(ids)).astype(np.int64)
                count += np.bincount(y, weights=weight[x], minlength=len(ids)).astype(np.int64)
                here, back = np.unique(np.concatenate([x, y]), return_inverse=True)
                node, root = star_of(back.reshape(2, -1).T, ids[here])
                stars.append(np.stack([here[node], here[root]], axis=1))
        node, root = star_of(np.concatenate(stars), ids)
        some = np.flatnonzero(count)
        return pa.table(
            {
                "node": pa.array(np.concatenate([ids[some], ids[node]]), pa.int64()),
                "links": pa.array([*count[some].tolist(), *[None] * len(node)], pa.int64()),
                "root": pa.array([*[None] * len(some), *ids[root].tolist()], pa.int64()),
            }
        )

    return dealt.groupBy("low", "high").applyInArrow(compare, _TILE)
