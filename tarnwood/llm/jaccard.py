"""Exact Jaccard join on word shingles.

Documents with equal shingle sets become one representative with a number of its own, so rows that
repeat a doc_id or have none are compared like all others. Representatives are cut into tiles by
exact set size, each tile a narrow band of sizes (or a share of one size), and a task compares two
tiles; tiles too far apart in size never meet, and a row goes only to tiles in reach of its own
size. In a tile pair the bit counts of hashed parity signatures bound the overlap from above: each
bit that differs stands for at least one shingle that only one of the two has. Pairs that the bound
lets pass are gathered into candidate groups, and only the documents of such groups are brought
together as sorted arrays, whose intersection decides. Links leave a tile as a spanning star, never
as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwood.llm.components import connected_components, star_of
from tarnwood.llm.shared import in_small_batches, written
from tarnwood.llm.tokens import mix, windows, words_of

_EDGES = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])
_TILE_ROWS, _TILE_BITS = (2048, 65536), 1 << 25
_GROUP_SHINGLES = 1 << 20
_MOST_NAMED = 2_000_000


def signature_bits(size):
    """Signature bits of a set: the power of two at or above its size, 64 to 65536."""
    return 1 << np.clip(np.ceil(np.log2(np.maximum(size, 1))), 6, 16).astype(np.int64)


@dataclass(frozen=True)
class Tiles:
    """Tiles in order of size: ``low`` and ``high`` size of each; the first tile and the number of tiles of each size."""

    sizes: np.ndarray
    first: np.ndarray
    parts: np.ndarray
    low: np.ndarray
    high: np.ndarray


def size_tiles(sizes: np.ndarray, counts: np.ndarray, most_rows: int) -> Tiles:
    """Cuts sets, counted by ascending size, into tiles of at most ``most_rows`` rows and ``_TILE_BITS`` signature bits.

    A size with more rows than that has tiles of its own, over which its rows are dealt.
    """
    first, parts, low, high, room = [], [], [], [], 0
    for size, n, bits in zip(sizes.tolist(), counts.tolist(), signature_bits(sizes).tolist()):
        most = min(most_rows, max(256, _TILE_BITS // bits))
        if n <= room:
            room -= n
            high[-1] = size
            parts.append(1)
        else:
            parts.append(-(-n // most))
            low += [size] * parts[-1]
            high += [size] * parts[-1]
            room = most - n if parts[-1] == 1 else 0
        first.append(len(low) - parts[-1])
    return Tiles(*(np.array(x, dtype=np.int64) for x in (sizes, first, parts, low, high)))


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row; fewer words than ``width`` make one shingle."""
    for low, high, words in words_of(column, lower=True):
        hashes = words.hashes()
        every = windows(hashes, width)
        for k in range(high - low):
            a, b = words.first[k], words.first[k + 1]
            if b - a >= width:
                yield np.unique(every[a : b - width + 1])
            elif b > a:
                yield windows(hashes[a:b], b - a) + np.uint64(b - a)
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray, bits: int) -> bytes:
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _bits_of(rows: list[bytes], bits: int) -> np.ndarray:
    """Signatures as 0/1 rows of ``bits`` columns; longer ones are folded by parity."""
    flat = np.unpackbits(np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1), axis=1)
    while flat.shape[1] > bits:
        half = flat.shape[1] // 2
        flat = flat[:, :half] ^ flat[:, half:]
    return flat


def _folded(rows: list[bytes], bits: int) -> np.ndarray:
    """``_bits_of`` for signatures of several lengths."""
    out = np.empty((len(rows), bits), np.uint8)
    size = np.array([len(r) for r in rows])
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        out[at] = _bits_of([rows[i] for i in at], bits)
    return out


def passing_pairs(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray, percent: int, same: bool) -> np.ndarray:
    """Index pairs whose bit counts leave the threshold possible (``same``: a is b, pairs once).

    The first half of the bits is counted for all pairs, the second only for those still possible.
    """
    out = []
    a_order, b_order = np.argsort(a_size, kind="stable"), np.argsort(b_size, kind="stable")
    sizes = b_size[b_order]
    half = a.shape[1] // 2
    signs = lambda x: np.float32(1) - 2 * x[:, :half].astype(np.float32)
    step_a, step_b = max(16, min(512, (1 << 22) // half)), max(16, min(2048, (1 << 23) // half))
    for i in range(0, len(a), step_a):
        rows = a_order[i : i + step_a]
        left = signs(a[rows])
        low = int(np.searchsorted(sizes, -(-a_size[rows[0]] * percent // 100)))
        high = int(np.searchsorted(sizes, a_size[rows[-1]] * 100 // percent, side="right"))
        low = max(low, i) if same else low
        for j in range(low, high, step_b):
            cols = b_order[j : min(high, j + step_b)]
            differ = (half - left @ signs(b[cols]).T) * np.float32(0.5)
            most = ((a_size[rows][:, None] + b_size[cols][None, :]) * (100 - percent)) // (100 + percent)
            may = differ <= most
            if same:
                may &= (np.arange(i, i + len(rows))[:, None] < np.arange(j, j + len(cols))[None, :])
            x, y = np.nonzero(may)
            x, y, room = rows[x], cols[y], (most - differ)[x, y]
            for s in range(0, len(x), 4096):
                xs, ys = x[s : s + 4096], y[s : s + 4096]
                ok = (a[xs, half:] != b[ys, half:]).sum(axis=1) <= room[s : s + 4096]
                out.append(np.stack([xs[ok], ys[ok]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def exact_links(sets: list[np.ndarray], pairs: np.ndarray, percent: int) -> np.ndarray:
    """A spanning forest of the pairs that truly link; a pair already joined by others is passed over."""
    near: dict[int, list[int]] = {}
    for x, y in pairs.tolist():
        near.setdefault(x, []).append(y)
        near.setdefault(y, []).append(x)
    waiting, found = set(near), []
    while waiting:
        edge = [waiting.pop()]
        while edge:
            x = edge.pop()
            for y in near[x]:
                if y in waiting:
                    inter = _overlap(sets[x], sets[y])
                    if 100 * inter >= percent * (len(sets[x]) + len(sets[y]) - inter):
                        waiting.discard(y)
                        edge.append(y)
                        found.append((x, y))
    return np.array(found, dtype=np.int64).reshape(-1, 2)


def _edges(ids: np.ndarray, links: np.ndarray) -> pa.Table:
    node, root = star_of(links, ids)
    return pa.table({"src": pa.array(ids[node], pa.int64()), "dst": pa.array(ids[root], pa.int64())})


def _named(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set."""
    return tuple(int(mix(s ^ seed).sum(dtype=np.uint64).view(np.int64)) for seed in (np.uint64(0), np.uint64(0x5851F42D4C957F2D)))


def shingle_features(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, hash of the text, n_shingles, two set hashes and the parity signature of every document."""
    kind = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "text_key", "n_shingles", "h1", "h2")] + [T.StructField("bits", T.BinaryType())])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h1, h2, signs = [], [], [], []
            for s in shingle_sets(batch.column(2), width):
                n.append(len(s))
                for out, h in zip((h1, h2), _named(s)):
                    out.append(h)
                signs.append(signature(s, int(signature_bits(len(s)))) if len(s) else b"")
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(x, pa.int64()) for x in (n, h1, h2)), pa.array(signs, pa.binary())], names=kind.names)

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(features, kind)


def _tile_pairs(reps: DataFrame, percent: int) -> DataFrame:
    """Each representative once for every tile pair that may hold a partner of it."""
    # One row per size that occurs: this grows with the longest text, not with the number of texts.
    found = reps.groupBy("n_shingles").agg(F.count("*").alias("n")).toPandas().sort_values("n_shingles")
    counts = found["n"].to_numpy(np.int64)
    tiles = size_tiles(found["n_shingles"].to_numpy(np.int64), counts, int(np.clip(counts.sum() // 48, *_TILE_ROWS)))
    spans = ("tile", "first", "last")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size = (batch.column(k).to_numpy() for k in (0, 1))
            at = np.searchsorted(tiles.sizes, size)
            tile = tiles.first[at] + node % tiles.parts[at]
            first = np.searchsorted(tiles.high, -(-size * percent // 100))
            last = np.searchsorted(tiles.low, size * 100 // percent, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int32()) for x in (tile, first, last))], names=[*batch.schema.names, *spans])

    rows = reps.select("node", "n_shingles", "bits")
    placed = rows.mapInArrow(place, T.StructType([*rows.schema.fields, *(T.StructField(n, T.IntegerType()) for n in spans)]))
    at = F.transform(F.sequence("first", "last"), lambda j: F.struct(F.least(j, "tile").alias("low"), F.greatest(j, "tile").alias("high"), (j < F.col("tile")).cast("int").alias("side")))
    return placed.select("node", "n_shingles", "bits", F.explode(at).alias("at")).select("node", "n_shingles", "bits", "at.*")


def candidate_edges(reps: DataFrame, percent: int) -> DataFrame:
    def compare(key: tuple, table: pa.Table) -> pa.Table:
        ids, sizes = (table.column(c).to_numpy() for c in ("node", "n_shingles"))
        side = table.column("side").to_numpy()
        signs = table.column("bits").to_pylist()
        bits = 8 * min(map(len, signs))
        parts = []
        for s in (0, 1):
            at = np.flatnonzero(side == s)
            parts.append((at, _folded([signs[i] for i in at], bits) if len(at) else None))
        (a_at, a), (b_at, b) = parts
        if key[0].as_py() == key[1].as_py():
            pairs = a_at[passing_pairs(a, sizes, a, sizes, percent, True)]
        elif len(a_at) and len(b_at):
            got = passing_pairs(a, sizes[a_at], b, sizes[b_at], percent, False)
            pairs = np.stack([a_at[got[:, 0]], b_at[got[:, 1]]], axis=1)
        else:
            pairs = np.zeros((0, 2), np.int64)
        return _edges(ids, pairs)

    return _tile_pairs(reps, percent).groupBy("low", "high").applyInArrow(compare, _EDGES)


def verified_edges(docs: DataFrame, groups: DataFrame, width: int, percent: int) -> DataFrame:
    """Links among the documents of each candidate group, decided on the sorted shingle arrays.

    ``groups``: node, its rep (doc_id and text_key of one of its rows), n_shingles, h1, h2, component.
    Small groups share a task; a group with more than ``_GROUP_SHINGLES`` shingles is cut into parts,
    and each pair of parts is a task of its own.
    """
    n, whole = groups.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    shares = max(1, whole // _GROUP_SHINGLES)
    size = groups.groupBy("component").agg(F.sum("n_shingles").alias("weight"))
    cut = groups.join(size, "component").withColumn("parts", F.ceil(F.col("weight") / _GROUP_SHINGLES).cast("int"))
    cut = cut.select("rep.*", "node", "component", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "h1", "h2")
    cut = written(cut, "cut")
    kind = T.StructType(
        [T.StructField("node", T.LongType()), T.StructField("component", T.LongType()), T.StructField("parts", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("shingles", T.BinaryType())]
    )

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Rows that share the rep's id and text all match it; one of a batch is enough.
            node, h1, h2 = (batch.column(k).to_numpy() for k in (0, 4, 5))
            rows = np.sort(np.unique(node, return_index=True)[1])
            made, fits = [], []
            for k, s in zip(rows.tolist(), shingle_sets(batch.column(6).take(pa.array(rows)), width)):
                if _named(s) == (h1[k], h2[k]):
                    fits.append(k)
                    made.append(s.tobytes())
            fits = pa.array(fits, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(fits) for k in range(4)), pa.array(made, pa.binary())], names=kind.names)

    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_key"), text.alias("text"))
    if n <= _MOST_NAMED:  # counted: one long each; beyond that the join itself brings all texts together once
        named = F.broadcast(cut.select(F.xxhash64("doc_id", "text_key").alias("_name")).distinct())
        texts = texts.join(named, F.xxhash64("_id", "_key") == F.col("_name"), "left_semi")
    found = texts.join(cut, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key")))
    sets = found.select("node", "component", "parts", "part", "h1", "h2", "text").mapInArrow(arrays, kind)
    task = "struct({} as home, {} as low, {} as high, {} as side)"
    lone = f"array({task.format(f'pmod(xxhash64(component), {shares}L)', '-1', '-1', '0')})"
    many = f"transform(sequence(0, parts - 1), j -> {task.format('component', 'least(j, part)', 'greatest(j, part)', 'if(j < part, 1, 0)')})"
    dealt = sets.withColumn("at", F.explode(F.expr(f"if(parts = 1, {lone}, {many})"))).select("node", "component", "shingles", "at.*")

    def verify(key: tuple, table: pa.Table) -> pa.Table:
        ids, group, side = (table.column(c).to_numpy() for c in ("node", "component", "side"))
        _, first = np.unique(ids, return_index=True)
        raw = table.column("shingles")
        cross = key[1].as_py() != key[2].as_py()
        nodes, roots = [], []
        order = first[np.argsort(group[first], kind="stable")]
        for members in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            sets = [np.frombuffer(raw[int(i)].as_py(), np.uint64) for i in members]
            sizes = np.array([len(s) for s in sets])
            bits = int(min(1 << 12, max(64, 1 << int(sizes.max() - 1).bit_length())))
            signs = _bits_of([signature(s, bits) for s in sets], bits)
            if cross:
                a, b = np.flatnonzero(side[members] == 0), np.flatnonzero(side[members] == 1)
                if not len(a) or not len(b):
                    continue
                got = passing_pairs(signs[a], sizes[a], signs[b], sizes[b], percent, False)
                pairs = np.stack([a[got[:, 0]], b[got[:, 1]]], axis=1)
            else:
                pairs = passing_pairs(signs, sizes, signs, sizes, percent, True)
            links = exact_links(sets, pairs, percent)
            node, root = star_of(links, ids[members])
            nodes.append(ids[members][node])
            roots.append(ids[members][root])
        flat = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
        return pa.table({"src": flat(nodes), "dst": flat(roots)})

    return dealt.groupBy("home", "low", "high").applyInArrow(verify, _EDGES)


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row of ``docs``.

    Two rows link when 100 * intersection >= ``percent`` * union of their sets of ``width``-word
    shingles (A-Z lower-cased); fewer words make one shingle. Null and empty texts have size 0 and
    link with nothing. Rows are compared by their texts alone: rows that repeat a doc_id are rows of
    their own, each with its own component, and so are rows without a doc_id. A null doc_id names no
    component: its row gets the smallest doc_id that it reaches, null if it reaches none. Texts of
    any length are taken whole, longer ones in an array call of their own. Other columns are ignored;
    an empty table gives an empty table.
    """
    features = written(shingle_features(in_small_batches(docs), width), "shingles")
    key = ["n_shingles", "h1", "h2"]
    classes = features.where("n_shingles > 0").groupBy(*key).agg(F.min(F.struct("doc_id", "text_key", "bits")).alias("top"), F.min("doc_id").alias("low"))
    classes = classes.select(F.monotonically_increasing_id().alias("node"), *key, "low", F.struct("top.doc_id", "top.text_key").alias("rep"), "top.bits")
    reps = written(classes, "representatives")
    maybe = connected_components(candidate_edges(reps, percent)).withColumnRenamed("node", "_node")
    groups = written(maybe.join(reps, F.col("_node") == F.col("node")).select("node", "rep", *key, "component"), "candidates")
    linked = connected_components(verified_edges(docs, groups, width, percent)).withColumnRenamed("node", "_node")
    members = written(linked.join(reps, F.col("_node") == F.col("node")).select("_node", "component", "low"), "members")
    tops = members.join(members.groupBy("component").agg(F.min("low").alias("top")), "component").select("_node", "top")
    named = reps.join(tops, F.col("_node") == F.col("node"), "left").select(*(F.col(k).alias(f"_{k}") for k in key), F.coalesce("top", "low").alias("component_id"))
    same = [F.col(k) == F.col(f"_{k}") for k in key]
    return features.join(named, same, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
