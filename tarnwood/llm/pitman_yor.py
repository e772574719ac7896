"""Hierarchical Pitman-Yor language model: training by Gibbs sampling and scoring, as one Spark job.

The model has a restaurant for each context word; all of them share one parent, the restaurant of
words, whose base is uniform. A customer of a context restaurant is one occurrence of a word after
that context; each table there is a customer of the parent.

How the work is dealt out. Occurrences are shuffled once, packed, into buckets by context word; a
context that holds more than a small share of all tokens is dealt over all buckets by its following
word, and its totals are summed separately. In a sweep every bucket draws anew how the customers of
each dish are seated, given all other dishes and the parent; it sends its table counts to shards by
word, which hold the parent restaurant, draw its seating, and answer with the parent's statistics.
Restaurants are updated side by side from the state of the sweep before, the usual form of parallel
training for this model. The seating of a dish is one block: the number of its tables is drawn from
its exact conditional distribution up to 32 customers (generalised Stirling numbers), beyond that
customer by customer in short runs with a look-ahead factor. After the burn-in, the predictive
probabilities of all sweeps are averaged.

Discounts are not sampled: each level's is n1 / (n1 + 2 * n2) of its dishes with one and two
customers, within 0.1 and 0.95, anew in every sweep for the words. The strength is a parameter, the
same for all restaurants. How occurrences are dealt depends on the texts alone, and so do the draws:
neither the cluster nor its number of shuffle partitions changes a score.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwood.llm.shared import in_small_batches
from tarnwood.llm.tokens import mix, words_of

_U64 = np.uint64
_BEGIN = _U64(0xB5AD4ECEDA1CE2A9)
_FINISH = _U64(0x1F83D9ABFB41BD6B)
_FLUSH = 3_000_000
_BUCKET_BYTES = 16 << 20
_EXACT = 32
_GLOBALS = 8  # customers, tables, ones, twos of the parent; tokens, types, ones, twos of the contexts

_PACKED = T.StructType(
    [T.StructField("bucket", T.IntegerType()), T.StructField("flush", T.LongType())]
    + [T.StructField(n, T.BinaryType()) for n in ("u", "runs", "names", "w", "n_all", "n_held", "doc", "ids", "held")]
)
_MAIL = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("target", "origin", "sweep")]
    + [T.StructField(n, T.BinaryType()) for n in ("words", "values", "hot", "hot_values", "head", "state", "memory")]
)
_PARTS = T.StructType(
    [T.StructField("flush", T.LongType()), T.StructField("bucket", T.IntegerType())]
    + [T.StructField(n, T.BinaryType()) for n in ("doc", "base", "score", "unknown", "ids", "held", "size")]
    + [T.StructField("train_tokens", T.LongType()), T.StructField("types", T.LongType())]
)
SCORES = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType())]
    + [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")]
    + [T.StructField(n, T.DoubleType()) for n in ("base_score", "score", "perplexity")]
)


def _frame(schema: T.StructType, rows: list[tuple]) -> pa.Table:
    kinds = {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.BinaryType(): pa.binary(), T.DoubleType(): pa.float64(), T.BooleanType(): pa.bool_()}
    columns = list(zip(*rows)) if rows else [()] * len(schema.fields)
    return pa.table({f.name: pa.array(list(c), kinds[f.dataType]) for f, c in zip(schema.fields, columns)})


def small(values: np.ndarray) -> bytes:
    """Counts as bytes, those of 255 and more behind them: most are one, and bytes compress well."""
    big = np.flatnonzero(values >= 255)
    return np.minimum(values, 255).astype(np.uint8).tobytes() + values[big].astype(np.uint32).tobytes() + np.uint32(len(big)).tobytes()


def unsmall(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw[-4:], np.uint32)[0])
    out = np.frombuffer(raw, np.uint8, len(raw) - 4 - 4 * n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, np.uint32, n, len(raw) - 4 - 4 * n)
    return out


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


# ---------------------------------------------------------------- packing occurrences


def hot_contexts(docs: DataFrame, buckets: int) -> list[int]:
    """Hashes of words with at least 1/(4 * buckets) of all tokens: fewer than 8 * buckets.

    Counted over all documents. A chunk reports only words above half that share of its own tokens,
    so reports stay small and no word above the share is missed by more than a factor of two.
    """
    kind = T.StructType([T.StructField("word", T.LongType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, words in words_of(batch.column(0), lower=True):
                total = len(words.start) + high - low
                keys, n = np.unique(words.hashes(), return_counts=True)
                often = n * 8 * buckets >= total
                names = np.concatenate([keys[often].view(np.int64), _BEGIN.reshape(1).view(np.int64), [0]])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.concatenate([n[often], [high - low, total]]), pa.int64())], names=kind.names)

    found = docs.select(F.col("text").cast("string")).mapInArrow(count, kind).groupBy("word").agg(F.sum("n").alias("n"))
    total = found.where("word = 0").first()
    if total is None:
        return []
    return sorted(r["word"] for r in found.where(F.col("n") * 8 * buckets >= F.lit(total["n"])).where("word <> 0").collect())


def pack_occurrences(docs: DataFrame, buckets: int, hot: list[int]) -> DataFrame:
    """Every (context, word) occurrence with its document, sorted and packed by bucket."""
    kind, hot_keys = _PACKED, np.sort(np.array(hot, dtype=np.int64).view(_U64))

    def flush(number: int, ids: list, held: list, tokens: list, sizes: list) -> pa.RecordBatch:
        n_docs = len(ids)
        size = np.concatenate(sizes)
        first = np.concatenate([[0], np.cumsum(size)])
        keys, back = np.unique(np.concatenate([*tokens, [_BEGIN, _FINISH]]), return_inverse=True)
        begin, finish = back[-2], back[-1]
        back = back[:-2].astype(np.int32)
        # Occurrence k of a document: contexts are the begin mark and its words, words are its words and the end.
        u = np.insert(back, first[:-1], begin)
        w = np.insert(back, first[1:], finish)
        narrow = np.uint16 if n_docs <= 1 << 16 else np.uint32
        doc = np.repeat(np.arange(n_docs, dtype=narrow), size + 1)
        bucket = (mix(keys) % _U64(buckets)).astype(np.int32)[u]
        split = np.flatnonzero(np.isin(keys, hot_keys)[u])
        bucket[split] = (mix(keys[u[split]] ^ mix(keys[w[split]])) % _U64(buckets)).astype(np.int32)
        if buckets < 1 << 16 and len(keys) < 1 << 24:
            order = bucket.astype(_U64) << _U64(48)
            order |= u.astype(_U64) << _U64(24)
            order |= w.astype(_U64)
            order = np.argsort(order, kind="stable")
        else:
            order = np.lexsort((w, u, bucket))
        bucket, u, w, doc = bucket[order], u[order], w[order], doc[order]
        out = np.array(held, dtype=bool)[doc]
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        rows = []
        for b in range(buckets):
            at = slice(edges[b], edges[b + 1])
            ub, wb = u[at], w[at]
            mine = b == number % buckets
            if not len(ub) and not mine:
                continue
            new_u = np.append(True, ub[1:] != ub[:-1])[: len(ub)]
            new = new_u | np.append(True, wb[1:] != wb[:-1])[: len(ub)]
            starts = np.flatnonzero(new)
            n_all = np.diff(np.append(starts, len(ub)))
            n_held = np.add.reduceat(out[at].astype(np.int64), starts) if len(starts) else n_all
            runs = np.diff(np.append(np.flatnonzero(new_u[starts]), len(starts)))
            names, at_name = np.unique(wb[starts], return_inverse=True)
            cells = (keys[ub[new_u]].tobytes(), small(runs), keys[names].tobytes(), at_name.astype(np.uint16 if len(names) <= 1 << 16 else np.uint32).tobytes(), small(n_all), small(n_held), doc[at].tobytes())
            extra = (pa.array(ids, pa.int64()).fill_null(0).to_numpy().tobytes(), np.array([2 * (i is None) + h for i, h in zip(ids, held)], np.uint8).tobytes()) if mine else (None, None)
            rows.append((b, number, *cells, *extra))
        return _frame(kind, rows).combine_chunks().to_batches()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        ids, held, tokens, sizes, n = [], [], [], [], 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            for low, high, words in words_of(batch.column(1), lower=True):
                ids += names[low:high]
                held += [held_out(i) for i in names[low:high]]
                tokens.append(words.hashes())
                sizes.append(np.diff(words.first))
                n += len(words.start) + high - low
                if n >= _FLUSH:
                    yield from flush(number, ids, held, tokens, sizes)
                    number += 1
                    ids, held, tokens, sizes, n = [], [], [], [], 0
        if ids:
            yield from flush(number, ids, held, tokens, sizes)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pack, kind)


# ---------------------------------------------------------------- restaurants


@lru_cache(maxsize=8)
def _log_stirling(discount: float) -> np.ndarray:
    """log of the generalised Stirling numbers S(c, t) for c, t up to ``_EXACT``."""
    out = np.full((_EXACT + 1, _EXACT + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(_EXACT):
        stay = c - discount * np.arange(_EXACT + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[c + 1] = np.logaddexp(np.append(-np.inf, out[c, :-1]), np.where(stay > 0, out[c] + np.log(np.maximum(stay, 1e-300)), -np.inf))
    return out


def draw_tables(customers: np.ndarray, others: np.ndarray, chance: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Number of tables of each dish given its customers, the tables of the restaurant's other dishes
    and the dish's probability in the parent."""
    tables = np.minimum(customers, 1).astype(np.int64)
    stirling = _log_stirling(discount)
    few = np.minimum(customers, _EXACT)
    log_chance = np.log(np.maximum(chance, 1e-300))
    order = np.argsort(few, kind="stable")
    bounds = np.searchsorted(few[order], np.arange(2, _EXACT + 2))
    for c in range(2, _EXACT + 1):
        for s in range(bounds[c - 2], bounds[c - 1], 1 << 15):
            at = order[s : min(s + (1 << 15), bounds[c - 1])]
            weight = np.cumsum(np.log(strength + discount * (others[at][:, None] + np.arange(c))) + log_chance[at][:, None], axis=1) + stirling[c, 1 : c + 1]
            if c == _EXACT:  # more customers follow: what a table costs them later
                n = np.maximum(customers[at], c)[:, None]
                t = discount * np.arange(1, c + 1)
                weight += np.cumsum(discount * (1 - chance[at])[:, None] * np.log((c - t + discount) / (n - t + discount)), axis=1) * (n > c)
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            pick = rng.random(len(at))[:, None] * weight[:, -1:]
            tables[at] = 1 + np.minimum((weight < pick).sum(axis=1), c - 1)
    at = np.flatnonzero(customers > _EXACT)
    seated = np.full(len(at), _EXACT, dtype=np.int64)
    while len(at):
        run = np.minimum(np.maximum(1, seated // 16), customers[at] - seated)
        t = tables[at]
        room = seated + run / 2 - discount * t
        ahead = (room / (customers[at] - discount * t)) ** (discount * (1 - chance[at]))
        new = (strength + discount * (others[at] + t)) * chance[at] * np.minimum(1.0, ahead)
        tables[at] += rng.binomial(run, new / (new + room))
        seated += run
        left = seated < customers[at]
        at, seated = at[left], seated[left]
    return tables


def _discount(ones: float, twos: float) -> float:
    """The usual estimate from the numbers of dishes with one and two customers."""
    return float(np.clip(ones / (ones + 2 * twos), 0.1, 0.95)) if ones else 0.5


class Bucket:
    """All occurrences of one bucket: distinct (context, word) cells and what each flush holds of them."""

    def __init__(self, packed: pa.Table, buckets: int, hot: np.ndarray):
        col = {n: packed.column(n).to_pylist() for n in packed.column_names}
        order = sorted(range(packed.num_rows), key=lambda i: col["flush"][i])
        read = lambda name, kind: [np.frombuffer(col[name][i], kind) for i in order]
        us, runs = read("u", _U64), [unsmall(col["runs"][i]) for i in order]
        named = read("names", _U64)
        self.flush = [col["flush"][i] for i in order]
        self.ids = [(col["ids"][i], col["held"][i]) for i in order]
        self.n_all, n_held = (np.concatenate([unsmall(col[n][i]) for i in order]) for n in ("n_all", "n_held"))
        self.cells_of = [int(r.sum()) for r in runs]
        self.docs = []
        for i, k, n in zip(order, np.cumsum(self.cells_of), self.cells_of):
            raw = col["doc"][i]
            many = int(self.n_all[k - n : k].sum())
            self.docs.append(np.frombuffer(raw, np.uint16 if len(raw) == 2 * many else np.uint32).astype(np.int64))
        self.u, u_back = np.unique(np.concatenate(us), return_inverse=True)
        self.words, name_back = np.unique(np.concatenate(named), return_inverse=True)
        first = np.cumsum([0, *map(len, named)])
        word = np.concatenate([name_back[a + np.frombuffer(col["w"][i], np.uint16 if len(n) <= 1 << 16 else np.uint32)] for i, a, n in zip(order, first, named)])
        key = (np.repeat(u_back, np.concatenate(runs)) << 32) | word
        cells, self.cell = np.unique(key, return_inverse=True)
        self.context, self.word = cells >> 32, cells & 0xFFFFFFFF
        self.customers = np.bincount(self.cell, weights=self.n_all - n_held, minlength=len(cells)).astype(np.int64)
        self.is_hot = np.isin(self.u, hot)
        self.total = np.bincount(self.context, weights=self.customers, minlength=len(self.u))

    def sum_by_context(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, weights=values, minlength=len(self.u))


class Answers:
    """What the shards say of one sweep to one bucket."""

    def __init__(self, bucket: Bucket, rows: list[dict], shards: int, strength: float):
        above = np.zeros((2, len(bucket.words)))
        self.customers, self.tables = bucket.total.copy(), np.zeros(len(bucket.u))
        home = shard_of(bucket.words, shards)
        hot_home = shard_of(bucket.u, shards)
        sums = np.zeros(_GLOBALS)
        for r in rows:
            if r["state"] is not None:
                self.state = unsmall(r["state"])
            above[:, home == r["origin"]] = unsmall(r["values"]).reshape(2, -1)
            at = np.flatnonzero(bucket.is_hot & (hot_home == r["origin"]))
            both = np.frombuffer(r["hot_values"], np.float64).reshape(2, -1)
            self.customers[at], self.tables[at] = both
            sums += np.frombuffer(r["head"], np.float64)
        own = bucket.sum_by_context(self.state)
        self.tables[~bucket.is_hot] = own[~bucket.is_hot]
        self.sums = sums
        c0, t0, ones0, twos0, self.tokens, self.types, ones, twos = sums
        self.discount, self.strength = _discount(ones, twos), strength
        d0, s0 = _discount(ones0, twos0), strength
        self.chance = (np.maximum(0.0, above[0] - d0 * above[1]) + (s0 + d0 * t0) / (self.types + 1)) / (s0 + c0)

    def predictive(self, bucket: Bucket) -> np.ndarray:
        """Probability of each cell's word after its context."""
        c, t = self.customers[bucket.context], self.tables[bucket.context]
        own = np.maximum(0.0, bucket.customers - self.discount * self.state)
        return (own + (self.strength + self.discount * t) * self.chance[bucket.word]) / (self.strength + c)


def recalled(rows: list[dict]) -> list[list[dict]]:
    """The answers of the sampled sweeps before, which travel with the bucket's state, and these."""
    before = next((r["memory"] for r in rows if r["memory"] is not None), None)
    return [*(pickle.loads(before) if before else []), [r | {"memory": None} for r in rows]]


def shard_of(words: np.ndarray, shards: int) -> np.ndarray:
    return (mix(words ^ _U64(0x632BE59BD9B4E019)) % _U64(shards)).astype(np.int64)


def _send(bucket: Bucket, number: int, sweep: int, tables: np.ndarray, sums: np.ndarray, shards: int, memory: bytes | None = None) -> pa.Table:
    """One message to each shard; one of them keeps the bucket's state and sends it back."""
    by_word = np.bincount(bucket.word, weights=tables, minlength=len(bucket.words)).astype(np.int64)
    home, hot_home = shard_of(bucket.words, shards), shard_of(bucket.u, shards)
    by_context = bucket.sum_by_context(tables)
    cold = ~bucket.is_hot
    tokens, types = bucket.total[cold].sum(), (bucket.total[cold] > 0).sum()
    rows = []
    word_order = np.argsort(home, kind="stable")
    edges = np.searchsorted(home[word_order], np.arange(shards + 1))
    for r in range(shards):
        at = word_order[edges[r] : edges[r + 1]]
        hot_at = np.flatnonzero(bucket.is_hot & (hot_home == r))
        mine = r == number % shards
        head = np.array([*sums[:2], sums[5], *sums[2:4], *((tokens, types, (bucket.customers == 1).sum(), (bucket.customers == 2).sum()) if mine else (0, 0, 0, 0))], np.float64)
        w = bucket.words[at]
        named = (None, None)
        if not sweep:  # the shards read the names of words and hot contexts from the first messages
            named = (w.tobytes(), bucket.u[hot_at].tobytes())
        kept = (small(tables), memory) if mine else (None, None)
        rows.append((r, number, sweep, named[0], small(by_word[at]), named[1], np.stack([bucket.total[hot_at], by_context[hot_at]]).tobytes(), head.tobytes(), *kept))
    return _frame(_MAIL, rows)


def _parent_step(key: tuple, first: pa.Table, mail: pa.Table, seed: int, strength: float) -> pa.Table:
    """One shard of the parent restaurant: sum, seat, answer every bucket."""
    by_origin = lambda t: sorted(t.to_pylist(), key=lambda r: r["origin"])
    rows, names = by_origin(mail), by_origin(first.select(["origin", "words", "hot"]))
    sweep = rows[0]["sweep"]
    lists = [np.frombuffer(r["words"], _U64) for r in names]
    _, back = np.unique(np.concatenate(lists), return_inverse=True)
    customers = np.bincount(back, weights=np.concatenate([unsmall(r["values"]) for r in rows])).astype(np.int64)
    heads = np.stack([np.frombuffer(r["head"], np.float64) for r in rows])
    c0, t0, types, ones0, twos0 = heads[0, :5]
    rng = np.random.default_rng([seed, 7, sweep, key[0].as_py()])
    d0 = _discount((customers == 1).sum(), (customers == 2).sum()) if not c0 else _discount(ones0, twos0)
    if c0:
        tables = draw_tables(customers, np.full(len(customers), max(0.0, t0 - 1)), np.full(len(customers), 1 / (types + 1)), d0, strength, rng)
    else:
        tables = np.minimum(customers, 1)
    hot, hot_back = np.unique(np.concatenate([np.frombuffer(r["hot"], _U64) for r in names]), return_inverse=True)
    both = np.concatenate([np.frombuffer(r["hot_values"], np.float64).reshape(2, -1) for r in rows], axis=1)
    totals = np.stack([np.bincount(hot_back, weights=b, minlength=len(hot)) for b in both])
    ones, twos = (customers == 1).sum(), (customers == 2).sum()
    sums = np.array([customers.sum(), tables.sum(), ones, twos, *heads[:, 5:].sum(axis=0)], np.float64)
    sums[4] += totals[0].sum()
    sums[5] += (totals[0] > 0).sum()
    out, at, hot_at = [], 0, 0
    for r, name, listed in zip(rows, names, lists):
        n_hot = len(name["hot"]) // 8
        mine = hot_back[hot_at : hot_at + n_hot]
        out.append((r["origin"], key[0].as_py(), sweep, None, small(np.concatenate([customers[back[at : at + len(listed)]], tables[back[at : at + len(listed)]]])), None, totals[:, mine].tobytes(), sums.tobytes(), r["state"], r["memory"]))
        at, hot_at = at + len(listed), hot_at + n_hot
    return _frame(_MAIL, out)


def score_documents(docs: DataFrame, burn_in: int = 1, samples: int = 2, seed: int = 1, buckets: int | None = None, strength: float = 1.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row.

    Tokens: words with A-Z lower-cased, then one end. The model learns from all documents that are
    not held out (crc32 of the doc_id as text, modulo 7, is 2) and scores all. ``score`` is the log10
    probability of the text under the mean of the predictive probabilities of ``samples`` sweeps
    after ``burn_in``. A null or empty text is an end alone; a null doc_id counts as empty text for
    the hash; repeated rows are documents of their own. A long text is one row of word hashes, eight
    bytes a word. Other columns are ignored; an empty table gives an empty table. Words are told apart
    by 64-bit hashes. ``buckets`` defaults to one for every 16 MB of text, which a task holds as arrays.
    """
    docs = in_small_batches(docs)
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    buckets = buckets or max(4, -(-size // _BUCKET_BYTES))
    shards = max(2, round(2 * buckets**0.5))
    hot_list = hot_contexts(docs, buckets)
    hot = np.sort(np.array(hot_list, dtype=np.int64).view(_U64))
    packed = pack_occurrences(docs, buckets, hot_list)

    def start(key: tuple, table: pa.Table) -> pa.Table:
        bucket = Bucket(table, buckets, hot)
        return _send(bucket, key[0].as_py(), 0, np.minimum(bucket.customers, 1), np.zeros(_GLOBALS), shards)

    def seat(key: tuple, table: pa.Table, mail: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _frame(_MAIL, [])
        bucket, rows, number = Bucket(table, buckets, hot), mail.to_pylist(), key[0].as_py()
        sweep = rows[0]["sweep"] + 1
        memory = pickle.dumps(recalled(rows)) if sweep > burn_in + 1 else None
        now = Answers(bucket, rows, shards, strength)
        others = np.maximum(0.0, now.tables[bucket.context] - now.state)
        rng = np.random.default_rng([seed, 3, sweep, number])
        tables = draw_tables(bucket.customers, others, now.chance[bucket.word], now.discount, now.strength, rng)
        return _send(bucket, number, sweep, tables, now.sums, shards, memory)

    def first_answer(key: tuple, table: pa.Table) -> pa.Table:
        return _parent_step(key, table, table, seed, strength)

    def answer(key: tuple, first: pa.Table, table: pa.Table) -> pa.Table:
        return _parent_step(key, first, table, seed, strength)

    def score(key: tuple, table: pa.Table, mail: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _frame(_PARTS, [])
        bucket, rounds = Bucket(table, buckets, hot), recalled(mail.to_pylist())
        mean = np.zeros(len(bucket.context))
        for rows in rounds:
            now = Answers(bucket, rows, shards, strength)
            mean += now.predictive(bucket)
        log_p = np.log10(mean / len(rounds))
        count = now.customers[bucket.context]
        log_c = np.log10(count + 1)
        out, at = [], 0
        for flush, doc, n, (ids, held) in zip(bucket.flush, bucket.docs, bucket.cells_of, bucket.ids):
            cell = np.repeat(bucket.cell[at : at + n], bucket.n_all[at : at + n])
            at += n
            here, back = np.unique(doc, return_inverse=True)
            total = lambda v: np.bincount(back, weights=v, minlength=len(here))
            cells = (small(np.diff(here, prepend=0)), total(log_c[cell]).tobytes(), total(log_p[cell]).tobytes(), small(total(count[cell] == 0).astype(np.int64)))
            out.append((flush, key[0].as_py(), *cells, ids, held, small(np.bincount(back, minlength=len(here))), int(now.tokens), int(now.types)))
        return _frame(_PARTS, out)

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        ids, flags = next((np.frombuffer(r["ids"], np.int64), np.frombuffer(r["held"], np.uint8)) for r in rows if r["ids"] is not None)
        sums = np.zeros((4, len(ids)))
        for r in sorted(rows, key=lambda r: r["bucket"]):
            at = np.cumsum(unsmall(r["doc"]))
            for k, values in enumerate((np.frombuffer(r["base"], np.float64), np.frombuffer(r["score"], np.float64), unsmall(r["unknown"]), unsmall(r["size"]))):
                sums[k, at] += values
        tokens, types = rows[0]["train_tokens"], rows[0]["types"]
        size = sums[3]
        return pa.table(
            {
                "doc_id": pa.array(ids, mask=flags >= 2),
                "held_out": pa.array(flags % 2 == 1),
                "n_tokens": pa.array(size.astype(np.int64)),
                "n_known": pa.array((size - sums[2]).astype(np.int64)),
                "train_tokens": pa.array(np.full(len(ids), tokens), pa.int64()),
                "base_score": pa.array(sums[0] - size * np.log10(tokens + types + 1)),
                "score": pa.array(sums[1]),
                "perplexity": pa.array(10 ** (-sums[1] / size)),
            }
        )

    # Every step reads the packed occurrences and the first messages from the same two shuffles.
    first = packed.groupBy("bucket").applyInArrow(start, _MAIL)
    replies = first.groupBy("target").applyInArrow(first_answer, _MAIL)
    for _ in range(burn_in + samples):
        mail = packed.groupBy("bucket").cogroup(replies.groupBy("target")).applyInArrow(seat, _MAIL)
        replies = first.groupBy("target").cogroup(mail.groupBy("target")).applyInArrow(answer, _MAIL)
    parts = packed.groupBy("bucket").cogroup(replies.groupBy("target")).applyInArrow(score, _PARTS)
    return parts.groupBy("flush").applyInArrow(gather, SCORES)
