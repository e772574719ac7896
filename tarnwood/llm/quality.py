"""Quality rules as a short-circuit cascade.

Each rule's cost and selectivity are estimated on a random sample; the rules then run in the order of
rejections per second, and a rule sees only the documents that all earlier ones kept. A document is
rejected if any rule rejects it, so the order changes the time and ``rejected_by``, never ``kept``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwood.llm.shared import in_small_batches
from tarnwood.llm.tokens import Words, find_words, slices, windows

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_ALPHA = np.zeros(256, dtype=bool)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True


@dataclass
class Texts:
    """A run of texts; measures are computed when first asked for."""

    data: np.ndarray
    offsets: np.ndarray
    _made: dict = field(default_factory=dict)

    def get(self, name: str) -> np.ndarray:
        if name not in self._made:
            self._made[name] = _MEASURES[name](self)
        return self._made[name]

    @property
    def words(self) -> Words:
        if "words" not in self._made:
            self._made["words"] = find_words(self.data, self.offsets)
        return self._made["words"]

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each row are flagged."""
        sums = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def take(self, rows: np.ndarray) -> Texts:
        if len(rows) == len(self.offsets) - 1:
            return self
        sizes = np.diff(self.offsets)[rows]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        parts = [self.data[self.offsets[r] : self.offsets[r + 1]] for r in rows]
        known = {k: v[rows] for k, v in self._made.items() if isinstance(v, np.ndarray)}
        return Texts(np.concatenate(parts) if parts else self.data[:0], offsets, known)


def _word_chars(t: Texts) -> np.ndarray:
    blank = np.isin(t.data, [0x20, 9, 10, 11, 12, 13])
    return t.per_row(((t.data & 0xC0) != 0x80) & ~blank)


def _dup_lines(t: Texts) -> np.ndarray:
    """Lines with a word that are equal to an earlier line of the same text.

    A line is what stands between line feeds, leading and trailing blanks included.
    """
    words, rows = t.words, len(t.offsets) - 1
    out = np.zeros(rows, dtype=np.int64)
    breaks = np.flatnonzero(t.data == 10)
    start = np.union1d(np.concatenate([[0], breaks + 1]), t.offsets[:-1])
    start = start[start < len(t.data)]
    end = np.minimum(np.append(start[1:], len(t.data)), t.offsets[np.searchsorted(t.offsets, start, "right")])
    end = end - ((end > start) & (t.data[np.maximum(end - 1, 0)] == 10))
    filled = np.searchsorted(words.start, start) < np.searchsorted(words.start, end)
    start, end = start[filled], end[filled]
    hashed = Words(t.data, t.offsets, start, end, np.searchsorted(start, t.offsets)).hashes()
    row = np.searchsorted(t.offsets, start, "right") - 1
    order = np.lexsort((hashed, row))
    same = (row[order][1:] == row[order][:-1]) & (hashed[order][1:] == hashed[order][:-1])
    np.add.at(out, row[order][1:][same], 1)
    return out


def _repeat_words(t: Texts) -> np.ndarray:
    """Words that lie in a window of three words found twice or more in the text."""
    words, rows = t.words, len(t.offsets) - 1
    row = words.rows
    if len(row) < 4:
        return np.zeros(rows, dtype=np.int64)
    found = windows(words.hashes(), 3)
    inside = row[2:] == row[:-2]
    at = np.flatnonzero(inside)
    key = found[at]
    order = np.lexsort((key, row[at]))
    k, r = key[order], row[at][order]
    equal = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    twice = np.zeros(len(at), dtype=bool)
    twice[1:] |= equal
    twice[:-1] |= equal
    covered = np.zeros(len(row), dtype=bool)
    for step in range(3):
        covered[at[order][twice] + step] = True
    return np.bincount(row[covered], minlength=rows).astype(np.int64)


def _alpha_words(t: Texts) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(_ALPHA[t.data])])
    has = sums[t.words.end] > sums[t.words.start]
    return np.bincount(t.words.rows[has], minlength=len(t.offsets) - 1)


_MEASURES: dict[str, Callable[[Texts], np.ndarray]] = {
    "n_words": lambda t: np.diff(t.words.first).astype(np.int64),
    "word_chars": _word_chars,
    "n_symbols": lambda t: t.per_row(_SYMBOL[t.data]),
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
    "n_alpha_words": _alpha_words,
    "n_upper": lambda t: t.per_row(_UPPER[t.data]),
    "n_letters": lambda t: t.per_row(_LETTER[t.data]),
    "n_lines": lambda t: t.per_row(t.data == 10) + 1,
    "n_marks": lambda t: t.per_row(t.data == 33),
}

#: name -> function of Texts that is true where the rule rejects.
RULES: dict[str, Callable[[Texts], np.ndarray]] = {
    "few_words": lambda t: t.get("n_words") < 50,
    "repeated_windows": lambda t: 100 * t.get("n_repeat_words") > 50 * t.get("n_words"),
    "symbols": lambda t: 10 * t.get("n_symbols") > 2 * t.get("n_words"),
    "word_length": lambda t: (t.get("word_chars") < 2 * t.get("n_words")) | (t.get("word_chars") > 15 * t.get("n_words")),
    "capitals": lambda t: 10 * t.get("n_upper") > 3 * t.get("n_letters"),
    "shouting": lambda t: 10 * t.get("n_marks") > 2 * t.get("n_words"),
    "repeated_lines": lambda t: (t.get("n_dup_lines") >= 3) & (10 * t.get("n_dup_lines") > 3 * t.get("n_lines")),
    "no_letters": lambda t: 10 * t.get("n_alpha_words") < 6 * t.get("n_words"),
}

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def order_rules(docs: DataFrame, text_col: str = "text", sample_rows: int = 512) -> list[str]:
    """Rule names by rejections per second, estimated on about ``sample_rows`` documents drawn at random.

    The next rule is the one that rejects most per second of what the rules before it left, where what
    they measured already costs nothing. Only the order is estimated; every rule still judges every
    document that reaches it.
    """
    n = docs.count()
    texts = docs.select(F.col(text_col).cast("string"))
    drawn = texts if n <= sample_rows else texts.sample(sample_rows / n, seed=17)
    left = [Texts(data, offsets) for _, _, data, offsets in slices(drawn.toArrow().column(0).combine_chunks())]
    order: list[str] = []
    while len(order) < len(RULES):
        rate: dict[str, float] = {}
        for name in sorted(RULES.keys() - set(order)):
            spent, lost = 1e-9, 0
            for t in left:
                trial = Texts(t.data, t.offsets, dict(t._made))
                began = time.perf_counter()
                lost += int(RULES[name](trial).sum())
                spent += time.perf_counter() - began
            rate[name] = (lost + 0.5) / spent
        order.append(max(rate, key=lambda name: (rate[name], name)))
        left = [t.take(np.flatnonzero(~RULES[order[-1]](t))) for t in left]
    return order


def quality_cascade(
    docs: DataFrame,
    rules: list[str] | None = None,
    measures: tuple[str, ...] = (),
    text_col: str = "text",
    sample_rows: int = 512,
) -> DataFrame:
    """``docs`` with ``kept`` boolean, ``rejected_by`` string and the named measures as longs.

    A null text counts as empty and is rejected (too few words). Rows are judged by their texts alone,
    so repeated rows and null ids are judged alike; texts of any length are judged whole, longer ones
    in array calls of their own. Rules of equal rate are taken by name. An input column whose name is taken by a result column is replaced by it. An empty table gives
    an empty table.
    """
    order = order_rules(docs, text_col, sample_rows) if rules is None else list(rules)
    made = {"kept", "rejected_by", *measures}
    base = in_small_batches(docs).drop(*(c for c in docs.columns if c in made and c != text_col))
    added = [T.StructField("kept", T.BooleanType()), T.StructField("rejected_by", T.StringType()), *(T.StructField(m, T.LongType()) for m in measures)]
    names = [f.name for f in base.schema.fields]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(names.index(text_col))
            for low, high, data, offsets in slices(column):
                texts = Texts(data, offsets)
                by = np.full(high - low, -1)
                left, rest = np.arange(high - low), texts
                for k, name in enumerate(order):
                    if not len(left):
                        break
                    out = RULES[name](rest)
                    if out.any():
                        by[left[out]] = k
                        left, rest = left[~out], rest.take(np.flatnonzero(~out))
                reasons = np.array([*order, None], dtype=object)[by]
                extra = [pa.array(by < 0), pa.array(reasons.tolist(), pa.string())] + [pa.array(texts.get(m), pa.int64()) for m in measures]
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns, *extra], names=[*names, *(f.name for f in added)])

    return base.mapInArrow(judge, T.StructType([*base.schema.fields, *added]))


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: the base measures, ``base_failed`` and the cascade's verdict."""
    judged = quality_cascade(docs.select("doc_id", "text"), measures=BASE)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *BASE, failed.alias("base_failed"), (F.col("kept") & ~failed).alias("kept"), "rejected_by")
