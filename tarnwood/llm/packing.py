"""Sum-of-squares online packing of tokenised documents into windows.

Every task packs the documents it reads, in order, and keeps one number per fill level: how many
windows stand at that level. A document longer than a window is cut into full windows and a rest;
the rest goes to the level where the sum of squared counts grows least. What a task leaves in partly
filled windows goes on to a second round, in which the pieces of a few tasks at a time are placed in
the same way. Only what that leaves open is closed by cutting: the fullest windows stay and are
filled up from the emptiest, and the last remainder goes into windows whose lengths are powers of
two, which need no padding. No source or group of copies can gather in one task: tasks are put
together by their numbers.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwood.llm.shared import in_small_batches, written
from tarnwood.llm.tokens import Words, find_words, lowered, slices

PIECES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [T.StructField("recut", T.BooleanType())]
)
_OPEN = T.StructType([*PIECES.fields, T.StructField("round", T.LongType()), T.StructField("ids", T.BinaryType())])
_MOST_CACHED = 500_000
_TASKS = 8
_NARROW = "<u2"
_AT_ONCE = 8


class Piece(NamedTuple):
    """Part of a document: its ids from ``start``, of ``total`` in the document."""

    doc_id: int | None
    start: int
    total: int
    ids: np.ndarray
    recut: bool = False

    def cut(self, size: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.total, self.ids[:size], True), Piece(self.doc_id, self.start + size, self.total, self.ids[size:], True)


class LevelPacker:
    """Sum-of-squares placement; ``count[h]`` windows stand at level ``h``."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list[Piece]]] = {}

    def place(self, piece: Piece) -> list[Piece] | None:
        """Puts a piece shorter than a window where it fits best; the window's pieces once it is full.

        Of levels that are equally good the emptiest is taken.
        """
        size, full = len(piece.ids), self.window
        count = self.count
        # Growth of the sum of squares when a window goes from level h to h + size; a full one leaves.
        growth = 2 * (count[size : full + 1] - count[: full + 1 - size]) + 2
        growth[0] = 2 * count[size] + 1
        growth[-1] = 1 - 2 * count[full - size]
        growth[1:][count[1 : full + 1 - size] == 0] = np.iinfo(np.int64).max
        level = int(np.argmin(growth))
        held = []
        if level:
            held = self.open[level].pop()
            count[level] -= 1
        held.append(piece)
        level += size
        if level == full:
            return held
        count[level] += 1
        self.open.setdefault(level, []).append(held)
        return None

    def left(self) -> list[list[Piece]]:
        """The windows still open, fullest first."""
        return [held for level in sorted(self.open, reverse=True) for held in self.open[level]]


def close_windows(windows: list[list[Piece]], window: int) -> list[list[Piece]]:
    """Full windows of ``windows`` (fullest first), filled up from the emptiest, and power-of-two ones of the rest."""
    out, at, end, loose = [], 0, len(windows), []
    while at < end:
        held, room = list(windows[at]), window - sum(len(p.ids) for p in windows[at])
        at += 1
        while room:
            if not loose:
                if at == end:
                    break
                end -= 1
                loose = [p._replace(recut=True) for p in reversed(windows[end])]
            piece = loose.pop()
            if len(piece.ids) > room:
                piece, rest = piece.cut(room)
                loose.append(rest)
            held.append(piece)
            room -= len(piece.ids)
        out.append(held)
    # Either pieces are left over or the last window is short, never both.
    line = loose
    if out and sum(len(p.ids) for p in out[-1]) < window:
        line = [p._replace(recut=True) for p in reversed(out.pop())]
    left = sum(len(p.ids) for p in line)
    for size in (1 << b for b in range(window.bit_length(), -1, -1) if left >> b & 1):
        held = []
        while size:
            piece = line.pop()
            if len(piece.ids) > size:
                piece, rest = piece.cut(size)
                line.append(rest)
            held.append(piece)
            size -= len(piece.ids)
        out.append(held)
    return out


_KIND = np.zeros(256, dtype=np.uint8)
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[39] = 0
_BREAK = " \0 "


def find_pieces(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words cut where an ASCII letter, digit or mark (no apostrophe) meets another kind of these.

    The tokenizer's own pattern always cuts there, so ids of pieces make up the ids of the text.
    """
    words = find_words(data, offsets)
    kind = _KIND[data]
    cut = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    cut = cut[~edge[cut]]
    start, end = np.sort(np.concatenate([words.start, cut])), np.sort(np.concatenate([words.end, cut]))
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


class WordEncoder:
    """Ids of texts for a tokenizer that lower-cases and never joins across white space.

    Each piece is encoded once and kept, up to a fixed number of pieces. Rows that hold the text of an
    added token, which the tokenizer matches before it cuts, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [lowered(np.frombuffer(t.content.encode(), np.uint8)).tobytes() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = self._ids([_BREAK])[0]
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.at = np.zeros(0, dtype=np.int32)
        self.size = np.zeros(0, dtype=np.int32)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _ids(self, texts: list[str]) -> np.ndarray:
        """Ids of the texts one after another; of few texts at a time, as the tokenizer keeps much more than ids."""
        found = []
        for at in range(0, len(texts), _AT_ONCE):
            found += [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts[at : at + _AT_ONCE], add_special_tokens=False)]
        return np.concatenate(found)

    def _learn(self, pieces: Words, keys: np.ndarray, where: np.ndarray) -> None:
        """Encode the pieces at ``where``, many in one text with a mark between them."""
        raw = pieces.data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(pieces.start[where].tolist(), pieces.end[where].tolist())]
        odd = [k for k, t in enumerate(texts) if "\0" in t]
        alone = {k: self._ids([texts[k]]) for k in odd}
        for k in odd:
            texts[k] = ""
        marked = self._ids([_BREAK.join([*texts[i : i + 500], ""]) for i in range(0, len(texts), 500)])
        ends = np.flatnonzero(marked == self.mark)
        sizes = np.diff(ends, prepend=-1) - 1
        flat = marked[marked != self.mark]
        if odd:
            parts = np.split(flat, np.cumsum(sizes)[:-1])
            for k in odd:
                parts[k], sizes[k] = alone[k], len(alone[k])
            flat = np.concatenate(parts)
        at = np.cumsum(sizes) - sizes + len(self.ids)
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = (np.insert(have, place, more) for have, more in ((self.keys, keys), (self.at, at), (self.size, sizes)))
        self.ids = np.concatenate([self.ids, flat.astype(np.uint32)])

    def _place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, and where each row's ids begin."""
        low = lowered(data)
        pieces = find_pieces(low, offsets)
        keys, first, back = np.unique(pieces.hashes(), return_index=True, return_inverse=True)
        if not len(keys):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        _, known = self._place(keys)
        if not known.all():
            if len(self.keys) + (~known).sum() > _MOST_CACHED:
                self._clear()
                known[:] = False
            self._learn(pieces, keys[~known], first[~known])
        at, _ = self._place(keys)
        size, begin = self.size[at][back].astype(np.int64), self.at[at][back]
        ends = np.cumsum(size)
        flat = self.ids[np.repeat(begin - (ends - size), size) + np.arange(int(size.sum()))]
        first = np.concatenate([[0], ends])[pieces.first]
        whole = self._with_added(low, offsets)
        if not len(whole):
            return flat, first
        parts = np.split(flat, first[1:-1])
        for k in whole.tolist():
            parts[k] = self._ids([data[offsets[k] : offsets[k + 1]].tobytes().decode()])
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def _with_added(self, low: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows that hold an added token's text, in any case."""
        raw, at = low.tobytes(), []
        for text in self.added:
            pos = raw.find(text)
            while pos >= 0:
                at.append(pos)
                pos = raw.find(text, pos + 1)
        return np.unique(np.searchsorted(offsets, np.array(at, np.int64), side="right") - 1)


@functools.lru_cache(maxsize=2)
def encoder_for(path: str) -> WordEncoder:
    """The Python worker's encoder; it stays for the worker's later tasks."""
    return WordEncoder(path)


def _rows(held: list[Piece], sequence: int, again: int | None = None) -> list[tuple]:
    """Result rows of one window; with ``again`` those of an open one, for that group of the second round."""
    out, offset = [], 0
    for p in held:
        raw = None
        if again is not None:
            raw = p.ids.astype(_NARROW if int(p.ids.max()) < 1 << 16 else "<u4", copy=False).tobytes()
        out.append((p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4", copy=False).tobytes()), p.total, sequence, offset, p.recut, again, raw))
        offset += len(p.ids)
    return out


def _batch(rows: list[tuple], fields: list[T.StructField]) -> pa.RecordBatch:
    kinds = {T.LongType(): pa.int64(), T.BooleanType(): pa.bool_(), T.BinaryType(): pa.binary()}
    columns = list(zip(*rows)) if rows else [()] * len(_OPEN.fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType]) for c, f in zip(columns, fields)], names=[f.name for f in fields])


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, recut.

    A document is its ids followed by ``end_id``; a null or empty text is ``end_id`` alone. Repeated
    rows are packed once each and share their doc_id; a null doc_id stays null. The ids of one text
    are held whole, however long it is; of documents in open windows only the piece that is there.
    ``recut`` marks pieces that were moved to close the last open windows: a few in a hundred for
    some thousand documents a task, fewer for more. There is no padding. Other columns are ignored.
    An empty table gives an empty table. ``sequence_id`` holds the task's or the round's number in its
    high bits, so a rerun of a lost task over the same files gives the same rows.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer)
        packer, task = LevelPacker(window), TaskContext.get().partitionId()
        sequence, out = task << 36, []
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for low, high, data, offsets in slices(batch.column(1)):
                flat, first = encoder.encode(data, offsets)
                for k in range(low, high):
                    ids = np.append(flat[first[k - low] : first[k - low + 1]], np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(ids), window):
                        piece = Piece(doc_ids[k], at, len(ids), ids[at : at + window].copy())
                        held = [piece] if len(piece.ids) == window else packer.place(piece)
                        if held:
                            out += _rows(held, sequence)
                            sequence += 1
                yield _batch(out, _OPEN.fields)
                out = []
        for held in packer.left():
            out += _rows(held, sequence, task // _TASKS)
            sequence += 1
        for at in range(0, len(out), 250):
            yield _batch(out[at : at + 250], _OPEN.fields)

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        packer, sequence, out = LevelPacker(window), (1 << 62) + (number << 36), []
        order = np.lexsort([table.column(c).to_numpy() for c in ("offset", "sequence_id")])
        ids, start, total, size = (table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "length"))
        raw, full = table.column("ids"), []
        for i in order.tolist():
            part = raw[i].as_buffer()  # stays where it is
            if held := packer.place(Piece(ids[i], start[i], total[i], np.frombuffer(part, _NARROW if part.size < 4 * size[i] else "<u4"))):
                full.append(held)
        for held in full + close_windows(packer.left(), window):
            out += _rows(held, sequence)
            sequence += 1
        return pa.Table.from_batches([_batch(out, PIECES.fields)])

    rows = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    placed = written(rows.mapInArrow(pack, _OPEN), "windows")
    names = [f.name for f in PIECES.fields]
    again = placed.where("round is not null").groupBy("round").applyInArrow(finish, PIECES)
    return placed.where("round is null").select(*names).union(again)
