"""Quotation linking: find what a message quotes, join it to the quoted message, order replies.

Lines that begin with ``>`` are quoted, one level for each ``>``. Runs of lines of one level are
passages; a passage is hashed as a whole and line by line after normalising (case, blanks). The
hashes are joined to those of messages' own words. A message replies to the message whose words it
quotes at the lowest level; where several fit, one of the own conversation and then the latest is
taken.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwood.llm.shared import in_small_batches, written

_MARK = re.compile(r"[ \t]*((?:>[ \t]?)+)(.*)", re.S)
_ATTRIBUTION = re.compile(r"(?:on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*", re.I | re.S)
_SHORTEST = 12


def split_quotes(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The text without quoted lines and attribution lines, and (level, passage) in order."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    before = 0
    for line in text.split("\n"):
        m = _MARK.match(line)
        level = m[1].count(">") if m else 0
        if level:
            if not before and own and _ATTRIBUTION.fullmatch(own[-1].strip()):
                own.pop()
            if level != before:
                passages.append((level, []))
            passages[-1][1].append(m[2])
        else:
            own.append(line)
        before = level
    if not passages:
        return text, []
    return re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n"), [(k, "\n".join(v)) for k, v in passages]


def passage_hashes(text: str, lines: bool = True) -> dict[int, bool]:
    """Hashes of a text as a whole, of its paragraphs and of its lines, after normalising.

    The value tells whether a piece may link to other conversations: pieces under 12 characters,
    unless they are the whole text, are shared by chance and link inside their own conversation only.
    """
    pieces = [text]
    if lines:
        pieces += re.split(r"\n\s*\n", text) + text.split("\n")
    plain = [" ".join(p.casefold().split()) for p in pieces]
    wide: dict[str, bool] = {}
    for k, p in enumerate(plain):
        if p:
            wide[p] = wide.get(p, False) or k == 0 or len(p) >= _SHORTEST
    return {int.from_bytes(hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True): w for p, w in sorted(wide.items())}


_PARSED = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("levels", T.IntegerType()),
        T.StructField("own", T.ArrayType(T.StructType([T.StructField("hash", T.LongType()), T.StructField("wide", T.BooleanType())]))),
        T.StructField("quoted", T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("hash", T.LongType()), T.StructField("wide", T.BooleanType())]))),
        T.StructField("n_quotes", T.IntegerType()),
    ]
)


def parse_messages(messages: DataFrame) -> DataFrame:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, levels, own, quoted, n = [], [], [], [], []
            for t in batch.column(3).to_pylist():
                clean, passages = split_quotes(t) if t is not None else (None, [])
                text.append(clean)
                levels.append(max((k for k, _ in passages), default=0))
                own.append([{"hash": h, "wide": w} for h, w in passage_hashes(clean).items()] if clean else [])
                quoted.append([{"level": k, "hash": h, "wide": w} for k, p in passages for h, w in passage_hashes(p).items()])
                n.append(len(passages))
            arrays = [pa.array(text, pa.string()), pa.array(levels, pa.int32()), pa.array(own, pa.list_(pa.struct([("hash", pa.int64()), ("wide", pa.bool_())]))), pa.array(quoted, pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("wide", pa.bool_())]))), pa.array(n, pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *arrays], names=_PARSED.names)

    casts = [F.col(c).cast(k).alias(c) for c, k in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))]
    return in_small_batches(messages).select(*casts).mapInArrow(parse, _PARSED)


def steps_to_roots(parents: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """conv_id, turn, root_conv, root_turn and depth of all that have a parent, by doubled steps, and
    the rows of ``parents`` whose steps never end, None if there are none.
    """
    reach = parents.select("conv_id", "turn", F.col("parent_conv").alias("root_conv"), F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth"))
    before = None
    while True:
        up = reach.select(F.col("conv_id").alias("root_conv"), F.col("turn").alias("root_turn"), F.col("root_conv").alias("far_conv"), F.col("root_turn").alias("far_turn"), F.col("depth").alias("more"))
        further = reach.join(up, ["root_conv", "root_turn"], "left")
        # Where steps end, each round brings some to their roots; else all that are left lead into cycles.
        left = further.where("more is not null").count()
        if not left:
            return reach, None
        if left == before:
            return reach, parents.join(further.where("more is not null").select("conv_id", "turn"), ["conv_id", "turn"], "left_semi")
        before = left
        reach = written(further.select("conv_id", "turn", F.coalesce("far_conv", "root_conv").alias("root_conv"), F.coalesce("far_turn", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "reach")


def cycle_cuts(endless: DataFrame) -> DataFrame:
    """(conv_id, turn) of one message of each cycle: of its links across conversations the one of the smallest."""
    step = written(endless.select("conv_id", "turn", F.col("parent_conv").alias("to_conv"), F.col("parent_turn").alias("to_turn"), F.struct((1 - F.col("far")).alias("near"), "conv_id", "turn").alias("least")), "cycles")
    # After at least as many steps as there are messages, all stand on cycles and have seen all of theirs.
    for _ in range(step.count().bit_length()):
        on = step.select(F.col("conv_id").alias("to_conv"), F.col("turn").alias("to_turn"), F.col("to_conv").alias("then_conv"), F.col("to_turn").alias("then_turn"), F.col("least").alias("then_least"))
        step = written(step.join(on, ["to_conv", "to_turn"]).select("conv_id", "turn", F.col("then_conv").alias("to_conv"), F.col("then_turn").alias("to_turn"), F.least("least", "then_least").alias("least")), "cycles")
    inside = step.select(F.col("to_conv").alias("conv_id"), F.col("to_turn").alias("turn")).distinct()
    return step.join(inside, ["conv_id", "turn"]).select("least.conv_id", "least.turn").distinct()


def link_quotes(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, text (without quotes), n_quotes, n_linked,
    parent_conv, parent_turn, root_conv, root_turn, depth.

    Ordered by (root_conv, root_turn, depth, conv_id, turn) the rows are conversations in reply
    order. A message without a linked quote is its own root at depth 0. The earliest turn of each
    conversation that holds a passage stands for it, and inside a conversation it must come before
    the quoting message; of other conversations the one with the smallest conv_id stands. Where
    conversations quote each other in a circle, the message of the smallest (conv_id, turn) that
    quotes another conversation has no parent; its n_linked stays. Null texts stay null, messages
    with a null conv_id or turn neither quote nor are quoted; repeated rows give repeated results.
    Messages of any length are read whole, one Python string each.
    Other columns are ignored; an empty table gives an empty table.
    """
    parsed = written(parse_messages(messages), "messages")
    placed = parsed.where("conv_id is not null and turn is not null")
    quotes = placed.where("n_quotes > 0").select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.*").groupBy("conv_id", "turn", "hash").agg(F.min("level").alias("level"), F.bool_or("wide").alias("wide"))
    wanted = quotes.select("hash").distinct()
    said = placed.select("conv_id", "turn", F.explode("own").alias("o")).select("conv_id", "turn", "o.*").groupBy("conv_id", "hash").agg(F.min("turn").alias("said_turn"), F.min(F.when(F.col("wide"), F.col("turn"))).alias("wide_turn"))
    said = said.join(wanted, "hash", "left_semi")
    here = quotes.join(said, ["conv_id", "hash"]).where("said_turn < turn").select("conv_id", "turn", "hash", "level", F.col("conv_id").alias("said_conv"), "said_turn", F.lit(0).alias("far"))
    rest = quotes.where("wide").join(here.select("conv_id", "turn", "hash"), ["conv_id", "turn", "hash"], "left_anti")
    # The two first conversations of each passage: one of them is another than the quoting one.
    firsts = said.where("wide_turn is not null").withColumn("place", F.row_number().over(Window.partitionBy("hash").orderBy("conv_id"))).where("place <= 2")
    nth = lambda k: F.max(F.when(F.col("place") == k, F.struct(F.col("conv_id").alias("said_conv"), F.col("wide_turn").alias("said_turn"))))
    world = firsts.groupBy("hash").agg(nth(1).alias("one"), nth(2).alias("two"))
    there = rest.join(world, "hash").withColumn("s", F.when(F.col("one.said_conv") != F.col("conv_id"), F.col("one")).otherwise(F.col("two"))).where("s is not null").select("conv_id", "turn", "hash", "level", "s.said_conv", "s.said_turn", F.lit(1).alias("far"))
    best = F.min(F.struct("level", "far", (-F.col("said_conv")).alias("c"), (-F.col("said_turn")).alias("t")))
    linked = written(here.union(there).groupBy("conv_id", "turn").agg(best.alias("b"), F.count_distinct("hash").alias("n_linked")).select("conv_id", "turn", (-F.col("b.c")).alias("parent_conv"), (-F.col("b.t")).alias("parent_turn"), F.col("b.far").alias("far"), "n_linked"), "parents")
    parents = linked
    reach, endless = steps_to_roots(parents)
    if endless is not None:
        parents = written(parents.join(cycle_cuts(endless), ["conv_id", "turn"], "left_anti"), "parents")
        reach, _ = steps_to_roots(parents)
    links = linked.select("conv_id", "turn", "n_linked").join(parents.select("conv_id", "turn", "parent_conv", "parent_turn").join(reach, ["conv_id", "turn"]), ["conv_id", "turn"], "left")
    out = parsed.drop("own", "quoted", "levels").join(links, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "text", "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "parent_conv", "parent_turn", F.coalesce("root_conv", "conv_id").alias("root_conv"), F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))
