"""URL rules looked up in a Bloom filter cascade, with DataFrame functions only.

Level 1 encodes the listed keys. Level 2 encodes those keys of the corpus's complete universe that
level 1 takes for listed by mistake, level 3 the listed keys that level 2 takes for such, and so on
until a level makes no mistake. Every key that occurs in the corpus then gets its exact answer from
bit tests alone: no join with the list. Level 1 is sized by how many keys of the universe there are
for each listed one, so that level 2 stays as small as the list; from there each level halves.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwood.llm.shared import written

#: (verdict, host, path prefix)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
_MOST_BITS = 1 << 29
_CHUNK = 512


@dataclass(frozen=True)
class Level:
    bits: bytes
    hashes: int
    seed: int


def _positions(key: Column, size: int, hashes: int, seed: int) -> list[Column]:
    a, b = F.xxhash64(F.lit(seed), key), F.xxhash64(F.lit(seed + 7919), key)
    return [F.pmod(F.pmod(a, F.lit(size)) + i * F.pmod(b, F.lit(size)), F.lit(size)) for i in range(hashes)]


def _hit(key: Column, level: Level) -> Column:
    """True where every bit of the key is set in the level's bitmap."""
    bitmap, found = F.lit(level.bits), F.lit(True)
    for at in _positions(key, 8 * len(level.bits), level.hashes, level.seed):
        byte = F.conv(F.hex(F.substring(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        found = found & (F.expr("1") == F.call_function("getbit", byte, (at % 8).cast("int")))
    return found


def member(key: Column, levels: list[Level]) -> Column:
    """True where the key is listed; exact for keys of the universe the cascade was built over."""
    answer = F.lit(len(levels) % 2 == 1)
    for k in range(len(levels) - 1, -1, -1):
        answer = F.when(_hit(key, levels[k]), answer).otherwise(F.lit(k % 2 == 1))
    return answer


def _level(keys: DataFrame, n: int, seed: int, rate: float) -> Level:
    """Bitmap of ``n`` keys that takes about the share ``rate`` of others for its own."""
    hashes = max(1, round(-math.log2(rate)))
    size = max(64, -(-int(n * hashes / math.log(2)) // 8) * 8)
    places = keys.select(F.explode(F.array(*_positions(F.col("key"), size, hashes, seed))).alias("at"))
    on = F.bit_or(F.expr("cast(shiftleft(1, cast(at % 8 as int)) as int)"))
    byte = places.groupBy(F.floor(F.col("at") / (8 * _CHUNK)).alias("chunk"), (F.floor(F.col("at") / 8) % _CHUNK).cast("int").alias("byte")).agg(on.alias("on"))
    # Tasks put the bytes together; a chunk of the bitmap is one row of 512 bytes.
    spelt = f"unhex(array_join(transform(sequence(0, {_CHUNK - 1}), i -> lpad(hex(coalesce(try_element_at(m, i), 0)), 2, '0')), ''))"
    chunks = byte.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("byte", "on"))).alias("m")).select("chunk", F.expr(spelt).alias("bytes"))
    bitmap = bytearray(-(-size // (8 * _CHUNK)) * _CHUNK)
    for r in chunks.collect():
        bitmap[r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] = r["bytes"]
    return Level(bytes(bitmap[: size // 8]), hashes, seed)


def _listed(levels: list[Level], dealt, part: int):
    """Test of a key for one cascade; with ``dealt`` only of keys that go to ``part``."""
    if dealt is None:
        return lambda k: member(k, levels)
    return lambda k: (dealt(k) == part) & member(k, levels)


def first_rate(listed: int, universe: int) -> float:
    """False positive rate of level 1 at which level 2 encodes about 0.7 keys for each listed one."""
    return min(0.5, math.sqrt(0.5) * max(1, listed) / max(1, universe))


def build_cascades(lists: dict[str, DataFrame], universe: DataFrame, n_universe: int, rate: float | None = None) -> dict[str, list[Level]]:
    """Levels for the keys of each list over all keys of ``universe`` (column ``key``), of which there are about ``n_universe``.

    The universe is read once for all lists: keys that some level 1 takes for listed are written, each
    once, and all further levels are built from those. Only bitmaps come to the driver, about
    log2(n_universe / listed) bits for each listed key. Null keys are not encoded, repeated keys count
    once. An empty list gives no level, and then nothing is a member. ``rate`` sets the rate of level 1.
    """
    lists = {name: keys.where("key is not null").select("key").distinct() for name, keys in lists.items()}
    counted = {name: (keys, keys.count()) for name, keys in lists.items()}
    levels = {name: [_level(keys, n, 1_000_003, rate or first_rate(n, n_universe))] if n else [] for name, (keys, n) in counted.items()}
    hits = [_hit(F.col("key"), made[0]) for made in levels.values() if made]
    if not hits:
        return levels
    some = hits[0]
    for h in hits[1:]:
        some = some | h
    taken = written(universe.select("key").where(some).distinct(), "taken")
    for name, made in levels.items():
        if not made:
            continue
        yes = counted[name][0]
        no = taken.where(_hit(F.col("key"), made[0])).join(yes, "key", "left_anti")
        while True:
            keys = no if len(made) % 2 else yes
            n = keys.count()
            if not n:
                break
            made.append(_level(keys, n, 1_000_003 * (len(made) + 1), 0.5))
            if len(made) % 2:
                no = no.where(_hit(F.col("key"), made[-1]))
            else:
                yes = yes.where(_hit(F.col("key"), made[-1]))
    return levels


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where there is no ``://``."""
    rest = F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_keys(lengths: list[int]) -> Column:
    """All keys that could match: each suffix of the host at a dot with each prefix of the path."""
    cut = ", ".join(map(str, lengths))
    suffixes = "transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))"
    prefixes = f"transform(filter(array({cut}), n -> n <= length(path)), n -> substring(path, 1, n))"
    return F.expr(f"flatten(transform({suffixes}, s -> transform({prefixes}, p -> concat(s, p))))")


def judge_urls(pages: DataFrame, rules=RULES, rate: float | None = None, most_bits: int = _MOST_BITS) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    Of the rules that fit, the longest wins (at equal length the one with the longer host, which
    comes first among a page's keys). Where none fits, ``rule`` is null and the verdict is what the
    cascades say of a URL without a listed key: allow. Null and malformed urls have empty host and
    path; long ones are taken whole. A bitmap stands in the plan, so lists whose level 1 needs more
    than ``most_bits`` are dealt by hash to several cascades, looked up one after the other. Result
    columns replace input columns of the same name; rows that repeat, have a null page_id or an odd
    url stay; an empty table gives an empty table.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    rows = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    lengths = sorted({len(p) for _, _, p in rules})
    none = F.array().cast("array<string>")
    rows = rows.withColumn("_keys", rule_keys(lengths) if lengths else none).withColumns({"_blocked": none, "_allowed": none})
    # Of the order of the keys of all pages; it sizes bitmaps and decides nothing.
    n_universe = pages.count() * 4 * max(1, len(lengths))
    most = max((sum(v == verdict for v, _, _ in rules) for verdict in ("block", "allow")), default=0)
    parts = max(1, math.ceil(most * -math.log2(rate or first_rate(most, n_universe)) / math.log(2) / most_bits))
    dealt = lambda key: F.pmod(F.xxhash64(F.lit(-1), key), F.lit(parts))
    for part in range(parts):
        lists = {v: spark.createDataFrame([(h + p,) for x, h, p in rules if x == v], "key string") for v in ("block", "allow")}
        universe = rows.select(F.explode("_keys").alias("key"))
        if parts > 1:
            lists, universe = {v: keys.where(dealt(F.col("key")) == part) for v, keys in lists.items()}, universe.where(dealt(F.col("key")) == part)
        cascades = build_cascades(lists, universe, n_universe // parts, rate)
        for name, verdict in (("_blocked", "block"), ("_allowed", "allow")):
            rows = rows.withColumn(name, F.concat(name, F.filter("_keys", _listed(cascades[verdict], dealt if parts > 1 else None, part))))
        if parts > 1:
            rows = written(rows, "judged")
    longest = "aggregate(concat(_blocked, _allowed), cast(null as string), (a, k) -> if(a is null or length(k) > length(a), k, a))"
    rows = rows.withColumn("rule", F.expr(longest))
    verdict = F.when(F.array_contains("_blocked", F.col("rule")), "block").otherwise("allow")
    return rows.withColumn("verdict", F.coalesce(verdict, F.lit("allow"))).drop("_keys", "_blocked", "_allowed")
