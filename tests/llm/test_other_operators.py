"""Operators over vectors, pages and conversations against brute force."""

import gzip
import hashlib
import math
import random
import re
import zlib

import numpy as np

from tarnwood.llm import quotes, urlfilter, vectors, warc
from tarnwood.llm.shared import new_folder

from tests.llm.test_text_operators import find_components


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * 0.25).astype(np.float32).tolist(), 1) for i in range(300)]
    rows += [(300, rows[0][1], 1), (301, [2 * x for x in rows[0][1]], 2), (302, None, 1), (303, [0.0] * 16, 1), (304, [float("nan")] + [1.0] * 15, 1), (305, [], 1), (306, [None] + [1.0] * 15, 1), (307, [1.0, 2.0], 1), (308, [2.0, 4.0], 1), (309, [float("inf")] + [1.0] * 15, 0)]
    links = []
    ok = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if ok(x) and ok(y) and len(x) == len(y):
                x, y = np.array(x), np.array(y)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.9:
                    links.append((a, b))
    want = find_components(len(rows), links)
    counts = [0] * len(rows)
    for a, b in links:
        counts[a] += 1
        counts[b] += 1
    for block, sub, real in ((None, (512, 2048), "float"), (40, (16, 7), "double")):
        got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<{real}>, n_links int"), block=block, sub=sub).collect()}
        assert [got[i].component_id for i in range(len(rows))] == want
        assert [got[i].n_links for i in range(len(rows))] == counts
        assert all(got[i].kept == (want[i] == i) for i in range(len(rows)))
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    # Null and repeated ids, ties at the threshold.
    odd = [(None, [1.0, 0.0]), (None, [1.0, 0.0]), (None, [0.0, 1.0]), (4, [-1.0, 0.0]), (4, [0.0, -1.0]), (7, [-2.0, 0.0]), (3, [-1.0, 0.1])]
    got = vectors.near_vectors(spark.createDataFrame(odd, "vec_id long, embedding array<double>"))
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got.collect()) == [(0, 0, 0, True), (0, 1, 0, False), (0, 1, 0, False), (3, 2, 3, True), (4, 0, 4, True), (4, 2, 3, False), (7, 2, 3, False)]


def test_blocks_bound_every_link(spark):
    """Vectors in few dimensions, where most block pairs fall out, against all pairs."""
    rng = np.random.default_rng(5)
    m = rng.normal(size=(1500, 3)) + np.array([0.3, 0, 0])
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    links = (unit @ unit.T >= 0.999).sum(axis=1) - 1
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), least=0.999, block=20).collect()}
    assert [got[i].n_links for i in range(len(rows))] == links.tolist() and links.sum() > 500
    tree = vectors.Blocks.fit(vectors._points(unit, np.eye(3)), 64)
    counts = np.bincount(tree.place(vectors._points(unit, np.eye(3))), minlength=64)
    assert counts.sum() == 1500 and counts.max() < 40


PAGES = "page_id long, url string, html string, record_type int"


def test_warc_round_trip(spark):
    long = "<p>é" * 60
    rows = [(5, "http://a/ b\r\nX: y", long, 1), (3, "http://a", long, 1), (9, None, long, 1), (1, "u", "short", 1), (2, "u", "short", 1), (4, "u", None, 1), (6, "u", "WARC/1.1\r\n" * 30, 1), (7, "u", "", 1)]
    for compressed in (True, False):
        path = new_folder(spark, "archives")
        warc.write_warc(spark.createDataFrame(rows, PAGES), path, compressed=compressed)
        records = warc.read_warc(spark, path)
        got = {r.page_id: r for r in warc.page_records(records).collect()}
        assert records.where("kind = 'gap'").count() == 0 and len(got) == len(rows)
        for i, _, html, _ in rows:
            raw = (html or "").encode()
            assert got[i].payload_bytes == len(raw) and got[i].payload_digest == hashlib.sha256(raw).hexdigest()
            assert (got[i].record_type, got[i].refers_to) == (("revisit", 3) if i in (5, 9) else ("response", None))
        payloads = {bytes(r.payload) for r in records.where("record_type = 'response'").select("payload").collect()}
        assert payloads == {(h or "").encode() for _, _, h, _ in rows}
        # Any reader of gzip sees the same archive.
        files = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(path + "/*.txt").select("content").collect())
        assert (gzip.decompress(files) if compressed else files).count(b"WARC-Record-ID") == len(rows)
    empty = new_folder(spark, "archives")
    warc.write_warc(spark.createDataFrame([], PAGES), empty)
    assert warc.read_warc(spark, empty).count() == 0


def record(k, payload):
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r:{k}>\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


def test_salvage_recovers_later_records():
    rng = random.Random(2)
    for packed in (False, True):
        raw = [record(k, bytes(rng.randrange(256) for _ in range(300)) + b"\nWARC/1.1\r\n") for k in range(12)]
        members = [gzip.compress(r) if packed else r for r in raw]
        for _ in range(30):
            hurt, data, clean = rng.randrange(12), [], []
            for k, m in enumerate(members):
                if k == hurt:
                    at = rng.randrange(len(m))
                    m = m[:at] + (b"" if rng.random() < 0.5 else bytes([m[at] ^ 0xFF])) + m[at + 1 :]
                else:
                    clean.append(k)
                data.append(m)
            rows = list(warc.salvage(b"".join(data)))
            ids = [int(r[3]["warc-record-id"][3:-1]) for r in rows if r[0] == "record" and r[3].get("warc-record-id", "").startswith("<r:") and r[3]["warc-record-id"][3:-1].isdigit()]
            assert set(clean) <= set(ids)
            assert len(rows) - len(ids) <= 1
            at = 0
            for r in rows:
                assert r[1] == at
                at += r[2]
            assert at == len(b"".join(data))


def salvaged(data):
    rows = list(warc.salvage(data))
    return [int(r[3]["warc-record-id"][3:-1]) for r in rows if r[0] == "record"], [r for r in rows if r[0] == "gap"]


def test_salvage_keeps_what_passes_around_damage(spark):
    rng = random.Random(7)
    raw = [record(k, bytes(rng.randrange(256) for _ in range(3000))) for k in range(60)]
    # A header of more than 1 MiB.
    rows = [(1, "http://a/" + "x" * (2 << 20), "long url", 1), (2, "u", "other", 1)]
    path = new_folder(spark, "archives")
    warc.write_warc(spark.createDataFrame(rows, PAGES), path)
    records = warc.read_warc(spark, path)
    assert sorted(r.page_id for r in warc.page_records(records).collect()) == [1, 2] and records.where("kind = 'gap'").count() == 0
    # One member of many records: one of them bad, the member cut, a byte of the stream hurt.
    bad = [*raw[:20], raw[20].replace(b"sha256:", b"sha256:0"), *raw[21:]]
    ids, gaps = salvaged(gzip.compress(b"".join(bad)) + gzip.compress(raw[0]))
    assert ids == [*range(20), *range(21, 60), 0] and [g[2:] for g in gaps] == [(0, "payload digest differs")]
    whole = gzip.compress(b"".join(raw))
    for after in (b"", gzip.compress(raw[59])):
        cut = whole[: len(whole) // 2]
        ids, gaps = salvaged(cut + after)
        n = len(ids) - bool(after)
        assert ids == [*range(n), *([59] if after else [])] and 28 <= n <= 30 and len(gaps) == 1
    hurt = whole[:-8] + bytes([whole[-8] ^ 1]) + whole[-7:]
    ids, gaps = salvaged(hurt)
    assert ids == list(range(60)) and len(gaps) == 1
    # A record cut inside its payload, and the next one at once behind it.
    ids, gaps = salvaged(record(1, b"cut" * 100)[:-100] + record(2, b"intact") + record(3, b"too"))
    assert ids == [2, 3] and len(gaps) == 1


def test_salvage_of_large_files_is_linear_and_bounded():
    import resource
    import time

    rng = random.Random(3)
    # 100 MB of members, then a member of one record more than a hundred times its size.
    noise = [rng.randbytes(14_000) for _ in range(50)]
    members = [gzip.compress(record(k, noise[k % 50]), 1) for k in range(7000)]
    data = b"".join(members)
    began = time.perf_counter()
    assert sum(r[0] == "record" for r in warc.salvage(data)) == 7000
    plain = time.perf_counter() - began
    assert plain < 30, plain
    # A bomb of nothing but zeros between two records of one member: it is read through, not held.
    packer = zlib.compressobj(9, zlib.DEFLATED, 31)
    zeros = bytes(1 << 20)
    bomb = packer.compress(record(1, b"before"))
    for _ in range(600):
        bomb += packer.compress(zeros)
    bomb += packer.compress(record(2, b"behind")) + packer.flush()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    ids, gaps = salvaged(bomb + members[0])
    assert ids == [1, 2, 0] and len(gaps) == 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000


def brute_url(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        rest = rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    best = None
    for verdict, h, p in urlfilter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, *(best or (None, "allow"))


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/7?x#y", "http://a.com/en/", "http://com/en/1", "https://xcom/en/1", "http://example.com/en/8", "http://b.example.net/de/8", "http://b.example.net/de/9", "http://c.net#/de/", "http://x.org/es", "http://x.org/es/\n9", "a://b://c.org/es/", "http://example.com/en/7"]
    rng = random.Random(6)
    urls += [f"http://{rng.choice(['www.', '', 'm.'])}h{rng.randrange(500)}.{rng.choice(['example.', ''])}{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'es'])}/{rng.randrange(100)}" for _ in range(400)]
    rows = [(i, u, "x") for i, u in enumerate(urls)]
    for rate, most in ((None, 1 << 29), (0.5, 1 << 29), (0.5, 2)):  # level 1 as planned; too small, so that more follow; several cascades
        got = {r.page_id: r for r in urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), rate=rate, most_bits=most).collect()}
        for i, u in enumerate(urls):
            assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == brute_url(u), u
    assert urlfilter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(4000).selectExpr("concat('k', id) as key")
    universe = universe.union(universe.where("key = 'k5'").crossJoin(spark.range(3000)).select("key"))
    listed = universe.where("cast(substring(key, 2) as int) % 7 = 0").union(spark.createDataFrame([(None,)], "key string"))
    wrong = lambda made: universe.where(urlfilter.member(universe.key, made) != (universe.key.substr(2, 9).cast("int") % 7 == 0)).count()
    levels = urlfilter.build_cascades({"a": listed, "none": listed.limit(0)}, universe, 4000, rate=0.5)
    assert len(levels["a"]) > 3 and levels["none"] == [] and wrong(levels["a"]) == 0
    planned = urlfilter.build_cascades({"a": listed}, universe, 4000)["a"]
    assert wrong(planned) == 0 and len(planned[1].bits) < 2 * len(planned[0].bits) and sum(len(x.bits) for x in planned) < sum(len(x.bits) for x in levels["a"])


def test_quotation_links(spark):
    first = "The first message says something long enough."
    rows = [
        (1, 0, "user", first, 0),
        (1, 1, "assistant", "On Monday Ann wrote:\n> the first  message says something LONG enough.\nI agree with that statement.", 0),
        (1, 2, "user", "> > " + first + "\n> I agree with that statement.\nThen all is well, dear friend.", 0),
        (1, 3, "user", "no quotes at all here", 0),
        (2, 0, "user", "> " + first + "\nFrom another thread.", 0),
        (2, 1, "user", "> never said by anyone anywhere\nok", 0),
        (3, 0, None, None, 0),
        (None, 0, "user", "> " + first, 0),
        (3, 1, "user", "", 0),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int")).collect()}
    see = lambda c, t: (got[c, t].parent_conv, got[c, t].parent_turn, got[c, t].root_conv, got[c, t].root_turn, got[c, t].depth)
    assert len(got) == len(rows)
    assert see(1, 1) == (1, 0, 1, 0, 1) and got[1, 1].text == "I agree with that statement."
    assert see(1, 2) == (1, 1, 1, 0, 2) and got[1, 2].n_linked == 2
    assert see(1, 3) == (None, None, 1, 3, 0)
    assert see(2, 0) == (1, 0, 1, 0, 1) and see(2, 1) == (None, None, 2, 1, 0) and got[2, 1].text == "ok"
    assert got[3, 0].text is None and got[3, 1].text == ""
    assert quotes.link_quotes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_quotation_links_in_both_directions(spark):
    rows = [
        (9, 0, "user", "only conversation nine says this"),
        (5, 0, "user", "> only conversation nine says this\nfive answers nine here"),
        (6, 0, "user", "two lines stand here\nok, agreed"),
        (6, 1, "user", "> ok, agreed\nfine then"),
        (7, 0, "user", "> ok, agreed\nnobody said so in seven"),
        # A circle of three conversations, and one message that leads into it.
        (20, 0, "user", "> words of twenty-two\nwords of twenty here"),
        (21, 0, "user", "> words of twenty here\nwords of twenty-one"),
        (22, 0, "user", "> words of twenty-one\nwords of twenty-two"),
        (23, 0, "user", "> words of twenty-two\nwords of twenty-three"),
        # Said later in the own conversation and earlier in another one.
        (30, 0, "user", "> these words come later here\nfirst of thirty"),
        (30, 1, "user", "these words come later here"),
        (31, 0, "user", "these words come later here"),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    see = lambda c, t: (got[c, t].parent_conv, got[c, t].parent_turn, got[c, t].root_conv, got[c, t].root_turn, got[c, t].depth)
    assert len(got) == len(rows)
    assert see(5, 0) == (9, 0, 9, 0, 1) and see(6, 1) == (6, 0, 6, 0, 1) and see(7, 0) == (None, None, 7, 0, 0)
    assert [see(c, 0) for c in (20, 21, 22, 23)] == [(None, None, 20, 0, 0), (20, 0, 20, 0, 1), (21, 0, 20, 0, 2), (22, 0, 20, 0, 3)] and got[20, 0].n_linked == 1
    assert see(30, 0) == (31, 0, 31, 0, 1)


def brute_links(rows):
    """Parent, number of linked passages, root and depth of each (conv, turn), by looking at all messages for each."""
    tidy = lambda t: " ".join(t.casefold().split())

    def pieces(text):
        """Whole text, paragraphs and lines; true for those that may link to other conversations."""
        out = {}
        for k, p in enumerate([text, *re.split(r"\n\s*\n", text), *text.split("\n")]):
            if tidy(p):
                out[tidy(p)] = out.get(tidy(p), False) or k == 0 or len(tidy(p)) >= 12
        return out

    own, quoted = {}, {}
    for c, t, _, text in rows:
        clean, passages = quotes.split_quotes(text) if text is not None else ("", [])
        own.setdefault((c, t), {}).update(pieces(clean))
        for level, p in passages:
            for piece, wide in pieces(p).items():
                was = quoted.setdefault((c, t), {}).get(piece, (level, False))
                quoted[c, t][piece] = (min(level, was[0]), wide or was[1])
    parent, linked = {}, {}
    for at, found in quoted.items():
        options = []
        for piece, (level, wide) in found.items():
            here = [m for m in own if m[0] == at[0] and piece in own[m]]
            if here and min(here)[1] < at[1]:
                options.append((level, 0, *(-x for x in min(here))))
            elif wide and (there := [m for m in own if m[0] != at[0] and own[m].get(piece)]):
                options.append((level, 1, *(-x for x in min(there))))
        if options:
            linked[at], (_, _, c, t) = len(options), min(options)
            parent[at] = (-c, -t)
    for start in sorted(parent):
        path = [start]
        while path[-1] in parent and parent[path[-1]] not in path:
            path.append(parent[path[-1]])
        if path[-1] in parent:
            circle = path[path.index(parent[path[-1]]) :]
            del parent[min(m for m in circle if parent[m][0] != m[0])]
    out = {}
    for at in own:
        root, depth = at, 0
        while root in parent:
            root, depth = parent[root], depth + 1
        out[at] = (parent.get(at), linked.get(at, 0), root, depth)
    return out


def test_quotation_links_of_whole_conversations(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rng = random.Random(6)
    said = ["short", "these words are said by many", "another passage of some length", "a third one, of other words", "and a last one to quote here"]
    for c in range(10_000, 10_060):  # conversations that quote themselves and each other, some in circles
        for t in range(rng.randrange(1, 5)):
            quote = [">" * rng.randrange(1, 3) + " " + rng.choice(said) + rng.choice(["", f" {rng.randrange(40)}"]) for _ in range(rng.randrange(3))]
            rows.append((c, t, "user", "\n".join([*quote, rng.choice(said) + rng.choice(["", f" {rng.randrange(40)}"])])))
    rows.append((10_060, 0, "user", "> these words are said by many\n" + "long " * 500_000))
    want = brute_links(rows)
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        parent = (r.parent_conv, r.parent_turn) if r.parent_conv is not None else None
        assert (parent, r.n_linked, (r.root_conv, r.root_turn), r.depth) == want[r.conv_id, r.turn], r
    assert sum(r.n_linked > 0 for r in got) > 60 and max(r.depth for r in got) > 1


def test_nested_levels():
    own, passages = quotes.split_quotes("a\n> b\n>> c\n> d\n\ne")
    assert own == "a\n\ne" and passages == [(1, "b"), (2, "c"), (1, "d")]
