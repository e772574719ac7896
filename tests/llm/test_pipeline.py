"""Every stage of the pipeline against brute force on what its predecessor kept."""

import collections
import random
import zlib

import corpus_pipeline
from tarnwood.llm.entries import tokenizer_path
from tarnwood.llm.mixing import targets
from tests.llm.test_text_operators import brute_components, brute_quality, luhn, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_kept(t):
    n, chars, symbols, dup, repeat = brute_quality(t)
    upper, letters = sum("A" <= c <= "Z" for c in t), sum(c.isascii() and c.isalpha() for c in t)
    with_letter = sum(any(c.isascii() and c.isalpha() or ord(c) > 127 for c in w) for w in words(t))
    return not (
        n < 50 or 100 * repeat > 50 * n or 10 * symbols > 2 * n or chars < 2 * n or chars > 15 * n or 10 * upper > 3 * letters
        or 10 * t.count("!") > 2 * n or (dup >= 3 and 10 * dup > 3 * (t.count("\n") + 1)) or 10 * with_letter < 6 * n
    )


def documents():
    rng = random.Random(9)
    vocab = [f"{a}{b}" for a in ("lorem", "ipsum", "dolor", "sit", "amet") for b in range(60)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(60, 300))) for _ in range(50)]
    for k in range(12):
        w = texts[k].split()
        w[rng.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    texts += texts[:8] + [None, "", "short", "!!! " * 80, "SHOUTING LOUD WORDS " * 40, "same line again\n" * 60]
    texts[3] += " call 4465758382889437 or ann@mail.example.com on 2024-02-29"
    return [(i, t, "en", [None, "s1", "s2", "s1"][i % 4], len(t or "")) for i, t in enumerate(texts)]


def test_stages(spark, tmp_path):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    tables, left = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, left, "").write.parquet(str(tmp_path / name))
        left = tables[name] = spark.read.parquet(str(tmp_path / name))
    found = {name: [tuple(r) for r in t.collect()] for name, t in tables.items()}

    good = sorted(found["quality_rules"])
    assert good == [r for r in rows if brute_kept(r[1] or "")] and 50 < len(good) < len(rows)

    _, top = brute_components([r[1] for r in good], 5, 80)
    single = sorted(found["jaccard_join"])
    assert single == [r for k, r in enumerate(good) if top[k] == k] and len(single) < len(good)

    clean = sorted(found["pii"])
    assert [r[0] for r in clean] == [r[0] for r in single]
    for before, after in zip(single, clean):
        assert after[2:4] == before[2:4] and after[4] == len(after[1])
        assert (after[1] != before[1]) == (before[0] == 3)
    tail = next(r[1] for r in clean if r[0] == 3).split()[-5:]
    assert luhn(tail[0]) and tail[0] != "4465758382889437" and tail[2].endswith("@mail.example.com") and tail[2] != "ann@mail.example.com" and tail[4] != "2024-02-29"

    copies, sizes, taken = collections.Counter(r[0] for r in found["mixing"]), collections.Counter(), collections.Counter()
    assert set(found["mixing"]) <= set(clean) and max(copies.values()) <= 2
    for r in clean:
        sizes[r[3]] += len(words(r[1]))
        taken[r[3]] += copies[r[0]] * len(words(r[1]))
    for source, aim in targets(dict(sizes)).items():
        assert abs(taken[source] - aim) <= 600

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = collections.Counter()
    for r in found["mixing"]:
        ids = tokenizer.encode(r[1], add_special_tokens=False).ids + [2]
        want[r[0]] += len(ids)
    pieces = [r.asDict() for r in tables["packing"].collect()]
    got, held = collections.Counter(), collections.defaultdict(list)
    for p in pieces:
        got[p["doc_id"]] += p["length"]
        held[p["sequence_id"]].append(p)
        ids = tokenizer.encode(next(r[1] for r in clean if r[0] == p["doc_id"]), add_special_tokens=False).ids + [2]
        part = ids[p["start"] : p["start"] + p["length"]]
        assert p["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)) and p["doc_tokens"] == len(ids)
    assert got == want
    for parts in held.values():
        ends = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == ends
            ends += p["length"]
        assert ends <= 4096


def test_near_copies_at_the_edge_and_repeated_rows(spark):
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    edit = lambda t, *at: " ".join("edited%d" % k if k in at else w for k, w in enumerate(t.split()))
    edge, under, again, none, mixed = text(49), text(48), text(60), text(60), text(60)
    rows = [(1, edge), (2, edit(edge, 20)), (3, under), (4, edit(under, 20)), (5, again), (5, again), (5, again)]
    rows += [(None, none), (None, none), (None, mixed), (6, mixed), (7, text(60)), (7, text(60)), (8, ""), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    left = corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == sorted([(0, none), (1, edge), (3, under), (4, edit(under, 20)), (5, again), (6, mixed), *((i, t or "") for i, t in rows[-4:])])
