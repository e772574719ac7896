"""Operators over documents against brute force in plain Python."""

import collections
import datetime
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tarnwood.llm import jaccard, mixing, packing, pii, pitman_yor, quality
from tarnwood.llm.components import connected_components
from tarnwood.llm.entries import tokenizer_path
from tarnwood.llm.shared import few_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, source string, kept int, n_replaced string"


def corpus():
    rng = random.Random(3)
    vocab = ["alpha", "Beta,", "gamma.", "δέλτα", "the", "of", "x", "naïve", "end!"]
    texts = [None, "", " \t\n ", "one", "one two three", "one two three", "a b a b a b a b\na b a b\na b a b\n\n", "ÀB\u00a0C d\r\ne"]
    base = [" ".join(rng.choice(vocab) + str(rng.randrange(40)) for _ in range(n)) for n in (60, 80, 120, 400)]
    texts += base + base[:2]
    for b in base:
        for edits in (1, 2, 3, 6, 12):
            words = b.split()
            for _ in range(edits):
                words[rng.randrange(len(words))] = "changed%d" % rng.randrange(9)
            texts.append(" ".join(words))
    texts.append("#### $$$ %% " * 30)
    texts.append("word " * 3000)
    return [(i, t, [None, "s1", "s2"][i % 3], 7, "x") for i, t in enumerate(texts)]


def words(t):
    return WORD.findall((t or ""))


def find_components(n, links):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return [top(x) for x in range(n)]


def shingle_set(t, width):
    w = words((t or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def brute_components(texts, width, percent):
    """Index of the smallest linked row of each row."""
    sets = [shingle_set(t, width) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return [len(s) for s in sets], find_components(len(sets), links)


def test_jaccard_components(spark, monkeypatch):
    rows = corpus()
    long = " ".join(f"Word{i * 7919 % 50021}" for i in range(300_000))  # beyond what one array call takes
    rows += [(len(rows), long, "", 0, ""), (len(rows) + 1, long[9:-9], "", 0, "")]
    sizes, want = brute_components([r[1] for r in rows], 4, 85)
    for group, tile in ((1 << 20, (2048, 65536)), (100, (5, 9))):
        monkeypatch.setattr(jaccard, "_GROUP_SHINGLES", group)
        monkeypatch.setattr(jaccard, "_TILE_ROWS", tile)
        got = {r.doc_id: r for r in jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA), width=4, percent=85).collect()}
        assert [got[i].component_id for i in range(len(rows))] == want
        assert [got[i].n_shingles for i in range(len(rows))] == sizes
    assert len(set(want)) < len(want) - 8 and want[-1] == len(rows) - 2


def test_jaccard_compares_rows_not_ids(spark):
    """Null and repeated ids, in every order of the rows."""
    rng = random.Random(8)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(90))
    t, u, v, none = text(), text(), text(), text()
    near = lambda x: x.replace(x.split()[40], "edited")
    rows = [(None, t), (5, t), (7, t), (9, near(t)), (1, v), (1, u), (2, near(v)), (3, near(u)), (None, none), (None, near(none)), (1, v), (None, None), (None, ""), (4, ""), (6, "A b"), (8, "a B")]
    for order in (rows, rows[::-1], rng.sample(rows, len(rows))):
        sizes, top = brute_components([x for _, x in order], 4, 85)
        ids = [[i for k, (i, _) in zip(top, order) if k == c and i is not None] for c in top]
        want = sorted((i or -1, n, min(c) if c else -1) for (i, _), n, c in zip(order, sizes, ids))
        got = jaccard.jaccard_components(spark.createDataFrame(order, "doc_id long, text string").repartition(3), width=4, percent=85).collect()
        assert sorted((r.doc_id or -1, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == want


def test_jaccard_empty(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 200)] + [(7, 7), (500, 500), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[k] == 100 for k in range(100, 200)) and got[500] == 500


def brute_quality(t):
    w = words(t)
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    windows = collections.defaultdict(list)
    for i in range(len(w) - 2):
        windows[tuple(w[i : i + 3])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_base(spark):
    rows = corpus()
    got = {r.doc_id: r for r in quality.quality_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    for r in rows:
        want = brute_quality(r[1])
        assert tuple(got[r[0]][k] for k in quality.BASE) == want, r
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert got[r[0]].base_failed == failed and not (failed and got[r[0]].kept)


def test_quality_verdict_does_not_depend_on_order(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    names = list(quality.RULES)
    kept = [{r.doc_id: r.kept for r in quality.quality_cascade(docs, rules=o).collect()} for o in (names, names[::-1])]
    assert kept[0] == kept[1]
    assert quality.quality_cascade(spark.createDataFrame([], SCHEMA)).count() == 0


def test_packing_round_trip(spark):
    rows = corpus()
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    pieces = packing.pack_documents(spark.createDataFrame(rows, SCHEMA), path, window=256).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]
        at = 0
        for p in sorted(by_doc[r[0]], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 256 or at & (at - 1) == 0
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), path).count() == 0


def test_packing_of_added_tokens(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["one <|endoftext|> two", "plain text", "", None, "A<|startoftext|>b<|endoftext|>", "<|ENDOFTEXT|> x <|endoftext|", "<|end", "oftext|> é", "again <|endoftext|>\n<|endoftext|> Ü"]
    assert tokenizer.encode(texts[0], add_special_tokens=False).ids == [637, 49407, 1237]
    pieces = packing.pack_documents(spark.createDataFrame([(i, t, "", 0, "") for i, t in enumerate(texts)], SCHEMA).coalesce(1), path, window=1 << 12).collect()
    found = collections.defaultdict(list)
    for p in pieces:
        found[p.doc_id].append(p)
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        assert sum(p.length for p in found[i]) == len(ids)
        for p in found[i]:
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[p.start : p.start + p.length]))


def test_encoder_hands_over_few_texts_at_a_time(monkeypatch):
    """The tokenizer keeps much more than ids of each text it has at once."""
    encoder, sizes = packing.WordEncoder(tokenizer_path()), []

    class Counted:
        def encode_batch_fast(self, texts, **how):
            sizes.append(len(texts))
            return whole.encode_batch_fast(texts, **how)

    texts = [f"word{k} other{k * k}" for k in range(6000)]
    whole = encoder.tokenizer
    want = [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    monkeypatch.setattr(encoder, "tokenizer", Counted())
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    flat, first = encoder.encode(data, np.cumsum([0, *map(len, texts)]))
    assert max(sizes) <= 8 and [flat[a:b].tolist() for a, b in zip(first, first[1:])] == want


def test_few_rows_need_no_python_workers(spark):
    kind = T.StructType([T.StructField("k", T.LongType()), T.StructField("s", T.StringType()), T.StructField("x", T.DoubleType())])
    for rows in ([(1, "a", 0.5), (None, None, None)], [(2, None, 1.0)], []):
        got = few_rows(spark, rows, kind)
        assert [tuple(r) for r in got.collect()] == rows and got.schema == kind
    plans = [mixing.mix_sources(spark.createDataFrame(pa.table({"doc_id": [1], "source": ["a"], "size": [3]}))), pii.pseudonymise(spark.createDataFrame(pa.table({"text": ["a@b.org"]})), "key")]
    assert not any("ExistingRDD" in d._jdf.queryExecution().executedPlan().toString() for d in plans)


def test_level_packer_places_by_sum_of_squares():
    """Every placement against all levels, over many pieces and small windows."""
    import numpy as np

    rng = random.Random(4)
    for full in (7, 16, 64):
        packer, total, done = packing.LevelPacker(full), 0, 0
        for k in range(400):
            rest = rng.randrange(1, full)
            total += rest
            before = packer.count.copy()
            held = packer.place(packing.Piece(k, 0, rest, np.zeros(rest, np.uint32)))
            done += sum(len(p.ids) for p in held or [])
            assert held is None or sum(len(p.ids) for p in held) == full
            options = []
            for h in range(0, full + 1 - rest):
                if h == 0 or before[h]:
                    c = before.copy()
                    c[h] -= h > 0
                    if h + rest < full:
                        c[h + rest] += 1
                    options.append(int((c**2).sum()))
            assert int((packer.count**2).sum()) == min(options)
        left = packer.left()
        assert sorted(sum(len(p.ids) for p in w) for w in left) == np.repeat(np.arange(full + 1), packer.count).tolist()
        closed = packing.close_windows(left, full)
        sizes = [sum(len(p.ids) for p in w) for w in closed]
        assert sum(sizes) == total - done and all(s == full or s & (s - 1) == 0 for s in sizes) and len(set(sizes)) >= len(sizes) - sizes.count(full)
        parts = collections.defaultdict(int)
        for p in (p for w in closed for p in w):
            parts[p.doc_id] += len(p.ids)
        assert parts == {p.doc_id: p.total for w in left for p in w}


def test_packing_goes_through_the_levels(spark):
    """Few tokens are placed by cutting at the end, with few and with many tasks."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    path = public_tokenizers.path("word_bpe_49k.json")
    for tasks in (8, 32):
        got = packing.pack_documents(docs.repartition(tasks), path).selectExpr("sum(length) as n", "sum(if(recut, length, 0)) as moved").first()
        assert got.moved < 0.1 * got.n, (tasks, got)
        print(tasks, got.moved / got.n)


def test_targets_and_mix(spark):
    sizes = {None: 1000, "b": 10, "a": 500, "c": 700}
    got = mixing.targets(sizes)
    assert abs(sum(got.values()) - min(1.5 * 2210, 2 * 2210)) < 1e-6
    assert all(got[s] <= 2 * sizes[s] + 1e-9 for s in sizes) and got["b"] == 20
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(1, 60), ["a", "b", None][i % 3] if i % 2 else "a", 1, "") for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.mix_sources(docs.select("doc_id", "source", mixing.word_count(docs.text).alias("size")))
    first = {r.doc_id: r for r in mixed.collect()}
    again = {r.doc_id: r.taken for r in mixed.repartition(3).collect()}
    assert again == {k: r.taken for k, r in first.items()}
    total = collections.Counter()
    for r in first.values():
        total[r.source] += r.taken
        assert r.taken <= 2 * r["size"] and r["size"] == len(rows[r.doc_id][1].split())
    for r in first.values():
        assert abs(total[r.source] - r.target) <= 0.01 * r.target + 60
    odd = spark.createDataFrame([(1, "a", None), (None, None, 5), (1, "a", 7), (1, "a", 7)], "doc_id long, source string, size long")
    assert sorted(r["size"] for r in mixing.mix_sources(odd).collect()) == [0, 5, 7, 7]
    assert mixing.mix_sources(docs.limit(0).select("doc_id", "source", mixing.word_count(docs.text).alias("size"))).count() == 0


def luhn(d):
    s = sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d)))
    return s % 10 == 0


def test_pseudonyms(spark):
    text = "card 4465758382889437 or 4465-7583-8288-9437, bad 4465758382889438; on 2024-02-29, 31.12.1999, 99/99/2001; me.then16@mail2.example.com 233.233.171.252. +1 (293) 555-9179%%% 123-45-6789 000-12-3456"
    rows = [(1, text, "a", 0, "z"), (2, "again 4465758382889437 2024-02-29 233.233.171.252", "a", 0, "z"), (3, None, None, None, None), (4, "", "", 0, ""), (5, "nothing here 12 3.5", "", 0, ""), (5, "nothing here 12 3.5", "", 0, "")]
    got = pii.pseudonymise(spark.createDataFrame(rows, SCHEMA), "k").orderBy("doc_id").collect()
    one, two = got[0].text, got[1].text
    card = re.search(r"card (\d{16}) or ((?:\d{4}-){3}\d{4}), bad 4465758382889438; on (\d{4}-\d\d-\d\d), (\d\d\.\d\d\.\d{4}), 99/99/2001; ([a-z.]+\d\d)@mail2.example.com (\d+(?:\.\d+){3})\. \+1 \((\d{3})\) (\d{3}-\d{4})%%% (\d{3}-\d\d-\d{4}) 000-12-3456$", one)
    assert card and luhn(card[1]) and card[1] != "4465758382889437" and card[2].replace("-", "") == card[1]
    assert two == f"again {card[1]} {card[3]} {card[6]}"
    assert card[5] != "me.then16" and card[6] != "233.233.171.252" and card[8] != "555-9179"
    assert [r.text for r in got[2:]] == [None, "", rows[4][1], rows[4][1]] and [r.n_replaced for r in got] == [8, 3, 0, 0, 0, 0]
    other = pii.pseudonymise(spark.createDataFrame(rows[:1], SCHEMA), "another").first().text
    assert other != one
    assert pii.pseudonymise(spark.createDataFrame([], SCHEMA), "k").count() == 0


def test_pseudonyms_are_a_permutation(spark):
    rows = [(i, "2024-%02d-%02d" % (m, d), "", 0, "") for i, (m, d) in enumerate((m, d) for m in range(1, 13) for d in range(1, 29))]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame(rows, SCHEMA), "k").collect()]
    assert len(set(got)) == len(rows) and all("1900-01-01" <= g <= "2099-12-31" for g in got)


def test_pseudonyms_of_all_forms(spark):
    upper = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"
    mixed = "9233A8ecF7C5B09FE5949719B6B82BC4"
    text = f"+4915112345678, +4420 7946 0958, +35312345678, +2 34 56 78; {upper} {upper.lower()} {mixed} 2024-02-29T10:00:00Z 2024-02-29 2024-02-29th"
    got = pii.pseudonymise(spark.createDataFrame([(1, text, "", 0, "")], SCHEMA), "k").first()
    form = r"\+49(\d{11}), \+44(\d\d \d{4} \d{4}), \+353(\d{8}), \+(\d \d\d \d\d \d\d); ([0-9A-F]{40}) ([0-9a-f]{40}) ([0-9A-Fa-f]{32}) (\d{4}-\d\d-\d\d)T10:00:00Z (\d{4}-\d\d-\d\d) 2024-02-29th"
    new = re.fullmatch(form, got.text)
    assert new and got.n_replaced == 9
    old = ("15112345678", "20 7946 0958", "12345678", "2 34 56 78", upper, upper.lower(), mixed, "2024-02-29", "2024-02-29")
    assert all(a != b for a, b in zip(new.groups(), old)) and new[1][:2] + new[2][:2] != "1520"
    assert new[5] == new[6].upper() and new[8] == new[9]


DIGITS, SMALL = "0123456789", "abcdefghijklmnopqrstuvwxyz"


def shift(key, *parts):
    return int(hashlib.sha256("|".join(map(str, (key, *parts))).encode()).hexdigest()[:12], 16)


def brute_feistel(value, tweak, key, alphabets):
    for r in range(8):
        half = len(value) // 2
        other = value[half:] if r % 2 == 0 else value[:half]
        out = ""
        for i, c in enumerate(value):
            if (i < half) == (r % 2 == 0):
                for letters in reversed(alphabets):
                    if c in letters:
                        c = letters[(letters.index(c) + shift(key, tweak, len(value), r, i, other)) % len(letters)]
                        break
            out += c
        value = out
    return value


def brute_number(x, tweak, key, low, high):
    a, b = divmod(x, high)
    for r in range(8):
        if r % 2 == 0:
            a = (a + shift(key, tweak, r, b)) % low
        else:
            b = (b + shift(key, tweak, r, a)) % high
    return a * high + b


def refill(shape, digits):
    left = iter(digits)
    return "".join(next(left) if c in DIGITS else c for c in shape)


CODES = ["1", "7", "20", "27", *"30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()]


def brute_pseudonym(m, key):
    """What takes the place of one match, after its kind is told by trying the kinds in order."""
    kind = next(k for k, p in pii.KINDS.items() if regex.fullmatch(p, m))
    digits = "".join(c for c in m if c in DIGITS)
    if kind == "email":
        local, domain = m.split("@")
        return brute_feistel(local, domain.lower(), key, (DIGITS, SMALL, SMALL.upper())) + "@" + domain
    if kind == "secret":
        if m != m.lower() and m != m.upper():
            return brute_feistel(m, "secret", key, (DIGITS, "abcdef", "ABCDEF"))
        new = brute_feistel(m.lower(), "secret", key, (DIGITS + "abcdef",))
        return new.upper() if m != m.lower() else new
    if kind == "date":
        for form in ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y"):
            try:
                at = datetime.datetime.strptime(m, form)
            except ValueError:
                continue
            first = datetime.datetime(1900, 1, 1)
            x = brute_number((at - first).days, "date", key, 150, 487)
            return (first + datetime.timedelta(x if x < 73049 else brute_number(x, "date", key, 150, 487))).strftime(form)
        return m
    if kind == "ip":
        new = brute_feistel("".join("%02x" % int(o) for o in m.split(".")), "ip", key, (DIGITS + "abcdef",))
        return ".".join(str(int(new[i : i + 2], 16)) for i in range(0, 8, 2))
    if kind == "phone":
        code = ""
        if m[0] == "+":
            code = next((c for c in CODES if m[1:].startswith(c)), m[1:4] if m[1:4].isdigit() and m[1] != "1" else "")
        rest = m[len(code) + 1 :] if code else m
        return ("+" + code if code else "") + refill(rest, brute_feistel("".join(c for c in rest if c in DIGITS), "+" + (code or "1"), key, (DIGITS,)))
    if kind == "ssn":
        area, group, serial = map(int, m.split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return m
        areas = [a for a in range(1, 900) if a != 666]
        x = brute_number((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, "ssn", key, 898 * 99, 9999)
        return "%03d-%02d-%04d" % (areas[x // 9999 // 99], x // 9999 % 99 + 1, x % 9999 + 1)
    if not luhn(digits):
        return m
    new = digits[0] + brute_feistel(digits[1:-1], "card", key, (DIGITS,))
    return refill(m, new + next(c for c in DIGITS if luhn(new + c)))


def test_pseudonyms_against_another_feistel(spark, sf):
    """Whole documents, and many numbers of each kind, against plain Python."""
    rng = random.Random(12)
    n = lambda k: "".join(rng.choice(DIGITS) for _ in range(k))
    odd = [f"{n(3)}-{n(2)}-{n(4)}" for _ in range(600)] + [f"{rng.choice(['+1 ', '+1-', ''])}{n(3)}-{n(3)}-{n(4)}" for _ in range(200)]
    odd += ["+1 293 555 9179", "293-555-9179", "(293) 555-9179", "2099-12-31", "1900-01-01", "29.02.1900", "29.02.2000", "12/31/2001", "31/12/2001", "12/11/2001"]
    odd += [f"{n(4)} {n(4)} {n(4)} {n(4)}" for _ in range(200)] + [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(50)]
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + odd + ["x " * 1_200_000 + odd[0]]
    got = pii.pseudonymise(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), "a key").orderBy("doc_id").collect()
    changed = 0
    for before, after in zip(texts, got):
        replaced = []
        want = regex.sub(pii.PATTERN, lambda m: replaced.append((m[0], brute_pseudonym(m[0], "a key"))) or replaced[-1][1], before) if before else before
        assert after.text == want and after.n_replaced == sum(a != b for a, b in replaced)
        changed += after.n_replaced
    assert changed > 800
    same = [got[texts.index(t)].text for t in ("+1 293 555 9179", "293-555-9179", "(293) 555-9179")]
    assert len({"".join(c for c in t if c in DIGITS)[-10:] for t in same}) == 1
    # All valid numbers stay valid, and no two come together.
    valid = {t: g.text for t, g in zip(texts, got) if regex.fullmatch(r"\d{3}-\d\d-\d{4}", t or "") and t[:3] not in ("000", "666") and t[0] != "9" and "-00-" not in t and t[-4:] != "0000"}
    assert len(set(valid.values())) == len(valid) > 400 and all(v[:3] not in ("000", "666") and v[0] != "9" and "-00-" not in v and v[-4:] != "0000" for v in valid.values())


def test_the_key_is_not_in_the_plan(spark):
    made = pii.pseudonymise(spark.createDataFrame([(1, "2024-02-29")], "doc_id long, text string"), "a key that nobody sees")
    assert "nobody" not in made._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        pii.pseudonymise(made, "")
    assert pii.key_of(spark) == pii.key_of(spark) != ""


def test_language_model(spark):
    rng = random.Random(5)
    follow = {a: [rng.choice("abcdefghij") for _ in range(2)] for a in "abcdefghij"}
    rows = []
    for i in range(300):
        w = [rng.choice("abcdefghij")]
        for _ in range(rng.randrange(5, 60)):
            w.append(rng.choice(follow[w[-1]]))
        rows.append((i, " ".join(w), "", 0, ""))
    rows += [(300, None, "", 0, ""), (301, "", "", 0, ""), (302, "unseen Words", "", 0, ""), (0, rows[0][1], "", 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = pitman_yor.score_documents(docs).collect()
    assert len(got) == len(rows)
    tokens = {r[0]: words((r[1] or "").translate(LOWER)) + [None] for r in rows}
    train = collections.Counter(t for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2 for t in tokens[r[0]])
    n, v = sum(train.values()), len(train)
    better = 0
    for r in got:
        want = sum(math.log10((train[t] + 1) / (n + v + 1)) for t in tokens[r.doc_id])
        assert abs(want - r.base_score) < 1e-9 and r.train_tokens == n and r.n_tokens == len(tokens[r.doc_id])
        assert r.n_known == sum(train[t] > 0 for t in tokens[r.doc_id]) and r.score < 0
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        better += r.held_out and r.score > r.base_score
    assert better > 0.9 * sum(r.held_out for r in got)
    assert pitman_yor.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    again = {(r.doc_id, r.score) for r in pitman_yor.score_documents(docs.repartition(3)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert again == {(r.doc_id, r.score) for r in got}


def brute_pitman_yor(train, texts, burn_in, samples, rng, strength=1.0):
    """Two levels with every customer at a table of its own choice, moved one at a time."""
    estimate = lambda n: min(0.95, max(0.1, n[1] / (n[1] + 2 * n[2]))) if n[1] else 0.5
    cells = collections.Counter((u, w) for t in train for u, w in zip(["^", *t], t))
    discount = estimate(collections.Counter(cells.values()))
    types = len({w for _, w in cells})
    seats = {c: [1] * n for c, n in cells.items()}  # customers of each table
    of_context = collections.Counter(u for t in train for u in ["^", *t[:-1]])
    tables = collections.Counter()
    for (u, _), s in seats.items():
        tables[u] += len(s)
    above = collections.defaultdict(list)
    for (_, w), s in seats.items():
        above[w] += [1] * len(s)

    def parent(w):
        c0, t0 = sum(map(sum, above.values())), sum(map(len, above.values()))
        return (sum(above[w]) - d0 * len(above[w]) + (strength + d0 * t0) / (types + 1)) / (strength + c0)

    def leave(at):
        k = rng.choices(range(len(at)), at)[0]
        at[k] -= 1
        if not at[k]:
            at.pop(k)
            return True

    def sit(at, fresh, d):
        weights = [n - d for n in at] + [fresh]
        k = rng.choices(range(len(weights)), weights)[0]
        if k == len(at):
            at.append(1)
            return True
        at[k] += 1

    mean = [[0.0] * len(t) for t in texts]
    for sweep in range(burn_in + samples):
        d0 = estimate(collections.Counter(sum(x) for x in above.values()))
        for (u, w), at in seats.items():
            for _ in range(cells[u, w]):
                if leave(at):
                    tables[u] -= 1
                    leave(above[w])
                if sit(at, (strength + discount * tables[u]) * parent(w), discount):
                    tables[u] += 1
                    t0 = sum(map(len, above.values()))
                    sit(above[w], (strength + d0 * t0) / (types + 1), d0)
        if sweep >= burn_in:
            for t, m in zip(texts, mean):
                for k, (u, w) in enumerate(zip(["^", *t], t)):
                    at = seats.get((u, w), [])
                    m[k] += (max(0.0, sum(at) - discount * len(at)) + (strength + discount * tables[u]) * parent(w)) / (strength + of_context[u]) / samples
    return [sum(map(math.log10, m)) for m in mean]


def test_language_model_against_seating_of_each_customer(spark):
    rng = random.Random(2)
    follow = {a: rng.choices("abcdefgh", k=3) for a in "abcdefgh"}
    rows = []
    for i in range(60):
        w = [rng.choice("abcdefgh")]
        for _ in range(rng.randrange(3, 12)):
            w.append(rng.choice(follow.get(w[-1], "abc")) if rng.random() < 0.8 else rng.choice("abcdefghxyz"))
        rows.append((i, " ".join(w), "", 0, ""))
    tokens = [r[1].split() + ["$"] for r in rows]
    train = [t for i, t in enumerate(tokens) if zlib.crc32(str(i).encode()) % 7 != 2]
    want = brute_pitman_yor(train, tokens, 20, 150, rng)
    got = {r.doc_id: r.score for r in pitman_yor.score_documents(spark.createDataFrame(rows, SCHEMA), burn_in=4, samples=12).collect()}
    off = [(got[i] - want[i]) / len(tokens[i]) for i in range(len(rows))]
    assert max(map(abs, off)) < 0.03 and abs(sum(off)) / len(off) < 0.01, (max(map(abs, off)), sum(off) / len(off))


def test_table_counts_follow_the_conditional():
    import numpy as np

    rng = np.random.default_rng(1)
    n = 20000
    # One dish, certain in the parent: the restaurant's prior, whose mean number of tables is known.
    for customers in (5, 30, 400):
        drawn = pitman_yor.draw_tables(np.full(n, customers), np.zeros(n), np.ones(n), 0.6, 1.0, rng)
        mean = 0.0
        expect = 0.0
        for i in range(customers):
            expect += (1.0 + 0.6 * expect) / (1.0 + i)
        mean = drawn.mean()
        assert abs(mean - expect) < 0.03 * expect, (customers, mean, expect)
