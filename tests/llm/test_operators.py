"""Defined results for nulls, empty tables, ties, repeated rows, clashing columns; brute force on small inputs."""

import hashlib
import math
import os
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import sentencepiece

from quirefold.llm import chat, exact_dedup, lm_score, media, mixing, near_dedup, pieces, quality, substring_dedup, warc
from quirefold.llm.common import WordHashes, components, shingles
from quirefold.llm.queries import PIECES, TOKENS

CLASH = "doc_id bigint, text string, source string, id string, row string, h string, same string, n string, size string, key string"
ROWS = [(1, "a b c"), (2, "A b c"), (3, None), (4, ""), (5, "x " * 3000), (5, "x " * 3000), (None, "lonely words here"), (7, "é ß ﬁ\n\ttabs"), (8, "a b c")]


def docs(spark, rows, extra="z"):
    return spark.createDataFrame([(i, t, s, *[extra] * 7) for i, t, s in (r if len(r) == 3 else (*r, "s") for r in rows)], CLASH)


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ROWS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


def words(rng, n, vocabulary=200):
    return [f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n)]


def near_copies(seed=1, groups=12):
    rng, out = random.Random(seed), []
    for _ in range(groups):
        base = words(rng, rng.randint(1, 120))
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 15))):
                copy[rng.randrange(len(copy))] = f"n{rng.random()}"
            out.append(" ".join(copy))
    rng.shuffle(out)
    return [(i, t) for i, t in enumerate(out)]


# exact dedup


def test_exact_dedup_states_every_row(odd):
    got = sorted((r.id is not None, r.id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.groups(odd).collect() if r.id is not None)
    assert got == sorted([(True, 1, 8, 3, False), (True, 2, 8, 3, False), (True, 8, 8, 3, True), (True, 3, 4, 2, False), (True, 4, 4, 2, True), (True, 5, 5, 2, False), (True, 5, 5, 2, True), (True, 7, 7, 1, True)])
    kept = exact_dedup.dedup(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 4, 5, 7, 8]


def test_exact_dedup_of_nothing(empty):
    assert exact_dedup.groups(empty).count() == 0 and exact_dedup.dedup(empty).count() == 0


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_BITS", 1 << 16)
    rows = [(i, f"text {i % 900}") for i in range(1500)]
    got = {r.id: (r.keep_id, r.group_size) for r in exact_dedup.groups(docs(spark, rows)).collect()}
    assert got == {i: (max(j for j in range(1500) if j % 900 == i % 900), sum(j % 900 == i % 900 for j in range(1500))) for i in range(1500)}


def test_ranges_of_hashes_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_BITS", 1 << 17)
    rows = [(i, f"text {i % 25000}") for i in range(30000)]
    assert exact_dedup.ranges(30000) == 4
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = exact_dedup.groups(d)
    assert got.filter("kept").count() == 25000 and got.filter("group_size = 2").count() == 10000 and exact_dedup.dedup(d).count() == 25000


def test_dedup_passes_any_columns_through(spark):
    rows = [(1, "a", "s", 1, {"k": 1}, ["x"]), (2, "A", "s", 2, {"k": 2}, ["x"]), (2, "a", "t", 3, {"k": 3}, None), (3, "b", None, 4, None, ["y"]), (None, "A", "u", 5, {"k": 5}, None), (None, None, "v", 6, None, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, sha string, `a.b` int, m map<string,int>, l array<string>")
    got = exact_dedup.dedup(d)
    assert got.columns == d.columns
    assert sorted((r[0] or -1, r[1] or "", r[3]) for r in got.collect()) == [(-1, "", 6), (2, "A", 2), (3, "b", 4)]


def test_hot_texts(spark):
    rows = [(i, "same" if i % 3 else f"t{i}") for i in range(900)]
    assert sum(r.kept for r in exact_dedup.groups(docs(spark, rows)).collect()) == 301


# mixing


def brute_targets(sizes, weights, total, cap):
    clamped = set()
    while True:
        level = (total - sum(cap * sizes[s] for s in clamped)) / max(sum(weights[s] for s in sizes if s not in clamped), 1e-12)
        more = {s for s in sizes if s not in clamped and weights[s] * level > cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in clamped else weights[s] * level for s in sizes}
        clamped |= more


def test_mixing_fills_to_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(words(rng, rng.randint(1, 30))), rng.choice(["a", "b", "c", None, "é", ""] + ["hot"] * 3)) for i in range(1500)]
    got = mixing.shares(docs(spark, rows), mixing.five_two_one).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = brute_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, sum(sizes.values()), 3)
    taken = Counter()
    for r in got:
        assert math.isclose(r.target, want[r.source]) and r.source_size == sizes[r.source] and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert len(got) == 1500 and all(abs(taken[s] - want[s]) <= 30 for s in sizes)
    assert sorted((r.id, r.taken) for r in got) == sorted((r.id, r.taken) for r in mixing.shares(docs(spark, rows), mixing.five_two_one).collect())


def test_mix_repeats_rows(odd, empty):
    taken = {r.id: r.repeats for r in mixing.shares(odd, mixing.five_two_one).collect() if r.id not in (5, None)}
    got = mixing.mix(odd, mixing.five_two_one)
    assert got.columns == odd.columns
    n = Counter(r.doc_id for r in got.collect())
    assert all(n[i] == taken[i] for i in taken) and n[5] % 2 == 0
    assert mixing.mix(empty, mixing.five_two_one).count() == 0 and mixing.shares(empty, mixing.five_two_one).count() == 0


def test_mix_passes_any_columns_through(spark):
    d = spark.createDataFrame([(i, "w " * 5, "st"[i % 2], i, {"k": i}) for i in range(20)], "doc_id bigint, text string, source string, `a.b` int, whole map<string,int>")
    got = mixing.mix(d, mixing.five_two_one)
    want = {r.id: r.repeats for r in mixing.shares(d, mixing.five_two_one).collect()}
    assert got.columns == d.columns and Counter(r.doc_id for r in got.collect()) == +Counter(want)


def test_mix_deals_out_what_repeated_rows_take(spark):
    rows = [(1, "a b", "x"), (1, "c d", "x")] + [(i % 3, "e f g", "y") for i in range(21)] + [(None, "h", "z")] * 5
    d = docs(spark, rows)
    taken, got = Counter(), Counter()
    for r in mixing.shares(d, mixing.five_two_one, share=0.7).collect():
        taken[r.id, r.source] += r.repeats
    assert any(n % sum(x[0] == i and x[2] == s for x in rows) for (i, s), n in taken.items())
    mixed = mixing.mix(d, mixing.five_two_one, share=0.7)
    assert mixed.columns == d.columns
    for r in mixed.collect():
        got[r.doc_id, r.source] += 1
    assert got == +taken


# pieces


def test_pieces_equal_the_library_and_read_back(spark, odd, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(5)
    alphabet = "abcdefghij  \n\téüßé́日本語ﬁ.,!'\"0123456789THEing"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [" " * k + t for k in (1, 2, 15, 16, 17, 33, 100) for t in ("", "x")] + ["x" * 5000, "the " * 5000]
    got = pieces.decode(pieces.encode(docs(spark, list(enumerate(texts))), PIECES), PIECES).collect()
    for r in got:
        assert r.ids == sp.encode(r.text) and r.decoded == r.text
    s = pieces.summary(odd, PIECES)
    assert s.count() == len(ROWS) and s.filter("not same").count() == 0 and pieces.summary(empty, PIECES).count() == 0


def test_a_word_of_600_000_characters_equals_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    word = "".join(random.Random(8).choices("abcdefghilmnorstuTHE+/0123456789é語", k=600_000))
    assert pieces.Encoder(pieces.Model(PIECES)).encode([word, "short words"])[0].tolist() == sp.encode(word)


# media


def test_media_round_trip():
    for n in (0, 1, 191, 192, 193, 1536, 1537, 100_000):
        data = os.urandom(n)
        parsed, back = media.read_back(media.write(data))
        assert back == data and sum(p.size for p in parsed.packets) == n
        assert [p.timestamp_ns for p in parsed.packets] == sorted(p.timestamp_ns for p in parsed.packets)
        for time, track, at in parsed.cues:
            assert track == 1 and media.write(data)[at : at + 4] == media.CLUSTER.to_bytes(4, "big") and time in {p.timestamp_ns for p in parsed.packets}


@pytest.mark.parametrize("kind,lace", [(1, b"\x02\xff\x2d\x05"), (3, b"\x02" + b"\x41\x2c" + b"\x5e\xd8"), (2, b"\x02")])
def test_each_lacing(kind, lace):
    sizes = {1: [300, 5, 7], 3: [300, 5, 7], 2: [9, 9, 9]}[kind]
    frames = [os.urandom(n) for n in sizes]
    block = media.element(media.SIMPLE, b"\x81\x00\x05" + bytes([kind << 1]) + lace + b"".join(frames))
    grouped = media.element(media.GROUP, media.element(media.BLOCK, b"\x82\xff\xff\x00abc") + media.element(media.REFERENCE, 1))
    cluster = media.element(media.CLUSTER, media.element(media.TIMESTAMP, 7) + block + grouped)
    unknown = media.SEGMENT.to_bytes(4, "big") + b"\x01\xff\xff\xff\xff\xff\xff\xff" + media.element(media.INFO, media.element(media.SCALE, 1000)) + media.CLUSTER.to_bytes(4, "big") + b"\xff" + cluster[5 + (cluster[4] < 0x80) :] + media.element(media.CUES, b"")
    for data in (media.element(media.SEGMENT, cluster), unknown):
        p = media.parse(data)
        assert [data[x.offset : x.offset + x.size] for x in p.packets] == [*frames, b"abc"]
        assert [x.track for x in p.packets] == [1, 1, 1, 2] and not p.packets[-1].key and p.packets[0].timestamp_ns == 12 * p.scale


def test_media_tables(spark, odd, empty):
    m = media.encoded(odd, "text", "media")
    p = media.packets(m, "doc_id").groupBy("id").sum("byte_size").collect()
    assert {r[0]: r[1] for r in p}[7] == 192
    bad = spark.createDataFrame([(1, bytearray(b"\x1a\x45\xdf\xa3\x85ab")), (2, None)], "doc_id bigint, media binary")
    assert [(r.id, r.error is None) for r in media.packets(bad, "doc_id").collect()] == [(1, False)]
    s = {r.id: r for r in media.summary(odd).collect()}
    assert s[3].payload_sha256 == hashlib.sha256(b" " * 192).hexdigest() == s[4].payload_sha256 and s[3].n_bytes == 0 and s[5].payload_bytes == 6144
    assert media.summary(empty).count() == 0


# LM scoring


def slow_tree(texts, depth):
    """Counts by (context, bits so far), all depths."""
    n = Counter()
    for t in texts:
        raw = bytes([255]) * depth + t + b"\xff"
        for i in range(depth, len(raw)):
            for d in range(depth + 1):
                c, node = raw[i - d : i], 1
                for k in range(7, -1, -1):
                    bit = raw[i] >> k & 1
                    n[c, node, bit] += 1
                    node = node * 2 + bit
    return n


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


def test_tree_equals_the_recursion(spark):
    train = [b"abracadabra", b"abra cadabra", b"", b"the cat sat on the mat"]
    tree = lm_score.grow(spark.createDataFrame([(t.decode(),) for t in train], "text string"))
    n, depth = slow_tree(train, lm_score.DEPTH), lm_score.DEPTH
    contexts = {c for c, _, _ in n}

    def weighted(c, node):
        a, b = n[c, node, 0], n[c, node, 1]
        if len(c) == depth or not a + b:
            return kt(a, b)
        below = [bytes([x]) + c for x in {y[0] for y in contexts if len(y) == len(c) + 1 and y[1:] == c}]
        return np.logaddexp(kt(a, b), sum(weighted(x, node) for x in below)) - math.log(2)

    def one(raw, i, node, d):
        c = raw[i - d : i]
        a, b = n[c, node, 0], n[c, node, 1]
        own = (b + 0.5) / (a + b + 1)
        longer = raw[i - d - 1 : i]
        if d == depth or not n[longer, node, 0] + n[longer, node, 1]:
            return own
        w = math.exp(kt(a, b) - math.log(2) - weighted(c, node))
        return w * own + (1 - w) * one(raw, i, node, d + 1)

    for text in (b"abra", b"the dog", b"", b"zz"):
        raw, bits = bytes([255]) * depth + text + b"\xff", 0.0
        for i in range(depth, len(raw)):
            node = 1
            for k in range(7, -1, -1):
                bit = raw[i] >> k & 1
                p = one(raw, i, node, 0)
                bits += math.log2(p if bit else 1 - p)
                node = node * 2 + bit
        assert math.isclose(tree.score([text])[0], bits * math.log10(2), rel_tol=1e-4)


def test_probabilities_sum_to_one(spark):
    tree = lm_score.grow(spark.createDataFrame([("some words and some more words",)], "text string"))
    for c in (b"some ", b"xyzzy", b"\xff" * 5):
        key = int.from_bytes(c[::-1], "big") << 8
        never = np.array([key | 0xFE], np.uint64)  # no byte of UTF-8; its place in the table is taken
        rest = np.array([key | x for x in range(256) if x != 0xFE], np.uint64)
        assert math.isclose(sum(2 ** tree.log2(rest)) + 2 ** tree._by_bits(never)[0], 1, rel_tol=1e-4)


def test_word_scores(odd, empty):
    got = lm_score.scored(odd, lm_score.F.coalesce(lm_score.F.col("doc_id") != 8, lm_score.F.lit(True))).collect()
    token = lambda t: [*(t or "").encode().lower().split(), b""]
    c = Counter(w for i, t in ROWS if i != 8 for w in token(t))
    total, v = sum(c.values()), len(c)
    assert len(got) == len(ROWS)
    for r in got:
        t = token(next(t for i, t in ROWS if i == r.id))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), total)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (total + 0.5 * (v + 1))) for w in t), rel_tol=1e-9) and r.score < 0
    assert lm_score.scored(empty, lm_score.F.lit(True)).count() == 0
    unlearned = lm_score.scored(odd, lm_score.F.lit(False)).first()
    assert unlearned.n_known == 0 and math.isclose(unlearned.bits_per_byte, 8, rel_tol=1e-6)


def test_rare_contexts_count_at_any_size(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK", 1 << 18)
    rng = random.Random(6)
    often, times, rare = [" ".join(words(rng, 8, 40)) for _ in range(20)], 3000, "Zyx\u00e9 quorl vex"
    rows = [(i, often[i % 20]) for i in range(20 * times)] + [(-1, rare), (-2, "quorl zyx w1"), (-3, rare)]
    assert sum(len(t) + 1 for _, t in rows) > 1 << 20
    d = docs(spark, rows).repartition(3)
    got = {r.id: r for r in lm_score.scored(d, lm_score.F.col("doc_id") >= -1).filter("id < 20").collect()}
    n, depth = Counter(), lm_score.DEPTH
    for texts, k in ((often, times), ([rare], 1)):
        for key, x in slow_tree([t.lower().encode() for t in texts], depth).items():
            n[key] += x * k
    below = {}
    for c, node, _ in n:
        below.setdefault((c[1:], node), set()).add(c) if c else None

    def weighted(c, node):
        a, b = n[c, node, 0], n[c, node, 1]
        return kt(a, b) if len(c) == depth else np.logaddexp(kt(a, b), sum(weighted(x, node) for x in below[c, node])) - math.log(2)

    known = {}

    def one(raw, i, node):
        p, left = 0.0, 1.0
        for d in range(depth + 1):
            c, longer = raw[i - d : i], raw[i - d - 1 : i]
            a, b = n[c, node, 0], n[c, node, 1]
            own = (b + 0.5) / (a + b + 1)
            if d == depth or not n[longer, node, 0] + n[longer, node, 1]:
                return p + left * own
            if (c, node) not in known:
                known[c, node] = math.exp(kt(a, b) - math.log(2) - weighted(c, node))
            p, left = p + left * known[c, node] * own, left * (1 - known[c, node])

    for i, text in [(-1, rare), (-2, "quorl zyx w1"), (-3, rare), (7, often[7])]:
        raw, bits = b"\xff" * depth + text.lower().encode() + b"\xff", 0.0
        for j in range(depth, len(raw)):
            node = 1
            for k in range(7, -1, -1):
                bit = raw[j] >> k & 1
                p = one(raw, j, node)
                bits += math.log2(p if bit else 1 - p)
                node = node * 2 + bit
        assert math.isclose(got[i].score, bits * math.log10(2), rel_tol=1e-4)


# WARC


def test_loser_tree():
    rng = random.Random(2)
    for k in range(12):
        runs = [sorted((rng.randint(0, 9), i, j) for j in range(rng.randint(0, 8))) for i in range(k)]
        assert [x[:2] for x in warc.LoserTree([iter(r) for r in runs], lambda x: x[0])] == sorted((x[0], x[1]) for r in runs for x in r)


def test_captures_are_written_read_and_ordered(spark):
    long = "é" * 600
    rows = [(1, "http://b.example/x", long), (2, "http://a.example/y z", long), (3, None, None), (4, "http://b.example/x", "short"), (5, "https://b.example:8080/x?q=1#f", "short"), (None, "no url", long), (2, "http://a.example/y z", long)]
    p = spark.createDataFrame([(*r, "z", "z") for r in rows], "page_id bigint, url string, html string, sha string, id string")
    got = warc.histories(p).orderBy("range", "place").collect()
    assert len(got) == 7
    assert sorted((r.id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in got) == [(0, "revisit", 2, 1200), (1, "revisit", 2, 1200), (2, "response", None, 1200), (2, "response", None, 1200), (3, "response", None, 0), (4, "response", None, 5), (5, "response", None, 5)]
    assert {r.payload_digest for r in got if r.payload_bytes == 5} == {hashlib.sha1(b"short").hexdigest()}
    keys = [warc.order((r.id, r.urlkey, r.captured)) for r in got]
    assert keys == sorted(keys) and warc.url_key("HTTP://www.Example.com:80/p?x") == "com,example,www)/p?x"
    assert warc.histories(p.limit(0)).count() == 0


def test_many_ranges_keep_the_order(spark):
    rng = random.Random(4)
    p = spark.createDataFrame([(i, f"http://h{rng.randint(0, 5) if i % 3 else 0}.example/", "x") for i in range(400)], "page_id bigint, url string, html string").repartition(7)
    got = warc.merge(warc.read(warc.write(p)), ranges=9).orderBy("range", "place").collect()
    keys = [warc.order((r.id, r.urlkey, r.captured)) for r in got]
    assert len(got) == 400 and keys == sorted(keys) and len({r.range for r in got}) == 9


# near-duplicates


def brute_groups(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    rows = near_copies(k)
    got = {r.id: (r.n, r.root) for r in near_dedup.groups(docs(spark, rows), k=k).collect()}
    assert got == brute_groups(rows, k, 80)


def edited_copies(rng, n, size=100, most=8):
    """n copies of one text, each with up to so many words replaced: some pairs are links, most are just not."""
    base = [f"b{i}" for i in range(size)]
    out = []
    for i in range(n):
        copy = list(base)
        for j in rng.sample(range(size), rng.randint(3, most)):
            copy[j] = f"n{i}.{j}"
        out.append((i, " ".join(copy)))
    return out


def test_a_large_group_of_near_copies_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PART_ROWS", 40)
    monkeypatch.setattr(near_dedup, "PAIRS_A_PART", 30)
    rows = edited_copies(random.Random(4), 250)
    got = {r.id: (r.n, r.root) for r in near_dedup.groups(docs(spark, rows), k=2).collect()}
    assert got == brute_groups(rows, 2, 80) and len({x for _, x in got.values()}) > 1


def test_a_block_puts_out_fewer_links_than_rows():
    rows = edited_copies(random.Random(5), 600)
    want = brute_groups(rows, 2, 80)
    sets = near_dedup.shingle_sets([t.encode() for _, t in rows], 2, WordHashes())
    ids = np.arange(len(rows))
    asks, twice = np.repeat([True, False], len(rows)), np.concatenate([ids, ids])
    a, b = near_dedup.block_links(asks, asks | True, twice, twice, sets + sets, 80)
    assert len(a) == len(rows) - len({r for _, r in want.values()})
    root = {i: i for i in ids}
    for x, y in sorted(zip(a, b, strict=True)):
        low, high = sorted((root[x], root[y]))
        root = {i: low if r == high else r for i, r in root.items()}
    assert all(root[i] == want[i][1] for i in ids)


def test_near_dedup_of_odd_rows(odd, empty):
    g = near_dedup.groups(odd, k=2)
    got = sorted((r.id or -1, r.n, r.root if r.root is not None else -1) for r in g.collect())
    assert got == [(-1, 2, -1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 1, 5), (5, 1, 5), (7, 3, 7), (8, 2, 1)]
    assert near_dedup.dedup(odd, k=2).columns and near_dedup.groups(empty).count() == 0 and near_dedup.dedup(empty).count() == 0


def test_near_duplicates_under_one_id_are_told_apart(spark):
    rng = random.Random(9)
    a, b, c = (words(rng, 80, 10**6) for _ in range(3))
    copy = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(a)), (2, " ".join(b)), (2, copy(a)), (3, copy(b)), (4, " ".join(c)), (4, copy(c)), (4, None), (None, copy(c))]
    d = docs(spark, rows)
    got = sorted((r.id or -1, r.root or -1) for r in near_dedup.groups(d, k=2).filter("n > 0").collect())
    assert got == [(-1, 4), (1, 1), (2, 1), (2, 2), (3, 2), (4, 4), (4, 4)]
    kept = Counter((r.doc_id, r.text) for r in near_dedup.dedup(d, k=2).collect())
    assert kept[4, " ".join(c)] + kept[4, copy(c)] == 1
    assert {x for x in kept if x[0] != 4 or x[1] is None} == {(1, " ".join(a)), (2, " ".join(b)), (4, None), (None, copy(c))}


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64))
    for share in (100, 400, 800):
        b = np.unique(np.concatenate([a[:share], rng.integers(0, 1 << 63, 900 - share, dtype=np.uint64)]))
        s = near_dedup.sketches([a, b, a[:1]], 512)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - true) < 0.1 and (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 75), (7, 7)], "a bigint, b bigint")
    got = {r.id: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {75: 50, 100: 50}


def test_components_never_end_unstable(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)], "a bigint, b bigint")
    with pytest.raises(RuntimeError):
        components(edges, rounds=1)


def test_shingles_of_few_words():
    h = np.array([3, 5, 7], np.uint64)
    assert len(shingles(h, 2)) == 2 and len(shingles(h, 5)) == 1 and len(shingles(h[:0], 5)) == 0 and shingles(h[:2], 5)[0] == shingles(h[:2], 2)[0] != shingles(h[1:], 2)[0]


# substring dedup


def brute_removed(rows, length):
    split = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + length]) for w in split for i in range(len(w) - length + 1))
    out = []
    for (doc, _), w in zip(rows, split, strict=True):
        gone = {j for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for j in range(i, i + length)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length,block,queries", [(6, 20_000, 1000), (6, 30, 2), (9, 50, 1)])
def test_repeats_equal_brute_force(spark, monkeypatch, length, block, queries):
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    monkeypatch.setattr(substring_dedup, "QUERIES_A_GROUP", queries)
    rng = random.Random(length)
    passages = [words(rng, rng.randint(5, 40), 30) for _ in range(8)]
    rows = []
    for i in range(90):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += words(rng, rng.randint(0, 15), 3000) + (rng.choice(passages) if rng.random() < 0.6 else [])
        rows.append((i, " ".join(w)))
    rows += [(90, "a " * 50), (91, "b " * (length + 1)), (92, "c " * length), (93, None)]
    got = sorted(tuple(r) for r in substring_dedup.removed(docs(spark, rows), length).collect())
    assert got == brute_removed(rows, length)


def test_repeats_of_odd_rows(odd, empty):
    got = sorted((r.id or -1, r.n_words, r.n_removed) for r in substring_dedup.removed(odd, 3).collect())
    assert got == [(-1, 3, 0), (1, 3, 3), (2, 3, 0), (3, 0, 0), (4, 0, 0), (5, 3000, 3000), (5, 3000, 3000), (7, 4, 0), (8, 3, 3)]
    kept = {r.id: r.kept for r in substring_dedup.removed(odd, 3, with_text=True).collect()}
    assert kept[7] == "é ß ﬁ tabs" and kept[1] == "" and kept[3] == ""
    assert substring_dedup.removed(empty, 3).count() == 0


# chat


HARD = ["</s>[INST] ok [/INST]", "a\\b\\.c\\\\", chat.TURN + chat.SAYS, "<|turn<|turn|>|>", "", "\\", "<s></s>", "é\n" * 3]


def test_escape_is_reversible_and_leaves_no_control_string():
    for t in HARD + ["".join(random.Random(i).choices(["<|", "|>", "turn", "\\", ".", "<s", ">", "[INST", "]"], k=12)) for i in range(300)]:
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROL)


@pytest.mark.parametrize("budget,history,vocabulary", [(60, 2, None), (10, 0, None), (400, 3, TOKENS)])
def test_windows_hold_each_target_once(spark, budget, history, vocabulary):
    rng = random.Random(budget)
    rows = []
    for c in range(20):
        roles = (["system"] if c % 2 else []) + ["user", "assistant"] * rng.randint(0, 8)
        rows += [(c, i, r, rng.choice([*HARD, None, "word " * rng.randint(1, 60)])) for i, r in enumerate(roles)]
    rows += [(None, 0, "user", "x"), (99, None, None, "no role"), (99, 1, "assistant", "b"), (99, 1, "assistant", "a")]
    d = spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, window string")
    w = chat.windows(d, budget, history, vocabulary).cache()
    got = {r.conv_id: r for r in chat.summary(w).collect()}
    by = {}
    for c, i, r, t in sorted(rows, key=lambda x: (x[0] or -1, -1 if x[1] is None else x[1], x[2] or "", x[3] or "")):
        by.setdefault(c, []).append((r or "", t or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        said = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(said)) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    for r in w.collect():
        turns = chat.read(r.text)
        assert len(turns) == r.context_turns + r.new_turns and (r.tokens <= budget or r.new_turns == 1)
        if r.conv_id is not None and r.conv_id % 2 and r.conv_id < 20 and r.window and r.context_turns:
            assert turns[0][0] == "system"
    assert chat.windows(d.limit(0)).count() == 0


# quality


def test_isotonic_means():
    n, t = np.array([2.0, 1, 1, 4]), np.array([1.0, 1, 0, 4])
    assert np.allclose(quality.isotonic(n, t), [0.5, 0.5, 0.5, 1.0])


def test_quality_on_held_out_rows(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    x = quality.features(d, "doc_id", "text")
    learn = lambda c: quality.F.crc32(quality.F.col(c).cast("string")) % 3 != 1
    s = quality.scored(x, quality.fit(quality.labelled(x, labels, keep_in=learn)))
    held = s.join(labels, s.id == labels.doc_id).filter("crc32(cast(doc_id as string)) % 3 = 1").collect()
    assert len(held) > 50 and sum((r.score >= 0.5) == bool(r.quality) for r in held) >= 0.95 * len(held)


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 0), (5, None), (7, 1)], "doc_id bigint, quality int")
    x = quality.features(odd, "doc_id", "text")
    s = quality.scored(x, quality.fit(quality.labelled(x, labels))).collect()
    assert len(s) == len(ROWS) and all(0 <= r.score <= 1 for r in s)
    none = quality.scored(x, quality.fit(quality.labelled(x, labels.limit(0)))).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.keep_good(empty, labels).count() == 0 and quality.keep_good(odd, labels).columns == odd.columns
