import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from vecloom.llm import simhash


def fingerprint(text, bits):
    """Votes bit by bit."""
    counts = Counter(simhash.words_of(text))
    votes = [0] * bits
    for w, n in counts.items():
        digest = int.from_bytes(hashlib.md5(w).digest(), "big")
        for i in range(bits):
            votes[i] += round(8 * n**0.5) * (1 if digest >> (127 - i) & 1 else -1)
    return sum(1 << i for i, v in enumerate(votes) if v > 0)


def groups(keys, near):
    """Connected components by union-find: key -> least member."""
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(keys)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if near(a, b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in keys}


def brute(rows, radius=simhash.RADIUS, bits=simhash.BLOCKS * simhash.WIDTH):
    """(doc_id, duplicate_of) of all rows that go; a null doc_id sorts last."""
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    kept = sorted((r for r in rows if r[1] and r[1].strip()), key=order)
    prints = [fingerprint(r[1], bits) for r in kept]
    g = groups(range(len(kept)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= radius)
    by = defaultdict(list)
    for i, r in g.items():
        by[r].append(i)
    return Counter((kept[i][0], kept[m[0]][0]) for m in by.values() for i in m[1:])


def test_fingerprints(rows):
    texts = [r[1] for r in rows]
    have, bits = simhash.fingerprints(texts, 125)
    for i, b in zip(have, bits):
        assert sum(1 << k for k, x in enumerate(b.tolist()) if x) == fingerprint(texts[i], 125)


def test_near_duplicates(docs, rows):
    got = Counter(tuple(r) for r in simhash.near_duplicates(docs).collect())
    assert got == brute(rows) and got[(11, 3)] == 1 and got[(21, 3)] == 1 and got[(0, 0)] == 2


def test_ball_join_is_complete(spark):
    """All pairs within the radius, among random fingerprints around a few centres."""
    rng = random.Random(5)
    blocks, width = 2, 12
    points = set()
    for _ in range(12):
        centre = rng.getrandbits(24)
        for _ in range(25):
            p = centre
            for _ in range(rng.randint(0, 6)):
                p ^= 1 << rng.randrange(24)
            points.add(p)
    rows = [(p, 0, [p & 4095, p >> 12]) for p in points]
    prints = spark.createDataFrame(rows, "hi long, lo long, block array<int>")
    got = [tuple(r) for r in simhash.near_edges(prints, 5, blocks, width).selectExpr("a.hi", "b.hi").collect()]
    want = {(a, b) for a in points for b in points if a < b and (a ^ b).bit_count() <= 5}
    assert len(got) == len(set(got)) and set(got) == want


def test_drop(docs, rows):
    got = simhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    want = Counter((r[0], r[1]) for r in rows)
    for (doc, _), n in brute(rows).items():
        text = [r[1] for r in rows if r[0] == doc][0]
        want[(doc, text)] -= n
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == +want


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_bits_are_balanced():
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(200)]
    _, bits = simhash.fingerprints(texts, 125)
    assert 0.3 < np.mean(bits) < 0.7


def test_many_equal_rows(spark, monkeypatch):
    """Rows that go are counted out in pieces of bounded size."""
    monkeypatch.setattr(simhash, "AT_ONCE", 4)
    df = spark.createDataFrame([(7, "the same words over and over again here")] * 23 + [(3, "the same words over and over again here"), (4, "quite another text with other words in it")], "doc_id long, text string")
    assert sorted((r[0], r[1]) for r in simhash.near_duplicates(df).collect()) == [(7, 3)] * 23


def test_dropping_by_shuffle(docs, monkeypatch):
    """Beyond the size that is broadcast the same documents go."""
    rows = lambda: sorted((tuple(r) for r in simhash.drop_near_duplicates(docs).collect()), key=repr)
    want = rows()
    monkeypatch.setattr(simhash, "FEW_MEMBERS", 0)
    assert rows() == want


def test_many_candidates_are_no_rows(spark, monkeypatch):
    """Rows of one variant are compared in parts of bounded size within a task, each near pair once; no join makes rows of candidates."""
    rng = random.Random(6)
    blocks, width, centre = 2, 12, 0xABC
    points = sorted({centre | rng.getrandbits(12) << 12 for _ in range(400)} | {(centre ^ 1) | rng.getrandbits(12) << 12 for _ in range(100)})
    emitted = [(k << width | (p >> k * width & 4095) ^ f, p, 0) for p in points for k in range(blocks) for f in (0, *(1 << i for i in range(width)))]
    batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*emitted)], ["variant", "hi", "lo"])
    want = {(a, b) for a in points for b in points if a < b and (a ^ b).bit_count() <= 5}
    for most in (7, 1000, 1 << 18):
        monkeypatch.setattr(simhash, "CANDIDATES", most)
        got = [(r["a"]["hi"], r["b"]["hi"]) for part in simhash._collisions(iter([batch]), 5, blocks, width) for r in part.to_pylist()]
        assert len(got) == len(set(got)) and set(got) == want
    assert list(simhash._collisions(iter([]), 5, blocks, width)) == []
    prints = spark.createDataFrame([(p, 0, [p & 4095, p >> 12]) for p in points], "hi long, lo long, block array<int>")
    assert "Join" not in simhash.near_edges(prints, 5, blocks, width)._jdf.queryExecution().toString()


def classes(points, pairs):
    """Point -> least of its connected component."""
    near = {frozenset(p) for p in pairs}
    return groups(points, lambda a, b: frozenset((a, b)) in near)


def test_links_make_the_same_groups(spark, monkeypatch):
    """Chains, dense groups and lone fingerprints: fewer links in a task than fingerprints, and the components of all near pairs."""
    rng = random.Random(8)
    blocks, width = 2, 12
    points = {rng.getrandbits(24) for _ in range(150)}
    for steps in (1, 3, 20):
        at = rng.getrandbits(24)
        for _ in range(120):
            p = at
            for _ in range(rng.randint(1, 3)):
                p ^= 1 << rng.randrange(24)
            points.add(p)
            at = p if steps > 1 and rng.randrange(steps) == 0 else at
    points = sorted(points)
    want = classes(points, [(a, b) for a in points for b in points if a < b and (a ^ b).bit_count() <= 5])
    emitted = [(k << width | (p >> k * width & 4095) ^ f, p, 0) for p in points for k in range(blocks) for f in (0, *(1 << i for i in range(width)))]
    batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*emitted)], ["variant", "hi", "lo"])
    for most, dense in ((7, 3), (7, 10_000), (100, 30), (1 << 18, 128)):
        monkeypatch.setattr(simhash, "CANDIDATES", most)
        monkeypatch.setattr(simhash, "DENSE", dense)
        got = [(r["a"]["hi"], r["b"]["hi"]) for part in simhash._collisions(iter([batch]), 5, blocks, width, True) for r in part.to_pylist()]
        assert len(got) < len(points) and all(a < b for a, b in got) and classes(points, got) == want
    assert list(simhash._collisions(iter([]), 5, blocks, width, True)) == []
    prints = spark.createDataFrame([(p, 0, [p & 4095, p >> 12]) for p in points], "hi long, lo long, block array<int>")
    assert classes(points, [tuple(r) for r in simhash.near_edges(prints, 5, blocks, width, True).selectExpr("a.hi", "b.hi").collect()]) == want


def test_large_group_is_not_all_its_pairs(spark, monkeypatch):
    """Near copies that grow with the table send links in proportion, not the square of their number."""
    rng, n = random.Random(9), 150
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join([*words[:k], f"other{k}", *words[k + 1 :]]) for k in range(n)]
    sent, real = [], simhash.near_edges
    monkeypatch.setattr(simhash, "near_edges", lambda *a: sent.append(real(*a)) or sent[-1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.near_duplicates(docs).collect()) == [(k, 0) for k in range(1, n)]
    tasks = sent[0].rdd.getNumPartitions()
    assert sent[0].count() < n * tasks < n * (n - 1) / 8
