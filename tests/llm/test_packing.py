import random
from collections import Counter, defaultdict

from vecloom.llm import packing, records


def tokens_of(text):
    """The number of tokens that the default measure counts."""
    with open(records.ranks_path(), "rb") as f:
        return len(records.encoder(f.read()).encode_ordinary(text))


def bytes_of(text):
    return len(text.encode())


def check_bins(pieces, texts, capacity, size=tokens_of):
    """Every token of every text lies in one place, no bin overflows, offsets don't overlap."""
    bins, seen = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert 0 < p["length"] <= capacity
        bins[p["bin_id"]].append((p["offset"], p["length"]))
        seen[p["doc_id"]].append((p["start"], p["length"]))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    want = Counter()
    for doc_id, text in texts:
        want[doc_id] += size(text) if text else 0
    assert {k: sum(n for _, n in v) for k, v in seen.items()} == {k: n for k, n in want.items() if n}
    assert sorted(bins) == list(range(len(bins)))
    return bins


def simulated(counts, capacity):
    """Item by item: exact singles, pairs and triples from the longest down, then best fit; returns sorted bins."""
    left, bins = Counter(counts), []

    def exact(length):
        gap = capacity - length
        if gap == 0:
            return (length,)
        options = [(gap,)]
        options += [(a, gap - a) for a in range(min(length, gap - 1), 0, -1) if 2 * a >= gap]
        options += [(a, b, gap - a - b) for a in range(min(length, gap - 2), 0, -1) for b in range(min(a, gap - a - 1), 0, -1) if a >= b >= gap - a - b > 0]
        for o in options:
            if not (Counter((length, *o)) - left):
                return (length, *o)
        return None

    for length in sorted(counts, reverse=True):
        while left[length]:
            found = exact(length)
            if not found:
                break
            left.subtract(found)
            bins.append(tuple(sorted(found, reverse=True)))
    open_ = []
    for length in sorted(left.elements(), reverse=True):
        fits = [b for b in open_ if capacity - sum(b) >= length]
        if fits:
            min(fits, key=lambda b: capacity - sum(b)).append(length)
        else:
            open_.append([length])
    return sorted(bins), open_


def test_plan_against_item_by_item():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.choice([10, 16, 33])
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 40)))
        exact, rest = packing.exact_patterns(dict(counts), capacity)
        bins, open_ = simulated(counts, capacity)
        assert sorted(p for p, n in exact for _ in range(n)) == bins
        fitted = packing.best_fit(rest, capacity)
        assert sorted(Counter(x for p, n in fitted for x in p for _ in range(n)).items()) == sorted((Counter(x for b in open_ for x in b)).items())
        assert sum(n for _, n in fitted) == len(open_)


def test_pack(docs, rows):
    got = packing.pack(docs, capacity=500, measure="bytes").collect()
    check_bins(got, [(r[0], r[1]) for r in rows], 500, bytes_of)


def test_pack_tokens(docs, rows):
    got = packing.pack(docs, capacity=200).collect()
    check_bins(got, [(r[0], r[1]) for r in rows], 200)


def test_empty(empty):
    assert packing.pack(empty).count() == 0


def test_bins_follow_the_order_of_the_rows(spark, tmp_path):
    """Each run of rows fills bins of its own, numbered by run and then by first row; equal lengths keep their order."""
    rng = random.Random(4)
    texts = [(i, "x" * rng.randint(0, 45)) for i in rng.sample(range(100), 97)] + [(None, "y" * 9), (200, None)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.createDataFrame(texts, "doc_id long, text string").repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/seven")
    for name, order in (("one", texts), ("seven", sorted(texts, key=lambda r: (r[0] is not None, r[0])))):
        at = {doc: i for i, (doc, _) in enumerate(order)}
        pieces = [r.asDict() for r in packing.pack_in_order(spark.read.parquet(f"{tmp_path}/{name}"), 20, "bytes", 10).collect()]
        check_bins(pieces, texts, 20, bytes_of)
        inside = defaultdict(set)
        for p in pieces:
            inside[p["bin_id"]].add(at[p["doc_id"]])
        assert all(len({i // 10 for i in v}) == 1 for v in inside.values())
        firsts = [min(inside[b]) for b in sorted(inside)]
        assert firsts == sorted(firsts)
        sizes = [sum(p["length"] for p in pieces if p["bin_id"] == b) for b in inside]
        assert sum(sizes) / (20 * len(sizes)) > 0.85


def test_in_order_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none")
    assert packing.pack_in_order(spark.read.parquet(f"{tmp_path}/none")).count() == 0
