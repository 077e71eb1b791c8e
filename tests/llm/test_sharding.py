import hashlib
from collections import Counter

import pytest

from vecloom.llm import sharding


def test_table_by_claims_in_turn():
    names, size = sharding.shard_names(5), 101
    prefs = []
    for s in names:
        h = hashlib.md5(s.encode()).hexdigest()
        off, skip = int(h[:15], 16) % size, int(h[15:30], 16) % (size - 1) + 1
        prefs.append([(off + j * skip) % size for j in range(size)])
    table, turn = {}, 0
    while len(table) < size:
        s = turn % 5
        slot = next(x for x in prefs[s] if x not in table)
        table[slot] = s
        turn += 1
    assert sharding.lookup_table(names, size) == [table[i] for i in range(size)]


def test_even_and_stable():
    names = sharding.shard_names(64)
    before, after = sharding.lookup_table(names), sharding.lookup_table(names[:-1])
    assert max(Counter(before).values()) - min(Counter(before).values()) <= 1
    assert sum(a != b and a != 63 for a, b in zip(before, after)) < 0.25 * sharding.SIZE


def test_rows(docs, rows):
    got = sharding.shard(docs, "doc_id", sharding.shard_names()).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    table = sharding.lookup_table(sharding.shard_names())
    for r in got:
        slot = int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:15], 16) % sharding.SIZE
        assert (r["slot"], r["shard"]) == (slot, sharding.shard_names()[table[slot]])


def test_bad_sizes():
    with pytest.raises(ValueError):
        sharding.lookup_table(sharding.shard_names(4), 100)


def test_empty(empty):
    assert sharding.shard(empty, "doc_id", sharding.shard_names()).count() == 0


@pytest.mark.parametrize("key,want", [("slot", ["slot", "slot_", "shard"]), ("shard", ["shard", "slot", "shard_"]), ("a.b", ["a.b", "slot", "shard"])])
def test_clashing_key_names(spark, key, want):
    df = spark.createDataFrame([(i, i) for i in range(40)], f"`{key}` long, slot_x long")
    got = sharding.shard(df, key, sharding.shard_names(5), 101)
    plain = sharding.shard(spark.createDataFrame([(i,) for i in range(40)], "id long"), "id", sharding.shard_names(5), 101)
    assert got.columns == want and Counter(tuple(r) for r in got.collect()) == Counter(tuple(r) for r in plain.collect())
