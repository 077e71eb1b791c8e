from collections import Counter, defaultdict

import pytest

from vecloom.llm import mixing


def simulated(blocks, weights, quantum, least_live):
    """Slot by slot: the released block of earliest deadline, phases restarting when a source runs out."""
    live = sorted(s for s in blocks if blocks[s] > 0 and weights[s] > 0)
    total, out, done, at = sum(weights[s] for s in live), {}, Counter(), 0
    while live and sum(weights[s] for s in live) >= least_live * total:
        q = quantum
        while q < 10 * len(live):
            q *= 10
        parts = dict(zip(live, mixing.quantised([weights[s] for s in live], q)))
        inside, t = Counter(), 0
        while True:
            ready = [(-((inside[s] + 1) * -q // parts[s]), s) for s in live if inside[s] * q // parts[s] <= t]
            _, s = min(ready)
            if done[s] >= blocks[s]:
                break
            out[at] = (s, done[s])
            done[s] += 1
            inside[s] += 1
            t += 1
            at += 1
            assert all(abs(inside[x] - t * parts[x] / q) < 1 for x in live)  # less than a block off its target
        live = [s for s in live if done[s] < blocks[s]]
    return out


@pytest.mark.parametrize("quantum,block,alpha", [(20, 2, 0.7), (100, 1, 1.0), (30, 8, 0.3)])
def test_schedule(docs, rows, quantum, block, alpha):
    got = mixing.mix(docs, block_docs=block, alpha=alpha, quantum=quantum).collect()
    counts = Counter(r[3] or "" for r in rows)
    want = simulated({s: -(-n // block) for s, n in counts.items()}, mixing.target_weights(counts, alpha), quantum, mixing.LEAST_LIVE)
    slots = defaultdict(set)
    for r in got:
        if r["slot"] is not None:
            slots[r["slot"]].add((r["source"] or "", r["block"]))
    assert {k: v for k, v in slots.items()} == {k: {v} for k, v in want.items()}
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter((r[0], r[3]) for r in rows)
    places = Counter((r["source"], r["block"], r["position"]) for r in got)
    assert max(places.values()) == 1 and all(0 <= r["position"] < block for r in got)


def test_drawn(docs, rows):
    got = mixing.drawn(docs, block_docs=2, quantum=20)
    assert got.columns == docs.columns
    have = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert not have - Counter((r[0], r[1]) for r in rows) and have


def test_given_weights(docs):
    got = mixing.mix(docs, weights={"s0": 0.5, "s1": 0.5}, block_docs=1, quantum=10).filter("slot is not null")
    assert {r[0] for r in got.select("source").distinct().collect()} == {"s0", "s1"}


def test_empty(empty):
    assert mixing.mix(empty).count() == 0 and mixing.drawn(empty).count() == 0


@pytest.mark.parametrize("weights", [{"a": 0.999, "b": 0.001}, mixing.target_weights({"hot": 5_000_000, **{f"s{i:03}": 5_000 for i in range(200)}})])
def test_deviation_from_target_weights(weights):
    """Less than a block from the given weights, however long the schedule."""
    got, slots = Counter(), 40_000
    for source, block, slot in mixing.schedule(dict.fromkeys(weights, 10**9), weights):
        assert block == got[source]
        got[source] += 1
        if slot % 1000 == 999:
            assert all(abs(got[s] - (slot + 1) * w) < 1 + 1e-6 for s, w in weights.items())
        if slot + 1 == slots:
            break
    assert sum(got.values()) == slots


def test_shuffled_schedule(docs, monkeypatch):
    """The join that isn't broadcast gives the same places."""
    want = mixing.mix(docs, block_docs=2).collect()
    monkeypatch.setattr(mixing, "FEW_BLOCKS", 0)
    assert Counter(mixing.mix(docs, block_docs=2).collect()) == Counter(want)


def test_every_document_is_drawn(spark, docs, rows):
    """A hot source, too, is used up after the others have run out."""
    hot = spark.createDataFrame([(i, f"text {i}", "hot" if i % 10 else f"s{i % 40}") for i in range(2000)], "doc_id long, text string, source string")
    got = mixing.mix(hot).collect()
    assert all(r["slot"] is not None for r in got) and len({(r["slot"], r["position"]) for r in got}) == 2000
    assert Counter((r["doc_id"], r["text"]) for r in mixing.drawn(docs).collect()) == Counter((r[0], r[1]) for r in rows)


def test_clashing_column_names(spark, rows):
    """Columns may bear the names that the plan used inside, whatever their case."""
    names = ["p", "s", "b", "t", "j", "k2", "s2", "__at", "__salt", "__n", "__before", "__g0", "Slot", "position", "__AT"]
    names = [n for i, n in enumerate(names) if n.lower() not in [m.lower() for m in names[:i]]]
    df = spark.createDataFrame([(*r[:2], r[3], *range(len(names))) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    got = mixing.drawn(df, block_docs=2)
    assert got.columns == df.columns
    assert Counter(tuple(r) for r in got.collect()) == Counter(tuple(r) for r in df.collect())
    assert mixing.mix(df).count() == len(rows)
