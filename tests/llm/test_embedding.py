import numpy as np

from vecloom.llm import embedding
from tests_llm_groups import groups


def planted(seed=2, n=150, dim=64):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim))
    for i in range(0, n, 3):
        v[i + 1] = v[i] + rng.standard_normal(dim) * rng.uniform(0.02, 0.6)  # on both sides of the threshold
    v[10] = v[4] * 3
    return v


def brute(rows, least):
    """{id: kept id} for ids that go."""
    unit = {i: np.array(x) / np.linalg.norm(x) for i, x in rows if i is not None and x and all(y is not None and np.isfinite(y) for y in x) and np.any(x)}
    near = lambda a, b: len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= least
    return {k: r for k, r in groups(list(unit), near).items() if k != r}


def check(spark, rows, **parameters):
    df = spark.createDataFrame([(i, x, i, "a", "b") for i, x in rows], "vec_id long, embedding array<double>, label long, id string, v string").repartition(3)
    got = embedding.near_duplicates(df, **parameters).collect()
    assert len(got) == len({r[0] for r in got})
    assert {r["vec_id"]: r["duplicate_of"] for r in got} == brute(rows, parameters.get("least_cosine", embedding.LEAST_COSINE))
    return got


def test_against_all_pairs(spark):
    got = check(spark, [(i, x.tolist()) for i, x in enumerate(planted())])
    assert len(got) > 20


def test_odd_dimensions_and_thresholds(spark):
    check(spark, [(i, x.tolist()) for i, x in enumerate(planted(3, 90, 13))], least_cosine=0.8, block=5)


def test_pieces_and_large_near_groups(spark, monkeypatch):
    """Cells split into pieces of a few rows, and groups of near vectors that aren't expanded into their pairs."""
    for name, value in (("CELL_ROWS", 10), ("OWN_ROWS", 7), ("BALL_ROWS", 11)):
        monkeypatch.setattr(embedding, name, value)
    rng = np.random.default_rng(6)
    v = np.concatenate([planted(5, 60, 24), rng.standard_normal(24) + rng.standard_normal((80, 24)) * 0.12])
    check(spark, [(i, x.tolist()) for i, x in enumerate(v)], block=6)


def test_all_pairs_and_forest(spark):
    """Every near pair once; the forest's edges are some of them, at most one fewer than the vectors in every task."""
    rng = np.random.default_rng(8)
    v = rng.standard_normal(16) + rng.standard_normal((40, 16)) * rng.uniform(0.05, 0.5, (40, 1))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if unit[a] @ unit[b] >= 0.9}
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = [(r["a"], r["b"]) for r in embedding.near_pairs(df, 0.9, block=8).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {(r["a"], r["b"]) for r in embedding.near_pairs(df, 0.9, block=8, forest=True).collect()} <= want


def test_edges(spark):
    v = planted(4, 12, 64).tolist()
    rows = [(i, x) for i, x in enumerate(v)] + [(100, None), (101, []), (102, [0.0] * 64), (103, [float("nan")] * 64), (104, v[0][:8]), (105, [None, *v[0][1:]]), (None, v[0]), (106, v[5]), (107, v[5]), (107, v[5])]
    got = check(spark, rows)
    assert {"vec_id": 107, "duplicate_of": 5} in [r.asDict() for r in got]


def test_classes(spark):
    """One row for each id, with the class of all pairs and its size."""
    rows = [(i, x.tolist()) for i, x in enumerate(planted(9, 60, 16))] + [(100, None), (101, [0.0] * 16), (None, [1.0] * 16), (5, [2.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    went = {r["vec_id"]: r["duplicate_of"] for r in embedding.near_duplicates(df).collect()}
    got = {r["vec_id"]: (r["class_id"], r["members"]) for r in embedding.classes(df).collect()}
    ids = {i for i, _ in rows if i is not None}
    assert set(got) == ids and went
    for i in ids:
        kept = went.get(i, i)
        assert got[i] == (kept, 1 + sum(k == kept for k in went.values()))


def test_empty(spark):
    nothing = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding.near_duplicates(nothing).count() == 0 and embedding.classes(nothing).count() == 0


def test_rotation_keeps_distances():
    m = embedding.rotation(64)
    assert np.allclose(m @ m.T, np.eye(64))
    assert sum(b - a for a, b in embedding.block_bounds(13, 5)) == 13
