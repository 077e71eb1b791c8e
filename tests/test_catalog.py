"""Every query of the catalog against its SQL; those without SQL against exact searches or their own rules."""

import numpy as np
import pytest
from compare import assert_same, database

from vecloom import catalog
from vecloom.plans.extra_queries import click_rows

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, con, name):
    assert_same(catalog.queries()[name](spark, sf_dir), con, SQL[name])


def pairs(spark, sf_dir, name):
    return {(r["query_id"], r["vec_id"]) for r in catalog.queries()[name](spark, sf_dir).collect()}


@pytest.mark.parametrize("name", ["knn_int8", "knn_binary_hamming", "knn_lsh_fixed_planes", "knn_ivf_label_centroids", "kmeans_ivf", "knn_ivf_pq"])
def test_recall_of_approximate_searches(spark, sf_dir, name):
    """Mean recall over the whole query set against all rows."""
    want = pairs(spark, sf_dir, "knn_batch" if name in ("knn_int8", "knn_binary_hamming", "knn_lsh_fixed_planes") else "knn_batch_l2")
    got = pairs(spark, sf_dir, name)
    assert len(want & got) >= 0.9 * len(want)


def test_compare_methods(spark, sf_dir):
    got = {r["method"]: r for r in catalog.queries()["compare_methods"](spark, sf_dir).collect()}
    assert len(got) == 7 and got["knn_pq"]["recall"] == 1.0 and all(r["recall"] >= 0.9 for r in got.values()), got


def test_parameter_grid(spark, sf_dir):
    """A wider radius finds no less; half of the bits find nearly all."""
    got = [r["recall"] for r in catalog.queries()["parameter_grid"](spark, sf_dir).orderBy("share").collect()]
    assert got == sorted(got) and got[-1] > 0.9 > got[0]


def test_html_extract(spark, sf_dir):
    """Against a pass over the page's tags by hand."""
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in catalog.queries()["html_extract"](spark, sf_dir).collect()}
    assert set(got) == set(pages)
    for i, r in got.items():
        assert "<script" not in r["text"] and all(x.startswith("http") for x in r["links"]) and len(r["links"]) == len(set(r["links"]))
        title = re.search(r"<title>(.*?)</title>", pages[i] or "", re.S)
        assert r["title"] == (html.unescape(title[1]).strip() if title else "")
        bare = re.sub(r"(?s)<!--.*?-->|<(script|style|noscript|head|svg|template)\b.*?</\1\s*>", " ", pages[i] or "")
        words = html.unescape(re.sub(r"(?s)<[^>]*>", " ", bare)).split()
        assert r["text"].split() == words or abs(len(r["text"].split()) - len(words)) <= 2, i


def test_recursive_chunks(spark, sf_dir):
    """Chunks without what each repeats of the one before hold all words of the text, in order; none is longer than allowed unless it is one word."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {}
    for r in catalog.queries()["recursive_chunks"](spark, sf_dir).orderBy("doc_id", "chunk").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    for i, text in texts.items():
        chunks = got.get(i, [])
        bodies = chunks[:1] + [c[min(50, len(a if k == 0 else a[min(50, len(chunks[k - 1])) :])) :] for k, (a, c) in enumerate(zip(chunks, chunks[1:]))]
        assert "".join("".join(bodies).split()) == "".join(text.split()) or not text.strip() or set(".!?,").intersection(text), i
        assert all(len(c) <= 550 or " " not in c[50:].strip() for c in chunks)


def test_token_chunks(spark, sf_dir):
    """Windows put together without what they share are the text."""
    from vecloom.plans import text_queries

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {}
    for r in catalog.queries()["token_chunks"](spark, sf_dir).orderBy("doc_id", "chunk").collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == {i for i, t in texts.items() if t}
    for i, rows in got.items():
        assert [r["chunk"] for r in rows] == list(range(len(rows))) and all(r["tokens"] == 512 for r in rows[:-1])
        if len(rows) == 1:
            assert rows[0]["text"] == texts[i]
    assert text_queries.token_windows(list(range(10)), 4, 1) == [[0, 1, 2, 3], [3, 4, 5, 6], [6, 7, 8, 9]]
    assert text_queries.token_windows([1, 2], 4, 1) == [[1, 2]] and text_queries.token_windows([], 4, 1) == [[]]


def test_contextual_chunks(spark, sf_dir):
    plain = {(r["doc_id"], r["chunk"]): r["text"] for r in catalog.queries()["recursive_chunks"](spark, sf_dir).collect()}
    got = {(r["doc_id"], r["chunk"]): r["text"] for r in catalog.queries()["contextual_chunks"](spark, sf_dir).collect()}
    assert set(got) == set(plain) and all(got[k].endswith(t) and (got[k] == t or got[k].startswith("Summary: ")) for k, t in plain.items())


def test_token_bucket(spark, sf_dir):
    """Request by request."""
    want, state = {}, {}
    for r in spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("user_id", "ts", "event_id").collect():
        level, last = state.get(r["user_id"], (4.0, r["ts"]))
        level = min(4.0, level + (r["ts"] - last).total_seconds() / 1800)
        want[r["event_id"]] = level >= 1
        state[r["user_id"]] = (level - (level >= 1), r["ts"])
    assert {r["event_id"]: r["allowed"] for r in catalog.queries()["token_bucket"](spark, sf_dir).collect()} == want


def test_view_clusters(spark, sf_dir):
    """In order of id each vector joins the first cluster whose first member is near."""
    want = {}
    heads = {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect(), key=lambda r: r["vec_id"]):
        v = np.array(r["embedding"], float)
        v /= np.linalg.norm(v)
        found = next((i for i, h in heads.get(r["label"], []) if h @ v >= 0.3), None)
        if found is None:
            heads.setdefault(r["label"], []).append((r["vec_id"], v))
            found = r["vec_id"]
        want[(r["label"], found)] = want.get((r["label"], found), 0) + 1
    assert {(r["label"], r["cluster"]): r["size"] for r in catalog.queries()["view_clusters"](spark, sf_dir).collect()} == want


def clicks(spark, sf_dir):
    rows = click_rows(spark, sf_dir).toPandas()
    return rows, rows[["n_chars", "day", "value"]].to_numpy(float), rows["y"].to_numpy()


def test_ltr_linear(spark, sf_dir):
    """Ridge weights of standardised columns by the normal equations."""
    rows, x, y = clicks(spark, sf_dir)
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z / len(z) + 1e-3 * np.eye(3), z.T @ (y - y.mean()) / len(z))
    got = {r["feature"]: r["weight"] for r in catalog.queries()["ltr_linear"](spark, sf_dir).collect()}
    assert np.allclose([got[n] for n in ("n_chars", "day", "value")], want, atol=1e-6)


@pytest.mark.parametrize("name", ["ltr_mlp", "ltr_pairwise", "ltr_trees"])
def test_ranking_models(spark, sf_dir, name):
    """Every row is scored, and scores rank clicks no worse than chance on the rows the model was fitted to."""
    rows, _, y = clicks(spark, sf_dir)
    got = {r["event_id"]: r["score"] for r in catalog.queries()[name](spark, sf_dir).collect()}
    assert set(got) == set(rows["event_id"])
    s = np.array([got[i] for i in rows["event_id"]])
    above = (s[y == 1][:, None] > s[y == 0]).mean() + (s[y == 1][:, None] == s[y == 0]).mean() / 2
    assert above >= 0.5


def test_ranking_models_learn():
    """On held-out rows of a rule that they can express."""
    from vecloom.operators import ranking

    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 3))
    y = (x[:, 0] - 2 * x[:, 1] > 0).astype(float)
    for fit in (ranking.fit_mlp, ranking.fit_pairwise):
        s = fit(x[:1000], y[:1000])(x[1000:])
        assert (s[y[1000:] == 1][:, None] > s[y[1000:] == 0]).mean() > 0.9
        assert len(fit(np.zeros((0, 3)), np.zeros(0))(x[:4])) == 4


def test_bradley_terry(spark, sf_dir):
    """At the maximum each kind wins as often as its strength says."""
    counts = {(r["better"], r["worse"]): r["n"] for r in catalog.queries()["preference_counts"](spark, sf_dir).collect()}
    w = {r["kind"]: r["strength"] for r in catalog.queries()["bradley_terry"](spark, sf_dir).collect()}
    total = sum(counts.values())
    for k in w:
        won = sum(n for (a, _), n in counts.items() if a == k)
        expected = sum(n / (1 + np.exp(w[o] - w[k])) for (a, b), n in counts.items() if k in (a, b) for o in [b if a == k else a])
        assert abs(won - expected) < 0.002 * total


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0


def test_compare_methods_searches_exactly_once(spark, sf_dir, monkeypatch):
    """One exact search for each metric, whatever the number of methods."""
    from vecloom.plans import vector_queries

    made = []
    for name in ("knn_batch", "knn_batch_l2"):
        whole = vector_queries.REG.queries[name]
        monkeypatch.setitem(vector_queries.REG.queries, name, lambda s, d, name=name, whole=whole: made.append(name) or whole(s, d))
    assert catalog.queries()["compare_methods"](spark, sf_dir).count() == 7 and sorted(made) == ["knn_batch", "knn_batch_l2"]
