"""Operators on small tables: truth tables, parser, planner, ranking, sources, plans."""

import subprocess
import sys
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecloom import catalog
from vecloom.functions import text as T
from vecloom.functions import vectors as V
from vecloom.functions.predicates import Filter
from vecloom.operators import graph, knn, retrieval, series
from vecloom.plans import dsl
from vecloom.plans.text_queries import recursive_split
from vecloom.sources import tables


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, "new", 5, "{}"), (2, "old", None, "{}"), (3, None, 9, "{}"), (4, "new", 7, None)], "id int, status string, count int, meta string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize(
    "f,want",
    [
        (Filter.eq("status", "new"), [1]),
        (Filter.ne("status", "new"), [2, 3]),
        (~Filter.eq("status", "new"), [2, 3]),
        (Filter.of("count", "gt", 5), [3]),
        (~Filter.of("count", "gt", 5), [1, 2]),
        (Filter.of("status", "in", ["new", "x"]), [1]),
        (Filter.of("status", "nin", ["new"]), [2, 3]),
        (Filter.of("count", "exists", True), [1, 3]),
        (Filter.of("count", "exists", False), [2]),
        (Filter.of("status", "contains", "l"), [2]),
        (Filter.of("status", "regex", "^n"), [1]),
        (Filter.eq("status", "old") | Filter.eq("count", 9), [2, 3]),
        (Filter.from_dict({"status": "new", "count": {"$gte": 5, "$odd": 1}}), [1]),
        (Filter.of("status", "gt", 3), []),
    ],
)
def test_predicates(rows, f, want):
    """A row without metadata fails every predicate, negated or not; a missing value is no match."""
    assert ids(rows.filter(f.column(metadata=F.col("meta")))) == want


def test_unknown_operator_and_empty_dictionary():
    assert Filter.from_dict({}) is None
    with pytest.raises(ValueError):
        Filter.of("a", "like", 1).column()


@pytest.mark.parametrize(
    "text,want",
    [
        ("count < 8", [1, 4]),
        ("NOT count > 6", [1, 2]),
        ('status = "new" AND count = 5 OR count = 9', [1, 3]),
        ('status = "new" AND (count = 5 OR count = 9)', [1]),
        ("status != 'new'", [2, 3]),
        ("status in 'new and old'", [1, 2, 4]),
        ('status contains "e"', [1, 4]),
        ('semantic_match("x", 5) AND count >= 7', [3, 4]),
        ('NOT semantic_match("x")', []),
    ],
)
def test_query_language(rows, text, want):
    assert ids(rows.filter(dsl.predicate(dsl.parse(text)))) == want


@pytest.mark.parametrize("text", ["price <", "AND", "(a = 1", "a ~ 1", "a = 1 b = 2", "semantic_match(", ""])
def test_syntax_faults(text):
    with pytest.raises(dsl.SyntaxFault):
        dsl.parse(text)


def test_planner():
    assert dsl.plan("a = 1")[1].strategy == "filter_only"
    assert dsl.plan('semantic_match("x")')[1].strategy == "vector_only"
    assert dsl.plan('a = 1 AND semantic_match("x", 3)', {"a": {"distinct": 100}})[1].strategy == "filter_first"
    plan = dsl.plan('a != 1 AND semantic_match("x", 3)')[1]
    assert (plan.strategy, plan.search[0].k, plan.overfetch) == ("vector_first", 3, 5)
    assert dsl.selectivity(dsl.parse("a = 1 OR b < 2")) == pytest.approx(0.05 + 0.33 - 0.05 * 0.33)


def test_distances(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = df.select(V.cosine_similarity(a, b), V.distance(a, b, "euclidean"), V.distance(a, b, "dot"), V.norm(V.normalized(a))).collect()
    assert [round(x, 6) for x in got[0]] == [0.96, round(2**0.5, 6), -24.0, 1.0]
    assert [round(x, 6) for x in got[1]] == [0.0, 1.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        V.distance(a, b, "other")


def test_batch_over_many_blocks(spark):
    """Blocks of a few rows, ties among copies, zero vectors; against all pairs."""
    rng = np.random.default_rng(1)
    m = rng.standard_normal((60, 6)).round(1)
    m[20:26] = m[3]
    m[40] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, embedding array<double>")
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    d = np.round(1 - unit @ unit.T, 9)
    for metric in ("cosine", "euclidean"):
        if metric == "euclidean":
            d = np.round(np.linalg.norm(m[:, None] - m, axis=2), 9)
        got = {}
        for r in knn.batch(df, df, 5, metric, block_rows=7).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["distance"]))
        for i in range(60):
            want = sorted((round(d[i, j], 6), j) for j in range(60) if j != i)[:5]
            assert [j for _, j, _ in sorted(got[i])] == [j for _, j in want] or [round(x, 6) for _, _, x in sorted(got[i])] == [x for x, _ in want]


def test_bm25_order(spark):
    docs = spark.createDataFrame([(1, "cat cat cat dog"), (2, "the dog chased the cat"), (3, "the bird flew over the mat"), (4, ""), (5, None)], "doc_id long, text string")
    assert [r["doc_id"] for r in retrieval.top(retrieval.bm25(docs, ["cat"]), 5).collect()] == [1, 2]
    assert [r["doc_id"] for r in retrieval.bm25_phrases(docs, ["the"], ["the mat"]).collect()] == [3]
    assert "Exchange hashpartitioning" not in retrieval.bm25(docs, ["cat"])._jdf.queryExecution().toString()


def test_metrics(spark):
    run = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "query_id long, doc_id long, rank long")
    relevant = spark.createDataFrame([(1, 11, 2), (1, 13, 1), (3, 1, 1)], "query_id long, doc_id long, grade int")
    got = {r["query_id"]: r for r in retrieval.metrics(run, relevant, 3).collect()}
    assert set(got) == {1, 3} and got[3]["mrr"] == 0.0
    assert (got[1]["recall"], got[1]["precision"], got[1]["mrr"]) == (0.5, 0.333333, 0.5)
    assert got[1]["ndcg"] == pytest.approx((2 / np.log2(3)) / (2 + 1 / np.log2(3)), abs=1e-5)


def test_anchored_windows(spark):
    df = spark.sql("select 1L u, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, h) ts from values (0), (1), (2), (3), (9) t(h)")
    got = [(r["window_end"] - r["window_start"], r["events"]) for r in series.anchored_windows(df, "u", "ts", 7200).orderBy("window_start").collect()]
    assert got == [(3 * 3600e6, 3), (6 * 3600e6, 1), (0, 1)]


def test_graph_rounds(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0)], "a long, b long, weight double")
    labels = spark.createDataFrame([(1, 7), (4, 8)], "node long, label int")
    got = {r["node"]: r["label"] for r in graph.label_propagation(edges, labels, 1).collect()}
    assert got == {1: 7, 2: 7, 3: 8, 4: 8}
    rank = {r["node"]: r["rank"] for r in graph.pagerank(edges, labels.select("node", F.lit(1.0).alias("p")), 5).collect()}
    assert sum(rank.values()) == pytest.approx(1.0)


def test_text_functions(spark):
    df = spark.createDataFrame([("Mail a.b@c.org or 555-123-4567, ssn 123-45-6789, ip 10.0.0.1, zip 12345.", "HTTPS://Ex.org?utm_source=x&b=2&a=1#top")], "t string, u string")
    row = df.select(T.redact(F.col("t")), T.canonical_url(F.col("u")), T.highlight(F.col("t"), ["mail"]), T.intent(F.lit("how so"))).first()
    assert row[0] == "Mail [EMAIL] or[PHONE], ssn [SSN], ip [IP], zip [ZIP]." or row[0] == "Mail [EMAIL] or [PHONE], ssn [SSN], ip [IP], zip [ZIP]."
    assert row[1] == "https://ex.org/?a=1&b=2" and row[2].startswith("**Mail**") and row[3] == "QA"


def test_recursive_split():
    text = "\n\n".join("word " * 60 for _ in range(5)).strip()
    pieces = recursive_split(text, 320, 10)
    assert all(len(p) <= 330 for p in pieces) and pieces[1].startswith(pieces[0][-10:]) and recursive_split("") == []


def test_sources(spark, tmp_path):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    change = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, tables.upsert(base, change, "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert ids(tables.delete(base, change, "id")) == [1]
    assert [r["id"] for r in tables.page(base, ["id"], 1, 1).collect()] == [2]
    (tmp_path / "qrels").mkdir()
    (tmp_path / "queries.jsonl").write_text('{"_id": "q1", "text": "x"}\n')
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d1", "title": "t", "text": "x"}\n')
    (tmp_path / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t1\n")
    q, c, r = tables.read_beir(spark, str(tmp_path))
    assert (q.count(), c.count(), r.first()["score"]) == (1, 1, 1)
    (tmp_path / "feed.xml").write_text("<rss><channel><item><link>http://a</link><title>T</title><description>D</description></item><item><title>no link</title></item></channel></rss>")
    assert [tuple(x) for x in tables.read_feed(spark, str(tmp_path / "feed.xml")).collect()] == [("http://a", "T", "D")]
    (tmp_path / "map.xml").write_text("<urlset><url><loc>http://a</loc><lastmod>2024</lastmod></url></urlset>")
    assert tables.read_sitemap(spark, str(tmp_path / "map.xml")).first()["url"] == "http://a"


def test_more_sources(spark, tmp_path):
    (tmp_path / "atom.xml").write_text('<feed><entry><id>urn:1</id><title>T</title><link href="http://a" rel="alternate"/><summary>S</summary></entry><entry><id>urn:2</id><content>C</content></entry></feed>')
    assert sorted(tuple(x) for x in tables.read_atom(spark, str(tmp_path / "atom.xml")).collect()) == [("http://a", "T", "S"), ("urn:2", None, "C")]
    (tmp_path / "index.xml").write_text("<sitemapindex><sitemap><loc> http://a/1.xml </loc></sitemap><sitemap><loc>http://a/2.xml</loc></sitemap></sitemapindex>")
    assert [r["url"] for r in tables.read_sitemap_index(spark, str(tmp_path / "index.xml")).collect()] == ["http://a/1.xml", "http://a/2.xml"]
    df = spark.createDataFrame([(1, "x"), (2, None)], "id long, v string")
    tables.write_jsonl(df, str(tmp_path / "log"))
    assert sorted(map(tuple, tables.read_jsonl(spark, str(tmp_path / "log"), "id long, v string").collect())) == [(1, "x"), (2, None)]
    import pyarrow.parquet as pq

    assert pq.read_table(tables.export_arrow(df, str(tmp_path / "export"))).num_rows == 2


def test_nearest_rank_by_sorting(spark):
    """Hot values, few values, no key, and keys with one row."""
    rng = np.random.default_rng(4)
    rows = [("a", float(x)) for x in rng.integers(0, 5, 900)] + [("a", float(x)) for x in rng.normal(size=701)] + [("b", 3.0)] * 50 + [("c", 1.5), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    for keys in (["k"], []):
        got = series.nearest_rank(df, "v", shares, keys).collect()
        assert len(got) == (3 if keys else 1)
        for r in got:
            v = sorted(x for k, x in rows if x is not None and (not keys or k == r["k"]))
            assert [r[n] for n in shares] == [v[min(int(len(v) * p), len(v) - 1)] for p in shares.values()] and r["n"] == len(v) and r["max"] == v[-1]


def test_redaction_at_every_depth(spark):
    df = spark.sql("select struct('n' as name, array(struct('p' as phone, 1 as x)) as calls, map('email', 'e', 'k', 'v') as more) as r")
    got = df.select(T.redact_fields(F.col("r"), df.schema["r"].dataType, {"name": "[N]", "phone": "[P]", "email": "[E]"}).alias("r")).first()["r"].asDict(True)
    assert got == {"name": "[N]", "calls": [{"phone": "[P]", "x": 1}], "more": {"email": "[E]", "k": "v"}}


def test_scan_is_pruned(spark, sf_dir):
    """Columns and predicates reach the scan."""
    f = Filter.of("p_size", "gt", 40).column()
    plan = spark.read.parquet(f"{sf_dir}/part.parquet").filter(f).select("p_partkey")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan


def test_imports_without_the_training_data_package(tmp_path):
    """The entry module works where the subpackage and the pipeline are missing."""
    root = Path(__file__).parent.parent
    code = f"""
import sys
sys.dont_write_bytecode = True
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("vecloom.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
sys.path.insert(0, {str(root)!r})
import __spark_entry__ as e
assert "rrf_hybrid" in e.queries() and not any(n.startswith("op") or n == "pipeline" for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True)


def test_product_quantisation_is_exact(spark):
    """Neighbours that the codes rank far down are found, for every query of the set."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16))
    v = tables.cut(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(3))
    books = knn.pq_train(v, 4, 4, rounds=3)
    got = {}
    for r in knn.pq_search(knn.query_set(v, 100), v, knn.pq_codes(v, books), books, 10).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    x = x.astype(np.float32).astype(np.float64)
    for q in range(0, 1500, 100):
        want = [j for j in np.argsort(((x - x[q]) ** 2).sum(1), kind="stable").tolist() if j != q][:10]
        assert [got[q][k] for k in range(1, 11)] == want


@pytest.mark.parametrize("dim", [1, 64, 65, 130, 768])
def test_sign_codes_hold_every_dimension(spark, dim):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(20, dim))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, v array<double>").select("i", V.sign_code(F.col("v")).alias("c"))
    codes = {r["i"]: r["c"] for r in df.collect()}
    for i in range(20):
        bits = [codes[i][d // 64] >> (d % 64) & 1 for d in range(dim)]
        assert bits == (x[i] > 0).astype(int).tolist() and len(codes[i]) == -(-dim // 64)
    h = df.alias("a").join(df.alias("b"), F.expr("a.i = 0")).select(F.col("b.i"), V.hamming(F.col("a.c"), F.col("b.c")).alias("h"))
    assert {r["i"]: r["h"] for r in h.collect()} == {i: int(((x[i] > 0) != (x[0] > 0)).sum()) for i in range(20)}


def test_binary_search_reads_every_dimension(spark):
    """Neighbours that differ from others only beyond the 64th dimension are found."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 128))
    x[:, :64] = np.abs(x[:, :64])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    bits = ((x[:, None] > 0) != (x > 0)).sum(2)
    got = {}
    for r in knn.binary_search(knn.query_set(df, 100), df, 3, 0.25).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q in range(0, 400, 100):
        inside = [j for j in np.argsort(1 - unit @ unit[q], kind="stable").tolist() if j != q and bits[q, j] <= 32][:3]
        assert [j for _, j in sorted(got.get(q, []))] == inside


def test_hot_cell_is_split(spark):
    """A key with most rows is several tasks, and every pair of a key meets once."""
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(i, rng.normal(size=3).tolist(), 0 if i % 10 else i) for i in range(200)], "vec_id long, embedding array<double>, cell long")
    each = lambda key, lid, a, rid, b: pa.table({"l": np.repeat(lid, len(rid)), "r": np.tile(rid, len(lid))})
    got = Counter((r["l"], r["r"]) for r in knn.meet(v, v, each, "l long, r long", "cell", 16).collect())
    cell = {i: 0 if i % 10 else i for i in range(200)}
    assert got == Counter((a, b) for a in range(200) for b in range(200) if cell[a] == cell[b])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name,pushed",
    [
        ("filter_builder_ops", ["GreaterThanOrEqual(p_size,10)", "LessThanOrEqual(p_size,30)"]),
        ("filter_from_dict", ["GreaterThanOrEqual(c_acctbal,1000.0)", "LessThan(c_acctbal,5000.0)", "Or(IsNull(c_mktsegment),Not(EqualTo(c_mktsegment,BUILDING)))", "In(c_nationkey"]),
        ("filter_regex", ["IsNotNull(p_brand)"]),
        ("dsl_and_or_not", ["LessThan(p_size,20)", "GreaterThanOrEqual(p_retailprice,1000.0)"]),
        ("row_level_security", ["Or(IsNull(o_orderstatus),Not(EqualTo(o_orderstatus,F)))"]),
    ],
)
def test_predicates_reach_the_scan(spark, sf_dir, name, pushed):
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    plan = plan_of(catalog.queries()[name](spark, sf_dir))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = " ".join(x for x in plan.splitlines() if "PushedFilters" in x)
    assert all(p in scans for p in pushed), scans


def test_probe_reads_only_its_cells(spark, tmp_path):
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(i, (np.eye(4)[i % 4] * 9 + rng.normal(size=4) * 0.1).tolist(), i % 4) for i in range(80)], "vec_id long, embedding array<double>, label long")
    knn.write_index(v.select("vec_id", "embedding"), knn.centroids(v, "label"), str(tmp_path / "index"))
    found = knn.ivf_one([9.0, 0.0, 0.0, 0.0], knn.read_index(spark, str(tmp_path / "index")), 1, 5)
    assert all(r["vec_id"] % 4 == 0 for r in found.collect()) and found.count() == 5
    assert "PartitionFilters: [isnotnull(cell" in plan_of(found) or "cast(cell" in plan_of(found).split("PartitionFilters", 1)[1].split("]")[0]


def test_sentence_chunks_are_linear(spark):
    """A text of four times as many sentences takes nowhere near sixteen times as long."""

    def took(n):
        df = spark.createDataFrame([(" ".join(f"Sentence number {i} is here." for i in range(n)),)], "t string").select(F.size(T.sentence_chunks(F.col("t"))).alias("n"))
        began = time.time()
        assert df.first()["n"] == -(-n // 4)
        return time.time() - began

    took(1000)
    assert took(16_000) < 8 * max(took(4_000), 0.25)


def test_planner_acts(spark, sf_dir):
    """A predicate that hardly any row passes: the answer is full while rows last, whatever the strategy."""
    from vecloom.plans import text_queries

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    passing = docs.filter("lang = 'fr' and source = 'src3'").count()
    got = text_queries.planned_search(spark, sf_dir, 'lang = "fr" AND source = "src3" AND semantic_match("q", 10)', {"lang": {"distinct": 1}, "source": {"distinct": 1}})
    rows = got.collect()
    assert {r["strategy"] for r in rows} == {"filter_first"} and all(r["lang"] == "fr" and r["source"] == "src3" for r in rows)
    assert len(rows) == min(passing, 10)


def test_product_codes_send_few_rows(spark):
    """Codes so coarse that they rule out hardly any row: what a block sends is still k rows a query, and copies tie by id."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[10:30] = x[0]
    v = tables.cut(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>"))
    books = knn.pq_train(v, 2, 2, rounds=1)
    sent = []
    keep = knn.best_of_each
    knn.best_of_each = lambda near, k: sent.append(near.count()) or keep(near, k)
    try:
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r["distance"]) for r in knn.pq_search(knn.query_set(v, 60), v, knn.pq_codes(v, books), books, 10).collect()}
    finally:
        knn.best_of_each = keep
    assert sent == [10 * 10]
    x = x.astype(np.float64)
    for q in range(0, 600, 60):
        d = np.round(np.linalg.norm(x - x[q], axis=1), 9)
        want = [j for j in np.lexsort((np.arange(600), d)).tolist() if j != q][:10]
        assert [got[q, k] for k in range(1, 11)] == [(j, d[j]) for j in want]


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
@pytest.mark.parametrize("size", [1e-30, 1.0, 1e30])
def test_screen_leaves_out_no_neighbour(metric, size):
    """Copies, multiples, zero vectors and values that aren't numbers, at any magnitude, against all pairs."""
    rng = np.random.default_rng(7)
    b = (rng.normal(size=(900, 24)) * size).astype(np.float32)
    b[100:140], b[200], b[300] = b[7], 0, b[301] * 3
    b[400], b[401] = np.nan, np.inf
    rid = rng.permutation(900).astype(np.int64)
    with np.errstate(all="ignore"):
        found = knn.closest(rid[:600:3], rid, 10, knn.Screen(b[:600:3], b, metric), lambda r, c: knn.exact_distances(b[:600:3], b, metric, r, c))
        got = sorted(zip(*(x.to_pylist() for x in found.columns)))
        y, want = b.astype(np.float64), []
        n = np.linalg.norm(y, axis=1)
        for i in range(0, 600, 3):
            dot = y @ y[i]
            d = np.linalg.norm(y - y[i], axis=1) if metric == "euclidean" else -dot if metric == "dot" else 1 - np.divide(dot, n * n[i], out=np.zeros(900), where=n * n[i] > 0)
            d = np.round(d, 9)
            want += [(int(rid[i]), int(rid[j]), d[j]) for j in np.lexsort((rid, d)) if j != i and np.isfinite(d[j])][:10]
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want)]


def test_subscription_rounds_before_it_compares(spark, tmp_path):
    """A similarity of 0.29999968 is 0.3 in six digits, as the SQL has it; one of 0.2999993 isn't."""
    from vecloom.streaming import jobs

    rows = [(0, [1.0, 0.0], 0)] + [(i, [x, (1 - x * x) ** 0.5], 0) for i, x in ((1, 0.29999968), (2, 0.2999993), (3, 0.31))]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["vec_id"], r["similarity"]) for r in jobs.subscription(spark, str(tmp_path)).collect()}
    assert got == {(1, 0.3), (3, 0.31)}


def counted(left, right):
    """How many rows the blocks send and how many pairs they see, with one row a left row and block."""
    each = lambda key, lid, a, rid, b: pa.table({"query_id": lid, "n": np.full(len(lid), len(rid))})
    r = knn.meet(left, right, each, "query_id long, n long").agg(F.count(F.lit(1)), F.sum("n")).first()
    return r[0], r[1]


def test_blocks_send_in_proportion(spark, monkeypatch):
    """Three times the vectors are sent three times, not nine, while blocks are small; beyond that blocks keep their size."""
    monkeypatch.setattr(knn, "TASK_PAIRS", 1, raising=False)
    df = lambda n: spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.rand(1), F.rand(2)).alias("embedding"))
    small, large = counted(df(3000), df(3000)), counted(df(9000), df(9000))
    assert small[1] == 3000**2 and large[1] == 9000**2 and large[0] == 3 * small[0]
    monkeypatch.setattr(knn, "BLOCK_NUMBERS", 2 * 1024)
    assert counted(df(30_000), df(3000)) == (30_000 * 3, 30_000 * 3000)


@pytest.mark.parametrize("size", [1.0, 1e6])
def test_distance_counts(spark, size):
    """Bins in arrays or, where there would be too many, sorted; against all pairs, the row itself left out."""
    x = np.random.default_rng(8).normal(size=(300, 4)) * size
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["bin"]): r["n"] for r in knn.distance_counts(knn.query_set(v, 30), v, 10).collect()}
    want = Counter((q, int(np.linalg.norm(x[q] - y) * 10)) for q in range(0, 300, 30) for i, y in enumerate(x) if i != q)
    assert got == want


def test_maxsim_of_groups(spark):
    x = np.random.default_rng(9).normal(size=(200, 4))
    v = spark.createDataFrame([(i, r.tolist(), i % 3) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {(r["query_id"], r["label"]): round(r["m"], 9) for r in knn.maxsim(knn.query_set(v, 40), v, "label").collect()}
    assert got == {(q, g): round(max(float(x[q] @ x[i]) for i in range(200) if i % 3 == g), 9) for q in range(0, 200, 40) for g in range(3)}


@pytest.mark.parametrize("name", ["pagerank_rerank", "gcn_propagation", "link_prediction", "temporal_growth", "temporal_trend", "graph_reachability", "label_propagation", "graph_degree_stats"])
def test_neighbours_are_searched_once(spark, sf_dir, name):
    """However often a query reads the edges, and in both directions."""
    before, calls = knn.closest, spark.sparkContext.accumulator(0)

    def counting(lid, *rest):
        calls.add(len(lid))
        return before(lid, *rest)

    knn.closest = counting
    try:
        catalog.queries()[name](spark, sf_dir).collect()
    finally:
        knn.closest = before
    assert calls.value == 500


def test_propagation_moves_vectors_whole(spark, monkeypatch):
    """Against matrices, in several groups of nodes; no dimension is a row before the last exchange."""
    monkeypatch.setattr(graph, "SUMMED", 7, raising=False)
    rng = np.random.default_rng(10)
    x = rng.normal(size=(40, 3)).astype(np.float32)
    pairs = sorted({tuple(sorted(p)) for p in rng.integers(0, 39, (80, 2)).tolist() if p[0] != p[1]})
    m = np.eye(40)
    for a, b in pairs:
        m[a, b] = m[b, a] = 1
    n = m.sum(1)
    want = np.round(m @ (x / np.sqrt(n)[:, None]) / np.sqrt(n)[:, None], 6)
    found = graph.propagated(spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a long, b long, weight double"), spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>"))
    got = {(r["node"], r["d"]): r["h"] for r in found.collect()}
    assert len(got) == 120 and all(abs(got[i, d] - want[i, d]) <= 1e-6 for i in range(40) for d in range(3))
    plan = plan_of(found)
    assert plan.index("Generate posexplode") < plan.index("Exchange")


def test_postings_are_sent_as_they_come(spark):
    """A batch of many words is sent in bounded parts, with the same counts."""

    class Documents:
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    texts = [" ".join(f"w{i}x{j} the Word{j % 7}" for j in range(200)) for i in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(texts)], ["doc_id", "text"])
    sent = list(retrieval.postings(Documents())(iter([batch])))
    assert sum(b.num_rows for b in sent) == 600 * 207 and max(b.num_rows for b in sent) < 25_000
    got = {(r["term"], r["tf"], r["dl"]) for b in sent for r in b.to_pylist() if r["doc_id"] == 5}
    assert got == {(f"w5x{j}", 1, 400) for j in range(200)} | {(f"word{j}", len(range(j, 200, 7)), 400) for j in range(7)}
