"""Registered queries on texts, pages and searches that fuse dense and sparse results.

A document has the vector whose vec_id is its doc_id. The text query of a single search is ``QUERY``.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions import text as T
from vecloom.functions import vectors as V
from vecloom.functions.predicates import Filter
from vecloom.operators import knn, retrieval
from vecloom.plans import dsl
from vecloom.plans.vector_queries import COS, Q, embeddings, query0
from vecloom.registry import Registry
from vecloom.sources import tables
from vecloom.sources.tables import table

REG = Registry()
K = 10
QUERY = ["the", "und", "tion"]
TOKENS = r"list_transform(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-zA-Z0-9_]+')), lambda w: lower(w))"


def documents(spark, sf_dir, *columns):
    return table(spark, sf_dir, "documents", *columns)


def bm25_sql(terms: list[str] = QUERY, substrings: bool = False) -> str:
    """CTEs t (tokens), s (statistics) and scored(doc_id, text, score)."""
    count = "((length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {n})" if substrings else "len(list_filter(tok, lambda x: x = '{w}'))"
    tf = ", ".join(f"{count.format(w=w, n=len(w))} AS tf{i}, list_contains(tok, '{w}') AS in{i}" for i, w in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (in{i}) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE) + 1) * (tf{i} * 2.5::DOUBLE) / (tf{i} + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))" for i in range(len(terms)))
    return f"tk AS (SELECT doc_id, text, {TOKENS} AS tok FROM documents), t AS (SELECT doc_id, text, len(tok) AS dl, {tf} FROM tk WHERE len(tok) > 0), s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {df} FROM t), scored AS (SELECT * FROM (SELECT doc_id, text, {score} AS score FROM t, s) WHERE score > 0)"


TOP = "SELECT row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank, doc_id, round(score, 6) AS score FROM scored ORDER BY round(score, 6) DESC, doc_id LIMIT 10"


@REG.query(f"SELECT doc_id, len(tok)::BIGINT AS tokens, len(list_distinct(tok))::BIGINT AS distinct_tokens FROM (SELECT doc_id, {TOKENS} AS tok FROM documents)")
def token_stats(spark, sf_dir):
    t = documents(spark, sf_dir, "doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("distinct_tokens"))


@REG.query(f"WITH {bm25_sql()} {TOP}")
def bm25_topk(spark, sf_dir):
    return retrieval.top(retrieval.bm25(documents(spark, sf_dir), QUERY), K).select("rank", "doc_id", "score")


@REG.query(f"WITH {bm25_sql(substrings=True)} {TOP}")
def bm25_substring_tf(spark, sf_dir):
    """Counts terms inside longer words too."""
    return retrieval.top(retrieval.bm25(documents(spark, sf_dir), QUERY, substrings=True), K).select("rank", "doc_id", "score")


@REG.query(f"WITH {bm25_sql(['of', 'the']).replace('scored AS', 'plain AS')}, scored AS (SELECT doc_id, score + 0.5 * ((length(text) - length(replace(lower(text), 'of the', ''))) // 6) AS score FROM plain WHERE contains(lower(text), 'of the')) {TOP}")
def bm25_phrase(spark, sf_dir):
    return retrieval.top(retrieval.bm25_phrases(documents(spark, sf_dir), ["of", "the"], ["of the"]), K).select("rank", "doc_id", "score")


STOPS = ", ".join(f"'{w}'" for w in T.STOP)
SPLADE = f"w AS (SELECT doc_id, list_filter({TOKENS}, lambda w: regexp_full_match(w, '[a-z][a-z0-9]{{1,24}}') AND NOT list_contains([{STOPS}], w)) AS tok FROM documents), p AS (SELECT doc_id, len(tok) AS dl, unnest(tok) AS term FROM w), po AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL), l AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT doc_id, dl FROM po)), df AS (SELECT term, count(*) AS df FROM po GROUP BY term), wt AS (SELECT doc_id, po.term, round(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS weight FROM po JOIN df ON df.term = po.term, l QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, po.term) <= 50)"


def weights(spark, sf_dir, terms=None):
    return retrieval.term_weights(retrieval.postings(documents(spark, sf_dir, "doc_id", "text")), terms=terms)


SPARSE_QUERY = ["von", "thly", "les"]


def query_weights(spark):
    return spark.createDataFrame([("von", 1.0), ("thly", 2.0), ("les", 0.5)], "term string, qw double")


QW = "qw(term, qw) AS (VALUES ('von', 1.0::DOUBLE), ('thly', 2.0), ('les', 0.5))"


@REG.query(f"WITH {SPLADE} SELECT doc_id, term, weight FROM wt")
def splade_doc_terms(spark, sf_dir):
    """The fifty heaviest terms of every document."""
    return weights(spark, sf_dir)


@REG.query(f"WITH {SPLADE}, {QW}, scored AS (SELECT doc_id, sum(weight * qw) AS score FROM wt JOIN qw ON qw.term = wt.term GROUP BY doc_id) {TOP}")
def splade_search(spark, sf_dir):
    return retrieval.top(retrieval.sparse_dot(weights(spark, sf_dir, SPARSE_QUERY), query_weights(spark)), K).select("rank", "doc_id", "score")


@REG.query(f"WITH {SPLADE}, {QW}, z AS (SELECT doc_id, sqrt(sum(weight * weight)) AS dn FROM wt GROUP BY 1), scored AS (SELECT wt.doc_id, sum(weight * qw) / (any_value(dn) * (SELECT sqrt(sum(qw * qw)) FROM qw)) AS score FROM wt JOIN qw ON qw.term = wt.term JOIN z ON z.doc_id = wt.doc_id GROUP BY wt.doc_id) {TOP}")
def sparse_cosine(spark, sf_dir):
    return retrieval.top(retrieval.sparse_dot(weights(spark, sf_dir, SPARSE_QUERY), query_weights(spark), cosine=True), K).select("rank", "doc_id", "score")


# Fusion

DENSE = f"{Q}, dense AS (SELECT vec_id AS id, row_number() OVER (ORDER BY d, vec_id) AS rank FROM (SELECT vec_id, {COS.replace(', 6)', ', 12)')} AS d FROM embeddings v, q ORDER BY d, vec_id LIMIT 50))"
SPARSE = f"{bm25_sql()}, sparse AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored ORDER BY round(score, 6) DESC, doc_id LIMIT 50)"


def dense_list(spark, sf_dir, k=50):
    return knn.exact(embeddings(spark, sf_dir, "vec_id", "embedding"), query0(spark, sf_dir), k).select(F.col("vec_id").alias("id"), "rank")


def sparse_list(spark, sf_dir, k=50):
    return retrieval.top(retrieval.bm25(documents(spark, sf_dir), QUERY), k).select(F.col("doc_id").alias("id"), "rank")


def _fused(f):
    best = F.max("rrf").over(knn.Window.partitionBy(F.lit(0)))
    top = f.orderBy(F.desc("rrf"), "id").limit(K).withColumn("score", F.round(F.col("rrf") / best, 6))
    return knn.ranked(top, [F.desc("rrf"), "id"]).select("rank", "id", "score", "sources")


_FUSED = "b AS (SELECT * FROM f ORDER BY rrf DESC, id LIMIT 10) SELECT row_number() OVER (ORDER BY rrf DESC, id) AS rank, id, round(rrf / max(rrf) OVER (), 6) AS score, sources FROM b"
_UNION = "f AS (SELECT id, sum(part) AS rrf, count(*) AS sources FROM (SELECT id, {0} / ({1} + rank) AS part FROM dense UNION ALL SELECT id, {2} / ({1} + rank) FROM sparse) GROUP BY id)"


@REG.query(f"WITH {DENSE}, {SPARSE}, {_UNION.format('1.0::DOUBLE', 60, '1.0::DOUBLE')}, {_FUSED}")
def rrf_hybrid(spark, sf_dir):
    """Dense and BM25 lists fused by reciprocal rank, normalised by the best."""
    return _fused(retrieval.rrf([dense_list(spark, sf_dir), sparse_list(spark, sf_dir)]))


@REG.query(f"WITH {DENSE}, {SPARSE}, {_UNION.format('0.7::DOUBLE', 59, '0.3::DOUBLE')}, {_FUSED}")
def rrf_weighted(spark, sf_dir):
    """The weighted form counts ranks from 0."""
    return _fused(retrieval.rrf([dense_list(spark, sf_dir), sparse_list(spark, sf_dir)], weights=[0.7, 0.3], first=0))


@REG.query(f"WITH {DENSE}, {SPARSE}, u AS (SELECT id, count(*) AS n FROM (SELECT id FROM dense UNION ALL SELECT id FROM sparse) GROUP BY id) SELECT count(*) AS either, count(*) FILTER (n = 2) AS shared, round(count(*) FILTER (n = 2) / count(*), 6) AS jaccard FROM u")
def rrf_nway_overlap(spark, sf_dir):
    f = retrieval.rrf([dense_list(spark, sf_dir), sparse_list(spark, sf_dir)])
    return f.agg(F.count(F.lit(1)).alias("either"), F.count_if(F.col("sources") == 2).alias("shared")).withColumn("jaccard", F.round(F.col("shared") / F.col("either"), 6))


@REG.query(f"WITH {DENSE}, {SPARSE} SELECT id, rank, 0::BIGINT AS priority FROM dense UNION ALL SELECT id, rank, 1 FROM sparse WHERE id NOT IN (SELECT id FROM dense)")
def index_union_first_wins(spark, sf_dir):
    return retrieval.first_wins([dense_list(spark, sf_dir), sparse_list(spark, sf_dir)], "id").select("id", "rank", F.col("priority").cast("long").alias("priority"))


@REG.query("SELECT key, value, count(*) AS n FROM (SELECT 'lang' AS key, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents) WHERE length(value) < 50 GROUP BY ALL")
def facets(spark, sf_dir):
    d = documents(spark, sf_dir, "lang", "source").unpivot([], ["lang", "source"], "key", "value")
    return d.filter(F.length("value") < 50).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


def fused_under(spark, sf_dir, ids, depth):
    """(id, rrf) of the dense and the BM25 list, ``depth`` long each, among ``ids`` (all if None). Corpus statistics are those of all documents."""
    e = embeddings(spark, sf_dir, "vec_id", "embedding")
    scored = retrieval.bm25(documents(spark, sf_dir), QUERY)
    q = query0(spark, sf_dir)
    if ids is not None:
        e, scored = e.join(ids.withColumnRenamed("id", "vec_id"), "vec_id", "left_semi"), scored.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    dense = knn.exact(e, q, depth).select(F.col("vec_id").alias("id"), "rank")
    return retrieval.rrf([dense, retrieval.top(scored, depth).select(F.col("doc_id").alias("id"), "rank")])


def planned_search(spark, sf_dir, text: str, statistics: dict, k: int = K):
    """Hybrid search under a query-language predicate, by the strategy the planner picks. filter_first searches among the rows that pass. vector_first
    takes ``overfetch`` * k of each list and filters those; if fewer than k are left, the filter goes first after all, so the answer is full while rows last.
    """
    tree, plan = dsl.plan(text, statistics)
    docs = documents(spark, sf_dir, "doc_id", "lang", "source")
    passing = docs.filter(dsl.predicate(tree, schema=docs.schema))

    def answer(fused, strategy):
        found = passing.join(F.broadcast(fused), F.col("doc_id") == F.col("id"))  # at most two lists of bounded length
        top = found.orderBy(F.desc("rrf"), "id").limit(k)
        return knn.ranked(top, [F.desc("rrf"), "id"]).select("rank", "id", "lang", "source", F.round("rrf", 6).alias("score"), F.lit(strategy).alias("strategy"))

    if plan.strategy in ("vector_first", "vector_only"):
        first = tables.cut(answer(fused_under(spark, sf_dir, None, k * plan.overfetch), plan.strategy))
        if plan.strategy == "vector_only" or first.count() == k:
            return first
    return answer(fused_under(spark, sf_dir, passing.select(F.col("doc_id").alias("id")), 5 * k), "filter_first")


def _planned(where: str, strategy: str, depth: int) -> str:
    """SQL of a planned search whose lists are ``depth`` long; filter_first filters before they are cut."""
    dense, sparse = DENSE.replace("LIMIT 50", f"LIMIT {depth}"), SPARSE.replace("LIMIT 50", f"LIMIT {depth}")
    if strategy == "filter_first":
        dense, sparse = dense.replace("FROM embeddings v, q ORDER", "FROM embeddings v, q WHERE vec_id IN (SELECT doc_id FROM pa) ORDER"), sparse.replace("FROM scored ORDER", "FROM scored WHERE doc_id IN (SELECT doc_id FROM pa) ORDER")
    return f"WITH pa AS (SELECT doc_id FROM documents WHERE {where}), {dense}, {sparse}, {_UNION.format('1.0::DOUBLE', 60, '1.0::DOUBLE')}, b AS (SELECT f.id, f.rrf, d.lang, d.source FROM f JOIN documents d ON d.doc_id = f.id WHERE d.doc_id IN (SELECT doc_id FROM pa) ORDER BY rrf DESC, id LIMIT 10) SELECT row_number() OVER (ORDER BY rrf DESC, id) AS rank, id, lang, source, round(rrf, 6) AS score, '{strategy}' AS strategy FROM b"


@REG.query(_planned("lang = 'en' AND source IS DISTINCT FROM 'src3'", "vector_first", 100))
def search_pipeline(spark, sf_dir):
    """A weak predicate: the search goes first and fetches ten times as many."""
    return planned_search(spark, sf_dir, 'lang = "en" AND NOT source = "src3" AND semantic_match("q", 10)', {"lang": {"distinct": 4}})


@REG.query(_planned("source = 'src3' AND lang <> 'en'", "filter_first", 50))
def search_filter_first(spark, sf_dir):
    """A predicate that few rows pass: the filter goes first, and the lists are full."""
    return planned_search(spark, sf_dir, 'source = "src3" AND NOT lang = "en" AND semantic_match("q", 10)', {"lang": {"distinct": 4}, "source": {"distinct": 20}})


@REG.query(f"WITH {bm25_sql()} SELECT s.doc_id, round(score, 6) AS f_bm25, round(least(length(s.text) / 1000, 1.0), 6) AS f_length, round(greatest(0.0, 1 - date_diff('day', e.ts, TIMESTAMP '2024-02-01') / 365), 6) AS f_freshness, 0.15::DOUBLE AS f_query_length FROM scored s JOIN events e ON e.event_id = s.doc_id")
def ltr_features(spark, sf_dir):
    """Features of every BM25 match; a document is as old as the event with its id."""
    ts = table(spark, sf_dir, "events", "event_id", "ts")
    df = retrieval.bm25(documents(spark, sf_dir), QUERY, extra={"chars": F.length("text")}).join(ts, F.col("doc_id") == F.col("event_id"))
    age = F.datediff(F.lit("2024-02-01").cast("date"), F.col("ts"))
    length, fresh, words = retrieval.ltr_features(df, F.col("chars"), age, len(QUERY))
    return df.select("doc_id", F.round("score", 6).alias("f_bm25"), F.round(length, 6).alias("f_length"), F.round(fresh, 6).alias("f_freshness"), words)


@REG.query("WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), p AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 1), b AS (SELECT unnest(list_transform(list_zip(q.e, p.e), lambda z: 0.7::DOUBLE * z[1] + 0.3::DOUBLE * z[2])) AS x, unnest(range(64)) AS d FROM q, p) SELECT d, round(x / sqrt(sum(x * x) OVER ()), 6) AS x FROM b")
def personalized_query(spark, sf_dir):
    """The query moved three tenths towards a profile."""
    e = embeddings(spark, sf_dir, "vec_id", "embedding")
    p = knn.query_vector(e, 1).withColumnRenamed("q", "p")
    b = knn.query_vector(e, 0).crossJoin(F.broadcast(p)).select(V.blend(F.col("q"), F.col("p"), 0.3).alias("b"))
    return b.select(F.posexplode("b").alias("d", "x")).select(F.col("d").cast("long").alias("d"), F.round("x", 6).alias("x"))


@REG.query(f"WITH {Q}, d AS (SELECT vec_id, {COS} * CASE WHEN vec_id IN (SELECT user_id FROM events WHERE event_type = 'click') THEN 0.8 ELSE 1.0 END AS distance FROM embeddings v, q), b AS (SELECT vec_id, round(distance, 6) AS distance FROM d ORDER BY 2, 1 LIMIT 10) SELECT row_number() OVER (ORDER BY distance, vec_id) AS rank, * FROM b")
def boost_clicked(spark, sf_dir):
    """Vectors that were clicked (their id is a clicking user's) come a fifth nearer."""
    clicked = table(spark, sf_dir, "events").filter("event_type = 'click'").select(F.col("user_id").alias("vec_id")).distinct().withColumn("hit", F.lit(True))
    d = knn.with_query(embeddings(spark, sf_dir, "vec_id", "embedding"), query0(spark, sf_dir)).join(clicked, "vec_id", "left")
    boosted = F.round(V.distance(F.col("embedding"), F.col("q")), 6) * F.when(F.col("hit"), 0.8).otherwise(1.0)
    top = d.select("vec_id", F.round(boosted, 6).alias("distance")).orderBy("distance", "vec_id").limit(K)
    return knn.ranked(top, ["distance", "vec_id"]).select("rank", "vec_id", "distance")


# Preparation of texts and pages

_PII = "text"
for _, _pattern, _label in T.PII:
    _PII = f"regexp_replace({_PII}, '{_pattern}', '{_label}', 'g')"
_PII = _PII.replace("\\t", "\\x09").replace("\\r", "\\x0d").replace("\\n", "\\x0a")


@REG.query(f"SELECT doc_id, md5({_PII}) AS digest, {_PII} <> text AS changed FROM documents")
def pii_redact(spark, sf_dir):
    d = documents(spark, sf_dir, "doc_id", "text").withColumn("clean", T.redact(F.col("text")))
    return d.select("doc_id", F.md5("clean").alias("digest"), (F.col("clean") != F.col("text")).alias("changed"))


@REG.query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::BIGINT AS words, length(text)::BIGINT AS chars, len(regexp_extract_all(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+'))::BIGINT AS emails, len(regexp_extract_all(text, 'https?://\S+'))::BIGINT AS urls FROM documents")
def enrich_counts(spark, sf_dir):
    count = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), 0)).cast("long")
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("words"), F.length("text").cast("long").alias("chars"), count(r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+").alias("emails"), count(r"https?://\S+").alias("urls"))


@REG.query(r"WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ss FROM documents), c AS (SELECT doc_id, ss, unnest(range(1, len(ss) + 1, 4)) AS i FROM s) SELECT doc_id, ((i - 1) // 4)::BIGINT AS chunk, ceil(len(ss) / 4)::BIGINT AS total, md5(array_to_string(ss[i:i + 4], ' ')) AS digest FROM c")
def sentence_chunks(spark, sf_dir):
    """Chunks of five sentences, one shared."""
    d = documents(spark, sf_dir, "doc_id", T.sentence_chunks(F.col("text")).alias("c"))
    return d.select("doc_id", F.size("c").cast("long").alias("total"), F.posexplode("c").alias("chunk", "t")).select("doc_id", F.col("chunk").cast("long").alias("chunk"), "total", F.md5("t").alias("digest"))


def recursive_split(text: str, size: int = 500, overlap: int = 50) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that serves; each but the first repeats the end of the one before."""

    def cut(piece: str, marks: tuple[str, ...]) -> list[str]:
        if len(piece) <= size or not marks:
            return [piece]
        merged, held = [], ""
        for part in piece.split(marks[0]):
            joined = f"{held}{marks[0]}{part}".strip() if held else part
            if len(joined) > size and held:
                merged.append(held)
                held = part
            else:
                held = joined
        merged += [held] if held else []
        return [y for x in merged for y in cut(x, marks[1:])]

    pieces = cut(text, ("\n\n", "\n", ". ", "! ", "? ", ", ", " ")) if text else []
    return pieces[:1] + [a[-overlap:] + b if overlap else b for a, b in zip(pieces, pieces[1:])]


@REG.query()
def recursive_chunks(spark, sf_dir):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, n, c) for i, t in zip(frame["doc_id"], frame["text"]) for n, c in enumerate(recursive_split(t or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "text"])

    return documents(spark, sf_dir, "doc_id", "text").mapInPandas(run, "doc_id long, chunk long, text string")


#: What the tokenizer of a public rank file splits a text into before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ranks_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """A rank file beside the installed package of public tokenizers."""
    found = importlib.util.find_spec("public_tokenizers")
    return os.path.join(os.path.dirname(found.origin) if found else "/opt/tokenizers", name)


def token_windows(tokens: list[int], size: int = 512, overlap: int = 50) -> list[list[int]]:
    """Windows of ``size`` tokens, each but the first beginning ``overlap`` before the end of the last; none that only repeats."""
    return [tokens[a : a + size] for a in range(0, max(len(tokens) - overlap, 1), size - overlap)]


def token_chunks(docs: DataFrame, ranks: str | None = None, size: int = 512, overlap: int = 50) -> DataFrame:
    """(doc_id, chunk, tokens, text) of docs(doc_id, text). Null and empty texts have no chunks; a cut within a character shows as a replacement mark."""
    with open(ranks or ranks_path(), "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        pairs = [line.split() for line in sent.value.splitlines()]
        encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        for frame in frames:
            rows = [(i, n, len(w), encoding.decode(w)) for i, t in zip(frame["doc_id"], frame["text"]) if t for n, w in enumerate(token_windows(encoding.encode_ordinary(t), size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "tokens", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk long, tokens long, text string")


class _Page(HTMLParser):
    SKIP = {"script", "style", "noscript", "head", "svg", "template"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.parts, self.links, self.hidden, self.in_title = "", [], [], 0, False

    def handle_starttag(self, tag, attrs):
        self.in_title = tag == "title"
        self.hidden += tag in self.SKIP
        if tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v and v.startswith(("http://", "https://"))]

    def handle_endtag(self, tag):
        self.in_title = False
        if tag in self.SKIP and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.hidden and data.strip():
            self.parts.append(data.strip())


@REG.query()
def html_extract(spark, sf_dir):
    """(page_id, title, text, links) of every page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, html in zip(frame["page_id"], frame["html"]):
                page = _Page()
                page.feed(html or "")
                rows.append((i, page.title.strip(), " ".join(page.parts), list(dict.fromkeys(page.links))))
            yield pd.DataFrame(rows, columns=["page_id", "title", "text", "links"])

    return table(spark, sf_dir, "pages", "page_id", "html").mapInPandas(run, "page_id long, title string, text string, links array<string>")


_DROP = ", ".join(f"'{x}'" for x in T.TRACKING)


@REG.query(rf"WITH b AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages), p AS (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) AS head, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1) AS path, list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT list_contains([{_DROP}], split_part(x, '=', 1)))) AS q FROM b) SELECT page_id, head || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(q, '&') END AS url FROM p")
def url_canonical(spark, sf_dir):
    return table(spark, sf_dir, "pages", "page_id", T.canonical_url(F.col("url")).alias("url"))


@REG.query("SELECT page_id, 'web_' || substr(sha1(url), 1, 24) AS web_id FROM pages")
def page_doc_id(spark, sf_dir):
    return table(spark, sf_dir, "pages", "page_id", T.page_id(F.col("url")).alias("web_id"))


@REG.query(r"SELECT item_id, CASE WHEN regexp_matches(lower(text), 'what|how|why|who|when|\?') THEN 'QA' WHEN len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) > 7 THEN 'EXPLORATORY' ELSE 'EXACT' END AS intent FROM benchmark")
def query_route(spark, sf_dir):
    """The intent of every benchmark item, read as a query."""
    return table(spark, sf_dir, "benchmark", "item_id", T.intent(F.col("text")).alias("intent"))


@REG.query(r"SELECT turn, conv_id, role, md5(regexp_replace(text, '(?i)\b(the|and)\b', '**\1**', 'g')) AS digest FROM conversations WHERE text IS NOT NULL")
def highlight(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.filter("text is not null").select("turn", "conv_id", "role", F.md5(T.highlight(F.col("text"), ["the", "and"])).alias("digest"))


@REG.query(rf"WITH {bm25_sql()}, r AS (SELECT doc_id, text, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored ORDER BY round(score, 6) DESC, doc_id LIMIT 5), se AS (SELECT doc_id, rank, unnest(list_filter(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS sentence FROM r), o AS (SELECT sentence, min(doc_id) AS doc_id, max(round(len(list_intersect(list_distinct({TOKENS.replace('text', 'sentence')}), ['the', 'und', 'tion'])) / (1 + 0.1 * rank), 6)) AS score FROM se WHERE len(list_filter(regexp_split_to_array(sentence, '\s+'), lambda w: w <> '')) >= 5 GROUP BY sentence) SELECT * FROM o WHERE score > 0 ORDER BY score DESC, sentence LIMIT 3")
def extractive_answer(spark, sf_dir):
    """The three best sentences of the five best documents."""
    top = retrieval.top(retrieval.bm25(documents(spark, sf_dir), QUERY), 5)  # five rows, to which the texts are joined
    best = documents(spark, sf_dir, "doc_id", "text").join(F.broadcast(top.select("doc_id", "rank")), "doc_id")
    s = best.select("doc_id", "rank", F.explode(T.sentences(F.col("text"))).alias("sentence")).filter(F.size(T.words(F.col("sentence"))) >= 5)
    overlap = F.size(F.array_intersect(T.tokens(F.col("sentence")), F.array(*map(F.lit, QUERY)))) / (1 + 0.1 * F.col("rank"))
    o = s.groupBy("sentence").agg(F.min("doc_id").alias("doc_id"), F.max(F.round(overlap, 6)).alias("score"))
    return o.filter("score > 0").orderBy(F.desc("score"), "sentence").limit(3)


@REG.query("SELECT text, max(conv_id) AS conv_id FROM (SELECT * FROM conversations WHERE starts_with(lower(text), 'the') AND lower(text) <> 'the') GROUP BY text ORDER BY conv_id DESC, text LIMIT 5")
def autocomplete(spark, sf_dir):
    c = table(spark, sf_dir, "conversations", "text", "conv_id").filter(F.lower("text").startswith("the") & (F.lower("text") != "the"))
    return c.groupBy("text").agg(F.max("conv_id").alias("conv_id")).orderBy(F.desc("conv_id"), "text").limit(5)


def fingerprints(df, key: str, text: str):
    """(key, fp): a 64-bit SimHash of word pairs, whose hash is the high half of md5."""
    t = df.select(key, T.words(F.lower(text)).alias("w"))
    n = F.size("w")
    pairs = F.when(n >= 2, F.zip_with(F.slice("w", F.lit(1), n - 1), F.slice("w", F.lit(2), n - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.col("w"))
    h = t.select(key, F.explode_outer(pairs).alias("s")).select(key, F.expr("(shiftleft(cast(conv(substr(md5(s), 1, 8), 16, 10) as bigint), 32) | cast(conv(substr(md5(s), 9, 8), 16, 10) as bigint))").alias("h"))
    votes = h.groupBy(key).agg(*[F.sum(F.expr(f"(shiftrightunsigned(h, {i}) & 1) * 2 - 1")).alias(f"b{i}") for i in range(64)])
    fp = F.lit(0).cast("long")
    for i in range(64):
        fp = fp.bitwiseOR(F.when(F.col(f"b{i}") > 0, F.expr(f"shiftleft(1L, {i})")).otherwise(F.lit(0).cast("long")))
    return votes.select(key, fp.alias("fp"))


_SH = r"w AS (SELECT page_id, list_filter(regexp_split_to_array(lower(html), '\s+'), lambda x: x <> '') AS w FROM pages), s AS (SELECT page_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM w), v AS (SELECT page_id, b, sum(CASE WHEN (('0x' || substr(md5(s), 16 - b // 4, 1))::INT >> (b % 4)) & 1 = 1 THEN 1 ELSE -1 END) > 0 AS bit FROM s, (SELECT unnest(range(64))::INT AS b) GROUP BY ALL), f AS (SELECT page_id, sum(CASE WHEN bit AND b < 32 THEN 1::BIGINT << b ELSE 0 END)::BIGINT AS lo, sum(CASE WHEN bit AND b >= 32 THEN 1::BIGINT << (b - 32) ELSE 0 END)::BIGINT AS hi FROM v GROUP BY page_id)"


@REG.query(f"WITH {_SH} SELECT page_id, lo, hi FROM f")
def simhash_pages(spark, sf_dir):
    """The two halves of every page's fingerprint."""
    f = fingerprints(table(spark, sf_dir, "pages"), "page_id", "html")
    return f.select("page_id", F.expr("fp & 4294967295L").alias("lo"), F.expr("shiftrightunsigned(fp, 32)").alias("hi"))


@REG.query(f"WITH {_SH} SELECT a.page_id AS a, b.page_id AS b, (bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi)))::BIGINT AS hamming FROM f a JOIN f b ON a.page_id < b.page_id WHERE bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi)) <= 3")
def near_duplicate_pages(spark, sf_dir):
    """Pairs of pages within three bits: they agree on one of four bands, so an equi-join on bands finds all."""
    f = fingerprints(table(spark, sf_dir, "pages"), "page_id", "html").select("page_id", "fp", F.posexplode(F.array(*[F.expr(f"shiftrightunsigned(fp, {16 * i}) & 65535L") for i in range(4)])).alias("band", "value"))
    a, b = f.alias("a"), f.alias("b")
    pairs = a.join(b, F.expr("a.band = b.band and a.value = b.value and a.page_id < b.page_id and bit_count(a.fp ^ b.fp) <= 3"))
    return pairs.select(F.col("a.page_id").alias("a"), F.col("b.page_id").alias("b"), F.expr("cast(bit_count(a.fp ^ b.fp) as bigint)").alias("hamming")).distinct()


# Predicates

@REG.query("SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size <= 30 AND (p_brand = 'Brand#12' OR NOT coalesce(contains(p_type, 'STEEL'), false)) AND p_retailprice IS NOT NULL")
def filter_builder_ops(spark, sf_dir):
    f = Filter.between("p_size", 10, 30) & (Filter.eq("p_brand", "Brand#12") | ~Filter.of("p_type", "contains", "STEEL")) & Filter.of("p_retailprice", "exists", True)
    df = table(spark, sf_dir, "part")
    return df.filter(f.column(schema=df.schema)).select("p_partkey")


@REG.query("SELECT c_custkey FROM customer WHERE c_acctbal >= 1000 AND c_acctbal < 5000 AND c_mktsegment IS DISTINCT FROM 'BUILDING' AND c_nationkey IN (1, 2, 3, 4, 5)")
def filter_from_dict(spark, sf_dir):
    f = Filter.from_dict({"c_acctbal": {"$gte": 1000, "$lt": 5000}, "c_mktsegment": {"$ne": "BUILDING"}, "c_nationkey": {"$in": [1, 2, 3, 4, 5]}})
    df = table(spark, sf_dir, "customer")
    return df.filter(f.column(schema=df.schema)).select("c_custkey")


@REG.query("SELECT event_id FROM events WHERE props IS NOT NULL AND coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50, false)")
def filter_json_props(spark, sf_dir):
    from vecloom.functions.predicates import json_field

    return table(spark, sf_dir, "events").filter(Filter.of("k", "gt", 50).column(json_field("props"), F.col("props"))).select("event_id")


@REG.query("SELECT event_id FROM events WHERE props IS NOT NULL AND NOT coalesce(json_extract_string(props, '$.missing') IN ('1', '2'), false) AND NOT coalesce(json_extract_string(props, '$.k') IN ('1', '2'), false)")
def filter_nin_missing(spark, sf_dir):
    """``nin`` holds for a missing key."""
    from vecloom.functions.predicates import json_field

    f = Filter.of("missing", "nin", ["1", "2"]) & Filter.of("k", "nin", ["1", "2"])
    return table(spark, sf_dir, "events").filter(f.column(json_field("props"), F.col("props"))).select("event_id")


@REG.query("SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '^Brand#[1-3]') ")
def filter_regex(spark, sf_dir):
    return table(spark, sf_dir, "part").filter((Filter.of("p_brand", "regex", "^Brand#[1-3]") & Filter.of("p_brand", "exists", True)).column()).select("p_partkey")


@REG.query("SELECT p_partkey FROM part WHERE (p_size < 20 AND p_retailprice >= 1000) OR NOT coalesce(p_brand = 'Brand#12', false)")
def dsl_and_or_not(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    return df.filter(dsl.predicate(dsl.parse('(p_size < 20 AND p_retailprice >= 1000) OR NOT p_brand = "Brand#12"'), schema=df.schema)).select("p_partkey")


@REG.query("SELECT p_partkey FROM part WHERE contains('Brand#12,Brand#23', p_brand) OR contains(p_type, 'o')")
def dsl_in_contains(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(dsl.predicate(dsl.parse("p_brand in 'Brand#12,Brand#23' OR p_type contains 'o'"))).select("p_partkey")


@REG.query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def row_level_security(spark, sf_dir):
    """A tenant's rows by semi-join, narrowed by a predicate in the query language."""
    mine = table(spark, sf_dir, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").filter(dsl.predicate(dsl.parse('o_orderstatus != "F"'))).join(mine, "o_custkey", "left_semi").select("o_orderkey")
