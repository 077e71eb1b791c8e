"""Sparse retrieval, rank fusion, reranking features, and ranking metrics."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vecloom.functions import text as T
from vecloom.operators.knn import ranked
from vecloom.sources.tables import cut


TOKEN = re.compile(r"\w+")
#: Postings sent at a time, and tokens whose term a worker keeps.
ROWS_SENT, TOKENS_KEPT = 20_000, 50_000


def term_counts(docs: DataFrame, terms: list[str], carry: list[str] | None = None) -> DataFrame:
    """(doc_id, dl, tf0 ..) of docs(doc_id, text) and the columns to carry: the number of tokens (as ``text.tokens`` has them), and of each term.

    One pass in Arrow batches that counts the different tokens of a text: several times faster than a regular expression for each term.
    """
    carry = carry or []
    kinds = {c: docs.schema[c] for c in carry}
    at = {t: i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dl, tf = [], [[] for _ in terms]
            for text in batch.column("text").to_pylist():
                n, found = 0, [0] * len(terms)
                for w, k in Counter(TOKEN.findall(text or "")).items():
                    if w.isascii():
                        n += k
                        i = at.get(w.lower())
                        if i is not None:
                            found[i] += k
                dl.append(n)
                for column, k in zip(tf, found):
                    column.append(k)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(dl, pa.int64()), *[pa.array(x, pa.int64()) for x in tf], *[batch.column(c) for c in carry]], ["doc_id", "dl", *[f"tf{i}" for i in range(len(terms))], *carry])

    schema = StructType([StructField("doc_id", LongType()), StructField("dl", LongType()), *[StructField(f"tf{i}", LongType()) for i in range(len(terms))], *kinds.values()])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry).mapInArrow(run, schema)


def bm25(docs: DataFrame, terms: list[str], k1: float = 1.5, b: float = 0.75, substrings: bool = False, extra: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, score) of documents with a positive score, and the ``extra`` columns of the text.

    One pass over the texts counts tokens and query terms and writes the counts, a few numbers a document, to the shared folder;
    corpus statistics and scores are read off that, and no token is ever shuffled. ``substrings`` counts occurrences inside longer words as well.
    """
    more = dict(extra or {}) | ({f"in{i}": T.substring_count(F.col("text"), F.lit(w)) for i, w in enumerate(terms)} if substrings else {})
    rows = cut(term_counts(docs.select("doc_id", "text", *[c.alias(n) for n, c in more.items()]), terms, list(more)).filter("dl > 0"), "bm25")
    inside = [F.col(f"tf{i}") > 0 for i in range(len(terms))]
    statistics = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(c).alias(f"df{i}") for i, c in enumerate(inside)])
    weight = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"in{i}" if substrings else f"tf{i}"), F.col(f"df{i}")
        weight = weight + F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1) * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    some = reduce(lambda x, y: x | y, [F.col(f"in{i}" if substrings else f"tf{i}") > 0 for i in range(len(terms))])
    return rows.filter(some).crossJoin(F.broadcast(statistics)).select("doc_id", weight.alias("score"), *(extra or {})).filter("score > 0")


def top(df: DataFrame, k: int, score: str = "score", key: str = "doc_id") -> DataFrame:
    """The k best by rounded score, ties by key."""
    rows = df.withColumn(score, F.round(score, 6)).orderBy(F.desc(score), key).limit(k)
    return ranked(rows, [F.desc(score), key])


def bm25_phrases(docs: DataFrame, terms: list[str], phrases: list[str], boost: float = 0.5) -> DataFrame:
    """(doc_id, score) of texts that hold every phrase; each occurrence adds ``boost``."""
    count = {f"phrase{i}": T.substring_count(F.col("text"), F.lit(p.lower())) for i, p in enumerate(phrases)}
    holds = reduce(lambda a, c: a & c, [F.col(n) > 0 for n in count])
    more = reduce(lambda a, c: a + c, [F.col(n) for n in count])
    return bm25(docs, terms, extra=count).filter(holds).select("doc_id", (F.col("score") + boost * more).alias("score"))


def postings(docs: DataFrame, stop: list[str] = T.STOP) -> DataFrame:
    """(doc_id, term, tf, dl) of terms that begin with a letter and have 2 to 25 characters, stop words aside. A document is counted where it lies: no shuffle.

    A worker holds a few texts, some ``ROWS_SENT`` postings and the terms of ``TOKENS_KEPT`` tokens, however many documents and different words there are.
    """
    whole, leave = re.compile(r"[a-z][a-z0-9]{1,24}"), set(stop)

    class Terms(dict):
        """The term that a token stands for, or an empty string."""

        def __missing__(self, token: str) -> str:
            low = token.lower()
            term = low if token.isascii() and whole.fullmatch(low) and low not in leave else ""
            if len(self) < TOKENS_KEPT:
                self[token] = term
            return term

    def made(*columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["doc_id", "term", "tf", "dl"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term_of = Terms()
        for batch in batches:
            ids, terms, tfs, dls = [], [], [], []
            for i, text in ((i, text.as_py()) for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"))):
                found: dict[str, int] = {}
                for w, n in Counter(TOKEN.findall(text or "")).items():
                    if term := term_of[w]:
                        found[term] = found.get(term, 0) + n
                ids += [i] * len(found)
                terms += found
                tfs += found.values()
                dls += [sum(found.values())] * len(found)
                if len(ids) >= ROWS_SENT:
                    yield made(ids, terms, tfs, dls)
                    ids, terms, tfs, dls = [], [], [], []
            yield made(ids, terms, tfs, dls)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, term string, tf long, dl long")


def term_weights(posted: DataFrame, k1: float = 1.2, b: float = 0.75, keep: int | None = 50, terms: list[str] | None = None) -> DataFrame:
    """(doc_id, term, weight): idf times saturated tf under the final corpus statistics; the ``keep`` heaviest of each document.

    The postings are written once. ``terms``: only the documents that hold one of them are weighed.
    """
    posted = cut(posted, "postings")
    lengths = posted.groupBy("doc_id").agg(F.first("dl").alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if terms is not None:
        posted = posted.join(posted.filter(F.col("term").isin(terms)).select("doc_id").distinct(), "doc_id", "left_semi")
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    saturated = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    out = posted.join(df, "term").crossJoin(F.broadcast(lengths)).select("doc_id", "term", F.round(idf * saturated, 6).alias("weight"))
    if keep is None:
        return out
    best = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "term")
    return out.withColumn("__n", F.row_number().over(best)).filter(F.col("__n") <= keep).drop("__n")


def sparse_dot(weights: DataFrame, query: DataFrame, cosine: bool = False) -> DataFrame:
    """(doc_id, score): products of a document's weights with those of query(term, qw), which is broadcast (a query has few terms)."""
    shared = weights.join(F.broadcast(query), "term").groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("qw")).alias("score"))
    if not cosine:
        return shared
    sizes = weights.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("dn"))
    size = query.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    joined = shared.join(sizes, "doc_id").crossJoin(F.broadcast(size))
    return joined.select("doc_id", F.when(F.col("dn") * F.col("qn") == 0, 0.0).otherwise(F.col("score") / (F.col("dn") * F.col("qn"))).alias("score"))


def rrf(lists: list[DataFrame], c: int = 60, weights: list[float] | None = None, first: int = 1) -> DataFrame:
    """(id, rrf, sources) of ranked lists (id, rank from 1): the sum of weight / (c + rank), one union and one aggregation. ``first`` is the value of the best rank."""
    weights = weights or [1.0] * len(lists)
    rows = reduce(DataFrame.unionByName, [x.select("id", (F.lit(w) / (c + F.col("rank") - 1 + first)).alias("part"), F.lit(i).alias("source")) for i, (x, w) in enumerate(zip(lists, weights))])
    return rows.groupBy("id").agg(F.sum("part").alias("rrf"), F.count(F.lit(1)).alias("sources"))


def first_wins(lists: list[DataFrame], key: str) -> DataFrame:
    """The union in which a key's row comes from the earliest list that has it."""
    rows = reduce(DataFrame.unionByName, [x.withColumn("priority", F.lit(i)) for i, x in enumerate(lists)])
    w = Window.partitionBy(key).orderBy("priority")
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def harmonic(*scores: Column) -> Column:
    """The harmonic mean, 0 where any is 0."""
    some = reduce(lambda a, c: a | c, [c == 0 for c in scores])
    return F.when(some, 0.0).otherwise(len(scores) / reduce(lambda a, c: a + c, [1 / c for c in scores]))


def map_dot(weights: Column, query: dict[str, float]) -> Column:
    """The product of a sparse vector, a map from terms to weights, with a query's few terms."""
    return reduce(lambda a, c: a + c, [F.coalesce(F.try_element_at(weights, F.lit(t)) * w, F.lit(0.0)) for t, w in query.items()])


def rerank(candidates: DataFrame, scorer: Column | None, text: Column, keys: list[str], k: int) -> DataFrame:
    """The best k candidates by a scorer's column, rows without a text last, ties by key; without a scorer the order of the keys stays."""
    by = [text.isNull(), F.desc(F.col("__score")), *keys] if scorer is not None else keys
    scored = candidates.withColumn("__score", F.lit(None).cast("double") if scorer is None else scorer)
    return ranked(scored.orderBy(*by).limit(k), by).drop("__score")


def ltr_features(df: DataFrame, length: Column, age_days: Column, query_length: int) -> list[Column]:
    """Text length, freshness and query length as features between 0 and 1."""
    return [
        F.least(length / 1000, F.lit(1.0)).alias("f_length"),
        F.greatest(F.lit(0.0), 1 - age_days / 365).alias("f_freshness"),
        F.lit(min(query_length / 20, 1.0)).alias("f_query_length"),
    ]


def relevance(event: Column, dwell_ms: Column) -> Column:
    """Implicit feedback: a click 1, a skip 0, a dwell ln(seconds + 1) / ln 61 between 0 and 1."""
    dwell = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.log(dwell_ms / 1000 + 1) / F.log(F.lit(61.0))))
    return F.when(event == "click", 1.0).when(event == "skip", 0.0).otherwise(dwell)


def metrics(run: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per query: recall, precision, reciprocal rank and two NDCGs at k.

    run(query_id, doc_id, rank from 1), relevant(query_id, doc_id, grade > 0). Queries without relevant documents are left
    out. The ideal ranking comes from the grades alone; gains are grade or 2 ** grade - 1.
    """
    hits = run.filter(F.col("rank") <= k).join(relevant, ["query_id", "doc_id"])
    discount = F.log2(F.col("rank") + 1)
    got = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"), F.sum(F.col("grade") / discount).alias("dcg"), F.sum((F.pow(F.lit(2.0), F.col("grade")) - 1) / discount).alias("dcg2"))
    w = Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")
    ideal = relevant.withColumn("rank", F.row_number().over(w))
    inside = F.col("rank") <= k
    best = ideal.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(inside, F.col("grade") / discount)).alias("idcg"), F.sum(F.when(inside, (F.pow(F.lit(2.0), F.col("grade")) - 1) / discount)).alias("idcg2"))
    j = best.join(got, "query_id", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return j.select("query_id", zero(F.col("hits") / F.col("n")).alias("recall"), zero(F.col("hits") / k).alias("precision"), zero(1.0 / F.col("first")).alias("mrr"), zero(F.col("dcg") / F.col("idcg")).alias("ndcg"), zero(F.col("dcg2") / F.col("idcg2")).alias("ndcg_exp"))


def class_metrics(run: DataFrame, items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``metrics`` where the relevant documents of a query are the other items(id, class, grade 1 or 2) of its own class.

    The ideal ranking follows from how many items of each grade a class has, so no pairs of a class are made.
    """
    grades = items.groupBy("class").agg(F.count_if(F.col("grade") == 2).alias("twos"), F.count_if(F.col("grade") == 1).alias("ones"))
    own = queries.join(items.withColumnRenamed("id", "query_id"), "query_id").join(grades, "class")
    own = own.select("query_id", "class", (F.col("twos") - (F.col("grade") == 2).cast("int")).alias("twos"), (F.col("ones") - (F.col("grade") == 1).cast("int")).alias("ones")).filter("twos + ones > 0")
    hit = run.filter(F.col("rank") <= k).join(own.select("query_id", "class"), "query_id").join(items.withColumnRenamed("id", "doc_id"), ["doc_id", "class"])
    discount = F.log2(F.col("rank") + 1)
    got = hit.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"), F.sum(F.col("grade") / discount).alias("dcg"), F.sum((F.pow(F.lit(2.0), F.col("grade")) - 1) / discount).alias("dcg2"))
    gain = lambda two, one: sum((F.when(F.col("twos") >= r, two).when(F.col("twos") + F.col("ones") >= r, one).otherwise(0.0) / F.log2(F.lit(r + 1.0)) for r in range(1, k + 1)), F.lit(0.0))
    j = own.withColumns({"n": F.col("twos") + F.col("ones"), "idcg": gain(2.0, 1.0), "idcg2": gain(3.0, 1.0)}).join(got, "query_id", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return j.select("query_id", zero(F.col("hits") / F.col("n")).alias("recall"), zero(F.col("hits") / k).alias("precision"), zero(1.0 / F.col("first")).alias("mrr"), zero(F.col("dcg") / F.col("idcg")).alias("ndcg"), zero(F.col("dcg2") / F.col("idcg2")).alias("ndcg_exp"))
