"""Registered queries on smaller operators: records, crawl queue, change images, feedback models, replicas."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions import text as T
from vecloom.functions import vectors as V
from vecloom.operators import knn
from vecloom.plans.text_queries import documents
from vecloom.plans.vector_queries import COS, Q, embeddings, query0
from vecloom.registry import Registry
from vecloom.sources.tables import table

REG = Registry()

ABBREVIATIONS = {"the": "a definite article", "und": "and also", "and": "as well"}
SYNONYMS = {"of": ["from", "about"], "to": ["towards"]}


@REG.query(f"WITH {Q}, d AS (SELECT vec_id, label, {COS} AS distance FROM embeddings v, q WHERE list_has_any([label, label % 3 + 100], [1, 101]) ORDER BY distance, vec_id LIMIT 10) SELECT row_number() OVER (ORDER BY distance, vec_id) AS rank, vec_id, distance FROM d")
def memory_search(spark, sf_dir):
    """Nearest rows whose categories (two for each row, made of the label) overlap the wanted ones."""
    e = embeddings(spark, sf_dir)
    wanted = F.arrays_overlap(F.array(F.col("label"), F.col("label") % 3 + 100), F.array(F.lit(1), F.lit(101)))
    return knn.exact(e, query0(spark, sf_dir), 10, where=wanted).select("rank", "vec_id", F.round("distance", 6).alias("distance"))


@REG.query(f"WITH {Q}, d AS (SELECT vec_id, {COS} AS distance FROM embeddings v, q ORDER BY distance, vec_id LIMIT 10 OFFSET 20) SELECT vec_id, distance FROM d")
def search_page(spark, sf_dir):
    """The third page of ten."""
    near = knn.with_query(embeddings(spark, sf_dir), query0(spark, sf_dir)).select("vec_id", F.round(V.distance(F.col("embedding"), F.col("q")), 6).alias("distance"))
    return near.orderBy("distance", "vec_id").offset(20).limit(10)


@REG.query(r"WITH s AS (SELECT doc_id, lang, source, list_filter(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ss FROM documents), c AS (SELECT *, unnest(range(1, len(ss) + 1, 4)) AS i FROM s) SELECT doc_id, ((i - 1) // 4)::BIGINT AS chunk_index, ceil(len(ss) / 4)::BIGINT AS total_chunks, md5(substr(array_to_string(ss[i:i + 4], ' '), 1, 500)) AS preview, lang, source FROM c")
def chunk_records(spark, sf_dir):
    """The record stored for each chunk: its place, the first 500 characters (as a digest), the document's fields."""
    d = documents(spark, sf_dir).withColumn("c", T.sentence_chunks(F.col("text")))
    rows = d.select("doc_id", "lang", "source", F.size("c").cast("long").alias("total_chunks"), F.posexplode("c").alias("i", "t"))
    return rows.select("doc_id", F.col("i").cast("long").alias("chunk_index"), "total_chunks", F.md5(F.substring("t", 1, 500)).alias("preview"), "lang", "source")


@REG.query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), props) AS text FROM events WHERE props IS NOT NULL")
def json_path(spark, sf_dir):
    """A field by its path, or else the whole record."""
    return table(spark, sf_dir, "events", "event_id", "props").filter("props is not null").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.col("props")).alias("text"))


@REG.query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'd' ELSE 'u' END AS op, concat_ws(' ', event_type, CASE WHEN json_extract_string(props, '$.k') <> '' THEN json_extract_string(props, '$.k') END) AS text, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS after_value FROM events")
def cdc_projection(spark, sf_dir):
    """Text and fields of each change: the columns that aren't empty, joined; a delete has no image after it."""
    k = F.get_json_object("props", "$.k")
    gone = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select("event_id", F.when(gone, "d").otherwise("u").alias("op"), F.concat_ws(" ", "event_type", F.when(k != "", k)).alias("text"), F.when(~gone, F.col("value")).alias("after_value"))


@REG.query("SELECT c_custkey, map_extract(map_from_entries(list_concat([{'k': 'policy', 'v': 'private'}], [{'k': 'name', 'v': c_name}])), 'policy')[1] AS policy, c_name AS name FROM customer")
def policy_merge(spark, sf_dir):
    """Collection policy over row metadata: the policy wins, null entries are dropped."""
    own = F.create_map(F.lit("policy"), F.lit("open"), F.lit("name"), F.col("c_name"), F.lit("content_uri"), F.lit(None).cast("string"))
    policy = F.create_map(F.lit("policy"), F.lit("private"))
    kept = F.map_filter(own, lambda k, v: v.isNotNull() & ~F.array_contains(F.map_keys(policy), k))
    m = F.map_concat(kept, policy)
    return table(spark, sf_dir, "customer", "c_custkey", m.alias("m")).select("c_custkey", F.col("m")["policy"].alias("policy"), F.col("m")["name"].alias("name"))


@REG.query("SELECT url, page_id FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS n FROM pages) WHERE n = 1 ORDER BY length(url), page_id LIMIT 10")
def frontier_pop(spark, sf_dir):
    """The ten next addresses of the queue, each address once, shallow ones first."""
    first = table(spark, sf_dir, "pages", "url", "page_id").groupBy("url").agg(F.min("page_id").alias("page_id"))
    return first.orderBy(F.length("url"), "page_id").limit(10)


@REG.query("SELECT page_id FROM pages WHERE length(html) >= 200 AND len(string_split(url, '/')) - 3 <= 3 AND starts_with(url, 'http')")
def crawl_admission(spark, sf_dir):
    """Pages that are long, shallow and fetched by HTTP."""
    return table(spark, sf_dir, "pages").filter((F.length("html") >= 200) & (F.size(F.split("url", "/")) - 3 <= 3) & F.col("url").startswith("http")).select("page_id")


def expansion(tokens, most: int = 6):
    """Words that abbreviations and synonyms of the tokens add, at most ``most``, none that is there."""
    table_ = F.create_map(*[x for k, v in {**{k: v.split() for k, v in ABBREVIATIONS.items()}, **SYNONYMS}.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    found = F.flatten(F.transform(F.filter(F.array_distinct(tokens), lambda w: F.map_contains_key(table_, w)), lambda w: table_[w]))
    return F.slice(F.array_except(found, tokens), 1, most)


_MAP = "map {" + ", ".join(f"'{k}': [" + ", ".join(f"'{w}'" for w in v) + "]" for k, v in {**{k: v.split() for k, v in ABBREVIATIONS.items()}, **SYNONYMS}.items()) + "}"
_TOK = r"list_transform(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-zA-Z0-9_]+')), lambda w: lower(w))"


@REG.query(f"WITH t AS (SELECT item_id, {_TOK} AS tok FROM benchmark), d AS (SELECT item_id, tok, list_filter(tok, lambda w, i: list_position(tok, w) = i) AS dis FROM t), f AS (SELECT item_id, tok, flatten(list_transform(list_filter(dis, lambda w: map_contains({_MAP}, w)), lambda w: {_MAP}[w])) AS found FROM d) SELECT item_id, array_to_string(list_filter(found, lambda w, i: list_position(found, w) = i AND NOT list_contains(tok, w))[:6], ' ') AS extra FROM f")
def query_expand(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(expansion(T.tokens(F.col("text"))), " ").alias("extra"))


@REG.query("WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), m AS (SELECT label, d, avg(x) AS m, count(*) AS n FROM x GROUP BY ALL) SELECT d::BIGINT - 1 AS d, round(sum(m * n) / sum(n), 6) AS delta FROM m GROUP BY d")
def federated_average(spark, sf_dir):
    """The clients' mean changes (a client for each label), weighted by their rows."""
    x = embeddings(spark, sf_dir).select("label", F.posexplode("embedding").alias("d", "x"))
    m = x.groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    return m.groupBy(F.col("d").cast("long").alias("d")).agg(F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 6).alias("delta"))


@REG.query("WITH a AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'view') AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'view') AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT coalesce(a.user_id, b.user_id) AS user_id, (coalesce(a.c, 0) > coalesce(b.c, 0) AND coalesce(a.v, 0) < coalesce(b.v, 0)) OR (coalesce(a.c, 0) < coalesce(b.c, 0) AND coalesce(a.v, 0) > coalesce(b.v, 0)) AS conflict FROM a FULL JOIN b ON a.user_id = b.user_id")
def clock_conflicts(spark, sf_dir):
    """Vector clocks of two replicas: concurrent ones conflict, equal ones don't."""

    def clock(rows: DataFrame, name: str) -> DataFrame:
        of = lambda t: F.count_if(F.col("event_type") == t)
        return rows.groupBy("user_id").agg(of("click").alias(f"{name}c"), of("view").alias(f"{name}v"))

    e = table(spark, sf_dir, "events", "user_id", "event_id", "event_type")
    j = clock(e.filter("event_id % 2 = 0"), "a").join(clock(e.filter("event_id % 2 = 1"), "b"), "user_id", "full").fillna(0, ["ac", "av", "bc", "bv"])
    return j.select("user_id", F.expr("(ac > bc and av < bv) or (ac < bc and av > bv)").alias("conflict"))


@REG.query("SELECT o_orderstatus, count(*) AS n, round(avg(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END), 2) AS avg_ms FROM orders GROUP BY o_orderstatus")
def trace_averages(spark, sf_dir):
    """Averages over successes only."""
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice"))), 2).alias("avg_ms"))


@REG.query("WITH m AS (SELECT event_type, count(*) AS n, greatest(0, 100 - avg(value)) * 0.4 + 0.6 * 100 * (count(*) FILTER (value > 50) / count(*)) AS s FROM events GROUP BY 1) SELECT event_type AS method, round(CASE WHEN n < 3 THEN 100 ELSE s END, 6) AS score FROM m")
def adaptive_method_scores(spark, sf_dir):
    """Latency and recall of each method as one score; methods with few samples are tried first."""
    recall = F.count_if(F.col("value") > 50) / F.count(F.lit(1))
    m = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("method")).agg(F.count(F.lit(1)).alias("n"), (F.greatest(F.lit(0.0), 100 - F.avg("value")) * 0.4 + 60 * recall).alias("s"))
    return m.select("method", F.round(F.when(F.col("n") < 3, 100.0).otherwise(F.col("s")), 6).alias("score"))


def ridge(rows: DataFrame, features: list[str], target: str, penalty: float = 1e-3) -> np.ndarray:
    """Weights of standardised features by normal equations, whose sums Spark aggregates; k * k numbers reach the driver."""
    k = len(features)
    sums = rows.agg(*[F.sum(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"p{i}_{j}") for i, a in enumerate([*features, target]) for j, b in enumerate([*features, target])], *[F.avg(a).alias(f"m{i}") for i, a in enumerate([*features, target])], F.count(F.lit(1)).alias("n")).first()
    n, mean = sums["n"], np.array([sums[f"m{i}"] for i in range(k + 1)], float)
    cov = np.array([[sums[f"p{i}_{j}"] for j in range(k + 1)] for i in range(k + 1)]) / n - np.outer(mean, mean)
    size = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    x = cov[:k, :k] / np.outer(size[:k], size[:k])
    return np.linalg.solve(x + penalty * np.eye(k), cov[:k, k] / size[:k])


@REG.query()
def ltr_linear(spark, sf_dir):
    """Weights of a linear ranker: document length, day and value against clicks."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.dayofmonth("ts").alias("day"))
    rows = e.join(documents(spark, sf_dir, F.col("doc_id").alias("event_id"), "n_chars"), "event_id").withColumn("y", (F.col("event_type") == "click").cast("double")).fillna(0.0, ["value"])
    names = ["n_chars", "day", "value"]
    return spark.createDataFrame(list(zip(names, map(float, ridge(rows, names, "y")))), "feature string, weight double")


@REG.query("WITH p AS (SELECT a.event_type AS better, b.event_type AS worse FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type <> b.event_type AND a.value > b.value) SELECT better, worse, count(*) AS n FROM p GROUP BY ALL")
def preference_counts(spark, sf_dir):
    """How often one kind beats another within a user. Counts of each kind below each value, in one pass over the sorted values: no pairs are made."""
    e = table(spark, sf_dir, "events", "user_id", "event_type", "value").filter("value is not null and user_id is not null and event_type is not null")
    kinds = sorted(r[0] for r in e.select("event_type").distinct().collect())  # the result has a row for each two of them
    of = [F.count_if(F.col("event_type") == k).alias(f"c{i}") for i, k in enumerate(kinds)]
    w = Window.partitionBy("user_id").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    below = e.groupBy("user_id", "value").agg(*of).withColumns({f"b{i}": F.coalesce(F.sum(f"c{i}").over(w), F.lit(0)) for i in range(len(kinds))})
    sums = [F.struct(F.lit(a).alias("better"), F.lit(b).alias("worse"), F.sum(F.col(f"c{i}") * F.col(f"b{j}")).alias("n")) for i, a in enumerate(kinds) for j, b in enumerate(kinds) if i != j]
    return below.agg(F.array(*sums).alias("s")).select(F.inline("s")).filter("n > 0")


@REG.query()
def bradley_terry(spark, sf_dir):
    """Strengths of the kinds fitted to the preference counts by gradient ascent; the table of counts is kinds by kinds."""
    pairs = [(r["better"], r["worse"], r["n"]) for r in preference_counts(spark, sf_dir).collect()]
    kinds = sorted({x for a, b, _ in pairs for x in (a, b)})
    wins = np.zeros((len(kinds), len(kinds)))
    for a, b, n in pairs:
        wins[kinds.index(a), kinds.index(b)] = n
    w = np.zeros(len(kinds))
    for _ in range(500):
        p = 1 / (1 + np.exp(w[None, :] - w[:, None]))
        miss = wins * (1 - p)
        w += 0.5 * (miss.sum(1) - miss.sum(0)) / max(wins.sum(), 1)
        w -= w.mean()
    return spark.createDataFrame([(k, float(x)) for k, x in zip(kinds, w)], "kind string, strength double")


@REG.query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS recent, count(*) OVER (PARTITION BY user_id) AS total FROM events QUALIFY recent <= 5")
def personal_history(spark, sf_dir):
    """The last five of each user beside the total."""
    w = Window.partitionBy("user_id")
    rows = table(spark, sf_dir, "events", "user_id", "event_id", "ts").withColumn("total", F.count(F.lit(1)).over(w)).withColumn("recent", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id"))).cast("long"))
    return rows.filter("recent <= 5").select("user_id", "event_id", "recent", "total")
