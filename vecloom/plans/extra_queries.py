"""Registered queries: write path, governance, telemetry, tuning rules, evaluation, text preparation, ranking models, graph features."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions import text as T
from vecloom.functions import vectors as V
from vecloom.functions.predicates import Filter
from vecloom.operators import graph, knn, ranking, retrieval, series
from vecloom.plans import text_queries as TQ
from vecloom.plans import vector_queries as VQ
from vecloom.plans.ops_queries import events
from vecloom.plans.text_queries import documents
from vecloom.plans.vector_queries import Q, embeddings, query0
from vecloom.registry import Registry
from vecloom.sources import tables
from vecloom.sources.tables import table

REG = Registry()
K = 10


# Write path


@REG.query("SELECT c_custkey, c_name, round(CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 100 ELSE c_acctbal END, 2) AS balance FROM customer WHERE c_custkey % 7 <> 3 UNION ALL SELECT -s_suppkey - 1, s_name, round(s_acctbal, 2) FROM supplier")
def write_path_state(spark, sf_dir):
    """Inserts, updates and deletes by id: new rows, changed balances, then rows that go."""
    base = table(spark, sf_dir, "customer", "c_custkey", "c_name", F.round("c_acctbal", 2).alias("balance"))
    fresh = table(spark, sf_dir, "supplier", (-F.col("s_suppkey") - 1).alias("c_custkey"), F.col("s_name").alias("c_name"), F.round("s_acctbal", 2).alias("balance"))
    changed = table(spark, sf_dir, "customer").filter("c_custkey % 10 = 0").select("c_custkey", "c_name", F.round(F.col("c_acctbal") + 100, 2).alias("balance"))
    gone = table(spark, sf_dir, "customer", "c_custkey").filter("c_custkey % 7 = 3")
    return tables.delete(tables.upsert(tables.upsert(base, fresh, "c_custkey"), changed, "c_custkey"), gone, "c_custkey")


@REG.query(r"WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ss FROM documents WHERE doc_id % 5 <> 0) SELECT doc_id, ceil(len(ss) / 4)::BIGINT AS chunks FROM s WHERE len(ss) > 0")
def delete_document_chunks(spark, sf_dir):
    """The chunks that are left when the documents whose id is divisible by 5 are deleted with all their chunks."""
    chunks = documents(spark, sf_dir, "doc_id", T.sentence_chunks(F.col("text")).alias("c")).select("doc_id", F.explode("c").alias("chunk")).select("doc_id")
    gone = documents(spark, sf_dir, "doc_id").filter("doc_id % 5 = 0")
    return tables.delete(chunks, gone, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))


@REG.query(f"WITH u AS ({TQ.REG.sql['url_canonical']}) SELECT url, min(page_id) AS page_id FROM u WHERE page_id % 2 = 1 AND url NOT IN (SELECT url FROM u WHERE page_id % 2 = 0) GROUP BY url")
def frontier_insert_if_new(spark, sf_dir):
    """Addresses that enter the queue: canonical, not there yet, each once."""
    u = table(spark, sf_dir, "pages", "page_id", T.canonical_url(F.col("url")).alias("url"))
    return tables.insert_if_new(u.filter("page_id % 2 = 0"), u.filter("page_id % 2 = 1").groupBy("url").agg(F.min("page_id").alias("page_id")), "url")


@REG.query("SELECT CASE page_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'done' ELSE 'failed' END AS status, count(*) AS n FROM pages GROUP BY 1")
def frontier_counts(spark, sf_dir):
    status = F.when(F.col("page_id") % 3 == 0, "pending").when(F.col("page_id") % 3 == 1, "done").otherwise("failed")
    return table(spark, sf_dir, "pages", status.alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@REG.query("SELECT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-25' EXCEPT SELECT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-15'")
def unseen_items(spark, sf_dir):
    """What each user met lately and not before: the set without what was seen."""
    e = events(spark, sf_dir, "user_id", "event_type", "ts")
    late, early = e.filter(F.col("ts") >= datetime.datetime(2024, 1, 25)), e.filter(F.col("ts") < datetime.datetime(2024, 1, 15))
    return late.select("user_id", "event_type").subtract(early.select("user_id", "event_type"))


@REG.query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def sql_statement(spark, sf_dir):
    """A statement in SQL over the tables, which are registered as views."""
    return tables.sql(spark, sf_dir, "select label, count(*) as n from embeddings group by label")


@REG.query(f"WITH {Q}, d AS (SELECT vec_id, {VQ.L2} AS distance FROM embeddings v, q WHERE vec_id % 3 <> 1 ORDER BY distance, vec_id LIMIT {K}) SELECT row_number() OVER (ORDER BY distance, vec_id) AS rank, vec_id, distance FROM d")
def knn_with_tombstones(spark, sf_dir):
    """Deleted vectors take no part in the search, so the answer is full."""
    e = embeddings(spark, sf_dir, "vec_id", "embedding")
    dead = e.filter("vec_id % 3 = 1").select("vec_id")
    return knn.exact(tables.delete(e, dead, "vec_id"), query0(spark, sf_dir), K, "euclidean").select("rank", "vec_id", F.round("distance", 6).alias("distance"))


@REG.query(f"WITH docs2 AS (SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 'the und tion the' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 0), {TQ.bm25_sql().replace('FROM documents', 'FROM docs2')} {TQ.TOP}")
def bm25_after_updates(spark, sf_dir):
    """Documents replaced and removed by id; statistics follow."""
    d = documents(spark, sf_dir, "doc_id", "text")
    changed = d.filter("doc_id % 10 = 1").select("doc_id", F.lit("the und tion the").alias("text"))
    state = tables.delete(tables.upsert(d, changed, "doc_id"), d.filter("doc_id % 10 = 0"), "doc_id")
    return retrieval.top(retrieval.bm25(state, TQ.QUERY), K).select("rank", "doc_id", "score")


# Governance


@REG.query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def namespace_filter(spark, sf_dir):
    """Rows of one namespace only."""
    df = table(spark, sf_dir, "customer")
    return df.filter(Filter.eq("c_mktsegment", "BUILDING").column(schema=df.schema)).select("c_custkey")


GRANTS = [("reader", "read"), ("writer", "read"), ("writer", "write"), ("admin", "read"), ("admin", "write"), ("admin", "delete"), ("admin", "admin")]


@REG.query("WITH g(role, permission) AS (VALUES ('reader', 'read'), ('writer', 'read'), ('writer', 'write'), ('admin', 'read'), ('admin', 'write'), ('admin', 'delete'), ('admin', 'admin')), a AS (SELECT event_id, ['none', 'reader', 'writer', 'admin'][user_id % 4 + 1] AS role, CASE event_type WHEN 'purchase' THEN 'write' WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'admin' ELSE 'read' END AS permission FROM events) SELECT a.event_id, g.role IS NOT NULL AS allowed FROM a LEFT JOIN g USING (role, permission)")
def rbac_gate(spark, sf_dir):
    """Whether the user's role grants what each action asks for."""
    role = F.get(F.array(*map(F.lit, ("none", "reader", "writer", "admin"))), (F.col("user_id") % 4).cast("int"))
    asks = F.when(F.col("event_type") == "purchase", "write").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "admin").otherwise("read")
    grants = spark.createDataFrame(GRANTS, "role string, permission string").withColumn("allowed", F.lit(True))
    a = events(spark, sf_dir).select("event_id", role.alias("role"), asks.alias("permission"))
    return a.join(F.broadcast(grants), ["role", "permission"], "left").select("event_id", F.coalesce("allowed", F.lit(False)).alias("allowed"))


@REG.query("SELECT n_nationkey, r_regionkey, n_nationkey % 3 = 0 OR n_regionkey = r_regionkey AS allowed FROM nation, region")
def residency(spark, sf_dir):
    """Where a tenant's data may lie: anywhere unless it is pinned (two of three are), else in its own region."""
    pinned = F.when(F.col("n_nationkey") % 3 != 0, F.col("n_regionkey"))
    n = table(spark, sf_dir, "nation", "n_nationkey", pinned.alias("pinned"))
    return n.join(table(spark, sf_dir, "region", "r_regionkey"), how="cross").select("n_nationkey", "r_regionkey", (F.col("pinned").isNull() | (F.col("pinned") == F.col("r_regionkey"))).alias("allowed"))


@REG.query("SELECT item_id, sha256('{\"k\":10,\"query\":' || to_json(text) || '}') AS key FROM benchmark WHERE text IS NOT NULL AND NOT regexp_matches(text, '[^ -~]')")
def cache_key(spark, sf_dir):
    """The digest of a search as JSON with sorted fields, for queries of plain ASCII."""
    b = table(spark, sf_dir, "benchmark").filter(F.col("text").isNotNull() & ~F.col("text").rlike("[^ -~]"))
    return b.select("item_id", F.sha2(F.to_json(F.struct(F.lit(10).alias("k"), F.col("text").alias("query"))), 256).alias("key"))


@REG.query("SELECT n_nationkey AS tenant, coalesce(e.n, 0) AS audit_events, least(coalesce(e.n, 0), 5) AS events_sampled, coalesce(c.n, 0) AS budgets FROM nation LEFT JOIN (SELECT user_id % 25 AS t, count(*) AS n FROM events GROUP BY 1) e ON e.t = n_nationkey LEFT JOIN (SELECT c_nationkey AS t, count(*) AS n FROM customer GROUP BY 1) c ON c.t = n_nationkey")
def compliance_report(spark, sf_dir):
    """Counts of audit events and configured budgets for each tenant, those without any included."""
    e = events(spark, sf_dir).groupBy((F.col("user_id") % 25).alias("tenant")).agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("tenant")).agg(F.count(F.lit(1)).alias("m"))
    j = table(spark, sf_dir, "nation", F.col("n_nationkey").alias("tenant")).join(e, "tenant", "left").join(c, "tenant", "left").fillna(0, ["n", "m"])
    return j.select("tenant", F.col("n").alias("audit_events"), F.least("n", F.lit(5)).alias("events_sampled"), F.col("m").alias("budgets"))


@REG.query("SELECT event_type, count(*) FILTER (ts < TIMESTAMP '2024-01-10') AS purged, count(*) FILTER (ts >= TIMESTAMP '2024-01-10') AS kept FROM events GROUP BY event_type")
def audit_purge(spark, sf_dir):
    """What a purge of the log before a day removes and leaves."""
    old = F.col("ts") < datetime.datetime(2024, 1, 10)
    return events(spark, sf_dir, "event_type", "ts").groupBy("event_type").agg(F.count_if(old).alias("purged"), F.count_if(~old).alias("kept"))


@REG.query("SELECT user_id, count(*) AS events, min(event_id) AS first_event, max(event_id) AS last_event, round(sum(value), 4) AS total FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'signup') GROUP BY user_id")
def gdpr_export(spark, sf_dir):
    """What is stored about the users who asked (here those with a signup)."""
    asked = events(spark, sf_dir, "user_id", "event_type").filter("event_type = 'signup'").select("user_id").distinct()
    return events(spark, sf_dir).join(asked, "user_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.round(F.sum("value"), 4).alias("total"))


@REG.query("SELECT c_custkey, '[NAME]' AS name, '[REDACTED]' AS token, c_mktsegment AS segment, '[PHONE]' AS phone FROM customer")
def pii_fields_nested(spark, sf_dir):
    """Sensitive fields are masked by name at every depth of a record."""
    record = F.struct(F.col("c_name").alias("name"), F.md5("c_name").alias("token"), F.struct(F.col("c_mktsegment").alias("segment"), F.concat(F.lit("555-"), F.col("c_custkey")).alias("phone")).alias("contact"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", record.alias("r"))
    masked = rows.select("c_custkey", T.redact_fields(F.col("r"), rows.schema["r"].dataType, {"name": "[NAME]", "phone": "[PHONE]", "token": "[REDACTED]"}).alias("r"))
    return masked.select("c_custkey", "r.name", "r.token", "r.contact.segment", "r.contact.phone")


# Telemetry


@REG.query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-31' GROUP BY event_type")
def usage_summary(spark, sf_dir):
    """Seven days' use by operation."""
    week = events(spark, sf_dir, "event_type", "value", "ts").filter((F.col("ts") >= datetime.datetime(2024, 1, 24)) & (F.col("ts") < datetime.datetime(2024, 1, 31)))
    return week.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@REG.query("WITH o AS (SELECT event_type, user_id % 4 AS collection, value, row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type, user_id % 4) AS n FROM events WHERE value >= 50) SELECT event_type, collection, max(CASE WHEN i = least(floor(n * 0.95), n - 1) THEN value END) AS p95, count(*) AS n, round(avg(value), 6) AS avg, max(value) AS max FROM o GROUP BY ALL")
def slow_query_stats(spark, sf_dir):
    """Samples at or above the threshold only, by method and collection."""
    slow = events(spark, sf_dir).filter("value >= 50").select("event_type", (F.col("user_id") % 4).alias("collection"), "value")
    return series.nearest_rank(slow, "value", {"p95": 0.95}, ["event_type", "collection"])


@REG.query("WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20') SELECT event_type, max(CASE WHEN i = n // 2 THEN value END) AS p50, max(CASE WHEN i = least(floor(n * 0.95), n - 1) THEN value END) AS p95, count(*) AS n, round(avg(value), 6) AS avg, max(value) AS max FROM o GROUP BY ALL")
def fusion_telemetry(spark, sf_dir):
    """Latencies of each index within a window of time."""
    recent = events(spark, sf_dir, "event_type", "value", "ts").filter(F.col("ts") >= datetime.datetime(2024, 1, 20)).drop("ts")
    return series.nearest_rank(recent, "value", {"p50": 0.5, "p95": 0.95}, ["event_type"])


@REG.query("SELECT category, count(*) AS n FROM (SELECT unnest([event_type, 'group' || user_id % 3]) AS category FROM events) GROUP BY category")
def memory_categories(spark, sf_dir):
    """Rows of each category; a row has two."""
    both = F.explode(F.array(F.col("event_type"), F.concat(F.lit("group"), F.col("user_id") % 3)))
    return events(spark, sf_dir, both.alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@REG.query("SELECT event_id, (SELECT count(*) FROM events WHERE event_type = 'click' OR user_id % 3 = 0) AS total FROM events WHERE event_type = 'click' OR user_id % 3 = 0 ORDER BY ts DESC, event_id DESC LIMIT 10 OFFSET 10")
def memory_page(spark, sf_dir):
    """The second page of rows in a category, newest first, beside the number of all."""
    kinds = F.array(F.col("event_type"), F.concat(F.lit("group"), F.col("user_id") % 3))
    rows = events(spark, sf_dir).filter(F.arrays_overlap(kinds, F.array(F.lit("click"), F.lit("group0"))))
    return tables.page(rows, [F.desc("ts"), F.desc("event_id")], 10, 10).select("event_id").crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))


@REG.query("WITH u AS (SELECT user_id, count(*) AS n, date_diff('second', max(ts), TIMESTAMP '2024-02-01') / 86400.0 AS idle FROM events GROUP BY user_id), t AS (SELECT CASE WHEN idle > 7 THEN 'cold' WHEN idle > 1 AND n < 50 THEN 'warm' ELSE 'hot' END AS tier FROM u) SELECT count(*) FILTER (tier = 'hot') AS hot, count(*) FILTER (tier = 'warm') AS warm, count(*) FILTER (tier = 'cold') AS cold FROM t")
def tier_counts(spark, sf_dir):
    """One row with a column for each tier."""
    from vecloom.plans.ops_queries import tier_transition

    return tier_transition(spark, sf_dir).agg(*[F.count_if(F.col("tier") == t).alias(t) for t in ("hot", "warm", "cold")])


@REG.query("SELECT count(*) AS tracked, coalesce(sum(n), 0)::BIGINT AS checks, round(coalesce(avg(n), 0), 6) AS avg_checks FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)")
def freshness_stats(spark, sf_dir):
    n = events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("tracked"), F.coalesce(F.sum("n"), F.lit(0)).alias("checks"), F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 6).alias("avg_checks"))


@REG.query("WITH a AS (SELECT user_id, max(event_id) AS at FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, max(event_id) AS at FROM events WHERE event_id % 2 = 1 AND event_type <> 'view' GROUP BY 1) SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN b.user_id IS NULL OR a.at > b.at THEN 'send' ELSE 'receive' END AS direction FROM a FULL JOIN b ON a.user_id = b.user_id")
def replica_delta(spark, sf_dir):
    """What one replica has to send to the other, and to receive from it: the newer state of each key wins."""
    e = events(spark, sf_dir, "user_id", "event_id", "event_type")
    a = e.filter("event_id % 2 = 0").groupBy("user_id").agg(F.max("event_id").alias("x"))
    b = e.filter("event_id % 2 = 1 and event_type <> 'view'").groupBy("user_id").agg(F.max("event_id").alias("y"))
    return a.join(b, "user_id", "full").select("user_id", F.when(F.col("y").isNull() | (F.col("x") > F.col("y")), "send").otherwise("receive").alias("direction"))


# Tuning rules


@REG.query("WITH n AS (SELECT c_nationkey, count(*) * 1000 AS n FROM customer GROUP BY 1) SELECT c_nationkey, CASE WHEN n < 1000 THEN 16 WHEN n < 10000 THEN 32 WHEN n < 100000 THEN 48 ELSE 64 END AS m, CASE WHEN n < 1000 THEN 200 WHEN n < 10000 THEN 300 WHEN n < 100000 THEN 400 ELSE 500 END AS ef_construction, greatest(1, floor(sqrt(n)))::INT AS nlist, least(10, greatest(1, floor(floor(sqrt(n)) / 10)))::INT AS nprobes FROM n")
def index_parameters(spark, sf_dir):
    """Parameters of a graph index and of inverted cells by the size of the collection."""
    n = table(spark, sf_dir, "customer", "c_nationkey").groupBy("c_nationkey").agg((F.count(F.lit(1)) * 1000).alias("n"))
    step = lambda *v: F.when(F.col("n") < 1000, v[0]).when(F.col("n") < 10_000, v[1]).when(F.col("n") < 100_000, v[2]).otherwise(v[3])
    cells = F.greatest(F.lit(1), F.floor(F.sqrt("n")).cast("int"))
    return n.select("c_nationkey", step(16, 32, 48, 64).alias("m"), step(200, 300, 400, 500).alias("ef_construction"), cells.alias("nlist"), F.least(F.lit(10), F.greatest(F.lit(1), F.floor(cells / 10).cast("int"))).alias("nprobes"))


@REG.query("SELECT n_nationkey, CASE WHEN n_nationkey / 25.0 < 0.07 THEN 'binary' WHEN n_nationkey / 25.0 < 0.15 THEN 'pq' WHEN n_nationkey / 25.0 < 0.30 THEN 'int8' END AS target FROM nation")
def precision_downgrade(spark, sf_dir):
    """The precision that a share of free memory calls for; none where there is enough."""
    free = F.col("n_nationkey") / 25.0
    return table(spark, sf_dir, "nation").select("n_nationkey", F.when(free < 0.07, "binary").when(free < 0.15, "pq").when(free < 0.30, "int8").alias("target"))


@REG.query("WITH m AS (SELECT event_type, count(*) AS n, greatest(0, 100 - avg(value)) * 0.4 + 0.6 * 100 * (count(*) FILTER (value > 50) / count(*)) AS s FROM events GROUP BY 1) SELECT event_type AS method, round(CASE WHEN n < 3 THEN 100 ELSE s END, 6) AS score FROM m ORDER BY 2 DESC, 1 LIMIT 1")
def adaptive_best_method(spark, sf_dir):
    """The method of the best score."""
    from vecloom.plans.more_queries import adaptive_method_scores

    return adaptive_method_scores(spark, sf_dir).orderBy(F.desc("score"), "method").limit(1)


@REG.query("SELECT dtype, (SELECT count(*) FROM embeddings) * 64 * size AS bytes, round((SELECT count(*) FROM embeddings) * 64 * size / 1048576.0, 6) AS mb, round(4.0 / size, 6) AS ratio FROM (VALUES ('float64', 8), ('float32', 4), ('float16', 2), ('int8', 1)) t(dtype, size)")
def memory_estimate(spark, sf_dir):
    """Bytes of the collection in each type, and how many times smaller than single precision that is."""
    kinds = spark.createDataFrame([("float64", 8), ("float32", 4), ("float16", 2), ("int8", 1)], "dtype string, size long")
    n = embeddings(spark, sf_dir, "embedding").agg(F.sum(F.size("embedding")).alias("n"))
    total = F.col("n") * F.col("size")
    return kinds.crossJoin(F.broadcast(n)).select("dtype", total.alias("bytes"), F.round(total / 1048576.0, 6).alias("mb"), F.round(4.0 / F.col("size"), 6).alias("ratio"))


@REG.query("WITH x AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 1e6) AS v FROM embeddings), m AS (SELECT max(list_max(list_transform(v, lambda x: abs(x)))) AS top FROM x) SELECT vec_id, round(list_max(list_transform(v, lambda x: abs(x))) * CASE WHEN top > 65504 THEN 65504 / top ELSE 1.0 END, 3) AS largest FROM x, m")
def half_precision_scale(spark, sf_dir):
    """The largest magnitude of each vector, scaled so that the whole collection fits half precision."""
    v = embeddings(spark, sf_dir, "vec_id", "embedding").select("vec_id", F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double") * 1e6))).alias("top"))
    most = v.agg(F.max("top").alias("most"))
    return v.crossJoin(F.broadcast(most)).select("vec_id", F.round(F.col("top") * F.when(F.col("most") > 65504, F.lit(65504.0) / F.col("most")).otherwise(1.0), 3).alias("largest"))


@REG.query(f"WITH {Q} SELECT vec_id, round(1 - {VQ.COS}, 6) AS similarity FROM embeddings v, q")
def similarity_conversion(spark, sf_dir):
    """Adapters hand on 1 - distance."""
    near = knn.with_query(embeddings(spark, sf_dir, "vec_id", "embedding"), query0(spark, sf_dir))
    return near.select("vec_id", F.round(1 - F.round(V.distance(F.col("embedding"), F.col("q")), 6), 6).alias("similarity"))


@REG.query("WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), v AS (SELECT d, var_pop(x) AS v FROM x GROUP BY d), n AS (SELECT sqrt(sum(x * x)) AS n FROM x GROUP BY vec_id) SELECT (SELECT round(avg(n), 6) FROM n) AS mean_norm, (SELECT round(stddev_pop(n), 6) FROM n) AS std_norm, round(stddev_pop(v) / avg(v), 6) AS variance_cv FROM v")
def dataset_statistics(spark, sf_dir):
    """Norms, and how unevenly the dimensions vary."""
    e = embeddings(spark, sf_dir, "vec_id", "embedding")
    n, total, square = knn.moments(e, 64)
    var = square.diagonal() / n - (total / n) ** 2
    norms = e.agg(F.round(F.avg(V.norm(F.col("embedding"))), 6).alias("mean_norm"), F.round(F.stddev_pop(V.norm(F.col("embedding"))), 6).alias("std_norm"))
    return norms.withColumn("variance_cv", F.lit(round(float(var.std() / var.mean()), 6)))


@REG.query("WITH d AS (SELECT a.vec_id AS query_id, floor(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) * 1000)::BIGINT AS bin FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), r AS (SELECT query_id, bin, row_number() OVER (PARTITION BY query_id ORDER BY bin) - 1 AS i, count(*) OVER (PARTITION BY query_id) AS n FROM d), p AS (SELECT query_id, min(bin) AS near, max(CASE WHEN i = greatest(1, floor(n * 0.9)) THEN bin END) AS far FROM r GROUP BY query_id) SELECT round(avg(near) / 1000, 6) AS nearest, round(avg(far) / 1000, 6) AS far FROM p")
def cluster_structure(spark, sf_dir):
    """Mean distance to the nearest vector, and to the one at nine tenths of all, in thousandths: blocks send counts of each thousandth."""
    e = embeddings(spark, sf_dir, "vec_id", "embedding")
    bins = knn.distance_counts(knn.query_set(e), e, 1000)
    w = knn.Window.partitionBy("query_id")
    at = bins.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)})
    per = at.groupBy("query_id").agg(F.min("bin").alias("near"), F.min(F.when(F.col("upto") > F.greatest(F.lit(1), F.floor(F.col("all") * 0.9)), F.col("bin"))).alias("far"))
    return per.agg(F.round(F.avg("near") / 1000, 6).alias("nearest"), F.round(F.avg("far") / 1000, 6).alias("far"))


# Evaluation


@REG.query(f"WITH {VQ.SET}, f AS (SELECT best.query_id, min(CASE WHEN a.label = b.label THEN rank END) AS first FROM best JOIN embeddings a ON a.vec_id = best.query_id JOIN embeddings b ON b.vec_id = best.vec_id GROUP BY 1) SELECT round(avg((coalesce(first, 99) <= 1)::INT), 6) AS r1, round(avg((coalesce(first, 99) <= 3)::INT), 6) AS r3, round(avg((coalesce(first, 99) <= 5)::INT), 6) AS r5, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM f")
def memory_benchmark(spark, sf_dir):
    """R@1, R@3, R@5 and MRR of the first neighbour with the query's label."""
    e = embeddings(spark, sf_dir)
    near = knn.batch(knn.query_set(e), e, K).select("query_id", "vec_id", "rank")
    own = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("gold"))
    f = near.join(own, "query_id").join(e.select("vec_id", "label"), "vec_id").groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("gold"), F.col("rank"))).alias("first"))
    within = lambda k: F.round(F.avg((F.coalesce("first", F.lit(99)) <= k).cast("int")), 6)
    return f.agg(within(1).alias("r1"), within(3).alias("r3"), within(5).alias("r5"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


@REG.query(f"WITH {VQ.SET}, s AS (SELECT query_id, avg(greatest(0, 1 - distance)) AS cr, max(CASE WHEN rank = 1 THEN greatest(0, 1 - distance) END) AS af, max(CASE WHEN rank = 2 THEN greatest(0, 1 - distance) END) AS ar FROM best WHERE rank <= 5 GROUP BY query_id) SELECT query_id, round(cr, 6) AS context, round(CASE WHEN cr = 0 OR af = 0 OR ar = 0 THEN 0 ELSE 3 / (1 / cr + 1 / af + 1 / ar) END, 6) AS overall FROM s")
def rag_scores(spark, sf_dir):
    """Relevance of the five contexts, and the harmonic mean with two other scores (here the two best similarities stand for the judged ones)."""
    e = embeddings(spark, sf_dir, "vec_id", "embedding")
    near = knn.batch(knn.query_set(e), e, 5).withColumn("s", F.greatest(F.lit(0.0), 1 - F.col("distance")))
    of = lambda r: F.max(F.when(F.col("rank") == r, F.col("s")))
    s = near.groupBy("query_id").agg(F.avg("s").alias("cr"), of(1).alias("af"), of(2).alias("ar"))
    return s.select("query_id", F.round("cr", 6).alias("context"), F.round(retrieval.harmonic(F.col("cr"), F.col("af"), F.col("ar")), 6).alias("overall"))


@REG.query(f"WITH r AS ({VQ.REG.sql['recall_binary_vs_exact']}) SELECT count(*) AS queries, round(avg(recall) * 100, 4) AS recall_percent, round(min(recall), 6) AS least, round(quantile_cont(recall, 0.5), 6) AS p50 FROM r")
def recall_report(spark, sf_dir):
    r = VQ.recall_binary_vs_exact(spark, sf_dir)
    return r.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("recall") * 100, 4).alias("recall_percent"), F.round(F.min("recall"), 6).alias("least"), F.round(F.percentile("recall", 0.5), 6).alias("p50"))


@REG.query()
def parameter_grid(spark, sf_dir):
    """(share, recall) of the search by sign codes for radii from narrow to wide: what a grid search reads the best trade off."""
    e = embeddings(spark, sf_dir, "vec_id", "embedding")
    exact = tables.cut(knn.batch(knn.query_set(e), e, K).select("query_id", "vec_id"))
    out = None
    for share in (0.36, 0.42, 0.47, 0.5):
        hits = knn.binary_search(knn.query_set(e), e, K, share).select("query_id", "vec_id", F.lit(1).alias("hit"))
        row = exact.join(hits, ["query_id", "vec_id"], "left").agg(F.lit(share).alias("share"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"))
        out = row if out is None else out.unionByName(row)
    return out


# Fusion and ranking


@REG.query(f"WITH u AS ({TQ.REG.sql['url_canonical']}), a AS (SELECT u.url, row_number() OVER (ORDER BY length(html) DESC, p.page_id) AS rank FROM pages p JOIN u USING (page_id) ORDER BY length(html) DESC, p.page_id LIMIT 50), b AS (SELECT url, row_number() OVER (ORDER BY page_id DESC) AS rank FROM u ORDER BY page_id DESC LIMIT 50), f AS (SELECT url AS id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, count(*) AS sources FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY url) SELECT id, round(rrf, 6) AS score, sources FROM f ORDER BY round(rrf, 9) DESC, id LIMIT 10")
def rrf_urls(spark, sf_dir):
    """Two ranked lists of pages fused by canonical address."""
    p = table(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url")).alias("id"), F.length("html").alias("n"))
    lists = [knn.ranked(p.orderBy(*by).limit(50), by).select("id", "rank") for by in ([F.desc("n"), "page_id"], [F.desc("page_id")])]
    return retrieval.rrf(lists).orderBy(F.desc(F.round("rrf", 9)), "id").limit(10).select("id", F.round("rrf", 6).alias("score"), "sources")


@REG.query("WITH w AS (SELECT conv_id, role, count(*) AS w FROM conversations WHERE role IS NOT NULL GROUP BY ALL) SELECT conv_id, round(sum(w * q), 6) AS score FROM w JOIN (VALUES ('user', 1.0::DOUBLE), ('assistant', 0.5)) v(role, q) USING (role) GROUP BY conv_id")
def sparse_given_maps(spark, sf_dir):
    """Sparse vectors that the caller provides as maps, multiplied with a query's map."""
    c = table(spark, sf_dir, "conversations").filter("role is not null").groupBy("conv_id", "role").agg(F.count(F.lit(1)).cast("double").alias("w"))
    maps = c.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "w"))).alias("m"))
    return maps.select("conv_id", F.round(retrieval.map_dot(F.col("m"), {"user": 1.0, "assistant": 0.5}), 6).alias("score")).filter("score > 0")


@REG.query("SELECT row_number() OVER (ORDER BY (text IS NULL)::INT, score DESC, conv_id, turn, role) AS rank, conv_id, turn FROM (SELECT *, length(text) AS score FROM conversations ORDER BY conv_id, turn, role LIMIT 50) ORDER BY 1 LIMIT 20")
def rerank_by_scorer(spark, sf_dir):
    """The first fifty ranked again by a scorer, rows without a text last."""
    c = table(spark, sf_dir, "conversations").orderBy("conv_id", "turn", "role").limit(50)
    return retrieval.rerank(c, F.length("text"), F.col("text"), ["conv_id", "turn", "role"], 20).select("rank", "conv_id", "turn")


@REG.query(f"WITH {TQ.DENSE}, {TQ.SPARSE}, {TQ._UNION.format('1.0::DOUBLE', 60, '1.0::DOUBLE')}, p AS (SELECT user_id, count(*) FILTER (event_type = 'click') / count(*) AS share FROM events GROUP BY 1) SELECT s.doc_id, round(coalesce({VQ.COS}, 0.5), 6) AS f_distance, round(s.score, 6) AS f_bm25, round(coalesce(f.rrf, 0), 6) AS f_rrf, 0.5::DOUBLE AS f_rerank, round(least(length(s.text) / 1000, 1.0), 6) AS f_length, round(coalesce(greatest(0.0, 1 - date_diff('day', e.ts, TIMESTAMP '2024-02-01') / 365), 0.5), 6) AS f_freshness, round(coalesce(p.share, 0.5), 6) AS f_popularity, 0.15::DOUBLE AS f_query_length FROM scored s LEFT JOIN embeddings v ON v.vec_id = s.doc_id LEFT JOIN f ON f.id = s.doc_id LEFT JOIN events e ON e.event_id = s.doc_id LEFT JOIN p ON p.user_id = s.doc_id, q")
def ltr_features_all(spark, sf_dir):
    """The eight features of every BM25 match; what is missing has its default."""
    scored = retrieval.bm25(documents(spark, sf_dir), TQ.QUERY, extra={"chars": F.length("text")})
    near = knn.with_query(embeddings(spark, sf_dir, "vec_id", "embedding"), query0(spark, sf_dir)).select(F.col("vec_id").alias("doc_id"), F.round(V.distance(F.col("embedding"), F.col("q")), 6).alias("distance"))
    fused = TQ.fused_under(spark, sf_dir, None, 50).select(F.col("id").alias("doc_id"), "rrf")
    age = events(spark, sf_dir, F.col("event_id").alias("doc_id"), F.datediff(F.lit("2024-02-01").cast("date"), F.col("ts")).alias("age"))
    clicks = events(spark, sf_dir).groupBy(F.col("user_id").alias("doc_id")).agg((F.count_if(F.col("event_type") == "click") / F.count(F.lit(1))).alias("share"))
    j = scored.join(near, "doc_id", "left").join(fused, "doc_id", "left").join(age, "doc_id", "left").join(clicks, "doc_id", "left")
    length, fresh, words = retrieval.ltr_features(j, F.col("chars"), F.col("age"), len(TQ.QUERY))
    or_else = lambda c, d, n: F.round(F.coalesce(c, F.lit(d)), 6).alias(n)
    return j.select("doc_id", or_else(F.col("distance"), 0.5, "f_distance"), F.round("score", 6).alias("f_bm25"), or_else(F.col("rrf"), 0.0, "f_rrf"), F.lit(0.5).alias("f_rerank"), F.round(length, 6).alias("f_length"), or_else(F.when(F.col("age").isNotNull(), fresh), 0.5, "f_freshness"), or_else(F.col("share"), 0.5, "f_popularity"), words)


def click_rows(spark, sf_dir) -> DataFrame:
    """(event_id, n_chars, day, value, y): what the ranking models learn clicks from."""
    e = events(spark, sf_dir).select("event_id", "event_type", F.coalesce("value", F.lit(0.0)).alias("value"), F.dayofmonth("ts").alias("day"))
    return e.join(documents(spark, sf_dir, F.col("doc_id").alias("event_id"), "n_chars"), "event_id").withColumn("y", (F.col("event_type") == "click").cast("double")).drop("event_type")


FEATURES = ["n_chars", "day", "value"]


@REG.query()
def ltr_mlp(spark, sf_dir):
    """(event_id, score): a network of one hidden layer, fitted to a bounded sample of labelled rows, scores every row."""
    rows = click_rows(spark, sf_dir)
    return ranking.scored(rows, ranking.fit_mlp(*ranking.sample(rows, "event_id", FEATURES, "y")), "event_id", FEATURES)


@REG.query()
def ltr_pairwise(spark, sf_dir):
    """(event_id, score): linear weights under the pairwise logistic loss."""
    rows = click_rows(spark, sf_dir)
    return ranking.scored(rows, ranking.fit_pairwise(*ranking.sample(rows, "event_id", FEATURES, "y")), "event_id", FEATURES)


@REG.query()
def ltr_trees(spark, sf_dir):
    """(event_id, score): gradient-boosted trees, fitted by Spark ML on all rows."""
    return ranking.boosted_trees(click_rows(spark, sf_dir), "event_id", FEATURES, "y")


# Text preparation

NOISE = ["please", "kindly", "could", "would", "tell", "me", "show", "the"]
MEANING = ["how", "why", "explain", "difference", "meaning", "understand", "concept", "overview", "compare", "describe"]
_NOISE, _MEANING = (", ".join(f"'{w}'" for w in words) for words in (NOISE, MEANING))
_PLAIN = r"regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"


@REG.query(rf"WITH t AS (SELECT item_id, {_PLAIN} AS plain, list_filter({TQ.TOKENS}, lambda w: NOT list_contains([{_NOISE}], w)) AS tok FROM benchmark) SELECT item_id, md5(plain) AS normal, md5(CASE WHEN len(tok) > 0 THEN array_to_string(tok, ' ') ELSE plain END) AS rewritten, CASE WHEN len(tok) > 0 AND array_to_string(tok, ' ') <> plain THEN 2 ELSE 1 END AS variants FROM t")
def query_rewrite(spark, sf_dir):
    """Queries with single spaces, the same without words of no use, and how many variants of them a search sends."""
    plain = F.regexp_replace(T.strip(F.col("text")), r"\s+", " ")
    t = table(spark, sf_dir, "benchmark").select("item_id", plain.alias("plain"), F.filter(T.tokens(F.col("text")), lambda w: ~w.isin(NOISE)).alias("tok"))
    rewritten = F.when(F.size("tok") > 0, F.array_join("tok", " ")).otherwise(F.col("plain"))
    return t.select("item_id", F.md5("plain").alias("normal"), F.md5(rewritten).alias("rewritten"), F.when(rewritten != F.col("plain"), 2).otherwise(1).alias("variants"))


@REG.query(rf"SELECT item_id, CASE WHEN regexp_matches(text, 'site:|filetype:|intitle:|\"|AND|OR|NOT') OR len(tok) <= 2 THEN 'keyword' WHEN list_has_any(tok, [{_MEANING}]) THEN 'neural' ELSE 'hybrid' END AS route FROM (SELECT item_id, text, {TQ.TOKENS} AS tok FROM benchmark)")
def web_query_route(spark, sf_dir):
    """Operators and very short queries go to keywords, questions of meaning to vectors, others to both."""
    t = table(spark, sf_dir, "benchmark").select("item_id", "text", T.tokens(F.col("text")).alias("tok"))
    signs = F.col("text").rlike('site:|filetype:|intitle:|"|AND|OR|NOT')
    return t.select("item_id", F.when(signs | (F.size("tok") <= 2), "keyword").when(F.arrays_overlap("tok", F.array(*map(F.lit, MEANING))), "neural").otherwise("hybrid").alias("route"))


@REG.query()
def token_chunks(spark, sf_dir):
    """(doc_id, chunk, tokens, text): windows of 512 tokens, 50 of them shared."""
    return TQ.token_chunks(documents(spark, sf_dir, "doc_id", "text"))


@REG.query()
def contextual_chunks(spark, sf_dir):
    """Recursive chunks, each behind the document's first sentence as its summary."""
    d = documents(spark, sf_dir, "doc_id", F.get(T.sentences(F.col("text")), F.lit(0)).alias("summary"))
    return TQ.recursive_chunks(spark, sf_dir).join(d, "doc_id").select("doc_id", "chunk", T.in_context(F.col("summary"), F.col("text")).alias("text"))


_LETTERS = "[" + ", ".join(f"(length(lower(text)) - length(replace(lower(text), '{c}', '')))::DOUBLE" for c in "aeiost") + "]"


@REG.query(f"WITH v AS (SELECT conv_id, turn, role, {_LETTERS} AS v, length(text) AS n FROM conversations WHERE length(text) > 5), d AS (SELECT *, CASE WHEN list_sum(v) = 0 OR list_sum(lag(v) OVER w) = 0 THEN 1.0 ELSE 1 - list_cosine_similarity(v, lag(v) OVER w) END AS dist FROM v WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)), g AS (SELECT *, sum(CASE WHEN round(dist, 9) > 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS chunk FROM d) SELECT conv_id, chunk::BIGINT AS chunk, count(*) AS turns, sum(n)::BIGINT AS chars FROM g GROUP BY ALL")
def semantic_chunks(spark, sf_dir):
    """Turns of a conversation in chunks that end where two neighbours' vectors (counts of six letters stand for an embedding) are more than 0.05 apart."""
    letters = F.array(*[T.substring_count(F.col("text"), F.lit(c)).cast("double") for c in "aeiost"])
    turns = table(spark, sf_dir, "conversations").filter(F.length("text") > 5).select("conv_id", "turn", "role", letters.alias("v"), F.length("text").alias("n"))
    chunks = series.split_where_apart(turns, "conv_id", ["turn", "role"], "v", 0.05)
    return chunks.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("turns"), F.sum("n").alias("chars"))


# Graph features


@REG.query(f"WITH {VQ.EDGES}, l AS (SELECT src, dst FROM links UNION ALL SELECT vec_id, vec_id FROM embeddings), g AS (SELECT src, count(*) AS n FROM l GROUP BY src), x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) SELECT l.src AS node, x.d::BIGINT - 1 AS d, round(sum(x.x / sqrt(a.n * b.n)), 6) AS h FROM l JOIN g a ON a.src = l.src JOIN g b ON b.src = l.dst JOIN x ON x.vec_id = l.dst GROUP BY ALL")
def gcn_propagation(spark, sf_dir):
    """One layer of graph convolution without weights: features summed over neighbours and the node itself, normalised by both degrees."""
    return graph.propagated(VQ.edges(spark, sf_dir), embeddings(spark, sf_dir, "vec_id", "embedding"))


@REG.query(f"WITH {VQ.EDGES}, n AS (SELECT v.vec_id, e.ts FROM embeddings v JOIN events e ON e.event_id = v.vec_id), t AS (SELECT greatest(x.ts, y.ts) AS ts FROM edges JOIN n x ON x.vec_id = a JOIN n y ON y.vec_id = b), c AS (SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM n WHERE ts >= TIMESTAMP '2024-01-01 06:00:00') AS recent_nodes, count(*) AS edges, count(*) FILTER (ts >= TIMESTAMP '2024-01-01 06:00:00') AS recent_edges FROM t) SELECT *, round(recent_edges / greatest(edges - recent_edges, 1) * 100, 2) AS growth_percent, recent_edges / greatest(edges - recent_edges, 1) * 100 > 50 AND recent_nodes > 10 AS bursty FROM c")
def temporal_trend(spark, sf_dir):
    """Nodes and edges before and in a window; a burst is growth beyond half with more than ten new nodes. An edge is as old as its younger end."""
    times = events(spark, sf_dir, F.col("event_id").alias("node"), "ts").join(embeddings(spark, sf_dir, F.col("vec_id").alias("node")), "node", "left_semi")
    return graph.trend(VQ.edges(spark, sf_dir), times, datetime.datetime(2024, 1, 1, 6))


@REG.query(f"WITH RECURSIVE {VQ.EDGES}, reach AS (SELECT 0::BIGINT AS node UNION SELECT l.dst FROM reach JOIN links l ON l.src = reach.node) SELECT (SELECT count(*) FROM reach) AS reached, (SELECT count(DISTINCT src) FROM links) AS nodes")
def graph_reachability(spark, sf_dir):
    """How many nodes can be reached from node 0, for the health of an index."""
    links = tables.cut(graph.both_ways(VQ.edges(spark, sf_dir)).select("src", "dst"))
    reached = graph.reachable(links, spark.createDataFrame([(0,)], "node long"))
    return reached.agg(F.count(F.lit(1)).alias("reached")).crossJoin(F.broadcast(links.agg(F.countDistinct("src").alias("nodes"))))
