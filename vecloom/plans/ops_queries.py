"""Registered queries on events, tenants and operations: series, billing, telemetry, policies, logs, feedback.

``events`` serves as usage log, click log and change log; ``customer`` and ``nation`` as tenants and collections.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from vecloom.functions import vectors as V
from vecloom.operators import knn, retrieval, series
from vecloom.registry import Registry
from vecloom.sources import tables
from vecloom.sources.tables import table

REG = Registry()
NOW = datetime.datetime(2024, 2, 1)


def events(spark, sf_dir, *columns):
    return table(spark, sf_dir, "events", *columns)


# Series

@REG.query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events WHERE user_id IS NOT NULL QUALIFY rank <= 3")
def latest_k_per_user(spark, sf_dir):
    return series.latest(events(spark, sf_dir), "user_id", [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id", "rank")


@REG.query("SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL")
def distinct_series(spark, sf_dir):
    return events(spark, sf_dir, "user_id").filter("user_id is not null").distinct()


@REG.query("WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events), w AS (SELECT user_id, us, n, us AS start FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.us, e.n, CASE WHEN e.us - w.start > 86400000000 THEN e.us ELSE w.start END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1), g AS (SELECT user_id, start, max(us) AS last, count(*) AS events FROM w GROUP BY ALL) SELECT user_id, start AS window_start, coalesce(lead(start) OVER (PARTITION BY user_id ORDER BY start), last) AS window_end, events FROM g")
def anchored_windows(spark, sf_dir):
    return series.anchored_windows(events(spark, sf_dir), "user_id", "ts", 86_400)


@REG.query("SELECT event_type, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    w = F.window(F.col("ts").cast("timestamp"), "1 day")
    return events(spark, sf_dir).groupBy("event_type", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("avg_value")).select("event_type", F.unix_micros("w.start").alias("start"), "n", "avg_value")


@REG.query("WITH x AS (SELECT time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY * i AS start, value FROM events, (SELECT unnest([0, 1]) AS i)) SELECT epoch_us(start) AS start, count(*) AS n FROM x GROUP BY ALL")
def sliding_windows(spark, sf_dir):
    """Two-day windows that begin every day."""
    w = F.window(F.col("ts").cast("timestamp"), "2 days", "1 day")
    return events(spark, sf_dir, "ts").groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.unix_micros("w.start").alias("start"), "n")


@REG.query("WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def session_windows(spark, sf_dir):
    w = F.session_window(F.col("ts").cast("timestamp"), "6 hours")
    return events(spark, sf_dir, "user_id", "ts").groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_micros("w.start").alias("start"), "n")


@REG.query("WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), d AS (SELECT v.vec_id, round(1 - list_cosine_similarity(v.embedding::DOUBLE[], q.q::DOUBLE[]), 6) AS distance FROM embeddings v JOIN events e ON e.event_id = v.vec_id, q WHERE e.ts BETWEEN TIMESTAMP '2024-01-01 02:00:00' AND TIMESTAMP '2024-01-01 12:00:00' ORDER BY distance, v.vec_id LIMIT 10) SELECT row_number() OVER (ORDER BY distance, vec_id) AS rank, vec_id, distance FROM d")
def time_range_knn(spark, sf_dir):
    """Search among the vectors of a time range, both ends included; the range reaches the scan."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    when = events(spark, sf_dir, F.col("event_id").alias("vec_id"), "ts").filter(F.col("ts").between(datetime.datetime(2024, 1, 1, 2), datetime.datetime(2024, 1, 1, 12)))
    return knn.exact(e.join(when, "vec_id", "left_semi"), knn.query_vector(e, 0), 10).select("rank", "vec_id", F.round("distance", 6).alias("distance"))


@REG.query("WITH RECURSIVE e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), f AS (SELECT user_id, 0::BIGINT AS n, 24.0::DOUBLE AS hours FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT e.user_id, e.n, CASE WHEN e.event_type = 'purchase' THEN greatest(1.0::DOUBLE, f.hours * 0.5) ELSE least(720.0::DOUBLE, f.hours * 1.5) END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1) SELECT user_id, round(hours, 6) AS hours FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1")
def recrawl_interval(spark, sf_dir):
    """A change (purchase) halves the interval, anything else lengthens it by half, from 1 hour to 30 days."""
    h = series.scaled_and_clamped(events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("event_type") != "purchase", 24.0, 1.5, 0.5, 1.0, 720.0, "hours")
    return h.select("user_id", F.round("hours", 6).alias("hours"))


@REG.query("WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), f AS (SELECT user_id, 0::BIGINT AS n, 0.0::DOUBLE AS ema FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT e.user_id, e.n, 0.95 * f.ema + 0.05 * coalesce(e.value, 0) FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1) SELECT user_id, round(ema, 6) AS ema FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1")
def preference_ema(spark, sf_dir):
    """A running mean in order of time, a twentieth for each new value."""
    m = series.running_mean(events(spark, sf_dir), "user_id", ["ts", "event_id"], F.coalesce("value", F.lit(0.0)), 0.05, "ema")
    return m.select("user_id", F.round("ema", 6).alias("ema"))


@REG.query("WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL), f AS (SELECT user_id, event_id, us, n, 4.0::DOUBLE AS level FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.us, e.n, least(4.0::DOUBLE, f.level - CASE WHEN f.level >= 1 THEN 1 ELSE 0 END + (e.us - f.us) / 1e6 / 1800) FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1) SELECT user_id, event_id, level >= 1 AS allowed FROM f")
def token_bucket(spark, sf_dir):
    """One request each half hour on average, bursts of four."""
    requests = events(spark, sf_dir).withColumn("cost", F.lit(1.0)).withColumn("ts", F.col("ts").cast("timestamp"))
    return series.token_bucket(requests, "user_id", "ts", "cost", 1 / 1800, 4.0)


@REG.query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS last_hour FROM events")
def sliding_quota(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, 0)
    return events(spark, sf_dir).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).select("event_id", F.count(F.lit(1)).over(w).alias("last_hour"))


# Aggregation

PRICES = [("view", 0.0001), ("click", 0.0004), ("purchase", 0.002), ("signup", 0.5)]


@REG.query("WITH p(event_type, price) AS (VALUES ('view', 0.0001::DOUBLE), ('click', 0.0004), ('purchase', 0.002), ('signup', 0.5)) SELECT user_id, month, u.event_type, n, round(n / CASE WHEN u.event_type = 'signup' THEN 1000.0 ELSE 1.0 END * coalesce(price, 0), 8) AS amount FROM (SELECT user_id, strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n FROM events GROUP BY ALL) u LEFT JOIN p ON p.event_type = u.event_type")
def billing_invoice(spark, sf_dir):
    """Line items by tenant, month and operation; signups are priced by the thousand, operations without a price are free."""
    prices = spark.createDataFrame(PRICES, "event_type string, price double")
    used = events(spark, sf_dir).groupBy("user_id", F.date_format("ts", "yyyy-MM").alias("month"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    unit = F.when(F.col("event_type") == "signup", 1000.0).otherwise(1.0)
    return used.join(F.broadcast(prices), "event_type", "left").select("user_id", "month", "event_type", "n", F.round(F.col("n") / unit * F.coalesce("price", F.lit(0.0)), 8).alias("amount"))


@REG.query("WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, max(CASE WHEN i = n // 2 THEN value END) AS p50, max(CASE WHEN i = least(floor(n * 0.95), n - 1) THEN value END) AS p95, count(*) AS n, round(avg(value), 6) AS avg, max(value) AS max FROM o GROUP BY event_type")
def latency_percentiles_nearest_rank(spark, sf_dir):
    return series.nearest_rank(events(spark, sf_dir, "event_type", "value").filter("value is not null"), "value", {"p50": 0.5, "p95": 0.95}, ["event_type"])


@REG.query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def latency_percentiles_linear(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.99), 6).alias("p99"))


@REG.query("SELECT count(*) AS n, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS zero_rate, round(count(*) FILTER (event_type = 'click') / count(*) FILTER (event_type = 'view'), 6) AS ctr FROM events")
def zero_result_ctr(spark, sf_dir):
    of = lambda t: F.count_if(F.col("event_type") == t)
    return events(spark, sf_dir, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(of("error") / F.count(F.lit(1)), 6).alias("zero_rate"), F.round(of("click") / of("view"), 6).alias("ctr"))


@REG.query("SELECT n_name, count(c_custkey) AS vectors FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def collection_counts_left_join(spark, sf_dir):
    n, c = table(spark, sf_dir, "nation", "n_nationkey", "n_name"), table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    return n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("c_custkey").alias("vectors"))


@REG.query("WITH u AS (SELECT user_id, count(*) AS n, date_diff('second', max(ts), TIMESTAMP '2024-02-01') / 86400.0 AS idle FROM events GROUP BY user_id) SELECT user_id, n, CASE WHEN idle > 7 THEN 'cold' WHEN idle > 1 AND n < 50 THEN 'warm' ELSE 'hot' END AS tier FROM u")
def tier_transition(spark, sf_dir):
    u = events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    idle = F.timestamp_diff("SECOND", F.col("last"), F.lit(NOW).cast("timestamp_ntz")) / 86400
    return u.select("user_id", "n", F.when(idle > 7, "cold").when((idle > 1) & (F.col("n") < 50), "warm").otherwise("hot").alias("tier"))


@REG.query("WITH p(event_type, days, enabled) AS (VALUES ('view', 10, true), ('click', 20, true), ('error', 1, false)) SELECT event_id FROM events JOIN p USING (event_type) WHERE enabled AND ts < TIMESTAMP '2024-02-01' - INTERVAL 1 DAY * days")
def retention_expired(spark, sf_dir):
    """Rows older than the time to live of their enabled policy."""
    policies = spark.createDataFrame([("view", 10, True), ("click", 20, True), ("error", 1, False)], "event_type string, days int, enabled boolean").filter("enabled")
    old = F.col("ts") < F.expr("timestamp_ntz'2024-02-01 00:00:00' - make_dt_interval(days)")
    return events(spark, sf_dir, "event_id", "ts", "event_type").join(F.broadcast(policies), "event_type").filter(old).select("event_id")


REGIONS = [("west", 37.4, -122.1), ("east", 40.7, -74.0), ("europe", 52.5, 13.4), ("asia", 35.7, 139.7)]


@REG.query("WITH r(region, lat, lon) AS (VALUES ('west', 37.4::DOUBLE, -122.1::DOUBLE), ('east', 40.7, -74.0), ('europe', 52.5, 13.4), ('asia', 35.7, 139.7)), d AS (SELECT c_custkey, region, round(2 * 6371 * asin(sqrt(power(sin(radians(lat - (c_custkey % 180 - 90)) / 2), 2) + cos(radians(c_custkey % 180 - 90)) * cos(radians(lat)) * power(sin(radians(lon - (c_custkey % 360 - 180)) / 2), 2))), 3) AS km FROM customer, r) SELECT c_custkey, region, km FROM d QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY km, region) = 1")
def haversine_nearest(spark, sf_dir):
    """Each customer's nearest region; coordinates are made of the key."""
    r = spark.createDataFrame(REGIONS, "region string, lat double, lon double")
    lat, lon = F.col("c_custkey") % 180 - 90, F.col("c_custkey") % 360 - 180
    d = table(spark, sf_dir, "customer", "c_custkey").crossJoin(F.broadcast(r)).withColumn("km", F.round(V.haversine_km(lat, lon, F.col("lat"), F.col("lon")), 3))
    best = d.groupBy("c_custkey").agg(F.min(F.struct("km", "region")).alias("b"))
    return best.select("c_custkey", "b.region", "b.km")


@REG.query("WITH n AS (SELECT c_nationkey, count(*) * 1000 AS n FROM customer GROUP BY 1), c AS (SELECT c_nationkey, 64 * ln(n) * 0.001 AS hnsw, 8 * n / 100.0 * 0.0005 AS ivf, 8 * n / 100.0 * 0.0002 AS ivf_pq, n * 0.002 AS brute FROM n) SELECT c_nationkey, round(hnsw, 6) AS hnsw, round(ivf, 6) AS ivf, round(ivf_pq, 6) AS ivf_pq, round(brute, 6) AS brute, CASE least(hnsw, ivf, ivf_pq, brute) WHEN hnsw THEN 'hnsw' WHEN ivf_pq THEN 'ivf_pq' WHEN ivf THEN 'ivf' ELSE 'brute' END AS best FROM c")
def cost_estimate(spark, sf_dir):
    """Cost of each index kind by collection size."""
    n = table(spark, sf_dir, "customer", "c_nationkey").groupBy("c_nationkey").agg((F.count(F.lit(1)) * 1000).alias("n"))
    cost = {"hnsw": 64 * F.log("n") * 0.001, "ivf_pq": 8 * F.col("n") / 100.0 * 0.0002, "ivf": 8 * F.col("n") / 100.0 * 0.0005, "brute": F.col("n") * 0.002}
    best, least = F.lit("brute"), F.least(*cost.values())
    for name in ("ivf", "ivf_pq", "hnsw"):
        best = F.when(cost[name] == least, name).otherwise(best)
    return n.select("c_nationkey", *[F.round(c, 6).alias(k) for k, c in cost.items()], best.alias("best"))


@REG.query("WITH b AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), t AS (SELECT *, CASE WHEN n * 256 <= 20000 THEN 0 WHEN n * 64 <= 20000 THEN 1 WHEN n * 16 <= 20000 THEN 2 ELSE 3 END AS budget, c_nationkey / 25.0 AS free FROM b) SELECT c_nationkey, ['fp32', 'int8', 'pq', 'binary'][1 + greatest(budget, CASE WHEN free < 0.07 THEN 3 WHEN free < 0.15 THEN 2 WHEN free < 0.30 THEN 1 ELSE 0 END)] AS precision FROM t")
def quantization_policy(spark, sf_dir):
    """The best precision that fits the budget, lowered under memory pressure."""
    n = table(spark, sf_dir, "customer", "c_nationkey").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    budget = F.when(F.col("n") * 256 <= 20000, 0).when(F.col("n") * 64 <= 20000, 1).when(F.col("n") * 16 <= 20000, 2).otherwise(3)
    free = F.col("c_nationkey") / 25.0
    pressure = F.when(free < 0.07, 3).when(free < 0.15, 2).when(free < 0.30, 1).otherwise(0)
    return n.select("c_nationkey", F.get(F.array(*map(F.lit, ("fp32", "int8", "pq", "binary"))), F.greatest(budget, pressure)).alias("precision"))


@REG.query("SELECT c_custkey, '[REDACTED]' AS c_name, c_mktsegment FROM customer WHERE c_acctbal < 0")
def audit_redaction(spark, sf_dir):
    """An audit extract in which sensitive fields are masked."""
    secret = {"c_name"}
    rows = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment", "c_acctbal").filter("c_acctbal < 0")
    return rows.select(*[F.lit("[REDACTED]").alias(c) if c in secret else F.col(c) for c in ("c_custkey", "c_name", "c_mktsegment")])


@REG.query("SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-21' GROUP BY event_type")
def audit_query(spark, sf_dir):
    """Counts by action from one day to the end of another."""
    return events(spark, sf_dir, "event_type", "ts").filter((F.col("ts") >= datetime.datetime(2024, 1, 10)) & (F.col("ts") < datetime.datetime(2024, 1, 21))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@REG.query("SELECT count(*) AS total, count(*) FILTER (ts >= TIMESTAMP '2024-01-25') AS last_7_days, count(*) FILTER (ts >= TIMESTAMP '2024-01-02') AS last_30_days, count(DISTINCT user_id) AS users FROM events")
def memory_stats(spark, sf_dir):
    since = lambda *d: F.count_if(F.col("ts") >= datetime.datetime(*d))
    return events(spark, sf_dir, "ts", "user_id").agg(F.count(F.lit(1)).alias("total"), since(2024, 1, 25).alias("last_7_days"), since(2024, 1, 2).alias("last_30_days"), F.countDistinct("user_id").alias("users"))


@REG.query("SELECT event_type, round(coalesce(count(*) FILTER (value > 50) / nullif(count(value), 0), 0), 4) AS hit_ratio FROM events GROUP BY event_type")
def cache_hit_ratio(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.round(F.coalesce(F.try_divide(F.count_if(F.col("value") > 50), F.count("value")), F.lit(0.0)), 4).alias("hit_ratio"))


@REG.query("SELECT source, count(*) AS chunks, min(doc_id) AS first_doc, max(n_chars) AS longest FROM documents GROUP BY source")
def document_list(spark, sf_dir):
    return table(spark, sf_dir, "documents", "source", "doc_id", "n_chars").groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.min("doc_id").alias("first_doc"), F.max("n_chars").alias("longest"))


# Logs and replicas

LOG = "CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END"


@REG.query(f"WITH l AS (SELECT user_id, value, {LOG} AS op, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, op, value FROM l WHERE n = 1 AND op <> 'DELETE'")
def wal_replay_state(spark, sf_dir):
    log = events(spark, sf_dir).withColumn("op", F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE"))
    return tables.replay(log, "user_id", ["ts", "event_id"], "op").select("user_id", "op", "value")


@REG.query("WITH a AS (SELECT user_id, max(ts) AS at FROM events WHERE event_type <> 'error' GROUP BY 1), r AS (SELECT user_id, max(ts) AS at FROM events WHERE event_type = 'error' GROUP BY 1) SELECT a.user_id FROM a LEFT JOIN r USING (user_id) WHERE r.at IS NULL OR a.at > r.at")
def lww_merge(spark, sf_dir):
    """A last-writer-wins set: visible where the last add is later than the last remove. One aggregation."""
    removed = F.col("event_type") == "error"
    u = events(spark, sf_dir, "user_id", "ts", "event_type").groupBy("user_id").agg(F.max(F.when(~removed, F.col("ts"))).alias("a"), F.max(F.when(removed, F.col("ts"))).alias("r"))
    return u.filter("a is not null and (r is null or a > r)").select("user_id")


@REG.query("SELECT event_type, sum(m)::BIGINT AS total FROM (SELECT event_type, user_id, max(event_id) AS m FROM events GROUP BY ALL) GROUP BY event_type")
def gcounter_merge(spark, sf_dir):
    """Grow-only counters: the largest count of each node, summed."""
    return events(spark, sf_dir, "event_type", "user_id", "event_id").groupBy("event_type", "user_id").agg(F.max("event_id").alias("m")).groupBy("event_type").agg(F.sum("m").alias("total"))


# Feedback

@REG.query("SELECT event_id, round(CASE event_type WHEN 'click' THEN 1.0 WHEN 'error' THEN 0.0 ELSE least(1.0, greatest(0.0, ln(abs(value) + 1) / ln(61.0))) END, 6) AS relevance FROM events WHERE value IS NOT NULL")
def rlhf_relevance(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "skip").otherwise(F.col("event_type"))
    return events(spark, sf_dir).filter("value is not null").select("event_id", F.round(retrieval.relevance(kind, F.abs("value") * 1000), 6).alias("relevance"))


@REG.query("SELECT a.user_id, a.event_id AS better, b.event_id AS worse FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'view' AND a.value > b.value")
def preference_pairs(spark, sf_dir):
    """Within a user, purchases above views of lower value: an equi-join with an inequality."""
    e = events(spark, sf_dir, "user_id", "event_id", "event_type", "value")
    a = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("better"), F.col("value").alias("v"))
    b = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("worse"), F.col("value").alias("w"))
    return a.join(b, "user_id").filter("v > w").select("user_id", "better", "worse")


@REG.query("SELECT conv_id, string_agg('[Source: ' || role || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn, role) AS context FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL GROUP BY conv_id")
def rag_context(spark, sf_dir):
    """The turns of each conversation as one context, in order."""
    c = table(spark, sf_dir, "conversations").filter("text is not null and role is not null")
    rows = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: F.concat(F.lit("[Source: "), x["role"], F.lit("]\n"), x["text"])), "\n\n---\n\n").alias("context"))


@REG.query("SELECT role, count(*) AS total, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY role")
def memory_listing(spark, sf_dir):
    return table(spark, sf_dir, "conversations", "role", "conv_id").groupBy("role").agg(F.count(F.lit(1)).alias("total"), F.countDistinct("conv_id").alias("conversations"))


@REG.query("SELECT user_id, sum(CASE WHEN event_type IN ('signup', 'purchase') THEN 1 ELSE 0 END)::BIGINT AS changes FROM events GROUP BY user_id HAVING changes >= 3")
def reindex_trigger(spark, sf_dir):
    """Collections whose accumulated changes reach the threshold."""
    return events(spark, sf_dir, "user_id", "event_type").groupBy("user_id").agg(F.count_if(F.col("event_type").isin("signup", "purchase")).alias("changes")).filter("changes >= 3")
