"""Registered queries on vectors: distances, searches, quantisation, graphs, metrics. The query vector of a single search is that of vec_id 0."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecloom.functions import vectors as V
from vecloom.operators import graph, knn, retrieval, series
from vecloom.registry import Registry
from vecloom.sources import tables
from vecloom.sources.tables import table

REG = Registry()
K = 10
COS = "round(1 - list_cosine_similarity(v.embedding::DOUBLE[], q.q::DOUBLE[]), 6)"
L2 = "round(list_distance(v.embedding::DOUBLE[], q.q::DOUBLE[]), 6)"
DOT = "round(-list_inner_product(v.embedding::DOUBLE[], q.q::DOUBLE[]), 6)"
Q = "q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
#: Searches of many queries take every vector whose id is divisible by 20.
ALL = "nn AS (SELECT a.vec_id AS query_id, b.vec_id, round(1 - list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]), 9) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM nn QUALIFY rank <= 10)"


SET = ALL.replace("a.vec_id <> b.vec_id)", "a.vec_id <> b.vec_id AND a.vec_id % 20 = 0)")
SET_L2 = SET.replace("round(1 - list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]), 9)", "round(list_distance(b.embedding::DOUBLE[], a.embedding::DOUBLE[]), 9)")
BEST = "SELECT query_id, vec_id, rank, round(distance, 6) AS distance FROM best"


def embeddings(spark, sf_dir, *columns):
    return table(spark, sf_dir, "embeddings", *(columns or ("vec_id", "embedding", "label")))


def query0(spark, sf_dir):
    return knn.query_vector(embeddings(spark, sf_dir), 0)


def rounded(df, *columns):
    return df.select("rank", "vec_id", *columns, F.round("distance", 6).alias("distance"))


def _distance(name: str, metric: str, sql: str):
    def run(spark, sf_dir):
        return knn.with_query(embeddings(spark, sf_dir), query0(spark, sf_dir)).select("vec_id", F.round(V.distance(F.col("embedding"), F.col("q"), metric), 6).alias("distance"))

    run.__name__ = name
    REG.query(f"WITH {Q} SELECT vec_id, {sql} AS distance FROM embeddings v, q")(run)


def _search(name: str, metric: str, sql: str):
    def run(spark, sf_dir):
        return rounded(knn.exact(embeddings(spark, sf_dir), query0(spark, sf_dir), K, metric), "label")

    run.__name__ = name
    REG.query(f"WITH {Q}, d AS (SELECT vec_id, label, {sql.replace(', 6)', ', 12)')} AS distance FROM embeddings v, q ORDER BY distance, vec_id LIMIT {K}) SELECT row_number() OVER (ORDER BY distance, vec_id) AS rank, vec_id, label, round(distance, 6) AS distance FROM d")(run)


for _name, _metric, _sql in (("cosine", "cosine", COS), ("euclidean", "euclidean", L2), ("dot", "dot", DOT)):
    _distance(f"dist_{_name}", _metric, _sql)
for _name, _metric, _sql in (("cosine", "cosine", COS), ("l2", "euclidean", L2), ("dot", "dot", DOT)):
    _search(f"knn_exact_{_name}", _metric, _sql)


@REG.query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS norm_before, round(1.0::DOUBLE, 6) AS norm_after FROM embeddings")
def l2_normalize_norms(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return e.select("vec_id", F.round(V.dot(F.col("embedding"), F.col("embedding")), 6).alias("norm_before"), F.round(V.norm(V.normalized(F.col("embedding"))), 6).alias("norm_after"))


@REG.query(f"WITH {Q}, d AS (SELECT vec_id, label, {COS} AS distance FROM embeddings v, q WHERE label IN (1, 3, 5) AND vec_id <> 0 ORDER BY distance, vec_id LIMIT {K}) SELECT row_number() OVER (ORDER BY distance, vec_id) AS rank, vec_id, label, distance FROM d")
def knn_filtered(spark, sf_dir):
    """The predicate goes first, so the answer is full."""
    return rounded(knn.exact(embeddings(spark, sf_dir), query0(spark, sf_dir), K, where=F.col("label").isin(1, 3, 5) & (F.col("vec_id") != 0)), "label")


@REG.query(f"WITH {Q}, d AS (SELECT vec_id, label, {COS} AS distance FROM embeddings v, q ORDER BY distance, vec_id LIMIT {K}) SELECT vec_id, label, distance FROM d WHERE label % 2 = (SELECT label % 2 FROM embeddings WHERE vec_id = 0)")
def knn_postfilter(spark, sf_dir):
    """The predicate (labels as even or odd as the query's, which is among its own neighbours) is applied to the top k, which may leave fewer."""
    e = embeddings(spark, sf_dir)
    own = e.filter("vec_id = 0").select((F.col("label") % 2).alias("parity"))
    near = knn.exact(e, query0(spark, sf_dir), K).crossJoin(F.broadcast(own)).filter(F.col("label") % 2 == F.col("parity"))
    return near.select("vec_id", "label", F.round("distance", 6).alias("distance"))


def found(df):
    return df.select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"))


@REG.query(f"WITH {SET} {BEST}")
def knn_batch(spark, sf_dir):
    e = embeddings(spark, sf_dir, "vec_id", "embedding")
    return found(knn.batch(knn.query_set(e), e, K))


@REG.query(f"WITH {SET.replace('1 - list_cosine_similarity', '1 - list_inner_product')} {BEST}")
def knn_batch_unit(spark, sf_dir):
    """Vectors at unit length need no norms."""
    e = embeddings(spark, sf_dir, "vec_id", "embedding")
    return found(knn.batch(knn.query_set(e), e, K, "dot").withColumn("distance", 1 + F.col("distance")))


@REG.query(f"WITH {SET_L2} {BEST}")
def knn_batch_l2(spark, sf_dir):
    e = embeddings(spark, sf_dir, "vec_id", "embedding")
    return found(knn.batch(knn.query_set(e), e, K, "euclidean"))


@REG.query(f"WITH {Q}, d AS (SELECT vec_id, label, {COS} AS distance FROM embeddings v, q) SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rank, distance FROM d QUALIFY rank <= 3")
def knn_per_label(spark, sf_dir):
    near = knn.with_query(embeddings(spark, sf_dir), query0(spark, sf_dir)).withColumn("distance", F.round(V.distance(F.col("embedding"), F.col("q")), 6))
    return knn.ranked(near, ["distance", "vec_id"], within=["label"]).filter("rank <= 3").select("label", "vec_id", "rank", "distance")


@REG.query(f"WITH {Q} SELECT vec_id, {COS} AS distance FROM embeddings v, q WHERE list_cosine_similarity(v.embedding::DOUBLE[], q.q::DOUBLE[]) >= 0.1")
def range_search_threshold(spark, sf_dir):
    return knn.within(embeddings(spark, sf_dir), query0(spark, sf_dir), 0.9).select("vec_id", F.round("distance", 6).alias("distance"))


INT8 = "x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), r AS (SELECT d, min(x) AS lo, CASE WHEN max(x) - min(x) < 1e-12 THEN 1.0::DOUBLE ELSE max(x) - min(x) END AS span FROM x GROUP BY d), c AS (SELECT vec_id, x.d, floor((x - lo) / span * 255 + 0.5) - 128 AS code, lo, span FROM x JOIN r USING (d))"


@REG.query(f"WITH {INT8} SELECT vec_id, d::BIGINT - 1 AS d, code::BIGINT AS code FROM c")
def int8_codes(spark, sf_dir):
    e = embeddings(spark, sf_dir, "vec_id", "embedding")
    return knn.int8_codes(e, knn.int8_ranges(e)).select("vec_id", F.posexplode("codes").alias("d", "code")).select("vec_id", F.col("d").cast("long").alias("d"), F.col("code").cast("long").alias("code"))


@REG.query(f"WITH {INT8}, w AS (SELECT vec_id, list((code + 128) / 255 * span + lo ORDER BY d) AS embedding FROM c GROUP BY vec_id), {SET.replace('FROM embeddings a JOIN embeddings b', 'FROM embeddings a JOIN w b')} {BEST}")
def knn_int8(spark, sf_dir):
    """Search on dequantised 8-bit codes."""
    e = embeddings(spark, sf_dir, "vec_id", "embedding")
    coded = knn.int8_codes(e, knn.int8_ranges(e)).select("vec_id", knn.dequantized(F.col("codes"), F.col("lo"), F.col("span")).alias("embedding"))
    return found(knn.batch(knn.query_set(e), coded, K))


#: Share of the dimensions in which a neighbour's signs may differ: 30 of 64.
SIGNS = 0.47
DIFFER = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END))"
BINARY = SET.replace("AND a.vec_id % 20 = 0)", f"AND a.vec_id % 20 = 0 AND {DIFFER} <= floor({SIGNS} * len(a.embedding)))")


@REG.query("SELECT vec_id, list_sum(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END))::BIGINT AS positive, list_sum(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN i ELSE 0 END))::BIGINT AS places FROM embeddings")
def sign_codes(spark, sf_dir):
    """How many bits each vector's code has set, and the sum of their places, counted from 1."""
    code = embeddings(spark, sf_dir, "vec_id", V.sign_code(F.col("embedding")).alias("code"))
    place = lambda w, i: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(F.call_function("shiftright", w, b).bitwiseAND(F.lit(1).cast("long")) == 1, i * 64 + b + 1).otherwise(0)), F.lit(0).cast("long"), lambda s, x: s + x)
    sums = F.aggregate(F.transform("code", place), F.lit(0).cast("long"), lambda s, x: s + x)
    return code.select("vec_id", F.aggregate("code", F.lit(0).cast("long"), lambda s, w: s + F.bit_count(w)).alias("positive"), sums.alias("places"))


@REG.query(f"WITH {BINARY} {BEST}")
def knn_binary_hamming(spark, sf_dir):
    """Sign codes of all dimensions as a filter, exact distances within their radius."""
    e = embeddings(spark, sf_dir, "vec_id", "embedding")
    return found(knn.binary_search(knn.query_set(e), e, K, SIGNS))


@REG.query(f"WITH {BINARY.replace('nn AS', 'bn AS').replace('FROM nn', 'FROM bn').replace('best AS', 'h AS')}, {SET} SELECT best.query_id, round(count(h.vec_id) / {K}.0, 6) AS recall FROM best LEFT JOIN h ON h.query_id = best.query_id AND h.vec_id = best.vec_id GROUP BY best.query_id")
def recall_binary_vs_exact(spark, sf_dir):
    """How many of the exact neighbours the search by sign codes finds."""
    e = embeddings(spark, sf_dir, "vec_id", "embedding")
    hits = knn.binary_search(knn.query_set(e), e, K, SIGNS).select("query_id", "vec_id", F.lit(1).alias("hit"))
    return knn.batch(knn.query_set(e), e, K).join(hits, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.round(F.count("hit") / K, 6).alias("recall"))


TABLES, BITS = 20, 4
PLANES = f"pl AS (SELECT t, b, list(('0x' || substr(md5(t::VARCHAR || ':' || b::VARCHAR || ':' || d::VARCHAR), 1, 8))::BIGINT / 2147483648.0::DOUBLE - 1 ORDER BY d) AS p FROM (SELECT unnest(range({TABLES})) AS t), (SELECT unnest(range({BITS})) AS b), (SELECT unnest(range(64)) AS d) GROUP BY t, b), bk AS (SELECT vec_id, t, sum(CASE WHEN list_inner_product(embedding::DOUBLE[], p) > 0 THEN 1 << b ELSE 0 END) AS bucket FROM embeddings, pl GROUP BY vec_id, t), ca AS (SELECT DISTINCT x.vec_id AS query_id, y.vec_id FROM bk x JOIN bk y ON x.t = y.t AND x.bucket = y.bucket AND x.vec_id <> y.vec_id WHERE x.vec_id % 20 = 0)"


@REG.query(f"WITH {PLANES}, {SET.replace('ON a.vec_id <> b.vec_id', 'ON a.vec_id <> b.vec_id AND (a.vec_id, b.vec_id) IN (SELECT query_id, vec_id FROM ca)')} {BEST}")
def knn_lsh_fixed_planes(spark, sf_dir):
    """Random hyperplanes, 20 tables of 4 bits."""
    e = embeddings(spark, sf_dir, "vec_id", "embedding")
    return found(knn.lsh_search(knn.query_set(e), e, K, TABLES, BITS, 64))


CENTROID = "x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), m AS (SELECT label, d, avg(x) AS m FROM x GROUP BY ALL), c AS (SELECT label::BIGINT AS cell, list(m ORDER BY d) AS centroid FROM m GROUP BY label), a AS (SELECT vec_id, embedding, cell, round(list_distance(embedding::DOUBLE[], centroid) ** 2, 9) AS d2 FROM embeddings, c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, cell) = 1)"


PROBES = 9
PROBED = f"pr AS (SELECT vec_id AS query_id, cell FROM embeddings, c WHERE vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_distance(embedding::DOUBLE[], centroid), 9), cell) <= {PROBES})"


def label_index(spark, sf_dir):
    """An index on disk with a cell around the mean of each label."""
    e, path = embeddings(spark, sf_dir), tables.shared_path(spark, "ivf-labels")
    knn.write_index(e.select("vec_id", "embedding"), knn.centroids(e, "label"), path)
    return knn.read_index(spark, path)


@REG.query(f"WITH {CENTROID}, {PROBED}, {SET_L2.replace('FROM embeddings a JOIN embeddings b ON', 'FROM embeddings a JOIN pr ON pr.query_id = a.vec_id JOIN a b ON b.cell = pr.cell AND')} {BEST}")
def knn_ivf_label_centroids(spark, sf_dir):
    """Inverted cells around the labels' means, 9 of 10 probed: these vectors lie so evenly that fewer cells hold less than 0.9 of the neighbours."""
    return found(knn.ivf(knn.query_set(embeddings(spark, sf_dir)), label_index(spark, sf_dir), PROBES, K))


@REG.query(f"WITH {CENTROID}, {Q}, p AS (SELECT cell FROM c, q ORDER BY round(list_distance(centroid, q.q::DOUBLE[]), 9), cell LIMIT 2), d AS (SELECT vec_id, {L2} AS distance FROM a v JOIN p USING (cell), q ORDER BY distance, vec_id LIMIT {K}) SELECT row_number() OVER (ORDER BY distance, vec_id) AS rank, vec_id, distance FROM d")
def ivf_probe_of_index(spark, sf_dir):
    """One vector against an index on disk: two of ten cells are read."""
    q = embeddings(spark, sf_dir).filter("vec_id = 0").first()["embedding"]
    return knn.ivf_one(q, label_index(spark, sf_dir), 2, K).select("rank", "vec_id", F.round("distance", 6).alias("distance"))


@REG.query(f"WITH {CENTROID} SELECT cell, count(*) AS vectors, round(sum(d2), 4) AS wcss FROM a GROUP BY cell")
def cell_wcss(spark, sf_dir):
    """Within-cell sums of squares."""
    e = embeddings(spark, sf_dir)
    return knn.assigned(e, knn.centroids(e, "label")).groupBy("cell").agg(F.count(F.lit(1)).alias("vectors"), F.round(F.sum("d2"), 4).alias("wcss"))


@REG.query()
def kmeans_ivf(spark, sf_dir):
    """Inverted cells from k-means on disk, 14 of 16 probed."""
    e, path = embeddings(spark, sf_dir, "vec_id", "embedding"), tables.shared_path(spark, "ivf-kmeans")
    knn.write_index(e, knn.kmeans(e, 16), path)
    return found(knn.ivf(knn.query_set(e), knn.read_index(spark, path), 14, K))


@REG.query(f"WITH {SET_L2} {BEST}")
def knn_pq(spark, sf_dir):
    """Product quantisation with 16 subspaces of 64 codewords; every row that the codes don't rule out is ranked again, so the result is exact."""
    e = embeddings(spark, sf_dir, "vec_id", "embedding")
    books = knn.pq_train(e, 16, 64)
    return found(knn.pq_search(knn.query_set(e), e, knn.pq_codes(e, books), books, K))


@REG.query()
def knn_ivf_pq(spark, sf_dir):
    """Inverted cells with product codes of the residuals, on disk; rows whose estimate is within a fifth of the k-th are ranked again."""
    e, path = embeddings(spark, sf_dir, "vec_id", "embedding"), tables.shared_path(spark, "ivf-pq")
    books = knn.ivf_pq_write(e, knn.kmeans(e, 8), 16, 64, path)
    queries = knn.query_set(e)
    return found(knn.reranked(knn.ivf_pq_candidates(queries, path, books, 7, K, 0.2), queries, e, K))


@REG.query()
def compare_methods(spark, sf_dir):
    """(method, queries, recall) of each approximate search against the exact one of its metric, over the query set.

    An exact search is made once for its metric, and one method runs after the other: of each a row is written.
    """
    best = {name: tables.cut(REG.queries[name](spark, sf_dir).select("query_id", "vec_id"), name) for name in ("knn_batch", "knn_batch_l2")}
    out = None
    for name, exact in (("knn_int8", "knn_batch"), ("knn_binary_hamming", "knn_batch"), ("knn_lsh_fixed_planes", "knn_batch"), ("knn_ivf_label_centroids", "knn_batch_l2"), ("kmeans_ivf", "knn_batch_l2"), ("knn_pq", "knn_batch_l2"), ("knn_ivf_pq", "knn_batch_l2")):
        hits = REG.queries[name](spark, sf_dir).select("query_id", "vec_id", F.lit(1).alias("hit"))
        each = best[exact].join(hits, ["query_id", "vec_id"], "left")
        row = tables.cut(each.agg(F.countDistinct("query_id").alias("queries"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall")).select(F.lit(name).alias("method"), "queries", "recall"), "recall")
        out = row if out is None else out.unionByName(row)
    return out


PART = "('0x' || right(md5(vec_id::VARCHAR), 8))::BIGINT % 4"


@REG.query(f"WITH {Q}, d AS (SELECT vec_id, {COS} AS distance, {PART} AS p FROM embeddings v, q), t AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY p ORDER BY distance, vec_id) <= 20), b AS (SELECT * FROM t ORDER BY distance, vec_id LIMIT {K}) SELECT row_number() OVER (ORDER BY distance, vec_id) AS rank, vec_id, p AS partition, distance FROM b")
def knn_hash_partitioned(spark, sf_dir):
    return rounded(knn.partitioned(embeddings(spark, sf_dir), query0(spark, sf_dir), knn.hash_partition(F.col("vec_id"), 4), K), "partition")


@REG.query(f"WITH {Q}, d AS (SELECT v.vec_id, {COS} AS distance, strftime(e.ts, '%Y-%m-%d') AS p FROM embeddings v JOIN events e ON e.event_id = v.vec_id, q), t AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY p ORDER BY distance, vec_id) <= 20), b AS (SELECT * FROM t ORDER BY distance, vec_id LIMIT {K}) SELECT row_number() OVER (ORDER BY distance, vec_id) AS rank, vec_id, p AS partition, distance FROM b")
def knn_range_partitioned(spark, sf_dir):
    """Partitions by day; a vector has the time of the event with its id."""
    ts = table(spark, sf_dir, "events", F.col("event_id").alias("vec_id"), "ts")
    return rounded(knn.partitioned(embeddings(spark, sf_dir).join(ts, "vec_id"), query0(spark, sf_dir), F.date_format("ts", "yyyy-MM-dd"), K), "partition")


@REG.query(f"WITH {Q}, d AS (SELECT vec_id, {COS} AS distance, {PART} AS p FROM embeddings v, q), t AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY distance, vec_id) AS r FROM d QUALIFY r <= {2 * K}), b AS (SELECT vec_id, sum(1.0::DOUBLE / (60 + r)) AS score, min(distance) AS distance FROM t GROUP BY vec_id) SELECT row_number() OVER (ORDER BY score DESC, distance, vec_id) AS rank, vec_id, round(score, 6) AS score, distance FROM b ORDER BY b.score DESC, b.distance, vec_id LIMIT {K}")
def scatter_gather_rrf(spark, sf_dir):
    """Four shards answer with their best 2 k, fused by reciprocal rank."""
    return rounded(knn.scatter_gather_rrf(embeddings(spark, sf_dir), query0(spark, sf_dir), knn.hash_partition(F.col("vec_id"), 4), K), F.round("score", 6).alias("score"))


@REG.query("WITH p AS (SELECT a.label AS query_label, a.vec_id, b.label, max(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS m FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 GROUP BY ALL) SELECT query_label, label, round(sum(m), 6) AS score FROM p GROUP BY ALL")
def maxsim_label_groups(spark, sf_dir):
    """Late interaction: the queries of each label, as a multi-vector, against the vectors of each label."""
    e = embeddings(spark, sf_dir)
    queries = knn.query_set(e)
    best = knn.maxsim(queries, e, "label").join(queries.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), "query_id")
    return best.groupBy("query_label", F.col("label").cast("int").alias("label")).agg(F.round(F.sum("m"), 6).alias("score"))


@REG.query("SELECT count(*) AS vectors, avg(len(embedding))::DOUBLE AS avg_dimension FROM embeddings")
def collection_statistics(spark, sf_dir):
    return tables.statistics(embeddings(spark, sf_dir))


@REG.query("SELECT vec_id, CASE WHEN vec_id % 7 = 3 THEN 60 ELSE len(embedding) END::BIGINT AS dimension FROM embeddings WHERE CASE WHEN vec_id % 7 = 3 THEN 60 ELSE len(embedding) END <> 64")
def dimension_validation(spark, sf_dir):
    """Rows whose length isn't the collection's. Every vector here has it, so those with an id of 3 modulo 7 are cut to 60 dimensions first."""
    cut = F.when(F.col("vec_id") % 7 == 3, F.slice("embedding", 1, 60)).otherwise(F.col("embedding"))
    return tables.wrong_dimension(embeddings(spark, sf_dir).withColumn("embedding", cut), 64)


@REG.query("SELECT label, d::BIGINT - 1 AS d, round(avg(x), 6) AS mean, CASE WHEN count(*) > 1 THEN round(stddev_pop(x), 6) END AS std, count(*) AS n FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY label, d")
def vector_window_stats(spark, sf_dir):
    return series.vector_statistics(embeddings(spark, sf_dir), ["label"])


@REG.query("WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), m AS (SELECT a.d AS i, b.d AS j, covar_pop(a.x, b.x) AS c FROM x a JOIN x b USING (vec_id) GROUP BY ALL) SELECT round(sum(CASE WHEN i = j THEN c END) ** 2 / sum(c * c), 4) AS dimension FROM m")
def intrinsic_dimension(spark, sf_dir):
    """Participation ratio of the covariance's eigenvalues from its trace and Frobenius norm."""
    n, total, square = knn.moments(embeddings(spark, sf_dir), 64)
    c = square / n - (total / n)[:, None] * (total / n)
    return spark.createDataFrame([(round(float(c.trace() ** 2 / (c * c).sum()), 4),)], "dimension double")


@REG.query(f"WITH {ALL}, r AS (SELECT query_id, max(CASE WHEN rank = 1 THEN distance END) AS r1, max(CASE WHEN rank = 2 THEN distance END) AS r2 FROM best GROUP BY 1) SELECT round(1 / avg(ln(r2 / r1)), 4) AS dimension FROM r WHERE r1 > 0")
def two_nn_dimension(spark, sf_dir):
    """Two-nearest-neighbour estimate of the intrinsic dimension, with a positive sign."""
    e = embeddings(spark, sf_dir, "vec_id", "embedding")
    r = knn.batch(e, e, K).groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("distance"))).alias("r1"), F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("r2"))
    return r.filter("r1 > 0").agg(F.round(1 / F.avg(F.log(F.col("r2") / F.col("r1"))), 4).alias("dimension"))


@REG.query(f"WITH {Q}, x AS (SELECT vec_id, unnest(embedding)::DOUBLE * unnest(q.q)::DOUBLE AS part, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings v, q) SELECT vec_id, d::BIGINT AS d, round(part, 6) AS part, row_number() OVER (PARTITION BY vec_id ORDER BY abs(round(part, 6)) DESC, d) AS rank FROM x QUALIFY rank <= 10")
def explain_dimensions(spark, sf_dir):
    """The ten dimensions that add most to each product with the query."""
    x = knn.with_query(embeddings(spark, sf_dir), query0(spark, sf_dir)).select("vec_id", F.posexplode(F.zip_with("embedding", "q", lambda a, b: a.cast("double") * b.cast("double"))).alias("d", "part"))
    x = x.select("vec_id", F.col("d").cast("long").alias("d"), F.round("part", 6).alias("part"))
    return knn.ranked(x, [F.desc(F.abs("part")), "d"], within=["vec_id"]).filter("rank <= 10")


# Graphs

EDGES = f"{ALL}, edges AS (SELECT least(query_id, vec_id) AS a, greatest(query_id, vec_id) AS b, round(1 / (1 + min(distance)), 6) AS weight FROM best GROUP BY ALL), links AS (SELECT a AS src, b AS dst, weight FROM edges UNION ALL SELECT b, a, weight FROM edges)"
KNOWN = "known AS (SELECT vec_id AS node, label FROM embeddings WHERE label % 2 = 0)"


def edges(spark, sf_dir):
    """Written once, as the queries read them in both directions and several times."""
    return tables.cut(graph.knn_edges(embeddings(spark, sf_dir, "vec_id", "embedding")), "edges")


def known(spark, sf_dir):
    """Half of the labels are taken as given, so that the others can be predicted."""
    return embeddings(spark, sf_dir).filter("label % 2 = 0").select(F.col("vec_id").alias("node"), "label")


@REG.query(f"WITH {EDGES} SELECT a, b, weight FROM edges")
def knn_graph_edges(spark, sf_dir):
    return graph.knn_edges(embeddings(spark, sf_dir, "vec_id", "embedding"))


@REG.query(f"WITH {EDGES} SELECT src AS node, count(*) AS degree, round(sum(weight), 6) AS strength FROM links GROUP BY src")
def graph_degree_stats(spark, sf_dir):
    return graph.degrees(edges(spark, sf_dir))


_ROUND = "{1} AS (SELECT node, label FROM {0} UNION ALL SELECT src, label FROM (SELECT l.src, k.label, count(*) AS n FROM links l JOIN {0} k ON k.node = l.dst WHERE l.src NOT IN (SELECT node FROM {0}) GROUP BY l.src, k.label QUALIFY row_number() OVER (PARTITION BY l.src ORDER BY n DESC, k.label) = 1))"


@REG.query(f"WITH {EDGES}, {KNOWN}, {_ROUND.format('known', 'k1')}, {_ROUND.format('k1', 'k2')} SELECT n.node, k2.label FROM (SELECT DISTINCT src AS node FROM links) n LEFT JOIN k2 ON k2.node = n.node")
def label_propagation(spark, sf_dir):
    return graph.label_propagation(edges(spark, sf_dir), known(spark, sf_dir), 2)


@REG.query(f"WITH {EDGES}, {KNOWN}, o AS (SELECT DISTINCT src FROM links WHERE src NOT IN (SELECT node FROM known)), v AS (SELECT l.src, k.label, 1.0::DOUBLE AS vote FROM links l JOIN o ON o.src = l.src JOIN known k ON k.node = l.dst UNION ALL SELECT l.src, k.label, 0.5 FROM links l JOIN o ON o.src = l.src JOIN links m ON m.src = l.dst JOIN known k ON k.node = m.dst WHERE m.dst <> l.src AND NOT EXISTS (SELECT 1 FROM links x WHERE x.src = l.src AND x.dst = m.dst)), s AS (SELECT src, label, sum(vote) AS votes FROM v GROUP BY ALL), t AS (SELECT *, votes / sum(votes) OVER (PARTITION BY src) AS share FROM s) SELECT src AS node, label, round(share, 3) AS confidence, floor(votes)::BIGINT AS votes FROM t WHERE share >= 0.25")
def link_prediction(spark, sf_dir):
    """Five labels are known, so a share of 0.25 is asked of the winner."""
    return graph.link_prediction(edges(spark, sf_dir), known(spark, sf_dir), 0.25)


_STEP = "{1} AS (SELECT p.node, 0.15 * p.p + 0.85 * coalesce(f.flow, 0) AS rank FROM p LEFT JOIN (SELECT m.dst, sum(m.move * r.rank) AS flow FROM moves m JOIN {0} r ON r.node = m.src GROUP BY m.dst) f ON f.dst = p.node)"


@REG.query(f"WITH {EDGES}, {Q}, top AS (SELECT v.vec_id, list_cosine_similarity(v.embedding::DOUBLE[], q.q::DOUBLE[]) AS score FROM embeddings v, q ORDER BY round(1 - score, 12), vec_id LIMIT {K}), moves AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS move FROM links), w AS (SELECT DISTINCT src AS node, coalesce(t.score, 0.01) AS w FROM links LEFT JOIN top t ON t.vec_id = src), p AS (SELECT node, w / sum(w) OVER () AS p FROM w), r0 AS (SELECT node, p AS rank FROM p), {_STEP.format('r0', 'r1')}, {_STEP.format('r1', 'r2')}, {_STEP.format('r2', 'r3')} SELECT t.vec_id, round(0.7 * t.score + 3 * r3.rank, 6) AS score FROM top t JOIN r3 ON r3.node = t.vec_id")
def pagerank_rerank(spark, sf_dir):
    """Candidates ranked again by personalised PageRank, three rounds."""
    e = embeddings(spark, sf_dir)
    found = tables.cut(knn.exact(e, query0(spark, sf_dir), K).select("vec_id", (1 - F.col("distance")).alias("score")))
    rank = graph.pagerank(edges(spark, sf_dir), found.select(F.col("vec_id").alias("node"), F.col("score").alias("p")))
    return found.join(rank, found["vec_id"] == rank["node"]).select("vec_id", F.round(0.7 * F.col("score") + 3 * F.col("rank"), 6).alias("score"))


@REG.query(f"WITH {EDGES} SELECT older, recent, round(recent / greatest(older, 1) * 100, 6) AS growth_percent FROM (SELECT count(*) FILTER (greatest(x.ts, y.ts) < TIMESTAMP '2024-01-16') AS older, count(*) FILTER (greatest(x.ts, y.ts) >= TIMESTAMP '2024-01-16') AS recent FROM edges JOIN events x ON x.event_id = a JOIN events y ON y.event_id = b)")
def temporal_growth(spark, sf_dir):
    import datetime

    times = table(spark, sf_dir, "events", F.col("event_id").alias("node"), "ts")
    return graph.growth(edges(spark, sf_dir), times, datetime.datetime(2024, 1, 16))


# Metrics: the ranked list of each vector, relevant are the vectors with its label

RUN = f"{SET}, rel AS (SELECT a.vec_id AS query_id, b.vec_id, 1 + (b.vec_id % 3 = 0)::INT AS grade FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), hit AS (SELECT best.query_id, count(*) AS hits, min(rank) AS first, sum(grade / log2(rank + 1)) AS dcg, sum((2.0 ** grade - 1) / log2(rank + 1)) AS dcg2 FROM best JOIN rel USING (query_id, vec_id) GROUP BY 1), ideal AS (SELECT query_id, count(*) AS n, sum(CASE WHEN r <= 10 THEN grade / log2(r + 1) END) AS idcg, sum(CASE WHEN r <= 10 THEN (2.0 ** grade - 1) / log2(r + 1) END) AS idcg2 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, vec_id) AS r FROM rel) GROUP BY 1), m AS (SELECT i.query_id, round(coalesce(hits / n, 0), 6) AS recall, round(coalesce(hits / 10, 0), 6) AS precision, round(coalesce(1.0 / first, 0), 6) AS mrr, round(coalesce(dcg / idcg, 0), 6) AS ndcg, round(coalesce(dcg2 / idcg2, 0), 6) AS ndcg_exp FROM ideal i LEFT JOIN hit h USING (query_id))"


def measured(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    run = knn.batch(knn.query_set(e), e, K).select("query_id", F.col("vec_id").alias("doc_id"), "rank")
    items = e.select(F.col("vec_id").alias("id"), F.col("label").alias("class"), (1 + (F.col("vec_id") % 3 == 0).cast("int")).alias("grade"))
    return retrieval.class_metrics(run, items, knn.query_set(e).select(F.col("vec_id").alias("query_id")), K)


@REG.query(f"WITH {RUN} SELECT * FROM m")
def retrieval_metrics(spark, sf_dir):
    """recall, precision, MRR and NDCG at 10 of every query."""
    return measured(spark, sf_dir)


@REG.query(f"WITH {RUN} SELECT count(*) AS queries, round(avg(recall), 4) AS recall, round(avg(precision), 4) AS precision, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg, round(avg(ndcg_exp), 4) AS ndcg_exp FROM m")
def evaluate_macro(spark, sf_dir):
    return measured(spark, sf_dir).agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), 4).alias(c) for c in ("recall", "precision", "mrr", "ndcg", "ndcg_exp")])


@REG.query()
def view_clusters(spark, sf_dir):
    """Greedy clusters of similar vectors within each label, candidates for materialised views."""
    return series.greedy_clusters(embeddings(spark, sf_dir), "label", 0.3)
