"""Time series: latest rows, anchored windows, ordered folds, token buckets, elementwise statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions import vectors as V
from vecloom.sources.tables import cut


def latest(df: DataFrame, series: str, order: list[Column | str], k: int) -> DataFrame:
    """The last k rows of each series; null series are left out. Spark limits every partition before the shuffle."""
    w = Window.partitionBy(series).orderBy(*order)
    return df.filter(F.col(series).isNotNull()).withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def streamed(rows: DataFrame, key: str, order: list[str], columns: list[str], step, close, schema: str) -> DataFrame:
    """An ordered fold that goes through each key's sorted rows as a stream: ``step(state, row, out)`` returns the next state, ``close(key, state, out)``
    ends a key; both append result rows to ``out``. A key is never held in memory, however many rows it has; Spark's sort spills."""
    names = [key, *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([(n, t) for n, t in zip(fields, types)])
        at, state, out, begun = None, None, [], False
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if not begun or row[0] != at:
                    if begun:
                        close(at, state, out)
                    at, state, begun = row[0], None, True
                state = step(state, row, out)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], schema=kind)
                out = []
        if begun:
            close(at, state, out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], schema=kind)

    known = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    fields, types = zip(*[(f.split()[0], known[f.split()[1]]) for f in schema.split(", ")])
    sorted_ = rows.select(*dict.fromkeys([*names, *order])).repartition(key).sortWithinPartitions(key, *order)
    return sorted_.select(*names).mapInArrow(run, schema)


def anchored_windows(events: DataFrame, series: str, time: str, width_seconds: int) -> DataFrame:
    """(series, window_start, window_end, events): a window begins at an event and holds those up to ``width_seconds`` later.

    The first later event begins the next one and is the end of this one; the last ends at its last
    event. Not a grid, not a session: each series is folded in time order.
    """
    width = width_seconds * 1_000_000

    def step(state, row, out):
        who, t = row
        if state is None:
            return t, t, 1
        start, _, n = state
        if t - start > width:
            out.append((who, start, t, n))
            return t, t, 1
        return start, t, n + 1

    def close(who, state, out):
        out.append((who, *state))

    rows = events.filter(F.col(series).isNotNull() & F.col(time).isNotNull()).select(F.col(series).cast("long").alias(series), F.unix_micros(F.col(time).cast("timestamp")).alias("us"))
    return streamed(rows, series, ["us"], ["us"], step, close, f"{series} long, window_start long, window_end long, events long")


def vector_statistics(df: DataFrame, keys: list[str], column: str = "embedding") -> DataFrame:
    """(keys, d, mean, std, n): elementwise mean and population deviation (null for one row)."""
    dims = df.select(*keys, F.posexplode(column).alias("d", "x")).withColumn("x", F.col("x").cast("double"))
    return dims.groupBy(*keys, F.col("d").cast("long").alias("d")).agg(F.round(F.avg("x"), 6).alias("mean"), F.when(F.count("x") > 1, F.round(F.stddev_pop("x"), 6)).alias("std"), F.count("x").alias("n"))


def scaled_and_clamped(df: DataFrame, key: str, order: list[str], grows: Column, start: float, up: float, down: float, least: float, most: float, out: str) -> DataFrame:
    """(key, out): a value that each row in order multiplies by ``up`` where ``grows`` holds, else by ``down``, kept between ``least`` and ``most``."""

    def step(state, row, _):
        value = start if state is None else state
        return min(most, value * up) if row[1] else max(least, value * down)

    rows = df.filter(F.col(key).isNotNull()).withColumn("__grows", F.coalesce(grows, F.lit(False))).withColumn(key, F.col(key).cast("long"))
    return streamed(rows, key, order, ["__grows"], step, lambda who, state, found: found.append((who, state)), f"{key} long, {out} double")


def running_mean(df: DataFrame, key: str, order: list[str], value: Column, share: float, out: str) -> DataFrame:
    """(key, out): the exponential mean of each key's values in order, from 0. In closed form: the value k rows from the end has the weight share * (1 - share) ** k."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])) - 1
    return df.withColumn("__w", share * F.pow(F.lit(1.0 - share), back)).groupBy(key).agg(F.sum(F.col("__w") * value).alias(out))


def token_bucket(requests: DataFrame, key: str, time: str, cost: str, rate: float, burst: float) -> DataFrame:
    """``allowed`` for each request: the bucket refills with elapsed time up to ``burst``; a request it cannot pay is refused."""

    def step(state, row, out):
        who, event, us, price = row
        level, last = state or (burst, us)
        level = min(burst, level + (us - last) / 1e6 * rate)
        ok = level >= price
        out.append((who, event, ok))
        return (level - price if ok else level), us

    rows = requests.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), "event_id", F.unix_micros(F.col(time).cast("timestamp")).alias("us"), F.col(cost).cast("double").alias("cost"))
    return streamed(rows, key, ["us", "event_id"], ["event_id", "us", "cost"], step, lambda *_: None, f"{key} long, event_id long, allowed boolean")


def nearest_rank(df: DataFrame, value: str, shares: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """Percentiles as the element at index int(n * p) of the ascending values, exact; (keys, shares, n, avg, max).

    Approximate quantiles cut each key's values into a hundred ranges, whose counts tell in which one an element lies; only the values of
    those ranges are counted one by one. So a hot key, or no key at all, is never sorted in one task.
    """
    keys = keys or []
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    whole = rows.groupBy(*keys).agg(F.percentile_approx("__v", [i / 100 for i in range(1, 100)], 1000).alias("__cuts"), F.count(F.lit(1)).alias("n"), F.round(F.avg("__v"), 6).alias("avg"), F.max("__v").alias("max"))
    whole = cut(whole if keys else whole.filter("n > 0"), "quantiles")

    def on(a: DataFrame, b: DataFrame, more: list[str] = []) -> DataFrame:  # noqa: B006
        return a.join(b, [*keys, *more]) if keys or more else a.crossJoin(F.broadcast(b))

    placed = on(rows, whole.select(*keys, "__cuts")).select(*keys, "__v", F.size(F.filter("__cuts", lambda c: c < F.col("__v"))).alias("__range"))
    counts = placed.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__m"))
    upto = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__range")
    places = F.array(*[F.struct(F.lit(name).alias("name"), F.least(F.floor(F.col("n") * p), F.col("n") - 1).alias("at")) for name, p in shares.items()])
    ranges = on(counts.withColumn("__end", F.sum("__m").over(upto)), whole.select(*keys, F.explode(places).alias("p"), F.lit(1).alias("__one"))).filter("p.at < __end and p.at >= __end - __m")
    wanted = ranges.select(*keys, "__range", F.col("p.name").alias("__name"), (F.col("p.at") - F.col("__end") + F.col("__m")).alias("__at"))
    values = on(placed, wanted.select(*keys, "__range").distinct(), ["__range"]).groupBy(*keys, "__range", "__v").agg(F.count(F.lit(1)).alias("__m"))
    values = values.withColumn("__end", F.sum("__m").over(Window.partitionBy(*keys, "__range").orderBy("__v")))
    found = on(values, wanted, ["__range"]).filter("__at < __end and __at >= __end - __m")
    picks = found.groupBy(*keys).agg(*[F.max(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in shares])
    return on(picks, whole.drop("__cuts"))


def split_where_apart(rows: DataFrame, key: str, order: list[str], vector: str, most: float) -> DataFrame:
    """``chunk`` for each row of a sequence: a new one begins where the cosine distance to the row before exceeds ``most``."""
    w = Window.partitionBy(key).orderBy(*order)
    apart = F.round(1 - V.cosine_similarity(F.col(vector), F.lag(vector).over(w)), 9) > most
    return rows.withColumn("__new", F.when(apart, 1).otherwise(0)).withColumn("chunk", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def greedy_clusters(vectors: DataFrame, group: str, least: float, least_size: int = 1) -> DataFrame:
    """(group, cluster, size): in order of id each vector joins the first cluster whose first member has a cosine of ``least`` or more.

    The order is part of the definition, so a group is one task; it goes through the sorted vectors as a stream and holds the clusters' first members only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heads, ids, sizes, begun = None, np.zeros((0, 0)), [], [], False

        def done() -> pa.RecordBatch:
            kept = [(at, i, n) for i, n in zip(ids, sizes) if n >= least_size]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in kept], pa.int64()) for k in range(3)], [group, "cluster", "size"])

        for batch in batches:
            for who, i, v in zip(*(batch.column(c).to_pylist() for c in (group, "vec_id", "embedding"))):
                if not begun or who != at:
                    if begun:
                        yield done()
                    at, heads, ids, sizes, begun = who, np.zeros((0, len(v))), [], [], True
                v = np.array(v, np.float64)
                size = np.linalg.norm(v)
                v = v / size if size else v
                close = np.flatnonzero(heads[: len(ids)] @ v >= least)
                if len(close):
                    sizes[close[0]] += 1
                    continue
                if len(ids) == len(heads):
                    heads = np.concatenate([heads, np.zeros((max(16, len(heads)), len(v)))])
                heads[len(ids)] = v
                ids.append(i)
                sizes.append(1)
        if begun:
            yield done()

    rows = vectors.select(F.col(group).cast("long").alias(group), F.col("vec_id").cast("long").alias("vec_id"), "embedding").repartition(group).sortWithinPartitions(group, "vec_id")
    return rows.mapInArrow(run, f"{group} long, cluster long, size long")
