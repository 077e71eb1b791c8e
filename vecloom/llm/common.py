"""Helpers shared by the training-data operators: scratch tables, row keys, batch slicing, ranks."""

from __future__ import annotations

import ctypes
import itertools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, on one machine a temporary folder is set; a cluster raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vecloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables of one operator run in the shared folder; they survive the loss of executors and cut the lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Deletes one table that no later plan reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release_memory() -> None:
    """Hands memory that a worker has freed back to the system; workers wait for their next task with what they hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id apart; a null text has its own key."""
    return F.when(text.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(text))


def slices(batch: pa.RecordBatch, column: str, chars: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about ``chars`` bytes of text, so that memory doesn't follow the batch size. Rows stay whole."""
    n = batch.num_rows
    if not n:
        return
    lengths = np.nan_to_num(np.asarray(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=float))
    part = (np.cumsum(lengths) // chars).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def salted_rank(df: DataFrame, group: list[str], salt: Column, order: list, out: str, few_groups: bool = False) -> DataFrame:
    """Adds ``out``: the 0-based rank of a row in its group by (salt, order).

    A group is ranked in as many pieces as it has salts, each in its own task, and shifted by
    the rows of earlier salts; so no task holds a whole hot group. Ties in the order get ranks
    in any order. Null group values form groups of their own. ``few_groups``: the caller has checked
    that the table of groups by salts is small, so that it is broadcast and ``df`` isn't shuffled again.
    """
    names = [unused(f"__vl_g{i}", df.columns) for i in range(len(group) + 1)]
    at, before_name, n = (unused(x, df.columns) for x in ("__vl_at", "__vl_before", "__vl_n"))
    salt_name = names[-1] + "s"
    df = df.withColumn(salt_name, salt)
    keys = [*group, salt_name]
    within = df.withColumn(at, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*group).orderBy(salt_name).rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*[F.col(k).alias(g) for k, g in zip(keys, names)], F.coalesce(F.sum(n).over(before), F.lit(0)).alias(before_name))
    on = F.lit(True)
    for k, g in zip(keys, names):
        on = on & F.col(k).eqNullSafe(F.col(g))
    joined = within.join(F.broadcast(shift) if few_groups else shift, on)
    return joined.withColumn(out, F.col(before_name) + F.col(at) - 1).drop(salt_name, at, before_name, *names)


def unused(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column has it, upper and lower case alike."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken or name.lower() + "s" in taken:
        name += "_"
    return name


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of the undirected ``edges(a, b)``: rows (node, component), the component being its smallest node.

    Alternating large-star and small-star steps; each round's edges are written to the shared
    folder. Rounds grow with the logarithm of the longest path and go on until nothing changes.
    """
    cur = scratch.write(edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc0")
    last = None
    for k in itertools.count(1):
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).union(cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        new = scratch.write(small, f"cc{k}")
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"cc{k - 1}")
        cur = new
        if state == last:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(cur.select(F.col("b"), F.col("b"))).distinct()
        last = state
