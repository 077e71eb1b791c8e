"""Streaming jobs: standing similarity subscriptions, change application, continuously kept views.

Each is a micro-batch job from a file source with a checkpoint in the shared folder. Sinks are keyed by batch id, so
a batch that is run again after a failure replaces its own output and nothing else.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators import knn
from vecloom.sources.tables import shared_dir, table


def stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 1) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    system = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    whole = system.getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(path)).isDirectory()
    # A source reads a folder; a single file is picked by its name.
    return source.parquet(path) if whole else source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run(df: DataFrame, each, root: str, mode: str = "append") -> None:
    """Runs all that is there now to the end; ``each(batch, batch_id)``."""
    query = df.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def subscription(spark: SparkSession, sf_dir: str, least: float = 0.3, every: int = 20) -> DataFrame:
    """(subscriber, vec_id, similarity) of every arriving vector within ``least`` of a standing query: each vector whose id is divisible by ``every``.

    Each batch meets the standing queries block by block, however many they are.
    """
    root = f"{shared_dir(spark)}/subscription-{uuid.uuid4().hex}"
    standing = knn.query_set(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), every)

    def each(batch: DataFrame, i: int) -> None:
        hits = knn.similar(standing, batch.select("vec_id", "embedding"), least)
        hits.select(F.col("query_id").alias("subscriber"), "vec_id", F.round("similarity", 6).alias("similarity")).write.mode("overwrite").parquet(f"{root}/out/batch={i}")

    run(stream(spark, sf_dir, "embeddings"), each, root)
    return spark.read.schema("subscriber long, vec_id long, similarity double").parquet(f"{root}/out/batch=*")


def apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after a stream of changes: of each key the last event by (ts, event_id) wins, whatever the batch it came in; errors delete.

    Each batch merges its last events with the state of the batch before and writes a new state.
    """
    root = f"{shared_dir(spark)}/changes-{uuid.uuid4().hex}"
    fields = "user_id long, ts timestamp_ntz, event_id long, event_type string, value double"

    def merge(batch: DataFrame, i: int) -> None:
        rows = batch.select("user_id", "ts", "event_id", "event_type", "value")
        if i > 0:
            rows = rows.unionByName(batch.sparkSession.read.schema(fields).parquet(f"{root}/state-{i - 1}"))
        last = rows.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("l"))
        last.select("user_id", "l.*").write.mode("overwrite").parquet(f"{root}/state-{i}")
        latest["id"] = i

    latest: dict = {}
    run(stream(spark, sf_dir, "events"), merge, root)
    if "id" not in latest:
        return spark.createDataFrame([], "user_id long, value double")
    return spark.read.schema(fields).parquet(f"{root}/state-{latest['id']}").filter("event_type <> 'error'").select("user_id", "value")


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, event_type, n, total): a windowed aggregate under a watermark, kept as a view that each batch rewrites."""
    root = f"{shared_dir(spark)}/view-{uuid.uuid4().hex}"
    events = stream(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "30 days")
    grouped = events.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    latest: dict = {}

    def keep(batch: DataFrame, i: int) -> None:
        batch.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total").write.mode("overwrite").parquet(f"{root}/view-{i}")
        latest["id"] = i

    run(grouped, keep, root, "complete")
    schema = "day string, event_type string, n long, total double"
    return spark.read.schema(schema).parquet(f"{root}/view-{latest['id']}") if latest else spark.createDataFrame([], schema)


def seen_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(digest) of each text that arrives, once: the digests seen before are the stream's state."""
    root = f"{shared_dir(spark)}/seen-{uuid.uuid4().hex}"
    fresh = stream(spark, sf_dir, "conversations").filter("text is not null").select(F.md5("text").alias("digest")).dropDuplicates(["digest"])
    run(fresh, lambda batch, i: batch.write.mode("overwrite").parquet(f"{root}/out/batch={i}"), root)
    return spark.read.schema("digest string").parquet(f"{root}/out/batch=*")


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, n) of the table that a queue of vectors was flushed to, a folder for each batch."""
    root = f"{shared_dir(spark)}/ingested-{uuid.uuid4().hex}"
    run(stream(spark, sf_dir, "embeddings"), lambda batch, i: batch.write.mode("overwrite").parquet(f"{root}/table/batch={i}"), root)
    return spark.read.schema("vec_id long, embedding array<float>, label int").parquet(f"{root}/table/batch=*").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
