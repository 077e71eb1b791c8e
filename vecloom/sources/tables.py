"""Table access: Parquet scans with pushed-down columns and predicates, upserts, deletes, operation logs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table, cut to ``columns`` if any are named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, on one machine a temporary one is set; a cluster raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vecloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` written to the shared folder and read again: it is computed once, the lineage ends there, and lost executors don't matter."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def page(df: DataFrame, order: list[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """One page in a total order; filters come before, so a page is full while rows last."""
    return df.orderBy(*order).offset(offset).limit(limit)


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``changes`` replace those of ``base`` with the same key."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes)


def insert_if_new(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key ``base`` doesn't have; those of one key must have been made one before."""
    return rows.join(base.select(key), key, "left_anti")


def delete(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key), key, "left_anti")


def replay(log: DataFrame, key: str, order: list[str], op: str, deletes: str = "DELETE") -> DataFrame:
    """The state after a write-ahead log: each key's last operation by ``order``; deleted keys are gone."""
    last = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return log.withColumn("__n", F.row_number().over(last)).filter((F.col("__n") == 1) & (F.col(op) != deletes)).drop("__n")


def statistics(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    return vectors.agg(F.count(F.lit(1)).alias("vectors"), F.avg(F.size(column)).alias("avg_dimension"))


def wrong_dimension(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """(vec_id, dimension) of the vectors that haven't the collection's length."""
    return vectors.select("vec_id", F.size(column).cast("long").alias("dimension")).filter(F.col("dimension") != dim)


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    """A SQL statement over the tables of a folder: those it names are registered as temporary views."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", statement):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(statement)


def export_arrow(df: DataFrame, path: str) -> str:
    """Writes a table as Parquet for readers of Arrow, and returns its path; nothing goes through the driver."""
    df.write.mode("overwrite").parquet(path)
    return path


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_beir(spark: SparkSession, path: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, corpus, qrels) of a dataset folder with queries.jsonl, corpus.jsonl and qrels/SPLIT.tsv."""
    queries = spark.read.schema("_id string, text string").json(f"{path}/queries.jsonl")
    corpus = spark.read.schema("_id string, title string, text string").json(f"{path}/corpus.jsonl")
    qrels = spark.read.option("sep", "\t").option("header", True).schema("`query-id` string, `corpus-id` string, score int").csv(f"{path}/qrels/{split}.tsv")
    return queries, corpus, qrels


def read_feed(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """(url, title, text) of RSS items; an item needs a url and a title or a text."""
    df = spark.read.format("xml").option("rowTag", row_tag).schema("link string, title string, description string, content string").load(path)
    return df.select(F.col("link").alias("url"), "title", F.coalesce("content", "description").alias("text")).filter("url is not null and (title is not null or text is not null)")


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """(url, title, text) of Atom entries: the address of the first link, the content or else the summary."""
    schema = "id string, title string, summary string, content string, link array<struct<_href string, _rel string>>"
    df = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    url = F.coalesce(F.get("link", F.lit(0)).getField("_href"), F.col("id"))
    return df.select(url.alias("url"), "title", F.coalesce("content", "summary").alias("text")).filter("url is not null and (title is not null or text is not null)")


def read_sitemap_index(spark: SparkSession, path: str) -> DataFrame:
    """(url, lastmod) of the sitemaps that an index names."""
    df = spark.read.format("xml").option("rowTag", "sitemap").schema("loc string, lastmod string").load(path)
    return df.select(F.trim("loc").alias("url"), "lastmod").filter("url is not null")


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(url, lastmod) of a sitemap's entries."""
    df = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    return df.select(F.trim("loc").alias("url"), "lastmod").filter("url is not null")
