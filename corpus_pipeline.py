"""The corpus pipeline: language ID, SimHash near-dedup, substring dedup, mixing, best-fit packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. The first four return the columns of
``documents``; the last returns the bins, in the order in which the mixture was written. ``run`` writes each result as Parquet in the shared folder and hands the
written table to the next stage, so a lost executor costs no more than the tasks of one stage; a table goes when the next is written.

Null and blank texts go with the first stage. Documents without a doc_id are kept and treated like others, their equal texts
being copies. Of equal rows near-dedup leaves one. Ties are broken by doc_id, then by a hash of the text. Further columns, whatever their
names, stay up to the mixture. An empty table gives no bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import langid, mixing, packing, simhash, substring
from vecloom.llm.common import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language; the label that was found replaces none: ``lang`` stays as it is."""
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id stays."""
    return simhash.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated spans out of the texts; a document of which nothing is left goes; ``n_chars`` follows the text."""
    cut = substring.drop_repeated_spans(docs, every=True)
    return cut.filter("text is not null and text rlike '\\\\S'").withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the target weights, in the order of the mixture."""
    return mixing.drawn(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(bin_id, doc_id, piece, start, length, offset) of every piece of the mixture's texts, in tokens; the bins follow the order of the mixture."""
    return packing.pack_in_order(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixture),
    ("best_fit_packing", packed),
]

#: Language ID is a trained model and the schedules are sequential: tests/llm/test_pipeline.py holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    before = None
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)  # all that was read of it is in the table just written
        before = name
    return docs
