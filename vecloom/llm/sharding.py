"""Sharding by a permutation-filled lookup table (Maglev hashing).

Each shard has a permutation of the table's slots, its preference order: (offset + j * skip) mod SIZE, both
taken from the md5 of its name. The shards take turns; each claims the first slot in its order that nobody holds,
until the prime-sized table is full. A key goes to the shard that holds slot (hash of key) mod SIZE: one
lookup in a broadcast table whose size depends on nothing but SIZE. All shards get the same share to
within one slot, and when a shard comes or goes few other keys move.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import unused

SHARDS, SIZE = 64, 6553


def _digits(text: str, first: int) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[first : first + 15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = SIZE) -> list[int]:
    """The shard (by position) that holds each slot."""
    if not is_prime(size) or len(shards) > size or not shards:
        raise ValueError("the size must be a prime and there must be between one shard and as many as slots")
    offset = [_digits(s, 0) % size for s in shards]
    skip = [_digits(s, 15) % (size - 1) + 1 for s in shards]
    table, turn, filled = [-1] * size, [0] * len(shards), 0
    while filled < size:
        for i in range(len(shards)):
            slot = (offset[i] + turn[i] * skip[i]) % size
            while table[slot] >= 0:
                turn[i] += 1
                slot = (offset[i] + turn[i] * skip[i]) % size
            table[slot] = i
            turn[i] += 1
            filled += 1
            if filled == size:
                break
    return table


def slot_of(key: Column, size: int = SIZE) -> Column:
    """(first 15 hex digits of the key's md5) mod size; a null key counts as the empty string."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15)
    return F.conv(digits, 16, 10).cast("long") % size


def shard(df: DataFrame, key: str, shards: list[str], size: int = SIZE) -> DataFrame:
    """One row for each row of ``df``: (key, slot, shard). Equal keys share a shard; a null key has one too; no shuffle.

    Other columns aren't read. Where the key itself is called slot or shard, the new column has an underscore more. An empty table gives no rows.
    """
    table = lookup_table(shards, size)
    lookup = df.sparkSession.createDataFrame(pd.DataFrame({"slot_": range(size), "shard": [shards[i] for i in table]}), "slot_ long, shard string")
    slot, name = (unused(x, [key]) for x in ("slot", "shard"))
    rows = df.select(F.col(f"`{key}`").alias("key_")).withColumn("slot", slot_of(F.col("key_"), size))
    return rows.join(F.broadcast(lookup), F.col("slot") == F.col("slot_"), "left").select(F.col("key_").alias(key), F.col("slot").alias(slot), F.col("shard").alias(name))


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:04d}" for i in range(n)]


ORACLE_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i, name, ('0x' || substr(md5(name), 1, 15))::BIGINT % {SIZE} AS off, ('0x' || substr(md5(name), 16, 15))::BIGINT % {SIZE - 1} + 1 AS skip
  FROM (SELECT i, format('shard-{{:04d}}', i) AS name FROM (SELECT unnest(range({SHARDS}))::INT AS i))
), orders AS MATERIALIZED (
  SELECT i, list((off + j * skip) % {SIZE} ORDER BY j) AS pref FROM shards, (SELECT unnest(range({SIZE}))::BIGINT AS j) GROUP BY i
), claims AS (
  SELECT 0 AS step, list_transform(range({SIZE}), lambda x: false) AS held, -1::BIGINT AS slot
  UNION ALL
  SELECT step + 1, list_concat(list_concat(held[:best], [true]), held[best + 2:]), best
  FROM (SELECT c.step, c.held, list_filter(o.pref, lambda x: NOT c.held[x + 1])[1] AS best FROM claims c JOIN orders o ON o.i = c.step % {SHARDS} WHERE c.step < {SIZE})
)
SELECT d.doc_id, ('0x' || substr(md5(d.doc_id::VARCHAR), 1, 15))::BIGINT % {SIZE} AS slot, s.name AS shard
FROM documents d JOIN claims c ON c.slot = ('0x' || substr(md5(d.doc_id::VARCHAR), 1, 15))::BIGINT % {SIZE} JOIN shards s ON s.i = (c.step - 1) % {SHARDS}
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", shard_names())
