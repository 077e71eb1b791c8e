"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in an order given by a hash of doc_id, form blocks. A source that has the share w of the
weight must have its block j in one of the slots from floor(j / w) up to ceil((j + 1) / w) - 1; each slot goes to the
released block with the earliest deadline, ties to the first source by name. The shares are exact fractions that add up to one, so
every block meets its deadline, and after any number of slots each source deviates from its target by less than one block.

When a source runs out, a new phase starts: its weight goes to the others in proportion, and the deviation counts from there.
That goes on until every source is used up, so every document of a source with a weight is drawn. ``least_live`` above 0 ends the
mixture earlier: when the sources that are left hold less than that share of the target weight.

Exact shares have no short period, so the schedule is as long as the number of blocks. One task makes it slot by slot
and hands it on in batches: its memory follows the number of sources, its time the number of blocks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import salted_rank, text_key

BLOCK_DOCS, QUANTUM, ALPHA, LEAST_LIVE = 8, 1000, 0.7, 0.0
#: Ranks are taken in pieces of about this many rows, however large a source is.
ROWS_PER_SALT = 10_000


#: A schedule of up to so many blocks is broadcast.
FEW_BLOCKS = 500_000


def quantised(weights: list[float], quantum: int) -> list[Fraction]:
    """The exact parts of ``quantum`` that the weights stand for; they add up to it."""
    exact = [Fraction(w) for w in weights]
    total = sum(exact)
    return [w * quantum / total for w in exact]


def schedule(blocks: dict[str, int], weights: dict[str, float], least_live: float = LEAST_LIVE, quantum: int = QUANTUM) -> Iterator[tuple[str, int, int]]:
    """(source, block, slot) in the order of the slots, earliest deadline first. The shares are exact, so ``quantum`` doesn't matter to them.

    A slot costs a step of a heap; a phase, of which there are at most as many as sources, the heap of the sources that are left.
    """
    live = sorted(s for s in blocks if blocks[s] > 0 and weights[s] > 0)
    total = sum(weights[s] for s in live)
    done, at = dict.fromkeys(live, 0), 0
    # The exact weights as whole numbers with a common denominator, so that a new phase costs no fractions.
    exact = {s: Fraction(weights[s]) for s in live}
    common = math.lcm(*[w.denominator for w in exact.values()]) if live else 1
    whole = {s: w.numerator * (common // w.denominator) for s, w in exact.items()}
    while live and sum(weights[s] for s in live) >= least_live * total:
        # Block j of a source is released at j * up // down, and due before the same of j + 1, rounded up.
        up, downs = sum(whole[s] for s in live), [whole[s] for s in live]
        waiting = [(0, i, 0) for i in range(len(live))]
        ready: list[tuple[int, int, int]] = []
        t = 0
        while True:
            while waiting and waiting[0][0] <= t:
                _, i, j = heapq.heappop(waiting)
                heapq.heappush(ready, (-((j + 1) * -up // downs[i]), i, j))
            deadline, i, j = heapq.heappop(ready)
            if t >= deadline:
                raise AssertionError("a deadline was missed")
            s = live[i]
            if done[s] >= blocks[s]:
                break
            yield s, done[s], at
            done[s] += 1
            t += 1
            at += 1
            heapq.heappush(waiting, ((j + 1) * up // downs[i], i, j + 1))
        live = [s for s in live if done[s] < blocks[s]]


def target_weights(counts: dict[str, int], alpha: float = ALPHA) -> dict[str, float]:
    """Shares of the document counts to the power ``alpha``, which lifts small sources above their share."""
    total = sum(n**alpha for n in counts.values()) or 1.0
    return {s: n**alpha / total for s, n in counts.items()}


def scheduled(docs: DataFrame, weights: dict[str, float] | None = None, block_docs: int = BLOCK_DOCS, alpha: float = ALPHA, least_live: float = LEAST_LIVE, quantum: int = QUANTUM) -> DataFrame:
    """``docs`` with three columns: ``__vl_block`` (in its source), ``__vl_slot`` (null if not drawn), ``__vl_at`` (in its block).

    Null sources are one source named by the empty string. ``weights`` by source replace the targets
    that are made of the counts of all documents; a source they don't name isn't drawn. An empty table stays empty. Texts, null,
    empty or very long, only tell rows of one doc_id apart; null ids are ranked like any other. Columns may have any names but
    those that begin with ``__vl_``.
    """
    spark = docs.sparkSession
    named = docs.withColumn("__vl_source", F.coalesce(F.col("source").cast("string"), F.lit("")))
    counts = {r[0]: r[1] for r in named.groupBy("__vl_source").count().collect()}  # one row for each source
    targets = {s: (weights or {}).get(s, 0.0) for s in counts} if weights else target_weights(counts, alpha)
    blocks = {s: -(-n // block_docs) for s, n in counts.items()}
    h = F.xxhash64(F.col("doc_id").cast("long"))
    key = F.col("__vl_key") if "__vl_key" in docs.columns else text_key(F.col("text"))
    bits = max(0, (max(counts.values(), default=0) // ROWS_PER_SALT).bit_length())
    salt = F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")
    named = named.withColumn("__vl_h", h.bitwiseXOR(F.lit(-(1 << 63))))
    ranked = salted_rank(named, ["__vl_source"], salt, ["__vl_h", "doc_id", key], "__vl_rank", few_groups=len(counts) << bits <= 500_000)
    ranked = ranked.withColumn("__vl_block", F.expr(f"__vl_rank div {block_docs}")).withColumn("__vl_at", F.col("__vl_rank") % block_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _ in range(batch.num_rows):
                for rows in batched(schedule(blocks, targets, least_live, quantum), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["__vl_s", "__vl_b", "__vl_slot"])

    slots = spark.range(0, 1, 1, 1).mapInArrow(run, "__vl_s string, __vl_b long, __vl_slot long")
    few = sum(blocks.values()) <= FEW_BLOCKS
    out = ranked.join(F.broadcast(slots) if few else slots, F.expr("__vl_s = __vl_source and __vl_b = __vl_block"), "left")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "__vl_block", "__vl_slot", "__vl_at")


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """Every document's place in the mixture: (doc_id, source, block, slot, position).

    Read in the order of (slot, position). ``slot`` is null for documents that aren't drawn. Equal rows
    have places of their own, their order among each other being of no account.
    """
    out = scheduled(docs.select("doc_id", "source", text_key(F.col("text")).alias("__vl_key")), **parameters)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col("__vl_block").alias("block"), F.col("__vl_slot").alias("slot"), F.col("__vl_at").alias("position"))


def drawn(docs: DataFrame, **parameters) -> DataFrame:
    """The documents of the mixture in its order (range-partitioned and sorted by slot), all columns unchanged."""
    out = scheduled(docs, **parameters).filter("__vl_slot is not null")
    return out.repartitionByRange("__vl_slot").sortWithinPartitions("__vl_slot", "__vl_at").select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE_SQL = None  # a sequential schedule: tests/llm/test_mixing.py compares it with a simulation slot by slot


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
