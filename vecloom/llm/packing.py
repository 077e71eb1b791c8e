"""Best-fit packing of token sequences into bins of fixed length.

Tokens are those of a byte-pair encoder, the one of the token-id records, or with ``measure`` "bytes" the UTF-8 bytes of a text. A text longer than a bin is cut into full pieces, which fill
bins of their own, and a rest; no token is lost. Rests are packed by their lengths alone: the plan
works on the count of each length, of which there are fewer than ``CAPACITY`` whatever the size of the corpus.

Plan: lengths from the longest down; the gap beside a length is filled exactly by one length, else by
a pair, else by a triple of the available lengths. Sets of lengths are bit sets, so the lookup of
complements and of sums of pairs are shifts and intersections; a combination is consumed as often as its counts
allow. What fits no combination is packed by best fit, longest first: into the open bin with the
smallest gap that holds it. Documents then get places by their rank among those of equal length.

Where the documents have an order, such as a mixture's, ``pack_in_order`` packs each run of ``WINDOW`` documents by itself, so the bins
read one after another hold the documents in that order, but for the places inside a run.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.llm.common import Scratch, salted_rank, slices, unused
from vecloom.llm.records import encoder, ranks_path

CAPACITY = 8192
#: Ranks are taken in pieces of about this many rows.
ROWS_PER_SALT = 500_000
#: Documents that are packed together where they have an order.
WINDOW = 16_384


class _Lengths:
    """Available lengths as bit sets: as they are, and mirrored at the capacity to look up complements."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.counts, self.capacity = dict(counts), capacity
        self.have = self.mirror = 0
        for x, n in counts.items():
            if n > 0:
                self.have |= 1 << x
                self.mirror |= 1 << (capacity - x)
        self.stale = 0
        self._index_pairs()

    def _index_pairs(self) -> None:
        sums, rest = 0, self.have
        while rest:
            low = rest & -rest
            sums |= self.have << (low.bit_length() - 1)
            rest ^= low
        text = format(sums & ((1 << (self.capacity + 1)) - 1), f"0{self.capacity + 1}b")
        self.pairs_mirror, self.stale = int(text[::-1], 2), 0  # bit capacity - s: some pair adds up to s

    def take(self, pattern: tuple[int, ...]) -> int:
        """Consumes ``pattern`` as often as the counts allow; returns how often."""
        need = Counter(pattern)
        times = min(self.counts.get(x, 0) // k for x, k in need.items())
        if times:
            for x, k in need.items():
                self.counts[x] -= times * k
                if not self.counts[x]:
                    self.have ^= 1 << x
                    self.mirror ^= 1 << (self.capacity - x)
                    self.stale += 1
        return times

    @staticmethod
    def _down(bits: int):
        while bits:
            x = bits.bit_length() - 1
            yield x
            bits ^= 1 << x

    def pairs(self, total: int, most: int):
        """(a, b), a >= b, a at most ``most``, available lengths adding up to ``total``."""
        found = self.have & (self.mirror >> (self.capacity - total)) & ((1 << (min(most, total - 1) + 1)) - 1) & ~1
        for a in self._down(found):
            if 2 * a < total:
                return
            yield a, total - a

    def triples(self, total: int, most: int):
        """(a, b, c) with a >= b >= c adding up to ``total``, by way of the index of sums of pairs."""
        if self.stale > 48:
            self._index_pairs()
        found = self.have & (self.pairs_mirror >> (self.capacity - total)) & ((1 << (min(most, total - 2) + 1)) - 1) & ~1
        for a in self._down(found):
            if 3 * a < total:
                return
            for b, c in self.pairs(total - a, a):
                yield a, b, c


def exact_patterns(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Bins filled to the last token as (lengths, number of bins), and the counts that are left."""
    left = _Lengths(counts, capacity)
    out = []

    def consume(length: int, rests) -> bool:
        for rest in rests:
            pattern = (length, *rest)
            need = Counter(pattern)
            if all(left.counts.get(x, 0) >= k for x, k in need.items()):
                out.append((tuple(sorted(pattern, reverse=True)), left.take(pattern)))
                return True
        return False

    for length in sorted(counts, reverse=True):
        gap = capacity - length
        while left.counts[length] > 0:
            if gap == 0:
                out.append(((length,), left.take((length,))))
            elif not (consume(length, [(gap,)]) or (gap > 1 and consume(length, left.pairs(gap, length))) or (gap > 2 and consume(length, left.triples(gap, length)))):
                break
    return out, {x: n for x, n in left.counts.items() if n > 0}


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: equal bins are handled together."""
    groups: dict[int, list[list]] = {}
    gaps = 0

    def put(pattern: tuple[int, ...], times: int) -> None:
        nonlocal gaps
        gap = capacity - sum(pattern)
        groups.setdefault(gap, []).append([pattern, times])
        gaps |= 1 << gap

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            fitting = gaps >> length
            if fitting:
                gap = (fitting & -fitting).bit_length() - 1 + length
                pattern, times = groups[gap].pop()
                if not groups[gap]:
                    gaps ^= 1 << gap
                each = gap // length  # a best fit stays the best fit for the next equal item
                bins = min(times, n // each)
                if bins:
                    put(pattern + (length,) * each, bins)
                    n -= bins * each
                    if times > bins:
                        put(pattern, times - bins)
                else:
                    put(pattern + (length,) * n, 1)
                    if times > 1:
                        put(pattern, times - 1)
                    n = 0
            else:
                each = capacity // length
                if n // each:
                    put((length,) * each, n // each)
                if n % each:
                    put((length,) * (n % each), 1)
                n = 0
    return [(p, t) for gap in sorted(groups) for p, t in groups[gap]]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """All bins as (lengths, longest first; number of such bins)."""
    exact, rest = exact_patterns({x: n for x, n in counts.items() if n > 0}, capacity)
    return exact + best_fit(rest, capacity)


def places(patterns: list[tuple[tuple[int, ...], int]], first_bin: int = 0) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, by first rank: (first rank, first bin, items a bin, offset in the bin)."""
    used: Counter = Counter()
    out: dict[int, list] = {}
    for pattern, times in patterns:
        offset = 0
        for length in dict.fromkeys(pattern):
            k = pattern.count(length)
            out.setdefault(length, []).append((used[length], first_bin, k, offset))
            used[length] += times * k
            offset += length * k
        first_bin += times
    return out


def _salt_bits(rows: int) -> int:
    return max(0, (rows // ROWS_PER_SALT).bit_length())


def sizes_of(docs: DataFrame, measure: str = "tokens", ranks: str | None = None, order: Column | None = None) -> DataFrame:
    """(doc_id, n, h) of the texts that aren't empty: the number of tokens, and a hash, or ``order``, that orders texts of equal length. No shuffle."""
    rows = docs.filter("octet_length(text) > 0").select(F.col("doc_id").cast("long").alias("doc_id"), F.expr("cast(octet_length(text) as bigint)").alias("n"), (F.xxhash64(F.col("doc_id").cast("long"), "text") if order is None else order).alias("h"), "text")
    if measure == "bytes":
        return rows.drop("text")
    with open(ranks or ranks_path(), "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(sent.value)
        for batch in batches:
            for piece in slices(batch, "text"):
                n = [len(encode.encode_to_numpy(t, disallowed_special=())) for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n, pa.int64()), piece.column("h")], ["doc_id", "n", "h"])

    return rows.mapInArrow(run, "doc_id long, n long, h long")


def pack(docs: DataFrame, capacity: int = CAPACITY, measure: str = "tokens") -> DataFrame:
    """One row for each piece of a text: (bin_id, doc_id, piece, start, length, offset).

    The piece is tokens ``start`` to ``start + length`` of the text and lies at ``offset`` of its bin. Null and empty texts
    have no tokens and no piece; a null doc_id is packed like any other. Equal rows are packed one by one; which of them gets which place is of no account.
    A text of any length is counted whole and cut into full bins. An empty table has no bins; columns other than doc_id and text aren't read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    sizes = scratch.write(sizes_of(docs, measure), "sizes").withColumn("full", F.expr(f"n div {capacity}")).withColumn("rest", F.col("n") % capacity)
    counts = {r[0]: r[1] for r in sizes.groupBy("rest").count().collect()}  # at most one row for each length below the capacity
    with_full, full = sizes.filter("full > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("full"), F.lit(0))).first()
    out = []
    if with_full:
        bits = _salt_bits(with_full)
        salted = sizes.filter("full > 0").withColumn("salt", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
        upto = Window.partitionBy("salt").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        before = Window.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
        shift = salted.groupBy("salt").agg(F.sum("full").alias("m")).select("salt", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"))  # 2 ** bits rows
        based = salted.withColumn("at", F.coalesce(F.sum("full").over(upto), F.lit(0))).join(shift, "salt")
        pieces = based.select("doc_id", (F.col("before") + F.col("at")).alias("at"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece"))
        out.append(pieces.select((F.col("at") + F.col("piece")).alias("bin_id"), "doc_id", "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), F.lit(0).cast("long").alias("offset")))
    rests = {x: n for x, n in counts.items() if x > 0}
    table = places(plan(rests, capacity), full)
    where = spark.createDataFrame(pd.DataFrame({"len": list(table), "p": [[{"rank": a, "bin": b, "k": k, "off": o} for a, b, k, o in v] for v in table.values()]}), "len long, p array<struct<rank:long,bin:long,k:long,off:long>>") if table else spark.createDataFrame([], "len long, p array<struct<rank:long,bin:long,k:long,off:long>>")
    bits = _salt_bits(max(rests.values(), default=0))
    rest = sizes.filter("rest > 0").select("doc_id", "h", "full", "rest")
    ranked = salted_rank(rest, ["rest"], F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"), ["h", "doc_id"], "rank")
    placed = ranked.join(F.broadcast(where), F.col("rest") == F.col("len")).withColumn("x", F.expr("element_at(filter(p, y -> y.rank <= rank), -1)")).withColumn("q", F.expr("rank - x.rank"))
    out.append(placed.select(F.expr("x.bin + q div x.k").alias("bin_id"), "doc_id", F.col("full").alias("piece"), (F.col("full") * capacity).alias("start"), F.col("rest").alias("length"), F.expr("x.off + q % x.k * rest").alias("offset")))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """The rows of a written table with their number, from 0, in the order they were written in: by task, file and row of the file."""
    at, row, start = (unused(x, [*docs.columns, name]) for x in ("__vl_file", "__vl_row", "__vl_start"))
    meta = docs.metadataColumn("_metadata")
    files = docs.select(meta["file_path"].alias(at)).groupBy(at).count().collect()  # one row for each file
    starts, n = [], 0
    for path, rows in sorted(files, key=lambda r: (int((re.search(r"part-(\d+)[^/]*$", r[0]) or [0, 0])[1]), r[0])):
        starts.append((path, n))
        n += rows
    table = docs.sparkSession.createDataFrame(starts, f"{at} string, {start} long")
    return docs.withColumns({at: meta["file_path"], row: meta["row_index"]}).join(F.broadcast(table), at).withColumn(name, F.col(start) + F.col(row)).drop(at, row, start)


def _window_places(counts: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """For each length of one run of documents, the places of its ranks."""
    table = places(plan({int(x): int(n) for x, n in zip(counts["rest"], counts["n"])}, capacity))
    return pd.DataFrame({"w": counts["w"].iloc[0], "len": list(table), "p": [[{"rank": a, "bin": b, "k": k, "off": o} for a, b, k, o in v] for v in table.values()]})


def pack_in_order(docs: DataFrame, capacity: int = CAPACITY, measure: str = "tokens", window: int = WINDOW) -> DataFrame:
    """``pack`` for a written table whose rows have an order: each run of ``window`` rows fills bins of its own.

    Bins are numbered by run, and inside a run by the first of their documents; of texts of equal length the earlier take the earlier places. A run leaves
    about one bin part empty. Runs are planned in tasks of their own; nulls, empty and long texts and equal rows as in ``pack``.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    at = unused("__vl_pos", docs.columns)
    sizes = scratch.write(sizes_of(numbered(docs.select("doc_id", "text"), at), measure, order=F.col(at)), "sizes")
    sizes = sizes.withColumns({"w": F.expr(f"h div {window}"), "full": F.expr(f"n div {capacity}"), "rest": F.col("n") % capacity})
    rest = sizes.filter("rest > 0")
    plans = rest.groupBy("w", "rest").agg(F.count(F.lit(1)).alias("n")).groupBy("w").applyInPandas(lambda counts: _window_places(counts, capacity), "w long, len long, p array<struct<rank:long,bin:long,k:long,off:long>>")
    ranked = rest.withColumn("rank", F.row_number().over(Window.partitionBy("w", "rest").orderBy("h")) - 1)
    placed = ranked.join(plans.withColumnRenamed("len", "rest"), ["w", "rest"]).withColumn("x", F.expr("element_at(filter(p, y -> y.rank <= rank), -1)")).withColumn("q", F.expr("rank - x.rank"))
    rests = placed.select("w", "h", F.expr("x.bin + q div x.k").alias("b"), "doc_id", F.col("full").alias("piece"), (F.col("full") * capacity).alias("start"), F.col("rest").alias("length"), F.expr("x.off + q % x.k * rest").alias("offset"))
    rests = rests.withColumn("h", F.min("h").over(Window.partitionBy("w", "b"))).withColumn("kind", F.lit(1))
    full = sizes.filter("full > 0").select("w", "h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("b"), "doc_id")
    full = full.select("w", "h", "b", "doc_id", F.col("b").alias("piece"), (F.col("b") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), F.lit(0).cast("long").alias("offset"), F.lit(0).alias("kind"))
    pieces = scratch.write(rests.unionByName(full).withColumn("at", F.dense_rank().over(Window.partitionBy("w").orderBy("h", "kind", "b")).cast("long") - 1), "pieces")
    before = Window.orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
    first = pieces.groupBy("w").agg((F.max("at") + 1).alias("m")).select("w", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("first"))  # one row for each run
    return pieces.join(first, "w").select((F.col("first") + F.col("at")).alias("bin_id"), "doc_id", "piece", "start", "length", "offset")


ORACLE_SQL = None  # a sequential plan: tests/llm/test_packing.py compares it with packing item by item


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
