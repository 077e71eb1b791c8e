"""SimHash near-duplicate removal by meet-in-the-middle ball hashing.

A document's fingerprint has ``blocks * width`` bits: each word's md5 votes on every bit with a
weight of round(8 * sqrt(count)). Two fingerprints are near when they differ in at most
``RADIUS = 3 * blocks - 1`` bits. Then some block differs in two bits or fewer, and the two
balls of half that radius around the block's values meet in a common variant: each
fingerprint emits, for every block, the block and all values one bit away, and near pairs
are exactly those that collide on a variant and pass the check of all bits. The search is
complete: no band, cap or sample leaves a near pair out.

The width of a block sets how many chance collisions there are: ``352 / 2 ** 25`` of all pairs a block at the default if bits were
even and independent, 45 times that in all on check_l. They grow with the square of the documents, so they are compared as whole arrays,
not as rows of a join. Near pairs grow so too where a group does: the classes are made from links, of which a task sends fewer than it has fingerprints.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.llm.common import Scratch, components, release_memory, slices, text_key

BLOCKS, WIDTH = 5, 25
RADIUS = 3 * BLOCKS - 1
#: Equal rows that one array stands for; members of groups, of some 40 bytes each, that are broadcast at most.
AT_ONCE, FEW_MEMBERS = 10_000, 500_000
#: Emitted rows that a task of the search holds, about; candidate pairs that it compares at a time.
ROWS_PER_TASK, CANDIDATES = 500_000, 1 << 18
#: Variants of more rows are compared by themselves, as a square; those of fewer together, pair by pair.
DENSE = 128


#: Lower-case UTF-8 bytes to words: ASCII punctuation, white space and controls part them, all else is kept.
PARTING = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-case runs of letters, digits and non-ASCII characters; of a text that has none, the stripped text itself."""
    lowered = text.lower().encode("utf-8", "replace")
    return lowered.translate(PARTING).split() or ([lowered.strip()] if lowered.strip() else [])


def fingerprints(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have words, their bits as 0/1). A bit is set when its votes sum to more than zero."""
    counts = [Counter(words_of(t)) if t else Counter() for t in texts]
    have = np.flatnonzero([len(c) for c in counts])
    ids: dict[bytes, int] = {}
    for i in have:
        ids.update(counts[i])
    votes = np.unpackbits(np.frombuffer(b"".join([hashlib.md5(w).digest() for w in ids]), np.uint8).reshape(-1, 16), axis=1)[:, :bits].astype(np.int8) * 2 - 1
    ids = dict(zip(ids, range(len(ids))))
    sums = np.zeros((len(have), bits), np.float32)  # whole numbers below 2 ** 24, so exact
    for row, i in enumerate(have):
        c = counts[i]
        codes = np.fromiter(map(ids.__getitem__, c), np.int32, len(c))
        weight = np.rint(8 * np.sqrt(np.fromiter(c.values(), np.float64, len(c)))).astype(np.float32)
        for a in range(0, len(codes), 50_000):
            sums[row] += weight[a : a + 50_000] @ votes.take(codes[a : a + 50_000], axis=0).astype(np.float32)
    return have, (sums > 0).astype(np.uint8)


def with_fingerprints(docs: DataFrame, blocks: int = BLOCKS, width: int = WIDTH) -> DataFrame:
    """Rows (doc_id, key, hi, lo, block) of the documents that have words; ``key`` tells texts of one doc_id apart."""
    bits = blocks * width
    if bits > 126:
        raise ValueError("blocks * width must be at most 126")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = (1 << np.arange(63, dtype=np.int64)), (1 << np.arange(max(bits - 63, 0), dtype=np.int64))
        part = 1 << np.arange(width, dtype=np.int32)
        for batch in batches:
            for piece in slices(batch, "text"):
                have, b = fingerprints(piece.column("text").to_pylist(), bits)
                if not len(have):
                    continue
                b64 = b.astype(np.int64)
                ints = (b.reshape(len(b), blocks, width).astype(np.int32) * part).sum(axis=2, dtype=np.int32)
                take = pa.array(have)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id").take(take), piece.column("key").take(take),
                        pa.array(b64[:, :63] @ high[: min(bits, 63)]), pa.array(b64[:, 63:] @ low if bits > 63 else np.zeros(len(b), np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, ints.size + 1, blocks, dtype=np.int32)), pa.array(ints.ravel())),
                    ],
                    ["doc_id", "key", "hi", "lo", "block"],
                )
        release_memory()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), "text")
    return rows.mapInArrow(run, "doc_id long, key long, hi long, lo long, block array<int>")


def _block(hi: np.ndarray, lo: np.ndarray, at: int, width: int) -> np.ndarray:
    """Block ``at`` of fingerprints with hi (the low 63 bits) and lo (the rest)."""
    low, mask = at * width, (1 << width) - 1
    if low >= 63:
        return (lo >> (low - 63)) & mask
    return ((hi >> low) | (lo << (63 - low) if low + width > 63 else 0)) & mask


def _met(variant: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], blocks: int, width: int) -> np.ndarray:
    """Of near pairs that collide on ``variant``, those for which this is the one collision that counts.

    That is the one in their first near block, and there on the least shared variant: equal values meet in themselves; values one bit
    apart in the lesser; values two bits apart in the lesser of both between.
    """
    at, value = variant >> width, variant & ((1 << width) - 1)
    counts, open_ = np.zeros(len(variant), bool), np.ones(len(variant), bool)
    for k in range(blocks):
        x, y = _block(*a, k, width), _block(*b, k, width)
        differ = x ^ y
        n, last = np.bitwise_count(differ), differ & -differ
        least = np.where(n < 2, np.minimum(x, y), np.minimum(x ^ last, x ^ differ ^ last))
        counts |= open_ & (n <= 2) & (at == k) & (value == least)
        open_ &= n > 2
    return counts


def _near(variant: np.ndarray, hi: np.ndarray, lo: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs (i, j), i < j, of rows of the same variant, rows being sorted by it; about ``CANDIDATES`` are compared at a time."""
    start = np.flatnonzero(np.append(True, variant[1:] != variant[:-1])) if len(variant) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(variant)))

    def kept(i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = np.flatnonzero(apart + np.bitwise_count(lo[i] ^ lo[j]) <= radius)
        return i[found], j[found]

    for s, n in zip(start[size > DENSE].tolist(), size[size > DENSE].tolist()):  # strips of the square of a variant's rows
        at = 0
        while at < n - 1:
            k = max(1, min(CANDIDATES // (n - at), n // 4))
            apart = np.bitwise_count(hi[s + at : s + at + k, None] ^ hi[None, s + at + 1 : s + n]).ravel()
            found = np.flatnonzero(apart <= radius)
            i, j = np.divmod(found, n - at - 1)
            upper = j >= i
            i, j, found = i[upper] + s + at, j[upper] + s + at + 1, found[upper]
            yield kept(i, j, apart[found])
            at += k
    small = np.repeat(size <= DENSE, size)
    later = np.where(small, np.repeat(start + size, size) - np.arange(1, len(variant) + 1), 0)  # rows of the same variant behind each
    rows = np.flatnonzero(later)
    upto = np.concatenate([[0], np.cumsum(later[rows])])
    done, all_ = 0, int(upto[-1])
    while done < all_:  # candidates by number
        stop = min(done + CANDIDATES, all_)
        first, last = np.searchsorted(upto, done, side="right") - 1, np.searchsorted(upto, stop, side="left")
        n = np.minimum(upto[first + 1 : last + 1], stop) - np.maximum(upto[first:last], done)
        i = np.repeat(rows[first:last], n)
        j = np.arange(done, stop) + np.repeat(rows[first:last] + 1 - upto[first:last], n)
        done = stop
        apart = np.bitwise_count(hi[i] ^ hi[j])
        found = np.flatnonzero(apart <= radius)
        yield kept(i[found], j[found], apart[found])


def _forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, member): the groups that the pairs of numbers make, each member but the least linked to the least."""
    if not len(i):
        return i, j
    low = min(i.min(), j.min())
    own = np.arange(max(i.max(), j.max()) - low + 1)
    root, i, j = own.copy(), i - low, j - low
    while True:
        x, y = root[i], root[j]
        open_ = np.flatnonzero(x != y)
        if not len(open_):
            member = np.flatnonzero(root != own)
            return root[member] + low, member + low
        i, j, x, y = i[open_], j[open_], x[open_], y[open_]
        root[np.maximum(x, y)] = np.minimum(x, y)  # of several, any
        while not np.array_equal(root, up := root[root]):
            root = up


def _pairs(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([pa.array(hi), pa.array(lo)], ["hi", "lo"]) for hi, lo in (a, b)], ["a", "b"])


def _collisions(batches: Iterator[pa.RecordBatch], radius: int, blocks: int, width: int, links: bool = False) -> Iterator[pa.RecordBatch]:
    """Near pairs among a task's rows (variant, hi, lo), all rows of a variant being there. ``links``: for each group of the task's
    near fingerprints each member but the least, with the least.

    A pair is told apart from its repeats on other variants where it is found. With ``links`` that is left out where a variant has more near pairs than rows: there its groups
    stand for them, wherever else the same pairs collide.
    """
    variant, hi, lo = (np.concatenate(x) for x in zip(*[[c.to_numpy() for c in batch.columns] for batch in batches] or [[np.zeros(0, np.int64)] * 3]))
    order = np.argsort(variant, kind="stable")
    variant, hi, lo = variant[order], hi[order], lo[order]
    linked, open_ = [], 0
    for i, j in _near(variant, hi, lo, radius):
        if links and len(i):
            _, which, n = np.unique(variant[i], return_inverse=True, return_counts=True)
            rows = np.searchsorted(variant, variant[i], "right") - np.searchsorted(variant, variant[i]) if n.max() > 1 else n[which]
            many = n[which] > rows
            if many.any():
                linked.append(_forest(i[many], j[many]))
                i, j = i[~many], j[~many]
        swap = (hi[i] > hi[j]) | ((hi[i] == hi[j]) & (lo[i] > lo[j]))
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        found = _met(variant[i], (hi[i], lo[i]), (hi[j], lo[j]), blocks, width)
        if links:
            linked.append((i[found], j[found]))
            open_ += sum(len(x[0]) for x in linked[-2:])
            if open_ > len(variant):  # a forest has fewer links than rows
                linked = [_forest(*(np.concatenate(x) for x in zip(*linked)))]
                open_ = 0
        elif found.any():
            i, j = i[found], j[found]
            yield _pairs((hi[i], lo[i]), (hi[j], lo[j]))
    if linked and len((rows := np.concatenate([x for pair in linked for x in pair]))):
        # Rows of one fingerprint are one: numbers in the order of fingerprints.
        rows = np.unique(rows)
        rows = rows[np.lexsort((lo[rows], hi[rows]))]
        new = np.append(True, (hi[rows[1:]] != hi[rows[:-1]]) | (lo[rows[1:]] != lo[rows[:-1]]))
        number = np.zeros(len(variant), np.int64)
        number[rows] = np.cumsum(new) - 1
        rows = rows[new]
        i, j = _forest(*(number[np.concatenate(x)] for x in zip(*linked)))
        yield _pairs((hi[rows[i]], lo[rows[i]]), (hi[rows[j]], lo[rows[j]]))
    release_memory()


def near_edges(prints: DataFrame, radius: int, blocks: int, width: int, links: bool = False) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints struct(hi, lo) within ``radius`` bits, each once. ``links``: pairs that make the same
    connected components, in a task fewer than its fingerprints, so that a large group isn't all pairs of its members.

    One shuffle, keyed by (block, variant), into tasks of about ``ROWS_PER_TASK`` rows, which compare the rows of a variant by
    arithmetic on whole arrays. A pair may collide on many variants; only one of them counts, which each task tells by itself.
    """
    distinct = prints.groupBy("hi", "lo").agg(F.first("block").alias("block"))
    tasks = max(prints.sparkSession.sparkContext.defaultParallelism, -(-prints.count() * blocks * (width + 1) // ROWS_PER_TASK))
    emitted = (
        distinct.select("hi", "lo", F.posexplode("block").alias("at", "value"))
        .select("hi", "lo", "at", "value", F.explode(F.sequence(F.lit(-1), F.lit(width - 1))).alias("flip"))
        .select(F.expr(f"shiftleft(cast(at as bigint), {width}) | (cast(value as bigint) ^ (case when flip < 0 then 0L else shiftleft(1L, flip) end))").alias("variant"), "hi", "lo")
        .repartition(tasks, "variant")
    )
    pair = "struct<hi:long,lo:long>"
    return emitted.mapInArrow(lambda batches: _collisions(batches, radius, blocks, width, links), f"a {pair}, b {pair}")


def near_groups(docs: DataFrame, blocks: int = BLOCKS, width: int = WIDTH, radius: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Members of near-duplicate groups: (doc_id, key, rows, keep_id, keep_key, keep).

    A group is a connected component of the near relation, equal fingerprints included; its
    kept document has the least doc_id (nulls last), then the least key. ``rows`` counts equal rows.

    Null texts, and texts of white space only, are in no group. Equal rows count as copies of each other. A text of any length is read
    whole; its worker holds its words and their counts. Columns other than doc_id and text aren't read.
    """
    radius = 3 * blocks - 1 if radius is None else radius
    if radius > 3 * blocks - 1:
        raise ValueError("the search is complete only up to 3 * blocks - 1 bits")
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    prints = scratch.write(with_fingerprints(docs, blocks, width), "prints")
    joined = components(near_edges(prints, radius, blocks, width, True), scratch)
    groups = joined.select(F.col("node.hi").alias("hi"), F.col("node.lo").alias("lo"), "component")
    rows = prints.groupBy("hi", "lo", "doc_id", "key").agg(F.count(F.lit(1)).alias("rows"))
    named = rows.join(groups, ["hi", "lo"], "left").withColumn("component", F.coalesce("component", F.struct("hi", "lo")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    kept = named.groupBy("component").agg(first.alias("first"), F.sum("rows").alias("size")).filter("size > 1")
    return named.join(kept, "component").select("doc_id", "key", "rows", F.col("first.doc_id").alias("keep_id"), F.col("first.key").alias("keep_key"), F.expr("doc_id <=> first.doc_id and key = first.key").alias("keep"))


def near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """The documents to remove, each with the one kept in its place: (doc_id, duplicate_of).

    One row for each input row that goes; equal rows of the kept document but the first go too.
    Clean documents, null and blank texts don't appear; an empty table gives no rows.
    """
    members = near_groups(docs, **parameters)
    gone = F.when(F.col("keep"), F.col("rows") - 1).otherwise(F.col("rows"))
    # Two steps, so that no array grows with the number of equal rows.
    many = members.withColumn("gone", gone).filter("gone > 0").select("doc_id", F.col("keep_id").alias("duplicate_of"), "gone", F.explode(F.expr(f"sequence(0L, (gone - 1) div {AT_ONCE})")).alias("k"))
    return many.select("doc_id", "duplicate_of", F.explode(F.expr(f"sequence(1L, least({AT_ONCE}L, gone - k * {AT_ONCE}L))")).alias("i")).drop("i")


def drop_near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` without near duplicates: of each group the document of least doc_id stays; all columns are kept, whatever their names.

    Documents outside any group, null and blank texts stay. Of equal (doc_id, text) rows that are kept, one stays.
    """
    scratch = Scratch(docs.sparkSession, "simhash-drop")
    members = scratch.write(near_groups(docs, scratch=scratch, **parameters).select(F.col("doc_id").alias("__vl_id"), F.col("key").alias("__vl_key"), F.when(F.col("keep"), F.col("rows")).otherwise(0).alias("__vl_rows")), "members")
    id_, key = F.col("doc_id").cast("long"), text_key(F.col("text"))
    changed = members.filter("__vl_rows <> 1")
    # A short list of what goes is broadcast, so that the texts stay where they are; a longer one is joined by a shuffle.
    beside = F.broadcast if changed.count() <= FEW_MEMBERS else (lambda df: df)
    out = docs.join(beside(changed), id_.eqNullSafe(F.col("__vl_id")) & (key == F.col("__vl_key")), "left")
    single = out.filter("__vl_rows is null").select(*[docs[c] for c in docs.columns])
    again = members.filter("__vl_rows > 1")
    if again.isEmpty():
        return single
    many = docs.join(beside(again), id_.eqNullSafe(F.col("__vl_id")) & (key == F.col("__vl_key")))
    one = many.withColumn("__vl_n", F.row_number().over(Window.partitionBy("__vl_id", "__vl_key").orderBy(F.lit(0)))).filter("__vl_n = 1")
    return single.unionByName(one.select(*docs.columns))


ORACLE_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, xxhash AS key, w, count(*) AS n FROM (
    SELECT doc_id, md5(text) AS xxhash, unnest(CASE WHEN len(ws) > 0 THEN ws ELSE [trim(low)] END) AS w
    FROM (SELECT doc_id, text, lower(text) AS low, list_filter(string_split_regex(lower(text), '[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+'), lambda x: x <> '') AS ws
          FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '\S')))
  GROUP BY ALL
), votes AS (
  SELECT doc_id, b.i, sum(round(8 * sqrt(n))::BIGINT * (CASE WHEN (('0x' || substr(h, 1 + b.i // 4, 1))::INT >> (3 - b.i % 4)) & 1 = 1 THEN 1 ELSE -1 END)) > 0 AS bit
  FROM (SELECT doc_id, n, md5(w) AS h FROM words), (SELECT unnest(range({BLOCKS * WIDTH}))::INT AS i) b GROUP BY ALL
), prints AS (
  SELECT doc_id, sum(CASE WHEN bit AND i < 62 THEN 1::BIGINT << i ELSE 0 END)::BIGINT AS hi, sum(CASE WHEN bit AND i >= 62 THEN 1::BIGINT << (i - 62) ELSE 0 END)::BIGINT AS lo
  FROM votes GROUP BY doc_id
), near AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM prints a, prints b
  WHERE a.doc_id <> b.doc_id AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= {RADIUS}
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM prints UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a
)
SELECT a AS doc_id, min(b) AS duplicate_of FROM reach GROUP BY a HAVING min(b) < a
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
