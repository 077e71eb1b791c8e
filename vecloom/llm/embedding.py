"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with a cosine of at least ``LEAST_COSINE`` lie within a squared distance of r² = 2 (1 - cosine). After a
fixed random rotation, which spreads the variance evenly, a vector is split into blocks of ``BLOCK`` dimensions, each
with a share of r² in proportion to its dimensions; at least one block of a near pair keeps to its share. So each
block is range-joined under its own budget. A cell is a pattern of signs of the block's first dimensions, of which there are the more
the more vectors there are; one side goes to its own cell, the other to every cell that its ball touches. What a cell gets
is packed, a byte a dimension with a bound on the error, and compared by matrix products: first the block under its budget, then the
whole vector. Pairs that the error leaves open are verified on the exact vectors. The search is complete: no pair is left out or capped.

Cells with many rows are split into pieces of bounded size, and every piece of one side meets every piece of the other in a task of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import Scratch, components

LEAST_COSINE, BLOCK, SEED = 0.95, 8, 20240607
#: Rows that a cell of evenly spread vectors has, and the most own and other rows that one task compares.
CELL_ROWS, OWN_ROWS, BALL_ROWS = 1600, 4096, 65_536
SLOTS = 1 << 16


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """An orthogonal matrix that depends on the dimension and the seed alone."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def block_bounds(dim: int, block: int) -> list[tuple[int, int]]:
    """Blocks of at most ``block`` dimensions, as even as possible."""
    n = -(-dim // block)
    cuts = [dim * k // n for k in range(n + 1)]
    return list(zip(cuts, cuts[1:]))


def unit_rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors) of a batch, by dimension; null, empty, zero and non-finite vectors are left out."""
    column = batch.column("v")
    sizes = np.nan_to_num(np.asarray(pc.list_value_length(column).to_numpy(zero_copy_only=False), dtype=float)).astype(np.int64)
    for dim in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == dim)
        flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        m = flat.reshape(-1, dim)
        with np.errstate(all="ignore"):
            m = m / np.abs(m).max(axis=1, keepdims=True)
            m = m / np.linalg.norm(m, axis=1, keepdims=True)
        fine = np.isfinite(m).all(axis=1)
        yield rows[fine], m[fine]


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of rows of integers."""
    h = np.full(len(columns[0]), 0x9E3779B97F4A7C15, np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            h = (h ^ c.astype(np.int64).view(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
    return h.view(np.int64)


def squared_radius(least_cosine: float) -> float:
    """The squared distance of unit vectors with that cosine, with room for rounding."""
    return 2 * (1 - least_cosine) * (1 + 1e-9) + 1e-12


def record_type(dim: int) -> np.dtype:
    """A packed vector: its id, and the rotated vector as x * scale with an error of at most ``error``."""
    return np.dtype([("id", "<i8"), ("scale", "<f4"), ("error", "<f4"), ("x", "i1", (dim,))])


def records(ids: np.ndarray, turned: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ids), record_type(turned.shape[1]))
    out["id"], out["scale"] = ids, np.abs(turned).max(axis=1) / 127
    scale = out["scale"].astype(np.float64)[:, None]
    out["x"] = np.rint(turned / scale)
    error = np.linalg.norm(turned - out["x"] * scale, axis=1)
    out["error"] = np.nextafter(error.astype(np.float32), np.float32(np.inf))
    return out


def touched(part: np.ndarray, budget: float, bits: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """(ball, row, cell) of a block's values: the own cells, then all that the balls touch. A cell is a pattern of signs of the first ``bits`` dimensions."""
    part = part[:, :bits]
    width = part.shape[1]
    own = (part >= 0).astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))
    yield False, np.arange(len(part)), own
    flips = np.arange(1 << width)
    pattern = ((flips[:, None] >> np.arange(width)) & 1).astype(np.float64)
    who, flip = np.nonzero(part**2 @ pattern.T <= budget)
    yield True, who, own[who] ^ flips[flip]


def key_bits(rows: int) -> int:
    """Signs in a cell's key, so that a cell of evenly spread vectors has about ``CELL_ROWS`` rows; 8 at most."""
    return min(max(1, round(math.log2(max(rows, 1) / CELL_ROWS))), 8)


def _blocks(batches: Iterator[pa.RecordBatch], square: float, block: int, bits: int):
    """(ids, rotated vectors, block number, its budget, its cells) of the batches, block by block."""
    for whole in batches:
        for a in range(0, whole.num_rows, 8192):
            batch = whole.slice(a, 8192)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for rows, unit in unit_rows(batch):
                dim = unit.shape[1]
                turned = unit @ rotation(dim)
                packed = records(ids[rows], turned)
                for k, (lo, hi) in enumerate(block_bounds(dim, block)):
                    for ball, who, cell in touched(turned[:, lo:hi], square * (hi - lo) / dim, bits):
                        yield dim, packed, k, ball, who, cell


def _slot(dim: int, block: np.ndarray | int, cell: np.ndarray) -> np.ndarray:
    """Where a cell is counted: one of ``SLOTS`` places, so that the table of counts has a fixed size."""
    return _mixed([np.full(len(cell), dim), np.full(len(cell), block), cell]) & (SLOTS - 1)


def piece_counts(vectors: DataFrame, square: float, block: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each slot into how many pieces its own rows, and the rows whose balls touch it, are split: at most ``SLOTS`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, SLOTS), np.int64)
        for dim, _, k, ball, _, cell in _blocks(batches, square, block, bits):
            count[int(ball)] += np.bincount(_slot(dim, k, cell), minlength=SLOTS)
        ball, slot = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(ball), pa.array(slot), pa.array(count[ball, slot])], ["ball", "slot", "n"])

    found = vectors.select("id", "v").mapInArrow(run, "ball long, slot long, n long").groupBy("ball", "slot").agg(F.sum("n").alias("n")).collect()
    pieces = np.ones((2, SLOTS), np.int64)
    for ball, slot, n in found:
        pieces[ball, slot] = -(-n // (BALL_ROWS if ball else OWN_ROWS))
    return pieces[0], pieces[1]


def cells(vectors: DataFrame, square: float, block: int, bits: int, own_pieces: np.ndarray, ball_pieces: np.ndarray) -> DataFrame:
    """(dim, block, cell, i, j, ball, rows): packed vectors by the cell of a block, from which one task gets piece i of the own rows and piece j of the others."""
    sent = vectors.sparkSession.sparkContext.broadcast((own_pieces, ball_pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = sent.value
        for dim, packed, k, ball, who, cell in _blocks(batches, square, block, bits):
            slot = _slot(dim, k, cell)
            mine, others = split[int(ball)][slot], split[1 - int(ball)][slot]
            piece = _mixed([packed["id"][who]]).view(np.uint64) % mine.astype(np.uint64)
            again = np.repeat(np.arange(len(who)), others)
            copy = np.arange(len(again)) - np.repeat(np.cumsum(others) - others, others)
            who, cell, piece = who[again], cell[again], piece[again].astype(np.int64)
            i, j = (copy, piece) if ball else (piece, copy)
            order = np.lexsort((j, i, cell))
            who, cell, i, j = who[order], cell[order], i[order], j[order]
            first = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])) if len(who) else np.zeros(0, np.int64)
            rows = packed[who]
            offsets = np.append(first, len(rows)) * rows.dtype.itemsize
            n = len(first)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, dim)), pa.array(np.full(n, k)), pa.array(cell[first]), pa.array(i[first]), pa.array(j[first]), pa.array(np.full(n, ball)),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(rows)]),
                ],
                ["dim", "block", "cell", "i", "j", "ball", "rows"],
            )

    return vectors.select("id", "v").mapInArrow(run, "dim long, block long, cell long, i long, j long, ball boolean, rows binary")


class Forest:
    """Components of nodes 0 .. n - 1; keeps of the edges it is given only those that join two components."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The positions of the edges that were needed."""
        left, kept = np.arange(len(a)), []
        while len(left):
            u, v = self.root[a[left]], self.root[b[left]]
            apart = u != v
            left, u, v = left[apart], u[apart], v[apart]
            if not len(left):
                break
            high, at = np.unique(np.maximum(u, v), return_index=True)
            kept.append(left[at])
            self.root[high] = np.minimum(u, v)[at]
            while True:
                ahead = self.root[self.root]
                if (ahead == self.root).all():
                    break
                self.root = ahead
        return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def _lengths(a: np.ndarray, b: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of the rows a[r] and b[c] in double precision: by a matrix product where they fill a good part of one."""
    rows, r_at = np.unique(r, return_inverse=True)
    cols, c_at = np.unique(c, return_inverse=True)
    value = lambda x: x["x"].astype(np.float64) * x["scale"].astype(np.float64)[:, None]
    if len(rows) * len(cols) <= 16 * len(r):
        p, q = value(a[rows]), value(b[cols])
        square = (p * p).sum(1)[:, None] + (q * q).sum(1) - 2 * p @ q.T
        return np.sqrt(np.maximum(square[r_at, c_at], 0))
    return np.concatenate([np.linalg.norm(value(a[r[k : k + 50_000]]) - value(b[c[k : k + 50_000]]), axis=1) for k in range(0, len(r), 50_000)])


def _above(left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Where left @ right.T is ``least`` or more. The product is made in tiles that stay in the processor's cache, and their marks are looked through eight at a time."""
    high, wide = 128, 512
    product, mark = np.empty((high, wide), np.float32), np.empty((high, wide), bool)
    found, width = [np.zeros((2, 0), np.int64)], right.shape[1]
    for b in range(0, len(right), wide):
        some = right[b : b + wide]
        turned = np.zeros((width, wide), np.float32)
        turned[:, : len(some)] = some.T
        for a in range(0, len(left), high):
            n = min(high, len(left) - a)
            np.greater_equal(np.matmul(left[a : a + n], turned, out=product[:n]), np.float32(least), out=mark[:n])
            mark[:n, len(some) :] = False
            words = np.flatnonzero(mark[:n].ravel().view(np.uint64))
            if len(words):
                at, bit = np.nonzero(mark[:n].reshape(-1, 8)[words])
                r, c = np.divmod(words[at] * 8 + bit, wide)
                found.append(np.stack([r + a, c + b]))
    r, c = np.concatenate(found, axis=1)
    return r, c


def joined(own: np.ndarray, ball: np.ndarray, lo: int, hi: int, square: float, forest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sure): the near pairs of two sets of packed vectors whose block lo .. hi keeps to its budget, id a < id b.

    ``sure``: the distance is within the radius whatever the packing's error; the others have to be verified. With ``forest`` only
    pairs that join two components, sure ones first; the components are the same.
    """
    dim = own["x"].shape[1]
    part = lambda x: x["x"][:, lo:hi].astype(np.float32) * x["scale"][:, None]
    names, at = np.unique(np.concatenate([own["id"], ball["id"]]), return_inverse=True)
    own_at, ball_at = at[: len(own)], at[len(own) :]
    trees, none = Forest(len(names)), np.zeros(0, np.int64)
    p = part(own)
    left = np.column_stack([p, -(p * p).sum(1) / 2, np.ones(len(p), np.float32)])
    most = (square * (hi - lo) / dim) ** 0.5
    a_out, b_out, sure_out, open_a, open_b = [none], [none], [np.zeros(0, bool)], [none], [none]
    for k in range(0, len(ball), 4096):
        some, some_at = ball[k : k + 4096], ball_at[k : k + 4096]
        q = part(some)
        reach = most + float(own["error"].max()) + float(some["error"].max()) + 1e-4
        right = np.column_stack([q, np.ones(len(q), np.float32), -(q * q).sum(1) / 2])
        r, c = _above(left, right, -reach * reach / 2)
        ordered = own["id"][r] < some["id"][c]
        r, c = r[ordered], c[ordered]
        if not len(r):
            continue
        d = _lengths(own, some, r, c)
        slack = own["error"][r].astype(np.float64) + some["error"][c] + 1e-6
        sure, maybe = d + slack <= square**0.5, d - slack <= square**0.5
        u, v = own_at[r], some_at[c]
        maybe &= ~sure
        keep = np.flatnonzero(sure)
        if forest:
            keep = keep[trees.add(u[keep], v[keep])]
        a_out.append(u[keep])
        b_out.append(v[keep])
        sure_out.append(np.ones(len(keep), bool))
        if forest:
            maybe &= trees.root[u] != trees.root[v]
        open_a.append(u[maybe])
        open_b.append(v[maybe])
    u, v = np.concatenate(open_a), np.concatenate(open_b)
    apart = trees.root[u] != trees.root[v] if forest else np.ones(len(u), bool)
    a, b = np.concatenate([*a_out, u[apart]]), np.concatenate([*b_out, v[apart]])
    return names[a], names[b], np.concatenate([*sure_out, np.zeros(int(apart.sum()), bool)])


def near_pairs(vectors: DataFrame, least_cosine: float = LEAST_COSINE, block: int = BLOCK, scratch: Scratch | None = None, forest: bool = False, rows: int | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of vectors(id, v) with a cosine of at least ``least_cosine``, each once. ``forest``: in every task only
    pairs that join two components, so that a large group of near vectors isn't expanded into all its pairs; the components are those of all pairs."""
    scratch = scratch or Scratch(vectors.sparkSession, "embedding")
    square = squared_radius(least_cosine)
    bits = key_bits(vectors.count() if rows is None else rows)
    packed = cells(vectors, square, block, bits, *piece_counts(vectors, square, block, bits))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        dim, k = key[0].as_py(), key[1].as_py()
        side = group.column("ball").to_numpy()
        data = group.column("rows").to_pylist()
        own, ball = (np.frombuffer(b"".join([x for x, s in zip(data, side) if s == want]), record_type(dim)) for want in (False, True))
        lo, hi = block_bounds(dim, block)[k]
        a, b, sure = joined(own, ball, lo, hi, square, forest) if len(own) and len(ball) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "sure": pa.array(sure, pa.bool_())})

    found = packed.groupBy("dim", "block", "cell", "i", "j").applyInArrow(run, "a long, b long, sure boolean")
    found = scratch.write(found, "candidates").groupBy("a", "b").agg(F.bool_or("sure").alias("sure"))
    sides = [vectors.select(F.col("id").alias(x), F.col("v").alias(f"v{x}")) for x in "ab"]
    dot, norm = "aggregate(zip_with({0}, {1}, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x)", "sqrt({})"
    cosine = f"{dot.format('va', 'vb')} / ({norm.format(dot.format('va', 'va'))} * {norm.format(dot.format('vb', 'vb'))})"
    maybe = found.filter("not sure").select("a", "b")
    verified = maybe.join(sides[0], "a").join(sides[1], "b").filter(F.expr(f"size(va) = size(vb) and {cosine} >= {least_cosine!r}")).select("a", "b")
    sure = found.filter("sure").select("a", "b")
    return sure if maybe.isEmpty() else sure.unionByName(verified)


def near_duplicates(table: DataFrame, id_column: str = "vec_id", column: str = "embedding", **parameters) -> DataFrame:
    """The vectors to remove, each with the one kept in its place: (vec_id, duplicate_of).

    Groups are connected components of the near relation, the least id of each being kept. Null, empty and zero vectors and those with
    values that aren't finite are in no group; vectors of different lengths are never near. Equal vectors form one
    vector in the search. Rows with the same id and the same vector give one row, and only if another id is kept.
    An id that has several vectors stands for all of them. A null id takes no part. An empty table gives no rows; extra columns aren't read.
    """
    scratch = Scratch(table.sparkSession, "embedding")
    rows = table.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{column}`").cast("array<double>").alias("v")).filter("id is not null and size(v) > 0 and exists(v, x -> x <> 0) and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    # -0.0 and 0.0 are one value; a vector is represented by its least id.
    rows = scratch.write(rows.withColumn("v", F.expr("transform(v, x -> x + 0D)")), "rows")
    named = scratch.write(rows.groupBy("v").agg(F.min("id").alias("id"), F.max("id").alias("last")), "distinct")
    many = named.filter("id <> last").select("v", F.col("id").alias("b"))
    same = rows.join(many, "v").filter("id <> b").select(F.col("id").alias("a"), "b")
    near = near_pairs(named.select("id", "v"), scratch=scratch, forest=True, **parameters)
    whole = components(same.unionByName(near), scratch)
    return whole.filter("node <> component").select(F.col("node").alias(id_column), F.col("component").alias("duplicate_of"))


def classes(table: DataFrame, id_column: str = "vec_id", column: str = "embedding", **parameters) -> DataFrame:
    """One row for each id that isn't null: (vec_id, class_id, members), the class being named by its least id.

    An id in no group of ``near_duplicates`` is a class of its own. Pairs aren't listed: a class of n vectors is n rows.
    """
    ids = table.select(F.col(f"`{id_column}`").cast("long").alias(id_column)).filter(F.col(id_column).isNotNull()).distinct()
    found = near_duplicates(table, id_column, column, **parameters)
    named = ids.join(found, id_column, "left").select(id_column, F.coalesce("duplicate_of", id_column).alias("class_id"))
    sizes = found.groupBy(F.col("duplicate_of").alias("class_id")).agg((F.count(F.lit(1)) + 1).alias("members"))
    return named.join(sizes, "class_id", "left").select(id_column, "class_id", F.coalesce("members", F.lit(1)).cast("long").alias("members"))


ORACLE_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0
), near AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {LEAST_COSINE}
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings WHERE vec_id IS NOT NULL UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a
), class AS (
  SELECT a AS vec_id, min(b) AS class_id FROM reach GROUP BY a
)
SELECT vec_id, class_id, count(*) OVER (PARTITION BY class_id) AS members FROM class
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
