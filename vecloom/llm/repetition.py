"""Quality rules on repetition by suffix arrays.

The suffixes of a text are sorted by prefix doubling; an interval of the longest-common-prefix array whose value
is ``MIN_REPEAT`` or more is a maximal repeated substring. The spans of all its occurrences are
united. A text is kept while the spans cover at most ``MOST_COVERED`` of its characters and no
repeated substring is longer than ``MOST_REPEAT`` characters and ``MOST_REPEAT_SHARE`` of the text.

A suffix's longest repeat is the larger of the two values beside it in the array, so the union needs no list of
intervals. Only suffixes that share their first ``MIN_REPEAT`` characters with another are sorted further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import slices

MIN_REPEAT = 64
MOST_COVERED, MOST_REPEAT, MOST_REPEAT_SHARE = 0.5, 300, 0.15


def _first_keys(codes: np.ndarray, h: int, bits: int) -> np.ndarray:
    """The first ``h`` characters of every suffix as one integer; zeros follow the end."""
    padded = np.concatenate([codes, np.zeros(h, np.int64)])
    key, have = padded, 1
    while have * 2 <= h:
        key = (key << (bits * have)) + np.concatenate([key[have:], np.zeros(have, np.int64)])
        have *= 2
    return key[: len(codes)]


def repeated_order(codes: np.ndarray, alphabet: int, least: int) -> tuple[np.ndarray, int]:
    """(positions in suffix order, k): all positions whose first k characters occur elsewhere too; k is at most ``least``."""
    n = len(codes)
    bits = int(alphabet).bit_length()
    h = 8 if bits <= 7 else 4 if bits <= 15 else 2
    while h > least:
        h //= 2
    key = _first_keys(codes, h, bits)
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    ranked = key[order]
    new[1:] = ranked[1:] != ranked[:-1]
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = group, -1  # a suffix's rank: where its group begins
    end = np.append(new[1:], True)
    open_ = np.flatnonzero(~(new & end))  # places in the order that share their key with a neighbour
    settled, level = None, 0
    while len(open_):
        at = order[open_]
        if settled is None and 2 * h > least:
            settled, level = open_, h
        ahead = rank[np.minimum(at + h, n)]
        old = rank[at]
        turn = np.lexsort((ahead, old))
        at, old, ahead = at[turn], old[turn], ahead[turn]
        order[open_] = at  # groups keep their places: open_ ascends, as the old ranks do
        fresh = np.ones(len(at), bool)
        fresh[1:] = (old[1:] != old[:-1]) | (ahead[1:] != ahead[:-1])
        rank[at] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        last = np.append(fresh[1:], True)
        open_ = open_[~(fresh & last)]
        h *= 2
    return (np.zeros(0, np.int64), h) if settled is None else (order[settled], level)


def longest_repeats(text: str, least: int = MIN_REPEAT) -> tuple[np.ndarray, np.ndarray]:
    """(positions, length of the longest substring there that occurs elsewhere in the text, overlaps allowed), for lengths of ``least`` and more.

    Candidates lie in suffix order; the values between neighbours come from Kasai's pass in text order.
    """
    none = np.zeros(0, np.int64)
    if len(text) <= least:
        return none, none
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, codes = np.unique(points, return_inverse=True)
    order, level = repeated_order(codes.astype(np.int64) + 1, len(kinds) + 1, least)
    if len(order) < 2:
        return none, none
    n = len(text)
    where = np.argsort(order)  # text order of the candidates
    before = np.empty(len(order), np.int64)  # the neighbour that comes first in suffix order
    before[0] = -1
    before[1:] = order[:-1]
    shared = np.zeros(len(order) + 1, np.int64)  # shared[k]: common prefix of the candidates k - 1 and k
    value, last = 0, 0
    for k in where.tolist():
        i, j = int(order[k]), int(before[k])
        if j < 0:
            value, last = 0, i
            continue
        value -= i - last
        if value < level:  # what is left of the last value may be shared with a position that is no candidate
            value = 0
        last = i
        step = 64
        a, b = i + value, j + value
        while a < n and b < n:
            if text[a : a + step] == text[b : b + step] and a + step <= n and b + step <= n:
                a, b, step = a + step, b + step, step * 2
            elif step > 1:
                step //= 2
            elif text[a] == text[b]:
                a, b = a + 1, b + 1
            else:
                break
        value = a - i
        shared[k] = value
    long = np.maximum(shared[:-1], shared[1:])
    keep = long >= least
    return order[keep], long[keep]


def repetition(text: str, least: int = MIN_REPEAT) -> tuple[int, int]:
    """(characters covered by repeated substrings, length of the longest one)."""
    at, long = longest_repeats(text, least)
    if not len(at):
        return 0, 0
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + long, -1)
    return int((np.cumsum(change)[:-1] > 0).sum()), int(long.max())


def repetition_rules(docs: DataFrame, least: int = MIN_REPEAT, most_covered: float = MOST_COVERED, most_repeat: int = MOST_REPEAT, most_repeat_share: float = MOST_REPEAT_SHARE) -> DataFrame:
    """One row for each document: (doc_id, chars, repeated_chars, repeated_fraction, longest_repeat, keep).

    Null and empty texts have no repeats and are kept (null ones have null chars). No shuffle; a text is looked at alone, so equal rows
    get equal results. Other columns, whatever their names, aren't read; an empty table gives no rows. Of repeats of the same length any counts. A text of any
    length is looked at whole; its worker holds about a hundred bytes a character.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                texts = piece.column("text").to_pylist()
                found = np.array([repetition(t, least) if t else (0, 0) for t in texts], np.int64).reshape(-1, 2)
                chars = np.array([len(t) if t else 0 for t in texts], np.int64)
                share = found[:, 0] / np.maximum(chars, 1)
                keep = (share <= most_covered) & ((found[:, 1] <= most_repeat) | (found[:, 1] <= most_repeat_share * chars))
                null = np.array([t is None for t in texts], bool)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(chars, mask=null), pa.array(found[:, 0]), pa.array(share), pa.array(found[:, 1]), pa.array(keep)],
                    ["doc_id", "chars", "repeated_chars", "repeated_fraction", "longest_repeat", "keep"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, chars long, repeated_chars long, repeated_fraction double, longest_repeat long, keep boolean")


ORACLE_SQL = None  # longest repeats: tests/llm/test_repetition.py compares them with all pairs of positions


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
