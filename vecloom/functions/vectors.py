"""Distances and vector arithmetic as Column expressions; they compute in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where either norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """cosine (1 - similarity), euclidean, dot (negated product), or unit (1 - product, for unit vectors)."""
    if metric == "cosine":
        return 1 - cosine_similarity(a, b)
    if metric == "euclidean":
        return euclidean(a, b)
    if metric == "dot":
        return -dot(a, b)
    if metric == "unit":
        return 1 - dot(a, b)
    raise ValueError(f"unknown metric: {metric}")


def normalized(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    size = norm(a)
    return F.when(size == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / size))


def blend(a: Column, b: Column, share: float) -> Column:
    """(1 - share) a + share b at unit length."""
    return normalized(F.zip_with(a, b, lambda x, y: x.cast("double") * (1 - share) + y.cast("double") * share))


def maxsim(query: Column, document: Column) -> Column:
    """Late interaction: for each query vector its largest product with a document vector, summed."""
    return F.aggregate(F.transform(query, lambda q: F.array_max(F.transform(document, lambda d: dot(q, d)))), F.lit(0.0), lambda s, x: s + x)


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ between two codes of ``sign_code``."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def sign_code(a: Column) -> Column:
    """The signs of all dimensions as 64-bit numbers: bit i % 64 of number i // 64 is set where dimension i is positive."""
    bit = lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    word = lambda i: F.aggregate(F.transform(F.slice(a, i, F.lit(64)), bit), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
    return F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(1), F.size(a), F.lit(64)), word)).otherwise(F.array().cast("array<bigint>"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    return 2 * 6371 * F.asin(F.sqrt(F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)))
