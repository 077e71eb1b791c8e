"""Models that rank: a small network, pairwise linear weights, boosted trees. The first two are fitted on the driver to a bounded sample of labelled rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted to: those of least hash of their id.
SAMPLE = 2000


def sample(rows: DataFrame, key: str, features: list[str], target: str, n: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(features, target) of at most ``n`` rows."""
    found = rows.filter(F.col(target).isNotNull()).orderBy(F.xxhash64(key), key).limit(n).select(*[F.col(c).cast("double") for c in [*features, target]]).collect()
    m = np.array(found, float).reshape(-1, len(features) + 1)
    return m[:, :-1], m[:, -1]


def _standard(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, scale), 0 and 1 where there are no rows."""
    if not len(x):
        return np.zeros(x.shape[1]), np.ones(x.shape[1])
    return x.mean(axis=0), x.std(axis=0) + 1e-8


def fit_mlp(x: np.ndarray, y: np.ndarray, hidden: int = 16, rounds: int = 200, rate: float = 0.05, seed: int = 42) -> Callable[[np.ndarray], np.ndarray]:
    """One layer of ``hidden`` tanh units under the squared loss, by gradient descent on all rows of the sample."""
    mean, scale = _standard(x)
    rng = np.random.default_rng(seed)
    into, bias, out, base = rng.normal(0, 0.1, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.1, hidden), float(y.mean()) if len(y) else 0.0
    z = (x - mean) / scale
    for _ in range(rounds if len(y) else 0):
        h = np.tanh(z @ into + bias)
        miss = h @ out + base - y
        back = np.outer(miss, out) * (1 - h * h)
        out -= rate * h.T @ miss / len(y)
        base -= rate * miss.mean()
        into -= rate * z.T @ back / len(y)
        bias -= rate * back.mean(axis=0)
    return lambda v: np.tanh((v - mean) / scale @ into + bias) @ out + base


def fit_pairwise(x: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.2) -> Callable[[np.ndarray], np.ndarray]:
    """Linear weights under the logistic loss of all pairs of different target. Targets take few values, so a round goes through pairs of values."""
    mean, scale = _standard(x)
    z, w = (x - mean) / scale, np.zeros(x.shape[1])
    groups = [z[y == v] for v in np.unique(y)]
    for _ in range(rounds):
        grad, n = np.zeros_like(w), 0
        for i, low in enumerate(groups):
            for high in groups[i + 1 :]:
                p = 1 / (1 + np.exp((high @ w)[:, None] - (low @ w)))  # how wrong each pair is
                grad += p.sum(axis=1) @ high - p.sum(axis=0) @ low
                n += p.size
        w += rate * grad / max(n, 1)
    return lambda v: (v - mean) / scale @ w


def scored(rows: DataFrame, model: Callable[[np.ndarray], np.ndarray], key: str, features: list[str]) -> DataFrame:
    """(key, score) of every row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "score": model(frame[features].to_numpy(float))})

    return rows.select(F.col(key).cast("long").alias(key), *[F.col(c).cast("double").alias(c) for c in features]).mapInPandas(run, f"`{key}` long, score double")


def boosted_trees(rows: DataFrame, key: str, features: list[str], target: str, trees: int = 5, depth: int = 3, seed: int = 7) -> DataFrame:
    """(key, score) by gradient-boosted regression trees."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    made = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(rows.select(key, *[F.col(c).cast("double").alias(c) for c in features], F.col(target).alias("label")))
    model = GBTRegressor(maxIter=trees, maxDepth=depth, seed=seed).fit(made.filter("label is not null"))
    return model.transform(made).select(key, F.col("prediction").alias("score"))
