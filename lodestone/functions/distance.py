"""Similarity functions as columns, in double precision; higher is better everywhere, so Euclidean distance counts negative."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidConfig

METRICS = ("cosine", "dot", "euclidean")


def metric_of(name: str) -> str:
    """dot or dot_product, euclidean or l2; everything else is cosine. Case doesn't count."""
    return {"dot": "dot", "dot_product": "dot", "euclidean": "euclidean", "l2": "euclidean"}.get((name or "").lower(), "cosine")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def magnitude(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    n = magnitude(a) * magnitude(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def squared_euclidean(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return _sum(F.transform(d, lambda x: x * x))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def score(a: Column, b: Column, metric: str = "cosine") -> Column:
    if metric not in METRICS:
        raise InvalidConfig(f"metric {metric!r}")
    return {"cosine": cosine, "dot": dot}[metric](a, b) if metric != "euclidean" else 0.0 - euclidean(a, b)


def score_query(v: Column, query: Sequence[float], metric: str = "cosine") -> Column:
    """score() against one known vector, whose length is computed once; vectors of another dimension score null."""
    q = [float(x) for x in query]
    lit = F.array(*map(F.lit, q)) if q else F.array().cast("array<double>")
    if metric == "cosine":
        n = math.sqrt(sum(x * x for x in q))
        out = F.lit(0.0) if n == 0 else F.when(magnitude(v) == 0, F.lit(0.0)).otherwise(dot(v, lit) / (magnitude(v) * n))
    else:
        out = score(v, lit, metric)
    return F.when(F.size(v) == len(q), out)


def dot_i8(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def score_i8(q: Column, d: Column, metric: str = "cosine") -> Column:
    """Codes against codes: the raw dot product, or the negative squared distance without a root."""
    if metric != "euclidean":
        return dot_i8(q, d).cast("double")
    e = F.zip_with(q, d, lambda x, y: (x.cast("long") - y.cast("long")) * (x.cast("long") - y.cast("long")))
    return -F.aggregate(e, F.lit(0).cast("long"), lambda s, x: s + x).cast("double")


def scores(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """queries x vectors, in double precision; the kernel of the Arrow functions."""
    q, v = queries.astype(np.float64), vectors.astype(np.float64)
    if metric == "dot":
        return q @ v.T
    if metric == "cosine":
        n = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))[None, :]
        return np.divide(q @ v.T, n, out=np.zeros_like(n), where=n > 0)
    d = (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * (q @ v.T)
    return 0.0 - np.sqrt(np.maximum(d, 0))
