"""Scalar quantization to signed bytes: fit by dimension, encode, search on codes, rescore exactly."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distance import score_i8, score_query
from .search import FOUND, Nearest, batch_knn, groups_of, streamed, vector_blocks


@dataclass(frozen=True)
class Scalar:
    scales: tuple[float, ...]
    biases: tuple[float, ...]

    def encode(self, v: Column) -> Column:
        """clamp(round((x - bias) / scale)), half away from zero, as bytes."""
        s, b = F.array(*map(F.lit, self.scales)), F.array(*map(F.lit, self.biases))
        code = F.zip_with(F.zip_with(v, b, lambda x, y: x.cast("double") - y), s, lambda x, y: F.least(F.lit(127.0), F.greatest(F.lit(-128.0), F.round(x / y))))
        return F.transform(code, lambda x: x.cast("tinyint"))

    def encode_query(self, q: Sequence[float]) -> list[int]:
        def away(x: float) -> int:
            return int(math.copysign(math.floor(abs(x) + 0.5), x))

        return [max(-128, min(127, away((x - b) / s))) for x, s, b in zip(q, self.scales, self.biases)]


def dimension_stats(docs: DataFrame, vector: str = "embedding") -> DataFrame:
    """dim, lo, hi: least and greatest value by dimension; map-side combined, so one row a dimension and partition is shuffled."""
    x = docs.where(F.size(vector) > 0).select(F.posexplode(vector).alias("dim", "x"))
    return x.groupBy("dim").agg(F.min("x").cast("double").alias("lo"), F.max("x").cast("double").alias("hi"))


def sq_table(docs: DataFrame, vector: str = "embedding") -> DataFrame:
    """dim, scale, bias."""
    flat = F.col("hi") == F.col("lo")
    return dimension_stats(docs, vector).select("dim", F.when(flat, 1.0).otherwise((F.col("hi") - F.col("lo")) / 255.0).alias("scale"), ((F.col("hi") + F.col("lo")) / 2).alias("bias"))


def fit(docs: DataFrame, vector: str = "embedding") -> Scalar:
    rows = sq_table(docs, vector).orderBy("dim").collect()  # one row a dimension
    return Scalar(tuple(r["scale"] for r in rows), tuple(r["bias"] for r in rows))


def sq_topk(docs: DataFrame, query: Sequence[float], k: int, sq: Scalar, metric: str = "cosine", id_col: str = "id", vector: str = "embedding") -> DataFrame:
    q = F.array(*(F.lit(x).cast("tinyint") for x in sq.encode_query(query)))
    rows = docs.where(F.size(vector) == len(query)).withColumn("score", score_i8(q, sq.encode(F.col(vector)), metric))
    return rows.orderBy(F.desc("score"), id_col).limit(max(0, k))


def sq_rescored(docs: DataFrame, query: Sequence[float], k: int, sq: Scalar, metric: str = "cosine", id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """The best 2k by codes, of them the best k by exact scores."""
    top = sq_topk(docs, query, 2 * k, sq, metric, id_col, vector)
    return top.withColumn("score", score_query(F.col(vector), query, metric)).orderBy(F.desc("score"), id_col).limit(max(0, k))


def sq_batch(queries: DataFrame, docs: DataFrame, k: int, sq: Scalar, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """queries: query_id, embedding. query_id, doc_id, score, rank: for every query the best k by the dot products of codes, which are exact in double precision."""
    codes = lambda v: sq.encode(F.col(v)).cast("array<float>")
    asked = queries.where(F.size("embedding") == len(sq.scales)).select("query_id", codes("embedding").alias("embedding"))
    rows = docs.where(F.size(vector) == len(sq.scales)).select(F.col(id_col).alias("id"), codes(vector).alias("embedding"))
    return batch_knn(asked, rows, k, "dot")


def sq_rescored_batch(queries: DataFrame, docs: DataFrame, k: int, sq: Scalar, metric: str = "cosine", id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """For every query the best 2k by codes, of them the best k by exact scores; vectors travel with their codes, so that a task that finds a pair scores it too."""
    codes = lambda v: sq.encode(F.col(v)).cast("array<float>").alias("codes")
    asked = queries.where(F.size("embedding") == len(sq.scales)).select("query_id", "embedding", codes("embedding"))
    rows = docs.where(F.size(vector) == len(sq.scales)).select(F.col(id_col).alias("id"), F.col(vector).alias("embedding"), codes(vector))
    groups = groups_of(docs.sparkSession, queries.count(), 2 * k)
    return streamed(vector_blocks(asked, "query_id", "codes", groups, "embedding"), vector_blocks(rows, "id", "codes", 0, "embedding"), groups, lambda: Nearest(2 * k, "dot", rescore=(k, metric)), FOUND)
