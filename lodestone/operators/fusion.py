"""Reciprocal-rank fusion, reranking, and the hybrid pipelines made of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import FeatureNotAvailable
from .base import CrossEncoder
from .bm25 import Bm25
from .search import exact_topk

RANK_CONSTANT = 60


def rrf(lists: Sequence[DataFrame], k: int, constant: int = RANK_CONSTANT) -> DataFrame:
    """lists: doc_id, score, each already cut to its best. doc_id, score: sums of 1 / (constant + rank); repeats within a list add up."""
    order = Window.orderBy(F.desc("score"), "doc_id")  # over lists of a limited length
    parts = [x.select("doc_id", (1.0 / (constant + F.row_number().over(order))).alias("part")) for x in lists]
    fused = reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg(F.sum("part").alias("score"))
    return fused.orderBy(F.desc("score"), "doc_id").limit(max(0, k))


class Reranker:
    """Gives a list new scores; the base class leaves them."""

    def scored(self, query: str, rows: DataFrame, text: str = "text") -> DataFrame:
        return rows.withColumn("rerank_score", F.col("score"))


class LengthReranker(Reranker):
    """Stand-in for a cross-encoder: shorter texts score higher, between 0.3 and 1."""

    def scored(self, query: str, rows: DataFrame, text: str = "text") -> DataFrame:
        return rows.withColumn("rerank_score", length_score(F.col(text)))


def length_score(text: Column) -> Column:
    n = F.octet_length(text)
    longest = F.greatest(F.max(n).over(Window.partitionBy(F.lit(0))), F.lit(1))  # over a list of a limited length
    return 1 - 0.7 * n / longest


def length_scores(rows: DataFrame, text: str = "text") -> DataFrame:
    """The same for a table of any length: the longest is found by an aggregate."""
    longest = rows.agg(F.greatest(F.max(F.octet_length(text)), F.lit(1)).alias("_longest"))
    return rows.crossJoin(F.broadcast(longest)).withColumn("rerank_score", 1 - 0.7 * F.octet_length(text) / F.col("_longest")).drop("_longest")


class CrossReranker(Reranker):
    """Scores pairs of query and text by a cross-encoder, over Arrow batches."""

    def __init__(self, encoder: CrossEncoder):
        self.encoder = encoder

    def scored(self, query: str, rows: DataFrame, text: str = "text") -> DataFrame:
        encoder = self.encoder

        @F.arrow_udf("double")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                yield pa.array([float(x) for x in encoder.scores(query, [t or "" for t in texts.to_pylist()])], pa.float64())

        return rows.withColumn("rerank_score", run(F.col(text)))


class OnnxCrossEncoder(CrossEncoder):
    """A cross-encoder in ONNX form with its tokenizer file: pairs padded to max_length, the first logit is the score. Model and tokenizer are opened where they are first used; both packages are optional."""

    def __init__(self, model: str, tokenizer: str, max_length: int = 512):
        try:
            import onnxruntime  # noqa: F401
            import tokenizers  # noqa: F401
        except ImportError as x:
            raise FeatureNotAvailable(f"cross-encoder: {x.name} is not installed") from x
        self.model, self.tokenizer, self.max_length = model, tokenizer, max_length

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_open"}

    def scores(self, query: str, texts: list[str]) -> list[float]:
        if not texts:
            return []
        if "_open" not in self.__dict__:
            import onnxruntime
            import tokenizers

            tok = tokenizers.Tokenizer.from_file(self.tokenizer)
            tok.enable_truncation(self.max_length)
            tok.enable_padding(length=self.max_length)
            self._open = onnxruntime.InferenceSession(self.model, providers=["CPUExecutionProvider"]), tok
        session, tok = self._open
        encoded = tok.encode_batch([(query, t) for t in texts])
        given = {"input_ids": [e.ids for e in encoded], "attention_mask": [e.attention_mask for e in encoded], "token_type_ids": [e.type_ids for e in encoded]}
        names = {i.name for i in session.get_inputs()}
        return [float(r[0]) for r in session.run(None, {k: np.array(v, np.int64) for k, v in given.items() if k in names})[0]]


@dataclass(frozen=True)
class Profile:
    bm25: bool
    rerank: bool
    multiplier: int


PROFILES = {"precision": Profile(True, True, 5), "production": Profile(True, True, 3), "maxspeed": Profile(False, False, 2)}


def hybrid(docs: DataFrame, query: Sequence[float], text_query: str, k: int = 10, profile: str = "production", reranker: Reranker | None = None, bm25: Bm25 | None = None, metric: str = "cosine", id_col: str = "id", text: str = "text", vectors: Callable[[int], DataFrame] | None = None) -> DataFrame:
    """The k best rows of docs with score, and rerank_score if reranked. Vector and keyword lists of k times the profile's multiplier are fused to 2k;
    without a keyword hit the vector list counts with its own scores. vectors: from a number to so many best (doc_id, score) of an index; without it the search is exact."""
    p, k = PROFILES[profile], max(1, k)
    fetch = k * p.multiplier
    near = vectors(fetch) if vectors is not None else exact_topk(docs, query, fetch, metric, id_col=id_col).select(F.col(id_col).alias("doc_id"), "score")
    found = near.orderBy(F.desc("score"), "doc_id").limit(2 * k)
    if p.bm25:
        words = (bm25 or Bm25(docs, id_col, text)).search(text_query, fetch)
        if not words.isEmpty():
            found = rrf([near, words], 2 * k)
    rows = docs.join(F.broadcast(found.withColumnRenamed("doc_id", "_found")), F.col(id_col) == F.col("_found")).drop("_found")  # at most 2k
    if p.rerank and reranker is not None:
        rows = reranker.scored(text_query, rows, text)
        return rows.orderBy(F.desc("rerank_score"), F.desc("score"), id_col).limit(k)
    return rows.orderBy(F.desc("score"), id_col).limit(k)
