"""The collection's operations as functions of plain values, for tool servers and the command line."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.filters import preview
from .operators.fusion import Reranker
from .schema import Document
from .sources.collection import Collection


def query(c: Collection, vector: list[float], k: int = 10, text: str | None = None, reranker: Reranker | None = None) -> list[dict]:
    """With a text and a reranker, 5k are fetched, reranked and cut to k."""
    if text is not None and reranker is not None:
        rows = reranker.scored(text, c.search(vector, 5 * k)).orderBy(F.desc("rerank_score"), "pos").limit(k)
    else:
        rows = c.search(vector, k)
    return [r.asDict() for r in rows.select("id", "score", preview(F.col("text"), 200, 197).alias("text"), "metadata").collect()]


def ingest(c: Collection, docs: list[dict]) -> dict:
    c.insert([Document(d["id"], d.get("text", ""), d.get("embedding") or [], d.get("metadata") or {}) for d in docs])
    return {"inserted": len(docs), "total": len(c)}


def delete(c: Collection, ids: list[str]) -> dict:
    return {"deleted": c.delete(ids)}


def listing(c: Collection, limit: int = 100, offset: int = 0) -> list[dict]:
    rows = c.documents().orderBy("pos").offset(offset).limit(limit)
    return [r.asDict() for r in rows.select("id", preview(F.col("text"), 100, 97).alias("text"), F.size("embedding").alias("dimension")).collect()]


def info(c: Collection) -> dict:
    docs = c.documents()
    n = docs.agg(F.count("*"), F.max(F.size("embedding")), F.count(F.when(F.size("embedding") > 0, 1))).first()
    kinds = docs.groupBy(F.coalesce(F.col("metadata")["language"], F.lit("unknown")).alias("language")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language").collect()  # a row a language
    return {"name": c.name, "documents": n[0], "dimension": max(0, n[1] or 0), "embedded": n[2], "index": c.config.index, "metric": c.config.metric, "languages": [{"language": r["language"], "n": r["n"], "pct": 100.0 * r["n"] / n[0]} for r in kinds]}
