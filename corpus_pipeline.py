"""The corpus pipeline: documents in, a training mixture out.

Every stage reads what its predecessor wrote and takes its decisions on all of it: the quality classifier drops what it rejects, exact dedup keeps one of equal texts, the n-gram join one of
each group of near duplicates, decontamination drops what holds a test item, and mixing draws from the sources, by their target weights and by the probability that the classifier gives a document. All but the last
return the columns of documents. The classifier is fitted once, on the documents that run() begins with.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, exact_dedup, mixing, ngram_join, quality
from lodestone.llm.common import discard, materialise, table


#: The scorer of the last corpus. A stage that runs in another application fits the same.
_scorers: dict[tuple[str, str], Callable[[Column], Column]] = {}


def _probability(spark: SparkSession, sf_dir: str) -> Column:
    """Of the documents that the classifier is to keep."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = quality.scorer(spark, quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return _scorers[key](F.col("text"))


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return docs.where(_probability(spark, sf_dir) >= quality.KEEP)


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.kept(docs, old=exact_dedup.historic())


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.representatives(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, _probability(spark, sf_dir), targets=mixing.TARGETS, other=mixing.OTHER)


STAGES = [
    ("quality classifier", _quality),
    ("exact dedup", _exact),
    ("n-gram Jaccard join", _near),
    ("benchmark decontamination", _decontaminate),
    ("mixing sources to target weights", _mix),
]

#: The classifier is a trained network and the BM25 search is not SQL, so that run() is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        after = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            discard(docs)
        docs = after
    return docs
