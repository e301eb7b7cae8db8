"""The classifier with few labelled documents."""

import pytest

pytest.importorskip("lodestone.llm")

from lodestone.llm import quality  # noqa: E402


def test_a_few_labels_of_both_kinds_are_fitted(spark):
    good, toxic = "calm river meadow harbour morning light", "vile rotten filthy scum idiot trash"
    docs = spark.createDataFrame([(i, f"{good if i % 2 else toxic} n{i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(10)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.clean(docs, labels).collect()}
    assert kept == {i for i in range(40) if i % 2}
    one_kind = labels.where("toxic = 1")
    assert quality.clean(docs, one_kind).count() == 40
