import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.errors import InvalidConfig
from lodestone.functions import distance, filters
from lodestone.operators import hnsw, ivfpq, kmeans, quantize, search

SCHEMA = "id long, embedding array<float>, label string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, str(i % 3)) for i, v in rows], SCHEMA)


def circle(spark, n, step, dim=2):
    return vectors(spark, [(i, [math.cos(i * step), math.sin(i * step)] + [0.0] * (dim - 2)) for i in range(n)])


def test_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0, 6.0]), ([3.0, 4.0, 0.0], [0.0, 0.0, 0.0])], "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    r = df.select(distance.dot(a, b), distance.magnitude(a), distance.cosine(a, b), distance.euclidean(a, b), distance.score(a, b, "euclidean")).collect()
    assert r[0][0] == 32 and r[1][1] == 5 and r[1][2] == 0.0 and r[1][3] == 5 and r[1][4] == -5
    assert distance.metric_of("L2") == "euclidean" and distance.metric_of("?") == "cosine" and distance.metric_of("dot_product") == "dot"
    with pytest.raises(InvalidConfig):
        distance.score(a, b, "hamming")


def test_exact_search_skips_what_has_no_vector_and_breaks_ties_by_id(spark):
    df = vectors(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.5, 0.5]), (3, []), (4, None), (5, [1.0, 0.0]), (6, [1.0]), (7, [0.0, 0.0])])
    got = [(r["id"], round(r["score"], 4)) for r in search.exact_topk(df, [1.0, 0.0], 10).collect()]
    assert got == [(0, 1.0), (5, 1.0), (2, 0.7071), (1, 0.0), (7, 0.0)]
    assert search.exact_topk(df, [1.0, 0.0], 0).count() == 0
    assert [r["id"] for r in search.exact_topk(df, [1.0, 0.0], 5, where=F.col("label") == "2").collect()] == [5, 2]
    assert search.exact_topk(df.where("false"), [1.0, 0.0], 3).count() == 0
    assert [r["id"] for r in search.postfiltered(df, [1.0, 0.0], 5, F.col("label") == "2", 1).collect()] == []


def test_batch_knn_equals_exact_search(spark):
    df = circle(spark, 60, 0.1)
    got = search.batch_knn(df.where("id < 5").select(F.col("id").alias("query_id"), "embedding"), df, 4, "euclidean").collect()
    for q in range(5):
        v = df.where(F.col("id") == q).first()["embedding"]
        want = [r["id"] for r in search.exact_topk(df, v, 4, "euclidean").collect()]
        assert [r["doc_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_filters(spark):
    df = spark.createDataFrame([({"lang": "en", "source": "book.pdf", "empty": ""},), ({},), (None,)], "metadata map<string,string>")
    for f, n in ((filters.metadata_eq("lang", "en"), 1), (filters.metadata_eq("lang", "EN"), 0), (filters.metadata_contains("source", ".pdf"), 1), (filters.metadata_exists("empty"), 1), (filters.metadata_exists("no"), 0), (filters.all_of(), 3), (filters.all_of(filters.metadata_eq("lang", "en"), filters.metadata_exists("no")), 0), (filters.any_of(filters.metadata_eq("lang", "en"), filters.metadata_exists("no")), 1), (~filters.metadata_eq("lang", "en"), 2)):
        assert df.where(f).count() == n


def test_scalar_quantization(spark):
    df = vectors(spark, [(0, [0.9, 0.1]), (1, [0.1, 0.9]), (2, [0.5, 0.5])])
    sq = quantize.fit(df)
    assert [r["id"] for r in quantize.sq_rescored(df, [1.0, 0.0], 1, sq).collect()] == [0]
    codes = [r[0] for r in df.orderBy("id").select(sq.encode(F.col("embedding"))).collect()]
    assert codes[0] == sq.encode_query([0.9, 0.1]) and all(-128 <= x <= 127 for c in codes for x in c)
    same = quantize.sq_table(vectors(spark, [(0, [2.0]), (1, [2.0])])).first()
    assert (same["scale"], same["bias"]) == (1.0, 2.0)


def test_kmeans():
    x = np.array([[0, 0], [0, 1], [10, 10], [10, 11]], float)
    c, who = kmeans.kmeans(x, 2)
    assert who[0] == who[1] != who[2] == who[3]
    assert kmeans.kmeans(x[:1], 3)[0].shape == (3, 2) and not kmeans.kmeans(x[:1], 3)[0][1:].any()
    assert kmeans.kmeans(np.zeros((0, 2)), 2)[0].shape == (2, 2)


def recall(found, exact):
    return len(set(found) & set(exact)) / len(exact)


def test_ivfpq(spark, tmp_path):
    df = vectors(spark, [(i, np.random.default_rng(i).normal(size=16).tolist()) for i in range(300)] + [(900, [])])
    for m in (0, 13, 25):
        with pytest.raises(InvalidConfig):
            ivfpq.Config(n_subvectors=m)
    assert [ivfpq.Config(n_probe=n, rerank=True).effective_probe for n in (10, 3)] == [5, 2] and ivfpq.Config(n_probe=7).effective_probe == 7
    index = ivfpq.IvfPq.build(df, ivfpq.Config(8, 8, 8, rerank=True))
    total = 0
    for q in range(10):
        v = df.where(F.col("id") == q).first()["embedding"]
        exact = [r["id"] for r in search.exact_topk(df, v, 10).collect()]
        total += recall([r["id"] for r in index.search(v, 10).collect()], exact)
    assert total / 10 >= 0.7
    v = df.where("id = 0").first()["embedding"]
    gone = index.delete(spark.createDataFrame([(0,)], "id long"))
    assert 0 not in [r["id"] for r in gone.search(v, 10).collect()] and gone.codes.count() == 300
    assert gone.compact().codes.count() == 299
    index.save(str(tmp_path / "x"))
    again = ivfpq.IvfPq.load(str(tmp_path / "x"), df)
    assert [r["id"] for r in again.search(v, 5).collect()] == [r["id"] for r in index.search(v, 5).collect()]
    assert all(r["id"] % 3 == 1 for r in index.search_filtered(v, 5, F.col("label") == "1").collect())


def test_hnsw_recall_and_order(spark):
    df = vectors(spark, [(i, np.random.default_rng(i).normal(size=12).tolist()) for i in range(400)] + [(900, None)])
    index = hnsw.Hnsw.build(df, hnsw.Config(8, 50, 40, shard_rows=250))
    queries = df.where("id < 20").select(F.col("id").alias("query_id"), "embedding")
    got, exact = index.search_batch(queries, 10), search.batch_knn(queries, df, 10)
    assert search.recall(got, exact, 10).agg(F.avg("recall")).first()[0] >= 0.9
    rows = [r["score"] for r in got.where("query_id = 3").orderBy("rank").collect()]
    assert rows == sorted(rows, reverse=True) and len(rows) == 10
    assert index.delete(spark.createDataFrame([(3,)], "id long")).search(df.where("id = 3").first()["embedding"], 1).first()["doc_id"] != 3


def test_latest_revisions(spark):
    log = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, True), (2, 3, False)], "id long, revision long, deleted boolean")
    assert [(r["id"], r["revision"]) for r in ivfpq.latest_revisions(log).collect()] == [(2, 3)]
