"""Searches in which every row is a query."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import hnsw, search
from lodestone.plans import queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """No vec_id 0 among the vectors."""
    at = tmp_path_factory.mktemp("vectors")
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 64))[rng.integers(20, size=600)] * 0.5 + rng.normal(size=(600, 64))
    spark.createDataFrame([(i + 1, v, 0) for i, v in enumerate(x.astype(np.float32).tolist())], "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return str(at)


def exact(e):
    return search.batch_knn(e.withColumnRenamed("vec_id", "query_id"), e, 10, id_col="vec_id")


def test_registered_ivfpq_reaches_its_recall_with_every_row_as_a_query(spark, tables):
    e = spark.read.parquet(f"{tables}/embeddings.parquet")
    index = queries._ivfpq(e, tables)
    found = index.search_batch(e.withColumnRenamed("vec_id", "query_id"), 10)
    r = search.recall(found, exact(e), 10).agg(F.avg("recall"), F.count("*")).first()
    assert r[0] >= 0.9 and r[1] == 600
    one = index.search(e.where("vec_id = 7").first()["embedding"], 10).collect()
    assert [x["id"] for x in one] == [x["doc_id"] for x in found.where("query_id = 7").orderBy("rank").collect()]


@pytest.mark.parametrize("name", ["sq", "ivfpq", "hnsw"])
def test_every_row_is_a_query_and_has_its_recall(spark, tables, name):
    e = spark.read.parquet(f"{tables}/embeddings.parquet")
    found = queries.QUERIES["sq_rescore_batch" if name == "sq" else f"{name}_batch"](spark, tables)
    n = found.groupBy("query_id").agg(F.count("*").alias("n"), F.max("rank").alias("last"))
    assert n.where("n = 10 and last = 10").count() == 600
    got = {r[0]: r[1] for r in queries.QUERIES[f"recall_at_10_{name}_batch"](spark, tables).collect()}
    assert len(got) == 600 and np.mean(list(got.values())) >= 0.9
    if name == "sq":
        v = e.where("vec_id = 7").first()["embedding"]
        want = queries.quantize.sq_topk(e, v, 10, queries.quantize.fit(e), id_col="vec_id").collect()
        found = queries.QUERIES["sq_topk_batch"](spark, tables).where("query_id = 7").orderBy("rank").collect()
        assert [(r["doc_id"], r["score"]) for r in found] == [(r["vec_id"], r["score"]) for r in want]


def test_best_columns_with_ties():
    rng = np.random.default_rng(2)
    ids = rng.permutation(50)
    for high in (3, 40, 10_000):
        s = rng.integers(0, high, (30, 50)).astype(float)
        s[:, 7] = -np.inf
        for n in (1, 5, 49, 50):
            want = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :n]
            assert (search.best_columns(s, ids, n) == want).all()


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_best_equals_all_scores_sorted(metric):
    """Blocks in any number and order, ties within and between blocks, vectors without length, a query's own id left out."""
    rng = np.random.default_rng(3)
    d = rng.integers(-2, 3, (700, 4)).astype(np.float32) * rng.choice([1, 1e-4, 1e4], (700, 1)).astype(np.float32)
    q, own = d[::7].copy(), np.arange(0, 700, 7)
    for exclude in (False, True):
        best = search.Best(own, q, 9, metric, exclude)
        for at in np.array_split(rng.permutation(700), [3, 40, 41, 400]):
            best.add(at, d[at])
        x, y = q[:, None].astype(float), d[None].astype(float)
        s = -np.sqrt(((x - y) ** 2).sum(2)) if metric == "euclidean" else (x * y).sum(2)
        if metric == "cosine":
            n = np.sqrt((x * x).sum(2)) * np.sqrt((y * y).sum(2))
            s = np.divide(s, n, out=np.zeros_like(s), where=n > 0)
        if exclude:
            s[np.arange(len(own)), own] = -np.inf
        for i in range(len(own)):
            assert best.score[i] == pytest.approx(np.sort(s[i])[::-1][:9], rel=1e-12, abs=1e-12)
            assert s[i][best.doc[i]] == pytest.approx(best.score[i], rel=1e-12, abs=1e-12) and len(set(best.doc[i])) == 9
            for a, b in zip(range(8), range(1, 9)):
                assert best.score[i][a] > best.score[i][b] or best.doc[i][a] < best.doc[i][b]


@pytest.mark.parametrize("name", ["batch_knn_cosine", "sq_topk_batch", "sq_rescore_batch", "ivfpq_batch"])
def test_tasks_keep_the_best_instead_of_sending_pairs_of_blocks(spark, tables, name):
    plan = queries.QUERIES[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("CartesianProduct", "BroadcastNestedLoopJoin", "Window"))


def test_queries_of_a_batch_are_found_whole(spark):
    """More than a product's rows, several groups, an id that asks twice, and vectors of another dimension in another partition."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2500, 8)).astype(np.float32)
    schema = "id long, embedding array<float>"
    e = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], schema)
    twice = e.select(F.when(F.col("id") == 2499, 0).otherwise(F.col("id")).alias("query_id"), "embedding")
    got = search.batch_knn(twice, e.union(spark.createDataFrame([(9999, [1.0, 2.0])], schema)), 3)
    n = got.groupBy("query_id").agg(F.count("*").alias("n"), F.max("rank").alias("last"))
    assert n.where("n = 3 and last = 3").count() == n.count() == 2499
    best = {(r["query_id"], r["rank"]): r["doc_id"] for r in got.collect()}
    assert all(best[i, 1] == i for i in range(1, 2499)) and {best[0, 1], best[0, 2]} == {0, 2499}


@pytest.mark.parametrize("config", [hnsw.Config(), hnsw.Config(metric="euclidean"), hnsw.Config(ef_construction=100, ef_search=100, codes=True)])
def test_graphs_are_built_and_walked_in_blocks(config):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 16))[rng.integers(30, size=4000)] + 0.5 * rng.normal(size=(4000, 16))
    x[3900:] = x[17]  # and many equal ones
    began = time.time()
    g = hnsw.Graph(x, config)
    s, at = g.search_many(x[:700], 10)
    assert time.time() - began < 10  # inserted one by one: 20 s and more
    best = search.Best(np.arange(700), x[:700], 10, config.metric)
    best.add(np.arange(4000), x)
    level = best.score[:, -1:] - 1e-5  # of equal ones any
    assert (s >= level).mean() > (0.85 if config.codes else 0.98) and (np.diff(s, axis=1) <= 0).all() and all(len(set(r)) == 10 for r in at.tolist())
    one = g.search(x[3], 10)
    assert [n for _, n in one] == at[3].tolist() and [t for t, _ in one] == s[3].tolist()
    assert all(len(set(r[r >= 0])) == (r >= 0).sum() and i not in r for i, r in enumerate(g.links[0]))


def test_shards_and_slices_of_queries_meet_once(spark, tmp_path):
    x = np.random.default_rng(6).normal(size=(1500, 8)).astype(np.float32)
    e = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, embedding array<float>")
    index = hnsw.Hnsw.build(e, hnsw.Config(shard_rows=400)).save(str(tmp_path / "g"))
    assert index.n == 4 and index.shards.count() == 4
    asked = e.withColumnRenamed("id", "query_id")
    found = index.search_batch(asked, 10)
    assert found.count() == 15_000 and found.select("query_id", "doc_id").distinct().count() == 15_000
    assert not any(x in found._jdf.queryExecution().executedPlan().toString() for x in ("CartesianProduct", "BroadcastNestedLoopJoin"))
    got = {r["name"]: (r["queries"], r["recall"]) for r in search.mean_recalls(found.select("query_id", "doc_id", F.lit("a").alias("name")), search.batch_knn(asked, e, 10), 10, ["a", "none"]).collect()}
    one = search.recall(found, search.batch_knn(asked, e, 10), 10).agg(F.avg("recall")).first()[0]
    assert got == {"a": (1500, pytest.approx(one)), "none": (1500, 0.0)} and one > 0.95
    assert hnsw.Hnsw.build(e.where("false"), hnsw.Config()).search([1.0] * 8, 3).count() == 0
