"""Queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import distance, filters
from ..functions.embed import HashEmbedder
from ..functions.text import tokens
from ..operators import bm25, fusion, hnsw, ivfpq, quantize, search, sml
from ..operators.chunking import chunk_files, split_documents, strategy_column
from ..sources.collection import Collection, Config
from ..sources.scratch import scratch
from ..streaming.watch import event_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):  # noqa: ANN202
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings")


def _first(e: DataFrame) -> list[float]:
    row = e.where("vec_id = 0").select("embedding").first()
    return list(row[0]) if row else []


def _out(found: DataFrame) -> DataFrame:
    return found.select("vec_id", F.round("score", 6).alias("score"))


_Q = "qv AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"
_E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_COS = "CASE WHEN list_inner_product(v, v) = 0 OR list_inner_product(q, q) = 0 THEN 0 ELSE list_cosine_similarity(v, q) END"


def _top_sql(score: str, where: str = "true", k: int = 10) -> str:
    return f"WITH {_Q}, {_E} SELECT vec_id, round({score}, 6) AS score FROM e, qv WHERE {where} ORDER BY {score} DESC, vec_id LIMIT {k}"


@_query(_top_sql(_COS))
def exact_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    return _out(search.exact_topk(e, _first(e), 10, "cosine", id_col="vec_id"))


@_query(_top_sql("list_inner_product(v, q)"))
def exact_topk_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    return _out(search.exact_topk(e, _first(e), 10, "dot", id_col="vec_id"))


@_query(_top_sql("0 - list_distance(v, q)"))
def exact_topk_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    return _out(search.exact_topk(e, _first(e), 10, "euclidean", id_col="vec_id"))


@_query(_top_sql(_COS, "label = 3"))
def exact_topk_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    return _out(search.exact_topk(e, _first(e), 10, where=F.col("label") == 3, id_col="vec_id"))


@_query(f"WITH {_Q}, {_E}, t AS (SELECT vec_id, label, {_COS} AS s FROM e, qv ORDER BY s DESC, vec_id LIMIT 30) SELECT vec_id, round(s, 6) AS score FROM t WHERE label = 2 ORDER BY s DESC, vec_id LIMIT 10")
def exact_topk_postfilter3(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    return _out(search.postfiltered(e, _first(e), 10, F.col("label") == 2, 30, id_col="vec_id"))


@_query(
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id)
SELECT query_id, doc_id, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS INT) AS rank FROM s QUALIFY rank <= 10"""
)
def batch_knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is a query."""
    e = _vectors(spark, sf_dir)
    found = search.batch_knn(e.withColumnRenamed("vec_id", "query_id"), e, 10, id_col="vec_id", exclude_self=True)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@_query("SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", F.round(distance.magnitude(F.col("embedding")), 6).alias("norm"))


_X = "x AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS dim FROM embeddings)"
_SQ = f"{_X}, d AS (SELECT dim, min(x) AS lo, max(x) AS hi FROM x GROUP BY dim), sq AS (SELECT dim, CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE (hi - lo) / 255.0::DOUBLE END AS scale, (hi + lo) / 2 AS bias FROM d)"
_CODE = "c AS (SELECT vec_id, label, dim, CAST(greatest(-128, least(127, round((x - bias) / scale))) AS BIGINT) AS c FROM x JOIN sq USING (dim))"
_CODES = f"{_SQ}, {_CODE}, s AS (SELECT a.vec_id, sum(a.c * b.c) AS s FROM c a JOIN c b ON a.dim = b.dim AND b.vec_id = 0 GROUP BY a.vec_id)"


@_query(f"WITH {_X} SELECT dim, min(x) AS lo, max(x) AS hi FROM x GROUP BY dim")
def dimension_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantize.dimension_stats(_vectors(spark, sf_dir)).select("dim", "lo", "hi")


@_query(f"WITH {_SQ} SELECT dim, round(scale, 9) AS scale, round(bias, 9) AS bias FROM sq")
def sq_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantize.sq_table(_vectors(spark, sf_dir)).select("dim", F.round("scale", 9).alias("scale"), F.round("bias", 9).alias("bias"))


@_query(f"WITH {_SQ}, {_CODE} SELECT vec_id, CAST(sum(c) AS BIGINT) AS code_sum FROM c GROUP BY vec_id")
def sq_encode_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    codes = quantize.fit(e).encode(F.col("embedding"))
    return e.select("vec_id", F.aggregate(codes, F.lit(0).cast("long"), lambda s, x: s + x).alias("code_sum"))


@_query(f"WITH {_CODES} SELECT vec_id, CAST(s AS DOUBLE) AS score FROM s ORDER BY score DESC, vec_id LIMIT 10")
def sq_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    return quantize.sq_topk(e, _first(e), 10, quantize.fit(e), id_col="vec_id").select("vec_id", "score")


_RESCORED = f"{_CODES}, {_Q}, t AS (SELECT vec_id FROM s ORDER BY s DESC, vec_id LIMIT 20), {_E}, r AS (SELECT vec_id, {_COS} AS s FROM e JOIN t USING (vec_id), qv ORDER BY s DESC, vec_id LIMIT 10)"


@_query(f"WITH {_RESCORED} SELECT vec_id, round(s, 6) AS score FROM r")
def sq_rescore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    return _out(quantize.sq_rescored(e, _first(e), 10, quantize.fit(e), id_col="vec_id"))


@_query(f"WITH {_RESCORED}, x2 AS (SELECT vec_id FROM e, qv ORDER BY {_COS} DESC, vec_id LIMIT 10) SELECT CAST(0 AS BIGINT) AS query_id, (SELECT count(*) FROM r JOIN x2 USING (vec_id)) / 10.0::DOUBLE AS recall")
def recall_at_10_sq(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    q = _first(e)
    pairs = lambda x: x.select(F.lit(0).cast("long").alias("query_id"), F.col("vec_id").alias("doc_id"))
    return search.recall(pairs(quantize.sq_rescored(e, q, 10, quantize.fit(e), id_col="vec_id")), pairs(search.exact_topk(e, q, 10, id_col="vec_id")), 10)


@_query(f"WITH {_X} SELECT label, dim, round(avg(x), 6) AS mean FROM x GROUP BY ALL")
def centroid_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _vectors(spark, sf_dir).select("label", F.posexplode("embedding").alias("dim", "x"))
    return x.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def _centroids(e: DataFrame) -> DataFrame:
    """One row a label: cid and its mean vector."""
    x = e.select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return x.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("c")).withColumnRenamed("label", "cid")


_CENT = f"{_X}, m AS (SELECT label AS cid, dim, avg(x) AS m FROM x GROUP BY ALL), cent AS (SELECT cid, list(m ORDER BY dim) AS c FROM m GROUP BY cid)"
_ASSIGN = f"{_CENT}, {_E}, a AS (SELECT vec_id, v, cid, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(v, c), cid) AS r FROM e, cent QUALIFY r = 1)"


def _assigned(e: DataFrame) -> DataFrame:
    pairs = e.crossJoin(_centroids(e)).withColumn("d", distance.squared_euclidean(F.col("embedding"), F.col("c")))
    return pairs.groupBy("vec_id").agg(F.min_by("cid", F.struct("d", "cid")).alias("cid"), F.first("embedding").alias("embedding"))


@_query(f"WITH {_ASSIGN} SELECT vec_id, cid FROM a")
def assign_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(_vectors(spark, sf_dir)).select("vec_id", "cid")


@_query(f"WITH {_ASSIGN}, {_Q}, p AS (SELECT cid FROM cent, qv ORDER BY list_cosine_similarity(c, q) DESC, cid LIMIT 3) SELECT vec_id, round({_COS}, 6) AS score FROM a, qv WHERE cid IN (SELECT cid FROM p) ORDER BY {_COS} DESC, vec_id LIMIT 10")
def ivf_probe_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    q = _first(e)
    probed = search.exact_topk(_centroids(e), q, 3, id_col="cid", vector="c").select("cid")
    return _out(search.exact_topk(_assigned(e).join(F.broadcast(probed), "cid", "left_semi"), q, 10, id_col="vec_id"))


def _stored(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Where this application keeps the index of a table: it is built by the first query that asks for it."""
    return scratch(spark, f"{name}-{hashlib.md5(sf_dir.encode()).hexdigest()}")  # noqa: S324


def _ivfpq(e: DataFrame, sf_dir: str) -> ivfpq.IvfPq:
    path = _stored(e.sparkSession, sf_dir, "ivfpq")
    try:
        return ivfpq.IvfPq.load(path, e, "vec_id")
    except FileNotFoundError:
        return ivfpq.IvfPq.build(e, ivfpq.Config(n_clusters=32, n_subvectors=16, n_probe=16, rerank=True, recall=0.9), "vec_id").save(path)


def _hnsw(e: DataFrame, sf_dir: str, config: hnsw.Config) -> hnsw.Hnsw:
    path = _stored(e.sparkSession, sf_dir, "hnsw-codes" if config.codes else "hnsw")
    try:
        return hnsw.Hnsw.load(path, e, config, "vec_id")
    except FileNotFoundError:
        return hnsw.Hnsw.build(e, config, "vec_id").save(path)


@_query()
def ivfpq_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    return _ivfpq(e, sf_dir).search(_first(e), 10).select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@_query()
def hnsw_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    return _hnsw(e, sf_dir, hnsw.Config()).search(_first(e), 10).select(F.col("doc_id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


def _as_queries(e: DataFrame) -> DataFrame:
    """Every row is a query, and is found by itself too."""
    return e.select(F.col("vec_id").alias("query_id"), "embedding")


def _exact_batch(e: DataFrame) -> DataFrame:
    return search.batch_knn(_as_queries(e), e, 10, id_col="vec_id")


def _pairs_out(found: DataFrame) -> DataFrame:
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _recalls(found: DataFrame, e: DataFrame) -> DataFrame:
    return search.recall(found, _exact_batch(e), 10)


_PAIRS = f"{_SQ}, {_CODE}, cl AS (SELECT vec_id, CAST(list(c ORDER BY dim) AS DOUBLE[]) AS c FROM c GROUP BY vec_id), s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_inner_product(a.c, b.c) AS s FROM cl a, cl b)"
_BEST = "row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id)"
_COS_PAIR = "CASE WHEN list_inner_product(a.v, a.v) = 0 OR list_inner_product(b.v, b.v) = 0 THEN 0 ELSE list_cosine_similarity(b.v, a.v) END"
_RESCORED_PAIRS = f"{_PAIRS}, {_E}, t AS (SELECT query_id, doc_id FROM s QUALIFY {_BEST} <= 20), r0 AS (SELECT query_id, doc_id, {_COS_PAIR} AS s FROM t JOIN e a ON a.vec_id = query_id JOIN e b ON b.vec_id = doc_id), r AS (SELECT *, CAST({_BEST} AS INT) AS rank FROM r0 QUALIFY rank <= 10)"


@_query(f"WITH {_PAIRS} SELECT query_id, doc_id, s AS score, CAST({_BEST} AS INT) AS rank FROM s QUALIFY rank <= 10")
def sq_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    return quantize.sq_batch(_as_queries(e), e, 10, quantize.fit(e), id_col="vec_id").select("query_id", "doc_id", "score", "rank")


@_query(f"WITH {_RESCORED_PAIRS} SELECT query_id, doc_id, round(s, 6) AS score, rank FROM r")
def sq_rescore_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    return _pairs_out(quantize.sq_rescored_batch(_as_queries(e), e, 10, quantize.fit(e), id_col="vec_id"))


@_query(
    f"WITH {_RESCORED_PAIRS}, x1 AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, {_COS_PAIR} AS s FROM e a, e b), x2 AS (SELECT query_id, doc_id FROM x1 QUALIFY {_BEST} <= 10) SELECT query_id, count(r.doc_id) / 10.0::DOUBLE AS recall FROM x2 LEFT JOIN r USING (query_id, doc_id) GROUP BY query_id"
)
def recall_at_10_sq_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    return _recalls(quantize.sq_rescored_batch(_as_queries(e), e, 10, quantize.fit(e), id_col="vec_id"), e)


@_query()
def ivfpq_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    return _pairs_out(_ivfpq(e, sf_dir).search_batch(_as_queries(e), 10))


@_query()
def recall_at_10_ivfpq_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    return _recalls(_ivfpq(e, sf_dir).search_batch(_as_queries(e), 10), e)


@_query()
def hnsw_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    return _pairs_out(_hnsw(e, sf_dir, hnsw.Config()).search_batch(_as_queries(e), 10))


@_query()
def recall_at_10_hnsw_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    return _recalls(_hnsw(e, sf_dir, hnsw.Config()).search_batch(_as_queries(e), 10), e)


_WALK = hnsw.Config(ef_construction=100, ef_search=100, codes=True)


@_query()
def hnsw_codes_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beams over signed bytes, the best 2k scored again by their vectors."""
    e = _vectors(spark, sf_dir)
    return _pairs_out(_hnsw(e, sf_dir, _WALK).search_batch(_as_queries(e), 10))


_REACHED = "SELECT name, (SELECT count(*) FROM embeddings) AS queries, true AS reached FROM (VALUES ('hnsw'), ('hnsw_codes'), ('ivf_pq')) t(name)"


@_query(_REACHED)
def recall_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the mean recall@10 of the approximate indexes, with every vector as a query, is 0.9 or more."""
    e = _vectors(spark, sf_dir)
    found = {"hnsw": _hnsw(e, sf_dir, hnsw.Config()), "hnsw_codes": _hnsw(e, sf_dir, _WALK), "ivf_pq": _ivfpq(e, sf_dir)}
    pairs = reduce(DataFrame.unionByName, (x.search_batch(_as_queries(e), 10).select("query_id", "doc_id", F.lit(name).alias("name")) for name, x in found.items()))
    return search.mean_recalls(pairs, _exact_batch(e), 10, list(found)).select("name", "queries", (F.col("recall") >= 0.9).alias("reached"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata have a key toxic only where there is a label."""
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").cast("string").alias("toxic"))
    pairs = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source", F.lit("toxic"), "toxic")
    return _docs(spark, sf_dir).join(labels, "doc_id", "left").withColumn("metadata", F.map_filter(pairs, lambda _, v: v.isNotNull()))


@_query("SELECT doc_id FROM documents WHERE lang = 'fr'")
def metadata_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_metadata(spark, sf_dir).where(filters.metadata_eq("lang", "fr")).select("doc_id")


@_query("SELECT doc_id FROM documents WHERE contains(source, '1')")
def metadata_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_metadata(spark, sf_dir).where(filters.metadata_contains("source", "1")).select("doc_id")


@_query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic IS NOT NULL)")
def metadata_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_metadata(spark, sf_dir).where(filters.metadata_exists("toxic")).select("doc_id")


@_query("SELECT doc_id FROM documents WHERE lang = 'en' AND contains(source, '1')")
def metadata_all_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_metadata(spark, sf_dir).where(filters.all_of(filters.metadata_eq("lang", "en"), filters.metadata_contains("source", "1"))).select("doc_id")


_T = r"t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents)"
_BM = f"""{_T}, len AS (SELECT doc_id, len(t) AS len FROM t), st AS (SELECT count(*) AS n, avg(len) AS avgdl FROM len),
tf AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM t) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), idf AS (SELECT term, df, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) + 1 AS idf FROM df, st)"""
_TERM = "idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl))"


def _bm_sql(words: dict[str, int]) -> str:
    q = ", ".join(f"('{w}', {n})" for w, n in words.items())
    return f"{_BM}, q(term, qtf) AS (VALUES {q}), b AS (SELECT doc_id, sum(qtf * {_TERM}) AS s FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN len USING (doc_id), st WHERE idf > 0 GROUP BY doc_id)"


@_query(f"WITH {_T} SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_terms FROM t")
def tokenise_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(F.array_distinct(tokens(F.col("text")))).cast("long").alias("n_terms"))


@_query(f"WITH {_T}, p AS (SELECT doc_id, unnest(t) AS term, CAST(generate_subscripts(t, 1) - 1 AS BIGINT) AS pos FROM t) SELECT term, doc_id, count(*) AS tf, min(pos) AS first_pos, max(pos) AS last_pos FROM p GROUP BY ALL")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = bm25.postings(_docs(spark, sf_dir), "doc_id")
    return p.select("term", "doc_id", "tf", F.element_at("positions", 1).cast("long").alias("first_pos"), F.element_at("positions", -1).cast("long").alias("last_pos"))


@_query(f"WITH {_T} SELECT doc_id, CAST(len(t) AS BIGINT) AS len FROM t")
def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.doc_lengths(_docs(spark, sf_dir), "doc_id")


@_query(f"WITH {_BM} SELECT term, df, round(idf, 6) AS idf FROM idf")
def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.vocabulary(_docs(spark, sf_dir), "doc_id").select("term", "df", F.round("idf", 6).alias("idf"))


def _bm25(spark: SparkSession, sf_dir: str, query: str, k: int = 20) -> DataFrame:
    return bm25.Bm25(_docs(spark, sf_dir), "doc_id").search(query, k).select("doc_id", F.round("score", 6).alias("score"))


@_query(f"WITH {_bm_sql({'ing': 1, 'nt': 1, 'ea': 1})} SELECT doc_id, round(s, 6) AS score FROM b ORDER BY s DESC, doc_id LIMIT 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, "ing nt ea")


@_query(f"WITH {_bm_sql({'ing': 2, 'or': 1})} SELECT doc_id, round(s, 6) AS score FROM b ORDER BY s DESC, doc_id LIMIT 20")
def bm25_repeated_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, "ing or ing")


@_query(
    rf"""WITH {_BM}, qt AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS qtf FROM qt GROUP BY ALL),
b AS (SELECT item_id, doc_id, sum(qtf * {_TERM}) AS s FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN len USING (doc_id), st WHERE idf > 0 GROUP BY ALL)
SELECT item_id AS query_id, doc_id, round(s, 6) AS score FROM b QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, doc_id) <= 3"""
)
def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item is a query."""
    found = bm25.Bm25(_docs(spark, sf_dir), "doc_id").search_batch(_table(spark, sf_dir, "benchmark"), "item_id", k=3)
    top = search.ranked(found.withColumn("score", F.round("score", 9)), 3)
    return top.select("query_id", "doc_id", F.round("score", 6).alias("score"))


@_query(
    f"WITH {_bm_sql({'ing': 1, 'or': 1})}, h AS (SELECT doc_id FROM t WHERE len(list_filter(range(1, len(t)), lambda i: t[i] = 'ing' AND t[i + 1] = 'or')) > 0) SELECT doc_id, round(coalesce(s, 0), 6) AS score FROM h LEFT JOIN b USING (doc_id) ORDER BY coalesce(s, 0) DESC, doc_id LIMIT 20"
)
def bm25_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, '"ing or"')


def _words(spark: SparkSession, sf_dir: str) -> bm25.Bm25:
    """The stored word index."""
    return bm25.Bm25.cached(_stored(spark, sf_dir, "bm25"), _docs(spark, sf_dir), "doc_id")


@_query(ORACLES["bm25_topk"])
def bm25_stored_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).search("ing nt ea", 20).select("doc_id", F.round("score", 6).alias("score"))


@_query(ORACLES["bm25_phrase"])
def bm25_stored_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).search('"ing or"', 20).select("doc_id", F.round("score", 6).alias("score"))


@_query(ORACLES["bm25_batch"])
def bm25_stored_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _words(spark, sf_dir).search_batch(_table(spark, sf_dir, "benchmark"), "item_id", k=3)
    return search.ranked(found.withColumn("score", F.round("score", 9)), 3).select("query_id", "doc_id", F.round("score", 6).alias("score"))


_VEC = f"vec AS (SELECT vec_id AS doc_id, {_COS} AS s FROM e JOIN documents ON doc_id = vec_id, qv)"
_RRF = "SELECT doc_id, sum(1.0::DOUBLE / (60 + r)) AS s FROM (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM va UNION ALL SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) FROM ba) GROUP BY doc_id"


def _hybrid_sql(fetch: int, rerank: bool) -> str:
    base = f"WITH {_bm_sql({'ing': 1, 'nt': 1})}, {_Q}, {_E}, {_VEC}, va AS (SELECT * FROM vec ORDER BY s DESC, doc_id LIMIT {fetch}), ba AS (SELECT * FROM b ORDER BY s DESC, doc_id LIMIT {fetch}), f AS (SELECT * FROM ({_RRF}) ORDER BY s DESC, doc_id LIMIT 20)"
    if not rerank:
        return f"{base} SELECT doc_id, round(s, 6) AS score FROM f ORDER BY s DESC, doc_id LIMIT 10"
    return f"{base}, g AS (SELECT doc_id, s, 1 - 0.7::DOUBLE * strlen(text) / greatest(1, max(strlen(text)) OVER ()) AS x FROM f JOIN documents USING (doc_id)) SELECT doc_id, round(s, 6) AS score FROM g ORDER BY x DESC, s DESC, doc_id LIMIT 10"


def _hybrid(spark: SparkSession, sf_dir: str, profile: str, reranker: fusion.Reranker | None = None) -> DataFrame:
    e = _vectors(spark, sf_dir)
    rows = _docs(spark, sf_dir).join(e, F.col("doc_id") == F.col("vec_id"), "left")
    q = _first(e)
    return fusion.hybrid(rows, q, "ing nt", 10, profile, reranker, bm25.Bm25(_docs(spark, sf_dir), "doc_id"), id_col="doc_id").select("doc_id", F.round("score", 6).alias("score"))


@_query(_hybrid_sql(30, False))
def hybrid_production(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, "production")


@_query(_hybrid_sql(50, True))
def hybrid_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, "precision", fusion.LengthReranker())


@_query(f"WITH {_Q}, {_E}, {_VEC} SELECT doc_id, round(s, 6) AS score FROM vec ORDER BY s DESC, doc_id LIMIT 10")
def hybrid_maxspeed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, "maxspeed")


@_query(f"WITH {_bm_sql({'ing': 1, 'nt': 1})}, {_Q}, {_E}, {_VEC}, va AS (SELECT * FROM vec ORDER BY s DESC, doc_id LIMIT 40), ba AS (SELECT * FROM b ORDER BY s DESC, doc_id LIMIT 40) SELECT doc_id, round(s, 9) AS score FROM ({_RRF}) ORDER BY s DESC, doc_id LIMIT 50")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    rows = e.join(_docs(spark, sf_dir), F.col("doc_id") == F.col("vec_id"))
    lists = [search.exact_topk(rows, _first(e), 40, id_col="doc_id").select("doc_id", "score"), bm25.Bm25(_docs(spark, sf_dir), "doc_id").search("ing nt", 40)]
    return fusion.rrf(lists, 50).select("doc_id", F.round("score", 9).alias("score"))


@_query("WITH f AS (SELECT doc_id, text FROM documents WHERE lang = 'de') SELECT doc_id, round(1 - 0.7::DOUBLE * strlen(text) / greatest(1, max(strlen(text)) OVER ()), 9) AS score FROM f")
def rerank_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).where("lang = 'de'")
    return fusion.length_scores(d).select("doc_id", F.round("rerank_score", 9).alias("score"))


@_query(
    "SELECT page_id, CASE WHEN lower(regexp_extract(regexp_extract(url, '^[^?#]*'), '\\.([A-Za-z0-9]+)$', 1)) IN ('rs','py','js','jsx','ts','tsx','mjs','cjs','go') THEN 'code' ELSE 'fixed_window' END AS strategy FROM pages"
)
def chunk_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", strategy_column(F.regexp_extract("url", r"^[^?#]*", 0)).alias("strategy"))


def _collection(spark: SparkSession, sf_dir: str, name: str, **config) -> Collection:  # noqa: ANN003
    """The documents as a collection; what was there is replaced."""
    c = Collection(spark, _stored(spark, sf_dir, name), Config(**config))
    d = _docs(spark, sf_dir)
    c.overwrite(d.select(F.col("doc_id").cast("string").alias("id"), "text", F.map_filter(F.create_map(F.lit("lang"), "lang"), lambda _, v: v.isNotNull()).alias("metadata")))
    return c


def _stored_texts(c: Collection) -> DataFrame:
    return c.documents().select(F.col("id").cast("long").alias("doc_id"), "text")


@_query("SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _collection(spark, sf_dir, "delete")
    c.delete(_table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("id")))
    return _stored_texts(c)


@_query("WITH n AS (SELECT item_id AS doc_id, text FROM benchmark) SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT doc_id, text FROM n")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _collection(spark, sf_dir, "upsert")
    c.update(_table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text"))
    return _stored_texts(c)


@_query("SELECT doc_id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark")
def append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id that is there already is there twice afterwards."""
    c = _collection(spark, sf_dir, "append")
    c.insert(_table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text"))
    return _stored_texts(c)


@_query("SELECT user_id AS id, event_id AS revision, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error'")
def dedup_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("revision"), "event_type", (F.col("event_type") == "error").alias("deleted"))
    return ivfpq.latest_revisions(log).select("id", "revision", "event_type")


@_query("SELECT coalesce(lang, 'unknown') AS language, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM documents GROUP BY 1")
def language_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _docs(spark, sf_dir).groupBy(F.coalesce("lang", F.lit("unknown")).alias("language")).agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


@_query("SELECT doc_id, '' AS text, lang FROM documents")
def storage_symbolic_pure(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _collection(spark, sf_dir, "symbolic", symbolic=True)
    return c.documents().select(F.col("id").cast("long").alias("doc_id"), "text", F.col("metadata")["lang"].alias("lang"))


@_query("SELECT count(*) AS n, count(DISTINCT text) AS vectors, true AS in_range FROM documents WHERE text IS NOT NULL")
def hash_embed_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts have one vector if and only if they are equal, and every component is in [0, 1)."""
    e = _docs(spark, sf_dir).where("text is not null").select(HashEmbedder(16).column(F.col("text")).alias("e"))
    return e.agg(F.count("*").alias("n"), F.count_distinct("e").alias("vectors"), F.bool_and(F.forall("e", lambda x: (x >= 0) & (x < 1))).alias("in_range"))


@_query()
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", HashEmbedder(16).column(F.col("text")).alias("embedding"))


@_query("SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY user_id")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda x, name: F.round(F.percentile("value", F.lit(x)), 6).alias(name)
    return _table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), p(0.5, "p50"), p(0.95, "p95"), p(0.99, "p99"))


@_query()
def chunk_fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _docs(spark, sf_dir).select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    return chunk_files(files).select("id", "text", F.col("metadata")["start_line"].alias("start_line"), F.col("metadata")["end_line"].alias("end_line"))


@_query()
def chunk_splitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_documents(_docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "lang"))


@_query()
def sml_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", sml.manifest(F.col("text"), F.col("doc_id").cast("string")).alias("manifest"))


@_query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_counts(_table(spark, sf_dir, "events"))
