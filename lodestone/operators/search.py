"""Exact nearest neighbours: one query as a column expression with a distributed top k, many queries as blocked matrix products that keep each query's best.

Order everywhere: score descending, then id ascending.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InvalidConfig
from ..functions.distance import METRICS, score_query

#: Vectors of a block, queries of one matrix product, and most queries of a task.
BLOCK, TILE, GROUP = 4096, 1024, 32_768


def exact_topk(docs: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", where: Column | None = None, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """The k best rows of docs with their score; where is applied before scoring. Rows without a vector, or with one of another dimension, are skipped."""
    if metric not in METRICS:
        raise InvalidConfig(f"metric {metric!r}")
    rows = docs if where is None else docs.where(where)
    rows = rows.withColumn("score", score_query(F.col(vector), query, metric)).where("score is not null")
    return rows.orderBy(F.desc("score"), id_col).limit(max(0, k))


def postfiltered(docs: DataFrame, query: Sequence[float], k: int, where: Column, fetch: int, **how) -> DataFrame:
    """The best `fetch` rows, of them those that pass the filter, at most k: fewer than k may be left."""
    found = exact_topk(docs, query, fetch, **how).where(where)
    return found.orderBy(F.desc("score"), how.get("id_col", "id")).limit(max(0, k))


def as_matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of equal dimension as a matrix, and the positions of their rows. The dimension is the first vector's; others must agree."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.flatnonzero(size > 0)
    if not len(at):
        return np.zeros((0, 0), np.float32), at
    if len(np.unique(size[at])) > 1:
        raise InvalidConfig(f"vectors differ in dimension: {np.unique(size[at]).tolist()}")
    flat = column.take(pa.array(at)).flatten()
    return flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(at), -1), at


def best_columns(s: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Of each row of scores the columns of the n best, best first, equal ones by id. Only rows with ties at the end of the list are sorted whole."""
    if n < s.shape[1]:
        at = np.argpartition(-s, n - 1, axis=1)[:, :n]
        last = np.take_along_axis(s, at, 1).min(1)
        tied = np.flatnonzero((s >= last[:, None]).sum(1) > n)
        if len(tied):
            at[tied] = np.lexsort((np.broadcast_to(ids, (len(tied), len(ids))), -s[tied]), axis=1)[:, :n]
    else:
        at = np.broadcast_to(np.arange(s.shape[1]), s.shape)
    order = np.lexsort((ids[at], -np.take_along_axis(s, at, 1)), axis=1)
    return np.take_along_axis(at, order, 1)


class Best:
    """Of each query the k best of the vectors that add() sees, equal ones by id; score and doc hold them, best first.

    Products in single precision, with a bound on their error, find what can be among them; only that is scored, in double precision and pair by pair, so that equal vectors have equal scores wherever they stand."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, metric: str = "cosine", exclude_self: bool = False, more: bool = False):
        self.ids, self.k, self.metric, self.exclude = ids, k, metric, exclude_self
        self.q = vectors.astype(np.float64)
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.q, self.q))
        self.near = self._near(self.q, self.norm)
        self.score, self.doc = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.more = np.full((len(ids), k), -np.inf) if more else None
        self.floor = np.full(len(ids), -np.inf)  # the last one's score, as a product

    def _near(self, x: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return (x / np.where(norm > 0, norm, 1)[:, None] if self.metric == "cosine" else x).astype(np.float32)

    def _scores(self, r: np.ndarray, d: np.ndarray, norm: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = np.empty(len(r))
        for lo in range(0, len(r), 1 << 15):
            i, j = r[lo : lo + (1 << 15)], c[lo : lo + (1 << 15)]
            if self.metric == "euclidean":
                x = self.q[i] - d[j]
                out[lo : lo + len(i)] = 0.0 - np.sqrt(np.einsum("ij,ij->i", x, x))
                continue
            s = np.einsum("ij,ij->i", self.q[i], d[j])
            if self.metric == "cosine":
                n = self.norm[i] * norm[j]
                s = np.divide(s, n, out=np.zeros_like(s), where=n > 0)
            out[lo : lo + len(i)] = s
        return out

    def add(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None, more: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> None:
        """rows: the queries that these vectors are for, all unless given. more: of pairs (row, column) a number that is kept beside the score."""
        rows = np.arange(len(self.ids)) if rows is None else rows
        if self.k <= 0 or not len(ids) or not len(rows):
            return
        d = vectors.astype(np.float64)
        norm = np.sqrt(np.einsum("ij,ij->i", d, d))
        near, half = self._near(d, norm), (norm * norm / 2).astype(np.float32)
        size = 1.0 if self.metric == "cosine" else norm.max()
        want = self.k + self.exclude
        for lo in range(0, len(rows), TILE):
            at = rows[lo : lo + TILE]
            a = self.near[at] @ near.T
            if self.metric == "euclidean":
                a -= half
            error = (d.shape[1] + 8) * 2.0**-23 * (size * (1.0 if self.metric == "cosine" else self.norm[at]) + (size * size if self.metric == "euclidean" else 0) + np.zeros(len(at)))
            low = self.floor[at] - error
            new = np.flatnonzero(self.floor[at] == -np.inf)
            if len(new) and len(ids) > want:  # as many as are asked for have this product or more
                low[new] = np.partition(a[new], len(ids) - want, axis=1)[:, len(ids) - want] - 2 * error[new]
            low[~np.isfinite(low)] = -np.inf
            r, c = np.divmod(np.flatnonzero(a >= low.astype(np.float32)[:, None]), len(ids))
            r = at[r]
            if self.exclude:
                other = self.ids[r] != ids[c]
                r, c = r[other], c[other]
            s = self._scores(r, d, norm, c)
            ok = (s >= self.score[r, -1]) & (s > -np.inf)
            if ok.any():
                r, c, s = r[ok], c[ok], s[ok]
                self._merge(r, s, ids[c], more(r, c) if more else None)

    def _merge(self, r: np.ndarray, s: np.ndarray, doc: np.ndarray, more: np.ndarray | None) -> None:
        """r: ascending."""
        own, first, count = np.unique(r, return_index=True, return_counts=True)
        place = np.repeat(np.arange(len(own)), count), self.k + np.arange(len(r)) - np.repeat(first, count)

        def beside(kept: np.ndarray, new: np.ndarray, empty: float) -> np.ndarray:
            out = np.full((len(own), self.k + count.max()), empty, kept.dtype)
            out[:, : self.k] = kept[own]
            out[place] = new
            return out

        scores_, docs = beside(self.score, s, -np.inf), beside(self.doc, doc, np.iinfo(np.int64).max)
        order = np.lexsort((docs, -scores_), axis=1)[:, : self.k]
        self.score[own], self.doc[own] = np.take_along_axis(scores_, order, 1), np.take_along_axis(docs, order, 1)
        if more is not None:
            self.more[own] = np.take_along_axis(beside(self.more, more, -np.inf), order, 1)
        last = self.score[own, -1]
        self.floor[own] = np.where(last == -np.inf, -np.inf, (self.norm[own] ** 2 - last**2) / 2) if self.metric == "euclidean" else last


def chosen(query: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> pa.RecordBatch:
    """query_id, doc_id, score, rank: the k best of each query."""
    ok = score > -np.inf
    query, doc, score = query[ok], doc[ok], score[ok]
    order = np.lexsort((doc, -score, query))
    query, doc, score = query[order], doc[order], score[order]
    _, first, count = np.unique(query, return_index=True, return_counts=True)
    rank = np.arange(len(query)) - np.repeat(first, count) + 1
    ok = rank <= k
    return pa.RecordBatch.from_pydict({"query_id": query[ok].astype(np.int64), "doc_id": doc[ok].astype(np.int64), "score": score[ok], "rank": rank[ok].astype(np.int32)})


FOUND = "query_id long, doc_id long, score double, rank int"


def groups_of(spark: SparkSession, rows: int, k: int) -> int:
    """Groups that so many queries are dealt to: of GROUP at most (fewer where k is large), as many for each core, and no tiny ones."""
    cores = spark.sparkContext.defaultParallelism
    most = max(TILE, min(GROUP, GROUP * 64 // max(1, k)))
    return max(1, min(cores, -(-rows // 512)), cores * -(-rows // (most * cores)) if rows > most else 1)


def dealt(ids: np.ndarray, groups: int) -> np.ndarray:
    """The group of each id, by a hash."""
    z = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((z ^ z >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)


def packed(df: DataFrame, pack: Callable[[pa.RecordBatch], Iterator[dict]], rows: int = BLOCK) -> DataFrame:
    """Rows as blocks: what pack makes of each `rows` of them: part, dim, and bytes a, b and c. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                held.append(b.slice(lo, rows))
                n += held[-1].num_rows
                if n >= rows:
                    yield from blocks(held)
                    held, n = [], 0
        if held:
            yield from blocks(held)

    def blocks(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in pack(pa.Table.from_batches(held).combine_chunks().to_batches()[0]) if sum(b.num_rows for b in held) else ():
            yield pa.RecordBatch.from_arrays([pa.array([x.get(name)], kind) for name, kind in (("part", pa.int32()), ("dim", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()))], names=["part", "dim", "a", "b", "c"])

    return df.mapInArrow(run, "part int, dim int, a binary, b binary, c binary")


def streamed(first: DataFrame, then: DataFrame, groups: int, make: Callable[[], object], schema: str) -> DataFrame:
    """Blocks as packed() gives them. Every group is one task: it takes the blocks of `first` that have its part, then, one after the other, those of `then`: of its part, or all of those that have none. A column parts (array) names the parts instead.
    make() gives an object with first(block), then(block), which may yield rows, and end(). What a task holds is bounded by its part of `first`; the blocks of `then` pass by."""
    parts = F.when(F.col("part").isNull(), F.sequence(F.lit(0), F.lit(groups - 1))).otherwise(F.array("part"))
    both = reduce(DataFrame.unionByName, (x.select(F.explode("parts" if "parts" in x.columns else parts).alias("part"), F.lit(n).alias("n"), "dim", "a", "b", "c") for n, x in enumerate((first, then))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = make()
        for b in batches:
            n, dim = b.column("n").to_pylist(), b.column("dim").to_pylist()
            for i in range(b.num_rows):
                block = (dim[i], *(x.as_buffer() if x.is_valid else b"" for x in (b.column(c)[i] for c in "abc")))
                if n[i]:
                    yield from o.then(*block) or ()
                else:
                    o.first(*block)
        yield from o.end()

    return both.repartitionById(groups, F.col("part")).sortWithinPartitions("n").mapInArrow(run, schema)


def vector_blocks(df: DataFrame, id_col: str, vector: str, groups: int = 0, second: str | None = None) -> DataFrame:
    """Blocks of rows with a vector: a the ids, b the vectors, c another vector of each row if there is one; with groups, each block is of one group."""

    def pack(b: pa.RecordBatch) -> Iterator[dict]:
        m, at = as_matrix(b.column(1))
        if not len(at):
            return
        ids = b.column(0).to_numpy(zero_copy_only=False)[at].astype(np.int64)
        other = as_matrix(b.column(2).take(pa.array(at)))[0] if second else None
        part = dealt(ids, groups) if groups else np.zeros(len(ids), np.int64)
        for g in np.unique(part).tolist():
            own = np.flatnonzero(part == g)
            yield {"part": g if groups else None, "dim": m.shape[1], "a": ids[own].tobytes(), "b": m[own].tobytes(), "c": other[own].tobytes() if second else None}

    rows = df.where(F.size(vector) > 0).select(F.col(id_col).cast("long"), *(F.col(v).cast("array<float>") for v in (vector, second) if v))
    return packed(rows, pack, BLOCK * 16 if groups else BLOCK)  # a block is cut into one a group


class Nearest:
    """The task of batch_knn(); with rescore, blocks hold a second vector (c) by whose score the best of what the first ones find are chosen."""

    def __init__(self, k: int, metric: str, exclude_self: bool = False, rescore: tuple[int, str] | None = None):
        self.k, self.how, self.rescore = k, (metric, exclude_self), rescore
        self.got: dict[int, list] = {}
        self.best: dict[int, Best] = {}
        self.second: dict[int, Best] = {}

    def first(self, dim: int, a: bytes, b: bytes, c: bytes) -> None:
        self.got.setdefault(dim, []).append((np.frombuffer(a, np.int64), np.frombuffer(b, np.float32).reshape(-1, dim), np.frombuffer(c, np.float32).reshape(-1, dim)))

    def _ready(self, dim: int) -> Best | None:
        if dim not in self.best and dim in self.got:
            ids, vectors, other = map(np.concatenate, zip(*self.got.pop(dim)))
            self.best[dim] = Best(ids, vectors, self.k, *self.how, more=self.rescore is not None)
            if self.rescore:
                self.second[dim] = Best(ids, other, 0, self.rescore[1])
        return self.best.get(dim)

    def then(self, dim: int, a: bytes, b: bytes, c: bytes) -> None:
        if best := self._ready(dim):
            more = None
            if self.rescore:
                d = np.frombuffer(c, np.float32).reshape(-1, dim).astype(np.float64)
                norm = np.sqrt(np.einsum("ij,ij->i", d, d))
                more = lambda r, col: self.second[dim]._scores(r, d, norm, col)
            best.add(np.frombuffer(a, np.int64), np.frombuffer(b, np.float32).reshape(-1, dim), more=more)

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.best:
            k = self.rescore[0] if self.rescore else self.k
            yield chosen(*(np.concatenate([x.ravel() for x in xs]) for xs in zip(*((np.repeat(b.ids, self.k), b.doc, b.more if self.rescore else b.score) for b in self.best.values()))), k)


def batch_knn(queries: DataFrame, docs: DataFrame, k: int, metric: str = "cosine", query_id: str = "query_id", id_col: str = "id", vector: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """query_id, doc_id, score, rank: the k best of docs for every query. Queries are dealt to groups; past each group, in a task of its own, go the blocks of docs, of which it keeps each query's best k."""
    if metric not in METRICS:
        raise InvalidConfig(f"metric {metric!r}")
    groups = groups_of(docs.sparkSession, queries.count(), k)
    return streamed(vector_blocks(queries, query_id, vector, groups), vector_blocks(docs, id_col, vector), groups, lambda: Nearest(k, metric, exclude_self), FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k rows of each query_id, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall(approx: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """query_id, recall: the share of the exact k that approx has."""
    hit = exact.join(approx.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    return hit.groupBy("query_id").agg((F.coalesce(F.sum("hit"), F.lit(0)) / F.lit(float(k))).alias("recall"))


def mean_recalls(found: DataFrame, exact: DataFrame, k: int, names: list[str]) -> DataFrame:
    """name, queries, recall: the mean recall of what each name has found (query_id, doc_id, name), all against one pass over the exact k."""
    by = found.groupBy("query_id", "doc_id").agg(F.collect_set("name").alias("names"))
    hit = exact.join(by, ["query_id", "doc_id"], "left").groupBy("query_id")
    shares = hit.agg(*((F.coalesce(F.sum(F.array_contains("names", name).cast("int")), F.lit(0)) / F.lit(float(k))).alias(f"r{i}") for i, name in enumerate(names)))
    means = shares.agg(F.count("*").alias("queries"), *(F.avg(f"r{i}").alias(f"r{i}") for i in range(len(names))))
    return means.select("queries", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.col(f"r{i}").alias("recall")) for i, name in enumerate(names)))).alias("x")).select("x.name", "queries", "x.recall")
