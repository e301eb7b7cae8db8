"""Navigable small-world graphs, one a shard: built and searched where the shard lies, the shards' best merged. Stored graphs are read back, so that a search builds nothing.

With codes, a beam walks over vectors quantized to signed bytes, and the best of what it finds are scored again by the vectors themselves.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidConfig
from ..sources.versions import Versions
from .base import Index
from .search import as_matrix, ranked, streamed, vector_blocks

_MASK = (1 << 64) - 1
#: Rows and columns of the matrix products in which a graph's neighbours are sought.
ROWS, COLUMNS = 512, 4096


@dataclass(frozen=True)
class Config:
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 50
    metric: str = "cosine"
    shard_rows: int = 50_000
    #: Beams over signed bytes, rescored.
    codes: bool = False

    def __post_init__(self) -> None:
        if self.m < 2 or self.ef_construction < 1 or self.ef_search < 1 or self.shard_rows < 1:
            raise InvalidConfig("m must be 2 or more, the others positive")


def _level(node: int, m: int) -> int:
    """A function of the node alone, so that a rebuilt graph is the same."""
    z = (node + 1) * 0x9E3779B97F4A7C15 & _MASK
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    z = (z ^ z >> 27) * 0x94D049BB133111EB & _MASK
    return int(-math.log(((z ^ z >> 31) + 1) / 2.0**64) / math.log(m))


class Graph:
    """nodes: of each layer its nodes, ascending; links: of each layer a row a node of places among them, -1 where there are fewer.

    What a node is linked to when it comes is chosen among the nearest ef_construction of the nodes before it. These are found exactly, by matrix products of blocks, which takes time with the square of the
    shard's rows but less than a beam for each node: a shard is bounded by shard_rows. What links to a node is then thinned once, with its own links, to as many as a node may have."""

    def __init__(self, vectors: np.ndarray, config: Config):
        self.config = config
        v = vectors.astype(np.float32)
        if config.metric == "cosine":
            n = np.linalg.norm(v, axis=1, keepdims=True)
            v = v / np.where(n == 0, 1, n)
        self.v = v
        self.codes: np.ndarray | None = None
        level = np.array([_level(node, config.m) for node in range(len(v))], np.int64)
        self.nodes = [np.flatnonzero(level >= at) for at in range(level.max() + 1)] if len(v) else []
        self.links = [self._linked(v[nodes], at) for at, nodes in enumerate(self.nodes)]
        if config.codes and len(v):
            lo, hi = v.min(0), v.max(0)
            self.scale, self.bias = np.where(hi > lo, (hi - lo) / 255, 1).astype(np.float32), (hi + lo) / 2
            self.codes = self._encode(v)

    def _encode(self, x: np.ndarray) -> np.ndarray:
        y = (x - self.bias) / self.scale
        return np.clip(np.copysign(np.floor(np.abs(y) + 0.5), y), -128, 127).astype(np.int8)

    def _pairs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Scores of the pairs of rows; for Euclidean minus the squares."""
        if self.config.metric == "euclidean":
            return -np.einsum("ij,ij->i", x - y, x - y)
        return np.einsum("ij,ij->i", x, y)

    def _linked(self, v: np.ndarray, layer: int) -> np.ndarray:
        m, most, diverse = self.config.m, self.config.m * (1 if layer else 2), not layer
        n, euclidean = len(v), self.config.metric == "euclidean"
        square = np.einsum("ij,ij->i", v, v)
        own = np.full((n, m), -1, np.int32)
        for lo in range(0, n, ROWS):
            x = v[lo : lo + ROWS]
            s, at = np.full((len(x), 0), -np.inf, np.float32), np.zeros((len(x), 0), np.int32)
            for left in range(0, lo + len(x), COLUMNS):
                right = min(left + COLUMNS, lo + len(x))
                t = x @ v[left:right].T
                if euclidean:
                    t = 2 * t - square[left:right] - square[lo : lo + len(x), None]
                places = np.arange(left, right, dtype=np.int32)
                if right > lo:
                    t[places[None] >= np.arange(lo, lo + len(x))[:, None]] = -np.inf
                s, at = np.concatenate([s, t], 1), np.concatenate([at, np.broadcast_to(places, t.shape)], 1)
                s, at = _top(s, at, self.config.ef_construction)
            own[lo : lo + len(x)] = self._select(v, square, *_sorted(s, at), m, diverse)
        source = np.repeat(np.arange(n, dtype=np.int32), m)[(ok := own.ravel() >= 0)]
        target = own.ravel()[ok]
        source, target = np.concatenate([source, target]), np.concatenate([target, source])
        order = np.lexsort((target, source))
        source, target = source[order], target[order]
        count = np.bincount(source, minlength=n)
        begin = np.cumsum(count) - count
        links = np.full((n, most), -1, np.int32)
        few = count[source] <= most
        links[source[few], (np.arange(len(source)) - begin[source])[few]] = target[few]
        many = np.flatnonzero(count > most)
        many = many[np.argsort(count[many], kind="stable")]
        while len(many):  # of like numbers, so that little is padded
            width = count[many[min(len(many), ROWS) - 1]]
            some = many[: max(1, min(ROWS, ROWS * 256 // width))]
            width = count[some].max()
            place = begin[some, None] + np.arange(width)
            there = np.arange(width) < count[some, None]
            at = np.where(there, target[np.minimum(place, len(target) - 1)], -1)
            r, c = np.nonzero(there)
            s = np.full(at.shape, -np.inf, np.float32)
            s[r, c] = self._pairs(v[some[r]], v[at[r, c]])
            links[some] = self._select(v, square, *_sorted(s, at), most, diverse)
            many = many[len(some) :]
        return links

    def _select(self, v: np.ndarray, square: np.ndarray, s: np.ndarray, at: np.ndarray, most: int, diverse: bool) -> np.ndarray:
        """Of each row's places, best first, up to `most`: half of them such that aren't closer to one chosen before than to the node, the others by closeness."""
        width = at.shape[1]
        picked = np.zeros(at.shape, bool)
        if diverse:
            half = max(1, most // 2)
            taken, count = np.full((len(at), half), -1, np.int64), np.zeros(len(at), np.int64)
            near = np.zeros((len(at), half, v.shape[1]), np.float32)
            live = np.flatnonzero((at >= 0).sum(1) > most)
            for t in range(width):
                live = live[(count[live] < half) & (at[live, t] >= 0)]
                if not len(live):
                    break
                x = at[live, t]
                like = np.matmul(near[live], v[x][:, :, None])[:, :, 0]
                if self.config.metric == "euclidean":
                    like = 2 * like - square[x][:, None] - square[taken[live]]
                like[np.arange(half) >= count[live, None]] = -np.inf
                ok = like.max(1) <= s[live, t]
                rows = live[ok]
                near[rows, count[rows]], taken[rows, count[rows]], picked[rows, t] = v[x[ok]], x[ok], True
                count[rows] += 1
        order = np.argsort(np.where(picked, 0, np.where(at >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
        out = np.full((len(at), most), -1, np.int32)
        out[:, : order.shape[1]] = np.take_along_axis(at, order, 1)
        return out

    def _beam(self, x: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """The ef best that a beam finds for each query among the vectors or codes x of the layer, best first: scores and places, -1 where there are fewer. All beams go one step at a time."""
        links = self.links[layer]
        n, width = len(q), links.shape[1]
        out_s, out_at = np.full((n, ef), -np.inf, np.float32), np.full((n, ef), -1, np.int32)
        rows, left = np.arange(n), np.arange(n)
        seen = np.zeros((n, len(links)), bool)
        seen[rows, start] = True
        s, at, done = np.full((n, ef + width), -np.inf, np.float32), np.full((n, ef + width), -1, np.int32), np.ones((n, ef + width), bool)
        s[:, 0], at[:, 0], done[:, 0] = self._pairs(x[start].astype(np.float32), q), start, False
        while len(rows):
            best = np.where(done[:, :ef], -np.inf, s[:, :ef]).argmax(1)
            more = ~done[rows, best]
            if 2 * more.sum() <= len(rows):  # the others are through
                out_s[left[~more]], out_at[left[~more]] = s[~more, :ef], at[~more, :ef]
                left, q, seen, s, at, done, best = (z[more] for z in (left, q, seen, s, at, done, best))
                rows, more = np.arange(len(left)), np.ones(len(left), bool)
                if not len(rows):
                    break
            done[rows, best] = True
            new = links[at[rows, best]]
            r, c = np.nonzero((new >= 0) & ~seen[rows[:, None], new] & more[:, None])
            node = new[r, c]
            seen[r, node] = True
            s[:, ef:], done[:, ef:] = -np.inf, True
            s[r, ef + c], at[r, ef + c], done[r, ef + c] = self._pairs(x[node].astype(np.float32), q[r]), node, False
            changed = np.unique(r[s[r, ef + c] > s[r, :ef].min(1)])
            if len(changed):
                order = np.argpartition(-s[changed], ef - 1, axis=1)[:, :ef]
                s[changed, :ef], at[changed, :ef], done[changed, :ef] = (np.take_along_axis(z[changed], order, 1) for z in (s, at, done))
        return _sorted(out_s, np.where(out_s > -np.inf, out_at, -1))

    def search_many(self, queries: np.ndarray, k: int, ef: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scores and nodes, best first, a row a query; -1 where fewer are found."""
        n = len(queries)
        if not self.nodes or k <= 0 or not n:
            return np.zeros((n, 0)), np.zeros((n, 0), np.int64)
        step = max(16, min(256, (1 << 25) // len(self.v)))  # so that what beams have seen stays small
        if n > step:
            s, at = zip(*(self.search_many(queries[lo : lo + step], k, ef) for lo in range(0, n, step)))
            return np.concatenate(s), np.concatenate(at)
        q = queries.astype(np.float32)
        if self.config.metric == "cosine":
            size = np.linalg.norm(q, axis=1, keepdims=True)
            q = q / np.where(size == 0, 1, size)
        coded = self.codes is not None
        walk, x = (self._encode(q).astype(np.float32), self.codes) if coded else (q, self.v)
        at = np.zeros(n, np.int64)  # the first of the highest nodes is where all begin
        for layer in range(len(self.nodes) - 1, 0, -1):
            _, found = self._beam(x[self.nodes[layer]], walk, at, 1, layer)
            at = np.searchsorted(self.nodes[layer - 1], self.nodes[layer][found[:, 0]])
        _, at = self._beam(x, walk, at, max(ef or self.config.ef_search, 5 * k if coded else k), 0)
        at = at[:, : 2 * k if coded else k]  # of codes the best 2k, in the order of their vectors
        r, c = np.nonzero(at >= 0)
        s = np.full(at.shape, -np.inf)
        s[r, c] = self._pairs(self.v[at[r, c]].astype(np.float64), q[r].astype(np.float64))
        if self.config.metric == "euclidean":
            s = 0.0 - np.sqrt(-s)
        s, at = _sorted(s, at)
        return s[:, :k], at[:, :k]

    def search(self, query: np.ndarray, k: int, ef: int | None = None) -> list[tuple[float, int]]:
        s, at = self.search_many(np.asarray(query)[None], k, ef)
        return [(t, n) for t, n in zip(s.ravel().tolist(), at.ravel().tolist()) if n >= 0]


def _top(s: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the n best, in no order."""
    if s.shape[1] <= n:
        return s, at
    order = np.argpartition(-s, n - 1, axis=1)[:, :n]
    return np.take_along_axis(s, order, 1), np.take_along_axis(at, order, 1)


def _sorted(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row best first, equal ones by place; -1 where there is none."""
    order = np.lexsort((at, -s), axis=1)
    s = np.take_along_axis(s, order, 1)
    return s, np.where(s > -np.inf, np.take_along_axis(at, order, 1), -1)


class _Walks:
    """The task of search_batch(): one shard's graph, and the queries that pass by."""

    def __init__(self, k: int, ef: int | None):
        self.k, self.ef, self.graph = k, ef, None

    def first(self, dim: int, a: bytes, b: bytes, c: bytes) -> None:
        self.graph, self.ids = pickle.loads(a), np.frombuffer(b, np.int64)  # noqa: S301 what build() wrote

    def then(self, dim: int, a: bytes, b: bytes, c: bytes) -> Iterator[pa.RecordBatch]:
        if self.graph is not None:
            ids = np.frombuffer(a, np.int64)
            s, at = self.graph.search_many(np.frombuffer(b, np.float32).reshape(-1, dim), self.k, self.ef)
            r, c = np.nonzero(at >= 0)
            yield pa.RecordBatch.from_pydict({"query_id": ids[r], "doc_id": self.ids[at[r, c]], "score": s[r, c]})

    def end(self) -> Iterator[pa.RecordBatch]:
        return iter(())


class Hnsw(Index):
    """shards: a row for each with its number (below n), pickled graph and ids. Rows without a vector are left out."""

    def __init__(self, config: Config, shards: DataFrame, docs: DataFrame, id_col: str, vector: str, n: int):
        self.n = n
        self.config, self.shards, self.docs, self.id_col, self.vector = config, shards, docs, id_col, vector

    @classmethod
    def build(cls, docs: DataFrame, config: Config, id_col: str = "id", vector: str = "embedding") -> Hnsw:
        rows = docs.where(F.size(vector) > 0).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
        n = max(1, -(-rows.count() // config.shard_rows))
        rows = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if held:  # a partition is a shard
                t = pa.Table.from_batches(held).sort_by("id")
                x, _ = as_matrix(t["v"].combine_chunks())
                yield pa.RecordBatch.from_arrays([t["shard"][:1].combine_chunks(), pa.array([pickle.dumps(Graph(x, config), 5)], pa.binary()), pa.array([t["id"].to_numpy().astype(np.int64).tobytes()], pa.binary())], names=["shard", "graph", "ids"])

        shards = rows.repartitionById(n, F.col("shard")).mapInArrow(run, "shard int, graph binary, ids binary")
        return cls(config, shards, docs, id_col, vector, n)

    def save(self, path: str) -> Hnsw:
        """Writes the graphs, once built, and gives the index as stored. Readers of a version that is replaced keep theirs."""
        v = Versions(self.docs.sparkSession, path)
        new = v.begin()
        self.shards.withColumn("config", F.lit(repr(self.config))).write.parquet(new)
        v.commit(new)
        return Hnsw.load(path, self.docs, self.config, self.id_col, self.vector)

    @classmethod
    def load(cls, path: str, docs: DataFrame, config: Config, id_col: str = "id", vector: str = "embedding") -> Hnsw:
        """The stored graphs, if they were built so; searches may widen ef_search."""
        now = Versions(docs.sparkSession, path).current()
        if now is None:
            raise FileNotFoundError(path)
        shards = docs.sparkSession.read.parquet(now)
        if "shard" not in shards.columns:  # of before shards had numbers
            raise FileNotFoundError(path)
        built = shards.select("config").first()
        if built is not None and replace(eval(built[0], {"Config": Config}), ef_search=config.ef_search) != config:  # noqa: S307 what save() wrote
            raise InvalidConfig("the stored graphs have another configuration")
        n = shards.agg(F.max("shard")).first()[0]
        return cls(config, shards.drop("config"), docs, id_col, vector, 1 if n is None else n + 1)

    def search_batch(self, queries: DataFrame, k: int, ef: int | None = None) -> DataFrame:
        """queries: query_id, embedding. query_id, doc_id, score, rank. Queries are dealt to slices; a task is a graph and a slice, whose blocks pass by."""
        spark = self.docs.sparkSession
        slices = max(1, min(-(-queries.count() // 512), -(-2 * spark.sparkContext.defaultParallelism // self.n)))
        none = F.lit(None)
        begin = F.col("shard") * slices
        graphs = self.shards.select(F.sequence(begin, begin + (slices - 1)).alias("parts"), none.cast("int").alias("dim"), F.col("graph").alias("a"), F.col("ids").alias("b"), none.cast("binary").alias("c"))
        asked = vector_blocks(queries, "query_id", "embedding", slices)
        asked = asked.withColumn("parts", F.transform(F.sequence(F.lit(0), F.lit(self.n - 1)), lambda s: s * slices + F.col("part")))
        return ranked(streamed(graphs, asked, self.n * slices, lambda: _Walks(k, ef), "query_id long, doc_id long, score double"), k)

    def search(self, query: Sequence[float], k: int, ef: int | None = None) -> DataFrame:
        q = self.docs.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id long, embedding array<float>")
        return self.search_batch(q, k, ef).drop("query_id")

    def search_filtered(self, query: Sequence[float], k: int, where: Column) -> DataFrame:
        """Over-fetches max(5k, twice ef_search), then filters; fewer than k may be left."""
        top = self.search(query, max(5 * k, 2 * self.config.ef_search)).drop("rank")
        rows = self.docs.join(F.broadcast(top), F.col(self.id_col) == F.col("doc_id")).where(where)
        return rows.select("doc_id", "score").orderBy(F.desc("score"), "doc_id").limit(max(0, k))

    def delete(self, ids: DataFrame) -> Hnsw:
        left = self.docs.join(ids.select(F.col("id").alias("_gone")), F.col(self.id_col) == F.col("_gone"), "left_anti")
        return Hnsw.build(left, self.config, self.id_col, self.vector)
