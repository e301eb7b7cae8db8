"""Inverted file with product quantization: codes as a table partitioned by cell, search by lookup tables over the probed cells."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InvalidConfig
from ..functions.distance import score_query, scores
from ..sources.versions import Versions
from .base import Index
from .kmeans import SAMPLE, kmeans, nearest
from .search import BLOCK, FOUND, Best, as_matrix, chosen, groups_of, packed, streamed, vector_blocks

#: Neighbours whose recall is calibrated, and most queries for that.
RECALL_K, CALIBRATION = 10, 500


@dataclass(frozen=True)
class Config:
    n_clusters: int = 256
    n_subvectors: int = 8
    n_probe: int = 8
    metric: str = "cosine"
    rerank: bool = False
    rebuild_threshold: float = 0.20
    batch_rebuild_size: int = 1000
    #: Mean recall of the best RECALL_K that build() sees to: n_probe is then where the choice of probes begins, as calibrate() finds them. 0: n_probe as it stands.
    recall: float = 0.0

    def __post_init__(self) -> None:
        if self.n_subvectors <= 0 or self.n_subvectors % 8:
            raise InvalidConfig("n_subvectors must be a positive multiple of 8")
        if self.n_clusters <= 0 or self.n_probe <= 0 or self.batch_rebuild_size <= 0 or self.rebuild_threshold < 0:
            raise InvalidConfig("cells, probes and batch size must be positive, the threshold not negative")
        if not 0 <= self.recall < 1:
            raise InvalidConfig("recall must be in [0, 1)")

    @property
    def effective_probe(self) -> int:
        """A rerank allows half the probes, 2 at least."""
        return max(self.n_probe // 2, 2) if self.rerank else self.n_probe


@dataclass
class Quantizer:
    centroids: np.ndarray
    codebooks: np.ndarray  # m x codes x width
    metric: str

    @property
    def width(self) -> int:
        return self.codebooks.shape[2]

    def prepared(self, x: np.ndarray) -> np.ndarray:
        """For cosine, vectors of length 1, so that sums over subvectors are cosines."""
        x = np.asarray(x, np.float64)
        if self.metric != "cosine":
            return x
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(n == 0, 1, n)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells and codes."""
        x = self.prepared(x)
        cell = nearest(x, self.centroids, self.metric)
        codes = np.stack([nearest(x[:, j * self.width : (j + 1) * self.width], book) for j, book in enumerate(self.codebooks)], 1)
        return cell, codes.astype(np.uint8)

    def table(self, q: np.ndarray) -> np.ndarray:
        """m x codes: what each code adds to the score. For Euclidean: minus the squared distance."""
        q = self.prepared(q[None])[0]
        out = []
        for j, book in enumerate(self.codebooks):
            part = q[j * self.width : (j + 1) * self.width]
            out.append(-((book - part) ** 2).sum(1) if self.metric == "euclidean" else book @ part)
        return np.stack(out)

    def probes(self, q: np.ndarray, n: int) -> list[int]:
        s = scores(self.prepared(q[None]), self.centroids, self.metric)[0]
        return np.lexsort((np.arange(len(s)), -s))[:n].tolist()


def train(x: np.ndarray, config: Config, each: Callable[[Callable, list], list] = lambda f, xs: [f(x) for x in xs]) -> Quantizer:
    """each: how the codebooks, one a list of subvectors, are trained, here one after the other."""
    if x.shape[1] < config.n_subvectors:
        raise InvalidConfig("fewer dimensions than subvectors")
    q = Quantizer(np.zeros((0, 0)), np.zeros((0, 0, 0)), config.metric)
    x = q.prepared(x)
    q.centroids, _ = kmeans(x, min(config.n_clusters, len(x)), config.metric)
    width = x.shape[1] // config.n_subvectors
    n = min(256, len(x))
    q.codebooks = np.stack(each(lambda part: kmeans(part, n)[0], [np.ascontiguousarray(x[:, j * width : (j + 1) * width]) for j in range(config.n_subvectors)]))
    return q


def calibrate(x: np.ndarray, q: Quantizer, config: Config) -> tuple[int, int]:
    """Probes and rerank depth (rows a result) with which the mean recall of the best RECALL_K of x reaches config.recall, less two standard errors; each of the first CALIBRATION rows is a query.
    Cells are tried from effective_probe up to all; only if all don't do is the depth doubled, as far as x goes. Without a rerank codes alone may never reach it: then all cells."""
    n, cells, k = len(x), len(q.centroids), min(RECALL_K, len(x))
    cell, codes = q.encode(x)
    prepared = q.prepared(x)
    at, ranks = np.zeros((min(n, CALIBRATION), k), np.int64), np.zeros((min(n, CALIBRATION), k, cells), np.int64)
    best = Best(np.arange(len(at)), prepared[: len(at)], k, config.metric)
    for lo in range(0, n, BLOCK):
        best.add(np.arange(lo, min(n, lo + BLOCK)), prepared[lo : lo + BLOCK])
    for i in range(len(at)):
        true = best.doc[i]
        order = np.empty(cells, np.int64)
        order[q.probes(x[i], cells)] = np.arange(cells)
        turn = order[cell]
        table = q.table(x[i])
        code = sum(table[j][codes[:, j]] for j in range(codes.shape[1]))
        at[i] = turn[true]
        for j, t in enumerate(true.tolist()):  # rows with a code as good or better, by the probe that reaches them
            ranks[i, j] = np.cumsum(np.bincount(turn[code >= code[t]], minlength=cells))
    depth = 4
    while True:
        most = depth * k if config.rerank else k
        for p in range(min(config.effective_probe, cells), cells + 1):
            hit = ((at < p) & (ranks[:, :, p - 1] <= most)).mean(1)
            if hit.mean() - 2 * hit.std() / np.sqrt(len(hit)) * (len(hit) < n) >= config.recall:
                return p, depth
        if not config.rerank or most >= n:
            return cells, depth
        depth *= 2


class _Probing:
    """The task of search_batch(). A code stands for the vector that its codebooks spell, of which a query's table adds up the products."""

    def __init__(self, q: Quantizer, n_probe: int, most: int, k: int, rerank: str | None):
        self.q, self.n_probe, self.most, self.k, self.rerank = q, n_probe, most, k, rerank
        self.got: list[tuple[np.ndarray, np.ndarray]] = []
        self.best: Best | None = None

    def first(self, dim: int, a: bytes, b: bytes, c: bytes) -> None:
        self.got.append((np.frombuffer(a, np.int64), np.frombuffer(b, np.float32).reshape(-1, dim)))

    def _begin(self) -> None:
        ids, vectors = map(np.concatenate, zip(*self.got))
        x, cells = self.q.prepared(vectors), len(self.q.centroids)
        of = [np.zeros(0, np.int64)]
        for lo in range(0, len(x), BLOCK):
            s = scores(x[lo : lo + BLOCK], self.q.centroids, self.q.metric)
            of.append(np.argsort(-s, axis=1, kind="stable")[:, : self.n_probe].ravel())
        cell, row = np.concatenate(of), np.repeat(np.arange(len(x)), min(self.n_probe, cells))
        order = np.argsort(cell, kind="stable")
        self.rows = np.split(row[order], np.cumsum(np.bincount(cell, minlength=cells))[:-1])  # by cell the queries that probe it
        self.best = Best(ids, x[:, : self.q.width * len(self.q.codebooks)], self.most, "euclidean" if self.q.metric == "euclidean" else "dot", more=self.rerank is not None)
        self.exact = Best(ids, vectors, 0, self.rerank) if self.rerank else None
        self.got = []

    def then(self, dim: int | None, a: bytes, b: bytes, c: bytes) -> None:
        if self.got:
            self._begin()
        if self.best is None:
            return
        ids, cids = np.frombuffer(a, np.int64).reshape(2, -1)
        codes = np.frombuffer(b, np.uint8).reshape(len(ids), -1)
        d = np.frombuffer(c, np.float32).reshape(len(ids), -1) if self.rerank else None
        more = None
        for cid, lo, n in zip(*(x.tolist() for x in np.unique(cids, return_index=True, return_counts=True))):
            own = slice(lo, lo + n)
            if self.rerank:
                v = d[own].astype(np.float64)
                norm = np.sqrt(np.einsum("ij,ij->i", v, v))
                more = lambda r, col: np.nan_to_num(self.exact._scores(r, v, norm, col), nan=-np.inf)  # noqa: B023, E731
            self.best.add(ids[own], np.concatenate([book[codes[own, j]] for j, book in enumerate(self.q.codebooks)], 1), self.rows[cid], more)

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.best is not None:
            b = self.best
            yield chosen(np.repeat(b.ids, self.most), b.doc.ravel(), (b.more if self.rerank else b.score).ravel(), self.k)


class IvfPq(Index):
    """codes: id, cid, code, live. Training and calibration take a bounded sample, by the smallest hashes of ids; encoding covers every row."""

    def __init__(self, config: Config, quantizer: Quantizer, codes: DataFrame, docs: DataFrame, id_col: str = "id", vector: str = "embedding", effort: tuple[int, int] | None = None, stale: int = 0):
        self.stale = stale  # rows encoded since the training
        self.config, self.quantizer, self.codes, self.docs, self.id_col, self.vector = config, quantizer, codes, docs, id_col, vector
        self.effort = self.n_probe, self.depth = effort or (config.effective_probe, 4)

    @classmethod
    def build(cls, docs: DataFrame, config: Config, id_col: str = "id", vector: str = "embedding", sample: int = SAMPLE) -> IvfPq:
        rows = docs.where(F.size(vector) > 0).select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
        some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
        x, _ = as_matrix(some["v"].combine_chunks() if len(some) else pa.array([], pa.list_(pa.float32())))
        if not len(x):
            raise InvalidConfig("no vectors to train on")
        sc = docs.sparkSession.sparkContext
        q = train(x, config, lambda f, xs: sc.parallelize(xs, len(xs)).map(f).collect())  # a task a codebook
        return cls(config, q, encode(rows, q), docs, id_col, vector, calibrate(x, q, config) if config.recall else None)

    def search_batch(self, queries: DataFrame, k: int) -> DataFrame:
        """queries: query_id, embedding. query_id, doc_id, score, rank: for every query what search() gives. Codes go by in blocks, with their vectors where these score again; a task holds its queries and their best."""
        most = self.depth * k if self.config.rerank else k
        spark = self.codes.sparkSession
        quantizer = spark.sparkContext.broadcast(self.quantizer)
        n_probe, metric, rerank = self.n_probe, self.config.metric, self.config.rerank
        rows = self.codes.where("live").select(F.col("id").cast("long").alias("id"), F.col("cid").cast("long").alias("cid"), "code")
        if rerank:
            docs = self.docs.select(F.col(self.id_col).cast("long").alias("_id"), F.col(self.vector).cast("array<float>").alias("_v"))
            rows = rows.join(docs, F.col("id") == F.col("_id"), "left").drop("_id")

        def pack(b: pa.RecordBatch) -> Iterator[dict]:
            b = b.take(pa.array(np.argsort(b.column(1).to_numpy(), kind="stable")))
            out = {"a": np.stack([b.column(c).to_numpy() for c in (0, 1)]).astype(np.int64).tobytes(), "b": b"".join(b.column(2).to_pylist())}
            if rerank:
                m, at = as_matrix(b.column(3))
                v = np.full((b.num_rows, m.shape[1]), np.nan, np.float32)  # a code without its vector takes its place, but isn't found
                v[at] = m
                out |= {"dim": m.shape[1], "c": v.tobytes()}
            yield out

        groups = groups_of(spark, queries.count(), most)
        make = lambda: _Probing(quantizer.value, n_probe, most, k, metric if rerank else None)
        return streamed(vector_blocks(queries, "query_id", "embedding", groups), packed(rows, pack, 4 * BLOCK), groups, make, FOUND)

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        """id, score: the best k live rows of the probed cells by their codes or, with rerank, of those the best k of depth * k (depth: 4, or as calibrated) by exact scores."""
        q = np.asarray(query, np.float64)
        table = self.quantizer.table(q)
        rows = self.codes.where(F.col("cid").isin(self.quantizer.probes(q, self.n_probe)) & F.col("live"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    codes = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                    s = table[np.arange(codes.shape[1])[None], codes].sum(1)
                    s = -np.sqrt(-np.minimum(s, 0)) if self_metric == "euclidean" else s
                    yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(s)], names=["id", "score"])

        self_metric = self.config.metric
        kind = self.codes.schema["id"].dataType.simpleString()
        found = rows.select("id", "code").mapInArrow(run, f"id {kind}, score double").orderBy(F.desc("score"), "id")
        if not self.config.rerank:
            return found.limit(max(0, k))
        top = found.limit(self.depth * k).select(F.col("id").alias("_found"))
        exact = self.docs.join(F.broadcast(top), F.col(self.id_col) == F.col("_found")).select(F.col(self.id_col).alias("id"), score_query(F.col(self.vector), query, self.config.metric).alias("score"))
        return exact.orderBy(F.desc("score"), "id").limit(max(0, k))

    def search_filtered(self, query: Sequence[float], k: int, where) -> DataFrame:  # noqa: ANN001
        """Over-fetches max(3k, twice the probes), then filters; fewer than k may be left."""
        top = self.search(query, max(3 * k, 2 * self.config.n_probe)).withColumnRenamed("id", "_found")
        rows = self.docs.join(F.broadcast(top), F.col(self.id_col) == F.col("_found")).where(where)
        return rows.select(F.col(self.id_col).alias("id"), "score").orderBy(F.desc("score"), "id").limit(max(0, k))

    def delete(self, ids: DataFrame) -> IvfPq:
        """ids: id. Marks rows as dead; compacts once dead rows reach the threshold."""
        gone = ids.select(F.col("id").alias("_gone")).distinct()
        codes = self.codes.join(gone, F.col("id") == F.col("_gone"), "left").withColumn("live", F.col("live") & F.col("_gone").isNull()).drop("_gone")
        out = IvfPq(self.config, self.quantizer, codes, self.docs.join(gone, F.col(self.id_col) == F.col("_gone"), "left_anti"), self.id_col, self.vector, self.effort, self.stale)
        return out.compact() if out.dead_ratio() >= self.config.rebuild_threshold else out

    def dead_ratio(self) -> float:
        return self.codes.agg(F.avg((~F.col("live")).cast("int"))).first()[0] or 0.0

    def compact(self) -> IvfPq:
        return IvfPq(self.config, self.quantizer, self.codes.where("live"), self.docs, self.id_col, self.vector, self.effort, self.stale)

    def insert(self, docs: DataFrame) -> IvfPq:
        """Small batches are encoded with the present codebooks; a batch of batch_rebuild_size rows, or too many rows encoded so since the training, trains anew."""
        everything = self.docs.unionByName(docs)
        n = docs.count()
        if n >= self.config.batch_rebuild_size or (self.stale + n) / max(1, everything.count()) >= self.config.rebuild_threshold:
            return IvfPq.build(everything, self.config, self.id_col, self.vector)
        more = encode(docs.where(F.size(self.vector) > 0).select(F.col(self.id_col).alias("id"), F.col(self.vector).alias("v")), self.quantizer)
        return IvfPq(self.config, self.quantizer, self.codes.unionByName(more), everything, self.id_col, self.vector, self.effort, self.stale + n)

    def save(self, path: str) -> IvfPq:
        """Codes by cell, so that a search reads the probed cells' files alone, as a log of revisions; the model beside them. A version of its own: readers keep theirs, a failed write changes nothing."""
        spark = self.codes.sparkSession
        v = Versions(spark, path)
        new = v.begin()
        self._log(0).write.partitionBy("cid").parquet(f"{new}/codes")
        q, c = self.quantizer, self.config
        row = [(json.dumps(asdict(c)), q.centroids.astype("<f8").tobytes(), q.codebooks.astype("<f8").tobytes(), list(q.centroids.shape), list(q.codebooks.shape), list(self.effort), self.stale)]
        spark.createDataFrame(row, "config string, centroids binary, codebooks binary, cs array<int>, bs array<int>, effort array<int>, stale long").coalesce(1).write.parquet(f"{new}/model")
        v.commit(new)
        return IvfPq.load(path, self.docs, self.id_col, self.vector)

    def _log(self, revision: int) -> DataFrame:
        return self.codes.select("id", "code", (~F.col("live")).alias("deleted"), F.lit(revision).cast("long").alias("revision"), "cid")

    @classmethod
    def load(cls, path: str, docs: DataFrame, id_col: str = "id", vector: str = "embedding", **changes) -> IvfPq:
        """Of each id the last revision counts; a delete mark is a dead row."""
        spark = docs.sparkSession
        now = Versions(spark, path).current()
        if now is None:
            raise FileNotFoundError(path)
        r = spark.read.parquet(f"{now}/model").first()
        config = replace(Config(**json.loads(r["config"])), **changes)
        q = Quantizer(np.frombuffer(r["centroids"], "<f8").reshape(r["cs"]), np.frombuffer(r["codebooks"], "<f8").reshape(r["bs"]), config.metric)
        log = spark.read.parquet(f"{now}/codes").select("id", "code", "deleted", "revision", F.col("cid").cast("int").alias("cid"))
        # a log without appends has one revision an id: nothing to sort out, and a search reads its cells alone
        rows = latest(log) if log.agg(F.max("revision")).first()[0] else log
        codes = rows.select("id", "code", (~F.col("deleted")).alias("live"), "cid")
        return cls(config, q, codes, docs, id_col, vector, tuple(r["effort"]) if config.recall else None, r["stale"])

    @staticmethod
    def append(path: str, more: DataFrame, gone: DataFrame | None = None) -> None:
        """Adds revisions to the stored log: more (id, code, live, cid, as encode() gives) and delete marks for gone (id). Nothing that is stored is rewritten."""
        spark = more.sparkSession
        now = Versions(spark, path).current()
        log = spark.read.parquet(f"{now}/codes")
        n = (log.agg(F.max("revision")).first()[0] or 0) + 1
        rows = more.select("id", "code", F.lit(False).alias("deleted"), F.lit(n).cast("long").alias("revision"), "cid")
        if gone is not None:  # a mark goes to the cell of the row that it ends
            ends = log.join(gone.select(F.col("id").alias("_gone")).distinct(), F.col("id") == F.col("_gone"), "left_semi").groupBy("id").agg(F.max_by("cid", "revision").cast("int").alias("cid"))
            rows = rows.unionByName(ends.select("id", F.lit(b"").alias("code"), F.lit(True).alias("deleted"), F.lit(n).cast("long").alias("revision"), "cid"))
        rows.write.mode("append").partitionBy("cid").parquet(f"{now}/codes")

    @staticmethod
    def compact_log(spark: SparkSession, path: str, threshold: float) -> bool:
        """Rewrites the log with the live rows alone if the share of others reaches the threshold."""
        v = Versions(spark, path)
        now = v.current()
        log = spark.read.parquet(f"{now}/codes")
        live = latest_revisions(log)
        total = log.count()
        if not total or (total - live.count()) / total < threshold:
            return False
        new = v.begin()
        live.withColumn("revision", F.lit(0).cast("long")).write.partitionBy("cid").parquet(f"{new}/codes")
        spark.read.parquet(f"{now}/model").write.parquet(f"{new}/model")
        v.commit(new)
        return True


def encode(rows: DataFrame, q: Quantizer) -> DataFrame:
    """rows: id, v. id, code, live, cid."""
    shared = rows.sparkSession.sparkContext.broadcast(q)  # centroids and codebooks: their size is the configuration's, not the data's
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, at = as_matrix(b.column("v"))
            if len(at):
                cell, codes = shared.value.encode(x)
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(np.ones(len(at), bool)), pa.array(cell.astype(np.int32))], names=["id", "code", "live", "cid"])

    return rows.mapInArrow(run, f"id {kind}, code binary, live boolean, cid int")


def latest(log: DataFrame) -> DataFrame:
    """The last revision of each id; of equal revisions one."""
    order = Window.partitionBy("id").orderBy(F.desc("revision"))
    return log.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def latest_revisions(log: DataFrame) -> DataFrame:
    """Of an append-only log (id, revision, deleted, ...) the live rows: the last revision of each id, unless it is a delete mark."""
    return latest(log).where("not deleted")


def read_jsonl_log(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """A log of lines {"id", "cluster", "code", "d"}, later lines counting: id, code, live, cid, and how many lines were corrupt and left out."""
    lines = spark.read.schema("id string, cluster int, code array<int>, d int, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).select("*", F.monotonically_increasing_id().alias("revision")).cache()
    ok = F.col("_bad").isNull() & F.col("id").isNotNull() & F.col("cluster").isNotNull()
    bad = lines.where(~ok).count()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [bytes(c or []) for c in b.column("code").to_pylist()]
            yield b.set_column(b.schema.get_field_index("code"), "code", pa.array(codes, pa.binary()))

    rows = latest(lines.where(ok).select("id", "code", (F.coalesce("d", F.lit(0)) == 1).alias("deleted"), "revision", F.col("cluster").alias("cid")))
    return rows.select("id", "code", (~F.col("deleted")).alias("live"), "cid").mapInArrow(pack, "id string, code binary, live boolean, cid int"), bad
