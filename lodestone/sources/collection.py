"""Named collections: parts of a Parquet table, and versions that list the parts they hold.

An insert writes a part and a version that lists it beside the parts before: nothing is rewritten. A delete or an update rewrites the parts that hold the ids, no other. A version becomes the present one by one
atomic step, so a failure at any moment leaves a whole collection, and readers keep the version that they began with; vacuum() removes by age what no version lists. One writer at a time.
Columns: the document's and pos, the insertion order.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import IncompatibleVersion, InvalidConfig
from ..functions.distance import metric_of
from ..operators import fusion, hnsw, ivfpq, search
from ..operators.bm25 import Bm25
from ..schema import STORED, Document, completed, frame
from .versions import Versions

INDEXES = ("bruteforce", "hnsw", "ivf_pq")


@dataclass(frozen=True)
class Config:
    index: str = "bruteforce"
    metric: str = "cosine"
    symbolic: bool = False  # texts are cleared, the manifest is kept
    manifest: bool = False
    hnsw: hnsw.Config = hnsw.Config()
    ivf_pq: ivfpq.Config = ivfpq.Config()


class Collection:
    def __init__(self, spark: SparkSession, path: str, config: Config | None = None):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or Config()
        if self.config.index not in INDEXES:
            raise InvalidConfig(f"index {self.config.index!r}")
        self._index = None

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1].rsplit(".", 1)[0] or "default"

    @property
    def versions(self) -> Versions:
        return Versions(self.spark, self.path)

    def version(self) -> str | None:
        """The present version's folder, None if nothing was ever stored."""
        v = self.versions
        now = v.current()
        if now is None and v.exists() and not v._fs().exists(v._p("parts")):  # with parts, the first insert is still at work, or failed
            raise IncompatibleVersion(f"{self.path} is no collection")
        return now

    def _parts(self, version: str | None) -> list[str]:
        return json.loads(self.spark.read.text(version, wholetext=True).first()[0]) if version else []

    def _read(self, parts: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(STORED).parquet(*(f"{self.path}/parts/{p}" for p in parts)) if parts else self.spark.createDataFrame([], STORED)

    def documents(self) -> DataFrame:
        """Empty if nothing was ever stored; a path that holds something else is refused."""
        return self._read(self._parts(self.version()))

    def __len__(self) -> int:
        return self.documents().count()

    def is_empty(self) -> bool:
        return self.documents().isEmpty()

    def _write(self, df: DataFrame) -> str:
        part = uuid.uuid4().hex
        df.select(*STORED.names).write.parquet(f"{self.path}/parts/{part}")
        return part

    def _commit(self, parts: Sequence[str]) -> None:
        v = self.versions
        new = v.begin()
        self.spark.createDataFrame([(json.dumps(list(parts)),)], "value string").coalesce(1).write.text(new)
        v.commit(new)
        self._index = None

    def _without(self, gone: DataFrame) -> tuple[list[str], int]:
        """The present parts less the rows with these ids (_gone, distinct), and how many rows those are. Only parts that hold some are rewritten."""
        parts = self._parts(self.version())
        rows = self._read(parts).withColumn("_part", F.regexp_extract(F.input_file_name(), r"/parts/([0-9a-f]+)/[^/]*$", 1))
        held = rows.join(gone, F.col("id") == F.col("_gone"), "left_semi").groupBy("_part").agg(F.count("*")).collect()  # a row a part
        for r in held:
            parts[parts.index(r[0])] = self._write(self._read([r[0]]).join(gone, F.col("id") == F.col("_gone"), "left_anti"))
        return parts, sum(r[1] for r in held)

    def vacuum(self, seconds: float = 7 * 86400) -> None:
        """Removes versions that have been out of use for so long, and parts that none of those left lists."""
        import time

        v = self.versions
        v.vacuum(seconds)
        kept = {p for f in v.folders() for p in self._parts(f)}
        fs, before = v._fs(), (time.time() - seconds) * 1000
        for s in fs.listStatus(v._p("parts")) if fs.exists(v._p("parts")) else ():
            if s.getPath().getName() not in kept and s.getModificationTime() <= before:
                fs.delete(s.getPath(), True)

    def _prepared(self, docs: DataFrame | Iterable[Document]) -> DataFrame:
        df = completed(docs if isinstance(docs, DataFrame) else frame(self.spark, docs))
        if self.config.manifest:
            from ..operators.sml import enrich

            df = enrich(df)
        return df.withColumn("text", F.lit("")) if self.config.symbolic else df

    def _numbered(self, df: DataFrame, after: int) -> DataFrame:
        """pos: ascending in the order of df's partitions and rows. Ids are sparse, so that no task has to number all rows."""
        return df.withColumn("pos", F.monotonically_increasing_id() + F.lit(after + 1))

    def _checked(self, df: DataFrame, present: DataFrame) -> None:
        sizes = df.select(F.size("embedding").alias("n")).where("n > 0").distinct()
        if not present.isEmpty():
            sizes = sizes.unionByName(present.select(F.size("embedding").alias("n")).where("n > 0").limit(1)).distinct()
        if len(sizes.take(2)) > 1:
            raise InvalidConfig("vectors differ in dimension")

    def _last(self) -> int:
        last = self.documents().agg(F.max("pos")).first()[0]
        return -1 if last is None else last

    def insert(self, docs: DataFrame | Iterable[Document]) -> None:
        """Appends, also where the id is there already."""
        new = self._prepared(docs)
        self._checked(new, self.documents())
        parts = self._parts(self.version())
        self._commit([*parts, self._write(self._numbered(new, self._last()))])

    def delete(self, ids: Sequence[str] | DataFrame) -> int:
        gone = (ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "id string")).select(F.col("id").alias("_gone")).distinct()
        parts, n = self._without(gone)
        if n:
            self._commit(parts)
        return n

    def update(self, docs: DataFrame | Iterable[Document]) -> None:
        """Replaces all rows with these ids, or adds them; they go to the end."""
        new = self._prepared(docs)
        self.replace(new.select("id"), new, prepared=True)

    def replace(self, ids: DataFrame, docs: DataFrame | Iterable[Document], prepared: bool = False) -> None:
        """Deletes the rows with these ids (column id) and appends docs, in one step: readers see both or neither."""
        new = docs if prepared else self._prepared(docs)
        gone = ids.select(F.col("id").alias("_gone")).distinct()
        self._checked(new, self.documents().join(gone, F.col("id") == F.col("_gone"), "left_anti"))
        last = self._last()
        parts, _ = self._without(gone)
        self._commit([*parts, self._write(self._numbered(new, last))])

    def overwrite(self, docs: DataFrame | Iterable[Document]) -> None:
        """Puts docs in the place of everything."""
        new = self._prepared(docs)
        self._checked(new, self.spark.createDataFrame([], STORED))
        self._commit([self._write(self._numbered(new, -1))])

    def index(self):  # noqa: ANN201
        """The approximate index over positions: built once for a version, stored beside it and read back by every later search, of other sessions too."""
        if self._index is None:
            c, docs = self.config, self.documents()
            kind, config = {"hnsw": (hnsw.Hnsw, c.hnsw), "ivf_pq": (ivfpq.IvfPq, c.ivf_pq)}[c.index]
            path = f"{self.version()}/_{c.index}"
            try:
                self._index = kind.load(path, docs, config, "pos") if c.index == "hnsw" else kind.load(path, docs, "pos")
                if self._index.config != config:
                    raise InvalidConfig("another configuration")
            except (FileNotFoundError, InvalidConfig):
                self._index = kind.build(docs, config, "pos").save(path)
        return self._index

    def nearest(self, query: Sequence[float], k: int, where: Column | None = None) -> DataFrame:
        """pos, score: the k best by the configured index."""
        metric = metric_of(self.config.metric)
        if self.config.index == "bruteforce" or self.is_empty():
            return search.exact_topk(self.documents(), query, k, metric, where, id_col="pos").select("pos", "score")
        x = self.index()
        found = x.search(query, k) if where is None else x.search_filtered(query, k, where)
        return found.select(F.col("doc_id" if self.config.index == "hnsw" else "id").alias("pos"), "score")

    def search(self, query: Sequence[float], k: int = 10, where: Column | None = None) -> DataFrame:
        """score and the document's columns, best first. Exact search filters before it scores; the approximate indexes fetch more and filter then."""
        metric = metric_of(self.config.metric)
        if self.config.index == "bruteforce" or self.is_empty():
            return search.exact_topk(self.documents(), query, k, metric, where, id_col="pos")
        found = self.nearest(query, k, where).withColumnRenamed("pos", "_pos")
        rows = self.documents().join(F.broadcast(found), F.col("pos") == F.col("_pos")).drop("_pos")
        return rows.orderBy(F.desc("score"), "pos").limit(max(0, k))

    def search_text(self, text: str, k: int, embedder) -> DataFrame:  # noqa: ANN001
        return self.search(embedder.embed(text), k)

    def words(self) -> Bm25:
        """The stored word index of the present version."""
        return Bm25.cached(f"{self.version()}/_bm25", self.documents(), "pos") if self.version() else Bm25(self.documents(), "pos")

    def keyword_search(self, text: str, k: int = 10) -> DataFrame:
        found = self.words().search(text, k)
        rows = self.documents().join(F.broadcast(found), F.col("pos") == F.col("doc_id")).drop("doc_id")
        return rows.orderBy(F.desc("score"), "pos")

    def hybrid_search(self, query: Sequence[float], text: str, k: int = 10, profile: str = "production", reranker: fusion.Reranker | None = None) -> DataFrame:
        """Vectors by the configured index, words by the stored one. Where the same id was inserted twice, its last row counts: the lists are looked up by id."""
        order = Window.partitionBy("id").orderBy(F.desc("pos"))  # over the rows of ids that occur twice
        docs = self.documents()
        twice = docs.groupBy("id").agg(F.count("*").alias("_c")).where("_c > 1").select("id")
        old = docs.join(twice, "id", "left_semi").withColumn("_n", F.row_number().over(order)).where("_n > 1").select(F.col("pos").alias("_old"))
        if not old.isEmpty():
            docs = docs.join(old, F.col("pos") == F.col("_old"), "left_anti")
            return fusion.hybrid(docs, query, text, k, profile, reranker, metric=metric_of(self.config.metric), id_col="pos")
        vectors = lambda n: self.nearest(query, n).select(F.col("pos").alias("doc_id"), "score")
        return fusion.hybrid(docs, query, text, k, profile, reranker, self.words(), metric_of(self.config.metric), "pos", vectors=vectors)

    def export_jsonl(self, path: str) -> None:
        """One JSON object a line, in insertion order, in one file: a sorted single partition."""
        self.documents().orderBy("pos").select("id", "text", "embedding", "metadata").coalesce(1).write.mode("overwrite").json(path)
