"""Watched directories: each micro-batch of new or changed files replaces their chunks in a collection; removed files are found by comparing listings.

The trigger interval is the quiet period: all changes within it are one batch.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk_files
from ..sources.collection import Collection
from ..sources.files import blank, text_files


@dataclass(frozen=True)
class Event:
    kind: str  # updated, deleted, error, stopped
    path: str
    chunks: int = 0
    message: str = ""


FILES = "path string, modificationTime timestamp, length bigint, content binary"


class Watcher:
    def __init__(self, spark: SparkSession, root: str, collection: Collection, extensions: Sequence[str], embedder=None, on_event: Callable[[Event], None] | None = None):  # noqa: ANN001
        self.spark, self.root, self.collection, self.extensions, self.embedder = spark, root.removeprefix("file://").rstrip("/"), collection, [e.lower().lstrip(".") for e in extensions], embedder
        self.on_event = on_event or (lambda e: None)
        self._writing = threading.Lock()

    def _tell(self, kind: str, counts: DataFrame) -> None:
        for r in counts.toLocalIterator():
            self.on_event(Event(kind, r["path"], r["n"]))

    def chunks(self, files: DataFrame) -> DataFrame:
        out = chunk_files(files)
        return out.withColumn("embedding", self.embedder.column(F.col("text"))) if self.embedder is not None else out

    def upsert(self, files: DataFrame) -> None:
        """files: path, text. All chunks whose metadata name the path as their source are replaced."""
        source = F.col("metadata")["source"]
        chunks = self.chunks(files).persist()
        try:
            stale = self.collection.documents().join(files.select(F.col("path").alias("_path")).distinct(), source == F.col("_path"), "left_semi")
            self.collection.replace(stale.select("id"), chunks)
            self._tell("updated", chunks.groupBy(source.alias("path")).agg(F.count("*").cast("int").alias("n")))
        finally:
            chunks.unpersist()

    def _batch(self, batch: DataFrame, _: int) -> None:
        text = F.expr("try_validate_utf8(cast(content as string))")
        order = F.max_by(text, "modificationTime")
        files = batch.groupBy(F.expr(f"substring(regexp_replace(path, '^file:/*', '/'), {len(self.root) + 2})").alias("path")).agg(order.alias("text"))
        ext = F.lower(F.regexp_extract("path", r"[^/]\.([^./]+)$", 1))
        files = files.where(ext.isin(*self.extensions) & ~blank(F.col("text")))
        try:
            if not files.isEmpty():
                with self._writing:
                    self.upsert(files)
        except Exception as x:
            self.on_event(Event("error", self.root, message=str(x)))
            raise

    def remove_missing(self) -> None:
        """Drops the chunks of files that aren't there any more; a stream of files cannot tell."""
        docs = self.collection.documents()
        known = docs.select(F.col("metadata")["source"].alias("path"), "id").where("path is not null")
        gone = known.join(text_files(self.spark, self.root, self.extensions, hidden=True).select("path"), "path", "left_anti").persist()
        try:
            counts = gone.groupBy("path").agg(F.count("*").cast("int").alias("n")).collect()  # one row a removed file
            if self.collection.delete(gone.select("id")):
                for r in counts:
                    self.on_event(Event("deleted", r["path"], r["n"]))
        finally:
            gone.unpersist()

    def start(self, checkpoint: str, seconds: float | None = 0.5, initial: bool = True, deletions: float = 5.0) -> StreamingQuery:
        """seconds: the trigger interval; None handles what is there and stops. The first batch is the initial scan; without it only files changed from now on count. A running watch looks for removed files every so
        many seconds (deletions); stop() on what this returns ends both."""
        stream = self.spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(self.root)
        if not initial:
            stream = stream.where(F.col("modificationTime") > F.lit(datetime.now(UTC)))
        w = stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", checkpoint)
        w = w.trigger(availableNow=True) if seconds is None else w.trigger(processingTime=f"{int(seconds * 1000)} milliseconds")
        query = w.start()
        if seconds is None:
            query.awaitTermination()
            self.remove_missing()
        else:
            threading.Thread(target=self._sweep, args=(query, deletions), daemon=True).start()
        return query

    def _sweep(self, query: StreamingQuery, seconds: float) -> None:
        """Between batches: a collection has one writer at a time."""
        while not query.awaitTermination(seconds):
            with self._writing:
                try:
                    self.remove_missing()
                except Exception as x:  # noqa: BLE001 the watch goes on
                    self.on_event(Event("error", self.root, message=str(x)))
        self.on_event(Event("stopped", self.root))


class Reindexer(Watcher):
    """Any change makes the whole directory be chunked and embedded anew, and put in the collection's place in one step."""

    def _batch(self, batch: DataFrame, _: int) -> None:
        ext = F.lower(F.regexp_extract("path", r"[^/]\.([^./]+)$", 1))
        if not batch.where(ext.isin(*self.extensions)).isEmpty():
            with self._writing:
                self.reindex()

    def reindex(self) -> int:
        """The number of chunks; a directory without any text leaves the collection as it is."""
        chunks = self.chunks(text_files(self.spark, self.root, self.extensions)).persist()
        try:
            n = chunks.count()
            if n:
                self.collection.overwrite(chunks)
                self.on_event(Event("updated", self.root, n))
            return n
        finally:
            chunks.unpersist()

    def remove_missing(self) -> None:
        """A removed file is a change like others."""
        source = F.col("metadata")["source"]
        known = self.collection.documents().select(source.alias("path")).where("path is not null").distinct()
        if not known.join(text_files(self.spark, self.root, self.extensions).select("path"), "path", "left_anti").isEmpty():
            self.reindex()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type in tumbling windows of event time; rows later than the watermark are dropped in a stream, and a batch has none."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")
