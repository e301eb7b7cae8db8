"""The single-file binary collection format, as a Spark data source named "vectorfile".

Little endian: a header of 24 bytes (magic, version 2, dimension, count, offset of the vectors), a block of id, text and metadata for each document, then all vectors as 32-bit floats.
Documents without a vector are written as zeros. Option headerOnly=true reads the header alone. A file of another kind or version is refused; a file that ends early too.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..errors import IncompatibleVersion

MAGIC = bytes.fromhex("44564442")
VERSION = 2
HEADER = struct.Struct("<4sIIIQ")
SCHEMA = "id string, text string, embedding array<float>, metadata map<string,string>, pos bigint"
HEADER_SCHEMA = "dimension bigint, count bigint, offset bigint, bytes bigint"


def is_binary(path: str) -> bool:
    try:
        with open(path, "rb") as f:
            return f.read(4) == MAGIC
    except OSError:
        return False


def header(path: str) -> tuple[int, int, int]:
    """Dimension, count, offset of the vectors."""
    with open(path, "rb") as f:
        raw = f.read(HEADER.size)
    if len(raw) < HEADER.size:
        raise EOFError(f"{path}: no whole header")
    magic, version, dim, count, offset = HEADER.unpack(raw)
    if magic != MAGIC or version != VERSION:
        raise IncompatibleVersion(f"{path}: not a collection file of version {VERSION}")
    return dim, count, offset


def _text(raw: memoryview, at: int) -> tuple[str, int]:
    if at + 4 > len(raw):
        raise EOFError("the file ends early")
    (n,) = struct.unpack_from("<I", raw, at)
    if at + 4 + n > len(raw):
        raise EOFError("the file ends early")
    return bytes(raw[at + 4 : at + 4 + n]).decode("utf-8", "replace"), at + 4 + n


def read(path: str) -> Iterator[tuple]:
    dim, count, offset = header(path)
    with open(path, "rb") as f:
        raw = memoryview(f.read())
    if offset + 4 * dim * count > len(raw):
        raise EOFError(f"{path}: the file ends early")
    at = HEADER.size
    for k in range(count):
        doc_id, at = _text(raw, at)
        text, at = _text(raw, at)
        (pairs,) = struct.unpack_from("<I", raw, at)
        at += 4
        meta = {}
        for _ in range(pairs):
            key, at = _text(raw, at)
            meta[key], at = _text(raw, at)
        yield doc_id, text, list(struct.unpack_from(f"<{dim}f", raw, offset + 4 * dim * k)), meta, k


def write(path: str, rows: list[tuple]) -> None:
    """rows: id, text, embedding, metadata. Written beside and moved into place."""
    dim = next((len(r[2]) for r in rows if r[2]), 0)
    body = bytearray()

    def put(text: str) -> None:
        raw = (text or "").encode()
        body.extend(struct.pack("<I", len(raw)) + raw)

    for doc_id, text, vector, meta in rows:
        if vector and len(vector) != dim:
            raise ValueError("vectors differ in dimension")
        put(doc_id)
        put(text)
        body.extend(struct.pack("<I", len(meta or {})))
        for key in sorted(meta or {}):
            put(key)
            put(meta[key])
    body.extend(bytes(-len(body) % 32))
    with open(f"{path}.part", "wb") as f:
        f.write(HEADER.pack(MAGIC, VERSION, dim, len(rows), HEADER.size + len(body)) + body)
        for r in rows:
            f.write(struct.pack(f"<{dim}f", *(r[2] or [0.0] * dim)))
        f.flush()
        os.fsync(f.fileno())
    os.replace(f"{path}.part", path)


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Part(WriterCommitMessage):
    path: str


def _files(path: str) -> list[str]:
    path = path.removeprefix("file://")
    return sorted(os.path.join(path, n) for n in os.listdir(path) if not n.startswith(("_", "."))) if os.path.isdir(path) else [path]


class _Reader(DataSourceReader):
    def __init__(self, path: str, head: bool):
        self.path, self.head = path, head

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in _files(self.path)]

    def read(self, partition: _File) -> Iterator[tuple]:
        if self.head:
            dim, count, offset = header(partition.path)
            yield dim, count, offset, 4 * dim * count
        else:
            yield from read(partition.path)


class _Writer(DataSourceWriter):
    """A file for each partition; one file, if the DataFrame has one partition."""

    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        c = TaskContext.get()
        part = os.path.join(self.path, f".part-{c.partitionId():05d}-{c.taskAttemptId()}")
        write(part, [(r["id"], r["text"], r["embedding"], r["metadata"]) for r in rows])
        return _Part(part)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        for k, m in enumerate(x for x in messages if x):
            os.replace(m.path, os.path.join(self.path, f"part-{k:05d}.bin"))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


class VectorFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vectorfile"

    def _head(self) -> bool:
        return str(self.options.get("headeronly", self.options.get("headerOnly", "false"))).lower() == "true"

    def schema(self) -> str:
        return HEADER_SCHEMA if self._head() else SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options["path"], self._head())

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VectorFile)
