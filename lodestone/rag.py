"""Directory to collection to answers: ingest, query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.embed import BagEmbedder, Embedder
from .operators.fusion import Reranker
from .operators.chunking import chunk_files
from .sources.collection import Collection
from .sources.files import text_files

EXTENSIONS = ("rs", "md", "toml", "txt")


def ingest(c: Collection, root: str, extensions: Sequence[str] = EXTENSIONS, embedder: Embedder | None = None) -> int:
    """Chunks and embeds the directory's files and appends them; the number of chunks."""
    chunks = chunk_files(text_files(c.spark, root, extensions))
    e = embedder or BagEmbedder()
    before = len(c)
    c.insert(chunks.withColumn("embedding", e.column(F.col("text"))))
    return len(c) - before


def query(c: Collection, text: str, k: int = 10, hybrid: bool = False, embedder: Embedder | None = None, reranker: Reranker | None = None) -> DataFrame:
    """The word index of a hybrid query is stored with the collection's version."""
    e = embedder or BagEmbedder()
    return c.hybrid_search(e.embed(text), text, k, reranker=reranker) if hybrid else c.search(e.embed(text), k)
