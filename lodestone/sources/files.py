"""Directories of text files as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED_DIRS = (".git", "node_modules", "target", ".venv", "__pycache__")
BINARY = frozenset("avi bin bz2 dll dylib eot exe gif gz ico jpeg jpg mov mp3 mp4 ogg otf pdf png pyc pyo so tar ttf wasm wav webm woff woff2 xz zip zst".split())


def _walked(spark: SparkSession, root: str, extensions: Sequence[str], hidden: bool) -> DataFrame:
    """path (below the root), text, kind: what a file is, by its name: text, binary or no matter."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.removeprefix("file://").removeprefix("file:").rstrip("/") + "/"
    path = F.expr(f"substring(regexp_replace(path, '^file:/*', '/'), {len(base) + 1})") if base.startswith("/") else F.col("path")
    f = raw.select(path.alias("path"), "content")
    names = F.split("path", "/")
    ext = F.lower(F.regexp_extract("path", r"[^/]\.([^./]+)$", 1))
    keep = ext != ""
    if extensions:
        keep &= ext.isin(*(e.lower().lstrip(".") for e in extensions))
    if not hidden:
        keep &= ~F.exists(names, lambda n: (n.startswith(".") & (n != ".gitignore")) | n.isin(*SKIPPED_DIRS))
    return f.where(keep).select("path", F.when(~ext.isin(*BINARY), F.expr("try_validate_utf8(cast(content as string))")).alias("text"))


def blank(text) -> Column:  # noqa: ANN001
    """Nothing but white space, or nothing."""
    return text.isNull() | ~F.rlike(text, F.lit(r"\S"))


def text_files(spark: SparkSession, root: str, extensions: Sequence[str] = (), hidden: bool = False) -> DataFrame:
    """path (below the root), text. Hidden entries (but .gitignore) and build folders are skipped unless hidden, so are binary kinds, files without an extension, unreadable and blank ones."""
    return _walked(spark, root, extensions, hidden).where(~blank(F.col("text")))


def skipped(spark: SparkSession, root: str, extensions: Sequence[str] = ()) -> int:
    """Files that text_files() looks at and leaves out: binary, unreadable or blank."""
    return _walked(spark, root, extensions, False).where(blank(F.col("text"))).count()


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Documents from lines of JSON; missing vectors and metadata are empty."""
    from ..schema import DOCUMENT, completed

    return completed(spark.read.schema(DOCUMENT).json(path))
