"""Session helpers shared by the corpus operators: tables, the shared scratch folder, row-wise Arrow functions."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of every helper column, so that extra columns of the input can't clash with it.
P = "_lds_"
#: Paths in the shared folder that materialise() wrote.
_written: set[tuple[SparkSession, str]] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, where it is unset and Spark runs in this process, a temporary one."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    spark.conf.set("spark.checkpoint.dir", root)
    atexit.register(lambda: shutil.rmtree(root[7:], ignore_errors=True))
    return root


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives the loss of any executor. Give the result to discard() when nothing needs it any more."""
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return keep_path(df.sparkSession.read.schema(df.schema).parquet(path), path)


def keep_path(df: DataFrame, path: str) -> DataFrame:
    """Marks df as what was written to path, for discard() and for the end of the driver."""
    if not _written:
        atexit.register(_clean)
    _written.add((df.sparkSession, path))
    df._lodestone_path = path  # type: ignore[attr-defined]
    return df


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _written.discard((spark, path))


def discard(*tables: DataFrame) -> None:
    for t in tables:
        _delete(t.sparkSession, t._lodestone_path)


def _clean() -> None:
    """What is left when the driver ends. Where the context has stopped before, its JVM still serves the file system."""
    for spark, path in list(_written):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001, PERF203 the JVM is gone; local files can still be removed
            if path.startswith(("/", "file:/")):
                shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def arrow_map(fn: Callable[..., Callable[..., pa.Array]], returns: str, *cols: Column) -> Column:
    """Apply to Arrow batches of cols what fn() makes; fn runs once in each Python worker's task."""

    if len(cols) == 1:

        @F.arrow_udf(returns)
        def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            f = fn()
            for b in batches:
                yield f(b)

        return one(*cols)

    @F.arrow_udf(returns)
    def many(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        f = fn()
        for b in batches:
            yield f(*b)

    return many(*cols)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
