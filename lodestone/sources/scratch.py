"""A folder for what queries store: that of spark.checkpoint.dir, which all executors share or, where it is unset and Spark runs in this process, a temporary one."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A path below it that only this application uses."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if sc.applicationId not in _own:
            _own[sc.applicationId] = tempfile.mkdtemp(prefix="lodestone-")
            atexit.register(shutil.rmtree, _own[sc.applicationId], ignore_errors=True)
        root = "file://" + _own[sc.applicationId]
    return f"{root}/lodestone-{sc.applicationId}/{name}"
