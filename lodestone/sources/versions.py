"""Versions of a stored thing in one folder, on any file system that Hadoop knows.

A version is a folder of its own; a pointer file numbered higher than all before makes it the present one. Pointers are created, never replaced, so at any moment, whatever crashes, the greatest
names a whole version. Old versions stay for readers that hold them until vacuum() removes them by age.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import SparkSession


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _p(self, *parts: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _fs(self):  # noqa: ANN202
        return self._p().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self._fs().exists(self._p())

    def _pointers(self) -> list[tuple[int, str]]:
        """Number and folder of each pointer, which is in its name; ascending."""
        fs = self._fs()
        if not fs.exists(self._p("_versions")):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._p("_versions"))]
        return sorted((int(n), v) for n, _, v in (x.partition("-") for x in names) if n.isdigit() and v)

    def current(self) -> str | None:
        """The present version's folder."""
        pointers = self._pointers()
        return f"{self.path}/{pointers[-1][1]}" if pointers else None

    def folders(self) -> list[str]:
        """Of all versions that have a pointer."""
        return [f"{self.path}/{v}" for _, v in self._pointers()]

    def begin(self) -> str:
        """A folder for a new version, unknown to readers until commit()."""
        return f"{self.path}/v-{uuid.uuid4().hex}"

    def commit(self, folder: str) -> None:
        number = (self._pointers() or [(0, "")])[-1][0] + 1
        self._fs().create(self._p("_versions", f"{number:012d}-{folder.rsplit('/', 1)[-1]}"), False).close()

    def vacuum(self, seconds: float = 7 * 86400) -> int:
        """Removes pointers and folders that have been out of use for so long; the number of folders."""
        fs, pointers, n = self._fs(), self._pointers(), 0
        before = (time.time() - seconds) * 1000
        live = {v for _, v in pointers[-1:]}
        young = {v for (_, v), (k, w) in zip(pointers, pointers[1:]) if fs.getFileStatus(self._p("_versions", f"{k:012d}-{w}")).getModificationTime() > before}
        for k, v in pointers[:-1]:
            if v not in young:
                fs.delete(self._p("_versions", f"{k:012d}-{v}"), False)
        for s in fs.listStatus(self._p()) if fs.exists(self._p()) else ():
            name = s.getPath().getName()
            if name.startswith("v-") and name not in live | young and s.getModificationTime() <= before:
                n += bool(fs.delete(s.getPath(), True))
        return n
