"""Small files (documents, pointers) through Hadoop's file system, so that any store Spark reads will do."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm, self._gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = lambda name: self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        self._fs = self._path("").getFileSystem(self._conf) if self.root else None

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def write(self, name: str, data: bytes) -> None:
        """Under another name first, then renamed: a reader sees the old file or the new one."""
        temporary = self._path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(temporary, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        # renaming with overwrite is one step of the file system, where rename alone refuses to replace
        overwrite = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = overwrite
        path = self._path(name)
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri() if path.toUri().getScheme() else self._fs.getUri(), self._conf).rename(
            self._fs.makeQualified(temporary), self._fs.makeQualified(path), options
        )

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))

    def read_json(self, name: str, default=None):
        return json.loads(self.read(name)) if self.exists(name) else default


def canonical_json(value) -> bytes:
    """Driver-side canonical JSON of small documents; keys are ASCII, floats are refused."""

    def check(x):
        if isinstance(x, float):
            raise ValueError("floats have no canonical form")
        if isinstance(x, int) and not isinstance(x, bool) and abs(x) > 2**53 - 1:
            raise ValueError("an integer beyond 2^53 - 1 has no canonical form")
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            check(y)

    check(value)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
