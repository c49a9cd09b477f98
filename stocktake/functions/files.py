"""Small files beside the tables, through the session's own file systems (local, HDFS, object stores)."""

from __future__ import annotations

import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str | None:
        """Text of a file; None if there is none."""
        p, fs = self._at(path)
        try:
            stream = fs.open(p)
        except Py4JJavaError:
            if fs.exists(p):
                raise
            return None
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str, overwrite: bool = False) -> bool:
        """Write a file whole; False if it is there and must not be overwritten."""
        p, fs = self._at(path)
        try:
            stream = fs.create(p, overwrite)
        except Py4JJavaError:
            if not overwrite and fs.exists(p):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def rename(self, old: str, new: str) -> bool:
        p, fs = self._at(old)
        try:
            return bool(fs.rename(p, self._at(new)[0]))
        except Py4JJavaError:
            if fs.exists(p):
                raise
            return False

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def changed(self, path: str) -> float:
        """When the file or folder was last changed, in seconds."""
        p, fs = self._at(path)
        return fs.getFileStatus(p).getModificationTime() / 1000

    def age(self, path: str) -> float:
        return time.time() - self.changed(path)

    def size(self, path: str) -> int:
        p, fs = self._at(path)
        return fs.getContentSummary(p).getLength()
