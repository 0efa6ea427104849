"""Folders and small files of any file system that Spark can reach."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """Thin calls of Hadoop's file system interface; paths may have any scheme."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        """What lies in a folder, sorted; a folder that isn't there is empty."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        stream = fs.create(p, False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def move(self, old: str, new: str) -> None:
        (fs, a), (_, b) = self._at(old), self._at(new)
        if not fs.rename(a, b):
            raise OSError(f"cannot move {old} to {new}")

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
