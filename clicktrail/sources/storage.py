"""What Spark's readers and writers do not do with files."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Storage:
    """The file system calls that Spark's writers do not offer: look, rename, remove."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), where

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where)

    def make(self, path: str) -> None:
        fs, where = self._at(path)
        fs.mkdirs(where)

    def names(self, path: str) -> list[str]:
        fs, where = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def move(self, source: str, target: str) -> None:
        fs, where = self._at(target)
        if not fs.rename(self._at(source)[1], where):
            raise OSError(f"could not rename {source} to {target}")

    def remove(self, path: str) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)
