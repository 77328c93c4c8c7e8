"""Tables that a session computes once and later queries read."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from .store import stored


def files_of(spark: SparkSession, path: str) -> tuple:
    """Name, size and time of each file of a table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


class Kept:
    """By application, folder and name: a stored table, as long as the files it comes from are the same and it is still there."""

    def __init__(self, sources: Sequence[str]) -> None:
        self.sources, self.tables = sources, {}

    def get(self, spark: SparkSession, folder: str, name: str, make: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
        key = (spark.sparkContext.applicationId, folder, name)
        mark = tuple(files_of(spark, f"{folder}/{t}.parquet") for t in self.sources)
        held = self.tables.get(key)
        if held is not None and held[0] == mark and self._there(held[1]):
            return held[1]
        if held is not None:
            self._delete(held[1])
        table = stored(make(spark, folder), name)
        self.tables[key] = (mark, table)
        return table

    def forget(self, folder: str | None = None) -> None:
        """Delete the tables of a folder, or all."""
        for key in [k for k in self.tables if folder is None or k[1] == folder]:
            self._delete(self.tables.pop(key)[1])

    @staticmethod
    def _at(table: DataFrame):
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_path)
        return path, path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _there(self, table: DataFrame) -> bool:
        path, files = self._at(table)
        return files.exists(path)

    def _delete(self, table: DataFrame) -> None:
        path, files = self._at(table)
        files.delete(path, True)
