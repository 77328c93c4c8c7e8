"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import IntegralType

#: ASCII white space, as a regular-expression class and as a list of characters.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where that is unset, a temporary folder, but only in local mode: executors of a cluster share no such folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The lineage ends there, so a lost executor costs the rows it was working on and not the steps
    before; and the table is computed once however often it is read. Like checkpoints, the tables
    stay until the folder is cleaned, or until ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.cut_path = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table of ``cut`` that nothing will read any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.cut_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lanes(spark: SparkSession, least: int = 1) -> int:
    """Number of partitions to deal rows out to: the session's setting for shuffles."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def integer_key(docs: DataFrame, key: str) -> Column:
    """The key as a long; operators whose results carry keys in arrays of numbers take integer keys only."""
    kind = docs.select(key).schema[0].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"column {key} is of type {kind.simpleString()}: this operator takes integer keys")
    return docs[key].cast("long")


def own_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name
