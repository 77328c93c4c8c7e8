"""Tables of runs that can be written twice: a run replaces its own partitions and nothing else.

A table is a folder of Parquet files partitioned by its keys. Spark stages a run's files beside the table
and moves them in when all tasks are done, so a run that fails leaves what was there, and a run that is
repeated leaves one copy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name of the partition that holds null keys.
NO_KEY = "__HIVE_DEFAULT_PARTITION__"


def replace_partitions(rows: DataFrame, path: str, by: Sequence[str]) -> None:
    """Write ``rows``; partitions that they have no row for stay as they are.

    Rows are dealt out by their keys and a hash of the row first, so a partition has few files and none
    is one task's work alone. Columns with a leading underscore are left out.
    """
    kept = rows.select(*[c for c in rows.columns if not c.startswith("_")])
    spread = F.pmod(F.xxhash64(*[c for c in kept.columns if c not in by]), F.lit(4))
    kept.repartition(*by, spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def partitions(spark: SparkSession, path: str, by: Sequence[str]) -> DataFrame:
    """A row for each partition: its keys (strings, null for the null key), ``files``, ``bytes`` and ``modified``.

    Only the listing of the files is read, none of their content. A table that is not there has no partitions.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], ", ".join([*(f"`{c}` string" for c in by), "files long", "bytes long", "modified timestamp"]))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", "length", "modificationTime")
    value = lambda c: F.regexp_extract("path", f"/{c}=([^/]*)/", 1)
    keyed = files.select("length", "modificationTime", *[F.nullif(F.url_decode(value(c)), F.lit(NO_KEY)).alias(c) for c in by])
    return keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("modified"))


def append_new_partitions(rows: DataFrame, path: str, by: Sequence[str]) -> None:
    """Write the rows of partitions that the table does not have; the others are dropped, so a repeated run changes nothing."""
    held = partitions(rows.sparkSession, path, by).select(*[F.col(c).alias(f"_{c}_") for c in by])
    same = [F.col(c).cast("string").eqNullSafe(F.col(f"_{c}_")) for c in by]
    replace_partitions(rows.join(held, same, "left_anti"), path, by)


def table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The table's rows. ``schema`` (with the keys) keeps the types of keys that look like numbers or dates."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def newest(spark: SparkSession, path: str, by: Sequence[str], at: str, where: str = "true") -> str | None:
    """The largest value of key ``at`` among partitions that meet ``where``; from the listing alone."""
    return partitions(spark, path, by).where(where).agg(F.max(at)).first()[0]


def append_weights(new: DataFrame, path: str, as_of: str) -> None:
    """new(category, metric, new_weight): the weights of ``as_of`` become the next version of the table (version, as_of, category, metric, weight).

    The next version is the last one of an earlier date with the new weights in place of its own, numbered on; a run
    repeated on its date replaces its version. The first run holds the new weights alone.
    """
    spark, by = new.sparkSession, ["version", "as_of"]
    earlier = partitions(spark, path, by).where(F.col("as_of").cast("date") < F.lit(as_of).cast("date"))
    last = earlier.agg(F.max(F.col("version").cast("int"))).first()[0]
    mine = new.select("category", "metric", "new_weight")
    if last is None:
        rows = mine.withColumnRenamed("new_weight", "weight")
    else:
        # a file is never read and replaced by one job: the version read here is an earlier one
        before = table(spark, path).where(F.col("version") == last).select("category", "metric", "weight")
        rows = before.join(mine, ["category", "metric"], "full_outer").select("category", "metric", F.coalesce("new_weight", "weight").alias("weight"))
    keyed = rows.select("category", "metric", F.col("weight").cast("double").alias("weight"), F.lit((last or 0) + 1).alias("version"), F.lit(as_of).cast("date").alias("as_of"))
    replace_partitions(keyed, path, by)
