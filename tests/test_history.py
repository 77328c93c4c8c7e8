from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from factorloom.functions.store import shared_folder
from factorloom.operators import history as H
from factorloom.operators import runs as U


@pytest.fixture
def path(spark):
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


def scores(spark, values: dict[str, float]):
    return spark.createDataFrame(list(values.items()), "ticker string, composite double").withColumn("_private", F.lit(1))


def rows(df, *names):
    return sorted(tuple(str(r[n]) for n in names) for r in df.collect())


def test_a_date_written_twice_is_there_once(spark, path):
    U.save_scores(scores(spark, {"A": 1.0, "B": 2.0}), path, "factor_scores", "aaa", "2001-06-30")
    U.save_scores(scores(spark, {"A": 3.0}), path, "factor_scores", "aaa", "2001-07-31")
    U.save_scores(scores(spark, {"A": 9.0}), path, "factor_scores", "aaa", "2001-06-30")
    held = spark.read.parquet(path)
    assert "_private" not in held.columns
    assert rows(held, "as_of", "ticker", "composite") == [("2001-06-30", "A", "9.0"), ("2001-07-31", "A", "3.0")]
    assert rows(U.load_scores(spark, path, "factor_scores", "aaa"), "ticker", "composite") == [("A", "3.0")]


def test_a_failed_run_leaves_the_old_rows(spark, path):
    U.save_scores(scores(spark, {"A": 1.0}), path, "t", "aaa", "2001-06-30")
    broken = scores(spark, {"A": 5.0, "B": 0.0}).withColumn("composite", F.when(F.col("ticker") == "B", F.raise_error(F.lit("stop"))).otherwise(F.col("composite")))
    with pytest.raises(Exception, match="stop"):
        U.save_scores(broken, path, "t", "aaa", "2001-06-30")
    assert rows(spark.read.parquet(path), "ticker", "composite") == [("A", "1.0")]


def test_partitions_come_from_the_listing(spark, path):
    U.save_scores(scores(spark, {"A": 1.0, "B": 2.0}), path, "raw", "a b", "2001-06-30")
    U.save_scores(scores(spark, {"A": 1.0}), path, "factor_scores", "x", "2001-07-31")
    listed = H.partitions(spark, path, ["tier", "config_hash", "as_of"])
    assert rows(listed, "tier", "config_hash", "as_of") == [("factor_scores", "x", "2001-07-31"), ("raw", "a b", "2001-06-30")]
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" in plan and "content" not in plan and "FileScan parquet" not in plan
    assert listed.agg(F.min("bytes")).first()[0] > 0
    assert H.partitions(spark, path + "-none", ["tier"]).count() == 0
    assert H.newest(spark, path, ["tier", "as_of"], "as_of") == "2001-07-31"


def test_reading_scores_reads_one_partition(spark, path):
    for day in ("2001-06-30", "2001-07-31"):
        U.save_scores(scores(spark, {day: 1.0}), path, "t", "aaa", day)
    found = U.load_scores(spark, path, "t", "aaa")
    assert len(found.inputFiles()) == 1 or rows(found, "ticker") == [("2001-07-31",)]
    assert "PartitionFilters: [" in found._jdf.queryExecution().executedPlan().toString()
    assert U.load_scores(spark, path, "t", "bbb").count() == 0


def test_new_partitions_only(spark, path):
    one = spark.createDataFrame([("2001-01-31", "1m", 5), ("2001-02-28", "1m", 6)], "run_date string, horizon string, n int")
    two = spark.createDataFrame([("2001-02-28", "1m", 99), ("2001-03-31", None, 7)], "run_date string, horizon string, n int")
    for rows_ in (one, two, two, one):
        H.append_new_partitions(rows_, path, ["run_date", "horizon"])
    assert rows(spark.read.parquet(path), "run_date", "horizon", "n") == [("2001-01-31", "1m", "5"), ("2001-02-28", "1m", "6"), ("2001-03-31", "None", "7")]


def test_versions_of_weights(spark, path):
    new = lambda **w: spark.createDataFrame([("c", k, v) for k, v in w.items()], "category string, metric string, new_weight double")
    H.append_weights(new(a=60.0, b=40.0), path, "2001-01-01")
    H.append_weights(new(a=50.0, d=10.0), path, "2001-02-01")
    H.append_weights(new(a=55.0, d=5.0), path, "2001-02-01")
    want = [("1", "2001-01-01", "a", "60.0"), ("1", "2001-01-01", "b", "40.0"), ("2", "2001-02-01", "a", "55.0"), ("2", "2001-02-01", "b", "40.0"), ("2", "2001-02-01", "d", "5.0")]
    assert rows(spark.read.parquet(path), "version", "as_of", "metric", "weight") == want
