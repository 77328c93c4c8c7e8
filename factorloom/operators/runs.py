"""Runs of the chain as tables: caches of scores, stage artifacts, manifests, snapshots of old runs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import counted, placed
from .history import partitions, replace_partitions

#: Sections of a configuration that decide scores.
SCORING_SECTIONS = ("factor_weights", "metric_weights", "data_quality", "sector_neutral", "value_trap_filters", "universe")


def config_hash(config: Mapping, sections: Sequence[str] = SCORING_SECTIONS) -> str:
    """First 12 digits of the SHA-256 of the sections as sorted JSON; sections that are missing count as empty."""
    raw = json.dumps({s: config.get(s, {}) for s in sections}, sort_keys=True)
    return hashlib.sha256(raw.encode()).hexdigest()[:12]


def load_times(rows: DataFrame, column: str = "ms") -> DataFrame:
    """Least, mean, largest and 95th of a hundred of the positive times, the last one by position int(0.95 n)."""
    at = placed(counted(rows.where(F.col(column) > 0), [], column), [], column)
    place = F.floor(F.col("total") * 0.95)
    p95 = F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("n")), F.col(column)))
    return at.agg(F.min(column).alias("least"), F.floor(F.sum(F.col(column) * F.col("n")) / F.sum("n")).alias("mean"), F.max(column).alias("most"), p95.alias("p95"), F.sum("n").alias("n"))


SCORE_KEYS = ("tier", "config_hash", "as_of")


def save_scores(scored: DataFrame, path: str, tier: str, config: str, as_of: str) -> None:
    """Columns without a leading underscore, under (tier, config_hash, as_of), in place of what an earlier run wrote there."""
    keyed = scored.withColumns({"tier": F.lit(tier), "config_hash": F.lit(config), "as_of": F.lit(as_of).cast("date")})
    replace_partitions(keyed, path, SCORE_KEYS)


def load_scores(spark: SparkSession, path: str, tier: str, config: str | None = None) -> DataFrame:
    """The newest date of a tier, and of a configuration if one is named; the date comes from the listing, and other partitions are not read."""
    mine = F.col("tier") == tier
    if config is not None:
        mine &= F.col("config_hash") == config
    last = partitions(spark, path, SCORE_KEYS).where(mine).agg(F.max("as_of")).first()[0]
    return spark.read.parquet(path).where(mine & (F.col("as_of") == F.lit(last).cast("date")))


def caches(spark: SparkSession, path: str) -> DataFrame:
    """The dates that a score table holds for each tier and configuration, from the listing of its files."""
    return partitions(spark, path, SCORE_KEYS).withColumn("as_of", F.col("as_of").cast("date"))


def cache_freshness(caches: DataFrame, today: Column, days: Mapping[str, int]) -> DataFrame:
    """caches(tier, config_hash, as_of): per tier and configuration the newest date, and whether it is younger than the tier's ``days``."""
    limit = F.coalesce(*[F.when(F.col("tier") == t, d) for t, d in days.items()], F.lit(0))
    out = caches.groupBy("tier", "config_hash").agg(F.max("as_of").alias("newest"))
    return out.withColumn("age", F.datediff(today, "newest")).withColumn("fresh", F.col("age") < limit)


def run_state(freshness: DataFrame) -> DataFrame:
    """Per configuration: hot if all its tiers are fresh, warm if some are, else cold."""
    share = F.count_if("fresh") / F.count(F.lit(1))
    return freshness.groupBy("config_hash").agg(F.count(F.lit(1)).alias("tiers"), F.count_if("fresh").alias("fresh"), F.when(share == 1, "hot").when(share > 0, "warm").otherwise("cold").alias("state"))


def save_artifact(df: DataFrame, path: str, run_id: str, stage: str) -> None:
    """A stage's output of a run, under (run_id, stage)."""
    df.write.mode("overwrite").parquet(f"{path}/run_id={run_id}/stage={stage}")


def artifact(spark: SparkSession, path: str, run_id: str, stage: str) -> DataFrame:
    return spark.read.parquet(f"{path}/run_id={run_id}/stage={stage}")


def manifest(universe: DataFrame, run_id: str, config: Mapping, started: str) -> DataFrame:
    """universe(ticker, failed): one row for the run: counts, hash of the configuration, its weights."""
    weights = json.dumps(config.get("factor_weights", {}), sort_keys=True)
    out = universe.agg(F.count_if(~F.col("failed")).alias("scored_count"), F.count_if("failed").alias("failed_count"))
    return out.select(F.lit(run_id).alias("run_id"), F.lit(started).cast("timestamp").alias("started"), F.lit(config_hash(config)).alias("config_hash"), "scored_count", "failed_count", F.lit(weights).alias("weights"))


def backfill(snapshots: DataFrame, runs: DataFrame, scores: DataFrame, members: DataFrame) -> DataFrame:
    """Snapshots of old runs that have none: runs(run_id, run_date), scores(run_id, ticker, ...), members(run_id, ticker).

    A run without a date, or with a snapshot of its date and id, adds nothing.
    """
    new = runs.where("run_date is not null").join(snapshots.select("run_date", "run_id").distinct(), ["run_date", "run_id"], "left_anti")
    held = members.select("run_id", "ticker", F.lit(True).alias("m")).distinct()
    out = scores.join(new, "run_id").join(held, ["run_id", "ticker"], "left").withColumn("in_portfolio", F.coalesce("m", F.lit(False))).drop("m")
    return snapshots.unionByName(out.select(*snapshots.columns))


def write_csv_with_notes(df: DataFrame, path: str, notes: Sequence[str]) -> None:
    """CSV parts without header and, in a part of its own, the notes and the names of the columns as ``#`` lines."""
    df.write.mode("overwrite").csv(path)
    lines = [*[f"# {n}" for n in notes], "# " + ",".join(df.columns)]
    df.sparkSession.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("append").text(path)


def read_csv_with_notes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("comment", "#").schema(schema).csv(path, pathGlobFilter="part-*")
