"""Proposals for new weights from information coefficients; tables of a few rows per category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import rounded


def everything():
    """All rows: the tables here have a row for each category."""
    return Window.partitionBy()


def ic_allocation(ics: DataFrame, total: float = 100.0) -> DataFrame:
    """ics(category, ic, weight, low, high): weights by positive IC; others get their lower bound.

    If no IC is positive, all get their lower bounds and equal parts of the rest.
    """
    positive = F.greatest(F.coalesce("ic", F.lit(0.0)), F.lit(0.0))
    out = ics.withColumn("pos", positive).withColumn("sum_pos", F.sum("pos").over(everything()))
    held = F.sum(F.when(F.col("pos") > 0, 0.0).otherwise(F.col("low"))).over(everything())
    none = F.col("low") + (F.lit(total) - F.sum("low").over(everything())) / F.count(F.lit(1)).over(everything())
    share = F.when(F.col("pos") > 0, (F.lit(total) - held) * F.col("pos") / F.col("sum_pos")).otherwise(F.col("low"))
    return out.withColumn("target", F.when(F.col("sum_pos") > 0, share).otherwise(none)).drop("pos", "sum_pos")


def constrain(df: DataFrame, most: float = 3.0, column: str = "target") -> DataFrame:
    """Inside the bounds and at most ``most`` from the current weight, one digit, scaled to 100; the largest takes what rounding leaves."""
    inside = lambda x: F.least(F.greatest(x, F.col("low")), F.col("high"))
    step = F.least(F.greatest(inside(F.col(column)), F.col("weight") - most), F.col("weight") + most)
    out = df.withColumn("p", rounded(inside(step), 1))
    out = out.withColumn("p", rounded(F.col("p") * 100 / F.sum("p").over(everything()), 1))
    first = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("p").desc(), "category"))
    out = out.withColumn("left", F.lit(100.0) - F.sum("p").over(everything())).withColumn("nth", first)
    return out.withColumn("proposed", rounded(F.when(F.col("nth") == 1, F.col("p") + F.col("left")).otherwise(F.col("p")), 1)).drop("p", "left", "nth")


def propose(ics: DataFrame, shrink: float = 0.5, most: float = 3.0, observations: int = 0) -> DataFrame:
    """Current weights moved toward the allocation, with change, direction, confidence, and whether it may be applied unasked."""
    target = ic_allocation(ics).withColumn("target", F.col("weight") * shrink + F.col("target") * (1 - shrink))
    out = constrain(target, most).withColumn("change", rounded(F.col("proposed") - F.col("weight"), 1))
    direction = F.when(F.col("change") > 0, "up").when(F.col("change") < 0, "down").otherwise("same")
    confidence = "high" if observations >= 50 else "medium" if observations >= 24 else "low"
    safe = (F.max(F.abs("change")).over(everything()) <= 2) & F.lit(confidence != "low")
    return out.select("category", "weight", "proposed", "change", direction.alias("direction"), F.lit(confidence).alias("confidence"), safe.alias("auto_apply"))


def regime_adjust(weights: DataFrame, regimes: DataFrame, scale: float = 0.1) -> DataFrame:
    """weights(category, weight), regimes(category, regime): more where dispersion is high, less where it is low, then to 100."""
    factor = F.when(F.col("regime") == "high", 1 + scale).when(F.col("regime") == "low", 1 - scale).otherwise(1.0)
    out = weights.join(regimes, "category", "left").withColumn("w", F.col("weight") * factor)
    return out.select("category", "weight", "regime", rounded(F.col("w") * 100 / F.sum("w").over(everything()), 4).alias("adjusted"))


def metric_proposal(ics: DataFrame, shrink: float = 0.5, most: float = 5.0) -> DataFrame:
    """ics(category, metric, ic, weight), all categories at once: toward the share of positive IC, within ``most``, to 100."""
    by = Window.partitionBy("category")
    pos = F.greatest(F.coalesce("ic", F.lit(0.0)), F.lit(0.0))
    out = ics.withColumn("pos", pos).withColumn("all_pos", F.sum("pos").over(by))
    aim = F.when(F.col("all_pos") > 0, F.col("weight") * shrink + (1 - shrink) * 100 * F.col("pos") / F.col("all_pos")).otherwise(F.col("weight"))
    out = out.withColumn("p", F.greatest(F.lit(0.0), F.least(F.greatest(aim, F.col("weight") - most), F.col("weight") + most)))
    return out.select("category", "metric", "weight", rounded(F.col("p") * 100 / F.sum("p").over(by), 2).alias("proposed"))


def metric_evolution(trends: DataFrame, run: int = 12, least_ic: float = 0.02, least_positive: float = 60.0, starts: int = 1, step: float = 5.0, candidates: Sequence[str] | None = None) -> DataFrame:
    """trends(category, metric, weight, ewm, positive_run, negative_run, positive_pct): metrics to take in and to lower.

    Only ``candidates`` are taken in and only others lowered; without that list, any metric may be either.
    """
    may = F.lit(True) if candidates is None else F.col("metric").isin(*candidates)
    stays = F.lit(False) if candidates is None else F.col("metric").isin(*candidates)
    fit = may & (F.col("weight") == 0) & (F.col("ewm") >= least_ic) & (F.col("positive_run") >= run) & (F.col("positive_pct") >= least_positive)
    new = trends.where(fit).withColumn("nth", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("ewm").desc(), "metric"))).where(F.col("nth") <= starts)
    down = trends.where(~stays & (F.col("weight") > 0) & (F.col("ewm") <= 0) & (F.col("negative_run") >= run))
    pick = lambda df, action, w: df.select("category", "metric", F.lit(action).alias("action"), F.col("weight"), w.alias("new_weight"))
    return pick(new, "activate", F.lit(step)).unionByName(pick(down, "lower", F.greatest(F.lit(0.0), F.col("weight") - step)))


def redistribute(weights: DataFrame, changes: DataFrame) -> DataFrame:
    """weights(category, metric, weight), changes(category, metric, action, new_weight): new weights of the categories that change.

    Lowered metrics free weight and activated ones need it; the net need is taken from, or the net rest
    given to, the other metrics in use by their weights; then the category is scaled to 100 if it is off
    by more than half a point, and its largest metric takes what rounding leaves.
    """
    by = Window.partitionBy("category")
    out = weights.join(changes.select("category", "metric", "action", "new_weight"), ["category", "metric"], "full_outer")
    out = out.withColumn("weight", F.coalesce("weight", F.lit(0.0))).withColumn("w", F.coalesce("new_weight", "weight"))
    out = out.withColumn("touched", F.count("action").over(by)).where("touched > 0")
    needed = F.sum(F.when(F.col("action") == "activate", F.col("new_weight"))).over(by)
    freed = F.sum(F.when(F.col("action") == "lower", F.col("weight") - F.col("new_weight"))).over(by)
    out = out.withColumn("net", F.coalesce(needed, F.lit(0.0)) - F.coalesce(freed, F.lit(0.0)))
    sits_out = F.when(F.col("net") > 0, "activate").otherwise("lower")
    takes = (F.col("w") > 0) & ~F.coalesce(F.col("action") == sits_out, F.lit(False))
    out = out.withColumn("base", F.when(takes, F.col("w"))).withColumn("total", F.sum("base").over(by))
    moved = F.when(F.col("base").isNull() | (F.col("net") == 0) | (F.col("total") <= 0), F.col("w")).otherwise(rounded(F.greatest(F.lit(0.0), F.col("base") - F.col("base") / F.col("total") * F.col("net")), 1))
    out = out.withColumn("w", moved).withColumn("sum", F.sum("w").over(by))
    off = (F.abs(F.col("sum") - 100) > 0.5) & (F.col("sum") > 0)
    out = out.withColumn("off", off).withColumn("w", F.when(F.col("off"), rounded(F.col("w") * (F.lit(100.0) / F.col("sum")), 1)).otherwise(F.col("w")))
    out = out.withColumn("left", F.lit(100.0) - F.sum("w").over(by)).withColumn("nth", F.row_number().over(by.orderBy(F.col("w").desc(), "metric")))
    last = F.when(F.col("off") & (F.abs("left") > 0.01) & (F.col("nth") == 1), rounded(F.col("w") + F.col("left"), 1)).otherwise(F.col("w"))
    return out.select("category", "metric", "weight", last.alias("new_weight"))


def append_version(versions: DataFrame, new: DataFrame, as_of: str) -> DataFrame:
    """versions(version, as_of, category, metric, weight) and the next version: the last one with the weights of ``new(category, metric, new_weight)``."""
    newest = versions.agg(F.max("version").alias("newest"))
    last = versions.crossJoin(newest).where("version = newest").drop("as_of")
    nxt = last.join(new.select("category", "metric", "new_weight"), ["category", "metric"], "full_outer")
    at = nxt.crossJoin(newest.select((F.col("newest") + 1).alias("next")))
    return versions.unionByName(at.select(F.col("next").cast("int").alias("version"), F.lit(as_of).cast("date").alias("as_of"), "category", "metric", F.coalesce("new_weight", "weight").alias("weight")))


def change_log(changes: DataFrame, as_of: str) -> DataFrame:
    """A row for each change: kind, metric, old and new weight."""
    kind = F.when(F.col("action") == "activate", "metric_activation").otherwise("metric_deactivation")
    return changes.select(F.lit(as_of).cast("date").alias("date"), kind.alias("change_type"), "category", "metric", F.col("weight").alias("old_value"), F.col("new_weight").alias("new_value"))
