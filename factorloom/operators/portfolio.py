"""Model portfolios: selection under a sector cap, weights under a position cap, statistics.

``keys`` holds several portfolios in one plan. Windows inside a portfolio go over its few dozen rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import quantile, rounded, steady
from ..functions.store import stored

ONE = "portfolio"


def eligible(scored: DataFrame, drop_traps: bool = True, least_coverage: float = 0.6, least_volume: float | None = None) -> DataFrame:
    """Without trap flags, then at or above the median composite of what is left, with enough metrics and volume."""
    left = scored.where(~F.col("value_trap") & ~F.col("growth_trap")) if drop_traps else scored
    median = left.agg(quantile(F.col("composite"), 0.5).alias("median"))
    out = left.crossJoin(F.broadcast(median)).where(F.col("composite") >= F.col("median")).drop("median")
    if "coverage" in out.columns:
        out = out.where(F.col("coverage") >= least_coverage)
    if least_volume is not None:
        out = out.where(F.col("dollar_volume") >= least_volume)
    return out


def select(scored: DataFrame, stocks: int = 25, per_sector: int = 8, least: int = 20, keys: Sequence[str] = ()) -> DataFrame:
    """The best by composite with at most ``per_sector`` of a sector."""
    by_sector = Window.partitionBy(*keys, "sector").orderBy(F.col("composite").desc_nulls_last(), "ticker")
    capped = scored.withColumn("in_sector", F.row_number().over(by_sector)).where(F.col("in_sector") <= per_sector)
    order = [F.col("composite").desc_nulls_last(), F.col("ticker")]
    if not keys:
        chosen = capped.orderBy(*order).limit(max(stocks, least))
        return chosen.withColumn("port_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).drop("in_sector")
    ranked = capped.withColumn("port_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("port_rank") <= max(stocks, least)).drop("in_sector")


def _all(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*(list(keys) or [F.lit(0)]))


def weight_equal(port: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    n = F.count(F.lit(1)).over(_all(keys))
    return port.withColumn("weight", rounded(F.lit(100.0) / n, 2))


def _share(port: DataFrame, x: Column, keys: Sequence[str]) -> DataFrame:
    return port.withColumn("x", x).withColumn("weight", steady(F.col("x") / F.sum("x").over(_all(keys)) * 100)).drop("x")


def weight_inverse_vol(port: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """1 / volatility; unknown ones take the median, and none counts as lower than a tenth of it or 5%."""
    median = F.percentile(F.when(F.col("volatility") > 0, F.col("volatility")), F.lit(0.5)).over(_all(keys))
    median = F.coalesce(F.when(median > 0, median), F.lit(0.25))
    vol = F.when(F.col("volatility") > 0, F.col("volatility")).otherwise(median)
    return _share(port, F.lit(1.0) / F.greatest(vol, median * 0.1, F.lit(0.05)), keys)


def weight_score(port: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    median = F.percentile("composite", F.lit(0.5)).over(_all(keys))
    return _share(port, F.greatest(F.coalesce("composite", median), F.lit(1.0)), keys)


def _capped(weights: Column, cap: float, rounds: int) -> Column:
    """A fold over ``rounds`` on an array of weights: what is over ``cap`` is cut, and what was cut goes to the others by their weights.

    It ends once no more than 0.001 is cut, or when all are over the cap; what the last cut took is then lost. With nothing
    but zeros to give to, all of these get equal parts.
    """
    zero = F.lit(0.0)
    total = lambda xs: F.aggregate(xs, zero, lambda a, x: a + x)

    def one(state: Column, _: Column) -> Column:
        old = state["w"]
        excess = total(F.transform(old, lambda x: F.greatest(x - cap, zero)))
        free = F.filter(old, lambda x: x <= cap)
        share = lambda x: F.when(total(free) > 0, x / total(free)).otherwise(F.lit(1.0) / F.size(free))
        ends = (excess <= 0.001) | (F.size(free) == 0)
        new = F.transform(old, lambda x: F.when(x > cap, F.lit(cap)).when(ends, x).otherwise(x + excess * share(x)))
        return F.struct(F.when(state["done"], old).otherwise(new).alias("w"), (state["done"] | ends).alias("done"))

    start = F.struct(weights.alias("w"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, one, lambda s: s["w"])


def cap_redistribute(port: DataFrame, cap: float = 5.0, rounds: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Cut weights at ``cap`` and give the excess to those not cut pro rata, again and again; a null weight counts as 0.

    The weights of a portfolio (some dozens) are one array, and the rounds a fold over it, so any number of
    portfolios takes one grouping and one join, not a window for each round.
    """
    by = list(keys)
    rows = stored(port.withColumn("_nth", F.monotonically_increasing_id()), "weights")
    held = F.array_sort(F.collect_list(F.struct(F.col("_nth").alias("nth"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("w"))))
    one = rows.groupBy(*by).agg(held.alias("held"))
    paired = F.zip_with(F.col("held.nth"), _capped(F.col("held.w"), cap, rounds), lambda nth, w: F.struct(nth.alias("_nth"), w.alias("_w")))
    new = one.select(F.explode(paired).alias("z")).select("z.*")
    return rows.join(new, "_nth").withColumn("weight", F.col("_w")).drop("_nth", "_w")


def round_to_100(port: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Two digits that sum to 100: the largest remainders are rounded up."""
    scaled = F.col("weight") / F.sum("weight").over(_all(keys)) * 10000
    out = port.withColumn("scaled", steady(scaled)).withColumn("whole", F.floor("scaled"))
    order = _all(keys).orderBy((F.col("scaled") - F.col("whole")).desc(), "ticker")
    out = out.withColumn("lack", F.lit(10000) - F.sum("whole").over(_all(keys))).withColumn("nth", F.row_number().over(order))
    return out.withColumn("weight", (F.col("whole") + (F.col("nth") <= F.col("lack")).cast("int")) / 100).drop("scaled", "whole", "lack", "nth")


def stats(port: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Size and weighted composite, beta (unknown: 1) and dividend yield (unknown: 0)."""
    mean = lambda x: rounded(F.sum(F.col("weight") * x) / F.sum("weight"), 4)
    return port.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        mean(F.col("composite")).alias("composite"),
        mean(F.coalesce(F.col("beta"), F.lit(1.0))).alias("beta"),
        mean(F.coalesce(F.col("dividend_yield"), F.lit(0.0))).alias("dividend_yield"),
    )


def sector_allocation(port: DataFrame, per_sector: int = 8, keys: Sequence[str] = ()) -> DataFrame:
    out = port.groupBy(*keys, "sector").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("weight"), 4).alias("weight"))
    return out.withColumn("at_cap", F.col("n") >= per_sector)


def factor_exposure(port: DataFrame, categories: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    cols = [rounded(F.sum(F.col("weight") * F.coalesce(F.col(f"{c}_score"), F.lit(50.0))) / F.sum("weight"), 4).alias(c) for c in categories]
    return port.groupBy(*keys).agg(*cols).unpivot(list(keys), list(categories), "category", "exposure")


def versus_benchmark(port: DataFrame, universe: DataFrame, weight: str) -> DataFrame:
    """Sector weights of the portfolio and of the universe by ``weight``, over all sectors of either."""
    ours = port.groupBy("sector").agg(F.sum("weight").alias("ours"))
    total = universe.groupBy("sector").agg(F.sum(weight).alias("w"))
    theirs = total.withColumn("theirs", F.col("w") / F.sum("w").over(_all(())) * 100).drop("w")
    both = ours.join(theirs, "sector", "full_outer").fillna(0.0, ["ours", "theirs"])
    return both.select("sector", rounded(F.col("ours"), 4).alias("portfolio"), rounded(F.col("theirs"), 4).alias("benchmark"), rounded(F.col("ours") - F.col("theirs"), 4).alias("active"))


def naive_top(scored: DataFrame, n: int = 25) -> DataFrame:
    return scored.where(~F.col("value_trap") & ~F.col("growth_trap")).orderBy(F.col("rank").asc_nulls_last(), "ticker").limit(n)
