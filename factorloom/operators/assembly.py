"""Metrics of prices and earnings joined to those of fundamentals: one wide row per security."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import rounded
from . import prices as P


def trailing(prices: DataFrame, days: int = 365) -> DataFrame:
    """Rows of each ticker less than ``days`` before its last one."""
    last = F.max("dt").over(Window.partitionBy("ticker"))
    return prices.withColumn("last", last).where(F.col("dt") > F.date_sub("last", days)).drop("last")


def risk_metrics(returns: DataFrame, market: DataFrame, risk_free: float = 0.045, least: int = 200, least_below: int = 20, least_fall: int = 50, least_share: float = 0.8, periods: int = 252) -> DataFrame:
    """Volatility, beta, downside deviation and deepest drawdown of each ticker's daily returns: one window and one aggregate by ticker.

    The rules are those of ``prices.annualised_vol``, ``beta``, ``sortino_inputs`` and ``max_drawdown``.
    """
    upto = Window.partitionBy("ticker").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    rows = returns.select("ticker", "dt", "ret").join(market.select("dt", F.col("ret").alias("mkt")), "dt", "left")
    rows = rows.withColumn("cum", F.product(1 + F.col("ret")).over(upto)).withColumn("peak", F.max("cum").over(upto))
    daily, year = (1 + risk_free) ** (1 / periods) - 1, F.sqrt(F.lit(float(periods)))
    below = F.when(F.col("ret") < daily, F.col("ret") - daily)
    n, both = F.count("ret"), F.count("mkt")
    out = rows.groupBy("ticker").agg(
        F.when(n >= least, F.stddev_samp("ret") * year).alias("volatility"),
        F.when(F.count(below) >= least_below, F.stddev_samp(below) * year).alias("downside"),
        F.when(n >= least_fall, F.min((F.col("cum") - F.col("peak")) / F.col("peak"))).alias("max_drawdown_1y"),
        both.alias("both"),
        F.covar_samp("ret", "mkt").alias("cov"),
        F.var_samp("mkt").alias("var"),
    )
    out = out.crossJoin(market.agg(F.count(F.lit(1)).alias("dates")))
    enough = (F.col("both") >= least) & (F.col("both") >= F.col("dates") * least_share) & (F.col("var") > 0)
    return out.select("ticker", "volatility", "downside", "max_drawdown_1y", F.when(enough, F.col("cov") / F.col("var")).alias("beta"))


def revision_metrics(earnings: DataFrame) -> DataFrame:
    """Surprise, acceleration and beat score of each ticker's last quarters: one shuffle by ticker, as in ``prices``."""
    by = Window.partitionBy("ticker")
    rows = P.surprises(earnings).withColumn("k", F.row_number().over(by.orderBy("i"))).withColumn("place", F.row_number().over(by.orderBy(F.col("i").desc())))
    two = F.count(F.lit(1)) >= 2
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("surprise")))
    beats = F.sum(F.when(F.col("surprise") > 0, F.col("place")).otherwise(0)).cast("double")
    return rows.groupBy("ticker").agg(F.when(two, F.percentile("surprise", F.lit(0.5))).alias("analyst_surprise"), (pick(1) - pick(2)).alias("earnings_acceleration"), F.when(two, beats).alias("consecutive_beat_streak"))


def assembled(metrics: DataFrame, risk: DataFrame, revisions: DataFrame, market_total: DataFrame, names: Sequence[str], risk_free: float = 0.045, series: str = "series", earner: str = "earner", digits: int = 8) -> DataFrame:
    """All metrics in one row per security.

    ``metrics`` come from the security's own fundamentals; ``series`` and ``earner`` name its price
    series and its earnings. Sharpe and Sortino ratios and the alpha take the return over twelve months
    without a skipped month. Values are rounded, so that equal inputs tie whatever the order of sums.
    """
    out = metrics.join(risk.withColumnRenamed("ticker", series), series, "left").join(revisions.withColumnRenamed("ticker", earner), earner, "left").crossJoin(market_total)
    excess = F.col("return_12m") - F.lit(risk_free)
    out = out.withColumns(
        {
            "sharpe_ratio": F.when(F.col("volatility") > 0, excess / F.col("volatility")),
            "sortino_ratio": F.when(F.col("downside") > 0, excess / F.col("downside")),
            "jensens_alpha": F.col("return_12m") - (F.lit(risk_free) + F.col("beta") * (F.col("total") - F.lit(risk_free))),
        }
    )
    return out.select("ticker", "company", "sector", "is_bank", *[rounded(F.col(n), digits).alias(n) for n in names])
