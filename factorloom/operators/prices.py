"""Price, return and event series: everything is a window or an aggregate by ticker."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio


def log_returns(prices: DataFrame, by: Sequence[str] = ("ticker",), dt: str = "dt") -> DataFrame:
    before = F.lag("close").over(Window.partitionBy(*by).orderBy(dt))
    return prices.where(F.col("close").isNotNull()).withColumn("ret", F.log(F.col("close") / before)).where("ret is not null")


def calendar_lookback(prices: DataFrame, days: Sequence[int] = (30, 182, 365)) -> DataFrame:
    """Per ticker the last close, and the close on or before so many days earlier: one pass, no join."""
    last = F.max("dt").over(Window.partitionBy("ticker"))
    rows = prices.where(F.col("close").isNotNull()).withColumn("last", last)
    cols = [F.max_by("close", F.when(F.col("dt") <= F.date_sub("last", d), F.col("dt"))).alias(f"close_{d}d") for d in days]
    return rows.groupBy("ticker").agg(F.max_by("close", "dt").alias("close"), *cols)


def annualised_vol(returns: DataFrame, least: int = 200, periods: int = 252) -> DataFrame:
    n = F.count("ret")
    return returns.groupBy("ticker").agg(n.alias("n"), F.when(n >= least, F.stddev_samp("ret") * F.sqrt(F.lit(float(periods)))).alias("volatility"))


def dollar_volume(prices: DataFrame, rows: int = 63, least: int = 20) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("dt").desc()))
    recent = prices.withColumn("nth", nth).where(F.col("nth") <= rows)
    return recent.groupBy("ticker").agg(F.when(F.count(F.lit(1)) >= least, F.avg(F.col("close") * F.col("volume"))).alias("dollar_volume"))


def total_return(returns: DataFrame, least: int = 200) -> DataFrame:
    return returns.agg(F.count("ret").alias("n"), F.when(F.count("ret") >= least, F.exp(F.sum("ret")) - 1).alias("total"))


def beta(returns: DataFrame, market: DataFrame, least: int = 200, least_share: float = 0.8) -> DataFrame:
    """Covariance with the market over its variance, on common dates; the market series is one row per date."""
    both = returns.select("ticker", "dt", "ret").join(market.select("dt", F.col("ret").alias("mkt")), "dt")
    total = market.agg(F.count(F.lit(1)).alias("dates"))
    out = both.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.covar_samp("ret", "mkt").alias("cov"), F.var_samp("mkt").alias("var")).crossJoin(F.broadcast(total))
    enough = (F.col("n") >= least) & (F.col("n") >= F.col("dates") * least_share) & (F.col("var") > 0)
    return out.select("ticker", "n", (F.col("n") / F.col("dates")).alias("overlap"), F.when(enough, F.col("cov") / F.col("var")).alias("beta"))


def beta_tail_aligned(returns: DataFrame, market: DataFrame, least: int = 200) -> DataFrame:
    """Without dates: the last returns of both series, counted from the end."""
    mine = returns.withColumn("i", F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("dt").desc())))
    theirs = market.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("dt").desc()))).select("i", F.col("ret").alias("mkt"))
    both = mine.join(theirs, "i")
    return both.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.when((F.count(F.lit(1)) >= least) & (F.var_samp("mkt") > 0), F.covar_samp("ret", "mkt") / F.var_samp("mkt")).alias("beta"))


def sortino_inputs(returns: DataFrame, risk_free: float = 0.045, least: int = 20, periods: int = 252) -> DataFrame:
    daily = (1 + risk_free) ** (1 / periods) - 1
    below = F.when(F.col("ret") < daily, F.col("ret") - daily)
    return returns.groupBy("ticker").agg(F.count(below).alias("n_below"), F.when(F.count(below) >= least, F.stddev_samp(below) * F.sqrt(F.lit(float(periods)))).alias("downside"))


def max_drawdown(returns: DataFrame, least: int = 50, by: Sequence[str] = ("ticker",), dt: str = "dt") -> DataFrame:
    """Deepest fall from a peak of the compounded returns; the first value is the first peak."""
    upto = Window.partitionBy(*by).orderBy(dt).rowsBetween(Window.unboundedPreceding, 0)
    grown = returns.withColumn("cum", F.product(1 + F.col("ret")).over(upto))
    peaks = grown.withColumn("peak", F.max("cum").over(upto))
    return peaks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= least, F.min((F.col("cum") - F.col("peak")) / F.col("peak"))).alias("max_drawdown"))


def simple_returns_ffill(prices: DataFrame, months: DataFrame) -> DataFrame:
    """Month-over-month change on the grid of all months, missing prices carried forward."""
    grid = prices.select("ticker").distinct().crossJoin(F.broadcast(months)).join(prices, ["ticker", "month_end"], "left")
    by = Window.partitionBy("ticker").orderBy("month_end")
    filled = grid.withColumn("close", F.last("close", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return filled.withColumn("ret", ratio(F.col("close"), F.lag("close").over(by)) - 1).select("ticker", "month_end", "close", "ret")


def forward_return(returns: DataFrame) -> DataFrame:
    return returns.withColumn("fwd", F.lead("ret").over(Window.partitionBy("ticker").orderBy("month_end"))).where("fwd is not null")


def momentum_monthly(prices: DataFrame) -> DataFrame:
    """12-1 and 6-1 month momentum by position among the prices that are there."""
    by = Window.partitionBy("ticker").orderBy("month_end")
    lag = lambda k: F.lag("close", k).over(by)
    back = lambda k: F.when(lag(k) > 0, lag(1) / lag(k) - 1)
    return prices.where(F.col("close").isNotNull()).select("ticker", "month_end", back(12).alias("mom_12_1"), back(6).alias("mom_6_1"))


def monthly_returns(prices: DataFrame) -> DataFrame:
    by = Window.partitionBy("ticker").orderBy("month_end")
    return prices.where(F.col("close").isNotNull()).withColumn("ret", F.col("close") / F.lag("close").over(by) - 1)


def vol_monthly(prices: DataFrame, months: int = 12) -> DataFrame:
    over = Window.partitionBy("ticker").orderBy("month_end").rowsBetween(1 - months, 0)
    rets = monthly_returns(prices)
    return rets.select("ticker", "month_end", F.when(F.count("ret").over(over) == months, F.stddev_samp("ret").over(over) * F.sqrt(F.lit(12.0))).alias("vol"))


def beta_monthly(prices: DataFrame, market: DataFrame, months: int = 12, least: int = 10) -> DataFrame:
    """Over the last returns of stock and market, on the months that both have."""
    mkt = market.withColumn("mkt", F.col("close") / F.lag("close").over(Window.partitionBy(F.lit(0)).orderBy("month_end")) - 1).select("month_end", "mkt")
    both = monthly_returns(prices).where("ret is not null").join(F.broadcast(mkt), "month_end").where("mkt is not null")
    over = Window.partitionBy("ticker").orderBy("month_end").rowsBetween(1 - months, 0)
    value = F.covar_samp("ret", "mkt").over(over) / F.var_samp("mkt").over(over)
    return both.select("ticker", "month_end", F.when((F.count("ret").over(over) >= least) & (F.var_samp("mkt").over(over) > 0), value).alias("beta"))


def moving_monthly(prices: DataFrame, market: DataFrame, months: int = 12, least: int = 10) -> DataFrame:
    """``momentum_monthly``, ``vol_monthly`` and ``beta_monthly`` in one pass over the prices of a ticker, in order of time.

    Closes are positive, so only a ticker's first price has no return, and market months are those of the prices.
    """
    by = Window.partitionBy("ticker").orderBy("month_end")
    lag = lambda k: F.lag("close", k).over(by)
    back = lambda k: F.when(lag(k) > 0, lag(1) / lag(k) - 1)
    mkt = market.withColumn("mkt", F.col("close") / F.lag("close").over(Window.partitionBy(F.lit(0)).orderBy("month_end")) - 1).select("month_end", "mkt")
    rows = prices.where(F.col("close").isNotNull()).join(F.broadcast(mkt), "month_end", "left")
    rows = rows.select("ticker", "month_end", "mkt", (F.col("close") / lag(1) - 1).alias("ret"), back(12).alias("mom_12_1"), back(6).alias("mom_6_1"))
    over = by.rowsBetween(1 - months, 0)
    both = F.col("ret").isNotNull() & F.col("mkt").isNotNull()
    stock, whole = F.when(both, F.col("ret")), F.when(both, F.col("mkt"))
    vol = F.when(F.count("ret").over(over) == months, F.stddev_samp("ret").over(over) * F.sqrt(F.lit(12.0)))
    beta = F.when(both & (F.count(stock).over(over) >= least) & (F.var_samp(whole).over(over) > 0), F.covar_samp(stock, whole).over(over) / F.var_samp(whole).over(over))
    return rows.select("ticker", "month_end", "mom_12_1", "mom_6_1", vol.alias("vol"), beta.alias("beta"))


def nearest_price(targets: DataFrame, prices: DataFrame, days: int = 7) -> DataFrame:
    """targets(ticker, target): the price nearest in time, at most ``days`` away, the earlier one of two; of several prices of a day the lowest.

    An as-of join in sorted passes: prices and targets of a ticker are put in order of time together, and the last price
    at or before a target, and the first at or after it, are carried along. Each price is read once, and no
    target meets more than two.
    """
    day = F.struct(F.col("dt"), F.col("close"))
    have = prices.where(F.col("close").isNotNull() & F.col("dt").isNotNull()).groupBy("ticker", "dt").agg(F.min("close").alias("close"))
    have = have.select("ticker", F.col("dt").alias("at"), day.alias("price"))
    asked = targets.select("ticker", F.col("target").alias("at")).where("at is not null").distinct()
    both = have.unionByName(asked.withColumn("price", F.lit(None).cast(have.schema["price"].dataType)))
    upto = Window.partitionBy("ticker").orderBy("at", F.col("price").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("ticker").orderBy(F.col("at").desc(), F.col("price").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("before", F.last("price", ignorenulls=True).over(upto)).withColumn("after", F.last("price", ignorenulls=True).over(down)).where("price is null")
    back, on = F.datediff("at", "before.dt"), F.datediff("after.dt", "at")
    earlier = F.coalesce(back <= on, F.col("before").isNotNull())
    found = carried.select("ticker", F.col("at").alias("target"), F.when(earlier, F.col("before.close")).otherwise(F.col("after.close")).alias("close"), F.when(earlier, back).otherwise(on).alias("days"))
    return found.where(F.col("days") <= days)


def forward_returns_horizons(snapshot: DataFrame, prices: DataFrame, horizons: dict[str, int], as_of: str) -> DataFrame:
    """snapshot(ticker, run_date): returns over each horizon that has passed by ``as_of``; rows without the shortest go."""
    base = snapshot.select("ticker", F.col("run_date").alias("target")).distinct()
    later = [snapshot.select("ticker", F.date_add("run_date", d).alias("target")).where(F.col("target") <= F.lit(as_of).cast("date")) for d in horizons.values()]
    for one in later:
        base = base.unionByName(one)
    found = nearest_price(base.distinct(), prices).select("ticker", "target", "close")
    out = snapshot.join(found.withColumnsRenamed({"target": "run_date", "close": "start"}), ["ticker", "run_date"]).where("start > 0")
    for name, d in horizons.items():
        then = found.select("ticker", F.date_sub("target", d).alias("run_date"), F.col("close").alias("end"))
        out = out.join(then, ["ticker", "run_date"], "left").withColumn(f"fwd_{name}", F.col("end") / F.col("start") - 1).drop("end")
    return out.where(F.col(f"fwd_{next(iter(horizons))}").isNotNull()).drop("start")


def portfolio_daily_return(prices: DataFrame, members: DataFrame) -> DataFrame:
    mine = prices.join(F.broadcast(members), "ticker", "left_semi")
    rets = mine.withColumn("ret", F.col("close") / F.lag("close").over(Window.partitionBy("ticker").orderBy("dt")) - 1)
    return rets.groupBy("dt").agg(F.avg("ret").alias("ret")).where("ret is not null")


def surprises(earnings: DataFrame, quarters: int = 4, least: float = 0.001, floor: float = 0.1) -> DataFrame:
    """Relative surprise of the last quarters; i counts from the newest; a quarter without figures or with a tiny estimate has none, and none stands in for it."""
    nth = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("quarter").desc()))
    recent = earnings.withColumn("i", nth).where(F.col("i") <= quarters)
    return recent.where(F.col("eps_actual").isNotNull() & (F.abs("eps_estimate") > least)).withColumn("surprise", (F.col("eps_actual") - F.col("eps_estimate")) / F.greatest(F.abs("eps_estimate"), F.lit(floor)))


def earnings_surprise(earnings: DataFrame) -> DataFrame:
    return surprises(earnings).groupBy("ticker").agg(F.when(F.count(F.lit(1)) >= 2, F.percentile("surprise", F.lit(0.5))).alias("surprise"))


def earnings_acceleration(earnings: DataFrame) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("ticker").orderBy("i"))
    valid = surprises(earnings).withColumn("k", k)
    pick = lambda n: F.max(F.when(F.col("k") == n, F.col("surprise")))
    return valid.groupBy("ticker").agg((pick(1) - pick(2)).alias("acceleration"))


def beat_score(earnings: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("i").desc()))
    valid = surprises(earnings).withColumn("place", place)
    return valid.groupBy("ticker").agg(F.when(F.count(F.lit(1)) >= 2, F.sum(F.when(F.col("surprise") > 0, F.col("place")).otherwise(0))).alias("beat_score"))


def risk_free_latest(bills: DataFrame, default: float = 0.045) -> DataFrame:
    return bills.agg(F.coalesce(F.max_by("close", "dt") / 100, F.lit(default)).alias("risk_free"))


def single_factor(returns: DataFrame, market: DataFrame) -> DataFrame:
    both = returns.select("ticker", "dt", "ret").join(market.select("dt", F.col("ret").alias("mkt")), "dt")
    return both.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("ret", "mkt").alias("slope"), F.regr_intercept("ret", "mkt").alias("intercept"), F.regr_r2("ret", "mkt").alias("r2"))
