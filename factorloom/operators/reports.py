"""Tables for reports and screens over scored securities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import quantile, rounded
from ..functions.store import stored


def band(x: Column, cuts: Sequence[tuple[float, str]], rest: str) -> Column:
    """The name of the first cut that x reaches, from the highest on."""
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for at, name in cuts:
        out = out.when(x >= at, name)
    return out.otherwise(rest)


def top_n(scored: DataFrame, n: int = 25) -> DataFrame:
    """Ranks up to n with the quartile band of the composite over all securities."""
    cuts = scored.agg(F.count("composite").alias("n"), *[quantile(F.col("composite"), q).alias(k) for k, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))])
    for k, default in (("q1", 40.0), ("q2", 55.0), ("q3", 70.0)):
        cuts = cuts.withColumn(k, F.when(F.col("n") >= 4, F.col(k)).otherwise(default))
    out = scored.where(F.col("rank") <= n).crossJoin(F.broadcast(cuts.drop("n")))
    quartile = F.when(F.col("composite") >= F.col("q3"), "Q1").when(F.col("composite") >= F.col("q2"), "Q2").when(F.col("composite") >= F.col("q1"), "Q3").otherwise("Q4")
    return out.withColumn("band", quartile).drop("q1", "q2", "q3")


def bottom_n(scored: DataFrame, n: int = 5) -> DataFrame:
    return scored.where(F.col("rank").isNotNull()).orderBy(F.col("rank").desc(), F.col("ticker").desc()).limit(n)


def sector_summary(scored: DataFrame, top: int = 25) -> DataFrame:
    out = scored.groupBy("sector").agg(F.avg("composite").alias("mean"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("rank") <= top).alias("in_top"))
    out = out.withColumn("mean", rounded(F.col("mean"), 2))
    return out.withColumn("band", band(F.col("mean"), [(60.0, "high"), (45.0, "medium")], "low"))


def histogram(scored: DataFrame, column: str, bins: int, top: float = 100.0) -> DataFrame:
    """Counts of equal bins over [0, top], the last one closed, empty ones too."""
    at = F.least(F.floor(F.col(column) / F.lit(top / bins)), F.lit(bins - 1)).cast("int").alias("bin")
    counts = scored.where(F.col(column).isNotNull()).groupBy(at).agg(F.count(F.lit(1)).alias("n"))
    every = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counts), "bin", "left").fillna(0, ["n"])


def trap_by_sector(scored: DataFrame) -> DataFrame:
    rate = lambda c: rounded(F.count_if(F.col(c)) / F.count(F.lit(1)) * 100, 2)
    return scored.groupBy("sector").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("value_trap").alias("value_traps"), rate("value_trap").alias("value_rate"), F.count_if("growth_trap").alias("growth_traps"), rate("growth_trap").alias("growth_rate")
    )


def sector_distribution(scored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column and sector: minimum, quartiles by position (n//4, n//2, 3n//4), mean, maximum, count."""
    tall = scored.unpivot("sector", list(columns), "factor", "value").where("value is not null")
    by = Window.partitionBy("factor", "sector")
    ranked = tall.withColumn("i", F.row_number().over(by.orderBy("value")) - 1).withColumn("n", F.count(F.lit(1)).over(by))
    at = lambda e: F.max(F.when(F.col("i") == F.floor(e), F.col("value")))
    return ranked.groupBy("factor", "sector").agg(
        F.min("value").alias("low"), at(F.col("n") / 4).alias("q1"), at(F.col("n") / 2).alias("median"), at(F.col("n") * 3 / 4).alias("q3"), F.max("value").alias("high"), rounded(F.avg("value"), 4).alias("mean"), F.count(F.lit(1)).alias("n")
    )


def kpis(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("universe"),
        F.count("composite").alias("scored"),
        F.count_if("value_trap").alias("value_traps"),
        F.count_if("growth_trap").alias("growth_traps"),
        rounded(F.avg("composite"), 2).alias("mean"),
        rounded(quantile(F.col("composite"), 0.5), 2).alias("median"),
    )


def _halo(ends: DataFrame, n: int, ahead: bool, order: Sequence[str]) -> DataFrame:
    """For each range the ``n`` rows next to it in the ranges ahead of it or behind, out of ``ends``: the outermost n rows of each range.

    Any range has a row, so the next n ranges hold n rows.
    """
    steps = F.explode(F.sequence(F.lit(1), F.lit(n)))
    to = ends.withColumn("step", steps).withColumn("range", F.col("range") + (F.col("step") if ahead else -F.col("step")))
    nearest = [F.col(c).desc() if ahead else F.col(c).asc() for c in order]
    return to.withColumn("nth", F.row_number().over(Window.partitionBy("range").orderBy(*nearest))).where(F.col("nth") <= n).drop("nth", "step")


def peers(universe: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` securities of the same sector whose size is next to each one's own, by |ratio - 1|, ties by ticker.

    Sizes of all sectors are put in order in ranges that Spark balances, each with the n sizes on either
    side of it that lie in other ranges, so no sector is one task's work. A size that many securities
    have is one row with the first n + 1 of them, so a row meets n sizes below, its own and n above.
    """
    has = universe.where(F.col("market_cap") > 0).select("ticker", "sector", F.col("market_cap").cast("double").alias("market_cap"))
    has = stored(has, "sizes")
    leading = has.withColumn("nth", F.row_number().over(Window.partitionBy("sector", "market_cap").orderBy("ticker"))).where(F.col("nth") <= n + 1)
    sizes = leading.groupBy("sector", "market_cap").agg(F.array_sort(F.collect_list("ticker")).alias("tickers"))
    order = ["sector", "market_cap"]
    tasks = int(universe.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(sizes.repartitionByRange(tasks, *order).withColumn("part", F.spark_partition_id()), "size-ranges")
    # a row for each range: ranges without rows are left out, and the others numbered on
    dense = ranged.select("part").distinct().withColumn("range", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("part")))
    ranged = ranged.join(F.broadcast(dense), "part").drop("part")
    inside = Window.partitionBy("range")
    numbered = ranged.withColumn("i", F.row_number().over(inside.orderBy(*order))).withColumn("j", F.count(F.lit(1)).over(inside) - F.col("i"))
    first, last = numbered.where(F.col("i") <= n).drop("i", "j"), numbered.where(F.col("j") < n).drop("i", "j")
    halo = _halo(last, n, True, order).unionByName(_halo(first, n, False, order))
    rows = ranged.withColumn("own", F.lit(True)).unionByName(halo.withColumn("own", F.lit(False)))
    by = Window.partitionBy("range", "sector").orderBy("market_cap")
    here = F.struct(F.col("market_cap").alias("size"), "tickers")
    near = [f(here, i).over(by) for i in range(1, n + 1) for f in (F.lag, F.lead)]
    met = rows.withColumn("near", F.array_compact(F.array(here, *near))).where("own")
    each = F.flatten(F.transform("near", lambda x: F.transform(x["tickers"], lambda t: F.struct(F.abs(x["size"] / F.col("market_cap") - 1).alias("distance"), t.alias("peer")))))
    met = met.select(*order, F.slice(F.array_sort(each), 1, n + 1).alias("best"))  # one more than n: a row's own ticker goes
    out = has.join(met, order).withColumn("best", F.slice(F.filter("best", lambda x: x["peer"] != F.col("ticker")), 1, n))
    out = out.select("ticker", F.posexplode("best").alias("nth", "x"))
    return out.select("ticker", F.col("x.peer").alias("peer"), (F.col("nth") + 1).alias("nth"), rounded(F.col("x.distance"), 6).alias("distance"))


def sector_context(scored: DataFrame, metrics: DataFrame, columns: Sequence[str], top: int = 10, least: int = 3) -> DataFrame:
    """Quartiles of metrics in the sectors of the ``top`` best."""
    sectors = scored.where(F.col("rank") <= top).select("sector").distinct()
    tall = metrics.join(F.broadcast(sectors), "sector", "left_semi").unpivot("sector", list(columns), "metric", "value").where("value is not null")
    out = tall.groupBy("sector", "metric").agg(F.count(F.lit(1)).alias("n"), *[rounded(quantile(F.col("value"), q), 6).alias(k) for k, q in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))])
    return out.where(F.col("n") >= least)


def score_forensics(ranked: DataFrame) -> DataFrame:
    """Ticker by metric: percentile, weight and weighted points inside the category."""
    got = F.sum("weight").over(Window.partitionBy("ticker", "category"))
    return ranked.select("ticker", "category", "metric", "value", F.col("pct"), F.col("weight"), F.when(got > 0, F.col("weight") * F.col("pct") / got).alias("points"))


def category_forensics(scored: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Ticker by category: score, weight, and score times weight; without a score or weight there are no points."""
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"{c}_score").alias("score"), F.lit(float(w)).alias("weight")) for c, w in weights.items()])
    each = scored.select("ticker", F.explode(rows).alias("c")).select("ticker", "c.*")
    return each.withColumn("points", F.when(F.col("weight") > 0, F.col("score") * F.col("weight")))


#: How the tables of a summary are coloured: table -> (what of the value counts, cuts from the highest on, rest).
BANDS = {
    "sector_delta": (F.abs, [(10.0000001, "far"), (5.0000001, "off")], "near"),
    "exposure": (lambda x: x, [(65.0, "strong"), (50.0, "fair")], "weak"),
    "jaccard": (lambda x: x, [(0.85, "robust"), (0.7, "fair")], "sensitive"),
    "correlation": (F.abs, [(0.99000001, "same"), (0.80000001, "very high"), (0.60000001, "high")], "low"),
}


def summary_bands(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(summary, item, value, band) of tables(item, value) by the cuts of ``BANDS``; a value without number has no band."""
    out = []
    for name, df in tables.items():
        what, cuts, rest = BANDS[name]
        out.append(df.select(F.lit(name).alias("summary"), F.col("item").cast("string").alias("item"), F.col("value").cast("double").alias("value"), band(what(F.col("value")), cuts, rest).alias("band")))
    return reduce(DataFrame.unionByName, out)


#: Raw metrics that are shown for the best securities.
SHOWN = ("ev_ebitda", "fcf_yield", "earnings_yield", "roic", "debt_equity", "forward_eps_growth", "revenue_growth", "return_12_1", "volatility", "beta", "analyst_surprise", "short_interest_ratio")


def company_snapshot(f: DataFrame) -> DataFrame:
    """Sizes, growth, margins, free cash flow, net debt and yield; null where a part is missing or the base is not positive."""
    growth = lambda a, b: F.when(F.abs(b) > 0, (F.col(a) - F.col(b)) / F.abs(b))
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return f.select(
        "ticker", "market_cap", "enterprise_value", "revenue", rounded(growth("revenue", "revenue_prior"), 4).alias("revenue_growth_yoy"), "net_income", rounded(growth("net_income", "net_income_prior"), 4).alias("ni_growth_yoy"),
        "ebitda", rounded(over("gross_profit", "revenue"), 4).alias("gross_margin"), rounded(over("net_income", "revenue"), 4).alias("net_margin"), rounded(F.col("ocf") - F.abs("capex"), 2).alias("fcf"),
        "total_debt", "total_cash", rounded(F.col("total_debt") - F.col("total_cash"), 2).alias("net_debt"), rounded(over("dividend_rate", "price"), 4).alias("dividend_yield"), "payout_ratio", "shares", "trailing_eps", "forward_eps", "dollar_volume", "short_ratio",
    )


# -- screens -----------------------------------------------------------------------------------------


def screen_filter(scored: DataFrame, sector: str | None = None, traps: str = "any", least: float | None = None, search: str | None = None) -> DataFrame:
    """Securities of a sector, with or without traps ('clean', 'vt', 'gt', 'any'), of a least composite
    (unknown ones pass), whose ticker or company holds ``search``."""
    out = scored
    if sector is not None:
        out = out.where(F.col("sector") == sector)
    if traps != "any":
        out = out.where({"clean": ~F.col("value_trap") & ~F.col("growth_trap"), "vt": F.col("value_trap"), "gt": F.col("growth_trap")}[traps])
    if least is not None:
        out = out.where(F.col("composite").isNull() | (F.col("composite") >= least))
    if search:
        out = out.where(F.contains(F.lower("ticker"), F.lit(search.lower())) | F.contains(F.lower("company"), F.lit(search.lower())))
    return out


def screen_sort(df: DataFrame, column: str, ascending: bool = True, n: int | None = None) -> DataFrame:
    """Nulls last either way; ties by ticker."""
    order = F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_last()
    out = df.orderBy(order, "ticker")
    return out if n is None else out.limit(n)


def security_search(universe: DataFrame, text: str, exclude: Sequence[str] = (), n: int = 8) -> DataFrame:
    return screen_sort(screen_filter(universe, search=text).where(~F.col("ticker").isin(*exclude)), "ticker", n=n)
