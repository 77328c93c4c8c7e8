"""Correlations, sensitivity of ranks to weights, dispersion, and data-quality rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import quantile, rounded, steady


def weight_sensitivity(scored: DataFrame, weights: dict[str, float], shift: float = 5.0, top: int = 20) -> DataFrame:
    """Each category up and down by ``shift`` points, the others scaled to 100: what becomes of the best ``top``.

    The scenarios are rows, so all are ranked in one plan.
    """
    spark = scored.sparkSession
    cats = list(weights)
    rows = [("base", "none", *[float(weights[c]) for c in cats])]
    for c in cats:
        for sign, name in ((1, "up"), (-1, "down")):
            new = max(0.0, weights[c] + sign * shift)
            rest = sum(w for k, w in weights.items() if k != c)
            scaled = {k: round(w * (100 - new) / rest, 2) for k, w in weights.items() if k != c}
            rows.append((c, name, *[new if k == c else scaled[k] for k in cats]))
    scenarios = spark.createDataFrame(rows, "category string, direction string, " + ", ".join(f"w_{c} double" for c in cats))
    total = sum((F.when(F.col(f"{c}_score").isNotNull(), F.col(f"w_{c}")).otherwise(0.0) for c in cats), F.lit(0.0))
    score = sum((F.coalesce(F.col(f"w_{c}") * F.col(f"{c}_score"), F.lit(0.0)) for c in cats), F.lit(0.0))
    all_ = scored.select("ticker", *[f"{c}_score" for c in cats]).crossJoin(F.broadcast(scenarios))
    all_ = all_.select("category", "direction", "ticker", F.when(total > 0, steady(score / total)).alias("score"))
    nth = F.row_number().over(Window.partitionBy("category", "direction").orderBy(F.col("score").desc_nulls_last(), "ticker"))
    best = all_.withColumn("nth", nth).where(F.col("nth") <= top)
    ours = best.where("category = 'base'").select("ticker").withColumn("in_base", F.lit(True))
    joined = best.where("category <> 'base'").join(F.broadcast(ours), "ticker", "left")
    out = joined.groupBy("category", "direction").agg(F.count(F.lit(1)).alias("n"), F.count("in_base").alias("unchanged"))
    return out.select("category", "direction", "unchanged", (F.col("n") - F.col("unchanged")).alias("changed"), rounded(F.col("unchanged") / (2 * F.col("n") - F.col("unchanged")), 4).alias("jaccard"))


def sensitivity_summary(sensitivity: DataFrame) -> DataFrame:
    return sensitivity.agg(rounded(F.avg("jaccard"), 4).alias("mean"), F.min("jaccard").alias("least"), F.min_by("category", F.struct("jaccard", "category")).alias("most_sensitive"))


def ranking_impact(scored: DataFrame, current: dict[str, float], proposed: dict[str, float], top: int = 20) -> DataFrame:
    """How the best ``top`` change under proposed weights; here a missing score adds nothing."""
    def best(weights: dict[str, float], flag: str) -> DataFrame:
        score = sum((F.lit(float(w)) * F.coalesce(F.col(f"{c}_score"), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0)) / F.lit(float(sum(weights.values())))
        return scored.select("ticker", steady(score).alias("s")).orderBy(F.col("s").desc(), "ticker").limit(top).select("ticker", F.lit(True).alias(flag))

    both = best(current, "was").join(best(proposed, "will"), "ticker", "full_outer")
    return both.select("ticker", F.when(F.col("was") & F.col("will"), "stays").when(F.col("will"), "enters").otherwise("leaves").alias("change"))


def dispersion(scored: DataFrame, categories: Sequence[str], least: int = 10) -> DataFrame:
    cols = [F.when(F.count(f"{c}_score") >= least, rounded(F.stddev_samp(f"{c}_score"), 4)).alias(c) for c in categories]
    return scored.agg(*cols).unpivot([], list(categories), "category", "dispersion")


def dispersion_regime(history: DataFrame, least: int = 12) -> DataFrame:
    """history(category, dt, dispersion): the latest value against the quartiles of all."""
    out = history.groupBy("category").agg(
        F.count("dispersion").alias("n"), F.max_by("dispersion", "dt").alias("latest"), quantile(F.col("dispersion"), 0.25).alias("p25"), quantile(F.col("dispersion"), 0.75).alias("p75")
    )
    return out.withColumn("regime", F.when(F.col("n") < least, "unknown").when(F.col("latest") > F.col("p75"), "high").when(F.col("latest") < F.col("p25"), "low").otherwise("normal"))


# -- data quality ------------------------------------------------------------------------------------


def rule(df: DataFrame, name: str, severity: str, condition, text) -> DataFrame:
    """Rows of ``df`` that meet a condition, as issues."""
    return df.where(condition).select("ticker", F.lit(name).alias("issue"), F.lit(severity).alias("severity"), text.cast("string").alias("detail"))


def union_rules(rules: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def fundamentals_rules(f: DataFrame) -> dict[str, DataFrame]:
    plain = F.lit("")
    return {
        "dq_market_cap": rule(f, "market_cap", "High", (F.col("market_cap") < 100e6) | (F.col("market_cap") > 5e12), plain),
        "dq_negative_ev": rule(f, "negative_ev", "High", F.col("enterprise_value") < 0, plain),
        "dq_revenue_break": rule(f, "revenue_break", "High", (F.col("revenue_prior") > 0) & (F.col("revenue") < 0.1 * F.col("revenue_prior")), plain),
        "acc_capex_sign": rule(f, "capex_sign", "High", (F.abs((F.col("ocf") - F.abs("capex")) - (F.col("ocf") + F.col("capex"))) > 1) | (F.col("capex") > 0), plain),
        "acc_cash_mismatch": rule(f, "cash_mismatch", "Medium", (F.col("total_cash") > 0) & (F.abs(F.col("total_cash") - F.col("current_assets") * 0.1) / F.col("total_cash") > 0.1), plain),
        "acc_dividend_unit": rule(f, "dividend_unit", "Medium", (F.col("price") > 0) & (F.abs(F.col("payout_ratio") - F.col("dividend_rate") / F.col("price") * 100) < 0.5), plain),
        "acc_ebit_ebitda": rule(f, "ebit_ebitda", "Medium", (F.col("ebitda") != 0) & (F.abs(1 - F.col("ebit") / F.col("ebitda")) > 0.15), F.when(F.abs(1 - F.col("ebit") / F.col("ebitda")) > 0.3, "high").otherwise("low")),
    }


def missing_critical(tall_source: DataFrame, metrics: Sequence[str]) -> DataFrame:
    one = tall_source.select("ticker", F.explode(F.filter(F.array(*[F.when(F.col(m).isNull(), F.lit(m)) for m in metrics]), lambda x: x.isNotNull())).alias("metric"))
    return one.select("ticker", F.lit("missing_metric").alias("issue"), F.lit("Medium").alias("severity"), F.col("metric").alias("detail"))


def winsorized_counts(tall: DataFrame, least: int = 10) -> DataFrame:
    """Per metric, the values at or beyond the 1st and 99th percentile."""
    limits = tall.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), quantile(F.col("value"), 0.01).alias("p01"), quantile(F.col("value"), 0.99).alias("p99"))
    beyond = tall.join(F.broadcast(limits.where(F.col("n") > least)), "metric").where((F.col("value") <= F.col("p01")) | (F.col("value") >= F.col("p99")))
    return beyond.groupBy("metric").agg(F.count(F.lit(1)).alias("n"))


def sector_coverage(wide: DataFrame, metrics: Sequence[str], alert: float = 70.0) -> DataFrame:
    cols = [(F.count(m) / F.count(F.lit(1)) * 100).alias(m) for m in metrics]
    one = wide.groupBy("sector").agg(F.count(F.lit(1)).alias("stocks"), *cols).unpivot(["sector", "stocks"], list(metrics), "metric", "pct")
    out = one.groupBy("sector", "stocks").agg(rounded(F.avg("pct"), 4).alias("coverage"), F.min_by("metric", F.struct("pct", "metric")).alias("worst_metric"), rounded(F.min("pct"), 4).alias("worst_pct"))
    return out.withColumn("alert", F.col("coverage") < alert)


def sector_name(records: DataFrame, names: dict[str, str]) -> DataFrame:
    """records(ticker, sector) whose vendor's sector name is another one in the standard."""
    known = records.sparkSession.createDataFrame(list(names.items()), "sector string, standard string")
    found = records.join(F.broadcast(known), "sector")
    return rule(found, "sector_name", "Critical", F.col("sector") != F.col("standard"), F.concat_ws(" / ", "sector", "standard"))


def recomputed(scored: DataFrame, raw: DataFrame, vendor_beta: DataFrame) -> DataFrame:
    """(ticker, check, scored, anew) where a scored value and one made anew from the vendor's raw fields are apart.

    Four checks, with what they may differ by: EV / EBITDA (0.5), earnings yield (0.005), growth of earnings a share (0.01), beta
    (0.15). A scored value that is missing while the other is there counts as apart, but for beta.
    """
    x = scored.select("ticker", "ev_ebitda", "earnings_yield", "forward_eps_growth", "beta")
    both = x.join(raw, "ticker").join(vendor_beta.select("ticker", F.col("beta").alias("vendor_beta")), "ticker", "left")
    checks = [
        ("ev_ebitda", F.when((F.col("enterprise_value") != 0) & (F.col("ebitda") > 0), F.col("enterprise_value") / F.col("ebitda")), 0.5),
        ("earnings_yield", F.when((F.col("trailing_eps") != 0) & (F.col("price") > 0), F.col("trailing_eps") / F.col("price")), 0.005),
        ("forward_eps_growth", F.when((F.col("forward_eps") != 0) & (F.abs("trailing_eps") > 0.01), (F.col("forward_eps") - F.col("trailing_eps")) / F.abs("trailing_eps")), 0.01),
        ("beta", F.when((F.col("vendor_beta") != 0) & F.col("beta").isNotNull(), F.col("vendor_beta")), 0.15),
    ]
    rows = F.array(*[F.struct(F.lit(name).alias("check"), F.col(name).alias("scored"), anew.alias("anew"), F.lit(most).alias("most")) for name, anew, most in checks])
    each = both.select("ticker", F.explode(rows).alias("c")).select("ticker", "c.*").where("anew is not null")
    return each.where(F.col("scored").isNull() | (F.abs(F.col("scored") - F.col("anew")) >= F.col("most"))).drop("most")


def misaligned_dates(lines: DataFrame, one: str = "income", other: str = "balance") -> DataFrame:
    """Tickers whose newest periods of two statements differ; one with only one of them does not count."""
    newest = lambda st: F.max(F.when(F.col("statement") == st, F.col("period_end"))).alias(st)
    return lines.groupBy("ticker").agg(newest(one), newest(other)).where(F.col(one) != F.col(other))
