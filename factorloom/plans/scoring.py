"""Scoring queries over the view of metrics, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions.kept import Kept
from ..functions.stats import rounded
from ..operators import assembly as A
from ..operators import prices as P
from ..operators import scoring as S
from ..sources import views
from . import fundamentals as FD
from . import series as SR
from .sql import pct_sql, rd

METRICS = config.METRIC_NAMES
CATS = config.CATEGORIES
W = config.CATEGORY_WEIGHTS
RISK_FREE = 0.045


#: Scores of the last run, from which reports, portfolios, screens and backtests start.
RUN = Kept(["customer", "supplier", "part", "orders", "lineitem"])


def kept(spark: SparkSession, sf: str, name: str, make: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    return RUN.get(spark, sf, name, make)


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    return kept(spark, sf, "metrics", all_metrics)


def all_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """All metrics of all securities: fundamentals, daily prices, market and earnings brought together."""
    returns = P.log_returns(A.trailing(views.view(spark, sf, views.PRICES_PAIRED)))
    market = P.log_returns(A.trailing(views.view(spark, sf, views.MARKET_DAILY).withColumn("ticker", F.lit("all")))).select("dt", "ret")
    total = P.total_return(market).select("total")
    return A.assembled(FD.metrics(spark, sf), A.risk_metrics(returns, market, RISK_FREE), A.revision_metrics(views.view(spark, sf, views.EARNINGS)), total, METRICS, RISK_FREE)


def tall(spark: SparkSession, sf: str) -> DataFrame:
    return S.with_dimension(S.to_tall(metrics(spark, sf), METRICS), config.metric_dimension(spark))


def wins(spark: SparkSession, sf: str) -> DataFrame:
    return S.with_dimension(S.winsorize(S.to_tall(metrics(spark, sf), METRICS)), config.metric_dimension(spark))


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Winsorized and ranked by sector."""
    return kept(spark, sf, "ranks", ranked_anew)


def ranked_anew(spark: SparkSession, sf: str) -> DataFrame:
    return S.cleaned_ranks(S.to_tall(metrics(spark, sf), METRICS), dimension=F.broadcast(config.metric_dimension(spark)))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the whole chain; reports, portfolios and diagnostics start here."""
    return kept(spark, sf, "scores", lambda s, f: chain(s, f, metrics(s, f)))  # most of what reads the scores reads the metrics too


def whole_chain(spark: SparkSession, sf: str) -> DataFrame:
    """From the raw tables to ranked securities, computed anew."""
    return chain(spark, sf, all_metrics(spark, sf))


def chain(spark: SparkSession, sf: str, of: DataFrame) -> DataFrame:
    return S.score_pipeline(of, config.metric_dimension(spark), METRICS, W, history=history(spark, sf))


def raw_scored(spark: SparkSession, sf: str) -> DataFrame:
    """Category scores and raw composites of all securities, without filter or adjusted weights."""
    return kept(spark, sf, "raw-scores", _raw_scores)


def _raw_scores(spark: SparkSession, sf: str) -> DataFrame:
    cats = S.category_scores(S.ranked_metrics(metrics(spark, sf), config.metric_dimension(spark), config.WEIGHTED), CATS)
    return cats.withColumn("composite_raw", S.composite_raw(cats, W))


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Spread of monthly prices as a stand-in for a history of momentum spreads."""
    prices = views.view(spark, sf, views.PRICES_MONTHLY)
    return prices.groupBy("month_end").agg(rounded(F.stddev_samp("close") / 1000, 4).alias("momentum_vol"))


SCORES = [f"{c}_score" for c in CATS]


QUERIES = {
    "direction_map": lambda s, sf: tall(s, sf).groupBy("metric", "higher").agg(F.count(F.lit(1)).alias("n")),
    "winsorize": lambda s, sf: wins(s, sf).select("ticker", "metric", "value"),
    "pct_rank_universe": lambda s, sf: S.pct_rank_universe(wins(s, sf)).select("ticker", "metric", rounded(F.col("pct"), 6).alias("pct")),
    "pct_rank_sector": lambda s, sf: ranked_anew(s, sf).select("ticker", "sector", "metric", rounded(F.col("pct"), 6).alias("pct")),
    "pct_logistic": lambda s, sf: ranked(s, sf).select("ticker", "metric", rounded(S.logistic(F.col("pct")), 4).alias("pct")),
    "category_scores": lambda s, sf: S.category_scores(ranked(s, sf), CATS).select("ticker", *[rounded(F.col(c), 6).alias(c) for c in SCORES]),
    "bank_weight_profile": lambda s, sf: wins(s, sf).groupBy("is_bank", "category", "metric").agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("n")),
    "piotroski_conditional": lambda s, sf: S.piotroski_conditional(ranked(s, sf), config.metric_dimension(s)).where("metric in ('piotroski_f_score', 'roic', 'gross_profit_assets')").select("ticker", "metric", rounded(F.col("weight"), 6).alias("weight")),
    "coverage_filter": lambda s, sf: S.coverage_filter(metrics(s, sf), config.METRICS, METRICS, 0.8).select("ticker", "present", "applicable"),
    "coverage_filter_simple": lambda s, sf: S.coverage_filter_simple(metrics(s, sf), METRICS, 0.7).select("ticker", "present"),
    "composite_raw": lambda s, sf: _raw_scores(s, sf).select("ticker", rounded(F.col("composite_raw"), 6).alias("composite_raw")),
    "coverage_discount": lambda s, sf: _discount(s, sf),
    "composite_percentile": lambda s, sf: S.composite_percentile(raw_scored(s, sf)).select("ticker", "composite"),
    "composite_sector_relative": lambda s, sf: S.composite_sector_relative(raw_scored(s, sf)).select("ticker", "sector", "composite"),
    "factor_contributions": lambda s, sf: S.contributions(raw_scored(s, sf), W).select("ticker", *[f"{c}_contrib" for c in CATS]),
    "value_trap": lambda s, sf: S.value_trap(raw_scored(s, sf)).select("ticker", "value_trap"),
    "value_trap_severity": lambda s, sf: S.value_trap(raw_scored(s, sf)).where("value_trap").select("ticker", "value_trap_severity"),
    "growth_trap": lambda s, sf: S.growth_trap(raw_scored(s, sf)).select("ticker", "growth_trap", "growth_trap_severity"),
    "insufficient_data_flag": lambda s, sf: S.insufficient_data(raw_scored(s, sf)).select("ticker", "insufficient_data"),
    "financial_caveat": lambda s, sf: metrics(s, sf).select("ticker", F.col("sector").isin("MACHINERY").alias("financial_caveat")),
    "rank_stocks": lambda s, sf: S.rank_stocks(scored(s, sf).drop("rank")).select("ticker", "composite", "rank"),
    "score_pipeline": lambda s, sf: whole_chain(s, sf).select("ticker", "sector", "is_bank", *[rounded(F.col(c), 6).alias(c) for c in SCORES], "composite", *[f"{c}_contrib" for c in CATS], "insufficient_data", "value_trap", "growth_trap", "rank"),
    "piotroski_growth_trap": lambda s, sf: _growth_trap(s, sf),
    "weights_check": lambda s, sf: S.weights_check(config.metric_weights(s).join(F.broadcast(tall(s, sf).select("metric").distinct()), "metric", "left_semi")),
    "skip_all_null_metric": lambda s, sf: config.metric_dimension(s).join(tall(s, sf).select("metric").distinct(), "metric", "left_anti").select("metric", "category", "generic"),
    "missing_pct": lambda s, sf: missing(s, sf),
    "category_coverage": lambda s, sf: category_coverage(s, sf),
    "auto_disable_category": lambda s, sf: S.auto_disable_category(category_coverage(s, sf), config.category_weights(s), least=0.97),
    "auto_reduce_sparse_metric": lambda s, sf: S.auto_reduce_sparse_metric(missing(s, sf), config.metric_dimension(s).select("metric", "category", F.col("generic").alias("weight")), most=60.0),
    "momentum_regime_weight": lambda s, sf: S.momentum_regime(raw_scored(s, sf), history(s, sf)).select(rounded(F.col("momentum_vol"), 6).alias("momentum_vol"), "n", rounded(F.col("p25"), 6).alias("p25"), rounded(F.col("p75"), 6).alias("p75"), "regime", "factor"),
}


def _growth_trap(spark: SparkSession, sf: str) -> DataFrame:
    """F-score weights where an earlier scoring had high growth and low quality."""
    dimension, rows = config.metric_dimension(spark), ranked(spark, sf)
    earlier = S.category_scores(S.piotroski_conditional(rows, dimension), CATS)
    out = S.piotroski_growth_trap(rows, dimension, earlier)
    return out.where("metric in ('piotroski_f_score', 'accruals', 'gross_profit_assets')").select("ticker", "metric", rounded(F.col("weight"), 6).alias("weight"))


def _discount(spark: SparkSession, sf: str) -> DataFrame:
    wide = metrics(spark, sf)
    present, applicable = S.metric_coverage(wide, config.METRICS, METRICS)
    coverage = wide.select("ticker", present.alias("present"), applicable.alias("applicable"))
    joined = raw_scored(spark, sf).join(coverage, "ticker")
    return joined.select("ticker", rounded(S.coverage_discount(F.col("composite_raw"), F.col("present"), F.col("applicable")), 6).alias("composite"))


def missing(spark: SparkSession, sf: str) -> DataFrame:
    wide = metrics(spark, sf)
    one = wide.agg(*[rounded(F.count_if(F.col(m).isNull()) / F.count(F.lit(1)) * 100, 4).alias(m) for m in METRICS])
    return one.unpivot([], METRICS, "metric", "missing_pct")


def category_coverage(spark: SparkSession, sf: str) -> DataFrame:
    one = raw_scored(spark, sf).agg(*[rounded(F.count(c) / F.count(F.lit(1)), 6).alias(c.removesuffix("_score")) for c in SCORES])
    return one.unpivot([], CATS, "category", "coverage")


# -- SQL ---------------------------------------------------------------------------------------------


def risk_sql() -> str:
    """CTEs of the daily series, the market and the earnings; names begin with z_."""
    year = lambda name, text: f"{name} AS (SELECT * FROM (SELECT *, max(dt) OVER (PARTITION BY ticker) AS last FROM {text} v) v WHERE dt > last - 365)"
    rets = lambda name, source: f"{name} AS (SELECT * FROM (SELECT ticker, dt, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY dt)) AS ret FROM {source}) v WHERE ret IS NOT NULL)"
    upto = "OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    rf = f"{SR.DAILY_RF!r}::DOUBLE"
    market = f"(SELECT 'all' AS ticker, * FROM {views.oracle(views.MARKET_DAILY)} w)"
    return f"""{year("z_p", views.oracle(views.PRICES_PAIRED))}, {rets("z_r", "z_p")}, {year("z_mp", market)}, {rets("z_m", "z_mp")},
 z_v AS (SELECT ticker, CASE WHEN count(*) >= 200 THEN stddev_samp(ret) * sqrt(252.0::DOUBLE) END AS volatility, CASE WHEN count(*) FILTER (ret < {rf}) >= 20 THEN stddev_samp(CASE WHEN ret < {rf} THEN ret - {rf} END) * sqrt(252.0::DOUBLE) END AS downside FROM z_r GROUP BY 1),
 z_d AS (SELECT ticker, CASE WHEN count(*) >= 50 THEN min((cum - peak) / peak) END AS drawdown FROM (SELECT *, max(cum) {upto} AS peak FROM (SELECT *, product(1 + ret) {upto} AS cum FROM z_r) v) v GROUP BY 1),
 z_b AS (SELECT ticker, CASE WHEN count(*) >= 200 AND count(*) >= (SELECT count(*) FROM z_m) * 0.8::DOUBLE AND var_samp(mkt) > 0 THEN covar_samp(ret, mkt) / var_samp(mkt) END AS beta FROM (SELECT z_r.ticker, z_r.ret, z_m.ret AS mkt FROM z_r JOIN z_m ON z_r.dt = z_m.dt) v GROUP BY 1),
 z_t AS (SELECT CASE WHEN count(*) >= 200 THEN exp(sum(ret)) - 1 END AS total FROM z_m),
 {SR.EARN.replace("ea AS", "z_ea AS").replace("e1 AS", "z_e1 AS").replace("su AS", "z_su AS").replace("FROM ea", "FROM z_ea").replace("FROM e1", "FROM z_e1")},
 z_u AS (SELECT ticker, CASE WHEN count(*) >= 2 THEN quantile_cont(surprise, 0.5) END AS surprise, max(surprise) FILTER (k = 1) - max(surprise) FILTER (k = 2) AS change, CASE WHEN count(*) >= 2 THEN CAST(sum(CASE WHEN surprise > 0 THEN p ELSE 0 END) AS DOUBLE) END AS beats FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY i) AS k, row_number() OVER (PARTITION BY ticker ORDER BY i DESC) AS p FROM z_su) v GROUP BY 1)"""


#: Metrics of prices and earnings; the acceleration of earnings has a query among those of events.
MARKET_METRICS = ("volatility", "beta", "sharpe_ratio", "sortino_ratio", "max_drawdown_1y", "jensens_alpha", "analyst_surprise", "consecutive_beat_streak")
QUERIES |= {m: (lambda m: lambda s, sf: metrics(s, sf).select("ticker", m))(m) for m in MARKET_METRICS}

EXCESS = f"({FD.SQL['return_12m']} - {RISK_FREE}::DOUBLE)"
MARKET_SQL = {
    "volatility": "z_v.volatility",
    "beta": "z_b.beta",
    "sharpe_ratio": f"CASE WHEN z_v.volatility > 0 THEN {EXCESS} / z_v.volatility END",
    "sortino_ratio": f"CASE WHEN downside > 0 THEN {EXCESS} / downside END",
    "max_drawdown_1y": "drawdown",
    "jensens_alpha": f"({FD.SQL['return_12m']} - ({RISK_FREE}::DOUBLE + z_b.beta * (total - {RISK_FREE}::DOUBLE)))",
    "analyst_surprise": "surprise",
    "earnings_acceleration": "change",
    "consecutive_beat_streak": "beats",
}
METRIC_SQL = {m: FD.SQL[m] if m in FD.SQL else MARKET_SQL[m] for m in METRICS}
M = f"z_e AS MATERIALIZED {FD.E}, {risk_sql()}, m AS MATERIALIZED (SELECT z_e.ticker, company, sector, b AS is_bank, {', '.join(f'{rd(x, 8)} AS {m}' for m, x in METRIC_SQL.items())} FROM z_e LEFT JOIN z_v ON z_v.ticker = series LEFT JOIN z_d ON z_d.ticker = series LEFT JOIN z_b ON z_b.ticker = series LEFT JOIN z_u ON z_u.ticker = earner CROSS JOIN z_t)"


def tall_sql(source: str = "m", dim: str = "dim", names: list[str] = METRICS) -> str:
    return f"t AS (SELECT u.ticker, u.sector, u.is_bank, u.metric, u.value, d.category, d.higher, d.generic, CASE WHEN is_bank THEN d.bank ELSE d.generic END AS weight FROM (UNPIVOT (SELECT ticker, sector, is_bank, {', '.join(names)} FROM {source}) ON {', '.join(names)} INTO NAME metric VALUE value) u JOIN {dim} d ON u.metric = d.metric)"


TALL = f"{M}, {config.dimension_sql()}, {tall_sql()}"
WINS_OF = (
    """, o AS (SELECT *, count(*) OVER (PARTITION BY metric) AS n, row_number() OVER (PARTITION BY metric ORDER BY value, ticker) AS rn FROM t),
 o2 AS (SELECT *, CAST(floor(0.01::DOUBLE * n) AS INT) AS k FROM o),
 o3 AS (SELECT *, max(CASE WHEN rn = k + 1 THEN value END) OVER (PARTITION BY metric) AS lo, max(CASE WHEN rn = n - k THEN value END) OVER (PARTITION BY metric) AS hi FROM o2),
 w AS (SELECT ticker, sector, is_bank, metric, category, higher, generic, weight, CASE WHEN n < 10 THEN value WHEN rn <= k THEN lo WHEN rn > n - k THEN hi ELSE value END AS value FROM o3)"""
)
WINS = TALL + WINS_OF
PCT_OF = (
    f""", r AS (SELECT *, count(*) OVER (PARTITION BY metric, sector) AS ns, {pct_sql("value", "metric")} AS pu, {pct_sql("value", "metric, sector")} AS ps FROM w),
 p AS (SELECT ticker, sector, is_bank, metric, category, generic, weight, CASE WHEN higher THEN 1 ELSE -1 END * CASE WHEN ns < 10 THEN pu ELSE ps END + CASE WHEN higher THEN 0 ELSE 100 END AS pct FROM r)"""
)


def cats_sql(source: str) -> str:
    cols = ", ".join(
        f"CASE WHEN sum(weight) FILTER (category = '{c}') > 0 THEN {rd(f'''sum(pct * weight) FILTER (category = '{c}') / sum(weight) FILTER (category = '{c}')''', 9)} END AS {c}_score" for c in CATS
    )
    return f"SELECT ticker, any_value(sector) AS sector, any_value(is_bank) AS is_bank, {cols} FROM {source} GROUP BY ticker"


PCT = WINS + PCT_OF
PIO = """sums AS (SELECT max(generic) FILTER (metric = 'piotroski_f_score') AS fg, sum(generic) FILTER (metric IN ({to})) AS pool FROM {dim})"""
COND_OF = (
    f""", v AS (SELECT ticker, CASE WHEN sum(weight) > 0 THEN {rd("sum(weight * pct) / sum(weight)", 9)} END AS val FROM p WHERE category = 'valuation' GROUP BY ticker),
 q AS (SELECT p.* REPLACE (CASE WHEN NOT is_bank AND coalesce(val < 50, false) AND metric = 'piotroski_f_score' THEN weight * 0.5
   WHEN NOT is_bank AND coalesce(val < 50, false) AND metric IN ('roic', 'gross_profit_assets') AND pool > 0 AND generic > 0 THEN generic + fg * 0.5 * generic / pool ELSE weight END AS weight) FROM p LEFT JOIN v USING (ticker) CROSS JOIN sums)"""
)
TO = "'roic', 'gross_profit_assets'"
COND = PCT + ", " + PIO.format(to=TO, dim="dim") + COND_OF
WEIGHTED_COND = f"{M}, {config.dimension_sql()}, {tall_sql(names=config.WEIGHTED)}" + WINS_OF + PCT_OF + ", " + PIO.format(to=TO, dim="dim") + COND_OF
RAW = (
    WEIGHTED_COND
    + f""", c AS ({cats_sql("q")}), x AS (SELECT *, {" + ".join(f"CASE WHEN {c}_score IS NOT NULL THEN {w}::DOUBLE ELSE 0 END" for c, w in W.items())} AS tw,
   {" + ".join(f"coalesce({w}::DOUBLE * {c}_score, 0)" for c, w in W.items())} AS ts FROM c),
 s AS (SELECT * EXCLUDE (tw, ts), tw, CASE WHEN tw > 0 THEN {rd("ts / tw", 9)} END AS composite_raw FROM x)"""
)


def quant(col: str, q: float) -> str:
    return f"(SELECT quantile_cont({col}, {q}) FROM s)"


def vote(*conds: str) -> str:
    return " + ".join(f"coalesce(CAST({c} AS INT), 0)" for c in conds)


def depth(low: list[tuple[str, float]], high: list[tuple[str, float]]) -> str:
    parts = [f"CASE WHEN {d}_score IS NOT NULL AND {quant(f'{d}_score', q)} > 0 THEN greatest(0, {quant(f'{d}_score', q)} - {d}_score) / {quant(f'{d}_score', q)} * 100 END" for d, q in low]
    parts = [f"CASE WHEN {d}_score IS NOT NULL AND {quant(f'{d}_score', q)} < 100 THEN greatest(0, {d}_score - {quant(f'{d}_score', q)}) / (100.0::DOUBLE - {quant(f'{d}_score', q)}) * 100 END" for d, q in high] + parts
    total, n = " + ".join(f"coalesce({p}, 0)" for p in parts), " + ".join(f"CAST({p} IS NOT NULL AS INT)" for p in parts)
    return rd(f"({total}) / ({n})", 1)


VT = f"({vote(*[f'{d}_score <= ' + quant(f'{d}_score', 0.3) for d in ('quality', 'momentum', 'revisions')])}) >= 2"
VT_DEPTH = depth([("quality", 0.3), ("momentum", 0.3), ("revisions", 0.3)], [])
GT = f"({vote('growth_score >= ' + quant('growth_score', 0.7), 'quality_score <= ' + quant('quality_score', 0.35), 'revisions_score <= ' + quant('revisions_score', 0.35))}) >= 2"
GT_DEPTH = depth([("quality", 0.35), ("revisions", 0.35)], [("growth", 0.7)])
COMPOSITE = f"CASE WHEN composite_raw IS NOT NULL THEN {rd(pct_sql('composite_raw', 'composite_raw IS NULL'), 2)} END"
INSUFFICIENT = "(quality_score IS NULL OR momentum_score IS NULL OR revisions_score IS NULL)"
APPLIES = {r[0]: r[5] for r in config.METRICS}
OK = {m: {"all": "true", "bank": "is_bank", "nonbank": "NOT is_bank"}[APPLIES[m]] for m in METRICS}
PRESENT = " + ".join(f"CAST({OK[m]} AND {m} IS NOT NULL AS INT)" for m in METRICS)
APPLICABLE = " + ".join(f"CAST({OK[m]} AS INT)" for m in METRICS)
COVERED = f"SELECT ticker, CAST({PRESENT} AS INT) AS present, CAST({APPLICABLE} AS INT) AS applicable FROM m"
MISSING = " UNION ALL ".join(f"SELECT '{m}' AS metric, {rd(f'CAST(count(*) - count({m}) AS DOUBLE) / count(*) * 100', 4)} AS missing_pct FROM m" for m in METRICS)
CAT_COVERAGE = " UNION ALL ".join(f"SELECT '{c}' AS category, {rd(f'CAST(count({c}_score) AS DOUBLE) / count(*)', 6)} AS coverage FROM s" for c in CATS)
CAT_VALUES = "cw(category, weight) AS (VALUES " + ", ".join(f"('{c}', {w}::DOUBLE)" for c, w in W.items()) + ")"

# The whole chain: coverage, weights of sparse metrics and of optional categories, regime, discount.
FILLED = " UNION ALL ".join(f"SELECT '{m}' AS metric, count({m}) AS filled, count(*) AS all_rows FROM cv" for m in METRICS)
MAY = f"(metric IN ({', '.join(repr(m) for m in config.REDUCIBLE)}) AND generic > 0)"


def off_sql(category: str) -> str:
    names = ", ".join(repr(m) for m in config.OPTIONAL[category])
    return f"(SELECT coalesce(CAST(sum(filled) AS DOUBLE) / sum(all_rows) < 0.3::DOUBLE, true) FROM fil WHERE metric IN ({names}))"


def given(steps: list[str]) -> str:
    """CTEs w0, w1, ...: the weights of the categories after each optional one without data gave its weight away."""
    out = "w0 AS (SELECT " + ", ".join(f"{float(x)}::DOUBLE AS w_{c}" for c, x in W.items()) + ")"
    for k, off in enumerate(steps):
        rest = " + ".join(f"w_{o}" for o in CATS if o != off)
        cols = ", ".join(f"CASE WHEN {off_sql(off)} THEN {'0' if o == off else rd(f'w_{o} + w_{off} * w_{o} / ({rest})', 2)} ELSE w_{o} END AS w_{o}" for o in CATS)
        out += f", w{k + 1} AS (SELECT {cols} FROM w{k})"
    return out


HISTORY = f"z_h AS (SELECT {rd('stddev_samp(close) / 1000', 4)} AS momentum_vol FROM {views.oracle(views.PRICES_MONTHLY)} q GROUP BY month_end)"
REGIME = f"{HISTORY}, z_a AS (SELECT {rd('stddev_samp(momentum_score)', 9)} AS mv FROM c), z_q AS (SELECT count(*) AS n, quantile_cont(momentum_vol, 0.25) AS p25, quantile_cont(momentum_vol, 0.75) AS p75 FROM z_h), z_g AS (SELECT *, CASE WHEN n < 20 THEN 'unknown' WHEN mv > p75 THEN 'high' WHEN mv < p25 THEN 'low' ELSE 'normal' END AS regime FROM z_a CROSS JOIN z_q)"
MOVED = f"wf AS (SELECT w.* REPLACE (CASE regime WHEN 'high' THEN {rd('w_momentum * 0.7::DOUBLE', 2)} WHEN 'low' THEN {rd('w_momentum * 1.15::DOUBLE', 2)} ELSE w_momentum END AS w_momentum, CASE regime WHEN 'high' THEN {rd('w_quality + w_momentum * (1 - 0.7::DOUBLE) / 2', 2)} ELSE w_quality END AS w_quality, CASE regime WHEN 'high' THEN {rd('w_valuation + w_momentum * (1 - 0.7::DOUBLE) / 2', 2)} WHEN 'low' THEN {rd('w_valuation - w_momentum * (1.15::DOUBLE - 1)', 2)} ELSE w_valuation END AS w_valuation) FROM w2 w CROSS JOIN z_g)"
CHAIN = (
    f"{M}, {config.dimension_sql()}, cv AS MATERIALIZED (SELECT m.*, present, applicable FROM m JOIN ({COVERED}) k ON k.ticker = m.ticker WHERE present >= greatest(1, floor(applicable * 0.6::DOUBLE))), fil AS ({FILLED}),"
    f" d1 AS (SELECT dim.*, {MAY} AS may, {MAY} AND CAST(all_rows - filled AS DOUBLE) / all_rows * 100 > 70 AS gone FROM dim JOIN fil USING (metric)),"
    f" d2 AS (SELECT d1.* REPLACE (CASE WHEN gone THEN 0 WHEN may AND sum(CASE WHEN gone THEN generic END) OVER k > 0 THEN {rd('generic + sum(CASE WHEN gone THEN generic END) OVER k * generic / sum(CASE WHEN may AND NOT gone THEN generic END) OVER k', 2)} ELSE generic END AS generic) FROM d1 WINDOW k AS (PARTITION BY category)), {tall_sql('cv', 'd2', config.WEIGHTED)}"
    + WINS_OF
    + PCT_OF
    + ", "
    + PIO.format(to=TO, dim="d2")
    + COND_OF
    + f", c0 AS ({cats_sql('q')}), c AS MATERIALIZED (SELECT cv.ticker, cv.sector, cv.is_bank, present, applicable, {', '.join(f'{c}_score' for c in CATS)} FROM cv LEFT JOIN c0 ON c0.ticker = cv.ticker), {given(list(config.OPTIONAL))}, {REGIME}, {MOVED},"
    + f" x AS (SELECT c.*, wf.*, {' + '.join(f'CASE WHEN {c}_score IS NOT NULL THEN w_{c} ELSE 0 END' for c in CATS)} AS tw, {' + '.join(f'coalesce(w_{c} * {c}_score, 0)' for c in CATS)} AS ts FROM c CROSS JOIN wf),"
    + f" x1 AS (SELECT *, CASE WHEN tw > 0 THEN {rd('ts / tw', 9)} END AS plain FROM x),"
    + f" s AS MATERIALIZED (SELECT * EXCLUDE (ts, plain), {rd('CASE WHEN CAST(present AS DOUBLE) / applicable < 0.8::DOUBLE THEN plain * (1 - (0.8::DOUBLE - CAST(present AS DOUBLE) / applicable) * 0.15::DOUBLE) ELSE plain END', 9)} AS composite_raw, {', '.join(f'coalesce({rd(f'{c}_score * w_{c} / tw', 2)}, 0) AS {c}_contrib' for c in CATS)} FROM x1)"
)
SCORED = (
    CHAIN
    + f""", f0 AS (SELECT *, {COMPOSITE} AS composite, {INSUFFICIENT} AS insufficient_data, {VT} AS value_trap, CASE WHEN {VT} THEN {VT_DEPTH} ELSE 0 END AS value_trap_severity,
   {GT} AS growth_trap, CASE WHEN {GT} THEN {GT_DEPTH} ELSE 0 END AS growth_trap_severity FROM s),
 f AS (SELECT *, CASE WHEN composite IS NOT NULL THEN rank() OVER (ORDER BY composite DESC NULLS LAST) END AS rank FROM f0)"""
)
ORACLE_SQL = {
    **{m: f"WITH {M} SELECT ticker, {m} FROM m" for m in MARKET_METRICS},
    "direction_map": f"WITH {TALL} SELECT metric, higher, count(*) AS n FROM t GROUP BY ALL",
    "winsorize": f"WITH {WINS} SELECT ticker, metric, value FROM w",
    "pct_rank_universe": f"WITH {WINS} SELECT ticker, metric, {rd('CASE WHEN higher THEN x ELSE 100 - x END', 6)} AS pct FROM (SELECT *, {pct_sql('value', 'metric')} AS x FROM w) y",
    "pct_rank_sector": f"WITH {PCT} SELECT ticker, sector, metric, {rd('pct', 6)} AS pct FROM p",
    "pct_logistic": f"WITH {PCT} SELECT ticker, metric, {rd('100.0::DOUBLE / (1.0::DOUBLE + exp(-0.08::DOUBLE * (pct - 50)))', 4)} AS pct FROM p",
    "category_scores": f"WITH {PCT}, c AS ({cats_sql('p')}) SELECT ticker, {', '.join(f'{rd(c, 6)} AS {c}' for c in SCORES)} FROM c",
    "bank_weight_profile": f"WITH {WINS} SELECT is_bank, category, metric, max(weight) AS weight, count(*) AS n FROM w GROUP BY ALL",
    "piotroski_conditional": f"WITH {COND} SELECT ticker, metric, {rd('weight', 6)} AS weight FROM q WHERE metric IN ('piotroski_f_score', 'roic', 'gross_profit_assets')",
    "coverage_filter": f"WITH {M} SELECT * FROM ({COVERED}) y WHERE present >= greatest(1, floor(applicable * 0.8::DOUBLE))",
    "coverage_filter_simple": f"WITH {M} SELECT ticker, present FROM (SELECT ticker, CAST({' + '.join(f'CAST({m} IS NOT NULL AS INT)' for m in METRICS)} AS INT) AS present FROM m) y WHERE present >= {max(1, int(len(METRICS) * 0.7))}",
    "composite_raw": f"WITH {RAW} SELECT ticker, {rd('composite_raw', 6)} AS composite_raw FROM s",
    "coverage_discount": f"WITH {RAW}, k AS ({COVERED}) SELECT ticker, {rd('CASE WHEN present / applicable < 0.8::DOUBLE THEN composite_raw * (1 - (0.8::DOUBLE - present / applicable) * 0.15::DOUBLE) ELSE composite_raw END', 6)} AS composite FROM s JOIN k USING (ticker)",
    "composite_percentile": f"WITH {RAW} SELECT ticker, {COMPOSITE} AS composite FROM s",
    "composite_sector_relative": f"WITH {RAW} SELECT ticker, sector, CASE WHEN count(*) OVER (PARTITION BY sector) < 3 THEN 50 ELSE {rd(pct_sql('composite_raw', 'sector'), 2)} END AS composite FROM s WHERE composite_raw IS NOT NULL",
    "factor_contributions": f"WITH {RAW} SELECT ticker, {', '.join(f'coalesce({rd(f'{c}_score * {w}::DOUBLE / tw', 2)}, 0) AS {c}_contrib' for c, w in W.items())} FROM s",
    "value_trap": f"WITH {RAW} SELECT ticker, {VT} AS value_trap FROM s",
    "value_trap_severity": f"WITH {RAW} SELECT ticker, {VT_DEPTH} AS value_trap_severity FROM s WHERE {VT}",
    "growth_trap": f"WITH {RAW} SELECT ticker, {GT} AS growth_trap, CASE WHEN {GT} THEN {GT_DEPTH} ELSE 0 END AS growth_trap_severity FROM s",
    "insufficient_data_flag": f"WITH {RAW} SELECT ticker, {INSUFFICIENT} AS insufficient_data FROM s",
    "financial_caveat": f"WITH {M} SELECT ticker, sector = 'MACHINERY' AS financial_caveat FROM m",
    "rank_stocks": f"WITH {SCORED} SELECT ticker, composite, rank FROM f",
    "score_pipeline": f"WITH {SCORED} SELECT ticker, sector, is_bank, {', '.join(f'{rd(c, 6)} AS {c}' for c in SCORES)}, composite, {', '.join(f'{c}_contrib' for c in CATS)}, insufficient_data, value_trap, growth_trap, rank FROM f",
    "piotroski_growth_trap": f"WITH {COND}, sums2 AS (SELECT max(generic) FILTER (metric = 'piotroski_f_score') AS fg2, sum(generic) FILTER (metric IN ('accruals', 'gross_profit_assets')) AS pool2 FROM dim), s AS ({cats_sql('q')}), tr AS (SELECT ticker FROM s WHERE growth_score >= {quant('growth_score', 0.7)} AND quality_score <= {quant('quality_score', 0.35)}), y AS (SELECT p.*, fg2, pool2, tr.ticker IS NOT NULL AND NOT is_bank AND NOT coalesce(val < 50, false) AS moved FROM p LEFT JOIN v ON v.ticker = p.ticker LEFT JOIN tr ON tr.ticker = p.ticker CROSS JOIN sums2) SELECT ticker, metric, {rd("CASE WHEN moved AND metric = 'piotroski_f_score' THEN weight * 0.5 WHEN moved AND metric <> 'piotroski_f_score' THEN generic + fg2 * 0.5 * generic / pool2 ELSE weight END", 6)} AS weight FROM y WHERE metric IN ('piotroski_f_score', 'accruals', 'gross_profit_assets')",
    "weights_check": f"WITH {TALL}, wx AS (SELECT 'generic' AS profile, category, generic AS weight FROM dim WHERE metric IN (SELECT metric FROM t) UNION ALL SELECT 'bank', category, bank FROM dim WHERE metric IN (SELECT metric FROM t)) SELECT profile, category, sum(weight) AS total, min(weight) AS lowest, abs(sum(weight) - 100) <= 0.5 AND min(weight) >= 0 AS valid FROM wx GROUP BY ALL",
    "skip_all_null_metric": f"WITH {TALL} SELECT metric, category, generic FROM dim WHERE metric NOT IN (SELECT metric FROM t)",
    "missing_pct": f"WITH {M} {MISSING}",
    "category_coverage": f"WITH {RAW} {CAT_COVERAGE}",
    "auto_disable_category": f"WITH {RAW}, cc AS ({CAT_COVERAGE}), {CAT_VALUES}, k AS (SELECT cw.*, coverage, CASE WHEN category IN ('revisions', 'investment') AND coalesce(coverage, 0) < 0.97 THEN 0 ELSE weight END AS kept FROM cw LEFT JOIN cc USING (category)) SELECT category, weight, coverage, {rd('kept * sum(weight) OVER () / sum(kept) OVER ()', 2)} AS new_weight FROM k",
    "auto_reduce_sparse_metric": f"WITH {M}, {config.dimension_sql()}, mp AS ({MISSING}), k AS (SELECT metric, category, generic AS weight, missing_pct, CASE WHEN coalesce(missing_pct, 100) > 60 AND generic > 0 THEN 0 ELSE generic END AS kept FROM dim LEFT JOIN mp USING (metric)) SELECT category, metric, weight, missing_pct, CASE WHEN sum(kept) OVER (PARTITION BY category) > 0 THEN {rd('kept * sum(weight) OVER (PARTITION BY category) / sum(kept) OVER (PARTITION BY category)', 2)} ELSE weight END AS new_weight FROM k",
    "momentum_regime_weight": f"WITH {RAW}, {REGIME} SELECT {rd('mv', 6)} AS momentum_vol, n, {rd('p25', 6)} AS p25, {rd('p75', 6)} AS p75, regime, CASE regime WHEN 'high' THEN 0.7::DOUBLE WHEN 'low' THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM z_g",
}
