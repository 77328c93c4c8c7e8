"""Price, event, backtest and information-coefficient queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import rounded
from ..operators import prices as P
from ..sources import views as V
from .sql import rd

AS_OF = "2001-06-30"


def daily(s: SparkSession, sf: str) -> DataFrame:
    return V.view(s, sf, V.PRICES_DAILY)


def monthly(s: SparkSession, sf: str) -> DataFrame:
    return V.view(s, sf, V.PRICES_MONTHLY)


def market(s: SparkSession, sf: str) -> DataFrame:
    return V.view(s, sf, V.MARKET_DAILY)


def returns(s: SparkSession, sf: str) -> DataFrame:
    return P.log_returns(daily(s, sf))


def market_returns(s: SparkSession, sf: str) -> DataFrame:
    return P.log_returns(market(s, sf).withColumn("ticker", F.lit("all"))).select("dt", "ret")


def months(s: SparkSession, sf: str) -> DataFrame:
    return V.view(s, sf, V.MARKET_MONTHLY)


def filled(s: SparkSession, sf: str) -> DataFrame:
    return P.simple_returns_ffill(monthly(s, sf), months(s, sf).select("month_end"))


def forward(s: SparkSession, sf: str) -> DataFrame:
    return forward_of(monthly(s, sf), months(s, sf))


def forward_of(prices: DataFrame, market: DataFrame) -> DataFrame:
    return P.forward_return(P.simple_returns_ffill(prices, market.select("month_end"))).select("ticker", "month_end", rounded(F.col("fwd"), 9).alias("fwd"))


def snapshot(s: SparkSession, sf: str) -> DataFrame:
    days = daily(s, sf).select("ticker").distinct().crossJoin(s.sql("SELECT explode(sequence(DATE'1999-01-15', DATE'2001-06-15', INTERVAL 1 MONTH)) AS run_date"))
    return days


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c), 6) for c in names})


QUERIES = {
    "log_returns": lambda s, sf: r6(returns(s, sf), "ret").select("ticker", "dt", "ret"),
    "calendar_lookback": lambda s, sf: P.calendar_lookback(daily(s, sf)),
    "annualised_vol": lambda s, sf: r6(P.annualised_vol(returns(s, sf)), "volatility"),
    "dollar_volume_63d": lambda s, sf: P.dollar_volume(daily(s, sf)).select("ticker", rounded(F.col("dollar_volume"), 2).alias("dollar_volume")),
    "market_12m_return": lambda s, sf: r6(P.total_return(market_returns(s, sf).where("dt > DATE'2000-11-04'")), "total"),
    "beta_daily": lambda s, sf: r6(P.beta(returns(s, sf), market_returns(s, sf)), "beta", "overlap"),
    "beta_tail_aligned": lambda s, sf: r6(P.beta_tail_aligned(returns(s, sf), market_returns(s, sf)), "beta"),
    "sortino_inputs": lambda s, sf: r6(P.sortino_inputs(returns(s, sf)), "downside"),
    "max_drawdown": lambda s, sf: r6(P.max_drawdown(returns(s, sf)), "max_drawdown"),
    "simple_returns_ffill": lambda s, sf: r6(filled(s, sf), "ret"),
    "forward_return_1m": lambda s, sf: r6(forward(s, sf), "fwd"),
    "momentum_monthly": lambda s, sf: r6(P.momentum_monthly(monthly(s, sf)), "mom_12_1", "mom_6_1"),
    "vol_monthly": lambda s, sf: r6(P.vol_monthly(monthly(s, sf)), "vol"),
    "beta_monthly": lambda s, sf: r6(P.beta_monthly(monthly(s, sf), months(s, sf)), "beta"),
    "nearest_price": lambda s, sf: P.nearest_price(snapshot(s, sf).withColumnRenamed("run_date", "target"), daily(s, sf)),
    "forward_returns_horizons": lambda s, sf: r6(P.forward_returns_horizons(snapshot(s, sf), daily(s, sf), {"1w": 7, "1m": 30, "3m": 90}, AS_OF), "fwd_1w", "fwd_1m", "fwd_3m"),
    "portfolio_daily_return": lambda s, sf: r6(P.portfolio_daily_return(daily(s, sf), daily(s, sf).select("ticker").distinct().where("ticker < 'N'")), "ret"),
    "earnings_surprise": lambda s, sf: r6(P.earnings_surprise(V.view(s, sf, V.EARNINGS)), "surprise"),
    "earnings_acceleration": lambda s, sf: r6(P.earnings_acceleration(V.view(s, sf, V.EARNINGS)), "acceleration"),
    "beat_score": lambda s, sf: P.beat_score(V.view(s, sf, V.EARNINGS)),
    "risk_free_latest": lambda s, sf: r6(P.risk_free_latest(market(s, sf)), "risk_free"),
    "single_factor_regression": lambda s, sf: r6(P.single_factor(returns(s, sf), market_returns(s, sf)), "slope", "intercept", "r2"),
}

# -- SQL ---------------------------------------------------------------------------------------------

D = f"d AS (SELECT * FROM {V.oracle(V.PRICES_DAILY)} v), g0 AS (SELECT ticker, dt, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY dt)) AS ret FROM d), g AS (SELECT * FROM g0 WHERE ret IS NOT NULL)"
MK = f", k AS (SELECT * FROM {V.oracle(V.MARKET_DAILY)} v), h0 AS (SELECT dt, ln(close / lag(close) OVER (ORDER BY dt)) AS ret FROM k), h AS (SELECT * FROM h0 WHERE ret IS NOT NULL)"
MO = f"m AS (SELECT * FROM {V.oracle(V.PRICES_MONTHLY)} v), mm AS (SELECT * FROM {V.oracle(V.MARKET_MONTHLY)} v)"
FILL = MO + ", gr AS (SELECT t.ticker, mm.month_end, m.close FROM (SELECT DISTINCT ticker FROM m) t CROSS JOIN mm LEFT JOIN m ON m.ticker = t.ticker AND m.month_end = mm.month_end), fl AS (SELECT ticker, month_end, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY month_end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close FROM gr), fr AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY month_end), 0) - 1 AS ret FROM fl)"
FWD = FILL + f", fw AS (SELECT * FROM (SELECT ticker, month_end, {rd('lead(ret) OVER (PARTITION BY ticker ORDER BY month_end)', 9)} AS fwd FROM fr) z WHERE fwd IS NOT NULL)"
LAG = lambda n: f"lag(close, {n}) OVER (PARTITION BY ticker ORDER BY month_end)"
SIG = (
    FWD
    + f""", mr AS (SELECT ticker, month_end, close / lag(close) OVER (PARTITION BY ticker ORDER BY month_end) - 1 AS ret, {LAG(1)} / {LAG(12)} - 1 AS a, {LAG(1)} / {LAG(6)} - 1 AS b FROM m),
 mv AS (SELECT *, count(ret) OVER w AS n, stddev_samp(ret) OVER w * sqrt(12.0::DOUBLE) AS vol FROM mr WINDOW w AS (PARTITION BY ticker ORDER BY month_end ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
 sg AS (SELECT ticker, month_end AS as_of, {rd('a', 9)} AS momentum, {rd('b', 9)} AS trend, {rd('-vol', 9)} AS quality FROM mv WHERE a IS NOT NULL AND b IS NOT NULL AND n = 12)"""
)
SNAP = "sn AS (SELECT ticker, CAST(r AS DATE) AS run_date FROM (SELECT DISTINCT ticker FROM d) t CROSS JOIN generate_series(DATE '1999-01-15', DATE '2001-06-15', INTERVAL 1 MONTH) q(r))"
NEAR = lambda day: f"(SELECT sn.ticker, sn.run_date, arg_min(close, (abs(dt - (run_date + {day})), dt)) AS close, min(abs(dt - (run_date + {day}))) AS days FROM sn JOIN d ON d.ticker = sn.ticker AND abs(dt - (run_date + {day})) <= 7 GROUP BY 1, 2)"
EARN = f"ea AS (SELECT * FROM {V.oracle(V.EARNINGS)} v), e1 AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY quarter DESC) AS i FROM ea), su AS (SELECT ticker, i, (eps_actual - eps_estimate) / greatest(abs(eps_estimate), 0.1::DOUBLE) AS surprise FROM e1 WHERE i <= 4 AND eps_actual IS NOT NULL AND abs(eps_estimate) > 0.001)"
DAILY_RF = (1 + 0.045) ** (1 / 252) - 1
BOTH = D + MK + ", b AS (SELECT g.ticker, g.dt, g.ret, h.ret AS mkt FROM g JOIN h ON g.dt = h.dt)"
UPTO = "OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

ORACLE_SQL = {
    "log_returns": f"WITH {D} SELECT ticker, dt, {rd('ret', 6)} AS ret FROM g",
    "calendar_lookback": f"WITH {D}, l AS (SELECT *, max(dt) OVER (PARTITION BY ticker) AS last FROM d) SELECT ticker, arg_max(close, dt) AS close, arg_max(close, dt) FILTER (dt <= last - 30) AS close_30d, arg_max(close, dt) FILTER (dt <= last - 182) AS close_182d, arg_max(close, dt) FILTER (dt <= last - 365) AS close_365d FROM l GROUP BY ticker",
    "annualised_vol": f"WITH {D} SELECT ticker, count(*) AS n, CASE WHEN count(*) >= 200 THEN {rd('stddev_samp(ret) * sqrt(252.0::DOUBLE)', 6)} END AS volatility FROM g GROUP BY 1",
    "dollar_volume_63d": f"WITH {D}, l AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) AS i FROM d) SELECT ticker, CASE WHEN count(*) >= 20 THEN {rd('avg(close * volume)', 2)} END AS dollar_volume FROM l WHERE i <= 63 GROUP BY 1",
    "market_12m_return": f"WITH {D}{MK} SELECT count(*) AS n, CASE WHEN count(*) >= 200 THEN {rd('exp(sum(ret)) - 1', 6)} END AS total FROM h WHERE dt > DATE '2000-11-04'",
    "beta_daily": f"WITH {BOTH}, q AS (SELECT ticker, count(*) AS n, covar_samp(ret, mkt) AS cv, var_samp(mkt) AS vr, (SELECT count(*) FROM h) AS dates FROM b GROUP BY 1) SELECT ticker, n, {rd('CAST(n AS DOUBLE) / dates', 6)} AS overlap, CASE WHEN n >= 200 AND n >= dates * 0.8::DOUBLE AND vr > 0 THEN {rd('cv / vr', 6)} END AS beta FROM q",
    "beta_tail_aligned": f"WITH {D}{MK}, a AS (SELECT ticker, ret, row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) AS i FROM g), c AS (SELECT ret AS mkt, row_number() OVER (ORDER BY dt DESC) AS i FROM h) SELECT ticker, count(*) AS n, CASE WHEN count(*) >= 200 AND var_samp(mkt) > 0 THEN {rd('covar_samp(ret, mkt) / var_samp(mkt)', 6)} END AS beta FROM a JOIN c USING (i) GROUP BY 1",
    "sortino_inputs": f"WITH {D} SELECT ticker, count(*) FILTER (ret < {DAILY_RF!r}::DOUBLE) AS n_below, CASE WHEN count(*) FILTER (ret < {DAILY_RF!r}::DOUBLE) >= 20 THEN {rd(f'stddev_samp(CASE WHEN ret < {DAILY_RF!r}::DOUBLE THEN ret - {DAILY_RF!r}::DOUBLE END) * sqrt(252.0::DOUBLE)', 6)} END AS downside FROM g GROUP BY 1",
    "max_drawdown": f"WITH {D}, a AS (SELECT *, product(1 + ret) {UPTO} AS cum FROM g), c AS (SELECT *, max(cum) {UPTO} AS peak FROM a) SELECT ticker, count(*) AS n, CASE WHEN count(*) >= 50 THEN {rd('min((cum - peak) / peak)', 6)} END AS max_drawdown FROM c GROUP BY 1",
    "simple_returns_ffill": f"WITH {FILL} SELECT ticker, month_end, close, {rd('ret', 6)} AS ret FROM fr",
    "forward_return_1m": f"WITH {FWD} SELECT ticker, month_end, {rd('fwd', 6)} AS fwd FROM fw",
    "momentum_monthly": f"WITH {MO} SELECT ticker, month_end, {rd(f'{LAG(1)} / {LAG(12)} - 1', 6)} AS mom_12_1, {rd(f'{LAG(1)} / {LAG(6)} - 1', 6)} AS mom_6_1 FROM m",
    "vol_monthly": f"WITH {SIG} SELECT ticker, month_end, CASE WHEN n = 12 THEN {rd('vol', 6)} END AS vol FROM mv",
    "beta_monthly": f"WITH {MO}, a AS (SELECT ticker, month_end, close / lag(close) OVER (PARTITION BY ticker ORDER BY month_end) - 1 AS ret FROM m), c AS (SELECT month_end, close / lag(close) OVER (ORDER BY month_end) - 1 AS mkt FROM mm), b AS (SELECT ticker, a.month_end, ret, mkt FROM a JOIN c ON a.month_end = c.month_end WHERE ret IS NOT NULL AND mkt IS NOT NULL), q AS (SELECT ticker, month_end, count(*) OVER w AS n, covar_samp(ret, mkt) OVER w AS cv, var_samp(mkt) OVER w AS vr FROM b WINDOW w AS (PARTITION BY ticker ORDER BY month_end ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) SELECT ticker, month_end, CASE WHEN n >= 10 AND vr > 0 THEN {rd('cv / vr', 6)} END AS beta FROM q",
    "nearest_price": f"WITH {D}, {SNAP} SELECT ticker, run_date AS target, close, CAST(days AS INT) AS days FROM {NEAR(0)} z",
    "forward_returns_horizons": f"WITH {D}, {SNAP}, p0 AS {NEAR(0)}, p1 AS {NEAR(7)}, p2 AS {NEAR(30)}, p3 AS {NEAR(90)} SELECT p0.ticker, p0.run_date, {rd('p1.close / p0.close - 1', 6)} AS fwd_1w, CASE WHEN p0.run_date + 30 <= DATE '{AS_OF}' THEN {rd('p2.close / p0.close - 1', 6)} END AS fwd_1m, CASE WHEN p0.run_date + 90 <= DATE '{AS_OF}' THEN {rd('p3.close / p0.close - 1', 6)} END AS fwd_3m FROM p0 JOIN p1 ON p1.ticker = p0.ticker AND p1.run_date = p0.run_date LEFT JOIN p2 ON p2.ticker = p0.ticker AND p2.run_date = p0.run_date LEFT JOIN p3 ON p3.ticker = p0.ticker AND p3.run_date = p0.run_date WHERE p0.close > 0 AND p0.run_date + 7 <= DATE '{AS_OF}'",
    "portfolio_daily_return": f"WITH {D}, a AS (SELECT dt, close / lag(close) OVER (PARTITION BY ticker ORDER BY dt) - 1 AS ret FROM d WHERE ticker < 'N') SELECT dt, {rd('avg(ret)', 6)} AS ret FROM a GROUP BY 1 HAVING avg(ret) IS NOT NULL",
    "earnings_surprise": f"WITH {EARN} SELECT ticker, CASE WHEN count(*) >= 2 THEN {rd('quantile_cont(surprise, 0.5)', 6)} END AS surprise FROM su GROUP BY 1",
    "earnings_acceleration": f"WITH {EARN}, a AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY i) AS k FROM su) SELECT ticker, {rd('max(surprise) FILTER (k = 1) - max(surprise) FILTER (k = 2)', 6)} AS acceleration FROM a GROUP BY 1",
    "beat_score": f"WITH {EARN}, a AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY i DESC) AS p FROM su) SELECT ticker, CASE WHEN count(*) >= 2 THEN CAST(sum(CASE WHEN surprise > 0 THEN p ELSE 0 END) AS BIGINT) END AS beat_score FROM a GROUP BY 1",
    "risk_free_latest": f"WITH {D}{MK} SELECT {rd('coalesce(arg_max(close, dt) / 100, 0.045)', 6)} AS risk_free FROM k",
    "single_factor_regression": f"WITH {BOTH} SELECT ticker, count(*) AS n, {rd('regr_slope(ret, mkt)', 6)} AS slope, {rd('regr_intercept(ret, mkt)', 6)} AS intercept, {rd('regr_r2(ret, mkt)', 6)} AS r2 FROM b GROUP BY 1",
}
