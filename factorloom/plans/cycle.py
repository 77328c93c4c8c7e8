"""Queries on annual statements, factor regressions, weight changes and runs, and their SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions.stats import rounded
from ..functions.store import shared_folder
from ..operators import diagnostics as D
from ..operators import exposure as X
from ..operators import history as H
from ..operators import proposals as P
from ..operators import runs as U
from ..operators import statements as ST
from ..operators import tables as T
from ..sources import views as V
from . import backtests as BT
from . import proposals as PP
from . import records as RC
from . import scoring as SC
from . import series as SR
from .sql import rd

CHAINS = {
    "receivables": ("Net Receivable", "Receivables", "Accounts Receivable"),
    "revenue": ("Total Revenue",),
    "cost_of_revenue": ("Cost Of Revenue",),
    "current_assets": ("Current Assets",),
    "ppe": ("Net PPE", "Property Plant Equipment"),
    "total_assets": ("Total Assets",),
    "depreciation": ("Depreciation And Amortization", "Depreciation"),
    "sga": ("Selling General And Administration", "Selling General And Admin"),
    "lt_debt": ("Long Term Debt",),
    "current_liabilities": ("Current Liabilities",),
    "net_income": ("Net Income",),
    "ocf": ("Operating Cash Flow", "Total Cash From Operating"),
}
RUN = {"factor_weights": config.CATEGORY_WEIGHTS, "metric_weights": {m[0]: m[3] for m in config.METRICS}}
TODAY = "2001-12-31"


def lines(s: SparkSession, sf: str) -> DataFrame:
    return RC.lines(s, sf).unionByName(V.view(s, sf, V.ANNUAL_LINES))


def factors(s: SparkSession, sf: str) -> DataFrame:
    five = V.view(s, sf, V.FACTORS_FIVE).toDF("dt", "Mkt-RF ", " SMB", "HML", "RMW", "CMA", "RF ")
    return X.factor_returns(five, V.view(s, sf, V.FACTOR_MOMENTUM).toDF("dt", "Mom   "))


def sleeves(s: SparkSession, sf: str) -> DataFrame:
    """Portfolios: each sleeve that is no factor, and the mean change of all of them."""
    rets = V.view(s, sf, V.SLEEVE_RETURNS).where("k > 5 and r is not null")
    each = rets.select(F.concat(F.lit("sleeve "), F.col("k").cast("string")).alias("portfolio"), "dt", (F.col("r") / 100).alias("ret"))
    return each.unionByName(rets.groupBy("dt").agg((F.avg("r") / 100).alias("ret")).withColumn("portfolio", F.lit("all")))


def regression(s: SparkSession, sf: str) -> DataFrame:
    """Portfolios regressed on the factors over all dates and over every two years, all at once."""
    spans = [("all", "1900-01-01", "2100-01-01"), *((f"{y}-{y + 1}", f"{y}-01-01", f"{y + 1}-12-31") for y in range(1995, 2001))]
    windows = s.createDataFrame(spans, "window string, start string, end string").select("window", F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"))
    return X.factor_regression(X.by_windows(sleeves(s, sf), windows), factors(s, sf), keys=["portfolio", "window"])


def changes(s: SparkSession, sf: str) -> DataFrame:
    return PP.QUERIES["metric_evolution"](s, sf)


def weights(s: SparkSession, sf: str) -> DataFrame:
    return config.metric_dimension(s).select("category", "metric", F.col("generic").alias("weight"))


def folder(s: SparkSession, name: str) -> str:
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


def _scores(s: SparkSession, sf: str, read: str | None) -> DataFrame:
    """Scores of three dates written under their keys, the first date twice; all of them, or the newest of a configuration."""
    path, found = folder(s, "scores"), RC.names(s, sf).withColumn("_private", F.lit(1))
    U.save_scores(found.where("sector = 'BUILDING'"), path, "factor_scores", "aaa", "2001-06-30")
    U.save_scores(found, path, "factor_scores", "aaa", "2001-06-30")
    U.save_scores(found.where("sector <> 'BUILDING'"), path, "factor_scores", "aaa", "2001-07-31")
    U.save_scores(found.where("sector = 'BUILDING'"), path, "factor_scores", "bbb", "2001-08-31")
    df = U.load_scores(s, path, "factor_scores", read) if read else s.read.parquet(path)
    return df.select("ticker", "company", "sector", "tier", "config_hash", "as_of")


def _snapshots(s: SparkSession, sf: str) -> DataFrame:
    """A snapshot of a date, taken again after its portfolio changed."""
    path, names = folder(s, "snapshots"), RC.names(s, sf)
    for last in ("5", "7"):
        H.replace_partitions(T.snapshot(names, names.where(f"substr(ticker, -1) = '{last}'"), "2001-06-30"), path, ["run_date"])
    return s.read.parquet(path).select("ticker", "company", "sector", "in_portfolio", "run_date")


def _histories(s: SparkSession, sf: str) -> DataFrame:
    """The first half of each year, then the second with two months that are there already, twice."""
    path = folder(s, "history")
    for months in ("month(run_date) <= 6", "month(run_date) >= 5", "month(run_date) >= 5"):
        found = RC.history(s, sf, months)
        H.append_new_partitions(found.withColumn("n_tickers", F.when(F.month("run_date") < 7, F.col("n_tickers")).otherwise(F.col("n_tickers") + 1)), path, ["run_date", "horizon"])
    return s.read.parquet(path).select("run_date", "horizon", "n_tickers")


def _versions(s: SparkSession, sf: str) -> DataFrame:
    """Two versions of the weights; the second is written twice."""
    path, redistributed = folder(s, "weights"), P.redistribute(weights(s, sf), changes(s, sf)).select("category", "metric", "new_weight")
    H.append_weights(weights(s, sf).withColumnRenamed("weight", "new_weight"), path, "2001-01-01")
    H.append_weights(redistributed.withColumn("new_weight", F.col("new_weight") / 2), path, TODAY)
    H.append_weights(redistributed, path, TODAY)
    return s.read.parquet(path).select("version", "as_of", "category", "metric", "weight")


def _artifacts(s: SparkSession, sf: str) -> DataFrame:
    path, names = folder(s, "artifacts"), RC.names(s, sf)
    U.save_artifact(names, path, "r1", "00_universe")
    U.save_artifact(names.where("sector = 'BUILDING'"), path, "r1", "01_kept")
    one = lambda stage: U.artifact(s, path, "r1", stage).agg(F.count(F.lit(1)).alias("rows"), F.min("ticker").alias("first")).withColumn("stage", F.lit(stage))
    return one("00_universe").unionByName(one("01_kept"))


def _csv(s: SparkSession, sf: str) -> DataFrame:
    path, rows = folder(s, "csv"), BT.QUERIES["bt_decile_returns"](s, sf).select("as_of", "decile", "ret", "n")
    U.write_csv_with_notes(rows, path, ["Illustrative only.", "Two known biases."])
    return U.read_csv_with_notes(s, path, "as_of date, decile int, ret double, n long")


def _caches(s: SparkSession, sf: str) -> DataFrame:
    """What the listing of a score table shows that holds a date for each month."""
    path, rows = folder(s, "caches"), SR.monthly(s, sf).withColumnRenamed("month_end", "as_of")
    keyed = rows.withColumns({"tier": F.when(F.month("as_of") % 2 == 0, "factor_scores").otherwise("raw"), "config_hash": F.when(F.year("as_of") < 2000, "old").otherwise("new")})
    H.replace_partitions(keyed, path, U.SCORE_KEYS)
    return U.caches(s, path)


def _backfill(s: SparkSession, sf: str) -> DataFrame:
    """Runs of every month; snapshots exist for those of January."""
    runs = SR.months(s, sf).select(F.date_format("month_end", "yyyyMM").alias("run_id"), F.when(F.month("month_end") != 5, F.col("month_end")).alias("run_date"))
    scores = SR.monthly(s, sf).select(F.date_format("month_end", "yyyyMM").alias("run_id"), "ticker", rounded(F.col("close"), 4).alias("composite"))
    members = scores.where("substr(ticker, -1) = '7'").select("run_id", "ticker")
    have = scores.where("substr(run_id, 5) = '01'").join(runs, "run_id").select("run_date", "run_id", "ticker", "composite", F.lit(False).alias("in_portfolio"))
    return U.backfill(have, runs, scores, members)


QUERIES = {
    "prior_year_fallback": lambda s, sf: ST.prior_year(lines(s, sf)).select("ticker", "label", rounded(F.col("prior"), 2).alias("prior"), "source"),
    "annual_fallback": lambda s, sf: ST.source_blocks(lines(s, sf), config.DECISIVE).select("ticker", "statement", "label", rounded(F.col("value"), 2).alias("value"), "source"),
    "beneish_inputs": lambda s, sf: ST.current_and_prior(lines(s, sf), CHAINS).select("ticker", *[rounded(F.col(c), 2).alias(c) for f in CHAINS for c in (f, f"{f}_prior")]),
    "factor_returns_scan": lambda s, sf: factors(s, sf).select("dt", *[rounded(F.col(f"`{c}`"), 10).alias(c.replace("-", "_")) for c in ("Mkt-RF", "SMB", "HML", "RMW", "CMA", "RF", "UMD")]),
    "ff_regression": lambda s, sf: regression(s, sf).select("portfolio", "window", "factor", *[rounded(F.col(c), 6).alias(c) for c in ("coefficient", "r2", "r2_adjusted")], rounded(F.col("f_value"), 3).alias("f_value"), "n"),
    "ff_alpha_annualised": lambda s, sf: X.annualised_alpha(regression(s, sf), keys=["portfolio", "window"]).select("portfolio", "window", *[rounded(F.col(c), 4).alias(c) for c in ("alpha_pct", "t_value")], "significance"),
    "weight_redistribution": lambda s, sf: P.redistribute(weights(s, sf), changes(s, sf)),
    "weights_version_append": lambda s, sf: _versions(s, sf),
    "weights_change_log": lambda s, sf: P.change_log(changes(s, sf), TODAY),
    "snapshot_append": lambda s, sf: _snapshots(s, sf),
    "history_append_dedup": lambda s, sf: _histories(s, sf),
    "scores_write": lambda s, sf: _scores(s, sf, None),
    "scores_read": lambda s, sf: _scores(s, sf, "aaa"),
    "stage_artifacts": lambda s, sf: _artifacts(s, sf),
    "csv_sinks": lambda s, sf: _csv(s, sf),
    "cache_freshness": lambda s, sf: U.cache_freshness(_caches(s, sf), F.lit(TODAY).cast("date"), {"factor_scores": 1500, "raw": 400}),
    "run_state": lambda s, sf: U.run_state(U.cache_freshness(_caches(s, sf), F.lit(TODAY).cast("date"), {"factor_scores": 1500, "raw": 400})),
    "run_manifest": lambda s, sf: U.manifest(RC.records(s, sf).select("ticker", F.col("error").isNotNull().alias("failed")), "r1", RUN, "2001-12-31 10:00:00"),
    "snapshot_backfill": lambda s, sf: _backfill(s, sf),
    "fetch_time_stats": lambda s, sf: U.load_times(V.base(s, sf, "lineitem").join(V.base(s, sf, "orders"), F.expr("l_orderkey = o_orderkey")).select(F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).cast("long").alias("ms"))),
    "acc_sector_name": lambda s, sf: D.sector_name(V.base(s, sf, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"), F.element_at(F.array(*[F.lit(x) for x in config.SECTOR_NAMES]), (F.col("c_nationkey") % len(config.SECTOR_NAMES) + 1).cast("int")).alias("sector")), config.SECTOR_NAMES),
}

# -- SQL ---------------------------------------------------------------------------------------------

LN = f"l AS (SELECT * FROM {V.oracle(V.STATEMENT_LINES)} v UNION ALL SELECT * FROM {V.oracle(V.ANNUAL_LINES)} v), n AS (SELECT *, row_number() OVER (PARTITION BY ticker, statement, freq, label ORDER BY period_end DESC) - 1 AS k FROM l WHERE value IS NOT NULL)"
FAC = f"WITH a AS {V.oracle(V.FACTORS_FIVE)}, b AS {V.oracle(V.FACTOR_MOMENTUM)}"

def _critical(z: float) -> str:
    """The t value as rare as z in a normal distribution, by the first terms of its series in 1 / df."""
    return f"({z} + {(z**3 + z) / 4} / (n - 7) + {(5 * z**5 + 16 * z**3 + 3 * z) / 96} / ((n - 7) * (n - 7)))"


def _steps(source: str, names: list[str]) -> str:
    """CTEs e0, e1, ...: centred columns, from which one factor after another is taken out (Gram and Schmidt); b<i><j> are the slopes of column j on what is left of factor i."""
    size, over = len(names), "OVER (PARTITION BY portfolio, win)"
    out = f"e0 AS (SELECT portfolio, win, {', '.join(f'avg({c}) {over} AS m{i}, {c} - avg({c}) {over} AS c{i}' for i, c in enumerate(names))} FROM {source})"
    for i in range(size - 1):
        later = range(i + 1, size)
        out += f", s{i} AS (SELECT *, {', '.join(f'sum(c{i} * c{j}) {over} / sum(c{i} * c{i}) {over} AS b{i}_{j}' for j in later)} FROM e{i})"
        out += f", e{i + 1} AS (SELECT * EXCLUDE ({', '.join(f'c{j}' for j in later)}), {', '.join(f'c{j} - b{i}_{j} * c{i} AS c{j}' for j in later)} FROM s{i})"
    return out


def _regression_sql(cols: str) -> str:
    """Coefficients by going back through the steps; the spread of the constant from what each factor leaves."""
    x = ["mkt", "smb", "hml", "rmw", "cma", "mom"]
    labels = ["Mkt-RF", "SMB", "HML", "RMW", "CMA", "UMD"]
    y, k = len(x), len(x)
    spans = "('all', DATE '1900-01-01', DATE '2100-01-01'), " + ", ".join(f"('{v}-{v + 1}', DATE '{v}-01-01', DATE '{v + 1}-12-31')" for v in range(1995, 2001))
    one = ", ".join(f"any_value(m{i}) AS m{i}, sum(c{i} * c{i}) AS q{i}" for i in range(k + 1)) + ", " + ", ".join(f"any_value(b{i}_{j}) AS b{i}_{j}" for i in range(k) for j in range(i + 1, k + 1))
    back, zeros = "", ""
    for i in reversed(range(k)):
        back += f", u{i} AS (SELECT *, b{i}_{y}{''.join(f' - b{i}_{j} * a{j}' for j in range(i + 1, k))} AS a{i} FROM {'g' if i == k - 1 else f'u{i + 1}'})"
    for i in range(k):
        zeros += f", v{i} AS (SELECT *, m{i}{''.join(f' - b{j}_{i} * z{j}' for j in range(i))} AS z{i} FROM {'u0' if i == 0 else f'v{i - 1}'})"
    means = " - ".join(["m" + str(y), *(f"a{i} * m{i}" for i in range(k))])
    lever = " + ".join(["1.0::DOUBLE / n", *(f"z{i} * z{i} / q{i}" for i in range(k))])
    return f"""{FAC}, sl AS (SELECT 'sleeve ' || k AS portfolio, dt, r / 100 AS ret FROM {V.oracle(V.SLEEVE_RETURNS)} v WHERE k > 5 AND r IS NOT NULL), pr AS (SELECT * FROM sl UNION ALL SELECT 'all', dt, avg(ret) FROM sl GROUP BY dt), wi(win, a, b) AS (VALUES {spans}),
 fs AS (SELECT a.dt, {', '.join(f'{c} / 100 AS {c}' for c in (*x[:-1], 'rf'))}, mom / 100 AS mom FROM a JOIN b ON a.dt = b.dt),
 ro AS (SELECT portfolio, win, {', '.join(x)}, ret - rf AS y FROM pr JOIN fs ON pr.dt = fs.dt JOIN wi ON pr.dt BETWEEN wi.a AND wi.b WHERE {' AND '.join(f'{c} IS NOT NULL' for c in x)}), {_steps('ro', [*x, 'y'])},
 g AS (SELECT portfolio, win, count(*) AS n, {one} FROM e{k} GROUP BY 1, 2 HAVING count(*) >= 30){back}{zeros},
 en AS (SELECT *, q{y} AS rest, {' + '.join(f'b{i}_{y} * b{i}_{y} * q{i}' for i in range(k))} AS told, {means} AS const, {lever} AS lever FROM v{k - 1}),
 fit AS (SELECT *, told / (told + rest) AS r2, 1 - rest / (told + rest) * (n - 1) / (n - {k + 1}) AS r2_adjusted, told / {k} / (rest / (n - {k + 1})) AS f_value, const / sqrt(rest / (n - {k + 1}) * lever) AS t FROM en),
 co AS ({' UNION ALL '.join(f"SELECT portfolio, win, '{name}' AS factor, {c} AS coefficient, t, r2, r2_adjusted, f_value, n FROM fit" for name, c in [*zip(labels, [f'a{i}' for i in range(k)], strict=True), ('const', 'const')])})
 SELECT {cols} FROM co"""


EVOLVED = PP.CHANGES.replace("ev AS (SELECT", "ev_ AS (SELECT").replace("FROM ev WHERE", "FROM ev_ WHERE") + ", ev AS (SELECT category, metric, generic AS weight FROM dim)"
REDIST = f"""{EVOLVED}, r0 AS (SELECT ev.category, ev.metric, ev.weight, action, new_weight, coalesce(new_weight, ev.weight) AS w, count(action) OVER (PARTITION BY ev.category) AS touched FROM ev LEFT JOIN ch ON ch.category = ev.category AND ch.metric = ev.metric),
 r1 AS (SELECT *, coalesce(sum(CASE WHEN action = 'activate' THEN new_weight END) OVER k, 0) - coalesce(sum(CASE WHEN action = 'lower' THEN weight - new_weight END) OVER k, 0) AS net FROM r0 WHERE touched > 0 WINDOW k AS (PARTITION BY category)),
 r2 AS (SELECT *, CASE WHEN w > 0 AND NOT coalesce(action = CASE WHEN net > 0 THEN 'activate' ELSE 'lower' END, false) THEN w END AS base FROM r1),
 r3 AS (SELECT category, metric, weight, CASE WHEN base IS NULL OR net = 0 OR sum(base) OVER k <= 0 THEN w ELSE {rd("greatest(0, base - base / sum(base) OVER k * net)", 1)} END AS w FROM r2 WINDOW k AS (PARTITION BY category)),
 r4 AS (SELECT *, sum(w) OVER (PARTITION BY category) AS total FROM r3), r5 AS (SELECT category, metric, weight, abs(total - 100) > 0.5 AND total > 0 AS off, CASE WHEN abs(total - 100) > 0.5 AND total > 0 THEN {rd("w * (100.0::DOUBLE / total)", 1)} ELSE w END AS w FROM r4),
 r6 AS (SELECT *, 100.0::DOUBLE - sum(w) OVER (PARTITION BY category) AS rest, row_number() OVER (PARTITION BY category ORDER BY w DESC, metric) AS nth FROM r5),
 rd AS (SELECT category, metric, weight, CASE WHEN off AND abs(rest) > 0.01 AND nth = 1 THEN {rd("w + rest", 1)} ELSE w END AS new_weight FROM r6)"""
NAMES = f"{SC.M}, nm AS (SELECT ticker, company, sector, 'factor_scores' AS tier FROM m)"
SCORE_DATES = f"WITH {NAMES}, al AS (SELECT *, 'aaa' AS config_hash, DATE '2001-06-30' AS as_of FROM nm UNION ALL SELECT *, 'aaa', DATE '2001-07-31' FROM nm WHERE sector <> 'BUILDING' UNION ALL SELECT *, 'bbb', DATE '2001-08-31' FROM nm WHERE sector = 'BUILDING')"
CACHES = f"WITH ca AS (SELECT CASE WHEN month(month_end) % 2 = 0 THEN 'factor_scores' ELSE 'raw' END AS tier, CASE WHEN year(month_end) < 2000 THEN 'old' ELSE 'new' END AS config_hash, max(month_end) AS newest FROM {V.oracle(V.MARKET_MONTHLY)} v GROUP BY 1, 2), fr AS (SELECT *, CAST(DATE '{TODAY}' - newest AS INT) AS age, DATE '{TODAY}' - newest < CASE tier WHEN 'factor_scores' THEN 1500 ELSE 400 END AS fresh FROM ca)"
VENDORS = "[" + ", ".join(repr(x) for x in config.SECTOR_NAMES) + "]"
STANDARD = "[" + ", ".join(repr(x) for x in config.SECTOR_NAMES.values()) + "]"
_BEST = lambda f, k: rd(f"arg_min(value, place) FILTER (field = '{f}' AND k = {k})", 2)

ORACLE_SQL = {
    "prior_year_fallback": f"WITH {LN}, q AS (SELECT ticker, label, CASE WHEN count(*) FILTER (k >= 4 AND k < 8) = 4 THEN sum(value) FILTER (k >= 4 AND k < 8) END AS ltm FROM n WHERE freq = 'Q' GROUP BY ticker, statement, label), a AS (SELECT ticker, label, value FROM n WHERE freq = 'A' AND k = 1) SELECT coalesce(q.ticker, a.ticker) AS ticker, coalesce(q.label, a.label) AS label, {rd('coalesce(ltm, value)', 2)} AS prior, CASE WHEN ltm IS NOT NULL THEN 'quarterly' WHEN value IS NOT NULL THEN 'annual' END AS source FROM q FULL JOIN a ON q.ticker = a.ticker AND q.label = a.label",
    "annual_fallback": f"WITH {LN}, q AS (SELECT ticker, statement, label, CASE count(*) FILTER (k < 4) WHEN 4 THEN sum(value) FILTER (k < 4) WHEN 3 THEN sum(value) FILTER (k < 4) * 4 / 3 END AS ltm FROM n WHERE freq = 'Q' AND statement IN ('income', 'cashflow') GROUP BY 1, 2, 3), a AS (SELECT ticker, statement, label, value AS annual FROM n WHERE freq = 'A' AND statement IN ('income', 'cashflow') AND k = 0), b AS (SELECT coalesce(q.ticker, a.ticker) AS ticker, coalesce(q.statement, a.statement) AS statement, coalesce(q.label, a.label) AS label, ltm, annual FROM q FULL JOIN a ON q.ticker = a.ticker AND q.label = a.label AND q.statement = a.statement), c AS (SELECT *, count(ltm) FILTER ({' OR '.join(f"(statement = '{st}' AND label IN ({', '.join(repr(x) for x in xs)}))" for st, xs in config.DECISIVE.items())}) OVER (PARTITION BY ticker, statement) > 0 AS quarterly FROM b), d AS (SELECT ticker, statement, label, CASE WHEN quarterly THEN ltm ELSE annual END AS value, CASE WHEN quarterly THEN 'quarterly' ELSE 'annual' END AS source FROM c) SELECT ticker, statement, label, {rd('value', 2)} AS value, source FROM d WHERE value IS NOT NULL",
    "beneish_inputs": f"WITH {LN}, ch(field, place, label) AS (VALUES {', '.join(f'({f!r}, {i}, {x!r})' for f, xs in CHAINS.items() for i, x in enumerate(xs))}), j AS (SELECT n.ticker, n.k, n.value, field, place FROM n JOIN ch ON lower(n.label) = lower(ch.label) WHERE freq = 'A' AND k <= 1) SELECT ticker, {', '.join(f'{_BEST(f, 0)} AS {f}, {_BEST(f, 1)} AS {f}_prior' for f in CHAINS)} FROM j GROUP BY ticker",
    "factor_returns_scan": f"{FAC} SELECT a.dt, {', '.join(f'{rd(f'{x} / 100', 10)} AS {y}' for x, y in (('mkt', 'Mkt_RF'), ('smb', 'SMB'), ('hml', 'HML'), ('rmw', 'RMW'), ('cma', 'CMA'), ('rf', 'RF'), ('mom', 'UMD')))} FROM a JOIN b ON a.dt = b.dt",
    "ff_regression": _regression_sql(f"portfolio, win AS window, factor, {rd('coefficient', 6)} AS coefficient, {rd('r2', 6)} AS r2, {rd('r2_adjusted', 6)} AS r2_adjusted, {rd('f_value', 3)} AS f_value, n"),
    "ff_alpha_annualised": _regression_sql(f"portfolio, win AS window, {rd('coefficient * 25200', 4)} AS alpha_pct, {rd('t', 4)} AS t_value, CASE WHEN abs(t) > {_critical(2.575829)} THEN '***' WHEN abs(t) > {_critical(1.959964)} THEN '**' WHEN abs(t) > {_critical(1.644854)} THEN '*' ELSE '' END AS significance") + " WHERE factor = 'const'",
    "weight_redistribution": f"WITH {REDIST} SELECT * FROM rd",
    "weights_version_append": f"WITH {REDIST} SELECT 1 AS version, DATE '2001-01-01' AS as_of, category, metric, weight FROM ev UNION ALL SELECT 2, DATE '{TODAY}', ev.category, ev.metric, coalesce(rd.new_weight, ev.weight) FROM ev LEFT JOIN rd ON rd.category = ev.category AND rd.metric = ev.metric",
    "weights_change_log": f"WITH {EVOLVED} SELECT DATE '{TODAY}' AS date, CASE action WHEN 'activate' THEN 'metric_activation' ELSE 'metric_deactivation' END AS change_type, category, metric, weight AS old_value, new_weight AS new_value FROM ch",
    "snapshot_append": f"WITH {SC.M} SELECT ticker, company, sector, right(ticker, 1) = '7' AS in_portfolio, DATE '2001-06-30' AS run_date FROM m",
    "history_append_dedup": f"WITH {RC.HIST} SELECT run_date, horizon, n_tickers + CASE WHEN month(run_date) < 7 THEN 0 ELSE 1 END AS n_tickers FROM h",
    "scores_write": f"{SCORE_DATES} SELECT * FROM al",
    "scores_read": f"{SCORE_DATES} SELECT * FROM al WHERE config_hash = 'aaa' AND as_of = DATE '2001-07-31'",
    "stage_artifacts": "SELECT '00_universe' AS stage, count(*) AS rows, min('C' || c_custkey) AS first FROM customer UNION ALL SELECT '01_kept', count(*), min('C' || c_custkey) FROM customer WHERE c_mktsegment = 'BUILDING'",
    "csv_sinks": BT.ORACLE_SQL["bt_decile_returns"],
    "cache_freshness": f"{CACHES} SELECT * FROM fr",
    "run_state": f"{CACHES} SELECT config_hash, count(*) AS tiers, count(*) FILTER (fresh) AS fresh, CASE WHEN count(*) FILTER (fresh) = count(*) THEN 'hot' WHEN count(*) FILTER (fresh) > 0 THEN 'warm' ELSE 'cold' END AS state FROM fr GROUP BY 1",
    "run_manifest": f"WITH {RC.RECORDS} SELECT 'r1' AS run_id, TIMESTAMP '2001-12-31 10:00:00' AS started, '{U.config_hash(RUN)}' AS config_hash, count(*) FILTER (error IS NULL) AS scored_count, count(error) AS failed_count, '{json.dumps(RUN['factor_weights'], sort_keys=True)}' AS weights FROM rc",
    "snapshot_backfill": f"WITH sc AS (SELECT strftime(month_end, '%Y%m') AS run_id, CASE WHEN month(month_end) <> 5 THEN month_end END AS run_date, ticker, {rd('close', 4)} AS composite FROM {V.oracle(V.PRICES_MONTHLY)} v) SELECT run_date, run_id, ticker, composite, right(run_id, 2) <> '01' AND right(ticker, 1) = '7' AS in_portfolio FROM sc WHERE run_date IS NOT NULL",
    "fetch_time_stats": "WITH a AS (SELECT CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS BIGINT) AS ms FROM lineitem JOIN orders ON l_orderkey = o_orderkey), b AS (SELECT ms, row_number() OVER (ORDER BY ms) - 1 AS i, count(*) OVER () AS n FROM a WHERE ms > 0) SELECT min(ms) AS least, CAST(floor(avg(ms)) AS BIGINT) AS mean, max(ms) AS most, max(ms) FILTER (i = CAST(floor(n * 0.95::DOUBLE) AS BIGINT)) AS p95, count(*) AS n FROM b",
    "acc_sector_name": f"WITH a AS (SELECT 'C' || c_custkey AS ticker, {VENDORS}[CAST(c_nationkey % {len(config.SECTOR_NAMES)} + 1 AS INT)] AS vendor, {STANDARD}[CAST(c_nationkey % {len(config.SECTOR_NAMES)} + 1 AS INT)] AS standard FROM customer) SELECT ticker, 'sector_name' AS issue, 'Critical' AS severity, vendor || ' / ' || standard AS detail FROM a WHERE vendor <> standard",
}
