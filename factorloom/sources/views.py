"""The tables of securities over the supplied tables.

Each view is one SQL text with the base tables as ``{names}``; it reads the same in Spark and in the
oracle. Money is summed in whole cents, so sums do not depend on the order of rows.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import stored

CENTS = "CAST(floor({x} * 100 + 0.5e0) AS BIGINT)"


def cents(x: str) -> str:
    return CENTS.replace("{x}", x)


YEARS = f"""
SELECT o_custkey AS ck, CAST(extract(year FROM o_orderdate) AS INT) AS yr, sum(rev) AS rev, sum(cogs) AS cogs, sum(tax) AS tax, sum(qty) AS qty, count(*) AS n
FROM {{orders}} JOIN (
  SELECT l_orderkey, sum({cents("l_extendedprice")}) AS rev, sum({cents("(l_extendedprice * (0.5e0 + l_discount))")}) AS cogs,
    sum({cents("(l_extendedprice * l_tax)")}) AS tax, sum(CAST(l_quantity AS BIGINT)) AS qty
  FROM {{lineitem}} GROUP BY l_orderkey) li ON o_orderkey = l_orderkey
GROUP BY o_custkey, CAST(extract(year FROM o_orderdate) AS INT)"""


def _year(name: str, k: int) -> str:
    return f"CAST(max(CASE WHEN k = {k} THEN {name} END) AS DOUBLE) / 100e0 AS {name}{k - 1}"


PIVOT = f"""
SELECT ck, {", ".join(_year(x, k) for x in ("rev", "cogs", "tax") for k in (1, 2, 4))},
  CAST(sum(n) AS DOUBLE) AS n_orders, CAST(max(CASE WHEN k = 1 THEN qty END) AS DOUBLE) AS qty0, CAST(max(CASE WHEN k = 2 THEN qty END) AS DOUBLE) AS qty1, count(*) AS n_years
FROM (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY yr DESC) AS k FROM ({YEARS}) y) r GROUP BY ck"""

#: One row per security with the raw fields of fundamentals; nulls are derived from absent years and from the key.
FUNDAMENTALS = f"""
SELECT 'C' || CAST(c_custkey AS STRING) AS ticker, c_name AS company, c_mktsegment AS sector, 'nation ' || CAST(c_nationkey AS STRING) AS industry,
  c_custkey AS ck, c_acctbal AS acctbal,
  CASE WHEN c_custkey % 37 <> 0 THEN rev0 * (1 + c_custkey % 5) * 0.8e0 END AS market_cap,
  CASE WHEN c_custkey % 13 = 0 THEN 0e0 WHEN c_custkey % 11 <> 0 THEN rev0 * (1 + c_custkey % 5) * (0.7e0 + (c_custkey % 7) * 0.05e0) END AS enterprise_value,
  rev0 * (c_custkey % 4) * 0.25e0 AS total_debt,
  CASE WHEN c_custkey % 17 <> 0 THEN abs(c_acctbal) * 10 END AS total_cash,
  CASE WHEN c_custkey % 19 <> 0 THEN rev0 END AS revenue, rev1 AS revenue_prior, rev3 AS revenue_3yr_ago,
  rev0 - cogs0 AS gross_profit, rev1 - cogs1 AS gross_profit_prior, cogs0 AS cost_of_revenue, cogs1 AS cost_of_revenue_prior,
  CASE WHEN c_custkey % 23 <> 0 THEN rev0 - cogs0 - tax0 * 3 END AS ebit, rev1 - cogs1 - tax1 * 3 AS ebit_prior,
  (rev0 - cogs0 - tax0 * 3) * 1.2e0 AS ebitda, rev0 * 0.04e0 * (c_custkey % 3) AS da,
  rev0 - cogs0 - tax0 * 8 AS net_income, rev1 - cogs1 - tax1 * 8 AS net_income_prior, tax0 AS tax_expense, rev0 - cogs0 - tax0 * 7 AS pretax_income,
  rev0 * 1.5e0 + abs(c_acctbal) * 20 AS total_assets, rev1 * 1.5e0 + abs(c_acctbal) * 20 AS total_assets_prior,
  rev0 * 0.6e0 - (c_custkey % 9) * rev0 * 0.08e0 + c_acctbal AS equity, rev1 * 0.6e0 - (c_custkey % 9) * rev1 * 0.08e0 + c_acctbal AS equity_prior,
  rev0 * 0.2e0 * (c_custkey % 3) AS lt_debt, rev1 * 0.2e0 * (c_custkey % 3) AS lt_debt_prior,
  rev0 * 0.3e0 + c_custkey % 100 AS current_liabilities, rev1 * 0.3e0 + c_custkey % 100 AS current_liabilities_prior,
  rev0 * 0.4e0 AS current_assets, rev1 * 0.4e0 AS current_assets_prior,
  CASE WHEN c_custkey % 29 <> 0 THEN rev0 * 0.12e0 END AS receivables, rev1 * (0.1e0 + (c_custkey % 5) * 0.01e0) AS receivables_prior,
  rev0 * 0.5e0 AS ppe, rev1 * 0.5e0 AS ppe_prior, rev0 * 0.04e0 AS depreciation, rev1 * 0.05e0 AS depreciation_prior, rev0 * 0.1e0 AS sga, rev1 * 0.11e0 AS sga_prior,
  CAST(100 + c_custkey % 50 AS DOUBLE) AS shares, CAST(100 + c_custkey % 47 AS DOUBLE) AS shares_prior,
  CASE WHEN c_custkey % 31 <> 0 THEN rev0 - cogs0 - tax0 * 5 - c_acctbal END AS ocf, -(rev0 * 0.03e0 * (c_custkey % 4)) AS capex, -(rev0 * 0.01e0 * (c_custkey % 6)) AS dividends_paid,
  (rev0 - cogs0 - tax0 * 8) / (100 + c_custkey % 50) AS trailing_eps, (rev0 - cogs0 - tax0 * 7) / (100 + c_custkey % 43) AS forward_eps,
  rev0 / (100 + c_custkey % 50) AS price, rev0 / (100 + c_custkey % 53) AS price_1m, rev1 / (100 + c_custkey % 50) AS price_6m, rev1 / (100 + c_custkey % 59) AS price_12m, rev0 / (95 + c_custkey % 41) AS high_52w,
  CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 12) * 0.2e0 END AS payout_ratio, (c_custkey % 8) * 0.5e0 AS dividend_rate,
  CASE WHEN c_custkey % 5 <> 0 THEN 0.5e0 + (c_custkey % 9) * 0.5e0 END AS price_to_book, rev0 * 0.004e0 AS book_value,
  CASE WHEN c_custkey % 6 = 0 THEN 0.01e0 * (c_custkey % 30) END AS info_roe, CAST(NULL AS DOUBLE) AS info_roa,
  rev0 / (90 + c_custkey % 60) AS target_price, CAST(c_custkey % 9 AS INT) AS n_analysts, (c_custkey % 15) - 1e0 AS short_ratio, 0.02e0 * (c_custkey % 60) AS insider_held, 0.01e0 * (c_custkey % 40) AS short_float, 0.5e0 + (c_custkey % 11) * 0.5e0 AS rating, rev0 * 0.005e0 * (c_custkey % 5) AS interest_expense,
  'P' || CAST(c_custkey % 100 AS STRING) AS series, 'S' || CAST(c_custkey % (SELECT max(s_suppkey) FROM {{supplier}}) + 1 AS STRING) AS earner,
  rev1 - cogs1 AS ltm_prior_gross, rev0 / nullif(n_orders, 0) AS dollar_volume, n_orders, CAST(n_years AS INT) AS n_years
FROM {{customer}} LEFT JOIN ({PIVOT}) p ON c_custkey = ck"""

#: The two series that each security follows, without its fundamentals.
FOLLOWERS = """
SELECT 'C' || CAST(c_custkey AS STRING) AS ticker, 'P' || CAST(c_custkey % 100 AS STRING) AS series, 'S' || CAST(c_custkey % (SELECT max(s_suppkey) FROM {supplier}) + 1 AS STRING) AS earner
FROM {customer}"""

#: Mean price of each of ten sleeves of parts, by day; set high enough that returns stay moderate.
SLEEVES = f"""
SELECT CAST(l_partkey % 10 AS INT) AS k, CAST(l_shipdate AS DATE) AS dt,
  100000e0 + CAST(sum({cents("l_extendedprice")}) AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / 100e0 AS close
FROM {{lineitem}} GROUP BY CAST(l_partkey % 10 AS INT), CAST(l_shipdate AS DATE)"""

#: Daily price of each pair of sleeves: the series that securities follow.
PRICES_PAIRED = f"""
SELECT 'P' || CAST(a.k * 10 + b.k AS STRING) AS ticker, a.dt AS dt, (a.close + b.close) / 2e0 AS close
FROM ({SLEEVES}) a JOIN ({SLEEVES}) b ON a.dt = b.dt"""

#: Monthly mean price of each supplier, set high enough that returns stay moderate.
PRICES_MONTHLY = f"""
SELECT 'S' || CAST(l_suppkey AS STRING) AS ticker, last_day(CAST(l_shipdate AS DATE)) AS month_end,
  100000e0 + CAST(sum({cents("l_extendedprice")}) AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / 100e0 AS close
FROM {{lineitem}} GROUP BY l_suppkey, last_day(CAST(l_shipdate AS DATE))"""

MARKET_MONTHLY = f"""
SELECT last_day(CAST(l_shipdate AS DATE)) AS month_end,
  100000e0 + CAST(sum({cents("l_extendedprice")}) AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / 100e0 AS close
FROM {{lineitem}} GROUP BY last_day(CAST(l_shipdate AS DATE))"""

#: Daily mean price and volume of each type of part.
PRICES_DAILY = f"""
SELECT p_type AS ticker, CAST(l_shipdate AS DATE) AS dt,
  100000e0 + CAST(sum({cents("l_extendedprice")}) AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / 100e0 AS close, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS volume
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey GROUP BY p_type, CAST(l_shipdate AS DATE)"""

MARKET_DAILY = f"""
SELECT CAST(l_shipdate AS DATE) AS dt,
  100000e0 + CAST(sum({cents("l_extendedprice")}) AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / 100e0 AS close
FROM {{lineitem}} GROUP BY CAST(l_shipdate AS DATE)"""

#: Quarterly statement lines of each customer, without rows for quarters that have no orders.
STATEMENT_LINES = f"""
SELECT ticker, 'income' AS statement, 'Q' AS freq, line_no, label, period_end, value FROM (
  SELECT 'C' || CAST(o_custkey AS STRING) AS ticker, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL '2' MONTH) AS period_end,
    CAST(sum(rev) AS DOUBLE) / 100e0 AS rev, CAST(sum(cogs) AS DOUBLE) / 100e0 AS cogs, CAST(sum(tax) AS DOUBLE) / 100e0 AS tax
  FROM {{orders}} JOIN (
    SELECT l_orderkey, sum({cents("l_extendedprice")}) AS rev, sum({cents("(l_extendedprice * (0.5e0 + l_discount))")}) AS cogs, sum({cents("(l_extendedprice * l_tax)")}) AS tax
    FROM {{lineitem}} GROUP BY l_orderkey) li ON o_orderkey = l_orderkey
  GROUP BY o_custkey, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL '2' MONTH)) q
CROSS JOIN (VALUES (1, 'Total Revenue'), (2, 'Cost Of Revenue'), (3, 'Tax Provision'), (4, 'Operating Revenue')) AS l(line_no, label)
CROSS JOIN LATERAL (SELECT CASE line_no WHEN 1 THEN rev WHEN 2 THEN cogs WHEN 3 THEN CASE WHEN tax > 500 THEN tax END ELSE rev - cogs END AS value) v"""

#: Quarterly price of each supplier as earnings, the year-ago quarter as the estimate.
EARNINGS = f"""
SELECT ticker, quarter, eps_actual, lag(eps_actual, 4) OVER (PARTITION BY ticker ORDER BY quarter) AS eps_estimate FROM (
  SELECT 'S' || CAST(l_suppkey AS STRING) AS ticker, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS quarter,
    CAST(sum({cents("l_extendedprice")}) AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / 100e0 AS eps_actual
  FROM {{lineitem}} GROUP BY l_suppkey, CAST(date_trunc('quarter', l_shipdate) AS DATE)) q"""

#: Annual statement lines of each customer, under labels that differ between customers.
ANNUAL_LINES = f"""
SELECT 'C' || CAST(ck AS STRING) AS ticker, statement, 'A' AS freq, line_no, label, make_date(yr, 12, 31) AS period_end, value
FROM (SELECT ck, yr, CAST(rev AS DOUBLE) / 100e0 AS rev, CAST(cogs AS DOUBLE) / 100e0 AS cogs, CAST(tax AS DOUBLE) / 100e0 AS tax FROM ({YEARS}) y0) y
CROSS JOIN (VALUES (1, 'income', 'Total Revenue'), (2, 'income', 'Cost Of Revenue'), (3, 'income', 'Tax Provision'), (4, 'income', 'Selling General And Administration'), (5, 'income', 'Net Income'),
  (6, 'balance', 'Receivables'), (7, 'balance', 'Net Receivable'), (8, 'balance', 'Current Assets'), (9, 'balance', 'Net PPE'), (10, 'balance', 'Total Assets'), (11, 'balance', 'Long Term Debt'), (12, 'balance', 'Current Liabilities'),
  (13, 'cashflow', 'Depreciation'), (14, 'cashflow', 'Depreciation And Amortization'), (15, 'cashflow', 'Operating Cash Flow')) AS l(line_no, statement, label)
CROSS JOIN LATERAL (SELECT CASE line_no WHEN 1 THEN rev WHEN 2 THEN cogs WHEN 3 THEN tax WHEN 4 THEN rev * 0.1e0 WHEN 5 THEN rev - cogs - tax * 8
  WHEN 6 THEN CASE WHEN ck % 3 = 0 THEN rev * 0.12e0 END WHEN 7 THEN CASE WHEN ck % 3 <> 0 THEN rev * 0.11e0 END WHEN 8 THEN rev * 0.4e0 WHEN 9 THEN rev * 0.5e0 WHEN 10 THEN rev * 1.5e0 WHEN 11 THEN rev * 0.2e0 * (ck % 3) WHEN 12 THEN rev * 0.3e0
  WHEN 13 THEN CASE WHEN yr % 2 = 0 THEN rev * 0.04e0 END WHEN 14 THEN CASE WHEN ck % 2 = 0 THEN rev * 0.05e0 END ELSE rev - cogs - tax * 5 END AS value) v"""

#: Daily change of each sleeve in percent.
SLEEVE_RETURNS = f"""
SELECT k, dt, (close / lag(close) OVER (PARTITION BY k ORDER BY dt) - 1) * 100e0 AS r FROM ({SLEEVES}) s"""

#: Five factors and the rate without risk, and momentum, in percent, one row per day.
FACTORS_FIVE = f"""
SELECT dt, max(CASE WHEN k = 0 THEN r END) AS mkt, max(CASE WHEN k = 1 THEN r END) AS smb, max(CASE WHEN k = 2 THEN r END) AS hml, max(CASE WHEN k = 3 THEN r END) AS rmw, max(CASE WHEN k = 4 THEN r END) AS cma, 0.01e0 AS rf
FROM ({SLEEVE_RETURNS}) f WHERE k < 5 GROUP BY dt"""
FACTOR_MOMENTUM = f"""SELECT dt, r AS mom FROM ({SLEEVE_RETURNS}) f WHERE k = 5 AND r IS NOT NULL"""

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, text: str, of: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Run a view's SQL over the base tables it names; ``of`` has other rows for some of them."""
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))
    return spark.sql(text, **{n: of[n] if of and n in of else base(spark, sf_dir, n) for n in names})


def of_securities(spark: SparkSession, sf_dir: str, tickers: DataFrame) -> dict[str, DataFrame]:
    """Customers, orders and order lines of a few securities: views of a row for each security or its statements read these in place of all."""
    customers = base(spark, sf_dir, "customer").join(tickers.select(F.col("ticker").alias("_t")), F.concat(F.lit("C"), F.col("c_custkey").cast("string")) == F.col("_t"), "left_semi")
    orders = base(spark, sf_dir, "orders").join(customers.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    orders = stored(orders, "orders")
    return {"customer": customers, "orders": orders, "lineitem": base(spark, sf_dir, "lineitem").join(orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")}


def oracle(text: str) -> str:
    """The same text for the oracle, as a subquery."""
    return "(" + re.sub(r"\{(\w+)\}", r"\1", text) + ")"
