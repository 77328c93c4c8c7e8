"""Metric dimension, weights and thresholds: the defaults that all operators take as parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Category weights in percent.
CATEGORY_WEIGHTS = {
    "valuation": 22.0,
    "quality": 22.0,
    "growth": 13.0,
    "momentum": 13.0,
    "risk": 10.0,
    "revisions": 10.0,
    "size": 5.0,
    "investment": 5.0,
}
CATEGORIES = list(CATEGORY_WEIGHTS)

# Metric, category, higher is better, generic weight, bank weight, applies to.
# A bank weight of None means that banks use the generic one.
METRICS = [
    ("ev_ebitda", "valuation", False, 25.0, 0.0, "nonbank"),
    ("fcf_yield", "valuation", True, 45.0, 0.0, "all"),
    ("earnings_yield", "valuation", True, 20.0, 40.0, "all"),
    ("ev_sales", "valuation", False, 10.0, 0.0, "nonbank"),
    ("pb_ratio", "valuation", False, 0.0, 60.0, "bank"),
    ("dividend_yield", "valuation", True, 0.0, 0.0, "all"),
    ("roic", "quality", True, 27.0, 0.0, "nonbank"),
    ("gross_profit_assets", "quality", True, 20.0, 0.0, "nonbank"),
    ("net_debt_to_ebitda", "quality", False, 18.0, 0.0, "nonbank"),
    ("piotroski_f_score", "quality", True, 15.0, 15.0, "all"),
    ("accruals", "quality", False, 5.0, 10.0, "all"),
    ("operating_leverage", "quality", False, 8.0, 0.0, "nonbank"),
    ("beneish_m_score", "quality", False, 7.0, 0.0, "nonbank"),
    ("roe", "quality", True, 0.0, 35.0, "bank"),
    ("roa", "quality", True, 0.0, 25.0, "bank"),
    ("equity_ratio", "quality", True, 0.0, 15.0, "bank"),
    ("debt_equity", "quality", False, 0.0, 0.0, "all"),
    ("operating_margin", "quality", True, 0.0, 0.0, "nonbank"),
    ("current_ratio", "quality", True, 0.0, 0.0, "nonbank"),
    ("insider_ownership", "quality", True, 0.0, 0.0, "all"),
    ("interest_coverage", "quality", True, 0.0, 0.0, "nonbank"),
    ("forward_eps_growth", "growth", True, 45.0, None, "all"),
    ("peg_ratio", "growth", False, 0.0, None, "all"),
    ("revenue_growth", "growth", True, 25.0, None, "all"),
    ("revenue_cagr_3yr", "growth", True, 15.0, None, "all"),
    ("sustainable_growth", "growth", True, 15.0, None, "all"),
    ("return_12_1", "momentum", True, 40.0, None, "all"),
    ("return_6m", "momentum", True, 35.0, None, "all"),
    ("jensens_alpha", "momentum", True, 25.0, None, "all"),
    ("proximity_52w_high", "momentum", True, 0.0, None, "all"),
    ("volatility", "risk", False, 30.0, None, "all"),
    ("beta", "risk", False, 20.0, None, "all"),
    ("sharpe_ratio", "risk", True, 15.0, None, "all"),
    ("sortino_ratio", "risk", True, 15.0, None, "all"),
    ("max_drawdown_1y", "risk", True, 20.0, None, "all"),
    ("analyst_surprise", "revisions", True, 38.0, None, "all"),
    ("price_target_upside", "revisions", True, 12.0, None, "all"),
    ("earnings_acceleration", "revisions", True, 20.0, None, "all"),
    ("consecutive_beat_streak", "revisions", True, 20.0, None, "all"),
    ("short_interest_ratio", "revisions", False, 10.0, None, "all"),
    ("short_pct_float", "revisions", False, 0.0, None, "all"),
    ("analyst_rating", "revisions", False, 0.0, None, "all"),
    ("size_log_mcap", "size", True, 100.0, None, "all"),
    ("asset_growth", "investment", False, 100.0, None, "all"),
]
# Sector names of the vendor and of the standard.
SECTOR_NAMES = {
    "Technology": "Information Technology",
    "Healthcare": "Health Care",
    "Financial Services": "Financials",
    "Consumer Cyclical": "Consumer Discretionary",
    "Consumer Defensive": "Consumer Staples",
    "Communication Services": "Communication Services",
    "Basic Materials": "Materials",
    "Industrials": "Industrials",
    "Energy": "Energy",
    "Utilities": "Utilities",
    "Real Estate": "Real Estate",
}
METRIC_NAMES = [m[0] for m in METRICS]

# Metrics whose generic weight goes to others of their category where they are mostly missing.
REDUCIBLE = (
    "ev_ebitda", "fcf_yield", "earnings_yield", "ev_sales", "pb_ratio",
    "roic", "gross_profit_assets", "debt_equity", "piotroski_f_score", "accruals", "roe", "roa", "equity_ratio",
    "forward_eps_growth", "peg_ratio", "revenue_growth", "sustainable_growth",
    "return_12_1", "return_6m", "volatility", "beta",
    "analyst_surprise", "price_target_upside", "earnings_acceleration", "consecutive_beat_streak",
    "size_log_mcap", "asset_growth",
)
# Optional categories and the metrics whose coverage decides whether they are used.
OPTIONAL = {"revisions": ("analyst_surprise", "price_target_upside", "earnings_acceleration", "consecutive_beat_streak"), "investment": ("asset_growth",)}
# Least and largest weight of each category that a proposal may give, in percent.
CATEGORY_BOUNDS = {
    "valuation": (5.0, 35.0),
    "quality": (5.0, 35.0),
    "growth": (3.0, 25.0),
    "momentum": (3.0, 25.0),
    "risk": (2.0, 20.0),
    "revisions": (2.0, 20.0),
    "size": (0.0, 15.0),
    "investment": (0.0, 15.0),
}
# A statement whose labels here are all missing from quarterly figures comes from annual ones.
DECISIVE = {"income": ("Total Revenue", "Net Income", "EBIT"), "cashflow": ("Operating Cash Flow", "Capital Expenditure")}
# Metrics whose presence says how well a security is covered.
KEY_METRICS = (
    "ev_ebitda", "fcf_yield", "earnings_yield", "ev_sales", "roic", "gross_profit_assets", "debt_equity", "piotroski_f_score", "accruals",
    "forward_eps_growth", "revenue_growth", "sustainable_growth", "return_12_1", "return_6m", "volatility", "beta", "analyst_surprise", "price_target_upside",
)
# Metrics without weight that may be taken in.
CANDIDATES = ("proximity_52w_high", "operating_margin", "current_ratio", "dividend_yield", "insider_ownership", "short_pct_float", "analyst_rating", "interest_coverage")
WEIGHTED = [m[0] for m in METRICS if m[3] or m[4]]


def metric_dimension(spark: SparkSession) -> DataFrame:
    """metric, category, higher, generic, bank, applies: 44 rows, so it is always broadcast."""
    rows = [(n, c, h, g, g if b is None else b, a) for n, c, h, g, b, a in METRICS]
    return spark.createDataFrame(rows, "metric string, category string, higher boolean, generic double, bank double, applies string")


def metric_weights(spark: SparkSession) -> DataFrame:
    """profile, category, metric, weight: the long form of the dimension."""
    rows = [(p, c, n, w) for n, c, _, g, b, _ in METRICS for p, w in (("generic", g), ("bank", g if b is None else b))]
    return spark.createDataFrame(rows, "profile string, category string, metric string, weight double")


def category_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATEGORY_WEIGHTS.items()), "category string, weight double")


def dimension_sql() -> str:
    """The dimension as VALUES, for oracle SQL."""
    rows = ", ".join(f"('{n}', '{c}', {str(h).lower()}, {g}::DOUBLE, {g if b is None else b}::DOUBLE, '{a}')" for n, c, h, g, b, a in METRICS)
    return f"dim(metric, category, higher, generic, bank, applies) AS (VALUES {rows})"
