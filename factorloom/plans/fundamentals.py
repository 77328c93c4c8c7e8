"""Metric queries over the view of fundamentals, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import rounded
from ..operators import metrics as M
from ..sources import views as V
from .sql import rd

#: Industries whose financial securities count as banks, and tickers that never do.
BANK_INDUSTRIES = tuple(f"nation {k}" for k in range(17))
NEVER_BANKS = ("C10", "C77")
B0 = "(coalesce(sector = 'MACHINERY', false))"
B = f"(coalesce(sector = 'MACHINERY' AND industry IN ({', '.join(repr(x) for x in BANK_INDUSTRIES)}), false) AND ticker NOT IN ({', '.join(repr(x) for x in NEVER_BANKS)}))"
COMPUTED = "(market_cap + total_debt - total_cash)"
TOL = f"(CASE WHEN {B0} THEN 0.25::DOUBLE ELSE 0.1::DOUBLE END)"
FAR = f"({COMPUTED} > 0 AND enterprise_value > 0 AND (enterprise_value / {COMPUTED} < 1 - {TOL} OR enterprise_value / {COMPUTED} > 1 + {TOL}))"
GONE = "(enterprise_value IS NULL OR enterprise_value = 0)"


def pos(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a}) / {b} END"


def clip(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest({lo}::DOUBLE, least({hi}::DOUBLE, {x})) END"


RATE = f"(CASE WHEN pretax_income <= 0 THEN 0 ELSE coalesce({clip('tax_expense / nullif(pretax_income, 0)', 0.0, 0.5)}, 0.21::DOUBLE) END)"
INVESTED = "(equity + total_debt - least(greatest(0, total_cash - CASE WHEN revenue > 0 THEN 0.02::DOUBLE * revenue ELSE 0 END), 0.5::DOUBLE * total_cash))"
CAPITAL = f"(CASE WHEN total_cash IS NULL OR equity IS NULL OR total_debt IS NULL THEN NULL WHEN total_assets > 0 THEN greatest({INVESTED}, 0.1::DOUBLE * total_assets) ELSE {INVESTED} END)"
SIGNALS = [
    ("net_income", "net_income > 0"),
    ("ocf", "ocf > 0"),
    ("CASE WHEN total_assets > 0 AND total_assets_prior > 0 THEN net_income + net_income_prior END", "net_income / total_assets > net_income_prior / total_assets_prior"),
    ("ocf + net_income", "ocf > net_income"),
    ("CASE WHEN total_assets > 0 AND total_assets_prior > 0 THEN lt_debt + lt_debt_prior END", "lt_debt / total_assets < lt_debt_prior / total_assets_prior"),
    ("CASE WHEN current_liabilities > 0 AND current_liabilities_prior > 0 THEN current_assets + current_assets_prior END", "current_assets / current_liabilities > current_assets_prior / current_liabilities_prior"),
    ("shares + shares_prior", "shares <= shares_prior"),
    ("CASE WHEN revenue > 0 AND revenue_prior > 0 THEN gross_profit + gross_profit_prior END", "gross_profit / revenue > gross_profit_prior / revenue_prior"),
    ("CASE WHEN total_assets > 0 AND total_assets_prior > 0 THEN revenue + revenue_prior END", "revenue / total_assets > revenue_prior / total_assets_prior"),
]
HELD = "(" + " + ".join(f"CASE WHEN ({a}) IS NOT NULL AND {b} THEN 1 ELSE 0 END" for a, b in SIGNALS) + ")"
TESTABLE = "(" + " + ".join(f"CAST(({a}) IS NOT NULL AS INT)" for a, _ in SIGNALS) + ")"
GM, GMP = "((revenue - cost_of_revenue) / revenue)", "((revenue_prior - cost_of_revenue_prior) / revenue_prior)"
AQ, AQP = "(1 - (current_assets + ppe) / total_assets)", "(1 - (current_assets_prior + ppe_prior) / total_assets_prior)"
INDEX = {
    "dsri": "CASE WHEN receivables_prior > 0 THEN (receivables / revenue) / (receivables_prior / revenue_prior) END",
    "gmi": f"CASE WHEN revenue > 0 AND {GM} > 0 THEN CASE WHEN revenue_prior > 0 THEN {GMP} END / {GM} END",
    "aqi": f"CASE WHEN {AQP} <> 0 THEN {AQ} / {AQP} WHEN {AQP} = 0 AND {AQ} IS NOT NULL THEN 1 END",
    "sgi": "revenue / revenue_prior",
    "depi": "CASE WHEN ppe + depreciation > 0 AND ppe_prior + depreciation_prior > 0 AND depreciation <> 0 THEN (depreciation_prior / (ppe_prior + depreciation_prior)) / (depreciation / (ppe + depreciation)) END",
    "sgai": "CASE WHEN revenue > 0 AND revenue_prior > 0 AND sga_prior > 0 THEN (sga / revenue) / (sga_prior / revenue_prior) END",
    "tata": "CASE WHEN total_assets > 0 THEN (net_income - ocf) / total_assets END",
    "lvgi": "CASE WHEN total_assets > 0 AND total_assets_prior > 0 AND lt_debt_prior + current_liabilities_prior > 0 THEN ((lt_debt + current_liabilities) / total_assets) / ((lt_debt_prior + current_liabilities_prior) / total_assets_prior) END",
}
REAL = " + ".join(f"CAST(({x}) IS NOT NULL AS INT)" for x in INDEX.values())
MSCORE = "(CASE WHEN revenue <> 0 AND revenue_prior <> 0 AND total_assets <> 0 AND total_assets_prior <> 0 AND " + f"({REAL}) >= 5 THEN {M.MANIPULATION_BASE}::DOUBLE + " + " + ".join(f"{w}::DOUBLE * coalesce({INDEX[k]}, {0 if k == 'tata' else 1})" for k, w in M.MANIPULATION.items()) + " END)"
EBITDA = "(coalesce(CASE WHEN da >= 0 THEN ebit + da ELSE ebitda END, ebitda))"
DIVIDENDS = "coalesce(abs(dividends_paid), abs(dividend_rate * shares))"
RET = f"(CASE WHEN payout_ratio BETWEEN 0 AND 2 THEN greatest(0, 1 - payout_ratio) WHEN {DIVIDENDS} IS NOT NULL AND net_income > 0 THEN greatest(0, 1 - {DIVIDENDS} / net_income) END)"
RECV = "(CASE WHEN receivables_prior > 0 AND revenue_prior > 0 THEN (receivables - receivables_prior) / receivables_prior - (revenue - revenue_prior) / revenue_prior END)"
RATIO = "(CASE WHEN abs(trailing_eps) > 0.1::DOUBLE THEN forward_eps / trailing_eps END)"
RM, EM = "((revenue - revenue_prior) / abs(revenue_prior))", "((ebit - ebit_prior) / abs(ebit_prior))"
GROWN = clip("(forward_eps - trailing_eps) / greatest(abs(trailing_eps), 1)", -0.75, 1.5)
SQL = {
    "ev_ebitda": f"CASE WHEN NOT b AND ev > 0 AND {EBITDA} > 0 THEN ev / {EBITDA} END",
    "fcf_yield": pos("ocf - abs(capex)", "ev"),
    "earnings_yield": f"coalesce({pos('net_income', 'market_cap')}, {pos('trailing_eps', 'price')})",
    "ev_sales": f"CASE WHEN NOT b AND ev > 0 THEN {pos('ev', 'revenue')} END",
    "roic": f"CASE WHEN NOT b AND {CAPITAL} > 0 THEN ebit * (1 - {RATE}) / {CAPITAL} END",
    "gross_profit_assets": f"CASE WHEN NOT b THEN {pos('gross_profit', 'total_assets')} END",
    "debt_equity": f"CASE WHEN NOT b THEN {pos('total_debt', 'equity')} END",
    "net_debt_to_ebitda": f"CASE WHEN NOT b THEN {pos('CASE WHEN total_debt IS NOT NULL THEN greatest(total_debt - coalesce(total_cash, 0), 0) END', EBITDA)} END",
    "operating_leverage": f"CASE WHEN NOT b AND revenue_prior > 0 AND ebit_prior <> 0 AND abs({RM}) >= 0.01::DOUBLE THEN {EM} / {RM} END",
    "piotroski_f_score": f"CASE WHEN {TESTABLE} >= 6 THEN CAST({HELD} AS DOUBLE) END",
    "accruals": pos("net_income - ocf", "total_assets"),
    "beneish_m_score": f"CASE WHEN NOT b THEN {MSCORE} END",
    "recv_rev_divergence": RECV,
    "forward_eps_growth": f"CASE WHEN abs(trailing_eps) > 0.01::DOUBLE THEN {GROWN} END",
    "peg_ratio": f"CASE WHEN {GROWN} > 0 AND trailing_eps > 0.01::DOUBLE AND price IS NOT NULL THEN least(price / trailing_eps / ({GROWN} * 100), 50) END",
    "revenue_growth": pos("revenue - revenue_prior", "revenue_prior"),
    "revenue_cagr_3yr": "CASE WHEN revenue_3yr_ago > 0 AND revenue > 0 THEN pow(revenue / revenue_3yr_ago, 1 / 3) - 1 END",
    "sustainable_growth": f"CASE WHEN net_income > 0 AND equity > 0 THEN {clip(f'net_income / CASE WHEN equity_prior > 0 THEN (equity + equity_prior) / 2 ELSE equity END * {RET}', 0.0, 1.0)} END",
    "eps_ratio": RATIO,
    "return_12_1": pos("price_1m - price_12m", "price_12m"),
    "return_6m": pos("price_1m - price_6m", "price_6m"),
    "return_12m": pos("price - price_12m", "price_12m"),
    "price_target_upside": f"CASE WHEN n_analysts >= 3 AND price > 0 THEN {clip('(target_price - price) / price', -0.5, 1.0)} END",
    "short_interest_ratio": "CASE WHEN short_ratio >= 0 THEN short_ratio END",
    "proximity_52w_high": pos("price", "high_52w"),
    "operating_margin": f"CASE WHEN NOT b THEN {pos('ebit', 'revenue')} END",
    "current_ratio": f"CASE WHEN NOT b THEN {pos('current_assets', 'current_liabilities')} END",
    "dividend_yield": pos("dividend_rate", "price"),
    "insider_ownership": "CASE WHEN insider_held BETWEEN 0 AND 1 THEN insider_held END",
    "short_pct_float": "CASE WHEN short_float >= 0 THEN short_float END",
    "analyst_rating": "CASE WHEN rating BETWEEN 1 AND 5 THEN rating END",
    "interest_coverage": "CASE WHEN NOT b THEN ebit / nullif(abs(interest_expense), 0) END",
    "pb_ratio": f"CASE WHEN b THEN CASE WHEN price_to_book > 0 THEN price_to_book ELSE {pos('price', 'book_value')} END END",
    "roe": f"CASE WHEN b THEN coalesce(info_roe, {pos('net_income', 'equity')}) END",
    "roa": f"CASE WHEN b THEN coalesce(info_roa, {pos('net_income', 'total_assets')}) END",
    "equity_ratio": f"CASE WHEN b THEN {pos('equity', 'total_assets')} END",
    "size_log_mcap": "CASE WHEN market_cap > 0 THEN -ln(market_cap) END",
    "asset_growth": pos("total_assets - total_assets_prior", "total_assets_prior"),
}
FLAGS = {
    "beneish_flag": f"coalesce(CASE WHEN NOT b THEN {MSCORE} END > -2.22::DOUBLE, false)",
    "channel_stuffing_flag": f"coalesce({RECV} > 0.15::DOUBLE, false)",
    "eps_basis_mismatch": f"coalesce({RATIO} > 2 OR {RATIO} < 0.3::DOUBLE, false)",
}
E = f"(SELECT *, {B} AS b, CASE WHEN {GONE} OR {FAR} THEN {COMPUTED} ELSE enterprise_value END AS ev, coalesce(NOT {GONE} AND {FAR}, false) AS ev_flag FROM {V.oracle(V.FUNDAMENTALS)} v)"
SRC = f"WITH e AS {E}"


def metrics(s: SparkSession, sf: str, of: dict[str, DataFrame] | None = None) -> DataFrame:
    return M.all_metrics(V.view(s, sf, V.FUNDAMENTALS, of), NEVER_BANKS, BANK_INDUSTRIES, ("company", "sector", "series", "earner"))


def digits(name: str) -> int:
    return 2 if name == "eps_ratio" else 5


def _one(name: str):
    return lambda s, sf: metrics(s, sf).select("ticker", rounded(F.col(name), digits(name)).alias(name))


QUERIES = {
    "metrics_all": lambda s, sf: metrics(s, sf).select("ticker", "is_bank", *[rounded(F.col(m), digits(m)).alias(m) for m in SQL], *FLAGS),
    "ev_resolved": lambda s, sf: metrics(s, sf).select("ticker", rounded(F.col("ev"), 2).alias("ev"), "ev_flag"),
    "bank_like": lambda s, sf: metrics(s, sf).select("ticker", "is_bank"),
    "bank_null_mask": lambda s, sf: metrics(s, sf).groupBy("is_bank").agg(*[F.count(m).alias(m) for m in ("ev_ebitda", "ev_sales", "roic", "gross_profit_assets", "debt_equity", "pb_ratio", "roe", "roa", "equity_ratio")]),
    "eps_mismatch_list": lambda s, sf: metrics(s, sf).where("eps_basis_mismatch").select("ticker", "eps_ratio").orderBy("ticker").limit(5),
    **{f"{k}": (lambda k: lambda s, sf: metrics(s, sf).where(k).select("ticker"))(k) for k in FLAGS},
    **{m: _one(m) for m in SQL if m != "return_12m"},
}
ORACLE_SQL = {
    "metrics_all": f"{SRC} SELECT ticker, b AS is_bank, {', '.join(f'{rd(x, digits(m))} AS {m}' for m, x in SQL.items())}, {', '.join(f'{x} AS {m}' for m, x in FLAGS.items())} FROM e",
    "ev_resolved": f"{SRC} SELECT ticker, {rd('ev', 2)} AS ev, ev_flag FROM e",
    "bank_like": f"{SRC} SELECT ticker, b AS is_bank FROM e",
    "bank_null_mask": f"{SRC} SELECT b AS is_bank, {', '.join(f'count({SQL[m]}) AS {m}' for m in ('ev_ebitda', 'ev_sales', 'roic', 'gross_profit_assets', 'debt_equity', 'pb_ratio', 'roe', 'roa', 'equity_ratio'))} FROM e GROUP BY 1",
    "eps_mismatch_list": f"{SRC} SELECT ticker, {rd(RATIO, 2)} AS eps_ratio FROM e WHERE {FLAGS['eps_basis_mismatch']} ORDER BY ticker LIMIT 5",
    **{k: f"{SRC} SELECT ticker FROM e WHERE {x}" for k, x in FLAGS.items()},
    **{m: f"{SRC} SELECT ticker, {rd(x, digits(m))} AS {m} FROM e" for m, x in SQL.items() if m != "return_12m"},
}
