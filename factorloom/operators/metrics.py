"""Row-level metrics of fundamentals: column expressions only, one projection, no shuffle.

A metric is null unless its inputs are there and its guards hold; nothing is ever NaN.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import clip, rounded

FINANCIAL = ("MACHINERY",)


def c(name: str) -> Column:
    return F.col(name)


def over(a: Column, b: Column) -> Column:
    """a / b where b is positive."""
    return F.when(b > 0, a / b)


def bank_like(sector: Column, ticker: Column | None = None, financial: tuple[str, ...] = FINANCIAL, never: tuple[str, ...] = (), industry: Column | None = None, industries: tuple[str, ...] = ()) -> Column:
    """A security of a financial sector, and of a bank's industry where a list is given, that is not on the list of non-banks; both lists are short."""
    bank = F.coalesce(sector.isin(*financial), F.lit(False))
    if industry is not None and industries:
        bank = bank & F.coalesce(industry.isin(*industries), F.lit(False))
    return bank & ~ticker.isin(*never) if ticker is not None and never else bank


def ev_resolved(sector: Column, loose: float = 0.25, tight: float = 0.10) -> tuple[Column, Column]:
    """Enterprise value, and whether it was replaced: the reported one unless it is missing, 0 or far from cap + debt - cash."""
    computed = c("market_cap") + c("total_debt") - c("total_cash")
    tolerance = F.when(bank_like(sector), loose).otherwise(tight)
    reported = c("enterprise_value")
    missing = reported.isNull() | (reported == 0)
    far = (computed > 0) & (reported > 0) & ((reported / computed < 1 - tolerance) | (reported / computed > 1 + tolerance))
    ev = F.when(missing, computed).when(far, computed).otherwise(reported)
    return ev, F.coalesce(~missing & far, F.lit(False))


def roic() -> Column:
    """EBIT after tax over invested capital, at least a tenth of the assets; surplus cash up to half of all cash is left out.

    Without revenue no cash counts as needed for operations; without assets there is no floor.
    """
    rate = F.when(c("pretax_income") <= 0, 0.0).otherwise(F.coalesce(clip(c("tax_expense") / F.when(c("pretax_income") != 0, c("pretax_income")), 0.0, 0.5), F.lit(0.21)))
    operating = F.when(c("revenue") > 0, 0.02 * c("revenue")).otherwise(0.0)
    surplus = F.least(F.greatest(F.lit(0.0), c("total_cash") - operating), 0.5 * c("total_cash"))
    capital = c("equity") + c("total_debt") - F.when(c("total_cash").isNotNull(), surplus)
    floored = F.when(c("total_assets") > 0, F.when(capital.isNotNull(), F.greatest(capital, 0.1 * c("total_assets")))).otherwise(capital)
    return F.when(floored > 0, c("ebit") * (1 - rate) / floored)


def piotroski() -> tuple[Column, Column]:
    """Signals that hold, and signals that can be tested: their inputs are there and denominators are positive."""
    rate = lambda a, b: (over(c(a), c(b)), over(c(f"{a}_prior"), c(f"{b}_prior")))
    returns, debt, liquidity, margin, turnover = rate("net_income", "total_assets"), rate("lt_debt", "total_assets"), rate("current_assets", "current_liabilities"), rate("gross_profit", "revenue"), rate("revenue", "total_assets")
    signals = [
        c("net_income") > 0,
        c("ocf") > 0,
        returns[0] > returns[1],
        c("ocf") > c("net_income"),
        debt[0] < debt[1],
        liquidity[0] > liquidity[1],
        c("shares") <= c("shares_prior"),
        margin[0] > margin[1],
        turnover[0] > turnover[1],
    ]
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    return add([F.coalesce(s.cast("int"), F.lit(0)) for s in signals]), add([s.isNotNull().cast("int") for s in signals])


# Weights of the eight indices of the manipulation score, and its constant and threshold.
MANIPULATION = {"dsri": 0.920, "gmi": 0.528, "aqi": 0.404, "sgi": 0.892, "depi": 0.115, "sgai": -0.172, "tata": 4.679, "lvgi": -0.327}
MANIPULATION_BASE, MANIPULATION_LIMIT = -4.84, -2.22


def manipulation_score(least: int = 5) -> Column:
    """Eight year-on-year indices, neutral where they cannot be computed; null with fewer than ``least`` of them."""
    r, rp, a, ap = c("revenue"), c("revenue_prior"), c("total_assets"), c("total_assets_prior")
    gm, gmp = F.when(r > 0, (r - c("cost_of_revenue")) / r), F.when(rp > 0, (rp - c("cost_of_revenue_prior")) / rp)
    aq, aqp = 1 - (c("current_assets") + c("ppe")) / a, 1 - (c("current_assets_prior") + c("ppe_prior")) / ap
    d, dp = c("depreciation"), c("depreciation_prior")
    index = {
        "dsri": F.when(c("receivables_prior") > 0, (c("receivables") / r) / (c("receivables_prior") / rp)),
        "gmi": F.when(gm > 0, gmp / gm),
        "aqi": F.when(aqp != 0, aq / aqp).when(aqp == 0, F.when(aq.isNotNull(), 1.0)),
        "sgi": r / rp,
        "depi": F.when((c("ppe") + d > 0) & (c("ppe_prior") + dp > 0) & (d != 0), (dp / (c("ppe_prior") + dp)) / (d / (c("ppe") + d))),
        "sgai": F.when((r > 0) & (rp > 0) & (c("sga_prior") > 0), (c("sga") / r) / (c("sga_prior") / rp)),
        "lvgi": F.when((a > 0) & (ap > 0) & (c("lt_debt_prior") + c("current_liabilities_prior") > 0), ((c("lt_debt") + c("current_liabilities")) / a) / ((c("lt_debt_prior") + c("current_liabilities_prior")) / ap)),
        "tata": F.when(a > 0, (c("net_income") - c("ocf")) / a),
    }
    real = sum((x.isNotNull().cast("int") for x in index.values()), F.lit(0))
    score = sum((F.lit(w) * F.coalesce(index[k], F.lit(0.0 if k == "tata" else 1.0)) for k, w in MANIPULATION.items()), F.lit(MANIPULATION_BASE))
    given = (r != 0) & (rp != 0) & (a != 0) & (ap != 0)
    return F.when(given & (real >= least), score)


def all_metrics(f: DataFrame, never: tuple[str, ...] = (), industries: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """ticker, is_bank, columns to ``keep``, and the metrics; those that do not apply to banks (or to others) are null there."""
    ev, ev_flag = ev_resolved(c("sector"))
    base = f.withColumns({"is_bank": bank_like(c("sector"), c("ticker"), never=never, industry=c("industry"), industries=industries), "ev": ev, "ev_flag": ev_flag})
    other = ~c("is_bank")
    built = F.when(c("da") >= 0, c("ebit") + c("da")).otherwise(c("ebitda"))
    ebitda = F.coalesce(built, c("ebitda"))
    held, testable = piotroski()
    dividends = F.coalesce(F.abs("dividends_paid"), F.abs(c("dividend_rate") * c("shares")))
    retention = F.greatest(F.lit(0.0), F.when(c("payout_ratio").between(0, 2), 1 - c("payout_ratio")).when(dividends.isNotNull() & (c("net_income") > 0), 1 - dividends / c("net_income")))
    growth = c("forward_eps") - c("trailing_eps")
    fwd = F.when(F.abs("trailing_eps") > 0.01, clip(growth / F.greatest(F.abs("trailing_eps"), F.lit(1.0)), -0.75, 1.5))
    rev_move, ebit_move = (c("revenue") - c("revenue_prior")) / F.abs("revenue_prior"), (c("ebit") - c("ebit_prior")) / F.abs("ebit_prior")
    score = manipulation_score()
    recv = F.when((c("receivables_prior") > 0) & (c("revenue_prior") > 0), (c("receivables") - c("receivables_prior")) / c("receivables_prior") - (c("revenue") - c("revenue_prior")) / c("revenue_prior"))
    eps_ratio = F.when(F.abs("trailing_eps") > 0.1, c("forward_eps") / c("trailing_eps"))
    return base.select(
        "ticker",
        "is_bank",
        *keep,
        "ev",
        "ev_flag",
        F.when(other & (c("ev") > 0) & (ebitda > 0), c("ev") / ebitda).alias("ev_ebitda"),
        over(c("ocf") - F.abs("capex"), c("ev")).alias("fcf_yield"),
        F.coalesce(over(c("net_income"), c("market_cap")), over(c("trailing_eps"), c("price"))).alias("earnings_yield"),
        F.when(other & (c("ev") > 0), over(c("ev"), c("revenue"))).alias("ev_sales"),
        F.when(other, roic()).alias("roic"),
        F.when(other, over(c("gross_profit"), c("total_assets"))).alias("gross_profit_assets"),
        F.when(other, over(c("total_debt"), c("equity"))).alias("debt_equity"),
        F.when(other, over(F.when(c("total_debt").isNotNull(), F.greatest(c("total_debt") - F.coalesce("total_cash", F.lit(0.0)), F.lit(0.0))), ebitda)).alias("net_debt_to_ebitda"),
        F.when(other & (c("revenue_prior") > 0) & (c("ebit_prior") != 0) & (F.abs(rev_move) >= 0.01), ebit_move / rev_move).alias("operating_leverage"),
        F.when(testable >= 6, held.cast("double")).alias("piotroski_f_score"),
        over(c("net_income") - c("ocf"), c("total_assets")).alias("accruals"),
        F.when(other, score).alias("beneish_m_score"),
        F.coalesce(F.when(other, score) > MANIPULATION_LIMIT, F.lit(False)).alias("beneish_flag"),
        recv.alias("recv_rev_divergence"),
        F.coalesce(recv > 0.15, F.lit(False)).alias("channel_stuffing_flag"),
        fwd.alias("forward_eps_growth"),
        F.when((fwd > 0) & (c("trailing_eps") > 0.01) & c("price").isNotNull(), F.least(c("price") / c("trailing_eps") / (fwd * 100), F.lit(50.0))).alias("peg_ratio"),
        over(c("revenue") - c("revenue_prior"), c("revenue_prior")).alias("revenue_growth"),
        F.when((c("revenue_3yr_ago") > 0) & (c("revenue") > 0), F.pow(c("revenue") / c("revenue_3yr_ago"), F.lit(1 / 3)) - 1).alias("revenue_cagr_3yr"),
        F.when((c("net_income") > 0) & (c("equity") > 0), clip(c("net_income") / F.when(c("equity_prior") > 0, (c("equity") + c("equity_prior")) / 2).otherwise(c("equity")) * retention, 0.0, 1.0)).alias("sustainable_growth"),
        rounded(eps_ratio, 2).alias("eps_ratio"),
        F.coalesce((eps_ratio > 2) | (eps_ratio < 0.3), F.lit(False)).alias("eps_basis_mismatch"),
        over(c("price_1m") - c("price_12m"), c("price_12m")).alias("return_12_1"),
        over(c("price_1m") - c("price_6m"), c("price_6m")).alias("return_6m"),
        over(c("price") - c("price_12m"), c("price_12m")).alias("return_12m"),
        F.when((c("n_analysts") >= 3) & (c("price") > 0), clip((c("target_price") - c("price")) / c("price"), -0.5, 1.0)).alias("price_target_upside"),
        F.when(c("short_ratio") >= 0, c("short_ratio")).alias("short_interest_ratio"),
        over(c("price"), c("high_52w")).alias("proximity_52w_high"),
        F.when(other, over(c("ebit"), c("revenue"))).alias("operating_margin"),
        F.when(other, over(c("current_assets"), c("current_liabilities"))).alias("current_ratio"),
        over(c("dividend_rate"), c("price")).alias("dividend_yield"),
        F.when(c("insider_held").between(0, 1), c("insider_held")).alias("insider_ownership"),
        F.when(c("short_float") >= 0, c("short_float")).alias("short_pct_float"),
        F.when(c("rating").between(1, 5), c("rating")).alias("analyst_rating"),
        F.when(other, F.when(c("interest_expense") != 0, c("ebit") / F.abs("interest_expense"))).alias("interest_coverage"),
        F.when(c("is_bank"), F.when(c("price_to_book") > 0, c("price_to_book")).otherwise(over(c("price"), c("book_value")))).alias("pb_ratio"),
        F.when(c("is_bank"), F.coalesce(c("info_roe"), over(c("net_income"), c("equity")))).alias("roe"),
        F.when(c("is_bank"), F.coalesce(c("info_roa"), over(c("net_income"), c("total_assets")))).alias("roa"),
        F.when(c("is_bank"), over(c("equity"), c("total_assets"))).alias("equity_ratio"),
        F.when(c("market_cap") > 0, -F.log("market_cap")).alias("size_log_mcap"),
        over(c("total_assets") - c("total_assets_prior"), c("total_assets_prior")).alias("asset_growth"),
    )


def provenance(metrics: DataFrame, names: Sequence[str], sources: DataFrame, partial: DataFrame, targets: DataFrame) -> DataFrame:
    """How many of ``names`` a security has, whether its income statement is quarterly or annual (else unknown), whether a sum of it was scaled up, and its price targets as they come.

    sources(ticker, source), partial(ticker, annualized), targets(ticker, ...).
    """
    present = sum((F.col(m).isNotNull().cast("int") for m in names), F.lit(0))
    out = metrics.select("ticker", present.alias("present"), F.lit(len(names)).alias("total")).join(sources, "ticker", "left").join(partial, "ticker", "left").join(targets, "ticker", "left")
    return out.withColumns({"source": F.coalesce("source", F.lit("unknown")), "annualized": F.coalesce("annualized", F.lit(False))})
