"""Literal cases of metrics, ranks, regressions, returns and weight changes."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.functions.ranks import average_pct, counted, placed, quantiles
from factorloom.operators import assembly, backtest, exposure, metrics, prices, proposals, runs, statements

FIELDS = """market_cap enterprise_value total_debt total_cash revenue revenue_prior revenue_3yr_ago gross_profit gross_profit_prior cost_of_revenue cost_of_revenue_prior
ebit ebit_prior ebitda da net_income net_income_prior tax_expense pretax_income total_assets total_assets_prior equity equity_prior lt_debt lt_debt_prior current_liabilities
current_liabilities_prior current_assets current_assets_prior receivables receivables_prior ppe ppe_prior depreciation depreciation_prior sga sga_prior shares shares_prior ocf capex
dividends_paid trailing_eps forward_eps price price_1m price_6m price_12m high_52w payout_ratio dividend_rate price_to_book book_value info_roe info_roa target_price n_analysts
short_ratio insider_held short_float rating interest_expense""".split()


def one(spark, **values):
    row = ("T", "BUILDING", "x", *[float(values[f]) if f in values else None for f in FIELDS])
    df = spark.createDataFrame([row], "ticker string, sector string, industry string, " + ", ".join(f"{f} double" for f in FIELDS))
    return metrics.all_metrics(df).first()


def test_roic_without_revenue_or_assets(spark):
    base = {"ebit": 100, "pretax_income": 100, "tax_expense": 20, "equity": 500, "total_debt": 200, "total_cash": 100}
    assert one(spark, **base).roic == pytest.approx(80 / (700 - 50))
    assert one(spark, **base, revenue=1000, total_assets=20_000).roic == pytest.approx(80 / 2000)
    assert one(spark, **(base | {"pretax_income": -5})).roic == pytest.approx(100 / 650)


def test_f_score_signals(spark):
    same = {"net_income": 10, "net_income_prior": 10, "total_assets": 100, "total_assets_prior": 100, "ocf": 12, "lt_debt": 0, "lt_debt_prior": 0, "current_assets": 5, "current_assets_prior": 5, "current_liabilities": 4, "current_liabilities_prior": 4, "shares": 9, "shares_prior": 9, "gross_profit": 3, "gross_profit_prior": 3, "revenue": 50, "revenue_prior": 50}
    assert one(spark, **same).piotroski_f_score == 4.0  # income, cash flow, cash over income, shares: equal debt is no gain
    assert one(spark, **(same | {"lt_debt_prior": 1})).piotroski_f_score == 5.0
    assert one(spark, **(same | {"total_assets": 0, "revenue": 0, "current_liabilities": 0})).piotroski_f_score is None


def test_multiples(spark):
    assert one(spark, total_debt=50, total_cash=10, ebit=15, da=5, ebitda=100).net_debt_to_ebitda == 2.0
    assert one(spark, total_debt=50, total_cash=10, ebit=15, ebitda=100).net_debt_to_ebitda == pytest.approx(0.4)
    assert one(spark, net_income=5, market_cap=0, trailing_eps=2, price=40).earnings_yield == 0.05
    assert one(spark, net_income=5, market_cap=100, trailing_eps=2, price=40).earnings_yield == 0.05
    assert one(spark, price=30, trailing_eps=0.5, forward_eps=1.0).peg_ratio == pytest.approx(60 / 50)
    assert one(spark, price=30, trailing_eps=1.0, forward_eps=9.0).peg_ratio == pytest.approx(30 / 150)
    grown = {"revenue": 110, "ebit": 12, "ebit_prior": 10}
    assert one(spark, **grown, revenue_prior=100).operating_leverage == pytest.approx(2.0)
    assert one(spark, **grown, revenue_prior=-100).operating_leverage is None


def test_retention_falls_back_to_the_dividend_rate(spark):
    base = {"net_income": 100, "equity": 400, "equity_prior": 600, "dividend_rate": 2, "shares": 10}
    assert one(spark, **base).sustainable_growth == pytest.approx(100 / 500 * 0.8)
    assert one(spark, **base, dividends_paid=-50).sustainable_growth == pytest.approx(0.1)
    assert one(spark, **base, payout_ratio=1.5).sustainable_growth == 0.0


def test_last_quarters_are_numbered_before_bad_ones_go(spark):
    rows = [("A", f"2020-{m:02d}-01", a, e) for m, a, e in ((1, 9.0, 1.0), (4, 1.2, 1.0), (7, None, 1.0), (10, 1.1, 1.0), (12, 1.4, 0.0))]
    df = spark.createDataFrame(rows, "ticker string, quarter string, eps_actual double, eps_estimate double")
    got = assembly.revision_metrics(df).first()
    assert got.analyst_surprise == pytest.approx(0.15) and got.earnings_acceleration == pytest.approx(-0.1) and got.consecutive_beat_streak == 3.0
    assert prices.beat_score(df).first().beat_score == 3


def test_risk_metrics_are_those_of_prices(spark):
    rng = random.Random(9)
    days = pd.date_range("2020-01-01", periods=260)
    rows = [(t, d.date(), rng.gauss(0, 0.02)) for t in "ab" for d in days if t == "a" or rng.random() < 0.9]
    market = spark.createDataFrame([(d.date(), rng.gauss(0, 0.01)) for d in days], "dt date, ret double")
    rets = spark.createDataFrame(rows, "ticker string, dt date, ret double")
    got = {r.ticker: r for r in assembly.risk_metrics(rets, market).collect()}
    for df, mine, theirs in ((prices.annualised_vol(rets), "volatility", "volatility"), (prices.beta(rets, market), "beta", "beta"), (prices.sortino_inputs(rets), "downside", "downside"), (prices.max_drawdown(rets), "max_drawdown_1y", "max_drawdown")):
        for r in df.collect():
            assert got[r.ticker][mine] == pytest.approx(r[theirs])


def test_placed_ranks_and_quantiles(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["x", "y", None]), None if rng.random() < 0.1 else float(rng.randint(0, 40))) for _ in range(700)]
    df = spark.createDataFrame(rows, "g string, value double")
    at = placed(counted(df, ["g"]), ["g"])
    got = {(r.g, r.value): r.pct for r in at.withColumn("pct", average_pct()).collect()}
    cut = {r.g: r for r in quantiles(at, {"q30": 0.3, "top": (F.col("value") > -1, 1.0)}, ["g"]).collect()}
    data = pd.DataFrame(rows, columns=["g", "value"]).dropna(subset=["value"])
    for g, part in data.groupby("g", dropna=False):
        g = None if pd.isna(g) else g
        assert {v: got[g, v] for v in part.value} == pytest.approx(dict(zip(part.value, part.value.rank(pct=True) * 100, strict=True)))
        assert cut[g].q30 == pytest.approx(part.value.quantile(0.3)) and cut[g].top == part.value.max()


def test_factor_regression_is_least_squares(spark):
    rng = np.random.default_rng(1)
    n, names = 300, ["Mkt-RF", "SMB", "HML", "RMW", "CMA"]
    x = rng.normal(size=(n, 5))
    y = 0.001 + x @ np.array([1.0, -0.5, 0.2, 0, 0.3]) * 0.01 + rng.normal(size=n) * 0.002
    dates = [d.date() for d in pd.date_range("2020-01-01", periods=n)]
    five = spark.createDataFrame([(d, *[float(v) for v in r], 0.0) for d, r in zip(dates, x, strict=True)], "dt date, `Mkt-RF ` double, ` SMB` double, HML double, RMW double, CMA double, RF double")
    momentum = spark.createDataFrame([(d, float(v)) for d, v in zip(dates[:-10], rng.normal(size=n - 10), strict=True)], "dt date, `Mom ` double")
    factors = exposure.factor_returns(five, momentum)
    assert factors.columns == ["dt", *names, "RF", "UMD"] and factors.count() == n - 10
    portfolio = spark.createDataFrame([(d, float(v)) for d, v in zip(dates, y, strict=True)], "dt date, ret double")
    got = exposure.factor_regression(portfolio, factors)
    f = factors.orderBy("dt").toPandas()
    a = np.column_stack([f[[*names, "UMD"]].to_numpy(), np.ones(len(f))])
    want, *_ = np.linalg.lstsq(a, y[: n - 10], rcond=None)
    rows = {r.factor: r for r in got.collect()}
    assert [rows[k].coefficient for k in [*names, "UMD", "const"]] == pytest.approx(want.tolist(), rel=1e-6, abs=1e-9)
    rest = y[: n - 10] - a @ want
    error = np.sqrt(np.diag(np.linalg.inv(a.T @ a)) * (rest @ rest) / (len(f) - 7))
    assert rows["const"].std_error == pytest.approx(error[-1], rel=1e-6) and rows["const"].r2 == pytest.approx(1 - (rest @ rest) / ((y[: n - 10] - y[: n - 10].mean()) ** 2).sum(), rel=1e-6)
    alpha = exposure.annualised_alpha(got).first()
    assert alpha.alpha_pct == pytest.approx(want[-1] * 25200) and alpha.significance == "***"
    assert exposure.factor_regression(portfolio.limit(10), factors).count() == 0


def test_regressions_of_many_keys_and_dependent_factors(spark):
    """Against the shortest least-squares solution, key by key; HML is twice SMB less the market, and CMA does not move."""
    rng = np.random.default_rng(5)
    rows, want = [], {}
    dates = [d.date() for d in pd.date_range("2020-01-01", periods=60)]
    x = rng.normal(size=(60, 2)) * 0.01 + 5
    f = np.column_stack([x, 2 * x[:, 1] - x[:, 0], np.full(60, 0.3)])
    factors = spark.createDataFrame([(d, *[float(v) for v in r], 0.001) for d, r in zip(dates, f, strict=True)], "dt date, `Mkt-RF` double, SMB double, HML double, CMA double, RF double")
    for key in range(40):
        y, n = rng.normal(size=60), 29 + key % 3
        rows += [(key, None if key % 5 == 0 else "w", d, float(v)) for d, v in zip(dates[:n], y, strict=False)] + [(key, "w", dates[59], None)]
        if n >= 30:
            centred = f[:n] - f[:n].mean(axis=0)
            unit = centred / np.where((s := np.sqrt((centred**2).sum(axis=0))) > 0, s, 1)
            b = np.linalg.lstsq(unit, y[:n] - y[:n].mean(), rcond=1e-8)[0]
            want[key] = 1 - ((y[:n] - y[:n].mean() - unit @ b) ** 2).sum() / ((y[:n] - y[:n].mean()) ** 2).sum()
    df = spark.createDataFrame(rows, "key int, part string, dt date, ret double")
    got = exposure.factor_regression(df, factors, keys=["key", "part"]).toPandas()
    assert set(got["key"]) == set(want) and len(got) == 5 * len(want)
    for key, part in got.groupby("key"):
        assert part["r2"].iloc[0] == pytest.approx(want[key], rel=1e-5)
        b = part.set_index("factor")["coefficient"]
        n = int(part["n"].iloc[0])
        fitted = b["const"] + f[:n] @ b[["Mkt-RF", "SMB", "HML", "CMA"]].to_numpy()
        assert np.isfinite(fitted).all() and b["CMA"] == 0
    whole = exposure.factor_regression(df.where("key = 1").drop("key", "part"), factors, names=["SMB"])
    assert whole.count() == 2 and whole.columns[0] == "factor"


def test_chance_of_t_values():
    """Fixed values from tables of the t distribution."""
    table = [(12.706, 1, 0.05), (2.228, 10, 0.05), (3.169, 10, 0.01), (1.812, 10, 0.10), (2.042, 30, 0.05), (2.576, 1_000_000, 0.01), (0.0, 5, 1.0), (1.0, 1, 0.5)]
    got = exposure.two_sided_p(np.array([t for t, _, _ in table]), np.array([float(d) for _, d, _ in table]))
    assert got.tolist() == pytest.approx([p for _, _, p in table], rel=2e-3)


def test_redistribution(spark):
    w = spark.createDataFrame([("q", "a", 50.0), ("q", "b", 30.0), ("q", "c", 20.0), ("q", "new", 0.0), ("r", "z", 100.0)], "category string, metric string, weight double")
    ch = "category string, metric string, action string, weight double, new_weight double"
    up = spark.createDataFrame([("q", "new", "activate", 0.0, 5.0)], ch)
    assert {r.metric: r.new_weight for r in proposals.redistribute(w, up).collect()} == {"a": 47.5, "b": 28.5, "c": 19.0, "new": 5.0}
    down = spark.createDataFrame([("q", "a", "lower", 50.0, 45.0)], ch)
    assert {r.metric: r.new_weight for r in proposals.redistribute(w, down).collect()} == {"a": 45.0, "b": 33.0, "c": 22.0, "new": 0.0}


def test_net_returns_and_turnover(spark):
    assigned = spark.createDataFrame([(m, t, 1) for m, ts in ((1, "ab"), (2, "bc"), (3, "bc"), (4, "cd")) for t in ts], "as_of int, ticker string, decile int")
    forward = spark.createDataFrame([(m, t, 0.1) for m in (1, 2, 4) for t in "abcd"], "month_end int, ticker string, fwd double")
    costs = backtest.turnover_cost(assigned, forward)
    assert {r.as_of: r.turnover for r in costs.collect()} == {1: 1.0, 2: 1.0, 4: 1.0}  # month 3 has no return: month 4 is held against month 2
    net = {r.as_of: r.ret for r in backtest.net_returns(backtest.decile_returns(assigned, forward), costs).collect()}
    assert net == pytest.approx({1: 0.099, 2: 0.099, 3: 0.0, 4: 0.099})


def test_runs(spark, tmp_path):
    assert runs.config_hash({"factor_weights": {"b": 1, "a": 2}}) == runs.config_hash({"factor_weights": {"a": 2, "b": 1}, "other": 3})
    df = spark.createDataFrame([("A", 1.5, None), ("B", None, "x,y")], "ticker string, v double, note string")
    runs.write_csv_with_notes(df, str(tmp_path / "csv"), ["a note"])
    got = runs.read_csv_with_notes(spark, str(tmp_path / "csv"), "ticker string, v double, note string")
    assert sorted(map(tuple, got.collect())) == [("A", 1.5, None), ("B", None, "x,y")]
    lines = spark.createDataFrame([("T", "balance", "A", i, label, d, v) for i, (label, d, v) in enumerate([("Receivables", "2020", 1.0), ("Net Receivable", "2019", 2.0), ("Receivables", "2019", 3.0)])], "ticker string, statement string, freq string, line_no int, label string, period_end string, value double")
    row = statements.current_and_prior(lines, {"rec": ("Net Receivable", "Receivables")}).first()
    assert (row.rec, row.rec_prior) == (2.0, 3.0)  # each of the two by the first label that has it
