"""Statements, tables and row-level metrics on hand-made rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factorloom.operators import diagnostics, metrics, proposals, reports, statements, tables
from factorloom.sources import views


def lines(spark, values, label="Total Revenue"):
    rows = [("A", "income", "Q", 1, label, f"20{20 + i // 4}-{3 * (i % 4) + 1:02d}-01", v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "ticker string, statement string, freq string, line_no int, label string, period_end string, value double")
    return df.withColumn("period_end", F.to_date("period_end"))


def test_ltm_needs_four_or_scales_three(spark):
    full = statements.ltm(lines(spark, [1.0, 2.0, 3.0, 4.0, 5.0])).first()
    assert (full.ltm, full.partial) == (14.0, False)
    three = statements.ltm(lines(spark, [3.0, None, 3.0, 3.0])).first()
    assert (three.ltm, three.partial) == (12.0, True)
    assert statements.ltm(lines(spark, [1.0, 2.0])).first().ltm is None
    assert statements.ltm(lines(spark, [float(i) for i in range(8)]), 4).first().ltm == 6.0


def test_kth_value_skips_nulls(spark):
    df = lines(spark, [1.0, None, 3.0, None])
    assert statements.value_at(df, 0).first().value == 3.0
    assert statements.value_at(df, 1).first().value == 1.0
    assert statements.value_at(df, 2).first() is None


def test_labels_equal_before_suffix(spark):
    df = lines(spark, [1.0], "Operating Revenue").unionByName(lines(spark, [1.0], "revenue"))
    assert statements.label_match(df, ["Revenue"]).first().label == "revenue"
    assert statements.label_match(df, ["operating"]).first().label == "Operating Revenue"
    assert statements.label_match(df, ["none"]).first() is None


def test_upsert_replaces_failures_only(spark):
    cols = "ticker string, error string, market_cap double"
    first = spark.createDataFrame([("A", "x", None), ("B", None, 1.0), ("C", "x", None)], cols)
    second = spark.createDataFrame([("A", None, 5.0), ("B", None, 9.0)], cols)
    got = {r.ticker: (r.error, r.market_cap) for r in tables.refresh_upsert(first, second).collect()}
    assert got == {"A": (None, 5.0), "B": (None, 1.0), "C": ("x", None)}


def test_subset_makes_unknown_rows_only_if_none_is_found(spark):
    df = spark.createDataFrame([("A", "a", "s")], "ticker string, company string, sector string")
    assert [tuple(r) for r in tables.subset(df, ["A", "Z"]).collect()] == [("A", "a", "s")]
    assert [tuple(r) for r in tables.subset(df, ["Z"]).collect()] == [("Z", "Z", "Unknown")]


NAMES = sorted(set(views.re.findall(r" AS (\w+)[,\n ]", views.FUNDAMENTALS.split("AS ticker")[1].split("FROM {customer}")[0])) | {"acctbal"})


def record(spark, **over):
    numbers = dict.fromkeys([n for n in NAMES if n.islower()], 100.0)
    numbers |= {"revenue": 1000.0, "revenue_prior": 900.0, "total_assets": 2000.0, "total_assets_prior": 1900.0, "market_cap": 5000.0, "total_debt": 500.0, "total_cash": 200.0, "enterprise_value": 5300.0, "ebit": 150.0, "da": 50.0, "capex": -40.0, "ocf": 180.0, "equity": 800.0}
    for k in ("ticker", "company", "sector", "industry", "revenue_3yr_ago"):
        numbers.pop(k, None)
    row = {"ticker": "A", "sector": "BUILDING", "revenue_3yr_ago": 800.0} | numbers | over
    kinds = ", ".join(f"{k} {'string' if k in ('ticker', 'sector') else 'double'}" for k in row)
    return metrics.all_metrics(spark.createDataFrame([tuple(row.values())], kinds)).first()


def test_metric_formulas(spark):
    m = record(spark)
    assert m.ev == 5300.0 and not m.ev_flag
    assert m.ev_ebitda == pytest.approx(5300 / 200) and m.fcf_yield == pytest.approx(140 / 5300)
    assert m.revenue_growth == pytest.approx(100 / 900) and m.operating_margin == pytest.approx(0.15)
    assert m.pb_ratio is None and m.roe is None


def test_metric_guards(spark):
    assert record(spark, enterprise_value=9000.0).ev == 5300.0
    assert record(spark, enterprise_value=9000.0).ev_flag
    assert record(spark, enterprise_value=None, total_cash=None).ev is None
    bank = record(spark, sector="MACHINERY", price_to_book=1.5)
    assert bank.pb_ratio == 1.5 and bank.ev_ebitda is None and bank.roic is None
    assert record(spark, n_analysts=2.0).price_target_upside is None
    assert record(spark, rating=7.0).analyst_rating is None


def test_proposals_stay_in_bounds(spark):
    rows = [("a", 0.1, 40.0, 20.0, 60.0), ("b", -0.1, 35.0, 10.0, 50.0), ("c", 0.02, 25.0, 10.0, 40.0)]
    got = proposals.propose(spark.createDataFrame(rows, "category string, ic double, weight double, low double, high double")).collect()
    assert round(sum(r.proposed for r in got), 6) == 100
    assert all(abs(r.change) <= 5 for r in got) and {r.direction for r in got} <= {"up", "down", "same"}


LINES = "ticker string, statement string, freq string, line_no int, label string, period_end string, value double"


def quarter(ticker, label, values, statement="income", freq="Q"):
    return [(ticker, statement, freq, 1, label, f"{2001 - i // 4}-{12 - 3 * (i % 4):02d}-28" if freq == "Q" else f"{2001 - i}-12-31", v) for i, v in enumerate(values)]


def test_misses_by_four_reasons(spark):
    rows = quarter("A", "Total Revenue", [1.0, 2.0, 3.0]) + quarter("B", "total revenue ", [1.0, None, 3.0]) + quarter("B", "EBIT", [1.0] * 4) + quarter("A", "Cash", [5.0], "balance", "A")
    wanted = statements.requests(spark, [("income", "Q", "Total Revenue", None), ("income", "Q", "EBIT", None), ("balance", "A", "Cash", 1), ("income", "Q", "ebit", 3)])
    got = statements.misses(spark.createDataFrame(rows, LINES), spark.createDataFrame([("A",), ("B",), ("C",)], "ticker string"), wanted)
    assert {(r.label, r.reason, r.n) for r in got.collect()} == {
        ("Total Revenue", "empty statement", 1), ("Total Revenue", "insufficient quarters", 1), ("EBIT", "empty statement", 1), ("EBIT", "label not found", 1),
        ("Cash", "out of range", 1), ("Cash", "empty statement", 2), ("ebit", "empty statement", 1), ("ebit", "label not found", 1),
    }


def test_balances_of_quarters_or_years(spark):
    rows = quarter("A", "Assets", [9.0, 8.0, 7.0, 6.0, 5.0], "balance") + quarter("A", "Assets", [90.0, 80.0], "balance", "A") + quarter("B", "Assets", [4.0, None, 3.0], "balance") + quarter("C", "Assets", [30.0, 20.0], "balance", "A")
    rows += quarter("A", "Debt", [1.0, None, 2.0], "balance")
    got = {(r.ticker, r.label): (r.source, r.latest, r.prior) for r in statements.mrq_balance(spark.createDataFrame(rows, LINES)).collect()}
    assert got == {("A", "Assets"): ("quarterly", 9.0, 5.0), ("A", "Debt"): ("quarterly", 1.0, None), ("B", "Assets"): ("quarterly", 4.0, 3.0), ("C", "Assets"): ("annual", 30.0, 20.0)}


def test_blocks_come_from_one_source(spark):
    decisive = {"income": ("Revenue", "EBIT"), "cashflow": ("Flow",)}
    rows = quarter("A", "EBIT", [1.0] * 4) + quarter("A", "Revenue", [50.0, 40.0], "income", "A") + quarter("A", "Flow", [7.0, 6.0], "cashflow", "A") + quarter("A", "Capex", [1.0] * 4, "cashflow")
    rows += quarter("B", "Revenue", [1.0, 1.0]) + quarter("B", "Tax", [1.0] * 4) + quarter("B", "Revenue", [9.0], "income", "A")
    got = {(r.ticker, r.statement, r.label): (r.value, r.source) for r in statements.source_blocks(spark.createDataFrame(rows, LINES), decisive).collect()}
    assert got == {("A", "income", "EBIT"): (4.0, "quarterly"), ("A", "cashflow", "Flow"): (7.0, "annual"), ("B", "income", "Revenue"): (9.0, "annual")}


def test_four_recomputations(spark):
    scored = spark.createDataFrame([("A", 10.0, 0.05, 0.1, 1.0), ("B", None, 0.05, None, None)], "ticker string, ev_ebitda double, earnings_yield double, forward_eps_growth double, beta double")
    raw = spark.createDataFrame([("A", 104.0, 10.0, 1.0, 1.2, 10.0), ("B", 50.0, 5.0, 0.5, 0.0, 10.0)], "ticker string, enterprise_value double, ebitda double, trailing_eps double, forward_eps double, price double")
    got = {(r.ticker, r.check): (r.scored, round(r.anew, 6)) for r in diagnostics.recomputed(scored, raw, spark.createDataFrame([("A", 1.2), ("B", 1.0)], "ticker string, beta double")).collect()}
    assert got == {("A", "earnings_yield"): (0.05, 0.1), ("A", "forward_eps_growth"): (0.1, 0.2), ("A", "beta"): (1.0, 1.2), ("B", "ev_ebitda"): (None, 10.0)}


def test_bands_and_fields(spark):
    rows = spark.createDataFrame([("a", 5.0), ("b", -10.0), ("c", 10.5), ("d", None)], "item string, value double")
    assert {r.item: r.band for r in reports.summary_bands({"sector_delta": rows}).collect()} == {"a": "near", "b": "off", "c": "far", "d": None}
    out = tables.enrich(spark.createDataFrame([("A", 1)], "ticker string, _x int"), spark.createDataFrame([("A", 2, 3)], "ticker string, x int, y int"), {"x": "_x", "y": "_y", "z": "_z"})
    assert out.first().asDict() == {"ticker": "A", "_x": 1, "_y": 3}


def test_candidates_come_in_and_others_go_down(spark):
    rows = [("q", "new", 0.0, 0.05, 12, 0, 80.0), ("q", "other", 0.0, 0.09, 12, 0, 80.0), ("q", "old", 20.0, -0.01, 0, 12, 20.0), ("q", "kept", 20.0, -0.01, 0, 3, 20.0), ("r", "new2", 0.0, 0.03, 12, 0, 80.0)]
    df = spark.createDataFrame(rows, "category string, metric string, weight double, ewm double, positive_run int, negative_run int, positive_pct double")
    got = {(r.metric, r.action, r.new_weight) for r in proposals.metric_evolution(df, candidates=["new", "new2"]).collect()}
    assert got == {("new", "activate", 5.0), ("old", "lower", 15.0)}


def test_views_of_a_few_securities_read_their_rows_only(spark):
    from pyspark.sql import functions as F

    from factorloom.sources import views

    sf = "/root/testdata/sf0.001"
    some = views.base(spark, sf, "customer").orderBy("c_custkey").limit(3).select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"))
    of = views.of_securities(spark, sf, some)
    assert of["customer"].count() == 3 and of["lineitem"].count() < views.base(spark, sf, "lineitem").count()
    key = [r.ticker for r in some.collect()]
    for text in (views.FUNDAMENTALS, views.STATEMENT_LINES, views.ANNUAL_LINES):
        mine, all_ = views.view(spark, sf, text, of), views.view(spark, sf, text)
        assert sorted(map(str, mine.collect())) == sorted(map(str, all_.where(F.col("ticker").isin(key)).collect()))
