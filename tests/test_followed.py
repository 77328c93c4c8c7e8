"""Months on the series that securities follow: nothing is made, stored or put in order for each security and month that need not be."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from factorloom.functions import ranks
from factorloom.operators import backtest as B
from factorloom.operators import scoring as S


@pytest.fixture
def kept_rows(monkeypatch):
    """Rows of each table that an operator stores."""
    sizes: dict[str, int] = {}
    for module in (ranks, B, S):
        plain = module.stored

        def counting(df, name="table", plain=plain):
            table = plain(df, name)
            sizes[name] = max(sizes.get(name, 0), table.count())
            return table

        monkeypatch.setattr(module, "stored", counting)
    return sizes


def test_deciles_store_scores_not_rows(spark, kept_rows):
    rng = random.Random(3)
    rows = [(m, f"T{i}", float(rng.randint(0, 40)) if i % 50 else None) for m in (1, 2, 3) for i in range(2000)]
    rows += [(4, f"T{i}", 7.0) for i in range(25)] + [(5, f"T{i}", 1.0) for i in range(19)]
    got = {(r.as_of, r.ticker): r.decile for r in B.deciles(spark.createDataFrame(rows, "as_of int, ticker string, score double")).collect()}
    want = {}
    for m in (1, 2, 3, 4):
        order = sorted((s, t) for a, t, s in rows if a == m and s is not None)
        for k, (_, t) in enumerate(order):
            x = (k + 1) / len(order) * 10
            want[m, t] = max(1, min(10, int(x) + (x > int(x))))
    assert got == want
    assert max(kept_rows.values()) < 3000  # rows of scores at the cuts, of 6,000 rows


def test_turnover_of_a_ticker_that_comes_back(spark):
    rows = [(1, "a", 1, 0.1), (1, "b", 1, 0.1), (2, "b", 1, 0.1), (2, "c", 1, None), (3, "a", 1, 0.1), (3, "c", 1, 0.2), (2, "a", 2, 0.3)]
    got = {(r.decile, r.as_of): r.turnover for r in B.turnover_cost(spark.createDataFrame(rows, "as_of int, ticker string, decile int, fwd double")).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 1.0, (1, 3): 1.0, (2, 2): 1.0}
    assert B.turnover_cost(spark.createDataFrame([(1, "a", 1, None)], "as_of int, ticker string, decile int, fwd double")).count() == 0


def test_shared_metrics_rank_like_each_security(spark, kept_rows):
    rng = random.Random(5)
    names = [(f"T{i}", rng.choice(["x", "y", None, "few"] if i < 30 else ["x", "y", None]), i % 4 == 0, f"E{i % 40}") for i in range(900)]
    dynamic = [(m, f"E{e}", rng.choice([None, float("nan"), *map(float, range(25))]), rng.random()) for m in (1, 2) for e in range(38) if (m, e) != (2, 7)]
    dimension = spark.createDataFrame([("p", "risk", True, 60.0, 20.0), ("q", "risk", False, 40.0, 80.0)], "metric string, category string, higher boolean, generic double, bank double")
    people, series = spark.createDataFrame(names, "ticker string, sector string, is_bank boolean, earner string"), spark.createDataFrame(dynamic, "as_of int, earner string, p double, q double")
    at, sectors = B.followed_ranks(series, people, ["p", "q"], dimension, "as_of", "earner")
    got = {(r.as_of, r.ticker, r.metric): r.pct for r in people.join(at, "earner").select("as_of", "ticker", "metric", B.of_sector(F.col("pct"), sectors).alias("pct")).collect()}
    sizes = dict(kept_rows)
    tall = S.with_dimension(S.to_tall(people.join(series, "earner"), ["p", "q"], keys=["as_of"]), dimension)
    want = {(r.as_of, r.ticker, r.metric): r.pct for r in S.cleaned_ranks(tall, keys=["as_of"]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert max(sizes.values(), default=0) < 900  # no row for each follower


def test_coefficients_of_followed_series(spark):
    rng = random.Random(7)
    names = [(f"T{i}", f"P{i % 12}") for i in range(240)]
    still = [(t, g, "s", rng.choice([None, 1.0, 2.0, 3.0, rng.random()])) for t, g in names]
    moving = [(m, t, g, "m", float(rng.randint(0, 9))) for m in (1, 2, 3, 4) for t, g in names]
    after = [(m, h, f"P{g}", None if (m, g) == (2, 3) else rng.choice([0.1, rng.random()])) for m in (1, 2, 3) for h in ("a", "b") for g in range(12) if (h, g) != ("b", 5)] + [(4, "a", f"P{g}", 0.5) for g in range(12)]
    fwd = spark.createDataFrame(after, "as_of int, horizon string, series string, fwd double")
    s = spark.createDataFrame(still, "ticker string, series string, name string, value double")
    m = spark.createDataFrame(moving, "as_of int, ticker string, series string, name string, value double")
    by = ["as_of", "horizon"]
    got = {(r.as_of, r.horizon, r.factor): (r.n, r.ic) for r in B.ic_followed(s.drop("ticker"), m.drop("ticker"), fwd, by).collect()}
    each = fwd.select(*by).distinct()
    values = s.crossJoin(each).select(*by, "ticker", "name", "value").unionByName(m.join(each, "as_of").select(*by, "ticker", "name", "value"))
    returns = fwd.join(spark.createDataFrame(names, "ticker string, series string"), "series").select(*by, "ticker", "fwd")
    want = {(r.as_of, r.horizon, r.factor): (r.n, r.ic) for r in B.ic_of(values, returns, ["s", "m"], by).collect()}
    assert len(want) == 14 and got == want
    assert got[4, "a", "m"] == (240, None)
    one = fwd.where("horizon = 'a' and fwd is not null").drop("horizon")
    had = m.join(one.select("as_of", "series"), ["as_of", "series"])
    assert {(r.as_of, r.factor): (r.n, r.ic) for r in B.ic_followed(None, had, one, filtered=True).collect()} == {(k[0], k[2]): v for k, v in want.items() if k[1] == "a" and k[2] == "m"}


def test_steps_are_the_percentiles(spark):
    rng = random.Random(9)
    rows = [(m, f"T{i}", rng.choice([None, round(rng.random(), 3), 0.5])) for m in (1, 2) for i in range(700)] + [(3, "a", None), (None, "a", 0.25)]
    df = spark.createDataFrame(rows, "as_of int, ticker string, composite_raw double")
    got = {(r.as_of, r.ticker): r.composite for r in B.with_steps(df, "as_of").collect()}
    assert got == {(r.as_of, r.ticker): r.composite for r in S.composite_percentile(df, keys=["as_of"]).collect()}


def test_rank_sums_store_keys_and_cells_not_rows(spark, kept_rows):
    rng = random.Random(11)
    rows = [(k, f"G{rng.randint(0, 6)}", rng.choice([rng.random() * 100, 50.0, float("inf"), -float("inf")]), rng.randint(1, 3)) for k in (1, 2) for _ in range(1500)] + [(3, "G0", 4.0, 2)]
    got = {(r.k, r.g): (r.n, r.s, r.q) for r in B.rank_sums(spark.createDataFrame(rows, "k int, g string, value double, n long"), ["k"], "g").collect()}
    want: dict = {}
    for k in (1, 2, 3):
        mine = [r for r in rows if r[0] == k]
        total = sum(r[3] for r in mine)
        for _, g, v, n in mine:
            rank = sum(m * ((w <= v) + (w < v)) for _, _, w, m in mine) - total
            a, b, c = want.get((k, g), (0, 0.0, 0.0))
            want[k, g] = (a + n, b + n * rank, c + n * rank * rank)
    assert got == want
    assert max(kept_rows.values()) <= 3 * 64  # not one for each value


def test_moving_metrics_of_a_month_in_one_pass(spark):
    from factorloom.operators import prices as PR

    rng = random.Random(13)
    months = [f"{1995 + k // 12}-{k % 12 + 1:02d}-28" for k in range(30)]
    prices = spark.createDataFrame([(f"S{t}", m, 100.0 + rng.random()) for t in range(4) for m in months[t * 3 :] if rng.random() < 0.9], "ticker string, month_end string, close double")
    market = spark.createDataFrame([(m, 50.0 + rng.random()) for m in months], "month_end string, close double")
    want = PR.momentum_monthly(prices).join(PR.vol_monthly(prices), ["ticker", "month_end"]).join(PR.beta_monthly(prices, market), ["ticker", "month_end"], "left")
    order = ["ticker", "month_end", "mom_12_1", "mom_6_1", "vol", "beta"]
    got = {tuple(r)[:2]: tuple(r)[2:] for r in PR.moving_monthly(prices, market).select(*order).collect()}
    expected = {tuple(r)[:2]: tuple(r)[2:] for r in want.select(*order).collect()}
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        assert [x is None for x in got[k]] == [x is None for x in v] and all(x is None or got[k][i] == pytest.approx(x) for i, x in enumerate(v))


def test_a_month_without_values_has_no_ranks(spark):
    dimension = spark.createDataFrame([("p", "risk", True, 60.0, 20.0), ("q", "risk", False, 40.0, 80.0)], "metric string, category string, higher boolean, generic double, bank double")
    people = spark.createDataFrame([(f"T{i}", "x", "E1" if i else "E2") for i in range(12)], "ticker string, sector string, earner string")
    series = spark.createDataFrame([(1, "E1", None, 2.0), (1, "E2", float("nan"), 2.0), (2, "E2", None, None)], "as_of int, earner string, p double, q double")
    at, sectors = B.followed_ranks(series, people, ["p", "q"], dimension, "as_of", "earner")
    assert sectors == ["x"] and {(r.as_of, r.earner, r.metric): r.pct for r in at.collect()} == {(1, e, "q"): [pytest.approx(100 - 6.5 / 12 * 100)] for e in ("E1", "E2")}


def test_series_meet_names_without_a_shuffle_of_all_rows(spark, kept_rows):
    rows = spark.createDataFrame([(m, f"P{i % 5}", "m", float(i % 7)) for m in (1, 2) for i in range(400)], "as_of int, series string, name string, value double")
    after = spark.createDataFrame([(m, h, f"P{g}", g / 10) for m in (1, 2) for h in ("a", "b") for g in range(5)], "as_of int, horizon string, series string, fwd double")
    got = B.ic_followed(None, rows, after, ["as_of", "horizon"]).collect()
    assert len(got) == 4 and kept_rows["members"] == 10  # one for each month, set and series; its size decides on the join


def test_rank_sums_cut_more_cells_for_more_rows(spark, monkeypatch):
    held, plain = {}, B.stored

    def looked_at(df, name="table"):
        held[name] = plain(df, name)
        return held[name]

    monkeypatch.setattr(B, "stored", looked_at)
    monkeypatch.setattr(B, "CELL_ROWS", 10, raising=False)
    rows = [(1, f"G{i % 3}", float(i % 500), 1) for i in range(1000)] + [(2, None, 7.0, 2)]
    got = {(r.k, r.g): (r.n, r.s, r.q) for r in B.rank_sums(spark.createDataFrame(rows, "k int, g string, value double, n long"), ["k"], "g").collect()}
    rank = lambda v: 2 * 2 * int(v) + 2 - 1000
    want = {(1, f"G{g}"): (sum(r[1] == f"G{g}" for r in rows), sum(rank(r[2]) for r in rows if r[1] == f"G{g}"), sum(rank(r[2]) ** 2 for r in rows if r[1] == f"G{g}")) for g in range(3)}
    assert got == want | {(2, None): (2, 0.0, 0.0)}
    cells = held["cell-sums"].groupBy("id", "cell").sum("n").collect()
    assert len(cells) > 90 and max(c["sum(n)"] for c in cells) <= 20
