"""Rules of the scoring chain against pandas and by hand."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom import config
from factorloom.functions.stats import average_rank_pct, rounded
from factorloom.operators import backtest, correlation, diagnostics, portfolio, prices, reports, scoring


def test_average_rank_is_pandas(spark):
    values = [3.0, 1.0, 3.0, 2.0, 5.0, 5.0, 5.0]
    df = spark.createDataFrame([(i, "m", v) for i, v in enumerate(values)], "i int, metric string, value double")
    got = {r.i: r.p for r in df.withColumn("p", average_rank_pct(F.col("value"), ["metric"])).collect()}
    want = pd.Series(values).rank(pct=True) * 100
    assert [got[i] for i in range(len(values))] == pytest.approx(want.tolist())


def test_rounding_is_half_to_even(spark):
    got = spark.createDataFrame([(0.125,), (0.375,), (2.5,)], "x double").select(rounded(F.col("x"), 2).alias("y")).collect()
    assert [r.y for r in got] == [0.12, 0.38, 2.5]


def metric_rows(n=300, seed=1):
    rng = random.Random(seed)
    return [(f"T{i}", f"s{i % 4}", i % 7 == 0, "fcf_yield", None if i % 11 == 0 else rng.gauss(0, 1)) for i in range(n)]


def tall(spark, rows):
    return spark.createDataFrame([r for r in rows if r[4] is not None], "ticker string, sector string, is_bank boolean, metric string, value double")


def test_winsorize(spark):
    rows = metric_rows()
    got = {r.ticker: r.value for r in scoring.winsorize(tall(spark, rows)).collect()}
    values = sorted(r[4] for r in rows if r[4] is not None)
    k = int(0.01 * len(values))
    assert min(got.values()) == values[k] and max(got.values()) == values[-k - 1]
    few = tall(spark, rows[:9])
    assert {r.value for r in scoring.winsorize(few).collect()} == {r[4] for r in rows[:9] if r[4] is not None}


def test_small_sectors_use_the_universe(spark):
    rows = metric_rows(30) + [("X", "tiny", False, "fcf_yield", 0.0)]
    ranked = scoring.with_dimension(tall(spark, rows), config.metric_dimension(spark))
    got = {r.ticker: r.pct for r in scoring.pct_rank_sector(ranked).collect()}
    every = {r.ticker: r.pct for r in scoring.pct_rank_universe(ranked).collect()}
    assert got["X"] == every["X"]


def test_direction(spark):
    rows = [(f"T{i}", "s", False, "ev_ebitda", float(i)) for i in range(20)]
    got = {r.ticker: r.pct for r in scoring.pct_rank_sector(scoring.with_dimension(tall(spark, rows), config.metric_dimension(spark))).collect()}
    assert got["T0"] == 95.0 and got["T19"] == 0.0


def test_weights_sum_to_100(spark):
    assert all(r.valid for r in scoring.weights_check(config.metric_weights(spark)).collect())
    assert sum(config.CATEGORY_WEIGHTS.values()) == 100


def scored_frame(spark, n=120):
    rng = random.Random(2)
    cols = [f"{c}_score" for c in config.CATEGORIES]
    rows = [(f"T{i:03d}", f"s{i % 5}", False, *[None if rng.random() < 0.1 else rng.uniform(0, 100) for _ in cols], rng.uniform(0, 100), rng.choice([None, 0.0, rng.uniform(0.1, 0.9)])) for i in range(n)]
    return spark.createDataFrame(rows, "ticker string, sector string, is_bank boolean, " + ", ".join(f"{c} double" for c in cols) + ", composite double, volatility double")


def test_null_scores_never_trap(spark):
    df = scored_frame(spark)
    got = scoring.growth_trap(scoring.value_trap(df)).collect()
    for r in got:
        if r.quality_score is None and r.revisions_score is None:
            assert not r.growth_trap and not r.value_trap
        assert 0 <= r.value_trap_severity <= 100 and 0 <= r.growth_trap_severity <= 100


def test_ranks_share_and_skip(spark):
    df = spark.createDataFrame([("a", 9.0), ("b", 9.0), ("c", 8.0), ("d", None)], "ticker string, composite double")
    assert {r.ticker: r["rank"] for r in scoring.rank_stocks(df).collect()} == {"a": 1, "b": 1, "c": 3, "d": None}


@pytest.mark.parametrize("weigh", [portfolio.weight_equal, portfolio.weight_inverse_vol, portfolio.weight_score])
def test_portfolio_weights(spark, weigh):
    port = portfolio.select(scored_frame(spark), stocks=25, per_sector=6)
    rows = portfolio.round_to_100(portfolio.cap_redistribute(weigh(port))).collect()
    assert len(rows) == 25 and round(sum(r.weight for r in rows), 6) == 100
    assert max(r.weight for r in rows) <= 5.01
    by_sector = pd.Series([r.sector for r in rows]).value_counts()
    assert by_sector.max() <= 6


def test_drawdown_and_perf(spark):
    rets = [0.1, -0.5, 0.2, 0.3]
    df = spark.createDataFrame([("a", i, r) for i, r in enumerate(rets)], "ticker string, dt int, ret double")
    assert prices.max_drawdown(df, least=1).first().max_drawdown == pytest.approx(-0.5)
    perf = backtest.perf_metrics(df.withColumnRenamed("dt", "as_of"), ["ticker"]).first()
    cum = 1.1 * 0.5 * 1.2 * 1.3
    assert perf.ann_return == pytest.approx(cum**3 - 1) and perf.max_drawdown == pytest.approx(-0.5)


def test_nearest_price_takes_the_earlier_of_two(spark):
    p = spark.sql("SELECT 'a' AS ticker, d AS dt, c AS close FROM VALUES (DATE'2020-01-01', 1D), (DATE'2020-01-05', 2D), (DATE'2020-02-01', NULL) AS t(d, c)")
    t = spark.sql("SELECT 'a' AS ticker, d AS target FROM VALUES (DATE'2020-01-03'), (DATE'2020-01-12'), (DATE'2020-01-13'), (DATE'2020-02-01') AS t(d)")
    got = {str(r.target): (r.close, r.days) for r in prices.nearest_price(t, p).collect()}
    assert got == {"2020-01-03": (1.0, 2), "2020-01-12": (2.0, 7)}


def test_peers(spark):
    rng = random.Random(4)
    rows = [(f"T{i}", f"s{i % 3}", None if i % 13 == 0 else float(rng.randint(1, 50))) for i in range(80)]
    got = reports.peers(spark.createDataFrame(rows, "ticker string, sector string, market_cap double"), n=3).collect()
    has = [r for r in rows if r[2]]
    for t, s, m in has:
        want = sorted(round(abs(o / m - 1), 6) for u, v, o in has if v == s and u != t)[:3]
        assert sorted(r.distance for r in got if r.ticker == t) == pytest.approx(want)


def test_spearman_is_pandas(spark):
    rng = random.Random(5)
    data = pd.DataFrame({c: [rng.choice([None, rng.randint(0, 9)]) for _ in range(60)] for c in "abc"}, dtype=float)
    rows = [(str(i), c, v) for c in data for i, v in data[c].items() if pd.notna(v)]
    got = correlation.spearman(spark.createDataFrame(rows, "ticker string, name string, value double")).collect()
    for r in got:
        both = data[[r.a, r.b]].dropna().rank()
        assert r.rho == pytest.approx(both[r.a].corr(both[r.b]), abs=6e-4)


def test_dates_scored_together_are_scored_as_alone(spark):
    r = random.Random(11)
    names = ["fcf_yield", "earnings_yield", "roic", "gross_profit_assets", "piotroski_f_score", "accruals"]
    rows = [(d, f"t{i}", r.choice("xy"), i % 7 == 0, *[None if r.random() < 0.1 else r.random() * (3 if d == "a" else 1) + (d == "b") for _ in names]) for d in "ab" for i in range(30)]
    wide = spark.createDataFrame(rows, "as_of string, ticker string, sector string, is_bank boolean, " + ", ".join(f"{n} double" for n in names))
    dimension = config.metric_dimension(spark)
    got = {(x.as_of, x.ticker, x.metric): (x.pct, x.weight) for x in scoring.ranked_metrics(wide, dimension, names, keys=["as_of"]).collect()}
    for d in "ab":
        alone = scoring.ranked_metrics(wide.where(F.col("as_of") == d).drop("as_of"), dimension, names).collect()
        assert {(d, x.ticker, x.metric): (x.pct, x.weight) for x in alone} == {k: v for k, v in got.items() if k[0] == d}


def test_places_in_groups(spark):
    from factorloom.functions.ranks import numbered

    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), float(r.randint(0, 5)), f"t{i}") for i in range(300)]
    got = numbered(spark.createDataFrame(rows, "g string, v double, t string"), ["g"], [F.col("v").desc(), F.col("t")])
    want = {}
    for g in ("a", "b", None):
        mine = sorted([x for x in rows if x[0] == g], key=lambda x: (-x[1], x[2]))
        want |= {x[2]: (i + 1, len(mine)) for i, x in enumerate(mine)}
    assert {x.t: (x.nth, x.total) for x in got.collect()} == want


def test_forward_correlations_against_pandas(spark):
    r = random.Random(6)
    rows = [(m, f"t{i}", r.choice([None, 1.0, float(r.randint(1, 9))]), r.random()) for m in (1, 2, 3) for i in range(15 if m == 3 else 40)]
    after = [(m, t, None if r.random() < 0.2 else float(r.randint(-3, 3))) for m, t, *_ in rows if r.random() < 0.9]
    got = backtest.ic_series(spark.createDataFrame(rows, "as_of int, ticker string, a double, b double"), spark.createDataFrame(after, "as_of int, ticker string, fwd double"), ["a", "b"])
    found = {(x.as_of, x.factor): (x.n, round(x.ic, 5)) for x in got.collect()}
    frame = pd.DataFrame(rows, columns=["as_of", "ticker", "a", "b"]).merge(pd.DataFrame(after, columns=["as_of", "ticker", "fwd"]), on=["as_of", "ticker"])
    want = {}
    for m, part in frame.groupby("as_of"):
        for c in "ab":
            both = part[[c, "fwd"]].dropna()
            if len(both) >= 20:
                want[m, c] = (len(both), round(both[c].rank().corr(both["fwd"].rank()), 5))
    assert found == want and {m for m, _ in want} == {1, 2}


def test_one_horizon(spark):
    rows = [("1w", d, 0.1) for d in range(9)] + [("1m", d, 0.2) for d in range(6)]
    df = spark.createDataFrame(rows, "horizon string, as_of int, ic double")
    assert {x.horizon for x in backtest.one_horizon(df).collect()} == {"1m"}
    assert {x.horizon for x in backtest.one_horizon(df.where("horizon = '1w'")).collect()} == {"1w"}
    assert backtest.one_horizon(df, least=7).count() == 0


def test_tables_are_kept_until_their_files_change(spark, tmp_path):
    from factorloom.functions.kept import Kept

    kept, made = Kept(["one"]), []

    def make(s, folder):
        made.append(folder)
        return s.read.parquet(f"{folder}/one.parquet")

    spark.range(3).write.parquet(f"{tmp_path}/one.parquet")
    assert kept.get(spark, str(tmp_path), "x", make).count() == 3 and kept.get(spark, str(tmp_path), "x", make).count() == 3 and len(made) == 1
    spark.range(2).write.mode("append").parquet(f"{tmp_path}/one.parquet")
    assert kept.get(spark, str(tmp_path), "x", make).count() == 5 and len(made) == 2
    kept.forget(str(tmp_path))
    assert not kept.tables and kept.get(spark, str(tmp_path), "x", make).count() == 5 and len(made) == 3


@pytest.mark.parametrize("tasks", [1, 5, 23])
def test_places_of_rows_whose_values_fill_many_ranges(spark, tasks):
    from factorloom.functions.ranks import placed_rows

    r = random.Random(tasks)
    rows = [(m, f"t{i}", r.choice(["x", "y", None]), None if r.random() < 0.05 else 3.0 if r.random() < 0.5 else float(r.randint(0, 6))) for m in ("a", "b", "c") for i in range(5 if m == "c" else 200)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        got = placed_rows(spark.createDataFrame(rows, "metric string, ticker string, sector string, value double"), ["metric"], "sector").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    there = [x for x in rows if x[3] is not None]
    assert len(got) == len(there)
    for x in got:
        mine = [v for m, _, _, v in there if m == x.metric]
        near = [v for m, _, s, v in there if m == x.metric and s == x.sector]
        assert (x.below, x.n, x.total) == (sum(v < x.value for v in mine), mine.count(x.value), len(mine))
        assert (x.inner_below, x.inner_n, x.inner_total) == (sum(v < x.value for v in near), near.count(x.value), len(near))


def test_cleaned_ranks_equal_winsorize_and_rank(spark):
    r = random.Random(8)
    rows = [(m, f"t{i}", r.choice("xyz") if i % 40 else "few", m == "a", 5.0 if m == "c" else 2.0 if r.random() < 0.3 else r.gauss(0, 1)) for m in ("a", "b", "c", "d") for i in range(7 if m == "d" else 260)]
    tall = spark.createDataFrame(rows, "metric string, ticker string, sector string, higher boolean, value double")
    want = {(x.metric, x.ticker): (round(x.value, 9), round(x.pct, 6)) for x in scoring.pct_rank_sector(scoring.winsorize(tall)).collect()}
    got = {(x.metric, x.ticker): (round(x.value, 9), round(x.pct, 6)) for x in scoring.cleaned_ranks(tall).collect()}
    assert got == want


def test_ranges_grow_in_number_with_the_rows(spark, monkeypatch):
    from factorloom.functions import ranks

    parts, plain = {}, ranks.stored

    def looked_at(df, name="table"):
        table = plain(df, name)
        if name == "ranges":
            parts.update({r["part"]: r["count"] for r in table.groupBy("part").count().collect()})
        return table

    monkeypatch.setattr(ranks, "stored", looked_at)
    monkeypatch.setattr(ranks, "RANGE_ROWS", 50, raising=False)
    rows = [("a", f"t{i}", "x" if i % 3 else "y", float(i % 700)) for i in range(1000)]
    got = ranks.placed_rows(spark.createDataFrame(rows, "metric string, ticker string, sector string, value double"), ["metric"], "sector").collect()
    assert len(parts) > 10 and max(parts.values()) < 200  # of 1,000 rows and 4 shuffle partitions
    assert all((x.below, x.n) == (sum(v < x.value for *_, v in rows), sum(v == x.value for *_, v in rows)) for x in got[::50]) and len(got) == 1000


def test_what_a_metric_has_stays_out_of_the_sort(spark, monkeypatch):
    kept, plain = {}, scoring.stored

    def looked_at(df, name="table"):
        kept[name] = df.columns
        return plain(df, name)

    from factorloom.functions import ranks

    monkeypatch.setattr(scoring, "stored", looked_at)
    monkeypatch.setattr(ranks, "stored", looked_at)
    r = random.Random(4)
    rows = [(m, f"t{i}", r.choice("xy"), i % 5 == 0, float(r.randint(0, 9))) for m in ("a", "b", "other") for i in range(60)]
    tall = spark.createDataFrame(rows, "metric string, ticker string, sector string, is_bank boolean, value double")
    dimension = spark.createDataFrame([("a", "risk", True, 60.0, 20.0), ("b", "risk", False, 40.0, 80.0)], "metric string, category string, higher boolean, generic double, bank double")
    order = ["metric", "ticker", "category", "higher", "weight", "value", "pct"]
    want = {tuple(x) for x in scoring.cleaned_ranks(scoring.with_dimension(tall, dimension)).select(*order).collect()}
    kept.clear()
    got = scoring.cleaned_ranks(tall, dimension=dimension).select(*order).collect()
    assert {tuple(x) for x in got} == want and len(got) == 120
    assert "placed" not in kept and not {"category", "higher", "weight"}.intersection(kept["ranges"])


def test_kept_scores_start_from_kept_metrics(monkeypatch):
    from factorloom.plans import scoring as plans

    monkeypatch.setattr(plans, "kept", lambda s, sf, name, make: make(s, sf))
    monkeypatch.setattr(plans, "metrics", lambda s, sf: "kept")
    monkeypatch.setattr(plans, "all_metrics", lambda s, sf: "anew")
    monkeypatch.setattr(plans, "history", lambda s, sf: None)
    monkeypatch.setattr(plans.config, "metric_dimension", lambda s: None)
    monkeypatch.setattr(plans.S, "score_pipeline", lambda of, *_, **__: of)
    assert (plans.scored(None, "x"), plans.whole_chain(None, "x")) == ("kept", "anew")
