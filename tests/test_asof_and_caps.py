from __future__ import annotations

import datetime as dt
import random

import pytest

from factorloom.operators import portfolio, prices, tables


def ten_rounds(weights: list[float], cap: float) -> list[float]:
    w = list(weights)
    for _ in range(10):
        over = [i for i, x in enumerate(w) if x > cap]
        free = [i for i, x in enumerate(w) if x <= cap]
        excess = sum(w[i] - cap for i in over)
        for i in over:
            w[i] = cap
        if excess <= 0.001 or not free:
            break
        total = sum(w[i] for i in free)
        for i in free:
            w[i] += excess * (w[i] / total if total > 0 else 1 / len(free))
    return w


def test_a_thousand_portfolios_in_one_plan(spark):
    r = random.Random(3)
    books = {}
    for p in range(1000):
        n = r.choice([1, 3, 19, 20, 21, 25, 40])
        raw = [r.choice([0.0, r.random(), r.random() ** 4 * 30, 5.0]) for _ in range(n)]
        total = sum(raw) or 1.0
        books[p] = [round(x / total * 100, 6) for x in raw]
    rows = [(p, i, w) for p, ws in books.items() for i, w in enumerate(ws)]
    r.shuffle(rows)
    got = {}
    for x in portfolio.cap_redistribute(spark.createDataFrame(rows, "book int, i int, weight double"), keys=["book"]).collect():
        got.setdefault(x.book, {})[x.i] = x.weight
    for p, ws in books.items():
        assert [got[p][i] for i in range(len(ws))] == pytest.approx(ten_rounds(ws, 5.0), abs=1e-6), p


def test_caps_of_one_portfolio(spark):
    one = spark.createDataFrame([("a", 60.0), ("b", 40.0), ("c", None)], "ticker string, weight double")
    assert {r.ticker: r.weight for r in portfolio.cap_redistribute(one, cap=70.0).collect()} == {"a": 60.0, "b": 40.0, "c": 0.0}
    assert portfolio.cap_redistribute(one.limit(0)).count() == 0


def day(n: int) -> dt.date:
    return dt.date(2000, 1, 1) + dt.timedelta(days=n)


def brute_nearest(targets, rows, days=7):
    out = []
    for t, at in sorted(set(targets), key=repr):
        near = sorted((abs((d - at).days), d, c) for k, d, c in rows if k == t and c is not None and d is not None and abs((d - at).days) <= days) if at and t else []
        if near:
            out.append((t, at, near[0][2], near[0][0]))
    return sorted(out)


def test_nearest_prices_equal_brute_force(spark):
    r = random.Random(1)
    have = [(r.choice("abc"), day(r.choice([r.randint(0, 60), r.randint(100, 400)])), r.choice([None, float(r.randint(1, 99))])) for _ in range(120)]
    targets = [(r.choice("abcd"), day(r.randint(-10, 420))) for _ in range(300)] + [("a", None)]
    got = prices.nearest_price(spark.createDataFrame(targets, "ticker string, target date"), spark.createDataFrame(have, "ticker string, dt date, close double"))
    assert sorted(tuple(x) for x in got.collect()) == brute_nearest(targets, have)


def test_nearest_prices_at_the_edges(spark):
    have = [("a", day(0), 1.0), ("a", day(14), 2.0), ("b", day(3), 5.0), ("b", day(3), 4.0)]
    targets = [("a", day(7)), ("a", day(-7)), ("a", day(-8)), ("a", day(21)), ("a", day(22)), ("a", day(8)), ("b", day(3)), ("c", day(0))]
    got = prices.nearest_price(spark.createDataFrame(targets, "ticker string, target date"), spark.createDataFrame(have, "ticker string, dt date, close double"))
    want = [("a", day(-7), 1.0, 7), ("a", day(7), 1.0, 7), ("a", day(8), 2.0, 6), ("a", day(21), 2.0, 7), ("b", day(3), 4.0, 0)]
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_listings_keep_what_is_broken(spark, tmp_path):
    names = ["Symbol", "Security", "GICS Sector"]
    (tmp_path / "a.csv").write_text('Symbol,Security,GICS Sector\nBRK.B,"Berkshire, Inc.",Financials\nX,Short\nY,Long,Energy,1,2\n,No ticker,Energy\nZ,,Energy\nZ,Zed,Energy\n')
    csv = tables.read_listing(spark, str(tmp_path / "a.csv"), "csv", names)
    assert tuple(tables.listing_quality(csv).first()) == (4, 2, 1, 1, 0)
    got = sorted(tuple(r) for r in tables.universe_of(csv, *names).collect())
    assert got == [("BRK-B", "Berkshire, Inc.", "Financials"), ("Z", None, "Energy")]
    (tmp_path / "b.json").write_text('{"Symbol": "A.B", "Security": "Ab", "GICS Sector": "Energy", "more": 1}\n{"Symbol": "C", broken\n{"Security": "No ticker"}\n')
    json = tables.read_listing(spark, str(tmp_path / "b.json"), "json", names)
    assert tuple(tables.listing_quality(json).first()) == (2, 1, 1, 0, 1)
    both = tables.first_that_holds([("none", tables.universe_of(csv, *names).where("false")), ("json", tables.universe_of(json, *names)), ("csv", tables.universe_of(csv, *names))])
    assert [tuple(r) for r in both.collect()] == [("A-B", "Ab", "Energy", "json")]
    with pytest.raises(ValueError):
        tables.read_listing(spark, str(tmp_path), "html", names)


def test_headers_with_other_names_are_an_error(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Ticker,Company,Sector\nA,b,c\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_listing(spark, str(tmp_path / "c.csv"), "csv", ["Symbol", "Security", "Sector"]).collect()
