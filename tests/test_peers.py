from __future__ import annotations

import random

import pytest

from factorloom.operators import reports


def brute(rows: list[tuple], n: int) -> list[tuple]:
    out = []
    for t, s, m in rows:
        if m is None or m <= 0:
            continue
        others = sorted((abs(m2 / m - 1), t2) for t2, s2, m2 in rows if s2 == s and t2 != t and m2 is not None and m2 > 0)
        out += [(t, p, i + 1) for i, (_, p) in enumerate(others[:n])]
    return sorted(out)


def found(spark, rows, n=5):
    df = reports.peers(spark.createDataFrame(rows, "ticker string, sector string, market_cap double"), n)
    return sorted((r.ticker, r.peer, r.nth) for r in df.collect())


def test_twenty_equal_sizes(spark):
    rows = [(f"t{i:02d}", "s", 7.0) for i in range(20)] + [("big", "s", 9.0), ("other", "z", 7.0)]
    got = found(spark, rows)
    assert got == brute(rows, 5)
    assert [p for t, p, _ in got if t == "t10"] == ["t00", "t01", "t02", "t03", "t04"]


@pytest.mark.parametrize("tasks", [1, 4, 17, 60])
def test_ranges_do_not_cut_neighbours(spark, tasks):
    r = random.Random(tasks)
    rows = [(f"t{i}", r.choice("abc"), r.choice([None, -1.0, 0.0, 5.0, float(r.randint(1, 60)), r.random() * 50])) for i in range(150)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        assert found(spark, rows) == brute(rows, 5)
        assert found(spark, rows, 2) == brute(rows, 2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_few_or_none(spark):
    assert found(spark, [("a", "s", 1.0)]) == [] and found(spark, []) == []
    assert found(spark, [("a", "s", 1.0), ("b", "s", 2.0)]) == [("a", "b", 1), ("b", "a", 1)]
