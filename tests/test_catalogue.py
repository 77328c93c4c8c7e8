"""Every query with SQL gives the rows of its SQL on the smallest tables (a sample of the queries here; tools/verify.py runs all)."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
from factorloom.plans import catalogue  # noqa: E402
from verify import rows  # noqa: E402

SF = "/root/testdata/sf0.001"
SOME = ["rpt_top_n", "winsorize", "pf_stats", "bt_perf_metrics", "beta_monthly", "rpt_peers", "weight_sensitivity", "earnings_surprise"]


def test_names_agree():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    cursor = db.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, cursor.fetchall())
