"""Statement, universe and history queries, and their SQL."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import rounded
from ..functions.store import shared_folder
from ..operators import statements as S
from ..operators import tables as T
from ..sources import views as V
from .reports import FU, fundamentals
from .scoring import M, metrics, rd

LABELS = ["total revenue", "Revenue", "Tax Provision", "Gross Profit"]
AS_OF = "2001-12-31"


def lines(s: SparkSession, sf: str) -> DataFrame:
    return V.view(s, sf, V.STATEMENT_LINES)


def all_lines(s: SparkSession, sf: str) -> DataFrame:
    return lines(s, sf).unionByName(V.view(s, sf, V.ANNUAL_LINES))


def balances(s: SparkSession, sf: str) -> DataFrame:
    """Annual balance sheets of all, and quarterly ones of every second security."""
    own = lines(s, sf).where("label = 'Total Revenue' and substr(ticker, -1) in ('0', '2', '4', '6', '8')")
    return V.view(s, sf, V.ANNUAL_LINES).unionByName(own.withColumns({"statement": F.lit("balance"), "label": F.lit("Total Assets"), "value": F.when(F.col("value") > 100000, F.col("value") * 1.5)}))


#: Look-ups of statement values: the k-th, or a sum of four quarters.
ASKED = [("income", "Q", "Total Revenue", None), ("income", "Q", "tax provision", None), ("income", "Q", "EBIT", None), ("income", "A", "Total Revenue", 3), ("balance", "A", "Receivables", 1), ("balance", "Q", "Total Assets", 0), ("cashflow", "A", "Depreciation", 2)]


def listed(s: SparkSession, sf: str) -> DataFrame:
    return V.base(s, sf, "customer").select(F.concat(F.lit("C."), F.col("c_custkey").cast("string")).alias("Symbol"), F.col("c_name").alias("Name"), F.col("c_mktsegment").alias("Segment"))


COLUMNS = ["Symbol", "Name", "Segment"]


def _headed(batches):
    """The lines of a file after a line with the names of its columns."""
    yield pa.RecordBatch.from_pydict({"value": [",".join(COLUMNS)]})
    yield from batches


def files(s: SparkSession, sf: str, kind: str) -> DataFrame:
    """The constituents written as files, some of whose lines are broken, and read back."""
    path = f"{shared_folder(s)}/constituents-{uuid.uuid4().hex}"
    rows, key = listed(s, sf), F.substring("Symbol", 3, 20).cast("int")
    if kind == "csv":
        whole = F.concat(F.lit('"'), "Symbol", F.lit('","'), F.col("Name"), F.lit(', Inc.","'), F.col("Segment"), F.lit('"'))
        line = F.when(key % 40 == 7, F.concat_ws(",", "Symbol", "Name")).when(key % 40 == 9, F.concat_ws(",", "Symbol", "Name", "Segment", F.lit("x"), F.lit("y"))).otherwise(whole)
        rows.select(line.alias("value")).mapInArrow(_headed, "value string").write.text(path)
        return T.read_listing(s, path, "csv", COLUMNS)
    line = F.when(key % 50 == 3, F.concat(F.lit('{"Symbol": "'), "Symbol")).otherwise(F.to_json(F.struct("Symbol", "Segment", F.when(key % 50 != 4, F.col("Name")).alias("Name"), F.lit(1).alias("more"))))
    rows.select(line.alias("value")).write.text(path)
    return T.read_listing(s, path, "json", COLUMNS)


def scanned(s: SparkSession, sf: str) -> DataFrame:
    """The first list that holds anything: one that is empty, then the CSV files, then JSON."""
    csv, json = (T.universe_of(files(s, sf, k), *COLUMNS) for k in ("csv", "json"))
    return T.first_that_holds([("empty", csv.where("false")), ("csv", csv), ("json", json)])


def quality(s: SparkSession, sf: str) -> DataFrame:
    return T.listing_quality(files(s, sf, "csv")).withColumn("source", F.lit("csv")).unionByName(T.listing_quality(files(s, sf, "json")).withColumn("source", F.lit("json")))


def records(s: SparkSession, sf: str) -> DataFrame:
    return fundamentals(s, sf).select("ticker", F.when(F.col("ck") % 4 != 0, F.col("company")).alias("company"), F.when(F.col("ck") % 3 != 0, F.col("sector")).alias("sector"), F.when(F.col("ck") % 5 == 0, F.lit("timeout")).alias("error"), F.when(F.col("ck") % 10 != 0, F.col("market_cap")).alias("market_cap"))


def second(s: SparkSession, sf: str) -> DataFrame:
    return fundamentals(s, sf).where("ck % 2 = 0").select("ticker", "company", "sector", F.lit(None).cast("string").alias("error"), (F.col("market_cap") + 1).alias("market_cap"))


def names(s: SparkSession, sf: str) -> DataFrame:
    return metrics(s, sf).select("ticker", "company", "sector")


def history(s: SparkSession, sf: str, keep: str) -> DataFrame:
    prices = V.view(s, sf, V.PRICES_MONTHLY)
    return prices.groupBy(F.col("month_end").alias("run_date")).agg(F.count(F.lit(1)).alias("n_tickers")).where(keep).select("run_date", F.lit("1m").alias("horizon"), "n_tickers")


QUERIES = {
    "stmt_label_match": lambda s, sf: S.label_match(lines(s, sf), LABELS),
    "stmt_value": lambda s, sf: S.value_at(lines(s, sf), 1),
    "ltm_sum": lambda s, sf: S.ltm(lines(s, sf), 4).select("ticker", "label", rounded(F.col("ltm"), 2).alias("ltm")),
    "ltm_partial": lambda s, sf: S.partial_labels(S.ltm(lines(s, sf))).where("annualized").select("ticker", F.concat_ws("|", "labels").alias("labels")),
    "label_alias_chain": lambda s, sf: S.alias_chain(S.ltm(lines(s, sf)), ["Gross Profit", "Tax Provision", "Operating Revenue"]).select("ticker", rounded(F.col("value"), 2).alias("value"), "label"),
    "mrq_balance": lambda s, sf: S.mrq_balance(balances(s, sf)).select("ticker", "label", "source", rounded(F.col("latest"), 2).alias("latest"), rounded(F.col("prior"), 2).alias("prior")),
    "stmt_misses": lambda s, sf: S.misses(all_lines(s, sf), fundamentals(s, sf).select("ticker"), S.requests(s, ASKED)),
    "stmt_freshness": lambda s, sf: S.freshness(lines(s, sf), AS_OF),
    "universe_scan": lambda s, sf: scanned(s, sf),
    "universe_scan_bad_rows": lambda s, sf: quality(s, sf),
    "universe_exclusions": lambda s, sf: T.exclude(names(s, sf), ["C1", "C2"], ["BUILDING"]),
    "universe_dedupe": lambda s, sf: T.first_of_each(names(s, sf).unionByName(names(s, sf).withColumn("company", F.lit("zzz"))), "ticker", "company"),
    "universe_subset": lambda s, sf: T.subset(names(s, sf), ["C1", "C7", "NOPE"]),
    "universe_drift": lambda s, sf: T.drift(names(s, sf).where("substr(ticker, -1) <> '3'"), names(s, sf).where("substr(ticker, -1) <> '5'")),
    "min_market_cap": lambda s, sf: T.min_market_cap(fundamentals(s, sf), 1e6).select("ticker"),
    "sector_override": lambda s, sf: T.sector_override(records(s, sf).select("ticker", "company", "sector"), names(s, sf)),
    "drop_failed": lambda s, sf: T.drop_failed(records(s, sf)).select("ticker", "error"),
    "refresh_upsert": lambda s, sf: T.refresh_upsert(records(s, sf), second(s, sf)).select("ticker", "error", rounded(F.col("market_cap"), 2).alias("market_cap")),
    "dq_fetch_failures": lambda s, sf: records(s, sf).agg(F.count_if(F.col("error").isNotNull()).alias("failed"), F.count(F.lit(1)).alias("n")).withColumn("warn", F.col("failed") / F.col("n") > 0.2),
    "ic_history_merge": lambda s, sf: T.merge_histories(history(s, sf, "month(run_date) = 1"), history(s, sf, "month(run_date) = 2").drop("horizon")),
    "history_status": lambda s, sf: T.history_status(history(s, sf, "true")),
    "raw_field_enrichment": lambda s, sf: T.enrich(names(s, sf).withColumn("_num_analysts", F.lit(-1)), fundamentals(s, sf), {"price": "_current_price", "target_price": "_target_mean", "n_analysts": "_num_analysts", "not_there": "_x", "revenue": "_total_revenue", "ocf": "_ocf"}).select("ticker", "sector", "_num_analysts", *[rounded(F.col(c), 4).alias(c) for c in ("_current_price", "_target_mean", "_total_revenue", "_ocf")]),
}

L = f"l AS (SELECT * FROM {V.oracle(V.STATEMENT_LINES)} v)"
NUM = L + ", n AS (SELECT *, row_number() OVER (PARTITION BY ticker, statement, freq, label ORDER BY period_end DESC) - 1 AS k FROM l WHERE value IS NOT NULL)"
LTM = NUM + ", t0 AS (SELECT ticker, statement, label, count(*) FILTER (k < 4) AS n, sum(value) FILTER (k < 4) AS total FROM n GROUP BY ALL), t AS (SELECT *, CASE WHEN n = 4 THEN total WHEN n = 3 THEN total * 4 / 3 END AS ltm, n = 3 AS partial FROM t0)"
RECORDS = FU + ", rc AS (SELECT ticker, ck, CASE WHEN ck % 4 <> 0 THEN company END AS company, CASE WHEN ck % 3 <> 0 THEN sector END AS sector, CASE WHEN ck % 5 = 0 THEN 'timeout' END AS error, CASE WHEN ck % 10 <> 0 THEN market_cap END AS market_cap FROM fu)"
HIST = f"h AS (SELECT month_end AS run_date, '1m' AS horizon, count(*) AS n_tickers FROM {V.oracle(V.PRICES_MONTHLY)} v GROUP BY 1)"
WANTED = ", ".join(f"('{x}')" for x in LABELS)

ORACLE_SQL = {
    "stmt_label_match": f"WITH {L}, w(wanted) AS (VALUES {WANTED}), j AS (SELECT DISTINCT ticker, statement, freq, line_no, label, wanted, CASE WHEN lower(label) = lower(wanted) THEN 0 WHEN starts_with(lower(label), lower(wanted)) OR ends_with(lower(label), lower(wanted)) THEN 1 END AS priority FROM l CROSS JOIN w), r AS (SELECT *, row_number() OVER (PARTITION BY ticker, statement, freq, wanted ORDER BY priority, line_no, label) AS nth FROM j WHERE priority IS NOT NULL) SELECT ticker, statement, freq, wanted, label, priority FROM r WHERE nth = 1",
    "stmt_value": f"WITH {NUM} SELECT ticker, statement, freq, label, period_end, value FROM n WHERE k = 1",
    "ltm_sum": f"WITH {NUM} SELECT ticker, label, CASE WHEN count(*) FILTER (k >= 4 AND k < 8) = 4 THEN {rd('sum(value) FILTER (k >= 4 AND k < 8)', 2)} END AS ltm FROM n GROUP BY ticker, statement, label",
    "ltm_partial": f"WITH {LTM} SELECT ticker, string_agg(label, '|' ORDER BY label) AS labels FROM t WHERE partial GROUP BY 1",
    "label_alias_chain": f"WITH {LTM}, c(place, label) AS (VALUES (0, 'Gross Profit'), (1, 'Tax Provision'), (2, 'Operating Revenue')) SELECT ticker, {rd('arg_min(ltm, place)', 2)} AS value, arg_min(t.label, place) AS label FROM t JOIN c ON t.label = c.label WHERE ltm IS NOT NULL GROUP BY 1",
    "mrq_balance": f"WITH {L}, bl AS (SELECT * FROM {V.oracle(V.ANNUAL_LINES)} v WHERE statement = 'balance' UNION ALL SELECT ticker, 'balance', freq, line_no, 'Total Assets', period_end, CASE WHEN value > 100000 THEN value * 1.5::DOUBLE END FROM l WHERE label = 'Total Revenue' AND right(ticker, 1) IN ('0', '2', '4', '6', '8')), pq AS (SELECT ticker, count(DISTINCT period_end) FILTER (freq = 'Q') AS quarters FROM bl GROUP BY 1), nb AS (SELECT bl.*, quarters, row_number() OVER (PARTITION BY bl.ticker, freq, label ORDER BY period_end DESC) - 1 AS k FROM bl JOIN pq ON pq.ticker = bl.ticker WHERE value IS NOT NULL AND (freq = 'Q') = (quarters > 0)) SELECT ticker, label, CASE WHEN max(quarters) > 0 THEN 'quarterly' ELSE 'annual' END AS source, {rd('max(value) FILTER (k = 0)', 2)} AS latest, {rd('max(value) FILTER (k = CASE WHEN quarters >= 5 THEN 4 ELSE 1 END)', 2)} AS prior FROM nb GROUP BY 1, 2",
    "stmt_misses": f"WITH {FU}, {L}, al AS (SELECT * FROM l UNION ALL SELECT * FROM {V.oracle(V.ANNUAL_LINES)} v), w(statement, freq, label, k) AS (VALUES {', '.join(f"('{a}', '{b}', '{c}', {'NULL' if k is None else k}::INT)" for a, b, c, k in ASKED)}), a AS (SELECT fu.ticker, w.*, (SELECT count(*) FROM al WHERE al.ticker = fu.ticker AND al.statement = w.statement AND al.freq = w.freq) AS lines, (SELECT count(*) FROM al WHERE al.ticker = fu.ticker AND al.statement = w.statement AND al.freq = w.freq AND lower(al.label) = lower(w.label)) AS labelled, (SELECT count(value) FROM al WHERE al.ticker = fu.ticker AND al.statement = w.statement AND al.freq = w.freq AND lower(al.label) = lower(w.label)) AS n FROM fu CROSS JOIN w), r AS (SELECT label, CASE WHEN lines = 0 THEN 'empty statement' WHEN labelled = 0 THEN 'label not found' WHEN k IS NOT NULL AND n <= k THEN 'out of range' WHEN k IS NULL AND n < 3 THEN 'insufficient quarters' END AS reason FROM a) SELECT label, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1, 2",
    "stmt_freshness": f"WITH {L}, a AS (SELECT ticker, statement, max(period_end) AS newest FROM l GROUP BY 1, 2) SELECT *, CAST(DATE '{AS_OF}' - newest AS INT) AS age, DATE '{AS_OF}' - newest > 200 AS stale FROM a",
    "universe_scan": "SELECT 'C-' || c_custkey AS ticker, c_name || ', Inc.' AS company, c_mktsegment AS sector, 'csv' AS source FROM customer WHERE c_custkey % 40 NOT IN (7, 9)",
    "universe_scan_bad_rows": "SELECT 'csv' AS source, count(*) FILTER (c_custkey % 40 NOT IN (7, 9)) AS good, count(*) FILTER (c_custkey % 40 IN (7, 9)) AS bad, 0::BIGINT AS no_symbol, 0::BIGINT AS no_name, 0::BIGINT AS no_segment FROM customer UNION ALL SELECT 'json', count(*) FILTER (c_custkey % 50 <> 3), count(*) FILTER (c_custkey % 50 = 3), 0, count(*) FILTER (c_custkey % 50 = 4), 0 FROM customer",
    "universe_exclusions": f"WITH {M} SELECT ticker, company, sector FROM m WHERE ticker NOT IN ('C1', 'C2') AND sector <> 'BUILDING'",
    "universe_dedupe": f"WITH {M} SELECT ticker, company, sector FROM m",
    "universe_subset": f"WITH {M} SELECT ticker, company, sector FROM m WHERE ticker IN ('C1', 'C7')",
    "universe_drift": f"WITH {M}, o AS (SELECT ticker FROM m WHERE right(ticker, 1) <> '3'), w AS (SELECT ticker FROM m WHERE right(ticker, 1) <> '5'), j AS (SELECT o.ticker AS a, w.ticker AS b FROM o FULL JOIN w ON o.ticker = w.ticker), q AS (SELECT count(*) FILTER (a IS NULL) AS added, count(*) FILTER (b IS NULL) AS removed, count(a) AS old FROM j) SELECT *, CAST(added + removed AS DOUBLE) / old * 100 AS drift_pct, CAST(added + removed AS DOUBLE) / old * 100 > 10 AS alert FROM q",
    "min_market_cap": f"WITH {FU} SELECT ticker FROM fu WHERE market_cap IS NULL OR market_cap >= 1e6",
    "sector_override": f"WITH {RECORDS} SELECT rc.ticker, fu.sector, CASE WHEN rc.company IS NULL OR rc.company = rc.ticker THEN fu.company ELSE rc.company END AS company FROM rc JOIN fu ON rc.ticker = fu.ticker",
    "drop_failed": f"WITH {RECORDS} SELECT ticker, error FROM rc WHERE NOT (error IS NOT NULL AND market_cap IS NULL)",
    "refresh_upsert": f"WITH {RECORDS} SELECT rc.ticker, CASE WHEN error IS NOT NULL AND rc.ck % 2 = 0 THEN NULL ELSE error END AS error, {rd('CASE WHEN error IS NOT NULL AND rc.ck % 2 = 0 THEN fu.market_cap + 1 ELSE rc.market_cap END', 2)} AS market_cap FROM rc JOIN fu ON rc.ticker = fu.ticker",
    "dq_fetch_failures": f"WITH {RECORDS} SELECT count(error) AS failed, count(*) AS n, CAST(count(error) AS DOUBLE) / count(*) > 0.2::DOUBLE AS warn FROM rc",
    "ic_history_merge": f"WITH {HIST} SELECT run_date, horizon, n_tickers, 'historical' AS source FROM h WHERE month(run_date) = 1 UNION ALL SELECT run_date, NULL, n_tickers, 'live' FROM h WHERE month(run_date) = 2",
    "history_status": f"WITH {HIST} SELECT count(DISTINCT run_date) AS run_dates, count(*) AS rows, CAST(sum(n_tickers) AS BIGINT) AS ticker_dates, CASE WHEN count(DISTINCT run_date) >= 50 THEN 'mature' WHEN count(DISTINCT run_date) >= 24 THEN 'growing' WHEN count(DISTINCT run_date) >= 8 THEN 'early' ELSE 'new' END AS tier FROM h",
    "raw_field_enrichment": f"WITH {FU} SELECT ticker, sector, -1 AS _num_analysts, {', '.join(f'{rd(a, 4)} AS {b}' for a, b in (('price', '_current_price'), ('target_price', '_target_mean'), ('revenue', '_total_revenue'), ('ocf', '_ocf')))} FROM fu",
}
