"""Portfolio, report, screen and diagnostic queries over scored securities, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions.stats import rounded
from ..functions.store import stored
from ..operators import correlation as CO
from ..operators import diagnostics as D
from ..operators import assembly as A
from ..operators import mentions as ME
from ..operators import metrics as MT
from ..operators import portfolio as P
from ..operators import prices as PR
from ..operators import reports as R
from ..operators import scoring as S
from ..operators import statements as ST
from ..sources import views
from . import fundamentals as FD
from .scoring import CATS, M, METRICS, MISSING, PCT, RAW, SCORED, SCORES, TALL, W, metrics, missing, ranked, raw_scored, rd, scored, tall

CAPS = config.CATEGORY_WEIGHTS
SNAPSHOT = ["market_cap", "enterprise_value", "revenue", "revenue_growth_yoy", "net_income", "ni_growth_yoy", "ebitda", "gross_margin", "net_margin", "fcf", "total_debt", "total_cash", "net_debt", "dividend_yield", "payout_ratio", "shares", "trailing_eps", "forward_eps", "dollar_volume", "short_ratio"]


def fundamentals(s: SparkSession, sf: str, of: dict[str, DataFrame] | None = None) -> DataFrame:
    return views.view(s, sf, views.FUNDAMENTALS, of)


def with_fields(s: SparkSession, sf: str) -> DataFrame:
    """Scored securities with company, volatility, beta, yield, volume and size."""
    extra = fundamentals(s, sf).select("ticker", "market_cap", "dollar_volume", (F.col("dividend_rate") / F.when(F.col("price") != 0, F.col("price"))).alias("dividend_yield"))
    more = metrics(s, sf).select("ticker", "company", "volatility", "beta")
    return scored(s, sf).join(extra, "ticker").join(more, "ticker")


def port(s: SparkSession, sf: str) -> DataFrame:
    return P.select(P.eligible(with_fields(s, sf), least_volume=0.0))


def final_port(s: SparkSession, sf: str) -> DataFrame:
    return P.round_to_100(P.cap_redistribute(P.weight_score(port(s, sf))))


PF = "ticker", "sector", "port_rank"
PROPOSED = CAPS | {"valuation": 17.0, "momentum": 18.0}


def spearman_source(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.unpivot("ticker", columns, "name", "value").where("value is not null")


def accuracy(s: SparkSession, sf: str) -> DataFrame:
    return D.union_rules(list(D.fundamentals_rules(fundamentals(s, sf)).values()))


def names(s: SparkSession, sf: str) -> DataFrame:
    """Nations, parts of two words, the first three words of benchmark items, suppliers with their first words, sectors and common words."""
    of = lambda table, entity, name, bound: views.base(s, sf, table).select(F.col(entity).cast("string").alias("entity"), name.alias("name"), F.lit(bound).alias("bound"))
    sectors = of("customer", "c_mktsegment", F.col("c_mktsegment"), ME.ANYWHERE).distinct()
    items = of("benchmark", "item_id", F.array_join(F.slice(F.split("text", " "), 1, 3), " "), ME.WORD)
    common = s.createDataFrame([("common", "the", ME.WORD), ("common", "of", ME.WORD), ("rare", "stupid", ME.WORD)], "entity string, name string, bound string")
    return reduce(DataFrame.unionByName, [of("nation", "n_name", F.col("n_name"), ME.WORD), of("part", "p_name", F.col("p_name"), ME.WORD).distinct(), items, ME.company_names(views.base(s, sf, "supplier"), "s_suppkey", "s_name"), sectors, common])


def dispersion_history(s: SparkSession, sf: str) -> DataFrame:
    prices = views.view(s, sf, views.PRICES_MONTHLY)
    return prices.groupBy("month_end", (F.substring("ticker", -1, 1)).alias("category")).agg(rounded(F.stddev_samp("close") / 1000, 4).alias("dispersion")).select("category", F.col("month_end").alias("dt"), "dispersion")


def _rule(name: str):
    return lambda s, sf: D.fundamentals_rules(fundamentals(s, sf))[name]


def provenance(s: SparkSession, sf: str, of: dict[str, DataFrame] | None = None) -> DataFrame:
    """Of all securities, or of those of the base tables ``of``."""
    lines = views.view(s, sf, views.STATEMENT_LINES, of).unionByName(views.view(s, sf, views.ANNUAL_LINES, of))
    sources = ST.source_blocks(lines, config.DECISIVE).where("statement = 'income'").groupBy("ticker").agg(F.max("source").alias("source"))
    partial = ST.partial_labels(ST.ltm(lines)).select("ticker", "annualized")
    targets = fundamentals(s, sf, of).select("ticker", "target_price", F.col("n_analysts").alias("analysts"))
    known = metrics(s, sf) if of is None else metrics(s, sf).join(targets.select("ticker"), "ticker", "left_semi")
    return MT.provenance(known, config.KEY_METRICS, sources, partial, targets)


def bands(s: SparkSession, sf: str) -> DataFrame:
    """Sectors against the universe, exposures, stability of the best under other weights, and correlations of categories."""
    book = P.weight_score(port(s, sf))
    return R.summary_bands(
        {
            "sector_delta": P.versus_benchmark(book, fundamentals(s, sf), "market_cap").select(F.col("sector").alias("item"), F.col("active").alias("value")),
            "exposure": P.factor_exposure(book, CATS).select(F.col("category").alias("item"), F.col("exposure").alias("value")),
            "jaccard": D.weight_sensitivity(raw_scored(s, sf), W).select(F.concat_ws(" ", "category", "direction").alias("item"), F.col("jaccard").alias("value")),
            "correlation": QUERIES["category_correlation"](s, sf).select(F.concat_ws(" ", "a", "b").alias("item"), F.col("rho").alias("value")),
        }
    )


def recompute(s: SparkSession, sf: str) -> DataFrame:
    """Scored values against the vendor's fields; the vendor's beta is that of returns aligned from the end, without dates."""
    rets = PR.log_returns(A.trailing(views.view(s, sf, views.PRICES_PAIRED)))
    market = PR.log_returns(A.trailing(views.view(s, sf, views.MARKET_DAILY).withColumn("ticker", F.lit("all")))).select("dt", "ret")
    theirs = fundamentals(s, sf).select("ticker", F.col("series")).join(PR.beta_tail_aligned(rets, market).select(F.col("ticker").alias("series"), "beta"), "series").select("ticker", "beta")
    raw = fundamentals(s, sf).select("ticker", "enterprise_value", "ebitda", "trailing_eps", "forward_eps", "price")
    return D.recomputed(metrics(s, sf), raw, theirs)


FLAGS = ("beneish_flag", "channel_stuffing_flag", "eps_basis_mismatch", "ev_flag")


def best_ten(s: SparkSession, sf: str) -> DataFrame:
    """Raw values and flags of the ten best: what is theirs alone is read from the base tables."""
    best = stored(scored(s, sf).where("rank <= 10").select("ticker", "rank", "composite", "value_trap", "growth_trap"), "best")
    of = views.of_securities(s, sf, best)
    raw = FD.metrics(s, sf, of).select("ticker", *FLAGS, "eps_ratio")
    quotes = fundamentals(s, sf, of).select("ticker", "price", "target_price", "n_analysts")
    shown = metrics(s, sf).select("ticker", *R.SHOWN)
    out = best.join(shown, "ticker").join(raw, "ticker").join(quotes, "ticker").join(provenance(s, sf, of).select("ticker", "present", "total", "source", "annualized"), "ticker", "left")
    return out.select("rank", "ticker", "composite", "value_trap", "growth_trap", *FLAGS, rounded(F.col("eps_ratio"), 2).alias("eps_ratio"), *R.SHOWN, *[rounded(F.col(c), 4).alias(c) for c in ("price", "target_price")], "n_analysts", "present", "total", "source", "annualized")


QUERIES = {
    "provenance": lambda s, sf: provenance(s, sf).withColumn("target_price", rounded(F.col("target_price"), 4)),
    "eps_mismatch_counts": lambda s, sf: FD.metrics(s, sf).select("ticker", "eps_basis_mismatch").join(provenance(s, sf).select("ticker", "annualized"), "ticker").agg(F.count_if("eps_basis_mismatch").alias("eps_mismatches"), F.count_if("annualized").alias("annualized"), F.count(F.lit(1)).alias("n")),
    "acc_recompute": lambda s, sf: recompute(s, sf).select("ticker", "check", *[rounded(F.col(c), 4).alias(c) for c in ("scored", "anew")]),
    "acc_statement_dates": lambda s, sf: D.misaligned_dates(views.view(s, sf, views.STATEMENT_LINES).where("value is not null").unionByName(views.view(s, sf, views.ANNUAL_LINES).where("statement = 'balance'"))),
    "rpt_summary_bands": lambda s, sf: bands(s, sf),
    "rpt_validation_top10": lambda s, sf: best_ten(s, sf),
    "rpt_company_snapshot": lambda s, sf: R.company_snapshot(fundamentals(s, sf)).select("ticker", *[rounded(F.col(c), 4).alias(c) for c in SNAPSHOT]),
    "rpt_category_forensics": lambda s, sf: R.category_forensics(raw_scored(s, sf), W).select("ticker", "category", *[rounded(F.col(c), 6).alias(c) for c in ("score", "points")], "weight"),
    "pf_eligible": lambda s, sf: P.eligible(with_fields(s, sf), least_volume=0.0).select("ticker", "composite"),
    "pf_select": lambda s, sf: port(s, sf).select(*PF),
    "pf_rank": lambda s, sf: port(s, sf).select("port_rank", "ticker", "composite"),
    "pf_weight_equal": lambda s, sf: P.weight_equal(port(s, sf)).select("ticker", "weight"),
    "pf_weight_invvol": lambda s, sf: P.weight_inverse_vol(port(s, sf)).select("ticker", rounded(F.col("weight"), 4).alias("weight")),
    "pf_weight_score": lambda s, sf: P.weight_score(port(s, sf)).select("ticker", rounded(F.col("weight"), 4).alias("weight")),
    "pf_cap_redistribute": lambda s, sf: P.cap_redistribute(P.weight_inverse_vol(port(s, sf))).select("ticker", rounded(F.col("weight"), 4).alias("weight")),
    "pf_round_to_100": lambda s, sf: P.round_to_100(P.weight_score(port(s, sf))).select("ticker", "weight"),
    "pf_stats": lambda s, sf: P.stats(P.weight_score(port(s, sf))),
    "pf_sector_alloc": lambda s, sf: P.sector_allocation(P.weight_score(port(s, sf))),
    "pf_factor_exposure": lambda s, sf: P.factor_exposure(P.weight_score(port(s, sf)), CATS),
    "pf_vs_benchmark": lambda s, sf: P.versus_benchmark(P.weight_score(port(s, sf)), fundamentals(s, sf), "market_cap"),
    "pf_naive_top_n": lambda s, sf: P.naive_top(scored(s, sf)).select("ticker", "rank"),
    "rpt_holdings": lambda s, sf: final_port(s, sf).select("port_rank", "ticker", "company", "sector", "composite", "weight", F.lit("score").alias("method")),
    "rpt_portfolio_simple": lambda s, sf: port(s, sf).groupBy("sector").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("beta"), 4).alias("beta"), rounded(F.avg("composite"), 4).alias("composite")),
    "rpt_factor_scores": lambda s, sf: with_fields(s, sf).select("ticker", "company", "sector", *[rounded(F.col(c), 1).alias(c) for c in SCORES], "composite", "rank", "value_trap", "growth_trap"),
    "rpt_top_n": lambda s, sf: R.top_n(scored(s, sf)).select("rank", "ticker", "sector", "composite", "band"),
    "rpt_bottom_n": lambda s, sf: R.bottom_n(scored(s, sf)).select("rank", "ticker", "composite"),
    "rpt_sector_summary": lambda s, sf: R.sector_summary(scored(s, sf)),
    "rpt_score_distribution": lambda s, sf: R.histogram(scored(s, sf), "composite", 10),
    "rpt_histogram20": lambda s, sf: R.histogram(scored(s, sf), "composite", 20),
    "rpt_trap_by_sector": lambda s, sf: R.trap_by_sector(scored(s, sf)),
    "rpt_sector_distribution": lambda s, sf: R.sector_distribution(raw_scored(s, sf).select("sector", *[rounded(F.col(c), 6).alias(c) for c in SCORES]), SCORES),
    "rpt_kpis": lambda s, sf: R.kpis(scored(s, sf)),
    "rpt_peers": lambda s, sf: R.peers(fundamentals(s, sf)),
    "rpt_sector_context": lambda s, sf: R.sector_context(scored(s, sf), metrics(s, sf), METRICS[:8]),
    "rpt_flags": lambda s, sf: scored(s, sf).select("ticker", "value_trap", "growth_trap", "insufficient_data", "value_trap_severity", "growth_trap_severity"),
    "rpt_score_forensics": lambda s, sf: R.score_forensics(ranked(s, sf)).select("ticker", "category", "metric", rounded(F.col("value"), 6).alias("value"), rounded(F.col("pct"), 6).alias("pct"), "weight", rounded(F.col("points"), 6).alias("points")),
    "rpt_metric_dictionary": lambda s, sf: config.metric_dimension(s).join(missing(s, sf), "metric", "left").select("metric", "category", "higher", "generic", "bank", "missing_pct"),
    "rpt_quality_summary": lambda s, sf: missing(s, sf).agg(F.count(F.lit(1)).alias("metrics"), rounded(F.lit(100) - F.avg("missing_pct"), 4).alias("coverage")).crossJoin(FD.metrics(s, sf).agg(F.count_if("eps_basis_mismatch").alias("eps_mismatches"))),
    "rpt_sensitivity_pairs": lambda s, sf: D.weight_sensitivity(raw_scored(s, sf), W).groupBy("category").pivot("direction", ["up", "down"]).agg(F.first("jaccard")),
    "weight_sensitivity": lambda s, sf: D.weight_sensitivity(raw_scored(s, sf), W),
    "sensitivity_summary": lambda s, sf: D.sensitivity_summary(D.weight_sensitivity(raw_scored(s, sf), W)),
    "ranking_impact": lambda s, sf: D.ranking_impact(raw_scored(s, sf), W, PROPOSED),
    "category_correlation": lambda s, sf: CO.spearman(spearman_source(raw_scored(s, sf), SCORES), names=SCORES),
    "metric_correlation": lambda s, sf: CO.spearman(ranked(s, sf).select("ticker", F.col("metric").alias("name"), rounded(F.col("pct"), 6).alias("value")), names=METRICS),
    "dispersion": lambda s, sf: D.dispersion(raw_scored(s, sf), CATS),
    "dispersion_regime": lambda s, sf: D.dispersion_regime(dispersion_history(s, sf)).select("category", "n", "latest", rounded(F.col("p25"), 6).alias("p25"), rounded(F.col("p75"), 6).alias("p75"), "regime"),
    "screen_filter": lambda s, sf: R.screen_filter(with_fields(s, sf), sector="BUILDING", traps="clean", least=60.0, search="c1").select("ticker", "composite"),
    "screen_sort": lambda s, sf: R.screen_sort(scored(s, sf), "composite", ascending=False, n=40).select("ticker", "composite"),
    "security_search": lambda s, sf: R.security_search(scored(s, sf).join(metrics(s, sf).select("ticker", "company"), "ticker"), "c12", ["C12"]).select("ticker"),
    "custom_peer_table": lambda s, sf: scored(s, sf).where(F.col("ticker").isin("C1", "C2", "C3", "C5", "C8")).select("ticker", "sector", "composite", "rank"),
    "entity_mentions": lambda s, sf: ME.entity_mentions(views.base(s, sf, "documents"), names(s, sf)),
    **{k: _rule(k) for k in ("dq_market_cap", "dq_negative_ev", "dq_revenue_break", "acc_capex_sign", "acc_cash_mismatch", "acc_dividend_unit", "acc_ebit_ebitda")},
    "dq_missing_critical": lambda s, sf: D.missing_critical(metrics(s, sf), ["ev_ebitda", "roic", "return_12_1"]),
    "dq_winsorized": lambda s, sf: D.winsorized_counts(tall(s, sf)),
    "dq_metric_drift": lambda s, sf: missing(s, sf).where("missing_pct > 50"),
    "dq_sector_coverage": lambda s, sf: D.sector_coverage(metrics(s, sf), METRICS),
    "dq_coverage_excluded": lambda s, sf: metrics(s, sf).select("ticker").join(S.coverage_filter(metrics(s, sf), config.METRICS, METRICS, 0.8).select("ticker"), "ticker", "left_anti"),
    "financial_split": lambda s, sf: metrics(s, sf).where("sector = 'MACHINERY'").agg(F.count(F.lit(1)).alias("financial"), F.count_if("is_bank").alias("banks"), F.count_if(~F.col("is_bank")).alias("others")),
    "dq_severity_counts": lambda s, sf: accuracy(s, sf).groupBy("severity").agg(F.count(F.lit(1)).alias("n")),
    "acc_summary": lambda s, sf: accuracy(s, sf).groupBy("issue", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ticker").alias("tickers")),
}

# -- SQL ---------------------------------------------------------------------------------------------

FU = f"fu AS (SELECT * FROM {views.oracle(views.FUNDAMENTALS)} v)"
FIELDS = SCORED + f", {FU}, wfx AS (SELECT f.*, m.company, m.volatility, m.beta, fu.market_cap, fu.dollar_volume, fu.dividend_rate / nullif(fu.price, 0) AS dividend_yield FROM f JOIN fu ON f.ticker = fu.ticker JOIN m ON f.ticker = m.ticker)"
ELIGIBLE = FIELDS + ", e0 AS (SELECT * FROM wfx WHERE NOT value_trap AND NOT growth_trap), e AS (SELECT * FROM e0 WHERE composite >= (SELECT quantile_cont(composite, 0.5) FROM e0) AND dollar_volume >= 0)"
PORT = ELIGIBLE + ", p0 AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY composite DESC NULLS LAST, ticker) AS k FROM e), p1 AS (SELECT * FROM p0 WHERE k <= 8 ORDER BY composite DESC NULLS LAST, ticker LIMIT 25), pf AS (SELECT *, CAST(row_number() OVER (ORDER BY composite DESC NULLS LAST, ticker) AS INT) AS port_rank FROM p1)"
SCORE_W = PORT + f", ws AS (SELECT *, {rd('greatest(coalesce(composite, (SELECT quantile_cont(composite, 0.5) FROM pf)), 1) / sum(greatest(coalesce(composite, (SELECT quantile_cont(composite, 0.5) FROM pf)), 1)) OVER () * 100', 9)} AS weight FROM pf)"
MED = "coalesce((SELECT quantile_cont(CASE WHEN volatility > 0 THEN volatility END, 0.5) FROM pf), 0.25)"
INV = f"1.0::DOUBLE / greatest(CASE WHEN volatility > 0 THEN volatility ELSE {MED} END, {MED} * 0.1::DOUBLE, 0.05::DOUBLE)"
INV_W = PORT + f", wi AS (SELECT *, {rd(f'{INV} / sum({INV}) OVER () * 100', 9)} AS weight FROM pf)"


def caps(source: str, cap: float = 5.0, rounds: int = 10) -> tuple[str, str]:
    out, last = "", source
    for i in range(rounds):
        ex = f"(SELECT sum(greatest(weight - {cap}::DOUBLE, 0)) FROM {last})"
        room = f"(SELECT sum(CASE WHEN weight <= {cap}::DOUBLE THEN weight ELSE 0 END) FROM {last})"
        free = f"(SELECT count(*) FROM {last} WHERE weight <= {cap}::DOUBLE)"
        new = f"CASE WHEN weight > {cap}::DOUBLE THEN {cap}::DOUBLE WHEN {ex} > 0.001 THEN weight + {ex} * CASE WHEN {room} > 0 THEN weight / {room} ELSE 1.0::DOUBLE / {free} END ELSE weight END"
        out += f", cap{i} AS MATERIALIZED (SELECT * REPLACE ({new} AS weight) FROM {last})"
        last = f"cap{i}"
    return out, last


def to_100(source: str) -> str:
    return f""", z0 AS (SELECT *, {rd('weight / sum(weight) OVER () * 10000', 9)} AS sc FROM {source}), z1 AS (SELECT *, floor(sc) AS wh FROM z0),
 z AS (SELECT * REPLACE ((wh + CASE WHEN row_number() OVER (ORDER BY sc - wh DESC, ticker) <= 10000 - sum(wh) OVER () THEN 1 ELSE 0 END) / 100 AS weight) FROM z1)"""


def mean_w(x: str) -> str:
    return rd(f"sum(weight * {x}) / sum(weight)", 4)


INV_CAP, INV_LAST = caps("wi")
SCORE_CAP, SCORE_LAST = caps("ws")
SCEN = []
for _c in ["base", *CATS]:
    for _sign, _name in ((0, "none"),) if _c == "base" else ((1, "up"), (-1, "down")):
        if _c == "base":
            _w = dict(W)
        else:
            _new = max(0.0, W[_c] + _sign * 5.0)
            _rest = sum(v for k, v in W.items() if k != _c)
            _w = {k: _new if k == _c else round(v * (100 - _new) / _rest, 2) for k, v in W.items()}
        SCEN.append(f"('{_c}', '{_name}', " + ", ".join(f"{_w[k]}::DOUBLE" for k in CATS) + ")")
SENS = (
    RAW
    + f", sc(category, direction, {', '.join('w_' + c for c in CATS)}) AS (VALUES {', '.join(SCEN)}), sx AS (SELECT category, direction, ticker, ({' + '.join(f'coalesce(w_{c} * {c}_score, 0)' for c in CATS)}) AS a, ({' + '.join(f'CASE WHEN {c}_score IS NOT NULL THEN w_{c} ELSE 0 END' for c in CATS)}) AS b FROM s CROSS JOIN sc), sy AS (SELECT category, direction, ticker, row_number() OVER (PARTITION BY category, direction ORDER BY CASE WHEN b > 0 THEN {rd('a / b', 9)} END DESC NULLS LAST, ticker) AS nth FROM sx), sb AS (SELECT * FROM sy WHERE nth <= 20), sz AS (SELECT category, direction, count(*) AS n, count(*) FILTER (ticker IN (SELECT ticker FROM sb WHERE category = 'base')) AS unchanged FROM sb WHERE category <> 'base' GROUP BY ALL), sens AS (SELECT category, direction, unchanged, n - unchanged AS changed, {rd('CAST(unchanged AS DOUBLE) / (2 * n - unchanged)', 4)} AS jaccard FROM sz)"
)


def spearman_sql(prefix: str, source: str) -> str:
    rk = lambda v: f"rank() OVER (PARTITION BY a, b ORDER BY {v}) + (count(*) OVER (PARTITION BY a, b, {v}) - 1) / 2.0::DOUBLE"
    return f"WITH {prefix}, u AS ({source}), j AS (SELECT x.name AS a, y.name AS b, x.value AS x, y.value AS y FROM u x JOIN u y ON x.ticker = y.ticker AND x.name < y.name), k AS (SELECT a, b, {rk('x')} AS rx, {rk('y')} AS ry FROM j) SELECT a, b, {rd('corr(rx, ry)', 3)} AS rho, count(*) AS n FROM k GROUP BY a, b"


def hist(bins: int) -> str:
    return f"WITH {SCORED} SELECT CAST(i AS INT) AS bin, CAST(count(composite) AS BIGINT) AS n FROM range({bins}) g(i) LEFT JOIN f ON least(floor(composite / {100 / bins}::DOUBLE), {bins - 1}) = i GROUP BY i"


def issue(name: str, severity: str, cond: str, detail: str = "''") -> str:
    return f"SELECT ticker, '{name}' AS issue, '{severity}' AS severity, {detail} AS detail FROM fu WHERE {cond}"


RULES = {
    "dq_market_cap": issue("market_cap", "High", "market_cap < 100e6 OR market_cap > 5e12"),
    "dq_negative_ev": issue("negative_ev", "High", "enterprise_value < 0"),
    "dq_revenue_break": issue("revenue_break", "High", "revenue_prior > 0 AND revenue < 0.1::DOUBLE * revenue_prior"),
    "acc_capex_sign": issue("capex_sign", "High", "abs((ocf - abs(capex)) - (ocf + capex)) > 1 OR capex > 0"),
    "acc_cash_mismatch": issue("cash_mismatch", "Medium", "total_cash > 0 AND abs(total_cash - current_assets * 0.1::DOUBLE) / total_cash > 0.1::DOUBLE"),
    "acc_dividend_unit": issue("dividend_unit", "Medium", "price > 0 AND abs(payout_ratio - dividend_rate / price * 100) < 0.5::DOUBLE"),
    "acc_ebit_ebitda": issue("ebit_ebitda", "Medium", "ebitda <> 0 AND abs(1 - ebit / ebitda) > 0.15::DOUBLE", "CASE WHEN abs(1 - ebit / ebitda) > 0.3::DOUBLE THEN 'high' ELSE 'low' END"),
}
ALL_RULES = " UNION ALL ".join(RULES.values())
IMPACT = lambda w: " + ".join(f"{float(v)}::DOUBLE * coalesce({c}_score, 0)" for c, v in w.items())
PCT_T = PCT.replace("SELECT ticker, sector, is_bank, metric, category, generic, weight, CASE WHEN higher", "SELECT ticker, sector, is_bank, metric, category, generic, weight, value, CASE WHEN higher")
ROUND_SCORES = ", ".join(f"{rd(c, 6)} AS {c}" for c in SCORES)

SOURCES = f"la AS (SELECT * FROM {views.oracle(views.STATEMENT_LINES)} v UNION ALL SELECT * FROM {views.oracle(views.ANNUAL_LINES)} v), lk AS (SELECT *, row_number() OVER (PARTITION BY ticker, statement, freq, label ORDER BY period_end DESC) - 1 AS k FROM la WHERE value IS NOT NULL), ls AS (SELECT ticker, statement, label, count(*) FILTER (freq = 'Q' AND k < 4) AS q, count(*) FILTER (freq = 'A' AND k = 0) AS a FROM lk GROUP BY 1, 2, 3), lt AS (SELECT ticker, CASE WHEN bool_or(statement = 'income' AND q >= 3 AND label IN ('Total Revenue', 'Net Income', 'EBIT')) THEN CASE WHEN bool_or(statement = 'income' AND q >= 3) THEN 'quarterly' END WHEN bool_or(statement = 'income' AND a > 0) THEN 'annual' END AS source, bool_or(q = 3) AS annualized FROM ls GROUP BY 1)"
PROVENANCE = f"{SOURCES}, pv_ AS (SELECT m.ticker, CAST({' + '.join(f'CAST(m.{c} IS NOT NULL AS INT)' for c in config.KEY_METRICS)} AS INT) AS present, {len(config.KEY_METRICS)} AS total, coalesce(lt.source, 'unknown') AS source, coalesce(lt.annualized, false) AS annualized FROM m LEFT JOIN lt ON lt.ticker = m.ticker)"
_TAIL = f"bt_a AS (SELECT ticker, ret, row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) AS i FROM z_r), bt_c AS (SELECT ret AS mkt, row_number() OVER (ORDER BY dt DESC) AS i FROM z_m), bt_v AS (SELECT ticker AS series, CASE WHEN count(*) >= 200 AND var_samp(mkt) > 0 THEN covar_samp(ret, mkt) / var_samp(mkt) END AS beta FROM bt_a JOIN bt_c USING (i) GROUP BY 1)"
_CHECKS = [("ev_ebitda", "CASE WHEN enterprise_value <> 0 AND ebitda > 0 THEN enterprise_value / ebitda END", 0.5), ("earnings_yield", "CASE WHEN trailing_eps <> 0 AND price > 0 THEN trailing_eps / price END", 0.005), ("forward_eps_growth", "CASE WHEN forward_eps <> 0 AND abs(trailing_eps) > 0.01 THEN (forward_eps - trailing_eps) / abs(trailing_eps) END", 0.01), ("beta", "CASE WHEN bt_v.beta <> 0 AND m.beta IS NOT NULL THEN bt_v.beta END", 0.15)]
_SNAP = {
    "revenue_growth_yoy": rd("CASE WHEN abs(revenue_prior) > 0 THEN (revenue - revenue_prior) / abs(revenue_prior) END", 4), "ni_growth_yoy": rd("CASE WHEN abs(net_income_prior) > 0 THEN (net_income - net_income_prior) / abs(net_income_prior) END", 4),
    "gross_margin": rd("CASE WHEN revenue > 0 THEN gross_profit / revenue END", 4), "net_margin": rd("CASE WHEN revenue > 0 THEN net_income / revenue END", 4), "fcf": rd("ocf - abs(capex)", 2), "net_debt": rd("total_debt - total_cash", 2), "dividend_yield": rd("CASE WHEN price > 0 THEN dividend_rate / price END", 4),
}


def bands_sql() -> str:
    exposure = " UNION ALL ".join(f"SELECT '{c}' AS item, {mean_w(f'coalesce({c}_score, 50)')} AS value FROM ws" for c in CATS)
    return f"""WITH z1 AS ({ORACLE_SQL['pf_vs_benchmark']}), z2 AS (WITH {SCORE_W} {exposure}), z3 AS ({ORACLE_SQL['weight_sensitivity']}), z4 AS ({ORACLE_SQL['category_correlation']})
 SELECT 'sector_delta' AS summary, sector AS item, active AS value, CASE WHEN abs(active) <= 5 THEN 'near' WHEN abs(active) <= 10 THEN 'off' ELSE 'far' END AS band FROM z1
 UNION ALL SELECT 'exposure', item, value, CASE WHEN value >= 65 THEN 'strong' WHEN value >= 50 THEN 'fair' ELSE 'weak' END FROM z2
 UNION ALL SELECT 'jaccard', category || ' ' || direction, jaccard, CASE WHEN jaccard >= 0.85 THEN 'robust' WHEN jaccard < 0.7 THEN 'sensitive' ELSE 'fair' END FROM z3
 UNION ALL SELECT 'correlation', a || ' ' || b, rho, CASE WHEN rho IS NULL THEN NULL WHEN abs(rho) > 0.99 THEN 'same' WHEN abs(rho) > 0.8 THEN 'very high' WHEN abs(rho) > 0.6 THEN 'high' ELSE 'low' END FROM z4"""


ORACLE_SQL = {
    "provenance": f"WITH {M}, {PROVENANCE} SELECT pv_.*, {rd('target_price', 4)} AS target_price, n_analysts AS analysts FROM pv_ JOIN z_e ON z_e.ticker = pv_.ticker",
    "eps_mismatch_counts": f"WITH {M}, {PROVENANCE} SELECT count(*) FILTER ({FD.FLAGS['eps_basis_mismatch']}) AS eps_mismatches, count(*) FILTER (annualized) AS annualized, count(*) AS n FROM pv_ JOIN z_e ON z_e.ticker = pv_.ticker",
    "acc_recompute": f"WITH {M}, {_TAIL}, x AS (" + " UNION ALL ".join(f"SELECT m.ticker, '{c}' AS \"check\", m.{c} AS scored, {anew} AS anew, {most}::DOUBLE AS most FROM m JOIN z_e ON z_e.ticker = m.ticker LEFT JOIN bt_v ON bt_v.series = z_e.series" for c, anew, most in _CHECKS) + f") SELECT ticker, \"check\", {rd('scored', 4)} AS scored, {rd('anew', 4)} AS anew FROM x WHERE anew IS NOT NULL AND (scored IS NULL OR abs(scored - anew) >= most)",
    "acc_statement_dates": f"SELECT * FROM (SELECT ticker, max(period_end) FILTER (statement = 'income') AS income, max(period_end) FILTER (statement = 'balance') AS balance FROM (SELECT * FROM {views.oracle(views.STATEMENT_LINES)} v WHERE value IS NOT NULL UNION ALL SELECT * FROM {views.oracle(views.ANNUAL_LINES)} v WHERE statement = 'balance') z GROUP BY 1) y WHERE income <> balance",
    "rpt_company_snapshot": f"WITH {FU} SELECT ticker, {', '.join(f'{rd(_SNAP.get(c, c), 4)} AS {c}' for c in SNAPSHOT)} FROM fu",
    "rpt_category_forensics": f"WITH {RAW} " + " UNION ALL ".join(f"SELECT ticker, '{c}' AS category, {rd(f'{c}_score', 6)} AS score, {rd(f'{c}_score * {w}::DOUBLE', 6)} AS points, {float(w)}::DOUBLE AS weight FROM s" for c, w in W.items()),
    "rpt_validation_top10": f"WITH {SCORED}, {FU}, {PROVENANCE} SELECT f.rank, f.ticker, f.composite, f.value_trap, f.growth_trap, {', '.join(f'(SELECT {FD.FLAGS.get(c, c)} FROM z_e WHERE z_e.ticker = f.ticker) AS {c}' for c in FLAGS)}, (SELECT {rd(FD.RATIO, 2)} FROM z_e WHERE z_e.ticker = f.ticker) AS eps_ratio, {', '.join(f'm.{c}' for c in R.SHOWN)}, {rd('fu.price', 4)} AS price, {rd('fu.target_price', 4)} AS target_price, fu.n_analysts, pv_.present, pv_.total, pv_.source, pv_.annualized FROM f JOIN m ON m.ticker = f.ticker JOIN fu ON fu.ticker = f.ticker LEFT JOIN pv_ ON pv_.ticker = f.ticker WHERE f.rank <= 10",
    "pf_eligible": f"WITH {ELIGIBLE} SELECT ticker, composite FROM e",
    "pf_select": f"WITH {PORT} SELECT ticker, sector, port_rank FROM pf",
    "pf_rank": f"WITH {PORT} SELECT port_rank, ticker, composite FROM pf",
    "pf_weight_equal": f"WITH {PORT} SELECT ticker, {rd('100.0::DOUBLE / count(*) OVER ()', 2)} AS weight FROM pf",
    "pf_weight_invvol": f"WITH {INV_W} SELECT ticker, {rd('weight', 4)} AS weight FROM wi",
    "pf_weight_score": f"WITH {SCORE_W} SELECT ticker, {rd('weight', 4)} AS weight FROM ws",
    "pf_cap_redistribute": f"WITH {INV_W}{INV_CAP} SELECT ticker, {rd('weight', 4)} AS weight FROM {INV_LAST}",
    "pf_round_to_100": f"WITH {SCORE_W}{to_100('ws')} SELECT ticker, weight FROM z",
    "pf_stats": f"WITH {SCORE_W} SELECT count(*) AS n, {mean_w('composite')} AS composite, {mean_w('coalesce(beta, 1)')} AS beta, {mean_w('coalesce(dividend_yield, 0)')} AS dividend_yield FROM ws",
    "pf_sector_alloc": f"WITH {SCORE_W} SELECT sector, count(*) AS n, {rd('sum(weight)', 4)} AS weight, count(*) >= 8 AS at_cap FROM ws GROUP BY sector",
    "pf_factor_exposure": f"WITH {SCORE_W} " + " UNION ALL ".join(f"SELECT '{c}' AS category, {mean_w(f'coalesce({c}_score, 50)')} AS exposure FROM ws" for c in CATS),
    "pf_vs_benchmark": f"WITH {SCORE_W}, ow AS (SELECT sector, sum(weight) AS w FROM ws GROUP BY 1), b0 AS (SELECT sector, sum(market_cap) AS w FROM fu GROUP BY 1), b AS (SELECT sector, w / sum(w) OVER () * 100 AS w FROM b0) SELECT coalesce(o.sector, b.sector) AS sector, {rd('coalesce(o.w, 0)', 4)} AS portfolio, {rd('coalesce(b.w, 0)', 4)} AS benchmark, {rd('coalesce(o.w, 0) - coalesce(b.w, 0)', 4)} AS active FROM ow o FULL JOIN b ON o.sector = b.sector",
    "pf_naive_top_n": f"WITH {SCORED} SELECT ticker, rank FROM f WHERE NOT value_trap AND NOT growth_trap ORDER BY rank ASC NULLS LAST, ticker LIMIT 25",
    "rpt_holdings": f"WITH {SCORE_W}{SCORE_CAP}{to_100(SCORE_LAST)} SELECT port_rank, ticker, company, sector, composite, weight, 'score' AS method FROM z",
    "rpt_portfolio_simple": f"WITH {PORT} SELECT sector, count(*) AS n, {rd('avg(beta)', 4)} AS beta, {rd('avg(composite)', 4)} AS composite FROM pf GROUP BY sector",
    "rpt_factor_scores": f"WITH {FIELDS} SELECT ticker, company, sector, {', '.join(f'{rd(c, 1)} AS {c}' for c in SCORES)}, composite, rank, value_trap, growth_trap FROM wfx",
    "rpt_top_n": f"WITH {SCORED}, b AS (SELECT count(composite) AS n, quantile_cont(composite, 0.25) AS q1, quantile_cont(composite, 0.5) AS q2, quantile_cont(composite, 0.75) AS q3 FROM f) SELECT rank, ticker, sector, composite, CASE WHEN composite >= CASE WHEN n >= 4 THEN q3 ELSE 70 END THEN 'Q1' WHEN composite >= CASE WHEN n >= 4 THEN q2 ELSE 55 END THEN 'Q2' WHEN composite >= CASE WHEN n >= 4 THEN q1 ELSE 40 END THEN 'Q3' ELSE 'Q4' END AS band FROM f CROSS JOIN b WHERE rank <= 25",
    "rpt_bottom_n": f"WITH {SCORED} SELECT rank, ticker, composite FROM f WHERE rank IS NOT NULL ORDER BY rank DESC, ticker DESC LIMIT 5",
    "rpt_sector_summary": f"WITH {SCORED}, a AS (SELECT sector, {rd('avg(composite)', 2)} AS mean, count(*) AS n, count(*) FILTER (rank <= 25) AS in_top FROM f GROUP BY sector) SELECT *, CASE WHEN mean IS NULL THEN NULL WHEN mean >= 60 THEN 'high' WHEN mean >= 45 THEN 'medium' ELSE 'low' END AS band FROM a",
    "rpt_score_distribution": hist(10),
    "rpt_histogram20": hist(20),
    "rpt_trap_by_sector": f"WITH {SCORED} SELECT sector, count(*) AS n, count(*) FILTER (value_trap) AS value_traps, {rd('CAST(count(*) FILTER (value_trap) AS DOUBLE) / count(*) * 100', 2)} AS value_rate, count(*) FILTER (growth_trap) AS growth_traps, {rd('CAST(count(*) FILTER (growth_trap) AS DOUBLE) / count(*) * 100', 2)} AS growth_rate FROM f GROUP BY sector",
    "rpt_sector_distribution": f"WITH {RAW}, rs AS (SELECT sector, {ROUND_SCORES} FROM s), u AS (UNPIVOT rs ON {', '.join(SCORES)} INTO NAME factor VALUE value), k AS (SELECT *, row_number() OVER (PARTITION BY factor, sector ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY factor, sector) AS n FROM u) SELECT factor, sector, min(value) AS low, max(value) FILTER (i = n // 4) AS q1, max(value) FILTER (i = n // 2) AS median, max(value) FILTER (i = 3 * n // 4) AS q3, max(value) AS high, {rd('avg(value)', 4)} AS mean, count(*) AS n FROM k GROUP BY factor, sector",
    "rpt_kpis": f"WITH {SCORED} SELECT count(*) AS universe, count(composite) AS scored, count(*) FILTER (value_trap) AS value_traps, count(*) FILTER (growth_trap) AS growth_traps, {rd('avg(composite)', 2)} AS mean, {rd('quantile_cont(composite, 0.5)', 2)} AS median FROM f",
    "rpt_peers": f"WITH {FU}, h AS (SELECT ticker, sector, market_cap FROM fu WHERE market_cap > 0), j AS (SELECT a.ticker, b.ticker AS peer, abs(b.market_cap / a.market_cap - 1) AS d FROM h a JOIN h b ON a.sector = b.sector AND a.ticker <> b.ticker), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY ticker ORDER BY d, peer) AS INT) AS nth FROM j) SELECT ticker, peer, nth, {rd('d', 6)} AS distance FROM k WHERE nth <= 5",
    "rpt_sector_context": f"WITH {SCORED}, u AS (UNPIVOT (SELECT sector, {', '.join(METRICS[:8])} FROM m WHERE sector IN (SELECT sector FROM f WHERE rank <= 10)) ON {', '.join(METRICS[:8])} INTO NAME metric VALUE value) SELECT sector, metric, count(*) AS n, {rd('quantile_cont(value, 0.25)', 6)} AS q25, {rd('quantile_cont(value, 0.5)', 6)} AS median, {rd('quantile_cont(value, 0.75)', 6)} AS q75 FROM u GROUP BY ALL HAVING count(*) >= 3",
    "rpt_flags": f"WITH {SCORED} SELECT ticker, value_trap, growth_trap, insufficient_data, CAST(value_trap_severity AS DOUBLE) AS value_trap_severity, CAST(growth_trap_severity AS DOUBLE) AS growth_trap_severity FROM f",
    "rpt_score_forensics": f"WITH {PCT_T} SELECT ticker, category, metric, {rd('value', 6)} AS value, {rd('pct', 6)} AS pct, weight, CASE WHEN sum(weight) OVER (PARTITION BY ticker, category) > 0 THEN {rd('weight * pct / sum(weight) OVER (PARTITION BY ticker, category)', 6)} END AS points FROM p",
    "rpt_metric_dictionary": f"WITH {M}, {config.dimension_sql()}, mp AS ({MISSING}) SELECT metric, category, higher, generic, bank, missing_pct FROM dim LEFT JOIN mp USING (metric)",
    "rpt_quality_summary": f"WITH {M}, mp AS ({MISSING}) SELECT count(*) AS metrics, {rd('100 - avg(missing_pct)', 4)} AS coverage, (SELECT count(*) FROM z_e WHERE {FD.FLAGS['eps_basis_mismatch']}) AS eps_mismatches FROM mp",
    "rpt_sensitivity_pairs": f"WITH {SENS} SELECT category, max(jaccard) FILTER (direction = 'up') AS up, max(jaccard) FILTER (direction = 'down') AS down FROM sens GROUP BY category",
    "weight_sensitivity": f"WITH {SENS} SELECT * FROM sens",
    "sensitivity_summary": f"WITH {SENS} SELECT {rd('avg(jaccard)', 4)} AS mean, min(jaccard) AS least, (SELECT category FROM sens ORDER BY jaccard, category LIMIT 1) AS most_sensitive FROM sens",
    "ranking_impact": f"WITH {RAW}, a AS (SELECT ticker FROM s ORDER BY {rd(f'({IMPACT(W)}) / 100.0::DOUBLE', 9)} DESC, ticker LIMIT 20), b AS (SELECT ticker FROM s ORDER BY {rd(f'({IMPACT(PROPOSED)}) / {float(sum(PROPOSED.values()))}::DOUBLE', 9)} DESC, ticker LIMIT 20) SELECT coalesce(a.ticker, b.ticker) AS ticker, CASE WHEN a.ticker IS NOT NULL AND b.ticker IS NOT NULL THEN 'stays' WHEN b.ticker IS NOT NULL THEN 'enters' ELSE 'leaves' END AS change FROM a FULL JOIN b ON a.ticker = b.ticker",
    "category_correlation": spearman_sql(RAW, f"SELECT ticker, name, value FROM (UNPIVOT s ON {', '.join(SCORES)} INTO NAME name VALUE value) z"),
    "metric_correlation": spearman_sql(PCT, f"SELECT ticker, metric AS name, {rd('pct', 6)} AS value FROM p"),
    "dispersion": f"WITH {RAW} " + " UNION ALL ".join(f"SELECT '{c}' AS category, CASE WHEN count({c}_score) >= 10 THEN {rd(f'stddev_samp({c}_score)', 4)} END AS dispersion FROM s" for c in CATS),
    "dispersion_regime": f"WITH h AS (SELECT right(ticker, 1) AS category, month_end AS dt, {rd('stddev_samp(close) / 1000', 4)} AS dispersion FROM {views.oracle(views.PRICES_MONTHLY)} v GROUP BY 1, 2), a AS (SELECT category, count(dispersion) AS n, arg_max(dispersion, dt) AS latest, quantile_cont(dispersion, 0.25) AS p25, quantile_cont(dispersion, 0.75) AS p75 FROM h GROUP BY 1) SELECT category, n, latest, {rd('p25', 6)} AS p25, {rd('p75', 6)} AS p75, CASE WHEN n < 12 THEN 'unknown' WHEN latest > p75 THEN 'high' WHEN latest < p25 THEN 'low' ELSE 'normal' END AS regime FROM a",
    "screen_filter": f"WITH {FIELDS} SELECT ticker, composite FROM wfx WHERE sector = 'BUILDING' AND NOT value_trap AND NOT growth_trap AND (composite IS NULL OR composite >= 60) AND (contains(lower(ticker), 'c1') OR contains(lower(company), 'c1'))",
    "screen_sort": f"WITH {SCORED} SELECT ticker, composite FROM f ORDER BY composite DESC NULLS LAST, ticker LIMIT 40",
    "security_search": f"WITH {M} SELECT ticker FROM m WHERE (contains(lower(ticker), 'c12') OR contains(lower(company), 'c12')) AND ticker <> 'C12' ORDER BY ticker LIMIT 8",
    "custom_peer_table": f"WITH {SCORED} SELECT ticker, sector, composite, rank FROM f WHERE ticker IN ('C1', 'C2', 'C3', 'C5', 'C8')",
    "entity_mentions": r"""WITH n0(entity, name, word) AS (SELECT n_name, n_name, true FROM nation UNION SELECT p_name, p_name, true FROM part UNION SELECT CAST(item_id AS VARCHAR), array_to_string(string_split(text, ' ')[1:3], ' '), true FROM benchmark
  UNION SELECT CAST(s_suppkey AS VARCHAR), CAST(s_suppkey AS VARCHAR), true FROM supplier UNION SELECT CAST(s_suppkey AS VARCHAR), CASE WHEN length(string_split_regex(lower(s_name), '[\s,]+')[1]) >= 4 THEN string_split_regex(lower(s_name), '[\s,]+')[1] END, false FROM supplier
  UNION SELECT c_mktsegment, c_mktsegment, false FROM customer UNION VALUES ('common', 'the', true), ('common', 'of', true), ('rare', 'stupid', true)),
 n AS (SELECT entity, lower(name) AS name, word, CASE WHEN regexp_matches(lower(name), '^[a-z0-9_]') THEN '(^|[^a-z0-9_])' ELSE '' END || regexp_escape(lower(name)) || CASE WHEN regexp_matches(lower(name), '[a-z0-9_]$') THEN '($|[^a-z0-9_])' ELSE '' END AS rule FROM n0 WHERE name <> ''),
 d AS (SELECT doc_id, lower(text) AS text FROM documents)
 SELECT DISTINCT doc_id, entity FROM d JOIN n ON contains(text, name) AND (NOT word OR regexp_matches(text, rule))""",
    **{k: f"WITH {FU} {v}" for k, v in RULES.items()},
    "dq_missing_critical": f"WITH {M} " + " UNION ALL ".join(f"SELECT ticker, 'missing_metric' AS issue, 'Medium' AS severity, '{c}' AS detail FROM m WHERE {c} IS NULL" for c in ("ev_ebitda", "roic", "return_12_1")),
    "dq_winsorized": f"WITH {TALL}, l AS (SELECT metric, count(*) AS n, quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.99) AS p99 FROM t GROUP BY 1) SELECT t.metric, count(*) AS n FROM t JOIN l ON t.metric = l.metric AND l.n > 10 WHERE value <= p01 OR value >= p99 GROUP BY 1",
    "dq_metric_drift": f"WITH {M}, mp AS ({MISSING}) SELECT * FROM mp WHERE missing_pct > 50",
    "dq_sector_coverage": f"WITH {M}, g AS (" + " UNION ALL ".join(f"SELECT sector, count(*) AS stocks, '{c}' AS metric, CAST(count({c}) AS DOUBLE) / count(*) * 100 AS pct FROM m GROUP BY sector" for c in METRICS) + f") SELECT sector, stocks, {rd('avg(pct)', 4)} AS coverage, arg_min(metric, (pct, metric)) AS worst_metric, {rd('min(pct)', 4)} AS worst_pct, {rd('avg(pct)', 4)} < 70 AS alert FROM g GROUP BY sector, stocks",
    "dq_coverage_excluded": None,
    "financial_split": f"WITH {M} SELECT count(*) AS financial, count(*) FILTER (is_bank) AS banks, count(*) FILTER (NOT is_bank) AS others FROM m WHERE sector = 'MACHINERY'",
    "dq_severity_counts": f"WITH {FU}, a AS ({ALL_RULES}) SELECT severity, count(*) AS n FROM a GROUP BY 1",
    "acc_summary": f"WITH {FU}, a AS ({ALL_RULES}) SELECT issue, severity, count(*) AS n, count(DISTINCT ticker) AS tickers FROM a GROUP BY 1, 2",
}
from .scoring import COVERED  # noqa: E402

ORACLE_SQL["dq_coverage_excluded"] = f"WITH {M} SELECT ticker FROM ({COVERED}) y WHERE NOT present >= greatest(1, floor(applicable * 0.8::DOUBLE))"
ORACLE_SQL["rpt_summary_bands"] = bands_sql()
