"""Weight proposals from the information coefficients of categories and metrics, further checks, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions.stats import rounded
from ..operators import proposals as P
from ..sources import views as V
from . import backtests as BT
from . import fundamentals as FD
from . import series as SR
from .scoring import rd

#: Dates in a row that a metric's coefficient must be of one sign for a change; the default of the operator is a year's.
RUN = 1
WEIGHTS = config.CATEGORY_WEIGHTS
BOUNDS = config.CATEGORY_BOUNDS


def trends(s: SparkSession, sf: str) -> DataFrame:
    """Of the category scores' coefficients over a month."""
    return BT.QUERIES["ic_trends"](s, sf)


def ics(s: SparkSession, sf: str) -> DataFrame:
    """Each category with its weight, its bounds and its coefficient, if it has a trend."""
    weights = s.createDataFrame([(c, w, *BOUNDS[c]) for c, w in WEIGHTS.items()], "category string, weight double, low double, high double")
    mine = trends(s, sf).select(F.regexp_replace("factor", "_score$", "").alias("category"), F.col("ewm").alias("ic"))
    return weights.join(F.broadcast(mine), "category", "left")


def metric_trends(s: SparkSession, sf: str) -> DataFrame:
    """Trends of the metrics' coefficients with the metrics' categories and generic weights; a metric without a trend is not there."""
    found = SR.r6(BT.metric_trends(s, sf), "ewm", "positive_pct")
    return config.metric_dimension(s).select("category", "metric", F.col("generic").alias("weight")).join(found.withColumnRenamed("factor", "metric"), "metric").select("category", "metric", "weight", "ewm", "positive_run", "negative_run", "positive_pct")


def metric_ics(s: SparkSession, sf: str) -> DataFrame:
    return metric_trends(s, sf).where("weight > 0").select("category", "metric", F.col("ewm").alias("ic"), "weight")


def regimes(s: SparkSession, sf: str) -> DataFrame:
    return trends(s, sf).select(F.regexp_replace("factor", "_score$", "").alias("category"), F.when(F.col("tail_3") > F.col("mean"), "high").otherwise("low").alias("regime"))


QUERIES = {
    "ic_allocation": lambda s, sf: P.ic_allocation(ics(s, sf)).select("category", rounded(F.col("target"), 4).alias("target")),
    "weight_constraints": lambda s, sf: P.constrain(P.ic_allocation(ics(s, sf))).select("category", "weight", rounded(F.col("target"), 6).alias("target"), "proposed"),
    "weight_proposal": lambda s, sf: P.propose(ics(s, sf), observations=30),
    "metric_weight_proposal": lambda s, sf: P.metric_proposal(metric_ics(s, sf)),
    "regime_adjust": lambda s, sf: P.regime_adjust(ics(s, sf).select("category", "weight"), regimes(s, sf)),
    "metric_evolution": lambda s, sf: P.metric_evolution(metric_trends(s, sf), run=RUN, candidates=config.CANDIDATES),
    "bt_price_date": lambda s, sf: _price_date(s, sf),
    "return_12m": lambda s, sf: FD.metrics(s, sf).select("ticker", rounded(F.col("return_12m"), 5).alias("return_12m")),
}


def _price_date(s: SparkSession, sf: str) -> DataFrame:
    """First trading day from five days before each month's end on: both meet by month, or by the next one."""
    ends = SR.months(s, sf).select("month_end").withColumn("m", F.explode(F.array(F.trunc("month_end", "month"), F.add_months(F.trunc("month_end", "month"), 1))))
    days = SR.market(s, sf).select("dt", F.trunc("dt", "month").alias("m"))
    return ends.join(days, "m").where(F.col("dt") >= F.date_sub("month_end", 5)).groupBy("month_end").agg(F.min("dt").alias("price_date"))


# -- SQL ---------------------------------------------------------------------------------------------

TR = BT.ORACLE_SQL["ic_trends"]
W0 = "w0(category, weight, low, high) AS (VALUES " + ", ".join(f"('{c}', {w}::DOUBLE, {BOUNDS[c][0]}::DOUBLE, {BOUNDS[c][1]}::DOUBLE)" for c, w in WEIGHTS.items()) + ")"
ICS = f"tr AS ({TR}), {W0}, i AS (SELECT w0.*, ewm AS ic, greatest(coalesce(ewm, 0), 0) AS pos FROM w0 LEFT JOIN tr ON factor = category || '_score')"
MT = f"mt AS ({BT.ORACLE_SQL['metric_ic_trends']}), {config.dimension_sql()}, ev AS (SELECT category, metric, generic AS weight, ewm, positive_run, negative_run, positive_pct FROM dim JOIN mt ON mt.factor = dim.metric)"
CANDIDATES = ", ".join(f"'{c}'" for c in config.CANDIDATES)
CHANGES = f"{MT}, ch AS (SELECT category, metric, 'activate' AS action, weight, 5::DOUBLE AS new_weight FROM ev WHERE metric IN ({CANDIDATES}) AND weight = 0 AND ewm >= 0.02 AND positive_run >= {RUN} AND positive_pct >= 60 QUALIFY row_number() OVER (ORDER BY ewm DESC, metric) <= 1 UNION ALL SELECT category, metric, 'lower', weight, greatest(0, weight - 5) FROM ev WHERE metric NOT IN ({CANDIDATES}) AND weight > 0 AND ewm <= 0 AND negative_run >= {RUN})"
ALLOC = ICS + ", al AS (SELECT *, CASE WHEN sum(pos) OVER () > 0 THEN CASE WHEN pos > 0 THEN (100 - sum(CASE WHEN pos > 0 THEN 0 ELSE low END) OVER ()) * pos / sum(pos) OVER () ELSE low END ELSE low + (100 - sum(low) OVER ()) / count(*) OVER () END AS target FROM i)"


def constrained(source: str, target: str) -> str:
    inside = lambda x: f"least(greatest({x}, low), high)"
    return f""", k0 AS (SELECT *, {rd(inside(f'least(greatest({inside(target)}, weight - 3), weight + 3)'), 1)} AS p0 FROM {source}), k1 AS (SELECT *, {rd('p0 * 100 / sum(p0) OVER ()', 1)} AS p FROM k0),
 k AS (SELECT *, {rd('CASE WHEN row_number() OVER (ORDER BY p DESC, category) = 1 THEN p + 100 - sum(p) OVER () ELSE p END', 1)} AS proposed FROM k1)"""


ORACLE_SQL = {
    "ic_allocation": f"WITH {ALLOC} SELECT category, {rd('target', 4)} AS target FROM al",
    "weight_constraints": f"WITH {ALLOC}{constrained('al', 'target')} SELECT category, weight, {rd('target', 6)} AS target, proposed FROM k",
    "weight_proposal": f"WITH {ALLOC}{constrained('al', '(weight * 0.5 + target * 0.5)')}, c AS (SELECT category, weight, proposed, {rd('proposed - weight', 1)} AS change FROM k) SELECT *, CASE WHEN change > 0 THEN 'up' WHEN change < 0 THEN 'down' ELSE 'same' END AS direction, 'medium' AS confidence, max(abs(change)) OVER () <= 2 AS auto_apply FROM c",
    "metric_weight_proposal": f"WITH {MT}, i AS (SELECT category, metric, weight, greatest(coalesce(ewm, 0), 0) AS pos FROM ev WHERE weight > 0), a AS (SELECT *, CASE WHEN sum(pos) OVER k > 0 THEN weight * 0.5 + 0.5 * 100 * pos / sum(pos) OVER k ELSE weight END AS aim FROM i WINDOW k AS (PARTITION BY category)), b AS (SELECT *, greatest(0, least(greatest(aim, weight - 5), weight + 5)) AS p FROM a) SELECT category, metric, weight, {rd('p * 100 / sum(p) OVER (PARTITION BY category)', 2)} AS proposed FROM b",
    "regime_adjust": f"WITH {ICS}, r AS (SELECT factor, CASE WHEN tail_3 > mean THEN 'high' ELSE 'low' END AS regime FROM tr), a AS (SELECT category, weight, regime, weight * CASE regime WHEN 'high' THEN 1.1::DOUBLE WHEN 'low' THEN 0.9::DOUBLE ELSE 1 END AS x FROM i LEFT JOIN r ON factor = category || '_score') SELECT category, weight, regime, {rd('x * 100 / sum(x) OVER ()', 4)} AS adjusted FROM a",
    "metric_evolution": f"WITH {CHANGES} SELECT * FROM ch",
    "bt_price_date": f"WITH {SR.D}{SR.MK}, {SR.MO} SELECT mm.month_end, min(dt) AS price_date FROM mm JOIN k ON dt >= mm.month_end - 5 GROUP BY 1",
    "return_12m": f"{FD.SRC} SELECT ticker, {rd(FD.SQL['return_12m'], 5)} AS return_12m FROM e",
}
