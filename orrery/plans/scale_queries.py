"""Named queries over records and groups that are larger than a task, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as names
from ..operators import charts, long_records, selection
from .base import WK, load, points_sql, rounded
from .series_queries import CUSUM_PARTS, MOVING_RANGE_SQL, SHEWHART_SQL, cusum_points_sql
from .wide_queries import BASELINE, DIGITS, FULL, ORDER, _family

CHART = charts.Chart()
#: Values of a group that a task may hold in these queries, small enough that larger groups are narrowed by histograms.
HOLD = 4096
LONG = names.SHEWHART + names.CUSUM + names.EWMA + names.MOVING_RANGE


def long_series(spark, sf):
    """All line items as three series, one for each return flag."""
    items = load(spark, sf, "lineitem").withColumn("rr_ms", F.col("l_quantity") * 25.0).withColumn("record_id", F.col("l_returnflag"))
    return long_records.clocked(items.select("record_id", "l_suppkey", *ORDER, "rr_ms"), [*ORDER, "l_suppkey"], BASELINE)


def long_charts(spark, sf):
    return long_records.record_charts(long_series(spark, sf), CHART, HOLD)


_LONG_SOURCE = f"SELECT l_returnflag AS record_id, row_number() OVER (PARTITION BY l_returnflag ORDER BY {', '.join(ORDER)}, l_suppkey) - 1 AS idx, l_quantity * 25.0 AS rr_ms FROM lineitem"
_KEEP, _CUT = 1 - CHART.weight, 200
_BOUND = CHART.ewma_limit * (CHART.weight / (2.0 - CHART.weight)) ** 0.5
# blocks of 200: what lies further back than one block before weighs less than 1e-19
LONG_EWMA_SQL = f"""x1 AS (SELECT *, pos // {_CUT} AS c FROM w), x2 AS (SELECT {WK}, c, sum(z * pow({_KEEP}::DOUBLE, -(pos - {_CUT} * c))) AS s FROM x1 GROUP BY {WK}, c),
x3 AS (SELECT x1.*, {CHART.weight} * (pow({_KEEP}::DOUBLE, pos - {_CUT} * x1.c) * sum(z * pow({_KEEP}::DOUBLE, -(pos - {_CUT} * x1.c))) OVER (PARTITION BY x1.record_id, x1.c ORDER BY pos ROWS UNBOUNDED PRECEDING)
  + pow({_KEEP}::DOUBLE, pos - {_CUT} * (x1.c - 1)) * coalesce(x2.s, 0.0)) AS ew FROM x1 LEFT JOIN x2 ON x1.record_id = x2.record_id AND x2.c = x1.c - 1),
ewp AS (SELECT {WK}, arg_max(ew, pos) AS ewma_last, max(abs(ew)) AS ewma_max_abs, regr_slope(ew, pos) FILTER (pos >= n // 2) AS ewma_slope, CAST(count(*) FILTER (abs(ew) > {_BOUND}) AS DOUBLE) AS ewma_alarm_count,
  min(t_local) FILTER (abs(ew) > {_BOUND}) AS ewma_first_alarm_time_sec FROM x3 GROUP BY {WK})"""


def _long_sql() -> str:
    parts = {"shp": SHEWHART_SQL, "cup": f"{cusum_points_sql('w', WK, CHART.h)}, {CUSUM_PARTS}", "mrp": MOVING_RANGE_SQL}
    bodies = ", ".join([*[_family(b, n) for n, b in parts.items()], LONG_EWMA_SQL])
    joined = " ".join(f"JOIN {n} USING ({WK})" for n in [*parts, "ewp"])
    shown = ", ".join(f"round({c}::DOUBLE, {DIGITS}) + 0.0 AS {c}" for c in LONG)
    return f"""{points_sql(_LONG_SOURCE, BASELINE, (), (), FULL)}, {bodies} SELECT record_id, n_rr, {shown} FROM (SELECT {WK}, count(*) AS n_rr FROM w GROUP BY {WK}) {joined}"""


SHARES = [0.05, 0.5, 0.95]


def group_percentiles(spark, sf):
    """Exact percentiles of prices by return flag and over all lines, groups of any size."""
    items = load(spark, sf, "lineitem").select(F.explode(F.array("l_returnflag", F.lit("all"))).alias("flag"), "l_extendedprice")
    return selection.exact_percentiles(items, ["flag"], F.col("l_extendedprice"), SHARES, HOLD)


QUERIES = {
    "long_record_charts": lambda s, d: rounded(long_charts(s, d), DIGITS),
    "group_percentiles": lambda s, d: rounded(group_percentiles(s, d), 4),
}
ORACLE_SQL = {
    "long_record_charts": _long_sql(),
    "group_percentiles": " UNION ALL ".join(
        f"SELECT {flag} AS flag, {s}::DOUBLE AS share, round(quantile_cont(l_extendedprice, {s}), 4) + 0.0 AS value, count(*) AS n FROM lineitem GROUP BY ALL" for s in SHARES for flag in ("l_returnflag", "'all'")
    ),
}
