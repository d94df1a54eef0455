"""The full window and record tables at their usual settings, over the long series of each supplier, and what is built on them."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import features as names
from ..operators import aggregate, charts, legacy, mahalanobis, stats, window_arrays, windows
from ..operators.intervals import series, with_clock
from .base import CLOCKED_SQL, EVENTS_SQL, KEY_COLUMNS, WK, clocked, clocked_sql, load, points_sql, rounded, sql_rounded, windowed
from .series_queries import CUSUM_PARTS, ECTOPY_SQL, EWMA_SQL, MOVING_RANGE_SQL, POINTS_SQL, RUNS_SQL, SHEWHART_SQL, VARIABILITY_SQL, charted_sql, cusum_points_sql, legacy_sql, pair_columns, scored_sql

COUNTS, SECONDS, FULL, BASELINE = (50, 100, 128, 200), (300.0,), 1800.0, 200
CHART = charts.Chart()
#: Decimals of results over sums of several hundred values.
DIGITS = 6
ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
SERIES_SQL = f"SELECT l_suppkey AS record_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(ORDER)}) - 1 AS idx, l_quantity * 25.0 AS rr_ms FROM lineitem"


def supplier_items(spark, sf):
    return load(spark, sf, "lineitem").withColumn("rr", F.col("l_quantity") * 25.0)


def supplier_intervals(spark, sf, copies=len(COUNTS) + len(SECONDS) + 1):
    """Each supplier's quantities, taken as intervals of 25 ms a unit."""
    return with_clock(series(supplier_items(spark, sf), "l_suppkey", "rr", ORDER, copies), BASELINE)


def all_scales(clocked, counts=COUNTS, seconds=SECONDS):
    return windows.multi_scale(clocked, counts, seconds, FULL, "main")


def supplier_windows(spark, sf):
    """All scales over each supplier's intervals."""
    return all_scales(supplier_intervals(spark, sf))


def window_features(spark, sf, counts=COUNTS, seconds=SECONDS):
    """All features of all windows: from arrays, and by window functions for the records that these do not fit."""
    clocked = supplier_intervals(spark, sf, 1)
    made = lambda rows: window_arrays.all_features(rows, counts, seconds, FULL, CHART, "main")
    if not window_arrays.unfit_records(supplier_items(spark, sf), "l_suppkey", F.col("rr")):
        return made(clocked)
    others = window_arrays.split(supplier_intervals(spark, sf))[1]
    return made(window_arrays.split(clocked)[0]).unionByName(charts.all_features(all_scales(others, counts, seconds), CHART))


def record_features(spark, sf, counts=COUNTS, seconds=SECONDS):
    return aggregate.records_of_windows(pair_columns(window_features(spark, sf, counts, seconds)), names.ALL, FULL)


def whole_record_features(spark, sf):
    """The rows of ``record_features`` for whole records, without the windows of the other scales."""
    return record_features(spark, sf, (), ())


def _family(body: str, name: str) -> str:
    """A family's relations, its result called ``name``."""
    return re.sub(r"(^|[\s,(])r AS \(SELECT", rf"\1{name} AS (SELECT", body)


_BODIES = (VARIABILITY_SQL, SHEWHART_SQL, f"{cusum_points_sql('w', WK, CHART.h)}, {CUSUM_PARTS}", EWMA_SQL, MOVING_RANGE_SQL, RUNS_SQL, ECTOPY_SQL)
_PARTS = ", ".join(_family(body, f"part{i}") for i, body in enumerate(_BODIES))
FEATURES_SQL = f"""{points_sql(SERIES_SQL, BASELINE, COUNTS, SECONDS, FULL)}, {_PARTS},
pr AS (SELECT {WK}, any_value(start_time_sec) AS start_time_sec, any_value(end_time_sec) AS end_time_sec, count(*) AS n_rr FROM w GROUP BY {WK}),
ft AS (SELECT * FROM pr {' '.join(f'JOIN part{i} USING ({WK})' for i in range(len(_BODIES)))})"""


def _shown(columns: list[str]) -> str:
    return ", ".join(f"round({c}::DOUBLE, {DIGITS}) + 0.0 AS {c}" for c in columns)


def _record_sql() -> str:
    parts = []
    for c in names.ALL:
        kind = names.how(c)
        parts.append(f"coalesce(sum({c}), 0) AS {c}" if kind == "sum" else f"{kind}({c}) AS {c}")
    return f"""{FEATURES_SQL}, rc AS (SELECT record_id, record_id // 2 AS pair_id, record_id % 2 AS y, window_type, window_size, {', '.join(parts)}, CAST(sum(n_rr) AS BIGINT) AS n_rr,
  max(end_time_sec) AS end_time_sec, min(start_time_sec + cusum_first_alarm_time_sec) AS cusum_first_alarm_abs_sec FROM ft GROUP BY record_id, window_type, window_size)
SELECT record_id, pair_id, y, window_type, window_size, n_rr, {_shown([*names.ALL, 'end_time_sec', 'cusum_first_alarm_abs_sec'])},
  round(CASE WHEN y = 1 THEN {FULL} - cusum_first_alarm_abs_sec END, {DIGITS}) + 0.0 AS lead_time_sec, round(CASE WHEN y = 0 AND end_time_sec > 0 THEN cusum_alarm_count / (end_time_sec / 3600.0) END, {DIGITS}) + 0.0 AS false_alarms_per_hour FROM rc"""


# --- distances with two features, which SQL can compute

PLANE = ["rmssd", "cv_rr"]
SPAN = 3.0


def plane_distances(spark, sf):
    """Distances of all feature windows from those with y = 0, with a threshold at the 95th percentile of these."""
    w = windowed(spark, sf).where("window_type = 'rr_count' AND window_size = 10")
    rows = pair_columns(charts.variability_with_bounds(w))
    x, ref = mahalanobis.as_vector(PLANE), rows.where("y = 0")
    fit = mahalanobis.fit_reference(ref, x, 2)
    limit = mahalanobis.alarm_threshold(mahalanobis.with_distance(ref, x, fit))
    return mahalanobis.with_distance(rows, x, fit), limit


def distances_by_record(spark, sf):
    rows, limit = plane_distances(spark, sf)
    # the reference's own percentile is a value that both sides of a comparison may hold: no closer than 1e-9 counts
    return mahalanobis.distances_by_record(rows, limit + 1e-9, SPAN, ["record_id", "y"])


DISTANCES_SQL = f"""{POINTS_SQL}, {VARIABILITY_SQL},
f0 AS (SELECT r.*, p.st, record_id % 2 AS y FROM r JOIN (SELECT {WK}, any_value(start_time_sec) AS st FROM w GROUP BY {WK}) p USING ({WK}) WHERE window_type = 'rr_count' AND window_size = 10),
md AS (SELECT coalesce(median(rmssd), 0.0) AS m1, coalesce(median(cv_rr), 0.0) AS m2 FROM f0 WHERE y = 0),
f1 AS (SELECT record_id, y, st, coalesce(rmssd, m1) AS x1, coalesce(cv_rr, m2) AS x2 FROM f0, md),
mu AS (SELECT avg(x1) AS u1, avg(x2) AS u2 FROM f1 WHERE y = 0),
f2 AS (SELECT record_id, y, st, x1 - u1 AS c1, x2 - u2 AS c2 FROM f1, mu),
sc AS (SELECT count(*) AS n, avg(c1 * c1) AS s11, avg(c1 * c2) AS s12, avg(c2 * c2) AS s22, avg((c1 * c1 + c2 * c2) * (c1 * c1 + c2 * c2)) AS q FROM f2 WHERE y = 0),
lw AS (SELECT *, (s11 + s22) / 2 AS m, ((s11 - (s11 + s22) / 2) * (s11 - (s11 + s22) / 2) + 2 * s12 * s12 + (s22 - (s11 + s22) / 2) * (s22 - (s11 + s22) / 2)) / 2 AS d2, (q - (s11 * s11 + 2 * s12 * s12 + s22 * s22)) / (2 * n) AS b2 FROM sc),
sh AS (SELECT m, CASE WHEN d2 > 0 THEN least(d2, b2) / d2 ELSE 0.0 END AS a, s11, s12, s22 FROM lw),
cv AS (SELECT (1 - a) * s11 + a * m AS v11, (1 - a) * s12 AS v12, (1 - a) * s22 + a * m AS v22 FROM sh),
dm AS (SELECT record_id, y, st, sqrt(greatest((c1 * c1 * v22 - 2 * c1 * c2 * v12 + c2 * c2 * v11) / (v11 * v22 - v12 * v12), 0.0)) AS d FROM f2, cv),
lt AS (SELECT quantile_cont(d, 0.95) + 1e-9 AS t FROM dm WHERE y = 0),
d1 AS (SELECT dm.*, t, row_number() OVER (PARTITION BY record_id ORDER BY st) - 1 AS i, count(*) OVER (PARTITION BY record_id) AS n FROM dm, lt),
d2 AS (SELECT *, CASE WHEN i >= n - greatest(n // 2, 1) THEN d END AS tl FROM d1), d3 AS (SELECT *, CASE WHEN tl IS NOT NULL THEN sum(CAST(tl IS NOT NULL AS INT)) OVER (PARTITION BY record_id ORDER BY i) END AS k FROM d2),
d4 AS (SELECT record_id, y, avg(d) AS a, median(d) AS b, max(d) AS c, quantile_cont(d, 0.9) AS e, arg_max(d, i) AS f, regr_slope(tl, CAST(k AS DOUBLE)) AS g, CAST(count(*) FILTER (d > t) AS DOUBLE) AS h,
  count(*) FILTER (d > t) / CAST(count(*) AS DOUBLE) AS s, max(st) AS ms, arg_min(st, i) FILTER (d > t) AS fa FROM d3 GROUP BY record_id, y)
SELECT record_id, y, round(a, {DIGITS}) + 0.0 AS mahalanobis_mean, round(b, {DIGITS}) + 0.0 AS mahalanobis_median, round(c, {DIGITS}) + 0.0 AS mahalanobis_max, round(e, {DIGITS}) + 0.0 AS mahalanobis_p90, round(f, {DIGITS}) + 0.0 AS mahalanobis_last, round(g, {DIGITS}) + 0.0 AS mahalanobis_slope,
  h AS mahalanobis_alarm_count, round(s, {DIGITS}) + 0.0 AS mahalanobis_alarm_density, round(s * ms, {DIGITS}) + 0.0 AS mahalanobis_time_in_alarm, round(fa, {DIGITS}) + 0.0 AS mahalanobis_first_alarm_time_sec, round(CASE WHEN y = 1 AND fa IS NOT NULL THEN greatest(0.0, {SPAN} - fa) END, {DIGITS}) + 0.0 AS mahalanobis_lead_time_sec FROM d4"""


# --- pairs of correlated features, and joins of record tables

CORRELATED = ["rmssd", "cv_rr", "mean_rr", "sdsd", "sd1", "sd2"]
THRESHOLD = 0.9


def event_records(spark, sf):
    return pair_columns(charts.variability(windowed(spark, sf).where("window_type = 'full_record'"))).select("record_id", "pair_id", "y", *CORRELATED)


def correlated_pairs(spark, sf):
    """Pairs of features at or above the threshold, with the number of the group of linked features that they belong to."""
    found = stats.spearman(event_records(spark, sf), CORRELATED).withColumn("rho", F.round("rho", 4)).where(F.abs("rho") >= THRESHOLD)
    rows = found.collect()  # one row for each pair of a short list of features
    groups = stats.components(CORRELATED, [(r["a"], r["b"]) for r in rows])
    of = F.create_map(*[F.lit(v) for i, g in enumerate(groups) for c in g for v in (c, i + 1)])
    return found.withColumn("group_id", of[F.col("a")])


CORRELATED_SQL = f"""{POINTS_SQL}, {VARIABILITY_SQL}, rec AS (SELECT record_id, {', '.join(CORRELATED)} FROM r WHERE window_type = 'full_record'),
lg AS (UNPIVOT rec ON {', '.join(CORRELATED)} INTO NAME feature VALUE x), nm AS (SELECT unnest({CORRELATED!r}) AS feature, unnest(range({len(CORRELATED)})) AS o),
lo AS (SELECT record_id, lg.feature, o, x FROM lg JOIN nm ON lg.feature = nm.feature WHERE x IS NOT NULL),
bo AS (SELECT a.feature AS a, b.feature AS b, a.o AS oa, b.o AS ob, a.x AS xa, b.x AS xb FROM lo a JOIN lo b ON a.record_id = b.record_id AND a.o < b.o),
rk AS (SELECT a, b, oa, ob, rank() OVER (PARTITION BY a, b ORDER BY xa) + (count(*) OVER (PARTITION BY a, b, xa) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY a, b ORDER BY xb) + (count(*) OVER (PARTITION BY a, b, xb) - 1) / 2.0::DOUBLE AS rb FROM bo),
pr AS (SELECT a, b, oa, ob, round(corr(ra, rb), 4) AS rho, count(*) AS n FROM rk GROUP BY a, b, oa, ob),
st AS (SELECT * FROM pr WHERE abs(rho) >= {THRESHOLD}),
ed AS (SELECT oa AS x, ob AS y FROM st UNION SELECT ob, oa FROM st UNION SELECT o, o FROM nm),
e2 AS (SELECT DISTINCT l.x, m.y FROM ed l JOIN ed m ON l.y = m.x), e4 AS (SELECT DISTINCT l.x, m.y FROM e2 l JOIN e2 m ON l.y = m.x), e8 AS (SELECT DISTINCT l.x, m.y FROM e4 l JOIN e4 m ON l.y = m.x),
ro AS (SELECT x, min(y) AS root FROM e8 GROUP BY x), gn AS (SELECT x, dense_rank() OVER (ORDER BY root) AS group_id FROM ro)
SELECT a, b, rho, n, group_id FROM st JOIN gn ON oa = x"""


def figures_beside_records(spark, sf):
    """Records with the largest distance of their windows: a left join, so that records without windows stay."""
    far = distances_by_record(spark, sf).select("record_id", "mahalanobis_max", "mahalanobis_alarm_count")
    return event_records(spark, sf).select("record_id", "pair_id", "y", "rmssd").join(far, "record_id", "left")


def records_in_alarm(spark, sf):
    """Records with a window in alarm: a semi join."""
    rows, limit = plane_distances(spark, sf)
    return event_records(spark, sf).select("record_id", "pair_id", "y").join(rows.where(F.col("dm") > limit + 1e-9), "record_id", "left_semi")


def charts_beside_variability(spark, sf):
    """Chart and variability tables of one kind of window, joined on the four window keys."""
    w = windowed(spark, sf).where("window_type = 'rr_count' AND window_size = 16")
    left = charts.cusum(w, charts.Chart(h=3.0)).select(*windows.KEYS, "cusum_abs_max")
    right = charts.variability(w).where("rmssd > 30").select(*windows.KEYS, "rmssd", "sd2")
    return left.join(right, windows.KEYS, "left")


def legacy_scan(spark, sf):
    """Customers as the manifest of records: most have no events, and keep a row of nulls."""
    manifest = load(spark, sf, "customer").select(F.col("c_custkey").alias("record_id"), "c_mktsegment")
    return legacy.scan(manifest, legacy.irregularity(clocked(spark, sf)))


#: Seconds of a dense window, such that some windows pass the gate and some do not.
GATE_STEP = 8.0


def gated_records(spark, sf):
    """The older pipeline's fourteen features with its gate and its usual baseline of ten windows."""
    return legacy.record_features(supplier_intervals(spark, sf), GATE_STEP, CHART)


def customers_without_events(spark, sf):
    c, e = load(spark, sf, "customer"), load(spark, sf, "events")
    return c.join(e, c.c_custkey == e.user_id, "left_anti").select("c_custkey", "c_name")


# --- all chart settings over three kinds of window

# The settings that charts are tuned over, and the kinds of window.
LIMITS, SLACKS, WEIGHTS, LENGTHS, SHEWHART_LIMITS = [3.0, 5.0, 7.0], [0.25, 0.5, 0.75], [0.1, 0.2, 0.3], [1, 2, 3], [2.5, 3.0]
TUNED = "(window_type = 'rr_count' AND window_size IN (100, 128)) OR (window_type = 'time' AND window_size = 300)"


def chart_settings(spark, sf):
    """Alarms of the three charts and records in alarm, for every one of 162 settings and every kind of window."""
    by = ["record_id", "window_type", "window_size"]
    rows = charts.chart_grid(supplier_windows(spark, sf).where(TUNED), SLACKS, LIMITS, WEIGHTS, LENGTHS, SHEWHART_LIMITS, by)
    alarms = [F.col(f"{c}_alarms") for c in ("cusum", "ewma", "shewhart")]
    total = rows.groupBy("window_type", "window_size", "h", "k", "lam", "sustained", "shewhart_l")
    return total.agg(*[F.sum(a).alias(n) for a, n in zip(alarms, ("cusum_alarms", "ewma_alarms", "shewhart_alarms"))], F.count_if(sum(alarms[1:], alarms[0]) > 0).alias("records"))


def _settings_sql() -> str:
    by, setting = "record_id, window_type, window_size", f"{WK}, h, k"
    up = f"OVER (PARTITION BY {setting} ORDER BY pos ROWS UNBOUNDED PRECEDING)"
    upto = f"OVER (PARTITION BY {WK}, lam ORDER BY pos ROWS UNBOUNDED PRECEDING)"
    return f"""{points_sql(SERIES_SQL, BASELINE, COUNTS, SECONDS, FULL)}, tw AS (SELECT {WK}, pos, z FROM w WHERE n >= 6 AND ({TUNED})),
g1 AS (SELECT * FROM tw, (SELECT unnest({LIMITS}::DOUBLE[]) AS h), (SELECT unnest({SLACKS}::DOUBLE[]) AS k)),
g2 AS (SELECT *, sum(z - k) {up} AS pp, sum(-z - k) {up} AS pm FROM g1), g3 AS (SELECT *, pp - least(0.0, min(pp) {up}) > h AS xp, pm - least(0.0, min(pm) {up}) > h AS xn FROM g2),
g4 AS (SELECT *, pos - row_number() OVER (PARTITION BY {setting}, xp ORDER BY pos) AS ip, pos - row_number() OVER (PARTITION BY {setting}, xn ORDER BY pos) AS i_n FROM g3),
g5 AS (SELECT *, greatest(CASE WHEN xp THEN count(*) OVER (PARTITION BY {setting}, xp, ip) ELSE 0 END, CASE WHEN xn THEN count(*) OVER (PARTITION BY {setting}, xn, i_n) ELSE 0 END) AS run FROM g4),
cu AS (SELECT {by}, h, k, sustained, count(*) FILTER (run >= sustained) AS ca FROM g5, (SELECT unnest({LENGTHS}) AS sustained) GROUP BY {by}, h, k, sustained),
e1 AS (SELECT *, lam * pow(1 - lam, pos) * sum(z * pow(1 - lam, -pos)) {upto} AS ew FROM tw, (SELECT unnest({WEIGHTS}::DOUBLE[]) AS lam)),
em AS (SELECT {by}, lam, count(*) FILTER (abs(ew) > 2.7 * sqrt(lam / (2 - lam))) AS ea FROM e1 GROUP BY {by}, lam),
sw AS (SELECT {by}, shewhart_l, count(*) FILTER (abs(z) > shewhart_l) AS sa FROM tw, (SELECT unnest({SHEWHART_LIMITS}::DOUBLE[]) AS shewhart_l) GROUP BY {by}, shewhart_l)
SELECT window_type, window_size, h, k, lam, CAST(sustained AS BIGINT) AS sustained, shewhart_l, CAST(sum(ca) AS BIGINT) AS cusum_alarms, CAST(sum(ea) AS BIGINT) AS ewma_alarms, CAST(sum(sa) AS BIGINT) AS shewhart_alarms,
  count(*) FILTER (ca + ea + sa > 0) AS records FROM cu JOIN em USING ({by}) JOIN sw USING ({by}) GROUP BY ALL"""


# --- manifest and audit of all users' recordings

# What each kind of recording is called, and why it is left out of the main task.
KINDS = {"view": ("p", "", None), "click": ("n", "", "control"), "purchase": ("p", "c", "continuation"), "error": ("n", "c", "control")}
#: The same for kinds that are not listed: they keep a row, with the reason that nobody knows what they are.
UNKNOWN = ("u", "", "unknown")


def recordings(spark, sf):
    """One recording for each user and kind of event: record_id, pair_id, y, prefix, tail, and the reason if it is left out."""
    rows = load(spark, sf, "events").select(F.col("user_id").alias("number"), F.col("event_type").alias("kind")).distinct()

    def pick(i):
        found = F.lit(UNKNOWN[i])
        for kind, values in KINDS.items():
            found = F.when(F.col("kind") == kind, F.lit(values[i])).otherwise(found)
        return found

    rows = rows.withColumns({"prefix": pick(0), "tail": pick(1), "excluded": pick(2)})
    # kinds that are not listed are told apart by their names
    known = F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))
    rows = rows.withColumn("prefix", F.when(known, F.col("prefix")).otherwise(F.concat("prefix", F.lit("-"), F.coalesce("kind", F.lit("")), F.lit("-"))))
    made = F.concat("prefix", F.lpad(F.col("number").cast("string"), 6, "0"), "tail")
    return rows.select(made.alias("record_id"), F.floor(F.col("number") / 2).cast("long").alias("pair_id"), (F.col("number") % 2).cast("long").alias("y"), "prefix", "tail", "excluded")


def audited(spark, sf):
    return recordings(spark, sf).select("record_id", "pair_id", "excluded", F.col("excluded").isNull().alias("included"))


RECORDINGS_SQL = """WITH re AS (
  SELECT 'p' || n AS record_id, u // 2 AS pair_id, u % 2 AS y, NULL AS excluded FROM (SELECT DISTINCT user_id AS u, lpad(CAST(user_id AS VARCHAR), 6, '0') AS n FROM events WHERE event_type = 'view')
  UNION ALL SELECT 'n' || n, u // 2, u % 2, 'control' FROM (SELECT DISTINCT user_id AS u, lpad(CAST(user_id AS VARCHAR), 6, '0') AS n FROM events WHERE event_type = 'click')
  UNION ALL SELECT 'p' || n || 'c', u // 2, u % 2, 'continuation' FROM (SELECT DISTINCT user_id AS u, lpad(CAST(user_id AS VARCHAR), 6, '0') AS n FROM events WHERE event_type = 'purchase')
  UNION ALL SELECT 'n' || n || 'c', u // 2, u % 2, 'control' FROM (SELECT DISTINCT user_id AS u, lpad(CAST(user_id AS VARCHAR), 6, '0') AS n FROM events WHERE event_type = 'error')
  UNION ALL SELECT 'u-' || k || '-' || n, u // 2, u % 2, 'unknown' FROM (SELECT DISTINCT user_id AS u, coalesce(event_type, '') AS k, lpad(CAST(user_id AS VARCHAR), 6, '0') AS n FROM events
    WHERE event_type IS NULL OR event_type NOT IN ('view', 'click', 'purchase', 'error')))"""


def recordings_audit(spark, sf):
    """Violations of the main task's rules, counted over all recordings as they are named."""
    from ..operators import folds

    return folds.dataset_audit(recordings(spark, sf), "record_id")


QUERIES = {
    "window_features_full": lambda s, d: rounded(window_features(s, d), DIGITS),
    "record_features_full": lambda s, d: rounded(record_features(s, d), DIGITS),
    "mahalanobis_by_record": lambda s, d: rounded(distances_by_record(s, d), DIGITS),
    "correlated_pairs": correlated_pairs,
    "records_with_distances": lambda s, d: rounded(figures_beside_records(s, d), DIGITS),
    "records_in_alarm": records_in_alarm,
    "charts_with_variability": lambda s, d: rounded(charts_beside_variability(s, d), DIGITS),
    "param_grid_charts": lambda s, d: rounded(chart_settings(s, d), DIGITS),
    "legacy_record_features_gated": lambda s, d: rounded(gated_records(s, d)),
    "legacy_scan": lambda s, d: rounded(legacy_scan(s, d)),
    "anti_join": customers_without_events,
    "manifest_and_audit": audited,
    "recordings_audit": recordings_audit,
}
ORACLE_SQL = {
    "window_features_full": f"{FEATURES_SQL} SELECT {', '.join(KEY_COLUMNS)}, n_rr, {_shown(['start_time_sec', 'end_time_sec', *names.ALL])} FROM ft",
    "record_features_full": _record_sql(),
    "mahalanobis_by_record": DISTANCES_SQL,
    "correlated_pairs": CORRELATED_SQL,
    "records_with_distances": DISTANCES_SQL.replace("SELECT record_id, y, round(a,", ", fin AS (SELECT record_id, y, round(a,", 1) + f") SELECT r.record_id, r.record_id // 2 AS pair_id, r.record_id % 2 AS y, round(rmssd, {DIGITS}) + 0.0 AS rmssd, mahalanobis_max, mahalanobis_alarm_count FROM r LEFT JOIN fin USING (record_id) WHERE window_type = 'full_record'",
    "records_in_alarm": DISTANCES_SQL[: DISTANCES_SQL.index("d1 AS (SELECT dm.*")].rstrip().rstrip(",") + " SELECT DISTINCT record_id, record_id // 2 AS pair_id, record_id % 2 AS y FROM dm, lt WHERE d > t",
    "charts_with_variability": f"{POINTS_SQL}, {_family(VARIABILITY_SQL, 'vb')}, {cusum_points_sql('w', WK)}, {_family(CUSUM_PARTS, 'cs')} SELECT {', '.join(f'cs.{c}' for c in KEY_COLUMNS)}, round(cusum_abs_max, {DIGITS}) + 0.0 AS cusum_abs_max, round(b.rmssd, {DIGITS}) + 0.0 AS rmssd, round(b.sd2, {DIGITS}) + 0.0 AS sd2 FROM cs LEFT JOIN (SELECT * FROM vb WHERE rmssd > 30) b USING ({WK}) WHERE cs.window_type = 'rr_count' AND cs.window_size = 16",
    "param_grid_charts": _settings_sql(),
    "legacy_record_features_gated": legacy_sql(charted_sql(scored_sql(clocked_sql(SERIES_SQL, BASELINE), GATE_STEP, legacy.BASELINE_WINDOWS, True), CHART.h)),
    "legacy_scan": sql_rounded(
        f"""{CLOCKED_SQL}, i1 AS (SELECT *, abs(rr_ms - lag(rr_ms) OVER (PARTITION BY record_id ORDER BY idx)) AS d, abs(rr_ms - median(rr_ms) OVER (PARTITION BY record_id)) AS far FROM c),
i2 AS (SELECT record_id, stddev_pop(rr_ms) / avg(rr_ms) AS rr_cv, avg(d) / avg(rr_ms) AS rr_masd_over_mean, median(far) AS segment_rr_mad_ms FROM i1 GROUP BY record_id),
r AS (SELECT c_custkey AS record_id, c_mktsegment, rr_cv, rr_masd_over_mean, segment_rr_mad_ms FROM customer LEFT JOIN i2 ON c_custkey = record_id)""",
        ["rr_cv", "rr_masd_over_mean", "segment_rr_mad_ms"],
        ["record_id", "c_mktsegment"],
    ),
    "anti_join": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)",
    "recordings_audit": f"""{RECORDINGS_SQL}, pp AS (SELECT pair_id, count(*) AS n, count(DISTINCT y) AS l FROM re GROUP BY pair_id),
ru AS (SELECT 'no_continuation_record' AS rule, count(*) FILTER (record_id LIKE '%c') AS violations FROM re UNION ALL SELECT 'no_control_record', count(*) FILTER (record_id LIKE 'n%') FROM re
  UNION ALL SELECT 'two_rows_per_pair', count(*) FILTER (n <> 2) FROM pp UNION ALL SELECT 'both_labels_per_pair', count(*) FILTER (l <> 2) FROM pp)
SELECT rule, violations, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ru""",
    "manifest_and_audit": f"{RECORDINGS_SQL} SELECT record_id, pair_id, excluded, excluded IS NULL AS included FROM re",
}
