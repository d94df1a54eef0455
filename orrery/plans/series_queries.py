"""Named queries over interval series and their windows, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as names
from ..operators import aggregate, charts, intervals, legacy, windows
from .base import CHART, CLOCKED_SQL, FULL, KEY_COLUMNS, POINTS_SQL, SECONDS, WK, clocked, load, rounded, sql_rounded, windowed

P = f"PARTITION BY {WK}"
O = f"OVER ({P} ORDER BY pos)"  # noqa: E741
UPTO = f"OVER ({P} ORDER BY pos ROWS UNBOUNDED PRECEDING)"


def guarded(n: int, parts: dict[str, str]) -> str:
    return ", ".join(f"CASE WHEN any_value(n) >= {n} THEN {v} END AS {c}" for c, v in parts.items())


def grouped(source: str, parts: str) -> str:
    return f"r AS (SELECT {WK}, {parts} FROM {source} GROUP BY {WK})"


VARIABILITY_SQL = f"""d AS (SELECT *, rr_ms - lag(rr_ms) {O} AS d, abs(rr_ms - median(rr_ms) OVER ({P})) AS far FROM w),
a AS (SELECT {WK}, any_value(n) AS n, avg(rr_ms) AS m, median(rr_ms) AS med, stddev_samp(rr_ms) AS sd, median(far) AS mad, sqrt(avg(d * d)) AS root,
  stddev_samp(d) AS ds, avg(abs(d)) AS da FROM d GROUP BY {WK}),
b AS (SELECT *, root / sqrt(2.0::DOUBLE) AS s1, sqrt(greatest(0.0, 2 * sd * sd - (root / sqrt(2.0::DOUBLE)) * (root / sqrt(2.0::DOUBLE)))) AS s2 FROM a),
r AS (SELECT {WK}, CASE WHEN n >= 4 THEN m END AS mean_rr, CASE WHEN n >= 4 THEN med END AS median_rr, CASE WHEN n >= 4 THEN sd END AS std_rr,
  CASE WHEN n >= 4 THEN mad END AS mad_rr, CASE WHEN n >= 4 THEN root END AS rmssd, CASE WHEN n >= 4 THEN ds END AS sdsd,
  CASE WHEN n >= 4 AND m > 0 THEN sd / m END AS cv_rr, CASE WHEN n >= 4 THEN da END AS rr_diff_mean, CASE WHEN n >= 4 THEN ds END AS rr_diff_std,
  CASE WHEN n >= 3 THEN s1 END AS sd1, CASE WHEN n >= 3 THEN s2 END AS sd2, CASE WHEN n >= 3 AND s2 > 0 THEN s1 / s2 END AS sd1_sd2_ratio FROM b)"""

SHEWHART_SQL = grouped(
    "w",
    guarded(
        6,
        {
            "shewhart_out_count": f"count(*) FILTER (abs(z) > {CHART.limit})",
            "shewhart_out_rate": f"count(*) FILTER (abs(z) > {CHART.limit}) / CAST(count(*) AS DOUBLE)",
            "shewhart_max_abs_z": "max(abs(z))",
            "shewhart_first_alarm_pos": f"CAST(coalesce(min(pos) FILTER (abs(z) > {CHART.limit}), -1) AS DOUBLE)",
            "shewhart_first_alarm_time_sec": f"min(t_local) FILTER (abs(z) > {CHART.limit})",
        },
    ),
)


def cusum_points_sql(source: str, keys: str, h: float = CHART.h) -> str:
    upto = f"OVER (PARTITION BY {keys} ORDER BY pos ROWS UNBOUNDED PRECEDING)"
    return f"""k1 AS (SELECT *, sum(z - {CHART.k}) {upto} AS pp, sum(-z - {CHART.k}) {upto} AS pm FROM {source}),
k2 AS (SELECT *, pp - least(0.0, min(pp) {upto}) AS s_pos, pm - least(0.0, min(pm) {upto}) AS s_neg FROM k1),
k3 AS (SELECT *, z IS NOT NULL AND coalesce(s_pos > {h}, FALSE) AS xp, z IS NOT NULL AND coalesce(s_neg > {h}, FALSE) AS xn FROM k2),
k4 AS (SELECT *, pos - row_number() OVER (PARTITION BY {keys}, xp ORDER BY pos) AS ip, pos - row_number() OVER (PARTITION BY {keys}, xn ORDER BY pos) AS i_n FROM k3),
k AS (SELECT *, (xp AND count(*) OVER (PARTITION BY {keys}, xp, ip) >= {CHART.sustained}) OR (xn AND count(*) OVER (PARTITION BY {keys}, xn, i_n) >= {CHART.sustained}) AS alarm FROM k4)"""


CUSUM_PARTS = grouped(
    "k",
    guarded(
        6,
        {
            "cusum_pos_max": "max(s_pos)",
            "cusum_neg_max": "max(s_neg)",
            "cusum_abs_max": "greatest(max(s_pos), max(s_neg))",
            "cusum_last_pos": "arg_max(s_pos, pos)",
            "cusum_last_neg": "arg_max(s_neg, pos)",
            "cusum_alarm_count": "count(*) FILTER (alarm)",
            "cusum_first_alarm_pos": "CAST(coalesce(min(pos) FILTER (alarm), -1) AS DOUBLE)",
            "cusum_first_alarm_time_sec": "min(t_local) FILTER (alarm)",
            "cusum_time_in_alarm": "count(*) FILTER (alarm) / CAST(count(*) AS DOUBLE) * max(t_local)",
            "cusum_alarm_density": "count(*) FILTER (alarm) / CAST(count(*) AS DOUBLE)",
        },
    ),
)
CUSUM_SQL = f"{cusum_points_sql('w', WK)}, {CUSUM_PARTS}"

_KEEP = 1 - CHART.weight
_BOUND = CHART.ewma_limit * (CHART.weight / (2.0 - CHART.weight)) ** 0.5
EWMA_SQL = f"e AS (SELECT *, {CHART.weight} * pow({_KEEP}::DOUBLE, pos) * sum(z * pow({_KEEP}::DOUBLE, -pos)) {UPTO} AS ew FROM w), " + grouped(
    "e",
    guarded(
        6,
        {
            "ewma_last": "arg_max(ew, pos)",
            "ewma_max_abs": "max(abs(ew))",
            "ewma_slope": "regr_slope(ew, pos) FILTER (pos >= n // 2)",
            "ewma_alarm_count": f"count(*) FILTER (abs(ew) > {_BOUND})",
            "ewma_first_alarm_time_sec": f"min(t_local) FILTER (abs(ew) > {_BOUND})",
        },
    ),
)

MOVING_RANGE_SQL = f"""m1 AS (SELECT *, abs(rr_ms - lag(rr_ms) {O}) AS mr FROM w),
m2 AS (SELECT *, abs(mr - median(mr) OVER ({P})) AS far, mr > {charts.MOVING_RANGE_FACTOR} * avg(mr) OVER ({P}) AS o FROM m1), """ + grouped(
    "m2", guarded(6, {"mr_mean": "avg(mr)", "mr_median": "median(mr)", "mr_max": "max(mr)", "mr_mad": "median(far)", "mr_out_count": "count(*) FILTER (o)"})
)


def longest_sql(text: str, symbol: str) -> str:
    return f"coalesce(list_max(list_transform(regexp_extract_all({text}, '{symbol}+'), lambda x: len(x))), 0)"


def frame(span: int) -> str:
    return f"OVER ({P} ORDER BY pos ROWS BETWEEN {span - 1} PRECEDING AND CURRENT ROW)"


RUNS_SQL = f"""q1 AS (SELECT *, median(z) OVER ({P}) AS med, z - lag(z) {O} AS d,
  pos >= 2 AND (sum(CAST(z > 2.0 AS INT)) {frame(3)} >= 2 OR sum(CAST(z < -2.0 AS INT)) {frame(3)} >= 2) AS two,
  pos >= 4 AND (sum(CAST(z > 1.0 AS INT)) {frame(5)} >= 4 OR sum(CAST(z < -1.0 AS INT)) {frame(5)} >= 4) AS one FROM w),
q2 AS (SELECT {WK}, any_value(n) AS n, string_agg(CASE WHEN z > med THEN 'A' WHEN z < med THEN 'B' ELSE 'M' END, '' ORDER BY pos) AS sides,
  string_agg(CASE WHEN d > 0 THEN 'U' WHEN d < 0 THEN 'D' ELSE 'E' END, '' ORDER BY pos) AS turns, bool_or(two) AS two, bool_or(one) AS one FROM q1 GROUP BY {WK}),
q3 AS (SELECT *, {longest_sql('sides', 'A')} AS a, {longest_sql('sides', 'B')} AS b, {longest_sql('turns', 'U')} AS up, {longest_sql('turns', 'D')} AS down FROM q2),
q4 AS (SELECT *, CASE WHEN up > 0 THEN up + 1 ELSE 0 END AS u1, CASE WHEN down > 0 THEN down + 1 ELSE 0 END AS d1 FROM q3),
r AS (SELECT {WK}, CASE WHEN n >= 6 THEN CAST(a AS BIGINT) END AS longest_run_above_median, CASE WHEN n >= 6 THEN CAST(b AS BIGINT) END AS longest_run_below_median,
  CASE WHEN n >= 6 THEN CAST(u1 AS BIGINT) END AS trend_run_up_max, CASE WHEN n >= 6 THEN CAST(d1 AS BIGINT) END AS trend_run_down_max,
  CASE WHEN n >= 6 THEN CAST(greatest(a, b) >= 8 AS BIGINT) + CAST(greatest(u1, d1) >= 6 AS BIGINT) + CAST(two AS BIGINT) + CAST(one AS BIGINT) END AS n_runs_rule_violations FROM q4)"""

ECTOPY_SQL = f"""h1 AS (SELECT *, median(rr_ms) OVER ({P}) AS med FROM w),
h2 AS (SELECT {WK}, any_value(n) AS n, any_value(med) AS med, string_agg(CASE WHEN rr_ms < {charts.SHORT} * med THEN 'S' WHEN rr_ms > {charts.LONG} * med THEN 'L' ELSE 'N' END, '' ORDER BY pos) AS s FROM h1 GROUP BY {WK}),
h3 AS (SELECT *, n >= 5 AND med > 0 AS fits FROM h2),
r AS (SELECT {WK}, """ + ", ".join(
    f"CASE WHEN fits THEN len(regexp_extract_all(s, '{p}')){tail} END AS {c}"
    for c, p, tail in (
        ("ectopy_like_count", "[SL]", ""),
        ("ectopy_like_density", "[SL]", " / CAST(n AS DOUBLE)"),
        ("short_long_sequence_count", "SL", ""),
        ("compensatory_pause_like_count", "SL", ""),
        ("bigeminy_like_pattern_count", "(SN){2,}", ""),
        ("trigeminy_like_pattern_count", "(SNN){2,}", ""),
        ("atrial_tachy_like_run_count", "S{3,}", ""),
    )
) + " FROM h3)"

def window_sql(body: str, columns: list[str]) -> str:
    return sql_rounded(f"{POINTS_SQL}, {body}", columns, KEY_COLUMNS)


def pair_columns(df):
    return df.withColumn("pair_id", F.floor(F.col("record_id") / 2).cast("long")).withColumn("y", (F.col("record_id") % 2).cast("long"))


def cusum_features(spark, sf):
    return charts.cusum_with_bounds(windowed(spark, sf), CHART)


def record_aggregate(spark, sf):
    names_ = names.CUSUM
    return rounded(aggregate.records_of_windows(pair_columns(cusum_features(spark, sf)), names_, 3.0))


def _record_sql(how_) -> str:
    parts = []
    for c in names.CUSUM:
        kind = how_(c)
        parts.append(f"coalesce(sum({c}), 0) AS {c}" if kind == "sum" else f"{kind}({c}) AS {c}")
    body = f"""{POINTS_SQL}, {CUSUM_SQL},
pr AS (SELECT {WK}, any_value(start_time_sec) AS st, any_value(end_time_sec) AS en, count(*) AS n_rr FROM w GROUP BY {WK}),
f AS (SELECT r.*, pr.st, pr.en, pr.n_rr, r.record_id // 2 AS pair_id, r.record_id % 2 AS y FROM r JOIN pr USING ({WK})),
g AS (SELECT record_id, pair_id, y, window_type, window_size, {', '.join(parts)}, CAST(sum(n_rr) AS BIGINT) AS n_rr, max(en) AS end_time_sec, min(st + cusum_first_alarm_time_sec) AS cusum_first_alarm_abs_sec
  FROM f GROUP BY record_id, pair_id, y, window_type, window_size)
SELECT record_id, pair_id, y, window_type, window_size, n_rr, """
    doubles = [*names.CUSUM, "end_time_sec", "cusum_first_alarm_abs_sec"]
    body += ", ".join(f"round({c}, 8) + 0.0 AS {c}" for c in doubles)
    body += ", round(CASE WHEN y = 1 THEN 3.0 - cusum_first_alarm_abs_sec END, 8) + 0.0 AS lead_time_sec"
    body += ", round(CASE WHEN y = 0 AND end_time_sec > 0 THEN cusum_alarm_count / (end_time_sec / 3600.0) END, 8) + 0.0 AS false_alarms_per_hour FROM g"
    return body


TEMPORAL = ["rmssd", "cv_rr"]


def temporal_query(spark, sf):
    w = windowed(spark, sf).where("window_type = 'rr_count' AND window_size = 10")
    f = pair_columns(charts.variability_with_bounds(w))
    return rounded(aggregate.temporal(f, TEMPORAL))


def _temporal_sql() -> str:
    parts = []
    for c in TEMPORAL:
        late, last = f"CASE WHEN i >= nn - third THEN {c} END", f"CASE WHEN i >= nn - 5 THEN {c} END"
        values = [
            f"median({c})", f"quantile_cont({c}, 0.9)", f"max({c})", f"median({late})", f"quantile_cont({late}, 0.9)", f"max({late})", f"avg({last})", f"max({last})",
            f"regr_slope({c}, CAST(i AS DOUBLE))", f"avg({late}) - avg(CASE WHEN i < third THEN {c} END)",
        ]
        parts += [f"round({v}, 8) + 0.0 AS {c}_{s}" for v, s in zip(values, aggregate.SUFFIXES)]
    return f"""{POINTS_SQL}, {VARIABILITY_SQL},
f AS (SELECT r.*, p.st FROM r JOIN (SELECT {WK}, any_value(start_time_sec) AS st FROM w GROUP BY {WK}) p USING ({WK}) WHERE window_type = 'rr_count' AND window_size = 10),
g AS (SELECT *, row_number() OVER (PARTITION BY record_id, window_type, window_size ORDER BY st) - 1 AS i, count(*) OVER (PARTITION BY record_id, window_type, window_size) AS nn FROM f),
h AS (SELECT *, greatest(1, nn // 3) AS third FROM g)
SELECT record_id, record_id // 2 AS pair_id, record_id % 2 AS y, window_type, window_size, {', '.join(parts)}, count(*) AS n_windows FROM h GROUP BY record_id, window_type, window_size"""


STEP = 0.25
LEGACY_BASE = 4


def dense_sql(clocked: str, step: float) -> str:
    return f"""{clocked},
l1 AS (SELECT *, CAST(floor(t / {step}) AS BIGINT) AS pos FROM c WHERE floor(t / {step}) * {step} < max_t),
l2 AS (SELECT *, rr_ms - lag(rr_ms) OVER (PARTITION BY record_id, pos ORDER BY idx) AS d, least(floor((t - pos * {step}) / ({step} / 3)), 2) AS sub FROM l1),
l3 AS (SELECT record_id, pos, sqrt(avg(d * d)) AS rmssd, count(*) FILTER (sub = 0) >= 3 AND count(*) FILTER (sub = 1) >= 3 AND count(*) FILTER (sub = 2) >= 3 AS gate FROM l2 GROUP BY record_id, pos),
l4 AS (SELECT record_id, unnest(range(0, greatest(CAST(ceil(max(max_t) / {step}) AS BIGINT) - 1, 0) + 1)) AS pos FROM c GROUP BY record_id),
dense AS (SELECT l4.record_id, l4.pos, (l4.pos + 0.5) * {step} AS center_s, rmssd, coalesce(gate, FALSE) AS gate FROM l4 LEFT JOIN l3 USING (record_id, pos))"""


def scored_sql(clocked: str, step: float, base: int, gate: bool = False) -> str:
    """With ``gate`` scores and values only where the window passed."""
    kept = "CASE WHEN gate THEN {} END" if gate else "{}"
    return f"""{dense_sql(clocked, step)},
b1 AS (SELECT *, CASE WHEN rmssd IS NOT NULL AND row_number() OVER (PARTITION BY record_id, rmssd IS NOT NULL ORDER BY pos) <= {base} THEN rmssd END AS base FROM dense),
b2 AS (SELECT *, count(base) OVER (PARTITION BY record_id) AS nb, median(base) OVER (PARTITION BY record_id) AS med FROM b1),
b3 AS (SELECT *, median(abs(base - med)) OVER (PARTITION BY record_id) AS mad FROM b2),
s0 AS (SELECT record_id, pos, center_s, rmssd, gate, CASE WHEN nb >= {base} THEN (rmssd - med) / (CASE WHEN mad = 0 THEN 1e-6 ELSE mad END) END AS z FROM b3),
scored AS (SELECT record_id, pos, center_s, {kept.format('rmssd')} AS rmssd, gate, {kept.format('z')} AS z FROM s0)"""


def charted_sql(scored: str, h: float) -> str:
    return f"""{scored}, {cusum_points_sql('scored', 'record_id', h)},
ch AS (SELECT record_id, pos, z, rmssd, gate, CASE WHEN z IS NOT NULL THEN s_pos END AS s_pos, CASE WHEN z IS NOT NULL THEN s_neg END AS s_neg, alarm AND z IS NOT NULL AS alarm FROM k)"""


DENSE_SQL = dense_sql(CLOCKED_SQL, STEP)
SCORED_SQL = scored_sql(CLOCKED_SQL, STEP, LEGACY_BASE)
CHARTED_SQL = charted_sql(SCORED_SQL, CHART.h)


def dense(spark, sf):
    return legacy.dense_windows(clocked(spark, sf), STEP)


def scored(spark, sf):
    return legacy.robust_scores(dense(spark, sf), LEGACY_BASE)


def events_per_record(spark, sf):
    from pyspark.sql import Window

    points = legacy.charted(scored(spark, sf), CHART)
    edge = legacy.rising_edges(F.col("alarm"), Window.partitionBy("record_id").orderBy("pos"))
    return points.withColumn("e", edge).groupBy("record_id").agg(F.sum("e").alias("alarm_events"), F.count_if("alarm").alias("alarmed"))


LEGACY_DOUBLES = ["pct_alarm_sustained", "max_cusum", "final_cusum", "max_cusum_pos", "max_cusum_neg", "final_cusum_pos", "final_cusum_neg", "median_rmssd", "median_z", "sqi_ok_fraction", "rr_cv", "rr_masd_over_mean", "segment_rr_mad_ms"]


def legacy_sql(charted: str) -> str:
    return sql_rounded(
        f"""{charted},
ed AS (SELECT *, CASE WHEN alarm AND NOT coalesce(lag(alarm) OVER (PARTITION BY record_id ORDER BY pos), FALSE) THEN 1 ELSE 0 END AS e FROM ch),
f1 AS (SELECT record_id, CAST(sum(e) AS BIGINT) AS alarm_events, count(*) FILTER (alarm) / CAST(count(*) AS DOUBLE) AS pct_alarm_sustained, max(s_pos) AS max_cusum_pos, max(s_neg) AS max_cusum_neg,
  arg_max(s_pos, pos) FILTER (s_pos IS NOT NULL) AS final_cusum_pos, arg_max(s_neg, pos) FILTER (s_neg IS NOT NULL) AS final_cusum_neg,
  median(rmssd) AS median_rmssd, median(z) AS median_z, avg(CAST(gate AS INT)) AS sqi_ok_fraction FROM ed GROUP BY record_id),
i1 AS (SELECT *, abs(rr_ms - lag(rr_ms) OVER (PARTITION BY record_id ORDER BY idx)) AS d, abs(rr_ms - median(rr_ms) OVER (PARTITION BY record_id)) AS far FROM c),
f2 AS (SELECT record_id, stddev_pop(rr_ms) / avg(rr_ms) AS rr_cv, avg(d) / avg(rr_ms) AS rr_masd_over_mean, median(far) AS segment_rr_mad_ms FROM i1 GROUP BY record_id),
r AS (SELECT *, greatest(max_cusum_pos, max_cusum_neg) AS max_cusum, greatest(final_cusum_pos, final_cusum_neg) AS final_cusum FROM f1 JOIN f2 USING (record_id))""",
        LEGACY_DOUBLES,
        ["record_id", "alarm_events"],
    )


LEGACY_SQL = legacy_sql(CHARTED_SQL)

GAPS_SQL = """WITH g AS (SELECT user_id AS record_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 2 AS idx,
  (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000.0 AS rr_ms FROM events)
SELECT record_id, idx, CAST(rr_ms AS DOUBLE) AS rr_ms FROM g WHERE idx >= 0"""


def gaps(spark, sf):
    return intervals.intervals_from_events(load(spark, sf, "events"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")), ["ts", "event_id"], 1000.0)


QUERIES = {
    "intervals_by_user": lambda s, d: gaps(s, d),
    "record_baseline": lambda s, d: rounded(intervals.baselines(clocked(s, d))),
    "multi_scale_windows": lambda s, d: rounded(windows.provenance(windowed(s, d))),
    "window_local_clock": lambda s, d: rounded(windowed(s, d).select(*windows.KEYS, "pos", "t_local", "z")),
    "window_zero_based_clock": lambda s, d: rounded(windows.zero_based(windowed(s, d)).select(*windows.KEYS, "pos", "t_local")),
    "hrv_window_basic": lambda s, d: rounded(charts.variability(windowed(s, d))),
    "shewhart_window": lambda s, d: rounded(charts.shewhart(windowed(s, d), CHART)),
    "cusum_points": lambda s, d: rounded(charts.cusum_points(windowed(s, d), CHART).select(*windows.KEYS, "pos", "s_pos", "s_neg", "alarm")),
    "cusum_window": lambda s, d: rounded(charts.cusum(windowed(s, d), CHART)),
    "ewma_window": lambda s, d: rounded(charts.ewma(windowed(s, d), CHART)),
    "moving_range_window": lambda s, d: rounded(charts.moving_range(windowed(s, d))),
    "runs_window": lambda s, d: rounded(charts.runs(windowed(s, d))),
    "ectopy_window": lambda s, d: rounded(charts.ectopy(windowed(s, d))),
    "record_aggregate": record_aggregate,
    "temporal_thirds": temporal_query,
    "legacy_dense_windows": lambda s, d: rounded(dense(s, d)),
    "legacy_robust_z": lambda s, d: rounded(scored(s, d)),
    "legacy_cusum_gaps": lambda s, d: rounded(legacy.charted(scored(s, d), CHART).select("record_id", "pos", "s_pos", "s_neg", "alarm")),
    "legacy_alarm_events": events_per_record,
    "legacy_record_features": lambda s, d: rounded(legacy.record_features(clocked(s, d), STEP, CHART, False, LEGACY_BASE)),
    "irregularity": lambda s, d: rounded(legacy.irregularity(clocked(s, d))),
}

ORACLE_SQL = {
    "intervals_by_user": GAPS_SQL,
    "record_baseline": sql_rounded(f"{CLOCKED_SQL}, r AS (SELECT record_id, any_value(mu) AS mu, any_value(sigma) AS sigma, any_value(n_total) AS n_rr, any_value(max_t) AS duration_s FROM c GROUP BY record_id)", ["mu", "sigma", "duration_s"], ["record_id", "n_rr"]),
    "multi_scale_windows": sql_rounded(f"{POINTS_SQL}, r AS (SELECT {WK}, any_value(start_time_sec) AS start_time_sec, any_value(end_time_sec) AS end_time_sec, count(*) AS n_rr FROM w GROUP BY {WK})", ["start_time_sec", "end_time_sec"], [*KEY_COLUMNS, "n_rr"]),
    "window_local_clock": sql_rounded(f"{POINTS_SQL}, r AS (SELECT * FROM w)", ["t_local", "z"], [*KEY_COLUMNS, "pos"]),
    "window_zero_based_clock": sql_rounded(f"{POINTS_SQL}, r AS (SELECT {WK}, pos, t - first_value(t) {O} AS t_local FROM w)", ["t_local"], [*KEY_COLUMNS, "pos"]),
    "hrv_window_basic": window_sql(VARIABILITY_SQL, names.HRV + names.POINCARE),
    "shewhart_window": window_sql(SHEWHART_SQL, names.SHEWHART),
    "cusum_points": sql_rounded(f"{POINTS_SQL}, {cusum_points_sql('w', WK)}, r AS (SELECT * FROM k)", ["s_pos", "s_neg"], [*KEY_COLUMNS, "pos", "alarm"]),
    "cusum_window": window_sql(CUSUM_SQL, names.CUSUM),
    "ewma_window": window_sql(EWMA_SQL, names.EWMA),
    "moving_range_window": window_sql(MOVING_RANGE_SQL, names.MOVING_RANGE),
    "runs_window": window_sql(RUNS_SQL, names.RUNS),
    "ectopy_window": window_sql(ECTOPY_SQL, names.ECTOPY),
    "record_aggregate": _record_sql(names.how),
    "temporal_thirds": _temporal_sql(),
    "legacy_dense_windows": sql_rounded(f"{DENSE_SQL}, r AS (SELECT * FROM dense)", ["center_s", "rmssd"], ["record_id", "pos", "gate"]),
    "legacy_robust_z": sql_rounded(f"{SCORED_SQL}, r AS (SELECT * FROM scored)", ["center_s", "rmssd", "z"], ["record_id", "pos", "gate"]),
    "legacy_cusum_gaps": sql_rounded(f"{CHARTED_SQL}, r AS (SELECT * FROM ch)", ["s_pos", "s_neg"], ["record_id", "pos", "alarm"]),
    "legacy_alarm_events": f"""{CHARTED_SQL}, ed AS (SELECT *, CASE WHEN alarm AND NOT coalesce(lag(alarm) OVER (PARTITION BY record_id ORDER BY pos), FALSE) THEN 1 ELSE 0 END AS e FROM ch)
SELECT record_id, CAST(sum(e) AS BIGINT) AS alarm_events, count(*) FILTER (alarm) AS alarmed FROM ed GROUP BY record_id""",
    "legacy_record_features": LEGACY_SQL,
    "irregularity": sql_rounded(f"""{CLOCKED_SQL}, i1 AS (SELECT *, abs(rr_ms - lag(rr_ms) OVER (PARTITION BY record_id ORDER BY idx)) AS d, abs(rr_ms - median(rr_ms) OVER (PARTITION BY record_id)) AS far FROM c),
r AS (SELECT record_id, stddev_pop(rr_ms) / avg(rr_ms) AS rr_cv, avg(d) / avg(rr_ms) AS rr_masd_over_mean, median(far) AS segment_rr_mad_ms FROM i1 GROUP BY record_id)""", ["rr_cv", "rr_masd_over_mean", "segment_rr_mad_ms"], ["record_id"]),
}
