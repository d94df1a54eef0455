"""Named queries over scores, pairs, folds and audits, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts, folds, resampling, stats
from .base import load, rounded, sql_rounded, whole_records, windowed
from .series_queries import POINTS_SQL, VARIABILITY_SQL, WK

SCORES_SQL = """WITH sc AS (
  SELECT 'user_mean' AS config, user_id AS record_id, user_id // 2 AS pair_id, user_id % 2 AS y, CAST(sum(CAST(value AS DECIMAL(20,2))) AS DOUBLE) / count(*) / 97.0 AS p FROM events GROUP BY user_id
  UNION ALL
  SELECT 'doc_chars', d.doc_id, d.doc_id // 2, CAST(l.quality AS BIGINT), d.n_chars / (d.n_chars + 1500.0::DOUBLE) FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def scores(spark, sf):
    e = load(spark, sf, "events").groupBy(F.col("user_id").alias("record_id")).agg((F.sum(F.col("value").cast("decimal(20,2)")).cast("double") / F.count(F.lit(1)) / 97.0).alias("p"))
    e = e.select(F.lit("user_mean").alias("config"), "record_id", F.floor(F.col("record_id") / 2).cast("long").alias("pair_id"), (F.col("record_id") % 2).cast("long").alias("y"), "p")
    d = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id")
    d = d.select(F.lit("doc_chars").alias("config"), F.col("doc_id").alias("record_id"), F.floor(F.col("doc_id") / 2).cast("long").alias("pair_id"), F.col("quality").cast("long").alias("y"), (F.col("n_chars") / (F.col("n_chars") + 1500.0)).alias("p"))
    return e.unionByName(d)


BY = ["config"]
CONFUSION_DOUBLES = ["brier", "precision", "recall", "f1", "specificity", "false_alarm_rate", "balanced_accuracy", "mcc"]
CONFUSION_SQL = sql_rounded(
    f"""{SCORES_SQL},
cm AS (SELECT config, count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y <> 1) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y <> 1) AS tn, avg((p - y) * (p - y)) AS brier FROM sc GROUP BY config),
cd AS (SELECT config, tp, fp, fn, tn, brier, CAST(tp AS DOUBLE) AS a, CAST(fp AS DOUBLE) AS b, CAST(fn AS DOUBLE) AS c, CAST(tn AS DOUBLE) AS d FROM cm),
r AS (SELECT *, CASE WHEN a + b > 0 THEN a / (a + b) ELSE 0.0 END AS precision, CASE WHEN a + c > 0 THEN a / (a + c) ELSE 0.0 END AS recall, CASE WHEN 2 * a + b + c > 0 THEN 2 * a / (2 * a + b + c) ELSE 0.0 END AS f1,
  CASE WHEN d + b > 0 THEN d / (d + b) END AS specificity, CASE WHEN d + b > 0 THEN b / (d + b) END AS false_alarm_rate,
  ((CASE WHEN a + c > 0 THEN a / (a + c) ELSE 0.0 END) + coalesce(CASE WHEN d + b > 0 THEN d / (d + b) END, 0.0)) / 2 AS balanced_accuracy,
  CASE WHEN (a + b) * (a + c) * (d + b) * (d + c) > 0 THEN (a * d - b * c) / sqrt((a + b) * (a + c) * (d + b) * (d + c)) ELSE 0.0 END AS mcc FROM cd)""",
    CONFUSION_DOUBLES,
    ["config", "tp", "fp", "fn", "tn"],
)


def auc_sql(by: str, source: str) -> str:
    return f"""ar AS (SELECT {by}, y, rank() OVER (PARTITION BY {by} ORDER BY p) + (count(*) OVER (PARTITION BY {by}, p) - 1) / 2.0::DOUBLE AS rk FROM {source}),
au AS (SELECT {by}, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y <> 1) AS n_neg, sum(rk) FILTER (y = 1) AS s FROM ar GROUP BY {by}),
auc AS (SELECT {by}, n_pos, n_neg, CASE WHEN n_pos > 0 AND n_neg > 0 THEN (s - n_pos * (n_pos + 1) / 2.0::DOUBLE) / (CAST(n_pos AS DOUBLE) * n_neg) END AS auc FROM au)"""


CURVE_SQL = f"""{SCORES_SQL},
ds AS (SELECT config, p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y <> 1) AS neg FROM sc GROUP BY config, p),
cu AS (SELECT config, p, sum(pos) OVER (PARTITION BY config ORDER BY p DESC) AS tp, sum(neg) OVER (PARTITION BY config ORDER BY p DESC) AS fp, sum(pos) OVER (PARTITION BY config) AS np, sum(neg) OVER (PARTITION BY config) AS nn FROM ds),
cv AS (SELECT config, p, CASE WHEN np > 0 THEN CAST(tp AS DOUBLE) / np END AS tpr, CASE WHEN nn > 0 THEN CAST(fp AS DOUBLE) / nn END AS fpr, CAST(tp AS DOUBLE) / (tp + fp) AS precision FROM cu)"""
MARGIN_SQL = """pm AS (SELECT config, pair_id, avg(p) FILTER (y = 1) AS pre, avg(p) FILTER (y = 0) AS far FROM sc GROUP BY config, pair_id), pq AS (SELECT *, pre - far AS margin FROM pm WHERE pre IS NOT NULL AND far IS NOT NULL)"""

FEATURES = ["rmssd", "cv_rr", "mean_rr", "median_rr", "sd1", "sd2"]
RECORDS_SQL = f"""{POINTS_SQL}, {VARIABILITY_SQL}, rec AS (SELECT record_id, record_id // 2 AS pair_id, record_id % 2 AS y, {', '.join(FEATURES)} FROM r WHERE window_type = 'full_record')"""
LONG_SQL = f"lg AS (UNPIVOT rec ON {', '.join(FEATURES)} INTO NAME feature VALUE x)"
DELTA_SQL = f"{RECORDS_SQL}, {LONG_SQL}, de AS (SELECT feature, pair_id, avg(x) FILTER (y = 0) AS far, avg(x) FILTER (y = 1) AS pre FROM lg GROUP BY feature, pair_id), dl AS (SELECT *, pre - far AS delta FROM de WHERE far IS NOT NULL AND pre IS NOT NULL)"


def records(spark, sf):
    v = charts.variability(whole_records(spark, sf))
    return v.select("record_id", F.floor(F.col("record_id") / 2).cast("long").alias("pair_id"), (F.col("record_id") % 2).cast("long").alias("y"), *FEATURES)


SIGNED_SQL = f"""{DELTA_SQL},
sr AS (SELECT feature, delta, abs(delta) AS ad, rank() OVER (PARTITION BY feature ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY feature, abs(delta)) - 1) / 2.0::DOUBLE AS rk FROM dl WHERE delta <> 0),
ss AS (SELECT feature, count(*) AS n_used, sum(CASE WHEN delta > 0 THEN rk ELSE 0.0 END) AS t_plus, sum(CASE WHEN delta < 0 THEN rk ELSE 0.0 END) AS t_minus, count(DISTINCT ad) < count(*) AS ties FROM sr GROUP BY feature),
q AS (SELECT *, least(t_plus, t_minus) AS wilcoxon_w, (t_plus - t_minus) / (t_plus + t_minus) AS rank_biserial FROM ss)"""



def _wilcoxon_p_sql(most_exact: int = 50) -> str:
    """Ways to every doubled rank sum by a recursion over each feature's differences; beyond ``most_exact`` an error function's series."""
    return SIGNED_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
tt AS (SELECT feature, CAST(sum(t * t * t - t) AS BIGINT) AS tie_term FROM (SELECT feature, ad, count(*) AS t FROM sr GROUP BY feature, ad) GROUP BY feature),
rr AS (SELECT sr.feature, CAST(2 * rk AS INT) AS r, row_number() OVER (PARTITION BY sr.feature ORDER BY ad, delta) AS i FROM sr JOIN q USING (feature) WHERE n_used <= {most_exact}),
wy AS (SELECT DISTINCT feature, 0::BIGINT AS i, 0 AS s, 1.0::DOUBLE AS ways FROM rr
  UNION ALL SELECT feature, i, s, sum(ways) FROM (SELECT wy.feature, rr.i, wy.s + u.add * rr.r AS s, wy.ways FROM wy JOIN rr ON rr.feature = wy.feature AND rr.i = wy.i + 1, (VALUES (0), (1)) u(add)) GROUP BY feature, i, s),
ex AS (SELECT q.feature, least(1.0, 2 * sum(ways) FILTER (s <= 2 * wilcoxon_w) / pow(2.0, any_value(n_used))) AS p FROM wy JOIN q ON q.feature = wy.feature AND wy.i = q.n_used GROUP BY q.feature),
nz AS (SELECT feature, abs(wilcoxon_w - n_used * (n_used + 1) / 4.0::DOUBLE) / sqrt(n_used * (n_used + 1) * (2 * n_used + 1) / 24.0::DOUBLE - tie_term / 48.0::DOUBLE) AS z FROM q JOIN tt USING (feature)),
er AS (SELECT feature, z, sum(CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * exp((2 * k + 1) * ln(z / sqrt(2.0)) - lgamma(k + 1.0)) / (2 * k + 1)) * 2 / sqrt(pi()) AS e FROM nz, range(0, 120) t(k) WHERE z > 0 GROUP BY feature, z)
SELECT feature, n_used, ties, tie_term, round(t_plus, 8) + 0.0 AS t_plus, round(t_minus, 8) + 0.0 AS t_minus, round(wilcoxon_w, 8) + 0.0 AS wilcoxon_w, round(rank_biserial, 8) + 0.0 AS rank_biserial,
  round(coalesce(ex.p, 1 - er.e, 1.0), 8) + 0.0 AS p_value FROM q JOIN tt USING (feature) LEFT JOIN ex USING (feature) LEFT JOIN er USING (feature)"""


SPEARMAN_SQL = f"""{RECORDS_SQL}, {LONG_SQL},
nm AS (SELECT unnest({FEATURES!r}) AS feature, unnest(range({len(FEATURES)})) AS o),
lo AS (SELECT record_id, lg.feature, o, x FROM lg JOIN nm ON lg.feature = nm.feature WHERE x IS NOT NULL),
bo AS (SELECT a.feature AS a, b.feature AS b, a.x AS xa, b.x AS xb FROM lo a JOIN lo b ON a.record_id = b.record_id AND a.o < b.o),
rk AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY xa) + (count(*) OVER (PARTITION BY a, b, xa) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY a, b ORDER BY xb) + (count(*) OVER (PARTITION BY a, b, xb) - 1) / 2.0::DOUBLE AS rb FROM bo),
rq AS (SELECT a, b, corr(ra, rb) AS rho, count(*) AS n FROM rk GROUP BY a, b)"""

FOLDS_SQL = f"{SCORES_SQL}, us AS (SELECT * FROM sc WHERE config = 'user_mean'), gs AS (SELECT pair_id, count(*) AS n FROM us GROUP BY pair_id), fo AS (SELECT pair_id, CAST((row_number() OVER (ORDER BY n DESC, pair_id DESC) - 1) % 5 + 1 AS BIGINT) AS fold FROM gs)"


def users(spark, sf):
    return scores(spark, sf).where("config = 'user_mean'")


REPLICATES = 500
DRAWS_SQL = f"""np AS (SELECT pair_id, row_number() OVER (ORDER BY pair_id) - 1 AS k FROM (SELECT DISTINCT pair_id FROM us)),
dr AS (SELECT b, CAST(floor((((b + 1) * 1103515245 + (k + 1) * 12345 + (b + 1) * (k + 1) * 69069) % 2147483647) / 7.0) AS BIGINT) % (SELECT count(*) FROM np) AS k FROM np, (SELECT unnest(range({REPLICATES})) AS b)),
dw AS (SELECT b, pair_id, count(*) AS times FROM dr JOIN np USING (k) GROUP BY b, pair_id)"""


def bootstrap_sql(rows: str) -> str:
    values = {
        "auc": "auc", "balanced_accuracy": "(tp / (tp + fn) + tn / (tn + fp)) / 2", "sensitivity": "tp / (tp + fn)", "specificity": "tn / (tn + fp)",
        "f1": "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END",
        "mcc": "CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0.0 END",
        "pairwise_concordance": "v",
    }
    long = " UNION ALL ".join(f"SELECT b, '{m}' AS metric, {v} AS v FROM bm" for m, v in values.items())
    count = lambda c, n: f"CAST(count(*) FILTER ({c}) AS DOUBLE) AS {n}"
    return f"""{FOLDS_SQL}, {DRAWS_SQL}, br AS ({rows}), bz AS (SELECT * FROM br UNION ALL SELECT -1, pair_id, 0, y, p FROM us), {auc_sql('b', 'bz')},
pb AS (SELECT b, pair_id, c, avg(p) FILTER (y = 1) AS pre, avg(p) FILTER (y = 0) AS far FROM bz GROUP BY b, pair_id, c),
cb AS (SELECT b, avg(CAST(pre > far AS INT)) AS v FROM pb WHERE pre IS NOT NULL AND far IS NOT NULL GROUP BY b),
bc AS (SELECT b, {count('p >= 0.5 AND y = 1', 'tp')}, {count('p >= 0.5 AND y <> 1', 'fp')}, {count('p < 0.5 AND y = 1', 'fn')}, {count('p < 0.5 AND y <> 1', 'tn')} FROM bz GROUP BY b),
bm AS (SELECT * FROM auc JOIN bc USING (b) LEFT JOIN cb USING (b) WHERE auc IS NOT NULL), mv AS (SELECT * FROM ({long}) WHERE v IS NOT NULL),
q AS (SELECT metric, avg(v) FILTER (b >= 0) AS mean, stddev_pop(v) FILTER (b >= 0) AS sd, quantile_cont(v, 0.025) FILTER (b >= 0) AS low, quantile_cont(v, 0.975) FILTER (b >= 0) AS high, count(*) FILTER (b >= 0) AS replicates, max(v) FILTER (b < 0) AS observed FROM mv GROUP BY metric)"""


BOOT = ["mean", "sd", "low", "high", "observed"]
GRID = [(h, k, s) for h in (2.0, 3.0, 4.0) for k in (0.25, 0.5, 0.75) for s in (1, 2, 3)]


def parameter_grid(spark, sf):
    w = windowed(spark, sf).where("window_type = 'rr_count' AND window_size = 16")
    slacks, limits, lengths = (sorted({g[i] for g in GRID}) for i in (1, 0, 2))
    alarms = charts.cusum_sweep(w, slacks, limits, lengths, ["record_id"])
    return alarms.groupBy("h", "k", "sustained").agg(F.sum("alarms").alias("alarms"), F.count_if(F.col("alarms") > 0).alias("records"))


def _grid_sql() -> str:
    values = ", ".join(f"({h}::DOUBLE, {k}::DOUBLE, {s})" for h, k, s in GRID)
    keys = f"h, k, sustained, {WK}"
    up = f"OVER (PARTITION BY {keys} ORDER BY pos ROWS UNBOUNDED PRECEDING)"
    return f"""{POINTS_SQL}, gr(h, k, sustained) AS (VALUES {values}), wg AS (SELECT * FROM w, gr WHERE window_type = 'rr_count' AND window_size = 16),
k1 AS (SELECT *, sum(z - k) {up} AS pp, sum(-z - k) {up} AS pm FROM wg), k2 AS (SELECT *, pp - least(0.0, min(pp) {up}) > h AS xp, pm - least(0.0, min(pm) {up}) > h AS xn FROM k1),
k3 AS (SELECT *, pos - row_number() OVER (PARTITION BY {keys}, xp ORDER BY pos) AS ip, pos - row_number() OVER (PARTITION BY {keys}, xn ORDER BY pos) AS i_n FROM k2),
k4 AS (SELECT *, (xp AND count(*) OVER (PARTITION BY {keys}, xp, ip) >= sustained) OR (xn AND count(*) OVER (PARTITION BY {keys}, xn, i_n) >= sustained) AS alarm FROM k3),
k5 AS (SELECT h, k, sustained, record_id, count(*) FILTER (alarm) AS alarms FROM k4 GROUP BY h, k, sustained, record_id)
SELECT h, k, CAST(sustained AS BIGINT) AS sustained, CAST(sum(alarms) AS BIGINT) AS alarms, count(*) FILTER (alarms > 0) AS records FROM k5 GROUP BY h, k, sustained"""


def threshold_classifier(spark, sf):
    """P = 1 / (1 + exp(-(2 / t)(x - t))) with t the 95th percentile of y = 0, missing values 0."""
    r = records(spark, sf).select("record_id", "y", F.coalesce("rmssd", F.lit(0.0)).alias("x"))
    t = r.where("y = 0").agg(F.percentile("x", 0.95).alias("t"))
    return r.crossJoin(F.broadcast(t)).select("record_id", "y", (1 / (1 + F.exp(-(2 / F.col("t")) * (F.col("x") - F.col("t"))))).alias("p"), (F.col("x") >= F.col("t")).alias("predicted"))


def summary_rows(spark, sf):
    return scores(spark, sf).withColumn("fold", F.col("pair_id") % 5)


def cv_summary(spark, sf):
    per = stats.roc_auc(summary_rows(spark, sf), ["config", "fold"])
    return per.groupBy("config").agg(F.avg("auc").alias("auc_mean"), F.stddev_samp("auc").alias("auc_std"), F.count("auc").alias("folds"))


CV_SQL = f"{SCORES_SQL}, sf AS (SELECT *, pair_id % 5 AS fold FROM sc), {auc_sql('config, fold', 'sf')}"

QUERIES = {
    "confusion_metrics": lambda s, d: rounded(stats.confusion(scores(s, d), BY)),
    "roc_auc_rank": lambda s, d: rounded(stats.roc_auc(scores(s, d), BY)),
    "roc_pr_curve": lambda s, d: rounded(stats.curve(scores(s, d), BY)),
    "average_precision": lambda s, d: rounded(stats.average_precision(scores(s, d), BY)),
    "trapezoid_auc": lambda s, d: rounded(stats.trapezoid_auc(scores(s, d), BY)),
    "pairwise_margins": lambda s, d: rounded(stats.pair_margins(scores(s, d), BY)),
    "pairwise_concordance": lambda s, d: rounded(stats.concordance(scores(s, d), BY)),
    "paired_delta": lambda s, d: rounded(stats.delta_summary(stats.pair_deltas(records(s, d), FEATURES))),
    "wilcoxon_stat": lambda s, d: rounded(stats.signed_ranks(stats.pair_deltas(records(s, d), FEATURES)).drop("tie_term")),
    "wilcoxon_p": lambda s, d: rounded(stats.wilcoxon_p(stats.pair_deltas(records(s, d), FEATURES))),
    "spearman_pairs": lambda s, d: rounded(stats.spearman(records(s, d), FEATURES)),
    "group_kfold_folds": lambda s, d: folds.group_folds(users(s, d), "pair_id"),
    "fold_audit": lambda s, d: folds.fold_audit(users(s, d), folds.group_folds(users(s, d), "pair_id"), "pair_id", "record_id"),
    "bootstrap_distinct": lambda s, d: rounded(resampling.bootstrap(users(s, d), REPLICATES)),
    "bootstrap_multiplicity": lambda s, d: rounded(resampling.bootstrap(users(s, d), REPLICATES, True)),
    "nan_audit": lambda s, d: rounded(folds.nan_audit(records(s, d), FEATURES, {"variability": ["rmssd", "cv_rr"], "plane": ["sd1", "sd2"]})),
    "param_grid_cusum": lambda s, d: rounded(parameter_grid(s, d)),
    "threshold_classifier": lambda s, d: rounded(threshold_classifier(s, d)),
    "cv_mean_std": lambda s, d: rounded(cv_summary(s, d)),
}
ORACLE_SQL = {
    "confusion_metrics": CONFUSION_SQL,
    "roc_auc_rank": f"{SCORES_SQL}, {auc_sql('config', 'sc')} SELECT config, n_pos, n_neg, round(auc, 8) + 0.0 AS auc FROM auc",
    "roc_pr_curve": f"{CURVE_SQL} SELECT config, round(p, 8) + 0.0 AS p, round(tpr, 8) + 0.0 AS tpr, round(fpr, 8) + 0.0 AS fpr, round(precision, 8) + 0.0 AS precision FROM cv",
    "average_precision": f"{CURVE_SQL}, st AS (SELECT config, (tpr - coalesce(lag(tpr) OVER (PARTITION BY config ORDER BY p DESC), 0.0)) * precision AS s FROM cv) SELECT config, round(sum(s), 8) + 0.0 AS average_precision FROM st GROUP BY config",
    "trapezoid_auc": f"{CURVE_SQL}, st AS (SELECT config, (fpr - coalesce(lag(fpr) OVER (PARTITION BY config ORDER BY p DESC), 0.0)) * (tpr + coalesce(lag(tpr) OVER (PARTITION BY config ORDER BY p DESC), 0.0)) / 2 AS s FROM cv) SELECT config, round(sum(s), 8) + 0.0 AS auc_trapezoid FROM st GROUP BY config",
    "pairwise_margins": f"{SCORES_SQL}, {MARGIN_SQL} SELECT config, pair_id, round(pre, 8) + 0.0 AS pre, round(far, 8) + 0.0 AS far, round(margin, 8) + 0.0 AS margin FROM pq",
    "pairwise_concordance": f"{SCORES_SQL}, {MARGIN_SQL} SELECT config, round(avg(CAST(margin > 0 AS INT)), 8) + 0.0 AS pairwise_concordance, count(*) AS n_pairs FROM pq GROUP BY config",
    "paired_delta": f"""{DELTA_SQL}, ds AS (SELECT feature, count(*) AS n_pairs, median(delta) AS med, quantile_cont(delta, 0.25) AS q25, quantile_cont(delta, 0.75) AS q75, avg(CAST(delta > 0 AS INT)) AS up, avg(CAST(delta < 0 AS INT)) AS dn FROM dl GROUP BY feature)
SELECT feature, n_pairs, round(med, 8) + 0.0 AS median_delta, round(q25, 8) + 0.0 AS q25, round(q75, 8) + 0.0 AS q75, round(q75 - q25, 8) + 0.0 AS iqr, round(up, 8) + 0.0 AS share_up, round(dn, 8) + 0.0 AS share_down, greatest(up, dn) >= 0.6 AS direction_consistent FROM ds""",
    "wilcoxon_stat": f"{SIGNED_SQL} SELECT feature, n_used, ties, round(t_plus, 8) + 0.0 AS t_plus, round(t_minus, 8) + 0.0 AS t_minus, round(wilcoxon_w, 8) + 0.0 AS wilcoxon_w, round(rank_biserial, 8) + 0.0 AS rank_biserial FROM q",
    "wilcoxon_p": _wilcoxon_p_sql(),
    "spearman_pairs": f"{SPEARMAN_SQL} SELECT a, b, n, round(rho, 8) + 0.0 AS rho FROM rq",
    "group_kfold_folds": f"{FOLDS_SQL} SELECT pair_id, fold FROM fo",
    "fold_audit": f"""{FOLDS_SQL}, la AS (SELECT us.*, fold FROM us JOIN fo USING (pair_id)), fs AS (SELECT DISTINCT fold AS f FROM fo)
SELECT f AS fold, count(*) FILTER (fold = f) AS n_val, count(*) FILTER (fold <> f) AS n_train, array_to_string(list_sort(list(DISTINCT pair_id) FILTER (fold = f)), ',') AS val_groups, NOT list_has_any(list(DISTINCT pair_id) FILTER (fold = f), list(DISTINCT pair_id) FILTER (fold <> f)) AS disjoint FROM fs, la GROUP BY f""",
    "bootstrap_distinct": bootstrap_sql("SELECT b, us.pair_id, 0 AS c, y, p FROM us JOIN dw USING (pair_id)") + " SELECT metric, replicates, " + ", ".join(f"round({c}, 8) + 0.0 AS {c}" for c in BOOT) + " FROM q",
    "bootstrap_multiplicity": bootstrap_sql("SELECT b, pair_id, unnest(range(times)) + 1 AS c, y, p FROM us JOIN dw USING (pair_id)") + " SELECT metric, replicates, " + ", ".join(f"round({c}, 8) + 0.0 AS {c}" for c in BOOT) + " FROM q",
    "nan_audit": f"{RECORDS_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER ({c} IS NULL) AS n_missing, round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 8)::DOUBLE AS pct_missing, {c in ('rmssd', 'cv_rr')} AS in_variability, {c in ('sd1', 'sd2')} AS in_plane FROM rec" for c in FEATURES),
    "param_grid_cusum": _grid_sql(),
    "threshold_classifier": f"{RECORDS_SQL}, xx AS (SELECT record_id, y, coalesce(rmssd, 0.0) AS x FROM rec), tt AS (SELECT quantile_cont(x, 0.95) AS t FROM xx WHERE y = 0) SELECT record_id, y, round(1 / (1 + exp(-(2 / t) * (x - t))), 8) + 0.0 AS p, x >= t AS predicted FROM xx, tt",
    "cv_mean_std": f"{CV_SQL} SELECT config, round(avg(auc), 8) + 0.0 AS auc_mean, round(stddev_samp(auc), 8) + 0.0 AS auc_std, count(auc) AS folds FROM auc GROUP BY config",
}
