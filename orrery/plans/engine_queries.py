"""Named queries over manifests, distances, models, streams and the relational tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import charts, folds, mahalanobis, model_cells, models, stats
from ..operators.scan import written
from ..operators.windows import multi_scale
from ..streaming.monitor import monitor, ordered_monitor
from .base import BASELINE, CHART, load, rounded, shared_dir, windowed
from .series_queries import POINTS_SQL, VARIABILITY_SQL, pair_columns
from .stat_queries import FEATURES, RECORDS_SQL, records, users

SPAN = 3.0


def embedding_distances(spark, sf):
    e = load(spark, sf, "embeddings").withColumn("x", F.col("embedding").cast("array<double>"))
    ref = e.where("label = 0")
    fit = mahalanobis.fit_reference(ref, F.col("x"), 64)
    limit = mahalanobis.alarm_threshold(mahalanobis.with_distance(ref, F.col("x"), fit))
    return mahalanobis.with_distance(e, F.col("x"), fit).select("vec_id", "label", "dm", (F.col("dm") > limit).alias("alarm"))


def feature_windows(spark, sf):
    return pair_columns(charts.variability_with_bounds(windowed(spark, sf).where("window_type = 'rr_count' AND window_size = 10")))


def record_distances(spark, sf):
    """Figures by record of the distances of all its feature windows from the windows with y = 0."""
    rows, names = feature_windows(spark, sf), mahalanobis.FEATURE_SETS["hrv_reduced"]
    x = mahalanobis.as_vector(names)
    ref = rows.where("y = 0")
    fit = mahalanobis.fit_reference(ref, x, len(names))
    limit = mahalanobis.alarm_threshold(mahalanobis.with_distance(ref, x, fit))
    return mahalanobis.distances_by_record(mahalanobis.with_distance(rows, x, fit), limit, SPAN, ["record_id", "y"])


def population_folds(spark, sf):
    f = folds.group_folds(users(spark, sf), "pair_id", 3)
    return rounded(mahalanobis.population_folds(feature_windows(spark, sf), mahalanobis.FEATURE_SETS["hrv_reduced"], f, SPAN))


def pair_baselines(spark, sf):
    return rounded(mahalanobis.pair_baselines(feature_windows(spark, sf), mahalanobis.FEATURE_SETS["hrv_reduced"]).select("pair_id", "window_type", "window_size", "record_id", "y", "start_time_sec", "dm", "threshold"))


SETS = 5
#: Blocks of features, each with those of the one before.
BLOCKS = {"A": FEATURES[:2], "B": FEATURES[:4], "C": FEATURES}


def fold_rows(spark, sf):
    """Whole-record features of all users and their fold, made once."""
    rows = written(records(spark, sf), "records")
    return written(rows.join(folds.group_folds(rows, "pair_id", SETS), "pair_id"), "folds")


def fold_models(rows, blocks):
    """Logistic models of every block and fold, and the held-out rows' ``fold``, ``block`` and ``p``; each row is held once for all of them."""
    m = model_cells.Models(len(FEATURES), SETS, model_cells.places(FEATURES, blocks), untrained=True)
    cells = model_cells.packed(rows.withColumn("scale", F.lit("full_record")), ["scale"], FEATURES, model_cells.fold_sides(F.col("fold"), SETS), SETS, ["record_id", "pair_id", "y", "fold"])
    return cells, model_cells.fitted(cells, m), m


def fold_predictions(rows, blocks):
    return written(model_cells.predictions(*fold_models(rows, blocks)).drop("s"), "predictions")


def cv_predictions(spark, sf):
    return fold_predictions(fold_rows(spark, sf), {"C": FEATURES}).select("record_id", "pair_id", "y", "fold", "p")


def cv_logistic(spark, sf):
    """Fold metrics of each block of features, from out-of-fold predictions."""
    by = ["block", "fold"]
    p = fold_predictions(fold_rows(spark, sf), BLOCKS)
    out = stats.roc_auc(p, by).join(stats.confusion(p, by), by)
    return out.select("fold", *[c for c in out.columns if c not in by], "block")


def incremental_blocks(spark, sf):
    summary = cv_logistic(spark, sf).groupBy("block").agg(F.avg("auc").alias("auc"), F.avg("f1").alias("f1")).withColumn("scale", F.lit("full_record"))
    return stats.block_differences(summary, [("A", "B"), ("B", "C"), ("A", "C")], ["scale"], ["auc", "f1"])


def coefficient_stability(spark, sf):
    _, table, m = fold_models(fold_rows(spark, sf), {"C": FEATURES})
    feature = F.element_at(F.array(*[F.lit(c) for c in FEATURES]), F.col("i") + 1)
    return models.coefficient_stability(model_cells.coefficients(table, m).select((F.col("s") + 1).cast("long").alias("model"), feature.alias("feature"), "coef"))


PRIORITY = ["rmssd", "cv_rr"]


def pruned_features(spark, sf):
    """Features kept in each fold's training rows, and the share of folds."""
    found = stats.kept_in_folds(fold_rows(spark, sf), FEATURES, 0.9, PRIORITY)
    kept = [(m, c) for m, names in found.items() for c in names]
    return stats.pruning_stability(spark.createDataFrame(kept, "fold long, feature string"), 5)


def pairwise_ranking(spark, sf):
    """Metrics of each held-out fold and the ranking within its pairs, with all features and with those kept by pruning.

    Pruning sees the training rows alone. What folds keep are blocks of features, and the models of all folds are
    fitted together.
    """
    rows = fold_rows(spark, sf)
    kept = stats.kept_in_folds(rows, FEATURES, 0.9, PRIORITY)
    blocks = {",".join(names): names for names in (FEATURES, *kept.values())}
    p = fold_predictions(rows, blocks)
    block = F.create_map(*[F.lit(v) for m, names in kept.items() for v in (m, ",".join(names))]) if kept else F.create_map().cast("map<bigint,string>")
    uses = F.filter(F.array(F.when(F.col("block") == ",".join(FEATURES), False), F.when(F.col("block") == block[F.col("fold")], True)), lambda use: use.isNotNull())
    p = p.withColumn("use_pruning", F.explode(uses))
    by = ["use_pruning", "fold"]
    mean = F.round(F.avg(F.round("margin", 4)), 4).alias("mean_margin")
    share = F.round(F.avg((F.col("pre") > F.col("far")).cast("double")), 4).alias("pairwise_concordance")
    pairs = stats.pair_margins(p, by).groupBy(*by).agg(share, mean, F.count(F.lit(1)).alias("n_pairs_val"))
    out = stats.confusion(p, by).join(stats.roc_auc(p, by), by).join(pairs, by, "left")
    return out.select("fold", *[c for c in out.columns if c not in by], "use_pruning")


def nested_tuning(spark, sf):
    """Best chart setting of each outer fold by inner mean AUC of alarm counts; the first setting wins ties."""
    w = windowed(spark, sf).where("window_type = 'rr_count' AND window_size = 16")
    alarms = charts.cusum_sweep(w, [0.25, 0.5, 0.75], [2.0, 3.0, 4.0], [1, 2, 3], ["record_id"])
    rows = pair_columns(alarms).join(folds.group_folds(users(spark, sf), "pair_id"), "pair_id").withColumn("p", F.col("alarms").cast("double"))
    outer = rows.select(F.col("fold").alias("outer")).distinct()
    inner = rows.crossJoin(F.broadcast(outer)).where(F.col("fold") != F.col("outer"))
    auc = stats.roc_auc(inner, ["outer", "h", "k", "sustained", "fold"]).groupBy("outer", "h", "k", "sustained").agg(F.avg("auc").alias("inner_auc"))
    first = F.row_number().over(Window.partitionBy("outer").orderBy(F.desc("inner_auc"), "h", "k", "sustained"))
    best = auc.withColumn("_r", first).where("_r = 1").drop("_r")
    held = rows.join(best.withColumnRenamed("outer", "fold"), ["fold", "h", "k", "sustained"])
    test = stats.roc_auc(held, ["fold", "h", "k", "sustained"]).select("fold", F.col("auc").alias("outer_auc"))
    return best.withColumnRenamed("outer", "fold").join(test, "fold", "left")


def streamed(spark, sf):
    """The monitor over all events as a stream that ends with them, its rows appended to a table in the shared folder."""
    root = f"{shared_dir(spark)}/monitor-{uuid.uuid4().hex}"
    schema = load(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rows = events.select(F.col("user_id").alias("record_id"), "ts", F.col("event_id").alias("order"), F.col("value").alias("rr_ms"))
    out = monitor(rows, BASELINE, CHART)
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").option("path", f"{root}/rows").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return rounded(spark.read.schema(out.schema).parquet(f"{root}/rows"))


HOUR = 3_600_000_000


def streamed_out_of_order(spark, sf):
    """The monitor over all events, which arrive up to six hours late and in six parts, one a trigger; a seventh ends every record."""
    root = f"{shared_dir(spark)}/monitor-{uuid.uuid4().hex}"
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    arrives = at + F.pmod(F.xxhash64("event_id"), F.lit(6 * HOUR))
    e = load(spark, sf, "events").select(F.col("user_id").alias("record_id"), at.alias("at"), F.col("event_id").alias("order"), F.col("value").alias("rr_ms"), F.lit(False).alias("last"), arrives.alias("_arrives"))
    ends = e.agg(F.min("_arrives").alias("a"), F.max("_arrives").alias("b")).head()
    width = ((ends["b"] or 0) - (ends["a"] or 0)) // 6 + 1
    schema = e.drop("_arrives").schema

    def trigger(arrived):
        """All that has just arrived, in one trigger; the state goes on from the last one."""
        arrived.write.mode("append").parquet(f"{root}/arrived")
        out = ordered_monitor(spark.readStream.schema(schema).parquet(f"{root}/arrived"), 6 * HOUR, BASELINE, CHART)
        query = out.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").option("path", f"{root}/rows").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return out.schema

    for part in range(6):
        trigger(e.where(F.floor((F.col("_arrives") - (ends["a"] or 0)) / width) == part).drop("_arrives"))
    closing = e.groupBy("record_id").agg(F.max("at").alias("at")).select("record_id", "at", F.lit(None).cast("long").alias("order"), F.lit(None).cast("double").alias("rr_ms"), F.lit(True).alias("last"))
    made = trigger(closing)
    return rounded(spark.read.schema(made).parquet(f"{root}/rows").drop("at"))


STREAM_SQL = f"""WITH RECURSIVE s AS (SELECT user_id AS record_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value AS rr_ms FROM events),
b AS (SELECT record_id, avg(rr_ms) AS mu, stddev_samp(rr_ms) AS sg FROM s WHERE idx < {BASELINE} GROUP BY record_id),
x AS (SELECT s.record_id, idx, rr_ms, (rr_ms - mu) / (CASE WHEN sg > 0 THEN sg ELSE 1.0 END) AS z FROM s JOIN b USING (record_id) WHERE idx >= {BASELINE}),
m AS (SELECT record_id, idx, rr_ms, z, greatest(0.0, z - {CHART.k}) AS s_pos, greatest(0.0, -z - {CHART.k}) AS s_neg, {CHART.weight} * z AS ewma FROM x WHERE idx = {BASELINE}
  UNION ALL SELECT x.record_id, x.idx, x.rr_ms, x.z, greatest(0.0, m.s_pos + x.z - {CHART.k}), greatest(0.0, m.s_neg - x.z - {CHART.k}), {CHART.weight} * x.z + {1 - CHART.weight} * m.ewma FROM m JOIN x ON x.record_id = m.record_id AND x.idx = m.idx + 1)
SELECT record_id, idx, round(rr_ms, 8) + 0.0 AS rr_ms, round(z, 8) + 0.0 AS z, round(s_pos, 8) + 0.0 AS s_pos, round(s_neg, 8) + 0.0 AS s_neg, round(ewma, 8) + 0.0 AS ewma,
  greatest(s_pos, s_neg) > {CHART.h} AS out_cusum, abs(ewma) > {CHART.ewma_limit * (CHART.weight / (2 - CHART.weight)) ** 0.5} AS out_ewma FROM m"""


def block_pivot(spark, sf):
    v = charts.variability(windowed(spark, sf)).withColumn("scale", F.concat_ws("_", "window_type", F.col("window_size").cast("int")))
    return v.groupBy("record_id").pivot("scale", ["rr_count_10", "rr_count_16", "rr_count_25", "full_record_1800"]).agg(F.avg("rmssd"))


def best_window(spark, sf):
    v = charts.variability(windowed(spark, sf)).where("window_type = 'rr_count' AND rmssd IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("record_id", "window_size").orderBy(F.desc("rmssd"), "window_index"))
    return v.withColumn("_r", rank).where("_r = 1").select("record_id", "window_size", "window_index", "rmssd")


def topk(spark, sf):
    r = stats.unpivoted(records(spark, sf), FEATURES, ["record_id"]).where("x IS NOT NULL")
    middle = r.groupBy("feature").agg(F.median("x").alias("_m"))
    return r.join(F.broadcast(middle), "feature").withColumn("away", F.abs(F.col("x") - F.col("_m"))).orderBy(F.desc("away"), "feature", "record_id").limit(20).select("record_id", "feature", "away")


def supplier_windows(spark, sf):
    """Count windows of 100 over the long series of each supplier's quantities."""
    from ..operators.intervals import series, with_clock

    li = load(spark, sf, "lineitem")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    w = multi_scale(with_clock(series(li, "l_suppkey", "l_quantity", order)), (100,))
    return rounded(charts.variability(w).select("record_id", "window_index", "mean_rr", "median_rr", "std_rr"))


def revenue_cube(spark, sf):
    li, o, c = load(spark, sf, "lineitem"), load(spark, sf, "orders"), load(spark, sf, "customer")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    return rows.cube("c_mktsegment", "o_orderpriority").agg(F.sum(cents).alias("cents"), F.count(F.lit(1)).alias("lines"), F.grouping_id().alias("level"))


def last_event_before_order(spark, sf):
    """For each order the customer-number's latest event before it: an as-of join as one union and one window."""
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("o_orderkey"), F.lit(None).cast("long").alias("event_id"))
    e = load(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("at"), F.lit(None).cast("long").alias("o_orderkey"), "event_id")
    shifted = o.withColumn("at", F.col("at") + F.expr("INTERVAL 30 YEARS"))
    w = Window.partitionBy("k").orderBy("at", F.col("event_id").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = shifted.unionByName(e).withColumn("last_event", F.last("event_id", ignorenulls=True).over(w))
    return both.where("o_orderkey IS NOT NULL AND last_event IS NOT NULL").select("o_orderkey", "last_event")


def event_sessions(spark, sf):
    """Events of a user within twelve hours of each other form one session."""
    e = load(spark, sf, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    fresh = (F.col("at") - F.lag("at").over(w) > 12 * 3600 * 1000000).cast("int")
    rows = e.withColumn("session", F.sum(F.coalesce(fresh, F.lit(0))).over(w))
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"), (F.max("at") - F.min("at")).alias("length_us"))


def set_operations(spark, sf):
    a = load(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    b = load(spark, sf, "events").select(F.col("user_id").alias("k"))
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.exceptAll(b).distinct()}
    out = None
    for name, df in parts.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).withColumn("op", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


QUERIES = {
    "mahalanobis_all_windows": lambda s, d: rounded(record_distances(s, d)),
    "mahalanobis_embeddings": lambda s, d: rounded(embedding_distances(s, d)),
    "mahalanobis_population_folds": population_folds,
    "mahalanobis_pair_baseline": pair_baselines,
    "cv_oof_predictions": lambda s, d: rounded(cv_predictions(s, d)),
    "cv_logistic": lambda s, d: rounded(cv_logistic(s, d)),
    "incremental_blocks": lambda s, d: rounded(incremental_blocks(s, d)),
    "coefficient_stability": lambda s, d: rounded(coefficient_stability(s, d)),
    "forest_importance": lambda s, d: rounded(models.forest_importance(records(s, d), FEATURES)),
    "pruning_stability": pruned_features,
    "pairwise_ranking": lambda s, d: rounded(pairwise_ranking(s, d)),
    "nested_chart_tuning": lambda s, d: rounded(nested_tuning(s, d)),
    "streaming_monitor": streamed,
    "streaming_monitor_out_of_order": streamed_out_of_order,
    "pivot_block_by_window": lambda s, d: rounded(block_pivot(s, d)),
    "best_window_per_record": lambda s, d: rounded(best_window(s, d)),
    "topk_abs": lambda s, d: rounded(topk(s, d)),
    "supplier_count_windows": supplier_windows,
    "revenue_cube": lambda s, d: rounded(revenue_cube(s, d)),
    "asof_join": last_event_before_order,
    "event_sessions": lambda s, d: rounded(event_sessions(s, d)),
    "set_operations": set_operations,
}
_SCALE = {"rr_count_10": "rr_count' AND window_size = 10", "rr_count_16": "rr_count' AND window_size = 16", "rr_count_25": "rr_count' AND window_size = 25", "full_record_1800": "full_record' AND window_size = 1800"}
ORACLE_SQL = {
    "streaming_monitor": STREAM_SQL,
    "streaming_monitor_out_of_order": f"SELECT *, FALSE AS late FROM ({STREAM_SQL})",
    "pivot_block_by_window": f"{POINTS_SQL}, {VARIABILITY_SQL} SELECT record_id, " + ", ".join(f"round(avg(rmssd) FILTER (window_type = '{f}), 8) + 0.0 AS {c}" for c, f in _SCALE.items()) + " FROM r GROUP BY record_id",
    "best_window_per_record": f"{POINTS_SQL}, {VARIABILITY_SQL}, q AS (SELECT *, row_number() OVER (PARTITION BY record_id, window_size ORDER BY rmssd DESC, window_index) AS k FROM r WHERE window_type = 'rr_count' AND rmssd IS NOT NULL) SELECT record_id, window_size, window_index, round(rmssd, 8) + 0.0 AS rmssd FROM q WHERE k = 1",
    "topk_abs": f"{RECORDS_SQL}, lg AS (UNPIVOT rec ON {', '.join(FEATURES)} INTO NAME feature VALUE x), md AS (SELECT feature, median(x) AS m FROM lg GROUP BY feature) SELECT record_id, lg.feature AS feature, round(abs(x - m), 8) + 0.0 AS away FROM lg JOIN md ON lg.feature = md.feature ORDER BY abs(x - m) DESC, lg.feature, record_id LIMIT 20",
    "supplier_count_windows": """WITH s AS (SELECT l_suppkey AS record_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS idx, count(*) OVER (PARTITION BY l_suppkey) AS n, l_quantity AS q FROM lineitem)
SELECT record_id, idx // 100 AS window_index, round(avg(q), 8) + 0.0 AS mean_rr, round(median(q), 8) + 0.0 AS median_rr, round(stddev_samp(q), 8) + 0.0 AS std_rr FROM s WHERE idx // 100 < n // 100 GROUP BY record_id, idx // 100""",
    "revenue_cube": "SELECT c_mktsegment, o_orderpriority, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS lines, CAST(grouping_id(c_mktsegment, o_orderpriority) AS BIGINT) AS level FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY CUBE (c_mktsegment, o_orderpriority)",
    "asof_join": """SELECT o_orderkey, last_event FROM (SELECT o_orderkey, (SELECT arg_max(event_id, (ts, event_id)) FROM events WHERE user_id = o_custkey AND ts <= o_orderdate + INTERVAL 30 YEARS) AS last_event FROM orders) WHERE last_event IS NOT NULL""",
    "event_sessions": """WITH g AS (SELECT user_id, event_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) > 43200000000 THEN 1 ELSE 0 END AS f FROM events),
h AS (SELECT *, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY us, event_id) AS BIGINT) AS session FROM g) SELECT user_id, session, count(*) AS events, max(us) - min(us) AS length_us FROM h GROUP BY user_id, session""",
    "set_operations": """SELECT 'union' AS op, count(*) AS n FROM (SELECT o_custkey FROM orders UNION SELECT user_id FROM events) UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT user_id FROM events)
UNION ALL SELECT 'except', count(*) FROM (SELECT DISTINCT o_custkey FROM (SELECT o_custkey FROM orders EXCEPT ALL SELECT user_id FROM events))""",
}
