"""Named queries over models: all blocks of features at all scales, nested choice of chart settings, coefficient tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import features as names
from ..operators import aggregate, charts, folds, mahalanobis, model_cells, model_table, models, stats, window_arrays
from ..operators.keyed_distance import fit_keys, lacking, with_keyed_distance, with_thresholds
from ..operators.scan import attach, running, segmented, written
from ..operators.selection import exact_percentiles
from .base import rounded
from .series_queries import pair_columns
from .wide_queries import LENGTHS, LIMITS, SHEWHART_LIMITS, SLACKS, TUNED, WEIGHTS, FULL, all_scales, record_features, supplier_intervals, supplier_items, supplier_windows, whole_record_features, window_features

FOLDS, INNER = 5, 3
SCALE = ["window_type", "window_size"]
#: Blocks whose figures are compared, the first with the second.
STEPS = [(f"{family}.{a}", f"{family}.{b}") for family, pairs in (("full", [("A_HRV", "C_HRV_SPC"), ("B_SPC", "C_HRV_SPC"), ("C_HRV_SPC", "D_HRV_SPC_Poincare"), ("D_HRV_SPC_Poincare", "E_HRV_SPC_Poincare_Ectopy")]), ("reduced", [("A_HRV", "C_HRV_SPC"), ("B_SPC", "C_HRV_SPC"), ("C_HRV_SPC", "D_HRV_SPC_Poincare")])) for a, b in pairs]
METRICS = ["auc", "f1", "recall", "specificity", "precision", "balanced_accuracy", "mcc"]


def folded_records(features: DataFrame) -> DataFrame:
    """Record features with their fold, and the part of the other folds that a machine leaves out."""
    records = written(features.select("record_id", "pair_id", "y", *SCALE, *names.ALL), "records")
    dealt = folds.group_folds(records.select("record_id", "pair_id").distinct(), "pair_id", FOLDS)
    parts = folds.group_folds(records.select("record_id", "pair_id").distinct(), "pair_id", INNER).withColumnRenamed("fold", "part")
    return attach(records, written(dealt.join(parts, "pair_id"), "folds"), ["pair_id"])


def block_predictions(spark, sf) -> DataFrame:
    """Out-of-fold probabilities of every record for each block, scale and kind of model."""
    who = [*SCALE, "record_id", "pair_id", "y"]
    cells = model_cells.packed(folded_records(record_features(spark, sf)), SCALE, names.ALL, model_cells.fold_sides(F.col("fold"), FOLDS), FOLDS, who, F.col("part"))
    logistic = model_cells.Models(len(names.ALL), FOLDS, model_cells.places(names.ALL, names.BLOCKS))
    kinds = {"logistic": logistic, "svm": replace(logistic, parts=INNER, loss="squared_hinge", plain_intercept=False)}
    made = [model_cells.predictions(cells, model_cells.fitted(cells, m), m).select(F.lit(k).alias("kind"), "block", *who, (F.col("s") + 1).cast("long").alias("held"), "p") for k, m in kinds.items()]
    return written(reduce(DataFrame.unionByName, made), "predictions")


def block_metrics(spark, sf) -> DataFrame:
    """Mean and deviation over folds of every block's metrics at every scale."""
    by = ["kind", "block", *SCALE, "held"]
    p = block_predictions(spark, sf)
    per = stats.confusion(p, by).join(stats.roc_auc(p, by).select(*by, "auc"), by).join(stats.concordance(p, by).select(*by, "pairwise_concordance"), by, "left")
    measured = [*METRICS, "pairwise_concordance"]
    figures = [f(c).alias(f"{c}_{n}") for c in measured for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return per.groupBy(*by[:-1]).agg(F.count(F.lit(1)).alias("n_folds"), *figures)


def block_steps(spark, sf) -> DataFrame:
    """What each larger block gains over a smaller one at equal scale and kind of model."""
    summary = block_metrics(spark, sf)
    return stats.block_differences(summary, STEPS, ["kind", *SCALE], [f"{c}_mean" for c in METRICS])


def coefficient_table(spark, sf) -> DataFrame:
    """Coefficients of all 49 features on whole records: mean and spread over folds, their signs, and their rank by size."""
    m = model_cells.Models(len(names.ALL), FOLDS, {"all": tuple(range(len(names.ALL)))})
    rows = folded_records(whole_record_features(spark, sf))
    cells = model_cells.packed(rows, SCALE, names.ALL, model_cells.fold_sides(F.col("fold"), FOLDS), FOLDS, ["record_id"])
    order = F.array(*[F.lit(c) for c in names.ALL])
    found = model_cells.coefficients(model_cells.fitted(cells, m), m)
    long = found.select(F.col("s").cast("long").alias("model"), F.element_at(order, F.col("i") + 1).alias("feature"), "coef")
    stable = models.coefficient_stability(long)
    # one row for each of 49 features
    return stable.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.abs("coef_mean")), "feature")))


# --- nested choice of chart settings

SETTING = ["h", "k", "lam", "sustained", "shewhart_l"]
_SETTING_TYPES = "h double, k double, lam double, sustained int, shewhart_l double"
CUSUM = ["cusum_pos_max", "cusum_neg_max", "cusum_abs_max", "cusum_last_pos", "cusum_last_neg", "cusum_alarm_count", "cusum_alarm_density", "cusum_time_in_alarm"]
SHEWHART = ["shewhart_out_count", "shewhart_out_rate", "shewhart_max_abs_z"]
EWMA = ["ewma_last", "ewma_max_abs", "ewma_slope", "ewma_alarm_count"]
# The features that settings are judged by.
TUNED_FEATURES = [*CUSUM, *SHEWHART, *EWMA, *names.MOVING_RANGE, *names.RUNS]
#: The EWMA's limit follows the Shewhart limit.
EWMA_SHARE = 0.9


GRID = window_arrays.Grid(LIMITS, SLACKS, WEIGHTS, LENGTHS, SHEWHART_LIMITS, [EWMA_SHARE * x for x in SHEWHART_LIMITS])
#: The scales of TUNED.
TUNED_COUNTS, TUNED_SECONDS = (100, 128), (300.0,)
_GRID_COLUMNS = [f"m{i}" for i in range(len(GRID.columns))]


def _medians(features: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return features.groupBy("record_id", *SCALE, *keys).agg(*[F.median(c).alias(c) for c in columns])


def swept_medians(windowed: DataFrame) -> DataFrame:
    """What ``window_arrays.grid_medians`` gives, by window functions; charts run over their own settings alone."""
    windowed = written(windowed, "windows")
    cusums = _medians(charts.cusum_features_sweep(windowed, SLACKS, LIMITS, LENGTHS), ["h", "k", "sustained"], CUSUM)
    ewmas = _medians(charts.ewma_features_sweep(windowed, WEIGHTS, {x: EWMA_SHARE * x for x in SHEWHART_LIMITS}), ["lam", "shewhart_l"], EWMA)
    beyond = _medians(charts.shewhart_features_sweep(windowed, SHEWHART_LIMITS), ["shewhart_l"], SHEWHART)
    plain = _medians(charts.ranges_and_runs(windowed), [], [*names.MOVING_RANGE, *names.RUNS])
    key = ["record_id", *SCALE]
    rows = ewmas.join(beyond, [*key, "shewhart_l"]).join(plain, key).join(cusums, key)
    # a column is the same under all settings that do not change it
    own = {}
    for setting, places in zip(GRID.settings, GRID.places(TUNED_FEATURES)):
        under = reduce(Column.__and__, [F.col(c) == F.lit(v) for c, v in zip(SETTING, setting)])
        own |= {i: F.max(F.when(under, F.col(c))) for c, i in zip(TUNED_FEATURES, places) if i not in own}
    return rows.groupBy(*key).agg(*[own[i].alias(c) for i, c in enumerate(_GRID_COLUMNS)])


def tuning_medians(spark, sf) -> DataFrame:
    """Median features of every record for three kinds of window, each once for the settings that change it."""
    clocked = supplier_intervals(spark, sf, 1)
    made = lambda rows: window_arrays.grid_medians(rows, TUNED_COUNTS, TUNED_SECONDS, GRID)
    if window_arrays.unfit_records(supplier_items(spark, sf), "l_suppkey", F.col("rr")):
        others = all_scales(window_arrays.split(supplier_intervals(spark, sf))[1], TUNED_COUNTS, TUNED_SECONDS).where(TUNED).where("n >= 6")
        found = made(window_arrays.split(clocked)[0]).unionByName(swept_medians(others))
    else:
        found = made(clocked)
    rows = pair_columns(found.where("record_id IS NOT NULL"))
    return rows.select("record_id", "pair_id", "y", *SCALE, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in _GRID_COLUMNS])


def under_settings(medians: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The medians' rows under each of 162 settings (``number``, from 0)."""
    settings = [(i, *setting, list(places)) for i, (setting, places) in enumerate(zip(GRID.settings, GRID.places(TUNED_FEATURES)))]
    table = medians.sparkSession.createDataFrame(settings, f"number int, {_SETTING_TYPES}, _at array<int>")
    rows = medians.withColumn("_m", F.array(*_GRID_COLUMNS)).drop(*_GRID_COLUMNS).join(F.broadcast(table))
    return rows.select("record_id", "pair_id", "y", *SCALE, *SETTING, *keep, *[F.col("_m")[F.col("_at")[i]].alias(c) for i, c in enumerate(TUNED_FEATURES)])


def tuning_records(spark, sf) -> DataFrame:
    """Median features of every record under all 162 settings for three kinds of window."""
    return under_settings(tuning_medians(spark, sf))


def inner_folds(dealt: DataFrame, inner: int) -> DataFrame:
    """(pair_id, fold, outer, inner): the pairs outside each outer fold, dealt in turn into inner folds."""
    outer = dealt.select(F.col("fold").alias("outer")).distinct()
    open_ = dealt.join(F.broadcast(outer), F.col("fold") != F.col("outer"))
    order = [F.desc("pair_id")]
    turn = running(segmented(open_, ["outer"], order), ["outer"], order, {"_turn": ("sum", F.lit(1).cast("long"))})
    return turn.select("pair_id", "fold", "outer", (F.pmod(F.col("_turn") - 1, F.lit(inner)) + 1).alias("inner"))


def _dealt(rows: DataFrame, outer: int, inner: int) -> tuple[DataFrame, DataFrame]:
    """The pairs' outer folds, and with them the inner fold of each pair by outer fold."""
    dealt = written(folds.group_folds(rows.select("record_id", "pair_id").distinct(), "pair_id", outer), "folds")
    return dealt, inner_folds(dealt, inner).groupBy("pair_id", "fold").agg(F.map_from_entries(F.collect_list(F.struct("outer", "inner"))).alias("turns"))


def _inner_sides(outer: int, inner: int) -> list[Column]:
    """The sides of a row in the inner folds of each outer fold."""
    part = lambda o, k: F.when(F.col("fold") == o, model_cells.NEITHER).when(F.try_element_at("turns", F.lit(o).cast("long")) == k, model_cells.HELD).otherwise(model_cells.TRAIN)
    return [part(o, k) for o in range(1, outer + 1) for k in range(1, inner + 1)]


def _judged(guessed: DataFrame, sets: int, inner: int) -> DataFrame:
    """(number, outer, inner_auc) of models numbered by setting and set."""
    areas = stats.roc_auc(written(guessed, "guessed"), ["model"]).where("auc IS NOT NULL")
    of = F.floor(F.pmod("model", F.lit(sets)) / inner).cast("long") + 1
    areas = areas.select(F.floor(F.col("model") / sets).cast("long").alias("number"), of.alias("outer"), "auc")
    return areas.groupBy("number", "outer").agg(F.avg("auc").alias("inner_auc"))


def _best(judged: DataFrame) -> DataFrame:
    """The best setting of each kind of window and outer fold; of equal ones the first in order."""
    first = F.row_number().over(Window.partitionBy(*SCALE, "outer").orderBy(F.desc(F.round("inner_auc", 9)), *SETTING))
    return written(judged.withColumn("_r", first).where("_r = 1").select(*SCALE, *SETTING, "outer", "inner_auc"), "best")


def _on_held_out(final: DataFrame, best: DataFrame, features: list[str]) -> DataFrame:
    """How the best settings do on their outer folds. ``final``: the rows under the best setting of each outer fold, with fold and outer."""
    by = [*SCALE, "outer"]
    m = model_cells.Models(len(features), 1, {"all": tuple(range(len(features)))})
    cells = model_cells.packed(final, by, features, F.array(F.when(F.col("fold") == F.col("outer"), model_cells.HELD).otherwise(model_cells.TRAIN)), 1, [*by, "record_id", "y"])
    held = written(model_cells.predictions(cells, model_cells.fitted(cells, m), m).select(*by, "y", "p"), "held")
    measured = stats.confusion(held, by).join(stats.roc_auc(held, by).select(*by, "auc"), by).select(*by, F.col("auc").alias("outer_auc"), "f1", "recall", "specificity", "balanced_accuracy", "mcc")
    return best.join(measured, by, "left")


def nested_choice(rows: DataFrame, features: list[str], outer: int = FOLDS, inner: int = INNER) -> DataFrame:
    """For each kind of window and outer fold: the setting of the best mean AUC over inner folds, and how it does on the held-out fold.

    All models of all settings are fitted together; of equal settings the first in order wins. Pairs are of equal size.
    """
    rows = written(rows, "tuning")
    dealt, turns = _dealt(rows, outer, inner)
    setting = [*SCALE, *SETTING]
    # one number for each of the settings, whose count does not grow with the records
    numbered = written(rows.select(*setting).distinct().withColumn("number", F.row_number().over(Window.orderBy(*setting)).cast("long")), "settings")
    tried = attach(attach(rows, turns, ["pair_id"]), numbered, setting)
    sides = _inner_sides(outer, inner)
    m = model_cells.Models(len(features), len(sides), {"all": tuple(range(len(features)))})
    cells = model_cells.packed(tried, ["number"], features, F.array(*sides), len(sides), ["number", "record_id", "y"])
    guessed = model_cells.predictions(cells, model_cells.fitted(cells, m), m).select((F.col("number") * len(sides) + F.col("s")).alias("model"), "y", "p")
    best = _best(attach(_judged(guessed, len(sides), inner), numbered, ["number"]))
    chosen = attach(rows.join(dealt, "pair_id"), best.groupBy(*setting).agg(F.collect_list("outer").alias("_outer")), setting)
    return _on_held_out(chosen.withColumn("outer", F.explode("_outer")), best, features)


def nested_choice_of_medians(medians: DataFrame, outer: int = FOLDS, inner: int = INNER) -> DataFrame:
    """``nested_choice`` over ``under_settings``, with each record's medians held once: a setting's models take their columns."""
    rows = written(medians, "tuning")
    dealt, turns = _dealt(rows, outer, inner)
    sides, places = _inner_sides(outer, inner), GRID.places(TUNED_FEATURES)
    m = model_cells.Models(len(_GRID_COLUMNS), len(sides), {str(i): p for i, p in enumerate(places)})
    cells = model_cells.packed(attach(rows, turns, ["pair_id"]), SCALE, _GRID_COLUMNS, F.array(*sides), len(sides), [*SCALE, "record_id", "y"])
    # three kinds of window
    kinds = written(rows.select(*SCALE).distinct().withColumn("kind", F.row_number().over(Window.orderBy(*SCALE)).cast("long")), "settings")
    guessed = attach(model_cells.predictions(cells, model_cells.fitted(cells, m), m), kinds, SCALE)
    number = F.col("kind") * len(places) + F.col("block").cast("long")
    judged = _judged(guessed.select((number * len(sides) + F.col("s")).alias("model"), "y", "p"), len(sides), inner)
    table = rows.sparkSession.createDataFrame([(i, *setting) for i, setting in enumerate(GRID.settings)], f"_i long, {_SETTING_TYPES}")
    named = kinds.join(F.broadcast(table)).select(*SCALE, *SETTING, (F.col("kind") * len(places) + F.col("_i")).alias("number"))
    best = _best(attach(judged, named, ["number"]))
    chosen = under_settings(attach(attach(rows, dealt, ["pair_id"]), best.select(*SCALE).distinct(), SCALE), ["fold"])
    wanted = best.groupBy(*SCALE, *SETTING).agg(F.collect_list("outer").alias("_outer"))
    return _on_held_out(attach(chosen, wanted, [*SCALE, *SETTING]).withColumn("outer", F.explode("_outer")), best, TUNED_FEATURES)


# --- distances as features, against and beside the charts

DISTANCES = [f"mahalanobis_{c}" for c in ("mean", "median", "max", "p90", "last", "slope", "alarm_count", "alarm_density", "time_in_alarm", "first_alarm_time_sec")]
HARNESS = [*names.HRV, *names.SPC, *DISTANCES]
# Blocks of the harness.
HARNESS_BLOCKS = {"A_HRV": names.HRV, "B_SPC": names.SPC, "C_HRV_SPC": names.HRV + names.SPC, "D_Mahal": DISTANCES, "E_HRV_SPC_Mahal": HARNESS}


DISTANCE_COLUMNS = list(dict.fromkeys(c for own in mahalanobis.FEATURE_SETS.values() for c in own))
WINDOW = ["record_id", "pair_id", "y", *SCALE, "window_index", "start_time_sec"]


def _window_rows(spark, sf, more: Sequence[str] = ()) -> DataFrame:
    """The windows' features that distances are taken in, and ``more`` columns, made once."""
    return written(pair_columns(window_features(spark, sf)).select(*dict.fromkeys([*WINDOW, *DISTANCE_COLUMNS, *more])), "windows")


def _each_set(make) -> DataFrame:
    """The rows of all sets of features that distances are taken in."""
    return reduce(DataFrame.unionByName, [make(own).withColumn("features", F.lit(name)) for name, own in mahalanobis.FEATURE_SETS.items()])


def _measured(rows: DataFrame, blocks: dict[str, list[str]], columns: list[str], cell: list[str], sides: Column, sets: int) -> DataFrame:
    """Probabilities of the held-out records of each cell, set and block, from logistic models over rows that are held once."""
    m = model_cells.Models(len(columns), sets, model_cells.places(columns, blocks))
    cells = model_cells.packed(rows, cell, columns, sides, sets, [*cell, "record_id", "pair_id", "y"])
    return model_cells.predictions(cells, model_cells.fitted(cells, m), m)


def harness_predictions(spark, sf) -> DataFrame:
    """Out-of-fold probabilities: references fitted for each fold's training windows, or for each pair by its own.

    With ``population_fold`` nothing of a held-out record enters mean, covariance, threshold or scaling; distances of
    training and held-out records are both taken from the fold's reference. ``threshold`` models look at the largest
    distance alone.
    """
    charted = [*names.HRV, *names.SPC]
    features = _window_rows(spark, sf, [*charted, "n_rr", "end_time_sec", "cusum_first_alarm_time_sec"])
    windowed = features.select(*WINDOW, *DISTANCE_COLUMNS)
    dealt = written(folds.group_folds(windowed.select("record_id", "pair_id").distinct(), "pair_id", FOLDS), "folds")
    records = written(aggregate.records_of_windows(features, charted, FULL).select("record_id", *SCALE, *charted), "records")
    sides = written(model_table.fold_sides(attach(windowed, dealt, ["pair_id"]), FOLDS), "sides")
    keys, far = [*SCALE, "held"], F.col("train") & (F.col("y") == 0)
    who = ["record_id", "pair_id", "y", *SCALE]
    filled = lacking(windowed, DISTANCE_COLUMNS)

    def population(own: list[str]) -> DataFrame:
        away = written(with_keyed_distance(sides, fit_keys(sides.where(far), own, keys, filled=filled), own, keys).drop(*DISTANCE_COLUMNS), "distances")
        return mahalanobis.distances_by_record(with_thresholds(away, far, keys), F.col("threshold"), FULL, [*who, "held", "train"])

    def paired(own: list[str]) -> DataFrame:
        return mahalanobis.distances_by_record(mahalanobis.pair_baselines(windowed, own), F.col("threshold"), FULL, who)

    whole = written(_each_set(population).join(records, ["record_id", *SCALE]), "harness")
    by = ["features", *keys]
    side = F.array(F.when(F.col("train"), model_cells.TRAIN).otherwise(model_cells.HELD))
    fitted = _measured(whole, HARNESS_BLOCKS, HARNESS, by, side, 1).select(*by, "block", "record_id", "pair_id", "y", "p", F.lit("logistic").alias("kind"))
    limits = exact_percentiles(whole.where(far), by, F.col("mahalanobis_max"), [mahalanobis.PERCENTILE / 100]).select(*by, F.col("value").alias("_t"))
    limit = F.coalesce("_t", F.lit(1.0))
    plain = attach(whole.where("NOT train"), limits, by, "left").withColumn("p", model_table.probability(2.0 / F.greatest(limit, F.lit(1e-6)) * (F.coalesce("mahalanobis_max", F.lit(0.0)) - limit)))
    plain = plain.withColumn("block", F.explode(F.array(F.lit("D_Mahal"), F.lit("E_HRV_SPC_Mahal")))).select(*by, "block", "record_id", "pair_id", "y", "p", F.lit("threshold").alias("kind"))
    own = attach(_each_set(paired), dealt, ["pair_id"]).select("features", *who, "fold", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in DISTANCES])
    paired_rows = _measured(own, {"D_Mahal": DISTANCES}, DISTANCES, ["features", *SCALE], model_cells.fold_sides(F.col("fold"), FOLDS), FOLDS)
    paired_rows = paired_rows.select("features", *SCALE, (F.col("s") + 1).cast("long").alias("held"), "block", "record_id", "pair_id", "y", "p", F.lit("logistic").alias("kind"))
    mode = lambda df, m: df.withColumn("mode", F.lit(m))
    return written(mode(fitted.unionByName(plain), "population_fold").unionByName(mode(paired_rows, "pair_baseline")), "predictions")


def harness_metrics(spark, sf) -> DataFrame:
    """Mean and deviation over folds of each mode, set of features, block, scale and kind of model."""
    by = ["mode", "features", "block", "kind", *SCALE]
    p = harness_predictions(spark, sf)
    per = stats.confusion(p, [*by, "held"]).join(stats.roc_auc(p, [*by, "held"]).select(*by, "held", "auc"), [*by, "held"])
    return per.groupBy(*by).agg(F.count(F.lit(1)).alias("n_folds"), *[f(c).alias(f"{c}_{n}") for c in METRICS for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def distance_steps(spark, sf) -> DataFrame:
    """What distances add to variability and charts, at every scale and for every set and kind of model."""
    summary = harness_metrics(spark, sf).where("mode = 'population_fold'")
    return stats.block_differences(summary, [("C_HRV_SPC", "E_HRV_SPC_Mahal")], ["features", "kind", *SCALE], ["auc_mean", "f1_mean"])


def distance_lead_times(spark, sf) -> DataFrame:
    """Time from the first alarm to the end of the span for every y = 1 record, by scale and set; the reference is all y = 0 windows of the scale."""
    windowed = _window_rows(spark, sf)
    filled = lacking(windowed, DISTANCE_COLUMNS)

    def made(own: list[str]) -> DataFrame:
        away = written(with_keyed_distance(windowed, fit_keys(windowed.where("y = 0"), own, SCALE, filled=filled), own, SCALE).drop(*DISTANCE_COLUMNS), "distances")
        judged = with_thresholds(away, F.col("y") == 0, SCALE).where("y = 1")
        first = F.min_by("start_time_sec", F.when(F.col("dm") > F.col("threshold"), F.col("window_index")))
        return judged.groupBy("record_id", "pair_id", *SCALE).agg((FULL - first).alias("lead_time_sec"), F.count_if(F.col("dm") > F.col("threshold")).alias("alarms"), F.max("dm").alias("farthest"), F.first("threshold").alias("threshold"))

    return _each_set(made)


QUERIES = {
    "block_metrics": lambda s, d: rounded(block_metrics(s, d), 6),
    "block_steps": lambda s, d: rounded(block_steps(s, d), 4),
    "distance_harness": lambda s, d: rounded(harness_metrics(s, d), 6),
    "distance_steps": lambda s, d: rounded(distance_steps(s, d), 4),
    "distance_lead_times": lambda s, d: rounded(distance_lead_times(s, d), 6),
    "coefficient_table": lambda s, d: rounded(coefficient_table(s, d), 6),
    "nested_model_tuning": lambda s, d: rounded(nested_choice_of_medians(tuning_medians(s, d)), 6),
}
ORACLE_SQL: dict[str, str] = {}
