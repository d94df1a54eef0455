"""Features of windows: variability, control charts and symbol patterns, as window functions and aggregates.

All take the rows that ``windows.multi_scale`` makes and group by its keys, so no further shuffle is needed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .windows import KEYS

# Fixed values of the charts.
MOVING_RANGE_FACTOR = 3.267
SHORT, LONG = 0.75, 1.25


@dataclass(frozen=True)
class Chart:
    """Chart settings: CUSUM limit, slack and sustained length; EWMA weight and limit; Shewhart limit."""

    h: float = 7.0
    k: float = 0.5
    sustained: int = 2
    weight: float = 0.2
    ewma_limit: float = 2.7
    limit: float = 3.0


def _whole() -> WindowSpec:
    return Window.partitionBy(*KEYS)


def _ordered() -> WindowSpec:
    return _whole().orderBy("pos")


def _least_n(n: int, value: Column) -> Column:
    return F.when(F.first("n") >= n, value).cast("double")


@dataclass(frozen=True)
class Part:
    """A family of features: rows with helper columns, aggregates of a window's rows, and results made from these.

    ``then`` has helper columns between aggregates and results.
    """

    rows: DataFrame
    values: dict[str, Column]
    finish: dict[str, Column] | None = None
    then: dict[str, Column] | None = None


def _features(*parts: Callable[[DataFrame], Part], more: dict[str, Column] | None = None) -> Callable[[DataFrame], DataFrame]:
    """All families from one pass over the windows: helper columns one after another, then one aggregate by window."""

    def made(windowed: DataFrame) -> DataFrame:
        rows, values, finish, then = windowed, dict(more or {}), {c: F.col(c) for c in more or {}}, {}
        for part in parts:
            found = part(rows)
            rows, values = found.rows, values | found.values
            finish |= found.finish or {c: F.col(c) for c in found.values}
            then |= found.then or {}
        # the rows are in the windows' order already; a hash aggregate of lists would sort them all once more
        rows.sparkSession.conf.set("spark.sql.execution.replaceHashWithSortAgg", "true")
        out = rows.groupBy(*KEYS).agg(F.first("n").alias("n"), *[v.alias(c) for c, v in values.items()])
        return out.withColumns(then).select(*KEYS, *[v.alias(c) for c, v in finish.items()])

    return made


def _variability(windowed: DataFrame) -> Part:
    x = F.col("rr_ms")
    rows = windowed.withColumn("_vd", x - F.lag(x).over(_ordered())).withColumn("_vfar", F.abs(x - F.median(x).over(_whole())))
    sd, mean = F.stddev_samp(x), F.avg(x)
    root = F.sqrt(F.avg(F.col("_vd") * F.col("_vd")))
    sd1 = root / F.sqrt(F.lit(2.0))
    sd2 = F.sqrt(F.greatest(F.lit(0.0), 2 * sd * sd - sd1 * sd1))
    four = {
        "mean_rr": mean,
        "median_rr": F.median(x),
        "std_rr": sd,
        "mad_rr": F.median("_vfar"),
        "rmssd": root,
        "sdsd": F.stddev_samp("_vd"),
        "cv_rr": F.when(mean > 0, sd / mean),
        "rr_diff_mean": F.avg(F.abs("_vd")),
        "rr_diff_std": F.stddev_samp("_vd"),
    }
    three = {"sd1": sd1, "sd2": sd2, "sd1_sd2_ratio": F.when(sd2 > 0, sd1 / sd2)}
    return Part(rows, {c: _least_n(4, v) for c, v in four.items()} | {c: _least_n(3, v) for c, v in three.items()})


def variability(windowed: DataFrame) -> DataFrame:
    """Nine variability features, null under 4 intervals, and three of the Poincare plot, null under 3."""
    return _features(_variability)(windowed)


def shewhart_values(chart: Chart) -> dict[str, Column]:
    """The Shewhart features as aggregates of a window's rows."""
    out = F.abs("z") > chart.limit
    values = {
        "shewhart_out_count": F.count_if(out),
        "shewhart_out_rate": F.count_if(out) / F.count(F.lit(1)),
        "shewhart_max_abs_z": F.max(F.abs("z")),
        "shewhart_first_alarm_pos": F.coalesce(F.min(F.when(out, F.col("pos"))), F.lit(-1)).cast("double"),
        "shewhart_first_alarm_time_sec": F.min(F.when(out, F.col("t_local"))),
    }
    return {c: _least_n(6, v) for c, v in values.items()}


def _shewhart(windowed: DataFrame, chart: Chart) -> Part:
    return Part(windowed, shewhart_values(chart))


def shewhart(windowed: DataFrame, chart: Chart = Chart()) -> DataFrame:
    """Points beyond the limit: count, rate, largest deviation, and place and time of the first (-1 and null if none)."""
    return _features(lambda w: _shewhart(w, chart))(windowed)


def cusum_points(windowed: DataFrame, chart: Chart = Chart(), keys: list[str] = KEYS) -> DataFrame:
    """Both cumulative sums and the alarm at every point.

    max(0, S + x) over time equals the running total of x less the least of 0 and the total's running minimum. A
    point is in alarm if it lies in a run of at least ``sustained`` points beyond the limit, on either side; a point
    without a value breaks a run.
    """
    whole = Window.partitionBy(*keys)
    ordered = whole.orderBy("pos")
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = windowed.withColumn("_p", F.sum(F.col("z") - chart.k).over(upto)).withColumn("_m", F.sum(-F.col("z") - chart.k).over(upto))
    rows = rows.withColumn("s_pos", F.col("_p") - F.least(F.lit(0.0), F.min("_p").over(upto))).withColumn("s_neg", F.col("_m") - F.least(F.lit(0.0), F.min("_m").over(upto)))
    rows = rows.withColumns({f"_x{side}": F.col("z").isNotNull() & F.coalesce(F.col(f"s_{side}") > chart.h, F.lit(False)) for side in ("pos", "neg")})
    rows = _with_lengths(rows, {"_rpos": "_xpos", "_rneg": "_xneg"}, ordered)
    alarm = _sustained("_rpos", chart.sustained, ordered) | _sustained("_rneg", chart.sustained, ordered)
    return rows.withColumn("alarm", alarm).drop("_p", "_m", "_xpos", "_rpos", "_xneg", "_rneg")


def _with_lengths(rows: DataFrame, flags: dict[str, str], ordered: WindowSpec) -> DataFrame:
    """For each flag the length so far of the stretch of true values that a row lies in, 0 outside; the rows' order serves all of them."""
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_at", F.row_number().over(ordered))
    ends = {f"_e{n}": F.max(F.when(~F.col(x), F.col("_at"))).over(upto) for n, x in flags.items()}
    rows = rows.withColumns(ends)
    return rows.withColumns({n: F.when(F.col(x), F.col("_at") - F.coalesce(F.col(f"_e{n}"), F.lit(0))).otherwise(0) for n, x in flags.items()}).drop("_at", *ends)


def _sustained(length: str, least: int, ordered: WindowSpec) -> Column:
    """Whether a row lies in a stretch of at least ``least`` rows: then the length so far comes to that within ``least`` - 1 rows."""
    return F.max(length).over(ordered.rowsBetween(0, least - 1)) >= least


def cusum_sweep(windowed: DataFrame, slacks: list[float], limits: list[float], sustained: list[int], by: list[str]) -> DataFrame:
    """(by, k, h, sustained, alarms) for every setting, without recomputing what settings share.

    Sums depend on the slack alone and lengths of runs on slack and limit; each sustained length only compares them.
    """
    rows = _sweep_points(windowed, slacks, limits, sustained)
    counts = {(i, j, s): F.count_if(f"_a{i}_{j}_{s}") for i in range(len(slacks)) for j in range(len(limits)) for s in sustained}
    out = rows.groupBy(*by).agg(*[v.alias(f"c{i}_{j}_{s}") for (i, j, s), v in counts.items()])
    made = [F.struct(F.lit(slacks[i]).alias("k"), F.lit(limits[j]).alias("h"), F.col(f"c{i}_{j}_{s}").alias("alarms"), F.lit(s).alias("sustained")) for i, j, s in counts]
    return out.select(*by, F.inline(F.array(*made)))


def _sweep_points(windowed: DataFrame, slacks: list[float], limits: list[float], sustained: list[int]) -> DataFrame:
    """Both sums of every slack (``_sp{i}``, ``_sn{i}``) and whether a point is in alarm under every slack, limit and length (``_a{i}_{j}_{length}``).

    Settings are columns and not rows, so that a window's points are ordered once for all of them.
    """
    ordered = _ordered()
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = windowed.select(*KEYS, "pos", "z", "t_local")
    steps = {f"{side}{i}": (F.col("z") if side == "p" else -F.col("z")) - k for i, k in enumerate(slacks) for side in "pn"}
    rows = rows.withColumns({f"_t{n}": F.sum(step).over(upto) for n, step in steps.items()})
    rows = rows.withColumns({f"_s{n}": F.col(f"_t{n}") - F.least(F.lit(0.0), F.min(f"_t{n}").over(upto)) for n in steps}).drop(*[f"_t{n}" for n in steps])
    flags = {f"_x{n}_{j}": F.coalesce(F.col(f"_s{n}") > h, F.lit(False)) for n in steps for j, h in enumerate(limits)}
    rows = _with_lengths(rows.withColumns(flags), {f"_r{x[2:]}": x for x in flags}, ordered)
    found = {f"_a{i}_{j}_{s}": _sustained(f"_rp{i}_{j}", s, ordered) | _sustained(f"_rn{i}_{j}", s, ordered) for i in range(len(slacks)) for j in range(len(limits)) for s in sustained}
    return rows.withColumns(found).drop(*flags, *[f"_r{x[2:]}" for x in flags])


def cusum_features_sweep(windowed: DataFrame, slacks: list[float], limits: list[float], sustained: list[int]) -> DataFrame:
    """Eight CUSUM features of each window under every setting (k, h, sustained)."""
    rows = _sweep_points(windowed, slacks, limits, sustained)
    settings = [(i, j, s) for i in range(len(slacks)) for j in range(len(limits)) for s in sustained]
    tops = [F.max(f"_s{side}{i}").alias(f"t{side}{i}") for i in range(len(slacks)) for side in "pn"]
    lasts = [F.max_by(f"_s{side}{i}", "pos").alias(f"l{side}{i}") for i in range(len(slacks)) for side in "pn"]
    out = rows.groupBy(*KEYS).agg(*tops, *lasts, *[F.count_if(f"_a{i}_{j}_{s}").alias(f"c{i}_{j}_{s}") for i, j, s in settings], F.count(F.lit(1)).alias("_n"), F.max("t_local").alias("_t"))

    def setting(i: int, j: int, s: int) -> Column:
        count = F.col(f"c{i}_{j}_{s}")
        share = count / F.col("_n")
        values = {
            "k": F.lit(slacks[i]), "h": F.lit(limits[j]), "sustained": F.lit(s), "cusum_pos_max": F.col(f"tp{i}"), "cusum_neg_max": F.col(f"tn{i}"), "cusum_abs_max": F.greatest(f"tp{i}", f"tn{i}"),
            "cusum_last_pos": F.col(f"lp{i}"), "cusum_last_neg": F.col(f"ln{i}"), "cusum_alarm_count": count.cast("double"), "cusum_alarm_density": share, "cusum_time_in_alarm": share * F.col("_t"),
        }
        return F.struct(*[v.alias(c) for c, v in values.items()])

    return out.select(*KEYS, F.inline(F.array(*[setting(*x) for x in settings])))


def ewma_features_sweep(windowed: DataFrame, weights: list[float], limits: dict[float, float]) -> DataFrame:
    """Four EWMA features of each window for every weight ``lam`` and every limit; ``limits`` maps what a limit is called by (``shewhart_l``) to it."""
    series = windowed.groupBy(*KEYS).agg(F.first("n").alias("n"), _sorted("z").alias("_ez"), _sorted("t_local").alias("_et"))
    settings = [F.struct(F.lit(w).alias("lam"), F.lit(name).alias("shewhart_l"), F.lit(limit).alias("limit")) for w in weights for name, limit in limits.items()]
    rows = series.select("*", F.inline(F.array(*settings)))
    pairs = F.zip_with("_ez", "_et", lambda z, t: F.struct(z.alias("z"), t.alias("t")))
    half = ewma_half(True)
    folded = rows.withColumn("_f", ewma_fold(pairs, Chart(weight=F.col("lam"), ewma_limit=F.col("limit")), half, F.lit(0.0), F.lit(0)))
    made = {c: v for c, v in ewma_results(half, F.col("_f")).items() if c != "ewma_first_alarm_time_sec"}
    return folded.select(*KEYS, "lam", "shewhart_l", *[v.alias(c) for c, v in made.items()])


def shewhart_features_sweep(windowed: DataFrame, limits: list[float]) -> DataFrame:
    """Three Shewhart features of each window under every limit."""
    counts = [F.count_if(F.abs("z") > limit).alias(f"s{i}") for i, limit in enumerate(limits)]
    out = windowed.groupBy(*KEYS).agg(*counts, F.count(F.lit(1)).alias("_n"), F.max(F.abs("z")).alias("shewhart_max_abs_z"))
    rows = out.select(*KEYS, "_n", "shewhart_max_abs_z", F.inline(F.array(*[F.struct(F.lit(x).alias("shewhart_l"), F.col(f"s{i}").cast("double").alias("shewhart_out_count")) for i, x in enumerate(limits)])))
    return rows.withColumn("shewhart_out_rate", F.col("shewhart_out_count") / F.col("_n")).drop("_n")


def ranges_and_runs(windowed: DataFrame) -> DataFrame:
    """Features that no chart setting changes."""
    return _features(_moving_range, _runs)(windowed)


def cusum_values() -> dict[str, Column]:
    """The CUSUM features as aggregates of a window's points."""
    share = F.count_if("alarm") / F.count(F.lit(1))
    values = {
        "cusum_pos_max": F.max("s_pos"),
        "cusum_neg_max": F.max("s_neg"),
        "cusum_abs_max": F.greatest(F.max("s_pos"), F.max("s_neg")),
        "cusum_last_pos": F.max_by("s_pos", "pos"),
        "cusum_last_neg": F.max_by("s_neg", "pos"),
        "cusum_alarm_count": F.count_if("alarm"),
        "cusum_first_alarm_pos": F.coalesce(F.min(F.when(F.col("alarm"), F.col("pos"))), F.lit(-1)).cast("double"),
        "cusum_first_alarm_time_sec": F.min(F.when(F.col("alarm"), F.col("t_local"))),
        "cusum_time_in_alarm": share * F.max("t_local"),
        "cusum_alarm_density": share,
    }
    return {c: _least_n(6, v) for c, v in values.items()}


def _cusum(windowed: DataFrame, chart: Chart) -> Part:
    return Part(cusum_points(windowed, chart), cusum_values())


def cusum(windowed: DataFrame, chart: Chart = Chart()) -> DataFrame:
    """Largest and last sums, and count, place, time and share of the points in alarm; null under 6 intervals."""
    return _features(lambda w: _cusum(w, chart))(windowed)


def _sorted(value: str) -> Column:
    """A window's values in order of position."""
    return F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda s: s[value])


def ewma_half(whole_tail: bool) -> Column:
    """Where the half of a window begins over which its slope is taken."""
    return F.when((F.col("n") < 4) & F.lit(whole_tail), 0).otherwise(F.floor(F.col("n") / 2))


def ewma_fold(pairs: Column, chart: Chart, half: Column, before: Column, place: Column) -> Column:
    """The mean and its figures over (z, t) pairs in order, of which the first is the window's ``place``-th, from the mean ``before`` it."""
    bound = chart.ewma_limit * (chart.weight / (2.0 - chart.weight)) ** 0.5
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    start = F.struct(before.alias("e"), zero.alias("top"), F.lit(0).cast("long").alias("out"), none.alias("first"), place.cast("long").alias("i"), zero.alias("sx"), zero.alias("sy"), zero.alias("sxy"), zero.alias("sxx"))

    def step(a: Column, x: Column) -> Column:
        e = chart.weight * x["z"] + (1 - chart.weight) * a["e"]
        beyond = F.abs(e) > bound
        place = (a["i"] - half).cast("double")
        tail = a["i"] >= half
        add = lambda old, new: old + F.when(tail, new).otherwise(0.0)
        return F.struct(
            e.alias("e"), F.greatest(a["top"], F.abs(e)).alias("top"), (a["out"] + beyond.cast("long")).alias("out"), F.coalesce(a["first"], F.when(beyond, x["t"])).alias("first"),
            (a["i"] + 1).alias("i"), add(a["sx"], place).alias("sx"), add(a["sy"], e).alias("sy"), add(a["sxy"], place * e).alias("sxy"), add(a["sxx"], place * place).alias("sxx"),
        )

    return F.aggregate(pairs, start, step)


def ewma_results(half: Column, f: Column) -> dict[str, Column]:
    m = (F.col("n") - half).cast("double")
    spread = m * f["sxx"] - f["sx"] * f["sx"]
    values = {
        "ewma_last": f["e"],
        "ewma_max_abs": f["top"],
        "ewma_slope": F.when(spread > 0, (m * f["sxy"] - f["sx"] * f["sy"]) / spread),
        "ewma_alarm_count": f["out"],
        "ewma_first_alarm_time_sec": f["first"],
    }
    return {c: F.when(F.col("n") >= 6, v).cast("double") for c, v in values.items()}


def _ewma(windowed: DataFrame, chart: Chart, whole_tail: bool) -> Part:
    pairs = F.zip_with("_ez", "_et", lambda z, t: F.struct(z.alias("z"), t.alias("t")))
    half = ewma_half(whole_tail)
    fold = ewma_fold(pairs, chart, half, F.lit(0.0), F.lit(0))
    return Part(windowed, {"_ez": _sorted("z"), "_et": _sorted("t_local")}, ewma_results(half, F.col("_f")), {"_f": fold})


def ewma(windowed: DataFrame, chart: Chart = Chart(), whole_tail: bool = True) -> DataFrame:
    """Exponentially weighted mean from 0: last, largest, slope of the second half, alarms and the first one's time.

    The recurrence is one fold over the window's values, in the JVM. With ``whole_tail`` windows of fewer than four
    points use all points for the slope.
    """
    return _features(lambda w: _ewma(w, chart, whole_tail))(windowed)


def ewma_sweep(windowed: DataFrame, weights: list[float], by: list[str], limit: float = 2.7) -> DataFrame:
    """(by, lam, alarms): points beyond the limit of every weight's own spread; a window's values are gathered once for all weights."""
    series = windowed.groupBy(*KEYS).agg(_sorted("z").alias("_z"))
    rows = series.select(*KEYS, "_z", F.explode(F.array(*[F.lit(w) for w in weights])).alias("lam"))
    bound = limit * F.sqrt(F.col("lam") / (2.0 - F.col("lam")))

    def step(a: Column, z: Column) -> Column:
        e = F.col("lam") * z + (1 - F.col("lam")) * a["e"]
        return F.struct(e.alias("e"), (a["out"] + F.coalesce(F.abs(e) > bound, F.lit(False)).cast("long")).alias("out"))

    counted = rows.withColumn("_f", F.aggregate("_z", F.struct(F.lit(0.0).alias("e"), F.lit(0).cast("long").alias("out")), step))
    return counted.groupBy(*by, "lam").agg(F.sum("_f.out").alias("alarms"))


def shewhart_sweep(windowed: DataFrame, limits: list[float], by: list[str]) -> DataFrame:
    """(by, shewhart_l, alarms): points beyond every limit."""
    counts = [F.count_if(F.abs("z") > limit).alias(str(i)) for i, limit in enumerate(limits)]
    long = windowed.groupBy(*by).agg(*counts).unpivot(by, [str(i) for i in range(len(limits))], "_i", "alarms")
    return long.withColumn("shewhart_l", F.element_at(F.array(*[F.lit(x) for x in limits]), F.col("_i").cast("int") + 1)).drop("_i")


def chart_grid(windowed: DataFrame, slacks: list[float], limits: list[float], weights: list[float], sustained: list[int], shewhart_limits: list[float], by: list[str]) -> DataFrame:
    """Alarms of the three charts of every ``by`` under the product of all settings.

    Each chart runs over its own settings alone, so windows are charted for 27 + 3 + 2 and not for 162 settings at the
    usual grid; only counts by ``by`` meet. Windows under 6 intervals are left out, as their features are null.
    """
    rows = windowed.where("n >= 6")
    cusums = cusum_sweep(rows, slacks, limits, sustained, by).withColumnRenamed("alarms", "cusum_alarms")
    ewmas = ewma_sweep(rows, weights, by).withColumnRenamed("alarms", "ewma_alarms")
    beyond = shewhart_sweep(rows, shewhart_limits, by).withColumnRenamed("alarms", "shewhart_alarms")
    return cusums.join(ewmas, by).join(beyond, by)


def _moving_range(windowed: DataFrame) -> Part:
    rows = windowed.withColumn("_mr", F.abs(F.col("rr_ms") - F.lag("rr_ms").over(_ordered())))
    rows = rows.withColumn("_mfar", F.abs(F.col("_mr") - F.median("_mr").over(_whole()))).withColumn("_mout", F.col("_mr") > MOVING_RANGE_FACTOR * F.avg("_mr").over(_whole()))
    values = {"mr_mean": F.avg("_mr"), "mr_median": F.median("_mr"), "mr_max": F.max("_mr"), "mr_mad": F.median("_mfar"), "mr_out_count": F.count_if("_mout")}
    return Part(rows, {c: _least_n(6, v) for c, v in values.items()})


def moving_range(windowed: DataFrame) -> DataFrame:
    """Absolute differences of neighbours: mean, median, largest, median deviation, points beyond 3.267 means."""
    return _features(_moving_range)(windowed)


def longest(symbols: Column, symbol: str) -> Column:
    """Length of the longest stretch of one symbol, 0 if there is none."""
    found = F.regexp_extract_all(symbols, F.lit(f"({symbol}+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(found, lambda s: F.length(s))), F.lit(0))


def _runs(windowed: DataFrame) -> Part:
    z = F.col("z")
    rows = windowed.withColumn("_rmed", F.median(z).over(_whole())).withColumn("_rd", z - F.lag(z).over(_ordered()))
    for name, span, beyond, need in (("two", 3, 2.0, 2), ("one", 5, 1.0, 4)):
        over = _ordered().rowsBetween(1 - span, 0)
        high, low = F.sum((z > beyond).cast("int")).over(over), F.sum((z < -beyond).cast("int")).over(over)
        rows = rows.withColumn(f"_{name}", (F.col("pos") >= span - 1) & ((high >= need) | (low >= need)))
    side = F.when(z > F.col("_rmed"), "A").when(z < F.col("_rmed"), "B").otherwise("M")
    turn = F.when(F.col("_rd") > 0, "U").when(F.col("_rd") < 0, "D").otherwise("E")
    rows = rows.withColumn("_side", side).withColumn("_turn", turn)
    values = {"_sides": F.array_join(_sorted("_side"), ""), "_turns": F.array_join(_sorted("_turn"), ""), "_two": F.max("_two"), "_one": F.max("_one")}
    steps = lambda s: F.when(longest(F.col("_turns"), s) > 0, longest(F.col("_turns"), s) + 1).otherwise(0)
    then = {"_a": longest(F.col("_sides"), "A"), "_b": longest(F.col("_sides"), "B"), "_u": steps("U"), "_v": steps("D")}
    rules = (F.greatest("_a", "_b") >= 8).cast("int") + (F.greatest("_u", "_v") >= 6).cast("int") + F.col("_two").cast("int") + F.col("_one").cast("int")
    finish = {"longest_run_above_median": F.col("_a"), "longest_run_below_median": F.col("_b"), "trend_run_up_max": F.col("_u"), "trend_run_down_max": F.col("_v"), "n_runs_rule_violations": rules}
    return Part(rows, values, {c: F.when(F.col("n") >= 6, v).cast("double") for c, v in finish.items()}, then)


def runs(windowed: DataFrame) -> DataFrame:
    """Longest stretches above and below the window's median, longest trends in points, and four run rules."""
    return _features(_runs)(windowed)


def _ectopy(windowed: DataFrame) -> Part:
    x, median = F.col("rr_ms"), F.median("rr_ms").over(_whole())
    rows = windowed.withColumn("_xmed", median)
    rows = rows.withColumn("_xs", F.when(x < SHORT * F.col("_xmed"), "S").when(x > LONG * F.col("_xmed"), "L").otherwise("N"))
    values = {"_xmed": F.first("_xmed"), "_xs": F.array_join(_sorted("_xs"), "")}
    count = lambda p: F.regexp_count("_xs", F.lit(p)).cast("long")
    finish = {
        "ectopy_like_count": count("[SL]"),
        "ectopy_like_density": count("[SL]") / F.col("n"),
        "short_long_sequence_count": count("SL"),
        "compensatory_pause_like_count": count("SL"),
        "bigeminy_like_pattern_count": count("(SN){2,}"),
        "trigeminy_like_pattern_count": count("(SNN){2,}"),
        "atrial_tachy_like_run_count": count("S{3,}"),
    }
    fits = (F.col("n") >= 5) & (F.col("_xmed") > 0)
    return Part(rows, values, {c: F.when(fits, v).cast("double") for c, v in finish.items()})


def ectopy(windowed: DataFrame) -> DataFrame:
    """Short and long intervals against the window's median, and patterns of them found in a string of symbols.

    Null under 5 intervals or if the median is not positive.
    """
    return _features(_ectopy)(windowed)


def _bounds() -> dict[str, Column]:
    """Provenance of a window, as aggregates of its rows."""
    return {"start_time_sec": F.first("start_time_sec"), "end_time_sec": F.first("end_time_sec"), "n_rr": F.count(F.lit(1))}


def variability_with_bounds(windowed: DataFrame) -> DataFrame:
    """The variability features with each window's bounds and size."""
    return _features(_variability, more=_bounds())(windowed)


def cusum_with_bounds(windowed: DataFrame, chart: Chart = Chart()) -> DataFrame:
    """The CUSUM features with each window's bounds and size."""
    return _features(lambda w: _cusum(w, chart), more=_bounds())(windowed)


def all_features(windowed: DataFrame, chart: Chart = Chart()) -> DataFrame:
    """One row for each window with provenance and all 49 features, from one pass and one aggregate."""
    parts = (_variability, lambda w: _shewhart(w, chart), lambda w: _cusum(w, chart), lambda w: _ewma(w, chart, True), _moving_range, _runs, _ectopy)
    return _features(*parts, more=_bounds())(windowed)
