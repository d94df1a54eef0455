"""Charts of whole records that do not fit one task: clock, baseline, Shewhart, CUSUM, EWMA and moving range by stretches.

Rows are ordered once, by a range shuffle, and cut into stretches: a row holds up to STRETCH intervals of a record as an
array. All that follows reads these rows where they lie. Each stretch is reduced to what the ones behind it need to know
(its size and time, total and least prefix of its sums, the mean at its end, the runs at its edges); windows over these
facts, a row for each stretch, give every stretch its start, from which it is charted by itself.

The results are those of ``charts`` over a record's ``full_record`` window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import charts
from .intervals import BASELINE_INTERVALS
from .scan import PART, attach, written
from .selection import HOLD, exact_percentiles

RECORD = ["record_id"]
#: What names a stretch.
PLACE = [*RECORD, PART, "_s"]
#: Intervals of one stretch, gathered in a row.
STRETCH = 4096
#: Rows that a task cuts together, in stretches.
CUT = 16
#: Influence of earlier stretches that is smaller than this is none in double precision.
NOTHING = 2.0**-60


def clocked(rows: DataFrame, order: Sequence[str], baseline: int = BASELINE_INTERVALS, parts: int | None = None) -> DataFrame:
    """What ``intervals.with_clock`` knows of (record_id, rr_ms), for records of any length, as stretches.

    A stretch has its intervals ``rr``, their number ``n``, the record's place ``at`` and milliseconds ``ms`` before it,
    the interval ``prev`` before it, and the record's ``n_total``, ``mu`` and ``sigma``. ``order`` must be total within a
    record. Records may be null.
    """
    tasks = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*RECORD, *order]
    ranged = rows.select(*keys, "rr_ms").repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    plain = ranged.select(*RECORD, F.spark_partition_id().alias(PART), F.col("rr_ms").cast("double").alias("rr"), F.col("rr_ms").cast("decimal(20,6)").alias("ms"))
    record = rows.schema["record_id"].dataType.simpleString()
    cut = written(plain.mapInArrow(_cut(STRETCH), f"record_id {record}, {PART} int, _s int, n long, rr array<double>, ms decimal(38,6), last double"), "stretches")
    order_ = Window.partitionBy(*RECORD).orderBy(PART, "_s")
    earlier = order_.rowsBetween(Window.unboundedPreceding, -1)
    places = cut.select(
        *PLACE,
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("at"),
        F.coalesce(F.sum("ms").over(earlier).cast("double"), F.lit(0.0)).alias("ms"),
        F.lag("last").over(order_).alias("prev"),
        F.sum("n").over(Window.partitionBy(*RECORD)).alias("n_total"),
    )
    placed = attach(cut.drop("ms", "last"), places, PLACE)
    first = placed.where(F.col("at") < baseline).select(*RECORD, F.explode(F.slice("rr", 1, F.least(F.col("n"), baseline - F.col("at")).cast("int"))).alias("_x"))
    sigma = F.stddev_samp("_x")
    return attach(placed, first.groupBy(*RECORD).agg(F.avg("_x").alias("mu"), F.when(sigma > 0, sigma).otherwise(1.0).alias("sigma")), RECORD)


def _cut(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: rows in order to stretches of one record and at most ``size`` rows."""

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= size * CUT:
                yield pa.concat_batches(held)
                held, n = [], 0
        if n:
            yield pa.concat_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in together(batches):
            codes = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            starts = [at for lo, hi in zip(bounds, bounds[1:]) for at in range(lo, hi, size)]
            ends = [*starts[1:], len(codes)]
            rr, ms = batch.column("rr"), batch.column("ms")
            sums = [pc.sum(ms[lo:hi]).as_py() for lo, hi in zip(starts, ends)]
            numbers = np.arange(number, number + len(starts), dtype=np.int32)
            number += len(starts)
            at = pa.array(starts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at), batch.column(1).take(at), pa.array(numbers), pa.array(np.subtract(ends, starts), pa.int64()),
                    pa.ListArray.from_arrays(pa.array([*starts, len(codes)], pa.int32()), rr), pa.array(sums, pa.decimal128(38, 6)), rr.take(pa.array(np.subtract(ends, 1))),
                ],
                names=["record_id", PART, "_s", "n", "rr", "ms", "last"],
            )

    return run


_TYPES = {"double": pa.float64(), "long": pa.int64()}


def _each(stretches: DataFrame, given: Sequence[str], made: Callable[[dict, np.ndarray], dict], out: dict[str, str]) -> DataFrame:
    """The columns ``out`` of every stretch, which ``made`` makes of its ``given`` columns and standardized intervals (NaN: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rr = batch.column("rr")
            values, ends = rr.flatten().to_numpy(zero_copy_only=False), np.cumsum(rr.value_lengths().to_numpy(zero_copy_only=False))
            rows = []
            for row, hi in zip(batch.select([*given, "n", "mu", "sigma"]).to_pylist(), ends):
                row["rr"] = values[hi - row["n"] : hi]
                rows.append(made(row, (row["rr"] - (np.nan if row["mu"] is None else row["mu"])) / row["sigma"]))
            columns = [pa.array([r[c] for r in rows], _TYPES[t]) for c, t in out.items()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in PLACE], *columns], names=[*PLACE, *out])

    schema = ", ".join([*[f"{c} {stretches.schema[c].dataType.simpleString()}" for c in PLACE], *[f"{c} {t}" for c, t in out.items()]])
    return stretches.select(*PLACE, "rr", *dict.fromkeys([*given, "n", "mu", "sigma"])).mapInArrow(run, schema)


def _prefixes(z: np.ndarray, sign: int, chart: charts.Chart) -> np.ndarray:
    """Running totals of a side's steps; a point without a value is no step."""
    return np.cumsum(np.where(np.isnan(z), 0.0, sign * z - chart.k))


def _reflected(z: np.ndarray, sign: int, chart: charts.Chart, start: float) -> np.ndarray:
    """max(0, S + step) from ``start``."""
    total = start + _prefixes(z, sign, chart)
    return total - np.minimum(0.0, np.minimum.accumulate(total))


def _smoothed(z: np.ndarray, chart: charts.Chart, start: float) -> np.ndarray:
    """The weighted mean from ``start``, of values that are all there."""
    return pd.Series(np.concatenate([[start], z])).ewm(alpha=chart.weight, adjust=False).mean().to_numpy()[1:]


def _beyond(s: np.ndarray, z: np.ndarray, chart: charts.Chart) -> np.ndarray:
    return (s > chart.h) & ~np.isnan(z)


def _sustained(beyond: np.ndarray, before: int, after: int, least: int) -> np.ndarray:
    """Points in runs of at least ``least``; ``before`` and ``after`` are what runs at the edges have outside."""
    turns = np.flatnonzero(np.diff(beyond, prepend=False, append=False))
    starts, ends = turns[::2], turns[1::2]
    lasting = ends - starts + before * (starts == 0) + after * (ends == len(beyond)) >= least
    marks = np.zeros(len(beyond) + 1, np.int64)
    marks[starts[lasting]] += 1
    marks[ends[lasting]] -= 1
    return np.cumsum(marks[:-1]) > 0


SIDES = {"pos": 1, "neg": -1}


def _sums(chart: charts.Chart) -> Callable[[dict, np.ndarray], dict]:
    """A stretch's total and least prefix on both sides, the mean at its end from 0, and the place of its first missing value."""

    def made(row: dict, z: np.ndarray) -> dict:
        out = {}
        for side, sign in SIDES.items():
            p = _prefixes(z, sign, chart)
            out |= {f"_t{side}": p[-1], f"_l{side}": p.min()}
        holes = np.flatnonzero(np.isnan(z))
        return out | {"_b": 0.0 if len(holes) else _smoothed(z, chart, 0.0)[-1], "_hole": row["at"] + holes[0] if len(holes) else None}

    return made


def _edges(chart: charts.Chart) -> Callable[[dict, np.ndarray], dict]:
    """The places of a stretch's first and last points that are not beyond the limit, on both sides."""

    def made(row: dict, z: np.ndarray) -> dict:
        out = {}
        for side, sign in SIDES.items():
            inside = row["at"] + np.flatnonzero(~_beyond(_reflected(z, sign, chart, row[f"_s{side}"]), z, chart))
            out |= {f"_f{side}": inside[0] if len(inside) else None, f"_z{side}": inside[-1] if len(inside) else None}
        return out

    return made


_FIGURES = {
    "out": "long", "top": "double", "out_at": "long", "out_t": "double", "pos_max": "double", "neg_max": "double", "pos_last": "double", "neg_last": "double", "alarms": "long", "alarm_at": "long", "alarm_t": "double",
    "t_max": "double", "e": "double", "e_top": "double", "e_out": "long", "e_first": "double", "sx": "double", "sy": "double", "sxy": "double", "sxx": "double",
}


def _figures(chart: charts.Chart) -> Callable[[dict, np.ndarray], dict]:
    """What a stretch adds to its record's charts; the mean ends at the record's first missing value."""
    bound = chart.ewma_limit * (chart.weight / (2.0 - chart.weight)) ** 0.5

    def made(row: dict, z: np.ndarray) -> dict:
        at = row["at"] + np.arange(len(z))
        t = (row["ms"] + np.cumsum(np.round(np.nan_to_num(row["rr"]), 6))) / 1000.0
        there = ~np.isnan(z)
        out = np.abs(z) > chart.limit
        s = {side: _reflected(z, sign, chart, row[f"_s{side}"]) for side, sign in SIDES.items()}
        alarm = np.logical_or(*[_sustained(_beyond(s[c], z, chart), row[f"_before{c}"], row[f"_after{c}"], chart.sustained) for c in SIDES])
        smooth = max(0, min(len(z), len(z) if row["_hole"] is None else row["_hole"] - row["at"]))
        e = _smoothed(z[:smooth], chart, row["_e"])
        far = np.abs(e) > bound
        half = 0 if row["n_total"] < 4 else row["n_total"] // 2
        tail = at[:smooth] >= half
        x, y = (at[:smooth][tail] - half).astype(float), e[tail]
        least = lambda v, m: v[m].min() if m.any() else None
        return {
            "out": out.sum(), "top": np.abs(z[there]).max() if there.any() else None, "out_at": least(at, out), "out_t": least(t, out), "pos_max": s["pos"].max(), "neg_max": s["neg"].max(), "pos_last": s["pos"][-1],
            "neg_last": s["neg"][-1], "alarms": alarm.sum(), "alarm_at": least(at, alarm), "alarm_t": least(t, alarm), "t_max": t.max(), "e": e[-1] if smooth else None, "e_top": np.abs(e).max(initial=0.0), "e_out": far.sum(),
            "e_first": t[:smooth][far][0] if far.any() else None, "sx": x.sum(), "sy": y.sum(), "sxy": x @ y, "sxx": x @ x,
        }

    return made


def _starts(sums: DataFrame, chart: charts.Chart) -> DataFrame:
    """Both sums and the mean before every stretch, and the record's first missing value.

    The mean is a short sum over the ends of the stretches before it; what lies further back is below double precision.
    """
    order = Window.partitionBy(*RECORD).orderBy("at")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    out = sums.withColumns({f"_c{s}": F.coalesce(F.sum(f"_t{s}").over(earlier), F.lit(0.0)) for s in SIDES})
    out = out.withColumns({f"_s{s}": F.col(f"_c{s}") - F.least(F.lit(0.0), F.min(F.col(f"_c{s}") + F.col(f"_l{s}")).over(earlier)) for s in SIDES})
    keep = 1 - chart.weight
    reach = math.ceil(math.log(NOTHING) / math.log(keep)) if keep > 0 else 0
    near = F.collect_list(F.struct("_b", (F.col("at") + F.col("n")).alias("end"))).over(order.rangeBetween(-(reach + STRETCH), -1))
    out = out.withColumn("_near", near).withColumn("_hole", F.min("_hole").over(Window.partitionBy(*RECORD)))
    mean = F.aggregate("_near", F.lit(0.0), lambda e, x: e + x["_b"] * F.pow(F.lit(keep), (F.col("at") - x["end"]).cast("double")))
    return out.select(*PLACE, *[f"_s{s}" for s in SIDES], mean.alias("_e"), "_hole")


def _outside(edges: DataFrame) -> DataFrame:
    """How far a run at a stretch's edge reaches before and behind it, on both sides."""
    # backward figures run forward over the reversed order: frames that end at the last row are made anew for each row
    frames = [Window.partitionBy(*RECORD).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("at"), F.desc("at"))]
    at = F.col("at")
    before = {f"_before{s}": at - F.coalesce(F.max(f"_z{s}").over(frames[0]), F.lit(-1)) - 1 for s in SIDES}
    after = {f"_after{s}": F.coalesce(F.min(f"_f{s}").over(frames[1]), F.col("n_total")) - at - F.col("n") for s in SIDES}
    return edges.select(*PLACE, *[v.alias(c) for c, v in (before | after).items()])


def point_charts(record: DataFrame, chart: charts.Chart) -> DataFrame:
    """Shewhart, CUSUM and EWMA features of each record."""
    sums = {**{f"_{k}{s}": "double" for s in SIDES for k in "tl"}, "_b": "double", "_hole": "long"}
    known = record.select(*PLACE, "at", "n", "n_total")
    starts = _starts(attach(known, _each(record, ["at"], _sums(chart), sums), PLACE), chart)
    started = attach(record, starts, PLACE)
    edges = _each(started, ["at", "_spos", "_sneg"], _edges(chart), {f"_{k}{s}": "long" for s in SIDES for k in "fz"})
    met = attach(started, _outside(attach(known, edges, PLACE)), PLACE)
    given = ["at", "ms", "n_total", "_spos", "_sneg", "_e", "_hole", *[f"_{k}{s}" for s in SIDES for k in ("before", "after")]]
    figures = attach(known, _each(met, given, _figures(chart), _FIGURES), PLACE)
    holes = starts.groupBy(*RECORD).agg(F.first("_hole").alias("_hole"))
    least = ["out_at", "out_t", "alarm_at", "alarm_t", "e_first"]
    largest = ["top", "pos_max", "neg_max", "t_max", "e_top"]
    last = ["pos_last", "neg_last", "e"]
    total = ["out", "alarms", "e_out", "sx", "sy", "sxy", "sxx"]
    made = {**{c: F.min(c) for c in least}, **{c: F.max(c) for c in largest}, **{c: F.max_by(c, "at") for c in last}, **{c: F.sum(c) for c in total}}
    out = attach(figures.groupBy(*RECORD).agg(F.first("n_total").alias("n"), *[v.alias(c) for c, v in made.items()]), holes, RECORD)
    share = F.col("alarms") / F.col("n")
    place = lambda c: F.coalesce(c, F.lit(-1)).cast("double")
    values = {
        "shewhart_out_count": F.col("out"), "shewhart_out_rate": F.col("out") / F.col("n"), "shewhart_max_abs_z": F.col("top"), "shewhart_first_alarm_pos": place("out_at"), "shewhart_first_alarm_time_sec": F.col("out_t"),
        "cusum_pos_max": F.col("pos_max"), "cusum_neg_max": F.col("neg_max"), "cusum_abs_max": F.greatest("pos_max", "neg_max"), "cusum_last_pos": F.col("pos_last"), "cusum_last_neg": F.col("neg_last"),
        "cusum_alarm_count": F.col("alarms"), "cusum_first_alarm_pos": place("alarm_at"), "cusum_first_alarm_time_sec": F.col("alarm_t"), "cusum_time_in_alarm": share * F.col("t_max"), "cusum_alarm_density": share,
    }
    # behind a missing value the mean is unknown, and with it all that counts its points
    whole = lambda c: F.when(F.col("_hole").isNull(), F.col(c))
    mean = F.struct(whole("e").alias("e"), F.col("e_top").alias("top"), F.col("e_first").alias("first"), whole("e_out").alias("out"), "sx", whole("sy").alias("sy"), whole("sxy").alias("sxy"), "sxx")
    smooth = charts.ewma_results(charts.ewma_half(True), F.col("_f"))
    out = out.withColumn("_f", mean)
    return out.select(*RECORD, F.col("n").alias("n_rr"), *[_enough("n", v).alias(c) for c, v in values.items()], *[v.alias(c) for c, v in smooth.items()])


def _enough(n: str, value: Column) -> Column:
    return F.when(F.col(n) >= 6, value).cast("double")


def moving_ranges(record: DataFrame, hold: int = HOLD) -> DataFrame:
    """The moving range features of each record and its size; medians are exact at any size."""
    before = F.concat(F.array("prev"), F.slice("rr", 1, (F.col("n") - 1).cast("int")))
    spaced = written(record.select(*RECORD, F.explode(F.zip_with("rr", before, lambda x, y: F.abs(x - y))).alias("_mr")), "ranges")
    facts = spaced.groupBy(*RECORD).agg(F.count(F.lit(1)).alias("n"), F.avg("_mr").alias("mr_mean"), F.max("_mr").alias("mr_max"))
    middle = exact_percentiles(spaced, RECORD, F.col("_mr"), [0.5], hold).select(*RECORD, F.col("value").alias("mr_median"))
    known = written(attach(facts, middle, RECORD, "left"), "facts")
    ranged = attach(spaced, known.drop("n", "mr_max"), RECORD)
    far = exact_percentiles(ranged, RECORD, F.abs(F.col("_mr") - F.col("mr_median")), [0.5], hold).select(*RECORD, F.col("value").alias("mr_mad"))
    out = ranged.groupBy(*RECORD).agg(F.count_if(F.col("_mr") > charts.MOVING_RANGE_FACTOR * F.col("mr_mean")).alias("mr_out_count"))
    both = attach(attach(known, out, RECORD), far, RECORD, "left")
    return both.select(*RECORD, *[_enough("n", F.col(c)).alias(c) for c in ("mr_mean", "mr_median", "mr_max", "mr_out_count", "mr_mad")])


def record_charts(record: DataFrame, chart: charts.Chart = charts.Chart(), hold: int = HOLD) -> DataFrame:
    """One row for each record: 25 features of four charts over all its intervals, and its size.

    ``record`` is of ``clocked``. Records of fewer than six intervals have nulls.
    """
    points = attach(point_charts(record, chart), moving_ranges(record, hold), RECORD)
    first = [c for c in points.columns if not c.startswith(("mr_", "ewma_"))]
    return points.select(*first, *[c for k in ("mr_", "ewma_") for c in points.columns if c.startswith(k)])
