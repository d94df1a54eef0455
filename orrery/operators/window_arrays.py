"""All features of the windows of records that tasks hold whole, from arrays of their intervals.

What ``charts`` says by window functions over a row for each interval and window is taken here from each interval once:
windows of one scale are columns of a matrix, their intervals its rows. Sums run in the order of the intervals, as
there, so that figures are the same. Records that do not fit this (too long, or with intervals that are missing, negative
or not finite) are left to ``charts``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import features as names
from . import charts, windows
from .windows import KEYS

#: Intervals that are charted together.
ROWS = 1 << 16
#: Intervals of the longest record that a task holds as arrays.
LONGEST = 50_000
#: Intervals of the least window that charts say anything of.
LEAST_CHARTED = 6
#: The longest interval, in ms.
LARGEST = 1e9
_KEPT = ["record_id", "idx", "rr_ms", "t", "z"]
_BOUNDS = ["start_time_sec", "end_time_sec"]


def fits(value: Column) -> Column:
    """Whether an interval keeps its record's clock running: there, finite and not negative."""
    return F.coalesce(value.between(0.0, LARGEST), F.lit(False))


def unfit_records(rows: DataFrame, record: str, value: Column) -> int:
    """How many records ``charts`` has to take."""
    each = rows.groupBy(record).agg(F.count(F.lit(1)).alias("n"), F.count_if(~fits(value)).alias("bad"))
    return each.where((F.col("n") > LONGEST) | (F.col("bad") > 0)).count()


def split(clocked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the records that fit, and those of the others."""
    marked = clocked.withColumn("_fit", (F.col("n_total") <= LONGEST) & F.min(fits(F.col("rr_ms"))).over(Window.partitionBy("record_id")))
    return marked.where("_fit").drop("_fit"), marked.where("NOT _fit").drop("_fit")


def all_features(clocked: DataFrame, counts: Sequence[int], seconds: Sequence[float], full: float, chart: charts.Chart = charts.Chart(), task: str = "", least: int = 2) -> DataFrame:
    """``charts.all_features`` over ``windows.multi_scale`` of records that fit; a task has a record's rows whole, as ``with_clock`` leaves them."""
    scales = _scales(counts, seconds, full, task, least)
    kind = clocked.schema["record_id"].dataType.simpleString()
    schema = f"record_id {kind}, window_type string, window_size double, window_index bigint, start_time_sec double, end_time_sec double, n_rr bigint, " + ", ".join(f"{c} double" for c in names.ALL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_records(batches):
            held = _Records(table)
            for scale in scales:
                for w in held.windows(scale):
                    made = _all(w, chart)
                    start, end = w.bounds()
                    keys = [held.ids.take(pa.array(w.record)), pa.array([scale.kind] * len(w.n)), pa.array(np.full(len(w.n), scale.size)), pa.array(w.index), pa.array(start), pa.array(end), pa.array(w.n)]
                    yield pa.RecordBatch.from_arrays([*keys, *[pa.array(made[c], pa.float64(), from_pandas=True) for c in names.ALL]], names=[*KEYS, *_BOUNDS, "n_rr", *names.ALL])

    out = clocked.select(*_KEPT).sortWithinPartitions("record_id", "idx").mapInArrow(run, schema)
    return out.withColumns({c: windows.four_places(F.col(c)) for c in _BOUNDS})


@dataclass(frozen=True)
class Grid:
    """Settings that charts are tried under; each EWMA limit goes with the Shewhart limit at its place."""

    limits: Sequence[float]
    slacks: Sequence[float]
    weights: Sequence[float]
    lengths: Sequence[int]
    shewhart_limits: Sequence[float]
    ewma_limits: Sequence[float]

    @property
    def settings(self) -> list[tuple]:
        """(h, k, lam, sustained, shewhart_l) in order."""
        return list(product(self.limits, self.slacks, self.weights, self.lengths, self.shewhart_limits))

    @property
    def columns(self) -> list[tuple]:
        """What is told apart: a feature and those of the settings that change it."""
        made = [(c, k) for k in self.slacks for c in names.CUSUM[:5]]
        made += [(c, h, k, s) for k in self.slacks for h in self.limits for s in self.lengths for c in ("cusum_alarm_count", "cusum_alarm_density", "cusum_time_in_alarm")]
        made += [(c, w) for w in self.weights for c in names.EWMA[:3]] + [("ewma_alarm_count", w, x) for w in self.weights for x in self.shewhart_limits]
        made += [("shewhart_max_abs_z",), *[(c, x) for x in self.shewhart_limits for c in names.SHEWHART[:2]]]
        return made + [(c,) for c in (*names.MOVING_RANGE, *names.RUNS)]

    def places(self, features: Sequence[str]) -> list[tuple[int, ...]]:
        """For each setting the columns of the features under it."""
        at = {c: i for i, c in enumerate(self.columns)}
        return [tuple(at[c, *[v for name, v in zip("hkwsx", setting) if name in self._changed_by(c)]] for c in features) for setting in self.settings]

    @staticmethod
    def _changed_by(feature: str) -> str:
        """The settings that change a feature: limit h, slack k, weight w, length s and Shewhart limit x."""
        if feature in names.CUSUM:
            return "k" if feature in names.CUSUM[:5] else "hks"
        if feature in names.EWMA:
            return "w" if feature in names.EWMA[:3] else "wx"
        return "x" if feature in names.SHEWHART[:2] else ""


def grid_medians(clocked: DataFrame, counts: Sequence[int], seconds: Sequence[float], grid: Grid) -> DataFrame:
    """(record_id, window_type, window_size, m0, m1, ...): the medians of ``grid.columns`` over a record's windows of at least 6 intervals."""
    scales = _scales(counts, seconds, None, "", 2)
    own = [f"m{i}" for i in range(len(grid.columns))]
    kind = clocked.schema["record_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_records(batches):
            held = _Records(table)
            for scale in scales:
                made = [(w.record, _grid(w, grid)) for w in held.windows(scale, LEAST_CHARTED)]
                if made:
                    record, middle = _medians_by_record(np.concatenate([r for r, _ in made]), np.concatenate([v for _, v in made], 1))
                    keys = [held.ids.take(pa.array(record)), pa.array([scale.kind] * len(record)), pa.array(np.full(len(record), scale.size))]
                    yield pa.RecordBatch.from_arrays([*keys, *[pa.array(v, from_pandas=True) for v in middle]], names=[*KEYS[:3], *own])

    rows = clocked.select(*_KEPT).sortWithinPartitions("record_id", "idx")
    return rows.mapInArrow(run, f"record_id {kind}, window_type string, window_size double, " + ", ".join(f"{c} double" for c in own))


@dataclass(frozen=True)
class Scale:
    kind: str
    size: float
    least: int = 1


def _scales(counts: Sequence[int], seconds: Sequence[float], full: float | None, task: str, least: int) -> list[Scale]:
    for s in seconds:
        windows.guard(s, task)
    return [*[Scale("rr_count", float(n)) for n in counts], *[Scale("time", float(s), least) for s in seconds], *([Scale("full_record", float(full))] if full is not None else [])]


def _whole_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables of about ROWS that end where a record ends."""
    kept, size = [], 0
    for batch in batches:
        kept.append(batch)
        size += batch.num_rows
        if size >= ROWS:
            table = pa.Table.from_batches(kept)
            last = int(np.flatnonzero(table.column("idx").to_numpy() == 0)[-1])
            if last:
                yield table.slice(0, last)
            kept, size = table.slice(last).to_batches(), table.num_rows - last
    if size:
        yield pa.Table.from_batches(kept)


@dataclass
class _Windows:
    """Windows by falling length: their record's number, index, first interval, number of intervals and, as columns, what these hold; NaN behind a window's end."""

    scale: Scale
    held: _Records
    record: np.ndarray
    index: np.ndarray
    first: np.ndarray
    n: np.ndarray

    def __post_init__(self):
        step = np.arange(self.n[0])[:, None]
        at = self.first + step
        if self.n[-1] == self.n[0]:
            self.x, self.z = self.held.x[at], self.held.z[at]
        else:
            at = np.minimum(at, len(self.held.x) - 1)
            self.x, self.z = (np.where(step < self.n, v[at], np.nan) for v in (self.held.x, self.held.z))
        opened = self.held.t[self.first] - self.held.x[self.first] / 1000.0
        self.open = opened if self.scale.kind == "time" else np.where(self.index == 0, 0.0, opened)

    def clock(self, place: np.ndarray) -> np.ndarray:
        """The window's own clock at a place of each window."""
        return self.held.t[self.first + place] - self.open

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        size = self.scale.size
        if self.scale.kind == "time":
            return self.index * size, np.minimum((self.index + 1) * size, self.held.t[self.held.ends[self.record] - 1])
        return np.zeros(len(self.n)) if self.scale.kind == "full_record" else self.open, self.held.t[self.first + self.n - 1]


class _Records:
    """Whole records in order."""

    def __init__(self, table: pa.Table):
        self.starts = np.flatnonzero(table.column("idx").to_numpy() == 0)
        self.ends = np.append(self.starts[1:], table.num_rows)
        self.ids = table.column("record_id").combine_chunks().take(pa.array(self.starts))
        self.x, self.t, self.z = (table.column(c).to_numpy() for c in ("rr_ms", "t", "z"))

    def windows(self, scale: Scale, least: int = 1) -> Iterator[_Windows]:
        """Windows of a scale of at least ``least`` intervals, those of similar length together."""
        record, index, first, n = self._spans(scale)
        for own in _alike(n):
            own = own[n[own] >= least]
            if len(own):
                yield _Windows(scale, self, record[own], index[own], first[own], n[own])

    def _spans(self, scale: Scale) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = self.ends - self.starts
        number = np.arange(len(sizes))
        if scale.kind == "full_record":
            return number, np.zeros(len(sizes), np.int64), self.starts, sizes
        if scale.kind == "rr_count":
            n = int(scale.size)
            each = sizes // n
            record = np.repeat(number, each)
            index = np.arange(len(record)) - np.repeat(np.cumsum(each) - each, each)
            return record, index, self.starts[record] + index * n, np.full(len(record), n)
        index = np.floor(self.t / scale.size).astype(np.int64)
        edge = np.append(True, index[1:] != index[:-1])
        edge[self.starts] = True
        first = np.flatnonzero(edge)
        n = np.diff(np.append(first, len(index)))
        record = np.searchsorted(self.starts, first, side="right") - 1
        own = (index[first] * scale.size < self.t[self.ends[record] - 1]) & (n >= scale.least)
        return record[own], index[first][own], first[own], n[own]


def _alike(n: np.ndarray) -> Iterator[np.ndarray]:
    """Places in order of falling n, those together whose n is more than half of the largest."""
    order = np.argsort(-n, kind="stable")
    falling = -n[order]
    low = 0
    while low < len(order):
        high = int(np.searchsorted(falling, -(-falling[low] // 2)))
        yield order[low:high]
        low = high


def _at(v: np.ndarray, place: np.ndarray) -> np.ndarray:
    return v[np.maximum(place, 0), np.arange(v.shape[1])]


def _sum(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the first n rows, one after another."""
    return _at(np.cumsum(v, 0), n - 1)


def _median(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    order = np.sort(np.ascontiguousarray(v.T), axis=1)
    row = np.arange(len(order))
    return 0.5 * order[row, np.maximum((n - 1) // 2, 0)] + 0.5 * order[row, np.minimum(n // 2, order.shape[1] - 1)]


def _deviation(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sample deviations of the first n rows; n falls."""
    mean, squares = np.zeros(v.shape[1]), np.zeros(v.shape[1])
    for i, k in enumerate(_lasting(n, len(v))):
        far = v[i, :k] - mean[:k]
        step = far / (i + 1)
        mean[:k] += step
        squares[:k] += far * (far - step)
    return np.sqrt(squares / (n - 1))


def _lasting(n: np.ndarray, rows: int) -> list[int]:
    """For each row the number of columns that reach it; n falls."""
    return np.searchsorted(-n, -np.arange(rows), side="left").tolist()


def _run_lengths(flags: np.ndarray) -> np.ndarray:
    """The length so far of the stretch of true values that a row lies in, 0 outside."""
    at = np.arange(1, len(flags) + 1, dtype=np.int32)[:, None]
    return at - np.maximum.accumulate(np.where(flags, np.int32(0), at), 0)


def _longest(flags: np.ndarray) -> np.ndarray:
    return _run_lengths(flags).max(0, initial=0)


def _shifted(flags: np.ndarray, by: int) -> np.ndarray:
    """The flags ``by`` rows later, or earlier if it is negative."""
    out = np.zeros_like(flags)
    if by >= 0:
        out[: len(flags) - by] = flags[by:]
    else:
        out[-by:] = flags[:by]
    return out


def _first(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether any row is true, and the first that is."""
    return flags.any(0), flags.argmax(0)


def _alarms(flags: np.ndarray, w: _Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, place (-1 if none) and time of the first of the true rows."""
    some, place = _first(flags)
    return flags.sum(0), np.where(some, place, -1), np.where(some, w.clock(np.where(some, place, 0)), np.nan)


def cusum_sums(z: np.ndarray, k: float) -> tuple[np.ndarray, np.ndarray]:
    """Both cumulative sums at every row."""
    totals = [np.cumsum(v, 0) for v in (z - k, -z - k)]
    high, low = (v - np.minimum(np.minimum.accumulate(v, 0), 0.0) for v in totals)
    return high, low


def sustained(flags: np.ndarray, least: int) -> np.ndarray:
    """Whether a row lies in a stretch of at least ``least`` rows."""
    return _dilated(_run_lengths(flags) >= least, least)


def _dilated(hit: np.ndarray, least: int) -> np.ndarray:
    """The rows, and the ``least`` - 1 before each of them."""
    out = hit.copy()
    for j in range(1, min(least, len(hit))):
        out[:-j] |= hit[j:]
    return out


def ewma(z: np.ndarray, n: np.ndarray, weight: float) -> np.ndarray:
    """The weighted mean at every row; n falls."""
    out, mean = np.full(z.shape, np.nan), np.zeros(z.shape[1])
    for i, k in enumerate(_lasting(n, len(z))):
        mean = weight * z[i, :k] + (1 - weight) * mean[:k]
        out[i, :k] = mean
    return out


def ewma_slope(e: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The slope of the mean over the second half of each window."""
    half = np.where(n < 4, 0, n // 2)
    place = np.arange(len(e))[:, None] - half
    tail = place >= 0
    m, x = (n - half).astype(float), np.where(tail, place, 0).astype(float)
    y = np.where(tail, e, 0.0)
    sx, sy, sxy, sxx = (_sum(v, n) for v in (x, y, x * y, x * x))
    spread = m * sxx - sx * sx
    return np.where(spread > 0, (m * sxy - sx * sy) / spread, np.nan)


def moving_ranges(x: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    steps = np.abs(x[1:] - x[:-1])
    mean, middle = _sum(steps, n - 1) / (n - 1), _median(steps, n - 1)
    return {"mr_mean": mean, "mr_median": middle, "mr_max": np.fmax.reduce(steps), "mr_mad": _median(np.abs(steps - middle), n - 1), "mr_out_count": (steps > charts.MOVING_RANGE_FACTOR * mean).sum(0)}


def run_rules(z: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    middle, turn = _median(z, n), z[1:] - z[:-1]
    above, below = _longest(z > middle), _longest(z < middle)
    up, down = (np.where(v > 0, v + 1, 0) for v in (_longest(turn > 0), _longest(turn < 0)))
    some = []
    for span, beyond, need in ((3, 2.0, 2), (5, 1.0, 4)):
        sides = [np.cumsum(np.concatenate([np.zeros((1, z.shape[1]), np.int32), flags]), 0, dtype=np.int32) for flags in (z > beyond, z < -beyond)]
        some.append(np.any([(c[span:] - c[:-span] >= need).any(0) for c in sides], 0))
    rules = (np.maximum(above, below) >= 8).astype(int) + (np.maximum(up, down) >= 6) + some[0] + some[1]
    return {"longest_run_above_median": above, "longest_run_below_median": below, "trend_run_up_max": up, "trend_run_down_max": down, "n_runs_rule_violations": rules}


def _variability(x: np.ndarray, n: np.ndarray, ranges: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    steps = x[1:] - x[:-1]
    mean, middle, dev, step_dev = _sum(x, n) / n, _median(x, n), _deviation(x, n), _deviation(steps, n - 1)
    root = np.sqrt(_sum(steps * steps, n - 1) / (n - 1))
    sd1 = root / np.sqrt(2.0)
    sd2 = np.sqrt(np.maximum(0.0, 2 * dev * dev - sd1 * sd1))
    return {
        "mean_rr": mean, "median_rr": middle, "std_rr": dev, "mad_rr": _median(np.abs(x - middle), n), "rmssd": root, "sdsd": step_dev, "cv_rr": np.where(mean > 0, dev / mean, np.nan),
        "rr_diff_mean": ranges["mr_mean"], "rr_diff_std": step_dev, "sd1": sd1, "sd2": sd2, "sd1_sd2_ratio": np.where(sd2 > 0, sd1 / sd2, np.nan),
    }


def _charts(w: _Windows, chart: charts.Chart) -> dict[str, np.ndarray]:
    z, n, last = w.z, w.n, w.n - 1
    far = np.abs(z)
    out, out_pos, out_time = _alarms(far > chart.limit, w)
    high, low = cusum_sums(z, chart.k)
    alarms, alarm_pos, alarm_time = _alarms(sustained(high > chart.h, chart.sustained) | sustained(low > chart.h, chart.sustained), w)
    top_high, top_low = np.fmax.reduce(high), np.fmax.reduce(low)
    e = ewma(z, n, chart.weight)
    size = np.abs(e)
    beyond, _, beyond_time = _alarms(size > chart.ewma_limit * (chart.weight / (2.0 - chart.weight)) ** 0.5, w)
    return {
        "shewhart_out_count": out, "shewhart_out_rate": out / n, "shewhart_max_abs_z": np.fmax.reduce(far), "shewhart_first_alarm_pos": out_pos, "shewhart_first_alarm_time_sec": out_time,
        "cusum_pos_max": top_high, "cusum_neg_max": top_low, "cusum_abs_max": np.maximum(top_high, top_low), "cusum_last_pos": _at(high, last), "cusum_last_neg": _at(low, last), "cusum_alarm_count": alarms,
        "cusum_first_alarm_pos": alarm_pos, "cusum_first_alarm_time_sec": alarm_time, "cusum_time_in_alarm": alarms / n * w.clock(last), "cusum_alarm_density": alarms / n,
        "ewma_last": _at(e, last), "ewma_max_abs": np.fmax.reduce(size), "ewma_slope": ewma_slope(e, n), "ewma_alarm_count": beyond, "ewma_first_alarm_time_sec": beyond_time,
    }


def _ectopy(x: np.ndarray, n: np.ndarray, middle: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of short and long intervals and of the patterns SL, (SN){2,}, (SNN){2,} and S{3,}: each by the place where it begins."""
    short, long = x < charts.SHORT * middle, x > charts.LONG * middle
    plain = (x >= charts.SHORT * middle) & (x <= charts.LONG * middle)

    def repeated(start: np.ndarray, step: int) -> np.ndarray:
        return (start & ~_shifted(start, -step) & _shifted(start, step)).sum(0)

    both = (short | long).sum(0)
    pair = short & _shifted(plain, 1)
    pauses = (short & _shifted(long, 1)).sum(0)
    return {
        "ectopy_like_count": both, "ectopy_like_density": both / n, "short_long_sequence_count": pauses, "compensatory_pause_like_count": pauses,
        "bigeminy_like_pattern_count": repeated(pair, 2), "trigeminy_like_pattern_count": repeated(pair & _shifted(plain, 2), 3),
        "atrial_tachy_like_run_count": (short & ~_shifted(short, -1) & _shifted(short, 1) & _shifted(short, 2)).sum(0),
    }


def _all(w: _Windows, chart: charts.Chart) -> dict[str, np.ndarray]:
    """All features of windows; NaN where a window has too few intervals for one."""
    n = w.n
    if n[0] < 3:
        return {c: np.full(len(n), np.nan) for c in names.ALL}
    with np.errstate(all="ignore"):
        ranges = moving_ranges(w.x, n)
        found = _variability(w.x, n, ranges)
        middle = found["median_rr"]
        of: list[tuple[Callable[[], dict[str, np.ndarray]], np.ndarray]] = [
            (lambda: {c: found[c] for c in names.HRV}, n >= 4), (lambda: {c: found[c] for c in names.POINCARE}, n >= 3), (lambda: _charts(w, chart) | ranges | run_rules(w.z, n), n >= LEAST_CHARTED),
            (lambda: _ectopy(w.x, n, middle), (n >= 5) & (middle > 0)),
        ]
        return {c: np.where(enough, v, np.nan) for part, enough in of for c, v in part().items()}


def _grid(w: _Windows, grid: Grid) -> np.ndarray:
    """A row of windows' values for each of ``grid.columns``."""
    z, n, last = w.z, w.n, w.n - 1
    end = w.clock(last)
    found: dict[tuple, np.ndarray] = {}
    with np.errstate(all="ignore"):
        for k in grid.slacks:
            high, low = cusum_sums(z, k)
            top_high, top_low = np.fmax.reduce(high), np.fmax.reduce(low)
            found |= {(c, k): v for c, v in zip(names.CUSUM[:5], (top_high, top_low, np.maximum(top_high, top_low), _at(high, last), _at(low, last)))}
            for h in grid.limits:
                runs = [_run_lengths(high > h), _run_lengths(low > h)]
                for s in grid.lengths:
                    count = (_dilated(runs[0] >= s, s) | _dilated(runs[1] >= s, s)).sum(0)
                    found |= {(c, h, k, s): v for c, v in zip(("cusum_alarm_count", "cusum_alarm_density", "cusum_time_in_alarm"), (count, count / n, count / n * end))}
        for weight in grid.weights:
            e = ewma(z, n, weight)
            size = np.abs(e)
            found |= {(c, weight): v for c, v in zip(names.EWMA[:3], (_at(e, last), np.fmax.reduce(size), ewma_slope(e, n)))}
            for x, limit in zip(grid.shewhart_limits, grid.ewma_limits):
                found["ewma_alarm_count", weight, x] = (size > limit * (weight / (2.0 - weight)) ** 0.5).sum(0)
        far = np.abs(z)
        found[("shewhart_max_abs_z",)] = np.fmax.reduce(far)
        for x in grid.shewhart_limits:
            out = (far > x).sum(0)
            found |= {("shewhart_out_count", x): out, ("shewhart_out_rate", x): out / n}
        found |= {(c,): v for c, v in (moving_ranges(w.x, n) | run_rules(z, n)).items()}
    return np.stack([found[c].astype(float) for c in grid.columns])


def _medians_by_record(record: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The records that have windows, and for each row of ``values`` their medians over these; NaN is left out."""
    order = np.argsort(record, kind="stable")
    numbers, starts, n = np.unique(record[order], return_index=True, return_counts=True)
    values = values[:, order]
    out = np.full((len(values), len(numbers)), np.nan)
    for own in _alike(n):
        step = np.arange(n[own[0]])
        at = np.minimum(starts[own, None] + step, values.shape[1] - 1)
        each = np.sort(np.where(step < n[own, None], values[:, at], np.nan), axis=2)
        seen = (~np.isnan(each)).sum(2, keepdims=True)
        low, high = (np.take_along_axis(each, np.clip(i, 0, each.shape[2] - 1), 2)[..., 0] for i in ((seen - 1) // 2, seen // 2))
        out[:, own] = 0.5 * low + 0.5 * high
    return numbers, out
