"""Distances from a reference class under a shrunk covariance, and their figures by record."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Feature sets for distances.
FEATURE_SETS = {
    "hrv_reduced": ["rmssd", "mad_rr", "sd1", "sd2", "sd1_sd2_ratio"],
    "spc_reduced": ["cusum_abs_max", "ewma_slope", "shewhart_out_rate", "mr_mad", "longest_run_above_median"],
    "hrv_spc_reduced": ["rmssd", "mad_rr", "sd1", "cusum_abs_max", "ewma_slope", "mr_mad"],
}
LEAST_ROWS = 5
PERCENTILE = 95.0


@dataclass(frozen=True)
class Reference:
    """Column medians for missing values, mean, precision, shrinkage and rows of the reference class."""

    medians: np.ndarray
    mean: np.ndarray
    precision: np.ndarray
    shrinkage: float
    rows: int

    def distances(self, x: np.ndarray) -> np.ndarray:
        c = np.where(np.isfinite(x), x, self.medians) - self.mean
        return np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", c, self.precision, c), 0.0))


def as_vector(names: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in names])


def _matrix(column: pa.Array, p: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, p)


def _summed(rows: DataFrame, p: int, per_batch, size: int) -> np.ndarray:
    """Sum over all rows of a vector of ``size`` numbers made from each batch; one such vector leaves each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += per_batch(_matrix(b.column("x"), p))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["i", "v"])

    out = np.zeros(size)
    for r in rows.select("x").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def fit_reference(reference: DataFrame, x: Column, p: int) -> Reference:
    """Ledoit-Wolf shrinkage towards a multiple of the identity, from sums over the reference rows.

    Missing values take the reference's column medians. At least LEAST_ROWS rows are needed. The driver sees p by p
    sums only; where the shrunk matrix cannot be inverted its pseudo-inverse serves.
    """
    raw = reference.select(x.alias("x"))
    clean = [F.when(~F.isnan(F.col("x")[j]) & (F.abs(F.col("x")[j]) != float("inf")), F.col("x")[j]) for j in range(p)]
    facts = raw.agg(F.count(F.lit(1)).alias("n"), *[F.median(c).alias(f"m{j}") for j, c in enumerate(clean)]).head()
    n = facts["n"]
    if n < LEAST_ROWS:
        raise ValueError(f"{n} reference rows; {LEAST_ROWS} are needed")
    medians = np.array([np.nan if facts[f"m{j}"] is None else facts[f"m{j}"] for j in range(p)])
    medians = np.where(np.isfinite(medians), medians, 0.0)
    filled = raw.select(F.array(*[F.coalesce(c, F.lit(float(m))) for c, m in zip(clean, medians)]).alias("x"))
    mean = _summed(filled, p, lambda a: a.sum(0), p) / n

    def second(a: np.ndarray) -> np.ndarray:
        c = a - mean
        return np.append((c.T @ c).ravel(), ((c * c).sum(1) ** 2).sum())

    sums = _summed(filled, p, second, p * p + 1)
    s = sums[:-1].reshape(p, p) / n
    m = np.trace(s) / p
    d2 = ((s - m * np.eye(p)) ** 2).sum() / p
    b2 = min(d2, (sums[-1] / n - (s**2).sum()) / (p * n))
    share = b2 / d2 if d2 > 0 else 0.0
    shrunk = (1 - share) * s + share * m * np.eye(p)
    try:
        precision = np.linalg.inv(shrunk)
    except np.linalg.LinAlgError:
        precision = np.linalg.pinv(shrunk)
    return Reference(medians, mean, precision, float(share), int(n))


def with_distance(df: DataFrame, x: Column, fit: Reference, out: str = "dm") -> DataFrame:
    """All columns and the distance of each row, in Arrow batches."""
    p = len(fit.mean)
    rows = df.select(F.struct(*df.columns).alias("_row"), F.transform(x, lambda v: F.coalesce(v.cast("double"), F.lit(float("nan")))).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = fit.distances(_matrix(b.column("x"), p)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(d)], names=["_row", out])

    return rows.mapInArrow(run, f"_row {rows.schema['_row'].dataType.simpleString()}, {out} double").select("_row.*", out)


def alarm_threshold(distances: DataFrame, percentile: float = PERCENTILE, dm: str = "dm") -> float:
    """Percentile of the reference's distances, infinite without any."""
    found = distances.agg(F.percentile(dm, percentile / 100.0).alias("t")).head()["t"]
    return float("inf") if found is None else float(found)


def distances_by_record(df: DataFrame, threshold: float | Column, span_s: float, keys: list[str], dm: str = "dm", start: str = "start_time_sec", label: str = "y") -> DataFrame:
    """Eleven figures of a record's distances in time order; ``threshold`` may be a column.

    Missing distances count as rows but not in statistics. The slope is over the last half's values, renumbered; the
    last value falls back to the last one there is; time in alarm is the share in alarm times the latest start.
    """
    w = Window.partitionBy(*keys)
    d = F.col(dm)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(start)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    tail = F.when((F.col("_i") >= F.col("_n") - F.greatest(F.floor(F.col("_n") / 2), F.lit(1))) & d.isNotNull(), d)
    rows = rows.withColumn("_tail", tail)
    rows = rows.withColumn("_k", F.when(F.col("_tail").isNotNull(), F.sum(F.col("_tail").isNotNull().cast("int")).over(w.orderBy("_i"))))
    alarm = d > threshold
    share = F.count_if(alarm) / F.count(F.lit(1))
    out = rows.groupBy(*keys).agg(
        F.avg(d).alias("mahalanobis_mean"), F.median(d).alias("mahalanobis_median"), F.max(d).alias("mahalanobis_max"), F.percentile(d, 0.9).alias("mahalanobis_p90"),
        F.max_by(d, F.when(d.isNotNull(), F.col("_i"))).alias("mahalanobis_last"), F.regr_slope(F.col("_tail"), F.col("_k").cast("double")).alias("mahalanobis_slope"),
        F.count_if(alarm).cast("double").alias("mahalanobis_alarm_count"), share.alias("mahalanobis_alarm_density"), (share * F.max(start)).alias("mahalanobis_time_in_alarm"),
        F.min_by(start, F.when(alarm, F.col("_i"))).alias("mahalanobis_first_alarm_time_sec"), F.max(label).alias("_y"),
    )
    lead = F.when((F.col("_y") == 1) & F.col("mahalanobis_first_alarm_time_sec").isNotNull(), F.greatest(F.lit(0.0), span_s - F.col("mahalanobis_first_alarm_time_sec")))
    return out.withColumn("mahalanobis_lead_time_sec", lead).drop("_y")


def population_folds(windows: DataFrame, names: list[str], folds: DataFrame, span_s: float, percentile: float = PERCENTILE) -> DataFrame:
    """For each fold: reference and threshold from training windows with y = 0, figures of all validation records; all folds together."""
    from .keyed_distance import fit_keys, with_keyed_distance, with_thresholds
    from .scan import written

    held = folds.select(F.col("fold").alias("_held")).distinct()
    rows = written(windows.join(folds, "pair_id").join(F.broadcast(held)), "distances")
    reference = (F.col("fold") != F.col("_held")) & (F.col("y") == 0)
    far = with_keyed_distance(rows, fit_keys(rows.where(reference), names, ["_held"]), names, ["_held"])
    judged = with_thresholds(written(far, "distances"), reference, ["_held"], percentile).where(F.col("fold") == F.col("_held"))
    return distances_by_record(judged, F.col("threshold"), span_s, ["record_id", "y", "fold"])


def pair_baselines(windows: DataFrame, names: list[str], percentile: float = PERCENTILE) -> DataFrame:
    """Reference from each pair's own y = 0 windows, at each scale.

    A pair and scale with too few reference windows is left out alone. (pair_id, window_type, window_size, record_id,
    y, start_time_sec, dm, threshold).
    """
    from .keyed_distance import fit_keys, with_keyed_distance, with_thresholds
    from .scan import written

    keys = ["pair_id", "window_type", "window_size"]
    rows = written(windows.select(*keys, "record_id", "y", "start_time_sec", *names), "distances")
    far = written(with_keyed_distance(rows, fit_keys(rows.where("y = 0"), names, keys), names, keys).drop(*names), "distances")
    return with_thresholds(far, F.col("y") == 0, keys, percentile)
