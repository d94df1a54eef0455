"""Distances from many reference classes at once: one shrunk covariance for each key, from sums over all rows.

Medians, means and second moments of all keys are aggregates; only a key's p by p numbers are inverted, in a row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mahalanobis import LEAST_ROWS, PERCENTILE
from .scan import attach, written
from .selection import exact_percentiles


def _cells(names: Sequence[str]) -> Column:
    """The named columns as an array; null where they are missing, NaN or infinite."""
    cell = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    return F.array(*[cell(F.col(c).cast("double")) for c in names])


def _shrunk(p: int):
    """Shrinkage towards a multiple of the identity, and the inverse, of each row's moments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            precision, share = [], []
            for upper, fourth, n in zip(*(batch.column(k).to_pylist() for k in ("_upper", "_fourth", "n"))):
                s = np.zeros((p, p))
                s[np.triu_indices(p)] = upper
                s = s + np.triu(s, 1).T
                m = np.trace(s) / p
                d2 = ((s - m * np.eye(p)) ** 2).sum() / p
                b2 = min(d2, (fourth - (s**2).sum()) / (p * n))
                a = b2 / d2 if d2 > 0 else 0.0
                shrunk = (1 - a) * s + a * m * np.eye(p)
                try:
                    inverse = np.linalg.inv(shrunk)
                except np.linalg.LinAlgError:
                    inverse = np.linalg.pinv(shrunk)
                precision.append(inverse.ravel().tolist())
                share.append(float(a))
            kept = batch.drop_columns(["_upper", "_fourth"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(precision, pa.list_(pa.float64())), pa.array(share, pa.float64())], names=[*kept.schema.names, "precision", "shrinkage"])

    return run


def lacking(rows: DataFrame, names: Sequence[str]) -> list[str]:
    """Those of the named columns that are missing somewhere."""
    found = rows.select(_cells(names).alias("_x")).agg(*[F.coalesce(F.bool_or(F.col("_x")[j].isNull()), F.lit(False)).alias(c) for j, c in enumerate(names)]).head()
    return [c for c in names if found[c]]


def fit_keys(reference: DataFrame, names: Sequence[str], keys: Sequence[str], least: int = LEAST_ROWS, filled: Sequence[str] | None = None) -> DataFrame:
    """(keys, n, medians, mean, precision, shrinkage) of the reference rows of every key that has ``least`` of them.

    Missing values take the key's medians, 0 where it has none. Where keys are few and large, ``filled`` names the
    columns that are missing in any row to be measured: the medians of these are exact at any size, those of the
    others, which nothing takes, are 0.
    """
    p, keys = len(names), list(keys)
    base = written(reference.select(*keys, _cells(names).alias("_x")), "distances")
    if filled is None:
        middle = F.array(*[F.coalesce(F.median(F.col("_x")[j]), F.lit(0.0)) for j in range(p)])
        facts = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), middle.alias("medians"))
    else:
        facts = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("medians", F.array_repeat(F.lit(0.0), p))
        if missing := [j for j, c in enumerate(names) if c in filled]:
            values = base.select(*keys, F.inline(F.array(*[F.struct(F.lit(j).alias("_j"), F.col("_x")[j].alias("_v")) for j in missing])))
            found = exact_percentiles(values, [*keys, "_j"], F.col("_v"), [0.5]).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_j", "value"))).alias("_m"))
            medians = F.array(*[F.coalesce(F.try_element_at("_m", F.lit(j)), F.lit(0.0)) for j in range(p)])
            facts = attach(facts, found, keys, "left").withColumn("medians", medians).drop("_m")
    facts = written(facts.where(F.col("n") >= least), "distances")
    filled = attach(base, facts.select(*keys, "medians"), keys).select(*keys, F.zip_with("_x", "medians", lambda v, m: F.coalesce(v, m)).alias("_x"))
    mean = written(filled.groupBy(*keys).agg(F.array(*[F.avg(F.col("_x")[j]) for j in range(p)]).alias("mean")), "distances")
    away = attach(filled, mean, keys).select(*keys, F.zip_with("_x", "mean", lambda v, m: v - m).alias("_c"))
    c = [F.col("_c")[j] for j in range(p)]
    norm = sum((v * v for v in c[1:]), c[0] * c[0])
    upper = F.array(*[F.avg(c[i] * c[j]) for i in range(p) for j in range(i, p)])
    moments = away.groupBy(*keys).agg(upper.alias("_upper"), F.avg(norm * norm).alias("_fourth"))
    whole = attach(attach(facts, mean, keys), moments, keys)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.schema.fields if f.name not in ("_upper", "_fourth"))
    return written(whole.mapInArrow(_shrunk(p), f"{types}, precision array<double>, shrinkage double"), "distances")


def with_keyed_distance(rows: DataFrame, fits: DataFrame, names: Sequence[str], keys: Sequence[str], out: str = "dm") -> DataFrame:
    """Rows of the keys that have a fit, with the distance from it; a plain expression of the JVM."""
    p = len(names)
    joined = attach(rows, fits.select(*keys, "medians", "mean", "precision"), keys)
    away = F.zip_with(F.zip_with(_cells(names), "medians", lambda v, m: F.coalesce(v, m)), "mean", lambda v, m: v - m)
    joined = joined.withColumn("_c", away)
    c, w = [F.col("_c")[j] for j in range(p)], F.col("precision")
    form = sum((c[i] * c[j] * w[i * p + j] for i in range(p) for j in range(p)), F.lit(0.0))
    return joined.withColumn(out, F.sqrt(F.greatest(form, F.lit(0.0)))).drop("medians", "mean", "precision", "_c")


def with_thresholds(distances: DataFrame, reference: Column, keys: Sequence[str], percentile: float = PERCENTILE, dm: str = "dm") -> DataFrame:
    """Adds ``threshold``, the percentile of each key's reference distances, infinite where it has none; exact at any size."""
    found = exact_percentiles(distances.where(reference), keys, F.col(dm), [percentile / 100.0]).select(*keys, F.col("value").alias("threshold"))
    return attach(distances, found, keys, "left").withColumn("threshold", F.coalesce("threshold", F.lit(float("inf"))))
