"""Steps that are fitted on one table and applied to others, as stages of a Spark ML pipeline that can be saved and loaded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import features
from . import stats
from .selection import exact_percentiles

#: A deviation of at most this share of the mean's size is rounding of equal values, and counts as 0.
ROUNDING = 1e-12


def _finite(name: str) -> Column:
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def _set_given(stage: Params, **given) -> None:
    """Sets what was given; a stage being loaded is made without arguments."""
    stage._set(**{k: v for k, v in given.items() if v is not None})


class MedianScaler(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Fills missing values by medians and standardizes by means and population deviations of the filled columns.

    Of ``inputCols`` those that the fitted table has take part, so that a stage before it may drop some. Nulls, NaN and
    infinities are missing. Medians are exact in tables of any size. A column without values is filled by 0; a
    deviation of 0 counts as 1; an empty table gives a model that only fills by 0.
    """

    def __init__(self, inputCols: Sequence[str] | None = None):
        super().__init__()
        _set_given(self, inputCols=inputCols and list(inputCols))

    def _fit(self, rows: DataFrame) -> MedianScalerModel:
        names, _ = features.resolve(self.getInputCols(), rows.columns)
        if not names:
            return MedianScalerModel([], [], [], [])
        order = F.array(*[F.lit(c) for c in names])
        long = rows.select(F.posexplode(F.array(*[_finite(c) for c in names])).alias("_i", "_x")).select(F.element_at(order, F.col("_i") + 1).alias("feature"), "_x")
        # one row for each column
        found = {r["feature"]: r["value"] for r in exact_percentiles(long, ["feature"], F.col("_x"), [0.5]).collect()}
        medians = [float(found.get(c, 0.0)) for c in names]
        filled = [F.coalesce(_finite(c), F.lit(m)) for c, m in zip(names, medians)]
        figures = rows.agg(*[f(x).alias(f"{k}{i}") for i, x in enumerate(filled) for k, f in (("a", F.avg), ("s", F.stddev_pop))]).head()
        means = [float(figures[f"a{i}"] or 0.0) for i in range(len(names))]
        spread = [float(figures[f"s{i}"] or 0.0) for i in range(len(names))]
        return MedianScalerModel(names, medians, means, [s if s > ROUNDING * abs(m) else 1.0 for s, m in zip(spread, means)])


class MedianScalerModel(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted medians, means and deviations; replaces the columns by their scaled values and keeps the others."""

    medians = Param(Params._dummy(), "medians", "what fills missing values", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "means of the filled columns", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "what the columns are divided by", TypeConverters.toListFloat)

    def __init__(self, inputCols=None, medians=None, means=None, deviations=None):
        super().__init__()
        _set_given(self, inputCols=inputCols, medians=medians, means=means, deviations=deviations)

    def _transform(self, rows: DataFrame) -> DataFrame:
        figures = zip(self.getInputCols(), *[self.getOrDefault(p) for p in (self.medians, self.means, self.deviations)])
        return rows.withColumns({c: (F.coalesce(_finite(c), F.lit(m)) - a) / s for c, m, a, s in figures})


class FeaturePruner(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Keeps one feature of each group that strong rank correlations connect: the first in ``priority``.

    Features not listed come last, in their own order. A pair is strong where its absolute Spearman correlation over
    the rows that have both, rounded to 4 decimals, is at least ``threshold``; constant features correlate with none.
    ``keyCol`` tells rows apart.
    """

    threshold = Param(Params._dummy(), "threshold", "least absolute correlation of a strong pair", TypeConverters.toFloat)
    priority = Param(Params._dummy(), "priority", "features in the order in which they are kept", TypeConverters.toListString)
    keyCol = Param(Params._dummy(), "keyCol", "column that tells rows apart", TypeConverters.toString)

    def __init__(self, inputCols: Sequence[str] | None = None, threshold: float | None = None, priority: Sequence[str] | None = None, keyCol: str | None = None):
        super().__init__()
        self._setDefault(threshold=0.9, priority=features.PRIORITY, keyCol="record_id")
        _set_given(self, inputCols=inputCols and list(inputCols), threshold=threshold, priority=priority and list(priority), keyCol=keyCol)

    def _fit(self, rows: DataFrame) -> FeaturePrunerModel:
        names, _ = features.resolve(self.getInputCols(), rows.columns)
        found = stats.CorrelationPruner(names, self.getOrDefault(self.threshold), self.getOrDefault(self.priority))
        key = self.getOrDefault(self.keyCol)
        clean = rows.select(key, *[_finite(c).alias(c) for c in names])
        rho = stats.spearman(clean, found.names, key).where(F.abs(F.round("rho", 4)) >= found.threshold)
        found.fit_pairs([(r["a"], r["b"]) for r in rho.select("a", "b").collect()])
        first = {c: g[0] for g in found.groups for c in g}
        return FeaturePrunerModel(names, [first[c] for c in names])


class FeaturePrunerModel(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """For each feature the one that stands for its group; drops those that another stands for."""

    standing = Param(Params._dummy(), "standing", "for each input column the feature kept of its group", TypeConverters.toListString)

    def __init__(self, inputCols=None, standing=None):
        super().__init__()
        _set_given(self, inputCols=inputCols, standing=standing)

    @property
    def kept(self) -> list[str]:
        return [c for c, g in zip(self.getInputCols(), self.getOrDefault(self.standing)) if c == g]

    @property
    def n_selected(self) -> int:
        return len(self.kept)

    @property
    def n_dropped(self) -> int:
        return len(self.getInputCols()) - len(self.kept)

    def _transform(self, rows: DataFrame) -> DataFrame:
        kept = set(self.kept)
        return rows.drop(*[c for c in self.getInputCols() if c not in kept])
