"""Median imputation, population scaling, and grouped cross-validation of classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def impute_and_scale(rows: DataFrame, names: list[str], by: str = "fold") -> DataFrame:
    """For every value v of ``by``: all rows, standardized with medians, means and population deviations of the others.

    Adds ``model`` (v), ``train`` and the vector ``x``; missing values take the training median, a deviation of 0
    counts as 1. Each row is repeated once per fold, a fixed number, so all folds are fitted together.
    """
    models = rows.select(F.col(by).alias("model")).distinct()
    spread = rows.crossJoin(F.broadcast(models)).withColumn("train", F.col(by) != F.col("model"))
    middle = [F.coalesce(F.median(F.when(F.col("train"), F.col(c).cast("double"))), F.lit(0.0)).alias(f"_m_{c}") for c in names]
    spread = spread.join(F.broadcast(spread.groupBy("model").agg(*middle)), "model")
    for c in names:
        spread = spread.withColumn(f"_v_{c}", F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")))
    figures = [f(F.when(F.col("train"), F.col(f"_v_{c}"))).alias(f"_{k}_{c}") for c in names for k, f in (("a", F.avg), ("s", F.stddev_pop))]
    spread = spread.join(F.broadcast(spread.groupBy("model").agg(*figures)), "model")
    scaled = [(F.col(f"_v_{c}") - F.col(f"_a_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in names]
    return spread.select(*rows.columns, "model", "train", F.array(*scaled).alias("x"))


def logistic_folds(scaled: DataFrame, p: int, c: float = 1.0, rounds: int = 25, tolerance: float = 1e-9) -> dict[int, np.ndarray]:
    """Ridge-penalized logistic coefficients (intercept last, not penalized) of every model, by Newton steps.

    One job a step sums gradients and Hessians of all models over all partitions; the driver solves p + 1 equations
    for each.
    """
    models = sorted(r["model"] for r in scaled.select("model").distinct().collect())
    beta = {m: np.zeros(p + 1) for m in models}
    size = (p + 1) * (p + 2)
    data = scaled.where("train").select("model", F.col("y").cast("double").alias("y"), "x").cache()
    for _ in range(rounds):
        now = {m: b.copy() for m, b in beta.items()}

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            sums = {m: np.zeros(size) for m in now}
            for b in batches:
                if not b.num_rows:
                    continue
                x = b.column("x").flatten().to_numpy().reshape(-1, p)
                x = np.concatenate([x, np.ones((len(x), 1))], 1)
                y, model = b.column("y").to_numpy(), b.column("model").to_numpy()
                for m in np.unique(model):
                    own = model == m
                    q = 1 / (1 + np.exp(-np.clip(x[own] @ now[m], -35, 35)))
                    sums[m] += np.concatenate([x[own].T @ (y[own] - q), ((x[own].T * (q * (1 - q))) @ x[own]).ravel()])
            keys = np.repeat(np.array(list(sums)), size)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.tile(np.arange(size), len(sums))), pa.array(np.concatenate(list(sums.values())))], names=["model", "i", "v"])

        total = {m: np.zeros(size) for m in models}
        for r in data.mapInArrow(run, "model long, i long, v double").groupBy("model", "i").agg(F.sum("v").alias("v")).collect():
            total[r["model"]][r["i"]] = r["v"]
        ridge = np.append(np.full(p, 1.0 / c), 0.0)
        step = 0.0
        for m in models:
            g = total[m][: p + 1] - ridge * beta[m]
            h = total[m][p + 1 :].reshape(p + 1, p + 1) + np.diag(ridge + 1e-12)
            move = np.linalg.solve(h, g)
            beta[m] = beta[m] + move
            step = max(step, float(np.abs(move).max()))
        if step < tolerance:
            break
    data.unpersist()
    return beta


def predictions(scaled: DataFrame, beta: dict[int, np.ndarray]) -> DataFrame:
    """Out-of-fold probabilities: each row scored by the model that did not see it."""
    pick = F.create_map(*[F.lit(v) for m, b in beta.items() for v in (m, [float(z) for z in b])])
    held = scaled.where(~F.col("train")).withColumn("_b", pick[F.col("model")])
    dot = F.aggregate(F.zip_with("x", F.slice("_b", 1, F.size("x")), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v) + F.element_at("_b", -1)
    return held.withColumn("p", 1 / (1 + F.exp(-dot))).drop("_b", "x", "train")


def coefficients(beta: dict[int, np.ndarray], names: list[str]) -> list[tuple[int, str, float]]:
    return [(int(m), c, float(v)) for m, b in beta.items() for c, v in zip(names, b)]


def coefficient_stability(table: DataFrame) -> DataFrame:
    """(feature, mean, std, share of folds with a positive coefficient, stable sign) of (model, feature, coef)."""
    up = F.avg((F.col("coef") > 0).cast("double"))
    return table.groupBy("feature").agg(F.avg("coef").alias("coef_mean"), F.stddev_samp("coef").alias("coef_std"), up.alias("share_positive"), ((up >= 0.8) | (up <= 0.2)).alias("sign_stable"))


def top_coefficients(table: DataFrame, k: int = 15) -> DataFrame:
    return table.orderBy(F.abs("coef").desc_nulls_last(), "feature").limit(k)


def forest_importance(rows: DataFrame, names: list[str], trees: int = 100, depth: int = 5, seed: int = 42):
    """(feature, importance) of a random forest over all rows, missing values as the column's median."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    middle = rows.agg(*[F.median(F.col(c).cast("double")).alias(c) for c in names]).head()
    filled = rows.select(F.col("y").cast("double").alias("label"), *[F.coalesce(F.col(c).cast("double"), F.lit(float(middle[c] or 0.0))).alias(c) for c in names])
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(VectorAssembler(inputCols=names, outputCol="features").transform(filled))
    return rows.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(names, model.featureImportances.toArray())], "feature string, importance double")


def svm_probabilities(scaled: DataFrame, reg: float = 0.01):
    """Out-of-fold probabilities of linear support vector machines with a logistic fit on the training margins."""
    from pyspark.ml.classification import LinearSVC, LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vectors = scaled.withColumn("features", array_to_vector("x")).withColumn("label", F.col("y").cast("double"))
    out = None
    for r in scaled.select("model").distinct().orderBy("model").collect():
        own = vectors.where(F.col("model") == r["model"])
        margin = LinearSVC(regParam=reg, maxIter=100).fit(own.where("train")).transform(own)
        margin = margin.select(*[c for c in scaled.columns if c != "x"], "label", array_to_vector(F.slice(vector_to_array("rawPrediction"), 2, 1)).alias("features"))
        part = LogisticRegression(maxIter=100).fit(margin.where("train")).transform(margin.where(~F.col("train")))
        part = part.select(*[c for c in scaled.columns if c not in ("x", "train")], vector_to_array("probability")[1].alias("p"))
        out = part if out is None else out.unionByName(part)
    return out
