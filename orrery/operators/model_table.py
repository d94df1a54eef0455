"""Any number of linear models at once, as a table: a row of coefficients for each key, fitted by sums over all rows.

Every Newton step is one pass: tasks sum gradients and Hessians of the models whose rows they hold, the sums of a model
meet in one row for each task, and its equations are solved where they meet. The driver sees one number a step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import attach, written

#: Rows of one model in one task; more are dealt to several.
ROWS_A_TASK = 100_000
_SUMS = "model string, beta array<double>, sums binary"


def _equations(x: np.ndarray, y: np.ndarray, beta: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray]:
    """Pull and weight of each row: how the loss draws its score, and how that changes with the score."""
    score = x @ beta
    if loss == "logistic":
        q = 1 / (1 + np.exp(-np.clip(score, -35, 35)))
        return y - q, q * (1 - q)
    sign = 2 * y - 1
    short = np.maximum(1 - sign * score, 0)
    return 2 * sign * short, 2.0 * (short > 0)


def _step_sums(p: int, loss: str):
    """One row for each model that a task meets in succession."""
    size = (p + 1) * (p + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: str | None = None
        beta, sums = np.zeros(p + 1), np.zeros(size)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([held]), pa.array([beta.tolist()], pa.list_(pa.float64())), pa.array([sums.tobytes()])], names=["model", "beta", "sums"])

        for batch in batches:
            if not batch.num_rows:
                continue
            models = batch.column("model").dictionary_encode()
            code = models.indices.to_numpy()
            x = batch.column("x").flatten().to_numpy().reshape(-1, p)
            x = np.concatenate([x, np.ones((len(x), 1))], 1)
            y, betas = batch.column("y").to_numpy(), batch.column("beta").flatten().to_numpy().reshape(-1, p + 1)
            edges = np.flatnonzero(np.append(True, code[1:] != code[:-1])).tolist() + [len(code)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                name = models.dictionary[code[lo]].as_py()
                if name != held:
                    if held is not None:
                        yield row()
                    held, beta, sums = name, betas[lo], np.zeros(size)
                own = x[lo:hi]
                pull, weight = _equations(own, y[lo:hi], beta, loss)
                sums = sums + np.concatenate([own.T @ pull, ((own.T * weight) @ own).ravel()])
        if held is not None:
            yield row()

    return run


def _solved(p: int, c: float, plain_intercept: bool, ridge: float):
    """The next coefficients of each model, from the sums that lie next to each other, and how far they moved."""
    penalty = np.append(np.full(p, ridge), 0.0 if plain_intercept else ridge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, beta, sums = None, None, None

        def solve():
            gradient = c * sums[: p + 1] - penalty * beta
            hessian = c * sums[p + 1 :].reshape(p + 1, p + 1) + np.diag(penalty + 1e-12)
            move = np.linalg.solve(hessian, gradient)
            return held, (beta + move).tolist(), float(np.abs(move).max())

        for batch in batches:
            out = []
            for name, b, s in zip(*(batch.column(k).to_pylist() for k in ("model", "beta", "sums"))):
                if name != held:
                    if held is not None:
                        out.append(solve())
                    held, beta, sums = name, np.array(b), np.zeros((p + 1) * (p + 2))
                sums = sums + np.frombuffer(s)
            yield _steps(out)
        if held is not None:
            yield _steps([solve()])

    return run


def _steps(rows: list) -> pa.RecordBatch:
    names, betas, moves = (list(v) for v in zip(*rows)) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(betas, pa.list_(pa.float64())), pa.array(moves, pa.float64())], names=["model", "beta", "move"])


def fit_table(rows: DataFrame, p: int, loss: str = "logistic", c: float = 1.0, plain_intercept: bool = True, ridge: float = 1.0, rounds: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """(model, beta): coefficients of every model, the intercept last.

    ``rows`` has model (string), y (0 to 1) and x (``p`` numbers); a row may stand for several models by being there
    several times. ``loss`` is ``logistic`` or ``squared_hinge``; minimized is ``ridge`` / 2 times the squared
    coefficients (without the intercept where ``plain_intercept``) and ``c`` times the losses. Models that have come to
    rest take no further part. A model with very many rows is dealt to several tasks.
    """
    sized = rows.groupBy("model").agg(F.count(F.lit(1)).alias("_n"))
    most = sized.agg(F.max("_n")).head()[0]
    if most is None:
        return rows.select("model", F.array().cast("array<double>").alias("beta")).where("false")
    salt = F.pmod(F.xxhash64("x", "y"), F.lit(-(-most // ROWS_A_TASK)))
    data = written(rows.select("model", F.col("y").cast("double").alias("y"), "x").withColumn("_s", salt).repartition("model", "_s").sortWithinPartitions("model"), "models")
    zero = F.array_repeat(F.lit(0.0), p + 1)
    open_ = written(data.select("model").distinct().withColumn("beta", zero), "models")
    done = None
    for _ in range(rounds):
        sums = attach(data, open_, ["model"]).select("model", "y", "x", "beta").mapInArrow(_step_sums(p, loss), _SUMS)
        solved = sums.repartition("model").sortWithinPartitions("model").mapInArrow(_solved(p, c, plain_intercept, ridge), "model string, beta array<double>, move double")
        moved = written(solved, "models")
        rested = moved.where(F.col("move") < tolerance).select("model", "beta")
        done = rested if done is None else done.unionByName(rested)
        open_ = moved.where(F.col("move") >= tolerance).select("model", "beta")
        if open_.isEmpty():
            return done
    return done.unionByName(open_)


def decision(x: Column, beta: Column) -> Column:
    products = F.zip_with(x, F.slice(beta, F.lit(1), F.size(x)), lambda a, b: a * b)
    return F.aggregate(products, F.element_at(beta, -1), lambda total, v: total + v)


def probability(score: Column) -> Column:
    return 1 / (1 + F.exp(-score))


def scored(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with ``score`` of their model."""
    return attach(rows, table, ["model"]).withColumn("score", decision(F.col("x"), F.col("beta"))).drop("beta")


def standardized(rows: DataFrame, names: list[str], by: list[str], seen: Column) -> DataFrame:
    """Adds ``x``: the named columns with missing values at the median, less the mean, over the deviation of the rows ``seen`` by each model.

    Medians without any value are 0, deviations of 0 count as 1. ``by`` names a model's keys.
    """
    own = lambda c: F.when(seen, c)
    clean = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in names}
    rows = written(rows.withColumns(clean), "models")
    middle = rows.groupBy(*by).agg(F.array(*[F.coalesce(F.median(own(F.col(c))), F.lit(0.0)) for c in names]).alias("_m"))
    filled = attach(rows, middle, by).withColumn("_v", F.array(*[F.coalesce(F.col(c), F.col("_m")[i]) for i, c in enumerate(names)]))
    filled = written(filled.drop("_m", *names), "models")
    cells = [F.col("_v")[i] for i in range(len(names))]
    facts = filled.groupBy(*by).agg(F.array(*[F.avg(own(v)) for v in cells]).alias("_a"), F.array(*[F.stddev_pop(own(v)) for v in cells]).alias("_s"))
    scaled = F.zip_with(F.zip_with("_v", "_a", lambda v, a: v - a), "_s", lambda d, s: d / F.when(s > 0, s).otherwise(1.0))
    return attach(filled, facts, by).withColumn("x", F.transform(scaled, lambda v: F.coalesce(v, F.lit(0.0)))).drop("_v", "_a", "_s")


def logistic_predictions(rows: DataFrame, p: int) -> DataFrame:
    """Held-out rows with ``p``, the probability by ridge-penalized logistic models. ``rows``: model, train, y, x and others."""
    table = fit_table(rows.where("train"), p)
    return scored(rows.where("NOT train"), table).withColumn("p", probability(F.col("score"))).drop("score", "x")


def svm_predictions(rows: DataFrame, p: int, part: str = "part", parts: int = 3) -> DataFrame:
    """Held-out rows with ``p``, the mean of ``parts`` linear squared-hinge machines, each calibrated on the training rows that it did not see.

    ``part`` (1 to ``parts``) deals the training rows; the sigmoid of a machine is a logistic model of its scores, with
    targets drawn in by one row of each class. A machine whose own part has no training rows is left out, as is one
    without rows of other parts.
    """
    each = rows.withColumn("_part", F.col(part)).withColumn("_out", F.explode(F.array(*[F.lit(k) for k in range(1, parts + 1)])))
    each = each.withColumn("_whole", F.col("model")).withColumn("model", F.concat_ws("|", "model", F.col("_out").cast("string")))
    table = fit_table(each.where("train AND _part <> _out"), p, "squared_hinge", plain_intercept=False)
    found = written(scored(each.where("NOT train OR _part = _out"), table).drop("x"), "models")
    shown = found.where("train")
    counts = shown.groupBy("model").agg(F.count_if(F.col("y") == 1).alias("_up"), F.count_if(F.col("y") != 1).alias("_down"))
    aim = F.when(F.col("y") == 1, (F.col("_up") + 1) / (F.col("_up") + 2)).otherwise(1 / (F.col("_down") + 2))
    sigmoids = fit_table(attach(shown, counts, ["model"]).select("model", aim.alias("y"), F.array("score").alias("x")), 1, ridge=0.0)
    held = attach(found.where("NOT train"), sigmoids, ["model"]).withColumn("p", probability(decision(F.array("score"), F.col("beta"))))
    keys = [c for c in rows.columns if c not in ("x", "model", "train")]
    return held.groupBy("_whole", *keys).agg(F.avg("p").alias("p")).withColumnRenamed("_whole", "model")


def fold_sides(rows: DataFrame, folds: int, fold: str = "fold") -> DataFrame:
    """Every row once for each fold: ``held`` is the fold and ``train`` whether the row lies outside it."""
    return rows.withColumn("held", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(folds).cast("long")))).withColumn("train", F.col(fold) != F.col("held"))


def block_rows(rows: DataFrame, names: list[str], blocks: dict[str, list[str]], keys: list[str]) -> DataFrame:
    """Rows once for each block of features, with the others' values at 0; the model is named by block and keys.

    A penalized coefficient of a feature that is always 0 is 0, so all blocks are fitted with the same equations.
    """
    masks = [F.struct(F.lit(b).alias("block"), F.array(*[F.lit(float(c in own)) for c in names]).alias("mask")) for b, own in blocks.items()]
    each = rows.withColumn("_b", F.explode(F.array(*masks)))
    each = each.withColumn("block", F.col("_b")["block"]).withColumn("x", F.zip_with("x", F.col("_b")["mask"], lambda v, m: v * m)).drop("_b")
    return each.withColumn("model", F.concat_ws("|", "block", *[F.col(k).cast("string") for k in keys]))


