"""Bootstrap of whole pairs: all replicates at once, as weights on the rows of one pass in order of the score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import PART, attach, written
from .stats import THRESHOLD, numbered_from_0, pair_margins

METRICS = ["auc", "balanced_accuracy", "sensitivity", "specificity", "f1", "mcc", "pairwise_concordance"]
_TALLIES = ["neg", "pos", "u", "tp", "fp", "fn", "tn"]


def replicate_draws(pairs: DataFrame, replicates: int, pair: str = "pair_id") -> DataFrame:
    """(pair, draws): the replicates in which a pair is drawn, as often as it is; each draws as many pairs as there are.

    Draw k of replicate b is a fixed arithmetic hash of (b, k), so that every engine draws alike. A pair has as many
    draws as there are replicates, on average, so rows stay small whatever the number of pairs.
    """
    numbered = written(numbered_from_0(pairs.select(pair).distinct(), [pair], "_k"))
    each = attach(numbered, numbered.agg(F.count(F.lit(1)).alias("_n")), []).select("_k", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))).alias("b"))
    mixed = (F.col("b") + 1) * 1103515245 + (F.col("_k") + 1) * 12345 + (F.col("b") + 1) * (F.col("_k") + 1) * 69069
    drawn = each.select(F.col("b").cast("int").alias("b"), F.pmod(F.floor(F.pmod(mixed, F.lit(2147483647)) / 7).cast("long"), F.col("_n")).alias("_k"))
    lists = drawn.groupBy("_k").agg(F.collect_list("b").alias("draws"))
    return numbered.join(lists, "_k", "left").select(pair, F.coalesce("draws", F.array().cast("array<int>")).alias("draws"))


def _weights(batch: pa.RecordBatch, replicates: int, multiplicity: bool) -> np.ndarray:
    """Times that each row is drawn, a column for each replicate; the last column is the rows as they are."""
    lists = batch.column("draws")
    ends = lists.offsets.to_numpy()
    row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
    flat = lists.flatten().to_numpy().astype(np.int64)
    times = np.bincount(row * (replicates + 1) + flat, minlength=batch.num_rows * (replicates + 1)).reshape(batch.num_rows, replicates + 1).astype(np.float64)
    if not multiplicity:
        times = np.minimum(times, 1.0)
    times[:, replicates] = 1.0
    return times


def _ordered_sums(replicates: int, multiplicity: bool, threshold: float):
    """Sums over one range of scores, for every replicate: weights of both classes, ordered pairs within the range, and the four counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = replicates + 1
        sums = {k: np.zeros(size) for k in _TALLIES}
        score, tied = None, (np.zeros(size), np.zeros(size))
        part = None

        def close() -> None:
            pos, neg = tied
            sums["u"] += pos * (sums["neg"] + 0.5 * neg)
            sums["pos"] += pos
            sums["neg"] += neg

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(PART)[0].as_py()
            w = _weights(batch, replicates, multiplicity)
            p, y = batch.column("p").to_numpy(), batch.column("y").to_numpy()
            hit, truth = p >= threshold, y == 1
            for name, rows in (("tp", hit & truth), ("fp", hit & ~truth), ("fn", ~hit & truth), ("tn", ~hit & ~truth)):
                sums[name] += rows @ w
            first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
            pos, neg = np.add.reduceat(w * truth[:, None], first, axis=0), np.add.reduceat(w * ~truth[:, None], first, axis=0)
            if score is not None and p[0] == score:
                pos[0] += tied[0]
                neg[0] += tied[1]
            elif score is not None:
                close()
            below = sums["neg"] + np.cumsum(neg, axis=0) - neg
            sums["u"] += (pos[:-1] * (below[:-1] + 0.5 * neg[:-1])).sum(0)
            sums["pos"] += pos[:-1].sum(0)
            sums["neg"] += neg[:-1].sum(0)
            score, tied = p[-1], (pos[-1], neg[-1])
        if part is not None:
            close()
            columns = [pa.array(np.full(size, part, np.int32)), pa.array(np.arange(size, dtype=np.int32)), *[pa.array(sums[k]) for k in _TALLIES]]
            yield pa.RecordBatch.from_arrays(columns, names=[PART, "b", *_TALLIES])

    return run


def _pair_sums(replicates: int, multiplicity: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agree, n = np.zeros(replicates + 1), np.zeros(replicates + 1)
        for batch in batches:
            if batch.num_rows:
                w = _weights(batch, replicates, multiplicity)
                agree += (batch.column("margin").to_numpy() > 0) @ w
                n += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates + 1, dtype=np.int32)), pa.array(agree), pa.array(n)], names=["b", "agree", "n"])

    return run


def replicate_metrics(scores: DataFrame, draws: DataFrame, replicates: int, multiplicity: bool = False, threshold: float = THRESHOLD, pair: str = "pair_id") -> DataFrame:
    """(b, metric, v) of the seven metrics; replicate ``replicates`` is the rows as they are.

    Replicates with one class only have none. Rows are ranged by score once; each range leaves a few sums for every
    replicate, and what lies below a range is added when these meet. Rows without score, label or pair are left out.
    """
    rows = scores.select(pair, F.col("y").cast("int").alias("y"), F.col("p").cast("double").alias("p")).dropna().join(draws, pair)
    n = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, "p").sortWithinPartitions("p").select(F.spark_partition_id().alias(PART), "p", "y", "draws")
    schema = f"{PART} int, b int, " + ", ".join(f"{k} double" for k in _TALLIES)
    parts = written(ranged.mapInArrow(_ordered_sums(replicates, multiplicity, threshold), schema))
    lower = F.coalesce(F.sum("neg").over(Window.partitionBy("b").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    whole = parts.withColumn("u", F.col("u") + F.col("pos") * lower).groupBy("b").agg(*[F.sum(k).alias(k) for k in _TALLIES]).where("pos > 0 AND neg > 0")
    margins = pair_margins(scores, [], pair).join(draws, pair).select("margin", "draws")
    pairs = margins.mapInArrow(_pair_sums(replicates, multiplicity), "b int, agree double, n double").groupBy("b").agg((F.sum("agree") / F.when(F.sum("n") > 0, F.sum("n"))).alias("pairwise_concordance"))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    margin = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    recall, specificity = tp / (tp + fn), tn / (tn + fp)
    values: dict[str, Column] = {
        "auc": F.col("u") / (F.col("pos") * F.col("neg")),
        "balanced_accuracy": (recall + specificity) / 2,
        "sensitivity": recall,
        "specificity": specificity,
        "f1": F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0),
        "mcc": F.when(margin > 0, (tp * tn - fp * fn) / F.sqrt(margin)).otherwise(0.0),
        "pairwise_concordance": F.col("pairwise_concordance"),
    }
    wide = whole.join(pairs, "b", "left").select("b", *[v.alias(c) for c, v in values.items()])
    return wide.unpivot(["b"], METRICS, "metric", "v").where("v IS NOT NULL")


def bootstrap(scores: DataFrame, replicates: int = 500, multiplicity: bool = False, confidence: float = 0.95, pair: str = "pair_id") -> DataFrame:
    """(metric, observed, mean, sd, low, high, replicates) of seven metrics over replicates of whole pairs.

    Without ``multiplicity`` a replicate is the set of the pairs drawn, else pairs count as often as they are drawn.
    """
    draws = written(replicate_draws(scores, replicates, pair))
    values = replicate_metrics(scores, draws, replicates, multiplicity, pair=pair)
    tail, drawn = (1 - confidence) / 2, F.when(F.col("b") < replicates, F.col("v"))
    figures = [F.avg(drawn).alias("mean"), F.stddev_pop(drawn).alias("sd"), F.percentile(drawn, tail).alias("low"), F.percentile(drawn, 1 - tail).alias("high"), F.count(drawn).alias("replicates")]
    return values.groupBy("metric").agg(F.max(F.when(F.col("b") == replicates, F.col("v"))).alias("observed"), *figures)
