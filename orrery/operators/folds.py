"""Grouped folds, their audit, and audits of the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import numbered_from_0


def group_folds(rows: DataFrame, group: str, k: int = 5) -> DataFrame:
    """(group, fold) with folds 1..k: groups from the largest to the smallest, later ids first, dealt in turn.

    No group is in two folds; with groups of one size fold sizes differ by one group at most.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    dealt = numbered_from_0(sizes, [F.desc("_n"), F.desc(group)], "_turn")
    return dealt.select(group, ((F.col("_turn") % k) + 1).cast("long").alias("fold"))


def fold_audit(rows: DataFrame, folds: DataFrame, group: str, id_col: str) -> DataFrame:
    """One row for each fold: sizes of both sides, sorted ids of the validation groups, and whether the sides share none."""
    labelled = rows.join(folds, group)
    parts = folds.select(F.col("fold").alias("_f")).distinct()
    sides = parts.crossJoin(labelled).withColumn("_in", F.col("fold") == F.col("_f"))
    out = sides.groupBy("_f").agg(F.count_if("_in").alias("n_val"), F.count_if(~F.col("_in")).alias("n_train"), F.array_sort(F.collect_set(F.when(F.col("_in"), F.col(group)))).alias("_v"), F.collect_set(F.when(~F.col("_in"), F.col(group))).alias("_t"))
    return out.select(F.col("_f").alias("fold"), "n_val", "n_train", F.array_join(F.col("_v").cast("array<string>"), ",").alias("val_groups"), (~F.arrays_overlap("_v", "_t")).alias("disjoint"))


def disjoint(a: DataFrame, b: DataFrame, column: str) -> bool:
    return a.select(column).intersect(b.select(column)).isEmpty()


def nan_audit(rows: DataFrame, names: list[str], blocks: dict[str, list[str]]) -> DataFrame:
    """(feature, n_missing, pct_missing, in_<block>...) over null and NaN values."""
    counts = [F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in names]
    total = rows.agg(F.count(F.lit(1)).alias("_n"), *counts)
    long = total.unpivot(["_n"], names, "feature", "n_missing")
    marks = [F.col("feature").isin(members).alias(f"in_{b}") for b, members in blocks.items()]
    return long.select("feature", "n_missing", F.when(F.col("_n") > 0, 100.0 * F.col("n_missing") / F.col("_n")).alias("pct_missing"), *marks)


def dataset_audit(records: DataFrame, id_col: str, pair: str = "pair_id", label: str = "y") -> DataFrame:
    """(rule, violations, status): ids without a trailing c, none that begins with n and a digit, pairs of two, both labels."""
    name = F.col(id_col).cast("string")
    by_pair = records.groupBy(pair).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(label).alias("_l"))
    rules = [
        records.select(F.lit("no_continuation_record").alias("rule"), F.count_if(name.endswith("c")).alias("violations")),
        records.select(F.lit("no_control_record").alias("rule"), F.count_if(name.rlike(r"(?i)^n\d+")).alias("violations")),
        by_pair.select(F.lit("two_rows_per_pair").alias("rule"), F.count_if(F.col("_n") != 2).alias("violations")),
        by_pair.select(F.lit("both_labels_per_pair").alias("rule"), F.count_if(F.col("_l") != 2).alias("violations")),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out.withColumn("status", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))
