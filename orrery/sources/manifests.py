"""Record manifests as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAIN_TASK = "main_p_far_vs_p_pre"
SECONDARY_TASK = "secondary_p_vs_n"


def _records(spark: SparkSession, prefix: str, n: int) -> DataFrame:
    i = F.col("id")
    return spark.range(1, n + 1).select(F.format_string(f"{prefix}%02d", i).alias("record_id"), F.floor((i - 1) / 2).cast("long").alias("pair_id"), i.alias("_i"))


def main_manifest(spark: SparkSession, n: int = 50) -> DataFrame:
    """n records of one cohort in pairs; odd numbers are far from onset (0), even ones before it (1)."""
    return _records(spark, "p", n).select("record_id", "pair_id", (F.col("_i") % 2 == 0).cast("int").alias("y"), F.lit(MAIN_TASK).alias("analysis_task"))


def secondary_manifest(spark: SparkSession, n: int = 50) -> DataFrame:
    """Both cohorts, n records each: p is 1 and n is 0. Group ids are shared by unrelated records of the two."""
    p = _records(spark, "p", n).withColumn("y", F.lit(1))
    return p.unionByName(_records(spark, "n", n).withColumn("y", F.lit(0))).select("record_id", "pair_id", "y", F.lit(SECONDARY_TASK).alias("analysis_task"))


def audit_manifest(spark: SparkSession, n: int = 50) -> DataFrame:
    """All record kinds of a database with the reason why a record is left out of the main task, if it is."""
    out = None
    for prefix, tail, reason in (("p", "", None), ("n", "", "control"), ("p", "c", "continuation"), ("n", "c", "control")):
        part = _records(spark, prefix, n).select(F.concat("record_id", F.lit(tail)).alias("record_id"), "pair_id", F.lit(reason).cast("string").alias("excluded"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("included", F.col("excluded").isNull())
