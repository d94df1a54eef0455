"""Readers and writers of tables and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, nanValue="NaN", emptyValue="")


def write_report_csv(df: DataFrame, path: str) -> None:
    """One CSV file for a report table; large tables belong in Parquet."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_windows(df: DataFrame, path: str) -> None:
    """Window rows partitioned by kind and size, so that later filters on these read only their files."""
    df.write.mode("overwrite").partitionBy("window_type", "window_size").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at ``path``, built and written first if it is not there or ``force`` is set."""
    if force or not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def checksums(spark: SparkSession, path: str, digits: int = 16) -> DataFrame:
    """(path, sha256): the first hex digits of each file's digest."""
    return spark.read.format("binaryFile").load(path).select("path", F.substring(F.sha2("content", 256), 1, digits).alias("sha256"))


def markdown(df: DataFrame, title: str) -> str:
    """A whole report table as Markdown; rows come to the driver partition by partition."""
    head = f"## {title}\n\n| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    show = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    return head + "".join(f"| {' | '.join(show(v) for v in r)} |\n" for r in df.toLocalIterator())


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every NaN of a double or float column as null, as all operators expect."""
    kinds = (T.DoubleType, T.FloatType)
    return df.select(*[F.nanvl(F.col(f.name), F.lit(None)).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f.name) for f in df.schema.fields])
