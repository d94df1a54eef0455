"""Running figures over ordered groups of any size: no task ever holds, sorts or reads more than one range of a group.

A table is cut by range over its group and order columns, so that one group lies in as many parts as its rows fill. A
first pass reduces each part of a group to its composition (a sum, an extreme, an affine map); the compositions, a row
for each part, are combined in order; a second pass adds to each part's own running figures what came before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "_part"
#: Rows of facts by group that are broadcast to the groups' rows; more are joined by key.
BROADCAST_ROWS = 100_000
_KINDS = {"sum": F.sum, "min": F.min, "max": F.max}


def written(df: DataFrame, name: str = "scan") -> DataFrame:
    """The rows as a table in the shared folder: what is read twice is made once, whatever executors are lost.

    The table is deleted when the driver ends.
    """
    from ..plans.base import shared_dir

    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def segmented(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], parts: int | None = None) -> DataFrame:
    """The rows with their part's number; parts follow each other in the order of ``by`` and ``order``.

    Equal rows in both lie in one part, so figures of ties are whole. The parts' bounds come from a sample, which is
    why the numbered rows are written and not made again.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, *order]
    return written(rows.repartitionByRange(n, *keys).withColumn(PART, F.spark_partition_id()))


def attach(rows: DataFrame, facts: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows with the facts of their group, of which ``facts`` has one row; groups may be null.

    Facts are written once, since they are counted before they are joined.
    """
    named = written(facts.select(*[F.col(c).alias(f"_k_{c}") for c in by], *[c for c in facts.columns if c not in by]), "facts")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by], F.lit(True))
    small = named.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(named) if small else named, same, how).drop(*[f"_k_{c}" for c in by])


def running(table: DataFrame, by: Sequence[str], order: Sequence[str | Column], values: dict[str, tuple[str, Column]], inclusive: bool = True, backward: bool = False) -> DataFrame:
    """Adds running sums, least or largest values of each group, in its order or backward.

    ``values`` maps names to (``sum``, ``min`` or ``max``, column); ``table`` is of ``segmented``; backward, ``order``
    has names alone. Without
    ``inclusive`` a row's own value is left out; sums over nothing are 0, extremes null.
    """
    # backward figures run forward over the reversed order: frames that end at the last row are made anew for each row
    turned = [F.desc(c) for c in (*order, PART)] if backward else [*order, PART]
    far = Window.unboundedPreceding
    local = Window.partitionBy(*by, PART).orderBy(*turned[:-1]).rowsBetween(far, 0 if inclusive else -1)
    others = Window.partitionBy(*by).orderBy(turned[-1]).rowsBetween(far, -1)
    facts = table.groupBy(*by, PART).agg(*[_KINDS[kind](c).alias(n) for n, (kind, c) in values.items()])
    facts = facts.select(*by, PART, *[_KINDS[kind](F.col(n)).over(others).alias(f"_c_{n}") for n, (kind, _) in values.items()])
    rows = attach(table.withColumns({n: _KINDS[kind](c).over(local) for n, (kind, c) in values.items()}), facts, [*by, PART])
    joined = {}
    for n, (kind, _) in values.items():
        here, before = F.col(n), F.col(f"_c_{n}")
        joined[n] = F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0)) if kind == "sum" else F.least(here, before) if kind == "min" else F.greatest(here, before)
    return rows.withColumns(joined).drop(*[f"_c_{n}" for n in values])


def before(table: DataFrame, by: Sequence[str], order: Sequence[str | Column], value: str, out: str) -> DataFrame:
    """Adds the value of the row before, across parts; null at a group's first row. ``order`` is a single column."""
    last = table.groupBy(*by, PART).agg(F.max_by(value, order[0]).alias("_last"))
    last = last.select(*by, PART, F.lag("_last").over(Window.partitionBy(*by).orderBy(PART)).alias("_last"))
    here = Window.partitionBy(*by, PART).orderBy(*order)
    rows = attach(table, last, [*by, PART])
    first = F.row_number().over(here) == 1
    return rows.withColumn(out, F.when(first, F.col("_last")).otherwise(F.lag(value).over(here))).drop("_last")


def reflected(table: DataFrame, by: Sequence[str], order: Sequence[str | Column], steps: dict[str, Column]) -> DataFrame:
    """Adds max(0, S + step) over time for each named column of steps, from sums that start at 0.

    That is the running total less the least of 0 and the total's running minimum. A part is reduced to its total and
    its least prefix; nulls are steps of 0.
    """
    local = Window.partitionBy(*by, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = table.withColumns({f"_p_{n}": F.coalesce(F.sum(c).over(local), F.lit(0.0)) for n, c in steps.items()})
    earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    facts = rows.groupBy(*by, PART).agg(*[x for n, c in steps.items() for x in (F.coalesce(F.sum(c), F.lit(0.0)).alias(f"_t_{n}"), F.min(f"_p_{n}").alias(f"_l_{n}"))])
    facts = facts.withColumns({f"_b_{n}": F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0.0)) for n in steps})
    facts = facts.withColumns({f"_f_{n}": F.min(F.col(f"_b_{n}") + F.col(f"_l_{n}")).over(earlier) for n in steps})
    rows = attach(rows, facts.drop(*[f"_{k}_{n}" for n in steps for k in "tl"]), [*by, PART])
    out = {}
    for n in steps:
        total = F.col(f"_b_{n}") + F.col(f"_p_{n}")
        least = F.least(F.lit(0.0), F.col(f"_f_{n}"), F.col(f"_b_{n}") + F.min(f"_p_{n}").over(local))
        out[n] = total - least
    return rows.withColumns(out).drop(*[f"_{k}_{n}" for n in steps for k in "pbf"])


def stretch_lengths(table: DataFrame, by: Sequence[str], index: str, flags: dict[str, str]) -> DataFrame:
    """For each flag column the length of the stretch of true values that a row lies in, 0 outside.

    ``index`` counts a group's rows from 0 without gaps. A stretch ends at the last false row before it and the first
    one behind it, wherever these lie.
    """
    at = F.col(index)
    ahead = running(table, by, [index], {f"_a_{n}": ("max", F.when(~F.col(f), at)) for n, f in flags.items()})
    back = {f"_z_{n}": ("min", F.when(~F.col(f), at)) for n, f in flags.items()}
    both = running(ahead, by, [index], {**back, "_end": ("max", at)}, backward=True)
    stop = lambda n: F.coalesce(f"_z_{n}", F.col("_end") + 1)
    rows = both.withColumns({n: F.when(F.col(f), stop(n) - F.coalesce(f"_a_{n}", F.lit(-1)) - 1).otherwise(0).cast("long") for n, f in flags.items()})
    return rows.drop("_end", *[f"_{k}_{n}" for n in flags for k in "az"])
