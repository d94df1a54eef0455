"""Jump consistent hashing of stable keys to shards, with gapless slots inside each shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import Scratch, text_of

# Fixed values of the published jump hash: multiplier of its 64-bit generator, and 2**31.
#: Jumps that nearly all keys get by with.
USUAL_JUMPS = 16
JUMP_MULTIPLIER = 2862933555777941757
JUMP_SPAN = 2147483648
_WRAP = "cast(18446744073709551616 as decimal(38,0))"


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a 64-bit key among ``shards``: the jumps grow strictly, so ``shards`` steps always suffice.

    The generator's state is kept as an unsigned decimal, since 64-bit overflow is an error in ANSI mode.
    A null key is treated as 0.
    """
    key = F.coalesce(key.cast("long"), F.lit(0)).cast("decimal(38,0)")
    wrap = F.expr(_WRAP)
    start = F.struct(
        F.when(key < 0, key + wrap).otherwise(key).cast("decimal(20,0)").alias("state"),
        F.lit(-1).cast("long").alias("at"),
        F.lit(0).cast("long").alias("next"),
    )

    def step(acc: Column, _: Column) -> Column:
        product = acc["state"] * F.lit(JUMP_MULTIPLIER).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")
        state = (product.cast("decimal(38,0)") % wrap).cast("decimal(20,0)")
        draw = F.floor(state / F.lit(8589934592).cast("decimal(10,0)")).cast("double") + 1.0
        jumped = F.floor((acc["next"] + 1).cast("double") * (F.lit(float(JUMP_SPAN)) / draw)).cast("long")
        moved = F.struct(state.alias("state"), acc["next"].alias("at"), jumped.alias("next"))
        return F.when(acc["next"] < shards, moved).otherwise(acc)

    # a key jumps about ln(shards) times; the few that need more than the first steps take the rest
    few = min(max(1, shards), USUAL_JUMPS)
    first = F.aggregate(F.sequence(F.lit(1), F.lit(few)), start, step)
    if few >= shards:
        return first["at"].cast("int")
    rest = F.sequence(F.lit(few + 1), F.lit(shards))
    done = F.transform(F.array(first), lambda a: F.when(a["next"] >= shards, a["at"]).otherwise(F.aggregate(rest, a, step, lambda b: b["at"])))
    return done[0].cast("int")


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its shard among ``shards``, its slot there, and its shard once one more is appended.

    The law is ``key``: only the id and the shard count decide, so appending a shard moves rows into that shard
    alone. Slots count the rows of a shard from 0 in the order of (id, text_crc32, size), nulls first. A null text
    has no bytes; a null id is hashed as 0; repeated rows take slots of their own; an empty table gives no rows.
    Other columns are ignored. Rows are numbered by ranges with a random tail in the key, so one hot id is spread
    over many tasks although it must share a shard.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = text_of(text_col)
    key = F.col(id_col)
    rows = docs.select(
        key.cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        jump_hash(key, shards).alias("shard"),
        jump_hash(key, shards + 1).alias("grown_shard"),
    )
    order = ["doc_id", "text_crc32", "size"]
    ranged = rows.withColumn("_tail", F.rand(17)).repartitionByRange("shard", *order, "_tail")
    ranged = scratch.table(ranged.select("*", F.spark_partition_id().alias("_part")))
    counts = ranged.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    local = Window.partitionBy("shard", "_part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    numbered = ranged.withColumn("_at", F.row_number().over(local)).join(starts, ["shard", "_part"])
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("_start") + F.col("_at") - 1).cast(T.LongType()).alias("slot"),
        "grown_shard",
    )
