"""As-of join: each row with the last one of another table before it, in range partitions of key and time.

Rows of both tables are cut into ranges of (key, time).  Within a piece the last right row
is carried by a window over key and piece; what a piece inherits comes from the last right
rows of the pieces before it, one row a key and piece.  So no key, and no lack of a key,
brings all rows into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import bucket_count, stored


def asof(left: DataFrame, right: DataFrame, on: str, by: tuple[str, ...] = (), carry: dict[str, str] | None = None, tie: str | None = None, strict: bool = True) -> DataFrame:
    """``left`` with columns of the last row of ``right`` before it (not strict: or at the same time), null where none is.

    ``by`` names columns that must be equal (nulls are equal), ``carry`` the columns taken over and
    their new names, ``tie`` the column of ``right`` whose greatest value wins at one time.  Rows of
    ``right`` without a time take no part; rows of ``left`` without one find nothing.
    """
    carry = carry or {c: f"{c}_before" for c in right.columns if c not in by}
    keys = [f"_k{i}" for i in range(max(1, len(by)))]
    key = lambda df: [F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=False)] if by else [F.lit(0).alias(keys[0])]
    row, got = F.struct(*[F.col(f"`{c}`") for c in left.columns]), F.struct(*[F.col(f"`{c}`").alias(n) for c, n in carry.items()])
    first, second = (0, 1) if strict else (1, 0)
    kind = right.schema[tie].dataType if tie else "int"
    mine = left.select(*key(left), F.col(f"`{on}`").alias("_t"), F.lit(first).alias("_side"), F.lit(None).cast(kind).alias("_tie"), row.alias("_l"), F.lit(None).cast(right.select(got).schema[0].dataType).alias("_r"))
    theirs = right.where(F.col(f"`{on}`").isNotNull()).select(*key(right), F.col(f"`{on}`").alias("_t"), F.lit(second).alias("_side"), (F.col(f"`{tie}`") if tie else F.lit(None).cast(kind)).alias("_tie"), F.lit(None).cast(left.select(row).schema[0].dataType).alias("_l"), got.alias("_r"))
    rows = mine.unionByName(theirs)
    order = ["_t", "_side", "_tie"]
    cut = stored(rows.repartitionByRange(bucket_count(rows), *keys, *order).withColumn("_piece", F.spark_partition_id()), "asof")
    there = F.col("_r").isNotNull()
    place = F.struct("_t", "_tie")
    tails = cut.groupBy(*keys, "_piece").agg(F.max_by(F.when(there, F.col("_r")), F.when(there, place)).alias("_tail"))
    before = F.last("_tail", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1))
    heads = tails.select(*[F.col(k).alias(f"_h{k}") for k in keys], F.col("_piece").alias("_hp"), before.alias("_head"))
    same = F.col("_piece") == F.col("_hp")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_h{k}"))
    within = F.last("_r", ignorenulls=True).over(W.partitionBy(*keys, "_piece").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    found = cut.withColumn("_within", within).where(F.col("_l").isNotNull()).join(heads, same, "left").withColumn("_r", F.when(F.col("_t").isNotNull(), F.coalesce("_within", "_head")))
    return found.select("_l.*", *[F.col(f"_r.{n}").alias(n) for n in carry.values()])
