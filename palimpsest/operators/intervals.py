"""Byte intervals of candidates: union, overlap, gaps and their neighbours.

Islands are found in two steps: first within stretches of ``STRETCH`` bytes of a
group, then over the islands that are left, so that a group with very many intervals
is sorted in many tasks and only its islands meet in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import bucket_count, stored

STRETCH = 1 << 24


def _merge(df: DataFrame, keys: list[str]) -> DataFrame:
    """Islands of (begin, stop) by keys; intervals that overlap or touch are one.

    Sorted rows are read in order and only those that open or close an island go on, so
    nothing is held for each island.  first_id and last_id are kept where ``df`` has them.
    """
    ids = [c for c in ("first_id", "last_id") if c in df.columns]
    by = W.partitionBy(*keys).orderBy("begin", *ids[:1], "stop")
    to_here, before = by.rowsBetween(W.unboundedPreceding, 0), by.rowsBetween(W.unboundedPreceding, -1)
    df = df.select(*keys, "begin", *ids, "stop", F.max("stop").over(before).alias("before"), F.max(F.struct("stop", *ids[1:])).over(to_here).alias("upto"), F.lead("begin").over(by).alias("next"))
    opens = F.col("before").isNull() | F.coalesce(F.col("begin") > F.col("before"), F.lit(False))
    closes = F.col("next").isNull() | F.coalesce(F.col("next") > F.col("upto.stop"), F.lit(True))
    some = df.select("*", opens.alias("opens"), closes.alias("closes")).where("opens or closes")
    end = F.when(F.col("closes"), F.col("upto")).otherwise(F.lead("upto").over(by))
    found = some.withColumn("end", end).where("opens")
    return found.select(*keys, "begin", F.col("end.stop").alias("stop"), *ids[:1], *[F.col(f"end.{c}").alias(c) for c in ids[1:]])


def islands(df: DataFrame, group: str = "group", begin: str = "begin", length: str = "length", id_: str | None = "id", buckets: int | None = None) -> DataFrame:
    """group, begin, stop, first_id (of the earliest interval), last_id (of the one that ends last).  Empty intervals are dropped.

    Without ``id_`` there are no ids.  ``buckets``: how many pieces each exchange takes, if more than the session's setting.
    """
    at, n = F.col(begin).cast("bigint"), F.col(length).cast("bigint")
    ids = [F.col(id_).alias("first_id"), F.col(id_).alias("last_id")] if id_ else []
    rows = df.where(n > 0).select(F.col(group).alias("group"), at.alias("begin"), (at + n).alias("stop"), *ids)
    rows = rows.withColumn("stretch", F.floor(F.col("begin") / STRETCH))
    dealt = lambda x, *by: x.repartition(buckets, *by) if buckets and buckets > int(x.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")) else x
    some = _merge(dealt(rows, "group", "stretch"), ["group", "stretch"]).drop("stretch")
    return _merge(dealt(some, "group"), ["group"])


def gaps(found: DataFrame) -> DataFrame:
    """group, gap_start, gap_end, gap_length, prev_id, next_id between consecutive islands."""
    by = W.partitionBy("group").orderBy("begin")
    nxt = found.withColumn("next_begin", F.lead("begin").over(by)).withColumn("next_id", F.lead("first_id").over(by)).where("next_begin is not null")
    return nxt.select("group", F.col("stop").alias("gap_start"), F.col("next_begin").alias("gap_end"), (F.col("next_begin") - F.col("stop")).alias("gap_length"), F.col("last_id").alias("prev_id"), "next_id")


def coverage(df: DataFrame, group: str = "group", begin: str = "begin", length: str = "length", buckets: int | None = None) -> DataFrame:
    """group, fragments, raw_bytes, unique_bytes, overlap_bytes, gap_count, gap_bytes, span_bytes, ranges; ``buckets`` as for ``islands``."""
    raw = df.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("fragments"), F.sum(F.greatest(F.col(length).cast("bigint"), F.lit(0))).alias("raw_bytes"))
    one = islands(df, group, begin, length, None, buckets).groupBy("group").agg(
        F.sum(F.col("stop") - F.col("begin")).alias("unique_bytes"),
        (F.count("*") - 1).alias("gap_count"),
        (F.max("stop") - F.min("begin")).alias("span"),
        F.sort_array(F.collect_list(F.struct("begin", "stop"))).alias("ranges"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    both = raw.join(one, "group", "left").select("group", "fragments", "raw_bytes", zero("unique_bytes"), zero("gap_count"), F.coalesce("span", F.lit(0)).alias("span_bytes"), "ranges")
    return both.select("group", "fragments", "raw_bytes", "unique_bytes", (F.col("raw_bytes") - F.col("unique_bytes")).alias("overlap_bytes"), "gap_count", (F.col("span_bytes") - F.col("unique_bytes")).alias("gap_bytes"), "span_bytes", "ranges")


def running_offset(df: DataFrame, group: str, order: str, size: str, name: str = "offset") -> DataFrame:
    """``df`` with the sum of ``size`` over the rows before, by group in order, for groups of any length.

    Rows are cut into ranges of (group, order); what a range adds to each group is summed apart.
    """
    cut = stored(df.repartitionByRange(bucket_count(df), group, order).withColumn("piece", F.spark_partition_id()), "ranges")
    totals = cut.groupBy(group, "piece").agg(F.sum(size).alias("total"))
    start = totals.withColumn("base", F.coalesce(F.sum("total").over(W.partitionBy(group).orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("total")
    within = F.coalesce(F.sum(size).over(W.partitionBy(group, "piece").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("within", within).join(start, [group, "piece"]).withColumn(name, (F.col("within") + F.col("base")).cast("bigint")).drop("within", "base", "piece")


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with its place from 1 in a total order, without sorting everything in one task.

    ``df`` is written first: the sample that cuts the ranges would compute it once more.
    """
    df = stored(df, "unranked")
    cut = stored(df.repartitionByRange(bucket_count(df), *order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()), "ranked")
    piece = F.shiftright("row", 33)
    sizes = {r.p: r.n for r in cut.groupBy(piece.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row a partition
    total, base = 0, []
    for p in range(max(sizes, default=-1) + 1):
        base.append(total)
        total += sizes.get(p, 0)
    start = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in base or [0]]), (piece + 1).cast("int"))
    return cut.withColumn(name, (F.col("row").bitwiseAND(F.lit((1 << 33) - 1)) + start + 1).cast("bigint")).drop("row")
