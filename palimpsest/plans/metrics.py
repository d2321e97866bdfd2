"""How well a reconstruction agrees with the truth: orders by inversions, clusters by contingency counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.profile import round4
from ..storage import bucket_count, stored

PIECES = 2048  # ranges of each order: their contingency table reaches the driver


def weighted_inversions(rank: np.ndarray, weight: np.ndarray) -> int:
    """Sum of w_i w_j over i < j with rank_i > rank_j, bit by bit of the ranks from the highest."""
    if not len(rank):
        return 0
    total, bits = 0, max(1, int(rank.max()).bit_length())
    for bit in range(bits - 1, -1, -1):
        above = rank >> (bit + 1)
        order = np.argsort(above, kind="stable")
        high, w, group = (rank[order] >> bit) & 1, weight[order], above[order]
        ones = np.cumsum(w * high)
        begin = np.searchsorted(group, group)
        before = ones - np.where(begin > 0, ones[begin - 1], 0)
        total += int((w * before)[high == 0].sum())
    return total


def discordant(rows: DataFrame, a: str, b: str) -> int:
    """Pairs of rows in which a and b rise in opposite directions; equal values make none.

    Rows equal in both are one with its number.  They are cut into ranges by (a, b) and by (b, a): a pair
    within one range of the second order is counted there, one within a range of the first by the ranges
    of the second, all others from the table of both ranges.
    """
    pairs = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("w"))
    n = min(PIECES, bucket_count(pairs))
    one = stored(pairs.repartitionByRange(n, "a", "b").withColumn("piece", F.spark_partition_id().cast("long")), "pieces")
    two = stored(one.repartitionByRange(n, "b", "a").withColumn("bucket", F.spark_partition_id().cast("long")), "buckets")

    def counted(by: str):
        """Of each group the pairs inverted in rank, rows in the order of (a, b)."""

        def run(batches):
            parts = [b for b in batches if b.num_rows]
            if parts:
                t = pa.Table.from_batches(parts)
                key, rank, w = (t[c].to_numpy() for c in (by, "rank", "w"))
                edge = np.append(np.flatnonzero(np.diff(key, prepend=key[0] - 1)), len(key))
                total = sum(weighted_inversions(rank[x:y], w[x:y]) for x, y in zip(edge[:-1], edge[1:], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([str(total)])], names=["n"])

        return run

    from pyspark.sql import Window as W

    # within a range of (b, a), rows have distinct places in that order
    placed = two.withColumn("rank", (F.row_number().over(W.partitionBy("bucket").orderBy("b", "a")) - 1).cast("long"))
    inside = placed.repartition(n, "bucket").sortWithinPartitions("bucket", "a", "b").select("bucket", "rank", "w").mapInArrow(counted("bucket"), "n string")
    across = two.withColumn("rank", F.col("bucket")).repartition(n, "piece").sortWithinPartitions("piece", "a", "b").select("piece", "rank", "w").mapInArrow(counted("piece"), "n string")
    total = int(inside.unionByName(across).agg(F.sum(F.col("n").cast("decimal(38,0)"))).first()[0] or 0)
    table = two.groupBy("piece", "bucket").agg(F.sum("w").alias("w")).collect()  # PIECES * PIECES at most
    if table:
        size = sum(r.w for r in table)
        m = np.zeros((max(r.piece for r in table) + 1, max(r.bucket for r in table) + 1), np.int64 if size < 3 * 10**9 else object)
        for r in table:
            m[r.piece, r.bucket] = r.w
        below = np.cumsum(m, axis=1) - m  # of a piece, what is in lesser buckets
        later = np.cumsum(below[::-1], axis=0)[::-1] - below
        total += int((m * later).sum())
    return total


def order_agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """pairs, concordant, discordant, tied, tau (Kendall's tau-b, 0 where an order has one value only) of two orders of the rows."""
    spark = rows.sparkSession
    rows = stored(rows.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null"), "orders")
    two = lambda n: n * (n - 1) // 2
    ties = lambda *c: int(rows.groupBy(*c).agg(F.count("*").cast("decimal(38,0)").alias("n")).agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0)
    n = rows.count()
    ta, tb, both, wrong = ties("a"), ties("b"), ties("a", "b"), discordant(rows, "a", "b")
    pairs = two(n)
    right = pairs - ta - tb + both - wrong
    scale = float((pairs - ta) * (pairs - tb)) ** 0.5
    out = spark.createDataFrame([(pairs, right, wrong, pairs - right - wrong, (right - wrong) / scale if scale else 0.0)], "pairs long, concordant long, discordant long, tied long, tau double")
    return out.withColumn("tau", round4(F.col("tau")))


def cluster_agreement(rows: DataFrame, truth: str, found: str) -> DataFrame:
    """items, adjusted_rand, b3_precision, b3_recall, b3_f1 of two labellings (nulls are a label of their own)."""
    cell = rows.groupBy(F.col(truth).alias("t"), F.col(found).alias("f")).agg(F.count("*").cast("double").alias("n"))
    cell = stored(cell, "contingency")
    row, col = cell.groupBy("t").agg(F.sum("n").alias("tn")), cell.groupBy("f").agg(F.sum("n").alias("fn"))
    two = lambda c: F.coalesce(F.sum(c * (c - 1) / 2), F.lit(0.0))
    joined = cell.join(row.withColumnRenamed("t", "t2"), F.col("t").eqNullSafe(F.col("t2"))).join(col.withColumnRenamed("f", "f2"), F.col("f").eqNullSafe(F.col("f2")))
    n = F.col("n")
    cells = joined.agg(two(n).alias("both"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("items"), F.sum(n * n / F.col("fn")).alias("p"), F.sum(n * n / F.col("tn")).alias("r"))
    rows_, cols = row.agg(two(F.col("tn")).alias("a")), col.agg(two(F.col("fn")).alias("b"))
    one = cells.withColumn("k", F.lit(1)).join(rows_.withColumn("k", F.lit(1)), "k").join(cols.withColumn("k", F.lit(1)), "k")  # a row each
    chance = F.col("a") * F.col("b") / (F.col("items") * (F.col("items") - 1) / 2)
    most = (F.col("a") + F.col("b")) / 2
    rand = F.when(F.col("items") < 2, 1.0).when(most == chance, 1.0).otherwise((F.col("both") - chance) / (most - chance))
    p, r = F.coalesce(F.col("p") / F.col("items"), F.lit(0.0)), F.coalesce(F.col("r") / F.col("items"), F.lit(0.0))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return one.select(F.col("items").cast("long").alias("items"), round4(rand).alias("adjusted_rand"), round4(p).alias("b3_precision"), round4(r).alias("b3_recall"), round4(f1).alias("b3_f1"))
