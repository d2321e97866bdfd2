"""Orders of texts: the best order by dynamic programming over subsets, and orders from outside as relational division."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reassemble import transition

LONGEST = 12


def best_order(offsets: list[int], texts: list[str]) -> tuple[list[int], float, int]:
    """Places in the best order, its score, and how many orders reach it; ties go to the order that is last by offsets, then places.

    For each subset and last text the best score, the number of orders that reach it and the last of
    these: n^2 2^n steps instead of n! orders.  Places are ranks by (offset, place).
    """
    n = len(texts)
    if n == 0:
        return [], 0.0, 1
    by = sorted(range(n), key=lambda i: (offsets[i], i))
    step = np.array([[transition(texts[i], texts[j], offsets[i], offsets[j]) if i != j else -np.inf for j in by] for i in by])
    full = 1 << n
    # orders are kept from their last text backwards, so that the greater first place decides: best[m, i] starts with i and holds the set m
    score, ways, after = np.full((full, n), -np.inf), np.zeros((full, n)), np.full((full, n), -1)
    for i in range(n):
        score[1 << i, i], ways[1 << i, i] = 0.0, 1
    for m in range(1, full):
        inside = [i for i in range(n) if m >> i & 1]
        if len(inside) < 2:
            continue
        for i in inside:
            rest = m & ~(1 << i)
            total = step[i] + score[rest]
            best = total.max()
            tied = np.flatnonzero(total >= best - 1e-6)
            score[m, i], ways[m, i], after[m, i] = best, ways[rest, tied].sum(), tied[-1]
    best = score[full - 1].max()
    tied = np.flatnonzero(score[full - 1] >= best - 1e-6)
    out, m, i = [], full - 1, int(tied[-1])
    while i >= 0:
        out.append(by[i])
        m, i = m & ~(1 << i), int(after[m, i])
    return out, float(best), int(ways[full - 1, tied].sum())


def best_orders(members: DataFrame, group: str, offset: str, text: str, longest: int = LONGEST) -> DataFrame:
    """group, offsets in the best order, score, orders that reach it, for groups of up to ``longest`` texts; null texts are empty.

    Groups are counted first, so a longer one is never gathered; of one offset the lesser text comes first.
    """
    rows = members.select(F.col(group).alias("group"), F.col(offset).cast("long").alias("offset"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("offset is not null")
    small = rows.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") <= longest)
    whole = rows.join(small.select(F.col("group").alias("_g")), F.col("group").eqNullSafe(F.col("_g")), "left_semi").groupBy("group").agg(F.sort_array(F.collect_list(F.struct("offset", "text"))).alias("texts"))  # ``longest`` at most

    def run(batches):
        for df in batches:
            out = []
            for g, texts in zip(df["group"], df["texts"], strict=True):
                offsets = [int(t["offset"]) for t in texts]
                order, score, ties = best_order(offsets, [t["text"] for t in texts])
                out.append((g, [offsets[i] for i in order], score, ties))
            yield pd.DataFrame(out, columns=["group", "offsets", "score", "ties"])

    kind = rows.schema["group"].dataType.simpleString()
    return whole.mapInPandas(run, f"group {kind}, offsets array<long>, score double, ties long")


def divided(proposals: DataFrame, members: DataFrame) -> DataFrame:
    """group, accepted, reason of each proposed order: (group, place, id) against the members (group, id).

    An order is accepted if it names exactly the members, each once: a relational division by
    counts, in one aggregation over names and members together.  The first reason that holds is
    given: no order, a repeated id, an unknown id, a missing one, with how many there are.
    """
    named = proposals.select("group", "id", F.lit(1).alias("named"), F.lit(0).alias("member"))
    there = members.select("group", "id", F.lit(0).alias("named"), F.lit(1).alias("member"))
    each = named.unionByName(there).groupBy("group", "id").agg(F.sum("named").alias("named"), F.max("member").alias("member"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    known = (F.col("member") == 1) & F.col("id").isNotNull()
    whole = each.groupBy("group").agg(F.sum("named").alias("names"), n(F.col("named") > 1)("repeated"), n((F.col("named") > 0) & ~known)("unknown"), n((F.col("named") == 0) & known)("missing"))
    why = (
        F.when(F.col("names") == 0, "no order given")
        .when(F.col("repeated") > 0, F.format_string("%d repeated", "repeated"))
        .when(F.col("unknown") > 0, F.format_string("%d unknown", "unknown"))
        .when(F.col("missing") > 0, F.format_string("%d missing", "missing"))
        .otherwise("")
    )
    return whole.select("group", (why == "").alias("accepted"), why.alias("reason"))


def external_order(proposals: DataFrame, members: DataFrame) -> DataFrame:
    """group, id, place of all members: by the proposed order where it is accepted, else by offset and id."""
    from pyspark.sql import Window as W

    taken = divided(proposals, members).where("accepted").select("group")
    told = proposals.join(taken, "group", "left_semi").select("group", "id", F.col("place").cast("long").alias("at"))
    rest = members.join(taken, "group", "left_anti").select("group", "id", F.col("offset").cast("long").alias("at"))
    by = W.partitionBy("group").orderBy("at", "id")
    return told.unionByName(rest).withColumn("place", F.row_number().over(by).cast("long")).drop("at")
