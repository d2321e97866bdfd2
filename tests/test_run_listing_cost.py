"""What a listing of a run holds at once: no table of islands, ranked rows without what follows from their key, vectors before orders."""

import random

import pytest

from palimpsest import queries, storage
from palimpsest.operators import intervals

SF = "/root/testdata/sf0.001"


def _brute(rows):
    """(group, begin, stop, first_id, last_id) of islands, read one by one."""
    found = []
    for group, begin, n, id_ in sorted((r for r in rows if r[2] > 0), key=lambda r: (r[0], r[1], r[3])):
        if found and found[-1][0] == group and begin <= found[-1][2]:
            found[-1][2], found[-1][4] = max((found[-1][2], found[-1][4]), (begin + n, id_))
        else:
            found.append([group, begin, begin + n, id_, id_])
    return sorted(map(tuple, found))


@pytest.mark.parametrize("buckets", [None, 9])
def test_islands_equal_brute_force_and_hash_nothing(spark, buckets):
    rng = random.Random(5)
    rows = [(g, (0 if rng.random() < 0.5 else intervals.STRETCH - 20) + rng.randrange(60), rng.randrange(-1, 9), k) for g in range(6) for k in range(40)]
    df = spark.createDataFrame(rows, "group long, begin long, length long, id long")
    found = intervals.islands(df, buckets=buckets)
    assert sorted((r.group, r.begin, r.stop, r.first_id, r.last_id) for r in found.collect()) == _brute(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and (f", {buckets})" in plan) == (buckets is not None)
    cover = {r.group: r for r in intervals.coverage(df, buckets=buckets).collect()}
    for g in range(6):
        mine = [(b, e) for x, b, e, *_ in _brute(rows) if x == g]
        assert [tuple(r) for r in cover[g].ranges] == mine and cover[g].unique_bytes == sum(e - b for b, e in mine) and cover[g].fragments == 40


def test_intervals_without_a_begin_are_islands_of_their_own(spark):
    df = spark.createDataFrame([("g", None, 5, "a"), ("g", None, 7, "b"), ("g", 3, 4, "c"), (None, 1, 1, "d")], "group string, begin long, length long, id string")
    assert {tuple(r) for r in intervals.islands(df).collect()} == {("g", None, None, "a", "a"), ("g", None, None, "b", "b"), ("g", 3, 7, "c", "c"), (None, 1, 2, "d", "d")}


def test_vectors_come_before_orders_and_keys_make_the_rest(spark):
    queries.run_listing(spark, SF).count()
    paths = storage._STORED[spark.sparkContext.applicationId]
    names = [p.rpartition("/palimpsest-")[2].rpartition("-")[0] for p in paths]
    at = max(k for k, n in enumerate(names) if n == "members")
    assert "unranked" not in names[:at] or names[:at][::-1].index("unranked") > names[:at][::-1].index("points")
    ranked = spark.read.parquet(paths[at + 1 + names[at + 1 :].index("ranked")])
    assert not {"artifact_sha256", "categories", "sensitivity_level"} & set(ranked.columns)
    assert {"artifact_sha256", "categories", "sensitivity_level"} <= set(queries.ranked_orders(spark, SF).columns)
