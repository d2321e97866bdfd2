"""Hard negatives against every anchor with every row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<double>, score double, rank string"


def brute(rows, k=5, n=5, band=(80, 100), every=100):
    """Rows of (id, label, vector of whole numbers); order in the list tells rows of one id apart."""
    use = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None for x in r[2])]
    dim = max((len(r[2]) for r in use), default=0)
    m = np.array([list(r[2]) + [0] * (dim - len(r[2])) for r in use], dtype=object).reshape(len(use), dim)
    out = []
    for a, (id_, label, _) in enumerate(use):
        if id_ % every:
            continue
        score = [int(sum(x * y for x, y in zip(m[a], m[b], strict=True))) for b in range(len(use))]
        order = sorted((b for b in range(len(use)) if b != a), key=lambda b: (-score[b], use[b][0]))
        for p in [b for b in order if use[b][1] == label][:k]:
            bad = [b for b in order if use[b][1] != label and band[0] * score[p] <= 100 * score[b] <= band[1] * score[p]][:n]
            out += [(id_, use[p][0], r, use[b][0], score[p], score[b]) for r, b in enumerate(bad, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(i, lab, v, 0.5, "x") for i, lab, v in rows], SCHEMA).withColumn("embedding", negatives.quantized(F.col("embedding")))
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 100 == 0, **options).collect())


def floors(rows):
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    return [(i, lab, [int(np.floor(256 * x)) for x in v] if ok(v) else None) for i, lab, v in rows]


def around(rng, centres, n, spread):
    return [(int(i), int(rng.integers(0, 4)), (centres[rng.integers(0, len(centres))] + rng.normal(0, spread, centres.shape[1])).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_equals_brute_force(spark, monkeypatch, spread):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(negatives, "CELL_ANCHORS", 2)
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    monkeypatch.setattr(negatives, "SALT_ROWS", 200)
    monkeypatch.setattr(negatives, "SAMPLE", 50)
    rows = around(rng, rng.normal(0, 1, (5, 6)), 900, spread)
    assert mined(spark, rows) == brute(floors(rows))


def test_a_cell_gets_only_rows_that_it_might_serve(spark):
    rng = np.random.default_rng(4)
    rows = around(rng, np.eye(6) * 4, 3000, 0.02)
    df = spark.createDataFrame([(i, lab, [int(256 * x) for x in v]) for i, lab, v in rows], "id long, label long, v array<long>").withColumn("row", F.monotonically_increasing_id())
    df = df.withColumn("square", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    anchors = df.where("id % 100 = 0")
    pivots = np.array([r.v for r in anchors.orderBy("id").limit(12).collect()], np.int64)
    blocks = negatives._blocks(anchors, pivots, 6, 5, negatives._sample(df, 6))
    largest = df.agg(F.max("square")).first()[0]
    pairs = negatives._served(df, blocks, pivots, 6, largest)
    met = sum(len(r.rows) // 8 * (len(r.x_rows) // 8) for r in pairs.collect())
    assert met < 0.5 * 30 * 3000


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 0.5, 0.25]
    rows = [(0, 1, one), (0, 1, one), (100, 1, one), (1, 1, one), (2, 2, one), (3, 2, one), (3, 2, one), (4, 1, [1.0]), (5, 2, [1.0, 0.5]), (6, 1, []), (7, None, one), (8, 1, None), (None, 1, one), (9, 1, [None, 1.0, 1.0]), (10, 2, [nan, 1.0, 1.0]), (11, 2, [inf, 0.0, 0.0]), (200, 3, [-1.0, 0.0, 0.0]), (300, 4, [0.0, 0.0, 0.0]), (12, 4, [0.0, 0.0, 0.0]), (13, 3, [1.0, 0.1, 0.1])]
    assert mined(spark, rows) == brute(floors(rows))
    ties = [(i, i % 2, one) for i in range(0, 400)]
    assert mined(spark, ties) == brute(floors(ties))
    assert mined(spark, []) == [] and mined(spark, [(1, 1, one)]) == [] and mined(spark, [(0, 1, one)]) == []


def test_every_row_in_the_sample(spark):
    rng = np.random.default_rng(9)
    rows = around(rng, rng.normal(0, 1, (3, 5)), 500, 0.3)
    assert mined(spark, rows, positives=3, negatives=2) == brute(floors(rows), 3, 2)


def test_large_numbers_stay_exact(spark):
    big = 1 << 28
    rows = [(i, i % 2, [big + i, big - 3 * i, 7]) for i in range(0, 320, 5)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<long>")
    assert sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 100 == 0).collect()) == brute(rows)
