"""As-of join, agreement of orders and clusters, best orders, orders from outside: against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import asof, orders, reassemble
from palimpsest.plans import metrics


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("by", [(), ("k",)])
def test_asof(spark, by, strict):
    rng = random.Random(4)
    left = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([*range(300), None])) for i in range(200)]
    right = [(i, rng.choice(["a", "a", "b", "c", None]), rng.choice([*range(0, 300, 3), None])) for i in range(150)]
    a, b = spark.createDataFrame(left, "id long, k string, t long"), spark.createDataFrame(right, "id long, k string, t long")
    got = {r.id: r.before for r in asof.asof(a.repartition(5), b, "t", by, {"id": "before"}, tie="id", strict=strict).collect()}
    want = {}
    for i, k, t in left:
        some = [(u, j) for j, m, u in right if u is not None and t is not None and (not by or m == k) and (u < t or (u == t and not strict))]
        want[i] = max(some)[1] if some else None
    assert got == want
    none = asof.asof(a, b.where("id < 0"), "t", by, {"id": "before"})
    assert none.where("before is not null").count() == 0 and none.count() == 200
    assert asof.asof(a.where("id < 0"), b, "t", by).count() == 0


def test_weighted_inversions():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 200):
        rank, w = rng.integers(0, max(1, n // 2 + 1), n), rng.integers(1, 5, n)
        want = sum(int(w[i] * w[j]) for i in range(n) for j in range(i + 1, n) if rank[i] > rank[j])
        assert metrics.weighted_inversions(rank, w) == want


@pytest.mark.parametrize("values", [4, 60])
def test_order_agreement(spark, values):
    rng = random.Random(values)
    rows = [(rng.randrange(values), rng.randrange(values)) for _ in range(250)] + [(2, 2)] * 100 + [(None, 1), (1, None)]
    got = metrics.order_agreement(spark.createDataFrame(rows, "a long, b long"), "a", "b").first()
    pairs = list(itertools.combinations([r for r in rows if None not in r], 2))
    sign = [((x[0] > y[0]) - (x[0] < y[0])) * ((x[1] > y[1]) - (x[1] < y[1])) for x, y in pairs]
    assert (got.pairs, got.concordant, got.discordant, got.tied) == (len(pairs), sign.count(1), sign.count(-1), sign.count(0))
    na, nb = sum(x[0] != y[0] for x, y in pairs), sum(x[1] != y[1] for x, y in pairs)
    assert got.tau == pytest.approx((sign.count(1) - sign.count(-1)) / (na * nb) ** 0.5, abs=1e-4)
    none = metrics.order_agreement(spark.createDataFrame([], "a long, b long"), "a", "b").first()
    assert (none.pairs, none.tau) == (0, 0.0)


def test_cluster_agreement(spark):
    rows = [("x", 1)] * 4 + [("x", 2)] * 2 + [("y", 2)] * 3 + [(None, None)] * 2 + [("z", None)]
    got = metrics.cluster_agreement(spark.createDataFrame(rows, "t string, f int"), "t", "f").first()
    pairs = list(itertools.combinations(rows, 2))
    a, b, both = (sum(c) for c in zip(*((x[0] == y[0], x[1] == y[1], x == y) for x, y in pairs), strict=True))
    chance = a * b / len(pairs)
    assert got.adjusted_rand == pytest.approx((both - chance) / ((a + b) / 2 - chance), abs=1e-4)
    p = np.mean([sum(x == y for y in rows) / sum(x[1] == y[1] for y in rows) for x in rows])
    r = np.mean([sum(x == y for y in rows) / sum(x[0] == y[0] for y in rows) for x in rows])
    assert (got.items, got.b3_precision, got.b3_recall) == (12, pytest.approx(p, abs=1e-4), pytest.approx(r, abs=1e-4))
    same = metrics.cluster_agreement(spark.createDataFrame([("x", 1), ("y", 2)], "t string, f int"), "t", "f").first()
    assert same.adjusted_rand == 1.0
    assert metrics.cluster_agreement(spark.createDataFrame([], "t string, f int"), "t", "f").first().items == 0


TEXTS = ["The start.", "and then", "goes on,", "Where next?", "Here\n", "", "  so it ends", "Újra", "x1 "]


def brute(offsets, texts):
    n = len(texts)
    by = sorted(range(n), key=lambda i: (offsets[i], i))
    step = [[reassemble.transition(texts[i], texts[j], offsets[i], offsets[j]) for j in by] for i in by]
    scored = [(sum(step[i][j] for i, j in itertools.pairwise(p)), p) for p in itertools.permutations(range(n))]
    best = max(scored)
    return [by[i] for i in best[1]], best[0], sum(s == best[0] for s, _ in scored)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 7])
def test_best_order_equals_all_orders(n):
    rng = random.Random(n)
    for _ in range(6):
        texts = [rng.choice(TEXTS) for _ in range(n)]
        offsets = [rng.randrange(20) for _ in range(n)]
        order, score, ties = orders.best_order(offsets, texts)
        want = brute(offsets, texts) if n else ([], 0.0, 1)
        assert (order, score, ties) == (want[0], pytest.approx(want[1]), want[2])


def test_best_order_of_nine_texts():
    texts, offsets = TEXTS, [5, 1, 9, 2, 8, 3, 7, 4, 6]
    assert orders.best_order(offsets, texts) == brute(offsets, texts)


def test_best_orders(spark):
    rows = [("g", i, t) for i, t in enumerate(TEXTS[:6])] + [("long", i, "x") for i in range(13)] + [(None, 1, None), (None, 1, "a"), ("h", None, "b")]
    got = {r.group: r for r in orders.best_orders(spark.createDataFrame(rows, "g string, o long, t string"), "g", "o", "t").collect()}
    assert set(got) == {"g", None}
    order, score, ties = reassemble.text_order([str(i) for i in range(6)], list(range(6)), TEXTS[:6])
    assert (got["g"].offsets, got["g"].score, got["g"].ties) == (order, score, ties) and got[None].ties >= 1
    assert orders.best_orders(spark.createDataFrame([], "g string, o long, t string"), "g", "o", "t").count() == 0


def test_orders_from_outside(spark):
    members = [(g, i, 10 * i) for g in ("ok", "twice", "lost", "new", "none") for i in range(4)]
    given = [("ok", 4 - i, i) for i in range(4)] + [("twice", i, i % 3) for i in range(4)] + [("lost", i, i) for i in range(3)] + [("new", i, i + 1) for i in range(4)] + [("ghost", 0, 1), ("new", 9, None)]
    m, p = spark.createDataFrame(members, "group string, id long, offset long"), spark.createDataFrame(given, "group string, place long, id long")
    got = {r.group: (r.accepted, r.reason) for r in orders.divided(p, m).collect()}
    assert got == {"ok": (True, ""), "twice": (False, "1 repeated"), "lost": (False, "1 missing"), "new": (False, "2 unknown"), "none": (False, "no order given"), "ghost": (False, "1 unknown")}
    placed = {}
    for r in orders.external_order(p, m).orderBy("group", "place").collect():
        placed.setdefault(r.group, []).append(r.id)
    assert placed == {"ok": [3, 2, 1, 0]} | {g: [0, 1, 2, 3] for g in ("twice", "lost", "new", "none")}
    assert orders.divided(p, m.where(F.lit(False))).where("accepted").count() == 0
