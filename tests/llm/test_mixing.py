"""The mix: targets against a plain water level, totals, bounds, fairness of the flight."""

import random

import numpy as np
import pytest

from palimpsest.llm import mixing

SCHEMA = "doc_id long, text string, source string, size double, target string, copies int"


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, free = share * sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(out.values())) / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > cap * sizes[s]}
        if not over:
            return out | {s: w[s] * level for s in free}
        out |= {s: cap * sizes[s] for s in over}
        free -= over
    return out


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(8)
    rows = []
    for i in range(3000):
        n = rng.choice([0, 1, 3, 20, 50, 90]) if rng.random() < 0.98 else 2000
        source = rng.choice(["b", "b", "b", "b", "a", "Z", "é", None, "", "c"])
        rows.append((i, " ".join(["w"] * n) if n else rng.choice(["", None, " \t"]), source))
    return rows


def framed(spark, rows):
    return spark.createDataFrame([(i, t, s, 0.1, "t", 3) for i, t, s in rows], SCHEMA)


def check(rows, got):
    size = lambda t: len((t or "").split())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size) for r in got) == sorted((i if i is not None else -1, size(t)) for i, t, _ in rows)
    by, taken = {}, {}
    for _, t, s in rows:
        by[s] = by.get(s, 0) + size(t)
    want = targets(by)
    for r in got:
        assert r.source_size == by[r.source] and r.target == pytest.approx(want[r.source])
        ratio = want[r.source] / by[r.source] if by[r.source] else 0
        assert r.copies in (int(ratio + 1e-9), int(np.ceil(ratio - 1e-9))) and r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    return want, taken


def test_targets_and_totals(spark, docs):
    df = framed(spark, docs)
    got = mixing.mix(df).collect()
    want, taken = check(docs, got)
    for s in want:
        assert abs(taken[s] - want[s]) <= 10, s
    again = mixing.mix(df.repartition(7, "size")).collect()
    assert sorted(got) == sorted(again) or {tuple(r) for r in got} == {tuple(r) for r in again}


def test_rounds_of_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 50)
    monkeypatch.setattr(mixing, "WAITING", 300)
    monkeypatch.setattr(mixing, "CHUNK", 2)
    monkeypatch.setattr(mixing, "SENT_SOURCES", 2)
    rows = docs + [(None, "a b c", "b")] * 40 + [(5, "x y", "c")] * 30
    want, taken = check(rows, mixing.mix(framed(spark, rows)).collect())
    for s in want:
        assert abs(taken[s] - want[s]) <= 10, s


def test_odd_tables(spark):
    assert mixing.mix(framed(spark, [])).collect() == []
    for rows in ([(1, "a b", "x")], [(1, None, None)], [(None, "a", None), (None, "a", None)], [(1, "", "x"), (2, "a b c", "y")], [(7, "a", "x")] * 5):
        check(rows, mixing.mix(framed(spark, rows)).collect())
    [one] = mixing.mix(framed(spark, [(1, "word " * 500_000, "x")])).collect()
    assert one.size == 500_000 and one.target == 750_000 and one.taken in (500_000, 1_000_000)


def test_flight_keeps_totals_and_is_fair():
    rng = np.random.default_rng(1)
    p, size = rng.random(40), rng.integers(1, 500, 40).astype(float)
    total = np.zeros(40)
    for k in range(3000):
        q = mixing.flight(p, size, np.random.default_rng(k))
        assert ((q > 0) & (q < 1)).sum() <= 2
        assert q.sum() == pytest.approx(p.sum()) and q @ size == pytest.approx(p @ size)
        total += q
    assert np.abs(total / 3000 - p).max() < 0.05
    size[0] = 4000
    total = np.zeros(40)
    for k in range(1000):
        q = mixing.descent(p, size, np.random.default_rng(k))
        assert ((q > 0) & (q < 1)).sum() <= mixing.LANDING
        assert q.sum() == pytest.approx(p.sum()) and q @ size == pytest.approx(p @ size)
        total += q
    assert np.abs(total / 1000 - p).max() < 0.08
    same = mixing.descent(np.full(30, 0.5), np.full(30, 7.0), np.random.default_rng(0))
    assert same.sum() == pytest.approx(15)


def test_landing_is_the_nearest_subset():
    p, size = np.array([0.5, 0.25, 0.75]), np.array([10.0, 20.0, 8.0])
    assert mixing.landing(p, size).tolist() == [1.0, 0.0, 1.0] or abs(mixing.landing(p, size) @ size - p @ size) <= 2


def test_mixed_documents(spark, docs):
    rows = docs[:400] + [(None, "a b c", "b")] * 7
    df = framed(spark, rows)
    got = mixing.mixed(df)
    assert got.columns == df.columns
    words = {}
    for r in mixing.mix(df).collect():
        words[r.source] = words.get(r.source, 0) + r.taken
    found = {}
    for r in got.collect():
        found[r.source] = found.get(r.source, 0) + len((r.text or "").split())
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in found.items() if n}
