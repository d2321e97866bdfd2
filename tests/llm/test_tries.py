"""The prefix trie against plain dictionaries of prefixes."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from palimpsest.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string, depth string, key long"


def digest(role, text):
    r, t = (role or "").encode(), (text or "").encode()
    return hashlib.sha256(str(len(r)).encode() + b":" + r + t).digest()[:16]


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest(role, text), role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(x, key=lambda y: y[:3])] for c, x in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    out, done = [], {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves = sum(done[k][0] for k in below) or 1
        saved = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(done[k][1] for k in below)
        done[p] = leaves, saved
        ends = ",".join(str(c) for c in sorted(members[p]) if len(built[c]) == len(p))
        up = min(members[p[:-1]]) if p else None
        out.append((min(members[p]), len(p), up, len(members[p]), len(below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def made(spark, rows, **options):
    df = spark.createDataFrame([(*r, "d", 1) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in tries.nodes(df, **options).collect()), key=repr)


def talk(rng, n):
    rows = []
    for c in rng.sample(range(3 * n), n):
        for t in range(rng.randint(1, 9)):
            if rng.random() < 0.4:
                text = "common" if t < 5 else "end"
            else:
                text = rng.choice(["a", "b", "", None, "é", "x" * 40])
            rows.append((c, rng.choice([t, t, t, None]) if rng.random() < 0.1 else t, rng.choice(["user", "user", None, "assistant"]), text))
    return rows


@pytest.mark.parametrize("heavy", [4096, 20])
def test_equals_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(tries, "HEAVY_MEMBERS", 3)
    monkeypatch.setattr(tries, "SHARD_TURNS", 50)
    monkeypatch.setattr(tries, "ENDS", 3)
    rng = random.Random(6)
    rows = talk(rng, 400)
    rows += [(5000 + c, t, "user", "same") for c in range(0, 300) for t in range(4)]  # one conversation many times
    rows += [(9000 + c, t, "user", "same" if t < 2 else str(c)) for c in range(0, 200) for t in range(5)]
    rng.shuffle(rows)
    assert made(spark, rows, heavy=heavy) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (3, None, None, None), (3, None, None, None), (3, 1, "user", ""), (0, 7, None, "zero"), (-4, 0, "user", "below"), (-5, 0, "user", "base"), (12, 1, "user", "only"), (12, 1, "user", "only"), (1 << 40, 0, "user", "far")]
    assert made(spark, rows) == brute(rows)
    assert made(spark, []) == [] and made(spark, [(None, None, None, None)]) == []
    long = [(10, t, "user", str(t)) for t in range(30_000)] + [(11, 0, "user", "y" * 5_000_000)]
    got = made(spark, long)
    assert len(got) == len(brute(long[:0] + [(10, t, "user", str(t)) for t in range(0)])) + len({(r[0], r[1]) for r in got}) and max(r[1] for r in got) == 30_000


def test_louds_round_trip():
    rng = np.random.default_rng(2)
    parent = np.array([0, 0, 0, 1, 1, 3, 3, 3, 5, 8])  # of nodes 1 to 10, in level order
    degrees = np.bincount(parent, minlength=11)
    t = tries.Louds(degrees)
    assert t.parents().tolist() == parent.tolist() and t.degrees().tolist() == degrees.tolist()
    degrees = rng.integers(0, 3, 50)
    degrees[:5] = 3
    nodes = 1 + np.cumsum(degrees)
    cut = int(np.argmax(nodes <= np.arange(1, 51))) if (nodes <= np.arange(1, 51)).any() else 50
    t = tries.Louds(degrees[:cut])
    assert t.degrees().tolist() == degrees[:cut].tolist()
