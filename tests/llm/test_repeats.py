"""Substring and suffix deduplication against brute force."""

import hashlib
import re
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest

from palimpsest.llm import anchors, substring, suffix

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_words(docs, window=50):
    words = [(i, WORD.findall((t or "").encode())) for i, t in docs]
    seen = {}
    for i, w in words:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            seen[k] = min(seen.get(k, 1 << 70), 1 << 60 if i is None else i)
    out = []
    for i, w in words:
        gone = bytearray(len(w))
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] < (1 << 60 if i is None else i):
                gone[p : p + window] = b"\1" * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(docs, window=200):
    data = [(i, (t or "").encode()) for i, t in docs]
    count = Counter(x[p : p + window] for _, x in data for p in range(len(x) - window + 1))
    out = []
    for i, x in data:
        gone = bytearray(len(x))
        for p in range(len(x) - window + 1):
            if count[x[p : p + window]] > 1:
                gone[p : p + window] = b"\1" * window
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(x), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", ["frame", "odd", "nothing"])
def test_words(name, request):
    df = request.getfixturevalue(name)
    assert rows(substring.remove_digests(df)) == brute_words(pairs(df))


@pytest.mark.parametrize("name", ["frame", "odd", "nothing"])
def test_bytes(name, request):
    df = request.getfixturevalue(name)
    assert rows(suffix.remove_digests(df)) == brute_bytes(pairs(df))


@pytest.mark.parametrize("window", [1, 5, 200])
def test_other_windows_of_words(frame, window):
    assert rows(substring.remove_digests(frame, window)) == brute_words(pairs(frame), window)


@pytest.mark.parametrize("window", [20, 400, 600])
def test_other_windows_of_bytes(frame, window):
    assert rows(suffix.remove_digests(frame, window)) == brute_bytes(pairs(frame), window)


def test_heavy_prefixes(frame, monkeypatch):
    """Prefixes with more surroundings than the bound are made longer, up to the whole window; nothing changes."""
    for module in (substring, suffix):
        monkeypatch.setattr(module, "kind_of", lambda window, old=module.kind_of: replace(old(window), heavy=1))
    assert rows(substring.remove_digests(frame)) == brute_words(pairs(frame))
    assert rows(suffix.remove_digests(frame)) == brute_bytes(pairs(frame))


def test_prefix_grows_to_the_window():
    for kind in (suffix.kind_of(), substring.kind_of()):
        seen = [kind.prefix]
        while kind.reach:
            kind = kind.longer()
            seen.append(kind.prefix)
        assert seen == sorted(set(seen)) and seen[-1] == kind.window


def test_denser_suffixes_serve_the_same_windows():
    at, near, far = np.array([500, 900]), np.array([0, 40]), np.array([128, 77])
    a, lo, hi = anchors.denser(at, near, far, 17)
    want = sorted(p - d for p, n, f in zip(at, near, far, strict=True) for d in range(n, f + 1))
    assert sorted(p - d for p, n, f in zip(a, lo, hi, strict=True) for d in range(n, f + 1)) == want and hi.max() < 17


def test_periodic_texts_are_sent_as_strides():
    uid, place = np.repeat([1, 2], [6, 3]), np.array([0, 2, 4, 6, 8, 9, 0, 5, 10])
    zero = np.zeros(9, np.int64)
    u, p, _, _, _, step, n = anchors._strides(uid, place, zero, zero, zero)
    back = [(x, y + s * k) for x, y, s, m in zip(u.tolist(), p.tolist(), step.tolist(), n.tolist(), strict=True) for k in range(m)]
    assert back == list(zip(uid.tolist(), place.tolist(), strict=True)) and len(u) < 9


def test_all_that_is_removed_comes_from_the_merge_and_the_subtrees(frame, monkeypatch):
    """Without what they return nothing is removed."""
    monkeypatch.setattr(suffix, "_resolve", lambda asked, docs, kind, buckets: asked.selectExpr("uid", "begin", "begin as stop").limit(0))
    monkeypatch.setattr(substring, "_resolve", lambda asked, docs, kind, buckets: asked.selectExpr("uid", "begin", "begin as stop").limit(0))
    assert suffix.remove_digests(frame).where("n_removed > 0").isEmpty() and substring.remove_digests(frame).where("n_removed > 0").isEmpty()


def test_small_pieces():
    """Anchors of a text cut into pieces serve each window exactly once, and equal windows get equal keys."""
    kind = suffix.kind_of()
    data = np.frombuffer(b"".join(bytes([65 + i * i % 23]) for i in range(5000)), np.uint8)
    old = anchors.PIECE
    try:
        for anchors.PIECE in (700, 1 << 18):
            values, first = kind.tokens(data, np.array([0, 3000, 5000]))
            row, place, near, far, key, ctx = anchors.find_anchors(values, first, kind)
            starts = sorted((int(r), int(p - d)) for r, p, a, b in zip(row, place, near, far, strict=True) for d in range(a, b + 1))
            assert starts == [(0, i) for i in range(2801)] + [(1, i) for i in range(1801)]
    finally:
        anchors.PIECE = old


def test_text_form_keeps_columns(frame):
    out = substring.remove(frame)
    assert out.columns == frame.columns
    got = {r.doc_id: r.text for r in out.collect()}
    want = {i: (n, g) for i, n, g, _ in brute_words(pairs(frame))}
    for i, t in pairs(frame):
        assert (got[i] == t) == (want[i][1] == 0)


def test_loser_tree_sorts_and_tells_shared_prefixes():
    rng = np.random.default_rng(1)
    runs, every = [], []
    for k in range(7):
        a = rng.integers(97, 99, (rng.integers(0, 40), 12)).astype(np.uint8)
        a = a[suffix.sort_rows(a)]
        every += [x.tobytes() for x in a]
        n = len(a)
        z = np.zeros(n)
        runs.append(suffix.Run(suffix.front_coded(a, *(z.astype(t) for t in suffix._META), np.zeros((n, 3), np.uint8)), 3))
    got = [lcp for _, lcp in suffix.merge(runs)]
    want = sorted(every)
    shared = [0] + [next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), 12) for a, b in zip(want, want[1:], strict=False)]
    assert got == shared
