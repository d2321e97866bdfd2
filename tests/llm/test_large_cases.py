"""Hot words beyond the dictionary, many heavy prefixes, many languages, texts of megabytes."""

import hashlib
import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import anchors, digest, langid, licenses, lm, simhash, substring, suffix
from palimpsest.llm.common import fold


def test_long_common_words_are_not_joined(spark, monkeypatch):
    monkeypatch.setattr(lm.LogBilinear.__init__, "__defaults__", (8, 3, *lm.LogBilinear.__init__.__defaults__[2:]))
    rule = "-" * 100
    rows = [(i, f"alpha {rule} beta {rule if i % 2 else 'gamma'} word{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = fold(F.col("doc_id"), 10) == 0
    got = {r.doc_id: r for r in lm.score(df, held).collect()}
    train = [t for i, t in rows if not got[i].held_out]
    counts = Counter(w for t in train for w in t.split())
    total, distinct = sum(counts.values()) + len(train), len(counts) + 1
    for i, t in rows:
        c = [counts[w] for w in t.split()] + [len(train)]
        assert got[i].base_score == pytest.approx(sum(np.log10((x + 0.1) / (total + 0.1 * (distinct + 1))) for x in c))
        assert got[i].n_known == sum(x > 0 for x in c)
    counted = lm.count_words(df.where(~held).select("text"))
    assert len(lm.Vocabulary(counted, len(train)).long) == 1


def test_heavy_prefixes_beyond_what_is_sent(frame, monkeypatch):
    results = []
    for sent in (anchors.SENT_KEYS, 0):
        monkeypatch.setattr(anchors, "SENT_KEYS", sent)
        for module in (suffix, substring):
            monkeypatch.setattr(module, "kind_of", lambda window, old=module.kind_of: replace(old(window), heavy=1))
        results.append((sorted(suffix.remove_digests(frame).collect()), sorted(substring.remove_digests(frame).collect())))
        monkeypatch.undo()
    assert results[0] == results[1]


@pytest.mark.parametrize("tile", [1 << 14, 40])
def test_links_by_pattern(spark, tile):
    """At a larger radius, over tiles of one pattern, whole and cut by population counts: the same components as all pairs."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = [np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, k, replace=False).astype(np.uint64)) for k in rng.integers(1, 10, 400)]
    fp = np.unique(np.concatenate([base, base[rng.integers(0, 60, 400)] ^ np.array(flips, np.uint64), np.arange(200, dtype=np.uint64), [np.uint64(0), np.uint64(2**64 - 1)]]))
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    got = simhash.links(df, 6, tile).collect()
    i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp) <= 6, 1))
    place = {int(x): k for k, x in enumerate(fp.view(np.int64))}
    u, v = np.array([place[r.u] for r in got]), np.array([place[r.v] for r in got])
    assert simhash.components(len(fp), i, j).tolist() == simhash.components(len(fp), u, v).tolist()
    assert simhash._segments(6)[-1][0] + simhash._segments(6)[-1][1] == 64


def test_many_languages(spark):
    rng = random.Random(1)
    tongues = {f"l{k:02d}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 8))) for _ in range(40)] for k in range(60)}
    rows = [(i, " ".join(rng.choices(words, k=60)), name) for i, (name, words) in enumerate(list(tongues.items()) * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.predict(df, *langid.learn(df.where("doc_id >= 60"))).where("doc_id < 60")
    assert found.where("lang <> lang_pred").count() == 0


@pytest.fixture(scope="module")
def long_texts():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 9))) for _ in range(5000)]
    one = " ".join(rng.choices(words, k=500_000))  # about 3 MB in one line
    return [one, one, one.replace(" ", "\n"), "x" * 3_000_000, ""]


def test_texts_of_megabytes(spark, long_texts):
    df = spark.createDataFrame(list(enumerate(long_texts)), "doc_id long, text string")
    prints = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    assert prints[0].fingerprint == prints[1].fingerprint == prints[2].fingerprint and prints[2].component_id == 0
    made = {r.doc_id: r.fingerprint for r in digest.fingerprints(df).collect()}
    assert made[0] == made[1] != made[3] and digest.likeness(*map(digest.from_hex, (made[0], made[1]))) == 1.0
    assert licenses.scan(df).count() >= 0
    kept = {r.doc_id: r for r in substring.remove_digests(df).collect()}
    assert (kept[0].n_removed, kept[1].n_removed, kept[2].n_removed) == (0, 500_000, 500_000)
    nothing = hashlib.sha256(b"").hexdigest()
    bytes_ = {r.doc_id: r for r in suffix.remove_digests(df).collect()}
    assert bytes_[0].n_removed == bytes_[0].n_bytes and bytes_[3].n_removed == 3_000_000 and bytes_[0].kept_sha256 == nothing


def test_cleaned_texts(frame):
    """The operator's general form: the texts and the spans to remove, which leave what the digests tell of."""
    want = sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in suffix.remove_digests(frame).collect())
    got = []
    for r in suffix.cleaned(frame).collect():
        data = (r.text or "").encode()
        keep = np.ones(len(data), bool)
        for s in r.spans or []:
            keep[s.begin : s.stop] = False
        got.append((r.doc_id, int((~keep).sum()), hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[keep])).hexdigest()))
    assert sorted(got) == want
