"""The other training-data operators against brute force, round trips and planted cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import bpe, decontam, digest, langid, licenses, lm, quality, simhash
from palimpsest.llm.common import fold
from palimpsest.llm.queries import tokenizer_path

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_fp(text):
    w = WORD.findall((text or "").encode().lower())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps, radius=2):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = sorted(fps)
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("name", ["frame", "odd", "nothing"])
def test_simhash(name, request):
    df = request.getfixturevalue(name)
    pairs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    fps = [(i, brute_fp(t)) for i, t in pairs]
    root = brute_components({f for _, f in fps})
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    want = sorted(((i, f"{f:016x}", least.get(root[f])) for i, f in fps), key=str)
    assert sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str) == want


@pytest.mark.parametrize(("tile", "radius"), [(1 << 14, 2), (5, 2), (5, 3), (1 << 14, 6)])
def test_tiles_lose_no_link(spark, tile, radius):
    rng = random.Random(2)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.add(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    fps |= {0, 1, 3, 7, 15, 2**64 - 1, 2**64 - 2}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), radius, tile)
    root = {r.u: r.root for r in simhash.star_components(edges).collect()}
    groups, want = {}, {}
    for f, s in zip(fps, signed, strict=True):
        groups.setdefault(root.get(s, s), set()).add(f)
    for f, r in brute_components(fps, radius).items():
        want.setdefault(r, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_radius_of_the_pipeline():
    """One word changed in texts of 100 to 2,000 words: nine of ten copies are within 6 bits."""
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    near = 0
    for _ in range(200):
        w = [rng.choice(vocab) for _ in range(rng.randint(100, 2000))]
        at = rng.randrange(len(w))
        a, b = " ".join(w).encode(), " ".join([*w[:at], "changed", *w[at + 1 :]]).encode()
        x, y = simhash.fingerprints_of(np.frombuffer(a + b, np.uint8), np.array([0, len(a), len(a) + len(b)]))
        near += int(x ^ y).bit_count() <= 6
    assert near >= 180


def test_one_of_each(frame, odd):
    kept = simhash.one_of_each(frame)
    assert kept.columns == frame.columns
    comp = simhash.near_duplicates(frame)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in comp.select("component_id").distinct().collect())
    comp = simhash.near_duplicates(odd.selectExpr("monotonically_increasing_id() as doc_id", "text"))
    assert simhash.one_of_each(odd).count() == comp.select("component_id").distinct().count()


def test_bpe_equals_the_library(frame):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    odd_texts = ["It's we'LL 12 3.5 x", "Σίσυφος ΟΔΥΣΣΕΥΣ", "a<|endoftext|>b <|startoftext|>", "\x1c\x1d a\x85b", "é   中文", "</w> !!??", "İstanbul ﬁ"]
    df = frame.select("doc_id", "text").unionByName(frame.sparkSession.createDataFrame(list(enumerate(odd_texts, 1000)), "doc_id long, text string"))
    text = {r.doc_id: r.text or "" for r in df.collect()}
    for r in bpe.encode(df, tokenizer_path()).collect():
        ids = t.encode(text[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded == t.decode(ids, skip_special_tokens=False)
    for r in bpe.encode_digests(df, tokenizer_path()).collect():
        ids = t.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("name", ["frame", "odd", "nothing"])
def test_digest_pairs(name, request):
    df = request.getfixturevalue(name)
    docs = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    tie = lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=7).digest())
    docs.sort(key=lambda d: (-(d[0] if d[0] is not None else -(1 << 63)), tie(d[1])))
    want = []
    for k, (i, t) in enumerate(docs):
        after, half = docs[(k + 1) % len(docs)][1], len(t) // 2
        edited = (t[: len(t) - half] + after[:half]).encode()
        a, b, c = (digest.codes(x) for x in (t.encode(), edited, after.encode()))
        want.append((i, len(t), hashlib.sha256(edited).hexdigest(), digest.to_hex(a), digest.to_hex(b), digest.likeness(a, b), digest.likeness(a, c)))
    assert sorted((tuple(r) for r in digest.with_edits(df).collect()), key=str) == sorted(want, key=str)


def test_rows_of_one_id_are_cut_into_ranges(spark, monkeypatch):
    """Many rows of one id and of none, some of them equal, over more ranges than ids: the pairs stay those of one sort."""
    monkeypatch.setattr(digest, "bucket_count", lambda df: 16)
    rng = random.Random(4)
    rows = [(None, f"n{rng.randint(0, 30)}") for _ in range(60)] + [(5, f"f{k}") for k in range(60)] + [(k, f"t{k}") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    tie = lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=7).digest())
    rows.sort(key=lambda d: (-(d[0] if d[0] is not None else -(1 << 63)), tie(d[1])))
    want = []
    for k, (i, t) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert sorted((tuple(r)[:3] for r in digest.with_edits(df).collect()), key=str) == sorted(want, key=str)
    at = digest._ranges(np.repeat([3, 7], 50), np.tile(np.arange(50) << 50, 2), np.array([1, 7, 7, 7, 9]))
    assert at[:50].tolist() == [1] * 50 and sorted(set(at[50:].tolist())) == [2, 3, 4]


def test_digest_form():
    code = digest.codes("hello größer world".encode())
    assert (digest.from_hex(digest.to_hex(code)) == code).all()
    assert digest.likeness(code, code) == 1.0 and set(digest.to_hex(digest.codes(b""))) == {"0"}
    assert 0 <= digest.likeness(code, digest.codes(b"something else")) < 1


def test_language(spark):
    rng = random.Random(1)
    vocab = {"en": "the of and with that this from have which their".split(), "de": "der die und nicht mit auch eine werden über schön".split()}
    say = lambda l_, n: " ".join(rng.choice(vocab[l_]) for _ in range(n))
    rows = [(i, say(l_, 30), l_, "x") for i in range(60) for l_ in ["en" if i % 2 else "de"]]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = langid.learn(train)
    tests = [(say("en", 20), "en"), (say("de", 20), "de"), (say("de", 30) + " " + say("en", 8), "de"), ("", "und"), (None, "und"), ("123 ... !", "und"), ("ÜBER", "de")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(tests)], "doc_id long, text string")
    got = langid.predict(df, *model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == [w for _, w in tests]
    assert 0.6 < got[2].score < 0.95 and got[3].score == 0 and all(0 <= r.score <= 1 for r in got)
    assert langid.predict(df, *model, keep="known").count() == 4
    none = langid.learn(train.where("doc_id < 0"))
    assert {r.lang_pred for r in langid.predict(df, *none).collect()} == {"und"}
    assert langid.predict(df.where("doc_id < 0"), *model).count() == 0


def plain_mixture(text, names, logp):
    """Word by word and language by language: EM, then the weakest language goes while the penalised likelihood does not fall."""
    from math import exp, log

    clean = [chr(b).lower() if (chr(b).isalpha() and b < 128) else (chr(b) if b >= 128 else " ") for b in (text or "").encode()]
    ws = "".join(clean).split(" ")
    ws = [w for w in ws if w]
    if not ws or not names:
        return None
    like, base = [], []
    for w in ws:
        padded = [32, *(ord(c) for c in w), 32]
        score = [0.0] * len(names)
        for k, order in enumerate(langid.ORDERS):
            for i in range(max(1, len(padded) - order + 1)):
                code = 0
                for b in padded[i : i + order]:
                    code = (code * 257 + b) % 2**32
                at = (code * 2654435761 % 2**32 >> 17) % langid.BUCKETS + k * langid.BUCKETS
                score = [s + float(x) / len(langid.ORDERS) for s, x in zip(score, logp[at], strict=True)]
        base.append(max(score))
        like.append([exp(s - base[-1]) for s in score])

    def em(theta, rounds):
        for _ in range(rounds):
            new = [0.0] * len(theta)
            for row in like:
                total = max(sum(a * t for a, t in zip(row, theta, strict=True)), 1e-30)
                new = [n + a * t / total for n, a, t in zip(new, row, theta, strict=True)]
            theta = [n / len(like) for n in new]
        return theta, sum(log(max(sum(a * t for a, t in zip(row, theta, strict=True)), 1e-30)) + b for row, b in zip(like, base, strict=True))

    theta, fit = em([1 / len(names)] * len(names), langid.ROUNDS)
    active, left = set(range(len(names))), 0.0
    for i in sorted(active, key=lambda i: theta[i]):
        left += theta[i] * len(ws)
        if left >= 0.5:
            break
        active.discard(i)
    cost = langid.PENALTY * log(len(ws) + 1)
    best = fit - cost * len(active)
    while len(active) > 1:
        weakest = min(active, key=lambda i: theta[i])
        trial = active - {weakest}
        start = [max(theta[i], 1e-3) if i in trial else 0.0 for i in range(len(names))]
        t, f = em([x / sum(start) for x in start], langid.ROUNDS // 2)
        if f - cost * len(trial) < best:
            break
        active, theta, best = trial, t, f - cost * len(trial)
    total = sum(theta[i] for i in active)
    return {names[i]: theta[i] / total for i in active}


def test_language_equals_plain_em(frame, odd, nothing):
    from pyspark.sql import functions as F

    learned = frame.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "de").when(F.col("doc_id") % 3 == 1, "fr").otherwise("en"))
    names, logp = langid.learn(learned)
    assert names == ["de", "en", "fr"]
    for df in (frame, odd):
        for r in langid.predict(df, names, logp).collect():
            want = plain_mixture(r.text, names, logp)
            if want is None or not any(c.isalpha() for c in r.text):
                assert (r.lang_pred, r.score) == ("und", 0)
            else:
                assert abs(r.score - max(want.values())) < 2e-2 and want[r.lang_pred] > max(want.values()) - 2e-2
    out = langid.predict(frame.withColumn("lang_pred", F.lit(1)), names, logp)
    assert out.columns == [c for c in frame.columns if c != "score"] + ["lang_pred", "score"]  # clashing names give way
    assert langid.predict(nothing, names, logp).count() == 0


def brute_base(docs, dictionary=None):
    from collections import Counter
    from math import log10

    toks = [(i, (t or "").encode().lower().split() + [None]) for i, t in docs]
    c = Counter(w for i, ws in toks if i is None or zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted([(i, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in toks], key=str)


@pytest.mark.parametrize("dictionary", [1 << 18, 5])
def test_language_model(frame, monkeypatch, dictionary):
    monkeypatch.setattr(lm, "STEPS", 3)
    monkeypatch.setattr(lm.LogBilinear.__init__, "__defaults__", (8, 3, *lm.LogBilinear.__init__.__defaults__[2:]))
    monkeypatch.setattr(lm.Vocabulary.__init__, "__defaults__", (dictionary,))
    docs = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    got = lm.score(frame, fold(F.col("doc_id"), 10) == 0).collect()
    assert sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], key=str) == brute_base(docs)
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)


@pytest.mark.parametrize("dictionary", [1 << 18, 5])
def test_language_model_scores_token_by_token(frame, monkeypatch, dictionary):
    """Each token's probability after the one before, normalised over the vocabulary; in a class, the word's smoothed share."""
    from collections import Counter
    from math import log10

    monkeypatch.setattr(lm.LogBilinear.__init__, "__defaults__", (8, 3, *lm.LogBilinear.__init__.__defaults__[2:]))
    monkeypatch.setattr(lm.Vocabulary.__init__, "__defaults__", (dictionary,))
    held = fold(F.col("doc_id"), 10) == 0
    got = {r.doc_id: r.score for r in lm.score(frame, held).collect()}
    train = frame.where(~held).select("text")
    texts = [(r.text or "").encode().lower().split() for r in train.collect()]
    count = Counter(w for t in texts for w in t)
    vocab = lm.Vocabulary(lm.count_words(train), len(texts), dictionary)
    id_of = {w: int(vocab.ids[k]) for w, k in vocab.index.items()}
    name = lambda w: lm.END if w is None else id_of.get(w, lm.word_class(w))
    pairs = np.zeros((lm.VOCAB, lm.VOCAB), np.float32)
    for t in texts:
        for a, b in zip([None, *t], [*t, None], strict=True):
            pairs[name(a), name(b)] += 1
    model = lm.LogBilinear(pairs)
    tokens, kinds = Counter(), Counter()
    for w, n in count.items():
        tokens[name(w)] += n
        kinds[name(w)] += 1
    for r in frame.collect():
        want, ws = 0.0, (r.text or "").encode().lower().split()
        for a, b in zip([None, *ws], [*ws, None], strict=True):
            s = model.q @ (model.c @ model.r[name(a)]) + model.b
            want += float(s[name(b)] - np.log(np.exp(s - s.max()).sum()) - s.max()) / np.log(10)
            if name(b) < lm.CLASSES:
                want += log10((count[b] + 0.1) / (tokens[name(b)] + 0.1 * (kinds[name(b)] + 1)))
        assert abs(got[r.doc_id] - want) < 1e-2 + 1e-5 * abs(want), r.doc_id


def test_language_model_odd_rows(odd, nothing, monkeypatch):
    monkeypatch.setattr(lm.LogBilinear.__init__, "__defaults__", (8, 1, *lm.LogBilinear.__init__.__defaults__[2:]))
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    got = lm.score(odd, fold(F.col("doc_id"), 10) == 0).collect()
    assert sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], key=str) == brute_base(docs)
    assert lm.score(nothing, fold(F.col("doc_id"), 10) == 0).count() == 0


def test_model_is_normalised():
    rng = np.random.default_rng(0)
    pairs = np.zeros((lm.VOCAB, lm.VOCAB), np.float32)
    pairs[rng.integers(0, 50, 3000), rng.integers(0, 50, 3000)] += 1
    table = lm.LogBilinear(pairs, size=8, steps=5).table()
    assert np.allclose((10.0 ** table.astype(float)).sum(axis=1), 1, atol=1e-3)


def test_quality(spark, nothing):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice("the river runs over stones and light falls".split()) for _ in range(120)).capitalize() + "."
    bad = lambda: " ".join(rng.choice("buy now cheap".split()).upper() + "!!" for _ in range(120))
    docs = spark.createDataFrame([(i, good() if i % 3 else bad(), "x") for i in range(300)] + [(900, None, "x"), (901, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(5, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert all(got[i].predicted == int(i % 3 > 0) for i in range(300)) and 0 <= got[900].score <= 1 and got[900].score == got[901].score
    holes = docs.unionByName(spark.createDataFrame([(None, good(), "x"), (None, bad(), "x"), (7, bad(), "x")], docs.schema))
    odd_labels = labels.unionByName(spark.createDataFrame([(-1, 1), (None, 1), (7, 1)], labels.schema))
    again = quality.train(holes, odd_labels)
    assert quality.score(holes, again).count() == 305 and all(0 <= r.score <= 1 for r in quality.score(holes, again).collect())
    none = quality.train(docs, labels.where("doc_id < 0"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(nothing, model).count() == 0


def test_attention_equals_a_plain_forward_pass():
    """Passage by passage: encode, weigh by gated attention, score the weighted sum."""
    from math import exp, tanh

    text = (" ".join(f"word{i}" for i in range(130)) + "\nTail, of THE text!").encode()
    data, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    x, bag = quality.passages(data, off)
    assert bag.tolist() == [0, 3]
    rng = np.random.default_rng(9)
    m = quality.AttentionBags(x.astype(float), bag, np.array([1.0]), epochs=1)
    for v in m.p.values():
        v += rng.normal(size=v.shape) * 0.3
    codes, weights = [], []
    for row in x.astype(float):
        z = [max(-8.0, min(8.0, (a - mu) / sd)) for a, mu, sd in zip(row, m.mean, m.std, strict=True)]
        h = [tanh(sum(a * w for a, w in zip(z, col, strict=True)) + b) for col, b in zip(m.p["w"].T, m.p["wb"], strict=True)]
        gate = [tanh(sum(a * w for a, w in zip(h, v, strict=True))) / (1 + exp(-sum(a * w for a, w in zip(h, u, strict=True)))) for v, u in zip(m.p["v"].T, m.p["u"].T, strict=True)]
        codes.append(h)
        weights.append(exp(sum(a * g for a, g in zip(m.p["a"], gate, strict=True))))
    whole = [sum(w * h[k] for w, h in zip(weights, codes, strict=True)) / sum(weights) for k in range(len(codes[0]))]
    want = 1 / (1 + exp(-(sum(a * c for a, c in zip(whole, m.p["c"], strict=True)) + m.p["b"][0])))
    assert abs(float(m.score(x, bag)[0]) - want) < 1e-9


def test_attention_gradients():
    rng = np.random.default_rng(4)
    x, to, y = rng.normal(size=(9, quality.FEATURES)), np.array([0, 2, 5, 9]), np.array([1.0, 0.0, 1.0])
    m = quality.AttentionBags(np.zeros((0, quality.FEATURES)), np.zeros(1, int), np.zeros(0))
    m.p["c"] += rng.normal(size=m.p["c"].shape)
    loss = lambda: -np.mean(y * np.log(m._forward(x, to)[-1]) + (1 - y) * np.log(1 - m._forward(x, to)[-1]))
    grads = m._grads(x, to, y)
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        m.p[k][at] += 1e-5
        up = loss()
        m.p[k][at] -= 2e-5
        down = loss()
        m.p[k][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6, k


def test_decontamination(spark, nothing):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(300)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [say(30) for _ in range(5)]
    edited = list(items[1])
    for k in range(3, 30, 6):
        edited[k] = "other"
    gap = items[2][:14] + ["extra", "words"] + items[2][14:]
    docs = [" ".join(say(200)) for _ in range(20)]
    docs += [" ".join(say(50) + items[0] + say(50)), " ".join(say(20) + edited + say(30)).upper(), " ".join(gap), "... ".join(items[3]), " ".join(items[4][:8] + say(80)), "", None]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(docs)], "doc_id long, text string, item_id double")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(8, None), (9, "..."), (10, " ".join(items[0]))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(df, bench).collect()}
    assert set(got) == {(20, 0), (20, 10), (21, 1), (22, 2), (23, 3)}
    assert got[20, 0] == 1.0 and 0.5 < got[21, 1] < 1.0
    kept = decontam.without(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [*range(20), 24, 25, 26]
    assert decontam.contaminated(nothing, bench).count() == 0 and decontam.contaminated(df, bench.where("item_id < 0")).count() == 0


@pytest.mark.parametrize(("threshold", "pairs"), [(0.5, 1 << 22), (0.7, 200)])
def test_decontamination_equals_alignment_of_all_pairs(spark, monkeypatch, threshold, pairs):
    """Every seventh word of an item is of all items; edits from every second to every tenth word."""
    monkeypatch.setattr(decontam, "PAIRS", pairs)
    rng = random.Random(21)
    vocab = [f"w{i}" for i in range(60)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [say(n) for n in (16, 60, 30, 3, 4, 5, 20, 45, 17, 24)] + [[x if k % 7 else "common" for k, x in enumerate(say(25))] for _ in range(4)]
    docs = [say(rng.randint(1, 150)) for _ in range(40)] + [["common"] * 60]
    for w in items:
        for every in (2, 3, 4, 5, 7, 10):
            docs.append(say(20) + [x if k % every else f"new{k}" for k, x in enumerate(w, 1)] + say(20))
        docs += [[y for x in w for y in (x, "between")], [x for x in w if rng.random() < 0.7], [y for x in w for y in ((x, "in", "two") if rng.random() < 0.3 else (x,))]]
    want = {}
    code = {w: k for k, w in enumerate({w for t in docs + items for w in t})}
    coded = lambda t: np.array([code[w] for w in t])
    for d, text in enumerate(docs):
        for i, w in enumerate(items):
            share = decontam.align(coded(w), coded(text)) / (2 * len(w))
            if share >= threshold:
                want[d, i] = share
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(df, bench, threshold).collect()} == want
    assert (43, 0) in want or threshold > 0.65  # every fourth word replaced
    assert sorted(r.doc_id for r in decontam.without(df, bench, threshold).collect()) == [d for d in range(len(docs)) if not any((d, i) in want for i in range(len(items)))]


def test_short_items_and_scripts_without_spaces(spark, odd):
    """Items of one or two words count whole; punctuation of any script ends words; unspaced scripts go by character."""
    items = ["Zanzibar", "blue‑green Algae", "水は百度で沸騰する。", "«Où est la gare?» demanda l’homme", "…"]
    docs = ["in zanzibar once", "zan zibar", "blue green algae grow", "algae, blue", "問題：水は百度で沸騰する、と彼は言った", "Où est la gare, demanda l'homme", "水と火", None, ""]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(df, bench).collect()} == {(0, 0), (2, 1), (4, 2), (5, 3)}
    got = decontam.contaminated(odd, spark.createDataFrame([(1, odd.where("doc_id = -3").first().text)], "item_id long, text string")).collect()
    assert -3 in {r.doc_id for r in got} and len(got) <= odd.count()


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(6)
    for _ in range(30):
        a, b = rng.integers(0, 4, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 4, rng.integers(1, 15)).astype(np.uint64)
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontam.align(a, b) == h.max()


def test_licenses(spark, nothing):
    mit = licenses.KNOWN[0][1]
    rows = [(1, "MIT Licence\n\nCopyright (c) 2020 A B\n" + mit.upper()), (1, "MIT Licence\n\nCopyright (c) 2020 A B\n" + mit.upper()), (2, "Prose.\nLicenced under CC BY-NC 4.0\nAll rights reserved"), (3, None), (None, "..."), (4, mit + " more")]
    got = sorted(((r.doc_id, r.license_id, r.line_licenses, r.n_lines) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, "MIT", "", 0), (1, "MIT", "", 0), (2, None, "CC-BY-NC-4.0,all-rights-reserved", 2), (3, None, "", 0), (None, None, "", 0), (4, None, "", 0)], key=str)
    digests = {r.doc_id: r.digest for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert digests[4] == hashlib.sha256(licenses.canonical(mit + " more").encode()).hexdigest()
    assert licenses.scan(nothing).count() == 0


def test_license_headers(spark):
    """Line breaks, punctuation and holders of rights do not matter."""
    head = """/* Copyright 2021 A. B.
 * Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
 * compliance with the License. You may obtain a copy of the License at
 *     https://www.apache.org/licenses/LICENSE-2.0
 * Unless required by applicable law or agreed to in writing, software distributed under the License is
 * distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and limitations under the License. */"""
    got = licenses.scan(spark.createDataFrame([(1, head.split("\n", 1)[1]), (2, head + " more")], "doc_id long, text string"))
    assert {r.doc_id: r.license_id for r in got.collect()} == {1: "Apache-2.0", 2: None}
    names = [n for n, _ in licenses.KNOWN_DIGESTS]
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(names) and all(len(d) == 64 for _, d in licenses.KNOWN_DIGESTS)
