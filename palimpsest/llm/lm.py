"""Language-model scores: a log-bilinear neural model trained by noise-contrastive estimation.

Tokens are predicted from the token before.  The model's vocabulary has a fixed size:
the commonest words, the end of a text, and ``CLASSES`` classes of all other words by
their last letters; inside a class a word has its smoothed share of the class's
tokens, and all unseen words together one more share, so that probabilities over the
training vocabulary and "unseen" sum to one.

Counts of words and of pairs are taken over every training text.  The pair counts
form a table of at most VOCAB**2 cells whatever the corpus, on which the driver
trains: score(w | h) = (C r_h) . q_w + b_w, told apart from unigram noise (logistic
loss; the noise expectation runs over the whole vocabulary instead of draws).
Scoring normalises over the vocabulary by batched matrix products.

Counts of the commonest ``DICTIONARY`` words travel to the executors; the others are
looked up by a join.

Defined results: a null text is empty: one end token; with no training text every
token is unseen (N = V = 0); rows of equal id and text get equal scores and stay
apart; a null id is in no held-out fold and is learned from; texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import _pack, _unpack, by_bucket
from .common import bucket_count, id_text, stored, text_blocks

CLASSES = 1024
VOCAB = 3072
END = CLASSES
DICTIONARY = 1 << 18
#: Longer words are looked up by the join, however common.
WORD_BYTES = 64
SIZE = 32
NOISE = 8.0
STEPS = 60
FLUSH = 300_000
_PUNCTUATION = b".,;:!?\"'()[]{}|*#$%&-_/\\"


def word_class(word: bytes) -> int:
    """Class of a word outside the model's vocabulary: by its last three bytes, punctuation apart."""
    core = word.rstrip(_PUNCTUATION)
    key = core[-3:] + (b"." if len(core) < len(word) else b"")
    return int.from_bytes(hashlib.blake2b(key, digest_size=4).digest()) % CLASSES


def count_words(texts: DataFrame) -> DataFrame:
    """(word binary, n) over all texts; ends of texts are not counted here."""

    def run(batches):
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for _, data, off in text_blocks(batches):
            low = data.tobytes().lower()
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                held.update(low[a:b].split())
            if len(held) >= FLUSH:
                yield flush()
                held.clear()
        if held:
            yield flush()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """What the executors need of the counts: the dictionary, ids, and totals of classes."""

    def __init__(self, counts: DataFrame, ends: int, dictionary: int = DICTIONARY):
        # a row for each sixteenth of a doubling of n
        by_n = counts.groupBy(F.floor(F.log2("n") * 16).alias("k")).agg(F.count("*").alias("words"), F.sum("n").alias("n"), F.min("n").alias("least")).orderBy(F.desc("k")).toPandas()
        fits = by_n["least"][by_n["words"].cumsum() <= dictionary]
        self.least = int(fits.min()) if len(fits) else 1 << 62
        self.ends = ends
        self.tokens = int(by_n["n"].sum()) + ends
        self.distinct = int(by_n["words"].sum()) + (ends > 0)
        # common words too long for the dictionary go out by hash
        self.long = {r.h: r.n for r in counts.where((F.col("n") >= self.least) & (F.octet_length("word") > WORD_BYTES)).select(F.sha2("word", 256).alias("h"), "n").collect()}
        rows = counts.where(self.inside()).select("word", "n").toPandas().sort_values(["n", "word"], ascending=[False, True])
        self.count = rows["n"].to_numpy(np.int64)
        words = [bytes(w) for w in rows["word"]]
        self.index = {w: i for i, w in enumerate(words)}
        hot = VOCAB - END - 1
        self.ids = np.array([END + 1 + i if i < hot else word_class(w) for i, w in enumerate(words)], np.int32)
        # totals of classes: those in the dictionary here, all others by one pass over the counts
        self.class_tokens, self.class_words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        np.add.at(self.class_tokens, self.ids[hot:], self.count[hot:])
        np.add.at(self.class_words, self.ids[hot:], 1)

        def classes(batches):
            n, m = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
            for b in batches:
                own = np.array([word_class(w) for w in b.column(0).to_pylist()], np.int64)
                np.add.at(n, own, b.column(1).to_numpy())
                np.add.at(m, own, 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(n), pa.array(m)], names=["c", "n", "m"])

        rest = counts.where(~self.inside()).select("word", "n").mapInArrow(classes, "c long, n long, m long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).toPandas()
        np.add.at(self.class_tokens, rest["c"].to_numpy(np.int64), rest["n"].to_numpy(np.int64))
        np.add.at(self.class_words, rest["c"].to_numpy(np.int64), rest["m"].to_numpy(np.int64))

    def inside(self) -> Column:
        """Which rows of the counts are in the dictionary: common words of bounded length."""
        return (F.col("n") >= self.least) & (F.octet_length("word") <= WORD_BYTES)

    def places(self, words: list[bytes]) -> list[int]:
        """Place of each word in the dictionary, or -1."""
        get = self.index.get
        return [get(w, -1) for w in words]

    def model_ids(self, words: list[bytes], places: np.ndarray) -> np.ndarray:
        ids = self.ids[places] if len(self.ids) else np.zeros(len(places), np.int32)
        cold = np.flatnonzero(places < 0)
        ids[cold] = [word_class(words[i]) for i in cold]
        return ids


def count_pairs(texts: DataFrame, shared, buckets: int) -> np.ndarray:
    """Pair counts (before, token) of the model's vocabulary over all texts.

    The driver gets at most VOCAB rows.
    """

    def run(batches):
        vocab: Vocabulary = shared.value
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            code, m = np.unique(np.concatenate(held), return_counts=True)
            bucket = code // VOCAB % buckets
            order = np.lexsort((code, bucket))
            code, m, bucket = code[order].astype(np.int64), m[order].astype(np.int64), bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(cuts[1:], len(code))
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int32)), pa.array([_pack(code[a:b], m[a:b]) for a, b in zip(cuts, ends, strict=True)], pa.binary())], names=["bucket", "pairs"])

        for _, data, off in text_blocks(batches):
            low = data.tobytes().lower()
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                words = low[a:b].split()
                ids = np.concatenate([[END], vocab.model_ids(words, np.array(vocab.places(words), np.int64)), [END]]).astype(np.int64)
                held.append(ids[:-1] * VOCAB + ids[1:])
                n += len(ids)
            if n >= 1 << 22:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    def add(batches):
        rows: dict[int, np.ndarray] = {}
        for b in batches:
            for blob in b.column(1).to_pylist():
                code, m = _unpack(blob, (np.int64, np.int64))
                before = code // VOCAB
                cuts = np.flatnonzero(np.diff(before, prepend=-1))
                for a, z in zip(cuts, np.append(cuts[1:], len(code)), strict=True):
                    row = rows.setdefault(int(before[a]), np.zeros(VOCAB, np.int64))
                    row[code[a:z] % VOCAB] += m[a:z]
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), pa.array([zstandard.compress(r.tobytes(), 1) for r in rows.values()], pa.binary())], names=["before", "row"])

    table = np.zeros((VOCAB, VOCAB), np.float32)
    dealt = by_bucket(texts.mapInArrow(run, "bucket int, pairs binary"), buckets)
    for r in dealt.mapInArrow(add, "before int, row binary").collect():
        table[r.before] = np.frombuffer(zstandard.decompress(r.row), np.int64)
    return table


class LogBilinear:
    """score(w | h) = (C r_h) . q_w + b_w."""

    def __init__(self, pairs: np.ndarray, size: int = SIZE, steps: int = STEPS, noise: float = NOISE, rate: float = 0.05, block: int = 256, seed: int = 7):
        rng = np.random.default_rng(seed)
        total = max(float(pairs.sum(dtype=np.float64)), 1.0)
        share = (pairs.sum(axis=0, dtype=np.float64) + 0.1) / (total + 0.1 * VOCAB)
        self.r = rng.normal(0, 0.1, (VOCAB, size)).astype(np.float32)
        self.c = np.eye(size, dtype=np.float32)
        self.q = rng.normal(0, 0.1, (VOCAB, size)).astype(np.float32)
        self.b = np.log(share).astype(np.float32)
        before = pairs.sum(axis=1, dtype=np.float64)
        offset = np.log(noise * share).astype(np.float32)
        weight = np.sqrt(np.maximum(before, 0)) / max(float(np.sqrt(before).sum()), 1.0)  # frequent contexts would drown the others
        used = np.flatnonzero(before > 0)
        own = (self.r, self.c, self.q, self.b)
        first, second = [np.zeros_like(x) for x in own], [np.zeros_like(x) for x in own]
        step = 0
        for epoch in range(steps):
            speed = rate * (1 - 0.9 * epoch / max(steps, 1))
            grads = [np.zeros_like(x) for x in own]
            for lo in range(0, len(used), block):
                h = used[lo : lo + block]
                scale = (weight[h] / before[h]).astype(np.float32)[:, None]
                ph = self.r[h] @ self.c.T
                real = 1 / (1 + np.exp(np.clip(offset - ph @ self.q.T - self.b, -60, 60)))  # posterior of data against noise
                # data cells pull up by 1 - real, noise cells push down by real
                d = pairs[h] * scale * (real - 1) + (noise * weight[h]).astype(np.float32)[:, None] * share.astype(np.float32) * real
                grads[2] += d.T @ ph
                grads[3] += d.sum(axis=0)
                dp = d @ self.q
                grads[1] += dp.T @ self.r[h]
                grads[0][h] += dp @ self.c
            step += 1
            for x, g, m, v in zip(own, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)

    def table(self, block: int = 256) -> np.ndarray:
        """log10 P(token | before) of the whole vocabulary: batched products, then normalised."""
        out = np.empty((VOCAB, VOCAB), np.float32)
        for lo in range(0, VOCAB, block):
            s = (self.r[lo : lo + block] @ self.c.T) @ self.q.T + self.b
            s -= s.max(axis=1, keepdims=True)
            out[lo : lo + block] = (s - np.log(np.exp(s).sum(axis=1, keepdims=True))) / np.log(10)
        return out


def score(docs: DataFrame, held_out, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Learn from rows where the Column ``held_out`` (of doc_id) is false; score all.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    context = docs.sparkSession.sparkContext
    docs = id_text(docs, doc_id, text)
    train = docs.where(~held_out).select("text")
    counts = stored(count_words(train), "words")
    vocab = Vocabulary(counts, train.count())
    shared = context.broadcast(vocab)
    model = LogBilinear(count_pairs(train, shared, min(bucket_count(docs), VOCAB)))
    shared_model = context.broadcast(model)

    def run(batches):
        vocab, table = shared.value, shared_model.value.table()
        n, v = vocab.tokens, vocab.distinct
        base_under = np.log10(n + 0.1 * (v + 1))
        inside = np.log10(vocab.class_tokens + 0.1 * (vocab.class_words + 1))  # of each class
        log_count = np.log10(vocab.count + 0.1)
        for rows, data, off in text_blocks(batches):
            low = data.tobytes().lower()
            ids = rows.column(0)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            out: list[tuple] = []
            for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                words = low[a:b].split()
                key = int.from_bytes(hashlib.blake2b(data[a:b].tobytes(), digest_size=8).digest(), signed=True)
                places = np.array(vocab.places(words), np.int64)
                tokens = np.concatenate([[END], vocab.model_ids(words, places), [END]]).astype(np.int64)
                known = places[places >= 0]
                lg = log_count[known]
                neural = float(table[tokens[:-1], tokens[1:]].sum(dtype=np.float64))
                in_class = tokens[1:-1] < CLASSES
                neural -= float(inside[tokens[1:-1][in_class]].sum()) - float(lg[in_class[places >= 0]].sum())
                base = float(lg.sum()) + np.log10(vocab.ends + 0.1) - base_under * (len(words) + 1)
                cold, seen = Counter([words[i] for i in np.flatnonzero(places < 0)]), len(known) + (vocab.ends > 0)
                for w in [w for w in cold if len(w) > WORD_BYTES] if vocab.long else []:
                    count = vocab.long.get(hashlib.sha256(w).hexdigest())
                    if count is not None:
                        m = cold.pop(w)
                        seen, part = seen + m, m * float(np.log10(count + 0.1))
                        base, neural = base + part, neural + part
                out.append((ids[k].as_py(), key, None, 0, len(words) + 1, seen, base, neural))
                out += [(out[-1][0], key, w, m, 0, 0, 0.0, 0.0) for w, m in cold.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["doc_id", "key", "word", "m", "n_tokens", "n_known", "base", "neural"])

    found = stored(docs.mapInArrow(run, "doc_id long, key long, word binary, m long, n_tokens long, n_known long, base double, neural double"), "lm")
    whole = found.where("word is null").select("doc_id", "key", F.lit(1).alias("copies"), "n_tokens", "n_known", "base", "neural")
    rare = counts.where(F.col("n") < vocab.least)
    cold = found.where("word is not null").select("doc_id", "key", "word", "m").join(rare, "word", "left")
    part = F.col("m") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)
    cold = cold.select("doc_id", "key", F.lit(0).alias("copies"), F.lit(0).alias("n_tokens"), F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0).alias("n_known"), part.alias("base"), part.alias("neural"))
    each = whole.unionByName(cold).groupBy("doc_id", "key").agg(*(F.sum(c).alias(c) for c in ("copies", "n_tokens", "n_known", "base", "neural")))
    one = each.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    share = lambda c: (F.col(c) / F.col("copies"))
    return one.select("doc_id", held_out.alias("held_out"), share("n_tokens").cast("long").alias("n_tokens"), share("n_known").cast("long").alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"), share("base").alias("base_score"), share("neural").alias("score"))
