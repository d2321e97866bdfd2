"""Quality scores: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` words.  Every passage is described by
shares of character classes and of kinds of words and encoded by one layer; gated
attention (tanh times sigmoid, softmax over the bag) weighs the encoded passages, and
a logistic layer scores the weighted sum.  All weights are learned from document
labels alone.  Training takes at most ``SAMPLE`` labelled documents, those with the
least hash of their id, and of each at most ``BAG`` passages, evenly spread over the
text; scoring takes every passage and is one pass without a shuffle.

Defined results: null, empty and blank texts are one empty passage; a document with
several labels counts with the highest, and of several texts under one id one is learned
from; null labels and ids are left out; with no label at all every score is 0.5; very
long texts have as many passages as they need.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, text_blocks, word_hashes, words

PASSAGE = 50
SAMPLE = 8_000
BAG = 64
THRESHOLD = 0.3
_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b";:", b"!", b"?", b"'\"`", b"()[]{}", b"|", b"#", b"$", b"%", b"&", b"*", b"@", b"<>", b"/\\", b"=+_~^", b"-"]
_CLASS = np.full(256, len(_GROUPS), np.int64)
for _k, _g in enumerate(_GROUPS):
    _CLASS[list(_g)] = _k
_CLASS[128:] = len(_GROUPS) + 1
CHARS = len(_GROUPS) + 2
FEATURES = CHARS + 10
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_ALPHA = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) >= 128)


def passages(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and for each row its first passage (one more than rows)."""
    start, end, first = words(data, off)
    count = np.diff(first)
    each = np.maximum(-(-count // PASSAGE), 1)
    bag = np.zeros(len(count) + 1, np.int64)
    np.cumsum(each, out=bag[1:])
    n = int(bag[-1])
    x = np.zeros((n, FEATURES), np.float32)
    row = np.repeat(np.arange(len(count)), count)
    mine = bag[row] + (np.arange(len(start)) - first[row]) // PASSAGE
    # bytes: a passage reaches from its first word (the first one from the row's start) to the next
    lead = np.flatnonzero(np.diff(mine, prepend=-1))
    begin = np.repeat(off[:-1], each)
    begin[mine[lead]] = start[lead]
    begin[bag[:-1]] = off[:-1]
    size = np.diff(np.append(begin, len(data)))
    owner = np.repeat(np.arange(n), size)
    x[:, :CHARS] = np.sqrt(np.bincount(owner * CHARS + _CLASS[data], minlength=n * CHARS).reshape(n, CHARS) / np.maximum(size, 1)[:, None])
    if not len(start):
        return x, bag
    number = np.maximum(np.bincount(mine, minlength=n), 1)
    mean = lambda v: np.bincount(mine, v, minlength=n) / number
    length = end - start
    hashes = word_hashes(data, start, end)
    again = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])])
    order = np.lexsort((hashes, mine))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (mine[order][1:] != mine[order][:-1])
    edge = np.concatenate([[0], np.cumsum(_UPPER[data])])
    alpha = np.concatenate([[0], np.cumsum(_ALPHA[data])])
    upper = edge[end] - edge[start]
    letters = alpha[end] - alpha[start]
    at = CHARS
    for v in (length / 10, np.minimum(length, 40) ** 2 / 400, again, upper > 0, (upper > 1) & (upper >= letters * 0.8), letters == 0, letters < length - 1, length > 12, length <= 3):
        x[:, at] = mean(v.astype(float))
        at += 1
    x[:, at] = np.bincount(mine[order], fresh, minlength=n) / number
    return x, bag


class AttentionBags:
    """Encoder, gated attention and logistic score, trained with Adam."""

    def __init__(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 30, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.std = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
        n = lambda a, b: (rng.normal(0, 1 / np.sqrt(a), (a, b))).astype(np.float64)
        self.p = {"w": n(FEATURES, hidden), "wb": np.zeros(hidden), "v": n(hidden, gate), "u": n(hidden, gate), "a": n(gate, 1)[:, 0], "c": np.zeros(hidden), "b": np.zeros(1)}
        if not len(y):
            return
        self.p["b"][0] = np.log((y.mean() + 0.01) / (1.01 - y.mean()))
        m, s = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), batch):
                docs = order[lo : lo + batch]
                size = np.diff(bag)[docs]
                to = np.concatenate([[0], np.cumsum(size)])
                i = np.arange(to[-1]) + np.repeat(bag[docs] - to[:-1], size)
                grads = self._grads(self._scaled(x[i]), to, y[docs])
                step += 1
                for k, g in grads.items():
                    g = g + decay * self.p[k]
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.01 * (g * g - s[k])
                    self.p[k] -= rate * (1 - epoch / epochs * 0.9) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -8, 8)

    def _forward(self, x: np.ndarray, to: np.ndarray):
        p = self.p
        h = np.tanh(x @ p["w"] + p["wb"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * g) @ p["a"]
        bag = np.repeat(np.arange(len(to) - 1), np.diff(to))
        e = np.exp(e - np.maximum.reduceat(e, to[:-1])[bag])
        weight = e / np.add.reduceat(e, to[:-1])[bag]
        z = np.add.reduceat(weight[:, None] * h, to[:-1], axis=0)
        return h, t, g, weight, bag, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))

    def _grads(self, x: np.ndarray, to: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h, t, g, weight, bag, z, out = self._forward(x, to)
        d = (out - y) / len(y)
        dz = d[:, None] * p["c"]
        along = (h * dz[bag]).sum(axis=1)
        de = weight * (along - np.add.reduceat(weight * along, to[:-1])[bag])
        dh = weight[:, None] * dz[bag]
        dt, dg = de[:, None] * p["a"] * g * (1 - t * t), de[:, None] * p["a"] * t * g * (1 - g)
        dh += dt @ p["v"].T + dg @ p["u"].T
        dx = dh * (1 - h * h)
        return {"w": x.T @ dx, "wb": dx.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "c": z.T @ d, "b": np.array([d.sum()])}

    def score(self, x: np.ndarray, bag: np.ndarray) -> np.ndarray:
        return self._forward(self._scaled(x), bag)[-1]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> AttentionBags:
    """Learn from the labelled documents (``labels``: doc_id and label) with the least id hashes, ``sample`` at most."""
    known = labels.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y")).where("doc_id is not null and y is not null")
    chosen = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    want = docs.sparkSession.sparkContext.broadcast({r.doc_id: r.y for r in chosen})

    def run(batches):
        ids = np.fromiter(want.value, np.int64, len(want.value))
        for b in batches:
            b = b.filter(pa.array(np.isin(b.column(0).to_numpy(zero_copy_only=False), ids))) if len(ids) else b.slice(0, 0)
            for rows, data, off in text_blocks(iter([b])):
                x, bag = passages(data, off)
                spread = [x[a + np.unique(np.linspace(0, z - a - 1, min(BAG, z - a)).astype(np.int64))] for a, z in zip(bag[:-1], bag[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([v.astype(np.float16).tobytes() for v in spread], pa.binary())], names=["doc_id", "x"])

    bags = id_text(docs, doc_id, text).where("doc_id is not null").mapInArrow(run, "doc_id long, x binary")
    found = sorted(bags.groupBy("doc_id").agg(F.min("x").alias("x")).collect())
    x = [np.frombuffer(r.x, np.float16).reshape(-1, FEATURES) for r in found]
    bag = np.concatenate([[0], np.cumsum([len(v) for v in x])]).astype(np.int64)
    return AttentionBags(np.concatenate(x).astype(np.float64) if x else np.zeros((0, FEATURES)), bag, np.array([want.value[r.doc_id] for r in found], float))


def score(docs: DataFrame, model: AttentionBags, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, predicted for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for rows, data, off in text_blocks(batches, limit=1 << 20):
            s = shared.value.score(*passages(data, off))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return id_text(docs, doc_id, text).mapInArrow(run, "doc_id long, score double, predicted int")
