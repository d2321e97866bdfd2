"""Language identification by multilingual mixture inference.

Training counts byte n-grams (2 and 3 bytes, within words, lower-cased, with word
ends) of every labelled training text, by language, over all rows.  A document is a
mixture of languages: each word's likelihood in a language is that of its n-grams,
and expectation-maximisation estimates the proportions.  The language set is chosen
by penalised likelihood: starting from all languages with any support, the weakest
is removed as long as log-likelihood minus ``PENALTY * ln(words + 1)`` per language
does not fall.  Languages that together have less than half a word of support go at
once: without them the likelihood falls by ln 2 at most, which no penalty is below.
The prediction is the largest proportion, which is also the score.

Defined results: ``und`` with score 0 for a null text, a text without a letter, or
when nothing was learned; ties go to the first language by name; whole texts of any
length are used; repeated rows get equal results; rows with a null id are predicted
but never learned from; input columns named lang_pred or score give way to the new
ones; languages are bounded by ``MAX_LANGUAGES`` (an error beyond).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, BLOCK_BYTES, text_blocks, tidy, words

BUCKETS = 1 << 15
ORDERS = (2, 3)
PENALTY = 1.0
ROUNDS = 12
MAX_LANGUAGES = 400
_LETTER = regex.compile(r"\p{L}")
_GAP = 0x20


def _clean(data: np.ndarray) -> np.ndarray:
    """Lower case; everything that is neither an ASCII letter nor part of a non-ASCII character becomes a gap."""
    out = _LOWER[data].copy()
    letter = ((out >= 97) & (out <= 122)) | (out >= 128)
    out[~letter] = _GAP
    return out


def _grams(clean: np.ndarray, start: np.ndarray, end: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word, and how many each word has.  A word is read with one gap on both sides."""
    n = len(clean)
    padded = np.concatenate([[np.uint8(_GAP)], clean, np.full(3, _GAP, np.uint8)]).astype(np.uint32)
    code = padded[: n + 1].copy()
    for k in range(1, order):
        code = code * np.uint32(257) + padded[k : n + 1 + k]
    code = (code * np.uint32(2654435761) >> np.uint32(17)) & np.uint32(BUCKETS - 1)
    count = np.maximum(end - start + 3 - order, 1)
    to = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=to[1:])
    return code[np.arange(to[-1]) + np.repeat(start - to[:-1], count)], to  # start in padded is the gap before


def _word_spans(clean: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return words(clean, off)


def learn(docs: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities, (orders * BUCKETS) x languages.

    The driver gets one compressed row of counts a language.
    """

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for rows, data, off in text_blocks(batches):
            names = np.array(rows.column(0).to_pylist(), dtype=object)
            clean = _clean(data)
            start, end, first = _word_spans(clean, off)
            owner = np.repeat(np.arange(len(off) - 1), np.diff(first))
            known, code = np.unique(names.astype(str), return_inverse=True)
            of = code[owner]
            for k, order in enumerate(ORDERS):
                grams, to = _grams(clean, start, end, order) if len(start) else (np.zeros(0, np.int64), np.zeros(1, np.int64))
                each = np.repeat(of, np.diff(to))
                for i, name in enumerate(known):
                    got = total.setdefault(name, np.zeros(len(ORDERS) * BUCKETS, np.int64))
                    got[k * BUCKETS : (k + 1) * BUCKETS] += np.bincount(grams[each == i], minlength=BUCKETS)
        for name, counts in total.items():
            full = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(full)), pa.array(full, pa.int32()), pa.array(counts[full])], names=["lang", "gram", "n"])

    known = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).where("lang is not null and text is not null")

    def gather(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for name in pc.unique(b.column(0)):
                own = b.filter(pc.equal(b.column(0), name))
                total.setdefault(name.as_py(), np.zeros(len(ORDERS) * BUCKETS, np.int64))[own.column(1).to_numpy()] += own.column(2).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([zstandard.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], names=["lang", "counts"])

    counts = known.mapInArrow(tidy(run), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = counts.repartition("lang").mapInArrow(gather, "lang string, counts binary").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = sorted(r.lang for r in found)
    logp = np.zeros((len(ORDERS) * BUCKETS, len(names)), np.float32)
    for r in found:
        full = np.frombuffer(zstandard.decompress(r.counts), np.int64).reshape(len(ORDERS), BUCKETS)
        logp[:, names.index(r.lang)] = np.log((full + 0.5) / (full.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)).ravel()
    return names, logp


def _em(like: np.ndarray, base: np.ndarray, doc: np.ndarray, begin: np.ndarray, theta: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents x languages) and log-likelihood after some rounds.  Documents with no word aren't given."""
    n = np.diff(np.append(begin, len(doc)))[:, None].astype(np.float32)
    for _ in range(rounds):
        r = like * theta[doc]
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-30)
        theta = np.add.reduceat(r, begin, axis=0) / n
    mass = np.log(np.maximum((like * theta[doc]).sum(axis=1), 1e-30)) + base
    return theta, np.add.reduceat(mass.astype(np.float64), begin)


def proportions(data: np.ndarray, off: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Language proportions of each row; all zero where a row has no word of letters."""
    rows, langs = len(off) - 1, logp.shape[1]
    out = np.zeros((rows, langs), np.float32)
    clean = _clean(data)
    start, end, first = _word_spans(clean, off)
    full = np.flatnonzero(np.diff(first))
    if not len(full) or not langs:
        return out
    score = np.zeros((len(start), langs), np.float32)
    for k, order in enumerate(ORDERS):
        grams, to = _grams(clean, start, end, order)
        score += np.add.reduceat(logp[grams + k * BUCKETS], to[:-1], axis=0) / len(ORDERS)
    base = score.max(axis=1)
    like = np.exp(score - base[:, None])
    count = np.diff(first)[full]
    doc, begin = np.repeat(np.arange(len(full)), count), first[:-1][full]
    theta, fit = _em(like, base, doc, begin, np.full((len(full), langs), 1 / langs, np.float32), ROUNDS)
    weak = theta.argsort(axis=1)
    support = np.cumsum(np.take_along_axis(theta, weak, axis=1) * count[:, None], axis=1)
    active = np.ones_like(theta, bool)
    np.put_along_axis(active, weak, support >= 0.5, axis=1)
    cost = PENALTY * np.log(count + 1)
    open_ = np.flatnonzero(active.sum(axis=1) > 1)
    best = fit - cost * active.sum(axis=1)
    while len(open_):
        weakest = np.where(active[open_], theta[open_], np.inf).argmin(axis=1)
        trial = active[open_].copy()
        trial[np.arange(len(open_)), weakest] = False
        size = count[open_]
        to = np.zeros(len(open_), np.int64)
        np.cumsum(size[:-1], out=to[1:])
        at = np.arange(size.sum()) + np.repeat(begin[open_] - to, size)
        from_ = np.where(trial, np.maximum(theta[open_], 1e-3), 0)
        from_ /= from_.sum(axis=1, keepdims=True)
        t, f = _em(like[at], base[at], np.repeat(np.arange(len(open_)), size), to, from_.astype(np.float32), ROUNDS // 2)
        f -= cost[open_] * trial.sum(axis=1)
        better = f >= best[open_]
        won = open_[better]
        active[won], theta[won], best[won] = trial[better], t[better], f[better]
        open_ = won[active[won].sum(axis=1) > 1]
    theta = np.where(active, theta, 0)
    out[full] = theta / theta.sum(axis=1, keepdims=True)
    return out


def has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    ascii_ = (((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122))).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(ascii_)])
    out = np.diff(total[off]) > 0
    for i in np.flatnonzero(~out & (np.diff(off) > 0)):
        out[i] = bool(_LETTER.search(data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


def predict_block(data: np.ndarray, off: np.ndarray, names: list[str], logp: np.ndarray) -> tuple[list[str], np.ndarray]:
    share = proportions(data, off, logp)
    if not names:
        return ["und"] * (len(off) - 1), np.zeros(len(off) - 1)
    share[~has_letter(data, off)] = 0
    top = share.argmax(axis=1)
    score = share.max(axis=1).astype(float)
    # a text of letters alone that no word was made of doesn't occur: each letter is in a word
    return [names[k] if s > 0 else "und" for k, s in zip(top, score, strict=True)], np.clip(score, 0, 1)


def predict(docs: DataFrame, names: list[str], logp: np.ndarray, text: str = "text", keep: str | None = None) -> DataFrame:
    """All columns of ``docs`` with lang_pred and score after them; no shuffle.

    ``keep='known'`` returns only documents with a language, without the new columns.
    Input columns named lang_pred or score are replaced unless ``keep`` is given.
    """
    if not keep:
        docs = docs.drop(*(c for c in docs.columns if c.lower() in ("lang_pred", "score") and c != text))
    model = docs.sparkSession.sparkContext.broadcast((names, logp))
    schema = docs.schema

    def run(batches):
        names, logp = model.value
        for rows, data, off in text_blocks(batches, text, BLOCK_BYTES * 8 // max(8, len(names))):  # a number a language for each n-gram
            lang, score = predict_block(data, off, names, logp)
            if keep:
                yield rows.filter(pa.array([x != "und" for x in lang]))
            else:
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(lang), pa.array(score)], names=[*rows.schema.names, "lang_pred", "score"])

    if not keep:
        from pyspark.sql import types as T

        schema = T.StructType([*schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(tidy(run), schema)
