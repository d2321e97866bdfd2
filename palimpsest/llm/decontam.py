"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters, digits and non-ASCII characters, lower-cased; Unicode
punctuation and spaces end them, and a character of a script without spaces is a word
of its own.  A test item is aligned locally (match 2, mismatch and gap -1) with the text
around its seeds, and the score is the best alignment's share of the item's own score.
Copies with edits keep most of it.

Seeds are the words and pairs of words of the item that all documents together contain
least often, so many that no alignment above the threshold goes without them.  With n
words, M of them matched and G pairs matched as pairs, an alignment has M - G runs and
loses at least 1 between two runs, so its score is at most 2 M - (M - G - 1) = M + G + 1.
An item has n words and n - 1 pairs; where the score needed is s, at least s - 1 of these
2 n - 1 are matched, and of any 2 n - s + 1 + t of them at least 1 + t.  ``t`` grows for
as long as the hits expected do not double.  An alignment spans 3 n - s words at most, so
its hits are in two neighbouring stretches of that length: an item is aligned there only
where the hits of both are 1 + t or more.  The search is exact: it finds what alignment
of every item with every text would.

Test items are read in blocks of at most ``BLOCK_BYTES`` of text and travel as arrays, so
what goes to the executors has a fixed bound whatever the benchmark; documents are
scanned twice per block (counts, then search) and never shuffled.

Defined results: null texts have no words; items of fewer than ``LEAST_WORDS`` words are
found by their whole sequence of words only; items without a word are not searched; items
with equal text are each reported; repeated documents are each reported; a null doc_id is
reported as null; no item or no document gives no row.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, id_text, mixed, text_blocks, tidy, word_hashes, words

LEAST_WORDS = 3
THRESHOLD = 0.5
BLOCK_BYTES = 16 << 20
#: Pairs of a hit and an item that are looked at once.
PAIRS = 1 << 22
_SLOTS = 22
_PLAIN = _LOWER.copy()
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 32
# Code points of punctuation and spaces, and of scripts written without spaces
_MARKS = ((0x2000, 0x206F), (0x3000, 0x303F), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF))


def _within(code: np.ndarray, ranges: tuple) -> np.ndarray:
    out = np.zeros(len(code), bool)
    for lo, hi in ranges:
        out |= (lo <= code) & (code <= hi)
    return out


def _spaced(plain: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unicode punctuation as spaces, and spaces around characters of scripts without spaces."""
    two = np.flatnonzero(plain[:-1] == 0xC2)
    two = two[(plain[two + 1] >= 0xA0) & ~np.isin(plain[two + 1], (0xAA, 0xB5, 0xBA))]
    plain[two] = plain[two + 1] = 32
    three = np.flatnonzero(plain[:-2] >> 4 == 0xE)
    if not len(three):
        return plain, off
    code = (plain[three].astype(np.int32) & 15) << 12 | (plain[three + 1].astype(np.int32) & 63) << 6 | plain[three + 2] & 63
    mark = three[_within(code, _MARKS)]
    plain[mark] = plain[mark + 1] = plain[mark + 2] = 32
    own = three[_within(code, _UNSPACED)]
    if not len(own):
        return plain, off
    cut = np.sort(np.concatenate([own, own + 3]))
    spaced = np.insert(plain, cut, 32)
    moved = off + np.searchsorted(cut, off)
    moved[-1] = len(spaced)
    return spaced, moved


def _tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    plain = _PLAIN[data]
    if len(plain) > 2 and (plain >= 0xC2).any():
        plain, off = _spaced(plain, off)
    start, end, first = words(plain, off)
    return word_hashes(plain, start, end), first


def _grams(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word at each place, and of the pair; the last place has no pair."""
    one = mixed(tokens)
    return one, mixed(one[:-1] * np.uint64(3) + tokens[1:])


def _needed(n: int, threshold: float) -> int:
    """Least alignment score of an item of n words that counts: short items count whole."""
    return max(1, math.ceil((threshold if n >= LEAST_WORDS else 1) * 2 * n - 1e-6))


def align(item: np.ndarray, text: np.ndarray, match: int = 2, miss: int = -1, gap: int = -1) -> int:
    """Best local alignment score (Smith-Waterman, linear gaps)."""
    above, best = np.zeros(len(text) + 1, np.int64), 0
    slope = -gap * np.arange(len(text) + 1)
    for word in item:
        row = np.zeros_like(above)
        row[1:] = np.maximum(np.maximum(above[:-1] + np.where(text == word, match, miss), above[1:] + gap), 0)
        above = np.maximum(np.maximum.accumulate(row + slope) - slope, 0)
        best = max(best, int(above.max()))
    return best


def _bound(item: np.ndarray, text: np.ndarray) -> int:
    """No alignment scores more: each matched word, and each matched pair, is in the text."""
    there = set(text.tolist())
    words = sum(w in there for w in item.tolist())
    pairs = int(np.isin(_grams(item)[1], _grams(text)[1]).sum()) if words else 0
    return min(2 * words, words + pairs + 1)


class Wanted:
    """Place of a gram among sorted distinct ones, by a table over its first bits."""

    def __init__(self, grams: np.ndarray):
        self.grams = grams
        self.first = np.searchsorted(grams >> np.uint64(64 - _SLOTS), np.arange((1 << _SLOTS) + 1, dtype=np.uint64)).astype(np.int32)
        self.most = int(np.diff(self.first).max()) if len(grams) else 0

    def places(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``grams`` are wanted, and which they are."""
        slot = (grams >> np.uint64(64 - _SLOTS)).astype(np.int64)
        at = np.flatnonzero(self.first[slot + 1] > self.first[slot])
        own, low, high = grams[at], self.first[slot[at]], self.first[slot[at] + 1]
        found = np.full(len(at), -1, np.int32)
        for k in range(self.most):
            i = np.flatnonzero((low + k < high) & (found < 0))
            hit = i[self.grams[low[i] + k] == own[i]]
            found[hit] = low[hit] + k
        ok = found >= 0
        return at[ok], found[ok]

    def hits(self, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places whose word, or pair within one row, is wanted; which it is; their rows."""
        out = []
        for size, grams in enumerate(_grams(tokens), 1):
            at, k = self.places(grams)
            row = np.searchsorted(first, at, side="right") - 1
            ok = at + size <= first[row + 1]
            out.append((at[ok], k[ok], row[ok]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Seeds:
    """Test items of a block, by their seeds.  ``count`` holds the occurrences of each of ``grams``."""

    def __init__(self, ids: list, tokens: list[np.ndarray], grams: np.ndarray, count: np.ndarray, threshold: float):
        self.ids, self.tokens, self.threshold = ids, tokens, threshold
        size = np.array([len(t) for t in tokens], np.int64)
        score = np.array([_needed(int(n), threshold) for n in size], np.int64)
        self.score, self.span, self.need = score, 3 * size - score, np.ones(len(tokens), np.int64)
        gram, item, which = [], [], []
        for i, t in enumerate(tokens):
            own = np.concatenate(_grams(t))
            n = count[np.searchsorted(grams, own)]
            order = np.argsort(n, kind="stable")
            least = 2 * len(t) - int(score[i]) + 1
            cost = np.cumsum(n[order])
            take = max(least, int(np.searchsorted(cost, 2 * cost[least - 1], side="right"))) if least <= len(own) else len(own)
            self.need[i] = max(1, 1 + take - least)
            order = order[:take][n[order[:take]] > 0]
            gram.append(own[order]), item.append(np.full(len(order), i)), which.append(order)
        gram, item, which = (np.concatenate([*x, np.zeros(0, t)]).astype(t) for x, t in ((gram, np.uint64), (item, np.int64), (which, np.int64)))
        order = np.lexsort((item, gram))
        self.wanted = Wanted(np.unique(gram))
        self.width = int(which.max()) + 1 if len(which) else 1
        # entries by (gram, item)
        self.item, self.which = item[order].astype(np.int64), which[order].astype(np.int64)
        self.entry = np.searchsorted(self.wanted.grams, gram[order]) * len(ids) + self.item

    def pairs(self, hit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(hit, entry) of every item of every hit, in portions of bounded size: by ranges of items."""
        n = len(self.ids)
        total = int((np.searchsorted(self.entry, (hit + 1) * n) - np.searchsorted(self.entry, hit * n)).sum())
        edges = np.linspace(0, n, min(n, -(-total // PAIRS)) + 1).astype(np.int64)
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            a, b = np.searchsorted(self.entry, hit * n + lo), np.searchsorted(self.entry, hit * n + hi)
            size = b - a
            first = np.cumsum(size) - size
            yield np.repeat(np.arange(len(hit)), size), np.arange(size.sum()) + np.repeat(a - first, size)


def count_grams(docs: DataFrame, grams: np.ndarray) -> np.ndarray:
    """Occurrences of each of the sorted grams in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(grams)

    def run(batches):
        wanted, total = Wanted(shared.value), np.zeros(len(shared.value), np.int64)
        for _, data, off in text_blocks(batches, limit=1 << 20):
            total += np.bincount(wanted.hits(*_tokens(data, off))[1], minlength=len(total))
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["k", "n"])

    rows = docs.select("text").mapInArrow(tidy(run), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    count = np.zeros(len(grams), np.int64)
    count[rows["k"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return count


def _regions(tokens: np.ndarray, first: np.ndarray, seeds: Seeds) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Where in which row which item may be: stretches with enough different seeds."""
    out: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    at, gram, row = seeds.wanted.hits(tokens, first)
    for hit, entry in seeds.pairs(gram.astype(np.int64)):
        if not len(hit):
            continue
        item = seeds.item[entry]
        stretch = (at[hit] - first[row[hit]]) // seeds.span[item]
        both, group = np.unique(row[hit] * len(seeds.ids) + item, return_inverse=True)
        most = int(stretch.max()) + 2
        found, n = np.unique(np.unique((group * most + stretch) * seeds.width + seeds.which[entry]) // seeds.width, return_counts=True)
        follows = np.append(np.where(np.diff(found) == 1, n[1:], 0), 0)
        r, i = np.divmod(both[found // most], len(seeds.ids))
        ok = np.flatnonzero(n + follows >= seeds.need[i])
        for j in ok.tolist():
            k, span, base = int(found[j] % most), int(seeds.span[i[j]]), int(first[r[j]])
            lo, hi = max(base + (k - 1) * span, base), min(base + (k + 3) * span, int(first[r[j] + 1]))
            old = out[int(r[j]), int(i[j])]
            if old and old[-1][1] >= lo:
                old[-1] = (old[-1][0], max(old[-1][1], hi))
            else:
                old.append((lo, hi))
    return out


def matches_of(tokens: np.ndarray, first: np.ndarray, seeds: Seeds) -> list[tuple[int, int, float]]:
    """(row, item, score) of the pairs that reach the threshold."""
    out = []
    for (r, i), regions in _regions(tokens, first, seeds).items():
        item, need, best = seeds.tokens[i], seeds.score[i], 0
        for lo, hi in regions:
            text = tokens[lo:hi]
            if _bound(item, text) >= need:
                best = max(best, align(item, text))
        if best >= need:
            out.append((r, i, best / (2 * len(item))))
    return out


def blocks_of(benchmark: DataFrame, item_id: str, text: str):
    """(ids, tokens) of the test items, a block at a time."""
    items = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{text}`").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for k in range(n):
        rows = items.withColumn("text", F.lower("text")).where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        ids, tokens = [], []
        for r in rows:
            data = np.frombuffer(r.text.encode(), np.uint8)
            t, _ = _tokens(data, np.array([0, len(data)]))
            if len(t):
                ids.append(r.item_id), tokens.append(t)
        if ids:
            yield ids, tokens


def _seeds(docs: DataFrame, benchmark: DataFrame, item_id: str, text: str, threshold: float):
    for ids, tokens in blocks_of(benchmark, item_id, text):
        grams = np.unique(np.concatenate([g for t in tokens for g in _grams(t)]))
        yield docs.sparkSession.sparkContext.broadcast(Seeds(ids, tokens, grams, count_grams(docs, grams), threshold))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, score of every document that holds a test item, copied or edited."""
    spark = docs.sparkSession
    docs = id_text(docs, doc_id, text).withColumn("text", F.lower("text"))
    schema = "doc_id long, item_id long, score double"
    out = spark.createDataFrame([], schema)
    for shared in _seeds(docs, benchmark, item_id, item_text, threshold):

        def run(batches, shared=shared):
            for rows, data, off in text_blocks(batches, limit=1 << 20):
                seeds = shared.value
                got = matches_of(*_tokens(data, off), seeds)
                if got:
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array([g[0] for g in got])), pa.array([seeds.ids[g[1]] for g in got], pa.int64()), pa.array([g[2] for g in got])], names=["doc_id", "item_id", "score"])

        out = out.unionByName(docs.mapInArrow(tidy(run), schema))
    return out


def without(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item; no shuffle."""
    low = "low"
    while low in docs.columns:
        low += "_"
    schema = docs.schema
    for shared in _seeds(docs.select(F.lower(F.col(f"`{text}`")).alias("text")), benchmark, item_id, item_text, threshold):

        def run(batches, shared=shared):
            for rows, data, off in text_blocks(batches, low, limit=1 << 20):
                keep = np.ones(rows.num_rows, bool)
                keep[[g[0] for g in matches_of(*_tokens(data, off), shared.value)]] = False
                yield rows.select(schema.names).filter(pa.array(keep))

        docs = docs.withColumn(low, F.lower(F.col(f"`{text}`"))).mapInArrow(tidy(run), schema)
    return docs
