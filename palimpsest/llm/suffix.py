"""Removal of bytes in strings that repeat anywhere: distributed merge sort of suffixes.

Suffixes are sampled at anchors, and those whose prefix occurs once are left out (see
``anchors``); every byte removed is found in the merge.  Each task sorts its suffixes,
front-codes them (the length of the prefix shared with the suffix before, then the
rest) and cuts the sorted run at splitters sampled from all suffixes.  A partition's
loser tree merges the runs.  It knows for each run how long a prefix its head shares
with the last suffix that left the tree: heads with different such lengths are ordered
by them alone, equal ones are compared from there on, so no known prefix is compared
again.  The merge gives the order and the common prefix lengths; with the same for the
bytes before the suffixes, equal windows have equal places in both.

Suffixes of one task with equal surroundings are settled in its sorted run; one of
them, marked, goes on for the others' sake.

Defined results: a null text is empty; documents shorter than ``window`` bytes lose
nothing; strings never reach across documents; repeated rows and rows with one doc_id
are documents of their own; offsets are bytes of UTF-8, so what is kept may start
within a character; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import SPANS, Kind, by_bucket, fetch, fetch_few, kept, numbered, padded, repeated_spans, runs_of, span_rows, suffixes, surroundings, with_spans
from .common import tidy

WINDOW = 200
#: Suffixes that a task sorts at once, and that are resolved at once after the merge.
RUN = 1 << 16
#: Suffixes sampled for the splitters, about.
SAMPLE = 1 << 15


def _byte_tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data.astype(np.uint64), off


def kind_of(window: int = WINDOW) -> Kind:
    return Kind(_byte_tokens, window, max(1, window * 36 // 100), block=1 << 19)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the prefix that each two rows share."""
    if not a.shape[1]:
        return np.zeros(len(a), np.int64)
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def shared(a: np.ndarray) -> np.ndarray:
    """Length of the prefix each row shares with the row before; 0 for the first."""
    out = np.zeros(len(a), np.int64)
    out[1:] = _common(a[1:], a[:-1])
    return out


def sort_rows(a: np.ndarray) -> np.ndarray:
    """Order of the rows of a byte matrix."""
    rows, width = a.tobytes(), a.shape[1]
    keys = [rows[i : i + width] for i in range(0, len(rows), width)] if width else [b""] * len(a)
    return np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)


def front_coded(suffix: np.ndarray, *meta: np.ndarray) -> bytes:
    """A sorted run as bytes: count, shared lengths, rests, then the other columns."""
    lcp = shared(suffix)
    rest = suffix[np.arange(suffix.shape[1]) >= lcp[:, None]]
    head = np.array([len(suffix), suffix.shape[1]], np.int64)
    return zstandard.compress(b"".join([head.tobytes(), lcp.astype(np.int32).tobytes(), *(np.ascontiguousarray(m).tobytes() for m in meta), rest.tobytes()]), 1)


_META = (np.int64, np.int32, np.int32, np.int32, np.uint8)  # uid, place, near, far, settled


class Run:
    """Reads a front-coded run, one suffix after the other."""

    def __init__(self, blob: bytes, before: int):
        raw = zstandard.decompress(blob)
        self.n, self.width = (int(x) for x in np.frombuffer(raw, np.int64, 2))
        self.lcps = np.frombuffer(raw, np.int32, self.n, 16).tolist()
        at, cols = 16 + 4 * self.n, []
        for kind in _META:
            cols.append(np.frombuffer(raw, kind, self.n, at))
            at += cols[-1].nbytes
        cols.append(np.frombuffer(raw, np.uint8, self.n * before, at).reshape(self.n, before))
        self.columns = cols
        self.rests, self.at, self.next, self.head = raw, at + self.n * before, 0, b""

    def advance(self) -> int:
        """To the next suffix; the length it shares with the one before, or -1 at the end."""
        if self.next >= self.n:
            return -1
        lcp = self.lcps[self.next]
        to = self.at + self.width - lcp
        self.head = self.head[:lcp] + self.rests[self.at : to]
        self.at = to
        self.next += 1
        return lcp


def _first_difference(a: bytes, b: bytes, at: int) -> int:
    """First place from ``at`` on where two strings of equal length differ."""
    n = len(a)
    while at < n:
        x = int.from_bytes(a[at : at + 32]) ^ int.from_bytes(b[at : at + 32])
        if x:
            return at + min(32, n - at) - (x.bit_length() + 7) // 8
        at += 32
    return n


def merge(runs: list[Run]) -> Iterator[tuple[int, int]]:
    """(run, shared length with the suffix before) in sorted order, by a loser tree."""
    k = 1
    while k < len(runs):
        k *= 2
    known = [run.advance() for run in runs] + [-1] * (k - len(runs))  # shared with the last that left
    losers = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known length becomes what it shares with the winner."""
        ha, hb = known[a], known[b]
        if ha > hb:
            return a, b
        if hb > ha:
            return b, a
        if ha < 0:
            return a, b
        x, y = runs[a].head, runs[b].head
        at = _first_difference(x, y, ha)
        if at == len(x) or x[at] < y[at]:
            known[b] = at
            return a, b
        known[a] = at
        return b, a

    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if k > 1 else 0
    while known[top] >= 0:
        yield top, known[top]
        known[top] = runs[top].advance()
        node = (top + k) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def _repeats(lcp: np.ndarray, near: np.ndarray, far: np.ndarray, before: np.ndarray, kind: Kind) -> np.ndarray:
    """mark[i, d]: the window that starts d bytes before suffix i stands elsewhere.  Rows are in sorted order."""
    m = len(lcp)
    group = np.cumsum(lcp < kind.prefix)
    by_left = sort_rows(np.concatenate([group.astype(">u8").view(np.uint8).reshape(m, 8), before], axis=1))
    common = shared(before[by_left])
    common[np.concatenate([[True], np.diff(group[by_left]) != 0])] = -1
    mark = np.zeros((m, kind.reach + 1), bool)
    place = np.empty(m, np.int64)
    for d in range(kind.reach + 1):
        i = np.flatnonzero((near <= d) & (d <= far))
        if len(i) < 2:
            continue
        after = np.cumsum(lcp < kind.window - d)
        place[by_left] = np.cumsum(common < d)
        node = ((after << 32) | place)[i]
        by = np.argsort(node)
        same = np.diff(node[by]) == 0
        mark[i[by[1:][same]], d] = True
        mark[i[by[:-1][same]], d] = True
    return mark


def _found(lcp: np.ndarray, uid: np.ndarray, place: np.ndarray, near: np.ndarray, far: np.ndarray, before: np.ndarray, kind: Kind) -> tuple[np.ndarray, ...]:
    """Spans of the windows that repeat among merged suffixes: pairs directly, larger groups by all distances."""
    start = np.flatnonzero(lcp < kind.prefix)
    size = np.diff(np.append(start, len(lcp)))
    a = start[size == 2]
    b = a + 1
    low = np.maximum(np.maximum(near[a], near[b]), kind.window - lcp[b])
    high = np.minimum(np.minimum(far[a], far[b]), _common(before[a], before[b]))
    ok = low <= high
    i, low, high = np.concatenate([a[ok], b[ok]]), np.tile(low[ok], 2), np.tile(high[ok], 2)
    out = [(uid[i], place[i] - high, place[i] - low + kind.window)]
    i = np.flatnonzero(np.repeat(size > 2, size))
    if len(i):
        out.append(runs_of(_repeats(lcp[i], near[i], far[i], before[i], kind), uid[i], place[i], kind.window))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def splitters(asked: DataFrame, docs: DataFrame, kind: Kind, buckets: int) -> list[bytes]:
    """Prefixes that cut all candidates into ``buckets`` parts, from a sample of bounded size.  They only decide who sorts what."""
    n = asked.count()
    if n < 2 or buckets < 2:
        return []
    few = fetch_few(asked.sample(min(1.0, SAMPLE / n), seed=11), docs)

    def run(batches):
        for batch in batches:
            for _, _, data, pieces in suffixes(batch):
                raw = data.tobytes()
                for at, *_ in pieces:
                    yield pa.RecordBatch.from_arrays([pa.array([raw[a : a + kind.prefix] for a in at[:: max(1, len(at) // 256)]], pa.binary())], names=["prefix"])

    found = sorted(bytes(r.prefix) for r in few.mapInArrow(run, "prefix binary").collect())
    return sorted({found[len(found) * k // buckets] for k in range(1, buckets)}) if found else []


def _sort(kind: Kind, shared_cuts) -> callable:
    window = kind.window

    def flush(held: list[tuple[np.ndarray, ...]], cuts: list[bytes]) -> pa.RecordBatch:
        uid, at, near, far, before, after = (np.concatenate(x) for x in zip(*held, strict=True))
        ends = np.stack([near, far], axis=1).astype(">u4").view(np.uint8)
        order = sort_rows(np.concatenate([after, before, ends], axis=1))
        uid, at, near, far, before, after, ends = (x[order] for x in (uid, at, near, far, before, after, ends))
        new = np.ones(len(order), bool)
        new[1:] = (after[1:] != after[:-1]).any(axis=1) | (before[1:] != before[:-1]).any(axis=1) | (ends[1:] != ends[:-1]).any(axis=1)
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(order)))
        i = np.flatnonzero(np.repeat(size > 1, size))
        spans = span_rows(uid[i], at[i] - far[i], at[i] - near[i] + window)
        after = after[start]
        raw = after.tobytes()
        rows = [raw[k : k + window] for k in range(0, len(raw), window)]
        edge = [0, *(bisect_left(rows, c) for c in cuts), len(rows)]
        bucket, blobs = [], []
        for b, (lo, hi) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
            if hi > lo:
                s = start[lo:hi]
                bucket.append(b)
                blobs.append(front_coded(after[lo:hi], *(c.astype(t) for c, t in zip((uid[s], at[s], near[s], far[s], size[lo:hi] > 1), _META, strict=True)), before[s]))
        n = spans.num_rows
        to = (spans.column(0).to_numpy() % (len(cuts) + 1)).astype(np.int32)
        none = pa.nulls(len(blobs), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.array(bucket, np.int32), to])), pa.array(blobs + [None] * n, pa.binary()), pa.concat_arrays([pa.nulls(len(blobs), pa.int64()), spans.column(0)]), *(pa.concat_arrays([none, spans.column(k)]) for k in (1, 2))], names=["bucket", "run", "uid", "begin", "stop"])

    def run(batches):
        cuts = shared_cuts.value
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in batches:
            for uid, _, data, pieces in suffixes(batch):
                room = padded(data, kind)
                for at, near, far, _ in pieces:
                    held.append((np.full(len(at), uid), at, near, far, *surroundings(room, at, near, far, kind)))
                    n += len(at)
                    if n >= RUN:
                        yield flush(held, cuts)
                        held, n = [], 0
        if n:
            yield flush(held, cuts)

    return run


def _combine(kind: Kind) -> callable:
    def run(batches):
        blobs = []
        for b in batches:
            spans = b.select(["uid", "begin", "stop"]).filter(b.column("uid").is_valid())
            if spans.num_rows:
                yield spans
            blobs += b.column("run").drop_null().to_pylist()
        if not blobs:
            return
        runs = [Run(x, kind.reach) for x in blobs]
        del blobs
        offset = np.cumsum([0] + [r.n for r in runs])
        uid, place, near, far, settled, before = (np.concatenate([r.columns[k] for r in runs]) for k in range(6))

        def done(r: list[int], k: list[int], lcp: list[int]) -> pa.RecordBatch:
            i, common = offset[np.array(r)] + np.array(k), np.array(lcp)
            common[0] = 0
            u, b, s = _found(common, uid[i], place[i].astype(np.int64), near[i].astype(np.int64), far[i].astype(np.int64), before[i], kind)
            return span_rows(u, b, s)

        at = [0] * len(runs)
        which, where, common = [], [], []
        for r, lcp in merge(runs):
            if lcp < kind.prefix and len(which) >= RUN:
                yield done(which, where, common)
                which, where, common = [], [], []
            which.append(r)
            where.append(at[r])
            common.append(lcp)
            at[r] += 1
        if which:
            yield done(which, where, common)

    return run


def _resolve(asked: DataFrame, docs: DataFrame, kind: Kind, buckets: int) -> DataFrame:
    cuts = splitters(asked, docs, kind, buckets)
    shared_cuts = docs.sparkSession.sparkContext.broadcast(cuts)
    sent = fetch(asked, docs, buckets).mapInArrow(tidy(_sort(kind, shared_cuts)), "bucket int, run binary, uid long, begin int, stop int")
    return by_bucket(sent, len(cuts) + 1).mapInArrow(tidy(_combine(kind)), SPANS)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, bytes, np.ndarray]]:
    """(batch, row, text, which bytes are kept) of ``with_spans``."""
    unzip = zstandard.ZstdDecompressor()
    for b in batches:
        z, spans = b.column("z"), b.column("spans")
        for k in range(b.num_rows):
            raw = unzip.decompress(z[k].as_py())
            yield b, k, raw, kept(len(raw), spans[k])


def remove_digests(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches):
        for b in batches:
            found = []
            for _, _, raw, keep in _texts([b]):
                starts = int((np.diff(keep.astype(np.int8), prepend=1) == -1).sum())
                own = raw if keep.all() else np.frombuffer(raw, np.uint8)[keep].tobytes()
                found.append((len(raw), len(raw) - len(own), starts, hashlib.sha256(own).hexdigest()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([f[i] for f in found], pa.int64()) for i in range(3)), pa.array([f[3] for f in found], pa.string())], names=names)

    rows = numbered(docs, doc_id, text)
    return with_spans(rows, repeated_spans(rows, kind_of(window), _resolve), "doc_id").mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The operator's general form: doc_id, text and the byte spans (begin, stop) to remove; null where there is none."""
    rows = numbered(docs, doc_id, text)
    spans = repeated_spans(rows, kind_of(window), _resolve)
    gone = spans.groupBy("uid").agg(F.collect_list(F.struct("begin", "stop")).alias("spans"))
    return rows.join(gone, "uid", "left").select("doc_id", "text", "spans")
