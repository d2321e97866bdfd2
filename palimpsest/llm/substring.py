"""Removal of passages that an earlier document has: prefix-partitioned suffix trees.

Suffixes of words are sampled at anchors, and those whose prefix occurs once are left
out (see ``anchors``).  All suffixes with one prefix form a group; a prefix with too
many different surroundings has been made longer, with denser suffixes, before they
are dealt out, until every group fits in memory.  Of each group a subtree of the words
from the suffix on and one of the words before it are built from the words themselves:
sorted, with the number of words that neighbours share, so that a node at depth t is a
run of neighbours that share t words.  Leaves that share no whole window with a
neighbour are dropped.  Suffixes in one node of both trees, a window deep together,
repeat it, and all but those of the document with the least id lose it.

Suffixes of one task with equal surroundings are settled there, but for those of its
earliest document, whose places travel as one row.

Defined results: null and blank texts have no words; documents shorter than a window
lose nothing; a repeat inside one document, or between rows with one doc_id, removes
nothing; a null doc_id comes after all others; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import SPANS, Kind, by_bucket, fetch, kept, numbered, repeated_spans, runs_of, span_rows, suffixes, with_spans
from .common import tidy, word_hashes, words
from .suffix import shared, sort_rows

WINDOW = 50
#: Suffixes that a task deals out at once.
RUN = 1 << 16
#: Parts of a bucket that are read one after the other.
PARTS = 16


def _word_tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, first = words(data, off)
    return word_hashes(data, start, end), first


def kind_of(window: int = WINDOW) -> Kind:
    return Kind(_word_tokens, window, max(1, window * 2 // 5))


def _tree(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves of the groups' subtrees in order, and how many words each shares with the one before (-1 where a group begins)."""
    m = len(group)
    order = sort_rows(np.concatenate([group.astype(">u4").view(np.uint8).reshape(m, 4), np.ascontiguousarray(rows).view(np.uint8).reshape(m, -1)], axis=1))
    common = shared(rows[order])
    common[np.concatenate([[True], np.diff(group[order]) != 0])] = -1
    return order, common


def _repeats(group: np.ndarray, rank: np.ndarray, near: np.ndarray, far: np.ndarray, before: np.ndarray, after: np.ndarray, kind: Kind) -> np.ndarray:
    """mark[i, d]: the window that starts d words before suffix i stands in an earlier document."""
    m, window = len(group), kind.window
    mark = np.zeros((m, kind.reach + 1), bool)
    order, common = _tree(group, after)
    # a leaf whose deepest inner node is too shallow for all its windows is alone in them
    deepest = np.maximum(common, np.append(common[1:], -1))
    alive = np.zeros(m, bool)
    alive[order] = deepest >= window - far[order]
    right = np.empty(m, np.int64)
    left = np.empty(m, np.int64)
    by_left, common_left = _tree(group, before)
    for d in range(kind.reach + 1):
        i = np.flatnonzero(alive & (near <= d) & (d <= far))
        if len(i) < 2:
            continue
        right[order] = np.cumsum(common < window - d)
        left[by_left] = np.cumsum(common_left < d)
        node = (right[i] << 32) | left[i]
        by = np.lexsort((rank[i], node))
        start = np.flatnonzero(np.concatenate([[True], np.diff(node[by]) != 0]))
        least = np.repeat(rank[i[by[start]]], np.diff(np.append(start, len(by))))
        mark[i[by], d] = rank[i[by]] > least
    return mark


def _deal(kind: Kind, buckets: int):
    """Suffixes with their surroundings, packed by prefix."""
    window, parts = kind.window, buckets * PARTS

    def flush(held: dict[tuple, list], spans: list) -> pa.RecordBatch:
        rows: list[list[tuple]] = []
        where: dict[int, int] = {}
        done = list(spans)
        for (key, near, far, text), found in held.items():
            least = min(f[0] for f in found)
            own: dict[tuple[int, int], list[int]] = {}
            for rank, uid, at in found:
                if rank > least:
                    done.append((uid, at - far, at - near + window))
                else:
                    own.setdefault((rank, uid), []).append(at)
            part = ((key & 0xFFFFFFFFFFFF) >> 16) * parts >> 32
            if part not in where:
                where[part] = len(rows)
                rows.append([])
            rows[where[part]] += [(key, rank, uid, at, near, far, text) for (rank, uid), at in own.items()]
        s = span_rows(*(np.array(x, np.int64) for x in zip(*done, strict=True))) if done else None
        blobs = []
        for r in rows:
            cols = [pa.array([x[k] for x in r], t) for k, t in enumerate(_ROW)]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _ROWS) as w:
                w.write_batch(pa.RecordBatch.from_arrays(cols, schema=_ROWS))
            blobs.append(zstandard.compress(sink.getvalue(), 1))
        n = s.num_rows if s is not None else 0
        part = np.array(list(where), np.int32)
        to = (s.column(0).to_numpy() % buckets).astype(np.int32) if n else np.zeros(0, np.int32)
        flat = [pa.concat_arrays([pa.nulls(len(blobs), t), s.column(k)]) if n else pa.nulls(len(blobs), t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([part // PARTS, to])), pa.array(np.concatenate([part, np.full(n, -1, np.int32)])), pa.array(blobs + [None] * n, pa.binary()), *flat], names=["bucket", "part", "rows", "uid", "begin", "stop"])

    def run(batches):
        held: dict[tuple, list] = {}
        n = 0
        for batch in batches:
            for uid, rank, data, pieces in suffixes(batch):
                text = data.tobytes().split()
                for at, near, far, key in pieces:
                    for a, lo, hi, k in zip(at.tolist(), near.tolist(), far.tolist(), key.tolist(), strict=True):
                        held.setdefault((k, lo, hi, b" ".join(text[a - hi : a - lo + window])), []).append((rank, uid, a))
                    n += len(at)
                    if n >= RUN:
                        yield flush(held, [])
                        held, n = {}, 0
        if n:
            yield flush(held, [])

    return run


_ROW = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary())
_ROWS = pa.schema(list(zip(("key", "rank", "uid", "at", "near", "far", "text"), _ROW, strict=True)))


def _subtrees(kind: Kind):
    """Spans found in the subtrees of a bucket's groups, a part of the bucket after the other."""
    window, reach = kind.window, kind.reach

    def done(blobs: list[bytes]) -> pa.RecordBatch:
        t = pa.concat_tables([pa.ipc.open_stream(zstandard.decompress(x)).read_all() for x in blobs]).combine_chunks()
        key, rank, uid, near, far = (t.column(c).to_numpy().astype(np.int64) for c in ("key", "rank", "uid", "near", "far"))
        group = np.unique(key, return_inverse=True)[1]
        several = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(several):
            return span_rows(*(np.zeros(0, np.int64),) * 3)
        t, group, rank, uid, near, far = t.take(pa.array(several)), group[several], rank[several], uid[several], near[several], far[several]
        code: dict[bytes, int] = {}
        rows = [[code.setdefault(w, len(code) + 1) for w in x.split(b" ")] for x in t.column("text").to_pylist()]
        flat = np.fromiter((w for r in rows for w in r), np.int32)
        size = np.array([len(r) for r in rows])
        first = np.cumsum(size) - size
        room = np.concatenate([flat, np.zeros(1, np.int32)])
        back, on = np.arange(reach), np.arange(window)
        before = room[np.where(back < far[:, None], (first + far)[:, None] - 1 - back, len(flat))]
        after = room[np.where(on < (window - near)[:, None], (first + far)[:, None] + on, len(flat))]
        mark = _repeats(group, rank, near, far, before, after, kind)
        places = t.column("at").combine_chunks()
        at, times = places.values.to_numpy().astype(np.int64), np.diff(places.offsets.to_numpy())
        return span_rows(*runs_of(np.repeat(mark, times, axis=0), np.repeat(uid, times), at, window))

    def run(batches):
        held, part = [], -1
        for b in batches:
            spans = b.select(["uid", "begin", "stop"]).filter(b.column("uid").is_valid())
            if spans.num_rows:
                yield spans
            for p, x in zip(b.column("part").to_pylist(), b.column("rows").to_pylist(), strict=True):
                if x is None:
                    continue
                if p != part and held:
                    yield done(held)
                    held = []
                part = p
                held.append(x)
        if held:
            yield done(held)

    return run


def _resolve(asked: DataFrame, docs: DataFrame, kind: Kind, buckets: int) -> DataFrame:
    dealt = fetch(asked, docs, buckets).mapInArrow(tidy(_deal(kind, buckets)), "bucket int, part int, rows binary, uid long, begin int, stop int")
    return by_bucket(dealt, buckets).sortWithinPartitions("part").mapInArrow(tidy(_subtrees(kind)), SPANS)


def _each(b: pa.RecordBatch):
    """For each row of ``with_spans``: its number of words, and its kept words."""
    unzip = zstandard.ZstdDecompressor()
    z, spans = b.column("z"), b.column("spans")
    for k in range(b.num_rows):
        own = unzip.decompress(z[k].as_py()).split()
        yield len(own), [own[i] for i in np.flatnonzero(kept(len(own), spans[k])).tolist()] if spans[k].is_valid else own


def remove_digests(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""

    def run(batches):
        for b in batches:
            found = [(n, n - len(own), hashlib.sha256(b" ".join(own)).hexdigest()) for n, own in _each(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)), pa.array([f[2] for f in found], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = numbered(docs, doc_id, text)
    return with_spans(rows, repeated_spans(rows, kind_of(window), _resolve), "doc_id").mapInArrow(tidy(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The operator's general form: all columns of ``docs``, the text without the repeated words.

    A document that loses nothing keeps its text as it is (a null one too); else kept words are joined by one space.
    """
    unzip = zstandard.ZstdDecompressor

    def run(batches):
        for b in batches:
            raw = [unzip().decompress(x) for x in b.column("z").to_pylist()]
            new = [r if n == len(own) else b" ".join(own) for r, (n, own) in zip(raw, _each(b), strict=True)]
            void = b.column("void").to_pylist()
            text_ = pa.array([None if v else x.decode() for v, x in zip(void, new, strict=True)], pa.string())
            rest = b.column("rest")
            yield pa.RecordBatch.from_arrays([text_ if c == text else rest.field(c) for c in names], names=names)

    names = docs.columns
    rows = numbered(docs, doc_id, text, rest=True)
    return with_spans(rows, repeated_spans(rows.drop("rest", "void"), kind_of(window), _resolve), "void", "rest").mapInArrow(tidy(run), docs.schema)
