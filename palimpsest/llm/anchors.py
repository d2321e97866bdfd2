"""Sampled suffixes: which of them can share a window of tokens, and where their text is.

A window is ``window`` consecutive tokens (bytes or words) of one document.  Its
anchor is the start of the run of tokens with the least hash inside it, the first of
equals: equal windows have equal anchors at equal distance, wherever they stand.  So
suffixes are sampled at anchors only, about one token in (window - prefix) / 2, and a
suffix answers for the windows that start ``near`` to ``far`` tokens before it.

Suffixes that share a window share their prefix.  ``candidates`` counts the prefixes
of all suffixes by hash and drops those that occur once: the hash only ever excludes,
what repeats is decided by the operators on the text itself.  Where more than
``HEAVY`` different surroundings share one prefix (a common line, say), the suffixes
behind it are sampled more densely, which makes the prefix that two of them must
share longer, and are counted again, until the prefix is the whole window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, mixed, stored, text_blocks, tidy

_B = np.uint64(0x5851F42D4C957F2D)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_LOW = np.uint64(0xFFFFFFFF)
#: Windows handled at once; a longer text is cut into pieces that overlap.
PIECE = 1 << 18
#: Suffixes that a task gathers before it sends or sorts them.
HELD = 1 << 21
#: Different surroundings of one prefix that are compared in one task; beyond, the prefix is made longer.
HEAVY = 512
#: Suffixes whose surroundings are taken at once.
CHUNK = 1 << 14
#: Keys (heavy prefixes, or documents that have them) that are sent to every task; more are joined by a shuffle.
SENT_KEYS = 1 << 18
SALTS = 64

Tokens = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Kind:
    """What repeats: tokens of a block (values, and each row's first), the window, and the prefix that suffixes share."""

    tokens: Tokens
    window: int
    prefix: int
    block: int = 1 << 20  # bytes of text turned into tokens at once
    heavy: int = HEAVY

    @property
    def reach(self) -> int:
        """Greatest distance of a served window."""
        return self.window - self.prefix

    def longer(self) -> Kind:
        """Suffixes at an eighth of the distance: so the prefix grows towards the window."""
        return replace(self, prefix=self.window + 1 - -(-(self.reach + 1) // 8))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse from 0 to n; kept for the next block."""
    if not _POWERS or len(_POWERS[0]) <= n:
        up, down = np.full(n + 1, _B), np.full(n + 1, _B_INV)
        up[0] = down[0] = 1
        _POWERS[:] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[0][: n + 1], _POWERS[1][: n + 1]


def _scrambled(values: np.ndarray) -> np.ndarray:
    return mixed(values + np.uint64(0x2545F4914F6CDD1D))


class Spans:
    """Hash of any span of tokens: differences of prefix sums, moved to the origin."""

    def __init__(self, values: np.ndarray):
        up, self.down = _powers(len(values))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(_scrambled(values) * up[:-1], out=self.sums[1:])

    def every(self, size: int) -> np.ndarray:
        """Of each run of ``size`` tokens."""
        return mixed((self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size] + np.uint64(size))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def find_anchors(values: np.ndarray, first: np.ndarray, kind: Kind) -> tuple[np.ndarray, ...]:
    """(row, place in row, least and greatest distance of served windows, prefix hash, hash of all that is served) of a block's anchors."""
    out: list[tuple[np.ndarray, ...]] = []
    w, k = kind.window, kind.prefix
    span = w - k + 1
    for lo in range(0, max(len(values) - w + 1, 0), PIECE):
        part = values[lo : lo + PIECE + w - 1]
        n = len(part) - w + 1
        hash_ = Spans(part)
        runs = hash_.every(k)
        low = (runs & ~_LOW) | np.arange(len(runs), dtype=np.uint64)
        size = 1
        while size * 2 <= span:
            low = np.minimum(low[: len(low) - size], low[size:])
            size *= 2
        if size < span:
            low = np.minimum(low[:n], low[span - size : span - size + n])
        anchor = (low[:n] & _LOW).astype(np.int64)
        row = np.repeat(np.arange(len(first) - 1), np.diff(np.clip(first, lo, lo + n)))
        ok = np.flatnonzero(np.arange(lo + w, lo + w + n) <= first[row + 1])
        if not len(ok):
            continue
        a = anchor[ok]
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(a) != 0) | (np.diff(ok) != 1)]))
        begin, end = ok[cut], ok[np.append(cut[1:], len(ok)) - 1]
        a = a[cut]
        near, far = a - end, a - begin
        served = mixed(hash_(begin, end + w) ^ (near.astype(np.uint64) << np.uint64(32) | far.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
        # the run's hash is the least of its window; hashed once more, keys spread evenly
        out.append((row[begin], a + lo - first[row[begin]], near, far, mixed(runs[a] ^ _B), served))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.view(np.uint64), z.view(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def denser(at: np.ndarray, near: np.ndarray, far: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes every ``step`` tokens before each given one that serve the same windows, each at a distance below ``step``."""
    low = near // step
    n = far // step - low + 1
    back = step * (np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return np.repeat(at, n) - back, np.maximum(np.repeat(near, n) - back, 0), np.minimum(np.repeat(far, n) - back, step - 1)


def padded(values: np.ndarray, kind: Kind) -> np.ndarray:
    """Room for the surroundings of every suffix of a text."""
    return np.concatenate([np.zeros(kind.reach, values.dtype), values, np.zeros(kind.window, values.dtype)])


def surroundings(room: np.ndarray, at: np.ndarray, near: np.ndarray, far: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    """Tokens before each suffix (nearest first) and from it on, as far as served windows go; zero beyond."""
    reach, window = kind.reach, kind.window
    before = room[(at + reach - 1)[:, None] - np.arange(reach)]
    before[np.arange(reach) >= far[:, None]] = 0
    after = room[(at + reach)[:, None] + np.arange(window)]
    after[np.arange(window) >= (window - near)[:, None]] = 0
    return before, after


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length, the first sorted."""
    head = np.array([len(arrays[0])], np.int64).tobytes()
    first = np.diff(arrays[0], prepend=arrays[0].dtype.type(0))
    body = b"".join([np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in (first, *arrays[1:])])
    return zstandard.compress(head + body, 1)


def _unpack(blob: bytes, kinds: tuple) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    n, at, out = int(raw[:8].view(np.int64)[0]), 8, []
    for t in kinds:
        size = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(t).ravel())
        at += n * size
    out[0] = np.cumsum(out[0], dtype=kinds[0])
    return out


def numbered(docs: DataFrame, doc_id: str, text: str, rest: bool = False) -> DataFrame:
    """(doc_id, text, uid, rank): a distinct uid for every row, and the rank by which documents are earlier or later.

    Where every doc_id is there and distinct, it is the uid; else rows are numbered and
    written once.  A null doc_id comes after all others.  ``rest`` adds a struct of the
    other columns of the input.
    """
    other = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(0)]).alias("rest"), F.col(f"`{text}`").isNull().alias("void")]
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), *(other if rest else []))
    docs = docs.withColumn("rank", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    if docs.groupBy("rank").count().where("count > 1 or rank < 0").isEmpty():
        return docs.withColumn("uid", F.col("rank"))
    return stored(docs.withColumn("uid", F.monotonically_increasing_id()), "numbered")


def _groups(key: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values in a sorted array."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def _slices(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal values."""
    start = _groups(key)
    return start, np.append(start, len(key))[1:]


# code: 48 bits of the prefix's hash, 16 of the surroundings'; place -1: a suffix known elsewhere, -2: a heavy prefix
_OPEN = (np.uint64, np.int64, np.int32, np.int32, np.int32)  # code, uid, place, near, far
_KNOWN = (np.int64, np.int32, np.int32, np.int32, np.int64, np.int32, np.int32)  # uid, begin, near, far, key, step, n
_NAMES = ("uid", "begin", "near", "far", "key", "step", "n")
_FOUND = "uid long, begin int, near int, far int, key long, step int, n int"
_SIXTEEN = np.uint64(16)


def _strides(uid, place, near, far, key) -> tuple[np.ndarray, ...]:
    """Suffixes in order of (uid, place), those of a periodic text as one row: ``n`` of them, ``step`` apart."""
    if not len(uid):
        return uid, place, near, far, key, place, place
    same = np.zeros(len(uid), bool)
    same[1:] = (uid[1:] == uid[:-1]) & (near[1:] == near[:-1]) & (far[1:] == far[:-1]) & (key[1:] == key[:-1])
    gap = np.diff(place, prepend=0)
    on = np.zeros(len(uid), bool)
    on[2:] = same[2:] & same[1:-1] & (gap[2:] == gap[1:-1])
    at = np.flatnonzero(~on)
    n = np.diff(np.append(at, len(uid)))
    return uid[at], place[at], near[at], far[at], key[at], np.where(n > 1, gap[np.minimum(at + 1, len(gap) - 1)], 0), n


def _sender(source: Callable, kind: Kind, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs the suffixes of ``source`` by prefix.  Those of a prefix that the task has twice are known to be candidates: only their codes go by prefix."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        uid, place, near, far, key, served = (np.concatenate(x) for x in zip(*held, strict=True))
        code = (key >> _SIXTEEN << _SIXTEEN) | (served >> np.uint64(48))
        order = np.argsort(code, kind="stable")
        code, uid, place, near, far = code[order], uid[order], place[order], near[order], far[order]
        key = code >> _SIXTEEN
        start = _groups(key)
        size = np.diff(np.append(start, len(key)))
        new = np.concatenate([[True], code[1:] != code[:-1]])
        alone, heavy = size == 1, np.add.reduceat(new, start) > kind.heavy
        mark = np.where(np.repeat(alone, size), place, np.where(np.repeat(heavy, size), -2, -1))
        first = np.zeros(len(key), bool)
        first[start] = True
        at = np.flatnonzero(new & (first | ~np.repeat(heavy, size)))
        bucket = ((code[at] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        cuts, ends = _slices(bucket)
        own = mark[at] >= 0
        open_ = [_pack(code[at[a:b]], np.where(own[a:b], uid[at[a:b]], 0), mark[at[a:b]].astype(np.int32), np.where(own[a:b], near[at[a:b]], 0).astype(np.int32), np.where(own[a:b], far[at[a:b]], 0).astype(np.int32)) for a, b in zip(cuts, ends, strict=True)]
        i = np.flatnonzero(~np.repeat(alone, size))
        spread = (mixed(uid[i].view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        by = np.lexsort((place[i], uid[i], spread))
        i, spread = i[by], spread[by]
        known = _strides(uid[i], place[i], near[i], far[i], key[i].view(np.int64))
        to = (mixed(known[0].view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        kcuts, kends = _slices(to)
        packed = [_pack(*(c[a:b].astype(t) for c, t in zip(known, _KNOWN, strict=True))) for a, b in zip(kcuts, kends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([bucket[cuts], to[kcuts]])), pa.array(open_ + [None] * len(packed), pa.binary()), pa.array([None] * len(open_) + packed, pa.binary())], names=["bucket", "open", "known"])

    def run(batches):
        held, n = [], 0
        for found in source(batches):
            held.append(found)
            n += len(found[0])
            if n >= HELD:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return run


def _receiver(kind: Kind) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a bucket: the suffixes whose prefix occurs again, and (uid null) the heavy prefixes."""

    def rows(cols: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(cols[0]), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + (1 << 17)].astype(t)) for c, t in zip(cols, _KNOWN, strict=True)], names=_NAMES)

    def settle(parts: list) -> tuple[list, tuple[np.ndarray, ...], np.ndarray]:
        """What must be kept of the rows so far, the candidates among them, the heavy prefixes."""
        code, uid, place, near, far = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(code, kind="stable")
        code, uid, place, near, far = code[order], uid[order], place[order], near[order], far[order]
        key = code >> _SIXTEEN
        start = _groups(key)
        size = np.diff(np.append(start, len(key)))
        new = np.concatenate([[True], code[1:] != code[:-1]])
        heavy = (np.add.reduceat(new, start) > kind.heavy) | (np.minimum.reduceat(place, start) == -2)
        alive = np.repeat((size > 1) | heavy | (np.minimum.reduceat(place, start) < 0), size)
        go = np.flatnonzero(alive & (place >= 0))
        mark = np.where(alive, np.where(np.repeat(heavy, size), -2, -1), place).astype(np.int32)
        first = np.zeros(len(key), bool)
        first[start] = True
        left = np.flatnonzero(new & (first | ~np.repeat(heavy, size)))
        zero = np.zeros(len(go), np.int32)
        out = uid[go], place[go], near[go], far[go], key[go].view(np.int64), zero, zero + 1
        return [(code[left], uid[left], mark[left], near[left], far[left])], out, key[start][heavy].view(np.int64)

    def run(batches):
        parts, n, heavy = [], 0, np.zeros(0, np.int64)
        for b in batches:
            for x in b.column("known").drop_null().to_pylist():
                yield from rows(tuple(_unpack(x, _KNOWN)))
            for x in b.column("open").drop_null().to_pylist():
                parts.append(tuple(_unpack(x, _OPEN)))
                n += len(parts[-1][0])
                if n > 2 * HELD:
                    parts, out, heavy = settle(parts)
                    yield from rows(out)
                    n = len(parts[0][0])
        if n:
            _, out, heavy = settle(parts)
            yield from rows(out)
        if len(heavy):
            none = [pa.nulls(len(heavy), pa.from_numpy_dtype(t)) for t in _KNOWN]
            yield pa.RecordBatch.from_arrays([*none[:4], pa.array(heavy), *none[5:]], names=_NAMES)

    return run


def by_bucket(df: DataFrame, buckets: int) -> DataFrame:
    """Each bucket to a partition of its own."""
    return df.repartitionById(buckets, F.col("bucket"))


def packed_texts(docs: DataFrame, *more: str) -> DataFrame:
    """Some columns and the compressed text, for a shuffle."""
    docs = docs.select(*more, "text")

    def run(batches):
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            text = pa.array([z.compress(x.as_buffer()) for x in b.column(len(more)).cast(pa.large_binary())], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(more)], text], names=[*more, "z"])

    return docs.mapInArrow(run, docs.drop("text").withColumn("z", F.lit(b"")).schema)


def _asks(asked: DataFrame) -> DataFrame:
    return asked.groupBy("uid").agg(F.collect_list(F.struct("begin", "near", "far", "key", "step", "n")).alias("ask"))


def fetch(asked: DataFrame, docs: DataFrame, buckets: int) -> DataFrame:
    """Texts of documents with the suffixes asked for, in as many partitions as there are buckets: the work on them is much larger than they are."""
    return _asks(asked.repartition(buckets, "uid")).join(packed_texts(docs, "uid", "rank").repartition(buckets, "uid"), "uid")


def fetch_few(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """The same for a sample of suffixes of bounded size: it is sent to the texts."""
    return docs.select("uid", "rank", "text").join(F.broadcast(_asks(asked)), "uid")


def suffixes(batch: pa.RecordBatch, chunk: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, Iterator[tuple[np.ndarray, ...]]]]:
    """(uid, rank, bytes of the text, pieces of (place, near, far, key)) of each row that ``fetch`` returns."""
    unzip = zstandard.ZstdDecompressor()
    packed = "z" in batch.schema.names
    for k in range(batch.num_rows):
        raw = unzip.decompress(batch.column("z")[k].as_py()) if packed else batch.column("text")[k].cast(pa.large_binary()).as_py()
        ask = batch.column("ask")[k].values
        begin, near, far, key, step, n = (ask.field(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("begin", "near", "far", "key", "step", "n"))
        first = np.cumsum(n) - n

        def pieces(begin=begin, near=near, far=far, key=key, step=step, n=n, first=first):
            for lo in range(0, int(n.sum()), chunk):
                i = np.arange(lo, min(lo + chunk, int(n.sum())))
                r = np.searchsorted(first, i, side="right") - 1
                yield begin[r] + step[r] * (i - first[r]), near[r], far[r], key[r]

        yield batch.column("uid")[k].as_py(), batch.column("rank")[k].as_py(), np.frombuffer(raw, np.uint8), pieces()


def parted(asked: DataFrame, heavy: DataFrame, many: int) -> tuple[DataFrame, DataFrame]:
    """Suffixes whose prefix is heavy, and the others."""
    if many > SENT_KEYS:  # heavy keys are hot: each is dealt over some salts
        salted = asked.withColumn("salt", F.pmod(F.xxhash64("uid", "begin"), F.lit(SALTS)))
        keys = heavy.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
        return salted.join(keys, ["key", "salt"], "left_semi").select(asked.columns), salted.join(keys, ["key", "salt"], "left_anti").select(asked.columns)
    keys = asked.sparkSession.sparkContext.broadcast(np.array(sorted(r.key for r in heavy.collect()), np.int64))

    def only(wanted: bool):
        def run(batches):
            for b in batches:
                yield b.filter(pa.array(np.isin(b.column("key").to_numpy(), keys.value) == wanted))

        return asked.mapInArrow(run, asked.schema)

    return only(True), only(False)


def _first_source(kind: Kind) -> Callable:
    def source(batches):
        for rows, data, off in text_blocks(batches, limit=kind.block):
            row, place, near, far, key, served = find_anchors(*kind.tokens(data, off), kind)
            yield rows.column(1).to_numpy(zero_copy_only=False)[row].astype(np.int64), place, near, far, key, served

    return source


def _denser_source(kind: Kind) -> Callable:
    """Of ``fetch``ed suffixes with heavy prefixes: denser ones with the prefix of ``kind``."""
    up = _powers(kind.window + kind.reach)[0]

    def hashed(x: np.ndarray) -> np.ndarray:
        return mixed((_scrambled(x.astype(np.uint64)) * up[: x.shape[1]]).sum(axis=1, dtype=np.uint64))

    def source(batches):
        for batch in batches:
            for uid, _, data, pieces in suffixes(batch, CHUNK // 8):
                values, _ = kind.tokens(data, np.array([0, len(data)]))
                room = padded(values, kind)
                for at, near, far, _ in pieces:
                    at, near, far = denser(at, near, far, kind.reach + 1)
                    before, after = surroundings(room, at, near, far, kind)
                    key = hashed(after[:, : kind.prefix])
                    served = hashed(np.concatenate([before, after], axis=1)) ^ mixed(near.astype(np.uint64) << np.uint64(32) | far.astype(np.uint64))
                    yield np.full(len(at), uid), at, near, far, key, served

    return source


SPANS = "uid long, begin int, stop int"
Resolve = Callable[[DataFrame, DataFrame, Kind, int], DataFrame]


def repeated_spans(docs: DataFrame, kind: Kind, resolve: Resolve) -> DataFrame:
    """(uid, begin, stop): spans, in tokens, of every repeated window of ``numbered`` documents.

    ``resolve`` gets candidates, documents, the kind and the number of buckets, and
    decides on the text itself.
    """
    buckets = bucket_count(docs)
    sent = docs.select("text", "uid").mapInArrow(tidy(_sender(_first_source(kind), kind, buckets)), "bucket int, open binary, known binary")
    spans = docs.sparkSession.createDataFrame([], SPANS)
    while True:
        found = stored(by_bucket(sent, buckets).mapInArrow(tidy(_receiver(kind)), _FOUND), "suffixes")
        asked, heavy = found.where("uid is not null"), found.where("uid is null").select("key")
        many = heavy.count() if kind.reach else 0  # a prefix that is the window has no surroundings
        if many:
            more, asked = parted(asked, heavy, many)
        if not asked.isEmpty():
            spans = spans.unionByName(resolve(asked, docs, kind, buckets))
        if not many:
            return spans
        kind = kind.longer()
        ids = more.select("uid").distinct()
        docs = docs.join(F.broadcast(ids) if ids.count() <= SENT_KEYS else ids, "uid", "left_semi")
        sent = fetch(more, docs, buckets).mapInArrow(tidy(_sender(_denser_source(kind), kind, buckets)), "bucket int, open binary, known binary")


def merged(uid: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of spans by document."""
    if not len(uid):
        return uid.astype(np.int64), begin.astype(np.int64), stop.astype(np.int64)
    order = np.lexsort((begin, uid))
    uid, begin, stop = uid[order], begin[order].astype(np.int64), stop[order].astype(np.int64)
    doc = np.cumsum(np.concatenate([[0], uid[1:] != uid[:-1]]))
    top = int(stop.max()) + 1
    reach = np.maximum.accumulate(stop + doc * top)
    new = np.concatenate([[True], begin[1:] + doc[1:] * top > reach[:-1]])
    at = np.flatnonzero(new)
    return uid[at], begin[at], reach[np.append(at[1:], len(uid)) - 1] - doc[at] * top


def runs_of(mark: np.ndarray, uid: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the marked windows; mark[i, d]: the window that starts d tokens before suffix i."""
    pad = np.zeros((len(mark), 1), bool)
    edge = np.diff(np.concatenate([pad, mark, pad], axis=1).astype(np.int8), axis=1)
    i, low = np.nonzero(edge == 1)
    j, high = np.nonzero(edge == -1)  # row by row, so that i equals j
    return uid[i], place[i] - (high - 1), place[i] - low + window


def span_rows(uid: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    uid, begin, stop = merged(uid, begin, stop)
    return pa.RecordBatch.from_arrays([pa.array(uid), pa.array(begin.astype(np.int32)), pa.array(stop.astype(np.int32))], names=["uid", "begin", "stop"])


def with_spans(rows: DataFrame, spans: DataFrame, *more: str) -> DataFrame:
    """uid, further columns, compressed text and spans (null where nothing goes) of every document."""
    n = bucket_count(rows)
    gone = spans.repartition(n, "uid").groupBy("uid").agg(F.collect_list(F.struct("begin", "stop")).alias("spans"))
    return packed_texts(rows, "uid", *more).repartition(n, "uid").join(gone, "uid", "left")


def kept(n: int, spans: pa.Scalar) -> np.ndarray:
    """Which of n tokens are outside all spans."""
    change = np.zeros(n + 1, np.int64)
    if spans.is_valid:
        np.add.at(change, spans.values.field(0).to_numpy(), 1)
        np.add.at(change, spans.values.field(1).to_numpy(), -1)
    return np.cumsum(change[:-1]) == 0
