"""Document fingerprints: quartile bucket digests.

Byte triplets (bytes at distances 0, 4 and 9, the text taken as a ring, so that any
text has as many triplets as bytes) are hashed into ``BUCKETS`` buckets and counted.
The digest holds two bits a bucket: above how many of the three quartiles of the
counts it lies; and one byte for the length, on a logarithmic scale.  The difference
of two digests is the mean difference of their bucket values, plus a small share for
the length; it is bounded, and likeness is one minus it.

``with_edits`` pairs every document with the next one in descending doc_id without a
global sort: ids are cut into ranges by quantiles, an id with many rows by the hash of
their text, ranges are sorted apart, and the first row of each range is also sent to
the end of the range before.

Defined results: a null text is empty; the empty text has the digest of zeros; equal
texts have equal digests; rows with one doc_id follow each other by a hash of their
text; null ids come last; a single row is its own next; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, id_text

BUCKETS = 1024
OFFSETS = (0, 4, 9)
LENGTH_SHARE = 0.05
_LEAST = -(1 << 63)


def codes(text: bytes) -> np.ndarray:
    """Bucket values 0..3 and, last, the length code."""
    out = np.zeros(BUCKETS + 1, np.uint8)
    n = len(text)
    if not n:
        return out
    x = np.frombuffer(text, np.uint8)
    ring = np.concatenate([x, np.resize(x, OFFSETS[2])]).astype(np.uint32)
    h = (ring[:n] << np.uint32(16)) | (ring[OFFSETS[1] : OFFSETS[1] + n] << np.uint32(8)) | ring[OFFSETS[2] : OFFSETS[2] + n]
    h ^= h >> np.uint32(11)
    h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    count = np.bincount(h >> np.uint32(22), minlength=BUCKETS)
    at = [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]
    low, mid, high = np.partition(count, at)[at]
    out[:-1] = (count > low).astype(np.uint8) + (count > mid) + (count > high)
    out[-1] = min(255, int(np.log2(n) * 8) + 1)
    return out


def to_hex(code: np.ndarray) -> str:
    four = code[:-1].reshape(-1, 4)
    return (four @ np.array([64, 16, 4, 1], np.uint8)).astype(np.uint8).tobytes().hex() + f"{code[-1]:02x}"


def from_hex(digest: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(digest), np.uint8)
    return np.append((raw[:-1, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).ravel(), raw[-1])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal digests; 0 at the largest difference."""
    a, b = a.astype(np.int16), b.astype(np.int16)
    gap = np.abs(a - b)
    return float(1 - (1 - LENGTH_SHARE) * gap[:-1].mean() / 3 - LENGTH_SHARE * min(int(gap[-1]), 32) / 32)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The operator's general form: doc_id and the digest of every document; no shuffle."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([to_hex(codes(x or b"")) for x in b.column(1).cast(pa.binary()).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return id_text(docs, doc_id, text).mapInArrow(run, "doc_id long, fingerprint string")


_TIE_BITS = 56


def _order(ids: pa.Array) -> np.ndarray:
    """Ascending in the order of documents: descending doc_id, null last."""
    return ~ids.cast(pa.int64()).fill_null(_LEAST).to_numpy(zero_copy_only=False)


def _ties(raw: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x, digest_size=_TIE_BITS // 8).digest()) for x in raw], np.int64)


def _ranges(own: np.ndarray, tie: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Range of each row.  A cut that is there several times is an id with many rows: their ties are cut evenly."""
    low, high = np.searchsorted(cuts, own, side="left"), np.searchsorted(cuts, own, side="right")
    times = high - low
    within = ((tie >> (_TIE_BITS - 24)) * times) >> 24
    return (low + np.where(times > 0, 1 + within, 0)).astype(np.int32)


def with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document."""
    docs = id_text(docs, doc_id, text)
    ranges = bucket_count(docs)
    share = [k / ranges for k in range(1, ranges)]
    found = docs.agg(F.percentile_approx(F.coalesce("doc_id", F.lit(_LEAST)), share, 10_000).alias("q")).first()["q"] if share else None
    cuts = np.sort(~np.array(found or [], np.int64))

    def rows_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        own = _order(b.column(0))
        raw = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
        tie = _ties(raw)
        return own, tie, raw, _ranges(own, tie, cuts)

    def tops(batches):
        best: dict[int, tuple[int, int]] = {}
        for b in batches:
            own, tie, _, at = rows_of(b)
            order = np.lexsort((tie, own, at))
            first = np.flatnonzero(np.diff(at[order], prepend=-1))
            for r, x, t in zip(at[order][first].tolist(), own[order][first].tolist(), tie[order][first].tolist(), strict=True):
                best[r] = min(best.get(r, (x, t)), (x, t))
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array([x for x, _ in best.values()], pa.int64()), pa.array([t for _, t in best.values()], pa.int64())], names=["r", "own", "tie"])

    # a row a range
    top = {r.r: (r.f.own, r.f.tie) for r in docs.mapInArrow(tops, "r int, own long, tie long").groupBy("r").agg(F.min(F.struct("own", "tie")).alias("f")).collect()}
    full = sorted(top)
    #: first row of a range: the range whose last row it follows
    guest_of = {top[b]: a for a, b in zip(full, full[1:] + full[:1], strict=True)}

    def pack(batches):
        z = zstandard.ZstdCompressor(level=1)
        sent = set()
        for b in batches:
            own, tie, raw, at = rows_of(b)
            packed = [z.compress(x) for x in raw]
            guests = []
            for g in np.flatnonzero(np.isin(own, np.array([x for x, _ in guest_of], np.int64))).tolist():
                key = int(own[g]), int(tie[g])
                if key in guest_of and key not in sent:  # of equal rows one is enough
                    sent.add(key)
                    guests.append(g)
            rows = np.concatenate([np.arange(len(own)), np.array(guests, np.int64)])
            to = np.concatenate([at, np.array([guest_of[int(own[g]), int(tie[g])] for g in guests], np.int32)])
            guest = np.arange(len(rows)) >= len(own)
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(guest), pa.array(own[rows]), pa.array(tie[rows]), b.column(0).take(pa.array(rows)), pa.array([packed[i] for i in rows], pa.binary())], names=["bucket", "guest", "own", "tie", "doc_id", "z"])

    def edit(batches):
        unzip = zstandard.ZstdDecompressor()
        waits: tuple | None = None
        out: list[tuple] = []
        follows = None  # a range's rows come in order, then its guests, of which the first counts

        def batch() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

        for b in batches:
            for k in range(b.num_rows):
                r = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                if waits is None and r[1]:
                    continue
                raw = unzip.decompress(b.column(5)[k].as_py())
                text, code = raw.decode("utf-8"), codes(raw)
                if waits is not None:
                    if follows != r[0]:
                        raise RuntimeError("a range without its end")
                    id_, before, code_before = waits
                    n = len(before)
                    edited = (before[: n - n // 2] + text[: n // 2]).encode("utf-8")
                    code_edited = codes(edited)
                    out.append((id_, n, hashlib.sha256(edited).hexdigest(), to_hex(code_before), to_hex(code_edited), likeness(code_before, code_edited), likeness(code_before, code)))
                waits, follows = (None, None) if r[1] else ((b.column(4)[k].as_py(), text, code), r[0])
                if len(out) >= 512:
                    yield batch()
                    out = []
        if out:
            yield batch()

    dealt = docs.mapInArrow(pack, "bucket int, guest boolean, own long, tie long, doc_id long, z binary").repartitionById(ranges, F.col("bucket"))
    # the first of a range is the greatest id; of equal ids the least hash of the text
    return dealt.sortWithinPartitions("bucket", "guest", "own", "tie").mapInArrow(edit, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
