"""Carving: signatures, boundaries by format, disrupted extents, fragments with ids.

A source is a table of chunks (source, chunk_start, total_size, data): consecutive
stretches of an image, each with the bytes after it that the largest scan may need.
A hit belongs to the chunk in which it starts, so chunks of an image can be carved by
different tasks.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .formats import rar_blocks
from .intervals import running_offset

DEFAULT_LENGTH = 4096
MB = 1 << 20


@dataclass(frozen=True)
class Signature:
    kind: str
    header: bytes
    scan: int
    least: int
    footer: bytes = b""


# Type, header, scan window, smallest length, footer.
SIGNATURES = (
    Signature("jpeg", b"\xff\xd8\xff", 20 * MB, 107, b"\xff\xd9"),
    Signature("png", b"\x89PNG\r\n\x1a\n", 20 * MB, 67),
    Signature("gif", b"GIF89a", 10 * MB, 20),
    Signature("gif", b"GIF87a", 10 * MB, 20),
    Signature("bmp", b"BM", 20 * MB, 54),
    Signature("tiff", b"II*\0", 30 * MB, 8),
    Signature("tiff", b"MM\0*", 30 * MB, 8),
    Signature("pcx", b"\x0a", 5 * MB, 128),
    Signature("pdf", b"%PDF-", 25 * MB, 67, b"%%EOF"),
    Signature("zip", b"PK\x03\x04", 30 * MB, 22, b"PK\x05\x06"),
    Signature("sqlite", b"SQLite format 3\0", 50 * MB, 100),
    Signature("wav", b"RIFF", 50 * MB, 44),
    Signature("7z", b"7z\xbc\xaf\x27\x1c", 50 * MB, 32),
    Signature("rar", b"Rar!\x1a\x07\0", 50 * MB, 20),
    Signature("rar", b"Rar!\x1a\x07\x01\0", 50 * MB, 20),
    Signature("wim", b"MSWIM\0\0\0", 50 * MB, 208),
    Signature("bz2", b"BZh", 50 * MB, 14),
    Signature("gz", b"\x1f\x8b\x08", 50 * MB, 18),
)
#: Bytes that a chunk carries beyond its own stretch.
OVERLAP = max(s.scan for s in SIGNATURES)
ZEROS = 64


class View:
    """Bytes of a chunk from a header on; sizes count to the image's end."""

    def __init__(self, data: bytes, at: int, rest: int, scan: int):
        self.data, self.at, self.rest, self.scan = data, at, rest, min(scan, rest)
        self.end = at + self.scan

    def find(self, what: bytes, start: int, end: int | None = None) -> int:
        """Place relative to the header, or -1."""
        stop = self.end if end is None else self.at + end
        k = self.data.find(what, self.at + start, stop)
        return k - self.at if k >= 0 else -1

    def bytes(self, start: int, n: int) -> bytes:
        return self.data[self.at + start : self.at + start + n]

    @property
    def default(self) -> int:
        return min(DEFAULT_LENGTH, self.rest)


# Each boundary returns (length, footer seen, type) or None to reject the hit.
Found = tuple[int, bool, str] | None


def _jpeg(v: View) -> Found:
    nxt = v.find(b"\xff\xd8\xff", 3)
    end = v.find(b"\xff\xd9", 2, nxt if nxt > 0 else None)
    return (end + 2, True, "jpeg") if end >= 0 else (nxt if nxt > 0 else v.default, False, "jpeg")


def _png(v: View) -> Found:
    at = 8
    while at + 8 <= v.scan:
        head = v.bytes(at, 8)
        if len(head) < 8:
            break
        size = int.from_bytes(head[:4])
        if size > 0x7FFFFFFF:
            break
        at += 12 + size
        if head[4:] == b"IEND":
            if at <= v.rest:
                return at, True, "png"
            break
    end = v.find(b"IEND", 8)
    return (min(end + 8, v.rest), True, "png") if end >= 0 else (v.default, False, "png")


def _gif(v: View) -> Found:
    head = v.bytes(0, 13)
    end = v.find(b"\x3b", 13) if len(head) == 13 and any(head[6:8]) and any(head[8:10]) else -1
    return (end + 1, True, "gif") if end >= 0 else (v.default, False, "gif")


def _bmp(v: View) -> Found:
    head = v.bytes(0, 54)
    if len(head) < 18:
        return None
    size, _, pixels, dib = struct.unpack("<IIII", head[2:18])
    if not 54 <= size <= SIGNATURES[4].scan or dib not in (12, 40, 64, 108, 124) or not 14 <= pixels < size:
        return None
    if dib >= 40:
        if len(head) < 30:
            return None
        width, height, planes, depth = struct.unpack("<iiHH", head[18:30])
        if not width or not height or max(abs(width), abs(height)) > 65535 or planes != 1 or depth not in (1, 4, 8, 16, 24, 32):
            return None
    return min(size, v.rest), size <= v.rest, "bmp"


def _tiff(v: View) -> Found:
    head = v.bytes(0, 8)
    if len(head) < 8:
        return None
    e = "<" if head[:2] == b"II" else ">"
    at = struct.unpack(e + "I", head[4:])[0]
    count = v.bytes(at, 2)
    if not 8 <= at < v.rest or len(count) < 2 or not 1 <= struct.unpack(e + "H", count)[0] <= 4096:
        return None
    return v.scan, True, "tiff"


def _pcx(v: View) -> Found:
    h = v.bytes(0, 128)
    if len(h) < 128 or h[1] not in (0, 2, 3, 4, 5) or h[2] not in (0, 1) or h[3] not in (1, 2, 4, 8):
        return None
    x0, y0, x1, y1 = struct.unpack("<HHHH", h[4:12])
    line = int.from_bytes(h[66:68], "little")
    if x1 < x0 or y1 < y0 or not 1 <= h[65] <= 4 or not line:
        return None
    return min(128 + h[65] * line * (y1 - y0 + 1) * 2, v.scan), True, "pcx"


def _pdf(v: View) -> Found:
    nxt = v.find(b"%PDF-", 5)
    stop = v.at + nxt if nxt > 0 else v.end
    end = v.data.rfind(b"%%EOF", v.at, stop)
    if end < 0:
        return (nxt if nxt > 0 else v.default), False, "pdf"
    at = end + 5
    while at < len(v.data) and v.data[at] in b"\r\n \0":
        at += 1
    return min(at - v.at, v.rest), True, "pdf"


def _zip(v: View) -> Found:
    end = v.find(b"PK\x05\x06", 0)
    if end < 0 or end + 22 > v.rest:
        return v.default, False, "zip"
    size = min(end + 22 + int.from_bytes(v.bytes(end + 20, 2), "little"), v.rest)
    body = v.bytes(0, size)
    types = b"[Content_Types].xml" in body
    for kind, part in (("docx", b"word/document.xml"), ("xlsx", b"xl/workbook.xml"), ("pptx", b"ppt/presentation.xml")):
        if types and part in body:
            return size, True, kind
    return size, True, "docx" if b"word/" in body or types else "xlsx" if b"xl/" in body else "pptx" if b"ppt/" in body else "zip"


def _sqlite(v: View) -> Found:
    h = v.bytes(0, 100)
    page = int.from_bytes(h[16:18]) if len(h) == 100 else 0
    page = 65536 if page == 1 else page
    count = int.from_bytes(h[28:32])
    ok = 512 <= page <= 65536 and page & (page - 1) == 0 and count
    return (min(page * count, v.rest) if ok else v.default), False, "sqlite"


def _wav(v: View) -> Found:
    h = v.bytes(0, 44)
    size = int.from_bytes(h[4:8], "little")
    if len(h) < 44 or not 36 <= size <= 50 * MB or h[8:16] != b"WAVEfmt " or int.from_bytes(h[16:20], "little") < 16:
        return None
    return min(size + 8, v.scan), True, "wav"


def _seven(v: View) -> Found:
    h = v.bytes(0, 32)
    if len(h) < 32 or zlib.crc32(h[12:32]) != int.from_bytes(h[8:12], "little"):
        return None
    offset, size = struct.unpack("<QQ", h[12:28])
    return min(32 + offset + size, v.scan), 32 + offset + size <= v.rest, "7z"


def _rar(v: View) -> Found:
    found = list(rar_blocks(v.data, v.at, v.scan))
    if not any(k == 0x73 for k, *_ in found):
        return v.default, False, "rar"
    last = found[-1]
    return min(last[1] + last[3] - v.at, v.rest), last[0] == 0x7B, "rar"


def _wim(v: View) -> Found:
    h = v.bytes(0, 208)
    if len(h) < 208 or struct.unpack("<II", h[8:16]) != (208, 0x00010D00):
        return None
    nxt = v.find(b"MSWIM\0\0\0", 8)
    return (nxt if nxt > 0 else v.default), False, "wim"


def _bz2(v: View) -> Found:
    h = v.bytes(0, 10)
    if len(h) < 10 or h[3:4] not in b"123456789" or h[4:] != b"1AY&SY":
        return v.default, False, "bz2"
    end = v.find(bytes.fromhex("177245385090"), 10)
    if end >= 0:
        return min(end + 10, v.rest), True, "bz2"
    nxt = v.find(b"BZh", 10)
    return (nxt if nxt > 0 else v.default), False, "bz2"


def _gz(v: View) -> Found:
    h = v.bytes(0, 10)
    if len(h) < 10 or h[3] > 0x1F or not (h[9] <= 13 or h[9] == 255):
        return None
    try:
        some = zlib.decompressobj(31).decompress(v.bytes(0, v.default))
    except zlib.error:
        return None
    return (v.default, False, "gz") if some else None


BOUNDARY = {"jpeg": _jpeg, "png": _png, "gif": _gif, "bmp": _bmp, "tiff": _tiff, "pcx": _pcx, "pdf": _pdf, "zip": _zip, "sqlite": _sqlite, "wav": _wav, "7z": _seven, "rar": _rar, "wim": _wim, "bz2": _bz2, "gz": _gz}


def extents(data: bytes) -> list[tuple[int, int]]:
    """Stretches between runs of at least 64 zero bytes; all of it where no such run starts after byte 32 and before the last 8."""
    n = len(data)
    hole = b"\0" * ZEROS
    first = data.find(hole, 32)
    if n <= ZEROS or first < 0 or first >= n - 8:
        return [(0, n)]
    out, at = [], 0
    while True:
        k = data.find(hole, at)
        if k < 0:
            break
        if k > at:
            out.append((at, k))
        at = k + ZEROS
        while at < n and not data[at]:
            at += 1
    if at < n:
        out.append((at, n))
    return out


def carve_chunk(data: bytes, start: int, own: int, total: int) -> list[tuple]:
    """Fragments whose header starts in the first ``own`` bytes of a chunk at ``start`` of an image.

    (offset, length, type, header flag, footer flag, group, extent index, extents, signature, method)
    """
    out = []
    for s in SIGNATURES:
        at = data.find(s.header)
        while 0 <= at < own:
            found = BOUNDARY[s.kind](View(data, at, total - start - at, s.scan))
            if found and found[0] >= s.least:
                size, footer, kind = found
                body = data[at : at + size]
                parts = extents(body) if kind not in ("sqlite", "tiff") and len(body) > ZEROS else [(0, size)]
                h = start + at
                if len(parts) > 1:
                    for i, (a, b) in enumerate(parts):
                        out.append((h + a, b - a, kind, i == 0, footer and i == len(parts) - 1, f"disrupted_{kind}_{h}", i, len(parts), s.header.hex(), "disrupted_extent"))
                else:
                    out.append((h, size, kind, True, footer, None, None, None, s.header.hex(), "signature"))
            at = data.find(s.header, at + max(1, len(s.header)))
    return out


FRAGMENT = "source string, offset long, length long, type_hint string, header_flag boolean, footer_flag boolean, group_id string, extent_index int, extent_total int, signature string, detection_method string"


def carve(chunks: DataFrame) -> DataFrame:
    """Fragments of all images, deduplicated by (source, offset, length, type), numbered by source in order: id F0001, F0002, ...

    ``chunks``: source, chunk_start, own (bytes that the chunk answers for), total_size, data.
    A text header of JPEG may overlap the one before across a chunk's start; such hits
    closer than the header's length to the last kept one are dropped as in one pass.
    """

    def run(batches):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        names = [x.strip().split(" ")[0] for x in FRAGMENT.split(",")]
        for b in batches:
            for r in b.to_pylist():
                rows = [(r["source"], *x) for x in carve_chunk(r["data"], r["chunk_start"], r["own"], r["total_size"])]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=names)

    found = chunks.select("source", "chunk_start", "own", "total_size", "data").mapInArrow(run, FRAGMENT)
    found = stored(found.dropDuplicates(["source", "offset", "length", "type_hint"]), "carved", heavy=True)
    # numbered in ranges of (source, offset): no image is sorted in one task
    found = running_offset(found.withColumn("place", F.struct("offset", "length", "type_hint")).withColumn("one", F.lit(1)), "source", "place", "one", "before").withColumn("seq", F.col("before") + 1).drop("place", "one", "before")
    return found.withColumn("id", F.format_string("F%04d", "seq")).withColumn("end_offset", F.col("offset") + F.col("length"))
