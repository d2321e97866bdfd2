"""Structural checks of recovered bytes by format; standard library only.

``check(kind, data)`` returns a Verdict.  Where no decoder is at hand (JPEG raster,
TIFF strips, PDF objects) the check is structural and its message says so.
"""

from __future__ import annotations

import bz2
import io
import re
import sqlite3
import struct
import tarfile
import wave
import zipfile
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPLETE, PARTIAL, ONE_MEMBER = "COMPLETE_ARCHIVE", "PARTIAL_ARCHIVE", "VALID_MEMBER_ONLY"
VALID, INVALID, METADATA = "STRUCTURALLY_VALID", "STRUCTURALLY_INVALID", "METADATA_ONLY"


@dataclass
class Verdict:
    valid: bool
    message: str
    state: str = ""
    members: list[str] = field(default_factory=list)
    completeness: float = 0.0

    def __post_init__(self) -> None:
        self.state = self.state or (VALID if self.valid else INVALID)


def no(message: str) -> Verdict:
    return Verdict(False, message)


def _ratio(have: int, want: int) -> float:
    return min(1.0, round(have / want, 4)) if want > 0 else 0.0


# Images


def jpeg(data: bytes) -> Verdict:
    if data[:3] != b"\xff\xd8\xff":
        return no("Missing JPEG SOI marker")
    at, frame, scan = 2, False, False
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return no(f"JPEG marker expected at byte {at}: corrupt segment")
        kind = data[at + 1]
        if kind in (0xFF, 0x01) or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
            continue
        if kind == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4])
        if size < 2 or at + 2 + size > len(data):
            return no("JPEG segment is truncated")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            if size < 8 or not int.from_bytes(data[at + 5 : at + 7]) or not int.from_bytes(data[at + 7 : at + 9]):
                return no("JPEG frame has no size")
            frame = True
        at += 2 + size
        if kind == 0xDA:
            if not frame:
                return no("JPEG scan without a frame")
            scan = True
            found = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.DOTALL).search(data, at)
            if not found:
                return no("JPEG scan has no end: image file is truncated")
            at = found.start()
    if scan and data[at : at + 2] == b"\xff\xd9":
        return Verdict(True, "Valid JPEG structure (markers checked, raster not decoded)", completeness=1.0)
    return no("JPEG has no complete scan")


def png(data: bytes) -> Verdict:
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return no("Missing PNG signature")
    at, head, pixels = 8, None, []
    while at + 12 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data):
            return no("PNG chunk is truncated")
        if zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + size : at + 12 + size]):
            return no(f"PNG chunk {kind.decode('latin-1')} CRC mismatch")
        at += 12 + size
        if kind == b"IHDR" and size == 13:
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            pixels.append(body)
        elif kind == b"IEND":
            break
    else:
        return no("PNG has no IEND chunk")
    if head is None or not head[0] or not head[1]:
        return no("PNG has no header chunk")
    width, height, depth, colour, _, _, laced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if channels is None:
        return no("PNG colour type is unknown")
    try:
        raw = zlib.decompress(b"".join(pixels))
    except zlib.error as e:
        return no(f"PNG pixel data is corrupt: {e}")
    line = lambda w: 1 + (w * channels * depth + 7) // 8 if w else 0
    passes = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)] if laced else [(0, 0, 1, 1)]
    want = sum(line(-(-(width - x) // dx)) * max(0, -(-(height - y) // dy)) for x, y, dx, dy in passes)
    return Verdict(True, f"Valid PNG image ({width}x{height})", completeness=1.0) if len(raw) == want else no("PNG pixel data has the wrong size")


def gif(data: bytes) -> Verdict:
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 14:
        return no("Missing GIF signature")
    width, height, flags = struct.unpack("<HHB", data[6:11])
    at, images = 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0), 0
    if not width or not height:
        return no("GIF has no size")

    def blocks(at: int) -> int:
        while at < len(data) and data[at]:
            at += 1 + data[at]
        return at + 1

    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            return Verdict(True, f"Valid GIF image ({width}x{height}, {images} frame(s))", completeness=1.0) if images else no("GIF holds no image")
        if kind == 0x21:
            at = blocks(at + 2)
        elif kind == 0x2C and at + 10 < len(data):
            local = data[at + 9]
            at = blocks(at + 10 + (3 << ((local & 7) + 1) if local & 0x80 else 0) + 1)
            images += 1
        else:
            return no("GIF block is corrupt")
    return no("GIF is truncated: no trailer")


def bmp(data: bytes) -> Verdict:
    if data[:2] != b"BM" or len(data) < 26:
        return no("Missing BMP header")
    size, _, pixels, dib = struct.unpack("<IIII", data[2:18])
    if dib == 12:
        width, height, _, depth = struct.unpack("<HHHH", data[18:26])
        packed = 0
    elif dib in (40, 52, 56, 64, 108, 124) and len(data) >= 54:
        width, height, _, depth, packed, packed_size = struct.unpack("<iiHHII", data[18:38])
    else:
        return no("BMP header is unknown")
    if not width or not height or depth not in (1, 4, 8, 16, 24, 32):
        return no("BMP header is corrupt")
    need = (abs(width) * depth + 31) // 32 * 4 * abs(height) if packed in (0, 3, 6) else packed_size
    return Verdict(True, f"Valid BMP image ({abs(width)}x{abs(height)})", completeness=1.0) if pixels + need <= len(data) else no("BMP pixel data is truncated")


def tiff(data: bytes) -> Verdict:
    if data[:4] not in (b"II*\0", b"MM\0*") or len(data) < 8:
        return no("Missing TIFF header")
    e = "<" if data[:2] == b"II" else ">"
    at = struct.unpack(e + "I", data[4:8])[0]
    if at < 8 or at + 2 > len(data):
        return no("TIFF directory lies outside the file")
    n = struct.unpack(e + "H", data[at : at + 2])[0]
    if not n or at + 2 + 12 * n > len(data):
        return no("TIFF directory is truncated")
    size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
    found: dict[int, list[int]] = {}
    for k in range(n):
        tag, kind, count, value = struct.unpack(e + "HHI4s", data[at + 2 + 12 * k : at + 14 + 12 * k])
        if kind not in size:
            return no("TIFF field type is unknown")
        total = size[kind] * count
        where = struct.unpack(e + "I", value)[0]
        raw = value[:total] if total <= 4 else data[where : where + total]
        if len(raw) < total:
            return no("TIFF field lies outside the file")
        if kind in (3, 4):
            found[tag] = list(struct.unpack(f"{e}{count}{'H' if kind == 3 else 'I'}", raw))
    if not found.get(256) or not found.get(257) or not all(found[256] + found[257]):
        return no("TIFF has no size")
    starts, counts = found.get(273) or found.get(324) or [], found.get(279) or found.get(325) or []
    if not starts or len(starts) != len(counts) or any(a + b > len(data) for a, b in zip(starts, counts, strict=True)):
        return no("TIFF image data is truncated")
    return Verdict(True, f"Valid TIFF structure ({found[256][0]}x{found[257][0]}, strips checked, not decoded)", completeness=1.0)


def pcx(data: bytes) -> Verdict:
    if len(data) < 128 or data[0] != 0x0A or data[1] not in (0, 2, 3, 4, 5) or data[2] not in (0, 1) or data[3] not in (1, 2, 4, 8):
        return no("Missing PCX header")
    x0, y0, x1, y1 = struct.unpack("<HHHH", data[4:12])
    planes, line = data[65], int.from_bytes(data[66:68], "little")
    if x1 < x0 or y1 < y0 or not 1 <= planes <= 4 or not line:
        return no("PCX header is corrupt")
    want, have, at = planes * line * (y1 - y0 + 1), 0, 128
    while have < want and at < len(data):
        run = data[at] & 0x3F if data[2] and data[at] >= 0xC0 else 1
        at += 2 if data[2] and data[at] >= 0xC0 else 1
        have += run
    return Verdict(True, f"Valid PCX image ({x1 - x0 + 1}x{y1 - y0 + 1})", completeness=1.0) if have >= want else no("PCX pixel data is truncated")


# Documents, sound, data


def pdf(data: bytes) -> Verdict:
    if data[:5] != b"%PDF-":
        return no("Missing PDF header")
    pages = len(re.findall(rb"/Type\s*/Page(?![A-Za-z])", data))
    if not pages:  # pages within compressed object streams
        for body in re.findall(rb"stream\r?\n(.*?)endstream", data, re.DOTALL):
            try:
                pages += len(re.findall(rb"/Type\s*/Page(?![A-Za-z])", zlib.decompressobj().decompress(body)))
            except zlib.error:
                continue
    if b"startxref" not in data and b"trailer" not in data:
        return no("PDF has no cross-reference: file is corrupt or truncated")
    return Verdict(True, f"Valid PDF structure ({pages} page(s), objects not rendered)", completeness=1.0) if pages else no("PDF has no page")


def _office(name: str, part: str) -> Callable[[bytes], Verdict]:
    def run(data: bytes) -> Verdict:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                bad = z.testzip()
                names = z.namelist()
        except Exception as e:
            return no(f"{name} container is corrupt ({type(e).__name__}): {e}")
        if bad:
            return no(f"{name} member CRC check failed: {bad}")
        missing = [p for p in ("[Content_Types].xml", part) if p not in names]
        return no(f"{name} part missing: {', '.join(missing)}") if missing else Verdict(True, f"Valid {name} document ({len(names)} parts)", COMPLETE, names, 1.0)

    return run


def zip_strict(data: bytes) -> Verdict:
    if data[:4] != b"PK\x03\x04":
        return no("Missing ZIP local header")
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            bad, names = z.testzip(), z.namelist()
    except Exception as e:
        return no(f"ZIP validation failed ({type(e).__name__}): {e}")
    return no(f"ZIP member CRC check failed: {bad}") if bad else Verdict(True, f"Valid ZIP archive ({len(names)} member(s))", COMPLETE, names, 1.0)


def sqlite(data: bytes) -> Verdict:
    if data[:16] != b"SQLite format 3\0":
        return no("Missing SQLite header")
    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(data)
        said = db.execute("PRAGMA integrity_check").fetchone()
        tables = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]
    except Exception as e:
        return no(f"SQLite DatabaseError: {e}")
    finally:
        db.close()
    return Verdict(True, f"Valid SQLite database ({len(tables)} table(s))", members=tables, completeness=1.0) if said and said[0] == "ok" else no(f"SQLite integrity check failed: corrupt ({said})")


def wav(data: bytes) -> Verdict:
    if len(data) < 44 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return no("Missing WAV header")
    if int.from_bytes(data[4:8], "little") + 8 > len(data) + 1024:
        return no("WAV declares more than is there")
    try:
        with wave.open(io.BytesIO(data)) as w:
            channels, width, rate = w.getnchannels(), w.getsampwidth(), w.getframerate()
    except Exception as e:
        return no(f"WAV is corrupt: {e}")
    fine = 1 <= channels <= 32 and 100 <= rate <= 384_000 and 1 <= width <= 4
    return Verdict(True, f"Valid WAV sound ({channels} channel(s), {rate} Hz)", completeness=1.0) if fine else no("WAV parameters are out of range")


def text(data: bytes) -> Verdict:
    try:
        s = data.decode("utf-8")
    except UnicodeDecodeError:
        s = data.decode("latin-1")
    share = sum(c.isprintable() or c in "\n\r\t" for c in s) / len(s) if s else 0.0
    return Verdict(True, f"Valid text (printable share {share:.2f})", completeness=1.0) if share >= 0.70 else no(f"Text has too few printable characters ({share:.2f})")


# Archives; each also tells whether it starts at a place, and how complete it is


def _local_headers(data: bytes):
    """(name, payload or None, crc, end) of each local header, also past damage."""
    at = data.find(b"PK\x03\x04")
    while at != -1 and at + 30 <= len(data):
        _, _, _, method, _, _, crc, packed, _, name, extra = struct.unpack("<4sHHHHHIIIHH", data[at : at + 30])
        begin = at + 30 + name + extra
        end = begin + packed
        title = data[at + 30 : at + 30 + name].decode("utf-8", "replace")
        body = None
        if end <= len(data):
            try:
                body = data[begin:end] if method == 0 else zlib.decompress(data[begin:end], -15) if method == 8 else None
            except zlib.error:
                body = None
        yield title, body, crc, end
        at = data.find(b"PK\x03\x04", max(at + 4, end))


def zip_archive(data: bytes) -> Verdict:
    if data[:4] != b"PK\x03\x04":
        return no("Missing ZIP local header")
    span = 30 + sum(struct.unpack("<HH", data[26:30])) + int.from_bytes(data[18:22], "little") if len(data) >= 30 else 0
    part = _ratio(len(data), span)
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            bad, names = z.testzip(), z.namelist()
        return Verdict(False, f"ZIP member CRC-32 check failed on: {bad}", completeness=part) if bad else Verdict(True, f"Valid complete ZIP archive ({len(names)} member(s))", COMPLETE, names, part)
    except Exception:
        names = [name for name, body, crc, _ in _local_headers(data) if body is not None and zlib.crc32(body) == crc]
    if names:
        return Verdict(True, f"Valid partial ZIP archive ({len(names)} validated member(s))", ONE_MEMBER if len(names) == 1 else PARTIAL, names, part)
    return Verdict(False, "ZIP directory is damaged and no member is intact: corrupt", completeness=part)


def tar_block(block: bytes) -> bool:
    """Whether a 512-byte block is a header with a right checksum, signed or unsigned."""
    stated = block[148:156].strip(b"\0 ")
    if len(block) < 512 or not re.fullmatch(rb"[0-7]+", stated):
        return False
    rest = block[:148] + b" " * 8 + block[156:512]
    return int(stated, 8) in (sum(rest), sum(b - 256 if b > 127 else b for b in rest))


def tar(data: bytes) -> Verdict:
    if len(data) < 512:
        return no("Candidate too small for a TAR block")
    names, at, ended = [], 0, False
    while at + 512 <= len(data):
        block = data[at : at + 512]
        if not any(block):
            ended = not any(data[at + 512 : at + 1024])
            break
        if not tar_block(block):
            break
        size = block[124:136].strip(b"\0 ")
        names.append(block[:100].rstrip(b"\0").decode("utf-8", "replace"))
        at += 512 + -(-(int(size, 8) if re.fullmatch(rb"[0-7]+", size) else 0) // 512) * 512
    part = 1.0 if len(data) >= at else _ratio(len(data), at)
    try:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            listed = [m.name for m in t.getmembers()]
        if listed:
            return Verdict(True, f"Valid TAR archive ({len(listed)} member(s))", COMPLETE, listed, part)
    except Exception:
        listed = []
    if names:
        return Verdict(True, f"Structurally valid TAR archive ({len(names)} member(s))", COMPLETE if ended else PARTIAL, names, part)
    return Verdict(False, "TAR has no block with a right checksum", completeness=part)


def seven_zip(data: bytes) -> Verdict:
    if len(data) < 32 or data[:6] != b"7z\xbc\xaf\x27\x1c":
        return no("Missing 7Z signature")
    if zlib.crc32(data[12:32]) != int.from_bytes(data[8:12], "little"):
        return no("7Z start header CRC mismatch")
    offset, size, crc = struct.unpack("<QQI", data[12:32])
    want = 32 + offset + size
    part = _ratio(len(data), want)
    if size and want <= len(data) and zlib.crc32(data[32 + offset : want]) == crc:
        return Verdict(True, f"Valid complete 7Z archive ({want} bytes, end header CRC verified)", COMPLETE, completeness=part)
    if len(data) >= want:
        return Verdict(False, "7Z end header CRC mismatch", completeness=part)
    return Verdict(True, f"Partial 7Z archive ({len(data)}/{want} bytes, {part * 100:.1f}%)", PARTIAL, completeness=part)


def rar_blocks(data: bytes, start: int = 0, bound: int = 50 << 20):
    """(type, place, header size, whole size) of each block after the signature."""
    at = start + (8 if data[start : start + 8] == b"Rar!\x1a\x07\x01\0" else 7)
    while at + 7 <= len(data) and at - start <= bound:
        _, kind, flags, size = struct.unpack("<HBHH", data[at : at + 7])
        if not size or at + size > len(data):
            return
        more = int.from_bytes(data[at + 7 : at + 11], "little") if flags & 0x8000 and at + 11 <= len(data) else 0
        yield kind, at, size, size + more
        if kind == 0x7B:
            return
        at += size + more


def rar(data: bytes) -> Verdict:
    if data[:7] != b"Rar!\x1a\x07\0" and data[:8] != b"Rar!\x1a\x07\x01\0":
        return no("Missing RAR signature")
    found = list(rar_blocks(data))
    kinds = [k for k, *_ in found]
    span = found[-1][1] + found[-1][3] if found else 0
    part = 1.0 if len(data) >= span else _ratio(len(data), span)
    if 0x73 not in kinds:
        return Verdict(False, "RAR has no main header", completeness=part)
    names = []
    for kind, at, _, _ in found:
        if kind == 0x74 and at + 32 <= len(data):
            size = int.from_bytes(data[at + 26 : at + 28], "little")
            names.append(data[at + 32 : at + 32 + size].decode("latin-1"))
    if not names:
        return Verdict(True, "RAR main header without members", METADATA, completeness=part)
    state = COMPLETE if 0x7B in kinds else PARTIAL
    return Verdict(True, f"Valid {'complete' if state == COMPLETE else 'partial'} RAR archive ({len(names)} member(s))", state, names, part)


def wim(data: bytes) -> Verdict:
    if len(data) < 208 or data[:8] != b"MSWIM\0\0\0":
        return Verdict(False, "Missing WIM header", completeness=_ratio(len(data), 208))
    size, version = struct.unpack("<II", data[8:16])
    if size != 208 or version != 0x00010D00:
        return no("WIM header fields are invalid")
    return Verdict(True, f"Structurally valid WIM header (parts {int.from_bytes(data[40:42], 'little')}/{int.from_bytes(data[42:44], 'little')})", VALID, completeness=1.0)


def _stream(name: str, magic: bytes, least: int, whole: Callable[[bytes], bytes], some: Callable[[bytes], bytes]) -> Callable[[bytes], Verdict]:
    def run(data: bytes) -> Verdict:
        if len(data) < least or not data.startswith(magic):
            return no(f"Missing {name} header")
        try:
            return Verdict(True, f"Valid complete {name} stream ({len(whole(data))} bytes)", COMPLETE, completeness=1.0)
        except Exception as e:
            why = str(e)
        try:
            got = len(some(data))
        except Exception as e:
            got, why = 0, str(e)
        return Verdict(True, f"Valid partial {name} stream ({got} bytes recovered)", PARTIAL, completeness=1.0) if got else no(f"{name} stream is corrupt: {why}")

    return run


def _gunzip(data: bytes) -> bytes:
    import gzip

    return gzip.decompress(data)


gz = _stream("GZIP", b"\x1f\x8b", 10, _gunzip, lambda d: zlib.decompressobj(31).decompress(d))
bzip2 = _stream("BZ2", b"BZh", 10, bz2.decompress, lambda d: bz2.BZ2Decompressor().decompress(d))

#: Tests whether an archive starts at a place, in the order in which they are asked.
STARTS: dict[str, Callable[[bytes, int], bool]] = {
    "zip": lambda d, o: d[o : o + 4] == b"PK\x03\x04",
    "tar": lambda d, o: len(d) >= o + 512 and (b"ustar" in d[o + 257 : o + 265] or (any(d[o : o + 512]) and tar_block(d[o : o + 512]))),
    "7z": lambda d, o: d[o : o + 6] == b"7z\xbc\xaf\x27\x1c",
    "rar": lambda d, o: d[o : o + 7] == b"Rar!\x1a\x07\0" or d[o : o + 8] == b"Rar!\x1a\x07\x01\0",
    "wim": lambda d, o: d[o : o + 8] == b"MSWIM\0\0\0",
    "gz": lambda d, o: d[o : o + 3] == b"\x1f\x8b\x08" and len(d) >= o + 10 and d[o + 3] <= 0x1F and (d[o + 9] <= 13 or d[o + 9] == 255),  # two bytes alone occur by chance
    "bz2": lambda d, o: d[o : o + 3] == b"BZh" and d[o + 4 : o + 10] == b"1AY&SY",
}
ARCHIVES: dict[str, Callable[[bytes], Verdict]] = {"zip": zip_archive, "tar": tar, "7z": seven_zip, "rar": rar, "wim": wim, "gz": gz, "bz2": bzip2}
CHECKS: dict[str, Callable[[bytes], Verdict]] = {
    "jpeg": jpeg, "png": png, "gif": gif, "bmp": bmp, "tiff": tiff, "pcx": pcx, "pdf": pdf, "wav": wav, "sqlite": sqlite, "text": text, "zip": zip_strict,
    "docx": _office("DOCX", "word/document.xml"), "xlsx": _office("XLSX", "xl/workbook.xml"), "pptx": _office("PPTX", "ppt/presentation.xml"),
    "tar": tar, "7z": seven_zip, "rar": rar, "wim": wim, "gz": gz, "bz2": bzip2,
}
#: Other names of formats.
ALIASES = {"jpg": "jpeg", "tif": "tiff", "txt": "text", "plain": "text", "db": "sqlite", "sqlite3": "sqlite", "gzip": "gz", "bzip2": "bz2", "wave": "wav"}


def archive_kind(data: bytes, at: int = 0) -> str | None:
    return next((k for k, test in STARTS.items() if test(data, at)), None)


def check(kind: str | None, data: bytes | None) -> Verdict:
    name = (kind or "").lower().strip().lstrip(".")
    name = ALIASES.get(name, name)
    if not data:
        return no("Candidate is empty")
    return CHECKS[name](data) if name in CHECKS else no(f"No validator for type '{kind}'")


_OUT = T.StructType([T.StructField("valid", T.BooleanType()), T.StructField("message", T.StringType()), T.StructField("state", T.StringType()), T.StructField("members", T.ArrayType(T.StringType())), T.StructField("completeness", T.DoubleType())])


def _frame(rows: list[Verdict]) -> pd.DataFrame:
    return pd.DataFrame({"valid": [v.valid for v in rows], "message": [v.message for v in rows], "state": [v.state for v in rows], "members": [v.members for v in rows], "completeness": [v.completeness for v in rows]})


@F.pandas_udf(_OUT)
def validate_format(kind: pd.Series, data: pd.Series) -> pd.DataFrame:
    return _frame([check(k, x) for k, x in zip(kind, data, strict=True)])


@F.pandas_udf(_OUT)
def validate_archive(data: pd.Series) -> pd.DataFrame:
    found = [(archive_kind(x or b""), x) for x in data]
    return _frame([ARCHIVES[k](x) if k else no("No archive format") for k, x in found])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("offset", T.LongType()), T.StructField("format", T.StringType()), T.StructField("structure", _OUT)])))
def nested_archives(data: pd.Series) -> pd.Series:
    """Archives that start at multiples of 512 bytes within, with what their adapter finds there."""

    def inside(x: bytes) -> list[dict]:
        found = [(o, k) for o in range(512, len(x), 512) if (k := archive_kind(x, o))]
        return [{"offset": o, "format": k, "structure": vars(ARCHIVES[k](x[o:]))} for o, k in found]

    return pd.Series([inside(x or b"") for x in data])


def nested(candidates: DataFrame, id_: str = "candidate_id", content: str = "content") -> DataFrame:
    """A row for each archive within a candidate: parent_id, offset, format, state, members, completeness."""
    found = candidates.select(F.col(id_).alias("parent_id"), F.explode(nested_archives(F.coalesce(F.col(content), F.lit(b"")))).alias("n"))
    return found.select("parent_id", "n.offset", "n.format", "n.structure.state", "n.structure.members", "n.structure.completeness")
