"""Shared pieces of the training-data operators: shared storage, text blocks, tokens.

Texts arrive as Arrow batches.  ``text_blocks`` cuts a batch into runs of rows of
at most ``limit`` bytes (a longer single text is a block of its own), so that the
numpy temporaries of an operator stay bounded whatever Arrow's batch size is.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import bucket_count, stored  # noqa: F401  for the operators

#: ASCII white space that ends a word.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

BLOCK_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an operator needs, under fixed names: other columns never clash."""
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def fold(doc_id, n: int):
    """crc32 of the decimal doc_id, mod n; a null id is in fold -1."""
    return F.coalesce((F.crc32(doc_id.cast("string")) % n).cast("int"), F.lit(-1))


def text_blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their UTF-8 bytes, offsets) for runs of rows; a null text counts as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()).fill_null(b"")
        off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(col):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
            yield batch.slice(lo, hi - lo), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            lo = hi


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased; other bytes as they are."""
    return _LOWER[data]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each row the index of its first word (one more than rows)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = np.zeros(n + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    begin = inside[1:-1] > inside[:-2]
    stop = inside[1:-1] > inside[2:]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    both = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]  # words that touch across a row's end
    begin[both] = True
    stop[both - 1] = True
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(start, off)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser over uint64 (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_PLACE = mixed(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every word: a sum of bytes times a random factor of their place, finalised."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.zeros(len(size), np.int64)
    np.cumsum(size[:-1], out=first[1:])
    total = int(size.sum())
    place = np.arange(total, dtype=np.int64) - np.repeat(first, size)
    at = place + np.repeat(start, size)
    long = int(size.max()) > len(_PLACE)
    factor = mixed((place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) if long else _PLACE[place]
    h = np.add.reduceat(factor * (data[at].astype(np.uint64) + np.uint64(1)), first)
    return mixed(h + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Batches) -> Batches:
    """``run``, and then the memory that it no longer needs goes back to the system: Python workers outlive their tasks, and the next stage needs it."""

    def all_of_it(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return all_of_it


def text_of(data: np.ndarray, off: np.ndarray, i: int) -> bytes:
    return data[off[i] : off[i + 1]].tobytes()
