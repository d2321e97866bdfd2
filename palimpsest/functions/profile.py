"""Byte profile: entropy, printable share, sliding windows, text/binary/mixed class."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..settings import DEFAULT, Settings

_PRINTABLE = np.zeros(256, dtype=bool)
_PRINTABLE[32:127] = True
_PRINTABLE[[9, 10, 13]] = True


def four(x):
    """Rounded to 4 places, ties up, whatever the last bit of x says; for arrays."""
    return np.floor(np.asarray(x) * 1e4 + 0.5 + 1e-7) / 1e4


def round4(c: Column) -> Column:
    """The same rounding as a Column."""
    return F.floor(c * 1e4 + 0.5 + 1e-7) / 1e4


def entropy_of(data: bytes | None) -> float:
    """Shannon entropy of the bytes in bits, 0 to 8."""
    if not data:
        return 0.0
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    c = c[c > 0].astype(float)
    n = c.sum()
    return float(four(max(0.0, np.log2(n) - (c * np.log2(c)).sum() / n)))


def printable_of(data: bytes | None) -> float:
    return float(four(_PRINTABLE[np.frombuffer(data, np.uint8)].mean())) if data else 0.0


@F.pandas_udf(T.DoubleType())
def byte_entropy(data: pd.Series) -> pd.Series:
    return pd.Series([entropy_of(x) for x in data], dtype="float64")


@F.pandas_udf(T.DoubleType())
def printable_ratio(data: pd.Series) -> pd.Series:
    return pd.Series([printable_of(x) for x in data], dtype="float64")


#: Windows counted at once.
BLOCK = 1 << 13


def window_entropies(data: bytes, window: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and entropies of the windows; the last is cut at the end.  ``step`` divides ``window``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0)
    count = 1 + -(-max(0, n - window) // step)
    x = np.frombuffer(data, np.uint8)
    seen = np.bincount(x, minlength=256) > 0
    x, wide = (np.cumsum(seen) - 1)[x], int(seen.sum())  # only bytes that occur are counted
    k = window // step
    table = np.arange(window + 1) * np.log2(np.maximum(np.arange(window + 1), 1))
    start = np.arange(count) * step
    size = np.minimum(start + window, n) - start
    own = np.empty(count)
    for lo in range(0, count, BLOCK):
        m = min(BLOCK, count - lo)
        part = x[lo * step : (lo + m - 1 + k) * step]
        cells = np.bincount(np.arange(len(part)) // step * wide + part, minlength=(m + k) * wide).reshape(-1, wide).astype(np.int32)
        total = np.cumsum(np.concatenate([np.zeros((1, wide), np.int32), cells]), axis=0, dtype=np.int32)
        own[lo : lo + m] = table[total[k : k + m] - total[:m]].sum(axis=1)
    return start, four(np.maximum(0.0, np.log2(size) - own / size))


def entropy_windows(df: DataFrame, data: str = "data", keys: tuple[str, ...] = ("id",), s: Settings = DEFAULT) -> DataFrame:
    """A row for every window: keys, window_start, window_end, entropy."""
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("window_start", T.LongType()), T.StructField("window_end", T.LongType()), T.StructField("entropy", T.DoubleType())])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                raw = [x or b"" for x in part.column(len(keys)).to_pylist()]
                found = [window_entropies(x, s.window, s.step) for x in raw]
                rows = pa.array(np.repeat(np.arange(len(raw)), [len(f[0]) for f in found]))
                start = np.concatenate([f[0] for f in found])
                end = np.concatenate([np.minimum(f[0] + s.window, len(x)) for f, x in zip(found, raw, strict=True)])
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(rows) for i in range(len(keys))), pa.array(start), pa.array(end), pa.array(np.concatenate([f[1] for f in found]))], names=[f.name for f in schema])

    return df.select(*keys, data).mapInArrow(run, schema)


_PROFILE = T.StructType([T.StructField(n, T.LongType() if n == "n_windows" else T.DoubleType()) for n in ("entropy", "printable_ratio", "n_windows", "low", "high")])


def byte_profile(data: Column, s: Settings = DEFAULT) -> Column:
    """Everything the classification needs, in one pass over the bytes."""

    @F.pandas_udf(_PROFILE)
    def profile(data: pd.Series) -> pd.DataFrame:
        rows = []
        for x in data:
            _, h = window_entropies(x or b"", s.window, s.step)
            rows.append((entropy_of(x), printable_of(x), len(h), float(h.min()) if len(h) else 0.0, float(h.max()) if len(h) else 0.0))
        return pd.DataFrame(rows, columns=["entropy", "printable_ratio", "n_windows", "low", "high"])

    return profile(data)


def characterization(p: Column, s: Settings = DEFAULT) -> Column:
    """text, binary or mixed, from a byte_profile struct."""
    e, r = p["entropy"], p["printable_ratio"]
    mixed = (p["n_windows"] >= 2) & (p["high"] - p["low"] >= s.mixed_delta) & (p["high"] >= s.binary_entropy) & (p["low"] <= s.text_entropy)
    return (
        F.when(p["n_windows"] == 0, "binary")
        .when(mixed, "mixed")
        .when((r >= s.text_ratio) & (e <= s.text_entropy), "text")
        .when((r <= s.binary_ratio) | (e >= s.binary_entropy), "binary")
        .when((r >= 0.70) & (e <= 6.0), "text")
        .otherwise("binary")
    )


def characterize(df: DataFrame, data: str = "data", s: Settings = DEFAULT) -> DataFrame:
    """``df`` with entropy, printable_ratio, n_windows, characterization."""
    df = df.withColumn("profile", byte_profile(F.col(data), s))
    return df.select("*", "profile.entropy", "profile.printable_ratio", "profile.n_windows", characterization(F.col("profile"), s).alias("characterization")).drop("profile")
