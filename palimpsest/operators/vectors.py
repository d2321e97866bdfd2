"""Fingerprints of fragments as 64 numbers: hashed text tokens, byte pairs with TF-IDF and SVD; similarity search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..settings import DEFAULT

_FNV_START, _FNV_PRIME = np.uint64(2166136261), np.uint64(16777619)
_MASK = np.uint64(0xFFFFFFFF)
VECTOR = T.ArrayType(T.DoubleType())


def normalized(v: np.ndarray, places: int = 6) -> np.ndarray:
    """Unit length, rounded; no number and infinity count as 0; zero stays zero."""
    v = np.nan_to_num(np.asarray(v, float), nan=0.0, posinf=0.0, neginf=0.0)
    norm = np.linalg.norm(v)
    return np.round(v / norm, places) if norm > 0 else np.zeros_like(v)


def fnv1a(tokens: list[bytes]) -> np.ndarray:
    """FNV-1a, 32 bits, of each token."""
    size = np.array([len(t) for t in tokens], np.int64)
    data = np.frombuffer(b"".join(tokens), np.uint8).astype(np.uint64)
    start = np.cumsum(size) - size
    h = np.full(len(tokens), _FNV_START)
    for k in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > k)
        h[on] = ((h[on] ^ data[start[on] + k]) * _FNV_PRIME) & _MASK
    return h


def hashed_counts(text: str, dim: int = DEFAULT.dimension) -> np.ndarray:
    """Counts of lower-cased words and character 3-grams by hash bucket."""
    out = np.zeros(dim)
    if not text.strip():
        return out
    tokens = [w.lower().encode("utf-8", "replace") for w in text.split()]
    if text.isascii():
        x = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint64)
        h = np.full(max(len(x) - 2, 0), _FNV_START)
        for k in range(3):
            h = ((h ^ x[k : k + len(h)]) * _FNV_PRIME) & _MASK
        out += np.bincount((h % np.uint64(dim)).astype(np.int64), minlength=dim)
    else:
        tokens += [text[i : i + 3].lower().encode("utf-8", "replace") for i in range(len(text) - 2)]
    out += np.bincount((fnv1a(tokens) % np.uint64(dim)).astype(np.int64), minlength=dim)
    return out


@F.pandas_udf(VECTOR)
def text_buckets(text: pd.Series) -> pd.Series:
    return pd.Series([hashed_counts(t or "").tolist() for t in text])


@F.pandas_udf(VECTOR)
def text_vector(text: pd.Series) -> pd.Series:
    return pd.Series([normalized(hashed_counts(t or "")).tolist() for t in text])


def pair_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    return np.unique((x[:-1] << 8) | x[1:], return_counts=True) if len(x) > 1 else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def pair_frequencies(rows: DataFrame) -> DataFrame:
    """(pair, n): in how many of the byte strings (one column) each pair occurs; pair -1 counts the strings."""

    def run(batches):
        total, n = np.zeros(1 << 16, np.int64), 0
        for b in batches:
            for x in b.column(0).to_pylist():
                n += 1
                total[pair_counts(x or b"")[0]] += 1
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(full, -1)), pa.array(np.append(total[full], n))], names=["pair", "n"])

    return rows.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def pair_vectors(df: DataFrame, id_: str = "id", data: str = "data", dim: int = DEFAULT.dimension) -> DataFrame:
    """(id, vector) of binary fragments: byte pairs, tf * (ln((N+1)/(df+1)) + 1), projected on the leading singular vectors.

    The 65,536 pairs bound the problem whatever the number of fragments: document
    frequencies and the cross-product of a random projection are sums over rows, so
    the basis comes from a randomised range finder (exact where fragments are fewer
    than the projection's width).  Signs are fixed: the largest component of every
    singular vector is positive.
    """
    context = df.sparkSession.sparkContext
    rows = df.select(F.col(id_).alias("id"), F.coalesce(F.col(data).cast("binary"), F.lit(b"")).alias("data"))

    found = pair_frequencies(rows.select("data")).toPandas()
    n = int(found.loc[found["pair"] == -1, "n"].sum())
    seen = found[found["pair"] >= 0]
    # only pairs that occur are numbered, and sent out
    seen = seen.sort_values("pair")
    at = np.zeros(1 << 16, np.int64)
    at[seen["pair"].to_numpy(np.int64)] = np.arange(len(seen))
    idf = np.log((n + 1) / (seen["n"].to_numpy(float) + 1)) + 1
    width = min(dim, n, len(seen))
    idf_shared = context.broadcast((at, idf))

    def weighted(x: bytes) -> tuple[np.ndarray, np.ndarray]:
        pair, m = pair_counts(x)
        at, idf = idf_shared.value
        return at[pair], m / max(m.sum(), 1) * idf[at[pair]]

    def product(basis: np.ndarray) -> np.ndarray:
        """(A^T A) basis, summed over all rows."""
        shared = context.broadcast(basis)

        def run(batches):
            out = np.zeros_like(shared.value)
            for b in batches:
                for x in b.column(1).to_pylist():
                    pair, w = weighted(x)
                    out[pair] += np.outer(w, w @ shared.value[pair])  # each pair once
            full = np.flatnonzero(np.abs(out).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(list(out[full]), pa.list_(pa.float64()))], names=["pair", "row"])

        def add(batches):
            out: dict[int, np.ndarray] = {}
            for b in batches:
                width = basis.shape[1]
                values = b.column(1).values.to_numpy().reshape(-1, width) if width else np.zeros((b.num_rows, 0))
                for p, v in zip(b.column(0).to_pylist(), values, strict=True):
                    if p in out:
                        out[p] += v
                    else:
                        out[p] = v.copy()
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.list_(pa.float64()))], names=["pair", "row"])

        # a row a pair reaches the driver, whatever the number of tasks
        parts = rows.mapInArrow(run, "pair long, row array<double>").repartition("pair").mapInArrow(add, "pair long, row array<double>").collect()
        out = np.zeros_like(basis)
        for r in parts:
            out[r["pair"]] = r["row"]
        shared.destroy()  # else each product's copies stay on the disk of every executor
        return out

    basis = np.zeros((len(seen), 0))
    if width:
        rng = np.random.default_rng(11)
        q = np.linalg.qr(rng.normal(size=(len(seen), min(width + 16, len(seen)))))[0]
        for _ in range(3):
            q = np.linalg.qr(product(q))[0]
        small = q.T @ product(q)
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        basis = q @ vectors[:, np.argsort(values)[::-1][:width]]
        basis *= np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])])
    shared = context.broadcast(basis)

    def project(batches):
        for b in batches:
            out = []
            for x in b.column(1).to_pylist():
                pair, w = weighted(x)
                v = np.zeros(dim)
                v[: shared.value.shape[1]] = w @ shared.value[pair] if len(pair) else 0
                out.append(normalized(v))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(v) for v in out], pa.list_(pa.float64()))], names=["id", "vector"])

    return rows.mapInArrow(project, T.StructType([rows.schema["id"], T.StructField("vector", T.ArrayType(T.DoubleType()))]))


def fingerprints(df: DataFrame, id_: str = "id", data: str = "data", kind: str = "characterization", dense: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, vector, method): text fragments by hashed tokens, or as ``dense`` embeds (id, text); binary and mixed ones by byte pairs."""
    text = F.col(kind) == "text"
    texts = df.where(text).select(F.col(id_).alias("id"), F.try_validate_utf8(F.col(data).cast("string")).alias("text"))
    one = dense(texts) if dense else texts.select("id", text_vector("text").alias("vector"), F.lit("hashed_tokens").alias("method"))
    two = pair_vectors(df.where(~text | F.col(kind).isNull()), id_, data).withColumn("method", F.lit("pair_tfidf_svd"))
    return one.unionByName(two)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Bounded to -1..1, rounded to 4 places; 0 for empty or zero vectors or anything that is no number."""
    from ..functions.profile import round4

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    c = F.when((norm > 0) & ~F.isnan(norm), dot(a, b) / norm).otherwise(0.0)
    c = F.when(F.isnan(c) | c.isNull(), 0.0).otherwise(c)
    return round4(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))
