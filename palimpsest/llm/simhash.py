"""SimHash near-duplicates: tiled exact comparison of fingerprints.

A fingerprint has 64 bits; a bit is set when more than half of the document's
3-word shingles have it set in their XXH64 (seed 42).  Distinct fingerprints are
dealt into tiles by their population counts in a few equal segments: two
fingerprints within ``radius`` bits have segment counts that differ by at most
``radius`` in sum, so tile pairs beyond that are skipped without a look.  The
remaining tile pairs are compared in full by exclusive-or and bit counts, a block
at a time.  A tile returns a spanning forest of its links, never all pairs, and
alternating star contractions join the forests into components.

At D distinct fingerprints about 2 % of D*D/2 pairs are compared at a radius of 2
(4 segments).  A tile that holds more than ``TILE`` fingerprints is cut, and its pieces
meet each piece of the other side once.

At a larger radius counts alone skip little.  There the bits are cut into one segment
more than the radius, so that fingerprints within it agree in a whole segment: a tile
holds the fingerprints of one pattern in one segment, and a larger tile is cut by
population counts, whose pieces meet only within the radius.  At a radius of 6 that is
1.3 % of all pairs, and a fingerprint goes to 7 tiles.

Defined results: a null or blank text has fingerprint zero and links like any
other; fewer than three words are one shingle; equal texts have equal fingerprints
and always link; a null doc_id is kept and never is a component_id unless no other
is reachable; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import star_components
from .anchors import numbered
from .common import bucket_count, id_text, lowered, mixed, stored, text_blocks, tidy, words

TILE = 1 << 14
SHINGLE = 3


SEGMENTS = 4
#: The largest radius at which tiles go by the population counts of segments.
BY_COUNTS = 2


def fingerprints_of(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """uint64 fingerprint of each row of a block."""
    rows = len(off) - 1
    data = lowered(data)
    start, end, first = words(data, off)
    # words of the block, each followed by one space
    size = end - start + 1
    to = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=to[1:])
    joined = np.full(int(to[-1]), 32, np.uint8)
    at = np.arange(len(joined)) - np.repeat(to[:-1] - start, size)
    keep = np.ones(len(joined), bool)
    keep[to[1:] - 1] = False
    joined[keep] = data[at[keep]]
    count = np.diff(first)
    shingles = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
    out = np.zeros(rows, np.uint64)
    if not shingles.sum():
        return out
    begin = np.zeros(rows + 1, np.int64)
    np.cumsum(shingles, out=begin[1:])
    word = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], shingles)
    stop = np.minimum(word + SHINGLE, np.repeat(first[1:], shingles))
    text, hashed = joined.tobytes(), xxhash.xxh64_digest
    digests = b"".join([hashed(text[a:b], 42) for a, b in zip(to[word].tolist(), (to[stop] - 1).tolist(), strict=True)])
    full = np.flatnonzero(shingles)
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    set_ = np.empty((len(full), 64), np.int64)
    for k, r in enumerate(full):
        set_[k] = bits[begin[r] : begin[r + 1]].sum(axis=0, dtype=np.int32 if shingles[r] < 1 << 30 else np.int64)
    out[full] = np.packbits(set_ * 2 > shingles[full, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a long) for every document."""

    def run(batches):
        for rows, data, off in text_blocks(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fingerprints_of(data, off).view(np.int64))], names=["doc_id", "fp"])

    return id_text(docs, doc_id, text).mapInArrow(tidy(run), "doc_id long, fp long")


def _steps(radius: int, segments: int) -> list[tuple[int, ...]]:
    """Differences of segment counts within the radius, one of each pair of opposites, none first."""
    near = [d for d in product(range(-radius, radius + 1), repeat=segments) if sum(map(abs, d)) <= radius]
    return [(0,) * segments] + [d for d in near if d > (0,) * segments]


def _counts(fp: np.ndarray, segments: int) -> np.ndarray:
    bits = 64 // segments
    shift = np.arange(segments, dtype=np.uint64) * np.uint64(bits)
    return np.bitwise_count((fp[:, None] >> shift) & np.uint64((1 << bits) - 1)).astype(np.int64)


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least reachable index of each of n nodes."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]
    return label


def _tile_links(own: np.ndarray, other: np.ndarray, radius: int, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among ``own`` and from ``own`` to ``other``."""
    a_out: list[np.ndarray] = []
    b_out: list[np.ndarray] = []
    every = np.concatenate([own, other])
    label = np.arange(len(every))
    for lo in range(0, len(own), block):
        x = own[lo : lo + block, None]
        for to in range(lo, len(every), block):
            i, j = np.nonzero(np.bitwise_count(x ^ every[None, to : to + block]) <= radius)
            i, j = i + lo, j + to
            fresh = label[i] != label[j]
            if fresh.any():
                i, j = label[i[fresh]], label[j[fresh]]
                nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
                root = nodes[components(len(nodes), at[: len(i)], at[len(i) :])]
                moved = root != nodes
                a_out.append(every[nodes[moved]])
                b_out.append(every[root[moved]])
                to_root = np.arange(len(every))
                to_root[nodes] = root
                label = to_root[label]
    if not a_out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(a_out), np.concatenate(b_out)


def _compare(radius: int):
    """Links of dealt fingerprints: rows (tile, piece, side, fp) in order of tile and piece."""

    def compare(batches):
        left: pd.DataFrame | None = None

        def done(df: pd.DataFrame) -> pa.RecordBatch:
            us, vs = [], []
            fp, side = df["fp"].to_numpy().view(np.uint64), df["side"].to_numpy()
            tile, piece = df["tile"].to_numpy(), df["piece"].to_numpy()
            cuts = np.flatnonzero((np.diff(tile) != 0) | (np.diff(piece) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(tile)], strict=True):
                s = side[lo:hi]
                if (s == 0).any() and hi - lo > 1:
                    u, v = _tile_links(fp[lo:hi][s == 0], fp[lo:hi][s == 1], radius)
                    us.append(u), vs.append(v)
            u = np.concatenate([*us, np.zeros(0, np.uint64)]).view(np.int64)
            v = np.concatenate([*vs, np.zeros(0, np.uint64)]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

        for b in batches:
            df = b.to_pandas()
            df = df if left is None else pd.concat([left, df], ignore_index=True)
            last = (df["tile"] == df["tile"].iat[-1]) & (df["piece"] == df["piece"].iat[-1]) if len(df) else np.zeros(0, bool)
            left = df[last]
            if len(df) > len(left):
                yield done(df[~last])
        if left is not None and len(left):
            yield done(left)

    return compare


def _segments(radius: int) -> list[tuple[int, int]]:
    """Shift and width of radius + 1 segments of 64 bits."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _pieces(size: np.ndarray, tile: int, radius: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Of a tile with ``size`` fingerprints of each population count: the first piece and the number of pieces of each count, and
    the pairs of pieces that can hold links."""
    first, many, span = np.zeros(65, np.int64), np.ones(65, np.int64), []
    pc = 0
    while pc < 65:
        to, total = pc + 1, int(size[pc])
        while to < 65 and total + size[to] <= tile:
            total += int(size[to])
            to += 1
        first[pc:to], many[pc:to] = len(span), max(1, -(-total // tile))
        span += [(pc, to - 1)] * int(many[pc])
        pc = to
    return first, many, [(p, q) for p in range(len(span)) for q in range(p, len(span)) if span[q][0] - span[p][1] <= radius]


def _links_by_pattern(distinct: DataFrame, radius: int, tile: int) -> DataFrame:
    """``links`` by equal segments: (segment, pattern) is a tile, a large one is cut by population counts."""
    segments = _segments(radius)
    width = max(w for _, w in segments)
    if width > 16:
        raise ValueError("a radius of 3 or more")

    def tiles(fp):
        for k, (shift, bits) in enumerate(segments):
            yield (np.int64(k) << width) + ((fp >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)

    def count(batches):
        total = np.zeros((len(segments) << width) * 65, np.int64)
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            pc = np.bitwise_count(fp).astype(np.int64)
            for t in tiles(fp):
                np.add.at(total, t * 65 + pc, 1)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full // 65), pa.array(full % 65), pa.array(total[full])], names=["tile", "pc", "n"])

    large = distinct.mapInArrow(count, "tile long, pc long, n long").groupBy("tile", "pc").agg(F.sum("n").alias("n"))
    large = large.join(large.groupBy("tile").agg(F.sum("n").alias("total")).where(F.col("total") > tile), "tile").collect()  # 65 rows a tile at most
    sizes: dict[int, np.ndarray] = {}
    for r in large:
        sizes.setdefault(r.tile, np.zeros(65, np.int64))[r.pc] = r.n
    cut = distinct.sparkSession.sparkContext.broadcast({t: _pieces(n, tile, radius) for t, n in sizes.items()})

    def deal(batches):
        def out(t, piece, side, fp):
            return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(t, len(fp))), pa.array(np.full(len(fp), piece, np.int64)), pa.array(np.full(len(fp), side, np.int8)), pa.array(fp.view(np.int64))], names=["tile", "piece", "side", "fp"])

        known = np.array(sorted(cut.value), np.int64)
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            pc = np.bitwise_count(fp).astype(np.int64)
            part = (mixed(fp) >> np.uint64(1)).astype(np.int64)
            for t in tiles(fp):
                split = np.isin(t, known)
                yield out(t[~split], 0, 0, fp[~split])
                for one in np.unique(t[split]):
                    mine = np.flatnonzero(t == one)
                    first, many, pairs = cut.value[int(one)]
                    own = first[pc[mine]] + part[mine] % many[pc[mine]]
                    for p, q in pairs:
                        number = (p << 31) + q
                        yield out(one, number, 0, fp[mine[own == p]])
                        if q > p:
                            yield out(one, number, 1, fp[mine[own == q]])

    dealt = distinct.select("fp").mapInArrow(tidy(deal), "tile long, piece long, side byte, fp long")
    return dealt.repartition(bucket_count(distinct, 1 << 20), "tile", "piece").sortWithinPartitions("tile", "piece").mapInArrow(tidy(_compare(radius)), "u long, v long")


def links(distinct: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """Links (u > v, as longs) that connect exactly what distances within the radius connect.

    ``distinct`` has one column fp of distinct longs.
    """
    spark = distinct.sparkSession
    if radius > BY_COUNTS:
        return _links_by_pattern(distinct, radius, tile)
    segments = SEGMENTS
    steps = np.array(_steps(radius, segments))
    base = 64 // segments + 1
    weight = base ** np.arange(segments)

    def count(batches):
        total = np.zeros(base**segments, np.int64)
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            np.add.at(total, _counts(fp, segments) @ weight, 1)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["tile", "n"])

    # at most 17**4 = 83,521 rows whatever the input
    found = distinct.mapInArrow(count, "tile long, n long").groupBy("tile").agg(F.sum("n").alias("n")).toPandas()
    size = np.zeros((base,) * segments, np.int64)
    size[tuple((found["tile"].to_numpy(np.int64)[:, None] // weight % base).T)] = found["n"].to_numpy(np.int64)
    incoming = np.zeros_like(size)
    for d in steps[1:]:
        src = tuple(slice(max(0, -k), base - max(0, k)) for k in d)
        dst = tuple(slice(max(0, k), base - max(0, -k)) for k in d)
        incoming[dst] += size[src]
    # pieces by tile; tiles of up to ``tile`` fingerprints stay whole
    large = {int(np.dot(k, weight)): (int(-(-size[tuple(k)] // tile)), max(1, int(-(-incoming[tuple(k)] // tile)))) for k in np.argwhere((size > tile) | ((size > 0) & (incoming > 16 * tile)))}
    present = spark.sparkContext.broadcast((size > 0, large))

    def deal(batches):
        there, cut = present.value
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            own = _counts(fp, segments)
            keys, pieces, sides, values = [], [], [], []
            for k, d in enumerate(steps):
                to = own + d
                ok = ((to >= 0) & (to < base)).all(axis=1)
                ok[ok] = there[tuple(to[ok].T)]
                key, val = to[ok] @ weight, fp[ok]
                side = np.full(len(key), int(k > 0), np.int8)
                split = np.isin(key, np.fromiter(cut, np.int64, len(cut))) if cut else np.zeros(len(key), bool)
                keys.append(key[~split]), pieces.append(np.zeros(int((~split).sum()), np.int32)), sides.append(side[~split]), values.append(val[~split])
                for t in np.unique(key[split]):
                    mine, (n, m) = val[split & (key == t)], cut[int(t)]
                    part = (mine * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                    if k:  # other side: one piece of m, to each of the n own pieces
                        for p in range(n):
                            keys.append(np.full(len(mine), t)), pieces.append((p * (n + m) + n + part % m).astype(np.int32)), sides.append(np.ones(len(mine), np.int8)), values.append(mine)
                    else:
                        part %= n
                        for q in range(n + m):
                            # as own side of piece pairs (part, q); as other side of (p, part), p < part
                            keys.append(np.full(len(mine), t)), pieces.append((part * (n + m) + q).astype(np.int32)), sides.append(np.zeros(len(mine), np.int8)), values.append(mine)
                        for p in range(n):
                            up = part > p
                            keys.append(np.full(int(up.sum()), t)), pieces.append((p * (n + m) + part[up]).astype(np.int32)), sides.append(np.ones(int(up.sum()), np.int8)), values.append(mine[up])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(pieces)), pa.array(np.concatenate(sides)), pa.array(np.concatenate(values).view(np.int64))], names=["tile", "piece", "side", "fp"])

    dealt = distinct.select("fp").mapInArrow(tidy(deal), "tile long, piece int, side byte, fp long")
    return dealt.repartition(bucket_count(distinct, 1 << 20), "tile", "piece").sortWithinPartitions("tile", "piece").mapInArrow(tidy(_compare(radius)), "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id for every document."""
    fps = stored(fingerprints(docs, doc_id, text), "simhash")
    least = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    root = star_components(links(least.select("fp"), radius))
    linked = least.join(root.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.select("fp", "root").join(named, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of one document of each component: the one with the least doc_id.

    Rows of one id are documents of their own; of such in a component one stays.  A null id comes last.
    """
    rows = numbered(docs, doc_id, text, rest=True)
    found = near_duplicates(rows.select("uid", "text"), radius, "uid", "text").select(F.col("doc_id").alias("uid"), "component_id")
    keep = rows.select("uid", "rank").join(found, "uid").groupBy("component_id").agg(F.min(F.struct("rank", "uid")).alias("first")).select("first.uid")
    names = [F.when(~F.col("void"), F.col("text")).alias(c) if c == text else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    return rows.join(keep, "uid", "left_semi").select(*names)
