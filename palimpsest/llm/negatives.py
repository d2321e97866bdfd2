"""Hard negatives: a Voronoi-partitioned distributed nearest-neighbour join over inner products.

Vectors are made one component longer, rows by sqrt(M^2 - |x|^2), anchors by 0, M the
largest norm of all: then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, and the greatest inner
products are the nearest neighbours.  Anchors fall in the cells of at most ``PIVOTS``
pivots, each cell cut into blocks of at most ``ANCHORS`` anchors, nearest to the pivot
first.  Every cell has its radius and the range of scores that its anchors still ask
for, bounded by what their block and a sample of at most ``SAMPLE`` rows already offer; by the triangle inequality over a row's distance to the pivot, and by the same
bound on the inner product itself, a row is replicated to only those cells that it
might serve.  Rows travel packed as blocks of numbers, cells with many are dealt over
many tasks, and each pair of blocks is joined exactly by one matrix product, of which
a task keeps the best few for each anchor.

Two such joins follow each other.  The first finds every anchor's positives, the second
negatives within the band of each positive's score.  The sample only excludes rows that
cannot be among the first few; results are exact.

The work of the matrix products is anchors times rows where the bounds can exclude
nothing, as among random directions.

Defined results: rows with a null id, label, vector or component take no part; of
vectors that differ in length the shorter is filled with zeros; a row's own copy is
another row; rows with one id are rows of their own, tied with each other; a positive
without a negative in its band gives no row, nor does one of negative score; no anchor
or an empty table gives an empty result.  Products beyond 64 bits wrap around.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, tidy

PIVOTS = 1024  # cells, a bound of what the driver and every task hold of the anchors
PIVOT_BYTES = 32 << 20
CELL_ANCHORS = 256  # a pivot for so many anchors, as far as PIVOTS goes
ANCHORS = 1024
SAMPLE = 4096
BLOCK_ROWS, BLOCK_BYTES = 4096, 1 << 20
SALT_ROWS = 1 << 17
BUFFER_BYTES = 32 << 20

LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def quantized(vector: Column, scale: int = 256) -> Column:
    """Whole numbers floor(scale * x) of a vector; null where a component is null or no finite number."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.when(~bad, F.transform(x, lambda v: F.floor(v * scale)))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Lists of whole numbers as rows of ``dim`` components."""
    off = column.offsets.to_numpy().astype(np.int64)
    size = np.diff(off)
    values = column.values.to_numpy(zero_copy_only=False)[off[0] :] if len(off) else np.zeros(0, np.int64)
    if (size == dim).all():
        return values[: len(size) * dim].reshape(-1, dim).astype(np.int64)
    out = np.zeros((len(size), dim), np.int64)
    place = np.arange(size.sum()) - np.repeat(off[:-1] - off[0], size)
    out[np.repeat(np.arange(len(size)), size), place] = values[: size.sum()]
    return out


def _pack(m: np.ndarray) -> tuple[int, bytes]:
    """Width in bytes and bytes of the narrowest whole numbers that hold a matrix."""
    low, high = (int(m.min()), int(m.max())) if m.size else (0, 0)
    width = next(w for w in (1, 2, 4, 8) if -(1 << (8 * w - 1)) <= low and high < 1 << (8 * w - 1))
    return width, m.astype(f"<i{width}").tobytes()


def _unpack(width: int, data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{width}").reshape(-1, dim)


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products as int64."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    most = [int(np.abs(x.astype(np.float64)).max(initial=0)) for x in (a, b)]
    if a.shape[1] * most[0] * most[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    with np.errstate(over="ignore"):
        return a.astype(np.int64) @ b.astype(np.int64).T


def _best(key: np.ndarray, score: np.ndarray, id_: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each key by score, greatest first, and id."""
    order = np.lexsort((id_, -score, key))
    sorted_key = key[order]
    first = np.searchsorted(sorted_key, sorted_key)
    return order[np.arange(len(order)) - first < k]


class _Kept:
    """The best few (score, id) of each key, from part to part."""

    def __init__(self, keys: int, k: int, floor: np.ndarray):
        self.k, self.key, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.low, self.last = floor.copy(), np.full(keys, MOST)  # of the k-th best so far: its score and id

    def add(self, key: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        use = (score > self.low[key]) | ((score == self.low[key]) & (id_ <= self.last[key]))
        if not use.any():
            return
        key, score, id_ = (np.concatenate(x) for x in ((self.key, key[use]), (self.score, score[use]), (self.id, id_[use])))
        at = _best(key, score, id_, self.k)
        self.key, self.score, self.id = key[at], score[at], id_[at]
        count = np.bincount(self.key, minlength=len(self.low))
        full = np.flatnonzero(count == self.k)
        end = np.searchsorted(self.key, full, side="right") - 1
        self.low[full], self.last[full] = self.score[end], self.id[end]


def _column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def _share(score: np.ndarray, per_cent: int) -> np.ndarray:
    """floor(per_cent * score / 100) without products beyond 64 bits."""
    return per_cent * (score // 100) + per_cent * (score % 100) // 100


Sample = tuple[np.ndarray, np.ndarray, np.ndarray]


def _sample(rows: DataFrame, dim: int) -> Sample:
    """Numbers, row numbers and labels of a few rows, by hash."""
    some = rows.select("row", "label", "v").orderBy(F.xxhash64("row", "id")).limit(max(1, min(SAMPLE, PIVOT_BYTES // max(8 * dim, 1)))).toArrow().combine_chunks()
    if not some.num_rows:
        return np.zeros((0, dim), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _matrix(some.column("v").chunk(0), dim), some.column("row").to_numpy(), some.column("label").to_numpy()


def _known(m: np.ndarray, row: np.ndarray, label: np.ndarray, sample: Sample) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Products of a block's anchors with each other and with the sample, whether labels are equal, and whether it is another row."""
    new = ~np.isin(sample[1], row)
    other, rows, labels = (np.concatenate(x) for x in ((m.astype(np.int64), sample[0][new]), (row, sample[1][new]), (label, sample[2][new])))
    return _products(m, other), label[:, None] == labels, row[:, None] != rows


def _floor(score: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row."""
    n = score.shape[1]
    return np.partition(score, n - k, axis=1)[:, n - k] if n >= k else np.full(len(score), LEAST)


def _blocks(anchors: DataFrame, pivots: np.ndarray, dim: int, k: int, sample: Sample) -> DataFrame:
    """Anchors by cell as packed blocks, with their radius and, of each anchor, a score that its k-th positive reaches."""
    total = anchors.count()
    shared = anchors.sparkSession.sparkContext.broadcast(pivots)
    known = anchors.sparkSession.sparkContext.broadcast(sample)

    def placed(batches):
        for b in batches:
            m = _matrix(_column(b, "v"), dim).astype(np.float64)
            p = shared.value.astype(np.float64)
            d = np.maximum((m * m).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * m @ p.T, 0)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(cell)), cell])), *b.columns], names=["cell", "far", *b.schema.names])

    def packed(batches):
        part, made = TaskContext.get().partitionId() << 32, 0
        most = max(1, min(ANCHORS, BLOCK_BYTES // max(8 * dim, 1)))
        for b in batches:
            cell = _column(b, "cell").to_numpy()
            for lo, hi in zip(*_runs(cell, most), strict=True):
                s = b.slice(lo, hi - lo)
                m, row, id_, label = _matrix(_column(s, "v"), dim), *(_column(s, n).to_numpy().astype(np.int64) for n in ("row", "id", "label"))
                score, same, other = _known(m, row, label, known.value)
                floor = _floor(np.where(same & other, score, LEAST), k)
                q = (m.astype(np.float64) ** 2).sum(axis=1)
                width, data = _pack(m)
                yield _rows([(int(cell[lo]), part + made, float(_column(s, "far").to_numpy().max()), int(floor.min()), MOST, float(q.max()), width, data, row.tobytes(), id_.tobytes(), label.tobytes(), floor.tobytes(), None)], BLOCKS)
                made += 1

    parts = max(1, min(total // (4 * ANCHORS), 1 << 16))
    near = anchors.select("row", "id", "label", "v").mapInArrow(placed, "cell int, far double, row long, id long, label long, v array<long>")
    cut = near.repartitionByRange(parts, "cell", "far", "row").sortWithinPartitions("cell", "far", "row")
    return stored(cut.mapInArrow(tidy(packed), BLOCKS), "anchors")


BLOCKS = "cell int, block long, far double, low long, high long, square double, width int, data binary, rows binary, ids binary, labels binary, floors binary, positives binary"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])


def _runs(cell: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Begins and ends of runs of one value, cut to at most so many."""
    edge = np.append(np.flatnonzero(np.diff(cell, prepend=cell[:1] - 1)), len(cell))
    lo = [x for a, b in zip(edge[:-1], edge[1:], strict=True) for x in range(int(a), int(b), most)]
    return lo, [*lo[1:], len(cell)]


def _served(rows: DataFrame, blocks: DataFrame, pivots: np.ndarray, dim: int, largest: float) -> DataFrame:
    """Rows packed for the cells that they might serve: (cell, salt, n, width, data, rows, ids, labels)."""
    cells = blocks.groupBy("cell").agg(F.max("far").alias("far"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("square").alias("square")).collect()  # a row a pivot
    at = np.array([r.cell for r in cells], np.int64)
    far, low, high, square = (np.array([r[n] for r in cells], np.float64) for n in ("far", "low", "high", "square"))
    shared = rows.sparkSession.sparkContext.broadcast((at, pivots[at].astype(np.float64), far, low, high, square))

    def might(m: np.ndarray) -> np.ndarray:
        """Which rows can have a score that a cell asks for."""
        _, p, far, low, high, square = shared.value
        size = (m * m).sum(axis=1)
        norm, slack = np.sqrt(size)[:, None], 1e-6 * (largest + square.max(initial=0) + 1)
        mid = m @ p.T
        ok = (mid + far * norm >= low - slack) & (mid - far * norm <= high + slack)
        # the same in distances of the longer vectors: |p' - x'| and the farthest that an anchor reaches
        apart = np.sqrt(np.maximum((p * p).sum(axis=1) + largest - 2 * mid, 0))
        reach = np.sqrt(np.maximum(square + largest - 2 * np.maximum(low, -1e300), 0))
        return ok & ((apart - far) ** 2 * (apart > far) <= reach**2 + slack)

    def run(batches):
        most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(2 * dim, 1)))
        held: dict[int, list[tuple]] = {}
        size: dict[int, int] = {}

        def out(c):
            m, row, id_, label = (np.concatenate(x) for x in zip(*held.pop(c), strict=True))
            del size[c]
            for k in range(0, len(m), most):
                width, data = _pack(m[k : k + most])
                yield _rows([(c, len(m[k : k + most]), width, data, row[k : k + most].tobytes(), id_[k : k + most].tobytes(), label[k : k + most].tobytes())], SERVED)

        for b in batches:
            for k in range(0, b.num_rows, most):
                s = b.slice(k, most)
                m, row, id_, label = _matrix(_column(s, "v"), dim), *(_column(s, n).to_numpy().astype(np.int64) for n in ("row", "id", "label"))
                ok = might(m.astype(np.float64))
                for j in np.flatnonzero(ok.any(axis=0)):
                    use, c = ok[:, j], int(shared.value[0][j])
                    held.setdefault(c, []).append((m[use], row[use], id_[use], label[use]))
                    size[c] = size.get(c, 0) + int(use.sum())
                    if size[c] >= most:
                        yield from out(c)
                while sum(size.values()) * 8 * (dim + 3) > BUFFER_BYTES:
                    yield from out(max(size, key=size.get))
        for c in list(held):
            yield from out(c)

    found = stored(rows.select("row", "id", "label", "v").mapInArrow(tidy(run), SERVED), "served")
    counts = {r.cell: r.n for r in found.groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # a row a pivot
    salts = F.element_at(F.array(*[F.lit(max(1, -(-counts.get(c, 0) // SALT_ROWS))) for c in range(len(pivots))]), F.col("cell") + 1)
    found = found.withColumn("salt", F.pmod(F.xxhash64("rows"), salts).cast("int"))
    dealt = blocks.drop("far", "low", "high", "square").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    # blocks of anchors stream, rows of a cell and salt are held against each
    return dealt.hint("merge").join(found.select("cell", "salt", F.col("width").alias("x_width"), F.col("data").alias("x_data"), F.col("rows").alias("x_rows"), F.col("ids").alias("x_ids"), F.col("labels").alias("x_labels")), ["cell", "salt"])


SERVED = "cell int, n int, width int, data binary, rows binary, ids binary, labels binary"


def _joined(pairs: DataFrame, begin, step, end, schema: str) -> DataFrame:
    """Runs of one block of anchors: ``begin`` makes their state, ``step`` adds rows to it, ``end`` gives what is kept."""

    def run(batches):
        block, state, row = None, None, None
        for b in batches:
            for row in b.to_pylist():
                if block != row["block"]:
                    if state is not None:
                        yield from end(state)
                    block, state = row["block"], begin(row)
                step(state, row)
        if state is not None:
            yield from end(state)

    return pairs.mapInArrow(tidy(run), schema)


def _positives(pairs: DataFrame, dim: int, k: int) -> DataFrame:
    """(block, slot, place, id, score): the first k rows of an anchor's own label."""

    def begin(r):
        floors = _longs(r["floors"])
        return {"block": r["block"], "m": _unpack(r["width"], r["data"], dim), "row": _longs(r["rows"]), "label": _longs(r["labels"]), "kept": _Kept(len(floors), k, floors)}

    def step(s, r):
        score = _products(s["m"], _unpack(r["x_width"], r["x_data"], dim))
        ok = (s["label"][:, None] == _longs(r["x_labels"])) & (s["row"][:, None] != _longs(r["x_rows"])) & (score >= s["kept"].low[:, None])
        a, b = np.nonzero(ok)
        s["kept"].add(a, score[a, b], _longs(r["x_ids"])[b])

    def end(s):
        kept = s["kept"]
        if len(kept.key):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept.key), s["block"])), pa.array(kept.key.astype(np.int32)), pa.array(kept.id), pa.array(kept.score)], names=["block", "slot", "id", "score"])

    found = _joined(pairs, begin, step, end, "block long, slot int, id long, score long")
    place = F.row_number().over(W.partitionBy("block", "slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def _asked(blocks: DataFrame, positives: DataFrame, dim: int, k: int, n: int, band: tuple[int, int], sample: Sample) -> DataFrame:
    """Blocks with their positives and the range of scores that a negative can have."""
    each = positives.groupBy("block").agg(F.collect_list(F.struct("slot", "place", "id", "score")).alias("found"))  # k for each anchor of a block
    known = blocks.sparkSession.sparkContext.broadcast(sample)

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                label, size = _longs(r["labels"]), len(_longs(r["ids"]))
                at = np.array([(x["slot"], x["place"] - 1) for x in r["found"]], np.int64).reshape(-1, 2)
                pos = np.full((2, size, k), -1, np.int64)
                pos[0, at[:, 0], at[:, 1]] = [x["id"] for x in r["found"]]
                pos[1, at[:, 0], at[:, 1]] = np.maximum([x["score"] for x in r["found"]], -1)  # below zero no band holds a score
                has = pos[1] >= 0
                if not has.any():
                    continue
                m = _unpack(r["width"], r["data"], dim)
                score, same, _ = _known(m, _longs(r["rows"]), label, known.value)
                low = np.full((size, k), MOST)
                for j in range(k):  # the first n negatives among a few rows bound those of all
                    p = pos[1][:, j, None]
                    least = -_share(-p, band[0])
                    best = _floor(np.where(~same & (score >= least) & (score <= _share(p, band[1])), score, LEAST), n)
                    low[:, j] = np.maximum(best, least[:, 0])
                low[~has] = MOST
                floors = low.min(axis=1)
                high = int(_share(pos[1], band[1]).max())
                q = float((m[has.any(axis=1)].astype(np.float64) ** 2).sum(axis=1).max())
                yield _rows([(*(r[c] for c in ("cell", "block", "far")), int(floors.min()), high, q, *(r[c] for c in ("width", "data", "rows", "ids", "labels")), low.tobytes(), pos.tobytes())], BLOCKS)

    return stored(blocks.drop("positives").join(each, "block").mapInArrow(tidy(run), BLOCKS), "asked")


def _negatives(pairs: DataFrame, dim: int, k: int, n: int, band: tuple[int, int]) -> DataFrame:
    def begin(r):
        low = _longs(r["floors"])
        pos = _longs(r["positives"]).reshape(2, -1, k)
        return {"block": r["block"], "m": _unpack(r["width"], r["data"], dim), "id": _longs(r["ids"]), "label": _longs(r["labels"]), "pos": pos, "high": _share(pos[1].max(axis=1), band[1]), "kept": _Kept(len(low), n, low)}

    def step(s, r):
        score = _products(s["m"], _unpack(r["x_width"], r["x_data"], dim))
        low = s["kept"].low.reshape(-1, k)
        a, b = np.nonzero((s["label"][:, None] != _longs(r["x_labels"])) & (score >= low.min(axis=1)[:, None]) & (score <= s["high"][:, None]))
        got, id_ = score[a, b], _longs(r["x_ids"])[b]
        for j in range(k):
            p = s["pos"][1][a, j]
            use = (p >= 0) & (got >= -_share(-p, band[0])) & (got <= _share(p, band[1]))
            s["kept"].add(a[use] * k + j, got[use], id_[use])

    def end(s):
        kept = s["kept"]
        if len(kept.key):
            slot, j = kept.key // k, kept.key % k
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), s["block"])), pa.array(kept.key.astype(np.int32)), pa.array(s["id"][slot]), pa.array(s["pos"][0][slot, j]), pa.array(kept.id), pa.array(s["pos"][1][slot, j]), pa.array(kept.score)], names=["block", "key", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    found = _joined(pairs, begin, step, end, "block long, key int, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    place = F.row_number().over(W.partitionBy("block", "key").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= n).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, band: tuple[int, int] = (80, 100), id_: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` hold arrays of whole numbers, ``anchor`` says which rows are anchors.  An
    anchor's positives are the first ``positives`` other rows of its label by inner product
    and id; their negatives the first ``negatives`` rows of other labels whose score is
    from band[0] to band[1] per cent of the positive's.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector).cast("array<long>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("square", square), "vectors")
    size = rows.agg(F.max(F.size("v")).alias("dim"), F.max("square").alias("square"), F.count_if("anchor").alias("anchors")).first()
    if not size.anchors:
        return spark.createDataFrame([], SCHEMA)
    dim, anchors = int(size.dim), rows.where("anchor")
    count = max(1, min(PIVOTS, PIVOT_BYTES // max(8 * dim, 1), -(-size.anchors // CELL_ANCHORS)))
    chosen = anchors.select("v").orderBy(F.xxhash64("id"), "row").limit(count).toArrow()
    pivots = _matrix(chosen.column("v").combine_chunks(), dim)
    sample = _sample(rows, dim)
    blocks = _blocks(anchors, pivots, dim, positives, sample)
    found = _positives(_served(rows, blocks, pivots, dim, size.square), dim, positives)
    asked = _asked(blocks, found, dim, positives, negatives, band, sample)
    return _negatives(_served(rows, asked, pivots, dim, size.square), dim, positives, negatives, band)


def oracle_sql() -> str:
    """Every anchor against every row."""
    return """WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score QUALIFY rank <= 5"""
