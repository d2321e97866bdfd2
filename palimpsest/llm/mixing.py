"""Mixing sources to target weights: balanced sampling by the cube method.

Sources in the order of their names weigh ``weights`` in turn and share ``share`` times
all words; a source gets at most ``cap`` times its own, what is over goes to the others
by weight until none is above.  A source whose target is r times its size takes every
document floor(r) times, and once more with the inclusion probability r - floor(r).

These probabilities make the flight of the cube method: three undecided documents at a
time move along the null space of the two constraints, their words and their number,
until one of them is in or out, so that both totals of the source stay as they are.
Sources are cut into blocks of about ``BLOCK`` documents by a hash; what is left of a
block, two documents, goes on to the next round, where fewer blocks remain.  In the last
block of a source the longest open document moves against all others, so that a few short
ones are left; among all their subsets the landing takes that whose words, and next whose
number, are nearest to what is open.  A few documents of every length wait for that
block.  Only where a source's open document is longer than
all others can make up, single short documents change to come near the target.

Every random number comes from a hash of the documents of a block, so runs agree
whatever the partitions are.

Defined results: a null text has no words; a null source is a source, the last; a null
doc_id is a document of its own; rows equal in doc_id, source and size share their
probability, all but a fraction of one are decided by rounding, and which of them is
taken makes no difference; documents without words take 0; an empty table gives an
empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.intervals import global_rank
from .common import bucket_count, stored, text_blocks, tidy, words

WEIGHTS = (5, 2, 1)
BLOCK = 2048
LANDING = 12
WAITING = 512  # of a source of many blocks, documents that wait for the last one
SEED = 20
SENT_SOURCES = 1 << 16  # sources whose figures are sent to every task; more are joined, salted
SALTS = 32
CHUNK = 1 << 16
EPS = 1e-9

KEY = ["no_source", "source"]


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, no_source, source, size: the words of every text."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{source}`").isNull().alias("no_source"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("source"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches):
        for b, data, off in text_blocks(batches):
            first = words(data, off)[2]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(first).astype(np.int64))], names=["doc_id", *KEY, "size"])

    return rows.mapInArrow(tidy(run), "doc_id long, no_source boolean, source string, size long")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """no_source, source, weight, source_size, target of every source."""
    found = sized.groupBy(*KEY).agg(F.sum("size").alias("source_size"))
    ranked = global_rank(found, [F.asc("no_source"), F.asc("source")], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = stored(ranked.select(*KEY, weight.alias("weight"), "source_size"), "sources")
    level, capped = None, -1
    size, w = F.col("source_size"), F.col("weight")
    while True:  # a water level that rises until no further source is above its cap
        over = F.lit(False) if level is None else w * level > cap * size
        r = ranked.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, size).otherwise(0)).alias("full"), F.sum(F.when(over, 0.0).otherwise(w)).alias("open"), F.sum(over.cast("long")).alias("n")).first()
        if r.n is None or r.n == capped:
            break
        capped = r.n
        level = (share * r.all - cap * r.full) / r.open if r.open else float("inf")
    level = F.lit(0.0 if level is None else float(level))
    return ranked.withColumn("target", F.least(w * level, cap * size.cast("double")))


def _with_sources(rows: DataFrame, per_source: DataFrame, n: int) -> DataFrame:
    """Join on the source: its figures go to every task, or rows and figures are dealt by source and salt."""
    if n <= SENT_SOURCES:
        return rows.join(F.broadcast(per_source), KEY)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int"))
    return salted.join(per_source.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*KEY, "salt"]).drop("salt")


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities moved to 0 or 1, all but two at most, with the sums of p and p * size as they were."""
    p, s, n = p.tolist(), size.tolist(), len(p)
    draws = iter(rng.random(4 * n + 8).tolist())
    live = [i for i in range(n) if EPS < p[i] < 1 - EPS]
    live, left = live[:3], live[3:][::-1]
    while len(live) == 3:
        i, j, k = live
        u = (s[j] - s[k], s[k] - s[i], s[i] - s[j])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[x]) / v if v > 0 else p[x] / -v for x, v in zip(live, u, strict=True) if v)
        down = min(p[x] / v if v > 0 else (1 - p[x]) / -v for x, v in zip(live, u, strict=True) if v)
        step = up if next(draws) * (up + down) < down else -down
        for x, v in zip(live, u, strict=True):
            p[x] = min(1.0, max(0.0, p[x] + step * v))
        stay = [x for x in live if EPS < p[x] < 1 - EPS]
        while len(stay) < 3 and left:
            stay.append(left.pop())
        live = stay
    out = np.array(p)
    return np.where((out <= EPS) | (out >= 1 - EPS), np.round(out), out)


@functools.lru_cache(maxsize=32)
def _subsets(n: int) -> np.ndarray:
    return ((np.arange(1 << n)[:, None] >> np.arange(n)) & 1).astype(np.float64)


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Zeros and ones for a few open probabilities: their words, next their number, nearest to the expected ones."""
    some = _subsets(len(p))
    miss = np.abs(some @ size - p @ size) + 0.01 * max(1.0, size.mean()) * np.abs(some.sum(axis=1) - p.sum())
    return some[int(miss.argmin())]


UNIT = "no_source boolean, source string, doc_id long, size long, rows long, source_size long, target double, whole int, sure long, hash long, late boolean, p double"


def descent(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight with all open documents at once: the longest moves, all others share the opposite move, until ``LANDING`` short ones are left."""
    p = p.copy()
    for k in np.argsort(-size, kind="stable").tolist():
        while EPS < p[k] < 1 - EPS:
            open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
            if len(open_) <= LANDING:
                return np.where((p <= EPS) | (p >= 1 - EPS), np.round(p), p)
            q, s = p[open_], size[open_] / size[open_].max() if size[open_].max() else size[open_]
            d, a = q * (1 - q), np.stack([np.ones(len(q)), s])
            own = np.where(open_ == k, 1.0, 0.0)
            u = d * (own - a.T @ (np.linalg.pinv(a * d @ a.T) @ (a @ (d * own))))
            if np.abs(u).max() < 1e-6 * d.max():  # nothing can make up for it
                break
            u[np.abs(u) < 1e-12 * np.abs(u).max()] = 0
            with np.errstate(divide="ignore", invalid="ignore"):
                up = np.where(u > 0, (1 - q) / u, np.where(u < 0, q / -u, np.inf)).min()
                down = np.where(u > 0, q / u, np.where(u < 0, (1 - q) / -u, np.inf)).min()
            p[open_] = np.clip(q + (up if rng.random() * (up + down) < down else -down) * u, 0, 1)
    return np.where((p <= EPS) | (p >= 1 - EPS), np.round(p), p)


def repaired(taken: np.ndarray, size: np.ndarray, words_: float) -> np.ndarray:
    """Where a long document was more than all others could make up: single documents change, the nearest to what is missing first, while the words come nearer."""
    taken = taken.copy()
    while True:
        miss = words_ - taken @ size
        if abs(miss) < 1:
            return taken
        rest = np.where(taken == (0.0 if miss > 0 else 1.0), np.abs(abs(miss) - size), np.inf)
        k = int(rest.argmin())
        if rest[k] >= abs(miss):
            return taken
        taken[k] = 1 - taken[k]


def _moved(seed: list[int], t):
    """A block after its flight and, where it is its source's last, the landing."""
    names = [x.split()[0] for x in UNIT.split(", ")]
    if t["block"][0].as_py() < 0:
        return t.select(names)
    last = t["blocks"][0].as_py() == 1
    h, id_, size = (t[c].fill_null(np.iinfo(np.int64).min).to_numpy() for c in ("hash", "doc_id", "size"))
    order, p = np.lexsort((id_, h)), t["p"].to_numpy().copy()
    rng = np.random.default_rng([*seed, int(h.min()) & 0xFFFFFFFFFFFF, int(h.astype(np.uint64).sum()) & 0xFFFFFFFFFFFF])
    size = size[order].astype(np.float64)
    q = (descent if last else flight)(p[order], size, rng)
    rest = np.flatnonzero((q > 0) & (q < 1))
    if len(rest) > LANDING + 2:
        q[rest] = flight(q[rest], size[rest], rng)
        rest = np.flatnonzero((q > 0) & (q < 1))
    if last and len(rest):
        q[rest] = landing(q[rest], size[rest])
    if last:
        q = repaired(q, size, float(p @ t["size"].to_numpy()))
    p[order] = q
    return t.set_column(t.schema.get_field_index("p"), "p", pa.array(p)).select(names)


def decided(units: DataFrame, sources: int, seed: int = SEED) -> DataFrame:
    """Units with p of 0 or 1: flights in blocks, in rounds of fewer blocks, and the landing."""
    open_, out, round_ = units.where((F.col("p") > EPS) & (F.col("p") < 1 - EPS)), units.where((F.col("p") <= EPS) | (F.col("p") >= 1 - EPS)), 0
    many = open_.groupBy(*KEY).agg(F.count("*").alias("n"))
    late = (F.col("n") > BLOCK) & (F.pmod(F.xxhash64("hash", F.lit(-1)), F.col("n")) < WAITING)
    open_ = _with_sources(open_.drop("late"), many, sources).withColumn("late", late).select(units.columns)
    while True:
        counts = open_.groupBy(*KEY).agg(F.greatest(F.lit(1), F.ceil(F.count_if(~F.col("late")) / BLOCK)).cast("long").alias("blocks"))
        block = F.when(F.col("late") & (F.col("blocks") > 1), -1).otherwise(F.pmod(F.xxhash64("hash", F.lit(round_)), F.col("blocks")))
        dealt = _with_sources(open_, counts, sources).withColumn("block", block)
        moved = stored(dealt.groupBy(*KEY, "block").applyInArrow(functools.partial(_moved, [seed, round_]), UNIT), f"flight-{round_}")
        out = out.unionByName(moved.where("p <= 0 or p >= 1"))
        open_ = moved.where("p > 0 and p < 1")
        if open_.isEmpty():
            return out
        round_ += 1


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row for documents equal in doc_id, source and size: ``rows`` of them, each taken ``whole`` times, ``extra`` of them once more."""
    sized = stored(sizes(docs, doc_id, text, source), "sizes")
    per_source = stored(targets(sized, weights, share, cap), "targets")
    n = per_source.count()
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = _with_sources(sized.groupBy(*KEY, "doc_id", "size").agg(F.count("*").alias("rows")), per_source.drop("weight").withColumn("ratio", ratio), n)
    units = units.withColumn("whole", F.floor(F.col("ratio") + EPS).cast("int"))
    mass = F.col("rows") * F.greatest(F.lit(0.0), F.col("ratio") - F.col("whole"))
    units = units.withColumn("sure", F.floor(mass + EPS).cast("long")).withColumn("hash", F.xxhash64(F.lit(seed), "doc_id", "size", *KEY))
    units = units.withColumn("late", F.lit(False)).withColumn("p", F.greatest(F.lit(0.0), mass - F.col("sure"))).select(*[x.split()[0] for x in UNIT.split(", ")])
    done = decided(stored(units, "units"), n, seed)
    return done.withColumn("extra", F.col("sure") + F.round("p").cast("long")).drop("sure", "p", "hash", "late")


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document; options as of ``plan``."""
    done = plan(docs, **options)
    many = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / CHUNK))).alias("chunk")
    one, more = done.where(F.col("rows") <= CHUNK).withColumn("chunk", F.lit(0).cast("long")), done.where(F.col("rows") > CHUNK).select("*", many)
    each = one.unionByName(more.repartition(bucket_count(docs), "chunk", "doc_id"))
    at = F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("rows")) - 1)).alias("at")
    each = each.select("*", at).withColumn("copies", (F.col("whole") + (F.col("at") < F.col("extra")).cast("int")).cast("int"))
    return each.select("doc_id", F.when(~F.col("no_source"), F.col("source")).alias("source"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their columns."""
    from pyspark.sql import Window as W

    done = plan(docs, doc_id=doc_id, text=text, source=source, **options).select(F.struct("*").alias("_plan"))
    clean = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    own = [F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{source}`").isNull().alias("no_source"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("source"), F.regexp_count(clean, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.struct(*own).alias("_key"), F.xxhash64(clean).alias("_text"))
    rows = rows.withColumn("_at", F.row_number().over(W.partitionBy("_key").orderBy("_text")) - 1)
    same = F.col("_key.doc_id").eqNullSafe(F.col("_plan.doc_id")) & (F.col("_key.no_source") == F.col("_plan.no_source")) & (F.col("_key.source") == F.col("_plan.source")) & (F.col("_key.size") == F.col("_plan.size"))
    copies = F.col("_plan.whole") + (F.col("_at") < F.col("_plan.extra")).cast("int")
    return rows.join(done, same).withColumn("_copies", copies).where("_copies > 0").select(F.explode(F.array_repeat("_row", F.col("_copies").cast("int"))).alias("_row")).select("_row.*")
