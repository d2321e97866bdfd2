"""Conversation prefix trie: succinct level-order tries of prefix shards.

Every rebuilt conversation is a path; the key of a prefix is a 128-bit chain hash of its
turns (SHA-256 of role and text, BLAKE2 over the chain), so that equal keys are equal
prefixes.  Prefixes with many turns below them (``heavy``) are the upper levels of the
trie.  The first other prefix of a path names its shard, which has few turns by
definition; shards are dealt over tasks by hash.  A task builds the trie of its shards
level by level with numpy: a LOUDS bit vector (for each node, in level order, a one for
each child and then a zero) and arrays of labels; parents come from the bits by rank and
select, and sums over subtrees from ``np.add.at`` over the levels in reverse.

Upper levels merge apart: members come from one aggregation, sums below them from the
roots of the shards, each of which adds to all of its heavy ancestors, aggregated in
parts before the shuffle.  The members that end at a heavy prefix are sorted by ranges
and joined as text in many tasks; only the chunks of text stream through the one hash.

Defined results: rows with a null conv_id take no part; a null turn comes first, rows of
one turn number follow each other by the hash of role and text; null role and text are
empty; c%5 is not negative, also of a negative c; a conversation may be longer than
memory allows for its texts but not for 24 bytes a turn; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, stored, tidy

FAMILY, SHARE = 5, 9
ROOT = bytes(16)
#: A prefix is heavy if more turns than this, or than this share of all, are below it, of more than so many conversations.
HEAVY, HEAVY_SHARE, HEAVY_MEMBERS = 4096, 1 << 16, 32
SENT = 1 << 20  # heavy prefixes that are sent to every task at most; the bound of turns rises until they are that few
SHARD_TURNS = 1 << 18
ENDS = 1 << 14
NONE = hashlib.sha256(b"").hexdigest()

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


class Louds:
    """A forest in level order: ones for the children of each node, then a zero; first those of a root above all."""

    def __init__(self, degrees: np.ndarray):
        ones = np.cumsum(degrees)
        self.bits = np.ones(len(degrees) + int(degrees.sum()), bool)
        self.bits[ones + np.arange(len(degrees))] = False
        self.zeros = np.cumsum(~self.bits)  # rank of zeros up to each place

    def parents(self) -> np.ndarray:
        """Of every node but the root above all: the node whose ones hold its place."""
        return self.zeros[np.flatnonzero(self.bits)]

    def degrees(self) -> np.ndarray:
        return np.diff(np.flatnonzero(~self.bits), prepend=-1) - 1


def forest(conv: np.ndarray, length: np.ndarray, keys: np.ndarray, size: np.ndarray, above: np.ndarray) -> dict[str, np.ndarray]:
    """Nodes of a forest of paths, in level order.

    ``conv`` and ``length`` are those of the paths, ``keys`` (two words a turn) and ``size`` of
    their turns, one path after the other, ``above`` what number of turns is above each path.
    """
    first = np.cumsum(length) - length
    live, parent, place = np.flatnonzero(length > 0), np.zeros(len(conv), np.int64), np.zeros(len(conv), np.int64)
    base, levels = 1, [(0, 1)]
    degrees: list[np.ndarray] = []
    out: dict[str, list[np.ndarray]] = {n: [] for n in ("conv_id", "n_convs", "size", "depth")}
    depth = 0
    while len(live):
        at = first[live] + depth
        order = np.lexsort((keys[at, 1], keys[at, 0], parent[live]))
        live, at = live[order], at[order]
        p = parent[live]
        new = np.append(True, (p[1:] != p[:-1]) | (keys[at[1:]] != keys[at[:-1]]).any(axis=1))
        begin = np.flatnonzero(new)
        node = base + np.cumsum(new) - 1
        out["conv_id"].append(np.minimum.reduceat(conv[live], begin))
        out["n_convs"].append(np.diff(np.append(begin, len(live))))
        out["size"].append(size[at[begin]])
        out["depth"].append(above[live[begin]] + depth + 1)
        low, high = levels[-1]
        degrees.append(np.bincount(p[begin] - low, minlength=high - low))
        place[live] = node
        levels.append((base, base + len(begin)))
        base += len(begin)
        depth += 1
        stay = length[live] > depth
        live = live[stay]
        parent[live] = place[live]
    low, high = levels[-1]
    louds = Louds(np.concatenate([*degrees, np.zeros(high - low, np.int64)]) if degrees else np.zeros(1, np.int64))
    parents, degree = np.append(-1, louds.parents()), louds.degrees()
    made = {n: np.append(0, np.concatenate(x)) if x else np.zeros(1, np.int64) for n, x in out.items()}
    leaves, saved = (degree == 0).astype(np.int64), np.maximum(made["n_convs"] - 1, 0) * made["size"]
    for low, high in levels[:0:-1]:
        np.add.at(leaves, parents[low:high], leaves[low:high])
        np.add.at(saved, parents[low:high], saved[low:high])
    return made | {"parent": parents, "n_children": degree, "n_leaves": leaves, "saved": saved, "last": place}


def ends_digests(conv: np.ndarray, last: np.ndarray, nodes: int) -> list[str]:
    """SHA-256 of the ids that end at each node, ascending, comma-joined."""
    out = [NONE] * nodes
    order = np.lexsort((conv, last))
    ids, at = conv[order].tolist(), last[order]
    begin = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else []
    for lo, hi in zip(begin, [*begin[1:], len(at)], strict=True):
        out[at[lo]] = hashlib.sha256(",".join(map(str, ids[lo:hi])).encode()).hexdigest()
    return out


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, family, turn, digest, size of every turn; texts stay behind."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    conv = F.col("conv_id").cast("long")
    return conversations.where(conv.isNotNull()).select(conv.alias("conv_id"), (conv - F.pmod(conv, F.lit(FAMILY))).alias("family"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id, keys (16 bytes a turn), sizes (8 bytes a turn) of every rebuilt conversation."""
    turns = _turns(conversations)
    dealt = turns.repartition(bucket_count(turns), "family").sortWithinPartitions("family", "conv_id", F.asc_nulls_first("turn"), "digest")

    def run(batches):
        rows: list[tuple] = []
        held = 0
        head: tuple[int, bytes, bytes] = (0, b"", b"")  # the first turns of a family's first conversation
        conv, family, digests, sizes = None, None, bytearray(), bytearray()

        def rebuilt():
            nonlocal head
            if conv == family:
                head = (conv, bytes(digests[: 16 * (SHARE - 1)]), bytes(sizes[: 8 * (SHARE - 1)]))
                d, s = digests, sizes
            else:
                h = zlib.crc32(str(conv).encode()) % SHARE
                of = head if head[0] == family else (family, b"", b"")
                d, s = of[1][: 16 * h] + digests[16 * h :], of[2][: 8 * h] + sizes[8 * h :]
            key, keys = ROOT, bytearray()
            for k in range(0, len(d), 16):
                key = hashlib.blake2b(key + d[k : k + 16], digest_size=16).digest()
                keys += key
            return conv, bytes(keys), bytes(s)

        def flush():
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["conv_id", "keys", "sizes"])

        for b in batches:
            if not b.num_rows:
                continue
            ids, families = b.column(0).to_numpy(), b.column(1).to_numpy()
            digest, size = b.column(3).to_pylist(), b.column(4).to_numpy().astype("<i8")
            edge = np.append(np.flatnonzero(np.diff(ids, prepend=ids[0] if conv is None else conv)), len(ids))
            if edge[0] != 0:
                edge = np.append(0, edge)
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if conv is not None and conv != ids[lo]:
                    rows.append(rebuilt())
                    held += len(rows[-1][1])
                    digests, sizes = bytearray(), bytearray()
                    if held > 1 << 22:
                        yield from flush()
                        rows, held = [], 0
                conv, family = int(ids[lo]), int(families[lo])
                digests += b"".join(digest[lo:hi])
                sizes += size[lo:hi].tobytes()
        if conv is not None:
            rows.append(rebuilt())
        if rows:
            yield from flush()

    return stored(dealt.mapInArrow(tidy(run), "conv_id long, keys binary, sizes binary"), "paths")


def _prefixes(rows: DataFrame) -> DataFrame:
    """key, conv_id, n_convs, below, size, depth of every prefix: one aggregation."""

    def run(batches):
        for b in batches:
            ids, n = b.column(0).to_numpy(), np.array([len(x) // 16 for x in b.column(1).to_pylist()], np.int64)
            keys = b"".join(b.column(1).to_pylist())
            total = int(n.sum())
            at = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
            size = np.frombuffer(b"".join(b.column(2).to_pylist()), "<i8")
            key = pa.Array.from_buffers(pa.binary(16), total, [None, pa.py_buffer(keys)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([key, pa.array(np.repeat(ids, n)), pa.array(np.repeat(n, n) - at), pa.array(size), pa.array(at + 1)], names=["key", "conv_id", "below", "size", "depth"])

    each = rows.mapInArrow(tidy(run), "key binary, conv_id long, below long, size long, depth long")
    return each.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("below").alias("below"), F.max("size").alias("size"), F.max("depth").alias("depth"))


def _split(rows: DataFrame, heavy: set[bytes]) -> DataFrame:
    """Paths below heavy prefixes (kind 0), heavy prefixes with those above them (1), conversations that end at one (2)."""
    shared = rows.sparkSession.sparkContext.broadcast(heavy)

    def run(batches):
        known, seen = shared.value, set()
        for b in batches:
            out: list[tuple] = []
            for conv, keys, sizes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                d = 0
                while d < len(keys) and keys[d : d + 16] in known:
                    key = keys[d : d + 16]
                    if key not in seen:
                        seen.add(key)
                        out.append((1, key, None, None, None, keys[:d]))
                    d += 16
                if d < len(keys):
                    out.append((0, keys[d : d + 16], conv, keys[d:], sizes[d // 2 :], keys[:d]))
                else:
                    out.append((2, keys[d - 16 :] if d else ROOT, conv, None, None, None))
            if out:
                kinds = (pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["kind", "key", "conv_id", "keys", "sizes", "above"])

    return stored(rows.mapInArrow(tidy(run), "kind int, key binary, conv_id long, keys binary, sizes binary, above binary"), "parts")


def _shards(parts: DataFrame, heavy: dict[bytes, int]) -> DataFrame:
    """Nodes below heavy prefixes; ``above`` holds the heavy prefixes above the roots of shards."""
    shared = parts.sparkSession.sparkContext.broadcast(heavy)
    light = parts.where("kind = 0").select("key", "conv_id", "keys", "sizes", "above")
    dealt = light.repartition(bucket_count(light), "key").sortWithinPartitions("key", "conv_id")

    def built(rows):
        conv = np.array([r[1] for r in rows], np.int64)
        length = np.array([len(r[2]) // 16 for r in rows], np.int64)
        keys = np.frombuffer(b"".join(r[2] for r in rows), "<u8").reshape(-1, 2)
        size = np.frombuffer(b"".join(r[3] for r in rows), "<i8")
        t = forest(conv, length, keys, size, np.array([len(r[4]) // 16 for r in rows], np.int64))
        ends = ends_digests(conv, t["last"], len(t["parent"]))[1:]
        parent = t["parent"][1:]
        first = np.cumsum(length) - length
        owner: dict[int, tuple[int, bytes]] = {}  # shards are nodes 1 to so many: by the first word of their keys
        top = np.flatnonzero(parent == 0)
        by_conv = {}
        for k in range(len(rows)):
            by_conv.setdefault(keys[first[k]].tobytes(), rows[k])
        order = sorted(by_conv.items(), key=lambda x: tuple(np.frombuffer(x[0], "<u8").tolist()))  # as the level sorts them
        for node, (_, r) in zip(top.tolist(), order, strict=True):
            owner[node] = (shared.value[r[4][-16:] or ROOT], r[4])
        ids = t["conv_id"]
        up = ids[np.maximum(parent, 0)].copy()
        for node, (conv_id, _) in owner.items():
            up[node] = conv_id
        above = [owner[k][1] if k in owner else None for k in range(len(parent))]
        cols = [ids[1:], t["depth"][1:], up, t["n_convs"][1:], t["n_children"][1:], t["n_leaves"][1:], t["saved"][1:], ends, pa.array(above, pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[*[x.split()[0] for x in NODE.split(", ")], "above"])

    def run(batches):
        rows: list[tuple] = []
        turns, last = 0, None
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if turns >= SHARD_TURNS and r[0] != last:
                    yield from built(rows)
                    rows, turns = [], 0
                rows.append(r)
                last = r[0]
                turns += len(r[2]) // 16
        if rows:
            yield from built(rows)

    return stored(dealt.mapInArrow(tidy(run), NODE + ", above binary"), "nodes")


def _ends(parts: DataFrame) -> DataFrame:
    """key, ends_sha256 of heavy prefixes: ids sorted by ranges, joined in chunks, chunks streamed through the hash."""
    ids = parts.where("kind = 2").select("key", "conv_id")
    cut = ids.repartitionByRange(bucket_count(ids), "key", "conv_id").sortWithinPartitions("key", "conv_id")

    def joined(batches):
        for b in batches:
            key, conv = b.column(0).to_pylist(), b.column(1).to_pylist()
            edge = [0, *[i for i in range(1, len(key)) if key[i] != key[i - 1]], len(key)]
            for a, z in zip(edge[:-1], edge[1:], strict=True):
                for lo in range(a, z, ENDS):
                    part = conv[lo : min(lo + ENDS, z)]
                    yield pa.RecordBatch.from_arrays([pa.array([key[lo]], pa.binary()), pa.array([part[0]]), pa.array([",".join(map(str, part)).encode()], pa.binary())], names=["key", "first", "chunk"])

    chunks = cut.mapInArrow(joined, "key binary, first long, chunk binary")

    def hashed(batches):
        key, h = None, None
        for b in batches:
            for k, chunk in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k != key:
                    if h is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()])], names=["key", "ends_sha256"])
                    key, h = k, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(chunk)
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()])], names=["key", "ends_sha256"])

    return chunks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key binary, ends_sha256 string")


def _ancestors(above) -> F.Column:
    """The root and the keys of 16 bytes in a text of them."""
    n = (F.octet_length(above) / 16).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.substring(above, i * 16 + 1, F.lit(16)))
    return F.concat(F.array(F.lit(ROOT)), F.when(n > 0, each).otherwise(F.array().cast("array<binary>")))


def _upper(heavy: DataFrame, parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of the heavy prefixes and the root."""
    above = parts.where("kind = 1").groupBy("key").agg(F.first("above").alias("above"))
    h = stored(heavy.join(above, "key", "left"), "heavy")  # of the root: none above
    last = lambda c: F.when(F.octet_length(c) > 0, F.expr("substring(above, -16, 16)")).otherwise(F.lit(ROOT))
    roots = nodes.where("above is not null").select("above", "n_leaves", "saved_tokens")
    below = h.where("above is not null").select("above")
    children = roots.select(last(F.col("above")).alias("key")).unionByName(below.select(last(F.col("above")).alias("key"))).groupBy("key").agg(F.count("*").alias("n_children"))
    h = h.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = h.select(F.when(F.col("above").isNull(), F.array(F.lit(ROOT))).otherwise(F.concat(_ancestors(F.col("above")), F.array("key"))).alias("to"), (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"))
    sums = roots.select(_ancestors(F.col("above")).alias("to"), "n_leaves", "saved_tokens").unionByName(own).select(F.explode("to").alias("key"), "n_leaves", "saved_tokens").groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    parent = h.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    out = h.withColumn("up", F.when(F.col("above").isNotNull(), last(F.col("above")))).join(parent, "up", "left").join(sums, "key").join(_ends(parts), "key", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"))


def nodes(conversations: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    spark = conversations.sparkSession
    rows = paths(conversations)
    whole = rows.agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.sum(F.octet_length("sizes") / 8).cast("long").alias("turns")).first()
    if not whole.n:
        return spark.createDataFrame([], NODE)
    limit = max(heavy, whole.turns // HEAVY_SHARE)
    found = stored(_prefixes(rows).where((F.col("below") > limit) & (F.col("n_convs") > HEAVY_MEMBERS)), "upper")
    while found.count() > SENT:
        limit *= 2
        found = found.where(F.col("below") > limit)
    sent = {bytes(r.key): r.conv_id for r in found.select("key", "conv_id").collect()}  # SENT at most
    root = spark.createDataFrame([(bytearray(ROOT), whole.conv_id, whole.n, whole.turns, 0, 0)], found.schema)
    parts = _split(rows, set(sent))
    made = _shards(parts, sent | {ROOT: whole.conv_id})
    return made.drop("above").unionByName(_upper(found.unionByName(root), parts, made))


_CRC_SQL = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"


def oracle_sql() -> str:
    """Prefixes as lists of turns."""
    return f"""WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC_SQL} % 9 AS h FROM (SELECT DISTINCT conv_id FROM c)),
n AS (SELECT conv_id AS base, count(*) AS n FROM c GROUP BY 1),
b AS (SELECT i.conv_id, c.p AS d, r, t FROM i JOIN c ON c.conv_id = i.base AND c.p <= i.h UNION ALL SELECT i.conv_id, least(h, coalesce(n.n, 0)) + c.p - h, r, t FROM i JOIN c ON c.conv_id = i.conv_id AND c.p > h LEFT JOIN n ON n.base = i.base),
paths AS (SELECT i.conv_id, coalesce(list(sha256(length(r) || ':' || r || t) ORDER BY d) FILTER (d IS NOT NULL), []) AS path, coalesce(list(strlen(t) ORDER BY d) FILTER (d IS NOT NULL), []) AS sizes FROM i LEFT JOIN b ON b.conv_id = i.conv_id GROUP BY 1),
e AS (SELECT conv_id, k AS depth, list_slice(path, 1, k) AS prefix, CASE WHEN k = 0 THEN 0 ELSE sizes[k] END AS size, len(path) = k AS ends FROM (SELECT *, unnest(range(len(path) + 1)) AS k FROM paths)),
nodes AS (SELECT prefix, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM e GROUP BY prefix),
kids AS (SELECT list_slice(prefix, 1, depth - 1) AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
whole AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (prefix)),
sums AS (SELECT list_slice(prefix, 1, k) AS prefix, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * size) AS saved FROM (SELECT *, unnest(range(depth + 1)) AS k FROM whole) GROUP BY 1)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, w.n_convs, CAST(w.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, w.ends_sha256
FROM whole w JOIN sums USING (prefix) LEFT JOIN nodes u ON w.depth > 0 AND u.prefix = list_slice(w.prefix, 1, w.depth - 1)"""
