"""Reassembly of clusters: type inference, order of text, archive search, validation."""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby, permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .formats import ARCHIVES, COMPLETE, STARTS, archive_kind, check

# Bytes that start a file, in the order in which they are asked.
MAGIC = (
    ("jpeg", b"\xff\xd8\xff"), ("png", b"\x89PNG\r\n\x1a\n"), ("gif", b"GIF89a"), ("gif", b"GIF87a"), ("pdf", b"%PDF-"), ("zip", b"PK\x03\x04"), ("sqlite", b"SQLite format 3\0"),
    ("7z", b"7z\xbc\xaf\x27\x1c"), ("rar", b"Rar!\x1a\x07"), ("wim", b"MSWIM\0\0\0"), ("gz", b"\x1f\x8b"), ("bz2", b"BZh"), ("tiff", b"II*\0"), ("tiff", b"MM\0*"), ("bmp", b"BM"),
)
# File name extension by type.
EXTENSIONS = {
    "jpeg": ".jpg", "jpg": ".jpg", "png": ".png", "gif": ".gif", "bmp": ".bmp", "tiff": ".tiff", "tif": ".tiff", "pcx": ".pcx", "pdf": ".pdf", "docx": ".docx", "xlsx": ".xlsx", "pptx": ".pptx", "zip": ".zip", "tar": ".tar", "7z": ".7z",
    "rar": ".rar", "wim": ".wim", "gz": ".gz", "gzip": ".gz", "bz2": ".bz2", "bzip2": ".bz2", "sqlite": ".sqlite", "db": ".sqlite", "wav": ".wav", "text": ".txt", "txt": ".txt", "raw": ".bin", "bin": ".bin",
}
WIDTH, DEPTH, SMALL = 8, 12, 6
#: Candidates that leave a task together, at most.
OUT_ROWS, OUT_BYTES = 1024, 8 << 20


def magic(data: bytes) -> str:
    kind = next((k for k, m in MAGIC if data.startswith(m)), "")
    if not kind and data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        return "wav"
    return kind or ("tar" if data[257:262] == b"ustar" else "unknown")


def infer_type(cluster: str | None, hints: list[str], first: bytes) -> str:
    """The cluster's type, else the commonest known hint (first at a tie), else by magic bytes."""
    if cluster and cluster.lower() not in ("unknown", "raw"):
        return cluster
    known = [h for h in hints if h and h.lower() not in ("unknown", "raw")]
    return max(known, key=lambda h: (known.count(h), -known.index(h))) if known else magic(first)


def transition(a: str, b: str, at_a: int, at_b: int) -> float:
    """How well b follows a."""
    score = 1.0 if at_b >= at_a else 0.0
    tail, head = a.rstrip()[-1:], b.lstrip()[:1]
    if not tail or not head:
        return score
    if tail in ".!?" and head.isupper():
        return score + 2.0
    if tail in ",;:" and head.islower():
        return score + 2.0
    if tail.isalnum() and head.islower():
        return score + 2.5
    return score + 1.5 if a.endswith("\n") else score


def transition_column(a: Column, b: Column, at_a: Column, at_b: Column) -> Column:
    """The same as a Column."""
    tail, head = F.right(F.rtrim(F.regexp_replace(a, r"\s+$", "")), F.lit(1)), F.substring(F.regexp_replace(b, r"^\s+", ""), 1, 1)
    upper, lower = head.rlike(r"^\p{Lu}$"), head.rlike(r"^\p{Ll}$")
    more = F.when((tail == "") | (head == ""), 0.0).when(tail.isin(".", "!", "?") & upper, 2.0).when(tail.isin(",", ";", ":") & lower, 2.0).when(tail.rlike(r"^[\p{L}\p{N}]$") & lower, 2.5).when(a.endswith("\n"), 1.5).otherwise(0.0)
    return F.when(at_b >= at_a, 1.0).otherwise(0.0) + F.when(a.isNull() | b.isNull(), 0.0).otherwise(more)


def text_order(ids: list[str], offsets: list[int], texts: list[str]) -> tuple[list[int], float, int]:
    """Best order of up to six texts: places, its score, how many orders reach that score.

    Ties go to the order that is last by offsets, then by ids.  More texts go by offset.
    """
    n = len(ids)
    if n > SMALL:
        return sorted(range(n), key=lambda i: (offsets[i], ids[i])), 0.0, 1
    step = [[transition(texts[i], texts[j], offsets[i], offsets[j]) if i != j else 0.0 for j in range(n)] for i in range(n)]
    scored = [(sum(step[i][j] for i, j in zip(p, p[1:], strict=False)), [offsets[i] for i in p], [ids[i] for i in p], p) for p in permutations(range(n))]
    best = max(scored)
    return list(best[3]), best[0], sum(abs(s[0] - best[0]) < 1e-6 for s in scored)


def accepted_order(given: list[str] | None, members: list[str]) -> tuple[bool, str]:
    """Whether an order from outside names exactly the members, each once."""
    if not given:
        return False, "no order given"
    if len(set(given)) != len(given):
        return False, "order repeats a fragment"
    extra, missing = set(given) - set(members), set(members) - set(given)
    if extra:
        return False, f"order names unknown fragments: {', '.join(sorted(extra))}"
    return (False, f"order leaves out fragments: {', '.join(sorted(missing))}") if missing else (True, "")


def archive_search(kind: str, parts: list[tuple[str, int, bytes]], width: int = WIDTH, depth: int = DEPTH) -> tuple[list[int], bool, str, str]:
    """Places in order, validity, message and state: fragments by offset first, else a bounded beam search.

    The search starts at the first fragment with the format's header.  It returns the first prefix
    that is a complete archive, and only where there is none the first one that is valid in part;
    states are kept by completeness, then offsets.
    """
    by_offset = sorted(range(len(parts)), key=lambda i: (parts[i][1], parts[i][0]))
    verify = ARCHIVES[kind]
    told = verify(b"".join(parts[i][2] for i in by_offset))
    if told.valid and told.state == COMPLETE:
        return by_offset, True, told.message, told.state
    first = next((i for i in by_offset if STARTS[kind](parts[i][2], 0)), by_offset[0])
    states, partial = [([first], verify(parts[first][2]))], None
    for _ in range(min(depth, len(parts))):
        valid = [s for s in states if s[1].valid]
        found = next((s for s in valid if s[1].state == COMPLETE), None)
        if found:
            return found[0], True, found[1].message, found[1].state
        partial = partial or next(iter(valid), None)
        grown = [([*order, i], verify(b"".join(parts[j][2] for j in [*order, i]))) for order, _ in states for i in by_offset if i not in order]
        grown.sort(key=lambda g: (-g[1].completeness, [parts[i][1] for i in g[0]]))
        states = grown[:width]
    if partial:
        return partial[0], True, partial[1].message, partial[1].state
    return by_offset, told.valid, told.message, told.state


CANDIDATE = "cluster_id string, file_type string, fragment_ids array<string>, content binary, status string, structural_validity double, parser_message string, ambiguous boolean, archive_state string, used_all_fragments boolean"


def reassemble(members: DataFrame, propose: Callable[[list[str], list[str]], list[str] | None] | None = None) -> DataFrame:
    """A candidate for each cluster: ``members`` has cluster_id, inferred_type, id, offset, type_hint, data, and may have
    parts, the number of the cluster's members: one alone stays in the task that has read it.

    More than six texts go by offset, or by the order of ids that ``propose`` (ids, texts) gives if it names
    each fragment once; else the message says why it was not taken.

    One cluster's members are read together (they become one file); clusters are bounded
    by the density rule's reach, and the content by 2 GB, Spark's limit of a cell.  A task gets
    many clusters, sorted, in one stream: a group each would cost more than the work in it.
    """

    def one(cluster: str, rows: list[tuple]) -> tuple:
        parts = [(i, int(o), d or b"") for _, _, i, o, _, d in rows]
        kind = infer_type(rows[0][1], [r[4] for r in rows], parts[0][2])
        if not any(p[2] for p in parts):
            return cluster, kind, [p[0] for p in parts], b"", "cluster_only", 0.0, "No bytes to reassemble", False, "UNRECOVERABLE", True
        order, ambiguous, state, told = list(range(len(parts))), False, "", ""
        if kind in ARCHIVES:
            order, valid, message, state = archive_search(archive_kind(parts[0][2]) or kind, parts)
            validity = (1.0 if state == COMPLETE else 0.85) if valid else 0.0
        else:
            if kind == "text":
                texts = [p[2].decode("utf-8", "replace") for p in parts]
                order, score, ties = text_order([p[0] for p in parts], [p[1] for p in parts], texts)
                ambiguous = ties > 1 and len(parts) > 1
                if propose is not None and len(parts) > SMALL:
                    ids = [p[0] for p in parts]
                    given = propose(ids, texts)
                    taken, why = accepted_order(given, ids)
                    order = [ids.index(i) for i in given] if taken else order
                    told = "External order taken; " if taken else f"External order not taken ({why}); "
            verdict = check(kind, b"".join(parts[i][2] for i in order))
            valid, message, validity = verdict.valid, told + verdict.message, float(verdict.valid)
            if ambiguous:
                message = f"Ambiguous candidate: {ties} orders tie at continuity {score:.2f}; {message}"
        status = "ambiguous" if ambiguous else "reconstructed" if valid else "validation_failed"
        return cluster, kind, [parts[i][0] for i in order], b"".join(parts[i][2] for i in order), status, validity, message, ambiguous, state, len(order) == len(parts)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches):
        out, size = [], 0
        each = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for cluster, rows in groupby(each, lambda r: r[0]):
            out.append(one(cluster, list(rows)))
            size += len(out[-1][3])
            if len(out) >= OUT_ROWS or size >= OUT_BYTES:
                yield batch(out)
                out, size = [], 0
        if out:
            yield batch(out)

    names = [x.strip().split(" ")[0] for x in CANDIDATE.split(",")]
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.binary(), pa.string(), pa.float64(), pa.string(), pa.bool_(), pa.string(), pa.bool_()]
    columns = ["cluster_id", "inferred_type", "id", "offset", "type_hint", "data"]
    counted = "parts" in members.columns
    dealt = (members.where("parts > 1") if counted else members).select(*columns).repartition("cluster_id").sortWithinPartitions("cluster_id", "offset", "id")
    if counted:
        dealt = dealt.unionByName(members.where("parts = 1").select(*columns))
    return dealt.mapInArrow(run, CANDIDATE)
