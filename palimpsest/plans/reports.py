"""Summaries, previews, narrative and evaluation over result tables."""

from __future__ import annotations

import io
import sqlite3
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.profile import round4
from ..operators.formats import nested_archives
from ..operators.intervals import global_rank


def hex_preview(df: DataFrame, key: str, data: str = "data", width: int = 16) -> DataFrame:
    """key, line_offset, hex_bytes, ascii: a row for each ``width`` bytes."""
    n = F.octet_length(data)
    lines = df.where(n > 0).select(key, F.col(data).alias("data"), F.explode(F.sequence(F.lit(0), n - 1, F.lit(width))).alias("line_offset"))
    part = F.expr(f"substring(data, line_offset + 1, {width})")
    spaced = F.regexp_replace(F.hex(part), "(..)(?=.)", "$1 ")
    return lines.select(key, F.col("line_offset").cast("bigint").alias("line_offset"), spaced.alias("hex_bytes"), F.regexp_replace(F.decode(part, "ISO-8859-1"), r"[^\x20-\x7E]", ".").alias("ascii"))


def _places(c: Column, n: int) -> Column:
    """``c`` as text with ``n`` decimals; ties go up, null is 0."""
    return F.format_string(f"%.{n}f", F.floor(F.coalesce(c.cast("double"), F.lit(0.0)) * 10**n + 0.5 + 1e-7) / 10**n)


# The lines for bytes left out and for no bytes.
def hex_dump(df: DataFrame, key: str, data: str = "data", most: int = 512, width: int = 16) -> DataFrame:
    """key, line_no, line: a dump of the first ``most`` bytes as text; a last line counts the bytes left out, one line stands for no bytes (or null).

    Keys are taken to be distinct; rows of one key have their lines side by side."""
    whole = df.select(key, F.coalesce(F.col(data), F.lit(b"")).alias("whole"))
    rows = hex_preview(whole.select(key, F.substring("whole", 1, most).alias("data")), key, width=width)
    line = F.format_string(f"%08X  %-{3 * width}s  |%s|", "line_offset", "hex_bytes", "ascii")
    n = F.octet_length("whole")
    more = whole.where(n > most).select(key, F.lit(-(-most // width) + 1).cast("bigint").alias("line_no"), F.concat(F.lit("... ["), F.format_number(n - most, 0), F.lit(" additional bytes truncated for display]")).alias("line"))
    none = whole.where(n == 0).select(key, F.lit(1).cast("bigint").alias("line_no"), F.lit("Empty data stream (0 bytes).").alias("line"))
    return rows.select(key, F.floor(F.col("line_offset") / width + 1).alias("line_no"), line.alias("line")).unionByName(more).unionByName(none)


#: Which states make which table of recovered files.
_TABLES = {"Partial Candidates": ("PARTIALLY_RECONSTRUCTED", "PARTIAL_RECONSTRUCTION"), "Raw Binary Salvage": ("RAW_BINARY_RECOVERY",), "Invalid Reconstructions": ("STRUCTURALLY_INVALID", "INVALID_RECONSTRUCTION", "UNRECOVERABLE")}


def file_tables(ranked: DataFrame) -> DataFrame:
    """Recovered files as an analyst reads them: a row for each table that a candidate belongs to, numbers as text.

    Every candidate is in ``All Candidates`` and in at most one other table; ambiguous ones are
    in no other, and a candidate that was recovered is in ``Validated Recoveries`` whatever its state.
    """
    state, percent = F.col("recovery_status"), lambda c: F.concat(_places(F.col(c) * 100, 1), F.lit("%"))
    own = F.when(F.col("is_successfully_recovered"), "Validated Recoveries")
    for name, states in _TABLES.items():
        own = own.when(state.isin(*states), name)
    size = lambda c: F.concat(F.format_number(F.coalesce(c, F.lit(0)), 0), F.lit(" B"))
    return ranked.select(
        F.explode(F.array_compact(F.array(F.lit("All Candidates"), own))).alias("tab"),
        "candidate_id",
        F.upper("file_type").alias("file_type"),
        state.alias("recovery_state"),
        size(F.col("recovered_bytes")).alias("recovered"),
        size(F.col("missing_bytes")).alias("missing"),
        percent("observed_recovery_ratio").alias("ratio"),
        F.when(F.col("structural_validity") >= 1, "VALID").otherwise("FAILED").alias("parser"),
        percent("composite_integrity_score").alias("integrity"),
        _places(F.col("priority_score"), 4).alias("priority"),
        F.coalesce(F.concat(F.substring("artifact_sha256", 1, 16), F.lit("...")), F.lit("—")).alias("sha256"),
    )


def ranked_or_found(assessed: DataFrame, orphans: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """place, kind ('candidate', 'file' or 'orphan'), id, file_type, bytes, state, priority_score: one listing of a run, ranked or not.

    With a ranking its candidates come first, by rank; candidates that it lacks (all of them
    without one) follow as files by id with no priority, orphan fragments last by place.
    """
    shape = lambda df, kind, order, id_, type_, size, state, score: df.select(F.lit(kind).alias("kind"), order.cast("bigint").alias("_o"), F.col(id_).cast("string").alias("id"), F.col(type_).alias("file_type"), F.col(size).cast("bigint").alias("bytes"), state.alias("state"), score.cast("double").alias("priority_score"))
    none = F.lit(None)
    left = assessed if ranked is None else assessed.join(ranked.select("candidate_id").distinct(), "candidate_id", "left_anti")
    files = shape(left, "file", F.lit(0), "candidate_id", "file_type", "recovered_bytes", F.col("recovery_status"), none)
    alone = shape(orphans, "orphan", F.col("seq"), "id", "type_hint", "length", F.lit("ORPHAN"), none)
    rows = files.unionByName(alone)
    if ranked is not None:
        rows = rows.unionByName(shape(ranked, "candidate", F.col("rank"), "candidate_id", "file_type", "recovered_bytes", F.col("recovery_status"), F.col("priority_score")))
    return global_rank(rows, [F.asc("kind"), F.asc("_o"), F.asc("id")], "place").select("place", *[c for c in rows.columns if c != "_o"])


#: Sections of the account, in their order.
SECTIONS = ("summary", "evidence", "findings", "integrity", "attention", "limits", "conclusion")
_LIMITS = (("observed", "A valid structure says that a file can be read, not that it is the file that was once stored."), ("unknown", "Bytes that no fragment holds are missing for good; nothing was filled in."), ("unknown", "Names, folders and times of files were not among the evidence."))


def narrative_sections(ranked: DataFrame, evidence: dict, fragments: int, clusters: int, orphans: int, attention: float = 0.5) -> DataFrame:
    """section, place, basis, line: a whole account of a run in seven sections, by rules alone.

    ``basis`` says whether a line was observed, inferred or is unknown.  Every candidate has
    its lines in ``findings`` and ``integrity``, and in ``attention`` if it is sensitive or its
    priority is above that share; ``place`` is its rank there.  Nothing passes through the
    driver: the account is as long as the ranking.  Sections without a candidate have one line
    that says so.
    """
    spark = ranked.sparkSession
    lines = lambda section, rows: spark.createDataFrame([(section, n, b, x) for n, (b, x) in enumerate(rows, 1)], "section string, place long, basis string, line string")
    t = ranked.agg(F.count("*").alias("n"), F.count_if("is_successfully_recovered").alias("good"), F.count_if(F.col("recovery_status").isin(*_TABLES["Partial Candidates"])).alias("part"), F.count_if(F.col("recovery_status").isin(*_TABLES["Invalid Reconstructions"])).alias("bad"))
    told = F.col("recovery_status").isNotNull()
    each = lambda section, basis, text, where=told: ranked.where(where).select(F.lit(section).alias("section"), F.col("rank").cast("bigint").alias("place"), F.lit(basis).alias("basis"), text.alias("line"))
    total = lambda section, text: t.select(F.lit(section).alias("section"), F.lit(1).cast("bigint").alias("place"), F.lit("observed").alias("basis"), text.alias("line"))
    empty = lambda section, where, text: ranked.agg(F.count_if(where).alias("n")).where("n = 0").select(F.lit(section).alias("section"), F.lit(1).cast("bigint").alias("place"), F.lit("observed").alias("basis"), F.lit(text).alias("line"))
    kind, urgent = F.upper(F.coalesce("file_type", F.lit("unknown"))), (F.col("sensitivity_level") != "NONE") | (F.col("priority_score") > attention)
    two = lambda c: _places(F.col(c), 2)
    name = F.concat(F.col("candidate_id"), F.lit(" ("), kind, F.lit(")"))
    parts = [
        total("summary", F.format_string("%d candidates: %d recovered, %d in part, %d invalid.", "n", "good", "part", "bad")),
        lines("evidence", [("observed", f"{evidence.get('source_path') or 'unnamed evidence'}, {evidence.get('size_bytes', 0):,} bytes."), ("observed", f"SHA-256 {evidence.get('sha256') or 'unknown'}."), ("observed", f"{fragments:,} fragments were carved."), ("inferred", f"{clusters:,} clusters were formed of them; {orphans:,} fragments belong to none.")]),
        each("findings", "inferred", F.concat(name, F.lit(": "), F.col("recovery_status"), F.lit(", "), F.format_number(F.coalesce("recovered_bytes", F.lit(0)), 0), F.lit(" bytes found, "), F.format_number(F.coalesce("missing_bytes", F.lit(0)), 0), F.lit(" missing."))),
        empty("findings", told, "No candidate was rebuilt."),
        each("integrity", "inferred", F.concat(name, F.lit(": confidence "), two("reconstruction_confidence"), F.lit(", validity "), two("structural_validity"), F.lit(", completeness "), two("completeness"), F.lit(", corruption "), two("corruption_estimate"), F.lit("."))),
        empty("integrity", told, "No candidate was scored."),
        each("attention", "observed", F.concat(name, F.lit(": "), F.col("sensitivity_level"), F.lit(" sensitivity ["), F.array_join("categories", ", "), F.lit("], priority "), _places(F.col("priority_score"), 4), F.lit(".")), urgent),
        empty("attention", urgent, "No candidate is sensitive or of raised priority."),
        lines("limits", _LIMITS),
        total("conclusion", F.format_string("%d of %d candidates passed their format's check and can be examined.", "good", "n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def overview(ranked: DataFrame) -> DataFrame:
    """One row of totals over ranked candidates."""
    state = lambda s: F.count_if(F.col("recovery_status") == s)
    return ranked.agg(
        F.count("*").alias("candidates"),
        state("FULLY_RECONSTRUCTED").alias("fully"),
        state("STRUCTURALLY_VALID_PARTIAL").alias("valid_partial"),
        state("PARTIALLY_RECONSTRUCTED").alias("partial"),
        state("STRUCTURALLY_INVALID").alias("invalid"),
        F.count_if(F.col("sensitivity_level") != "NONE").alias("sensitive"),
        F.count_if(F.col("priority_score") >= 0.70).alias("high_priority"),
        round4(F.avg("observed_recovery_ratio")).alias("mean_ratio"),
        F.sum("recovered_bytes").cast("bigint").alias("recovered_bytes"),
    )


def summary_lines(ranked: DataFrame) -> DataFrame:
    """rank, line: the text summary, a line for each ranked candidate."""
    line = F.format_string("#%d %s [%s] priority %.4f, integrity %.4f, %s, %d bytes", "rank", "candidate_id", "file_type", "priority_score", "composite_integrity_score", "recovery_status", "recovered_bytes")
    return ranked.select("rank", line.alias("line"))


def summary_header(ranked: DataFrame, evidence: dict, fragments: int, clusters: int, seconds: float) -> list[str]:
    """Lines before the candidates': evidence (source_path, size_bytes, sha256), counts of what was found, one aggregate over the candidates."""
    t = overview(ranked).first()
    valid = ranked.where("structural_validity >= 1").count()
    return [
        f"Evidence: {evidence['source_path']}, {evidence['size_bytes']:,} bytes, SHA-256 {evidence['sha256']}", f"Duration: {seconds:.2f} s", f"Fragments: {fragments}", f"Clusters: {clusters}",
        f"Candidates: {t.candidates}", f"Structurally valid: {valid}", f"Sensitive: {t.sensitive}", f"High priority: {t.high_priority}", *([] if t.candidates else ["No candidates from this evidence."]),
    ]


def archive_report(ranked: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row of archive results: what was carved, rebuilt, complete, partial, invalid, nested or out of order (braided)."""
    kinds = ("zip", "tar", "7z", "rar", "wim", "gz", "bz2")
    carved = nodes.where(F.col("type_hint").isin(*kinds)).agg(F.count("*").alias("carved_archive_fragments"), F.array_join(F.array_sort(F.collect_set("type_hint")), ",").alias("archive_types"))
    ids = F.col("fragment_ids")
    good = F.col("is_successfully_recovered")
    whole = ranked.where(F.col("file_type").isin(*kinds)).agg(
        F.count("*").alias("archive_reconstructions"), F.count_if(good & (F.col("stage5_structural_validity") >= 1)).alias("complete"), F.count_if(good & (F.col("stage5_structural_validity") < 1)).alias("partial"), F.count_if(~good).alias("invalid"),
        F.count_if(F.size(nested_archives(F.col("content"))) > 0).alias("nested"), F.count_if((F.size(ids) > 1) & (ids != F.array_sort(ids))).alias("braided"),
    )
    return carved.crossJoin(whole)  # a row each


_LISTED = T.ArrayType(T.StructType([T.StructField("entry", T.StringType()), T.StructField("position", T.IntegerType()), T.StructField("size", T.LongType()), T.StructField("detail", T.StringType())]))


@F.pandas_udf(_LISTED)
def _listed(kind: pd.Series, data: pd.Series) -> pd.Series:
    def one(k: str, x: bytes) -> list[dict]:
        try:
            if k == "zip":
                with zipfile.ZipFile(io.BytesIO(x)) as z:
                    return [{"entry": i.filename, "position": n, "size": i.file_size, "detail": "member"} for n, i in enumerate(z.infolist(), 1)]
            if k == "sqlite":
                db = sqlite3.connect(":memory:")
                db.deserialize(x)
                tables = db.execute("SELECT name, sql FROM sqlite_master WHERE type = 'table' ORDER BY rowid").fetchall()
                return [{"entry": t, "position": n, "size": db.execute('SELECT count(*) FROM "' + t.replace('"', '""') + '"').fetchone()[0], "detail": sql} for n, (t, sql) in enumerate(tables, 1)]
        except (zipfile.BadZipFile, sqlite3.Error):
            pass  # nothing to list in a damaged file
        return []

    return pd.Series([one(k, x or b"") for k, x in zip(kind, data, strict=True)])


def listings(df: DataFrame, id_: str, kind: str = "file_type", data: str = "content") -> DataFrame:
    """A row for each member of a ZIP archive (size in bytes) and each table of a SQLite file (size in rows); none for damaged files."""
    return df.select(id_, F.explode(_listed(F.lower(F.col(kind)), F.col(data))).alias("e")).select(id_, "e.*")


def save_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines; text outside ASCII stays as it is."""
    df.write.mode("overwrite").json(path)


def narrative(ranked: DataFrame, top: int = 5, model: Callable[[dict], str] | None = None) -> str:
    """A factual account of a run from its totals and its first candidates.

    ``model`` may phrase the same telemetry (totals and rows, no content) instead; what
    it returns is used only if it is a text.
    """
    total = overview(ranked).first().asDict()
    first = [r.asDict() for r in ranked.orderBy("rank").limit(top).select("rank", "candidate_id", "file_type", "recovery_status", "sensitivity_level", "priority_score", "priority_reason").collect()]
    if model is not None:
        try:
            told = model({"totals": total, "candidates": first})
        except Exception:
            told = None
        if isinstance(told, str) and told.strip():
            return told
    lines = [
        f"Observed: {total['candidates']} candidate(s), {total['recovered_bytes'] or 0} bytes recovered; {total['fully']} fully reconstructed, {total['valid_partial']} valid but partial, {total['partial']} partial, {total['invalid']} structurally invalid.",
        f"Sensitivity: {total['sensitive']} candidate(s) with sensitive patterns; {total['high_priority']} of high priority.",
        *[f"{r['rank']}. {r['candidate_id']} ({r['file_type']}): {r['recovery_status']}, {r['sensitivity_level']} sensitivity. {r['priority_reason']}" for r in first],
        "Unknown: original sizes, authorship and the content of missing ranges.",
    ]
    return "\n".join(lines)


def precision_recall(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """true_positive, false_positive, false_negative, precision, recall, f1 of two sets of rows; 0 for an empty denominator."""
    a = found.select(*keys).distinct().withColumn("f", F.lit(1))
    b = truth.select(*keys).distinct().withColumn("t", F.lit(1))
    both = a.join(b, keys, "full").agg(F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("true_positive"), F.count_if(F.col("t").isNull()).alias("false_positive"), F.count_if(F.col("f").isNull()).alias("false_negative"))
    tp, fp, fn = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")
    share = lambda x, y: F.coalesce(round4(F.try_divide(x, y)), F.lit(0.0))
    return both.select("*", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))
