import pytest

from palimpsest.operators import relations
from palimpsest.plans import reports
from palimpsest.plans.engine import Engine
from palimpsest.sources import evidence as ev
from palimpsest.sources import fixtures as fx
from palimpsest.streaming import watch


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark, fx.image_frame(spark))
    e.run()
    return e


def test_engine_end_to_end(engine):
    rows = engine.tables["ranked"].collect()
    part = next(r for r in rows if r.recovery_status == "STRUCTURALLY_VALID_PARTIAL")
    assert (part.recovered_bytes, part.missing_bytes, part.span_bytes) == (len(fx.jpeg()) - 150, 128, len(fx.jpeg()) - 22)
    bad = next(r for r in rows if r.recovery_status == "PARTIALLY_RECONSTRUCTED")
    assert bad.structural_validity == 0 and bad.gap_count == 1 and not bad.is_successfully_recovered
    assert sorted(r["rank"] for r in rows) == list(range(1, 11))
    scores = [r.priority_score for r in sorted(rows, key=lambda r: r["rank"])]
    assert scores == sorted(scores, reverse=True)


def test_telemetry(spark):
    e = Engine(spark, fx.image_frame(spark))
    told = []
    e.listeners.append(lambda k, n, name: told.append((k, n, name)))
    e.stage(3)
    rows = {r.table: r for r in e.telemetry().collect()}
    assert told == [(1, 8, "carve"), (2, 8, "profile"), (3, 8, "fingerprint")]
    assert rows["fragments"].rows == e.tables["fragments"].count() > 0 and all(r.seconds > 0 for r in rows.values())


def test_headers_never_merge(engine):
    assert engine.tables["clusters"].where("members > 1").count() == 2
    assert engine.tables["clusters"].where("is_singleton").count() == 8


def test_edges_are_those_of_all_pairs(engine):
    nodes = engine.tables["nodes"]
    want = relations.edges(relations.all_pairs(nodes.withColumn("evidence", nodes["source"])))
    assert sorted(engine.tables["edges"].collect()) == sorted(want.collect()) and want.count() > 0


def test_reports(engine):
    ranked = engine.tables["ranked"]
    total = reports.overview(ranked).first()
    assert (total.candidates, total.fully, total.valid_partial, total.partial) == (10, 8, 1, 1)
    assert reports.summary_lines(ranked).count() == 10
    assert "10 candidate(s)" in reports.narrative(ranked)
    assert reports.narrative(ranked, model=lambda t: "told") == "told"
    assert "Observed" in reports.narrative(ranked, model=lambda t: 1 / 0)


def test_recovered_file_tables(engine):
    rows = reports.file_tables(engine.tables["ranked"]).collect()
    by = {t: [r for r in rows if r.tab == t] for t in {r.tab for r in rows}}
    assert {t: len(r) for t, r in by.items()} == {"All Candidates": 10, "Validated Recoveries": 9, "Partial Candidates": 1}
    assert all(r.parser == "VALID" and r.ratio.endswith("%") and len(r.sha256) == 19 for r in by["Validated Recoveries"])


def test_account_in_sections(engine, spark):
    ranked = engine.tables["ranked"]
    told = reports.narrative_sections(ranked, {"source_path": "x", "size_bytes": 9862, "sha256": "ab"}, 12, 10, 0, attention=2.0).collect()
    assert {r.section for r in told} == set(reports.SECTIONS)
    by = {s: [r.line for r in sorted(told, key=lambda r: r.place) if r.section == s] for s in reports.SECTIONS}
    assert by["summary"] == ["10 candidates: 9 recovered, 1 in part, 0 invalid."] and by["conclusion"][0].startswith("9 of 10 ")
    assert by["evidence"][0] == "x, 9,862 bytes." and len(by["findings"]) == len(by["integrity"]) == 10
    sensitive = ranked.where("sensitivity_level <> 'NONE'").count()
    assert len(by["attention"]) == max(1, sensitive)
    none = reports.narrative_sections(ranked.limit(0), {}, 0, 0, 0).collect()
    assert {r.section for r in none} == set(reports.SECTIONS)
    assert [r.line for r in none if r.section == "findings"] == ["No candidate was rebuilt."]


def test_listing_without_a_ranking(engine):
    assessed, orphans = engine.tables["assessed"], engine.tables["orphans"]
    n, m = assessed.count(), orphans.count()
    rows = sorted(reports.ranked_or_found(assessed, orphans).collect())
    assert [r.kind for r in rows] == ["file"] * n + ["orphan"] * m and [r.place for r in rows] == list(range(1, n + m + 1))
    assert all(r.priority_score is None for r in rows)
    ranked = engine.tables["ranked"]
    both = sorted(reports.ranked_or_found(assessed, orphans, ranked.where("rank <= 4")).collect())
    assert [r.kind for r in both] == ["candidate"] * 4 + ["file"] * (n - 4) + ["orphan"] * m
    assert [r.id for r in both[:4]] == [r.candidate_id for r in ranked.orderBy("rank").limit(4).collect()]


def test_hex_dump(spark):
    rows = spark.createDataFrame([(1, bytearray(b"Hello\x00world, again")), (2, bytearray()), (3, None), (4, bytearray(600))], "k int, data binary")
    got = {}
    for r in sorted(reports.hex_dump(rows, "k").collect()):
        got.setdefault(r.k, []).append(r.line)
    assert got[1] == [f"00000000  {'48 65 6C 6C 6F 00 77 6F 72 6C 64 2C 20 61 67 61':<48}  |Hello.world, aga|", f"00000010  {'69 6E':<48}  |in|"]
    assert got[2] == got[3] == ["Empty data stream (0 bytes)."]
    assert len(got[4]) == 33 and got[4][-1] == "... [88 additional bytes truncated for display]"


def test_empty_evidence(spark):
    e = Engine(spark, fx.image_frame(spark).where("source_path = 'no_header'"))
    assert e.run().count() == 0


def test_paths_and_files(spark, tmp_path):
    (tmp_path / "a.img").write_bytes(fx.images()["twin_jpeg"])
    (tmp_path / "empty.img").write_bytes(b"")
    for path, error in (("", ValueError), (str(tmp_path / "none"), FileNotFoundError), (str(tmp_path), ValueError), (str(tmp_path / "empty.img"), ValueError)):
        with pytest.raises(error):
            ev.validate_path(spark, path)
    rows = ev.read_evidence(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].evidence_id == "EV-" + rows[0].sha256[:12].upper() and rows[0].file_name == "a.img"
    assert ev.ground_truth(spark, str(tmp_path / "none")).count() == 0


def test_cache(spark, tmp_path):
    cache = ev.ResultCache(spark, str(tmp_path))
    assert cache.load("ab") is None
    cache.save("ab", spark.range(3))
    assert cache.load("ab").count() == 3 and cache.load("cd") is None
    cache.invalidate("ab")
    assert cache.load("ab") is None


def test_artifacts(engine, spark, tmp_path):
    ev.write_artifacts(engine.tables["assessed"], str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.folder for r in rows} == {"validated", "partial"}
    assert all(r.file_name.startswith("recovered_" if r.folder == "validated" else "recovery_candidate_") for r in rows)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"mail a@b.co and 4111-2222-3333-4444")
    q = watch.watch_evidence(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        r = spark.sql("SELECT * FROM seen").collect()
    finally:
        q.stop()
    assert [x.sensitivity_level for x in r] == ["HIGH"]


def test_external_order_of_large_texts(spark):
    from palimpsest.operators import reassemble

    rows = spark.createDataFrame([("c", "text", f"F{k}", k * 100, "text", bytearray(f"part {k}. ".encode())) for k in range(8)], "cluster_id string, inferred_type string, id string, offset long, type_hint string, data binary")
    back = reassemble.reassemble(rows, lambda ids, texts: ids[::-1]).first()
    assert list(back.fragment_ids) == [f"F{k}" for k in range(7, -1, -1)] and back.parser_message.startswith("External order taken")
    kept = reassemble.reassemble(rows, lambda ids, texts: ids[:-1]).first()
    assert list(kept.fragment_ids) == [f"F{k}" for k in range(8)] and "leaves out fragments: F7" in kept.parser_message


def test_archive_report_header_and_json(spark, tmp_path):
    import json

    from palimpsest.plans import reports
    from palimpsest.plans.engine import Engine
    from palimpsest.sources import fixtures as fx

    e = Engine(spark, fx.image_frame(spark).where("source_path in ('multi_format', 'no_header')"))
    ranked = e.run()
    r = reports.archive_report(ranked, e.tables["nodes"]).first()
    assert (r.carved_archive_fragments, r.archive_types, r.archive_reconstructions, r.complete, r.partial, r.invalid, r.nested, r.braided) == (1, "zip", 1, 1, 0, 0, 0, 0)
    assert e.tables["nested"].count() == 0
    lines = reports.summary_header(ranked, {"source_path": "x", "size_bytes": 9862, "sha256": "ab"}, e.tables["fragments"].count(), e.tables["clusters"].count(), 1.5)
    assert lines[0] == "Evidence: x, 9,862 bytes, SHA-256 ab" and "Fragments: 4" in lines and "Candidates: 4" in lines and "Structurally valid: 4" in lines
    reports.save_json(ranked.select("rank", "file_type"), str(tmp_path / "j"))
    got = [json.loads(x) for f in (tmp_path / "j").glob("part-*") for x in f.read_text().splitlines()]
    assert sorted(g["file_type"] for g in got) == ["jpeg", "pdf", "sqlite", "zip"]


def test_bytes_of_fragments_over_chunks(spark, monkeypatch):
    """Fragments over several chunks, beyond the end, and of an unknown image."""
    from palimpsest.sources import evidence as ev

    monkeypatch.setattr(ev, "CHUNK", 100)
    image = bytes(i % 251 for i in range(950))
    images = spark.createDataFrame([("a", bytearray(image))], "source_path string, content binary")
    asked = [("a", 0, 950), ("a", 99, 2), ("a", 150, 400), ("a", 900, 500), ("a", 300, 100), ("b", 0, 10)]
    rows = ev.fragment_bytes(spark.createDataFrame(asked, "source string, offset long, length long"), images).collect()
    got = {(r.source, r.offset, r.length): r.data and bytes(r.data) for r in rows}
    assert got == {(s, o, n): image[o : o + n] if s == "a" else None for s, o, n in asked}
