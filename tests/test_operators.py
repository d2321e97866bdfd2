import bz2
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import carve, formats, intervals, reassemble, relations, similarity, vectors
from palimpsest.operators.components import star_components
from palimpsest.sources import evidence as ev
from palimpsest.sources import fixtures as fx


def test_interval_union_exact(spark):
    rows = [("u", 100, 200, "F1"), ("u", 200, 200, "F2"), ("u", 500, 100, "F3"), ("t", 100, 50, "F1"), ("t", 200, 50, "F2"), ("t", 250, 50, "F3"), ("z", 5, 0, "F1")]
    df = spark.createDataFrame(rows, "group string, begin long, length long, id string")
    got = {r.group: r for r in intervals.coverage(df).collect()}
    u = got["u"]
    assert (u.raw_bytes, u.unique_bytes, u.overlap_bytes, u.gap_count, u.gap_bytes, u.span_bytes) == (500, 400, 100, 1, 100, 500)
    assert [(r.begin, r.stop) for r in u.ranges] == [(100, 400), (500, 600)]
    assert (got["z"].unique_bytes, got["z"].gap_count) == (0, 0)
    gap = {r.group: r for r in intervals.gaps(intervals.islands(df)).collect()}
    assert (gap["t"].gap_start, gap["t"].gap_length, gap["t"].prev_id, gap["t"].next_id) == (150, 50, "F1", "F2")


def test_islands_across_stretches(spark):
    big = intervals.STRETCH
    df = spark.createDataFrame([("g", big - 10, 20, "a"), ("g", big + 10, 5, "b"), ("g", 3 * big, 1, "c")], "group string, begin long, length long, id string")
    assert [(r.begin, r.stop, r.last_id) for r in intervals.islands(df).orderBy("begin").collect()] == [(big - 10, big + 15, "b"), (3 * big, 3 * big + 1, "c")]


def test_running_offset_and_rank(spark):
    df = spark.range(100).select(F.col("id"), F.when(F.col("id") < 60, "hot").otherwise("b").alias("g"), F.lit(3).alias("n"))
    got = {r.id: r.offset for r in intervals.running_offset(df, "g", "id", "n").collect()}
    assert got == {i: 3 * (i if i < 60 else i - 60) for i in range(100)}
    ranked = intervals.global_rank(df, [F.desc("id")]).collect()
    assert {r.id: r["rank"] for r in ranked} == {i: 100 - i for i in range(100)}


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (103, 102), (7, 7)]
    got = {r.u: r.root for r in star_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {101: 100, 103: 102}
    assert star_components(spark.createDataFrame([], "u long, v long")).count() == 0


def fragment(i, offset, vector, kind="pdf", source="img", header=False, group=None, length=512):
    return (i, i, source, offset, length, kind, "binary", header, group, vector)


SCHEMA = "id long, seq long, source string, offset long, length long, type_hint string, characterization string, header_flag boolean, group_id string, vector array<double>"


def unit(k):
    return [1.0 if i == k else 0.0 for i in range(64)]


@pytest.mark.parametrize(
    ("rows", "clusters", "orphans"),
    [
        ([fragment(i, i * 512, unit(1 if i < 3 else 2)) for i in range(5)], {0: 5}, 0),
        ([fragment(0, 0, unit(1)), fragment(1, 512, unit(1)), fragment(2, 10_000_000, unit(63))], {0: 2}, 1),
        ([fragment(0, 0, unit(1), header=True), fragment(1, 600, unit(1), header=True)], {}, 2),
        ([fragment(0, 0, unit(1)), fragment(1, 512, unit(1), source="other")], {}, 2),
        ([fragment(0, 0, unit(1), group="g", kind="jpeg", header=True), fragment(1, 900, unit(9), group="g", kind="jpeg")], {0: 2}, 0),
        ([fragment(0, 0, unit(1), kind="jpeg"), fragment(1, 512, unit(1), kind="pdf")], {}, 2),
    ],
)
def test_clusters(spark, rows, clusters, orphans):
    f = spark.createDataFrame(rows, SCHEMA)
    members, alone = relations.clusters(f)
    if len(rows) == 5:  # same type and close: even orthogonal vectors stay 0.6 apart, so two groups
        assert sorted(r.n for r in members.groupBy("label").agg(F.count("*").alias("n")).collect()) == [2, 3]
    else:
        assert {r.label: r.n for r in members.groupBy("label").agg(F.count("*").alias("n")).collect()} == clusters
    assert alone.count() == orphans


def test_roll_up(spark):
    f = spark.createDataFrame([fragment(0, 0, unit(1)), fragment(1, 512, unit(1))], SCHEMA)
    r = relations.roll_up(relations.clusters(f)[0], f).first()
    assert (r.member_ids, r.inferred_type, r.confidence) == ([0, 1], "pdf", 1.0)


@pytest.mark.parametrize("block", [7, 1024])
def test_edges_at_any_distance(spark, block, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", block)
    monkeypatch.setattr(similarity, "PIVOT_POINTS", 10 * block)
    rng = random.Random(3)
    far = [fragment(0, 0, unit(1)), fragment(1, 90_000_000, unit(1)), fragment(2, 0, unit(1), source="other", kind="jpeg")]
    rows = far + [fragment(i, rng.randrange(20) * 40_000, [rng.choice([0.0, 0.0, 1.0, 2.0]) for _ in range(6)] + [0.0] * 58, source=rng.choice(["one", "two"]), kind=rng.choice(["zip", "pdf", "unknown"])) for i in range(3, 40)]
    f = spark.createDataFrame(rows, SCHEMA)
    want = relations.edges(relations.all_pairs(f.withColumn("evidence", F.lit(1)))).collect()
    got = relations.edges(relations.close_pairs(f)).collect()
    assert sorted(got) == sorted(want) and {(0, 1), (0, 2)} <= {(r.source_id, r.target_id) for r in got}
    apart = relations.edges(relations.close_pairs(f, "source")).collect()
    assert sorted(apart) == sorted(relations.edges(relations.all_pairs(f.withColumn("evidence", F.col("source")))).collect())
    assert relations.close_pairs(f.where("id < 0")).count() == 0


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([], [])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_fnv_and_vectors(spark):
    assert vectors.fnv1a([b"foobar", b""]).tolist() == [3214735720, 2166136261]
    assert vectors.hashed_counts("  ").sum() == 0
    assert abs(sum(x * x for x in vectors.normalized(vectors.hashed_counts("some text here"))) - 1) < 1e-4


def test_pair_vectors_equal_a_full_svd(spark):
    import numpy as np

    rows = [(i, bytearray(fx.noise(80, i + 1))) for i in range(12)]
    got = {r.id: np.array(r.vector) for r in vectors.pair_vectors(spark.createDataFrame(rows, "id long, data binary")).collect()}
    a = np.zeros((12, 65536))
    for i, d in rows:
        pair, m = vectors.pair_counts(bytes(d))
        a[i, pair] = m / m.sum()
    a *= np.log(13 / ((a > 0).sum(axis=0) + 1)) + 1
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    want = u * s
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    have = np.array([got[i][:12] for i in range(12)])
    assert np.allclose(have @ have.T, want @ want.T, atol=1e-4)


def test_carving_exact_offsets(spark):
    found = carve.carve(ev.chunked(fx.image_frame(spark))).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r.source, r.seq)):
        by.setdefault(r.source, []).append((r.id, r.offset, r.length, r.type_hint, r.header_flag, r.footer_flag))
    n = len(fx.jpeg())
    assert by["adjacent_jpegs"] == [("F0001", 64, n, "jpeg", True, True), ("F0002", 96 + n, n, "jpeg", True, True)]
    assert by["twin_jpeg"] == [("F0001", 0, n, "jpeg", True, True), ("F0002", n + 64, n, "jpeg", True, True)]
    assert [x[3] for x in by["multi_format"]] == ["jpeg", "pdf", "zip", "sqlite"]
    assert by["disrupted_jpeg"] == [("F0001", 128, 250, "jpeg", True, False), ("F0002", 506, n - 400, "jpeg", False, True)]
    assert not {"no_header", "bad_bmp", "bad_tiff", "bad_pcx"} & set(by)


def test_carving_is_the_same_in_small_chunks(spark):
    images = fx.image_frame(spark)
    cut = lambda n: sorted((r.source, r.offset, r.length, r.type_hint) for r in carve.carve(ev.chunked(images, chunk=n, overlap=1 << 16)).collect())
    assert cut(97) == cut(1 << 20)


def test_images_of_texts_hold_no_chance_signature(spark):
    texts = ["text 6446603", "text 17650020", "plain"]  # the letters' checksums hold BZh and the start of a JPEG
    rows = spark.createDataFrame([(3 * i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = carve.carve(ev.chunked(fx.text_images(rows))).select("source", "type_hint").collect()
    assert sorted((r.source[-1], r.type_hint) for r in found) == [(k, t) for k in "036" for t in ("jpeg", "zip")]


BAD = {"jpeg_cut", "png_crc", "bmp_cut", "pdf_empty", "zip_no_end", "docx_bare", "tar_sum", "sqlite_cut", "text_bad"}


@pytest.mark.parametrize("name", list(fx.samples()))
def test_validators(name):
    kind, data = fx.samples()[name]
    verdict = formats.check(kind, data)
    assert verdict.valid == (name not in BAD), verdict.message
    assert not formats.check(kind, b"").valid


def test_archive_states():
    s = fx.samples()
    assert formats.zip_archive(s["zip_no_end"][1]).state == formats.PARTIAL
    assert formats.zip_archive(fx.zipped({"a": b"x" * 50})[:-30]).state == formats.ONE_MEMBER
    assert formats.seven_zip(s["7z_cut"][1]).completeness == 0.75
    assert formats.rar(s["rar_open"][1]).state == formats.PARTIAL and formats.rar(s["rar"][1]).members == ["note.txt"]
    assert formats.check("odd", b"x").message == "No validator for type 'odd'"


def test_two_bytes_make_no_nested_stream(spark):
    inside = fx.noise(512) + b"\x1f\x8b" + fx.noise(700)  # as compressed bytes hold by chance
    real = fx.noise(512) + fx.gzipped() + fx.noise(700)
    rows = spark.createDataFrame([("chance", bytearray(inside)), ("stream", bytearray(real))], "candidate_id string, content binary")
    assert [(r.parent_id, r.offset, r.format) for r in formats.nested(rows).collect()] == [("stream", 512, "gz")]


def test_archive_search_uses_all_pieces():
    whole = fx.bzipped(fx.noise(900, 8))
    k = len(whole) // 3
    order, valid, _, state = reassemble.archive_search("bz2", [("c", 1000, whole[:k]), ("a", 2000, whole[k : 2 * k]), ("b", 0, whole[2 * k :])])
    assert (order, valid, state) == ([0, 1, 2], True, formats.COMPLETE)


def test_archive_search_goes_on_beyond_a_partial_prefix():
    whole = bz2.compress(random.Random(8).randbytes(600_000), 1)  # seven blocks: the first third alone is a partial stream
    k = len(whole) // 3
    parts = [("c", 1000, whole[:k]), ("a", 2000, whole[k : 2 * k]), ("b", 0, whole[2 * k :])]
    assert formats.bzip2(whole[:k]).state == formats.PARTIAL
    order, valid, _, state = reassemble.archive_search("bz2", parts)
    assert (order, valid, state) == ([0, 1, 2], True, formats.COMPLETE)
    order, valid, _, state = reassemble.archive_search("bz2", [parts[0], parts[2]])  # the middle is lost
    assert (order, valid, state) == ([0], True, formats.PARTIAL)


def test_text_order():
    order, score, ties = reassemble.text_order(["a", "b"], [0, 100], ["First sentence.", "Second one."])
    assert (order, score, ties) == ([0, 1], 3.0, 1)
    assert reassemble.text_order(["a", "b"], [0, 0], ["x1", "y1"])[2] == 2
    assert reassemble.text_order([str(i) for i in range(7)], [7 - i for i in range(7)], ["t"] * 7)[0] == [6, 5, 4, 3, 2, 1, 0]
    assert reassemble.accepted_order(["a", "b"], ["b", "a"]) == (True, "")
    assert reassemble.accepted_order(["a", "x"], ["b", "a"])[1] == "order names unknown fragments: x"


def test_type_inference():
    assert reassemble.infer_type("unknown", ["pdf", "unknown", "jpeg", "pdf"], b"") == "pdf"
    assert reassemble.infer_type(None, ["jpeg", "pdf"], b"") == "jpeg"
    assert reassemble.infer_type("raw", [], fx.wav()) == "wav" and reassemble.magic(b"\0" * 600) == "unknown"
