import hashlib

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import profile, scoring, sensitivity

ENGLISH = (b"The quick brown fox jumps over the lazy dog while rivers run to the sea. " * 8)[:512]
CHAIN = b"".join(hashlib.sha256(bytes([i])).digest() for i in range(16))


@pytest.mark.parametrize(("data", "entropy", "ratio"), [(b"", 0.0, 0.0), (None, 0.0, 0.0), (b"A" * 50, 0.0, 1.0), (b"\x00\xff" * 128, 1.0, 0.0), (bytes(range(256)), 8.0, 0.3828), (b"Hello World", 2.8454, 1.0), (b"\t\n\r ", 2.0, 1.0)])
def test_entropy_and_ratio(data, entropy, ratio):
    assert profile.entropy_of(data) == entropy
    assert profile.printable_of(data) == ratio


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 160, 161, 1000])
def test_windows_equal_the_entropy_of_their_bytes(n):
    data = (ENGLISH + CHAIN)[:n]
    start, h = profile.window_entropies(data, 128, 32)
    assert len(start) == (0 if n == 0 else 1 + -(-max(0, n - 128) // 32))
    assert h.tolist() == [profile.entropy_of(data[s : s + 128]) for s in start]


def test_characterization(spark):
    rows = [("empty", b""), ("text", ENGLISH), ("binary", CHAIN), ("mixed", b"a" * 512 + CHAIN)]
    df = spark.createDataFrame([(k, bytearray(d)) for k, d in rows], "id string, data binary")
    got = {r.id: r.characterization for r in profile.characterize(df).collect()}
    assert got == {"empty": "binary", "text": "text", "binary": "binary", "mixed": "mixed"}


CASES = {
    "Aadhaar 4567 8901 2345": ({("aadhaar", "XXXX-XXXX-2345")}, "MEDIUM"),
    "PAN ABCDE1234F": ({("pan", "A****234F")}, "MEDIUM"),
    "mail security-audit@enterprise-corp.org": ({("email", "s***@enterprise-corp.org")}, "LOW"),
    "call +91-9876543210": ({("phone", "+91-XXXXX-3210")}, "LOW"),
    "card 4111-2222-3333-4444": ({("credit_card", "****-****-****-4444")}, "HIGH"),
    "a plain sentence": (set(), "NONE"),
    "": (set(), "NONE"),
}


def test_sensitivity_cases(spark):
    df = spark.createDataFrame([(t,) for t in CASES] + [(None,)], "text string")
    got = {r.text: r for r in sensitivity.analyze(df).collect()}
    for text, (want, level) in CASES.items():
        found = {(m.category, m.match_snippet) for m in got[text].matches}
        assert want <= found or (text.startswith("card") and want <= found), (text, found)
        assert got[text].sensitivity_level == level, text
    assert got[None].sensitivity_level == "NONE"


def test_credentials_keywords_and_levels(spark):
    texts = ["api_key = abcdefghijklmnop1234 password: hunter22", "CONFIDENTIAL, RESTRICTED. Internal use only", "secret", "ABCDE1234F 4567 8901 2345 a@b.co +91-9876543210 confidential", "a@b.co 9876543210"]
    got = [r for r in sensitivity.analyze(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).orderBy("id").collect()]
    assert [r.sensitivity_level for r in got] == ["HIGH", "MEDIUM", "LOW", "HIGH", "MEDIUM"]
    assert {m.pattern_name for m in got[0].matches} == {"Potential API Key / Secret", "Potential Password String"}
    assert len([m for m in got[1].matches if m.category == "sensitive_keyword"]) == 3
    assert got[2].matches[0].match_snippet == "Keyword 'secret' matched (1x)"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_scores(spark):
    L = F.lit
    r = one(
        spark,
        scoring.confidence(L("reconstructed"), L(1), L(0.92), L(False)).alias("clean"),
        scoring.confidence(L("ambiguous"), L(2), L(0.9), L(True)).alias("tied"),
        scoring.confidence(L("cluster_only"), L(0), L(0.0), L(False)).alias("none"),
        scoring.completeness(L(512), L(0), L(0), L(True), L(True)).alias("whole"),
        scoring.completeness(L(1024), L(2), L(1024), L(True), L(True)).alias("gaps"),
        scoring.corruption(L(False), L("validation_failed"), L("bad CRC")).alias("crc"),
        scoring.corruption(L(True), L("reconstructed"), L("ok")).alias("fine"),
        scoring.composite(L(0.1), L(0.0), L(0.0), L(0.0)).alias("bare"),
        scoring.composite(L(1.0), L(1.0), L(1.0), L(0.0), (0, 0, 0, 0)).alias("zero_weights"),
        scoring.recovery_ratio(L(400), L(100)).alias("ratio"),
        scoring.recovery_ratio(L(0), L(0)).alias("nothing"),
    )
    assert (r.clean, r.tied, r.none) == (0.984, 0.3375, 0.1)
    assert (r.whole, r.gaps, r.crc, r.fine) == (1.0, 0.43, 0.9, 0.0)
    assert (r.bare, r.zero_weights, r.ratio, r.nothing) == (0.175, 1.0, 0.8, 0.0)


@pytest.mark.parametrize(
    ("args", "want"),
    [((1.0, 0, 10, 1, "pdf", False, "reconstructed"), "FULLY_RECONSTRUCTED"), ((1.0, 1, 10, 2, "pdf", False, "reconstructed"), "STRUCTURALLY_VALID_PARTIAL"), ((0.0, 1, 10, 2, "pdf", False, "validation_failed"), "PARTIALLY_RECONSTRUCTED"), ((0.0, 0, 10, 2, "pdf", False, "validation_failed"), "STRUCTURALLY_INVALID"), ((0.0, 0, 10, 2, "raw", False, "x"), "RAW_BINARY_RECOVERY"), ((1.0, 0, 10, 2, "text", True, "ambiguous"), "AMBIGUOUS"), ((0.0, 0, 0, 0, "pdf", False, "cluster_only"), "UNRECOVERABLE")],
)
def test_recovery_status(spark, args, want):
    assert one(spark, scoring.recovery_status(*map(F.lit, args)).alias("s")).s == want


def test_priority_penalties_lower_the_score(spark):
    L = F.lit
    base = (L(0.9), L(1.0), L(1.0), L(65536), L("HIGH"), L(2))
    r = one(spark, scoring.priority(*base, L(False), L(0.0)).alias("a"), scoring.priority(*base, L(True), L(0.0)).alias("b"), scoring.priority(*base, L(False), L(1.0)).alias("c"))
    assert r.a == 0.96 and r.b == 0.81 and r.c == 0.86


def test_each_sensitive_pattern_is_matched_once(spark):
    from palimpsest.functions import sensitivity as se

    df = se.analyze(spark.createDataFrame([(1, "Top SECRET file of ABCDE1234F")], "id long, text string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == len(se.IDENTIFIERS) + len(se.CREDENTIALS) + len(se.KEYWORDS)
    assert [(m.category, m.occurrence_count) for m in df.first().matches] == [("pan", 1), ("sensitive_keyword", 1), ("sensitive_keyword", 1)]


def test_every_keyword_passes_the_cheap_test(spark):
    from palimpsest.functions import sensitivity as se

    texts = [(i, "An " + p.replace(r"\b", "").replace("[- ]", "-").replace("?", "").upper() + " x") for i, (p, _) in enumerate(se.KEYWORDS)]
    found = se.matches(spark.createDataFrame(texts, "id long, text string"), "keywords").collect()
    assert {(r.id, r.pattern_name) for r in found} >= {(i, name) for i, (_, name) in enumerate(se.KEYWORDS)}
