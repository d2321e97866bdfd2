import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from palimpsest.llm import queries as q

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    first = {r.doc_id: r.text for r in docs.collect()}
    seen = [len(first)]
    bench = [r.text.lower() for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    for name, stage in p.STAGES:
        out = stage(spark, docs, DIR)
        if name != "encoded":
            assert out.dtypes == docs.dtypes
            out = out.persist()
        seen.append(out.count())
        docs = out
        if name == "benchmark_leaks":
            kept = {r.doc_id: r.text for r in docs.collect()}
            assert not any(b in " ".join(t.lower().split()) for t in kept.values() for b in bench if len(b.split()) > 5)
    assert seen == sorted(seen, reverse=True) and seen[0] > seen[-1] > 0
    assert p.run(spark, DIR).count() == seen[-1]


def test_language_and_benchmark_stages_equal_brute_force(spark):
    """Every text by plain mixture inference, and every item aligned with every whole text."""
    import numpy as np

    from palimpsest.llm import decontam, langid
    from tests.llm.test_operators import plain_mixture

    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("n_chars < 1200")
    model = langid.learn(docs)
    rows = docs.collect()
    want = {r.doc_id for r in rows if r.text is not None and any(c.isalpha() for c in r.text) and plain_mixture(r.text, *model)}
    assert {r.doc_id for r in p.language(spark, docs, DIR).collect()} == want
    words = lambda t: decontam._tokens(np.frombuffer(t.lower().encode(), np.uint8), np.array([0, len(t.lower().encode())]))[0]
    items = [words(r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    leaks = {r.doc_id for r in rows if r.text for i in items if decontam.align(i, words(r.text)) >= decontam._needed(len(i), decontam.THRESHOLD)}
    assert leaks and {r.doc_id for r in p.benchmark_leaks(spark, docs, DIR).collect()} == {r.doc_id for r in rows} - leaks


def test_stages_take_odd_rows(spark):
    """Null and repeated ids, null and empty texts, repeated rows, and columns with names that the operators use."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    some = docs.limit(30)
    long = "lorem ipsum dolor sit amet " * 4000
    odd = spark.createDataFrame([(None, "le chat dort", None, None, 12), (None, None, "fr", "x", 0), (3, "", "de", "x", 0), (3, "word", None, "x", 4), (3, "word", None, "x", 4), (-1, long, "en", "x", len(long)), (9, "…", "en", "x", 1)], docs.schema)
    rows = some.unionByName(odd)
    for c in ("uid", "rank", "score", "spans", "fp", "rest", "z", "low"):
        rows = rows.withColumn(c, F.lit(1))
    for name, stage in p.STAGES:
        out = stage(spark, rows, DIR)
        if name != "encoded":
            assert out.dtypes == rows.dtypes
            rows = out.persist()
            assert rows.count() > 0
        else:
            assert out.count() == rows.count()


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id < 0")
    for _, stage in p.STAGES:
        docs = stage(spark, docs, DIR)
    assert docs.count() == 0


#: Of other tables than documents: pairs of anchors and positives, nodes of a trie.
OTHERS = ("op11_voronoi_negatives", "op13_louds_trie")


@pytest.mark.parametrize("name", [n for n in q.QUERIES if n not in OTHERS])
def test_queries_give_a_row_a_document(spark, name):
    n = spark.read.parquet(f"{DIR}/documents.parquet").count()
    rows = q.QUERIES[name](spark, DIR).collect()
    assert len(rows) == n or (name.startswith("op2_") and 0 < len(rows))


@pytest.mark.parametrize("name", list(q.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    found = c.sql(q.ORACLE_SQL[name])
    want = sorted(map(str, found.fetchall()))
    assert want and sorted(str(tuple(r)) for r in q.QUERIES[name](spark, DIR).select(found.columns).collect()) == want
