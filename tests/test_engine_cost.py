"""What a run of the engine does not pay for: tables that nobody asks for, a group a cluster, bytes in every table."""

import pytest

from palimpsest import storage
from palimpsest.operators import reassemble, vectors
from palimpsest.plans.engine import Engine
from palimpsest.sources import fixtures as fx


def test_relation_graph_is_built_when_asked_for(spark):
    e = Engine(spark, fx.image_frame(spark))
    e.run()
    made = lambda: sum("palimpsest-edges-" in p for p in storage._STORED[spark.sparkContext.applicationId])
    before = made()
    assert "edges" in e.tables
    n = e.tables["edges"].count()
    assert (made() - before, n > 0, e.tables["edges"].count()) == (1, True, n)


def test_bytes_are_stored_with_fragments_and_candidates_only(spark):
    e = Engine(spark, fx.image_frame(spark))
    ranked = {r.candidate_id: bytes(r.content) for r in e.run().select("candidate_id", "content").collect()}
    assert "content" not in e.tables["scored"].columns
    assert ranked == {f"recon_{r.cluster_id}": bytes(r.content) for r in e.tables["candidates"].collect()}


def test_clusters_come_in_one_stream(spark):
    whole = fx.bzipped()
    rows = [("c", "bz2", f"F{i}", i * 10, "bz2", bytearray(whole[i * 20 : (i + 1) * 20 if i < 2 else None]), 3) for i in range(3)] + [(f"s{k}", "text", "F9", k, "text", bytearray(b"one text."), 1) for k in range(5)]
    members = spark.createDataFrame(rows, "cluster_id string, inferred_type string, id string, offset long, type_hint string, data binary, parts long")
    found = reassemble.reassemble(members)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    assert sorted(found.collect()) == sorted(reassemble.reassemble(members.drop("parts")).collect())
    got = {r.cluster_id: (r.status, len(r.fragment_ids)) for r in found.collect()}
    assert got == {"c": ("reconstructed", 3)} | {f"s{k}": ("reconstructed", 1) for k in range(5)}


def test_only_pairs_that_occur_are_sent(spark, monkeypatch):
    from pyspark import SparkContext

    sent, real = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, x: sent.append(x) or real(self, x))
    rows = spark.createDataFrame([(k, bytearray([k, 200, 7, k, 9] * 20)) for k in range(6)], "id long, data binary")
    got = vectors.pair_vectors(rows).collect()
    assert all(sum(x * x for x in r.vector) == pytest.approx(1, abs=1e-3) for r in got)
    assert max(x.shape[0] for x in sent if hasattr(x, "shape")) < 100
