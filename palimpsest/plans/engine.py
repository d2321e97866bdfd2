"""The recovery pipeline over images: carve, profile, fingerprint, cluster, reassemble, score, assess, rank."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, MutableMapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, sensitivity
from ..functions.profile import characterize
from ..operators import carve as carving
from ..operators import embedding, formats, intervals, reassemble, relations, vectors
from ..settings import DEFAULT, Settings
from ..sources import evidence as ev
from ..storage import stored

#: Fragments' clusters that are sent out to their bytes; more meet them by a join.
SENT = 1 << 20


class Tables(MutableMapping):
    """Tables by name.  One that is given as a function is built, once, when it is first asked for."""

    def __init__(self, **known: DataFrame):
        self._known: dict[str, DataFrame | Callable[[], DataFrame]] = known

    def __getitem__(self, name: str) -> DataFrame:
        if not isinstance(self._known[name], DataFrame):
            self._known[name] = self._known[name]()
        return self._known[name]

    def __setitem__(self, name: str, table: DataFrame | Callable[[], DataFrame]) -> None:
        self._known[name] = table

    def __delitem__(self, name: str) -> None:
        del self._known[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._known)

    def __len__(self) -> int:
        return len(self._known)


class Engine:
    """Stages over evidence (source_path, content, ...): each a table, built once and stored.

    ``stage(n)`` gives the tables known after stage n, 1 to 8.  No later stage reads ``edges``, the
    relation graph: it is built when it is asked for.  Bytes are stored twice, with the fragments and
    with the candidates; later tables meet them again by cluster.  ``encoder`` embeds text
    fragments in place of hashed tokens.
    """

    def __init__(self, spark: SparkSession, evidence: DataFrame, settings: Settings = DEFAULT, encoder: embedding.Hook | None = None):
        self.spark, self.s, self.encoder = spark, settings, encoder
        self.tables = Tables(evidence=evidence)
        self._steps = [self.carve, self.profile, self.fingerprint, self.relate, self.reassemble, self.score, self.assess, self.rank]
        self._done = 0
        self.listeners: list[Callable[[int, int, str], None]] = []
        self._seconds: list[tuple[int, str, float, list[str]]] = []

    @classmethod
    def of(cls, spark: SparkSession, path: str) -> Engine:
        return cls(spark, ev.read_evidence(spark, path))

    def stage(self, n: int) -> Tables:
        while self._done < n:
            step, known, began = self._steps[self._done], set(self.tables), time.perf_counter()
            step()
            self._done += 1
            self._seconds.append((self._done, step.__name__, time.perf_counter() - began, [t for t in self.tables if t not in known]))
            for told in self.listeners:
                told(self._done, len(self._steps), step.__name__)
        return self.tables

    def telemetry(self) -> DataFrame:
        """stage, name, seconds, table, rows: of each stage that ran, its time and the tables it made.

        Rows are counted by an observation on one pass over each table.
        """
        out = []
        for stage, name, seconds, made in self._seconds:
            for table in made or [None]:
                rows = None
                if table is not None:
                    seen = Observation(f"{name}-{table}")
                    self.tables[table].observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
                    rows = seen.get["rows"]
                out.append((stage, name, seconds, table, rows))
        return self.spark.createDataFrame(out, "stage int, name string, seconds double, table string, rows long")

    def run(self) -> DataFrame:
        return self.stage(8)["ranked"]

    def carve(self) -> None:
        t = self.tables
        found = carving.carve(ev.chunked(t["evidence"]))
        # ids are numbers within a source; across sources fragments are told apart by a key
        sources = intervals.global_rank(found.select("source").distinct(), [F.asc("source")], "source_no")
        t["fragments"] = stored(found.join(sources, "source").withColumn("seq", (F.shiftleft(F.col("source_no").cast("bigint"), 40) + F.col("seq")).cast("bigint")), "fragments")

    def profile(self) -> None:
        t = self.tables
        with_bytes = ev.fragment_bytes(t["fragments"], t["evidence"])
        t["characterized"] = stored(characterize(with_bytes, "data", self.s), "characterized", heavy=True)

    def fingerprint(self) -> None:
        t = self.tables
        dense = (lambda rows: embedding.embed(rows, self.encoder, dim=self.s.dimension)) if self.encoder else None
        t["features"] = stored(vectors.fingerprints(t["characterized"], "seq", "data", dense=dense), "features")

    def relate(self) -> None:
        t = self.tables
        nodes = stored(t["characterized"].drop("data").join(t["features"].select(F.col("id").alias("seq"), "vector"), "seq"), "nodes")
        members, orphans = relations.clusters(nodes.withColumn("id", F.col("seq")), self.s)
        # an orphan with a header is a cluster of its own; others stay orphans
        alone = orphans.select(F.col("id").alias("seq")).join(nodes.where("header_flag").select("seq"), "seq").select("seq", F.col("seq").alias("label"), F.lit(True).alias("is_singleton"))
        both = stored(members.select("seq", "label", F.lit(False).alias("is_singleton")).unionByName(alone), "members")
        rolled = relations.roll_up(both.withColumn("id", F.col("seq")), nodes, self.s)
        single = both.groupBy("label").agg(F.max("is_singleton").alias("is_singleton"))
        cluster = F.format_string("cluster_%d_%04d", F.shiftright("label", 40), F.col("label").bitwiseAND(F.lit((1 << 40) - 1)))
        t["members"] = both
        t["clusters"] = stored(rolled.join(single, "label").withColumn("cluster_id", cluster).withColumn("confidence", F.when(F.col("is_singleton"), 1.0).otherwise(F.col("confidence"))), "clusters")
        t["orphans"] = orphans.select(F.col("id").alias("seq")).join(nodes.select("seq", "id", "source", "offset", "length", "type_hint", "header_flag"), "seq")
        t["nodes"] = nodes
        t["edges"] = lambda: stored(relations.edges(relations.close_pairs(nodes, "source", s=self.s), s=self.s), "edges")

    def reassemble(self) -> None:
        t = self.tables
        named = t["members"].join(t["clusters"].select("label", "cluster_id", "inferred_type", F.col("members").alias("parts")), "label").select("seq", "cluster_id", "inferred_type", "parts")
        named = F.broadcast(named) if t["members"].count() <= SENT else named
        rows = t["characterized"].select("seq", "id", "offset", "type_hint", "data").join(named, "seq")
        t["candidates"] = stored(reassemble.reassemble(rows), "candidates", heavy=True)
        t["nested"] = formats.nested(t["candidates"].where(F.col("file_type").isin(*relations.ARCHIVES)), "cluster_id")

    def score(self) -> None:
        t = self.tables
        frags = t["members"].join(t["nodes"], "seq").join(t["clusters"].select("label", "cluster_id"), "label")
        flags = frags.groupBy("cluster_id").agg(F.count("*").alias("fragment_count"), F.sum("length").alias("raw_length"), F.max("header_flag").alias("header"), F.max("footer_flag").alias("footer"))
        cover = intervals.coverage(frags, "cluster_id", "offset", "length").withColumnRenamed("group", "cluster_id")
        c = t["candidates"].drop("content").join(flags, "cluster_id").join(cover.drop("fragments"), "cluster_id").join(t["clusters"].select("cluster_id", F.col("confidence").alias("cluster_confidence")), "cluster_id")
        ok = (F.col("status") == "reconstructed") | (F.col("structural_validity") >= 1.0)
        c = c.withColumn("stage5_structural_validity", F.col("structural_validity")).withColumn("success", ok)
        c = c.withColumn("reconstruction_confidence", scoring.confidence(F.col("status"), F.size("fragment_ids"), F.col("cluster_confidence"), F.col("ambiguous")))
        c = c.withColumn("completeness", scoring.completeness(F.col("raw_length"), F.col("gap_count"), F.col("gap_bytes"), F.col("header"), F.col("footer")))
        c = c.withColumn("structural_validity", scoring.validity(F.col("success"), F.col("status")))
        c = c.withColumn("corruption_estimate", scoring.corruption(F.col("success"), F.col("status"), F.col("parser_message")))
        c = c.withColumn("composite_integrity_score", scoring.composite(F.col("reconstruction_confidence"), F.col("completeness"), F.col("structural_validity"), F.col("corruption_estimate"), self.s.integrity))
        t["scored"] = stored(c, "scored")

    def assess(self) -> None:
        self.tables["assessed"] = self._with_bytes(self._assessed()).withColumn("artifact_sha256", F.sha2("content", 256))

    def _with_bytes(self, c: DataFrame) -> DataFrame:
        """``c`` with the content of its candidates."""
        return c.join(self.tables["candidates"].select("cluster_id", "content"), "cluster_id")

    def _assessed(self) -> DataFrame:
        c = self.tables["scored"]
        n = F.size("fragment_ids")
        c = c.withColumn("recovered_bytes", F.col("unique_bytes")).withColumn("missing_bytes", F.col("gap_bytes"))
        c = c.withColumn("observed_recovery_ratio", scoring.recovery_ratio(F.col("recovered_bytes"), F.col("missing_bytes")))
        c = c.withColumn("recovery_status", scoring.recovery_status(F.col("structural_validity"), F.col("gap_count"), F.col("recovered_bytes"), n, F.col("file_type"), F.col("ambiguous"), F.col("status")))
        c = c.withColumn("recovery_reason", scoring.recovery_reason(n, F.col("recovered_bytes"), F.col("span_bytes"), F.col("missing_bytes"), F.col("file_type"), F.col("structural_validity"), F.col("recovery_status"), F.col("parser_message")))
        c = c.withColumn("is_successfully_recovered", scoring.recovered_ok(F.col("structural_validity"), F.col("recovery_status")))
        c = c.withColumn("candidate_id", F.concat(F.lit("recon_"), F.col("cluster_id")))
        folder, name = ev.artifact(F.col("candidate_id"), F.col("file_type"), F.col("recovery_status"))
        return c.withColumn("artifact_path", F.concat(folder, F.lit("/"), name))

    def rank(self) -> None:
        bodies = self.tables["candidates"].select("cluster_id", F.sha2("content", 256).alias("artifact_sha256"), sensitivity.decoded(F.col("content")).alias("body"))
        c = self._assessed().join(stored(sensitivity.analyze(bodies, "body").drop("body"), "sensitive"), "cluster_id")
        args = (F.col("sensitivity_level"), F.size("categories"))
        c = c.withColumn("priority_score", scoring.priority(F.col("composite_integrity_score"), F.col("observed_recovery_ratio"), F.col("structural_validity"), F.col("recovered_bytes"), *args, F.col("ambiguous"), F.col("corruption_estimate"), self.s))
        c = c.withColumn("priority_reason", scoring.priority_reason(F.col("priority_score"), *args, F.col("structural_validity"), F.col("observed_recovery_ratio"), F.col("ambiguous"), F.col("corruption_estimate"), self.s))
        order = [F.desc("priority_score"), F.desc("composite_integrity_score"), F.desc("observed_recovery_ratio"), F.desc("recovered_bytes"), F.asc("candidate_id")]
        self.tables["ranked"] = self._with_bytes(intervals.global_rank(c, order))
