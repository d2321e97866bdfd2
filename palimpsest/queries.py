"""The recovery engine's queries over the driver's tables, and the same questions in DuckDB's SQL.

Documents stand for evidence (their UTF-8 bytes, or files and images of every format made
of them), embeddings for fingerprints laid out along an image, lineitem for byte intervals
of candidates, events for what arrives, conversations for texts to be ordered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import profile, scoring, sensitivity
from .operators import asof, carve, embedding, formats, index, intervals, orders, reassemble, relations, similarity, vectors
from .plans import metrics, reports
from .plans.engine import Engine
from .settings import Settings
from .sources import evidence as ev
from .sources import fixtures
from .storage import bucket_count, stored
from .streaming import sessions, watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))


def _round_sql(x: str) -> str:
    return f"floor(({x}) * 1e4 + 0.5 + 1e-7) / 1e4"


# Evidence


@query("SELECT doc_id, 'EV-' || upper(substr(sha256(coalesce(text, '')), 1, 12)) AS evidence_id, sha256(coalesce(text, '')) AS sha256, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size_bytes FROM documents")
def evidence_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = F.sha2("data", 256)
    return document_bytes(spark, sf_dir).select("doc_id", ev.evidence_id(sha).alias("evidence_id"), sha.alias("sha256"), F.octet_length("data").cast("bigint").alias("size_bytes"))


@query("SELECT sha256(coalesce(text, '')) AS sha256, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def evidence_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_bytes(spark, sf_dir).groupBy(F.sha2("data", 256).alias("sha256")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


# Byte profile

_BYTES_SQL = "SELECT doc_id, unnest(regexp_extract_all(hex(encode(coalesce(text, ''))), '..')) AS b, unnest(range(strlen(coalesce(text, '')))) AS p FROM documents"
_ENTROPY_SQL = f"SELECT doc_id, {_round_sql('greatest(0, log2(sum(c)) - sum(c * log2(c)) / sum(c))')} AS entropy FROM (SELECT doc_id, b, CAST(count(*) AS DOUBLE) AS c FROM bytes GROUP BY ALL) GROUP BY doc_id"
_WINDOWS_SQL = f"""SELECT doc_id, w * 32 AS window_start, least(w * 32 + 128, any_value(n)) AS window_end, {_round_sql("greatest(0, log2(sum(c)) - sum(c * log2(c)) / sum(c))")} AS entropy
FROM (SELECT doc_id, w, b, any_value(n) AS n, CAST(count(*) AS DOUBLE) AS c
  FROM (SELECT doc_id, b, n, unnest(range(greatest(0, CAST(ceil((p - 127) / 32.0) AS BIGINT)), least(p // 32, CAST(ceil(greatest(0, n - 128) / 32.0) AS BIGINT)) + 1)) AS w
    FROM bytes JOIN (SELECT doc_id, strlen(coalesce(text, '')) AS n FROM documents) USING (doc_id)) GROUP BY doc_id, w, b) GROUP BY doc_id, w"""
_PRINTABLE_SQL = f"SELECT doc_id, {_round_sql(chr(39).join(['avg(CASE WHEN b BETWEEN ', '20', ' AND ', '7E', ' OR b IN (', '09', ', ', '0A', ', ', '0D', ') THEN 1.0 ELSE 0.0 END)']))} AS printable_ratio FROM bytes GROUP BY doc_id"


@query(f"WITH bytes AS ({_BYTES_SQL}) SELECT d.doc_id, coalesce(e.entropy, 0) AS entropy FROM documents d LEFT JOIN ({_ENTROPY_SQL}) e USING (doc_id)")
def doc_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_bytes(spark, sf_dir).select("doc_id", profile.byte_entropy("data").alias("entropy"))


@query(f"WITH bytes AS ({_BYTES_SQL}) SELECT d.doc_id, coalesce(e.printable_ratio, 0) AS printable_ratio FROM documents d LEFT JOIN ({_PRINTABLE_SQL}) e USING (doc_id)")
def printable_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_bytes(spark, sf_dir).select("doc_id", profile.printable_ratio("data").alias("printable_ratio"))


@query(f"WITH bytes AS ({_BYTES_SQL}) {_WINDOWS_SQL}")
def entropy_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.entropy_windows(document_bytes(spark, sf_dir), keys=("doc_id",))


@query(f"""WITH bytes AS ({_BYTES_SQL}), e AS ({_ENTROPY_SQL}), r AS ({_PRINTABLE_SQL}), w AS (SELECT doc_id, count(*) AS n, min(entropy) AS low, max(entropy) AS high FROM ({_WINDOWS_SQL}) GROUP BY doc_id)
SELECT d.doc_id, coalesce(e.entropy, 0) AS entropy, coalesce(r.printable_ratio, 0) AS printable_ratio, coalesce(w.n, 0) AS n_windows,
  CASE WHEN w.n IS NULL THEN 'binary' WHEN w.n >= 2 AND w.high - w.low >= 1.8 AND w.high >= 6.5 AND w.low <= 5.8 THEN 'mixed' WHEN printable_ratio >= 0.85 AND entropy <= 5.8 THEN 'text'
    WHEN printable_ratio <= 0.30 OR entropy >= 6.5 THEN 'binary' WHEN printable_ratio >= 0.70 AND entropy <= 6.0 THEN 'text' ELSE 'binary' END AS characterization
FROM documents d LEFT JOIN e USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN w USING (doc_id)""")
def characterization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.characterize(document_bytes(spark, sf_dir)).select("doc_id", "entropy", "printable_ratio", "n_windows", "characterization")


@query("SELECT page_id, CAST(o AS BIGINT) AS line_offset, trim(regexp_replace(substr(h, 2 * o + 1, 32), '(..)', '\\1 ', 'g')) AS hex_bytes, list_aggregate(list_transform(regexp_extract_all(substr(h, 2 * o + 1, 32), '..'), lambda x: CASE WHEN x BETWEEN '20' AND '7E' THEN chr(CAST('0x' || x AS INTEGER)) ELSE '.' END), 'string_agg', '') AS ascii FROM (SELECT page_id, hex(encode(html)) AS h, unnest(range(0, strlen(html), 16)) AS o FROM pages)")
def hex_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.hex_preview(table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("data")), "page_id")


_SIGNS = [(s.kind, s.header.hex().upper()) for s in carve.SIGNATURES]


def _spaced(h: str) -> str:
    return " ".join(h[i : i + 2] for i in range(0, len(h), 2)) + " "


@query("WITH h AS (SELECT regexp_replace(hex(encode(text)), '(..)', '\\1 ', 'g') AS h FROM documents) " + " UNION ALL ".join(f"SELECT '{k}' AS kind, '{h}' AS header, CAST(coalesce(sum((len(h) - len(replace(h, '{_spaced(h)}', ''))) // {len(_spaced(h))}), 0) AS BIGINT) AS hits FROM h" for k, h in _SIGNS))
def signature_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        total = [0] * len(carve.SIGNATURES)
        for b in batches:
            for x in b.column(0).to_pylist():
                for i, s in enumerate(carve.SIGNATURES):
                    total[i] += x.count(s.header)
        yield pa.RecordBatch.from_arrays([pa.array([s.kind for s in carve.SIGNATURES]), pa.array([s.header.hex().upper() for s in carve.SIGNATURES]), pa.array(total, pa.int64())], names=["kind", "header", "hits"])

    return document_bytes(spark, sf_dir).select("data").mapInArrow(run, "kind string, header string, hits long").groupBy("kind", "header").agg(F.sum("hits").alias("hits"))


# Fingerprints and relations


@query("""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS tok FROM documents WHERE trim(text) <> ''
  UNION ALL SELECT doc_id, lower(substr(text, CAST(i AS BIGINT), 3)) FROM (SELECT doc_id, text, unnest(range(1, length(text) - 1)) AS i FROM documents WHERE trim(text) <> '')),
u AS (SELECT doc_id, tok, count(*) AS n FROM t GROUP BY ALL), d AS (SELECT DISTINCT tok FROM u),
h AS (SELECT tok, list_reduce(list_transform(regexp_extract_all(hex(encode(tok)), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda a, x: (xor(a, x) * 16777619) & 4294967295, 2166136261) % 64 AS bucket FROM d)
SELECT doc_id, CAST(bucket AS BIGINT) AS bucket, CAST(sum(n) AS BIGINT) AS n FROM u JOIN h USING (tok) GROUP BY ALL""")
def text_hash_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(vectors.text_buckets("text")).alias("bucket", "n"))
    return rows.where("n > 0").select("doc_id", F.col("bucket").cast("bigint").alias("bucket"), F.col("n").cast("bigint").alias("n"))


@query(f"""WITH b AS (SELECT page_id, hex(encode(html)) AS h FROM pages), p AS (SELECT DISTINCT page_id, substr(h, 2 * i + 1, 4) AS pair FROM (SELECT page_id, h, unnest(range(length(h) // 2 - 1)) AS i FROM b))
SELECT CAST('0x' || pair AS BIGINT) AS pair, count(*) AS pages, {_round_sql("ln((n + 1)::DOUBLE / (count(*) + 1)) + 1")} AS idf FROM p, (SELECT count(*) AS n FROM pages) GROUP BY pair, n""")
def byte_pair_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.pair_frequencies(table(spark, sf_dir, "pages").select(F.encode("html", "UTF-8").alias("data")))
    n = found.where("pair < 0").select(F.col("n").alias("total"))
    return found.where("pair >= 0").crossJoin(F.broadcast(n)).select("pair", F.col("n").alias("pages"), profile.round4(F.log((F.col("total") + 1) / (F.col("n") + 1)) + 1).alias("idf"))


@query()
def byte_pair_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("data"))
    out = vectors.pair_vectors(rows, "page_id", "data")
    return out.select(F.col("id").alias("page_id"), "vector", profile.round4(F.sqrt(vectors.dot(F.col("vector"), F.col("vector")))).alias("norm"))


def embedded_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as fragments of 4096 bytes in images by label, one after the other by id."""
    e = table(spark, sf_dir, "embeddings").where("vec_id is not null")
    return e.select(
        F.col("vec_id").alias("id"), F.col("vec_id").alias("seq"), F.col("label").cast("string").alias("source"), (F.col("vec_id") * 4096).alias("offset"), F.lit(4096).cast("bigint").alias("length"),
        F.element_at(F.array(F.lit("zip"), F.lit("jpeg"), F.lit("unknown")), (F.pmod("vec_id", F.lit(3)) + 1).cast("int")).alias("type_hint"),
        F.when(F.pmod("vec_id", F.lit(2)) == 0, "text").otherwise("binary").alias("characterization"), (F.pmod("vec_id", F.lit(7)) == 0).alias("header_flag"),
        F.when(F.pmod("vec_id", F.lit(4)) == 0, F.concat(F.lit("g"), F.floor(F.col("vec_id") / 20).cast("string"))).alias("group_id"), (F.pmod("vec_id", F.lit(11)) == 0).alias("extent_linked"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )


_FRAGMENTS_SQL = "frags AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS source, vec_id * 4096 AS o, CASE vec_id % 3 WHEN 0 THEN 'zip' WHEN 1 THEN 'jpeg' ELSE 'unknown' END AS kind, vec_id % 2 = 0 AS text, vec_id % 7 = 0 AS header, CASE WHEN vec_id % 4 = 0 THEN 'g' || (vec_id // 20) END AS grp, vec_id % 11 = 0 AS linked, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL)"
_PAIRS_SQL = f"""{_FRAGMENTS_SQL},
p AS (SELECT a.id AS a, b.id AS b, a.kind AS ka, b.kind AS kb, a.source = b.source AS same, a.header AND b.header AS headers, coalesce(a.grp = b.grp, false) AS grouped, a.linked OR b.linked AS linked, greatest(b.o - a.o - 4096, 0) AS gap, {_round_sql("list_cosine_similarity(a.v, b.v)")} AS similarity, CASE WHEN a.source <> b.source THEN 0.0 ELSE {_round_sql("exp(-greatest(b.o - a.o - 4096, 0) / 65536.0)")} END AS offset_proximity,
  CASE WHEN a.kind = b.kind AND a.kind <> 'unknown' THEN 1.0 WHEN a.text AND b.text THEN 0.85 WHEN a.kind = 'unknown' OR b.kind = 'unknown' THEN 0.20 ELSE 0.0 END AS type_match FROM frags a JOIN frags b ON a.id < b.id),
m AS (SELECT *, {_round_sql("greatest(0, least(1, 0.6 / 1.0 * greatest(0, similarity) + 0.2 / 1.0 * offset_proximity + 0.2 / 1.0 * type_match))")} AS edge_weight FROM p)"""
_BASIS_SQL = "CASE WHEN ka = 'zip' AND kb = 'zip' AND gap = 0 THEN 'ARCHIVE_STRUCTURAL_CONTINUITY' WHEN ka = 'zip' AND kb = 'zip' THEN 'ARCHIVE_SAME_CONTAINER' WHEN offset_proximity >= 0.5 AND type_match >= 0.8 THEN 'STRUCTURAL_SPATIAL' WHEN linked THEN 'FILESYSTEM_EXTENT' ELSE 'HEURISTIC_SIMILARITY' END"
_TYPE_SQL = "CASE WHEN ka = 'zip' AND kb = 'zip' AND gap = 0 THEN 'MUST_FOLLOW' WHEN ka = 'zip' AND kb = 'zip' THEN 'SAME_ARCHIVE' WHEN linked AND NOT (offset_proximity >= 0.5 AND type_match >= 0.8) THEN 'SAME_MEMBER' ELSE 'MAY_FOLLOW' END"


def _two_sql(x: str) -> str:
    return f"printf('%.2f', floor(({x}) * 100 + 0.5 + 1e-9) / 100)"


_REASON_SQL = f"""coalesce(nullif(concat_ws(', ', CASE WHEN ka = 'zip' AND kb = 'zip' THEN 'archive ZIP structural continuity' END,
  CASE WHEN similarity >= 0.7 THEN 'high vector similarity (' || {_two_sql("similarity")} || ')' WHEN similarity >= 0.4 THEN 'moderate vector similarity (' || {_two_sql("similarity")} || ')' END,
  CASE WHEN offset_proximity >= 0.8 THEN 'close offset proximity' END, CASE WHEN type_match >= 0.8 THEN 'compatible type (' || ka || ')' END), ''), 'composite signal correlation')"""


@query(f"WITH {_PAIRS_SQL} SELECT a AS source_id, b AS target_id, similarity, offset_proximity, CAST(type_match AS DOUBLE) AS type_match, edge_weight, {_BASIS_SQL} AS relationship_basis, {_TYPE_SQL} AS relationship_type, {_REASON_SQL} AS reason FROM m WHERE edge_weight >= 0.40 OR similarity >= 0.50")
def fragment_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fragments as one evidence: an edge joins any two of them, at any distance."""
    return relations.edges(relations.close_pairs(embedded_fragments(spark, sf_dir)))


@query(f"WITH {_PAIRS_SQL} SELECT {_BASIS_SQL} AS relationship_basis, count(*) AS n, {_round_sql('avg(edge_weight)')} AS mean_weight FROM m WHERE edge_weight >= 0.40 OR similarity >= 0.50 GROUP BY 1")
def edge_basis_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fragment_edges(spark, sf_dir)
    return e.groupBy("relationship_basis").agg(F.count("*").alias("n"), profile.round4(F.avg("edge_weight")).alias("mean_weight"))


#: Random vectors are nearly orthogonal: a wider radius than the engine's lets type and place form clusters.
LOOSE = Settings(eps=0.62)
DENSE = Settings(eps=0.62, min_samples=4)


def _near_sql(eps: float, samples: int = 2) -> str:
    """Clusters (id, label): cores with their neighbours; a border point goes to the first cluster that reaches it."""
    return f"""{_PAIRS_SQL}, near AS (SELECT a AS u, b AS v FROM m WHERE same AND CASE WHEN type_match <= 0 OR headers OR offset_proximity < 0.15 THEN 1.0 WHEN grouped THEN 0.05 ELSE 1.0 - edge_weight END <= {eps}),
every AS (SELECT u, v FROM near UNION SELECT v, u FROM near), cores AS (SELECT u FROM every GROUP BY u HAVING count(*) + 1 >= {samples}),
both_ AS (SELECT e.u, e.v FROM every e JOIN cores c ON c.u = e.u JOIN cores d ON d.u = e.v),
reached(u, r) AS (SELECT u, u FROM cores UNION SELECT b.v, reached.r FROM reached JOIN both_ b ON b.u = reached.u WHERE b.v > reached.r),
owned AS (SELECT u AS id, min(r) AS label FROM reached GROUP BY u),
labels AS (SELECT * FROM owned UNION ALL SELECT e.u, min(o.label) FROM every e JOIN owned o ON o.id = e.v WHERE e.u NOT IN (SELECT u FROM cores) GROUP BY e.u)"""


@query(f"WITH RECURSIVE {_near_sql(0.62)} SELECT id, label FROM labels")
def fragment_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.clusters(embedded_fragments(spark, sf_dir), LOOSE)[0].select("id", "label")


@query(f"WITH RECURSIVE {_near_sql(0.30)} SELECT id, label FROM labels")
def engine_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the engine's own radius: carved extents of one group, and what is very alike."""
    return relations.clusters(embedded_fragments(spark, sf_dir))[0].select("id", "label")


@query(f"WITH RECURSIVE {_near_sql(0.62, 4)} SELECT id, label FROM labels")
def dense_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.clusters(embedded_fragments(spark, sf_dir), DENSE)[0].select("id", "label")


@query(f"WITH RECURSIVE {_near_sql(0.62)} SELECT id FROM frags WHERE id NOT IN (SELECT id FROM labels)")
def orphan_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.clusters(embedded_fragments(spark, sf_dir), LOOSE)[1]


@query(f"""WITH RECURSIVE {_near_sql(0.62)}, k AS (SELECT label, kind, count(*) AS n, min(id) AS f FROM labels JOIN frags USING (id) WHERE kind <> 'unknown' GROUP BY ALL),
best AS (SELECT label, kind FROM k QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, f) = 1),
pair AS (SELECT x.label, avg(list_cosine_similarity(a.v, b.v)) AS c FROM labels x JOIN labels y ON x.label = y.label AND x.id < y.id JOIN frags a ON a.id = x.id JOIN frags b ON b.id = y.id GROUP BY x.label),
whole AS (SELECT l.label, count(*) AS members, coalesce(any_value(best.kind), 'unknown') AS inferred_type, {_round_sql("greatest(0.1, least(1.0, any_value(pair.c)))")} AS confidence, array_to_string(list(l.id ORDER BY l.id), ',') AS member_ids FROM labels l LEFT JOIN best USING (label) LEFT JOIN pair USING (label) GROUP BY l.label)
SELECT *, members || ' fragments grouped (inferred type: ' || chr(39) || inferred_type || chr(39) || ') with mean intra-cluster vector similarity of ' || {_two_sql("confidence")} || ' (conservative DBSCAN eps=0.62)' AS reason FROM whole""")
def cluster_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = embedded_fragments(spark, sf_dir)
    return relations.roll_up(relations.clusters(f, LOOSE)[0], f, LOOSE).select("label", "members", "inferred_type", "confidence", F.array_join(F.transform("member_ids", lambda x: x.cast("string")), ",").alias("member_ids"), "reason")


def _vector_groups_sql(eps: float, samples: int) -> str:
    """Density clusters on cosines alone, over all pairs of embeddings."""
    return f"""RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL),
every AS (SELECT a.id AS u, b.id AS v FROM v a JOIN v b ON a.id <> b.id AND 1.0::DOUBLE - greatest(0.0::DOUBLE, {_round_sql("list_cosine_similarity(a.v, b.v)")}) <= {eps}::DOUBLE),
cores AS (SELECT id AS u FROM v LEFT JOIN every ON every.u = v.id GROUP BY id HAVING count(every.v) + 1 >= {samples}),
both_ AS (SELECT e.u, e.v FROM every e JOIN cores c ON c.u = e.u JOIN cores d ON d.u = e.v),
reached(u, r) AS (SELECT u, u FROM cores UNION SELECT b.v, reached.r FROM reached JOIN both_ b ON b.u = reached.u WHERE b.v > reached.r),
owned AS (SELECT u AS id, min(r) AS label FROM reached GROUP BY u),
labels AS (SELECT * FROM owned UNION ALL SELECT e.u, min(o.label) FROM every e JOIN owned o ON o.id = e.v WHERE e.u NOT IN (SELECT u FROM cores) GROUP BY e.u)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query(f"WITH {_vector_groups_sql(0.62, 2)} SELECT id, label FROM labels")
def vector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters on vectors alone; random directions are nearly orthogonal, so the radius is wider than the engine's."""
    return similarity.dense_groups(_vectors(spark, sf_dir), eps=0.62)[0]


@query(f"WITH {_vector_groups_sql(0.66, 4)} SELECT label, count(*) AS members, CAST(sum(id) AS BIGINT) AS ids FROM labels GROUP BY label")
def vector_dense_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cores need four points within reach: clusters with their members and the sum of these."""
    found = similarity.dense_groups(_vectors(spark, sf_dir), eps=0.66, min_samples=4)[0]
    return found.groupBy("label").agg(F.count("*").alias("members"), F.sum("id").alias("ids"))


@query(f"WITH {_vector_groups_sql(0.66, 4)} SELECT id FROM v WHERE id NOT IN (SELECT id FROM labels)")
def vector_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.dense_groups(_vectors(spark, sf_dir), eps=0.66, min_samples=4)[1]


@query(f"""SELECT q.vec_id AS query_id, e.vec_id AS id, {_round_sql("list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))")} AS similarity,
CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_round_sql("list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))")} DESC, e.vec_id) AS INTEGER) AS place FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0 QUALIFY place <= 5""")
def similar_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return index.top_k(e, e.where(F.pmod("vec_id", F.lit(20)) == 0), k=5)


# Words weigh tf * idf by bucket of their MD5's first two bytes and go to four signed places by its next eight; the mean of all vectors is taken off
_DENSE_SQL = f"""w AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+')) AS word FROM documents) GROUP BY ALL),
h AS (SELECT word, md5(word) AS h, CAST('0x' || substr(md5(word), 1, 4) AS BIGINT) AS bucket FROM (SELECT DISTINCT word FROM w)),
n AS (SELECT count(DISTINCT doc_id) AS n FROM w),
idf AS (SELECT bucket, ln((n + 1)::DOUBLE / (count(DISTINCT doc_id) + 1)) + 1 AS idf FROM w JOIN h USING (word), n GROUP BY bucket, n),
spots AS (SELECT word, bucket, CAST('0x' || substr(h, 5 + 2 * k, 2) AS BIGINT) % 64 AS place, 1 - 2 * (CAST('0x' || substr(h, 13 + 2 * k, 2) AS BIGINT) & 1) AS sign FROM h, (SELECT unnest(range(4)) AS k)),
x AS (SELECT doc_id, place, sum(tf * idf * sign) AS x FROM w JOIN spots USING (word) JOIN idf USING (bucket) GROUP BY ALL),
u AS (SELECT doc_id, place, CAST(floor(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) * 1e6 + 0.5) AS BIGINT) AS u FROM x),
mean AS (SELECT place, sum(u) AS total FROM u GROUP BY place),
centred AS (SELECT d.doc_id, p.place, CAST(coalesce(u, 0) * n - coalesce(total, 0) AS DOUBLE) AS c FROM (SELECT DISTINCT doc_id FROM w) d CROSS JOIN (SELECT unnest(range(64)) AS place) p CROSS JOIN n LEFT JOIN u ON u.doc_id = d.doc_id AND u.place = p.place LEFT JOIN mean ON mean.place = p.place),
dense AS (SELECT doc_id, place, CAST(floor(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)) * 1e6 + 0.5) AS BIGINT) AS millionths FROM centred)"""


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vector, method) of all documents by a projection learned from them."""
    docs = table(spark, sf_dir, "documents")
    return embedding.embed(docs, embedding.learn(docs).hook(), "doc_id")


@query(f"WITH {_DENSE_SQL} SELECT doc_id, 'sparse_projection' AS method, CAST(place AS INTEGER) AS place, millionths FROM dense WHERE millionths <> 0")
def dense_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dense(spark, sf_dir).select(F.col("id").alias("doc_id"), "method", F.posexplode("vector").alias("place", "x"))
    return rows.select("doc_id", "method", "place", F.floor(F.col("x") * 1e6 + 0.5).alias("millionths")).where("millionths <> 0")


@query(f"""WITH {_DENSE_SQL}, v AS (SELECT doc_id, list(millionths / 1e6::DOUBLE ORDER BY place) AS v FROM dense GROUP BY doc_id),
s AS (SELECT q.doc_id AS query_id, e.doc_id AS id, {_round_sql("list_cosine_similarity(q.v, e.v)")} AS similarity FROM v q JOIN v e ON q.doc_id <> e.doc_id WHERE q.doc_id % 20 = 0)
SELECT query_id, id, similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INTEGER) AS place FROM s QUALIFY place <= 5""")
def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches of the similarity index over the documents' embeddings; texts without a word take no part."""
    e = stored(_dense(spark, sf_dir).where(F.col("method") == "sparse_projection"), "dense")
    return index.top_k(e, e.where(F.pmod("id", F.lit(20)) == 0), k=5, id_="id", vector="vector")


# Intervals, recoverability, integrity


#: File bytes of an exchange's piece of lines: some tens of times that when sorted, next to another task's.
LINE_BYTES = 4 << 20


def line_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as byte ranges of a candidate: start at the part's key, as long as the quantity."""
    l_ = table(spark, sf_dir, "lineitem")
    return l_.select(F.col("l_orderkey").alias("group"), F.col("l_partkey").alias("begin"), F.col("l_quantity").cast("bigint").alias("length"), F.col("l_linenumber").cast("bigint").alias("id"))


def line_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_intervals(spark, sf_dir)
    return intervals.coverage(lines, buckets=bucket_count(lines, LINE_BYTES)).drop("ranges")


_ISLANDS_SQL = """iv AS (SELECT l_orderkey AS g, l_partkey AS b, l_partkey + CAST(l_quantity AS BIGINT) AS e, CAST(l_linenumber AS BIGINT) AS id FROM lineitem WHERE CAST(l_quantity AS BIGINT) > 0),
f AS (SELECT *, CASE WHEN b <= max(e) OVER (PARTITION BY g ORDER BY b, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM iv),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY g ORDER BY b, e, id) AS island FROM f),
islands AS (SELECT g, min(b) AS b, max(e) AS e, arg_min(id, (b, id)) AS first_id, arg_max(id, (e, id)) AS last_id FROM n GROUP BY g, island)"""
_COVER_SQL = f"""{_ISLANDS_SQL}, raw AS (SELECT l_orderkey AS g, count(*) AS fragments, CAST(sum(greatest(CAST(l_quantity AS BIGINT), 0)) AS BIGINT) AS raw_bytes FROM lineitem GROUP BY 1),
cover AS (SELECT raw.g, fragments, raw_bytes, CAST(sum(e - b) AS BIGINT) AS unique_bytes, count(*) - 1 AS gap_count, max(e) - min(b) AS span_bytes FROM raw JOIN islands USING (g) GROUP BY ALL)"""


@query(f"WITH {_COVER_SQL} SELECT g AS \"group\", fragments, raw_bytes, unique_bytes, raw_bytes - unique_bytes AS overlap_bytes, gap_count, span_bytes - unique_bytes AS gap_bytes, span_bytes FROM cover")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_coverage(spark, sf_dir)


@query(f"WITH {_ISLANDS_SQL} SELECT g AS \"group\", e AS gap_start, nb AS gap_end, nb - e AS gap_length, last_id AS prev_id, nf AS next_id FROM (SELECT *, lead(b) OVER w AS nb, lead(first_id) OVER w AS nf FROM islands WINDOW w AS (PARTITION BY g ORDER BY b)) WHERE nb IS NOT NULL")
def interval_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_intervals(spark, sf_dir)
    return intervals.gaps(intervals.islands(lines, buckets=bucket_count(lines, LINE_BYTES)))


@query("SELECT doc_id, source, CAST(coalesce(sum(strlen(coalesce(text, ''))) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", CAST(strlen(coalesce(text, '')) AS BIGINT) AS length FROM documents")
def image_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("length"))
    return intervals.running_offset(docs, "source", "doc_id", "length").select("doc_id", "source", "offset", "length")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as candidates, with status, message and flags derived from their keys; some count as empty, with gaps known or not."""
    c = line_coverage(spark, sf_dir).withColumnRenamed("group", "order_id")
    k = lambda n: F.pmod("order_id", F.lit(n))
    status = F.when(k(11) == 0, "cluster_only").when(k(7) == 0, "ambiguous").when(k(5) == 0, "validation_failed").otherwise("reconstructed")
    c = c.withColumn("status", status).withColumn("parser_message", F.when(k(10) == 0, "Member CRC check failed").otherwise("ok")).withColumn("ambiguous", F.col("status") == "ambiguous")
    c = c.withColumn("header", k(2) == 0).withColumn("footer", k(3) == 0).withColumn("cluster_confidence", k(101) / 100.0).withColumn("kind", F.when(k(13) == 0, "raw").otherwise("pdf"))
    ok = F.col("status") == "reconstructed"
    c = c.withColumn("confidence", scoring.confidence(F.col("status"), F.col("fragments"), F.col("cluster_confidence"), F.col("ambiguous")))
    actual, gaps = F.when(k(17) == 0, 0).otherwise(F.col("raw_bytes")), F.when(k(34) != 0, F.col("gap_count"))
    c = c.withColumn("completeness", scoring.completeness(actual, gaps, F.col("gap_bytes"), F.col("header"), F.col("footer")))
    c = c.withColumn("validity", scoring.validity(ok, F.col("status"))).withColumn("corruption", scoring.corruption(ok, F.col("status"), F.col("parser_message")))
    return c.withColumn("composite", scoring.composite(F.col("confidence"), F.col("completeness"), F.col("validity"), F.col("corruption")))


_CANDIDATES_SQL = f"""{_COVER_SQL}, c0 AS (SELECT *, g AS order_id, span_bytes - unique_bytes AS gap_bytes, CASE WHEN g % 11 = 0 THEN 'cluster_only' WHEN g % 7 = 0 THEN 'ambiguous' WHEN g % 5 = 0 THEN 'validation_failed' ELSE 'reconstructed' END AS status, (g % 101) / 100.0::DOUBLE AS cc FROM cover),
c1 AS (SELECT *, CASE status WHEN 'cluster_only' THEN 0.10::DOUBLE WHEN 'validation_failed' THEN 0.40::DOUBLE WHEN 'ambiguous' THEN 0.45::DOUBLE ELSE 0.70::DOUBLE END + 0.20::DOUBLE * cc + CASE WHEN fragments = 1 AND status = 'reconstructed' THEN 0.10::DOUBLE ELSE 0::DOUBLE END AS s,
  CASE WHEN g % 17 <> 0 THEN raw_bytes::DOUBLE / (raw_bytes + gap_bytes)::DOUBLE WHEN gap_count = 0 THEN 1.0::DOUBLE ELSE greatest(0.2::DOUBLE, 1::DOUBLE - gap_count * 0.15::DOUBLE) END * (1::DOUBLE - least(0.35::DOUBLE, gap_count * 0.07::DOUBLE)) AS t FROM c0),
c2 AS (SELECT *, least(1.0, greatest(0.0, {_round_sql("CASE WHEN status = 'ambiguous' THEN least(s, 0.45::DOUBLE) * 0.75::DOUBLE ELSE s END")})) AS confidence, least(1.0, greatest(0.0, {_round_sql("CASE WHEN g % 34 = 0 THEN 0.0::DOUBLE WHEN g % 2 = 0 AND g % 3 = 0 AND gap_count = 0 THEN least(1.0, t + 0.05::DOUBLE) ELSE t END")})) AS completeness,
  CASE WHEN status = 'reconstructed' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS validity, CASE WHEN status IN ('cluster_only', 'reconstructed') THEN 0.0::DOUBLE WHEN g % 10 = 0 THEN 0.9::DOUBLE ELSE 0.75::DOUBLE END AS corruption FROM c1),
c AS (SELECT *, {_round_sql("0.25::DOUBLE * confidence + 0.25::DOUBLE * completeness + 0.35::DOUBLE * validity + 0.15::DOUBLE * (1 - corruption)")} AS composite, {_round_sql("unique_bytes / span_bytes::DOUBLE")} AS ratio,
  CASE WHEN status = 'cluster_only' THEN 'UNRECOVERABLE' WHEN status = 'ambiguous' THEN 'AMBIGUOUS' WHEN validity >= 1 AND gap_count = 0 THEN 'FULLY_RECONSTRUCTED' WHEN validity >= 1 THEN 'STRUCTURALLY_VALID_PARTIAL' WHEN g % 13 = 0 THEN 'RAW_BINARY_RECOVERY' WHEN gap_count > 0 THEN 'PARTIALLY_RECONSTRUCTED' ELSE 'STRUCTURALLY_INVALID' END AS recovery_status FROM c2)"""


@query(f"WITH {_CANDIDATES_SQL} SELECT order_id, CAST(confidence AS DOUBLE) AS confidence, CAST(completeness AS DOUBLE) AS completeness, validity, corruption, composite FROM c")
def integrity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("order_id", "confidence", "completeness", "validity", "corruption", "composite")


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    c = c.withColumn("ratio", scoring.recovery_ratio(F.col("unique_bytes"), F.col("gap_bytes")))
    return c.withColumn("recovery_status", scoring.recovery_status(F.col("validity"), F.col("gap_count"), F.col("unique_bytes"), F.col("fragments"), F.col("kind"), F.col("ambiguous"), F.col("status")))


@query(f"WITH {_CANDIDATES_SQL} SELECT order_id, unique_bytes AS recovered_bytes, gap_bytes AS missing_bytes, span_bytes, ratio, recovery_status, recovery_status IN ('FULLY_RECONSTRUCTED', 'STRUCTURALLY_VALID_PARTIAL') AS recovered FROM c")
def recoverability(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assessed(spark, sf_dir)
    return a.select("order_id", F.col("unique_bytes").alias("recovered_bytes"), F.col("gap_bytes").alias("missing_bytes"), "span_bytes", "ratio", "recovery_status", scoring.recovered_ok(F.col("validity"), F.col("recovery_status")).alias("recovered"))


_RECOVERY_REASON_SQL = """CASE WHEN recovery_status = 'UNRECOVERABLE' OR unique_bytes = 0 THEN 'Candidate has no recoverable bytes or fragment members. Structural validation is not possible. Classified as UNRECOVERABLE.'
  ELSE 'Candidate reconstructed from ' || fragments || CASE WHEN fragments = 1 THEN ' fragment. ' ELSE ' associated fragments. ' END || format('{:,}', unique_bytes) || ' bytes were recovered across a ' || format('{:,}', span_bytes) || '-byte observed span. '
  || CASE WHEN gap_bytes > 0 THEN format('{:,}', gap_bytes) || ' bytes remain missing or unknown between associated fragments. ' ELSE 'No internal gaps were observed between associated fragments. ' END
  || CASE WHEN recovery_status = 'RAW_BINARY_RECOVERY' THEN 'File type not structurally validated; preserved as raw binary salvage.' WHEN validity >= 1 THEN kind || ' structural validation succeeded.' ELSE kind || ' structural validation failed (' || message || ').' END
  || ' The candidate is therefore classified as ' || recovery_status || '.' END"""


@query(f"WITH {_CANDIDATES_SQL} SELECT order_id, {_RECOVERY_REASON_SQL} AS reason FROM (SELECT *, CASE WHEN g % 13 = 0 THEN 'RAW' ELSE 'PDF' END AS kind, CASE WHEN g % 10 = 0 THEN 'Member CRC check failed' ELSE 'ok' END AS message FROM c)")
def recovery_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assessed(spark, sf_dir)
    why = scoring.recovery_reason(F.col("fragments"), F.col("unique_bytes"), F.col("span_bytes"), F.col("gap_bytes"), F.col("kind"), F.col("validity"), F.col("recovery_status"), F.col("parser_message"))
    return a.select("order_id", why.alias("reason"))


@query(f"WITH {_CANDIDATES_SQL} SELECT recovery_status, count(*) AS n, {_round_sql('avg(ratio)')} AS mean_ratio, CAST(sum(unique_bytes) AS BIGINT) AS recovered_bytes FROM c GROUP BY 1")
def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(spark, sf_dir).groupBy("recovery_status").agg(F.count("*").alias("n"), profile.round4(F.avg("ratio")).alias("mean_ratio"), F.sum("unique_bytes").cast("bigint").alias("recovered_bytes"))


@query(f"WITH {_CANDIDATES_SQL} SELECT kind, recovery_status, count(*) AS n FROM (SELECT CASE WHEN g % 13 = 0 THEN 'raw' ELSE 'pdf' END AS kind, recovery_status FROM c) GROUP BY ROLLUP (kind, recovery_status)")
def type_state_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(spark, sf_dir).rollup("kind", "recovery_status").agg(F.count("*").alias("n"))



# Reports over ranked candidates


def ranked_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ranked candidates, in the engine's columns; every 19th is sensitive."""
    a = assessed(spark, sf_dir)
    high = F.pmod("order_id", F.lit(19)) == 0
    level, categories = F.when(high, "HIGH").otherwise("NONE"), F.when(high, F.array(F.lit("EMAIL"))).otherwise(F.array().cast("array<string>"))
    score = scoring.priority(F.col("composite"), F.col("ratio"), F.col("validity"), F.col("unique_bytes"), level, F.size(categories), F.col("ambiguous"), F.col("corruption"))
    rows = a.select(
        "order_id", F.col("order_id").cast("string").alias("candidate_id"), F.col("kind").alias("file_type"), "recovery_status", scoring.recovered_ok(F.col("validity"), F.col("recovery_status")).alias("is_successfully_recovered"),
        F.col("unique_bytes").alias("recovered_bytes"), F.col("gap_bytes").alias("missing_bytes"), F.col("ratio").alias("observed_recovery_ratio"), F.col("confidence").alias("reconstruction_confidence"), "completeness",
        F.col("validity").alias("structural_validity"), F.col("corruption").alias("corruption_estimate"), F.col("composite").alias("composite_integrity_score"), score.alias("priority_score"),
    )
    ranked = intervals.global_rank(rows, [F.desc("priority_score"), F.desc("composite_integrity_score"), F.desc("observed_recovery_ratio"), F.desc("recovered_bytes"), F.asc("order_id")])
    # what follows from the key alone is not sorted with the rows
    return ranked.select("*", level.alias("sensitivity_level"), categories.alias("categories"), F.sha2(F.col("order_id").cast("string"), 256).alias("artifact_sha256"))


_RANKED_SQL = f"""{_CANDIDATES_SQL}, scored AS (SELECT *, CAST(g AS VARCHAR) AS candidate_id, CASE WHEN g % 13 = 0 THEN 'RAW' ELSE 'PDF' END AS file_type, g % 19 = 0 AS high, recovery_status IN ('FULLY_RECONSTRUCTED', 'STRUCTURALLY_VALID_PARTIAL') AS good,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, {_round_sql("0.25::DOUBLE * composite + 0.20::DOUBLE * ratio + 0.15::DOUBLE * validity + 0.30::DOUBLE * (CASE WHEN g % 19 = 0 THEN 0.9::DOUBLE ELSE 0::DOUBLE END) + 0.10::DOUBLE * least(1.0::DOUBLE, unique_bytes / 65536.0::DOUBLE) - (CASE WHEN status = 'ambiguous' THEN 0.15::DOUBLE ELSE 0::DOUBLE END) - 0.10::DOUBLE * corruption")})) AS priority FROM c),
ranked AS (SELECT *, row_number() OVER (ORDER BY priority DESC, composite DESC, ratio DESC, unique_bytes DESC, g) AS rank FROM scored)"""


def _places_sql(x: str, n: int) -> str:
    return f"printf('%.{n}f', floor(({x})::DOUBLE * 1e{n} + 0.5 + 1e-7) / 1e{n})"


@query(f"""WITH {_RANKED_SQL}, own AS (SELECT *, CASE WHEN good THEN 'Validated Recoveries' WHEN recovery_status = 'PARTIALLY_RECONSTRUCTED' THEN 'Partial Candidates' WHEN recovery_status = 'RAW_BINARY_RECOVERY' THEN 'Raw Binary Salvage' WHEN recovery_status IN ('STRUCTURALLY_INVALID', 'UNRECOVERABLE') THEN 'Invalid Reconstructions' END AS tab FROM ranked),
t AS (SELECT * FROM own WHERE tab IS NOT NULL UNION ALL SELECT * REPLACE ('All Candidates' AS tab) FROM own)
SELECT tab, candidate_id, file_type, recovery_status AS recovery_state, format('{{:,}} B', unique_bytes) AS recovered, format('{{:,}} B', gap_bytes) AS missing, {_places_sql("ratio * 100", 1)} || '%' AS ratio, CASE WHEN validity >= 1 THEN 'VALID' ELSE 'FAILED' END AS parser,
{_places_sql("composite * 100", 1)} || '%' AS integrity, {_places_sql("priority", 4)} AS priority, substr(sha256(candidate_id), 1, 16) || '...' AS sha256 FROM t""")
def recovered_file_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.file_tables(ranked_orders(spark, sf_dir))


@query(f"""WITH {_RANKED_SQL}, named AS (SELECT *, candidate_id || ' (' || file_type || ')' AS name FROM ranked),
t AS (SELECT count(*) AS n, count(*) FILTER (good) AS ok, count(*) FILTER (recovery_status = 'PARTIALLY_RECONSTRUCTED') AS part, count(*) FILTER (recovery_status IN ('STRUCTURALLY_INVALID', 'UNRECOVERABLE')) AS bad FROM ranked)
SELECT 'summary' AS section, 1::BIGINT AS place, 'observed' AS basis, n || ' candidates: ' || ok || ' recovered, ' || part || ' in part, ' || bad || ' invalid.' AS line FROM t
UNION ALL SELECT 'conclusion', 1, 'observed', ok || ' of ' || n || ' candidates passed their format''s check and can be examined.' FROM t
UNION ALL SELECT 'findings', rank, 'inferred', name || ': ' || recovery_status || ', ' || format('{{:,}}', unique_bytes) || ' bytes found, ' || format('{{:,}}', gap_bytes) || ' missing.' FROM named
UNION ALL SELECT 'integrity', rank, 'inferred', name || ': confidence ' || {_places_sql("confidence", 2)} || ', validity ' || {_places_sql("validity", 2)} || ', completeness ' || {_places_sql("completeness", 2)} || ', corruption ' || {_places_sql("corruption", 2)} || '.' FROM named
UNION ALL SELECT 'attention', rank, 'observed', name || ': ' || CASE WHEN high THEN 'HIGH sensitivity [EMAIL]' ELSE 'NONE sensitivity []' END || ', priority ' || {_places_sql("priority", 4)} || '.' FROM named WHERE high OR priority > 0.5""")
def run_narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The account's sections that follow from the orders; what the caller tells of the evidence is left to the tests."""
    told = reports.narrative_sections(ranked_orders(spark, sf_dir), {}, 0, 0, 0)
    return told.where(~F.col("section").isin("evidence", "limits"))


@query(f"""WITH {_vector_groups_sql(0.66, 4)}, {_RANKED_SQL}, shown AS (SELECT 'candidate' AS kind, rank AS o, candidate_id AS id, lower(file_type) AS file_type, unique_bytes AS bytes, recovery_status AS state, priority AS priority_score FROM ranked WHERE priority >= 0.4
UNION ALL SELECT 'file', 0, candidate_id, lower(file_type), unique_bytes, recovery_status, NULL FROM ranked WHERE priority < 0.4
UNION ALL SELECT 'orphan', id, CAST(id AS VARCHAR), 'vector', 4096, 'ORPHAN', NULL FROM v WHERE id NOT IN (SELECT id FROM labels))
SELECT row_number() OVER (ORDER BY kind, o, id) AS place, kind, id, file_type, CAST(bytes AS BIGINT) AS bytes, state, priority_score FROM shown""")
def run_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of priority 0.4 or more as ranked, all others as found, then the vectors that no cluster holds."""
    # first what needs Python workers: executors' heaps grow with the orders, and hardly shrink
    alone = vector_orphans(spark, sf_dir).select(F.col("id").alias("seq"), "id", F.lit("vector").alias("type_hint"), F.lit(4096).alias("length"))
    ranked = ranked_orders(spark, sf_dir)
    return reports.ranked_or_found(ranked, alone, ranked.where("priority_score >= 0.4"))


@query("""WITH h AS (SELECT page_id, hex(encode(html)) AS h, CAST(strlen(html) AS BIGINT) AS n FROM pages WHERE html <> ''), o AS (SELECT *, unnest(range(0, least(n, 512), 16)) AS o FROM h), p AS (SELECT *, substr(h, 2 * o + 1, 2 * least(16, 512 - o)) AS x FROM o)
SELECT page_id, CAST(o // 16 + 1 AS BIGINT) AS line_no, printf('%08X  %-48s  |%s|', o, trim(regexp_replace(x, '(..)', '\\1 ', 'g')), list_aggregate(list_transform(regexp_extract_all(x, '..'), lambda c: CASE WHEN c BETWEEN '20' AND '7E' THEN chr(CAST('0x' || c AS INTEGER)) ELSE '.' END), 'string_agg', '')) AS line FROM p
UNION ALL SELECT page_id, 33, '... [' || format('{:,}', n - 512) || ' additional bytes truncated for display]' FROM h WHERE n > 512
UNION ALL SELECT page_id, 1, 'Empty data stream (0 bytes).' FROM pages WHERE coalesce(html, '') = ''""")
def hex_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.hex_dump(table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("data")), "page_id")


# Sensitivity


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query(sensitivity.pii_sql("documents", "doc_id"))
def pii_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensitivity.matches(_texts(spark, sf_dir), "pii", keys=("doc_id",))


@query(sensitivity.pii_sql("(SELECT page_id, url || ' ' || html AS text FROM pages)", "page_id"))
def page_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit(" "), "html").alias("text"))
    return sensitivity.matches(pages, "pii", keys=("page_id",))


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A letter about each customer with formatted identifiers made from its key."""
    k = F.col("c_custkey")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    text = F.concat(
        F.lit("Confidential file of "), F.col("c_name"), F.lit(", PAN ABCDE"), pad(F.pmod(k, F.lit(10000)), 4), F.lit("F"),
        F.when(F.pmod(k, F.lit(2)) == 0, F.concat(F.lit(", aadhaar 4"), pad(F.pmod(k, F.lit(1000)), 3), F.lit(" 8901 2345"))).otherwise(""),
        F.when(F.pmod(k, F.lit(3)) == 0, F.concat(F.lit(", mail user"), k.cast("string"), F.lit("@example.org"))).otherwise(""),
        F.when(F.pmod(k, F.lit(4)) == 0, F.concat(F.lit(", phone +91-98765"), pad(F.pmod(k, F.lit(100000)), 5))).otherwise(""),
        F.when(F.pmod(k, F.lit(5)) == 0, F.concat(F.lit(", card 4111-2222-3333-"), pad(F.pmod(k, F.lit(10000)), 4))).otherwise(""),
        F.when(F.pmod(k, F.lit(6)) == 0, F.concat(F.lit(", password: Hidden"), k.cast("string"), F.lit(" and api_key=abcdefghijklmnop"), k.cast("string"))).otherwise(""),
        F.when(F.pmod(k, F.lit(7)) == 0, F.lit(" Bearer abcdefghijklmnopqrstuvwxyz see https://example.org/a/very/long/path/that/goes/on/and/on. Salary and audit report.")).otherwise("."),
    )
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"))


_LETTERS_SQL = """(SELECT c_custkey, 'Confidential file of ' || c_name || ', PAN ABCDE' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || 'F'
 || CASE WHEN c_custkey % 2 = 0 THEN ', aadhaar 4' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || ' 8901 2345' ELSE '' END
 || CASE WHEN c_custkey % 3 = 0 THEN ', mail user' || c_custkey || '@example.org' ELSE '' END
 || CASE WHEN c_custkey % 4 = 0 THEN ', phone +91-98765' || lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') ELSE '' END
 || CASE WHEN c_custkey % 5 = 0 THEN ', card 4111-2222-3333-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') ELSE '' END
 || CASE WHEN c_custkey % 6 = 0 THEN ', password: Hidden' || c_custkey || ' and api_key=abcdefghijklmnop' || c_custkey ELSE '' END
 || CASE WHEN c_custkey % 7 = 0 THEN ' Bearer abcdefghijklmnopqrstuvwxyz see https://example.org/a/very/long/path/that/goes/on/and/on. Salary and audit report.' ELSE '.' END AS text FROM customer)"""


@query(f"{sensitivity.pii_sql(_LETTERS_SQL, 'c_custkey')}\nUNION ALL {sensitivity.keyword_sql(_LETTERS_SQL, 'c_custkey')}")
def derived_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = letters(spark, sf_dir)
    return sensitivity.matches(rows, "pii", keys=("c_custkey",)).unionByName(sensitivity.matches(rows, "keywords", keys=("c_custkey",)))


@query(sensitivity.keyword_sql(_LETTERS_SQL, "c_custkey"))
def keyword_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensitivity.matches(letters(spark, sf_dir), "keywords", keys=("c_custkey",))


def _levels_sql(source: str, key: str) -> str:
    return f"""found AS ({sensitivity.pii_sql(source, key)}
UNION ALL {sensitivity.keyword_sql(source, key)}),
summed AS (SELECT {key}, list_sort(list_distinct(list(category))) AS cats, CAST(sum(occurrence_count) AS BIGINT) AS n, coalesce(sum(occurrence_count) FILTER (category = 'sensitive_keyword'), 0) AS k FROM found GROUP BY 1),
levels AS (SELECT s.{key}, coalesce(n, 0) AS match_count, coalesce(array_to_string(cats, ','), '') AS categories, coalesce(len(cats), 0) AS n_categories, {sensitivity.level_sql("coalesce(cats, [])", "coalesce(k, 0)")} AS sensitivity_level FROM {source} s LEFT JOIN summed USING ({key}))"""


_EXPLAINED_SQL = """CASE WHEN sensitivity_level = 'NONE' OR match_count = 0 THEN 'No sensitive patterns or keywords detected in recovered candidate content. Classified as NONE.'
  ELSE CASE sensitivity_level WHEN 'HIGH' THEN 'High' WHEN 'MEDIUM' THEN 'Medium' ELSE 'Low' END || ' sensitivity classification: Candidate contains ' || match_count || CASE WHEN sensitivity_level = 'LOW' THEN ' general identifier' ELSE ' potential sensitive' END
  || ' pattern match(es) across ' || n_categories || CASE WHEN n_categories = 1 THEN ' category (' ELSE ' categories (' END || replace(categories, ',', ', ') || ')' || CASE WHEN sensitivity_level = 'HIGH' THEN ', indicating potential high-risk identifiers or credentials.' ELSE '.' END END"""


@query(f"WITH {_levels_sql(_LETTERS_SQL, 'c_custkey')} SELECT c_custkey, match_count, categories, sensitivity_level, {_EXPLAINED_SQL} AS sensitivity_explanation FROM levels")
def customer_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensitivity.analyze(letters(spark, sf_dir)).select("c_custkey", "match_count", F.array_join("categories", ",").alias("categories"), "sensitivity_level", "sensitivity_explanation")


@query(f"WITH {_levels_sql('documents', 'doc_id')} SELECT doc_id, match_count, categories, sensitivity_level FROM levels")
def document_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensitivity.analyze(_texts(spark, sf_dir)).select("doc_id", "match_count", F.array_join("categories", ",").alias("categories"), "sensitivity_level")


# Priority


def prioritized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as whole text candidates: sensitivity, integrity, priority."""
    d = sensitivity.analyze(_texts(spark, sf_dir)).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("recovered_bytes"), "sensitivity_level", F.size("categories").alias("n_categories"), F.length(F.coalesce("text", F.lit(""))).alias("chars"), F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")).alias("controls"))
    valid = (F.col("chars") > 0) & (1 - F.col("controls") / F.col("chars") >= 0.70)
    one, zero = F.lit(1.0), F.lit(0.0)
    d = d.withColumn("validity", F.when(valid, 1.0).otherwise(0.0)).withColumn("corruption", F.when(valid, 0.0).otherwise(0.75))
    status = F.when(valid, "reconstructed").otherwise("validation_failed")
    d = d.withColumn("integrity", scoring.composite(scoring.confidence(status, F.lit(1), one, F.lit(False)), F.when(F.col("chars") > 0, one).otherwise(zero), F.col("validity"), F.col("corruption")))
    d = d.withColumn("ratio", F.when(F.col("chars") > 0, one).otherwise(zero))
    return d.withColumn("priority_score", scoring.priority(F.col("integrity"), F.col("ratio"), F.col("validity"), F.col("recovered_bytes"), F.col("sensitivity_level"), F.col("n_categories"), F.lit(False), F.col("corruption")))


_PRIORITY_SQL = f"""{_levels_sql("documents", "doc_id")},
base AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS recovered_bytes, coalesce(text, '') <> '' AND 1 - length(regexp_replace(coalesce(text, ''), '[^\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) / length(coalesce(text, '')) >= 0.70 AS ok, coalesce(text, '') <> '' AS there FROM documents),
p AS (SELECT doc_id, recovered_bytes, sensitivity_level, n_categories, {_round_sql("0.25::DOUBLE * (CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END) + 0.25::DOUBLE * (CASE WHEN there THEN 1 ELSE 0 END) + 0.35::DOUBLE * (CASE WHEN ok THEN 1 ELSE 0 END) + 0.15::DOUBLE * (CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END)")} AS integrity, CASE WHEN there THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ratio, CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS validity,
  least(1.0, {_round_sql("CASE sensitivity_level WHEN 'HIGH' THEN 0.85::DOUBLE WHEN 'MEDIUM' THEN 0.55::DOUBLE WHEN 'LOW' THEN 0.25::DOUBLE ELSE 0::DOUBLE END + least(0.15::DOUBLE, n_categories * 0.05::DOUBLE)")}) AS sens FROM base JOIN levels USING (doc_id)),
r AS (SELECT doc_id, recovered_bytes, sensitivity_level, n_categories, validity, integrity, ratio, greatest(0.0::DOUBLE, least(1.0::DOUBLE, {_round_sql("0.25::DOUBLE * integrity + 0.20::DOUBLE * ratio + 0.15::DOUBLE * validity + 0.30::DOUBLE * sens + 0.10::DOUBLE * least(1.0::DOUBLE, recovered_bytes / 65536.0::DOUBLE) - 0.10::DOUBLE * (CASE WHEN validity >= 1 THEN 0::DOUBLE ELSE 0.75::DOUBLE END)")})) AS priority_score FROM p)"""
_ORDER_SQL = "priority_score DESC, integrity DESC, ratio DESC, recovered_bytes DESC, doc_id"


def _order() -> list[Column]:
    return [F.desc("priority_score"), F.desc("integrity"), F.desc("ratio"), F.desc("recovered_bytes"), F.asc("doc_id")]


@query(f"WITH {_PRIORITY_SQL} SELECT doc_id, sensitivity_level, integrity, priority_score, CASE WHEN priority_score >= 0.7 THEN 'High' WHEN priority_score >= 0.4 THEN 'Medium' ELSE 'Low' END AS priority_label, row_number() OVER (ORDER BY {_ORDER_SQL}) AS rank FROM r")
def priority_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = intervals.global_rank(prioritized(spark, sf_dir), _order())
    return ranked.select("doc_id", "sensitivity_level", "integrity", "priority_score", scoring.priority_label(F.col("priority_score")).alias("priority_label"), "rank")


@query(f"""WITH {_PRIORITY_SQL} SELECT doc_id, CASE WHEN priority_score >= 0.7 THEN 'High' WHEN priority_score >= 0.4 THEN 'Medium' ELSE 'Low' END || printf(' investigative priority (score: %.4f). ', priority_score)
  || CASE WHEN sensitivity_level <> 'NONE' THEN 'Contains ' || sensitivity_level || ' sensitivity data across ' || n_categories || ' category(ies).' ELSE 'Zero sensitive patterns detected.' END
  || CASE WHEN validity >= 1 THEN ' File candidate is structurally valid.' ELSE ' Structural validation failed.' END || printf(' Observed recovery ratio is %.1f%%.', ratio * 100) || CASE WHEN validity >= 1 THEN '' ELSE ' Corruption penalty applied (75.0% estimated corruption).' END AS reason FROM r""")
def priority_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    why = scoring.priority_reason(F.col("priority_score"), F.col("sensitivity_level"), F.col("n_categories"), F.col("validity"), F.col("ratio"), F.lit(False), F.col("corruption"))
    return prioritized(spark, sf_dir).select("doc_id", why.alias("reason"))


@query(f"WITH {_PRIORITY_SQL} SELECT doc_id, sensitivity_level, priority_score FROM r ORDER BY {_ORDER_SQL} LIMIT 20")
def top_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prioritized(spark, sf_dir).orderBy(*_order()).limit(20).select("doc_id", "sensitivity_level", "priority_score")


@query(f"""WITH {_levels_sql("documents", "doc_id")}, f AS (SELECT doc_id FROM levels WHERE sensitivity_level <> 'NONE'), t AS (SELECT doc_id FROM labels WHERE toxic = 1),
n AS (SELECT count(*) FILTER (f.doc_id IS NOT NULL AND t.doc_id IS NOT NULL) AS tp, count(*) FILTER (t.doc_id IS NULL) AS fp, count(*) FILTER (f.doc_id IS NULL) AS fn FROM f FULL JOIN t ON f.doc_id = t.doc_id)
SELECT tp AS true_positive, fp AS false_positive, fn AS false_negative, coalesce({_round_sql("tp / nullif(tp + fp, 0)::DOUBLE")}, 0) AS "precision", coalesce({_round_sql("tp / nullif(tp + fn, 0)::DOUBLE")}, 0) AS recall, coalesce({_round_sql("2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE")}, 0) AS f1 FROM n""")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sensitivity.analyze(_texts(spark, sf_dir)).where("sensitivity_level <> 'NONE'")
    return reports.precision_recall(found, table(spark, sf_dir, "labels").where("toxic = 1"), ["doc_id"])


# Text order


@query("""WITH p AS (SELECT conv_id, turn, text AS a, lead(text) OVER w AS b, lead(turn) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
e AS (SELECT conv_id, turn, a, right(regexp_replace(a, '\\s+$', ''), 1) AS t, substr(regexp_replace(b, '^\\s+', ''), 1, 1) AS h FROM p WHERE nt IS NOT NULL)
SELECT conv_id, turn, 1.0::DOUBLE + CASE WHEN t = '' OR h = '' OR t IS NULL OR h IS NULL THEN 0 WHEN t IN ('.', '!', '?') AND regexp_matches(h, '^\\p{Lu}$') THEN 2.0 WHEN t IN (',', ';', ':') AND regexp_matches(h, '^\\p{Ll}$') THEN 2.0 WHEN regexp_matches(t, '^[\\p{L}\\p{N}]$') AND regexp_matches(h, '^\\p{Ll}$') THEN 2.5 WHEN suffix(a, chr(10)) THEN 1.5 ELSE 0 END AS score FROM e""")
def text_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lead("text").over(by).alias("after"), F.lead("turn").over(by).alias("next_turn")).where("next_turn is not null")
    return c.select("conv_id", "turn", reassemble.transition_column(F.col("text"), F.col("after"), F.col("turn"), F.col("next_turn")).alias("score"))


_RULE_SQL = "CASE WHEN t = '' OR h = '' THEN 0 WHEN t IN ('.', '!', '?') AND regexp_matches(h, '^\\p{Lu}$') THEN 2.0 WHEN t IN (',', ';', ':') AND regexp_matches(h, '^\\p{Ll}$') THEN 2.0 WHEN regexp_matches(t, '^[\\p{L}\\p{N}]$') AND regexp_matches(h, '^\\p{Ll}$') THEN 2.5 WHEN nl THEN 1.5 ELSE 0 END"


@query(f"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(text, '') AS x, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations QUALIFY n <= 6),
g AS (SELECT conv_id, turn, n, right(regexp_replace(x, '\\s+$', ''), 1) AS t, substr(regexp_replace(x, '^\\s+', ''), 1, 1) AS h, suffix(x, chr(10)) AS nl FROM c),
e AS (SELECT conv_id, i, j, CASE WHEN j >= i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + {_RULE_SQL} AS s FROM (SELECT a.conv_id, a.turn AS i, b.turn AS j, a.t, b.h, a.nl FROM g a JOIN g b ON a.conv_id = b.conv_id AND a.turn <> b.turn)),
p(conv_id, n, path, last, score) AS (SELECT conv_id, n, [turn], turn, 0.0::DOUBLE FROM g UNION ALL SELECT p.conv_id, n, list_append(path, j), j, score + s FROM p JOIN e ON e.conv_id = p.conv_id AND e.i = p.last AND NOT list_contains(path, j)),
f AS (SELECT *, count(*) OVER (PARTITION BY conv_id, score) AS ties, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, path DESC) AS place FROM p WHERE len(path) = n)
SELECT conv_id, array_to_string(path, ',') AS turns, score, ties > 1 AS ambiguous FROM f WHERE place = 1""")
def text_order_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pandas as pd

    c = table(spark, sf_dir, "conversations")
    small = c.groupBy("conv_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("turns")).where(F.col("n") <= reassemble.SMALL)

    def order(batches):
        for df in batches:
            rows = []
            for conv, turns in zip(df["conv_id"], df["turns"], strict=True):
                ids = [int(t["turn"]) for t in turns]
                found, score, ties = reassemble.text_order([f"{i:06d}" for i in ids], ids, [t["text"] for t in turns])
                rows.append((conv, [ids[i] for i in found], score, ties > 1))
            yield pd.DataFrame(rows, columns=["conv_id", "turns", "score", "ambiguous"])

    found = small.select("conv_id", "turns").mapInPandas(order, "conv_id long, turns array<long>, score double, ambiguous boolean")
    return found.withColumn("turns", F.array_join(F.transform("turns", lambda x: x.cast("string")), ","))


@query("SELECT conv_id, array_to_string(list(turn ORDER BY turn), ',') AS turns, sha256(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS content_sha256 FROM conversations GROUP BY conv_id HAVING count(*) > 6")
def text_order_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("t")).where(F.size("t") > reassemble.SMALL)
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: x["turn"].cast("string")), ",").alias("turns"), F.sha2(F.array_join(F.col("t.text"), ""), 256).alias("content_sha256"))


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100 AS total FROM events GROUP BY 1, 2")
def event_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.activity(table(spark, sf_dir, "events")).withColumn("total", F.floor(F.col("total") * 100 + 0.5) / 100)


# Streams, as-of joins, agreement, orders


_SESSIONS_SQL = """o AS (SELECT user_id, ts, event_type, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o),
found AS (SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors FROM s GROUP BY user_id, k)"""


@query(f"WITH {_SESSIONS_SQL} SELECT * FROM found")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessions(table(spark, sf_dir, "events"))


@query(f"WITH {_SESSIONS_SQL} SELECT * FROM found WHERE ended < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def streamed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, through duplicates, state and timers: cases that the last watermark closes."""
    found = sessions.drained(sessions.cases(sessions.events_stream(spark, f"{sf_dir}/events.parquet", files=64)), "cases")[0]
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")})


@query("""SELECT e.event_id, e.user_id, e.ts, e.event_type, coalesce(c.event_id, -1) AS view_id, coalesce(c.ts, e.ts) AS view_ts, coalesce(c.value, -1) AS view_value
FROM (SELECT * FROM events WHERE event_type <> 'view') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') c ON e.user_id = c.user_id AND e.ts > c.ts""")
def last_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event that is no view with the last view of its user before it; -1 and its own time where there is none."""
    e = table(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").select("user_id", "ts", "event_id", "value")
    found = asof.asof(e.where("event_type <> 'view'").select("event_id", "user_id", "ts", "event_type"), views, "ts", ("user_id",), {"event_id": "view_id", "ts": "view_ts", "value": "view_value"}, tie="event_id")
    none = {"view_id": F.lit(-1), "view_ts": F.col("ts"), "view_value": F.lit(-1.0)}
    return found.withColumns({c: F.coalesce(F.col(c), v) for c, v in none.items()})


@query("SELECT e.event_id, coalesce(c.event_id, -1) AS error_id, coalesce(CAST(epoch_us(e.ts) - epoch_us(c.ts) AS BIGINT), -1) AS since_us FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') c ON e.ts > c.ts")
def last_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the last error of any user before it: a join without a key."""
    e = table(spark, sf_dir, "events")
    found = asof.asof(e.select("event_id", "ts"), e.where("event_type = 'error'").select("ts", "event_id"), "ts", (), {"event_id": "error_id", "ts": "error_ts"}, tie="event_id")
    since = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("error_ts").cast("timestamp"))
    return found.select("event_id", F.coalesce("error_id", F.lit(-1)).alias("error_id"), F.coalesce(since, F.lit(-1)).alias("since_us"))


def _kendall_sql(rows: str) -> str:
    return f"""WITH r AS (SELECT row_number() OVER () AS i, a, b FROM ({rows}) WHERE a IS NOT NULL AND b IS NOT NULL),
p AS (SELECT sign(x.a - y.a) AS sa, sign(x.b - y.b) AS sb FROM r x JOIN r y ON x.i < y.i),
n AS (SELECT count(*) AS pairs, count(*) FILTER (sa * sb > 0) AS concordant, count(*) FILTER (sa * sb < 0) AS discordant, count(*) FILTER (sa <> 0) AS na, count(*) FILTER (sb <> 0) AS nb FROM p)
SELECT pairs, concordant, discordant, pairs - concordant - discordant AS tied, coalesce({_round_sql("(concordant - discordant) / nullif(sqrt(na::DOUBLE * nb::DOUBLE), 0)")}, 0) AS tau FROM n"""


@query(_kendall_sql("SELECT conv_id * 1000 + turn AS a, CAST(strlen(text) AS BIGINT) AS b FROM conversations"))
def turn_order_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of turns against their length, over all turns as one sequence."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("a"), F.octet_length("text").cast("long").alias("b"))
    return metrics.order_agreement(c, "a", "b")


@query(_kendall_sql("SELECT n_chars AS a, CAST(length(source) * 100 + doc_id % 100 AS BIGINT) AS b FROM documents"))
def document_order_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("n_chars").alias("a"), (F.length("source") * 100 + F.col("doc_id") % 100).cast("long").alias("b"))
    return metrics.order_agreement(d, "a", "b")


@query(f"""WITH {_vector_groups_sql(0.62, 2)}, r AS (SELECT e.label AS t, l.label AS f FROM embeddings e JOIN labels l ON l.id = e.vec_id),
c AS (SELECT t, f, count(*)::DOUBLE AS n FROM r GROUP BY ALL), tn AS (SELECT t, sum(n) AS tn FROM c GROUP BY 1), fn AS (SELECT f, sum(n) AS fn FROM c GROUP BY 1),
x AS (SELECT sum(n * (n - 1) / 2) AS both_, sum(n) AS items, sum(n * n / fn) / sum(n) AS p, sum(n * n / tn) / sum(n) AS r FROM c JOIN tn ON c.t IS NOT DISTINCT FROM tn.t JOIN fn ON c.f IS NOT DISTINCT FROM fn.f),
y AS (SELECT x.*, (SELECT sum(tn * (tn - 1) / 2) FROM tn) AS a, (SELECT sum(fn * (fn - 1) / 2) FROM fn) AS b FROM x),
z AS (SELECT *, a * b / (items * (items - 1) / 2) AS e, (a + b) / 2 AS m FROM y)
SELECT CAST(items AS BIGINT) AS items, {_round_sql("(both_ - e) / (m - e)")} AS adjusted_rand, {_round_sql("p")} AS b3_precision, {_round_sql("r")} AS b3_recall, {_round_sql("2 * p * r / (p + r)")} AS b3_f1 FROM z""")
def vector_cluster_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of vectors against the labels of the embeddings."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("truth"))
    return metrics.cluster_agreement(vector_clusters(spark, sf_dir).join(e, "id"), "truth", "label")


@query(f"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(text, '') AS x, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations QUALIFY n <= 8),
g AS (SELECT conv_id, turn, n, right(regexp_replace(x, '\\s+$', ''), 1) AS t, substr(regexp_replace(x, '^\\s+', ''), 1, 1) AS h, suffix(x, chr(10)) AS nl FROM c),
e AS (SELECT conv_id, i, j, CASE WHEN j >= i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + {_RULE_SQL} AS s FROM (SELECT a.conv_id, a.turn AS i, b.turn AS j, a.t, b.h, a.nl FROM g a JOIN g b ON a.conv_id = b.conv_id AND a.turn <> b.turn)),
p(conv_id, n, path, last, score) AS (SELECT conv_id, n, [turn], turn, 0.0::DOUBLE FROM g UNION ALL SELECT p.conv_id, n, list_append(path, j), j, score + s FROM p JOIN e ON e.conv_id = p.conv_id AND e.i = p.last AND NOT list_contains(path, j)),
f AS (SELECT *, count(*) OVER (PARTITION BY conv_id, score) AS ties, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, path DESC) AS place FROM p WHERE len(path) = n)
SELECT conv_id, array_to_string(path, ',') AS turns, score, ties FROM f WHERE place = 1""")
def text_order_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best order of the turns of every conversation of up to 12, with the number of orders that tie."""
    found = orders.best_orders(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return found.select(F.col("group").alias("conv_id"), F.array_join(F.transform("offsets", lambda x: x.cast("string")), ",").alias("turns"), "score", "ties")


def proposed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders for conversations as an outside model may give them: backwards, some with a turn lost, named twice or unknown, some not at all."""
    c = table(spark, sf_dir, "conversations").where("conv_id is not null").select(F.col("conv_id").alias("group"), F.col("turn").alias("id"))
    k, place = F.col("group") % 5, -F.col("id")
    lost = c.where(~((k == 1) & (F.col("id") == 0)) & (k != 4)).select("group", place.alias("place"), "id")
    twice = c.where((k == 2) & (F.col("id") == 1)).select("group", F.lit(1).cast("long").alias("place"), "id")
    unknown = c.where((k == 3) & (F.col("id") == 0)).select("group", F.lit(2).cast("long").alias("place"), (F.col("id") + 1000).alias("id"))
    return lost.unionByName(twice).unionByName(unknown)


_PROPOSED_SQL = """m AS (SELECT conv_id AS g, turn AS id FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT g, id, -id AS place FROM m WHERE NOT (g % 5 = 1 AND id = 0) AND g % 5 <> 4 UNION ALL SELECT g, id, 1 FROM m WHERE g % 5 = 2 AND id = 1 UNION ALL SELECT g, id + 1000, 2 FROM m WHERE g % 5 = 3 AND id = 0),
v AS (SELECT g, CASE WHEN NOT EXISTS (SELECT 1 FROM o WHERE o.g = k.g) THEN 'no order given'
  WHEN EXISTS (SELECT 1 FROM o WHERE o.g = k.g GROUP BY id HAVING count(*) > 1) THEN (SELECT count(*) FROM (SELECT id FROM o WHERE o.g = k.g GROUP BY id HAVING count(*) > 1)) || ' repeated'
  WHEN EXISTS (SELECT id FROM o WHERE o.g = k.g EXCEPT SELECT id FROM m WHERE m.g = k.g) THEN (SELECT count(*) FROM (SELECT id FROM o WHERE o.g = k.g EXCEPT SELECT id FROM m WHERE m.g = k.g)) || ' unknown'
  WHEN EXISTS (SELECT id FROM m WHERE m.g = k.g EXCEPT SELECT id FROM o WHERE o.g = k.g) THEN (SELECT count(*) FROM (SELECT id FROM m WHERE m.g = k.g EXCEPT SELECT id FROM o WHERE o.g = k.g)) || ' missing' ELSE '' END AS reason FROM (SELECT DISTINCT g FROM m) k)"""


@query(f"WITH {_PROPOSED_SQL} SELECT g AS conv_id, reason = '' AS accepted, reason FROM v")
def order_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "conversations").where("conv_id is not null").select(F.col("conv_id").alias("group"), F.col("turn").alias("id"))
    return orders.divided(proposed_orders(spark, sf_dir), members).withColumnRenamed("group", "conv_id")


@query(f"""WITH {_PROPOSED_SQL}, x AS (SELECT o.g, o.id, o.place AS pos FROM o JOIN v ON v.g = o.g AND reason = '' UNION ALL SELECT m.g, m.id, m.id FROM m JOIN v ON v.g = m.g AND reason <> '')
SELECT g AS conv_id, id AS turn, row_number() OVER (PARTITION BY g ORDER BY pos, id) AS place FROM x""")
def external_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in the proposed order where it names each once, else as they stand."""
    members = table(spark, sf_dir, "conversations").where("conv_id is not null").select(F.col("conv_id").alias("group"), F.col("turn").alias("id"), F.col("turn").alias("offset"))
    return orders.external_order(proposed_orders(spark, sf_dir), members).select(F.col("group").alias("conv_id"), F.col("id").alias("turn"), "place")


# Files and images made of the documents


#: Letters of a document's text and hash (sources/fixtures.py), by which the sizes of files go.
_LETTERS = "docs AS (SELECT doc_id, 64 + 2 * CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents)"
_KIND_SQL = f"""files AS (SELECT doc_id, n, list_extract({list(fixtures.KINDS)}, CAST(doc_id % {len(fixtures.KINDS)} AS INTEGER) + 1) AS kind, doc_id // {len(fixtures.KINDS)} % 2 = 1 AS damaged FROM docs)"""
_JPEG, _ZIP = 136, 30 + 5 + 46 + 5 + 22  # bytes around the letters: headers and the end; headers, directory and end with a name of five
#: By kind: validity and state of a whole and of a damaged file.
_VERDICTS = ", ".join(f"('{k}', {v}, '{s}', {w}, '{t}')" for k, v, s, w, t in (
    *((k, True, "STRUCTURALLY_VALID", False, "STRUCTURALLY_INVALID") for k in ("jpeg", "png", "gif", "bmp", "pdf", "text")), *((k, True, "COMPLETE_ARCHIVE", False, "STRUCTURALLY_INVALID") for k in ("zip", "docx", "tar", "bz2")),
    *((k, True, "COMPLETE_ARCHIVE", True, "PARTIAL_ARCHIVE") for k in ("7z", "rar", "gz")), *((k, True, "STRUCTURALLY_VALID", True, "STRUCTURALLY_VALID") for k in ("wav", "sqlite")),
))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


_CARVED_SQL = f"""images AS (SELECT doc_id, 'doc_' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS source, doc_id % 3 = 1 AS torn, n + {_JPEG} AS j, n + {_ZIP} AS z FROM docs),
carved AS (SELECT doc_id, source, 1 AS k, 64 AS o, CASE WHEN torn THEN {fixtures.TORN} ELSE j END AS length, 'jpeg' AS kind, true AS header, NOT torn AS footer, CASE WHEN torn THEN 'disrupted_jpeg_64' END AS grp FROM images
UNION ALL SELECT doc_id, source, 2, 64 + {fixtures.TORN} + 128, j - {fixtures.TORN}, 'jpeg', false, true, 'disrupted_jpeg_64' FROM images WHERE torn
UNION ALL SELECT doc_id, source, CASE WHEN torn THEN 3 ELSE 2 END, 64 + j + CASE WHEN torn THEN 128 ELSE 0 END + 64, z, 'zip', true, true, NULL FROM images)"""


@query(f"WITH {_LETTERS}, {_CARVED_SQL} SELECT source, 'F' || lpad(CAST(k AS VARCHAR), 4, '0') AS id, CAST(o AS BIGINT) AS \"offset\", length, kind AS type_hint, header AS header_flag, footer AS footer_flag, grp AS group_id FROM carved")
def carve_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = fixtures.text_images(_documents(spark, sf_dir))
    return carve.carve(ev.chunked(images)).select("source", "id", "offset", "length", "type_hint", "header_flag", "footer_flag", "group_id")


@query(f"WITH {_LETTERS}, {_KIND_SQL} SELECT doc_id, kind, CASE WHEN damaged THEN w ELSE v END AS valid, CASE WHEN damaged THEN t ELSE s END AS state FROM files JOIN (VALUES {_VERDICTS}) AS x(kind, v, s, w, t) USING (kind)")
def validate_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fixtures.wrapped_texts(_documents(spark, sf_dir))
    return files.withColumn("v", formats.validate_format("kind", "data")).select(F.col("id").alias("doc_id"), "kind", "v.valid", "v.state")


# Damaged archives: a ZIP without its directory's end still has members; a 7z file lacks the last 20 bytes of its packed size, header and 32 bytes before
@query(f"""WITH {_LETTERS}, {_KIND_SQL}
SELECT doc_id, kind, CASE WHEN damaged THEN 'PARTIAL_ARCHIVE' ELSE 'COMPLETE_ARCHIVE' END AS state, CASE kind WHEN 'zip' THEN 'a.txt,b.txt' WHEN 'docx' THEN '[Content_Types].xml,word/document.xml' WHEN 'tar' THEN 'a.txt' WHEN 'rar' THEN 'note.txt' ELSE '' END AS members,
  CASE WHEN kind = '7z' AND damaged THEN {_round_sql("(n + 20) / (n + 40)::DOUBLE")} ELSE 1.0::DOUBLE END AS completeness, 0::INTEGER AS nested
FROM files WHERE kind IN ('zip', 'docx', 'tar', '7z', 'rar', 'gz', 'bz2') AND NOT (damaged AND kind IN ('tar', 'bz2'))""")
def archive_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fixtures.wrapped_texts(_documents(spark, sf_dir)).withColumn("v", formats.validate_archive("data")).where("v.state <> 'STRUCTURALLY_INVALID'")
    return found.select(F.col("id").alias("doc_id"), "kind", "v.state", F.array_join("v.members", ",").alias("members"), "v.completeness", F.size(formats.nested_archives("data")).alias("nested"))


# The ZIP begins after one header of 512 bytes and is filled up to blocks of 512; the next header is the rest of the tar.
# A ZIP's end is looked for in the last 65,557 bytes: beyond a longer rest of the tar (blocks, two empty ones, records of 10,240) only its members are found
@query(f"""WITH {_LETTERS} SELECT CAST(doc_id AS VARCHAR) AS parent_id, 512::BIGINT AS "offset", 'zip' AS format, CASE WHEN ceil((2048 + ceil((n + {_ZIP}) / 512.0) * 512 + ceil(n / 512.0) * 512) / 10240.0) * 10240 - 512 - (n + {_ZIP}) > 65535 THEN 'VALID_MEMBER_ONLY' ELSE 'COMPLETE_ARCHIVE' END AS state FROM docs
UNION ALL SELECT CAST(doc_id AS VARCHAR), CAST(512 + ceil((n + {_ZIP}) / 512.0) * 512 AS BIGINT), 'tar', 'COMPLETE_ARCHIVE' FROM docs""")
def nested_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.nested(fixtures.text_boxes(_documents(spark, sf_dir))).select("parent_id", "offset", "format", "state")


@query("SELECT 'cluster_' || CASE WHEN doc_id < 100 THEN lpad(CAST(doc_id AS VARCHAR), 3, '0') ELSE CAST(doc_id AS VARCHAR) END AS cluster_id, 'bz2' AS file_type, 'F0003,F0001,F0002' AS fragment_ids, 'reconstructed' AS status, 1.0::DOUBLE AS structural_validity, false AS ambiguous, 'COMPLETE_ARCHIVE' AS archive_state, true AS used_all_fragments FROM documents")
def archive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reassemble.reassemble(fixtures.text_thirds(_documents(spark, sf_dir)))
    return found.withColumn("fragment_ids", F.array_join("fragment_ids", ",")).drop("content", "parser_message")


# Of whole files (validity 1, no gap): integrity 1, priority 0.60 + 0.10 * bytes / 65536, at most 0.10.  Of torn ones the cluster's confidence is its floor, 0.1
@query(f"""WITH {_LETTERS}, {_CARVED_SQL},
f AS (SELECT dense_rank() OVER (ORDER BY source) AS no, min(k) AS k, kind, string_agg('F' || lpad(CAST(k AS VARCHAR), 4, '0'), ',' ORDER BY k) AS ids, CAST(sum(length) AS BIGINT) AS size, CASE WHEN count(*) > 1 THEN 128 ELSE 0 END AS gap FROM carved GROUP BY source, kind, coalesce(grp, CAST(k AS VARCHAR))),
g AS (SELECT *, {_round_sql("size / (size + gap)::DOUBLE")} AS ratio, CASE WHEN gap = 0 THEN 1.0::DOUBLE ELSE {_round_sql("0.25::DOUBLE * 0.72::DOUBLE + 0.25::DOUBLE * " + _round_sql("size / (size + gap)::DOUBLE * 0.93::DOUBLE") + " + 0.5::DOUBLE")} END AS integrity FROM f),
s AS (SELECT *, {_round_sql("0.25::DOUBLE * integrity + 0.20::DOUBLE * ratio + 0.15::DOUBLE + 0.10::DOUBLE * least(1.0::DOUBLE, size / 65536.0::DOUBLE)")} AS priority, 'recon_cluster_' || no || '_' || lpad(CAST(k AS VARCHAR), 4, '0') AS cid FROM g)
SELECT row_number() OVER (ORDER BY priority DESC, integrity DESC, ratio DESC, size DESC, cid) AS rank, cid AS candidate_id, kind AS file_type, ids AS fragment_ids, size AS recovered_bytes, CAST(gap AS BIGINT) AS missing_bytes, CASE gap WHEN 0 THEN 'FULLY_RECONSTRUCTED' ELSE 'STRUCTURALLY_VALID_PARTIAL' END AS recovery_status,
  integrity AS composite_integrity_score, 'NONE' AS sensitivity_level, priority AS priority_score, 'validated/recovered_' || cid || CASE kind WHEN 'jpeg' THEN '.jpg' ELSE '.zip' END AS artifact_path FROM s""")
def recovered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole engine over an image of each document."""
    e = Engine(spark, fixtures.text_images(_documents(spark, sf_dir)))
    return e.run().select("rank", "candidate_id", "file_type", F.array_join("fragment_ids", ",").alias("fragment_ids"), "recovered_bytes", "missing_bytes", "recovery_status", "composite_integrity_score", "sensitivity_level", "priority_score", "artifact_path")


@query(f"""WITH {_LETTERS}, {_KIND_SQL}, z AS (SELECT * FROM files WHERE kind = 'zip' AND NOT damaged)
SELECT CAST(doc_id AS VARCHAR) AS name, 'a.txt' AS entry, 1::INTEGER AS position, n AS size, 'member' AS detail FROM z UNION ALL SELECT CAST(doc_id AS VARCHAR), 'b.txt', 2, 64, 'member' FROM z
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'note', 1, 1, 'CREATE TABLE note (id INTEGER, body TEXT)' FROM files WHERE kind = 'sqlite' AND NOT damaged""")
def content_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fixtures.wrapped_texts(_documents(spark, sf_dir)).where("kind in ('zip', 'sqlite') and not damaged")
    return reports.listings(files.select(F.col("id").cast("string").alias("name"), "kind", "data"), "name", "kind", "data")


@query("""WITH k AS (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey AS order_id, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE floor(q / (l_orderkey % 200 + 1.0::DOUBLE) * 1e4 + 0.5 + 1e-7) / 1e4 END AS logical_recovery_ratio,
  least(1.0::DOUBLE, greatest(0.0::DOUBLE, floor(q / greatest(q, l_orderkey % 200 + 1)::DOUBLE * 1e4 + 0.5 + 1e-7) / 1e4)) AS expected_completeness FROM k""")
def expected_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as candidates whose original size is known, or not."""
    k = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.sum("l_quantity").cast("bigint").alias("q"))
    size, zero, no = F.pmod("order_id", F.lit(200)) + 1, F.lit(0), F.lit(False)
    known = F.when(F.pmod("order_id", F.lit(3)) != 0, size)
    return k.select("order_id", scoring.logical_ratio(F.col("q"), known).alias("logical_recovery_ratio"), scoring.completeness(F.col("q"), zero, zero, no, no, expected=size).alias("expected_completeness"))


FLAGSHIP = priority_rank
