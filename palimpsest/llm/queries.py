"""The queries of the training-data operators, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, digest, langid, licenses, lm, mixing, negatives, quality, simhash, substring, suffix, tries
from .common import fold, id_text, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def language_model(docs: DataFrame):
    """Learned from text and language of all documents but those of fold 2 of 4."""
    return langid.learn(docs.where(fold(F.col("doc_id"), 4).isin(0, 1, 3)))


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(id_text(docs), *language_model(docs)).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_rare_seed_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=2)


def op4_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.with_edits(table(spark, sf_dir, "documents"))


def op5_log_bilinear_nce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 10) == 0)


def op6_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_attention_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) > 0))
    return quality.score(docs, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op8_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_suffix_merge_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_digests(table(spark, sf_dir, "documents"), window=200)


def op10_prefix_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_digests(table(spark, sf_dir, "documents"), window=50)


def op11_voronoi_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = e.select("vec_id", label.alias("label"), negatives.quantized(F.col("embedding")).alias("embedding"))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=5, band=(80, 100))


def op12_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, cap=2.0)
    return mix.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op13_louds_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.nodes(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_language_mixture, op2_rare_seed_alignment, op3_simhash_tiles, op4_quartile_digest, op5_log_bilinear_nce, op6_license_digests, op7_attention_passages, op8_bpe_prefix_dp, op9_suffix_merge_sort, op10_prefix_suffix_trees, op11_voronoi_negatives, op12_cube_mixing, op13_louds_trie)}
ORACLE_SQL: dict[str, str] = {"op6_license_digests": licenses.oracle_sql(), "op11_voronoi_negatives": negatives.oracle_sql(), "op13_louds_trie": tries.oracle_sql()}
