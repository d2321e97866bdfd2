"""A training corpus from ``documents``: five stages, each an operator of ``palimpsest.llm``.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the
columns of ``documents``; the last returns the encoded documents.  ``run`` writes
every stage as Parquet in the shared folder and reads it for the next, so a lost
executor never costs more than the stage at work.

In every stage columns other than doc_id, text, lang and n_chars pass as they are,
whatever their names; a null doc_id is a document of its own that comes after all
others; rows with one doc_id are documents of their own; a table without rows stays
without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, decontam, langid, simhash, substring
from palimpsest.llm.common import stored, table
from palimpsest.llm.queries import tokenizer_path
from palimpsest.session import ship

#: Bits: of copies with one word changed in 100 to 2,000, 0.755 are within 2 bits, 0.935 within 4, 0.988 within 6 (400 made-up texts).
#: Unrelated texts are that near with a probability of 5e-12 a pair.
NEAR_BITS = 6


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that mixture inference can name; null and empty texts and texts without a letter go."""
    return langid.predict(docs, *langid.learn(docs), keep="known")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group linked by SimHash fingerprints; of repeated rows one."""
    return simhash.one_of_each(docs, radius=NEAR_BITS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words or more that a smaller doc_id has; n_chars follows the text.

    A text that loses nothing, a null one too, stays as it is; of equal texts all but the first lose all."""
    return substring.remove(docs, window=50).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, neither copied nor edited; null and empty texts hold none."""
    return decontam.without(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; a null text is empty."""
    return bpe.encode_digests(docs, tokenizer_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_leaks", benchmark_leaks), ("encoded", encoded)]

#: Components, mixtures and alignments are beyond SQL.  tests/llm hold brute-force versions: of language and benchmark_leaks as
#: stages, of the others as the operators that they are.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
