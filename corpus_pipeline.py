"""Five stages from raw documents to token ids, each one operator of ``tidemark.llm``.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame.  All but the last return the columns of ``docs``, whatever others it brings along;
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontam, exact_dedup, language_id, minhash, shared

#: Documents whose best language has a smaller share of the text go.
LEAST_SCORE = 0.4
TOKENIZER = "byte_bpe_50k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts that no language has ``LEAST_SCORE`` of."""
    return language_id.keep_identified(docs, language_id.learn(docs), LEAST_SCORE)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal without white space the longest stays, then the smallest doc_id; null and empty texts are one group, and a null doc_id comes last."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity 0.8 or more; the smallest doc_id of a group stays, once.  Texts without words are linked with nothing; rows without a doc_id stay."""
    return minhash.keep_one(docs, words=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are judged by their own texts, those without a doc_id or with a shared one too; null and empty texts are clean."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row; a null text counts as empty."""
    return bpe.encode_digests(docs, TOKENIZER)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", encode),
]

#: Forward-backward, MinHash and BPE are beyond SQL; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.materialise(stage(spark, docs, sf_dir), name)
        shared.drop_held(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
