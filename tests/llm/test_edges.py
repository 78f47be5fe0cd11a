"""Every operator and stage on awkward tables: nulls, repeated and very long rows, clashing columns, no rows."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, exact_dedup, language_id, minhash, pii, sharding, suffix_dedup, token_counts

DATA = "/root/testdata/sf0.001"
PASSAGE = "seven quick foxes jumped over the very lazy dog today and then went home to rest for a while before the next long day began"
ROWS = [(1, PASSAGE), (1, PASSAGE), (1, "another text"), (2, None), (2, ""), (None, PASSAGE), (None, None), (3, "mail bob@example.org, " * 8000 + "end"), (4, "é" * 150_000), (5, " \n\t "), (6, PASSAGE + " tail")]
CLASHING = "digest rank n_tokens spans component_id slot key first second known lo d t _nth nil doc gram bucket root items kind found listed stretch at term n_term entity".split()


@pytest.fixture(scope="module")
def model(spark):
    return language_id.learn(spark.read.parquet(f"{DATA}/documents.parquet"))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (None, PASSAGE), (2, None), (3, ""), (4, "é" * 1000)], "item_id bigint, text string").withColumn("window", F.lit(1))


def table(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string").repartition(3).select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


OPERATORS = {
    "op1": lambda d, m, b: token_counts.count_tokens(d, "word_bpe_49k.json"),
    "op3": lambda d, m, b: language_id.predict(d, m),
    "op4": lambda d, m, b: pii.find(d),
    "op5": lambda d, m, b: minhash.near_groups(d),
    "op6": lambda d, m, b: decontam.decontaminate(d, b),
    "op7": lambda d, m, b: bpe.encode_digests(d, "byte_bpe_50k.json"),
    "op8": lambda d, m, b: suffix_dedup.removed_digests(d),
    "op9": lambda d, m, b: exact_dedup.exact_groups(d),
    "op10": lambda d, m, b: sharding.shard(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(spark, model, bench, name):
    run, docs = OPERATORS[name], table(spark)
    got = run(docs, model, bench).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in ROWS)
    if name == "op10":
        assert len({(r["shard"], r["slot"]) for r in got}) == len(ROWS)
    else:
        # rows that are equal have equal results, but that op9 keeps one row of them
        fields = [i for i, c in enumerate(got[0].__fields__) if (name, c) != ("op9", "kept")]
        assert len({tuple(str(r[i]) for i in fields) for r in got if r["doc_id"] == 1}) <= 2
    assert run(docs.where("false"), model, bench).count() == 0


def test_every_stage_keeps_columns(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame([(d, x, "en", "s", len(x or "")) for d, x in ROWS], documents.schema)
    for docs in (documents.limit(30).unionByName(extra).withColumn("digest", F.lit(1)), documents.where("false")):
        n = docs.count()
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, DATA)
            kept = out.count()
            assert kept == n if name == "bpe" else kept <= n
            assert name == "bpe" or out.columns == docs.columns
    # what each stage does with rows that share an id, or have none
    ids = lambda df: Counter(r["doc_id"] for r in df.collect())
    stages = dict(pipeline.STAGES)
    assert ids(stages["exact_dedup"](spark, extra, DATA))[1] == 2
    near = stages["near_dedup"](spark, extra, DATA)
    assert ids(near)[None] == 2 and ids(near)[6] in (0, 1)
    empty = {r["doc_id"] for r in stages["language_id"](spark, extra, DATA).collect()}
    assert 2 not in empty and 5 not in empty and 1 in empty
