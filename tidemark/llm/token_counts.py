"""Token counts with a digest cache.

Contents are normalised (runs of ASCII white space become one space, ends trimmed:
the tokenizer drops white space, so counts do not change) and digested.  Digests and
the tokenizer's version are joined to stored counts; only distinct misses are encoded,
and their counts are appended to the cache, a Parquet folder.

Edge cases: a null text counts as empty (0 tokens, 0 bytes) and is flagged
``over_limit = false``; repeated rows each get a row; columns besides ``doc_id`` and
``text`` are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Distinct chunks a worker remembers in each of two generations.
MEMO = 400_000
#: Longer chunks are encoded but not remembered.
LONGEST = 64
CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens bigint"


def tokenizer_version(name: str) -> str:
    """The first 32 hex digits of the vocabulary file's SHA-256."""
    with open(public_tokenizers.path(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:32]


@lru_cache(maxsize=2)
def _loaded(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name)), shared.TwoGenerations(MEMO)


def _counts(name: str, texts: list[bytes]) -> list[int]:
    """The tokenizer splits at white space before anything else, so a text's count is the sum over its chunks."""
    tokenizer, memo = _loaded(name)
    chunks: list[bytes] = []
    ends = []
    for t in texts:
        chunks += t.split()
        ends.append(len(chunks))
    got = memo.get_all(chunks)
    missing = list({c for c, v in zip(chunks, got) if v is None})
    if missing:
        new = [len(e) for e in tokenizer.encode_batch_fast([c.decode() for c in missing], add_special_tokens=False)]
        short = [i for i, c in enumerate(missing) if len(c) <= LONGEST]
        memo.put([missing[i] for i in short], [new[i] for i in short])
        fresh = dict(zip(missing, new))
        got = [fresh[c] if v is None else v for c, v in zip(chunks, got)]
    out, a = [], 0
    for b in ends:
        out.append(sum(got[a:b]))
        a = b
    return out


def normalised(text: str = "text"):
    return F.trim(F.regexp_replace(shared.text_or_empty(text), "[\\x20\\x09-\\x0D]+", " "))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, digest`` for every row of ``docs``.

    ``cache`` names the Parquet folder of stored counts, created when missing; by
    default a new one in the shared folder.
    """
    spark = docs.sparkSession
    shared.prepare_python(spark)
    version = tokenizer_version(tokenizer)
    cache = cache or shared.new_path(spark, "token-cache")
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    fresh = not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    if fresh:
        spark.createDataFrame([], CACHE_SCHEMA).write.parquet(cache)
    stored = lambda: spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)

    content = docs.select(normalised().alias("content")).withColumn("digest", F.unhex(F.sha2("content", 256)))
    # left anti before the grouping: known contents are not moved; equal contents meet in the map-side combine
    misses = content.join(stored().select("digest"), "digest", "left_anti").groupBy("digest").agg(F.first("content").alias("content"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _counts(tokenizer, [t.encode() for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.binary()), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], ["digest", "tokenizer", "n_tokens"])

    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)

    # In an older cache a digest may stand twice (two writers at once); either row will do.  The join meets a
    # plain table, so that Spark can split the rows of a very frequent content.
    known = stored().select("digest", "n_tokens")
    if not fresh:
        known = shared.materialise(known.groupBy("digest").agg(F.first("n_tokens").alias("n_tokens")), "token-counts")
    rows = docs.select("doc_id", F.octet_length(shared.text_or_empty()).cast("long").alias("n_bytes"), F.unhex(F.sha2(normalised(), 256)).alias("digest"))
    return rows.join(known, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.lower(F.hex("digest")).alias("digest"))
