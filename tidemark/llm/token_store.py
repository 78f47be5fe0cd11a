"""Token ids in ORC files, in the order of document ids.

Layout below one path: ``ids`` holds a row a document (``part, doc_id, pos, n_tokens, ids``),
``manifest`` a row a file (``part, base, n_docs, n_tokens, first_id, last_id``).  Ids are integer
lists in ORC's run-length encoding; stripes are the unit that tasks read, a row index every
``STRIDE`` rows and Bloom filters on ``doc_id`` let a reader skip what it does not look for.

Texts are range-partitioned by doc_id before they are encoded, so that nothing is encoded twice,
and sorted there; a task encodes its range in order and knows how many ids its file holds before
each document (``pos``).  A document's place in the whole stream is its file's ``base`` plus
``pos``.  The manifest has as many rows as there are files, which is the session's number of
shuffle partitions; it alone passes the driver.

Edge cases: a null text counts as empty (only the end id); null doc_ids come first; rows with one
doc_id are ordered by a 64-bit digest of the text, and equal rows each have a place; columns
besides ``doc_id`` and ``text`` are ignored; an empty table gives a store without documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .bpe import PLAIN, Codec, codec

END = 2
STRIPE, STRIDE = 16 << 20, 1000
ROWS = "part int, doc_id bigint, pos bigint, n_tokens bigint, ids array<int>"
MANIFEST = "part int, base bigint, n_docs bigint, n_tokens bigint, first_id bigint, last_id bigint"
PLACES = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def _encoded(c: Codec, raw: np.ndarray) -> bytes:
    """Little-endian ids of one text: by the ranked form of the vocabulary where all engines agree on it, else fragment by fragment."""
    text = raw.tobytes().decode()
    if c.fast and PLAIN.fullmatch(text) and not any(m in text for m in c.marks):
        return np.array(c.fast(text), "<u4").tobytes()
    return b"".join([p[0] for p in c.encode_fragments(c.fragments(raw))])


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    """Encodes every text, appends ``end``, writes files and manifest."""
    spark = docs.sparkSession
    shared.prepare_python(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("digest", F.xxhash64("text"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, part, pos = codec(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, raw, bounds in shared.text_blocks(batch.column(1)):
                ids = [_encoded(c, raw[s:e]) + last for s, e in zip(bounds[:-1], bounds[1:])]
                sizes = np.array([len(x) >> 2 for x in ids], np.int64)
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, part, np.int32)), batch.column(0).slice(a, b - a), pa.array(pos + ends - sizes), pa.array(sizes), lists], ["part", "doc_id", "pos", "n_tokens", "ids"])
                pos += int(ends[-1])

    options = {"compression": "zstd", "orc.stripe.size": STRIPE, "orc.row.index.stride": STRIDE, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": 0.01, "orc.rows.between.memory.checks": 100}
    rows.mapInArrow(run, ROWS).write.options(**options).orc(f"{path}/ids")
    each = _rows(spark, path).groupBy("part").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    files, base, out = sorted(each.collect()), 0, []  # a row a file
    for r in files:
        out.append((r["part"], base, r["n_docs"], r["n_tokens"], r["first_id"], r["last_id"]))
        base += r["n_tokens"]
    spark.createDataFrame(out, MANIFEST).coalesce(1).write.orc(f"{path}/manifest")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROWS).orc(f"{path}/ids")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).orc(f"{path}/manifest")


def _based(rows: DataFrame, path: str) -> DataFrame:
    bases = manifest(rows.sparkSession, path).select(F.col("part").alias("file"), "base")
    return rows.join(F.broadcast(bases), F.col("part") == F.col("file")).withColumn("start", F.col("base") + F.col("pos"))  # a row a file


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``, stripe by stripe."""
    return _based(_rows(spark, path), path).select("doc_id", "start", "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few documents: stripes and row groups are skipped by their bounds and Bloom filters."""
    return read(spark, path).where(F.col("doc_id").isin(doc_ids))


def window(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """``start, ids``: the parts of documents that lie in places ``first`` .. ``last - 1`` of the stream; files outside are skipped by the manifest."""
    files = [r for r in manifest(spark, path).collect() if r["base"] < last and r["base"] + r["n_tokens"] > first]
    reach = F.lit(False)
    for r in files[:1] + files[-1:]:  # only the outermost files are cut
        reach = reach | (F.col("part") == r["part"]) & (F.col("pos") < last - r["base"]) & (F.col("pos") + F.col("n_tokens") > first - r["base"])
    if len(files) > 2:
        reach = reach | F.col("part").between(files[1]["part"], files[-2]["part"])
    rows = _based(_rows(spark, path).where(reach), path)
    skip = F.greatest(F.lit(first) - F.col("start"), F.lit(0))
    upto = F.least(F.lit(last) - F.col("start"), F.col("n_tokens"))
    return rows.select((F.col("start") + skip).alias("start"), F.slice("ids", (skip + 1).cast("int"), (upto - skip).cast("int")).alias("ids"))


def places(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""
    shared.prepare_python(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            bounds = lists.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(bounds).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _based(_rows(spark, path), path).select("doc_id", "start", "ids").mapInArrow(run, PLACES)
