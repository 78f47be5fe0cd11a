"""Canonical JSON and content hashes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import importable


def canonical_json(value) -> str:
    """Sorted keys, no blanks, raw UTF-8; whole floats are written without a fraction."""

    def plain(v):
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        if isinstance(v, float):
            if v != v or v in (float("inf"), float("-inf")):
                return None
            return int(v) if v.is_integer() and abs(v) < 1e21 else v
        return v

    return json.dumps(plain(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def canonical_hash(value) -> str:
    return sha256(canonical_json(value))


def json_string(c: Column) -> Column:
    """A JSON string literal of a text column."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit('"'))


def json_numbers(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("]"))


def entry_id(draw_id: Column, strategy: Column, frozen_at: Column) -> Column:
    return F.sha2(F.concat(F.lit('{"drawId":'), json_string(draw_id), F.lit(',"frozenAt":'), json_string(frozen_at), F.lit(',"strategyId":'), json_string(strategy), F.lit("}")), 256)


def chain_hash(content: Column, previous: Column) -> Column:
    """Of an event's canonical content and the hash before it (GENESIS for the first)."""
    return F.sha2(F.concat(content, F.lit("|"), F.coalesce(previous, F.lit("GENESIS"))), 256)


def draw_json(date: Column, draw_id: Column, result: Column, process_time: Column | None = None) -> Column:
    """One line: date, id, result, and process_time where there is one."""
    parts = [F.lit('{"date":'), json_string(date), F.lit(',"id":'), json_string(draw_id), F.lit(',"result":'), json_numbers(result)]
    if process_time is not None:
        parts.append(F.coalesce(F.concat(F.lit(',"process_time":'), json_string(process_time)), F.lit("")))
    return F.concat(*parts, F.lit("}"))


#: Lines of one partition that is sent to the driver.
LINES = 200_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a batch, each with its newline, as one piece."""
    for batch in batches:
        lines = batch.column(0)
        if lines.null_count:
            raise ValueError("a line is null")
        ended = pc.binary_join_element_wise(lines.cast(pa.string()), "", "\n")
        yield pa.RecordBatch.from_arrays([pa.array([ended.buffers()[2].to_pybytes()[: pc.sum(pc.binary_length(ended)).as_py() or 0]], pa.binary())], ["piece"])


def dataset_hash(lines: DataFrame) -> str:
    """SHA-256 over all lines in order, each with its newline; ``lines`` has ``t, line``.

    A single SHA-256 is sequential.  Tasks put ranges of ``t`` in order and join their lines to pieces, which are held on the
    executors' disks and stream through the driver, one partition at a time.
    """
    spark = lines.sparkSession
    importable(spark)
    n, low, high = lines.agg(F.count(F.lit(1)), F.coalesce(F.min("t"), F.lit(0)), F.coalesce(F.max("t"), F.lit(0))).first()
    parts = max(1, -(-n // LINES))
    width = (high - low) // parts + 1
    at = F.coalesce(F.expr(f"(t - {low}L) div {width}L"), F.lit(0)).cast("int")
    pieces = lines.repartitionById(parts, at).sortWithinPartitions("t").select("line").mapInArrow(_joined, "piece binary").persist(StorageLevel.DISK_ONLY)
    h = hashlib.sha256()
    try:
        pieces.count()  # all partitions side by side; else each is only computed when the driver asks for it
        for row in pieces.toLocalIterator(prefetchPartitions=True):
            h.update(row["piece"])
    finally:
        pieces.unpersist()
    return h.hexdigest()
