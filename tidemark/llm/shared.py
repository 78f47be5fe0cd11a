"""What the operators of this subpackage share: the cluster's folder, Arrow blocks and vectorised hashing.

Nothing here keeps state on a machine-local disk.  Intermediate tables go to the
folder named by ``spark.checkpoint.dir``; it is read from the session and replaced
by one of our own only in local mode, where the setting may be absent (tests).
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..session import importable

#: Upper bound of one Arrow batch handed to Python, in rows and in bytes.
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20
#: Bytes of text that the vectorised loops look at together.
BLOCK_BYTES = 1 << 20

#: ASCII white space, the only separators of words in these operators.
SPACES = b"\t\n\x0b\x0c\r "
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        own = f"file://{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"
    else:
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame | None) -> None:
    """Delete the files behind a table made by :func:`materialise` that no later plan reads."""
    if df is None:
        return
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        while "=" in folder.getName():  # a partition's folder
            folder = folder.getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


_held: list[tuple[DataFrame, DataFrame]] = []


def hold(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in blocks on the executors' disks; the blocks of a lost executor are computed anew.

    For rows that come straight from Python workers and are read several times.  No files are written: each file makes
    the executor start processes (in a local folder three runs of chmod), and while one starts, all memory of the JVM is
    also counted as the new process's.
    """
    tag = free_name(df, "_held")
    kept = df.withColumn(tag, F.lit(uuid.uuid4().hex)).persist(StorageLevel.DISK_ONLY)  # no equal plan over older files is taken for this one
    kept.count()
    _held.append((kept.drop(tag), kept))
    return _held[-1][0]


def drop_held(spark: SparkSession, *tables: DataFrame) -> None:
    """Give up tables made by :func:`hold` that no later plan reads; all of the session's if none is named."""
    for pair in list(_held):
        if pair[1].sparkSession is spark and (not tables or any(pair[0] is t for t in tables)):
            pair[1].unpersist()
            _held.remove(pair)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def prepare_python(spark: SparkSession) -> None:
    """Bound the Arrow batches of Python stages by bytes as well as rows (a session setting), and let workers import this package."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever columns it brings along."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name += "_"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``[a, b)`` with their UTF-8 bytes side by side and ``b - a + 1`` offsets; null counts as empty.

    A block holds at least one row and otherwise at most ``most`` bytes, so that
    memory follows the longest single text and not the batch.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + most, "right")) - 1)
        yield a, b, raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        a = b


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
ODD64 = np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.full(max(1, 2 * n), _BASE if kind == "up" else _INVERSE, np.uint64)
            have[0] = 1
            have = np.multiply.accumulate(have)
        _powers[kind] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, by one prefix sum over the block."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * _power("up", len(raw)), out=total[1:])
        return mix64((total[ends] - total[starts]) * _power("down", len(raw) + 1)[starts] + (ends - starts).astype(np.uint64))


def word_spans(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-space bytes; a run ends where its row does."""
    inside = np.zeros(len(raw) + 2, bool)
    np.logical_not(IS_SPACE[raw], out=inside[1:-1])
    fresh = inside[1:-1] & ~inside[:-2]
    cuts = bounds[:-1][bounds[:-1] < len(raw)]
    fresh[cuts] = inside[1:-1][cuts]
    last = inside[1:-1] & ~inside[2:]
    cuts = bounds[1:][bounds[1:] > 0] - 1
    last[cuts] = inside[1:-1][cuts]
    return np.flatnonzero(fresh), np.flatnonzero(last) + 1


#: How to drop what operators keep in a worker from one task to the next.
_kept: list[Callable[[], None]] = []


def keeps(drop: Callable[[], None]) -> None:
    """An operator that keeps tables or memos in its worker says here how they are dropped."""
    _kept.append(drop)


def let_go() -> None:
    """Workers go from stage to stage, and Spark counts their memory in none: drop what other operators have left in this one."""
    for drop in _kept:
        drop()
    gc.collect()
    pa.default_memory_pool().release_unused()


class TwoGenerations:
    """A memo of bounded size: when the young half is full, the old half is forgotten."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def get_all(self, keys: list) -> list:
        got = list(map(self.young.get, keys))
        if None in got:
            old = self.old
            for i, v in enumerate(got):
                if v is None and (v := old.get(keys[i])) is not None:
                    got[i] = v
                    self.young[keys[i]] = v
        return got

    def put(self, keys: list, values: list) -> None:
        if len(self.young) + len(keys) > self.most:
            self.old, self.young = self.young, {}
        self.young.update(zip(keys, values))
