"""The seeded shuffle of all rows as a table, without a loop over them.

A shuffle by swaps runs from the last place down: step i swaps place i with a drawn place
j(i) <= i.  What ends up at place p came from j(p); if an earlier step (a larger i) had swapped
that place, from there, and so on.  With N(v), the first step after v that drew v, the way back
is a chain p -> S(p) -> N(S(p)) -> ..., where S(p) is the next step after p that drew j(p).
Chains lead to larger numbers only and are some logarithm of n long; they are resolved by
pointer doubling, so the number of rounds is the logarithm of that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rng
from ..session import importable, settled


def swaps(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """``i, j``: the place that step i draws; place 0, which no step draws for, stays itself."""
    importable(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.column(0).to_numpy()
            with np.errstate(over="ignore"):
                state = np.uint32(int(seed) & 0xFFFFFFFF) + rng.STEP * (n - i).astype(np.uint64).astype(np.uint32)
            j = np.where(i == 0, 0, (rng._mixed(state) * (i + 1)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(j)], ["i", "j"])

    return spark.range(n).select(F.col("id").alias("i")).mapInArrow(run, "i bigint, j bigint")


def table(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """``new, old``: row ``old`` comes to place ``new``; the same permutation as ``rng.permutation(n, seed)``."""
    drawn = Window.partitionBy("j").orderBy("i")  # about log(n / j) rows
    steps = settled(swaps(spark, n, seed).withColumn("s", F.lead("i").over(drawn)), "swaps")
    ahead = steps.where("i > j").groupBy(F.col("j").alias("v")).agg(F.min("i").alias("far"))
    # a place without a later step is the end of its chain
    ahead = settled(steps.select(F.col("i").alias("v")).join(ahead, "v", "left").select("v", F.coalesce("far", "v").alias("far")), "chains")
    while True:
        onward = ahead.select(F.col("v").alias("far"), F.col("far").alias("farther"))
        ahead = settled(ahead.join(onward, "far").select("v", F.col("farther").alias("far"), (F.col("farther") > F.col("far")).alias("moved")), "chains")
        if ahead.where("moved").isEmpty():
            break
        ahead = ahead.drop("moved")
    ends = ahead.select(F.col("v").alias("s"), "far")
    return steps.join(ends, "s", "left").select(F.col("i").alias("new"), F.coalesce("far", "j").alias("old"))
