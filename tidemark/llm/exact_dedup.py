"""Exact dedup by content sort.  DataFrame and SQL functions only.

Texts are normalised by deleting ASCII white space.  Splitters sampled by Spark from a
bounded key (the first 48 characters and a 64-bit digest) range-partition the normalised
bytes, an external sort within each range puts equals next to each other, and each row
is compared in full with its neighbour.  Of equals, the longest original text stays,
then the smallest identifier.

A group that holds more than one in ``HOT`` of all rows (fewer than ``HOT`` such groups
can exist, so their list is bounded and may be broadcast) is dealt over ``SALTS`` ranges;
each range keeps its own best row, and the few best rows are compared once more.

Edge cases: a null text counts as empty, and all empty texts are equal; repeated rows with
one doc_id count as rows of the group and share one ``keep_id`` (of rows equal in every way
exactly one is ``kept``); a null doc_id comes after all others; columns besides ``doc_id``
and ``text`` are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

HOT = 1000
SALTS = 64


def normalised(text: Column) -> Column:
    for space in " \n\r\t\x0b\x0c":
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def exact_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row."""
    text = shared.text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).alias("n_points"), normalised(text).alias("content"))
    keyed = rows.withColumn("digest", F.xxhash64("content"))
    counts = keyed.groupBy("digest").count()
    total = docs.count()
    hot = counts.where(F.col("count") > max(total // HOT, 16)).select("digest", F.lit(True).alias("hot"))
    # fewer than HOT rows where total >= 16 * HOT, and at most total / 16 otherwise: always below 1000
    keyed = keyed.join(F.broadcast(hot), "digest", "left")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "n_points"), F.lit(SALTS)).cast("int")).otherwise(F.lit(-1))
    ranged = keyed.withColumn("salt", salt).withColumn("head", F.substring("content", 1, 48))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ranged.repartitionByRange(parts, "head", "digest", "salt")

    # The range partitioning already has each group together, and one sort serves both windows:
    # a window ends where the next row's content differs, which is the full comparison of neighbours.
    same = Window.partitionBy("head", "digest", "salt", "content")
    ordered = same.orderBy(F.col("n_points").desc(), F.col("doc_id").asc_nulls_last())
    decided = ranged.select(
        "doc_id", "n_points", "digest", "hot",
        F.row_number().over(ordered).alias("rank"),
        F.first("doc_id").over(ordered).alias("keep_id"),
        F.count(F.lit(1)).over(same).alias("group_size"),
        F.sha2("content", 256).alias("text_sha256"),
    )
    decided = shared.materialise(decided, "exact-groups")
    best = (
        decided.where(F.col("hot") & (F.col("rank") == 1))
        .groupBy("digest", "text_sha256")
        .agg(F.min_by(F.struct("n_points", "doc_id"), F.struct(-F.col("n_points"), F.col("doc_id").isNull(), F.col("doc_id"))).alias("best"), F.sum("group_size").alias("all_size"))
        .select("digest", "text_sha256", "best", "all_size")
    )
    joined = decided.join(F.broadcast(best), ["digest", "text_sha256"], "left")  # as many rows as hot groups
    wins = F.col("best").isNull() | ((F.col("best.n_points") == F.col("n_points")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id")))
    return joined.select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("keep_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("all_size", "group_size").cast("long").alias("group_size"),
        ((F.col("rank") == 1) & wins).alias("kept"),
        "text_sha256",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one of each group of equal texts."""
    sha, nth = shared.free_name(docs, "_sha"), shared.free_name(docs, "_nth")
    kept = exact_groups(docs).where("kept").select(F.col("doc_id").alias("kept_id"), "text_sha256")
    rows = docs.withColumn(sha, F.sha2(normalised(shared.text_or_empty()), 256))
    met = rows.join(kept, rows["doc_id"].cast("long").eqNullSafe(kept["kept_id"]) & (rows[sha] == kept["text_sha256"]), "left_semi")
    order = Window.partitionBy("doc_id", sha).orderBy(F.length("text").desc_nulls_last(), "text")
    return met.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).select(*docs.columns)
