"""Keyed upsert, comparison of sources, continuity and order checks."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rng, rules
from ..session import importable


def _same(a: str, b: str) -> Column:
    """Date and result; process_time does not count."""
    return F.col(f"{a}.date").eqNullSafe(F.col(f"{b}.date")) & F.col(f"{a}.result").eqNullSafe(F.col(f"{b}.result"))


def classified(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows (``ordinal, id, date, result``) with ``action``: added, unchanged, duplicate or conflict.

    The row that holds an id is the existing one or else the first incoming one.  A row that
    equals it is a duplicate if an earlier row of the batch with that id was added or equal too.
    """
    first = incoming.groupBy("id").agg(F.min_by(F.struct("date", "result"), "ordinal").alias("first"), F.min("ordinal").alias("first_ordinal"))
    held = first.join(existing.select("id", F.struct("date", "result").alias("old")), "id", "left")
    held = held.select("id", F.coalesce("old", "first").alias("held"), F.col("old").isNotNull().alias("was_there"), "first_ordinal", "old")
    rows = incoming.withColumn("row", F.struct("date", "result")).join(held, "id")
    added = ~F.col("was_there") & (F.col("ordinal") == F.col("first_ordinal"))
    rows = rows.withColumn("fits", added | _same("row", "held"))
    seen = F.coalesce(F.max(F.col("fits").cast("int")).over(Window.partitionBy("id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    action = F.when(added, "added").when(~F.col("fits"), "conflict").when(seen, "duplicate").otherwise("unchanged")
    return rows.select("ordinal", "id", "date", "result", "held", action.alias("action"))


def merged(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing rows never change; first rows of new ids are added."""
    new = incoming.join(existing.select("id"), "id", "left_anti").groupBy("id").agg(F.min_by(F.struct("date", "result"), "ordinal").alias("r")).select(F.col("r.date").alias("date"), "id", F.col("r.result").alias("result"))
    return existing.select("date", "id", "result").unionByName(new)


def counters(actions: DataFrame) -> DataFrame:
    n = lambda a: F.count_if(F.col("action") == a)
    return actions.agg(n("added").alias("added"), n("unchanged").alias("unchanged"), n("duplicate").alias("duplicates"), n("conflict").alias("conflicts"))


def conflicts(actions: DataFrame) -> DataFrame:
    return actions.where("action = 'conflict'").select("id", F.col("held").alias("existing"), F.struct("date", "result").alias("incoming"))


def compare_ids(local: DataFrame, mirror: DataFrame | None) -> DataFrame:
    """``compared, only_local, only_mirror, both``; without a mirror nothing is compared."""
    spark = local.sparkSession
    if mirror is None:
        return spark.createDataFrame([(False, 0, 0, 0)], "compared boolean, only_local bigint, only_mirror bigint, both bigint")
    both = local.select("id", F.lit(1).alias("l")).distinct().join(mirror.select("id", F.lit(1).alias("m")).distinct(), "id", "full")
    return both.agg(F.lit(True).alias("compared"), F.count_if(F.col("m").isNull()).alias("only_local"), F.count_if(F.col("l").isNull()).alias("only_mirror"), F.count_if(F.col("l").isNotNull() & F.col("m").isNotNull()).alias("both"))


def sample_ids(table: DataFrame, extra: int, seed: int) -> list[str]:
    """First, last, middle and ``extra`` seeded ids of the rest, drawn without replacement; positions are drawn, not rows.

    Only the chosen positions' ids reach the driver.
    """
    from .draws import numbered

    placed = numbered(table.select("id"), F.substring(F.lpad("id", 20, "0"), 1, 16), [F.col("id").cast("bigint"), F.col("id")])
    n = placed.count()
    if not n:
        return []
    fixed = sorted({0, n - 1, n // 2})
    left, taken, u = n - len(fixed), [], rng.stream(seed, max(1, min(extra, n)))
    for i in range(min(extra, left)):
        k = int(u[i] * (left - i))
        # the k-th position that is neither fixed nor taken
        for p in sorted(fixed + taken):
            if p <= k:
                k += 1
        taken.append(k)
    return sorted(r["id"] for r in placed.where(F.col("t").isin(fixed + taken)).select("id").collect())


def looked_up(ids: DataFrame, adapter: str, options: dict | None = None, batch: int = 50) -> DataFrame:
    """``id, value, error``: raw details of each id (``id``), fetched on the executors.

    ``adapter`` is the import path (``module:Class``) of a class made with the options, whose ``fetch_details(ids)`` gives
    a raw row or an exception for each id of a batch.  What it raises itself counts for each id of the batch; nothing
    ends the job, so that one bad page does not hide the others.
    """
    importable(ids.sparkSession)
    module, _, name = adapter.partition(":")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source = getattr(importlib.import_module(module), name)(options or {})
        for b in batches:
            for a in range(0, len(b), batch):
                some = b["id"].iloc[a : a + batch].tolist()
                try:
                    got = dict(source.fetch_details(some))
                except Exception as e:  # the adapter's own failure, told for each id
                    got = dict.fromkeys(some, e)
                missing = LookupError("no detail")
                out = [(i, got.get(i, missing)) for i in some]
                text = lambda x: f"{type(x).__name__}: {x}"
                yield pd.DataFrame([(i, None if isinstance(x, Exception) else x if isinstance(x, str) else json.dumps(x), text(x) if isinstance(x, Exception) else None) for i, x in out], columns=["id", "value", "error"])

    return ids.select("id").mapInPandas(run, "id string, value string, error string")


def checked_details(raw: DataFrame, normalise: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``id, date, result, error`` of raw details ``id, value, error``: a detail that is no valid row, or of another id, is an error, not a mismatch.

    ``normalise`` may first change ``value`` (columns ``id, value, error`` in and out), for sources whose rows have another form.
    """
    from ..sources import jsonl

    raw = normalise(raw) if normalise else raw
    fields = jsonl.validated(raw.select(F.struct("id", "error", F.col("value").isNull().alias("none")).alias("line"), "value"))
    problem = F.when(F.col("line.none"), "no detail").when(F.col("reason").isNotNull(), F.concat(F.lit("detail is not valid: "), "reason")).when(F.col("id") != F.col("line.id"), "detail is of another id")
    error = F.coalesce(F.col("line.error"), problem)
    return fields.select(F.col("line.id").alias("id"), F.when(error.isNull(), F.col("date")).alias("date"), F.when(error.isNull(), F.col("result")).alias("result"), error.alias("error"))


def cross_check(local: DataFrame, detail: DataFrame, mirror: DataFrame | None, sample: DataFrame | list[str]) -> DataFrame:
    """``id, fetch_error, error, mismatches`` for each sampled id; ``detail`` has ``id, date, result, error``."""
    spark = local.sparkSession
    ids = sample.select("id") if isinstance(sample, DataFrame) else spark.createDataFrame([(i,) for i in sample], "id string")
    side = lambda df, name, *more: df.select("id", F.struct("date", "result").alias(name), *more)
    rows = ids.join(side(local, "l"), "id", "left").join(side(detail, "d", "error"), "id", "left")
    rows = rows.join(side(mirror, "m"), "id", "left") if mirror is not None else rows.withColumn("m", F.lit(None).cast("struct<date:date,result:array<int>>"))
    failed = F.col("error").isNotNull() | F.col("d").isNull()
    wrong = F.filter(F.array(
        F.when(F.col("l").isNotNull() & ~failed & ~_same("l", "d"), "detail differs"),
        F.when(F.col("l").isNotNull() & F.col("m").isNotNull() & ~_same("l", "m"), "mirror differs"),
    ), lambda x: x.isNotNull())
    return rows.select("id", failed.alias("fetch_error"), F.when(failed, F.coalesce("error", F.lit("no detail"))).alias("error"), wrong.alias("mismatches"))


def cross_check_status(checks: DataFrame) -> DataFrame:
    out = checks.agg(F.count(F.lit(1)).alias("sample_size"), F.count_if(F.size("mismatches") > 0).alias("failures"), F.count_if("fetch_error").alias("fetch_errors"))
    return out.withColumn("status", F.when(F.col("sample_size") == 0, "EMPTY").when(F.col("failures") > 0, "FAIL").when(F.col("fetch_errors") > 0, "PARTIAL").otherwise("PASS"))


def missing_ids(table: DataFrame, width: int = 5) -> DataFrame:
    """Ids between the least and the greatest that no row has.

    Gaps follow from each id's successor within ranges of ids, so the full sequence is not made or moved.
    """
    ids = table.select(F.col("id").try_cast("bigint").alias("n")).where("n is not null").distinct()
    size = 1 << 16
    low = ids.withColumn("range", F.expr(f"n div {size}"))
    nxt = F.lead("n").over(Window.partitionBy("range").orderBy("n"))
    edges = low.groupBy("range").agg(F.min("n").alias("first")).withColumn("next_first", F.lead("first").over(Window.orderBy("range")))  # one row for 65,536 ids
    gaps = low.withColumn("next", nxt).join(edges, "range")
    gaps = gaps.withColumn("next", F.coalesce("next", "next_first")).where(F.col("next") > F.col("n") + 1)
    # wide gaps are cut first, so that no row holds more than a range's ids
    parts = gaps.select(F.explode(F.sequence(F.col("n") + 1, F.col("next") - 1, F.lit(size).cast("long"))).alias("a"), "next")
    each = parts.select(F.explode(F.sequence("a", F.least(F.col("a") + size, F.col("next")) - 1)).alias("missing"))
    text = F.col("missing").cast("string")
    return each.select(F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0")).alias("id"))


def continuity(table: DataFrame) -> DataFrame:
    """``first, last, expected, present, n_missing, n_duplicates, continuous``: one row."""
    ids = table.select("id", F.col("id").try_cast("bigint").alias("n")).groupBy("id", "n").count()
    out = ids.agg(F.min("n").alias("first"), F.max("n").alias("last"), F.count_distinct("n").alias("present"), F.count_if(F.col("count") > 1).alias("n_duplicates"))
    expected = F.coalesce(F.col("last") - F.col("first") + 1, F.lit(0))
    return out.select("first", "last", expected.alias("expected"), "present", (expected - F.col("present")).alias("n_missing"), "n_duplicates", ((expected > 0) & (expected == F.col("present")) & (F.col("n_duplicates") == 0)).alias("continuous"))


def dataset_issues(table: DataFrame, previous_latest: str | None = None) -> DataFrame:
    """``index, id, reason`` of rows ``t, id, date``: repeated ids, the first break of order, a latest date that went back."""
    first = table.groupBy("id").agg(F.min("t").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = table.join(first, "id").where(F.col("t") > F.col("first")).select(F.col("t").alias("index"), "id", F.concat(F.lit("id repeats the row at "), F.col("first").cast("string")).alias("reason"))
    after = table.select((F.col("t") - 1).alias("t"), F.struct("date", "id").alias("next"))
    breaks = table.select("t", F.struct("date", "id").alias("here")).join(after, "t").where(F.col("here") > F.col("next"))
    order = breaks.agg(F.min_by("next.id", "t").alias("id"), (F.min("t") + 1).alias("index")).where("index is not null").select("index", "id", F.lit("rows are out of order").alias("reason"))
    out = repeated.unionByName(order)
    if previous_latest:
        latest = table.agg(F.max_by("date", "t").alias("latest")).where(F.col("latest") < F.lit(previous_latest).cast("date"))
        out = out.unionByName(latest.select(F.lit(None).cast("long").alias("index"), F.lit(None).cast("string").alias("id"), F.lit("the latest date went back").alias("reason")))
    return out
