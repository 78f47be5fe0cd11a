"""The draw table: numbering, frequency, windows, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules


def from_orders(orders: DataFrame) -> DataFrame:
    """Draws derived from orders by a fixed hash: ``date, key, result`` (see the survey's expression)."""
    key = "((o_orderkey + 1L) * (n * 7919L + 104729L) + o_custkey * n * 31L) % 1000003L"
    # key and number in one whole number each, which sorts without a comparator
    result = f"sort_array(transform(slice(sort_array(transform(sequence(1, 45), n -> {key} * 64 + n)), 1, 6), x -> cast(pmod(x, 64) as int)))"
    return orders.select(F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("key"), F.expr(result).alias("result"))


def numbered(rows: DataFrame, coarse: Column, order: list[Column]) -> DataFrame:
    """``t`` = position in the order (coarse, *order), without one task for all rows.

    Rows are counted by the coarse value (a few thousand dates); running totals of these
    counts, a small table, give each date's first position.
    """
    dated = rows.withColumn("_coarse", coarse)
    counts = dated.groupBy("_coarse").count()
    first = counts.select("_coarse", (F.sum("count").over(Window.orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1))).alias("_first"))
    within = F.row_number().over(Window.partitionBy("_coarse").orderBy(*order)) - 1
    return dated.join(first, "_coarse").withColumn("t", (F.coalesce("_first", F.lit(0)) + within).cast("long")).drop("_coarse", "_first")


def draws(orders: DataFrame) -> DataFrame:
    """``t, id, date, result`` in canonical order."""
    table = numbered(from_orders(orders), F.to_date("at"), [F.col("at"), F.col("key")])
    return table.select("t", F.lpad((F.col("t") + 1).cast("string"), 8, "0").alias("id"), F.to_date("at").alias("date"), "result")


def numbers(spark) -> DataFrame:
    return spark.range(1, rules.POOL + 1).select(F.col("id").cast("int").alias("num"))


def frequency(table: DataFrame) -> DataFrame:
    """``num, count, expected, delta_pct, gap`` for all 45 numbers; ``gap`` is rows since last seen, or all rows.

    One pass: counts and last positions are combined before they are moved, and as each row
    has six numbers, the number of rows and the last position follow from these 45 rows.
    """
    ranked = table.select("t", F.explode("result").alias("num")).groupBy("num").agg(F.count(F.lit(1)).alias("count"), F.max("t").alias("last"))
    dense = numbers(table.sparkSession).join(F.broadcast(ranked), "num", "left")  # 45 rows
    count, everything = F.coalesce("count", F.lit(0)), Window.partitionBy(F.lit(1))
    dense = dense.select("num", count.cast("long").alias("count"), "last", F.expr(f"sum(count) over (partition by 1) div {rules.PICKS}").alias("n"), F.max("last").over(everything).alias("top"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    expected = n * rules.PICKS / float(rules.POOL)
    return dense.select(
        "num", "count", expected.alias("expected"),
        F.when(n == 0, 0.0).otherwise((F.col("count") - expected) / expected * 100).alias("delta_pct"),
        F.coalesce(F.col("top") - F.col("last"), n).cast("long").alias("gap"),
    )


def chi_square(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.sum(F.when(F.col("expected") > 0, (F.col("count") - F.col("expected")) ** 2 / F.col("expected"))), F.lit(0.0)).alias("chi_square"))


def last_days(table: DataFrame, window: str) -> DataFrame:
    """Calendar days up to the latest date, inclusive; ``ALL`` keeps every row."""
    if window == "ALL":
        return table
    latest = table.agg(F.max("date").alias("_latest"))
    return table.join(F.broadcast(latest), F.col("date") >= F.date_sub("_latest", rules.WINDOW_DAYS[window] - 1)).drop("_latest")


def search(table: DataFrame, id_prefix: str | None = None, start: str | None = None, end: str | None = None, most: int = 50) -> DataFrame:
    """Newest first, at most ``most`` rows with the number of all; a blank query finds nothing."""
    wanted = [F.col("id").startswith(id_prefix.strip())] if id_prefix and id_prefix.strip() else []
    wanted += [F.col("date") >= F.lit(start).cast("date")] if start else []
    wanted += [F.col("date") <= F.lit(end).cast("date")] if end else []
    found = table.where(F.lit(False)) if not wanted else table
    for w in wanted:
        found = found.where(w)
    total = found.agg(F.count(F.lit(1)).alias("total_matches"))
    top = found.orderBy(F.desc("date"), F.desc("id")).limit(most)
    return top.join(F.broadcast(total), how="cross")  # one row on the right


def top_numbers(rows: DataFrame, kind: str, k: int = 6) -> DataFrame:
    """``cold`` has no tie-break by gap here, unlike the COLD strategy."""
    order = {"hot": [F.desc("count"), F.asc("num")], "cold": [F.asc("count"), F.asc("num")], "overdue": [F.desc("gap"), F.asc("num")]}[kind]
    return rows.orderBy(*order).limit(k)


def latest_id(table: DataFrame) -> DataFrame:
    return table.agg(F.max_by("id", F.col("id").cast("bigint")).alias("latest_id"))
