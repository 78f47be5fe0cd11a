"""Exact combinatorics as small tables and column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rules

TOTAL = math.comb(rules.POOL, rules.PICKS)


def choose(n: Column, k: Column) -> Column:
    """Whole numbers up to C(45, 22); 0 outside 0 <= k <= n; a negative n is an error.

    The product after each factor is itself a binomial coefficient, so every division is exact.
    """
    steps = F.sequence(F.lit(1), F.greatest(F.least(k, n - k), F.lit(1)))
    value = F.aggregate(steps, F.lit(1).cast("long"), lambda acc, i: F.call_function("div", acc * (n - F.least(k, n - k) + i), i))
    return F.when(n < 0, F.raise_error(F.lit("n is negative")).cast("long")).when((k < 0) | (k > n), F.lit(0).cast("long")).when((k == 0) | (k == n), F.lit(1).cast("long")).otherwise(value)


def _long(x) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("long")


def outcomes(spark: SparkSession) -> DataFrame:
    """``matches, combinations, probability, payout`` of one ticket: seven rows."""
    k = F.col("id")
    n = choose(_long(6), k) * choose(_long(39), 6 - k)
    return spark.range(7).select(k.cast("int").alias("matches"), n.alias("combinations"), (n / float(TOTAL)).alias("probability"), rules.payout(k).alias("payout"))


def hypergeometric(spark: SparkSession, pool: int) -> DataFrame:
    """``matches, probability`` of a pool of ``pool`` numbers against six drawn."""
    k = F.col("id")
    n = choose(_long(pool), k) * choose(_long(rules.POOL - pool), 6 - k)
    return spark.range(7).select(k.cast("int").alias("matches"), (n / float(TOTAL)).alias("probability"))


def expected_matches(pool: int = 6) -> float:
    return rules.PICKS * pool / rules.POOL


def match_variance() -> float:
    return 6 * (6 / 45) * (39 / 45) * (39 / 44)


def tier_counts(spark: SparkSession, pool: int = 18) -> DataFrame:
    """``m, j, tickets``: of all tickets in a pool with m drawn numbers, how many match exactly j."""
    m, j = F.col("m"), F.col("j")
    grid = spark.range(7 * 7).select(F.expr("id div 7").alias("m"), (F.col("id") % 7).alias("j"))
    return grid.select(m.cast("int").alias("m"), j.cast("int").alias("j"), (choose(m, j) * choose(_long(pool) - m, 6 - j)).alias("tickets"))


def pool_payouts(spark: SparkSession, pool: int = 18) -> DataFrame:
    """``m, fixed_payout, jackpot_tickets`` of all tickets of a pool; the jackpot is left out of the payout."""
    prize = F.col("j").cast("long")
    paid = F.when(prize.between(3, 5), F.coalesce(rules.payout(F.col("j")), F.lit(0)) * F.col("tickets")).otherwise(0)
    return tier_counts(spark, pool).groupBy("m").agg(F.sum(paid).cast("long").alias("fixed_payout"), F.sum(F.when(F.col("j") == 6, F.col("tickets")).otherwise(0)).cast("long").alias("jackpot_tickets"))


def bao(spark: SparkSession) -> DataFrame:
    """``pool, tickets, cost, jackpot_probability`` for pools of 6 .. 45."""
    n = choose(F.col("id"), _long(6))
    return spark.range(6, 46).select(F.col("id").cast("int").alias("pool"), n.alias("tickets"), (n * rules.TICKET_PRICE).alias("cost"), (n / float(TOTAL)).alias("jackpot_probability"))


def at_least_one(tickets: Column) -> Column:
    """Chance that one of so many independent random tickets wins the jackpot."""
    return 1 - F.pow(F.lit(1 - 1 / TOTAL), tickets)


def frontier(spark: SparkSession, budgets: list[int] | DataFrame, most: int = 30) -> DataFrame:
    """For each budget (numbers, or a column ``budget``): the largest affordable pool and the same money in separate tickets."""
    wanted = budgets.select("budget") if isinstance(budgets, DataFrame) else spark.createDataFrame([(b,) for b in budgets], "budget bigint")
    table = bao(spark)
    best = wanted.join(F.broadcast(table), F.col("cost") <= F.col("budget")).groupBy("budget").agg(F.max(F.struct("pool", "tickets", "cost", "jackpot_probability")).alias("b"))  # 40 rows broadcast
    single = _at_least(spark)
    tickets = F.least(F.expr(f"budget div {rules.TICKET_PRICE}"), F.lit(most)).cast("long")
    return best.select(
        "budget", "b.pool", F.col("b.tickets").alias("pool_tickets"), F.col("b.cost").alias("pool_cost"), "b.jackpot_probability",
        tickets.alias("tickets"), (F.expr(f"budget div {rules.TICKET_PRICE}") > most).alias("capped"),
        (tickets * F.lit(single[4])).alias("p_at_least_4"), (tickets * F.lit(single[5])).alias("p_at_least_5"), (tickets / float(TOTAL)).alias("p_jackpot"),
    )


def _at_least(spark: SparkSession | None = None) -> dict[int, float]:
    n = {k: math.comb(6, k) * math.comb(39, 6 - k) for k in range(7)}
    return {k: sum(n[i] for i in range(k, 7)) / TOTAL for k in range(7)}


def portfolio_odds(tickets: Column) -> Column:
    """Exact where every two tickets share one number at most, since then no two can both match four or more."""
    p = _at_least()
    return F.struct((tickets * rules.TICKET_PRICE).cast("long").alias("cost"), (tickets * p[4]).alias("p_at_least_4"), (tickets * p[5]).alias("p_at_least_5"), (tickets * p[6]).alias("p_jackpot"))


def exact_benchmark(spark: SparkSession, counts: list[int] | DataFrame) -> DataFrame:
    """Disjoint-event tickets against as many independent ones, with lifts, for four or more matches."""
    p = _at_least()[4]
    n = F.col("tickets")
    planned, random = n * p, 1 - F.pow(F.lit(1 - p), n)
    rows = counts.select("tickets") if isinstance(counts, DataFrame) else spark.createDataFrame([(c,) for c in counts], "tickets bigint")
    return rows.select(n, planned.alias("planned"), random.alias("random"), (planned - random).alias("absolute_lift"), ((planned - random) / random).alias("relative_lift"))


def profit_ledger(losses: Column, payout: Column, price: int = rules.TICKET_PRICE, target: int = 20_000) -> Column:
    cost = (losses + 1) * price
    return F.struct(cost.alias("cost"), (payout - cost).alias("net"), (cost + target).alias("required"))


def ranking_score(ticket: Column, features: Column) -> Column:
    """Mean of the ticket's numbers in a map of features; missing ones count 0."""
    return F.aggregate(ticket, F.lit(0.0), lambda acc, n: acc + F.coalesce(F.try_element_at(features, n), F.lit(0.0))) / F.size(ticket)
