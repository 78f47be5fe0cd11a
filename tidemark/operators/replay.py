"""Replay of one draw with what was known before it: tickets frozen from the history, then scored."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng, rules
from . import checks, portfolio, walkforward


def frozen_tickets(table: DataFrame, date: str, lookback: int = 90, seed: int = 645) -> DataFrame:
    """``strategy, ticket`` by the last ``lookback`` rows before the date, and the seeded random ticket."""
    history = checks.without_later_rows(checks.before(table, date), date)
    last = history.agg(F.max("t").alias("_last"))
    window = history.join(F.broadcast(last), F.col("t") > F.col("_last") - lookback).withColumn("t", F.col("t") - F.col("_last") + lookback - 1)
    # the row behind the window stands for the draw to come; its numbers are not looked at
    target = window.where("t = 0").withColumn("t", F.lit(lookback).cast("long"))
    wide = walkforward.picks(window.unionByName(target).select("t", "result"), lookback)
    wide = wide.withColumn("RANDOM", rng.random_pick(F.lit(seed).cast("long")))
    names = (*walkforward.RULES, "RANDOM")
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(n).alias("ticket")) for n in names])).alias("x")).select("x.*")


def scored(tickets: DataFrame, result: DataFrame) -> DataFrame:
    """``strategy, ticket, matches, matched, tier, payout, net`` against the one row ``result``."""
    met = tickets.join(F.broadcast(result.select("result")), how="cross")  # one row on the right
    k = rules.matches(F.col("ticket"), F.col("result"))
    paid = rules.payout(k)
    return met.select("strategy", "ticket", k.alias("matches"), rules.matched_numbers(F.col("ticket"), F.col("result")).alias("matched"), rules.tier(k).alias("tier"), paid.alias("payout"), (F.coalesce(paid, F.lit(0)) - rules.TICKET_PRICE).cast("long").alias("net"))


def portfolios(result: DataFrame, counts: tuple[int, ...] = (10, 20, 30), seed: int = 645) -> DataFrame:
    """``tickets, cost, covered_pairs, best, payout`` of the planned portfolios against the one row ``result``."""
    spark = result.sparkSession
    rows = [(n, i, t) for n in counts for i, t in enumerate(portfolio.planned_tickets(n, seed))]
    each = spark.createDataFrame(rows, "tickets int, ticket_id int, ticket array<int>")
    pair = F.flatten(F.transform("ticket", lambda x: F.transform(F.filter("ticket", lambda y: y > x), lambda y: x * 100 + y)))
    k = rules.matches(F.col("ticket"), F.col("result"))
    met = each.join(F.broadcast(result.select("result")), how="cross").withColumn("k", k)  # one row on the right
    sums = met.groupBy("tickets").agg(F.max("k").alias("best"), F.sum(F.coalesce(rules.payout(F.col("k")), F.lit(0))).alias("payout"), (F.count(F.lit(1)) * rules.TICKET_PRICE).alias("cost"))
    pairs = each.select("tickets", F.explode(pair).alias("pair")).groupBy("tickets").agg(F.count_distinct("pair").alias("covered_pairs"))
    return sums.join(pairs, "tickets")


def pool_math(spark: SparkSession, size: int = 18) -> DataFrame:
    """Constants of all tickets of a pool: number, cost, chance of the jackpot, expected fixed prizes."""
    total, tickets = math.comb(rules.POOL, rules.PICKS), math.comb(size, rules.PICKS)
    single = sum(math.comb(6, k) * math.comb(39, 6 - k) * prize for k, prize in rules.PRIZES.items()) / total
    return spark.createDataFrame([(size, tickets, tickets * rules.TICKET_PRICE, tickets / total, single, single * tickets)], "size int, tickets bigint, cost bigint, p_jackpot double, single_ev double, pool_ev double")
