"""Portfolios of tickets: construction, validity, coverage, scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng, rules

ORDER = 5
#: Tickets of a portfolio.
MOST = 30


def plane_blocks() -> np.ndarray:
    """The 31 lines of the projective plane of order 5: affine lines with their point at infinity, verticals, infinity."""
    q = ORDER
    x = np.arange(q)
    lines = [np.append(((s * x + c) % q) * q + x, q * q + s) for s in range(q) for c in range(q)]
    lines += [np.append(x * q + v, q * q + q) for v in range(q)]
    return np.array([*lines, np.arange(q * q, q * q + q + 1)])


def planned_tickets(n: int, seed: int = 645) -> list[list[int]]:
    """Up to 30 tickets, any two of which share one number at most."""
    if not 1 <= n <= 30:
        raise ValueError("a portfolio has 1 to 30 tickets")
    u = rng.stream(seed + 97 * n, 44 + 30)

    def shuffled(values: list, u: np.ndarray) -> list:
        out = list(values)
        for k, i in enumerate(range(len(out) - 1, 0, -1)):
            j = int(u[k] * (i + 1))
            out[i], out[j] = out[j], out[i]
        return out

    labels = np.array(shuffled(list(range(1, 46)), u[:44])[:31])
    order = shuffled(list(range(31)), u[44:])[:n]
    blocks = plane_blocks()
    return [sorted(labels[blocks[i]].tolist()) for i in order]


def portfolio(spark: SparkSession, n: int, seed: int = 645) -> DataFrame:
    return spark.createDataFrame(list(enumerate(planned_tickets(n, seed))), "ticket_id int, ticket array<int>")


def shared_pairs(tickets: DataFrame) -> DataFrame:
    """``portfolio, i, j, shared`` of every two tickets of a portfolio (``portfolio, ticket_id, ticket``) that share two numbers or more.

    Two tickets share a pair of numbers exactly when both are filed under it; tickets that share m numbers meet
    under m (m - 1) / 2 pairs.  A portfolio holds ``MOST`` tickets at most, so no pair's list is longer.
    """
    number = lambda y: F.filter("ticket", lambda x: x > y)
    pair = F.flatten(F.transform("ticket", lambda x: F.transform(number(x), lambda y: x * 100 + y)))
    filed = tickets.select("portfolio", "ticket_id", F.explode(pair).alias("pair")).groupBy("portfolio", "pair").agg(F.sort_array(F.collect_list("ticket_id")).alias("ids")).where(F.size("ids") > 1)
    after = lambda i, k: F.transform(F.slice("ids", k + 2, F.size("ids")), lambda j: F.struct(i.alias("i"), j.alias("j")))
    each = filed.select("portfolio", F.explode(F.flatten(F.transform("ids", after))).alias("p"))
    met = each.groupBy("portfolio", "p").agg(F.count(F.lit(1)).alias("n"))
    return met.select("portfolio", "p.i", "p.j", ((F.lit(1) + F.sqrt(F.lit(1) + 8 * F.col("n"))) / 2).cast("int").alias("shared"))


def validity(tickets: DataFrame) -> DataFrame:
    """``portfolio, n, most_shared, valid`` for each portfolio of ``portfolio, ticket_id, ticket``.

    Valid are 1 to ``MOST`` tickets of six distinct numbers of which no two share more than one.  More than ``MOST``
    tickets are no portfolio and are not compared (``most_shared`` is null), so a portfolio that holds a third of all
    tickets is only counted.
    """
    sizes = tickets.groupBy("portfolio").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_and(rules.is_valid_result(F.col("ticket"))), F.lit(False)).alias("tickets_ok"))
    small = tickets.join(sizes.where(F.col("n") <= MOST).select("portfolio"), "portfolio", "left_semi")
    two = shared_pairs(small).groupBy("portfolio").agg(F.max("shared").alias("two"))
    number = small.select("portfolio", F.explode("ticket").alias("x")).groupBy("portfolio", "x").count().groupBy("portfolio").agg((F.max("count") > 1).cast("int").alias("one"))
    met = sizes.join(two, "portfolio", "left").join(number, "portfolio", "left")
    most = F.when(F.col("n") <= MOST, F.coalesce("two", "one", F.lit(0)))
    return met.select("portfolio", "n", most.alias("most_shared"), (F.col("n").between(1, MOST) & F.col("tickets_ok") & F.coalesce(most <= 1, F.lit(False))).alias("valid"))


def is_valid(tickets: DataFrame) -> DataFrame:
    """``n, most_shared, valid`` of one portfolio; none is not valid."""
    found = validity(tickets.withColumn("portfolio", F.lit(0))).select("n", "most_shared", "valid")
    return found.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.max("most_shared").alias("most_shared"), F.coalesce(F.bool_or("valid"), F.lit(False)).alias("valid"))


def covered_pairs(tickets: DataFrame) -> DataFrame:
    """Distinct pairs of numbers that some ticket holds."""
    pair = F.flatten(F.transform("ticket", lambda x: F.transform(F.filter("ticket", lambda y: y > x), lambda y: x * 100 + y)))
    return tickets.select(F.explode(pair).alias("pair")).agg(F.count_distinct("pair").alias("covered_pairs"))


def best_match(table: DataFrame, tickets: list[list[int]]) -> DataFrame:
    """``t, best``: the most numbers any ticket shares with each draw; no tickets give 0."""
    own = F.array(*[F.array(*map(F.lit, t)) for t in tickets]) if tickets else F.expr("cast(array() as array<array<int>>)")
    return table.select("t", F.coalesce(F.array_max(F.transform(own, lambda t: rules.matches(t, F.col("result")))), F.lit(0)).alias("best"))


def scores(table: DataFrame, tickets: list[list[int]]) -> DataFrame:
    """For each draw: best match, sum of payouts (null counts 0) and cost of the portfolio."""
    own = F.array(*[F.array(*map(F.lit, t)) for t in tickets])
    ks = F.transform(own, lambda t: rules.matches(t, F.col("result")))
    paid = F.aggregate(F.transform(ks, lambda k: F.coalesce(rules.payout(k), F.lit(0)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return table.select("t", F.array_max(ks).alias("best"), paid.alias("payout"), F.lit(len(tickets) * rules.TICKET_PRICE).cast("long").alias("cost"))


def same_budget_simulation(n: int, simulations: int = 3000, seed: int = 645, portfolio_seed: int = 645) -> dict:
    """Planned against random tickets on simulated draws; one stream, so one run (vectorised over it)."""
    fixed = np.zeros((n, rules.POOL + 1), bool)
    for i, t in enumerate(planned_tickets(n, portfolio_seed)):
        fixed[i, t] = True
    all_tickets = rng.fair_tickets(seed, simulations * (n + 1)).reshape(simulations, n + 1, rules.PICKS)
    drawn = all_tickets[:, 0]
    planned = fixed[:, drawn].sum(2).max(0)
    mark = np.zeros((simulations, rules.POOL + 1), bool)
    mark[np.arange(simulations)[:, None], drawn] = True
    random = mark[np.arange(simulations)[:, None, None], all_tickets[:, 1:]].sum(2).max(1)
    rate = lambda v, k: float((v >= k).mean())
    return {"tickets": n, "simulations": simulations, "planned_mean_best": float(planned.mean()), "random_mean_best": float(random.mean()), "planned_rate_4": rate(planned, 4), "random_rate_4": rate(random, 4), "planned_rate_5": rate(planned, 5), "random_rate_5": rate(random, 5)}


def simulations(spark: SparkSession, counts: list[int], n: int = 3000) -> DataFrame:
    """One task a portfolio size."""
    from ..session import importable

    importable(spark)

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([same_budget_simulation(int(c), n) for c in b["tickets"]])

    schema = "tickets bigint, simulations bigint, planned_mean_best double, random_mean_best double, planned_rate_4 double, random_rate_4 double, planned_rate_5 double, random_rate_5 double"
    return spark.createDataFrame([(c,) for c in counts], "tickets bigint").repartition(len(counts)).mapInPandas(run, schema)
