"""Audit of pools of 18 numbers: every rule's pool against every draw, with exact statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric, rng, rules
from ..session import settled
from . import resample
from .walkforward import POOL_RULES, holm, picks

POOL = 18
P0 = math.comb(18, 6) / math.comb(45, 6)
EXPECTED_K = 6 * 18 / 45


def _payout(k):
    """Fixed prizes of all tickets of the pool, by drawn numbers in it."""
    table = {m: sum(math.comb(m, j) * math.comb(POOL - m, 6 - j) * prize for j, prize in rules.PRIZES.items()) for m in range(7)}
    out = F.lit(0).cast("long")
    for m, v in table.items():
        out = F.when(k == m, F.lit(v).cast("long")).otherwise(out)
    return out


def observations(table: DataFrame, lookback: int = 90, seed: int | None = 645) -> DataFrame:
    """LONG: ``t, date, rule, k, hit6``; with a seed also RANDOM18."""
    wide = picks(table, lookback, POOL_RULES, POOL, carry=("date",))
    names = list(POOL_RULES)
    if seed is not None:
        wide = wide.withColumn("RANDOM18", rng.pool_pick(seed, POOL)(F.col("t")))
        names.append("RANDOM18")
    each = F.array(*[F.struct(F.lit(n).alias("rule"), rules.matches(F.col(n), F.col("result")).alias("k")) for n in names])
    # as in walkforward.series, places are exploded, so that nothing is computed twice
    placed = wide.select("t", "date", each.alias("all"), F.explode(F.array(*map(F.lit, range(len(names))))).alias("_i"))
    return placed.select("t", "date", F.get("all", "_i").alias("o")).select("t", "date", "o.rule", "o.k", (F.col("o.k") == 6).alias("hit6"))


def leak_check(table: DataFrame, lookback: int = 90, seed: int = 645) -> DataFrame:
    """Pools that hold the result: the harness must report every one as hit."""
    late = table.where(F.col("t") >= lookback)
    pool = rng.oracle_pool(seed, POOL)(F.col("t"), F.col("result"))
    return late.select("t", rules.matches(pool, F.col("result")).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") == 6).alias("hits"))


def rule_counts(seen: DataFrame) -> DataFrame:
    """``rule, n, hit6, k0..k6, mean_k, median_k, at_least_4, at_least_5, payout, cost``; a histogram first, so that one row a value is moved."""
    hist = seen.groupBy("rule", "k").agg(F.count(F.lit(1)).alias("n"))
    at = Window.partitionBy("rule")
    order = at.orderBy("k")
    placed = hist.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(at))
    holds = lambda p: F.max(F.when((F.col("upto") - F.col("n") <= p) & (p < F.col("upto")), F.col("k")))
    total = F.sum("n")
    tickets = math.comb(POOL, 6)
    return placed.groupBy("rule").agg(
        total.alias("n"), F.coalesce(F.sum(F.when(F.col("k") == 6, F.col("n"))), F.lit(0)).alias("hit6"),
        *[F.coalesce(F.sum(F.when(F.col("k") == i, F.col("n"))), F.lit(0)).alias(f"k{i}") for i in range(7)],
        (F.sum(F.col("k") * F.col("n")) / total).alias("mean_k"),
        ((holds(F.expr("(total - 1) div 2")) + holds(F.expr("total div 2"))) / 2).alias("median_k"),
        F.coalesce(F.sum(F.when(F.col("k") >= 4, F.col("n"))), F.lit(0)).alias("at_least_4"), F.coalesce(F.sum(F.when(F.col("k") >= 5, F.col("n"))), F.lit(0)).alias("at_least_5"),
        F.sum(_payout(F.col("k")) * F.col("n")).alias("payout"), (total * tickets * rules.TICKET_PRICE).alias("cost"),
    )


def halves(seen: DataFrame, lookback: int, trials: int) -> DataFrame:
    """Hits and mean k of the first half (rounded down) and the rest."""
    early = F.col("t") - lookback < trials // 2
    return seen.groupBy("rule", early.alias("early")).agg(F.count(F.lit(1)).alias("n"), F.count_if("hit6").alias("hit6"), F.avg("k").alias("mean_k"))


def contingency(seen: DataFrame, control: str, lowest: int = 6) -> DataFrame:
    """Each rule against the control on the same draws: both, only one, neither hit."""
    hit = (F.col("k") >= lowest).alias("hit")
    base = seen.where(F.col("rule") == control).select("t", hit.alias("base"))
    met = seen.where(F.col("rule") != control).select("rule", "t", hit).join(base, "t")
    n = lambda a, b: F.count_if((F.col("hit") == a) & (F.col("base") == b))
    return met.groupBy("rule").agg(n(True, True).alias("both"), n(True, False).alias("rule_only"), n(False, True).alias("control_only"), n(False, False).alias("neither"))


def null_calibration(n: int) -> dict:
    return {"n": n, "expected_hits": n * P0, "p_zero": numeric.binomial_pmf(n, 0, P0), "low": numeric.binomial_quantile(n, P0, 0.025), "high": numeric.binomial_quantile(n, P0, 0.975), "underpowered": n * P0 < 5}


def calibrated(rows: DataFrame) -> DataFrame:
    """``rows`` (``n``: draws) with what chance alone gives: ``expected_hits, p_zero, low, high, underpowered``."""
    n = F.col("n")
    return rows.select("*", (n * P0).alias("expected_hits"), F.pow(F.lit(1 - P0), n).alias("p_zero"), numeric.quantile(n, P0, F.lit(0.025)).alias("low"), numeric.quantile(n, P0, F.lit(0.975)).alias("high"), (n * P0 < 5).alias("underpowered"))


def audit(table: DataFrame, lookback: int = 90, seed: int = 645, alpha: float = 0.05, iterations: int = 10_000) -> DataFrame:
    """One row a rule: exact tail and interval, Holm over the four history rules, paired tests, halves and a verdict."""
    seen = settled(observations(table, lookback, seed), "pool18")
    trials = max(0, table.count() - lookback)
    counts = rule_counts(seen)
    exact = counts.withColumn("p_value", numeric.exact_tail(F.col("n"), F.col("hit6"), P0)).withColumn("ci", numeric.interval(F.col("n"), F.col("hit6"), alpha))
    history = holm(exact.where("rule <> 'RANDOM18'").withColumn("_all", F.lit(1)), ["_all"], 4, ["rule"]).drop("_all")
    pairs = contingency(seen, "RANDOM18").withColumn("mcnemar_p", numeric.mcnemar_p(F.col("rule_only"), F.col("control_only")))
    base = seen.where("rule = 'RANDOM18'").select("t", F.col("k").alias("base_k"))
    deltas = seen.where("rule <> 'RANDOM18'").join(base, "t").select("rule", "t", (F.col("k") - F.col("base_k")).cast("double").alias("d"))
    tests = resample.paired(deltas, "rule", seed, iterations)
    h = halves(seen, lookback, trials).groupBy("rule").agg(F.max(F.when(F.col("early"), F.col("mean_k"))).alias("early_k"), F.max(F.when(~F.col("early"), F.col("mean_k"))).alias("late_k"))
    rows = history.join(pairs, "rule").join(tests, "rule").join(h, "rule")
    lift = (F.col("hit6") / F.col("n") > P0) | (F.col("mean_k") > EXPECTED_K)
    opposed = (F.col("early_k") - EXPECTED_K) * (F.col("late_k") - EXPECTED_K) < 0
    reasons = F.filter(F.array(F.when(~lift, "no positive lift"), F.when(F.col("adjusted_p") > alpha, "not significant after Holm"), F.when(opposed, "halves disagree")), lambda x: x.isNotNull())
    return rows.withColumn("reasons", reasons).withColumn("verdict", F.when(F.size("reasons") == 0, "SIGNAL").otherwise("NO_EDGE"))
