"""Negative controls: data or pairings in which no rule can have an edge, and one leak that must be seen."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng, rules
from ..session import importable, settled
from . import permutation, walkforward

EXPECTED = 0.8


def fair_draws(spark: SparkSession, seeds: list[int], draws: int) -> DataFrame:
    """``rep, t, id, date, result``: one stream a seed, one task a few seeds."""
    importable(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rep, seed in zip(b["rep"], b["seed"]):
                yield pd.DataFrame({"rep": rep, "t": np.arange(draws), "result": list(rng.fair_tickets(int(seed), draws))})

    frame = spark.createDataFrame(list(enumerate(seeds)), "rep int, seed bigint").repartition(max(1, len(seeds)))
    rows = frame.mapInPandas(run, "rep int, t bigint, result array<int>")
    return rows.select("rep", "t", F.lpad((F.col("t") + 1).cast("string"), 5, "0").alias("id"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("t") * 2).cast("int")).alias("date"), "result")


def iid_pass_rates(spark: SparkSession, draws: int = 260, lookback: int = 90, replications: int = 25, seed: int = 645) -> DataFrame:
    """Control A: share of fair data sets in which a rule passes all three gates; all replications in one plan."""
    table = fair_draws(spark, [seed * 1_000_003 + r for r in range(replications)], draws)
    scores = settled(walkforward.series(table, lookback, "RANDOM", ("rep",)), "controls")
    rows = walkforward.summary(scores, lookback, draws - lookback, ["rep"], "RANDOM")
    return rows.where("strategy <> 'RANDOM'").groupBy("strategy").agg((F.count_if(F.col("gates_passed") == 3) / replications).alias("pass_rate"))


def shuffled_draws(table: DataFrame, seed: int = 645) -> DataFrame:
    """Control B's input: results and ids at permuted positions."""
    order = permutation.table(table.sparkSession, table.count(), seed).select(F.col("new").alias("new_t"), F.col("old").alias("t"))
    return table.join(order, "t").select(F.col("new_t").alias("t"), "id", "date", "result")


def edges(table: DataFrame, lookback: int = 90) -> DataFrame:
    scores = walkforward.series(table, lookback, "RANDOM")
    return scores.groupBy("strategy").agg(F.avg("k").alias("mean_k"), (F.avg("k") - F.avg("control_k")).alias("edge"), F.count(F.lit(1)).alias("trials"))


def time_shuffle(table: DataFrame, lookback: int = 90, seed: int = 645) -> DataFrame:
    """Control B: edges before and after the shuffle; ``collapsed`` if no edge grew."""
    before = edges(table, lookback).where("strategy <> 'RANDOM'").select("strategy", F.col("edge").alias("original_edge"))
    after = edges(shuffled_draws(table, seed), lookback).select("strategy", F.col("edge").alias("shuffled_edge"))
    met = before.join(after, "strategy")
    return met.select("strategy", "original_edge", "shuffled_edge", (F.col("original_edge") - F.col("shuffled_edge")).alias("edge_delta"), (F.abs("shuffled_edge") <= F.abs("original_edge") + 1e-12).alias("collapsed"))


def random_baseline(table: DataFrame, lookback: int = 90) -> DataFrame:
    """Control C."""
    late = table.where(F.col("t") >= lookback)
    k = rng.random_control()(rules.seed_of(F.col("id"), F.col("t")), F.col("result"))["k"]
    return late.select(k.alias("k")).agg(F.avg("k").alias("observed_mean"), F.count(F.lit(1)).alias("trials")).select("observed_mean", F.lit(EXPECTED).alias("expected_mean"), F.abs(F.col("observed_mean") - EXPECTED).alias("difference"), "trials")


def label_permutation(table: DataFrame, lookback: int = 90, seed: int = 645) -> DataFrame:
    """Control E: tickets against permuted draws."""
    order = permutation.table(table.sparkSession, max(0, table.count() - lookback), seed).select((F.col("new") + lookback).alias("t"), (F.col("old") + lookback).alias("other_t"))
    own = walkforward.picks(table, lookback).join(order, "t")
    met = own.join(table.select(F.col("t").alias("other_t"), F.col("result").alias("other")), "other_t")
    each = F.array(*[F.struct(F.lit(r).alias("strategy"), rules.matches(F.col(r), F.col("result")).alias("k"), rules.matches(F.col(r), F.col("other")).alias("permuted")) for r in walkforward.RULES])
    rows = met.select(F.explode(each).alias("x")).select("x.*").groupBy("strategy").agg((F.avg("k") - EXPECTED).alias("true_edge"), (F.avg("permuted") - EXPECTED).alias("permuted_edge"))
    return rows.withColumn("collapsed", F.abs("permuted_edge") < 0.15)


def future_leak(table: DataFrame, lookback: int = 90) -> DataFrame:
    """Control F: a ticket that is the result itself, against the honest HOT ticket."""
    met = walkforward.picks(table, lookback, ("HOT",))
    sums = met.agg(F.count(F.lit(1)).alias("trials"), (F.avg(rules.matches(F.col("HOT"), F.col("result"))) - EXPECTED).alias("safe_edge"), F.avg(rules.matches(F.col("result"), F.col("result"))).alias("leaked_mean"), F.avg((rules.matches(F.col("result"), F.col("result")) == 6).cast("int")).alias("leaked_jackpot_rate"))
    leaked = F.col("leaked_mean") - EXPECTED
    return sums.withColumn("leaked_edge", leaked).withColumn("leak_detected", (F.col("leaked_mean") >= 5) & (leaked > F.col("safe_edge") + 1))


def all_controls(table: DataFrame, lookback: int = 90, seed: int = 645, replications: int = 25) -> DataFrame:
    """``control, value, threshold, passed``: five rows; too few draws give ``insufficient``."""
    spark = table.sparkSession
    table = settled(table, "draws")
    if table.count() <= lookback:
        return spark.createDataFrame([(c, None, None, None, True) for c in "ABCEF"], "control string, value double, threshold double, passed boolean, insufficient boolean")
    row = lambda name, df, value, threshold, passed: df.select(F.lit(name).alias("control"), value.cast("double").alias("value"), F.lit(threshold).cast("double").alias("threshold"), passed.alias("passed"), F.lit(False).alias("insufficient"))
    a = iid_pass_rates(spark, replications=replications, lookback=lookback, seed=seed).agg(F.max("pass_rate").alias("v"))
    b = time_shuffle(table, lookback, seed).agg(F.max(F.abs("shuffled_edge")).alias("v"), F.bool_and("collapsed").alias("ok"))
    e = label_permutation(table, lookback, seed).agg(F.max(F.abs("permuted_edge")).alias("v"), F.bool_and("collapsed").alias("ok"))
    out = row("A", a, F.col("v"), 0.3, F.col("v") <= 0.3)
    for part in (row("B", b, F.col("v"), None, F.col("ok")), row("C", random_baseline(table, lookback), F.col("difference"), 0.1, F.col("difference") <= 0.1), row("E", e, F.col("v"), 0.15, F.col("ok")), row("F", future_leak(table, lookback), F.col("leaked_edge"), None, F.col("leak_detected"))):
        out = out.unionByName(part)
    return out
