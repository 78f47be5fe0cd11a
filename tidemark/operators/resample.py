"""Seeded resampling: null distributions, sign flips, bootstraps.

One seed is one stream, and its values are a function of the counter, so a task can start
anywhere in it.  Work is dealt as (repetitions x block of rows) or as parts of the cycle that all
seeds share: a task draws its values and hands on sums, which are added up.  The result is that of one
sequential loop, as far as one period of the stream reaches; beyond it each repetition has a
seed of its own (``rng.unit_seeds``).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import rng, rules
from ..session import importable, settled

#: Values of flips or bootstraps, and simulated draws, of one task.
WORK, DRAWS = 1 << 28, 1 << 22
#: Differences of one block; numbers drawn together.
BLOCK, CHUNK = 1 << 18, 1 << 15
#: So many blocks in a row draw all bootstrap places together and keep their own.
REDRAWN = 16


def _ranges(spark: SparkSession, n: int, part: int) -> DataFrame:
    parts = -(-n // part)
    return spark.range(0, parts, 1, max(1, parts)).select((F.col("id") * part).alias("first"), F.least((F.col("id") + 1) * part, F.lit(n)).alias("last"))


def null_distribution(spark: SparkSession, draws: int, statistic: Callable[[np.ndarray], float], simulations: int = 2000, seed: int = 645) -> DataFrame:
    """``sim, value``: any statistic of simulated fair data sets, each an array of ``draws`` sorted tickets."""
    importable(spark)
    per = draws * (rules.POOL - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, last in zip(batch["first"], batch["last"]):
                for sim, start in enumerate(rng.unit_seeds(seed, simulations, per, first, last), first):
                    yield pd.DataFrame({"sim": [sim], "value": [float(statistic(rng.fair_tickets(start, draws)))]})

    return _ranges(spark, simulations, 25).mapInPandas(run, "sim bigint, value double")


NUMBERS = [f"n{i}" for i in range(1, rules.POOL + 1)]


def _rings(draws: int, simulations: int, seed: int) -> dict[int, tuple[np.ndarray, rng.Arcs]]:
    """Simulations and their tickets as arcs, for each ring of tickets.

    Tickets of one stream lie ``per`` values apart on the cycle of all states, which makes a ring for each remainder
    by the greatest common divisor of ``per`` and the period; all tickets that any seed can give lie on these.
    """
    per = rules.POOL - 1
    apart = math.gcd(per, rng.PERIOD)
    ring = rng.PERIOD // apart
    at = rng.cycle_places(rng.unit_seeds(seed, simulations, draws * per))
    nth = at // apart * pow(per // apart, -1, ring) % ring
    return {r: (own, rng.Arcs(nth[own], draws, ring)) for r in range(apart) if len(own := np.flatnonzero(at % apart == r))}


def null_counts(spark: SparkSession, draws: int, simulations: int = 2000, seed: int = 645) -> DataFrame:
    """``sim, n1 .. n45``: how often each number is drawn in each simulated data set.

    Tickets that several simulations share are drawn once, at most 2^32 for simulations of any number and length.
    """
    importable(spark)
    dealt = [(r, k, of) for r, (_, arcs) in _rings(draws, simulations, seed).items() for of in [-(-int(arcs.length.sum()) // DRAWS)] for k in range(of)]
    columns = ", ".join(f"{n} bigint" for n in NUMBERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings = _rings(draws, simulations, seed)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                r, k, of = dealt[i]
                met = list(rings[r][1].dealt(k, of))
                counts = np.array([rng.fair_counts(int(rng.states(0, 1, r)[0]), b - a, a) for _, a, b in met])
                yield pa.RecordBatch.from_arrays([pa.array([r] * len(met), pa.int64()), pa.array([piece for piece, _, _ in met]), *map(pa.array, counts.T)], ["ring", "piece", *NUMBERS])

    def spread(table: pa.Table) -> pa.Table:
        own, arcs = _rings(draws, simulations, seed)[table.column("ring")[0].as_py()]
        each = np.zeros((len(arcs.length), rules.POOL), np.int64)
        each[table.column("piece").to_numpy()] = np.stack([table.column(n).to_numpy() for n in NUMBERS], 1)
        return pa.table({"sim": pa.array(own), **dict(zip(NUMBERS, map(pa.array, arcs.sums(each).T)))})

    partial = spark.range(0, len(dealt), 1, max(1, len(dealt))).mapInArrow(run, f"ring bigint, piece bigint, {columns}")
    pieces = partial.groupBy("ring", "piece").agg(*[F.sum(n).alias(n) for n in NUMBERS])
    found = pieces.groupBy("ring").applyInArrow(spread, f"sim bigint, {columns}")  # twice as many pieces as simulations
    return spark.range(simulations).select(F.col("id").alias("sim")).join(found, "sim", "left").na.fill(0, NUMBERS)


def _squares() -> Column:
    out = F.lit(0).cast("long")
    for n in NUMBERS:
        out = out + F.col(n) * F.col(n)
    return out


def null_chi_square(spark: SparkSession, draws: int, simulations: int = 2000, seed: int = 645) -> DataFrame:
    """``sim, chi_square, squares`` of simulated fair data sets; with ``draws`` fixed, chi-square grows with the sum of squared counts."""
    expected = draws * rules.PICKS / rules.POOL
    statistic = F.lit(0.0)
    for n in NUMBERS:
        statistic = statistic + (F.col(n) - expected) * (F.col(n) - expected) / F.lit(expected or 1.0)
    return null_counts(spark, draws, simulations, seed).select("sim", statistic.alias("chi_square"), _squares().alias("squares"))


@udtf(returnType="t bigint, result array<int>")
class FairDraws:
    """``fair_draws(n, seed)``: tickets of one stream, a part at a time."""

    def eval(self, n: int, seed: int):
        for a in range(0, n, 20_000):
            for i, ticket in enumerate(rng.fair_tickets(seed, min(20_000, n - a), a).tolist()):
                yield a + i, ticket


def fairness(table: DataFrame, simulations: int = 2000, seed: int = 645) -> DataFrame:
    """Observed chi-square and its simulated p, each count one more than found.  Whole numbers are compared."""
    from .draws import chi_square, frequency

    spark = table.sparkSession
    seen = settled(frequency(table), "frequency")  # 45 rows, else counted twice
    facts = seen.agg(F.sum(F.col("count") * F.col("count")).cast("long").alias("own"), (F.sum("count") / rules.PICKS).cast("long").alias("draws")).first()  # one row
    null = null_chi_square(spark, facts["draws"], simulations, seed)
    p = null.agg(((F.count_if(F.col("squares") >= facts["own"]) + 1) / (simulations + 1)).alias("p_value"), F.count(F.lit(1)).alias("simulations"))
    return chi_square(seen).select(F.col("chi_square").alias("observed")).join(F.broadcast(p), how="cross")  # one row on either side


def flipped_sums(d: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sums of the rows of ``d`` with signs drawn from each start on (``starts x rows``; all rows share the signs)."""
    out, own = np.zeros((len(starts), len(d))), rng.states(0, d.shape[1], 1)
    wide, step = 4096, 16
    for a in range(0, d.shape[1], wide):
        some, at = np.ascontiguousarray(d[:, a : a + wide].T, np.float64), own[a : a + wide]
        for k in range(0, len(starts), step):
            with np.errstate(over="ignore"):
                # 1 and -1 for values below and from one half on
                out[k : k + step] -= rng.halves(starts[k : k + step, None] + at) @ some
    return out


def drawn_places(n: int, first: int, last: int) -> np.ndarray:
    """Which of ``n`` places the values at ``first`` .. ``last - 1`` of the cycle stand for."""
    with np.errstate(over="ignore"):
        state = _steps(last - first) + rng.states(0, 1, first)
    return (rng.mixed_bits(state) * (n / rng.PERIOD)).astype(np.int64)


@functools.cache
def _strides() -> np.ndarray:
    return rng.states(0, CHUNK)


def _steps(n: int) -> np.ndarray:
    return _strides()[:n] if n <= CHUNK else rng.states(0, n)


def sign_flip_sums(deltas: np.ndarray, seed: int, first: int, last: int, iterations: int | None = None) -> np.ndarray:
    return flipped_sums(deltas[None], rng.unit_seeds(seed, iterations or last, len(deltas), first, last))[:, 0]


def bootstrap_sums(deltas: np.ndarray, seed: int, first: int, last: int, iterations: int | None = None) -> np.ndarray:
    n = len(deltas)
    return np.array([deltas[drawn_places(n, k + 1, k + 1 + n)].sum() for k in rng.cycle_places(rng.unit_seeds(seed, iterations or last, n, first, last))])


def bounds(iterations: int) -> tuple[int, int]:
    """Places of the 2.5 and 97.5 per cent values among the sorted means."""
    return max(0, int(0.025 * iterations)), min(iterations - 1, -int(-0.975 * iterations // 1) - 1)


def sign_flip(deltas: np.ndarray, seed: int, iterations: int = 10_000) -> dict:
    n = max(1, len(deltas))
    mean = float(deltas.sum()) / n
    means = np.sort(sign_flip_sums(deltas, seed, 0, iterations) / n)
    low, high = bounds(iterations)
    return {"mean_delta": mean, "null_low": float(means[low]), "null_high": float(means[high]), "p_value": min(1.0, float((np.abs(means) >= abs(mean)).sum()) / iterations)}


def bootstrap(deltas: np.ndarray, seed: int, iterations: int = 10_000) -> tuple[float, float]:
    if not len(deltas):
        return 0.0, 0.0
    means = np.sort(bootstrap_sums(deltas, seed, 0, iterations) / len(deltas))
    low, high = bounds(iterations)
    return float(means[low]), float(means[high])


def in_series(deltas: DataFrame, key: str) -> DataFrame:
    """Blocks of at most ``BLOCK`` differences in the order of ``t`` (distinct in a key): ``key, blk, offset, n, total, d``."""
    blocks = deltas.groupBy(key, F.expr(f"t div {BLOCK}").alias("blk")).agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "d"))), lambda x: x["d"].cast("double")).alias("d"))
    blocks = settled(blocks, "blocks")  # else the differences are computed once more for the sizes
    sizes = blocks.select(key, "blk", F.size("d").cast("long").alias("m"), F.aggregate("d", F.lit(0.0), lambda a, x: a + x).alias("s"))
    # a row a block: a key's blocks are numbered by running sums
    before = Window.partitionBy(key).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    each = Window.partitionBy(key)
    placed = sizes.select(key, "blk", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"), F.sum("m").over(each).alias("n"), F.sum("s").over(each).alias("total"))
    return blocks.join(placed, [key, "blk"]).select(key, "blk", "offset", "n", "total", "d")


def _shares(spark: SparkSession, values: Column, rows: int) -> tuple[Column, int]:
    """In how many shares a row's work of ``values`` is dealt, and to how many partitions: ``WORK`` values each, but no more copies of rows than keep all cores busy."""
    busy = 4 * spark.sparkContext.defaultParallelism
    copies = max(1, -(-busy // max(1, rows)))
    return F.least(F.greatest(F.lit(1), F.ceil(values / F.lit(float(WORK)))), F.lit(copies)).cast("long"), max(busy, min(rows, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _shared(rows: DataFrame, shares: Column) -> DataFrame:
    """Each row once for each of its ``shares`` (``share``: from 0)."""
    return rows.withColumn("shares", shares).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))


def paired(deltas: DataFrame, key: str, seed: int, iterations: int = 10_000) -> DataFrame:
    """Sign-flip test and bootstrap interval of ``d`` (in the order of ``t``) for each value of ``key``."""
    spark = deltas.sparkSession
    importable(spark)
    series = settled(in_series(deltas, key), "series")
    flip, boot = _flipped(series, key, seed, iterations), _drawn(series, key, seed, iterations)
    sums = flip.select(key, "iteration", "flip", F.lit(None).cast("double").alias("boot")).unionByName(boot.select(key, "iteration", F.lit(None).cast("double").alias("flip"), "boot"))
    means = sums.groupBy(key, "iteration").agg(F.sum("flip").alias("flip"), F.sum("boot").alias("boot")).join(series.groupBy(key).agg(F.first("n").alias("n"), F.first("total").alias("total")), key)
    means = means.select(key, (F.col("total") / F.col("n")).alias("mean_delta"), (F.col("flip") / F.col("n")).alias("flip"), (F.col("boot") / F.col("n")).alias("boot"))
    low, high = bounds(iterations)
    sorted_flip, sorted_boot = F.sort_array(F.collect_list("flip")), F.sort_array(F.collect_list("boot"))  # as many as iterations
    return means.groupBy(key).agg(
        F.first("mean_delta").alias("mean_delta"), F.get(sorted_flip, F.lit(low)).alias("null_low"), F.get(sorted_flip, F.lit(high)).alias("null_high"),
        F.least(F.lit(1.0), F.count_if(F.abs("flip") >= F.abs("mean_delta")) / F.lit(float(iterations))).alias("flip_p"),
        F.get(sorted_boot, F.lit(low)).alias("boot_low"), F.get(sorted_boot, F.lit(high)).alias("boot_high"),
    )


def _flipped(series: DataFrame, key: str, seed: int, iterations: int) -> DataFrame:
    """``key, iteration, flip``: sums under signs, each block by itself."""
    spark, kind = series.sparkSession, dict(series.dtypes)[key]
    # keys with series alike draw the same values; they are drawn once
    alike = series.groupBy("n", "offset", F.size("d").alias("m")).agg(F.collect_list(F.struct(F.col(key).alias("key"), "d")).alias("rows"))  # as many as keys
    shares, parts = _shares(spark, F.col("m") * F.lit(float(iterations)), series.select("n", "offset").distinct().count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for offset, n, rows, share, of in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2), *(c.to_pylist() for c in batch.columns[3:])):
                first, last = (iterations * k // of for k in (share, share + 1))
                starts, keys = rng.unit_seeds(seed, iterations, n, first, last), rows.values.field("key")
                own = rows.values.field("d").flatten().to_numpy().reshape(len(keys), -1)
                with np.errstate(over="ignore"):
                    flip = flipped_sums(own, starts + rng.STEP * np.uint32(offset % rng.PERIOD))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.tile(np.arange(len(keys)), len(starts)))), pa.array(np.repeat(np.arange(first, last), len(keys))), pa.array(flip.ravel())], [key, "iteration", "flip"])

    dealt = _shared(alike, shares).select("offset", "n", "rows", "share", "shares").repartition(parts)
    return dealt.mapInArrow(run, f"{key} {kind}, iteration bigint, flip double")


def _arcs(n: int, seed: int, iterations: int) -> rng.Arcs:
    """The values of all bootstraps of ``n`` places, on the cycle of all states."""
    return rng.Arcs(rng.cycle_places(rng.unit_seeds(seed, iterations, n)) + 1, n, rng.PERIOD)


def _drawn(series: DataFrame, key: str, seed: int, iterations: int) -> DataFrame:
    """``key, iteration, boot``: sums over bootstraps.

    Which place a value stands for depends on where the value lies on the cycle of all states and on ``n``
    alone, so a repetition's sum is one over an arc of this cycle.  Places that arcs share are drawn
    once, at most one period for all repetitions of any length.  ``REDRAWN`` blocks in a row draw them together,
    and each such group keeps its own.
    """
    spark, kind = series.sparkSession, dict(series.dtypes)[key]
    grouped = series.withColumn("together", F.expr(f"blk div {REDRAWN}"))
    values = F.least(F.col("n") * F.lit(float(iterations)), F.lit(float(rng.PERIOD)))
    shares, parts = _shares(spark, values, grouped.select("n", "together").distinct().count())

    def draw(table: pa.Table) -> pa.Table:
        n, share, of = (table.column(c)[0].as_py() for c in ("n", "share", "shares"))
        names = table.column(key).combine_chunks().dictionary_encode()
        offset, held = table.column("offset").to_numpy(), table.column("d").combine_chunks()
        code, values, ends = names.indices.to_numpy(), held.flatten().to_numpy(), np.cumsum(held.value_lengths().to_numpy())
        lists = np.split(values, ends[:-1])
        # the keys of each range of places, side by side
        ranges: dict[tuple[int, int], list[int]] = {}
        rows = [np.flatnonzero(code == k) for k in range(len(names.dictionary))]
        rows = [r[np.argsort(offset[r])] for r in rows]
        for k, r in enumerate(rows):
            ranges.setdefault((int(offset[r[0]]), sum(len(lists[i]) for i in r)), []).append(k)
        wide = [(low, m, keys, np.stack([np.concatenate([lists[i] for i in rows[k]]) for k in keys], 1)) for (low, m), keys in ranges.items()]
        pieces, sums, found, one = [], [], [np.empty((CHUNK, len(keys))) for _, _, keys, _ in wide], np.ones(CHUNK)
        for piece, first, last in _arcs(n, seed, iterations).dealt(share, of):
            total = np.zeros(len(rows))
            for a in range(first, last, CHUNK):
                at = drawn_places(n, a, min(last, a + CHUNK))
                for (low, m, keys, d), out in zip(wide, found):
                    here = at if m == n else at - low
                    here = here if m == n else here[here.view(np.uint64) < m]
                    total[keys] += one[: len(here)] @ d.take(here, 0, out[: len(here)], "clip")
            pieces.append(piece)
            sums.append(total)
        each = pa.array(np.tile(np.arange(len(rows)), len(pieces)))
        return pa.table({key: names.dictionary.take(each), "n": pa.array(np.full(len(each), n)), "piece": pa.array(np.repeat(np.array(pieces, np.int64), len(rows))), "boot": pa.array(np.concatenate([np.zeros(0), *sums]))})

    def spread(table: pa.Table) -> pa.Table:
        arcs = _arcs(table.column("n")[0].as_py(), seed, iterations)
        each = np.zeros((len(arcs.length), 1))
        each[table.column("piece").to_numpy(), 0] = table.column("boot").to_numpy()
        boot = arcs.sums(each)[:, 0]
        return pa.table({key: pa.array([table.column(key)[0].as_py()] * len(boot), table.column(key).type), "iteration": pa.array(np.arange(len(boot))), "boot": pa.array(boot)})

    by = ["n", "together", "share"]
    dealt = _shared(grouped, shares).select(*by, "shares", key, "offset", "d").repartition(2 * parts, *by)
    pieces = dealt.groupBy(*by).applyInArrow(draw, f"{key} {kind}, n bigint, piece bigint, boot double")
    summed = pieces.groupBy(key, "n", "piece").agg(F.sum("boot").alias("boot"))
    return summed.groupBy(key, "n").applyInArrow(spread, f"{key} {kind}, iteration bigint, boot double")  # as many rows as twice the iterations
