"""Leak-safe walk-forward tests of selection rules.

History of a target row t is the ``lookback`` rows before it.  The table is cut into
blocks of consecutive rows; a block also gets the last ``lookback`` rows of the one before,
so one shuffle by block, one row a draw, puts all that a target needs in one place.  There
the counts of all 45 numbers are differences of running sums, and the rules rank them row
by row, over Arrow batches of a sorted block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rng, rules, stats
from ..session import importable, settled

BLOCK = 2048
RULES = ("HOT", "COLD", "BALANCED")
POOL_RULES = ("HOT18", "COLD18", "OVERDUE18", "BALANCED18")


def in_blocks(table: DataFrame, position: str, halo: int, keys: tuple[str, ...] = (), block: int | None = None) -> DataFrame:
    """Each row with ``blk`` and ``own``; the last ``halo`` rows of a block come once more, not own, with the next."""
    size = max(block or BLOCK, halo)
    b = F.col(position).cast("long")
    here = F.expr(f"{position} div {size}")
    repeats = F.when(F.pmod(b, F.lit(size)) >= size - halo, F.array(F.struct(here.alias("blk"), F.lit(True).alias("own")), F.struct((here + 1).alias("blk"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(here.alias("blk"), F.lit(True).alias("own"))))
    out = table.withColumn("_b", F.explode(repeats)).select("*", "_b.blk", "_b.own").drop("_b")
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(parts, *keys, "blk")


def _histories(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], lookback: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Own rows with a full history, and for these the counts and gaps of all numbers (``rows x 45``).

    Batches come sorted by keys, block and t; the last ``lookback`` rows are carried from one to the next.
    """
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        fresh = 0 if held is None else len(held)
        rows = rows if held is None else pa.concat_tables([held, rows])
        held = rows.slice(max(0, len(rows) - lookback))
        new = np.zeros(len(rows), bool)
        if len(rows):
            new[0] = True
        for c in (*keys, "blk"):
            v = rows.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(new)
        for a, b in zip(starts, [*starts[1:], len(rows)]):
            if b <= fresh:
                continue
            part = rows.slice(a, b - a).combine_chunks().to_batches()[0]
            sizes = pc.fill_null(pc.list_value_length(part.column("result")), 0).to_numpy(zero_copy_only=False)
            if (sizes != rules.PICKS).any():
                raise ValueError(f"row t = {part.column('t')[int(np.argmax(sizes != rules.PICKS))]} has no {rules.PICKS} numbers")
            drawn = part.column("result").flatten().to_numpy().reshape(-1, rules.PICKS)
            hit = np.zeros((b - a, rules.POOL), np.int32)
            hit[np.arange(b - a)[:, None], drawn - 1] = 1
            upto = np.concatenate((np.zeros((1, rules.POOL), np.int32), np.cumsum(hit, 0, dtype=np.int32)))
            last = np.maximum.accumulate(np.where(hit, np.arange(b - a)[:, None], -lookback - 1), 0)
            own = part.column("own").to_numpy(zero_copy_only=False) & (part.column("t").to_numpy() >= lookback)
            own[: max(0, fresh - a)] = False
            i = np.flatnonzero(own)
            if len(i):
                count = upto[i] - upto[np.maximum(i - lookback, 0)]
                gap = np.minimum((i - 1)[:, None] - last[i - 1], lookback)
                yield part.take(pa.array(i)), count, gap


def _in_order(table: DataFrame, lookback: int, keys: tuple[str, ...], carry: tuple[str, ...] = ()) -> DataFrame:
    importable(table.sparkSession)
    return in_blocks(table.select(*keys, "t", "result", *carry), "t", lookback, keys).sortWithinPartitions(*keys, "blk", "t")


def _schema(table: DataFrame, keys: tuple[str, ...], *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*(table.schema[k] for k in keys), *(T.StructField(n, t) for n, t in more)])


def rolling(table: DataFrame, lookback: int = 90, keys: tuple[str, ...] = ()) -> DataFrame:
    """``blk, t, num, count, gap`` of every target with a full history (and ``keys``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, count, gap in _histories(batches, keys, lookback):
            each = pa.array(np.repeat(np.arange(len(rows)), rules.POOL))
            num = np.tile(np.arange(1, rules.POOL + 1, dtype=np.int32), len(rows))
            cells = [rows.column(c).take(each) for c in (*keys, "blk", "t")]
            yield pa.RecordBatch.from_arrays([*cells, pa.array(num), pa.array(count.ravel().astype(np.int32)), pa.array(gap.ravel().astype(np.int32))], [*keys, "blk", "t", "num", "count", "gap"])

    fields = [("blk", T.LongType()), ("t", T.LongType()), ("num", T.IntegerType()), ("count", T.IntegerType()), ("gap", T.IntegerType())]
    return _in_order(table, lookback, keys).mapInArrow(run, _schema(table, keys, *fields))


def _least(key: np.ndarray, k: int) -> np.ndarray:
    """The numbers of the ``k`` least keys of each row, the smaller number first among equals."""
    ranked = key.astype(np.int64) * 64 + np.arange(key.shape[1])
    return np.sort(np.partition(ranked, k - 1, 1)[:, :k] % 64, 1)


def pick(count: np.ndarray, gap: np.ndarray, rule: str, lookback: int, k: int) -> np.ndarray:
    """Each row's numbers by a rule, ascending."""
    if rule.startswith("HOT"):
        return _least(lookback - count, k) + 1
    if rule.startswith("COLD"):
        return _least(count * (lookback + 1) + lookback - gap, k) + 1
    if rule.startswith("OVERDUE"):
        return _least(lookback - gap, k) + 1
    # |deltaPercent| orders as |45 count - 6 lookback|, in whole numbers; three bands of fifteen numbers
    even = np.abs(count * rules.POOL - rules.PICKS * lookback)
    return np.concatenate([_least(even[:, a : a + 15], k // 3) + a + 1 for a in (0, 15, 30)], 1)


def picks(table: DataFrame, lookback: int = 90, names: tuple[str, ...] = RULES, k: int = rules.PICKS, keys: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """``t, result``, the columns of ``carry`` and an ``array<int>`` for each rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, count, gap in _histories(batches, keys, lookback):
            lists = []
            for name in names:
                numbers = pick(count, gap, name, lookback, k).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * numbers.shape[1]), pa.array(numbers.ravel())))
            yield pa.RecordBatch.from_arrays([rows.column(c) for c in (*keys, "t", "result", *carry)] + lists, [*keys, "t", "result", *carry, *names])

    fields = [("t", T.LongType()), ("result", T.ArrayType(T.IntegerType())), *((c, table.schema[c].dataType) for c in carry), *((n, T.ArrayType(T.IntegerType())) for n in names)]
    return _in_order(table, lookback, keys, carry).mapInArrow(run, _schema(table, keys, *fields))


def series(table: DataFrame, lookback: int = 90, control: str = "RANDOM", keys: tuple[str, ...] = ()) -> DataFrame:
    """LONG: ``t, date, strategy, k, hit3, payout, control_k, control_payout``; null payouts count 0."""
    wide = picks(table, lookback, keys=keys, carry=("id", "date"))

    # matches in columns of their own, each computed once
    wide = wide.withColumns({f"_k_{n}": rules.matches(F.col(n), F.col("result")) for n in RULES})

    def scored(name: str) -> Column:
        k = F.col(f"_k_{name}")
        return F.struct(F.lit(name).alias("strategy"), k.cast("double").alias("k"), (k >= 3).cast("double").alias("hit3"), F.coalesce(rules.payout(k), F.lit(0)).cast("double").alias("payout"))

    each = [scored(n) for n in RULES]
    if control == "RANDOM":
        wide = wide.withColumn("_r", rng.random_control()(rules.seed_of(F.col("id"), F.col("t")), F.col("result")))
        each.append(F.struct(F.lit("RANDOM").alias("strategy"), F.col("_r.k").alias("k"), F.col("_r.hit3").alias("hit3"), F.col("_r.payout").alias("payout")))
    base = each[-1] if control == "RANDOM" else scored(control)
    wide = wide.select(*keys, "t", "date", F.array(*each).alias("all"), base.alias("base"))
    # places of the array and not its values are exploded: Spark would check the array for being empty first, and for that compute all it holds once more
    placed = wide.select(*keys, "t", "date", "all", "base", F.explode(F.array(*map(F.lit, range(len(each))))).alias("_i"))
    long = placed.select(*keys, "t", "date", F.get("all", "_i").alias("s"), "base")
    return long.select(*keys, "t", "date", "s.strategy", "s.k", "s.hit3", "s.payout", F.col("base.k").alias("control_k"), F.col("base.payout").alias("control_payout"))


def with_phases(scores: DataFrame, trials: int, lookback: int) -> DataFrame:
    """``phase`` by position: 50 / 25 / 25 per cent, with the edge rules of short series."""
    i = F.col("t") - lookback
    train = max(1, trials // 2)
    valid = min(max(train + 1, trials * 3 // 4), trials - 1)
    if trials < 3:
        return scores.withColumn("phase", F.lit(None).cast("string")).where(F.lit(False))
    return scores.withColumn("phase", F.when(i < train, "DEVELOPMENT").when(i < valid, "VALIDATION").otherwise("TEST"))


def hac(differences: DataFrame, keys: list[str], lookback: int, most: int) -> DataFrame:
    """``keys, n, mean, naive_se, hac, lag, se`` of ``d`` over consecutive ``i``: Bartlett weights, lags up to floor(cbrt n).

    ``most`` bounds the rows of one key, and so the lags looked at.  Products at all lags are
    columns of one window over blocks with a halo, and are summed before they are moved.
    """
    far = 1
    while (far + 1) ** 3 <= most:
        far += 1
    far = max(1, min(far, lookback - 1))
    moments = differences.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("sd"))
    moments = moments.withColumn("lag", stats.hac_lag(F.col("n"), lookback))
    centred = differences.join(F.broadcast(moments.select(*keys, "mean")), keys).select(*keys, "i", (F.col("d") - F.col("mean")).alias("c"))  # a row for each key
    blocks = in_blocks(centred, "i", far, tuple(keys))
    before = Window.partitionBy(*keys, "blk").orderBy("i")
    products = blocks.select(*keys, "own", (F.col("c") * F.col("c")).alias("g0"), *[(F.col("c") * F.lag("c", k).over(before)).alias(f"g{k}") for k in range(1, far + 1)]).where("own")
    sums = products.groupBy(*keys).agg(*[F.coalesce(F.sum(f"g{k}"), F.lit(0.0)).alias(f"g{k}") for k in range(far + 1)])
    gamma = sums.select(*keys, F.posexplode(F.array(*[f"g{k}" for k in range(far + 1)])).alias("lag_k", "g"))
    weighted = gamma.join(F.broadcast(moments.select(*keys, "n", "lag")), keys).where(F.col("lag_k") <= F.least("lag", F.col("n") - 1))
    weight = F.when(F.col("lag_k") == 0, 1.0).otherwise(2 * (1 - F.col("lag_k") / (F.least("lag", F.col("n") - 1) + 1)))
    long_run = weighted.groupBy(*keys).agg(F.sum(weight * F.col("g") / F.col("n")).alias("long_run"))
    out = moments.join(F.broadcast(long_run), keys)
    naive = F.col("sd") / F.sqrt(F.col("n").cast("double"))
    robust = F.when(F.col("n") < 2, 0.0).otherwise(F.sqrt(F.greatest("long_run", F.lit(0.0)) / F.col("n")))
    return out.select(*keys, "n", "mean", naive.alias("naive_se"), robust.alias("hac"), "lag", F.greatest(naive, robust).alias("se"))


def summary(scores: DataFrame, lookback: int, most: int, keys: list[str], control: str, alpha: float = 0.05) -> DataFrame:
    """One row a key and strategy: means, payouts, cost, edge, z, half edges and the three gates."""
    by = [*keys, "strategy"]
    bounds = scores.groupBy(*by).agg(F.min("t").alias("first"), F.count(F.lit(1)).alias("trials"))
    marked = scores.join(F.broadcast(bounds), by).withColumn("i", F.col("t") - F.col("first")).withColumn("early", F.col("i") < F.floor(F.col("trials") / 2))
    d = F.col("k") - F.col("control_k")
    capped = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(float(rules.ROBUST_CAP)))
    half = lambda early: F.coalesce(F.avg(F.when(F.col("early") == early, F.col("k"))), F.lit(0.0)) - F.coalesce(F.avg(F.when(F.col("early") == early, F.col("control_k"))), F.lit(0.0))
    sums = marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trials"), F.avg("k").alias("average_matches"), (F.avg("hit3") * 100).alias("hit3_rate_pct"),
        F.sum("payout").alias("payout"), F.sum(capped("payout")).alias("robust_payout"), F.sum(capped("control_payout")).alias("control_robust_payout"),
        (F.avg("k") - F.avg("control_k")).alias("edge"), half(True).alias("first_half_edge"), half(False).alias("second_half_edge"),
    )
    errors = hac(marked.select(*by, "i", d.alias("d")), by, lookback, most).select(*by, "mean", "se")
    z = F.when(F.col("se") == 0, 0.0).otherwise(F.col("mean") / F.col("se"))
    is_control = F.col("strategy") == control
    cost = (F.col("trials") * rules.TICKET_PRICE).cast("long")
    out = sums.join(errors, by).withColumn("z", z).withColumn("cost", cost)
    out = out.withColumn("p_value", F.when(is_control, 1.0).otherwise(stats.one_sided_p(F.col("z"))))
    out = out.withColumn("roi_pct", F.when(F.col("cost") == 0, 0.0).otherwise((F.col("payout") - F.col("cost")) / F.col("cost") * 100))
    out = out.withColumn("significant", ~is_control & (F.col("p_value") <= alpha))
    out = out.withColumn("stable_halves", ~is_control & (F.col("first_half_edge") > 0) & (F.col("second_half_edge") > 0))
    out = out.withColumn("beats_control_payout", ~is_control & (F.col("robust_payout") > F.col("control_robust_payout")))
    out = out.withColumn("gates_passed", F.col("significant").cast("int") + F.col("stable_halves").cast("int") + F.col("beats_control_payout").cast("int"))
    return out.withColumn("ci95_low", F.col("edge") - 1.96 * F.col("se")).withColumn("ci95_high", F.col("edge") + 1.96 * F.col("se"))


def holm(items: DataFrame, keys: list[str], family: Column | int, order: list[str]) -> DataFrame:
    """``adjusted_p``: running maximum of min(1, p * (m - rank)); ``order`` breaks ties of p."""
    family = F.lit(family) if isinstance(family, int) else family
    sizes = Window.partitionBy(*keys)
    ranked = Window.partitionBy(*keys).orderBy("p_value", *order)
    m = F.greatest(family, F.count(F.lit(1)).over(sizes))
    stepped = items.withColumn("_step", F.least(F.lit(1.0), F.col("p_value") * (m - F.row_number().over(ranked) + 1)))
    return stepped.withColumn("adjusted_p", F.max("_step").over(ranked.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def select_candidate(validation: DataFrame, alpha: float) -> DataFrame:
    """At most one row, by adjusted p, then edge; RANDOM never."""
    fit = validation.where((F.col("strategy") != "RANDOM") & (F.col("edge") > 0) & (F.coalesce("adjusted_p", F.lit(1.0)) <= alpha))
    return fit.orderBy("adjusted_p", F.desc("edge"), "strategy").limit(1)


def control_first(rows: DataFrame, control: str = "RANDOM") -> DataFrame:
    """Rows of one phase with their place in a table that has the control on top."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("phase").orderBy(F.col("strategy") != control, "strategy"))).orderBy("nth")


def report_rows(table: DataFrame, lookback: int = 90, alpha: float = 0.05, family: int | None = None, look: int = 1, control: str = "RANDOM") -> DataFrame:
    """One row a phase and strategy, with Holm-adjusted p within each phase."""
    table = settled(table, "draws")
    trials = max(0, table.count() - lookback)
    spent = stats.spent_alpha_py(look, alpha)
    scores = settled(with_phases(series(table, lookback, control), trials, lookback), "scores")  # read by every sum below
    rows = summary(scores, lookback, trials, ["phase"], control, alpha)
    own = holm(rows.where(F.col("strategy") != control), ["phase"], family or (len(RULES) - (control in RULES)), ["strategy"])
    both = own.unionByName(rows.where(F.col("strategy") == control).withColumn("adjusted_p", F.lit(None).cast("double")))
    return both.withColumn("significant_corrected", F.coalesce((F.col("edge") > 0) & (F.col("adjusted_p") <= spent), F.lit(False)))


def reliability(rows: DataFrame, alpha: float, control: str = "RANDOM") -> DataFrame:
    """One row a strategy: chosen on VALIDATION only, confirmed or not on TEST."""
    chosen = select_candidate(rows.where("phase = 'VALIDATION'"), alpha).select(F.col("strategy").alias("chosen"))
    value = lambda phase, c: F.max(F.when(F.col("phase") == phase, F.col(c)))
    each = rows.where(F.col("strategy") != control).groupBy("strategy").agg(
        value("VALIDATION", "edge").alias("validation_edge"), value("VALIDATION", "adjusted_p").alias("validation_adjusted_p"),
        value("TEST", "edge").alias("test_edge"), value("TEST", "adjusted_p").alias("test_adjusted_p"),
        value("TEST", "ci95_low").alias("test_ci95_low"), value("TEST", "ci95_high").alias("test_ci95_high"), value("TEST", "significant_corrected").alias("test_significant"),
    )
    met = each.join(F.broadcast(chosen), each["strategy"] == chosen["chosen"], "left")  # one row at most
    selected = F.col("chosen").isNotNull()
    signal = selected & F.coalesce("test_significant", F.lit(False)) & (F.coalesce("test_ci95_low", F.lit(0.0)) > 0)
    return met.select("strategy", selected.alias("selected_on_validation"), "validation_edge", "validation_adjusted_p", "test_edge", "test_adjusted_p", "test_ci95_low", "test_ci95_high", F.when(signal, "HOLDOUT_SIGNAL").when(selected, "VALIDATION_ONLY").otherwise("NO_EDGE").alias("verdict"))


def ablation(rows: DataFrame, alpha: float, control: str = "RANDOM", family: int = 3) -> DataFrame:
    """Holm again without each strategy in turn; edges do not change."""
    base = rows.where((F.col("strategy") != control) & F.col("phase").isin("VALIDATION", "TEST")).select("phase", "strategy", "edge", "p_value", F.col("adjusted_p").alias("full_adjusted_p"))
    without = base.withColumn("removed", F.explode(F.array_remove(F.lit(list(RULES)), F.col("strategy"))))
    again = holm(without, ["removed", "phase"], max(family - 1, 2), ["strategy"])
    flips = (F.col("edge") > 0) & (F.col("adjusted_p") <= alpha) & (F.col("full_adjusted_p") > alpha)
    return again.select("removed", "phase", "strategy", "edge", F.lit(0.0).alias("delta_edge"), "full_adjusted_p", "adjusted_p", flips.alias("newly_significant"))
