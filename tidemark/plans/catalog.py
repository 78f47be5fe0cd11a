"""Queries by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exact, hashing, numeric, rng, rules, stats
from ..operators import controls, draws, merge, pool18, portfolio, provenance, resample, walkforward
from ..sources import html, jsonl
from ..session import settled
from ..streaming import limits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
LOOKBACK = 90


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def all_draws(spark: SparkSession, d: str) -> DataFrame:
    return draws.draws(table(spark, d, "orders"))


def text(c) -> "F.Column":
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


DRAWS = """
WITH draws AS (
  SELECT CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS t,
         lpad(CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS VARCHAR), 8, '0') AS id,
         CAST(o_orderdate AS DATE) AS date,
         list_sort(list_transform(list_sort(list_transform(range(1, 46), lambda n:
           {'k': ((o_orderkey + 1) * (n * 7919 + 104729) + o_custkey * n * 31) % 1000003, 'n': n}))[1:6], lambda x: x.n)) AS result
  FROM orders)"""
ROLLING = DRAWS + """,
cells AS (
  SELECT t, num, CAST(list_contains(result, num) AS INT) AS hit FROM draws, (SELECT unnest(range(1, 46)) AS num)),
rolling AS (
  SELECT t, num, count, gap FROM (
    SELECT t, num, CAST(sum(hit) OVER w AS BIGINT) AS count,
           coalesce(t - 1 - max(CASE WHEN hit = 1 THEN t END) OVER w, 90) AS gap
    FROM cells WINDOW w AS (PARTITION BY num ORDER BY t ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING))
  WHERE t >= 90)"""
RANKED = ROLLING + """,
ranked AS (
  SELECT t, num,
    row_number() OVER (PARTITION BY t ORDER BY count DESC, num) AS hot,
    row_number() OVER (PARTITION BY t ORDER BY count, gap DESC, num) AS cold,
    row_number() OVER (PARTITION BY t ORDER BY gap DESC, num) AS overdue,
    row_number() OVER (PARTITION BY t, (num - 1) // 15 ORDER BY abs(45 * count - 540), num) AS balanced
  FROM rolling),
picks AS (
  SELECT t, list_sort(list(num) FILTER (hot <= 6)) AS HOT, list_sort(list(num) FILTER (cold <= 6)) AS COLD,
         list_sort(list(num) FILTER (balanced <= 2)) AS BALANCED,
         list_sort(list(num) FILTER (hot <= 18)) AS HOT18, list_sort(list(num) FILTER (cold <= 18)) AS COLD18,
         list_sort(list(num) FILTER (overdue <= 18)) AS OVERDUE18, list_sort(list(num) FILTER (balanced <= 6)) AS BALANCED18
  FROM ranked GROUP BY t)"""
_PAY = "CASE k WHEN 3 THEN 30000 WHEN 4 THEN 300000 WHEN 5 THEN 10000000 ELSE 0 END"
_M = "4294967295::UBIGINT"


def sql_swaps(seed: str, first: str = "0") -> str:
    """The swaps of one seeded shuffle of 45 numbers, last first, as ``i * 64 + j``; ``first`` values of the stream are skipped."""
    state = f"list_transform(range(1, 45), lambda c: ({seed} + (c + {first})::UBIGINT * 1831565813) & {_M})"
    once = f"list_transform({state}, lambda s: (xor(s, s >> 15) * (s | 1)) & {_M})"
    twice = f"list_transform({once}, lambda x: xor((x + ((xor(x, x >> 7) * (x | 61)) & {_M})) & {_M}, x))"
    return f"list_reverse(list_transform({twice}, lambda x, k: ((45 - k) * 64 + ((xor(x, x >> 14) * (46 - k)::UBIGINT) >> 32)::BIGINT)))"


def sql_ticket(swaps: str, size: int = 6) -> str:
    """Where the first ``size`` places of the shuffle come from: each is followed back through the swaps."""
    return f"list_sort(list_transform(range(0, {size}), lambda p: 1 + list_reduce(list_prepend(p, {swaps}), lambda a, x: CASE WHEN a = x // 64 THEN x % 64 WHEN a = x % 64 THEN x // 64 ELSE a END)))"


_RULE_SERIES = f"""
  SELECT t, strategy, k, CAST(k >= 3 AS INT) AS hit3, {_PAY} AS payout FROM (
    SELECT d.t, 'HOT' AS strategy, len(list_intersect(HOT, result)) AS k FROM draws d JOIN picks USING (t)
    UNION ALL SELECT d.t, 'COLD', len(list_intersect(COLD, result)) FROM draws d JOIN picks USING (t)
    UNION ALL SELECT d.t, 'BALANCED', len(list_intersect(BALANCED, result)) FROM draws d JOIN picks USING (t))"""
_PAIRED = """,
paired AS (SELECT s.*, c.k AS ck, c.payout AS cp, s.t - 90 AS i FROM series s JOIN series c ON c.t = s.t AND c.strategy = 'COLD')"""
SERIES = RANKED + f""",
series AS ({_RULE_SERIES})""" + _PAIRED
#: The mean of 32 seeded tickets a draw as one more strategy, and as control.
RANDOM = RANKED + f""",
swapped AS (SELECT t, result, {sql_swaps("w")} AS swaps FROM (SELECT t, result, ((t + 1) * 131 + unnest(range(0, 32)))::UBIGINT AS w FROM draws WHERE t >= 90)),
control AS (SELECT t, CAST(avg(k) AS DOUBLE) AS k, CAST(avg(CAST(k >= 3 AS INT)) AS DOUBLE) AS hit3, CAST(avg({_PAY}) AS DOUBLE) AS payout
            FROM (SELECT t, len(list_intersect({sql_ticket("swaps")}, result)) AS k FROM swapped) GROUP BY t),
series AS ({_RULE_SERIES}
  UNION ALL SELECT t, 'RANDOM', k, hit3, payout FROM control)""" + _PAIRED.replace("'COLD'", "'RANDOM'")
_PHASES = """,
size AS (SELECT count(*) - 90 AS n FROM draws),
cuts AS (SELECT n, greatest(1, n // 2) AS a, least(greatest(greatest(1, n // 2) + 1, n * 3 // 4), n - 1) AS b FROM size),
phased AS (SELECT p.*, CASE WHEN i < a THEN 'DEVELOPMENT' WHEN i < b THEN 'VALIDATION' ELSE 'TEST' END AS phase FROM paired p, cuts),
placed AS (SELECT *, row_number() OVER (PARTITION BY phase, strategy ORDER BY t) - 1 AS j,
                  count(*) OVER (PARTITION BY phase, strategy) AS n,
                  k - ck - avg(k - ck) OVER (PARTITION BY phase, strategy) AS c FROM phased),
lags AS (SELECT *, CASE WHEN n < 2 THEN 0 ELSE least(89, greatest(1, CAST(floor(cbrt(n) + 1e-9) AS BIGINT))) END AS lag FROM placed),
gammas AS (
  SELECT a.phase, a.strategy, x.k AS lag_k, any_value(a.n) AS n, any_value(a.lag) AS lag, sum(a.c * b.c) / any_value(a.n) AS g
  FROM lags a, (SELECT unnest(range(0, 90)) AS k) x, lags b
  WHERE x.k <= least(a.lag, a.n - 1) AND b.phase = a.phase AND b.strategy = a.strategy AND b.j = a.j - x.k GROUP BY 1, 2, 3),
hac AS (SELECT phase, strategy, sqrt(greatest(sum(CASE WHEN lag_k = 0 THEN g ELSE 2 * (1 - lag_k / (least(lag, n - 1) + 1.0)) * g END), 0) / any_value(n)) AS hac,
               any_value(lag) AS lag FROM gammas GROUP BY 1, 2),
sums AS (
  SELECT phase, strategy, count(*) AS trials, avg(k) AS average_matches, avg(hit3) * 100 AS hit3_rate_pct, sum(payout) AS payout,
    sum(least(payout, 300000)) AS robust_payout, sum(least(cp, 300000)) AS control_robust_payout, avg(k) - avg(ck) AS edge, avg(k - ck) AS mean,
    coalesce(avg(k) FILTER (j < n // 2), 0) - coalesce(avg(ck) FILTER (j < n // 2), 0) AS first_half_edge,
    coalesce(avg(k) FILTER (j >= n // 2), 0) - coalesce(avg(ck) FILTER (j >= n // 2), 0) AS second_half_edge,
    coalesce(stddev_samp(k - ck), 0) / sqrt(count(*)) AS naive_se
  FROM placed GROUP BY 1, 2),
tested AS (
  SELECT *, CASE WHEN strategy = 'COLD' THEN 1.0 ELSE greatest(0, least(1, 1 - 0.5 * (1 + CASE WHEN z < 0 THEN -1 ELSE 1 END * (1 - ((((1.061405429 * q - 1.453152027) * q + 1.421413741) * q - 0.284496736) * q + 0.254829592) * q * exp(-z * z / 2))))) END AS p_value
  FROM (SELECT *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)) AS q FROM (
    SELECT *, greatest(hac, naive_se) AS se, CASE WHEN greatest(hac, naive_se) = 0 THEN 0 ELSE mean / greatest(hac, naive_se) END AS z FROM sums JOIN hac USING (phase, strategy)))),
stepped AS (SELECT *, least(1, p_value * (2 - row_number() OVER (PARTITION BY phase ORDER BY p_value, strategy) + 1)) AS step,
                   row_number() OVER (PARTITION BY phase ORDER BY p_value, strategy) AS r FROM tested WHERE strategy <> 'COLD'),
adjusted AS (SELECT *, max(step) OVER (PARTITION BY phase ORDER BY r ROWS UNBOUNDED PRECEDING) AS adjusted_p FROM stepped)"""
PHASED = SERIES + _PHASES
RANDOM_PHASED = RANDOM + _PHASES.replace("'COLD'", "'RANDOM'").replace("p_value * (2 - row_number()", "p_value * (3 - row_number()")


# ---- frequency and search -------------------------------------------------------------------------------------------

_FREQ = """
SELECT CAST(num AS INT) AS num, coalesce(c, 0) AS count, round(n * 6 / 45.0, 6) AS expected,
       round((coalesce(c, 0) * 45 - n * 6) * 100 / (n * 6.0), 6) AS delta_pct, coalesce(top - last, n) AS gap
FROM (SELECT unnest(range(1, 46)) AS num) LEFT JOIN (SELECT x AS num, count(*) AS c, max(t) AS last FROM (SELECT t, unnest(result) AS x FROM {src}) GROUP BY 1) USING (num),
     (SELECT count(*) AS n, max(t) AS top FROM {src})"""
_90D = ", recent AS (SELECT * FROM draws WHERE date >= (SELECT max(date) FROM draws) - 89)"


def _rounded(f: DataFrame) -> DataFrame:
    n = F.col("expected") * 7.5
    return f.select("num", "count", F.round("expected", 6).alias("expected"), F.round((F.col("count") * 45 - n * 6) * 100 / (n * 6), 6).alias("delta_pct"), "gap")


@query(DRAWS + _FREQ.format(src="draws"))
def freq_all(spark, d):
    return _rounded(draws.frequency(all_draws(spark, d)))


@query(DRAWS + _90D + _FREQ.format(src="recent"))
def freq_window_90d(spark, d):
    return _rounded(draws.frequency(draws.last_days(settled(all_draws(spark, d), "draws"), "90D")))


@query(DRAWS + f"SELECT round(sum((count - expected) * (count - expected) / expected), 4) AS chi_square FROM ({_FREQ.format(src='draws')})")
def chi_square(spark, d):
    return draws.chi_square(_rounded(draws.frequency(all_draws(spark, d)))).select(F.round("chi_square", 4).alias("chi_square"))


@query(DRAWS + f"SELECT num, count, gap, CASE WHEN delta_pct > 8 THEN 'hot' WHEN delta_pct < -8 THEN 'cold' ELSE 'neutral' END AS tone FROM ({_FREQ.format(src='draws')})")
def frequency_tones(spark, d):
    return _rounded(draws.frequency(all_draws(spark, d))).select("num", "count", "gap", rules.frequency_tone(F.col("delta_pct")).alias("tone"))


def _top(kind: str, order: str) -> None:
    @query(DRAWS + f"SELECT num, count, gap FROM ({_FREQ.format(src='draws')}) ORDER BY {order} LIMIT 6")
    def top(spark, d):
        return draws.top_numbers(draws.frequency(all_draws(spark, d)), kind).select("num", "count", "gap")

    QUERIES[f"top_k_{kind}"], SQL[f"top_k_{kind}"] = QUERIES.pop("top"), SQL.pop("top")


for _k, _o in (("hot", "count DESC, num"), ("cold", "count, num"), ("overdue", "gap DESC, num")):
    _top(_k, _o)


@query(DRAWS + ", f AS (SELECT * FROM draws WHERE starts_with(id, '000001') AND date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31') SELECT t, id, date, array_to_string(result, ',') AS result, (SELECT count(*) FROM f) AS total_matches FROM f ORDER BY date DESC, id DESC LIMIT 50")
def explorer_filter(spark, d):
    return draws.search(all_draws(spark, d), " 000001 ", "1995-01-01", "1996-12-31").select("t", "id", "date", text("result").alias("result"), "total_matches")


@query(DRAWS + "SELECT max_by(id, CAST(id AS BIGINT)) AS latest_id FROM draws")
def latest_id(spark, d):
    return draws.latest_id(all_draws(spark, d))


@query(DRAWS + "SELECT CASE WHEN CAST(id AS BIGINT) >= 500 THEN 'PROSPECTIVE' ELSE 'RETROSPECTIVE' END AS evidence, count(*) AS n FROM draws GROUP BY 1")
def evidence_counts(spark, d):
    return all_draws(spark, d).groupBy(rules.evidence(F.col("id"), F.lit("00000500")).alias("evidence")).agg(F.count(F.lit(1)).alias("n"))


@query(DRAWS + "SELECT t, lpad(CAST(t + 2 AS VARCHAR), 8, '0') AS next_id FROM draws")
def next_draw_id(spark, d):
    return all_draws(spark, d).select("t", rules.next_id(F.col("id")).alias("next_id"))


# ---- rolling features, picks, walk-forward --------------------------------------------------------------------------


@query(ROLLING + "SELECT t, CAST(num AS INT) AS num, CAST(count AS INT) AS count, CAST(gap AS INT) AS gap FROM rolling")
def rolling_freq_gap(spark, d):
    return walkforward.rolling(all_draws(spark, d), LOOKBACK).select("t", "num", "count", "gap")


@query(RANKED + "SELECT t, array_to_string(HOT, ',') AS hot, array_to_string(COLD, ',') AS cold, array_to_string(BALANCED, ',') AS balanced FROM picks")
def strategy_picks(spark, d):
    p = walkforward.picks(all_draws(spark, d), LOOKBACK)
    return p.select("t", text("HOT").alias("hot"), text("COLD").alias("cold"), text("BALANCED").alias("balanced"))


@query(RANKED + "SELECT t, array_to_string(HOT18, ',') AS hot18, array_to_string(COLD18, ',') AS cold18, array_to_string(OVERDUE18, ',') AS overdue18, array_to_string(BALANCED18, ',') AS balanced18 FROM picks")
def pool18_picks(spark, d):
    p = walkforward.picks(all_draws(spark, d), LOOKBACK, walkforward.POOL_RULES, 18)
    return p.select("t", *[text(r).alias(r.lower()) for r in walkforward.POOL_RULES])


@query(SERIES + "SELECT t, strategy, CAST(k AS INT) AS k, hit3, CAST(payout AS BIGINT) AS payout FROM series")
def walkforward_scores(spark, d):
    s = walkforward.series(all_draws(spark, d), LOOKBACK, "COLD")
    return s.select("t", "strategy", F.col("k").cast("int").alias("k"), F.col("hit3").cast("int").alias("hit3"), F.col("payout").cast("long").alias("payout"))


@query(SERIES + "SELECT count(*) AS trials, round(avg(k), 9) AS mean_matches, round(avg(k) - 0.8, 9) AS edge FROM series WHERE strategy = 'HOT'")
def walkforward_edge_hot(spark, d):
    met = walkforward.picks(all_draws(spark, d), LOOKBACK, ("HOT",))
    k = rules.matches(F.col("HOT"), F.col("result"))
    return met.agg(F.count(F.lit(1)).alias("trials"), F.round(F.avg(k), 9).alias("mean_matches"), F.round(F.avg(k) - 0.8, 9).alias("edge"))


_SUMMARY = ["trials", "average_matches", "hit3_rate_pct", "payout", "robust_payout", "edge", "first_half_edge", "second_half_edge", "se", "z", "p_value"]
_SUMMARY_SQL = "trials, round(average_matches, 6) AS average_matches, round(hit3_rate_pct, 6) AS hit3_rate_pct, CAST(payout AS BIGINT) AS payout, CAST(robust_payout AS BIGINT) AS robust_payout, round(edge, 6) AS edge, round(first_half_edge, 6) AS first_half_edge, round(second_half_edge, 6) AS second_half_edge, round(se, 6) AS se, round(z, 5) AS z, round(p_value, 5) AS p_value"


def _summary(rows: DataFrame, *keys: str) -> DataFrame:
    digits = {"z": 5, "p_value": 5}
    value = lambda c: F.col(c).cast("long").alias(c) if c in ("trials", "payout", "robust_payout") else F.round(c, digits.get(c, 6)).alias(c)
    return rows.select(*keys, "strategy", *map(value, _SUMMARY))


def _report(spark, d):
    return walkforward.report_rows(all_draws(spark, d), LOOKBACK, control="COLD")


@query(PHASED + f"SELECT phase, strategy, {_SUMMARY_SQL} FROM tested")
def phase_summary(spark, d):
    return _summary(_report(spark, d), "phase")


@query(PHASED.replace("CASE WHEN i < a THEN 'DEVELOPMENT' WHEN i < b THEN 'VALIDATION' ELSE 'TEST' END", "'ALL'") + f"SELECT strategy, {_SUMMARY_SQL} FROM tested")
def backtest_summary(spark, d):
    trials = table(spark, d, "orders").count() - LOOKBACK
    scores = settled(walkforward.series(all_draws(spark, d), LOOKBACK, "COLD").withColumn("all", F.lit("ALL")), "scores")
    return _summary(walkforward.summary(scores, LOOKBACK, trials, ["all"], "COLD"))


@query(PHASED + "SELECT phase, strategy, CAST(lag AS BIGINT) AS lag, round(hac, 6) AS hac, round(naive_se, 6) AS naive_se FROM sums JOIN hac USING (phase, strategy)")
def hac_se(spark, d):
    trials = table(spark, d, "orders").count() - LOOKBACK
    scores = walkforward.with_phases(walkforward.series(all_draws(spark, d), LOOKBACK, "COLD"), trials, LOOKBACK)
    diff = settled(scores.select("phase", "strategy", "t", (F.col("k") - F.col("control_k")).alias("d")), "differences")
    first = diff.groupBy("phase").agg(F.min("t").alias("first"))
    placed = diff.join(F.broadcast(first), "phase").withColumn("i", F.col("t") - F.col("first"))  # three rows
    h = walkforward.hac(placed, ["phase", "strategy"], LOOKBACK, trials)
    return h.select("phase", "strategy", "lag", F.round("hac", 6).alias("hac"), F.round("naive_se", 6).alias("naive_se"))


@query(PHASED + "SELECT phase, strategy, round(p_value, 5) AS p_value, round(adjusted_p, 5) AS adjusted_p FROM adjusted")
def holm(spark, d):
    return _report(spark, d).where("strategy <> 'COLD'").select("phase", "strategy", F.round("p_value", 5).alias("p_value"), F.round("adjusted_p", 5).alias("adjusted_p"))


@query(PHASED + "SELECT strategy, round(edge, 6) AS edge, round(adjusted_p, 5) AS adjusted_p FROM adjusted WHERE phase = 'DEVELOPMENT' AND edge > 0 AND adjusted_p <= 0.5 ORDER BY adjusted_p, edge DESC, strategy LIMIT 1")
def select_candidate(spark, d):
    rows = _report(spark, d).where("phase = 'DEVELOPMENT' and strategy <> 'COLD'")
    return walkforward.select_candidate(rows, 0.5).select("strategy", F.round("edge", 6).alias("edge"), F.round("adjusted_p", 5).alias("adjusted_p"))


# ---- ingest ---------------------------------------------------------------------------------------------------------

_SIDES = DRAWS + """,
existing AS (SELECT * FROM draws WHERE t % 17 <> 0),
incoming AS (SELECT t AS ordinal, id, date, CASE WHEN t % 13 = 0 THEN list_transform(result, lambda x: x % 45 + 1) ELSE result END AS result FROM draws
             UNION ALL SELECT t + 1000000000, id, date, result FROM draws WHERE t % 34 = 0),
firsts AS (SELECT id, min_by(result, ordinal) AS result, min_by(date, ordinal) AS date, min(ordinal) AS first FROM incoming GROUP BY id),
held AS (SELECT f.id, coalesce(e.result, f.result) AS result, coalesce(e.date, f.date) AS date, e.id IS NOT NULL AS was, f.first FROM firsts f LEFT JOIN existing e USING (id)),
fits AS (SELECT i.*, NOT was AND ordinal = first AS added, (NOT was AND ordinal = first) OR (i.result = h.result AND i.date = h.date) AS fit FROM incoming i JOIN held h USING (id)),
actions AS (SELECT ordinal, id, CASE WHEN added THEN 'added' WHEN NOT fit THEN 'conflict'
  WHEN coalesce(max(CAST(fit AS INT)) OVER (PARTITION BY id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'duplicate' ELSE 'unchanged' END AS action FROM fits)"""


def _sides(spark, d):
    table_ = settled(all_draws(spark, d), "draws")
    existing = table_.where("t % 17 <> 0").select("date", "id", "result")
    altered = F.when(F.col("t") % 13 == 0, F.transform("result", lambda x: x % 45 + 1)).otherwise(F.col("result"))
    incoming = table_.select(F.col("t").alias("ordinal"), "id", "date", altered.alias("result")).unionByName(table_.where("t % 34 = 0").select((F.col("t") + 1000000000).alias("ordinal"), "id", "date", "result"))
    return existing, incoming


@query(_SIDES + "SELECT id, date, array_to_string(result, ',') AS result FROM existing UNION ALL SELECT id, date, array_to_string(result, ',') FROM held WHERE NOT was")
def merge_upsert(spark, d):
    return merge.merged(*_sides(spark, d)).select("id", "date", text("result").alias("result"))


@query(_SIDES + "SELECT count(*) FILTER (action = 'added') AS added, count(*) FILTER (action = 'unchanged') AS unchanged, count(*) FILTER (action = 'duplicate') AS duplicates, count(*) FILTER (action = 'conflict') AS conflicts FROM actions")
def merge_counters(spark, d):
    return merge.counters(merge.classified(*_sides(spark, d)))


@query(_SIDES + "SELECT f.id, array_to_string(h.result, ',') AS existing, array_to_string(f.result, ',') AS incoming FROM fits f JOIN held h USING (id) WHERE NOT fit")
def merge_conflicts(spark, d):
    return merge.conflicts(merge.classified(*_sides(spark, d))).select("id", text(F.col("existing.result")).alias("existing"), text(F.col("incoming.result")).alias("incoming"))


@query(DRAWS + "SELECT true AS compared, count(*) FILTER (t % 17 <> 0 AND t % 19 = 0) AS only_local, count(*) FILTER (t % 17 = 0 AND t % 19 <> 0) AS only_mirror, count(*) FILTER (t % 17 <> 0 AND t % 19 <> 0) AS both FROM draws")
def id_set_compare(spark, d):
    table_ = settled(all_draws(spark, d), "draws")
    return merge.compare_ids(table_.where("t % 17 <> 0"), table_.where("t % 19 <> 0"))


@query(DRAWS + "SELECT id FROM draws WHERE t % 17 = 0 AND t > (SELECT min(t) FROM draws WHERE t % 17 <> 0) AND t < (SELECT max(t) FROM draws WHERE t % 17 <> 0)")
def continuity_gaps(spark, d):
    return merge.missing_ids(settled(all_draws(spark, d).where("t % 17 <> 0").select("id"), "ids"), 8)


@query(DRAWS + ", k AS (SELECT CAST(id AS BIGINT) AS n FROM draws WHERE t % 17 <> 0) SELECT min(n) AS first, max(n) AS last, max(n) - min(n) + 1 AS expected, count(DISTINCT n) AS present, max(n) - min(n) + 1 - count(DISTINCT n) AS n_missing, 0 AS n_duplicates, max(n) - min(n) + 1 = count(DISTINCT n) AS continuous FROM k")
def continuity(spark, d):
    return merge.continuity(all_draws(spark, d).where("t % 17 <> 0")).withColumn("n_duplicates", F.col("n_duplicates").cast("int"))


_DISORDER = DRAWS + """, r AS (SELECT CASE WHEN t % 1000 = 500 THEN t + 1 WHEN t % 1000 = 501 THEN t - 1 ELSE t END AS t, CASE WHEN t % 700 = 3 AND t > 3 THEN '00000001' ELSE id END AS id, date FROM draws)
SELECT r.t AS index, r.id, 'id repeats the row at ' || f AS reason FROM r JOIN (SELECT id, min(t) AS f FROM r GROUP BY id HAVING count(*) > 1) USING (id) WHERE r.t > f
UNION ALL SELECT * FROM (SELECT b.t, b.id, 'rows are out of order' FROM r a JOIN r b ON b.t = a.t + 1 WHERE (a.date, a.id) > (b.date, b.id) ORDER BY b.t LIMIT 1)
UNION ALL SELECT NULL, NULL, 'the latest date went back'"""


@query(_DISORDER)
def order_check(spark, d):
    t = F.col("t")
    moved = F.when(t % 1000 == 500, t + 1).when(t % 1000 == 501, t - 1).otherwise(t)
    rows = all_draws(spark, d).select(moved.alias("t"), F.when((t % 700 == 3) & (t > 3), "00000001").otherwise(F.col("id")).alias("id"), "date")
    return merge.dataset_issues(settled(rows, "draws"), "2999-01-01")


@query(DRAWS + """SELECT id, date, '{"date":"' || CAST(date AS VARCHAR) || '","id":"' || id || '","result":[' || array_to_string(result, ',') || ']}' AS line FROM draws""")
def draw_lines(spark, d):
    return jsonl.serialised(all_draws(spark, d)).select("id", "date", "line")


@query(DRAWS + """SELECT t AS line, CASE t % 8 WHEN 1 THEN 'line is not JSON' WHEN 2 THEN 'date is not on the calendar' WHEN 3 THEN 'result has the wrong length' WHEN 4 THEN 'result has a value out of range' WHEN 5 THEN 'result repeats a number' WHEN 6 THEN 'id is missing or blank' WHEN 7 THEN 'date has the wrong form' END AS reason FROM draws""")
def validation_reasons(spark, d):
    rows = all_draws(spark, d)
    good = hashing.draw_json(F.col("date").cast("string"), F.col("id"), F.col("result"))
    make = lambda date=None, id_=None, result=None: hashing.draw_json(date if date is not None else F.col("date").cast("string"), id_ if id_ is not None else F.col("id"), result if result is not None else F.col("result"))
    broken = {
        1: F.substring(good, 1, 20), 2: make(date=F.lit("2026-02-30")), 3: make(result=F.slice("result", 1, 5)),
        4: make(result=F.array_append(F.slice("result", 1, 5), F.lit(46))), 5: make(result=F.array_append(F.slice("result", 1, 5), F.get("result", F.lit(0)))),
        6: make(id_=F.lit("  ")), 7: make(date=F.date_format("date", "dd-MM-yyyy")),
    }
    value = good
    for k, v in broken.items():
        value = F.when(F.col("t") % 8 == k, v).otherwise(value)
    return jsonl.validated(rows.select(F.col("t").alias("line"), value.alias("value"))).select("line", "reason")


@query("SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, len(regexp_extract_all(html, 'href=')) AS n_links FROM pages")
def html_extract(spark, d):
    return html.tags(table(spark, d, "pages"))


# ---- tickets and portfolios -----------------------------------------------------------------------------------------

@query(DRAWS + f""", e AS (SELECT t, len(list_intersect([3, 11, 19, 27, 35, 43], result)) AS k, result FROM draws)
SELECT t, CAST(k AS INT) AS k, CASE k WHEN 6 THEN 'JACKPOT' WHEN 5 THEN 'FIRST' WHEN 4 THEN 'SECOND' WHEN 3 THEN 'THIRD' ELSE 'NONE' END AS tier,
CASE WHEN k = 6 THEN NULL ELSE {_PAY} END AS payout, array_to_string(list_filter([3, 11, 19, 27, 35, 43], lambda x: list_contains(result, x)), ',') AS matched FROM e""")
def evaluate_ticket(spark, d):
    ticket = F.array(*map(F.lit, (3, 11, 19, 27, 35, 43)))
    e = all_draws(spark, d).select("t", rules.evaluated(ticket, F.col("result")).alias("e"))
    return e.select("t", F.col("e.matches").alias("k"), "e.tier", F.col("e.payout").cast("int").alias("payout"), text("e.matched").alias("matched"))


@query(DRAWS + "SELECT i >= 10 AS later, count(DISTINCT (x, y)) AS covered_pairs FROM (SELECT t AS i, unnest(result) AS x, result AS ticket FROM draws), LATERAL (SELECT unnest(ticket) AS y) WHERE x < y GROUP BY 1")
def ticket_pairs_covered(spark, d):
    """All derived tickets: the first ten as one portfolio, and the rest."""
    rows = all_draws(spark, d).select(F.col("t").alias("ticket_id"), F.col("result").alias("ticket"))
    one = lambda later: portfolio.covered_pairs(rows.where((F.col("ticket_id") >= 10) == later)).select(F.lit(later).alias("later"), "covered_pairs")
    return one(False).unionByName(one(True))


@query(DRAWS + """, tickets AS (SELECT t // 30 AS portfolio, t AS i, result AS ticket FROM draws), sizes AS (SELECT portfolio, count(*) AS n FROM tickets GROUP BY 1),
shared AS (SELECT a.portfolio, max(len(list_intersect(a.ticket, b.ticket))) AS s FROM tickets a JOIN tickets b ON a.portfolio = b.portfolio AND a.i < b.i GROUP BY 1)
SELECT portfolio, n, CAST(coalesce(s, 0) AS INT) AS most_shared, coalesce(s, 0) <= 1 AS valid FROM sizes LEFT JOIN shared USING (portfolio)""")
def portfolio_valid(spark, d):
    """All derived tickets, thirty to a portfolio."""
    return portfolio.validity(all_draws(spark, d).select(F.expr("t div 30").alias("portfolio"), F.col("t").alias("ticket_id"), F.col("result").alias("ticket")))


def _literal(n: int) -> str:
    return ", ".join(f"({i}, [{', '.join(map(str, t))}])" for i, t in enumerate(portfolio.planned_tickets(n)))


@query(DRAWS + f", p AS (SELECT * FROM (VALUES {_literal(10)}) AS v(i, ticket)) SELECT t, CAST(max(len(list_intersect(ticket, result))) AS INT) AS best FROM draws, p GROUP BY t")
def best_match(spark, d):
    return portfolio.best_match(all_draws(spark, d), portfolio.planned_tickets(10))


@query(DRAWS + f", p AS (SELECT * FROM (VALUES {_literal(10)}) AS v(i, ticket)), m AS (SELECT t, len(list_intersect(ticket, result)) AS k FROM draws, p) SELECT t, CAST(max(k) AS INT) AS best, CAST(sum({_PAY}) AS BIGINT) AS payout, 100000 AS cost FROM m GROUP BY t")
def portfolio_scores(spark, d):
    return portfolio.scores(all_draws(spark, d), portfolio.planned_tickets(10)).withColumn("cost", F.col("cost").cast("int"))


@query(DRAWS + f", p AS (SELECT * FROM (VALUES {_literal(30)}) AS v(i, ticket)) SELECT i AS ticket_id, array_to_string(ticket, ',') AS ticket, count(*) FILTER (len(list_intersect(ticket, result)) >= 3) AS draws_met FROM p, draws GROUP BY 1, 2")
def portfolio_plan(spark, d):
    """The planned tickets, with the derived draws that each meets in three numbers or more."""
    plan = portfolio.planned_tickets(30)
    hit = [F.count_if(rules.matches(F.array(*map(F.lit, t)), F.col("result")) >= 3).alias(f"t{i}") for i, t in enumerate(plan)]
    met = all_draws(spark, d).agg(*hit)  # one row: every draw is looked at once
    each = met.select(F.explode(F.array(*[F.struct(F.lit(i).alias("ticket_id"), F.col(f"t{i}").alias("draws_met")) for i in range(30)])).alias("x")).select("x.*")
    return portfolio.portfolio(spark, 30).select("ticket_id", text("ticket").alias("ticket")).join(each, "ticket_id")


# ---- exact tables ---------------------------------------------------------------------------------------------------

_FACT = "WITH f AS (SELECT CAST(n AS BIGINT) AS n, CASE WHEN n = 0 THEN 1 ELSE product(x) END AS v FROM (SELECT unnest(range(0, 46)) AS n), LATERAL (SELECT unnest(range(1, greatest(n, 1) + 1)) AS x) GROUP BY n), c AS (SELECT a.n, b.n AS k, CAST(round(a.v / (b.v * d.v)) AS BIGINT) AS v FROM f a, f b, f d WHERE d.n = a.n - b.n)"


_DRAWN = DRAWS + ", " + _FACT[5:]
_TICKET = (3, 11, 19, 27, 35, 43)


def _observed(spark, d, k, name: str) -> DataFrame:
    """Derived draws by a number that each has."""
    return all_draws(spark, d).groupBy(k.cast("int").alias(name)).agg(F.count(F.lit(1)).alias("observed"))


def _with_observed(rows: DataFrame, seen: DataFrame, name: str) -> DataFrame:
    return rows.join(F.broadcast(seen), name, "left").withColumn("observed", F.coalesce("observed", F.lit(0)))  # seven rows


_MET = f"(SELECT len(list_intersect({list(_TICKET)}, result)) AS k, count(*) AS c FROM draws GROUP BY 1)"
_IN18 = "(SELECT len(list_filter(result, lambda x: x <= 18)) AS k, count(*) AS c FROM draws GROUP BY 1)"


@query(_DRAWN + f" SELECT CAST(a.k AS INT) AS matches, a.v * b.v AS combinations, round(a.v * b.v / 8145060.0, 12) AS probability, CASE a.k WHEN 6 THEN NULL WHEN 5 THEN 10000000 WHEN 4 THEN 300000 WHEN 3 THEN 30000 ELSE 0 END AS payout, coalesce(o.c, 0) AS observed FROM c a JOIN c b ON b.n = 39 AND b.k = 6 - a.k LEFT JOIN {_MET} o ON o.k = a.k WHERE a.n = 6")
def exact_outcomes(spark, d):
    """Chances of one ticket, and how many derived draws it met so."""
    rows = exact.outcomes(spark).withColumn("probability", F.round("probability", 12)).withColumn("payout", F.col("payout").cast("int"))
    return _with_observed(rows, _observed(spark, d, rules.matches(F.array(*map(F.lit, _TICKET)), F.col("result")), "matches"), "matches")


def _in_18():
    return F.size(F.filter("result", lambda x: x <= 18))


@query(_DRAWN + f" SELECT CAST(a.k AS INT) AS matches, round(a.v * b.v / 8145060.0, 12) AS probability, coalesce(o.c, 0) AS observed FROM c a JOIN c b ON b.n = 27 AND b.k = 6 - a.k LEFT JOIN {_IN18} o ON o.k = a.k WHERE a.n = 18 AND a.k <= 6")
def hypergeometric18(spark, d):
    """Chances of the pool 1 .. 18, and how many derived draws had so many of its numbers."""
    return _with_observed(exact.hypergeometric(spark, 18).withColumn("probability", F.round("probability", 12)), _observed(spark, d, _in_18(), "matches"), "matches")


_TIERS = _DRAWN + f", o AS {_IN18}, tiers AS (SELECT m, j, coalesce(x.v, 0) * coalesce(y.v, 0) AS tickets FROM (SELECT unnest(range(0, 7)) AS m), (SELECT unnest(range(0, 7)) AS j) LEFT JOIN c x ON x.n = m AND x.k = j LEFT JOIN c y ON y.n = 18 - m AND y.k = 6 - j)"


@query(_TIERS + " SELECT CAST(m AS INT) AS m, CAST(j AS INT) AS j, tickets, tickets * coalesce(c, 0) AS tickets_drawn FROM tiers LEFT JOIN o ON o.k = m")
def tier_counts(spark, d):
    """Tickets of the pool 1 .. 18 by matches, for one draw and for all derived draws."""
    rows = _with_observed(exact.tier_counts(spark), _observed(spark, d, _in_18(), "m"), "m")
    return rows.select("m", "j", "tickets", (F.col("tickets") * F.col("observed")).alias("tickets_drawn"))


@query(_TIERS + " SELECT CAST(m AS INT) AS m, CAST(sum(tickets * CASE j WHEN 3 THEN 30000 WHEN 4 THEN 300000 WHEN 5 THEN 10000000 ELSE 0 END) AS BIGINT) AS fixed_payout, CAST(sum(CASE WHEN j = 6 THEN tickets ELSE 0 END) AS BIGINT) AS jackpot_tickets, coalesce(any_value(c), 0) AS observed FROM tiers LEFT JOIN o ON o.k = m GROUP BY m")
def pool_payouts(spark, d):
    """Prizes of the pool 1 .. 18 by drawn numbers in it, and how many derived draws had so many."""
    return _with_observed(exact.pool_payouts(spark), _observed(spark, d, _in_18(), "m"), "m")


@query(_DRAWN + " SELECT CAST(n AS INT) AS pool, v AS tickets, v * 10000 AS cost, round(v / 8145060.0, 12) AS jackpot_probability, (SELECT count(*) FROM draws WHERE list_max(result) <= n) AS observed FROM c WHERE k = 6 AND n >= 6")
def bao_table(spark, d):
    """Pools of the first numbers, with the derived draws that lie in each."""
    seen = all_draws(spark, d).groupBy(F.array_max("result").alias("top")).agg(F.count(F.lit(1)).alias("c"))
    rows = exact.bao(spark).withColumn("jackpot_probability", F.round("jackpot_probability", 12))
    met = rows.join(F.broadcast(seen), F.col("top") <= F.col("pool"), "left")  # at most 45 rows on either side
    return met.groupBy("pool", "tickets", "cost", "jackpot_probability").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("observed"))


_P4, _P5 = 11115 + 234 + 1, 234 + 1
_BUDGET = "(CAST(floor(o_totalprice / 5000) AS BIGINT) + 1) * 100000"


@query(_FACT + f" SELECT budget, orders, CAST(max(n) AS INT) AS pool, max(v) AS pool_tickets, max(v) * 10000 AS pool_cost, round(max(v) / 8145060.0, 12) AS jackpot_probability, least(budget // 10000, 30) AS tickets, budget // 10000 > 30 AS capped, round(least(budget // 10000, 30) * {_P4} / 8145060.0, 10) AS p_at_least_4 FROM (SELECT {_BUDGET} AS budget, count(*) AS orders FROM orders GROUP BY 1) JOIN c ON k = 6 AND n >= 6 AND v * 10000 <= budget GROUP BY budget, orders")
def bao_frontier(spark, d):
    """What the budgets of all orders would buy."""
    budgets = table(spark, d, "orders").groupBy(((F.floor(F.col("o_totalprice") / 5000) + 1) * 100_000).alias("budget")).agg(F.count(F.lit(1)).alias("orders"))
    f = exact.frontier(spark, budgets.select("budget")).join(budgets, "budget")
    return f.select("budget", "orders", "pool", "pool_tickets", "pool_cost", F.round("jackpot_probability", 12).alias("jackpot_probability"), "tickets", "capped", F.round("p_at_least_4", 10).alias("p_at_least_4"))


#: Customers' numbers of orders serve as numbers of tickets, of losses and of trials.
_BOUGHT = "(SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o FROM orders GROUP BY 1)"


def bought(spark, d) -> DataFrame:
    status = lambda x: F.count_if(F.col("o_orderstatus") == x)
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), status("F").alias("f"), status("O").alias("o"))


@query(f"SELECT n AS tickets, count(*) AS customers, round(n * {_P4} / 8145060.0, 10) AS planned, round(1 - pow(1 - {_P4} / 8145060.0, n), 10) AS random, round(n * {_P4} / 8145060.0 - (1 - pow(1 - {_P4} / 8145060.0, n)), 10) AS absolute_lift FROM {_BOUGHT} GROUP BY n")
def exact_benchmark(spark, d):
    counts = bought(spark, d).groupBy(F.col("n").alias("tickets")).agg(F.count(F.lit(1)).alias("customers"))
    e = exact.exact_benchmark(spark, counts.select("tickets")).join(counts, "tickets")
    return e.select("tickets", "customers", *[F.round(c, 10).alias(c) for c in ("planned", "random", "absolute_lift")])


@query(f"SELECT o_custkey, least(n, 30) AS tickets, least(n, 30) * 10000 AS cost, round(least(n, 30) * {_P4} / 8145060.0, 10) AS p4, round(least(n, 30) * {_P5} / 8145060.0, 10) AS p5, round(least(n, 30) / 8145060.0, 12) AS p6 FROM {_BOUGHT}")
def portfolio_odds(spark, d):
    """Odds of a planned portfolio for each customer, of as many tickets as orders, thirty at most as every portfolio."""
    n = F.least(F.col("n"), F.lit(portfolio.MOST).cast("long"))
    o = bought(spark, d).select("o_custkey", n.alias("tickets"), exact.portfolio_odds(n).alias("o"))
    return o.select("o_custkey", "tickets", F.col("o.cost").alias("cost"), F.round("o.p_at_least_4", 10).alias("p4"), F.round("o.p_at_least_5", 10).alias("p5"), F.round("o.p_jackpot", 12).alias("p6"))


@query(f"SELECT o_custkey, n AS losses, (n + 1) * 10000 AS cost, 300000 - (n + 1) * 10000 AS net, (n + 1) * 10000 + 20000 AS required FROM {_BOUGHT}")
def profit_ledger(spark, d):
    p = bought(spark, d).select("o_custkey", F.col("n").alias("losses"), exact.profit_ledger(F.col("n"), F.lit(300000)).alias("p"))
    return p.select("o_custkey", "losses", "p.cost", "p.net", "p.required")


_SPENT = "0.05 * ln(1 + (exp(1) - 1) * {})"


@query(f"SELECT user_id, k AS look, round(CASE WHEN k = 1 THEN 0.05 ELSE {_SPENT.format('1.0')} - {_SPENT.format('(k - 1) / CAST(k AS DOUBLE)')} END, 12) AS alpha FROM (SELECT user_id, count(*) AS k FROM events GROUP BY 1)")
def alpha_spend(spark, d):
    """Alpha left for the next look of each user, who has looked as often as there are events."""
    looks = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("look"))
    return looks.select("user_id", "look", F.round(stats.spent_alpha(F.col("look").cast("double")), 12).alias("alpha"))


@query("SELECT event_id, round(greatest(0, least(1, 1 - 0.5 * (1 + CASE WHEN z < 0 THEN -1 ELSE 1 END * (1 - ((((1.061405429 * q - 1.453152027) * q + 1.421413741) * q - 0.284496736) * q + 0.254829592) * q * exp(-z * z / 2))))), 9) AS p_value FROM (SELECT event_id, z, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)) AS q FROM (SELECT event_id, (value - 50) / 20 AS z FROM events))")
def p_value(spark, d):
    return table(spark, d, "events").select("event_id", F.round(stats.one_sided_p((F.col("value") - 50) / 20), 9).alias("p_value"))


# ---- pool of 18 -----------------------------------------------------------------------------------------------------

_SEEN = RANKED + ", seen AS (" + " UNION ALL ".join(f"SELECT t, '{r}' AS rule, len(list_intersect({r}, result)) AS k FROM draws JOIN picks USING (t)" for r in walkforward.POOL_RULES) + ")"


@query(_SEEN + "SELECT rule, count(*) AS n, count(*) FILTER (k = 6) AS hit6, " + ", ".join(f"count(*) FILTER (k = {i}) AS k{i}" for i in range(7)) + ", round(avg(k), 9) AS mean_k, median(k) AS median_k, count(*) FILTER (k >= 4) AS at_least_4 FROM seen GROUP BY rule")
def rule_report(spark, d):
    r = pool18.rule_counts(pool18.observations(all_draws(spark, d), LOOKBACK, None))
    return r.select("rule", "n", "hit6", *[f"k{i}" for i in range(7)], F.round("mean_k", 9).alias("mean_k"), "median_k", "at_least_4")


@query(_SEEN + "SELECT a.rule, count(*) FILTER (a.k >= 4 AND b.k >= 4) AS both, count(*) FILTER (a.k >= 4 AND b.k < 4) AS rule_only, count(*) FILTER (a.k < 4 AND b.k >= 4) AS control_only, count(*) FILTER (a.k < 4 AND b.k < 4) AS neither FROM seen a JOIN seen b ON a.t = b.t AND b.rule = 'COLD18' WHERE a.rule <> 'COLD18' GROUP BY a.rule")
def contingency(spark, d):
    return pool18.contingency(pool18.observations(all_draws(spark, d), LOOKBACK, None), "COLD18", 4)


@query(_SEEN + "SELECT rule, t - 90 < (SELECT (count(*) - 90) // 2 FROM draws) AS early, count(*) AS n, count(*) FILTER (k = 6) AS hit6, round(avg(k), 9) AS mean_k FROM seen GROUP BY 1, 2")
def stability_halves(spark, d):
    h = pool18.halves(pool18.observations(all_draws(spark, d), LOOKBACK, None), LOOKBACK, table(spark, d, "orders").count() - LOOKBACK)
    return h.withColumn("mean_k", F.round("mean_k", 9))


@query()
def pool18_audit(spark, d):
    return pool18.audit(all_draws(spark, d), LOOKBACK)


@query(DRAWS + "SELECT count(*) - 90 AS n, count(*) - 90 AS hits FROM draws")
def leak_check(spark, d):
    return pool18.leak_check(all_draws(spark, d), LOOKBACK)


# ---- seeded resampling ----------------------------------------------------------------------------------------------


@query()
def fairness_mc(spark, d):
    return resample.fairness(all_draws(spark, d))


@query()
def sign_flip_bootstrap(spark, d):
    s = walkforward.series(all_draws(spark, d), LOOKBACK, "COLD").where("strategy <> 'COLD'")
    return resample.paired(s.select("strategy", "t", (F.col("k") - F.col("control_k")).alias("d")), "strategy", 645)


@query()
def negative_controls(spark, d):
    return controls.all_controls(all_draws(spark, d), LOOKBACK)


# ---- provenance -----------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT CAST(quality AS DOUBLE) AS outcome, least(n_chars / 10000.0, 1) AS predicted FROM labels JOIN documents USING (doc_id)),
b AS (SELECT least(CAST(floor(predicted * 10) AS INT), 9) AS k, count(*) AS n, avg(predicted) AS p, avg(outcome) AS o, sum((predicted - outcome) * (predicted - outcome)) AS sq FROM p GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(sq) / sum(n), 8) AS brier, round(sum(n * abs(p - o)) / sum(n), 8) AS ece FROM b""")
def calibration_ece(spark, d):
    p = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    r = provenance.calibration(p.select(F.col("quality").cast("double").alias("outcome"), F.least(F.col("n_chars") / 10000.0, F.lit(1.0)).alias("predicted")))
    return r.select("n", F.round("brier", 8).alias("brier"), F.round("ece", 8).alias("ece"))


@query("SELECT source AS family_id, count(DISTINCT doc_id) AS experiments, count(DISTINCT CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END) AS hypotheses, count(DISTINCT n_chars % 7) AS looks FROM documents GROUP BY source")
def family_counts(spark, d):
    r = table(spark, d, "documents").select(F.col("source").alias("family_id"), F.col("doc_id").alias("experiment_id"), F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("lang")).alias("hypothesis_id"), F.col("source").alias("strategy_id"), (F.col("n_chars") % 7).cast("string").alias("dataset_hash"))
    return provenance.family_counts(r).drop("holm_family")


@query("SELECT 'UNRECOGNISED_PROTOCOL_HASH' AS kind, CAST(doc_id AS VARCHAR) AS experiment_id, source AS detail FROM documents WHERE source NOT IN (SELECT DISTINCT source FROM documents WHERE doc_id < 20 AND source IS NOT NULL)")
def provenance_unrecognised(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("experiment_id"), F.col("source").alias("protocol_hash"), "doc_id")
    return provenance.unrecognised(docs, docs.where("doc_id < 20"))


@query("SELECT kind, CAST(doc_id AS VARCHAR) AS experiment_id, detail FROM (SELECT doc_id, 'PROTOCOL_HASH_MISMATCH' AS kind, 'a' || doc_id % 5 || ' a' || doc_id % 3 AS detail FROM documents WHERE doc_id % 5 <> doc_id % 3 UNION ALL SELECT doc_id, 'DATASET_HASH_MISMATCH', 'b' || doc_id % 2 || ' b' || doc_id % 7 FROM documents WHERE doc_id % 2 <> doc_id % 7)")
def provenance_inconsistent(spark, d):
    docs = table(spark, d, "documents")
    tag = lambda p, m: F.concat(F.lit(p), (F.col("doc_id") % m).cast("string"))
    one = lambda m, n: docs.select(F.col("doc_id").cast("string").alias("experiment_id"), tag("a", m).alias("protocol_hash"), tag("b", n).alias("dataset_hash"), F.lit("1").alias("protocol_version"))
    return provenance.inconsistent(one(5, 2), one(3, 7))


@query("WITH v AS (SELECT lang AS kind, CAST(doc_id AS VARCHAR) AS experiment_id, source AS detail FROM documents) SELECT v.*, x.justification, x.justification IS NOT NULL AS explained FROM v LEFT JOIN (SELECT lang AS kind, CAST(doc_id AS VARCHAR) AS experiment_id, source AS detail, 'why ' || doc_id AS justification FROM documents WHERE doc_id % 4 = 0) x USING (kind, experiment_id, detail)")
def provenance_triage(spark, d):
    docs = table(spark, d, "documents")
    v = docs.select(F.col("lang").alias("kind"), F.col("doc_id").cast("string").alias("experiment_id"), F.col("source").alias("detail"), F.col("doc_id").alias("line"))
    x = v.where("line % 4 = 0").withColumn("justification", F.concat(F.lit("why "), "experiment_id"))
    return provenance.triage(v.drop("line"), x.unionByName(x.withColumn("line", F.col("line") + 1_000_000_000).withColumn("justification", F.lit("late")))).select("kind", "experiment_id", "detail", "justification", "explained")


@query("WITH f AS (SELECT source AS experiment_id, CASE WHEN doc_id % 50 = 0 THEN 'x/other.json' ELSE 'x/' || source || '.json' END AS file, CAST(n_chars % 2 AS VARCHAR) AS content FROM documents) SELECT 'ARTIFACT_COLLISION' AS kind, experiment_id, CAST(count(DISTINCT content) AS VARCHAR) AS detail FROM f GROUP BY experiment_id HAVING count(DISTINCT content) > 1 UNION ALL SELECT 'ARTIFACT_NAME', experiment_id, file FROM f WHERE file = 'x/other.json'")
def artifact_collision(spark, d):
    docs = table(spark, d, "documents")
    f = docs.select(F.col("source").alias("experiment_id"), F.when(F.col("doc_id") % 50 == 0, "x/other.json").otherwise(F.concat(F.lit("x/"), "source", F.lit(".json"))).alias("file"), (F.col("n_chars") % 2).cast("string").alias("content"))
    return provenance.collisions(f)


_EVENTS = "WITH e AS (SELECT event_id AS line, CAST(user_id AS VARCHAR) AS entry_id, CASE event_id % 3 WHEN 0 THEN 'FROZEN' ELSE 'SCORED' END AS format, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 7 END AS matches FROM events)"


@query(_EVENTS + """, b AS (SELECT entry_id, max(line) FILTER (format = 'FROZEN') AS base_line, min(line) FILTER (format = 'FROZEN') AS first_line FROM e GROUP BY 1)
SELECT b.entry_id, first_line, base_line, CAST(min_by(matches, line) FILTER (format = 'SCORED' AND line > base_line) AS INT) AS matches,
CASE WHEN count(*) FILTER (format = 'SCORED' AND line > base_line) > 0 THEN 'SCORED' ELSE 'PENDING' END AS status FROM b JOIN e USING (entry_id) WHERE base_line IS NOT NULL GROUP BY 1, 2, 3""")
def ledger_fold(spark, d):
    e = table(spark, d, "events")
    scored = F.col("event_id") % 3 != 0
    rows = e.select(F.col("event_id").alias("line"), F.col("user_id").cast("string").alias("entry_id"), F.when(scored, "SCORED").otherwise("FROZEN").alias("format"), F.when(scored, F.array(F.lit(1))).alias("result"), F.when(scored, (F.col("event_id") % 7).cast("int")).alias("matches"), F.lit(None).cast("string").alias("tier"))
    return provenance.fold(rows).select("entry_id", "first_line", "base_line", "matches", "status")


_CHAIN = """WITH e AS (SELECT event_id AS line, CASE WHEN event_id % 11 = 0 THEN 'LEGACY' ELSE 'FROZEN' END AS format, CAST(event_id AS VARCHAR) AS content, sha256('h' || event_id) AS own FROM events),
c AS (SELECT line, content, lag(CASE WHEN line % 5 = 0 THEN sha256(content || '|GENESIS') ELSE own END) OVER (ORDER BY line) AS before, CASE WHEN line % 5 = 0 THEN NULL ELSE sha256('h' || (line - 1)) END AS prev, CASE WHEN line % 5 = 0 THEN sha256(content || '|GENESIS') ELSE own END AS h FROM e WHERE format <> 'LEGACY')
SELECT line, prev IS NOT DISTINCT FROM before AS link_ok, sha256(content || '|' || coalesce(prev, 'GENESIS')) = h AS hash_ok FROM c"""


def chain_rows(spark, d) -> DataFrame:
    """Events as a chain that starts anew at every fifth line."""
    e = table(spark, d, "events")
    n, content = F.col("event_id"), F.col("event_id").cast("string")
    restart = n % 5 == 0
    return e.select(n.alias("line"), F.when(n % 11 == 0, "LEGACY").otherwise("FROZEN").alias("format"), content.alias("content"), F.when(~restart, F.sha2(F.concat(F.lit("h"), (n - 1).cast("string")), 256)).alias("previousEntryHash"), F.when(restart, F.sha2(F.concat(content, F.lit("|GENESIS")), 256)).otherwise(F.sha2(F.concat(F.lit("h"), content), 256)).alias("entryHash"))


@query(_CHAIN)
def chain_verify(spark, d):
    return provenance.verify_chain(chain_rows(spark, d))


@query("SELECT max_by(sha256('h' || event_id), event_id) AS last_hash FROM events WHERE event_id % 11 <> 0")
def last_chain_hash(spark, d):
    e = table(spark, d, "events")
    return provenance.last_hash(e.select(F.col("event_id").alias("line"), F.when(F.col("event_id") % 11 == 0, "LEGACY").otherwise("FROZEN").alias("format"), F.sha2(F.concat(F.lit("h"), F.col("event_id").cast("string")), 256).alias("entryHash")))


@query("SELECT event_id, CASE WHEN a <= 43200000 THEN 'Fresh' WHEN a <= 604800000 THEN 'Delayed' ELSE 'Stale' END AS freshness, a >= 43200000 AS refresh FROM (SELECT event_id, greatest(epoch_ms(m) - epoch_ms(ts), 0) AS a FROM events, (SELECT max(ts) AS m FROM events))")
def freshness(spark, d):
    e = table(spark, d, "events")
    now = F.broadcast(e.agg(F.unix_millis(F.max(F.col("ts").cast("timestamp"))).alias("now")))
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.join(now, how="cross").select("event_id", rules.freshness(ms, F.col("now")).alias("freshness"), rules.should_refresh(ms, F.col("now")).alias("refresh"))  # one row on the right
