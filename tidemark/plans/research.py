"""Reports against the random control, seeded streams, checks, ledgers and registries: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hashing, numeric, rng, rules
from ..operators import checks, controls, draws, merge, portfolio, pool18, prospective, provenance, registry, replay, walkforward
from ..session import settled
from ..sources import jsonl, paged
from ..sources.shapes import json_value
from ..streaming import limits
from .catalog import _BOUGHT, _CHAIN, _FACT, _M, _PAY, _SUMMARY_SQL, DRAWS, LOOKBACK, RANDOM_PHASED, RANKED, _literal, all_draws, bought, chain_rows, query, sql_swaps, sql_ticket, table, text

# ---- rules against the random control -------------------------------------------------------------------------------

_RANDOM_SUMMARY = _SUMMARY_SQL.replace("CAST(payout AS BIGINT)", "round(payout, 4)").replace("CAST(robust_payout AS BIGINT)", "round(robust_payout, 4)")
_GATES = "strategy <> 'RANDOM' AND p_value <= 0.05 AS significant, strategy <> 'RANDOM' AND first_half_edge > 0 AND second_half_edge > 0 AS stable_halves, strategy <> 'RANDOM' AND robust_payout > control_robust_payout AS beats_control_payout"


def _report(spark, d):
    return walkforward.report_rows(all_draws(spark, d), LOOKBACK)


@query(RANDOM_PHASED + f"""
SELECT phase, strategy, {_RANDOM_SUMMARY}, CAST(trials * 10000 AS BIGINT) AS cost, round((payout - trials * 10000.0) / (trials * 10000.0) * 100, 5) AS roi_pct, {_GATES},
       round(edge - 1.96 * se, 6) AS ci95_low, round(edge + 1.96 * se, 6) AS ci95_high, round(adjusted_p, 5) AS adjusted_p, coalesce(edge > 0 AND adjusted_p <= 0.05, false) AS significant_corrected
FROM tested LEFT JOIN (SELECT phase, strategy, adjusted_p FROM adjusted) USING (phase, strategy)""")
def temporal_report(spark, d):
    """Rules against the seeded random control."""
    digits = {"z": 5, "p_value": 5, "adjusted_p": 5, "roi_pct": 5, "payout": 4, "robust_payout": 4}
    rounded = ("average_matches", "hit3_rate_pct", "payout", "robust_payout", "edge", "first_half_edge", "second_half_edge", "se", "z", "p_value", "roi_pct", "ci95_low", "ci95_high", "adjusted_p")
    return _report(spark, d).select("phase", "strategy", "trials", "cost", *[F.round(c, digits.get(c, 6)).alias(c) for c in rounded], "significant", "stable_halves", "beats_control_payout", "significant_corrected")


_RELIABLE = RANDOM_PHASED + """,
chosen AS (SELECT strategy AS chosen FROM adjusted WHERE phase = 'VALIDATION' AND edge > 0 AND adjusted_p <= 0.05 ORDER BY adjusted_p, edge DESC, strategy LIMIT 1),
each AS (SELECT strategy, max(edge) FILTER (phase = 'VALIDATION') AS ve, max(adjusted_p) FILTER (phase = 'VALIDATION') AS vp, max(edge) FILTER (phase = 'TEST') AS te, max(adjusted_p) FILTER (phase = 'TEST') AS tp,
                max(edge - 1.96 * se) FILTER (phase = 'TEST') AS lo, max(edge + 1.96 * se) FILTER (phase = 'TEST') AS hi FROM adjusted GROUP BY 1)
SELECT strategy, chosen IS NOT NULL AS selected_on_validation, round(ve, 6) AS validation_edge, round(vp, 5) AS validation_adjusted_p, round(te, 6) AS test_edge, round(tp, 5) AS test_adjusted_p, round(lo, 6) AS test_ci95_low, round(hi, 6) AS test_ci95_high,
       CASE WHEN chosen IS NOT NULL AND te > 0 AND tp <= 0.05 AND lo > 0 THEN 'HOLDOUT_SIGNAL' WHEN chosen IS NOT NULL THEN 'VALIDATION_ONLY' ELSE 'NO_EDGE' END AS verdict
FROM each LEFT JOIN chosen ON chosen = strategy"""


@query(_RELIABLE)
def strategy_reliability(spark, d):
    r = walkforward.reliability(settled(_report(spark, d), "report"), 0.05)
    digits = lambda c: 5 if c.endswith("_p") else 6
    return r.select("strategy", "selected_on_validation", *[F.round(c, digits(c)).alias(c) for c in ("validation_edge", "validation_adjusted_p", "test_edge", "test_adjusted_p", "test_ci95_low", "test_ci95_high")], "verdict")


@query(RANDOM_PHASED + """,
without AS (SELECT r.removed, a.*, row_number() OVER (PARTITION BY r.removed, phase ORDER BY p_value, strategy) AS place FROM adjusted a, (SELECT unnest(['HOT', 'COLD', 'BALANCED']) AS removed) r WHERE strategy <> removed AND phase IN ('VALIDATION', 'TEST')),
again AS (SELECT *, max(least(1, p_value * (2 - place + 1))) OVER (PARTITION BY removed, phase ORDER BY place ROWS UNBOUNDED PRECEDING) AS p2 FROM without)
SELECT removed, phase, strategy, round(edge, 6) AS edge, 0.0::DOUBLE AS delta_edge, round(adjusted_p, 5) AS full_adjusted_p, round(p2, 5) AS adjusted_p, edge > 0 AND p2 <= 0.05 AND adjusted_p > 0.05 AS newly_significant FROM again""")
def ablation(spark, d):
    a = walkforward.ablation(_report(spark, d), 0.05)
    return a.select("removed", "phase", "strategy", F.round("edge", 6).alias("edge"), "delta_edge", F.round("full_adjusted_p", 5).alias("full_adjusted_p"), F.round("adjusted_p", 5).alias("adjusted_p"), "newly_significant")


@query(RANDOM_PHASED + """,
ordered AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN strategy = 'RANDOM' THEN 0 ELSE 1 END, strategy) AS nth FROM tested WHERE phase = 'TEST')
SELECT nth, strategy, round(edge, 6) AS edge FROM ordered""")
def control_first(spark, d):
    """The TEST rows as they are shown: the control on top."""
    return walkforward.control_first(_report(spark, d).where("phase = 'TEST'")).select(F.col("nth").cast("long").alias("nth"), "strategy", F.round("edge", 6).alias("edge"))


_SPANS = """, spans AS (SELECT phase, min(d.date) AS a, max(d.date) AS b, count(DISTINCT p.t) AS n FROM phased p JOIN draws d USING (t) GROUP BY 1)"""


@query(RANDOM_PHASED + _SPANS + f"""
SELECT 'fam-' || lower(strategy) || '-aaaaaaaa-bbbbbbbb' AS experiment_id, strategy AS strategy_id, round(average_matches, 6) AS average_matches, round(edge, 6) AS effect_size, round(p_value, 5) AS p_value, round(adjusted_p, 5) AS adjusted_p,
       (SELECT string_agg(lower(phase) || ' ' || a || ' ' || b || ' ' || n, ',' ORDER BY lower(phase)) FROM spans) AS temporal_split
FROM adjusted WHERE phase = 'TEST'""")
def experiment_artifacts(spark, d):
    """One artifact a strategy from the report, with the TEST numbers."""
    rows = settled(all_draws(spark, d), "draws")
    report = settled(walkforward.report_rows(rows, LOOKBACK), "report")
    scores = walkforward.with_phases(rows.where(F.col("t") >= LOOKBACK), rows.count() - LOOKBACK, LOOKBACK)
    a = registry.artifacts(report, scores, "fam", "a" * 64, "b" * 64, "v1", 645, LOOKBACK)
    split = F.array_join(F.transform(F.map_entries("temporal_split"), lambda e: F.concat_ws(" ", e["key"], e["value"]["start_date"], e["value"]["end_date"], e["value"]["trials"].cast("string"))), ",")
    return a.select("experiment_id", "strategy_id", F.round("metrics.average_matches", 6).alias("average_matches"), F.round("statistics.effect_size", 6).alias("effect_size"), F.round("statistics.p_value", 5).alias("p_value"), F.round("statistics.adjusted_p", 5).alias("adjusted_p"), split.alias("temporal_split"))


# ---- seeded streams and exact tails ---------------------------------------------------------------------------------


@query(f"SELECT seed, array_to_string({sql_ticket('swaps')}, ',') AS ticket FROM (SELECT seed, {sql_swaps('w')} AS swaps FROM (SELECT o_orderkey AS seed, (CASE WHEN o_orderkey = 0 THEN 1831565813 ELSE o_orderkey END)::UBIGINT AS w FROM orders))")
def random_pick(spark, d):
    """A ticket for each order, seeded by its key."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("seed"), text(rng.random_pick(F.col("o_orderkey"))).alias("ticket"))


_H1 = f"((xor(xor(645, 2654435769)::UBIGINT, t::UBIGINT) * 2246822507) & {_M})"
_H2 = f"((xor({_H1}, {_H1} >> 13) * 3266489909) & {_M})"


@query(DRAWS + f", s AS (SELECT t, result, {sql_swaps('w')} AS swaps FROM (SELECT t, result, xor({_H2}, {_H2} >> 16) AS w FROM draws WHERE t >= 90)) SELECT t, array_to_string({sql_ticket('swaps', 18)}, ',') AS pool, CAST(len(list_intersect({sql_ticket('swaps', 18)}, result)) AS INT) AS k FROM s")
def pool18_random(spark, d):
    """The seeded random pool of each draw; a pool without 18 distinct numbers would be an error."""
    late = all_draws(spark, d).where(F.col("t") >= LOOKBACK).withColumn("pool", checks.valid_pool(rng.pool_pick(645, 18)(F.col("t"))))
    return late.select("t", text("pool").alias("pool"), rules.matches(F.col("pool"), F.col("result")).alias("k"))


def _plans() -> str:
    return " UNION ALL ".join(f"SELECT {n} AS n, ticket FROM (VALUES {_literal(n)}) AS v(i, ticket)" for n in (10, 20, 30))


@query(DRAWS + f""", plans AS ({_plans()}),
met AS (SELECT n, t, max(len(list_intersect(ticket, result))) AS k FROM plans, draws GROUP BY 1, 2), held AS (SELECT n, avg(k) AS observed FROM met GROUP BY 1),
slots AS (SELECT n, i, sim, (sim * (n + 1) + i) * 44 AS skip FROM (SELECT unnest([10, 20, 30]) AS n), LATERAL (SELECT unnest(range(0, n + 1)) AS i), (SELECT unnest(range(0, 3000)) AS sim)),
tickets AS (SELECT n, sim, i, {sql_ticket('swaps')} AS ticket FROM (SELECT n, sim, i, {sql_swaps('645::UBIGINT', 'skip')} AS swaps FROM slots)),
drawn AS (SELECT n, sim, ticket AS result FROM tickets WHERE i = 0),
random AS (SELECT n, sim, max(len(list_intersect(ticket, result))) AS k FROM tickets JOIN drawn USING (n, sim) WHERE i > 0 GROUP BY 1, 2),
planned AS (SELECT n, sim, max(len(list_intersect(ticket, result))) AS k FROM plans JOIN drawn USING (n) GROUP BY 1, 2)
SELECT CAST(n AS BIGINT) AS tickets, count(*) AS simulations, round(avg(p.k), 9) AS planned_mean_best, round(avg(r.k), 9) AS random_mean_best, round(avg(CAST(p.k >= 4 AS INT)), 9) AS planned_rate_4, round(avg(CAST(r.k >= 4 AS INT)), 9) AS random_rate_4,
       round(avg(CAST(p.k >= 5 AS INT)), 9) AS planned_rate_5, round(avg(CAST(r.k >= 5 AS INT)), 9) AS random_rate_5, round(any_value(observed), 9) AS observed_mean_best FROM planned p JOIN random r USING (n, sim) JOIN held USING (n) GROUP BY n""")
def portfolio_mc(spark, d):
    """Planned against random tickets on simulated draws, and the planned ones on all derived draws."""
    sizes = (10, 20, 30)
    rows = settled(all_draws(spark, d).select("t", "result"), "draws")
    seen = [portfolio.best_match(rows, portfolio.planned_tickets(n)).agg(F.avg("best").alias("b")).select(F.lit(n).cast("long").alias("tickets"), F.round("b", 9).alias("observed_mean_best")) for n in sizes]
    s = portfolio.simulations(spark, list(sizes)).join(seen[0].unionByName(seen[1]).unionByName(seen[2]), "tickets")
    return s.select("tickets", "observed_mean_best", "simulations", *[F.round(c, 9).alias(c) for c in ("planned_mean_best", "random_mean_best", "planned_rate_4", "random_rate_4", "planned_rate_5", "random_rate_5")])


@query(f"SELECT o_custkey, f AS b, o AS c, CASE WHEN f + o < 6 THEN NULL ELSE round(least(1, 2 * (SELECT sum(exp(lgamma(f + o + 1) - lgamma(k + 1) - lgamma(f + o - k + 1)) / pow(2, f + o)) FROM range(0, 200) x(k) WHERE k <= least(f, o))) + 1e-12, 9) END AS p FROM {_BOUGHT}")
def mcnemar(spark, d):
    """Orders of each customer in one of two states against the other; p is a fraction of a power of two, so ties of the rounding are pushed up."""
    return bought(spark, d).select("o_custkey", F.col("f").alias("b"), F.col("o").alias("c"), F.round(numeric.mcnemar_p(F.col("f"), F.col("o")) + 1e-12, 9).alias("p"))


_PMF = "exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({p}) + (n - k) * ln(1 - {p}))"


@query(f"""WITH RECURSIVE given AS (SELECT DISTINCT n, f AS x, 0 AS place FROM {_BOUGHT}),
halved AS (SELECT n, x, place, 0 AS step, 0.0::DOUBLE AS la, 1.0::DOUBLE AS lb, 0.0::DOUBLE AS ha, 1.0::DOUBLE AS hb FROM given
  UNION ALL SELECT n, x, place, step + 1, CASE WHEN l THEN (la + lb) / 2 ELSE la END, CASE WHEN l THEN lb ELSE (la + lb) / 2 END, CASE WHEN h THEN (ha + hb) / 2 ELSE ha END, CASE WHEN h THEN hb ELSE (ha + hb) / 2 END FROM (
    SELECT *, (SELECT coalesce(sum({_PMF.format(p='((la + lb) / 2)')}), 0) FROM range(0, 200) r(k) WHERE k >= x AND k <= n) < 0.025 AS l,
              (SELECT coalesce(sum({_PMF.format(p='((ha + hb) / 2)')}), 0) FROM range(0, 200) r(k) WHERE k <= x AND k <= n) > 0.025 AS h FROM halved WHERE step < 40))
SELECT n, x, round(CASE WHEN x = 0 THEN 0 ELSE (la + lb) / 2 END, 9) AS low, round(CASE WHEN x = n THEN 1 ELSE (ha + hb) / 2 END, 9) AS high FROM halved WHERE step = 40""")
def clopper_pearson(spark, d):
    """Intervals for every share of one state among as many orders as some customer has."""
    counts = bought(spark, d).select("n", F.col("f").alias("x")).distinct()
    ci = numeric.interval(F.col("n"), F.col("x"))
    return counts.withColumn("ci", ci).select("n", "x", F.round("ci.low", 9).alias("low"), F.round("ci.high", 9).alias("high"))


@query(f"WITH c AS (SELECT n, q, k, sum({_PMF.format(p='0.3')}) OVER (PARTITION BY n, q ORDER BY k) AS cdf FROM (SELECT DISTINCT n FROM {_BOUGHT}), (SELECT unnest([0.025, 0.5, 0.975]) AS q), LATERAL (SELECT unnest(range(0, n + 1)) AS k)) SELECT CAST(n AS BIGINT) AS n, CAST(q AS DOUBLE) AS q, min(k) AS quantile FROM c WHERE cdf >= q GROUP BY 1, 2")
def binomial_quantile(spark, d):
    sizes = bought(spark, d).select("n").distinct().select("n", F.explode(F.array(*map(F.lit, (0.025, 0.5, 0.975)))).alias("q"))
    return sizes.select("n", "q", numeric.quantile(F.col("n"), 0.3, F.col("q")).alias("quantile"))


@query(DRAWS + f", k AS (SELECT year(date) AS year, CAST({pool18.P0!r} AS DOUBLE) AS p, count(*) AS n FROM draws GROUP BY 1) SELECT CAST(year AS INT) AS year, n, round(n * p, 9) AS expected_hits, round(pow(1 - p, n), 9) AS p_zero, n * p < 5 AS underpowered FROM k")
def null_calibration(spark, d):
    """What chance alone gives in the draws of each year."""
    years = all_draws(spark, d).groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return pool18.calibrated(years).select("year", "n", F.round("expected_hits", 9).alias("expected_hits"), F.round("p_zero", 9).alias("p_zero"), "underpowered")


_CONTROL = RANKED + f", s AS (SELECT t, result, {sql_swaps('w')} AS swaps FROM (SELECT t, result, ((t + 1) * 131 + unnest(range(0, 32)))::UBIGINT AS w FROM draws WHERE t >= 90)), c AS (SELECT t, CAST(avg(len(list_intersect({sql_ticket('swaps')}, result))) AS DOUBLE) AS k FROM s GROUP BY t)"


@query(_CONTROL + "SELECT round(avg(k), 9) AS observed_mean, CAST(0.8 AS DOUBLE) AS expected_mean, round(abs(avg(k) - 0.8), 9) AS difference, count(*) AS trials FROM c")
def control_random_baseline(spark, d):
    c = controls.random_baseline(all_draws(spark, d), LOOKBACK)
    return c.select(F.round("observed_mean", 9).alias("observed_mean"), "expected_mean", F.round("difference", 9).alias("difference"), "trials")


@query(RANKED + "SELECT count(*) AS trials, round(avg(len(list_intersect(HOT, result))) - 0.8, 9) AS safe_edge, CAST(6 AS DOUBLE) AS leaked_mean, CAST(1 AS DOUBLE) AS leaked_jackpot_rate, round(CAST(5.2 AS DOUBLE), 9) AS leaked_edge, 5.2 > avg(len(list_intersect(HOT, result))) - 0.8 + 1 AS leak_detected FROM draws JOIN picks USING (t)")
def control_future_leak(spark, d):
    c = controls.future_leak(all_draws(spark, d), LOOKBACK)
    return c.select("trials", F.round("safe_edge", 9).alias("safe_edge"), "leaked_mean", "leaked_jackpot_rate", F.round("leaked_edge", 9).alias("leaked_edge"), "leak_detected")


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
walk AS (SELECT user_id, ts, n, true AS allowed, ms AS last, NULL::BIGINT AS before, 0::BIGINT AS wait FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.ts, e.n, ok, CASE WHEN ok THEN ms ELSE last END, CASE WHEN ok THEN last ELSE before END, CASE WHEN ok THEN 0 ELSE 86400000 - (ms - before) END
  FROM (SELECT e.*, w.last, w.before, NOT (before IS NOT NULL AND ms - before < 86400000 AND ms - last < 86400000) AS ok FROM e JOIN walk w ON w.user_id = e.user_id AND e.n = w.n + 1) e)
SELECT user_id, ts, allowed, wait AS retry_after_ms FROM walk""")
def rate_limit(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return limits.limited(e, 3_600_000 * 24, 2)


# ---- checks and requests --------------------------------------------------------------------------------------------

_LINE = """'{"date":"' || CAST(date AS VARCHAR) || '","id":"' || id || '","result":[' || array_to_string(result, ',') || ']}'"""
_DIGEST = f"sha256(string_agg({_LINE}, chr(10) ORDER BY t) || chr(10))"


@query(DRAWS + f"SELECT {_DIGEST} AS sha256, count(*) AS records FROM draws")
def dataset_sha256(spark, d):
    rows = settled(all_draws(spark, d), "draws")
    return spark.createDataFrame([(checks.digest_of(rows), rows.count())], "sha256 string, records bigint")


@query(DRAWS + f"""SELECT true AS continuous, 0::BIGINT AS missing, CAST(min(date) AS VARCHAR) AS "firstDate", CAST(max(date) AS VARCHAR) AS "lastDate", min(id) AS "firstId", max(id) AS "lastId", count(*) AS "recordCount", 2::BIGINT AS "schemaVersion", {_DIGEST} AS sha256 FROM draws""")
def manifest(spark, d):
    rows = settled(all_draws(spark, d), "draws")
    m = jsonl.manifest(rows, merge.continuity(rows), checks.digest_of(rows))
    return spark.createDataFrame([tuple(m[k] for k in sorted(m))], ", ".join(f"{k} {'boolean' if isinstance(m[k], bool) else 'bigint' if isinstance(m[k], int) else 'string'}" for k in sorted(m)))


@query(DRAWS + """SELECT 'not_empty' AS "check", true AS ok, CAST(count(*) AS VARCHAR) AS detail FROM draws UNION ALL SELECT 'manifest_present', true, NULL UNION ALL SELECT 'digest', false, repeat('0', 16)
UNION ALL SELECT 'record_count', false, CAST(count(*) AS VARCHAR) FROM draws UNION ALL SELECT 'ids_and_order', false, 'id repeats the row at 0' UNION ALL SELECT 'canonical', false, CAST(count(*) FILTER (t % 9 = 1) AS VARCHAR) FROM draws""")
def data_check(spark, d):
    """A table with one repeated id, lines that differ, and a manifest of other data."""
    rows = settled(all_draws(spark, d), "draws")
    lines = jsonl.serialised(rows).join(rows.select("id", "t"), "id").select("t", F.when(F.col("t") % 9 == 1, "{}").otherwise(F.col("line")).alias("line"))
    wrong = {"schemaVersion": 2, "recordCount": -1, "sha256": "f" * 64}
    whole = checks.data_check(rows, wrong, "0" * 64, lines)
    repeated = merge.dataset_issues(rows.withColumn("id", F.when(F.col("t") == 3, "00000001").otherwise(F.col("id"))))
    first = repeated.agg((F.count(F.lit(1)) == 0).alias("ok"), F.min_by("reason", F.struct("index", "reason")).alias("detail")).select(F.lit("ids_and_order").alias("check"), "ok", "detail")
    return whole.where(F.col("check") != "ids_and_order").unionByName(first)


@query(DRAWS + "SELECT count(*) FILTER (t % 17 <> 0) AS records, min(id) FILTER (t % 17 <> 0) AS first_id, max(id) FILTER (t % 17 <> 0) AS latest_id, min(date) FILTER (t % 17 <> 0) AS first_date, max(date) FILTER (t % 17 <> 0) AS latest_date, max(t) FILTER (t % 17 <> 0) - min(t) FILTER (t % 17 <> 0) + 1 - count(*) FILTER (t % 17 <> 0) AS n_missing, 0::BIGINT AS n_duplicates, false AS continuous, 7::BIGINT AS manifest_records, 'abc' AS manifest_sha256 FROM draws")
def data_status(spark, d):
    return checks.status(all_draws(spark, d).where("t % 17 <> 0"), {"recordCount": 7, "sha256": "abc"})


@query(DRAWS + f"""SELECT 'dataset' AS "check", true AS ok, count(*) || ' rows' AS detail FROM draws UNION ALL SELECT 'manifest', true, 'digest fits' UNION ALL SELECT 'protocolLock', false, 'wrong shape' UNION ALL SELECT 'requiredArtifact', false, 'not readable'""")
def readiness(spark, d):
    rows = settled(all_draws(spark, d), "draws")
    digest = checks.digest_of(rows)
    validated = jsonl.validated(jsonl.serialised(rows).select(F.monotonically_increasing_id().alias("line"), F.col("line").alias("value")))
    return checks.readiness(spark, validated, jsonl.manifest(rows, merge.continuity(rows), digest), digest, {"protocolVersion": "v1"}, None)


_DISORDERED = DRAWS + """, r AS (SELECT t, CASE WHEN t % 50 = 3 THEN '00000001' ELSE id END AS id FROM draws), i AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS nth, count(*) OVER () AS n FROM r WHERE id = '00000001' AND t > 0)"""


@query(_DISORDERED + " SELECT nth, 'id 00000001: id repeats the row at 0' AS text FROM i WHERE nth < 10 UNION ALL SELECT 10, 'and ' || (n - 10) || ' more' FROM (SELECT any_value(n) AS n FROM i) WHERE n > 10")
def issue_report(spark, d):
    """The first ten issues and a line for the rest."""
    rows = all_draws(spark, d).withColumn("id", F.when(F.col("t") % 50 == 3, "00000001").otherwise(F.col("id"))).withColumn("date", F.date_add(F.lit("2000-01-01").cast("date"), F.col("t").cast("int")))
    return checks.report_lines(merge.dataset_issues(rows))


@query("SELECT event_id, CASE WHEN s = 'not-modified' OR (s = 'ok' AND event_id % 3 = 0) THEN 'up-to-date' WHEN s = 'ok' THEN 'updated' WHEN event_id % 5 > 2 THEN 'conflict' ELSE 'error' END AS state FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'not-modified' WHEN 1 THEN 'error' ELSE 'ok' END AS s FROM events)")
def refresh_states(spark, d):
    n = F.col("event_id")
    state = F.when(n % 4 == 0, "not-modified").when(n % 4 == 1, "error").otherwise("ok")
    conflicts = F.when(n % 5 > 2, n % 5).otherwise(0)
    return table(spark, d, "events").select("event_id", checks.refresh_state(state, n % 3, conflicts).alias("state"))


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 200 WHEN 1 THEN 400 WHEN 2 THEN 400 WHEN 3 THEN 403 WHEN 4 THEN 400 WHEN 5 THEN 413 WHEN 6 THEN 400 ELSE 200 END AS status,
CASE event_id % 8 WHEN 1 THEN 'body is no object' WHEN 2 THEN 'force is no boolean' WHEN 3 THEN 'force is not allowed' WHEN 4 THEN 'records is no list' WHEN 5 THEN 'too many records' WHEN 6 THEN 'manifest is no object' END AS problem FROM events""")
def refresh_requests(spark, d):
    bodies = ["{}", "[1]", '{"force": 1}', '{"force": true}', '{"records": {}}', '{"records": [1, 2, 3]}', '{"manifest": []}', '{"force": false, "records": [{}], "manifest": null, "revalidateOfficialCache": true}']
    body = F.get(F.array(*map(F.lit, bodies)), (F.col("event_id") % 8).cast("int"))
    return checks.refresh_requests(table(spark, d, "events").select("event_id", body.alias("body")), most=2).drop("body")


@query(DRAWS + "SELECT date, count(*) AS n FROM draws WHERE date < DATE '1998-04-14' GROUP BY 1")
def as_of(spark, d):
    """Rows before a date, past the guard that no later row is among them."""
    history = checks.without_later_rows(checks.before(all_draws(spark, d), "1998-04-14"), "1998-04-14")
    return history.groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query(DRAWS + "SELECT id, date FROM draws WHERE CAST(id AS BIGINT) > 700")
def since_cursor(spark, d):
    return limits.since(all_draws(spark, d), "00000700").select("id", "date")


_PAGES = DRAWS + ", p AS (SELECT CAST((SELECT count(*) - 1 FROM draws) - t AS BIGINT) // 8 AS page, * FROM draws), stop AS (SELECT min(page) AS last FROM p WHERE CAST(id AS BIGINT) <= 900)"


@query(_PAGES + "SELECT CAST(page AS INT) AS page, id FROM p, stop WHERE page <= last AND CAST(id AS BIGINT) > 900")
def crawl_since(spark, d):
    """Pages of eight, newest first, down to the page that reaches a known id."""
    rows = settled(all_draws(spark, d), "draws")
    n = rows.count()
    return paged.crawl(rows.select(F.expr(f"({n - 1} - t) div 8").cast("int").alias("page"), "id", F.col("date").cast("string").alias("date"), "result"), "00000900", True).select("page", "id")


@query("SELECT * FROM (SELECT lang AS source, max(doc_id) AS last_date, count(*) AS records FROM documents WHERE lang IS NOT NULL GROUP BY lang) ORDER BY last_date DESC, records DESC, source <> 'cache' LIMIT 1")
def best_snapshot(spark, d):
    docs = table(spark, d, "documents").where("lang is not null")
    return jsonl.best_snapshot(docs.groupBy(F.col("lang").alias("source")).agg(F.max("doc_id").alias("last_date"), F.count(F.lit(1)).alias("records")))


# ---- sources against each other -------------------------------------------------------------------------------------

_SAMPLE = DRAWS + """, s AS (SELECT *, result <> list_sort(list_transform(result, lambda x: x % 45 + 1)) AS other FROM draws WHERE t % 97 = 0)
, c AS (SELECT id, t % 5 = 0 OR t % 11 = 0 AS fetch_error, list_filter([CASE WHEN t % 3 = 0 AND NOT (t % 5 = 0 OR t % 11 = 0) THEN 'detail differs' END, CASE WHEN t % 7 = 0 AND t % 2 = 0 THEN 'mirror differs' END], lambda x: x IS NOT NULL) AS m FROM s)"""


def _checked(spark, d):
    rows = settled(all_draws(spark, d).where("t % 97 = 0"), "sample")
    other = F.array_sort(F.transform("result", lambda x: x % 45 + 1))
    t = F.col("t")
    detail = rows.where("t % 11 <> 0").select("id", "date", F.when(t % 3 == 0, other).otherwise(F.col("result")).alias("result"), F.when(t % 5 == 0, "timeout").alias("error"))
    mirror = rows.where("t % 2 = 0").select("id", "date", F.when(t % 7 == 0, other).otherwise(F.col("result")).alias("result"))
    return merge.cross_check(rows.select("id", "date", "result"), detail, mirror, rows.select("id"))


@query(_SAMPLE + " SELECT id, fetch_error, array_to_string(m, ',') AS mismatches FROM c")
def cross_check(spark, d):
    return _checked(spark, d).select("id", "fetch_error", F.array_join("mismatches", ",").alias("mismatches"))


@query(_SAMPLE + " SELECT count(*) AS sample_size, count(*) FILTER (len(m) > 0) AS failures, count(*) FILTER (fetch_error) AS fetch_errors, CASE WHEN count(*) FILTER (len(m) > 0) > 0 THEN 'FAIL' WHEN count(*) FILTER (fetch_error) > 0 THEN 'PARTIAL' ELSE 'PASS' END AS status FROM c")
def cross_check_status(spark, d):
    return merge.cross_check_status(_checked(spark, d))


@query()
def cross_check_sample(spark, d):
    """First, last, middle and five seeded draws of all, each looked up in raw form: checked, and compared with what is held."""
    rows = settled(all_draws(spark, d).select("t", "id", "date", "result"), "draws")
    t = F.col("t")
    good = hashing.draw_json(F.col("date").cast("string"), F.col("id"), F.col("result"))
    raw = F.when(t % 3 == 0, hashing.draw_json(F.col("date").cast("string"), F.col("id"), F.slice("result", 1, 5))).when(t % 5 != 0, good)
    details = merge.checked_details(rows.select("id", raw.alias("value"), F.when(t % 5 == 0, "timeout").alias("error")))
    return merge.cross_check(rows, details, None, merge.sample_ids(rows, 5, 645)).select("id", "fetch_error", "error", F.array_join("mismatches", ",").alias("mismatches"))


_LOCAL = DRAWS + ", n AS (SELECT count(*) AS n, count(*) - count(*) // 100 - 1 AS held FROM draws)"


@query(_LOCAL + """ SELECT 'as held' AS source, n - held AS new_rows, 8::BIGINT AS sample_size, 0::BIGINT AS failures, 1::BIGINT AS fetch_errors, 'PASS' AS outcome, 0 AS exit_code FROM n
UNION ALL SELECT 'latest differs', n - held, 8, 1, 0, 'FAIL', 1 FROM n UNION ALL SELECT 'no change', NULL, 8, 0, 0, 'PASS', 0 FROM n UNION ALL SELECT 'change without rows', 0, 8, 0, 0, 'FAIL', 1 FROM n""")
def verify_live(spark, d):
    """All draws but the newest hundredth are held; pages of eight are crawled down to the latest of these, and sampled draws looked up in raw form."""
    rows = settled(all_draws(spark, d).select("t", "id", "date", "result"), "draws")
    n = rows.count()
    held = n - n // 100 - 1
    local = rows.where(F.col("t") < held)
    pages = rows.select(F.expr(f"({n - 1} - t) div {paged.PAGE_SIZE}").cast("int").alias("page"), "id", F.col("date").cast("string").alias("date"), "result")
    new = lambda latest: paged.crawl(pages, latest, True)
    last = F.col("t") == held - 1

    def looked_up(error, result):
        raw = rows.select("id", hashing.draw_json(F.col("date").cast("string"), F.col("id"), result).alias("value"), error.cast("string").alias("error"))
        return lambda ids: merge.checked_details(raw.join(F.broadcast(ids), "id"))  # the sample: eight ids at most

    none, as_is = F.lit(None), F.col("result")
    other = F.when(last, F.array_sort(F.transform("result", lambda x: x % 45 + 1))).otherwise(as_is)
    cases = {
        "as held": (new, looked_up(F.when(F.col("t") == 0, "timeout"), as_is)), "latest differs": (new, looked_up(none, other)),
        "no change": (lambda latest: None, looked_up(none, as_is)), "change without rows": (lambda latest: pages.where("false"), looked_up(none, as_is)),
    }
    return checks.union([checks.verify_live(local, crawl, lookup).select(F.lit(case).alias("source"), "*") for case, (crawl, lookup) in cases.items()])


# ---- predictions ----------------------------------------------------------------------------------------------------

_ENTRIES = DRAWS + """, e AS (SELECT id AS draw_id, CASE t % 3 WHEN 0 THEN 'HOT' WHEN 1 THEN 'COLD' ELSE 'BALANCED' END AS strategy_id, lpad(CAST(t * 7919 % 100003 AS VARCHAR), 6, '0') AS frozen_at, [3, 11, 19, 27, 35, 43] AS prediction,
CASE WHEN t % 4 = 0 THEN [1, 2, 3, 4, 5, 6] END AS result, CASE WHEN t % 4 = 0 THEN 1 END AS matches, CASE WHEN t % 4 = 0 THEN 'NONE' END AS tier FROM draws)"""


def _entries(spark, d):
    t = F.col("t")
    old = t % 4 == 0
    return all_draws(spark, d).select(
        F.col("id").alias("draw_id"), F.when(t % 3 == 0, "HOT").when(t % 3 == 1, "COLD").otherwise("BALANCED").alias("strategy_id"), F.lpad((t * 7919 % 100003).cast("string"), 6, "0").alias("frozen_at"),
        F.array(*map(F.lit, (3, 11, 19, 27, 35, 43))).alias("prediction"), F.when(old, F.array(*map(F.lit, range(1, 7)))).alias("result"), F.when(old, 1).alias("matches"), F.when(old, "NONE").alias("tier"),
    )


_TIER = "CASE {k} WHEN 6 THEN 'JACKPOT' WHEN 5 THEN 'FIRST' WHEN 4 THEN 'SECOND' WHEN 3 THEN 'THIRD' ELSE 'NONE' END"


@query(_ENTRIES + f" SELECT draw_id, strategy_id, array_to_string(coalesce(e.result, d.result), ',') AS result, CAST(CASE WHEN e.result IS NULL AND d.id IS NOT NULL THEN len(list_intersect(prediction, d.result)) ELSE matches END AS INT) AS matches, CASE WHEN e.result IS NULL AND d.id IS NOT NULL THEN {_TIER.format(k='len(list_intersect(prediction, d.result))')} ELSE tier END AS tier FROM e LEFT JOIN (SELECT * FROM draws WHERE t % 2 = 0) d ON d.id = draw_id")
def prospective_results(spark, d):
    results = all_draws(spark, d).where("t % 2 = 0").select(F.col("id").alias("draw_id"), "result")
    return prospective.with_results(_entries(spark, d), results).select("draw_id", "strategy_id", text("result").alias("result"), "matches", "tier")


@query(_ENTRIES + " SELECT count(*) AS total_frozen, count(*) FILTER (result IS NULL) AS pending, count(*) FILTER (result IS NOT NULL) AS scored FROM e")
def prospective_counts(spark, d):
    return prospective.counts(_entries(spark, d))


@query(_ENTRIES + " SELECT draw_id, strategy_id, frozen_at, CASE WHEN result IS NULL THEN 'PENDING' ELSE 'SCORED' END AS status, matches, tier FROM e")
def prospective_entries(spark, d):
    return prospective.summary_entries(_entries(spark, d))


@query(_ENTRIES + " SELECT id AS draw_id, s AS strategy_id FROM (SELECT id, unnest(['HOT', 'COLD', 'BALANCED']) AS s FROM draws) WHERE (id, s) NOT IN (SELECT draw_id, strategy_id FROM e)")
def prospective_unfrozen(spark, d):
    c = all_draws(spark, d).select(F.col("id").alias("draw_id"), F.explode(F.array(*map(F.lit, walkforward.RULES))).alias("strategy_id"))
    return prospective.unfrozen(c, _entries(spark, d))


@query(_ENTRIES + f" SELECT draw_id, CAST(len(list_intersect(prediction, d.result)) AS INT) AS matches, {_TIER.format(k='len(list_intersect(prediction, d.result))')} AS tier FROM e JOIN draws d ON d.id = draw_id WHERE e.result IS NULL")
def prospective_due(spark, d):
    pending = _entries(spark, d).where("result is null").select("draw_id", "prediction")
    return provenance.due(pending, all_draws(spark, d)).select("draw_id", "matches", "tier")


@query(DRAWS + """, c AS (SELECT t, id AS draw_id, CASE t % 5 WHEN 0 THEN 'old' ELSE 'now' END AS h, CASE WHEN t % 4 = 0 THEN [1, 1, 2, 3, 4, 5] ELSE result END AS ticket FROM draws)
SELECT draw_id, CASE WHEN h <> 'now' THEN 'protocol hash has changed' WHEN CAST(draw_id AS BIGINT) < 500 THEN 'draw is not prospective' WHEN t % 3 = 0 THEN 'result is already known' WHEN t % 4 = 0 THEN 'ticket is not valid' END AS refusal FROM c""")
def freeze_refusals(spark, d):
    t = F.col("t")
    rows = all_draws(spark, d)
    c = rows.select(F.col("id").alias("draw_id"), F.when(t % 5 == 0, "old").otherwise("now").alias("protocol_hash"), F.when(t % 4 == 0, F.array(*map(F.lit, (1, 1, 2, 3, 4, 5)))).otherwise(F.col("result")).alias("ticket"))
    return provenance.freeze(c, rows.where("t % 3 = 0"), {"protocolHash": "now", "startDrawId": "00000500"}).select("draw_id", "refusal")


_LEDGER = ['{"drawId":"7","frozenAt":"2026-01-01T00:00:00Z","protocolHash":"p","datasetHashAtFreeze":"d","strategyId":"HOT","prediction":[1,2,3,4,5,6],"result":null,"matches":null,"tier":null', '{"kind":"SCORED","entryId":"e","drawId":"7","strategyId":"HOT","scoredAt":"2026-01-02T00:00:00Z","result":[1,2,3,4,5,%s],"matches":%s,"tier":"THIRD","previousEntryHash":null,"entryHash":"h"}']


@query("""SELECT event_id AS line, CASE event_id % 8 WHEN 0 THEN 'LEGACY' WHEN 1 THEN 'FROZEN' WHEN 2 THEN 'FROZEN' WHEN 3 THEN 'SCORED' WHEN 4 THEN 'SCORED' WHEN 5 THEN 'SCORED' END AS format,
CASE event_id % 8 WHEN 2 THEN 'entryId is missing or blank' WHEN 4 THEN 'result is no ticket' WHEN 5 THEN 'matches is out of range' WHEN 6 THEN 'unknown kind' WHEN 7 THEN 'line is not JSON' END AS problem FROM events""")
def ledger_problems(spark, d):
    entry, score = _LEDGER
    values = [entry + "}", entry + ',"kind":"FROZEN","entryId":"e","previousEntryHash":null,"entryHash":"h"}', entry + ',"kind":"FROZEN","previousEntryHash":null,"entryHash":"h"}', score % (6, 3), score % (46, 3), score % (6, 7), '{"kind":"OTHER"}', "{"]
    lines = table(spark, d, "events").select(F.col("event_id").alias("line"), F.get(F.array(*map(F.lit, values)), (F.col("event_id") % 8).cast("int")).alias("value"))
    return prospective.ledger_problems(lines)


@query(_CHAIN.replace("SELECT line, prev", "SELECT count(*) AS chained, count(*) FILTER (NOT (link_ok AND hash_ok)) AS violations, count(*) FILTER (NOT (link_ok AND hash_ok)) = 0 AS verified FROM (SELECT line, prev") + ")")
def chain_health(spark, d):
    """Sound and broken lines of the chain of all events."""
    return provenance.chain_health(provenance.verify_chain(chain_rows(spark, d)))


_AUDIT = "WITH chain AS (SELECT * FROM (" + _CHAIN.replace("CASE WHEN event_id % 11", "CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 11") + """)),
r AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS e, 'a' || doc_id % 5 AS p, 'b' || doc_id % 2 AS s FROM documents),
f AS (SELECT doc_id, CASE WHEN doc_id % 41 <> 0 THEN e END AS e, CASE WHEN doc_id % 50 = 0 THEN 'x/other.json' ELSE 'x/' || e || '.json' END AS file, 'c' AS content FROM r
      UNION ALL SELECT doc_id, CASE WHEN doc_id % 41 <> 0 THEN e END, 'y/' || e || '.json', CASE WHEN doc_id % 2 = 0 THEN 'c' ELSE 'd' END FROM r WHERE doc_id % 13 = 0),
v AS (SELECT 'UNRECOGNISED_PROTOCOL_HASH' AS kind, e AS experiment_id, p AS detail, doc_id FROM r WHERE doc_id % 5 = 4
      UNION ALL SELECT 'PROTOCOL_HASH_MISMATCH', e, p || ' a' || doc_id % 3, doc_id FROM r WHERE doc_id % 41 <> 0 AND doc_id % 5 <> doc_id % 3
      UNION ALL SELECT 'DATASET_HASH_MISMATCH', e, s || ' b' || doc_id % 7, doc_id FROM r WHERE doc_id % 41 <> 0 AND doc_id % 2 <> doc_id % 7
      UNION ALL SELECT 'ARTIFACT_COLLISION', e, CAST(count(DISTINCT content) AS VARCHAR), 1 FROM f WHERE e IS NOT NULL GROUP BY e HAVING count(DISTINCT content) > 1
      UNION ALL SELECT 'ARTIFACT_NAME', e, file, doc_id FROM f WHERE e IS NOT NULL AND file = 'x/other.json'
      UNION ALL SELECT 'ARTIFACT_MALFORMED', file, 'file is no artifact', 1 FROM f WHERE e IS NULL),
findings AS (
  SELECT CASE WHEN x THEN 'EXPLAINED' ELSE 'OPEN' END AS severity, kind, experiment_id, detail, CASE WHEN x THEN 'why ' || experiment_id END AS justification
  FROM (SELECT *, doc_id % 4 = 0 AND kind IN ('PROTOCOL_HASH_MISMATCH', 'ARTIFACT_NAME') AS x FROM v)
  UNION ALL SELECT 'FATAL', 'LEDGER_LINE', NULL, CAST(event_id AS VARCHAR), NULL FROM events WHERE event_id % 97 = 0
  UNION ALL SELECT 'FATAL', 'CHAIN_LINK', NULL, CAST(line AS VARCHAR), NULL FROM chain WHERE NOT link_ok
  UNION ALL SELECT 'FATAL', 'CHAIN_HASH', NULL, CAST(line AS VARCHAR), NULL FROM chain WHERE NOT hash_ok)"""


def _findings(spark, d):
    n = F.col("doc_id")
    tag = lambda p, m: F.concat(F.lit(p), (n % m).cast("string"))
    e = n.cast("string")
    docs = table(spark, d, "documents").select("doc_id")
    records = docs.select(e.alias("experiment_id"), tag("a", 5).alias("protocol_hash"), tag("b", 2).alias("dataset_hash"), F.lit("1").alias("protocol_version"))
    recognised = records.select("protocol_hash").where("protocol_hash <> 'a4'")
    file = lambda name, content: (name.alias("file"), content.alias("content"), F.when(n % 41 != 0, e).alias("experiment_id"), tag("a", 3).alias("protocol_hash"), tag("b", 7).alias("dataset_hash"), F.lit("1").alias("protocol_version"))
    files = docs.select(*file(F.when(n % 50 == 0, "x/other.json").otherwise(F.concat(F.lit("x/"), e, F.lit(".json"))), F.lit("c")))
    files = files.unionByName(docs.where(n % 13 == 0).select(*file(F.concat(F.lit("y/"), e, F.lit(".json")), F.when(n % 2 == 0, "c").otherwise("d"))))
    why = lambda kind, detail: docs.where(n % 4 == 0).select(n.alias("line"), F.lit(kind).alias("kind"), e.alias("experiment_id"), detail.alias("detail"), F.concat(F.lit("why "), e).alias("justification"))
    exceptions = why("PROTOCOL_HASH_MISMATCH", F.concat_ws(" ", tag("a", 5), tag("a", 3))).unionByName(why("ARTIFACT_NAME", F.lit("x/other.json")))
    ledger = chain_rows(spark, d).withColumn("format", F.when(F.col("line") % 97 != 0, F.col("format")))
    return provenance.audit(records, recognised, files, ledger, exceptions)


@query(_AUDIT + " SELECT * FROM findings")
def provenance_report(spark, d):
    """Registry, artifact files, exceptions and ledger in one list of findings."""
    return _findings(spark, d)


@query(_AUDIT + " SELECT count(*) FILTER (severity = 'FATAL') AS fatal, count(*) FILTER (severity = 'OPEN') AS unexplained, count(*) FILTER (severity = 'EXPLAINED') AS acknowledged, count(*) FILTER (severity <> 'EXPLAINED') = 0 AS ok FROM findings")
def provenance_status(spark, d):
    return provenance.audit_status(_findings(spark, d))


# ---- registry -------------------------------------------------------------------------------------------------------


def _registry(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("family_id"), F.col("doc_id").cast("string").alias("experiment_id"), F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("lang")).alias("hypothesis_id"), F.col("source").alias("strategy_id"), (F.col("n_chars") % 7).cast("string").alias("dataset_hash"))


@query("WITH m AS (SELECT min(source) AS s FROM documents), f AS (SELECT count(DISTINCT CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END) AS h, count(DISTINCT n_chars % 7) + 1 AS l FROM documents, m WHERE source = s) SELECT (SELECT s FROM m) AS family_id, h AS family_size, h AS hypothesis_count, l AS look_count, 3::BIGINT AS fallback_family_size FROM f UNION ALL SELECT 'none', 3, 3, 1, 3")
def family_summary(spark, d):
    rows = _registry(spark, d)
    first = rows.agg(F.min("family_id")).first()[0]
    return registry.family_summary(rows, first, extra_looks=["x"]).unionByName(registry.family_summary(rows, "none"))


@query("WITH s AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), i AS (SELECT source, 'fam-' || lower(source) || '-aaaaaaaa-bbbbbbbb' AS experiment_id, 'fam-' || lower(source) || '-aaaaaaaa' AS legacy_id, row_number() OVER (ORDER BY source) AS n FROM s) SELECT source AS strategy_id, experiment_id, legacy_id FROM i WHERE n % 3 = 0")
def unregistered(spark, d):
    """A third is registered under its id, a third under its older one."""
    names = settled(table(spark, d, "documents").where("source is not null").select(F.col("source").alias("strategy_id")).distinct(), "strategies")
    placed = names.select("strategy_id", F.row_number().over(Window.orderBy("strategy_id")).alias("n"))  # a name for each source
    named = registry.ids(names, "fam", "a" * 64, "b" * 64)
    known = named.join(placed, "strategy_id").select(F.when(F.col("n") % 3 == 1, F.col("experiment_id")).when(F.col("n") % 3 == 2, F.col("legacy_id")).alias("experiment_id")).where("experiment_id is not null")
    return registry.unregistered(named, known)


@query(DRAWS + "SELECT 'v1' AS protocol_version, 'p' AS protocol_hash, 'then' AS protocol_locked_at, 'd' AS protocol_dataset_hash, lpad(CAST(count(*) + 1 AS VARCHAR), 8, '0') AS prospective_start_draw_id FROM draws")
def protocol_lock(spark, d):
    return registry.protocol_lock(draws.latest_id(all_draws(spark, d)), "v1", "p", "d", "then")


@query(DRAWS + "SELECT 'p' AS protocol_hash, 'v1' AS protocol_version, 'then' AS recorded_at, 'migrated-existing-lock' AS source UNION ALL SELECT 'q', 'v2', 'now', 'lock'")
def protocol_history(spark, d):
    """A history that begins with a lock, gets one entry that is new and one that is not."""
    lock = registry.protocol_lock(draws.latest_id(all_draws(spark, d)), "v1", "p", "d", "then")
    entry = lambda h, v: spark.createDataFrame([(h, v, "now", "lock")], "protocol_hash string, protocol_version string, recorded_at string, source string")
    return provenance.append_history(provenance.append_history(registry.history_of_lock(lock), entry("q", "v2")), entry("p", "v3"))


_RECORD = {"experimentId": "e", "hypothesisId": "h", "familyId": "f", "strategyId": "HOT", "strategyVersion": "1", "parameters": {}, "seed": 1, "datasetHash": "d", "protocolVersion": "v", "protocolHash": "p", "registeredAt": "2026-01-01T00:00:00Z", "status": "REGISTERED"}


@query("""SELECT event_id AS line, CASE event_id % 8 WHEN 1 THEN 'experimentId is missing or blank' WHEN 2 THEN 'strategyId is unknown' WHEN 3 THEN 'seed is no number' WHEN 4 THEN 'registeredAt is no time' WHEN 5 THEN 'predictions is no list of texts' WHEN 6 THEN 'not an object' WHEN 7 THEN 'not JSON' END AS problem FROM events""")
def registry_problems(spark, d):
    make = lambda **x: hashing.canonical_json({**_RECORD, **x})
    values = [make(predictions=["a"], rankingScoreVersion=None), make(experimentId=""), make(strategyId="WARM"), make(seed="1"), make(registeredAt="soon"), make(predictions=["a", 1]), "[]", "x"]
    lines = table(spark, d, "events").select(F.col("event_id").alias("line"), F.get(F.array(*map(F.lit, values)), (F.col("event_id") % 8).cast("int")).alias("value"))
    return lines.select("line", registry.record_problem(json_value("value")).alias("problem"))


@query("SELECT count(*) AS n, round(avg(power(p - o, 2)), 8) AS brier, count(*) >= 100 AND avg(power(p - o, 2)) <= 0.9 AND e <= 1 AS promoted FROM (SELECT CAST(quality AS DOUBLE) AS o, least(n_chars / 10000.0, 1) AS p, 0 AS e FROM labels JOIN documents USING (doc_id)) GROUP BY e")
def promotion(spark, d):
    p = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    report = provenance.calibration(p.select(F.col("quality").cast("double").alias("outcome"), F.least(F.col("n_chars") / 10000.0, F.lit(1.0)).alias("predicted")))
    return provenance.promotion(report, 100, 0.9, 1.0).select("n", F.round("brier", 8).alias("brier"), "promoted")


@query(DRAWS + "SELECT t, round((" + " + ".join(f"CASE WHEN result[{i}] % 2 = 0 THEN result[{i}] / 10.0 ELSE 0 END" for i in range(1, 7)) + ") / 6, 9) AS score FROM draws")
def ranking_score(spark, d):
    """Mean of the numbers' features, those of odd numbers missing."""
    from ..functions import exact

    features = F.create_map(*[F.lit(x) for n in range(2, 46, 2) for x in (n, n / 10.0)])
    return all_draws(spark, d).select("t", F.round(exact.ranking_score(F.col("result"), features), 9).alias("score"))


# ---- replay ---------------------------------------------------------------------------------------------------------

_BEFORE = DRAWS + f""", target AS (SELECT * FROM draws WHERE t = 1000), history AS (SELECT * FROM draws WHERE date < (SELECT date FROM target)),
win AS (SELECT *, row_number() OVER (ORDER BY t DESC) AS back FROM history QUALIFY back <= 90),
f AS (SELECT num, count(b) AS count, coalesce(min(b) - 1, 90) AS gap FROM (SELECT unnest(range(1, 46)) AS num) LEFT JOIN (SELECT unnest(result) AS num, back AS b FROM win) USING (num) GROUP BY 1),
r AS (SELECT num, row_number() OVER (ORDER BY count DESC, num) AS hot, row_number() OVER (ORDER BY count, gap DESC, num) AS cold, row_number() OVER (PARTITION BY (num - 1) // 15 ORDER BY abs(45 * count - 540), num) AS even FROM f),
frozen AS (SELECT 'HOT' AS strategy, list_sort(list(num) FILTER (hot <= 6)) AS ticket FROM r UNION ALL SELECT 'COLD', list_sort(list(num) FILTER (cold <= 6)) FROM r UNION ALL SELECT 'BALANCED', list_sort(list(num) FILTER (even <= 2)) FROM r
           UNION ALL SELECT 'RANDOM', {sql_ticket('w')} FROM (SELECT {sql_swaps('645::UBIGINT')} AS w))"""


@query(_BEFORE + f", s AS (SELECT strategy, ticket, result, len(list_intersect(ticket, result)) AS k FROM frozen, target) SELECT strategy, array_to_string(ticket, ',') AS ticket, CAST(k AS INT) AS matches, {_TIER.format(k='k')} AS tier, CAST({_PAY} - 10000 AS BIGINT) AS net FROM s")
def replay_scores(spark, d):
    rows = settled(all_draws(spark, d), "draws")
    target = rows.where("t = 1000")
    date = str(target.first()["date"])
    return replay.scored(replay.frozen_tickets(rows, date), target).select("strategy", text("ticket").alias("ticket"), "matches", "tier", "net")


@query(f"WITH plans AS ({_plans()}), " + DRAWS.strip()[5:] + f""", m AS (SELECT n, ticket, len(list_intersect(ticket, result)) AS k FROM plans, draws WHERE t = 1000)
SELECT n AS tickets, CAST(max(k) AS INT) AS best, CAST(sum({_PAY}) AS BIGINT) AS payout, count(*) * 10000 AS cost, 15 * count(*) AS covered_pairs FROM m GROUP BY n""")
def replay_portfolios(spark, d):
    """Any two planned tickets share one number at most, so each covers 15 pairs of its own."""
    return replay.portfolios(all_draws(spark, d).where("t = 1000")).select("tickets", "best", "payout", "cost", "covered_pairs")


@query(DRAWS + ", " + _FACT[5:] + " SELECT 18 AS size, (SELECT count(*) FROM draws WHERE list_max(result) <= 18) AS hits, a.v AS tickets, a.v * 10000 AS cost, round(a.v / 8145060.0, 12) AS p_jackpot, round((SELECT sum(x.v * y.v * CASE x.k WHEN 3 THEN 30000 WHEN 4 THEN 300000 ELSE 10000000 END) / 8145060.0 FROM c x JOIN c y ON y.n = 39 AND y.k = 6 - x.k WHERE x.n = 6 AND x.k BETWEEN 3 AND 5), 9) AS single_ev FROM c a WHERE a.n = 18 AND a.k = 6")
def pool_math(spark, d):
    """Constants of the pool 1 .. 18, and the derived draws that lie in it."""
    hits = all_draws(spark, d).agg(F.count_if(F.array_max("result") <= 18).alias("hits"))
    return replay.pool_math(spark).join(F.broadcast(hits), how="cross").select("size", "hits", "tickets", "cost", F.round("p_jackpot", 12).alias("p_jackpot"), F.round("single_ev", 9).alias("single_ev"))
