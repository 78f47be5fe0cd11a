"""Streams across their period, simulations, flips and bootstraps dealt in blocks, and permutations as tables: all equal to one loop."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from tests.test_goldens import plain_stream, plain_ticket
from tidemark.functions import hashing, numeric, rng
from tidemark.operators import permutation, pool18, resample, walkforward
from tidemark.plans.catalog import sql_swaps, sql_ticket


def plain_value(state):
    """One value by whole numbers of any size."""
    m = 0xFFFFFFFF
    state &= m
    x = ((state ^ (state >> 15)) * (state | 1)) & m
    x = ((x + ((x ^ (x >> 7)) * (x | 61) & m)) & m) ^ x
    return (x ^ (x >> 14)) / 2**32


@pytest.mark.parametrize("seed", [0, 645, 2**32 - 1, -7])
def test_stream_wraps_at_its_period(seed):
    got = rng.stream(seed, 7, rng.PERIOD - 3)
    assert got.tolist() == [plain_value(seed + 0x6D2B79F5 * (k + 1)) for k in range(rng.PERIOD - 3, rng.PERIOD + 4)]
    assert got[3:].tolist() == rng.stream(seed, 4).tolist()
    assert np.array_equal(rng.fair_tickets(seed, 3, rng.PERIOD), rng.fair_tickets(seed, 3, 0))
    far = -(-rng.PERIOD // 44) - 1
    s = plain_stream(645)
    assert rng.fair_tickets(645, 2).tolist() == [plain_ticket(s) for _ in range(2)]
    at = rng.fair_tickets(seed, 2, far)
    u = [plain_value(seed + 0x6D2B79F5 * (k + 1)) for k in range(far * 44, far * 44 + 88)]
    for row, values in zip(at.tolist(), (u[:44], u[44:])):
        pool = list(range(1, 46))
        for i, v in zip(range(44, 0, -1), values):
            j = int(v * (i + 1))
            pool[i], pool[j] = pool[j], pool[i]
        assert row == sorted(pool[:6])


def test_repetitions_have_seeds_of_their_own_beyond_the_period():
    within = rng.unit_seeds(645, 100, 1000)
    assert within.tolist() == [(645 + 0x6D2B79F5 * 1000 * k) & 0xFFFFFFFF for k in range(100)]
    beyond = rng.unit_seeds(645, 2000, 150_000 * 44)
    assert len(set(beyond.tolist())) == 2000
    assert beyond[10:20].tolist() == rng.unit_seeds(645, 2000, 150_000 * 44, 10, 20).tolist() == rng.combine_seed(645, np.arange(10, 20)).tolist()


@pytest.mark.parametrize("work, block", [(1 << 28, 1 << 20), (20_000, 64)])
def test_simulated_counts(spark, monkeypatch, work, block):
    monkeypatch.setattr(resample, "WORK", work)
    monkeypatch.setattr(resample, "DRAWS", block)
    s = plain_stream(645)
    got = {r["sim"]: [r[n] for n in resample.NUMBERS] for r in resample.null_counts(spark, 150, 12).collect()}
    for sim in range(12):
        results = [plain_ticket(s) for _ in range(150)]
        assert got[sim] == [sum(n in r for r in results) for n in range(1, 46)]


def test_simulated_p_as_in_sql(spark):
    """The simulated p-value of a small table by DuckDB alone."""
    draws, sims = 60, 40
    seen = [plain_ticket(plain_stream(900 + i)) for i in range(draws)]
    table = spark.createDataFrame([(i, f"{i:05d}", r) for i, r in enumerate(seen)], "t bigint, id string, result array<int>")
    got = resample.fairness(table, sims).first()
    first = "(sim * 60 + t) * 44"
    sql = f"""WITH tickets AS (SELECT sim, {sql_ticket("swaps")} AS ticket FROM (SELECT sim, {sql_swaps("645::UBIGINT", first)} AS swaps FROM range({sims}) a(sim), range({draws}) b(t))),
    counts AS (SELECT sim, x, count(*) AS c FROM (SELECT sim, unnest(ticket) AS x FROM tickets) GROUP BY ALL), squares AS (SELECT sim, sum(c * c) AS s FROM counts GROUP BY sim)
    SELECT (count(*) FILTER (s >= {sum(sum(n in r for r in seen) ** 2 for n in range(1, 46))}) + 1) / {sims + 1}.0, count(*) FROM squares"""
    p, n = duckdb.sql(sql).fetchall()[0]
    assert (got["p_value"], got["simulations"]) == (pytest.approx(p), n)


@pytest.mark.parametrize("block, redrawn, work", [(1 << 18, 16, 1 << 28), (64, 16, 20_000), (64, 2, 20_000)])
def test_flips_and_bootstraps_in_blocks(spark, monkeypatch, block, redrawn, work):
    """Series in one block, in blocks that draw all places, and in blocks to which places are sent; t with gaps."""
    for name, value in (("BLOCK", block), ("REDRAWN", redrawn), ("WORK", work)):
        monkeypatch.setattr(resample, name, value)
    r = random.Random(2)
    rows = [(k, t * 3 + 7, r.choice([-1.5, 0.25, 2.0, 1.0])) for k, n in (("a", 400), ("b", 233), ("c", 1)) for t in range(n)]
    frame = spark.createDataFrame(rows, "rule string, t bigint, d double").repartition(3)
    got = {x["rule"]: x for x in resample.paired(frame, "rule", 645, 300).collect()}
    low, high = resample.bounds(300)
    for k in "abc":
        d = np.array([x for key, _, x in rows if key == k])
        n, u = len(d), rng.stream(645, 300 * len(d)).reshape(300, -1)
        flip, boot = np.sort(np.where(u < 0.5, -1, 1) @ d) / n, np.sort(d[(u * n).astype(int)].sum(1)) / n
        mean = d.sum() / n
        want = [mean, flip[low], flip[high], (np.abs(flip) >= abs(mean)).mean(), boot[low], boot[high]]
        assert [got[k][c] for c in ("mean_delta", "null_low", "null_high", "flip_p", "boot_low", "boot_high")] == pytest.approx(want)


def test_series_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK", 10)
    rows = [("a", t, float(t)) for t in range(5, 38)]
    got = sorted(tuple(r) for r in resample.in_series(spark.createDataFrame(rows, "rule string, t bigint, d double"), "rule").select("offset", "n", "total", "d").collect())
    assert [x for r in got for x in r[3]] == [float(t) for t in range(5, 38)] and max(len(r[3]) for r in got) == 10
    assert [r[0] for r in got] == [0, 5, 15, 25] and {(r[1], r[2]) for r in got} == {(33, float(sum(range(5, 38))))}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000])
@pytest.mark.parametrize("seed", [645, 3])
def test_permutation_by_pointers(spark, n, seed):
    got = sorted(tuple(r) for r in permutation.table(spark, n, seed).collect())
    order, s = list(range(n)), plain_stream(seed)
    for i in range(n - 1, 0, -1):
        j = int(next(s) * (i + 1))
        order[i], order[j] = order[j], order[i]
    assert got == list(enumerate(order)) and rng.permutation(n, seed).tolist() == order


@pytest.mark.parametrize("n", [0, 1, 7, 99, 100, 101, 250])
def test_arcs_share_their_pieces(n):
    """Sums over arcs of a ring of 100 places, longer ones going round, against a walk; shares visit each covered place once."""
    r = random.Random(n)
    begins, worth = np.array([r.randrange(100) for _ in range(9)]), np.array([[r.randrange(50), 1] for _ in range(100)], float)
    arcs = rng.Arcs(begins, n, 100)
    each, visited = np.zeros((len(arcs.length), 2)), []
    for part in range(7):
        for piece, a, b in arcs.dealt(part, 7):
            each[piece] += worth[a:b].sum(0)
            visited += range(a, b)
    assert sorted(visited) == sorted({(k + i) % 100 for k in begins for i in range(n)})
    assert arcs.sums(each).tolist() == [worth[[(k + i) % 100 for i in range(n)]].sum(0).tolist() for k in begins.tolist()]


def test_long_bootstraps_draw_one_period_at_most():
    """10,000 repetitions of 9,000,000 places share the cycle; each value stands for the place it has in its own stream."""
    arcs = resample._arcs(9_000_000, 645, 10_000)
    assert 0 < arcs.length.sum() <= rng.PERIOD < 10_000 * 9_000_000
    for k in (0, 9_999):
        start = int(rng.unit_seeds(645, 10_000, 9_000_000, k, k + 1)[0])
        first = int(rng.cycle_places(np.array([start], np.uint32))[0]) + 1
        want = np.minimum((rng.stream(start, 70_000) * 9_000_000).astype(int), 8_999_999)
        assert resample.drawn_places(9_000_000, first, first + 70_000).tolist() == want.tolist()
        assert arcs.first[arcs.begin[k]] == first % rng.PERIOD


def test_series_computes_its_matches_once(spark):
    table = spark.range(200).selectExpr("id AS t", "lpad(id, 8, '0') AS id", "date'2020-01-01' AS date", "array(1, 2, 3, 4, 5, cast(6 + id % 39 AS int)) AS result")
    for plan in (walkforward.series(table, 90, "COLD").select("strategy", "t", "k"), pool18.observations(table, 90, None).select("rule", "t", "k")):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("array_intersect") == (4 if "HOT18" in text else 3)


def test_pools_with_a_leak_are_filled_together(monkeypatch):
    """All rows at once against one at a time, also with repeated numbers and ones out of range; few calls for many rows."""
    r = np.random.default_rng(4)
    results = np.array([np.sort(r.choice(45, 6, replace=False)) + 1 for _ in range(300)])
    results[5], results[9], results[11] = [1, 1, 2, 3, 4, 5], [0, 1, 2, 3, 4, 46], [45, 44, 43, 42, 41, 40]
    seeds = rng.combine_seed(645, np.arange(300))
    want = []
    for s, row in zip(seeds, results):
        rest = np.setdiff1d(rng.ALL, row)
        want.append(sorted([*row.tolist(), *rest[rng.places(np.array([s], np.uint32), 12, len(rest))[:, 0]].tolist()]))
    calls, places = [], rng.places
    monkeypatch.setattr(rng, "places", lambda *a: calls.append(1) or places(*a))
    assert rng.filled_pools(seeds, results).tolist() == want and len(calls) == 3


@pytest.mark.parametrize("n, p", [(1, 0.3), (40, 0.5), (1471, 0.0022791728974372195), (3000, 0.999), (5000, 0.2)])
def test_binomial_tail_against_the_sum_of_all_terms(n, p):
    for x in sorted({0, 1, n // 3, int(n * p), int(n * p) + 1, int(n * p + 40 * (n * p) ** 0.5), n, n + 1}):
        whole = min(1.0, math.fsum(numeric.binomial_pmf(n, k, p) for k in range(max(x, 0), n + 1)))
        assert numeric.binomial_tail(n, x, p) == pytest.approx(1.0 if x <= 0 else whole, rel=1e-9, abs=1e-300)
    assert [numeric.binomial_tail(n, x, q) for q in (0.0, 1.0) for x in (0, 1, n, n + 1)] == [1.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0]


def test_binomial_tail_of_many_draws_takes_few_terms(monkeypatch):
    """9,000,000 draws: one term by special functions, a few thousand by ratios; before, one after the other."""
    calls, pmf = [], numeric.binomial_pmf
    monkeypatch.setattr(numeric, "binomial_pmf", lambda *a: calls.append(a) or pmf(*a))
    assert numeric.binomial_tail(9_000_000, 20_513, pool18.P0) == pytest.approx(0.5, abs=0.01) and len(calls) == 1
    low, high = numeric.clopper_pearson(9_000_000, 20_513)
    assert (low, high) == pytest.approx((20_513 / 9e6 - 1.96 * 143 / 9e6, 20_513 / 9e6 + 1.96 * 143 / 9e6), rel=1e-3)


def test_simulations_of_many_draws_share_their_tickets():
    """2,000 simulations of 54,000,000 draws: at most all tickets of the cycle, and each as in its own stream."""
    rings = resample._rings(54_000_000, 2000, 645)
    assert sum(int(arcs.length.sum()) for _, arcs in rings.values()) <= rng.PERIOD < 2000 * 54_000_000
    assert sorted(k for own, _ in rings.values() for k in own.tolist()) == list(range(2000))
    for r, (own, arcs) in rings.items():
        at = int(arcs.first[arcs.begin[0]])
        start = int(rng.unit_seeds(645, 2000, 54_000_000 * 44, int(own[0]), int(own[0]) + 1)[0])
        assert rng.fair_tickets(int(rng.states(0, 1, r)[0]), 5, at).tolist() == rng.fair_tickets(start, 5).tolist()


def test_simulations_that_overlap(spark, monkeypatch):
    """Streams that start inside each other (seeds as for more than one period), and longer than a ring."""
    def lap(draws, sims, seed):
        begins = np.array([7, 3, 3, 90, 40])
        return {2: (np.arange(5), rng.Arcs(begins, draws, 100))}

    monkeypatch.setattr(resample, "_rings", lap)
    monkeypatch.setattr(resample, "DRAWS", 13)
    for draws in (0, 20, 230):
        got = {r["sim"]: [r[n] for n in resample.NUMBERS] for r in resample.null_counts(spark, draws, 5).collect()}
        each = rng.fair_tickets(int(rng.states(0, 1, 2)[0]), 100)
        for sim, begin in enumerate((7, 3, 3, 90, 40)):
            assert got[sim] == np.bincount(each[(begin + np.arange(draws)) % 100].ravel(), minlength=46)[1:].tolist()


def test_dataset_hash_streams_pieces(spark, monkeypatch):
    """Lines in any order, far apart and below zero, against one loop; pieces and not lines come to the driver; a null line is an error."""
    monkeypatch.setattr(hashing, "LINES", 60)
    r = random.Random(6)
    at = r.sample(range(-10**12, 10**12), 250) + list(range(250))
    rows = [(t, f"{t} é\U0001f600 " * r.randrange(4)) for t in at]
    r.shuffle(rows)
    frame, came = spark.createDataFrame(rows, "t bigint, line string").repartition(3), []
    kind, local = type(frame), type(frame).toLocalIterator
    monkeypatch.setattr(kind, "toLocalIterator", lambda self, **k: (came.append(x) or x for x in local(self, **k)))
    want = hashlib.sha256("".join(line + "\n" for _, line in sorted(rows)).encode()).hexdigest()
    assert hashing.dataset_hash(frame) == want and 0 < len(came) < 50
    assert hashing.dataset_hash(frame.limit(0)) == hashlib.sha256().hexdigest()
    with pytest.raises(Exception, match="a line is null"):
        hashing.dataset_hash(spark.createDataFrame([(1, None)], "t bigint, line string"))
