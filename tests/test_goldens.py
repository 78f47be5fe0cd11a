"""Published constants, fixtures and properties that need no oracle."""

from __future__ import annotations

import inspect
import json
import math
from unittest.mock import MagicMock

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import exact, hashing, numeric, rng, rules, stats
from tidemark.operators import controls, draws, merge, pool18, portfolio, provenance, resample, walkforward
from tidemark.plans import catalog
from tidemark.sources import html, jsonl
from tidemark.streaming import limits


def test_seeded_ticket():
    assert rng.tickets(rng.ticket_seeds(np.array([645]))).tolist() == [[2, 11, 14, 15, 21, 30]]


def test_stream_can_start_anywhere():
    assert np.array_equal(rng.stream(645, 50)[20:], rng.stream(645, 30, 20))
    assert np.array_equal(rng.fair_tickets(1, 10)[4:], rng.fair_tickets(1, 6, 4))


@pytest.mark.parametrize("n, planned, random, p4, r4", [(10, 2.06033, 2.09467, 0.017667, 0.019), (20, 2.37633, 2.38133, None, None), (30, 2.59033, 2.53867, None, None)])
def test_same_budget(n, planned, random, p4, r4):
    got = portfolio.same_budget_simulation(n)
    assert round(got["planned_mean_best"], 5) == planned and round(got["random_mean_best"], 5) == random
    if p4:
        assert round(got["planned_rate_4"], 6) == p4 and round(got["random_rate_4"], 6) == r4


def test_planned_tickets_share_one_number_at_most():
    for n in (1, 10, 30):
        t = portfolio.planned_tickets(n)
        assert len(t) == n and all(len(set(x)) == 6 for x in t)
        assert all(len(set(a) & set(b)) <= 1 for i, a in enumerate(t) for b in t[:i])


def test_pool_constants():
    assert pool18.P0 == pytest.approx(0.0022791728974372195, abs=1e-18)
    assert numeric.binomial_tail(1471, 4, pool18.P0) == pytest.approx(0.43135486845168364, abs=1e-10)
    assert [numeric.mcnemar(*x) for x in ((4, 4), (2, 4), (3, 4))] == pytest.approx([1, 0.6875, 1])
    assert numeric.mcnemar(2, 3) is None
    low, high = numeric.clopper_pearson(1471, 4)
    assert numeric.binomial_tail(1471, 4, low) == pytest.approx(0.025, abs=1e-9) and numeric.binomial_cdf(1471, 4, high) == pytest.approx(0.025, abs=1e-9)
    assert numeric.clopper_pearson(10, 0)[0] == 0 and numeric.clopper_pearson(10, 10)[1] == 1


def test_expected_prize(spark):
    got = exact.outcomes(spark).agg(F.sum(F.col("probability") * F.coalesce("payout", F.lit(0))).alias("ev"), F.sum("combinations").alias("n"), F.sum("probability").alias("p")).first()
    assert got["n"] == 8145060 and got["p"] == pytest.approx(1) and got["ev"] == pytest.approx(1369.8978276403122, abs=1e-9)


def test_spent_alpha():
    assert stats.spent_alpha_py(2) == pytest.approx(0.018994274652086127, abs=1e-17)
    assert sum(stats.spent_alpha_py(1) if k == 1 else 0 for k in (1,)) == 0.05


def test_hac_lag(spark):
    rows = spark.createDataFrame([(368,), (1,), (8,), (64,), (63,), (1_000_000,)], "n bigint").select(stats.hac_lag(F.col("n"), 90).alias("l")).collect()
    assert [r["l"] for r in rows] == [7, 0, 2, 4, 3, 89]


def test_hac_against_loop(spark):
    d = np.random.default_rng(2).normal(size=400)
    frame = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(d)], "s string, i bigint, d double")
    got = walkforward.hac(frame, ["s"], 90, 400).first()
    c, n, lag = d - d.mean(), len(d), 7
    long_run = (c @ c) / n + sum(2 * (1 - k / (lag + 1)) * (c[k:] @ c[:-k]) / n for k in range(1, lag + 1))
    assert got["lag"] == lag and got["hac"] == pytest.approx(math.sqrt(long_run / n)) and got["naive_se"] == pytest.approx(d.std(ddof=1) / math.sqrt(n))


def test_holm_keeps_order(spark):
    items = spark.createDataFrame([("x", "a", 0.01), ("x", "b", 0.04), ("x", "c", 0.03)], "g string, strategy string, p_value double")
    got = {r["strategy"]: r["adjusted_p"] for r in walkforward.holm(items, ["g"], 3, ["strategy"]).collect()}
    assert got == pytest.approx({"a": 0.03, "c": 0.06, "b": 0.06})


def fixture(spark, tmp_path, name, lines):
    p = tmp_path / name
    p.write_text("\r\n".join(lines) + "\n")
    return jsonl.parse_draws(spark, str(p))


def line(i, result, date="2020-01-0{}", **more):
    return json.dumps({"date": date.format(i), "id": f"{197 + i:05d}", "result": result, **more})


def test_fixture_validation(spark, tmp_path):
    good = [1, 2, 3, 4, 5, 6]
    lines = [line(1, good[::-1], process_time="x"), line(2, good, date="2026-02-30"), line(3, good[:5]), line(4, [*good[:5], 46]), line(5, [*good[:5], 5]),
             json.dumps({"date": "2020-01-06", "id": " ", "result": good}), line(7, good, date="06-01-2020"), line(8, [*good[:5], "6"]), "", "{broken", "[1]"]
    valid, rejects = fixture(spark, tmp_path, "d.jsonl", lines)
    assert [(r["id"], list(r["result"]), r["process_time"]) for r in valid.collect()] == [("00198", good, "x")]
    reasons = {r["line"]: r["reason"] for r in rejects.collect()}
    assert len(reasons) == 9
    assert reasons[1] == "date is not on the calendar" and reasons[6] == "date has the wrong form" and reasons[5] == "id is missing or blank"
    assert "wrong length" in reasons[2] and "range" in reasons[3] and "repeats" in reasons[4] and "integer" in reasons[7]


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ordinal bigint, id string, date string, result array<int>").withColumn("date", F.col("date").cast("date"))


def test_merge_fixtures(spark):
    a, b, c = ("00198", "2020-01-01", [1, 2, 3, 4, 5, 6]), ("00199", "2020-01-02", [1, 2, 3, 4, 5, 7]), ("00200", "2020-01-03", [1, 2, 3, 4, 5, 8])
    valid = frame(spark, [a, b, c])
    twice = frame(spark, [a, a, b])
    count = lambda x, y: tuple(merge.counters(merge.classified(x, y)).first())
    assert count(valid, twice) == (0, 2, 1, 0)
    assert count(valid.limit(0), twice) == (2, 0, 1, 0)
    other = ("00198", "2020-01-01", [9, 10, 11, 12, 13, 14])
    assert count(valid, frame(spark, [other, b])) == (0, 1, 0, 1)
    kept = {r["id"]: list(r["result"]) for r in merge.merged(valid, frame(spark, [other, b])).collect()}
    assert kept["00198"] == a[2] and len(kept) == 3


def test_snapshot_round_trip(spark, tmp_path):
    table = frame(spark, [("00001", "2020-01-01", [1, 2, 3, 4, 5, 6]), ("00002", "2020-01-03", [2, 3, 4, 5, 6, 7])])
    lines = jsonl.serialised(table).join(table.select("id", F.col("ordinal").alias("t")), "id")
    digest = hashing.dataset_hash(lines)
    jsonl.save_snapshot(table, jsonl.manifest(table, merge.continuity(table), digest), str(tmp_path / "s"))
    back, described = jsonl.load_snapshot(spark, str(tmp_path / "s"))
    assert described["recordCount"] == 2 and described["continuous"] and back.count() == 2
    assert jsonl.load_snapshot(spark, str(tmp_path / "none")) == (None, None)


def cyclic(spark, n=120, shift=0):
    rows = [(i, f"{i + 1:05d}", sorted((i + o) % 45 + 1 for o in (0, 7, 14, 21, 28, 35)), i) for i in range(n)]
    return spark.createDataFrame(rows, "t bigint, id string, result array<int>, d int").withColumn("date", F.date_add(F.lit("2025-01-01").cast("date"), F.col("d"))).drop("d")


def brute_picks(results, t, lookback):
    window = results[t - lookback : t]
    rows = []
    for num in range(1, 46):
        seen = [i for i, r in enumerate(window) if num in r]
        rows.append((num, len(seen), lookback - 1 - seen[-1] if seen else lookback))
    hot = sorted(sorted(rows, key=lambda r: (-r[1], r[0]))[:6])
    cold = sorted(sorted(rows, key=lambda r: (r[1], -r[2], r[0]))[:6])
    even = sorted(x for b in range(3) for x in sorted((r for r in rows if (r[0] - 1) // 15 == b), key=lambda r: (abs(45 * r[1] - 6 * lookback), r[0]))[:2])
    return tuple([r[0] for r in p] for p in (hot, cold, even))


def test_picks_against_loop_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(walkforward, "BLOCK", 40)
    table = controls.fair_draws(spark, [7], 150).drop("rep")
    results = [list(r["result"]) for r in table.orderBy("t").collect()]
    got = {r["t"]: (list(r["HOT"]), list(r["COLD"]), list(r["BALANCED"])) for r in walkforward.picks(table, 30).collect()}
    assert set(got) == set(range(30, 150))
    assert all(got[t] == brute_picks(results, t, 30) for t in got)


def test_future_does_not_reach_back(spark):
    table = cyclic(spark)
    changed = table.withColumn("result", F.when(F.col("t") >= 100, F.array(*map(F.lit, range(1, 7)))).otherwise(F.col("result")))
    key = lambda df: {r["t"]: r["HOT"] for r in walkforward.picks(df, 30).where("t <= 100").collect()}
    assert key(table) == key(changed)


def test_leak_is_seen(spark):
    table = controls.fair_draws(spark, [3], 130).drop("rep")
    assert controls.future_leak(table, 30).first()["leak_detected"]
    assert tuple(pool18.leak_check(table, 30).first()) == (100, 100)


def test_resampling_is_one_stream():
    d = np.random.default_rng(1).integers(-2, 3, 57).astype(float)
    whole = resample.sign_flip_sums(d, 5, 0, 40)
    assert np.array_equal(whole, np.concatenate([resample.sign_flip_sums(d, 5, a, a + 10) for a in range(0, 40, 10)]))
    u = rng.stream(5, 57 * 40).reshape(40, 57)
    assert np.allclose(whole, [sum(x if v >= 0.5 else -x for x, v in zip(d, row)) for row in u])


def test_chain_reports_one_line_for_one_change(spark):
    events = provenance.append_events([{"kind": "FROZEN", "n": i} for i in range(6)], None)
    events[3]["n"] = 99
    rows = [(i, "FROZEN", hashing.canonical_json({"kind": e["kind"], "n": e["n"]}), e["previousEntryHash"], e["entryHash"]) for i, e in enumerate(events)]
    got = provenance.verify_chain(spark.createDataFrame(rows, "line bigint, format string, content string, previousEntryHash string, entryHash string")).collect()
    assert [r["line"] for r in got if not (r["link_ok"] and r["hash_ok"])] == [3]
    gone = spark.createDataFrame([r for r in rows if r[0] != 1], "line bigint, format string, content string, previousEntryHash string, entryHash string")
    assert [r["line"] for r in provenance.verify_chain(gone).where("not link_ok").collect()] == [2]


def test_entry_id_is_canonical(spark):
    got = spark.range(1).select(hashing.entry_id(F.lit("01562"), F.lit("HOT"), F.lit('2026-01-01T00:00:00.000Z')).alias("h")).first()["h"]
    assert got == hashing.canonical_hash({"strategyId": "HOT", "frozenAt": "2026-01-01T00:00:00.000Z", "drawId": "01562"})
    assert hashing.canonical_json({"b": 1.0, "a": [0.5, None]}) == '{"a":[0.5,null],"b":1}'


def test_limiter_does_not_record_denials(spark):
    rows = [(1, s) for s in (0, 1, 2, 3, 4, 5, 9, 10, 11)]
    e = spark.createDataFrame(rows, "user_id bigint, s int").select("user_id", F.timestamp_seconds("s").alias("ts"))
    got = [r["allowed"] for r in limits.limited(e, 10_000, 5).orderBy("ts").collect()]
    assert got == [True] * 5 + [False, False, True, True]


def test_stream_sync_keeps_the_old_snapshot_on_conflict(spark, tmp_path):
    state = {"t": frame(spark, [("00001", "2020-01-01", [1, 2, 3, 4, 5, 6])])}
    sync = limits.sync_batch(lambda: state["t"], lambda df: state.update(t=df.select(F.lit(0).alias("ordinal"), "id", "date", "result")))
    sync(frame(spark, [("00002", "2020-01-03", [1, 2, 3, 4, 5, 7])]), 0)
    assert state["t"].count() == 2
    with pytest.raises(ValueError, match="conflict"):
        sync(frame(spark, [("00002", "2020-01-03", [1, 2, 3, 4, 5, 9])]), 1)
    with pytest.raises(ValueError, match="missing"):
        sync(frame(spark, [("00009", "2020-01-09", [1, 2, 3, 4, 5, 9])]), 2)
    assert state["t"].count() == 2


BALLS = '<span class="bong_tron">03</span><span class="bong_tron small">45</span>'


def test_html_rows(spark):
    row_of = lambda i: f'<tr> <td>05/02/2024</td> <td><a href="/x?id={i}&nocatche=1">{i}</a></td> <td>{BALLS}</td> </tr>'
    page = f'<div class="doso_output_nd"><table><tbody>{row_of("00123")}<tr><td>06/02/2024</td></tr>{row_of("00122")}</tbody></table></div>'
    make = lambda text: spark.createDataFrame([(1, text)], "page_id int, html string")
    rows = sorted(html.history_rows(make(page)).collect())
    assert [(r["id"], r["date"], list(r["result"])) for r in rows] == [("00122", "2024-02-05", [3, 45]), ("00123", "2024-02-05", [3, 45])]
    with pytest.raises(Exception, match="no result table"):
        html.history_rows(make("<p>")).collect()
    empty = '<div class="doso_output_nd"><tbody></tbody></div>'
    with pytest.raises(Exception, match="table is empty"):
        html.history_rows(make(empty)).collect()
    assert html.history_rows(make(empty), trust_empty=True).count() == 0


def test_html_detail(spark):
    page = f'<b>#999</b> color: #123456 Kỳ quay thưởng <b>#00123</b> ngày <b>05/02/2024</b> <div class="day_so_ket_qua_v2">{BALLS}</div>'
    make = lambda text: spark.createDataFrame([(1, text)], "page_id int, html string")
    row = html.official_draw(make(page), "00123").first()
    assert (row["id"], row["date"], list(row["result"])) == ("00123", "2024-02-05", [3, 45])
    assert html.official_draw(make(page), "00124").count() == 0
    for broken, why in ((page.replace("#00123", "#123"), "no heading"), (page.replace("_v2", "_v1"), "no numbers")):
        with pytest.raises(Exception, match=why):
            html.detail(make(broken)).collect()
    key = make("Game645CompareWebPart.ServerSideDrawResult(RenderInfo, 'abc-1', x)").select(html.history_key(F.col("html")).alias("k")).first()["k"]
    assert key == "abc-1"
    with pytest.raises(Exception, match="no paging key"):
        make("x").select(html.history_key(F.col("html"))).collect()


def test_small_rules(spark):
    row = spark.range(1).select(rules.next_id(F.lit("00999")).alias("a"), rules.next_id(F.lit("99")).alias("b"), rules.next_id(F.lit("x")).alias("c"), rules.seed_of(F.lit("00000"), F.lit(7)).alias("d"), rules.format_tickets(F.array(F.array(F.lit(2), F.lit(11)))).alias("e")).first()
    assert tuple(row) == ("01000", "100", None, 7, "01: 02 11")


def test_an_invalid_ticket_or_result_is_an_error(spark):
    good, bad = F.array(*map(F.lit, range(1, 7))), F.array(*map(F.lit, (1, 1, 2, 3, 4, 5)))
    row = spark.range(1).select(rules.evaluated(good, good).alias("e")).first()["e"]
    assert (row["matches"], row["tier"], row["payout"], list(row["matched"])) == (6, "JACKPOT", None, [1, 2, 3, 4, 5, 6])
    for pair in ((bad, good), (good, bad)):
        with pytest.raises(Exception, match="no valid ticket"):
            spark.range(1).select(rules.evaluated(*pair)).collect()


def test_wide_gaps_come_in_pieces(spark):
    table = spark.createDataFrame([("00001",), ("200001",), ("200003",)], "id string")
    assert merge.missing_ids(table).count() == 199_999 + 1


def test_portfolios_over_thirty_are_not_compared(spark):
    rows = spark.range(5000).select(F.col("id").alias("ticket_id"), F.array(*map(F.lit, range(1, 7))).alias("ticket"))
    assert tuple(portfolio.is_valid(rows).first()) == (5000, None, False)


def test_sample_ids_are_fixed(spark):
    table = cyclic(spark)
    a = merge.sample_ids(table, 5, 645)
    assert a == merge.sample_ids(table, 5, 645) and len(a) == 8 and {"00001", "00061", "00120"} <= set(a)


def plain_stream(seed):
    """The stream with whole numbers, one value after another."""
    m, state = 0xFFFFFFFF, seed & 0xFFFFFFFF
    while True:
        state = (state + 0x6D2B79F5) & m
        x = ((state ^ state >> 15) * (state | 1)) & m
        x = ((x + (((x ^ x >> 7) * (x | 61)) & m)) & m) ^ x
        yield (x ^ x >> 14) / 4294967296


def plain_ticket(stream):
    pool = list(range(1, 46))
    for i in range(44, 0, -1):
        j = int(next(stream) * (i + 1))
        pool[i], pool[j] = pool[j], pool[i]
    return sorted(pool[:6])


def test_random_control_against_loop(spark):
    rows = [(s, sorted(plain_ticket(plain_stream(1000 + s)))) for s in (0, 1, 5, 12345)]
    frame = spark.createDataFrame(rows, "seed bigint, result array<int>")
    got = frame.select("seed", rng.random_control()(F.col("seed"), F.col("result")).alias("c")).collect()
    prize = {3: 30_000, 4: 300_000, 5: 10_000_000}
    for r, (seed, result) in zip(sorted(got, key=lambda r: r["seed"]), rows):
        ks = [len(set(plain_ticket(plain_stream(seed * 131 + i or 0x6D2B79F5))) & set(result)) for i in range(32)]
        assert r["c"]["k"] == sum(ks) / 32 and r["c"]["hit3"] == sum(k >= 3 for k in ks) / 32 and r["c"]["payout"] == sum(prize.get(k, 0) for k in ks) / 32


def test_fair_tickets_share_one_stream():
    s = plain_stream(645)
    assert rng.fair_tickets(645, 5).tolist() == [plain_ticket(s) for _ in range(5)]


@pytest.mark.parametrize("name, module, function, full", [
    ("fairness_mc", resample, "fairness", {"simulations": 2000}), ("sign_flip_bootstrap", resample, "paired", {"iterations": 10_000}),
    ("pool18_audit", pool18, "audit", {"iterations": 10_000}), ("negative_controls", controls, "all_controls", {"replications": 25}),
])
def test_queries_run_the_whole_job(monkeypatch, name, module, function, full):
    """Registered with as many repetitions as the reference has by default."""
    monkeypatch.setattr(catalog, "all_draws", lambda spark, d: None)
    monkeypatch.setattr(catalog.walkforward, "series", lambda *a: MagicMock())
    monkeypatch.setattr(catalog, "F", MagicMock())
    shape, seen = inspect.signature(getattr(module, function)), {}

    def called(*args, **named):
        bound = shape.bind(*args, **named)
        bound.apply_defaults()
        seen.update(bound.arguments)

    monkeypatch.setattr(module, function, called)
    catalog.QUERIES[name](None, None)
    assert {k: seen[k] for k in full} == full
