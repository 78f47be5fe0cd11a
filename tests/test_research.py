"""Guards, sources, events, registries and resampling against plain loops."""

from __future__ import annotations

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_goldens import frame, plain_stream, plain_ticket
from tidemark.functions import numeric, rng
from tidemark.operators import checks, controls, pool18, prospective, provenance, registry, replay, resample, walkforward
from tidemark.sources import jsonl, paged
from tidemark.sources.shapes import json_value, whole_or_nothing
from tidemark.streaming import limits


def plain_counts(results):
    return [sum(n in r for r in results) for n in range(1, 46)]


def plain_chi(results):
    e = len(results) * 6 / 45
    return sum((c - e) ** 2 / e for c in plain_counts(results))


def test_future_rows_are_errors(spark):
    rows = frame(spark, [("00001", "2020-01-01", [1, 2, 3, 4, 5, 6]), ("00002", "2020-01-03", [1, 2, 3, 4, 5, 7])])
    assert [r["id"] for r in checks.before(rows, "2020-01-03").collect()] == ["00001"]
    assert checks.without_later_rows(rows, "2020-01-04").count() == 2
    with pytest.raises(Exception, match="00002 of 2020-01-03 is not before"):
        checks.without_later_rows(rows, "2020-01-03").collect()
    with pytest.raises(Exception, match="18 distinct"):
        rows.select(checks.valid_pool(F.col("result"))).collect()


def test_sync_keeps_the_old_table(spark):
    old = frame(spark, [("00001", "2020-01-01", [1, 2, 3, 4, 5, 6])])
    assert checks.sync(old, None)[1]["status"] == "not-modified"
    new, summary = checks.sync(old, frame(spark, [("00002", "2020-01-03", [1, 2, 3, 4, 5, 7])]))
    assert summary["status"] == "ok" and summary["added"] == 1 and new.count() == 2
    for rows, why in (([("00001", "2020-01-01", [9, 10, 11, 12, 13, 14])], "conflicting"), ([("00004", "2020-01-09", [1, 2, 3, 4, 5, 7])], "missing")):
        kept, summary = checks.sync(old, frame(spark, rows))
        assert kept is old and summary["status"] == "error" and why in summary["error"]
    assert checks.sync(old, frame(spark, [("00004", "2020-01-09", [1, 2, 3, 4, 5, 7])]), allow_gaps=True)[1]["status"] == "ok"
    bad = frame(spark, [("00002", "2020-01-03", [1])]).withColumn("reason", F.lit("short"))
    assert checks.sync(old, bad)[1]["rejected"] == 1


def test_check_of_a_sound_snapshot(spark, tmp_path):
    rows = frame(spark, [("00001", "2020-01-01", [1, 2, 3, 4, 5, 6]), ("00002", "2020-01-03", [2, 3, 4, 5, 6, 7])]).withColumn("t", F.col("ordinal"))
    digest = checks.digest_of(rows)
    lines = jsonl.serialised(rows.drop("ordinal")).join(rows.select("id", "t"), "id").select("t", "line")
    found = checks.data_check(rows, {"sha256": digest, "recordCount": 2, "schemaVersion": 2}, digest, lines)
    assert tuple(checks.passed(found).first()) == (True, 0) and found.count() == 6
    assert tuple(checks.passed(checks.data_check(rows, None, digest)).first()) == (False, 1)
    assert not checks.passed(checks.data_check(rows.limit(0), None, digest)).first()["ok"]
    lock = {k: "x" for k in ("protocolVersion", "protocolHash", "protocolLockedAt", "protocolDatasetHash")} | {"prospectiveStartDrawId": None}
    ready = checks.readiness(spark, rows.withColumn("reason", F.lit(None).cast("string")), {"sha256": digest, "recordCount": 2, "schemaVersion": 2}, digest, lock, {})
    assert checks.passed(ready).first()["ok"]
    assert [r["ok"] for r in checks.readiness(spark, None, None, None, None, None).collect()] == [False] * 4


PAGES = [[{"id": f"{n:05d}", "date": "2020-01-01", "result": [1, 2, 3, 4, 5, 6]} for n in range(20 - 8 * p, max(0, 12 - 8 * p), -1)] for p in range(3)]


@pytest.fixture
def folder(tmp_path):
    for i, rows in enumerate(PAGES):
        (tmp_path / f"{i}.json").write_text(json.dumps(rows))
    return str(tmp_path)


def test_pages_are_read_until_the_anchor(spark, folder):
    spark.dataSource.register(paged.PagedDraws)
    pages = spark.read.format("paged_draws").option("folder", folder).load()
    assert pages.count() == 20
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(paged.crawl(pages, "00001")) == [f"{n:05d}" for n in range(1, 21)]
    assert ids(paged.crawl(pages, "00010", at_or_below=True)) == [f"{n:05d}" for n in range(11, 21)]
    assert ids(paged.crawl(pages, "00015")) == [f"{n:05d}" for n in range(13, 21)]
    with pytest.raises(Exception, match="anchor 00099"):
        paged.crawl(pages, "00099").collect()
    # a short page ends the crawl before the anchor is seen
    with pytest.raises(Exception, match="anchor 00001"):
        paged.crawl(pages.where("id <> '00020'"), "00001").collect()
    # a page that is missing is not jumped over
    with pytest.raises(Exception, match="anchor 00001"):
        paged.crawl(pages.where("page <> 1"), "00001").collect()


def test_nothing_new_is_not_an_empty_page(tmp_path):
    source = paged.JsonPages({"folder": str(tmp_path)})
    (tmp_path / "0.json").write_text("[]")
    assert source.fetch(0) == [] and source.fetch(1) is None and source.count() == 1


def test_stream_of_pages_goes_on_from_the_last_id(spark, folder, tmp_path_factory):
    spark.dataSource.register(paged.PagedDraws)
    out = str(tmp_path_factory.mktemp("out"))
    checkpoint = str(tmp_path_factory.mktemp("checkpoint"))

    def run():
        q = spark.readStream.format("paged_draws").option("folder", folder).option("after", "00004").load().writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r["id"] for r in spark.read.schema(paged.ROWS).json(out).collect())

    assert run() == [f"{n:05d}" for n in range(5, 21)]
    with open(f"{folder}/0.json", "w") as f:
        f.write(json.dumps([{**PAGES[0][0], "id": "00021"}, *PAGES[0]]))
    assert run() == [f"{n:05d}" for n in range(5, 22)]


ENTRY = {"drawId": "01562", "strategyId": "HOT", "frozenAt": "2026-01-01T00:00:00.000Z", "protocolHash": "p", "datasetHashAtFreeze": "d", "prediction": [6, 5, 4, 3, 2, 1]}


def test_events_are_linked_and_fold(spark, tmp_path):
    first = prospective.frozen_event(ENTRY, None)
    other = prospective.frozen_event({**ENTRY, "strategyId": "COLD"}, first["entryHash"])
    score = prospective.scored_event(first, [1, 2, 3, 40, 41, 42], "2026-01-03T00:00:00Z", other["entryHash"])
    assert first["prediction"] == [1, 2, 3, 4, 5, 6] and (score["matches"], score["tier"]) == (3, "THIRD")
    with pytest.raises(ValueError, match="no valid ticket"):
        prospective.scored_event(first, [1, 2, 3, 3, 41, 42], "x", None)
    registry.append(spark.createDataFrame([(json.dumps(e),) for e in (first, other)], "value string"), str(tmp_path / "ledger"))
    lines = spark.createDataFrame([(i, json.dumps(e)) for i, e in enumerate((first, other, score))], "line bigint, value string")
    assert [r["problem"] for r in prospective.ledger_problems(lines).collect()] == [None] * 3
    events = provenance.parse_ledger(lines)
    state = {r["entry_id"]: (r["status"], r["matches"]) for r in provenance.fold(events).collect()}
    assert state == {first["entryId"]: ("SCORED", 3), other["entryId"]: ("PENDING", None)}
    contents = [{k: v for k, v in e.items() if k not in ("previousEntryHash", "entryHash")} for e in (first, other, score)]
    from tidemark.functions import hashing

    rows = [(i, "FROZEN", hashing.canonical_json(c), e["previousEntryHash"], e["entryHash"]) for i, (c, e) in enumerate(zip(contents, (first, other, score)))]
    verified = provenance.verify_chain(spark.createDataFrame(rows, "line bigint, format string, content string, previousEntryHash string, entryHash string"))
    assert provenance.chain_health(verified).first()["verified"]


def test_ledger_as_a_stream(spark, tmp_path):
    """Lines arrive in files; each batch is appended and the state is folded from all of them."""
    first = prospective.frozen_event(ENTRY, None)
    score = prospective.scored_event(first, [1, 2, 3, 40, 41, 42], "2026-01-03T00:00:00Z", first["entryHash"])
    source, ledger = tmp_path / "in", str(tmp_path / "ledger")
    source.mkdir()
    for i, (event, status) in enumerate(((first, "PENDING"), (score, "SCORED"))):
        (source / f"{i}.json").write_text(json.dumps({"line": i, "value": json.dumps(event)}) + "\n")
        stream = spark.readStream.schema("line bigint, value string").json(str(source))
        limits.append_ledger(stream, ledger, str(tmp_path / "checkpoint")).awaitTermination()
        assert [r["status"] for r in limits.ledger_state(spark, ledger).collect()] == [status]


def test_broken_files_are_not_half_believed(spark):
    good = {"protocolHash": "p", "protocolVersion": "v", "recordedAt": "2026-01-01T00:00:00Z", "source": "lock"}
    read = lambda values, problem, kind: registry.parsed(spark.createDataFrame([(json.dumps(v),) for v in values], "value string"), problem, kind).collect()
    assert [r["protocolHash"] for r in read([good, {**good, "note": "n"}], registry.history_problem, registry.HISTORY)] == ["p", "p"]
    for broken in ({**good, "source": "guess"}, {**good, "recordedAt": "soon"}, {**good, "note": 3}, [], 7):
        assert read([good, broken], registry.history_problem, registry.HISTORY) == []
    exception = {"kind": "UNKNOWN_PROTOCOL_HASH", "experimentId": "e", "detail": "d", "justification": "j", "discoveredAt": "2026-01-01", "rootCauseFixed": True}
    assert len(read([exception], registry.exception_problem, registry.EXCEPTIONS)) == 1 and not read([{**exception, "rootCauseFixed": "yes"}], registry.exception_problem, registry.EXCEPTIONS)
    family = {"familyId": "f", "familySize": 3, "hypothesisCount": 3.5, "lookCount": 1, "fallbackFamilySize": 3}
    assert len(read([family], registry.family_problem, registry.FAMILY)) == 1
    assert not read([{**family, "hypothesisCount": 4}], registry.family_problem, registry.FAMILY) and not read([{**family, "lookCount": 0}], registry.family_problem, registry.FAMILY)
    artifact = {"experimentId": "e", "gitCommit": None, "datasetSha256": "d", "protocolVersion": "v", "protocolHash": "p", "strategy": {"id": "HOT"}, "seed": 1, "temporalSplit": {}, "metrics": {}, "statistics": {}, "controls": {}, "runtime": {}}
    check = lambda v: spark.createDataFrame([(json.dumps(v),)], "value string").select(registry.artifact_problem(json_value("value")).alias("p")).first()["p"]
    assert check(artifact) is None and check({**artifact, "strategy": {}}) == "strategy.id is missing or blank" and check({**artifact, "runtime": []}) == "runtime is no object" and check({**artifact, "gitCommit": 1}) == "gitCommit is no text"
    assert whole_or_nothing(spark.createDataFrame([], "problem string")).count() == 0


def test_published_documents_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("HOT", 0.1), ("COLD", None)], "strategy string, p double")
    with pytest.raises(ValueError, match="lacks a field"):
        registry.publish(spark, rows, "bad", str(tmp_path / "a.json"))
    assert not (tmp_path / "a.json").exists()
    value = registry.publish(spark, rows.fillna(1.0), "good", str(tmp_path / "b.json"))
    assert jsonl.load_json(spark, str(tmp_path / "b.json")) == value and len(value["rows"]) == 2
    with pytest.raises(FileExistsError):
        registry.publish(spark, rows.fillna(1.0), "good", str(tmp_path / "b.json"), overwrite=False)


def test_register_and_transition(spark):
    rows = registry.registered(spark.createDataFrame([("a",), ("b",)], "experiment_id string"), "now")
    done = {r["experiment_id"]: r["status"] for r in provenance.transition(rows, "a", "COMPLETED").collect()}
    assert done == {"a": "COMPLETED", "b": "REGISTERED"}


def test_null_distribution_of_any_statistic(spark):
    """One stream over all simulations, for a statistic of one's own and for the fairness test."""
    s = plain_stream(645)
    simulated = [[plain_ticket(s) for _ in range(20)] for _ in range(60)]
    got = resample.null_distribution(spark, 20, lambda r: float(r[:, 0].max()), 60)
    assert {r["sim"]: r["value"] for r in got.collect()} == {i: float(max(r[0] for r in x)) for i, x in enumerate(simulated)}
    rows = [(i, f"{i:05d}", plain_ticket(plain_stream(9 + i))) for i in range(20)]
    table = spark.createDataFrame(rows, "t bigint, id string, result array<int>")
    found = resample.fairness(table, 60).first()
    seen = plain_chi([r[2] for r in rows])
    assert found["observed"] == pytest.approx(seen) and found["p_value"] == pytest.approx((sum(plain_chi(x) >= seen - 1e-12 for x in simulated) + 1) / 61)


def test_fair_draws_as_a_table_function(spark):
    spark.udtf.register("fair_draws", resample.FairDraws)
    s = plain_stream(7)
    got = [list(r["result"]) for r in spark.sql("select * from fair_draws(5, 7)").orderBy("t").collect()]
    assert got == [plain_ticket(s) for _ in range(5)]


def plain_paired(d, seed, iterations):
    flips, boots = plain_stream(seed), plain_stream(seed)
    n = len(d)
    flip = sorted(sum(x if next(flips) >= 0.5 else -x for x in d) / n for _ in range(iterations))
    boot = sorted(sum(d[int(next(boots) * n)] for _ in range(n)) / n for _ in range(iterations))
    low, high = int(0.025 * iterations), -(-975 * iterations // 1000) - 1
    mean = sum(d) / n
    return mean, flip[low], flip[high], sum(abs(x) >= abs(mean) for x in flip) / iterations, boot[low], boot[high]


def test_paired_tests_against_loop(spark):
    d = {k: np.random.default_rng(i).integers(-2, 4, 37).astype(float).tolist() for i, k in enumerate("ab")}
    rows = [(k, t, x) for k, v in d.items() for t, x in enumerate(v)]
    got = {r["rule"]: r for r in resample.paired(spark.createDataFrame(rows, "rule string, t bigint, d double").repartition(3), "rule", 645, 1200).collect()}
    for k, v in d.items():
        want = plain_paired(v, 645, 1200)
        assert [got[k][c] for c in ("mean_delta", "null_low", "null_high", "flip_p", "boot_low", "boot_high")] == pytest.approx(want)


def test_pool_audit_against_loop(spark):
    """Every column of the audit from loops over the observations."""
    table = controls.fair_draws(spark, [1], 150).drop("rep")
    seen = {}
    for r in pool18.observations(table, 30, 645).orderBy("t").collect():
        seen.setdefault(r["rule"], []).append(r["k"])
    got = {r["rule"]: r for r in pool18.audit(table, 30, 645, iterations=300).collect()}
    assert set(got) == {"HOT18", "COLD18", "OVERDUE18", "BALANCED18"} and all(len(v) == 120 for v in seen.values())
    base, raw = seen["RANDOM18"], {}
    for rule, row in got.items():
        ks = seen[rule]
        hits = sum(k == 6 for k in ks)
        raw[rule] = numeric.binomial_tail(120, hits, pool18.P0)
        assert (row["n"], row["hit6"], row["median_k"]) == (120, hits, float(np.median(ks))) and row["p_value"] == pytest.approx(raw[rule])
        assert [row[f"k{i}"] for i in range(7)] == [ks.count(i) for i in range(7)]
        assert (row["ci"]["low"], row["ci"]["high"]) == pytest.approx(numeric.clopper_pearson(120, hits))
        assert (row["rule_only"], row["control_only"]) == (sum(a == 6 and b < 6 for a, b in zip(ks, base)), sum(a < 6 and b == 6 for a, b in zip(ks, base)))
        want = plain_paired([float(a - b) for a, b in zip(ks, base)], 645, 300)
        assert [row[c] for c in ("mean_delta", "null_low", "null_high", "flip_p", "boot_low", "boot_high")] == pytest.approx(want)
        early, late = np.mean(ks[:60]), np.mean(ks[60:])
        assert (row["early_k"], row["late_k"]) == pytest.approx((early, late))
    step = 0
    for i, rule in enumerate(sorted(raw, key=lambda r: (raw[r], r))):
        step = max(step, min(1, raw[rule] * (4 - i)))
        row = got[rule]
        assert row["adjusted_p"] == pytest.approx(step)
        lift = row["hit6"] / 120 > pool18.P0 or row["mean_k"] > 2.4
        signal = lift and step <= 0.05 and not (row["early_k"] - 2.4) * (row["late_k"] - 2.4) < 0
        assert row["verdict"] == ("SIGNAL" if signal else "NO_EDGE") and (len(row["reasons"]) == 0) == signal


def brute_series(results, ids, lookback):
    from tests.test_goldens import brute_picks

    out = {"HOT": [], "COLD": [], "BALANCED": [], "RANDOM": []}
    for t in range(lookback, len(results)):
        for name, pick in zip(out, brute_picks(results, t, lookback)):
            out[name].append(len(set(pick) & set(results[t])))
        seeds = [int(ids[t]) * 131 + i for i in range(32)]
        out["RANDOM"].append(sum(len(set(plain_ticket(plain_stream(s))) & set(results[t])) for s in seeds) / 32)
    return out


def test_negative_controls_against_loop(spark):
    table = controls.fair_draws(spark, [4], 80).drop("rep")
    rows = table.orderBy("t").collect()
    results, ids = [list(r["result"]) for r in rows], [r["id"] for r in rows]
    own = brute_series(results, ids, 30)
    mean = lambda x: sum(x) / len(x)
    order = list(range(80))
    s = plain_stream(645)
    for i in range(79, 0, -1):
        j = int(next(s) * (i + 1))
        order[i], order[j] = order[j], order[i]
    mixed = brute_series([results[i] for i in order], [ids[i] for i in order], 30)
    for r in controls.time_shuffle(table, 30).collect():
        a, b = (mean(x[r["strategy"]]) - mean(x["RANDOM"]) for x in (own, mixed))
        assert (r["original_edge"], r["shuffled_edge"]) == pytest.approx((a, b)) and r["collapsed"] == (abs(b) <= abs(a) + 1e-12)
    assert controls.random_baseline(table, 30).first()["observed_mean"] == pytest.approx(mean(own["RANDOM"]))
    s, order = plain_stream(645), list(range(50))
    for i in range(49, 0, -1):
        j = int(next(s) * (i + 1))
        order[i], order[j] = order[j], order[i]
    from tests.test_goldens import brute_picks

    for r in controls.label_permutation(table, 30).collect():
        at = ("HOT", "COLD", "BALANCED").index(r["strategy"])
        got = mean([len(set(brute_picks(results, 30 + k, 30)[at]) & set(results[30 + order[k]])) for k in range(50)]) - 0.8
        assert r["permuted_edge"] == pytest.approx(got) and r["true_edge"] == pytest.approx(mean(own[r["strategy"]]) - 0.8)
    rates = {r["strategy"]: r["pass_rate"] for r in controls.iid_pass_rates(spark, 60, 30, 3).collect()}
    assert set(rates) == {"HOT", "COLD", "BALANCED"} and all(0 <= x <= 1 for x in rates.values())
    out = controls.all_controls(table, 30, replications=2)
    assert sorted(r["control"] for r in out.collect()) == list("ABCEF")
    assert controls.all_controls(table, 80, replications=2).where("insufficient").count() == 5


def test_replay_does_not_look_at_the_target(spark):
    table = controls.fair_draws(spark, [5], 130).drop("rep")
    target = table.where("t = 120").first()
    date = str(target["date"])
    mine = lambda df: {r["strategy"]: list(r["ticket"]) for r in replay.frozen_tickets(df, date, 30).collect()}
    changed = table.withColumn("result", F.when(F.col("t") >= 120, F.array(*map(F.lit, range(1, 7)))).otherwise(F.col("result")))
    assert mine(table) == mine(changed) and mine(table)["RANDOM"] == [2, 11, 14, 15, 21, 30]


def test_picks_over_batches_of_any_size(spark, monkeypatch):
    """Histories are carried from one Arrow batch to the next."""
    table = controls.fair_draws(spark, [3, 8], 120)
    whole = {(r["rep"], r["t"]): (r["HOT"], r["COLD"], r["BALANCED"]) for r in walkforward.picks(table, 30, keys=("rep",)).collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(walkforward, "BLOCK", 50)
    try:
        for size in (1, 7, 64):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            again = {(r["rep"], r["t"]): (r["HOT"], r["COLD"], r["BALANCED"]) for r in walkforward.picks(table, 30, keys=("rep",)).collect()}
            assert again == whole and len(whole) == 180
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_sample_ids_against_loop(spark):
    from tests.test_goldens import cyclic
    from tidemark.operators import merge

    ids = [f"{i + 1:05d}" for i in range(120)]
    fixed = {ids[0], ids[-1], ids[60]}
    rest, u, want = [i for i in ids if i not in fixed], rng.stream(645, 5), []
    for x in u:
        want.append(rest.pop(int(x * len(rest))))
    assert merge.sample_ids(cyclic(spark), 5, 645) == sorted(fixed | set(want))


def test_a_row_without_six_numbers_is_named(spark):
    for bad in (None, [1, 2, 3]):
        rows = [(t, [1, 2, 3, 4, 5, 6] if t != 17 else bad) for t in range(60)]
        with pytest.raises(Exception, match="row t = 17 has no 6 numbers"):
            walkforward.picks(spark.createDataFrame(rows, "t bigint, result array<int>"), 30).collect()
