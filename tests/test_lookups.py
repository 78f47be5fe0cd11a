"""Details looked up in batches, portfolios by their pairs, line numbers by splits."""

from __future__ import annotations

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import hashing, rng
from tidemark.operators import checks, merge, portfolio, provenance
from tidemark.sources import jsonl, paged

DAY = datetime.date(2024, 1, 1)


class Details:
    """Rows by id; some raise, some are not valid, some are other rows, and one batch fails as a whole."""

    def __init__(self, options):
        self.shift = int(options.get("shift", 0))

    def fetch_details(self, ids):
        if "00666" in ids:
            raise ConnectionError("source is down")
        for i in ids:
            n = int(i)
            row = {"id": i, "date": "2024-01-01", "result": [1, 2, 3, 4, 5, 6 + self.shift + n % 2]}
            if n % 10 == 3:
                yield i, TimeoutError("too slow")
            elif n % 10 == 4:
                yield i, {**row, "result": [1, 2, 3, 4, 5]}
            elif n % 10 == 5:
                yield i, {**row, "id": "09999"}
            elif n % 10 == 6:
                yield i, "<html>"
            elif n % 10 != 7:
                yield i, row


def test_details_and_their_errors(spark):
    ids = [f"{n:05d}" for n in range(1, 21)]
    local = spark.createDataFrame([(i, DAY, [1, 2, 3, 4, 5, 6 + (int(i) % 2 if int(i) % 10 != 8 else 3)]) for i in ids], "id string, date date, result array<int>")
    raw = merge.looked_up(local.select("id"), "tests.test_lookups:Details", batch=7)
    details = merge.checked_details(raw)
    found = {r["id"]: r for r in merge.cross_check(local, details, None, local.select("id")).collect()}
    assert len(found) == 20
    for i, r in found.items():
        n = int(i) % 10
        error = {3: "TimeoutError: too slow", 4: "detail is not valid: result has the wrong length", 5: "detail is of another id", 6: "detail is not valid: line is not JSON", 7: "LookupError: no detail"}.get(n)
        # what could not be looked up is an error and no mismatch
        assert (r["fetch_error"], r["error"], r["mismatches"]) == (error is not None, error, ["detail differs"] if n == 8 else [])
    assert merge.cross_check_status(merge.cross_check(local, details, None, ids[:2])).first()["status"] == "PASS"
    assert merge.cross_check_status(merge.cross_check(local, details, None, ids[:3])).first()["status"] == "PARTIAL"
    assert merge.cross_check_status(merge.cross_check(local, details, None, ids)).first()["status"] == "FAIL"
    assert merge.cross_check_status(merge.cross_check(local, details, None, [])).first()["status"] == "EMPTY"


def test_a_failing_batch_and_a_form_of_its_own(spark):
    ids = spark.createDataFrame([("00666",), ("00001",)], "id string").coalesce(1)
    assert {r["error"] for r in merge.checked_details(merge.looked_up(ids, "tests.test_lookups:Details")).collect()} == {"ConnectionError: source is down"}
    one = merge.looked_up(ids.where("id = '00001'"), "tests.test_lookups:Details", {"shift": 2})
    assert merge.checked_details(one).first()["result"] == [1, 2, 3, 4, 5, 9]
    renamed = lambda raw: raw.withColumn("value", F.replace("value", F.lit('"drawn"'), F.lit('"result"')))
    other = one.withColumn("value", F.replace("value", F.lit('"result"'), F.lit('"drawn"')))
    assert merge.checked_details(other).first()["error"].startswith("detail is not valid") and merge.checked_details(other, renamed).first()["result"] == [1, 2, 3, 4, 5, 9]


def test_portfolios_by_pairs_as_by_comparing_all(spark):
    r = random.Random(4)
    rows, groups = [], {}
    for p in range(40):
        pool = r.choice([8, 20, 45])
        tickets = [sorted(r.sample(range(1, pool + 1), 6)) for _ in range(r.choice([1, 2, 5, 30, 31]))]
        if p % 9 == 0:
            tickets = portfolio.planned_tickets(r.randrange(2, 31))
        if p % 7 == 3:
            tickets[0] = [1, 1, 2, 3, 4, 50]
        groups[p] = tickets
        rows += [(p, i, t) for i, t in enumerate(tickets)]
    # one portfolio with a third of all tickets
    groups[99] = [[1, 2, 3, 4, 5, 6]] * (len(rows) // 2)
    rows += [(99, i, t) for i, t in enumerate(groups[99])]
    table = spark.createDataFrame(rows, "portfolio int, ticket_id int, ticket array<int>").repartition(5)
    got = {x["portfolio"]: (x["n"], x["most_shared"], x["valid"]) for x in portfolio.validity(table).collect()}
    for p, tickets in groups.items():
        legal = all(len(set(t)) == 6 and 1 <= min(t) and max(t) <= 45 for t in tickets)
        most = max((len(set(a) & set(b)) for a, b in itertools.combinations(tickets, 2)), default=0) if len(tickets) <= 30 else None
        assert got[p] == (len(tickets), most if legal or most is None else got[p][1], legal and most is not None and most <= 1)
    assert sum(v[2] for v in got.values()) >= 5 and {v[1] for v in got.values()} >= {None, 0, 1, 2, 3, 4, 5}
    shared = {(x["portfolio"], x["i"], x["j"]): x["shared"] for x in portfolio.shared_pairs(table.where("portfolio < 5 and portfolio <> 3")).collect()}
    assert shared == {(p, i, j): len(set(a) & set(b)) for p in (0, 1, 2, 4) for (i, a), (j, b) in itertools.combinations(enumerate(groups[p]), 2) if len(set(a) & set(b)) > 1}
    assert tuple(portfolio.is_valid(table.where("false").drop("portfolio")).first()) == (0, None, False)


@pytest.mark.parametrize("split", ["2k", "128m"])
def test_line_numbers_of_files_read_in_splits(spark, tmp_path, split):
    r = random.Random(1)
    files = {}
    for name, n, end in (("a.jsonl", 3000, "\n"), ("b.jsonl", 5, "\r\n"), ("c.jsonl", 900, "\r\n"), ("d.jsonl", 0, "\n")):
        lines = [r.choice(["", "  ", f'{{"n":{i}}}' + "x" * r.randrange(40)]) for i in range(n)]
        (tmp_path / name).write_bytes("".join(x + end for x in lines).encode())
        files[name] = [(i, x.strip()) for i, x in enumerate(lines) if x.strip()]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        read = jsonl.read_lines(spark, str(tmp_path))
        assert split != "2k" or read.rdd.getNumPartitions() >= 1
        got = {}
        for x in read.collect():
            got.setdefault(x["file"].rsplit("/", 1)[-1], []).append((x["line"], x["value"]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in files.items() if v}


def test_live_check_and_a_source_that_fails(spark):
    ids = [f"{n:05d}" for n in range(1, 21)]
    local = spark.createDataFrame([(i, DAY, [1, 2, 3, 4, 5, 6]) for i in ids], "id string, date date, result array<int>")
    details = lambda error, date=DAY: lambda sample: sample.select("id", F.lit(date).alias("date"), F.array(*map(F.lit, range(1, 7))).alias("result"), F.lit(error).cast("string").alias("error"))
    seen = []

    def two_more(latest):
        seen.append(latest)
        return spark.createDataFrame([("00021",), ("00022",)], "id string")

    def failing(error):
        def crawl(latest):
            raise error

        return crawl

    row = lambda *a: tuple(checks.verify_live(*a).first())
    assert row(local, two_more, details(None)) == (2, 8, 0, 0, "PASS", 0) and seen == ["00020"]
    # details that cannot be fetched are counted, and are no mismatch
    assert row(local, two_more, details("too slow")) == (2, 8, 0, 8, "PASS", 0)
    assert row(local, two_more, details(None, DAY + datetime.timedelta(1))) == (2, 8, 8, 0, "FAIL", 1)
    assert row(local, lambda latest: None, details(None)) == (None, 8, 0, 0, "PASS", 0)
    assert row(local, lambda latest: local.where("false"), details(None)) == (0, 8, 0, 0, "FAIL", 1)
    assert row(local.where("false"), lambda latest: None, details(None)) == (None, 0, 0, 0, "PASS", 0)
    for error, outcome in ((ConnectionRefusedError("no"), ("NOT EXECUTED", 2)), (TimeoutError(), ("NOT EXECUTED", 2)), (ValueError("a page's text has TimeoutError: in it"), ("FAIL", 1)), (KeyError("id"), ("FAIL", 1))):
        assert row(local, failing(error), details(None))[4:] == outcome
    # a task's own error, and an anchor that no page has
    for error, outcome in (("ConnectionError", ("NOT EXECUTED", 2)), ("ValueError", ("FAIL", 1))):
        broken = lambda sample, e=error: sample.mapInPandas(raiser(e), "id string, date date, result array<int>, error string")
        assert row(local, two_more, broken)[4:] == outcome
    pages = local.select(F.lit(0).alias("page"), F.format_string("%05d", F.col("id").cast("int") + 50).alias("id"), F.col("date").cast("string").alias("date"), "result")
    assert row(local, lambda latest: paged.crawl(pages, latest, True), details(None))[4:] == ("FAIL", 1)


def raiser(name):
    import builtins

    def run(batches):
        for _ in batches:
            raise getattr(builtins, name)("in a task")
            yield

    return run


def test_findings_of_registry_files_and_ledger(spark):
    own = "experiment_id string, protocol_hash string, dataset_hash string, protocol_version string"
    registry = spark.createDataFrame([("a", "p", "d", "1"), ("b", "old", "d", "1"), ("c", "p", "d", "1"), ("e", "p", "d", "1")], own)
    files = spark.createDataFrame([
        ("a.json", "x", "a", "p", "d", "1"), ("b.json", "x", "b", "p", "d", "1"), ("b.json", "x", "b", "p", "d", "1"), ("c.json", "x", "c", "p", "d", "1"), ("c2.json", "y", "c", "p", "f", "1"), ("z.json", "{", None, None, None, None),
    ], "file string, content string, " + own)
    good = hashing.sha256("one|GENESIS")
    ledger = spark.createDataFrame([(1, "FROZEN", "one", None, good), (2, "LEGACY", "old", None, None), (3, None, "?", None, None), (4, "SCORED", "two", good, "0"), (5, "SCORED", "three", "1", None)], "line long, format string, content string, previousEntryHash string, entryHash string")
    exceptions = spark.createDataFrame([(1, "ARTIFACT_NAME", "c", "c2.json", "known"), (2, "ARTIFACT_NAME", "c", "c2.json", "late"), (3, "CHAIN_HASH", None, "4", "no"), (4, "DATASET_HASH_MISMATCH", "c", "d g", "another")], "line long, kind string, experiment_id string, detail string, justification string")
    found = provenance.audit(registry, registry.where("protocol_hash = 'p'"), files, ledger, exceptions)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([
        ("OPEN", "UNRECOGNISED_PROTOCOL_HASH", "b", "old", None), ("OPEN", "PROTOCOL_HASH_MISMATCH", "b", "old p", None), ("OPEN", "DATASET_HASH_MISMATCH", "c", "d f", None),
        ("OPEN", "ARTIFACT_COLLISION", "c", "2", None), ("EXPLAINED", "ARTIFACT_NAME", "c", "c2.json", "known"), ("OPEN", "ARTIFACT_MALFORMED", "z.json", "file is no artifact", None),
        ("FATAL", "LEDGER_LINE", None, "3", None), ("FATAL", "CHAIN_HASH", None, "4", None), ("FATAL", "CHAIN_LINK", None, "5", None), ("FATAL", "CHAIN_HASH", None, "5", None),
    ], key=repr)
    assert tuple(provenance.audit_status(found).first()) == (4, 5, 1, False)
    nothing = provenance.audit(registry.where("false"), registry, files.where("false"), ledger.where("line < 3"), exceptions)
    assert tuple(provenance.audit_status(nothing).first()) == (0, 0, 0, True)


def test_newlines_reports_and_unseeded_tickets(spark, tmp_path):
    texts = spark.createDataFrame([("a\r\nb\nc\r\n",), ("\r",), ("",), (None,)], "x string")
    assert [r[0] for r in texts.select(jsonl.canonical_newlines(F.col("x"))).collect()] == ["a\nb\nc\n", "\r", "", None]
    assert jsonl.latest_report(spark, str(tmp_path), "-audit.json") is None
    for name in ("2024-02-01-audit.json", "2024-10-01-audit.json", "2024-12-01-other.json", "2023-12-31-audit.json"):
        (tmp_path / name).write_text("no JSON")
    assert jsonl.latest_report(spark, str(tmp_path), "-audit.json").endswith("/2024-10-01-audit.json")
    picks = [r["p"] for r in spark.range(400).select(rng.quick_pick(F.col("id")).alias("p")).collect()]
    assert all(p == sorted(set(p)) and len(p) == 6 and 1 <= p[0] and p[-1] <= 45 for p in picks)
    assert len(set(map(tuple, picks))) > 390 and len({n for p in picks for n in p}) == 45


def test_readiness_of_what_is_missing_and_what_is_there(spark):
    row = "line long, id string, date date, result array<int>, reason string"
    good, bad, none = (spark.createDataFrame(x, row) for x in ([(0, "1", DAY, [1], None)], [(0, "1", DAY, [1], None), (1, "2", DAY, [1], "why")], []))
    described = {"schemaVersion": 2, "recordCount": 1, "sha256": "a" * 64, "firstId": "1", "lastId": "1", "firstDate": "2024-01-01", "lastDate": "2024-01-01", "continuous": True, "missing": 0}
    assert jsonl.is_manifest(described)
    answers = lambda *a: {r["check"]: (r["ok"], r["detail"]) for r in checks.readiness(spark, *a).collect()}
    fine = answers(good, described, "a" * 64, None, {})
    assert fine["dataset"] == (True, "1 rows") and fine["manifest"] == (True, "digest fits") and fine["requiredArtifact"] == (True, "present") and not fine["protocolLock"][0]
    assert answers(good, described, "b" * 64, None, None)["manifest"] == (False, "digest differs")
    assert answers(bad, described, "a" * 64, None, 7) | {"protocolLock": 0} == {"dataset": (False, "1 bad rows"), "manifest": (False, "no valid data set to compare"), "requiredArtifact": (False, "no JSON object"), "protocolLock": 0}
    assert answers(none, described, "a" * 64, None, None)["dataset"] == (False, "0 rows")
    lost = answers(None, None, None, None, None)
    assert {k: v[1] for k, v in lost.items() if k != "protocolLock"} == {"dataset": "not readable", "manifest": "not readable", "requiredArtifact": "not readable"} and not any(ok for ok, _ in lost.values())
    assert answers(good, {"sha256": 1}, "a" * 64, None, None)["manifest"] == (False, "wrong shape")
