"""Streams give a table's rows for any split into batches; sources that cannot be trusted end with an error and commit nothing."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import paged
from tidemark.streaming import limits


def limiter_events(seed):
    r = random.Random(seed)
    times = sorted(r.choice([0, 1, 5, 40, 300]) * 100 + r.randrange(30_000) for _ in range(60))
    return [(r.randrange(3), t) for t in times] + [(0, times[10])] * 3


@pytest.mark.parametrize("seed, batches, jumble", [(1, 1, 0), (2, 4, 0), (3, 5, 3000), (4, 7, 8000)])
def test_any_split_gives_the_tables_decisions(spark, tmp_path, seed, batches, jumble):
    """Batches of events in order, and out of order by less than the watermark's delay."""
    r = random.Random(seed)
    events = limiter_events(seed)
    frame = lambda rows: spark.createDataFrame([(u, t) for u, t in rows], "user_id bigint, ms bigint").select("user_id", F.timestamp_millis(F.col("ms") + 1_700_000_000_000).alias("ts"))
    want = sorted(tuple(x) for x in limits.limited(frame(events), 2_000, 3).collect())
    assert {x[2] for x in want} == {True, False}
    arrived = sorted(events, key=lambda e: e[1] + r.randrange(jumble + 1))
    cuts = sorted(r.sample(range(1, len(events)), batches - 1))
    parts = [arrived[a:b] for a, b in zip([0, *cuts], [*cuts, len(events)])]
    # a last request of another user, far later, moves the watermark past all others
    source = tmp_path / "in"
    source.mkdir()
    for i, part in enumerate([*parts, [(99, 10_000_000)]]):
        lines = [json.dumps({"user_id": u, "at": t + 1_700_000_000_000}) for u, t in part]
        (source / f"{i:03d}.json").write_text("\n".join(lines))
        import os

        os.utime(source / f"{i:03d}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema("user_id bigint, at bigint").option("maxFilesPerTrigger", 1).json(str(source)).select("user_id", F.timestamp_millis("at").alias("ts"))
    out = str(tmp_path / "out")
    q = limits.limited(stream, 2_000, 3, "10 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(x) for x in spark.read.parquet(out).collect() if x["user_id"] != 99)
    assert got == want


# ---- pages -----------------------------------------------------------------------------------------------------------

SIZE = paged.PAGE_SIZE


def draw(n):
    return {"id": f"{n:05d}", "date": "2024-01-01", "result": [1, 2, 3, 4, 5, 6]}


def put(folder, ids):
    """Pages of eight, newest first."""
    for p in folder.glob("*.json"):
        p.unlink()
    for i in range(0, len(ids), SIZE):
        (folder / f"{i // SIZE}.json").write_text(json.dumps([draw(n) for n in ids[i : i + SIZE]]))


@pytest.fixture
def pages(spark, tmp_path):
    spark.dataSource.register(paged.PagedDraws)
    folder = tmp_path / "pages"
    folder.mkdir()

    def run(**options):
        stream = spark.readStream.format("paged_draws").options(folder=str(folder), **options).load()
        q = stream.writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(int(r["id"]) for r in spark.read.schema(paged.ROWS).json(str(tmp_path / "out")).collect())

    return folder, run


def test_stream_reaches_its_anchor(pages):
    folder, run = pages
    put(folder, range(40, 0, -1))
    assert run(after="00017") == list(range(18, 41))
    put(folder, range(95, 0, -1))
    assert run(after="00017") == list(range(18, 96))
    assert run(after="00017") == list(range(18, 96))


def test_a_source_above_the_anchor_commits_nothing(pages):
    folder, run = pages
    put(folder, range(40, 20, -1))
    with pytest.raises(Exception, match="no page reaches back to 00017"):
        run(after="00017")
    put(folder, range(40, 0, -1))
    assert run(after="00017") == list(range(18, 41))
    # later the source loses what was read last
    put(folder, range(90, 45, -1))
    with pytest.raises(Exception, match="no page reaches back to 00040"):
        run(after="00017")
    put(folder, range(30, 0, -1))
    with pytest.raises(Exception, match="went back from 00090 to 00030"):
        run(after="00017")
    put(folder, range(90, 0, -1))
    assert run(after="00017") == list(range(18, 91))


def test_a_hole_between_pages_is_an_error(pages):
    folder, run = pages
    put(folder, range(40, 0, -1))
    (folder / "1.json").write_text(json.dumps([draw(n) for n in range(32, 27, -1)]))
    with pytest.raises(Exception, match="page 1 is missing or short"):
        run(after="00005")


def test_first_crawl_with_and_without_a_first_id(pages):
    folder, run = pages
    put(folder, range(20, 3, -1))
    with pytest.raises(Exception, match="no page reaches back to 00001"):
        run(first="00001")
    put(folder, range(20, 0, -1))
    assert run(first="00001") == list(range(1, 21))
    put(folder, range(29, 0, -1))
    assert run(first="00001") == list(range(1, 30))


class Growing(paged.JsonPages):
    """Grows by rows on top each time its newest page has been looked at a few times."""

    seen = 0

    def fetch(self, page):
        Growing.seen += 1
        top = 40 + Growing.seen // 5 % 20
        ids = list(range(top, 0, -1))[page * SIZE : (page + 1) * SIZE]
        return [draw(n) for n in ids]

    def count(self):
        return 8


def test_rows_that_move_while_they_are_read():
    reader = paged.PageStream({"adapter": "tests.test_streams:Growing", "folder": ".", "after": "00003"})
    for _ in range(12):
        Growing.seen = 0
        end = reader.latestOffset()
        parts = reader.partitions({"id": "00003", "pages": 0}, end)
        got = sorted(int(r[1]) for p in parts for r in reader.read(p))
        assert got == list(range(4, int(end["id"]) + 1))


# ---- ledger ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_ledger_state_after_each_batch(spark, tmp_path, seed):
    """Lines of few entries in any order and split: full lines that come again, scores before, behind and without one, broken lines."""
    import os

    from tidemark.operators import provenance
    from tidemark.streaming import ledger

    r = random.Random(seed)
    entry = {"drawId": "1", "frozenAt": "2026-01-01T00:00:00Z", "protocolHash": "p", "datasetHashAtFreeze": "d", "strategyId": "HOT", "prediction": [1, 2, 3, 4, 5, 6], "result": None, "matches": None, "tier": None}
    lines = []
    for n in range(120):
        e = f"e{r.randrange(9)}"
        kind = r.choice(["FROZEN", "SCORED", "SCORED", "LEGACY", "OTHER", "{"])
        if kind == "FROZEN":
            value = {**entry, "kind": kind, "entryId": e}
        elif kind == "SCORED":
            value = {"kind": kind, "entryId": e, "drawId": "1", "strategyId": "HOT", "result": [1, 2, 3, 4, 5, n % 39 + 6], "matches": n % 7, "tier": "NONE"}
        elif kind == "LEGACY":
            scored = r.random() < 0.3
            value = {**entry, "drawId": e, "result": [7, 8, 9, 10, 11, 12] if scored else None, "matches": 0 if scored else None, "tier": "NONE" if scored else None}
        else:
            value = {"kind": kind}
        lines.append((n, "{" if kind == "{" else json.dumps(value)))
    arrived = sorted(lines, key=lambda x: x[0] + r.randrange(40)) if seed == 1 else r.sample(lines, len(lines))
    source, table = tmp_path / "in", str(tmp_path / "state")
    source.mkdir()
    key = lambda row: (row["entry_id"], row["first_line"], row["base_line"], row["result"], row["matches"], row["tier"], row["status"])
    for i in range(4):
        part = arrived[: (i + 1) * 30]
        (source / f"{i}.json").write_text("\n".join(json.dumps({"line": n, "value": v}) for n, v in part[i * 30 :]))
        os.utime(source / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
        stream = spark.readStream.schema("line bigint, value string").json(str(source))
        ledger.keep_state(stream, table, str(tmp_path / "checkpoint")).awaitTermination()
        want = provenance.fold(provenance.parse_ledger(spark.createDataFrame(part, "line bigint, value string")))
        got = ledger.state(spark, table)
        assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    ledger.compacted(spark, table, str(tmp_path / "other"))
    assert sorted(map(key, ledger.state(spark, str(tmp_path / "other")).collect())) == sorted(map(key, got.collect()))


# ---- mirror ----------------------------------------------------------------------------------------------------------


def test_a_mirror_makes_a_batch_for_each_version(spark, tmp_path):
    from tidemark.sources import jsonl, mirror

    spark.dataSource.register(mirror.MirrorLines)
    text, out = tmp_path / "mirror.jsonl", str(tmp_path / "out")
    put_rows = lambda n: text.write_text("\n".join(json.dumps(draw(i)) for i in range(1, n + 1)) + "\n")
    options = {"adapter": "tidemark.sources.mirror:FileMirror", "path": str(text)}

    def run():
        q = spark.readStream.format("mirror_lines").options(**options).load().writeStream.format("json").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination()
        rows = spark.read.schema(mirror.LINES).json(out)
        return sorted(rows.distinct().groupBy("version").count().select("count").toPandas()["count"].tolist())

    put_rows(120)
    assert run() == [120]
    # unchanged is not empty, and makes no batch
    assert run() == [120]
    put_rows(121)
    assert run() == [120, 121]
    text.write_text("<html>moved</html>\n" * 500)
    with pytest.raises(Exception, match="has 0 rows, fewer than 100"):
        run()
    put_rows(99)
    with pytest.raises(Exception, match="has 99 rows"):
        run()
    rows = spark.read.format("mirror_lines").options(**options)
    with pytest.raises(Exception, match="has 99 rows"):
        rows.load().collect()
    put_rows(130)
    assert run() == [120, 121, 130]
    put_rows(100)
    found = jsonl.validated(rows.load().select("line", "value"))
    assert found.where("reason is null").count() == 100
    assert rows.option("known", mirror.FileMirror(options).version()).load().count() == 0
