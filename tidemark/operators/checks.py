"""Checks of a data set before and after it is published, guards against later rows, and requests to refresh."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, rules
from ..session import settled
from ..sources import jsonl
from . import draws, merge

#: Limits of a refresh request.
MOST_BYTES, MOST_RECORDS = 2 * 1024 * 1024, 3000
#: Errors by which a source could not be reached; a task's error is known by its text only.
UNREACHED = ("ConnectionError", "ConnectionRefusedError", "ConnectionResetError", "ConnectionAbortedError", "BrokenPipeError", "TimeoutError", "gaierror", "URLError")
LIVE = "new_rows bigint, sample_size bigint, failures bigint, fetch_errors bigint, outcome string, exit_code int"


def before(table: DataFrame, date: str) -> DataFrame:
    """Rows strictly before a date."""
    return table.where(F.col("date") < F.lit(date).cast("date"))


def without_later_rows(history: DataFrame, date: str) -> DataFrame:
    """``history`` as it is; a row on the date or later is an error where it is met, and is never dropped."""
    late = F.concat(F.lit("row "), F.col("id"), F.lit(" of "), F.col("date").cast("string"), F.lit(f" is not before {date}"))
    held = F.when(F.col("date") >= F.lit(date).cast("date"), F.raise_error(late).cast("date")).otherwise(F.col("date"))
    return history.withColumn("date", held)


def valid_pool(pool: Column, size: int = 18) -> Column:
    """The pool as it is; one without ``size`` distinct numbers in 1 .. 45 is an error."""
    return F.when(rules.is_valid_result(pool, size), pool).otherwise(F.raise_error(F.concat(F.lit(f"pool has not {size} distinct numbers: "), F.coalesce(F.to_json(pool), F.lit("null")))).cast("array<int>"))


def data_check(table: DataFrame, manifest: dict | None, digest: str, on_disk: DataFrame | None = None) -> DataFrame:
    """``check, ok, detail``: not empty, ids and order, manifest present, its digest and count, and the lines on disk as they should be.

    ``on_disk`` has ``t, line``; lines are compared by position.
    """
    spark = table.sparkSession
    counted = table.agg(F.count(F.lit(1)).alias("n"))
    row = lambda name, ok, detail: F.struct(F.lit(name).alias("check"), ok.alias("ok"), detail.cast("string").alias("detail"))
    n = F.col("n")
    fixed = [row("not_empty", n > 0, n), row("manifest_present", F.lit(manifest is not None), F.lit(None))]
    if manifest is not None:
        fixed += [row("digest", F.lit(manifest["sha256"] == digest), F.lit(digest[:16])), row("record_count", n == manifest["recordCount"], n)]
    checks = counted.select(F.explode(F.array(*fixed)).alias("c")).select("c.*")
    issues = merge.dataset_issues(table).agg(F.count(F.lit(1)).alias("n"), F.min_by("reason", F.struct("index", "reason")).alias("first"))
    out = checks.unionByName(issues.select(F.lit("ids_and_order").alias("check"), (n == 0).alias("ok"), F.col("first").alias("detail")))
    if on_disk is not None:
        own = jsonl.serialised(table.select("t", "date", "id", "result")).withColumnRenamed("line", "want")
        met = own.join(table.select("id", "t"), "id").select("t", "want").join(on_disk.select("t", "line"), "t", "full")
        differ = met.agg(F.count_if(~F.col("want").eqNullSafe(F.col("line"))).alias("n"))
        out = out.unionByName(differ.select(F.lit("canonical").alias("check"), (n == 0).alias("ok"), n.cast("string").alias("detail")))
    return out


def passed(checks: DataFrame) -> DataFrame:
    return checks.agg(F.coalesce(F.bool_and("ok"), F.lit(False)).alias("ok"), F.count_if(~F.col("ok")).alias("failures"))


def status(table: DataFrame, manifest: dict | None) -> DataFrame:
    """One row: what is there, its continuity, and what the manifest says of it."""
    span = table.agg(F.count(F.lit(1)).alias("records"), F.min_by("id", F.struct("date", "id")).alias("first_id"), F.max_by("id", F.struct("date", "id")).alias("latest_id"), F.min("date").alias("first_date"), F.max("date").alias("latest_date"))
    gaps = merge.continuity(table).select("n_missing", "n_duplicates", "continuous")
    out = span.join(F.broadcast(gaps), how="cross")  # one row each
    return out.withColumn("manifest_records", F.lit((manifest or {}).get("recordCount")).cast("long")).withColumn("manifest_sha256", F.lit((manifest or {}).get("sha256")).cast("string"))


def report_lines(issues: DataFrame, most: int = 10) -> DataFrame:
    """``nth, text``: the first ``most`` issues in order, and a line that counts the rest."""
    text = F.concat(F.when(F.col("id").isNotNull(), F.concat(F.lit("id "), F.col("id"), F.lit(": "))).otherwise(""), F.col("reason"))
    top = issues.orderBy(F.asc_nulls_last("index"), "reason", F.asc_nulls_last("id")).limit(most)
    numbered = top.agg(F.sort_array(F.collect_list(F.struct(F.coalesce("index", F.lit(1 << 62)).alias("i"), "reason", text.alias("text")))).alias("rows")).select(F.posexplode("rows").alias("nth", "r")).select(F.col("nth").cast("long").alias("nth"), "r.text")
    rest = issues.agg((F.count(F.lit(1)) - most).alias("n")).where("n > 0").select(F.lit(most).cast("long").alias("nth"), F.concat(F.lit("and "), F.col("n").cast("string"), F.lit(" more")).alias("text"))
    return numbered.unionByName(rest)


def readiness(spark: SparkSession, rows: DataFrame | None, manifest: dict | None, digest: str | None, lock: dict | None, artifact: object) -> DataFrame:
    """``check, ok, detail`` of the data set (``rows`` as validated), manifest, protocol lock and required artifact; None stands for what could not be read."""
    from .registry import lock_problem

    counts = (F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason").isNotNull()).alias("bad"))
    counted = rows.agg(*counts) if rows is not None else spark.range(1).select(F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("bad"))
    n, bad = F.col("n"), F.col("bad")
    whole = F.coalesce((n > 0) & (bad == 0), F.lit(False))
    described = jsonl.is_manifest(manifest)
    fits = whole & F.lit(bool(described and manifest["sha256"] == digest))
    compared = F.when(~whole, "no valid data set to compare").when(fits, "digest fits").otherwise("digest differs")
    problem = lock_problem(lock)
    row = lambda name, ok, detail: F.struct(F.lit(name).alias("check"), ok.alias("ok"), detail.alias("detail"))
    return counted.select(F.explode(F.array(
        row("dataset", whole, F.when(n.isNull(), "not readable").when(bad > 0, F.concat(bad.cast("string"), F.lit(" bad rows"))).otherwise(F.concat(n.cast("string"), F.lit(" rows")))),
        row("manifest", fits, F.lit("not readable") if manifest is None else compared if described else F.lit("wrong shape")),
        row("protocolLock", F.lit(problem is None), F.lit(problem or f"version {lock['protocolVersion']}")),
        row("requiredArtifact", F.lit(isinstance(artifact, (dict, list))), F.lit("present" if isinstance(artifact, (dict, list)) else "not readable" if artifact is None else "no JSON object")),
    )).alias("c")).select("c.*")


def refresh_state(status: Column, added: Column, conflicts: Column) -> Column:
    """What a finished sync means to a reader of the data."""
    return F.when((status == "not-modified") | ((status == "ok") & (added == 0)), "up-to-date").when(status == "ok", "updated").when(conflicts > 0, "conflict").otherwise("error")


def refresh_requests(bodies: DataFrame, allow_force: bool = False, most: int = MOST_RECORDS) -> DataFrame:
    """``status, problem`` of JSON texts in ``body``: 200 with no problem, or the first refusal."""
    v = F.try_parse_json(F.col("body"))
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    absent = lambda path: kind(path).isNull()
    wrong = lambda path, start: ~absent(path) & ~kind(path).startswith(start)
    records = F.size(F.try_variant_get(v, "$.records", "array<variant>"))
    force = F.coalesce(F.try_variant_get(v, "$.force", "boolean"), F.lit(False))
    tests = [
        (F.octet_length("body") > MOST_BYTES, 413, "body is too large"),
        (v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), 400, "body is no object"),
        (wrong("$.force", "BOOLEAN"), 400, "force is no boolean"),
        (force & F.lit(not allow_force), 403, "force is not allowed"),
        (wrong("$.revalidateOfficialCache", "BOOLEAN"), 400, "revalidateOfficialCache is no boolean"),
        (wrong("$.records", "ARRAY"), 400, "records is no list"),
        (records > most, 413, "too many records"),
        (wrong("$.manifest", "OBJECT") & (kind("$.manifest") != "VOID"), 400, "manifest is no object"),
    ]
    first = F.coalesce(*[F.when(F.coalesce(t, F.lit(False)), F.struct(F.lit(s).alias("status"), F.lit(p).alias("problem"))) for t, s, p in tests], F.struct(F.lit(200).alias("status"), F.lit(None).cast("string").alias("problem")))
    return bodies.withColumn("_f", first).select(*bodies.columns, F.col("_f.status").alias("status"), F.col("_f.problem").alias("problem"))


def sync(existing: DataFrame, incoming: DataFrame | None, allow_gaps: bool = False, width: int = 5) -> tuple[DataFrame, dict]:
    """The merged table and a summary; any fault gives the existing table back.  ``incoming`` None means that nothing has changed.

    ``incoming`` has ``ordinal, id, date, result`` and, where it comes from :func:`jsonl.validated`, ``reason``.
    """
    if incoming is None:
        return existing, {"status": "not-modified", "added": 0, "conflicts": 0}
    if "reason" in incoming.columns:
        rejected = incoming.where("reason is not null").count()
        if rejected:
            return existing, {"status": "error", "added": 0, "conflicts": 0, "rejected": rejected, "error": f"{rejected} rejected rows"}
    counts = merge.counters(merge.classified(existing, incoming)).first().asDict()
    summary = {"status": "ok", **counts, "rejected": 0}
    if counts["conflicts"]:
        return existing, {**summary, "status": "error", "added": 0, "error": f"{counts['conflicts']} conflicting rows"}
    new = merge.merged(existing, incoming)
    state = merge.continuity(new).first()
    if state["n_duplicates"] or (state["n_missing"] and not allow_gaps):
        return existing, {**summary, "status": "error", "added": 0, "error": f"{state['n_missing']} missing and {state['n_duplicates']} repeated ids"}
    was, now = existing.agg(F.max("date")).first()[0], new.agg(F.max("date")).first()[0]
    if was is not None and now < was:
        return existing, {**summary, "status": "error", "added": 0, "error": "the latest date went back"}
    return new, summary


def unreachable(error: Exception) -> bool:
    """Whether a source could not be reached at all; what it sent and what could not be read is another matter."""
    names = {c.__name__ for c in type(error).__mro__}
    last = [x.split(":")[0].rsplit(".", 1)[-1].strip() for x in str(error).splitlines() if x[:1].strip()]
    return bool(names.intersection(UNREACHED)) or any(x in UNREACHED for x in last)


def verify_live(local: DataFrame, crawl: Callable[[str | None], DataFrame | None], lookup: Callable[[DataFrame], DataFrame], extra: int = 5, seed: int = 645) -> DataFrame:
    """One row ``new_rows, sample_size, failures, fetch_errors, outcome, exit_code``: ``local`` against its source; nothing of ``local`` is written.

    ``crawl(latest_id)`` gives the rows above an id, or None where nothing has changed; ``lookup(ids)`` gives details
    ``id, date, result, error`` of sampled ids.  FAIL (1) for a sampled row that differs, for a change without a row and
    for an error of the source's contents; NOT EXECUTED (2) where the source could not be reached; else PASS (0), also
    where single details could not be looked up, which are counted.  An empty ``local`` has no sample.
    """
    spark = local.sparkSession
    try:
        fetched = crawl(draws.latest_id(local).first()[0])
        fetched = fetched if fetched is None else settled(fetched, "live-rows")
        ids = merge.sample_ids(local, extra, seed)
        sample = spark.createDataFrame([(i,) for i in ids], "id string")
        details = settled(lookup(sample).select("id", "date", "result", "error"), "live-details")
    except Exception as e:  # the source's own failure is the finding
        reached = not unreachable(e)
        return spark.createDataFrame([(None, None, None, None, "FAIL" if reached else "NOT EXECUTED", 1 if reached else 2)], LIVE)
    checked = merge.cross_check_status(merge.cross_check(local, details, None, ids))
    new = fetched.agg(F.count(F.lit(1)).alias("new_rows")) if fetched is not None else spark.range(1).select(F.lit(None).cast("long").alias("new_rows"))
    bad = F.coalesce(F.col("new_rows") == 0, F.lit(False)) | (F.col("status") == "FAIL")
    out = checked.join(F.broadcast(new), how="cross")  # one row each
    return out.select("new_rows", "sample_size", "failures", "fetch_errors", F.when(bad, "FAIL").otherwise("PASS").alias("outcome"), bad.cast("int").alias("exit_code"))


def digest_of(table: DataFrame) -> str:
    """SHA-256 of the canonical lines of ``t, date, id, result``."""
    return hashing.dataset_hash(table.select("t", hashing.draw_json(F.col("date").cast("string"), F.col("id"), F.col("result")).alias("line")))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
