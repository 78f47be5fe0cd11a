"""Registered experiments, protocol locks and their history, artifacts and published summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..sources import jsonl
from ..sources.shapes import blank, has_kind, json_value, no_flag, no_number, no_object, no_text, no_time, not_an_object, one_of, present, whole_or_nothing
from .prospective import STRATEGIES

#: Names of states and kinds.
STATUSES = ("REGISTERED", "RUNNING", "COMPLETED", "FAILED", "INVALIDATED")
HISTORY_SOURCES = ("lock", "migrated-existing-lock", "migrated-pre-lock-registry")
VIOLATIONS = ("UNKNOWN_PROTOCOL_HASH", "ARTIFACT_PROTOCOL_HASH_MISMATCH", "ARTIFACT_DATASET_HASH_MISMATCH", "ARTIFACT_EXPERIMENT_ID_MISMATCH", "ARTIFACT_ID_COLLISION", "ARTIFACT_FILENAME_MISMATCH", "MALFORMED_ARTIFACT_FILE")
HOLM_FALLBACK = 3


def record_problem(v: Column) -> Column:
    """First problem of a registry line: required fields, then optional ones that are there."""
    kinds = F.try_variant_get(v, "$.predictions", "array<variant>")
    return F.coalesce(
        not_an_object(v), blank(v, "experimentId"), blank(v, "hypothesisId"), blank(v, "familyId"), one_of(v, "strategyId", STRATEGIES), blank(v, "strategyVersion"), no_object(v, "parameters"),
        no_number(v, "seed"), blank(v, "datasetHash"), blank(v, "protocolVersion"), blank(v, "protocolHash"), no_time(v, "registeredAt"), one_of(v, "status", STATUSES),
        no_number(v, "budgetTickets", True), no_number(v, "budgetVnd", True),
        F.when(present(v, "$.predictionKind"), one_of(v, "predictionKind", ("single_ticket", "portfolio"))),
        F.when(present(v, "$.predictions") & ~(has_kind(v, "$.predictions", "ARRAY") & F.coalesce(F.forall(kinds, lambda x: F.schema_of_variant(x) == "STRING"), F.lit(False))), "predictions is no list of texts"),
        no_flag(v, "preRegistered", True), no_text(v, "dataCutoffDrawId"), no_text(v, "dataCutoffDate"), no_text(v, "rankingScoreVersion", nullable=True),
    )


def history_problem(v: Column) -> Column:
    return F.coalesce(not_an_object(v), blank(v, "protocolHash"), blank(v, "protocolVersion"), no_time(v, "recordedAt"), one_of(v, "source", HISTORY_SOURCES), no_text(v, "note"))


def exception_problem(v: Column) -> Column:
    return F.coalesce(not_an_object(v), one_of(v, "kind", VIOLATIONS), blank(v, "experimentId"), blank(v, "detail"), blank(v, "justification"), no_time(v, "discoveredAt"), no_flag(v, "rootCauseFixed"))


def artifact_problem(v: Column) -> Column:
    return F.coalesce(
        not_an_object(v), blank(v, "experimentId"), no_text(v, "gitCommit", optional=False, nullable=True), blank(v, "datasetSha256"), blank(v, "protocolVersion"), blank(v, "protocolHash"), no_object(v, "strategy"),
        F.when(F.coalesce(F.try_variant_get(v, "$.strategy.id", "string"), F.lit("")) == "", "strategy.id is missing or blank"), no_number(v, "seed"),
        *[no_object(v, name) for name in ("temporalSplit", "metrics", "statistics", "controls", "runtime")],
    )


def family_problem(v: Column) -> Column:
    """Of a family summary: whole counts of one or more, and both names of the size agree."""
    least = lambda name: F.coalesce(no_number(v, name), F.when(~(F.try_variant_get(v, f"$.{name}", "double") >= 1), f"{name} is below one"))
    floor = lambda name: F.floor(F.try_variant_get(v, f"$.{name}", "double"))
    return F.coalesce(not_an_object(v), blank(v, "familyId"), *map(least, ("familySize", "hypothesisCount", "lookCount", "fallbackFamilySize")), F.when(floor("familySize") != floor("hypothesisCount"), "family sizes differ"))


def lock_problem(lock: object) -> str | None:
    if not isinstance(lock, dict):
        return "not readable" if lock is None else "wrong shape"
    texts = all(isinstance(lock.get(k), str) for k in ("protocolVersion", "protocolHash", "protocolLockedAt", "protocolDatasetHash"))
    start = lock.get("prospectiveStartDrawId", 0)
    return None if texts and (start is None or isinstance(start, str)) else "wrong shape"


def parsed(values: DataFrame, problem, kind: str) -> DataFrame:
    """JSON texts in ``value`` as columns of the struct type ``kind``; one bad text, and there are no rows."""
    rows = values.withColumn("problem", problem(json_value("value")))
    return whole_or_nothing(rows).select(F.from_json("value", kind).alias("_r")).select("_r.*")


HISTORY = "protocolHash string, protocolVersion string, recordedAt string, source string, note string"
EXCEPTIONS = "kind string, experimentId string, detail string, justification string, discoveredAt string, rootCauseFixed boolean"
REGISTRY = "experimentId string, hypothesisId string, familyId string, strategyId string, strategyVersion string, seed double, datasetHash string, protocolVersion string, protocolHash string, registeredAt string, status string"
FAMILY = "familyId string, familySize double, hypothesisCount double, lookCount double, fallbackFamilySize double"


def family_summary(registry: DataFrame, family: str, fallback: int = HOLM_FALLBACK, extra_looks: list[str] | None = None) -> DataFrame:
    """One row: size of the family for Holm (hypotheses, or the fallback) and looks (distinct data sets with the extra ones, one at least)."""
    mine = registry.where(F.col("family_id") == family)
    hypothesis = F.coalesce(F.nullif(F.trim("hypothesis_id"), F.lit("")), F.col("strategy_id"))
    extra = F.lit(extra_looks or []).cast("array<string>")
    counted = mine.agg(F.count_distinct(hypothesis).alias("h"), F.size(F.array_union(F.collect_set("dataset_hash"), extra)).alias("l"))
    size = F.coalesce(F.nullif(F.col("h"), F.lit(0).cast("long")), F.lit(fallback).cast("long"))
    return counted.select(F.lit(family).alias("family_id"), size.alias("family_size"), size.alias("hypothesis_count"), F.greatest("l", F.lit(1)).cast("long").alias("look_count"), F.lit(fallback).cast("long").alias("fallback_family_size"))


def registered(experiments: DataFrame, now: str) -> DataFrame:
    return experiments.withColumn("registered_at", F.lit(now)).withColumn("status", F.lit("REGISTERED"))


def ids(strategies: DataFrame, family: str, dataset_hash: str, protocol_hash: str) -> DataFrame:
    """``strategy_id`` with the id of an experiment and the older one that lacks the protocol."""
    old = F.concat(F.lit(f"{family}-"), F.lower("strategy_id"), F.lit(f"-{dataset_hash[:8]}"))
    return strategies.withColumn("experiment_id", F.concat(old, F.lit(f"-{protocol_hash[:8]}"))).withColumn("legacy_id", old)


def unregistered(named: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows of :func:`ids` that the registry knows under neither id."""
    known = registry.select(F.col("experiment_id").alias("_known")).distinct()
    fresh = named.join(known, F.col("experiment_id") == F.col("_known"), "left_anti")
    return fresh.join(known, F.col("legacy_id") == F.col("_known"), "left_anti")


def append(rows: DataFrame, folder: str) -> None:
    """Rows as JSON lines behind those already there; none is ever rewritten."""
    rows.write.mode("append").json(folder)


def protocol_lock(latest: DataFrame, version: str, protocol_hash: str, dataset_hash: str, locked_at: str) -> DataFrame:
    """One row from the one row ``latest_id``: what is locked, and the first draw that counts as prospective."""
    return latest.select(F.lit(version).alias("protocol_version"), F.lit(protocol_hash).alias("protocol_hash"), F.lit(locked_at).alias("protocol_locked_at"), F.lit(dataset_hash).alias("protocol_dataset_hash"), rules.next_id(F.col("latest_id")).alias("prospective_start_draw_id"))


def history_of_lock(lock: DataFrame) -> DataFrame:
    """The first entry of a history that begins while a lock is already there."""
    return lock.select("protocol_hash", "protocol_version", F.col("protocol_locked_at").alias("recorded_at"), F.lit("migrated-existing-lock").alias("source"))


def artifacts(report: DataFrame, scores: DataFrame, family: str, dataset_hash: str, protocol_hash: str, version: str, seed: int, lookback: int) -> DataFrame:
    """One row a strategy from the report's rows: its id, the dates and trials of the phases, and the TEST numbers."""
    spans = scores.groupBy("phase").agg(F.min("date").cast("string").alias("start_date"), F.max("date").cast("string").alias("end_date"), F.count_distinct("t").alias("trials"))
    split = spans.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.lower("phase"), F.struct("start_date", "end_date", "trials"))))).alias("temporal_split"))
    test = report.where("phase = 'TEST' and strategy <> 'RANDOM'")
    named = ids(test.withColumn("strategy_id", F.col("strategy")), family, dataset_hash, protocol_hash)
    out = named.join(F.broadcast(split), how="cross")  # one row on the right
    return out.select(
        "experiment_id", F.lit(dataset_hash).alias("dataset_sha256"), F.lit(version).alias("protocol_version"), F.lit(protocol_hash).alias("protocol_hash"), "strategy_id", F.lit(lookback).alias("lookback"), F.lit(seed).alias("seed"), "temporal_split",
        F.struct("average_matches", "hit3_rate_pct", "roi_pct", "edge").alias("metrics"),
        F.struct(F.col("edge").alias("effect_size"), F.col("ci95_low").alias("ci_low"), F.col("ci95_high").alias("ci_high"), "p_value", "adjusted_p", F.lit("newey-west-hac").alias("variance_method")).alias("statistics"),
    )


def documents(rows: DataFrame, name: str) -> DataFrame:
    """Rows as one JSON document: ``schemaVersion`` 1 and a list."""
    return rows.agg(F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.lit(name).alias("kind"), F.sort_array(F.collect_list(F.struct(*rows.columns))).alias("rows"))).alias("document"))


def document_problem(v: Column, columns: tuple[str, ...]) -> Column:
    rows = F.try_variant_get(v, "$.rows", "array<variant>")
    missing = F.exists(rows, lambda r: ~F.forall(F.array(*map(F.lit, columns)), lambda c: F.array_contains(F.map_keys(F.try_variant_get(r, "$", "map<string,variant>")), c)))
    return F.coalesce(not_an_object(v), F.when(~F.coalesce(F.try_variant_get(v, "$.schemaVersion", "int") == 1, F.lit(False)), "unknown version"), F.when(rows.isNull(), "rows is no list"), F.when(missing, "a row lacks a field"))


def publish(spark: SparkSession, rows: DataFrame, name: str, path: str, overwrite: bool = True) -> dict:
    """The rows' document, written only if it reads back as one."""
    import json

    text = documents(rows, name).first()["document"]
    problem = spark.createDataFrame([(text,)], "value string").select(document_problem(json_value("value"), tuple(rows.columns)).alias("p")).first()["p"]
    if problem:
        raise ValueError(f"{name}: {problem}")
    value = json.loads(text)
    jsonl.save_json(spark, value, path, overwrite)
    return value
