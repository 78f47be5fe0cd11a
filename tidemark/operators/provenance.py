"""Append-only registry and hash-chained ledger: folds, joins and violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing

LEDGER = "kind string, entryId string, drawId string, strategyId string, frozenAt string, protocolHash string, datasetHashAtFreeze string, prediction array<int>, scoredAt string, result array<int>, matches int, tier string, previousEntryHash string, entryHash string"


def parse_ledger(lines: DataFrame) -> DataFrame:
    """``line`` and the union of all events' columns, with ``format`` and ``issue``; a line without a kind is LEGACY."""
    e = F.from_json("value", LEDGER, {"mode": "PERMISSIVE"})
    rows = lines.select("line", "value", e.alias("e")).select("line", "value", "e.*")
    kind = F.when(F.col("kind").isNull() & F.col("drawId").isNotNull(), "LEGACY").when(F.col("kind").isin("FROZEN", "SCORED"), F.col("kind"))
    own = F.coalesce("entryId", hashing.entry_id(F.col("drawId"), F.col("strategyId"), F.col("frozenAt")))
    return rows.withColumn("format", kind).withColumn("entry_id", own).withColumn("issue", F.when(kind.isNull(), "unknown kind"))


def fold(events: DataFrame) -> DataFrame:
    """State of each entry from ``line, entry_id, format, result, matches, tier``.

    The last LEGACY or FROZEN line is the entry; the first SCORED line after it fills it if
    it has no result yet; SCORED lines without an entry before them are dropped.
    """
    base = F.col("format").isin("LEGACY", "FROZEN")
    last = events.groupBy("entry_id").agg(F.max(F.when(base, F.col("line"))).alias("base_line"), F.min(F.when(base, F.col("line"))).alias("first_line"))
    held = events.join(last.where("base_line is not null"), "entry_id")
    score = F.struct("result", "matches", "tier")
    out = held.groupBy("entry_id", "base_line", "first_line").agg(
        F.max(F.when(F.col("line") == F.col("base_line"), score)).alias("b"),
        F.min_by(F.when(F.col("format") == "SCORED", score), F.when((F.col("format") == "SCORED") & (F.col("line") > F.col("base_line")), F.col("line"))).alias("s"),
    )
    pick = lambda c: F.when(F.col("b.result").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"s.{c}"))
    return out.select("entry_id", "first_line", "base_line", pick("result").alias("result"), pick("matches").alias("matches"), pick("tier").alias("tier"), F.when(pick("result").isNotNull(), "SCORED").otherwise("PENDING").alias("status"))


def with_previous(events: DataFrame, block: int = 1 << 16) -> DataFrame:
    """The claimed hash of the chained line before, without one task for all lines: blocks of lines, and their last hashes."""
    chained = events.where("format <> 'LEGACY'").withColumn("blk", F.expr(f"line div {block}"))
    inside = chained.withColumn("before", F.lag("entryHash").over(Window.partitionBy("blk").orderBy("line")))
    ends = chained.groupBy("blk").agg(F.max_by("entryHash", "line").alias("end")).withColumn("carried", F.lag("end").over(Window.orderBy("blk"))).select("blk", "carried")  # a row for 65,536 lines
    return inside.join(ends, "blk").withColumn("before", F.coalesce("before", "carried")).drop("blk", "carried")


def verify_chain(events: DataFrame) -> DataFrame:
    """``line, link_ok, hash_ok`` of chained lines ``line, format, content, previousEntryHash, entryHash``.

    Links are checked against claimed hashes, so one changed line is one report.
    """
    rows = with_previous(events)
    return rows.select("line", F.col("previousEntryHash").eqNullSafe(F.col("before")).alias("link_ok"), (hashing.chain_hash(F.col("content"), F.col("previousEntryHash")) == F.col("entryHash")).alias("hash_ok"))


def last_hash(events: DataFrame) -> DataFrame:
    return events.where("format <> 'LEGACY'").agg(F.max_by("entryHash", "line").alias("last_hash"))


def chain_health(verified: DataFrame) -> DataFrame:
    bad = ~(F.col("link_ok") & F.col("hash_ok"))
    return verified.agg(F.count(F.lit(1)).alias("chained"), F.count_if(bad).alias("violations"), (F.count_if(bad) == 0).alias("verified"))


def append_events(contents: list[dict], previous: str | None) -> list[dict]:
    """Hash-linked events for a new (small) batch; each hash needs the one before, so this is a fold."""
    out = []
    for content in contents:
        digest = hashing.sha256(f"{hashing.canonical_json(content)}|{previous or 'GENESIS'}")
        out.append({**content, "previousEntryHash": previous, "entryHash": digest})
        previous = digest
    return out


def freeze(candidates: DataFrame, known: DataFrame, lock: dict) -> DataFrame:
    """``refusal`` of each candidate ``draw_id, protocol_hash, ticket``: the first that holds of four, or null."""
    from ..functions import rules

    met = candidates.join(known.select(F.col("id").alias("draw_id"), F.lit(True).alias("known")).distinct(), "draw_id", "left")
    reason = (
        F.when(F.col("protocol_hash") != lock["protocolHash"], "protocol hash has changed")
        .when(rules.evidence(F.col("draw_id"), F.lit(lock.get("startDrawId"))) != "PROSPECTIVE", "draw is not prospective")
        .when(F.coalesce("known", F.lit(False)), "result is already known")
        .when(~rules.is_valid_result(F.col("ticket")), "ticket is not valid")
    )
    return met.withColumn("refusal", reason).drop("known")


def due(pending: DataFrame, table: DataFrame) -> DataFrame:
    """Pending entries whose draw has a result, scored."""
    from ..functions import rules

    met = pending.join(table.select(F.col("id").alias("draw_id"), "result"), "draw_id")
    k = rules.matches(F.col("prediction"), F.col("result"))
    return met.withColumn("matches", k).withColumn("tier", rules.tier(k))


def unrecognised(registry: DataFrame, recognised: DataFrame) -> DataFrame:
    """Registry rows whose protocol hash is neither current nor in the history."""
    bad = registry.join(recognised.select("protocol_hash").distinct(), "protocol_hash", "left_anti")
    return bad.select(F.lit("UNRECOGNISED_PROTOCOL_HASH").alias("kind"), "experiment_id", F.col("protocol_hash").alias("detail"))


def inconsistent(registry: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Up to three violations a pair of registry row and artifact: protocol hash, dataset hash, protocol version."""
    a = artifacts.select("experiment_id", *[F.col(c).alias(f"a_{c}") for c in ("protocol_hash", "dataset_hash", "protocol_version")])
    wrong = lambda c: F.when(~F.col(c).eqNullSafe(F.col(f"a_{c}")), F.struct(F.lit(f"{c.upper()}_MISMATCH").alias("kind"), F.concat_ws(" ", c, f"a_{c}").alias("detail")))
    found = F.filter(F.array(*map(wrong, ("protocol_hash", "dataset_hash", "protocol_version"))), lambda x: x.isNotNull())
    return registry.join(a, "experiment_id").select("experiment_id", F.explode(found).alias("v")).select("v.kind", "experiment_id", "v.detail")


def collisions(files: DataFrame) -> DataFrame:
    """Ids with several contents, and files not named after their id: ``file, experiment_id, content``."""
    several = files.groupBy("experiment_id").agg(F.count_distinct("content").alias("n")).where("n > 1").select(F.lit("ARTIFACT_COLLISION").alias("kind"), "experiment_id", F.col("n").cast("string").alias("detail"))
    named = files.where(F.regexp_extract("file", "([^/]+)[.]json$", 1) != F.col("experiment_id")).select(F.lit("ARTIFACT_NAME").alias("kind"), "experiment_id", F.col("file").alias("detail"))
    return several.unionByName(named)


def triage(violations: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Violations with ``explained`` and the justification of the first exception that names them."""
    keys = ["kind", "experiment_id", "detail"]
    first = exceptions.groupBy(*keys).agg(F.min_by("justification", "line").alias("justification"))
    return violations.join(first, keys, "left").withColumn("explained", F.col("justification").isNotNull())


def audit(registry: DataFrame, recognised: DataFrame, files: DataFrame, ledger: DataFrame, exceptions: DataFrame) -> DataFrame:
    """``severity, kind, experiment_id, detail, justification``: all findings in registry, artifact files and ledger.

    ``files`` has ``file, content, experiment_id, protocol_hash, dataset_hash, protocol_version``; one without an id is no
    artifact.  ``ledger`` has ``line, format, content, previousEntryHash, entryHash``; a line without a format is none.
    Faults of the ledger are FATAL and no exception explains them.  Other findings are OPEN, or EXPLAINED where an
    exception has the same kind, id and detail.  A registry row without an artifact is no finding.
    """
    from . import checks

    read = files.where("experiment_id is not null")
    stated = read.select("experiment_id", "protocol_hash", "dataset_hash", "protocol_version").distinct()
    malformed = files.where("experiment_id is null").select(F.lit("ARTIFACT_MALFORMED").alias("kind"), F.col("file").alias("experiment_id"), F.lit("file is no artifact").alias("detail"))
    found = checks.union([unrecognised(registry, recognised), inconsistent(registry, stated), collisions(read), malformed])
    judged = triage(found, exceptions).select(F.when(F.col("explained"), "EXPLAINED").otherwise("OPEN").alias("severity"), "kind", "experiment_id", "detail", "justification")
    fault = lambda rows, kind: rows.select(F.lit("FATAL").alias("severity"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("experiment_id"), F.col("line").cast("string").alias("detail"), F.lit(None).cast("string").alias("justification"))
    chain = verify_chain(ledger)
    # a claimed hash that is absent is a fault, not unknown
    return checks.union([judged, fault(ledger.where("format is null"), "LEDGER_LINE"), fault(chain.where("not coalesce(link_ok, false)"), "CHAIN_LINK"), fault(chain.where("not coalesce(hash_ok, false)"), "CHAIN_HASH")])


def audit_status(findings: DataFrame) -> DataFrame:
    n = lambda x: F.count_if(F.col("severity") == x)
    return findings.agg(n("FATAL").alias("fatal"), n("OPEN").alias("unexplained"), n("EXPLAINED").alias("acknowledged"), (n("FATAL") + n("OPEN") == 0).alias("ok"))


def family_counts(registry: DataFrame) -> DataFrame:
    """``family_id, experiments, hypotheses, looks, holm_family``: looks are distinct data sets, one at least."""
    hypothesis = F.coalesce(F.nullif(F.trim("hypothesis_id"), F.lit("")), F.col("strategy_id"))
    out = registry.groupBy("family_id").agg(F.count_distinct("experiment_id").alias("experiments"), F.count_distinct(hypothesis).alias("hypotheses"), F.greatest(F.count_distinct("dataset_hash"), F.lit(1)).alias("looks"))
    return out.withColumn("holm_family", F.coalesce(F.nullif(F.col("hypotheses"), F.lit(0).cast("long")), F.lit(3)))


def append_history(history: DataFrame, entry: DataFrame) -> DataFrame:
    """Insert where the hash is new."""
    return history.unionByName(entry.join(history.select("protocol_hash"), "protocol_hash", "left_anti").select(*history.columns))


def hash_conflict(registry: DataFrame, experiment_id: str, protocol_hash: str) -> DataFrame:
    return registry.where((F.col("experiment_id") == experiment_id) & (F.col("protocol_hash") != protocol_hash)).limit(1)


def experiment_id(family: str, strategy: str, dataset_hash: str, protocol_hash: str) -> str:
    return f"{family}-{strategy.lower()}-{dataset_hash[:8]}-{protocol_hash[:8]}"


def transition(registry: DataFrame, experiment: str, status: str) -> DataFrame:
    return registry.withColumn("status", F.when(F.col("experiment_id") == experiment, status).otherwise(F.col("status")))


def calibration(pairs: DataFrame, buckets: int = 10) -> DataFrame:
    """``n, brier, ece`` of ``predicted, outcome``: bucket by clamped score, averages of the scores as they are."""
    clamped = F.least(F.greatest("predicted", F.lit(0.0)), F.lit(1.0))
    b = F.least(F.floor(clamped * buckets), F.lit(buckets - 1).cast("long"))
    each = pairs.withColumn("bucket", b).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("predicted").alias("p"), F.avg("outcome").alias("o"), F.sum((F.col("predicted") - F.col("outcome")) ** 2).alias("sq"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("sq") / F.sum("n"), F.lit(0.0)).alias("brier"), F.coalesce(F.sum(F.col("n") * F.abs(F.col("p") - F.col("o"))) / F.sum("n"), F.lit(0.0)).alias("ece"))


def promotion(report: DataFrame, least: int, brier: float, ece: float) -> DataFrame:
    return report.withColumn("promoted", (F.col("n") >= least) & (F.col("brier") <= brier) & (F.col("ece") <= ece))
