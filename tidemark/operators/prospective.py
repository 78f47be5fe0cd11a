"""Predictions frozen before a draw and scored after it: chained events, scoring, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, rules
from ..sources.shapes import blank, has_kind, json_value, no_time, one_of

STRATEGIES = ("RANDOM", "HOT", "COLD", "BALANCED")
TIERS = (*rules.TIERS.values(), "NONE")


def unfrozen(candidates: DataFrame, entries: DataFrame) -> DataFrame:
    """Candidates without an entry for their draw and strategy."""
    return candidates.join(entries.select("draw_id", "strategy_id").distinct(), ["draw_id", "strategy_id"], "left_anti")


def with_results(entries: DataFrame, results: DataFrame) -> DataFrame:
    """Entries of a draw in ``results`` (``draw_id, result``) without a result get one and its score; others stay as they are."""
    met = entries.join(results.select("draw_id", F.col("result").alias("_drawn")), "draw_id", "left")
    fresh = F.col("result").isNull() & F.col("_drawn").isNotNull()
    k = rules.matches(F.col("prediction"), F.col("_drawn"))
    return met.select(*[c for c in entries.columns if c not in ("result", "matches", "tier")], F.when(fresh, F.col("_drawn")).otherwise(F.col("result")).alias("result"), F.when(fresh, k).otherwise(F.col("matches")).alias("matches"), F.when(fresh, rules.tier(k)).otherwise(F.col("tier")).alias("tier"))


def summary_entries(entries: DataFrame) -> DataFrame:
    """Newest freeze first."""
    state = F.when(F.col("result").isNull(), "PENDING").otherwise("SCORED")
    return entries.select("draw_id", "strategy_id", "frozen_at", state.alias("status"), "matches", "tier").orderBy(F.desc("frozen_at"), "draw_id", "strategy_id")


def counts(entries: DataFrame) -> DataFrame:
    pending = F.col("result").isNull()
    return entries.agg(F.count(F.lit(1)).alias("total_frozen"), F.count_if(pending).alias("pending"), F.count_if(~pending).alias("scored"))


def frozen_event(entry: dict, previous: str | None) -> dict:
    """The chained event of an entry (``drawId, frozenAt, protocolHash, datasetHashAtFreeze, strategyId, prediction``)."""
    own = {"drawId": entry["drawId"], "strategyId": entry["strategyId"], "frozenAt": entry["frozenAt"]}
    content = {"kind": "FROZEN", "entryId": hashing.canonical_hash(own), **entry, "prediction": sorted(entry["prediction"]), "result": None, "matches": None, "tier": None}
    return _linked(content, previous)


def scored_event(frozen: dict, result: list[int], scored_at: str, previous: str | None) -> dict:
    """The chained score of a frozen event; tickets and results that are not six distinct numbers in 1 .. 45 are errors."""
    for ticket in (frozen["prediction"], result):
        if len(set(ticket)) != rules.PICKS or len(ticket) != rules.PICKS or not all(isinstance(n, int) and 1 <= n <= rules.POOL for n in ticket):
            raise ValueError(f"no valid ticket: {ticket}")
    k = len(set(frozen["prediction"]) & set(result))
    content = {"kind": "SCORED", "entryId": frozen["entryId"], "drawId": frozen["drawId"], "strategyId": frozen["strategyId"], "scoredAt": scored_at, "result": list(result), "matches": k, "tier": rules.TIERS.get(k, "NONE")}
    return _linked(content, previous)


def _linked(content: dict, previous: str | None) -> dict:
    return {**content, "previousEntryHash": previous, "entryHash": hashing.sha256(f"{hashing.canonical_json(content)}|{previous or 'GENESIS'}")}


def _ticket_problem(v: Column, path: str) -> Column:
    numbers = F.try_variant_get(v, path, "array<int>")
    return ~(has_kind(v, path, "ARRAY") & rules.is_valid_result(numbers) & F.coalesce(F.exists(F.try_variant_get(v, path, "array<variant>"), lambda x: ~F.schema_of_variant(x).isin("BIGINT", "INT", "SMALLINT", "TINYINT")) == F.lit(False), F.lit(False)))


def entry_problem(v: Column) -> Column:
    """First problem of a full entry in a variant column, or null."""
    is_null = lambda path: has_kind(v, path, "VOID")
    matches = F.try_variant_get(v, "$.matches", "int")
    unscored = is_null("$.matches") | is_null("$.tier")
    return F.coalesce(
        F.when(~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "entry is no object"),
        blank(v, "drawId"), no_time(v, "frozenAt"), blank(v, "protocolHash"), blank(v, "datasetHashAtFreeze"), one_of(v, "strategyId", STRATEGIES),
        F.when(_ticket_problem(v, "$.prediction"), "prediction is no ticket"),
        F.when(~is_null("$.result") & _ticket_problem(v, "$.result"), "result is no ticket"),
        F.when(~is_null("$.matches") & ~F.coalesce(matches.between(0, rules.PICKS), F.lit(False)), "matches is out of range"),
        F.when(~is_null("$.tier") & one_of(v, "tier", TIERS).isNotNull(), "tier is unknown"),
        F.when(is_null("$.result") != unscored, "result and score do not go together"),
    )


def _chain_problem(v: Column) -> Column:
    return F.coalesce(blank(v, "entryId"), F.when(~has_kind(v, "$.previousEntryHash", "VOID", "STRING"), "previousEntryHash is no text"), blank(v, "entryHash"))


def frozen_problem(v: Column) -> Column:
    return F.coalesce(entry_problem(v), F.when(~has_kind(v, "$.result", "VOID"), "a frozen event has a result"), _chain_problem(v))


def scored_problem(v: Column) -> Column:
    return F.coalesce(
        _chain_problem(v), blank(v, "drawId"), one_of(v, "strategyId", STRATEGIES), no_time(v, "scoredAt"),
        F.when(_ticket_problem(v, "$.result"), "result is no ticket"),
        F.when(~F.coalesce(F.try_variant_get(v, "$.matches", "int").between(0, rules.PICKS), F.lit(False)), "matches is out of range"), one_of(v, "tier", TIERS),
    )


def ledger_problems(lines: DataFrame) -> DataFrame:
    """``line, format, problem`` of ledger lines (``line, value``), a line without a kind being a full entry."""
    v = json_value("value")
    kind = F.try_variant_get(v, "$.kind", "string")
    problem = F.when(v.isNull(), "line is not JSON").when(kind.isNull(), entry_problem(v)).when(kind == "FROZEN", frozen_problem(v)).when(kind == "SCORED", scored_problem(v)).otherwise("unknown kind")
    return lines.select("line", F.when(kind.isin("FROZEN", "SCORED"), kind).when(v.isNotNull() & kind.isNull(), "LEGACY").alias("format"), problem.alias("problem"))
