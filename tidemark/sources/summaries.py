"""Published summaries of four kinds: shapes of nested JSON, checked field by field and read only as a whole.

A rule says what a value must be and what it is read as; rules nest.  ``problem`` gives the first
thing wrong in a variant column, with its path, or null; ``read`` gives the typed value, or null
where anything is wrong.  Fields that no rule names are let be.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..operators.prospective import STRATEGIES
from .shapes import NUMBER, json_value


@dataclass(frozen=True)
class Rule:
    """``wrong(v, path)`` is a problem or null; ``value(v)`` what a right value is read as."""

    wrong: Callable[[Column, str], Column]
    value: Callable[[Column], Column]


def _kind(v: Column, *kinds: str) -> Column:
    found = F.schema_of_variant(v)
    out = F.lit(False)
    for k in kinds:
        out = out | found.startswith(k)
    return F.coalesce(out, F.lit(False))


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _unless(ok: Column, path: str, what: str) -> Column:
    return F.when(~F.coalesce(ok, F.lit(False)), f"{path} {what}")


def text(blank: bool = True) -> Rule:
    ok = lambda v: _kind(v, "STRING") & (F.lit(blank) | (_as(v, "string") != ""))
    return Rule(lambda v, p: _unless(ok(v), p, "is no text" if blank else "is missing or blank"), lambda v: _as(v, "string"))


def number(least: float | None = None, whole: bool = False, floor: bool = False) -> Rule:
    """A finite number; ``whole`` ones are read as integers, and with ``floor`` any number is rounded down to one."""

    def ok(v: Column) -> Column:
        x = _as(v, "double")
        out = _kind(v, *NUMBER) & ~F.isnan(x) & (F.abs(x) < float("inf"))
        out = out & (x >= least) if least is not None else out
        return out & (x == F.floor(x)) if whole else out

    return Rule(lambda v, p: _unless(ok(v), p, "is no whole number" if whole else "is no number" if least is None else f"is no number from {least:g} on"), lambda v: F.floor(_as(v, "double")).cast("long") if whole or floor else _as(v, "double"))


def flag() -> Rule:
    return Rule(lambda v, p: _unless(_kind(v, "BOOLEAN"), p, "is no boolean"), lambda v: _as(v, "boolean"))


def truth() -> Rule:
    """JavaScript's truth of whatever there is; a missing value is false."""
    filled = lambda v: F.when(_kind(v, "BOOLEAN"), _as(v, "boolean")).when(_kind(v, "STRING"), _as(v, "string") != "").when(_kind(v, *NUMBER), _as(v, "double") != 0)
    return Rule(lambda v, p: F.lit(None).cast("string"), lambda v: F.coalesce(filled(v), _kind(v, "OBJECT", "ARRAY")))


def always(x: object) -> Rule:
    if isinstance(x, bool):
        return Rule(lambda v, p: _unless(_kind(v, "BOOLEAN") & (_as(v, "boolean") == x), p, f"is not {str(x).lower()}"), lambda v: F.lit(x))
    return Rule(lambda v, p: _unless(_kind(v, *NUMBER) & (_as(v, "double") == x), p, f"is not {x}"), lambda v: F.lit(x).cast("long"))


def one_of(*values: str) -> Rule:
    return Rule(lambda v, p: _unless(_kind(v, "STRING") & _as(v, "string").isin(*values), p, "is unknown"), lambda v: _as(v, "string"))


def nullable(rule: Rule, optional: bool = False) -> Rule:
    """The rule's value or null; a missing one only if ``optional``."""
    void = lambda v: (_kind(v, "VOID") | v.isNull()) if optional else _kind(v, "VOID")
    return Rule(lambda v, p: F.when(~void(v), rule.wrong(v, p)), lambda v: F.when(~void(v), rule.value(v)))


def record(**fields: Rule) -> Rule:
    part = lambda v, name: F.try_variant_get(v, f"$.{name}", "variant")
    return Rule(
        lambda v, p: F.coalesce(_unless(_kind(v, "OBJECT"), p, "is no object"), *[r.wrong(part(v, n), f"{p}.{n}") for n, r in fields.items()]),
        lambda v: F.struct(*[r.value(part(v, n)).alias(n) for n, r in fields.items()]),
    )


def each(rule: Rule, size: int | None = None) -> Rule:
    items = lambda v: _as(v, "array<variant>")

    def wrong(v: Column, p: str) -> Column:
        ok = _kind(v, "ARRAY") & (F.size(items(v)) == size) if size is not None else _kind(v, "ARRAY")
        inside = F.filter(F.transform(items(v), lambda x: rule.wrong(x, f"{p}[]")), lambda x: x.isNotNull())
        return F.coalesce(_unless(ok, p, "is no list" if size is None else f"is no list of {size}"), F.get(inside, F.lit(0)))

    return Rule(wrong, lambda v: F.transform(items(v), rule.value))


#: The fields of the four summaries, and what they may be.
_PHASE = record(originalAdjustedPValue=number(), ablatedAdjustedPValue=number(), originalSignificant=flag(), ablatedSignificant=flag(), newlySignificantAfterAblation=flag())
_RULES = one_of("HOT", "COLD", "BALANCED")
ABLATION = record(
    schemaVersion=always(1), generatedAt=text(), datasetHash=nullable(text()), datasetRecordCount=number(), lookback=number(), alpha=number(), fullFamilySize=number(), deterministic=always(True),
    rows=each(record(removed=_RULES, fullFamilySize=number(), ablatedFamilySize=number(), verdict=text(), anyNewlySignificant=flag(), deltas=each(record(strategy=_RULES, validation=_PHASE, test=_PHASE)))),
    honestNote=text(blank=False),
)
PORTFOLIO = record(
    schemaVersion=always(1), generatedAt=text(),
    rows=each(record(
        ticketCount=number(), simulationCount=number(), seed=number(), portfolioSeed=number(), projectiveMeanBestMatch=number(), randomMeanBestMatch=number(), meanBestMatchDelta=number(),
        projectiveHitAtLeast4Rate=number(), randomHitAtLeast4Rate=number(), projectiveHitAtLeast5Rate=number(), randomHitAtLeast5Rate=number(),
    )),
    honestNote=text(blank=False),
)
_COUNT = number(least=0, floor=True)
PROSPECTIVE = record(
    generatedAt=text(), totalFrozen=_COUNT, pendingCount=_COUNT, scoredCount=_COUNT,
    entries=each(record(drawId=text(blank=False), strategyId=one_of(*STRATEGIES), frozenAt=text(), status=one_of("PENDING", "SCORED"), matches=nullable(number(whole=True)), tier=nullable(one_of(*rules.TIERS.values(), "NONE")))),
    chainHealth=record(chainedCount=_COUNT, legacyCount=_COUNT, verified=flag(), violationCount=_COUNT),
)
_SLICE = nullable(record(n=number(), meanK=number(), hit6Count=number(), hit6Rate=number()), optional=True)
POOL = record(
    schemaVersion=always(1), generatedAt=text(), sourceReportFile=text(), datasetRecordCount=nullable(number()), firstDrawId=nullable(text()), latestDrawId=nullable(text()),
    math=nullable(record(totalCombinations=number(), bao18Tickets=number(), ticketPrice=number(), bao18CostPerDraw=number(), nullJackpotProbability=number())),
    protocolA=nullable(record(evaluatedDraws=number(), hit6Count=number(), hit6Rate=number(), sourceVerdict=text())),
    protocolB=record(evaluatedCount=nullable(number()), rules=each(record(
        rule=one_of("RANDOM18", "HOT18", "COLD18", "OVERDUE18", "BALANCED18"), isBaseline=truth(), n=number(), hit6Count=number(), hit6Rate=number(), expectedNullHits=number(), rawPValue=nullable(number()), adjustedPValue=nullable(number()),
        meanIntersection=number(), hit4PlusRate=number(), hit5PlusRate=number(), verdict=nullable(text()), reasons=each(text()), early=_SLICE, late=_SLICE,
    ))),
    nullCalibration=nullable(record(nullExpectedCount=number(), nullProbZeroHits=number(), nullPredictiveInterval95=nullable(each(number(), 2)), underpowered=flag())),
    finalVerdict=text(), scientificGrade=text(), scientificSpecHash=nullable(text(), optional=True), buildProvenance=nullable(record(generatedAt=text(), gitHeadShort=nullable(text())), optional=True),
)
SHAPES = {"ablation": ABLATION, "portfolio": PORTFOLIO, "prospective": PROSPECTIVE, "pool": POOL}


def read(documents: DataFrame, shape: str) -> DataFrame:
    """The columns of ``documents`` (``value``: JSON text) with ``problem`` and ``summary``, of which one is null: a broken summary is not half believed."""
    rule = SHAPES[shape]
    rows = documents.withColumn("_v", json_value("value"))
    rows = rows.withColumn("problem", F.when(F.col("_v").isNull(), "not JSON").otherwise(rule.wrong(F.col("_v"), "$")))
    return rows.withColumn("summary", F.when(F.col("problem").isNull(), rule.value(F.col("_v")))).drop("_v")
