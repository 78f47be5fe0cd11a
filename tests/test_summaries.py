"""The four published summaries: read as they are, refused with any one field broken or gone."""

from __future__ import annotations

import copy
import json

import pytest

from tidemark.sources import summaries

PHASE = {"originalAdjustedPValue": 0.2, "ablatedAdjustedPValue": 0.1, "originalSignificant": False, "ablatedSignificant": True, "newlySignificantAfterAblation": True}
SLICE = {"n": 10, "meanK": 2.4, "hit6Count": 0, "hit6Rate": 0.0}
GOOD = {
    "ablation": {
        "schemaVersion": 1, "generatedAt": "2026-01-01", "datasetHash": "d", "datasetRecordCount": 10, "lookback": 90, "alpha": 0.05, "fullFamilySize": 3, "deterministic": True, "honestNote": "n",
        "rows": [{"removed": r, "fullFamilySize": 3, "ablatedFamilySize": 2, "verdict": "v", "anyNewlySignificant": False, "deltas": [{"strategy": "COLD", "validation": PHASE, "test": PHASE}]} for r in ("HOT", "BALANCED")],
    },
    "portfolio": {
        "schemaVersion": 1, "generatedAt": "2026-01-01", "honestNote": "n",
        "rows": [{"ticketCount": 5, "simulationCount": 3000, "seed": 645, "portfolioSeed": 645, "projectiveMeanBestMatch": 2.1, "randomMeanBestMatch": 2.0, "meanBestMatchDelta": 0.1, "projectiveHitAtLeast4Rate": 0.01, "randomHitAtLeast4Rate": 0.01, "projectiveHitAtLeast5Rate": 0.0, "randomHitAtLeast5Rate": 0}],
    },
    "prospective": {
        "generatedAt": "2026-01-01", "totalFrozen": 2.7, "pendingCount": 1, "scoredCount": 1, "chainHealth": {"chainedCount": 3, "legacyCount": 0, "verified": True, "violationCount": 0},
        "entries": [{"drawId": "01562", "strategyId": "HOT", "frozenAt": "t", "status": "SCORED", "matches": 3, "tier": "THIRD"}, {"drawId": "01563", "strategyId": "COLD", "frozenAt": "t", "status": "PENDING", "matches": None, "tier": None}],
    },
    "pool": {
        "schemaVersion": 1, "generatedAt": "2026-01-01", "sourceReportFile": "f", "datasetRecordCount": 10, "firstDrawId": "1", "latestDrawId": "9",
        "math": {"totalCombinations": 8145060, "bao18Tickets": 18564, "ticketPrice": 10000, "bao18CostPerDraw": 185640000, "nullJackpotProbability": 0.0022},
        "protocolA": {"evaluatedDraws": 10, "hit6Count": 0, "hit6Rate": 0, "sourceVerdict": "v"},
        "protocolB": {"evaluatedCount": 10, "rules": [{"rule": "HOT18", "isBaseline": False, "n": 10, "hit6Count": 0, "hit6Rate": 0, "expectedNullHits": 0.02, "rawPValue": 1, "adjustedPValue": 1, "meanIntersection": 2.4, "hit4PlusRate": 0.1, "hit5PlusRate": 0, "verdict": "NO_EDGE", "reasons": ["r"], "early": SLICE, "late": SLICE}]},
        "nullCalibration": {"nullExpectedCount": 0.02, "nullProbZeroHits": 0.98, "nullPredictiveInterval95": [0, 1], "underpowered": True},
        "finalVerdict": "v", "scientificGrade": "g", "scientificSpecHash": "s", "buildProvenance": {"generatedAt": "t", "gitHeadShort": "abc"},
    },
}
NULLABLE = {"datasetHash", "matches", "tier", "pool.datasetRecordCount", "firstDrawId", "latestDrawId", "math", "protocolA", "evaluatedCount", "rawPValue", "adjustedPValue", "pool.verdict", "early", "late", "nullCalibration", "nullPredictiveInterval95", "scientificSpecHash", "buildProvenance", "gitHeadShort"}
OPTIONAL = {"early", "late", "scientificSpecHash", "buildProvenance", "isBaseline"}


def places(value, path=()):
    """Paths of everything inside."""
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for k, v in items:
        yield (*path, k), v
        yield from places(v, (*path, k))


def changed(value, path, new=None, drop=False):
    out = copy.deepcopy(value)
    at = out
    for k in path[:-1]:
        at = at[k]
    if drop:
        del at[path[-1]]
    else:
        at[path[-1]] = new
    return json.dumps(out)


@pytest.mark.parametrize("shape", GOOD)
def test_one_broken_field_breaks_the_summary(spark, shape):
    good = GOOD[shape]
    cases = [(json.dumps(good), True), (json.dumps({**good, "more": {"x": 1}}), True), ("{", False), ("[]", False), ("7", False), ("null", False)]
    for path, v in places(good):
        name = str(path[-1]) if not isinstance(path[-1], int) else None
        wrong = "x" if not isinstance(v, str) else 7
        if name == "isBaseline":
            cases.append((changed(good, path, wrong), True))
        else:
            cases.append((changed(good, path, wrong), False))
        if name:
            free = name in NULLABLE or f"{shape}.{name}" in NULLABLE
            cases.append((changed(good, path, None), free or name == "isBaseline"))
            cases.append((changed(good, path, drop=True), name in OPTIONAL))
    if shape == "prospective":
        cases += [(changed(good, ("pendingCount",), -1), False), (changed(good, ("entries", 0, "matches"), 2.5), False), (changed(good, ("entries", 0, "drawId"), ""), False), (changed(good, ("entries",), []), True)]
    if shape == "pool":
        cases += [(changed(good, ("nullCalibration", "nullPredictiveInterval95"), [1]), False), (changed(good, ("protocolB", "rules", 0, "reasons"), []), True), (changed(good, ("schemaVersion",), 2), False)]
    if shape == "ablation":
        cases += [(changed(good, ("deterministic",), False), False), (changed(good, ("honestNote",), ""), False), (changed(good, ("rows", 1, "removed"), "RANDOM"), False)]
    table = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, value string")
    got = {r["i"]: r for r in summaries.read(table, shape).collect()}
    for i, (value, ok) in enumerate(cases):
        assert (got[i]["problem"] is None) == ok == (got[i]["summary"] is not None), (value, got[i]["problem"])
    read = got[0]["summary"].asDict(recursive=True)
    want = copy.deepcopy(good)
    if shape == "prospective":
        want["totalFrozen"] = 2
    assert read == want
    assert all("$" in r["problem"] for r in got.values() if r["problem"] and r["problem"] != "not JSON")
