"""Column expressions of the 6-of-45 rules: validity, matches, tiers, prizes, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The game's shape and prizes.
POOL, PICKS = 45, 6
TICKET_PRICE = 10_000
PRIZES = {3: 30_000, 4: 300_000, 5: 10_000_000}
ROBUST_CAP = 300_000
TIERS = {6: "JACKPOT", 5: "FIRST", 4: "SECOND", 3: "THIRD"}
WINDOW_DAYS = {"30D": 30, "90D": 90, "365D": 365}


def matches(ticket: Column, result: Column) -> Column:
    """Size of the intersection."""
    return F.size(F.array_intersect(ticket, result))


def matched_numbers(ticket: Column, result: Column) -> Column:
    """The ticket's numbers that were drawn, in the ticket's order."""
    return F.filter(ticket, lambda n: F.array_contains(result, n))


def tier(k: Column) -> Column:
    out = F.lit("NONE")
    for n, name in TIERS.items():
        out = F.when(k == n, name).otherwise(out)
    return out


def payout(k: Column) -> Column:
    """Null for the jackpot, whose prize varies."""
    out = F.when(k == 6, F.lit(None).cast("long")).otherwise(F.lit(0).cast("long"))
    for n, prize in PRIZES.items():
        out = F.when(k == n, F.lit(prize).cast("long")).otherwise(out)
    return out


def is_calendar_date(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.expr("true"), F.lit(False)) & text.try_cast("date").isNotNull()


def result_problem(result: Column, count: int = PICKS, highest: int = POOL) -> Column:
    """First problem of an ``array<string>`` of JSON values, or null; ``"6"`` in quotes is no integer."""
    number = lambda x: x.try_cast("double")
    return (
        F.when(result.isNull(), "result is not a list")
        .when(F.size(result) != count, "result has the wrong length")
        .when(F.exists(result, lambda x: x.isNull() | ~x.rlike("^-?[0-9]+([.]0+)?$")), "result has a value that is no integer")
        .when(F.exists(result, lambda x: (number(x) < 1) | (number(x) > highest)), "result has a value out of range")
        .when(F.size(F.array_distinct(result)) != count, "result repeats a number")
    )


def is_valid_result(result: Column, count: int = PICKS, highest: int = POOL) -> Column:
    """For ``array<int>``: ``count`` distinct numbers in 1 .. highest."""
    return F.coalesce((F.size(result) == count) & F.forall(result, lambda x: x.between(1, highest)) & (F.size(F.array_distinct(result)) == count), F.lit(False))


def evaluated(ticket: Column, result: Column) -> Column:
    """``struct<matches, matched, tier, payout>``; six distinct numbers in 1 .. 45 on both sides, or an error."""
    ok = is_valid_result(ticket) & is_valid_result(result)
    checked = F.when(ok, ticket).otherwise(F.raise_error(F.concat(F.lit("no valid ticket or result: "), F.coalesce(F.to_json(F.struct(ticket.alias("ticket"), result.alias("result"))), F.lit("")))).cast("array<int>"))
    k = matches(checked, result)
    return F.struct(k.alias("matches"), matched_numbers(checked, result).alias("matched"), tier(k).alias("tier"), payout(k).alias("payout"))


def next_id(draw_id: Column) -> Column:
    """One more, at least as wide; null if it is no number."""
    number = F.when(draw_id.rlike("^[0-9]+$"), draw_id.try_cast("bigint") + 1)
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(draw_id), F.length(text)), F.lit("0"))


def seed_of(draw_id: Column, t: Column) -> Column:
    """The digits of the id, or the position where there are none (or only zeros)."""
    return F.coalesce(F.nullif(F.regexp_replace(draw_id, "[^0-9]", "").try_cast("bigint"), F.lit(0).cast("bigint")), t.cast("bigint"))


def frequency_tone(delta_percent: Column) -> Column:
    return F.when(delta_percent > 8, "hot").when(delta_percent < -8, "cold").otherwise("neutral")


def evidence(draw_id: Column, start_id: Column) -> Column:
    """PROSPECTIVE from the lock's first id on; without one all is RETROSPECTIVE."""
    return F.when(start_id.isNotNull() & (draw_id.try_cast("bigint") >= start_id.try_cast("bigint")), "PROSPECTIVE").otherwise("RETROSPECTIVE")


def freshness(last_sync_ms: Column, now_ms: Column, fresh_ms: int = 12 * 3_600_000, stale_ms: int = 7 * 86_400_000) -> Column:
    age = F.greatest(now_ms - last_sync_ms, F.lit(0))
    return F.when(last_sync_ms.isNull(), "Unknown").when(age <= fresh_ms, "Fresh").when(age <= stale_ms, "Delayed").otherwise("Stale")


def should_refresh(last_sync_ms: Column, now_ms: Column, ttl_ms: int = 12 * 3_600_000) -> Column:
    return F.when(last_sync_ms.isNull(), True).otherwise(now_ms - last_sync_ms >= ttl_ms)


def ball(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def format_tickets(tickets: Column) -> Column:
    """``01: 02 11 ...`` a line for an ``array<array<int>>``."""
    return F.array_join(F.transform(tickets, lambda t, i: F.concat(F.lpad((i + 1).cast("string"), 2, "0"), F.lit(": "), F.array_join(F.transform(t, ball), " "))), "\n")


def format_vnd(amount: Column) -> Column:
    return F.concat(F.translate(F.format_number(amount, 0), ",", "."), F.lit(" ₫"))


def format_percent(value: Column, digits: int = 1) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", value), F.lit("%"))
