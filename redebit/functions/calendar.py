"""Calendar, rail-window and band expressions.

All of them work on epoch seconds, so they do not depend on the session time zone
and stay inside whole-stage code generation. India has no daylight saving, so the
local clock is UTC plus a constant.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IST_OFFSET_SECONDS = 19_800
DAY = 86_400

# Rail names, budgets, notice lead and settlement latency.
UPI, CARD, ENACH = "upi_autopay", "card_emandate", "enach"
RAILS = [
    # rail, attempt_budget, notice_lead_hours, outcome_latency_days, rail_code
    (UPI, 4, 24, 0, 0),
    (CARD, 4, 24, 0, 1),
    (ENACH, 3, 24, 1, 2),
]

PDN_CUTOFF_MINUTE = 23 * 60 + 50
CONTACT_OPEN_HOUR, CONTACT_CLOSE_HOUR = 8, 19

# Upper edges of the hour bands (IST minutes) and ticket bands (paise).
HOUR_BAND_EDGES = (600, 780, 1020, 1290)
TICKET_BAND_EDGES = (100_000, 500_000, 1_500_000, 10_000_000)
BAND_MIDPOINT_MINUTE = (300, 690, 900, 1155, 1365)


def epoch(ts: Column) -> Column:
    return F.unix_seconds(ts)


def ist_seconds(ts: Column) -> Column:
    return epoch(ts) + F.lit(IST_OFFSET_SECONDS)


def minute_of_day(ts: Column) -> Column:
    """IST minute of the day, 0..1439."""
    return F.floor(F.pmod(ist_seconds(ts), F.lit(DAY)) / 60).cast("int")


def hour_ist(ts: Column) -> Column:
    """Fractional IST hour; seconds are ignored."""
    return minute_of_day(ts) / F.lit(60.0)


def ist_day_number(ts: Column) -> Column:
    """IST calendar day as days since 1970-01-01."""
    return F.floor(ist_seconds(ts) / DAY).cast("int")


def date_ist(ts: Column) -> Column:
    return F.date_from_unix_date(ist_day_number(ts))


def day_of_month_ist(ts: Column) -> Column:
    return F.dayofmonth(date_ist(ts))


def weekday_ist(ts: Column) -> Column:
    """Monday = 0."""
    return F.pmod(ist_day_number(ts) + 3, F.lit(7))


def band_of(value: Column, edges: tuple[int, ...]) -> Column:
    """Half-open banding: index of the first edge above ``value``; NULL stays NULL."""
    out = F.when(value < edges[0], 0)
    for index, edge in enumerate(edges[1:], start=1):
        out = out.when(value < edge, index)
    return out.when(value >= edges[-1], len(edges))


def hour_band(ts: Column) -> Column:
    return band_of(minute_of_day(ts), HOUR_BAND_EDGES)


def ticket_band(paise: Column) -> Column:
    return band_of(paise, TICKET_BAND_EDGES)


def is_execution_legal(rail: Column, ts: Column) -> Column:
    """May a debit execute at this instant, on window grounds alone?"""
    minute = minute_of_day(ts)
    upi = (minute < 600) | ((minute >= 780) & (minute < 1020)) | (minute >= 1290)
    clearing = (weekday_ist(ts) < 5) & (minute < 780)
    return F.when(rail == UPI, upi).when(rail == CARD, F.lit(True)).when(rail == ENACH, clearing)


def is_pdn_send_legal(rail: Column, send_at: Column, debit_at: Column) -> Column:
    """23:50 IST submission cut-off for a debit on the next calendar day (UPI only)."""
    late = minute_of_day(send_at) >= PDN_CUTOFF_MINUTE
    next_day = ist_day_number(debit_at) == ist_day_number(send_at) + 1
    return F.when(rail == UPI, ~(late & next_day)).otherwise(F.lit(True))


def _per_rail(rail: Column, position: int) -> Column:
    out = None
    for row in RAILS:
        hit = F.lit(row[position])
        out = F.when(rail == row[0], hit) if out is None else out.when(rail == row[0], hit)
    return out


def attempt_budget(rail: Column) -> Column:
    return _per_rail(rail, 1)


def notice_lead_hours(rail: Column) -> Column:
    return _per_rail(rail, 2)


def outcome_latency_days(rail: Column) -> Column:
    return _per_rail(rail, 3)


def rail_code(rail: Column) -> Column:
    return F.coalesce(_per_rail(rail, 4), F.lit(-1))


def add_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + seconds.cast("long") * F.lit(1_000_000))


def outcome_due_at(rail: Column, presented_at: Column) -> Column:
    """Next clearing weekday for the batch rail; immediate elsewhere."""
    weekday = weekday_ist(presented_at)
    days = F.when(rail != ENACH, 0).when(weekday == 4, 3).when(weekday == 5, 2).otherwise(1)
    return add_seconds(presented_at, days * F.lit(DAY))


def is_contact_hour(ts: Column) -> Column:
    minute = minute_of_day(ts)
    return (minute >= CONTACT_OPEN_HOUR * 60) & (minute < CONTACT_CLOSE_HOUR * 60)


def window_start(ts: Column, seconds: int) -> Column:
    """Epoch-aligned tumbling bucket."""
    return F.timestamp_seconds(epoch(ts) - F.pmod(epoch(ts), F.lit(seconds)))


def at_ist_hour(ts: Column, days: Column, minute_of_day_ist: Column) -> Column:
    """The instant ``days`` IST days after ``ts``'s day, at the given IST minute."""
    return F.timestamp_seconds(
        (ist_day_number(ts) + days).cast("long") * F.lit(DAY)
        + minute_of_day_ist.cast("long") * 60
        - F.lit(IST_OFFSET_SECONDS)
    )
