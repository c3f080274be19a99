"""Which hours of a cycle may be debited, and when notices may be sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redebit.functions import calendar as cal

HOUR = 3600
DUNNING_HOURS = 168  # the week that replayed policies cover
PLAN_HOURS = 720  # the horizon of planning: a monthly cycle
MIN_NOTICE_HOURS, MAX_NOTICE_HOURS = 24, 96
# The widely used retry schedule, days after the failure.
BASELINE_DAYS = (1, 3, 5)
CONTROL_MINUTE_IST = 9 * 60
REASONS = (
    "outside rail execution window",
    "inside the notice lead time",
    "no lawful notice instant",
    "at or beyond the cycle deadline",
)


def slot_time(anchor: Column, slot: Column) -> Column:
    return cal.add_seconds(anchor, slot.cast("long") * HOUR)


def explode_slots(cycles: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """One row per hourly slot.

    The cycles are hash-distributed by ``keys`` first: exploding keeps that distribution,
    so every later window per cycle sorts in place and only whole cycles ever move. The number of
    partitions is stated: cycles are small before they are exploded, and adaptive execution
    would merge them into a few tasks that then hold ``horizon`` times as much.
    """
    partitions = int(cycles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cycles.repartition(partitions, *keys).select("*", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("slot"))


def legality_columns(rail: Column, decided_at: Column, deadline_at: Column, slot: Column) -> dict[str, Column]:
    at = slot_time(decided_at, slot)
    lead = cal.notice_lead_hours(rail)
    latest_send = slot_time(decided_at, slot - lead)
    return {
        "in_window": cal.is_execution_legal(rail, at),
        "notice_lead": slot >= lead,
        "pdn_cutoff": (slot >= lead)
        & (cal.is_pdn_send_legal(rail, latest_send, at) | cal.is_pdn_send_legal(rail, decided_at, at)),
        "before_deadline": at < deadline_at,
    }


def legality_mask(slots: DataFrame) -> DataFrame:
    """Each constraint as its own column, the conjunction, and the reasons for exclusion."""
    checks = legality_columns(F.col("rail"), F.col("decided_at"), F.col("deadline_at"), F.col("slot"))
    out = slots.select("*", *[c.alias(n) for n, c in checks.items()])
    names = list(checks)
    legal = F.col(names[0]) & F.col(names[1]) & F.col(names[2]) & F.col(names[3])
    reasons = F.array_compact(
        F.array(*[F.when(~F.col(n), F.lit(r)) for n, r in zip(names, REASONS, strict=True)])
    )
    return out.withColumn("legal", legal).withColumn("reasons", reasons)


def first_contact_hour(decided_at: Column) -> Column:
    """Hours from the decision to the first contact hour (0 when already inside it)."""
    minute = cal.minute_of_day(decided_at)
    opens, closes = cal.CONTACT_OPEN_HOUR * 60, cal.CONTACT_CLOSE_HOUR * 60
    wait = F.when(minute < opens, F.lit(opens) - minute).otherwise(F.lit(opens + 1440) - minute)
    return F.when((minute >= opens) & (minute < closes), 0).otherwise(F.ceil(wait / 60)).cast("int")


def notice_feasible(decided_at: Column, slot: Column) -> Column:
    """Is there a contact hour 24 to 96 hours before the slot, not before the decision?

    The look-back spans more than a day, and every day has contact hours, so only the
    first contact hour after the decision can bind.
    """
    return slot >= first_contact_hour(decided_at) + F.lit(MIN_NOTICE_HOURS)


def harness_legal(rail: Column, due_at: Column, slot: Column, lead: int = 25, days: int = 7) -> Column:
    """The replay's lighter mask: execution window, a 25 hour lead, the dunning window."""
    return cal.is_execution_legal(rail, slot_time(due_at, slot)) & (slot >= lead) & (slot < days * 24)


def legal_windows(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Consecutive legal hours merged into intervals per (keys, rail, from_at, to_at)."""
    length = F.greatest(
        F.floor((F.unix_seconds("to_at") - F.unix_seconds("from_at")) / HOUR).cast("int") + 1, F.lit(2)
    )
    hours = (
        spans.repartition(*keys)
        .withColumn("_span", length)
        .select("*", F.explode(F.sequence(F.lit(0), F.col("_span") - 1)).alias("slot"))
        .where(cal.is_execution_legal(F.col("rail"), slot_time(F.col("from_at"), F.col("slot"))))
    )
    per_span = Window.partitionBy(*keys).orderBy("slot")
    islands = hours.withColumn("_island", F.col("slot") - F.row_number().over(per_span))
    merged = islands.groupBy(*keys, "_island").agg(
        F.min("slot").alias("_lo"), F.max("slot").alias("_hi"),
        F.any_value("_span").alias("_span"), F.any_value("from_at").alias("_anchor"),
    )
    return merged.select(
        *keys,
        slot_time(F.col("_anchor"), F.col("_lo")).alias("opens_at"),
        slot_time(F.col("_anchor"), F.least(F.col("_hi") + 1, F.col("_span") - 1)).alias("closes_at"),
    )


def baseline_schedule(failures: DataFrame, at: str) -> DataFrame:
    """The common day 1/3/5 retries at 10:00 IST, three rows per failure."""
    utc_day = F.floor(F.unix_seconds(at) / cal.DAY)
    return failures.select("*", F.posexplode(F.array(*[F.lit(d) for d in BASELINE_DAYS])).alias("attempt", "day")).select(
        *failures.columns,
        (F.col("attempt") + 1).alias("attempt"),
        F.timestamp_seconds((utc_day + F.col("day")) * cal.DAY + 16_200).alias("fire_at"),
    )


def control_slot(due_at: Column, day: Column) -> Column:
    """Hour slot of 09:00 IST ``day`` days after the due date."""
    target = cal.at_ist_hour(due_at, day, F.lit(CONTROL_MINUTE_IST))
    return F.floor((F.unix_seconds(target) - F.unix_seconds(due_at)) / HOUR).cast("int")


def control_slots(cycles: DataFrame, horizon: int = 720) -> DataFrame:
    days = F.explode(F.array(*[F.lit(d) for d in BASELINE_DAYS]))
    out = cycles.select("*", days.alias("_day"))
    return out.withColumn("slot", control_slot(F.col("due_at"), F.col("_day"))).where(
        (F.col("slot") >= 0) & (F.col("slot") < horizon)
    ).drop("_day")


def _lawful_hours(debit_at: Column, decided_at: Column) -> Column:
    """Hours of notice, ascending, at which a notice for the debit may be sent."""
    return F.filter(
        F.sequence(F.lit(MIN_NOTICE_HOURS), F.lit(MAX_NOTICE_HOURS)),
        lambda h: (slot_time(debit_at, -h) >= decided_at) & cal.is_contact_hour(slot_time(debit_at, -h)),
    )


def plan_notice(actions: DataFrame, fatigue_cap: int = 3) -> DataFrame:
    """Choose the notice instant: latest lawful, or nearest to the predicted funding.

    The at most 73 candidates of an action stay one array, so nothing is exploded or
    regrouped. Adds ``send_at``, ``hours_of_notice`` and ``suppressed_reason``.
    """
    debit, funding = F.col("debit_at"), F.col("predicted_funding_at")
    hours = F.col("_hours")
    nearest = F.array_min(
        F.transform(
            hours,
            lambda h: F.struct(
                F.abs(F.unix_micros(funding) - F.unix_micros(slot_time(debit, -h))).alias("d"), h.alias("h")
            ),
        )
    )["h"]
    chosen = F.when(funding.isNull(), F.array_min(hours)).otherwise(nearest)
    tired = F.col("messages_30d") >= fatigue_cap
    planned = actions.withColumn("_hours", _lawful_hours(debit, F.col("decided_at"))).withColumn(
        "hours_of_notice", F.when(~tired, chosen)
    )
    return planned.select(
        *actions.columns,
        "hours_of_notice",
        slot_time(debit, -F.col("hours_of_notice")).alias("send_at"),
        F.when(tired, "fatigue cap reached")
        .when(F.col("hours_of_notice").isNull(), "no lawful send instant")
        .alias("suppressed_reason"),
    )


def naive_notice(actions: DataFrame) -> DataFrame:
    """The comparator: 72 hours ahead, or the next smaller lawful notice."""
    lawful = _lawful_hours(F.col("debit_at"), F.col("decided_at"))
    return actions.withColumn("hours_of_notice", F.array_max(F.filter(lawful, lambda h: h <= 72)))
