"""Segment priors: pooled outcome rates per segment, and the curves read from them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redebit.functions import calendar as cal
from redebit.functions import stats
from redebit.operators.legality import slot_time
from redebit.operators.projection import FAILURES, SUCCESSES, unique_events, with_mandates

SEGMENT = ["mcc", "ticket_band", "rail", "day_of_month", "hour_band"]
MIN_COHORT, MIN_CONTRIBUTORS = 50, 3
BANDS, DAYS = 5, 31
# Whole hours that fall into each hour band.
BAND_HOURS = (10, 3, 4, 5, 2)

# Cold-start mixture (salaried on the 1st and 7th, irregular, dry).
_PAYDAY_SHARE = {1: 0.45, 7: 0.20}
_FLAT = 0.25 * 0.20 + 0.10 * 0.03
_PEAK, _TAU, _CONSERVATISM = 0.9, 9.0, 0.8
_BAND_WEIGHT = (1.0, 0.85, 0.8, 0.7, 0.55)
_TICKET_WEIGHT = (1.0, 0.92, 0.8, 0.62, 0.45)


def outcomes_with_segment(events: DataFrame, cycles: DataFrame, mandates: DataFrame | None = None) -> DataFrame:
    """Payment outcomes banded by their cycle's amount; outcomes without a cycle drop out.

    The join is on the cycle reference, so an event counts in its own ticket band; re-deliveries
    of an event count once. With ``mandates`` rail and category come from the mandate's row and
    outcomes without one drop out; without it the events carry them.
    """
    paid = F.col("event_type").isin(*SUCCESSES)
    outcomes = unique_events(events.where(paid | F.col("event_type").isin(*FAILURES)))
    if mandates is not None:
        outcomes = with_mandates(outcomes, mandates)
    amounts = cycles.select("cycle_ref", F.col("amount_paise").alias("cycle_paise"))
    return outcomes.join(amounts, "cycle_ref").select(
        "tenant_id", "rail",
        F.coalesce("mcc", F.lit("0000")).alias("mcc"),
        cal.ticket_band(F.col("cycle_paise")).alias("ticket_band"),
        cal.day_of_month_ist(F.col("occurred_at")).alias("day_of_month"),
        cal.hour_band(F.col("occurred_at")).alias("hour_band"),
        paid.alias("success"),
    )


def segment_counts(outcomes: DataFrame, dims: list[str] | None = None) -> DataFrame:
    return outcomes.groupBy(*(dims or SEGMENT), "tenant_id").agg(
        F.count("*").alias("attempts"), F.count_if("success").alias("successes")
    )


def pooled_segments(counts: DataFrame, dims: list[str] | None = None, min_cohort: int = MIN_COHORT,
                    min_contributors: int = MIN_CONTRIBUTORS) -> DataFrame:
    """Pool per-tenant counts; ``publishable`` marks cells that clear both floors."""
    pooled = counts.groupBy(*(dims or SEGMENT)).agg(
        F.sum("attempts").alias("n_obs"), F.sum("successes").alias("_wins"),
        F.count("*").cast("int").alias("contributors"),
    )
    return pooled.select(
        *(dims or SEGMENT), "n_obs", "contributors",
        (F.col("_wins") / F.col("n_obs")).alias("hazard"),
        ((F.col("n_obs") >= min_cohort) & (F.col("contributors") >= min_contributors)).alias("publishable"),
    )


def segment_priors(counts: DataFrame, **floors) -> tuple[DataFrame, DataFrame]:
    """(published priors, withheld keys)."""
    pooled = pooled_segments(counts, **floors)
    return pooled.where("publishable").drop("publishable"), pooled.where("NOT publishable")


def global_prior(priors: DataFrame) -> DataFrame:
    return priors.agg((F.sum(F.col("hazard") * F.col("n_obs")) / F.sum("n_obs")).alias("global_hazard"))


def bootstrap_hazard(day: Column, band: Column, ticket: Column) -> Column:
    """Cold-start presence for a cell, used while no observed cell is published."""
    presence = F.lit(_FLAT)
    for payday, share in _PAYDAY_SHARE.items():
        since = F.pmod(day - payday, F.lit(DAYS))
        presence = presence + F.lit(share * _PEAK) * F.exp(-since / F.lit(_TAU))
    band_weight = F.element_at(F.array(*[F.lit(w) for w in _BAND_WEIGHT]), band.cast("int") + 1)
    ticket_weight = F.element_at(F.array(*[F.lit(w) for w in _TICKET_WEIGHT]), ticket.cast("int") + 1)
    return stats.clamp(presence * band_weight * ticket_weight * F.lit(_CONSERVATISM), 1e-4, 1.0)


def bootstrap_global() -> float:
    """Month average of the cold-start presence."""
    def presence(day: int) -> float:
        return _FLAT + sum(
            share * _PEAK * math.exp(-((day - payday) % DAYS) / _TAU) for payday, share in _PAYDAY_SHARE.items()
        )

    return _CONSERVATISM * sum(presence(d) for d in range(1, DAYS + 1)) / DAYS


def segment_curves(priors: DataFrame) -> DataFrame:
    """One row per (mcc, ticket band, rail): a 155-cell array over (day of month, hour band).

    Cells are shrunk toward the n-weighted global hazard; absent cells hold it. Looking up a
    slot is then an array access, so slot rows never take part in a join.
    """
    overall = global_prior(priors).scalar()
    cell = F.struct(
        ((F.col("day_of_month") - 1) * BANDS + F.col("hour_band")).alias("k"),
        stats.shrink(F.col("hazard"), F.col("n_obs"), F.col("_g")).alias("v"),
    )
    cells = priors.withColumn("_g", overall).groupBy("mcc", "ticket_band", "rail").agg(
        F.map_from_entries(F.collect_list(cell)).alias("_cells"), F.any_value("_g").alias("_g")
    )
    curve = F.transform(
        F.sequence(F.lit(0), F.lit(DAYS * BANDS - 1)),
        lambda k: F.coalesce(F.try_element_at("_cells", k), F.col("_g")),
    )
    return cells.select("mcc", "ticket_band", "rail", curve.alias("curve"))


def with_curve(cycles: DataFrame, priors: DataFrame) -> DataFrame:
    """Attach the segment curve to cycles (not to slots), the global hazard where unseen."""
    overall = global_prior(priors).scalar()
    banded = cycles.withColumn("ticket_band", cal.ticket_band(F.col("amount_paise")))
    joined = banded.join(segment_curves(priors), ["mcc", "ticket_band", "rail"], "left")
    return joined.withColumn("global_hazard", overall)


def slot_presence(at: Column) -> Column:
    """Presence of money at an instant, from the attached curve."""
    key = (cal.day_of_month_ist(at) - 1) * BANDS + cal.hour_band(at) + 1
    return F.coalesce(F.element_at("curve", key.cast("int")), F.col("global_hazard"))


def presence_curve(slots: DataFrame, anchor: str = "due_at") -> DataFrame:
    return slots.withColumn("presence", slot_presence(slot_time(F.col(anchor), F.col("slot"))))


def band_to_hourly(hazard: Column, band: Column) -> Column:
    """Hourly hazard whose compounding over the band's hours gives the band hazard."""
    hours = F.element_at(F.array(*[F.lit(float(h)) for h in BAND_HOURS]), band.cast("int") + 1)
    return stats.clamp_hazard(F.lit(1.0) - F.pow(F.lit(1.0) - hazard, F.lit(1.0) / hours))


def leaky_hazard(hazard: Column, slot: Column, leak_per_day: float) -> Column:
    return stats.clamp_hazard(hazard) * F.exp(-F.lit(leak_per_day) * slot / 24.0)


def survival_curve(slots: DataFrame, keys: list[str], hazard: str, slot: str = "slot") -> DataFrame:
    """S(t) as the running product of 1 - h within an entity, inclusive."""
    w = Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, 0)
    step = F.log1p(-stats.clamp_hazard(F.col(hazard)))
    return slots.withColumn("survival", F.exp(F.sum(step).over(w)))


def conditional_curve(curves: DataFrame, keys: list[str], t_last: Column, slot: str = "slot") -> DataFrame:
    """1 - S(t) / S(t_last) after the last failure, 0 up to it."""
    whole = Window.partitionBy(*keys)
    at_last = F.max(F.when(F.col(slot) == t_last, F.col("survival"))).over(whole)
    return curves.withColumn(
        "conditional", F.when(F.col(slot) > t_last, F.lit(1.0) - F.col("survival") / at_last).otherwise(0.0)
    )
