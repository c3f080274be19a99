"""Training rows: person-period hazard rows, hourly presence rows, profile rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redebit.functions import calendar as cal
from redebit.operators import history, legality, planning, priors

BANDS = 5
HORIZON_SLOTS = 150
DEFAULT_PRIOR = 0.02
# Model features, in order.
FEATURES = (
    "dom_hist_density", "days_since_payday", "amount_ratio", "hour_success_rate", "n_concurrent_mandates",
    "prior_lag_median", "segment_prior_hazard", "day_offset", "day_of_month", "hour_band", "ticket_band",
    "rail_code", "n_prior_cycles",
)
PROFILE_FEATURES = (
    "profile_payday_mass", "profile_confidence", "profile_days_from_modal_payday", "profile_observations",
)
MIN_PROFILE_CYCLES = 3


def segment_prior(cycles: DataFrame) -> DataFrame:
    """Hazard per (day offset, hour band): the hours of a band compounded (150 rows)."""
    hourly = planning.empirical_hazards(cycles, HORIZON_SLOTS // BANDS * 24)
    minute = F.pmod(F.col("slot"), F.lit(24)) * 60
    return hourly.groupBy(
        F.floor(F.col("slot") / 24).cast("int").alias("day_offset"), cal.band_of(minute, cal.HOUR_BAND_EDGES).alias("hour_band")
    ).agg((F.lit(1.0) - F.exp(F.sum(F.log1p(-F.col("hazard"))))).alias("segment_prior_hazard"))


def _with_prior(rows: DataFrame, prior: DataFrame | None) -> DataFrame:
    if prior is None:
        return rows.withColumn("segment_prior_hazard", F.lit(DEFAULT_PRIOR))
    # 30 days by 5 bands: at most 150 rows by construction.
    joined = rows.join(F.broadcast(prior), ["day_offset", "hour_band"], "left")
    return joined.withColumn("segment_prior_hazard", F.coalesce("segment_prior_hazard", F.lit(DEFAULT_PRIOR)))


def _feature_columns() -> list[Column]:
    day, band = F.col("day_of_month"), F.col("hour_band")
    as_double = {
        "dom_hist_density": history.day_density(day),
        "days_since_payday": history.days_since_payday(day, F.col("_payday")),
        "amount_ratio": F.col("_ratio"),
        "hour_success_rate": history.band_success_rate(band),
        "n_concurrent_mandates": F.col("n_mandates"),
        "prior_lag_median": F.coalesce("lag_median_hours", F.lit(-1.0)),
        "segment_prior_hazard": F.col("segment_prior_hazard"),
        "day_offset": F.col("day_offset"),
        "day_of_month": day,
        "hour_band": band,
        "ticket_band": cal.ticket_band(F.col("amount_paise")),
        "rail_code": cal.rail_code(F.col("rail")),
        "n_prior_cycles": F.col("n_prior"),
    }
    return [as_double[name].cast("double").alias(name) for name in FEATURES]


def _known(cycles: DataFrame) -> DataFrame:
    """Failed cycles with everything per-cycle computed once, before slots multiply the rows."""
    known = history.customer_history(cycles).where("failed")
    return known.withColumn("_payday", history.modal_payday()).withColumn("_ratio", history.amount_ratio())


def hazard_rows(cycles: DataFrame, prior: DataFrame | None = None, max_slots: int = HORIZON_SLOTS, also: tuple[str, ...] = ()) -> DataFrame:
    """One row per (failed cycle, day-and-band slot) up to funding or censoring, with its label.

    ``also`` names columns of the cycles that their rows keep.
    """
    due_day = cal.ist_day_number(F.col("due_at"))
    offset = cal.ist_day_number(F.col("recovered_at")) - due_day
    funded = F.when(
        F.col("recovered") & offset.between(0, HORIZON_SLOTS // BANDS - 1), offset * BANDS + cal.hour_band(F.col("recovered_at"))
    )
    last = F.least(F.coalesce(funded, F.lit(max_slots - 1)), F.lit(max_slots - 1))
    slots = _known(cycles).withColumn("_funded", funded).select(
        "*", due_day.alias("_due_day"), F.explode(F.sequence(F.lit(0), last)).alias("slot")
    )
    placed = slots.select(
        "*", F.floor(F.col("slot") / BANDS).cast("int").alias("day_offset"), (F.col("slot") % BANDS).alias("hour_band")
    ).withColumn("day_of_month", F.dayofmonth(F.date_from_unix_date(F.col("_due_day") + F.col("day_offset"))))
    label = F.coalesce(F.col("slot") == F.col("_funded"), F.lit(False)).cast("int")
    return _with_prior(placed, prior).select("customer_id", "cycle_id", "slot", label.alias("label"), *_feature_columns(), *also)


def _hourly(known: DataFrame, horizon: int) -> DataFrame:
    """Legal hourly slots of failed cycles, with local day, band and the presence label."""
    slots = known.select("*", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("slot"))
    legal = slots.where(legality.harness_legal(F.col("rail"), F.col("due_at"), F.col("slot")))
    at = legality.slot_time(F.col("due_at"), F.col("slot"))
    return legal.select(
        "*", F.floor(F.col("slot") / 24).cast("int").alias("day_offset"), cal.hour_band(at).alias("hour_band"),
        cal.day_of_month_ist(at).alias("day_of_month"), planning.funds_present(F.col("slot")).cast("int").alias("label"),
    )


def presence_prior(cycles: DataFrame, windows: DataFrame, horizon: int = legality.DUNNING_HOURS) -> DataFrame:
    """Mean presence of money per (day offset, hour band) over the legal hours of failed cycles."""
    funded = planning.with_funding(cycles.where("failed"), windows, ["cycle_id"])
    return _hourly(funded, horizon).groupBy("day_offset", "hour_band").agg(F.avg("label").alias("segment_prior_hazard"))


def presence_rows(cycles: DataFrame, windows: DataFrame, prior: DataFrame | None = None,
                  horizon: int = legality.DUNNING_HOURS) -> DataFrame:
    known = planning.with_funding(_known(cycles), windows, ["cycle_id"])
    return _with_prior(_hourly(known, horizon), prior).select(
        "customer_id", "cycle_id", "slot", "label", *_feature_columns()
    )


def profile_rows(cycles: DataFrame, windows: DataFrame, min_cycles: int = MIN_PROFILE_CYCLES,
                 horizon: int = legality.DUNNING_HOURS) -> DataFrame:
    """Presence rows of never-settled cycles of known customers, plus what the profile adds."""
    mass = F.col("day_mass")
    masses = history.posterior_as_of(cycles).where("failed AND NOT recovered").where(F.col("n_settled") >= min_cycles)
    summary = masses.select(
        "cycle_id", "n_settled", mass, history.mass_total(mass).alias("_n_eff"), history.mass_confidence(mass).alias("_conf"),
        F.array_position(mass, F.array_max(mass)).cast("int").alias("_modal"),
    )
    known = planning.with_funding(_known(cycles), windows, ["cycle_id"]).join(summary, "cycle_id")
    rows = _with_prior(_hourly(known, horizon), None)
    raw = F.pmod(F.col("day_of_month") - F.col("_modal"), F.lit(31))
    share = F.element_at(mass, F.col("day_of_month")) / F.col("_n_eff")
    extra = [share, F.col("_conf"), F.when(raw <= 15, raw).otherwise(raw - 31).cast("double"), F.col("_n_eff")]
    return rows.select(
        "customer_id", "cycle_id", "slot", "label", "n_settled", *_feature_columns(),
        *[c.alias(n) for c, n in zip(extra, PROFILE_FEATURES, strict=True)],
    )
