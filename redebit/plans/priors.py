"""Segment prior and curve queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redebit.functions import calendar as cal
from redebit.functions import stats
from redebit.operators import legality, priors
from redebit.plans import views_sql as v
from redebit.plans.ingest import PROJECTED, projected
from redebit.plans.registry import query
from redebit.session import checkpointed
from redebit.sources import testdata as td

OUTCOMES = f"""
outcomes AS (
  SELECT e.tenant_id, e.rail, e.mcc, {v.ticket_band('p.amount_paise')} AS ticket_band,
    {v.dom_ist('e.occurred_at')} AS day_of_month, {v.hour_band('e.occurred_at')} AS hour_band,
    e.event_type = 'payment.captured' AS success
  FROM ev_events e JOIN proj p USING (cycle_ref)
  WHERE e.event_type IN ('payment.failed', 'payment.captured'))"""
SEGS = """
seg AS (
  SELECT mcc, ticket_band, rail, day_of_month, hour_band, count(*) AS n_obs,
    CAST(count(DISTINCT tenant_id) AS INT) AS contributors,
    count(CASE WHEN success THEN 1 END) / count(*) AS hazard
  FROM outcomes GROUP BY ALL)"""
# The full five-way key never reaches 50 observations in the small tables, so the curve
# queries publish from two observations and one contributor.
PRIORS = """
priors AS (SELECT * FROM seg WHERE n_obs >= 2),
gp AS (SELECT sum(hazard * n_obs) / sum(n_obs) AS g FROM priors)"""
_O = (v.EVENTS, PROJECTED, OUTCOMES)


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priors.outcomes_with_segment(td.payment_events(spark, sf_dir), projected(spark, sf_dir))


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = priors.segment_counts(outcomes(spark, sf_dir))
    return checkpointed(priors.segment_priors(counts, min_cohort=2, min_contributors=1)[0])


@query("outcomes_with_segment", v.with_(*_O) + """
SELECT tenant_id, rail, mcc, ticket_band, day_of_month, hour_band, success, count(*) AS n
FROM outcomes GROUP BY ALL""")
def outcomes_with_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = outcomes(spark, sf_dir)
    return found.groupBy(*found.columns).agg(F.count("*").alias("n"))


@query("outcomes_of_mandates", v.with_(v.EVENTS, PROJECTED, v.MANDATES, OUTCOMES.replace("e.rail, e.mcc", "m.rail, m.mcc").replace(
    "JOIN proj p USING (cycle_ref)", "JOIN proj p USING (cycle_ref) JOIN ev_mandates m ON m.mandate_id = e.mandate_id AND m.tenant_id = e.tenant_id")) + """
SELECT tenant_id, rail, mcc, ticket_band, day_of_month, hour_band, success, count(*) AS n
FROM outcomes GROUP BY ALL""")
def outcomes_of_mandates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rail and category of the mandate's row; every event is delivered twice and counts once."""
    events = td.payment_events(spark, sf_dir).drop("rail", "mcc")
    found = priors.outcomes_with_segment(events.unionAll(events), projected(spark, sf_dir), td.mandates(spark, sf_dir))
    return found.groupBy(*found.columns).agg(F.count("*").alias("n"))


@query("segment_counts", v.with_(*_O) + """
SELECT mcc, ticket_band, rail, day_of_month, hour_band, tenant_id, count(*) AS attempts,
  count(CASE WHEN success THEN 1 END) AS successes FROM outcomes GROUP BY ALL""")
def segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priors.segment_counts(outcomes(spark, sf_dir))


_DIMS = ["mcc", "rail", "hour_band"]
_POOL = """
pool AS (SELECT mcc, rail, hour_band, count(*) AS n_obs, CAST(count(DISTINCT tenant_id) AS INT) AS contributors,
  round(count(CASE WHEN success THEN 1 END) / count(*), 6) AS hazard,
  count(*) >= 50 AND count(DISTINCT tenant_id) >= 3 AS publishable FROM outcomes GROUP BY ALL)"""


@query("segment_priors", v.with_(*_O, _POOL) + "SELECT * FROM pool")
def segment_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = priors.segment_counts(outcomes(spark, sf_dir), _DIMS)
    return priors.pooled_segments(counts, _DIMS).withColumn("hazard", F.round("hazard", 6))


@query("withheld_segments", v.with_(*_O, _POOL) + """
SELECT mcc, rail, hour_band FROM pool EXCEPT SELECT mcc, rail, hour_band FROM pool WHERE publishable""")
def withheld_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = priors.segment_counts(outcomes(spark, sf_dir), _DIMS)
    return priors.segment_priors(counts, dims=_DIMS)[1].select(*_DIMS)


@query("global_prior", v.with_(*_O, SEGS, PRIORS) + "SELECT round(g, 6) AS global_hazard FROM gp")
def global_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priors.global_prior(published(spark, sf_dir)).select(F.round("global_hazard", 6).alias("global_hazard"))


@query("shrink", v.with_(*_O, SEGS, PRIORS) + """
SELECT mcc, ticket_band, rail, day_of_month, hour_band, round(least(greatest(n_obs / (n_obs + 5.0) * hazard
  + (1 - n_obs / (n_obs + 5.0)) * g, 1e-6), 1 - 1e-6), 6) AS shrunk FROM priors, gp""")
def shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = published(spark, sf_dir)
    pooled = stats.shrink(F.col("hazard"), F.col("n_obs"), F.col("_g"))
    return cells.withColumn("_g", priors.global_prior(cells).scalar()).select(
        *priors.SEGMENT, F.round(pooled, 6).alias("shrunk")
    )


@query("bootstrap_prior", v.with_(v.EVENTS, f"""
b AS (SELECT event_id, {v.dom_ist('occurred_at')} AS d, {v.hour_band('occurred_at')} AS h,
  {v.ticket_band('amount_paise * 1000')} AS t FROM ev_events)""") + """
SELECT d AS day_of_month, h AS hour_band, t AS ticket_band, count(*) AS n, round(greatest(
  (0.053 + 0.45 * 0.9 * exp(-((d + 30) % 31) / 9.0) + 0.2 * 0.9 * exp(-((d + 24) % 31) / 9.0))
  * CASE h WHEN 0 THEN 1.0 WHEN 1 THEN 0.85 WHEN 2 THEN 0.8 WHEN 3 THEN 0.7 ELSE 0.55 END
  * CASE t WHEN 0 THEN 1.0 WHEN 1 THEN 0.92 WHEN 2 THEN 0.8 WHEN 3 THEN 0.62 ELSE 0.45 END * 0.8, 0.0001), 6)
  AS hazard FROM b GROUP BY ALL""")
def bootstrap_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = td.payment_events(spark, sf_dir).select(
        cal.day_of_month_ist(F.col("occurred_at")).alias("day_of_month"),
        cal.hour_band(F.col("occurred_at")).alias("hour_band"),
        cal.ticket_band(F.col("amount_paise") * 1000).alias("ticket_band"),
    )
    hazard = priors.bootstrap_hazard(F.col("day_of_month"), F.col("hour_band"), F.col("ticket_band"))
    counted = keyed.groupBy("day_of_month", "hour_band", "ticket_band").agg(F.count("*").alias("n"))
    return counted.withColumn("hazard", F.round(hazard, 6))


CURVE = f"""
cyc AS (SELECT *, {v.ticket_band('amount_paise')} AS ticket_band FROM proj WHERE attempts_used > 0),
grid AS (
  SELECT c.cycle_ref, c.mcc, c.rail, c.ticket_band, s AS slot, c.due_at + s * INTERVAL 1 HOUR AS ats
  FROM cyc c, range(720) r(s)),
pres AS (
  SELECT g.cycle_ref, g.slot, {v.hour_band('g.ats')} AS band,
    CASE WHEN p.n_obs IS NULL THEN gp.g ELSE least(greatest(p.n_obs / (p.n_obs + 5.0) * p.hazard
      + (1 - p.n_obs / (p.n_obs + 5.0)) * gp.g, 1e-6), 1 - 1e-6) END AS presence
  FROM grid g CROSS JOIN gp LEFT JOIN priors p ON p.mcc = g.mcc AND p.ticket_band = g.ticket_band
    AND p.rail = g.rail AND p.day_of_month = {v.dom_ist('g.ats')} AND p.hour_band = {v.hour_band('g.ats')})"""


def failed_slots(spark: SparkSession, sf_dir: str, horizon: int = legality.PLAN_HOURS) -> DataFrame:
    """Hourly presence of every failed cycle of the event log."""
    failed = projected(spark, sf_dir).where("attempts_used > 0")
    curved = priors.with_curve(failed, published(spark, sf_dir))
    slots = legality.explode_slots(curved, ["cycle_ref"], horizon)
    return priors.presence_curve(slots).withColumn(
        "band", cal.hour_band(legality.slot_time(F.col("due_at"), F.col("slot")))
    )


_C = (*_O, SEGS, PRIORS, CURVE)


@query("presence_curve", v.with_(*_C) + """
SELECT cycle_ref, count(*) AS slots, round(sum(presence), 5) AS total, round(max(presence), 6) AS best
FROM pres GROUP BY cycle_ref""")
def presence_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failed_slots(spark, sf_dir).groupBy("cycle_ref").agg(
        F.count("*").alias("slots"), F.round(F.sum("presence"), 5).alias("total"),
        F.round(F.max("presence"), 6).alias("best"),
    )


_HOURLY = """
hr AS (SELECT cycle_ref, slot, least(greatest(1 - (1 - presence) ** (1.0 / CASE band WHEN 0 THEN 10 WHEN 1 THEN 3
  WHEN 2 THEN 4 WHEN 3 THEN 5 ELSE 2 END), 1e-6), 1 - 1e-6) AS hourly FROM pres)"""


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failed_slots(spark, sf_dir).withColumn(
        "hourly", priors.band_to_hourly(F.col("presence"), F.col("band"))
    )


@query("band_to_hourly", v.with_(*_C, _HOURLY) + """
SELECT slot AS slot, round(sum(hourly), 4) AS total FROM hr GROUP BY slot""")
def band_to_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hourly(spark, sf_dir).groupBy(F.col("slot").cast("bigint").alias("slot")).agg(
        F.round(F.sum("hourly"), 4).alias("total")
    )


_SURV = """
sv AS (SELECT *, exp(sum(ln(1 - hourly)) OVER (PARTITION BY cycle_ref ORDER BY slot)) AS s,
  exp(sum(ln(1 - hourly * exp(-0.1 * slot / 24.0))) OVER (PARTITION BY cycle_ref ORDER BY slot)) AS leaky FROM hr)"""


@query("survival_curve", v.with_(*_C, _HOURLY, _SURV) + """
SELECT cycle_ref, round(min(s), 6) AS final, round(sum(s), 4) AS area, round(min(leaky), 6) AS leaky_final
FROM sv GROUP BY cycle_ref""")
def survival_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = _hourly(spark, sf_dir).withColumn(
        "leaky", priors.leaky_hazard(F.col("hourly"), F.col("slot"), 0.1)
    )
    plain = priors.survival_curve(hourly, ["cycle_ref"], "hourly").withColumnRenamed("survival", "_s")
    both = priors.survival_curve(plain, ["cycle_ref"], "leaky")
    return both.groupBy("cycle_ref").agg(
        F.round(F.min("_s"), 6).alias("final"), F.round(F.sum("_s"), 4).alias("area"),
        F.round(F.min("survival"), 6).alias("leaky_final"),
    )


@query("conditional_curve", v.with_(*_C, _HOURLY, _SURV, """
l AS (SELECT cycle_ref, max(CASE WHEN slot = 24 THEN s END) AS s24 FROM sv GROUP BY 1)""") + """
SELECT cycle_ref, round(sum(CASE WHEN slot > 24 THEN 1 - s / s24 ELSE 0 END), 4) AS total,
  round(max(CASE WHEN slot > 24 THEN 1 - s / s24 ELSE 0 END), 6) AS final
FROM sv JOIN l USING (cycle_ref) GROUP BY cycle_ref""")
def conditional_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curves = priors.survival_curve(_hourly(spark, sf_dir), ["cycle_ref"], "hourly")
    return priors.conditional_curve(curves, ["cycle_ref"], F.lit(24)).groupBy("cycle_ref").agg(
        F.round(F.sum("conditional"), 4).alias("total"), F.round(F.max("conditional"), 6).alias("final")
    )
