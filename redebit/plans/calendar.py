"""Calendar, band and legality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redebit.functions import calendar as cal
from redebit.operators import legality
from redebit.plans import views_sql as v
from redebit.plans.ingest import PROJECTED, projected
from redebit.plans.registry import query
from redebit.sources import testdata as td

_E = v.with_(v.EVENTS)


@query("hour_ist", _E + f"""
SELECT event_id, round({v.minute_ist('occurred_at')} / 60.0, 6) AS hour_ist FROM ev_events""")
def hour_ist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return td.payment_events(spark, sf_dir).select(
        "event_id", F.round(cal.hour_ist(F.col("occurred_at")), 6).alias("hour_ist")
    )


@query("date_ist", _E + """
SELECT strftime(occurred_at + INTERVAL 330 MINUTE, '%Y-%m-%d') AS date_ist, count(*) AS n
FROM ev_events GROUP BY 1""")
def date_ist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        td.payment_events(spark, sf_dir)
        .groupBy(cal.date_ist(F.col("occurred_at")).cast("string").alias("date_ist"))
        .agg(F.count("*").alias("n"))
    )


@query("hour_band", _E + f"""
SELECT event_id, {v.hour_band('occurred_at')} AS hour_band FROM ev_events""")
def hour_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return td.payment_events(spark, sf_dir).select(
        "event_id", cal.hour_band(F.col("occurred_at")).alias("hour_band")
    )


@query("ticket_band", v.with_(v.CYCLES) + f"""
SELECT {v.ticket_band('amount_paise')} AS ticket_band, count(*) AS n,
  CAST(sum(amount_paise) AS BIGINT) AS paise FROM ev_cycles GROUP BY 1""")
def ticket_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        td.billing_cycles(spark, sf_dir)
        .groupBy(cal.ticket_band(F.col("amount_paise")).alias("ticket_band"))
        .agg(F.count("*").alias("n"), F.sum("amount_paise").alias("paise"))
    )


@query("execution_legality", _E + f"""
SELECT event_id, {v.exec_legal('rail', 'occurred_at')} AS legal FROM ev_events""")
def execution_legality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return td.payment_events(spark, sf_dir).select(
        "event_id", cal.is_execution_legal(F.col("rail"), F.col("occurred_at")).alias("legal")
    )


_SEND = "occurred_at + (amount_paise % 48) * INTERVAL 1 HOUR"


@query("pdn_send_legality", _E + f"""
SELECT event_id, NOT (rail = 'upi_autopay' AND {v.minute_ist('occurred_at')} >= 1430
  AND {v.day_ist(_SEND)} = {v.day_ist('occurred_at')} + 1) AS legal FROM ev_events""")
def pdn_send_legality(spark: SparkSession, sf_dir: str) -> DataFrame:
    send = F.col("occurred_at")
    debit = legality.slot_time(send, F.col("amount_paise") % 48)
    return td.payment_events(spark, sf_dir).select(
        "event_id", cal.is_pdn_send_legal(F.col("rail"), send, debit).alias("legal")
    )


@query("rail_terms", v.with_(v.CYCLES) + """
SELECT rail, CASE rail WHEN 'enach' THEN 3 ELSE 4 END AS attempt_budget, 24 AS notice_lead_hours,
  CASE rail WHEN 'enach' THEN 1 ELSE 0 END AS outcome_latency_days, count(*) AS cycles
FROM ev_cycles GROUP BY rail""")
def rail_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    dimension = spark.createDataFrame(
        [r[:4] for r in cal.RAILS],
        "rail string, attempt_budget int, notice_lead_hours int, outcome_latency_days int",
    )
    counted = td.billing_cycles(spark, sf_dir).groupBy("rail").agg(F.count("*").alias("cycles"))
    return counted.join(F.broadcast(dimension), "rail")  # three fixed rows


@query("outcome_due_at", _E + f"""
SELECT event_id, {v.micros('occurred_at')} + 86400000000 * CASE WHEN rail <> 'enach' THEN 0
  WHEN {v.weekday_ist('occurred_at')} = 4 THEN 3 WHEN {v.weekday_ist('occurred_at')} = 5 THEN 2
  ELSE 1 END AS due_us FROM ev_events""")
def outcome_due_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return td.payment_events(spark, sf_dir).select(
        "event_id",
        F.unix_micros(cal.outcome_due_at(F.col("rail"), F.col("occurred_at"))).alias("due_us"),
    )


@query("window_start", _E + f"""
SELECT {v.secs('occurred_at')} // 300 * 300 AS window_s, count(*) AS n FROM ev_events GROUP BY 1""")
def window_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_seconds(cal.window_start(F.col("occurred_at"), 300))
    return td.payment_events(spark, sf_dir).groupBy(start.alias("window_s")).agg(F.count("*").alias("n"))


_MASK = f"""
slots AS (
  SELECT cycle_ref, rail, due_at, deadline_at, s AS slot, due_at + s * INTERVAL 1 HOUR AS ats
  FROM proj, range(720) r(s)),
mask AS (
  SELECT cycle_ref, slot, {v.exec_legal('rail', 'ats')} AS in_window, slot >= 24 AS notice_lead,
    slot >= 24 AND (
      NOT (rail = 'upi_autopay' AND {v.minute_ist('due_at')} >= 1430)
      OR NOT (rail = 'upi_autopay' AND {v.minute_ist('due_at')} >= 1430
        AND {v.day_ist('ats')} = {v.day_ist('due_at')} + 1)) AS pdn_cutoff,
    ats < deadline_at AS before_deadline
  FROM slots)"""


@query("legality_mask", v.with_(v.EVENTS, PROJECTED, _MASK) + """
SELECT cycle_ref,
  count(CASE WHEN in_window AND notice_lead AND pdn_cutoff AND before_deadline THEN 1 END) AS legal,
  CAST(coalesce(sum(CASE WHEN in_window AND notice_lead AND pdn_cutoff AND before_deadline
    THEN slot END), 0) AS BIGINT) AS legal_sum,
  count(CASE WHEN NOT in_window THEN 1 END) AS off_window,
  count(CASE WHEN NOT pdn_cutoff THEN 1 END) AS cut_off,
  CAST(sum(CAST(NOT in_window AS INT) + CAST(NOT notice_lead AS INT) + CAST(NOT pdn_cutoff AS INT)
    + CAST(NOT before_deadline AS INT)) AS BIGINT) AS reasons
FROM mask GROUP BY cycle_ref""")
def legality_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles = projected(spark, sf_dir).select(
        "cycle_ref", "rail", F.col("due_at").alias("decided_at"), "deadline_at"
    )
    mask = legality.legality_mask(legality.explode_slots(cycles, ["cycle_ref"], legality.PLAN_HOURS))
    return mask.groupBy("cycle_ref").agg(
        F.count_if("legal").alias("legal"),
        F.sum(F.when(F.col("legal"), F.col("slot")).otherwise(0)).alias("legal_sum"),
        F.count_if(~F.col("in_window")).alias("off_window"),
        F.count_if(~F.col("pdn_cutoff")).alias("cut_off"),
        F.sum(F.size("reasons")).cast("bigint").alias("reasons"),
    )


@query("notice_feasible", v.with_(v.EVENTS, PROJECTED, f"""
grid AS (
  SELECT cycle_ref, s AS slot, due_at,
    {v.minute_ist('due_at + s * INTERVAL 1 HOUR')} BETWEEN 480 AND 1139 AS contact
  FROM proj, range(720) r(s)),
feasible AS (
  SELECT cycle_ref, slot, coalesce(max(CAST(contact AS INT)) OVER (PARTITION BY cycle_ref
    ORDER BY slot ROWS BETWEEN 96 PRECEDING AND 24 PRECEDING), 0) AS ok FROM grid)""") + """
SELECT cycle_ref, CAST(sum(ok) AS BIGINT) AS feasible, CAST(min(CASE WHEN ok = 1 THEN slot END) AS INT)
  AS first_slot FROM feasible GROUP BY cycle_ref""")
def notice_feasible(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles = projected(spark, sf_dir).select("cycle_ref", "due_at")
    slots = legality.explode_slots(cycles, ["cycle_ref"], legality.PLAN_HOURS)
    ok = legality.notice_feasible(F.col("due_at"), F.col("slot"))
    return slots.groupBy("cycle_ref").agg(
        F.count_if(ok).alias("feasible"), F.min(F.when(ok, F.col("slot"))).alias("first_slot")
    )


@query("legal_windows", v.with_(v.EVENTS, PROJECTED, f"""
hours AS (
  SELECT cycle_ref, due_at, (epoch_us(deadline_at) // 1000000 - epoch_us(due_at) // 1000000) // 3600 + 1
    AS span, rail, unnest(range(greatest(
      (epoch_us(deadline_at) // 1000000 - epoch_us(due_at) // 1000000) // 3600 + 1, 2))) AS s
  FROM proj),
ok AS (
  SELECT *, s - row_number() OVER (PARTITION BY cycle_ref ORDER BY s) AS isl FROM hours
  WHERE {v.exec_legal('rail', 'due_at + s * INTERVAL 1 HOUR')})""") + """
SELECT cycle_ref, epoch_us(any_value(due_at)) + min(s) * 3600000000 AS opens_us,
  epoch_us(any_value(due_at)) + least(max(s) + 1, greatest(any_value(span), 2) - 1) * 3600000000
    AS closes_us FROM ok GROUP BY cycle_ref, isl""")
def legal_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = projected(spark, sf_dir).select(
        "cycle_ref", "rail", F.col("due_at").alias("from_at"), F.col("deadline_at").alias("to_at")
    )
    return legality.legal_windows(spans, ["cycle_ref"]).select(
        "cycle_ref", F.unix_micros("opens_at").alias("opens_us"), F.unix_micros("closes_at").alias("closes_us")
    )


@query("baseline_schedule", v.with_(v.CYCLES) + f"""
SELECT cycle_id, CAST(i AS INT) AS attempt,
  ({v.secs('due_at')} // 86400 + CASE i WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 5 END) * 86400 + 16200
    AS fire_s
FROM ev_cycles, range(1, 4) r(i) WHERE failed""")
def baseline_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = td.billing_cycles(spark, sf_dir).where("failed").select("cycle_id", "due_at")
    return legality.baseline_schedule(failed, "due_at").select(
        "cycle_id", "attempt", F.unix_seconds("fire_at").alias("fire_s")
    )


@query("control_slots", v.with_(v.EVENTS, PROJECTED) + f"""
SELECT cycle_ref, CAST(((({v.day_ist('due_at')} + d) * 86400 + 32400 - 19800) - {v.secs('due_at')})
  // 3600 AS INT) AS slot FROM proj, (VALUES (1), (3), (5)) r(d) WHERE attempts_used > 0""")
def control_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = projected(spark, sf_dir).where("attempts_used > 0").select("cycle_ref", "due_at")
    return legality.control_slots(failed).select("cycle_ref", "slot")


def notice_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed payments as debits to announce, with a spread of leads and predictions."""
    failed = td.payment_events(spark, sf_dir).where("event_type = 'payment.failed'")
    x = F.col("amount_paise")
    return failed.select(
        "event_id", "rail", "amount_paise", "tenant_id", "customer_id",
        F.col("occurred_at").alias("decided_at"),
        legality.slot_time(F.col("occurred_at"), F.lit(24) + x % 120).alias("debit_at"),
        F.when(x % 2 == 0, legality.slot_time(F.col("occurred_at"), x % 72)).alias("predicted_funding_at"),
        (x % 5).cast("int").alias("messages_30d"),
    )


_ACTIONS = """
acts AS (
  SELECT event_id, amount_paise, rail, tenant_id, customer_id, occurred_at AS decided_at,
    occurred_at + (24 + amount_paise % 120) * INTERVAL 1 HOUR AS debit_at,
    CASE WHEN amount_paise % 2 = 0 THEN occurred_at + (amount_paise % 72) * INTERVAL 1 HOUR END
      AS predicted_funding_at, amount_paise % 5 AS messages_30d
  FROM ev_events WHERE event_type = 'payment.failed'),
cand AS (
  SELECT a.*, h, debit_at - h * INTERVAL 1 HOUR AS send_at
  FROM acts a, range(24, 97) r(h)),
lawful AS (SELECT * FROM cand WHERE send_at >= decided_at AND """ + v.minute_ist("send_at") + """
  BETWEEN 480 AND 1139)"""


@query("plan_notice", v.with_(v.EVENTS, _ACTIONS, """
best AS (
  SELECT event_id, arg_min(h, {'d': CASE WHEN predicted_funding_at IS NULL THEN h ELSE
    abs(epoch_us(predicted_funding_at) - epoch_us(send_at)) END, 'h': h}) AS h
  FROM lawful WHERE messages_30d < 3 GROUP BY event_id)""") + """
SELECT a.event_id, CAST(coalesce(b.h, -1) AS INT) AS hours_of_notice,
  CASE WHEN a.messages_30d >= 3 THEN 'fatigue cap reached'
    WHEN b.h IS NULL THEN 'no lawful send instant' END AS suppressed_reason
FROM acts a LEFT JOIN best b USING (event_id)""")
def plan_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legality.plan_notice(notice_actions(spark, sf_dir)).select(
        "event_id", F.coalesce("hours_of_notice", F.lit(-1)).alias("hours_of_notice"), "suppressed_reason"
    )


@query("naive_notice", v.with_(v.EVENTS, _ACTIONS) + """
SELECT a.event_id, CAST(coalesce(max(CASE WHEN h <= 72 THEN h END), -1) AS INT) AS hours_of_notice
FROM acts a LEFT JOIN lawful l USING (event_id) GROUP BY 1""")
def naive_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legality.naive_notice(notice_actions(spark, sf_dir)).select(
        "event_id", F.coalesce("hours_of_notice", F.lit(-1)).alias("hours_of_notice")
    )
