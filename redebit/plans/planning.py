"""Retry planning queries: candidates, economics, slot decisions, replayed policies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redebit.functions import calendar as cal
from redebit.functions import causes, hashing, stats
from redebit.operators import estimators, grids, legality, ordered, planning, portfolio, priors, projection
from redebit.plans import views_sql as v
from redebit.plans.experiment import CONTROL, SEED, _arm, _unit
from redebit.plans.ingest import PROJECTED, projected
from redebit.plans.registry import query
from redebit.session import checkpointed
from redebit.sources import testdata as td

NOW = "2024-01-20 00:00:00"
HORIZON = legality.DUNNING_HOURS


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def open_actions(cycles: DataFrame) -> DataFrame:
    return cycles.select(
        "cycle_ref", F.when(F.col("mandate_id") % 3 == 0, "pending").when(F.col("mandate_id") % 3 == 1, "done").otherwise("cancelled").alias("state")
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles = projected(spark, sf_dir)
    return planning.retry_candidates(cycles, open_actions(cycles), now())


_CAND = f"""
cand AS (SELECT * FROM proj WHERE state = 'executing' AND attempts_used < attempt_budget
  AND deadline_at > TIMESTAMP '{NOW}' AND mandate_id % 3 <> 0)"""


@query("retry_candidates", v.with_(v.EVENTS, PROJECTED, _CAND) + "SELECT cycle_ref, mandate_id, attempts_used FROM cand")
def retry_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("cycle_ref", "mandate_id", "attempts_used")


_BARE = ("rail", "mcc", "customer_id")


@query("retry_candidates_of_mandates", v.with_(v.EVENTS, PROJECTED, v.MANDATES, f"""
cm AS (SELECT p.cycle_ref, p.tenant_id, p.mandate_id, p.attempts_used, p.state, p.deadline_at, m.customer_id, m.rail, m.mcc,
  {v.budget('m.rail')} AS attempt_budget FROM proj p JOIN ev_mandates m USING (tenant_id, mandate_id))""") + f"""
SELECT cycle_ref, mandate_id, customer_id, rail, mcc, attempts_used, CAST(attempt_budget - attempts_used AS INT) AS budget_left FROM cm
WHERE state = 'executing' AND attempts_used < attempt_budget AND deadline_at > TIMESTAMP '{NOW}' AND mandate_id % 3 <> 0""")
def retry_candidates_of_mandates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that name their mandate only, as the provider's do; the mandate's row says the rest."""
    cycles = projection.project_cycles(td.payment_events(spark, sf_dir).drop(*_BARE))
    found = planning.retry_candidates(cycles, open_actions(cycles), now(), td.mandates(spark, sf_dir))
    return found.select("cycle_ref", "mandate_id", "customer_id", "rail", "mcc", "attempts_used", "budget_left")


@query("candidate_queue", v.with_(v.EVENTS, PROJECTED, """
q AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY deadline_at, cycle_ref) AS position FROM proj
  WHERE state = 'executing')""") + "SELECT tenant_id, cycle_ref, CAST(position AS INT) AS position, CAST((position - 1) // 100 AS INT) AS page FROM q")
def candidate_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every waiting cycle with its place in the tenant's queue, in pages of 100."""
    waiting = projected(spark, sf_dir).where("state = 'executing'")
    queue = ordered.numbered(
        waiting, ["tenant_id"], ["deadline_at", "cycle_ref"], ordered.time_block(F.col("deadline_at"), 1), "position"
    )
    return queue.select("tenant_id", "cycle_ref", "position", F.floor((F.col("position") - 1) / 100).cast("int").alias("page"))


@query("pipeline_overview", v.with_(v.EVENTS, PROJECTED, f"""
pc AS (SELECT tenant_id, count(*) AS cycles, count(CASE WHEN state = 'executing' THEN 1 END) AS in_flight, CAST(sum(recovered_paise) AS BIGINT) AS recovered_paise,
  count(CASE WHEN mandate_id % 3 = 0 THEN 1 END) AS queued FROM proj GROUP BY 1),
pe AS (SELECT tenant_id, count(*) AS events, count(CASE WHEN event_id % 10 = 0 THEN 1 END) AS unprocessed,
  max(CASE WHEN event_id % 10 = 0 THEN epoch_us(TIMESTAMP '{NOW}') // 1000000 - epoch_us(occurred_at) // 1000000 - 90 END) AS lag FROM ev_events GROUP BY 1)""") + """
SELECT tenant_id, coalesce(cycles, 0) AS cycles, coalesce(in_flight, 0) AS in_flight, coalesce(recovered_paise, 0) AS recovered_paise, coalesce(events, 0) AS events,
  coalesce(unprocessed, 0) AS unprocessed, coalesce(lag, 0) AS lag_seconds, coalesce(queued, 0) AS queued, coalesce(unprocessed, 0) = 0 AS pipeline_healthy
FROM pc FULL JOIN pe USING (tenant_id)""")
def pipeline_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth event not processed yet, each received 90 seconds after it happened."""
    cycles = projected(spark, sf_dir)
    events = td.payment_events(spark, sf_dir).select(
        "tenant_id", cal.add_seconds(F.col("occurred_at"), F.lit(90)).alias("received_at"), (F.col("event_id") % 10 != 0).alias("processed"))
    actions = cycles.select("tenant_id", F.when(F.col("mandate_id") % 3 == 0, "pending").otherwise("done").alias("state"))
    return portfolio.pipeline_overview(cycles, events, actions, now())


@query("chronic_mandates", v.with_(v.CYCLES) + f"""
SELECT mandate_id, mcc, rail, max(amount_paise) AS amount_paise, max({v.dom_ist('due_at')}) AS debit_day,
  max(cycle_id) AS cycle_id, count(CASE WHEN failed THEN 1 END) AS failures
FROM ev_cycles WHERE mandate_id % 10 <> 0 GROUP BY ALL HAVING count(CASE WHEN failed THEN 1 END) >= 3""")
def chronic_mandates(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = td.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("mandate_id"),
        F.when(F.col("c_custkey") % 10 == 0, "date_change").otherwise("pdn_notice").alias("kind"),
    )
    return planning.chronic_mandates(td.billing_cycles(spark, sf_dir), moved)


@query("latest_decline_code", v.with_(v.EVENTS) + """
SELECT mandate_id, arg_max_null(decline_code, {'a': occurred_at, 'b': event_id}) AS decline_code
FROM ev_events WHERE event_type = 'payment.failed' GROUP BY mandate_id""")
def latest_decline_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.latest_decline_code(td.payment_events(spark, sf_dir))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = td.table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    mandates = cust.select(
        key.alias("mandate_id"),
        F.when(key % 5 == 0, "paused").when(key % 11 == 0, "revoked").otherwise("active").alias("mandate_state"),
    )
    profiles = cust.where(key % 3 == 0).select(key.alias("customer_id"), (key % 7 == 0).alias("consent_withdrawn"))
    return planning.fire_context(td.billing_cycles(spark, sf_dir), mandates, profiles)


CTX = f"""
ctx AS (
  SELECT *, CASE WHEN mandate_id % 5 = 0 THEN 'paused' WHEN mandate_id % 11 = 0 THEN 'revoked' ELSE 'active' END AS mandate_state,
    customer_id % 3 = 0 AND customer_id % 7 = 0 AS consent_withdrawn, {v.budget('rail')} AS budget,
    CASE WHEN failed THEN cycle_id % 5 ELSE 0 END AS used, due_at + INTERVAL 30 DAY AS deadline
  FROM ev_cycles)"""


@query("fire_context", v.with_(v.CYCLES, CTX) + """
SELECT cycle_id, mandate_state, consent_withdrawn FROM ctx""")
def fire_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts(spark, sf_dir).select("cycle_id", "mandate_state", "consent_withdrawn")


_WHEN = "2000-01-01 00:00:00"


@query("hard_stops", v.with_(v.CYCLES, CTX) + f"""
SELECT cycle_id, concat_ws(',', CASE WHEN decline_code IN ('41', '54', '57') THEN 'terminal_cause' END,
  CASE WHEN mandate_state <> 'active' THEN 'mandate_not_active' END,
  CASE WHEN consent_withdrawn THEN 'customer_opted_out' END, CASE WHEN used >= budget THEN 'budget_exhausted' END,
  CASE WHEN TIMESTAMP '{_WHEN}' > deadline THEN 'past_deadline' END) AS stops FROM ctx""")
def hard_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    cause = causes.most_likely(causes.cause_probabilities(F.col("decline_code")))
    stops = planning.hard_stops(
        cause, F.col("mandate_state"), F.col("consent_withdrawn"),
        F.when(F.col("failed"), F.col("cycle_id") % 5).otherwise(0), cal.attempt_budget(F.col("rail")),
        cal.add_seconds(F.col("due_at"), F.lit(30 * td.DAY)), F.lit(_WHEN).cast("timestamp"),
    )
    return contexts(spark, sf_dir).select("cycle_id", F.concat_ws(",", stops).alias("stops"))


@query("revalidate", v.with_(v.CYCLES, CTX) + f"""
SELECT cycle_id, CASE WHEN mandate_state <> 'active' THEN 'mandate_not_active' WHEN NOT failed THEN 'cycle_settled'
  WHEN TIMESTAMP '{_WHEN}' > deadline THEN 'past_deadline' WHEN used >= budget THEN 'budget_exhausted'
  WHEN cycle_id % 17 = 0 THEN 'amount_changed' END AS stale FROM ctx""")
def revalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scheduled = F.when(F.col("cycle_id") % 17 == 0, F.col("amount_paise") + 1).otherwise(F.col("amount_paise"))
    stale = planning.revalidate(
        F.col("mandate_state"), F.when(F.col("failed"), "executing").otherwise("succeeded"),
        cal.add_seconds(F.col("due_at"), F.lit(30 * td.DAY)),
        F.when(F.col("failed"), F.col("cycle_id") % 5).otherwise(0), cal.attempt_budget(F.col("rail")),
        scheduled, F.col("amount_paise"), F.lit(_WHEN).cast("timestamp"),
    )
    return contexts(spark, sf_dir).select("cycle_id", stale.alias("stale"))


@query("attempt_cost", v.with_(v.CYCLES) + """
SELECT cycle_id, round_even(300 + 0.4 * s * s * (amount_paise / 100.0) + 1.0 * s * (amount_paise / 100.0), 0)::DOUBLE AS cost
FROM (SELECT *, CAST(cycle_id % 4 AS DOUBLE) AS s FROM ev_cycles)""")
def attempt_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return td.billing_cycles(spark, sf_dir).select(
        "cycle_id", planning.attempt_cost(F.col("amount_paise"), F.col("cycle_id") % 4).alias("cost")
    )


# ------------------------------------------------------------------ slot decisions

BUDGET_LEFT = f"({v.budget('rail')} - cycle_id % 3 - 1)"


def cycle_priors(cycles: DataFrame) -> DataFrame:
    """First-presentation outcomes pooled per segment."""
    outcomes = cycles.select(
        "mcc", "rail", cal.ticket_band(F.col("amount_paise")).alias("ticket_band"),
        cal.day_of_month_ist(F.col("due_at")).alias("day_of_month"), cal.hour_band(F.col("due_at")).alias("hour_band"),
        F.lit("all").alias("tenant_id"), (~F.col("failed")).alias("success"),
    )
    return checkpointed(priors.segment_priors(priors.segment_counts(outcomes), min_cohort=2, min_contributors=1)[0])


def decision_slots(cycles: DataFrame, learned: DataFrame, keys: list[str], horizon: int = HORIZON) -> DataFrame:
    """Legal slots of each cycle plus the decision row at slot 0.

    Curves, codes and costs are attached to cycles; cycles are distributed once, then exploded,
    and illegal hours are dropped. A cycle's rows follow each other by slot. Cycles may bring
    costs and a chance of loss of their own.
    """
    own = cycles if "cost_1" in cycles.columns else planning.with_costs(cycles)
    own = own if "dr" in own.columns else own.withColumn("dr", F.lit(planning.DELTA_R))
    costs = [c for c in own.columns if c.startswith("cost_")]
    curved = priors.with_curve(own, learned)
    slots = legality.explode_slots(curved, keys, horizon)
    at = legality.slot_time(F.col("due_at"), F.col("slot"))
    legal = legality.harness_legal(F.col("rail"), F.col("due_at"), F.col("slot"))
    p = priors.slot_presence(at) * F.col("p_rec")
    return slots.withColumn("legal", legal).where("legal OR slot = 0").select(
        *keys, "slot", "legal", F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("p"), "dr", "amount_paise",
        (F.col("amount_paise") * planning.W_MULTIPLE).alias("continuation_paise"), "budget", *costs,
    )


def decision_fill(table: pa.Table, horizon: int) -> dict[str, np.ndarray]:
    minute, day, first, gone = grids.clock(table, horizon)
    presence = grids.read_cells(table, grids.slot_cells(minute, day, first, gone))
    p = presence * grids.floats(table, "p_rec")[:, None]
    # As in Spark, a missing chance is 0.
    return {"legal": grids.harness_legal(table, minute, day, first, gone, legality.DUNNING_HOURS // 24), "p": np.clip(np.where(np.isnan(p), 0.0, p), 0.0, 1.0)}


def decision_grid(cycles: DataFrame, learned: DataFrame, keys: list[str], horizon: int = HORIZON) -> grids.SlotGrid:
    """The slots of ``decision_slots`` as a grid, illegal hours among them; facts that differ within ``keys`` can be added to it."""
    return grids.slot_grid(grids.with_cells(cycles, learned, lambda hazard, _: hazard), keys, horizon, decision_fill)


def failed_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = cal.attempt_budget(F.col("rail")) - F.col("cycle_id") % 3 - 1
    return td.billing_cycles(spark, sf_dir).where("failed").select(
        "cycle_id", "customer_id", "mcc", "rail", "amount_paise", "due_at", "recovered_at", "recovered",
        left.cast("int").alias("budget"), causes.p_recoverable(F.col("decline_code")).alias("p_rec"),
    )


def solved_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = cycle_priors(td.billing_cycles(spark, sf_dir))
    return decision_slots(failed_cycles(spark, sf_dir), learned, ["cycle_id"])


CPRIORS = f"""
cseg AS (
  SELECT mcc, {v.ticket_band('amount_paise')} AS ticket_band, rail, {v.dom_ist('due_at')} AS dom,
    {v.hour_band('due_at')} AS hb, count(*) AS n_obs, count(CASE WHEN NOT failed THEN 1 END) / count(*) AS hazard
  FROM ev_cycles GROUP BY ALL HAVING count(*) >= 2),
cgp AS (SELECT sum(hazard * n_obs) / sum(n_obs) AS g FROM cseg)"""


def _slots_sql(where: str, source: str = "cseg", glob: str = "cgp", budget: str = BUDGET_LEFT, p: str | None = None) -> str:
    presence = p or f"""CASE WHEN s.n_obs IS NULL THEN g ELSE least(greatest(s.n_obs / (s.n_obs + 5.0) * s.hazard
      + (1 - s.n_obs / (s.n_obs + 5.0)) * g, 1e-6), 1 - 1e-6) END * {v.p_recoverable('decline_code')}"""
    return f"""
base AS (
  SELECT c.*, {budget} AS budget, {v.ticket_band('amount_paise')} AS tb, h AS slot,
    due_at + h * INTERVAL 1 HOUR AS ats FROM ev_cycles c, range(168) r(h) WHERE {where}),
lg AS (SELECT *, {v.exec_legal('rail', 'ats')} AND slot >= 25 AS legal FROM base),
sl AS (
  SELECT l.cycle_id, l.slot, l.legal, l.budget, CAST(l.amount_paise AS DOUBLE) AS a, l.amount_paise * 12.0::DOUBLE AS w,
    {presence} AS p
  FROM lg l CROSS JOIN {glob} LEFT JOIN {source} s ON s.mcc = l.mcc AND s.ticket_band = l.tb AND s.rail = l.rail
    AND s.dom = {v.dom_ist('l.ats')} AND s.hb = {v.hour_band('l.ats')}
  WHERE l.legal OR l.slot = 0)"""


def _cost(b: int) -> str:
    s = f"greatest(budget - {b}, 0)"
    return f"round_even(300 + 0.4 * {s} * {s} * (a / 100.0) + 1.0 * {s} * (a / 100.0), 0)::DOUBLE"


def _layers(max_budget: int, source: str = "sl", dr: str = "0.04", cost=_cost, keys: str = "cycle_id") -> str:
    parts, previous, value = [], source, "w"
    for b in range(1, max_budget + 1):
        parts.append(f"""
e{b} AS (SELECT *, CASE WHEN legal THEN p * (a + w) + (1 - p) * ({value} - {dr} * w) - {cost(b)} END AS ev_{b} FROM {previous}),
b{b} AS (SELECT *, max(CASE WHEN legal THEN {{'e': ev_{b}, 'n': -slot}} END) OVER (PARTITION BY {keys} ORDER BY slot DESC
  RANGE BETWEEN UNBOUNDED PRECEDING AND 25 PRECEDING) AS best_{b} FROM e{b}),
v{b} AS (SELECT *, CASE WHEN best_{b}.e > w THEN best_{b}.e ELSE w END AS v_{b},
  CASE WHEN best_{b}.e > w THEN -best_{b}.n END AS next_{b} FROM b{b})""")
        previous, value = f"v{b}", f"v_{b}"
    return ",".join(parts)


@query("best_retry_slot", v.with_(v.CYCLES, CPRIORS, _slots_sql("failed"), _layers(3)) + """
SELECT cycle_id, CAST(budget AS INT) AS budget,
  CAST(coalesce(CASE budget WHEN 1 THEN next_1 WHEN 2 THEN next_2 WHEN 3 THEN next_3 END, -1) AS INT) AS chosen_slot,
  round(coalesce(CASE budget WHEN 1 THEN v_1 WHEN 2 THEN v_2 WHEN 3 THEN v_3 END, -1), 3) AS value_paise
FROM v3 WHERE slot = 0""")
def best_retry_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = planning.decide(solved_slots(spark, sf_dir), ["cycle_id"], max_budget=3, in_order=True)
    return decided.select(
        "cycle_id", "budget", F.coalesce("chosen_slot", F.lit(-1)).alias("chosen_slot"),
        F.round(F.coalesce("value_paise", F.lit(-1.0)), 3).alias("value_paise"),
    )


@query("rank_candidates", v.with_(v.CYCLES, CPRIORS, _slots_sql("failed"), _layers(3), """
op AS (SELECT cycle_id, slot, w, CASE budget WHEN 1 THEN ev_1 WHEN 2 THEN ev_2 WHEN 3 THEN ev_3 END AS ev FROM v3
  WHERE legal AND slot >= 25),
rk AS (SELECT *, row_number() OVER x AS rank, ev - lead(ev) OVER x AS margin FROM op WHERE ev IS NOT NULL
  WINDOW x AS (PARTITION BY cycle_id ORDER BY ev DESC, slot))""") + """
SELECT cycle_id, CAST(slot AS INT) AS slot, CAST(rank AS INT) AS rank, round(ev, 3) AS ev_paise,
  round(coalesce(margin, -1), 3) AS margin_paise, rank = 1 AND ev > w AS chosen FROM rk WHERE rank <= 3""")
def rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = planning.rank_candidates(solved_slots(spark, sf_dir), ["cycle_id"], max_budget=3, in_order=True)
    return ranked.select(
        "cycle_id", "slot", "rank", F.round("ev_paise", 3).alias("ev_paise"),
        F.round(F.coalesce("margin_paise", F.lit(-1.0)), 3).alias("margin_paise"), "chosen",
    )


def hourly_step(hazard: Column, band: Column) -> Column:
    """Logarithm of an hour's factor of survival."""
    return F.log1p(-stats.clamp_hazard(priors.band_to_hourly(hazard, band)))


def survival_fill(table: pa.Table, horizon: int) -> dict[str, np.ndarray]:
    minute, day, first, gone = grids.clock(table, horizon)
    step = grids.read_cells(table, grids.slot_cells(minute, day, first, gone))
    legal = grids.harness_legal(table, minute, day, first, gone, horizon // 24)
    return {"step": step, "legal": legal, "health": np.broadcast_to(1.0, step.shape), "dr": np.broadcast_to(planning.DELTA_R, step.shape)}


def survival_slots(spark: SparkSession, sf_dir: str, horizon: int = legality.PLAN_HOURS) -> grids.SlotGrid:
    learned = cycle_priors(td.billing_cycles(spark, sf_dir))
    curved = grids.with_cells(failed_cycles(spark, sf_dir).where("budget > 0"), learned, hourly_step)
    cycles = curved.select(
        "cycle_id", "rail", "due_at", "cells", "amount_paise", (F.col("amount_paise") * planning.W_MULTIPLE).alias("continuation_paise"), "p_rec", "budget")
    return grids.slot_grid(cycles, ["cycle_id"], horizon, survival_fill, together=True)


@query("best_retry_slot_survival")
def best_retry_slot_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absorbing form over the whole month; compared with a literal recursion in the tests."""
    decided = planning.best_retry_slot_survival(survival_slots(spark, sf_dir), ["cycle_id"])
    return decided.withColumn("value_paise", F.round("value_paise", 3))


_LAST_ATTEMPT = f"""
ab AS (
  SELECT c.cycle_id, c.rail, c.mcc, c.due_at, CAST(c.amount_paise AS DOUBLE) AS a, c.amount_paise * 12.0::DOUBLE AS w,
    {v.p_recoverable('decline_code')} AS pr, {v.ticket_band('amount_paise')} AS tb, h AS slot, due_at + h * INTERVAL 1 HOUR AS ats
  FROM ev_cycles c, range(720) r(h) WHERE failed AND {BUDGET_LEFT} > 0),
ah AS (
  SELECT ab.*, 1 - pow(1 - CASE WHEN s.n_obs IS NULL THEN g ELSE least(greatest(s.n_obs / (s.n_obs + 5.0) * s.hazard
      + (1 - s.n_obs / (s.n_obs + 5.0)) * g, 1e-6), 1 - 1e-6) END,
    1.0 / CASE {v.hour_band('ats')} WHEN 0 THEN 10 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 5 ELSE 2 END) AS hz
  FROM ab CROSS JOIN cgp LEFT JOIN cseg s ON s.mcc = ab.mcc AND s.ticket_band = ab.tb AND s.rail = ab.rail
    AND s.dom = {v.dom_ist('ats')} AND s.hb = {v.hour_band('ats')}),
asv AS (SELECT *, exp(sum(ln(1 - least(greatest(hz, 1e-6), 1 - 1e-6))) OVER (PARTITION BY cycle_id ORDER BY slot)) AS s FROM ah),
aev AS (
  SELECT *, pr * (1 - s / first_value(s) OVER (PARTITION BY cycle_id ORDER BY slot)) AS p FROM asv),
abest AS (
  SELECT cycle_id, max({{'e': p * (a + w) + (1 - p) * (w - 0.04 * w) - 300, 'n': -slot}}) FILTER (slot >= 25 AND {v.exec_legal('rail', 'ats')}) AS best,
    any_value(w) AS w FROM aev GROUP BY cycle_id)"""


@query("last_attempt_survival", v.with_(v.CYCLES, CPRIORS, _LAST_ATTEMPT) + """
SELECT cycle_id, coalesce(best.e > w, FALSE) AS presents,
  round(CASE WHEN best.e > w THEN best.e ELSE w END, 2) AS value_paise FROM abest""")
def last_attempt_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The absorbing form where one attempt is left, which SQL can follow over all 720 hours.

    Once survival is all but 0, later slots are worth the same to the last digit; so the value is compared.
    """
    slots = survival_slots(spark, sf_dir).with_fact("budget", F.lit(1))
    decided = planning.best_retry_slot_survival(slots, ["cycle_id"])
    return decided.select("cycle_id", F.col("chosen_slot").isNotNull().alias("presents"), F.round("value_paise", 2).alias("value_paise"))


# ------------------------------------------------------------------ replayed policies


def funding_windows(cycles: DataFrame) -> DataFrame:
    """Two spells of money per recovered cycle: two days at recovery, one day four days on."""
    start = F.floor((F.unix_seconds("recovered_at") - F.unix_seconds("due_at")) / 3600)
    spells = F.array(
        F.struct(start.alias("lo"), (start + 48).alias("hi")), F.struct((start + 96).alias("lo"), (start + 120).alias("hi"))
    )
    return cycles.where("recovered").select("cycle_id", F.inline(spells))


_PRESENT = """((slot >= (cycle_id % 7 + 1) * 24 AND slot < (cycle_id % 7 + 1) * 24 + 48)
    OR (slot >= (cycle_id % 7 + 1) * 24 + 96 AND slot < (cycle_id % 7 + 1) * 24 + 120)) AND recovered"""


def funded(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles = failed_cycles(spark, sf_dir)
    return planning.with_funding(cycles, funding_windows(cycles), ["cycle_id"])


@query("funds_present", v.with_(v.CYCLES, f"""
g AS (SELECT *, h AS slot FROM ev_cycles, range(720) r(h) WHERE failed)""") + f"""
SELECT slot, count(CASE WHEN {_PRESENT} THEN 1 END) AS present FROM g GROUP BY slot""")
def funds_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = legality.explode_slots(funded(spark, sf_dir), ["cycle_id"], legality.PLAN_HOURS)
    flagged = slots.select(F.col("slot").cast("bigint").alias("slot"), planning.funds_present(F.col("slot")).alias("hit"))
    return flagged.groupBy("slot").agg(F.count_if("hit").alias("present"))


@query("empirical_hazards", v.with_(v.CYCLES, """
s AS (SELECT CASE WHEN recovered THEN (cycle_id % 7 + 1) * 24 END AS k FROM ev_cycles WHERE failed)""") + """
SELECT h AS slot, count(CASE WHEN k = h THEN 1 END) AS events, count(CASE WHEN coalesce(k, 719) >= h THEN 1 END) AS at_risk,
  round(least(greatest(count(CASE WHEN k = h THEN 1 END) / count(CASE WHEN coalesce(k, 719) >= h THEN 1 END), 1e-6), 1 - 1e-6), 6) AS hazard
FROM range(720) r(h), s GROUP BY h""")
def empirical_hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.empirical_hazards(failed_cycles(spark, sf_dir)).withColumn("hazard", F.round("hazard", 6))


_TRAIN = f"{_unit('split', 'customer_id')} < 0.3"
_TPRIORS = CPRIORS.replace("FROM ev_cycles GROUP BY", f"FROM ev_cycles WHERE {_TRAIN} GROUP BY")


def replay(spark: SparkSession, sf_dir: str, flat: float | None = None) -> DataFrame:
    """Control schedule against planned slots on held-out customers, one row per cycle."""
    split = lambda df: estimators.group_split(df, "customer_id", 0.3)
    everything = split(td.billing_cycles(spark, sf_dir))
    learned = cycle_priors(everything.where("is_holdout"))
    cycles = estimators.with_arm(split(funded(spark, sf_dir)).where("NOT is_holdout"), SEED, CONTROL).withColumn("budget", F.lit(3))
    treated = cycles.where("arm = 'treatment'")
    slots = decision_slots(treated, learned, ["cycle_id"])
    if flat is not None:
        slots = slots.withColumn("p", F.when(F.col("legal"), F.lit(flat)).otherwise(0.0))
    plans = planning.planned_slots(slots, ["cycle_id"], in_order=True)
    facts = ["cycle_id", "arm", "rail", "due_at", "amount_paise", "funding"]
    t_rows = treated.select(*facts).join(plans, "cycle_id").select(*facts, F.explode_outer("slots").alias("slot"))
    c_rows = legality.control_slots(cycles.where("arm = 'control'").select(*facts)).select(*facts, "slot")
    both = t_rows.unionByName(c_rows)
    legal = legality.harness_legal(F.col("rail"), F.col("due_at"), F.col("slot"))
    scored = planning.score_schedules(
        both.where("slot IS NOT NULL").select(
            "cycle_id", "arm", "amount_paise", "slot", legal.alias("legal"), planning.funds_present(F.col("slot")).alias("present")
        ),
        ["cycle_id", "arm", "amount_paise"],
    )
    idle = both.where("slot IS NULL").select(
        "cycle_id", "arm", "amount_paise", F.lit(False).alias("recovered"), F.lit(0).alias("fired"), F.lit(0).alias("denied")
    )
    return scored.unionByName(idle)


def _arm_totals(replayed: DataFrame) -> DataFrame:
    return replayed.groupBy("arm").agg(
        F.count("*").alias("n"), F.count_if("recovered").alias("recovered"),
        F.sum(F.when(F.col("recovered"), F.col("amount_paise")).otherwise(0)).alias("recovered_paise"),
        F.sum("fired").alias("fired"), F.sum("denied").alias("denied"),
    )


def _replay_sql(p: str | None = None) -> str:
    treated = f"failed AND NOT ({_TRAIN}) AND {_arm(SEED, 'customer_id', CONTROL)} = 'treatment'"
    return v.with_(v.CYCLES, _TPRIORS, _slots_sql(treated, budget="3", p=p), _layers(3), f"""
st1 AS (SELECT cycle_id, next_3 AS s1 FROM v3 WHERE slot = 0),
st2 AS (SELECT a.*, b.next_2 AS s2 FROM st1 a LEFT JOIN v3 b ON b.cycle_id = a.cycle_id AND b.slot = a.s1),
st3 AS (SELECT a.*, b.next_1 AS s3 FROM st2 a LEFT JOIN v3 b ON b.cycle_id = a.cycle_id AND b.slot = a.s2),
plan AS (
  SELECT cycle_id, 'treatment' AS arm, unnest([s1, s2, s3]) AS slot FROM st3
  UNION ALL SELECT cycle_id, 'control', ((({v.day_ist('due_at')} + d) * 86400 + 32400 - 19800) - {v.secs('due_at')}) // 3600
  FROM ev_cycles, (VALUES (1), (3), (5)) r(d)
  WHERE failed AND NOT ({_TRAIN}) AND {_arm(SEED, 'customer_id', CONTROL)} = 'control'),
pl AS (SELECT p.cycle_id, p.arm, p.slot, c.amount_paise, p.slot IS NOT NULL AND {v.exec_legal('rail', 'due_at + p.slot * INTERVAL 1 HOUR')}
    AND p.slot >= 25 AND p.slot < 168 AS legal, {_PRESENT.replace('slot', 'p.slot').replace('cycle_id', 'c.cycle_id')} AS present
  FROM plan p JOIN ev_cycles c ON c.cycle_id = p.cycle_id),
hits AS (SELECT cycle_id, arm, any_value(amount_paise) AS amount_paise, min(CASE WHEN legal AND present THEN slot END) AS hit FROM pl GROUP BY ALL),
sc AS (SELECT h.cycle_id, h.arm, h.amount_paise, h.hit IS NOT NULL AS recovered,
    count(CASE WHEN legal AND slot <= coalesce(hit, 999) THEN 1 END) AS fired,
    count(CASE WHEN NOT legal AND slot IS NOT NULL AND slot <= coalesce(hit, 999) THEN 1 END) AS denied
  FROM hits h JOIN pl USING (cycle_id) GROUP BY ALL)""")


@query("run_arms", _replay_sql() + """
SELECT arm, count(*) AS n, count(CASE WHEN recovered THEN 1 END) AS recovered,
  CAST(sum(CASE WHEN recovered THEN amount_paise ELSE 0 END) AS BIGINT) AS recovered_paise,
  CAST(sum(fired) AS BIGINT) AS fired, CAST(sum(denied) AS BIGINT) AS denied FROM sc GROUP BY arm""")
def run_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arm_totals(replay(spark, sf_dir))


@query("flat_prior_ablation", _replay_sql("CASE WHEN l.legal THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END") + """
SELECT arm, count(*) AS n, count(CASE WHEN recovered THEN 1 END) AS recovered,
  CAST(sum(CASE WHEN recovered THEN amount_paise ELSE 0 END) AS BIGINT) AS recovered_paise,
  CAST(sum(fired) AS BIGINT) AS fired, CAST(sum(denied) AS BIGINT) AS denied FROM sc GROUP BY arm""")
def flat_prior_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same replay with the model replaced by a constant; compare with run_arms."""
    return _arm_totals(replay(spark, sf_dir, flat=0.6))


def _rate_sql(p: str | None = None) -> str:
    return _replay_sql(p) + """
SELECT avg(CASE WHEN recovered THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (arm = 'treatment')
  - avg(CASE WHEN recovered THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (arm = 'control') AS lift FROM sc"""


@query("ablation_lift", f"""
SELECT round(m.lift, 6) AS model_lift, round(f.lift, 6) AS flat_lift, round(m.lift - f.lift, 6) AS lift_from_model
FROM ({_rate_sql()}) m, ({_rate_sql("CASE WHEN l.legal THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END")}) f""")
def ablation_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the lift over control the model brings, and how much any legal schedule would."""
    lifts = []
    for name, flat in (("model_lift", None), ("flat_lift", 0.6)):
        totals = _arm_totals(replay(spark, sf_dir) if flat is None else replay(spark, sf_dir, flat=flat))
        rate = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("recovered") / F.col("n")))
        lifts.append(totals.agg((rate("treatment") - rate("control")).alias(name)))
    both = lifts[0].withColumn("flat_lift", lifts[1].scalar())
    return both.select(*[F.round(c, 6).alias(c) for c in ("model_lift", "flat_lift")], F.round(F.col("model_lift") - F.col("flat_lift"), 6).alias("lift_from_model"))


KNOBS = [(1.0, 1.0, 1.0), (2.0, 1.0, 1.0), (1.0, 3.0, 0.5), (4.0, 2.0, 2.0)]


@query("policy_sweep", v.with_(v.CYCLES, CPRIORS, _slots_sql("failed", budget="2"), """
kn(knob, cm, lam, mu) AS (VALUES (0, 1.0, 1.0, 1.0), (1, 2.0, 1.0, 1.0), (2, 1.0, 3.0, 0.5), (3, 4.0, 2.0, 2.0)),
ks AS (SELECT sl.*, knob, cm, lam, mu FROM sl, kn)""", _layers(
    2, "ks", "0.04 * mu", lambda b: f"round_even({_cost(b)} * cm * lam, 0)::DOUBLE", "cycle_id, knob")) + """
SELECT knob, count(*) AS cycles, count(next_2) AS acted, round(1 - count(next_2) / count(*), 6) AS stop_rate,
  round(avg(next_2), 6) AS mean_slot, count(DISTINCT next_2) AS distinct_slots FROM v2 WHERE slot = 0 GROUP BY knob""")
def policy_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each (cost, annoyance, revocation) knob row applied to every failed cycle."""
    rows = F.array(*[
        F.struct(F.lit(i).alias("knob"), *[F.lit(x).alias(n) for n, x in zip(("cm", "lam", "mu"), k, strict=True)])
        for i, k in enumerate(KNOBS)
    ])
    cycles = failed_cycles(spark, sf_dir).withColumn("budget", F.lit(2)).select("cycle_id", "mcc", "rail", "amount_paise", "due_at", "p_rec", "budget")
    learned = cycle_priors(td.billing_cycles(spark, sf_dir))
    keys = ["cycle_id", "knob", "cm", "lam", "mu"]
    grid = decision_grid(cycles, learned, ["cycle_id"])
    # A cycle meets the knobs after it moved.
    tuned = planning.with_costs(grid.cycles.select("*", F.inline(rows)), 2).withColumn("dr", F.lit(planning.DELTA_R) * F.col("mu"))
    for b in (1, 2):
        tuned = tuned.withColumn(f"cost_{b}", F.bround(F.col(f"cost_{b}") * F.col("cm") * F.col("lam"), 0))
    tuned = tuned.withColumn("continuation_paise", F.col("amount_paise") * planning.W_MULTIPLE)
    decided = planning.decide(grid.of(tuned), keys, max_budget=2)
    return decided.groupBy("knob").agg(
        F.count("*").alias("cycles"), F.count("chosen_slot").alias("acted"),
        F.round(F.lit(1.0) - F.count("chosen_slot") / F.count("*"), 6).alias("stop_rate"),
        F.round(F.avg("chosen_slot"), 6).alias("mean_slot"), F.count_distinct("chosen_slot").alias("distinct_slots"),
    )


@query("idem_key", v.with_(v.CYCLES, """
k AS (SELECT cycle_id, substr(sha256(cycle_id || ':' || (cycle_id % 4) || ':debit_attempt:' || amount_paise), 1, 32) AS idem_key FROM ev_cycles),
j AS (SELECT *, sha256('jitter:' || idem_key) AS h FROM k)""") + """
SELECT cycle_id, idem_key, CAST((CAST(('0x' || substr(h, 1, 8)) AS HUGEINT) * 4294967296 + CAST(('0x' || substr(h, 9, 8)) AS HUGEINT)) % 300 AS BIGINT) AS jitter_s
FROM j""")
def idem_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = hashing.idem_key(F.col("cycle_id"), F.col("cycle_id") % 4, F.lit("debit_attempt"), F.col("amount_paise"))
    keyed = td.billing_cycles(spark, sf_dir).select("cycle_id", key.alias("idem_key"))
    return keyed.withColumn("jitter_s", hashing.jitter_seconds(F.col("idem_key"), 300))


@query("notice_fields", """
SELECT c_custkey AS mandate_id, CASE WHEN c_custkey % 5 = 0 THEN 'whatsapp' WHEN c_custkey % 3 = 0 THEN 'whatsapp' ELSE 'sms' END AS channel,
  '160' AS header_series, '/v1/mandates/' || c_custkey || '/opt-out' AS opt_out_path,
  CASE WHEN c_custkey % 10 >= 5 THEN '/v1/cycles/' || c_custkey || '/pay' END AS pay_now_link FROM customer""")
def notice_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    rows = td.table(spark, sf_dir, "customer").select(
        key.alias("mandate_id"), F.when(key % 3 == 0, "whatsapp").when(key % 3 == 1, "voice").alias("preferred"),
        (key % 5 == 0).alias("dnd"), ((key % 10) / 10).alias("risk"),
    )
    return planning.notice_fields(rows).drop("preferred", "dnd", "risk")
