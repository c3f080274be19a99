"""From the event log to scheduled debits and notices, as one lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redebit.functions import causes
from redebit.operators import legality, planning, priors, projection
from redebit.plans import views_sql as v
from redebit.plans.ingest import PROJECTED
from redebit.plans.planning import _layers, open_actions
from redebit.plans.priors import OUTCOMES, PRIORS, SEGS
from redebit.plans.registry import query
from redebit.session import checkpointed
from redebit.sources import testdata as td


def plan_retries(events: DataFrame, cycles: DataFrame, actions: DataFrame, published: DataFrame, now: Column,
                 horizon: int = legality.PLAN_HOURS) -> DataFrame:
    """Candidates, their legal hours, the best slot, and a lawful notice for it.

    Decline codes and curves join at cycle level; one hash distribution by cycle then serves
    the slot windows of all budgets.
    """
    open_cycles = planning.retry_candidates(cycles, actions, now)
    coded = open_cycles.join(planning.latest_decline_code(events), "mandate_id", "left").select(
        "cycle_ref", "tenant_id", "mandate_id", "mcc", "rail", "amount_paise", "deadline_at", "attempts_used",
        F.col("last_failure_at").alias("decided_at"), F.col("budget_left").alias("budget"),
        causes.p_recoverable(F.col("decline_code")).alias("p_rec"),
    )
    costed = planning.with_costs(coded)
    slots = legality.explode_slots(priors.with_curve(costed, published), ["cycle_ref"], horizon)
    masked = legality.legality_mask(slots)
    lawful = F.col("legal") & legality.notice_feasible(F.col("decided_at"), F.col("slot"))
    at = legality.slot_time(F.col("decided_at"), F.col("slot"))
    rows = masked.withColumn("legal", lawful).where("legal OR slot = 0").select(
        "cycle_ref", "tenant_id", "mandate_id", "decided_at", "attempts_used", "slot", "legal",
        (priors.slot_presence(at) * F.col("p_rec")).alias("p"), F.lit(planning.DELTA_R).alias("dr"), "amount_paise",
        (F.col("amount_paise") * planning.W_MULTIPLE).alias("continuation_paise"), "budget",
        *[c for c in costed.columns if c.startswith("cost_")],
    )
    keys = ["cycle_ref", "tenant_id", "mandate_id", "decided_at", "attempts_used"]
    decided = planning.decide(rows, keys, in_order=True)
    debits = planning.scheduled_actions(decided)
    announced = legality.plan_notice(
        debits.withColumn("debit_at", F.col("fire_at")).withColumn("predicted_funding_at", F.lit(None).cast("timestamp"))
        .withColumn("messages_30d", F.lit(0))
    )
    return announced.where("send_at IS NOT NULL")


_SQL = v.with_(v.EVENTS, PROJECTED, OUTCOMES, SEGS, PRIORS, f"""
codes AS (SELECT mandate_id, arg_max_null(decline_code, {{'a': occurred_at, 'b': event_id}}) AS code FROM ev_events
  WHERE event_type = 'payment.failed' GROUP BY mandate_id),
cand AS (SELECT p.*, c.code, p.last_failure_at AS dec_at, p.attempt_budget - p.attempts_used AS budget FROM proj p LEFT JOIN codes c USING (mandate_id)
  WHERE state = 'executing' AND attempts_used < attempt_budget AND deadline_at > TIMESTAMP '2024-01-02' AND mandate_id % 3 <> 0),
base AS (SELECT c.*, s AS slot, dec_at + s * INTERVAL 1 HOUR AS ats, {v.minute_ist('dec_at')} AS dm FROM cand c, range(720) r(s)),
lg AS (SELECT *, {v.exec_legal('rail', 'ats')} AND slot >= 24 AND ats < deadline_at
  AND (NOT (rail = 'upi_autopay' AND dm >= 1430) OR NOT (rail = 'upi_autopay' AND dm >= 1430 AND {v.day_ist('ats')} = {v.day_ist('dec_at')} + 1))
  AND slot >= 24 + CASE WHEN dm >= 480 AND dm < 1140 THEN 0 WHEN dm < 480 THEN ceil((480 - dm) / 60.0) ELSE ceil((1920 - dm) / 60.0) END AS legal FROM base),
sl AS (SELECT l.cycle_ref, l.tenant_id, l.dec_at, l.attempts_used, l.slot, l.legal, l.budget, CAST(l.amount_paise AS DOUBLE) AS a, l.amount_paise,
    l.amount_paise * 12.0::DOUBLE AS w,
    CASE WHEN p.n_obs IS NULL THEN gp.g ELSE least(greatest(p.n_obs / (p.n_obs + 5.0) * p.hazard + (1 - p.n_obs / (p.n_obs + 5.0)) * gp.g, 1e-6), 1 - 1e-6) END
      * {v.p_recoverable('l.code')} AS p
  FROM lg l CROSS JOIN gp LEFT JOIN priors p ON p.mcc = l.mcc AND p.ticket_band = {v.ticket_band('l.amount_paise')} AND p.rail = l.rail
    AND p.day_of_month = {v.dom_ist('l.ats')} AND p.hour_band = {v.hour_band('l.ats')}
  WHERE l.legal OR l.slot = 0)""", _layers(4, keys="cycle_ref"), f"""
dec AS (SELECT *, CASE budget WHEN 1 THEN next_1 WHEN 2 THEN next_2 WHEN 3 THEN next_3 WHEN 4 THEN next_4 END AS chosen FROM v4 WHERE slot = 0),
deb AS (SELECT *, dec_at + CAST(chosen AS BIGINT) * INTERVAL 1 HOUR AS fire_at,
  substr(sha256(cycle_ref || ':' || (attempts_used + 1) || ':debit_attempt:' || amount_paise), 1, 32) AS idem_key FROM dec WHERE chosen IS NOT NULL),
ntc AS (SELECT cycle_ref, min(h) AS h FROM deb, range(24, 97) r(h) WHERE fire_at - h * INTERVAL 1 HOUR >= dec_at
  AND {v.minute_ist('fire_at - h * INTERVAL 1 HOUR')} BETWEEN 480 AND 1139 GROUP BY 1)""")


@query("retry_plan", _SQL + """
SELECT d.cycle_ref, d.tenant_id, CAST(d.chosen AS INT) AS chosen_slot, epoch_us(fire_at) AS fire_us, CAST(n.h AS INT) AS hours_of_notice, idem_key
FROM deb d JOIN ntc n USING (cycle_ref)""")
def retry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Re-deliveries go once, before cycles and outcomes are built from the same events.
    events = projection.unique_events(td.payment_events(spark, sf_dir))
    # The projected cycles feed the priors, the candidates and the open actions.
    cycles = checkpointed(projection.project_cycles(events))
    counts = priors.segment_counts(priors.outcomes_with_segment(events, cycles))
    published = checkpointed(priors.segment_priors(counts, min_cohort=2, min_contributors=1)[0])
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    planned = plan_retries(events, cycles, open_actions(cycles), published, now)
    return planned.select(
        "cycle_ref", "tenant_id", "chosen_slot", F.unix_micros("fire_at").alias("fire_us"), "hours_of_notice", "idem_key"
    )
