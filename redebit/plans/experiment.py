"""Experiment, portfolio and survival queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redebit.functions import hashing, stats
from redebit.operators import estimators, portfolio, survival
from redebit.plans import views_sql as v
from redebit.plans.registry import query
from redebit.sources import testdata as td

SEED, CONTROL = "recovery-2026", 0.5

PORT = """
port AS (
  SELECT c.*, CASE WHEN failed THEN cycle_id % 3 + 1 ELSE 0 END AS attempts_used,
    CASE WHEN recovered THEN amount_paise ELSE 0 END AS recovered_paise,
    due_at >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY AS alive
  FROM ev_cycles_t c)"""


def portfolio_cycles(spark: SparkSession, sf_dir: str, with_tenant: bool = True) -> DataFrame:
    """Billing cycles with attempts, money and whether the mandate was recently alive."""
    cycles = td.billing_cycles(spark, sf_dir, with_tenant=with_tenant)
    newest = td.table(spark, sf_dir, "orders").agg(F.max(F.unix_seconds(F.col("o_orderdate").cast("timestamp")))).scalar()
    return cycles.select(
        "*",
        F.when(F.col("failed"), F.col("cycle_id") % 3 + 1).otherwise(0).alias("attempts_used"),
        F.when(F.col("recovered"), F.col("amount_paise")).otherwise(0).alias("recovered_paise"),
        (F.unix_seconds("due_at") >= newest - 365 * td.DAY).alias("alive"),
    )


def _bucket(seed: str, key: str) -> str:
    return f"(CAST(('0x' || substr(sha256('{seed}:' || {key}), 1, 8)) AS BIGINT) % 10000)"


def _arm(seed: str, key: str, pct: float) -> str:
    return f"(CASE WHEN {_bucket(seed, key)} < {pct * 10000} THEN 'control' ELSE 'treatment' END)"


def _unit(salt: str, *parts: str) -> str:
    joined = " || '|' || ".join([f"'{salt}'", *parts])
    return f"(CAST(('0x' || substr(sha256({joined}), 1, 13)) AS BIGINT) / 4503599627370496.0)"


def _rollout(share: float, holdout: float) -> str:
    return (
        f"(CASE WHEN {_unit('share', 'tenant_id', 'mandate_id')} >= {share} THEN 'excluded' "
        f"WHEN {_unit('holdout', 'tenant_id', 'mandate_id')} < {holdout} THEN 'holdout' "
        "ELSE 'treatment' END)"
    )


@query("assign_arm", f"""
SELECT c_custkey AS customer_id, {_arm(SEED, 'c_custkey', 0.3)} AS arm,
  CAST(CASE {_arm(SEED, 'c_custkey', 0.3)} WHEN 'control' THEN 0.3 ELSE 0.7 END AS DOUBLE) AS propensity
FROM customer""")
def assign_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    arm = hashing.assign_arm(F.col("c_custkey"), SEED, 0.3)
    return td.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), arm.alias("arm"),
        F.round(hashing.propensity(arm, 0.3), 6).alias("propensity"),
    )


@query("rollout_arm", f"""
WITH m AS (SELECT c_custkey AS mandate_id, 'n' || c_nationkey AS tenant_id FROM customer)
SELECT mandate_id, {_rollout(0.01, 0.0)} AS canary, {_rollout(0.1, 0.15)} AS ramp,
  {_rollout(1.0, 0.15)} AS full_stage FROM m""")
def rollout_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    mandates = td.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("mandate_id"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("tenant_id"),
    )
    keys = (F.col("tenant_id"), F.col("mandate_id"))
    return mandates.select(
        "mandate_id",
        portfolio.rollout_arm("canary", *keys).alias("canary"),
        portfolio.rollout_arm("ramp", *keys).alias("ramp"),
        portfolio.rollout_arm("full", *keys).alias("full_stage"),
    )


_SUMMARY = f"""
totals AS (
  SELECT tenant_id, mandate_id, bool_or(alive) AS alive,
    count(CASE WHEN attempts_used > 0 THEN 1 END) AS failed_cycles,
    count(CASE WHEN attempts_used > 0 AND recovered_paise > 0 THEN 1 END) AS recovered_cycles,
    sum(CASE WHEN attempts_used > 0 THEN recovered_paise ELSE 0 END) AS recovered_paise,
    sum(attempts_used) AS attempts
  FROM port GROUP BY ALL),
summary AS (
  SELECT tenant_id, {_rollout(1.0, 0.15)} AS arm, count(*) AS mandates,
    count(CASE WHEN alive THEN 1 END) AS alive_mandates,
    CAST(sum(failed_cycles) AS BIGINT) AS failed_cycles,
    CAST(sum(recovered_cycles) AS BIGINT) AS recovered_cycles,
    CAST(sum(recovered_paise) AS BIGINT) AS recovered_paise,
    CAST(sum(attempts) AS BIGINT) AS attempts
  FROM totals GROUP BY ALL)"""

_CELLS = ", ".join(
    f"coalesce(max(CASE WHEN arm = '{arm}' THEN {f} END), 0) AS {p}_{f}"
    for p, arm in (("t", "treatment"), ("h", "holdout"))
    for f in ("mandates", "alive_mandates", "failed_cycles", "recovered_cycles", "recovered_paise", "attempts")
)
_RATES = f"""
pair AS (SELECT tenant_id, {_CELLS} FROM summary GROUP BY tenant_id),
rates AS (
  SELECT *, CASE WHEN t_failed_cycles = 0 THEN 0 ELSE t_recovered_cycles / t_failed_cycles END AS tr,
    CASE WHEN h_failed_cycles = 0 THEN 0 ELSE h_recovered_cycles / h_failed_cycles END AS hr,
    CASE WHEN t_mandates = 0 THEN 0 ELSE t_alive_mandates / t_mandates END AS ts,
    CASE WHEN h_mandates = 0 THEN 0 ELSE h_alive_mandates / h_mandates END AS hs,
    CASE WHEN t_recovered_cycles = 0 THEN 0 ELSE t_recovered_paise / t_recovered_cycles END AS ticket
  FROM pair),
ses AS (
  SELECT *, CASE WHEN t_failed_cycles >= 30 AND h_failed_cycles >= 30 THEN 1.959963985 *
      sqrt(tr * (1 - tr) / t_failed_cycles + hr * (1 - hr) / h_failed_cycles) END AS rse,
    CASE WHEN t_mandates >= 30 AND h_mandates >= 30 THEN 1.959963985 *
      sqrt(ts * (1 - ts) / t_mandates + hs * (1 - hs) / h_mandates) END AS sse
  FROM rates),
mp AS (
  SELECT tenant_id, t_mandates AS treatment_n, h_mandates AS holdout_n,
    round(tr, 4) AS treatment_recovery_rate, round(hr, 4) AS holdout_recovery_rate,
    CAST(trunc((tr - hr) * (t_failed_cycles * ticket)) AS BIGINT) AS incremental_recovery_paise,
    CAST(trunc((tr - hr - rse) * (t_failed_cycles * ticket)) AS BIGINT) AS recovery_low_paise,
    CAST(trunc((tr - hr + rse) * (t_failed_cycles * ticket)) AS BIGINT) AS recovery_high_paise,
    CASE WHEN t_mandates >= 30 AND h_mandates >= 30 THEN round((ts - hs) * 100, 2) END
      AS incremental_survival_pts,
    round((ts - hs - sse) * 100, 2) AS survival_low_pts,
    round((ts - hs + sse) * 100, 2) AS survival_high_pts,
    CAST(coalesce(round(h_mandates * 100 / nullif(t_mandates + h_mandates, 0)), 0) AS BIGINT)
      AS holdout_pct
  FROM ses)"""
_P = (v.CYCLES_T, PORT, _SUMMARY)


@query("arm_summary", v.with_(*_P) + "SELECT * FROM summary")
def arm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.arm_summary(portfolio_cycles(spark, sf_dir), "full")


@query("matched_pair", v.with_(*_P, _RATES) + "SELECT * FROM mp")
def matched_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.matched_pair(portfolio.arm_summary(portfolio_cycles(spark, sf_dir), "full"))


@query("fleet_pair", v.with_(*_P, _RATES) + """
SELECT CAST(sum(incremental_recovery_paise) AS BIGINT) AS incremental_recovery_paise,
  round(avg(incremental_survival_pts), 2) AS incremental_survival_pts,
  CAST(sum(treatment_n) AS BIGINT) AS treatment_n, CAST(sum(holdout_n) AS BIGINT) AS holdout_n,
  CAST(round(sum(holdout_n) * 100 / sum(treatment_n + holdout_n)) AS BIGINT) AS holdout_pct
FROM mp""")
def fleet_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.fleet_pair(matched_pair(spark, sf_dir))


_INTERVENTIONS = """
interventions AS (
  SELECT 'n' || (user_id % 25) AS tenant_id, event_id,
    CASE event_type WHEN 'error' THEN 'pdn_notice' WHEN 'view' THEN 'date_change' ELSE 'retry' END AS kind
  FROM events)"""


def interventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return td.table(spark, sf_dir, "events").select(
        F.concat(F.lit("n"), (F.col("user_id") % 25).cast("string")).alias("tenant_id"), "event_id",
        F.when(kind == "error", "pdn_notice").when(kind == "view", "date_change").otherwise("retry").alias("kind"),
    )


@query("efficiency", v.with_(*_P, _RATES, _INTERVENTIONS, """
cnt AS (SELECT tenant_id, count(CASE WHEN kind = 'date_change' THEN 1 END) AS permanent_fixes,
    count(CASE WHEN kind = 'pdn_notice' THEN 1 END) AS notices FROM interventions GROUP BY 1)""") + """
SELECT p.tenant_id, round(t_attempts / nullif(t_recovered_cycles, 0), 2) AS attempts_per_recovery,
  round(h_attempts / nullif(h_recovered_cycles, 0), 2) AS attempts_per_recovery_baseline,
  coalesce(permanent_fixes, 0) AS permanent_fixes,
  round(coalesce(notices, 0) / greatest(t_failed_cycles, 1), 2) AS messages_per_customer_cycle
FROM pair p LEFT JOIN cnt c ON c.tenant_id = p.tenant_id""")
def efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = portfolio.arm_summary(portfolio_cycles(spark, sf_dir), "full")
    return portfolio.efficiency(summary, interventions(spark, sf_dir))


def checked_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions with two recorded rule checks each."""
    decisions = td.gate_decisions(spark, sf_dir)
    checks = F.array(
        F.struct(
            F.lit("RULE-A").alias("rule_id"),
            F.when(F.col("part") % 50 == 0, "DENY").otherwise("ALLOW").alias("verdict"),
        ),
        F.struct(F.lit("RULE-B").alias("rule_id"), F.col("verdict").alias("verdict")),
    )
    return decisions.withColumn("checks", checks).withColumn(
        "tenant_id", F.concat(F.lit("n"), (F.col("lane") % 25).cast("string"))
    )


_GUARD = """
viol AS (
  SELECT 'n' || (lane % 25) AS tenant_id,
    count(CASE WHEN verdict = 'ALLOW' AND part % 50 = 0 THEN 1 END) AS violations
  FROM ev_decisions GROUP BY 1),
guard AS (
  SELECT s.tenant_id, k.key,
    CASE k.key WHEN 'compliance_violations' THEN coalesce(violations, 0)
      WHEN 'revocation_vs_control' THEN round(hs - ts, 4)
      ELSE CAST(t_recovered_paise - h_recovered_paise AS DOUBLE) END AS value
  FROM ses s LEFT JOIN viol USING (tenant_id),
    (VALUES ('compliance_violations'), ('revocation_vs_control'), ('net_value_paise')) k(key)),
guards AS (
  SELECT *, CASE WHEN key = 'net_value_paise' THEN CASE WHEN value <= 0 THEN 'breach' ELSE 'ok' END
    ELSE CASE WHEN value > 0 THEN 'breach' ELSE 'ok' END END AS status FROM guard)"""


def _guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = portfolio.arm_summary(portfolio_cycles(spark, sf_dir), "full")
    return portfolio.guardrails(summary, checked_decisions(spark, sf_dir))


@query("guardrails", v.with_(*_P, _RATES, v.DECISIONS, _GUARD) + "SELECT tenant_id, key, value, status FROM guards")
def guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _guardrails(spark, sf_dir)


_REPORTED = (
    "treatment_recovery_rate", "holdout_recovery_rate", "incremental_recovery_paise", "recovery_low_paise", "recovery_high_paise",
    "incremental_survival_pts", "survival_low_pts", "survival_high_pts", "attempts_per_recovery", "attempts_per_recovery_baseline",
)


@query("tenant_report", v.with_(*_P, _RATES, v.DECISIONS, _GUARD, """
br AS (SELECT tenant_id, string_agg(key, ',' ORDER BY key) AS breached FROM guards WHERE status = 'breach' GROUP BY 1),
tr AS (SELECT m.*, round(t_attempts / nullif(t_recovered_cycles, 0), 2) AS attempts_per_recovery,
    round(h_attempts / nullif(h_recovered_cycles, 0), 2) AS attempts_per_recovery_baseline, coalesce(breached, '') AS breached,
    (holdout_n - (treatment_n + holdout_n) * 0.15::DOUBLE) ** 2 / ((treatment_n + holdout_n) * 0.15::DOUBLE)
    + (treatment_n - (treatment_n + holdout_n) * 0.85::DOUBLE) ** 2 / ((treatment_n + holdout_n) * 0.85::DOUBLE) AS chi
  FROM mp m JOIN pair p ON p.tenant_id = m.tenant_id LEFT JOIN br ON br.tenant_id = m.tenant_id),
tv AS (SELECT *, coalesce(chi <= 10.827566170662733, FALSE) AS valid FROM tr)""") + f"""
SELECT tenant_id, valid, round(chi, 6) AS chi_square, {', '.join(f'CASE WHEN valid THEN {c} END AS {c}' for c in _REPORTED)}, breached,
  CASE WHEN NOT valid THEN 'invalid split' WHEN breached <> '' THEN 'guardrail breached'
    WHEN recovery_low_paise > 0 AND incremental_survival_pts >= 0 THEN 'holds' ELSE 'no defensible effect' END AS verdict
FROM tv""")
def tenant_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = portfolio.arm_summary(portfolio_cycles(spark, sf_dir), "full")
    rails = portfolio.guardrails(summary, checked_decisions(spark, sf_dir))
    found = portfolio.tenant_report(summary, rails, interventions(spark, sf_dir), portfolio.STAGES["full"][1])
    return found.withColumn("chi_square", F.round("chi_square", 6))


@query("fleet_guardrails", v.with_(*_P, _RATES, v.DECISIONS, _GUARD) + """
SELECT key, CASE WHEN key = 'revocation_vs_control' THEN max(value) ELSE sum(value) END AS value,
  CASE key WHEN 'net_value_paise' THEN CASE WHEN sum(value) <= 0 THEN 'breach' ELSE 'ok' END
    WHEN 'compliance_violations' THEN CASE WHEN sum(value) <> 0 THEN 'breach' ELSE 'ok' END
    ELSE max(CASE WHEN status <> 'ok' THEN 'breach' ELSE 'a' END) END AS status
FROM guards GROUP BY key""")
def fleet_guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.fleet_guardrails(_guardrails(spark, sf_dir))


@query("rail_mix", v.with_(v.CYCLES_T, """
m AS (SELECT DISTINCT tenant_id, mandate_id, rail FROM ev_cycles_t),
g AS (SELECT tenant_id, rail, count(*) AS mandates FROM m GROUP BY GROUPING SETS ((tenant_id, rail), (rail)))""") + """
SELECT tenant_id, rail, mandates, round(mandates / sum(mandates) OVER (PARTITION BY tenant_id), 4) AS share
FROM g""")
def rail_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mandates = td.billing_cycles(spark, sf_dir, with_tenant=True).select("tenant_id", "mandate_id", "rail").distinct()
    return portfolio.rail_mix(mandates)


@query("tenant_overview", v.with_(v.EVENTS, v.DECISIONS, """
ev AS (SELECT tenant_id, count(*) AS events, count(DISTINCT mandate_id) AS mandates,
    count(DISTINCT cycle_ref) AS cycles, count(CASE WHEN event_type = 'payment.failed' THEN 1 END) AS failures,
    CAST(sum(CASE WHEN event_type = 'payment.captured' THEN amount_paise ELSE 0 END) AS BIGINT) AS captured_paise
  FROM ev_events GROUP BY 1),
dc AS (SELECT tenant_id, count(*) AS decisions, count(CASE WHEN verdict = 'ALLOW' THEN 1 END) AS allowed,
    count(CASE WHEN verdict <> 'ALLOW' THEN 1 END) AS refused FROM ev_decisions GROUP BY 1)""") + """
SELECT * FROM ev FULL JOIN dc USING (tenant_id)""")
def tenant_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    per_cycle = td.payment_events(spark, sf_dir).groupBy("tenant_id", "mandate_id", "cycle_ref").agg(
        F.count("*").alias("events"), F.count_if(kind == "payment.failed").alias("failures"),
        F.sum(F.when(kind == "payment.captured", F.col("amount_paise")).otherwise(0)).alias("captured_paise"),
    )
    per_mandate = per_cycle.groupBy("tenant_id", "mandate_id").agg(
        F.sum("events").alias("events"), F.count("*").alias("cycles"),
        F.sum("failures").alias("failures"), F.sum("captured_paise").alias("captured_paise"),
    )
    events = per_mandate.groupBy("tenant_id").agg(
        F.sum("events").alias("events"), F.count("*").alias("mandates"), F.sum("cycles").alias("cycles"),
        F.sum("failures").alias("failures"), F.sum("captured_paise").alias("captured_paise"),
    )
    verdict = F.col("verdict")
    decisions = td.gate_decisions(spark, sf_dir).groupBy("tenant_id").agg(
        F.count("*").alias("decisions"), F.count_if(verdict == "ALLOW").alias("allowed"),
        F.count_if(verdict != "ALLOW").alias("refused"),
    )
    return portfolio.tenant_overview({"events": events, "decisions": decisions})


UNITS = f"""
units AS (
  SELECT *, {_arm(SEED, 'customer_id', CONTROL)} AS arm FROM ev_cycles WHERE failed)"""


def failed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = td.billing_cycles(spark, sf_dir).where("failed")
    return estimators.with_arm(failed, SEED, CONTROL)


_COUNTS = """
SELECT count(CASE WHEN arm = 'treatment' THEN 1 END) AS n_t,
  count(CASE WHEN arm = 'treatment' AND recovered THEN 1 END) AS s_t,
  count(CASE WHEN arm = 'control' THEN 1 END) AS n_c,
  count(CASE WHEN arm = 'control' AND recovered THEN 1 END) AS s_c"""


def _lift_sql(source: str, keys: str = "") -> str:
    return f"""
SELECT {keys} n_t, s_t, n_c, s_c, round(p1 - p0, 6) AS lift, round(p1 - p0 - 1.96 * se, 6) AS low,
  round(p1 - p0 + 1.96 * se, 6) AS high,
  (p1 - p0 - 1.96 * se > 0) OR (p1 - p0 + 1.96 * se < 0) AS excludes_zero
FROM (SELECT *, s_t / n_t AS p1, s_c / n_c AS p0,
  sqrt(s_t / n_t * (1 - s_t / n_t) / n_t + s_c / n_c * (1 - s_c / n_c) / n_c) AS se FROM {source})"""


@query("incremental_lift", v.with_(v.CYCLES, UNITS, f"counts AS ({_COUNTS}, rail FROM units GROUP BY rail)")
       + _lift_sql("counts", "rail,"))
def incremental_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = estimators.arm_counts(failed_units(spark, sf_dir), F.col("recovered"), ["rail"])
    lifted = estimators.incremental_lift(counts)
    return lifted.select(
        "rail", "n_t", "s_t", "n_c", "s_c", F.round("lift", 6).alias("lift"),
        F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "excludes_zero",
    )


@query("srm_check", f"""
WITH c AS (SELECT {_arm(SEED, 'c_custkey', 0.3)} AS arm, c_nationkey FROM customer),
n AS (SELECT c_nationkey AS nation, count(CASE WHEN arm = 'treatment' THEN 1 END) AS n_t,
  count(CASE WHEN arm = 'control' THEN 1 END) AS n_c FROM c GROUP BY ALL),
x AS (SELECT *, (n_c - (n_t + n_c) * 0.3) ** 2 / ((n_t + n_c) * 0.3)
  + (n_t - (n_t + n_c) * 0.7) ** 2 / ((n_t + n_c) * 0.7) AS chi FROM n)
SELECT nation, n_t, n_c, round(CAST(chi AS DOUBLE), 6) AS chi_square, chi <= 10.827566170662733 AS srm_passed
FROM x""")
def srm_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = td.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("nation")
    )
    counts = estimators.arm_counts(estimators.with_arm(customers, SEED, 0.3), F.lit(True), ["nation"])
    return estimators.srm_check(counts, 0.3).select(
        "nation", "n_t", "n_c", F.round("chi_square", 6).alias("chi_square"), "srm_passed"
    )


_CUPED = f"""
cust AS (
  SELECT customer_id, CAST(sum(CASE WHEN recovered THEN amount_paise ELSE 0 END) AS DOUBLE) AS y,
    CAST(sum(CASE WHEN NOT failed THEN amount_paise ELSE 0 END) AS DOUBLE) AS x
  FROM ev_cycles GROUP BY 1),
m AS (SELECT covar_samp(y, x) / var_pop(x) AS theta, avg(x) AS mx FROM cust),
adj AS (SELECT {_arm(SEED, 'customer_id', CONTROL)} AS arm, theta, y, y - theta * (x - mx) AS a FROM cust, m)"""


@query("cuped", v.with_(v.CYCLES, _CUPED) + """
SELECT arm, count(*) AS n, round(any_value(theta), 6) AS theta, round(avg(y), 2) AS mean_y,
  round(avg(a), 2) AS mean_adjusted, round(1 - var_samp(a) / var_samp(y), 6) AS variance_reduction
FROM adj GROUP BY arm""")
def cuped(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles = td.billing_cycles(spark, sf_dir)
    units = cycles.groupBy("customer_id").agg(
        F.sum(F.when(F.col("recovered"), F.col("amount_paise")).otherwise(0)).cast("double").alias("y"),
        F.sum(F.when(~F.col("failed"), F.col("amount_paise")).otherwise(0)).cast("double").alias("x"),
    )
    adjusted = estimators.with_arm(estimators.cuped(units, "y", "x"), SEED, CONTROL)
    return adjusted.groupBy("arm").agg(
        F.count("*").alias("n"), F.round(F.any_value("theta"), 6).alias("theta"),
        F.round(F.avg("y"), 2).alias("mean_y"), F.round(F.avg("adjusted"), 2).alias("mean_adjusted"),
        F.round(F.lit(1.0) - F.var_samp("adjusted") / F.var_samp("y"), 6).alias("variance_reduction"),
    )


@query("ips", v.with_(v.CYCLES, UNITS, f"""
p AS (SELECT *, CASE WHEN {_bucket(SEED, 'customer_id')} % 20 = 0 THEN 0.005 ELSE 0.5 END AS prop FROM units)""") + """
SELECT rail, round(avg(CASE WHEN recovered THEN 1.0 ELSE 0.0 END / greatest(prop, 0.01)), 6) AS estimate,
  round(avg(CASE WHEN prop < 0.01 THEN 1.0 ELSE 0.0 END), 6) AS clipped_fraction FROM p GROUP BY rail""")
def ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rare = hashing.assignment_bucket(F.col("customer_id"), SEED) % 20 == 0
    propensity = F.when(rare, 0.005).otherwise(0.5)
    result = estimators.ips(
        failed_units(spark, sf_dir), F.col("recovered").cast("double"), propensity, ["rail"]
    )
    return result.select(
        "rail", F.round("estimate", 6).alias("estimate"), F.round("clipped_fraction", 6).alias("clipped_fraction")
    )


def recovery_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from failure to recovery, censored at 30."""
    units = failed_units(spark, sf_dir)
    days = F.when(F.col("recovered"), F.col("cycle_id") % 7 + 1).otherwise(30).cast("int")
    return units.select("arm", "rail", "recovered", "customer_id", days.alias("days"))


_DUR = "dur AS (SELECT *, CAST(CASE WHEN recovered THEN cycle_id % 7 + 1 ELSE 30 END AS INT) AS days FROM units)"
_KM = """
cnt AS (SELECT arm, rail, days AS t, count(*) AS n, count(CASE WHEN recovered THEN 1 END) AS events
  FROM dur GROUP BY ALL),
risk AS (SELECT *, CAST(sum(n) OVER (PARTITION BY arm, rail ORDER BY t DESC) AS BIGINT) AS at_risk FROM cnt),
km AS (SELECT arm, rail, t, at_risk, events, product(1.0 - events / at_risk) OVER (PARTITION BY arm, rail ORDER BY t)
  AS survival FROM risk WHERE events > 0)"""


@query("kaplan_meier", v.with_(v.CYCLES, UNITS, _DUR, _KM) + """
SELECT arm, rail, t, at_risk, events, round(survival, 6) AS survival FROM km""")
def kaplan_meier(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = survival.kaplan_meier(recovery_durations(spark, sf_dir), "days", F.col("recovered"), ["arm", "rail"])
    return curve.withColumn("survival", F.round("survival", 6))


_LIFE = """
life AS (
  SELECT customer_id, any_value(rail) AS rail,
    CAST(date_diff('day', min(due_at), max(due_at)) AS INT) AS days,
    max(due_at) < (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY AS died
  FROM ev_cycles GROUP BY customer_id)"""


def lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mandate lifetime in days and whether it has died."""
    cycles = portfolio_cycles(spark, sf_dir, with_tenant=False)
    span = F.unix_seconds(F.max("due_at")) - F.unix_seconds(F.min("due_at"))
    return cycles.groupBy("customer_id", "rail").agg(
        F.floor(span / td.DAY).cast("int").alias("days"), (~F.max("alive")).alias("died")
    )


@query("survival_summary", v.with_(v.CYCLES, _LIFE, """
cnt AS (SELECT rail, days AS t, count(*) AS n, count(CASE WHEN died THEN 1 END) AS events FROM life GROUP BY ALL),
risk AS (SELECT *, sum(n) OVER (PARTITION BY rail ORDER BY t DESC) AS at_risk FROM cnt),
km AS (SELECT rail, t, product(1.0 - events / at_risk) OVER (PARTITION BY rail ORDER BY t) AS s
  FROM risk WHERE events > 0)""") + """
SELECT rail, round(coalesce(arg_max(s, t) FILTER (t <= 1000), 1.0), 6) AS survival_1000d,
  CAST(coalesce(min(CASE WHEN s <= 0.5 THEN t END), -1) AS INT) AS median FROM km GROUP BY rail""")
def survival_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = survival.kaplan_meier(lifetimes(spark, sf_dir), "days", F.col("died"), ["rail"])
    at = survival.survival_at(curve, ["rail"], 1000).select("rail", F.round("survival", 6).alias("survival_1000d"))
    median = survival.median_survival(curve, ["rail"])
    return at.join(median, "rail").withColumn("median", F.coalesce("median", F.lit(-1)))


@query("log_rank", v.with_(v.CYCLES, UNITS, _DUR, """
cnt AS (SELECT rail, days AS t, count(CASE WHEN arm = 'treatment' THEN 1 END) AS na,
    count(CASE WHEN arm = 'control' THEN 1 END) AS nb,
    count(CASE WHEN arm = 'treatment' AND recovered THEN 1 END) AS da,
    count(CASE WHEN recovered THEN 1 END) AS d FROM dur GROUP BY ALL),
r AS (SELECT rail, da, d, CAST(sum(na) OVER w AS DOUBLE) AS ra, CAST(sum(nb) OVER w AS DOUBLE) AS rb
  FROM cnt WINDOW w AS (PARTITION BY rail ORDER BY t DESC)),
s AS (SELECT rail, CAST(sum(da) AS BIGINT) AS o, sum(ra * d / (ra + rb)) AS e,
  sum(ra * rb * d * (ra + rb - d) / ((ra + rb) * (ra + rb) * (ra + rb - 1))) AS var
  FROM r WHERE d > 0 AND ra + rb > 1 GROUP BY rail)""") + """
SELECT rail, o AS observed_a, round(e, 6) AS expected_a, round((o - e) ** 2 / var, 6) AS chi_square FROM s""")
def log_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = survival.log_rank(
        recovery_durations(spark, sf_dir), "days", F.col("recovered"), "arm", "treatment", "control", ["rail"]
    )
    return result.select(
        "rail", "observed_a", F.round("expected_a", 6).alias("expected_a"), F.round("chi_square", 6).alias("chi_square")
    )


_PREV = f"""
prev AS (
  SELECT cycle_id, {_arm(SEED, 'customer_id', CONTROL)} AS arm, amount_paise >= 1500000 AS high_risk,
    NOT failed AS ok, recovered FROM ev_cycles),
pc AS (SELECT arm, count(*) AS n, count(CASE WHEN ok THEN 1 END) AS prevented,
  count(CASE WHEN recovered THEN 1 END) AS recovered FROM prev WHERE high_risk GROUP BY arm)"""


def accounted_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles = estimators.with_arm(td.billing_cycles(spark, sf_dir), SEED, CONTROL)
    return cycles.select(
        "cycle_id", "arm", (F.col("amount_paise") >= 1_500_000).alias("high_risk"),
        (~F.col("failed")).alias("succeeded_first"),
        F.when(F.col("failed"), F.col("cycle_id") % 3 + 1).otherwise(0).alias("retries"),
        F.col("recovered").alias("recovered_after_retry"),
    )


@query("prevention_accounting", v.with_(v.CYCLES, _PREV, """
w AS (SELECT max(CASE WHEN arm = 'treatment' THEN n END) AS nt, max(CASE WHEN arm = 'control' THEN n END) AS nc,
  max(CASE WHEN arm = 'treatment' THEN prevented END) AS pt, max(CASE WHEN arm = 'control' THEN prevented END) AS pc,
  max(CASE WHEN arm = 'treatment' THEN recovered END) AS rt, max(CASE WHEN arm = 'control' THEN recovered END) AS rc
  FROM pc)""") + """
SELECT 'prevention' AS kind, round(pt / nt - pc / nc, 6) AS lift,
  round(pt / nt - pc / nc - 1.96 * sqrt(pt / nt * (1 - pt / nt) / nt + pc / nc * (1 - pc / nc) / nc), 6) AS low FROM w
UNION ALL SELECT 'recovery', round(rt / nt - rc / nc, 6),
  round(rt / nt - rc / nc - 1.96 * sqrt(rt / nt * (1 - rt / nt) / nt + rc / nc * (1 - rc / nc) / nc), 6) FROM w""")
def prevention_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = portfolio.prevention_counts(accounted_cycles(spark, sf_dir))

    def wide(field: str) -> list:
        return [
            F.max(F.when(F.col("arm") == arm, F.col(source))).alias(name)
            for arm, suffix in (("treatment", "t"), ("control", "c"))
            for source, name in (("n", f"n_{suffix}"), (field, f"s_{suffix}"))
        ]

    parts = [
        estimators.incremental_lift(counts.agg(*wide(field))).select(
            F.lit(kind).alias("kind"), F.round("lift", 6).alias("lift"), F.round("low", 6).alias("low")
        )
        for kind, field in (("prevention", "prevented"), ("recovery", "recovered"))
    ]
    return parts[0].unionByName(parts[1])


@query("prevention_overlap", v.with_(v.CYCLES) + "SELECT cycle_id FROM ev_cycles WHERE NOT failed AND recovered")
def prevention_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.prevention_overlap(accounted_cycles(spark, sf_dir))


@query("net_value", v.with_(v.CYCLES, """
parts AS (SELECT rail, CASE WHEN recovered THEN amount_paise ELSE 0 END AS rec,
  CASE WHEN recovered THEN amount_paise // 10 ELSE 0 END AS ret,
  CASE WHEN failed THEN 300 * (cycle_id % 3 + 1) ELSE 0 END AS fee, CASE WHEN failed THEN 25 ELSE 0 END AS msg,
  CASE WHEN failed AND NOT recovered THEN amount_paise // 5 ELSE 0 END AS churn FROM ev_cycles)""") + """
SELECT rail, CAST(sum(rec + ret - fee - msg - churn) AS BIGINT) AS net_paise,
  CAST(sum(rec) AS BIGINT) AS recovery_only_paise,
  CAST(sum(rec) - sum(rec + ret - fee - msg - churn) AS BIGINT) AS overstatement_paise,
  CASE WHEN sum(rec + ret - fee - msg - churn) <= 0 THEN 'breach' ELSE 'pass' END AS status
FROM parts GROUP BY rail""")
def net_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount, won, failed = F.col("amount_paise"), F.col("recovered"), F.col("failed")
    parts = td.billing_cycles(spark, sf_dir).select(
        "rail",
        F.when(won, amount).otherwise(0).alias("recovered_paise"),
        F.when(won, F.floor(amount / 10)).otherwise(0).alias("retained_paise"),
        F.when(failed, (F.col("cycle_id") % 3 + 1) * 300).otherwise(0).alias("fee_paise"),
        F.when(failed, 25).otherwise(0).cast("bigint").alias("message_paise"),
        F.when(failed & ~won, F.floor(amount / 5)).otherwise(0).alias("churn_paise"),
    )
    return portfolio.net_value(parts, ["rail"])


@query("active_experiment", """
WITH cfg AS (
  SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'n' || c_nationkey END AS tenant_id,
    'exp-' || c_custkey AS experiment_id, c_name AS seed, (c_custkey % 9 + 1) / 10.0 AS control_pct,
    c_custkey % 11 AS committed_at, c_acctbal > 7000 AS frozen FROM customer),
own AS (SELECT tenant_id, arg_max(experiment_id, {'a': committed_at, 'b': experiment_id}) AS e
  FROM cfg WHERE frozen AND tenant_id IS NOT NULL GROUP BY 1),
plat AS (SELECT arg_max(experiment_id, {'a': committed_at, 'b': experiment_id}) AS e
  FROM cfg WHERE frozen AND tenant_id IS NULL)
SELECT t.tenant_id, c.experiment_id, c.seed, round(CAST(c.control_pct AS DOUBLE), 6) AS control_pct,
  o.e IS NOT NULL AS is_own
FROM (SELECT 'n' || n_nationkey AS tenant_id FROM nation) t LEFT JOIN own o USING (tenant_id), plat p, cfg c
WHERE c.experiment_id = coalesce(o.e, p.e)""")
def active_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    configs = td.table(spark, sf_dir, "customer").select(
        F.when(c % 7 != 0, F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("tenant_id"),
        F.concat(F.lit("exp-"), c.cast("string")).alias("experiment_id"), F.col("c_name").alias("seed"),
        F.round((c % 9 + 1) / F.lit(10.0), 6).alias("control_pct"), (c % 11).alias("committed_at"),
        (F.col("c_acctbal") > 7000).alias("frozen"),
    )
    tenants = td.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("tenant_id")
    )
    return portfolio.active_experiment(configs, tenants)


FATIGUE_CAP = 3.0


@query("contact_guardrails", v.with_(v.EVENTS, v.CYCLES_T, f"""
mv AS (SELECT tenant_id, avg(n) AS value FROM (SELECT tenant_id, customer_id, cycle_ref, count(*) AS n FROM ev_events
  WHERE event_type = 'payment.failed' GROUP BY ALL) GROUP BY 1),
oc AS (SELECT DISTINCT tenant_id, customer_id, {_arm(SEED, 'customer_id', CONTROL)} AS arm FROM ev_cycles_t),
cr AS (SELECT tenant_id, coalesce(avg(CASE WHEN arm = 'treatment' THEN CAST(customer_id % 7 = 0 AS INT) END), 0) AS value,
  coalesce(avg(CASE WHEN arm = 'control' THEN CAST(customer_id % 7 = 0 AS INT) END), 0) AS threshold FROM oc GROUP BY 1)""") + f"""
SELECT tenant_id, 'message_volume' AS key, round(value, 6) AS value, {FATIGUE_CAP}::DOUBLE AS threshold, CASE WHEN value > {FATIGUE_CAP} THEN 'breach' ELSE 'ok' END AS status FROM mv
UNION ALL SELECT tenant_id, 'complaint_rate', round(value, 6), round(threshold, 6), CASE WHEN value > threshold THEN 'breach' ELSE 'ok' END FROM cr""")
def contact_guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed debits as the messages sent; every seventh customer as one who opted out."""
    messages = td.payment_events(spark, sf_dir).where("event_type = 'payment.failed'")
    customers = td.billing_cycles(spark, sf_dir, with_tenant=True).select("tenant_id", "customer_id").distinct()
    armed = estimators.with_arm(customers, SEED, CONTROL).withColumn("opted_out", F.col("customer_id") % 7 == 0)
    found = portfolio.contact_guardrails(messages, armed, FATIGUE_CAP)
    return found.select("tenant_id", "key", F.round("value", 6).alias("value"), F.round("threshold", 6).alias("threshold"), "status")


AA_SEEDS = [f"aa-{i}" for i in range(600)]
_AA = f"""
aac AS (SELECT customer_id, count(*) AS n, count(CASE WHEN recovered THEN 1 END) AS s FROM ev_cycles WHERE failed GROUP BY 1),
aas AS (SELECT 'aa-' || i AS seed, n, s, CAST(('0x' || substr(sha256('aa-' || i || ':' || customer_id), 1, 8))
  AS BIGINT) % 10000 < 5000 AS control FROM aac, range({len(AA_SEEDS)}) r(i)),
counts AS (SELECT seed, CAST(sum(CASE WHEN control THEN 0 ELSE n END) AS BIGINT) AS n_t, CAST(sum(CASE WHEN control THEN 0 ELSE s END) AS BIGINT) AS s_t,
  CAST(sum(CASE WHEN control THEN n ELSE 0 END) AS BIGINT) AS n_c, CAST(sum(CASE WHEN control THEN s ELSE 0 END) AS BIGINT) AS s_c FROM aas GROUP BY seed),
l AS ({_lift_sql('counts', 'seed,')})"""


def _aa_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = td.billing_cycles(spark, sf_dir).where("failed")
    return estimators.aa_coverage(failed, AA_SEEDS, F.col("recovered"))


@query("aa_coverage", v.with_(v.CYCLES, _AA) + """
SELECT seed, lift, NOT excludes_zero AS covers_zero FROM l""")
def aa_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aa_splits(spark, sf_dir).select("seed", F.round("lift", 6).alias("lift"), "covers_zero")


@query("aa_share", v.with_(v.CYCLES, _AA) + """
SELECT count(*) AS splits, round(avg(CASE WHEN excludes_zero THEN 0.0::DOUBLE ELSE 1.0 END), 6) AS coverage FROM l""")
def aa_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimators.aa_share(_aa_splits(spark, sf_dir)).select("splits", F.round("coverage", 6).alias("coverage"))


@query("group_split", v.with_(v.CYCLES) + f"""
SELECT {_unit('split', 'customer_id')} < 0.3 AS is_holdout, count(*) AS n,
  count(DISTINCT customer_id) AS customers FROM ev_cycles GROUP BY 1""")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_customer = td.billing_cycles(spark, sf_dir).groupBy("customer_id").agg(F.count("*").alias("n"))
    split = estimators.group_split(per_customer, "customer_id", 0.3)
    return split.groupBy("is_holdout").agg(F.sum("n").alias("n"), F.count("*").alias("customers"))


_EVIDENCE = """
evd AS (
  SELECT tenant_id, CASE CAST(substr(tenant_id, 2) AS INT) % 5 WHEN 0 THEN 'observe' WHEN 1 THEN 'shadow'
      WHEN 2 THEN 'canary' WHEN 3 THEN 'ramp' ELSE 'full' END AS stage,
    count(CASE WHEN failed THEN 1 END) / count(*) AS completeness,
    count(DISTINCT CASE WHEN failed THEN due_at END) AS days, count(*) AS n,
    count(CASE WHEN recovered THEN 1 END) AS rec
  FROM ev_cycles_t GROUP BY tenant_id)"""


@query("adoption_gate", v.with_(v.CYCLES_T, _EVIDENCE, """
g AS (SELECT tenant_id, stage, CASE stage
  WHEN 'observe' THEN concat_ws(',', CASE WHEN completeness < 0.999 THEN 'event completeness' END,
    CASE WHEN days < 7 THEN 'projection matches' END)
  WHEN 'shadow' THEN concat_ws(',', CASE WHEN n < 10000 THEN 'shadow decisions' END,
    CASE WHEN rec % 2 <> 0 THEN 'gate errors' END, CASE WHEN completeness >= 0.05 THEN 'calibration' END)
  WHEN 'canary' THEN concat_ws(',', CASE WHEN days < 14 THEN 'canary days' END,
    CASE WHEN rec % 3 <> 0 THEN 'double debits' END, CASE WHEN rec % 2 <> 0 THEN 'compliance violations' END,
    CASE WHEN completeness > 0.6 THEN 'revocation rate' END)
  WHEN 'ramp' THEN concat_ws(',', CASE WHEN rec <= 100 THEN 'recovery interval' END,
    CASE WHEN n % 2 = 0 THEN 'survival interval' END, CASE WHEN days < 30 THEN 'guardrail days' END)
  ELSE 'already at the final stage' END AS unmet FROM evd)""") + """
SELECT tenant_id, stage, unmet, unmet = '' AS may_advance FROM g""")
def adoption_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles = td.billing_cycles(spark, sf_dir, with_tenant=True)
    per_day = cycles.groupBy("tenant_id", "due_at").agg(
        F.count("*").alias("n"), F.count_if("failed").alias("f"), F.count_if("recovered").alias("r")
    )
    facts = per_day.groupBy("tenant_id").agg(
        F.sum("n").alias("n"), F.sum("f").alias("f"), F.sum("r").alias("r"), F.count_if(F.col("f") > 0).alias("days")
    )
    number = F.substring("tenant_id", 2, 9).cast("int") % 5
    share = F.col("f") / F.col("n")
    evidence = facts.select(
        "tenant_id",
        F.element_at(F.array(*[F.lit(s) for s in portfolio.STAGE_ORDER]), number + 1).alias("stage"),
        share.alias("event_completeness"), F.col("days").alias("projection_matches_days"),
        F.col("n").alias("shadow_decisions"), (F.col("r") % 2).alias("gate_errors"),
        share.alias("calibration_ece"), F.lit(True).alias("audit_report_produced"),
        F.col("days").alias("canary_days"), (F.col("r") % 3).alias("double_debits"),
        (F.col("r") % 2).alias("compliance_violations"), (share > 0.6).alias("revocation_above_baseline"),
        (F.col("r") > 100).alias("recovery_ci_excludes_zero"), (F.col("n") % 2 == 0).alias("survival_ci_negative"),
        F.col("days").alias("guardrails_green_days"),
    )
    return portfolio.adoption_gate(evidence).select(
        "tenant_id", "stage", F.concat_ws(",", "unmet").alias("unmet"), "may_advance"
    )


@query("batch_report", v.with_(v.CYCLES, UNITS, _DUR, f"counts AS ({_COUNTS} FROM units)", """
km0 AS (SELECT arm, days AS t, count(*) AS n, count(CASE WHEN recovered THEN 1 END) AS events FROM dur GROUP BY ALL),
km1 AS (SELECT *, sum(n) OVER (PARTITION BY arm ORDER BY t DESC) AS at_risk FROM km0),
km AS (SELECT arm, t, product(1.0 - events / at_risk) OVER (PARTITION BY arm ORDER BY t) AS s FROM km1 WHERE events > 0),
s90 AS (SELECT max(CASE WHEN arm = 'treatment' THEN s END) AS st, max(CASE WHEN arm = 'control' THEN s END) AS sc
  FROM (SELECT arm, arg_max(s, t) AS s FROM km WHERE t <= 90 GROUP BY arm)),
money AS (SELECT CAST(sum(CASE WHEN arm = 'treatment' AND recovered THEN amount_paise ELSE 0 END) -
  sum(CASE WHEN arm = 'control' AND recovered THEN amount_paise ELSE 0 END) AS BIGINT) AS net FROM units),
x AS (SELECT *, (n_c - (n_t + n_c) * 0.5) ** 2 / ((n_t + n_c) * 0.5)
    + (n_t - (n_t + n_c) * 0.5) ** 2 / ((n_t + n_c) * 0.5) AS chi, s_t / n_t - s_c / n_c AS d,
  1.96 * sqrt(s_t / n_t * (1 - s_t / n_t) / n_t + s_c / n_c * (1 - s_c / n_c) / n_c) AS se FROM counts)""") + """
SELECT 'recovery-2026' AS seed, chi <= 10.827566170662733 AS valid, round(chi, 6) AS chi_square,
  CASE WHEN chi <= 10.827566170662733 THEN round(d, 6) END AS recovery_lift,
  CASE WHEN chi <= 10.827566170662733 THEN round(d - se, 6) END AS recovery_low,
  CASE WHEN chi <= 10.827566170662733 THEN round(d + se, 6) END AS recovery_high,
  CASE WHEN chi <= 10.827566170662733 THEN round(st, 6) END AS treatment_unrecovered_90d,
  CASE WHEN chi <= 10.827566170662733 THEN round(sc, 6) END AS control_unrecovered_90d,
  CASE WHEN chi <= 10.827566170662733 THEN net END AS net_paise,
  chi <= 10.827566170662733 AND d - se > 0 AND st <= sc AND net > 0 AS headline_holds
FROM x, s90, money""")
def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the sample-ratio gate first, and no numbers behind a failed gate."""
    durations = recovery_durations(spark, sf_dir)
    units = failed_units(spark, sf_dir)
    counts = estimators.srm_check(
        estimators.incremental_lift(estimators.arm_counts(units, F.col("recovered"))), CONTROL
    )
    curve = survival.kaplan_meier(durations, "days", F.col("recovered"), ["arm"])
    at90 = survival.survival_at(curve, ["arm"], 90).groupBy().agg(
        F.max(F.when(F.col("arm") == "treatment", F.col("survival"))).alias("s_treat"),
        F.max(F.when(F.col("arm") == "control", F.col("survival"))).alias("s_ctrl"),
    )
    won = F.when(F.col("recovered"), F.col("amount_paise")).otherwise(0)
    money = units.agg(F.sum(F.when(F.col("arm") == "treatment", won).otherwise(-won)))
    row = counts.withColumn("_s", at90.select(F.struct("s_treat", "s_ctrl")).scalar()).withColumn(
        "net", money.scalar()
    )
    valid = F.col("srm_passed")
    s_treat, s_ctrl = F.col("_s.s_treat"), F.col("_s.s_ctrl")
    return row.select(
        F.lit(SEED).alias("seed"), valid.alias("valid"), F.round("chi_square", 6).alias("chi_square"),
        F.when(valid, F.round("lift", 6)).alias("recovery_lift"),
        F.when(valid, F.round("low", 6)).alias("recovery_low"),
        F.when(valid, F.round("high", 6)).alias("recovery_high"),
        F.when(valid, F.round(s_treat, 6)).alias("treatment_unrecovered_90d"),
        F.when(valid, F.round(s_ctrl, 6)).alias("control_unrecovered_90d"),
        F.when(valid, F.col("net")).alias("net_paise"),
        (valid & (F.col("low") > 0) & (s_treat <= s_ctrl) & (F.col("net") > 0)).alias("headline_holds"),
    )
