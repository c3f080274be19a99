"""Portfolio metrics: arms, matched pair, guardrails, roll-ups, adoption gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redebit.functions import hashing, stats
from redebit.operators import estimators

MIN_ARM = 30
# Share of mandates acted on and holdout share per adoption stage.
STAGES = {
    "observe": (0.0, 0.0),
    "shadow": (0.0, 0.0),
    "canary": (0.01, 0.0),
    "ramp": (0.10, 0.15),
    "full": (1.0, 0.15),
}
STAGE_ORDER = tuple(STAGES)


def rollout_arm(stage: str, tenant: Column, mandate: Column) -> Column:
    """excluded / holdout / treatment from two independent salted draws.

    The share draw does not depend on the stage, so membership only grows as the stage does.
    """
    share, holdout = STAGES[stage]
    inside = hashing.unit_interval("share", tenant, mandate) < share
    held = hashing.unit_interval("holdout", tenant, mandate) < holdout
    return F.when(~inside, "excluded").when(held, "holdout").otherwise("treatment")


def mandate_totals(cycles: DataFrame, stage: str) -> DataFrame:
    """One row per mandate with its arm; the arm is computed once per mandate, not per cycle."""
    failed = F.col("attempts_used") > 0
    won = failed & (F.col("recovered_paise") > 0)
    totals = cycles.groupBy("tenant_id", "mandate_id").agg(
        F.max("alive").alias("alive"),
        F.count_if(failed).alias("failed_cycles"),
        F.count_if(won).alias("recovered_cycles"),
        F.sum(F.when(won, F.col("recovered_paise")).otherwise(0)).alias("recovered_paise"),
        F.sum("attempts_used").alias("attempts"),
    )
    return totals.withColumn("arm", rollout_arm(stage, F.col("tenant_id"), F.col("mandate_id")))


def arm_summary(cycles: DataFrame, stage: str) -> DataFrame:
    """Mandates, alive, failed, recovered, money and attempts per tenant and arm."""
    return mandate_totals(cycles, stage).groupBy("tenant_id", "arm").agg(
        F.count("*").alias("mandates"),
        F.count_if("alive").alias("alive_mandates"),
        F.sum("failed_cycles").alias("failed_cycles"),
        F.sum("recovered_cycles").alias("recovered_cycles"),
        F.sum("recovered_paise").alias("recovered_paise"),
        F.sum("attempts").cast("bigint").alias("attempts"),
    )


_FIELDS = ("mandates", "alive_mandates", "failed_cycles", "recovered_cycles", "recovered_paise", "attempts")


def pair_arms(summary: DataFrame) -> DataFrame:
    """Treatment (t_) and holdout (h_) side by side, absent arms as zeros."""
    cells = [
        F.coalesce(F.max(F.when(F.col("arm") == arm, F.col(field))), F.lit(0)).alias(f"{prefix}_{field}")
        for prefix, arm in (("t", "treatment"), ("h", "holdout"))
        for field in _FIELDS
    ]
    return summary.groupBy("tenant_id").agg(*cells)


def _rate(num: str, den: str) -> Column:
    return F.coalesce(stats.ratio(F.col(num), F.col(den)), F.lit(0.0))


def _interval(p1: Column, n1: Column, p0: Column, n0: Column) -> tuple[Column, Column]:
    """Low and high of a rate difference; NULL on thin arms or on a figure that is no rate."""
    usable = (n1 >= MIN_ARM) & (n0 >= MIN_ARM) & p1.between(0, 1) & p0.between(0, 1)
    half = F.when(usable, F.lit(stats.Z_PORTFOLIO) * stats.proportion_se(p1, n1, p0, n0))
    return p1 - p0 - half, p1 - p0 + half


def matched_pair(summary: DataFrame) -> DataFrame:
    """Recovery and survival lift as one pair; thin arms give NULL, not zero."""
    pair = pair_arms(summary)
    t_rec, h_rec = _rate("t_recovered_cycles", "t_failed_cycles"), _rate("h_recovered_cycles", "h_failed_cycles")
    t_sur, h_sur = _rate("t_alive_mandates", "t_mandates"), _rate("h_alive_mandates", "h_mandates")
    ticket = F.coalesce(stats.ratio(F.col("t_recovered_paise"), F.col("t_recovered_cycles")), F.lit(0.0))
    scale = F.col("t_failed_cycles") * ticket
    low, high = _interval(t_rec, F.col("t_failed_cycles"), h_rec, F.col("h_failed_cycles"))
    comparable = (F.col("t_mandates") >= MIN_ARM) & (F.col("h_mandates") >= MIN_ARM)
    s_low, s_high = _interval(t_sur, F.col("t_mandates"), h_sur, F.col("h_mandates"))
    both = F.col("t_mandates") + F.col("h_mandates")
    return pair.select(
        "tenant_id",
        F.col("t_mandates").alias("treatment_n"),
        F.col("h_mandates").alias("holdout_n"),
        F.round(t_rec, 4).alias("treatment_recovery_rate"),
        F.round(h_rec, 4).alias("holdout_recovery_rate"),
        ((t_rec - h_rec) * scale).cast("bigint").alias("incremental_recovery_paise"),
        (low * scale).cast("bigint").alias("recovery_low_paise"),
        (high * scale).cast("bigint").alias("recovery_high_paise"),
        F.when(comparable, F.round((t_sur - h_sur) * 100, 2)).alias("incremental_survival_pts"),
        F.when(comparable, F.round(s_low * 100, 2)).alias("survival_low_pts"),
        F.when(comparable, F.round(s_high * 100, 2)).alias("survival_high_pts"),
        F.coalesce(F.round(F.col("h_mandates") * 100 / F.nullif(both, F.lit(0)), 0), F.lit(0.0))
        .cast("bigint").alias("holdout_pct"),
    )


def efficiency(summary: DataFrame, interventions: DataFrame) -> DataFrame:
    """Attempts per recovery by arm, permanent fixes, messages per treated cycle."""
    counts = interventions.groupBy("tenant_id").agg(
        F.count_if(F.col("kind") == "date_change").alias("permanent_fixes"),
        F.count_if(F.col("kind") == "pdn_notice").alias("notices"),
    )
    joined = pair_arms(summary).join(counts, "tenant_id", "left")
    notices = F.coalesce("notices", F.lit(0))
    return joined.select(
        "tenant_id",
        F.round(stats.ratio(F.col("t_attempts"), F.col("t_recovered_cycles")), 2).alias("attempts_per_recovery"),
        F.round(stats.ratio(F.col("h_attempts"), F.col("h_recovered_cycles")), 2)
        .alias("attempts_per_recovery_baseline"),
        F.coalesce("permanent_fixes", F.lit(0)).alias("permanent_fixes"),
        F.round(notices / F.greatest(F.col("t_failed_cycles"), F.lit(1)), 2).alias("messages_per_customer_cycle"),
    )


def compliance_violations(decisions: DataFrame) -> DataFrame:
    """ALLOW decisions that hold a failed check, per tenant."""
    bad = (F.col("verdict") == "ALLOW") & F.exists("checks", lambda c: c["verdict"] != "ALLOW")
    return decisions.groupBy("tenant_id").agg(F.count_if(bad).alias("violations"))


def guardrails(summary: DataFrame, decisions: DataFrame) -> DataFrame:
    """Three guardrails per tenant in long form."""
    pair = pair_arms(summary)
    joined = pair.join(compliance_violations(decisions), "tenant_id", "left")
    t_sur, h_sur = _rate("t_alive_mandates", "t_mandates"), _rate("h_alive_mandates", "h_mandates")
    violations = F.coalesce("violations", F.lit(0)).cast("double")
    delta = F.round(h_sur - t_sur, 4)
    net = (F.col("t_recovered_paise") - F.col("h_recovered_paise")).cast("double")

    def rail(key: str, value: Column, breached: Column) -> Column:
        status = F.when(breached, "breach").otherwise("ok")
        return F.struct(F.lit(key).alias("key"), value.alias("value"), status.alias("status"))

    rails = F.array(
        rail("compliance_violations", violations, violations > 0),
        rail("revocation_vs_control", delta, delta > 0),
        rail("net_value_paise", net, net <= 0),
    )
    return joined.select("tenant_id", F.inline(rails))


def contact_guardrails(messages: DataFrame, customers: DataFrame, cap: float) -> DataFrame:
    """The subscriber's guardrails per tenant, in long form with their thresholds.

    ``message_volume``: messages per customer and cycle (``messages`` has tenant_id, customer_id,
    cycle_ref) against the fatigue cap. ``complaint_rate``: share of treated customers who complained
    or opted out against that of the control arm (``customers`` has tenant_id, arm, opted_out).
    """
    per_cycle = messages.groupBy("tenant_id", "customer_id", "cycle_ref").agg(F.count("*").alias("n"))
    volume = per_cycle.groupBy("tenant_id").agg(F.avg("n").alias("value")).select(
        "tenant_id", F.lit("message_volume").alias("key"), "value", F.lit(float(cap)).alias("threshold"))
    share = lambda arm: F.coalesce(F.avg(F.when(F.col("arm") == arm, F.col("opted_out").cast("double"))), F.lit(0.0))
    complaints = customers.groupBy("tenant_id").agg(share("treatment").alias("value"), share("control").alias("threshold")).select(
        "tenant_id", F.lit("complaint_rate").alias("key"), "value", "threshold")
    return volume.unionByName(complaints).withColumn("status", F.when(F.col("value") > F.col("threshold"), "breach").otherwise("ok"))


def tenant_report(summary: DataFrame, rails: DataFrame, interventions: DataFrame, holdout: float) -> DataFrame:
    """Recovery and mandate survival as one pair per tenant, with efficiency, breaches and a verdict.

    ``summary`` holds the arms, ``rails`` guardrails in long form (tenant_id, key, status), ``holdout``
    the designed share of the holdout. No number stands behind a failed sample-ratio gate; a
    breached guardrail forbids the claim whatever the numbers say; thin arms support no claim.
    """
    sizes = pair_arms(summary).select("tenant_id", F.col("t_mandates").alias("n_t"), F.col("h_mandates").alias("n_c"))
    gate = estimators.srm_check(sizes, holdout).select("tenant_id", "chi_square", F.coalesce("srm_passed", F.lit(False)).alias("valid"))
    breaches = rails.where("status = 'breach'").groupBy("tenant_id").agg(
        F.array_join(F.array_sort(F.collect_set("key")), ",").alias("breached")
    )
    row = gate.join(matched_pair(summary), "tenant_id").join(efficiency(summary, interventions), "tenant_id").join(breaches, "tenant_id", "left")
    numbers = (
        "treatment_recovery_rate", "holdout_recovery_rate", "incremental_recovery_paise", "recovery_low_paise", "recovery_high_paise",
        "incremental_survival_pts", "survival_low_pts", "survival_high_pts", "attempts_per_recovery", "attempts_per_recovery_baseline",
    )
    breached = F.coalesce("breached", F.lit(""))
    both = F.coalesce((F.col("recovery_low_paise") > 0) & (F.col("incremental_survival_pts") >= 0), F.lit(False))
    verdict = F.when(~F.col("valid"), "invalid split").when(breached != "", "guardrail breached").when(both, "holds").otherwise("no defensible effect")
    return row.select(
        "tenant_id", "valid", "chi_square", *[F.when(F.col("valid"), F.col(c)).alias(c) for c in numbers],
        breached.alias("breached"), verdict.alias("verdict"),
    )


def fleet_guardrails(per_tenant: DataFrame) -> DataFrame:
    """Fleet view: counts and money add up, rates take the worst tenant."""
    summed = F.col("key").isin("compliance_violations", "net_value_paise")
    merged = per_tenant.groupBy("key").agg(
        F.sum("value").alias("_sum"), F.max("value").alias("_max"),
        F.max((F.col("status") != "ok").cast("int")).alias("_bad"),
    )
    value = F.when(summed, F.col("_sum")).otherwise(F.col("_max"))
    status = (
        F.when(F.col("key") == "net_value_paise", F.col("_sum") <= 0)
        .when(F.col("key") == "compliance_violations", F.col("_sum") != 0)
        .otherwise(F.col("_bad") == 1)
    )
    return merged.select("key", value.alias("value"), F.when(status, "breach").otherwise("ok").alias("status"))


def rail_mix(mandates: DataFrame) -> DataFrame:
    """Mandates and share per rail, per tenant and (tenant NULL) for the fleet."""
    counted = mandates.groupBy("tenant_id", "rail").agg(F.count("*").alias("mandates"))
    both = counted.groupingSets(
        [["tenant_id", "rail"], ["rail"]], "tenant_id", "rail"
    ).agg(F.sum("mandates").alias("mandates"))
    totals = both.groupBy("tenant_id").agg(F.sum("mandates").alias("_all"))
    return both.alias("b").join(
        totals.alias("t"), F.expr("b.tenant_id <=> t.tenant_id")
    ).select(
        "b.tenant_id", "rail", "mandates", F.round(F.col("mandates") / F.col("_all"), 4).alias("share")
    )


def fleet_pair(pairs: DataFrame) -> DataFrame:
    """Fleet line of the matched pair: money adds up, survival averages measurable tenants."""
    both = F.sum("treatment_n") + F.sum("holdout_n")
    return pairs.agg(
        F.sum("incremental_recovery_paise").alias("incremental_recovery_paise"),
        F.round(F.avg("incremental_survival_pts"), 2).alias("incremental_survival_pts"),
        F.sum("treatment_n").alias("treatment_n"),
        F.sum("holdout_n").alias("holdout_n"),
        F.round(F.sum("holdout_n") * 100 / F.nullif(both, F.lit(0)), 0).cast("bigint").alias("holdout_pct"),
    )


def tenant_overview(parts: dict[str, DataFrame]) -> DataFrame:
    """One row per tenant from one conditional aggregate per table.

    ``parts`` maps a table label to an already aggregated frame keyed by tenant_id.
    """
    merged = None
    for frame in parts.values():
        merged = frame if merged is None else merged.join(frame, "tenant_id", "full")
    return merged.na.fill(0)


def pipeline_overview(cycles: DataFrame, events: DataFrame, actions: DataFrame, now: Column) -> DataFrame:
    """Per tenant what is in flight, queued, recovered and not yet processed, and how far behind it is.

    ``events`` has tenant_id, received_at and processed; ``actions`` has tenant_id and state.
    """
    parts = {
        "cycles": cycles.groupBy("tenant_id").agg(
            F.count("*").alias("cycles"), F.count_if(F.col("state") == "executing").alias("in_flight"),
            F.coalesce(F.sum("recovered_paise"), F.lit(0)).cast("bigint").alias("recovered_paise")),
        "events": events.groupBy("tenant_id").agg(
            F.count("*").alias("events"), F.count_if(~F.col("processed")).alias("unprocessed"),
            F.max(F.when(~F.col("processed"), F.unix_seconds(now) - F.unix_seconds("received_at"))).alias("lag_seconds")),
        "actions": actions.groupBy("tenant_id").agg(F.count_if(F.col("state") == "pending").alias("queued")),
    }
    return tenant_overview(parts).withColumn("pipeline_healthy", F.col("unprocessed") == 0)


def prevention_counts(cycles: DataFrame) -> DataFrame:
    """Prevented (first execution succeeded) and recovered per arm over high-risk cycles."""
    prevented = F.col("succeeded_first") & (F.col("retries") == 0)
    return cycles.where("high_risk").groupBy("arm").agg(
        F.count("*").alias("n"),
        F.count_if(prevented).alias("prevented"),
        F.count_if("recovered_after_retry").alias("recovered"),
    )


def prevention_overlap(cycles: DataFrame) -> DataFrame:
    """Cycles counted as both prevented and recovered; must be empty."""
    prevented = cycles.where("succeeded_first AND retries = 0").select("cycle_id")
    recovered = cycles.where("recovered_after_retry").select("cycle_id")
    return prevented.intersect(recovered)


def net_value(parts: DataFrame, by: list[str]) -> DataFrame:
    """Recovered plus retained value less fees, messages and value lost to churn."""
    total = (
        F.sum("recovered_paise") + F.sum("retained_paise") - F.sum("fee_paise")
        - F.sum("message_paise") - F.sum("churn_paise")
    )
    return parts.groupBy(*by).agg(
        total.alias("net_paise"),
        F.sum("recovered_paise").alias("recovery_only_paise"),
        (F.sum("recovered_paise") - total).alias("overstatement_paise"),
    ).withColumn("status", F.when(F.col("net_paise") <= 0, "breach").otherwise("pass"))


def active_experiment(configs: DataFrame, tenants: DataFrame) -> DataFrame:
    """The frozen experiment of each tenant: its own newest, else the platform's newest."""
    frozen = configs.where("frozen")
    newest = F.struct("committed_at", "experiment_id")
    row = F.struct("experiment_id", "seed", "control_pct")
    own = frozen.where("tenant_id IS NOT NULL").groupBy("tenant_id").agg(F.max_by(row, newest).alias("_own"))
    platform = frozen.where("tenant_id IS NULL").agg(F.max_by(row, newest)).scalar()
    chosen = tenants.join(own, "tenant_id", "left").withColumn("_x", F.coalesce("_own", platform))
    return chosen.select("tenant_id", "_x.*", F.col("_own").isNotNull().alias("is_own"))


# Exit criteria of each adoption stage.
def adoption_gate(evidence: DataFrame) -> DataFrame:
    """Unmet exit criteria of the tenant's current stage, and whether it may advance."""
    def unmet(*tests: tuple[Column, str]) -> Column:
        return F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in tests]))

    c = F.col
    gates = {
        "observe": unmet(
            (c("event_completeness") < 0.999, "event completeness"),
            (c("projection_matches_days") < 7, "projection matches"),
        ),
        "shadow": unmet(
            (c("shadow_decisions") < 10_000, "shadow decisions"),
            (c("gate_errors") != 0, "gate errors"),
            (~(c("calibration_ece") < 0.05), "calibration"),
            (~c("audit_report_produced"), "audit report"),
        ),
        "canary": unmet(
            (c("canary_days") < 14, "canary days"),
            (c("double_debits") != 0, "double debits"),
            (c("compliance_violations") != 0, "compliance violations"),
            (c("revocation_above_baseline"), "revocation rate"),
        ),
        "ramp": unmet(
            (~c("recovery_ci_excludes_zero"), "recovery interval"),
            (c("survival_ci_negative"), "survival interval"),
            (c("guardrails_green_days") < 30, "guardrail days"),
        ),
        "full": F.array(F.lit("already at the final stage")),
    }
    reasons = None
    for stage, gate in gates.items():
        reasons = F.when(c("stage") == stage, gate) if reasons is None else reasons.when(c("stage") == stage, gate)
    return evidence.withColumn("unmet", reasons).withColumn("may_advance", F.size("unmet") == 0)
