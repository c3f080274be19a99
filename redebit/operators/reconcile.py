"""Outcomes that arrive later than the attempt, and provider reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRACE_HOURS = 6


def outcome_status(attempts: DataFrame, cycles: DataFrame, now: Column, grace_hours: int = GRACE_HOURS) -> DataFrame:
    """Attempts with a due outcome: resolved, awaiting or overdue, and whether an alert is due."""
    presented = attempts.where("outcome_due_at IS NOT NULL").join(cycles.select("cycle_ref", "rail"), "cycle_ref")
    resolved = F.col("state").isin("succeeded", "failed")
    late = F.unix_seconds("outcome_due_at") < F.unix_seconds(now) - grace_hours * 3600
    status = F.when(resolved, "resolved").when(now < F.col("outcome_due_at"), "awaiting").otherwise("overdue")
    return presented.withColumn("status", status).withColumn("alert", ~resolved & late)


def retry_allowed(cycles: DataFrame, status: DataFrame) -> DataFrame:
    """Cycles with no unresolved attempt: an open outcome blocks the next retry."""
    blocked = status.where("status <> 'resolved'").select("cycle_ref")
    return cycles.join(blocked, "cycle_ref", "left_anti")


def reconcile_by_key(attempts: DataFrame, provider: DataFrame) -> DataFrame:
    """Full outer match on the idempotency key.

    An ambiguous attempt the provider has never seen was not charged and becomes failed; one
    the provider still calls ambiguous stays. Provider rows without an attempt are reported.
    """
    joined = attempts.alias("a").join(provider.alias("p"), "idem_key", "full")
    ambiguous = F.col("a.state") == "ambiguous"
    outcome = F.col("p.outcome")
    state = (
        F.when(F.col("a.state").isNull(), F.lit(None))
        .when(~ambiguous, F.col("a.state"))
        .when(outcome.isNull(), "failed")
        .when(outcome == "accepted", "fired")
        .when(outcome == "declined", "failed")
        .otherwise("ambiguous")
    )
    code = F.when(ambiguous & outcome.isNull(), "reconciled_not_charged").when(
        ambiguous & (outcome == "declined"), F.col("p.decline_code")
    ).otherwise(F.col("a.decline_code"))
    issue = (
        F.when(F.col("a.state").isNull(), "unknown at our side")
        .when((F.col("a.state") == "failed") & (outcome == "accepted"), "charged though recorded failed")
        .when((F.col("a.state") == "fired") & outcome.isNull(), "fired but unknown to provider")
    )
    return joined.select("idem_key", state.alias("state"), code.alias("decline_code"), issue.alias("discrepancy"))
