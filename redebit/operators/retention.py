"""Revocation hazard, continuation value and interventions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redebit.functions import calendar as cal
from redebit.operators import history

UNPAID_EDGES = (0.0, 30.0, 60.0, 90.0)
MAX_FAILURES = 4
MIN_CELL = 30
AT_RISK = 0.15
CHRONIC_CYCLES, MIN_LIFT = 3, 0.25
CELL = ["failure_bucket", "unpaid_bucket", "rail"]


def failure_bucket(consecutive: Column) -> Column:
    return F.least(F.greatest(consecutive, F.lit(0)), F.lit(MAX_FAILURES)).cast("int")


def unpaid_bucket(days: Column) -> Column:
    return F.when(days >= 90, 90.0).when(days >= 60, 60.0).when(days >= 30, 30.0).otherwise(0.0)


def lifecycle_observations(cycles: DataFrame, died_before: Column) -> DataFrame:
    """Lifecycle steps with their hazard cell and whether the mandate died at the step."""
    newest = history.last_cycles(cycles).select(
        "cycle_id", (F.col("last_due_at") < died_before).alias("died_here")
    )
    steps = history.lifecycle_steps(cycles).join(newest, "cycle_id", "left")
    return steps.select(
        "mandate_id", "cycle_id", "rail", "due_at", "amount_paise", "seq_no", "consecutive_failures", "days_unpaid",
        "successes",
        failure_bucket(F.col("consecutive_failures")).alias("failure_bucket"),
        unpaid_bucket(F.col("days_unpaid")).alias("unpaid_bucket"),
        F.coalesce("died_here", F.lit(False)).alias("died_here"),
        F.col("died_here").isNotNull().alias("is_last"),
    )


def revocation_hazard(observations: DataFrame) -> DataFrame:
    """Monthly hazard per cell; a thin cell carries the global hazard."""
    cells = observations.groupBy(*CELL).agg(F.count("*").alias("n"), F.count_if("died_here").alias("deaths"))
    overall = cells.agg(F.sum("deaths") / F.sum("n")).scalar()
    return cells.withColumn("global_hazard", overall).withColumn(
        "hazard",
        F.when(F.col("n") >= MIN_CELL, F.col("deaths") / F.col("n")).otherwise(F.col("global_hazard")),
    )


def with_monthly_hazard(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Attach the cell hazard, the global one for unseen cells."""
    overall = cells.agg(F.max("global_hazard")).scalar()
    # 5 failure buckets x 4 unpaid buckets x 3 rails: at most 60 rows, and far too few keys
    # to distribute the rows by.
    known = cells.where(F.col("rail").isin(*[r[0] for r in cal.RAILS])).select(*CELL, F.col("hazard").alias("_h"))
    joined = rows.join(F.broadcast(known), CELL, "left")
    return joined.withColumn("monthly_hazard", F.coalesce("_h", overall)).drop("_h")


def daily_hazard(monthly: Column) -> Column:
    kept = F.least(F.greatest(monthly, F.lit(0.0)), F.lit(0.999999))
    return F.lit(1.0) - F.pow(F.lit(1.0) - kept, F.lit(1.0 / 30.0))


def survival_days(monthly: Column, days: Column) -> Column:
    return F.pow(F.lit(1.0) - daily_hazard(monthly), days)


def marginal_delta(rows: DataFrame, cells: DataFrame, days_ahead: Column) -> DataFrame:
    """Chance the mandate is lost while waiting ``days_ahead``; the wait itself ages the cell."""
    waited = rows.withColumn("days_ahead", days_ahead).withColumn(
        "unpaid_bucket", unpaid_bucket(F.col("days_unpaid") + F.col("days_ahead"))
    )
    scored = with_monthly_hazard(waited, cells)
    return scored.withColumn(
        "marginal_delta", F.lit(1.0) - survival_days(F.col("monthly_hazard"), F.col("days_ahead").cast("double"))
    )


def continuation_value(monthly: Column, paise: Column, collect: Column, cycles: int = 24, discount: float = 0.98) -> Column:
    """Discounted value of the mandate's next cycles, as a closed geometric sum in paise."""
    q = F.lit(discount) * (F.lit(1.0) - monthly)
    total = q * (F.lit(1.0) - F.pow(q, F.lit(float(cycles)))) / (F.lit(1.0) - q)
    return F.bround(total * paise * collect, 0).cast("bigint")


def at_risk_mandates(observations: DataFrame, cells: DataFrame, threshold: float = AT_RISK) -> DataFrame:
    newest = with_monthly_hazard(observations.where("is_last"), cells)
    return newest.where(F.col("monthly_hazard") >= threshold).select("mandate_id", "monthly_hazard")


def day_of_month_hazard(cycles: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """P(settled at first presentation) per IST debit day with its counts."""
    return cycles.groupBy(*(keys or []), cal.day_of_month_ist(F.col("due_at")).alias("day")).agg(
        F.count("*").alias("n"), (F.count_if(~F.col("failed")) / F.count("*")).alias("p")
    )


def peak_day(by_day: DataFrame, keys: list[str], min_observations: int = 30) -> DataFrame:
    """Best day among days with enough observations; smallest day on a tie."""
    enough = by_day.where(F.col("n") >= min_observations)
    best = F.max(F.struct("p", (-F.col("day")).alias("neg_day")))
    return enough.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, (-F.col("_b.neg_day")).alias("peak_day"), F.col("_b.p").alias("peak_p")
    )


def select_intervention(rows: DataFrame, fatigue_cap: int = 3) -> DataFrame:
    """Hard stop, then date change, then retry if it beats waiting, else back off with reasons."""
    c = F.col
    chronic = c("consecutive_failures") >= CHRONIC_CYCLES
    lift = c("peak_p") - c("day_p")
    move = c("peak_day").isNotNull() & (c("peak_day") != c("debit_day")) & (lift > MIN_LIFT) & chronic
    reasons = F.array_compact(F.array(
        F.lit("best attempt is worth less than the mandate"),
        F.when(c("monthly_hazard") >= AT_RISK, F.lit("revocation hazard above threshold")),
        F.when(c("messages_30d") >= fatigue_cap, F.lit("fatigue cap reached")),
    ))
    stopped = F.size("hard_stops") > 0
    retry = c("best_ev_paise") > c("continuation_paise")
    kind = (
        F.when(stopped, "back_off").when(F.coalesce(move, F.lit(False)), "date_change")
        .when(retry, "retry").otherwise("back_off")
    )
    return rows.withColumn("intervention", kind).withColumn(
        "reasons",
        F.when(stopped, c("hard_stops")).when(kind == "back_off", reasons).otherwise(F.array().cast("array<string>")),
    )


def propose_rail_migration(current: Column, available: Column, days_to_expiry: Column, fraud_holds: Column,
                           horizon: int = 45) -> Column:
    """Target rail for an expiring or repeatedly held card; NULL when nothing is proposed."""
    alternates = F.array_sort(F.array_remove(available, "card_emandate"))
    target = F.when(F.array_contains(alternates, cal.UPI), F.lit(cal.UPI)).otherwise(F.try_element_at(alternates, F.lit(1)))
    expiring = F.coalesce(days_to_expiry.between(0, horizon), F.lit(False))
    wanted = (current == cal.CARD) & (F.size(alternates) > 0) & (expiring | (fraud_holds >= 2))
    return F.when(wanted, target)
