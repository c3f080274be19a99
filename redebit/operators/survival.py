"""Kaplan-Meier curves and the log-rank test.

Rows are first counted per distinct duration; the windows below run over those counts
only (durations are whole days, so a few thousand rows per group at any table size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _per_time(units: DataFrame, duration: str, by: list[str], **counts: Column) -> DataFrame:
    return units.groupBy(*by, F.col(duration).alias("t")).agg(
        *[F.count_if(c).alias(n) for n, c in counts.items()]
    )


def kaplan_meier(units: DataFrame, duration: str, observed: Column, by: list[str]) -> DataFrame:
    """at_risk, events and S(t) at each distinct event time."""
    counted = _per_time(units, duration, by, n=F.lit(True), events=observed)
    later = Window.partitionBy(*by).orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    so_far = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    risky = counted.withColumn("at_risk", F.sum("n").over(later)).where("events > 0")
    hazard = F.col("events") / F.col("at_risk")
    alive = F.col("events") < F.col("at_risk")
    log_step = F.when(alive, F.log(F.lit(1.0) - F.when(alive, hazard).otherwise(0.0))).otherwise(0.0)
    survival = F.exp(F.sum(log_step).over(so_far)) * F.min(alive.cast("int")).over(so_far)
    return risky.withColumn("survival", survival).select(*by, "t", "at_risk", "events", "survival")


def median_survival(curve: DataFrame, by: list[str]) -> DataFrame:
    """First time at which S(t) is one half or less; NULL if never reached."""
    return curve.groupBy(*by).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("t"))).alias("median"))


def survival_at(curve: DataFrame, by: list[str], t: float) -> DataFrame:
    """S at time t: the last step at or before it, 1 before the first event."""
    reached = F.col("t") <= t
    return curve.groupBy(*by).agg(
        F.coalesce(F.max_by("survival", F.when(reached, F.col("t"))), F.lit(1.0)).alias("survival")
    )


def log_rank(units: DataFrame, duration: str, observed: Column, arm: str, a: str, b: str,
             by: list[str] | None = None) -> DataFrame:
    """Observed and expected events of arm a, variance, and the chi-square statistic."""
    by = by or []
    in_a, in_b = F.col(arm) == a, F.col(arm) == b
    counted = _per_time(
        units.where(in_a | in_b), duration, by, n_a=in_a, n_b=in_b, d_a=in_a & observed, d=observed
    )
    later = Window.partitionBy(*by).orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    risk = counted.select(
        *by, "d_a", "d", F.sum("n_a").over(later).cast("double").alias("r_a"),
        F.sum("n_b").over(later).cast("double").alias("r_b"),
    ).withColumn("r", F.col("r_a") + F.col("r_b")).where("d > 0 AND r > 1")
    variance = F.col("r_a") * F.col("r_b") * F.col("d") * (F.col("r") - F.col("d")) / (
        F.col("r") * F.col("r") * (F.col("r") - 1)
    )
    summed = risk.groupBy(*by).agg(
        F.sum("d_a").alias("observed_a"),
        F.sum(F.col("r_a") * F.col("d") / F.col("r")).alias("expected_a"),
        F.sum(variance).alias("variance"),
    )
    return summed.withColumn(
        "chi_square",
        F.when(F.col("variance") > 0, F.pow(F.col("observed_a") - F.col("expected_a"), 2) / F.col("variance"))
        .otherwise(0.0),
    )
