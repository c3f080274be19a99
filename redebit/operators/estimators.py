"""Experiment estimators over arm summaries and unit rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redebit.functions import hashing, stats


def arm_counts(units: DataFrame, outcome: Column, by: list[str] | None = None) -> DataFrame:
    """n and recovered per arm as one wide row per group: n_t, s_t, n_c, s_c."""
    treated, control = F.col("arm") == "treatment", F.col("arm") == "control"
    return units.groupBy(*(by or [])).agg(
        F.count_if(treated).alias("n_t"),
        F.count_if(treated & outcome).alias("s_t"),
        F.count_if(control).alias("n_c"),
        F.count_if(control & outcome).alias("s_c"),
    )


def incremental_lift(counts: DataFrame, z: float = stats.Z_INTERVAL) -> DataFrame:
    """Difference of proportions with its interval; NULL where an arm is empty."""
    p1, p0 = stats.ratio(F.col("s_t"), F.col("n_t")), stats.ratio(F.col("s_c"), F.col("n_c"))
    se = F.lit(z) * stats.proportion_se(p1, F.col("n_t"), p0, F.col("n_c"))
    lifted = counts.withColumn("lift", p1 - p0).withColumn("_se", F.when(F.col("lift").isNotNull(), se))
    return (
        lifted.withColumn("low", F.col("lift") - F.col("_se"))
        .withColumn("high", F.col("lift") + F.col("_se"))
        .withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0))
        .drop("_se")
    )


def srm_check(counts: DataFrame, control_pct: float) -> DataFrame:
    """Sample-ratio mismatch: chi-square of the arm sizes against the design."""
    n = F.col("n_t") + F.col("n_c")
    want_c, want_t = n * control_pct, n * (1.0 - control_pct)
    statistic = F.pow(F.col("n_c") - want_c, 2) / want_c + F.pow(F.col("n_t") - want_t, 2) / want_t
    return counts.withColumn("chi_square", statistic).withColumn(
        "srm_passed", F.col("chi_square") <= stats.CHI2_ALPHA_001
    )


def chi2_p_value(statistic: float) -> float:
    """Upper tail of chi-square with one degree of freedom, for a single reported number."""
    if statistic < 0:
        raise ValueError("chi-square statistic cannot be negative")
    return math.erfc(math.sqrt(statistic / 2.0))


def cuped_moments(units: DataFrame, y: str, x: str, by: list[str] | None = None) -> DataFrame:
    """theta (sample covariance over population variance) and the mean of the covariate."""
    spread = F.var_pop(x)
    return units.groupBy(*(by or [])).agg(
        F.coalesce(F.covar_samp(y, x) / F.nullif(spread, F.lit(0.0)), F.lit(0.0)).alias("theta"),
        F.avg(x).alias("mean_x"),
    )


def cuped(units: DataFrame, y: str, x: str) -> DataFrame:
    """Variance-reduced outcome ``y - theta (x - mean x)``; unchanged for a constant x."""
    moments = cuped_moments(units, y, x).select(F.struct("theta", "mean_x")).scalar()
    fitted = units.withColumn("_m", moments)
    return fitted.withColumn("theta", F.col("_m.theta")).withColumn(
        "adjusted", F.col(y) - F.col("theta") * (F.col(x) - F.col("_m.mean_x"))
    ).drop("_m")


def ips(units: DataFrame, outcome: Column, propensity: Column, by: list[str] | None = None,
        floor: float = 0.01) -> DataFrame:
    """Inverse propensity estimate and the share of clipped propensities."""
    return units.groupBy(*(by or [])).agg(
        F.avg(outcome / F.greatest(propensity, F.lit(floor))).alias("estimate"),
        F.avg((propensity < floor).cast("double")).alias("clipped_fraction"),
    )


def with_arm(units: DataFrame, seed: str, control_pct: float, key: str = "customer_id") -> DataFrame:
    return units.withColumn("arm", hashing.assign_arm(F.col(key), seed, control_pct))


def aa_coverage(units: DataFrame, seeds: list[str], outcome: Column, control_pct: float = 0.5) -> DataFrame:
    """Re-seeded A/A splits: how many intervals contain zero.

    Whoever is split is a customer, so rows are first summed per customer. A customer meets the
    seeds inside the map task and collapses there into four counters per seed: what is shuffled
    is one row per seed and task, however many rows and seeds there are.
    """
    customers = units.groupBy("customer_id").agg(F.count("*").alias("_n"), F.count_if(outcome).alias("_s"))
    seeded = customers.select("*", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    control = hashing.assign_arm(F.col("customer_id"), F.col("seed"), control_pct) == "control"
    split = [F.sum(F.when(arm, F.col(c)).otherwise(0)).alias(f"{p}_{a}") for a, arm in (("t", ~control), ("c", control)) for p, c in (("n", "_n"), ("s", "_s"))]
    lifts = incremental_lift(seeded.groupBy("seed").agg(*split))
    return lifts.withColumn("covers_zero", ~F.col("excludes_zero"))


def aa_share(coverage: DataFrame) -> DataFrame:
    """Of the A/A intervals, the share that contains zero, and the mean absolute lift."""
    return coverage.agg(
        F.count("*").alias("splits"), F.avg(F.col("covers_zero").cast("double")).alias("coverage"), F.avg(F.abs("lift")).alias("mean_abs_lift"))


def group_split(units: DataFrame, key: str, holdout: float, salt: str = "split") -> DataFrame:
    """Hold out whole customers, never rows of one customer."""
    return units.withColumn("is_holdout", hashing.unit_interval(salt, F.col(key)) < holdout)
