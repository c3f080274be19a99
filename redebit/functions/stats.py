"""Statistical scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z_WILSON = 1.959963984540054
Z_INTERVAL = 1.96
Z_PORTFOLIO = 1.959963985
KAPPA = 5.0
MIN_HAZARD, MAX_HAZARD = 1e-6, 1.0 - 1e-6
CHI2_ALPHA_001 = 10.827566170662733


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def clamp_hazard(value: Column) -> Column:
    return clamp(value, MIN_HAZARD, MAX_HAZARD)


def wilson_lower(successes: Column, attempts: Column, z: float = Z_WILSON) -> Column:
    return _wilson(successes, attempts, z, -1.0)


def wilson_upper(successes: Column, attempts: Column, z: float = Z_WILSON) -> Column:
    return _wilson(successes, attempts, z, 1.0)


def _wilson(successes: Column, attempts: Column, z: float, side: float) -> Column:
    n = attempts.cast("double")
    safe = F.greatest(n, F.lit(1.0))
    p = successes.cast("double") / safe
    z2 = z * z
    denominator = F.lit(1.0) + F.lit(z2) / safe
    centre = (p + F.lit(z2) / (safe * 2.0)) / denominator
    spread = F.sqrt(p * (F.lit(1.0) - p) / safe + F.lit(z2) / (safe * safe * 4.0))
    bound = centre + F.lit(side * z) / denominator * spread
    if side < 0:
        return F.when(n == 0, 0.0).otherwise(F.greatest(bound, F.lit(0.0)))
    return F.when(n == 0, 1.0).otherwise(F.least(bound, F.lit(1.0)))


def shrink(rate: Column, n: Column, prior: Column, kappa: float = KAPPA) -> Column:
    """Partial pooling toward ``prior``: weight n / (n + kappa)."""
    weight = n / (n + F.lit(kappa))
    return clamp_hazard(weight * rate + (F.lit(1.0) - weight) * prior)


def proportion_se(p1: Column, n1: Column, p0: Column, n0: Column) -> Column:
    one = F.lit(1.0)
    return F.sqrt(p1 * (one - p1) / n1 + p0 * (one - p0) / n0)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL, not an error, on an empty denominator."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def log_loss_term(label: Column, p: Column) -> Column:
    q = clamp(p, 1e-15, 1.0 - 1e-15)
    y = label.cast("double")
    return -(y * F.log(q) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - q))


def psi_term(reference_share: Column, current_share: Column, floor: float = 1e-6) -> Column:
    ref = F.greatest(reference_share, F.lit(floor))
    cur = F.greatest(current_share, F.lit(floor))
    return (cur - ref) * F.log(cur / ref)
