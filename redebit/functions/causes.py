"""Decline-cause posterior as plain column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six causes, in tie-break order.
CAUSES = (
    "no_funds",
    "issuer_degraded",
    "fraud_hold",
    "limit_breach",
    "mandate_dead",
    "credential_dead",
)
TERMINAL = ("mandate_dead", "credential_dead")
DIAGNOSABLE = CAUSES[:4]

# Decline codes whose cause is certain.
CERTAIN = {
    "41": "credential_dead",
    "43": "credential_dead",
    "14": "credential_dead",
    "54": "credential_dead",
    "57": "mandate_dead",
}
# Decline codes that are nearly certain, as weights before normalising.
LIKELY = {
    "51": {"no_funds": 0.97, "issuer_degraded": 0.015, "limit_breach": 0.015},
    # 91 names issuer_degraded twice in the rule; the remainder share (0.04) is the one kept.
    "91": {"issuer_degraded": 0.04, "no_funds": 0.06},
    "61": {"limit_breach": 0.9, "no_funds": 0.06, "issuer_degraded": 0.04},
}
# Spread for an unknown or missing code.
UNKNOWN = {"no_funds": 0.35, "issuer_degraded": 0.25, "fraud_hold": 0.20, "limit_breach": 0.20}
# Starting weights of the catch-all code 05.
DO_NOT_HONOR = {
    "no_funds": 1.0, "issuer_degraded": 0.35, "fraud_hold": 0.25, "limit_breach": 0.20,
}


def neutral_context() -> dict[str, Column]:
    return {
        "issuer_health": F.lit(1.0),
        "peer_rate": F.lit(1.0),
        "sibling_rate": F.lit(0.0),
        "amount_ratio": F.lit(1.0),
        "days_since_payday": F.lit(None).cast("double"),
        "n_concurrent": F.lit(1),
    }


def _ambiguous_weights(ctx: dict[str, Column]) -> dict[str, Column]:
    def factor(condition: Column, value: float) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(1.0))

    sick = ctx["issuer_health"] < 0.85
    peers_down = ctx["peer_rate"] < 0.5
    siblings_down = ctx["sibling_rate"] > 0.5
    stale_pay = F.coalesce(ctx["days_since_payday"] >= 20, F.lit(False))
    fresh_pay = F.coalesce(ctx["days_since_payday"] <= 2, F.lit(False))
    crowded = ctx["n_concurrent"] >= 4
    limit = F.when(ctx["amount_ratio"] >= 2.5, 4.0).when(ctx["amount_ratio"] > 1.4, 2.0).otherwise(1.0)
    funds = (
        F.lit(DO_NOT_HONOR["no_funds"])
        * factor(sick, 0.5)
        * factor(peers_down, 0.6)
        * factor(siblings_down, 2.5)
        * F.when(stale_pay, 2.5).when(fresh_pay, 0.5).otherwise(1.0)
        * factor(crowded, 1.6)
    )
    issuer = (
        F.lit(DO_NOT_HONOR["issuer_degraded"])
        * factor(sick, 4.0)
        * factor(peers_down, 3.0)
        * factor(siblings_down, 0.5)
    )
    return {
        "no_funds": funds,
        "issuer_degraded": issuer,
        "fraud_hold": F.lit(DO_NOT_HONOR["fraud_hold"]),
        "limit_breach": F.lit(DO_NOT_HONOR["limit_breach"]) * limit,
    }


def cause_probabilities(code: Column, ctx: dict[str, Column] | None = None) -> dict[str, Column]:
    """Normalised probability per cause for a decline code in its context."""
    ambiguous = _ambiguous_weights(ctx or neutral_context())
    weights = {}
    for cause in CAUSES:
        weight = F.when(code == "05", ambiguous.get(cause, F.lit(0.0)))
        for known, certain in CERTAIN.items():
            weight = weight.when(code == known, F.lit(1.0 if cause == certain else 0.0))
        for known, spread in LIKELY.items():
            weight = weight.when(code == known, F.lit(spread.get(cause, 0.0)))
        weights[cause] = weight.otherwise(F.lit(UNKNOWN.get(cause, 0.0)))
    total = sum(weights.values(), F.lit(0.0))
    return {cause: weight / total for cause, weight in weights.items()}


def most_likely(probabilities: dict[str, Column]) -> Column:
    """Name of the largest probability; ties go to the earlier cause."""
    best = F.greatest(
        *[F.struct(p.alias("p"), F.lit(-i).alias("rank"), F.lit(c).alias("cause"))
          for i, (c, p) in enumerate(probabilities.items())]
    )
    return best["cause"]


def p_recoverable(code: Column, ctx: dict[str, Column] | None = None) -> Column:
    """Posterior mass off the terminal causes."""
    p = cause_probabilities(code, ctx)
    return sum((p[c] for c in CAUSES if c not in TERMINAL), F.lit(0.0))
