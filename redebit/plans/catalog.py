"""Every registered query. Importing a plan module registers its queries."""

from redebit.plans import (  # noqa: F401
    calendar,
    customers,
    experiment,
    governance,
    ingest,
    issuers,
    learning,
    planning,
    priors,
    retry_plan,
    streams,
)
from redebit.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
