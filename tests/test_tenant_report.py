"""The report per tenant: gate first, guardrails veto, thin arms claim nothing."""

from pyspark.sql import functions as F

from redebit.operators import portfolio

COLUMNS = (
    "tenant_id string, arm string, mandates long, alive_mandates long, failed_cycles long, recovered_cycles long, "
    "recovered_paise long, attempts long"
)


def arms(tenant, treated, held, won=(600, 50), alive=(800, 120)):
    return [
        (tenant, "treatment", treated, min(treated, alive[0]), 900, won[0], won[0] * 100, 1800),
        (tenant, "holdout", held, min(held, alive[1]), 150, won[1], won[1] * 100, 300),
    ]


def test_gate_guardrails_and_both_halves_decide(spark):
    rows = [
        *arms("good", 850, 150), *arms("skewed", 500, 500), *arms("vetoed", 850, 150),
        *arms("killing", 850, 150, alive=(400, 140)), *arms("flat", 850, 150, won=(300, 50)), *arms("thin", 20, 4),
    ]
    summary = spark.createDataFrame(rows, COLUMNS)
    rails = spark.createDataFrame(
        [("vetoed", "net_value_paise", "breach"), ("vetoed", "complaint_rate", "breach"), ("vetoed", "complaint_rate", "breach"),
         ("good", "complaint_rate", "ok"), ("skewed", "complaint_rate", "breach")],
        "tenant_id string, key string, status string",
    )
    none = spark.createDataFrame([], "tenant_id string, kind string")
    got = {r.tenant_id: r for r in portfolio.tenant_report(summary, rails, none, 0.15).collect()}
    assert {t: r.verdict for t, r in got.items()} == {
        "good": "holds", "skewed": "invalid split", "vetoed": "guardrail breached", "killing": "no defensible effect",
        "flat": "no defensible effect", "thin": "no defensible effect",
    }
    assert got["vetoed"].breached == "complaint_rate,net_value_paise" and got["good"].breached == ""
    # No number stands behind a failed gate.
    assert got["skewed"].recovery_low_paise is None and got["skewed"].attempts_per_recovery is None
    assert got["good"].attempts_per_recovery == 3.0 and got["good"].attempts_per_recovery_baseline == 6.0
    assert got["killing"].incremental_survival_pts < 0 < got["killing"].recovery_low_paise
    empty = portfolio.tenant_report(summary.limit(0), rails, none, 0.15)
    assert empty.where(F.col("verdict").isNotNull()).count() == 0
