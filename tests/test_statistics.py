import datetime as dt
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from redebit.functions import causes, hashing, stats
from redebit.operators import estimators, portfolio, priors, survival

MP = "6 6 6 6 7 9 10 10 11 13 16 17 19 20 22 23 25 32 32 34 35"
MP_OBS = "1 1 1 0 1 0 1 0 0 1 1 0 0 0 1 1 0 0 0 0 0"
PLACEBO = "1 1 2 2 3 4 4 5 5 8 8 8 8 11 11 12 12 15 17 22 23"


@pytest.fixture(scope="module")
def freireich(spark):
    data = [("6-MP", int(t), o == "1") for t, o in zip(MP.split(), MP_OBS.split())]
    data += [("placebo", int(t), True) for t in PLACEBO.split()]
    return spark.createDataFrame(data, "arm string, t int, observed boolean").withColumnRenamed("t", "days")


def test_kaplan_meier_freireich(freireich):
    curve = survival.kaplan_meier(freireich, "days", F.col("observed"), ["arm"])
    got = {(r["arm"], r["t"]): r["survival"] for r in curve.collect()}
    for t, s in {6: 0.857, 7: 0.807, 10: 0.753, 13: 0.690, 16: 0.627, 22: 0.538, 23: 0.448}.items():
        assert got[("6-MP", t)] == pytest.approx(s, abs=5e-4)
    assert got[("placebo", 23)] == 0.0
    medians = {r["arm"]: r["median"] for r in survival.median_survival(curve, ["arm"]).collect()}
    assert medians["placebo"] == 8 and medians["6-MP"] == 23
    at = {r["arm"]: r["survival"] for r in survival.survival_at(curve, ["arm"], 5).collect()}
    assert at["6-MP"] == 1.0


def test_log_rank_freireich(freireich):
    row = survival.log_rank(freireich, "days", F.col("observed"), "arm", "6-MP", "placebo").first()
    assert row["observed_a"] == 9
    assert row["expected_a"] == pytest.approx(19.25, abs=0.01)
    assert row["chi_square"] == pytest.approx(16.79, abs=0.01)


@pytest.mark.parametrize("x,p", [(2.706, 0.10), (3.841, 0.05), (5.024, 0.025), (6.635, 0.01), (10.828, 0.001)])
def test_chi_square_table(x, p):
    assert estimators.chi2_p_value(x) == pytest.approx(p, abs=2e-4)
    assert (x > stats.CHI2_ALPHA_001) == (estimators.chi2_p_value(x) < 0.001)


def test_wilson(spark):
    df = spark.createDataFrame([(0, 0), (5, 10), (10, 10)], "s int, n int")
    got = [(r[0], r[1]) for r in df.select(stats.wilson_lower(F.col("s"), F.col("n")), stats.wilson_upper(F.col("s"), F.col("n"))).collect()]
    assert got[0] == (0.0, 1.0)
    assert got[1] == pytest.approx((0.2366, 0.7634), abs=1e-4)
    assert got[2][1] == pytest.approx(1.0)


def test_assignment_equals_the_plain_hash(spark):
    ids = [str(i) for i in range(500)]
    df = spark.createDataFrame([(i,) for i in ids], "c string").repartition(7)
    got = {r["c"]: r["b"] for r in df.select("c", hashing.assignment_bucket(F.col("c"), "seed").alias("b")).collect()}
    assert got == {i: int(hashlib.sha256(f"seed:{i}".encode()).hexdigest()[:8], 16) % 10_000 for i in ids}


def test_rollout_only_grows(spark):
    df = spark.range(4000).select(F.lit("t").alias("t"), F.col("id").alias("m"))
    arms = df.select(*[portfolio.rollout_arm(s, F.col("t"), F.col("m")).alias(s) for s in portfolio.STAGE_ORDER]).collect()
    for r in arms:
        inside = [r[s] != "excluded" for s in portfolio.STAGE_ORDER]
        assert inside == sorted(inside)
    assert all(r["shadow"] == "excluded" for r in arms)
    assert 0.12 < sum(r["full"] == "holdout" for r in arms) / 4000 < 0.18


@pytest.mark.parametrize("n,measured", [(0, False), (29, False), (30, True)])
def test_thin_arms_are_null(spark, n, measured):
    summary = spark.createDataFrame(
        [("t", "treatment", 100, 90, 80, 40, 4000, 90)] + ([("t", "holdout", n, n, n, n // 2, 100 * n, n)] if n else []),
        "tenant_id string, arm string, mandates bigint, alive_mandates bigint, failed_cycles bigint, recovered_cycles bigint, recovered_paise bigint, attempts bigint",
    )
    row = portfolio.matched_pair(summary).first()
    assert (row["incremental_survival_pts"] is not None) is measured
    assert (row["recovery_low_paise"] is not None) is measured


def test_srm_blocks_a_broken_split(spark):
    df = spark.createDataFrame([(5000, 5000), (6000, 4000)], "n_t bigint, n_c bigint")
    assert [r["srm_passed"] for r in estimators.srm_check(df, 0.5).collect()] == [True, False]


def test_cuped_on_a_constant_covariate_changes_nothing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "y double, x double")
    assert [r["adjusted"] for r in estimators.cuped(df, "y", "x").collect()] == [1.0, 3.0]


def test_withheld_and_published_cover_all_cells(spark):
    data = [("a", t, n, n // 2) for t, n in (("t1", 30), ("t2", 30), ("t3", 30))] + [("b", "t1", 900, 1), ("c", "t1", 10, 1), ("c", "t2", 5, 1), ("c", "t3", 5, 1)]
    counts = spark.createDataFrame(data, "mcc string, tenant_id string, attempts bigint, successes bigint")
    kept, held = priors.segment_priors(counts, dims=["mcc"])
    assert {r["mcc"] for r in kept.collect()} == {"a"}
    assert {r["mcc"] for r in held.collect()} == {"b", "c"}


@pytest.mark.parametrize(
    "code,expected",
    [
        ("41", {"credential_dead": 1.0}), ("57", {"mandate_dead": 1.0}), ("51", {"no_funds": 0.97, "limit_breach": 0.015}),
        ("91", {"no_funds": 0.6, "issuer_degraded": 0.4}), ("61", {"limit_breach": 0.9}), (None, {"no_funds": 0.35, "fraud_hold": 0.2}),
        ("05", {"no_funds": 1 / 1.8}),
    ],
)
def test_cause_posterior(spark, code, expected):
    df = spark.createDataFrame([(code,)], "code string")
    p = causes.cause_probabilities(F.col("code"))
    row = df.select(*[c.alias(n) for n, c in p.items()]).first().asDict()
    assert sum(row.values()) == pytest.approx(1.0)
    for cause, value in expected.items():
        assert row[cause] == pytest.approx(value)


def test_bootstrap_peaks_after_payday(spark):
    days = [r[0] for r in spark.range(1, 32).select(priors.bootstrap_hazard(F.col("id"), F.lit(0), F.lit(0))).collect()]
    assert days[0] == max(days) and days[6] > days[5]
    assert sum(days) / 31 == pytest.approx(priors.bootstrap_global(), rel=1e-9)


def test_hmac_matches_the_standard_library(spark):
    import hmac

    for secret in (b"k", b"x" * 64, b"y" * 100):
        ipad, opad = hashing.hmac_pads(secret)
        df = spark.createDataFrame([("héllo",)], "b string")
        got = df.select(hashing.hmac_sha256(F.col("b"), F.lit(ipad), F.lit(opad))).first()[0]
        assert got == hmac.new(secret, "héllo".encode(), hashlib.sha256).hexdigest()


def test_log_loss_is_finite_at_the_edges(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 1.0)], "y int, p double")
    assert all(math.isfinite(r[0]) for r in df.select(stats.log_loss_term(F.col("y"), F.col("p"))).collect())


def test_withheld_segments_query_names_small_cells(spark, tmp_path):
    from redebit.plans import catalog

    # users 4, 12 and 16 (three tenants) share category and rail and have 60 outcomes, user 7 has two
    at = dt.datetime(2024, 1, 2, 6)
    users = [4, 12, 16] * 20 + [7, 7]
    rows = [(n, at + dt.timedelta(seconds=n), "error" if n % 2 else "purchase", u, 1.0, '{"k": 1}') for n, u in enumerate(users)]
    schema = "event_id bigint, ts timestamp, event_type string, user_id bigint, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "events.parquet"))
    held = catalog.QUERIES["withheld_segments"](spark, str(tmp_path)).collect()
    pooled = catalog.QUERIES["segment_priors"](spark, str(tmp_path)).collect()
    assert {(r.mcc, r.rail, r.hour_band) for r in held} == {(r.mcc, r.rail, r.hour_band) for r in pooled if not r.publishable}
    assert len(held) == 1 and len(pooled) == 2
