"""Outage detection, as-of states and the cause mixture."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from redebit.functions import causes
from redebit.operators import diagnosis, issuers


def attempts(seed, outage=True, issuers_n=4, hours=12, per_window=40):
    rng, start, rows = random.Random(seed), dt.datetime(2026, 1, 1), []
    for w in range(hours * 12):
        for i in range(issuers_n):
            down = outage and i == 1 and 60 <= w < 72
            for a in range(per_window):
                rows.append((f"i{i}", start + dt.timedelta(minutes=5 * w, seconds=7 * a), rng.random() < (0.1 if down else 0.85)))
    return rows


@pytest.mark.parametrize("outage", [True, False])
def test_outage_is_seen_at_once_and_only_where_it_is(spark, outage):
    df = spark.createDataFrame(attempts(1, outage), "issuer string, at timestamp, success boolean")
    states = issuers.issuer_cusum(issuers.issuer_windows(df), F.lit(0.82)).collect()
    degraded = sorted((r["issuer"], (r["start_s"] - int(dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc).timestamp())) // 300) for r in states if r["degraded_since_s"] >= 0)
    if not outage:
        assert degraded == []
        return
    assert {i for i, _ in degraded} == {"i1"}
    assert degraded[0][1] in (60, 61) and degraded[-1][1] <= 74
    final = max((r for r in states if r["issuer"] == "i1"), key=lambda r: r["start_s"])
    assert final["outages"] == 1 and 55 <= final["outage_minutes"] <= 75


def test_phases_equal_a_step_per_window():
    rng = np.random.default_rng(7)
    for span, n in ((1, 40), (3, 200), (256, 600)):
        drift, bad = rng.normal(-0.02, 0.2, n), rng.random(n) < 0.4
        start = np.arange(n) * 300
        was, issuers.SPAN = issuers.SPAN, span
        got = list(zip(*issuers.follow(issuers.HEALTHY, start, drift, bad, 0.25)))
        cut = issuers.follow(issuers.HEALTHY, start[:17], drift[:17], bad[:17], 0.25)
        rest = issuers.follow(tuple(c[-1].item() for c in cut), start[17:], drift[17:], bad[17:], 0.25)
        issuers.SPAN = was
        cusum, since, good, outages, minutes = 0.0, None, 0, 0, 0.0
        for i in range(n):
            cusum = max(0.0, cusum + drift[i])
            if since is None:
                if bad[i] and cusum > 0.25:
                    since, good = start[i], 0
            else:
                good = max(0, good - 1) if bad[i] else good + 1
                if good == issuers.RECOVERY_WINDOWS:
                    outages, minutes, cusum, since, good = outages + 1, minutes + (start[i] - since) / 60, 0.0, None, 0
            assert got[i] == (pytest.approx(cusum), -1 if since is None else since, good, outages, pytest.approx(minutes))
        for whole, tail in zip(issuers.follow(issuers.HEALTHY, start, drift, bad, 0.25), rest):
            assert tail == pytest.approx(whole[17:])


def test_state_as_of_looks_only_back(spark):
    states = spark.createDataFrame([("a", 300, 1.0), ("a", 900, 2.0)], "issuer string, start_s bigint, cusum double")
    points = spark.createDataFrame([(i, "a", t) for i, t in enumerate((100, 300, 610, 905, 1300))], "n int, issuer string, t bigint").select(
        "n", "issuer", F.timestamp_seconds("t").alias("at")
    )
    got = [r["cusum"] for r in issuers.state_as_of(points, states).orderBy("n").collect()]
    assert got == [None, None, 1.0, 1.0, 2.0]


def observations(seed=0, n=400):
    rng, rows = np.random.default_rng(seed), []
    for i in range(n):
        code = ["51", "91", "61", "05", None][rng.integers(0, 5)]
        recovered = bool(rng.random() < 0.5)
        rows.append((
            i, i % 50, code, float(rng.random()), float(rng.random()), float(rng.integers(0, 2)), float(0.5 + rng.random() * 3),
            None if rng.random() < 0.2 else float(rng.integers(0, 30)), int(rng.integers(1, 5)), recovered, float(rng.random() * 90) if recovered else None,
        ))
    return rows


def numpy_em(rows, iterations):
    """A plain dense EM with the same anchors."""
    x = np.array([[r[3], r[4], r[5], r[6], -1.0 if r[7] is None else r[7], r[8], float(r[9]), np.log1p(r[10]) if r[9] else -1.0] for r in rows], dtype=float)
    resp = []
    for r in rows:
        if r[2] == "51":
            p = [0.97, 0.015, 0.0, 0.015]
        elif r[2] == "91":
            p = [0.06, 0.04, 0.0, 0.0]
        elif r[2] == "61":
            p = [0.06, 0.04, 0.0, 0.9]
        elif r[2] == "05":
            nf, isd, fh, lb = 1.0, 0.35, 0.25, 0.2
            if r[3] < 0.85: isd, nf = isd * 4, nf * 0.5
            if r[4] < 0.5: isd, nf = isd * 3, nf * 0.6
            if r[5] > 0.5: nf, isd = nf * 2.5, isd * 0.5
            lb *= 4.0 if r[6] >= 2.5 else 2.0 if r[6] > 1.4 else 1.0
            if r[7] is not None: nf *= 2.5 if r[7] >= 20 else 0.5 if r[7] <= 2 else 1.0
            if r[8] >= 4: nf *= 1.6
            p = [nf, isd, fh, lb]
        else:
            p = [0.35, 0.25, 0.2, 0.2]
        resp.append(np.array(p) / sum(p))
    resp = np.array(resp)
    anchored = np.array([r[2] != "05" for r in rows])
    pinned = resp[anchored].copy()
    for _ in range(iterations):
        mass = resp.sum(axis=0) + 1e-12
        weight = mass / mass.sum()
        mean = (resp.T @ x) / mass[:, None]
        var = np.maximum((resp.T @ (x * x)) / mass[:, None] - mean**2, 1e-3)
        logs = np.log(weight) + np.sum(-0.5 * (np.log(2 * np.pi * var) + (x[:, None, :] - mean) ** 2 / var), axis=2)
        shift = logs.max(axis=1, keepdims=True)
        total = np.exp(logs - shift).sum(axis=1, keepdims=True)
        resp = np.exp(logs - shift) / total
        resp[anchored] = pinned
        likelihood = float(np.sum(np.log(total) + shift))
    return weight, mean, likelihood


def test_em_matches_a_dense_implementation(spark):
    rows = observations()
    df = spark.createDataFrame(
        rows,
        "cycle_id int, customer_id int, decline_code string, issuer_health double, peer_rate double, sibling_rate double, amount_ratio double, "
        "days_since_payday double, n_concurrent int, recovered boolean, recovery_lag_hours double",
    )
    model = diagnosis.fit_cause_em(df, max_iterations=3, tolerance=0.0)
    weight, mean, likelihood = numpy_em(rows, 3)
    assert model.log_likelihood == pytest.approx(likelihood, rel=1e-9)
    for j, cause in enumerate(causes.DIAGNOSABLE):
        assert model.weights[cause] == pytest.approx(weight[j], rel=1e-9)
        assert model.means[cause]["amount_ratio"] == pytest.approx(mean[j][3], rel=1e-9)
    scored = diagnosis.predict_cause(diagnosis.em_rows(df), model)
    totals = scored.select(sum((F.col(f"em_{c}") for c in causes.DIAGNOSABLE), F.lit(0.0)).alias("t")).collect()
    assert all(r["t"] == pytest.approx(1.0) for r in totals)
