"""Why debits failed: labelled context rows, anchored EM, confusion counts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redebit.functions import calendar as cal
from redebit.functions import causes
from redebit.operators import history, issuers, ordered
from redebit.session import checkpointed

DAY = cal.DAY
NEAR_SECONDS = 6 * 3600
CONTEXT = ("issuer_health", "peer_rate", "sibling_rate", "amount_ratio", "days_since_payday", "n_concurrent")
OUTCOME = ("recovered_flag", "log_lag")
MIN_VARIANCE = 1e-3


def sibling_failures(attempts: DataFrame, within: int = NEAR_SECONDS, among: DataFrame | None = None) -> DataFrame:
    """Other attempts of the customer within ``within`` seconds, and how many of them failed.

    Input columns: ``customer_id``, ``at``, ``failed``. Counting uses bucketed range sums,
    never pairs. ``among`` are the attempts counted, where ``attempts`` are only some of them.
    """
    stamped = attempts.withColumn("_us", F.unix_micros("at"))
    near = ordered.trailing(
        stamped if among is None else among.withColumn("_us", F.unix_micros("at")), ["customer_id"], "_us", within * 1_000_000, within * 1_000_000,
        {"_n": F.lit(1), "_f": F.col("failed").cast("int")},
    )
    joined = ordered.matched(stamped, near, ["customer_id", "_us"])
    concurrent = (F.col("_n") - 1).cast("int")
    failures = (F.col("_f") - F.col("failed").cast("int")).cast("int")
    return joined.select(
        *attempts.columns, concurrent.alias("concurrent"), failures.alias("sibling_failures"),
        F.when(concurrent > 0, failures / F.greatest(concurrent, F.lit(1))).otherwise(0.0).alias("sibling_rate"),
    )


def cause_observations(cycles: DataFrame, bucket: int = DAY, span: int = 7 * DAY) -> DataFrame:
    """One row per failed cycle with the six context signals and the recovery label."""
    attempts = cycles.select("issuer", F.col("due_at").alias("at"), (~F.col("failed")).alias("success"))
    health = issuers.rolling_health(
        issuers.issuer_windows(attempts, bucket), issuers.issuer_baseline(attempts), span
    ).select("issuer", "window_start", "issuer_health", "peer_rate")
    since = F.pmod(cal.day_of_month_ist(F.col("due_at")) - history.modal_payday(), F.lit(30)).cast("double")
    # What the counters are for is worked out before rows move again.
    known = history.customer_history(cycles, day_at=F.col("due_at")).where("failed").select(
        "cycle_id", "customer_id", "issuer", "decline_code", "failed", F.col("due_at").alias("at"), "due_at", "recovered", "recovered_at",
        history.amount_ratio().alias("amount_ratio"), since.alias("days_since_payday"),
    )
    near = sibling_failures(known, among=cycles.withColumn("at", F.col("due_at")))
    windowed = near.withColumn("window_start", cal.window_start(F.col("at"), bucket))
    lag = (F.unix_seconds("recovered_at") - F.unix_seconds("due_at")) / F.lit(3600.0)
    return windowed.join(health, ["issuer", "window_start"], "left").select(
        "cycle_id", "customer_id", "decline_code", "issuer_health", "peer_rate", "sibling_rate",
        "amount_ratio", "days_since_payday",
        F.greatest(F.col("concurrent"), F.lit(1)).alias("n_concurrent"), "recovered",
        F.when(F.col("recovered"), lag).alias("recovery_lag_hours"),
    )


def context_columns() -> dict[str, Column]:
    return {name: F.col(name) for name in CONTEXT}


def with_cause(observations: DataFrame) -> DataFrame:
    """Rule-based posterior columns ``p_<cause>`` and the most likely cause."""
    p = causes.cause_probabilities(F.col("decline_code"), context_columns())
    named = observations.select("*", *[c.alias(f"p_{n}") for n, c in p.items()])
    return named.withColumn("cause", causes.most_likely({n: F.col(f"p_{n}") for n in p}))


@dataclass(frozen=True)
class CauseMixture:
    """Fitted mixture: weights, means and variances per cause over context and outcome."""

    weights: dict[str, float]
    means: dict[str, dict[str, float]]
    variances: dict[str, dict[str, float]]
    iterations: int
    log_likelihood: float

    def log_joint(self, cause: str, features: tuple[str, ...]) -> Column:
        total = F.lit(math.log(self.weights[cause]))
        for name in features:
            mean, var = self.means[cause][name], max(self.variances[cause][name], MIN_VARIANCE)
            total = total - F.lit(0.5 * math.log(2.0 * math.pi * var)) - F.pow(F.col(name) - mean, 2) * (0.5 / var)
        return total


def _with_posterior(rows: DataFrame, model: CauseMixture, features: tuple[str, ...], prefix: str) -> DataFrame:
    """Normalised probability per cause and the log of their total, in staged projections.

    Each stage names its columns, so no expression is repeated inside the next one.
    """
    names = causes.DIAGNOSABLE
    logs = rows.select("*", *[model.log_joint(c, features).alias(f"_l_{c}") for c in names])
    shifted = logs.withColumn("_shift", F.greatest(*[F.col(f"_l_{c}") for c in names]))
    weighed = shifted.select("*", *[F.exp(F.col(f"_l_{c}") - F.col("_shift")).alias(f"_w_{c}") for c in names])
    total = sum((F.col(f"_w_{c}") for c in names), F.lit(0.0))
    summed = weighed.withColumn("_total", total)
    return summed.select(
        *rows.columns, *[(F.col(f"_w_{c}") / F.col("_total")).alias(f"{prefix}{c}") for c in names],
        (F.log("_total") + F.col("_shift")).alias("log_total"),
    )


def em_rows(observations: DataFrame) -> DataFrame:
    """Numeric features, initial responsibilities and the anchor flag (any code but 05)."""
    p = causes.cause_probabilities(F.col("decline_code"), context_columns())
    total = sum((p[c] for c in causes.DIAGNOSABLE), F.lit(0.0))
    lag = F.col("recovery_lag_hours")
    return observations.select(
        "cycle_id", "customer_id", "decline_code",
        *[F.coalesce(F.col(n).cast("double"), F.lit(-1.0)).alias(n) for n in CONTEXT],
        F.coalesce(F.col("recovered").cast("double"), F.lit(0.0)).alias("recovered_flag"),
        F.when(F.col("recovered") & (lag >= 0), F.log1p(lag)).otherwise(-1.0).alias("log_lag"),
        (F.coalesce("decline_code", F.lit("")) != "05").alias("anchored"),
        *[
            F.when(total > 0, p[c] / F.greatest(total, F.lit(1e-300))).otherwise(1.0 / len(causes.DIAGNOSABLE)).alias(f"r_{c}")
            for c in causes.DIAGNOSABLE
        ],
    )


FEATURES = CONTEXT + OUTCOME


def evidence_patterns(rows: DataFrame) -> DataFrame:
    """Rows of ``em_rows`` that look alike as one, with their number.

    EM sees a row through its features, its first responsibilities and whether it is anchored;
    rows that agree in these move alike in every iteration, so their number is all it needs.
    """
    looks = [*FEATURES, *[f"r_{c}" for c in causes.DIAGNOSABLE], "anchored"]
    return rows.groupBy(*looks).agg(F.count("*").cast("double").alias("n"))


def _expectation(model: CauseMixture | None):
    """Per task: sums of responsibility, weighted features and their squares per cause, and the log likelihood."""
    names, k = causes.DIAGNOSABLE, len(FEATURES)
    if model is not None:
        logs = np.log([model.weights[c] for c in names])
        mean = np.array([[model.means[c][f] for f in FEATURES] for c in names])
        var = np.array([[max(model.variances[c][f], MIN_VARIANCE) for f in FEATURES] for c in names])
        logs = logs - 0.5 * np.log(2.0 * np.pi * var).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(names) * (1 + 2 * k) + 1)
        for batch in batches:
            columns = np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns])
            x, share, anchored, n = columns[:k].T, columns[k:-2].T, columns[-2] > 0, columns[-1]
            if model is not None:
                joint = logs + sum(-0.5 * (x[:, i, None] - mean[:, i]) ** 2 / var[:, i] for i in range(k))
                top = joint.max(1, keepdims=True)
                weight = np.exp(joint - top)
                total = weight.sum(1, keepdims=True)
                share = np.where(anchored[:, None], share, weight / total)
                out[-1] += (n * (np.log(total) + top)[:, 0]).sum()
            counted = share * n[:, None]
            out[:-1] += np.concatenate([counted.sum(0), (counted.T @ x).ravel(), (counted.T @ (x * x)).ravel()])
        yield pa.record_batch({"sums": [out]})

    return run


def _moments(patterns: DataFrame, model: CauseMixture | None) -> dict:
    """Sums per cause over all patterns; as many numbers reach the driver as the model has, whatever the input."""
    parts = patterns.mapInArrow(_expectation(model), "sums array<double>").select(F.posexplode("sums"))
    sums = np.array([r["s"] for r in parts.groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect()])
    names, k = causes.DIAGNOSABLE, len(FEATURES)
    mass, first, second = np.split(sums[:-1], [len(names), len(names) * (1 + k)])
    return {"mass": mass, "first": first.reshape(-1, k), "second": second.reshape(-1, k), "log_likelihood": float(sums[-1])}


def _maximise(moments: dict) -> tuple[dict, dict, dict]:
    mass = moments["mass"] + 1e-12
    mean = moments["first"] / mass[:, None]
    var = np.maximum(moments["second"] / mass[:, None] - mean**2, MIN_VARIANCE)
    by_cause = lambda m: {c: dict(zip(FEATURES, map(float, own))) for c, own in zip(causes.DIAGNOSABLE, m)}
    return dict(zip(causes.DIAGNOSABLE, map(float, mass / mass.sum()))), by_cause(mean), by_cause(var)


def fit_cause_em(observations: DataFrame, max_iterations: int = 200, tolerance: float = 1e-6) -> CauseMixture:
    """Anchored EM over evidence patterns, until the log likelihood moves by less than ``tolerance``.

    Rows with an informative decline code keep their rule-based responsibility; only code 05
    rows move. Rows are folded to patterns once, in the shared checkpoint folder; an iteration
    reads the patterns and adds up a few sums per cause.
    """
    patterns = checkpointed(evidence_patterns(em_rows(observations)))
    moments, previous = _moments(patterns, None), -math.inf
    for iteration in range(1, max_iterations + 1):
        weights, means, variances = _maximise(moments)
        model = CauseMixture(weights, means, variances, iteration, previous)
        moments = _moments(patterns, model)
        likelihood = moments["log_likelihood"]
        model = CauseMixture(weights, means, variances, iteration, likelihood)
        if abs(likelihood - previous) < tolerance:
            break
        previous = likelihood
    return model


def predict_cause(rows: DataFrame, model: CauseMixture) -> DataFrame:
    """Posterior from context alone: outcomes are never known when a decision is made."""
    scored = _with_posterior(rows, model, CONTEXT, "em_").drop("log_total")
    return scored.withColumn("em_cause", causes.most_likely({c: F.col(f"em_{c}") for c in causes.DIAGNOSABLE}))


def confusion_matrix(rows: DataFrame, truth: str, predicted: str, labels: tuple[str, ...]) -> DataFrame:
    """Truth by predicted counts plus recall, one row per true label."""
    hits = [F.count_if(F.col(predicted) == label).alias(label) for label in labels]
    counted = rows.where(F.col(truth).isin(*labels) & F.col(predicted).isin(*labels)).groupBy(
        F.col(truth).alias("truth")
    ).agg(*hits, (F.count_if(F.col(truth) == F.col(predicted)) / F.count("*")).alias("recall"))
    return counted


def precision(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    right = F.count_if(F.col(truth) == F.col(predicted))
    return rows.groupBy(F.col(predicted).alias("predicted")).agg((right / F.count("*")).alias("precision"))


def accuracy(rows: DataFrame, truth: str, predicted: str, labels: tuple[str, ...]) -> DataFrame:
    """Share of rows on the diagonal of the confusion matrix, over rows whose labels are both known."""
    known = rows.where(F.col(truth).isin(*labels) & F.col(predicted).isin(*labels))
    return known.agg(F.count("*").alias("rows"), F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))
