"""Calibration, drift and parity monitoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redebit.functions import stats
from redebit.operators import ordered
from redebit.session import checkpointed

ECE_ALERT, PSI_MODERATE, PSI_SIGNIFICANT, SPIKE_SHARE = 0.05, 0.10, 0.25, 0.10


def log_loss(rows: DataFrame, label: Column, p: Column, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or [])).agg(
        F.avg(stats.log_loss_term(label, p)).alias("log_loss"),
        F.avg(F.pow(p - label.cast("double"), 2)).alias("brier"), F.count("*").alias("n"),
    )


def reliability_curve(rows: DataFrame, label: Column, p: Column, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """Equal-width bins: mean prediction, observed rate and count."""
    index = F.greatest(F.least(F.floor(p * bins), F.lit(bins - 1)), F.lit(0)).cast("int")
    return rows.select(*(by or []), index.alias("bin"), p.alias("_p"), label.cast("double").alias("_y")).groupBy(
        *(by or []), "bin"
    ).agg(F.avg("_p").alias("mean_predicted"), F.avg("_y").alias("observed"), F.count("*").alias("n"))


def calibration_error(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Count-weighted gap between prediction and outcome; alerts above 5 percent."""
    gap = F.abs(F.col("mean_predicted") - F.col("observed")) * F.col("n")
    return curve.groupBy(*(by or [])).agg((F.sum(gap) / F.sum("n")).alias("ece")).withColumn(
        "alert", F.col("ece") > ECE_ALERT
    )


def unpivot(rows: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """Long form (feature, value)."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return rows.select(*(keep or []), F.inline(cells))


def value_ranks(counts: DataFrame, buckets: int = 256) -> DataFrame:
    """Cumulative counts over sorted values per feature.

    Values are cut at their own approximate quantiles, so that buckets hold about as many distinct
    values each however they lie; one far value does not push all others into a single bucket. The
    cuts only say where a task ends: counts and running sums are exact.
    """
    cuts = counts.groupBy("feature").agg(
        F.percentile_approx("value", [i / buckets for i in range(1, buckets)], 100 * buckets).alias("_cuts"), F.sum("n").alias("total")
    )
    joined = counts.join(F.broadcast(cuts), "feature")  # one row of ``buckets`` cuts per monitored feature
    bucket = F.size(F.filter("_cuts", lambda c: c <= F.col("value")))
    return ordered.running(joined.withColumn("_bucket", bucket).drop("_cuts"), ["feature"], ["value"], F.col("_bucket"), {"cum": ("sum", F.col("n"))}).drop("_bucket")


def exact_quantiles(counts: DataFrame, probabilities: list[float]) -> DataFrame:
    """Linear-interpolated quantiles per feature from value counts (feature, value, n)."""
    ranked = value_ranks(counts)
    last = F.col("total") - 1
    picks = []
    for i, p in enumerate(probabilities):
        low = F.floor(last * p)
        picks.append(F.min(F.when(F.col("cum") > low, F.col("value"))).alias(f"_a{i}"))
        picks.append(F.min(F.when(F.col("cum") > F.least(low + 1, last), F.col("value"))).alias(f"_b{i}"))
    found = ranked.groupBy("feature").agg(F.max("total").alias("total"), *picks)
    at = [
        F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * ((F.col("total") - 1) * p - F.floor((F.col("total") - 1) * p))
        for i, p in enumerate(probabilities)
    ]
    return found.select("feature", "total", F.array(*at).alias("quantiles"))


def psi(reference: DataFrame, current: DataFrame, bins: int = 10) -> DataFrame:
    """Population stability index per feature of two long frames (feature, value); missing values are left out.

    Bins come from the reference deciles; a value holding a tenth of the reference gets a
    bin of its own, and a constant reference is compared as below / equal / above.
    """
    # Value counts are read several times below; the rows behind them only once.
    known = "value IS NOT NULL AND NOT isnan(value)"
    ref = checkpointed(reference.where(known).groupBy("feature", "value").agg(F.count("*").alias("n")))
    cur = current.where(known).groupBy("feature", "value").agg(F.count("*").alias("n"))
    marks = exact_quantiles(ref, [i / bins for i in range(bins + 1)])
    spike = ref.groupBy("feature").agg(F.max(F.struct("n", (-F.col("value")).alias("neg"))).alias("_top"))
    edges = marks.join(spike, "feature").select(
        "feature", F.array_distinct("quantiles").alias("_q"), (-F.col("_top.neg")).alias("_mode"),
        (F.col("_top.n") / F.col("total") >= SPIKE_SHARE).alias("_spiky"),
    )
    inner = F.slice("_q", 2, F.greatest(F.size("_q") - 2, F.lit(0)))
    constant = F.size("_q") <= 2
    point = F.element_at("_q", 1)
    spiked = F.array_distinct(F.concat(inner, F.array("_mode")))
    ruled = edges.select(
        "feature",
        F.when(constant, F.array(point)).when(F.col("_spiky"), spiked).otherwise(inner).alias("edges"),
        F.when(constant, point).when(F.col("_spiky"), F.col("_mode")).alias("own_bin"),
    )

    def binned(counts: DataFrame, name: str) -> DataFrame:
        placed = counts.join(F.broadcast(ruled), "feature")  # one row per monitored feature
        below = F.size(F.filter("edges", lambda e: e <= F.col("value")))
        past = F.coalesce((F.col("value") > F.col("own_bin")).cast("int"), F.lit(0))
        return placed.groupBy("feature", (below + past).alias("bin")).agg(F.sum("n").alias(name))

    both = binned(ref, "ref_n").join(binned(cur, "cur_n"), ["feature", "bin"], "full").na.fill(0, ["ref_n", "cur_n"])
    totals = both.groupBy("feature").agg(F.sum("ref_n").alias("_r"), F.sum("cur_n").alias("_c"))
    term = stats.psi_term(F.col("ref_n") / F.col("_r"), F.col("cur_n") / F.col("_c"))
    scored = both.join(F.broadcast(totals), "feature").groupBy("feature").agg(F.sum(term).alias("psi"))
    severity = (
        F.when(F.col("psi") >= PSI_SIGNIFICANT, "significant").when(F.col("psi") >= PSI_MODERATE, "moderate").otherwise("stable")
    )
    return scored.withColumn("severity", severity)


def drift_report(reference: DataFrame, current: DataFrame, features: list[str], ece: DataFrame | None = None) -> DataFrame:
    """PSI of every feature, with the calibration error alongside when given."""
    report = psi(unpivot(reference, features), unpivot(current, features))
    error = F.lit(None).cast("double") if ece is None else ece.select("ece").scalar()
    return report.withColumn("alert", F.col("psi") >= PSI_SIGNIFICANT).withColumn("ece", error)


def feature_parity(offline: DataFrame, online: DataFrame, key: str, features: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Worst relative gap per feature between the two feature paths, and rows on one side only."""
    left, right = unpivot(offline, features, [key]), unpivot(online, features, [key])
    joined = left.withColumnRenamed("value", "offline").join(right.withColumnRenamed("value", "online"), [key, "feature"], "full")
    scale = F.greatest(F.abs("offline"), F.abs("online"), F.lit(1e-12))
    gap = joined.withColumn("relative", F.abs(F.col("offline") - F.col("online")) / scale)
    worst = F.max(F.struct("relative", (-F.col(key)).alias("neg_key"), "offline", "online")).alias("w")
    one_sided = F.count_if(F.col("offline").isNull() | F.col("online").isNull())
    return gap.groupBy("feature").agg(worst, F.count("*").alias("rows_compared"), one_sided.alias("one_sided")).select(
        "feature", "rows_compared", "one_sided", F.col("w.relative").alias("relative"), F.col("w.offline").alias("offline"),
        F.col("w.online").alias("online"), ((F.col("w.relative") > tolerance) | (F.col("one_sided") > 0)).alias("skewed"),
    )


def parity_diagnosis(report: DataFrame) -> DataFrame:
    n, bad = F.count("*"), F.count_if("skewed")
    return report.agg(
        bad.alias("skewed"),
        F.when(bad == 0, "no divergence").when(bad == n, "every feature diverges: likely the wrong snapshot")
        .when(bad == 1, "one feature diverges: likely a definition drift").otherwise("several features diverge").alias("diagnosis"),
    )


def alerts(metrics: dict[str, DataFrame]) -> DataFrame:
    """Named one-row metrics (``value``, ``breached``) as rows of an alerts table."""
    parts = [
        df.select(F.lit(name).alias("metric"), F.col("value").cast("double").alias("value"), F.col("breached").alias("breached"))
        for name, df in metrics.items()
    ]
    return reduce(DataFrame.unionByName, parts)
