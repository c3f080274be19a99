"""Training-row, model and monitoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redebit.functions import stats
from redebit.operators import estimators, features, history, models, monitor
from redebit.plans import views_sql as v
from redebit.plans.customers import AS_OF, HIST, PAID
from redebit.plans.planning import _PRESENT, funding_windows
from redebit.plans.registry import query
from redebit.session import checkpointed
from redebit.sources import testdata as td


def _sum_columns(names: tuple[str, ...]) -> list:
    return [F.round(F.sum(n), 3).alias(n) for n in names]


SEGPRIOR = """
kk AS (SELECT CASE WHEN recovered THEN (cycle_id % 7 + 1) * 24 END AS k FROM ev_cycles WHERE failed),
kc AS (SELECT coalesce(k, 719) AS s, count(*) AS leaves, count(k) AS events FROM kk GROUP BY 1),
hz AS (SELECT h, least(greatest(coalesce(any_value(e.events), 0) / sum(r.leaves), 1e-6), 1 - 1e-6) AS hz FROM range(720) g(h)
  JOIN kc r ON r.s >= h LEFT JOIN kc e ON e.s = h GROUP BY h),
segp AS (SELECT h // 24 AS d, CASE WHEN h % 24 < 10 THEN 0 WHEN h % 24 < 13 THEN 1 WHEN h % 24 < 17 THEN 2
  WHEN h % 24 * 60 < 1290 THEN 3 ELSE 4 END AS b, 1 - exp(sum(ln(1 - hz))) AS sp FROM hz GROUP BY ALL)"""
BANDRATE = """
bnd AS (SELECT cycle_id, b, count(CASE WHEN paid_at IS NOT NULL AND pband = b THEN 1 END) AS s,
    count(CASE WHEN paid_at IS NOT NULL AND pband = b THEN 1 END) + count(CASE WHEN failed AND fband = b THEN 1 END) AS a
  FROM pairs, range(5) r(b) GROUP BY ALL)"""


def _feature_sql(day: str, band: str, prior: str) -> str:
    return f"""
  round(sum(CASE WHEN coalesce(h.n_paid, 0) = 0 THEN 0 ELSE coalesce(dd.n, 0) / h.n_paid END), 3) AS dom_hist_density,
  round(sum(CAST(coalesce(({day} - m.payday + 30) % 30, -1) AS DOUBLE)), 3) AS days_since_payday,
  round(sum(CASE WHEN coalesce(h.p75, 0) > 0 THEN x.amount_paise / h.p75 ELSE 1.0 END), 3) AS amount_ratio,
  round(sum(CASE WHEN coalesce(bb.a, 0) = 0 THEN 0.5 ELSE bb.s / bb.a END), 3) AS hour_success_rate,
  round(sum(1.0::DOUBLE), 3) AS n_concurrent_mandates, round(sum(coalesce(h.lagm, -1)), 3) AS prior_lag_median,
  round(sum({prior}), 3) AS segment_prior_hazard, round(sum(CAST(x.d AS DOUBLE)), 3) AS day_offset,
  round(sum(CAST({day} AS DOUBLE)), 3) AS day_of_month, round(sum(CAST({band} AS DOUBLE)), 3) AS hour_band,
  round(sum(CAST({v.ticket_band('x.amount_paise')} AS DOUBLE)), 3) AS ticket_band,
  round(sum(CASE x.rail WHEN 'upi_autopay' THEN 0 WHEN 'card_emandate' THEN 1 ELSE 2 END::DOUBLE), 3) AS rail_code,
  round(sum(coalesce(h.n_prior, 0)::DOUBLE), 3) AS n_prior_cycles"""


_JOINS = """LEFT JOIN hist h USING (cycle_id) LEFT JOIN modal m USING (cycle_id)
  LEFT JOIN days dd ON dd.cycle_id = x.cycle_id AND dd.dom = x.dom LEFT JOIN bnd bb ON bb.cycle_id = x.cycle_id AND bb.b = x.b"""
HROWS = f"""
fs AS (SELECT *, CASE WHEN recovered AND {v.day_ist('recovered_at')} - {v.day_ist('due_at')} BETWEEN 0 AND 29
  THEN ({v.day_ist('recovered_at')} - {v.day_ist('due_at')}) * 5 + {v.hour_band('recovered_at')} END AS fslot FROM ev_cycles WHERE failed),
x AS (SELECT fs.*, s AS slot, s // 5 AS d, s % 5 AS b, CAST(day(due_at + INTERVAL 330 MINUTE + (s // 5) * INTERVAL 1 DAY) AS INT) AS dom
  FROM fs, range(150) r(s) WHERE s <= least(coalesce(fslot, 149), 149))"""


def hazard_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles = td.billing_cycles(spark, sf_dir)
    return features.hazard_rows(cycles, features.segment_prior(cycles.where("failed")))


def training_of(cycles: DataFrame, *also: str) -> DataFrame:
    """Stored training rows of cycles that know whose side their customer is on."""
    return checkpointed(features.hazard_rows(cycles, features.segment_prior(cycles.where("failed")), also=(*models.SHARES, *also)))


@query("hazard_rows", v.with_(v.CYCLES, PAID, HIST, BANDRATE, SEGPRIOR, HROWS) + f"""
SELECT CAST(x.slot AS BIGINT) AS slot, count(*) AS n, count(CASE WHEN slot = fslot THEN 1 END) AS positives, {_feature_sql('x.dom', 'x.b', 'coalesce(sp, 0.02)')}
FROM x LEFT JOIN segp ON segp.d = x.d AND segp.b = x.b {_JOINS} GROUP BY x.slot""")
def hazard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hazard_training(spark, sf_dir)
    return rows.groupBy(F.col("slot").cast("bigint").alias("slot")).agg(
        F.count("*").alias("n"), F.sum("label").alias("positives"), *_sum_columns(features.FEATURES)
    )


PROWS = f"""
x AS (SELECT c.*, s AS slot, s // 24 AS d, {v.hour_band('due_at + s * INTERVAL 1 HOUR')} AS b, {v.dom_ist('due_at + s * INTERVAL 1 HOUR')} AS dom
  FROM ev_cycles c, range(25, 168) r(s) WHERE failed AND {v.exec_legal('rail', 'due_at + s * INTERVAL 1 HOUR')}),
lab AS (SELECT *, CASE WHEN {_PRESENT} THEN 1 ELSE 0 END AS label FROM x),
pprior AS (SELECT d, b, avg(label) AS sp FROM lab GROUP BY ALL)"""


def _windows(cycles: DataFrame) -> DataFrame:
    return funding_windows(cycles.where("failed"))


@query("presence_prior", v.with_(v.CYCLES, PROWS) + """
SELECT CAST(d AS INT) AS day_offset, CAST(b AS INT) AS hour_band, round(sp, 6) AS presence FROM pprior""")
def presence_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles = td.billing_cycles(spark, sf_dir)
    return features.presence_prior(cycles, _windows(cycles)).select(
        "day_offset", "hour_band", F.round("segment_prior_hazard", 6).alias("presence")
    )


@query("presence_rows", v.with_(v.CYCLES, PAID, HIST, BANDRATE, PROWS) + f"""
SELECT x.slot AS slot, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, {_feature_sql('x.dom', 'x.b', 'sp')}
FROM lab x JOIN pprior ON pprior.d = x.d AND pprior.b = x.b {_JOINS} GROUP BY x.slot""")
def presence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles = td.billing_cycles(spark, sf_dir)
    windows = _windows(cycles)
    rows = features.presence_rows(cycles, windows, features.presence_prior(cycles, windows))
    return rows.groupBy(F.col("slot").cast("bigint").alias("slot")).agg(
        F.count("*").alias("n"), F.sum("label").alias("positives"), *_sum_columns(features.FEATURES)
    )


@query("profile_rows", v.with_(v.CYCLES, AS_OF, PROWS, """
pm AS (SELECT cycle_id, arg_max(day, {'m': mass, 'd': -day}) AS modal FROM as_of GROUP BY 1)""") + """
SELECT x.slot AS slot, count(*) AS n, round(sum(coalesce(a.mass, 0) / s.n_eff), 3) AS profile_payday_mass,
  round(sum(greatest(1 - entropy / ln(31), 0) * n_eff / (n_eff + 5)), 3) AS profile_confidence,
  round(sum(CASE WHEN (x.dom - modal + 31) % 31 <= 15 THEN (x.dom - modal + 31) % 31 ELSE (x.dom - modal + 31) % 31 - 31 END::DOUBLE), 3)
    AS profile_days_from_modal_payday, round(sum(n_eff), 3) AS profile_observations, CAST(sum(o.n_settled) AS BIGINT) AS settled
FROM x JOIN ords o USING (cycle_id) JOIN asum s USING (cycle_id) JOIN pm USING (cycle_id)
  LEFT JOIN as_of a ON a.cycle_id = x.cycle_id AND a.day = x.dom WHERE NOT x.recovered AND o.n_settled >= 3 GROUP BY x.slot""")
def profile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles = td.billing_cycles(spark, sf_dir)
    rows = features.profile_rows(cycles, _windows(cycles))
    return rows.groupBy(F.col("slot").cast("bigint").alias("slot")).agg(
        F.count("*").alias("n"), *_sum_columns(features.PROFILE_FEATURES), F.sum("n_settled").alias("settled")
    )


_V0 = f"""
hr AS (SELECT dom, b, {v.ticket_band('amount_paise')} AS tb, slot, CASE WHEN slot = fslot THEN 1 ELSE 0 END AS label FROM x),
gl AS (SELECT avg(label) AS g FROM hr),
v0 AS (SELECT dom, b, tb, count(*) AS n, sum(label) AS events, least(greatest(count(*) / (count(*) + 5.0) * avg(label)
  + (1 - count(*) / (count(*) + 5.0)) * any_value(g), 1e-6), 1 - 1e-6) AS hazard FROM hr, gl GROUP BY ALL HAVING count(*) >= 50)"""


@query("hazard_v0", v.with_(v.CYCLES, HROWS, _V0) + """
SELECT CAST(dom AS INT) AS day_of_month, CAST(b AS INT) AS hour_band, CAST(tb AS INT) AS ticket_band, n,
  CAST(events AS BIGINT) AS events, round(hazard, 6) AS hazard FROM v0""")
def hazard_v0(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = models.hazard_v0(hazard_training(spark, sf_dir))
    return cells.select(*[F.col(c).cast("int").alias(c) for c in models.CELL], "n", "events", F.round("hazard", 6).alias("hazard"))


_SC = """
sc AS (SELECT hr.slot, coalesce(hazard, g) AS hz FROM hr CROSS JOIN gl LEFT JOIN v0 USING (dom, b, tb))"""


def _scored_v0(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hazard_training(spark, sf_dir)  # the cells need four columns of it, so it is not stored
    return models.score_v0(rows, models.hazard_v0(rows))


@query("hazards_by_slot", v.with_(v.CYCLES, HROWS, _V0, _SC) + "SELECT slot, round(avg(hz), 6) AS mean_hazard, count(*) AS n FROM sc GROUP BY slot")
def hazards_by_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = models.hazards_by(_scored_v0(spark, sf_dir), "hazard_v0", F.col("slot").cast("bigint"), "slot")
    return means.withColumn("mean_hazard", F.round("mean_hazard", 6))


@query("daily_hazard", v.with_(v.CYCLES, HROWS, _V0, _SC) + """
SELECT slot // 5 AS day, round(avg(hz), 6) AS mean_hazard, count(*) AS n FROM sc GROUP BY 1""")
def daily_hazard(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = models.hazards_by(_scored_v0(spark, sf_dir), "hazard_v0", F.floor(F.col("slot") / 5), "day")
    return means.withColumn("mean_hazard", F.round("mean_hazard", 6))


@query("fit_hazard_v1")
def fit_hazard_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted and calibrated hazards on held-out customers, per day: observed against predicted."""
    cycles = models.with_shares(estimators.group_split(td.billing_cycles(spark, sf_dir), "customer_id", 0.3))
    rows = training_of(cycles, "is_holdout")
    model = models.fit_hazard_v1(rows.where("NOT is_holdout"))
    scored = model.score(rows.where("is_holdout"))
    return scored.groupBy(F.floor(F.col("day_offset")).alias("day")).agg(
        F.count("*").alias("n"), F.round(F.avg("hazard_v1"), 6).alias("predicted"), F.round(F.avg("label"), 6).alias("observed")
    )


@query("score_curves")
def score_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves from the boosted model for most cycles, the cell table for the rest."""
    rows = training_of(models.with_shares(td.billing_cycles(spark, sf_dir)))
    model = models.fit_hazard_v1(rows)
    counts = rows.agg(F.count("*").alias("n"), F.sum(F.col("label").cast("bigint")).alias("p"))
    version = models.model_version_id(
        "liquidity_hazard", "gbt", {"max_iter": 300, "tolerance": 0.01}, features.FEATURES,
        models.fingerprint(counts.select("n").scalar(), counts.select("p").scalar()),
    )
    enabled = F.col("customer_id") % 4 != 0
    curves = models.score_curves(rows, model, models.hazard_v0(rows), enabled, F.col("hour_band") != 1)
    return curves.withColumn("model_version", version).groupBy("model_version", "fallback", F.col("hour_band").cast("int").alias("hour_band")).agg(
        F.count("*").alias("n"), F.round(F.avg("hazard"), 6).alias("mean_hazard")
    )


@query("model_version_id", v.with_(v.CYCLES, """
c AS (SELECT rail, count(*) AS n, count(CASE WHEN recovered THEN 1 END) AS p FROM ev_cycles WHERE failed GROUP BY rail),
f AS (SELECT rail, substr(sha256('[' || n || ',' || p || ',null]'), 1, 16) AS fp FROM c)""") + """
SELECT rail, fp AS fingerprint, substr(sha256('{"decision_point":"liquidity_hazard","feature_names":["a","b"],"kind":"cells","params":{"kappa":5},"training_fingerprint":"'
  || fp || '"}'), 1, 16) AS version_id FROM f""")
def model_version_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = td.billing_cycles(spark, sf_dir).where("failed").groupBy("rail").agg(
        F.count("*").alias("n"), F.count_if("recovered").alias("p")
    )
    stamped = counts.withColumn("fingerprint", models.fingerprint(F.col("n"), F.col("p")))
    version = models.model_version_id("liquidity_hazard", "cells", {"kappa": 5}, ("a", "b"), F.col("fingerprint"))
    return stamped.select("rail", "fingerprint", version.alias("version_id"))


# ------------------------------------------------------------------ monitoring

SCORED = """
scored AS (SELECT c.cycle_id, c.rail, NOT c.failed AS y, c.due_at, coalesce(h.n_prior, 0) AS n_prior,
  (coalesce(h.n_paid, 0) + 1) / (coalesce(h.n_prior, 0) + 2) AS p FROM paid c LEFT JOIN hist h USING (cycle_id))"""


def scored_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-presentation success scored by the customer's own earlier record."""
    known = history.customer_history(td.billing_cycles(spark, sf_dir))
    return known.select(
        "cycle_id", "rail", (~F.col("failed")).alias("y"), "due_at", "n_prior",
        ((F.col("n_paid") + 1) / (F.col("n_prior") + 2)).alias("p"),
    )


_LL = "-(CAST(y AS INT) * ln(greatest(least(p, 1 - 1e-15), 1e-15)) + (1 - CAST(y AS INT)) * ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)))"


@query("log_loss", v.with_(v.CYCLES, PAID, HIST, SCORED) + f"""
SELECT rail, round(avg({_LL}), 6) AS log_loss, round(avg((p - CAST(y AS INT)) ** 2), 6) AS brier, count(*) AS n FROM scored GROUP BY rail""")
def log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = monitor.log_loss(scored_cycles(spark, sf_dir), F.col("y"), F.col("p"), ["rail"])
    return result.select("rail", F.round("log_loss", 6).alias("log_loss"), F.round("brier", 6).alias("brier"), "n")


_REL = """
rel AS (SELECT rail, CAST(least(floor(p * 10), 9) AS INT) AS bin, avg(p) AS mp, avg(CAST(y AS INT)) AS ob, count(*) AS n FROM scored GROUP BY ALL)"""


@query("reliability_curve", v.with_(v.CYCLES, PAID, HIST, SCORED, _REL) + """
SELECT rail, bin, round(mp, 6) AS mean_predicted, round(ob, 6) AS observed, n FROM rel""")
def reliability_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = monitor.reliability_curve(scored_cycles(spark, sf_dir), F.col("y"), F.col("p"), by=["rail"])
    return curve.withColumn("mean_predicted", F.round("mean_predicted", 6)).withColumn("observed", F.round("observed", 6))


@query("calibration_error", v.with_(v.CYCLES, PAID, HIST, SCORED, _REL) + """
SELECT rail, round(sum(abs(mp - ob) * n) / sum(n), 6) AS ece, sum(abs(mp - ob) * n) / sum(n) > 0.05 AS alert FROM rel GROUP BY rail""")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = monitor.reliability_curve(scored_cycles(spark, sf_dir), F.col("y"), F.col("p"), by=["rail"])
    return monitor.calibration_error(curve, ["rail"]).withColumn("ece", F.round("ece", 6))


@query("learning_curve", v.with_(v.CYCLES, PAID, HIST, SCORED, f"""
lc AS (SELECT n_prior, count(*) AS n, avg({_LL}) AS informed, avg({_LL.replace('least(p', 'least(0.5').replace('least(p', 'least(0.5')}) AS plain FROM scored GROUP BY 1)""") + """
SELECT CAST(n_prior AS INT) AS cycles_observed, n, round(informed, 6) AS log_loss_informed, round(plain, 6) AS log_loss_segment_only,
  round(plain - informed, 6) AS improvement FROM lc""")
def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-loss by cycles observed, with the customer's record and without it."""
    y, p = F.col("y"), F.col("p")
    informed, plain = stats.log_loss_term(y, p), stats.log_loss_term(y, F.lit(0.5))
    curve = scored_cycles(spark, sf_dir).groupBy(F.col("n_prior").alias("cycles_observed")).agg(
        F.count("*").alias("n"), F.avg(informed).alias("_i"), F.avg(plain).alias("_s")
    )
    return curve.select(
        "cycles_observed", "n", F.round("_i", 6).alias("log_loss_informed"), F.round("_s", 6).alias("log_loss_segment_only"),
        F.round(F.col("_s") - F.col("_i"), 6).alias("improvement"),
    )


DRIFT_FEATURES = ["amount", "weekday", "constant", "delay"]
_CUT = "1998-06-01 00:00:00"
_DRIFT = f"""
fe AS (SELECT due_at < TIMESTAMP '{_CUT}' AS is_ref, CAST(amount_paise AS DOUBLE) AS amount, CAST(cycle_id % 7 AS DOUBLE) AS weekday,
  1.0::DOUBLE AS constant, CASE WHEN recovered THEN CAST(cycle_id % 7 + 1 AS DOUBLE) ELSE 0 END AS delay FROM ev_cycles),
lo AS (SELECT is_ref, unnest(['amount', 'weekday', 'constant', 'delay']) AS feature, unnest([amount, weekday, constant, delay]) AS value FROM fe),
qs AS (SELECT feature, count(*) AS total, list_sort(list_distinct(quantile_cont(value, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS q FROM lo WHERE is_ref GROUP BY 1),
vc AS (SELECT feature, value, count(*) AS n FROM lo WHERE is_ref GROUP BY ALL),
md AS (SELECT feature, arg_max(value, {{'n': n, 'v': -value}}) AS md, max(n) AS mn FROM vc GROUP BY 1),
ed AS (SELECT feature, CASE WHEN len(q) <= 2 THEN [q[1]] WHEN mn / total >= 0.1 THEN list_distinct(list_concat(q[2:len(q) - 1], [md])) ELSE q[2:len(q) - 1] END AS e,
  CASE WHEN len(q) <= 2 THEN q[1] WHEN mn / total >= 0.1 THEN md END AS own FROM qs JOIN md USING (feature)),
bn AS (SELECT l.feature, l.is_ref, len(list_filter(e, lambda z: z <= l.value)) + coalesce(CAST(l.value > own AS INT), 0) AS bin FROM lo l JOIN ed USING (feature)),
ct AS (SELECT feature, bin, count(CASE WHEN is_ref THEN 1 END) AS r, count(CASE WHEN NOT is_ref THEN 1 END) AS c FROM bn GROUP BY ALL),
sh AS (SELECT feature, greatest(r / sum(r) OVER (PARTITION BY feature), 1e-6) AS r, greatest(c / sum(c) OVER (PARTITION BY feature), 1e-6) AS c FROM ct),
ps AS (SELECT feature, sum((c - r) * ln(c / r)) AS psi FROM sh GROUP BY 1)"""


def drift_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = td.billing_cycles(spark, sf_dir).select(
        (F.col("due_at") < F.lit(_CUT).cast("timestamp")).alias("is_ref"), F.col("amount_paise").cast("double").alias("amount"),
        (F.col("cycle_id") % 7).cast("double").alias("weekday"), F.lit(1.0).alias("constant"),
        F.when(F.col("recovered"), (F.col("cycle_id") % 7 + 1).cast("double")).otherwise(0.0).alias("delay"),
    )
    return rows.where("is_ref"), rows.where("NOT is_ref")


@query("psi", v.with_(v.CYCLES, _DRIFT) + """
SELECT feature, round(psi, 6) AS psi, CASE WHEN psi >= 0.25 THEN 'significant' WHEN psi >= 0.1 THEN 'moderate' ELSE 'stable' END AS severity FROM ps""")
def psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cur = drift_sides(spark, sf_dir)
    scores = monitor.psi(monitor.unpivot(ref, DRIFT_FEATURES), monitor.unpivot(cur, DRIFT_FEATURES))
    return scores.withColumn("psi", F.round("psi", 6))


@query("drift_report", v.with_(v.CYCLES, PAID, HIST, SCORED, """
rel AS (SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, avg(p) AS mp, avg(CAST(y AS INT)) AS ob, count(*) AS n FROM scored GROUP BY ALL),
er AS (SELECT sum(abs(mp - ob) * n) / sum(n) AS ece FROM rel)""", _DRIFT) + """
SELECT feature, round(psi, 6) AS psi, psi >= 0.25 AS alert, round(ece, 6) AS ece FROM ps, er""")
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cur = drift_sides(spark, sf_dir)
    error = monitor.calibration_error(monitor.reliability_curve(scored_cycles(spark, sf_dir), F.col("y"), F.col("p")))
    report = monitor.drift_report(ref, cur, DRIFT_FEATURES, error)
    return report.select("feature", F.round("psi", 6).alias("psi"), "alert", F.round("ece", 6).alias("ece"))


_PAR = """
off_ AS (SELECT o_orderkey AS k, o_totalprice AS a, CAST(o_custkey AS DOUBLE) AS b, o_totalprice * 2 AS c FROM orders),
on_ AS (SELECT k, a, CASE WHEN k % 1000 = 7 THEN b * 1.000001 ELSE b END AS b, CASE WHEN k % 500 = 3 THEN c + 1 ELSE c END AS c FROM off_ WHERE k % 5000 <> 11),
lo AS (SELECT k, unnest(['a', 'b', 'c']) AS feature, unnest([a, b, c]) AS offline FROM off_),
ln AS (SELECT k, unnest(['a', 'b', 'c']) AS feature, unnest([a, b, c]) AS online FROM on_),
g AS (SELECT feature, lo.offline, ln.online, abs(lo.offline - ln.online) / greatest(abs(lo.offline), abs(ln.online), 1e-12) AS rel
  FROM lo FULL JOIN ln USING (k, feature)),
p AS (SELECT feature, count(*) AS rows_compared, count(CASE WHEN online IS NULL THEN 1 END) AS one_sided, max(rel) AS rel FROM g GROUP BY feature)"""


def parity_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("k")
    offline = td.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("a"), F.col("o_custkey").cast("double").alias("b"),
        (F.col("o_totalprice") * 2).alias("c"),
    )
    online = offline.where(k % 5000 != 11).select(
        "k", "a", F.when(k % 1000 == 7, F.col("b") * 1.000001).otherwise(F.col("b")).alias("b"),
        F.when(k % 500 == 3, F.col("c") + 1).otherwise(F.col("c")).alias("c"),
    )
    return offline, online


@query("feature_parity", "WITH " + _PAR + """
SELECT feature, rows_compared, one_sided, round(rel * 1e6, 6) AS relative_ppm, rel > 1e-9 OR one_sided > 0 AS skewed FROM p""")
def feature_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = monitor.feature_parity(*parity_sides(spark, sf_dir), "k", ["a", "b", "c"])
    return report.select("feature", "rows_compared", "one_sided", F.round(F.col("relative") * 1e6, 6).alias("relative_ppm"), "skewed")


@query("parity_diagnosis", "WITH " + _PAR + """
SELECT count(CASE WHEN rel > 1e-9 OR one_sided > 0 THEN 1 END) AS skewed, 'every feature diverges: likely the wrong snapshot' AS diagnosis FROM p""")
def parity_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.parity_diagnosis(monitor.feature_parity(*parity_sides(spark, sf_dir), "k", ["a", "b", "c"]))
