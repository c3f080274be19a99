"""Issuer health and decline-cause queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redebit.functions import causes, stats
from redebit.operators import diagnosis, issuers
from redebit.plans import views_sql as v
from redebit.plans.customers import HIST, PAID
from redebit.plans.registry import query
from redebit.session import checkpointed
from redebit.sources import testdata as td

DAY = td.DAY
# The small tables see about two attempts per issuer and hour, so windows are a day wide
# and the detector is tuned to react; the defaults serve five-minute windows.
TUNING = dict(fraction=0.95, slack=0.0, threshold=0.01, min_attempts=5)

ATT = f"""
att AS (SELECT issuer, occurred_at, event_type = 'payment.captured' AS success
  FROM ev_events WHERE event_type IN ('payment.failed', 'payment.captured')),
win AS (SELECT issuer, {v.secs('occurred_at')} // 86400 * 86400 AS start_s, count(*) AS attempts,
  count(CASE WHEN success THEN 1 END) AS successes FROM att GROUP BY ALL),
base AS (SELECT greatest(count(CASE WHEN success THEN 1 END) / count(*), 0.05) AS b FROM att)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = F.col("event_type") == "payment.captured"
    return td.payment_events(spark, sf_dir).where(paid | (F.col("event_type") == "payment.failed")).select(
        "event_id", "customer_id", "issuer", F.col("occurred_at").alias("at"), paid.alias("success"),
    )


@query("issuer_windows", v.with_(v.EVENTS, ATT) + f"""
SELECT issuer, start_s, attempts, successes, round({v.wilson('successes', 'attempts', '-')}, 6) AS wilson_lower,
  round({v.wilson('successes', 'attempts', '+')}, 6) AS wilson_upper FROM win""")
def issuer_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = F.col("successes"), F.col("attempts")
    return issuers.issuer_windows(attempts(spark, sf_dir), DAY).select(
        "issuer", F.unix_seconds("window_start").alias("start_s"), "attempts", "successes",
        F.round(stats.wilson_lower(s, n), 6).alias("wilson_lower"),
        F.round(stats.wilson_upper(s, n), 6).alias("wilson_upper"),
    )


@query("issuer_baseline", v.with_(v.EVENTS, ATT) + "SELECT round(b, 6) AS baseline FROM base")
def issuer_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.count_if("success") / F.count("*")
    return attempts(spark, sf_dir).agg(F.round(F.greatest(rate, F.lit(0.05)), 6).alias("baseline"))


_TRAIL = """
tr AS (SELECT *, CAST(sum(attempts) OVER w AS BIGINT) AS ta, CAST(sum(successes) OVER w AS BIGINT) AS tsuc FROM win
  WINDOW w AS (PARTITION BY issuer ORDER BY start_s RANGE BETWEEN 259200 PRECEDING AND CURRENT ROW))"""


@query("trailing_issuer_counts", v.with_(v.EVENTS, ATT, _TRAIL) + """
SELECT issuer, start_s, ta AS trailing_attempts, tsuc AS trailing_successes FROM tr""")
def trailing_issuer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = issuers.issuer_windows(attempts(spark, sf_dir), DAY)
    return issuers.trailing_counts(windows, 3 * DAY).select(
        "issuer", F.unix_seconds("window_start").alias("start_s"), "trailing_attempts", "trailing_successes"
    )


@query("rolling_issuer_health", v.with_(v.EVENTS, ATT, _TRAIL) + f"""
SELECT issuer, start_s, round(CASE WHEN ta < 5 THEN 1.0 ELSE least(1.0, {v.wilson('tsuc', 'ta', '-')} / b) END, 6)
  AS issuer_health, round(CASE WHEN ta < 5 THEN 1.0 ELSE least(1.0, tsuc / ta / b) END, 6) AS peer_rate FROM tr, base""")
def rolling_issuer_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = attempts(spark, sf_dir)
    health = issuers.rolling_health(issuers.issuer_windows(seen, DAY), issuers.issuer_baseline(seen), 3 * DAY)
    return health.select(
        "issuer", F.unix_seconds("window_start").alias("start_s"),
        F.round("issuer_health", 6).alias("issuer_health"), F.round("peer_rate", 6).alias("peer_rate"),
    )


def cusum_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = attempts(spark, sf_dir)
    return issuers.issuer_cusum(issuers.issuer_windows(seen, DAY), issuers.issuer_baseline(seen), **TUNING)


_CUSUM = f"""
inp AS (SELECT issuer, start_s, attempts, row_number() OVER (PARTITION BY issuer ORDER BY start_s) AS rn,
  (b * 0.95 - {v.wilson('successes', 'attempts', '+')}) / (b * 0.95) AS dev,
  {v.wilson('successes', 'attempts', '+')} < b * 0.95 AS bad FROM win, base),
st AS (
  SELECT DISTINCT issuer, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS start_s, CAST(0 AS DOUBLE) AS cusum,
    CAST(-1 AS BIGINT) AS since, CAST(0 AS BIGINT) AS streak, CAST(0 AS BIGINT) AS outages, CAST(0 AS DOUBLE) AS minutes FROM inp
  UNION ALL
  SELECT i.issuer, i.rn, i.start_s,
    CASE WHEN attempts < 5 THEN cusum WHEN since >= 0 AND NOT bad AND streak + 1 >= 2 THEN 0.0
      ELSE greatest(0.0, cusum + dev) END,
    CASE WHEN attempts < 5 THEN since WHEN since < 0 AND greatest(0.0, cusum + dev) > 0.01 AND bad THEN i.start_s
      WHEN since >= 0 AND NOT bad AND streak + 1 >= 2 THEN -1 ELSE since END,
    CASE WHEN attempts < 5 THEN streak WHEN since < 0 THEN
        CASE WHEN greatest(0.0, cusum + dev) > 0.01 AND bad THEN 0 ELSE streak END
      WHEN bad THEN greatest(0, streak - 1) WHEN streak + 1 >= 2 THEN 0 ELSE streak + 1 END,
    outages + CASE WHEN attempts >= 5 AND since >= 0 AND NOT bad AND streak + 1 >= 2 THEN 1 ELSE 0 END,
    minutes + CASE WHEN attempts >= 5 AND since >= 0 AND NOT bad AND streak + 1 >= 2 THEN (i.start_s - since) / 60.0 ELSE 0 END
  FROM st JOIN inp i ON i.issuer = st.issuer AND i.rn = st.rn + 1)"""
_REC = "WITH RECURSIVE " + v.with_(v.EVENTS, ATT, _CUSUM)[5:]


@query("issuer_cusum", _REC + """
SELECT issuer, start_s, round(cusum, 6) AS cusum, since AS degraded_since_s, CAST(streak AS INT) AS healthy_streak,
  CAST(outages AS INT) AS outages, round(minutes, 6) AS outage_minutes FROM st WHERE rn > 0""")
def issuer_cusum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cusum_states(spark, sf_dir).withColumn("cusum", F.round("cusum", 6)).withColumn(
        "outage_minutes", F.round("outage_minutes", 6)
    )


_ASOF = """
pts AS (SELECT event_id, issuer, occurred_at, epoch_us(occurred_at) // 1000000 AS at_s FROM ev_events),
seen AS (SELECT p.event_id, p.at_s, arg_max({'since': s.since, 'outages': s.outages, 'minutes': s.minutes}, s.start_s) AS x
  FROM pts p LEFT JOIN st s ON s.issuer = p.issuer AND s.rn > 0 AND s.start_s < p.at_s // 86400 * 86400 GROUP BY ALL),
eta AS (SELECT event_id, at_s, x.since AS since, CASE WHEN x.since >= 0 THEN greatest(
    CASE WHEN x.outages > 0 THEN x.minutes / x.outages ELSE 54.0 END - greatest((at_s - x.since) / 60.0, 0),
    CASE WHEN x.outages > 0 THEN x.minutes / x.outages ELSE 54.0 END * 0.25) END AS eta FROM seen)"""


def _points_with_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = td.payment_events(spark, sf_dir).select("event_id", "issuer", F.col("occurred_at").alias("at"))
    known = issuers.state_as_of(points, cusum_states(spark, sf_dir), DAY)
    eta = issuers.recovery_eta_minutes(
        F.unix_seconds("at"), F.col("degraded_since_s"), F.col("outages"), F.col("outage_minutes")
    )
    return known.withColumn("eta_minutes", eta)


@query("issuer_state_asof", _REC.rstrip() + "," + _ASOF + """
SELECT event_id, coalesce(since, -2) AS degraded_since_s, round(coalesce(eta, -1), 6) AS eta_minutes FROM eta""")
def issuer_state_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points_with_eta(spark, sf_dir).select(
        "event_id", F.coalesce("degraded_since_s", F.lit(-2)).alias("degraded_since_s"),
        F.round(F.coalesce("eta_minutes", F.lit(-1.0)), 6).alias("eta_minutes"),
    )


@query("health_multiplier", _REC.rstrip() + "," + _ASOF + """
SELECT s AS slot, round(sum(CASE WHEN coalesce(s < eta / 60.0, FALSE) THEN 0.15 ELSE 1.0::DOUBLE END), 6) AS total
FROM eta, range(0, 48, 6) r(s) GROUP BY s""")
def health_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(42).cast("bigint"), F.lit(6).cast("bigint")))
    points = _points_with_eta(spark, sf_dir).select("eta_minutes", slots.alias("slot"))
    return points.groupBy("slot").agg(
        F.round(F.sum(issuers.health_multiplier(F.col("slot"), F.col("eta_minutes"))), 6).alias("total")
    )


@query("sibling_failures", v.with_(v.EVENTS) + """
, pay AS (SELECT event_id, customer_id, occurred_at, event_type = 'payment.failed' AS failed FROM ev_events
  WHERE event_type IN ('payment.failed', 'payment.captured')),
w AS (SELECT event_id, failed, count(*) OVER x AS n, sum(CAST(failed AS INT)) OVER x AS f FROM pay
  WINDOW x AS (PARTITION BY customer_id ORDER BY occurred_at RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND INTERVAL 6 HOUR FOLLOWING))
SELECT event_id, CAST(n - 1 AS INT) AS concurrent, CAST(f - CAST(failed AS INT) AS INT) AS sibling_failures,
  round(CASE WHEN n > 1 THEN (f - CAST(failed AS INT)) / (n - 1) ELSE 0 END, 6) AS sibling_rate FROM w""".replace("\n, pay", ",\npay", 1))
def sibling_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = attempts(spark, sf_dir).select("event_id", "customer_id", "at", (~F.col("success")).alias("failed"))
    return diagnosis.sibling_failures(seen).select(
        "event_id", "concurrent", "sibling_failures", F.round("sibling_rate", 6).alias("sibling_rate")
    )


@query("cause_posterior", v.with_(v.EVENTS) + f"""
, w AS (SELECT event_id, decline_code, {v.cause_weights('decline_code')} FROM ev_events WHERE event_type = 'payment.failed'),
t AS (SELECT *, w_no_funds + w_issuer_degraded + w_fraud_hold + w_limit_breach + w_mandate_dead + w_credential_dead AS tot FROM w)
SELECT event_id, round(w_no_funds / tot, 6) AS no_funds, round(w_issuer_degraded / tot, 6) AS issuer_degraded,
  round(w_fraud_hold / tot, 6) AS fraud_hold, round(w_limit_breach / tot, 6) AS limit_breach,
  round(w_mandate_dead / tot, 6) AS mandate_dead, round(w_credential_dead / tot, 6) AS credential_dead FROM t
""".replace("\n, w", ",\nw", 1))
def cause_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = causes.cause_probabilities(F.col("decline_code"))
    failed = td.payment_events(spark, sf_dir).where("event_type = 'payment.failed'")
    return failed.select("event_id", *[F.round(c, 6).alias(n) for n, c in p.items()])


@query("top_cause", v.with_(v.EVENTS) + f"""
SELECT coalesce(decline_code, 'none') AS code, CASE WHEN decline_code = '61' THEN 'limit_breach'
  WHEN decline_code IN ('41', '54') THEN 'credential_dead' WHEN decline_code = '57' THEN 'mandate_dead' ELSE 'no_funds' END AS cause,
  count(*) AS n, round(any_value({v.p_recoverable('decline_code')}), 6) AS p_recoverable
FROM ev_events WHERE event_type = 'payment.failed' GROUP BY 1, 2""")
def top_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("decline_code")
    failed = td.payment_events(spark, sf_dir).where("event_type = 'payment.failed'")
    named = failed.select(
        F.coalesce(code, F.lit("none")).alias("code"), causes.most_likely(causes.cause_probabilities(code)).alias("cause"),
        F.round(causes.p_recoverable(code), 6).alias("p_recoverable"),
    )
    return named.groupBy("code", "cause").agg(F.count("*").alias("n"), F.any_value("p_recoverable").cast("double").alias("p_recoverable"))


@query("p_recoverable", v.with_(v.CYCLES) + f"""
SELECT mandate_id, round(sum({v.p_recoverable('decline_code')}), 6) AS recoverable, count(*) AS failures
FROM ev_cycles WHERE failed GROUP BY mandate_id""")
def p_recoverable(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = td.billing_cycles(spark, sf_dir).where("failed")
    return failed.groupBy("mandate_id").agg(
        F.round(F.sum(causes.p_recoverable(F.col("decline_code"))), 6).alias("recoverable"), F.count("*").alias("failures")
    )


OBS = f"""
catt AS (SELECT issuer, {v.secs('due_at')} AS s, count(*) AS attempts, count(CASE WHEN NOT failed THEN 1 END) AS successes
  FROM ev_cycles GROUP BY ALL),
cbase AS (SELECT greatest(sum(successes) / sum(attempts), 0.05) AS b FROM catt),
ctr AS (SELECT issuer, s, sum(attempts) OVER w AS ta, sum(successes) OVER w AS tsuc FROM catt
  WINDOW w AS (PARTITION BY issuer ORDER BY s RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW)),
chealth AS (SELECT issuer, s, CASE WHEN ta < 5 THEN 1.0 ELSE least(1.0, {v.wilson('tsuc', 'ta', '-')} / b) END AS ih,
  CASE WHEN ta < 5 THEN 1.0 ELSE least(1.0, tsuc / ta / b) END AS peer FROM ctr, cbase),
sib AS (SELECT cycle_id, count(*) OVER x - 1 AS nc, sum(CAST(failed AS INT)) OVER x - CAST(failed AS INT) AS fc FROM ev_cycles
  WINDOW x AS (PARTITION BY customer_id ORDER BY due_at RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND INTERVAL 6 HOUR FOLLOWING)),
ddays AS (SELECT c.cycle_id, p.due_dom AS dom, count(*) AS n FROM paid c JOIN paid p ON p.customer_id = c.customer_id
  AND p.rn < c.rn AND p.paid_at IS NOT NULL GROUP BY ALL),
dmodal AS (SELECT cycle_id, arg_max(dom, {{'n': n, 'd': -dom}}) AS payday FROM ddays GROUP BY 1),
obs AS (
  SELECT c.cycle_id, c.decline_code, ih, peer, CASE WHEN nc > 0 THEN fc / nc ELSE 0 END AS sib,
    CASE WHEN coalesce(h.p75, 0) > 0 THEN c.amount_paise / h.p75 ELSE 1.0 END AS ratio,
    CAST((c.due_dom - payday + 30) % 30 AS DOUBLE) AS dsp, greatest(nc, 1) AS ncon, c.recovered
  FROM paid c JOIN sib USING (cycle_id) LEFT JOIN hist h USING (cycle_id) LEFT JOIN dmodal USING (cycle_id)
  LEFT JOIN chealth k ON k.issuer = c.issuer AND k.s = {v.secs('c.due_at')} WHERE c.failed)"""


def cause_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosis.cause_observations(td.billing_cycles(spark, sf_dir))


@query("cause_observations", v.with_(v.CYCLES, PAID, HIST, OBS) + """
SELECT cycle_id, round(ih, 6) AS issuer_health, round(peer, 6) AS peer_rate, round(sib, 6) AS sibling_rate,
  round(ratio, 6) AS amount_ratio, coalesce(dsp, -1.0) AS days_since_payday, CAST(ncon AS INT) AS n_concurrent, recovered
FROM obs""")
def cause_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cause_rows(spark, sf_dir).select(
        "cycle_id", F.round("issuer_health", 6).alias("issuer_health"), F.round("peer_rate", 6).alias("peer_rate"),
        F.round("sibling_rate", 6).alias("sibling_rate"), F.round("amount_ratio", 6).alias("amount_ratio"),
        F.coalesce("days_since_payday", F.lit(-1.0)).alias("days_since_payday"), "n_concurrent", "recovered",
    )


_AMBIG = """
w05 AS (SELECT *, 1.0 * CASE WHEN ih < 0.85 THEN 0.5 ELSE 1 END * CASE WHEN peer < 0.5 THEN 0.6 ELSE 1 END
    * CASE WHEN sib > 0.5 THEN 2.5 ELSE 1 END * CASE WHEN dsp >= 20 THEN 2.5 WHEN dsp <= 2 THEN 0.5 ELSE 1 END
    * CASE WHEN ncon >= 4 THEN 1.6 ELSE 1 END AS nf,
  0.35 * CASE WHEN ih < 0.85 THEN 4.0 ELSE 1 END * CASE WHEN peer < 0.5 THEN 3.0 ELSE 1 END
    * CASE WHEN sib > 0.5 THEN 0.5 ELSE 1 END AS idg,
  0.2 * CASE WHEN ratio >= 2.5 THEN 4.0 WHEN ratio > 1.4 THEN 2.0 ELSE 1 END AS lb FROM obs),
pred AS (SELECT *, CASE WHEN nf >= idg AND nf >= 0.25 AND nf >= lb THEN 'no_funds' WHEN idg >= 0.25 AND idg >= lb THEN 'issuer_degraded'
  WHEN 0.25 >= lb THEN 'fraud_hold' ELSE 'limit_breach' END AS cause FROM w05)"""


@query("contextual_cause", v.with_(v.CYCLES, PAID, HIST, OBS, _AMBIG) + """
SELECT cycle_id, cause, round(nf / (nf + idg + lb + 0.25), 6) AS p_no_funds FROM pred WHERE decline_code = '05'""")
def contextual_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = diagnosis.with_cause(cause_rows(spark, sf_dir).where("decline_code = '05'"))
    return named.select("cycle_id", "cause", F.round("p_no_funds", 6).alias("p_no_funds"))


def _truth_and_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded failures re-diagnosed as if the code had been the catch-all 05."""
    rows = cause_rows(spark, sf_dir).where(F.col("decline_code").isin("51", "91", "61"))
    truth = F.when(F.col("decline_code") == "51", "no_funds").when(F.col("decline_code") == "91", "issuer_degraded").otherwise("limit_breach")
    return diagnosis.with_cause(rows.withColumn("truth", truth).withColumn("decline_code", F.lit("05")))


@query("confusion_matrix", v.with_(v.CYCLES, PAID, HIST, OBS, _AMBIG, """
tg AS (SELECT CASE decline_code WHEN '51' THEN 'no_funds' WHEN '91' THEN 'issuer_degraded' ELSE 'limit_breach' END AS truth, cause
  FROM pred WHERE decline_code IN ('51', '91', '61'))""") + """
SELECT truth, count(CASE WHEN cause = 'no_funds' THEN 1 END) AS no_funds,
  count(CASE WHEN cause = 'issuer_degraded' THEN 1 END) AS issuer_degraded,
  count(CASE WHEN cause = 'fraud_hold' THEN 1 END) AS fraud_hold, count(CASE WHEN cause = 'limit_breach' THEN 1 END) AS limit_breach,
  round(count(CASE WHEN cause = truth THEN 1 END) / count(*), 6) AS recall FROM tg GROUP BY truth""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = diagnosis.confusion_matrix(_truth_and_guess(spark, sf_dir), "truth", "cause", causes.DIAGNOSABLE)
    return matrix.withColumn("recall", F.round("recall", 6))


_TG = """
tg AS (SELECT CASE decline_code WHEN '51' THEN 'no_funds' WHEN '91' THEN 'issuer_degraded' ELSE 'limit_breach' END AS truth, cause
  FROM pred WHERE decline_code IN ('51', '91', '61'))"""


@query("cause_accuracy", v.with_(v.CYCLES, PAID, HIST, OBS, _AMBIG, _TG) + """
SELECT count(*) AS rows, round(avg(CASE WHEN truth = cause THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy FROM tg""")
def cause_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diagnosis.accuracy(_truth_and_guess(spark, sf_dir), "truth", "cause", causes.DIAGNOSABLE)
    return found.select("rows", F.round("accuracy", 6).alias("accuracy"))


@query("cause_precision", v.with_(v.CYCLES, PAID, HIST, OBS, _AMBIG, _TG) + """
SELECT cause AS predicted, round(avg(CASE WHEN truth = cause THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS precision FROM tg GROUP BY 1""")
def cause_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diagnosis.precision(_truth_and_guess(spark, sf_dir), "truth", "cause")
    return found.select("predicted", F.round("precision", 6).alias("precision"))


def _em_table(spark: SparkSession, model: diagnosis.CauseMixture) -> DataFrame:
    rows = [
        (c, model.weights[c], model.means[c]["amount_ratio"], model.means[c]["recovered_flag"], model.iterations)
        for c in causes.DIAGNOSABLE
    ]
    return spark.createDataFrame(rows, "cause string, weight double, mean_ratio double, mean_recovered double, iterations int")


@query("cause_em")
def cause_em(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixture fitted to its tolerance; checked against a plain NumPy EM in the tests."""
    return _em_table(spark, diagnosis.fit_cause_em(cause_rows(spark, sf_dir)))


def _em_sql(iterations: int) -> str:
    """The same EM, unrolled for a fixed number of iterations."""
    names = causes.DIAGNOSABLE
    features = {"issuer_health": "ih", "peer_rate": "peer", "sibling_rate": "sib", "amount_ratio": "ratio",
                "days_since_payday": "coalesce(dsp, -1.0)", "n_concurrent": "ncon", "recovered_flag": "CASE WHEN recovered THEN 1 ELSE 0 END",
                "log_lag": "CASE WHEN recovered THEN ln(1 + (cycle_id % 7 + 1) * 24.0) ELSE -1 END"}
    feature = " UNION ALL ".join(f"SELECT cycle_id, '{n}' AS f, CAST({e} AS DOUBLE) AS x FROM obs" for n, e in features.items())
    own = {"no_funds": "nf", "issuer_degraded": "idg", "fraud_hold": "0.25", "limit_breach": "lb"}
    first = " UNION ALL ".join(
        f"SELECT cycle_id, '{c}' AS c, coalesce(decline_code, '') <> '05' AS pinned, CAST(CASE WHEN decline_code = '05' THEN {own[c]} ELSE w_{c} END AS DOUBLE) AS w FROM emw"
        for c in names)
    steps = [f"emw AS (SELECT *, {v.cause_weights('decline_code')} FROM w05)", f"emf AS MATERIALIZED ({feature})",
             f"em0 AS MATERIALIZED (SELECT cycle_id, c, pinned, CASE WHEN sum(w) OVER x > 0 THEN w / sum(w) OVER x ELSE 0.25 END AS r FROM ({first}) WINDOW x AS (PARTITION BY cycle_id))"]
    for i in range(1, iterations + 1):
        steps.append(f"""emm{i} AS MATERIALIZED (SELECT c, f, w, mu, greatest(sq - mu * mu, 1e-3) AS var FROM (
            SELECT r.c, f, any_value(m) / (SELECT sum(m) FROM (SELECT sum(r) + 1e-12 AS m FROM em{i - 1} GROUP BY c)) AS w,
              sum(r * x) / any_value(m) AS mu, sum(r * x * x) / any_value(m) AS sq
            FROM em{i - 1} r JOIN emf USING (cycle_id) JOIN (SELECT c, sum(r) + 1e-12 AS m FROM em{i - 1} GROUP BY c) USING (c) GROUP BY r.c, f))""")
        if i < iterations:
            steps.append(f"""em{i} AS MATERIALIZED (SELECT cycle_id, c, pinned, CASE WHEN pinned THEN r ELSE e / sum(e) OVER (PARTITION BY cycle_id) END AS r FROM (
                SELECT cycle_id, c, pinned, r, exp(j - max(j) OVER (PARTITION BY cycle_id)) AS e FROM (
                  SELECT cycle_id, c, ln(any_value(w)) + sum(-0.5 * ln(2 * pi() * var) - (x - mu) * (x - mu) / (2 * var)) AS j
                  FROM emf JOIN emm{i} USING (f) GROUP BY cycle_id, c) JOIN em{i - 1} USING (cycle_id, c)))""")
    return v.with_(v.CYCLES, PAID, HIST, OBS, _AMBIG, *steps) + f"""
SELECT c AS cause, round(any_value(w), 6) AS weight, round(max(mu) FILTER (f = 'amount_ratio'), 6) AS mean_ratio,
  round(max(mu) FILTER (f = 'recovered_flag'), 6) AS mean_recovered, CAST({iterations} AS INT) AS iterations FROM emm{iterations} GROUP BY c"""


@query("cause_em_steps", _em_sql(4))
def cause_em_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit after exactly four iterations, as SQL can unroll it."""
    model = diagnosis.fit_cause_em(cause_rows(spark, sf_dir), max_iterations=4, tolerance=0.0)
    rounded = [F.round(c, 6).alias(c) for c in ("weight", "mean_ratio", "mean_recovered")]
    return _em_table(spark, model).select("cause", *rounded, "iterations")


@query("cause_predict")
def cause_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checkpointed(cause_rows(spark, sf_dir))
    model = diagnosis.fit_cause_em(rows)
    scored = diagnosis.predict_cause(diagnosis.em_rows(rows), model)
    return scored.groupBy("decline_code", "em_cause").agg(F.count("*").alias("n"))
