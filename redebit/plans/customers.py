"""Customer history, payday profile and retention queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redebit.functions import calendar as cal
from redebit.functions import causes
from redebit.operators import history, retention
from redebit.plans import views_sql as v
from redebit.plans.ingest import PROJECTED, projected
from redebit.plans.priors import published
from redebit.plans.priors import _O as OUTCOME_CTES
from redebit.plans.priors import PRIORS, SEGS
from redebit.plans.registry import query
from redebit.session import checkpointed
from redebit.sources import testdata as td

PAID = f"""
paid AS (
  SELECT *, CASE WHEN NOT failed THEN due_at WHEN recovered THEN recovered_at END AS paid_at,
    {v.dom_ist('due_at')} AS due_dom, {v.hour_band('due_at')} AS due_band,
    row_number() OVER (PARTITION BY customer_id ORDER BY due_at, cycle_id) AS rn
  FROM ev_cycles)"""
HIST = f"""
pairs AS (
  SELECT c.cycle_id, {v.dom_ist('p.paid_at')} AS dom, {v.hour_band('p.paid_at')} AS pband,
    {v.hour_band('p.due_at')} AS fband, p.failed, p.paid_at, p.amount_paise AS pa, p.recovered,
    CASE WHEN p.recovered THEN (epoch_us(p.recovered_at) - epoch_us(p.due_at)) / 3600000000.0 END AS lag,
    c.due_dom, c.due_band
  FROM paid c JOIN paid p ON p.customer_id = c.customer_id AND p.rn < c.rn),
days AS (SELECT cycle_id, dom, count(*) AS n FROM pairs WHERE paid_at IS NOT NULL GROUP BY ALL),
modal AS (SELECT cycle_id, arg_max(dom, {{'n': n, 'd': -dom}}) AS payday FROM days GROUP BY 1),
hist AS (
  SELECT cycle_id, count(*) AS n_prior, count(paid_at) AS n_paid,
    count(CASE WHEN paid_at IS NOT NULL AND dom = due_dom THEN 1 END) AS hits,
    count(CASE WHEN paid_at IS NOT NULL AND pband = due_band THEN 1 END) AS bs,
    count(CASE WHEN paid_at IS NOT NULL AND pband = due_band THEN 1 END)
      + count(CASE WHEN failed AND fband = due_band THEN 1 END) AS ba,
    floor(quantile_cont(CASE WHEN paid_at IS NOT NULL THEN pa END, 0.75)) AS p75, median(lag) AS lagm
  FROM pairs GROUP BY cycle_id)"""


@query("customer_history", v.with_(v.CYCLES, PAID, HIST) + """
SELECT c.cycle_id, CAST(coalesce(n_prior, 0) AS INT) AS n_prior, CAST(coalesce(n_paid, 0) AS INT) AS n_paid,
  round(CASE WHEN coalesce(n_paid, 0) = 0 THEN 0 ELSE hits / n_paid END, 6) AS day_density,
  CAST(coalesce((due_dom - payday + 30) % 30, -1) AS DOUBLE) AS days_since_payday,
  round(CASE WHEN coalesce(ba, 0) = 0 THEN 0.5 ELSE bs / ba END, 6) AS band_success_rate,
  round(CASE WHEN coalesce(p75, 0) > 0 THEN amount_paise / p75 ELSE 1.0 END, 6) AS amount_ratio,
  round(coalesce(lagm, -1), 6) AS lag_median_hours
FROM paid c LEFT JOIN hist h USING (cycle_id) LEFT JOIN modal m USING (cycle_id)""")
def customer_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, band = cal.day_of_month_ist(F.col("due_at")), cal.hour_band(F.col("due_at"))
    return history.customer_history(td.billing_cycles(spark, sf_dir)).select(
        "cycle_id", "n_prior", "n_paid",
        F.round(history.day_density(day), 6).alias("day_density"),
        history.days_since_payday(day).alias("days_since_payday"),
        F.round(history.band_success_rate(band), 6).alias("band_success_rate"),
        F.round(history.amount_ratio(), 6).alias("amount_ratio"),
        F.round(F.coalesce("lag_median_hours", F.lit(-1.0)), 6).alias("lag_median_hours"),
    )


@query("days_since_payday", v.with_(v.CYCLES, PAID, HIST) + """
SELECT CAST(coalesce(payday, -1) AS INT) AS payday, count(*) AS n,
  CAST(sum(coalesce((due_dom - payday + 30) % 30, -1)) AS BIGINT) AS total
FROM paid LEFT JOIN modal USING (cycle_id) GROUP BY 1""")
def days_since_payday(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = history.customer_history(td.billing_cycles(spark, sf_dir))
    since = history.days_since_payday(cal.day_of_month_ist(F.col("due_at")))
    return known.groupBy(F.coalesce(history.modal_payday(), F.lit(-1)).alias("payday")).agg(
        F.count("*").alias("n"), F.sum(since).cast("bigint").alias("total")
    )


SETTLED = f"""
settled AS (
  SELECT customer_id, cycle_id, due_at, {v.dom_ist('due_at')} AS day,
    row_number() OVER (PARTITION BY customer_id ORDER BY due_at DESC, cycle_id DESC) AS back
  FROM ev_cycles WHERE NOT failed OR recovered),
masses AS (SELECT customer_id, day, sum(0.97 ** (back - 1)) AS mass FROM settled GROUP BY ALL)"""


@query("payday_posterior", v.with_(v.CYCLES, SETTLED) + """
SELECT customer_id, day, round(mass, 6) AS mass FROM masses""")
def payday_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.payday_posterior(td.billing_cycles(spark, sf_dir)).withColumn("mass", F.round("mass", 6))


PROFILE = """
profile AS (
  SELECT customer_id, sum(mass) AS n_eff, ln(sum(mass)) - sum(mass * ln(mass)) / sum(mass) AS entropy,
    arg_max(day, {'m': mass, 'd': -day}) AS modal_day FROM masses GROUP BY 1)"""


@query("profile_summary", v.with_(v.CYCLES, SETTLED, PROFILE) + """
SELECT customer_id, round(n_eff, 6) AS n_eff, CAST(modal_day AS INT) AS modal_day,
  round(greatest(1 - entropy / ln(31), 0) * n_eff / (n_eff + 5), 6) AS confidence FROM profile""")
def profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    masses = history.payday_posterior(td.billing_cycles(spark, sf_dir))
    return history.posterior_summary(masses).select(
        "customer_id", F.round("n_eff", 6).alias("n_eff"), "modal_day", F.round("confidence", 6).alias("confidence")
    )


AS_OF = f"""
ords AS (
  SELECT *, NOT failed OR recovered AS settled, {v.dom_ist('due_at')} AS day,
    coalesce(sum(CAST(NOT failed OR recovered AS INT)) OVER (PARTITION BY customer_id ORDER BY due_at, cycle_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_settled,
    row_number() OVER (PARTITION BY customer_id ORDER BY due_at, cycle_id) AS rn
  FROM ev_cycles),
as_of AS (
  SELECT c.cycle_id, p.day, sum(0.97 ** (c.n_settled - p.n_settled - 1)) AS mass
  FROM ords c JOIN ords p ON p.customer_id = c.customer_id AND p.rn < c.rn AND p.settled GROUP BY ALL),
asum AS (
  SELECT cycle_id, sum(mass) AS n_eff, ln(sum(mass)) - sum(mass * ln(mass)) / sum(mass) AS entropy FROM as_of GROUP BY 1)"""


@query("posterior_as_of", v.with_(v.CYCLES, AS_OF) + """
SELECT o.cycle_id, CAST(n_settled AS INT) AS n_settled, round(coalesce(n_eff, 0), 6) AS n_eff,
  round(coalesce(greatest(1 - entropy / ln(31), 0) * n_eff / (n_eff + 5), 0), 6) AS confidence,
  round(coalesce(mass, 0), 6) AS due_day_mass
FROM ords o LEFT JOIN asum USING (cycle_id) LEFT JOIN as_of a ON a.cycle_id = o.cycle_id AND a.day = o.day""")
def posterior_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = history.posterior_as_of(td.billing_cycles(spark, sf_dir))
    mass = F.col("day_mass")
    return known.select(
        "cycle_id", "n_settled", F.round(history.mass_total(mass), 6).alias("n_eff"),
        F.round(history.mass_confidence(mass), 6).alias("confidence"),
        F.round(F.element_at(mass, cal.day_of_month_ist(F.col("due_at"))), 6).alias("due_day_mass"),
    )


@query("payday_probability", v.with_(v.CYCLES, SETTLED, PROFILE) + """
, hint AS (SELECT c_custkey AS customer_id, c_custkey % 31 + 1 AS day, c_custkey % 200 AS age FROM customer),
w AS (SELECT h.*, p.n_eff, (1 - p.n_eff / (p.n_eff + 5)) * greatest(1 - age / 180.0, 0) AS share
  FROM hint h JOIN profile p USING (customer_id))
SELECT m.customer_id, m.day, round((1 - share) * mass / n_eff + share * CAST(m.day = w.day AS INT), 6) AS probability
FROM masses m JOIN w USING (customer_id)""".replace("\n, hint", ",\nhint", 1))
def payday_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    masses = history.payday_posterior(td.billing_cycles(spark, sf_dir))
    totals = masses.groupBy("customer_id").agg(F.sum("mass").alias("n_eff"))
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    hints = td.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), (F.col("c_custkey") % 31 + 1).alias("declared_day"),
        cal.add_seconds(now, -(F.col("c_custkey") % 200) * cal.DAY).alias("declared_at"),
    )
    joined = masses.join(totals, "customer_id").join(hints, "customer_id")
    p = history.payday_probability(
        F.col("mass") / F.col("n_eff"), F.col("n_eff"), F.col("day") == F.col("declared_day"),
        history.declared_weight(F.col("declared_at"), now),
    )
    return joined.select("customer_id", "day", F.round(p, 6).alias("probability"))


@query("fatigue_score", v.with_(v.EVENTS, """
now AS (SELECT max(occurred_at) AS n FROM ev_events),
msg AS (SELECT customer_id, (epoch_us(n) - epoch_us(occurred_at)) / 86400000000.0 AS age
  FROM ev_events, now WHERE event_type = 'payment.failed')""") + """
SELECT customer_id, round(sum(0.5 ** (age / 14.0)), 6) AS fatigue_score,
  count(CASE WHEN age < 30 THEN 1 END) AS messages_30d FROM msg GROUP BY customer_id""")
def fatigue_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = td.payment_events(spark, sf_dir)
    now = events.agg(F.max("occurred_at")).scalar()
    messages = events.where("event_type = 'payment.failed'").select(
        "customer_id", F.col("occurred_at").alias("sent_at")
    )
    return history.fatigue(messages, now).withColumn("fatigue_score", F.round("fatigue_score", 6))


@query("settlement_lags", v.with_(v.CYCLES, """
r AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY due_at DESC, cycle_id DESC) AS rn
  FROM ev_cycles WHERE recovered)""") + """
SELECT customer_id, string_agg(CAST(cycle_id % 7 + 1 AS VARCHAR), ',' ORDER BY rn DESC) AS lags
FROM r WHERE rn <= 24 GROUP BY customer_id""")
def settlement_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    lags = history.settlement_lags(td.billing_cycles(spark, sf_dir))
    return lags.select(
        "customer_id", F.array_join(F.transform("lags", lambda x: x.cast("int").cast("string")), ",").alias("lags")
    )


LIFE = """
ord AS (SELECT *, row_number() OVER w AS seq_no, sum(CAST(NOT failed AS INT)) OVER w AS successes,
    row_number() OVER (PARTITION BY mandate_id ORDER BY due_at DESC, cycle_id DESC) = 1 AS is_last
  FROM ev_cycles WINDOW w AS (PARTITION BY mandate_id ORDER BY due_at, cycle_id)),
steps AS (
  SELECT *, sum(CAST(failed AS INT)) OVER (PARTITION BY mandate_id, successes ORDER BY seq_no) AS consec,
    is_last AND due_at < (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY AS died_here
  FROM ord),
obs AS (
  SELECT *, CAST(least(consec, 4) AS INT) AS fb,
    CASE WHEN consec >= 3 THEN 90.0 WHEN consec = 2 THEN 60.0 WHEN consec = 1 THEN 30.0 ELSE 0.0 END AS ub
  FROM steps)"""


def _died_before(spark: SparkSession, sf_dir: str):
    newest = td.table(spark, sf_dir, "orders").agg(
        F.max(F.unix_seconds(F.col("o_orderdate").cast("timestamp")))
    ).scalar()
    return F.timestamp_seconds(newest - 365 * td.DAY)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.lifecycle_observations(td.billing_cycles(spark, sf_dir), _died_before(spark, sf_dir))


@query("lifecycle_steps", v.with_(v.CYCLES, LIFE) + """
SELECT cycle_id, seq_no, CAST(consec AS INT) AS consecutive_failures, CAST(consec * 30.0 AS DOUBLE) AS days_unpaid,
  CAST(successes AS BIGINT) AS successes, died_here FROM obs""")
def lifecycle_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select(
        "cycle_id", "seq_no", "consecutive_failures", "days_unpaid", "successes", "died_here"
    )


@query("consecutive_failures", v.with_(v.CYCLES, LIFE) + """
SELECT mandate_id, CAST(least(consec, 12) AS INT) AS run FROM obs WHERE is_last""")
def consecutive_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.consecutive_failures(td.billing_cycles(spark, sf_dir))


CELLS = """
tot AS (SELECT count(CASE WHEN died_here THEN 1 END) / count(*) AS gh FROM obs),
cells AS (SELECT fb, ub, rail, count(*) AS n, count(CASE WHEN died_here THEN 1 END) AS deaths,
  CASE WHEN count(*) >= 30 THEN count(CASE WHEN died_here THEN 1 END) / count(*) ELSE any_value(gh) END AS hazard
  FROM obs, tot GROUP BY ALL)"""


@query("revocation_hazard", v.with_(v.CYCLES, LIFE, CELLS) + """
SELECT fb AS failure_bucket, CAST(ub AS DOUBLE) AS unpaid_bucket, rail, n, deaths, round(hazard, 6) AS hazard
FROM cells""")
def revocation_hazard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.revocation_hazard(observations(spark, sf_dir)).select(
        *retention.CELL, "n", "deaths", F.round("hazard", 6).alias("hazard")
    )


@query("at_risk_mandates", v.with_(v.CYCLES, LIFE, CELLS) + """
SELECT mandate_id, round(hazard, 6) AS monthly_hazard FROM obs JOIN cells USING (fb, ub, rail)
WHERE is_last AND hazard >= 0.04""")
def at_risk_mandates(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = checkpointed(observations(spark, sf_dir))  # read for the cells and again for the rows
    risky = retention.at_risk_mandates(seen, retention.revocation_hazard(seen), threshold=0.04)
    return risky.withColumn("monthly_hazard", F.round("monthly_hazard", 6))


@query("marginal_delta", v.with_(v.CYCLES, LIFE, CELLS, """
w AS (SELECT o.mandate_id, o.consec, o.fb, o.rail, d, CASE WHEN consec * 30 + d >= 90 THEN 90.0 WHEN consec * 30 + d >= 60
  THEN 60.0 WHEN consec * 30 + d >= 30 THEN 30.0 ELSE 0.0 END AS ub
  FROM obs o, (VALUES (0), (3), (7), (30)) r(d) WHERE is_last)""") + """
SELECT mandate_id, CAST(d AS INT) AS days_ahead,
  round(1 - (1 - (1 - (1 - coalesce(hazard, gh)) ** (1 / 30.0))) ** d, 6) AS marginal_delta
FROM w CROSS JOIN tot LEFT JOIN cells USING (fb, ub, rail)""")
def marginal_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = checkpointed(observations(spark, sf_dir))  # read for the cells and again for the rows
    cells = retention.revocation_hazard(seen)
    ahead = seen.where("is_last").withColumn("_d", F.explode(F.array(*[F.lit(d) for d in (0, 3, 7, 30)])))
    return retention.marginal_delta(ahead, cells, F.col("_d")).select(
        "mandate_id", "days_ahead", F.round("marginal_delta", 6).alias("marginal_delta")
    )


@query("continuation_value", v.with_(v.CYCLES, LIFE, CELLS, """
q AS (SELECT mandate_id, amount_paise, 0.98 * (1 - hazard) AS q FROM obs JOIN cells USING (fb, ub, rail) WHERE is_last)""") + """
SELECT mandate_id, CAST(round_even(q * (1 - q ** 24.0) / (1 - q) * amount_paise * 0.8, 0) AS BIGINT)
  AS continuation_paise, amount_paise * 12 AS placeholder_paise FROM q""")
def continuation_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = checkpointed(observations(spark, sf_dir))  # read for the cells and again for the rows
    last = retention.with_monthly_hazard(seen.where("is_last"), retention.revocation_hazard(seen))
    value = retention.continuation_value(F.col("monthly_hazard"), F.col("amount_paise"), F.lit(0.8))
    return last.select("mandate_id", value.alias("continuation_paise"),
                       (F.col("amount_paise") * 12).alias("placeholder_paise"))


_DOM = f"""
dom AS (SELECT rail, {v.dom_ist('due_at')} AS day, count(*) AS n, count(CASE WHEN NOT failed THEN 1 END) / count(*) AS p
  FROM ev_cycles GROUP BY ALL),
peak AS (SELECT rail, arg_max(day, {{'p': p, 'd': -day}}) AS peak_day, max(p) AS peak_p FROM dom WHERE n >= 30 GROUP BY rail)"""


@query("day_of_month_hazard", v.with_(v.CYCLES, _DOM) + "SELECT rail, day, n, round(p, 6) AS p FROM dom")
def day_of_month_hazard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.day_of_month_hazard(td.billing_cycles(spark, sf_dir), ["rail"]).withColumn("p", F.round("p", 6))


@query("peak_day", v.with_(v.CYCLES, _DOM) + "SELECT rail, CAST(peak_day AS INT) AS peak_day, round(peak_p, 6) AS peak_p FROM peak")
def peak_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_day = retention.day_of_month_hazard(td.billing_cycles(spark, sf_dir), ["rail"])
    return retention.peak_day(by_day, ["rail"]).withColumn("peak_p", F.round("peak_p", 6))


@query("dominant_rail", v.with_(v.CYCLES_T, """
n AS (SELECT tenant_id, rail, count(*) AS n FROM ev_cycles_t GROUP BY ALL)""") + """
SELECT tenant_id, arg_max(rail, {'n': n, 'r': rail}) AS rail FROM n GROUP BY tenant_id""")
def dominant_rail(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = td.billing_cycles(spark, sf_dir, with_tenant=True).groupBy("tenant_id", "rail").agg(F.count("*").alias("n"))
    return counts.groupBy("tenant_id").agg(F.max_by("rail", F.struct("n", "rail")).alias("rail"))


@query("select_intervention", v.with_(v.CYCLES, LIFE, CELLS, _DOM, f"""
rows_ AS (
  SELECT o.mandate_id, o.consec, hazard, peak_day, peak_p, {v.dom_ist('o.due_at')} AS debit_day,
    CASE WHEN dd.n >= 30 THEN dd.p ELSE 0 END AS day_p, o.cycle_id % 5 AS messages, o.cycle_id % 13 = 0 AS opted,
    o.consec >= 4 AS spent, o.cycle_id % 2 = 0 AS worth
  FROM obs o JOIN cells USING (fb, ub, rail) LEFT JOIN peak USING (rail)
  LEFT JOIN dom dd ON dd.rail = o.rail AND dd.day = {v.dom_ist('o.due_at')} WHERE is_last),
kinds AS (
  SELECT *, CASE WHEN opted OR spent THEN 'back_off'
    WHEN peak_day IS NOT NULL AND peak_day <> debit_day AND peak_p - day_p > 0.25 AND consec >= 3 THEN 'date_change'
    WHEN worth THEN 'retry' ELSE 'back_off' END AS intervention FROM rows_)""") + """
SELECT mandate_id, intervention, CASE WHEN opted OR spent THEN concat_ws(';', CASE WHEN opted THEN 'customer_opted_out' END,
    CASE WHEN spent THEN 'budget_exhausted' END)
  WHEN intervention = 'back_off' THEN concat_ws(';', 'best attempt is worth less than the mandate',
    CASE WHEN hazard >= 0.15 THEN 'revocation hazard above threshold' END,
    CASE WHEN messages >= 3 THEN 'fatigue cap reached' END) ELSE '' END AS reasons FROM kinds""")
def select_intervention(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles = td.billing_cycles(spark, sf_dir)
    seen = checkpointed(observations(spark, sf_dir))  # read for the cells and again for the rows
    last = retention.with_monthly_hazard(seen.where("is_last"), retention.revocation_hazard(seen))
    by_day = retention.day_of_month_hazard(cycles, ["rail"])
    peaks = retention.peak_day(by_day, ["rail"])
    days = by_day.select("rail", F.col("day").alias("debit_day"), F.when(F.col("n") >= 30, F.col("p")).otherwise(0.0).alias("day_p"))
    stops = F.array_compact(F.array(
        F.when(F.col("cycle_id") % 13 == 0, F.lit("customer_opted_out")),
        F.when(F.col("consecutive_failures") >= 4, F.lit("budget_exhausted")),
    ))
    rows = (
        last.withColumn("debit_day", cal.day_of_month_ist(F.col("due_at")))
        .join(F.broadcast(peaks), "rail", "left")  # one row per rail
        .join(F.broadcast(days), ["rail", "debit_day"], "left")  # 31 days by rail
        .select(
            "mandate_id", "consecutive_failures", "monthly_hazard", "peak_day", "peak_p", "debit_day", "day_p",
            stops.alias("hard_stops"), (F.col("cycle_id") % 5).alias("messages_30d"),
            F.when(F.col("cycle_id") % 2 == 0, 2).otherwise(1).alias("best_ev_paise"), F.lit(1).alias("continuation_paise"),
        )
    )
    return retention.select_intervention(rows).select(
        "mandate_id", "intervention", F.concat_ws(";", "reasons").alias("reasons")
    )


@query("rail_migration", """
WITH c AS (SELECT c_custkey AS k, c_custkey % 3 AS r, c_nationkey AS n FROM customer),
a AS (SELECT k, CASE r WHEN 0 THEN 'card_emandate' WHEN 1 THEN 'upi_autopay' ELSE 'card_emandate' END AS cur,
  CASE n % 4 WHEN 0 THEN ['card_emandate'] WHEN 1 THEN ['card_emandate', 'enach']
    ELSE ['card_emandate', 'enach', 'upi_autopay'] END AS av, k % 90 AS expiry, k % 4 AS holds FROM c)
SELECT k AS customer_id, CASE WHEN cur = 'card_emandate' AND len(av) > 1 AND (expiry <= 45 OR holds >= 2)
  THEN CASE WHEN list_contains(av, 'upi_autopay') THEN 'upi_autopay' ELSE 'enach' END END AS target FROM a""")
def rail_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey") % 4
    rails = (
        F.when(n == 0, F.array(F.lit(cal.CARD)))
        .when(n == 1, F.array(F.lit(cal.CARD), F.lit(cal.ENACH)))
        .otherwise(F.array(F.lit(cal.CARD), F.lit(cal.ENACH), F.lit(cal.UPI)))
    )
    current = F.when(k % 3 == 1, cal.UPI).otherwise(cal.CARD)
    target = retention.propose_rail_migration(current, rails, k % 90, k % 4)
    return td.table(spark, sf_dir, "customer").select(k.alias("customer_id"), target.alias("target"))
