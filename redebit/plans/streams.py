"""Streaming jobs run over the event log and checked against the batch answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redebit.plans import views_sql as v
from redebit.plans.ingest import MANDATE_FOLD, PROJECTED
from redebit.plans.issuers import _CUSUM, ATT, DAY, TUNING
from redebit.plans.registry import query
from redebit.session import checkpointed
from redebit.sources import testdata as td
from redebit.streaming import jobs, run

_PAID = ("payment.failed", "payment.captured")


@query("stream_projection", v.with_(v.EVENTS, PROJECTED) + f"""
SELECT cycle_ref, state, attempts_used, recovered_paise, amount_paise, {v.micros('due_at')} AS due_us FROM proj""")
def stream_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["mandate_id", "cycle_ref"]
    rows, _ = run.drain(jobs.stream_projection(td.payment_event_stream(spark, sf_dir), keys=keys), "update")
    return run.latest(rows, keys).select(
        "cycle_ref", "state", "attempts_used", "recovered_paise", "amount_paise", F.unix_micros("due_at").alias("due_us")
    )


@query("stream_mandate_state", "WITH RECURSIVE " + v.with_(v.EVENTS, MANDATE_FOLD)[5:] + """
SELECT mandate_id, arg_max(state, rn) AS state, arg_max(stale, rn) AS stale_transitions FROM fold GROUP BY mandate_id""")
def stream_mandate_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = run.drain(jobs.mandate_state(td.payment_event_stream(spark, sf_dir)), "update")
    return run.latest(rows, ["mandate_id"])


def _attempts(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin(*_PAID)).select(
        "issuer", F.col("occurred_at").alias("at"), (F.col("event_type") == "payment.captured").alias("success")
    )


@query("stream_issuer_windows", v.with_(v.EVENTS, ATT) + """
SELECT issuer, start_s, attempts, successes FROM win""")
def stream_issuer_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = jobs.issuer_windows(_attempts(td.payment_event_stream(spark, sf_dir)), "1 hour", "1 day")
    rows, _ = run.drain(windows, "update")
    return run.latest(rows, ["issuer", "window_start"]).select(
        "issuer", F.unix_seconds("window_start").alias("start_s"), "attempts", "successes"
    )


@query("stream_issuer_detector", "WITH RECURSIVE " + v.with_(v.EVENTS, ATT, _CUSUM)[5:] + """
SELECT issuer, start_s, round(cusum, 6) AS cusum, since AS degraded_since_s, CAST(outages AS INT) AS outages
FROM st WHERE rn > 0""")
def stream_issuer_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed windows in one job from attempts to states; windows that no later attempt closes follow from their latest counts."""
    attempts = _attempts(td.payment_events(spark, sf_dir))
    rate = attempts.agg(F.greatest(F.count_if("success") / F.count("*"), F.lit(0.05)).alias("b")).first()["b"]
    stream = _attempts(td.payment_event_stream(spark, sf_dir))
    closed, _ = run.drain(jobs.issuer_detector(stream, rate, "1 hour", "1 day", **TUNING), "append")
    counts, _ = run.drain(jobs.issuer_windows(stream, "1 hour", "1 day"), "update")
    rows = jobs.with_open_windows(closed, run.latest(counts, ["issuer", "window_start"]), rate, **TUNING)
    return rows.select(
        "issuer", "start_s", F.round("cusum", 6).alias("cusum"), "degraded_since_s", "outages"
    )


@query("stream_retry_sessions", v.with_(v.EVENTS, f"""
pays AS (SELECT * FROM ev_events WHERE event_type IN {_PAID}),
marked AS (
  SELECT *, CASE WHEN lag(occurred_at) OVER w IS NULL OR occurred_at - lag(occurred_at) OVER w >= INTERVAL 2 DAY THEN 1 ELSE 0 END AS fresh
  FROM pays WINDOW w AS (PARTITION BY mandate_id, cycle_ref ORDER BY occurred_at, event_id)),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY mandate_id, cycle_ref ORDER BY occurred_at, event_id) AS isl FROM marked),
ses AS (SELECT mandate_id, cycle_ref, epoch_us(min(occurred_at)) AS started_us, epoch_us(max(occurred_at)) + 172800000000 AS closed_us,
  count(CASE WHEN event_type = 'payment.failed' THEN 1 END) AS failures FROM islands GROUP BY mandate_id, cycle_ref, isl)""") + """
SELECT mandate_id, cycle_ref, started_us, closed_us, failures FROM ses""")
def stream_retry_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = run.drain(jobs.retry_sessions(td.payment_event_stream(spark, sf_dir)), "update")
    sessions = run.latest(rows, ["mandate_id", "cycle_ref", "started_at"]).where("NOT absorbed")
    return sessions.select(
        "mandate_id", "cycle_ref", F.unix_micros("started_at").alias("started_us"), F.unix_micros("closed_at").alias("closed_us"), "failures"
    )


_TRAIL = f"""
msg AS (SELECT customer_id, {v.secs('occurred_at')} AS s FROM ev_events WHERE event_type = 'payment.failed'),
ends AS (SELECT DISTINCT customer_id, (s // 86400 + g) * 86400 AS as_of_s FROM msg, range(1, 31) r(g)),
trail AS (SELECT e.customer_id, as_of_s, count(*) AS messages_30d FROM ends e JOIN msg m ON m.customer_id = e.customer_id
  AND m.s < as_of_s AND m.s >= as_of_s - 2592000 GROUP BY ALL)"""


def _messages(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'payment.failed'").select("customer_id", F.col("occurred_at").alias("sent_at"))


@query("trailing_messages", v.with_(v.EVENTS, _TRAIL) + "SELECT customer_id, as_of_s, messages_30d FROM trail")
def trailing_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = jobs.trailing_messages(_messages(td.payment_events(spark, sf_dir)))
    return counted.select("customer_id", F.unix_seconds("as_of").alias("as_of_s"), "messages_30d")


@query("stream_trailing_messages", v.with_(v.EVENTS, _TRAIL) + """
SELECT customer_id, as_of_s, messages_30d FROM trail""")
def stream_trailing_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = run.drain(jobs.trailing_messages(_messages(td.payment_event_stream(spark, sf_dir))), "update")
    return run.latest(rows, ["customer_id", "as_of"]).select("customer_id", F.unix_seconds("as_of").alias("as_of_s"), "messages_30d")


@query("stream_dedupe", v.with_(v.EVENTS) + "SELECT tenant_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM ev_events GROUP BY 1")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event delivered up to three times in the stream, kept once."""
    copies = F.explode(F.sequence(F.lit(0), (F.col("amount_paise") % 3).cast("int"))).alias("copy")
    delivered = td.payment_event_stream(spark, sf_dir).select("*", copies)
    rows, _ = run.drain(jobs.dedupe_stream(delivered).select("tenant_id", "event_id"), "append")
    return rows.groupBy("tenant_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("stream_late_capture_guard", v.with_(v.EVENTS, PROJECTED) + """
SELECT cycle_ref, 'cancelled' AS state FROM proj WHERE state = 'succeeded' AND attempts_used > 0""")
def stream_late_capture_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redebit.plans.ingest import projected

    actions = projected(spark, sf_dir).where("attempts_used > 0").select("cycle_ref", F.lit("pending").alias("state"))
    actions = checkpointed(actions)  # every batch reads them; the log is projected once
    out = run.scratch(spark)
    cycles = jobs.stream_projection(td.payment_event_stream(spark, sf_dir), keys=["mandate_id", "cycle_ref"])
    run.drain(cycles, "update", jobs.late_capture_guard(actions, out))
    return spark.read.option("recursiveFileLookup", "true").parquet(out).distinct()


@query("lag_monitor", v.with_(v.EVENTS) + """
SELECT count(*) AS pending, 1706745600 - min(epoch_us(occurred_at) // 1000000 + 90) AS value,
  1706745600 - min(epoch_us(occurred_at) // 1000000 + 90) > 30 AS breached FROM ev_events""")
def lag_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log as backlog, each event received 90 seconds after it happened."""
    backlog = td.payment_events(spark, sf_dir).withColumn("received_at", F.col("occurred_at") + F.expr("INTERVAL 90 SECONDS"))
    return jobs.lag_monitor(backlog, F.timestamp_seconds(F.lit(1_706_745_600)))
