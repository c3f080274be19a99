"""Ingest and projection queries over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redebit.operators import projection
from redebit.plans import views_sql as v
from redebit.plans.registry import query
from redebit.sources import events as ev
from redebit.sources import testdata as td

SECRETS = [(f"t{i}", f"current-{i}".encode()) for i in range(5)] + [
    (f"t{i}", f"previous-{i}".encode()) for i in range(5)
]


def _entity(**fields):
    return F.struct(F.struct(*[c.alias(n) for n, c in fields.items()]).alias("entity"))


def raw_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log rendered as provider JSON, one delivery per event.

    Payments carry the mandate as a token and the cycle as an invoice; captures use the
    invoice paths; some bodies are damaged so that every reject reason occurs.
    """
    events = td.payment_events(spark, sf_dir)
    mandate = F.concat(F.lit("m"), F.col("mandate_id").cast("string"))
    ends = F.unix_seconds("deadline_at")
    damage = F.col("amount_paise") % 25
    failed = F.to_json(F.struct(
        F.when(damage != 1, F.col("event_type")).alias("event"),
        F.unix_seconds("occurred_at").alias("created_at"),
        F.struct(
            _entity(current_end=ends).alias("subscription"),
            _entity(
                token_id=mandate, invoice_id=F.col("cycle_ref"), amount=F.col("amount_paise"),
                error_code=F.col("decline_code"),
            ).alias("payment"),
        ).alias("payload"),
    ))
    captured = F.to_json(F.struct(
        F.col("event_type").alias("event"),
        F.struct(
            _entity(id=mandate).alias("token"),
            _entity(id=F.col("cycle_ref"), amount=F.col("amount_paise"), expire_by=ends).alias("invoice"),
        ).alias("payload"),
    ))
    other = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("id"),
        F.col("event_type").alias("event"),
        F.unix_seconds("occurred_at").alias("created_at"),
        F.struct(_entity(id=mandate, current_end=ends).alias("subscription")).alias("payload"),
    ))
    body = (
        F.when(damage == 3, F.lit("[1, 2]"))
        .when(damage == 4, F.lit("{broken"))
        .when(F.col("event_type") == "payment.failed", failed)
        .when(F.col("event_type") == "payment.captured", captured)
        .otherwise(other)
    )
    header = F.when(
        F.col("event_type").isin("payment.failed", "payment.captured") & (damage != 2),
        F.col("event_id").cast("string"),
    )
    return events.select(
        header.alias("event_id"),
        "tenant_id",
        body.alias("body"),
        F.timestamp_seconds(F.unix_seconds("occurred_at") + 90).alias("received_at"),
        F.col("event_id").alias("source_id"),
        "amount_paise",
    )


_PARSED = v.with_(v.EVENTS, """
parsed AS (
  SELECT *, amount_paise % 25 AS damage,
    event_type IN ('payment.failed', 'payment.captured') AS paid
  FROM ev_events),
reasons AS (
  SELECT *, CASE WHEN damage = 4 THEN 'body is not valid JSON'
    WHEN damage = 3 THEN 'body is not a JSON object'
    WHEN event_type = 'payment.failed' AND damage = 1 THEN 'no event type'
    WHEN paid AND damage = 2 THEN 'no event id' END AS reason
  FROM parsed)""")


@query("parse_envelope", _PARSED + f"""
SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, 'm' || mandate_id AS mandate_id,
  CASE WHEN paid THEN cycle_ref END AS cycle_ref,
  CASE WHEN paid THEN amount_paise ELSE -1 END AS amount_paise,
  {v.secs('deadline_at')} AS deadline_s, decline_code,
  {v.secs('occurred_at')} + CASE WHEN event_type = 'payment.captured' THEN 90 ELSE 0 END
    AS occurred_s
FROM reasons WHERE reason IS NULL""")
def parse_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = ev.split_malformed(ev.parse_envelope(raw_bodies(spark, sf_dir).drop("amount_paise")))
    return good.select(
        "event_id", "event_type", "mandate_id", "cycle_ref",
        F.coalesce("amount_paise", F.lit(-1)).alias("amount_paise"),
        F.unix_seconds("deadline_at").alias("deadline_s"),
        "decline_code",
        F.unix_seconds("occurred_at").alias("occurred_s"),
    )


@query("split_malformed", _PARSED + """
SELECT reason AS reject_reason, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS id_sum
FROM reasons WHERE reason IS NOT NULL GROUP BY 1""")
def split_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = ev.parse_envelope(raw_bodies(spark, sf_dir).drop("amount_paise"))
    rejects = parsed.where("reject_reason IS NOT NULL")
    return rejects.groupBy("reject_reason").agg(
        F.count("*").alias("n"), F.sum("source_id").alias("id_sum")
    )


@query("read_events", """
SELECT count(*) AS n, CAST(sum(CASE WHEN round(value * 100) % 3 <> 2 THEN 1 ELSE 0 END) AS BIGINT)
  AS verified FROM events""")
def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = verified_bodies(spark, sf_dir)
    return signed.agg(
        F.count("*").alias("n"), F.count_if("signature_ok").alias("verified")
    )


def verified_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies signed with the current, the previous or a foreign secret, then verified."""
    from redebit.functions import hashing

    bodies = raw_bodies(spark, sf_dir)
    which = F.col("amount_paise") % 3
    signature = None
    for i in range(5):
        for slot, label in ((0, "current"), (1, "previous"), (2, "foreign")):
            ipad, opad = hashing.hmac_pads(f"{label}-{i}".encode())
            digest = hashing.hmac_sha256(F.col("body"), F.lit(ipad), F.lit(opad))
            hit = (F.col("tenant_id") == f"t{i}") & (which == slot)
            signature = F.when(hit, digest) if signature is None else signature.when(hit, digest)
    signed = bodies.withColumn("signature", signature)
    return ev.verify_signatures(signed, ev.secrets_frame(spark, SECRETS))


@query("verify_signatures", v.with_(v.EVENTS) + """
SELECT tenant_id, count(*) AS n,
  CAST(sum(CASE WHEN amount_paise % 3 <> 2 THEN 1 ELSE 0 END) AS BIGINT) AS verified,
  CAST(sum(CASE WHEN amount_paise % 3 <> 2 THEN event_id ELSE 0 END) AS BIGINT) AS verified_ids
FROM ev_events GROUP BY tenant_id""")
def verify_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("signature_ok")
    return verified_bodies(spark, sf_dir).groupBy("tenant_id").agg(
        F.count("*").alias("n"),
        F.count_if(ok).alias("verified"),
        F.sum(F.when(ok, F.col("source_id")).otherwise(0)).alias("verified_ids"),
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event delivered one to three times, copies arriving later."""
    events = td.payment_events(spark, sf_dir)
    copies = F.sequence(F.lit(0), (F.col("amount_paise") % 3).cast("int"))
    return events.select("*", F.explode(copies).alias("copy")).select(
        *events.columns,
        F.timestamp_seconds(F.unix_seconds("occurred_at") + F.col("copy") * 600).alias("received_at"),
    )


@query("dedupe_events", v.with_(v.EVENTS) + f"""
SELECT event_id, {v.secs('occurred_at')} AS received_s, event_type FROM ev_events""")
def dedupe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.dedupe_events(deliveries(spark, sf_dir)).select(
        "event_id", F.unix_seconds("received_at").alias("received_s"), "event_type"
    )


def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.project_cycles(projection.unique_events(td.payment_events(spark, sf_dir)))


PROJECTED = """
folded AS (
  SELECT tenant_id, mandate_id, customer_id, rail, mcc, cycle_ref,
    count(DISTINCT CASE WHEN event_type = 'payment.failed' THEN event_id END) AS attempts_used,
    max(CASE WHEN event_type = 'payment.failed' THEN occurred_at END) AS last_failure_at,
    count(CASE WHEN event_type = 'payment.captured' THEN 1 END) AS successes,
    arg_min(CASE WHEN event_type = 'payment.captured' THEN amount_paise END,
      CASE WHEN event_type = 'payment.captured' THEN {'a': occurred_at, 'b': event_id} END)
      AS paid_paise,
    arg_min(amount_paise, CASE WHEN amount_paise <> 0 THEN {'a': occurred_at, 'b': event_id} END)
      AS amount,
    min(occurred_at) AS due_at, min(deadline_at) AS deadline_at
  FROM ev_events GROUP BY ALL),
proj AS (
  SELECT *, CASE WHEN successes > 0 THEN 'succeeded' WHEN attempts_used > 0 THEN 'executing'
      ELSE 'scheduled' END AS state,
    CASE WHEN successes > 0 THEN coalesce(paid_paise, 0) ELSE 0 END AS recovered_paise,
    coalesce(amount, 0) AS amount_paise,
    CASE rail WHEN 'enach' THEN 3 ELSE 4 END AS attempt_budget
  FROM folded)"""


@query("project_cycles", v.with_(v.EVENTS, PROJECTED) + f"""
SELECT cycle_ref, mandate_id, state, attempts_used, recovered_paise, amount_paise,
  coalesce({v.micros('last_failure_at')}, 0) AS last_failure_us, {v.micros('due_at')} AS due_us,
  {v.secs('deadline_at')} AS deadline_s, attempt_budget,
  CAST(greatest(attempt_budget - attempts_used, 0) AS INT) AS budget_left FROM proj""")
def project_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected(spark, sf_dir).select(
        "cycle_ref", "mandate_id", "state", "attempts_used", "recovered_paise", "amount_paise",
        F.coalesce(F.unix_micros("last_failure_at"), F.lit(0)).alias("last_failure_us"),
        F.unix_micros("due_at").alias("due_us"),
        F.unix_seconds("deadline_at").alias("deadline_s"),
        "attempt_budget", "budget_left",
    )


@query("recovery_by_rail", v.with_(v.EVENTS, PROJECTED) + """
SELECT tenant_id, rail, count(*) AS cycles,
  count(CASE WHEN attempts_used > 0 THEN 1 END) AS failed_cycles,
  count(CASE WHEN attempts_used > 0 AND recovered_paise > 0 THEN 1 END) AS recovered_cycles,
  CAST(sum(CASE WHEN attempts_used > 0 THEN recovered_paise ELSE 0 END) AS BIGINT)
    AS recovered_paise,
  CAST(sum(attempts_used) AS BIGINT) AS attempts,
  round(sum(attempts_used) / nullif(CAST(count(CASE WHEN attempts_used > 0 AND recovered_paise > 0
    THEN 1 END) AS DOUBLE), 0), 6) AS attempts_per_recovery
FROM proj GROUP BY tenant_id, rail""")
def recovery_by_rail(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("attempts_used") > 0
    won = failed & (F.col("recovered_paise") > 0)
    return projected(spark, sf_dir).groupBy("tenant_id", "rail").agg(
        F.count("*").alias("cycles"),
        F.count_if(failed).alias("failed_cycles"),
        F.count_if(won).alias("recovered_cycles"),
        F.sum(F.when(failed, F.col("recovered_paise")).otherwise(0)).alias("recovered_paise"),
        F.sum("attempts_used").alias("attempts"),
        F.round(F.sum("attempts_used") / F.nullif(F.count_if(won).cast("double"), F.lit(0.0)), 6)
        .alias("attempts_per_recovery"),
    )


@query("cycle_sequence", v.with_(v.CYCLES) + """
SELECT cycle_id, mandate_id,
  CAST(row_number() OVER (PARTITION BY mandate_id ORDER BY due_at, cycle_id) AS INT) AS seq_no
FROM ev_cycles""")
def cycle_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles = td.billing_cycles(spark, sf_dir).select("cycle_id", "mandate_id", "due_at")
    return projection.cycle_sequence(cycles, tie="cycle_id").drop("due_at")


MANDATE_FOLD = """
moves AS (
  SELECT mandate_id, row_number() OVER (PARTITION BY mandate_id ORDER BY occurred_at, event_id) AS rn,
    CASE event_type WHEN 'subscription.authenticated' THEN 'active'
      WHEN 'subscription.resumed' THEN 'active' WHEN 'subscription.paused' THEN 'paused'
      WHEN 'subscription.halted' THEN 'at_risk' WHEN 'subscription.cancelled' THEN 'revoked' END AS to_state
  FROM ev_events WHERE event_type LIKE 'subscription.%'),
legal(f, t) AS (VALUES ('created','active'), ('created','expired'), ('active','paused'),
  ('active','at_risk'), ('active','expired'), ('paused','active'), ('paused','expired'),
  ('at_risk','active'), ('at_risk','revoked'), ('at_risk','expired'), ('revoked','re_enrolling'),
  ('re_enrolling','active'), ('re_enrolling','expired')),
fold AS (
  SELECT DISTINCT mandate_id, CAST(0 AS BIGINT) AS rn, 'created' AS state, CAST(0 AS BIGINT) AS stale
  FROM moves
  UNION ALL
  SELECT m.mandate_id, m.rn,
    CASE WHEN f.state = m.to_state THEN f.state WHEN l.t IS NOT NULL THEN m.to_state ELSE f.state END,
    f.stale + CASE WHEN f.state <> m.to_state AND l.t IS NULL THEN 1 ELSE 0 END
  FROM fold f JOIN moves m ON m.mandate_id = f.mandate_id AND m.rn = f.rn + 1
  LEFT JOIN legal l ON l.f = f.state AND l.t = m.to_state)"""


@query("mandate_state", "WITH RECURSIVE " + v.with_(v.EVENTS, MANDATE_FOLD)[5:] + """
SELECT mandate_id, arg_max(state, rn) AS state, arg_max(stale, rn) AS stale_transitions
FROM fold GROUP BY mandate_id""")
def mandate_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.mandate_state(td.payment_events(spark, sf_dir))


@query("retry_sessions", v.with_(v.EVENTS, """
pays AS (SELECT * FROM ev_events WHERE event_type IN ('payment.failed', 'payment.captured')),
marked AS (
  SELECT *, CASE WHEN lag(occurred_at) OVER w IS NULL
    OR occurred_at - lag(occurred_at) OVER w >= INTERVAL 2 DAY THEN 1 ELSE 0 END AS fresh
  FROM pays WINDOW w AS (PARTITION BY mandate_id, cycle_ref ORDER BY occurred_at, event_id)),
islands AS (
  SELECT *, sum(fresh) OVER (PARTITION BY mandate_id, cycle_ref ORDER BY occurred_at, event_id) AS isl
  FROM marked)""") + f"""
SELECT mandate_id, cycle_ref, {v.micros('min(occurred_at)')} AS started_us,
  {v.micros('max(occurred_at) + INTERVAL 2 DAY')} AS closed_us,
  count(CASE WHEN event_type = 'payment.failed' THEN 1 END) AS failures,
  count(CASE WHEN event_type = 'payment.captured' THEN 1 END) AS successes
FROM islands GROUP BY mandate_id, cycle_ref, isl""")
def retry_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.retry_sessions(td.payment_events(spark, sf_dir)).select(
        "mandate_id", "cycle_ref",
        F.unix_micros("started_at").alias("started_us"),
        F.unix_micros("closed_at").alias("closed_us"),
        "failures", "successes",
    )


@query("late_capture_guard", v.with_(v.EVENTS, PROJECTED) + """
SELECT cycle_ref, 'cancelled' AS state FROM proj WHERE state = 'succeeded' AND attempts_used > 0""")
def late_capture_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles = projected(spark, sf_dir)
    actions = cycles.where("attempts_used > 0").select("cycle_ref", F.lit("pending").alias("state"))
    return projection.late_capture_guard(cycles, actions)


@query("domain_views", v.with_(v.EVENTS, v.CYCLES_T, v.DECISIONS) + """
SELECT 'ev_events' AS view_name, count(*) AS n, CAST(sum(amount_paise) AS BIGINT) AS paise FROM ev_events
UNION ALL SELECT 'ev_cycles', count(*), CAST(sum(amount_paise) AS BIGINT) FROM ev_cycles_t
UNION ALL SELECT 'ev_decisions', count(*), CAST(sum(amount_paise) AS BIGINT) FROM ev_decisions""")
def domain_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = td.register_views(spark, sf_dir)
    parts = [
        views[name].agg(F.count("*").alias("n"), F.sum("amount_paise").alias("paise"))
        .select(F.lit(name).alias("view_name"), "n", "paise")
        for name in ("ev_events", "ev_cycles", "ev_decisions")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
