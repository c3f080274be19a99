"""Rules, ledger, privacy, reply and reconciliation queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redebit.functions import calendar as cal
from redebit.functions import hashing
from redebit.operators import ledger, legality, privacy, reconcile, replies, rules
from redebit.plans import views_sql as v
from redebit.plans.ingest import PROJECTED, projected
from redebit.plans.registry import query
from redebit.session import checkpointed
from redebit.sources import events as ev
from redebit.sources import testdata as td

# ------------------------------------------------------------------ rules


def proposed_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed payments as proposed actions of three kinds with a spread of facts."""
    x = F.col("amount_paise")
    failed = td.payment_events(spark, sf_dir).where("event_type = 'payment.failed'")
    kind = F.when(x % 4 < 2, "debit_attempt").when(x % 4 == 2, "sms").otherwise(
        F.when(x % 8 == 3, "notification").otherwise("carrier_pigeon")
    )
    hours = F.when(x % 3 != 0, (x % 40).cast("double"))
    return failed.select(
        "event_id", kind.alias("action_type"), "rail", "mcc", (x * 3000).alias("amount_paise"),
        cal.hour_ist(F.col("occurred_at")).alias("hour_ist"),
        F.when(hours.isNotNull(), F.col("occurred_at")).alias("pdn_sent_at"), hours.alias("hours_since_pdn"),
        (x % 2 == 0).alias("is_next_day_debit"), F.when(x % 5 != 0, "tpl").alias("dlt_template_id"),
        F.lit("160").alias("header_series"), (x % 7 == 0).alias("dnd_registered"),
        F.when(x % 11 != 0, "c").alias("consent_ref"), (x % 13 == 0).alias("consent_withdrawn"),
        (x % 5).cast("int").alias("messages_30d"), F.lit(3).alias("tenant_fatigue_cap"),
        F.when(x % 2 == 0, F.lit("2026-08-15")).otherwise("2026-09-01").cast("date").alias("as_of"),
    )


RULE_SQL = f"""
pa AS (
  SELECT event_id, CASE WHEN x % 4 < 2 THEN 'debit_attempt' WHEN x % 4 = 2 THEN 'sms' WHEN x % 8 = 3 THEN 'notification'
    ELSE 'carrier_pigeon' END AS action_type, rail, mcc, x * 3000 AS amount, x, {v.minute_ist('occurred_at')} / 60.0 AS hour,
    CASE WHEN x % 3 <> 0 THEN x % 40 END AS hrs
  FROM (SELECT *, amount_paise AS x FROM ev_events WHERE event_type = 'payment.failed')),
ck AS (
  SELECT *,
    CASE WHEN action_type = 'debit_attempt' AND rail = 'upi_autopay' THEN
      CASE WHEN hour < 10 OR (hour >= 13 AND hour < 17) OR hour >= 21.5 THEN 'ALLOW' ELSE 'DENY' END END AS c_win,
    CASE WHEN action_type = 'debit_attempt' THEN CASE WHEN coalesce(hrs >= 24, FALSE) THEN 'ALLOW' ELSE 'DENY' END END AS c_pdn,
    CASE WHEN action_type = 'notification' THEN CASE WHEN NOT (x % 2 = 0 AND hour >= 23.83) THEN 'ALLOW' ELSE 'DENY' END END AS c_cut,
    CASE WHEN action_type = 'debit_attempt' THEN CASE WHEN amount <= CASE WHEN mcc = '6300' THEN 10000000 ELSE 1500000 END
      THEN 'ALLOW' ELSE 'ESCALATE_HUMAN' END END AS c_cap,
    CASE WHEN action_type = 'sms' THEN CASE WHEN hour >= 8 AND hour < 19 THEN 'ALLOW' ELSE 'DEFER' END END AS c_con,
    CASE WHEN action_type = 'sms' THEN CASE WHEN x % 5 <> 0 AND x % 7 <> 0 THEN 'ALLOW' ELSE 'DENY' END END AS c_dlt,
    CASE WHEN action_type IN ('sms', 'debit_attempt') THEN CASE WHEN x % 11 <> 0 AND x % 13 <> 0 THEN 'ALLOW' ELSE 'DENY' END END AS c_dpdp,
    CASE WHEN action_type = 'sms' THEN CASE WHEN x % 5 < 3 THEN 'ALLOW' ELSE 'DEFER' END END AS c_fat
  FROM pa),
judged AS (
  SELECT *, [c_win, c_pdn, c_cut, c_cap, c_con, c_dlt, c_dpdp, c_fat] AS cs, concat_ws(',',
    CASE WHEN c_dpdp <> 'ALLOW' THEN 'DPDP-CONSENT-VALID' END, CASE WHEN c_fat <> 'ALLOW' THEN 'HOUSE-FATIGUE-CAP' END,
    CASE WHEN c_win <> 'ALLOW' THEN 'NPCI-AUTOPAY-WINDOW' END, CASE WHEN c_cut <> 'ALLOW' THEN 'NPCI-PDN-CUTOFF-2350' END,
    CASE WHEN c_cap <> 'ALLOW' THEN 'RBI-EMANDATE-AFA-CAP' END, CASE WHEN c_pdn <> 'ALLOW' THEN 'RBI-EMANDATE-PDN-24H' END,
    CASE WHEN c_con <> 'ALLOW' THEN 'RBI-FPC-CONTACT-WINDOW' END, CASE WHEN c_dlt <> 'ALLOW' THEN 'TRAI-DLT-TEMPLATE' END) AS failed_rules
  FROM ck)"""


def judged_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = rules.with_afa_cap(proposed_actions(spark, sf_dir), ev.default_caps(spark))
    return rules.evaluate_rules(capped, ev.valid_rules(ev.default_rules(spark)))


@query("evaluate_rules", v.with_(v.EVENTS, RULE_SQL) + """
SELECT event_id, failed_rules, CASE WHEN action_type = 'carrier_pigeon' THEN 'DENY'
  WHEN list_contains(cs, 'DENY') THEN 'DENY' WHEN list_contains(cs, 'ESCALATE_HUMAN') THEN 'ESCALATE_HUMAN'
  WHEN list_contains(cs, 'DEFER') THEN 'DEFER' ELSE 'ALLOW' END AS verdict, action_type = 'carrier_pigeon' AS degraded
FROM judged""")
def evaluate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_actions(spark, sf_dir).select(
        "event_id", F.concat_ws(",", "failed_rules").alias("failed_rules"), "verdict", "degraded"
    )


@query("rule_checks", v.with_(v.EVENTS, RULE_SQL) + """
SELECT rule_id, CAST(version AS INT) AS version, verdict, count(*) AS n FROM (
  SELECT 'DPDP-CONSENT-VALID' AS rule_id, 1 AS version, c_dpdp AS verdict FROM ck
  UNION ALL SELECT 'HOUSE-FATIGUE-CAP', 1, c_fat FROM ck UNION ALL SELECT 'NPCI-AUTOPAY-WINDOW', 3, c_win FROM ck
  UNION ALL SELECT 'NPCI-PDN-CUTOFF-2350', 1, c_cut FROM ck UNION ALL SELECT 'RBI-EMANDATE-AFA-CAP', 2, c_cap FROM ck
  UNION ALL SELECT 'RBI-EMANDATE-PDN-24H', CASE WHEN x % 2 = 0 THEN 2 ELSE 3 END, c_pdn FROM ck
  UNION ALL SELECT 'RBI-FPC-CONTACT-WINDOW', 1, c_con FROM ck UNION ALL SELECT 'TRAI-DLT-TEMPLATE', 4, c_dlt FROM ck)
WHERE verdict IS NOT NULL GROUP BY ALL""")
def rule_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = judged_actions(spark, sf_dir).select(F.inline("checks"))
    return long.groupBy("rule_id", "version", "verdict").agg(F.count("*").alias("n"))


_FORCE = """
rl(rule_id, version, as_of, acts, rails) AS (VALUES
  ('NPCI-AUTOPAY-WINDOW', 3, DATE '2026-08-01', ['debit_attempt'], ['upi_autopay']),
  ('RBI-EMANDATE-PDN-24H', 2, DATE '2026-04-21', ['debit_attempt'], ['upi_autopay', 'card_emandate', 'enach']),
  ('RBI-EMANDATE-PDN-24H', 3, DATE '2026-08-30', ['debit_attempt'], NULL),
  ('NPCI-PDN-CUTOFF-2350', 1, DATE '2026-04-21', ['notification'], NULL),
  ('RBI-EMANDATE-AFA-CAP', 2, DATE '2026-04-21', ['debit_attempt'], NULL),
  ('RBI-FPC-CONTACT-WINDOW', 1, DATE '2022-08-12', ['sms', 'whatsapp', 'voice'], NULL),
  ('TRAI-DLT-TEMPLATE', 4, DATE '2025-01-01', ['sms'], NULL),
  ('DPDP-CONSENT-VALID', 1, DATE '2023-08-11', ['sms', 'whatsapp', 'voice', 'debit_attempt'], NULL),
  ('HOUSE-FATIGUE-CAP', 1, DATE '2026-01-01', ['sms', 'whatsapp'], NULL)),
cx AS (SELECT DISTINCT action_type, rail, CASE WHEN x % 2 = 0 THEN DATE '2026-08-15' ELSE DATE '2026-09-01' END AS at_date FROM pa),
inf AS (SELECT action_type, cx.rail, strftime(at_date, '%Y-%m-%d') AS as_of, rule_id, max(version) AS version FROM cx
  JOIN rl ON list_contains(acts, action_type) AND rl.as_of <= at_date AND (rails IS NULL OR list_contains(rails, cx.rail))
  GROUP BY ALL)"""


def _in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    contexts = proposed_actions(spark, sf_dir).select("action_type", "rail", "as_of").distinct()
    return rules.rules_in_force(contexts, ev.valid_rules(ev.default_rules(spark)))


@query("rules_in_force", v.with_(v.EVENTS, RULE_SQL, _FORCE) + """
SELECT action_type, rail, as_of, rule_id, CAST(version AS INT) AS version FROM inf""")
def rules_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_force(spark, sf_dir).select(
        "action_type", "rail", F.col("as_of").cast("string").alias("as_of"), "rule_id", "version"
    )


@query("rules_not_in_force", v.with_(v.EVENTS, RULE_SQL, _FORCE) + """
SELECT rule_id FROM (SELECT DISTINCT rule_id FROM rl UNION SELECT 'RULE-X-' || action_type FROM cx)
EXCEPT SELECT rule_id FROM inf""")
def rules_not_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = ev.default_rules(spark).select("rule_id").distinct()
    extra = proposed_actions(spark, sf_dir).select(F.concat(F.lit("RULE-X-"), "action_type").alias("rule_id")).distinct()
    return rules.rules_not_in_force(named.union(extra), _in_force(spark, sf_dir))


@query("caps_as_of", v.with_(v.EVENTS, RULE_SQL) + """
SELECT mcc, CAST(CASE WHEN mcc = '6300' THEN 10000000 ELSE 1500000 END AS BIGINT) AS afa_free_cap, count(*) AS n FROM pa GROUP BY mcc""")
def caps_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = rules.with_afa_cap(proposed_actions(spark, sf_dir), ev.default_caps(spark))
    return capped.groupBy("mcc", "afa_free_cap").agg(F.count("*").alias("n"))


@query("shadow_audit", v.with_(v.CYCLES, """
f AS (SELECT *, CASE rail WHEN 'upi_autopay' THEN 1 ELSE 0 END AS upi,
  CASE WHEN amount_paise > CASE WHEN mcc = '6300' THEN 10000000 ELSE 1500000 END THEN 1 ELSE 0 END AS over FROM ev_cycles WHERE failed),
t AS (SELECT count(*) AS n, sum(upi) * 3 AS win, count(*) * 3 AS pdn, sum(over) * 3 AS cap FROM f)""") + """
SELECT rule_id, CAST(violations AS BIGINT) AS violations, round(violations * 10000 / n, 4) AS per_10k_cycles FROM (
  SELECT 'NPCI-AUTOPAY-WINDOW' AS rule_id, win AS violations, n FROM t UNION ALL SELECT 'RBI-EMANDATE-PDN-24H', pdn, n FROM t
  UNION ALL SELECT 'RBI-EMANDATE-AFA-CAP', cap, n FROM t)""")
def shadow_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = td.billing_cycles(spark, sf_dir).where("failed")
    return rules.shadow_audit(_judged_baseline(spark, failed), failed.agg(F.count("*")).scalar())


def _judged_baseline(spark: SparkSession, failed: DataFrame) -> DataFrame:
    actions = rules.with_afa_cap(rules.baseline_actions(failed, dt.date(2026, 9, 1)), ev.default_caps(spark))
    return rules.evaluate_rules(actions, ev.valid_rules(ev.default_rules(spark)))


@query("shadow_audit_totals", v.with_(v.CYCLES) + """
SELECT count(*) * 3 AS attempts, 0::BIGINT AS allowed, 0::BIGINT AS defer, 0::BIGINT AS escalate_human, count(*) * 3 AS deny FROM ev_cycles WHERE failed""")
def shadow_audit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No default retry announces itself a day ahead, so each of them is denied."""
    failed = td.billing_cycles(spark, sf_dir).where("failed")
    return rules.audit_totals(_judged_baseline(spark, failed)).select("attempts", "allowed", "defer", "escalate_human", "deny")


# ------------------------------------------------------------------ ledger

FIELDS = ["decision_id", "ts", "cycle_id", "verdict", "amount_paise"]


def chained(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The ledger of all decisions: the fields that are hashed, and ``more`` columns beside them."""
    decisions = td.gate_decisions(spark, sf_dir).select(*ledger.KEYS, *FIELDS, *more)
    return ledger.append_decisions(decisions, ["ts", "decision_id"], fields=FIELDS)


CHAIN = """
body AS (
  SELECT *, '{"decision_id":"' || decision_id || '","ts":' || epoch_us(ts) || ',"cycle_id":' || cycle_id || ',"verdict":"' || verdict
    || '","amount_paise":' || amount_paise || '}' AS payload,
    row_number() OVER (PARTITION BY tenant_id, lane ORDER BY ts, decision_id) - 1 AS seq FROM ev_decisions),
chain AS (
  SELECT tenant_id, lane, seq, repeat('0', 64) AS prev, sha256(tenant_id || '|' || lane || '|0|' || repeat('0', 64) || '|' || payload) AS h
  FROM body WHERE seq = 0
  UNION ALL
  SELECT b.tenant_id, b.lane, b.seq, c.h, sha256(b.tenant_id || '|' || b.lane || '|' || b.seq || '|' || c.h || '|' || b.payload)
  FROM chain c JOIN body b ON b.tenant_id = c.tenant_id AND b.lane = c.lane AND b.seq = c.seq + 1)"""
_CH = "WITH RECURSIVE " + v.with_(v.DECISIONS, CHAIN)[5:]


@query("append_decisions", _CH + """
SELECT tenant_id, lane, max(seq) AS chain_seq, arg_max(h, seq) AS record_hash FROM chain GROUP BY ALL""")
def append_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.chain_heads(chained(spark, sf_dir))


def damaged(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The chained ledger with edited amounts, forged hashes and lost records."""
    built = chained(spark, sf_dir, *more)
    x = F.col("amount_paise")
    kept = built.where(~((F.col("chain_seq") > 0) & (x % 41 == 0)))
    payload = F.when(x % 29 == 0, F.replace("payload", F.lit('"amount_paise":'), F.lit('"amount_paise":9'))).otherwise(F.col("payload"))
    forged = F.when(x % 37 == 0, F.repeat(F.lit("f"), F.lit(64))).otherwise(F.col("record_hash"))
    return kept.withColumn("payload", payload).withColumn("record_hash", forged)


_DAMAGE = """
full_ AS (SELECT b.*, c.prev, c.h FROM body b JOIN chain c USING (tenant_id, lane, seq)),
led AS (
  SELECT tenant_id, lane, seq, prev, decision_id, CASE WHEN amount_paise % 29 = 0 THEN replace(payload, '"amount_paise":', '"amount_paise":9')
    ELSE payload END AS payload, CASE WHEN amount_paise % 37 = 0 THEN repeat('f', 64) ELSE h END AS h
  FROM full_ WHERE NOT (seq > 0 AND amount_paise % 41 = 0)),
lk AS (
  SELECT *, coalesce(lag(seq) OVER w + 1, 0) AS want_seq, coalesce(lag(h) OVER w, repeat('0', 64)) AS want_prev,
    sha256(tenant_id || '|' || lane || '|' || seq || '|' || prev || '|' || payload) AS calc
  FROM led WINDOW w AS (PARTITION BY tenant_id, lane ORDER BY seq)),
brk AS (
  SELECT tenant_id, lane, seq, decision_id, 'sequence gap' AS reason, CAST(want_seq AS VARCHAR) AS expected, CAST(seq AS VARCHAR) AS found FROM lk WHERE seq <> want_seq
  UNION ALL SELECT tenant_id, lane, seq, decision_id, 'broken link', want_prev, prev FROM lk WHERE prev <> want_prev
  UNION ALL SELECT tenant_id, lane, seq, decision_id, 'hash mismatch', calc, h FROM lk WHERE h <> calc)"""


@query("verify_chain", _CH.rstrip() + "," + _DAMAGE + """
SELECT tenant_id, lane, seq AS chain_seq, decision_id, reason, expected, found FROM brk""")
def verify_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.verify_chain(damaged(spark, sf_dir))


_SEGMENT = 4
_REGISTER = f"""
node AS (SELECT tenant_id, lane, seq // {_SEGMENT} AS segment, count(*) AS records, sha256(string_agg(h, '|' ORDER BY seq)) AS root FROM chain GROUP BY ALL),
reg AS (SELECT tenant_id, lane, max(seq) AS last FROM chain GROUP BY ALL),
kept AS (SELECT tenant_id, lane, seq, CASE WHEN amount_paise % 37 = 0 THEN repeat('f', 64) ELSE h END AS h FROM full_
  WHERE NOT (seq > 0 AND amount_paise % 41 = 0) AND lane % 13 <> 0),
again AS (SELECT tenant_id, lane, seq // {_SEGMENT} AS segment, sha256(string_agg(h, '|' ORDER BY seq)) AS root FROM kept GROUP BY ALL),
ends AS (SELECT r.tenant_id, r.lane, r.last, max(k.seq) AS found FROM reg r LEFT JOIN kept k USING (tenant_id, lane) GROUP BY ALL),
flt AS (
  SELECT tenant_id, lane, 'lost chain' AS reason, 0::BIGINT AS from_seq, last AS to_seq FROM ends WHERE found IS NULL
  UNION ALL SELECT tenant_id, lane, 'cut tail', found + 1, last FROM ends WHERE found < last
  UNION ALL SELECT n.tenant_id, n.lane, 'changed segment', segment * {_SEGMENT}, least(segment * {_SEGMENT} + {_SEGMENT - 1}, last)
    FROM node n JOIN again a USING (tenant_id, lane, segment) JOIN reg r USING (tenant_id, lane) WHERE n.root <> a.root)"""


def _kept_register(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    built = checkpointed(chained(spark, sf_dir).select(*ledger.KEYS, "chain_seq", "record_hash", "amount_paise"))
    return built, checkpointed(ledger.chain_register(built, _SEGMENT))


@query("chain_register", _CH.rstrip() + "," + _DAMAGE.rsplit("lk AS (", 1)[0].rstrip().rstrip(",") + "," + _REGISTER + """
SELECT tenant_id, lane, segment, records, root FROM node""")
def chain_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept apart from the ledger: the roots of every chain's segments."""
    return _kept_register(spark, sf_dir)[1].select("tenant_id", "lane", F.inline("segments"))


@query("verify_register", _CH.rstrip() + "," + _DAMAGE.rsplit("lk AS (", 1)[0].rstrip().rstrip(",") + "," + _REGISTER + """
SELECT tenant_id, lane, reason, from_seq, to_seq FROM flt""")
def verify_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged ledger, with whole chains gone, against the register of the sound one."""
    built, register = _kept_register(spark, sf_dir)
    x = F.col("amount_paise")
    kept = built.where(~((F.col("chain_seq") > 0) & (x % 41 == 0)) & (F.col("lane") % 13 != 0))
    forged = kept.withColumn("record_hash", F.when(x % 37 == 0, F.repeat(F.lit("f"), F.lit(64))).otherwise(F.col("record_hash")))
    return ledger.verify_register(forged, register, _SEGMENT)


@query("tenant_roots", _CH.rstrip() + """, ends AS (SELECT tenant_id, lane, arg_max(h, seq) AS h FROM chain GROUP BY ALL),
l0 AS (SELECT tenant_id, row_number() OVER (PARTITION BY tenant_id ORDER BY lane) - 1 AS pos, h FROM ends),
l1 AS (SELECT tenant_id, pos // 256 AS pos, sha256(string_agg(h, '|' ORDER BY pos)) AS h FROM l0 GROUP BY ALL),
l2 AS (SELECT tenant_id, pos // 256 AS pos, sha256(string_agg(h, '|' ORDER BY pos)) AS h FROM l1 GROUP BY ALL)
SELECT tenant_id, h AS root FROM l2""")
def tenant_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.tenant_roots(ledger.chain_heads(checkpointed(chained(spark, sf_dir))))


@query("replay_decisions", _CH.rstrip() + "," + _DAMAGE + """
SELECT l.tenant_id, l.lane, l.seq AS chain_seq, l.h = l.calc AS hash_matches,
  concat_ws(',', CASE WHEN d.part % 50 = 0 THEN 'RULE-A' END, CASE WHEN d.verdict <> 'ALLOW' THEN 'RULE-B' END) AS refused
FROM lk l JOIN ev_decisions d USING (decision_id)""")
def replay_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = F.to_json(F.array(
        F.struct(F.lit("RULE-A").alias("rule_id"), F.when(F.col("part") % 50 == 0, "DENY").otherwise("ALLOW").alias("verdict")),
        F.struct(F.lit("RULE-B").alias("rule_id"), F.col("verdict").alias("verdict")),
    ))
    replayed = ledger.replay_decisions(damaged(spark, sf_dir, "part").withColumn("checks_json", checks))
    return replayed.select("tenant_id", "lane", "chain_seq", "hash_matches", F.concat_ws(",", "refused").alias("refused"))


_ORDER = ["ts", "decision_id"]


@query("ledger_page", v.with_(v.DECISIONS) + """
SELECT decision_id, verdict FROM ev_decisions WHERE verdict <> 'ALLOW' AND ts < TIMESTAMP '2000-01-01' ORDER BY ts DESC, decision_id DESC LIMIT 50""")
def ledger_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.col("ts") < F.lit("2000-01-01 00:00:00").cast("timestamp")
    return ledger.ledger_page(td.gate_decisions(spark, sf_dir), "refused", _ORDER, before).select("decision_id", "verdict")


@query("decision_ticker", v.with_(v.DECISIONS) + f"""
SELECT decision_id, verdict, {v.secs('ts')} AS at_s FROM ev_decisions WHERE ts > TIMESTAMP '2001-01-01' ORDER BY ts DESC, decision_id DESC LIMIT 20""")
def decision_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = td.gate_decisions(spark, sf_dir).where(F.col("ts") > F.lit("2001-01-01 00:00:00").cast("timestamp"))
    return ledger.ledger_page(recent, "all", _ORDER, limit=20).select(
        "decision_id", "verdict", F.unix_seconds("ts").alias("at_s")
    )


@query("recent_cycles", v.with_(v.CYCLES) + f"""
SELECT cycle_id, {v.secs('due_at')} AS due_s, amount_paise FROM ev_cycles ORDER BY due_at DESC, cycle_id DESC LIMIT 50""")
def recent_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles = td.billing_cycles(spark, sf_dir)
    return cycles.orderBy(F.col("due_at").desc(), F.col("cycle_id").desc()).limit(50).select(
        "cycle_id", F.unix_seconds("due_at").alias("due_s"), "amount_paise"
    )


def stored_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed payments as stored debit actions."""
    failed = td.payment_events(spark, sf_dir).where("event_type = 'payment.failed'")
    x = F.col("amount_paise")
    return failed.select(
        "tenant_id", F.col("event_id").alias("action_id"), F.col("cycle_ref").alias("cycle_id"), F.lit("debit_attempt").alias("action_type"),
        legality.slot_time(F.col("occurred_at"), x % 200).alias("fire_at"),
        F.when(x % 3 == 0, "pending").when(x % 3 == 1, "claimed").otherwise("done").alias("state"),
    )


_STORED = """
sa AS (SELECT tenant_id, event_id AS action_id, cycle_ref AS cycle_id, occurred_at + (amount_paise % 200) * INTERVAL 1 HOUR AS fire_at,
  CASE amount_paise % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'claimed' ELSE 'done' END AS state
  FROM ev_events WHERE event_type = 'payment.failed')"""


@query("due_actions", v.with_(v.EVENTS, _STORED, """
r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY fire_at, action_id) AS position FROM sa
  WHERE state <> 'done' AND fire_at <= TIMESTAMP '2024-01-20')""") + """
SELECT tenant_id, action_id, CAST(position AS INT) AS position FROM r WHERE position <= 50""")
def due_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return ledger.due_actions(stored_actions(spark, sf_dir), now, 50).select("tenant_id", "action_id", "position")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = td.payment_events(spark, sf_dir)
    events = log.select(F.col("cycle_ref").alias("cycle_id"), F.col("occurred_at").alias("at"), "event_type")
    decided = log.where("event_type = 'payment.failed'").select(
        F.col("cycle_ref").alias("cycle_id"), legality.slot_time(F.col("occurred_at"), F.lit(1)).alias("at"),
        F.lit("retry_decision").alias("action_type"),
    )
    actions = stored_actions(spark, sf_dir).withColumnRenamed("fire_at", "at")
    return ledger.cycle_timeline(events, decided, actions)


_TIMELINE = """
tl AS (
  SELECT cycle_ref AS cycle_id, occurred_at AS ats, replace(event_type, '.', '_') AS kind, FALSE AS pending FROM ev_events
  UNION ALL SELECT cycle_ref, occurred_at + INTERVAL 1 HOUR, 'retry_decision', FALSE FROM ev_events WHERE event_type = 'payment.failed'
  UNION ALL SELECT cycle_id, fire_at, 'debit_attempt', TRUE FROM sa WHERE state <> 'done')"""


@query("cycle_timeline", v.with_(v.EVENTS, _STORED, _TIMELINE) + f"""
SELECT cycle_id, kind, pending, count(*) AS n, {v.micros('min(ats)')} AS first_us, {v.micros('max(ats)')} AS last_us FROM tl GROUP BY ALL""")
def cycle_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline(spark, sf_dir).groupBy("cycle_id", "kind", "pending").agg(
        F.count("*").alias("n"), F.unix_micros(F.min("at")).alias("first_us"), F.unix_micros(F.max("at")).alias("last_us")
    )


@query("timeline_axis", v.with_(v.EVENTS, _STORED, _TIMELINE, f"""
ts AS (SELECT cycle_id, {v.secs('ats')} AS s FROM tl),
ax AS (SELECT cycle_id, min(s) AS lo, greatest(max(s), {v.secs("TIMESTAMP '2024-01-20'")}) AS hi FROM ts GROUP BY 1)""") + """
SELECT cycle_id, hi + 28800 AS axis_to_s, greatest(lo - 14400, hi + 28800 - 345600) AS axis_from_s, count(*) AS entries,
  count(CASE WHEN s < greatest(lo - 14400, hi + 28800 - 345600) THEN 1 END) AS off_axis FROM ts JOIN ax USING (cycle_id) GROUP BY ALL""")
def timeline_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.timeline_axis(timeline(spark, sf_dir), F.lit("2024-01-20 00:00:00").cast("timestamp"))


# ------------------------------------------------------------------ privacy

PEPPER = b"test-pepper"
_IPAD, _OPAD = hashing.hmac_pads(PEPPER)


def _anon(tenant: str, customer: str) -> str:
    return (
        f"'anon_' || substr(sha256(from_hex('{_OPAD}') || from_hex(sha256(from_hex('{_IPAD}') || "
        f"encode('{privacy.DOMAIN}|' || {tenant} || '|' || {customer})))), 1, 32)"
    )


@query("pseudonymise", f"""
SELECT c_custkey AS customer_id, {_anon("'n' || c_nationkey", 'c_custkey')} AS pseudonym FROM customer""")
def pseudonymise(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenant = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    return td.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), privacy.pseudonymise(tenant, F.col("c_custkey"), PEPPER).alias("pseudonym")
    )


def suppressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some customers suppressed by raw id, others by pseudonym."""
    key = F.col("c_custkey")
    tenant = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    listed = td.table(spark, sf_dir, "customer").where(key % 5 < 2)
    ref = F.when(key % 5 == 0, key.cast("string")).otherwise(privacy.pseudonymise(tenant, key, PEPPER))
    return listed.select(tenant.alias("tenant_id"), ref.alias("customer_ref"), F.lit("opt_out").alias("reason"))


@query("apply_suppressions", v.with_(v.CYCLES_T) + """
SELECT cycle_id, customer_id FROM ev_cycles_t WHERE customer_id % 5 >= 2""")
def apply_suppressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles = td.billing_cycles(spark, sf_dir, with_tenant=True)
    return privacy.apply_suppressions(cycles, suppressions(spark, sf_dir), PEPPER).select("cycle_id", "customer_id")


@query("excluded_from_training", v.with_(v.CYCLES_T) + """
SELECT tenant_id, count(*) AS rows_kept FROM ev_cycles_t WHERE customer_id % 5 >= 2 GROUP BY tenant_id""")
def excluded_from_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles = td.billing_cycles(spark, sf_dir, with_tenant=True)
    kept = privacy.excluded_from_training(cycles, suppressions(spark, sf_dir), PEPPER)
    return kept.groupBy("tenant_id").agg(F.count("*").alias("rows_kept"))


def _forget_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    cust = td.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("tenant_id"), F.col("c_custkey").alias("customer_id"),
        F.col("c_custkey").cast("string").alias("customer_ref"), F.col("c_name").alias("raw_text"),
    )
    return {
        "suppressions": suppressions(spark, sf_dir),
        "mandates": cust.select("tenant_id", "customer_id", "customer_ref"),
        "profiles": cust.select("tenant_id", "customer_id"),
        "replies": cust.withColumn("needs_human", F.lit(True)),
    }


@query("forget_customers", f"""
WITH c AS (SELECT 'n' || c_nationkey AS tenant_id, c_custkey AS k, c_name FROM customer)
SELECT 'mandates' AS tbl, count(*) AS n, count(CASE WHEN k % 4 = 1 THEN 1 END) AS changed FROM c
UNION ALL SELECT 'profiles', count(CASE WHEN k % 4 <> 1 THEN 1 END), 0 FROM c
UNION ALL SELECT 'replies', count(*), count(CASE WHEN k % 4 = 1 THEN 1 END) FROM c
UNION ALL SELECT 'suppressions', count(CASE WHEN k % 5 < 2 THEN 1 END) + count(CASE WHEN k % 4 = 1 AND k % 5 <> 1 THEN 1 END),
  count(CASE WHEN k % 5 = 1 OR (k % 4 = 1 AND k % 5 <> 1) THEN 1 END) FROM c""")
def forget_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _forget_tables(spark, sf_dir)
    asked = tables["profiles"].where("customer_id % 4 = 1").withColumn("reason", F.lit("consent_withdrawn"))
    done = privacy.forget_customers(tables, asked, PEPPER)
    anon = F.startswith("customer_ref", F.lit(privacy.PREFIX))
    parts = []
    for name, flag in (("mandates", anon), ("profiles", F.lit(False)), ("replies", anon), ("suppressions", anon)):
        parts.append(done[name].agg(F.count("*").alias("n"), F.count_if(flag).alias("changed")).select(F.lit(name).alias("tbl"), "n", "changed"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("redact_documents", r"""
WITH r AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\b\d{13,19}\b', '[REDACTED]', 'g'),
  '\b[\w.%-]+@[\w.-]+\.[A-Za-z]{2,}\b', '[REDACTED]', 'g'), '\b(?:\+91[-\s]?)?[6-9]\d{9}\b', '[REDACTED]', 'g') AS t, text FROM documents)
SELECT doc_id, md5(t) AS digest, (length(t) - length(replace(t, '[REDACTED]', ''))) // 10 AS masks FROM r""")
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = privacy.redact(td.table(spark, sf_dir, "documents").select("doc_id", "text"))
    stripped = F.replace("text", F.lit(privacy.MASK), F.lit(""))
    masks = (F.char_length("text") - F.char_length(stripped)) / 10
    return docs.select("doc_id", F.md5("text").alias("digest"), masks.cast("bigint").alias("masks"))


@query("redact_columns", """
SELECT role, count(*) AS n, '[REDACTED]' AS reply_token FROM conversations GROUP BY role""")
def redact_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = td.table(spark, sf_dir, "conversations").select("role", F.col("text").alias("reply_token"))
    return privacy.redact(rows).groupBy("role", "reply_token").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ replies


def reply_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns rendered as parsed-reply JSON, right and wrong in eleven ways."""
    turn = F.col("conv_id") * 7 + F.col("turn")
    good = F.concat(
        F.lit('{"intent":"promise_to_pay","confidence":0.'), (turn % 9 + 1).cast("string"),
        F.lit(',"declared_funding_day":'), (turn % 31 + 1).cast("string"), F.lit(',"language":"hi"}'),
    )
    wrong = {
        1: '{"intent":"opt_out","confidence":1,"amount":5}', 2: '{"intent":"opt_out"}', 3: '{"intent":7,"confidence":1}',
        4: '{"intent":"refund","confidence":1}', 5: '{"intent":"none","confidence":true}', 6: '{"intent":"none","confidence":1.5}',
        7: '{"intent":"none","confidence":1,"declared_funding_day":2.5}', 8: '{"intent":"none","confidence":1,"declared_funding_day":32}',
        9: '{"intent":"none","confidence":1,"language":4}', 10: '{"intent":"none","confidence":1,"language":""}', 11: "[1]",
    }
    kind = turn % 13
    body = good
    for number, text in wrong.items():
        body = F.when(kind == number, F.lit(text)).otherwise(body)
    return td.table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("reply_id"), body.alias("payload"),
        F.timestamp_seconds(F.lit(1_700_000_000) + turn * 60).alias("received_at"),
        F.when(turn % 4 == 0, F.timestamp_seconds(F.lit(1_700_090_000))).alias("resolved_at"),
    )


_REPLY = """
rp AS (SELECT conv_id || '-' || turn AS reply_id, conv_id * 7 + turn AS t FROM conversations),
rj AS (SELECT *, CASE t % 13 WHEN 1 THEN 'unexpected keys' WHEN 2 THEN 'missing required keys' WHEN 3 THEN 'intent: expected a string'
  WHEN 4 THEN 'intent: unknown' WHEN 5 THEN 'confidence: expected a number' WHEN 6 THEN 'confidence: out of range'
  WHEN 7 THEN 'declared_funding_day: expected an integer' WHEN 8 THEN 'declared_funding_day: out of range'
  WHEN 9 THEN 'language: expected a string' WHEN 10 THEN 'language: bad length' WHEN 11 THEN 'expected an object' END AS rejection FROM rp)"""


@query("validate_replies", "WITH " + _REPLY + """
SELECT reply_id, rejection, CASE WHEN rejection IS NULL THEN 'promise_to_pay' END AS intent,
  CASE WHEN rejection IS NULL THEN round((t % 9 + 1) / 10.0::DOUBLE, 6) END AS confidence,
  CAST(CASE WHEN rejection IS NULL THEN t % 31 + 1 ELSE -1 END AS BIGINT) AS day FROM rj""")
def validate_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = replies.validate_replies(reply_payloads(spark, sf_dir))
    return judged.select(
        "reply_id", "rejection", "intent", F.round("confidence", 6).alias("confidence"),
        F.coalesce("declared_funding_day", F.lit(-1)).alias("day"),
    )


@query("human_queue", "WITH " + _REPLY + """
SELECT reply_id, rejection FROM rj WHERE rejection IS NOT NULL AND t % 4 <> 0 ORDER BY t, reply_id LIMIT 100""")
def human_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies.human_queue(replies.validate_replies(reply_payloads(spark, sf_dir))).select("reply_id", "rejection")


# ------------------------------------------------------------------ reconciliation


def attempt_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payment attempts with the outcome date of their rail and a spread of states."""
    x = F.col("amount_paise")
    failed = td.payment_events(spark, sf_dir).where("event_type = 'payment.failed'")
    state = F.when(x % 4 == 0, "succeeded").when(x % 4 == 1, "failed").when(x % 4 == 2, "ambiguous").otherwise("fired")
    return failed.select(
        F.col("event_id").alias("attempt_id"), "cycle_ref", F.col("event_id").cast("string").alias("idem_key"), state.alias("state"),
        "decline_code",
        F.when(F.col("rail") == "enach", cal.outcome_due_at(F.col("rail"), F.col("occurred_at"))).alias("outcome_due_at"),
    )


_ATT = f"""
al AS (
  SELECT event_id AS attempt_id, cycle_ref, rail, decline_code, amount_paise AS x,
    CASE amount_paise % 4 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' WHEN 2 THEN 'ambiguous' ELSE 'fired' END AS state,
    CASE WHEN rail = 'enach' THEN occurred_at + CASE WHEN {v.weekday_ist('occurred_at')} = 4 THEN 3
      WHEN {v.weekday_ist('occurred_at')} = 5 THEN 2 ELSE 1 END * INTERVAL 1 DAY END AS due
  FROM ev_events WHERE event_type = 'payment.failed'),
os AS (SELECT *, CASE WHEN x % 4 < 2 THEN 'resolved' WHEN TIMESTAMP '2024-01-20' < due THEN 'awaiting' ELSE 'overdue' END AS status
  FROM al WHERE due IS NOT NULL)"""


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return reconcile.outcome_status(attempt_log(spark, sf_dir), projected(spark, sf_dir), now)


@query("outcome_status", v.with_(v.EVENTS, PROJECTED, _ATT) + """
SELECT attempt_id, rail, status, x % 4 >= 2 AND due < TIMESTAMP '2024-01-20' - INTERVAL 6 HOUR AS alert FROM os""")
def outcome_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir).select("attempt_id", "rail", "status", "alert")


@query("retry_allowed", v.with_(v.EVENTS, PROJECTED, _ATT) + """
SELECT cycle_ref FROM proj WHERE cycle_ref NOT IN (SELECT cycle_ref FROM os WHERE status <> 'resolved')""")
def retry_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.retry_allowed(projected(spark, sf_dir), _status(spark, sf_dir)).select("cycle_ref")


@query("reconcile_by_key", v.with_(v.EVENTS, _ATT, """
pv AS (SELECT CAST(event_id AS VARCHAR) AS idem_key, CASE amount_paise % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'declined' ELSE 'ambiguous' END AS outcome
  FROM ev_events WHERE event_type IN ('payment.failed', 'payment.captured') AND amount_paise % 7 <> 0)""") + """
SELECT coalesce(CAST(a.attempt_id AS VARCHAR), p.idem_key) AS idem_key,
  CASE WHEN a.state IS NULL THEN NULL WHEN a.state <> 'ambiguous' THEN a.state WHEN p.outcome IS NULL THEN 'failed'
    WHEN p.outcome = 'accepted' THEN 'fired' WHEN p.outcome = 'declined' THEN 'failed' ELSE 'ambiguous' END AS state,
  CASE WHEN a.state = 'ambiguous' AND p.outcome IS NULL THEN 'reconciled_not_charged'
    WHEN a.state = 'ambiguous' AND p.outcome = 'declined' THEN '05' ELSE a.decline_code END AS decline_code,
  CASE WHEN a.state IS NULL THEN 'unknown at our side' WHEN a.state = 'failed' AND p.outcome = 'accepted' THEN 'charged though recorded failed'
    WHEN a.state = 'fired' AND p.outcome IS NULL THEN 'fired but unknown to provider' END AS discrepancy
FROM al a FULL JOIN pv p ON p.idem_key = CAST(a.attempt_id AS VARCHAR)""")
def reconcile_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("amount_paise")
    outcome = F.when(x % 3 == 0, "accepted").when(x % 3 == 1, "declined").otherwise("ambiguous")
    provider = td.payment_events(spark, sf_dir).where(
        F.col("event_type").isin("payment.failed", "payment.captured") & (x % 7 != 0)
    ).select(F.col("event_id").cast("string").alias("idem_key"), outcome.alias("outcome"), F.lit("05").alias("decline_code"))
    return reconcile.reconcile_by_key(attempt_log(spark, sf_dir), provider)
