"""The domain views as SQL text, shared by the oracle statements."""

from __future__ import annotations


def _case(index: str, values: tuple[str | None, ...]) -> str:
    arms = " ".join(
        f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)
    )
    return f"(CASE {index} {arms} END)"


_MCC = ("7997", "5815", "8299", "6300")
_DECLINE = ("51", "05", "91", "61", "54", "57", "41", None)


def _rail(key: str) -> str:
    return (
        f"(CASE WHEN {key} % 10 < 7 THEN 'upi_autopay' WHEN {key} % 10 < 9 "
        "THEN 'card_emandate' ELSE 'enach' END)"
    )


EVENTS = f"""
ev_events AS (
  SELECT event_id, 't' || (user_id % 5) AS tenant_id, user_id AS customer_id,
    user_id AS mandate_id,
    user_id || '-' || strftime(date_trunc('week', ts), '%Y%m%d') AS cycle_ref,
    CASE event_type
      WHEN 'purchase' THEN 'payment.captured'
      WHEN 'error' THEN 'payment.failed'
      WHEN 'signup' THEN 'subscription.authenticated'
      WHEN 'click' THEN CASE WHEN CAST(props->>'k' AS INT) % 10 = 0
        THEN 'subscription.cancelled' ELSE 'subscription.halted' END
      WHEN 'view' THEN CASE WHEN CAST(props->>'k' AS INT) % 2 = 0
        THEN 'subscription.paused' ELSE 'subscription.resumed' END
    END AS event_type,
    ts AS occurred_at,
    CAST(date_trunc('week', ts) AS TIMESTAMP) + INTERVAL 7 DAY AS deadline_at,
    CAST(round(value * 100) AS BIGINT) AS amount_paise,
    'ISS' || (user_id % 8) AS issuer, {_rail('user_id')} AS rail,
    {_case('user_id % 4', _MCC)} AS mcc,
    CASE WHEN event_type = 'error' THEN {_case("CAST(props->>'k' AS INT) % 8", _DECLINE)} END
      AS decline_code
  FROM events)"""

MANDATES = f"""
ev_mandates AS (
  SELECT 't' || (c_custkey % 5) AS tenant_id, c_custkey AS mandate_id, c_custkey AS customer_id,
    {_rail('(c_custkey + c_nationkey)')} AS rail, {_case('(c_custkey + c_nationkey) % 4', _MCC)} AS mcc
  FROM customer)"""

CYCLES = f"""
ev_cycles AS (
  SELECT o_orderkey AS cycle_id, o_custkey AS customer_id, o_custkey AS mandate_id,
    {_rail('o_custkey')} AS rail, {_case('o_custkey % 4', _MCC)} AS mcc,
    'ISS' || (o_custkey % 8) AS issuer,
    CAST(round(o_totalprice * 10) AS BIGINT) AS amount_paise,
    o_orderdate AS due_at, o_orderstatus <> 'O' AS failed, o_orderstatus = 'P' AS recovered,
    CASE WHEN o_orderstatus = 'P' THEN o_orderdate + (o_orderkey % 7 + 1) * INTERVAL 1 DAY END
      AS recovered_at,
    CASE WHEN o_orderstatus <> 'O' THEN {_case('o_orderkey % 8', _DECLINE)} END AS decline_code
  FROM orders)"""

CYCLES_T = CYCLES + """,
ev_cycles_t AS (
  SELECT c.*, 'n' || k.c_nationkey AS tenant_id
  FROM ev_cycles c JOIN customer k ON k.c_custkey = c.customer_id)"""

DECISIONS = """
ev_decisions AS (
  SELECT 't' || (l_orderkey % 5) AS tenant_id, l_orderkey AS lane,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
      CAST(epoch(l_shipdate) AS BIGINT)) AS decision_id,
    l_shipdate AS ts, l_orderkey AS cycle_id,
    CASE l_returnflag WHEN 'N' THEN 'ALLOW' WHEN 'R' THEN 'DENY' ELSE 'DEFER' END AS verdict,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_paise,
    l_linenumber AS line, l_partkey AS part
  FROM lineitem)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def secs(ts: str) -> str:
    return f"(epoch_us({ts}) // 1000000)"


def micros(ts: str) -> str:
    return f"epoch_us({ts})"


def minute_ist(ts: str) -> str:
    return f"((({secs(ts)} + 19800) % 86400) // 60)"


def day_ist(ts: str) -> str:
    return f"(({secs(ts)} + 19800) // 86400)"


def weekday_ist(ts: str) -> str:
    return f"(({day_ist(ts)} + 3) % 7)"


def dom_ist(ts: str) -> str:
    return f"CAST(day({ts} + INTERVAL 330 MINUTE) AS INT)"


def hour_band(ts: str) -> str:
    m = minute_ist(ts)
    return (
        f"(CASE WHEN {m} < 600 THEN 0 WHEN {m} < 780 THEN 1 WHEN {m} < 1020 THEN 2 "
        f"WHEN {m} < 1290 THEN 3 ELSE 4 END)"
    )


def ticket_band(x: str) -> str:
    return (
        f"(CASE WHEN {x} < 100000 THEN 0 WHEN {x} < 500000 THEN 1 WHEN {x} < 1500000 THEN 2 "
        f"WHEN {x} < 10000000 THEN 3 ELSE 4 END)"
    )


def exec_legal(rail: str, ts: str) -> str:
    m = minute_ist(ts)
    return (
        f"(CASE {rail} WHEN 'upi_autopay' THEN ({m} < 600 OR ({m} >= 780 AND {m} < 1020) "
        f"OR {m} >= 1290) WHEN 'card_emandate' THEN TRUE "
        f"ELSE ({weekday_ist(ts)} < 5 AND {m} < 780) END)"
    )


def budget(rail: str) -> str:
    return f"(CASE {rail} WHEN 'enach' THEN 3 ELSE 4 END)"


def cause_weights(code: str) -> str:
    """CTE columns w_<cause> in a neutral context."""
    rows = {
        "no_funds": ("1.0", "0.97", "0.06", "0.06", "0.35"),
        "issuer_degraded": ("0.35", "0.015", "0.04", "0.04", "0.25"),
        "fraud_hold": ("0.25", "0.0", "0.0", "0.0", "0.2"),
        "limit_breach": ("0.2", "0.015", "0.0", "0.9", "0.2"),
    }
    parts = []
    for cause, (c05, c51, c91, c61, other) in rows.items():
        parts.append(
            f"CAST(CASE {code} WHEN '05' THEN {c05} WHEN '51' THEN {c51} WHEN '91' THEN {c91} "
            f"WHEN '61' THEN {c61} WHEN '41' THEN 0 WHEN '43' THEN 0 WHEN '14' THEN 0 "
            f"WHEN '54' THEN 0 WHEN '57' THEN 0 ELSE {other} END AS DOUBLE) AS w_{cause}"
        )
    parts.append(f"CAST(CASE {code} WHEN '57' THEN 1 ELSE 0 END AS DOUBLE) AS w_mandate_dead")
    parts.append(
        f"CAST(CASE WHEN {code} IN ('41','43','14','54') THEN 1 ELSE 0 END AS DOUBLE) "
        "AS w_credential_dead"
    )
    return ",\n    ".join(parts)


def p_recoverable(code: str) -> str:
    return f"(CASE WHEN {code} IN ('41','43','14','54','57') THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END)"


def wilson(s: str, n: str, side: str, z: float = 1.959963984540054) -> str:
    z2 = z * z
    nn = f"greatest(CAST({n} AS DOUBLE), 1.0)"
    p = f"(CAST({s} AS DOUBLE) / {nn})"
    root = f"sqrt({p} * (1.0 - {p}) / {nn} + {z2} / ({nn} * {nn} * 4.0))"
    bound = f"(({p} + {z2} / ({nn} * 2.0)) / (1.0 + {z2} / {nn}) {side} {z} / (1.0 + {z2} / {nn}) * {root})"
    if side == "-":
        return f"(CASE WHEN {n} = 0 THEN 0.0 ELSE greatest({bound}, 0.0) END)"
    return f"(CASE WHEN {n} = 0 THEN 1.0 ELSE least({bound}, 1.0) END)"
