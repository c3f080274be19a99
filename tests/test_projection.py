"""The convergence set: any order and any number of copies give one state."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from redebit.operators import planning, priors, projection
from redebit.sources import events as ev

BASE = dt.datetime(2026, 1, 1)
KINDS = [
    "subscription.authenticated", "payment.failed", "payment.failed", "payment.failed", "payment.captured",
    "subscription.halted", "subscription.cancelled",
]


def convergence_rows():
    return [
        (f"e{i}", "m1", "c1", kind, BASE + dt.timedelta(minutes=10 * i), BASE + dt.timedelta(days=30), 49_900)
        for i, kind in enumerate(KINDS)
    ]


SCHEMA = "event_id string, mandate_id string, cycle_ref string, event_type string, occurred_at timestamp, deadline_at timestamp, amount_paise bigint"
KEYS = ["mandate_id", "cycle_ref"]


def project(df):
    cycle = projection.project_cycles(projection.unique_events(df), KEYS).first()
    mandate = projection.mandate_state(df).first()
    return cycle["state"], cycle["attempts_used"], cycle["recovered_paise"], mandate["state"], mandate["stale_transitions"]


def test_convergence(spark):
    rng = random.Random(0)
    for _ in range(6):
        rows = convergence_rows() + rng.sample(convergence_rows(), 3)
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, SCHEMA).repartition(rng.randrange(1, 5))
        assert project(df) == ("succeeded", 3, 49_900, "revoked", 0)


def fold(kinds):
    state, stale = "created", 0
    for kind in kinds:
        to = projection.MANDATE_EVENT_STATE.get(kind)
        if to is None or to == state:
            continue
        if to in projection.MANDATE_TRANSITIONS[state]:
            state = to
        else:
            stale += 1
    return state, stale


@pytest.mark.parametrize("levels", [(60, 86_400), (86_400,), (7_200, 90_000, 10**7), (10**9,)])
def test_block_composition_equals_the_plain_fold(spark, levels):
    rng = random.Random(len(levels))
    kinds = list(projection.MANDATE_EVENT_STATE)
    rows, want = [], {}
    for m in range(12):
        chosen = [rng.choice(kinds) for _ in range(40)]
        want[f"m{m}"] = fold(chosen)
        rows += [(f"{m}-{i:03d}", f"m{m}", None, k, BASE + dt.timedelta(hours=5 * i), None, None) for i, k in enumerate(chosen)]
    rng.shuffle(rows)
    got = {r["mandate_id"]: (r["state"], r["stale_transitions"]) for r in projection.mandate_state(spark.createDataFrame(rows, SCHEMA), levels).collect()}
    assert got == want


def test_a_cycle_without_a_billing_date_is_left_out(spark):
    rows = [("e1", "m", "c", "payment.failed", BASE, None, 10)]
    assert projection.project_cycles(spark.createDataFrame(rows, SCHEMA), KEYS).count() == 0


def test_envelope_types_and_rejects(spark):
    bodies = {
        "ok": '{"event":"payment.failed","created_at":1767322800,"payload":{"payment":{"entity":{"token_id":"m","invoice_id":"c","amount":149900,"error_code":"51","error_reason":""}}}}',
        "text amount": '{"event":"payment.failed","payload":{"payment":{"entity":{"amount":"149900"}}}}',
        "negative date": '{"event":"x.y","payload":{"subscription":{"entity":{"id":"","current_end":-5}},"token":{"entity":{"id":"t"}}}}',
        "array": "[]", "broken": "{", "no type": "{}", "numeric type": '{"event":5}', "null": None,
    }
    received = dt.datetime(2026, 1, 2)
    df = spark.createDataFrame([(k, b, received) for k, b in bodies.items()], "event_id string, body string, received_at timestamp")
    got = {r["event_id"]: r for r in ev.parse_envelope(df).collect()}
    ok = got["ok"]
    assert (ok["mandate_id"], ok["cycle_ref"], ok["amount_paise"], ok["decline_code"]) == ("m", "c", 149_900, "51")
    assert ok["occurred_at"] == dt.datetime(2026, 1, 2, 3) and ok["reject_reason"] is None
    assert got["text amount"]["amount_paise"] is None and got["text amount"]["occurred_at"] == received
    assert got["negative date"]["deadline_at"] is None and got["negative date"]["mandate_id"] == "t"
    reasons = {k: r["reject_reason"] for k, r in got.items()}
    assert reasons["array"] == "body is not a JSON object"
    assert reasons["broken"] == reasons["null"] == "body is not valid JSON"
    assert reasons["no type"] == reasons["numeric type"] == "no event type"


def test_missing_event_ids(spark):
    df = spark.createDataFrame(
        [(None, '{"event":"invoice.paid","id":"b1"}'), (None, '{"event":"invoice.paid","id":7}'), ("", '{"event":"invoice.paid"}')],
        "event_id string, body string",
    ).withColumn("received_at", F.current_timestamp())
    got = [(r["event_id"], r["reject_reason"]) for r in ev.parse_envelope(df).collect()]
    assert got == [("b1", None), (None, "no event id"), (None, "no event id")]


def test_signatures_fail_closed(spark):
    import hashlib
    import hmac

    sign = lambda secret, body: hmac.new(secret, body.encode(), hashlib.sha256).hexdigest()
    rows = [("a", "{}", sign(b"old", "{}")), ("a", "{}", sign(b"new", "{}")), ("a", "{} ", sign(b"new", "{}")), ("b", "{}", sign(b"new", "{}")), ("a", "{}", "")]
    df = spark.createDataFrame(rows, "tenant_id string, body string, signature string").withColumn("n", F.monotonically_increasing_id())
    secrets = ev.secrets_frame(spark, [("a", b"old"), ("a", b"new")])
    got = [r["signature_ok"] for r in ev.verify_signatures(df, secrets).orderBy("n").collect()]
    assert got == [True, True, False, False, False]


def test_first_delivery_wins(spark):
    rows = [("e", BASE + dt.timedelta(seconds=s), v) for s, v in ((5, "late"), (1, "first"), (9, "last"))]
    for order in itertools.permutations(rows):
        df = spark.createDataFrame(list(order), "event_id string, received_at timestamp, v string")
        assert [r["v"] for r in ev.dedupe_events(df).collect()] == ["first"]


def test_mandates_give_rail_and_budget_to_bare_events(spark):
    at = "timestamp'2024-01-0{}'"
    events = spark.createDataFrame(
        [(1, "t1", 10, "c1", "payment.failed", "2024-01-01", 500), (1, "t1", 10, "c1", "payment.failed", "2024-01-01", 500),
         (2, "t1", 10, "c1", "payment.failed", "2024-01-02", 500), (3, "t1", 10, "c1", "payment.failed", "2024-01-03", 500),
         (4, "t1", 11, "c2", "payment.failed", "2024-01-01", 500), (5, "t1", 99, "c3", "payment.failed", "2024-01-01", 500),
         (6, "t1", None, "c4", "payment.failed", "2024-01-01", 500)],
        "event_id long, tenant_id string, mandate_id long, cycle_ref string, event_type string, at string, amount_paise long",
    ).selectExpr("*", "timestamp(at) AS occurred_at", "timestamp'2024-02-01' AS deadline_at").drop("at")
    mandates = spark.createDataFrame(
        [("t1", 10, 7, "enach", "7997"), ("t1", 11, 8, "upi_autopay", None), ("t2", 10, 9, "card", "1")],
        "tenant_id string, mandate_id long, customer_id long, rail string, mcc string")
    cycles = projection.project_cycles(events)
    none = spark.createDataFrame([], "cycle_ref string, state string")
    now = F.expr(at.format(5))
    got = planning.retry_candidates(cycles, none, now, mandates).collect()
    # The batch rail allows three attempts, which c1 has used; unknown and missing mandates drop out.
    assert [(r.cycle_ref, r.customer_id, r.rail, r.budget_left) for r in got] == [("c2", 8, "upi_autopay", 3)]
    assert planning.retry_candidates(cycles.limit(0), none, now, mandates).count() == 0
    found = priors.outcomes_with_segment(events, cycles, mandates.withColumn("occurred_at", F.lit("clash")))
    assert found.groupBy("rail", "mcc").count().orderBy("rail").collect() == [("enach", "7997", 3), ("upi_autopay", "0000", 1)]
