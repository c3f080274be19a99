import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from redebit.operators import ledger, privacy, reconcile, replies, rules
from redebit.sources import events as ev
from redebit.sources import sinks

DEBIT = {
    "action_type": "debit_attempt", "rail": "upi_autopay", "mcc": "5815", "amount_paise": 49_900, "hour_ist": 9.0,
    "pdn_sent_at": dt.datetime(2026, 8, 1), "hours_since_pdn": 30.0, "consent_ref": "c", "consent_withdrawn": False,
    "as_of": dt.date(2026, 9, 1),
}
SMS = {
    "action_type": "sms", "rail": None, "mcc": None, "amount_paise": 1, "hour_ist": 12.0, "consent_ref": "c", "consent_withdrawn": False,
    "dlt_template_id": "t", "header_series": "160", "dnd_registered": False, "messages_30d": 2, "tenant_fatigue_cap": 3,
    "as_of": dt.date(2026, 9, 1),
}
NOTE = {"action_type": "notification", "rail": None, "hour_ist": 23.8, "is_next_day_debit": True, "as_of": dt.date(2026, 9, 1)}
TYPES = {**rules.FACTS, "action_type": "string", "rail": "string", "mcc": "string", "as_of": "date"}
TYPES.pop("afa_free_cap")


def judge(spark, *actions):
    schema = "n int, " + ", ".join(f"{k} {t}" for k, t in TYPES.items())
    data = [(i, *[a.get(k) for k in TYPES]) for i, a in enumerate(actions)]
    capped = rules.with_afa_cap(spark.createDataFrame(data, schema), ev.default_caps(spark))
    judged = rules.evaluate_rules(capped, ev.valid_rules(ev.default_rules(spark)))
    return [(r["verdict"], r["failed_rules"], r["degraded"]) for r in judged.orderBy("n").collect()]


@pytest.mark.parametrize(
    "change,verdict,failed",
    [
        ({}, "ALLOW", []), ({"hour_ist": 9.99}, "ALLOW", []), ({"hour_ist": 10.0}, "DENY", ["NPCI-AUTOPAY-WINDOW"]),
        ({"hour_ist": 10.0, "rail": "card_emandate"}, "ALLOW", []), ({"hours_since_pdn": 23.99}, "DENY", ["RBI-EMANDATE-PDN-24H"]),
        ({"hours_since_pdn": 24.0}, "ALLOW", []), ({"pdn_sent_at": None, "hours_since_pdn": None}, "DENY", ["RBI-EMANDATE-PDN-24H"]),
        ({"amount_paise": 1_500_000}, "ALLOW", []), ({"amount_paise": 1_500_001}, "ESCALATE_HUMAN", ["RBI-EMANDATE-AFA-CAP"]),
        ({"amount_paise": 1_500_001, "mcc": "6300"}, "ALLOW", []), ({"amount_paise": 10_000_001, "mcc": "6300"}, "ESCALATE_HUMAN", ["RBI-EMANDATE-AFA-CAP"]),
        ({"mcc": None}, "ALLOW", []), ({"consent_withdrawn": True}, "DENY", ["DPDP-CONSENT-VALID"]),
        ({"consent_withdrawn": None}, "DENY", ["DPDP-CONSENT-VALID"]),
        ({"amount_paise": 2_000_000, "hour_ist": 11.0}, "DENY", ["NPCI-AUTOPAY-WINDOW", "RBI-EMANDATE-AFA-CAP"]),
    ],
)
def test_debit_rules(spark, change, verdict, failed):
    assert judge(spark, {**DEBIT, **change}) == [(verdict, failed, False)]


@pytest.mark.parametrize(
    "change,verdict",
    [
        ({}, "ALLOW"), ({"hour_ist": 7.99}, "DEFER"), ({"hour_ist": 8.0}, "ALLOW"), ({"hour_ist": 19.0}, "DEFER"),
        ({"dlt_template_id": None}, "DENY"), ({"dnd_registered": True}, "DENY"), ({"messages_30d": 3}, "DEFER"), ({"header_series": "140"}, "DENY"),
    ],
)
def test_message_rules(spark, change, verdict):
    assert judge(spark, {**SMS, **change})[0][0] == verdict


def test_cutoff_unknown_actions_and_versions(spark):
    got = judge(spark, NOTE, {**NOTE, "hour_ist": 23.84}, {**NOTE, "hour_ist": 23.84, "is_next_day_debit": False}, {"action_type": "fax", "as_of": dt.date(2026, 9, 1)})
    assert [g[0] for g in got] == ["ALLOW", "DENY", "ALLOW", "DENY"]
    assert got[3] == ("DENY", [], True)
    before_all = {**DEBIT, "as_of": dt.date(2020, 1, 1)}
    assert judge(spark, before_all) == [("DENY", [], True)]


def test_rule_table_is_validated(spark):
    base = ("R", 1, "X", "cited", dt.date(2026, 1, 1), ["sms"], None, "TRUE")
    data = [(*base, "MAYBE"), ("S", 1, "X", " ", dt.date(2026, 1, 1), ["sms"], None, "TRUE", "DENY"), ("T", 1, "X", "c", None, ["sms"], None, "TRUE", "DENY")]
    kept = ev.valid_rules(spark.createDataFrame(data, ev.schemas.RULES)).collect()
    assert [(r["rule_id"], r["on_fail"]) for r in kept] == [("R", "DENY")]


# ------------------------------------------------------------------ ledger

FIELDS = ["decision_id", "ts", "verdict", "amount_paise"]


@pytest.fixture(scope="module")
def decisions(spark):
    start = dt.datetime(2026, 1, 1)
    data = [(t, l, f"{t}{l}{i:02d}", start + dt.timedelta(hours=i), "ALLOW", 100 + i) for t in ("a", "b", "c") for l in (0, 1) for i in range(10)]
    df = spark.createDataFrame(data, "tenant_id string, lane int, decision_id string, ts timestamp, verdict string, amount_paise bigint")
    return ledger.with_payload(df.repartition(5), FIELDS).persist()


@pytest.fixture(scope="module")
def chained(decisions):
    return ledger.append_decisions(decisions, ["ts", "decision_id"]).persist()


def test_an_intact_chain_has_no_breaks(chained):
    assert ledger.verify_chain(chained).count() == 0
    assert [r["chain_seq"] for r in ledger.chain_heads(chained).collect()] == [9] * 6


@pytest.mark.parametrize("damage,reasons", [
    (lambda d: d.withColumn("payload", F.when(F.col("decision_id") == "a003", F.lit("{}")).otherwise(F.col("payload"))), {("a003", "hash mismatch")}),
    (lambda d: d.where("decision_id <> 'a003'"), {("a004", "sequence gap"), ("a004", "broken link")}),
    (lambda d: d.withColumn("record_hash", F.when(F.col("decision_id") == "a003", F.lit("0")).otherwise(F.col("record_hash"))),
     {("a003", "hash mismatch"), ("a004", "broken link")}),
    (lambda d: d.withColumn("prev_hash", F.when(F.col("decision_id") == "a000", F.lit("1")).otherwise(F.col("prev_hash"))),
     {("a000", "broken link"), ("a000", "hash mismatch")}),
])
def test_each_kind_of_damage_is_named(chained, damage, reasons):
    assert {(r["decision_id"], r["reason"]) for r in ledger.verify_chain(damage(chained)).collect()} == reasons


def test_verification_crosses_block_borders(chained, monkeypatch):
    monkeypatch.setattr(ledger, "SEQ_BLOCK", 3)
    assert ledger.verify_chain(chained).count() == 0
    lost = ledger.verify_chain(chained.where("decision_id <> 'b102'")).collect()
    assert {(r["decision_id"], r["reason"]) for r in lost} == {("b103", "sequence gap"), ("b103", "broken link")}


def test_a_chain_is_built_once_and_its_payload_is_not_shuffled(decisions, chained, monkeypatch):
    built = ledger.append_decisions(decisions.drop("payload"), ["ts", "decision_id"], fields=FIELDS)
    cols = ["decision_id", "payload", "chain_seq", "prev_hash", "record_hash"]
    assert sorted(map(tuple, built.select(cols).collect())) == sorted(map(tuple, chained.select(cols).collect()))
    plan = ledger.verify_chain(built)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    monkeypatch.setattr(ledger, "SEQ_BLOCK", 2)  # whole blocks are lost, and one record of a block is both its ends
    lost = ledger.verify_chain(chained.where("NOT (decision_id LIKE 'a0%' AND chain_seq IN (1, 2, 3, 4, 6))")).collect()
    assert {(r["decision_id"], r["reason"], r["expected"]) for r in lost if r["reason"] == "sequence gap"} == {
        ("a005", "sequence gap", "1"), ("a007", "sequence gap", "6")}


def test_segments_count_their_records_over_all_levels(chained):
    roots = ledger.merkle_roots(chained, ledger.KEYS, "chain_seq", "record_hash", 10, fan_in=3)
    assert [r["records"] for r in roots.collect()] == [10] * 6


def test_batches_extend_the_same_chain(spark, decisions, chained):
    cut = F.lit(dt.datetime(2026, 1, 1, 4))
    first = ledger.append_decisions(decisions.where(F.col("ts") < cut), ["ts", "decision_id"])
    second = ledger.append_decisions(decisions.where(F.col("ts") >= cut), ["ts", "decision_id"], ledger.chain_heads(first))
    cols = ["decision_id", "chain_seq", "record_hash"]
    assert sorted(map(tuple, first.unionByName(second).select(cols).collect())) == sorted(map(tuple, chained.select(cols).collect()))


def test_snapshots_and_months(spark, tmp_path, chained):
    root = str(tmp_path)
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int, at int")
    first = lambda: sinks.upsert_snapshot(rows(("a", 1, 1), ("b", 1, 1)), f"{root}/p", 0, ["k"], ["at"])
    second = lambda v: sinks.upsert_snapshot(rows(("a", 2, 2), ("c", 1, 2), ("b", 9, 0)), f"{root}/p", v, ["k"], ["at"])
    for step in (first, first, lambda: second(1), lambda: second(1)):  # a retried batch changes nothing
        step()
    with pytest.raises(RuntimeError):  # starting anew beside later snapshots would fork the state
        first()
    with pytest.raises(AnalysisException):  # a lost snapshot is no empty one
        second(5)
    got = sorted(map(tuple, sinks.read_snapshot(spark, f"{root}/p", 1).select("k", "v").collect()))
    assert got == [("a", 2), ("b", 1), ("c", 1)]
    sinks.write_decisions(chained, f"{root}/d")
    assert spark.read.parquet(f"{root}/d").where("month = '2026-01'").count() == chained.count()
    sinks.write_alerts(spark.createDataFrame([("lag", 1.0, True)], "metric string, value double, breached boolean"), f"{root}/a")
    assert spark.read.parquet(f"{root}/a").count() == 1


# ------------------------------------------------------------------ privacy, replies, reconciliation


def test_pseudonyms_need_a_pepper_and_are_tenant_scoped(spark):
    with pytest.raises(ValueError):
        privacy.pepper_of(spark)
    df = spark.createDataFrame([("a", "1"), ("b", "1")], "t string, c string")
    one = [r[0] for r in df.select(privacy.pseudonymise(F.col("t"), F.col("c"), b"p")).collect()]
    two = [r[0] for r in df.select(privacy.pseudonymise(F.col("t"), F.col("c"), b"q")).collect()]
    assert len({*one, *two}) == 4 and all(x.startswith("anon_") and len(x) == 37 for x in one)


def test_redaction(spark):
    df = spark.createDataFrame(
        [("call +91-9876543210 or 9876543210, card 4111111111111111, a.b@c.co.in; ref 12345", "x", None)], "note string, card_number string, email string"
    )
    row = privacy.redact(df).first()
    assert row["note"] == "call +91-[REDACTED] or [REDACTED], card [REDACTED], [REDACTED]; ref 12345"
    assert row["card_number"] == "[REDACTED]" and row["email"] is None


@pytest.mark.parametrize("payload,rejection", [
    ('{"intent":"none","confidence":1}', None), ('{"intent":"none","confidence":0.5,"declared_funding_day":null,"language":null}', None),
    ('{"intent":"none","confidence":true}', "confidence: expected a number"), ('{"intent":"none","confidence":0.5,"x":1}', "unexpected keys"),
    ('{"intent":"refund","confidence":0.5}', "intent: unknown"), ('{"intent":"none","confidence":0.5,"declared_funding_day":32}', "declared_funding_day: out of range"),
    ('{"intent":"none","confidence":0.5,"declared_funding_day":"3"}', "declared_funding_day: expected an integer"), ("nope", "expected an object"),
    ('{"intent":"none","confidence":-0.1}', "confidence: out of range"), ('{"confidence":1}', "missing required keys"),
    ('{"intent":null,"confidence":1}', "intent: expected a string"),
])
def test_reply_schema(spark, payload, rejection):
    row = replies.validate_replies(spark.createDataFrame([(payload,)], "payload string")).first()
    assert row["rejection"] == rejection
    assert (row["intent"] is None) == (rejection is not None) == row["needs_human"]


def test_reconciliation(spark):
    ours = spark.createDataFrame([("a", "ambiguous", None), ("b", "ambiguous", None), ("c", "ambiguous", None), ("d", "fired", None)], "idem_key string, state string, decline_code string")
    theirs = spark.createDataFrame([("b", "accepted", None), ("c", "ambiguous", None), ("e", "accepted", None)], "idem_key string, outcome string, decline_code string")
    got = {r["idem_key"]: (r["state"], r["decline_code"], r["discrepancy"]) for r in reconcile.reconcile_by_key(ours, theirs).collect()}
    assert got == {
        "a": ("failed", "reconciled_not_charged", None), "b": ("fired", None, None), "c": ("ambiguous", None, None),
        "d": ("fired", None, "fired but unknown to provider"), "e": (None, None, "unknown at our side"),
    }


@pytest.mark.parametrize("lanes", [1, 16])
def test_a_register_names_what_is_gone(spark, lanes):
    rows = [("t", n % lanes, f"d{n}", n, "ALLOW") for n in range(160)] + [("u", 0, f"e{n}", n, "DENY") for n in range(5)]
    made = spark.createDataFrame(rows, "tenant_id string, lane bigint, decision_id string, n bigint, verdict string")
    built = ledger.append_decisions(ledger.with_payload(made, ["decision_id", "verdict"]), ["n"]).cache()
    register = ledger.chain_register(built, 8).cache()
    found = lambda df: sorted((r["tenant_id"], r["lane"], r["reason"], r["from_seq"], r["to_seq"]) for r in ledger.verify_register(df, register, 8).collect())
    assert found(built) == []
    last = 160 // lanes - 1
    assert found(built.where("tenant_id = 't'")) == [("u", 0, "lost chain", 0, 4)]
    cut = built.where(f"NOT (tenant_id = 't' AND lane = 0 AND chain_seq >= {last})")
    assert ("t", 0, "cut tail", last, last) in found(cut)
    assert ledger.verify_chain(cut).count() == 0  # no gap is left behind
    edited = built.withColumn("record_hash", F.when((F.col("tenant_id") == "u") & (F.col("chain_seq") == 1), F.repeat(F.lit("f"), F.lit(64))).otherwise(F.col("record_hash")))
    assert found(edited) == [("u", 0, "changed segment", 0, 4)]
    more = built.unionByName(built.where("tenant_id = 'u'").withColumn("lane", F.lit(7).cast("bigint")))
    assert found(more) == [("u", 7, "unknown chain", None, None)]
    grown = built.unionByName(built.where("tenant_id = 'u' AND chain_seq = 4").withColumn("chain_seq", F.lit(5).cast("bigint")))
    assert found(grown) == []


def test_merkle_root_of_many_levels(spark):
    import hashlib

    hashes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(30)]
    df = spark.createDataFrame([("k", i, h) for i, h in enumerate(hashes)], "k string, at bigint, h string")
    level = hashes
    while len(level) > 1:
        level = [hashlib.sha256("|".join(level[i : i + 3]).encode()).hexdigest() for i in range(0, len(level), 3)]
    assert ledger.merkle_roots(df, ["k"], "at", "h", 30, fan_in=3).first()["root"] == level[0]


@pytest.mark.parametrize("predicate,verdict", [
    ("hour_ist > -1", "ALLOW"), ("messages_30d + 1 <= tenant_fatigue_cap", "ALLOW"), ("dlt_template_id LIKE 't%'", "ALLOW"),
    ("dlt_template_id LIKE 'x%'", "DENY"), ("amount_paise * 9223372036854775807 * 2 > 0", "DENY"), ("hour_ist / 0 > 1", "DENY"),
    ("CASE WHEN dnd_registered THEN FALSE WHEN hour_ist BETWEEN 9 AND 18 THEN TRUE ELSE FALSE END", "ALLOW"), ("messages_30d IN (1, 2)", "ALLOW"),
    ("amount_paise > '99999999999999999999'", "DENY"), ("header_series = 160", "DENY"), ("java_method('java.lang.System', 'exit')", "DENY"),
    ("nonsense >", "DENY"), ("other_column > 1", "DENY"), ("amount_paise", "DENY"), (" ", "DENY"),
])
def test_one_predicate_never_stops_the_job(spark, predicate, verdict):
    row = ("R", 1, "X", "cited", dt.date(2026, 1, 1), ["sms"], None, predicate, "DENY")
    table = spark.createDataFrame([row], ev.schemas.RULES)
    schema = "n int, " + ", ".join(f"{k} {t}" for k, t in TYPES.items())
    action = spark.createDataFrame([(0, *[SMS.get(k) for k in TYPES])], schema)
    assert rules.evaluate_rules(action, table).first()["verdict"] == verdict
    refused = [r["reason"] for r in rules.refused_rules(table).collect()]
    assert bool(refused) == (not rules.admitted(spark, predicate))
    if predicate.startswith("amount_paise > '"):
        assert refused == ["compares text with something else"]


def test_a_busy_month_is_written_by_as_many_tasks_as_its_size_asks(spark, tmp_path):
    rows = spark.range(0, 200_000, 1, 32).select(  # a month is split by the tasks that wrote it
        F.sha2(F.col("id").cast("string"), 256).alias("decision_id"),
        F.expr("if(id % 50 = 0, timestamp'2024-04-05', timestamp'2024-03-05')").alias("ts"),
    )
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        sinks.write_decisions(rows, f"{tmp_path}/d")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    back = spark.read.parquet(f"{tmp_path}/d")
    assert back.groupBy("month").count().orderBy("month").collect() == [("2024-03", 196_000), ("2024-04", 4_000)]
    assert len(list((tmp_path / "d" / "month=2024-03").glob("*.parquet"))) > 8
