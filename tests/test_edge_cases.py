"""Cases the supplied tables do not hold: NULL keys, several deadlines, re-deliveries, hostile rules, NULL values."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from redebit.operators import monitor, ordered, projection, rules, running_quantile
from redebit.sources import events as ev
from redebit.streaming import jobs, run

T0 = dt.datetime(2024, 1, 1)
EVENT = (
    "event_id long, event_type string, occurred_at timestamp, tenant_id string, mandate_id long, customer_id long, "
    "rail string, mcc string, cycle_ref string, amount_paise long, deadline_at timestamp"
)


def event(i, kind, hour, cycle, mcc="6012", deadline=None):
    at = T0 + dt.timedelta(hours=hour)
    return (i, kind, at, "t1", 1, 1, "enach", mcc, cycle, 500, deadline and T0 + dt.timedelta(days=deadline))


EVENTS = [
    # one deadline on the first event only; the attribute missing on others; the capture delivered three times
    event(1, "payment.failed", 1, "a", deadline=30), event(2, "payment.captured", 5, "a", mcc=None), *[event(2, "payment.captured", 5, "a", mcc=None)] * 2,
    # two deadlines: the first in order counts
    event(3, "payment.failed", 1, "b", deadline=20), event(4, "payment.failed", 9, "b", deadline=25), *[event(4, "payment.failed", 9, "b", deadline=25)] * 2,
    # a deadline that comes late, and none at all
    event(5, "payment.failed", 1, "c"), event(6, "subscription.charged", 3, "c", deadline=9), event(7, "payment.failed", 1, "d"),
]
WANT = {("a", "succeeded", 1, 30), ("b", "executing", 2, 20), ("c", "succeeded", 1, 9)}


def facts(df):
    rows = df.where("deadline_at IS NOT NULL").collect()
    return {(r.cycle_ref, r.state, r.attempts_used, (r.deadline_at - T0).days) for r in rows}


def test_a_cycle_is_one_row_whatever_its_events_lack(spark):
    cycles = projection.project_cycles(spark.createDataFrame(EVENTS, EVENT))
    assert facts(cycles) == WANT and cycles.where("mcc = '6012'").count() == 3


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch_on_odd_events(spark, tmp_path, seed):
    shuffled = random.Random(seed).sample(EVENTS, len(EVENTS))
    path = str(tmp_path / "log")
    for k in range(0, len(shuffled), 3):
        spark.createDataFrame(shuffled[k : k + 3], EVENT).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.createDataFrame([], EVENT).schema).option("maxFilesPerTrigger", 1).parquet(path)
    rows, _ = run.drain(jobs.stream_projection(stream), "update")
    assert rows.select("batch_id").distinct().count() > 2
    assert facts(run.latest(rows, projection.CYCLE_KEYS)) == WANT


def test_null_keys_and_instants_stay_in_ordered_results(spark):
    rows = [(1, 1, T0), (2, None, T0), (3, None, T0 + dt.timedelta(days=90)), (4, 1, None), (5, 1, T0 + dt.timedelta(days=40))]
    df = spark.createDataFrame(rows, "id long, k long, at timestamp")
    block = ordered.time_block(F.col("at"))
    window = Window.partitionBy("k").orderBy("at", "id")
    want = sorted(tuple(r) for r in df.select("id", F.row_number().over(window), F.lag("id").over(window)).collect())
    numbered = ordered.numbered(df, ["k"], ["at", "id"], block, "n")
    both = ordered.with_previous(numbered, ["k"], ["at", "id"], block, ["id"])
    assert sorted(tuple(r) for r in both.select("id", "n", "prev_id").collect()) == want


def test_percentiles_of_hot_keys_equal_those_of_others(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i % 3 or None, i, T0 + dt.timedelta(days=rng.randrange(200)), rng.randint(-50, 50) if i % 7 else None) for i in range(150)]
    df = spark.createDataFrame(rows, "k long, id long, at timestamp, v long")
    args = (["k"], ["at", "id"], ordered.time_block(F.col("at")), {"p": (F.col("v"), 0.75)})
    plain = sorted(map(str, running_quantile.running_percentiles(df, *args).select("id", "p").collect()))
    monkeypatch.setattr(running_quantile, "HOT_ROWS", 10)
    assert sorted(map(str, running_quantile.running_percentiles(df, *args).select("id", "p").collect())) == plain


def test_psi_leaves_missing_values_out(spark):
    rng = np.random.default_rng(1)
    make = lambda mean: [("f", float(x)) for x in rng.normal(mean, 1, 400)]
    ref, cur = make(0), make(1)
    missing = [("f", None)] * 400 + [("f", float("nan"))] * 50
    frame = lambda rows: spark.createDataFrame(rows, "feature string, value double")
    score = lambda a, b: monitor.psi(frame(a), frame(b)).first().psi
    assert score(ref + missing, cur) == pytest.approx(score(ref, cur))
    assert score(ref, cur + missing) == pytest.approx(score(ref, cur))


@pytest.mark.parametrize("predicate,good", [
    ("amount_paise <= afa_free_cap", True), ("hour_ist BETWEEN 8 AND 19 AND consent_ref IS NOT NULL", True),
    ("coalesce(dnd_registered, false) OR lower(header_series) = '160'", True), ("try_divide(amount_paise, 0) > 1", True),
    ("reflect('java.lang.System', 'getProperty', 'user.home') IS NOT NULL", False), ("amount_paise / 0 > 1", False),
    ("unknown_column > 1", False), ("amount_paise >", False), ("CAST(consent_ref AS INT) > 0", False), ("exists(SELECT 1)", False), ("", False),
    ("consent_ref > 5", False), ("amount_paise", False), ("hours_since_pdn >= 24 AND amount_paise < 5", True),
])
def test_only_admitted_predicates_run(spark, predicate, good):
    assert rules.admitted(spark, predicate) is good


def test_a_bad_rule_fails_alone(spark):
    base = ev.default_rules(spark)
    bad = base.limit(1).withColumn("rule_id", F.lit("BAD")).withColumn("predicate", F.lit("amount_paise / 0 > 1")).withColumn("rails", F.lit(None).cast("array<string>"))
    action = spark.createDataFrame(
        [("debit_attempt", "upi_autopay", dt.date(2026, 9, 1), 1000)], "action_type string, rail string, as_of date, amount_paise long"
    )
    got = rules.evaluate_rules(action, base.unionByName(bad)).first()
    assert "BAD" in got.failed_rules and got.verdict == "DENY"
