import datetime as dt

import pytest
from pyspark.sql import functions as F

from redebit.functions import calendar as cal
from redebit.operators import legality
from tests.helpers import IST, at


def frame(spark, texts, rail="upi_autopay"):
    return spark.createDataFrame([(t, rail, at(t, IST)) for t in texts], "label string, rail string, ts timestamp")


@pytest.mark.parametrize(
    "label,band,legal",
    [
        ("2026-06-01 09:59:59", 0, True), ("2026-06-01 10:00:00", 1, False), ("2026-06-01 12:59:00", 1, False),
        ("2026-06-01 13:00:00", 2, True), ("2026-06-01 16:59:00", 2, True), ("2026-06-01 17:00:00", 3, False),
        ("2026-06-01 21:29:00", 3, False), ("2026-06-01 21:30:00", 4, True), ("2026-06-01 00:00:00", 0, True),
    ],
)
def test_hour_band_and_upi_window_edges(spark, label, band, legal):
    row = frame(spark, [label]).select(
        cal.hour_band(F.col("ts")).alias("b"), cal.is_execution_legal(F.col("rail"), F.col("ts")).alias("ok")
    ).first()
    assert (row["b"], row["ok"]) == (band, legal)


@pytest.mark.parametrize("paise,band", [(0, 0), (99_999, 0), (100_000, 1), (499_999, 1), (500_000, 2), (1_500_000, 3), (10_000_000, 4)])
def test_ticket_band_edges(spark, paise, band):
    assert spark.range(1).select(cal.ticket_band(F.lit(paise))).first()[0] == band


def test_band_of_null_stays_null(spark):
    assert spark.range(1).select(cal.ticket_band(F.lit(None).cast("bigint"))).first()[0] is None


def test_batch_rail_skips_weekends(spark):
    start = dt.datetime(2026, 6, 1)
    days = [(start + dt.timedelta(days=d, hours=3)).isoformat(" ") for d in range(14)]
    found = {
        r["ts"]: r for r in frame(spark, days, "enach").select(
            "ts", cal.is_execution_legal(F.col("rail"), F.col("ts")).alias("ok"),
            cal.outcome_due_at(F.col("rail"), F.col("ts")).alias("due"),
        ).collect()
    }
    for ts, row in found.items():
        local = ts.replace(tzinfo=dt.timezone.utc).astimezone(IST)
        assert row["ok"] == (local.weekday() < 5 and local.hour < 13)
        due = local + dt.timedelta(days=1)
        while due.weekday() >= 5:
            due += dt.timedelta(days=1)
        assert row["due"] == due.astimezone(dt.timezone.utc).replace(tzinfo=None)


@pytest.mark.parametrize(
    "send,debit,legal",
    [
        ("2026-06-01 23:49:00", "2026-06-02 12:00:00", True), ("2026-06-01 23:50:00", "2026-06-02 12:00:00", False),
        ("2026-06-01 23:55:00", "2026-06-03 12:00:00", True),
    ],
)
def test_notice_cutoff(spark, send, debit, legal):
    df = spark.createDataFrame([(at(send, IST), at(debit, IST))], "s timestamp, d timestamp")
    assert df.select(cal.is_pdn_send_legal(F.lit("upi_autopay"), F.col("s"), F.col("d"))).first()[0] is legal
    assert df.select(cal.is_pdn_send_legal(F.lit("card_emandate"), F.col("s"), F.col("d"))).first()[0] is True


def test_results_do_not_depend_on_the_session_zone(spark):
    df = frame(spark, ["2026-06-01 09:30:00"])
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        shifted = spark.createDataFrame(df.select(F.unix_seconds("ts").alias("s")).collect()).select(
            cal.minute_of_day(F.timestamp_seconds("s"))
        ).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert shifted == df.select(cal.minute_of_day(F.col("ts"))).first()[0] == 9 * 60 + 30


def test_notice_feasibility_equals_the_search(spark):
    starts = [dt.datetime(2026, 6, 1) + dt.timedelta(minutes=37 * i) for i in range(40)]
    df = spark.createDataFrame([(s,) for s in starts], "d timestamp").select("d", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("slot"))
    got = {(r["d"], r["slot"]): r["ok"] for r in df.select("d", "slot", legality.notice_feasible(F.col("d"), F.col("slot")).alias("ok")).collect()}
    for (d, slot), ok in got.items():
        def contact(h):
            local = (d + dt.timedelta(hours=h)).replace(tzinfo=dt.timezone.utc).astimezone(IST)
            return 8 * 60 <= local.hour * 60 + local.minute < 19 * 60
        want = any(contact(h) for h in range(max(0, slot - 96), slot - 24 + 1)) if slot >= 24 else False
        assert ok == want, (d, slot)


def test_plan_notice_prefers_the_latest_or_the_nearest(spark):
    d, debit = at("2026-06-01 09:00:00", IST), at("2026-06-05 15:00:00", IST)
    df = spark.createDataFrame(
        [(1, d, debit, None, 0), (2, d, debit, at("2026-06-02 12:20:00", IST), 0), (3, d, debit, None, 3)],
        "id int, decided_at timestamp, debit_at timestamp, predicted_funding_at timestamp, messages_30d int",
    )
    got = {r["id"]: r for r in legality.plan_notice(df).collect()}
    assert got[1]["hours_of_notice"] == 24 and got[1]["send_at"] == debit - dt.timedelta(hours=24)
    assert got[2]["send_at"] == at("2026-06-02 12:00:00", IST)
    assert got[3]["send_at"] is None and got[3]["suppressed_reason"] == "fatigue cap reached"
