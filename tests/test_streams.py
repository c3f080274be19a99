"""Streams over split, shuffled and repeated files give the batch answer."""

import datetime as dt
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from redebit.operators import ledger, projection
from redebit.plans import catalog
from redebit.sources import sinks
from redebit.sources import testdata as td
from redebit.streaming import jobs, run

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """The event log in eight files, events in random files and a fifth delivered twice."""
    root = str(tmp_path_factory.mktemp("events") / "log")
    events = td.payment_events(spark, SF)
    again = events.where("event_id % 5 = 0")
    shuffled = events.unionByName(again).orderBy(F.rand(seed=3))
    shuffled.repartition(8).write.parquet(root)
    return root, events


def stream(spark, files):
    root, events = files
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(root)


def same(a, b):
    cols = sorted(a.columns)
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


def test_projection_converges(spark, files):
    keys = ["mandate_id", "cycle_ref"]
    rows, _ = run.drain(jobs.stream_projection(stream(spark, files), keys=keys), "update")
    assert rows.select("batch_id").distinct().count() > 1
    same(run.latest(rows, keys), projection.project_cycles(files[1], keys))


def test_mandate_state_converges(spark, files):
    rows, _ = run.drain(jobs.mandate_state(stream(spark, files), delay="60 days"), "update")
    same(run.latest(rows, ["mandate_id"]), projection.mandate_state(files[1]))


def test_a_mandate_is_a_short_list_before_it_is_segments(spark, files):
    rows, _ = run.drain(jobs.mandate_state(stream(spark, files), delay="60 days", flat_events=3), "update")
    same(run.latest(rows, ["mandate_id"]), projection.mandate_state(files[1]))


def test_repeated_deliveries_are_dropped(spark, files):
    rows, _ = run.drain(jobs.dedupe_stream(stream(spark, files), "60 days").select("event_id"), "append")
    same(rows.select("event_id"), files[1].select("event_id"))


def test_ledger_grows_by_micro_batches(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    decisions = td.gate_decisions(spark, SF)
    decisions.repartition(6).write.parquet(source)
    arriving = spark.readStream.schema(decisions.schema).option("maxFilesPerTrigger", 2).parquet(source)
    writer = jobs.ledger_appender(root, ["decision_id", "ts", "verdict"], ["ts", "decision_id"])
    run.drain(arriving, "append", writer)
    built = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/ledger")
    assert built.count() == decisions.count()
    assert ledger.verify_chain(built).count() == 0


def test_priors_are_upserted_per_batch(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(20).select((F.col("id") % 4).alias("k"), F.col("id").alias("version")).repartition(4).write.parquet(source)
    schema = spark.read.parquet(source).schema
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    run.drain(arriving, "append", jobs.priors_writer(root, ["k"], ["version"]))
    final = sinks.read_snapshot(spark, root, 3)
    assert sorted(map(tuple, final.collect())) == [(0, 16), (1, 17), (2, 18), (3, 19)]


def test_lag_alert(spark):
    now = F.lit("2026-01-01 00:01:00").cast("timestamp")
    df = spark.createDataFrame([("2026-01-01 00:00:20",), ("2026-01-01 00:00:50",)], "t string").select(F.col("t").cast("timestamp").alias("received_at"))
    row = jobs.lag_monitor(df, now).first()
    assert (row["pending"], row["value"], row["breached"]) == (2, 40, True)
    assert jobs.lag_monitor(df.where("FALSE"), now).first()["breached"] is False
    progress = {"timestamp": "2026-01-01T00:01:00.000Z", "numInputRows": 5, "eventTime": {"max": "2026-01-01T00:00:10.000Z", "watermark": "2026-01-01T00:00:00.000Z"}}
    assert jobs.progress_lag(progress) == {"rows": 5, "value": 50.0, "breached": True}


# ------------------------------------------------------------------ bounded state

EVENT = "tenant_id string, cycle_ref string, event_id bigint, event_type string, occurred_at timestamp, received_at timestamp, amount_paise bigint, deadline_at timestamp"
START = dt.datetime(2026, 1, 1)


def cycle_log(seed=5, cycles=60, months=12):
    """Events in order of receipt: retries, captures long after the deadline, re-deliveries, missing deadlines."""
    rng, rows, number = random.Random(seed), [], 0
    for c in range(cycles):
        due = START + dt.timedelta(days=rng.randrange(30 * months), hours=rng.randrange(24))
        deadline = due + dt.timedelta(days=30)
        kinds = [("payment.failed", d) for d in sorted(rng.sample(range(0, 25), rng.randrange(0, 4)))]
        if rng.random() < 0.5:
            kinds.append(("payment.captured", rng.choice([2, 20, 45, 90, 150])))
        for kind, day in kinds or [("payment.captured", 1)]:
            number += 1
            at = due + dt.timedelta(days=day)
            known = None if rng.random() < 0.2 else deadline + dt.timedelta(days=rng.choice([0, 0, 5]))
            row = (f"t{c % 2}", f"c{c}", number, kind, at, at + dt.timedelta(hours=rng.randrange(48)), rng.choice([0, 49_900]), known)
            rows.append(row)
            if rng.random() < 0.4:
                rows.append((*row[:5], row[5] + dt.timedelta(days=rng.choice([0, 3, 100])), *row[6:]))
    return sorted(rows, key=lambda r: r[5])


def arriving(spark, folder, rows, schema, files):
    """One file per micro-batch, in the order of ``rows``."""
    os.makedirs(folder)
    names = [x.split()[0] for x in schema.split(", ")]
    frame = spark.createDataFrame(rows, schema)
    kinds = frame.schema
    size = -(-len(rows) // files)
    for i in range(files):
        own = pd.DataFrame(rows[i * size : (i + 1) * size], columns=names)
        for name in ("occurred_at", "received_at", "deadline_at", "sent_at"):
            if name in own:
                own[name] = pd.to_datetime(own[name]).astype("datetime64[us]")
        own.to_parquet(f"{folder}/{i:04d}.parquet", coerce_timestamps="us")
        os.utime(f"{folder}/{i:04d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(folder), frame


def state_rows(stream, mode, writer, checkpoint):
    """Runs the stream to its end; rows in state after each micro-batch."""
    query = stream.writeStream.outputMode(mode).foreachBatch(writer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]


def test_evicted_cycles_find_their_events_again(spark, tmp_path):
    rows = cycle_log()
    stream, frame = arriving(spark, str(tmp_path / "in"), rows, EVENT, 12)
    changes = jobs.cycle_changes(stream, clock="received_at", delay="1 hour", grace_days=10)
    root = str(tmp_path / "table")
    sizes = state_rows(changes, "update", jobs.projection_store(root, buckets=4, compact_every=5), str(tmp_path / "checkpoint"))
    want = projection.project_cycles(frame).where("TRUE")
    got = jobs.projected_table(spark, root, compact_every=5).where("deadline_at IS NOT NULL")
    same(got, want)
    # A cycle is held for its month and the grace, out of twelve; keys, values and timers count.
    assert max(sizes) < 0.75 * 3 * 60 and sizes[-1] < max(sizes)


def test_sessions_come_out_as_they_change(spark, tmp_path):
    rng, rows = random.Random(3), []
    for i in range(300):
        at = START + dt.timedelta(hours=rng.randrange(24 * 60))
        rows.append((i % 3, f"c{i % 17}", rng.choice(["payment.failed", "payment.captured", "subscription.paused"]), at))
    rows.sort(key=lambda r: r[3] + dt.timedelta(days=rng.randrange(7)))  # disorder within the delay
    stream, frame = arriving(spark, str(tmp_path / "in"), rows, "mandate_id bigint, cycle_ref string, event_type string, occurred_at timestamp", 10)
    written, sizes = [], []

    def write(batch, batch_id):
        written.append(batch.withColumn("batch_id", F.lit(batch_id)).toPandas())

    sizes = state_rows(jobs.retry_sessions(stream, delay="8 days"), "update", write, str(tmp_path / "checkpoint"))
    changes = pd.concat(written)
    assert changes["absorbed"].any()
    latest = changes.sort_values("batch_id").drop_duplicates(["mandate_id", "cycle_ref", "started_at"], keep="last")
    columns = ["mandate_id", "cycle_ref", "started_at", "closed_at", "failures", "successes"]
    got = sorted(map(tuple, latest[~latest["absorbed"]][columns].itertuples(index=False)))
    want = sorted(map(tuple, projection.retry_sessions(frame).select(columns).toPandas().itertuples(index=False)))
    assert got == want
    assert all(len(w) < len(want) for w in written[1:])


def test_message_panes_equal_sliding_windows(spark, tmp_path):
    rng = random.Random(6)
    rows = sorted(((rng.randrange(5), START + dt.timedelta(minutes=rng.randrange(60 * 24 * 120))) for _ in range(250)), key=lambda r: r[1])
    stream, frame = arriving(spark, str(tmp_path / "in"), rows, "customer_id bigint, sent_at timestamp", 8)
    want = frame.groupBy("customer_id", F.window("sent_at", "30 days", "1 day").alias("w")).agg(F.count("*").alias("messages_30d")).select(
        "customer_id", F.col("w.end").alias("as_of"), "messages_30d")
    same(jobs.trailing_messages(frame), want)
    written, _ = run.drain(jobs.trailing_messages(stream), "update")
    same(run.latest(written, ["customer_id", "as_of"]), want)


def test_detector_follows_closed_windows(spark, tmp_path):
    from redebit.operators import issuers

    rng, rows = random.Random(8), []
    for w in range(48):
        for i in range(2):
            down = i == 1 and 20 <= w < 30
            rows += [(f"i{i}", START + dt.timedelta(minutes=5 * w, seconds=9 * a), rng.random() < (0.1 if down else 0.85)) for a in range(30)]
    rows.sort(key=lambda r: r[1])
    schema = "issuer string, sent_at timestamp, success boolean"
    stream, frame = arriving(spark, str(tmp_path / "in"), rows, schema, 6)
    named = lambda df: df.withColumnRenamed("sent_at", "at")
    written, _ = run.drain(jobs.issuer_detector(named(stream), 0.82), "append")
    batch = issuers.issuer_cusum(issuers.issuer_windows(named(frame)), F.lit(0.82))
    last = START.replace(tzinfo=dt.timezone.utc).timestamp() + 300 * 47 + 9 * 29 - 600
    rounded = lambda df: df.withColumn("cusum", F.round("cusum", 9)).withColumn("outage_minutes", F.round("outage_minutes", 9))
    same(rounded(written.drop("batch_id")), rounded(batch.where(F.col("start_s") + 300 <= last)))
    assert {r["issuer"] for r in written.where("degraded_since_s >= 0").collect()} == {"i1"}


def test_detector_query_has_a_state_for_every_window(spark, tmp_path):
    from redebit.plans import catalog

    rng, rows = random.Random(21), []
    for n in range(400):  # user 3 stops early: its last window is closed, that of user 1 is open
        user = 1 + 2 * (n % 2) if n < 300 else 1
        rows.append((n, START + dt.timedelta(hours=n), rng.choice(["purchase", "error", "error"]), user, 1.0, '{"k": 1}'))
    columns = ["event_id", "ts", "event_type", "user_id", "value", "props"]
    pd.DataFrame(rows, columns=columns).astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet", index=False)
    read = lambda name: catalog.QUERIES[name](spark, str(tmp_path))
    got = read("stream_issuer_detector")
    want = read("issuer_cusum").select(*got.columns)
    same(got, want)
    assert got.select("issuer").distinct().count() == 2 and got.count() == read("issuer_windows").count()


def test_mandate_segments_compose_like_the_fold(spark, tmp_path):
    rng, rows = random.Random(12), []
    kinds = list(projection.MANDATE_EVENT_STATE)
    for n in range(400):
        at = START + dt.timedelta(minutes=rng.choice([n * 30, n * 30, n * 30 + rng.randrange(3)]))
        rows.append((n % 3, n, rng.choice(kinds), at))
    rows.sort(key=lambda r: r[3] + dt.timedelta(hours=rng.randrange(20)))  # late by less than the delay
    rows += rows[-5:]
    stream, frame = arriving(spark, str(tmp_path / "in"), rows, "mandate_id bigint, event_id bigint, event_type string, occurred_at timestamp", 9)
    written = []

    def write(batch, batch_id):
        written.append(batch.withColumn("batch_id", F.lit(batch_id)).toPandas())

    sizes = state_rows(jobs.mandate_state(stream, delay="1 day"), "update", write, str(tmp_path / "checkpoint"))
    changes = pd.concat(written).sort_values("batch_id").drop_duplicates("mandate_id", keep="last")
    got = sorted(map(tuple, changes[["mandate_id", "state", "stale_transitions"]].itertuples(index=False)))
    want = sorted(map(tuple, projection.mandate_state(frame.dropDuplicates()).select("mandate_id", "state", "stale_transitions").toPandas().itertuples(index=False)))
    assert got == want
    assert max(sizes[3:]) < 0.7 * len(rows)  # only what the watermark has not passed


def test_late_capture_guard_projects_the_log_once(spark, monkeypatch):
    guard, sources = jobs.late_capture_guard, []
    monkeypatch.setattr(jobs, "late_capture_guard", lambda actions, out: sources.extend(actions.inputFiles()) or guard(actions, out))
    states = {r.state for r in catalog.QUERIES["stream_late_capture_guard"](spark, SF).collect()}
    assert states == {"cancelled"} and not sources  # batches read stored actions, not the log again
