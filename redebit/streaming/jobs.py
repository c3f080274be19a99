"""The operators as Structured Streaming jobs.

What built-in stateful operators can express with bounded state stays in the JVM. Folds that
depend on order (mandate state, issuer detector) or must end with their key (cycles, sessions,
message panes) keep small keyed state through ``transformWithState`` and its pandas form, and timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from redebit.operators import issuers, ledger, ordered, projection
from redebit.sources import sinks

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(df: DataFrame) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return df


def dedupe_stream(events: DataFrame, delay: str = "1 day", at: str = "occurred_at") -> DataFrame:
    """Drop re-deliveries; an id is remembered until the watermark passes it."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(["event_id"])


MICROS_PER_MS = 1000
EVENT_FIELDS = ("us", "id", "failed", "paid", "amount", "deadline")
CYCLE_EVENT = "struct<us: bigint, id: {0}, failed: boolean, paid: boolean, amount: bigint, deadline: bigint>"
CYCLE_ROW = Row(*EVENT_FIELDS)


class CycleEvents(StatefulProcessor):
    """The distinct events of a cycle until its deadline and a grace have passed.

    A cycle that comes without state and may have been evicted is marked ``stored``: what the
    stored table knows of it has to be added. The mark stays as long as the state does.
    """

    def __init__(self, keys: list[str], event: str, grace_ms: int) -> None:
        self.keys, self.event, self.grace_ms = keys, event, grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("cycle", f"events array<{self.event}>, expires bigint, stored boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.state.exists()
        events, before, stored = self.state.get() if known else ([], None, False)
        held = {e[1]: tuple(e) for e in events}
        size = len(held)
        for row in rows:
            e = tuple(row[name] for name in EVENT_FIELDS)
            held.setdefault(e[1], e)
        if known and len(held) == size:
            return  # re-deliveries only
        deadlines = [(e[0], e[1], e[5]) for e in held.values() if e[5] is not None]
        end = min(deadlines)[2] if deadlines else max(e[0] for e in held.values())
        expires = end // MICROS_PER_MS + self.grace_ms
        now = timerValues.getCurrentWatermarkInMs()
        stored = stored or not known and (not deadlines or expires <= now)
        if expires > now:
            if before is not None and before != expires:
                self.handle.deleteTimer(before)
            if before != expires:
                self.handle.registerTimer(expires)
            self.state.update((list(held.values()), expires, stored))
        elif known:
            self.handle.deleteTimer(before)
            self.state.clear()
        yield Row(*self.keys, "events", "stored")(*key, [CYCLE_ROW(*e) for e in held.values()], stored)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def cycle_changes(events: DataFrame, clock: str = "occurred_at", delay: str = "30 days", grace_days: int = 30,
                  keys: list[str] | None = None) -> DataFrame:
    """Changed cycles of each micro-batch with their distinct events, and whether stored events are to be added.

    ``clock`` drives watermark and timers. With the time of receipt as the clock, an event is never
    too late, however old it is; with ``occurred_at``, events more than ``delay`` behind are dropped.
    State is held from a cycle's first event until ``grace_days`` after its deadline (after its last
    event if no deadline is known).
    """
    keys = keys or projection.CYCLE_KEYS
    kinds = dict(events.dtypes)
    event = CYCLE_EVENT.format(kinds["event_id"])
    fields = [projection.cycle_event(kinds["event_id"])[name].alias(name) for name in EVENT_FIELDS[:-1]]
    deadline = F.unix_micros("deadline_at").alias("deadline")
    rows = events.where("cycle_ref IS NOT NULL").withWatermark(clock, delay).select(*keys, clock, *fields, deadline)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"events array<{event}>", "stored boolean"])
    # Rows, not pandas: a cycle has a handful of events, and a frame for each would cost more than the work on it.
    return use_rocksdb(rows).groupBy(*keys).transformWithState(
        statefulProcessor=CycleEvents(keys, event, grace_days * 86_400_000), outputStructType=schema,
        outputMode="Update", timeMode="EventTime")


def with_cycle_state(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The columns of a projected cycle, from the array of its events."""
    rest = [c for c in changes.columns if c not in keys]
    facts = changes.select(*keys, *rest, *projection.facts_of_events())
    return facts.select(*projection.cycle_columns(keys), *rest)


def stream_projection(events: DataFrame, grace: str = "30 days", keys: list[str] | None = None, clock: str = "occurred_at") -> DataFrame:
    """Cycle state kept current, in update mode; equal to the batch fold over the same events.

    A cycle is its keys alone: events without a deadline, or with another one, belong to it, and
    the first deadline known in event order counts. State ends with the cycle (see ``cycle_changes``);
    ``projection_store`` writes a stream whose late captures find their cycle again.
    """
    keys = keys or projection.CYCLE_KEYS
    return with_cycle_state(cycle_changes(events, clock, grace, keys=keys), keys).drop("events", "stored")


def projection_store(root: str, keys: list[str] | None = None, buckets: int = 64, compact_every: int = 50):
    """foreachBatch writer of ``cycle_changes``: the table of projected cycles.

    Changed cycles are written by batch number, so a retried batch writes the same rows. A cycle
    whose state was evicted gets its stored events back: only the buckets of such cycles are read.
    Each ``compact_every``-th batch also carries over all cycles that did not change, and older
    batches are not read any more.
    """
    keys = keys or projection.CYCLE_KEYS

    def write(changes: DataFrame, batch_id: int) -> None:
        spark = changes.sparkSession
        changes = changes.withColumn("bucket", F.pmod(F.hash(*keys), F.lit(buckets)))
        base = batch_id - batch_id % compact_every
        asked = [r["bucket"] for r in changes.where("stored").select("bucket").distinct().collect()]  # at most ``buckets``
        compacting = batch_id == base and batch_id > 0
        if batch_id > 0 and (asked or compacting):
            before = _cycle_rows(spark, root, batch_id, compact_every)
            newest = before if compacting else before.where(F.col("bucket").isin(asked))
            if not compacting:
                newest = ordered.matched(newest, changes.where("stored").select(*keys), keys, "left_semi")
            newest = newest.groupBy(*keys, "bucket").agg(F.max_by("events", "batch").alias("_before"))
            changes = _joined(changes, newest, keys)
        target = f"{root}/cycles/batch={batch_id}"
        with_cycle_state(changes, keys).write.mode("overwrite").partitionBy("bucket").parquet(target)

    return write


def _joined(changes: DataFrame, newest: DataFrame, keys: list[str]) -> DataFrame:
    old = newest.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("bucket").alias("_of_bucket"), "_before")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    # A changed cycle holds all of its events unless it is marked; an unchanged one only has stored ones.
    events = F.when(F.col("_before").isNull(), F.col("events")).when(F.col("events").isNull(), F.col("_before")).when(
        F.col("stored"), F.array_union("_before", "events")).otherwise(F.col("events"))
    both = changes.withColumn("_new", F.lit(True)).join(old, same, "full")
    own = [F.when(F.col("_new"), F.col(k)).otherwise(F.col(f"_of_{k}")).alias(k) for k in [*keys, "bucket"]]
    return both.select(*own, events.alias("events"), F.coalesce("stored", F.lit(False)).alias("stored"))


def _cycle_rows(spark: SparkSession, root: str, before: int, compact_every: int) -> DataFrame:
    """Stored rows of the batches from the last compaction on, with bucket and batch number."""
    rows = spark.read.option("basePath", f"{root}/cycles").parquet(f"{root}/cycles")
    base = (before - 1) - (before - 1) % compact_every
    return rows.where((F.col("batch") >= base) & (F.col("batch") < before))


def projected_table(spark: SparkSession, root: str, keys: list[str] | None = None, compact_every: int = 50) -> DataFrame:
    """The cycles that ``projection_store`` has written, each as its newest batch left it."""
    keys = keys or projection.CYCLE_KEYS
    rows = spark.read.option("basePath", f"{root}/cycles").parquet(f"{root}/cycles")
    last = rows.agg(F.max("batch")).first()[0]
    rows = rows.where(F.col("batch") >= last - last % compact_every)
    rest = [c for c in rows.columns if c not in (*keys, "batch", "bucket", "events", "stored")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row")).select(*keys, "_row.*")


def issuer_windows(attempts: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Tumbling windows per issuer: closed ones in append mode, the latest counts in update mode."""
    return (
        attempts.withWatermark("at", delay)
        .groupBy("issuer", F.window("at", window).alias("w"))
        .agg(F.count("*").alias("attempts"), F.count_if("success").alias("successes"))
        .select("issuer", F.col("w.start").alias("window_start"), "attempts", "successes")
    )


DAY_US = 86_400_000_000


class MessagePanes(StatefulProcessor):
    """Messages of a customer per day; a change touches the days that look back on it."""

    def __init__(self, customer: str, days: int) -> None:
        self.customer, self.days = customer, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.panes = handle.getValueState("panes", "days array<bigint>, counts array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        panes = dict(zip(*self.panes.get())) if self.panes.exists() else {}
        changed = set()
        for batch in rows:
            for day, count in batch["day"].value_counts().items():
                panes[int(day)] = panes.get(int(day), 0) + int(count)
                changed.add(int(day))
        # A later message is not older than the watermark; panes that none of its days looks back on go.
        oldest = timerValues.getCurrentWatermarkInMs() * MICROS_PER_MS // DAY_US - self.days
        ends = np.array(sorted({d + g for d in changed for g in range(1, self.days + 1)}))
        days = np.array(sorted(panes))
        sums = np.concatenate([[0], np.cumsum([panes[int(d)] for d in days])])
        held = sums[np.searchsorted(days, ends)] - sums[np.searchsorted(days, ends - self.days)]
        kept = [int(d) for d in days if d >= oldest]
        self.panes.update((kept, [panes[d] for d in kept]))
        yield pd.DataFrame({self.customer: [key[0]] * len(ends), "as_of_us": ends * DAY_US, "messages": held})

    def close(self) -> None:
        pass


def trailing_messages(messages: DataFrame, delay: str = "1 day", days: int = 30) -> DataFrame:
    """Messages per customer over the ``days`` days before each midnight, for those that had any.

    A message is counted in its day's pane once. In the stream a customer's state is its panes of
    the last days, and an update comes out for every midnight whose count changed.
    """
    day = F.floor(F.unix_micros("sent_at") / DAY_US)
    if not messages.isStreaming:
        panes = messages.groupBy("customer_id", day.alias("day")).agg(F.count("*").alias("n"))
        reach = panes.select("customer_id", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("_g"), "day", "n")
        sums = reach.groupBy("customer_id", (F.col("day") + F.col("_g")).alias("day")).agg(F.sum("n").alias("messages_30d"))
        return sums.select("customer_id", F.timestamp_micros(F.col("day") * DAY_US).alias("as_of"), "messages_30d")
    kind = dict(messages.dtypes)["customer_id"]
    rows = messages.withWatermark("sent_at", delay).select("customer_id", "sent_at", day.alias("day"))
    changes = use_rocksdb(rows).groupBy("customer_id").transformWithStateInPandas(
        statefulProcessor=MessagePanes("customer_id", days), outputStructType=f"customer_id {kind}, as_of_us bigint, messages bigint",
        outputMode="Update", timeMode="EventTime")
    return changes.select("customer_id", F.timestamp_micros("as_of_us").alias("as_of"), F.col("messages").alias("messages_30d"))


class OpenSessions(StatefulProcessor):
    """The sessions of a cycle that an event may still join, as mergeable intervals."""

    def __init__(self, keys: list[str], gap_us: int) -> None:
        self.keys, self.gap = keys, gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sessions", "open array<array<bigint>>, timer bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, timer = self.state.get() if self.state.exists() else ([], None)
        before = {s[0]: tuple(s) for s in held}
        spans = sorted([*before.values(), *((us, us, int(f), int(p)) for b in rows for us, f, p in zip(b["us"], b["failed"], b["paid"]))])
        merged: list[tuple] = []
        for first, last, failed, paid in spans:
            if merged and first < merged[-1][1] + self.gap:
                a, b, f, p = merged[-1]
                merged[-1] = (a, max(b, last), f + failed, p + paid)
            else:
                merged.append((first, last, failed, paid))
        now_us = timerValues.getCurrentWatermarkInMs() * MICROS_PER_MS
        self.keep([s for s in merged if s[1] + self.gap > now_us], timer)
        changed = [(*s, False) for s in merged if before.get(s[0]) != s]
        starts = {s[0] for s in merged}
        changed += [(*s, True) for start, s in before.items() if start not in starts]
        out = {k: [v] * len(changed) for k, v in zip(self.keys, key)}
        columns = zip(("started", "last", "failures", "successes", "absorbed"), zip(*changed))
        yield pd.DataFrame(out | {name: list(values) for name, values in columns}) if changed else pd.DataFrame()

    def keep(self, sessions: list[tuple], timer: int | None) -> None:
        """Sessions that stay, and a timer for the first of them to end."""
        ends = min(((s[1] + self.gap) // MICROS_PER_MS + 1 for s in sessions), default=None)
        if timer is not None and timer != ends:
            self.handle.deleteTimer(timer)
        if ends is None:
            self.state.clear()
            return
        if timer != ends:
            self.handle.registerTimer(ends)
        self.state.update(([list(s) for s in sessions], ends))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            held, _ = self.state.get()
            now_us = timerValues.getCurrentWatermarkInMs() * MICROS_PER_MS
            self.keep([tuple(s) for s in held if s[1] + self.gap > now_us], None)
        return iter([])

    def close(self) -> None:
        pass


def retry_sessions(events: DataFrame, delay: str = "1 hour", gap_days: int = 2) -> DataFrame:
    """Recovery episodes as they change, in update mode; equal to the batch sessions.

    A batch gives the sessions it began or changed, by their start; one that joined an earlier
    session comes out once more as ``absorbed``. A session leaves the state when the watermark
    has passed its end, since no event can join it any more.
    """
    keys = ["mandate_id", "cycle_ref"]
    kinds = dict(events.dtypes)
    failed, paid = F.col("event_type").isin(*projection.FAILURES), F.col("event_type").isin(*projection.SUCCESSES)
    rows = events.where(failed | paid).withWatermark("occurred_at", delay).select(
        *keys, "occurred_at", F.unix_micros("occurred_at").alias("us"), failed.alias("failed"), paid.alias("paid"))
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "started bigint, last bigint, failures bigint, successes bigint, absorbed boolean"])
    sessions = use_rocksdb(rows).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=OpenSessions(keys, gap_days * DAY_US), outputStructType=schema, outputMode="Update", timeMode="EventTime")
    return sessions.select(
        *keys, F.timestamp_micros("started").alias("started_at"),
        F.timestamp_micros(F.col("last") + gap_days * DAY_US).alias("closed_at"), "failures", "successes", "absorbed")


#: Spans of the segments of a mandate, in microseconds; each is made of those below it.
MINUTE_US, HOUR_US = 60_000_000, 3_600_000_000
STATES = range(len(projection.MANDATE_STATES))
#: What nothing does to a mandate: for each state the state reached, then the refusals counted.
UNCHANGED = [*STATES, *[0] * len(STATES)]
_MOVES = {(a, b): projection.MANDATE_STATES[b] in projection.MANDATE_TRANSITIONS[projection.MANDATE_STATES[a]] for a in STATES for b in STATES}


def one_move(to: int) -> list[int]:
    """What one event does to a mandate in each state."""
    legal = [s == to or _MOVES[s, to] for s in STATES]
    return [*(to if ok else s for s, ok in zip(STATES, legal)), *(int(not ok) for ok in legal)]


def then(first: list[int], second: list[int]) -> list[int]:
    n = len(STATES)
    return [*(second[first[s]] for s in STATES), *(first[n + s] + second[n + first[s]] for s in STATES)]


#: Events of a mandate that are held as one list before they become segments.
FLAT_EVENTS = 512
MOVES = [one_move(to) for to in STATES]


class MandateFold(StatefulProcessor):
    """Mandate state in total order: a short list of events, or segments that compose.

    The events of most mandates that the watermark has not passed are few; they are one value of the state,
    read and written once per batch. Of more than ``flat_events`` the mandate goes on in segments.

    What a minute's events do to each of the seven states is a small table, and tables compose:
    minutes make an hour, hours a day, days the mandate. An event, late or not, is put into its
    minute; then one table per level is made anew. Days that the watermark has passed are applied
    to the base and forgotten with all that is below them.
    """

    def __init__(self, flat_events: int = FLAT_EVENTS) -> None:
        self.flat_events = flat_events

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flat = handle.getValueState("flat", "us array<bigint>, id array<string>, to array<int>, state int, stale bigint, segments boolean")
        self.base = handle.getValueState("base", "state int, stale bigint")
        self.minutes = handle.getMapState("minutes", "at bigint", "us array<bigint>, id array<string>, to array<int>")
        node = "at array<bigint>, moves array<array<bigint>>"
        self.hours = handle.getMapState("hours", "at bigint", node)
        self.days = handle.getMapState("days", "at bigint", node)
        self.root = handle.getValueState("root", node)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = [e for batch in rows for e in zip(batch["us"].tolist(), batch["id"].tolist(), batch["to"].tolist())]
        *held, state, stale, segments = self.flat.get() or ([], [], [], 0, 0, False)
        if not segments:
            events = sorted({*zip(*held), *events})
            if len(events) <= self.flat_events:
                state, stale = self.keep(events, state, stale, held[0][0] if held[0] else None, timerValues)
                yield pd.DataFrame({"mandate_id": [key[0]], "state": [projection.MANDATE_STATES[state]], "stale_transitions": [stale]})
                return
            self.base.update((state, stale))
            self.flat.update(([], [], [], 0, 0, True))
        fresh: dict[int, list] = {}
        for e in events:
            fresh.setdefault(e[0] // MINUTE_US, []).append(e)
        moves = {at: self.minute(at, events) for at, events in fresh.items()}
        for table, span in ((self.hours, HOUR_US // MINUTE_US), (self.days, DAY_US // HOUR_US)):
            moves = self.above(table, moves, span)
        root = self.node(self.root.get()) if self.root.exists() else {}
        for day in moves.keys() - root.keys():
            self.handle.registerTimer((day + 1) * DAY_US // MICROS_PER_MS)
        root |= moves
        state, stale = self.settle(root, timerValues.getCurrentWatermarkInMs() * MICROS_PER_MS)
        for day in sorted(root):
            state, stale = self.applied(state, stale, root[day])
        yield pd.DataFrame({"mandate_id": [key[0]], "state": [projection.MANDATE_STATES[state]], "stale_transitions": [stale]})

    def keep(self, events: list, state: int, stale: int, first: int | None, timerValues) -> tuple[int, int]:
        """Applies all events, in order; those of passed days for good, the others stay, with a timer for the first day."""
        now_us = timerValues.getCurrentWatermarkInMs() * MICROS_PER_MS
        passed = sum((us // DAY_US + 1) * DAY_US <= now_us for us, _, _ in events)
        left = events[passed:]
        for _, _, to in events[:passed]:
            state, stale = self.applied(state, stale, MOVES[to])
        self.flat.update(([e[0] for e in left], [e[1] for e in left], [e[2] for e in left], state, stale, False))
        if left and (first is None or first // DAY_US != left[0][0] // DAY_US):
            self.handle.registerTimer((left[0][0] // DAY_US + 1) * DAY_US // MICROS_PER_MS)
        for _, _, to in left:
            state, stale = self.applied(state, stale, MOVES[to])
        return state, stale

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        *held, state, stale, segments = self.flat.get() or ([], [], [], 0, 0, True)
        if not segments:
            self.keep(list(zip(*held)), state, stale, None, timerValues)
        elif self.root.exists():
            self.settle(self.node(self.root.get()), timerValues.getCurrentWatermarkInMs() * MICROS_PER_MS)
        return iter([])

    def minute(self, at: int, events: list) -> list[int]:
        held = set(zip(*self.minutes.getValue((at,)))) if self.minutes.containsKey((at,)) else set()
        ordered_events = sorted(held | set(events))
        self.minutes.updateValue((at,), tuple(map(list, zip(*ordered_events))))
        out = UNCHANGED
        for _, _, to in ordered_events:
            out = then(out, one_move(to))
        return out

    def above(self, table, moves: dict[int, list[int]], span: int) -> dict[int, list[int]]:
        """The segments of the next level over the changed ones, made anew from their parts."""
        out = {}
        for at in {m // span for m in moves}:
            parts = self.node(table.getValue((at,))) if table.containsKey((at,)) else {}
            parts |= {m: own for m, own in moves.items() if m // span == at}
            table.updateValue((at,), (list(parts), list(parts.values())))
            whole = UNCHANGED
            for part in sorted(parts):
                whole = then(whole, parts[part])
            out[at] = whole
        return out

    @staticmethod
    def node(value) -> dict[int, list[int]]:
        return {int(at): [int(x) for x in moves] for at, moves in zip(*value)}

    @staticmethod
    def applied(state: int, stale: int, moves: list[int]) -> tuple[int, int]:
        return moves[state], stale + moves[len(STATES) + state]

    def settle(self, root: dict[int, list[int]], now_us: int) -> tuple[int, int]:
        """Applies the days that have passed to the base, and drops them from ``root`` and the state."""
        state, stale = self.base.get() if self.base.exists() else (0, 0)
        for day in sorted(d for d in root if (d + 1) * DAY_US <= now_us):
            state, stale = self.applied(state, stale, root.pop(day))
            for hour in self.node(self.days.getValue((day,))):
                for minute in self.node(self.hours.getValue((hour,))):
                    self.minutes.removeKey((minute,))
                self.hours.removeKey((hour,))
            self.days.removeKey((day,))
        self.base.update((state, stale))
        self.root.update((list(root), list(root.values())))
        return state, stale

    def close(self) -> None:
        pass


def mandate_state(events: DataFrame, delay: str = "7 days", flat_events: int = FLAT_EVENTS) -> DataFrame:
    moves = events.withWatermark("occurred_at", delay).select(
        "mandate_id", F.unix_micros("occurred_at").alias("us"), F.lpad(F.col("event_id").cast("string"), 20, "0").alias("id"),
        projection.state_index(F.col("event_type")).alias("to"), "occurred_at",
    ).where("to IS NOT NULL")
    kind = dict(events.dtypes)["mandate_id"]
    return use_rocksdb(moves).groupBy("mandate_id").transformWithStateInPandas(
        statefulProcessor=MandateFold(flat_events), outputStructType=f"mandate_id {kind}, state string, stale_transitions bigint",
        outputMode="Update", timeMode="EventTime",
    )


class IssuerDetector(StatefulProcessor):
    """The state of one issuer, moved on by the windows that a micro-batch closes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "cusum double, since bigint, streak int, outages int, minutes double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else issuers.HEALTHY
        windows = pd.concat(list(rows)).sort_values("start_s", ignore_index=True)
        state, columns = issuers.followed(state, windows)
        self.state.update(state)
        yield pd.DataFrame(dict(zip(issuers.STATE_COLUMNS, [[key[0]] * len(windows), windows["start_s"], *columns])))

    def close(self) -> None:
        pass


def issuer_detector(attempts: DataFrame, baseline: float, delay: str = "10 minutes", window: str = "5 minutes", **tuning) -> DataFrame:
    """Detector states from a stream of attempts, in append mode.

    Attempts are counted per tumbling window; the detector sees a window once, when the watermark
    has closed it, so counts are final and windows come in order. State is one row per issuer and
    the windows still open.
    """
    closed = issuer_windows(attempts, delay, window)
    inputs = issuers.detector_inputs(closed, F.lit(baseline), **tuning)
    return use_rocksdb(inputs).groupBy("issuer").transformWithStateInPandas(
        statefulProcessor=IssuerDetector(), outputStructType=issuers.STATE_SCHEMA, outputMode="Append", timeMode="None"
    )


def with_open_windows(closed: DataFrame, windows: DataFrame, baseline: float, **tuning) -> DataFrame:
    """The states of closed windows, and after them those of windows that are still open.

    ``windows`` holds the latest counts of all windows. An issuer's open windows start after its closed
    ones, so its last closed state is carried on over them.
    """
    fields = issuers.STATE_COLUMNS[2:]
    states = closed.select(*issuers.STATE_COLUMNS)
    last = states.groupBy("issuer").agg(F.max_by(F.struct(*fields), "start_s").alias("_last")).select("issuer", "_last.*")
    inputs = issuers.detector_inputs(windows, F.lit(baseline), **tuning)
    known = states.select(F.col("issuer").alias("_issuer"), F.col("start_s").alias("_start"))
    still_open = inputs.join(known, F.col("issuer").eqNullSafe(F.col("_issuer")) & (F.col("start_s") == F.col("_start")), "left_anti")

    def carry_on(carried: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame(columns=issuers.STATE_COLUMNS)
        own = own.sort_values("start_s", ignore_index=True)
        state = tuple(carried[fields].iloc[0]) if len(carried) else issuers.HEALTHY
        return pd.DataFrame(dict(zip(issuers.STATE_COLUMNS, [own["issuer"], own["start_s"], *issuers.followed(state, own)[1]])))

    later = last.groupBy("issuer").cogroup(still_open.groupBy("issuer")).applyInPandas(carry_on, issuers.STATE_SCHEMA)
    return states.unionByName(later)


def late_capture_guard(pending_actions: DataFrame, path: str):
    """foreachBatch writer: cancel the pending actions of cycles that turned out paid."""

    def write(cycles: DataFrame, batch_id: int) -> None:
        cancelled = projection.late_capture_guard(cycles, pending_actions)
        cancelled.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def ledger_appender(root: str, fields: list[str], order: list[str]):
    """foreachBatch writer: extend the chains with a micro-batch of decisions.

    The heads of all chains live in versioned snapshots, so a batch reads one small table
    and a retried batch writes the same rows again.
    """

    def write(decisions: DataFrame, batch_id: int) -> None:
        spark = decisions.sparkSession
        heads = sinks.read_snapshot(spark, f"{root}/heads", batch_id - 1)
        chained = ledger.append_decisions(ledger.with_payload(decisions, fields), order, heads)
        target = f"{root}/ledger/batch={batch_id}"
        chained.write.mode("overwrite").parquet(target)
        ends = ledger.chain_heads(spark.read.parquet(target))
        sinks.upsert_snapshot(ends, f"{root}/heads", batch_id, ledger.KEYS, ["chain_seq"])

    return write


def priors_writer(root: str, keys: list[str], order: list[str]):
    """foreachBatch writer: keyed upsert of published priors or profiles."""

    def write(updates: DataFrame, batch_id: int) -> None:
        sinks.upsert_snapshot(updates, root, batch_id, keys, order)

    return write


def lag_monitor(pending: DataFrame, now, threshold_seconds: int = 30) -> DataFrame:
    """Backlog size and age of its oldest row; breached above 30 seconds."""
    oldest = F.unix_seconds(now) - F.min(F.unix_seconds("received_at"))
    return pending.agg(F.count("*").alias("pending"), F.coalesce(oldest, F.lit(0)).alias("value")).withColumn(
        "breached", F.col("value") > threshold_seconds
    )


def progress_lag(progress: dict, threshold_seconds: int = 30) -> dict:
    """The same from a streaming query's progress: rows read and distance behind the newest event."""
    times = progress.get("eventTime", {})
    lag = 0.0
    if "max" in times and "watermark" in times:
        lag = (pd.Timestamp(progress["timestamp"]) - pd.Timestamp(times["max"])).total_seconds()
    return {"rows": progress.get("numInputRows", 0), "value": lag, "breached": lag > threshold_seconds}
