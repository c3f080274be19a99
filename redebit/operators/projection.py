"""Event log to domain state: billing cycles and mandates as order-free folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redebit.functions import calendar as cal
from redebit.operators import ordered

# Event types by meaning.
FAILURES = ("payment.failed",)
SUCCESSES = ("payment.captured", "subscription.charged", "invoice.paid")
MANDATE_EVENT_STATE = {
    "subscription.authenticated": "active",
    "subscription.activated": "active",
    "subscription.resumed": "active",
    "subscription.paused": "paused",
    "subscription.halted": "at_risk",
    "subscription.cancelled": "revoked",
    "subscription.completed": "expired",
}
# The mandate state machine.
MANDATE_STATES = ("created", "active", "paused", "at_risk", "revoked", "re_enrolling", "expired")
MANDATE_TRANSITIONS = {
    "created": ("active", "expired"),
    "active": ("paused", "at_risk", "expired"),
    "paused": ("active", "expired"),
    "at_risk": ("active", "revoked", "expired"),
    "revoked": ("re_enrolling",),
    "re_enrolling": ("active", "expired"),
    "expired": (),
}


def cycle_facts() -> list[Column]:
    """Aggregates that fold deduplicated events of one cycle; none depends on row order."""
    order = F.struct("occurred_at", "event_id")
    failed = F.col("event_type").isin(*FAILURES)
    paid = F.col("event_type").isin(*SUCCESSES)
    return [
        F.count_if(failed).alias("attempts_used"),
        F.max(F.when(failed, F.col("occurred_at"))).alias("last_failure_at"),
        F.count_if(paid).alias("_successes"),
        F.min_by(F.coalesce("amount_paise", F.lit(0)), F.when(paid, order)).alias("_paid_paise"),
        F.min_by("amount_paise", F.when(F.col("amount_paise") != 0, order)).alias("_amount"),
        F.min("occurred_at").alias("due_at"),
        F.min_by("deadline_at", F.when(F.col("deadline_at").isNotNull(), order)).alias("deadline_at"),
    ]


def cycle_columns(keys: list[str]) -> list[Column]:
    paid = F.col("_successes") > 0
    return [
        *[F.col(k) for k in keys],
        F.when(paid, "succeeded")
        .when(F.col("attempts_used") > 0, "executing")
        .otherwise("scheduled")
        .alias("state"),
        F.col("attempts_used"),
        F.col("last_failure_at"),
        F.when(paid, F.coalesce("_paid_paise", F.lit(0))).otherwise(F.lit(0)).alias("recovered_paise"),
        F.coalesce("_amount", F.lit(0)).alias("amount_paise"),
        F.col("due_at"),
        F.col("deadline_at"),
    ]


def cycle_event(event_id_type: str = "string") -> Column:
    """What the fold needs of an event, as one struct."""
    return F.struct(
        F.unix_micros("occurred_at").alias("us"), F.col("event_id").cast(event_id_type).alias("id"),
        F.col("event_type").isin(*FAILURES).alias("failed"), F.col("event_type").isin(*SUCCESSES).alias("paid"),
        F.coalesce(F.col("amount_paise").cast("bigint"), F.lit(0)).alias("amount"), F.unix_micros("deadline_at").alias("deadline"),
    )


def facts_of_events(events: str = "events") -> list[Column]:
    """The facts of ``cycle_facts`` from an array of a cycle's distinct events."""
    def kept(condition):
        return F.filter(events, condition)

    def earliest(rows: Column, value) -> Column:
        ordered_rows = F.transform(rows, lambda e: F.struct(e["us"].alias("us"), e["id"].alias("id"), value(e).alias("v")))
        return F.array_min(ordered_rows)["v"]

    failed, paid = kept(lambda e: e["failed"]), kept(lambda e: e["paid"])
    return [
        F.size(failed).cast("bigint").alias("attempts_used"),
        F.timestamp_micros(F.array_max(F.transform(failed, lambda e: e["us"]))).alias("last_failure_at"),
        F.size(paid).cast("bigint").alias("_successes"),
        earliest(paid, lambda e: e["amount"]).alias("_paid_paise"),
        earliest(kept(lambda e: e["amount"] != 0), lambda e: e["amount"]).alias("_amount"),
        F.timestamp_micros(F.array_min(F.transform(events, lambda e: e["us"]))).alias("due_at"),
        F.timestamp_micros(earliest(kept(lambda e: e["deadline"].isNotNull()), lambda e: e["deadline"])).alias("deadline_at"),
    ]


CYCLE_KEYS = ["tenant_id", "cycle_ref"]
CYCLE_ATTRIBUTES = ["mandate_id", "customer_id", "rail", "mcc"]


def first_known(name: str) -> Column:
    """The first value that is not NULL, in event order."""
    return F.min_by(name, F.when(F.col(name).isNotNull(), F.struct("occurred_at", "event_id"))).alias(name)


def unique_events(events: DataFrame) -> DataFrame:
    """Re-deliveries removed; identical copies collapse on the map side."""
    return events.dropDuplicates(["event_id"])


def project_cycles(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per cycle; cycles with no billing date on any event are left out.

    Re-deliveries count once. What only describes the cycle (mandate, customer, rail, mcc) and
    its deadline is the first known value, so events that lack or change it stay in one cycle.
    ``budget_left`` is derived: a fold never invents a budget_exhausted state.
    """
    keys = keys or CYCLE_KEYS
    own = unique_events(events.where(F.col("cycle_ref").isNotNull()))
    facts = [first_known(a) for a in CYCLE_ATTRIBUTES if a not in keys and a in events.columns]
    folded = own.groupBy(*keys).agg(*cycle_facts(), *facts)
    names = [a for a in CYCLE_ATTRIBUTES if a not in keys and a in events.columns]
    cycles = folded.select(*cycle_columns(keys), *names).where("deadline_at IS NOT NULL")
    return with_budget(cycles) if "rail" in cycles.columns else cycles


def with_budget(cycles: DataFrame) -> DataFrame:
    """The attempts that the rail allows a cycle, and how many of them are left."""
    budget = cal.attempt_budget(F.col("rail"))
    return cycles.withColumn("attempt_budget", budget).withColumn(
        "budget_left", F.greatest(budget - F.col("attempts_used"), F.lit(0)).cast("int")
    )


MANDATE_KEYS = ["tenant_id", "mandate_id"]
MANDATE_FACTS = ["customer_id", "rail", "mcc"]


def with_mandates(rows: DataFrame, mandates: DataFrame) -> DataFrame:
    """Events or cycles with the customer, rail and category of their mandate.

    ``mandates`` has one row per tenant and mandate; only its keys and facts are read. Its facts
    replace those that the rows carry, and rows without a known mandate drop out. The provider's
    envelopes name the mandate only, so their cycles get rail and budget here.
    """
    facts = mandates.select(*MANDATE_KEYS, *MANDATE_FACTS)
    joined = rows.drop(*MANDATE_FACTS).join(facts, MANDATE_KEYS)
    return with_budget(joined) if "attempts_used" in rows.columns else joined


def cycle_sequence(cycles: DataFrame, at: str = "due_at", tie: str = "cycle_ref") -> DataFrame:
    """Billing sequence of a cycle within its mandate."""
    return ordered.numbered(cycles, ["mandate_id"], [at, tie], ordered.time_block(F.col(at)), "seq_no")


def state_index(event_type: Column) -> Column:
    out = None
    for name, state in MANDATE_EVENT_STATE.items():
        value = F.lit(MANDATE_STATES.index(state))
        out = F.when(event_type == name, value) if out is None else out.when(event_type == name, value)
    return out


def _allowed() -> Column:
    flags = [
        F.lit(to in MANDATE_TRANSITIONS[frm]) for frm in MANDATE_STATES for to in MANDATE_STATES
    ]
    return F.array(*flags)


def _step(at: Column, to: Column) -> Column:
    """One event applied to one (state, stale) pair."""
    legal = F.element_at(_allowed(), at["state"] * len(MANDATE_STATES) + to + 1)
    moved = (at["state"] != to) & legal
    stale = (at["state"] != to) & ~legal
    return F.struct(
        F.when(moved, to).otherwise(at["state"]).alias("state"),
        (at["stale"] + stale.cast("long")).alias("stale"),
    )


FOLD_LEVELS = (60, 86_400)  # seconds: minute blocks, then days, then the whole mandate


def mandate_state(events: DataFrame, levels: tuple[int, ...] = FOLD_LEVELS) -> DataFrame:
    """Fold mandate events in total order, counting refused transitions.

    A fold over a state machine is a composition of functions on seven states, and
    composition is associative. The events of a minute are reduced to their function, the
    minutes of a day to one, and the days of a mandate are applied in turn, so no task ever
    holds the history of a busy mandate.
    """
    moves = events.select(
        "mandate_id", "event_id", F.unix_micros("occurred_at").alias("us"), state_index(F.col("event_type")).alias("to")
    ).where("to IS NOT NULL")
    identity = F.array(
        *[F.struct(F.lit(i).alias("state"), F.lit(0).cast("long").alias("stale")) for i in range(len(MANDATE_STATES))]
    )
    first, *coarser = levels
    folded = (
        moves.withColumn("block", F.floor(F.col("us") / (first * 1_000_000)))
        .groupBy("mandate_id", "block")
        .agg(F.array_sort(F.collect_set(F.struct("us", "event_id", "to"))).alias("moves"))
        .select(
            "mandate_id", (F.col("block") * first).alias("second"),
            F.aggregate("moves", identity, lambda fn, m: F.transform(fn, lambda s: _step(s, m["to"]))).alias("fn"),
        )
    )
    for seconds in coarser:
        folded = (
            folded.groupBy("mandate_id", F.floor(F.col("second") / seconds).alias("block"))
            .agg(F.array_sort(F.collect_list(F.struct("second", "fn"))).alias("parts"))
            .select(
                "mandate_id", (F.col("block") * seconds).alias("second"),
                F.aggregate("parts", identity, lambda fn, p: F.transform(fn, lambda s: _apply(s, p["fn"]))).alias("fn"),
            )
        )
    created = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("stale"))
    names = F.array(*[F.lit(s) for s in MANDATE_STATES])
    return (
        folded.groupBy("mandate_id")
        .agg(F.array_sort(F.collect_list(F.struct("second", "fn"))).alias("parts"))
        .select("mandate_id", F.aggregate("parts", created, lambda acc, p: _apply(acc, p["fn"])).alias("r"))
        .select(
            "mandate_id",
            names[F.col("r.state")].alias("state"),
            F.col("r.stale").alias("stale_transitions"),
        )
    )


def _apply(at: Column, fn: Column) -> Column:
    """A block's function applied to one (state, stale) pair."""
    reached = fn[at["state"]]
    return F.struct(reached["state"].alias("state"), (at["stale"] + reached["stale"]).alias("stale"))


def retry_sessions(events: DataFrame, gap: str = "2 days") -> DataFrame:
    """Recovery episodes: payment events of a cycle with no pause longer than ``gap``."""
    paid = F.col("event_type").isin(*SUCCESSES)
    failed = F.col("event_type").isin(*FAILURES)
    return (
        events.where(paid | failed)
        .groupBy("mandate_id", "cycle_ref", F.session_window("occurred_at", gap).alias("w"))
        .agg(F.count_if(failed).alias("failures"), F.count_if(paid).alias("successes"))
        .select(
            "mandate_id", "cycle_ref",
            F.col("w.start").alias("started_at"), F.col("w.end").alias("closed_at"),
            "failures", "successes",
        )
    )


def late_capture_guard(cycles: DataFrame, actions: DataFrame) -> DataFrame:
    """Pending actions that a paid cycle cancels."""
    paid = cycles.where(F.col("state").isin("succeeded", "superseded")).select("cycle_ref")
    return actions.where(F.col("state") == "pending").join(paid, "cycle_ref", "left_semi").withColumn(
        "state", F.lit("cancelled")
    )
