"""Candidate selection, attempt economics and the retry-slot decision."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StructField, StructType

from redebit.functions import calendar as cal
from redebit.functions import hashing
from redebit.operators import grids, legality, projection

LEAD_SLOTS = 25
BASE_FEE, BETA_FRAUD, LAMBDA_ANNOYANCE = 300, 0.4, 1.0
W_MULTIPLE = 12
DELTA_R = 0.04
MAX_BUDGET = 4
SETTLED_STATES = ("succeeded", "superseded", "budget_exhausted", "stopped_economic", "stopped_hard")
TERMINAL_CAUSES = ("credential_dead", "mandate_dead")


def retry_candidates(cycles: DataFrame, open_actions: DataFrame, now: Column, mandates: DataFrame | None = None) -> DataFrame:
    """Executing cycles with budget and time left that have no open action.

    With ``mandates`` customer, rail, category and thereby the budget come from the mandate's row;
    cycles without one are left out. Without it the cycles carry them.
    """
    live = cycles.where((F.col("state") == "executing") & (F.col("deadline_at") > now))
    if mandates is not None:
        live = projection.with_mandates(live, mandates)
    live = live.where(F.col("attempts_used") < F.col("attempt_budget"))
    pending = open_actions.where(F.col("state").isin("pending", "claimed")).select("cycle_ref")
    return live.join(pending, "cycle_ref", "left_anti")


def chronic_mandates(cycles: DataFrame, interventions: DataFrame, chronic: int = 3) -> DataFrame:
    """Mandates with enough failed cycles and no date change proposed yet."""
    grouped = cycles.groupBy("mandate_id", "mcc", "rail").agg(
        F.max("amount_paise").alias("amount_paise"),
        F.max(cal.day_of_month_ist(F.col("due_at"))).alias("debit_day"),
        F.max("cycle_id").alias("cycle_id"),
        F.count_if("failed").alias("failures"),
    ).where(F.col("failures") >= chronic)
    moved = interventions.where("kind = 'date_change'").select("mandate_id")
    return grouped.join(moved, "mandate_id", "left_anti")


def latest_decline_code(events: DataFrame) -> DataFrame:
    """Code of the newest failure per mandate; reduced on the map side."""
    failed = events.where("event_type = 'payment.failed'")
    newest = F.struct("occurred_at", "event_id")
    return failed.groupBy("mandate_id").agg(F.max_by("decline_code", newest).alias("decline_code"))


def fire_context(cycles: DataFrame, mandates: DataFrame, profiles: DataFrame) -> DataFrame:
    """A cycle with its mandate and the customer's consent, absent profiles counting as consenting."""
    joined = cycles.join(mandates, "mandate_id").join(profiles, "customer_id", "left")
    return joined.withColumn("consent_withdrawn", F.coalesce("consent_withdrawn", F.lit(False)))


def hard_stops(cause: Column, mandate_state: Column, opted_out: Column, used: Column, budget: Column,
               deadline: Column, now: Column) -> Column:
    """Every stop reason that applies, never only the first."""
    return F.array_compact(F.array(
        F.when(cause.isin(*TERMINAL_CAUSES), F.lit("terminal_cause")),
        F.when(mandate_state != "active", F.lit("mandate_not_active")),
        F.when(opted_out, F.lit("customer_opted_out")),
        F.when(used >= budget, F.lit("budget_exhausted")),
        F.when(now > deadline, F.lit("past_deadline")),
    ))


def revalidate(mandate_state: Column, cycle_state: Column, deadline: Column, used: Column, budget: Column,
               scheduled_paise: Column, paise: Column, now: Column) -> Column:
    """First reason an action is stale at fire time; NULL if it still holds."""
    return (
        F.when(mandate_state != "active", "mandate_not_active")
        .when(cycle_state.isin(*SETTLED_STATES), "cycle_settled")
        .when(now > deadline, "past_deadline")
        .when(used >= budget, "budget_exhausted")
        .when(scheduled_paise != paise, "amount_changed")
    )


def attempt_cost(paise: Column, spent: Column) -> Column:
    """Fee plus fraud and annoyance surcharges growing with attempts spent, in paise (half-even)."""
    unit = paise / F.lit(100.0)
    raw = F.lit(float(BASE_FEE)) + F.lit(BETA_FRAUD) * spent * spent * unit + F.lit(LAMBDA_ANNOYANCE) * spent * unit
    return F.bround(raw, 0)


#: Rows solved in one step; a step takes whole cycles.
ROWS_AT_ONCE = 1 << 17
SLOT_COLUMNS = ("slot", "legal", "p")


class Cycles:
    """Slot rows of whole cycles, in order, and where each cycle begins; facts are there once per cycle or in every row."""

    def __init__(self, table: pa.Table, starts: np.ndarray) -> None:
        self.table, self.starts, self.rows = table, starts, len(table)
        self.facts = None
        if "_facts" in table.column_names:
            heads = table.column("_facts").combine_chunks()
            self.facts = pa.Table.from_struct_array(heads.flatten() if isinstance(heads, pa.Array) else pa.chunked_array(c.flatten() for c in heads.chunks))
            if len(self.facts) != len(starts):
                raise ValueError("a cycle in order begins with its one row of slot 0")
        self.cycle = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, self.rows)))
        self.place = np.arange(self.rows) - starts[self.cycle]
        self.slot = table.column("slot").to_numpy().astype(np.int64)
        self.legal = pc.fill_null(table.column("legal"), False).to_numpy()

    def number(self, name: str) -> np.ndarray:
        """A column as floats, nulls as NaN."""
        if self.facts is not None and name in self.facts.column_names:
            return table_floats(self.facts.column(name))[self.cycle]
        return table_floats(self.table.column(name))

    def take(self, names: list[str], rows: np.ndarray) -> pa.Table:
        """Columns as they came, at some rows."""
        if self.facts is None:
            return self.table.select(names).take(rows)
        own, shared = self.cycle[rows], self.facts.column_names
        return pa.table({n: self.facts.column(n).take(own) if n in shared else self.table.column(n).take(rows) for n in names})

    def reach(self, lead: int) -> tuple[np.ndarray, np.ndarray]:
        """Per row the first row of its cycle that lies ``lead`` slots ahead, and whether there is one."""
        low = int(self.slot.min(initial=0))
        width = int(self.slot.max(initial=0)) - low + abs(lead) + 1
        line = self.cycle * width + self.slot - low
        first = np.searchsorted(line, line + lead)
        there = first < self.rows
        first = np.minimum(first, self.rows - 1)
        return first, there & (self.cycle[first] == self.cycle)

    def best_from(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best value from each row to the end of its cycle and the first row that has it."""
        shape = (len(self.starts), int(self.place.max(initial=0)) + 1)
        grid = np.full(shape, -np.inf)
        grid[self.cycle, self.place] = value
        top = np.maximum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]
        held = np.where(grid == top, np.arange(shape[1]), shape[1])
        first = np.minimum.accumulate(held[:, ::-1], axis=1)[:, ::-1]
        at = self.starts[self.cycle] + first[self.cycle, self.place]
        return top[self.cycle, self.place], np.minimum(at, self.rows - 1)


def table_floats(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.float64(), safe=False).to_numpy()


def _whole_cycles(batches: Iterator[pa.RecordBatch]) -> Iterator[Cycles]:
    """Steps of whole cycles; one begins where the key changes, or with slot 0 where only this row brings the key."""
    held, size = [], 0

    def cut(table: pa.Table) -> np.ndarray:
        if "_facts" in table.column_names:
            return np.flatnonzero(table.column("slot").to_numpy() == 0)
        key = table.column("_key").to_numpy()
        return np.flatnonzero(np.append(True, key[1:] != key[:-1]))

    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= ROWS_AT_ONCE:
            table = pa.Table.from_batches(held).combine_chunks()
            starts = cut(table)
            last = int(starts[-1])  # the last cycle may go on
            if last:
                yield Cycles(table.slice(0, last), starts[:-1])
            held, size = table.slice(last).to_batches(), size - last
    if size:
        table = pa.Table.from_batches(held).combine_chunks()
        yield Cycles(table, cut(table))


class GridCycles(Cycles):
    """Cycles that have every slot of a horizon: a row of a grid each."""

    def __init__(self, facts: pa.Table, horizon: int, columns: dict[str, np.ndarray]) -> None:
        n = len(facts)
        self.facts, self.horizon, self.rows = facts, horizon, n * horizon
        self.starts = np.arange(n) * horizon
        self.cycle, self.place = np.repeat(np.arange(n), horizon), np.tile(np.arange(horizon), n)
        self.slot, self.legal = self.place, columns["legal"].ravel()
        self.columns = {name: values.ravel() for name, values in columns.items()}
        self.table = pa.table({"slot": self.place.astype(np.int32)})

    def number(self, name: str) -> np.ndarray:
        return self.columns[name] if name in self.columns else np.repeat(table_floats(self.facts.column(name)), self.horizon)

    def reach(self, lead: int) -> tuple[np.ndarray, np.ndarray]:
        there = self.place + lead < self.horizon
        return np.where(there, np.arange(self.rows) + lead, 0), there

    def best_from(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        grid = value.reshape(-1, self.horizon)[:, ::-1]
        top = np.maximum.accumulate(grid, axis=1)
        held = np.where(grid == top, np.arange(self.horizon)[::-1], self.horizon)
        first = np.minimum.accumulate(held, axis=1)[:, ::-1].ravel()
        return top[:, ::-1].ravel(), np.minimum(np.repeat(self.starts, self.horizon) + first, self.rows - 1)


def by_cycle(slots: DataFrame | grids.SlotGrid, keys: list[str], columns: list[str], schema: StructType,
             solve: Callable[[Cycles], pa.Table], in_order: bool) -> DataFrame:
    """``solve`` over the slot rows of whole cycles, many cycles at a time.

    ``in_order`` says that the rows of a cycle follow each other by slot, as ``legality.explode_slots``
    and narrow steps after it leave them, and differ in ``slot``, ``legal`` and ``p`` only; then nothing is
    shuffled or sorted, and the rest goes to Python with slot 0. Other rows are sorted first. The cycles
    of a grid go to Python without their slots.
    """
    names = [f.name for f in schema]
    if isinstance(slots, grids.SlotGrid):
        return _by_cycle_of_grid(slots, names, schema, solve)
    wanted = list(dict.fromkeys([*keys, *columns]))
    if in_order:
        facts = F.array(F.struct(*[c for c in wanted if c not in SLOT_COLUMNS]))
        rows = slots.select(*SLOT_COLUMNS, F.when(F.col("slot") == 0, facts).alias("_facts"))
    else:
        rows = slots.repartition(*keys).sortWithinPartitions(*keys, "slot").select(*wanted, F.xxhash64(*keys).alias("_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cycles in _whole_cycles(batches):
            yield from solve(cycles).select(names).combine_chunks().to_batches()

    return rows.mapInArrow(run, schema)


def _by_cycle_of_grid(grid: grids.SlotGrid, names: list[str], schema: StructType, solve: Callable[[Cycles], pa.Table]) -> DataFrame:
    fill, horizon = grid.fill, grid.horizon
    at_once = max(1, ROWS_AT_ONCE // horizon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), at_once):
                facts = pa.Table.from_batches([batch.slice(at, at_once)])
                yield from solve(GridCycles(facts, horizon, fill(facts, horizon))).select(names).combine_chunks().to_batches()

    return grid.cycles.mapInArrow(run, schema)


def _solved(cycles: Cycles, max_budget: int, lead: int, min_ev: float) -> dict[str, np.ndarray]:
    """``ev_b``, ``v_b`` and ``next_b`` per row; NaN stands for null."""
    p, dr, amount, stay = (cycles.number(c) for c in ("p", "dr", "amount_paise", "continuation_paise"))
    ahead, there = cycles.reach(lead)
    out, value = {}, stay
    for b in range(1, max_budget + 1):
        lost = value - dr * stay
        ev = np.where(cycles.legal, p * (amount + stay) + (1.0 - p) * lost - cycles.number(f"cost_{b}"), np.nan)
        top, at = cycles.best_from(np.where(np.isnan(ev), -np.inf, ev))
        best = np.where(there, top[ahead], -np.inf)
        take = best > stay + min_ev
        value = np.where(take, best, stay)
        out |= {f"ev_{b}": ev, f"v_{b}": value, f"next_{b}": np.where(take, cycles.slot[at[ahead]], np.nan)}
    return out


def _at(cycles: Cycles, solved: dict[str, np.ndarray], prefix: str, max_budget: int) -> np.ndarray:
    """The layer that belongs to the attempts a cycle has left."""
    budget = cycles.number("budget")
    return np.select([budget == b for b in range(1, max_budget + 1)], [solved[f"{prefix}_{b}"] for b in range(1, max_budget + 1)], np.nan)


def _nullable(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    gone = np.isnan(values)
    return pa.array(np.where(gone, 0, values), mask=gone).cast(kind)


def _inputs(max_budget: int) -> list[str]:
    return ["slot", "legal", "p", "dr", "amount_paise", "continuation_paise", "budget", *[f"cost_{b}" for b in range(1, max_budget + 1)]]


def _fields(slots: DataFrame | grids.SlotGrid, names: list[str], *more: StructField) -> StructType:
    return StructType([*(slots.schema[n] for n in names), *more])


def best_retry_slot(slots: DataFrame, keys: list[str], max_budget: int = MAX_BUDGET, lead: int = LEAD_SLOTS,
                    min_ev: float = 0.0, in_order: bool = False) -> DataFrame:
    """The retry decision at every slot, one layer per attempt left.

    Input: one row per legal slot of a cycle with ``slot``, ``p`` (success probability), ``dr``
    (chance of losing the mandate), ``amount_paise``, ``continuation_paise``, ``budget``,
    ``cost_1..cost_n`` (cost with b attempts left), plus one row with slot 0 and ``legal`` false
    where the decision is taken.

    ``ev_b`` is the value of presenting at the slot with b attempts left, ``v_b`` the best value
    reachable from it and ``next_b`` the first slot that has it. Reachable slots are an end of the
    cycle's rows, so a layer is one running maximum from the last slot back.
    """
    layers = [f"{name}_{b}" for b in range(1, max_budget + 1) for name in ("ev", "v", "next")]
    columns = list(dict.fromkeys([*keys, *_inputs(max_budget)]))
    slot_type = slots.schema["slot"].dataType
    schema = _fields(slots, columns, *[StructField(n, slot_type if n.startswith("next") else DoubleType()) for n in layers])

    def solve(cycles: Cycles) -> pa.Table:
        out = cycles.take(columns, np.arange(cycles.rows))
        for name, values in _solved(cycles, max_budget, lead, min_ev).items():
            out = out.append_column(name, _nullable(values, cycles.table.schema.field("slot").type if name.startswith("next") else pa.float64()))
        return out

    return by_cycle(slots, keys, columns, schema, solve, in_order)


def with_costs(slots: DataFrame, max_budget: int = MAX_BUDGET) -> DataFrame:
    """cost_b for every number of attempts left, from the cycle's own budget."""
    spent = lambda b: F.greatest(F.col("budget") - b, F.lit(0))
    return slots.select(
        "*", *[attempt_cost(F.col("amount_paise"), spent(b)).alias(f"cost_{b}") for b in range(1, max_budget + 1)]
    )


def decide(slots: DataFrame | grids.SlotGrid, keys: list[str], max_budget: int = MAX_BUDGET, lead: int = LEAD_SLOTS, in_order: bool = False) -> DataFrame:
    """One row per cycle: the slot to present at (NULL means stop) and its expected value."""
    kept = list(dict.fromkeys([*keys, "amount_paise", "continuation_paise", "budget"]))
    schema = _fields(slots, kept, StructField("chosen_slot", slots.schema["slot"].dataType), StructField("value_paise", DoubleType()))

    def solve(cycles: Cycles) -> pa.Table:
        solved = _solved(cycles, max_budget, lead, 0.0)
        heads = np.flatnonzero(cycles.slot == 0)
        chosen, value = (_at(cycles, solved, name, max_budget)[heads] for name in ("next", "v"))
        out = cycles.take(kept, heads)
        return out.append_column("chosen_slot", _nullable(chosen, cycles.table.schema.field("slot").type)).append_column(
            "value_paise", _nullable(value, pa.float64()))

    return by_cycle(slots, keys, _inputs(max_budget), schema, solve, in_order)


def planned_slots(slots: DataFrame, keys: list[str], budget: int = 3, lead: int = LEAD_SLOTS, in_order: bool = False) -> DataFrame:
    """Follow the policy from slot 0: the presentations a cycle would make if each one failed."""
    slot_type = slots.schema["slot"].dataType
    schema = _fields(slots, keys, StructField("slots", ArrayType(slot_type)), StructField("stopped_early", BooleanType()))

    def solve(cycles: Cycles) -> pa.Table:
        solved = _solved(cycles, budget, lead, 0.0)
        heads = np.flatnonzero(cycles.slot == 0)
        at, steps = heads, []
        for left in range(budget, 0, -1):
            reached = np.where(at >= 0, solved[f"next_{left}"][at], np.nan)
            steps.append(reached)
            # The row of the reached slot; slots only grow, so it lies between the cycle's rows.
            wanted = np.where(np.isnan(reached), -1, reached)
            at = np.where(wanted < 0, -1, _row_of(cycles, cycles.cycle[heads], wanted.astype(np.int64)))
        grid = np.stack(steps, 1)
        made = ~np.isnan(grid)
        values = pa.array(grid[made].astype(np.int64)).cast(cycles.table.schema.field("slot").type)
        offsets = pa.array(np.append(0, np.cumsum(made.sum(1))).astype(np.int32))
        return cycles.take(keys, heads).append_column("slots", pa.ListArray.from_arrays(offsets, values)).append_column(
            "stopped_early", pa.array(~made[:, -1]))

    return by_cycle(slots, keys, _inputs(budget), schema, solve, in_order)


def _row_of(cycles: Cycles, cycle: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """The first row of a slot of a cycle."""
    width = int(max(cycles.slot.max(initial=0), slot.max(initial=0))) + 2
    return np.minimum(np.searchsorted(cycles.cycle * width + cycles.slot, cycle * width + slot), cycles.rows - 1)


def rank_candidates(slots: DataFrame, keys: list[str], top: int = 3, max_budget: int = MAX_BUDGET,
                    lead: int = LEAD_SLOTS, in_order: bool = False) -> DataFrame:
    """Best legal slots of a fresh decision with value, rank, chosen flag and margin to the next."""
    double = lambda name: StructField(name, DoubleType())
    kept = list(dict.fromkeys([*keys, "slot", "p"]))
    schema = _fields(slots, kept, double("ev_paise"), double("cost_paise"), slots.schema["continuation_paise"])

    def solve(cycles: Cycles) -> pa.Table:
        ev = _at(cycles, _solved(cycles, max_budget, lead, 0.0), "ev", max_budget)
        cost = _at(cycles, {f"cost_{b}": cycles.number(f"cost_{b}") for b in range(1, max_budget + 1)}, "cost", max_budget)
        rows = np.flatnonzero((cycles.slot >= lead) & ~np.isnan(ev))
        rows = rows[np.lexsort((cycles.slot[rows], -ev[rows], cycles.cycle[rows]))]
        own = cycles.cycle[rows]
        # One more than asked for, as the last one's margin is to the next.
        rows = rows[np.arange(len(rows)) - np.searchsorted(own, own) <= top]
        return cycles.take([*kept, "continuation_paise"], rows).append_column(
            "ev_paise", _nullable(ev[rows], pa.float64())).append_column("cost_paise", _nullable(cost[rows], pa.float64()))

    open_slots = by_cycle(slots, keys, _inputs(max_budget), schema, solve, in_order)
    order = Window.partitionBy(*keys).orderBy(F.col("ev_paise").desc(), "slot")
    ranked = open_slots.withColumn("rank", F.row_number().over(order)).withColumn(
        "margin_paise", F.col("ev_paise") - F.lead("ev_paise").over(order)
    )
    chosen = (F.col("rank") == 1) & (F.col("ev_paise") > F.col("continuation_paise"))
    return ranked.where(F.col("rank") <= top).withColumn("chosen", chosen).withColumn(
        "rationale",
        F.when(chosen, "chosen").when(F.col("rank") == 1, "stopped: best value does not clear the bar").otherwise("runner-up"),
    )


# ---------------------------------------------------------------- survival form


# A presentation at slot t' after a failure at t is worth
#
#     lost + q gain - cost  -  (1 / S(t)) q S(t') gain,     gain = amount + stay - lost,
#
# where ``lost`` is what a further failure at t' leaves. For every t' that is a line in 1/S(t), and 1/S
# grows with t. A line is asked for from 1/S(0) up to the last t that lies ``lead`` before it; one that a
# later line is no worse than at both ends is never the best, and few are left. Those are laid over
# all points, many cycles in step.

DEAD = 1e-9
CYCLES_AT_ONCE = 256  # a cycle's curves of 720 slots take 6 KB each


def _packed(kept: np.ndarray, *tables: tuple[np.ndarray, float]) -> list[np.ndarray]:
    """The kept cells of each row moved to its front, in order; others are filled."""
    row, at = np.nonzero(kept)
    count = kept.sum(1)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    packed = []
    for table, empty in tables:
        new = np.full((len(kept), int(count.max(initial=0))), empty, table.dtype)
        new[row, place] = table[row, at]
        packed.append(new)
    return packed


def _last_best(value: np.ndarray, newest: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For values that come one after another: whether each becomes the best (equal ones if newest), and who is best then (-1: none)."""
    before = np.concatenate([np.full((len(value), 1), -np.inf), np.maximum.accumulate(value, axis=1)[:, :-1]], 1)
    wins = value > before
    if newest is not None:
        wins |= (value == before) & newest & (value > -np.inf)
    return wins, np.maximum.accumulate(np.where(wins, np.arange(value.shape[1]), -1), axis=1)


def best_ahead(rise: np.ndarray, base: np.ndarray, points: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Per cycle and point the best value of the lines that may be asked there, -inf without one.

    Lines come by slot (base -inf: none); line j may be asked at points 0..reach[j].
    """
    # From the last slot back, as the later lines are there first.
    rise, base, reach = rise[:, ::-1], base[:, ::-1], reach[::-1]
    asked = (base > -np.inf) & (reach >= 0)
    first = points[:, :1]
    at_first = np.where(asked, rise * first + base, -np.inf)
    _, holder = _last_best(at_first)
    other = np.concatenate([np.full((len(base), 1), -1), holder[:, :-1]], 1)
    take = lambda table: np.take_along_axis(table, np.maximum(other, 0), 1)
    last = points[:, np.maximum(reach, 0)]
    beaten = (other >= 0) & (take(at_first) >= at_first) & (take(rise) * last + take(base) >= rise * last + base)
    kept = asked & ~beaten
    out = np.full(points.shape, -np.inf)
    lines = _packed(kept, (rise, 0.0), (base, -np.inf), (np.broadcast_to(reach, kept.shape), -1))
    count = kept.sum(1)
    order = np.argsort(count, kind="stable")
    for at in range(0, len(order), 32):  # cycles with about as many lines
        own = order[at : at + 32]
        x, top = points[own], out[own]
        for k in range(int(count[own].max(initial=0))):
            until = lines[2][own, k]
            n = int(until.max()) + 1
            value = lines[0][own, k, None] * x[:, :n] + lines[1][own, k, None]
            if (until != n - 1).any():
                value[np.arange(n) > until[:, None]] = -np.inf
            np.maximum(top[:, :n], value, out=top[:, :n])
        out[own] = top
    return out


def first_of_tied(rise: np.ndarray, base: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Per cycle which of the lines (by slot, base -inf: none) that are best at point 0 an upper envelope keeps.

    The envelope is a tree over the points; a node holds the line that is best in its middle, of equal
    ones the one that came last, and a loser goes on to the side where it is ahead at the end. Lines come
    from the last slot back; only the nodes on the way to point 0 matter, and each sees its lines at once.
    """
    depth = max(1, (points.shape[1] - 1).bit_length())
    x = lambda at: points[:, min(at, points.shape[1] - 1), None]
    there = base[:, ::-1] > -np.inf
    name = np.broadcast_to(np.arange(base.shape[1])[::-1], base.shape)
    rise, base, name, newest = _packed(there, (rise[:, ::-1], 0.0), (base[:, ::-1], -np.inf), (name, -1), (there, False))
    values, names = [], []
    for level in range(depth + 1):
        if not base.shape[1]:
            break
        span = 1 << (depth - level)
        half = span >> 1
        take = lambda table, at: np.take_along_axis(table, np.maximum(at, 0), 1)  # noqa: E731, B023 - used at once
        wins, holder = _last_best(rise * x(half) + base, newest)
        final = holder[:, -1:]
        values.append(np.where(final >= 0, take(rise, final) * x(0) + take(base, final), -np.inf))
        names.append(np.where(final >= 0, take(name, final), -1))
        if not half:
            break
        loser = np.where(wins, np.concatenate([np.full((len(base), 1), -1), holder[:, :-1]], 1), np.arange(base.shape[1]))
        fresh = newest & ~wins
        ahead = []
        for end in (x(0), x(span - 1)):
            ours, theirs = take(rise, loser) * end + take(base, loser), take(rise, holder) * end + take(base, holder)
            ahead.append((ours > theirs) | (fresh & (ours == theirs)))
        on = ahead[0] & ~ahead[1] & (loser >= 0) & (take(base, loser) > -np.inf)
        rise, base, name, newest = _packed(on, (take(rise, loser), 0.0), (take(base, loser), -np.inf), (take(name, loser), -1), (fresh, False))
    value, name = np.concatenate(values, 1), np.concatenate(names, 1)
    top = value.max(1)
    return np.where(value == top[:, None], name, np.iinfo(int).max).min(1)


def survival_plan(slot: np.ndarray, survival: np.ndarray, legal: np.ndarray, health: np.ndarray, dr: np.ndarray,
                  amount: np.ndarray, stay: np.ndarray, p_rec: np.ndarray, budget: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """First slot to present at (-1: none) and value per cycle; ``slot`` is shared, the rest is by cycle and slot."""
    n = len(slot)
    alive = survival > DEAD
    unit, keep = amount / 100.0, stay[:, None]
    value = np.repeat(keep, n, 1)
    first, worth = np.full(len(amount), -1), stay.copy()
    points = 1.0 / np.maximum(survival, DEAD)
    reach = slot >= slot[0] + lead
    # The last point from which a slot may be asked.
    until = np.searchsorted(slot, slot - lead, "right") - 1
    live = np.arange(len(amount))
    for left in range(1, int(budget.max(initial=0)) + 1):
        live = live[budget[live] >= left]
        spent = budget[live] - left
        cost = np.round(BASE_FEE + BETA_FRAUD * spent**2 * unit[live] + LAMBDA_ANNOYANCE * spent * unit[live])
        q = health[live] * p_rec[live, None]
        lost = value[live] - dr[live] * keep[live]
        gain = amount[live, None] + keep[live] - lost
        base = np.where(legal[live], lost + q * gain - cost[:, None], -np.inf)
        rise = np.where(legal[live], -q * survival[live] * gain, 0.0)
        last = spent == 0
        # A cycle's last layer is asked at its first slot only.
        own = live[last]
        ahead = np.where(base[last] > -np.inf, rise[last] * points[own, :1] + base[last], -np.inf)[:, reach]
        if len(own) and ahead.shape[1]:
            top = ahead.max(1)
            take = alive[own, 0] & (top > stay[own])
            first[own] = np.where(take, slot[reach][ahead.argmax(1)], -1)
            worth[own] = np.where(take, top, stay[own])
            # Of slots worth the same to the last digit, the one that an envelope of their lines keeps.
            tied = take & ((ahead == top[:, None]).sum(1) > 1)
            if tied.any():
                lines = [table[last][tied][:, reach] for table in (rise, base)]
                first[own[tied]] = slot[reach][first_of_tied(*lines, points[own[tied]])]
        more = live[~last]
        if not len(more):
            break
        top = best_ahead(rise[~last], base[~last], points[more], until)
        value[more] = np.where(alive[more] & (top > stay[more, None]), top, stay[more, None])
    return first, worth


def best_retry_slot_survival(slots: DataFrame | grids.SlotGrid, keys: list[str], lead: int = LEAD_SLOTS) -> DataFrame:
    """Absorbing variant: success depends on both the slot and the last failure.

    Needs ``survival`` (not growing with the slot), ``legal``, ``health`` and ``dr`` for every slot of a
    cycle's horizon. A cycle's slots form one row of arrays; cycles with the same slots are solved
    together, ``CYCLES_AT_ONCE`` at a time, on the best of lines. The cycles of a grid, which gives the
    logarithms of survival's factors as ``step``, go to Python without their slots.
    """
    fields = ("slot", "survival", "legal", "health", "dr")
    scalars = ("amount_paise", "continuation_paise", "p_rec", "budget")
    if isinstance(slots, grids.SlotGrid):
        return _survival_of_grid(slots, keys, scalars, lead)
    point = F.struct(F.col("slot").cast("int").alias("slot"), F.col("survival").cast("double").alias("survival"), "legal",
                     F.col("health").cast("double").alias("health"), F.col("dr").cast("double").alias("dr"))
    packed = slots.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("curve"), *[F.any_value(c).cast("double").alias(c) for c in scalars])
    rows = packed.select(*keys, *[F.col(f"curve.{f}").alias(f) for f in fields], *scalars)
    schema = StructType([*packed.select(*keys).schema.fields, StructField("chosen_slot", IntegerType()), StructField("value_paise", DoubleType())])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), CYCLES_AT_ONCE):
                batch = whole.slice(at, CYCLES_AT_ONCE)
                column = lambda c: batch.column(batch.schema.names.index(c))
                alike: dict[bytes, list[int]] = {}
                for i, own in enumerate(column("slot")):
                    alike.setdefault(own.values.to_numpy().tobytes(), []).append(i)
                chosen, value = np.full(len(batch), -1), np.zeros(len(batch))
                for shape, members in alike.items():
                    slot = np.frombuffer(shape, np.int32)
                    grid = [np.stack([column(f)[i].values.to_numpy(zero_copy_only=False) for i in members]) for f in fields[1:]]
                    facts = [column(c).to_numpy(zero_copy_only=False)[members] for c in scalars]
                    facts[-1] = facts[-1].astype(int)
                    chosen[members], value[members] = survival_plan(slot, *grid, *facts, lead)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(keys)], pa.array(chosen, pa.int32(), mask=chosen < 0), pa.array(value)], names=[f.name for f in schema])

    return rows.mapInArrow(solve, schema)


def _curves(columns: dict[str, np.ndarray], starts: np.ndarray, copies: int) -> tuple[np.ndarray, ...]:
    """Slots and, per key, survival, legality, health and loss; rows of one key share their slots' survival."""
    rows = starts[:, None] + np.arange(copies)
    # Slot by slot, the copies of a slot after one another.
    by_slot = {name: c[rows].transpose(0, 2, 1).reshape(len(starts), -1) for name, c in columns.items()}
    slot = np.repeat(np.arange(next(iter(columns.values())).shape[1], dtype=np.int32), copies)
    grid = [grids.survival_curve(by_slot["step"]), *[by_slot[f] for f in ("legal", "health", "dr")]]
    if copies > 1:
        order = np.lexsort((*grid[::-1], np.broadcast_to(slot, grid[0].shape)), axis=1)
        grid = [np.take_along_axis(g, order, 1) for g in grid]
    return slot, *grid


def _survival_of_grid(slots: grids.SlotGrid, keys: list[str], scalars: tuple[str, ...], lead: int) -> DataFrame:
    fill, horizon = slots.fill, slots.horizon
    schema = StructType([*(slots.schema[k] for k in keys), StructField("chosen_slot", IntegerType()), StructField("value_paise", DoubleType())])

    def solve(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        columns = fill(table, horizon)
        copies = np.diff(np.append(starts, len(table)))
        chosen, value = np.full(len(starts), -1), np.zeros(len(starts))
        for many in np.unique(copies):
            own = np.flatnonzero(copies == many)
            slot, *grid = _curves(columns, starts[own], many)
            facts = [table_floats(table.column(c))[starts[own]] for c in scalars]
            facts[-1] = facts[-1].astype(int)
            chosen[own], value[own] = survival_plan(slot, *grid, *facts, lead)
        named = table.select(keys).take(starts).combine_chunks().to_batches()[0]
        return pa.RecordBatch.from_arrays([*named.columns, pa.array(chosen, pa.int32(), mask=chosen < 0), pa.array(value)], names=[f.name for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            key = table.column("_key").to_numpy()
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            last = int(starts[-1])  # the last key may go on
            for at in range(0, len(starts) - 1, CYCLES_AT_ONCE):
                own = starts[at : at + CYCLES_AT_ONCE + 1]
                if own[-1] != last:
                    own, end = own[:CYCLES_AT_ONCE], int(own[-1])
                else:
                    own, end = own[:-1], last
                yield solve(table.slice(int(own[0]), end - int(own[0])), own - own[0])
            held = table.slice(last).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield solve(table, np.zeros(1, int))

    return slots.cycles.withColumn("_key", F.xxhash64(*keys)).mapInArrow(run, schema)


# ---------------------------------------------------------------- funding, replay, actions


def with_funding(cycles: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Attach a cycle's funding windows as half-open hour ranges (a handful per cycle)."""
    ranges = windows.groupBy(*keys).agg(F.collect_list(F.struct("lo", "hi")).alias("funding"))
    return cycles.join(ranges, keys, "left")


def funds_present(slot: Column) -> Column:
    hit = F.exists("funding", lambda w: (slot >= w["lo"]) & (slot < w["hi"]))
    return F.coalesce(hit, F.lit(False))


def empirical_hazards(cycles: DataFrame, horizon: int = 720) -> DataFrame:
    """Per hourly slot: funded over at risk, a cycle leaving the risk set once funded."""
    slot = F.floor((F.unix_seconds("recovered_at") - F.unix_seconds("due_at")) / 3600)
    known = F.when((slot >= 0) & (slot < horizon), slot)
    counted = cycles.groupBy(F.coalesce(known, F.lit(horizon - 1)).alias("slot")).agg(
        F.count("*").alias("leaves"), F.count_if(known.isNotNull()).alias("events")
    )
    grid = cycles.sparkSession.range(horizon).withColumnRenamed("id", "slot")
    filled = grid.join(counted, "slot", "left").na.fill(0)
    later = Window.orderBy(F.col("slot").desc()).rowsBetween(Window.unboundedPreceding, 0)
    risk = filled.withColumn("at_risk", F.sum("leaves").over(later))  # one row per slot
    raw = F.when(F.col("at_risk") > 0, F.col("events") / F.col("at_risk")).otherwise(0.0)
    return risk.select("slot", "events", "at_risk", F.least(F.greatest(raw, F.lit(1e-6)), F.lit(1 - 1e-6)).alias("hazard"))


def score_schedules(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Fired, denied and recovered per cycle for scheduled slots with ``legal`` and ``present``.

    Presentation stops at the first legal slot with money; what follows never happens.
    """
    hit = F.min(F.when(F.col("legal") & F.col("present"), F.col("slot")))
    first = attempts.groupBy(*keys).agg(
        hit.alias("hit"), F.collect_list(F.struct("slot", "legal")).alias("plan")
    )
    reached = F.filter("plan", lambda a: F.coalesce(a["slot"] <= F.col("hit"), F.lit(True)))
    return first.select(
        *keys,
        F.col("hit").isNotNull().alias("recovered"),
        F.size(F.filter(reached, lambda a: a["legal"])).alias("fired"),
        F.size(F.filter(reached, lambda a: ~a["legal"])).alias("denied"),
    )


def scheduled_actions(decisions: DataFrame, spread: int = 300) -> DataFrame:
    """Debit rows with idempotency key and jitter for cycles that have a chosen slot."""
    key = hashing.idem_key(F.col("cycle_ref"), F.col("attempts_used") + 1, F.lit("debit_attempt"), F.col("amount_paise"))
    planned = decisions.where("chosen_slot IS NOT NULL").withColumn("idem_key", key)
    fire = legality.slot_time(F.col("decided_at"), F.col("chosen_slot"))
    return planned.withColumn("fire_at", fire).withColumn("jitter_s", hashing.jitter_seconds(F.col("idem_key"), spread))


def choose_channel(preferred: Column, dnd: Column) -> Column:
    return F.when(dnd, "whatsapp").when(preferred.isin("sms", "whatsapp"), preferred).otherwise("sms")


def notice_fields(rows: DataFrame) -> DataFrame:
    """Channel, header, opt-out path and, on elevated risk, a pay-now link."""
    ref = F.col("mandate_id").cast("string")
    return rows.select(
        "*", choose_channel(F.col("preferred"), F.col("dnd")).alias("channel"), F.lit("160").alias("header_series"),
        F.concat(F.lit("/v1/mandates/"), ref, F.lit("/opt-out")).alias("opt_out_path"),
        F.when(F.col("risk") >= 0.5, F.concat(F.lit("/v1/cycles/"), ref, F.lit("/pay"))).alias("pay_now_link"),
    )
