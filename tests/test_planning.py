"""The slot decision against exhaustive search, and the other planning rules."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from redebit.operators import planning

LEAD = 2


def instance(rng, cycle, horizon=12, budget=3):
    return {
        "id": cycle, "budget": budget, "amount": rng.randrange(1_000, 90_000), "w": rng.randrange(10_000, 300_000),
        "slots": [(s, round(rng.random(), 3), round(rng.random() * 0.2, 3), rng.random() < 0.6) for s in range(1, horizon)],
    }


def cost(inst, b):
    spent = max(inst["budget"] - b, 0)
    raw = 300 + 0.4 * spent * spent * inst["amount"] / 100 + spent * inst["amount"] / 100
    return round(raw)


def search(inst, b, t):
    """Plain recursion: (value, slot) of the best decision with b attempts left after slot t."""
    if b == 0:
        return inst["w"], None
    best = None
    for slot, p, dr, legal in inst["slots"]:
        if not legal or slot < t + LEAD:
            continue
        later, _ = search(inst, b - 1, slot)
        ev = p * (inst["amount"] + inst["w"]) + (1 - p) * (later - dr * inst["w"]) - cost(inst, b)
        if best is None or ev > best[0]:
            best = (ev, slot)
    if best is None or best[0] <= inst["w"]:
        return inst["w"], None
    return best


@pytest.mark.parametrize("budget", [1, 2, 3])
def test_best_slot_equals_exhaustive_search(spark, budget):
    rng = random.Random(budget)
    many = [instance(rng, i, budget=budget) for i in range(25)]
    data = []
    for inst in many:
        data.append((inst["id"], 0, 0.0, 0.0, False, inst["amount"], inst["w"], budget))
        data += [(inst["id"], s, p, dr, True, inst["amount"], inst["w"], budget) for s, p, dr, legal in inst["slots"] if legal]
    slots = spark.createDataFrame(
        data, "cycle_id int, slot int, p double, dr double, legal boolean, amount_paise bigint, continuation_paise bigint, budget int"
    )
    got = {r["cycle_id"]: r for r in planning.decide(planning.with_costs(slots), ["cycle_id"], lead=LEAD).collect()}
    for inst in many:
        value, slot = search(inst, budget, 0)
        assert got[inst["id"]]["chosen_slot"] == slot
        assert got[inst["id"]]["value_paise"] == pytest.approx(value)


def test_planned_slots_follow_the_policy(spark):
    rng = random.Random(9)
    many = [instance(rng, i, horizon=16) for i in range(20)]
    data = []
    for inst in many:
        data.append((inst["id"], 0, 0.0, 0.0, False, inst["amount"], inst["w"], 3))
        data += [(inst["id"], s, p, dr, True, inst["amount"], inst["w"], 3) for s, p, dr, legal in inst["slots"] if legal]
    slots = spark.createDataFrame(
        data, "cycle_id int, slot int, p double, dr double, legal boolean, amount_paise bigint, continuation_paise bigint, budget int"
    )
    got = {r["cycle_id"]: r["slots"] for r in planning.planned_slots(planning.with_costs(slots), ["cycle_id"], lead=LEAD).collect()}
    for inst in many:
        want, t = [], 0
        for b in (3, 2, 1):
            _, slot = search(inst, b, t)
            if slot is None:
                break
            want.append(slot)
            t = slot
        assert got[inst["id"]] == want


def search_survival(s, legal, health, dr, amount, w, p_rec, budget, lead):
    h = len(s)
    value = [float(w)] * h
    best_slot = None
    for b in range(1, budget + 1):
        spent = budget - b
        c = round(300 + 0.4 * spent**2 * amount / 100 + spent * amount / 100)
        nxt, pick = list(value), [None] * h
        for t in range(h):
            best = None
            for x in range(t + lead, h):
                if not legal[x]:
                    continue
                p = (1 - s[x] / s[t]) * health[x] * p_rec
                ev = p * (amount + w) + (1 - p) * (value[x] - dr[x] * w) - c
                if best is None or ev > best[0]:
                    best = (ev, x)
            nxt[t] = float(w)
            if best and best[0] > w:
                nxt[t], pick[t] = best
        value, best_slot = nxt, pick[0]
    return best_slot, value[0]


def test_survival_form_equals_the_literal_loop(spark):
    rng = np.random.default_rng(4)
    data, want = [], {}
    for i in range(15):
        h = 30
        s = np.cumprod(1 - rng.random(h) * 0.15)
        legal, health, dr = rng.random(h) < 0.6, np.where(rng.random(h) < 0.2, 0.15, 1.0), rng.random(h) * 0.05
        amount, w, budget = int(rng.integers(10_000, 90_000)), int(rng.integers(10_000, 90_000)), int(rng.integers(1, 4))
        want[i] = search_survival(s, legal, health, dr, amount, w, 0.9, budget, 3)
        data += [(i, t, float(s[t]), bool(legal[t]), float(health[t]), float(dr[t]), amount, w, 0.9, budget) for t in range(h)]
    slots = spark.createDataFrame(
        data, "cycle_id int, slot int, survival double, legal boolean, health double, dr double, amount_paise bigint, continuation_paise bigint, p_rec double, budget int"
    )
    for r in planning.best_retry_slot_survival(slots, ["cycle_id"], lead=3).collect():
        slot, value = want[r["cycle_id"]]
        assert r["chosen_slot"] == slot and r["value_paise"] == pytest.approx(value)


def test_scoring_stops_at_the_first_success(spark):
    data = [
        (1, 30, True, False), (1, 60, False, True), (1, 80, True, True), (1, 120, True, True),  # denied, then paid at 80
        (2, 30, False, False), (2, 60, True, False),  # never paid
    ]
    df = spark.createDataFrame(data, "cycle_id int, slot int, legal boolean, present boolean")
    got = {r["cycle_id"]: (r["recovered"], r["fired"], r["denied"]) for r in planning.score_schedules(df, ["cycle_id"]).collect()}
    assert got == {1: (True, 2, 1), 2: (False, 1, 1)}


def test_every_hard_stop_is_reported(spark):
    df = spark.range(1).select(planning.hard_stops(
        F.lit("mandate_dead"), F.lit("paused"), F.lit(True), F.lit(4), F.lit(4),
        F.timestamp_seconds(F.lit(10)), F.timestamp_seconds(F.lit(20)),
    ).alias("s"))
    assert df.first()["s"] == ["terminal_cause", "mandate_not_active", "customer_opted_out", "budget_exhausted", "past_deadline"]


def test_attempt_cost_rounds_half_to_even(spark):
    rows = spark.createDataFrame([(125, 1), (375, 1), (49_900, 0)], "a bigint, k int")
    got = [r[0] for r in rows.select(planning.attempt_cost(F.col("a"), F.col("k"))).collect()]
    assert got == [round(300 + 0.4 * 1.25 + 1.25), round(300 + 0.4 * 3.75 + 3.75), 300]


def test_layers_over_cycles_in_order_equal_those_of_any_rows(spark):
    """Rows that explode leaves in order need neither shuffle nor sort, and give what sorted rows give."""
    from pyspark.sql import functions as F

    facts = spark.range(40).select(
        F.col("id").alias("cycle_id"), F.lit(0.04).alias("dr"), (F.col("id") * 1000 + 500).alias("amount_paise"),
        (F.col("id") * 9000).cast("double").alias("continuation_paise"), (F.col("id") % 4).cast("int").alias("budget"))
    slots = planning.with_costs(facts).select("*", F.explode(F.sequence(F.lit(0), F.lit(60))).alias("slot"))
    slots = slots.withColumn("legal", (F.col("slot") > 0) & (F.col("slot") % 3 != 0)).where("legal OR slot = 0").withColumn("p", (F.col("slot") * 7 % 11) / 11)
    for solve in (planning.decide, planning.planned_slots, planning.rank_candidates):
        plain, ordered = (solve(slots, ["cycle_id"], lead=5, in_order=flag) for flag in (False, True))
        assert sorted(map(str, plain.collect())) == sorted(map(str, ordered.collect()))
        assert "Exchange" not in planning.decide(slots, ["cycle_id"], in_order=True)._jdf.queryExecution().toString()


def test_grids_of_slots_give_what_rows_of_slots_give(spark):
    """Cycles without amount, rail, category or seen segment, and cycles that come twice, on both forms."""
    import datetime as dt

    from redebit.functions import calendar as cal
    from redebit.operators import grids, legality, priors
    from redebit.plans import planning as plans

    rng = random.Random(3)
    pick = lambda *x: rng.choice(x)
    due = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(80 * 86_400))
    made = [(i, pick("5815", "7997", "new", None), pick("upi_autopay", "card_emandate", "enach", None), pick(None, 90_000, 700_000, rng.randrange(2_000_000)),
             due(), rng.choice([0.06, 0.9, 1.0]), pick(1, 2, 3)) for i in range(120)]
    cycles = spark.createDataFrame(made + made[:25], "cycle_id int, mcc string, rail string, amount_paise bigint, due_at timestamp, p_rec double, budget int")
    learned = spark.createDataFrame(
        [(m, t, r, d, b, rng.randrange(2, 40), rng.random() * 0.5) for m in ("5815", "7997") for t in (0, 2, 3) for r in ("upi_autopay", "enach")
         for d in range(1, 32) for b in range(5) if rng.random() < 0.8],
        "mcc string, ticket_band int, rail string, day_of_month int, hour_band int, n_obs int, hazard double")
    stay = (F.col("amount_paise") * planning.W_MULTIPLE).alias("continuation_paise")
    legal = legality.harness_legal(F.col("rail"), F.col("due_at"), F.col("slot"), days=30)

    slots = legality.explode_slots(priors.with_curve(cycles, learned), ["cycle_id"], 720)
    at = legality.slot_time(F.col("due_at"), F.col("slot"))
    hourly = priors.band_to_hourly(priors.slot_presence(at), cal.hour_band(at))
    curves = priors.survival_curve(slots.withColumn("hazard", hourly), ["cycle_id"], "hazard")
    rows = curves.select("cycle_id", "slot", "survival", legal.alias("legal"), F.lit(1.0).alias("health"), F.lit(planning.DELTA_R).alias("dr"),
                         "amount_paise", stay, "p_rec", "budget")
    facts = grids.with_cells(cycles, learned, plans.hourly_step).select("cycle_id", "rail", "due_at", "cells", "amount_paise", stay, "p_rec", "budget")
    grid = grids.slot_grid(facts, ["cycle_id"], 720, plans.survival_fill, together=True)
    plain, fast = (sorted(map(str, planning.best_retry_slot_survival(s, ["cycle_id"]).collect())) for s in (rows, grid))
    assert len(plain) == 120 and plain == fast

    costed = planning.with_costs(cycles, 3)
    rows = plans.decision_slots(costed, learned, ["cycle_id"])
    facts = costed.withColumn("dr", F.lit(planning.DELTA_R)).withColumn("continuation_paise", F.col("amount_paise") * planning.W_MULTIPLE)
    grid = plans.decision_grid(facts, learned, ["cycle_id"])
    for solve in (planning.decide, planning.planned_slots):
        plain, fast = (sorted(map(str, x.collect())) for x in (solve(rows, ["cycle_id"], 3, in_order=True), solve(grid, ["cycle_id"], 3)))
        assert plain == fast and len(plain) == 145


def test_exponential_has_the_bits_of_spark(spark):
    from redebit.operators import grids

    rng = np.random.default_rng(5)
    x = np.concatenate([-rng.random(4000) * s for s in (1e-8, 0.4, 2, 40, 760)] + [np.array([0.0, -0.34657359027997264, -1.03972077083992, -745.2, -9000.0])])
    want = [r[0] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(F.exp("x")).collect()]
    assert (grids.strict_exp(x) == np.array(want)).all()
