"""Centroid clustering, suffix-array dedup and conversation repair against brute force."""

import hashlib
import itertools
import math
import random
import zlib

import duckdb
import numpy as np
import pytest

from redebit.llm import centroid_clusters, conversation_repair, suffix_dedup
from tests.llm import fixtures


# Centroid clustering ---------------------------------------------------------------------------


def kmeans(rows, k, rounds, seed, dimensions, scale):
    kept = []
    for vec_id, x in rows:
        if x is None or len(x) != dimensions or any(c is None or not math.isfinite(c) for c in x):
            continue
        kept.append((vec_id, [max(-(1 << 27), min(1 << 27, math.floor(float(np.float32(c)) * scale))) for c in x]))
    hashed = lambda v: hashlib.sha256(f"{seed}:{'' if v is None else v}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashed(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centroids)]
    out = [(vec_id, *nearest(v)[::-1]) for vec_id, v in kept]
    return sorted(out, key=str), centroids


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, 1, "clash", 2) for i, x in rows], "vec_id long, embedding array<float>, n int, data string, place int")


@pytest.mark.parametrize("block_rows", [3, 512])
def test_clusters_equal_a_literal_loop(spark, block_rows):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(i % 3, 0.3) for _ in range(5)]) for i in range(150)]
    rows += [(i, [0.5] * 5) for i in range(200, 240)] + [(7, [0.25] * 5), (7, [0.25] * 5), (None, [1.0] * 5)]
    rows += [(300, None), (301, []), (302, [1.0] * 4), (303, [None] + [1.0] * 4), (304, [math.nan] * 5), (305, [math.inf] * 5), (306, [1e30, -1e30, 0.0, 0.0, 0.0])]
    got, centroids = centroid_clusters.clusters(vectors(spark, rows).repartition(3), k=4, rounds=5, dimensions=5, block_rows=block_rows)
    want, final = kmeans(rows, 4, 5, centroid_clusters.SEED, 5, centroid_clusters.SCALE)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert centroids.tolist() == final


def test_few_vectors_and_empty_table(spark):
    few = centroid_clusters.cluster_vectors(vectors(spark, [(1, [0.5] * 64), (2, [0.25] * 64)])).collect()
    assert sorted(r.distance for r in few) == [0, 0] and {r.inertia for r in few} == {0}
    none = centroid_clusters.cluster_vectors(vectors(spark, [(1, None)]))
    assert none.count() == 0 and "centroid_sha256" in none.columns


def test_curve_is_a_hilbert_curve():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    index = centroid_clusters.hilbert(cells, 3)
    assert sorted(index) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(1) == 1).all()


def test_boxes_rule_out_most_centroids_where_vectors_form_groups(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (8, 16))
    rows = [(i, (centres[i % 8] + rng.normal(0, 0.05, 16)).tolist()) for i in range(4000)]
    made = centroid_clusters.integers(vectors(spark, rows), dimensions=16)
    blocks = centroid_clusters.blocks_along_curve(made, 16, 64).collect()
    ints = np.floor(centres * centroid_clusters.SCALE).astype(np.int64)
    left = [len(centroid_clusters.candidates(*(np.frombuffer(x, np.int32).astype(np.int64) for x in (b.low, b.high)), ints)) for b in blocks]
    assert sum(b.n for b in blocks) == 4000 and np.mean(left) < 2


def test_box_bound_never_drops_the_nearest():
    rng = np.random.default_rng(8)
    for _ in range(200):
        m = rng.integers(-6, 6, (rng.integers(1, 6), 3))
        c = rng.integers(-6, 6, (5, 3))
        every = np.arange(5)
        own, distance = centroid_clusters.nearest(m, c, every)
        some = centroid_clusters.candidates(m.min(0), m.max(0), c)
        again, same = centroid_clusters.nearest(m, c, some)
        assert (own == again).all() and (distance == same).all()


# Suffix-array dedup ----------------------------------------------------------------------------


def repeated_bytes(texts, match):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for b in data:
        for i in range(len(b) - match + 1):
            seen[b[i : i + match]] = seen.get(b[i : i + match], 0) + 1
    out = []
    for b in data:
        cut = bytearray(len(b))
        for i in range(len(b) - match + 1):
            if seen[b[i : i + match]] > 1:
                cut[i : i + match] = b"\1" * match
        spans = sum(1 for i in range(len(b)) if cut[i] and (i == 0 or not cut[i - 1]))
        out.append((len(b), sum(cut), spans, hashlib.sha256(bytes(x for x, c in zip(b, cut) if not c)).hexdigest()))
    return out


def shared_texts():
    """Passages of two depths inside texts, edits, exact copies, periodic and tiny texts."""
    rng = random.Random(1)
    some = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    base, inner = some(300), some(60)
    base = base[:100] + inner + base[100:]
    texts = [None, "", "x" * 300, "ab" * 200, "x" * 39, "x" * 40, inner, some(20) + inner + some(20)]
    for _ in range(40):
        a = rng.randrange(300)
        texts.append(some(rng.randrange(60)) + base[a : a + rng.randrange(10, 200)] + some(rng.randrange(80)))
    for _ in range(15):
        edited = list(base)
        edited[rng.randrange(300)] = "Z"
        texts.append("".join(edited))
    return texts + [base] * 3


@pytest.mark.parametrize("match, anchor, chunk, piece, batches", [(40, 12, 1024, 1 << 18, 4), (40, 12, 3, 1 << 18, 5), (25, 8, 2, 50, 1), (60, 60, 1, 64, 3)])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, match, anchor, chunk, piece, batches):
    monkeypatch.setattr(suffix_dedup, "CHUNK_REGIONS", chunk)
    monkeypatch.setattr(suffix_dedup.chosen, "__defaults__", (piece,))
    texts = shared_texts()
    rows = [(None if i == 9 else i, t, "clash", 1, b"x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, anchor int, data binary").repartition(5)
    got = suffix_dedup.dedup_documents(docs, match=match, anchor=anchor, batches=batches).collect()
    want = [(None if i == 9 else i, *w) for i, w in enumerate(repeated_bytes(texts, match))]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_dedup_of_a_long_text_and_of_an_empty_table(spark):
    long = fixtures.prose(5, 40_000)
    docs = spark.createDataFrame([(1, long), (2, "y" + long[1000:3000]), (3, fixtures.prose(6, 50))], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.dedup_documents(docs).collect()}
    assert (got[1].n_removed, got[1].n_spans) == (2000, 1) and (got[2].n_removed, got[3].n_removed) == (2000, 0)
    assert suffix_dedup.dedup_documents(fixtures.empty(spark)).count() == 0


def test_levels_double_and_hold_each_suffix_once(spark):
    texts = suffix_dedup.keyed(spark.createDataFrame([(i, t) for i, t in enumerate(shared_texts())], "doc_id long, text string"))
    every = suffix_dedup.suffixes(texts, 40, 12, 7).cache()
    family = suffix_dedup.SuffixFamily(spark)
    seen = set()
    for b in range(7):
        own = every.where(f"batch = {b}")
        found = {r.anchor for r in family.add(own).collect()}
        anchors = [r.anchor for r in own.collect()]
        assert found == {a for a in anchors if anchors.count(a) > 1 or a in seen}
        seen |= set(anchors)
    assert [size for size, _ in family.levels] == [2, 1, 0]
    sums = [spark.table(name).agg({"n": "sum"}).first()[0] or 0 for _, name in family.levels]
    assert sum(sums) == every.count()
    plan = spark.table(family.levels[0][1]).join(spark.table(family.levels[1][1]).select(*family.ORDER), [*family.ORDER])
    assert "Exchange hashpartitioning" not in plan._jdf.queryExecution().executedPlan().toString()
    family.close()


# Conversation repair ---------------------------------------------------------------------------


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def facts(rows):
    """Faults of one conversation's rows after damage, in order."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        tail = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else "")
        seen.add((role, text))
    return faults


def every_repair(rows, faults, most):
    """The cheapest (cost, audit, turns) by trying all edits, with at most ``most`` inserts in one place."""
    legal = lambda roles: roles == "" or bool(__import__("re").fullmatch("s?(ua)+", roles))
    inserts = ["", *("".join(x) for n in range(1, most + 1) for x in itertools.product("ua", repeat=n))]
    best = None
    options = []
    for (_, _, role, _), fault in zip(rows, faults):
        own = [(2, "D", None)]
        if fault in ("", "truncated"):
            extra = 5 if fault else 0
            own += [(extra, "K", role[:1] or "?")] + [(extra + 1, "R", x) for x in "ua"]
        options.append(own)
    for picks in itertools.product(*options):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            cost, audit, roles, turns = 0, "", "", []
            for i, gap in enumerate(gaps):
                cost, audit, roles = cost + 5 * len(gap), audit + "I" * len(gap), roles + gap
                turns += [("user" if g == "u" else "assistant", "") for g in gap]
                if i < len(picks):
                    c, edit, initial = picks[i]
                    cost, audit = cost + c, audit + edit
                    if edit != "D":
                        roles += initial
                        name = rows[i][2] if edit == "K" else "user" if initial == "u" else "assistant"
                        turns.append((name, rows[i][3]))
            if legal(roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, turns)
    return best


def conversations(seed, count, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " ", "What?", "And then\n", None, "End. "]
    out = []
    for conv in range(count):
        for turn in range(rng.randrange(1, most + 1)):
            out.append((conv, None if rng.random() < 0.1 else turn + rng.randrange(2), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts)))
    return out + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho.")]


KIND = "conv_id long, turn long, role string, text string, key string, part string, cost string"


def repaired(spark, rows):
    table = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], KIND).repartition(3)
    return {r.conv_id: r for r in conversation_repair.repair_conversations(table).collect()}


def by_conversation(rows):
    out = {}
    for r in damage(rows):
        out.setdefault(r[0], []).append(r)
    for own in out.values():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    return out


@pytest.mark.parametrize("segment_rows, fan_in", [(64, 64), (1, 2), (2, 2)])
def test_repairs_equal_trying_everything(spark, monkeypatch, segment_rows, fan_in):
    monkeypatch.setattr(conversation_repair, "SEGMENT_ROWS", segment_rows)
    monkeypatch.setattr(conversation_repair, "FAN_IN", fan_in)
    rows = conversations(11, 60, 3)
    got, after = repaired(spark, rows), by_conversation(rows)
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        own = after.get(conv, [])
        faults = facts(own)
        cost, audit, turns = every_repair(own, faults, 1 if len(own) > 2 else 2)
        turn = [x[1] for x in own if x[1] is not None]
        pairs = [x[2][:1] + y[2][:1] for x, y in zip(own, own[1:])]
        want = (conv, max(turn) - min(turn) + 1 - len(set(turn)) if turn else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                hashlib.sha256("\n".join(f"{a}:{b}" for a, b in turns).encode()).hexdigest())
        assert tuple(r) == want, own


def test_long_conversations_equal_the_sql(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "SEGMENT_ROWS", 16)
    monkeypatch.setattr(conversation_repair, "FAN_IN", 2)
    rng = random.Random(5)
    rows = conversations(3, 40, 9)
    rows += [(1000, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Yes.", f"So {t}.", f"cut {t}"])) for t in range(900)]
    got = repaired(spark, rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = {r[0]: r for r in con.execute(conversation_repair.oracle()).fetchall()}
    assert {k: tuple(v) for k, v in got.items()} == want


def test_search_is_quick_on_the_worst_segment():
    rng = random.Random(2)
    rows = [(rng.choice("uas "), rng.choice([0, 0, 3, 1])) for _ in range(64)]
    whole = conversation_repair.answers_of(rows, True)[0]
    table = conversation_repair.answers_of(rows, False)
    ends = [(x["cost"], x["audit"]) for x in table if x["origin"] == 0 and x["goal"] in conversation_repair.COMPLETE]
    assert (whole["cost"], whole["audit"]) == min(ends)


def test_no_conversations(spark):
    assert conversation_repair.repair_conversations(spark.createDataFrame([], KIND)).count() == 0
