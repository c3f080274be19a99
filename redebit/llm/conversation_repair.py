"""Cheapest repair of damaged conversations by depth-first branch-and-bound.

A conversation should have role initials ``(s?(ua)+)?``: perhaps a system turn, then user and
assistant in turn. Its rows, in order, are kept, given another role, or deleted, and empty turns
may be inserted, at the costs below. Of the cheapest repairs the one with the ASCII-least audit
(initials of the edits) is taken; audit and rows determine the repaired conversation.

**Search.** A node is a row number, a state of the role pattern, a cost and an audit so far. The
search keeps an explicit stack, cheapest child on top, and an incumbent (cost, audit) per goal. A
node is cut where its cost plus the suffix lower bound (what each later row costs at least, whatever
the roles around it) exceeds the incumbent, or equals it with a greater audit; a table per row and
state keeps the best prefix, and worse ones are eliminated: prefixes that have used up the same
rows at the same cost differ before either ends, so the lesser stays the lesser. The search ends when
the stack is empty, which proves the incumbent optimal.

**Scale.** Rows are sorted by conversation and turn over range partitions, so a conversation of
any length is spread over tasks. Each partition cuts its conversations into segments of at most
``SEGMENT_ROWS`` rows. A segment that is a whole conversation is searched from the first state; one
of several is searched from every state to every state, and its answers compose associatively:
segments are merged in groups of ``FAN_IN`` per level. Duplicates are found by the least row number
per (conversation, role, text), which combines before the shuffle. Only SHA-256 of the repaired
text is sequential by its nature: rows stream through a sorted partition with one hash state.

Edge cases: a null in conv_id or turn counts as one space in the damage key, a null role or text is
one space. Rows with a null conv_id form one conversation. Null turns sort first and take no part in
the gaps. Rows of one turn are taken by role, then text. A conversation without rows after damage gives
zeros, an empty audit and the hash of the empty string. Roles with other initials, or empty ones, are
never kept as they are. An empty table gives no rows. Columns of other names are not read. Whole texts stay
out of the search, which sees initials and faults only.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redebit.llm.common import stored

SEGMENT_ROWS, FAN_IN = 64, 64
WORD, END = r"[^\x20\x09-\x0D]", ".!?"
DELETE, INSERT, KEEP, REROLE = "DIKR"
DELETE_COST, INSERT_COST, REROLE_COST, CUT_COST = 2, 5, 1, 5

#: States of the role pattern: nothing yet, after a system turn, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
COMPLETE = (START, ASSISTANT)
STATES = (START, SYSTEM, USER, ASSISTANT)
LEGAL = ("su", "ua", "au")
#: Faults of a row; the first that holds counts.
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)

PLACE_BITS = 33
ROWS = "conv_id {0}, turn long, role string, text string, key binary, place long, part long, segment long, turn_step int"
ANSWERS = "array<struct<origin int, goal int, cost long, audit string>>"
SEGMENT = (
    "conv_id {0}, part long, segment long, low long, high long, turns long, blank long, duplicate long, truncated long, "
    "illegal long, first string, last string, whole boolean, answers " + ANSWERS
)


def or_space(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows after damage; a repeated row comes twice."""
    own = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), or_space(F.col("role")).alias("role"), or_space(F.col("text")).alias("text"))
    key = F.concat_ws(":", or_space(F.col("conv_id")), or_space(F.col("turn")))
    kind = F.crc32(key.cast("binary")) % 20
    return own.withColumn("kind", kind).where("kind != 0").select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def placed(rows: DataFrame) -> DataFrame:
    """Rows in order with their place, segment and whether a new turn begins there, in the shared folder.

    ``segment`` counts the segments of a conversation within a partition (``part``).
    """
    kind = rows.schema["conv_id"].dataType.simpleString()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        place, held, at, before = part << PLACE_BITS, object(), 0, None
        for batch in batches:
            places, segments, steps = [], [], []
            for conv, turn in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if conv != held:
                    held, at, before = conv, 0, None
                places.append(place)
                segments.append(at // SEGMENT_ROWS)
                # A segment begins its own count of turns; merging takes off what two share.
                steps.append(int(turn is not None and (turn != before or at % SEGMENT_ROWS == 0)))
                place, at, before = place + 1, at + 1, turn
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(places, pa.int64()), pa.array([part] * len(batch), pa.int64()),
                 pa.array(segments, pa.int64()), pa.array(steps, pa.int32())],
                names=["conv_id", "turn", "role", "text", "key", "place", "part", "segment", "turn_step"])

    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    # The ranges are cut by the head of a text, so that whole sampled texts do not reach the driver.
    ranged = rows.withColumn("key", key).repartitionByRange(F.col("conv_id"), F.col("turn").asc_nulls_first(), F.substring("role", 1, 64), F.substring("text", 1, 64))
    return stored(ranged.sortWithinPartitions(*order).mapInArrow(number, ROWS.format(kind)))


def with_faults(rows: DataFrame) -> DataFrame:
    """conv_id, part, segment, place, turn, turn_step, initial and fault of every placed row."""
    firsts = rows.groupBy("conv_id", "key").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("_first"))
    tail = F.regexp_extract("text", rf"(?s)({WORD})[\x20\x09-\x0D]*\z", 1)
    slim = rows.select("conv_id", "part", "segment", "place", "turn", "turn_step", F.substring("role", 1, 1).alias("initial"), tail.alias("_tail"))
    fault = (
        F.when(F.col("_tail") == "", BLANK).when(F.col("_first").isNull(), DUPLICATE)
        .when(~F.col("_tail").isin(*END), TRUNCATED).otherwise(NONE)
    )
    return slim.join(firsts, "place", "left").withColumn("fault", fault).drop("_tail", "_first")


def choices(initial: str, fault: int, state: int) -> Iterator[tuple[int, str, int]]:
    """Edits of a row from a state: (cost, edit, next state)."""
    yield DELETE_COST, DELETE, state
    if fault in (NONE, TRUNCATED):
        cut = CUT_COST if fault == TRUNCATED else 0
        if (state, initial) in NEXT:
            yield cut, KEEP, NEXT[state, initial]
        for role in "ua":
            if (state, role) in NEXT:
                yield cut + REROLE_COST, REROLE, NEXT[state, role]


def suffix_bounds(rows: list[tuple[str, int]]) -> list[int]:
    """What the rows from each number on cost at least, whatever the roles around them."""
    bound = [0]
    for initial, fault in reversed(rows):
        least = min(cost for state in STATES for cost, _, _ in choices(initial, fault, state))
        bound.append(bound[-1] + least)
    return bound[::-1]


def search(rows: list[tuple[str, int]], origin: int, goals: dict[int, int]) -> dict[int, tuple[int, str]]:
    """Best (cost, audit) per goal from ``origin`` over (initial, fault) rows; ``goals`` maps end states to goals."""
    bound, n = suffix_bounds(rows), len(rows)
    incumbent: dict[int, tuple[int, str]] = {}
    best: dict[tuple[int, int], tuple[int, str]] = {(0, origin): (0, "")}
    wanted = set(goals.values())
    stack = [(0, origin, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if best[i, state] != (cost, audit) or not open_goals(incumbent, wanted, cost + bound[i], audit):
            continue
        if i == n and state in goals and (cost, audit) < incumbent.get(goals[state], (cost + 1, "")):
            incumbent[goals[state]] = (cost, audit)
        children = [(i, NEXT[state, r], cost + INSERT_COST, audit + INSERT) for r in "ua" if (state, r) in NEXT]
        if i < n:
            children += [(i + 1, after, cost + c, audit + edit) for c, edit, after in choices(*rows[i], state)]
        kept = []
        for child in children:
            node, value = child[:2], child[2:]
            if node not in best or value < best[node]:
                best[node] = value
                kept.append(child)
        kept.sort(key=lambda x: (x[2] + bound[x[0]], x[3]), reverse=True)
        stack += kept
    return incumbent


def open_goals(incumbent: dict[int, tuple[int, str]], wanted: set[int], least: int, audit: str) -> bool:
    """Whether a prefix whose cost is at least ``least`` may still improve some goal."""
    for goal in wanted:
        if goal not in incumbent:
            return True
        cost, found = incumbent[goal]
        if least < cost or least == cost and audit <= found[: len(audit)]:
            return True
    return False


def answers_of(rows: list[tuple[str, int]], whole: bool) -> list[dict]:
    """Answers of a segment: of a whole conversation from the start to a complete end, else between all states."""
    asked = [(START, {g: START for g in COMPLETE})] if whole else [(o, {s: s for s in STATES}) for o in STATES]
    return [
        {"origin": origin, "goal": goal, "cost": cost, "audit": audit}
        for origin, goals in asked for goal, (cost, audit) in search(rows, origin, goals).items()
    ]


def composed(left: Iterable[dict], right: Iterable[dict]) -> list[dict]:
    """Answers of two neighbouring segments as one."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    after: dict[int, list[dict]] = {}
    for y in right:
        after.setdefault(y["origin"], []).append(y)
    for x in left:
        for y in after.get(x["goal"], ()):
            key, value = (x["origin"], y["goal"]), (x["cost"] + y["cost"], x["audit"] + y["audit"])
            if key not in best or value < best[key]:
                best[key] = value
    return [{"origin": o, "goal": g, "cost": c, "audit": a} for (o, g), (c, a) in best.items()]


def merged(x: dict, y: dict) -> dict:
    """Two neighbouring segments as one: counts, turns, adjacent roles and answers."""
    low = min((v for v in (x["low"], y["low"]) if v is not None), default=None)
    high = max((v for v in (x["high"], y["high"]) if v is not None), default=None)
    shared = x["high"] is not None and x["high"] == y["low"]
    out = {k: x[k] + y[k] for k in ("blank", "duplicate", "truncated")}
    return x | out | {
        "low": low, "high": high, "turns": x["turns"] + y["turns"] - shared, "first": x["first"], "last": y["last"],
        "illegal": x["illegal"] + y["illegal"] + (x["last"] + y["first"] not in LEGAL),
        "answers": composed(x["answers"], y["answers"]),
    }


def segments(marked: DataFrame) -> DataFrame:
    """One row per segment with its counts and answers; a segment has at most ``SEGMENT_ROWS`` rows."""
    kind = marked.schema["conv_id"].dataType.simpleString()
    grouped = marked.groupBy("conv_id", "part", "segment").agg(
        F.array_sort(F.collect_list(F.struct("place", "initial", "fault"))).alias("rows"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.sum("turn_step").alias("turns"),
    )
    at = F.struct("part", "segment")
    # A small row per conversation; it has several segments if its first and last are not the same.
    ends = marked.groupBy("conv_id").agg((F.min(at) != F.max(at)).alias("_several")).where("_several")
    several = ends.withColumnRenamed("conv_id", "_conv")
    asked = grouped.join(several, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    schema = SEGMENT.format(kind)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                rows = [(x["initial"], x["fault"]) for x in r.pop("rows")]
                faults, whole = [f for _, f in rows], not r.pop("_several")
                out.append(r | {
                    "whole": whole,
                    "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
                    "illegal": sum(x[0] + y[0] not in LEGAL for x, y in zip(rows, rows[1:])),
                    "first": rows[0][0], "last": rows[-1][0], "answers": answers_of(rows, whole),
                })
            yield as_batch(out, batch.schema.field("conv_id").type)

    return asked.mapInArrow(solve, schema)


def as_batch(rows: list[dict], conv: pa.DataType) -> pa.RecordBatch:
    long, text = pa.int64(), pa.string()
    answer = pa.struct([("origin", pa.int32()), ("goal", pa.int32()), ("cost", long), ("audit", text)])
    fields = [("conv_id", conv), *[(c, long) for c in ("part", "segment", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal")],
              ("first", text), ("last", text), ("whole", pa.bool_()), ("answers", pa.list_(answer))]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))


def folded(pieces: DataFrame) -> DataFrame:
    """One row per conversation: segments merged level by level, ``FAN_IN`` of them in one group at most.

    Whole conversations pass by; the number of levels follows the largest numbers of the others.
    """
    done, rest = pieces.where("whole"), pieces.where("not whole")
    top = rest.agg(F.max("segment").alias("segment"), F.max("part").alias("part")).first()
    for column in ("segment", "part"):
        left = top[column] or 0
        while left > 0:
            rest, left = level(rest, column), left // FAN_IN
    return done.unionByName(rest)


def level(pieces: DataFrame, column: str) -> DataFrame:
    """Neighbouring segments that share ``column`` divided by ``FAN_IN`` become one."""
    keys = ["conv_id", *(c for c in ("part", "segment") if c != column)]
    inner = [column, *(c for c in pieces.columns if c not in (*keys, column))]
    grouped = pieces.groupBy(*keys, F.floor(F.col(column) / FAN_IN).alias("_to")).agg(
        F.array_sort(F.collect_list(F.struct(*inner)), lambda x, y: (x[column] - y[column]).cast("int")).alias("own"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                own, to = r.pop("own"), r.pop("_to")
                out.append(r | functools.reduce(merged, own) | {column: to})
            yield as_batch(out, batch.schema.field("conv_id").type)

    return grouped.mapInArrow(fold, pieces.schema)


def repaired_hash(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id and SHA-256 of the repaired conversation; rows stream in order, after their audit."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    none = F.lit(None).cast("string")
    stream = rows.select("conv_id", "place", "role", "text", none.alias("audit")).unionByName(
        found.select("conv_id", F.lit(-1).cast("long").alias("place"), none.alias("role"), none.alias("text"), "audit"))
    ordered = stream.repartition("conv_id").sortWithinPartitions("conv_id", "place")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, edits = None, iter("")
        for batch in batches:
            ids, hashes = [], []
            for conv, place, role, text, audit in zip(*(c.to_pylist() for c in batch.columns)):
                if place < 0:
                    if current is not None:
                        ids.append(current.conv)
                        hashes.append(current.ended(edits))
                    current, edits = Repaired(conv), iter(audit)
                else:
                    current.take(edits, role, text)
            yield hashed(ids, hashes, batch.schema.field("conv_id").type)
        if current is not None:
            yield hashed([current.conv], [current.ended(edits)], batch.schema.field("conv_id").type)

    return ordered.mapInArrow(digest, f"conv_id {kind}, repaired_sha256 string")


def hashed(ids: list, hashes: list[str], conv: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, conv), pa.array(hashes, pa.string())], names=["conv_id", "repaired_sha256"])


class Repaired:
    """The hash of a repaired conversation that comes row by row."""

    def __init__(self, conv) -> None:
        self.conv, self.state, self.hash, self.empty = conv, START, hashlib.sha256(), True

    def add(self, role: str, text: str) -> None:
        self.hash.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.state, self.empty = NEXT[self.state, role[0]], False

    def due(self) -> str:
        return "assistant" if self.state == USER else "user"

    def take(self, edits: Iterator[str], role: str, text: str) -> None:
        while (edit := next(edits)) == INSERT:
            self.add(self.due(), "")
        if edit != DELETE:
            self.add(role if edit == KEEP else self.due(), text)

    def ended(self, edits: Iterator[str]) -> str:
        for _ in edits:
            self.add(self.due(), "")
        return self.hash.hexdigest()


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation of the input: faults after damage, and its cheapest repair."""
    rows = placed(damaged(conversations))
    best = F.array_min(F.transform(
        F.filter("answers", lambda x: (x["origin"] == START) & x["goal"].isin(*COMPLETE)),
        lambda x: F.struct(x["cost"].alias("cost"), x["audit"].alias("audit"))))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    found = stored(folded(stored(segments(with_faults(rows)))).withColumn("best", best).select(
        "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit"))
    both = found.join(renamed(repaired_hash(rows, found)), F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    every = renamed(conversations.select("conv_id").distinct()).join(both, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    count = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select(
        F.col("_conv").alias("conv_id"), *count, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def renamed(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("conv_id", "_conv")


def oracle() -> str:
    """The same in SQL: a least (cost, audit) per row and state, row after row."""
    follow = ", ".join(f"({s}, '{r}', {t})" for (s, r), t in NEXT.items())
    inserts = {(s, k): t for s in STATES for k, t in enumerate(reached(s))}
    ahead = ", ".join(f"({s}, {k}, {t})" for (s, k), t in inserts.items())
    return f"""WITH RECURSIVE
    original AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS key FROM conversations),
    kinds AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(k)::BIGINT FOR k IN key]), lambda c, b:
        list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT) % 20 AS kind FROM original),
    damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM kinds, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
    faulty AS MATERIALIZED (SELECT *, left(role, 1) AS initial,
        right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS tail,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS earlier,
        CASE WHEN tail = '' THEN {BLANK} WHEN again THEN {DUPLICATE} WHEN tail NOT IN ('.', '!', '?') THEN {TRUNCATED} ELSE {NONE} END AS fault
        FROM numbered),
    totals AS MATERIALIZED (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = {BLANK}) AS blank, count(*) FILTER (fault = {DUPLICATE}) AS duplicate, count(*) FILTER (fault = {TRUNCATED}) AS truncated,
        count(*) FILTER (earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
    follow(state, initial, after) AS (VALUES {follow}),
    ahead(state, k, after) AS (VALUES {ahead}),
    edits AS (SELECT state, initial, fault, edit, cost, after FROM (
        SELECT s AS state, x.initial, x.fault, '{DELETE}' AS edit, {DELETE_COST} AS cost, s AS after
            FROM (SELECT DISTINCT initial, fault FROM faulty) x, range({len(STATES)}) t(s)
        UNION ALL SELECT f.state, x.initial, x.fault, e.edit, e.cost + CASE x.fault WHEN {TRUNCATED} THEN {CUT_COST} ELSE 0 END, f.after
            FROM (SELECT DISTINCT initial, fault FROM faulty WHERE fault IN ({NONE}, {TRUNCATED})) x, follow f,
                (VALUES ('{KEEP}', 0), ('{REROLE}', {REROLE_COST})) e(edit, cost)
            WHERE CASE e.edit WHEN '{KEEP}' THEN f.initial = x.initial ELSE f.initial IN ('u', 'a') END)),
    paths AS (
        SELECT conv_id, 0::BIGINT AS i, 0 AS state, {{'cost': 0::BIGINT, 'audit': ''}} AS best FROM totals
        UNION ALL
        SELECT p.conv_id, p.i + 1, e.after, min({{'cost': p.best.cost + {INSERT_COST} * h.k + e.cost, 'audit': p.best.audit || repeat('{INSERT}', h.k::INTEGER) || e.edit}})
        FROM paths p JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1
            JOIN ahead h ON h.state = p.state JOIN edits e ON e.state = h.after AND e.initial = f.initial AND e.fault = f.fault
        GROUP BY p.conv_id, p.i + 1, e.after),
    best AS MATERIALIZED (SELECT p.conv_id, min({{'cost': p.best.cost + {INSERT_COST} * h.k, 'audit': p.best.audit || repeat('{INSERT}', h.k::INTEGER)}}) AS best
        FROM paths p JOIN totals t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = t.n JOIN ahead h ON h.state = p.state AND h.after IN ({START}, {ASSISTANT})
        GROUP BY p.conv_id),
    steps AS (SELECT conv_id, k, best.audit[k] AS edit, length(replace(best.audit[:k], '{INSERT}', '')) AS i
        FROM best, range(1, length(best.audit) + 1) t(k) WHERE best.audit[k] != '{DELETE}'),
    turns AS (SELECT s.conv_id, s.k, s.edit, f.role, CASE s.edit WHEN '{INSERT}' THEN '' ELSE f.text END AS text,
        row_number() OVER own AS o, first_value(s.edit = '{KEEP}' AND f.initial = 's') OVER own AS headed
        FROM steps s LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i
        WINDOW own AS (PARTITION BY s.conv_id ORDER BY s.k)),
    repaired AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = '{KEEP}' THEN role
            WHEN (o - headed::INTEGER) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k)) AS h FROM turns GROUP BY conv_id)
    SELECT c.conv_id, coalesce(t.gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
        coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.best.cost, 0)::BIGINT AS cost,
        coalesce(b.best.audit, '') AS audit, coalesce(r.h, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c
        LEFT JOIN totals t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id"""


def reached(state: int) -> list[int]:
    """The states after 0, 1 and 2 inserted turns; a third comes back to where the first was."""
    out = [state]
    for _ in range(2):
        out.append(NEXT[out[-1], "a" if out[-1] == USER else "u"])
    return out
