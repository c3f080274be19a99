"""The hash-chained decision ledger: append, verify, replay, page through."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redebit.operators import ordered

GENESIS = "0" * 64
KEYS = ["tenant_id", "lane"]
SEQ_BLOCK = 100_000


def with_lane(decisions: DataFrame, lanes: int, by: str = "cycle_id") -> DataFrame:
    """Spread a tenant over independent chains; one cycle's decisions stay in one chain.

    A chain is sequential by definition, so lanes are how a very busy tenant is split.
    """
    return decisions.withColumn("lane", F.pmod(F.xxhash64(by), F.lit(lanes)))


def with_payload(decisions: DataFrame, fields: list[str]) -> DataFrame:
    """Canonical body: fixed field order, instants as epoch microseconds."""
    cells = [
        (F.unix_micros(c) if dict(decisions.dtypes)[c] == "timestamp" else F.col(c)).alias(c) for c in fields
    ]
    return decisions.withColumn("payload", F.to_json(F.struct(*cells)))


def link_text(seq: Column, prev_hash: Column) -> Column:
    return F.concat_ws("|", F.col("tenant_id"), F.col("lane").cast("string"), seq.cast("string"), prev_hash, F.col("payload"))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Extend chains over rows sorted by (tenant, lane, order); only the head is kept, other columns pass as they are."""
    values = lambda c: c.to_pylist() if c.null_count else c.to_numpy(zero_copy_only=False).tolist()
    key, seq, head = None, 0, GENESIS
    for batch in batches:
        seqs, prevs, hashes = [], [], []
        for tenant, lane, payload, seq0, head0 in zip(*(values(batch.column(n)) for n in (*KEYS, "payload", "_next_seq", "_head"))):
            if (tenant, lane) != key:
                key, seq, head = (tenant, lane), seq0, head0
            digest = hashlib.sha256(f"{tenant}|{lane}|{seq}|{head}|{payload}".encode()).hexdigest()
            seqs.append(seq)
            prevs.append(head)
            hashes.append(digest)
            seq, head = seq + 1, digest
        names = [n for n in batch.schema.names if n not in ("_next_seq", "_head")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array(seqs, pa.int64()), pa.array(prevs, pa.string()), pa.array(hashes, pa.string())],
            names=[*names, "chain_seq", "prev_hash", "record_hash"])


def append_decisions(decisions: DataFrame, order: list[str], heads: DataFrame | None = None, fields: list[str] | None = None) -> DataFrame:
    """Chain a batch of decisions onto each (tenant, lane) head.

    Rows stream through sorted partitions and a task holds one head per chain, never a
    chain. ``heads`` has ``tenant_id, lane, chain_seq, record_hash`` of the current ends. With ``fields``
    the payload is made of them where the rows are chained, so it is not shuffled.
    """
    if heads is not None:
        ends = heads.select(*KEYS, (F.col("chain_seq") + 1).alias("_n"), F.col("record_hash").alias("_h"))
        decisions = decisions.join(ends, KEYS, "left").select(*decisions.columns, "_n", "_h")
    arranged = decisions.repartition(*KEYS).sortWithinPartitions(*KEYS, *order)
    if fields is not None:
        arranged = with_payload(arranged, fields)
    known = [c for c in arranged.columns if c not in ("_n", "_h")]
    next_seq, head = (F.col("_n"), F.col("_h")) if heads is not None else (F.lit(None), F.lit(None))
    based = arranged.select(
        *known, F.coalesce(next_seq, F.lit(0)).cast("bigint").alias("_next_seq"), F.coalesce(head, F.lit(GENESIS)).alias("_head"))
    schema = ", ".join(f"`{n}` {t}" for n, t in based.dtypes if n in known) + ", chain_seq bigint, prev_hash string, record_hash string"
    return based.mapInArrow(_chain, schema)


def chain_heads(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(*KEYS).agg(
        F.max("chain_seq").alias("chain_seq"), F.max_by("record_hash", "chain_seq").alias("record_hash")
    )


def verify_chain(ledger: DataFrame) -> DataFrame:
    """Every break: sequence gap, broken link, hash mismatch.

    Each record is judged against the stored hash of its predecessor, so verification is
    parallel inside a chain and goes on past a break.
    """
    computed = F.sha2(link_text(F.col("chain_seq"), F.col("prev_hash")), 256)
    # Hashes are worked out where the record is; a record moves once, without its payload.
    judged = ledger.select(
        *KEYS, "chain_seq", "decision_id", "prev_hash", "record_hash", F.when(F.col("record_hash") != computed, computed).alias("_computed"),
        F.greatest(F.floor(F.col("chain_seq") / SEQ_BLOCK), F.lit(0)).alias("_block"))
    inside = Window.partitionBy(*KEYS, "_block").orderBy("chain_seq")
    own = F.struct("chain_seq", "record_hash")
    placed = judged.select("*", F.lag(own).over(inside).alias("_previous"), F.lead(own).over(inside).isNull().alias("_tail"))

    def breaks(previous: Column) -> Column:
        want_seq = F.coalesce(previous["chain_seq"] + 1, F.lit(0))
        want_prev = F.coalesce(previous["record_hash"], F.lit(GENESIS))

        def broken(bad: Column, reason: str, expected: Column, found: Column) -> Column:
            return F.when(
                bad, F.struct(F.lit(reason).alias("reason"), expected.cast("string").alias("expected"), found.cast("string").alias("found"))
            )

        return F.array_compact(F.array(
            broken(F.col("chain_seq") != want_seq, "sequence gap", want_seq, F.col("chain_seq")),
            broken(F.col("prev_hash") != want_prev, "broken link", want_prev, F.col("prev_hash")),
            broken(F.col("_computed").isNotNull(), "hash mismatch", F.col("_computed"), F.col("record_hash")),
        ))

    # Only the first record of a later block has its predecessor elsewhere, in the last record of the block before. What goes on
    # are broken records and, apart from them, the ends of blocks in their order.
    first = F.col("_previous").isNull() & (F.col("_block") > 0)
    kept = ["chain_seq", "decision_id", "prev_hash", "record_hash", "_computed", "_previous"]
    emitted = F.array_compact(F.array(
        F.when(~first & (F.size(breaks(F.col("_previous"))) > 0), F.struct(F.col("_block").alias("_part"), F.lit(True).alias("_judge"), *kept)),
        F.when(first | F.col("_tail"), F.struct(F.lit(-1).cast("bigint").alias("_part"), first.alias("_judge"), *kept)),
    ))
    ends = Window.partitionBy(*KEYS, "_part").orderBy("chain_seq")
    found = placed.select(*KEYS, F.inline(emitted)).withColumn("_carry", F.lag(own).over(ends)).where("_judge")
    previous = F.when(F.col("_part") < 0, F.col("_carry")).otherwise(F.col("_previous"))
    return found.withColumn("_previous", previous).select(*KEYS, "chain_seq", "decision_id", F.inline(breaks(F.col("_previous"))))


# ---------------------------------------------------------------- register of chains
#
# A chain proves its own order, but not that it is all there: a chain that is gone, or whose tail
# was cut off, leaves no gap. The register keeps, per chain, its length, its head and a Merkle
# root over segments of record hashes; a tenant's root is a Merkle root over its chains. Chains,
# and segments of a busy chain, are hashed side by side.

SEGMENT_RECORDS, FAN_IN = 4096, 256


def merkle_roots(hashes: DataFrame, keys: list[str], place: str, value: str, largest: int, fan_in: int = FAN_IN) -> DataFrame:
    """One root per ``keys`` over ``value`` in the order of ``place`` (0, 1, ..., below ``largest``), and how many ``records`` it covers.

    A node is the hash of up to ``fan_in`` neighbours, so no group holds more than that, and the
    number of levels follows ``largest`` alone.
    """
    level, left = hashes.select(*keys, F.col(place).cast("bigint").alias("_at"), F.col(value).alias("_hash"), F.lit(1).cast("bigint").alias("records")), max(largest, 1)
    while True:
        grouped = level.groupBy(*keys, F.floor(F.col("_at") / fan_in).alias("_at"))
        level = grouped.agg(F.array_sort(F.collect_list(F.struct("_at", "_hash"))).alias("_nodes"), F.sum("records").alias("records")).select(
            *keys, "_at", F.sha2(F.array_join(F.col("_nodes._hash"), "|"), 256).alias("_hash"), "records")
        left = -(-left // fan_in)
        if left == 1:
            return level.select(*keys, "records", F.col("_hash").alias("root"))


def segment_roots(ledger: DataFrame, records: int = SEGMENT_RECORDS) -> DataFrame:
    """Per (tenant, lane, segment): its records and the Merkle root over them."""
    placed = ledger.withColumn("segment", F.floor(F.col("chain_seq") / records)).withColumn("_in", F.col("chain_seq") % records)
    return merkle_roots(placed, [*KEYS, "segment"], "_in", "record_hash", records)


def chain_register(ledger: DataFrame, records: int = SEGMENT_RECORDS) -> DataFrame:
    """Per chain: its length, its head, and the roots of its segments, to be kept apart from the ledger."""
    roots = segment_roots(ledger, records).groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct("segment", "records", "root"))).alias("segments"))
    return ordered.matched(chain_heads(ledger), roots, KEYS)


def tenant_roots(register: DataFrame) -> DataFrame:
    """One Merkle root per tenant over the heads of its chains, in lane order: a figure to publish."""
    lane = F.row_number().over(Window.partitionBy("tenant_id").orderBy("lane")) - 1  # one small row per chain
    chains = register.withColumn("_lane", lane)
    largest = chains.agg(F.max("_lane")).first()[0]
    return merkle_roots(chains, ["tenant_id"], "_lane", "record_hash", (largest or 0) + 1).select("tenant_id", "root")


def verify_register(ledger: DataFrame, register: DataFrame, records: int = SEGMENT_RECORDS) -> DataFrame:
    """What a register says is not there any more, or is not what it was: one row per fault.

    ``lost chain``, ``unknown chain``, ``cut tail`` (records after the last one found), and
    ``changed segment`` where the records of a segment are complete in number or not but differ
    from its root. A chain that has grown since is no fault.
    """
    ledger = ledger.select(*KEYS, "chain_seq", "record_hash")
    known = register.select(*KEYS, F.col("chain_seq").alias("_seq"), F.inline("segments"))
    bound = ordered.matched(ledger, register.select(*KEYS, F.col("chain_seq").alias("_last")), KEYS)
    now = segment_roots(bound.where("chain_seq <= _last").drop("_last"), records)
    ends = ledger.groupBy(*KEYS).agg(F.max("chain_seq").alias("_found"))
    heads = ordered.matched(register.select(*KEYS, F.col("chain_seq").alias("_seq")), ends, KEYS, "left")
    lost = heads.where("_found IS NULL").select(*KEYS, F.lit("lost chain").alias("reason"), F.lit(0).cast("bigint").alias("from_seq"), F.col("_seq").alias("to_seq"))
    cut = heads.where("_found < _seq").select(*KEYS, F.lit("cut tail").alias("reason"), (F.col("_found") + 1).alias("from_seq"), F.col("_seq").alias("to_seq"))
    unknown = ordered.matched(ends, register.select(*KEYS), KEYS, "left_anti").select(
        *KEYS, F.lit("unknown chain").alias("reason"), F.lit(None).cast("bigint").alias("from_seq"), F.lit(None).cast("bigint").alias("to_seq"))
    seen = ordered.matched(known, now.select(*KEYS, "segment", F.col("root").alias("_root")), [*KEYS, "segment"], "left")
    changed = seen.where("_root IS NOT NULL AND _root <> root").select(
        *KEYS, F.lit("changed segment").alias("reason"), (F.col("segment") * records).alias("from_seq"),
        F.least(F.col("segment") * records + records - 1, F.col("_seq")).alias("to_seq"))
    return lost.unionByName(cut).unionByName(unknown).unionByName(changed)


def replay_decisions(ledger: DataFrame, checks_schema: str = "array<struct<rule_id:string,verdict:string>>") -> DataFrame:
    """Each decision with its parsed checks, refused rules and whether its hash still matches."""
    computed = F.sha2(link_text(F.col("chain_seq"), F.col("prev_hash")), 256)
    parsed = ledger.withColumn("checks", F.from_json("checks_json", checks_schema))
    refused = F.transform(F.filter("checks", lambda c: c["verdict"] != "ALLOW"), lambda c: c["rule_id"])
    return parsed.withColumn("hash_matches", computed == F.col("record_hash")).withColumn("refused", refused)


def ledger_page(decisions: DataFrame, wanted: str, order: list[str], before: Column | None = None, limit: int = 50) -> DataFrame:
    """Keyset page, newest first; ``wanted`` is all, allow or refused."""
    if wanted not in ("all", "allow", "refused"):
        raise ValueError("verdict must be all, allow or refused")
    page = decisions if before is None else decisions.where(before)
    if wanted == "allow":
        page = page.where("verdict = 'ALLOW'")
    elif wanted == "refused":
        page = page.where("verdict <> 'ALLOW'")
    return page.orderBy(*[F.col(c).desc() for c in order]).limit(limit)


def due_actions(actions: DataFrame, now: Column, k: int) -> DataFrame:
    """Per tenant the ``k`` earliest due actions (top-k is taken before the shuffle)."""
    due = actions.where(F.col("state").isin("pending", "claimed") & (F.col("fire_at") <= now))
    w = Window.partitionBy("tenant_id").orderBy("fire_at", "action_id")
    return due.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def cycle_timeline(events: DataFrame, decisions: DataFrame, actions: DataFrame) -> DataFrame:
    """One dated line per event, decision and pending action of a cycle (``cycle_id, at, kind, pending``)."""
    done = F.lit(False).alias("pending")
    parts = [
        events.select("cycle_id", "at", F.replace(F.col("event_type"), F.lit("."), F.lit("_")).alias("kind"), done),
        decisions.select("cycle_id", "at", F.col("action_type").alias("kind"), done),
        actions.where(F.col("state").isin("pending", "claimed")).select(
            "cycle_id", "at", F.col("action_type").alias("kind"), F.lit(True).alias("pending")
        ),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def timeline_axis(timeline: DataFrame, now: Column) -> DataFrame:
    """Axis of each cycle's timeline: 8 hours past the end, at most four days long, with what falls off it."""
    hour = 3600
    spans = timeline.groupBy("cycle_id").agg(
        F.min(F.unix_seconds("at")).alias("_lo"), F.greatest(F.max(F.unix_seconds("at")), F.unix_seconds(now)).alias("_hi")
    )
    axis = spans.select(
        "cycle_id", (F.col("_hi") + 8 * hour).alias("axis_to_s"),
        F.greatest(F.col("_lo") - 4 * hour, F.col("_hi") + 8 * hour - 96 * hour).alias("axis_from_s"),
    )
    joined = timeline.join(axis, "cycle_id")
    return joined.groupBy("cycle_id", "axis_from_s", "axis_to_s").agg(
        F.count("*").alias("entries"), F.count_if(F.unix_seconds("at") < F.col("axis_from_s")).alias("off_axis")
    )
