"""Parsed customer replies against their closed schema, and the human queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reply intents and keys.
INTENTS = ("none", "opt_out", "promise_to_pay", "dispute", "question")
FIELDS = ("declared_funding_day", "intent", "confidence", "language")
REQUIRED = ("intent", "confidence")
NUMBERS = ("BIGINT", "DOUBLE", "DECIMAL")


def _kind(name: str) -> Column:
    node = F.try_variant_get("_v", f"$.{name}", "variant")
    return F.regexp_replace(F.coalesce(F.schema_of_variant(node), F.lit("VOID")), r"\(.*", "")


def validate_replies(replies: DataFrame, payload: str = "payload") -> DataFrame:
    """Accept a reply whole or reject it with the first reason; nothing is half-read."""
    known = F.array(*[F.lit(f) for f in FIELDS])
    needed = F.array(*[F.lit(f) for f in REQUIRED])
    read = replies.select(
        "*", F.try_parse_json(payload).alias("_v"), F.json_object_keys(payload).alias("_keys"),
    ).select(
        "*", _kind("intent").alias("_ki"), _kind("confidence").alias("_kc"), _kind("declared_funding_day").alias("_kd"),
        _kind("language").alias("_kl"), F.try_variant_get("_v", "$.intent", "string").alias("_intent"),
        F.try_variant_get("_v", "$.confidence", "double").alias("_confidence"),
        F.try_variant_get("_v", "$.declared_funding_day", "bigint").alias("_day"),
        F.try_variant_get("_v", "$.language", "string").alias("_language"),
    )
    c = F.col
    reason = (
        F.when(c("_keys").isNull(), "expected an object")
        .when(F.size(F.array_except("_keys", known)) > 0, "unexpected keys")
        .when(F.size(F.array_except(needed, "_keys")) > 0, "missing required keys")
        .when(c("_ki") != "STRING", "intent: expected a string")
        .when(~c("_intent").isin(*INTENTS), "intent: unknown")
        .when(~c("_kc").isin(*NUMBERS), "confidence: expected a number")
        .when(~c("_confidence").between(0.0, 1.0), "confidence: out of range")
        .when(~c("_kd").isin("VOID", "BIGINT"), "declared_funding_day: expected an integer")
        .when((c("_kd") == "BIGINT") & ~c("_day").between(1, 31), "declared_funding_day: out of range")
        .when(~c("_kl").isin("VOID", "STRING"), "language: expected a string")
        .when((c("_kl") == "STRING") & ~F.char_length("_language").between(1, 32), "language: bad length")
    )
    judged = read.withColumn("rejection", reason)
    ok = c("rejection").isNull()
    return judged.select(
        *replies.columns, "rejection", F.when(ok, c("_intent")).alias("intent"),
        F.when(ok, c("_confidence")).alias("confidence"), F.when(ok, c("_day")).alias("declared_funding_day"),
        F.when(ok, c("_language")).alias("language"), (~ok).alias("needs_human"),
    )


def human_queue(replies: DataFrame, limit: int = 100) -> DataFrame:
    """Oldest unresolved replies waiting for a person."""
    waiting = replies.where("needs_human AND resolved_at IS NULL")
    return waiting.orderBy("received_at", "reply_id").limit(limit)
