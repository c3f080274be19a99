"""Reading, verifying, deduplicating and normalising the provider event log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redebit import schemas
from redebit.functions import hashing

# Fields in fallback order, inside `payload.<kind>.entity`.
MANDATE_PATHS = ("subscription.entity.id", "payment.entity.token_id", "token.entity.id")
CYCLE_PATHS = ("invoice.entity.id", "payment.entity.invoice_id")
AMOUNT_PATHS = ("payment.entity.amount", "invoice.entity.amount")
BILLING_PATHS = ("subscription.entity.current_end", "invoice.entity.expire_by")
DECLINE_PATHS = ("payment.entity.error_reason", "payment.entity.error_code")


def read_events(spark: SparkSession, path: str, only_verified: bool = True) -> DataFrame:
    """The event log with its fixed schema; unverified deliveries are pushed out of the scan."""
    events = spark.read.schema(schemas.EVENTS_RAW).parquet(path)
    return events.where("signature_ok") if only_verified else events


def stream_events(spark: SparkSession, path: str, max_files: int = 64) -> DataFrame:
    """The same log as a stream; the checkpoint replaces a processed marker."""
    return (
        spark.readStream.schema(schemas.EVENTS_RAW)
        .option("maxFilesPerTrigger", max_files)
        .parquet(path)
        .where("signature_ok")
    )


# Event types the engine understands; anything else is checked more closely.
KNOWN_TYPES = (
    "payment.failed", "payment.captured", "subscription.charged", "invoice.paid", "subscription.authenticated",
    "subscription.activated", "subscription.resumed", "subscription.paused", "subscription.halted",
    "subscription.cancelled", "subscription.completed",
)


def _first_text(paths: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.col(f"_payload.{p}"), F.lit("")) for p in paths])


def _first_long(paths: tuple[str, ...], positive: bool = False) -> Column:
    values = [F.col(f"_payload.{p}") for p in paths]
    return F.coalesce(*[F.when(v > 0, v) if positive else v for v in values])


def _json_string(name: str, value: Column) -> Column:
    """``value``, only if the JSON field it came from is itself a non-empty string."""
    node = F.try_variant_get(F.try_parse_json("body"), f"$.{name}", "variant")
    return F.when(F.schema_of_variant(node) == "STRING", F.nullif(value, F.lit("")))


def parse_envelope(raw: DataFrame) -> DataFrame:
    """Provider JSON in ``body`` to typed columns, plus ``reject_reason`` for bad rows.

    Needs ``event_id`` (header value, may be NULL), ``body`` and ``received_at``.
    Other columns pass through. A wrongly typed field becomes NULL on its own.

    The body is parsed once, by a generator: a later filter on the outcome then cannot be
    pushed under it and parse again. The closer look at JSON types is taken only for rows
    the plain parse leaves in doubt.
    """
    carried = [c for c in raw.columns if c not in ("event_id", "body")]
    parsed = raw.select(
        "event_id", "body", *carried,
        F.inline(F.array(F.from_json("body", schemas.BODY))).alias("_id", "_event", "_created_at", "_payload"),
    )
    event_type = F.when(F.col("_event").isin(*KNOWN_TYPES), F.col("_event")).otherwise(
        F.when(F.col("_event").isNotNull(), _json_string("event", F.col("_event")))
    )
    header = F.nullif(F.col("event_id"), F.lit(""))
    event_id = F.coalesce(header, F.when(F.col("_id").isNotNull(), _json_string("id", F.col("_id"))))
    json = F.try_parse_json("body")
    doubt = (
        F.when(json.isNull(), "body is not valid JSON")
        .when(~F.startswith(F.schema_of_variant(json), F.lit("OBJECT")), "body is not a JSON object")
        .when(F.col("event_type").isNull(), "no event type")
        .otherwise("no event id")
    )
    named = parsed.select(
        event_id.alias("event_id"), event_type.alias("event_type"), "body", "_created_at", "_payload", *carried
    )
    usable = F.col("event_type").isNotNull() & F.col("event_id").isNotNull()
    return named.select(
        "event_id", "event_type",
        _first_text(MANDATE_PATHS).alias("mandate_id"),
        _first_text(CYCLE_PATHS).alias("cycle_ref"),
        _first_long(AMOUNT_PATHS).alias("amount_paise"),
        F.timestamp_seconds(_first_long(BILLING_PATHS, positive=True)).alias("deadline_at"),
        _first_text(DECLINE_PATHS).alias("decline_code"),
        F.coalesce(F.timestamp_seconds("_created_at"), F.col("received_at")).alias("occurred_at"),
        F.when(~usable, doubt).alias("reject_reason"),
        "body",
        *carried,
    )


def split_malformed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable events, rejects with their reason)."""
    good = parsed.where("reject_reason IS NULL").drop("reject_reason", "body")
    rejects = parsed.where("reject_reason IS NOT NULL").select(
        "event_id", "reject_reason", "body", "received_at"
    )
    return good, rejects


def secrets_frame(spark: SparkSession, secrets: list[tuple[str, bytes]]) -> DataFrame:
    """(tenant, secret) pairs as precomputed key pads; the secret itself is not shipped."""
    rows = [(tenant, *hashing.hmac_pads(secret)) for tenant, secret in secrets if secret]
    return spark.createDataFrame(rows, "tenant_id string, ipad string, opad string")


def verify_signatures(raw: DataFrame, secrets: DataFrame) -> DataFrame:
    """Set ``signature_ok``: does the raw body match under any active secret of its tenant?

    The secrets of a tenant (a rotation window, so a handful) travel as one array, which
    keeps an event one row: no fan-out and no regrouping.
    """
    keyring = secrets.groupBy("tenant_id").agg(
        F.collect_list(F.struct("ipad", "opad")).alias("_keys")
    )
    matches = F.exists(
        "_keys",
        lambda key: hashing.hmac_sha256(F.col("body"), key["ipad"], key["opad"]) == F.col("signature"),
    )
    joined = raw.drop("signature_ok").join(keyring, "tenant_id", "left")
    return joined.withColumn(
        "signature_ok", F.coalesce(matches & (F.col("signature") != ""), F.lit(False))
    ).drop("_keys")


def dedupe_events(events: DataFrame, arrival: str = "received_at") -> DataFrame:
    """First delivery per event id wins.

    A grouped ``min_by`` combines on the map side, so one event re-delivered without end
    is reduced before it is shuffled.
    """
    rest = [c for c in events.columns if c != "event_id"]
    tie = F.struct(F.col(arrival), F.hash(*[F.col(c) for c in rest]))
    first = events.groupBy("event_id").agg(F.min_by(F.struct(*rest), tie).alias("_first"))
    return first.select("event_id", "_first.*").select(*events.columns)


# The rule table. Predicates are Spark SQL over the action's facts; a missing
# fact makes a predicate NULL, which counts as failed.
RULE_ROWS: list[tuple] = [
    ("NPCI-AUTOPAY-WINDOW", 3, "NPCI", "UPI Autopay non-peak execution windows", "2026-08-01",
     ["debit_attempt"], ["upi_autopay"],
     "hour_ist < 10 OR (hour_ist >= 13 AND hour_ist < 17) OR hour_ist >= 21.5", "DENY"),
    ("RBI-EMANDATE-PDN-24H", 2, "RBI", "Digital Payments - E-mandate Framework, 2026", "2026-04-21",
     ["debit_attempt"], ["upi_autopay", "card_emandate", "enach"],
     "pdn_sent_at IS NOT NULL AND hours_since_pdn >= 24", "DENY"),
    ("RBI-EMANDATE-PDN-24H", 3, "RBI", "Digital Payments - E-mandate Framework, 2026", "2026-08-30",
     ["debit_attempt"], None,
     "pdn_sent_at IS NOT NULL AND hours_since_pdn >= 24", "DENY"),
    ("NPCI-PDN-CUTOFF-2350", 1, "NPCI", "NPCI operating guidelines - PDN submission cutoff",
     "2026-04-21", ["notification"], None,
     "NOT (is_next_day_debit AND hour_ist >= 23.83)", "DENY"),
    ("RBI-EMANDATE-AFA-CAP", 2, "RBI", "Digital Payments - E-mandate Framework, 2026", "2026-04-21",
     ["debit_attempt"], None, "amount_paise <= afa_free_cap", "ESCALATE_HUMAN"),
    ("RBI-FPC-CONTACT-WINDOW", 1, "RBI", "Fair Practices Code, circular 12 Aug 2022", "2022-08-12",
     ["sms", "whatsapp", "voice"], None, "hour_ist >= 8 AND hour_ist < 19", "DEFER"),
    ("TRAI-DLT-TEMPLATE", 4, "TRAI", "TCCCPR 2018, as amended 2025", "2025-01-01", ["sms"], None,
     "dlt_template_id IS NOT NULL AND header_series = '160' AND NOT dnd_registered", "DENY"),
    ("DPDP-CONSENT-VALID", 1, "MeitY", "DPDP Act 2023", "2023-08-11",
     ["sms", "whatsapp", "voice", "debit_attempt"], None,
     "consent_ref IS NOT NULL AND NOT consent_withdrawn", "DENY"),
    ("HOUSE-FATIGUE-CAP", 1, "INTERNAL", "Product policy - customer protection", "2026-01-01",
     ["sms", "whatsapp"], None, "messages_30d < tenant_fatigue_cap", "DEFER"),
]
# Merchant category ceilings for debits without extra authentication.
CAP_ROWS = [
    ("*", 1_500_000, "2026-04-21"),
    ("6300", 10_000_000, "2026-04-21"),
    ("6012", 10_000_000, "2026-04-21"),
    ("6211", 10_000_000, "2026-04-21"),
]
VERDICT_RANK = {"ALLOW": 0, "DEFER": 1, "ESCALATE_HUMAN": 2, "DENY": 3}


def _date(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def default_rules(spark: SparkSession) -> DataFrame:
    rows = [(*r[:4], _date(r[4]), *r[5:]) for r in RULE_ROWS]
    return spark.createDataFrame(rows, schemas.RULES)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return valid_rules(spark.read.schema(schemas.RULES).json(path))


def valid_rules(rules: DataFrame) -> DataFrame:
    """Only citable, dated rules count; an unknown or missing on_fail means DENY."""
    known = F.col("on_fail").isin(*VERDICT_RANK)
    return rules.where(
        F.coalesce(F.trim("citation"), F.lit("")) != ""
    ).where("as_of IS NOT NULL AND size(applies_to) > 0").withColumn(
        "on_fail", F.when(known, F.col("on_fail")).otherwise("DENY")
    )


def default_caps(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, c, _date(d)) for m, c, d in CAP_ROWS], schemas.CAPS)
