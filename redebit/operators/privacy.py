"""Pseudonyms, suppression, forgetting and redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redebit.functions import hashing

PEPPER_CONF = "redebit.pepper"
DOMAIN = "redebit.forget.v1"
PREFIX = "anon_"
MASK = "[REDACTED]"
# Name parts that mark a column as sensitive.
SENSITIVE_PARTS = (
    "pan", "card_number", "cardnumber", "cvv", "expiry", "account_number", "accountnumber", "ifsc", "balance",
    "email", "phone", "mobile", "vpa", "upi_id", "address", "password", "secret", "token", "authorization",
    "api_key", "apikey", "signature", "webhook_secret",
)
# Card digits, e-mail addresses, Indian mobile numbers.
PATTERNS = (
    r"\b\d{13,19}\b",
    r"\b[\w.%-]+@[\w.-]+\.[A-Za-z]{2,}\b",
    r"\b(?:\+91[-\s]?)?[6-9]\d{9}\b",
)


def pepper_of(spark: SparkSession, pepper: bytes | None = None) -> bytes:
    """The pseudonym key; without one nothing is pseudonymised, because a plain hash is reversible."""
    if pepper:
        return pepper
    configured = spark.conf.get(PEPPER_CONF, None)
    if not configured:
        raise ValueError(f"{PEPPER_CONF} is not set")
    return configured.encode()


def pseudonymise(tenant: Column, customer: Column, pepper: bytes) -> Column:
    ipad, opad = hashing.hmac_pads(pepper)
    message = F.concat(F.lit(DOMAIN + "|"), tenant.cast("string"), F.lit("|"), customer.cast("string"))
    return F.concat(F.lit(PREFIX), F.substring(hashing.hmac_sha256(message, F.lit(ipad), F.lit(opad)), 1, 32))


def apply_suppressions(rows: DataFrame, suppressions: DataFrame, pepper: bytes) -> DataFrame:
    """Rows whose customer is suppressed under neither the raw id nor the pseudonym."""
    listed = suppressions.select("tenant_id", "customer_ref").distinct()
    keyed = rows.withColumn("_raw", F.col("customer_id").cast("string")).withColumn(
        "_anon", pseudonymise(F.col("tenant_id"), F.col("customer_id"), pepper)
    )
    by_raw = listed.withColumnRenamed("customer_ref", "_raw")
    by_anon = listed.withColumnRenamed("customer_ref", "_anon")
    return keyed.join(by_raw, ["tenant_id", "_raw"], "left_anti").join(by_anon, ["tenant_id", "_anon"], "left_anti").select(*rows.columns)


def forget_customers(tables: dict[str, DataFrame], requests: DataFrame, pepper: bytes) -> dict[str, DataFrame]:
    """Cascade a batch of requests over suppressions, mandates, profiles and replies.

    Decisions are left alone: the chain refers to mandates, not to customers.
    """
    asked = requests.select("tenant_id", "customer_id", F.lit(True).alias("_asked")).distinct()
    anon = pseudonymise(F.col("tenant_id"), F.col("customer_id"), pepper)

    def rewrite(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
        joined = df.join(asked, ["tenant_id", "customer_id"], "left")
        hit = F.coalesce("_asked", F.lit(False))
        return joined.select(*[
            (F.when(hit, changes[c]).otherwise(F.col(c)) if c in changes else F.col(c)).alias(c) for c in df.columns
        ])

    fresh = requests.select("tenant_id", anon.alias("customer_ref"), "reason").distinct()
    known = tables["suppressions"]
    added = fresh.join(known.select("tenant_id", "customer_ref"), ["tenant_id", "customer_ref"], "left_anti")
    return {
        "suppressions": known.unionByName(added),
        "mandates": rewrite(tables["mandates"], {"customer_ref": anon}),
        "profiles": tables["profiles"].join(asked, ["tenant_id", "customer_id"], "left_anti"),
        "replies": rewrite(
            tables["replies"], {"customer_ref": anon, "raw_text": F.lit(""), "needs_human": F.lit(False)}
        ),
    }


def excluded_from_training(rows: DataFrame, suppressions: DataFrame, pepper: bytes) -> DataFrame:
    return apply_suppressions(rows, suppressions, pepper)


def scrub_text(text: Column) -> Column:
    """Mask card digits, e-mail addresses and mobile numbers; letters and digits as in Unicode."""
    for pattern in PATTERNS:
        text = F.regexp_replace(text, "(?U)" + pattern, MASK)
    return text


def redact(df: DataFrame) -> DataFrame:
    """Mask columns with a sensitive name, scrub every other text column."""
    out = []
    for name, kind in df.dtypes:
        if any(part in name.lower() for part in SENSITIVE_PARTS):
            out.append(F.when(F.col(name).isNotNull(), MASK).alias(name))
        elif kind == "string":
            out.append(scrub_text(F.col(name)).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)
