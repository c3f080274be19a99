"""Payment-event views over the supplied star-schema tables.

`events` plays the provider's event log, `orders` with `customer` the billing cycles,
and `lineitem` the gate decisions. The definitions are fixed; oracle SQL repeats them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redebit.functions import calendar as cal
from redebit.session import configure

DAY = 86_400

# Category code and decline code by remainder.
MCC_BY_REMAINDER = ("7997", "5815", "8299", "6300")
DECLINE_BY_REMAINDER = ("51", "05", "91", "61", "54", "57", "41", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: Column, values: tuple[str | None, ...]) -> Column:
    out = F.when(index == 0, values[0])
    for i, value in enumerate(values[1:], start=1):
        out = out.when(index == i, F.lit(value))
    return out


def rail_of(key: Column) -> Column:
    last = key % 10
    return F.when(last < 7, cal.UPI).when(last < 9, cal.CARD).otherwise(cal.ENACH)


def mcc_of(key: Column) -> Column:
    return _pick(key % 4, MCC_BY_REMAINDER)


def issuer_of(key: Column) -> Column:
    return F.concat(F.lit("ISS"), (key % 8).cast("string"))


def _week_start(ts: Column) -> Column:
    """Monday 00:00 UTC of the week of ``ts`` as epoch seconds."""
    day = F.floor(F.unix_seconds(ts) / DAY)
    return (day - F.pmod(day + 3, F.lit(7))) * DAY


def payment_event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payment events as a file stream over the same table."""
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return to_payment_events(raw)


def payment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_payment_events(table(spark, sf_dir, "events"))


def to_payment_events(raw: DataFrame) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    k = F.get_json_object("props", "$.k").try_cast("int")
    user = F.col("user_id")
    kind = (
        F.when(F.col("event_type") == "purchase", "payment.captured")
        .when(F.col("event_type") == "error", "payment.failed")
        .when(F.col("event_type") == "signup", "subscription.authenticated")
        .when(
            F.col("event_type") == "click",
            F.when(k % 10 == 0, "subscription.cancelled").otherwise("subscription.halted"),
        )
        .when(
            F.col("event_type") == "view",
            F.when(k % 2 == 0, "subscription.paused").otherwise("subscription.resumed"),
        )
    )
    week = _week_start(at)
    failed = F.col("event_type") == "error"
    return raw.select(
        "event_id",
        F.concat(F.lit("t"), (user % 5).cast("string")).alias("tenant_id"),
        user.alias("customer_id"),
        user.alias("mandate_id"),
        F.concat_ws(
            "-",
            user.cast("string"),
            F.date_format(F.date_from_unix_date((week / DAY).cast("int")), "yyyyMMdd"),
        ).alias("cycle_ref"),
        kind.alias("event_type"),
        at.alias("occurred_at"),
        F.timestamp_seconds(week + 7 * DAY).alias("deadline_at"),
        F.round(F.col("value") * 100).cast("long").alias("amount_paise"),
        issuer_of(user).alias("issuer"),
        rail_of(user).alias("rail"),
        mcc_of(user).alias("mcc"),
        F.when(failed, _pick(k % 8, DECLINE_BY_REMAINDER)).alias("decline_code"),
    )


def billing_cycles(spark: SparkSession, sf_dir: str, with_tenant: bool = False) -> DataFrame:
    """Billing cycles; the customer join happens only where the tenant is asked for."""
    orders = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    due = F.col("o_orderdate").cast("timestamp")
    status = F.col("o_orderstatus")
    cycles = orders.select(
        key.alias("cycle_id"),
        cust.alias("customer_id"),
        cust.alias("mandate_id"),
        rail_of(cust).alias("rail"),
        mcc_of(cust).alias("mcc"),
        issuer_of(cust).alias("issuer"),
        F.round(F.col("o_totalprice") * 10).cast("long").alias("amount_paise"),
        due.alias("due_at"),
        (status != "O").alias("failed"),
        (status == "P").alias("recovered"),
        F.when(status == "P", cal.add_seconds(due, (key % 7 + 1) * DAY)).alias("recovered_at"),
        F.when(status != "O", _pick(key % 8, DECLINE_BY_REMAINDER)).alias("decline_code"),
    )
    if not with_tenant:
        return cycles
    owners = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("tenant_id"),
    )
    return cycles.join(owners, "customer_id")


def mandates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mandate per customer, with facts of its own that the events do not show."""
    key, of = F.col("c_custkey"), F.col("c_custkey") + F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("t"), (key % 5).cast("string")).alias("tenant_id"), key.alias("mandate_id"),
        key.alias("customer_id"), rail_of(of).alias("rail"), mcc_of(of).alias("mcc"),
    )


def gate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions without their chain columns; an order is one ledger lane."""
    line = table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    return line.select(
        F.concat(F.lit("t"), (F.col("l_orderkey") % 5).cast("string")).alias("tenant_id"),
        F.col("l_orderkey").alias("lane"),
        F.concat_ws(
            "-", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"),
            F.unix_seconds(F.col("l_shipdate").cast("timestamp")),
        ).alias("decision_id"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_orderkey").alias("cycle_id"),
        F.when(flag == "N", "ALLOW").when(flag == "R", "DENY").otherwise("DEFER").alias("verdict"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("amount_paise"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
    )


def register_views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Register the domain views as temp views for ``spark.sql`` users."""
    views = {
        "ev_events": payment_events(spark, sf_dir),
        "ev_cycles": billing_cycles(spark, sf_dir, with_tenant=True),
        "ev_decisions": gate_decisions(spark, sf_dir),
        "reply_text": table(spark, sf_dir, "conversations"),
        "doc_text": table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return views
