"""Versioned compliance rules evaluated as columns."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redebit.operators import legality
from redebit.sources.events import VERDICT_RANK

FACTS = {
    "hour_ist": "double", "pdn_sent_at": "timestamp", "hours_since_pdn": "double", "is_next_day_debit": "boolean",
    "amount_paise": "bigint", "afa_free_cap": "bigint", "dlt_template_id": "string", "header_series": "string",
    "dnd_registered": "boolean", "consent_ref": "string", "consent_withdrawn": "boolean", "messages_30d": "int",
    "tenant_fatigue_cap": "int",
}


#: Functions a predicate may call; none of them can fail on a value.
FUNCTIONS = (
    "coalesce", "least", "greatest", "upper", "lower", "trim", "length", "try_add", "try_subtract", "try_multiply", "try_divide",
    "startswith", "endswith", "contains",
)


class Refused(Exception):
    """Why a predicate is not admitted."""


def _pairs(children: list[Column]) -> Column:
    """CASE WHEN from its conditions and values in turn, and the last value if there is one more."""
    out = F
    for i in range(0, len(children) - 1, 2):
        out = out.when(children[i], children[i + 1])
    return out.otherwise(children[-1]) if len(children) % 2 else out


#: What each admitted part of a predicate becomes. Arithmetic takes the forms that give NULL where they fail; division is
#: admitted as ``try_divide`` only, so that a rule says itself what it means by a zero.
BUILD = {
    "And": lambda a, b: a & b, "Or": lambda a, b: a | b, "Not": lambda a: ~a,
    "EqualTo": lambda a, b: a == b, "EqualNullSafe": lambda a, b: a.eqNullSafe(b), "LessThan": lambda a, b: a < b,
    "LessThanOrEqual": lambda a, b: a <= b, "GreaterThan": lambda a, b: a > b, "GreaterThanOrEqual": lambda a, b: a >= b,
    "In": lambda a, *of: a.isin(*of), "IsNull": lambda a: a.isNull(), "IsNotNull": lambda a: a.isNotNull(),
    "UnresolvedBetween": lambda a, low, high: a.between(low, high), "Add": F.try_add, "Subtract": F.try_subtract,
    "Multiply": F.try_multiply, "UnaryMinus": lambda a: F.try_subtract(F.lit(0), a),
    "UnaryPositive": lambda a: a, "If": lambda test, yes, no: F.when(test, yes).otherwise(no), "CaseWhen": lambda *c: _pairs(list(c)),
}


def _built(node) -> Column:
    """A part of the parsed predicate as a column, made of admitted parts only."""
    kind = node.getClass().getSimpleName()
    if kind == "Literal":
        return F.expr(node.sql())
    if kind == "UnresolvedAttribute":
        if node.name() not in FACTS:
            raise Refused(f"unknown fact {node.name()}")
        return F.col(node.name())
    children = [node.children().apply(i) for i in range(node.children().length())]
    if kind == "Like":
        pattern = children[1].sql() if children[1].getClass().getSimpleName() == "Literal" else None
        if pattern is None or "\\" in pattern:
            raise Refused("LIKE takes a fixed pattern without escapes")
        return _built(children[0]).like(pattern[1:-1])
    if kind == "UnresolvedFunction":
        name = node.nameParts().mkString(".").lower()
        if name == "between":
            return BUILD["UnresolvedBetween"](*map(_built, children))
        if name not in FUNCTIONS:
            raise Refused(f"function {name} is not admitted")
        return F.call_function(name, *map(_built, children))
    if kind not in BUILD:
        raise Refused(f"{kind} is not admitted")
    return BUILD[kind](*map(_built, children))


def _text_casts(node) -> bool:
    """Whether the analysed expression turns text into something else, which fails on some texts."""
    if node.getClass().getSimpleName() == "Cast" and node.child().dataType().typeName() == "string" and node.dataType().typeName() != "string":
        return True
    children = node.children()
    return any(_text_casts(children.apply(i)) for i in range(children.length()))


def compiled(spark: SparkSession, predicate: str | None) -> tuple[Column | None, str | None]:
    """The predicate as a column over ``FACTS``, or why it is refused.

    Rule text comes from files. Spark's parser reads it (PySpark has no public call for the parse
    tree, so this asks the JVM session); what is admitted is built anew from its parts, so nothing
    else can run, and nothing that can fail at run time: a bad rule fails by itself and never the job.
    """
    if not predicate or not predicate.strip():
        return None, "empty predicate"
    try:
        parsed = spark._jsparkSession.sessionState().sqlParser().parseExpression(predicate)
    except Exception as error:  # noqa: BLE001 - whatever Spark says of a text it cannot read
        return None, f"not readable: {str(error).strip().splitlines()[0][:120]}"
    try:
        column = _built(parsed)
        checked = spark.createDataFrame([], ", ".join(f"{n} {k}" for n, k in FACTS.items())).select(column.alias("ok"))
    except Refused as error:
        return None, str(error)
    except AnalysisException as error:
        return None, f"not valid: {str(error).strip().splitlines()[0][:120]}"
    if checked.schema["ok"].dataType.simpleString() != "boolean":
        return None, "not a condition"
    expressions = checked._jdf.queryExecution().analyzed().expressions()
    if any(_text_casts(expressions.apply(i)) for i in range(expressions.length())):
        return None, "compares text with something else"
    return column, None


def admitted(spark: SparkSession, predicate: str | None) -> bool:
    return compiled(spark, predicate)[1] is None


def refused_rules(rules: DataFrame) -> DataFrame:
    """Rules whose predicate is not admitted, with the reason: to be shown when rules are loaded."""
    spark = rules.sparkSession
    texts = [r["predicate"] for r in rule_table(rules).select("predicate").distinct().collect()]
    reasons = [(t, compiled(spark, t)[1]) for t in texts]
    found = spark.createDataFrame([r for r in reasons if r[1]], "predicate string, reason string")
    return rules.join(F.broadcast(found), rules["predicate"].eqNullSafe(found["predicate"])).select("rule_id", "version", rules["predicate"], "reason")


MAX_RULES = 10_000


def rule_table(rules: DataFrame) -> DataFrame:
    """Of versions that start on the same date, the newest; an error beyond ``MAX_RULES`` of them."""
    newest = Window.partitionBy("rule_id", "as_of").orderBy(F.col("version").desc())
    kept = rules.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")
    if kept.limit(MAX_RULES + 1).count() > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rule versions")
    return kept


def rules_in_force(contexts: DataFrame, rules: DataFrame) -> DataFrame:
    """Newest version per rule for each (action_type, rail, as_of) context."""
    by_action = rules.select("*", F.explode("applies_to").alias("action_type")).withColumnRenamed("as_of", "rule_as_of")
    applicable = contexts.join(by_action, "action_type").where(
        (F.col("rule_as_of") <= F.col("as_of")) & (F.col("rails").isNull() | F.array_contains("rails", F.col("rail")))
    )
    newest = Window.partitionBy("action_type", "rail", "as_of", "rule_id").orderBy(
        F.col("rule_as_of").desc(), F.col("version").desc()
    )
    return applicable.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")


def with_afa_cap(actions: DataFrame, caps: DataFrame) -> DataFrame:
    """Ceiling of the action's category as of its date, else the default; NULL without one."""
    history = caps.groupBy("mcc").agg(
        F.sort_array(F.collect_list(F.struct("as_of", "cap_paise")), asc=False).alias("_caps")
    )
    default = history.where("mcc = '*'").agg(F.any_value("_caps")).scalar()
    known = lambda versions: F.try_element_at(
        F.filter(versions, lambda c: c["as_of"] <= F.col("as_of")), F.lit(1)
    )["cap_paise"]
    joined = actions.join(history, "mcc", "left").withColumn("_default", default)
    return joined.withColumn("afa_free_cap", F.coalesce(known(F.col("_caps")), known(F.col("_default")))).drop("_caps", "_default")


def _check(spark: SparkSession, rule, applies: Column) -> Column:
    """A rule's outcome for an action it applies to; NULL where it does not apply. A rule not admitted fails."""
    condition, _ = compiled(spark, rule["predicate"])
    passed = F.lit(False) if condition is None else F.coalesce(condition, F.lit(False))
    verdict = F.when(passed, "ALLOW").otherwise(rule["on_fail"])
    return F.when(
        applies,
        F.struct(F.lit(rule["rule_id"]).alias("rule_id"), F.lit(rule["version"]).alias("version"), verdict.alias("verdict")),
    )


def evaluate_rules(actions: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rule in force against every action, worst verdict winning.

    The rule table, kept by people, is read once and becomes column expressions, so any number
    of actions is judged in one narrow pass. A predicate that is NULL (a missing fact) or not
    admitted fails; an action
    no rule covers is denied and marked degraded. Needs the columns of ``FACTS`` plus
    ``action_type``, ``rail`` and ``as_of``.
    """
    table = sorted(rule_table(rules).collect(), key=lambda r: (r["rule_id"], r["as_of"], r["version"]), reverse=True)
    missing = [F.lit(None).cast(kind).alias(name) for name, kind in FACTS.items() if name not in actions.columns]
    facts = actions.select("*", *missing) if missing else actions
    checks: dict[str, Column] = {}
    for rule in table:
        applies = F.col("action_type").isin(*rule["applies_to"]) & (F.col("as_of") >= F.lit(rule["as_of"]))
        if rule["rails"] is not None:
            applies = applies & F.coalesce(F.col("rail").isin(*rule["rails"]), F.lit(False))
        outcome = _check(actions.sparkSession, rule, applies)
        newer = checks.get(rule["rule_id"])
        checks[rule["rule_id"]] = outcome if newer is None else F.coalesce(newer, outcome)
    ordered = [checks[k] for k in sorted(checks)]
    ranks = F.create_map(*[F.lit(x) for pair in VERDICT_RANK.items() for x in pair])
    judged = facts.select(*actions.columns, F.array_compact(F.array(*ordered)).alias("checks"))
    worst = F.array_max(F.transform("checks", lambda c: F.element_at(ranks, c["verdict"])))
    names = F.array(*[F.lit(n) for n in VERDICT_RANK])
    degraded = F.size("checks") == 0
    return judged.select(
        "*", F.when(degraded, "DENY").otherwise(F.get(names, worst)).alias("verdict"), degraded.alias("degraded"),
        F.transform(F.filter("checks", lambda c: c["verdict"] != "ALLOW"), lambda c: c["rule_id"]).alias("failed_rules"),
    )


def baseline_actions(cycles: DataFrame, as_of) -> DataFrame:
    """The day 1/3/5 retries as unannounced debit attempts at 10:00 IST."""
    fired = legality.baseline_schedule(cycles, "due_at")
    return fired.select(
        "cycle_id", "attempt", "rail", "mcc", "amount_paise", F.lit("debit_attempt").alias("action_type"),
        F.lit(10.0).alias("hour_ist"), F.lit("consent").alias("consent_ref"), F.lit(False).alias("consent_withdrawn"),
        F.lit(as_of).cast("date").alias("as_of"),
    )


def shadow_audit(judged: DataFrame, cycles: int | Column) -> DataFrame:
    """Violations per rule among refused attempts, with the rate per 10 000 cycles."""
    failed = judged.where("verdict <> 'ALLOW'").select(F.explode("failed_rules").alias("rule_id"), "verdict")
    total = F.lit(cycles) if isinstance(cycles, int) else cycles
    return failed.groupBy("rule_id").agg(F.count("*").alias("violations")).withColumn(
        "per_10k_cycles", F.round(F.col("violations") * 10_000 / total, 4)
    )


def audit_totals(judged: DataFrame) -> DataFrame:
    """Attempts, how many were allowed, and how many each other verdict got."""
    counts = [F.count_if(F.col("verdict") == name).alias(name.lower()) for name in VERDICT_RANK if name != "ALLOW"]
    return judged.agg(F.count("*").alias("attempts"), F.count_if(F.col("verdict") == "ALLOW").alias("allowed"), *counts)


def rules_not_in_force(headline: DataFrame, in_force: DataFrame) -> DataFrame:
    return headline.select("rule_id").exceptAll(in_force.select("rule_id").distinct())
