"""Fixed schemas. Nothing is ever inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _B, _TS = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


#: Raw event log: one row per delivery of a provider event.
EVENTS_RAW = _struct(
    event_id=_S, tenant_id=_S, body=_S, signature=_S, signature_ok=_B, received_at=_TS
)

#: The provider's JSON body, restricted to the paths the engine reads.
_ENTITY = _struct(
    id=_S, current_end=_L, invoice_id=_S, amount=_L, error_code=_S, error_reason=_S,
    token_id=_S, expire_by=_L,
)
BODY = _struct(
    id=_S,
    event=_S,
    created_at=_L,
    payload=_struct(
        subscription=_struct(entity=_ENTITY),
        payment=_struct(entity=_ENTITY),
        invoice=_struct(entity=_ENTITY),
        token=_struct(entity=_ENTITY),
    ),
)

#: Normalised events, the input of every projection.
EVENTS = _struct(
    event_id=_S, tenant_id=_S, mandate_id=_S, cycle_ref=_S, event_type=_S, occurred_at=_TS,
    deadline_at=_TS, amount_paise=_L, decline_code=_S,
)

RULES = _struct(
    rule_id=_S, version=_I, regulator=_S, citation=_S, as_of=T.DateType(),
    applies_to=T.ArrayType(_S), rails=T.ArrayType(_S), predicate=_S, on_fail=_S,
)

CAPS = _struct(mcc=_S, cap_paise=_L, as_of=T.DateType())

ATTEMPTS = _struct(
    attempt_id=_S, tenant_id=_S, cycle_id=_S, idem_key=_S, state=_S, decline_code=_S,
    presented_at=_TS, outcome_due_at=_TS,
)
