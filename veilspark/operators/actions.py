"""One Column per policy action. Nothing here reads data: the gate ran before."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import parse_date
from ..functions.hashing import identifier_hash, keyed_offset, token_for
from ..functions.numbers import bucket_label, seconds_of_day
from ..functions.text import canonical_string, is_missing, normalized_string, quoted
from ..keys import ProjectKey
from ..policy import ColumnPlan, Policy, find_column

REVIEW = "[REVIEW_REQUIRED]"
REVIEW_DATE = "[REVIEW_REQUIRED_DATE]"
REVIEW_TIME = "[REVIEW_REQUIRED_TIME]"
REDACTED_DATE = "[REDACTED_DATE]"
REDACTED_TIME = "[REDACTED_TIME]"


# Missing values become null before any hashing, and nulls pass through: without a CASE
# around them the expensive parts are evaluated once per row by common sub-expressions.


def tokenize(value: Column, dtype: T.DataType, token_type: str, key: ProjectKey) -> Column:
    present = F.when(~is_missing(value, dtype), canonical_string(value, dtype))
    return token_for(key, token_type, present)


def present_subject(subject: Column, dtype: T.DataType, ascii_only: bool) -> Column:
    return F.when(~is_missing(subject, dtype), normalized_string(subject, dtype, ascii_only))


def hash_id(value: Column, dtype: T.DataType, key: ProjectKey, ascii_only: bool = False) -> Column:
    return identifier_hash(key, normalized_string(value, dtype, ascii_only))


def date_shift(
    value: Column, dtype: T.DataType, subject: Column, subject_type: T.DataType,
    policy: Policy, key: ProjectKey, ascii_only: bool = False,
) -> Column:
    shift = policy.date_shift
    days = keyed_offset(
        key, "date_shift", present_subject(subject, subject_type, ascii_only),
        shift.low, shift.high, shift.direction,
    )
    moved = F.date_format(F.date_add(parse_date(value, dtype), days), "yyyy-MM-dd")
    return F.coalesce(moved, F.lit(REDACTED_DATE))


def time_shift(
    value: Column, dtype: T.DataType, subject: Column, subject_type: T.DataType,
    policy: Policy, key: ProjectKey, ascii_only: bool = False,
) -> Column:
    shift = policy.time_shift
    minutes = keyed_offset(
        key, "time_shift", present_subject(subject, subject_type, ascii_only),
        shift.low, shift.high, shift.direction,
    )
    moved = F.pmod(seconds_of_day(value, dtype) + minutes * 60, F.lit(86400))
    midnight = F.lit("1970-01-01").cast("timestamp_ntz")
    clock = F.date_format(
        midnight + F.make_dt_interval(secs=moved.cast("decimal(18,6)")), "HH:mm:ss"
    )
    return F.coalesce(clock, F.when(~is_missing(value, dtype), F.lit(REDACTED_TIME)))


def subject_columns(columns: list[str], policy: Policy) -> dict[str, str | None]:
    """The subject column each shifting action uses in a table, None when it is absent."""
    return {
        "date_shift": find_column(columns, policy.date_shift.subject_column),
        "time_shift": find_column(columns, policy.time_shift.subject_column),
    }


def action_column(
    plan: ColumnPlan, schema: T.StructType, policy: Policy, key: ProjectKey, ascii_only: set[str]
) -> Column:
    """The safe form of a column, for every action that is a plain expression of its row."""
    value, dtype = quoted(plan.name), plan.dtype
    if plan.action == "keep":
        return value
    if plan.action == "tokenize":
        return tokenize(value, dtype, plan.token_type, key)
    if plan.action == "hash":
        return hash_id(value, dtype, key, plan.name in ascii_only)
    if plan.action == "bucket":
        return bucket_label(value, dtype, policy.bucket_rules_for(plan.name))
    if plan.action == "redact":
        return F.lit(f"[REDACTED_{plan.schema_type or 'UNKNOWN_VALUE'}]")
    if plan.action in ("date_shift", "time_shift"):
        subject = subject_columns(schema.names, policy)[plan.action]
        if subject is None:
            return F.lit(REVIEW_DATE if plan.action == "date_shift" else REVIEW_TIME)
        shifted = date_shift if plan.action == "date_shift" else time_shift
        return shifted(
            value, dtype, quoted(subject), schema[subject].dataType,
            policy, key, subject in ascii_only,
        )
    return F.lit(REVIEW)
