"""Draft a policy from a table by an ordered list of rules. Names and types decide what they
can; one profiling job reads the other columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.numbers import is_number
from ..functions.text import quoted
from ..policy import is_secret_column, schema_type
from .naming import canonical_name, name_features, token_domain
from .profile import profile_tables


@dataclass(frozen=True)
class Decision:
    column_name: str
    canonical_name: str | None
    action: str
    confidence: float
    reason: str
    role: str


class NeedsValues(LookupError):
    """A rule asks for the values of a column that was not profiled."""


class _Unprofiled(dict):
    def __missing__(self, feature: str):
        raise NeedsValues(feature)


@dataclass(frozen=True)
class Evidence:
    """All that is known about one column when the rules run."""

    name: str
    dtype: T.DataType
    features: Mapping[str, Any]
    profile: Mapping[str, Any]
    has_subject: bool

    def named(self, *names: str) -> bool:
        return self.features["canonical_name"] in names

    def __getitem__(self, feature: str) -> bool:
        known = self.features if feature in self.features else self.profile
        return bool(known[feature])

    @property
    def clock_values(self) -> bool:
        return self["is_time"] and self.profile["time_like_share"] >= 0.8

    @property
    def datetime_typed(self) -> bool:
        return isinstance(self.dtype, (T.TimestampType, T.TimestampNTZType))


@dataclass(frozen=True)
class Rule:
    when: Callable[[Evidence], bool]
    action: str
    confidence: float
    reason: str
    role: str


def _date_rules(when: Callable[[Evidence], bool], confidence: float, reason: str, else_reason: str):
    """Dates shift if their rows have a subject, and need review if not."""
    return (
        Rule(lambda e: when(e) and e.has_subject, "date_shift", confidence, reason, "date"),
        Rule(when, "review_required", 0.62, else_reason, "date"),
    )


_DIRECT = "direct_identifier"
_NO_SUBJECT = "date-like field has no detected subject identifier"

# Order, actions, confidences, reasons and roles. The first match wins.
RULES = (
    Rule(lambda e: is_secret_column(e.name), "drop", 1.0, "secret column name", "secret"),
    Rule(
        lambda e: e.named("customer_name", "email", "phone", "loan_no", "account_no"),
        "tokenize", 0.98, "recognized {canonical} column", _DIRECT,
    ),
    Rule(lambda e: e.named("customer_id"), "tokenize", 0.99, "joinable customer identifier", _DIRECT),
    Rule(lambda e: e.named("address"), "tokenize", 0.95, "direct address identifier", _DIRECT),
    Rule(
        lambda e: e.named("amount"),
        "review_required", 0.95, "numeric measure requires explicit policy", "unknown_numeric",
    ),
    *_date_rules(
        lambda e: e.named("transaction_date"),
        0.94, "date linked to a stable subject", "date has no detected subject identifier",
    ),
    Rule(
        lambda e: e.named("province", "status"),
        "keep", 0.96, "low-risk categorical value", "public_category",
    ),
    Rule(
        lambda e: e.named("note"),
        "redact_text", 0.92, "free text scanned and selectively redacted", "free_text",
    ),
    Rule(
        lambda e: schema_type(e.name) is not None,
        "tokenize", 0.9, "schema detector identified sensitive field", _DIRECT,
    ),
    Rule(
        lambda e: e["is_actor"],
        "tokenize", 0.94, "user or audit actor identifier", "user_identifier",
    ),
    Rule(lambda e: e.clock_values, "time_shift", 0.9, "time-only value shifted per subject", "time"),
    Rule(
        lambda e: e["is_category"] and e["is_safe_category"],
        "keep", 0.9, "safe low-cardinality category", "public_category",
    ),
    Rule(
        lambda e: e["is_description"] and e["is_category_candidate"],
        "tokenize", 0.88, "repeated description treated as a category", "category",
    ),
    Rule(
        lambda e: e["is_free_text"],
        "redact_text", 0.8, "free text scanned and selectively redacted", "free_text",
    ),
    Rule(
        lambda e: e["is_operational"] and e["is_category_candidate"],
        "tokenize", 0.88, "repeated operational category", "category",
    ),
    Rule(
        lambda e: e["is_operational"],
        "tokenize", 0.88, "operational business identifier", "category",
    ),
    Rule(
        lambda e: e["is_identifier"],
        "tokenize", 0.82, "identifier-like business column", "business_identifier",
    ),
    *_date_rules(
        lambda e: e["is_date"], 0.82, "date-like business column linked to a subject", _NO_SUBJECT
    ),
    Rule(
        lambda e: e["is_amount"],
        "review_required", 0.82, "amount-like measure requires explicit policy", "unknown_numeric",
    ),
    Rule(
        lambda e: e["is_category"], "tokenize", 0.72, "high-cardinality or rare category", "category"
    ),
    *_date_rules(
        lambda e: e.datetime_typed, 0.72, "unknown date-like field linked to a subject", _NO_SUBJECT
    ),
    Rule(
        lambda e: isinstance(e.dtype, T.BooleanType),
        "keep", 0.9, "boolean category", "public_category",
    ),
    Rule(
        lambda e: e["is_category_candidate"],
        "tokenize", 0.78, "low-cardinality repeated values", "category",
    ),
    Rule(
        lambda e: is_number(e.dtype),
        "review_required", 0.7, "unknown numeric measure requires explicit policy", "unknown_numeric",
    ),
    Rule(
        lambda e: True,
        "review_required", 0.65, "unknown text/code field requires explicit policy", "unknown_text",
    ),
)


@dataclass(frozen=True)
class InferredPolicy:
    decisions: tuple[Decision, ...]
    subject_column: str | None

    @property
    def columns(self) -> dict[str, str]:
        return {d.column_name: d.action for d in self.decisions}

    @property
    def roles(self) -> dict[str, str]:
        return {d.column_name: d.role for d in self.decisions}

    @property
    def review_columns(self) -> list[str]:
        return list(dict.fromkeys(d.column_name for d in self.decisions if d.action == "review_required"))

    @property
    def token_domains(self) -> dict[str, str]:
        return {
            d.column_name: token_domain(d.column_name)
            for d in self.decisions
            if d.action == "tokenize"
            and (d.role == "category" or name_features(d.column_name)["is_operational"])
        }

    def draft(self) -> dict[str, Any]:
        """A complete policy document for review. It never holds a source value."""
        subject = self.subject_column or "customer_id"
        shift = {"scope": "subject", "subject_column": subject, "direction": "both", "stability": "project"}
        return {
            "security": {
                "require_entity_detector": True,
                "store_raw_copy": False,
                "raw_ttl_hours": 24,
                "mapping_ttl_days": 30,
                "reject_duplicate_job_id": True,
            },
            "date_shift": {**shift, "min_days": 1, "max_days": 30},
            "time_shift": {**shift, "min_minutes": 1, "max_minutes": 720},
            "columns": self.columns,
            "token_domains": self.token_domains,
            "default": {"unknown_column": "review_required"},
            "bucket": {},
            "custom_recognizers": [],
        }

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(d.column_name, d.canonical_name, d.action, d.confidence, d.reason, d.role) for d in self.decisions],
            "column_name string, canonical_name string, action string, confidence double, "
            "reason string, role string",
        )


def infer_policy(df: DataFrame) -> InferredPolicy:
    """Let the first matching rule decide each column."""
    return infer_policies({"table": df})["table"]


def infer_policies(tables: Mapping[str, DataFrame]) -> dict[str, InferredPolicy]:
    """A policy for each of many tables. Columns that no rule can decide by name and type
    are profiled, all by the same job; one row for each of them reaches the driver."""
    open_columns = {}
    for name, df in tables.items():
        subject = bool(_subjects(df))
        undecided = [c.name for c in df.schema.fields if _matching(c, _Unprofiled(), subject) is None]
        if undecided:
            open_columns[name] = df.select(*map(quoted, undecided))
    profiles = (
        {
            (row["table_name"], row["column_name"]): row.asDict()
            for row in profile_tables(open_columns).collect()
        }
        if open_columns
        else {}
    )
    return {
        name: _decide(df, {c: profiles.get((name, c), _Unprofiled()) for c in df.columns})
        for name, df in tables.items()
    }


def _subjects(df: DataFrame) -> list[str]:
    return [name for name in df.columns if canonical_name(name) == "customer_id"]


def _matching(column: T.StructField, profile: Mapping[str, Any], has_subject: bool) -> Rule | None:
    """The first rule that holds; none if one before it asks for values that are not there."""
    evidence = Evidence(column.name, column.dataType, name_features(column.name), profile, has_subject)
    try:
        return next(rule for rule in RULES if rule.when(evidence))
    except NeedsValues:
        return None


def _decide(df: DataFrame, profiles: Mapping[str, Mapping[str, Any]]) -> InferredPolicy:
    subjects = _subjects(df)
    decisions = []
    for column in df.schema.fields:
        rule = _matching(column, profiles[column.name], bool(subjects))
        canonical = canonical_name(column.name)
        reason = rule.reason.format(canonical=canonical)
        decisions.append(
            Decision(column.name, canonical, rule.action, rule.confidence, reason, rule.role)
        )
    return InferredPolicy(tuple(decisions), subjects[-1] if subjects else None)


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """All rows of all tables; a column a table lacks is null there. A column whose type
    differs between tables becomes text."""
    types: dict[str, set[str]] = {}
    for table in tables:
        for column in table.schema.fields:
            types.setdefault(column.name, set()).add(column.dataType.simpleString())
    mixed = [name for name, kinds in types.items() if len(kinds) > 1]
    cast = [
        t.withColumns({c: t[f"`{c}`"].cast("string") for c in mixed if c in t.columns}) if mixed else t
        for t in tables
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def combined_policy(tables: list[DataFrame]) -> InferredPolicy:
    """One policy for many tables, from all their rows."""
    return infer_policy(union_tables(tables))
