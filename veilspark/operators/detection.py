"""Findings per column and detector: the aggregate every gate decision rests on."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import is_number
from ..functions.patterns import SECRET_RULES, TEXT_RULES
from ..functions.spans import any_rule
from ..functions.text import canonical_string, fold_case, is_ascii, quoted, strip
from ..policy import ColumnPlan, Policy, Recognizer, resolve_actions
from .actions import subject_columns
from .report import ReviewOverride
from .text_scan import (
    EntityDetector,
    count_pii,
    count_recognized,
    count_secrets,
    entity_redactor,
    recognizer_rules,
    with_flags,
)

MODES = ("strict", "targeted")
VISIBLE = ("keep", "review_required")


@dataclass
class Findings:
    """Counts of one table: ``counts[(column, detector)]``, and which columns are ASCII."""

    rows: int
    counts: dict[tuple[str, str], int] = field(default_factory=dict)
    ascii_only: set[str] = field(default_factory=set)

    def of(self, column: str, detector: str) -> int:
        return self.counts.get((column, detector), 0)


def scans_secrets(plan: ColumnPlan, mode: str) -> bool:
    wanted = plan.secret_name or plan.action in VISIBLE
    wanted = wanted or (mode == "strict" and plan.action != "redact_text")
    return wanted and not is_number(plan.dtype) and not is_temporal(plan.dtype)


def is_temporal(dtype: T.DataType) -> bool:
    """Typed dates and timestamps: their text form can match no rule of ours."""
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def _text_of(plan: ColumnPlan) -> Column:
    return canonical_string(quoted(plan.name), plan.dtype)


def wanted_pairs(
    plans: Sequence[ColumnPlan], mode: str, recognizers: Sequence[Recognizer], detector
) -> list[tuple[ColumnPlan, str]]:
    """The (column, detector) pairs a gate decision needs."""
    pairs = []
    for plan in plans:
        if scans_secrets(plan, mode):
            pairs.append((plan, "secret"))
        if plan.action in VISIBLE and not plan.secret_name:
            if not is_temporal(plan.dtype):
                pairs.append((plan, "pii"))
            if recognizers:
                pairs.append((plan, "custom"))
            if plan.action == "review_required" and detector is not None:
                pairs.append((plan, "entity"))
    return pairs


def _suspect(plan: ColumnPlan, kind: str, recognizers: Sequence[Recognizer]) -> Column:
    """Cheap superset of "this value has a finding": rule by rule, each behind its substring
    test; a user's patterns as they are."""
    rules = {"secret": SECRET_RULES, "pii": TEXT_RULES}.get(kind) or recognizer_rules(recognizers)
    return any_rule(_text_of(plan), rules)


def _exact(
    plan: ColumnPlan, kind: str, recognizers: Sequence[Recognizer], detector, flags: dict[str, Column]
) -> Column:
    text = _text_of(plan)
    if kind == "entity":
        return entity_redactor(detector)(text)["n"]
    if kind == "custom":
        return count_recognized(text, recognizers, flags)
    return count_secrets(text) if kind == "secret" else count_pii(text)


def count_columns(
    df: DataFrame,
    pairs: Sequence[tuple[ColumnPlan, str]],
    exact: set[tuple[str, str]],
    recognizers: Sequence[Recognizer],
    detector,
) -> tuple[DataFrame, list[str]]:
    """df with a count for each (column, detector) pair in a column of its own, and the names of
    these: to be summed by an observation on the write of the same rows. Pairs in ``exact``
    count findings, the others the values that may have one; entities are always findings."""
    names = []
    for i, (plan, kind) in enumerate(pairs):
        if kind == "entity" or (plan.name, kind) in exact:
            flags: dict[str, Column] = {}
            if kind == "custom":
                df, flags = with_flags(df, _text_of(plan), recognizers, f"__gate_{i}")
            count = _exact(plan, kind, recognizers, detector, flags)
        else:
            count = _suspect(plan, kind, recognizers).cast("int")
        names.append(f"__found_{i}")
        df = df.withColumn(names[-1], F.coalesce(count, F.lit(0)).cast("bigint"))
    return df, names


def column_findings(
    df: DataFrame, policy: Policy, mode: str = "strict",
    recognizers: Sequence[Recognizer] = (), detector: EntityDetector | None = None,
) -> Findings:
    """Findings per column and detector, for the columns that need a scan; others are
    not even read. One aggregate looks for suspects with one regex per detector; only
    columns that have some are counted exactly, by a second aggregate."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    plans = resolve_actions(df.schema, policy)
    wanted = wanted_pairs(plans, mode, recognizers, detector)
    checks = [(plan, kind) for plan, kind in wanted if kind != "entity"]
    subjects = set(subject_columns(df.columns, policy).values())
    shifting = {p.action for p in plans} & {"date_shift", "time_shift"}
    keyed = [
        p
        for p in plans
        if isinstance(p.dtype, T.StringType)
        and (p.action == "hash" or (shifting and p.name in subjects))
    ]
    row = df.agg(
        F.count(F.lit(1)),
        *[F.count_if(_suspect(plan, kind, recognizers)) for plan, kind in checks],
        *[F.count_if(~is_ascii(_text_of(plan))) for plan in keyed],
    ).first()
    suspects = {(plan.name, kind) for (plan, kind), n in zip(checks, row[1:]) if n}
    ascii_only = {plan.name for plan, n in zip(keyed, row[1 + len(checks) :]) if not n}

    counts = {(plan.name, kind): 0 for plan, kind in wanted}
    exact = [(p, k) for p, k in wanted if k == "entity" or (p.name, k) in suspects]
    if exact:
        staged, totals = df, []
        for plan, kind in exact:
            flags: dict[str, Column] = {}
            if kind == "custom":
                staged, flags = with_flags(staged, _text_of(plan), recognizers, plan.name)
            totals.append(F.sum(_exact(plan, kind, recognizers, detector, flags)))
        sums = staged.agg(*totals).first()
        counts.update({(p.name, k): int(n or 0) for (p, k), n in zip(exact, sums)})
    return Findings(int(row[0]), counts, ascii_only)


def findings_table(df: DataFrame, policy: Policy, mode: str = "strict", recognizers=()) -> DataFrame:
    """(column_name, detector, n), one row per scanned column and detector."""
    findings = column_findings(df, policy, mode, recognizers)
    return df.sparkSession.createDataFrame(
        [(column, kind, n) for (column, kind), n in findings.counts.items()],
        "column_name string, detector string, n bigint",
    )


def residual_findings(
    df: DataFrame, columns: Sequence[str], recognizers: Sequence[Recognizer] = (),
    detector: EntityDetector | None = None,
) -> DataFrame:
    """(column_name, n): secrets, personal data, entities and non-keep recognizer matches
    still present in finished columns."""
    active = [r for r in recognizers if r.action != "keep"]
    schema, sums = df.schema, []
    for name in columns:
        text = canonical_string(quoted(name), schema[name].dataType)
        df, flags = with_flags(df, text, active, name)
        n = count_secrets(text) + count_pii(text) + count_recognized(text, active, flags)
        if detector is not None:
            n = n + entity_redactor(detector)(text)["n"]
        sums.append(F.coalesce(F.sum(n), F.lit(0)).cast("bigint"))
    if not sums:
        return df.sparkSession.createDataFrame([], "column_name string, n bigint")
    rows = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n")) for i, c in enumerate(columns)]
    )
    wide = df.agg(*[s.alias(f"n{i}") for i, s in enumerate(sums)])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def residual_scan(
    safe: DataFrame, policy: Policy, recognizers: Sequence[Recognizer] = (),
    detector: EntityDetector | None = None,
) -> DataFrame:
    """Residual findings of the columns a policy leaves visible."""
    plans = [p for p in resolve_actions(safe.schema, policy) if p.action in VISIBLE]
    kept = [p.name for p in plans if p.action == "keep"]
    reviewed = [p.name for p in plans if p.action != "keep"]
    return residual_findings(safe, kept, recognizers).unionByName(
        residual_findings(safe, reviewed, recognizers, detector)
    )


def leaked_values(df: DataFrame, text: str, least: int = 4) -> DataFrame:
    """Rows that hold a cell of ``least`` characters or more found inside ``text``."""
    reason = text.casefold()
    folded = F.lit(reason)
    found = F.lit(False)
    for column in df.schema.fields:
        if isinstance(column.dataType, T.BinaryType):
            continue
        cell = strip(canonical_string(quoted(column.name), column.dataType))
        # a cell longer than the text is not in it, and is not worth folding
        found = found | F.coalesce(
            F.when(F.length(cell).between(least, len(reason)), folded.contains(fold_case(cell))),
            F.lit(False),
        )
    return df.where(found)


def check_override(df: DataFrame, override: ReviewOverride | None) -> None:
    """A reviewer's reason may hold no secret, no personal data and no imported cell."""
    if override is None:
        return
    reason = F.lit(override.reason)
    suspicious = any_rule(reason, (*SECRET_RULES, *TEXT_RULES))
    one = df.sparkSession.range(1)
    if one.where(suspicious).where(count_secrets(reason) + count_pii(reason) > 0).take(1):
        raise ValueError("override reason must not contain secrets or personal data")
    if leaked_values(df, override.reason).take(1):
        raise ValueError("override reason must not contain an imported value")
