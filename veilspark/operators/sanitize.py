"""Sanitize whole tables: scan, gate, then one projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import canonical_string, is_missing, quoted
from ..keys import ProjectKey
from ..policy import ColumnPlan, Policy, Recognizer, resolve_actions
from . import report as r
from .actions import action_column, subject_columns, tokenize
from .detection import VISIBLE, Findings, check_override, column_findings, residual_findings
from .report import ExportBlocked, Report, ReviewOverride
from .synthesize import left_name, synthesize_numeric
from .text_scan import EntityDetector, scan_distinct_text, scan_text, text_counters


@dataclass
class SanitizeResult:
    """A gated result. ``staged`` still holds originals and never leaves the gate."""

    staged: DataFrame = field(repr=False)
    plans: list[ColumnPlan]
    policy: Policy
    key: ProjectKey = field(repr=False)
    gate: Report
    ascii_only: set[str] = field(default_factory=set)
    #: Kept columns that show findings: nothing gives them out while the gate is shut.
    shown: tuple[str, ...] = ()
    _text_done: bool = False

    @property
    def can_export(self) -> bool:
        return not self.gate.blocked

    @property
    def safe(self) -> DataFrame:
        """The safe rows, whether or not the gate passes; sinks use ``export``."""
        return self.staged.select(*self.safe_columns())

    @property
    def masked(self) -> DataFrame:
        """The safe rows, with null in place of the columns that show findings."""
        return self.safe.withColumns({c: F.lit(None).cast("string") for c in self.shown})

    def export(self) -> DataFrame:
        if not self.can_export:
            raise ExportBlocked("export is blocked: " + ", ".join(self.gate.block_reasons))
        return self.safe

    def safe_columns(self) -> list:
        source = self.staged.schema
        names = [p.name for p in self.plans]
        schema = type(source)([source[name] for name in names])
        columns = []
        for plan in self.plans:
            if plan.action == "drop":
                continue
            if plan.action == "redact_text":
                column = F.col(f"{scan_name(plan)}.safe")
            elif plan.action == "synthesize":
                column = F.col(draw_name(plan))
            else:
                column = action_column(plan, schema, self.policy, self.key, self.ascii_only)
            columns.append(column.alias(plan.name))
        return columns

    def text_aggregates(self) -> list:
        """Counters of free-text columns, and of originals that synthesis left in place, for a
        report or an observed write."""
        return [
            column.alias(f"{kind}_{plan.name}")
            for plan in self.plans
            if plan.action == "redact_text"
            for kind, column in text_counters(scan_name(plan)).items()
        ] + [
            F.count_if(F.col(left_name(draw_name(plan)))).alias(f"left_{plan.name}")
            for plan in self.plans
            if plan.action == "synthesize"
        ]

    def observed(self) -> tuple[DataFrame, Observation | None]:
        """The safe rows, and an observation that counts free-text findings while they
        are written, so that text is scanned once."""
        aggregates = self.text_aggregates()
        if not aggregates:
            return self.safe, None
        seen = Observation()
        return self.staged.observe(seen, *aggregates).select(*self.safe_columns()), seen

    def add_text_counts(self, counts: Mapping[str, int]) -> None:
        if self._text_done:
            return
        for plan in self.plans:
            if plan.action == "redact_text":
                kinds = ("secrets", "pii", "entities", "custom")
                self.gate.add_text(*[int(counts.get(f"{kind}_{plan.name}") or 0) for kind in kinds])
            elif plan.action == "synthesize":
                self.gate.originals_left[plan.name] = int(counts.get(f"left_{plan.name}") or 0)
        self._text_done = True

    def report(self) -> Report:
        """The full report. Free-text counters cost one pass unless a write observed them."""
        aggregates = self.text_aggregates()
        if aggregates and not self._text_done:
            self.add_text_counts(self.staged.agg(*aggregates).first().asDict())
        return self.gate

    def mapping(self) -> DataFrame:
        """Distinct (token, token_type, original) of token columns and of text tokens."""
        pairs = [
            F.array(
                F.when(
                    ~is_missing(quoted(p.name), p.dtype),
                    F.struct(
                        tokenize(quoted(p.name), p.dtype, p.token_type, self.key).alias("token"),
                        F.lit(p.token_type).alias("token_type"),
                        canonical_string(quoted(p.name), p.dtype).alias("original"),
                    ),
                )
            )
            for p in self.plans
            if p.action == "tokenize"
        ]
        pairs += [
            F.coalesce(F.col(f"{scan_name(p)}.tokens"), F.array())
            for p in self.plans
            if p.action == "redact_text" and self.policy.recognizers
        ]
        if not pairs:
            return self.staged.sparkSession.createDataFrame(
                [], "token string, token_type string, original string"
            )
        minted = self.staged.select(F.explode(F.array_compact(F.concat(*pairs))).alias("m"))
        return minted.select("m.token", "m.token_type", "m.original").distinct()


def scan_name(plan: ColumnPlan) -> str:
    return work_name("scan", plan.name)


def draw_name(plan: ColumnPlan) -> str:
    return work_name("draw", plan.name)


def work_name(kind: str, column: str) -> str:
    """A working column's name, one for each column, whatever characters that has."""
    return f"__{kind}_{column.encode().hex()}"


def gate_columns(
    plans: Sequence[ColumnPlan], findings: Findings, policy: Policy, report: Report
) -> list[ColumnPlan]:
    """Final plans: secret columns become drops; findings and reasons enter the report."""
    final = []
    subjects = subject_columns([p.name for p in plans], policy)
    for plan in plans:
        secrets = findings.of(plan.name, "secret")
        if plan.secret_name or secrets:
            plan = replace(plan, action="drop")
            detected = secrets or findings.rows
            report.secret_detections += detected
            report.add_detector(r.SECRET_SCANNER, detected)
        else:
            if plan.schema_type:
                report.add_detector(r.SCHEMA_DETECTOR, findings.rows)
            found = {k: findings.of(plan.name, k) for k in ("pii", "entity", "custom")}
            report.add_detector(r.PII_SCANNER, found["pii"])
            report.add_detector(r.ENTITY_SCANNER, found["entity"])
            report.add_detector(r.CUSTOM_RECOGNIZER, found["custom"])
            if plan.action == "keep" and sum(found.values()):
                report.residual_detections += sum(found.values())
                report.block(r.RESIDUAL)
            if plan.action == "review_required":
                report.review_columns.append(plan.name)
            if plan.action in subjects and subjects[plan.action] is None:
                report.block(r.NO_SUBJECT if plan.action == "date_shift" else r.NO_TIME_SUBJECT)
        report.column_actions[plan.name] = plan.action
        report.add_action(plan.action, findings.rows)
        final.append(plan)
    return final


def needs_detector(plans: Sequence[ColumnPlan], mode: str) -> bool:
    return mode == "strict" or any(p.action in ("redact_text", "review_required") for p in plans)


def sanitize_table(
    df: DataFrame,
    policy: Policy,
    key: ProjectKey,
    mode: str = "strict",
    override: ReviewOverride | None = None,
    recognizers: Sequence[Recognizer] = (),
    detector: EntityDetector | None = None,
    row_key: Sequence[str] | None = None,
    distinct_text: bool = False,
) -> SanitizeResult:
    """Apply a policy to every row of a table.

    Job 1 counts findings in the columns that stay visible (or all, in strict mode);
    the driver then knows which columns drop and whether export is blocked. The safe
    rows are a projection of the input that runs when the result is used.
    ``distinct_text`` scans each distinct free text once, for repetitive columns.
    """
    policy = replace(policy, recognizers=(*policy.recognizers, *recognizers))
    plans = resolve_actions(df.schema, policy)
    check_override(df, override)
    findings = column_findings(df, policy, mode, policy.recognizers, detector)
    report = Report(
        rows=findings.rows,
        policy_fingerprint=policy.fingerprint,
        override=override,
        date_shift=vars(policy.date_shift).copy(),
        time_shift=vars(policy.time_shift).copy(),
    )
    if needs_detector(plans, mode) and policy.security.require_entity_detector and detector is None:
        report.block(r.NO_DETECTOR)
    final = gate_columns(plans, findings, policy, report)
    if report.review_columns and override is None:
        report.block(r.REVIEW_REQUIRED)

    result = planned_rows(
        df, final, policy, key, row_key or df.columns, detector, distinct_text, findings.ascii_only
    )
    result.gate = report
    shown = tuple(
        p.name
        for p in final
        if p.action == "keep" and any(findings.of(p.name, k) for k in ("pii", "entity", "custom"))
    )
    result.shown = shown
    return result


def planned_rows(
    df: DataFrame,
    plans: list[ColumnPlan],
    policy: Policy,
    key: ProjectKey,
    row_key: Sequence[str],
    detector: EntityDetector | None = None,
    distinct_text: bool = False,
    ascii_only: set[str] = frozenset(),
) -> SanitizeResult:
    """The rows under final plans, with a report that a gate has yet to fill."""
    staged = df
    for plan in plans:
        if plan.action == "synthesize":
            staged = synthesize_numeric(staged, plan.name, draw_name(plan), key, row_key)
        elif plan.action == "redact_text":
            scan = scan_distinct_text if distinct_text else scan_text
            staged = scan(staged, plan.name, scan_name(plan), key, policy.recognizers, detector)
    return SanitizeResult(staged, plans, policy, key, Report(), set(ascii_only))


def sanitize_tables(
    tables: Mapping[str, DataFrame], policy: Policy, key: ProjectKey, **options
) -> dict[str, SanitizeResult]:
    """Many tables under one key, so equal values of one domain get one token everywhere."""
    return {name: sanitize_table(df, policy, key, **options) for name, df in tables.items()}


def sanitize_records(spark, records: Sequence[Mapping], policy: Policy, key: ProjectKey, **options):
    """Rows given by the caller as dicts, through the same gate."""
    return sanitize_table(spark.createDataFrame(list(records)), policy, key, **options)


def sanitize_text(
    df: DataFrame,
    column: str,
    policy: Policy,
    key: ProjectKey,
    recognizers: Sequence[Recognizer] = (),
    detector: EntityDetector | None = None,
) -> SanitizeResult:
    """Whole documents: redact one text column, keep the others out of the result, and
    rescan the output. Anything still found blocks export."""
    policy = replace(policy, recognizers=(*policy.recognizers, *recognizers))
    report = Report(policy_fingerprint=policy.fingerprint)
    if policy.security.require_entity_detector and detector is None:
        report.block(r.NO_DETECTOR)
    plan = replace(
        resolve_actions(df.select(column).schema, policy)[0], action="redact_text", secret_name=False
    )
    staged = scan_text(df, column, scan_name(plan), key, policy.recognizers, detector)
    result = SanitizeResult(staged, [plan], policy, key, report)
    residual = residual_findings(result.safe, [column], policy.recognizers, detector).first()["n"]
    if residual:
        report.residual_detections = residual
        report.block(r.RESIDUAL)
    report.column_actions[column] = "redact_text"
    return result


__all__ = [
    "VISIBLE",
    "SanitizeResult",
    "gate_columns",
    "needs_detector",
    "planned_rows",
    "sanitize_records",
    "sanitize_table",
    "sanitize_tables",
    "sanitize_text",
    "work_name",
]
