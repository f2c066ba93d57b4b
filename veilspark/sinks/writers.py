"""Gated outputs: nothing leaves a blocked result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.report import ExportBlocked, Report
from ..operators.sanitize import SanitizeResult
from ..sources.formats import SEPARATORS

TABLE_FORMATS = ("parquet", "orc", "json", *SEPARATORS)


def write_rows(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", rows_per_file: int = 0) -> None:
    """``rows_per_file`` (0: any number) bounds the files that a reader cannot split."""
    if fmt not in TABLE_FORMATS:
        raise ValueError(f"unsupported output type: {fmt}")
    writer = df.write.mode(mode).option("maxRecordsPerFile", rows_per_file)
    if fmt in SEPARATORS:
        writer.option("header", True).option("sep", SEPARATORS[fmt]).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def write_safe(
    result: SanitizeResult, path: str, fmt: str = "parquet", mode: str = "errorifexists"
) -> Report:
    """Write the safe rows if the gate passed, and return the full report. Free-text
    counters are observed during the write, so text is scanned once. Files appear
    through the job committer, all or none."""
    if not result.can_export:
        raise ExportBlocked("export is blocked: " + ", ".join(result.gate.block_reasons))
    rows, seen = result.observed()
    write_rows(rows, path, fmt, mode)
    if seen is not None:
        result.add_text_counts(seen.get)
    return result.report()


def write_report(report: Report, spark, path: str, mode: str = "errorifexists") -> None:
    """Counters and column actions as two small tables under ``path``; reports of jobs carry
    project, job and kind of input in every row, so that many of them share the tables."""
    named = {name: F.lit(value) for name, value in report.identity().items()}
    for part, rows in (("counters", report.counters(spark)), ("columns", report.columns(spark))):
        rows.withColumns(named).coalesce(1).write.mode(mode).parquet(f"{path}/{part}")
