"""A bounded, already sanitized look at an input, with a policy draft."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import quoted
from ..keys import ProjectKey
from ..operators.inference import infer_policy
from ..operators.sanitize import sanitize_table
from ..operators.text_scan import EntityDetector
from ..policy import Policy
from .formats import ARCHIVES, file_format
from .readers import load_any


def preview_table(
    df: DataFrame, key: ProjectKey, preview_rows: int = 10, policy: Policy | None = None,
    detector: EntityDetector | None = None, order_by: str | None = None,
) -> dict[str, Any]:
    """Sanitized sample, types, roles, draft and report of the first rows: of ``order_by``,
    or whichever come first. Without a policy the inferred draft is used, in strict mode. A
    kept column that shows findings is null in the sample."""
    if preview_rows < 1:
        raise ValueError("preview_rows must be at least 1")
    # the sample is fixed once, on the driver, so that every step sees the same rows
    first = df.orderBy(quoted(order_by)) if order_by else df
    sample = df.sparkSession.createDataFrame(first.limit(preview_rows).collect(), df.schema)
    inferred = infer_policy(sample) if policy is None else None
    result = sanitize_table(
        sample, policy or Policy.from_dict(inferred.draft()), key, "strict", detector=detector
    )
    return {
        "rows": result.gate.rows,
        "columns": df.columns,
        "inferred_types": dict(df.dtypes),
        "sample": result.masked,
        "suggested_policy": inferred.draft() if inferred else None,
        "inferred_roles": inferred.roles if inferred else None,
        "report": result.report(),
    }


def preview_file(
    spark: SparkSession, path: str, key: ProjectKey, preview_rows: int = 10,
    input_type: str | None = None, policy: Policy | None = None,
) -> dict[str, Any]:
    fmt = file_format(path, input_type)
    if fmt in ARCHIVES:
        raise ValueError("preview is not supported for archives")
    return preview_table(load_any(spark, path, fmt), key, preview_rows, policy)


__all__ = ["preview_file", "preview_table"]
