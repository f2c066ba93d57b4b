"""Releases: several gated tables that become readable together, or not at all.

The gate sits in the write. Each table's source is read once: the rows that are written are
the rows whose findings are counted, by an observation on that write, so a source that changes
between reads cannot slip anything through. Parts go to a folder that Spark does not list
(`_parts/<release>/<table>`). If any table is blocked, its parts are removed and nothing else
happens; if all pass, one manifest file is created, and only what a manifest names is read.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..keys import ProjectKey, validate_identifier
from ..operators import report as r
from ..operators.detection import Findings, check_override, count_columns, wanted_pairs
from ..operators.report import ExportBlocked, Report, ReviewOverride
from ..operators.sanitize import SanitizeResult, gate_columns, needs_detector, planned_rows
from ..operators.text_scan import EntityDetector
from ..policy import Policy, Recognizer, resolve_actions
from .commit import create_once, names_in, read_text, remove
from .writers import write_rows


class DuplicateRelease(RuntimeError):
    """A release id was used before."""


def parts_path(path: str, release_id: str, name: str = "") -> str:
    return f"{path}/_parts/{release_id}" + (f"/{name}" if name else "")


def _manifest_path(path: str, release_id: str) -> str:
    return f"{path}/_manifests/{release_id}.json"


def write_observed(
    df: DataFrame,
    policy: Policy,
    key: ProjectKey,
    path: str,
    mode: str = "strict",
    override: ReviewOverride | None = None,
    recognizers: Sequence[Recognizer] = (),
    detector: EntityDetector | None = None,
    row_key: Sequence[str] | None = None,
    fmt: str = "parquet",
) -> Report:
    """Write the safe rows to a path that nothing reads yet, and judge what was written.

    One pass writes the rows and counts them and the values that may hold a finding, by the
    cheap superset of each detector. None: there is no finding. Else the rows are written again
    with exact counts for those columns, and without the columns that turn out to hold secrets,
    until a write has counted all it had to. A blocked result is removed and raises.
    """
    spark = df.sparkSession
    policy = replace(policy, recognizers=(*policy.recognizers, *recognizers))
    plans = resolve_actions(df.schema, policy)
    check_override(df, override)
    lost: dict[str, int] = {}  # columns with secrets, and how many were seen
    exact: set[tuple[str, str]] = set()
    while True:
        wanted = [(p, kind) for p, kind in wanted_pairs(plans, mode, policy.recognizers, detector) if p.name not in lost]
        left = [replace(p, action="drop") if p.secret_name or p.name in lost else p for p in plans]
        counted, names = count_columns(df, wanted, exact, policy.recognizers, detector)
        result = planned_rows(counted, left, policy, key, row_key or df.columns, detector)
        seen = Observation()
        sums = [F.coalesce(F.sum(F.col(name)), F.lit(0)).alias(name) for name in names]
        observed = result.staged.observe(seen, F.count(F.lit(1)).alias("rows"), *sums, *result.text_aggregates())
        write_rows(observed.select(*result.safe_columns()), path, fmt, "overwrite")
        found = seen.get
        counts = {(p.name, kind): int(found[name]) for (p, kind), name in zip(wanted, names)}
        unsure = {pair for pair, n in counts.items() if n and pair[1] != "entity"} - exact
        again = {name: counts[name, kind] for name, kind in exact if kind == "secret" and counts.get((name, kind))}
        again = {p.name: again[p.name] for p in plans if p.name in again and not p.secret_name}
        if not unsure and not again:
            break
        exact |= unsure
        lost |= again
    counts |= {(name, "secret"): n for name, n in lost.items()}
    report = Report(
        rows=int(found["rows"]),
        policy_fingerprint=policy.fingerprint,
        override=override,
        date_shift=vars(policy.date_shift).copy(),
        time_shift=vars(policy.time_shift).copy(),
    )
    if needs_detector(plans, mode) and policy.security.require_entity_detector and detector is None:
        report.block(r.NO_DETECTOR)
    gate_columns(plans, Findings(report.rows, counts), policy, report)
    if report.review_columns and override is None:
        report.block(r.REVIEW_REQUIRED)
    result.gate = report
    result.add_text_counts(found)
    if report.blocked:
        remove(spark, path)
        raise ExportBlocked("export is blocked: " + ", ".join(report.block_reasons))
    return report


def release_tables(
    tables: Mapping[str, DataFrame],
    policy: Policy,
    key: ProjectKey,
    path: str,
    release_id: str,
    fmt: str = "parquet",
    **options,
) -> dict[str, Report]:
    """Write all tables, each behind its gate, and make them readable by one manifest. If one
    is blocked, or anything fails, no table of the release can be read."""
    validate_identifier(release_id, "release_id")
    spark = next(iter(tables.values())).sparkSession
    if read_text(spark, _manifest_path(path, release_id)) is not None:
        raise DuplicateRelease(f"release '{release_id}' is there already")
    try:
        reports = {
            validate_identifier(name, "table name"): write_observed(df, policy, key, parts_path(path, release_id, name), fmt=fmt, **options)
            for name, df in tables.items()
        }
        commit_release(spark, path, release_id, {n: {"format": fmt, "rows": rep.rows} for n, rep in reports.items()})
    except BaseException:
        remove(spark, parts_path(path, release_id))
        raise
    return reports


def commit_release(spark: SparkSession, path: str, release_id: str, tables: Mapping[str, dict]) -> None:
    """The commit point: from now on the parts of these tables are read."""
    text = json.dumps({"release": release_id, "tables": dict(tables)}, sort_keys=True)
    if not create_once(spark, _manifest_path(path, release_id), text):
        raise DuplicateRelease(f"release '{release_id}' is there already")


def releases(spark: SparkSession, path: str) -> list[str]:
    """Ids of the committed releases of a folder."""
    return [n.removesuffix(".json") for n in names_in(spark, f"{path}/_manifests") if n.endswith(".json")]


def read_release(spark: SparkSession, path: str, release_id: str, name: str) -> DataFrame:
    """A table of a committed release."""
    manifest = read_text(spark, _manifest_path(path, release_id))
    tables = json.loads(manifest)["tables"] if manifest else {}
    if name not in tables:
        raise FileNotFoundError(f"no committed release '{release_id}' holds a table '{name}'")
    reader = spark.read.format(tables[name]["format"])
    found = reader.load(parts_path(path, release_id, name))
    return found.drop("batch_id") if tables[name].get("batches") else found


__all__ = [
    "DuplicateRelease",
    "SanitizeResult",
    "commit_release",
    "parts_path",
    "read_release",
    "release_tables",
    "releases",
    "write_observed",
]
