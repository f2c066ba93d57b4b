"""One import from start to end: guard, raw copy, sanitize, vault, audit, gated write."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .keys import ProjectKey, validate_identifier
from .operators.audit import append_event, job_chain, read_audit
from .operators.report import ReviewOverride
from .operators.sanitize import SanitizeResult, sanitize_table, sanitize_text
from .operators.text_scan import EntityDetector
from .operators.vault import (
    TokenCollision,
    detokenize,
    job_exists,
    read_vault,
    seal_mapping,
    seal_rows,
    token_collisions,
    write_vault,
)
from .policy import Policy, Recognizer
from .sinks.writers import write_safe
from .sources.formats import file_format
from .sources.readers import load_tables


class DuplicateJob(RuntimeError):
    """A job id was used before and the policy forbids that."""


@dataclass(frozen=True)
class Stores:
    """Shared folders of the vault and the audit table."""

    vault: str
    audit: str


def vault_exists(spark: SparkSession, stores: Stores, project_id: str, job_id: str) -> bool:
    try:
        return job_exists(read_vault(spark, stores.vault), project_id, job_id)
    except Exception as error:  # a vault that was never written holds no job
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return False


def was_run(spark: SparkSession, stores: Stores, project_id: str, job_id: str) -> bool:
    """Whether a job left vault rows or, having nothing to store, its event."""
    events = read_audit(spark, stores.audit).where(
        (F.col("chain") == job_chain(project_id, job_id)) & (F.col("event") == "import_sanitized")
    )
    return vault_exists(spark, stores, project_id, job_id) or bool(events.select("seq").take(1))


def import_table(
    df: DataFrame,
    policy: Policy,
    key: ProjectKey,
    job_id: str,
    stores: Stores,
    mode: str = "strict",
    override: ReviewOverride | None = None,
    recognizers: Sequence[Recognizer] = (),
    detector: EntityDetector | None = None,
    text_column: str | None = None,
    row_key: Sequence[str] | None = None,
    input_type: str | None = None,
) -> SanitizeResult:
    """Sanitize a table (or, with ``text_column``, a collection of documents), store its
    mapping encrypted and record the event. The result still has to pass the gate."""
    spark = df.sparkSession
    validate_identifier(job_id, "job_id")
    if policy.security.reject_duplicate_job_id and was_run(spark, stores, key.project_id, job_id):
        raise DuplicateJob(f"job_id '{job_id}' was used before")
    if text_column is None:
        result = sanitize_table(df, policy, key, mode, override, recognizers, detector, row_key)
    else:
        result = sanitize_text(df, text_column, policy, key, recognizers, detector)
    gate = result.gate
    gate.project_id, gate.job_id = key.project_id, job_id
    gate.input_type = input_type or ("table" if text_column is None else "text")
    minting = any(p.action == "tokenize" for p in result.plans) or result.policy.recognizers
    # before anything is stored: a job that fails leaves no rows and keeps its id
    if minting and token_collisions(result.mapping()).take(1):
        raise TokenCollision("token collision detected")
    if policy.security.store_raw_copy:
        raw = seal_rows(df, key, job_id, timedelta(hours=policy.security.raw_ttl_hours))
        write_vault(raw, stores.vault)
    if minting:
        ttl = timedelta(days=policy.security.mapping_ttl_days)
        write_vault(seal_mapping(result.mapping(), key, job_id, ttl), stores.vault)
    append_event(
        spark,
        stores.audit,
        {
            "event": "import_sanitized",
            "project_id": key.project_id,
            "job_id": job_id,
            "policy_fingerprint": policy.fingerprint,
            "blocked": not result.can_export,
            "can_export": result.can_export,
            "review_actor": override.actor if override else None,
            "review_reason": override.reason if override else None,
        },
        job_chain(key.project_id, job_id),
    )
    return result


def import_file(
    spark: SparkSession, path: str, out: str, policy: Policy, key: ProjectKey, job_id: str,
    stores: Stores, fmt: str = "parquet", input_type: str | None = None, mode: str = "targeted",
    **options,
) -> dict[str, SanitizeResult]:
    """File to file, under a reviewed policy. An archive's members each become a table,
    and nothing is written unless all of them pass."""
    tables = load_tables(spark, path, input_type)
    several = len(tables) > 1
    results = {
        name: import_table(
            table, policy, key, f"{job_id}-{i}" if several else job_id, stores, mode,
            input_type=file_format(path, input_type), **options
        )
        for i, (name, table) in enumerate(tables.items())
    }
    for result in results.values():
        result.export()
    for name, result in results.items():
        write_safe(result, f"{out}/{name}" if several else out, fmt)
    return results


def open_tokens(
    df: DataFrame, columns: dict[str, str], key: ProjectKey, job_id: str, purpose: str, stores: Stores
) -> DataFrame:
    """Detokenize, and record who asked for what."""
    spark = df.sparkSession
    opened = detokenize(df, columns, read_vault(spark, stores.vault), key, job_id, purpose)
    append_event(
        spark,
        stores.audit,
        {
            "event": "mapping_opened",
            "project_id": key.project_id,
            "job_id": job_id,
            "artifact_id": f"{key.project_id}/{job_id}",
            "purpose": purpose.strip(),
        },
        job_chain(key.project_id, job_id),
    )
    return opened
