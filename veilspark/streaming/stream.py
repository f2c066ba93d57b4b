"""Micro-batch sanitizing. Tokens are pure functions of key and value, so equal values
get equal tokens in every batch without any state."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import token_for
from ..functions.numbers import is_integral
from ..functions.text import quoted
from ..keys import ProjectKey, validate_identifier
from ..operators.actions import action_column
from ..operators.report import ExportBlocked
from ..operators.sanitize import SanitizeResult, sanitize_table, work_name
from ..operators.text_scan import EntityDetector, scan_text
from ..operators.vault import VAULT_SCHEMA, TokenCollision, job_path, seal_mapping, token_collisions
from ..policy import ColumnPlan, Policy, Recognizer, resolve_actions
from ..sinks.release import commit_release, parts_path


@dataclass(frozen=True)
class StreamPaths:
    """Shared folders of one streaming job. Everything is written per batch id with
    overwrite, so a repeated batch replaces its own output."""

    out: str
    checkpoint: str
    vault: str | None = None
    report: str | None = None
    quarantine: str | None = None


def safe_stream(df: DataFrame, policy: Policy, key: ProjectKey) -> DataFrame:
    """The projection alone, on a streaming or batch DataFrame: stateless, no gate. Columns
    under review or with a secret name are held back as markers or dropped by name."""
    plans = resolve_actions(df.schema, policy)
    schema = df.schema
    columns = []
    for plan in plans:
        if plan.secret_name or plan.action == "drop":
            continue
        if plan.action == "synthesize":
            raise ValueError("synthesize needs the quantiles of a whole batch; use sanitize_stream")
        if plan.action == "redact_text":
            df = scan_text(df, plan.name, work_name("scan", plan.name), key, policy.recognizers)
            columns.append(F.col(f"{work_name('scan', plan.name)}.safe").alias(plan.name))
        else:
            columns.append(action_column(plan, schema, policy, key, set()).alias(plan.name))
    return df.select(*columns)


def stable_columns(safe: DataFrame, plans: Sequence[ColumnPlan], hidden: Sequence[str] = ()) -> DataFrame:
    """Safe rows with every planned column in a type that the schema alone decides. A column
    lost to a secret found in this batch, or hidden, is null, so the stream keeps its schema."""
    columns = []
    for plan in plans:
        kind = plan.dtype if plan.action == "keep" else T.StringType()
        if plan.action == "synthesize":  # whether all numbers are whole is chance in a batch
            kind = T.LongType() if is_integral(plan.dtype) else T.DoubleType()
        there = plan.name in safe.columns and plan.name not in hidden
        value = quoted(plan.name) if there else F.lit(None)
        columns.append(value.cast(kind).alias(plan.name))
    return safe.select(*columns)


def sanitize_stream(
    df: DataFrame,
    policy: Policy,
    key: ProjectKey,
    job_id: str,
    paths: StreamPaths,
    mode: str = "targeted",
    recognizers: Sequence[Recognizer] = (),
    detector: EntityDetector | None = None,
    row_key: Sequence[str] | None = None,
    trigger: dict | None = None,
):
    """Start a query that gates every batch. A blocked batch goes to the quarantine folder
    (sanitized, and without the columns that still show findings) or, without one, fails the
    query. New tokens enter the vault once a job; report rows carry their batch id and add up
    on read."""
    policy = replace(policy, recognizers=(*policy.recognizers, *recognizers))
    schema = df.schema
    validate_identifier(job_id, "job_id")
    own = job_path(paths.vault, key.project_id, job_id) if paths.vault else None
    checks = job_path(f"{paths.vault}/_checks", key.project_id, job_id) if paths.vault else None
    if own:  # an empty first part, so that the first batch has a vault to read
        token_checks(df.sparkSession.createDataFrame([], "token string, original string"), key).write.mode("append").parquet(f"{checks}/batch_id=-1")
        _vault_part(df.sparkSession.createDataFrame([], VAULT_SCHEMA)).write.mode("append").parquet(f"{own}/batch_id=-1")

    plans = [
        p for p in resolve_actions(schema, policy) if p.action != "drop" and not p.secret_name
    ]
    planned = [p.name for p in plans]

    # not persisted: gate, rows and tokens read the source again rather than leave originals
    # on executor disks
    def gated(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        result = sanitize_table(batch, policy, key, mode, detector=detector, row_key=row_key)
        safe, seen = result.observed()
        lost = [name for name in planned if name not in safe.columns]
        blocked = not result.can_export or bool(lost)
        if blocked and paths.quarantine is None:
            reasons = result.gate.block_reasons or [f"secret in {name}" for name in lost]
            raise ExportBlocked(f"batch {batch_id} is blocked: " + ", ".join(reasons))
        target = paths.quarantine if blocked else paths.out
        rows = stable_columns(safe, plans, result.shown if blocked else ())
        rows.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
        if seen is not None:
            result.add_text_counts(seen.get)
        if paths.report:
            result.report().counters(spark).coalesce(1).write.mode("overwrite").parquet(
                f"{paths.report}/batch_id={batch_id}"
            )
        if own:
            store_tokens(spark, result, batch_id)

    def store_tokens(spark: SparkSession, result: SanitizeResult, batch_id: int) -> None:
        mapping = result.mapping()
        if token_collisions(mapping).take(1) or clashing_tokens(spark, mapping, key, checks, batch_id).take(1):
            raise TokenCollision("token collision detected")
        fresh = new_tokens(spark, mapping, own, batch_id)
        ttl = timedelta(days=policy.security.mapping_ttl_days)
        sealed = _vault_part(seal_mapping(fresh, key, job_id, ttl))
        sealed.write.mode("overwrite").parquet(f"{own}/batch_id={batch_id}")
        token_checks(fresh, key).write.mode("overwrite").parquet(f"{checks}/batch_id={batch_id}")

    return (
        df.writeStream.foreachBatch(gated)
        .option("checkpointLocation", paths.checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def release_stream(
    df: DataFrame,
    policy: Policy,
    key: ProjectKey,
    job_id: str,
    path: str,
    checkpoint: str,
    name: str = "rows",
    **options,
) -> None:
    """All that a stream holds now as one release (id: the job's): its batches can be read once
    all of them have passed their gates, and not before. A job that was stopped by a blocked
    batch goes on from there when it is called again; until it ends, nothing is readable."""
    spark = df.sparkSession
    out = parts_path(path, validate_identifier(job_id, "job_id"), name)
    sanitize_stream(df, policy, key, job_id, StreamPaths(out, checkpoint), **options).awaitTermination()
    commit_release(spark, path, job_id, {name: {"format": "parquet", "batches": True}})


def _vault_part(rows: DataFrame) -> DataFrame:
    """Vault rows without the columns that the folder's path holds."""
    return rows.drop("project_id", "job_id")


def token_checks(mapping: DataFrame, key: ProjectKey) -> DataFrame:
    """token and a keyed check value of the original it stands for, which shows nothing without the key."""
    return mapping.select("token", token_for(key, "CHECK", F.col("original")).alias("check"))


def clashing_tokens(spark: SparkSession, mapping: DataFrame, key: ProjectKey, checks: str, batch_id: int) -> DataFrame:
    """Tokens of a batch that an earlier batch of the job stored for another original."""
    stored = spark.read.schema("token string, check string, batch_id bigint").parquet(checks)
    stored = stored.where(F.col("batch_id") < batch_id).select("token", F.col("check").alias("known"))
    return token_checks(mapping, key).join(stored, "token").where(F.col("check") != F.col("known")).select("token")


def new_tokens(spark: SparkSession, mapping: DataFrame, own: str, batch_id: int) -> DataFrame:
    """Tokens that no earlier batch of the job stored, of which only the token column is
    read; a rerun of a batch does not see its own rows."""
    stored = spark.read.schema("token string, batch_id bigint").parquet(own)
    stored = stored.where(F.col("batch_id") < batch_id).select("token")
    return mapping.join(stored, "token", "left_anti")


def read_stream_table(spark: SparkSession, path: str) -> DataFrame:
    """All committed batches of an output folder."""
    return spark.read.option("mergeSchema", False).parquet(path).drop("batch_id")


def cumulative_report(spark: SparkSession, path: str) -> DataFrame:
    """(section, name, n) summed over the batches of a job."""
    return spark.read.parquet(path).groupBy("section", "name").agg(F.sum("n").alias("n"))
