"""The token vault: one encrypted row per token, and the controlled way back.

A vault is a table (parquet, partitioned by project and job). Each original is sealed
with AES-256-GCM under a fresh IV; the row's own metadata is authenticated with it, so
a row moved to another job, project or expiry no longer opens.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold_case, quoted
from ..keys import ProjectKey, validate_identifier

VAULT_SCHEMA = (
    "kind string, token string, token_type string, sealed binary, key_id string, "
    "created_at timestamp, expires_at timestamp, project_id string, job_id string"
)


class VaultError(RuntimeError):
    """A vault is missing, expired, or holds rows that fail authentication."""


class TokenCollision(RuntimeError):
    """Two originals share a token."""


def _bound_metadata() -> Column:
    """Canonical JSON of a vault row's metadata, authenticated with the sealed value."""
    names = ("expires_at", "job_id", "key_id", "kind", "project_id", "token", "token_type")
    return F.to_json(
        F.struct(
            *[
                (F.unix_micros(n) if n == "expires_at" else F.col(n)).alias(n)
                for n in names
            ]
        ),
        {"ignoreNullFields": "false"},
    )


def _purpose(kind: str) -> str:
    return "mapping_encryption" if kind == "mapping" else "artifact_encryption"


def _seal(plain: Column, key: ProjectKey, kind: str) -> Column:
    return F.aes_encrypt(
        plain.cast("binary"), F.lit(key.sub_key(_purpose(kind))), F.lit("GCM"), F.lit("DEFAULT"),
        F.lit(b""), _bound_metadata(),
    )


def _opened(key: ProjectKey) -> Column:
    def unseal(kind: str) -> Column:
        return F.try_aes_decrypt(
            F.col("sealed"), F.lit(key.sub_key(_purpose(kind))), F.lit("GCM"), F.lit("DEFAULT"),
            _bound_metadata(),
        ).cast("string")

    return F.when(F.col("kind") == "mapping", unseal("mapping")).otherwise(unseal("raw"))


def token_collisions(mapping: DataFrame) -> DataFrame:
    """Tokens that stand for more than one original of a mapping."""
    counted = mapping.select("token", "original").distinct().groupBy("token")
    return counted.agg(F.count(F.lit(1)).alias("originals")).where(F.col("originals") > 1)


def repeated_tokens(vault: DataFrame, project_id: str, job_id: str) -> DataFrame:
    """Tokens stored more than once by a job. A mapping is distinct, so these stand for
    several originals; seen here, the check needs one column of the written vault."""
    rows = vault.where(
        (F.col("project_id") == project_id) & (F.col("job_id") == job_id) & (F.col("kind") == "mapping")
    )
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def _stamped(df: DataFrame, key: ProjectKey, job_id: str, kind: str, ttl: timedelta, now: datetime) -> DataFrame:
    return df.withColumns(
        {
            "kind": F.lit(kind),
            "key_id": F.lit(key.key_id),
            "created_at": F.lit(now),
            "expires_at": F.lit(now + ttl),
            "project_id": F.lit(key.project_id),
            "job_id": F.lit(validate_identifier(job_id, "job_id")),
        }
    )


def _columns(df: DataFrame) -> DataFrame:
    return df.select([part.strip().split(" ")[0] for part in VAULT_SCHEMA.split(",")])


def seal_mapping(
    mapping: DataFrame, key: ProjectKey, job_id: str, ttl: timedelta = timedelta(days=30),
    now: datetime | None = None,
) -> DataFrame:
    """Vault rows of a (token, token_type, original) mapping."""
    stamped = _stamped(mapping, key, job_id, "mapping", ttl, now or datetime.now(timezone.utc))
    return _columns(stamped.withColumn("sealed", _seal(F.col("original"), key, "mapping")))


def seal_rows(
    df: DataFrame, key: ProjectKey, job_id: str, ttl: timedelta = timedelta(hours=24),
    now: datetime | None = None,
) -> DataFrame:
    """Opt-in encrypted copy of raw rows, each as JSON, kept under the same rules."""
    raw = df.select(F.to_json(F.struct(*map(quoted, df.columns)), {"ignoreNullFields": "false"}).alias("original"))
    raw = raw.withColumns({"token": F.sha2("original", 256), "token_type": F.lit("RAW")})
    stamped = _stamped(raw, key, job_id, "raw", ttl, now or datetime.now(timezone.utc))
    return _columns(stamped.withColumn("sealed", _seal(F.col("original"), key, "raw")))


def open_rows(vault: DataFrame, key: ProjectKey) -> DataFrame:
    """Raw rows that authenticate, as JSON text."""
    kept = vault.where((F.col("kind") == "raw") & (F.col("key_id") == key.key_id))
    return kept.select("job_id", _opened(key).alias("row")).where(F.col("row").isNotNull())


def job_exists(vault: DataFrame, project_id: str, job_id: str) -> bool:
    """Whether a job already left rows; partition pruning makes this a file listing."""
    rows = vault.where((F.col("project_id") == project_id) & (F.col("job_id") == job_id))
    return bool(rows.select(F.lit(1)).take(1))


def write_vault(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Rows by project, job and batch; a job that isn't a stream has the one batch -1."""
    if "batch_id" not in rows.columns:
        rows = rows.withColumn("batch_id", F.lit(-1).cast("bigint"))
    rows.write.mode(mode).partitionBy("project_id", "job_id", "batch_id").parquet(path)


def job_path(path: str, project_id: str, job_id: str) -> str:
    """Folder of one job's rows: identifiers are safe in paths as they are."""
    return f"{path}/project_id={project_id}/job_id={job_id}"


def read_vault(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{VAULT_SCHEMA}, batch_id bigint").parquet(path).drop("batch_id")


def open_mapping(
    vault: DataFrame, key: ProjectKey, job_id: str, purpose: str, now: datetime | None = None
) -> DataFrame:
    """(token, original) of one job, after every check: the rows exist, match the key, some
    are not expired (the others are left out: a stream's first batches expire first), all
    authenticate, and the stated purpose quotes no original value."""
    if not isinstance(purpose, str) or not purpose.strip():
        raise ValueError("a purpose is required to open a mapping")
    now = now or datetime.now(timezone.utc)
    rows = vault.where(
        (F.col("project_id") == key.project_id)
        & (F.col("job_id") == job_id)
        & (F.col("kind") == "mapping")
    )
    opened = rows.select("token", "expires_at", "key_id", _opened(key).alias("original"))
    original = F.col("original")
    quotes = (F.trim(original) != "") & F.lit(purpose.casefold()).contains(fold_case(original))
    n, wrong_key, sealed, expired, told = opened.agg(
        F.count(F.lit(1)),
        F.count_if(F.col("key_id") != key.key_id),
        F.count_if(original.isNull()),
        F.count_if(F.col("expires_at") <= F.lit(now)),
        F.count_if(quotes),
    ).first()
    if not n or wrong_key:
        raise VaultError("no mapping of this job matches the project key")
    if sealed:
        raise VaultError("mapping authentication failed")
    if expired == n:
        raise VaultError("mapping has expired")
    if told:
        raise ValueError("purpose must not contain an original value")
    return opened.where(F.col("expires_at") > F.lit(now)).select("token", "original")


def detokenize(
    df: DataFrame, columns: dict[str, str], vault: DataFrame, key: ProjectKey, job_id: str,
    purpose: str, now: datetime | None = None,
) -> DataFrame:
    """Add the original of each token column (``{token column: new column}``); tokens the
    vault does not know stay null. ``jobs.open_tokens`` does this and records it."""
    mapping = open_mapping(vault, key, job_id, purpose, now)
    for token_column, out in columns.items():
        side = mapping.select(F.col("token").alias(token_column), F.col("original").alias(out))
        df = df.join(side, token_column, "left")
    return df


def expired_rows(vault: DataFrame, key: ProjectKey, now: datetime) -> Column:
    """Expired and authentic under this key. Rows that do not open stay where they are."""
    return (
        (F.col("expires_at") <= F.lit(now))
        & (F.col("project_id") == key.project_id)
        & _opened(key).isNotNull()
    )


def purge_expired(vault: DataFrame, key: ProjectKey, now: datetime | None = None) -> DataFrame:
    """The vault without its expired rows; write it to a new path and switch over."""
    gone = expired_rows(vault, key, now or datetime.now(timezone.utc))
    return vault.where(~F.coalesce(gone, F.lit(False)))


def count_expired(vault: DataFrame, key: ProjectKey, now: datetime | None = None) -> int:
    """Number of artifacts (job and kind) a purge would remove."""
    gone = expired_rows(vault, key, now or datetime.now(timezone.utc))
    return vault.where(gone).select("project_id", "job_id", "kind", "created_at").distinct().count()
