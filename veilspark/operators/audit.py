"""Append-only audit table with a hash chain per chain id."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.commit import create_once, names_in, read_text

CHAIN_VERSION = 1
_EVENT = "event-"


class AuditConflict(RuntimeError):
    """Other writers took every number that this one asked for."""


# Fields allowed per event type.
ALLOWED_FIELDS = {
    "import_sanitized": (
        "blocked", "can_export", "event", "job_id", "policy_fingerprint", "project_id",
        "review_actor", "review_reason",
    ),
    "mapping_opened": ("artifact_id", "event", "job_id", "project_id", "purpose"),
}

# Hashed fields, in name order.
HASHED = (
    "artifact_id", "blocked", "can_export", "chain_version", "event", "job_id",
    "policy_fingerprint", "previous_hash", "project_id", "purpose", "review_actor",
    "review_reason", "seq", "timestamp",
)
AUDIT_SCHEMA = (
    "chain string, seq bigint, artifact_id string, blocked boolean, can_export boolean, "
    "chain_version int, event string, job_id string, policy_fingerprint string, "
    "previous_hash string, project_id string, purpose string, review_actor string, "
    "review_reason string, timestamp string, event_hash string"
)


def event_hash() -> Column:
    """SHA-256 of the canonical JSON of an event's fields (name order, nulls kept)."""
    return F.sha2(F.to_json(F.struct(*HASHED), {"ignoreNullFields": "false"}), 256)


def checked_event(event: dict[str, Any]) -> dict[str, Any]:
    """A copy of the event, if each of its fields belongs to its kind and holds one plain value."""
    kind = event.get("event")
    known = ALLOWED_FIELDS.get(kind, ())
    wrong = {
        name: "is no field of this kind" if name not in known else f"is a {type(value).__name__}"
        for name, value in event.items()
        if name not in known or not (value is None or isinstance(value, (str, bool, int, float)))
    }
    if kind not in ALLOWED_FIELDS or wrong:
        raise ValueError(f"audit event {kind!r} is not recorded: {wrong or 'unknown kind'}")
    return dict(event)


def append_event(
    spark: SparkSession, path: str, event: dict[str, Any], chain: str = "default",
    timestamp: str | None = None, tries: int = 1000,
) -> int:
    """Append one event to a chain, and return its number.

    An event is a file named by its number and created once: of writers that saw the same end
    of the chain one gets the number, and the others follow it. Chains lie in folders of their
    own. Only the names in the folder and its last event are read.
    """
    payload = checked_event(event)
    folder = f"{path}/chain={''.join(c if c.isalnum() or c in '._-' else f'%{ord(c):02X}' for c in chain)}"
    for _ in range(tries):
        taken = [name for name in names_in(spark, folder) if name.startswith(_EVENT)]
        last = json.loads(read_text(spark, f"{folder}/{taken[-1]}")) if taken else {"seq": 0, "event_hash": None}
        row = {
            **{name: None for name in HASHED},
            **payload,
            "chain": chain,
            "seq": last["seq"] + 1,
            "chain_version": CHAIN_VERSION,
            "previous_hash": last["event_hash"],
            "timestamp": timestamp or datetime.now(timezone.utc).isoformat(),
            "event_hash": None,
        }
        hashed = spark.createDataFrame([row], AUDIT_SCHEMA).withColumn("event_hash", event_hash()).drop("chain")
        text = hashed.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0]
        if create_once(spark, f"{folder}/{_EVENT}{row['seq']:018d}.json", text + "\n"):
            return row["seq"]
    raise AuditConflict(f"no number was free in chain '{chain}' in {tries} tries")


def job_chain(project_id: str, job_id: str) -> str:
    """The chain of one job's events."""
    return f"{project_id}.{job_id}"


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    names = [part.split(" ")[0] for part in AUDIT_SCHEMA.split(", ")]
    try:
        return spark.read.schema(AUDIT_SCHEMA).json(path).select(*names)
    except Exception as error:  # a log that was never written is empty
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], AUDIT_SCHEMA)


def checked_events(events: DataFrame) -> DataFrame:
    """Every event with ``error``: null, or the first test it fails.

    The predecessor comes from equi-joins on (chain, seq), not a window over the chain,
    so one chain of any length spreads over all tasks. A repeated seq is a broken link."""
    places = events.groupBy("chain", "seq").agg(
        F.count(F.lit(1)).alias("copies"), F.min("event_hash").alias("hash")
    )
    prior = places.select("chain", (F.col("seq") + 1).alias("seq"), F.col("hash").alias("prior_hash"))
    linked = events.join(places.select("chain", "seq", "copies"), ["chain", "seq"]).join(
        prior.withColumn("has_prior", F.lit(True)), ["chain", "seq"], "left"
    )
    starts = F.col("previous_hash").isNull() & F.col("has_prior").isNull()
    follows = F.col("has_prior") & F.col("previous_hash").eqNullSafe(F.col("prior_hash"))
    link_ok = (F.col("copies") == 1) & F.when(F.col("seq") == 1, starts).otherwise(follows)
    label = F.concat(F.lit("event "), F.col("seq"))
    error = (
        F.when(
            ~F.col("chain_version").eqNullSafe(F.lit(CHAIN_VERSION)),
            F.concat(label, F.lit(" has an unsupported chain version")),
        )
        .when(
            ~F.col("event_hash").eqNullSafe(event_hash()), F.concat(label, F.lit(" hash mismatch"))
        )
        .when(
            ~F.coalesce(link_ok, F.lit(False)), F.concat(label, F.lit(" previous hash mismatch"))
        )
    )
    return linked.withColumn("error", error).drop("copies", "prior_hash", "has_prior")


def verify_audit(events: DataFrame) -> DataFrame:
    """Per chain: valid, event_count (0 if broken), last_hash, first failing seq, error."""
    bad = F.when(F.col("error").isNotNull(), F.col("seq"))
    summary = checked_events(events).groupBy("chain").agg(
        F.min(bad).alias("first_bad_seq"),
        F.min_by("error", bad).alias("error"),
        F.count(F.lit(1)).alias("n"),
        F.max_by("event_hash", "seq").alias("last"),
    )
    valid = F.col("first_bad_seq").isNull()
    return summary.select(
        "chain",
        valid.alias("valid"),
        F.when(valid, F.col("n")).otherwise(0).alias("event_count"),
        F.when(valid, F.col("last")).alias("last_hash"),
        "first_bad_seq",
        "error",
    )
