"""Gates inside the write, releases with one commit point, and audit chains with several writers."""

import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from veilspark import Policy, sanitize_table
from veilspark.operators.audit import AuditConflict, append_event, read_audit, verify_audit
from veilspark.operators.report import ExportBlocked
from veilspark.sinks import commit, release
from veilspark.sinks.release import DuplicateRelease, read_release, release_tables, releases, write_observed
from veilspark.streaming.stream import release_stream

OPEN = {"security": {"require_entity_detector": False}}
POLICY = Policy.from_dict({"columns": {"id": "tokenize", "note": "hash", "status": "keep", "extra": "keep"}, **OPEN})
TEXT = Policy.from_dict({"columns": {**POLICY.columns, "note": "redact_text"}, **OPEN})
ROWS = [("C-1", "mail a@b.co", "open", "x"), ("C-2", None, "closed", "y"), ("C-1", "token = abcdef12345", "open", "z")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "id string, note string, status string, extra string")


def test_one_read_writes_the_rows_and_the_report_of_two(spark, key, tmp_path, monkeypatch):
    whole = sanitize_table(frame(spark), TEXT, key)
    jobs = []
    write = release.write_rows
    monkeypatch.setattr(release, "write_rows", lambda *args: (jobs.append(args[1]), write(*args)))
    report = release_tables({"t": frame(spark)}, TEXT, key, str(tmp_path), "r1")["t"]
    assert len(jobs) == 1 and report == whole.report()
    assert sorted(map(str, read_release(spark, str(tmp_path), "r1", "t").collect())) == sorted(map(str, whole.export().collect()))


def test_a_secret_that_comes_up_costs_its_column(spark, key, tmp_path):
    rows = [*ROWS, ("C-9", None, "ghp_" + "a" * 36, "password = hunter2hunter2")]
    report = write_observed(frame(spark, rows), POLICY, key, str(tmp_path / "out"), mode="targeted")
    whole = sanitize_table(frame(spark, rows), POLICY, key, "targeted")
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.columns == ["id", "note"] == whole.safe.columns and report == whole.report()


def test_a_source_that_changes_between_reads_cannot_slip_through(spark, key, tmp_path):
    source = str(tmp_path / "source")
    frame(spark).write.parquet(source)


    checked = spark.read.parquet(source)
    assert sanitize_table(checked, POLICY, key, "targeted").can_export
    frame(spark, [("C-3", None, "call 0812345678", "x")]).write.mode("append").parquet(source)
    with pytest.raises(ExportBlocked, match="residual_sensitive_data"):
        release_tables({"t": spark.read.parquet(source)}, POLICY, key, str(tmp_path / "out"), "r1", mode="targeted")
    assert releases(spark, str(tmp_path / "out")) == [] and not os.path.exists(tmp_path / "out" / "_parts" / "r1")


def test_a_blocked_third_table_leaves_nothing_readable(spark, key, tmp_path):
    path = str(tmp_path / "out")
    good, bad = frame(spark), frame(spark, [("C-3", None, "a@b.co", "x")])
    with pytest.raises(ExportBlocked):
        release_tables({"a": good, "b": good, "c": bad}, POLICY, key, path, "r1", mode="targeted")
    with pytest.raises(FileNotFoundError):
        read_release(spark, path, "r1", "a")
    release_tables({"a": good, "b": good}, POLICY, key, path, "r1", mode="targeted")
    assert read_release(spark, path, "r1", "b").count() == 3
    with pytest.raises(DuplicateRelease):
        release_tables({"a": good}, POLICY, key, path, "r1", mode="targeted")
    assert read_release(spark, path, "r1", "a").count() == 3


def test_a_blocked_batch_leaves_nothing_readable_until_the_job_ends(spark, key, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for i, rows in enumerate([ROWS[:2], ROWS[2:], [("C-3", None, "call 0812345678", "x")]]):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(source)
        for name in sorted(os.listdir(source)):
            if name.startswith("part-"):
                os.utime(os.path.join(source, name), (1_700_000_000 + i, 1_700_000_000 + i))

    def stream(policy):
        df = spark.readStream.schema(frame(spark).schema).option("maxFilesPerTrigger", 1).parquet(source)
        release_stream(df, policy, key, "job", path, checkpoint)

    with pytest.raises(StreamingQueryException, match="residual_sensitive_data"):
        stream(POLICY)
    assert releases(spark, path) == []
    stream(Policy.from_dict({"columns": {**POLICY.columns, "status": "hash"}, **OPEN}))
    assert read_release(spark, path, "job", "rows").count() == 4


def test_two_writers_give_one_chain(spark, tmp_path):
    path = str(tmp_path / "audit")
    event = {"event": "import_sanitized", "project_id": "p", "job_id": "j", "blocked": False, "can_export": True}

    def write(k):
        return append_event(spark, path, {**event, "job_id": f"j{k}"}, "one chain/é")

    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(write, range(12)))
    assert sorted(numbers) == list(range(1, 13))
    row = verify_audit(read_audit(spark, path)).first()
    assert (row["chain"], row["valid"], row["event_count"]) == ("one chain/é", True, 12)


def test_a_number_is_taken_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "file")
    assert commit.create_once(spark, path, "first") and not commit.create_once(spark, path, "second")
    assert commit.read_text(spark, path) == "first" and "file" in commit.names_in(spark, str(tmp_path))
    assert commit.read_text(spark, str(tmp_path / "none")) is None and commit.names_in(spark, str(tmp_path / "none")) == []
    monkeypatch.setattr("veilspark.operators.audit.create_once", lambda *a: False)
    with pytest.raises(AuditConflict):
        append_event(spark, str(tmp_path / "audit"), {"event": "mapping_opened"}, tries=3)


def test_events_are_plain_files_in_order(spark, tmp_path):
    for k in range(2):
        append_event(spark, str(tmp_path), {"event": "mapping_opened", "purpose": f"because {k}"}, "c")
    names = [n for n in sorted(os.listdir(tmp_path / "chain=c")) if not n.startswith(".")]
    assert names == ["event-000000000000000001.json", "event-000000000000000002.json"]
    first, second = (json.load(open(tmp_path / "chain=c" / n)) for n in names)
    assert second["previous_hash"] == first["event_hash"]
    edited = read_audit(spark, str(tmp_path)).withColumn("purpose", F.lit("other"))
    assert verify_audit(edited).first()["error"] == "event 1 hash mismatch"
