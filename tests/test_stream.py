"""Micro-batches: equality with the batch path, gate, vault and report."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from veilspark import Policy, StreamPaths, safe_stream, sanitize_stream, sanitize_table
from veilspark.streaming.stream import cumulative_report, read_stream_table

OPEN = {"security": {"require_entity_detector": False}}
SCHEMA = "customer_id string, status string, note string"


def stream_of(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/part={i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/part=*")


def paths_in(folder, quarantine=False):
    return StreamPaths(
        f"{folder}/out", f"{folder}/checkpoint", f"{folder}/vault", f"{folder}/report",
        f"{folder}/quarantine" if quarantine else None,
    )


POLICY = Policy.from_dict(
    {**OPEN, "columns": {"customer_id": "tokenize", "status": "keep", "note": "redact_text"}}
)
BATCHES = [
    [("C-001", "open", "mail a@b.co"), ("C-002", "open", "repeat")],
    [("C-001", "closed", "repeat"), (None, "open", None)],
    [("C-003", "open", "token = abcdef12345")],
]


def test_stream_equals_batch(spark, key, tmp_path):
    stream = stream_of(spark, tmp_path, BATCHES)
    paths = paths_in(tmp_path)
    query = sanitize_stream(stream, POLICY, key, "job", paths)
    query.awaitTermination()
    assert len(query.recentProgress) >= 3
    whole = sanitize_table(spark.createDataFrame([r for b in BATCHES for r in b], SCHEMA), POLICY, key)
    got = read_stream_table(spark, paths.out).collect()
    assert sorted(map(str, got)) == sorted(map(str, whole.export().collect()))
    vault = spark.read.parquet(paths.vault)
    assert vault.count() == 3 == vault.select("token").distinct().count()
    counted = {(r["section"], r["name"]): r["n"] for r in cumulative_report(spark, paths.report).collect()}
    report = whole.report()
    assert {name: n for (section, name), n in counted.items() if section == "detector"} == report.detector_counts
    assert {name: n for (section, name), n in counted.items() if section == "action"} == report.action_counts


def test_blocked_batch_fails_the_query(spark, key, tmp_path):
    batches = [BATCHES[0], [("C-009", "call 0812345678", "x")]]
    paths = paths_in(tmp_path)
    with pytest.raises(StreamingQueryException, match="residual_sensitive_data"):
        sanitize_stream(stream_of(spark, tmp_path, batches), POLICY, key, "job", paths).awaitTermination()
    assert "0812345678" not in str(spark.read.parquet(paths.out).collect())


def test_quarantine_keeps_the_schema_and_the_stream_alive(spark, key, tmp_path):
    batches = [BATCHES[0], [("C-009", "token = abcdef12345", "x")], BATCHES[1]]
    paths = paths_in(tmp_path, quarantine=True)
    sanitize_stream(stream_of(spark, tmp_path, batches), POLICY, key, "job", paths).awaitTermination()
    assert read_stream_table(spark, paths.out).count() == 4
    held = spark.read.parquet(paths.quarantine)
    assert held.count() == 1 and held.first()["status"] is None
    assert held.columns[:3] == ["customer_id", "status", "note"]


def test_repeated_batch_replaces_its_own_output(spark, key, tmp_path):
    stream = stream_of(spark, tmp_path, BATCHES)
    paths = paths_in(tmp_path)
    sanitize_stream(stream, POLICY, key, "job", paths).awaitTermination()
    before = spark.read.parquet(paths.out).count()
    lost = StreamPaths(paths.out, f"{tmp_path}/checkpoint2", paths.vault, paths.report)
    sanitize_stream(stream, POLICY, key, "job", lost).awaitTermination()
    assert spark.read.parquet(paths.out).count() == before
    assert spark.read.parquet(paths.vault).select("token").distinct().count() == 3


def test_stateless_projection_on_a_stream(spark, key, tmp_path):
    stream = stream_of(spark, tmp_path, BATCHES)
    projected = safe_stream(stream, POLICY, key)
    query = (
        projected.writeStream.format("memory").queryName("projected").trigger(availableNow=True)
        .option("checkpointLocation", f"{tmp_path}/c").start()
    )
    query.awaitTermination()
    batch = safe_stream(spark.createDataFrame([r for b in BATCHES for r in b], SCHEMA), POLICY, key)
    assert sorted(map(str, spark.table("projected").collect())) == sorted(map(str, batch.collect()))
    with pytest.raises(ValueError):
        safe_stream(stream.select(F.length("note").alias("n")), Policy.from_dict({"columns": {"n": "synthesize"}}), key)


def test_a_token_of_another_original_in_an_earlier_batch_stops_the_stream(spark, key, tmp_path):
    paths = paths_in(tmp_path)
    sanitize_stream(stream_of(spark, tmp_path, BATCHES[:1]), POLICY, key, "job", paths).awaitTermination()
    checks = f"{paths.vault}/_checks/project_id=project/job_id=job/batch_id=0"
    stored = spark.read.parquet(checks)
    assert stored.count() == 2 and "C-001" not in str(stored.collect())
    other = spark.createDataFrame([(r.token, "CHECK_OTHER") for r in stored.collect()], stored.schema)
    other.write.mode("overwrite").parquet(checks)
    spark.createDataFrame(BATCHES[1], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part=1")
    again = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    with pytest.raises(StreamingQueryException, match="token collision"):
        sanitize_stream(again, POLICY, key, "job", paths).awaitTermination()


def test_batches_of_the_event_queries_do_not_grow_with_the_files(spark, tmp_path):
    from veilspark.plans import queries

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(200)
    events.repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    out = queries._event_stream(spark, str(tmp_path)).out
    written = spark.read.parquet(out)
    assert written.count() == 200
    assert sorted(r[0] for r in written.select("batch_id").distinct().collect()) == [0, 1, 2]
