"""Table sanitizing, gate, report and writes."""

import pytest
from pyspark.sql import functions as F

from veilspark import (
    EntityDetector,
    ExportBlocked,
    Policy,
    Recognizer,
    ReviewOverride,
    residual_scan,
    sanitize_records,
    sanitize_table,
    sanitize_tables,
    sanitize_text,
    write_safe,
)
from veilspark.operators.report import utility_impact
from veilspark.policy import normalize_column_name

OPEN = {"security": {"require_entity_detector": False}}


def policy(columns, **more):
    return Policy.from_dict({**OPEN, "columns": columns, **more})


def values(df, column):
    return [row[column] for row in df.collect()]


def test_column_names_match_across_styles():
    for name in ("CustomerID", "customer id", "customer_id", "Customer-ID"):
        assert normalize_column_name(name) == "customer_id"
    p = policy({"customerid": "hash", "audit_time": "keep"})
    assert p.action_for("CustomerID") == "hash" and p.action_for("AuditTime") == "keep"
    assert p.action_for("other") == "review_required"


@pytest.mark.parametrize(
    "document",
    [
        {"columns": {"a": "explode"}},
        {"default": {"unknown_column": "nothing"}},
        {"token_domains": {"a": "1x"}},
        {"date_shift": {"min_days": 0}},
        {"date_shift": {"min_days": 5, "max_days": 4}},
        {"date_shift": {"direction": "up"}},
        {"date_shift": {"scope": "table"}},
        {"time_shift": {"max_minutes": 1440}},
        {"security": {"mapping_ttl_days": 0}},
    ],
)
def test_bad_policies_are_rejected(document):
    with pytest.raises(ValueError):
        Policy.from_dict(document)


def test_yaml_policy():
    p = Policy.from_yaml(b"columns:\n  a: hash\nsecurity:\n  require_presidio: false\n")
    assert p.action_for("A") == "hash" and not p.security.require_entity_detector
    assert len(p.fingerprint) == 64


def test_null_rules_per_action(spark, key):
    df = spark.createDataFrame(
        [("C1", None)], "customer_id string, v string"
    ).select("customer_id", *[F.col("v").alias(f"v_{a}") for a in "abcdefgh"])
    p = policy(
        {
            "customer_id": "keep", "v_a": "tokenize", "v_b": "hash", "v_c": "bucket", "v_d": "date_shift",
            "v_e": "time_shift", "v_f": "redact", "v_g": "redact_text", "v_h": "synthesize",
        }
    )
    row = sanitize_table(df, p, key).safe.first()
    assert row["v_a"] is None and row["v_b"].startswith("HASH_") and row["v_c"] == "AMOUNT_BUCKET_UNKNOWN"
    assert row["v_d"] == "[REDACTED_DATE]" and row["v_e"] is None
    assert row["v_f"] == "[REDACTED_UNKNOWN_VALUE]" and row["v_g"] is None and row["v_h"] is None


def test_time_shift_wraps_and_keeps_missing(spark, key):
    df = spark.createDataFrame(
        [("C1", "01:15:00"), ("C1", "23:30:00"), ("C2", "08:00:00"), (None, None), (None, "08:00"), ("C3", "25:00")],
        "CustomerID string, AuditTime string",
    )
    p = policy(
        {"customer_id": "tokenize", "audit_time": "time_shift"},
        time_shift={"subject_column": "customer_id", "min_minutes": 60, "max_minutes": 60, "direction": "forward"},
    )
    result = sanitize_table(df, p, key)
    assert result.can_export
    assert values(result.safe, "AuditTime") == [
        "02:15:00", "00:30:00", "09:00:00", None, "[REDACTED_TIME]", "[REDACTED_TIME]",
    ]


def test_date_shift_keeps_intervals_of_a_subject(spark, key):
    df = spark.createDataFrame(
        [("C1", "2026-01-01"), ("C1", "2026-01-11"), (" C1 ", "2026-01-01"), ("C2", "x"), (None, "2026-01-01")],
        "customer_id string, transaction_date string",
    )
    out = values(sanitize_table(df, policy({"customer_id": "tokenize", "transaction_date": "date_shift"}), key).safe, "transaction_date")
    assert out[0] == out[2] and out[3] == out[4] == "[REDACTED_DATE]"
    days = spark.createDataFrame([(out[0], out[1])], "a string, b string").selectExpr("datediff(b, a) AS d")
    assert days.first()["d"] == 10


def test_absent_subject_blocks(spark, key):
    df = spark.createDataFrame([("2026-01-01", "08:00")], "d string, t string")
    result = sanitize_table(df, policy({"d": "date_shift", "t": "time_shift"}), key)
    assert result.gate.block_reasons == ["missing_subject_column", "missing_time_subject_column"]
    assert tuple(result.safe.first()) == ("[REVIEW_REQUIRED_DATE]", "[REVIEW_REQUIRED_TIME]")
    with pytest.raises(ExportBlocked):
        result.export()


def test_personal_data_in_a_kept_column_blocks(spark, key):
    df = spark.createDataFrame([("contact alice@example.com",)], "status string")
    result = sanitize_table(df, policy({"status": "keep"}), key)
    assert not result.can_export and result.gate.residual_detections == 1
    assert result.gate.block_reasons == ["residual_sensitive_data"]
    assert residual_scan(result.safe, result.policy).collect()[0]["n"] == 1


def test_shifted_dates_are_no_residuals(spark, key):
    df = spark.createDataFrame([("C1", "2026-07-20", "active")], "customer_id string, transaction_date string, status string")
    p = policy({"customer_id": "tokenize", "transaction_date": "date_shift", "status": "keep"})
    assert sanitize_table(df, p, key).gate.residual_detections == 0


def test_secret_columns_drop_by_name_and_by_value(spark, key):
    df = spark.createDataFrame(
        [("x", "fine", "token = abcdef123456", 1), ("y", "fine", "ok", 2)], "api_key string, a string, b string, n int"
    )
    strict = sanitize_table(df, policy({"a": "hash", "b": "hash", "n": "keep"}), key, "strict")
    assert strict.safe.columns == ["a", "n"]
    assert strict.gate.column_actions["api_key"] == strict.gate.column_actions["b"] == "drop"
    assert strict.gate.secret_detections == 2 + 1
    targeted = sanitize_table(df, policy({"a": "hash", "b": "hash", "n": "keep"}), key, "targeted")
    assert targeted.safe.columns == ["a", "b", "n"]


def test_review_columns_block_unless_overridden(spark, key):
    df = spark.createDataFrame([("alpha beta", "C-1")], "label string, customer_id string")
    p = policy({"customer_id": "tokenize"})
    assert sanitize_table(df, p, key).gate.block_reasons == ["review_required"]
    approved = sanitize_table(df, p, key, override=ReviewOverride("alice@corp", "checked by hand"))
    assert approved.can_export and approved.safe.first()["label"] == "[REVIEW_REQUIRED]"
    for reason in ("saw ALPHA BETA there", "ask bob@example.com", "password: hunter2hunter2"):
        with pytest.raises(ValueError):
            sanitize_table(df, p, key, override=ReviewOverride("alice@corp", reason))
    for actor, reason in (("", "fine reason"), ("a b", "fine reason"), ("alice", "x"), ("alice", "bad\nline")):
        with pytest.raises(ValueError):
            ReviewOverride(actor, reason)


def test_short_cells_do_not_count_as_leaks(spark, key):
    df = spark.createDataFrame([("by",)], "label string")
    assert sanitize_table(df, policy({"label": "hash"}), key, override=ReviewOverride("alice", "done by hand")).can_export


def test_missing_detector_blocks_only_where_needed(spark, key):
    df = spark.createDataFrame([("a",)], "v string")
    needed = Policy.from_dict({"columns": {"v": "redact_text"}})
    assert sanitize_table(df, needed, key, "targeted").gate.block_reasons == ["entity_detector_unavailable"]
    unneeded = Policy.from_dict({"columns": {"v": "hash"}})
    assert sanitize_table(df, unneeded, key, "targeted").can_export
    assert not sanitize_table(df, unneeded, key, "strict").can_export


class Shouts(EntityDetector):
    def load(self):
        return lambda text: [(0, len(text), "SHOUT")] if text.isupper() else []


def test_detector_counts_review_columns(spark, key):
    df = spark.createDataFrame([("LOUD",), ("quiet",)], "v string")
    result = sanitize_table(df, Policy.from_dict({"columns": {"v": "review_required"}}), key, detector=Shouts())
    assert result.gate.detector_counts["entity_scanner"] == 1
    assert result.gate.block_reasons == ["review_required"]


def test_domains_link_columns_and_tables(spark, key):
    p = policy(
        {"a_code": "tokenize", "b_code": "tokenize"}, token_domains={"a_code": "location", "b_code": "LOCATION"}
    )
    df = spark.createDataFrame([("A", "A"), ("B", "A"), (None, None)], "a_code string, b_code string")
    rows = sanitize_table(df, p, key).safe.collect()
    assert rows[0][0] == rows[0][1] and rows[0][0].startswith("LOCATION_")
    assert rows[1][0] != rows[1][1] and rows[2][0] is None
    other = spark.createDataFrame([("B",)], "b_code string")
    both = sanitize_tables({"x": df, "y": other}, p, key)
    assert both["y"].safe.first()[0] == rows[1][0]


def test_tokens_do_not_depend_on_partitioning(spark, key):
    df = spark.range(500).select(F.col("id").cast("string").alias("customer_id"))
    p = policy({"customer_id": "tokenize"})
    one = sanitize_table(df.coalesce(1), p, key).safe.orderBy("customer_id").collect()
    many = sanitize_table(df.repartition(13), p, key).safe.orderBy("customer_id").collect()
    assert one == many and len({r[0] for r in one}) == 500


def test_no_original_survives(spark, key):
    originals = [f"Person Number {i}" for i in range(50)]
    df = spark.createDataFrame([(o, f"note about {i}@mail.example") for i, o in enumerate(originals)], "name string, note string")
    result = sanitize_table(df, policy({"name": "tokenize", "note": "redact_text"}), key)
    text = str(result.export().collect())
    assert not any(o in text for o in originals) and "@mail.example" not in text


def test_report_and_utility_impact(spark, key):
    df = spark.createDataFrame([("a@b.co token = abcdef123", "x@y.org"), (None, "q")], "note string, email string")
    result = sanitize_table(df, policy({"note": "redact_text", "email": "tokenize"}), key)
    report = result.report()
    assert report.detector_counts == {"schema_detector": 2, "secret_scanner": 1, "regex_pii_scanner": 1}
    assert report.action_counts == {"redact_text": 2, "tokenize": 2, "drop": 1, "redact": 1}
    assert report.as_dict()["utility_impact"]["email"]["preservation"] == "stable_linkage"
    unknown = spark.createDataFrame([("c", "other")], "column_name string, action string")
    assert utility_impact(unknown).first()["preservation"] == "unknown"


def test_gated_write(spark, key, tmp_path):
    df = spark.createDataFrame([("a@b.co",), ("plain",)], "note string")
    p = policy({"note": "redact_text"})
    report = write_safe(sanitize_table(df, p, key), str(tmp_path / "out"))
    assert report.detector_counts == {"regex_pii_scanner": 1}
    assert sorted(values(spark.read.parquet(str(tmp_path / "out")), "note")) == ["[REDACTED_EMAIL]", "plain"]
    blocked = sanitize_table(df, policy({"note": "keep"}), key)
    with pytest.raises(ExportBlocked):
        write_safe(blocked, str(tmp_path / "blocked"))
    assert not (tmp_path / "blocked").exists()
    with pytest.raises(ValueError):
        write_safe(sanitize_table(df, p, key), str(tmp_path / "x"), "xlsx")


def test_documents(spark, key):
    df = spark.createDataFrame([(1, "call a@b.co about CASE-9")], "id int, body string")
    case = Recognizer("case", r"CASE-\d+", "tokenize")
    result = sanitize_text(df, "body", policy({}), key, [case])
    assert result.can_export
    assert result.export().first()["body"].startswith("call [REDACTED_EMAIL] about CASE_")
    assert result.mapping().first()["original"] == "CASE-9"
    # a recognizer that puts personal data back is caught by the rescan
    leaky = Recognizer("kept", r"CASE-\d+", "redact")
    again = spark.createDataFrame([(1, "a@b.co")], "id int, body string")
    assert sanitize_text(again, "body", policy({}), key, [leaky]).gate.residual_detections == 0


def test_records_and_nested_values(spark, key):
    result = sanitize_records(spark, [{"customer_id": "C-1", "email": "alice@example.com"}],
                              policy({"customer_id": "hash", "email": "tokenize"}), key)
    row = result.export().first()
    assert row["email"].startswith("EMAIL_") and "alice" not in str(row)
    nested = spark.createDataFrame([((1, "a@b.co"),)], "v struct<n:int,m:string>")
    blocked = sanitize_table(nested, policy({"v": "keep"}), key)
    assert blocked.gate.residual_detections == 1


def test_distinct_text_option(spark, key):
    df = spark.createDataFrame([("repeat a@b.co",)] * 20 + [(None,)], "note string")
    p = policy({"note": "redact_text"})
    result = sanitize_table(df, p, key, distinct_text=True)
    assert sorted(map(str, values(result.export(), "note"))) == ["None"] + ["repeat [REDACTED_EMAIL]"] * 20
    assert result.report().detector_counts["regex_pii_scanner"] == 20


def test_callback_recognizers_in_visible_columns(spark, key):
    df = spark.createDataFrame([("A1 A2",), ("A3",), (None,)], "status string")
    odd = Recognizer("odd", r"A\d", "drop", python_validator=lambda m: int(m[1]) % 2 == 1)
    result = sanitize_table(df, policy({"status": "keep"}), key, recognizers=[odd])
    assert result.gate.detector_counts == {"custom_recognizer": 2}
    assert residual_scan(df, policy({"status": "keep"}), [odd]).first()["n"] == 2
