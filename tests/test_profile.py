"""Profiles, policy inference, quantiles, synthesis, previews."""

import math
import random
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark import Policy, combined_policy, infer_policy, preview_table, profile_columns, union_tables
from veilspark import value_frequencies
from veilspark.functions.text import canonical_string
from veilspark.operators.naming import canonical_name, name_features, token_domain
from veilspark.operators.profile import profile_tables
from veilspark.operators.quantiles import exact_quantiles
from veilspark.operators.synthesize import synthesize_numeric


def infer(spark, columns, schema):
    rows = list(zip(*columns.values()))
    return infer_policy(spark.createDataFrame(rows, schema))


def brute_profile(values):
    texts = [str(v).strip() for v in values if v is not None and str(v).strip()]
    n, counts = len(texts), Counter(texts)
    unique = len(counts)
    candidate = n > 0 and (
        unique == 1
        or (
            unique <= min(100, max(20, round(math.sqrt(n))))
            and (unique <= max(2, n // 3) if n < 50 else unique / n <= 0.2)
        )
    )
    safe = n >= 2 and 2 <= unique <= min(64, max(12, n // 2)) and min(counts.values()) >= max(2, int(n * 0.01))
    rare = sum(c for c in counts.values() if c < 5)
    return (n, unique, rare, max(counts.values(), default=0), candidate, safe)


def test_profiles_equal_brute_force(spark):
    rng = random.Random(3)
    columns = {
        "few": [rng.choice("abc") for _ in range(400)],
        "rare": [rng.choice("abc") for _ in range(398)] + ["x", "y"],
        "ids": [f"id{i}" for i in range(400)],
        "mixed": [rng.choice([None, "", "  ", " a ", "a", "b" * 80]) for _ in range(400)],
        "empty": [None] * 400,
        "groups": [str(i % 20) for i in range(400)],
        "many": [str(i % 90) for i in range(400)],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} string" for c in columns))
    rows = {r["column_name"]: r for r in profile_columns(df).collect()}
    assert set(rows) == set(columns)
    for name, values in columns.items():
        r = rows[name]
        n, unique, rare, top, candidate, safe = brute_profile(values)
        assert (r["non_null_count"], r["unique_count"]) == (n, unique)
        assert r["is_category_candidate"] == candidate, name
        assert r["is_safe_category"] == safe, name
        if n:
            assert r["rare_value_ratio"] == rare / n and r["top_value_ratio"] == top / n


@pytest.mark.parametrize("n, unique", [(1, 1), (6, 2), (6, 3), (49, 16), (49, 17), (50, 10), (50, 11), (400, 20), (400, 21)])
def test_category_candidate_limits(spark, n, unique):
    values = [f"v{i % unique}" for i in range(n)]
    row = profile_columns(spark.createDataFrame([(v,) for v in values], "c string")).first()
    assert row["is_category_candidate"] == brute_profile(values)[4]


def test_value_frequencies(spark):
    df = spark.createDataFrame([("a", 1), (" a", 1), ("", None)], "s string, n int")
    got = {(r["column_name"], r["value"]): r["n"] for r in value_frequencies(df).collect()}
    assert got == {("s", "a"): 2, ("n", "1"): 2}


def test_name_features():
    assert canonical_name(" EMAIL ") == "email" and canonical_name("รหัสลูกค้า") == "customer_id"
    assert name_features("ApprovedBy")["is_actor"] and not name_features("Standby")["is_actor"]
    assert name_features("case_number_2")["is_identifier"] and name_features("PersonalIDs")["is_identifier"]
    assert name_features("date_of_birth")["is_date"] and not name_features("update_count")["is_date"]
    assert name_features("audit_time")["is_time"] and not name_features("date_time")["is_time"]
    assert token_domain("OriginLocationCode") == "LOCATION" and token_domain("9x") == "CATEGORY"
    assert token_domain("status code") == "STATUS_CODE"


def test_status_code_is_kept(spark):
    policy = infer(spark, {"StatusCode": ["ACTIVE", "CLOSED"] * 3}, "StatusCode string")
    assert policy.columns == {"StatusCode": "keep"}
    assert policy.decisions[0].reason == "safe low-cardinality category"


def test_amounts_notes_and_unknowns(spark):
    assert infer(spark, {"a": [100.0, 250.0, 900.0]}, "OutstandingAmount double").columns == {
        "OutstandingAmount": "review_required"
    }
    assert infer(spark, {"n": ["call customer", "follow up"]}, "note string").columns == {"note": "redact_text"}
    assert infer(spark, {"u": ["alpha", "beta", "gamma"]}, "UnclassifiedLabel string").columns == {
        "UnclassifiedLabel": "review_required"
    }


def test_draft_is_complete_and_free_of_values(spark):
    policy = infer(spark, {"c": ["C-001", "C-002"], "a": [100.0, 250.0]}, "CustomerID string, OutstandingAmount double")
    draft = policy.draft()
    assert draft["columns"] == {"CustomerID": "tokenize", "OutstandingAmount": "review_required"}
    assert draft["date_shift"]["subject_column"] == "CustomerID"
    assert draft["security"]["store_raw_copy"] is False and "C-001" not in str(draft)
    assert Policy.from_dict(draft).action_for("customer_id") == "tokenize"


def test_operational_table(spark):
    n, when = 6, datetime(2026, 1, 1)
    columns = {
        "CustomerID": [f"C{i}" for i in range(n)], "IsArchived": [True, False] * 3, "SourceSystem": ["A", "B"] * 3,
        "OrganizationCode": ["O1", "O2"] * 3, "OriginLocationCode": [1, 2] * 3, "PriorLocationCode": [1, 2] * 3,
        "CurrentLocationCode": ["1", "2"] * 3, "Description": ["first", "second"] * 3, "RecordedDate": [when] * n,
        "Notes": [f"text {i}" for i in range(n)], "LastModifiedDate": [when] * n, "AuditTime": ["08:00:00"] * n,
        "ProcessedBy": ["u1", "u2"] * 3, "AgentCode": [f"g{i}" for i in range(n)], "OfficeCode": ["x", "y"] * 3,
        "Amount": [f"{i}.00" for i in range(n)],
    }
    schema = ", ".join(
        f"{c} {'boolean' if c == 'IsArchived' else 'int' if c in ('OriginLocationCode', 'PriorLocationCode') else 'timestamp' if c.endswith('Date') else 'string'}"
        for c in columns
    )
    got = infer(spark, columns, schema).columns
    expected = dict.fromkeys(columns, "tokenize") | {
        "IsArchived": "keep", "Notes": "redact_text", "RecordedDate": "date_shift", "LastModifiedDate": "date_shift",
        "AuditTime": "time_shift", "Amount": "review_required",
    }
    assert got == expected


def test_numeric_groups_and_measures(spark):
    policy = infer(
        spark, {"g": [i % 3 + 1 for i in range(120)], "v": list(range(120))}, "NumericGroup int, ContinuousValue int"
    )
    assert policy.columns == {"NumericGroup": "tokenize", "ContinuousValue": "review_required"}
    assert policy.roles == {"NumericGroup": "category", "ContinuousValue": "unknown_numeric"}
    assert policy.token_domains == {"NumericGroup": "NUMERICGROUP"}


def test_combined_policy_of_differing_tables(spark):
    a = spark.createDataFrame([("C1", 5)], "customer_id string, amount int")
    b = spark.createDataFrame([("C2", "x", "2.5")], "customer_id string, note string, amount string")
    merged = union_tables([a, b])
    assert merged.columns == ["customer_id", "amount", "note"] and merged.count() == 2
    policy = combined_policy([a, b])
    assert policy.columns == {"customer_id": "tokenize", "amount": "review_required", "note": "redact_text"}
    assert policy.review_columns == ["amount"]


def test_preview_is_bounded_sanitized_and_drafted(spark, key):
    df = spark.createDataFrame([(f"C-{i:03d}", 1.0 * i) for i in range(50)], "CustomerID string, OutstandingAmount double")
    preview = preview_table(df, key, 7)
    sample = preview["sample"].collect()
    assert preview["rows"] == len(sample) == 7
    assert all(r["CustomerID"].startswith("UNKNOWN_VALUE_") for r in sample)
    assert preview["inferred_roles"]["CustomerID"] == "direct_identifier"
    assert preview["suggested_policy"]["columns"]["OutstandingAmount"] == "review_required"
    assert "review_required" in preview["report"].block_reasons
    with pytest.raises(ValueError):
        preview_table(df, key, 0)


SHARES = [0.0, 0.01, 0.2, 0.25, 0.5, 0.77, 0.99, 1.0]


@pytest.mark.parametrize(
    "values",
    [
        [5.0],
        [1.0, 2.0],
        [float(i * i % 997) for i in range(30_000)],
        [7.0] * 20_000 + [float(i) for i in range(20_000)],
        [math.exp(i / 3000) for i in range(40_000)],
    ],
    ids=["one", "two", "repeats", "hot value", "skewed"],
)
def test_narrowed_quantiles_equal_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(5)
    expected = np.quantile(np.array(values), SHARES)
    got = exact_quantiles(df, F.col("x"), SHARES)
    assert np.allclose(got, expected, rtol=1e-12, atol=0)
    assert exact_quantiles(df.where("x IS NULL"), F.col("x"), SHARES) == []


def test_synthesized_numbers_stay_in_range_and_off_the_originals(spark, key):
    values = [100.0, 250.0, 900.0, 1200.0, None]
    df = spark.createDataFrame(list(enumerate(values)), "i int, amount double")
    out = [r["o"] for r in synthesize_numeric(df, "amount", "o", key).orderBy("i").collect()]
    assert out[4] is None and all(100 <= v <= 1200 and v not in values for v in out[:4])


def test_synthesized_formatted_amounts(spark, key):
    df = spark.createDataFrame([("1,200.50",), ("THB 2,400.00",), ("(300.00)",), ("-",)], "amount string")
    out = sorted(r["o"] for r in synthesize_numeric(df, "amount", "o", key).collect() if r["o"] is not None)
    assert len(out) == 3 and all(-300 <= v <= 2400 for v in out)
    assert not set(out) & {1200.5, 2400.0, -300.0}


def test_synthesis_of_whole_and_constant_columns(spark, key):
    gaps = [i * 3 for i in range(2000)]
    df = spark.createDataFrame([(v, 7.5, i) for i, v in enumerate(gaps)], "n int, c double, i int")
    whole = synthesize_numeric(df, "n", "o", key)
    assert dict(whole.dtypes)["o"] == "bigint"
    assert not {r["o"] for r in whole.collect()} & set(gaps)
    constant = [r["o"] for r in synthesize_numeric(df, "c", "o", key).collect()]
    assert 7.5 not in constant and all(6.5 <= v <= 8.5 for v in constant) and len(set(constant)) > 100
    empty = df.select(F.lit(None).cast("string").alias("x"))
    assert synthesize_numeric(empty, "x", "o", key).first()["o"] is None


def test_synthesis_does_not_depend_on_partitioning(spark, key):
    df = spark.range(3000).selectExpr("id", "id * 1.5 + 0.25 AS v")
    one = synthesize_numeric(df.coalesce(1), "v", "o", key).orderBy("id").collect()
    many = synthesize_numeric(df.repartition(11), "v", "o", key).orderBy("id").collect()
    assert one == many


def largest_method(df):
    """Bytes of the largest method Spark generates for a plan; the JVM only interprets those over 8,000."""
    stages = df._jdf.queryExecution().debug().codegenToSeq()
    return max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size()))


def test_wide_tables_stay_compiled(spark):
    kinds = ["cast(id AS bigint)", "cast(id AS double) / 7", "concat(' n', id)", "timestamp_ntz'2024-01-02 03:04:05'"]
    wide = spark.range(5).selectExpr(*[f"{kinds[i % 4]} AS c{i}" for i in range(14)])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert largest_method(profile_tables({"wide": wide})) < 8000
        assert largest_method(value_frequencies(wide)) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_values_of_every_type_count_as_their_texts(spark):
    rows = [
        (0.0, 0.1, 1, "2024-10-27 00:30:00", " a", True), (-0.0, 0.1, -1, "2024-10-27 01:30:00", "a　", None),
        (float("nan"), None, None, "9999-12-31 23:59:59.5", " ", False), (1e-310, 1e30, 1, "2024-10-27 00:30:00.000001", "12:30", True),
        (-0.0, 0.1, 2**63 - 1, "0001-01-01 00:00:00", "", True), (float("-inf"), -0.0, -(2**63), None, None, True),
        (1.5e16, 0.0, 10, "9999-12-30 23:59:59.25", "\x0012:30 pm", True), (12345678.9, 7.0, 10, "1600-02-29 12:00:00.1", "é ", True),
    ]
    df = spark.createDataFrame(rows, "real double, small float, whole bigint, ts string, text string, yes boolean").selectExpr(
        "*", "cast(ts AS timestamp) AS at", "cast(ts AS timestamp_ntz) AS wall", "cast(whole AS decimal(20,0)) AS exact",
        "cast(ts AS timestamp_ntz) + make_dt_interval(3000000) AS far", "cast(least(greatest(whole, -9), 9) AS tinyint) AS tiny", "struct(whole) AS nested",
    )
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # 00:30 and 01:30 UTC have one text there
    try:
        df = df.withColumn("shifted", F.timestamp_seconds(F.col("tiny") * 1800 + 1729989000))
        got = {r["column_name"]: r.asDict() for r in profile_columns(df).collect()}
        for field in df.schema.fields:
            text = canonical_string(F.col(field.name), field.dataType)
            texts = [t.strip() for (t,) in df.select(text).collect() if t is not None and t.strip()]
            counts = Counter(texts)
            want = (len(texts), len(counts), min(counts.values()), sum(map(len, texts)) / len(texts), max(counts.values()) / len(texts))
            row = got[field.name]
            assert (row["non_null_count"], row["unique_count"], row["least_count"], row["average_text_length"], row["top_value_ratio"]) == want, field.name
            found = {r["value"]: r["n"] for r in value_frequencies(df, [field.name]).collect()}
            assert found == counts, field.name
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
