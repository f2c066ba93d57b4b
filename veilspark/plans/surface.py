"""Queries of operators that meet no table of their own in the other queries, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators.inference import combined_policy, infer_policy
from ..operators.sanitize import sanitize_records, sanitize_table
from ..operators.text_scan import EntityDetector
from ..policy import Policy, Recognizer
from ..sinks.writers import write_report
from ..sources.readers import load_any
from . import common as c
from .common import KEY, spread_table, table, work_folder


def schema_types(spark, sf):
    """Customers under column names that stand for sensitive types: tokens carry the type."""
    names = {"c_custkey": "customer_id", "c_name": "Name", "c_nationkey": "passport", "c_mktsegment": "Account No"}
    people = table(spark, sf, "customer").select(*(F.col(old).alias(new) for old, new in names.items()))
    policy = Policy.from_dict({"security": c.NO_DETECTOR, "default": {"unknown_column": "tokenize"}})
    return sanitize_table(people, policy, KEY).export().withColumnRenamed("Account No", "account_no")


def json_arrays(spark, sf):
    """Customers written as one JSON array for each nation, and read back."""
    folder = work_folder(spark)
    rows = table(spark, sf, "customer").select("c_nationkey", F.struct("c_custkey", "c_name", "c_mktsegment").alias("row"))
    arrays = rows.groupBy("c_nationkey").agg(F.to_json(F.collect_list("row")).alias("value"))
    arrays.repartition("c_nationkey").write.partitionBy("c_nationkey").text(folder)
    read = load_any(spark, folder, "json", schema="c_custkey bigint, c_name string, c_mktsegment string, c_nationkey int")
    return read.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")


def text_files(spark, sf):
    """The lines of each region's nations as one text file, read as one document."""
    folder = work_folder(spark)
    lines = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "\n").alias("value"))
    lines.repartition("n_regionkey").write.partitionBy("n_regionkey").text(folder)
    return load_any(spark, folder, "text").select("n_regionkey", F.length("value").alias("characters"), F.sha2(F.rtrim(F.regexp_replace("value", "\n$", "")), 256).alias("digest"))


def record_rows(spark, sf):
    """Regions handed over as records, through the same gate as a table."""
    records = [row.asDict() for row in table(spark, sf, "region").select("r_regionkey", "r_name").collect()]
    policy = Policy.from_dict({"security": c.NO_DETECTOR, "columns": {"r_regionkey": "hash", "r_name": "tokenize"}})
    return sanitize_records(spark, records, policy, KEY).export()


class Names(EntityDetector):
    """A stand-in for a model: words with a capital that end in -er."""

    def load(self):
        pattern = re.compile(r"\b[A-Z][a-z]*er\b", re.ASCII)
        return lambda text: [(m.start(), m.end(), "NAMED") for m in pattern.finditer(text)]


def detected_entities(spark, sf):
    """Conversations with the entities of a plug-in redacted; the policy requires one."""
    chats = spread_table(spark, sf, "conversations").select("conv_id", "turn", "text")
    policy = Policy.from_dict({"columns": {"conv_id": "keep", "turn": "keep", "text": "redact_text"}})
    return sanitize_table(chats, policy, KEY, mode="targeted", detector=Names()).export()


def _even(match: str) -> bool:
    return int(match) % 2 == 0


def validated_matches(spark, sf):
    """Numbers of three digits in parts' names and keys, of which a callback lets the even ones pass."""
    digits = F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")
    parts = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", digits).alias("note"))
    rule = Recognizer("code", r"[0-9]{3}", "redact", python_validator=_even)
    policy = Policy.from_dict({"security": c.NO_DETECTOR, "columns": {"p_partkey": "hash", "note": "redact_text"}})
    return sanitize_table(parts, policy, KEY, mode="targeted", recognizers=[rule]).export()


def policy_draft(spark, sf):
    """The complete draft for the orders, as one row a column; it holds no value of the table."""
    draft = infer_policy(table(spark, sf, "orders")).draft()
    rows = [(name, action, draft["default"]["unknown_column"], draft["date_shift"]["subject_column"]) for name, action in draft["columns"].items()]
    return spark.createDataFrame(rows, "column_name string, action string, unknown_column string, subject_column string")


def combined_draft(spark, sf):
    """One policy for customers and suppliers, from all their rows, and what is left to review."""
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_mktsegment")
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_acctbal")
    inferred = combined_policy([customers, suppliers])
    review = set(inferred.review_columns)
    return inferred.frame(spark).select("column_name", "action", F.col("column_name").isin(*review).alias("to_review"))


def identified_reports(spark, sf):
    """Reports of two jobs in one folder, told apart by project, job and kind of input."""
    folder = work_folder(spark)
    for job, name, policy in (("first", "customer", c.CUSTOMER_POLICY), ("second", "orders", c.ORDERS_POLICY)):
        report = sanitize_table(table(spark, sf, name), policy, KEY).report()
        report.project_id, report.job_id, report.input_type = KEY.project_id, job, "parquet"
        write_report(report, spark, folder, mode="append")
    stored = spark.read.parquet(f"{folder}/counters").where("section = 'action'")
    return stored.groupBy("project_id", "job_id", "input_type").agg(F.max("n").alias("most"), F.count("*").alias("actions"))


SURFACE = {
    f.__name__: f
    for f in (schema_types, json_arrays, text_files, record_rows, detected_entities, validated_matches, policy_draft, combined_draft, identified_reports)
}


def surface_sql(token, identifier, redaction, drafts: str, merged: str) -> dict[str, str]:
    """SQL of these queries, from the SQL of tokens and ids and of the drafts of single and merged tables."""
    return {
        "schema_types": f"""SELECT {token('CUSTOMER_ID', 'c_custkey::VARCHAR')} AS customer_id, {token('PERSON', 'c_name')} AS Name,
  {token('PASSPORT', 'c_nationkey::VARCHAR')} AS passport, {token('ACCOUNT_NO', 'c_mktsegment')} AS account_no FROM customer""",
        "json_arrays": "SELECT c_custkey, c_name, c_mktsegment, c_nationkey FROM customer",
        "text_files": """SELECT n_regionkey, length(string_agg(n_name, chr(10) ORDER BY n_name)) + 1 AS characters,
  sha256(string_agg(n_name, chr(10) ORDER BY n_name)) AS digest FROM nation GROUP BY n_regionkey""",
        "record_rows": f"SELECT {identifier('r_regionkey::VARCHAR')} AS r_regionkey, {token('UNKNOWN_VALUE', 'r_name')} AS r_name FROM region",
        "detected_entities": f"WITH {redaction('conversations', 'conv_id, turn', 'text')} "
        r"SELECT conv_id, turn, regexp_replace(safe, '\b[A-Z][a-z]*er\b', '[REDACTED_NAMED]', 'g') AS text FROM redacted",
        "validated_matches": f"""WITH t AS (SELECT p_partkey, p_name || ' ' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') AS note FROM part)
SELECT {identifier('p_partkey::VARCHAR')} AS p_partkey, regexp_replace(note, '([0-9][0-9][02468])$', '[REDACTED_CODE]') AS note FROM t""",
        "policy_draft": f"""SELECT column_name, action, 'review_required' AS unknown_column, 'customer_id' AS subject_column
FROM ({drafts}) WHERE table_name = 'orders'""",
        "combined_draft": f"SELECT column_name, action, action = 'review_required' AS to_review FROM ({merged})",
        "identified_reports": """SELECT 'acceptance' AS project_id, 'first' AS job_id, 'parquet' AS input_type, count(*) AS most, 5 AS actions FROM customer
UNION ALL SELECT 'acceptance', 'second', 'parquet', 2 * count(*), 5 FROM orders""",
    }
