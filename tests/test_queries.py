"""The registered queries: contract, SQL agreement on the smallest data, plan shape."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, rows_of
from veilspark.plans.common import work_folder

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data is not here")

SAMPLED = (
    "sanitize_customer", "sanitize_orders", "import_orders", "time_shift_events", "synthesize_custkey", "redact_documents",
    "find_pii", "custom_recognizers", "count_findings", "export_gate", "redaction_report", "draft_policies",
    "detokenize_orders", "audit_chain", "stream_events",
)


def test_every_sql_belongs_to_a_query():
    names = set(contract.queries())
    assert set(contract.oracle_sql()) <= names
    own = {n for n in names if n != "pipeline" and not n.startswith("op")}
    assert own <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).columns == ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@pytest.mark.parametrize("name", SAMPLED)
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = contract.queries()[name](spark, SF)
    result = db.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_table_projection_is_one_codegen_stage_without_shuffle_or_python(spark):
    plan = plan_of(contract.queries()["sanitize_customer"](spark, SF))
    assert "Exchange" not in plan and "Python" not in plan and plan.count("*(1)") >= 1


def test_gate_reads_only_the_columns_it_needs(spark, key):
    from veilspark import Policy
    from veilspark.operators.detection import column_findings

    seen = []
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    policy = Policy.from_dict({"columns": {"o_orderstatus": "keep"}, "default": {"unknown_column": "tokenize"}})
    original = type(orders).agg

    def spy(df, *columns):
        out = original(df, *columns)
        seen.append(plan_of(out))
        return out

    type(orders).agg = spy
    try:
        column_findings(orders, policy, "targeted")
    finally:
        type(orders).agg = original
    assert len(seen) == 1 and "ReadSchema: struct<o_orderstatus:string>" in seen[0]


def test_work_goes_to_the_folder_the_session_names():
    class Conf:
        def get(self, name, default=None):
            return "/shared/folder" if name == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert work_folder(Session()).startswith("/shared/folder/veilspark-")
