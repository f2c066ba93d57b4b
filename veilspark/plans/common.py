"""Key, policies and table access shared by the registered queries and their SQL."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..keys import ProjectKey
from ..policy import Policy, Recognizer

# A fixed key, so that the SQL side can compute the same tokens.
KEY = ProjectKey("acceptance", hashlib.sha256(b"veilspark acceptance queries").digest())

NO_DETECTOR = {"require_entity_detector": False}

ACCOUNT_BUCKETS = [[None, 0, "NEGATIVE"], [0, 2500, "LOW"], [2500, 7500, "MIDDLE"], [7500, None, "HIGH"]]
PRICE_BUCKETS = [[None, 50000, "SMALL"], [50000, 250000, "MEDIUM"], [250000, 400000, "LARGE"]]

CUSTOMER_POLICY = Policy.from_dict(
    {
        "security": NO_DETECTOR,
        "columns": {
            "c_custkey": "hash",
            "c_name": "tokenize",
            "c_nationkey": "redact",
            "c_acctbal": "bucket",
            "c_mktsegment": "keep",
        },
        "token_domains": {"c_name": "PERSON"},
        "bucket": {"c_acctbal": ACCOUNT_BUCKETS},
    }
)
ORDERS_POLICY = Policy.from_dict(
    {
        "security": NO_DETECTOR,
        "columns": {
            "o_orderkey": "tokenize",
            "o_custkey": "tokenize",
            "o_orderstatus": "keep",
            "o_totalprice": "bucket",
            "o_orderdate": "date_shift",
            "o_orderpriority": "drop",
        },
        "token_domains": {"o_orderkey": "order_no", "o_custkey": "customer id"},
        "bucket": {"o_totalprice": PRICE_BUCKETS},
        "date_shift": {"subject_column": "o_custkey", "min_days": 1, "max_days": 30},
    }
)
EVENTS_POLICY = Policy.from_dict(
    {
        "security": NO_DETECTOR,
        "columns": {
            "event_id": "tokenize",
            "ts": "date_shift",
            "user_id": "hash",
            "event_type": "keep",
            "value": "bucket",
            "props": "drop",
        },
        "token_domains": {"event_id": "EVENT"},
        "bucket": {"value": [[None, 5, "LOW"], [5, 20, "MIDDLE"], [20, None, "HIGH"]]},
        "date_shift": {"subject_column": "user_id", "min_days": 3, "max_days": 9, "direction": "forward"},
    }
)
IMPORT_POLICY = Policy.from_dict(
    {
        "security": NO_DETECTOR,
        "columns": {
            "o_orderkey": "keep",
            "o_custkey": "tokenize",
            "o_totalprice": "synthesize",
            "o_orderstatus": "keep",
            "o_orderdate": "date_shift",
            "o_orderpriority": "tokenize",
        },
        "token_domains": {"o_custkey": "CUSTOMER_ID", "o_orderpriority": "PRIORITY"},
        "date_shift": {"subject_column": "o_custkey", "min_days": 1, "max_days": 30},
    }
)
CLOCK_POLICY = Policy.from_dict(
    {"columns": {}, "time_shift": {"subject_column": "user_id", "min_minutes": 1, "max_minutes": 720}}
)
DOCUMENT_POLICY = Policy.from_dict(
    {
        "security": NO_DETECTOR,
        "columns": {
            "doc_id": "keep",
            "text": "redact_text",
            "lang": "keep",
            "source": "hash",
            "n_chars": "redact",
        },
    }
)
RECOGNIZERS = (
    Recognizer("us phone", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "tokenize"),
    Recognizer("serial", r"[0-9]{14,}", "drop"),
    Recognizer("mail host", r"mail[0-9]+\.example\.com", "redact"),
    Recognizer("currency", r"[0-9]+%", "keep"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows cost much CPU. One that is a single split, so one row group, is
    dealt over the cores; nothing larger is moved."""
    df = table(spark, sf_dir, name)
    return df.repartition(spark.sparkContext.defaultParallelism) if df.rdd.getNumPartitions() == 1 else df


def work_folder(spark: SparkSession) -> str:
    """A new folder in the shared place the cluster names. Only a session on one machine may
    do without: its temporary folder is shared by nature."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="veilspark-")
    return f"{root.rstrip('/')}/veilspark-{uuid.uuid4().hex}"
