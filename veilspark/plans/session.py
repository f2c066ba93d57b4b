"""Session settings and shipping of this package to the executors."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

import veilspark
from veilspark.keys import PLAN_REDACTION_REGEX

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the Python workers once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(veilspark.__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="veilspark-"), "veilspark")
    context.addPyFile(shutil.make_archive(archive, "zip", root, "veilspark"))
    _shipped.add(context.applicationId)


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("veilspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.redaction.string.regex", PLAN_REDACTION_REGEX)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
