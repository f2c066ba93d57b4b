"""Helpers of the operators: work tables in the shared folder, words of whole texts, checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.commit import remove

#: ASCII white space, which separates words: bytes.split() without arguments cuts at the same bytes.
SPACE = r"[\x20\x09-\x0D]+"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_local: dict[str, str] = {}
_passing: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset, a local session gets a temporary folder; a cluster has no folder to fall back on.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _local.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="veilspark-"))


def stage(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends, a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    if not stays:
        for made in _passing:
            made.append(path)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that are staged inside are removed at its end, but for those that stay."""
    made: list[str] = []
    _passing.append(made)
    try:
        yield
    finally:
        _passing.remove(made)
        for path in made:
            remove(spark, path)


def word_pieces(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, in lists from about `size` bytes each, so that a very long text needs little memory."""
    if len(data) <= size:
        yield data.split()
        return
    start = 0
    while start < len(data):
        cut = _SPACE.search(data, min(start + size, len(data)))
        end = cut.start() if cut else len(data)
        yield data[start:end].split()
        start = end


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row: Spark would copy a plain expression into every lambda."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bounded(df: DataFrame, most: int) -> bool:
    """Whether df has at most `most` rows; counts no more than that."""
    return df.limit(most + 1).count() <= most


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df, to be broadcast if it has at most `most` rows (of a few numbers or short texts each), else joined."""
    return F.broadcast(df) if bounded(df, most) else df


def hashed_share(hashed: Column, most: int, of: int) -> Column:
    """About `most` of the `of` rows, evenly by a 64-bit hash: a test that each row passes or not by itself, where a
    sorted limit would make every task send that many rows."""
    share = min(1.0, most / max(of, 1))
    return hashed <= F.lit(min((1 << 63) - 1, int(-(1 << 63) + share * (1 << 64))))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place in the given order, from 0, by range partitions: each is sorted and numbered by itself,
    and the sizes of those before it (one number a partition) are added."""
    spark = rows.sparkSession
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = stage(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    starts, total = [], 0
    for number, size in sorted(ordered.groupBy(part.alias("part")).count().collect()):  # one row a partition
        starts.append((number, total))
        total += size
    starts = F.broadcast(spark.createDataFrame(starts, "_part bigint, _start bigint"))
    joined = ordered.join(starts, part == F.col("_part"))
    return joined.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_start")
