"""Files that Spark has no reader for, decoded inside tasks.

One task decodes one file or archive member, so work spreads over files. Every file is
checked against the limits before it is decoded.
"""

from __future__ import annotations

import gzip
import io
import json
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import PurePosixPath

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .formats import ARCHIVES, SEPARATORS, file_format

MAX_INPUT_BYTES = 100_000_000
MAX_MEMBERS = 100
MAX_EXTRACTED_BYTES = 500_000_000


@dataclass(frozen=True)
class Limits:
    """What a file that one task must hold may measure; give ``load_any`` other ones as needed."""

    file_bytes: int = field(default_factory=lambda: MAX_INPUT_BYTES)
    members: int = field(default_factory=lambda: MAX_MEMBERS)
    archive_bytes: int = field(default_factory=lambda: MAX_EXTRACTED_BYTES)


def _records(found) -> pa.Table:
    return pa.Table.from_pylist(found if isinstance(found, list) else [found])


def _frame(read: Callable[[io.BytesIO], pd.DataFrame]) -> Callable[[bytes], pa.Table]:
    return lambda data: pa.Table.from_pandas(read(io.BytesIO(data)), preserve_index=False)


def _yaml(data: bytes) -> pa.Table:
    import yaml

    return _records(yaml.safe_load(data.decode("utf-8")))


def _column_file(module: str) -> Callable[[bytes], pa.Table]:
    def read(data: bytes) -> pa.Table:
        import importlib

        return importlib.import_module(f"pyarrow.{module}").read_table(io.BytesIO(data))

    return read


DECODERS: dict[str, Callable[[bytes], pa.Table]] = {
    "text": lambda data: pa.table({"value": [data.decode("utf-8")]}),
    "json": lambda data: _records(json.loads(data)),
    "yaml": _yaml,
    "jsonl": _frame(lambda stream: pd.read_json(stream, lines=True)),
    "xml": _frame(lambda stream: pd.read_xml(stream, parser="etree")),
    **{name: _column_file(name) for name in ("parquet", "feather", "orc")},
    **{
        name: _frame(lambda stream, sep=sep: pd.read_csv(stream, sep=sep))
        for name, sep in SEPARATORS.items()
    },
}


def decode(fmt: str, data: bytes) -> pa.Table:
    """One file's bytes as a table; a gzipped file is opened first."""
    if fmt not in DECODERS:
        raise ValueError(f"no decoder for {fmt}")
    return DECODERS[fmt](gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)


def _refused(entry: zipfile.ZipInfo) -> str | None:
    """Why a member is not read, if it isn't."""
    path = PurePosixPath(entry.filename.replace("\\", "/"))
    if path.is_absolute() or ".." in path.parts:
        return "leads out of the archive"
    if entry.flag_bits & 1:
        return "is encrypted"
    if entry.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        return "is compressed in a way that is not read"
    return "is an archive itself" if file_format(entry.filename) in ARCHIVES else None


def zip_members(data: bytes, limits: Limits | None = None) -> Iterator[tuple[str, str, bytes]]:
    """(name, format, bytes) of an archive's files; one that breaks a rule refuses all."""
    limits = limits or Limits()
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        files = [entry for entry in archive.infolist() if not entry.is_dir()]
        if not 1 <= len(files) <= limits.members:
            raise ValueError(f"an archive of {len(files)} files; 1 to {limits.members} are read")
        problems = [f"{e.filename} {why}" for e in files if (why := _refused(e))]
        if problems:
            raise ValueError("; ".join(problems))
        left = limits.archive_bytes
        for entry in files:
            with archive.open(entry) as member:  # the size an entry states proves nothing
                content = member.read(left + 1)
            left -= len(content)
            if left < 0:
                raise ValueError(f"the archive holds over {limits.archive_bytes} bytes")
            yield entry.filename, file_format(entry.filename), content


def binary_files(spark: SparkSession, path: str, fmt: str, limits: Limits | None = None) -> DataFrame:
    """(name, fmt, content) of files, or of archive members, within the limits."""
    limits = limits or Limits()
    too_large = F.raise_error(F.lit("input file exceeds the maximum allowed size")).cast("boolean")
    files = spark.read.format("binaryFile").load(path)
    # the length is looked at before the content is used, whatever columns are asked for
    content = F.when(F.when(F.col("length") > limits.file_bytes, too_large).otherwise(True), F.col("content"))
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), content.alias("content"))
    if fmt == "zip":
        return archive_members(files, limits)
    return files.select("name", F.lit(fmt).alias("fmt"), "content")


def archive_members(archives: DataFrame, limits: Limits | None = None) -> DataFrame:
    """(name, fmt, content) of every member of the zip archives in column ``content``."""
    limits = limits or Limits()

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                for member in zip_members(bytes(content), limits):
                    yield pd.DataFrame([member], columns=["name", "fmt", "content"])

    return archives.select("content").mapInPandas(explode, "name string, fmt string, content binary")


def decoded(files: DataFrame) -> DataFrame:
    """All rows of (name, fmt, content) files, under the union of their schemas. Only the
    distinct schemas reach the driver."""

    def schemas(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tables = [decode(f, bytes(c)) for f, c in zip(batch["fmt"], batch["content"])]
            yield pd.DataFrame(
                {"arrow": [t.schema.remove_metadata().serialize().to_pybytes() for t in tables]}
            )

    distinct = files.mapInPandas(schemas, "arrow binary").distinct().collect()
    found = [pa.ipc.read_schema(pa.py_buffer(bytes(row["arrow"]))) for row in distinct]
    target = pa.unify_schemas(found, promote_options="permissive")
    schema = files.sparkSession.createDataFrame(target.empty_table()).schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fmt, content in zip(batch.column("fmt"), batch.column("content")):
                table = decode(fmt.as_py(), content.as_py())
                columns = [
                    table.column(f.name).cast(f.type)
                    if f.name in table.column_names
                    else pa.nulls(table.num_rows, f.type)
                    for f in target
                ]
                yield from pa.table(columns, schema=target).to_batches()

    return files.mapInArrow(rows, schema)


def read_archive(spark: SparkSession, path: str, limits: Limits | None = None) -> dict[str, DataFrame]:
    """One table per archive member; member names (as many as the limits allow) come to the driver."""
    members = binary_files(spark, path, "zip", limits)
    names = [row["name"] for row in members.select("name").distinct().collect()]
    return {name: decoded(members.where(F.col("name") == name)) for name in sorted(names)}
