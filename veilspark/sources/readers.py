"""Read any supported input as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import quoted
from .decoders import Limits, binary_files, decoded, read_archive
from .formats import SEPARATORS, file_format, inner_format

# Cell texts that mean "no value" in delimited files.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def without_missing_texts(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.when(~quoted(f.name).isin(*MISSING_TEXTS), quoted(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else quoted(f.name)
            for f in df.schema.fields
        ]
    )


def read_delimited(
    spark: SparkSession,
    path: str,
    separator: str = ",",
    schema: T.StructType | str | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """A delimited file with a header; unnamed columns become ``column_<i>``. With
    ``multi_line`` a quoted cell may hold line breaks, and a file is read by one task;
    without, big files are split."""
    reader = spark.read.option("header", True).option("sep", separator).option("escape", '"')
    reader = reader.option("multiLine", multi_line)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    df = reader.csv(path)
    names = [f"column_{i + 1}" if c == f"_c{i}" else c for i, c in enumerate(df.columns)]
    df = df.toDF(*names)
    missing = [] if schema else numbers_with_gaps(df)
    return without_missing_texts(df).withColumns(
        {name: quoted(name).try_cast(kind) for name, kind in missing}
    )


def numbers_with_gaps(df: DataFrame) -> list[tuple[str, str]]:
    """Text columns that hold numbers but for texts that mean "no value", which the reader's
    own inference takes for text, and their types. One aggregate over the text columns."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return []
    tests = []
    for name in names:
        text = F.trim(quoted(name))
        gap = quoted(name).isin(*MISSING_TEXTS)
        number = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
        tests.append(
            F.struct(
                F.count_if(gap).alias("gaps"),
                F.count_if(~gap & number).alias("numbers"),
                F.count_if(~gap & ~number).alias("others"),
                F.count_if(~gap & number & text.try_cast("bigint").isNull()).alias("fractions"),
            )
        )
    found = zip(names, df.agg(*tests).first())
    return [
        (name, "double" if n["fractions"] else "bigint")
        for name, n in found
        if n["gaps"] and n["numbers"] and not n["others"]
    ]


def load_any(
    spark: SparkSession,
    path: str,
    input_type: str | None = None,
    schema: T.StructType | str | None = None,
    row_tag: str = "row",
    multi_line: bool = True,
    limits: Limits | None = None,
) -> DataFrame:
    """One DataFrame from a path or glob. Give a schema for big inputs to spare the
    inference pass, and ``multi_line=False`` if no quoted cell holds a line break, so that
    big delimited files are split. ``limits`` bounds files that one task must hold.
    Archives hold several tables: see ``load_tables``."""
    fmt = file_format(path, input_type)
    if fmt == "gzip":
        fmt = inner_format(path)
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt in SEPARATORS:
        return read_delimited(spark, path, SEPARATORS[fmt], schema, multi_line)
    if fmt == "json":
        return reader.option("multiLine", True).json(path)
    if fmt == "jsonl":
        return reader.json(path)
    if fmt == "xml":
        return reader.option("rowTag", row_tag).xml(path)
    if fmt == "parquet":
        return reader.parquet(path)
    if fmt == "orc":
        return reader.orc(path)
    if fmt == "text":
        return spark.read.text(path, wholetext=True)
    if fmt in ("yaml", "feather"):
        return decoded(binary_files(spark, path, fmt, limits))
    raise ValueError("an archive holds several tables; use load_tables")


def load_tables(
    spark: SparkSession, path: str, input_type: str | None = None, limits: Limits | None = None
) -> dict[str, DataFrame]:
    """Every table of an input by name: the members of an archive, else the one file."""
    if file_format(path, input_type) == "zip":
        return read_archive(spark, path, limits)
    return {path.rsplit("/", 1)[-1]: load_any(spark, path, input_type, limits=limits)}
