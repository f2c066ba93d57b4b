"""Column profiles: value frequencies first, statistics over them second."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import canonical_string, quoted, strip

# Fixed value: a clock time, optionally with seconds, fraction and AM/PM.
CLOCK_TEXT = r"(?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d{1,6})?)?(?:\s*[AaPp][Mm])?"


# Slots of a cell by its type; what has no slot of its own travels as its text.
_SLOTS = {"whole": "bigint", "real": "double", "moment": "timestamp_ntz", "text": "string"}
_FIRST_DAY, _LAST_DAY = "0001-01-01", "9999-12-31"  # moments between have texts of one form


def _slot(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "whole"
    if isinstance(dtype, T.DoubleType):
        return "real"
    return "moment" if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)) else "text"


def _cells(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(place, whole, real, moment, text): one row per cell, null and blank ones too. Values keep their types
    here: texts of all columns in one expression make a method that the JVM only interprets."""

    def cell(place: int, name: str) -> Column:
        dtype = df.schema[name].dataType
        own = _slot(dtype)
        value = canonical_string(quoted(name), dtype) if own == "text" else quoted(name)
        slots = [(value if slot == own else F.lit(None)).cast(kind).alias(slot) for slot, kind in _SLOTS.items()]
        return F.struct(F.lit(place).alias("place"), *slots)

    return df.select(F.inline(F.array(*[cell(i, name) for i, name in enumerate(names)])))


def _stripped(text: Column) -> Column:
    """``strip``, which walks the whole text, only where the first or last character may need it."""
    last = F.ascii(F.substring(text, -1, 1))
    return F.when(F.ascii(text).between(33, 126) & last.between(33, 126), text).otherwise(strip(text))


def unpivot(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(place, value): one row per non-blank cell, its column's place in ``names`` and its
    stripped text."""
    value = F.coalesce(
        F.col("whole").cast("string"),
        canonical_string(F.col("real"), T.DoubleType()),
        canonical_string(F.col("moment"), T.TimestampNTZType()),
        _stripped(F.col("text")),
    )
    return _cells(df, names).select("place", value.alias("value")).where(F.col("value") != "")


def _keyed(cells: DataFrame) -> DataFrame:
    """(place, v, w, width, clock): for each non-blank cell 128 bits that equal those of another cell of its
    column if their texts are equal, and the text's length and whether it is a clock time. Numbers and moments
    are known by their value (xxhash64 of eight bytes maps no two to one), other cells by two hashes of the text."""
    whole, real, moment, text = (F.col(slot) for slot in _SLOTS)
    usual = (moment >= F.lit(_FIRST_DAY).cast("timestamp_ntz")) & (moment < F.lit(_LAST_DAY).cast("timestamp_ntz"))
    split = F.unix_micros(moment.cast("timestamp")) % 1_000_000 != 0
    told = cells.select(
        "place",
        "whole",
        "real",
        F.when(usual, moment).alias("moment"),
        F.when(usual, F.when(split, 26).otherwise(19)).alias("moment_width"),
        F.coalesce(_stripped(text), F.when(~usual, canonical_string(moment, T.TimestampNTZType()))).alias("text"),
        F.length(canonical_string(real, T.DoubleType())).alias("real_width"),
    )
    value = F.when(whole.isNotNull(), whole).when(real.isNotNull(), F.xxhash64(real)).when(moment.isNotNull(), F.xxhash64(moment))
    # the hash is blind to the sign of zero, the text is not
    other = F.when(text.isNotNull(), F.xxhash64(F.lit(1), text)).when(real == 0, F.col("real_width")).otherwise(0)
    clock = text.isNotNull() & text.contains(":") & text.rlike(rf"\A(?:{CLOCK_TEXT})\z")
    return told.where(F.coalesce(text != "", whole.isNotNull() | real.isNotNull() | moment.isNotNull())).select(
        "place",
        value.otherwise(F.xxhash64(text)).alias("v"),
        other.cast("bigint").alias("w"),
        F.coalesce(F.length(whole.cast("string")), "real_width", "moment_width", F.length(text)).alias("width"),
        clock.cast("int").alias("clock"),
    )


def _name_of(names: Sequence[str]) -> Column:
    return F.element_at(F.lit(list(names)), F.col("place") + 1)


def value_frequencies(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, value, n). Equal cells combine map-side before the shuffle."""
    names = list(columns or df.columns)
    counted = unpivot(df, names).groupBy("place", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(_name_of(names).alias("column_name"), "value", "n")


def half_even_sqrt(n: Column) -> Column:
    return F.bround(F.sqrt(n)).cast("bigint")


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column of a table; see ``profile_tables``."""
    chosen = df.select(*[quoted(c) for c in columns]) if columns else df
    return profile_tables({"": chosen}).drop("table_name")


def profile_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table and column, also for empty columns: counts, ratios, average
    length, and the category tests. All tables share the same two aggregations; values
    travel as numbers or digests."""
    places, parts = [], []
    for name, df in tables.items():
        keyed = _keyed(_cells(df, df.columns)).withColumn("place", F.col("place") + len(places))
        parts.append(keyed)
        places += [(len(places) + i, name, column) for i, column in enumerate(df.columns)]
    cells = reduce(DataFrame.unionByName, parts)
    frequencies = cells.groupBy("place", "v", "w").agg(
        F.count(F.lit(1)).alias("n"), F.max("width").alias("width"), F.max("clock").alias("clock")
    )
    n = F.col("n")
    measured = frequencies.groupBy("place").agg(
        F.sum(n).alias("non_null_count"),
        F.count(F.lit(1)).alias("unique_count"),
        F.max(n).alias("top_count"),
        F.min(n).alias("least_count"),
        F.coalesce(F.sum(F.when(n < 5, n)), F.lit(0)).alias("rare_count"),
        F.sum(n * F.col("width")).alias("characters"),
        F.sum(n * F.col("clock")).alias("clock_count"),
    )
    spark = cells.sparkSession
    every = spark.createDataFrame(places, "place int, table_name string, column_name string")
    counts = [c for c in measured.columns if c != "place"]
    filled = every.join(measured, "place", "left").na.fill(0, counts)

    total, unique = F.col("non_null_count"), F.col("unique_count")

    def share(part: Column) -> Column:
        return F.when(total > 0, part / total).otherwise(F.lit(0.0))

    profile = filled.select(
        "table_name",
        "column_name",
        "non_null_count",
        "unique_count",
        share(unique).alias("unique_ratio"),
        share(F.col("top_count")).alias("top_value_ratio"),
        share(F.col("rare_count")).alias("rare_value_ratio"),
        share(F.col("characters")).alias("average_text_length"),
        share(F.col("clock_count")).alias("time_like_share"),
        "least_count",
    )
    return profile.withColumns(
        {"is_category_candidate": category_candidate(), "is_safe_category": safe_category()}
    )


def category_candidate() -> Column:
    """Few enough distinct values for a category, over the columns of a profile."""
    n, unique = F.col("non_null_count"), F.col("unique_count")
    most = F.least(F.lit(100), F.greatest(F.lit(20), half_even_sqrt(n)))
    few_rows = unique <= F.greatest(F.lit(2), F.floor(n / 3))
    return (
        F.when((n == 0) | (unique == 0), False)
        .when(unique == 1, True)
        .when(unique > most, False)
        .when(n < 50, few_rows)
        .otherwise(F.col("unique_ratio") <= 0.20)
    )


def safe_category() -> Column:
    """Low cardinality and no rare value, so that a value singles nobody out."""
    n, unique = F.col("non_null_count"), F.col("unique_count")
    most = F.least(F.lit(64), F.greatest(F.lit(12), F.floor(n / 2)))
    least = F.greatest(F.lit(2), F.floor(n * 0.01))
    return (n >= 2) & unique.between(2, most) & (F.col("least_count") >= least)
