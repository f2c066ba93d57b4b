"""Size and content digest of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_string, quoted


def row_digest(df: DataFrame) -> Column:
    """60-bit digest of a row's canonical text; null differs from the empty string."""
    cells = [
        F.coalesce(
            F.concat(F.lit("="), canonical_string(quoted(c), df.schema[c].dataType)), F.lit("-")
        )
        for c in df.columns
    ]
    digest = F.sha2(F.concat_ws("\x1f", *cells), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)")


def table_metadata(df: DataFrame, name: str) -> DataFrame:
    """(table_name, row_count, column_count, digest); the digest ignores row order and files."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(row_digest(df)), F.lit(0)).cast("string").alias("digest"),
    ).select(
        F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("column_count"),
        "digest",
    )
