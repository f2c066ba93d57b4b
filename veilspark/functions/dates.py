"""Date parsing as an ordered list of formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbers import is_integral
from .text import canonical_string, strip

# (shape of the text, Spark pattern). Month comes first in slashed dates.
DATE_SHAPES = (
    (r"\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"),
    (r"\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d"),
    (r"\d{8}", "yyyyMMdd"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"),
    (r"\d{1,2}-\d{1,2}-\d{4}", "M-d-yyyy"),
    (r"(?i)\d{1,2} [a-z]{3} \d{4}", "d MMM yyyy"),
    (r"(?i)\d{1,2}-[a-z]{3}-\d{4}", "d-MMM-yyyy"),
    (r"(?i)\d{1,2} [a-z]{4,} \d{4}", "d MMMM yyyy"),
    (r"(?i)[a-z]{3} \d{1,2}, \d{4}", "MMM d, yyyy"),
    (r"(?i)[a-z]{4,} \d{1,2}, \d{4}", "MMMM d, yyyy"),
)
_CLOCK_SUFFIX = r"[T ]([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,9})?)?( ?(Z|[+-]\d{2}:?\d{2}))?$"


def parse_date(value: Column, dtype: T.DataType) -> Column:
    """Calendar date of a value, or null. Integers count nanoseconds since 1970."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return value.cast("date")
    if isinstance(dtype, T.NumericType) and not isinstance(dtype, T.BooleanType):
        nanos = value if is_integral(dtype) else F.when(~F.isnan(value.cast("double")), value)
        days = F.floor(nanos / F.lit(86_400_000_000_000)).cast("int")
        return F.date_add(F.lit("1970-01-01").cast("date"), days)
    text = F.regexp_replace(strip(canonical_string(value, dtype)), _CLOCK_SUFFIX, "")
    # try_to_timestamp wants month names capitalised
    text = F.initcap(text)
    parsed = F.lit(None).cast("date")
    for shape, pattern in reversed(DATE_SHAPES):
        parsed = F.when(
            text.rlike(rf"\A{shape}\z"), F.try_to_timestamp(text, F.lit(pattern)).cast("date")
        ).otherwise(parsed)
    return parsed
