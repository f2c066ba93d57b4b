"""Number clean-up, buckets and clock arithmetic as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import ascii_digits, canonical_string, let, strip

# Currency words and signs that may stand in an amount.
CURRENCY_WORDS = ("THB", "USD", "EUR", "GBP", "JPY", "BAHT")
THAI_BAHT_WORD = "บาท"
CURRENCY_SIGNS = "$฿€£¥"

BUCKET_UNKNOWN = "AMOUNT_BUCKET_UNKNOWN"

_NUMBER = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?"
_UNDERSCORED = r"\d+(?:_\d+)*"
_FLOAT_TEXT = (
    rf"[+-]?(?:{_UNDERSCORED}(?:\.(?:{_UNDERSCORED})?)?|\.{_UNDERSCORED})"
    rf"(?:[eE][+-]?{_UNDERSCORED})?"
)
_CLOCK = r"\A(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d+)?)?\z"
_WORD_EDGE = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def coerce_numeric(value: Column, dtype: T.DataType) -> Column:
    """Double of a number or of a formatted amount such as ``THB (1,234.50)``; else null."""
    if is_number(dtype):
        number = value.cast("double")
        return F.when(~F.isnan(number), number)
    raw = strip(canonical_string(value, dtype))
    negative = raw.rlike(r"\A\(.*\)\z")
    text = F.regexp_replace(raw, r"\A\((.*)\)\z", "-$1")
    text = F.regexp_replace(
        text, rf"(?i){_WORD_EDGE}(?:{'|'.join(CURRENCY_WORDS)}){_WORD_EDGE}", ""
    )
    text = F.replace(text, F.lit(THAI_BAHT_WORD), F.lit(""))
    text = F.translate(text, "," + CURRENCY_SIGNS, "")
    text = ascii_digits(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]", ""))
    number = F.when(text.rlike(rf"\A{_NUMBER}\z"), text.try_cast("double"))
    return F.when(negative, -F.abs(number)).otherwise(number)


def float_of(value: Column, dtype: T.DataType) -> Column:
    """Strict float parse of a value: digits with ``_`` separators, inf and nan words."""
    if is_number(dtype):
        return value.cast("double")
    text = ascii_digits(strip(canonical_string(value, dtype)))
    return (
        F.when(
            text.rlike(rf"\A{_FLOAT_TEXT}\z"), F.translate(text, "_", "").try_cast("double")
        )
        .when(text.rlike(r"(?i)\A\+?inf(inity)?\z"), F.lit(float("inf")))
        .when(text.rlike(r"(?i)\A-inf(inity)?\z"), F.lit(float("-inf")))
        .when(text.rlike(r"(?i)\A[+-]?nan\z"), F.lit(float("nan")))
    )


def bucket_label(value: Column, dtype: T.DataType, rules: list) -> Column:
    """First ``[low, high, label]`` with low <= x < high; an open end is None."""
    number = float_of(value, dtype)
    label = F.when(number.isNull(), F.lit(BUCKET_UNKNOWN))
    for low, high, name in rules:
        inside = F.lit(True)
        if low is not None or high is not None:
            inside = ~F.isnan(number)  # Spark orders NaN above every number
        if low is not None:
            inside = inside & (number >= float(low))
        if high is not None:
            inside = inside & (number < float(high))
        label = label.when(inside, F.lit(str(name)))
    return label.otherwise(F.lit(BUCKET_UNKNOWN))


def seconds_of_day(value: Column, dtype: T.DataType) -> Column:
    """Seconds since midnight of a day fraction in [0, 1) or of ``H:MM[:SS[.f]]``; else null."""
    if isinstance(dtype, T.NumericType):
        fraction = value.cast("double")
        return F.when(
            ~F.isnan(fraction) & (fraction >= 0) & (fraction < 1),
            (F.bround(fraction * 86400) % 86400).cast("int"),
        )

    def parse(text: Column) -> Column:
        def field(i: int) -> Column:
            part = F.substring(F.split_part(text, F.lit(":"), F.lit(i)), 1, 2)
            return F.coalesce(part.try_cast("int"), F.lit(0))

        return F.when(text.rlike(_CLOCK), field(1) * 3600 + field(2) * 60 + field(3))

    return let(ascii_digits(strip(canonical_string(value, dtype))), parse)
