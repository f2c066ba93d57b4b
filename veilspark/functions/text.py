"""Scalar text helpers: all native expressions, except NFKC of non-ASCII strings."""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ALL = [chr(code) for code in range(sys.maxunicode + 1)]
WHITESPACE = "".join(c for c in _ALL if c.isspace())
_DIGITS = "".join(c for c in _ALL if c.isdecimal() and not c.isascii())
_DIGIT_VALUES = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)
del _ALL


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    A lambda variable is the one way to share a sub-expression inside a single
    Column; without it nested text rules would inline their input exponentially.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def quoted(name: str) -> Column:
    """Column by exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def ascii_digits(value: Column) -> Column:
    """Every decimal digit of any script as 0-9."""
    return F.translate(value, _DIGITS, _DIGIT_VALUES)


def is_blank(value: Column) -> Column:
    return F.ltrim(value, F.lit(WHITESPACE)) == ""


def fold_case(value: Column) -> Column:
    return F.lower(F.upper(value))


def is_ascii(value: Column) -> Column:
    return F.octet_length(value) == F.length(value)


def _double_string(value: Column) -> Column:
    """Shortest decimal form; plain digits for 1e-4 <= |x| < 1e16, else ``1e+16`` style.
    Denormal numbers keep the digits Java prints (4.9e-324)."""
    text = value.cast("string")
    plain = F.regexp_replace(
        F.regexp_replace(text.cast("decimal(38,20)").cast("string"), r"0+$", ""), r"\.$", ".0"
    )
    exponent = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), r"E-(\d)$", "e-0$1"), r"E(\d)", "e+$1"
    )
    size = F.abs(value)
    usual = ((size >= 1e-3) & (size < 1e7)) | (value == 0)
    return (
        F.when(usual, text)
        .when(F.isnan(value), F.lit("nan"))
        .when(size == float("inf"), F.when(value > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(F.lower(exponent))
    )


def canonical_string(value: Column, dtype: T.DataType) -> Column:
    """The text a value stands for when it is scanned, hashed or tokenized."""
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return value
    if isinstance(dtype, T.BooleanType):
        return F.initcap(value.cast("string"))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return _double_string(value)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        text = value.cast("string")  # a fraction without its trailing zeros, if any
        return F.when(text.contains("."), F.rpad(text, 26, "0")).otherwise(text)
    if isinstance(dtype, T.BinaryType):
        return F.base64(value)
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value)
    return value.cast("string")


def is_missing(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return value.isNull() | F.isnan(value)
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return value.isNull() | is_blank(value)
    return value.isNull()


@F.pandas_udf(T.StringType())
def _nfkc_strip(values: pd.Series) -> pd.Series:
    return values.str.normalize("NFKC").str.strip()


def normalized_string(value: Column, dtype: T.DataType, ascii_only: bool = False) -> Column:
    """strip(NFKC(text)). Non-strings and ``ascii_only`` columns stay native; the
    Arrow UDF sees nulls for the ASCII rows of the others and so does no work there."""
    text = canonical_string(value, dtype)
    if ascii_only or not isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return strip(text)
    return F.when(is_ascii(text), strip(text)).otherwise(
        _nfkc_strip(F.when(~is_ascii(text), text))
    )
