"""Native validators for digit strings found by a pattern."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_digits


def _digits(value: Column) -> Column:
    return F.regexp_replace(ascii_digits(value), r"[^0-9]", "")


def luhn_valid(value: Column) -> Column:
    digits = _digits(value)
    return (
        F.length(digits).between(13, 19)
        & ~digits.rlike(r"^(\d)\1*$")
        & F.call_function("luhn_check", digits)
    )


def thai_id_valid(value: Column) -> Column:
    digits = _digits(value)
    weighted = sum(
        (F.substring(digits, i + 1, 1).cast("int") * (13 - i) for i in range(12)), F.lit(0)
    )
    expected = (F.lit(11) - weighted % 11) % 10
    return F.when(
        (F.length(digits) == 13) & ~digits.rlike(r"^(\d)\1*$"),
        F.substring(digits, 13, 1).cast("int") == expected,
    ).otherwise(False)


def ip_valid(value: Column) -> Column:
    """Four dot-separated numbers, each 0 to 255."""
    octets = F.split(ascii_digits(value), r"\.", -1)
    return (F.size(octets) == 4) & F.forall(
        octets,
        lambda octet: octet.rlike(r"^[0-9]+$")
        & F.coalesce(octet.try_cast("decimal(38,0)") <= 255, F.lit(False)),
    )
