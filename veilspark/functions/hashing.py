"""Keyed hashing as native expressions (no Python worker)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..keys import ProjectKey
from .text import let

_CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
# RFC 4648 base32 alphabet.
BASE32_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_TOKEN_TYPE = re.compile(r"[A-Z][A-Z0-9_]{0,63}")


def safe_label(name: str, what: str = "token_type") -> str:
    label = name.strip().upper().replace(" ", "_")
    if not _TOKEN_TYPE.fullmatch(label):
        raise ValueError(f"{what} must be a safe uppercase identifier")
    return label


def hmac_hex(key: ProjectKey, purpose: str, message: Column) -> Column:
    """Hex HMAC-SHA256 of a binary message under the sub-key of ``purpose``."""
    inner, outer = key.pads(purpose)
    digest = F.unhex(F.sha2(F.concat(F.lit(inner), message), 256))
    return F.sha2(F.concat(F.lit(outer), digest), 256)


def base32_of_hex(digits: Column) -> Column:
    """Base32 of 20 hex digits (80 bits): two 40-bit halves of eight symbols each."""

    def half(start: int) -> Column:
        return F.lpad(F.conv(F.substring(digits, start, 10), 16, 32), 8, "0")

    return F.translate(F.concat(half(1), half(11)), _CONV_DIGITS, BASE32_ALPHABET)


def token_for(key: ProjectKey, token_type: str, text: Column) -> Column:
    """``TYPE_`` + 16 base32 symbols; equal text and type give an equal token anywhere."""
    label = safe_label(token_type)
    message = F.concat(F.lit(label.encode() + b"\0"), text.cast("binary"))
    digest = hmac_hex(key, "tokenization", message)
    return F.concat(F.lit(label + "_"), base32_of_hex(F.substring(digest, 1, 20)))


def identifier_hash(key: ProjectKey, text: Column) -> Column:
    digest = hmac_hex(key, "id_hash", F.coalesce(text, F.lit("")).cast("binary"))
    return F.concat(F.lit("HASH_"), F.substring(digest, 1, 24))


def keyed_offset(
    key: ProjectKey, purpose: str, subject: Column, low: int, high: int, direction: str
) -> Column:
    """Stable offset of a subject in ``low..high`` days or minutes, signed by direction."""
    prefix = b"v1\0" + key.project_id.encode() + b"\0"
    digest = hmac_hex(key, purpose, F.concat(F.lit(prefix), subject.cast("binary")))
    choice = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    width = high - low + 1
    # the magnitude is low + choice mod width; the sign, where it varies, is the parity
    # of choice div width: both follow from choice mod 2*width
    turn = (choice % F.lit(2 * width).cast("decimal(20,0)")).cast("int")
    if direction != "both":
        turn = (choice % F.lit(width).cast("decimal(20,0)")).cast("int")
        return low + turn if direction == "forward" else -(low + turn)
    # bound once, so that the digest is computed once wherever this stands
    return let(turn, lambda t: F.when(t >= width, low + t - width).otherwise(-(low + t)))
