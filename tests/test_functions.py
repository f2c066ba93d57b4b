"""Native expressions against plain-Python formulas."""

import base64
import hashlib
import hmac
import random
import unicodedata

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions.checks import ip_valid, luhn_valid, thai_id_valid
from veilspark.functions.dates import parse_date
from veilspark.functions.hashing import keyed_offset, token_for
from veilspark.functions.numbers import bucket_label, coerce_numeric, seconds_of_day
from veilspark.functions.text import canonical_string, is_missing, normalized_string
from veilspark.operators.actions import hash_id, tokenize

STRING = T.StringType()


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def test_sub_keys_follow_rfc5869(key):
    extracted = hmac.new(b"veilspark:v1", bytes(range(32)), hashlib.sha256).digest()
    expected = hmac.new(extracted, b"id_hash\x01", hashlib.sha256).digest()
    assert key.sub_key("id_hash") == expected
    assert key.sub_key("tokenization") != expected
    with pytest.raises(ValueError):
        key.sub_key("other")


def test_token_is_base32_of_truncated_hmac(spark, key):
    values = ["C-001", "é สวัสดี", "x" * 500, " padded "]

    def expected(value):
        digest = hmac.new(key.sub_key("tokenization"), b"EMAIL\0" + value.encode(), hashlib.sha256)
        return "EMAIL_" + base64.b32encode(digest.digest()[:10]).decode()

    assert column(spark, values, lambda v: token_for(key, "email", v)) == [expected(v) for v in values]


def test_tokenize_keeps_missing_and_separates_types(spark, key):
    out = column(spark, ["a", None, "  ", "a"], lambda v: tokenize(v, STRING, "PERSON", key))
    assert out[0] == out[3] and out[1] is None and out[2] is None
    other = column(spark, ["a"], lambda v: tokenize(v, STRING, "EMAIL", key))
    assert other[0].split("_")[1] != out[0].split("_")[1]


def test_hash_normalizes_and_never_returns_null(spark, key):
    composed, decomposed = "é", unicodedata.normalize("NFD", "é")
    out = column(spark, [composed, f" {decomposed} ", None, "", "Ａ1", "A1"], lambda v: hash_id(v, STRING, key))
    assert out[0] == out[1] and out[2] == out[3] and out[4] == out[5]
    digest = hmac.new(key.sub_key("id_hash"), b"", hashlib.sha256).hexdigest()
    assert out[2] == "HASH_" + digest[:24]


def test_keyed_offset_matches_formula(spark, key):
    subjects = [f"S{i}" for i in range(200)] + ["ลูกค้า"]

    def expected(subject, direction):
        message = b"v1\0project\0" + subject.encode()
        choice = int.from_bytes(
            hmac.new(key.sub_key("date_shift"), message, hashlib.sha256).digest()[:8], "big"
        )
        width = 30
        size = 1 + choice % width
        if direction == "both":
            return size if (choice // width) % 2 else -size
        return size if direction == "forward" else -size

    for direction in ("both", "forward", "backward"):
        out = column(
            spark, subjects, lambda v: keyed_offset(key, "date_shift", v, 1, 30, direction)
        )
        assert out == [expected(s, direction) for s in subjects]


def test_canonical_doubles_read_like_python(spark):
    values = [0.0, 1.0, -2.5, 1e7, 12345678.9, 1e15, 1e16, 1.5e17, 1e-3, 0.00012, 1e-5, 1.25e-7,
              float("nan"), float("inf"), float("-inf"), 123456789012345.6, 1e22, 3.3e-10, 1e-300]
    out = column(spark, values, lambda v: canonical_string(v, T.DoubleType()), "double")
    assert out == [str(v) for v in values]


def test_missing_is_null_nan_or_any_unicode_blank(spark):
    assert column(spark, [None, "", " \t　\x1c", "x"], lambda v: is_missing(v, STRING)) == [
        True, True, True, False,
    ]
    assert column(spark, [None, float("nan"), 0.0], lambda v: is_missing(v, T.DoubleType()), "double") == [
        True, True, False,
    ]


def test_normalized_string_equals_python(spark):
    values = ["  a ", "ﬁ", "é", "　全角ＡＢ　", "plain"]
    expected = [unicodedata.normalize("NFKC", v).strip() for v in values]
    assert column(spark, values, lambda v: normalized_string(v, STRING)) == expected


def _luhn(text):
    digits = [int(unicodedata.decimal(c)) for c in text if c.isdecimal()]
    if not 13 <= len(digits) <= 19 or len(set(digits)) == 1:
        return False
    total = 0
    for place, digit in enumerate(reversed(digits)):
        total += digit if place % 2 == 0 else sum(divmod(2 * digit, 10))
    return total % 10 == 0


def test_checksums_against_formulas(spark):
    rng = random.Random(7)
    numbers = ["".join(rng.choice("0123456789") for _ in range(rng.randint(12, 20))) for _ in range(2000)]
    numbers += ["0" * 16, "4111 1111-1111 1111 ", "๔๑๑๑๑๑๑๑๑๑๑๑๑๑๑๑"]
    assert column(spark, numbers, luhn_valid) == [_luhn(n) for n in numbers]

    def thai(text):
        if len(text) != 13 or len(set(text)) == 1:
            return False
        total = sum(int(text[i]) * (13 - i) for i in range(12))
        return (11 - total % 11) % 10 == int(text[12])

    ids = ["".join(rng.choice("0123456789") for _ in range(13)) for _ in range(2000)] + ["1" * 13]
    assert column(spark, ids, thai_id_valid) == [thai(n) for n in ids]
    ips = ["1.2.3.4", "255.255.255.255", "256.1.1.1", "1.2.3", "1.2.3.4.5", "01.002.3.4", "a.b.c.d"]
    assert column(spark, ips, ip_valid) == [True, True, False, False, False, True, False]


def test_bucket_edges_and_odd_numbers(spark):
    rules = [[None, 0, "NEG"], [0, 10, "LOW"], [10, None, "HIGH"]]
    values = ["-0.01", "0", "9.999", "10", " 12 ", "1_000", "1e3", "inf", "-inf", "nan", "", None, "12d", "x"]
    unknown = "AMOUNT_BUCKET_UNKNOWN"
    assert column(spark, values, lambda v: bucket_label(v, STRING, rules)) == [
        "NEG", "LOW", "LOW", "HIGH", "HIGH", "HIGH", "HIGH", "HIGH", "NEG", unknown, unknown, unknown,
        unknown, unknown,
    ]
    doubles = [float("nan"), None, -5.0, 0.0]
    assert column(spark, doubles, lambda v: bucket_label(v, T.DoubleType(), rules), "double") == [
        unknown, unknown, "NEG", "LOW",
    ]


def test_coerce_numeric_formats(spark):
    values = ["1,200.50", "THB 2,400.00", "(300.00)", "-", "$5", "1 000 บาท", "usd 1e3", "(-7)", ".5", "5.", "abc",
              None, "฿ 12", "USDX 3"]
    assert column(spark, values, lambda v: coerce_numeric(v, STRING)) == [
        1200.5, 2400.0, -300.0, None, 5.0, 1000.0, 1000.0, None, 0.5, 5.0, None, None, 12.0, None,
    ]


def test_seconds_of_day(spark):
    values = ["8:05", "08:05:09.25", " 23:59:59 ", "24:00", "7:60", "1:2", "x", "๐๘:๐๕"]
    assert column(spark, values, lambda v: seconds_of_day(v, STRING)) == [
        29100, 29109, 86399, None, None, None, None, 29100,
    ]
    fractions = [0.0, 0.5, 0.99999999, 1.0, -0.1, float("nan")]
    assert column(spark, fractions, lambda v: seconds_of_day(v, T.DoubleType()), "double") == [
        0, 43200, 0, None, None, None,
    ]


def test_parse_date_formats(spark):
    values = ["2026-07-20", "2026-07-20 10:15:00", "2026-07-20T10:15:00Z", "2026/7/2", "20260720", "07/20/2026",
              "20 Jul 2026", "july 20, 2026", "2026-13-01", "garbage", "", None]
    out = column(spark, values, lambda v: parse_date(v, STRING))
    assert [str(d) if d else None for d in out] == [
        "2026-07-20", "2026-07-20", "2026-07-20", "2026-07-02", "2026-07-20", "2026-07-20", "2026-07-20",
        "2026-07-20", None, None, None, None,
    ]
    nanos = column(spark, [0, 86_400_000_000_000, -1], lambda v: parse_date(v, T.LongType()), "bigint")
    assert [str(d) for d in nanos] == ["1970-01-01", "1970-01-02", "1969-12-31"]
