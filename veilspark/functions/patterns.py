"""Rules for personal data and secrets, in priority order.

A word boundary is written out over letters, digits and ``_`` of every script, because
the built-in one treats a combining mark next to a word differently.
"""

from __future__ import annotations

from .checks import ip_valid, luhn_valid, thai_id_valid
from .spans import SpanRule

_W = r"[\p{L}\p{N}_]"
_NOT_AFTER_DIGIT = r"(?<!\p{Nd})"
_NOT_BEFORE_DIGIT = r"(?!\p{Nd})"

# Nine digits with at most one sign between two, or a point between two.
_DIGITS = r"\p{Nd}(?:\.\p{Nd}|(?:[ -]?\p{Nd}){8})"

# Kinds, patterns and their priority order.
PII_RULES = (
    SpanRule(
        "EMAIL",
        rf"(?:(?<!{_W})[A-Za-z0-9_]|(?<={_W})[.%+-])[A-Za-z0-9._%+-]*"
        rf"@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}(?!{_W})",
        hints=("@",),
    ),
    SpanRule(
        "PHONE",
        rf"{_NOT_AFTER_DIGIT}(?:\+?66|0)\p{{Nd}}{{1,2}}[- ]?\p{{Nd}}{{3}}[- ]?\p{{Nd}}{{4}}{_NOT_BEFORE_DIGIT}",
        guard=_DIGITS,
    ),
    SpanRule("THAI_ID", rf"{_NOT_AFTER_DIGIT}\p{{Nd}}{{13}}{_NOT_BEFORE_DIGIT}", valid=thai_id_valid, guard=_DIGITS),
    SpanRule(
        "CREDIT_CARD",
        rf"{_NOT_AFTER_DIGIT}(?:\p{{Nd}}[ -]?){{13,19}}{_NOT_BEFORE_DIGIT}",
        valid=luhn_valid,
        guard=_DIGITS,
    ),
    SpanRule(
        "IP_ADDRESS",
        rf"(?<!{_W})(?:\p{{Nd}}{{1,3}}\.){{3}}\p{{Nd}}{{1,3}}(?!{_W})",
        hints=(".",),
        valid=ip_valid,
        guard=_DIGITS,
    ),
)

# The loose card pattern takes a number beside a card into one match, which then fails its check or
# eats into an address: "61.64.53.61 4080166431094600". A card in one piece claims its digits first;
# one in the usual groups, where the loose match left them.
_CARD_IN_ONE = SpanRule(
    "CREDIT_CARD",
    rf"{_NOT_AFTER_DIGIT}\p{{Nd}}{{13,19}}[ -]?{_NOT_BEFORE_DIGIT}",
    valid=luhn_valid,
    covered=True,
)
_CARD_IN_GROUPS = SpanRule(
    "CREDIT_CARD",
    rf"{_NOT_AFTER_DIGIT}\p{{Nd}}{{4}}[ -](?:\p{{Nd}}{{4}}[ -]\p{{Nd}}{{4}}[ -]\p{{Nd}}{{4}}|\p{{Nd}}{{6}}[ -]\p{{Nd}}{{5}})"
    rf"[ -]?{_NOT_BEFORE_DIGIT}",
    valid=luhn_valid,
    covered=True,
)
TEXT_RULES = (*PII_RULES[:3], _CARD_IN_ONE, *PII_RULES[3:], _CARD_IN_GROUPS)

# Public token formats. A dropped secret reads [DROPPED_SECRET], whichever rule found it.
# What may follow an anchor is bounded, or ends where the next anchor can begin, so that a text
# of any length and make is read in time proportional to its length.
SECRET_RULES = (
    SpanRule(  # a block without its end line runs to the end of the text
        "PRIVATE_KEY",
        r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"
        r"(?:[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY-----|[\s\S]*)",
        hints=("PRIVATE KEY-----",),
    ),
    SpanRule(
        "CREDENTIAL_URL",
        r"[A-Za-z][A-Za-z0-9+.-]{0,30}+://[^\s/:@]++:[^\s/@]++@[^\s\"'<>]+",
        hints=("://",),
    ),
    SpanRule(
        "JWT",
        r"eyJ[A-Za-z0-9_-]{8,1000}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}",
        hints=("eyJ",),
    ),
    SpanRule(
        "GITHUB_TOKEN",
        r"(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})",
        hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"),
    ),
    SpanRule("SLACK_TOKEN", r"(?:xox[abeprs]|xapp)-[A-Za-z0-9-]{10,}", hints=("xox", "xapp-")),
    SpanRule(
        "AWS_KEY",
        r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
        hints=("AKIA", "ASIA"),
    ),
    SpanRule("BEARER", r"(?i)bearer\s++[A-Za-z0-9._~+/-]{16,}=*", words=("bearer",)),
    SpanRule(
        "BASIC",
        r"(?i)authorization[\"']?\s*+[:=]\s*+[\"']?basic\s++[A-Za-z0-9+/_-]{8,}={0,2}",
        hints=("=", ":"),
        words=("basic",),
    ),
    SpanRule(  # the name may go on after the word, as in aws_secret_access_key
        "ASSIGNMENT",
        r"(?i)(?:api[_-]?key|token|secret|password|passwd|pwd|connection[_-]?string)[A-Za-z0-9_-]{0,40}+"
        r"[\"']?\s*+[:=]\s*+(?:\"[^\"\r\n]{6,}+\"|'[^'\r\n]{6,}+'|[^\s\"',;<>]{6,})",
        hints=("=", ":"),
        words=("key", "token", "secret", "passw", "pwd", "connection"),
    ),
)

SECRET_LABEL = "[DROPPED_SECRET]"

# Column names that mark a secret, after normalization.
SECRET_COLUMN_NAMES = (
    "api_key",
    "apikey",
    "access_key",
    "secret",
    "secret_key",
    "client_secret",
    "password",
    "passwd",
    "private_key",
    "connection_string",
    "access_token",
    "refresh_token",
    "auth_token",
)
