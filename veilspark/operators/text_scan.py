"""Free-text redaction: secrets, then personal data, then entities, then recognizers.

Each step works on the text the step before it left. Steps are separate projections,
so the optimizer keeps one evaluation of each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import token_for
from ..functions.patterns import SECRET_LABEL, SECRET_RULES, TEXT_RULES
from ..functions.spans import (
    SpanRule,
    count_by_line,
    count_spans,
    find_spans,
    replace_by_line,
    replace_spans,
    span_text,
)
from ..functions.text import canonical_string, is_missing, quoted
from ..keys import ProjectKey
from ..policy import Recognizer

EntityFinder = Callable[[str], list[tuple[int, int, str]]]


class EntityDetector:
    """A user's entity model. ``load`` runs once per Python worker and returns a
    function ``text -> [(start, end, entity)]``."""

    def load(self) -> EntityFinder:
        raise NotImplementedError


def entity_redactor(detector: EntityDetector):
    """Arrow UDF ``text -> (text with [REDACTED_<ENTITY>], number of entities)``."""

    @F.pandas_udf("text string, n int")
    def redact(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        find = detector.load()

        def one(text: str | None) -> tuple[str | None, int]:
            if text is None:
                return None, 0
            found = sorted(find(text), reverse=True)
            for start, end, entity in found:
                text = f"{text[:start]}[REDACTED_{entity}]{text[end:]}"
            return text, len(found)

        for batch in batches:
            yield pd.DataFrame([one(text) for text in batch], columns=["text", "n"])

    return redact


def secret_label(kind: Column, match: Column) -> Column:
    return F.lit(SECRET_LABEL)


def pii_label(kind: Column, match: Column) -> Column:
    return F.concat(F.lit("[REDACTED_"), kind, F.lit("]"))


def without_secrets(text: Column) -> Column:
    return replace_spans(text, find_spans(text, SECRET_RULES), secret_label)


def pii_findings(text: Column) -> Column:
    return find_spans(text, TEXT_RULES)


def count_secrets(text: Column) -> Column:
    return count_spans(text, SECRET_RULES)


def count_pii(text: Column) -> Column:
    return count_by_line(text, TEXT_RULES)


def recognizer_rules(recognizers: Sequence[Recognizer]) -> list[SpanRule]:
    return [SpanRule(r.name, r.pattern, valid=r.validator) for r in recognizers]


def _callback(check: Callable[[str], bool]):
    @F.pandas_udf("array<boolean>")
    def run(matches: pd.Series) -> pd.Series:
        return matches.map(lambda found: None if found is None else [bool(check(m)) for m in found])

    return run


def callback_flags(text: Column, recognizers: Sequence[Recognizer]) -> dict[str, Column]:
    """One boolean per match of each recognizer that has a Python validator."""
    return {
        r.name: _callback(r.python_validator)(
            F.when(text.rlike(r.pattern), F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0)))
        )
        for r in recognizers
        if r.python_validator is not None
    }


def with_flags(
    df: DataFrame, text: Column, recognizers: Sequence[Recognizer], prefix: str
) -> tuple[DataFrame, dict[str, Column]]:
    """Callback results as columns of their own: a Python function cannot run inside the
    lambda functions that walk the spans."""
    flags = callback_flags(text, recognizers)
    if not flags:
        return df, {}
    df = df.withColumns({f"{prefix}__flags_{kind}": flag for kind, flag in flags.items()})
    return df, {kind: F.col(f"`{prefix}__flags_{kind}`") for kind in flags}


def count_recognized(
    text: Column, recognizers: Sequence[Recognizer], flags: dict[str, Column]
) -> Column:
    if not recognizers:
        return F.lit(0)
    return F.size(find_spans(text, recognizer_rules(recognizers), flags))


def recognizer_label(recognizers: Sequence[Recognizer], key: ProjectKey):
    """Replacement of a recognized span: a token, a marker, or the text itself."""

    def label(kind: Column, match: Column) -> Column:
        chosen = match  # keep
        for r in recognizers:
            if r.action == "tokenize":
                chosen = F.when(kind == r.name, token_for(key, r.name, match)).otherwise(chosen)
            elif r.action in ("drop", "redact"):
                verb = "DROPPED" if r.action == "drop" else "REDACTED"
                chosen = F.when(kind == r.name, F.lit(f"[{verb}_{r.name}]")).otherwise(chosen)
        return chosen

    return label


def minted_tokens(
    text: Column, spans: Column, recognizers: Sequence[Recognizer], key: ProjectKey
) -> Column:
    """(token, token_type, original) of every span a recognizer tokenized."""
    label = recognizer_label(recognizers, key)
    names = [r.name for r in recognizers if r.action == "tokenize"]
    return F.transform(
        F.filter(spans, lambda s: s["kind"].isin(names)),
        lambda s: F.struct(
            label(s["kind"], span_text(text, s)).alias("token"),
            s["kind"].alias("token_type"),
            span_text(text, s).alias("original"),
        ),
    )


TOKENS = "array<struct<token:string,token_type:string,original:string>>"


def scan_text(
    df: DataFrame,
    column: str,
    out: str,
    key: ProjectKey,
    recognizers: Sequence[Recognizer] = (),
    detector: EntityDetector | None = None,
) -> DataFrame:
    """Add ``out``: struct(safe, secrets, pii, entities, kinds, tokens) of a text column.
    A missing text has a null ``safe`` and no findings."""
    dtype = df.schema[column].dataType
    value = quoted(column)
    temporary: list[str] = []

    def stage(name: str, column: Column) -> Column:
        nonlocal df
        temporary.append(f"{out}__{name}")
        df = df.withColumn(temporary[-1], column)
        return F.col(temporary[-1])

    raw = stage("raw", F.when(~is_missing(value, dtype), canonical_string(value, dtype)))
    secrets = stage("secrets", find_spans(raw, SECRET_RULES))
    clean = stage("clean", replace_spans(raw, secrets, secret_label))
    pii = stage("pii", replace_by_line(clean, TEXT_RULES, pii_label))
    text = stage("text", F.coalesce(pii["text"], clean))
    entities = F.lit(0)
    if detector is not None:
        # used twice, the text stays a projection of its own below the Python step
        given = F.when(text.isNotNull(), text)
        redacted = stage("entities", entity_redactor(detector)(given))
        text, entities = stage("unnamed", redacted["text"]), redacted["n"]
    kinds, tokens = F.array().cast("array<string>"), F.array().cast(TOKENS)
    if recognizers:
        df, flags = with_flags(df, text, recognizers, out)
        temporary += [f"{out}__flags_{kind}" for kind in flags]
        spans = stage("spans", find_spans(text, recognizer_rules(recognizers), flags))
        kinds = F.transform(spans, lambda s: s["kind"])
        tokens = minted_tokens(text, spans, recognizers, key)
        text = replace_spans(text, spans, recognizer_label(recognizers, key))
    return df.withColumn(
        out,
        F.struct(
            text.alias("safe"),
            F.size(secrets).alias("secrets"),
            F.coalesce(pii["n"], F.lit(0)).alias("pii"),
            entities.alias("entities"),
            kinds.alias("kinds"),
            tokens.alias("tokens"),
        ),
    ).drop(*temporary)


def scan_distinct_text(
    df: DataFrame,
    column: str,
    out: str,
    key: ProjectKey,
    recognizers: Sequence[Recognizer] = (),
    detector: EntityDetector | None = None,
) -> DataFrame:
    """Same result as ``scan_text`` with every distinct text scanned once.

    Texts travel once, in the distinct (combined map-side); rows join back on a
    digest, whose repeats adaptive execution splits.
    """
    dtype = df.schema[column].dataType
    digest = F.sha2(canonical_string(quoted(column), dtype), 256)
    keyed = df.withColumn(f"{out}__digest", digest)
    texts = keyed.select(f"{out}__digest", quoted(column)).where(quoted(column).isNotNull())
    scanned = scan_text(
        texts.dropDuplicates([f"{out}__digest"]), column, out, key, recognizers, detector
    ).select(f"{out}__digest", out)
    return keyed.join(scanned, f"{out}__digest", "left").drop(f"{out}__digest")


def text_counters(out: str) -> dict[str, Column]:
    """Aggregates over a scanned column, for the report."""
    scan = F.col(out)

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0))

    return {
        "secrets": total(scan["secrets"]),
        "pii": total(scan["pii"]),
        "entities": total(scan["entities"]),
        "custom": total(F.coalesce(F.size(scan["kinds"]), F.lit(0))),
    }
