"""Benchmark decontamination by winnowing, in native expressions only.

A word is a maximal run of characters outside [\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after lower-casing A-Z. A window
is `window` consecutive words of an item; an item of fewer words, but not none, is one window.

Winnowing: of the hashes of all k-grams, the smallest of each `window - k + 1` consecutive ones is kept, on both
sides. Two texts that share `window` words share that many consecutive k-grams, and so a kept hash. Items too
short for that are found by an anchor word. A row that shares no kept hash or anchor has no hit; the words of the
others are compared with the items' windows themselves, so hashes never decide, and overlapping windows extend
each other to hits.

The texts are read once: the rows' word counts, and the texts of suspected rows only, go to a table in the
shared folder. With up to `literals` kept hashes the suspicion is a test inside the row (the list is counted
first); beyond that the hashes are joined.

Defined results: null or wordless texts have no hit; items without id give hits but are not counted or listed;
repeated items count once; repeated documents come back as often as they are there; an empty benchmark
contaminates nothing; other columns of both tables are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, let, lower_ascii, small, stage

_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    found = F.split(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), _OTHER, " "), " ")
    return F.array_remove(found, "")


def _grams(found: Column, k: int) -> Column:
    """Hashes of all k-grams."""

    def hashes(single: Column) -> Column:
        count = F.size(single) - F.lit(k - 1)
        return F.transform(F.slice(single, 1, F.greatest(count, F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(single, i + j) for j in range(1, k))))

    return let(F.transform(found, lambda x: F.xxhash64(x)), hashes)


def kept_hashes(found: Column, k: int, window: int) -> Column:
    """The smallest k-gram hash of every window of consecutive ones; of all there are, if they are fewer."""
    run = window - k + 1

    def least(hashes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(hashes) - F.lit(run - 1), F.lit(1)))
        return F.array_distinct(F.transform(starts, lambda i: F.array_min(F.slice(hashes, i, run))))

    return F.array_compact(let(_grams(found, k), least))


def _is_in(values: list, element: Column) -> Column:
    return element.isin(values) if values else F.lit(False)


def _windows(rows: DataFrame, length: Column, *keep: str) -> DataFrame:
    """One row for each place `at` of `length` words: their text as `span`."""
    last = F.size("words") - length + 1
    places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return rows.select(*keep, "words", length.alias("length"), F.explode(places).alias("at")).select(
        *keep, "length", "at", F.concat_ws(" ", F.slice("words", F.col("at"), F.col("length"))).alias("span")
    )


def hits(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    k: int = 5,
    literals: int = 20_000,
) -> tuple[DataFrame, DataFrame]:
    """Two tables: rows (row, doc_id, n_words, text of suspected rows) and found (row, n_hit, items: sorted ids).

    found has only rows with hits.
    """
    items = items.select(F.col(item_id).alias("item"), words(F.col(item_text)).alias("words"))
    items = stage(items.where(F.size("words") > 0).select("item", "words", F.least(F.size("words"), F.lit(window)).alias("length")), "items")
    full = items.where(F.col("length") == window)
    marks = stage(full.select(F.explode(kept_hashes(F.col("words"), k, window)).alias("mark")).distinct(), "marks")
    short = items.where(F.col("length") < window)
    anchors = stage(short.select(F.array_min(F.transform("words", lambda w: F.struct(F.xxhash64(w).alias("h"), w.alias("w"))))["w"].alias("anchor")).distinct(), "anchors")

    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = words(F.col("text"))
    if bounded(marks, literals) and bounded(anchors, literals):
        inside, starting = ([r[0] for r in t.collect()] for t in (marks, anchors))

        def judge(w: Column) -> Column:
            marked = F.exists(kept_hashes(w, k, window), lambda h: _is_in(inside, h)) if inside else F.lit(False)
            anchored = F.exists(w, lambda x: _is_in(starting, x)) if starting else F.lit(False)
            return F.struct(F.size(w).cast("bigint").alias("n_words"), (marked | anchored).alias("suspect"))

        judged = picked.select("doc_id", "text", let(found, judge).alias("seen"))
        rows = stage(
            judged.select(
                F.monotonically_increasing_id().alias("row"), "doc_id", F.col("seen.n_words").alias("n_words"), F.when(F.col("seen.suspect"), F.col("text")).alias("text")
            ),
            "rows",
        )
    else:
        rows = stage(picked.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows")
        by_mark = rows.select("row", F.explode(kept_hashes(found, k, window)).alias("mark")).join(marks, "mark")
        by_word = rows.select("row", F.explode(F.array_distinct(found)).alias("anchor")).join(anchors, "anchor")
        suspects = by_mark.select("row").union(by_word.select("row")).distinct().withColumn("suspect", F.lit(True))
        rows = rows.join(suspects, "row", "left")
        rows = stage(
            rows.select("row", "doc_id", F.size(words(F.col("text"))).cast("bigint").alias("n_words"), F.when(F.col("suspect"), F.col("text")).alias("text")), "rows"
        )

    spans = stage(_windows(items, F.col("length"), "item").select("item", "span", "length").distinct(), "spans")
    lengths = [r[0] for r in spans.select("length").distinct().collect()]  # window at most
    suspects = rows.where(F.col("text").isNotNull()).select("row", words(F.col("text")).alias("words"))
    texts = small(spans.select("span").distinct())
    if not lengths:
        lengths = [window]
    places = None
    for length in lengths:
        part = _windows(suspects, F.lit(length), "row").join(texts, "span")
        places = part if places is None else places.union(part)
    places = stage(places.select("row", "at", "length", "span"), "places")
    # Words covered: each place adds what lies beyond the furthest end before it. One sorted pass a row, no arrays.
    ends = places.groupBy("row", "at").agg(F.max(F.col("at") + F.col("length")).alias("end"))
    before = F.expr("max(end) over (partition by row order by at rows between unbounded preceding and 1 preceding)")
    covered = ends.withColumn("before", F.coalesce(before, F.lit(0)))
    covered = covered.groupBy("row").agg(F.sum(F.greatest(F.col("end") - F.greatest("at", "before"), F.lit(0))).cast("bigint").alias("n_hit"))
    of = spans.where(F.col("item").isNotNull()).select("item", "span")
    named = places.select("row", "span").distinct().join(of, "span").select("row", F.col("item").cast("string").alias("item"))
    named = named.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return rows, covered.join(named, "row", "left")


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids) and contaminated of every row of docs.

    contaminated: a word is hit, and at least one in twenty.
    """
    rows, found = hits(docs, items, **options)
    joined = rows.join(found, "row", "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0)))
    return joined.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
