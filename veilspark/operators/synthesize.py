"""Synthetic numbers drawn from the quantile bins of a column."""

from __future__ import annotations

import hashlib
import hmac
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import coerce_numeric, is_integral
from ..functions.text import canonical_string, quoted
from ..keys import ProjectKey
from .quantiles import exact_quantiles

MAX_BINS = 16
MAX_STEPS = 128
_DRAW_RANGE = float(1 << 52)


def synthesis_seed(key: ProjectKey, column: str, rows: int) -> str:
    message = b"v1\0" + key.project_id.encode() + b"\0" + column.encode() + b"\0" + str(rows).encode()
    return hmac.new(key.sub_key("numeric_synthesis"), message, hashlib.sha256).hexdigest()


def row_digest(seed: str, row_key: Sequence[Column]) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), *row_key), 256)


def draws(digest: Column) -> tuple[Column, Column]:
    """Two uniform numbers in [0, 1) that depend on the seed and the row alone, so a
    rerun or another partitioning gives the same row the same numbers."""
    return tuple(
        F.conv(F.substring(digest, start, 13), 16, 10).cast("double") / _DRAW_RANGE
        for start in (1, 14)
    )


def synthesize_numeric(
    df: DataFrame, column: str, out: str, key: ProjectKey, row_key: Sequence[str] | None = None
) -> DataFrame:
    """Add ``out``: for each number a draw from a random quantile bin between q01 and q99,
    moved off any original value; null stays null. Whole-number columns give whole numbers.
    A draw with no free value near stays as it is, and ``left_name(out)`` says so."""
    dtype = df.schema[column].dataType
    number = coerce_numeric(quoted(column), dtype)
    nearest = F.rint(number)
    whole = F.abs(number - nearest) <= 1e-8 + 1e-5 * F.abs(nearest)
    rows, n, all_whole, size = df.agg(
        F.count(F.lit(1)), F.count(number), F.bool_and(whole), F.max(F.abs(number))
    ).first()
    if n == 0:
        return df.withColumns({left_name(out): F.lit(False), out: F.lit(None).cast("double")})
    as_integer = is_integral(dtype) or (bool(all_whole) and size < 2.0**53)

    bins = min(MAX_BINS, max(2, math.isqrt(n)))
    shares = [0.01 + 0.98 * i / bins for i in range(bins + 1)]
    shares[-1] = 0.99
    edges = exact_quantiles(df, number, shares)
    if edges[0] == edges[-1]:
        spread = max(abs(edges[0]) * 0.05, 1.0)
        edges[0], edges[-1] = edges[0] - spread, edges[-1] + spread

    names = list(row_key) if row_key else df.columns
    row_id = [
        F.coalesce(canonical_string(quoted(c), df.schema[c].dataType), F.lit("")) for c in names
    ]
    # one column per step: the digest of a row is computed once
    digest, number_name, place, drawn = (f"{out}__{part}" for part in ("digest", "x", "bin", "drawn"))
    pick, within = draws(F.col(digest))
    bounds = F.lit([float(edge) for edge in edges])
    left, right = F.element_at(bounds, F.col(place) + 1), F.element_at(bounds, F.col(place) + 2)
    spot = left + within * (right - left)
    drafted = (
        df.withColumn(digest, row_digest(synthesis_seed(key, column, rows), row_id))
        .withColumn(number_name, nearest if as_integer else number)
        .withColumn(place, F.floor(pick * bins).cast("int"))
        .withColumn(
            drawn, F.when(F.col(number_name).isNotNull(), F.rint(spot) if as_integer else spot)
        )
    )
    # a drawn value is taken if it is also an original: one pass, one combined shuffle
    sides = F.array(
        F.struct(F.col(drawn).alias("value"), F.lit(True).alias("is_draw")),
        F.struct(F.col(number_name).alias("value"), F.lit(False).alias("is_draw")),
    )
    taken = (
        drafted.select(F.inline(sides))
        .where(F.col("value").isNotNull())
        .groupBy("value")
        .agg(F.bool_or("is_draw").alias("draws"), F.bool_and("is_draw").alias("only_draws"))
        .where(F.col("draws") & ~F.col("only_draws"))
        .select("value")
    )
    value, stays = F.col(drawn), F.lit(False)
    # not checkpointed: the values are originals and should not be written in the clear
    if taken.take(1):
        originals = drafted.select(F.col(number_name).alias("value")).where(F.col("value").isNotNull())
        move = _free_whole_number if as_integer else _free_number
        moved = move(taken, originals.distinct(), edges[0], edges[-1])
        moved = moved.select(
            F.col("value").alias(drawn), F.col("free").alias(f"{out}__free"), F.lit(True).alias(f"{out}__taken")
        )
        drafted = drafted.join(moved, drawn, "left")
        value = F.coalesce(F.col(f"{out}__free"), value)
        stays = F.col(f"{out}__taken") & F.col(f"{out}__free").isNull()
    return drafted.withColumns(
        {left_name(out): F.coalesce(stays, F.lit(False)), out: value.cast("bigint") if as_integer else value}
    ).drop(digest, number_name, place, drawn, f"{out}__free", f"{out}__taken")


def left_name(out: str) -> str:
    """The column that says whether a drawn value is an original that could not be moved."""
    return f"{out}__left"


def _free_whole_number(taken: DataFrame, originals: DataFrame, low: float, high: float) -> DataFrame:
    """Nearest whole number that is no original: upwards within reach and range, else
    downwards, else none. Originals are grouped in blocks of MAX_STEPS numbers, so a
    block and its two neighbours hold everything in reach and never more than 384 values."""
    value = F.col("value").cast("bigint")
    block = F.floor(F.col("value") / MAX_STEPS)
    near = (
        originals.select(
            F.explode(F.array(block - 1, block, block + 1)).alias("block"), value.alias("v")
        )
        .groupBy("block")
        .agg(F.collect_set("v").alias("near"))
    )
    up_to = F.least(value + MAX_STEPS, F.lit(math.floor(high)))
    down_to = F.greatest(value - MAX_STEPS, F.lit(math.ceil(low)))
    up = F.when(up_to > value, F.array_except(F.sequence(value + 1, up_to), "near"))
    down = F.when(down_to < value, F.array_except(F.sequence(value - 1, down_to, F.lit(-1)), "near"))
    return (
        taken.withColumn("block", block)
        .join(near, "block")
        .select("value", F.coalesce(F.get(up, 0), F.get(down, 0)).cast("double").alias("free"))
    )


def _free_number(taken: DataFrame, originals: DataFrame, low: float, high: float) -> DataFrame:
    """Same rule in steps of 1/10,000 of the range. A drawn double is taken only by
    coincidence or in a bin of one value, so few values reach this point."""
    step = max((high - low) / 10_000, 1e-9)
    steps = F.sequence(F.lit(1), F.lit(MAX_STEPS))
    moves = F.concat(
        F.transform(steps, lambda k: F.struct(k.alias("rank"), (F.col("value") + k * step).alias("to"))),
        F.transform(
            steps,
            lambda k: F.struct((k + MAX_STEPS).alias("rank"), (F.col("value") - k * step).alias("to")),
        ),
    )
    tried = (
        taken.select("value", F.explode(moves).alias("move"))
        .select("value", "move.rank", "move.to")
        .where(F.col("to").between(low, high))
    )
    free = tried.join(originals.withColumnRenamed("value", "to"), "to", "left_anti")
    return free.groupBy("value").agg(F.min_by("to", "rank").alias("free"))
