"""Exact quantiles, linear between order statistics, without a single-task sort."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ACCURACY = 10_000


def exact_quantiles(
    df: DataFrame, value: Column, probabilities: Sequence[float]
) -> list[float]:
    """Quantiles of the non-null values: approximate sketches narrow each to a few candidate
    values, which are counted exactly. (The built-in one holds all values in one task.)"""
    data = df.select(value.cast("double").alias("x")).where(F.col("x").isNotNull())
    n, least, most = data.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if n == 0:
        return []
    positions = [p * (n - 1) for p in probabilities]
    wanted = sorted({r for at in positions for r in (math.floor(at), min(math.floor(at) + 1, n - 1))})
    found = _order_statistics(data, n, wanted, least, most)
    result = []
    for at in positions:
        low = math.floor(at)
        below, above = found[low], found[min(low + 1, n - 1)]
        result.append(below + (above - below) * (at - low))
    return result


def _order_statistics(
    data: DataFrame, n: int, ranks: list[int], least: float, most: float
) -> dict[int, float]:
    """Value at each 0-based rank. Every rank keeps a bracket [low, high] that holds it;
    each round shrinks all brackets by one sketch pass and one counting pass, until they
    hold few rows or no round helps."""
    x = F.col("x")
    # rank -> (low, high, rows below low, rows up to high)
    brackets = {rank: (least, most, 0, n) for rank in ranks}
    before = None
    while brackets != before:
        before = dict(brackets)
        wide = [r for r, (low, high, below, upto) in brackets.items() if low < high and upto - below > _ACCURACY]
        if not wide:
            break
        # ranks of one bracket share one sketch
        groups: dict[tuple, list[int]] = {}
        for r in wide:
            groups.setdefault(brackets[r], []).append(r)
        sketches = []
        for (low, high, below, upto), members in groups.items():
            ends = []
            for r in members:
                share = (r - below) / (upto - below)
                ends += [max(0.0, share - 2 / _ACCURACY), min(1.0, share + 2 / _ACCURACY)]
            inside = F.when(x.between(low, high), x)
            sketches.append(F.percentile_approx(inside, ends, _ACCURACY))
        sketched = list(data.agg(*sketches).first())
        guess = {}
        for members, ends in zip(groups.values(), sketched):
            guess.update({r: (ends[2 * i], ends[2 * i + 1]) for i, r in enumerate(members)})
        guesses = [guess[r] for r in wide]
        counts = []
        for low, high in guesses:
            counts += [F.sum((x < low).cast("bigint")), F.sum((x <= high).cast("bigint"))]
        exact = list(data.agg(*counts).first())
        for i, r in enumerate(wide):
            low, high, below, upto = brackets[r]
            if exact[2 * i] <= r:
                low, below = guesses[i][0], exact[2 * i]
            if exact[2 * i + 1] > r:
                high, upto = guesses[i][1], exact[2 * i + 1]
            brackets[r] = (low, high, below, upto)
    return _pick(data, brackets)


def _pick(data: DataFrame, brackets: dict[int, tuple]) -> dict[int, float]:
    """Count the distinct values inside the open brackets and read off the ranks."""
    found = {r: low for r, (low, high, _, _) in brackets.items() if low == high}
    open_ = sorted({b for b in brackets.values() if b[0] < b[1]})
    if not open_:
        return found
    x = F.col("x")
    member = F.array_compact(
        F.array(*[F.when(x.between(b[0], b[1]), F.lit(i)) for i, b in enumerate(open_)])
    )
    counted = (
        data.where(F.size(member) > 0)
        .groupBy("x")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("x", "n", F.explode(member).alias("bracket"))
    )
    below = F.element_at(F.array(*[F.lit(b[2]) for b in open_]), F.col("bracket") + 1)
    running = Window.partitionBy("bracket").orderBy("x")
    ranked = counted.select(
        "bracket", "x", "n", (below + F.sum("n").over(running)).alias("upto")
    )
    wanted = {r: open_.index(b) for r, b in brackets.items() if b[0] < b[1]}
    hit = F.lit(False)
    for r, i in wanted.items():
        hit = hit | ((F.col("bracket") == i) & (F.col("upto") > r) & (F.col("upto") - F.col("n") <= r))
    rows = ranked.where(hit).collect()  # at most one row per rank
    for r, i in wanted.items():
        found[r] = next(
            row["x"] for row in rows if row["bracket"] == i and row["upto"] - row["n"] <= r < row["upto"]
        )
    return found
