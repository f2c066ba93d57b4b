"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths (capacities) are permitted, each at a cost. Pieces go in decreasing length to the open
bin they fill best; if none has room, a new bin is opened. Its size is the one that costs least a token when filled
from the lengths that are left, largest first, and shrunk to what they fill. At the end every bin shrinks to the
cheapest capacity that holds its contents. A shard is also packed by the simpler rule that takes bins to be filled
whole, and the cheaper of both results stands.

Pieces are dealt by hash to shards that are packed independently, in parallel; the number of shards follows the
number of pieces, and a shard's loss is at most its few last bins. Only ids and lengths move, never texts.

Defined results: a document of more tokens than the largest capacity is cut into pieces of that capacity and a
rest; one without tokens has no piece and is not in the result; repeated rows are packed as often as they are
there and told apart by `copy`; ties of length go by doc_id (null last), tokens, copy and piece; an empty table gives
an empty result; other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OUT = "shard int, bin int, capacity int, start int, doc_id bigint, tokens bigint, copy bigint, piece int, first bigint, length int"


def default_cost(capacity: int) -> float:
    """What a sequence costs: its tokens, and attention over them, equal at 4,096 tokens."""
    return capacity * (1 + capacity / 4096)


class _Left:
    """The lengths not yet packed, as counts, and what a new bin would come to hold of them."""

    def __init__(self, lengths: Sequence[int]):
        self.count = Counter(lengths)
        self.sizes = sorted(self.count)

    def take(self, n: int) -> None:
        self.count[n] -= 1
        while self.sizes and not self.count[self.sizes[-1]]:
            self.sizes.pop()

    def filled(self, n: int, capacity: int) -> int:
        """Tokens in a bin of that capacity opened for a piece of n tokens, if the largest that fit follow."""
        free, top = capacity - n, len(self.sizes)
        while free and top:
            top = bisect_right(self.sizes, free, 0, top) - 1
            if top < 0:
                break
            size = self.sizes[top]
            # Pieces go in decreasing length, so lengths above n are used up; n itself is not counted again.
            free -= size * min(self.count[size] - (size == n), free // size)
        return capacity - free


def pack(lengths: Sequence[int], capacities: Sequence[int], cost=default_cost, joint: bool = False) -> tuple[list[int], list[int], list[int]]:
    """Bin and start of each of the decreasing lengths, and each bin's capacity.

    A new bin's size is chosen as if it were filled whole, or, if `joint`, by what the lengths left would fill.
    """
    if joint:
        remaining = _Left(lengths)
    sizes = sorted(set(capacities))
    costs = {c: cost(c) for c in sizes}
    left = int(sum(lengths))  # tokens not yet packed, this piece included
    bins, starts, used, room = [], [], [], []
    open_bins: dict[int, list[int]] = {}  # by room, the latest last
    rooms: list[int] = []  # those of open_bins, ascending
    for n in lengths:
        at = bisect_left(rooms, n)
        if at < len(rooms):
            free = rooms[at]
            b = open_bins[free].pop()
            if not open_bins[free]:
                del open_bins[free], rooms[at]
        else:
            b, fit = len(used), [c for c in sizes if c >= n]
            if joint:
                fills = {c: remaining.filled(n, c) for c in fit}
                free = min(fit, key=lambda c: (min(costs[x] for x in fit if x >= fills[c]) / fills[c], c))
            else:
                free = min(fit, key=lambda c: (costs[c] / min(c, left), c))
            used.append(0)
            room.append(free)
        bins.append(b)
        starts.append(used[b])
        used[b] += n
        left -= n
        if joint:
            remaining.take(n)
        free -= n
        if free:
            if free not in open_bins:
                open_bins[free] = []
                insort(rooms, free)
            open_bins[free].append(b)
    final = [min((c for c in sizes if c >= u), key=lambda c: (costs[c], c)) for u in used]
    return bins, starts, final


def pack_cheapest(lengths: Sequence[int], capacities: Sequence[int], cost=default_cost) -> tuple[list[int], list[int], list[int]]:
    """pack() by either rule, whichever result costs less."""
    both = [pack(lengths, capacities, cost, joint) for joint in (True, False)]
    return min(both, key=lambda found: sum(map(cost, found[2])))


def word_tokens(text: Column) -> Column:
    """Words and one end: the length of a text where no tokenizer is given."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1


def pack_documents(
    docs: DataFrame,
    capacities: Sequence[int] = (512, 1024, 2048, 4096),
    doc_id: str = "doc_id",
    text: str = "text",
    tokens: Column | None = None,
    cost=default_cost,
    shard_pieces: int = 50_000,
) -> DataFrame:
    """One row a piece: shard, bin, capacity, start in the bin, doc_id, tokens, copy, piece, first token, length.

    `tokens` gives a row's number of tokens; words and one end by default.
    """
    top = max(capacities)
    sized = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), (word_tokens(F.col(text)) if tokens is None else tokens).cast("bigint").alias("n"))
    counts = sized.where("n > 0").groupBy("doc_id", "n").agg(F.count("*").alias("copies"))
    counts = counts.withColumn("pieces", F.ceil(F.col("n") / top))
    total = counts.agg(F.sum(F.col("copies") * F.col("pieces"))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_pieces))
    each = counts.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    each = each.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)))
    pieces = each.select(
        F.pmod(F.xxhash64("doc_id", "n", "copy", "piece"), F.lit(shards)).cast("int").alias("shard"),
        "doc_id",
        F.col("n").alias("tokens"),
        "copy",
        F.col("piece").cast("int").alias("piece"),
        (F.col("piece") * top).alias("first"),
        F.least(F.col("n") - F.col("piece") * top, F.lit(top)).cast("int").alias("length"),
    )

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("tokens", "ascending"), ("copy", "ascending"), ("piece", "ascending")])
        bins, starts, final = pack_cheapest(group.column("length").to_pylist(), capacities, cost)
        final = np.array(final, np.int32)
        return pa.table(
            {
                "shard": group.column("shard"),
                "bin": pa.array(bins, pa.int32()),
                "capacity": pa.array(final[bins], pa.int32()),
                "start": pa.array(starts, pa.int32()),
                **{c: group.column(c) for c in ("doc_id", "tokens", "copy", "piece", "first", "length")},
            }
        )

    return pieces.groupBy("shard").applyInArrow(run, _OUT)


def sequences(packed: DataFrame) -> DataFrame:
    """One row a bin: its capacity, tokens, and its pieces in order; a bin holds as many as its capacity at most."""
    piece = F.struct("start", "doc_id", "tokens", "copy", "piece", "first", "length")
    return packed.groupBy("shard", "bin", "capacity").agg(
        F.sum("length").alias("tokens"), F.sort_array(F.collect_list(piece)).alias("pieces")
    )
