"""Importance resampling towards a target distribution: array-scored weights, cutoff by threshold bisection.

Words are maximal runs of characters outside [\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after lower-casing A-Z. Features
are all runs of 1 to 3 consecutive words of a text, joined by one space, repeats counted; a feature's bucket is the
CRC-32 of its UTF-8 bytes modulo `buckets`. A bucket's gain compares its share of the target's features with its
share of the source's. A document's weight is the sum of its features' gains, its score the weight plus Gumbel
noise drawn from a hash of seed and doc_id, so the highest scores are a sample without replacement.

Counts. A task adds its texts' features up in one array of `buckets` numbers; the arrays are summed by bucket in
Spark, and only the sum, of that fixed size, goes to the driver and back as the array of gains. CRC-32 is linear:
the value of joined words follows from those of its parts and their lengths, so no joined string is built.

Cutoff. Scores are persisted in the shared folder. The number of scores at or above a threshold is counted exactly,
in jobs that each count for all thresholds the next `steps` halvings can ask for, until the smallest score of the
draw is known; in the same way its largest tied doc_id, and for repeated rows the largest row number. Nothing is
sorted to find the cutoff. Only the rows drawn are range-partitioned and ranked.

Defined results: null text has no words; a null doc_id draws its noise from the seed alone and comes after all
others in ties; repeated rows are rows of their own; an empty target or source gives gains from the smoothing alone;
an empty table gives an empty result; other columns of the inputs are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, stage, word_pieces

#: Bytes that belong to words stand for themselves, A-Z for a-z, all others for a space.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_POLYNOMIAL = 0xEDB88320  # of CRC-32
_DIRECT = 64


def _zero_bytes() -> tuple[np.ndarray, np.ndarray]:
    """What 0 to 63 zero bytes, and 2^k zero bytes, make of a CRC: xor of one entry for each of its four bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(_POLYNOMIAL), step >> 1).astype(np.uint32)
    direct = np.empty((_DIRECT, 4, 256), np.uint32)
    direct[0] = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
    for n in range(1, _DIRECT):
        direct[n] = (direct[n - 1] >> 8) ^ step[direct[n - 1] & 255]
    powers = [direct[1]]
    for _ in range(31):
        powers.append(_apply(powers[-1], powers[-1]))
    return direct, np.array(powers)


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


_ZEROS, _POWERS = _zero_bytes()
_SPACE = np.uint32(zlib.crc32(b" "))


def _joined(crc: np.ndarray, after: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of texts followed by others, from those of both and the lengths of the others."""
    n = np.minimum(length, _DIRECT - 1)
    moved = _ZEROS[n, 0, crc & 255] ^ _ZEROS[n, 1, (crc >> 8) & 255] ^ _ZEROS[n, 2, (crc >> 16) & 255] ^ _ZEROS[n, 3, crc >> 24]
    far = np.flatnonzero(length >= _DIRECT)
    if len(far):
        value, left = crc[far], length[far]
        for k in range(int(left.max()).bit_length()):
            value = np.where(left >> k & 1, _apply(_POWERS[k], value), value)
        moved[far] = value
    return moved ^ after


def feature_crcs(words: list[bytes], ends: np.ndarray, longest: int = 3, skip: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, .. words: the place of each run's last word, and the run's CRC-32.

    ends: the text of word i goes on to ends[i]; runs do not cross it. Runs that end before `skip` are left out.
    """
    single = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    length = np.fromiter(map(len, words), np.int64, len(words))
    found, at, run = [], np.arange(len(words)), single
    for size in range(1, longest + 1):
        if size > 1:
            going = at + 1 < ends[at]
            at, run = at[going] + 1, run[going]
            run = _joined(_joined(run, np.full(len(run), _SPACE), np.ones(len(run), np.int64)), single[at], length[at])
        found.append((at[at >= skip], run[at >= skip]))
    return found


def _texts(batches: Iterator[pa.RecordBatch], column: int, size: int = 1 << 22) -> Iterator[tuple[list[int], list[bytes], np.ndarray, int, pa.RecordBatch]]:
    """Words of consecutive texts of a batch, or of a piece of one long text: places of the texts in the batch, words,
    where the text of each word ends, words of the piece before that are there for their runs only, and the batch."""
    for batch in batches:
        at, words, ends, held = [], [], [], 0
        for i, body in enumerate(batch.column(column).to_pylist()):
            data = (body or b"").translate(_FOLD)
            if len(data) > size:
                tail: list[bytes] = []
                for piece in word_pieces(data, size):
                    yield [i] * (len(tail) + len(piece)), tail + piece, np.full(len(tail) + len(piece), len(tail) + len(piece)), len(tail), batch
                    tail = (tail + piece)[-2:]
                continue
            own = data.split()
            words += own
            at += [i] * len(own)
            ends.append((len(words), len(own)))
            held += len(data)
            if held > size:
                yield at, words, _spread(ends), 0, batch
                at, words, ends, held = [], [], [], 0
        if words:
            yield at, words, _spread(ends), 0, batch
        yield [], [], np.empty(0, np.int64), -1, batch  # the batch is over


def _spread(ends: list[tuple[int, int]]) -> np.ndarray:
    return np.repeat(np.array([e for e, _ in ends], np.int64), np.array([n for _, n in ends], np.int64))


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = 10_000, longest: int = 3) -> np.ndarray:
    """How many features of all texts fall in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, words, ends, skip, _ in _texts(batches, 0):
            if words:
                for _, crc in feature_crcs(words, ends, longest, skip):
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    found = docs.select(F.col(text).cast("binary")).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for bucket, n in found.collect():  # one row a bucket
        counts[bucket] = n
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, in thousandths, rounded down."""
    buckets = len(source)
    over, under = float(target.sum() + buckets), float(source.sum() + buckets)
    return np.array([math.floor(1000 * math.log((t + 1) * under / ((s + 1) * over))) for s, t in zip(map(float, source), map(float, target))], np.int64)


def noise(doc_id, seed: int = 42) -> int:
    """Gumbel noise of a document, in thousandths, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", longest: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row of docs."""
    buckets = np.uint32(len(gain))
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("body"))
    schema = f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_features bigint, weight bigint, score bigint"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for at, words, ends, skip, batch in _texts(batches, 1):
            if sums is None:
                sums = np.zeros((3, batch.num_rows), np.int64)
            if skip >= 0:
                at = np.array(at, np.int64)
                sums[0] += np.bincount(at[skip:], minlength=batch.num_rows)
                for last, crc in feature_crcs(words, ends, longest, skip):
                    sums[1] += np.bincount(at[last], minlength=batch.num_rows)
                    weights = gain[crc % buckets].astype(np.float64)  # whole numbers, exact below 2^53
                    sums[2] += np.bincount(at[last], weights, minlength=batch.num_rows).astype(np.int64)
                continue
            extra = np.array([noise(d, seed) for d in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, [*sums, sums[2] + extra])], names=["doc_id", "n_words", "n_features", "weight", "score"])
            sums = None

    return picked.mapInArrow(score, schema)


def nth_smallest(rows: DataFrame, value: Column, n: int, steps: int = 4) -> tuple[int, int]:
    """The n-th smallest whole number (n from 1) among rows, and how many are smaller, by bisection.

    Each job counts exactly what is at or below every midpoint that the next `steps` halvings can ask for.
    """
    low, high = rows.agg(F.min(value), F.max(value)).first()
    below = 0
    while low < high:
        marks: set[int] = set()
        spans = {(low, high)}
        for _ in range(steps):
            mids = {(a, b): (a + b) // 2 for a, b in spans if a < b}
            marks |= set(mids.values())
            spans = {half for (a, b), m in mids.items() for half in ((a, m), (m + 1, b))}
        marks = sorted(marks)
        counts = rows.agg(*(F.count(F.when(value <= F.lit(m), 1)) for m in marks)).first()
        for m, c in zip(marks, counts):
            if c >= n:
                high = m
                break
            low, below = m + 1, c
    return low, below


def draw(scored: DataFrame, eligible: Column, share: int, steps: int = 4) -> DataFrame:
    """scored, with `rank` of the floor(share * N / 100) highest scores of the N eligible rows, ties to the smaller doc_id.

    scored is persisted (a table, read again); doc_id is a whole number.
    """
    rows = stage(scored.select("*", F.monotonically_increasing_id().alias("_row"), eligible.alias("_in")), "scored")
    of = rows.where("_in")
    n = of.count() * share // 100
    columns = scored.columns
    if n == 0:
        return rows.select(*columns, F.lit(None).cast("bigint").alias("rank"))
    score, row = -F.col("score"), F.col("_row")
    last, above = nth_smallest(of, score, n, steps)
    drawn, n = score < last, n - above
    tied = of.where(score == last)
    ids = tied.where(F.col("doc_id").isNotNull())
    known = ids.count()
    if n > known:  # all with an id, and some without
        drawn, n, tied = drawn | ((score == last) & F.col("doc_id").isNotNull()), n - known, tied.where(F.col("doc_id").isNull())
        same = F.col("doc_id").isNull()
    else:
        at, above = nth_smallest(ids, F.col("doc_id"), n, steps)
        drawn, n, tied = drawn | ((score == last) & (F.col("doc_id") < at)), n - above, ids.where(F.col("doc_id") == at)
        same = F.col("doc_id") == at
    most, _ = nth_smallest(tied, row, n, steps)
    drawn = F.col("_in") & F.coalesce(drawn | ((score == last) & same & (row <= most)), F.lit(False))
    ranked = numbered(rows.where(drawn), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), row.asc()], "rank")
    rest = rows.where(~drawn).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.select(*columns, (F.col("rank") + 1).alias("rank")).unionByName(rest.select(*columns, "rank"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    least_words: int = 20,
    share: int = 5,
    buckets: int = 10_000,
    longest: int = 3,
    seed: int = 42,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of each row of docs.

    The draw is the `share` hundredths, rounded down, of the documents with at least least_words words.
    """
    gain = gains(bucket_counts(docs, text, buckets, longest), bucket_counts(target, target_text, buckets, longest))
    return draw(weigh(docs, gain, doc_id, text, longest, seed), F.col("n_words") >= least_words, share)
