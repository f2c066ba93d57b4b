"""Repeated token windows: Rabin-Karp hashes of every fixed-length window, counted in Spark, merged to intervals.

A word is a maximal run of bytes other than ASCII white space, a window is `window` consecutive words of one
document. A window repeats if its words also start earlier: in a smaller doc_id, or earlier in the same document.

Every window gets a 64-bit rolling hash of its words' hashes. A task cuts its documents into runs of `run_words`
words, keeps the first window of each hash in the run (the others repeat already), and sends the rest packed, 9
bytes a window, to buckets by hash. Buckets follow the input's size, so each holds about `bucket_words` windows,
and a passage that a third of all documents share costs a bucket one entry per run. A bucket finds each hash's
first window; all others repeat. Their starts are packed by groups of documents, and one task a group merges
overlapping windows into maximal intervals. Two different windows are taken for equal with odds of about 2^-63 a pair.

Defined results: null text has no words; a null doc_id sorts after all others; rows with one doc_id are one
document's texts, each judged on its own words, and a window at the same place of the same doc_id isn't earlier;
exact repeated rows come back as often as they are there; an empty table gives an empty result; other columns
stay as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import word_pieces

_LAST = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_SENT = "bucket int, hashes binary, at binary, words binary"
_SHEAF = "part int, sheaf binary"
_INTERVALS = "doc bigint, variant int, removed array<struct<start:bigint,end:bigint>>"


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """Rabin-Karp hash of every window, by prefix sums modulo 2^64; hash k is that of words k to k + window - 1."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    powers = np.ones(len(words) + 1, np.uint64)
    powers[1:] = _BASE
    np.cumprod(powers, out=powers)
    inverse = np.ones(len(words) + 1, np.uint64)
    inverse[1:] = pow(_BASE, -1, 1 << 64)
    np.cumprod(inverse, out=inverse)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * inverse[:-1], out=sums[1:])
    found = (sums[window:] - sums[:n]) * powers[:n]
    found ^= found >> np.uint64(32)  # the low bits of a product mix least: buckets go by the high ones
    found *= np.uint64(0xD6E8FEB86659FD93)
    found ^= found >> np.uint64(29)
    return found


def _sheaves(doc: np.ndarray, variant: np.ndarray, start: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """Repeated windows, packed by groups of documents."""
    mixed = (doc.astype(np.uint64) * np.uint64(_BASE)) ^ (variant.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    part = ((mixed >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((start, variant, doc, part))
    part, doc, variant, start = part[order], doc[order], variant[order].astype(np.int32), start[order]
    edges = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip(np.append(0, edges), np.append(edges, len(part))):
        if b > a:
            columns = (np.diff(doc[a:b], prepend=0), variant[a:b], np.diff(start[a:b], prepend=0))
            yield int(part[a]), zlib.compress(b"".join(c.tobytes() for c in columns), 1)


def _opened(sheaf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = zlib.decompress(sheaf)
    n = len(data) // 20
    doc, start = np.cumsum(np.frombuffer(data, np.int64, n)), np.cumsum(np.frombuffer(data, np.int64, n, 12 * n))
    return doc, np.frombuffer(data, np.int32, n, 8 * n), start


def _split(hashes: np.ndarray, doc: np.ndarray, start: np.ndarray, variant: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first windows of each hash (one for each variant of a document) and of the repeated ones."""
    order = np.lexsort((variant, start, doc, hashes))
    h, d, s, v = hashes[order], doc[order], start[order], variant[order]
    new = np.append(True, h[1:] != h[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    earliest = (d == d[first]) & (s == s[first])
    twin = np.append(False, (v[1:] == v[:-1])) & earliest & ~new
    return order[earliest & ~twin], order[~earliest]


class _Run:
    """Words of consecutive documents, up to a number."""

    def __init__(self, window: int, buckets: int):
        self.window, self.buckets = window, buckets
        self.clear()

    def clear(self) -> None:
        self.words: list[np.ndarray] = []
        self.of: list[tuple[int, int, int, int]] = []  # doc, variant, first word's place in its text, words
        self.n = 0

    def add(self, doc: int, variant: int, place: int, words: np.ndarray) -> None:
        self.words.append(words)
        self.of.append((doc, variant, place, len(words)))
        self.n += len(words)

    def rows(self) -> Iterator[tuple]:
        if not self.n:
            return
        doc, variant, place, size = (np.array(x, np.int64) for x in zip(*self.of))
        ends = np.cumsum(size)
        every = window_hashes(np.concatenate(self.words), self.window)
        full = size >= self.window
        inside = np.zeros(len(every) + 1, np.int32)
        np.add.at(inside, (ends - size)[full], 1)
        np.add.at(inside, (ends - self.window + 1)[full], -1)
        at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        order = np.argsort(every[at])
        at = at[order]
        hashes = every[at]
        same = np.append(False, hashes[1:] == hashes[:-1])
        twice = np.flatnonzero(same | np.append(same[1:], False))
        if len(twice):
            k = np.searchsorted(ends, at[twice], side="right")
            first, later = _split(hashes[twice], doc[k], at[twice] - (ends - size)[k] + place[k], variant[k])
            k, places = k[later], at[twice[later]]
            keep = np.ones(len(at), bool)
            keep[twice] = False
            keep[twice[first]] = True
            for part, sheaf in _sheaves(doc[k], variant[k], places - (ends - size)[k] + place[k], self.buckets):
                yield self.buckets + part, None, None, sheaf
            at, hashes = at[keep], hashes[keep]
        directory = zlib.compress(
            b"".join([np.diff(doc, prepend=0).tobytes(), variant.astype(np.int32).tobytes(), place.astype(np.uint32).tobytes(), size.astype(np.uint32).tobytes()]), 1
        )
        share = -(-(1 << 64) // self.buckets)
        bounds = np.array([b * share for b in range(1, self.buckets)], np.uint64)
        edges = np.concatenate([[0], np.searchsorted(hashes, bounds), [len(hashes)]])
        for b, (i, j) in enumerate(zip(edges, edges[1:])):
            if j > i:
                places = at[i:j].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
                yield b, _pack(hashes[i:j]), places.tobytes(), directory


def _pack(hashes: np.ndarray) -> bytes:
    """Ascending hashes as differences, of as many bytes as the largest needs."""
    steps = np.diff(hashes)
    size = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    steps = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]
    return bytes([size]) + hashes[:1].astype("<u8").tobytes() + steps.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    size = data[0]
    raw = np.frombuffer(data, np.uint8, offset=9).reshape(-1, size)
    steps = np.zeros((len(raw) + 1, 8), np.uint8)
    steps[1:, :size] = raw
    steps[0] = np.frombuffer(data, np.uint8, count=8, offset=1)
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64)


def _repeated(group: pa.Table, buckets: int) -> pa.Table:
    """The repeated windows of one bucket, packed by documents; those packed already pass through."""
    bucket = group.column("bucket")[0].as_py()
    if bucket >= buckets:
        return pa.table({"part": pa.array([bucket - buckets] * group.num_rows, pa.int32()), "sheaf": group.column("words")})
    hashes, at, doc, variant, place, size, base = [], [], [], [], [], [], 0
    for packed, places, words in zip(*(group.column(c).to_pylist() for c in ("hashes", "at", "words"))):
        hashes.append(_unpack(packed))
        raw = np.zeros((len(places) // 3, 4), np.uint8)
        raw[:, :3] = np.frombuffer(places, np.uint8).reshape(-1, 3)
        at.append(raw.reshape(-1).view("<u4").astype(np.int64) + base)
        words = zlib.decompress(words)
        n = len(words) // 20
        doc.append(np.cumsum(np.frombuffer(words, np.int64, n)))
        variant.append(np.frombuffer(words, np.int32, n, 8 * n))
        place.append(np.frombuffer(words, np.uint32, n, 12 * n).astype(np.int64))
        size.append(np.frombuffer(words, np.uint32, n, 16 * n).astype(np.int64))
        base += int(size[-1].sum())
    hashes, at, doc, variant, place, size = map(np.concatenate, (hashes, at, doc, variant, place, size))
    order = np.argsort(hashes)
    hashes = hashes[order]
    same = np.append(False, hashes[1:] == hashes[:-1])
    twice = same | np.append(same[1:], False)
    hashes, at = hashes[twice], at[order[twice]]
    ends = np.cumsum(size)
    k = np.searchsorted(ends, at, side="right")
    start = at - (ends - size)[k] + place[k]
    _, later = _split(hashes, doc[k], start, variant[k]) if len(hashes) else (None, np.empty(0, np.int64))
    k = k[later]
    found = list(zip(*_sheaves(doc[k], variant[k], start[later], buckets))) or [(), ()]
    return pa.table({"part": pa.array(found[0], pa.int32()), "sheaf": pa.array(found[1], pa.binary())})


def _merged(group: pa.Table, window: int) -> pa.Table:
    """The maximal intervals of words that a group of documents has in repeated windows."""
    doc, variant, start = map(np.concatenate, zip(*map(_opened, group.column("sheaf").to_pylist())))
    order = np.lexsort((start, variant, doc))
    doc, variant, start = doc[order], variant[order], start[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (variant[1:] != variant[:-1]))
    first = np.flatnonzero(new | np.append(True, start[1:] > start[:-1] + window))
    last = np.append(first[1:], len(start)) - 1
    spans = pa.StructArray.from_arrays([pa.array(start[first]), pa.array(start[last] + window)], names=["start", "end"])
    own = np.flatnonzero(new)
    offsets = np.append(np.searchsorted(first, own), len(first)).astype(np.int32)
    return pa.table({"doc": pa.array(doc[own]), "variant": pa.array(variant[own]), "removed": pa.ListArray.from_arrays(pa.array(offsets), spans)})


def _keyed(docs: DataFrame, doc_id: str, text: str) -> list[Column]:
    """doc (doc_id, the largest for null) and variant, which tells texts of one doc_id apart."""
    return [
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_LAST)).alias("doc"),
        F.hash(F.xxhash64(F.col(text)), F.octet_length(F.col(text))).alias("variant"),
    ]


def repeated_windows(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20, run_words: int = 2_000_000, bucket_words: int = 2_000_000
) -> DataFrame:
    """doc, variant and removed (maximal intervals of words in repeated windows) of each text that has some."""
    if not 0 < run_words < (1 << 23):
        raise ValueError("run_words must be below 2^23: a place in a run takes three bytes")
    picked = docs.select(*_keyed(docs, doc_id, text), F.col(text).cast("binary").alias("body"))
    # A word takes six or so bytes with its space; the number only sets how many buckets there are.
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    buckets = max(8, -(-int(size) // (6 * bucket_words)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in _SENT.split(", ")]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        run = _Run(window, buckets)

        def flush():
            rows = list(run.rows())
            run.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for doc, variant, body in zip(*(c.to_pylist() for c in batch.columns)):
                place, tail = 0, np.empty(0, np.uint64)
                for words in word_pieces(body or b""):
                    words = np.concatenate([tail, word_hashes(words)]) if len(tail) else word_hashes(words)
                    if len(words) >= window:
                        run.add(doc, variant, place, words)
                        place += len(words) - window + 1
                        tail = words[len(words) - window + 1 :]
                    else:
                        tail = words
                    if run.n >= run_words:
                        yield from flush()
        yield from flush()

    sent = picked.mapInArrow(send, _SENT)
    sheaves = sent.groupBy("bucket").applyInArrow(lambda group: _repeated(group, buckets), _SHEAF)
    return sheaves.groupBy("part").applyInArrow(lambda group: _merged(group, window), _INTERVALS)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20, **sizes: int) -> DataFrame:
    """All rows and columns of docs, and n_words, removed (maximal intervals of words, [start, end)) and kept.

    kept holds the words outside the intervals, joined by one space. Columns of these three names that docs
    already has are replaced.
    """
    cuts = repeated_windows(docs, doc_id, text, window, **sizes)
    keyed = docs.select(F.struct("*").alias("row"), *_keyed(docs, doc_id, text))
    own = [c for c in docs.columns if c.lower() not in ("n_words", "removed", "kept") or c in (doc_id, text)]
    joined = keyed.join(cuts, ["doc", "variant"], "left")
    joined = joined.select(*(F.col("row")[c].alias(f"c{i}") for i, c in enumerate(own)), F.coalesce("removed", F.array().cast(_INTERVALS.split()[-1])))
    added = T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
            T.StructField("kept", T.StringType()),
        ]
    )
    schema = T.StructType([docs.schema[c] for c in own] + added.fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, kept = [], []
            for body, removed in zip(batch.column(own.index(text)).to_pylist(), batch.column(len(own)).to_pylist()):
                words = (body or "").encode().split()
                n.append(len(words))
                for span in reversed(removed):
                    del words[span["start"] : span["end"]]
                kept.append(b" ".join(words))
            columns = [*batch.columns[:-1], pa.array(n, pa.int64()), batch.columns[-1], pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(cut, schema)
