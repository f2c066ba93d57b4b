"""Language identification by rank-order profiles.

The n-grams (n = 1 to 3) of a text's words, with a mark at word ends, are ranked by frequency. A language's
profile is the ranking of the n-grams of all its training texts, cut at `profile` ranks. A text goes to the
language whose profile is nearest by out-of-place distance: the sum over the text's `profile` most frequent
n-grams of how many ranks each is out of place, `profile` ranks for one that the language doesn't list.

Texts are cased down and read whole; counts cover all training texts and are summed in Spark. The ranking is cut
in two steps, within 16 groups of n-grams a language, then among those, so at most 16 * profile rows a language
reach the driver; more than `languages` languages are refused, as tables are sent to every task.

Defined results: text that is null or has no letter is `und` with score 0, as is everything if nothing could be
learned; ties of frequency go to the smaller n-gram by code points, ties of distance to the language that sorts
first; rows without language or doc_id teach nothing; repeated rows count as often as they are there; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded

_EDGE = 1  # the code of a word's end; no letter has it
_PIECE = 1 << 21
_HELD = 1 << 20  # counted n-grams a task holds before it hands them on
_GROUPS = 16
_END = re.compile(r"[\W\d_]")


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _pieces(text: str) -> Iterator[str]:
    start = 0
    while start < len(text):
        cut = _END.search(text, start + _PIECE) if start + _PIECE < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end


def _grams(piece: str) -> np.ndarray:
    """The n-grams of a text as numbers: three code points of 21 bits, the first ones 0 for shorter n-grams."""
    codes = np.frombuffer(piece.lower().encode("utf-32-le"), np.uint32)
    codes = np.where(_letters()[codes], codes, _EDGE).astype(np.int64)
    codes = np.concatenate([[_EDGE], codes, [_EDGE]])
    codes = codes[np.append(True, (codes[1:] != _EDGE) | (codes[:-1] != _EDGE))]
    if len(codes) < 3:
        return np.empty(0, np.int64)
    two = codes[:-1] << 21 | codes[1:]
    three = (two[:-1] << 21 | codes[2:])[codes[1:-1] != _EDGE]
    return np.concatenate([codes[codes != _EDGE], two, three])


def counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Several counts as one, by ascending n-gram."""
    grams, counts = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])[: len(grams)])
    return grams[first], np.add.reduceat(counts[order], first) if len(first) else counts


def count_grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of a whole text, ascending, and their numbers."""
    parts = []
    for piece in _pieces(text or ""):
        grams = np.sort(_grams(piece))
        first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])[: len(grams)])
        parts.append((grams[first], np.diff(np.append(first, len(grams)))))
    return counted(parts) if len(parts) > 1 else parts[0] if parts else (np.empty(0, np.int64), np.empty(0, np.int64))


def ranked(grams: np.ndarray, counts: np.ndarray, profile: int) -> np.ndarray:
    return grams[np.lexsort((grams, -counts))[:profile]]


class Profiles:
    """Rankings of all languages, side by side."""

    def __init__(self, rankings: dict[str, np.ndarray], profile: int):
        self.names, self.profile = sorted(rankings), profile
        self.grams = np.unique(np.concatenate([rankings[n] for n in self.names])) if rankings else np.empty(0, np.int64)
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), -1, np.int32)
        for k, n in enumerate(self.names):
            self.ranks[np.searchsorted(self.grams, rankings[n]), k] = np.arange(len(rankings[n]))

    def nearest(self, text: str | None) -> tuple[str, float]:
        """The language and 1 - its distance as a share of the largest possible one."""
        own = ranked(*count_grams(text), self.profile)
        if not len(own) or not len(self.grams):
            return "und", 0.0
        at = np.searchsorted(self.grams, own)
        at[self.grams[np.minimum(at, len(self.grams) - 1)] != own] = len(self.grams)
        ranks = self.ranks[at]
        out = np.where(ranks < 0, self.profile, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(out.argmin())
        return self.names[best], 1 - float(out[best]) / (self.profile * len(own))


def learned_on(doc_id: Column) -> Column:
    """Rows that may teach: crc32 of the id as text is not 0 modulo 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def train(docs: DataFrame, profile: int = 400, languages: int = 1000) -> Profiles:
    """Profiles of all languages of docs (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def out():
            for lang, parts in held.items():
                grams, counts = counted(parts)
                columns = [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = count_grams(text)
                size += len(found[0])
                held.setdefault(lang, []).append(found)
            if size > _HELD:
                for lang, parts in held.items():
                    held[lang] = [counted(parts)]
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > _HELD // 2:
                    yield from out()
                    size = 0
        yield from out()

    known = docs.where(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    sums = known.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sums = sums.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(_GROUPS)))
    nth = F.expr("row_number() over (partition by lang, part order by n desc, gram)")
    rows = sums.withColumn("nth", nth).where(F.col("nth") <= profile).select("lang", "gram", "n")
    if not bounded(known.select("lang").distinct(), languages):
        raise ValueError(f"more than {languages} languages")
    found = rows.toArrow()
    names = found.column("lang").to_numpy(zero_copy_only=False)
    grams, counts = (found.column(c).to_numpy() for c in ("gram", "n"))
    return Profiles({n: ranked(grams[names == n], counts[names == n], profile) for n in sorted(set(names))}, profile)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """All rows and columns of docs, lang_pred and score, which replace columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    own = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    at = own.index("text")
    schema = T.StructType([docs.schema[c] for c in own] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.nearest(t) for t in batch.column(at).to_pylist()]
            names, scores = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.select(*(F.col(f"`{c}`") for c in own)).mapInArrow(run, schema)
