"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Vectors are packed in blocks. A block keeps, for each dimension, its list of vectors sorted by that component.
A query reads all lists of a block in step, from the end that its own component's sign makes best. What it has
read of a vector is exact; what it has not read lies between the list's worst value and the value just read,
which bounds each vector's score from below and above. Reading goes on in rounds of growing depth until k vectors
have lower bounds that no other vector's upper bound reaches; then only the scores of the vectors that can still
be among the k are resolved. A round works on all queries of a block at once, as matrix products: components read
so far times the query, plus the list's bound times what is not read.

Queries are a stated set: those rows are packed too, in groups of at most a number of bytes, and the blocks are dealt
to parts. A task has one group and one part: it holds its queries and the k best that each has so far, and its blocks
pass one after the other, so a list is sorted once a task and the worst of the k best stops the reading of later
blocks. Each group meets each part once; a meeting yields k rows a query, of which a window keeps the k best over all
parts. Some queries try the rounds first; where their bounds part only at the end of the lists, as in dense vectors,
the others of the block read on to the end at once, which is one product. What moves is every block once a group and
every query once a part; the driver gets counts.

Components x become floor(scale * x) as integers, so scores are exact: float32 or float64 products where no sum
can leave their exact integers, else Python integers.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; a query meets
every row but its own, also rows of equal id or content; equal scores go to the smaller id (null ids last), then
to the row first read; vectors of different lengths are padded with zeros; a query without candidates has no
row; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

_BLOCK = "block bigint, width int, kind string, ids binary, known binary, data binary"
_QUERY = "block bigint, width int, kind string, at binary, ids binary, data binary"
_FOUND = "query_id bigint, query_block bigint, query_at int, vec_id bigint, vec_block bigint, vec_at int, score bigint"
_LAST = (1 << 63) - 1
_NONE = -(1 << 62)
_TRY = 8  # queries that try the rounds in each block before the others
_SCORES = 1 << 20  # of one product, so that they are still in the cache when they are looked through


def _narrow(data: np.ndarray) -> np.ndarray:
    most = int(np.abs(data).max(initial=0))
    return data.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def _rows(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _integers(lists: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors that take part, padded with zeros to the longest, and their rows."""
    sizes = lists.value_lengths().fill_null(0).to_numpy()
    values = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))  # nulls become NaN
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = (sizes > 0) & (bad[ends] == bad[ends - sizes])
    values = values[np.repeat(good, sizes)]
    if len(values) and np.abs(values).max() >= 1 << 62:
        raise ValueError("a component is too large for a 64-bit integer")
    taken = np.flatnonzero(good)
    data = np.zeros((len(taken), int(sizes[taken].max(initial=0))), np.int64)
    data[np.arange(data.shape[1]) < sizes[taken][:, None]] = values
    return data, taken


def blocks(vectors: DataFrame, vec_id: str, embedding: str, rows: int, scale: int) -> DataFrame:
    """Vectors that take part, as integers, in packed blocks of up to `rows`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        number, base = 0, 0

        def out(last: bool = False) -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            while (size := sum(len(ids) for ids, _, _ in held)) and (last or size >= rows):
                width = max(data.shape[1] for _, _, data in held)
                data = np.concatenate([np.pad(data, ((0, 0), (0, width - data.shape[1]))) for _, _, data in held])
                ids, known = (np.concatenate([h[i] for h in held]) for i in (0, 1))
                held = [(ids[rows:], known[rows:], data[rows:])]
                data = data[:rows]
                while width > 1 and not data[:, width - 1].any():
                    width -= 1  # padding of longer vectors in other blocks
                data = _narrow(data[:, :width])
                row = (base << 32 | number, width, data.dtype.name, ids[:rows].tobytes(), known[:rows].tobytes(), data.tobytes())
                number += 1
                yield _rows([[x] for x in row], _BLOCK)

        for batch in batches:
            ids, lists, part = batch.columns
            data, taken = _integers(lists, scale)
            if len(taken):
                base = part[0].as_py()
                known = ids.is_valid().to_numpy(zero_copy_only=False)[taken]
                held.append((ids.fill_null(_LAST).to_numpy()[taken], known, data))
                yield from out()
        yield from out(last=True)

    picked = vectors.select(F.col(vec_id).cast("bigint"), F.col(embedding).cast("array<double>"), F.spark_partition_id())
    return picked.mapInArrow(run, _BLOCK)


def _queries(packed: DataFrame, every: int) -> DataFrame:
    """The rows of the packed blocks whose id is divisible by `every`, packed by their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, width, kind, ids, known, data in zip(*(c.to_pylist() for c in batch.columns)):
                ids, known = np.frombuffer(ids, np.int64), np.frombuffer(known, bool)
                data = np.frombuffer(data, kind).reshape(len(ids), width)
                at = np.flatnonzero(known & (ids % every == 0))
                if len(at):
                    row = (block, width, kind, at.astype(np.int32).tobytes(), ids[at].tobytes(), data[at].tobytes())
                    yield _rows([[x] for x in row], _QUERY)

    return packed.mapInArrow(run, _QUERY)


def _kind(queries: np.ndarray, data: np.ndarray) -> type:
    """The cheapest number type in which no partial sum can be inexact."""
    largest = float(np.abs(queries).max()) * float(np.abs(data).max()) * queries.shape[1]
    return np.float32 if largest < 1 << 23 else np.float64 if largest < 1 << 52 else object


class Lists:
    """The sorted lists of one block of vectors."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.order = np.argsort(data, axis=0, kind="stable")
        self.sorted = np.take_along_axis(data, self.order, axis=0)
        self.place = np.empty_like(self.order)
        np.put_along_axis(self.place, self.order, np.arange(len(data))[:, None], axis=0)
        self.read: np.ndarray | None = None

    def whole(self, kind: type) -> np.ndarray:
        """All components, [dimensions, vectors]."""
        if self.read is None or self.read.dtype != np.dtype(kind):
            self.read = np.ascontiguousarray(self.data.T.astype(kind))
        return self.read

    def bounds(self, queries: np.ndarray, depth: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds [queries, vectors] after `depth` reads of every list."""
        n = len(self.data)
        if depth >= n:
            exact = queries.astype(kind) @ self.whole(kind)
            return exact, exact
        up, down = np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)
        lower = upper = None
        for own, seen, value, worst in (
            (up, self.place >= n - depth, self.sorted[max(n - depth, 0)], self.sorted[0]),
            (down, self.place < depth, self.sorted[min(depth, n) - 1], self.sorted[-1]),
        ):
            read = own @ np.where(seen, self.data, 0).astype(kind).T
            unread = (~seen).astype(kind).T
            low, high = read + (own * worst.astype(kind)) @ unread, read + (own * value.astype(kind)) @ unread
            lower, upper = (low, high) if lower is None else (lower + low, upper + high)
        return lower, upper


def _low(kind: type) -> float | int:
    """Below all scores, for a query's own row."""
    return -np.inf if kind is not object else -(1 << 200)


def _any(kind: type) -> float | int:
    """What every score reaches, but not a query's own row."""
    return np.finfo(kind).min if kind is not object else -(1 << 199)


def _reaching(scores: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and positions of the scores that reach their row's `least` and, by score, its k-th best."""
    rows = np.flatnonzero(scores.max(axis=1) >= least)
    part = scores[rows] if len(rows) < len(scores) else scores
    can = part >= least[rows, None]
    many = np.flatnonzero(np.count_nonzero(can, axis=1) > 4 * k)
    if len(many):
        most = min(k, scores.shape[1])
        can[many] &= part[many] >= _kth(part[many], most)[:, None]
    row, at = np.divmod(np.flatnonzero(can.ravel()), scores.shape[1])
    return rows[row], at


def _kth(lower: np.ndarray, most: int) -> np.ndarray:
    n = lower.shape[1]
    return np.partition(lower, n - most, axis=1)[:, n - most] if lower.dtype != object else np.sort(lower, axis=1)[:, n - most]


def candidates(
    queries: np.ndarray, lists: Lists, own: np.ndarray, k: int, depth: int, least: np.ndarray, kind: type
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Queries, positions and scores of all pairs that can be among a query's k best and reach its `least`, with the
    depth at which they were told from the others."""
    n = len(lists.data)
    left, depth = np.arange(len(queries)), min(depth, n)
    while len(left):
        lower, upper = lists.bounds(queries[left], depth, kind)
        has_own = np.flatnonzero(own[left] >= 0)
        out = own[left][has_own]
        lower[has_own, out] = _low(kind)
        if depth >= n:
            row, at = _reaching(lower, least[left], k)
            yield left[row], at, lower[row, at], depth
            return
        upper[has_own, out] = _low(kind)
        kth = np.maximum(_kth(lower, min(k, n)), least[left])
        can = (upper >= kth[:, None]).astype(bool)
        can[has_own, out] = False
        done = can.sum(axis=1) <= 4 * k  # few outsiders can still qualify: resolve what is left
        for row in np.flatnonzero(done):
            q, at = left[row], np.flatnonzero(can[row])
            yield np.full(len(at), q), at, lists.data[at].astype(kind) @ queries[q].astype(kind), depth
        left, depth = left[~done], min(n, depth * 4)


def search(
    queries: np.ndarray, lists: Lists, ids: np.ndarray, own: np.ndarray, k: int, first_depth: int = 64
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each query with its k best vectors (positions) and their scores. own: the query's own position, or -1.

    ids order equal scores.
    """
    kind = _kind(queries, lists.data)
    least = np.full(len(queries), _any(kind), kind)
    for rows, at, exact, _ in candidates(queries, lists, own, k, first_depth, least, kind):
        for q in np.unique(rows):
            mine = np.flatnonzero(rows == q)
            best = np.array(sorted(mine, key=lambda j: (-exact[j], ids[at[j]])), int)[:k]
            yield int(q), at[best], exact[best]


class Asked:
    """The queries of one task, with the k best vectors that each has met so far."""

    def __init__(self, packs: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], k: int):
        """packs: block, positions in it, ids and vectors of some queries."""
        self.k = k
        self.block = np.concatenate([np.full(len(at), block, np.int64) for block, at, _, _ in packs])
        self.at, self.ids = (np.concatenate([p[i] for p in packs]) for i in (1, 2))
        kind = max((data.dtype for _, _, _, data in packs), key=lambda t: t.itemsize)
        self.data = np.zeros((len(self.at), max(p[3].shape[1] for p in packs)), kind)
        start = 0
        for *_, data in packs:
            self.data[start : start + len(data), : data.shape[1]] = data
            start += len(data)
        size = (len(self.at), k)
        self.score = np.full(size, _NONE, np.int64)
        self.found = {"unknown": np.ones(size, bool), "id": np.zeros(size, np.int64), "block": np.full(size, -1, np.int64), "at": np.zeros(size, np.int32)}

    def meet(self, block: int, ids: np.ndarray, known: np.ndarray, data: np.ndarray, rows: int) -> None:
        """All queries, at most `rows` at a time, with one block of vectors."""
        rows = min(rows, max(_TRY, _SCORES // len(data)))
        width = min(self.data.shape[1], data.shape[1])  # what lies beyond is zero in one of them
        data = data[:, :width]
        lists, kind = Lists(data), _kind(self.data[:, :width], data)
        if kind is object and self.score.dtype != object:
            self.score = self.score.astype(object)
            self.score[self.found["block"] < 0] = _any(object)
        own = np.where(self.block == block, self.at, -1)
        start, depth = 0, 64
        while start < len(own):
            end = start + (rows if start else min(rows, _TRY))
            least, deepest = np.maximum(self.score[start:end, -1].astype(kind), _any(kind)), 0
            for row, at, exact, deep in candidates(self.data[start:end, :width], lists, own[start:end], self.k, depth, least, kind):
                self.keep(row + start, exact, block, at, ids, known)
                deepest = max(deepest, deep)
            if not start and deepest >= len(data):
                depth = len(data)
            start = end

    def keep(self, row: np.ndarray, exact: np.ndarray, block: int, at: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        """The k best of each row, of those so far and the given ones."""
        score = exact if exact.dtype == object else exact.astype(np.int64).astype(self.score.dtype)
        unknown, of = ~known[at], ids[at]
        last = {name: x[row, -1] for name, x in self.found.items()}
        behind = (unknown > last["unknown"]) | ((unknown == last["unknown"]) & (of > last["id"]))
        equal = (score == self.score[row, -1]).astype(bool) & (last["block"] >= 0)
        new = np.flatnonzero(~(equal & behind))
        if not len(new):
            return
        row, at = row[new], at[new]
        touched = np.unique(row)
        rows = np.concatenate([np.repeat(touched, self.k), row])
        score = np.concatenate([self.score[touched].ravel(), score[new]])
        given = {"unknown": unknown[new], "id": of[new], "block": np.full(len(new), block), "at": at}
        found = {name: np.concatenate([x[touched].ravel(), given[name].astype(x.dtype)]) for name, x in self.found.items()}
        # A place that is still free has the lowest score of all.
        down = -score if score.dtype != object else np.unique(-score, return_inverse=True)[1]
        order = np.lexsort((found["at"], found["block"], found["id"], found["unknown"], down, rows))
        rows = rows[order]
        first = np.searchsorted(rows, touched)
        best = order[first[:, None] + np.arange(self.k)]
        self.score[touched] = score[best]
        for name, x in self.found.items():
            x[touched] = found[name][best]

    def rows(self, size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        row, place = np.nonzero(self.found["block"] >= 0)
        for i in range(0, len(row), size):
            r, p = row[i : i + size], place[i : i + size]
            unknown, of, block, at = (x[r, p] for x in self.found.values())
            of = pa.array(of, pa.int64(), mask=unknown)
            yield _rows([self.ids[r], self.block[r], self.at[r], of, block, at, self.score[r, p]], _FOUND)


def _dealt(over: int) -> Column:
    """A number under `over` for each block: those of a partition one after the other, from another start in each."""
    return F.pmod(F.shiftright("block", 32) + F.col("block").bitwiseAND(F.lit((1 << 32) - 1)), F.lit(over)).cast("int")


def top_k(
    vectors: DataFrame,
    every: int = 50,
    k: int = 5,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    scale: int = 256,
    block_rows: int = 4096,
    query_rows: int = 512,
    group_bytes: int = 32 << 20,
) -> DataFrame:
    """query_id, query_row (tells queries of one id apart), rank from 1, vec_id and score of the k best.

    Queries are the rows whose id is divisible by `every`. query_rows of them meet block_rows vectors at a time;
    group_bytes bounds the queries, and the vectors, that one task is given.
    """
    spark = vectors.sparkSession
    packed = stage(blocks(vectors, vec_id, embedding, block_rows, scale), "vectors")
    single = stage(_queries(packed, every), "queries")
    number, held = packed.agg(F.count("block"), F.sum(F.length("data"))).first()
    asking = single.agg(F.sum(F.length("data"))).first()[0]
    groups = max(1, -(-(asking or 0) // group_bytes))
    parts = max(1, -(-(held or 0) // group_bytes), -(-4 * spark.sparkContext.defaultParallelism // groups))
    parts = min(parts, max(1, number))
    nothing = F.lit(None).cast("binary")
    every_part, every_group = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("to") for n in (parts, groups))
    asks = single.select("*", every_part).select(
        (_dealt(groups) * F.lit(parts) + F.col("to")).alias("task"), F.lit(0).alias("what"), "block", "width", "kind", "ids", "at", nothing.alias("known"), "data"
    )
    given = packed.select("*", every_group).select(
        (F.col("to") * F.lit(parts) + _dealt(parts)).alias("task"), F.lit(1).alias("what"), "block", "width", "kind", "ids", nothing.alias("at"), "known", "data"
    )
    dealt = asks.union(given).repartitionById(groups * parts, F.col("task")).sortWithinPartitions("task", "what", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, packs, asked = None, [], None
        for batch in batches:
            for row in range(batch.num_rows):
                task, what, block, width, kind = (c[row].as_py() for c in batch.columns[:5])
                ids, at, known, data = (c[row].as_buffer() if c[row].is_valid else None for c in batch.columns[5:])
                if task != last:
                    if asked:
                        yield from asked.rows()
                    last, packs, asked = task, [], None
                ids = np.frombuffer(ids, np.int64)
                data = np.frombuffer(data, kind).reshape(len(ids), width)
                if not what:
                    packs.append((block, np.frombuffer(at, np.int32), ids, data))
                elif packs or asked:
                    if not asked:
                        packs, asked = [], Asked(packs, k)
                    asked.meet(block, ids, np.frombuffer(known, bool), data, query_rows)
        if asked:
            yield from asked.rows()

    found = dealt.mapInArrow(run, _FOUND)
    rank = F.expr("row_number() over (partition by query_block, query_at order by score desc, vec_id asc nulls last, vec_block, vec_at)")
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", F.concat_ws(":", "query_block", "query_at").alias("query_row"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
