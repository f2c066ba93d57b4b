"""SimHash near-duplicates: whole-text fingerprints, linked exactly by vantage-point trees, grouped by links.

A link is a pair of fingerprints with at most `radius` differing bits. Equal fingerprints are one point.

Shards. A vantage-point split of the whole 64 bits at the median distance keeps little apart at radius 4:
distances to any vantage point lie within 32 +- 4 and the triangle bound sends most points to both sides.
So the first level bounds distance within blocks of bits: radius + 1 blocks, of which a link leaves at least
one untouched, so both ends have the same distance, by block, to every vantage point. That makes the block's
value the shard, without overlap. A shard of more than `shard_rows` points is split further by rings of
distance to one of its points; points within `radius` of a ring's edge are also put in the next ring, so every
pair meets. Inside a shard a task searches a vantage-point tree, cutting branches by the triangle bound, and
emits a spanning star for each connected set instead of all its pairs.

Groups. Stars of all shards are joined by alternating large-star and small-star steps on tables; no link,
component or fingerprint goes to the driver.

Defined results: null or wordless text has fingerprint 0 and is linked like any other; repeated rows come
back as often as they are there; a null doc_id takes part but never names a group that has another id; an
empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hashed_share, passing_tables, small, stage, word_pieces
from .substring_dedup import window_hashes, word_hashes

#: xxHash seed of the shingles.
SEED = 42
_LEAF = 256


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The 64-bit fingerprint of a text: a bit is set if it is set in over half of the shingle hashes."""
    ones, total, tail = np.zeros(64, np.int64), 0, []
    for words in word_pieces((text or b"").lower()):
        words = tail + words
        if len(words) >= shingle:
            shingles = map(b" ".join, zip(*(islice(words, k, None) for k in range(shingle))))
            digests = b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED)))
            bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
            ones += bits.sum(axis=0, dtype=np.int32)
            total += len(bits)
            tail = words[len(words) - shingle + 1 :]
        else:
            tail = words
    if not total:
        if not tail:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id, mark (xxhash64 of the text, which tells rows of one doc_id apart) and fp (signed) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found.view(np.int64))], names=["doc_id", "mark", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).cast("binary").alias("text"))
    return picked.mapInArrow(run, f"doc_id {kind}, mark bigint, fp bigint")


class _Groups:
    """Connected sets of the points of one shard."""

    def __init__(self, points: np.ndarray):
        self.points, self.of = points, np.arange(len(points))

    def unite(self, members: np.ndarray) -> None:
        labels = np.unique(self.of[members])
        if len(labels) > 1:
            self.of[np.isin(self.of, labels)] = labels[0]

    def compare(self, a: np.ndarray, b: np.ndarray, radius: int) -> None:
        for start in range(0, len(a), _LEAF):
            part = a[start : start + _LEAF]
            near = np.bitwise_count(self.points[part][:, None] ^ self.points[b][None, :]) <= radius
            near &= self.of[part][:, None] != self.of[b][None, :]
            for i in np.flatnonzero(near.any(axis=1)):
                self.unite(np.append(b[near[i]], part[i]))


def search(points: np.ndarray, radius: int) -> np.ndarray:
    """For each of the distinct points, the position of its group's first point; exact, by vantage-point trees."""
    groups = _Groups(points)
    work: list[tuple[np.ndarray, np.ndarray | None]] = [(np.arange(len(points)), None)]
    while work:
        a, b = work.pop()
        if not len(a) or (b is not None and not len(b)):
            continue
        if len(a) <= _LEAF:
            groups.compare(a, a if b is None else b, radius)
            continue
        vantage = points[a[len(a) // 2]]
        of_a = np.bitwise_count(points[a] ^ vantage)
        middle = int(np.median(of_a))
        inner = of_a <= middle
        if inner.all():  # half of them at the largest distance: split below it
            middle -= 1
            inner = of_a <= middle
        if not inner.any():  # all at one distance from this point, which is among them only if they are equal
            groups.compare(a, a if b is None else b, radius)
            continue
        groups.unite(a[of_a <= radius])
        if b is None:
            work.append((a[inner], None))
            work.append((a[~inner], None))
            work.append((a[inner & (of_a > middle - radius)], a[~inner & (of_a <= middle + radius)]))
        else:
            of_b = np.bitwise_count(points[b] ^ vantage)
            groups.unite(np.concatenate([a[of_a <= radius], b[of_b <= radius]]))
            work.append((a[inner], b[of_b <= middle + radius]))
            work.append((a[~inner], b[of_b > middle - radius]))
    return groups.of


def _blocks(radius: int, bits: int = 64) -> list[tuple[int, int]]:
    edges = np.linspace(0, bits, radius + 2).astype(int)
    return [(int(a), int(b - a)) for a, b in zip(edges, edges[1:])]


def _split(shards: DataFrame, shard_rows: int, radius: int, rounds: int) -> DataFrame:
    """Shards with over shard_rows points, split by rings of distance to one of their points."""
    for turn in range(rounds):
        large = (
            shards.groupBy("shard")
            .agg(F.count("*").alias("n"), F.max_by("fp", F.xxhash64("fp", F.lit(turn))).alias("vantage"))
            .where(F.col("n") > shard_rows)
            .select("shard", "vantage")
        )
        large = stage(large, "simhash-large")
        if large.isEmpty():
            return shards
        ring, far = F.expr("bit_count(fp ^ vantage)"), 2 * radius + 1
        joined = shards.join(large, "shard", "left")
        rings = F.when(F.col("vantage").isNull(), F.array(F.lit(-1))).otherwise(
            F.when(ring % far > radius, F.array(F.floor(ring / far), F.floor(ring / far) + 1))
            .otherwise(F.array(F.floor(ring / far)))
            .cast("array<int>")
        )
        shards = stage(
            joined.select("shard", "fp", F.explode(rings).alias("ring")).select(
                F.when(F.col("ring") < 0, F.col("shard"))
                .otherwise(F.concat_ws("/", "shard", F.col("ring").cast("string")))
                .alias("shard"),
                "fp",
            ),
            "simhash-shards",
        )
    return shards


def links(points: DataFrame, radius: int = 4, shard_rows: int = 50_000, rounds: int = 8) -> DataFrame:
    """Stars (fp, root) that connect all points (distinct fp) with at most radius differing bits.

    Shards still larger than shard_rows after `rounds` splits (points so alike that rings do not part them) are
    searched whole in one task, which takes time, not correctness: a point is 8 bytes.
    """
    values = [
        F.concat_ws("/", F.lit(str(k)), F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << size) - 1)).cast("string"))
        for k, (start, size) in enumerate(_blocks(radius))
    ]
    shards = _split(points.select(F.explode(F.array(*values)).alias("shard"), "fp"), shard_rows, radius, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            found = np.unique(found)
            root = search(found.view(np.uint64), radius)
            other = root != np.arange(len(found))
            return found[other], found[root[other]]

        last, kept = None, []
        for batch in batches:
            names = batch.column(0).to_pylist()
            fps = batch.column(1).to_numpy(zero_copy_only=False)
            out, start = [], 0
            for end in range(len(names)):
                if names[end] != last:
                    kept.append(fps[start:end])
                    if sum(map(len, kept)) > 1:
                        out.append(stars(np.concatenate(kept)))
                    last, kept, start = names[end], [], end
            kept.append(fps[start:].copy())
            if out:
                a, b = (np.concatenate([x[k] for x in out]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["fp", "root"])
        if sum(map(len, kept)) > 1:
            a, b = stars(np.concatenate(kept))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["fp", "root"])

    return shards.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "fp bigint, root bigint")


def components(edges: DataFrame, a: str = "fp", b: str = "root") -> DataFrame:
    """node and root: every node of the edges but the roots, and its component's smallest node."""
    edges = edges.where(F.col(a) != F.col(b))
    edges = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = stage(small.where("u != v").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4, shard_rows: int = 50_000
) -> DataFrame:
    """doc_id, mark, fp, component_id (the smallest doc_id that links reach) and root (one fingerprint of all it has) of every row."""
    found = stage(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    points = stage(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    stars = components(links(points.select("fp"), radius, shard_rows))
    rooted = points.join(stars.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(named, "root").select("fp", "component_id", "root")
    return found.join(named, "fp").select("doc_id", "mark", "fp", "component_id", "root")


#: Words of a parity bitmap of a shingle set, 64 bits each.
_PARITY = 16
#: Shingles that are put last, at most: the frequent ones of a sample of the rows.
_FREQUENT = 1 << 16
_SIDES = "row bigint, doc_id {}, mark bigint, fp bigint, words int, sequence bigint, size int, parity array<bigint>, prefix array<bigint>, shingles binary"


def _shingle_hashes(body: bytes | None, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's words, and the sorted set of those of its shingles (fewer words: of the whole sequence)."""
    words = np.concatenate([np.empty(0, np.uint64), *(word_hashes(w) for w in word_pieces((body or b"").lower()) if w)])
    return words, np.unique(window_hashes(words, min(shingle, max(len(words), 1))))


def _frequent_shingles(docs: DataFrame, doc_id: str, text: str, shingle: int, least_rows: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that occur in four rows or more of a sample (a sixteenth of the rows, `least_rows` at
    least), and the binary logarithm of their counts. They only order shingles: any choice finds the same links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_shingle_hashes(body, shingle)[1] for body in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())], names=["token"])

    total = docs.count()
    drawn = docs.where(hashed_share(F.xxhash64(doc_id, text), max(total // 16, least_rows), total))
    tokens = drawn.select(F.col(text).cast("binary").alias("text")).mapInArrow(run, "token bigint")
    often = tokens.groupBy("token").agg(F.floor(F.log2(F.count("*"))).cast("int").alias("level")).where("level >= 2")
    often = stage(often, "frequent")
    least, held = 64, 0
    for level, n in sorted(often.groupBy("level").count().collect(), reverse=True):  # one row a level, 64 at most
        if held + n > _FREQUENT:
            break
        least, held = level, held + n
    rows = sorted((r[0] % (1 << 64), r[1]) for r in often.where(F.col("level") >= least).collect())
    return np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int8)


def _prefix(found: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first elements of a sorted set, by frequency and then value, so many that two sets of that similarity or
    more always share one of them: a set may lack at most a share of 1 - similarity of its own in the other."""
    if not len(found):
        return found
    level = np.zeros(len(found), np.int8)
    if len(frequent[0]):
        at = np.minimum(np.searchsorted(frequent[0], found), len(frequent[0]) - 1)
        level = np.where(frequent[0][at] == found, frequent[1][at], level)
    needed = math.ceil(similarity * len(found) - 1e-9)
    return found[np.argsort(level, kind="stable")][: len(found) - needed + 1]


def _parity(short: np.ndarray) -> np.ndarray:
    """For each of some 1,000 bits whether an odd number of elements have it: sets differ in an element at least for
    each bit in which their bitmaps differ."""
    odd = np.bincount(short % (64 * _PARITY), minlength=64 * _PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sides(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, frequent: tuple = ((), ())
) -> DataFrame:
    """What near_copies compares of each row: fingerprint, hash of the word sequence, shingle set (32 bits each), its
    parity bitmap and its prefix."""
    frequent = (np.array(frequent[0], np.uint64), np.array(frequent[1], np.int8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        names = ["fp", "words", "sequence", "size", "parity", "prefix", "shingles"]
        for batch in batches:
            rows = []
            for body in batch.column(3).to_pylist():
                words, found = _shingle_hashes(body, shingle)
                whole = int(window_hashes(words, len(words))[0]) if len(words) else 0
                fp = fingerprint(body, shingle)
                signed = lambda x: np.asarray(x, np.uint64).view(np.int64)
                short = np.unique((found >> np.uint64(32)).astype("<u4"))
                prefix = signed(_prefix(found, frequent, similarity))
                rows.append((int(signed(fp)), len(words), int(signed(whole)), len(short), _parity(short), prefix, short.tobytes()))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["row", "doc_id", "mark", *names])

    kind = docs.schema[doc_id].dataType.simpleString()
    picked = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).cast("binary").alias("text"))
    return picked.mapInArrow(run, _SIDES.format(kind))


def _may_be_similar(size_u, at_u, size_v, at_v, similarity: float):
    """Whether sets of these sizes may have the similarity, if these places are of the first element they share."""
    low, high = np.minimum(size_u, size_v), np.maximum(size_u, size_v)
    left = 1 + np.minimum(size_u - at_u - 1, size_v - at_v - 1)
    return (low >= similarity * high - 1e-6) & (left >= similarity / (1 + similarity) * (size_u + size_v) - 1e-6)


def _prefix_pairs(units: DataFrame, similarity: float, paired: int) -> DataFrame:
    """u, v, token: pairs of rows that share a shingle of their prefixes (token null). Of a shingle that more than
    `paired` rows share, each row with the first and the last of them, and the rows themselves (v null)."""

    def group_pairs(token: np.ndarray, row: np.ndarray, size: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        lengths = np.diff(np.append(starts, len(token)))
        left, right, members = [], [], []
        for length in np.unique(lengths[lengths > 1]):
            first = starts[lengths == length]
            if length <= paired:
                a, b = np.triu_indices(length, 1)
                left.append((first[:, None] + a).ravel())
                right.append((first[:, None] + b).ravel())
                continue
            for start in first:
                every = np.arange(start, start + length)
                for leader in (row[every].argmin(), row[every].argmax()):
                    left.append(every)
                    right.append(np.full(length, start + leader))
                members.append(every)
        if not left:
            return
        left, right, members = np.concatenate(left), np.concatenate(right), np.concatenate([np.empty(0, np.int64), *members])
        keep = _may_be_similar(size[left], at[left], size[right], at[right], similarity) & (row[left] != row[right])
        u, v = row[left[keep]], row[right[keep]]
        n, m = len(u), len(members)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.maximum(u, v), row[members]])),
                pa.array(np.concatenate([np.minimum(u, v), np.zeros(m, np.int64)]), mask=np.arange(n + m) >= n),
                pa.array(np.concatenate([np.zeros(n, np.int64), token[members]]), mask=np.arange(n + m) < n),
            ],
            names=["u", "v", "token"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # rows of the last shingle so far

        def done(more: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            whole = [np.concatenate(c) for c in zip(*held, more)]
            held.clear()
            yield from group_pairs(*whole)

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(columns[0]):
                continue
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            if cut or (held and held[-1][0][-1] != columns[0][0]):
                yield from done([c[:cut] for c in columns])
            held.append([c[cut:].copy() for c in columns])
        if held:
            yield from done([c[:0] for c in held[-1]])

    tokens = units.select(F.posexplode("prefix").alias("at", "token"), "row", "size").select("token", "row", "size", "at")
    return tokens.repartition("token").sortWithinPartitions("token").mapInArrow(run, "u bigint, v bigint, token bigint")


def _rest(members: DataFrame, units: DataFrame, sets: DataFrame, stars: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links (u, v) that connect the rows of large groups (of `token`) as all links between them do.

    Rows that `stars` connect need no further link. A group whose rows are all connected is done, and groups of the same
    rows are one. Others are cut, in order of size and component, into blocks; blocks whose sizes admit a link and that
    hold more than one component meet in a task each, which compares all their pairs by matrix products.
    """
    root = F.coalesce("root", "row").alias("root")
    named = members.join(stars.withColumnRenamed("node", "row"), "row", "left").select("token", "row", root)
    groups = named.groupBy("token").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("one"),
        F.sum(F.xxhash64(F.lit(1), "row").cast("decimal(38,0)")).alias("two"), F.min("root").alias("low"), F.max("root").alias("high"),
    )
    open_groups = groups.where("low < high").groupBy("n", "one", "two").agg(F.min("token").alias("token")).select("token")
    band = F.floor(F.log(F.col("size").cast("double")) / math.log(1 / similarity))
    place = F.row_number().over(Window.partitionBy("token").orderBy(band, "root", "size", "row"))
    placed = named.join(open_groups, "token", "left_semi").join(units.select("row", "size"), "row")
    placed = stage(placed.withColumn("block", F.floor((place - 1) / block).cast("int")), "large-groups")
    ranges = placed.groupBy("token", "block").agg(
        F.min("size").alias("least"), F.max("size").alias("most"), F.min("root").alias("low"), F.max("root").alias("high")
    )
    a, b = (ranges.select("token", *(F.col(c).alias(f"{c}_{side}") for c in ranges.columns[1:])) for side in "ab")
    fits = (F.col("most_b") >= F.lit(similarity) * F.col("least_a") - 1e-6) & (F.col("most_a") >= F.lit(similarity) * F.col("least_b") - 1e-6)
    open_pairs = F.least("low_a", "low_b") < F.greatest("high_a", "high_b")
    meetings = stage(a.join(b, "token").where((F.col("block_a") <= F.col("block_b")) & fits & open_pairs).select("token", "block_a", "block_b"), "meetings")
    here = placed.select("token", "block", "row", "root")
    first = here.join(meetings, (here["token"] == meetings["token"]) & (here["block"] == meetings["block_a"]))
    other = here.join(meetings, (here["token"] == meetings["token"]) & (here["block"] == meetings["block_b"])).where("block_a < block_b")
    columns = [meetings["token"], "block_a", "block_b", "row", "root"]
    met = first.select(*columns, F.lit(0).alias("side")).unionByName(other.select(*columns, F.lit(1).alias("side")))

    def run(table: pa.Table) -> pa.Table:
        rows, roots, side = (table.column(c).to_numpy() for c in ("row", "root", "side"))
        found = [np.frombuffer(x, "<u4") for x in table.column("shingles").to_pylist()]
        size = np.array([len(x) for x in found])
        values, column = np.unique(np.concatenate(found), return_inverse=True)
        at = np.repeat(np.arange(len(found)), size)
        shared = np.bincount(column) > 1
        number = np.cumsum(shared) - 1
        at, column = at[shared[column]], number[column[shared[column]]]
        order = np.argsort(column, kind="stable")
        at, column = at[order], column[order]
        both = np.zeros((len(found), len(found)), np.float32)
        for start in range(0, int(shared.sum()), 4096):
            a, b = np.searchsorted(column, (start, start + 4096))
            part = np.zeros((len(found), 4096), np.float32)
            part[at[a:b], column[a:b] - start] = 1
            both += part @ part.T
        near = both >= similarity * (size[:, None] + size[None, :] - both)
        of = np.unique(roots, return_inverse=True)[1]
        if side.any():
            near &= side[:, None] != side[None, :]
        u, v = [], []
        for i in np.flatnonzero(near.any(axis=1)):
            others = np.flatnonzero(near[i] & (of != of[i]))
            labels, one = np.unique(of[others], return_index=True)
            u += [rows[i]] * len(labels)
            v += list(rows[others[one]])
            of[np.isin(of, labels)] = of[i]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return met.join(sets, "row").groupBy("token", "block_a", "block_b").applyInArrow(run, "u bigint, v bigint")


def _similar(pairs: DataFrame, least: float) -> DataFrame:
    """The pairs whose shingle sets (of `shingles` and `other`) are at least so similar, by intersection and union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                a, b = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
                both = len(np.intersect1d(a, b, assume_unique=True))
                if both >= least * (len(a) + len(b) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)], names=["u", "v"])

    return pairs.select("u", "v", "shingles", "other").mapInArrow(run, "u bigint, v bigint")


def near_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8, shingle: int = 5, radius: int = 4,
    shard_rows: int = 50_000, paired: int = 64, block: int = 256,
) -> DataFrame:
    """doc_id, mark and root (one number for all rows of a group) of every row; groups are connected by links of texts
    whose sets of `shingle`-word shingles have the given similarity (Jaccard) or more: all such links, each verified.

    Candidates are the fingerprints that vantage-point trees connect within `radius` bits, and, since texts of
    similarity 0.8 may differ in ten bits, rows that share a shingle of their prefixes: the first fifth of a set, rarer
    shingles first, which two such sets always share one of. A shingle that up to `paired` rows share gives all pairs.
    Of one that more share, rows first meet two of them; those groups that this leaves in several components are then
    compared whole, block by block (_rest). Sizes, places in the prefix and parity bitmaps only drop pairs that cannot
    be similar; the others meet their shingle sets. Rows of one word sequence are one.
    """
    with passing_tables(docs.sparkSession):
        return stage(_near_copies(docs, doc_id, text, similarity, shingle, radius, shard_rows, paired, block), "near-copies", stays=True)


def _near_copies(docs: DataFrame, doc_id: str, text: str, similarity: float, shingle: int, radius: int, shard_rows: int, paired: int, block: int) -> DataFrame:
    frequent = _frequent_shingles(docs, doc_id, text, shingle)
    found = stage(sides(docs, doc_id, text, shingle, similarity, frequent), "sides")
    same = stage(found.groupBy("sequence", "words").agg(F.min("row").alias("unit"), F.count("*").alias("n")), "sequences")
    large = F.col("n") > found.count() // 1000  # under a thousand of them
    rows, keys = found.select("row", "doc_id", "mark", "sequence", "words"), ["sequence", "words"]
    hot = F.broadcast(same.where(large).drop("n"))
    of = rows.join(hot, keys).unionByName(rows.join(hot.drop("unit"), keys, "left_anti").join(same.where(~large).drop("n"), keys))
    of = stage(of.select("row", "doc_id", "mark", "unit"), "units")
    units = found.join(of.where("row = unit").select("row"), "row", "left_semi").where("words > 0")
    units = stage(units.select("row", "fp", "size", "parity", "prefix"), "unit-sides")

    points = stage(units.groupBy("fp").agg(F.min("row").alias("first")), "points")
    stars = links(points.select("fp"), radius, shard_rows)
    of_root = points.select(F.col("fp").alias("root"), F.col("first").alias("other"))
    near = stars.join(points, "fp").join(of_root, "root").select(F.greatest("first", "other").alias("u"), F.least("first", "other").alias("v"))
    equal = units.select("row", "fp").join(points, "fp").where("row > first").select(F.col("row").alias("u"), F.col("first").alias("v"))
    sharing = stage(_prefix_pairs(units, similarity, paired), "sharing")
    pairs = near.union(equal).union(sharing.where("v is not null").select("u", "v")).distinct()

    side = units.select("row", "size", "parity")
    judged = pairs.join(side.toDF("u", "size_u", "parity_u"), "u").join(side.toDF("v", "size_v", "parity_v"), "v")
    bits = F.zip_with("parity_u", "parity_v", lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    apart = F.aggregate(bits, F.lit(0), lambda total, n: total + n)
    even = F.least("size_u", "size_v") >= F.lit(similarity) * F.greatest("size_u", "size_v") - 1e-6
    most = F.lit((1 - similarity) / (1 + similarity)) * (F.col("size_u") + F.col("size_v")) + 1e-6
    judged = stage(judged.where(even & (apart <= most)).select("u", "v"), "judged")
    members = sharing.where("v is null").select(F.col("u").alias("row"), "token")
    needed = judged.select(F.explode(F.array("u", "v")).alias("row")).union(members.select("row")).distinct()
    sets = stage(found.select("row", "shingles").join(small(needed), "row", "left_semi"), "shingle-sets")
    linked = _similar(judged.join(sets.toDF("u", "shingles"), "u").join(sets.toDF("v", "other"), "v"), similarity)
    stars = components(linked, "u", "v")
    if not members.isEmpty():
        more = stage(_rest(members, units, sets, stars, similarity, block), "more-links")
        if not more.isEmpty():
            stars = components(stars.toDF("u", "v").union(more), "u", "v")
    return of.join(stars.toDF("unit", "root"), "unit", "left").select("doc_id", "mark", F.coalesce("root", "unit").alias("root"))
