"""Merkle manifest of a dataset as a postorder append log.

Leaves are digests of rows; each tree (one a language, say) holds its leaves in the order of their ids. While a tree
has several nodes, every two consecutive ones become the digest of their hex texts joined; a last single one becomes
the digest of its own. What remains is the tree's subroot. The subroots, in the order of their trees, are the leaves
of one more tree, whose subroot is the root.

Append log. Nodes are logged in the order of their completion (postorder). Aligned builders write it: a builder takes
2^height consecutive leaves at a multiple of that number, so its nodes are one gapless run of the log, whose place is
known without any other builder. Before leaf s a tree's log holds 2s - popcount(s) nodes, and node `index` of `level`
with m leaves below it comes sum(ceil(m / 2^j), j = 0..level) - 1 places after that (`position`). The nodes above are
built the same way from the builders' last nodes, `height` levels a round, and go to the places that the same formula
gives. Siblings of a proof are addressed by the formula: inside a builder's run directly, above it in a join on
(tree, position), once a builder and not once a row.

Rows are numbered by range partitions, so neither a tree nor an id is bound to one task: a tree of any size is dealt
to builders of 2^height leaves. Digests, ids and numbers move, texts never do.

Defined results: a null tree name is a tree, before all others; a null id comes first in its tree; rows with one id
are ordered by their leaves; repeated rows are leaves of their own; an empty table has no trees, no log and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, small, stage

_RUN = "tree bigint, block bigint, position bigint, nodes binary"


def leaf(*values: Column) -> Column:
    """The digest of values: each `-` if null, else its UTF-8 bytes' number, a colon and the value."""
    parts = (value.cast("string") for value in values)
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts)), 256)


def parent(*children: str) -> str:
    """The digest of hex digests, joined as texts."""
    return hashlib.sha256("".join(children).encode()).hexdigest()


def width(n: int, level: int) -> int:
    """Nodes of a level of a tree of n leaves."""
    return -(-n >> level)


def top_level(n: int) -> int:
    """The level of the subroot."""
    return (n - 1).bit_length()


def position(level: int, index: int, n: int) -> int:
    """The place of a node in the postorder log of a tree of n leaves, from 0."""
    start = index << level
    below = min(1 << level, n - start)
    return 2 * start - start.bit_count() + sum(width(below, j) for j in range(level + 1)) - 1


def completion(n: int, base: int, first: int, count: int, levels: int) -> Iterator[tuple[int, int]]:
    """(level, index) of the nodes over nodes first .. first + count - 1 of level `base`, as they are completed, those
    themselves included; `levels` levels at most. first is a multiple of 2^levels."""
    last = width(n, base) - 1
    for i in range(first, first + count):
        yield base, i
        level, at = base, i
        while level < base + levels and level < top_level(n) and (at & 1 or i == last):
            level, at = level + 1, at >> 1
            yield level, at


@dataclass
class Manifest:
    """trees: tree, name, leaves, subroot. runs: the log, as consecutive nodes from `position` on. upper: the log's
    nodes from the builders' last ones up, one a row. rows: the leaves by builder. top: the manifest of the subroots."""

    trees: DataFrame
    runs: DataFrame
    upper: DataFrame
    rows: DataFrame
    height: int
    top: Manifest | None = None

    def root(self) -> str | None:
        """The digest over everything; None for an empty table."""
        last = (self.top or self).trees.select("subroot").first()
        return last[0] if last else None


def _build(rows: DataFrame, trees: DataFrame, height: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """runs, upper nodes and subroots (tree, subroot) over rows: tree, leaves, index, leaf."""
    nodes = rows.select("tree", "leaves", "index", "leaf")
    runs, uppers, base = None, [], 0
    most = trees.agg(F.max("leaves")).first()[0] or 0
    while True:
        built = nodes.withColumn("block", F.shiftright("index", height)).repartition("tree", "block").sortWithinPartitions("tree", "block", "index")
        built = stage(built.select("tree", "leaves", "block", "index", "leaf").mapInArrow(_builder(base, height), _RUN + ", upper array<struct<level:int,index:bigint,position:bigint,node:string>>"), f"log-{base}")
        runs = built.select("tree", "block", "position", "nodes") if base == 0 else runs
        uppers.append(built.select("tree", F.inline("upper")))
        base += height
        if most <= 1 << base:
            break
        nodes = uppers[-1].where(F.col("level") == base).join(small(trees.where(F.col("leaves") > 1 << base).select("tree", "leaves")), "tree")
        nodes = nodes.select("tree", "leaves", "index", F.col("node").alias("leaf"))
    upper = uppers[0]
    for more in uppers[1:]:
        upper = upper.unionByName(more)
    tops = upper.join(small(trees.select("tree", "leaves")), "tree").where(F.col("position") == _last_position())
    return runs, upper, tops.select("tree", F.col("node").alias("subroot"))


def _last_position() -> Column:
    """The place of the subroot in a log of `leaves` leaves: the number of nodes of all levels, less one."""
    n = F.col("leaves")
    levels = (F.when(n > 1 << j - 1, F.ceil(n / F.lit(float(1 << j)))).otherwise(0) for j in range(1, 52))
    return n + sum(levels, F.lit(0)) - 1


def _builder(base: int, height: int):
    """A task's builders: rows (tree, leaves, block, index, leaf), sorted, give one run each."""

    def close(tree: int, n: int, block: int, leaves: list[str]) -> tuple:
        known: dict[tuple[int, int], str] = {}
        nodes, upper, first = [], [], None
        for level, index in completion(n, base, block << height, len(leaves), height):
            if level == base:
                node = leaves[index - (block << height)]
            else:
                node = parent(*(known.pop((level - 1, child)) for child in (2 * index, 2 * index + 1) if (level - 1, child) in known))
            known[level, index] = node
            top = level == top_level(n)
            place = position(level, index, n) if base or not nodes or top or level == height else None
            first = place if first is None else first
            if base == 0:
                nodes.append(node)
            if level > base if base else level == height or top:
                upper.append({"level": level, "index": index, "position": place, "node": node})
        return tree, block, first, bytes.fromhex("".join(nodes)), upper

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        names = ["tree", "block", "position", "nodes", "upper"]
        kind = pa.list_(pa.struct([("level", pa.int32()), ("index", pa.int64()), ("position", pa.int64()), ("node", pa.string())]))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), kind]

        def flush():
            nonlocal out
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
            out = []

        for batch in batches:
            for tree, n, block, _, digest in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (tree, n, block):
                    if held:
                        out.append(close(*key, held))
                        if len(out) >= 16:
                            yield from flush()
                    key, held = (tree, n, block), []
                held.append(digest)
        if held:
            out.append(close(*key, held))
        yield from flush()

    return build


def build(leaves: DataFrame, tree: str | None = "tree", order: str = "id", digest: str = "leaf", height: int = 12) -> Manifest:
    """The manifest of leaves: names of trees, ids and hex digests; further columns stay with the rows.

    tree None: all leaves are of one tree, without a manifest of subroots.
    """
    named = leaves.select(
        (F.col(tree).cast("string") if tree else F.lit(None).cast("string")).alias("name"),
        F.col(order).alias("id"),
        F.col(digest).alias("leaf"),
        *(F.col(c).alias(f"with_{c}") for c in leaves.columns if c not in (tree, order, digest)),
    )
    named = stage(named.withColumn("row", F.monotonically_increasing_id()), "leaves")
    place = numbered(named, [F.col("name").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf").asc(), F.col("row").asc()], "place")
    place = stage(place, "placed")
    sizes = stage(place.groupBy("name").agg(F.min("place").alias("first"), F.count("*").alias("leaves")), "sizes")
    trees = stage(numbered(sizes, [F.col("first").asc()], "tree"), "trees")
    known = small(trees.select(F.col("name").alias("_name"), "tree", "first", "leaves"))
    rows = place.join(known, F.col("name").eqNullSafe(F.col("_name"))).withColumn("index", F.col("place") - F.col("first")).drop("_name", "place", "first", "row")
    rows = stage(rows, "rows")
    runs, upper, tops = _build(rows, trees, height)
    trees = stage(trees.join(small(tops), "tree").select("tree", "name", "leaves", "subroot"), "subroots")
    top = build(trees.select("tree", "subroot"), None, "tree", "subroot", height) if tree else None
    return Manifest(trees, runs, upper, rows, height, top)


def _paths(manifest: Manifest) -> DataFrame:
    """tree, block and path of every builder: for each level above it the sibling (null: none), and its side."""
    blocks = manifest.runs.select("tree", "block").join(small(manifest.trees.select("tree", "leaves")), "tree")
    height = manifest.height

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tree, block, n in zip(*(c.to_pylist() for c in batch.columns)):
                for level in range(height, top_level(n)):
                    index = block >> (level - height) ^ 1
                    out.append((tree, block, level, 1 - 2 * (index & 1 ^ 1), position(level, index, n) if index < width(n, level) else None))
            names = ["tree", "block", "level", "side", "position"]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, types)], names=names)

    asked = blocks.select("tree", "block", "leaves").mapInArrow(ask, "tree bigint, block bigint, level int, side int, position bigint")
    found = asked.join(manifest.upper.select("tree", "position", "node"), ["tree", "position"], "left")
    steps = F.sort_array(F.collect_list(F.struct("level", "side", "node")))  # one a level
    return stage(found.groupBy("tree", "block").agg(steps.alias("path")), "paths")


def proofs(manifest: Manifest, claimed: str | None = None) -> DataFrame:
    """A row for each leaf: name, id, leaf, subroot, the further columns (as `with_` and their name), siblings (from the
    leaf to the root, left to right) and folded: the root recomputed from them and from `claimed` (null, or no such
    column: from the leaf itself)."""
    outer = None
    if manifest.top:
        outer = stage(proofs(manifest.top).select(F.col("id").alias("tree"), F.col("steps").alias("outer")), "outer")
    rows, height = manifest.rows, manifest.height
    extra = [c for c in rows.columns if c.startswith("with_")]
    known = manifest.trees.select("tree", "subroot")
    known = known.join(outer, "tree") if outer is not None else known.withColumn("outer", F.lit(None).cast("array<struct<side:int,node:string>>"))
    heads = manifest.runs.join(_paths(manifest), ["tree", "block"], "left").join(small(known, 10_000), "tree")
    heads = heads.select("tree", "block", F.struct("position", "nodes", "path", "outer", "subroot").alias("head"))
    claim = F.col(f"with_{claimed}") if claimed else F.lit(None).cast("string")
    own = ["name", "id", "leaf", *extra]
    body = rows.select("tree", F.shiftright("index", height).alias("block"), "index", "leaves", claim.alias("claim"), F.struct(*own).alias("own"))
    body = body.withColumn("head", F.lit(None).cast(heads.schema["head"].dataType))
    none = heads.select("tree", "block", F.lit(-1).cast("bigint").alias("index"), F.lit(None).cast("bigint").alias("leaves"), F.lit(None).cast("string").alias("claim"), F.lit(None).cast(body.schema["own"].dataType).alias("own"), "head")
    # Each builder's head comes before its rows, so it is there once and not once a row.
    met = body.unionByName(none).repartition("tree", "block").sortWithinPartitions("tree", "block", "index")
    kind = met.select("own.*").schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind)
    schema = f"own struct<{fields.replace('` ', '`:')}>, subroot string, steps array<struct<side:int,node:string>>, folded string"
    steps_type = pa.list_(pa.struct([("side", pa.int32()), ("node", pa.string())]))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            at = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names) if name != "own"}
            subroots, all_steps, folded, kept = [], [], [], []
            for i in range(batch.num_rows):
                if at["head"][i] is not None:
                    head = at["head"][i]
                    continue
                n, index = at["leaves"][i], at["index"][i]
                nodes, start = head["nodes"], head["position"]
                steps, where = [], index
                for level in range(min(height, top_level(n))):
                    other = where ^ 1
                    node = None
                    if other < width(n, level):
                        place = 32 * (position(level, other, n) - start)
                        node = nodes[place : place + 32].hex()
                    steps.append((-1 if where & 1 else 1, node))
                    where >>= 1
                steps += [(s["side"], s["node"]) for s in (head["path"] or []) + (head["outer"] or [])]
                place = 32 * (position(0, index, n) - start)
                value = at["claim"][i] or nodes[place : place + 32].hex()
                for side, node in steps:
                    value = parent(value) if node is None else parent(node, value) if side < 0 else parent(value, node)
                kept.append(i)
                subroots.append(head["subroot"])
                all_steps.append([{"side": s, "node": d} for s, d in steps])
                folded.append(value)
            own = batch.column(batch.schema.get_field_index("own")).take(pa.array(kept, pa.int64()))
            columns = [own, pa.array(subroots, pa.string()), pa.array(all_steps, steps_type), pa.array(folded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["own", "subroot", "steps", "folded"])

    found = met.mapInArrow(extract, schema)
    siblings = F.transform(F.filter("steps", lambda s: s["node"].isNotNull()), lambda s: s["node"])
    return found.select("own.*", "subroot", "steps", siblings.alias("siblings"), "folded")


def write_log(manifest: Manifest, path: str) -> None:
    """The log and the trees as tables: path/runs (base runs), path/upper, path/trees, and path/top for the subroots."""
    manifest.runs.write.parquet(f"{path}/runs")
    manifest.upper.write.parquet(f"{path}/upper")
    manifest.trees.write.parquet(f"{path}/trees")
    if manifest.top:
        write_log(manifest.top, f"{path}/top")
