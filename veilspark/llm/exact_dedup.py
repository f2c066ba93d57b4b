"""Exact dedup by two-pass Bloom filtering, in native expressions only.

Texts are equal when they are identical after deleting every character of [\\x20\\x09-\\x0D]; null counts as empty.
Of equal texts the row with the most code points in its original text stays, then the one with the smallest
doc_id, then any one of those.

The texts are read once: digest, length and id of each row go to a table in the shared folder. The first pass
fills a counting Bloom filter with the digests: a digest has `probes` cells within one block of 32,768, and cells
are summed where they arise before they meet. The cells hit more than once, as one bitmap a block, are the second
filter: a digest all of whose cells are there is possibly repeated. The second pass tests every row against that
filter. Rows that fail the test are alone with their text and pass straight through; only the others shuffle.

The filter has about `bits_per_row` bits a row and at most `most_bits`, which bounds what is broadcast at any size
of input: beyond that it lets more single rows through to the exact pass, and the result stays the same.

Hot groups: cells and groups are summed before they shuffle, and groups with over a thousandth of the possibly
repeated rows, of which there can be no more than a thousand, meet their rows in a broadcast.

Defined results: repeated rows are rows of their own, of which one stays; a null doc_id comes after all others;
an empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stage

#: The characters that do not count.
IGNORED = "\x20\x09\x0a\x0b\x0c\x0d"
_BLOCK = 1 << 15  # bits of a bitmap of bitmap_construct_agg
_HOT = 1_000


def normalized(text: Column) -> Column:
    """The text without ASCII white space; empty for null."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), IGNORED, F.coalesce(text.cast("string"), F.lit("")))


def filter_blocks(rows: int, bits_per_row: int, most_bits: int) -> int:
    """Blocks of a filter for so many rows."""
    return max(1, -(-min(rows * bits_per_row, max(most_bits, _BLOCK)) // _BLOCK))


def _block(digest: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(blocks)).cast("int")


def _cells(digest: Column, probes: int) -> Column:
    """The places of a digest's cells within its block."""
    return F.array(*(F.pmod(F.xxhash64(digest, F.lit(i)), F.lit(_BLOCK)).cast("int") for i in range(probes)))


def repeated_filter(rows: DataFrame, digest: str, blocks: int, probes: int) -> DataFrame:
    """block and bitmap of the cells that rows hit more than once."""
    hits = rows.select(_block(F.col(digest), blocks).alias("block"), F.explode(F.array_distinct(_cells(F.col(digest), probes))).alias("cell"))
    twice = hits.groupBy("block", "cell").agg(F.count("*").alias("hits")).where("hits > 1")
    # Cells are single now, so no block holds more than 32,768 of them, and each bitmap is made once.
    return twice.repartition("block").groupBy("block").agg(F.bitmap_construct_agg(F.col("cell").cast("bigint")).alias("bitmap"))


def _is_set(bitmap: Column, cell: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(cell, 3) + 1), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, cell.bitwiseAND(F.lit(7))) == 1


def possibly_repeated(rows: DataFrame, seen: DataFrame, digest: str, blocks: int, probes: int) -> DataFrame:
    """rows, with `again`: whether all cells of the row's digest are in the filter."""
    seen = F.broadcast(seen.select(F.col("block").alias("_block"), F.col("bitmap").alias("_bitmap")))
    joined = rows.join(seen, _block(F.col(digest), blocks) == F.col("_block"), "left")
    tests = (_is_set(F.col("_bitmap"), F.pmod(F.xxhash64(digest, F.lit(i)), F.lit(_BLOCK)).cast("int")) for i in range(probes))
    return joined.withColumn("again", F.coalesce(reduce(Column.__and__, tests), F.lit(False))).drop("_block", "_bitmap")


def mark_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits_per_row: int = 16, most_bits: int = 1 << 30, probes: int = 2
) -> DataFrame:
    """One row for each row of docs: doc_id, digest (hex SHA-256 of the normalized text), keep_id (doc_id of the row
    that stays), group_size and kept."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).alias("doc_id"),
        F.unhex(F.sha2(normalized(F.col(text)), 256)).alias("digest"),
        F.coalesce(F.length(F.col(text).cast("string")), F.lit(0)).alias("points"),
    )
    rows = stage(rows, "digests")
    blocks = filter_blocks(rows.count(), bits_per_row, most_bits)
    seen = stage(repeated_filter(rows, "digest", blocks, probes), "seen-again")
    rows = stage(possibly_repeated(rows, seen, "digest", blocks, probes), "tested")

    alone = rows.where(~F.col("again")).select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"))
    again = rows.where("again").select("row", "doc_id", "digest", "points")
    order = F.struct((-F.col("points")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    groups = again.groupBy("digest").agg(F.count("*").alias("group_size"), F.min(order).alias("first"))
    groups = stage(groups.select("digest", "group_size", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row")), "groups")
    hot_size = F.lit((again.count() // _HOT) + 1)
    hot = groups.where(F.col("group_size") >= hot_size)

    def settled(part: DataFrame) -> DataFrame:
        return part.select("doc_id", "digest", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))

    of_hot = settled(again.join(F.broadcast(hot), "digest"))
    rest = again.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    of_rest = settled(rest.join(small(groups.where(F.col("group_size") < hot_size)), "digest"))
    marked = alone.unionByName(of_hot).unionByName(of_rest)
    return marked.withColumn("digest", F.lower(F.hex("digest")))


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **sizes: int) -> DataFrame:
    """docs without the rows that do not stay; all columns. Repeated rows of the one that stays count once.

    Rows with a text of its own pass through where they are; what shuffles are the rows of repeated texts.
    """
    marked = mark_duplicates(docs, doc_id, text, **sizes).where(F.col("group_size") > 1)
    repeated = stage(marked.where("kept").select("digest", "keep_id", "group_size"), "stays")
    digest = F.sha2(normalized(F.col(text)), 256)
    packed = docs.select(digest.alias("digest"), F.struct("*").alias("row"))
    listed = small(repeated.select("digest"))
    alone = packed.join(listed, "digest", "left_anti").select("row.*")
    again = packed.join(small(repeated), "digest")
    again = again.where(F.col("row")[doc_id].eqNullSafe(F.col("keep_id")))
    points = F.coalesce(F.length(F.col("row")[text].cast("string")), F.lit(0))
    one = again.groupBy("digest").agg(F.max_by("row", points).alias("row"))
    return alone.unionByName(one.select("row.*"))
