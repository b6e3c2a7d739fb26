"""Exact deduplication: a two-pass Bloom filter finds the rows whose hash may
repeat; only those rows shuffle, the rest pass straight through.

Pass 1 counts, for every row, the filter bits its hash sets and keeps the bits
that two or more rows set.  Pass 2 tests each row against that filter: a row
with any bit of its own cannot have an equal row and is decided where it is.
The filter is a table of 4 KiB bitmaps, at most ``max_blocks`` of them, which
is the proven bound of the broadcast; a fuller filter only sends more rows
through the shuffle, never changes a decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Cuts, ascii_lower, fresh

BLOCK_BITS = 32768      # bits in one bitmap of bitmap_construct_agg


def text_sha256(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased; null counts as empty."""
    return F.sha2(ascii_lower(text), 256)


def _filter_place(sha: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of the filter and the two bits inside it for a hash."""
    x = F.xxhash64(sha)
    return (F.pmod(x, F.lit(blocks)).cast("int"),
            [F.shiftrightunsigned(x, s).bitwiseAND(BLOCK_BITS - 1) for s in (18, 40)])


def repeated_bits(hashes: DataFrame, bits_per_row: int = 16,
                  max_blocks: int = 16384) -> tuple[DataFrame, int]:
    """Pass 1: (block, bitmap) of the bits that at least two rows set, and the
    number of blocks (16 bits per row, 64 MiB at most by default)."""
    blocks = min(max_blocks, max(1, -(-hashes.count() * bits_per_row // BLOCK_BITS)))
    block, bits = _filter_place(F.col("sha"), blocks)
    filled = (hashes.select(block.alias("block"),
                            F.explode(F.array_distinct(F.array(*bits))).alias("bit"))
              .groupBy("block", "bit").agg(F.count("*").alias("n")).where("n > 1"))
    return filled.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap")), blocks


def with_maybe_repeated(rows: DataFrame, sha: str, bitmaps: DataFrame, blocks: int,
                        flag: str) -> DataFrame:
    """Pass 2: add ``flag``, false only where no other row can have the hash."""
    block_name, map_name, at = fresh([*rows.columns, flag], "block", "bitmap", "filter_block")
    block, bits = _filter_place(F.col(sha), blocks)

    def is_set(bit: Column) -> Column:
        byte = F.substring(F.col(map_name), F.shiftright(bit, 3).cast("int") + 1, F.lit(1))
        value = F.conv(F.hex(byte), 16, 10).cast("int")
        mask = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]),
                            bit.bitwiseAND(7).cast("int") + 1)
        return value.bitwiseAND(mask) != 0

    held = F.broadcast(bitmaps.select(F.col("block").alias(block_name),
                                      F.col("bitmap").alias(map_name)))
    tested = rows.withColumn(at, block).join(held, F.col(at) == F.col(block_name), "left")
    return tested.withColumn(
        flag, F.coalesce(is_set(bits[0]) & is_set(bits[1]), F.lit(False))
    ).drop(at, block_name, map_name)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     max_blocks: int = 16384) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (A-Z lower-cased, null as empty) the row with the largest
    doc_id stays; a null doc_id is the smallest.  Rows repeated with the same
    doc_id are counted each and one of them stays.  Empty table: no rows.
    Other columns are not read, so their names cannot clash.
    """
    cuts = Cuts(docs.sparkSession, "exact")
    hashes = cuts.cut(
        docs.select(F.col(id_col).alias("doc_id"), text_sha256(F.col(text_col)).alias("sha"))
        .withColumn("ord", F.monotonically_increasing_id()), "hashes")
    found, blocks = repeated_bits(hashes, max_blocks=max_blocks)
    bitmaps = cuts.cut(found, "filter", 1)
    flagged = with_maybe_repeated(hashes, "sha", bitmaps, blocks, "maybe")
    straight = flagged.where("NOT maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    maybe = flagged.where("maybe")
    # written, so that the join deals both sides anew and a hot hash can be split
    groups = cuts.cut(maybe.groupBy("sha").agg(
        F.max(F.struct("doc_id", "ord")).alias("top"), F.count("*").alias("group_size")), "groups")
    decided = maybe.join(groups, "sha").select(
        "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size",
        (F.col("ord") == F.col("top.ord")).alias("kept"), F.col("sha").alias("text_sha256"))
    return straight.unionByName(decided)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      max_blocks: int = 16384) -> DataFrame:
    """The rows that stay, with all their columns; rules as in
    ``duplicate_groups``.  Rows that cannot repeat are passed on in place; the
    others meet the winner of their hash by (hash, doc_id), a key that no
    large group shares."""
    cuts = Cuts(docs.sparkSession, "exact")
    sha, flag, key, keep = fresh(docs.columns, "sha", "maybe", "group_sha", "keep_id")
    hashes = cuts.cut(docs.select(F.col(id_col).alias("doc_id"),
                                  text_sha256(F.col(text_col)).alias("sha")), "hashes")
    found, blocks = repeated_bits(hashes, max_blocks=max_blocks)
    bitmaps = cuts.cut(found, "filter", 1)
    top = (with_maybe_repeated(hashes, "sha", bitmaps, blocks, "maybe").where("maybe")
           .groupBy(F.col("sha").alias(key)).agg(F.max("doc_id").alias(keep)))
    flagged = with_maybe_repeated(docs.withColumn(sha, text_sha256(F.col(text_col))),
                                  sha, bitmaps, blocks, flag)
    straight = flagged.where(~F.col(flag)).select(*docs.columns)
    winners = (flagged.where(F.col(flag))
               .join(top, (F.col(sha) == F.col(key)) & F.col(id_col).eqNullSafe(F.col(keep)),
                     "left_semi")
               .dropDuplicates([sha, id_col]).select(*docs.columns))
    return straight.unionByName(winners)
