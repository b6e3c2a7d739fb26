"""SimHash near-duplicates: an inverted index on byte positions with count
filtering.

A 64-bit fingerprint is eight positional bytes.  Fingerprints that differ in at
most three bits share at least five of them.  Posting lists of single bytes
would pair a 256th of all fingerprints with each other, so the postings are
keyed by four positional bytes, for the fourteen position sets of ``BLOCKS``:
any five positions contain one of them, so no pair is missed.  For each pair
that meets in a posting, the shared positional bytes are tallied; pairs that
reach the guaranteed five are verified by their bit distance.

A posting of more than ``max_posting`` fingerprints emits no pairs.  Its
members are linked exactly through the fingerprints around them: two within
three bits have a point within one bit of the one and two bits of the other,
and every fingerprint that has such a point links to the least one within one
bit of it.  That is a fixed number of rows per member, however large the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Cuts, fresh, slices, texts_of
from .graphs import connected_components

#: The Steiner system S(3,4,8) on the byte positions.  Every set
#: of five positions contains one of these fourteen sets of four.
BLOCKS = ((0, 1, 2, 3), (4, 5, 6, 7),
          (0, 1, 4, 5), (0, 1, 6, 7), (2, 3, 4, 5), (2, 3, 6, 7),
          (0, 2, 4, 6), (0, 2, 5, 7), (1, 3, 4, 6), (1, 3, 5, 7),
          (0, 3, 4, 7), (0, 3, 5, 6), (1, 2, 4, 7), (1, 2, 5, 6))
SEED = 42
SHINGLES_AT_ONCE = 1 << 15


def fingerprint(text: bytes, words_per_shingle: int = 3) -> int:
    """SimHash of a text's word shingles: A-Z lower-cased, words split at space
    and \\t..\\r, XXH64 of each shingle; a bit is 1 if set in over half of them."""
    words = text.lower().split()
    if not words:
        return 0
    k = words_per_shingle
    count = max(1, len(words) - k + 1)
    set_bits = np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, count, SHINGLES_AT_ONCE):
        part = words[at:at + SHINGLES_AT_ONCE + k - 1]
        shingles = [join(words)] if len(words) < k else map(
            join, zip(*[part[i:] for i in range(k)]))
        hashes = np.array([digest(s, SEED) for s in shingles], ">u8")
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(
            axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > count).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], words_per_shingle: int):
    for batch in slices(batches, 512):
        values = np.array([fingerprint(t, words_per_shingle) for t in texts_of(batch)], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(values.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(
        lambda batches: _fingerprints(batches, words_per_shingle), f"doc_id {kind}, fp bigint")


def positional_byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * (7 - position)).bitwiseAND(255)


def shared_bytes(a: str, b: str) -> Column:
    """How many positional bytes two fingerprints share."""
    apart = F.col(a).bitwiseXOR(F.col(b))
    return sum((positional_byte(apart, p) == 0).cast("int") for p in range(8))


def _postings(fps: DataFrame) -> DataFrame:
    keys = []
    for number, block in enumerate(BLOCKS):
        key = F.lit(number).cast("bigint")
        for p in block:
            key = F.shiftleft(key, 8).bitwiseOR(positional_byte(F.col("fp"), p))
        keys.append(key)
    return fps.select("fp", F.explode(F.array(*keys)).alias("posting"))


def close_pairs(fps: DataFrame, cuts: Cuts, max_bits: int = 3,
                max_posting: int = 64) -> DataFrame:
    """Links (a, b) between different fingerprints of ``fps(fp)``: all pairs
    within ``max_bits``, except that in large postings only links enough to
    connect what they connect."""
    if max_bits != 3:
        raise ValueError("the position sets guarantee a shared posting for 3 bits")
    least = 8 - max_bits
    postings = _postings(fps)
    sizes = postings.groupBy("posting").agg(F.count("*").alias("members")).where("members > 1")
    shared = cuts.cut(postings.join(sizes, "posting"), "postings")
    small = shared.where(F.col("members") <= max_posting).select("posting", "fp")
    pairs = (small.withColumnRenamed("fp", "a").join(small.withColumnRenamed("fp", "b"), "posting")
             .where("a < b").where(shared_bytes("a", "b") >= least)
             .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
             .select("a", "b"))
    crowded = shared.where(F.col("members") > max_posting).select("fp").distinct()
    one = "transform(sequence(0, 63), i -> shiftleft(1L, i))"
    two = ("flatten(transform(sequence(1, 63), i -> transform(sequence(0, i - 1), "
           "j -> shiftleft(1L, i) | shiftleft(1L, j))))")
    points = cuts.cut(
        crowded.select("fp", F.explode(F.expr(f"concat(array(0L), {one})")).alias("m"),
                       F.lit(True).alias("near"))
        .unionByName(crowded.select("fp", F.explode(F.expr(two)).alias("m"),
                                    F.lit(False).alias("near")))
        .select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("point"), "near"), "points")
    hubs = cuts.cut(points.groupBy("point").agg(
        F.min(F.when(F.col("near"), F.col("fp"))).alias("hub"), F.count("*").alias("members"))
        .where("hub IS NOT NULL AND members > 1").select("point", "hub"), "hubs")
    spokes = (points.join(hubs, "point").where("fp <> hub")
              .select(F.col("hub").alias("a"), F.col("fp").alias("b")))
    return pairs.unionByName(spokes).distinct()


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                              words_per_shingle: int = 3, max_bits: int = 3,
                              max_posting: int = 64) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id,
    the smallest doc_id reachable over links of at most ``max_bits`` bits.

    Null, empty and blank texts have fingerprint zero and link like any other;
    a text of fewer words than a shingle is one shingle.  Repeated rows give
    repeated results.  A fingerprint that only rows without a doc_id have links
    with no other, and its component is null.  Empty table: no rows.
    """
    cuts = Cuts(docs.sparkSession, "simhash")
    rows = cuts.cut(fingerprints(docs, id_col, text_col, words_per_shingle), "rows")
    classes = cuts.cut(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "classes")
    pairs = cuts.cut(close_pairs(classes.select("fp"), cuts, max_bits, max_posting), "pairs")
    ids = classes.where("doc_id IS NOT NULL")
    ends = (pairs.join(ids.select(F.col("fp").alias("a"), F.col("doc_id").alias("id_a")), "a")
            .join(ids.select(F.col("fp").alias("b"), F.col("doc_id").alias("id_b")), "b")
            .select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    found = connected_components(ends, cuts)
    named = cuts.cut(
        classes.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("fp", F.coalesce("component", "doc_id").alias("component_id")), "named")
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of each component the
    document with the smallest doc_id; its other members go.  A row without a
    doc_id stays unless a document with one is in its component."""
    found = near_duplicate_components(docs, id_col, text_col)
    gone_id = fresh(docs.columns, "gone_id")[0]
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, docs[id_col] == gone[gone_id], "left_anti")
