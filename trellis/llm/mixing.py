"""Mixing sources to target weights, in blocks of a fixed number of words.

Every source's words lie on one line, document after document, and the line is
cut into blocks of ``block_words``.  Output shards of ``shard_slots`` slots
draw multinomial source counts: each slot draws a source with the probability
of its target.  Draws beyond a source's quota are redrawn for the sources that
the draws left short, so the corpus meets its targets to within one block.
The j-th slot of a source takes the block at place j of a pseudorandom
permutation of the source's block indices (a new pass over it after every
``blocks`` slots), and the slots join the blocks on (source, block).

No source is ever one group: draws are numbered per (source, shard) and the
shards by sums of 1024 neighbours, documents lie on their line in the order of a
hash and are numbered per (source, range of the hash), and the joins run on
(source, block).  The number of hash ranges follows from the size of the input;
neither the order of the line nor a draw depends on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trellis.operators.chunks import global_ordinal

from .common import WORD, Cuts, fresh

#: Fixed values of the mixing rule.
WEIGHTS = (5, 2, 1)
CAP = 3

RANGE_ROWS = 65536          # rows that a hash range aims at, all sources together
HASH_BITS = 60              # of ``hashed``
ROUNDS = ((0.6180339887, 1043525, 7), (0.2915, 786433, 3), (0.7071067811, 393241, 11),
          (0.4142135623, 196613, 5))    # (rotation, odd multiplier, key factor) per round


def hashed(*parts: Column) -> Column:
    """A non-negative 60-bit integer from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 15),
                  16, 10).cast("bigint")


def permuted(x: str) -> Column:
    """Place of index ``x`` under a keyed permutation of 0..blocks-1.

    Each round rotates the whole range and then scrambles the largest power of
    two that fits (odd multiplication, then an xor of its upper half); both
    steps are one-to-one, and the rotation feeds every index to the second.
    Reads the columns blocks, mask (that power less one), half (half its bits)
    and key, which ``block_keys`` adds to a source.
    """
    rounds = ", ".join(f"named_struct('turn', cast(floor(blocks * {t}D) as bigint) + key % blocks, "
                       f"'odd', {odd}L, 'add', (key % 65536) * {f})" for t, odd, f in ROUNDS)
    return F.expr(
        f"aggregate(array({rounds}), {x}, (a, r) -> transform(array((a + r.turn) % blocks), "
        "y -> if(y <= mask, transform(array((y * r.odd + r.add) & mask), "
        "z -> z ^ shiftright(z, half))[0], y))[0])")


def block_keys(sources: DataFrame, seed: int) -> DataFrame:
    """Add what ``permuted`` needs to rows with sid and blocks."""
    bits = F.length(F.bin("blocks")) - 1
    return (sources.withColumn("bits", bits.cast("int"))
            .withColumn("mask", F.expr("shiftleft(1L, bits) - 1"))
            .withColumn("half", F.expr("greatest(1, (bits + 1) div 2)").cast("int")).drop("bits")
            .withColumn("key", hashed(F.lit(seed), F.lit("order"), F.col("sid"))))


def source_targets(sizes: DataFrame, cuts: Cuts) -> DataFrame:
    """(sid, source, source_size, target): sources by code point, null last,
    weigh 5, 2, 1, repeating, and share all words by weight; a target stops at
    three times its source's size and the excess is shared again by weight."""
    totals = cuts.cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    order = [F.col("source").isNull(), F.coalesce("source", F.lit(""))]
    ranked = cuts.cut(
        global_ordinal(totals.withColumn("last", order[0]).withColumn("name", order[1]),
                       ["last", "name"], "sid").drop("last", "name"), "ranked")
    cuts.drop(totals)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]),
                          (F.col("sid") % len(WEIGHTS)).cast("int") + 1)
    ranked = ranked.withColumn("weight", weight)
    whole = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    total, share = whole[0] or 0, 0.0
    rest, free = total, whole[1] or 0
    while free and rest / free > share:      # the share only grows, so sources only ever join
        share = rest / free
        over = F.col("weight") * F.lit(share) > CAP * F.col("source_size")
        capped, free = ranked.agg(
            F.coalesce(F.sum(F.when(over, CAP * F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        rest = total - capped
    return ranked.withColumn("target", F.least(
        (CAP * F.col("source_size")).cast("double"), F.col("weight") * F.lit(share)))


def _running(df: DataFrame, value: str, part: list[str], order: list[str]) -> Column:
    """Sum of ``value`` over the rows before this one in its part."""
    w = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def block_plan(sources: DataFrame, cuts: Cuts, block_words: int, shard_slots: int,
               seed: int) -> DataFrame:
    """(sid, block, times): how often the mix takes each block of each source.
    ``slot_plan`` holds the same slot by slot."""
    return (slot_plan(sources, cuts, block_words, shard_slots, seed)
            .groupBy("sid", "block").agg(F.count("*").alias("times")))


def slot_plan(sources: DataFrame, cuts: Cuts, block_words: int, shard_slots: int,
              seed: int) -> DataFrame:
    """(slot, shard, sid, block): the block that every output slot takes."""
    spark = sources.sparkSession
    line = cuts.cut(
        sources.where("source_size > 0")
        .withColumn("blocks", F.expr(f"(source_size + {block_words - 1}) div {block_words}"))
        .withColumn("quota", F.least(
            CAP * F.col("blocks"),
            F.floor(F.col("target") / F.col("source_size") * F.col("blocks") + 0.5)))
        .select("sid", "blocks", "quota"), "quota")
    line = block_keys(line, seed)
    # offsets of the sources on the line of all slots: a running sum over sources
    placed = cuts.cut(_offsets(line, "quota", "lo"), "placed")
    own = ["blocks", "mask", "half", "key"]
    slots, n_sources = placed.agg(F.sum("quota"), F.count("*")).first()
    slots = slots or 0
    width = max(1, -(-slots // max(1, 4 * n_sources)))
    # the grid cells that a source's stretch touches, so that a draw finds it by equality
    cells = placed.where("quota > 0").select(
        "sid", "lo", (F.col("lo") + F.col("quota")).alias("hi"),
        F.explode(F.expr(f"sequence(lo div {width}, (lo + quota - 1) div {width})")).alias("cell"))
    draws = (spark.range(slots).select(F.col("id").alias("slot"))
             .withColumn("at", hashed(F.lit(seed), F.col("slot")) % F.lit(max(1, slots)))
             .withColumn("cell", F.expr(f"at div {width}"))
             .join(cells, "cell").where("at >= lo AND at < hi")
             .select("slot", F.expr(f"slot div {shard_slots}").alias("shard"), "sid"))
    draws = cuts.cut(draws, "draws")
    counts = draws.groupBy("sid", "shard").agg(F.count("*").alias("drawn"))
    counts = cuts.cut(counts, "drawn").withColumn("span", F.expr("shard div 1024"))
    spans = counts.groupBy("sid", "span").agg(F.sum("drawn").alias("span_drawn"))
    spans = spans.withColumn("ahead", _running(spans, "span_drawn", ["sid"], ["span"]))
    counts = cuts.cut(
        counts.withColumn("inside", _running(counts, "drawn", ["sid", "span"], ["shard"]))
        .join(spans.select("sid", "span", "ahead"), ["sid", "span"])
        .select("sid", "shard", "drawn", (F.col("inside") + F.col("ahead")).alias("before")),
        "counts")
    numbered = (draws.withColumn("n", F.row_number().over(
                    W.partitionBy("sid", "shard").orderBy("slot")))
                .join(counts.select("sid", "shard", "before"), ["sid", "shard"])
                .join(placed.select("sid", "quota", *own), "sid")
                .withColumn("j", F.col("before") + F.col("n") - 1))
    within = numbered.where("j < quota").select("slot", "shard", "sid", "j", *own)
    # draws beyond a quota are dealt, in slot order, to the sources left short
    got = (placed.join(counts.groupBy("sid").agg(F.sum("drawn").alias("drawn")), "sid", "left")
           .withColumn("drawn", F.coalesce("drawn", F.lit(0)))
           .withColumn("surplus", F.greatest(F.col("drawn") - F.col("quota"), F.lit(0)))
           .withColumn("short", F.greatest(F.col("quota") - F.col("drawn"), F.lit(0))))
    got = cuts.cut(_offsets(_offsets(cuts.cut(got, "got"), "surplus", "s_lo"), "short", "d_lo"),
                   "settle")
    spare = (numbered.where("j >= quota").select("slot", "shard", "sid", "j")
             .join(got.select("sid", "quota", "s_lo"), "sid")
             .select("slot", "shard", (F.col("s_lo") + F.col("j") - F.col("quota")).alias("k")))
    wanted = got.where("short > 0").select(
        "sid", *own, "drawn", "d_lo",
        F.explode(F.expr("sequence(0L, short - 1)")).alias("i")).select(
        "sid", *own, (F.col("d_lo") + F.col("i")).alias("k"),
        (F.col("drawn") + F.col("i")).alias("j"))
    settled = spare.join(wanted, "k").select("slot", "shard", "sid", "j", *own)
    return (within.unionByName(settled).withColumn("place", F.expr("j % blocks"))
            .select("slot", "shard", "sid", permuted("place").alias("block")))


def _offsets(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over all rows with a smaller sid: sums of 1024
    neighbouring sources first, then a running sum inside each thousand."""
    part = df.withColumn("sid_part", F.expr("sid div 1024"))
    parts = part.groupBy("sid_part").agg(F.sum(value).alias("part_sum"))
    ahead = parts.withColumn("ahead", F.coalesce(F.sum("part_sum").over(
        W.orderBy("sid_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return (part.withColumn(name, _running(part, value, ["sid_part"], ["sid"]))
            .join(F.broadcast(ahead.select("sid_part", "ahead")), "sid_part")
            .withColumn(name, F.col(name) + F.col("ahead")).drop("sid_part", "ahead"))


def sized_documents(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size, mark): words of every text, null as none; ``mark``
    tells texts of one doc_id apart."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0))
        .cast("bigint").alias("size"),
        F.xxhash64(F.col(text_col)).alias("mark"))


def document_takings(sizes: DataFrame, cuts: Cuts, block_words: int, shard_slots: int,
                     seed: int) -> tuple[DataFrame, DataFrame]:
    """(documents laid out, words taken by block).

    The first has every row of ``sizes`` with sid, source_size, target and
    ``at``, the place of its first word on its source's line (in the order of
    the doc_id's hash, numbered in ranges of it so that no source is one group);
    the second is (sid, at, start, words, times): the stretches of each row
    that the mix takes, ``start`` counted from the row's first word.
    """
    sources = cuts.cut(source_targets(sizes, cuts), "targets")
    ranges = max(10, int(sizes.count() / RANGE_ROWS).bit_length())
    laid = (sizes.join(sources.select(F.col("source").alias("name"), "sid", "source_size",
                                      "target"), F.col("source").eqNullSafe(F.col("name")))
            .drop("name").withColumn("lot", hashed(F.lit("lot"), F.col("doc_id")))
            .withColumn("bucket", F.shiftright("lot", HASH_BITS - ranges)))
    laid = laid.withColumn("inner", _running(laid, "size", ["sid", "bucket"],
                                             ["lot", "doc_id", "size", "mark"])).drop("lot")
    laid = cuts.cut(laid, "laid")
    parts = laid.groupBy("sid", "bucket").agg(F.sum("size").alias("part_size"))
    parts = parts.withColumn("ahead", _running(parts, "part_size", ["sid"], ["bucket"]))
    laid = cuts.cut(
        laid.join(parts.select("sid", "bucket", "ahead"), ["sid", "bucket"])
        .withColumn("at", F.col("inner") + F.col("ahead")).drop("inner", "ahead", "bucket"),
        "placed_docs")
    times = block_plan(sources.select("sid", "source_size", "target"), cuts, block_words,
                       shard_slots, seed)
    pieces = laid.where("size > 0").select(
        "sid", "at", "size",
        F.explode(F.expr(f"sequence(at div {block_words}, (at + size - 1) div {block_words})"))
        .alias("block")).join(times, ["sid", "block"])
    first = F.greatest(F.col("block") * block_words, F.col("at"))
    last = F.least((F.col("block") + 1) * block_words, F.col("at") + F.col("size"))
    return laid, pieces.select("sid", "at", (first - F.col("at")).alias("start"),
                               (last - first).alias("words"), "times")


#: Parameters of the registered query, the same for every size of the input.
BLOCK_WORDS, SHARD_SLOTS, SEED = 16, 16384, 20240611


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  source_col: str = "source", block_words: int = BLOCK_WORDS,
                  shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken.

    Null texts and texts without words have size 0 and are never taken; a null
    source is a source of its own, ranked last; repeated rows are laid out
    each; an empty table gives no rows.  Every block is taken at most three
    times, so no document exceeds three times its size.  Draws depend on the
    seed and the block indices alone, so reruns agree.
    """
    cuts = Cuts(docs.sparkSession, "mix")
    sizes = cuts.cut(sized_documents(docs, id_col, text_col, source_col), "sizes")
    laid, taken = document_takings(sizes, cuts, block_words, shard_slots, seed)
    words = taken.groupBy("sid", "at").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    some = (laid.where("size > 0").join(words, ["sid", "at"], "left")
            .select("doc_id", "size", "source_size", "target",
                    F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")))
    none = laid.where("size = 0").select("doc_id", "size", "source_size", "target",
                                         F.lit(0).cast("bigint").alias("taken"))
    return some.unionByName(none)


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", block_words: int = BLOCK_WORDS,
                shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of ``docs``: the text of a row is made
    of the stretches that the mix takes of it, in order and repeated as often
    as taken, each word with the white space before it.  Rows of which nothing
    is taken are left out; a row repeated in full comes once, with the takings
    of all its repeats."""
    cuts = Cuts(docs.sparkSession, "mix")
    sizes = cuts.cut(sized_documents(docs, id_col, text_col, source_col), "sizes")
    laid, taken = document_takings(sizes, cuts, block_words, shard_slots, seed)
    spans, k_id, k_source, k_mark = fresh(docs.columns, "spans", "key_id", "key_source", "mark")
    used = (taken.join(laid.where("size > 0").select("sid", "at", "doc_id", "source", "mark"),
                       ["sid", "at"])
            .groupBy(F.col("doc_id").alias(k_id), F.col("source").alias(k_source),
                     F.col("mark").alias(k_mark))
            .agg(F.sort_array(F.collect_list(F.struct("start", "words", "times"))).alias(spans)))
    # the words are bound once, as the one element that the outer transform
    # visits: named in the inner lambda they would be split again for every span
    words = (r"regexp_extract_all(concat(' ', `%s`), "
             r"'[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+', 0)" % text_col)
    text = F.expr(
        f"transform(array({words}), w -> concat_ws('', transform(`{spans}`, s -> "
        f"repeat(concat_ws('', slice(w, cast(s.start + 1 as int), cast(s.words as int))), "
        f"cast(s.times as int)))))[0]")
    c = F.col
    return (docs.withColumn(k_mark + "_", F.xxhash64(c(text_col)))
            .join(used, c(id_col).eqNullSafe(c(k_id)) & c(source_col).eqNullSafe(c(k_source))
                  & (c(k_mark + "_") == c(k_mark)))
            .dropDuplicates([id_col, source_col, k_mark])
            .withColumn(text_col, F.regexp_replace(text, r"^[\x20\x09-\x0D]", ""))
            .select(*docs.columns))
