"""Embedding near-duplicates by NN-descent, with link counts by blocked tiles.

Equal vectors of one label are one node.  Random hyperplane codes deal the
nodes into small blocks whose members become first neighbours; then rounds of
neighbours-of-neighbours joins refine the graph: every node compares all
members of its list, of which at least one must be new, and offers each what
beats the last place of its own list of ``width`` places.  A list whose last
place is still a link is saturated: its places are doubled, up to
``max_width``, and all it holds counts as new again, so that what it had no
room for is met once more.  A group gives the links that span it to the
components, so a link that even a list of ``max_width`` has no room for still
joins them, and no list of all links is stored.

Links are then counted inside each component by tiles of two blocks of at most
about TILE nodes, as partial sums per node.  A block's centre and radius decide
by the triangle inequality of angles which tiles hold links only or none; the
others are compared.  An audit holds the counts of nodes sampled from every
label and degree class against all vectors of their label; while a label or a
class stays below ``recall`` more rounds follow from new hyperplanes, and at
last a pass of tiles over whole labels, which misses nothing.  Cosines are
computed in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Cuts, partitions_of, slices
from .graphs import connected_components

CODE_BITS = 20              # hyperplanes per table; a label uses as many as its size asks for
BLOCK = 48                  # members that a block aims at
TILE = 512                  # nodes that a counting block aims at
STRIPE = 64                 # blocks of one group that meet all others in one task
MARGIN = 1e-6               # radians left to rounding before a tile is decided unseen
SALTS = 32                  # shares of a crowded cell that learn their number of lots apart
AUDIT_ROWS = 8192           # vectors that the audited nodes of a label meet in one group

_PAIRS = "v bigint, u bigint, sim double, spans boolean"


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column in one array, and where each list starts."""
    flat = np.asarray(column.flatten(), dtype=np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _unit(matrix: np.ndarray) -> np.ndarray:
    # scaling by the largest component first keeps the norm of tiny or huge vectors exact
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _codes(batches: Iterator[pa.RecordBatch], tables: list[int]):
    for batch in slices(batches, 2048):
        flat, at = _vectors(batch.column("vec"))
        codes = np.zeros((batch.num_rows, len(tables)), np.int64)
        for dim in np.unique(np.diff(at)):
            rows = np.flatnonzero(np.diff(at) == dim)
            matrix = _unit(np.stack([flat[at[r]:at[r] + dim] for r in rows]))
            for t, table in enumerate(tables):
                planes = np.random.default_rng([int(dim), table]).standard_normal((dim, CODE_BITS))
                codes[rows, t] = (matrix @ planes > 0) @ (1 << np.arange(CODE_BITS)[::-1])
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(batch.num_rows + 1) * len(tables), pa.int32()),
            pa.array(codes.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("node"), lists], names=["node", "codes"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups (column ``grp``) of a stream sorted by it."""
    held = None
    for batch in slices(batches, 8192):
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        key = held.column("grp").to_numpy()
        last = int(np.searchsorted(key, key[-1], side="left")) if len(key) else 0
        if last:
            yield held.slice(0, last)
            held = held.slice(last)
    if held is not None and held.num_rows:
        yield held


def _spanning(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends (i, j) of links that connect all that a symmetric matrix links."""
    waits = link.any(axis=1)
    ends = [np.zeros((2, 0), np.int64)]
    while waits.any():
        front = np.flatnonzero(waits)[:1]
        waits[front] = False
        while len(front):
            found = np.flatnonzero(link[front].any(axis=0) & waits)
            ends.append(np.stack([front[link[np.ix_(front, found)].argmax(axis=0)], found]))
            waits[found] = False
            front = found
    i, j = np.concatenate(ends, axis=1)
    return i, j


def _compared(batches: Iterator[pa.RecordBatch], width: int, threshold: float):
    """What each group's members offer each other: pairs (v, u, sim) for v's
    list, and the links that span the group (spans).  Columns: grp, node, vec,
    fresh (new in this list), floor (the sim to beat).  ``width`` is the most
    places that any list has."""
    for table in _groups(batches):
        table = table.combine_chunks()
        key, node = table.column("grp").to_numpy(), table.column("node").to_numpy()
        fresh, floor = table.column("fresh").to_numpy(), table.column("floor").to_numpy()
        flat, at = _vectors(table.column("vec").combine_chunks())
        edges = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        out, held = [], 0
        for a, b in zip(edges[:-1], edges[1:]):
            n = b - a
            if n < 2:
                continue
            x = _unit(flat[at[a]:at[b]].reshape(n, -1))
            sims = x @ x.T
            new = fresh[a:b][None, :] | fresh[a:b][:, None]
            np.fill_diagonal(new, False)
            link = sims >= threshold
            np.fill_diagonal(link, False)
            if (link & new).any():
                i, j = _spanning(link | link.T)
                out.append((node[a + i], node[a + j], sims[i, j], np.ones(len(i), bool)))
            useful = new & (sims > floor[a:b][:, None])
            if n > width + 1:           # only the best few can enter a list
                ranked = np.where(useful, sims, -2.0)
                useful &= ranked >= -np.partition(-ranked, width - 1, axis=1)[:, width - 1][:, None]
            i, j = np.nonzero(useful)
            out.append((node[a + i], node[a + j], sims[i, j], np.zeros(len(i), bool)))
            held += len(i)
            if held > 100_000:
                yield _pairs(out)
                out, held = [], 0
        if out:
            yield _pairs(out)


def _pairs(parts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)],
                                      names=["v", "u", "sim", "spans"])


class NNDescent:
    """The neighbour graph (v, u, sim, fresh) of ``nodes`` (node, label, vec),
    the lists that have grown (v, room), and the links met so far that connect
    what any compared group linked."""

    def __init__(self, nodes: DataFrame, cuts: Cuts, threshold: float, width: int,
                 max_width: int, gain: float = 0.001):
        self.nodes, self.cuts, self.threshold, self.gain = nodes, cuts, threshold, gain
        self.width, self.max_width = width, max(width, max_width)
        self.parts = partitions_of(nodes.sparkSession)
        self.graph: DataFrame | None = None
        self.spans: DataFrame | None = None
        self.rooms = nodes.sparkSession.createDataFrame([], "v bigint, room int")
        self.grown: list[int] = []          # lists enlarged after each comparison
        self.settled = False
        self.round = 0

    def _compare(self, members: DataFrame) -> DataFrame:
        width, threshold = self.max_width, self.threshold
        return (members.select("grp", "node", "vec", "fresh", "floor")
                .repartition(self.parts, "grp").sortWithinPartitions("grp")
                .mapInArrow(lambda b: _compared(b, width, threshold), _PAIRS))

    def seed(self, tables: list[int]) -> None:
        """First neighbours from the blocks of some hyperplane tables."""
        coded = (self.nodes.select("node", "vec")
                 .mapInArrow(lambda b: _codes(b, tables), "node bigint, codes array<bigint>")
                 .select("node", F.posexplode("codes").alias("tab", "code")))
        sizes = self.nodes.groupBy("label", "dim").agg(F.count("*").alias("n"))
        placed = self.cuts.cut(
            self.nodes.select("node", "label", "dim")
            .join(sizes.withColumn("bits", _bits(BLOCK)), ["label", "dim"]).join(coded, "node")
            .select("node", "label", "dim", "tab",
                    F.expr(f"shiftright(code, {CODE_BITS} - bits)").alias("code")), "codes")
        buckets = self.cuts.cut(placed.groupBy("label", "dim", "tab", "code")
                                .agg(F.count("*").alias("members")), "buckets")
        lot = F.pmod(F.xxhash64("node", "tab", F.lit(self.round)),
                     F.ceil(F.col("members") / BLOCK))
        members = (placed.join(buckets, ["label", "dim", "tab", "code"])
                   .select("node", F.xxhash64("label", "dim", "tab", "code", lot).alias("grp"))
                   .join(self.nodes.select("node", "vec"), "node")
                   .withColumns({"fresh": F.lit(True), "floor": F.lit(-2.0)}))
        self._merge(self._compare(members))
        self.cuts.drop(placed, buckets)

    def _merge(self, compared: DataFrame) -> None:
        """Put offered pairs into the lists, and spanning links to the others."""
        found = self.cuts.cut(compared, "found")
        spans = found.where("spans").select(F.least("v", "u").alias("a"),
                                            F.greatest("v", "u").alias("b"))
        if self.spans is not None:
            spans = spans.unionByName(self.spans)
        spans = self.cuts.cut(spans.distinct(), "spans")
        offered = found.where("NOT spans").select("v", "u", "sim", F.lit(False).alias("known"))
        if self.graph is not None:
            offered = offered.unionByName(
                self.graph.select("v", "u", "sim", F.lit(True).alias("known")))
        one = offered.groupBy("v", "u").agg(F.max("sim").alias("sim"),
                                            F.max("known").alias("known"))
        ranked = one.withColumn("place", F.row_number().over(
            W.partitionBy("v").orderBy(F.desc("sim"), "u")))
        listed = self.cuts.cut(
            ranked.where(F.col("place") <= self.max_width).join(self.rooms, "v", "left")
            .withColumn("room", F.coalesce("room", F.lit(self.width)))
            .where(F.col("place") <= F.col("room"))
            .select("v", "u", "sim", "known", "room", "place"), "listed")
        # the last place of a full list tells whether it is saturated
        saturated = ((F.col("place") == F.col("room")) & (F.col("sim") >= self.threshold)
                     & (F.col("room") < self.max_width))
        new = ~F.col("known") & (F.col("sim") >= self.threshold)
        seen = listed.agg(F.count_if(saturated).alias("grown"), F.count_if(new).alias("links"),
                          F.count("*").alias("places")).first()
        self.grown.append(seen["grown"])
        graph = listed.withColumn("fresh", ~F.col("known"))
        if seen["grown"]:
            full = listed.where(saturated).select(
                "v", F.least(F.col("room") * 2, F.lit(self.max_width)).alias("more"))
            rooms = self.cuts.cut(self.rooms.join(full, "v", "full")
                                  .select("v", F.coalesce("more", "room").alias("room")), "rooms")
            graph = listed.join(full, "v", "left").withColumn(
                "fresh", ~F.col("known") | F.col("more").isNotNull())
            self.cuts.drop(self.rooms)
            self.rooms = rooms
        graph = self.cuts.cut(graph.select("v", "u", "sim", "fresh"), "graph")
        self.cuts.drop(found, listed)
        if self.graph is not None:
            self.cuts.drop(self.graph, self.spans)
        self.graph, self.spans = graph, spans
        self.settled = not seen["grown"] and seen["links"] <= self.gain * seen["places"]

    def refine(self) -> bool:
        """One neighbours-of-neighbours round; whether another one is due: lists
        have grown, or more than ``gain`` of all places hold a new link."""
        self.round += 1
        g, width = self.graph, self.width
        floors = (g.groupBy("v").agg(F.count("*").alias("held"), F.min("sim").alias("least"))
                  .join(self.rooms, "v", "left")
                  .select("v", F.when(F.col("held") >= F.coalesce("room", F.lit(width)),
                                      F.col("least")).otherwise(F.lit(-2.0)).alias("floor")))
        # a list's owner is a neighbour of its members too; those who have a
        # popular member in their lists meet its own list in lots
        lots = g.groupBy(F.col("u").alias("grp")).agg(
            F.ceil(F.count("*") / (2 * width)).alias("lots"))
        own = (g.select(F.col("v").alias("grp"), F.col("u").alias("node"), "fresh")
               .join(lots, "grp", "left")
               .select("grp", "node", "fresh", F.explode(F.sequence(
                   F.lit(0).cast("bigint"), F.coalesce("lots", F.lit(1)) - 1)).alias("lot")))
        back = (g.select(F.col("u").alias("grp"), F.col("v").alias("node"), "fresh")
                .join(lots, "grp").select("grp", "node", "fresh", F.pmod(
                    F.xxhash64("node", "grp", F.lit(self.round)), F.col("lots")).alias("lot")))
        members = (own.unionByName(back).groupBy("grp", "lot", "node")
                   .agg(F.max("fresh").alias("fresh"))
                   .select(F.xxhash64("grp", "lot").alias("grp"), "node", "fresh"))
        known = self.cuts.cut(
            self.nodes.select("node", "vec").join(floors.withColumnRenamed("v", "node"), "node",
                                                  "left")
            .select("node", "vec", F.coalesce("floor", F.lit(-2.0)).alias("floor")), "vectors")
        self._merge(self._compare(members.join(known, "node")))
        self.cuts.drop(known)
        return not self.settled


def _bits(size: int):
    """Bits of a code that cut ``n`` nodes to about ``size``."""
    return F.least(F.lit(CODE_BITS), F.greatest(
        F.lit(0), F.ceil(F.log2(F.col("n") / size)).cast("int")))


def _with_lots(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """``rows`` (node, ...) with ``lots``: how many lots of about ``size`` rows
    their key is dealt into.  A crowded key's rows learn it in SALTS shares."""
    lots = (rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).alias("lots")).where("lots > 1")
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    salt = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(SALTS)).cast("int")
    return (rows.withColumn("salt", salt).join(lots, [*keys, "salt"], "left")
            .withColumn("lots", F.coalesce("lots", F.lit(1).cast("bigint"))).drop("salt"))


def _spheres(batches: Iterator[pa.RecordBatch]):
    """Centre and radius (angle) of each block of a stream sorted by grp."""
    for table in _groups(batches):
        table = table.combine_chunks()
        key, team = table.column("grp").to_numpy(), table.column("team").to_numpy()
        copies, node = table.column("copies").to_numpy(), table.column("node").to_numpy()
        flat, at = _vectors(table.column("vec").combine_chunks())
        edges = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        out = []
        for a, b in zip(edges[:-1], edges[1:]):
            x = _unit(flat[at[a]:at[b]].reshape(b - a, -1))
            total = x.sum(axis=0)
            centre = _unit((total if np.abs(total).max() > 1e-6 else x[0])[None, :])[0]
            radius = np.arccos(np.clip(x @ centre, -1, 1)).max()
            out.append((key[a], team[a], centre.tolist(), radius, copies[a:b].sum(), node[a]))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*out), kinds)],
            names=["block", "team", "centre", "radius", "copies", "first"])


def _tiled(batches: Iterator[pa.RecordBatch], threshold: float, with_spans: bool):
    """Of each tile (grp): how many rows the nodes of its first side link with
    on the other (node, near), and the links that span it (node, other)."""
    for table in _groups(batches):
        table = table.combine_chunks()
        key, node = table.column("grp").to_numpy(), table.column("node").to_numpy()
        copies, side = table.column("copies").to_numpy(), table.column("side").to_numpy()
        flat, at = _vectors(table.column("vec").combine_chunks())
        edges = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        for a, b in zip(edges[:-1], edges[1:]):
            x = _unit(flat[at[a]:at[b]].reshape(b - a, -1))
            one, two = np.flatnonzero(side[a:b] == 0), np.flatnonzero(side[a:b] == 1)
            link = (x[one] @ x[two].T >= threshold) & (node[a + one][:, None] != node[a + two])
            near = link @ copies[a + two]
            v, n, u = [node[a + one]], [near], [np.full(len(one), -1)]
            if with_spans and link.any():
                both = np.zeros((b - a, b - a), bool)
                both[np.ix_(one, two)] = link
                i, j = _spanning(both | both.T)
                v, n, u = v + [node[a + i]], n + [np.full(len(i), -1)], u + [node[a + j]]
            near = np.concatenate(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(v)), pa.array(near, mask=near < 0),
                 pa.array(np.concatenate(u), mask=near >= 0)], names=["node", "near", "other"])


def count_links(nodes: DataFrame, cuts: Cuts, threshold: float,
                with_spans: bool = False) -> DataFrame:
    """(node, near, other) over ``nodes`` (node, vec, copies, team): rows with
    ``near``, whose sum is the rows that a node links with inside its team, and
    with ``with_spans`` links (node, other) that connect what the teams link."""
    parts, c = partitions_of(nodes.sparkSession), F.col
    coded = (nodes.select("node", "vec")
             .mapInArrow(lambda b: _codes(b, [0]), "node bigint, codes array<bigint>"))
    sizes = nodes.groupBy("team").agg(F.count("*").alias("n")).withColumn("bits", _bits(TILE))
    placed = cuts.cut(nodes.join(sizes, "team").join(coded, "node").select(
        "node", "copies", "team", "vec",
        F.expr(f"shiftright(codes[0], {CODE_BITS} - bits)").alias("cell")), "cells")
    dealt = cuts.cut(_with_lots(placed, ["team", "cell"], TILE).select(
        "node", "copies", "vec", "team", F.xxhash64(
            "team", "cell", F.pmod(F.xxhash64("node"), c("lots"))).alias("block")), "dealt")
    blocks = cuts.cut(
        dealt.withColumnRenamed("block", "grp").repartition(parts, "grp")
        .sortWithinPartitions("grp").mapInArrow(
            _spheres, "block bigint, team bigint, centre array<double>, radius double, "
                      "copies bigint, first bigint"), "blocks")
    stripes = blocks.groupBy("team").agg(F.ceil(F.count("*") / STRIPE).alias("stripes"))
    striped = blocks.join(stripes, "team")
    one = striped.select("team", F.pmod("block", c("stripes")).alias("stripe"),
                         *[c(x).alias(f"{x}_1") for x in ("block", "centre", "radius", "first")])
    two = striped.select("team", F.explode(F.sequence(
        F.lit(0).cast("bigint"), c("stripes") - 1)).alias("stripe"),
        *[c(x).alias(f"{x}_2") for x in ("block", "centre", "radius", "first", "copies")])
    cosine = F.aggregate(F.zip_with("centre_1", "centre_2", lambda x, y: x * y), F.lit(0.0),
                         lambda x, y: x + y)
    angle, reach = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))), float(
        np.arccos(threshold))
    tiles = cuts.cut(
        one.join(two, ["team", "stripe"]).withColumn("angle", angle)
        .withColumn("spread", c("radius_1") + c("radius_2"))
        .where(c("angle") <= reach + c("spread") + MARGIN)
        .select("block_1", "block_2", "first_1", "first_2", "copies_2",
                (c("angle") + c("spread") <= reach - MARGIN).alias("whole")), "tiles")
    compared = tiles.where("NOT whole").select(
        F.xxhash64("block_1", "block_2").alias("grp"), F.explode(F.array(
            F.struct(F.lit(0).alias("side"), c("block_1").alias("block")),
            F.struct(F.lit(1).alias("side"), c("block_2").alias("block")))).alias("s"))
    counted = (compared.select("grp", "s.side", "s.block").join(dealt, "block")
               .select("grp", "side", "node", "copies", "vec")
               .repartition(parts, "grp").sortWithinPartitions("grp")
               .mapInArrow(lambda b: _tiled(b, threshold, with_spans),
                           "node bigint, near bigint, other bigint"))
    nil = F.lit(None).cast("bigint")
    sure = tiles.where("whole")
    inside = sure.groupBy(c("block_1").alias("block")).agg(
        F.sum("copies_2").alias("near"), F.max(c("block_1") == c("block_2")).alias("own"))
    counted = counted.unionByName(dealt.join(inside, "block").select(
        "node", (c("near") - F.when(c("own"), c("copies")).otherwise(0)).alias("near"),
        nil.alias("other")))
    if with_spans:
        hub = sure.select(c("block_2").alias("block"), c("first_1").alias("node"))
        counted = counted.unionByName(dealt.select("block", c("node").alias("other")).join(
            hub, "block").where("node <> other").select("node", nil.alias("near"), "other"))
    out = cuts.cut(counted, "counted")
    cuts.drop(placed, dealt, blocks, tiles)
    return out


def audit(counts: DataFrame, threshold: float, sample: int) -> float:
    """The least recall of any label or true degree class over ``counts`` (node,
    label, vec, copies, near): the mean, over the nodes with links that the
    sample stands for, of the part of a node's links that was counted.

    ``sample`` nodes are drawn from every degree class of every label and meet
    all vectors of their label in groups of about AUDIT_ROWS; the driver gets
    one number."""
    c, kind, cuts = F.col, ["label", "dim", "class"], Cuts(counts.sparkSession, "audit")
    rows = cuts.cut(_with_lots(counts.withColumns(
        {"dim": F.size("vec"), "class": F.ceil(F.log2(c("near") + 1))}),
        ["label", "dim"], AUDIT_ROWS), "rows")
    place = F.row_number().over(
        W.partitionBy(*kind).orderBy(F.xxhash64("node", F.lit(11)), "node"))
    sizes = rows.groupBy(*kind).agg(F.count("*").alias("nodes"))
    asked = cuts.cut(rows.withColumn("place", place).where(c("place") <= sample)
                     .join(sizes, kind).withColumn(
                         "weight", c("nodes") / F.least(c("nodes"), F.lit(sample))), "asked")
    sides = (asked.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("bigint"), c("lots") - 1)))
             .withColumn("side", F.lit(0))
             .unionByName(rows.withColumn("lot", F.pmod(F.xxhash64("node", F.lit(13)), c("lots")))
                          .withColumn("side", F.lit(1)), allowMissingColumns=True)
             .select(F.xxhash64("label", "dim", "lot").alias("grp"), "side", "node", "copies",
                     "vec"))
    found = (sides.repartition(partitions_of(counts.sparkSession), "grp")
             .sortWithinPartitions("grp")
             .mapInArrow(lambda b: _tiled(b, threshold, False),
                         "node bigint, near bigint, other bigint")
             .groupBy("node").agg(F.sum("near").alias("links")).where("links > 0"))
    judged = cuts.cut(asked.join(found, "node").select(
        "label", F.ceil(F.log2(c("links") + 1)).alias("class"), "weight",
        (c("weight") * c("near") / c("links")).alias("held")), "judged")
    recall = None
    for key in ("label", "class"):
        part = judged.groupBy(key).agg((F.sum("held") / F.sum("weight")).alias("recall"))
        part = part.select("recall")
        recall = part if recall is None else recall.unionByName(part)
    least = recall.agg(F.min("recall")).first()[0]
    cuts.drop(rows, asked, judged)
    return 1.0 if least is None else least


def near_duplicate_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                           label_col: str = "label", threshold: float = 0.93, width: int = 12,
                           max_width: int = 48, tables: int = 6, max_rounds: int = 8,
                           recall: float = 0.98, sample: int = 32,
                           retries: int = 3) -> DataFrame:
    """One row per input row: vec_id, n_links (other vectors linked directly),
    component_id (smallest vec_id reachable), kept (vec_id = component_id).

    Rows are compared only with rows of their label and length.  Rows with a
    null id, a null label, or a vector that is null, empty, zero or holds null
    or non-finite components link with nothing and are their own component.
    Equal vectors of a label are links of each other.  Empty table: no rows.
    Lists start with ``width`` places and grow to ``max_width``; links beyond
    that are not lost, as spanning links and the tiles find them.
    """
    cuts = Cuts(rows.sparkSession, "vectors")
    c = F.col
    given = rows.select(c(id_col).alias("vec_id"), c(vec_col).alias("vec"),
                        c(label_col).alias("label"))
    sound = (c("vec_id").isNotNull() & c("label").isNotNull() & F.coalesce(
        (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x)
                                       & (F.abs(x) < float("inf")))
        & F.exists("vec", lambda x: x != 0), F.lit(False)))
    given = cuts.cut(given.withColumn("sound", F.coalesce(sound, F.lit(False))), "rows")
    nodes = cuts.cut(given.where("sound").groupBy("label", "vec")
                     .agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
                     .withColumn("dim", F.size("vec")), "nodes")
    descent = NNDescent(nodes, cuts, threshold, width, max_width)

    def counted(found: DataFrame) -> DataFrame:
        near = (found.where("near IS NOT NULL").groupBy("node").agg(F.sum("near").alias("near")))
        return nodes.join(near, "node", "left").select(
            "node", "label", "vec", "copies", F.coalesce("near", F.lit(0)).alias("near"))

    for attempt in range(retries + 1):
        descent.seed(list(range(attempt * tables, (attempt + 1) * tables)))
        for _ in range(max_rounds):
            if not descent.refine():
                break
        parts = connected_components(descent.spans, cuts)
        counts = cuts.cut(counted(count_links(
            nodes.join(parts, "node").withColumnRenamed("component", "team"), cuts, threshold)),
            "counts")
        if audit(counts, threshold, sample) >= recall:
            break
    else:
        found = count_links(nodes.withColumn("team", F.xxhash64("label", "dim")), cuts, threshold,
                            with_spans=True)
        parts = connected_components(found.where("other IS NOT NULL").select(
            c("node").alias("a"), c("other").alias("b")), cuts)
        counts = cuts.cut(counted(found), "counts")
    facts = cuts.cut(
        counts.join(parts, "node", "left")
        .select("label", "vec", (c("near") + c("copies") - 1).alias("n_links"),
                F.coalesce("component", "node").alias("component_id")), "facts")
    placed = (given.where("sound").join(facts, ["label", "vec"])
              .select("vec_id", "n_links", "component_id"))
    alone = given.where("NOT sound").select("vec_id", F.lit(0).cast("bigint").alias("n_links"),
                                            c("vec_id").alias("component_id"))
    return placed.unionByName(alone).withColumn(
        "kept", F.coalesce(c("vec_id") == c("component_id"), F.lit(False)))
