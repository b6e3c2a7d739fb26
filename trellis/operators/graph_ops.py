"""Queries over the lineage graph tables.

Lookups that the reference runs for one name at a time are written as joins
against a *table* of requests, so a batch of names costs one plan.  Bounded
walks (impact, column trace) are unrolled level loops: one join per level,
each level checkpointed so plans stay flat and a lost executor recomputes one
level only.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import by_shuffle, cut_lineage, drop_cut, scratch_path
from .lineage_graph import LineageGraph

MAX_DEPTH = 6


# ------------------------------------------------------------ matching


def find_datasets(g: LineageGraph, q: str, ns: str | None = None,
                  how: str = "contains") -> DataFrame:
    """datasets by case-insensitive substring (or equality) of the
    name, plus an optional namespace substring."""
    d = g.datasets
    name_l = F.lower("name")
    q_l = F.lit(q.strip().lower())
    cond = name_l.contains(q_l) if how == "contains" else name_l == q_l
    if ns:
        cond = cond & F.lower("namespace").contains(F.lit(ns.strip().lower()))
    return d.filter(cond)


def list_datasets(g: LineageGraph) -> DataFrame:
    """key, namespace, name of every dataset."""
    return g.datasets.select("key", "namespace", "name")


def list_namespaces(g: LineageGraph) -> DataFrame:
    """Sorted distinct non-empty namespaces."""
    return (g.datasets.select("namespace").filter(F.col("namespace") != "")
            .distinct().orderBy("namespace"))


def suggest(g: LineageGraph, kind: str, text: str, ns: str | None = None,
            limit: int = 50) -> DataFrame:
    """distinct names containing ``text`` (case-insensitive), sorted,
    first ``limit`` (the limit is the feature: an autocomplete list)."""
    n = g.nodes.filter(F.col("kind") == kind)
    if ns:
        n = n.filter(F.col("namespace") == ns)
    return (n.filter(F.lower("name").contains(F.lit(text.lower())))
            .select("name").distinct().orderBy("name").limit(limit))


def search_field(g: LineageGraph, field: str) -> DataFrame:
    """datasets with a schema column or a column-lineage output whose
    name contains ``field``; a lineage hit is dropped when any schema hit of
    the same dataset starts with that output's name."""
    f = field.strip().lower()
    sch = (g.datasets.select("key", "name", "namespace", F.posexplode("schema")
                             .alias("pos", "entry"))
           .withColumn("col_name", F.lower(F.trim(F.split_part("entry", F.lit("("), F.lit(1)))))
           .filter(F.col("col_name").contains(f))
           .select("key", "name", "namespace", F.lit("schema").alias("source"),
                   F.col("entry").alias("hit"), "pos"))
    outs = (g.column_lineage.select(F.col("dataset_key").alias("key"), "out_field")
            .distinct().filter(F.lower("out_field").contains(f)))
    hits_per_ds = sch.groupBy("key").agg(F.collect_list("hit").alias("schema_hits"))
    lin = (outs.join(hits_per_ds, "key", "left")
           .filter(~F.coalesce(F.exists(F.col("schema_hits"),
                                        lambda h: h.startswith(F.col("out_field"))),
                               F.lit(False)))
           .join(g.datasets.select("key", "name", "namespace"), "key")
           .select("key", "name", "namespace", F.lit("lineage output").alias("source"),
                   F.col("out_field").alias("hit"), F.lit(None).cast("int").alias("pos")))
    return sch.unionByName(lin)


# -------------------------------------------------------- joins / sets


def source_datasets(g: LineageGraph) -> DataFrame:
    """Datasets with no producing job."""
    prod = g.edges.filter(F.col("relation") == "produces").select(F.col("dst").alias("key"))
    return g.datasets.join(prod, "key", "left_anti")


def terminal_datasets(g: LineageGraph) -> DataFrame:
    """Datasets no job consumes."""
    cons = g.edges.filter(F.col("relation") == "feeds").select(F.col("src").alias("key"))
    return g.datasets.join(cons, "key", "left_anti")


def two_hop(g: LineageGraph) -> DataFrame:
    """Dataset -> job -> dataset, one hop each way."""
    f = g.edges.filter(F.col("relation") == "feeds").select(
        F.col("src").alias("ds_key"), F.col("dst").alias("job_key"))
    p = g.edges.filter(F.col("relation") == "produces").select(
        F.col("src").alias("job_key"), F.col("dst").alias("out_key"))
    return f.join(p, "job_key")


def impact_chain(g: LineageGraph) -> DataFrame:
    """The one-hop chains of every source dataset, with names."""
    src = source_datasets(g).select(F.col("key").alias("ds_key"),
                                    F.col("name").alias("ds_name"))
    jobs = g.jobs.select(F.col("key").alias("job_key"), F.col("name").alias("job_name"))
    outs = g.datasets.select(F.col("key").alias("out_key"), F.col("name").alias("out_name"))
    return two_hop(g).join(src, "ds_key").join(jobs, "job_key").join(outs, "out_key")


def find_jobs(g: LineageGraph, datasets: DataFrame | None = None) -> DataFrame:
    """Producers and consumers (sorted job names) per dataset."""
    d = (datasets if datasets is not None else g.datasets).select("key", "name", "namespace")
    jobs = by_shuffle(g.jobs.select(F.col("key").alias("job_key"), F.col("name").alias("job_name")))
    prod = (g.edges.filter(F.col("relation") == "produces")
            .select(F.col("dst").alias("key"), F.col("src").alias("job_key"))
            .join(jobs, "job_key").groupBy("key")
            .agg(F.array_sort(F.collect_list("job_name")).alias("producers")))
    cons = (g.edges.filter(F.col("relation") == "feeds")
            .select(F.col("src").alias("key"), F.col("dst").alias("job_key"))
            .join(jobs, "job_key").groupBy("key")
            .agg(F.array_sort(F.collect_list("job_name")).alias("consumers")))
    empty = F.array().cast("array<string>")
    return (d.join(by_shuffle(prod), "key", "left").join(by_shuffle(cons), "key", "left")
            .select("key", "name", "namespace",
                    F.coalesce("producers", empty).alias("producers"),
                    F.coalesce("consumers", empty).alias("consumers")))


def induced_subgraph(g: LineageGraph, ids: DataFrame) -> DataFrame:
    """Edges whose both ends are in ``ids(key)``."""
    k = ids.select("key").distinct()
    return (g.edges.join(k.withColumnRenamed("key", "src"), "src", "left_semi")
            .join(k.withColumnRenamed("key", "dst"), "dst", "left_semi"))


def adjacency(g: LineageGraph) -> tuple[DataFrame, DataFrame]:
    """Successors and predecessors per node (sorted lists)."""
    succ = g.edges.groupBy(F.col("src").alias("key")).agg(
        F.array_sort(F.collect_list("dst")).alias("successors"))
    pred = g.edges.groupBy(F.col("dst").alias("key")).agg(
        F.array_sort(F.collect_list("src")).alias("predecessors"))
    return succ, pred


def central(g: LineageGraph, dataset: str | None = None, job: str | None = None,
            ns: str | None = None) -> DataFrame:
    """Nodes whose name equals the requested dataset or job name."""
    n = g.nodes
    cond = F.lit(False)
    if dataset:
        cond = cond | ((F.col("kind") == "dataset") & (F.col("name") == dataset))
    if job:
        cond = cond | ((F.col("kind") == "job") & (F.col("name") == job))
    out = n.filter(cond)
    if ns:
        out = out.filter(F.col("namespace") == ns)
    return out


def _neighbours(g: LineageGraph, ids: DataFrame, direction: str) -> DataFrame:
    """(key, nbr) pairs one hop from ``ids`` in the given direction."""
    k = ids.select("key").distinct()
    down = g.edges.select(F.col("src").alias("key"), F.col("dst").alias("nbr"))
    up = g.edges.select(F.col("dst").alias("key"), F.col("src").alias("nbr"))
    if direction == "downstream":
        e = down
    elif direction == "upstream":
        e = up
    else:
        e = down.unionByName(up)
    return e.join(k, "key", "left_semi")


def expand(g: LineageGraph, ids: DataFrame, direction: str = "both",
           ns: str | None = None) -> DataFrame:
    """The node set grown by one hop (namespace filter on new nodes)."""
    nb = _neighbours(g, ids, direction).select(F.col("nbr").alias("key"))
    if ns:
        nb = nb.join(g.nodes.filter(F.col("namespace") == ns).select("key"), "key", "left_semi")
    return ids.select("key").unionByName(nb).distinct()


def expandable(g: LineageGraph, visible: DataFrame, direction: str = "both",
               ns: str | None = None) -> DataFrame:
    """Visible nodes that have at least one hidden neighbour."""
    nb = _neighbours(g, visible, direction)
    if ns:
        nb = nb.join(g.nodes.filter(F.col("namespace") == ns)
                     .select(F.col("key").alias("nbr")), "nbr", "left_semi")
    hidden = nb.join(visible.select(F.col("key").alias("nbr")), "nbr", "left_anti")
    return visible.select("key").join(hidden.select("key"), "key", "left_semi")


def graph_stats(g: LineageGraph, chunks: DataFrame | None = None) -> DataFrame:
    """Node, edge and chunk counts as one row (one aggregate over a
    tagged union, pivoted)."""
    parts = [("datasets", g.datasets), ("jobs", g.jobs), ("edges", g.edges)]
    if chunks is not None:
        parts.append(("chunks", chunks))
    tagged = None
    for tag, df in parts:
        t = df.select(F.lit(tag).alias("t"))
        tagged = t if tagged is None else tagged.unionByName(t)
    tags = [t for t, _ in parts]
    out = tagged.groupBy().pivot("t", tags).count()
    return out.select(*[F.coalesce(F.col(t), F.lit(0)).cast("bigint").alias(t) for t in tags])


# ---------------------------------------------------------------- walks


def impact(g: LineageGraph, roots: DataFrame, max_depth: int | None = MAX_DEPTH) -> DataFrame:
    """Downstream BFS from every root in ``roots(key)`` at once.

    Returns ``(root_key, node_key, depth, truncated)``: each node reached once,
    at its minimum depth; the root itself is never reported.  With
    ``max_depth=None`` the walk goes on until no root reaches a new node;
    otherwise ``truncated`` marks the nodes at the last level beyond which the
    walk would have reached more.  The frontier is keyed by ``(root, node)``;
    each level is one join with the edges and one anti-join with what that root
    already reached.
    """
    e = g.edges.select(F.col("src").alias("node_key"), F.col("dst").alias("nxt"))
    frontier = cut_lineage(roots.select(F.col("key").alias("root_key"),
                                        F.col("key").alias("node_key")).distinct())
    visited, levels, depth = frontier, [], 0

    def beyond() -> DataFrame:
        return (frontier.join(e, "node_key")
                .select("root_key", F.col("node_key").alias("via"), F.col("nxt").alias("node_key"))
                .join(visited, ["root_key", "node_key"], "left_anti"))

    while max_depth is None or depth < max_depth:
        nxt = cut_lineage(beyond().select("root_key", "node_key").distinct())
        if nxt.isEmpty():
            break
        depth += 1
        levels.append(nxt.withColumn("depth", F.lit(depth)))
        visited = visited.unionByName(nxt)
        frontier = nxt
    if not levels:
        return roots.sparkSession.createDataFrame(
            [], "root_key string, node_key string, depth int, truncated boolean")
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    if max_depth is None or depth < max_depth:
        return out.withColumn("truncated", F.lit(False))
    cut_at = (beyond().select("root_key", F.col("via").alias("node_key")).distinct()
              .withColumn("_more", F.lit(True)))
    return (out.join(cut_at, ["root_key", "node_key"], "left")
            .select("root_key", "node_key", "depth",
                    (F.coalesce("_more", F.lit(False)) & (F.col("depth") == depth))
                    .alias("truncated")))


def _numbered(g: LineageGraph, carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(nodes with a number and the columns ``carry``, pairs one edge apart)."""
    nodes = cut_lineage(g.nodes.select("key", (F.col("kind") == "dataset").alias("_ds"), *carry)
                        .withColumn("id", F.monotonically_increasing_id()), "reach_nodes")
    ids = nodes.select("key", "id")
    pairs = cut_lineage(
        g.edges.join(ids.withColumnsRenamed({"key": "src", "id": "a"}), "src")
        .join(ids.withColumnsRenamed({"key": "dst", "id": "b"}), "dst")
        .where("a <> b").select("a", "b", F.lit(1).alias("dist")).distinct(), "reach")
    return nodes, pairs


def _doubled(nodes: DataFrame, pairs: DataFrame, limit: int | None,
             pairs_per_node: int | None = None) -> tuple[DataFrame, int]:
    """(pairs up to ``step`` apart, step) of ``reach``, from those of ``_numbered``;
    with ``pairs_per_node`` no round starts from more pairs than that."""
    most = None if pairs_per_node is None else pairs_per_node * nodes.count()
    step = 1
    while ((limit is None or step < limit) and (most is None or pairs.count() <= most)
           and not (tips := pairs.where(F.col("dist") == step)).isEmpty()):
        onward = pairs.select(F.col("a").alias("mid"), F.col("b").alias("c"),
                              (F.col("dist") + step).alias("dist"))
        longer = (tips.select("a", F.col("b").alias("mid")).join(onward, "mid")
                  .where("a <> c").select("a", F.col("c").alias("b"), "dist"))
        if limit is not None:
            longer = longer.where(F.col("dist") <= limit)
        least = pairs.unionByName(longer).groupBy("a", "b").agg(F.min("dist").alias("dist"))
        if step == 1:
            least = least.join(nodes.where("_ds").select(F.col("id").alias("a")), "a", "left_semi")
        done, pairs = pairs, cut_lineage(least, "reach")
        drop_cut(done)
        step *= 2
    return pairs, step


def reach(g: LineageGraph, limit: int | None = None) -> DataFrame:
    """``(root_key, node_key, depth)`` for every dataset and all it leads to, at
    the least depth (``limit`` at most), by path doubling.

    A round starts from all pairs up to ``step`` apart.  A shortest path of
    ``step + 1`` to ``2 * step`` edges has a node exactly ``step`` from its
    start, so joining the pairs of that distance with all pairs finds every
    one of them, and the least sum is its length.  The rounds are the logarithm
    of the greatest depth (two more at most), and cycles end by themselves: a
    pair never returns.  Edges lead from datasets to jobs and back, so after
    the first round only datasets start a path that can be continued.  Keys
    travel as numbers; each round is written once and replaces the last.
    """
    nodes, pairs = _numbered(g)
    pairs, _ = _doubled(nodes, pairs, limit)
    datasets = nodes.where("_ds").select(F.col("id").alias("a"))
    return _keyed(nodes, pairs.join(datasets, "a", "left_semi"))


def _keyed(nodes: DataFrame, pairs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Numbered pairs by key, with the columns ``carry`` of the node reached.
    Few nodes, as counted, meet the pairs without a shuffle."""
    few = nodes.limit(NODES_SENT + 1).count() <= NODES_SENT
    ends = [nodes.select(F.col("key").alias("root_key"), F.col("id").alias("a")),
            nodes.select(F.col("key").alias("node_key"), F.col("id").alias("b"), *carry)]
    roots, reached = (F.broadcast(x) if few else x for x in ends)
    return pairs.join(roots, "a").join(reached, "b").select(
        "root_key", "node_key", F.col("dist").alias("depth"), *carry)


#: Pairs a node that the doubling of ``reach_from`` may start a round with.
PAIRS_PER_NODE = 256
#: Edges that may travel to the tasks of a walk, nodes that may, and places (roots
#: times nodes) that a task marks at once.
EDGES_SENT, NODES_SENT, PLACES = 4_000_000, 500_000, 1 << 26


def _walks(ids: np.ndarray, begin: np.ndarray, onward: np.ndarray, rows: int = 1 << 16):
    """The function of a task that walks from its roots, level by level: node ``i``
    has the number ``ids[i]`` and leads to ``onward[begin[i]:begin[i + 1]]``."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("dist", pa.int32())])
    size = len(ids)

    def walk(roots: np.ndarray):
        who, at = np.arange(len(roots)), np.searchsorted(ids, roots)
        seen = np.zeros(len(roots) * size, dtype=bool)
        seen[who * size + at] = True
        held, n, depth = [], 0, 0
        while len(who):
            depth += 1
            first = begin[at]
            many = begin[at + 1] - first
            ends = np.cumsum(many)
            edge = np.arange(ends[-1]) + np.repeat(first - ends + many, many)
            place = np.repeat(who * size, many) + onward[edge]
            place = np.unique(place[~seen[place]])
            seen[place] = True
            who = place // size
            at = place - who * size
            held.append((roots[who], ids[at], np.full(len(who), depth, dtype=np.int32)))
            n += len(who)
            if n >= rows or not len(who):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*held)], schema=schema)
                held, n = [], 0

    def fn(batches):
        for batch in batches:
            roots = np.intersect1d(batch.column(0).to_numpy(zero_copy_only=False), ids)
            step = max(1, PLACES // max(size, 1))
            for i in range(0, len(roots), step):
                yield from walk(roots[i:i + step])
    return fn


def reach_from(g: LineageGraph, roots: DataFrame, pairs_per_node: int = PAIRS_PER_NODE,
               carry: Sequence[str] = ()) -> DataFrame:
    """The rows of ``reach`` for ``roots(key)``, datasets, without the pairs of
    all others; ``carry`` names further columns of the node reached.

    Edges that are few, as counted, travel to the tasks as numbers, and each task
    walks from some of the roots to the end, with bounded marks, so the depth
    takes no rounds and only the rows of the result are written.

    More edges are walked in rounds.  Doubling goes on while the pairs up to
    ``step`` apart are few a node; then the walk goes on from the roots alone,
    ``step`` edges at a time.  All nodes up to ``far`` from a root are known, and
    a shortest path to one of the next ``step`` has a node exactly ``far`` from
    it, so joining the nodes of that distance with the pairs finds all of them.
    Only new nodes are kept, level by level in one written table.
    """
    nodes, pairs = _numbered(g, carry)
    spark = g.edges.sparkSession
    start = (nodes.join(by_shuffle(roots.select("key").distinct()), "key", "left_semi")
             .where("_ds").select(F.col("id").alias("a")))
    if pairs.limit(EDGES_SENT + 1).count() <= EDGES_SENT:
        edges = pairs.select("a", "b").toArrow()
        a, b = (edges[c].to_numpy() for c in ("a", "b"))
        ids, order = np.unique(np.concatenate([a, b])), np.argsort(a, kind="stable")
        begin = np.searchsorted(a[order], np.append(ids, np.iinfo(np.int64).max))
        onward = np.searchsorted(ids, b[order])
        start = cut_lineage(start, "roots")
        tasks = max(spark.sparkContext.defaultParallelism, -(-start.count() * len(ids) // PLACES))
        return _keyed(nodes, start.repartition(tasks).mapInArrow(
            _walks(ids, begin, onward), "a bigint, b bigint, dist int"), carry)
    pairs, step = _doubled(nodes, pairs, None, pairs_per_node)
    pairs = by_shuffle(pairs)
    path = scratch_path(spark, "reach_from")
    far, level = step, 0
    new = pairs.join(start, "a", "left_semi")
    while True:
        new.write.parquet(f"{path}/level={level}")
        found = spark.read.parquet(path)
        tips = found.where((F.col("level") == level) & (F.col("dist") == far))
        if tips.isEmpty():
            return _keyed(nodes, found.drop("level"), carry)
        onward = pairs.select(F.col("a").alias("mid"), F.col("b").alias("c"),
                              (F.col("dist") + far).alias("dist"))
        new = (by_shuffle(tips.select("a", F.col("b").alias("mid"))).join(onward, "mid")
               .where("a <> c").groupBy("a", F.col("c").alias("b")).agg(F.min("dist").alias("dist"))
               .join(by_shuffle(found.select("a", "b")), ["a", "b"], "left_anti"))
        far, level = far + step, level + 1


def impact_of_all(g: LineageGraph, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The rows of ``impact`` with every dataset as root, by path doubling
    one level beyond the cap, where the truncated walks show."""
    pairs = reach(g, max_depth + 1)
    beyond = pairs.where(F.col("depth") == max_depth + 1).select(
        "root_key", F.col("node_key").alias("dst"))
    cut_at = (beyond.join(g.edges.select("src", "dst"), "dst")
              .select("root_key", F.col("src").alias("node_key"),
                      F.lit(max_depth).alias("depth")).distinct()
              .withColumn("_more", F.lit(True)))
    return (pairs.where(F.col("depth") <= max_depth)
            .join(cut_at, ["root_key", "node_key", "depth"], "left")
            .select("root_key", "node_key", "depth",
                    F.coalesce("_more", F.lit(False)).alias("truncated")))


def with_names(g: LineageGraph, rows: DataFrame) -> DataFrame:
    """Impact rows with the reached node's kind and name."""
    return rows.join(g.nodes.select(F.col("key").alias("node_key"), "kind", "name"), "node_key")


def impact_named(g: LineageGraph, roots: DataFrame, max_depth: int | None = MAX_DEPTH) -> DataFrame:
    """Impact rows of the roots with the reached node's kind and name."""
    return with_names(g, impact(g, roots, max_depth))


def impact_by_name(g: LineageGraph, name: str, ns: str | None = None,
                   how: str = "exact", max_depth: int | None = MAX_DEPTH) -> DataFrame:
    """Impact of every dataset matching ``name`` (exact or substring)."""
    roots = find_datasets(g, name, ns, how).select("key")
    return impact_named(g, roots, max_depth)


def impact_layers(impact_rows: DataFrame) -> DataFrame:
    """Nested form: one row per (root, depth) with the sorted ``[kind] name`` list."""
    return (impact_rows.groupBy("root_key", "depth")
            .agg(F.array_sort(F.collect_list(F.concat(F.lit("["), F.col("kind"), F.lit("] "),
                                                      F.col("name")))).alias("layer")))


def transitive_chain(g: LineageGraph, max_depth: int | None = None) -> DataFrame:
    """The documented transitive chain: impact of every source dataset,
    followed to its end (``reach_from``) unless ``max_depth`` stops it."""
    sources = source_datasets(g).select("key")
    if max_depth is not None:
        return impact_named(g, sources, max_depth)
    return reach_from(g, sources, carry=("kind", "name")).withColumn("truncated", F.lit(False))


def dataset_schema(g: LineageGraph, name: str, ns: str | None = None) -> DataFrame:
    """Schema and column lineage of the *first* dataset matching."""
    hits = find_datasets(g, name, ns, "contains")
    first = hits.orderBy("first_ord").limit(1).select("key", "name", "namespace", "schema")
    cl = (g.column_lineage.groupBy("dataset_key", "out_field")
          .agg(F.min("field_ord").alias("fo"),
               F.array_join(F.transform(F.array_sort(F.collect_list(
                   F.struct("src_ord", F.concat("src_table", F.lit("."), "src_field")
                            .alias("s")))), lambda x: x["s"]), ", ").alias("srcs"))
          .select(F.col("dataset_key").alias("key"), "fo",
                  F.concat(F.col("out_field"), F.lit(" ← "), F.col("srcs")).alias("line")))
    lines = (cl.join(first.select("key"), "key", "left_semi").groupBy("key")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("fo", "line"))),
                              lambda x: x["line"]).alias("lineage")))
    return first.join(lines, "key", "left").select(
        "key", "name", "namespace", F.array_join("schema", ", ").alias("schema"),
        F.array_join(F.coalesce("lineage", F.array().cast("array<string>")), "\n")
        .alias("lineage"))


def column_trace(g: LineageGraph, roots: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Backwards walk through column lineage from ``roots(key[, field])``.

    Nodes are ``(lower-cased table name, field)``; a table name resolves to
    its first dataset by lower-cased name (first homonym, as the reference
    does).  Breadth-first over nodes, each reached once per (root, field) at
    its minimum depth; nodes up to ``max_depth`` are expanded.  Output rows
    are the expanded lineage edges ``(root_key, root_field, depth, dataset,
    field, src_dataset, src_field, type, subtype, revisited, truncated)``:
    ``revisited`` marks a source reached earlier (cycle or diamond),
    ``truncated`` a first reach beyond the depth cap.
    """
    resolve = (g.datasets.select(F.lower("name").alias("lname"), "key", "first_ord")
               .groupBy("lname").agg(F.min_by("key", "first_ord").alias("rkey")))
    cl = g.column_lineage.filter(F.col("src_table").isNotNull()).select(
        F.col("dataset_key").alias("rkey"), F.col("out_field").alias("field"),
        F.col("src_table").alias("src_dataset"), "src_field", "type", "subtype")
    edges = cut_lineage(resolve.join(cl, "rkey").drop("rkey")
                        .withColumn("lsrc", F.lower("src_dataset")), "trace_edges")
    hop = edges.select("lname", "field", F.col("lsrc").alias("nl"),
                       F.col("src_field").alias("nf")).distinct()
    names = g.datasets.select(F.col("key").alias("root_key"), F.lower("name").alias("lname"))
    r = roots.select(F.col("key").alias("root_key"),
                     *([F.col("field").alias("root_field")] if "field" in roots.columns else []))
    if "root_field" not in r.columns:
        r = r.join(g.column_lineage.select(F.col("dataset_key").alias("root_key"),
                                           F.col("out_field").alias("root_field")).distinct(),
                   "root_key")
    keys = ["root_key", "root_field", "lname", "field"]
    frontier = cut_lineage(r.join(names, "root_key")
                           .select("root_key", "root_field", "lname",
                                   F.col("root_field").alias("field")), "trace_level")
    levels = [frontier.withColumn("depth", F.lit(0))]
    visited = frontier
    for depth in range(1, max_depth + 2):
        nxt = (frontier.join(hop, ["lname", "field"])
               .select("root_key", "root_field", F.col("nl").alias("lname"),
                       F.col("nf").alias("field"))
               .join(visited, keys, "left_anti").distinct())
        nxt = cut_lineage(nxt, "trace_level")
        if nxt.isEmpty():
            break
        levels.append(nxt.withColumn("depth", F.lit(depth)))
        visited = visited.unionByName(nxt)
        frontier = nxt
    nodes = levels[0]
    for lv in levels[1:]:
        nodes = nodes.unionByName(lv)
    src_depth = nodes.select("root_key", "root_field", F.col("lname").alias("lsrc"),
                             F.col("field").alias("src_field"),
                             F.col("depth").alias("src_depth"))
    out = (nodes.filter(F.col("depth") <= max_depth).join(edges, ["lname", "field"])
           .join(src_depth, ["root_key", "root_field", "lsrc", "src_field"], "left"))
    fresh = F.col("src_depth") == F.col("depth") + 1
    return out.select("root_key", "root_field", "depth", F.col("lname").alias("dataset"),
                      "field", "src_dataset", "src_field", "type", "subtype",
                      (~fresh).alias("revisited"),
                      (fresh & (F.col("depth") + 1 > max_depth)).alias("truncated"))


def sort_distinct(df: DataFrame, col: str) -> DataFrame:
    """K01."""
    return df.select(col).distinct().orderBy(col)


def longest_match(cands: DataFrame, key: Sequence[str], name: str = "name") -> DataFrame:
    """Per key, the longest candidate name (ties: name ascending)."""
    w = Window.partitionBy(*key).orderBy(F.length(name).desc(), F.col(name).asc())
    return cands.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")

