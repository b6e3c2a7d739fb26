"""Lineage graph as tables.

The reference keeps a property graph in one process; here it is five
DataFrames built with explode + aggregate, so each piece is a shuffle keyed by
node:

* ``datasets(key, namespace, name, format, schema, last_seen, first_ord)``
* ``jobs(key, namespace, name, first_ord)``
* ``edges(src, dst, relation)`` -- ``feeds`` dataset->job, ``produces`` job->dataset
* ``runs(job_key, event_type, event_time, source_file, seq)``
* ``column_lineage(dataset_key, out_field, src_table, src_field, src_key, type,
  subtype, field_ord, src_ord)``

"Last wins" and "first wins" follow ``ord = (eventTime, source_file, seq, io,
position)``; a distributed read has no global line order, so event time leads.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import by_shuffle, cut_lineage, drop_cut
from ..functions.lineage import (dataset_key, dataset_name, dataset_ns, first_transform,
                                 infer_format, job_key, job_short_name, render_schema)


@dataclass
class LineageGraph:
    datasets: DataFrame
    jobs: DataFrame
    edges: DataFrame
    runs: DataFrame
    column_lineage: DataFrame

    @property
    def nodes(self) -> DataFrame:
        """All nodes: ``key, kind, namespace, name``."""
        d = self.datasets.select("key", F.lit("dataset").alias("kind"), "namespace", "name")
        j = self.jobs.select("key", F.lit("job").alias("kind"), "namespace", "name")
        return d.unionByName(j)


def _event_ord() -> list[Column]:
    return [F.coalesce(F.col("eventTime"), F.lit("")).alias("t"),
            F.coalesce(F.col("source_file"), F.lit("")).alias("f"),
            F.col("seq").alias("s")]


def clean_events(events: DataFrame) -> DataFrame:
    """Good events with the job fields resolved; bad ones are left out
    (see ``sources.events.quarantine`` to keep them)."""
    ok = events.filter(F.col("_corrupt").isNull() & F.col("job.name").isNotNull()) \
        if "_corrupt" in events.columns else events.filter(F.col("job.name").isNotNull())
    name = job_short_name(F.col("job.name"))
    return ok.select(
        job_key(F.col("job.namespace"), name).alias("job_key"),
        F.coalesce(F.col("job.namespace"), F.lit("")).alias("job_namespace"),
        name.alias("job_name"),
        "eventType", "eventTime", "inputs", "outputs",
        F.struct(*_event_ord()).alias("ev_ord"),
        "source_file", "seq")


def sightings(ev: DataFrame) -> DataFrame:
    """Every dataset mention with its job, direction and order."""
    def side(col: str, io: int) -> DataFrame:
        return (ev.select("job_key", "ev_ord", "eventTime",
                          F.posexplode(col).alias("pos", "ds"))
                .withColumn("io", F.lit(io)))
    s = side("inputs", 0).unionByName(side("outputs", 1))
    raw = F.col("ds.name")
    fields = F.col("ds.facets.schema.fields")
    name = dataset_name(raw)
    return s.select(
        "job_key", "io", "eventTime",
        F.struct(F.col("ev_ord.t"), F.col("ev_ord.f"), F.col("ev_ord.s"), F.col("io"),
                 F.col("pos")).alias("ord"),
        dataset_key(raw).alias("ds_key"),
        dataset_ns(raw).alias("namespace"),
        name.alias("name"),
        infer_format(name, fields).alias("format"),
        render_schema(fields).alias("schema"),
        F.col("ds.facets.columnLineage.fields").alias("lineage"))


def build_nodes_datasets(s: DataFrame) -> DataFrame:
    """A05 + A07: one row per dataset; format and schema from the last
    non-empty sighting, identity from the first."""
    return (s.groupBy(F.col("ds_key").alias("key"))
            .agg(F.min_by(F.struct("namespace", "name"), F.col("ord")).alias("id"),
                 F.max_by("format", F.col("ord")).alias("format"),
                 F.max_by("schema", F.when(F.size("schema") > 0, F.col("ord")))
                 .alias("schema"),
                 F.max("eventTime").alias("last_seen"),
                 F.min("ord").alias("first_ord"),
                 F.max("ord").alias("last_ord"),
                 F.max(F.when(F.size("schema") > 0, F.col("ord"))).alias("schema_ord"))
            .select("key", "id.namespace", "id.name", "format",
                    F.coalesce("schema", F.array().cast("array<string>")).alias("schema"),
                    "last_seen", "first_ord", "last_ord", "schema_ord"))


def build_jobs(ev: DataFrame) -> DataFrame:
    """One row per job key, first sighting wins."""
    return (ev.groupBy(F.col("job_key").alias("key"))
            .agg(F.min_by(F.struct(F.col("job_namespace").alias("namespace"),
                                   F.col("job_name").alias("name")), "ev_ord").alias("id"),
                 F.min("ev_ord").alias("first_ord"))
            .select("key", "id.namespace", "id.name", "first_ord"))


def build_runs(ev: DataFrame) -> DataFrame:
    """Run history: events with both a type and a time."""
    ok = (F.coalesce(F.col("eventType"), F.lit("")) != "") & \
         (F.coalesce(F.col("eventTime"), F.lit("")) != "")
    return ev.filter(ok).select("job_key", F.col("eventType").alias("event_type"),
                                F.col("eventTime").alias("event_time"), "source_file", "seq")


def build_edges(s: DataFrame) -> DataFrame:
    """One edge per (src, dst), ``feeds`` or ``produces``."""
    feeds = s.filter("io = 0").select(F.col("ds_key").alias("src"),
                                      F.col("job_key").alias("dst"),
                                      F.lit("feeds").alias("relation"))
    prods = s.filter("io = 1").select(F.col("job_key").alias("src"),
                                      F.col("ds_key").alias("dst"),
                                      F.lit("produces").alias("relation"))
    return feeds.unionByName(prods).distinct()


def build_column_lineage(s: DataFrame) -> DataFrame:
    """Union of sources per output field, distinct by (table, field),
    attributes of the first mention kept."""
    f = s.select("ds_key", "ord", F.posexplode("lineage").alias("fpos", "out_field", "meta"))
    i = f.select("ds_key", "ord", "fpos", "out_field",
                 F.posexplode_outer("meta.inputFields").alias("ipos", "inp"))
    src_raw = F.col("inp.name")
    rows = i.select(
        F.col("ds_key").alias("dataset_key"), "out_field",
        F.when(F.col("inp").isNotNull(), dataset_name(src_raw)).alias("src_table"),
        F.when(F.col("inp").isNotNull(), F.coalesce(F.col("inp.field"), F.lit("?")))
        .alias("src_field"),
        F.when(F.col("inp").isNotNull(), dataset_key(src_raw)).alias("src_key"),
        first_transform(F.col("inp.transformations"), "type").alias("type"),
        first_transform(F.col("inp.transformations"), "subtype").alias("subtype"),
        F.struct("ord", "fpos").alias("field_ord"),
        F.struct("ord", "fpos", "ipos").alias("src_ord"))
    merged = (rows.groupBy("dataset_key", "out_field", "src_table", "src_field")
              .agg(F.min_by(F.struct("src_key", "type", "subtype"), "src_ord").alias("a"),
                   F.min("field_ord").alias("field_ord"),
                   F.min("src_ord").alias("src_ord"))
              .select("dataset_key", "out_field", "src_table", "src_field", "a.src_key",
                      "a.type", "a.subtype", "field_ord", "src_ord"))
    # a field's position is its first mention over all of its sources
    w = Window.partitionBy("dataset_key", "out_field")
    return merged.withColumn("field_ord", F.min("field_ord").over(w))


class WrittenGraph(LineageGraph):
    """The graph of some events whose tables are built when first read: each is
    written once to the shared checkpoint folder, from cleaned events and
    sightings written once, and a query that reads two tables builds two.  The
    tables compress well, so their joins shuffle (``by_shuffle``)."""

    def __init__(self, events: DataFrame):
        self._events = events

    @cached_property
    def _clean(self) -> DataFrame:
        return cut_lineage(clean_events(self._events), "events")

    @cached_property
    def _sightings(self) -> DataFrame:
        return cut_lineage(sightings(self._clean), "sightings")

    @cached_property
    def datasets(self) -> DataFrame:
        return by_shuffle(cut_lineage(build_nodes_datasets(self._sightings), "datasets"))

    @cached_property
    def jobs(self) -> DataFrame:
        return by_shuffle(cut_lineage(build_jobs(self._clean), "jobs"))

    @cached_property
    def edges(self) -> DataFrame:
        return by_shuffle(cut_lineage(build_edges(self._sightings), "edges"))

    @cached_property
    def runs(self) -> DataFrame:
        return by_shuffle(cut_lineage(build_runs(self._clean), "runs"))

    @cached_property
    def column_lineage(self) -> DataFrame:
        return by_shuffle(cut_lineage(build_column_lineage(self._sightings), "column_lineage"))

    def drop(self) -> None:
        """Delete the tables written so far; they are built anew if read again."""
        for name in [n for n, t in vars(self).items() if n != "_events"]:
            drop_cut(vars(self).pop(name))

    @property
    def nodes(self) -> DataFrame:
        return by_shuffle(super().nodes)        # a union drops the requests of its sides


def build_graph(events: DataFrame, materialize: bool = False) -> LineageGraph:
    """Events -> datasets, jobs, edges, runs, column lineage; with
    ``materialize`` the tables that are read are written once each."""
    if materialize:
        return WrittenGraph(events)
    ev = clean_events(events)
    s = sightings(ev)
    return LineageGraph(datasets=build_nodes_datasets(s), jobs=build_jobs(ev),
                        edges=build_edges(s), runs=build_runs(ev),
                        column_lineage=build_column_lineage(s))


def run_stats(runs: DataFrame) -> DataFrame:
    """Completed / failed counts and the last event per job."""
    return (runs.groupBy("job_key")
            .agg(F.count_if(F.col("event_type") == "COMPLETE").cast("bigint")
                 .alias("n_complete"),
                 F.count_if(F.col("event_type") == "FAIL").cast("bigint").alias("n_fail"),
                 F.max_by(F.struct("event_type", "event_time"),
                          F.struct("event_time", "source_file", "seq")).alias("last")))


def export_graph(g: LineageGraph, code_matches: DataFrame | None = None):
    """Node list with flags, and the edge list."""
    nodes = g.nodes.alias("n")
    cl = g.column_lineage.select(F.col("dataset_key").alias("key")).distinct() \
        .withColumn("has_column_lineage", F.lit(True))
    fmt = g.datasets.select("key", "format")
    out = nodes.join(cl, "key", "left").join(fmt, "key", "left")
    if code_matches is not None:
        code = code_matches.select(F.col("job_key").alias("key")).distinct() \
            .withColumn("has_code", F.lit(True))
        out = out.join(code, "key", "left")
    else:
        out = out.withColumn("has_code", F.lit(None).cast("boolean"))
    out = out.select("key", "kind", "name", "namespace",
                     F.coalesce("has_code", F.lit(False)).alias("has_code"),
                     F.coalesce("has_column_lineage", F.lit(False)).alias("has_column_lineage"),
                     F.coalesce("format", F.lit("")).alias("format"))
    edges = g.edges.select(F.col("src").alias("source"), F.col("dst").alias("target"),
                           "relation")
    return out, edges
