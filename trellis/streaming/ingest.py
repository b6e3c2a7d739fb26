"""Near-real-time ingest of lineage events.

``stream_ingest`` reads new NDJSON event files with Structured Streaming and,
per micro-batch, merges the batch's graph into the stored graph.  The five graph
tables are kept by key (``sources.keyed``), and every aggregate of the graph is
mergeable (first/last by order, distinct sets), so a batch reads and rewrites
only the buckets of the keys it mentions, merging is idempotent for a replayed
batch, and the stored graph equals ``build(all events)`` for any split of the
events into files and batches.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage_graph import (LineageGraph, build_column_lineage, build_edges, build_jobs,
                                       build_nodes_datasets, build_runs, clean_events, run_stats,
                                       sightings)
from ..schemas import EVENT
from ..session import cut_lineage
from ..sources.keyed import KeyedTable


def write_event_files(events: DataFrame, path: str) -> None:
    """Write events as NDJSON files (the shape a lineage listener emits), one
    per partition."""
    cols = [f.name for f in EVENT.fields if f.name != "_corrupt"]
    events.select(*cols).write.mode("overwrite").json(path)


def _merge_datasets(d: DataFrame) -> DataFrame:
    return (d.groupBy("key").agg(
        F.min_by(F.struct("namespace", "name"), "first_ord").alias("id"),
        F.max_by("format", "last_ord").alias("format"),
        F.max_by("schema", "schema_ord").alias("schema"),
        F.max("schema_ord").alias("schema_ord"),
        F.max("last_seen").alias("last_seen"),
        F.min("first_ord").alias("first_ord"),
        F.max("last_ord").alias("last_ord"))
        .select("key", "id.namespace", "id.name", "format",
                F.coalesce("schema", F.array().cast("array<string>")).alias("schema"),
                "last_seen", "first_ord", "last_ord", "schema_ord"))


def _merge_jobs(j: DataFrame) -> DataFrame:
    return (j.groupBy("key").agg(F.min_by(F.struct("namespace", "name"), "first_ord").alias("id"),
                                 F.min("first_ord").alias("first_ord"))
            .select("key", "id.namespace", "id.name", "first_ord"))


def _merge_edges(e: DataFrame) -> DataFrame:
    return e.select("src", "dst", "relation").distinct()


RUN_ID = ["job_key", "event_type", "event_time", "source_file", "seq"]


def _merge_runs(r: DataFrame) -> DataFrame:
    return r.dropDuplicates(RUN_ID)


def _merge_column_lineage(cl: DataFrame) -> DataFrame:
    rows = (cl.groupBy("dataset_key", "out_field", "src_table", "src_field")
            .agg(F.min_by(F.struct("src_key", "type", "subtype"), "src_ord").alias("a"),
                 F.min("field_ord").alias("field_ord"), F.min("src_ord").alias("src_ord"))
            .select("dataset_key", "out_field", "src_table", "src_field", "a.src_key",
                    "a.type", "a.subtype", "field_ord", "src_ord"))
    field = Window.partitionBy("dataset_key", "out_field")
    return rows.withColumn("field_ord", F.min("field_ord").over(field))


#: Graph table -> (key of its buckets, merge of stored and new rows).
MERGES = {
    "datasets": (["key"], _merge_datasets),
    "jobs": (["key"], _merge_jobs),
    "edges": (["src", "dst", "relation"], _merge_edges),
    "runs": (RUN_ID, _merge_runs),
    "column_lineage": (["dataset_key", "out_field"], _merge_column_lineage),
}


def graph_tables(spark: SparkSession, store: str, buckets: int = 16) -> dict[str, KeyedTable]:
    """The five graph tables of a store, each kept by its key."""
    return {name: KeyedTable(spark, os.path.join(store, name), key, buckets)
            for name, (key, _) in MERGES.items()}


def merge_into_store(spark: SparkSession, g: LineageGraph, store: str,
                     buckets: int = 16) -> dict[str, list[int]]:
    """Merge a graph into the stored one; the buckets rewritten, by table."""
    return {name: kept.merge(getattr(g, name), MERGES[name][1])
            for name, kept in graph_tables(spark, store, buckets).items()}


def stored_graph(spark: SparkSession, store: str, buckets: int = 16) -> LineageGraph | None:
    """The stored graph, or None before the first batch."""
    tables = {n: t.read() for n, t in graph_tables(spark, store, buckets).items()}
    return None if tables["jobs"] is None else LineageGraph(**tables)


def batch_graph(events: DataFrame) -> LineageGraph:
    """The graph of a batch for one merge: cleaned events and sightings are
    written once; the tables are not, as the merge writes each by bucket."""
    ev = cut_lineage(clean_events(events), "events")
    s = cut_lineage(sightings(ev), "sightings")
    return LineageGraph(datasets=build_nodes_datasets(s), jobs=build_jobs(ev),
                        edges=build_edges(s), runs=build_runs(ev),
                        column_lineage=build_column_lineage(s))


def event_stream(spark: SparkSession, src: str, max_files_per_trigger: int) -> DataFrame:
    """New event files under ``src``, with the file of every row."""
    return (spark.readStream.schema(EVENT)
            .option("maxFilesPerTrigger", max_files_per_trigger)
            .option("columnNameOfCorruptRecord", "_corrupt")
            .json(src)
            .select("*", F.col("_metadata.file_path").alias("source_file")))


def stream_ingest(spark: SparkSession, src: str, store: str, checkpoint: str,
                  max_files_per_trigger: int = 1000, available_now: bool = True,
                  buckets: int = 16):
    """Ingest event files under ``src`` into the stored graph.

    Returns the streaming query (already finished when ``available_now``).
    """
    def per_batch(df: DataFrame, batch_id: int) -> None:
        numbered = df.withColumn("seq", F.monotonically_increasing_id())
        merge_into_store(spark, batch_graph(numbered), store, buckets)

    writer = (event_stream(spark, src, max_files_per_trigger).writeStream
              .foreachBatch(per_batch).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime="30 seconds")
    q = writer.start()
    if available_now:
        q.awaitTermination()
    return q


def stream_run_stats(spark: SparkSession, src: str, checkpoint: str, store: str,
                     max_files_per_trigger: int = 1000, buckets: int = 16) -> DataFrame:
    """Run counts per job kept up to date by a streaming aggregation.

    The aggregation runs in update mode: a trigger emits the jobs whose counts
    it changed, and they replace their rows in a table kept by job.  Late
    events change their job's counts like any other (the state holds one row
    per job, so no watermark drops them); an event delivered twice is two runs,
    as in the batch counts.
    """
    stats = run_stats(build_runs(clean_events(
        event_stream(spark, src, max_files_per_trigger)
        .withColumn("seq", F.lit(0).cast("long")))))
    kept = KeyedTable(spark, store, ["job_key"], buckets)
    q = (stats.writeStream.outputMode("update")
         .foreachBatch(lambda df, batch_id: kept.replace(df))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    rows = kept.read()
    return spark.createDataFrame([], stats.schema) if rows is None else rows
