"""Sync -- events, job code and markdown into the graph and a stored chunk
index.

The index is a table kept by chunk id (``sources.keyed``).  A sync replaces the
chunks that changed and leaves all others, so it rewrites only the buckets of
changed ids; ids that are no longer built stay, as in the reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunks import build_chunks
from ..operators.codematch import match_code
from ..operators.graph_ops import graph_stats
from ..operators.lineage_graph import LineageGraph, build_graph
from ..sources.keyed import KeyedTable


def index_table(spark: SparkSession, store: str, buckets: int = 64) -> KeyedTable:
    """The stored chunk index."""
    return KeyedTable(spark, store, ["id"], buckets)


def sync(spark: SparkSession, events: DataFrame, code: DataFrame | None,
         markdown: DataFrame | None, store: str,
         buckets: int = 64) -> tuple[LineageGraph, DataFrame, list[int]]:
    """Build the graph, attach code (G14), build chunks (R05) and upsert them
    (S12): the graph, the stored index and the buckets that were rewritten."""
    g = build_graph(events, materialize=True)
    job_code = None
    if code is not None:
        job_code = (match_code(g.jobs, code).filter(F.col("code").isNotNull())
                    .select("job_key", "code"))
    index = index_table(spark, store, buckets)
    touched = index.replace(build_chunks(g, job_code=job_code, markdown=markdown))
    return g, index.read(), touched


def sync_counts(g: LineageGraph, index: DataFrame) -> DataFrame:
    """The counts that a sync reports."""
    return graph_stats(g, index)
