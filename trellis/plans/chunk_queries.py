"""Registered chunk/index queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks as C
from ..operators.graph_ops import graph_stats, source_datasets
from ..sources.markdown import markdown_files
from . import oracle as O
from . import oracle_chunks  # noqa: F401  (registers the chunk CTEs)
from .graph_queries import exact_code, graph

NS = "s3_lake_raw"


def q_dataset_chunks(spark, d):
    return C.dataset_chunks(graph(spark, d))


def q_job_chunks(spark, d):
    return C.job_chunks(graph(spark, d))


def q_job_chunks_code(spark, d):
    """R02 with the code of the jobs that a file names exactly."""
    g = graph(spark, d)
    return C.job_chunks(g, exact_code(spark, d, g))


def q_impact_chunks(spark, d):
    return C.impact_chunks(graph(spark, d))


def q_sections(spark, d):
    return C.split_sections(markdown_files(spark, d))


def q_knowledge(spark, d):
    return C.knowledge_chunks(markdown_files(spark, d))


def q_index(spark, d):
    return C.build_chunks(graph(spark, d), markdown=markdown_files(spark, d))


def q_upsert(spark, d):
    g = graph(spark, d)
    old = C.dataset_chunks(g).unionByName(C.job_chunks(g)).withColumnRenamed("text",
                                                                             "document")
    src = source_datasets(g).select("key")
    new = (C.dataset_chunks(g).join(src.withColumnRenamed("key", "id"), "id", "left_semi")
           .unionByName(C.impact_chunks(g))
           .withColumn("document", F.concat(F.lit("passage: "), F.col("text"))).drop("text"))
    return C.upsert(old, new)


def q_get_chunks(spark, d):
    idx = C.build_chunks(graph(spark, d))
    return C.get_chunks(idx, {"$and": [{"namespace": NS}, {"kind": "dataset"}]}) \
        .select("id", "name", "document")


def q_stats_chunks(spark, d):
    g = graph(spark, d)
    return graph_stats(g, C.build_chunks(g, markdown=markdown_files(spark, d)))


QUERIES = {
    "r01_dataset_chunks": (q_dataset_chunks, O.sql("SELECT * FROM chunk_datasets",
                                                   "chunk_datasets")),
    "r02_job_chunks": (q_job_chunks, O.sql("SELECT * FROM chunk_jobs", "chunk_jobs")),
    "r02_job_chunks_code": (q_job_chunks_code, O.sql("""
SELECT id, kind, name, namespace, source, text || CASE WHEN CAST(u AS BIGINT) % 4 = 0
  THEN chr(10) || 'Glue source code:' || chr(10) || '# batch job for user ' || u || chr(10)
    || 'def run(spark):' || chr(10) || '    return spark.read.parquet(' || chr(39)
    || 'lake/ds_' || u || chr(39) || ')' || chr(10) ELSE '' END AS text
FROM (SELECT *, regexp_extract(name, '[0-9]+$') AS u FROM chunk_jobs)""", "chunk_jobs")),
    "r03_impact_chunks": (q_impact_chunks, O.sql("SELECT * FROM chunk_impact", "chunk_impact")),
    "x16_split_sections": (q_sections, O.sql("SELECT * FROM md_sections", "md_sections")),
    "r04_knowledge_chunks": (q_knowledge, O.sql("SELECT * FROM chunk_knowledge",
                                                "chunk_knowledge")),
    "r05_build_index": (q_index, O.sql("SELECT * FROM chunks_all", "chunks_all")),
    "s12_upsert": (q_upsert, O.sql("""
SELECT id, kind, name, namespace, source, text AS document FROM (
  SELECT * FROM chunk_datasets UNION ALL SELECT * FROM chunk_jobs) o
WHERE id NOT IN (SELECT key FROM lin_sources) AND id NOT IN (SELECT id FROM chunk_impact)
UNION ALL
SELECT id, kind, name, namespace, source, 'passage: ' || text FROM chunk_datasets
WHERE id IN (SELECT key FROM lin_sources)
UNION ALL
SELECT id, kind, name, namespace, source, 'passage: ' || text FROM chunk_impact""",
                                   "chunk_datasets", "chunk_jobs", "chunk_impact",
                                   "lin_sources")),
    "s13_get_chunks": (q_get_chunks, O.sql(f"""
SELECT id, name, 'passage: ' || text AS document FROM chunk_datasets
WHERE namespace = '{NS}' AND kind = 'dataset'""", "chunk_datasets")),
    "a09_graph_stats_chunks": (q_stats_chunks, O.sql("""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM lin_datasets) AS datasets,
       (SELECT CAST(count(*) AS BIGINT) FROM lin_jobs) AS jobs,
       (SELECT CAST(count(*) AS BIGINT) FROM lin_edges) AS edges,
       (SELECT CAST(count(*) AS BIGINT) FROM chunks_all) AS chunks""",
                                                     "lin_datasets", "lin_jobs", "lin_edges",
                                                     "chunks_all")),
}
