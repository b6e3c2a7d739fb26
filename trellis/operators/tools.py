"""The fixed set of five named graph lookups, as one dispatch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codematch, graph_ops
from .lineage_graph import LineageGraph

TOOL_NAMES = ("get_job_code", "get_dataset_schema", "search_field", "get_impact",
              "find_jobs")


def run_tool(g: LineageGraph, tool: str, code: DataFrame | None = None, **params) -> DataFrame:
    """Run one named lookup with its parameters."""
    if tool == "get_job_code":
        wanted = params.get("job_name")
        jobs = g.jobs.filter(F.lower("name") == wanted.strip().lower()) if wanted else g.jobs
        return codematch.job_code(jobs, code, codematch.match_code(jobs, code))
    if tool == "get_dataset_schema":
        return graph_ops.dataset_schema(g, params["dataset_name"], params.get("namespace"))
    if tool == "search_field":
        return graph_ops.search_field(g, params["field_name"])
    if tool == "get_impact":
        return graph_ops.impact_by_name(g, params["dataset_name"], params.get("namespace"),
                                        how="contains")
    if tool == "find_jobs":
        ds = graph_ops.find_datasets(g, params["dataset_name"], params.get("namespace"))
        return graph_ops.find_jobs(g, ds)
    raise ValueError(f"unknown tool {tool!r}; expected one of {TOOL_NAMES}")
