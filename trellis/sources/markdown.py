"""Markdown knowledge files (S09) and the adapter from ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from .tables import table


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Every ``*.md`` of the folder ``path`` (not of its sub-folders) as ``(path = file name, content)``,
    one row per whole file."""
    df = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return df.select(F.col("_metadata.file_name").alias("path"), F.col("value").alias("content"))


def markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One markdown file per document: a title line, then every other line of
    the text promoted to a ``## `` heading over the line after it."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    content = F.concat(F.lit("# "), F.col("source"), F.lit(" "), F.col("lang"), F.lit("\n"),
                       F.regexp_replace("text", r"\n([^\n]*)\n", "\n## $1\n"))
    return d.select(F.concat(F.lit("doc_"), F.lpad(F.col("doc_id").cast("string"), 8, "0"),
                             F.lit(".md")).alias("path"), content.alias("content"))
