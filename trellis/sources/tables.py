"""Parquet scans and sinks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan; a column list narrows the ReadSchema."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, ``{sf_dir}/{name}.parquet``."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def write_table(df: DataFrame, path: str, by: list[str] | None = None,
                dynamic: bool = False, mode: str = "overwrite") -> None:
    """Parquet sink; ``by`` partitions Hive-style.

    Rows of one partition are brought together first: a task opens a file for
    every partition it holds rows of, so files would grow with tasks times
    partitions.  A large partition is dealt to several tasks.

    Overwrite is static by default (every partition is replaced, as the
    reference jobs do); ``dynamic=True`` replaces only the partitions written.
    """
    writer = (df.hint("rebalance", *by) if by else df).write.mode(mode)
    if dynamic:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(path)
