"""Parquet tables kept by key: rows lie in hash buckets (one Hive partition
each), and an update rewrites only the buckets of the keys it brings.

Buckets are replaced by Spark's dynamic partition overwrite: the new files are
staged while the old ones are read and take their place when the job commits.
Merges must be idempotent (a replayed batch merges to the same rows), so no log
of versions is kept.  On storage without atomic renames a table format should
take this place; the merged rows stay in the checkpoint folder until the commit
is through.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_cut, is_missing_path, scratch_path

BUCKET = "_bucket"


class KeyedTable:
    """A table under ``path`` in ``buckets`` buckets of ``key``.

    The number of buckets is fixed when the table is first written; choose it
    so that a bucket is some hundred MB at the expected size.  Keys should
    identify rows, so that no bucket holds one hot key.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], buckets: int = 16):
        self.spark, self.key, self.buckets = spark, list(key), buckets
        self.path = os.path.join(path, f"buckets-{buckets}")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException as e:
            if is_missing_path(e):          # nothing written yet
                return None
            raise

    def read(self) -> DataFrame | None:
        """The rows, or None before the first merge."""
        stored = self._stored()
        return None if stored is None else stored.drop(BUCKET)

    def merge(self, new: DataFrame, combine: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Merge ``new`` into the table and return the buckets rewritten.

        ``combine`` reduces stored and new rows of the same keys, told apart by
        the column ``_new``, to the rows that stay; only rows that share a key
        may influence each other.
        """
        fresh = cut_lineage(new.withColumn(BUCKET, self._bucket()), "keyed_new")
        touched = sorted(r[0] for r in fresh.select(BUCKET).distinct().collect())
        if touched:                         # at most one number per bucket
            rows = fresh.drop(BUCKET).withColumn("_new", F.lit(True))
            stored = self._stored()
            if stored is not None:
                old = stored.where(F.col(BUCKET).isin(touched)).drop(BUCKET)
                rows = old.withColumn("_new", F.lit(False)).unionByName(rows)
            merged = cut_lineage(combine(rows).drop("_new").withColumn(BUCKET, self._bucket()),
                                 "keyed_merged")
            (merged.hint("rebalance", BUCKET).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path))
            drop_cut(merged)
        drop_cut(fresh)
        return touched

    def replace(self, new: DataFrame) -> list[int]:
        """Rows of ``new`` (one per key) replace the rows of their keys; buckets
        in which every new row equals what is stored are not touched.

        New and stored rows meet once, by bucket, and are written once beside
        the store; what is to be committed lies there by bucket already."""
        columns = new.columns
        rows = new.withColumn("_new", F.lit(True)).withColumn(BUCKET, self._bucket())
        stored = self._stored()
        if stored is not None:
            rows = rows.unionByName(stored.select(*columns, BUCKET).withColumn("_new", F.lit(False)))
        row, is_new = F.struct(*columns), F.col("_new")
        same = F.min_by(row, is_new).eqNullSafe(F.max_by(row, is_new))
        found = (rows.repartition(BUCKET)
                 .groupBy(BUCKET, *[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.key)])
                 .agg(F.max_by(row, is_new).alias("_row"),
                      (F.max(is_new) & (F.min(is_new) | ~same)).alias("_changed")))
        path = scratch_path(self.spark, "keyed_merged")
        found.select("_row.*", "_changed", BUCKET).write.partitionBy(BUCKET).parquet(path)
        if not self._written(path):
            return []
        merged = self.spark.read.parquet(path)
        touched = sorted(r[0] for r in merged.where("_changed").select(BUCKET).distinct().collect())
        if touched:                         # at most one number per bucket
            (merged.where(F.col(BUCKET).isin(touched)).drop("_changed").write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path))
        drop_cut(merged)
        return touched

    def _written(self, path: str) -> bool:
        """False if no row was written under ``path``, which has no schema then."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return any(f.isDirectory() for f in files.listStatus(target))
