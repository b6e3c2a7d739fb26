"""Helpers shared by the corpus operators: written lineage cuts that can be
dropped, fresh column names, and moving texts through Arrow as raw bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: A word of the corpus contracts: a run of anything but space and \t..\r.
WORD = r"[^\x20\x09-\x0D]+"


class Cuts:
    """Tables written under the shared checkpoint folder by one operator run.

    ``cut`` writes a frame once and continues from the written table, so a lost
    executor costs one re-read and later stages never replay the lineage.
    ``drop`` deletes a table that no later plan reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def cut(self, df: DataFrame, step: str, partitions: int | None = None) -> DataFrame:
        path = scratch_path(self.spark, f"{self.name}-{step}")
        (df.coalesce(partitions) if partitions else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (out, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            _, path = self._paths.pop(id(df), (None, None))
            if path:
                target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                conf = self.spark.sparkContext._jsc.hadoopConfiguration()
                target.getFileSystem(conf).delete(target, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names built from ``names`` that clash with none of ``taken``."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8 bytes; null becomes empty."""
    return [b or b"" for b in batch.column(column).cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches cut to at most ``rows`` rows, to bound what one step decodes."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
