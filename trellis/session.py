"""Session helpers: building a session for tests/bench and finding the shared
checkpoint folder.

Lineage is cut with ``DataFrame.checkpoint()`` into ``spark.checkpoint.dir``.
On a cluster that setting names a shared folder and is always read from the
session; only a local-mode session (tests, bench) may get a scratch folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "trellis") -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, registering it with the context.

    Uses ``spark.checkpoint.dir`` when the cluster sets it.  A local-mode
    session without the setting (tests) gets a fresh scratch folder; any
    other session without it is an error, since a machine-local folder does
    not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set: name a shared folder "
                "(HDFS/object store) for lineage cuts")
        conf_dir = tempfile.mkdtemp(prefix="trellis-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cut the plan: write ``df`` once as parquet under the shared checkpoint
    folder and continue from the written table.

    One job per cut (an eager ``checkpoint()`` runs the plan twice unless
    cached), and the table lives on shared storage, so losing an executor
    never sends later stages back through the whole lineage.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the written table of a ``cut_lineage`` that no later plan reads."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(conf).delete(target, True)


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` with the request that its joins shuffle both sides (sort-merge).

    A join is planned from the compressed size of written files, before any
    explode: rows that are many times that estimate would be broadcast, and a
    broadcast is built on the driver.  The request passes through projections,
    filters, explodes and aggregates up to the next join.
    """
    return df.hint("merge")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a frame over the default parallelism when its scan yields
    fewer partitions (a small single-file table); a no-op for large inputs,
    whose file splits already give enough tasks."""
    n = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < n:
        return df.repartition(n)
    return df


def is_missing_path(error: Exception) -> bool:
    """True only for "the path does not exist": any other read error must not
    be taken for an empty store."""
    return isinstance(error, AnalysisException) and error.getCondition() == "PATH_NOT_FOUND"
