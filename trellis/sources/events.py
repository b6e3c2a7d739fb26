"""Lineage event sources (S05, S06, X13) and the adapter from the ``events`` table."""

from __future__ import annotations

import datetime as _dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EVENT, EVENT_ROW
from ..session import spread
from .tables import table

EVENT_FILE_GLOB = "*.{ndjson,json}"


def _with_arrival(df: DataFrame) -> DataFrame:
    """Arrival position: file path and an id increasing along each file."""
    return (df.withColumn("source_file", F.col("_metadata.file_path"))
              .withColumn("seq", F.monotonically_increasing_id()))


def read_events(spark: SparkSession, path: str, strict: bool = False,
                modified_since: _dt.datetime | None = None,
                recursive: bool = False) -> DataFrame:
    """NDJSON events with the declared schema.

    Blank lines are skipped; a malformed line lands in ``_corrupt`` (or fails
    the read when ``strict``).  A missing path gives an empty frame.
    ``modified_since`` keeps files modified at or after the instant (the
    reader's own ``modifiedAfter`` is strictly after).  ``recursive`` walks a
    prefix and keeps ``*.ndjson``/``*.json`` files.
    """
    reader = (spark.read.schema(EVENT)
              .option("mode", "FAILFAST" if strict else "PERMISSIVE")
              .option("columnNameOfCorruptRecord", "_corrupt"))
    if recursive:
        reader = reader.option("recursiveFileLookup", "true").option(
            "pathGlobFilter", EVENT_FILE_GLOB)
    try:
        df = reader.json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return spark.createDataFrame([], EVENT_ROW)
        raise
    if modified_since is not None:
        since = (F.lit(modified_since.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
                 if modified_since.tzinfo is None
                 else F.timestamp_seconds(F.lit(modified_since.timestamp())))
        df = df.filter(F.col("_metadata.file_modification_time") >= since)
    return _with_arrival(df)


def day_cutoff(now: _dt.datetime, hour: int = 5, utc_offset: int = 2) -> _dt.datetime:
    """The instant of ``hour`` o'clock of the day of ``now`` at a fixed offset
    from UTC.  Before that hour it lies ahead, so a scan from it loads nothing."""
    zone = _dt.timezone(_dt.timedelta(hours=utc_offset))
    return now.astimezone(zone).replace(hour=hour, minute=0, second=0, microsecond=0)


def parse_events(lines: DataFrame, col: str = "value") -> DataFrame:
    """Parse JSON text rows into the event struct's columns."""
    parsed = F.from_json(F.col(col), EVENT, {"columnNameOfCorruptRecord": "_corrupt"})
    return lines.select(parsed.alias("e"), *[c for c in lines.columns if c != col]) \
        .select("e.*", *[c for c in lines.columns if c != col])


def quarantine(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split events into (good, bad): unparsable lines and missing job names."""
    bad_cond = F.col("_corrupt").isNotNull() | F.col("job.name").isNull()
    return events.filter(~bad_cond), events.filter(bad_cond)


# ------------------------------------------------- adapter from ``events``

# Fixed values of the adapter (FIXTURES.md §2).
JOB_NAMESPACE = "shop"
EVENT_TYPE_MAP = (("purchase", "COMPLETE"), ("error", "FAIL"), ("click", "RUNNING"),
                  ("view", "START"), ("signup", "START"))


def _raw_dataset_name(ds_id: Column) -> Column:
    sid = ds_id.cast("string")
    m = ds_id % 4
    return (F.when(m == 0, F.concat(F.lit("s3/lake/raw/ds_"), sid))
            .when(m == 1, F.concat(F.lit("lake/hudi/ds_hudi_"), sid))
            .when(m == 2, F.concat(F.lit("lake/ds_"), sid))
            .otherwise(F.concat(F.lit("/lake/staging/ds_"), sid)))


def _schema_facet(ds_id: Column, k: Column) -> Column:
    base = [F.struct(F.lit("id").alias("name"), F.lit("bigint").alias("type")),
            F.struct(F.concat(F.lit("value_"), (k % 3).cast("string")).alias("name"),
                     F.lit("double").alias("type"))]
    hoodie = F.array(F.struct(F.lit("_hoodie_commit_time").alias("name"),
                              F.lit("string").alias("type")))
    fields = F.when(ds_id % 4 == 1, F.concat(F.array(*base), hoodie)).otherwise(F.array(*base))
    return F.struct(fields.alias("fields"))


def _input_field(src_name: Column, field: Column, subtype: Column) -> Column:
    return F.struct(
        F.lit(JOB_NAMESPACE).alias("namespace"), src_name.alias("name"), field.alias("field"),
        F.array(F.struct(F.lit("DIRECT").alias("type"), subtype.alias("subtype")))
        .alias("transformations"))


def lineage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage events derived row by row from the ``events`` table.

    user ``u`` runs job ``job_etl_user_{u}``; views and clicks read dataset
    ``3u + k % 5``; purchases write dataset ``3u + 4 + k % 5`` with column
    lineage from the read dataset; signups and errors touch no dataset.
    """
    ev = spread(table(spark, sf_dir, "events").select("event_id", "ts", "user_id",
                                                      "event_type", "props"))
    # scalar parts first, as plain columns, so the JSON is parsed once per row
    # and the struct building below only references columns
    u0 = F.col("user_id")
    k0 = F.get_json_object("props", "$.k").cast("bigint")
    base = ev.select("event_id", "ts", "user_id", "event_type", k0.alias("k")).select(
        "event_id", "ts", "user_id", "event_type", "k",
        (3 * u0 + F.col("k") % 5).alias("in_id"),
        (3 * u0 + 4 + F.col("k") % 5).alias("out_id"))
    base = base.select("*", _raw_dataset_name(F.col("in_id")).alias("in_name"),
                       _raw_dataset_name(F.col("out_id")).alias("out_name"))
    u = F.col("user_id")
    k = F.col("k")
    etype = None
    for src, dst in EVENT_TYPE_MAP:
        etype = (F.when(F.col("event_type") == src, dst) if etype is None
                 else etype.when(F.col("event_type") == src, dst))
    in_id = F.col("in_id")
    out_id = F.col("out_id")
    src_name = F.col("in_name")
    lineage = F.create_map(
        F.concat(F.lit("value_"), (k % 3).cast("string")),
        F.struct(F.array(_input_field(
            src_name, F.concat(F.lit("value_"), ((k + 1) % 3).cast("string")),
            F.when(k % 2 == 0, "IDENTITY").otherwise("AGGREGATION"))).alias("inputFields")),
        F.lit("id"),
        F.struct(F.array(_input_field(src_name, F.lit("id"), F.lit("IDENTITY")))
                 .alias("inputFields")),
    )
    empty = F.array().cast(EVENT["inputs"].dataType)
    in_ds = F.array(F.struct(
        F.lit(JOB_NAMESPACE).alias("namespace"), src_name.alias("name"),
        F.struct(_schema_facet(in_id, k).alias("schema"),
                 F.lit(None).cast(EVENT["inputs"].dataType.elementType["facets"].dataType
                                  ["columnLineage"].dataType).alias("columnLineage"))
        .alias("facets")))
    out_ds = F.array(F.struct(
        F.lit(JOB_NAMESPACE).alias("namespace"), F.col("out_name").alias("name"),
        F.struct(_schema_facet(out_id, k).alias("schema"),
                 F.struct(lineage.alias("fields")).alias("columnLineage")).alias("facets")))
    reads = F.col("event_type").isin("view", "click")
    writes = F.col("event_type") == "purchase"
    return base.select(
        etype.alias("eventType"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("eventTime"),
        F.struct(F.lit(JOB_NAMESPACE).alias("namespace"),
                 F.concat(F.lit("job_etl_user_"), u.cast("string"), F.lit(".execute_"),
                          F.col("event_id").cast("string")).alias("name")).alias("job"),
        F.when(reads, in_ds).otherwise(empty).cast(EVENT["inputs"].dataType).alias("inputs"),
        F.when(writes, out_ds).otherwise(empty).cast(EVENT["outputs"].dataType)
        .alias("outputs"),
        F.lit(None).cast("string").alias("_corrupt"),
        F.lit("events").alias("source_file"),
        F.col("event_id").alias("seq"),
    )
