"""Declared schemas: lineage events (OpenLineage-shaped JSON) and graph tables."""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, LongType, MapType, StringType, StructField,
                               StructType)

TRANSFORMATION = StructType([
    StructField("type", StringType()),
    StructField("subtype", StringType()),
])

INPUT_FIELD = StructType([
    StructField("namespace", StringType()),
    StructField("name", StringType()),
    StructField("field", StringType()),
    StructField("transformations", ArrayType(TRANSFORMATION)),
])

SCHEMA_FIELD = StructType([
    StructField("name", StringType()),
    StructField("type", StringType()),
])

FACETS = StructType([
    StructField("schema", StructType([
        StructField("fields", ArrayType(SCHEMA_FIELD)),
    ])),
    StructField("columnLineage", StructType([
        StructField("fields", MapType(StringType(), StructType([
            StructField("inputFields", ArrayType(INPUT_FIELD)),
        ]))),
    ])),
])

DATASET = StructType([
    StructField("namespace", StringType()),
    StructField("name", StringType()),
    StructField("facets", FACETS),
])

JOB = StructType([
    StructField("namespace", StringType()),
    StructField("name", StringType()),
])

#: One NDJSON line.  ``_corrupt`` receives lines that do not parse.
EVENT = StructType([
    StructField("eventType", StringType()),
    StructField("eventTime", StringType()),
    StructField("job", JOB),
    StructField("inputs", ArrayType(DATASET)),
    StructField("outputs", ArrayType(DATASET)),
    StructField("_corrupt", StringType()),
])

#: Events as the graph builder consumes them: the event plus its arrival
#: position (``source_file``, ``seq``) used to order "last wins" choices.
EVENT_ROW = StructType(EVENT.fields + [
    StructField("source_file", StringType()),
    StructField("seq", LongType()),
])

#: Job source files.
JOB_CODE = StructType([
    StructField("file_name", StringType()),
    StructField("code", StringType()),
])
