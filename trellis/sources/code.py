"""Job source files (S07/S08) and the adapter from the ``events`` table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import JOB_CODE
from ..session import is_missing_path
from .tables import table


def read_job_code(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Every ``*.py`` as ``(file_name without .py, code)``, one row per whole
    file: below the prefix ``path`` (S08), or with ``recursive=False`` in the
    folder ``path`` itself (S07)."""
    reader = spark.read.option("pathGlobFilter", "*.py")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    try:
        df = reader.text(path, wholetext=True)
    except AnalysisException as e:
        if is_missing_path(e):
            return spark.createDataFrame([], JOB_CODE)
        raise
    return df.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.py$", 1)
                     .alias("file_name"), F.col("value").alias("code"))


def job_code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file per user of ``events`` by ``u % 4``: an exact-name
    file, a suffix-name file, a misspelt (fuzzy) file, or a file of another
    name that no tier matches."""
    u = F.col("user_id")
    m = u % 4
    su = u.cast("string")
    name = (F.when(m == 0, F.concat(F.lit("JOB-etl-user-"), su))
            .when(m == 1, F.concat(F.lit("x_etl_user_"), su))
            .when(m == 2, F.concat(F.lit("etl_usr_"), su))
            .otherwise(F.concat(F.lit("nightly-report-"), su)))
    code = F.concat(F.lit("# batch job for user "), su,
                    F.lit("\ndef run(spark):\n    return spark.read.parquet('lake/ds_"), su,
                    F.lit("')\n"))
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(name.alias("file_name"), code.alias("code"))
