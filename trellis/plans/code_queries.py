"""Registered job/code matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import codematch as C
from ..session import by_shuffle, cut_lineage
from ..sources.code import job_code_files
from . import oracle as O
from ..operators.lineage_graph import build_jobs, clean_events
from ..sources.events import lineage_events


def _inputs(spark, d):
    """Jobs (the only graph table matching needs) and the code files."""
    jobs = build_jobs(clean_events(lineage_events(spark, d))).select("key", "name")
    return jobs, job_code_files(spark, d)


def q_exact(spark, d):
    jobs, code = _inputs(spark, d)
    return C.match_exact(jobs, C.code_index(code)).select("job_key", "file_name")


def q_suffix(spark, d):
    jobs, code = _inputs(spark, d)
    return C.match_suffix(jobs, C.code_index(code)).select("job_key", "file_name")


def q_fuzzy(spark, d):
    jobs, code = _inputs(spark, d)
    jobs = by_shuffle(cut_lineage(jobs, "match_jobs"))      # both are read several times
    idx = by_shuffle(cut_lineage(C.code_index(code), "code_idx"))
    return C.match_fuzzy(jobs, idx).select("job_key", "file_name", "score")


def q_cascade(spark, d):
    jobs, code = _inputs(spark, d)
    return C.match_code(jobs, code).select("job_key", "file_name", "match_kind", "score")


def q_job_code(spark, d):
    jobs, code = _inputs(spark, d)
    return C.job_code(jobs, code, C.match_code(jobs, code)).select("job_key", "job_name", "code")


def q_attach(spark, d):
    jobs, code = _inputs(spark, d)
    return C.attach_code(jobs, code).select("key", "name", "match_kind", "file_name",
                                            F.length("code").alias("code_len"))


def q_similarity(spark, d):
    """X12 on every job and the file of its user (same last name part): ratio
    of the normalised names."""
    jobs, code = _inputs(spark, d)
    idx = C.code_index(code)
    j = C._jobs(jobs)
    pairs = j.join(idx, F.substring_index(F.col("job_norm"), "_", -1)
                   == F.substring_index(F.col("norm"), "_", -1))
    return pairs.select("job_key", "file_name",
                        C.similarity(F.col("job_norm"), F.col("norm")).alias("score"))


_NORM = "regexp_replace(replace(lower({c}), '-', '_'), '^job_', '')"

_cte_sql = {
    "code_files": """
SELECT CASE user_id % 4 WHEN 0 THEN 'JOB-etl-user-' || user_id
            WHEN 1 THEN 'x_etl_user_' || user_id WHEN 2 THEN 'etl_usr_' || user_id
            ELSE 'nightly-report-' || user_id END
         AS file_name
FROM (SELECT DISTINCT user_id FROM events)""",
}


def _with_code(body: str) -> str:
    return O.sql(body, "lin_jobs", extra=(
        ("code_files", _cte_sql["code_files"]),
        ("code_idx", f"""
SELECT norm, max(file_name) AS file_name FROM
  (SELECT file_name, {_NORM.format(c='file_name')} AS norm FROM code_files)
WHERE norm <> '' GROUP BY norm"""),
        ("jn", f"SELECT key AS job_key, {_NORM.format(c='name')} AS job_norm FROM lin_jobs")))


QUERIES = {
    "j08_match_exact": (q_exact, _with_code("""
SELECT jn.job_key, c.file_name FROM jn JOIN code_idx c ON c.norm = jn.job_norm""")),
    "j09_match_suffix": (q_suffix, _with_code("""
SELECT job_key, arg_min(file_name, (norm, file_name)) AS file_name
FROM jn JOIN code_idx c ON jn.job_norm <> '' AND (ends_with(jn.job_norm, c.norm)
                                              OR ends_with(c.norm, jn.job_norm))
GROUP BY job_key""")),
    "j10_match_fuzzy": (q_fuzzy, None),
    "j11_match_code": (q_cascade, None),
    "j13_job_code": (q_job_code, None),
    "g14_attach_code": (q_attach, None),
    "x12_similarity": (q_similarity, None),
}
