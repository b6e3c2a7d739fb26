"""Lineage naming and facet helpers (X09-X15, F10) as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values the lineage rules must reproduce.
INTERNAL_FIELD_PREFIX = "_hoodie_"
TABLE_FORMATS = ("hudi", "delta", "iceberg")
DEFAULT_FORMAT = "parquet"
MISSING = "?"


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def norm_job_name(c) -> Column:
    """Lower case, ``-`` to ``_``, strip one leading ``job_``."""
    return F.regexp_replace(F.replace(F.lower(_c(c)), F.lit("-"), F.lit("_")), r"^job_", "")


def job_short_name(c) -> Column:
    """Job name is the text before the first ``.``."""
    return F.substring_index(_c(c), ".", 1)


def job_key(namespace, name) -> Column:
    return F.concat(F.lit("job::"), F.coalesce(_c(namespace), F.lit("")), F.lit("/"), _c(name))


def dataset_ns(raw) -> Column:
    """``a/b/t`` -> ``a_b`` when the path has three or more parts, else ``''``."""
    parts = F.split(F.coalesce(_c(raw), F.lit("")), "/", -1)
    n = F.size(parts)
    return F.when(n >= 3, F.array_join(F.slice(parts, 1, n - 1), "_")).otherwise(F.lit(""))


def dataset_name(raw) -> Column:
    """Last path part when three or more parts, else the raw name."""
    r = F.coalesce(_c(raw), F.lit(""))
    parts = F.split(r, "/", -1)
    return F.when(F.size(parts) >= 3, F.element_at(parts, -1)).otherwise(r)


def dataset_key(raw) -> Column:
    """``dataset::{ns}/{name}``; the event's dataset namespace is ignored."""
    return F.concat(F.lit("dataset::"), dataset_ns(raw), F.lit("/"), dataset_name(raw))


def visible_fields(fields) -> Column:
    """schema fields without internal ``_hoodie_*`` ones."""
    return F.filter(F.coalesce(_c(fields), F.array()),
                    lambda f: ~f["name"].startswith(INTERNAL_FIELD_PREFIX))


def render_schema(fields) -> Column:
    """``name (type)`` per visible field, ``?`` for a missing type."""
    return F.transform(visible_fields(fields),
                       lambda f: F.concat(f["name"], F.lit(" ("),
                                          F.coalesce(f["type"], F.lit(MISSING)), F.lit(")")))


def infer_format(name, fields) -> Column:
    """X11: table-format word in the parsed name, else internal fields -> hudi."""
    low = F.lower(_c(name))
    out = None
    for fmt in TABLE_FORMATS:
        cond = low.contains(fmt)
        out = F.when(cond, F.lit(fmt)) if out is None else out.when(cond, F.lit(fmt))
    has_internal = F.exists(F.coalesce(_c(fields), F.array()),
                            lambda f: f["name"].startswith(INTERNAL_FIELD_PREFIX))
    return out.when(has_internal, F.lit("hudi")).otherwise(F.lit(DEFAULT_FORMAT))


def first_transform(transformations, part: str) -> Column:
    """First transformation's ``type``/``subtype``; ``?`` if absent."""
    return F.coalesce(F.get(_c(transformations), 0)[part], F.lit(MISSING))
