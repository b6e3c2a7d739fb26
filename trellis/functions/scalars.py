"""Scalar column builders.

Every helper returns a ``Column`` made of built-in expressions, so it stays
inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def upper_trim(c: ColumnOrName) -> Column:
    """``upper(trim(c))``; trim removes spaces only (tabs stay)."""
    return F.upper(F.trim(_c(c)))


def snake_upper(c: ColumnOrName) -> Column:
    """Trim, whitespace runs to ``_``, upper case."""
    return F.upper(F.regexp_replace(F.trim(_c(c)), r"\s+", "_"))


def year_str(c: ColumnOrName) -> Column:
    """Calendar year as a string."""
    return F.year(_c(c)).cast("string")


def month2(c: ColumnOrName) -> Column:
    """Two-digit month string, ``01`` .. ``12``."""
    return F.lpad(F.month(_c(c)).cast("string"), 2, "0")


def days_between(c: ColumnOrName, as_of: _dt.date | str) -> Column:
    """Whole days from ``c`` to the reference date ``as_of``."""
    return F.datediff(F.lit(as_of).cast("date"), _c(c))


def horizon(as_of: _dt.date | str, days: int) -> Column:
    """``as_of + days`` as a date."""
    return F.date_add(F.lit(as_of).cast("date"), days)


def stamp(value: _dt.datetime | None) -> Column:
    """load/score timestamp; the clock only when no value is given."""
    if value is None:
        return F.localtimestamp()
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def prefixed_id(prefix: str, c: ColumnOrName) -> Column:
    """Null-propagating ``concat``."""
    return F.concat(F.lit(prefix), _c(c).cast("string"))


def recommended_stock(demand: ColumnOrName, margin: float) -> Column:
    """``int(demand * margin)``, truncating; overflow gives null."""
    return (_c(demand) * F.lit(margin)).try_cast("int")


def tier(cases: Sequence[tuple[Column, str]], default: str) -> Column:
    """first matching condition wins; null conditions fall through."""
    out = None
    for cond, label in cases:
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(default) if out is not None else F.lit(default)


def clean_ws(c: ColumnOrName) -> Column:
    """Collapse whitespace runs to one space and trim."""
    return F.trim(F.regexp_replace(_c(c), r"\s+", " "))


def is_field_name(c: ColumnOrName) -> Column:
    """snake_case identifier test."""
    return _c(c).rlike(r"^[a-z][a-z0-9_]{1,}$")


def tokens(c: ColumnOrName) -> Column:
    """Lower-cased tokens split on whitespace, ``_``, ``-`` and ``/``."""
    return F.split(F.lower(_c(c)), r"[\s_\-/]+")


def left(c: ColumnOrName, n: int) -> Column:
    """First ``n`` characters."""
    return F.substring(_c(c), 1, n)


def as_passage(c: ColumnOrName) -> Column:
    """Document text as stored in the index."""
    return F.concat(F.lit("passage: "), _c(c))


def as_query(c: ColumnOrName) -> Column:
    """Query text as sent to the encoder."""
    return F.concat(F.lit("query: "), _c(c))


def keep_lines(doc: ColumnOrName, prefixes: Sequence[str]) -> Column:
    """Keep the lines of ``doc`` that start with one of ``prefixes``."""
    pats = [p for p in prefixes]
    return F.array_join(
        F.filter(F.split(_c(doc), "\n"),
                 lambda line: _any_startswith(line, pats)),
        "\n")


def _any_startswith(line: Column, prefixes: Sequence[str]) -> Column:
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | line.startswith(p)
    return cond


def contains_any(text: ColumnOrName, keywords: Sequence[str]) -> Column:
    """True when the lower-cased text contains any keyword."""
    low = F.lower(_c(text))
    cond = F.lit(False)
    for kw in keywords:
        cond = cond | low.contains(kw)
    return cond
