"""Bounded, reproducible samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the doc_id's decimal text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def held_out(doc_id: Column, folds: int, rest: int) -> Column:
    """True for the rows whose labels must not be learnt; a null id is not held out."""
    return F.coalesce(fold(doc_id, folds) == rest, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, rest: int,
                    per_class: int, max_chars: int, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(text, label, weight, part) of at most ``per_class`` labelled rows of each
    class, chosen by the hash of their ids among the rows that are not held
    out; texts longer than ``max_chars`` are not used for fitting.

    ``weight`` restores the class shares of all labelled rows, ``part`` (0..11)
    splits the sample.  The chosen ids, 2 * per_class rows at most, are
    broadcast, so the texts are filtered where they are read.
    """
    known = (labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
             .where(~held_out(F.col(id_col), folds, rest))
             .select(F.col(id_col).alias("labelled_id"), F.col(label).cast("int").alias("label"),
                     F.xxhash64(id_col).alias("draw")))
    counts = dict(known.groupBy("label").count().collect())
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy("draw", "labelled_id").limit(per_class)
        part = part.withColumn("weight", F.lit(
            counts.get(value, 0) / max(1, min(per_class, counts.get(value, 0)))))
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).alias("labelled_id"), F.col(text_col).alias("text"))
    return (texts.where(F.length("text").between(1, max_chars))
            .join(F.broadcast(chosen), "labelled_id")
            .select("text", "label", "weight",
                    F.pmod(F.shiftright("draw", 7), F.lit(12)).cast("int").alias("part")))
