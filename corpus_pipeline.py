"""Corpus pipeline: the stages a text corpus passes before training.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns the documents that stay, with the columns of documents, except the
last, which returns token ids.  ``run`` applies them to the documents table,
writing every stage's result as Parquet in the shared checkpoint folder and
reading it again as the next stage's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trellis.llm.bpe import encode_documents
from trellis.llm.common import Cuts
from trellis.llm.exact_dedup import drop_exact_copies
from trellis.llm.mixing import mixed_texts
from trellis.llm.queries import RANK_FILE
from trellis.llm.simhash_dedup import drop_near_copies
from trellis.llm.toxicity import drop_toxic
from trellis.sources.tables import table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 stay."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return drop_exact_copies(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked within three bits the smallest doc_id stays."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's text becomes the words that the mix takes of it."""
    return mixed_texts(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digest of what they decode to."""
    return encode_documents(docs, public_tokenizers.path(RANK_FILE))


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("simhash dedup", simhash_dedup),
    ("mixing", mixing),
    ("bpe", bpe),
]

#: The fingerprints, the classifier and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = Cuts(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done = cuts.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        cuts.drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
