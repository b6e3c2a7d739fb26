"""Toxicity: gradient-boosted trees over dense features, isotonic calibration.

Features of a text: densities of insults (a fixed list, and words and word
beginnings learnt from labelled rows), how close insults stand to a
second-person word, the rates of capitals, punctuation and obfuscated words.
Spark ML trains the trees and the calibration on a bounded labelled sample;
the texts are scored whole, where they are read, without a shuffle.

The sample's parts are used apart: the lexicon learns from one, the trees from
another, the calibration from a third, so no step is judged by what it learnt.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cuts, fresh, slices, texts_of
from .labelled import held_out, labelled_sample

#: Insults, and words that address the reader.
INSULTS = ("idiot", "moron", "stupid", "trash", "scum", "clown", "loser", "pathetic",
           "worthless", "disgusting", "dumb", "jerk", "filth", "vermin", "imbecile")
SECOND_PERSON = ("you", "your", "yours", "yourself", "du", "dich", "dir", "dein", "deine", "ihr",
                 "euch", "tu", "toi", "te", "ton", "ta", "vous", "votre", "tú", "ti", "tus",
                 "usted", "ustedes")
#: Characters that stand for letters in obfuscated words.
DISGUISES = str.maketrans("013457@$!", "oieastasi")

STEM = 5                    # characters of a learnt word beginning
NEAR = 3                    # words between an insult and a second-person word
_WORD = re.compile(r"[^\W_]+(?:[@$!*'_]+[^\W_]+)*", re.U)
_RUN = re.compile(r"([!?.*#$%&])\1+")
_STRETCH = re.compile(r"(.)\1{2,}")

FEATURES = ("insults", "learnt_words", "learnt_stems", "top_weight", "near_second_person",
            "second_person", "capitals", "capital_words", "exclamations", "punctuation",
            "mark_runs", "obfuscated", "stretched", "log_words", "distinct_hits")


def features(text: str, words: dict[str, float], stems: dict[str, float]) -> list[float]:
    """The dense features of one text; zeros for a text without words."""
    tokens = _WORD.findall(text)
    n = len(tokens)
    if not n:
        return [0.0] * len(FEATURES)
    hits, distinct, learnt, stemmed, top = [], set(), 0.0, 0.0, 0.0
    seconds, disguised, capital_words = [], 0, 0
    for i, token in enumerate(tokens):
        if len(token) > 1 and token.isupper():
            capital_words += 1
        word = token.lower()
        plain = word
        if not word.isalpha():
            plain = word.translate(DISGUISES).replace("*", "").replace("_", "").replace("'", "")
            if any(c.isalpha() for c in word):
                disguised += 1
        weight = words.get(plain, 0.0)
        stem_weight = stems.get(plain[:STEM], 0.0)
        learnt += weight
        stemmed += stem_weight
        if plain in _INSULTS or weight > 0 or stem_weight > 0:
            distinct.add(plain)
            top = max(top, weight, stem_weight)
        if plain in _INSULTS or weight > 0:
            hits.append(i)
        if plain in _SECOND:
            seconds.append(i)
    near, at = 0, 0
    for i in hits:
        while at < len(seconds) and seconds[at] < i - NEAR:
            at += 1
        near += at < len(seconds) and seconds[at] <= i + NEAR
    chars = len(text)
    letters = sum(map(str.isalpha, text)) or 1
    return [100 * sum(t.lower().translate(DISGUISES) in _INSULTS for t in
                      (tokens[i] for i in hits)) / n,
            100 * learnt / n, 100 * stemmed / n, top, 100 * near / n, 100 * len(seconds) / n,
            sum(map(str.isupper, text)) / letters, capital_words / n,
            100 * text.count("!") / chars,
            (chars - letters - sum(map(str.isspace, text))) / chars,
            100 * len(_RUN.findall(text)) / chars, 100 * disguised / n,
            100 * len(_STRETCH.findall(text)) / chars, math.log1p(n), float(len(distinct))]


_INSULTS, _SECOND = frozenset(INSULTS), frozenset(SECOND_PERSON)


def _featured(batches: Iterator[pa.RecordBatch], lexicon: tuple[dict, dict]):
    for batch in slices(batches, 256):
        rows = [features(t.decode("utf-8", "replace"), *lexicon) for t in texts_of(batch)]
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in rest], pa.array(rows, pa.list_(pa.float64()))],
            names=[*rest, "features"])


def with_features(rows: DataFrame, lexicon: tuple[dict, dict]) -> DataFrame:
    """Replace ``text`` by the array ``features``."""
    held = rows.sparkSession.sparkContext.broadcast(lexicon)     # at most 2 * top_words entries
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(lambda batches: _featured(batches, held.value),
                           f"{schema}, features array<double>")


def learn_lexicon(rows: DataFrame, top_words: int = 2000, least_docs: int = 5,
                  least_weight: float = 1.5) -> tuple[dict[str, float], dict[str, float]]:
    """Weights (log odds of a toxic document) of words and of word beginnings
    that stand in at least ``least_docs`` toxic rows; the ``top_words``
    strongest of each, which bounds what is collected."""
    sizes = dict(rows.groupBy("label").count().collect())
    toxic, clean = sizes.get(1, 0) + 1, sizes.get(0, 0) + 1
    word = F.expr(r"regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+', 0)")
    out = []
    for kind in (word, F.transform(word, lambda w: F.substring(w, 1, STEM))):
        counted = (rows.select("label", F.explode(F.array_distinct(kind)).alias("w"))
                   .where(F.length("w") >= (STEM if out else 3)).groupBy("w")
                   .agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
                   .where(F.col("t") >= least_docs)
                   .withColumn("weight", F.log((F.col("t") + 0.5) / toxic)
                               - F.log((F.col("c") + 0.5) / clean))
                   .where(F.col("weight") >= least_weight)
                   .orderBy(F.desc("weight"), "w").limit(top_words))
        out.append({r["w"]: float(r["weight"]) for r in counted.collect()})
    return out[0], out[1]


class ToxicityModel:
    """A fitted lexicon, trees and calibration; or a constant where the labels
    hold no row of one class."""

    def __init__(self, lexicon, trees, curve, constant: float | None = None):
        self.lexicon, self.trees, self.curve, self.constant = lexicon, trees, curve, constant

    def score(self, rows: DataFrame) -> DataFrame:
        """Replace ``text`` by ``score``, the probability of label 1."""
        kept = [c for c in rows.columns if c != "text"]
        if self.constant is not None:
            return rows.select(*kept, F.lit(self.constant).alias("score"))
        raw = _margin(self.trees, with_features(rows, self.lexicon))
        return self.curve.transform(raw).select(
            *kept, F.least(F.greatest("calibrated", F.lit(0.0)), F.lit(1.0)).alias("score"))


def _margin(trees, featured: DataFrame) -> DataFrame:
    vectors = featured.withColumn("vector", array_to_vector("features")).drop("features")
    return (trees.transform(vectors)
            .withColumn("margin", vector_to_array("rawPrediction")[1])
            .drop("vector", "rawPrediction", "probability", "prediction"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5,
                 rest: int = 0, per_class: int = 15000, max_chars: int = 65536,
                 rounds: int = 24, depth: int = 4, **columns) -> ToxicityModel:
    """Fit on at most ``per_class`` labelled rows of each class that are not held
    out.  With no row of a class every text gets the share of label 1 (0.5
    without labels)."""
    cuts = Cuts(docs.sparkSession, "toxicity")
    rows = cuts.cut(labelled_sample(docs, labels, label, folds, rest, per_class, max_chars,
                                    **columns), "sample")
    lexicon = learn_lexicon(rows.where("part < 5"))
    ready = cuts.cut(with_features(rows.where("part >= 5"), lexicon), "features", 8)
    found = {(r["tree"], r["label"]) for r in
             ready.select((F.col("part") < 9).alias("tree"), "label").distinct().collect()}
    if len(found) < 4:
        share = rows.agg(F.sum(F.col("label") * F.col("weight")) / F.sum("weight")).first()[0]
        cuts.drop(rows, ready)
        return ToxicityModel(lexicon, None, None, 0.5 if share is None else float(share))
    vectors = ready.withColumn("vector", array_to_vector("features")).drop("features")
    trees = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=rounds, maxDepth=depth,
                          stepSize=0.2, minInstancesPerNode=5, seed=7).fit(
        vectors.where("part < 9"))
    curve = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight",
                               predictionCol="calibrated").fit(
        _margin(trees, ready.where("part >= 9")).withColumn("label", F.col("label").cast("double")))
    cuts.drop(rows, ready)
    return ToxicityModel(lexicon, trees, curve)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text", folds: int = 5, rest: int = 0, **fit) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1, higher: toxic),
    predicted (1 if score >= 0.5).

    Null and empty texts have all features zero and are scored like that.
    Repeated rows give repeated results; an empty table gives no rows.  The
    score reads the text alone.
    """
    model = fit_toxicity(docs, labels, folds=folds, rest=rest, id_col=id_col, text_col=text_col,
                         **fit)
    rows = docs.select(F.col(id_col).alias("doc_id"),
                       held_out(F.col(id_col), folds, rest).alias("held_out"),
                       F.col(text_col).alias("text"))
    return model.score(rows).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
               text_col: str = "text", threshold: float = 0.5, **fit) -> DataFrame:
    """The rows scored below ``threshold``, with all their columns."""
    model = fit_toxicity(docs, labels, id_col=id_col, text_col=text_col, **fit)
    score, copy = fresh([*docs.columns, "text"], "score", "text_copy")
    # the row travels as one struct, so none of its names can clash
    rows = docs.select(F.struct(*docs.columns).alias(copy), F.col(text_col).alias("text"))
    kept = model.score(rows).where(F.col("score") < threshold)
    return kept.select(f"{copy}.*")
