"""Job <-> source-code matching.

The cascade -- exact normalised name, then suffix, then best fuzzy score at
or above a threshold -- runs tier by tier on the ``left_anti`` remainder.
No tier pairs every job with every file:

* suffix: every suffix of a name is exploded (names are short identifiers),
  so "a ends with b" becomes an equi-join on ``b``;
* fuzzy: the best file of a job is looked for among the nearest names first.
  Names at most two insertions or deletions apart share a string that both
  become by deletions, so an equi-join on those strings finds all such pairs
  and no others.  No file further away can beat ``2 la / (2 la + 3)`` (proof at
  ``unseen_bound``), so a job whose best score is above that is settled; only
  the others take candidates from an exact q-gram filter (below).  A vectorised
  pandas UDF computes the Ratcliff/Obershelp ratio of candidates only.

Why the q-gram filter is exact.  ``ratio = 2M/T`` with ``M`` matched
characters and ``T = la + lb``.  ``M <= min(la, lb)`` gives the length bound
``2 min/T >= t``.  Matching blocks are separated by at least one unmatched
character, so there are at most ``T - 2M + 1`` blocks and the strings share at
least ``M - blocks >= 3M - T - 1`` bigram occurrences; with ``2M >= tT`` that
is ``o = ceil((1.5 t - 1) T - 1)`` (0.125 T - 1 at t = 0.75).  Prefix
filtering over bigram occurrences ordered rarest first then needs each
string to index only its first ``n - o + 1`` bigrams.  Pairs whose bound
gives ``o <= 0`` (very short names) are matched on a shared character
instead, which ``M > 0`` requires.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..functions.lineage import norm_job_name
from ..session import by_shuffle, cut_lineage

# Fixed value: minimum similarity for a fuzzy match.
SIMILARITY_THRESHOLD = 0.75


@pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """``difflib.SequenceMatcher(None, a, b).ratio()`` per pair."""
    from difflib import SequenceMatcher
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None
                      else None for x, y in zip(a, b)], dtype="float64")


def similarity_at_least(threshold: float):
    """Like ``similarity`` but pairs whose cheap upper bounds
    (``real_quick_ratio``, ``quick_ratio``) are below ``threshold`` get null
    without computing the full ratio; every score at or above the threshold is
    exact.  Rows sorted by ``b`` reuse one matcher per ``b`` (its index of
    ``b`` is built once)."""
    @pandas_udf(DoubleType())
    def sim(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher
        out = []
        sm, cur = SequenceMatcher(None), None
        for x, y in zip(a, b):
            if x is None or y is None:
                out.append(None)
                continue
            if y != cur:
                sm.set_seq2(y)
                cur = y
            sm.set_seq1(x)
            if sm.real_quick_ratio() < threshold or sm.quick_ratio() < threshold:
                out.append(None)
            else:
                out.append(sm.ratio())
        return pd.Series(out, dtype="float64")
    # a deterministic one would be computed again for the filter on its result
    return sim.asNondeterministic()


def code_index(code: DataFrame) -> DataFrame:
    """Files keyed by normalised name; one file per name (greatest file name
    wins, as a later dict entry would), empty names dropped."""
    c = code.select("file_name", "code", norm_job_name("file_name").alias("norm"))
    c = c.filter(F.col("norm") != "")
    w = Window.partitionBy("norm").orderBy(F.col("file_name").desc())
    return c.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def _jobs(jobs: DataFrame) -> DataFrame:
    return jobs.select(F.col("key").alias("job_key"), F.col("name").alias("job_name"),
                       norm_job_name("name").alias("job_norm"))


def match_exact(jobs: DataFrame, idx: DataFrame) -> DataFrame:
    """Equal normalised names."""
    return (_jobs(jobs).join(by_shuffle(idx), F.col("job_norm") == F.col("norm"))
            .select("job_key", "job_name", "file_name", "code",
                    F.lit("exact").alias("match_kind"), F.lit(1.0).alias("score")))


def _suffixes(c: Column) -> Column:
    """All non-empty suffixes of a string."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))),
                       lambda i: F.substring(c, i, 1 << 30))


def match_suffix(jobs: DataFrame, idx: DataFrame) -> DataFrame:
    """One normalised name ends with the other; the first file by
    normalised name wins."""
    j = _jobs(jobs).filter(F.col("job_norm") != "")
    # file name is a suffix of the job name
    a = (j.select("job_key", "job_name", "job_norm",
                  F.explode(_suffixes(F.col("job_norm"))).alias("sfx"))
         .join(by_shuffle(idx), F.col("sfx") == F.col("norm")))
    # job name is a suffix of the file name
    fsuf = idx.select("file_name", "code", "norm",
                      F.explode(_suffixes(F.col("norm"))).alias("sfx"))
    b = j.join(by_shuffle(fsuf), F.col("job_norm") == F.col("sfx"))
    cols = ["job_key", "job_name", "file_name", "code", "norm"]
    both = a.select(*cols).unionByName(b.select(*cols))
    w = Window.partitionBy("job_key").orderBy("norm", "file_name")
    return (both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
            .select("job_key", "job_name", "file_name", "code",
                    F.lit("suffix").alias("match_kind"), F.lit(1.0).alias("score")))


def _bigram_occurrences(df: DataFrame, key: str, s: str) -> DataFrame:
    """(key, gram, occ) for every bigram occurrence of ``s`` (occ = how many
    times the same bigram appeared before in the string, so multisets become
    sets)."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))),
                        lambda i: F.substring(F.col(s), i, 2))
    g = df.select(key, s, F.posexplode(grams).alias("p", "gram")).filter(F.length("gram") == 2)
    w = Window.partitionBy(key, "gram").orderBy("p")
    return by_shuffle(g.withColumn("occ", F.row_number().over(w) - 1).drop("p"))


def fuzzy_candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Exact candidate pairs ``(lkey, rkey)`` for ``ratio >= threshold``.

    ``left(lkey, ls)`` and ``right(rkey, rs)``; see the module docstring for
    why no qualifying pair is lost.
    """
    t = threshold
    slope = 1.5 * t - 1.0            # shared bigrams >= slope*T - 1
    lmin = t / (2.0 - t)             # length bound: min/max >= t/(2-t)

    locc = _bigram_occurrences(left, "lkey", "ls")
    rocc = _bigram_occurrences(right, "rkey", "rs")
    allocc = (locc.select("gram", "occ").unionByName(rocc.select("gram", "occ"))
              .groupBy("gram", "occ").agg(F.count(F.lit(1)).alias("freq")))

    def prefix(occ, key, s):
        n = F.length(s) - 1
        tmin = F.length(s) + F.ceil(F.length(s) * F.lit(lmin))
        o = F.greatest(F.ceil(F.lit(slope) * tmin - 1), F.lit(1))
        ranked = occ.join(allocc, ["gram", "occ"])
        w = Window.partitionBy(key).orderBy("freq", "gram", "occ")
        return (ranked.withColumn("_r", F.row_number().over(w))
                .filter(F.col("_r") <= n - o + 1).select(key, "gram", "occ"))

    lp = prefix(locc, "lkey", "ls")
    rp = prefix(rocc, "rkey", "rs")
    by_gram = by_shuffle(lp).join(rp, ["gram", "occ"]).select("lkey", "rkey").distinct()

    # very short pairs (T <= 8 at t = 0.75): no bigram guarantee; a shared
    # character is required instead
    short_t = math.floor(1.0 / slope) if slope > 0 else 1 << 30
    ls = left.filter(F.length("ls") < short_t)
    rs = right.filter(F.length("rs") < short_t)

    def chars(df, key, s):
        return by_shuffle(df.select(key, F.explode(F.split(F.col(s), "")).alias("ch")).distinct())
    by_char = (chars(ls, "lkey", "ls").join(chars(rs, "rkey", "rs"), "ch")
               .select("lkey", "rkey").distinct())
    left, right = by_shuffle(left), by_shuffle(right)
    short_pairs = (by_char.join(by_shuffle(ls), "lkey").join(by_shuffle(rs), "rkey")
                   .filter(F.length("ls") + F.length("rs") <= short_t)
                   .select("lkey", "rkey"))
    cands = by_gram.unionByName(short_pairs).distinct()
    return (cands.join(left, "lkey").join(right, "rkey")
            .filter(2.0 * F.least(F.length("ls"), F.length("rs"))
                    >= F.lit(t) * (F.length("ls") + F.length("rs"))))


def upper_bound(a: Column, b: Column) -> Column:
    """An upper bound of the similarity ratio, without Python.

    The matched characters form a common subsequence, so with T characters in
    both strings and M matched, at least T - 2M insertions and deletions turn
    one into the other; an edit distance counts a replacement once instead of
    twice, so it is at most T - 2M, and 2M/T <= (T - distance)/T.  One division
    of whole numbers, as the ratio itself is: rounding keeps their order, which
    ``1 - distance/T`` does not.
    """
    total = F.length(a) + F.length(b)
    return (total - F.levenshtein(a, b)) / total


#: Longest name that is looked up by deletions (its square is the number of
#: variants); a longer one goes to the q-gram filter, which finds the same.
DELETION_MAX_LEN = 64


def _deletions(df: DataFrame, key: str, s: str) -> DataFrame:
    """(key, variant, gone): every string that ``s`` becomes by deleting
    ``gone`` characters, two at most."""
    c, n = F.col(s), F.length(s)

    def without(i, j):
        return F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, j - i - 1),
                        F.substring(c, j + 1, n))
    places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    one = F.transform(places, lambda i: without(i, n + 1))
    two = F.when(n < 2, F.array().cast("array<string>")).otherwise(F.flatten(F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.transform(F.sequence(i + 1, F.greatest(n, i + 1)), lambda j: without(i, j)))))
    by_gone = F.array(F.array(c), F.array_distinct(one), F.array_distinct(two))
    return by_shuffle(df.where(n.between(1, DELETION_MAX_LEN))
                      .select(key, F.posexplode(by_gone).alias("gone", "variants"))
                      .select(key, F.explode("variants").alias("variant"), "gone"))


#: Names whose variants a task joins at most, as a mean.
NAMES_PER_TASK = 5_000


def _tasks(rows: int, per_task: int, spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-rows // per_task))


def near_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs ``(lkey, ls, rkey, rs)`` that at most two insertions and deletions
    turn into each other (names up to ``DELETION_MAX_LEN``).  The tasks of the
    join grow with the names."""
    n = _tasks(left.count() + right.count(), NAMES_PER_TASK, left.sparkSession)
    a = _deletions(left, "lkey", "ls").withColumnRenamed("gone", "lgone").repartition(n, "variant")
    pairs = (a.join(_deletions(right, "rkey", "rs").repartition(n, "variant"), "variant")
             .where("lgone + gone <= 2").select("lkey", "rkey").distinct())
    return pairs.join(by_shuffle(left), "lkey").join(by_shuffle(right), "rkey")


def unseen_bound(length: Column, distance: int) -> Column:
    """No string further than ``distance`` insertions and deletions from one of
    ``length`` characters has a ratio above this.

    The matched characters are a common subsequence, so with ``d`` insertions
    and deletions at least, ``T - 2M >= d`` and the ratio is at most ``1 - d/T``;
    the other string has at most ``length + d`` characters, so ``T`` is at most
    ``2 length + d``, and ``2 length / (2 length + d)`` falls as ``d`` grows.
    """
    return (2 * length) / (2 * length + distance + 1)


def _best(scored: DataFrame) -> DataFrame:
    """The best-scored file of each job (ties: file name order)."""
    w = Window.partitionBy("lkey").orderBy(F.col("score").desc(), F.col("rkey"))
    return scored.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


#: Pairs that a task sorts and scores at most, as a mean.
PAIRS_PER_TASK = 100_000


def _scored(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs that reach ``threshold`` with their score.  Rows of one file stay
    together (sorted) so that a task reuses one matcher per file; a salt on the
    job key splits a file hit by many jobs.  The tasks grow with the pairs,
    which are written once to be counted, so a task's memory does not."""
    pairs = cut_lineage(pairs, "scored_pairs")
    slots = _tasks(pairs.count(), PAIRS_PER_TASK, pairs.sparkSession)
    salt = F.pmod(F.xxhash64("lkey"), F.lit(slots))
    return (pairs.repartition(slots, "rkey", salt).sortWithinPartitions("rkey")
            .withColumn("score", similarity_at_least(threshold)(F.col("ls"), F.col("rs")))
            .filter(F.col("score") >= threshold))


def _best_of_all(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """The best file of each job among the q-gram filter's candidates."""
    bounded = cut_lineage(
        fuzzy_candidates(left, right, threshold)
        .withColumn("upper", upper_bound(F.col("ls"), F.col("rs")))
        .filter(F.col("upper") >= threshold), "fuzzy_bounds")
    # the nearest file of each job by that bound is scored first; its score is
    # what any other file has to reach, and few bounds do
    first = (bounded.groupBy("lkey").agg(
        F.min_by(F.struct("ls", "rkey", "rs"), F.struct(-F.col("upper"), "rkey")).alias("p"))
        .select("lkey", similarity(F.col("p.ls"), F.col("p.rs")).alias("lower")))
    worth = (bounded.join(by_shuffle(first), "lkey")
             .filter(F.col("upper") >= F.greatest("lower", F.lit(threshold))))
    return _best(_scored(worth, threshold))


def match_fuzzy(jobs: DataFrame, idx: DataFrame,
                threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """Best ratio per job (ties: file name order), kept when
    ``>= threshold``."""
    j = _jobs(jobs).filter(F.col("job_norm") != "")
    left = j.select(F.col("job_key").alias("lkey"), F.col("job_norm").alias("ls"))
    right = idx.select(F.col("norm").alias("rkey"), F.col("norm").alias("rs"))
    settled = cut_lineage(
        _best(_scored(near_pairs(left, right), threshold))
        .where(F.col("score") > unseen_bound(F.length("ls"), 2))
        .select("lkey", "rkey", "score"), "fuzzy_near")
    rest = cut_lineage(left.join(by_shuffle(settled), "lkey", "left_anti"), "fuzzy_rest")
    best = settled
    if not rest.isEmpty():
        best = settled.unionByName(_best_of_all(rest, right, threshold)
                                   .select("lkey", "rkey", "score"))
    return (by_shuffle(best).join(j, F.col("lkey") == F.col("job_key"))
            .join(by_shuffle(idx), F.col("rkey") == F.col("norm"))
            .select("job_key", "job_name", "file_name", "code",
                    F.lit("fuzzy").alias("match_kind"), "score"))


def match_code(jobs: DataFrame, code: DataFrame,
               threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """Exact -> suffix -> fuzzy, each on the jobs still unmatched;
    ``match_kind`` records the tier, unmatched jobs get ``miss``.  Each tier's
    (small) result is written once so later tiers do not recompute it."""
    idx = by_shuffle(cut_lineage(code_index(code), "code_idx"))
    js = by_shuffle(cut_lineage(jobs.select("key", "name"), "match_jobs"))
    exact = cut_lineage(match_exact(js, idx), "match_exact")
    rest = js.join(exact.select(F.col("job_key").alias("key")), "key", "left_anti")
    suffix = cut_lineage(match_suffix(rest, idx), "match_suffix")
    rest = cut_lineage(rest.join(suffix.select(F.col("job_key").alias("key")), "key",
                                 "left_anti"), "match_rest")
    fuzzy = cut_lineage(match_fuzzy(rest, idx, threshold), "match_fuzzy")
    rest = rest.join(fuzzy.select(F.col("job_key").alias("key")), "key", "left_anti")
    miss = rest.select(F.col("key").alias("job_key"), F.col("name").alias("job_name"),
                       F.lit(None).cast("string").alias("file_name"),
                       F.lit(None).cast("string").alias("code"),
                       F.lit("miss").alias("match_kind"), F.lit(None).cast("double").alias("score"))
    return exact.unionByName(suffix).unionByName(fuzzy).unionByName(miss)


def _substrings(c: Column) -> Column:
    """All non-empty substrings of a (short) string."""
    n = F.length(c)
    return F.flatten(F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.transform(F.sequence(i, F.greatest(n, i)),
                              lambda j: F.substring(c, i, j - i + 1))))


def job_code(jobs: DataFrame, code: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """Code per job -- the cascade's match, else a file named exactly
    like the job, else the first file whose name is contained in the job name."""
    js = jobs.select(F.col("key").alias("job_key"), F.col("name").alias("job_name"))
    files = by_shuffle(code.select("file_name", "code"))
    by_name = (js.join(files, F.col("job_name") == F.col("file_name"))
               .groupBy("job_key").agg(F.min_by("code", "file_name").alias("c_name")))
    subs = (js.select("job_key", F.explode(F.array_distinct(_substrings(F.col("job_name"))))
                      .alias("sub"))
            .join(files, F.col("sub") == F.col("file_name"))
            .groupBy("job_key").agg(F.min_by("code", "file_name").alias("c_sub")))
    out = (js.join(by_shuffle(by_name), "job_key", "left")
           .join(by_shuffle(subs), "job_key", "left"))
    if matches is not None:
        out = out.join(by_shuffle(matches.filter(F.col("code").isNotNull())
                                  .select("job_key", F.col("code").alias("c_match"))),
                       "job_key", "left")
    else:
        out = out.withColumn("c_match", F.lit(None).cast("string"))
    return out.select("job_key", "job_name",
                      F.coalesce("c_match", "c_name", "c_sub").alias("code"))


def attach_code(jobs: DataFrame, code: DataFrame,
                threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """Jobs with their matched code (``code``) and match tier."""
    m = match_code(jobs, code, threshold)
    return jobs.join(by_shuffle(m.select("job_key", "code", "match_kind", "file_name")
                                .withColumnRenamed("job_key", "key")), "key", "left")
