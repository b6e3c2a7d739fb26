"""Batch retrieval over the chunk index.

Everything works on a *table of questions* ``(q_id, question)``, one output
row per (question, rank, chunk), instead of one question per call.

* Vector top-k (R06): index partitions are scored against a size-checked
  batch of query vectors with numpy inside ``mapInPandas``; each partition
  keeps only its k best per query, and a final group-limited window merges
  those.  Larger query sets run batch after batch -- no query is dropped.
* Term detection (R09): "term contained in the question" becomes an
  equi-join of terms with the question's substrings of the term lengths;
  "all tokens of the term are in the question" joins on the term's rarest
  token only, then checks the rest with ``array_except``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.scalars import contains_any, keep_lines, tokens
from ..session import by_shuffle, cut_lineage, spread
from .chunks import _ordered_join, lineage_lines
from .graph_ops import find_jobs, longest_match
from .lineage_graph import LineageGraph, run_stats
from .text_vectors import COMMON_SHARE, by_blocks, is_few, products, sparse_columns

# Fixed values the retrieval rules must reproduce.
LIST_KEYWORDS = (
    "listar", "lista", "todos", "todas", "enumera", "muéstrame",
    "cuántos", "cuantos", "qué tablas", "que tablas",
    "qué datasets", "que datasets", "inventario",
)
CODE_KEYWORDS = (
    "código", "codigo", "script", "implementación", "implementacion",
    "cómo funciona", "como funciona", "qué hace", "que hace",
    "lógica", "logica", "fuente", "python", ".py", "glue", "spark",
    "muéstrame", "muestrame", "enséñame", "enseñame", "ver el código",
    "cómo se calcula", "como se calcula", "cómo se genera", "como se genera",
    "cómo se construye", "como se construye", "cómo se obtiene", "como se obtiene",
    "de dónde viene", "de donde viene", "de dónde sale", "de donde sale",
    "cómo se rellena", "como se rellena", "cómo se popula", "como se popula",
    "qué lógica", "que logica", "que lógica",
    "lógica del campo", "logica del campo", "lógica de la columna", "logica de la columna",
    "cómo se deriva", "como se deriva", "cómo se transforma", "como se transforma",
    "ver", "muestra", "dame", "necesito",
)
SUMMARY_PREFIXES = ("Dataset:", "Produced by", "Namespace:")
DEFAULT_N = 20
LIST_MIN_N = 40
FETCH_CAP = 40
MIN_REST = 4
HISTORY_TURNS = 6
HISTORY_KEEP = 4
ASSISTANT_CUT = 200


def is_list_query(q) -> Column:
    """X20."""
    return contains_any(q, LIST_KEYWORDS)


def is_code_query(q) -> Column:
    """X20."""
    return contains_any(q, CODE_KEYWORDS)


def recall_n(q, n: int = DEFAULT_N) -> Column:
    """List-type questions ask for at least 40 results."""
    return F.when(is_list_query(q), F.greatest(F.lit(n), F.lit(LIST_MIN_N))).otherwise(F.lit(n))


def fetch_k(n: Column) -> Column:
    """Candidates fetched from the vector index, ``min(2n, 40)``."""
    return F.least(n * 2, F.lit(FETCH_CAP))


def tokens_subset(term_tokens: Column, q_tokens: Column) -> Column:
    """All tokens of the term are in the question, and more than one."""
    return (F.size(F.array_except(term_tokens, q_tokens)) == 0) & (F.size(term_tokens) > 1)


# ---------------------------------------------------------------- vectors


def _topk_batches(qids: np.ndarray, qmat: np.ndarray, k: int, metric: str,
                  id_col: str, vec_col: str):
    def fn(it):
        qnorm = np.sqrt((qmat * qmat).sum(axis=1)) if metric == "cosine" else None
        for pdf in it:
            if pdf.empty:
                continue
            ids = pdf[id_col].to_numpy()
            v = np.stack(pdf[vec_col].to_numpy()).astype(np.float64)
            if metric == "cosine":
                dot = np.zeros((qmat.shape[0], v.shape[0]))
                for j in range(v.shape[1]):
                    dot += qmat[:, j, None] * v[None, :, j]
                vnorm = np.sqrt((v * v).sum(axis=1))
                dist = 1.0 - dot / (qnorm[:, None] * vnorm[None, :])
            else:
                # squared L2, summed dimension by dimension (left to right)
                dist = np.zeros((qmat.shape[0], v.shape[0]))
                for j in range(v.shape[1]):
                    diff = qmat[:, j, None] - v[None, :, j]
                    dist += diff * diff
            kk = min(k, v.shape[0])
            out_q, out_id, out_d = [], [], []
            for qi in range(qmat.shape[0]):
                row = dist[qi]
                if kk < len(row):
                    cut = np.partition(row, kk - 1)[kk - 1]
                    sel = np.nonzero(row <= cut)[0]      # keeps every tie at the cut
                else:
                    sel = np.arange(len(row))
                order = np.lexsort((ids[sel], row[sel]))[:kk]
                out_q.extend([qids[qi]] * len(order))
                out_id.extend(ids[sel][order].tolist())
                out_d.extend(row[sel][order].tolist())
            yield pd.DataFrame({"q_id": out_q, id_col: out_id, "distance": out_d})
    return fn


def vector_search(index: DataFrame, queries: DataFrame, k: int, metric: str = "l2",
                  id_col: str = "vec_id", vec_col: str = "embedding",
                  max_queries_per_pass: int = 1024) -> DataFrame:
    """Exact top-k per query by squared L2 (default) or cosine.

    ``queries(q_id, qvec)``.  Query vectors travel as a broadcast of at most
    ``max_queries_per_pass`` rows (checked with a bounded count); more
    queries run in further passes.  Returns ``(q_id, rank, id, distance)``.
    """
    spark = index.sparkSession
    qid_type = queries.schema["q_id"].dataType
    out_schema = StructType([StructField("q_id", qid_type),
                             StructField(id_col, index.schema[id_col].dataType),
                             StructField("distance", DoubleType())])
    n = queries.limit(max_queries_per_pass + 1).count()
    if n <= max_queries_per_pass:
        batches = [queries]
    else:
        from .chunks import global_ordinal
        numbered = global_ordinal(queries, ["q_id"], "_qord")
        total = numbered.count()
        batches = [numbered.filter((F.col("_qord") >= s) & (F.col("_qord") < s + max_queries_per_pass))
                   for s in range(0, total, max_queries_per_pass)]
    parts = []
    for b in batches:
        rows = b.select("q_id", "qvec").collect()   # one bounded batch
        if not rows:
            continue
        qids = np.array([r[0] for r in rows], dtype=object)
        qmat = np.array([list(r[1]) for r in rows], dtype=np.float64)
        fn = _topk_batches(qids, qmat, k, metric, id_col, vec_col)
        parts.append(spread(index.select(id_col, vec_col)).mapInPandas(fn, out_schema))
    if not parts:
        return spark.createDataFrame([], out_schema.add("rank", LongType()))
    cand = parts[0]
    for p in parts[1:]:
        cand = cand.unionByName(p)
    w = Window.partitionBy("q_id").orderBy("distance", id_col)
    return (cand.withColumn("rank", F.row_number().over(w).cast("bigint"))
            .filter(F.col("rank") <= k)
            .select("q_id", "rank", id_col, "distance"))


def label_prototypes(embeddings: DataFrame) -> DataFrame:
    """Query vectors derived from the table: the lowest-id vector of each label."""
    return (embeddings.groupBy("label")
            .agg(F.min_by("embedding", "vec_id").alias("qvec"))
            .select(F.col("label").cast("bigint").alias("q_id"), "qvec"))


def approx_search(index: DataFrame, queries: DataFrame, k: int, bucket_length: float = 2.0,
                  num_tables: int = 3, threshold: float = 1e9, seed: int = 7) -> DataFrame:
    """Approximate neighbours with random-projection LSH (a bucket join,
    then top-k by Euclidean distance per query)."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    ix = index.select("vec_id", array_to_vector("embedding").alias("v"))
    qs = queries.select("q_id", array_to_vector("qvec").alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket_length,
                                        numHashTables=num_tables, seed=seed).fit(ix)
    pairs = model.approxSimilarityJoin(qs, ix, threshold, distCol="distance")
    flat = pairs.select(F.col("datasetA.q_id").alias("q_id"),
                        F.col("datasetB.vec_id").alias("vec_id"), "distance")
    w = Window.partitionBy("q_id").orderBy("distance", "vec_id")
    return flat.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def embed_text(df: DataFrame, text_col: str = "text", num_features: int = 1 << 12):
    """Text vectors without an external model (tokens -> hashed term
    frequencies -> IDF -> unit length).  Returns (fitted model, frame with
    ``vec: array<double>`` and the same without its zeros, ``_unit``)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"[\s_\-/]+"),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_unit", p=2.0),
    ])
    model = pipe.fit(df)
    out = model.transform(df).withColumn("vec", vector_to_array("_unit")) \
        .drop("_tok", "_tf", "_idf")
    return model, out


# ---------------------------------------------------------- term matching


def index_terms(index: DataFrame) -> DataFrame:
    """Distinct non-empty namespace and name values of the index metadata:
    ``(term_kind, term)``."""
    ns = index.select(F.lit("namespace").alias("term_kind"), F.col("namespace").alias("term"))
    nm = index.select(F.lit("name").alias("term_kind"), F.col("name").alias("term"))
    return ns.unionByName(nm).filter(F.coalesce(F.col("term"), F.lit("")) != "").distinct()


GRAM = 4        # characters of the grams that anchor a term


def _grams(c: Column, k: int) -> Column:
    """The distinct substrings of ``k`` characters (the whole of a shorter text)."""
    return F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(c) - k + 1, F.lit(1))),
        lambda i: F.substring(c, i, k)))


def contained_terms(questions: DataFrame, terms: DataFrame, qcol: str = "question",
                    k: int = GRAM) -> DataFrame:
    """``(q_id, term_kind, term)`` where ``lower(term)`` occurs in the
    lower-cased question.

    A contained term's grams of ``k`` characters all occur in the question, so
    joining each term's rarest gram (counted over all terms) with the
    question's grams loses none, and ``contains`` decides the few candidates.
    A term shorter than ``k`` is its own gram.  Grams are many times the texts
    they come from: those of questions that are no term's rarest are left out
    before the join (by a broadcast if the rarest are few, as counted), and all
    other joins shuffle; the anchors are written once, which ends the plan over
    the terms there.
    """
    t = by_shuffle(terms.withColumn("lterm", F.lower("term")))
    q = questions.select("q_id", F.lower(qcol).alias("_lq")).where("q_id is not null")
    by_gram = t.where(F.length("lterm") >= k).withColumn("gram", F.explode(_grams(F.col("lterm"), k)))
    freq = by_gram.groupBy("gram").agg(F.count(F.lit(1)).alias("_f"))
    w = Window.partitionBy("term_kind", "term").orderBy("_f", "gram")
    rarest = (by_gram.join(freq, "gram").withColumn("_r", F.row_number().over(w))
              .where("_r = 1").select("gram", "term_kind", "term", "lterm"))
    short = t.where(F.length("lterm") < k).select(F.col("lterm").alias("gram"), "term_kind", "term",
                                                  "lterm")
    anchors = cut_lineage(rarest.unionByName(short), "term_anchors")
    pieces = F.array_distinct(F.concat(*[_grams(F.col("_lq"), n) for n in range(1, k + 1)]))
    asked = q.select("q_id", "_lq", F.explode(pieces).alias("gram"))
    wanted = anchors.select("gram").distinct()
    if is_few(wanted):
        asked = cut_lineage(asked.join(F.broadcast(wanted), "gram", "left_semi"), "question_grams")
    return (by_shuffle(asked).join(by_shuffle(anchors), "gram")
            .where(F.col("_lq").contains(F.col("lterm"))).select("q_id", "term_kind", "term"))


def token_subset_terms(questions: DataFrame, terms: DataFrame,
                       qcol: str = "question") -> DataFrame:
    """``(q_id, term_kind, term)`` where the term has more than one token and
    all of them are question tokens (joined on the term's rarest token)."""
    t = by_shuffle(terms.withColumn("ttok", F.array_distinct(tokens("term")))
                   .filter(F.size("ttok") > 1))
    freq = (t.select(F.explode("ttok").alias("tok")).groupBy("tok")
            .agg(F.count(F.lit(1)).alias("f")))
    te = t.select("term_kind", "term", "ttok", F.explode("ttok").alias("tok")).join(freq, "tok")
    w = Window.partitionBy("term_kind", "term").orderBy("f", "tok")
    rare = te.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "f")
    qt = questions.select("q_id", F.array_distinct(tokens(qcol)).alias("qtok"))
    qe = by_shuffle(qt.select("q_id", "qtok", F.explode("qtok").alias("tok")))
    return (qe.join(rare, "tok").filter(tokens_subset(F.col("ttok"), F.col("qtok")))
            .select("q_id", "term_kind", "term"))


def detect_entities(questions: DataFrame, index: DataFrame, qcol: str = "question") -> DataFrame:
    """Per question the longest matching namespace and name
    (ties: alphabetical).  ``(q_id, ns, name)``; null when none matches."""
    terms = cut_lineage(index_terms(index), "terms")
    hits = contained_terms(questions, terms, qcol).unionByName(
        token_subset_terms(questions, terms, qcol)).distinct()
    best = longest_match(hits, ["q_id", "term_kind"], "term")
    piv = best.groupBy("q_id").agg(
        F.max(F.when(F.col("term_kind") == "namespace", F.col("term"))).alias("ns"),
        F.max(F.when(F.col("term_kind") == "name", F.col("term"))).alias("name"))
    return questions.select("q_id").join(by_shuffle(piv), "q_id", "left")


# ----------------------------------------------------------- graph context


def _schema_line(schema: Column) -> Column:
    return F.when(F.size(schema) > 0, F.concat(F.lit("Schema: "), F.array_join(schema, ", ")))


def graph_context(g: LineageGraph, questions: DataFrame, job_code: DataFrame | None = None,
                  qcol: str = "question") -> DataFrame:
    """Context document of the node with the longest name contained in
    the question (ties: name, then key).  ``(q_id, node_key, kind, context)``."""
    nodes = g.nodes.filter(F.coalesce(F.col("name"), F.lit("")) != "")
    terms = cut_lineage(nodes.select(F.lit("node").alias("term_kind"), F.col("name").alias("term"))
                        .distinct(), "node_names")
    hits = contained_terms(questions, terms, qcol).select("q_id", F.col("term").alias("name"))
    cand = by_shuffle(hits).join(nodes, "name")
    w = Window.partitionBy("q_id").orderBy(F.length("name").desc(), "name", "key")
    best = cand.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    # read for datasets and for jobs
    best = by_shuffle(cut_lineage(
        by_shuffle(best).join(questions.select("q_id", F.col(qcol).alias("_q")), "q_id"),
        "named_nodes"))

    # dataset documents
    pc = by_shuffle(find_jobs(g).select("key", "producers", "consumers"))
    ll = by_shuffle(lineage_lines(g).withColumnRenamed("lines", "ll"))
    ds = g.datasets.join(pc, "key", "left").join(ll, "key", "left")
    ds_doc = F.concat_ws(
        "\n",
        F.concat(F.lit("Dataset: "), F.col("name")),
        F.concat(F.lit("Namespace: "), F.col("namespace")),
        F.concat(F.lit("Formato: "), F.col("format")),
        _schema_line(F.col("schema")),
        F.when(F.size(F.coalesce("ll", F.array())) > 0,
               F.concat(F.lit("Linaje de columnas:\n"), F.array_join("ll", "\n"))),
        F.when(F.size("producers") > 0,
               F.concat(F.lit("Producido por: "), F.array_join("producers", ", "))),
        F.when(F.size("consumers") > 0,
               F.concat(F.lit("Consumido por: "), F.array_join("consumers", ", "))))
    ds_docs = by_shuffle(ds.select("key", ds_doc.alias("ds_doc")))

    # job documents: per-dataset blocks for inputs and outputs
    ll_short = by_shuffle(lineage_lines(g, with_transform=False))
    blocks = g.datasets.join(ll_short, "key", "left").select(
        F.col("key").alias("ds_key"),
        F.concat_ws("\n",
                    F.concat(F.lit("  - "), F.col("name"), F.lit(" ["), F.col("namespace"),
                             F.lit("]")),
                    F.when(F.size("schema") > 0,
                           F.concat(F.lit("    Schema: "), F.array_join("schema", ", "))),
                    F.when(F.size(F.coalesce("lines", F.array())) > 0,
                           F.array_join(F.transform("lines", lambda x: F.concat(F.lit("  "), x)),
                                        "\n"))).alias("block"),
        "name")

    def side(relation: str, job_end: str, ds_end: str, label: str) -> DataFrame:
        e = g.edges.filter(F.col("relation") == relation).select(
            F.col(job_end).alias("key"), F.col(ds_end).alias("ds_key"))
        return by_shuffle(
            e.join(by_shuffle(blocks), "ds_key").groupBy("key")
            .agg(F.count(F.lit(1)).alias(f"n_{label}"),
                 _ordered_join(F.collect_list(F.struct(F.col("name").alias("o"),
                                                       F.col("ds_key").alias("o2"),
                                                       F.col("block").alias("text"))), "\n")
                 .alias(f"b_{label}")))
    rs = by_shuffle(run_stats(g.runs).withColumnRenamed("job_key", "key"))
    jobs = (g.jobs.join(rs, "key", "left").join(side("feeds", "dst", "src", "in"), "key", "left")
            .join(side("produces", "src", "dst", "out"), "key", "left"))
    if job_code is not None:
        jobs = jobs.join(by_shuffle(job_code.select(F.col("job_key").alias("key"), "code")), "key",
                         "left")
    else:
        jobs = jobs.withColumn("code", F.lit(None).cast("string"))
    jobs = jobs.select("key", "name", "namespace", "n_complete", "n_fail", "last", "code",
                       "n_in", "b_in", "n_out", "b_out")
    jb = (best.filter(F.col("kind") == "job").select("q_id", "key", "_q")
          .join(by_shuffle(jobs), "key"))
    code_part = F.when(F.coalesce(F.col("code"), F.lit("")) != "",
                       F.when(is_code_query(F.col("_q")),
                              F.concat(F.lit("\nCódigo fuente ("), F.col("name"),
                                       F.lit(".py):\n```python\n"),
                                       F.regexp_replace("code", r"(?U)^\s+|\s+$", ""),
                                       F.lit("\n```")))
                       .otherwise(F.concat(F.lit("\nCódigo fuente disponible: "), F.col("name"),
                                           F.lit(".py"))))
    job_doc = F.concat_ws(
        "\n",
        F.concat(F.lit("Job: "), F.col("name")),
        F.concat(F.lit("Namespace: "), F.col("namespace")),
        F.concat(F.lit("Ejecuciones: "), F.coalesce("n_complete", F.lit(0)).cast("string"),
                 F.lit(" exitosas, "), F.coalesce("n_fail", F.lit(0)).cast("string"),
                 F.lit(" fallidas")),
        F.when(F.col("last").isNotNull(),
               F.concat(F.lit("Último evento: "), F.col("last.event_type"), F.lit(" en "),
                        F.col("last.event_time"))),
        code_part,
        F.concat(F.lit("\nInputs ("), F.coalesce("n_in", F.lit(0)).cast("string"), F.lit("):")),
        F.col("b_in"),
        F.concat(F.lit("\nOutputs ("), F.coalesce("n_out", F.lit(0)).cast("string"),
                 F.lit("):")),
        F.col("b_out"))
    job_ctx = jb.select("q_id", F.col("key").alias("node_key"), F.lit("job").alias("kind"),
                        job_doc.alias("context"))
    ds_ctx = (best.filter(F.col("kind") == "dataset").select("q_id", "key")
              .join(ds_docs, "key")
              .select("q_id", F.col("key").alias("node_key"), F.lit("dataset").alias("kind"),
                      F.col("ds_doc").alias("context")))
    return ds_ctx.unionByName(job_ctx)


# ---------------------------------------------------------------- retrieve


def first_per_name(hits: DataFrame) -> DataFrame:
    """Best-ranked row per (question, name)."""
    w = Window.partitionBy("q_id", "name").orderBy("rank", "id")
    return hits.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def namespace_summary(index: DataFrame, detected: DataFrame) -> DataFrame:
    """Per question with a detected namespace, the kept lines of every
    dataset chunk of that namespace: ``(q_id, name, summary)``."""
    ds = index.filter(F.col("kind") == "dataset").select(
        F.col("namespace").alias("ns"), "name", "id",
        keep_lines(F.col("document"), SUMMARY_PREFIXES).alias("summary"))
    return detected.filter(F.col("ns").isNotNull()).select("q_id", "ns").join(by_shuffle(ds), "ns")


def budget(ranked: DataFrame, n_col: str = "n", min_rest: int = MIN_REST) -> DataFrame:
    """Priority rows (tier 0/1) always, then the first ``max(n - p,
    min_rest)`` of the rest by position."""
    w = Window.partitionBy("q_id").orderBy("tier", "pos")
    first = F.count_if(F.col("tier") < 2).over(Window.partitionBy("q_id"))
    r = (ranked.where("q_id is not null").withColumn("_p", first)
         .withColumn("_i", F.row_number().over(w)))
    keep = (F.col("tier") < 2) | (F.col("_i") - F.col("_p")
                                  <= F.greatest(F.col(n_col) - F.col("_p"), F.lit(min_rest)))
    return r.filter(keep).drop("_p", "_i")


def exact_boost(detected: DataFrame, index: DataFrame, seen: DataFrame) -> DataFrame:
    """The chunks named exactly like a question's detected name, where the
    question has not ``seen(q_id, name)`` that name already."""
    return (detected.filter(F.col("name").isNotNull()).join(by_shuffle(index), "name")
            .join(by_shuffle(seen), ["q_id", "name"], "left_anti"))


def hits_wanted(n: int = DEFAULT_N, cap: int = FETCH_CAP) -> int:
    """The most hits that ``retrieve`` reads of any question."""
    return min(2 * max(n, LIST_MIN_N), cap)


@F.pandas_udf(DoubleType())
def _length(terms: pd.Series, weights: pd.Series, dims: pd.Series) -> pd.Series:
    """Vector lengths, summed over all dimensions as ``vector_search`` does."""
    out = []
    for at, w, n in zip(terms, weights, dims):
        full = np.zeros((1, n))
        full[0, np.asarray(at, dtype=np.int64)] = w
        out.append(float(np.sqrt((full * full).sum(axis=1))[0]))
    return pd.Series(out, dtype="float64")


def _nonzero(vectors: DataFrame, id_col: str, vec_col: str, name: str) -> DataFrame:
    """``(row, id, terms, weights, norm)``: the dimensions of each vector that are
    not zero, ascending, written once; ``row`` tells vectors of one id apart.
    Vectors are arrays, or the vectors of Spark ML, read without their zeros."""
    v = F.col(vec_col)
    if isinstance(vectors.schema[vec_col].dataType, VectorUDT):
        sparse = vectors.where(v.isNotNull()).select(
            F.col(id_col).alias("id"), F.unwrap_udt(v).alias("_u")).select(
            "id", F.col("_u.values").alias("_w"),
            F.coalesce("_u.indices", F.expr("sequence(0, size(_u.values) - 1)")).alias("_at"),
            F.coalesce("_u.size", F.size("_u.values")).alias("dims"))
        found = (spread(sparse).withColumn("_keep", F.expr(
            "filter(sequence(0, size(_w) - 1), i -> size(_w) > 0 and _w[i] <> 0D)"))
            .select("id", F.expr("transform(_keep, i -> _at[i])").alias("terms"),
                    F.expr("transform(_keep, i -> _w[i])").alias("weights"), "dims"))
    else:
        found = (spread(vectors.select(F.col(id_col).alias("id"), v.alias("_v")))
                 .where("_v is not null")
                 .select("id", "_v", F.expr("filter(sequence(0, size(_v) - 1), i -> _v[i] <> 0D)")
                         .alias("terms"))
                 .select("id", "terms", F.expr("transform(terms, i -> _v[i])").alias("weights"),
                         F.size("_v").alias("dims")))
    return by_shuffle(cut_lineage(
        found.withColumn("row", F.monotonically_increasing_id())
        .withColumn("norm", _length("terms", "weights", "dims")).drop("dims"), name))


def _nearest(queries: pa.Table, k: int, common_share: float):
    """The function of a task that compares ``queries`` with a block of texts.

    Every product is added in the order of the dimensions, as ``vector_search``
    adds them, so the distances are the same."""
    qrows, qterms, qweights, qnorms = (queries[c].to_pylist()
                                       for c in ("vec", "terms", "weights", "norm"))

    def near(block: pd.DataFrame):
        size, columns = len(block), sparse_columns(block, common_share)
        norms, rows = block["norm"].to_numpy(np.float64), block["row"].to_numpy()
        blank = norms == 0
        some_blank, kk = bool(blank.any()), min(k, size)
        out: tuple[list, list, list] = [], [], []
        for q, q_terms, q_weights, q_norm in zip(qrows, qterms, qweights, qnorms):
            dot = products(columns, size, q_terms, q_weights)
            if q_norm == 0:
                dist = np.full(size, np.inf)
            elif some_blank:                # no direction, no distance: after all others
                dist = np.where(blank, np.inf, 1.0 - dot / (q_norm * np.where(blank, 1.0, norms)))
            else:
                dist = 1.0 - dot / (q_norm * norms)
            if kk < size:
                best = np.flatnonzero(dist <= np.partition(dist, kk - 1)[kk - 1])
            else:
                best = np.arange(size)
            best = best[np.argsort(dist[best], kind="stable")[:kk]]   # the block is in order of ids
            out[0].append(np.full(kk, q))
            out[1].append(rows[best])
            out[2].append(dist[best])
            if len(out[0]) >= 1000:
                yield pd.DataFrame(dict(zip(("vec", "row", "distance"), map(np.concatenate, out))))
                out = [], [], []
        if out[0]:
            yield pd.DataFrame(dict(zip(("vec", "row", "distance"), map(np.concatenate, out))))

    return near


def vector_hits(index_vecs: DataFrame, query_vecs: DataFrame, n: int = DEFAULT_N,
                common_share: float = COMMON_SHARE) -> DataFrame:
    """Semantic hits ``(q_id, rank, id)`` from ``index_vecs(id, vec)`` and
    ``query_vecs(q_id, qvec)``, the chunk and question vectors.

    The same rows as ``vector_search`` by cosine.  The vectors are mostly zeros
    and are compared without them: texts lie in blocks, a bounded batch of
    question vectors travels to every block, and a block gives back the best of
    each vector, so no pair of a question and a text is ever written beyond
    those.  Questions of equal vectors are searched once.  Vectors with negative
    parts are scored in full.
    """
    k = hits_wanted(n)
    index = _nonzero(index_vecs, "id", "vec", "index_vectors")
    queries = _nonzero(query_vecs, "q_id", "qvec", "query_vectors").withColumnsRenamed(
        {"id": "q_id", "row": "q_row"})
    negative = F.exists("weights", lambda w: w < 0)
    if not (index.where(negative).isEmpty() and queries.where(negative).isEmpty()):
        return vector_search(*(
            x.withColumn(c, vector_to_array(c)) if isinstance(x.schema[c].dataType, VectorUDT) else x
            for x, c in ((index_vecs, "vec"), (query_vecs, "qvec"))),
            k, metric="cosine", id_col="id", vec_col="vec").select("q_id", "rank", "id")
    alike = cut_lineage(queries.groupBy("terms", "weights", "norm")
                        .agg(F.min("q_row").alias("vec")), "distinct_vectors")
    vec_of = queries.join(by_shuffle(alike), ["terms", "weights", "norm"]).select("q_id", "vec")
    near = by_blocks(index, alike, ["id", "row"], ["row", "terms", "weights", "norm"],
                     lambda batch: _nearest(batch, k, common_share),
                     "vec bigint, row bigint, distance double")
    near = (near.withColumn("_r", F.rank().over(Window.partitionBy("vec").orderBy("distance")))
            .where(F.col("_r") <= k).drop("_r"))
    best = Window.partitionBy("vec").orderBy("distance", "id", "row")
    near = by_shuffle(near).join(by_shuffle(index.select("row", "id")), "row")
    near = near.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k)
    return by_shuffle(vec_of).join(by_shuffle(near), "vec").select("q_id", "rank", "id")


def retrieve(questions: DataFrame, g: LineageGraph, index: DataFrame, hits: DataFrame,
             n: int = DEFAULT_N, search_text: DataFrame | None = None,
             fetch_cap: int = FETCH_CAP, min_rest: int = MIN_REST) -> DataFrame:
    """The context rows of each question.

    tier 0: graph document of the node named in the question (R10);
    tier 1: the chunk whose name equals the detected name (R11);
    tier 2: semantic ``hits(q_id, rank, id)``, first per name (W04), of which a
    question reads ``min(2n, fetch_cap)``; then the namespace summary (R12);
    the rest is cut to the budget, ``min_rest`` at least (K04).  Questions,
    detected names and each tier are written once, since several tiers read
    them.  Rows hold numbers of documents; the texts come to the rows that stay.
    """
    qs = questions.select("q_id", "question",
                          recall_n(F.col("question"), n).alias("n"))
    if search_text is not None:
        qs = qs.join(search_text.select("q_id", "search"), "q_id", "left")
    else:
        qs = qs.withColumn("search", F.col("question"))

    def numbered(df: DataFrame, name: str) -> DataFrame:
        return by_shuffle(cut_lineage(df.withColumn("doc", F.monotonically_increasing_id()), name))
    index = numbered(index, "chunks")
    qs = by_shuffle(cut_lineage(qs, "questions"))
    ctx = numbered(graph_context(g, qs.select("q_id", "question")), "context")
    # the graph document's node name counts as already seen, in every tier below
    named = by_shuffle(cut_lineage(
        ctx.select("q_id", "node_key")
        .join(by_shuffle(g.nodes.select(F.col("key").alias("node_key"), "name")), "node_key")
        .select("q_id", "name").distinct(), "named"))
    det = by_shuffle(cut_lineage(
        detect_entities(qs.select("q_id", F.col("search").alias("question")), index), "detected"))
    about = (qs.select("q_id", "n")
             .join(by_shuffle(named.groupBy("q_id").agg(F.collect_set("name").alias("_named"))),
                   "q_id", "left")
             .join(by_shuffle(det.groupBy("q_id").agg(
                 F.collect_set("name").alias("_name"), (F.count("ns") > 0).alias("_listed"))),
                 "q_id", "left"))
    is_in = lambda names: F.coalesce(F.array_contains(names, F.col("name")), F.lit(False))
    sem = (by_shuffle(hits).join(index.select("id", "name", "doc"), "id")
           .join(by_shuffle(about), "q_id")
           .filter(F.col("rank") <= F.least(F.col("n") * 2, F.lit(fetch_cap)))
           .where(~is_in("_named"))
           .select("q_id", "rank", "id", "name", "doc", is_in("_name").alias("detected"),
                   F.coalesce("_listed", F.lit(False)).alias("listed")))
    sem = cut_lineage(first_per_name(sem), "semantic")
    # of the names that a question has seen, those that a tier compares with
    seen = sem.where("detected").select("q_id", "name").unionByName(named)
    boost = (exact_boost(det, index, seen)
             .groupBy("q_id", "name").agg(F.min_by("doc", "id").alias("doc")))
    boost = cut_lineage(boost, "boost")
    summ = namespace_summary(index, det)
    seen = (sem.where("listed").select("q_id", "name").unionByName(boost.select("q_id", "name"))
            .unionByName(named))
    summ = summ.join(by_shuffle(seen), ["q_id", "name"], "left_anti")
    summ_doc = (summ.groupBy("q_id", "ns")
                .agg(_ordered_join(F.collect_list(F.struct(F.col("name").alias("o"),
                                                           F.col("id").alias("o2"),
                                                           F.col("summary").alias("text"))),
                                   "\n\n").alias("body"))
                .select("q_id", F.concat(F.lit("Datasets in "), F.col("ns"), F.lit(":\n\n"),
                                         F.col("body")).alias("document")))
    summ_doc = numbered(summ_doc, "summaries")

    def tier(df: DataFrame, number: int, pos: Column, of: int) -> DataFrame:
        return df.select("q_id", F.lit(number).alias("tier"), pos.alias("pos"),
                         F.lit(of).alias("of"), "doc")
    rows = (tier(ctx, 0, F.lit(0), 0).unionByName(tier(boost, 1, F.lit(0), 1))
            .unionByName(tier(sem, 2, F.col("rank"), 1))
            .unionByName(tier(summ_doc, 3, F.lit(1 << 30), 2)))
    kept = budget(by_shuffle(rows).join(qs.select("q_id", "n"), "q_id"), min_rest=min_rest)
    texts = (ctx.select(F.lit(0).alias("of"), "doc", F.col("context").alias("document"))
             .unionByName(index.select(F.lit(1).alias("of"), "doc", "document"))
             .unionByName(summ_doc.select(F.lit(2).alias("of"), "doc", "document")))
    return (by_shuffle(kept).join(by_shuffle(texts), ["of", "doc"])
            .select("q_id", "tier", "pos", "document", "n"))


# ------------------------------------------------------------ chat history


def history_query(conversations: DataFrame) -> DataFrame:
    """Per conversation, the search text for its last user turn: the
    user/assistant turns among the six before it (assistant text cut to
    200), the last four of those, then the question."""
    user_last = (conversations.filter(F.col("role") == "user").groupBy("conv_id")
                 .agg(F.max("turn").alias("q_turn")))
    c = conversations.join(user_last, "conv_id")
    q = c.filter(F.col("turn") == F.col("q_turn")).select("conv_id", F.col("text").alias("q"))
    hist = c.filter(F.col("turn") < F.col("q_turn"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    recent = (hist.withColumn("_back", F.row_number().over(w))
              .filter(F.col("_back") <= HISTORY_TURNS)
              .filter(F.col("role").isin("user", "assistant"))
              .withColumn("_back2", F.row_number().over(w))
              .filter(F.col("_back2") <= HISTORY_KEEP)
              .select("conv_id", "turn",
                      F.when(F.col("role") == "user", F.col("text"))
                      .otherwise(F.substring("text", 1, ASSISTANT_CUT)).alias("t")))
    joined = recent.groupBy("conv_id").agg(
        _ordered_join(F.collect_list(F.struct(F.col("turn").alias("o"),
                                              F.col("t").alias("text"))), " ").alias("ctx"))
    return q.join(joined, "conv_id", "left").select(
        "conv_id", F.concat_ws(" ", F.col("ctx"), F.col("q")).alias("search"))


def qa_pairs(conversations: DataFrame) -> DataFrame:
    """Question/answer pairs: a user turn and the assistant turn right after it."""
    u = conversations.filter(F.col("role") == "user").select(
        "conv_id", F.col("turn").alias("q_turn"), F.col("text").alias("question"))
    a = conversations.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("q_turn"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "q_turn"])


def last_pairs(conversations: DataFrame, n: int = 5) -> DataFrame:
    """The last ``n`` pairs per conversation, oldest first (``pos`` 1..n)."""
    p = qa_pairs(conversations)
    w = Window.partitionBy("conv_id").orderBy(F.col("q_turn").desc())
    last = p.withColumn("_back", F.row_number().over(w)).filter(F.col("_back") <= n)
    w2 = Window.partitionBy("conv_id").orderBy("q_turn")
    return last.withColumn("pos", F.row_number().over(w2)).drop("_back")
