"""Registered retrieval and chat-history queries (R06-R15, K03-K04, W04-W05,
U05, X19-X23, S10-S11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import as_passage, as_query, keep_lines, left, tokens
from ..operators import chunks as C
from ..operators import retrieve as R
from ..operators.text_vectors import TextIndex
from ..session import cut_lineage, scratch_path
from ..sources import chatlog as H
from ..sources.tables import table
from . import oracle as O
from . import oracle_chunks  # noqa: F401  (registers the chunk CTEs)
from .graph_queries import graph

K = 10


def questions(g):
    """Question batch derived from the graph: an impact question per dataset,
    a code question per job, a list question per namespace."""
    ds = g.datasets.select(F.concat(F.lit("impact:"), F.col("key")).alias("q_id"),
                           F.concat(F.lit("que rompe si cambio "), F.col("name")).alias("question"))
    jb = g.jobs.select(F.concat(F.lit("code:"), F.col("key")).alias("q_id"),
                       F.concat(F.lit("muéstrame el código de "), F.col("name")).alias("question"))
    ns = (g.datasets.select("namespace").filter(F.col("namespace") != "").distinct()
          .select(F.concat(F.lit("list:"), F.col("namespace")).alias("q_id"),
                  F.concat(F.lit("lista todas las tablas de "), F.col("namespace"))
                  .alias("question")))
    return ds.unionByName(jb).unionByName(ns)


def graph_index(g):
    return cut_lineage(C.build_chunks(g))


def q_vector_search(spark, d):
    e = table(spark, d, "embeddings")
    return R.vector_search(e, R.label_prototypes(e), K).select("q_id", "rank", "vec_id")


def q_vector_cosine(spark, d):
    e = table(spark, d, "embeddings")
    return R.vector_search(e, R.label_prototypes(e), K, metric="cosine").select(
        "q_id", "rank", "vec_id")


def q_approx(spark, d):
    e = table(spark, d, "embeddings")
    return R.approx_search(e, R.label_prototypes(e), K).select("q_id", "rank", "vec_id")


def q_embed_text(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    _, out = R.embed_text(docs)
    return out.select("doc_id", F.size("vec").alias("dims"),
                      F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x).alias("norm2"))


def q_text_weights(spark, d):
    """The sparse vector of every document."""
    index = TextIndex(table(spark, d, "documents"), "doc_id")
    return index.postings.select(F.col("id").alias("doc_id"), "term",
                                 F.round("weight", 6).alias("weight"))


def q_text_search(spark, d):
    """The documents nearest to each benchmark passage."""
    index = TextIndex(table(spark, d, "documents"), "doc_id")
    return index.search(table(spark, d, "benchmark"), "item_id", K).select(
        F.col("q_id").alias("item_id"), "rank", F.col("id").alias("doc_id"),
        F.round("score", 6).alias("score"))


def q_detect(spark, d):
    g = graph(spark, d)
    return R.detect_entities(questions(g), graph_index(g))


def q_tokens_subset(spark, d):
    g = graph(spark, d)
    return R.token_subset_terms(questions(g), R.index_terms(graph_index(g)))


def q_graph_context(spark, d):
    g = graph(spark, d)
    return R.graph_context(g, questions(g))


def q_intents(spark, d):
    g = graph(spark, d)
    q = questions(g)
    return q.select("q_id", R.is_list_query(F.col("question")).alias("is_list"),
                    R.is_code_query(F.col("question")).alias("is_code"),
                    R.recall_n(F.col("question")).alias("n"),
                    R.fetch_k(R.recall_n(F.col("question"))).alias("fetch_k"),
                    F.array_join(tokens("question"), "|").alias("tokens"),
                    as_query(F.col("question")).alias("query_text"))


def q_namespace_summary(spark, d):
    g = graph(spark, d)
    det = R.detect_entities(questions(g), graph_index(g))
    return R.namespace_summary(graph_index(g), det).select("q_id", "name", "summary")


def q_exact_boost(spark, d):
    g = graph(spark, d)
    idx = graph_index(g)
    det = cut_lineage(R.detect_entities(questions(g), idx), "detected")
    nothing_seen = det.select("q_id", "name").limit(0)
    return (R.exact_boost(det, idx, nothing_seen)
            .groupBy("q_id", "name").agg(F.min("id").alias("id")))


def q_first_per_name(spark, d):
    e = table(spark, d, "embeddings")
    hits = R.vector_search(e, R.label_prototypes(e), 40)
    named = hits.join(e.select("vec_id", F.col("label").cast("string").alias("name")), "vec_id")
    return R.first_per_name(named.withColumn("id", F.col("vec_id"))).select(
        "q_id", "name", "rank", "vec_id")


def q_budget(spark, d):
    e = table(spark, d, "embeddings")
    hits = R.vector_search(e, R.label_prototypes(e), 40)
    ranked = hits.select("q_id", F.when(F.col("rank") == 1, 0).otherwise(2).alias("tier"),
                         F.col("rank").alias("pos"), "vec_id", F.lit(12).alias("n"))
    return R.budget(ranked).select("q_id", "tier", "pos", "vec_id")


def q_retrieve(spark, d):
    g = graph(spark, d)
    idx = graph_index(g)
    qs = questions(g)
    model, iv = R.embed_text(idx.withColumnRenamed("document", "text"))
    qv = model.transform(qs.withColumn("text", as_query(F.col("question"))))
    hits = R.vector_hits(iv.select("id", F.col("_unit").alias("vec")),
                         qv.select("q_id", F.col("_unit").alias("qvec")))
    return R.retrieve(qs, g, idx, hits).select(
        "q_id", "tier", "pos", F.length("document").alias("doc_len"))


def q_retrieve_documents(spark, d):
    """R13 with semantic hits by sparse text vectors: the whole documents."""
    g = graph(spark, d)
    idx = graph_index(g)
    qs = cut_lineage(questions(g), "questions")
    hits = TextIndex(idx, "id", "document").search(qs, "q_id", R.hits_wanted(), "question")
    return R.retrieve(qs, g, idx, hits).select("q_id", "tier", "pos", "document")


def q_history(spark, d):
    return R.history_query(table(spark, d, "conversations"))


def q_last_pairs(spark, d):
    return R.last_pairs(table(spark, d, "conversations")).select(
        "conv_id", "pos", "question", "answer")


def q_chat_roundtrip(spark, d):
    entries = H.chat_entries(table(spark, d, "conversations"))
    path = scratch_path(spark, "chatlog")
    H.append_chat(entries, path)
    return H.read_chat_logs(spark, path).select("chat_date", "question", "answer")


def q_text_helpers(spark, d):
    g = graph(spark, d)
    idx = graph_index(g).filter(F.col("kind") == "dataset")
    return idx.select("id", left(F.col("document"), 200).alias("head"),
                      keep_lines(F.col("document"), R.SUMMARY_PREFIXES).alias("kept"),
                      as_passage(F.col("name")).alias("passage"))


# ------------------------------------------------------------------ oracle

O._cte("questions", ("lin_datasets", "lin_jobs"), """
SELECT 'impact:' || key AS q_id, 'que rompe si cambio ' || name AS question FROM lin_datasets
UNION ALL
SELECT 'code:' || key, 'muéstrame el código de ' || name FROM lin_jobs
UNION ALL
SELECT DISTINCT 'list:' || namespace, 'lista todas las tablas de ' || namespace
FROM lin_datasets WHERE namespace <> ''""")

O._cte("graph_index", ("chunk_datasets", "chunk_jobs", "chunk_impact"), """
SELECT id, kind, name, namespace, source, 'passage: ' || text AS document FROM chunk_datasets
UNION ALL SELECT id, kind, name, namespace, source, 'passage: ' || text FROM chunk_jobs
UNION ALL SELECT id, kind, name, namespace, source, 'passage: ' || text FROM chunk_impact""")

_TOK = "list_distinct(string_split_regex(lower({x}), '[\\s_\\-/]+'))"

O._cte("terms", ("graph_index",), f"""
SELECT DISTINCT term_kind, term, {_TOK.format(x='term')} AS ttok FROM (
  SELECT 'namespace' AS term_kind, namespace AS term FROM graph_index
  UNION ALL SELECT 'name', name FROM graph_index) WHERE coalesce(term, '') <> ''""")

O._cte("term_hits", ("questions", "terms"), f"""
SELECT DISTINCT q.q_id, t.term_kind, t.term FROM questions q JOIN terms t
  ON contains(lower(q.question), lower(t.term))
  OR (len(t.ttok) > 1 AND list_has_all({_TOK.format(x='q.question')}, t.ttok))""")

O._cte("detected", ("questions", "term_hits"), """
SELECT q.q_id,
  (SELECT term FROM term_hits h WHERE h.q_id = q.q_id AND h.term_kind = 'namespace'
   ORDER BY length(term) DESC, term LIMIT 1) AS ns,
  (SELECT term FROM term_hits h WHERE h.q_id = q.q_id AND h.term_kind = 'name'
   ORDER BY length(term) DESC, term LIMIT 1) AS name
FROM questions q""")

_PROTO = """
SELECT CAST(label AS BIGINT) AS q_id, arg_min(embedding, vec_id) AS qvec
FROM embeddings GROUP BY label"""

_L2 = """list_reduce(list_transform(list_zip(p.qvec, e.embedding),
    lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE))
            * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE))), lambda a, b: a + b)"""

_COS = """1.0 - list_reduce(list_transform(list_zip(p.qvec, e.embedding),
    lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)), lambda a, b: a + b)
  / (sqrt(list_sum(list_transform(p.qvec, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))
     * sqrt(list_sum(list_transform(e.embedding,
                                    lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))))"""


_TF = r"""
SELECT {id} AS id, term, count(*) AS tf
FROM (SELECT {id}, unnest(regexp_split_to_array(lower({text}), '[\s_\-/]+')) AS term FROM {table})
WHERE term <> '' GROUP BY ALL"""

def _text_vectors(table: str, id_: str, text: str) -> tuple:
    return (
        ("tf", _TF.format(id=id_, text=text, table=table)),
        ("idf", f"""
SELECT term, ln(((SELECT count(DISTINCT {id_}) FROM {table}) + 1) / (count(*) + 1)) AS idf
FROM tf GROUP BY term"""),
        ("raw", "SELECT id, term, tf * idf AS raw FROM tf JOIN idf USING (term) "
                "WHERE tf * idf > 0"),
        ("vec", "SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight "
                "FROM raw"))


def _query_vectors(table: str, id_: str, text: str) -> tuple:
    return (
        ("qtf", _TF.format(id=id_, text=text, table=table)),
        ("qraw", "SELECT id, term, tf * idf AS raw FROM qtf JOIN idf USING (term) "
                 "WHERE tf * idf > 0"),
        ("qvec", "SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight "
                 "FROM qraw"))


def _text_hits(k: int) -> str:
    return f"""
SELECT q_id, CAST(row_number() OVER (PARTITION BY q_id ORDER BY s DESC, d) AS INTEGER) AS rank,
       d AS id, s AS score
FROM (SELECT q.id AS q_id, v.id AS d, round(sum(q.weight * v.weight), 9) AS s
      FROM qvec q JOIN vec v USING (term) GROUP BY ALL)
QUALIFY rank <= {k}"""


_DOCUMENT_VECTORS = _text_vectors("documents", "doc_id", "text")

_LIST_KW = ", ".join(f"'{k}'" for k in R.LIST_KEYWORDS)

#: The tiers of a question's context: graph document, named chunk, semantic
#: hits, namespace summary; then the budget.
_TIERS = f"""
SELECT q_id, 0 AS tier, 0 AS pos, context AS document FROM ctx
UNION ALL SELECT q_id, 1, 0, document FROM boost
UNION ALL SELECT q_id, 2, rank, document FROM sem
UNION ALL
SELECT q_id, 3, 1 << 30, 'Datasets in ' || ns || ':' || chr(10) || chr(10)
       || string_agg(summary, chr(10) || chr(10) ORDER BY name, id)
FROM (SELECT d.q_id, d.ns, g.name, g.id,
        array_to_string(list_filter(string_split(g.document, chr(10)),
          lambda l: starts_with(l, 'Dataset:') OR starts_with(l, 'Produced by')
                    OR starts_with(l, 'Namespace:')), chr(10)) AS summary
      FROM detected d JOIN graph_index g ON g.namespace = d.ns AND g.kind = 'dataset'
      WHERE (d.q_id, g.name) NOT IN (SELECT q_id, name FROM sem UNION ALL
                                     SELECT q_id, name FROM boost UNION ALL
                                     SELECT q_id, name FROM named))
GROUP BY q_id, ns"""


def _knn_sql(dist: str, k: int, select: str = "SELECT q_id, rank, vec_id FROM ranked") -> str:
    return O.sql(select, extra=(
        ("protos", _PROTO),
        ("ranked", f"""
SELECT q_id, vec_id, label, rank FROM (
  SELECT p.q_id, e.vec_id, e.label,
    row_number() OVER (PARTITION BY p.q_id ORDER BY {dist}, e.vec_id) AS rank
  FROM protos p, embeddings e) WHERE rank <= {k}""")))


_GCTX_DS = """
SELECT q.q_id, d.key AS node_key, 'dataset' AS kind,
  concat_ws(chr(10), 'Dataset: ' || d.name, 'Namespace: ' || d.namespace,
    'Formato: ' || d.format,
    CASE WHEN d.schema <> '' THEN 'Schema: ' || d.schema END,
    CASE WHEN l.lines IS NOT NULL THEN 'Linaje de columnas:' || chr(10) || l.lines END,
    CASE WHEN p.producers IS NOT NULL THEN 'Producido por: ' || p.producers END,
    CASE WHEN p.consumers IS NOT NULL THEN 'Consumido por: ' || p.consumers END) AS context
FROM best q JOIN lin_datasets d ON d.key = q.key
LEFT JOIN lin_pc p ON p.key = d.key LEFT JOIN lin_lines l ON l.key = d.key"""

_GCTX_JOB = """
SELECT q.q_id, j.key AS node_key, 'job' AS kind,
  concat_ws(chr(10), 'Job: ' || j.name, 'Namespace: ' || j.namespace,
    'Ejecuciones: ' || r.n_ok || ' exitosas, ' || r.n_fail || ' fallidas',
    'Último evento: ' || r.last_type || ' en ' || r.last_time,
    chr(10) || 'Inputs (' || coalesce(bi.n, 0) || '):', bi.b,
    chr(10) || 'Outputs (' || coalesce(bo.n, 0) || '):', bo.b) AS context
FROM best q JOIN lin_jobs j ON j.key = q.key
JOIN (SELECT job_key, count(*) FILTER (WHERE event_type = 'COMPLETE') AS n_ok,
        count(*) FILTER (WHERE event_type = 'FAIL') AS n_fail,
        arg_max(event_type, event_time) AS last_type, max(event_time) AS last_time
      FROM lin_runs GROUP BY job_key) r ON r.job_key = j.key
LEFT JOIN (SELECT e.dst AS key, count(*) AS n,
             string_agg(blk.block, chr(10) ORDER BY blk.name, blk.key) AS b
           FROM lin_edges e JOIN blk ON blk.key = e.src WHERE e.relation = 'feeds'
           GROUP BY e.dst) bi ON bi.key = j.key
LEFT JOIN (SELECT e.src AS key, count(*) AS n,
             string_agg(blk.block, chr(10) ORDER BY blk.name, blk.key) AS b
           FROM lin_edges e JOIN blk ON blk.key = e.dst WHERE e.relation = 'produces'
           GROUP BY e.src) bo ON bo.key = j.key"""

_BLK = """
SELECT d.key, d.name, concat_ws(chr(10), '  - ' || d.name || ' [' || d.namespace || ']',
  CASE WHEN d.schema <> '' THEN '    Schema: ' || d.schema END,
  (SELECT string_agg(line, chr(10) ORDER BY f_time, f_seq, f_fpos) FROM (
     SELECT f_time, f_seq, f_fpos, '    ' || out_field || ' ← ' ||
       string_agg(src_table || '.' || src_field, ', ' ORDER BY s_time, s_seq, s_fpos) AS line
     FROM lin_cl c WHERE c.dataset_key = d.key
     GROUP BY out_field, f_time, f_seq, f_fpos))) AS block
FROM lin_datasets d"""

_BEST = """
SELECT q_id, key FROM (
  SELECT q.q_id, n.key, row_number() OVER (PARTITION BY q.q_id
      ORDER BY length(n.name) DESC, n.name, n.key) AS r
  FROM questions q JOIN lin_nodes n ON n.name <> '' AND contains(lower(q.question), lower(n.name)))
WHERE r = 1"""

_HIST = """
WITH ql AS (SELECT conv_id, max(turn) AS q_turn FROM conversations WHERE role = 'user'
            GROUP BY conv_id),
h AS (SELECT c.conv_id, c.turn, c.role, c.text,
        row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn DESC) AS back
      FROM conversations c JOIN ql ON ql.conv_id = c.conv_id WHERE c.turn < ql.q_turn),
h2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back2
       FROM h WHERE back <= 6 AND role IN ('user', 'assistant')),
ctx AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN text ELSE substr(text, 1, 200) END,
                                   ' ' ORDER BY turn) AS ctx
        FROM h2 WHERE back2 <= 4 GROUP BY conv_id)
SELECT ql.conv_id, concat_ws(' ', ctx.ctx, c.text) AS search
FROM ql JOIN conversations c ON c.conv_id = ql.conv_id AND c.turn = ql.q_turn
LEFT JOIN ctx ON ctx.conv_id = ql.conv_id"""

_PAIRS = """
WITH p AS (SELECT u.conv_id, u.turn AS q_turn, u.text AS question, a.text AS answer
           FROM conversations u JOIN conversations a
             ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
           WHERE u.role = 'user'),
l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY q_turn DESC) AS back FROM p)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY q_turn) AS INTEGER) AS pos,
  question, answer FROM l WHERE back <= 5"""

_CHAT = r"""
WITH p AS (SELECT u.conv_id, u.text AS question, a.text AS answer
           FROM conversations u JOIN conversations a
             ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
           WHERE u.role = 'user'),
e AS (SELECT strftime(DATE '2024-01-01' + CAST(conv_id % 28 AS INTEGER), '%Y-%m-%d')
               AS chat_date,
        '**Question:** ' || question || chr(10) || chr(10) || answer AS entry FROM p)
SELECT chat_date,
  regexp_replace(regexp_extract(entry, '\*\*Question:\*\* ([^\n]+)', 1), '^\s+|\s+$', '', 'g')
    AS question,
  regexp_replace(regexp_extract(entry, '\*\*Question:\*\* [^\n]+([\s\S]*)$', 1),
                 '^\s+|\s+$', '', 'g') AS answer
FROM e WHERE regexp_matches(entry, '\*\*Question:\*\* ([^\n]+)')
  AND regexp_replace(regexp_extract(entry, '\*\*Question:\*\* [^\n]+([\s\S]*)$', 1),
                     '^\s+|\s+$', '', 'g') <> ''"""

QUERIES = {
    "r06_vector_search_l2": (q_vector_search, _knn_sql(_L2, K)),
    "r06_vector_search_cosine": (q_vector_cosine, _knn_sql(_COS, K)),
    "r07_approx_search": (q_approx, None),
    "r08_embed_text": (q_embed_text, None),
    "r08_text_weights": (q_text_weights, O.sql(
        "SELECT id AS doc_id, term, round(weight, 6) AS weight FROM vec", extra=_DOCUMENT_VECTORS)),
    "r08_text_search": (q_text_search, O.sql(f"""
SELECT q_id AS item_id, rank, id AS doc_id, round(score, 6) AS score FROM ({_text_hits(K)})""",
        extra=_DOCUMENT_VECTORS + _query_vectors("benchmark", "item_id", "text"))),
    "r09_detect_entities": (q_detect, O.sql("SELECT * FROM detected", "detected")),
    "u05_tokens_subset": (q_tokens_subset, O.sql(f"""
SELECT DISTINCT q.q_id, t.term_kind, t.term FROM questions q JOIN terms t
  ON len(t.ttok) > 1 AND list_has_all({_TOK.format(x='q.question')}, t.ttok)""",
                                                 "questions", "terms")),
    "r10_graph_context": (q_graph_context, O.sql(
        f"{_GCTX_DS}\nUNION ALL\n{_GCTX_JOB}", "questions", "lin_nodes", "lin_datasets",
        "lin_jobs", "lin_pc", "lin_lines", "lin_runs", "lin_edges", "lin_cl",
        extra=(("best", _BEST), ("blk", _BLK)))),
    "x20_intents": (q_intents, O.sql("""
SELECT q_id,
  list_bool_or(list_transform([{list_kw}], lambda k: contains(lower(question), k))) AS is_list,
  list_bool_or(list_transform([{code_kw}], lambda k: contains(lower(question), k))) AS is_code,
  n, least(n * 2, 40) AS fetch_k,
  array_to_string(string_split_regex(lower(question), '[\\s_\\-/]+'), '|') AS tokens,
  'query: ' || question AS query_text
FROM (SELECT *, CASE WHEN list_bool_or(list_transform([{list_kw}],
                   lambda k: contains(lower(question), k))) THEN 40 ELSE 20 END AS n
      FROM questions)""".format(
        list_kw=", ".join(f"'{k}'" for k in R.LIST_KEYWORDS),
        code_kw=", ".join(f"'{k}'" for k in R.CODE_KEYWORDS)), "questions")),
    "r12_namespace_summary": (q_namespace_summary, O.sql("""
SELECT d.q_id, g.name,
  array_to_string(list_filter(string_split(g.document, chr(10)),
    lambda l: starts_with(l, 'Dataset:') OR starts_with(l, 'Produced by')
              OR starts_with(l, 'Namespace:')), chr(10)) AS summary
FROM detected d JOIN graph_index g ON g.namespace = d.ns AND g.kind = 'dataset'""",
                                                         "detected", "graph_index")),
    "r11_exact_boost": (q_exact_boost, O.sql("""
SELECT d.q_id, d.name, min(g.id) AS id FROM detected d JOIN graph_index g ON g.name = d.name
GROUP BY d.q_id, d.name""", "detected", "graph_index")),
    "w04_first_per_name": (q_first_per_name, _knn_sql(_L2, 40, select="""
SELECT q_id, name, rank, vec_id FROM (
  SELECT q_id, CAST(label AS VARCHAR) AS name, rank, vec_id,
    row_number() OVER (PARTITION BY q_id, label ORDER BY rank, vec_id) AS r FROM ranked)
WHERE r = 1""")),
    "k04_budget": (q_budget, _knn_sql(_L2, 40, select="""
SELECT q_id, tier, pos, vec_id FROM (
  SELECT q_id, CASE WHEN rank = 1 THEN 0 ELSE 2 END AS tier, rank AS pos, vec_id,
    row_number() OVER (PARTITION BY q_id ORDER BY CASE WHEN rank = 1 THEN 0 ELSE 2 END, rank)
      AS i,
    count(*) FILTER (WHERE rank = 1) OVER (PARTITION BY q_id) AS p
  FROM ranked)
WHERE tier < 2 OR i - p <= greatest(12 - p, 4)""")),
    "r13_retrieve": (q_retrieve, None),
    "r13_retrieve_documents": (q_retrieve_documents, O.sql("""
SELECT q_id, tier, pos, document FROM (
  SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY tier, pos) AS i,
    count(*) FILTER (WHERE tier < 2) OVER (PARTITION BY q_id) AS p
  FROM tiers JOIN asked USING (q_id))
WHERE tier < 2 OR i - p <= greatest(n - p, 4)""",
        "questions", "lin_nodes", "lin_datasets", "lin_jobs", "lin_pc", "lin_lines", "lin_runs",
        "lin_edges", "lin_cl", "graph_index", "detected",
        extra=(("best", _BEST), ("blk", _BLK), ("ctx", f"{_GCTX_DS}\nUNION ALL\n{_GCTX_JOB}"),
               ("named", "SELECT DISTINCT c.q_id, n.name FROM ctx c "
                         "JOIN lin_nodes n ON n.key = c.node_key"),
               ("asked", f"""
SELECT q_id, CASE WHEN list_bool_or(list_transform([{_LIST_KW}],
                    lambda k: contains(lower(question), k))) THEN 40 ELSE 20 END AS n
FROM questions"""))
        + _text_vectors("graph_index", "id", "document")
        + _query_vectors("questions", "q_id", "question")
        + (("hits", _text_hits(R.hits_wanted())),
           ("sem", """
SELECT q_id, name, rank, document FROM (
  SELECT h.q_id, g.name, h.rank, g.document,
    row_number() OVER (PARTITION BY h.q_id, g.name ORDER BY h.rank, h.id) AS r
  FROM hits h JOIN asked USING (q_id) JOIN graph_index g ON g.id = h.id
  WHERE h.rank <= least(2 * n, 40))
WHERE r = 1 AND (q_id, name) NOT IN (SELECT q_id, name FROM named)"""),
           ("boost", """
SELECT d.q_id, d.name, arg_min(g.document, g.id) AS document
FROM detected d JOIN graph_index g ON g.name = d.name
WHERE (d.q_id, d.name) NOT IN (SELECT q_id, name FROM sem UNION ALL SELECT q_id, name FROM named)
GROUP BY d.q_id, d.name"""),
           ("tiers", _TIERS)))),
    "r15_history_query": (q_history, _HIST),
    "w05_last_pairs": (q_last_pairs, _PAIRS),
    "s11_chat_log_roundtrip": (q_chat_roundtrip, _CHAT),
    "x21_text_helpers": (q_text_helpers, O.sql("""
SELECT id, substr(document, 1, 200) AS head,
  array_to_string(list_filter(string_split(document, chr(10)),
    lambda l: starts_with(l, 'Dataset:') OR starts_with(l, 'Produced by')
              OR starts_with(l, 'Namespace:')), chr(10)) AS kept,
  'passage: ' || name AS passage
FROM graph_index WHERE kind = 'dataset'""", "graph_index")),
}
