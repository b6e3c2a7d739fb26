"""Joins of rows that are many times their written size must not pass through the driver."""

from __future__ import annotations

from trellis.operators import codematch as C
from trellis.operators import retrieve as R
from trellis.session import cut_lineage

from conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def questions(spark):
    rows = [(f"q{i}", f"que rompe si cambio ds_{i}") for i in range(50)]
    return cut_lineage(spark.createDataFrame(rows, "q_id string, question string"))


def test_grams_of_questions_are_not_broadcast(spark):
    terms = cut_lineage(spark.createDataFrame(
        [("name", f"ds_{i}") for i in range(50)] + [("name", "si"), ("name", "cambio ds 7")],
        "term_kind string, term string"))
    found = R.contained_terms(questions(spark), terms).unionByName(
        R.token_subset_terms(questions(spark), terms))
    assert "Broadcast" not in plan(found)
    got = {tuple(r) for r in found.collect()}
    assert ("q7", "name", "cambio ds 7") in got and ("q12", "name", "ds_1") in got
    assert sum(t == "si" for _, _, t in got) == 50


def test_detected_names_are_not_broadcast(spark):
    index = cut_lineage(spark.createDataFrame(
        [(f"id{i}", "dataset", f"ds_{i}", "lake", f"Dataset: ds_{i}") for i in range(50)],
        "id string, kind string, name string, namespace string, document string"))
    det = R.detect_entities(questions(spark), index)
    assert "Broadcast" not in plan(det)
    assert "Broadcast" not in plan(R.namespace_summary(index, cut_lineage(det)))
    assert {r["q_id"]: r["name"] for r in det.collect()} == {f"q{i}": f"ds_{i}" for i in range(50)}


def test_deletion_variants_are_not_broadcast(spark):
    names = [(f"etl_user_{i}",) * 2 for i in range(60)]
    left = cut_lineage(spark.createDataFrame(names, "lkey string, ls string"))
    right = cut_lineage(spark.createDataFrame(names, "rkey string, rs string"))
    pairs = C.near_pairs(left, right)
    assert "Broadcast" not in plan(pairs)
    assert "Broadcast" not in plan(C.fuzzy_candidates(left, right, 0.75))
    assert sum(r["lkey"] == r["rkey"] for r in pairs.collect()) == 60


def test_hits_by_dimensions_equal_the_full_search(spark):
    import random
    rnd = random.Random(5)

    def vec(dims=40):
        out = [0.0] * dims
        for i in rnd.sample(range(1, dims), rnd.randint(1, 4)):
            out[i] = float(rnd.choice([0.25, 0.5, 1.0, 3.0]))
        if rnd.random() < 0.9:
            out[0] = 0.1
        return out
    index = cut_lineage(spark.createDataFrame(
        [(f"id{i % 290:03d}", vec()) for i in range(300)], "id string, vec array<double>"))
    asked = [(f"q{i}", vec()) for i in range(30)] + [("q_none", [0.0] * 39 + [1e-3])]
    queries = cut_lineage(spark.createDataFrame(asked, "q_id string, qvec array<double>"))
    full = R.vector_search(index, queries, R.hits_wanted(), metric="cosine", id_col="id",
                           vec_col="vec").select("q_id", "rank", "id")
    for share in (0.05, 0.0, 1.0):
        assert sorted(map(tuple, R.vector_hits(index, queries, common_share=share).collect())) \
            == sorted(map(tuple, full.collect()))


def test_chains_from_the_sources_alone(spark):
    from trellis.operators import graph_ops as G
    edges = []
    for i in range(60):                     # a long chain with a cycle and side branches
        edges += [(f"d{i}", f"j{i}", "feeds"), (f"j{i}", f"d{i + 1}", "produces")]
    edges += [("j40", "d7", "produces"), ("s", "j5", "feeds"), ("j20", "x", "produces")]
    keys = sorted({k for a, b, _ in edges for k in (a, b)})

    class Graph:
        pass
    g = Graph()
    g.nodes = cut_lineage(spark.createDataFrame(
        [(k, "job" if k.startswith("j") else "dataset") for k in keys], "key string, kind string"))
    g.edges = cut_lineage(spark.createDataFrame(edges, "src string, dst string, relation string"))
    roots = spark.createDataFrame([("d0",), ("s",)], "key string")
    whole = {tuple(r) for r in G.reach(g).collect() if r["root_key"] in ("d0", "s")}
    assert {d for _, _, d in whole} == set(range(1, 121))
    for few in (1, 5, 1000):
        assert {tuple(r) for r in G.reach_from(g, roots, few).collect()} == whole


def written_inputs(df) -> str:
    return " ".join(df.inputFiles())


def test_fuzzy_match_reads_its_inputs_once(spark):
    from trellis.plans.code_queries import q_fuzzy
    assert "events.parquet" not in written_inputs(q_fuzzy(spark, SF_SMALL))


def test_named_nodes_and_detected_names_end_their_plan(spark):
    from trellis.plans.retrieve_queries import q_exact_boost, q_graph_context
    for query in (q_graph_context, q_exact_boost):
        found = plan(query(spark, SF_SMALL))
        assert "Broadcast" not in found and "Generate" not in found


def fuzzy_inputs(spark, n=200):
    names = [(f"etl_user_{i}",) * 2 for i in range(n)]
    return (cut_lineage(spark.createDataFrame(names, "lkey string, ls string")),
            cut_lineage(spark.createDataFrame(names, "rkey string, rs string")))


def test_tasks_of_the_fuzzy_match_grow_with_names_and_pairs(spark, monkeypatch):
    left, right = fuzzy_inputs(spark)
    want = {tuple(r) for r in C._scored(C.near_pairs(left, right), 0.75).collect()}
    monkeypatch.setattr(C, "NAMES_PER_TASK", 10)
    monkeypatch.setattr(C, "PAIRS_PER_TASK", 100)
    pairs = C.near_pairs(left, right)
    assert "hashpartitioning(variant" in plan(pairs) and ", 40), REPARTITION_BY_NUM" in plan(pairs)
    scored = C._scored(pairs, 0.75)
    tasks = -(-pairs.count() // 100)
    assert f", {tasks}), REPARTITION_BY_NUM" in plan(scored)
    assert {tuple(r) for r in scored.collect()} == want


def test_similarity_is_computed_once_a_pair(spark):
    left, right = fuzzy_inputs(spark, 20)
    scored = C._scored(C.near_pairs(left, right), 0.75)
    assert plan(scored).count("ArrowEvalPython") == 1


def written(monkeypatch, *modules) -> dict:
    """The tables that the modules cut from now on, by name."""
    found: dict = {}
    for module in modules:
        def cut(df, name="cut", real=module.cut_lineage):
            found.setdefault(name, []).append(out := real(df, name))
            return out
        monkeypatch.setattr(module, "cut_lineage", cut)
    return found


def test_vector_hits_write_no_pairs_but_the_best(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector
    from trellis.operators import text_vectors as T
    index = cut_lineage(spark.createDataFrame(
        [(f"id{i:04d}", [1.0, 0.0, float(i % 7), float(i % 30 == 0)]) for i in range(1200)]
        + [("blank", [0.0] * 4)], "id string, vec array<double>"))
    asked = [(f"q{i}", [0.0, 0.0, 0.0, 2.0] if i % 2 else [0.5, 0.0, 1.0, 3.0]) for i in range(50)]
    queries = cut_lineage(spark.createDataFrame(asked, "q_id string, qvec array<double>"))
    texts = {r["id"]: r["vec"] for r in index.collect()}

    def best(q):
        dot = {x: sum(a * b for a, b in zip(q, v)) / (sum(b * b for b in v) ** 0.5 or 1)
               for x, v in texts.items()}
        return sorted(texts, key=lambda x: (x == "blank", -round(dot[x], 9), x))[:R.hits_wanted()]
    want = {(q_id, i + 1, x) for q_id, q in asked for i, x in enumerate(best(q))}
    found = written(monkeypatch, R, T)
    vectors = [(index.withColumn("vec", array_to_vector("vec")),
                queries.withColumn("qvec", array_to_vector("qvec"))), (index, queries)]
    monkeypatch.setattr(T, "TEXTS_PER_BLOCK", 500, raising=False)
    for passes in (32_768, 1):
        monkeypatch.setattr(T, "VECTORS_PER_PASS", passes, raising=False)
        for x, q in vectors[-1:] if passes == 1 else vectors:
            assert {tuple(r) for r in R.vector_hits(x, q).collect()} == want
    assert max(t.count() for tables in found.values() for t in tables) <= len(texts)


def test_documents_come_to_the_rows_that_stay(spark, monkeypatch):
    from trellis.plans.retrieve_queries import q_retrieve
    found = written(monkeypatch, R)
    q_retrieve(spark, SF_SMALL).collect()
    assert "document" not in found["semantic"][0].columns
    # of the questions' substrings those that are some name's rarest
    rarest = {r[0] for t in found["term_anchors"] for r in t.select("gram").collect()}
    grams = [r for t in found["question_grams"] for r in t.select("gram").collect()]
    assert grams and {r[0] for r in grams} <= rarest


def test_chains_are_walked_in_tasks_and_in_rounds_alike(spark, monkeypatch):
    from trellis.operators import graph_ops as G
    from trellis.operators.lineage_graph import LineageGraph
    edges = []
    for i in range(40):                     # two chains that meet, a cycle, a node alone
        edges += [(f"d{i}", f"j{i}", "feeds"), (f"j{i}", f"d{i + 1}", "produces")]
    edges += [("j30", "d9", "produces"), ("s", "j12", "feeds"), ("t", "j2", "feeds")]
    data = [(k, f"name of {k}") for k in {x for a, b, _ in edges for x in (a, b)} | {"alone"}]
    schema = "key string, namespace string, name string"
    g = LineageGraph(*(cut_lineage(spark.createDataFrame(
        [(k, "ns", n) for k, n in data if k.startswith("j") == jobs], schema)) for jobs in (False, True)),
        cut_lineage(spark.createDataFrame(edges, "src string, dst string, relation string")), None, None)
    after: dict = {}
    for a, b, _ in edges:
        after.setdefault(a, set()).add(b)
    want = set()
    for root in ("d0", "s", "t"):
        level, seen, depth = {root}, {root}, 0
        while level := {y for x in level for y in after.get(x, ())} - seen:
            depth, seen = depth + 1, seen | level
            want |= {(root, y, depth, "job" if y[0] == "j" else "dataset", f"name of {y}")
                     for y in level}

    def rows():
        return sorted(map(tuple, G.transitive_chain(g).drop("truncated").select(
            "root_key", "node_key", "depth", "kind", "name").collect()))
    monkeypatch.setattr(G, "EDGES_SENT", 0, raising=False)
    monkeypatch.setattr(G, "NODES_SENT", 0, raising=False)
    assert rows() == sorted(want)
    monkeypatch.undo()
    rounds: list = []
    monkeypatch.setattr(G, "scratch_path", lambda *a: rounds.append(a))
    for places in (1, 1 << 26):             # one root at a time, all at once
        monkeypatch.setattr(G, "PLACES", places, raising=False)
        assert rows() == sorted(want)
    assert not rounds


def test_questions_with_few_rare_hits_share_the_search_of_common_terms(spark, monkeypatch):
    from trellis.operators import text_vectors as T
    texts = cut_lineage(spark.createDataFrame(
        [(f"id{i:03d}", f"lake ds {i % 60} w{i % 7} " + "ds " * (i % 5)) for i in range(240)]
        + [("other", "nothing of it")], "id string, text string"))
    asked = cut_lineage(spark.createDataFrame(
        [(f"q{i}", f"lake ds {i}") for i in range(60)] + [("none", "zzz"), ("common", "ds lake")],
        "q_id string, text string"))
    index = T.TextIndex(texts, "id")
    unit, want = {}, set()
    for r in index.postings.collect():
        unit.setdefault(r["id"], {})[r["term"]] = r["weight"]
    weights: dict = {}
    for r in index.weigh(asked, "q_id").collect():
        weights.setdefault(r["q_id"], {})[r["term"]] = r["weight"]
    for q, terms in weights.items():
        score = {x: round(sum(w * v.get(t, 0.0) for t, w in terms.items()), 9) for x, v in unit.items()}
        best = sorted((x for x in score if score[x] > 0), key=lambda x: (-score[x], x))[:12]
        want |= {(q, i + 1, x) for i, x in enumerate(best)}
    found = written(monkeypatch, T)
    monkeypatch.setattr(T, "TEXTS_PER_BLOCK", 50, raising=False)
    for passes in (32_768, 1):
        monkeypatch.setattr(T, "VECTORS_PER_PASS", passes, raising=False)
        hits = T.TextIndex(texts, "id").search(asked, "q_id", 12)
        assert {(r["q_id"], r["rank"], r["id"]) for r in hits.collect()} == want
    # 62 queries leave few vectors of common terms to search
    assert all(t.count() <= 4 for t in found["alike"])


def test_texts_are_numbered_and_stored_without_further_copies(spark, monkeypatch, tmp_path):
    from trellis.operators import chunks as K
    from trellis.sources import keyed
    body = "\n## ".join(f"part {i} " + "x" * 60 for i in range(3))
    md = cut_lineage(spark.createDataFrame(
        [("b.md", body), ("a.md", "short"), ("a.md", body + " one"), ("a.md", body + " two")],
        "path string, content string"))
    found = written(monkeypatch, K, keyed)
    new = K.knowledge_chunks(md)
    rows = sorted(map(tuple, new.select("id", "source").collect()),
                  key=lambda r: int(r[0].rpartition(":")[2]))
    assert rows == [(f"knowledge::{s}::{i}", s) for i, s in enumerate(["a.md"] * 6 + ["b.md"] * 3)]
    texts = {r["document"] for r in new.collect()}
    assert len(texts) == 3 + 2 and sum("two" in t for t in texts) == 1
    assert all("text" not in t.columns for name in ("ordinal_rows", "ordinal") for t in found[name])

    store = keyed.KeyedTable(spark, str(tmp_path), ["id"], 8)
    schema = "id string, document string"
    first = spark.createDataFrame([(f"c{i}", f"text {i}") for i in range(60)] + [("n", None)], schema)
    assert store.replace(first.limit(0)) == [] and store.read() is None
    assert store.replace(first) == list(range(8)) and store.replace(first) == []
    change = spark.createDataFrame([("c7", "other"), ("c8", "text 8"), ("n", None)], schema)
    assert len(store.replace(change)) == 1
    want = {r["id"]: r["document"] for r in first.collect()} | {"c7": "other"}
    assert {r["id"]: r["document"] for r in store.read().collect()} == want
    assert store.read().count() == 61 and "keyed_new" not in found
