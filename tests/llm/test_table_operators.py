"""Exact dedup, mixing, embeddings, classifiers and the pipeline: oracles, brute
force, held-out accuracy, and odd rows."""

import hashlib
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trellis.llm import embedding_dedup, exact_dedup, mixing, quality, toxicity
from trellis.llm.common import Cuts
from trellis.llm.labelled import fold
from trellis.llm.queries import ORACLE_SQL, QUERIES

SF, SF_LABELS = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "sha string, block int, words int, score double, at int")


def docs(spark, rows):
    """Rows (doc_id, text, source) with columns whose names operators use inside."""
    return spark.createDataFrame(
        [(i, t, "en", s, len(t or ""), "x", 1, 2, 0.5, 3) for i, t, s in rows], SCHEMA)


ODD = [(1, None, "a"), (2, "", "a"), (3, "Same Text", "b"), (7, "sAME text", None),
       (7, "sAME text", None), (5, "same text", "c"), (None, "same TEXT", "c"),
       (8, "É", "a"), (9, "é", "a"), (10, "w " * 30_000, "d"), (None, "no id", "d")]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_LABELS}/{t}.parquet'")
    got = QUERIES[name](spark, SF_LABELS)
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    if name == "op5_mixing":
        rounded = got.withColumn("target", F.round("target", 6))
        assert sorted(map(tuple, rounded.select(names).collect())) == sorted(
            tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in want.fetchall())
    else:
        assert sorted(map(str, map(tuple, got.select(names).collect()))) == sorted(
            map(str, want.fetchall()))


def test_exact_dedup_of_odd_rows(spark):
    got = exact_dedup.duplicate_groups(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    same = [r for r in got if r["text_sha256"] == hashlib.sha256(b"same text").hexdigest()]
    assert len(same) == 5 and {(r["keep_id"], r["group_size"]) for r in same} == {(7, 5)}
    assert sum(r["kept"] for r in same) == 1
    empty = [r for r in got if r["text_sha256"] == hashlib.sha256(b"").hexdigest()]
    assert {(r["keep_id"], r["group_size"]) for r in empty} == {(2, 2)}
    assert {r["group_size"] for r in got if r["doc_id"] in (8, 9, 10)} == {1}
    kept = exact_dedup.drop_exact_copies(docs(spark, ODD))
    assert kept.columns == docs(spark, []).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(
        ["2", "7", "8", "9", "10", "None"])
    assert exact_dedup.duplicate_groups(docs(spark, [])).count() == 0
    assert exact_dedup.drop_exact_copies(docs(spark, [])).count() == 0


def test_a_full_filter_changes_no_decision(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    one, wide = (sorted(map(tuple, exact_dedup.duplicate_groups(table, max_blocks=n).collect()))
                 for n in (1, 16384))
    assert one == wide


def test_only_possibly_repeated_rows_are_flagged(spark):
    rows = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).alias("sha"))
    both = rows.union(rows.limit(20))
    bits, blocks = exact_dedup.repeated_bits(both)
    flagged = exact_dedup.with_maybe_repeated(both, "sha", bits, blocks, "maybe")
    n = flagged.where("maybe").count()
    assert 40 <= n < 300
    assert flagged.where("maybe").join(rows.limit(20), "sha", "left_semi").count() == 40


def plain_targets(sizes):
    """Targets by sharing again and again until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        share = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * share > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else weight[s] * share for s in order}
        capped |= over


def test_mix_meets_targets_and_reruns_agree(spark):
    rows = [(i, "word " * (i % 90), None if i % 10 == 9 else f"s{min(i % 10, 6)}")
            for i in range(600)] + [(1000, "tiny", "small"), (1001, None, "void")]
    table = docs(spark, rows)
    got = mixing.mix_documents(table).collect()
    assert len(got) == len(rows)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    sizes = {}
    for i, s in source.items():
        sizes[s] = sizes.get(s, 0) + size[i]
    targets, taken = plain_targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(targets[s])
        assert r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 2 * 16
    again = mixing.mix_documents(table.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mix_of_odd_rows(spark):
    got = mixing.mix_documents(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert all(r["taken"] == 0 for r in got if r["doc_id"] in (1, 2))
    mixed = mixing.mixed_texts(docs(spark, ODD))
    assert mixed.columns == docs(spark, []).columns
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in mixed.collect())
    assert words == sum(r["taken"] for r in got)
    assert mixing.mix_documents(docs(spark, [])).count() == 0
    assert mixing.mixed_texts(docs(spark, [])).count() == 0


def test_permutation_is_one_to_one(spark):
    for blocks in (1, 2, 3, 64, 1000, 4097):
        rows = mixing.block_keys(spark.range(blocks).select(
            "id", F.lit(3).alias("sid"), F.lit(blocks).cast("bigint").alias("blocks")), 1)
        places = [r[0] for r in rows.select(mixing.permuted("id")).collect()]
        assert sorted(places) == list(range(blocks))


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in rows],
                                 "vec_id bigint, embedding array<float>, label int, "
                                 "vec string, node int")


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 32))
    near = base[rng.integers(0, 40, 400)] + 0.12 * rng.standard_normal((400, 32))
    crowd = base[0] + 0.05 * rng.standard_normal((150, 32))
    data = np.vstack([base, near, crowd, crowd[:30]]).astype(np.float32)
    label = rng.integers(0, 2, len(data))
    label[700:] = 1
    order = rng.permutation(len(data))
    rows = [(int(order[i]), data[i].tolist(), int(label[i])) for i in range(len(data))]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicate_vectors(
        vectors(spark, rows)).collect()}
    unit = data.astype(float) / np.linalg.norm(data.astype(float), axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    want, found = link.sum(), sum(r["n_links"] for r in got.values())
    assert 0.97 * want <= found <= want
    parts = list(range(len(data)))
    changed = True
    while changed:
        low = [min([parts[i], *(parts[j] for j in np.flatnonzero(link[i]))],
                   key=lambda x: order[x]) for i in range(len(data))]
        changed, parts = low != parts, low
    same = sum(got[int(order[i])]["component_id"] == int(order[parts[i]])
               for i in range(len(data)))
    assert same >= 0.97 * len(data)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_embeddings_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None),
            (5, None, 0), (6, [0.0, 0.0], 0), (7, [nan, 1.0], 0), (8, [inf, 0.0], 0),
            (9, [1.0, None], 0), (10, [], 0), (11, [1.0, 0.0, 0.0], 0), (2, [2.0, 0.0], 0),
            (None, [1.0, 0.0], 0), (12, [1e-30, 0.0], 0)]
    got = embedding_dedup.near_duplicate_vectors(vectors(spark, rows)).collect()
    linked = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got}
    assert len(got) == len(rows)
    assert linked[1] == (3, 1) and linked[2] == (3, 1) and linked[12] == (3, 1)
    assert all(linked[i] == (0, i) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11))
    assert linked[None] == (0, None)
    assert embedding_dedup.near_duplicate_vectors(vectors(spark, [])).count() == 0


def test_nn_descent_finds_the_links_of_a_table(spark):
    """The given vectors hold no links, so every tenth gets a near copy and one
    label a hot group of them: many labels, links in each."""
    rows = spark.read.parquet(f"{SF_LABELS}/embeddings.parquet").collect()
    rng = np.random.default_rng(9)
    x = np.array([r["embedding"] for r in rows], float)
    label = np.array([r["label"] for r in rows])
    spread = 0.1 * np.linalg.norm(x, axis=1).mean() / np.sqrt(x.shape[1])
    pick = np.concatenate([np.arange(0, len(x), 10), np.full(200, int(np.argmax(label)))])
    x = np.vstack([x, x[pick] + spread * rng.standard_normal((len(pick), x.shape[1]))])
    x, label = x.astype(np.float32), np.concatenate([label, label[pick]])
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicate_vectors(
        vectors(spark, [(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, label))])
    ).collect()}
    unit = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    want = link.sum(axis=1)
    assert want.sum() > 200 * 200
    assert len(got) == len(x) and all(got[i] <= n for i, n in enumerate(want))
    assert sum(got.values()) >= 0.98 * want.sum()
    single = want == 1          # the hot group must not carry the figure
    assert sum(got[int(i)] for i in np.flatnonzero(single)) >= 0.95 * single.sum()


def test_a_crowded_group_is_compared_whole():
    x = np.eye(60, 64)
    x[50] = x[40] + 0.05 * x[41]
    batch = pa.RecordBatch.from_pydict({
        "grp": np.zeros(60, np.int64), "node": np.arange(60), "vec": x.tolist(),
        "fresh": np.ones(60, bool), "floor": np.full(60, -2.0), "dice": np.zeros(60, np.int64)})
    got = [r for b in embedding_dedup._compared(iter([batch]), 12, 0.93) for r in b.to_pylist()]
    assert {(r["v"], r["u"]) for r in got if r["sim"] >= 0.93} >= {(40, 50), (50, 40)}


def clustered(seed):
    """Vectors of two labels: a hot cluster, pairs among many others."""
    rng = np.random.default_rng(seed)
    hot = rng.standard_normal(48) + 0.12 * rng.standard_normal((700, 48))
    base = rng.standard_normal((200, 48))
    pairs = base[:60] + 0.1 * rng.standard_normal((60, 48))
    data = np.vstack([hot, base, pairs]).astype(np.float32)
    label = np.array([0] * 700 + [1] * 260)
    unit = data / np.linalg.norm(data.astype(float), axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    return [(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(data, label))], link


def test_links_missed_by_all_rounds_are_found_by_whole_labels(spark, monkeypatch):
    rows, link = clustered(5)
    monkeypatch.setattr(embedding_dedup.NNDescent, "_compare", lambda self, members:
                        spark.createDataFrame([], embedding_dedup._PAIRS))
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicate_vectors(
        vectors(spark, rows), retries=0).collect()}
    assert [got[i]["n_links"] for i in range(len(rows))] == link.sum(axis=1).tolist()
    assert all(got[i]["component_id"] == got[int(j)]["component_id"]
               for i, j in zip(*np.nonzero(link)))


def test_audit_sees_a_small_label_beside_a_hot_cluster(spark):
    rows, link = clustered(6)
    near = link.sum(axis=1)
    near[700:] = 0
    counts = spark.createDataFrame(
        [(i, y, v, 1, int(n)) for (i, v, y), n in zip(rows, near)],
        "node bigint, label int, vec array<float>, copies bigint, near bigint")
    assert embedding_dedup.audit(counts, 0.93, 256) < 0.1


def test_a_dense_cluster_keeps_no_list_of_all_its_links(spark):
    rows, link = clustered(7)
    nodes = spark.createDataFrame(
        [(i, v, y, len(v)) for i, v, y in rows],
        "node bigint, vec array<float>, label int, dim int")
    descent = embedding_dedup.NNDescent(nodes, Cuts(spark, "test"), 0.93, 12, 48)
    descent.seed([0, 1])
    descent.refine()
    assert descent.graph.count() <= 48 * len(rows)
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicate_vectors(
        vectors(spark, rows)).collect()}
    assert [got[i] for i in range(len(rows))] == link.sum(axis=1).tolist()


def test_saturated_lists_grow(spark):
    """Clusters of 30 fill lists of 4 with links: these grow until every link of
    a cluster has a place; lists of vectors without links stay as they are."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((6, 32))
    data = np.vstack([c + 0.05 * rng.standard_normal((30, 32)) for c in centres]
                     + [rng.standard_normal((120, 32))]).astype(np.float32)
    nodes = spark.createDataFrame([(i, v.tolist(), 0, 32) for i, v in enumerate(data)],
                                  "node bigint, vec array<float>, label int, dim int")
    unit = data / np.linalg.norm(data.astype(float), axis=1, keepdims=True)
    link = unit @ unit.T >= 0.93
    np.fill_diagonal(link, False)
    found = {}
    for most in (4, 64):
        descent = embedding_dedup.NNDescent(nodes, Cuts(spark, "test"), 0.93, 4, most)
        descent.seed([0, 1])
        for _ in range(8):
            if not descent.refine():
                break
        found[most] = descent.graph.where("sim >= 0.93").count()
        rooms = {r["v"]: r["room"] for r in descent.rooms.collect()}
        assert set(rooms) == (set(range(180)) if most > 4 else set())
        assert max(descent.grown) == (180 if most > 4 else 0)
    assert all(n <= 64 for n in rooms.values())
    assert found[4] <= 4 * len(data) and found[64] >= 0.99 * link.sum()


def judged(spark, name, label):
    labels = spark.read.parquet(f"{SF_LABELS}/labels.parquet")
    got = QUERIES[name](spark, SF_LABELS)
    assert got.count() == spark.read.parquet(f"{SF_LABELS}/documents.parquet").count()
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    return np.mean([r["predicted"] == r[label] for r in rows])


def test_quality_on_held_out_labels(spark):
    assert judged(spark, "op3_quality", "quality") >= 0.93


def test_toxicity_on_held_out_labels(spark):
    assert judged(spark, "op4_toxicity", "toxic") >= 0.93


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_classifiers_without_labels_and_odd_rows(spark, score):
    table = docs(spark, ODD)
    labels = spark.createDataFrame([(3, 1, 1), (None, 0, 0), (5, None, None)],
                                   "doc_id bigint, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        got = score(table, known).collect()
        assert len(got) == len(ODD)
        assert len({r["score"] for r in got}) == 1          # one class: its share, for all
    assert score(docs(spark, []), labels).count() == 0


def test_held_out_labels_are_not_learnt(spark):
    table = spark.read.parquet(f"{SF_LABELS}/documents.parquet")
    labels = spark.read.parquet(f"{SF_LABELS}/labels.parquet")
    turned = labels.withColumn("quality", F.when(
        fold(F.col("doc_id"), 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (sorted((r["doc_id"], r["score"]) for r in
                       quality.score_quality(table, x).collect()) for x in (labels, turned))
    assert one == two


def test_obfuscated_insults_count():
    plain = toxicity.features("you are an idiot today", {}, {})
    masked = toxicity.features("you are an 1d10t today", {}, {})
    at = toxicity.FEATURES.index
    assert plain[at("insults")] > 0 and masked[at("insults")] > 0
    assert plain[at("near_second_person")] > 0
    assert masked[at("obfuscated")] > 0 and plain[at("obfuscated")] == 0
    assert toxicity.features("", {}, {}) == [0.0] * len(toxicity.FEATURES)


def test_pipeline_stages_take_effect(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "simhash dedup", "mixing", "bpe"]
    table = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r["doc_id"] for r in QUERIES["op4_toxicity"](spark, SF).collect() if r["predicted"]}
    stage = dict(corpus_pipeline.STAGES)
    clean = stage["toxicity"](spark, table, SF)
    assert clean.columns == table.columns
    ids = {r["doc_id"] for r in table.collect()}
    assert {r["doc_id"] for r in clean.collect()} == ids - toxic
    unique = stage["exact dedup"](spark, clean, SF)
    kept = {r["doc_id"] for r in exact_dedup.duplicate_groups(clean).where("kept").collect()}
    assert {r["doc_id"] for r in unique.collect()} == kept
    single = stage["simhash dedup"](spark, unique, SF)
    mixed = stage["mixing"](spark, single, SF)
    assert mixed.columns == table.columns
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_documents(single).collect()}
    rows = {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert {i: len(t.split()) for i, t in rows.items()} == {i: n for i, n in taken.items() if n}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(out) == set(rows)
    assert all(out[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
               and out[i]["n_tokens"] == len(out[i]["token_ids"]) for i, t in rows.items())


def test_block_length_is_one_for_every_size(spark):
    size = 32 * 14_064                                      # 18 million words in all
    table = docs(spark, [(i, "w", f"s{i % 2}") for i in range(40)]).withColumn(
        "text", F.repeat(F.lit("w "), size))
    taken = [r["taken"] for r in mixing.mix_documents(table).collect()]
    assert sum(taken) == 40 * size and all(n % 16 == 0 for n in taken)
    assert any(n % 32 for n in taken)                       # documents begin at blocks of 32


def test_hash_ranges_do_not_change_the_mix(spark, monkeypatch):
    table = docs(spark, [(i, "some words " * (i % 40), f"s{i % 3}") for i in range(400)])
    plain = sorted(map(tuple, mixing.mix_documents(table).collect()))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 0.01)
    assert sorted(map(tuple, mixing.mix_documents(table).collect())) == plain
    assert sorted(map(tuple, mixing.mix_documents(table, shard_slots=2).collect())) == plain
