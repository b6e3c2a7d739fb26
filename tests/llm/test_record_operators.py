"""Packing, vector codes and conversation repair: the public library, brute
force over whole tables, and odd rows."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trellis.llm import conversation_repair as repair
from trellis.llm import packing, vector_codes
from trellis.llm.queries import PACK_FILE, QUERIES

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(PACK_FILE))


def expected_pieces(tokenizer, rows, capacity=1024):
    out = Counter()
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out[doc, n, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))] += 1
    return out


def check_packing(got, tokenizer, rows, capacity=1024):
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
                   for r in got) == expected_pieces(tokenizer, rows, capacity)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_of_a_table(spark, tokenizer):
    got = QUERIES["op11_packing"](spark, SF).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet")
            .select("doc_id", "text").collect()]
    n = check_packing(got, tokenizer, rows)
    assert n <= 1.01 * -(-sum(r["length"] for r in got) // 1024) + 1


ODD_TEXTS = [(1, None), (2, ""), (3, " "), (4, "x" * 5000), (5, "word " * 3000), (5, "word " * 3000),
             (None, "no id"), (6, "a<|endoftext|>b"), (7, "中文   x\x1c y ½ ²\n\n\t z"),
             (8, "it's  we'll\r\n  end  "), (9, "😀" * 700)]


@pytest.mark.parametrize("capacity", [1, 7, 1024])
def test_packing_of_odd_rows(spark, tokenizer, capacity):
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in ODD_TEXTS],
                                 "doc_id bigint, text string, part int, length int, rank int")
    path = public_tokenizers.path(PACK_FILE)
    got = packing.pack_documents(docs, path, capacity=capacity, with_ids=True).collect()
    check_packing(got, tokenizer, ODD_TEXTS, capacity)
    assert all(zlib.crc32(struct.pack(f"<{r['length']}I", *r["ids"])) == r["ids_crc32"]
               for r in got)
    assert packing.pack_documents(docs.limit(0), path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60) | st.text(" \n\tab1'sé.", max_size=60))
def test_encoder_equals_the_library(text):
    enc = packing._encoder(open(public_tokenizers.path(PACK_FILE), encoding="utf-8").read())
    ids = enc.ids.tokenizer.encode(text, add_special_tokens=False).ids
    assert enc.encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_long_texts_are_encoded_in_parts(tokenizer, monkeypatch):
    monkeypatch.setattr("trellis.llm.bpe.PART_CHARS", 50)
    enc = packing.PieceEncoder(open(public_tokenizers.path(PACK_FILE), encoding="utf-8").read())
    text = "Some words,  and 中文 spaces \n" * 40
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    assert enc.encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_plan_uses_every_count_and_nears_the_bound():
    rng = np.random.default_rng(5)
    cases = {"even": (rng.integers(1, 1025, 20_000), 1.005), "thirds": (
        np.repeat([341, 342, 513], [3000, 1000, 500]), 1.02), "halves": (
        rng.integers(513, 700, 300), 1.0), "few": (rng.integers(1, 1025, 40), 1.1)}
    for name, (lengths, slack) in cases.items():
        counts = Counter(lengths.tolist())
        plan = packing.plan_sequences(counts, 1024)
        used = Counter()
        for config, times in plan:
            assert sum(n * per for n, per in config) <= 1024 and times > 0
            used.update({n: per * times for n, per in config})
        assert used == counts
        some = np.array(sorted(counts))
        _, bound = packing.solve_weights(some, np.array([counts[int(n)] for n in some], float), 1024)
        least = max(bound, (lengths > 512).sum(), lengths.sum() / 1024)
        assert sum(t for _, t in plan) <= slack * least + 1, name


def test_weights_bound_the_program_from_below():
    lengths, counts = np.array([3, 4, 7]), np.array([4.0, 3.0, 2.0])
    solved, bound = packing.solve_weights(lengths, counts, 10)
    assert bound <= 4.5 + 1e-9          # 7+3 twice, 3+3+4, 4+4: the optimum of the program
    assert all(sum(n * p for n, p in c) <= 10 for c in solved)


# ------------------------------------------------------------- vector codes


def brute_codes(rows, entries=256, rounds=4):
    rows = [r for r in rows if r[1] is not None
            and all(x is not None and np.isfinite(x) for x in r[1])]
    x = np.floor(np.array([r[1] for r in rows], float) * 1024).astype(np.int64)
    width = x.shape[1] // 4
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, tuple(x[i])))
    parts = [x[:, p * width:(p + 1) * width] for p in range(4)]
    books = [p[first[:entries]].copy() for p in parts]
    for n in range(rounds + 1):
        dist = [((p[:, None] - b[None]) ** 2).sum(2) for p, b in zip(parts, books)]
        near = [d.argmin(1) for d in dist]
        if n == rounds:
            break
        for part, book, own in zip(parts, books, near):
            for e in set(own.tolist()):
                book[e] = part[own == e].sum(0) // (own == e).sum()
    error = sum(d.min(1) for d in dist)
    by_label = Counter()
    for r, e in zip(rows, error):
        by_label[r[2]] += int(e)
    digest = hashlib.sha256(",".join(str(int(c)) for b in books for e in b for c in e)
                            .encode()).hexdigest()
    return Counter((r[0], "".join(f"{int(own[i]):02x}" for own in near), int(error[i]),
                    by_label[r[2]], digest) for i, r in enumerate(rows))


def test_vector_codes_of_a_table(spark):
    got = QUERIES["op12_vector_codes"](spark, SF)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet")
            .select("vec_id", "embedding", "label").collect()]
    assert Counter(map(tuple, got.collect())) == brute_codes(rows)


def test_vector_codes_of_odd_rows(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([-1.5, 0.25, 0.2501, 3.0]) for _ in range(12)], rnd.choice([None, 1, 2]))
            for i in range(300)]
    rows += rows[:20] + [(None, [0.5] * 12, None), (900, None, 1), (901, [float("nan")] * 12, 1),
                         (902, [1.0] * 11 + [None], 1), (903, [float("inf")] * 12, 2)]
    schema = "vec_id bigint, embedding array<float>, label int"
    df = spark.createDataFrame(rows, schema)
    clash = df.withColumns({"error": F.lit("x"), "code": F.lit(1), "of": F.lit(2), "ints": F.lit(3)})
    want = brute_codes(rows)
    for table in (df, clash, df.repartition(7)):
        assert Counter(map(tuple, vector_codes.compress_vectors(table).collect())) == want
    assert vector_codes.compress_vectors(df.limit(0)).count() == 0
    short = spark.createDataFrame([(1, [1.0], 1), (2, [], 1), (3, [0.0, 0.0, 0.0, 0.0, 1.0], None)],
                                  schema)
    assert {r["vec_id"]: r["error"] for r in vector_codes.compress_vectors(short).collect()} == {
        1: 0, 2: 0, 3: 0}


def test_large_components_stay_exact(spark):
    rows = [(i, [1e12 * (i % 5), 3.0 * i, -1e12, 0.0], None) for i in range(400)]
    got = vector_codes.compress_vectors(
        spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"))
    assert {r["label_error"] for r in got.collect()} == {
        sum(r["error"] for r in got.collect())}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20), st.integers(1, 30), st.integers(0, 2 ** 32 - 1), st.booleans())
def test_nearest_equals_all_distances(length, entries, seed, big):
    rng = np.random.default_rng(seed)
    x, book = rng.integers(-4, 5, (15, length)), rng.integers(-4, 5, (entries, length))
    if big:
        x, book = x.astype(object) * 10 ** 30, book.astype(object) * 10 ** 30
    index, scaled = vector_codes.nearest(vector_codes.walsh(x), vector_codes.walsh(book))
    dist = ((x[:, None] - book[None]) ** 2).sum(2)
    width = 1 << max(0, length - 1).bit_length()
    assert index.tolist() == dist.argmin(1).tolist()
    assert scaled.tolist() == (dist.min(1) * width).tolist()


def test_transform_is_in_order_of_sign_changes():
    for width in (1, 2, 8, 32):
        signs = vector_codes.walsh(np.eye(width, dtype=np.int64)).T
        assert [int((a[1:] != a[:-1]).sum()) for a in signs] == list(range(width))


# ------------------------------------------------------ conversation repair


def damaged(rows):
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        die = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if die == 1:
            x = ""
        if die == 2:
            x = re.sub("[.!?]", "", x)
        if die == 4:
            r = "user"
        yield from [(c, t, r, x)] * {0: 0, 3: 2}.get(die, 1)


def cheapest(turns, faults):
    """All ways to edit, least cost first and then ASCII-least, by recursion."""
    @lru_cache(None)
    def go(i, state, inserted):
        ways = [(0, "")] if i == len(turns) and state in "a" else []
        after = "a" if state == "u" else "u"
        if inserted < 3:
            cost, tail = go(i, after, inserted + 1)
            ways.append((cost + 3, "I" + tail))
        if i < len(turns):
            cost, tail = go(i + 1, state, 0)
            ways.append((cost + 4, "D" + tail))
            if faults[i] in ("", "truncated"):
                extra, initial = 3 * (faults[i] != ""), turns[i][0][:1]
                if initial and (state, initial) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"),
                                                    ("u", "a")}:
                    cost, tail = go(i + 1, initial, 0)
                    ways.append((cost + extra, "K" + tail))
                cost, tail = go(i + 1, after, 0)
                ways.append((cost + 3 + extra, "R" + tail))
        return min(ways, default=(10 ** 9, ""))

    for i in reversed(range(len(turns))):       # from the end: no deep recursion
        for state in ("", "s", "u", "a"):
            go(i, state, 0)
    return go(0, "", 0)


def brute_repair(rows):
    conversations = {r[0]: [] for r in rows}
    for c, t, r, x in damaged(rows):
        conversations[c].append((t, r, x))
    out = []
    for c, turns in conversations.items():
        turns.sort(key=lambda q: (q[0] is not None, q[0] or 0, q[1].encode(),
                                  hashlib.sha256(q[2].encode()).digest()))
        numbers = {t for t, _, _ in turns if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        turns, seen, faults = [q[1:] for q in turns], set(), []
        for role, text in turns:
            shown = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen
                          else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit = cheapest(tuple(turns), tuple(faults))
        lines, state, left = [], "", iter(turns)
        for edit in audit:
            after = "assistant" if state[:1] == "u" else "user"
            role, text = ("", "") if edit == "I" else next(left)
            if edit != "D":
                state = role if edit == "K" else after
                lines.append(f"{state}:{text}")
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"


def odd_conversations(seed, sizes=(1, 2, 5, 30)):
    rnd = random.Random(seed)
    return [(c, rnd.choice([None, k, k, rnd.randrange(40)]),
             rnd.choice([None, "user", "user", "assistant", "system", "", "tool", "u", "sys"]),
             rnd.choice([None, "", "hi.", "no", "ok! ", "ok! ", "x\n", ". .", "why?\x85"]))
            for c in [None, *range(60)] for k in range(rnd.choice(sizes))]


def test_repair_of_a_table(spark):
    got = QUERIES["op13_conversation_repair"](spark, SF)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, got.collect()), key=str) == brute_repair(rows)


def test_repair_of_odd_rows(spark):
    rows = odd_conversations(1)
    df = spark.createDataFrame(rows, CONVERSATIONS)
    clash = df.withColumns({"n": F.lit(1), "part": F.lit("x"), "audit": F.lit(0), "c": F.lit(9)})
    want = brute_repair(rows)
    for table in (df, clash):
        assert sorted(map(tuple, repair.repair_damaged(table).collect()), key=str) == want
    assert repair.repair_damaged(df.limit(0)).count() == 0
    assert repair.repair_plans(df.limit(0)).count() == 0


def test_one_conversation_over_many_tasks(spark):
    rnd = random.Random(7)
    rows = [(1, k // 2, rnd.choice(["user", "assistant", "user", "tool"]),
             rnd.choice(["same.", f"text {k}", f"text {k}.", ""])) for k in range(400)]
    rows += [(2, 5, "user", "Hi.")] * 50 + [(0, 1, "user", "Hi."), (0, 2, "assistant", "Yes.")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = repair.repair_damaged(spark.createDataFrame(rows, CONVERSATIONS)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, got), key=str) == brute_repair(rows)


def test_repaired_turns_are_the_digested_texts(spark):
    df = spark.createDataFrame(odd_conversations(2), CONVERSATIONS)
    plans = repair.repair_plans(df)
    turns = defaultdict(list)
    for r in sorted(repair.repaired_turns(df, plans).collect(), key=lambda r: r["place"]):
        turns[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for r in repair.repaired_digests(df, plans).collect():
        text = "\n".join(turns[r["conv_id"]])
        assert hashlib.sha256(text.encode()).hexdigest() == r["repaired_sha256"]
        roles = "".join(line[:1] for line in turns[r["conv_id"]])
        assert re.fullmatch("(s?(ua)+)?", roles)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(1, 9)), max_size=6))
def test_runs_cost_what_single_turns_cost(runs):
    symbols, lengths = bytes(s for s, _ in runs), tuple(n for _, n in runs)
    names = ["system", "user", "assistant", "tool"]
    turns = tuple((names[s // 4], "") for s, n in runs for _ in range(n))
    faults = tuple(["", "truncated", "duplicate", "blank"][s % 4] for s, n in runs for _ in range(n))
    m = repair.matrix_of(symbols, lengths)
    cost = min(m[0][j] + repair._END[j] for j in range(4))
    audit, state = repair.unroll(symbols, lengths, repair._END, 0, True)
    assert (cost, audit) == cheapest(turns, faults)
    assert state in (repair.START, repair.ASSISTANT)


def test_schemas_match_the_contracts(spark):
    for name, kinds in {"op11_packing": {"sequence_id": "bigint", "piece": "int"},
                        "op13_conversation_repair": {"cost": "bigint", "gaps": "bigint"}}.items():
        got = dict(QUERIES[name](spark, SF).dtypes)
        assert {k: got[k] for k in kinds} == kinds
