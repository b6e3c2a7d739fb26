"""Text operators against brute force: BPE, edit-aware counts, SimHash, URL
rules, and suffix repeats, with null, empty, long, tied and repeated rows."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from trellis.llm import bpe, simhash_dedup, suffix_dedup, token_counts, url_filter
from trellis.llm.queries import QUERIES, RANK_FILE

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path(RANK_FILE)
SCHEMA = "doc_id bigint, text string, source string, fp int, n_tokens string, block string"


def docs(spark, rows):
    """Rows (doc_id, text) with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "s", 1, "x", "y") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def encoder():
    with open(RANKS, "rb") as f:
        return bpe.Encoder(f.read())


@pytest.fixture(scope="module")
def library(encoder):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


def scrambled(rnd, n):
    return "".join(rnd.choice(["a", "b", "'re", " ", "  ", "\n", "\x1c", "\x85", "9", "²", "é",
                               "ª", "我", "e", "_", "!", "the", chr(rnd.randrange(0x250))])
                   for _ in range(n))


def test_pattern_is_the_public_one():
    assert bpe.PATTERN == public_tokenizers.PATTERN


def test_encoding_equals_the_library(encoder, library):
    rnd = random.Random(1)
    for _ in range(3000):
        text = scrambled(rnd, rnd.randrange(20))
        assert encoder.encode(text) == library.encode_ordinary(text)
        assert encoder.decode(encoder.encode(text)) == text.encode()
    piece = "a" * 5000                  # one long piece
    assert encoder.encode(piece) == library.encode_ordinary(piece)


def test_long_texts_are_encoded_in_parts(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "PART_CHARS", 50)
    rnd = random.Random(2)
    for _ in range(200):
        text = scrambled(rnd, 400)
        parts = list(bpe.parts_of(text))
        assert "".join(parts) == text
        assert [i for p in parts for i in encoder.encode(p)] == library.encode_ordinary(text)


def test_memo_is_bounded(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 100)
    memo = bpe.Memo(encoder.ranks)
    for i in range(1000):
        assert memo[f" word{i}"] == bpe.merge(f" word{i}".encode(), encoder.ranks)
    assert len(memo) <= 100 and len(memo.old) <= 101


def test_op10_over_the_whole_table(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in
             spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op10_bpe"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_encode_decode_round_trip_and_edges(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "x y"), (3, "é 我 \n" * 1000)]
    encoded = bpe.encode_documents(docs(spark, rows), RANKS)
    got = sorted(((r["doc_id"], r["text"]) for r in
                  bpe.decode_documents(encoded, RANKS).collect()), key=str)
    assert got == sorted(((i, t or "") for i, t in rows), key=str)
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in
            encoded.where("doc_id IN (1, 2)").collect()} == {(0, empty, empty)}
    assert bpe.encode_documents(docs(spark, []), RANKS).count() == 0


def edited(text, edits):
    limit = len(text)
    for i in sorted(range(len(edits)), key=lambda i: (edits[i]["start"], i), reverse=True):
        start = min(max(edits[i]["start"], 0), limit)
        stop = min(start + edits[i]["removed"], limit)
        text, limit = text[:start] + edits[i]["inserted"] + text[stop:], start
    return text


def test_edits_equal_full_encoding(encoder, library):
    rnd = random.Random(3)
    for _ in range(1500):
        text = scrambled(rnd, rnd.choice([0, 10, 300]))
        edits = [dict(start=rnd.randrange(-1, len(text) + 3), removed=rnd.randrange(6),
                      inserted=scrambled(rnd, rnd.randrange(4))) for _ in range(rnd.randrange(5))]
        tree = token_counts.PieceTree.of(text, encoder)
        assert tree.n_tokens == len(library.encode_ordinary(text))
        new, _ = token_counts.apply_edits(text, tree, edits, encoder)
        assert new == edited(text, edits)
        assert tree.n_tokens == len(library.encode_ordinary(new))
        assert tree.pieces() == token_counts.PieceTree.of(new, encoder).pieces()


def test_an_edit_reencodes_its_surroundings_only(encoder):
    text = "some words of a text " * 5000
    tree = token_counts.PieceTree.of(text, encoder)
    _, work = token_counts.apply_edits(
        text, tree, [dict(start=50_000, removed=3, inserted="x")], encoder)
    assert work < 40


def test_op1_and_stored_trees(spark, library):
    table = spark.read.parquet(f"{SF}/documents.parquet").withColumn(
        "edits", token_counts.cleaning_edits())
    rows = {r["doc_id"]: r for r in table.collect()}
    for r in QUERIES["op1_token_counts"](spark, SF).collect():
        text = rows[r["doc_id"]]["text"] or ""
        new = edited(text, [e.asDict() for e in rows[r["doc_id"]]["edits"]])
        assert r["n_tokens"] == len(library.encode_ordinary(text))
        assert r["n_tokens_edited"] == len(library.encode_ordinary(new))
        assert r["n_chars_edited"] == len(new)
    first = token_counts.count_with_edits(table.limit(20), RANKS, keep_trees=True)
    again = token_counts.count_with_edits(
        first.withColumn("edits", F.expr("array(named_struct('start', 5, 'removed', 2, "
                                         "'inserted', 'new words'))")), RANKS, keep_trees=True)
    for r in again.collect():
        assert r["n_tokens_edited"] == len(library.encode_ordinary(r["text"]))


def test_counts_of_odd_rows(spark):
    rows = docs(spark, [(1, None), (2, ""), (2, ""), (None, "a b")]).withColumn(
        "edits", F.lit(None).cast(token_counts.EDITS))
    got = token_counts.count_with_edits(rows, RANKS).collect()
    assert sorted(r["n_tokens"] for r in got) == [0, 0, 0, 2]
    assert all(r["n_tokens"] == r["n_tokens_edited"] and r["chars_reencoded"] == 0 for r in got)


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64)
               if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(points):
    """doc_id -> smallest doc_id reachable, by trying all pairs."""
    points = sorted(points)
    parent = {i: i for i, _ in points}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for n, (i, x) in enumerate(points):
        for j, y in points[:n]:
            if (x ^ y).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i, _ in points}


def test_op7_equals_all_pairs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r["doc_id"], plain_fingerprint(r["text"])) for r in rows]
    parts = plain_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"])
           for r in QUERIES["op7_simhash_dedup"](spark, SF).collect()}
    assert got == {i: (f"{x:016x}", parts[i]) for i, x in prints}


@pytest.mark.parametrize("max_posting", [1, 64])
def test_fingerprint_links_connect_what_all_pairs_connect(spark, max_posting):
    """With max_posting=1 every posting goes the way of crowded ones."""
    rnd = random.Random(4)
    points = [rnd.getrandbits(64) for _ in range(20)]
    while len(points) < 90:
        points.append(rnd.choice(points) ^ sum(1 << b for b in rnd.sample(
            range(64), rnd.randrange(1, 6))))
    points = sorted(set(points))
    signed = [x - (1 << 64) if x >> 63 else x for x in points]
    cuts = simhash_dedup.Cuts(spark, "test")
    fps = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    pairs = [(r["a"], r["b"]) for r in simhash_dedup.close_pairs(
        fps, cuts, max_posting=max_posting).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in pairs)
    place = {x: i for i, x in enumerate(signed)}
    parent = list(range(len(signed)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in pairs:
        x, y = sorted((root(place[a]), root(place[b])))
        parent[y] = x
    want = plain_components(list(enumerate(points)))
    assert {i: root(i) for i in range(len(signed))} == want


def test_fingerprint_blocks_cover_every_five_positions():
    from itertools import combinations
    assert all(any(set(b) <= set(c) for b in simhash_dedup.BLOCKS)
               for c in combinations(range(8), 5))


def test_simhash_of_odd_rows(spark):
    rows = [(4, None), (3, " \t"), (9, "one"), (9, "one"), (8, "ONE"), (None, "one"),
            (7, "x " * 40_000)]
    got = simhash_dedup.near_duplicate_components(docs(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in got) == [
        (0, 8), (3, 3), (4, 3), (7, 7), (8, 8), (9, 8), (9, 8)]
    kept = simhash_dedup.drop_near_copies(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 3, 7, 8]
    assert simhash_dedup.near_duplicate_components(docs(spark, [])).count() == 0


def test_url_rules_and_terms(spark):
    rows = [(1, None), (2, "no scheme/en/"), (3, "http://A.example.COM/en/x?q"),
            (4, "https://www.example.com/en/"), (5, "http://example.com"), (6, "ftp://a.net/es/#x"),
            (7, "http://anet/es/"), (8, "http://casino.org/"), (9, "http://casinos.org/"),
            (10, "http://free.org/win"), (11, "http://free.org/free"), (11, "http://free.org/free"),
            (None, "http://x.org?u=http://b.com/")]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in rows],
                                  "page_id bigint, url string, host string, rule string")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"])
           for r in url_filter.judge_urls(pages).collect()}
    assert got == {
        (1, "", "", None, "allow"), (2, "", "", None, "allow"),
        (3, "a.example.com", "/en/x", "example.com/en/", "block"),
        (4, "www.example.com", "/en/", "www.example.com/en/", "allow"),
        (5, "example.com", "", None, "allow"), (6, "a.net", "/es/", "net/es/", "block"),
        (7, "anet", "/es/", None, "allow"), (8, "casino.org", "/", None, "block"),
        (9, "casinos.org", "/", None, "allow"), (10, "free.org", "/win", None, "block"),
        (11, "free.org", "/free", None, "allow"), (None, "x.org", "", None, "allow")}
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    kept = url_filter.keep_allowed(pages)
    assert kept.schema == pages.schema
    assert sorted(map(str, kept.collect())) == sorted(
        str(r) for r, verdict in ((r, url_filter.judge_urls(
            spark.createDataFrame([r], pages.schema)).first()["verdict"])
            for r in pages.collect()) if verdict == "allow")
    shared = spark.createDataFrame(
        [(1, "http://a.net/es/", "n"), (1, "http://ok.org/", None), (None, "http://ok.org/", "x"),
         (None, None, None), (2, "http://ok.org/", "x"), (2, "http://ok.org/", "x")],
        "page_id bigint, url string, verdict string")
    assert sorted(map(str, url_filter.keep_allowed(shared).collect())) == sorted(
        map(str, shared.collect()[1:]))
    assert url_filter.keep_allowed(shared.limit(0)).count() == 0


def plain_repeats(rows, length):
    """Multiset of (doc_id, bytes, removed, spans, digest) by trying every window."""
    def key(d):
        return suffix_dedup.NO_ID if d is None else d
    first, out = {}, {}
    for d, t in rows:
        data = (t or "").encode()
        for i in range(len(data) - length + 1):
            at = (key(d), i)
            w = data[i:i + length]
            first[w] = min(first.get(w, at), at)
    for d, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first[data[i:i + length]] < (key(d), i):
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        kept = hashlib.sha256(bytes(c for c, g in zip(data, gone) if not g)).hexdigest()
        row = (d, len(data), sum(gone), spans, kept)
        out[row] = out.get(row, 0) + 1
    return out


@pytest.mark.parametrize("length,alphabet", [(100, "abé"), (12, "ab"), (30, "abcdefgh ")])
def test_suffix_repeats_equal_brute_force(spark, length, alphabet):
    rnd = random.Random(length)
    base = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(50, 500)))
            for _ in range(10)]
    rows = []
    for i in range(50):
        text = ""
        for _ in range(rnd.randrange(5)):
            at = rnd.randrange(100)
            text += rnd.choice(base)[at:at + rnd.randrange(300)] if rnd.random() < 0.7 else \
                "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(80)))
        rows.append((None if i == 17 else i, text if i % 13 else None))
    rows += [rows[5], (500, "a" * 3000), (501, "b" + "a" * 2000)]
    rnd.shuffle(rows)
    got = {}
    for r in suffix_dedup.remove_repeats(docs(spark, rows).repartition(5), length=length).collect():
        got[tuple(r)] = got.get(tuple(r), 0) + 1
    assert got == plain_repeats(rows, length)


def test_op8_over_the_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in
            spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {tuple(r): 1 for r in QUERIES["op8_suffix_dedup"](spark, SF).collect()}
    assert got == plain_repeats(rows, 100)


def test_suffix_chunks_overlap(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    rnd = random.Random(8)
    part = bytes(rnd.choice(b"abcd") for _ in range(900))
    text = part + bytes(rnd.choice(b"abcd") for _ in range(3000)) + part
    runs = []
    for chunk in suffix_dedup._pieces_of([(1, 1, text)], 100):
        p, s, e, a, _, _ = suffix_dedup.window_runs([c[2] for c in chunk], 100)
        runs += [(int(s[i]) + chunk[p[i]][1], int(e[i]) + chunk[p[i]][1]) for i in range(len(p))]
    assert sorted(w for s, e in runs for w in range(s, e + 1)) == list(range(len(text) - 99))


def test_loser_tree_merges_and_tracks_prefixes():
    rnd = random.Random(9)
    for k in (0, 1, 2, 5, 8):
        runs = [sorted((bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(1, 9))), b"", 0, 0, i)
                       for i in range(rnd.randrange(30))) for _ in range(k)]
        blobs = [suffix_dedup.decode_run(suffix_dedup.encode_run(r), len(r)) for r in runs]
        out = list(suffix_dedup.merge_runs(blobs))
        assert [x[1] for x in out] == sorted(x[0] for r in runs for x in r)
        for a, b in zip(out, out[1:]):
            assert b[0] == suffix_dedup.common_prefix(a[1], b[1])


def test_suffix_repeats_of_an_empty_table(spark):
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0
