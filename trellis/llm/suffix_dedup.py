"""Repeated passages by a distributed, common-prefix-aware suffix merge sort.

A byte goes if a ``length``-byte string that covers it also starts earlier, in
a smaller doc_id or earlier in its document.  Sorting every suffix is not
needed: each window of ``length`` bytes names one anchor, the leftmost k-gram
of least hash inside it (k is half of ``length``), so equal windows name equal
anchors at equal places, and only suffixes that start at anchors are sorted.

1. Texts are read once; windows that follow each other and share an anchor form
   a run.  Runs repeated inside a task are decided there.  Of the others the
   anchor's hash is dealt by value, as blobs, and hashes seen once drop out.
2. The suffixes at the remaining anchors are sorted per task, cut by byte-range
   splitters and exchanged as front-coded runs: each suffix as the length it
   shares with its predecessor and the rest.
3. A loser tree combines the runs of a range.  Every contestant knows the
   prefix it shares with the last suffix put out, so a match compares lengths
   first and bytes only beyond the known prefix.  Suffixes that share an anchor
   come out next to each other; their windows are compared exactly, in document
   order, and all but the first of each string are covered.

Hashes only choose what is sorted; every decision compares bytes.  A passage in
a third of all documents reaches a range once per task, not once per document.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cuts, partitions_of, slices, texts_of

CHUNK = 1 << 18             # bytes hashed at once; positions in it fit 20 bits
POSITION_BITS = np.uint64(20)
SEGMENT = 12 << 20          # bytes of text in which a task finds its own repeats
RUN_SUFFIXES = 60_000      # suffixes per sorted run
BUCKET_ANCHORS = 1_000_000
RANGE_SUFFIXES = 150_000
NO_ID = -(1 << 63)          # a null doc_id comes before all others

_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full((1 << int(POSITION_BITS)) + 1, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def window_runs(pieces: list[bytes], length: int):
    """Runs of windows with one anchor, over pieces of text that windows do not
    cross: (piece, first window, last window, anchor, anchor hash, content hash),
    positions counted from the piece's start."""
    k = length // 2
    width = length - k + 1
    up, down = _power_tables()
    data = np.frombuffer(b"".join(pieces), np.uint8)
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(data * up[:n], out=prefix[1:])
    grams = _mix((prefix[k:] - prefix[:n - k + 1]) * down[:n - k + 1])
    m = len(grams)
    low = (np.uint64(1) << POSITION_BITS) - np.uint64(1)
    ranked = (grams & ~low) | np.arange(m, dtype=np.uint64)
    blocks = -(-m // width) + 1
    grid = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    grid[:m] = ranked
    grid = grid.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    sizes = np.array([len(p) for p in pieces], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    piece = np.repeat(np.arange(len(pieces)), np.maximum(sizes - length + 1, 0))
    offset = np.arange(len(piece)) - np.repeat(
        np.cumsum(np.maximum(sizes - length + 1, 0)) - np.maximum(sizes - length + 1, 0),
        np.maximum(sizes - length + 1, 0))
    window = starts[piece] + offset
    anchor = (np.minimum(behind[window], ahead[window + width - 1]) & low).astype(np.int64)
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])) + 1
    first = np.concatenate([[0], cut]) if len(anchor) else cut
    last = np.concatenate([cut - 1, [len(anchor) - 1]]) if len(anchor) else cut
    s, e, a, p = window[first], window[last], anchor[first], piece[first]
    content = _mix((prefix[e + length] - prefix[s]) * down[s]) ^ (
        (e - s).astype(np.uint64) * np.uint64(_BASE)) ^ (a - s).astype(np.uint64)
    at = starts[p]
    return p, s - at, e - at, a - at, grams[a], content


def _segments(batches: Iterator[pa.RecordBatch]):
    """Rows (doc, mark, text) gathered to segments of about SEGMENT bytes."""
    held, size = [], 0
    for batch in slices(batches, 512):
        for doc, mark, text in zip(batch.column("doc").to_pylist(),
                                   batch.column("mark").to_pylist(), texts_of(batch)):
            held.append((doc, mark, text))
            size += len(text)
            if size >= SEGMENT:
                yield held
                held, size = [], 0
    if held:
        yield held


def _pieces_of(rows, length: int):
    """Chunks of pieces (row, offset, bytes); long texts overlap by a window."""
    held, size = [], 0
    for r, (_, _, text) in enumerate(rows):
        for at in range(0, max(len(text) - length + 1, 0), CHUNK - length):
            piece = text[at:at + CHUNK - 1]
            if size + len(piece) > CHUNK and held:
                yield held
                held, size = [], 0
            held.append((r, at, piece))
            size += len(piece)
    if held:
        yield held


def _pack(**arrays: np.ndarray) -> bytes:
    parts = [np.ascontiguousarray(a).tobytes() for a in arrays.values()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(blob: bytes, n: int, **kinds) -> dict[str, np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, {}
    for name, kind in kinds.items():
        size = np.dtype(kind).itemsize * n
        out[name] = np.frombuffer(data, kind, n, at)
        at += size
    return out


_RUN = dict(hash="u8", doc="i8", mark="i8", s="i8", e="u2", a="u2")
_DEALT = "part int, n int, blob binary"


def _anchors(batches: Iterator[pa.RecordBatch], length: int, buckets: int):
    """Step 1, map side.  part < buckets: runs by anchor hash; else: runs that
    an earlier equal run of the same task covers."""
    for rows in _segments(batches):
        found = []
        for chunk in _pieces_of(rows, length):
            p, s, e, a, h, content = window_runs([c[2] for c in chunk], length)
            row = np.array([c[0] for c in chunk], np.int64)[p]
            base = np.array([c[1] for c in chunk], np.int64)[p]
            found.append((row, base + s, base + e, base + a, h, content))
        if not found:
            continue
        row, s, e, a, h, content = map(np.concatenate, zip(*found))
        doc = np.array([r[0] for r in rows], np.int64)[row]
        mark = np.array([r[1] for r in rows], np.int64)[row]
        order = np.lexsort((row, s, doc, content))
        same = np.flatnonzero(content[order][1:] == content[order][:-1]) + 1
        keep, covered = np.ones(len(row), bool), []
        lead = -1
        for i in same.tolist():
            here = order[i]
            if lead < 0 or content[lead] != content[here]:
                lead = order[i - 1]
            x, y = rows[row[lead]][2], rows[row[here]][2]
            if (e[lead] - s[lead] == e[here] - s[here]
                    and x[s[lead]:e[lead] + length] == y[s[here]:e[here] + length]):
                keep[here] = False
                if (doc[lead], s[lead]) < (doc[here], s[here]):
                    covered.append(here)
        part = (h % np.uint64(buckets)).astype(np.int64)
        part[~keep] = -1
        part[covered] = buckets + (doc[covered] % buckets)
        order = np.argsort(part, kind="stable")
        order = order[part[order] >= 0]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(part[order])) + 1, [len(order)]])
        out = []
        for x, y in zip(edges[:-1], edges[1:]):
            if y > x:
                i = order[x:y]
                out.append((int(part[i[0]]), len(i), _pack(
                    hash=h[i], doc=doc[i], mark=mark[i], s=s[i], e=(e - s)[i].astype("u2"),
                    a=(a - s)[i].astype("u2"))))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))],
                names=["part", "n", "blob"])


def _by_part(batches: Iterator[pa.RecordBatch]):
    """(part, [(n, blob), ...]) of a stream sorted by part."""
    part, held = None, []
    for batch in slices(batches, 64):
        for p, n, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "blob"))):
            if p != part and held:
                yield part, held
                held = []
            part = p
            held.append((n, blob))
    if held:
        yield part, held


_SPANS = "covered boolean, doc bigint, mark bigint, s bigint, e bigint, a bigint"


def _spans(covered: bool, doc, mark, s, e, a) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(doc), covered)), *[pa.array(np.asarray(x, np.int64))
                                                 for x in (doc, mark, s, e, a)]],
        names=["covered", "doc", "mark", "s", "e", "a"])


def _repeated(batches: Iterator[pa.RecordBatch], buckets: int):
    """Step 1, reduce side: runs whose anchor hash another run has too, and the
    covered runs as they come."""
    for part, blobs in _by_part(batches):
        runs = [_unpack(blob, n, **_RUN) for n, blob in blobs]
        run = {c: np.concatenate([r[c] for r in runs]) for c in _RUN}
        if part < buckets:
            order = np.argsort(run["hash"], kind="stable")
            twin = run["hash"][order][1:] == run["hash"][order][:-1]
            stays = np.zeros(len(order), bool)
            stays[order[1:][twin]] = stays[order[:-1][twin]] = True
            run = {c: v[stays] for c, v in run.items()}
        for at in range(0, len(run["doc"]), 50_000):
            doc, mark, s, e, a = (run[c][at:at + 50_000] for c in ("doc", "mark", "s", "e", "a"))
            yield _spans(part >= buckets, doc, mark, s, s + e, s + a)


def common_prefix(x: bytes, y: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that share ``known`` bytes."""
    n = min(len(x), len(y)) - known
    differ = int.from_bytes(x[known:known + n], "big") ^ int.from_bytes(y[known:known + n], "big")
    return known + n - (differ.bit_length() + 7) // 8


def encode_run(suffixes: list[tuple]) -> bytes:
    """Front-coded blob of sorted (right, left, doc, mark, s)."""
    shared, sizes, lefts, rest, before = [], [], [], [], []
    last = b""
    for right, left, *_ in suffixes:
        lcp = common_prefix(last, right)
        shared.append(lcp)
        sizes.append(len(right) - lcp)
        rest.append(right[lcp:])
        lefts.append(len(left))
        before.append(left)
        last = right
    ids = np.array([x[2:] for x in suffixes], np.int64)
    body = b"".join(rest) + b"".join(before)
    head = b"".join(np.array(v, k).tobytes() for v, k in
                    ((shared, "u2"), (sizes, "u2"), (lefts, "u2"))) + ids.T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + body)


def decode_run(blob: bytes, n: int) -> Iterator[tuple]:
    """(common prefix with the suffix before, right, left, doc, mark, s)."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    shared, sizes, lefts = (np.frombuffer(data, "u2", n, 2 * n * i).tolist() for i in range(3))
    docs, marks, starts = (np.frombuffer(data, "i8", n, 6 * n + 8 * n * i).tolist()
                           for i in range(3))
    at = 30 * n
    side = at + sum(sizes)
    last = b""
    for i in range(n):
        last = last[:shared[i]] + data[at:at + sizes[i]]
        at += sizes[i]
        left = data[side:side + lefts[i]]
        side += lefts[i]
        yield shared[i], last, left, docs[i], marks[i], starts[i]


def merge_runs(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Combine sorted runs with a loser tree: (common prefix with the suffix put
    out before, right, left, doc, mark, s).  A contestant's known prefix refers
    to the suffix that beat it last, which is the one put out when it plays
    again, so the contestant with the longer known prefix is the smaller and
    bytes are compared only where both know the same."""
    k = len(runs)
    now = [next(r, None) for r in runs]
    known = [0] * k
    losers = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = now[a], now[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        lcp = common_prefix(x[1], y[1], known[a])
        if x[1][lcp:lcp + 1] <= y[1][lcp:lcp + 1]:
            known[b] = lcp
            return a, b
        known[a] = lcp
        return b, a

    def settle(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(settle(2 * node), settle(2 * node + 1))
        return winner

    best = settle(1) if k > 1 else 0
    while k and now[best] is not None:
        yield (known[best], *now[best][1:])
        now[best] = next(runs[best], None)
        known[best] = now[best][0] if now[best] is not None else 0
        node = (best + k) >> 1
        while node:
            best, losers[node] = play(losers[node], best)
            node >>= 1


def _suffix_runs(batches: Iterator[pa.RecordBatch], length: int, splitters: list[bytes]):
    """Step 2: the suffixes at the anchors of each text, as front-coded runs."""
    k, held = length // 2, []

    def flush():
        held.sort()
        parts = [bisect_right(splitters, x[0][:k]) for x in held]
        edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(held)]
        out = [(parts[x], y - x, encode_run(held[x:y])) for x, y in zip(edges[:-1], edges[1:])]
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))],
            names=["part", "n", "blob"])

    for batch in slices(batches, 256):
        runs = batch.column("runs").to_pylist()
        for doc, mark, text, own in zip(batch.column("doc").to_pylist(),
                                        batch.column("mark").to_pylist(), texts_of(batch), runs):
            for run in own:
                s, e, a = run["s"], run["e"], run["a"]
                held.append((text[a:e + length], text[s:a], doc, mark, s))
            if len(held) >= RUN_SUFFIXES:
                yield flush()
    if held:
        yield flush()


def covered_windows(group: list[tuple], length: int) -> Iterator[tuple]:
    """(doc, mark, first, last) of the windows that an earlier equal window of
    the group covers; the group's suffixes share an anchor."""
    group.sort(key=lambda x: (x[3], x[5], x[4]))
    whole: dict[tuple, tuple] = {}
    parts: list[tuple] = []
    for _, right, left, doc, mark, s in group:
        first = whole.setdefault((left, right), (doc, s))
        if first == (doc, s):
            parts.append((left + right, left, right, doc, mark, s))
        else:
            yield doc, mark, s, s + len(left) + len(right) - length
    if len(parts) < 2:
        return
    # equal windows reach equally far to the left of the anchor, so one reach is
    # compared at a time: one window of each member is held, not all of them
    covered = [0] * len(parts)
    for reach in range(max(len(left) for _, left, *_ in parts) + 1):
        seen: dict[bytes, tuple] = {}
        for i, (text, left, _, doc, _, s) in enumerate(parts):
            o = len(left) - reach
            if 0 <= o <= len(text) - length:
                at = (doc, s + o)
                if seen.setdefault(text[o:o + length], at) != at:
                    covered[i] |= 1 << o
    for bits, (_, _, _, doc, mark, s) in zip(covered, parts):
        o = 0
        while bits >> o:
            o += ((bits >> o) & -(bits >> o)).bit_length() - 1
            n = ((~(bits >> o)) & ((bits >> o) + 1)).bit_length() - 1
            yield doc, mark, s + o, s + o + n - 1
            o += n


def _merged(batches: Iterator[pa.RecordBatch], length: int):
    """Step 3: merge the runs of a range and compare windows group by group."""
    k = length // 2
    for _, blobs in _by_part(batches):
        out, group = [], []
        for suffix in merge_runs([decode_run(blob, n) for n, blob in blobs]):
            if suffix[0] < k and group:
                if len(group) > 1:
                    out += covered_windows(group, length)
                group = []
                if len(out) > 50_000:
                    doc, mark, s, e = zip(*out)
                    yield _spans(True, doc, mark, s, e, s)
                    out = []
            group.append(suffix)
        if len(group) > 1:
            out += covered_windows(group, length)
        if out:
            doc, mark, s, e = zip(*out)
            yield _spans(True, doc, mark, s, e, s)


def _cleaned(batches: Iterator[pa.RecordBatch], length: int, with_text: bool):
    for batch in slices(batches, 256):
        rows = []
        for text, spans in zip(texts_of(batch), batch.column("spans").to_pylist()):
            kept, at, removed, n = [], 0, 0, 0
            for span in sorted((x["s"], x["e"]) for x in spans or ()):
                begin, end = span[0], span[1] + length
                if n and begin <= at:
                    if end > at:
                        removed += end - at
                        at = end
                    continue
                kept.append(text[at:begin])
                removed += end - begin
                n, at = n + 1, end
            kept.append(text[at:])
            left = b"".join(kept)
            rows.append((len(text), removed, n, hashlib.sha256(left).hexdigest(),
                         left.decode("utf-8", "replace") if with_text else ""))
        columns = list(zip(*rows)) if rows else [()] * 5
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"),
             *[pa.array(c, t) for c, t in zip(columns, kinds)][:5 if with_text else 4]],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256",
                   "kept_text"][:6 if with_text else 5])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   length: int = 100, with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256 and, with ``with_text``, the kept text (bytes
    that a cut leaves without their character become U+FFFD there; the digest
    is of the bytes).

    Null counts as empty and texts shorter than ``length`` keep all bytes.  A
    null doc_id comes before all others.  Rows repeated with one doc_id and
    text are one document and give repeated results.  Empty table: no rows.
    Other columns are not read.  ``length`` is at most 2000.
    """
    if not 2 <= length <= 2000:
        raise ValueError("length must lie between 2 and 2000 bytes")
    spark = docs.sparkSession
    cuts = Cuts(spark, "suffixes")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    # sizes, and one suffix at a hashed place of some text per lot, for the splitters
    lots = min(1 << 17, max(4096, docs.count() // 64))
    place = F.pmod(F.xxhash64("mark", "doc"), F.greatest(F.length("text"), F.lit(1)))
    drawn = (rows.groupBy(F.pmod("mark", F.lit(lots)))
             .agg(F.sum(F.octet_length("text")).alias("bytes"),
                  F.max_by(F.substring(F.col("text"), (place + 1).cast("int"), F.lit(16)),
                           F.xxhash64("mark")).alias("sample"))
             .select("bytes", F.encode("sample", "UTF-8").alias("sample")).collect())
    total = sum(r["bytes"] or 0 for r in drawn)
    shuffle = partitions_of(spark)
    buckets = max(shuffle, total * 4 // (length * BUCKET_ANCHORS) + 1)
    runs = cuts.cut(
        rows.select("doc", "mark", "text")
        .mapInArrow(lambda b: _anchors(b, length, buckets), _DEALT)
        .repartition(shuffle, "part").sortWithinPartitions("part")
        .mapInArrow(lambda b: _repeated(b, buckets), _SPANS), "runs")
    ranges = max(shuffle, runs.where("NOT covered").count() // RANGE_SUFFIXES + 1)
    sample = sorted({bytes(r["sample"]) for r in drawn if r["sample"]})
    step = max(1, len(sample) // ranges)
    splitters = sample[step::step]
    places = (runs.where("NOT covered").groupBy("doc", "mark")
              .agg(F.collect_list(F.struct("s", "e", "a")).alias("runs")))
    merged = cuts.cut(
        rows.select("doc", "mark", "text").join(places, ["doc", "mark"])
        .mapInArrow(lambda b: _suffix_runs(b, length, splitters), _DEALT)
        .repartition(max(shuffle, min(ranges, 4 * shuffle)), "part").sortWithinPartitions("part")
        .mapInArrow(lambda b: _merged(b, length), _SPANS), "merged")
    spans = (runs.where("covered").select("doc", "mark", "s", "e")
             .unionByName(merged.select("doc", "mark", "s", "e"))
             .groupBy("doc", "mark").agg(F.collect_list(F.struct("s", "e")).alias("spans")))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, "
              "kept_sha256 string" + (", kept_text string" if with_text else ""))
    return (rows.join(spans, ["doc", "mark"], "left").select("doc_id", "text", "spans")
            .mapInArrow(lambda b: _cleaned(b, length, with_text), schema))
