"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Documents become pieces of at most one sequence's length.  The packing is
decided on the length histogram alone, at most ``capacity`` counts: a
configuration says how many pieces of each length one sequence holds, and the
linear program "fewest configurations that cover every length's count" is
solved by multiplicative weights.  A length's weight falls as it is covered; a
knapsack dynamic program over the capacity prices the configurations.  The
solution is rounded down, whole configurations are then taken by their
fractions as far as they fit, and what is left is packed by best fit, so the
counts come out exactly and no sequence has gaps.

The plan has one line per (configuration, length).  A piece finds its line by
its rank among the pieces of its length; ranks are a task's own count plus the
sums of the tasks before it, so neither a length nor a sequence is ever one
group.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import _NOT_PLAIN, _PLAIN, parts_of
from .common import Cuts, slices, texts_of

CAPACITY = 1024
END_ID = 2
CACHE_PIECES = 400_000      # pre-tokens per generation of a worker's memo; two are held


# ------------------------------------------------------------------ tokens


def byte_characters() -> dict[int, str]:
    """Fixed rule of byte-level vocabularies: a printable byte is written as
    itself, the others as the characters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class Ids(dict):
    """Ids of pre-tokens as little-endian bytes, in two generations of bounded
    size; the library's merges encode what is not held."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.old = tokenizer, {}
        self.merges, self.characters = tokenizer.model, byte_characters()

    def of(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            written = piece.encode().decode("latin-1").translate(self.characters)
            ids = [token.id for token in self.merges.tokenize(written)]
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= CACHE_PIECES:
            self.old = self.copy()
            self.clear()
        self[piece] = found
        return found


class PieceEncoder:
    """Ids of whole texts by a public tokenizer file, given as its text.

    Where the file splits by the public pattern and a text has plain characters
    only, a text's ids are those of its pre-tokens, which repeat; any other
    text, or one with a special token's string, goes to the library part by part.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(tokenizer_file)
        split = tokenizer.pre_tokenizer.__class__.__name__
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.by_pattern = split == "ByteLevel" and tokenizer.normalizer is None \
            and not tokenizer.pre_tokenizer.add_prefix_space
        self.ids = Ids(tokenizer)

    def encode(self, text: str) -> bytes:
        if not self.by_pattern:
            return self.ids.of(text)
        out = []
        for part in parts_of(text):
            if _NOT_PLAIN.search(part) or any(s in part for s in self.special):
                out.append(self.ids.of(part))
            else:
                out += map(self.ids.__getitem__, _PLAIN.findall(part))
        return b"".join(out)


_encoders: dict[str, PieceEncoder] = {}


def _encoder(tokenizer_file: str) -> PieceEncoder:
    if tokenizer_file not in _encoders:
        _encoders.clear()
        _encoders[tokenizer_file] = PieceEncoder(tokenizer_file)
    return _encoders[tokenizer_file]


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer_file: str, capacity: int, end_id: int,
            with_ids: bool):
    """Pieces of every text; ``nth`` counts a length's pieces within the task."""
    enc, part = _encoder(tokenizer_file), TaskContext.get().partitionId()
    end, met = struct.pack("<I", end_id), Counter()
    for batch in slices(batches, 256):
        rows = []
        for doc, raw in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
            ids = enc.encode(raw.decode("utf-8", "replace")) + end
            total = len(ids) // 4
            start, stop = 0, total % capacity or capacity
            for number in range(-(-total // capacity)):
                own = ids[4 * start:4 * stop]
                rows.append((doc, number, start, stop - start, zlib.crc32(own), part,
                             met[stop - start], own))
                met[stop - start] += 1
                start, stop = stop, stop + capacity
        kinds = [batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(),
                 pa.int64(), pa.int32(), pa.int64()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
        if not rows:
            continue
        *columns, ids = zip(*rows)
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        if with_ids:
            arrays.append(pa.array([np.frombuffer(x, "<u4").astype("int32") for x in ids],
                                   pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def cut_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
               text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
               with_ids: bool = False) -> DataFrame:
    """Pieces of every row's ids: doc_id, piece (from 0), start, length,
    ids_crc32, part and nth (the task that read it, and its place among that
    task's pieces of equal length) and, with ``with_ids``, the ids.

    A document's ids end with ``end_id``.  One that is longer than ``capacity``
    is cut from its end, so only its first piece may be shorter.  Null and
    empty texts are one piece of one id; repeated rows give repeated pieces.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, "
              "part int, nth bigint" + (", ids array<int>" if with_ids else ""))
    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(
        lambda batches: _pieces(batches, held.value, capacity, end_id, with_ids), schema)


# ------------------------------------------------------------- the program


class Knapsack:
    """Best configurations under length prices: unbounded, by capacity."""

    def __init__(self, lengths: np.ndarray, prices: np.ndarray, capacity: int):
        self.lengths = lengths
        self.worth = np.zeros(capacity + 1)
        self.took = np.full(capacity + 1, -1)
        fitting = np.searchsorted(lengths, np.arange(capacity + 1), "right")
        for room in range(int(lengths[0]), capacity + 1):
            n = fitting[room]
            values = self.worth[room - lengths[:n]] + prices[:n]
            best = int(values.argmax())
            self.worth[room], self.took[room] = values[best], best

    def fill(self, room: int) -> Counter:
        """Length indexes of the best filling of ``room``."""
        out = Counter()
        while room > 0 and self.took[room] >= 0:
            out[int(self.took[room])] += 1
            room -= int(self.lengths[self.took[room]])
        return out


def solve_weights(lengths: np.ndarray, counts: np.ndarray, capacity: int,
                  epsilon: float = 0.05, step: float = 0.25,
                  pricings: int = 600) -> tuple[dict[tuple, float], float]:
    """Fractional configurations that cover ``counts``, and a lower bound on
    the optimum of the linear program.

    Multiplicative weights: taking a configuration lowers the weight of each of
    its lengths by ``(1 - epsilon)`` to the power of the share of its count
    that it gained; a length covered ``ln(lengths) / epsilon`` times leaves the
    program.  One pricing serves many steps: every open length anchors the best
    configuration that holds it, taken while its worth is near the best and
    none of its lengths gained more than ``step`` under these prices.  Any
    prices bound the program from below by duality.  What is taken until the
    first length is covered (or half the pricings are used) only teaches the
    prices; the solution is what follows.  After ``pricings`` it stands as it
    is, scaled so that the most covered length is covered once.
    """
    goal = np.log(len(lengths) + 1) / epsilon
    prices, gained = lengths / capacity, np.zeros(len(lengths))
    taken: dict[tuple, float] = {}
    bound, learning = 0.0, True
    for n in range(pricings):
        held = np.flatnonzero(gained < goal)
        if learning and (len(held) < len(lengths) or n >= pricings // 2):
            learning, held = False, np.arange(len(lengths))
            gained, taken = np.zeros(len(lengths)), {}
        if not len(held):
            break
        table = Knapsack(lengths[held], prices[held], capacity)
        best = table.worth[capacity]
        bound = max(bound, float((prices * counts)[held].sum() / best))
        fresh = np.zeros(len(lengths))
        for i in np.argsort(gained[held], kind="stable"):
            room = capacity - int(lengths[held[i]])
            if fresh[held[i]] >= step or prices[held[i]] + table.worth[room] < (1 - epsilon) * best:
                continue
            chosen = table.fill(room)
            chosen[int(i)] += 1
            which = held[list(chosen)]
            per = np.array(list(chosen.values()))
            amount = float((counts[which] * (step - fresh[which]) / per).min())
            if amount <= 0:
                continue
            fresh[which] += amount * per / counts[which]
            config = tuple(sorted((int(lengths[w]), int(p)) for w, p in zip(which, per)))
            taken[config] = taken.get(config, 0.0) + amount
        gained += fresh
        prices = prices * (1 - epsilon) ** fresh
        prices /= prices.max()
    scale = min(goal, gained.max())
    return {c: x / scale for c, x in taken.items()}, bound


def _best_fit(left: Counter, capacity: int) -> Iterator[tuple[tuple, int]]:
    """Configurations of what is left: the longest piece with the set of others
    that fills its room best (sums of lengths as bits of a whole number), as
    often as the counts allow."""
    while left:
        top = max(left)
        chosen = Counter([top])
        room, sums, steps = capacity - top, 1, []
        limit = (1 << room + 1) - 1
        for length in sorted((x for x in left if x <= room), reverse=True):
            n, one = min(left[length] - (length == top), room // length), 1
            while n > 0:                        # copies in powers of two
                some = min(one, n)
                steps.append((length, some, sums))
                sums |= sums << length * some & limit
                n, one = n - some, one * 2
            if sums >> room & 1:
                break
        at = sums.bit_length() - 1
        for length, some, before in reversed(steps):
            if not before >> at & 1:
                chosen[length] += some
                at -= length * some
        times = min(left[n] // per for n, per in chosen.items())
        left = +(left - Counter({n: per * times for n, per in chosen.items()}))
        yield tuple(sorted(chosen.items())), times


def plan_sequences(histogram: dict[int, int], capacity: int) -> list[tuple[tuple, int]]:
    """(configuration, number of sequences) that use every count exactly."""
    left = Counter({n: c for n, c in histogram.items() if c > 0})
    plan: Counter = Counter()
    if left.get(capacity):                      # whole sequences need no decision
        plan[((capacity, 1),)] = left.pop(capacity)
    if left:
        lengths = np.array(sorted(left))
        counts = np.array([left[int(n)] for n in lengths], float)
        solved, _ = solve_weights(lengths, counts, capacity)

        def take(config, times):
            times = min([times, *(left[n] // per for n, per in config)])
            if times > 0:
                plan[config] += times
                left.subtract({n: per * times for n, per in config})

        for config, x in sorted(solved.items(), key=lambda c: (-c[1], c[0])):
            take(config, int(x))
        full = [c for c in solved if sum(n * per for n, per in c) == capacity]
        for config in sorted(full, key=lambda c: (-(solved[c] % 1), c)):
            take(config, round(solved[config] % 1))
        for config, times in _best_fit(+left, capacity):
            plan[config] += times
    return sorted(plan.items())


# ----------------------------------------------------------- the placement


def _placed(batches: Iterator[pa.RecordBatch], lines: dict[int, tuple[np.ndarray, ...]]):
    """Sequence and offset of every piece by its rank within its length."""
    for batch in batches:
        length = batch.column("length").to_numpy()
        rank = batch.column("rank").to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length).tolist():
            here = np.flatnonzero(length == n)
            since, per, first, at = lines[n]
            line = np.searchsorted(since, rank[here], "right") - 1
            place = rank[here] - since[line]
            sequence[here] = first[line] + place // per[line]
            offset[here] = at[line] + place % per[line] * n
        kept = [i for i, name in enumerate(batch.schema.names) if name != "rank"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in kept), pa.array(sequence), pa.array(offset)],
            names=[*(batch.schema.names[i] for i in kept), "sequence_id", "offset"])


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (as ``cut_pieces`` returns them, written once) with
    sequence_id and offset instead of part and nth.

    The driver holds the length histogram and the plan, both bounded by the
    capacity; the table of ranks has one row per task and length.
    """
    by_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    base = by_task.select(F.col("part").alias("p"), F.col("length").alias("l"),
                          F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in
                 by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    lines: dict[int, list] = {n: [] for n in histogram}
    used, first = Counter(), 0
    for config, times in plan_sequences(histogram, capacity):
        at = 0
        for n, per in config:
            lines[n].append((used[n], per, first, at))
            used[n] += per * times
            at += per * n
        first += times
    held = pieces.sparkSession.sparkContext.broadcast(
        {n: tuple(np.array(c, np.int64) for c in zip(*rows)) for n, rows in lines.items()})
    kept = [c for c in pieces.columns if c not in ("part", "nth")]
    ranked = (pieces.join(base, (F.col("part") == F.col("p")) & (F.col("length") == F.col("l")))
              .select(*kept, (F.col("nth") + F.col("base")).alias("rank")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema
                       if f.name != "rank") + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(lambda batches: _placed(batches, held.value), schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
                   text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
                   with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its offset there:
    doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids with
    ``with_ids``, the sequences' contents).

    A sequence's pieces fill it from 0 without gaps, up to ``capacity`` ids.
    Null and empty texts are pieces of the end id alone; repeated rows are
    packed each; an empty table gives no rows; other columns are not read.
    """
    cuts = Cuts(docs.sparkSession, "packing")
    pieces = cuts.cut(cut_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id,
                                 with_ids), "pieces")
    return place_pieces(pieces, capacity)
