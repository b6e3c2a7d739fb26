"""Vector code compression: product quantisation with whole-number codebooks.

Components become integers; a vector is cut into equal consecutive parts and
every part position has a codebook of its own, refined for a few rounds.  The
nearest entry is found in the Walsh-Hadamard domain: parts and entries are
padded with zeros to a power of two ``P`` and transformed by additions alone,
which scales every squared distance by exactly ``P``.  Squared differences add
up in sequency order (coarse patterns first); an entry whose sum exceeds the
distance of a known entry is out, and only the survivors read further
coefficients.  Nothing is rounded anywhere.

Every round is one pass of the tasks over the prepared vectors; a task returns
sums per (part, entry, position), so what shuffles and what the driver holds is
a codebook's size (entries x dimensions numbers), whatever the table's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cuts, slices

ROWS = 1024         # vectors whose distances one step holds
HEAD = 4            # coefficients read for every entry
STEP = 4            # coefficients read at once for the survivors


def sequency_order(width: int) -> np.ndarray:
    """Natural index of the pattern with 0, 1, 2, ... sign changes: the
    bit-reversed Gray code."""
    bits = width.bit_length() - 1
    gray = [s ^ (s >> 1) for s in range(width)]
    return np.array([int(f"{g:0{bits}b}"[::-1], 2) if bits else 0 for g in gray])


def walsh(rows: np.ndarray) -> np.ndarray:
    """Transform of rows (padded with zeros to a power of two), by sequency."""
    n, length = rows.shape
    width = 1 << max(0, length - 1).bit_length()
    out = np.zeros((n, width), rows.dtype)
    out[:, :length] = rows
    half = 1
    while half < width:
        pairs = out.reshape(n, -1, 2, half)
        a, b = pairs[:, :, 0, :], pairs[:, :, 1, :]
        out = np.stack((a + b, a - b), axis=2).reshape(n, width)
        half *= 2
    return out[:, sequency_order(width)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties to the lower) and the squared distance
    times the width, for transformed rows and entries."""
    width = x.shape[1]
    head = min(HEAD, width)
    so_far = np.zeros((len(x), len(book)), x.dtype)
    for c in range(head):
        d = x[:, c, None] - book[None, :, c]
        so_far += d * d
    lead = book[so_far.argmin(axis=1)]
    bound = ((x - lead) * (x - lead)).sum(axis=1)
    row, entry = np.nonzero(so_far <= bound[:, None])
    total = so_far[row, entry]
    for c in range(head, width, STEP):
        d = x[row, c:c + STEP] - book[entry, c:c + STEP]
        total = total + (d * d).sum(axis=1)
        alive = total <= bound[row]
        row, entry, total = row[alive], entry[alive], total[alive]
    first = np.searchsorted(row, np.arange(len(x)))         # every row has a survivor
    best = np.minimum.reduceat(total, first)
    hit = np.flatnonzero(total == best[row])
    place = hit[np.searchsorted(row[hit], np.arange(len(x)))]
    return entry[place], best


class Codebooks:
    """The entries of every part position, as nested lists of whole numbers."""

    def __init__(self, books: list[list[list[int]]], length: int, largest: int):
        self.books, self.length = books, length
        self.width = 1 << max(0, length - 1).bit_length()
        # sums of squares stay below 4 (width * largest)^2: 64 bits where that fits
        self.kind = np.int64 if 4 * (self.width * largest) ** 2 < 1 << 63 else object
        self._walsh = None

    def assign(self, ints: list[list[int]]) -> tuple[np.ndarray, list, list]:
        """Padded vectors (rows, parts, length), and the nearest entry and its
        scaled distance by part."""
        if self._walsh is None:
            self._walsh = [walsh(np.array(b, self.kind).reshape(-1, self.length))
                           for b in self.books]
        rows = np.zeros((len(ints), len(self.books) * self.length), self.kind)
        for i, v in enumerate(ints):
            rows[i, :len(v)] = v
        rows = rows.reshape(len(ints), len(self.books), self.length)
        found = [nearest(walsh(rows[:, p]), book) for p, book in enumerate(self._walsh)]
        return rows, [f[0] for f in found], [f[1] for f in found]

    def sha256(self) -> str:
        flat = (str(x) for book in self.books for entry in book for x in entry)
        return hashlib.sha256(",".join(flat).encode()).hexdigest()


def _sums(batches: Iterator[pa.RecordBatch], books: Codebooks):
    """Sums of the parts that a task gave to each entry, by position."""
    totals: dict[tuple[int, int], list] = {}
    for batch in slices(batches, ROWS):
        rows, entries, _ = books.assign(batch.column("ints").to_pylist())
        for p, entry in enumerate(entries):
            used, where, counts = np.unique(entry, return_inverse=True, return_counts=True)
            sums = np.zeros((len(used), books.length), books.kind)
            np.add.at(sums, where, rows[:, p])
            for e, total, n in zip(used.tolist(), sums.tolist(), counts.tolist()):
                held = totals.setdefault((p, e), [[0] * books.length, 0])
                held[0] = [a + b for a, b in zip(held[0], total)]
                held[1] += n
    lines = [(p, e, at, Decimal(x), n) for (p, e), (total, n) in totals.items()
             for at, x in enumerate(total)]
    if lines:
        part, entry, at, total, n = zip(*lines)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(at, pa.int32()),
             pa.array(total, pa.decimal128(38, 0)), pa.array(n, pa.int64())],
            names=["part", "entry", "at", "total", "n"])


def _codes(batches: Iterator[pa.RecordBatch], books: Codebooks):
    """Code and error of every vector."""
    for batch in slices(batches, ROWS):
        _, entries, scaled = books.assign(batch.column("ints").to_pylist())
        codes = ["".join(f"{i:02x}" for i in row) for row in zip(*map(np.ndarray.tolist, entries))]
        errors = [sum(row) // books.width for row in zip(*map(np.ndarray.tolist, scaled))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()),
             pa.array([e if e < 1 << 63 else None for e in errors], pa.int64())],
            names=["vec_id", "label", "code", "error"])


def fit_codebooks(vectors: DataFrame, parts: int, entries: int, rounds: int) -> Codebooks | None:
    """Codebooks of ``vectors(vec_id, ints)``; None for an empty table.

    The first entries are the parts of the vectors with the smallest ids (null
    ids last, equal ids by components); each round replaces an entry by the
    floored mean of its parts and leaves unused entries as they are.
    """
    facts = vectors.agg(
        F.max(F.size("ints")).alias("size"),
        F.max(F.array_max(F.transform("ints", lambda x: F.greatest(x, -(x + 1))))).alias("top")
    ).first()
    if facts["size"] is None:
        return None
    length = max(1, -(-facts["size"] // parts))
    first = (vectors.orderBy(F.col("vec_id").asc_nulls_last(), "ints")
             .select("ints").limit(entries).collect())
    padded = [r["ints"] + [0] * (parts * length - len(r["ints"])) for r in first]
    start = [[v[p * length:(p + 1) * length] for v in padded] for p in range(parts)]
    books = Codebooks(start, length, (facts["top"] or 0) + 1)
    for _ in range(rounds):
        sums = (vectors.select("ints")
                .mapInArrow(lambda batches, held=books: _sums(batches, held),
                            "part int, entry int, at int, total decimal(38,0), n bigint")
                .groupBy("part", "entry", "at")
                .agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect())
        moved = [[list(e) for e in book] for book in books.books]
        for r in sums:                          # at most entries x dimensions rows
            moved[r["part"]][r["entry"]][r["at"]] = int(r["total"]) // r["n"]
        books = Codebooks(moved, length, (facts["top"] or 0) + 1)
    return books


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str,
                  scale: int) -> DataFrame:
    """(vec_id, label, ints) of the rows whose vector can be coded."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x) != F.lit(float("inf"))))
    return (df.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"),
                      F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
            .where(F.col("vec").isNotNull() & finite)
            .select("vec_id", "label",
                    F.transform("vec", lambda x: F.floor(x * F.lit(float(scale)))).alias("ints")))


def compress_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                     label_col: str = "label", parts: int = 4, entries: int = 256,
                     rounds: int = 4, scale: int = 1024) -> DataFrame:
    """One row per coded vector: vec_id, code (two hex digits a part), error
    (squared distance to the entries, over all parts), label_error (errors
    summed over rows of equal label, nulls together) and codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components are
    dropped.  Vectors shorter than the longest, or than the next multiple of
    ``parts``, count as if zeros followed.  Null ids and labels are kept;
    repeated rows give repeated results; fewer rows than ``entries`` give
    smaller codebooks; an empty table gives no rows.  Components beyond 64 bits
    count as the nearest 64-bit number and an error beyond it is null.  Other
    columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries: 1 to 256, a code has two hex digits a part")
    spark = df.sparkSession
    cuts = Cuts(spark, "vector-codes")
    vectors = cuts.cut(whole_vectors(df, id_col, vec_col, label_col, scale), "vectors")
    books = fit_codebooks(vectors, parts, entries, rounds)
    types = {f.name: f.dataType.simpleString() for f in vectors.schema}
    schema = f"vec_id {types['vec_id']}, label {types['label']}, code string, error bigint"
    if books is None:
        coded, digest = spark.createDataFrame([], schema), F.lit("")
    else:
        coded = cuts.cut(vectors.mapInArrow(lambda b: _codes(b, books), schema), "codes")
        cuts.drop(vectors)
        digest = F.lit(books.sha256())
    whole = F.count("error") == F.count("*")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(
        F.when(whole, F.try_sum("error")).alias("label_error"))
    return (coded.join(by_label, coded["label"].eqNullSafe(by_label["of"]))
            .select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256")))
