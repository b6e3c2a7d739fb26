"""Conversation structure repair: the cheapest edits that turn a conversation
into an optional system turn followed by user/assistant pairs.

Every turn is a symbol: the class of its role's first letter and its first
fault.  Equal neighbours collapse to runs.  The repaired roles are read by a
four-state automaton, so one turn is a 4 x 4 min-plus matrix (keep, rerole,
delete, and any insertions before it); a run advances through cached binary
powers of its matrix, and the edits are unrolled from the costs to go.

Nothing is keyed by conversation alone until it is short: turns are ranged over
tasks by (conversation, turn), a task reduces its stretch of a conversation to
runs and one matrix, stretches are chained (at most one per task), and each is
unrolled where it lies for every state it may start in.  Equal turns are
counted before they are sorted.  Only the repaired texts are read in sequence,
since one digest covers them all; they stream through in bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Cuts, partitions_of

KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 3, 4, 3, 3     # costs of the edits
NEVER = 1 << 60
START, SYSTEM, USER, ASSISTANT = range(4)       # states: what was read last
CLASSES = "sua"                                 # class 3: any other initial
FINE, TRUNCATED, DUPLICATE, BLANK = range(4)    # faults; symbol = 4 * class + fault
_AFTER_INSERT = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_SPACES = " \t\n\x0b\x0c\r"


def _kept(state: int, symbol: int) -> int | None:
    """State after keeping a turn, None where it may not stand."""
    if symbol % 4 >= DUPLICATE:
        return None
    wanted = CLASSES[symbol // 4:symbol // 4 + 1]
    if wanted == "s":
        return SYSTEM if state == START else None
    if wanted == "u":
        return USER if state != USER else None
    return ASSISTANT if wanted == "a" and state == USER else None


def _moves(state: int, symbol: int) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, next state) at a turn, in ASCII order; all edits but the
    insertion use the turn up."""
    extra = CUT_SHORT if symbol % 4 == TRUNCATED else 0
    yield "D", DELETE, state
    yield "I", INSERT, _AFTER_INSERT[state]
    kept = _kept(state, symbol)
    if kept is not None:
        yield "K", KEEP + extra, kept
    if symbol % 4 < DUPLICATE:
        yield "R", REROLE + extra, _AFTER_INSERT[state]


def _times(a, b):
    """Min-plus product of two matrices."""
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4))
                 for i in range(4))


def _insertions():
    rows = []
    for state in range(4):
        row, cost, at = [NEVER] * 4, 0, state
        while row[at] > cost:
            row[at] = cost
            at, cost = _AFTER_INSERT[at], cost + INSERT
        rows.append(tuple(row))
    return tuple(rows)


_INSERTIONS = _insertions()
_NOTHING = tuple(tuple(0 if i == j else NEVER for j in range(4)) for i in range(4))
#: Cost to go at the end: the empty conversation and a finished pair are whole.
_END = tuple(min(row[START], row[ASSISTANT]) for row in _INSERTIONS)


@lru_cache(maxsize=None)
def power(symbol: int, k: int):
    """Matrix of 2**k turns of one symbol, insertions before each included."""
    if k:
        return _times(power(symbol, k - 1), power(symbol, k - 1))
    one = [[NEVER] * 4 for _ in range(4)]
    for state in range(4):
        for edit, cost, after in _moves(state, symbol):
            if edit != "I":
                one[state][after] = min(one[state][after], cost)
    return _times(_INSERTIONS, one)


def before_run(symbol: int, n: int, to_go):
    """Costs to go before ``n`` turns of one symbol, from those after them."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            m = power(symbol, k)
            to_go = tuple(min(m[i][j] + to_go[j] for j in range(4)) for i in range(4))
    return to_go


@lru_cache(maxsize=1 << 14)
def matrix_of(symbols: bytes, lengths: tuple[int, ...]):
    """Matrix of a stretch of runs."""
    out = _NOTHING
    for symbol, n in zip(symbols, lengths):
        for k in range(n.bit_length()):
            if n >> k & 1:
                out = _times(out, power(symbol, k))
    return out


@lru_cache(maxsize=1 << 14)
def unroll(symbols: bytes, lengths: tuple[int, ...], to_go, state: int,
           last: bool) -> tuple[str, int]:
    """ASCII-least cheapest edits of a stretch from ``state`` and the state it
    leaves; ``to_go`` are the costs after it, ``last`` adds closing inserts."""
    after = [to_go]                             # costs to go after each run
    for symbol, n in zip(symbols[:0:-1], lengths[:0:-1]):
        after.append(before_run(symbol, n, after[-1]))
    edits = []
    for symbol, n, end in zip(symbols, lengths, reversed(after)):
        costs = [end]
        for _ in range(n):                      # one row of costs for each turn of the run
            costs.append(before_run(symbol, 1, costs[-1]))
        for i in range(n, 0, -1):
            here, there = costs[i], costs[i - 1]
            edit = "I"
            while edit == "I":
                edit, state = next((e, nxt) for e, cost, nxt in _moves(state, symbol)
                                   if cost + (here if e == "I" else there)[nxt] == here[state])
                edits.append(edit)
    while last and _END[state]:
        edits.append("I")
        state = _AFTER_INSERT[state]
    return "".join(edits), state


# ------------------------------------------------------------- the rows


def _plain(rows: DataFrame, conv_col: str, turn_col: str, role_col: str,
           text_col: str) -> DataFrame:
    """(conv_id, turn, role, text); null roles and texts are one space."""
    return rows.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
                       F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("role"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit(" ")).alias("text"))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
           role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) damaged by the hash of ``conv_id:turn``: of
    twenty classes 0 drops the row, 1 empties its text, 2 removes ``.!?``, 3
    repeats it, 4 makes it a user's.  Nulls count as one space, in the hash
    too; the row keeps a null conv_id or turn."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                    F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    text = (F.when(F.col("_die") == 1, "").when(F.col("_die") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text")))
    copies = F.when(F.col("_die") == 3, 2).otherwise(1)
    return (_plain(rows, conv_col, turn_col, role_col, text_col)
            .withColumn("_die", F.crc32(name) % 20).where("_die <> 0")
            .select("conv_id", "turn",
                    F.when(F.col("_die") == 4, "user").otherwise(F.col("role")).alias("role"),
                    text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy"))
            .drop("_copy"))


def turn_symbols(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, first, rest, n): ``n`` equal turns, the
    first of them with symbol ``first``, the others with symbol ``rest``.

    A text counts as seen earlier when an equal role and text stands at an
    earlier turn, or before it among the equal turns."""
    shown = F.rtrim(F.col("text"), F.lit(_SPACES))
    turns = (rows.select("conv_id", "turn", "role", _digest(F.col("text")).alias("digest"),
                         (shown == "").alias("blank"),
                         (~F.right(shown, F.lit(1)).isin(".", "!", "?")).alias("cut_short"))
             .groupBy("conv_id", "turn", "role", "digest", "blank", "cut_short")
             .agg(F.count("*").alias("n")))
    repeated = (turns.where("not blank")
                .groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"),
                         F.col("digest").alias("d"))
                .agg(F.min(F.struct("turn")).alias("met"), F.count("*").alias("places"))
                .where("places > 1"))
    seen = turns.join(repeated, turns["conv_id"].eqNullSafe(repeated["c"])
                      & (turns["role"] == repeated["r"]) & (turns["digest"] == repeated["d"]), "left")
    initial = F.left("role", F.lit(1))
    kind = 4 * (F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2)
                .otherwise(3))
    earlier = F.col("places").isNotNull() & ~F.col("met.turn").eqNullSafe(F.col("turn"))
    fault = (F.when(F.col("blank"), BLANK).when(earlier, DUPLICATE)
             .when(F.col("cut_short"), TRUNCATED).otherwise(FINE))
    return seen.select("conv_id", "turn", "role", "digest", (kind + fault).alias("first"),
                       (kind + F.when(F.col("blank"), BLANK).otherwise(DUPLICATE)).alias("rest"),
                       "n")


def _runs(batches: Iterator[pa.RecordBatch]):
    """Runs of every conversation's stretch in this task's sorted turns."""
    part = TaskContext.get().partitionId()
    done: list[tuple] = []
    conv, symbols, lengths, open_ = None, bytearray(), [], False

    def add(symbol, n):
        if symbols and symbols[-1] == symbol:
            lengths[-1] += n
        elif n:
            symbols.append(symbol)
            lengths.append(n)

    def batch_of(rows):
        conv_ids, blobs, runs = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(conv_ids, kind), pa.array([part] * len(rows), pa.int32()),
             pa.array(blobs, pa.binary()), pa.array(runs, pa.list_(pa.int64()))],
            names=["conv_id", "part", "symbols", "lengths"])

    kind = None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for c, first, rest, n in zip(*(batch.column(name).to_pylist()
                                       for name in ("conv_id", "first", "rest", "n"))):
            if open_ and c != conv:
                done.append((conv, bytes(symbols), lengths))
                symbols, lengths = bytearray(), []
            conv, open_ = c, True
            add(first, 1)
            add(rest, n - 1)
        if len(done) >= 1000:
            yield batch_of(done)
            done = []
    if open_:
        yield batch_of([*done, (conv, bytes(symbols), lengths)])


def _matrices(batches: Iterator[pa.RecordBatch]):
    """The matrix of every stretch, row by row."""
    for batch in batches:
        flat = [[x for row in matrix_of(s, tuple(n)) for x in row]
                for s, n in zip(batch.column("symbols").to_pylist(),
                                batch.column("lengths").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("part"), pa.array(flat, pa.list_(pa.int64()))],
            names=["conv_id", "part", "matrix"])


def _costs_to_go(batches: Iterator[pa.RecordBatch]):
    """Per stretch of a conversation: the costs after it, its place among the
    stretches, and the whole conversation's cost."""
    for batch in batches:
        out = []
        for conv, stretches in zip(batch.column("conv_id").to_pylist(),
                                   batch.column("stretches").to_pylist()):
            to_go, rows = _END, []
            for s in reversed(stretches):
                rows.append((conv, s["part"], list(to_go), s is stretches[0], s is stretches[-1]))
                m = s["matrix"]
                to_go = tuple(min(m[4 * i + j] + to_go[j] for j in range(4)) for i in range(4))
            out += [(*row, to_go[START]) for row in rows]
        columns = zip(*out)
        names = ["conv_id", "part", "to_go", "is_first", "is_last", "cost"]
        kinds = [batch.schema.field("conv_id").type, pa.int32(), pa.list_(pa.int64()), pa.bool_(),
                 pa.bool_(), pa.int64()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=names)


def _unrolled(batches: Iterator[pa.RecordBatch]):
    """Edits and leaving state of a stretch for every state it may start in
    (only the empty start for a conversation's first), and its counts."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            symbols, lengths = r["symbols"], tuple(r["lengths"])
            ways = [unroll(symbols, lengths, tuple(r["to_go"]), state, r["is_last"])
                    for state in range(1 if r["is_first"] else 4)]
            faults, illegal = [0] * 4, 0
            for i, (symbol, n) in enumerate(zip(symbols, lengths)):
                faults[symbol % 4] += n
                illegal += n - 1 + (i > 0 and not _legal(symbols[i - 1], symbol))
            rows.append((r["conv_id"], r["part"], [w[0] for w in ways], [w[1] for w in ways],
                         symbols[0], symbols[-1], faults[BLANK], faults[DUPLICATE],
                         faults[TRUNCATED], illegal, r["cost"]))
        if rows:
            kinds = [batch.schema.field("conv_id").type, pa.int32(), pa.list_(pa.string()),
                     pa.list_(pa.int32()), pa.int32(), pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                names=["conv_id", "part", "edits", "ends", "head", "tail", "blank", "duplicate",
                       "truncated", "illegal", "cost"])


def _legal(a: int, b: int) -> bool:
    return (a // 4, b // 4) in ((0, 1), (1, 2), (2, 1))


def _chained(batches: Iterator[pa.RecordBatch]):
    """Stretches joined in order: each starts in the state the last one left."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            state, audit, tail, illegal = START, [], None, r["illegal"]
            for s in r["stretches"]:
                audit.append(s["edits"][state])
                illegal += tail is not None and not _legal(tail, s["head"])
                state, tail = s["ends"][state], s["tail"]
            rows.append((r["conv_id"], r["blank"], r["duplicate"], r["truncated"], illegal,
                         r["cost"], "".join(audit)))
        if rows:
            kinds = [batch.schema.field("conv_id").type, *[pa.int64()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                names=["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def repair_plans(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, gaps (turn numbers missing between
    the least and the largest), blank, duplicate, truncated (turns by first
    fault), illegal (neighbours whose initials are not su, ua or au), cost and
    audit (one letter an edit: Keep, Rerole, Delete, Insert).

    Turns are taken by number, nulls first; turns of one number by role, then
    by the SHA-256 of the text.  Null roles and texts count as one space; a
    null conv_id is a conversation.  Repeated rows are duplicates.  An empty
    table gives no rows.  Other columns are not read.
    """
    spark = rows.sparkSession
    cuts = Cuts(spark, "conversation-repair")
    kind = rows.schema[conv_col].dataType.simpleString()
    turns = cuts.cut(turn_symbols(_plain(rows, conv_col, turn_col, role_col, text_col)), "turns")
    order = ["conv_id", "turn", "role", "digest"]
    stretches = cuts.cut(
        turns.repartitionByRange(partitions_of(spark), *order).sortWithinPartitions(*order)
        .select("conv_id", "first", "rest", "n")
        .mapInArrow(_runs, f"conv_id {kind}, part int, symbols binary, lengths array<bigint>"),
        "stretches")
    costs = (stretches.mapInArrow(_matrices, f"conv_id {kind}, part int, matrix array<bigint>")
             .groupBy("conv_id")
             .agg(F.sort_array(F.collect_list(F.struct("part", "matrix"))).alias("stretches"))
             .mapInArrow(_costs_to_go, f"conv_id {kind}, part int, to_go array<bigint>, "
                                       "is_first boolean, is_last boolean, cost bigint")
             .withColumnsRenamed({"conv_id": "c", "part": "p"}))
    unrolled = (stretches.join(costs, stretches["conv_id"].eqNullSafe(costs["c"])
                               & (stretches["part"] == costs["p"]))
                .select("conv_id", "part", "symbols", "lengths", "to_go", "is_first", "is_last",
                        "cost")
                .mapInArrow(_unrolled,
                            f"conv_id {kind}, part int, edits array<string>, ends array<int>, "
                            "head int, tail int, blank bigint, duplicate bigint, "
                            "truncated bigint, illegal bigint, cost bigint"))
    plans = (unrolled.groupBy("conv_id")
             .agg(F.sort_array(F.collect_list(F.struct("part", "edits", "ends", "head", "tail")))
                  .alias("stretches"),
                  *[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated", "illegal")],
                  F.max("cost").alias("cost"))
             .mapInArrow(_chained, f"conv_id {kind}, blank bigint, duplicate bigint, "
                                   "truncated bigint, illegal bigint, cost bigint, audit string"))
    gaps = (turns.select(F.col("conv_id").alias("g"), "turn").distinct().groupBy("g")
            .agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
                 .cast("bigint").alias("gaps")))
    return (plans.join(gaps, plans["conv_id"].eqNullSafe(gaps["g"]))
            .select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
                    "audit"))


# ---------------------------------------------------------- the repaired turns


def _in_order(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Plans and turns of each conversation together, the plan first, sorted
    for reading in sequence."""
    kept = [c for c in plans.columns if c != "conv_id"]
    ahead = plans.select("conv_id", F.struct(*kept).alias("plan"))
    empty = F.lit(None)
    types = {f.name: f.dataType for f in rows.schema} | {"plan": ahead.schema["plan"].dataType}
    both = ahead.select("conv_id", "plan", empty.cast(types["turn"]).alias("turn"),
                        empty.cast("string").alias("role"), empty.cast("string").alias("text")
                        ).unionByName(rows.select("conv_id", empty.cast(types["plan"]).alias("plan"),
                                                  "turn", "role", "text"))
    return (both.withColumn("digest", _digest(F.col("text")))
            .repartition(partitions_of(rows.sparkSession), "conv_id")
            .sortWithinPartitions("conv_id", F.col("plan").isNull(), "turn", "role", "digest")
            .select("conv_id", "plan", "role", "text"))


def _edited(batches: Iterator[pa.RecordBatch]):
    """Events of the sorted rows: ("plan", conv, plan), then a ("turn", edit,
    role, text) for each repaired turn, then ("end",)."""
    conv = audit = None
    at, state = 0, START

    def inserts():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state, at = _AFTER_INSERT[state], at + 1
            yield "turn", "I", _ROLE[state], ""

    for batch in batches:
        for c, plan, role, text in zip(*(batch.column(x).to_pylist()
                                         for x in ("conv_id", "plan", "role", "text"))):
            if plan is not None:
                if audit is not None:
                    yield from inserts()
                    yield ("end",)
                conv, audit, at, state = c, plan["audit"], 0, START
                yield "plan", conv, plan
                continue
            yield from inserts()
            edit, at = audit[at], at + 1
            if edit == "R":
                state = _AFTER_INSERT[state]
                yield "turn", edit, _ROLE[state], text
            elif edit == "K":
                initial = CLASSES.find(role[:1])
                state = (SYSTEM, USER, ASSISTANT)[initial]
                yield "turn", edit, role, text
    if audit is not None:
        yield from inserts()
        yield ("end",)


def _turn_rows(batches, kind):
    rows, conv, place = [], None, 0

    def batch_of():
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), (kind, pa.int64(), pa.string(),
                                                         pa.string(), pa.string()))],
            names=["conv_id", "place", "edit", "role", "text"])

    for event in _edited(batches):
        if event[0] == "plan":
            conv, place = event[1], 0
        elif event[0] == "turn":
            rows.append((conv, place, *event[1:]))
            place += 1
            if len(rows) >= 256:
                yield batch_of()
                rows = []
    if rows:
        yield batch_of()


def _digest_rows(batches, kind, columns):
    rows, held, first = [], None, True

    def batch_of():
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), (kind, *columns.values(), pa.string()))],
            names=["conv_id", *columns, "repaired_sha256"])

    for event in _edited(batches):
        if event[0] == "plan":
            held, first, head = hashlib.sha256(), True, event[1:]
        elif event[0] == "turn":
            held.update(f"{'' if first else chr(10)}{event[2]}:{event[3]}".encode())
            first = False
        else:
            rows.append((head[0], *[head[1][c] for c in columns], held.hexdigest()))
            if len(rows) >= 1000:
                yield batch_of()
                rows = []
    if rows:
        yield batch_of()


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def repaired_turns(rows: DataFrame, plans: DataFrame, conv_col: str = "conv_id",
                   turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit, role, text.
    Inserted turns have the empty text; a conversation whose turns are all
    deleted has no rows."""
    plain = _plain(rows, conv_col, turn_col, role_col, text_col)
    kind, arrow = plain.schema["conv_id"].dataType, _arrow(plain.schema["conv_id"].dataType)
    return _in_order(plain, plans).mapInArrow(
        lambda batches: _turn_rows(batches, arrow),
        f"conv_id {kind.simpleString()}, place bigint, edit string, role string, text string")


def repaired_digests(rows: DataFrame, plans: DataFrame, conv_col: str = "conv_id",
                     turn_col: str = "turn", role_col: str = "role",
                     text_col: str = "text") -> DataFrame:
    """Every plan with repaired_sha256: the SHA-256 of its repaired turns as
    ``role:text`` lines joined by newlines; plans without turns keep the digest
    of the empty string."""
    plain = _plain(rows, conv_col, turn_col, role_col, text_col)
    kind = plain.schema["conv_id"].dataType
    kept = {f.name: f.dataType for f in plans.schema if f.name != "conv_id"}
    arrow, columns = _arrow(kind), {name: _arrow(t) for name, t in kept.items()}
    return _in_order(plain, plans).mapInArrow(
        lambda batches: _digest_rows(batches, arrow, columns),
        f"conv_id {kind.simpleString()}, "
        + ", ".join(f"`{n}` {t.simpleString()}" for n, t in kept.items())
        + ", repaired_sha256 string")


def repair_damaged(rows: DataFrame) -> DataFrame:
    """Damage every conversation, repair it, and digest the result: the columns
    of ``repair_plans`` and repaired_sha256 for every conv_id of ``rows``.

    A conversation without rows after the damage has zeros, an empty audit and
    the digest of the empty string.
    """
    cuts = Cuts(rows.sparkSession, "conversation-repair")
    broken = damage(rows)
    found = cuts.cut(repair_plans(broken), "plans").withColumnRenamed("conv_id", "c")
    ids = rows.select("conv_id").distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    plans = ids.join(found, ids["conv_id"].eqNullSafe(found["c"]), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"))
    return repaired_digests(broken, plans)
