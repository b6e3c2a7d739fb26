"""Token counts that follow edits.

Every document keeps a segment tree over its pre-tokens: a leaf holds a few
neighbouring pieces of the tokenizer's split with their lengths and token
counts, an inner node the sums of its half.  An edit finds its place by
descending the sums, splits the text again from the last piece that can depend
on the edited characters, stops where a new piece ends at an old boundary, and
replaces only the pieces between; the touched leaves' paths are summed anew.
The count of the edited text is the root, without encoding the rest again.

Context: a match of the split pattern starts at a piece boundary, reads nothing
before it and at most two characters beyond its own end (``'re`` and the
look-ahead after white space), so pieces ending before the character left of
the edit stay as they are, and after the edit all pieces stay from the first
common boundary on.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _FULL, _NOT_PLAIN, _PLAIN, Encoder, encoder, parts_of, split_pieces
from .common import slices, texts_of

LEAF = 32                   # pieces per leaf when a tree is built
EDITS = "array<struct<start:int,removed:int,inserted:string>>"


class PieceTree:
    """Segment tree over the pieces of one text."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self._build(chars, tokens)

    @classmethod
    def of(cls, text: str, enc: Encoder) -> PieceTree:
        pieces = [p for part in parts_of(text) for p in split_pieces(part)]
        return cls(list(map(len, pieces)), [len(enc.memo[p]) for p in pieces])

    def _build(self, chars: list[int], tokens: list[int]) -> None:
        self.chars = [chars[i:i + LEAF] for i in range(0, len(chars), LEAF)] or [[]]
        self.tokens = [tokens[i:i + LEAF] for i in range(0, len(tokens), LEAF)] or [[]]
        self.width = 1
        while self.width < len(self.chars):
            self.width *= 2
        self.sums = [(0, 0)] * (2 * self.width)
        for leaf in range(len(self.chars)):
            self.sums[self.width + leaf] = (sum(self.chars[leaf]), sum(self.tokens[leaf]))
        for node in range(self.width - 1, 0, -1):
            a, b = self.sums[2 * node], self.sums[2 * node + 1]
            self.sums[node] = (a[0] + b[0], a[1] + b[1])

    @property
    def n_chars(self) -> int:
        return self.sums[1][0]

    @property
    def n_tokens(self) -> int:
        return self.sums[1][1]

    def pieces(self) -> tuple[list[int], list[int]]:
        """Lengths and token counts of all pieces, which rebuild the tree."""
        return sum(self.chars, []), sum(self.tokens, [])

    def _leaf_reaching(self, at: int) -> tuple[int, int]:
        """First leaf that ends at or after ``at`` and where it starts."""
        node, start = 1, 0
        while node < self.width:
            left = self.sums[2 * node][0]
            if start + left >= at:
                node = 2 * node
            else:
                start += left
                node = 2 * node + 1
        return min(node - self.width, len(self.chars) - 1), start

    def _set_leaf(self, leaf: int, chars: list[int], tokens: list[int]) -> None:
        self.chars[leaf], self.tokens[leaf] = chars, tokens
        node = self.width + leaf
        self.sums[node] = (sum(chars), sum(tokens))
        node >>= 1
        while node:
            a, b = self.sums[2 * node], self.sums[2 * node + 1]
            self.sums[node] = (a[0] + b[0], a[1] + b[1])
            node >>= 1

    def edit(self, text: str, start: int, stop: int, inserted: str, enc: Encoder,
             matcher) -> tuple[str, int]:
        """Replace text[start:stop] by ``inserted``: the new text, and how many
        of its characters were split and encoded again."""
        new = text[:start] + inserted + text[stop:]
        grown, edit_end = len(new) - len(text), start + len(inserted)
        leaf, at = self._leaf_reaching(max(start - 1, 0))
        ends = list(accumulate(self.chars[leaf], initial=at))
        first = bisect_left(ends, start - 1, 1) - 1 if start > 0 else 0
        begin = ends[min(first, len(ends) - 1)]
        first = min(first, len(self.chars[leaf]))
        # old boundaries from ``begin`` on, leaf by leaf
        here, index, old = leaf, first, begin
        chars, tokens, done = [], [], begin
        for match in matcher.finditer(new, begin):
            chars.append(match.end() - match.start())
            tokens.append(len(enc.memo[match.group()]))
            done = match.end()
            if done < edit_end:
                continue
            while old < done - grown or old < stop:
                while here < len(self.chars) and index >= len(self.chars[here]):
                    here, index = here + 1, 0
                if here == len(self.chars):
                    break
                old += self.chars[here][index]
                index += 1
            if old == done - grown:
                break
        else:                       # no match reaches on: all that is left was replaced
            here, index = len(self.chars), 0
        if here >= len(self.chars):
            here, index = len(self.chars) - 1, len(self.chars[-1])
        head = self.chars[leaf][:first], self.tokens[leaf][:first]
        tail = self.chars[here][index:], self.tokens[here][index:]
        if here == leaf:
            self._set_leaf(leaf, head[0] + chars + tail[0], head[1] + tokens + tail[1])
        else:
            self._set_leaf(leaf, head[0] + chars, head[1] + tokens)
            for between in range(leaf + 1, here):
                self._set_leaf(between, [], [])
            self._set_leaf(here, *tail)
        if len(self.chars[leaf]) > 8 * LEAF:
            self._build(*self.pieces())
        return new, done - begin


def apply_edits(text: str, tree: PieceTree, edits: list[dict], enc: Encoder) -> tuple[str, int]:
    """Apply edits given in the positions of ``text``: the new text and the
    characters encoded again.  Places are clipped to the text; an edit that
    reaches into the next one ends where that starts; of edits at one place
    the given order is the order of their insertions."""
    work, plain = 0, not _NOT_PLAIN.search(text)
    limit = len(text)
    order = sorted(range(len(edits)), key=lambda i: (edits[i]["start"] or 0, i), reverse=True)
    for i in order:
        start = min(max(edits[i]["start"] or 0, 0), limit)
        stop = min(start + max(edits[i]["removed"] or 0, 0), limit)
        inserted = edits[i]["inserted"] or ""
        limit = start
        if start == stop and not inserted:
            continue
        plain = plain and not _NOT_PLAIN.search(inserted)
        text, redone = tree.edit(text, start, stop, inserted, enc, _PLAIN if plain else _FULL)
        work += redone
    return text, work


def _counted(batches: Iterator[pa.RecordBatch], rank_file: bytes, keep: bool, stored: bool):
    enc = encoder(rank_file)
    for batch in slices(batches, 256):
        edits = batch.column("edits").to_pylist()
        trees = (zip(batch.column("piece_chars").to_pylist(),
                     batch.column("piece_tokens").to_pylist()) if stored else None)
        out = []
        for raw, changes in zip(texts_of(batch), edits):
            text = raw.decode("utf-8", "replace")
            tree = PieceTree(*next(trees)) if stored else PieceTree.of(text, enc)
            before, chars = tree.n_tokens, tree.n_chars
            text, work = apply_edits(text, tree, changes or [], enc)
            row = [before, tree.n_tokens, chars, tree.n_chars, work]
            out.append(row + [text, *tree.pieces()] if keep else row)
        kinds = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())] * keep
        columns = zip(*out) if out else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
            names=["doc_id", *_COUNTS, *_STATE[:3 * keep]])


_COUNTS = ["n_tokens", "n_tokens_edited", "n_chars", "n_chars_edited", "chars_reencoded"]
_STATE = ["text", "piece_chars", "piece_tokens"]


def count_with_edits(docs: DataFrame, rank_path: str, edits: str = "edits",
                     id_col: str = "doc_id", text_col: str = "text",
                     keep_trees: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens and n_chars of the text,
    n_tokens_edited and n_chars_edited after the edits of column ``edits``
    (array of start, removed, inserted), chars_reencoded; with ``keep_trees``
    also the edited text and its tree's leaves (piece_chars, piece_tokens).

    Where ``docs`` has piece_chars and piece_tokens from such a run, the trees
    are rebuilt from them and the text is not encoded again.  Null and empty
    texts have no tokens, null edits change nothing, repeated rows give
    repeated results, an empty table none.  A text is counted where it is read;
    nothing shuffles.
    """
    spark = docs.sparkSession
    with open(rank_path, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())
    stored = {"piece_chars", "piece_tokens"} <= set(docs.columns)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.col(edits).cast(EDITS).alias("edits"),
                       *["piece_chars", "piece_tokens"] * stored)
    schema = ", ".join([f"doc_id {kind}", *[f"{c} bigint" for c in _COUNTS]])
    if keep_trees:
        schema += ", text string, piece_chars array<int>, piece_tokens array<int>"
    return rows.mapInArrow(lambda batches: _counted(batches, held.value, keep_trees, stored),
                           schema)


def cleaning_edits(text: str = "text", source: str = "source"):
    """Edits that a cleaning pass would make, derived from each row: a mark put
    in at a quarter of the text, eight characters in its middle replaced by the
    source's name, and a line end added."""
    n = f"coalesce(char_length(`{text}`), 0)"
    return F.expr(
        f"array(named_struct('start', cast({n} div 4 as int), 'removed', 0, "
        f"'inserted', ' [checked] '), "
        f"named_struct('start', cast({n} div 2 as int), 'removed', 8, "
        f"'inserted', coalesce(`{source}`, '')), "
        f"named_struct('start', cast({n} as int), 'removed', 0, 'inserted', '\\n'))").cast(EDITS)
