"""Byte-level BPE encoding and decoding with a public rank file.

A text is split by the tokenizer's pattern; each piece is merged on its own.
The merges of a piece run on a segment tree over its byte positions: leaf i
holds the rank of the pair that starts at i, every inner node the leftmost
minimum below it, so the root names the next merge and a merge is three point
updates (the merged pair, its right part, its live left neighbour), each
logarithmic in the piece's length.

The rank file is the driver's parameter; its bytes (under a megabyte) travel
as a broadcast variable, so executors need no copy of it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices, texts_of

#: The split pattern of the public rank files.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same split for the built-in matcher, valid for characters up to U+024F
#: without the information separators and the Latin-1 superscripts and fractions.
_SPACE = "\\t-\\r \\x85\\xa0"
_PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w{_SPACE}]|_)+"
                    rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_NOT_PLAIN = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")
_FULL = regex.compile(PATTERN)

CACHE_PIECES = 200_000      # pieces per generation of a worker's memo; two are held
PART_CHARS = 1 << 20        # a longer text is split and merged part by part
NO_PAIR = 1 << 62


def split_pieces(text: str) -> list[str]:
    """The matches of PATTERN in order."""
    return (_FULL if _NOT_PLAIN.search(text) else _PLAIN).findall(text)


def parts_of(text: str) -> Iterator[str]:
    """A long text in parts: a cut falls before a space that follows a
    non-space, where every match of the pattern ends."""
    at = 0
    while len(text) - at > PART_CHARS:
        cut = text.find(" ", at + PART_CHARS)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Token ids of one piece, merging the leftmost pair of least rank first."""
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    width = 1
    while width < n:
        width *= 2
    tree = [NO_PAIR] * (2 * width)
    get = ranks.get
    for i in range(n - 1):
        rank = get(piece[i:i + 2])
        if rank is not None:
            tree[width + i] = rank * width + i
    for node in range(width - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    end = list(range(1, n + 1))         # end[i]: where the token that starts at i ends
    start = list(range(-1, n))          # start[i]: where the token that ends at i starts
    while tree[1] != NO_PAIR:
        left = tree[1] % width
        right = end[left]
        stop = end[right]
        end[left] = stop
        start[stop] = left
        places = [(right, NO_PAIR), (left, NO_PAIR)]
        if stop < n:
            rank = get(piece[left:end[stop]])
            if rank is not None:
                places[1] = (left, rank * width + left)
        if left > 0:
            before = start[left]
            rank = get(piece[before:stop])
            places.append((before, NO_PAIR if rank is None else rank * width + before))
        for place, value in places:
            node = width + place
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    break
                tree[node] = least
                node >>= 1
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at:end[at]]])
        at = end[at]
    return tuple(ids)


class Memo(dict):
    """Ids of the pieces seen last, in two generations of bounded size."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.old = ranks, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            ids = merge(piece.encode(), self.ranks)
        if len(self) >= CACHE_PIECES:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """Encodes and decodes with one rank file, given as its bytes."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in
                      (line.split() for line in rank_file.splitlines() if line)}
        self.token = dict(zip(self.ranks.values(), self.ranks))
        self.name = {rank: str(rank) for rank in self.token}
        self.memo = Memo(self.ranks)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, split_pieces(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_encoders: dict[bytes, Encoder] = {}


def encoder(rank_file: bytes) -> Encoder:
    """The worker's encoder for a rank file, kept between tasks."""
    key = hashlib.sha256(rank_file).digest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(rank_file)
    return _encoders[key]


def _encoded(batches: Iterator[pa.RecordBatch], rank_file: bytes, with_ids: bool):
    enc = encoder(rank_file)
    for batch in slices(batches, 256):
        counts, ids_sha, text_sha, all_ids = [], [], [], []
        for raw in texts_of(batch):
            n, named, decoded, kept = 0, hashlib.sha256(), hashlib.sha256(), []
            for part in parts_of(raw.decode("utf-8", "replace")):
                ids = enc.encode(part)
                if n and ids:
                    named.update(b",")
                named.update(",".join(map(enc.name.__getitem__, ids)).encode())
                decoded.update(enc.decode(ids))
                n += len(ids)
                if with_ids:
                    kept += ids
            counts.append(n)
            ids_sha.append(named.hexdigest())
            text_sha.append(decoded.hexdigest())
            all_ids.append(kept)
        columns = [batch.column("doc_id"), pa.array(counts, pa.int64()),
                   pa.array(ids_sha), pa.array(text_sha)]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            columns.append(pa.array(all_ids, pa.list_(pa.int32())))
            names.append("token_ids")
        yield pa.RecordBatch.from_arrays(columns, names=names)


def encode_documents(docs: DataFrame, rank_path: str, id_col: str = "doc_id",
                     text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256 (of the decimal ids
    joined by commas), decoded_sha256 (of the bytes that the ids decode to)
    and, with ``with_ids``, token_ids.

    Null and empty texts have no tokens and the digests of no bytes; repeated
    rows give repeated results; an empty table gives no rows.  Only the two
    named columns are read.  No shuffle: a text is encoded where it is read.
    """
    with open(rank_path, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(
        lambda batches: _encoded(batches, held.value, with_ids),
        schema + (", token_ids array<int>" if with_ids else ""))


def _decoded(batches: Iterator[pa.RecordBatch], rank_file: bytes):
    enc = encoder(rank_file)
    for batch in slices(batches, 256):
        texts = [enc.decode(ids or []).decode("utf-8", "replace")
                 for ids in batch.column("token_ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())],
                                         names=["doc_id", "text"])


def decode_documents(encoded: DataFrame, rank_path: str) -> DataFrame:
    """(doc_id, text) of rows with token_ids; null ids give the empty text."""
    with open(rank_path, "rb") as f:
        held = encoded.sparkSession.sparkContext.broadcast(f.read())
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "token_ids").mapInArrow(
        lambda batches: _decoded(batches, held.value), f"doc_id {kind}, text string")
