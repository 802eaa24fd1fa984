"""Byte-level BPE: encoding with a segment tree over byte positions, and decoding.

For one pre-token, the tree's leaves are its byte positions; a leaf holds the rank of the pair that starts
there (the token at that place and the next live one), and each inner node the least rank below it with its
leftmost place. The root names the next merge. A merge joins two live neighbours and changes at most three
leaves, each a logarithmic update, so a pre-token of n bytes costs O(n log n) however long it is.

A pre-token that the vocabulary holds as a whole is that token. Pre-tokens repeat, so a bounded dictionary
keeps their ids; it never decides a result.

Defined results: a null or empty text has no ids and decodes to nothing. Repeated rows get the same ids each.
An empty table gives an empty
result. Other columns are not read. Each document is read where it lies: no shuffle.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEVER = 1 << 80
CACHE_ENTRIES = 300_000
#: Children of a node of the segment tree.
FAN = 16
#: Documents that are encoded at a time.
SLICE = 256


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of one byte string, by merges of the leftmost pair of least rank until no pair has one.

    A tree node is one number: the rank, and below it the place; least is then also leftmost. A node has FAN children,
    so that the least of them is one call of `min`, and a short piece is one node."""
    n = len(piece)
    if n < 2:
        return [piece]
    get, shift = ranks.get, n.bit_length()
    mask = (1 << shift) - 1
    leaves = [NEVER] * (n - 1)
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            leaves[i] = rank << shift | i
    tree = [leaves]
    while len(tree[-1]) > FAN:
        below = tree[-1]
        tree.append([min(below[k : k + FAN]) for k in range(0, len(below), FAN)])
    root, inner = tree[-1], tree[1:]
    tokens: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (top := min(root)) != NEVER:
        i = top & mask
        j = after[i]
        token = tokens[i] = tokens[i] + tokens[j]
        tokens[j] = None
        k = after[i] = after[j]
        leaves[i] = NEVER
        if j < n - 1:
            leaves[j] = NEVER
        if k < n:
            before[k] = i
            rank = get(token + tokens[k])
            if rank is not None:
                leaves[i] = rank << shift | i
        h = before[i]
        if h >= 0:
            rank = get(tokens[h] + token)
            leaves[h] = NEVER if rank is None else rank << shift | h
        if inner:
            changed = {h, i, j} if h >= 0 else {i, j}
            below = leaves
            for level in inner:
                changed = {x // FAN for x in changed if x // FAN < len(level)}
                for x in changed:
                    level[x] = min(below[x * FAN : x * FAN + FAN])
                below = level
    return [t for t in tokens if t is not None]


class Encoder(dict):
    """Pre-token to ids. As a dictionary it holds what has been looked up; when it is full, what it holds becomes the
    elder half, out of which entries that are used again come back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks, self.split, self.elder = ranks, regex.compile(pattern).findall, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.elder.get(word)
        if ids is None:
            piece, ranks = word.encode(), self.ranks
            rank = ranks.get(piece)
            ids = (rank,) if rank is not None else tuple([ranks[t] for t in merge(piece, ranks)])
        if len(word) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.elder = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.split(text))))


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: lines of a base-64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(read_ranks(path), pattern)


@lru_cache(maxsize=2)
def byte_table(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(path).items()}


def _id_lists(lists: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(lists) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the ids of each whole text. `path` is the vocabulary's place on every executor."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = [enc.encode(t) if t else [] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), _id_lists(ids)], names=["id", "ids"])

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, decoded): the bytes of each list of ids."""
    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = part.column("ids")
                flat, ends = ids.values[ids.offsets[0].as_py() : ids.offsets[-1].as_py()].to_numpy().tolist(), ids.offsets.to_numpy() - ids.offsets[0].as_py()
                out = [b"".join(map(table.__getitem__, flat[a:b])) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *[part.column(k) for k in keep], pa.array(out, pa.binary())],
                    names=["id", *keep, "decoded"],
                )

    kinds = dict(rows.dtypes)
    schema = ", ".join([f"id {kinds['id']}", *[f"`{k}` {kinds[k]}" for k in keep], "decoded binary"])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: id, n_tokens, ids_sha256 (of the decimal ids, joined by spaces), decoded_sha256."""
    ids = encode(df, path, pattern, id_col, text_col)
    ids = ids.withColumn("n_tokens", F.size("ids").cast("long")).withColumn(
        "ids_sha256", F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256)
    )
    out = decode(ids, path, id_col, keep=("n_tokens", "ids_sha256"))
    return out.select(id_col, "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
