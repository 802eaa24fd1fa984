"""A hashed maximum-entropy language model with a class-factored softmax.

P(token | history) = P(class | history) * P(token | class, history), both trained by gradients on the same features:
the previous word, the previous two (n-grams), and the words two and three back (skips).

A word's class is its last two bytes, where these are among the most frequent; other words share a class, and
the end of a text has one. The class law is a softmax over rows of weights, one row per hashed feature. Within a class the
law is a softmax in steps: a Huffman tree over the class's words by their counts, at each node of which the
features choose a side. Its weights lie in blocks of 16 cells: a block is hashed from a feature and the node at which
four levels of the tree begin, and the node's place in these four levels is its cell, so a step seldom leaves a line of
memory. Without weights both laws are those of the counts. Rare words stand behind one leaf of their class and share its
mass by their counts, with room for one unseen word.

Training reads all training texts. They are turned into ids once, by counts aggregated in Spark; the ids are written and
read again by training and scoring. In each round a share of the partitions runs gradient updates (Adagrad, small batches)
over its texts from the round's weights, and emits its changes; these are averaged, each weight by the squared gradients
that it got, in a tree of bounded fan-in. Both tables of weights grow with the training tokens, up to what an
executor holds (`table_sizes`); the changes come from at most TRAINERS tasks. The driver holds the model: at most HEAD
words and tables of these sizes.

Scoring runs over sparse batches of feature rows in numpy. Words outside the head are looked up by a join with the full
table of counts; such words are rare by definition, so that join has no hot key.

Defined results: a null or empty text is its end alone. A null id counts as the empty text for the choice of training
documents. Rows repeated are trained on and scored each. Without training tokens every token has the law of the
untrained model. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import Scratch, byte_slices, keep_freed_memory, text_or_empty

#: Most words of the head; rarer words are looked up by a join.
HEAD = 1 << 17
CLASSES = 32
OTHER, END_CLASS = CLASSES - 2, CLASSES - 1
ROUNDS, BATCH, RATE, CELL_RATE = 2, 2048, 0.15, 0.05
TRAINERS, BLOCKS, FAN = 256, 64, 32
#: Different words that a part holds before it passes their counts on.
COUNTED = 1_000_000
SLICE_BYTES = 8 << 20
#: Texts whose tokens are dealt into batches together; batches do not go across, so this sets the gradient steps.
TRAINED = 512
#: Of Adagrad's sums of squares, at the start: of rows, and of cells.
FIRST_SQUARE, FIRST_CELL = 1e-3, 1.0
#: Log odds are taken as no further from zero than this in training: probabilities stay clear of numbers so small that
#: arithmetic with them is slow.
FAR = 30.0
#: Levels of the tree that share a block of cells; tokens whose steps are taken at a time.
LEVELS, STEPS = 4, 512
#: Stretches of the tree that are scored at a time, so that what is at work stays in a core's cache.
STRETCHES = 2048
#: What is laid out of each stretch; the bias where a path has ended before its last stretch does: such a step costs nothing.
LAID, NO_STEP = 3 * LEVELS + 1, -200.0


def table_sizes(tokens: int) -> tuple[int, int]:
    """(rows of class weights, cells of tree weights), powers of two: about one row for 4,096 training tokens and one cell for
    128, between what any corpus gets and what an executor may hold beside its data (8 and 16 MB, and twice that in training)."""
    fit = lambda n, low, high: min(max(int(n).bit_length(), low), high)
    return 1 << fit(tokens // 4096, 13, 16), 1 << fit(tokens // 128, 17, 22)


# ------------------------------------------------------------------ words
def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and the places at which each text's begin. Only A to Z are lowered; only space and tab to
    return part words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    flat, ends = lists.flatten(), lists.offsets.to_numpy()
    real = pc.not_equal(flat, "")
    return flat.filter(real), np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))][ends - ends[0]]


def suffixes(words: pa.Array) -> np.ndarray:
    """A number for the last two bytes of each word (of a word of one byte, for that byte)."""
    if not len(words):
        return np.zeros(0, dtype=np.int64)
    raw = words.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], dtype=np.uint8)
    last, long = data[ends[1:] - 1].astype(np.int64), np.diff(ends) > 1
    return np.where(long, data[np.maximum(ends[1:] - 2, 0)].astype(np.int64) * 256 + last, 65536 + last)


def suffix_number(key: bytes) -> int:
    return key[0] * 256 + key[1] if len(key) > 1 else 65536 + key[0]


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over the texts; words only, as bytes. A part's counts are summed before they travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).select(["word", "c_sum"]).rename_columns(["word", "c"])

        for batch in batches:
            for at, to in byte_slices(batch.column("text"), SLICE_BYTES):
                words, _ = split_words(batch.column("text")[at:to])
                found = pc.value_counts(words)
                held.append(pa.table({"word": found.field("values").cast(pa.binary()), "c": found.field("counts")}))
                rows += len(found)
                if rows > COUNTED:
                    held, rows = [summed()], 0
                    if held[0].num_rows > COUNTED // 2:
                        yield from held[0].combine_chunks().to_batches()
                        held = []
        if held:
            yield from summed().combine_chunks().to_batches()

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def suffix_class(word: Column, keys: dict[bytes, int]) -> Column:
    table = F.create_map(*[F.lit(x) for k in keys.items() for x in k]) if keys else F.create_map().cast("map<binary,int>")
    return F.coalesce(F.try_element_at(table, F.substring(word, -2, 2)), F.lit(OTHER))


@dataclass
class Counts:
    """The counts of words outside the head, and a bounded summary of all."""

    table: DataFrame
    head: list[tuple[bytes, int]]
    keys: dict[bytes, int]
    tokens: int
    types: int
    ends: int
    rare: dict[int, tuple[int, int]]  # class: (tokens, types) of words outside the head

    @property
    def whole(self) -> float:
        return self.tokens + 0.5 * (self.types + 1)


def least_of_head(counts: DataFrame, most: int) -> int:
    """The least count of the words of the head: as many as there are, or at most `most`. From a histogram by 16 steps to
    each doubling, so that no more than the head reaches the driver."""
    step = F.floor(F.log2("c") * 16).cast("int")
    held, least = 0, None
    for r in sorted(counts.groupBy(step.alias("b")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect(), key=lambda r: -r["b"]):
        held += r["n"]
        if held > most:
            break
        least = r["c"]
    return 1 << 62 if least is None else least


def count(scratch: Scratch, texts: DataFrame, most: int) -> Counts:
    counts = scratch.table(word_counts(texts))
    ends = texts.count()
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least = least_of_head(counts, most)
    head = sorted(((bytes(r[0]), r[1]) for r in counts.where(F.col("c") >= least).collect()), key=lambda x: (-x[1], x[0]))
    by_suffix = counts.groupBy(F.substring("word", -2, 2).alias("k")).agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "k").limit(OTHER)
    keys = {bytes(r[0]): k for k, r in enumerate(by_suffix.collect())}
    tail = counts.where(F.col("c") < least)
    grouped = tail.groupBy(suffix_class(F.col("word"), keys).alias("k")).agg(F.sum("c"), F.count("*"))
    rare = {r[0]: (r[1], r[2]) for r in grouped.collect()}
    return Counts(tail, head, keys, total + ends, types + (ends > 0), ends, rare)


# ------------------------------------------------------------------ the model
@dataclass
class Model:
    """All that training and scoring need. Ids: head words by falling count, the end, the start, the rare word of each class."""

    words: pa.Array
    by_suffix: np.ndarray  # class by suffix number
    cls: np.ndarray  # class of each id
    base: np.ndarray  # of head words and the end: natural log of the unigram law
    start: np.ndarray  # each id's path in nodes and bits, and its length
    size: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    first_stretch: np.ndarray  # each id's first stretch of LEVELS steps, and how many it has
    stretches: np.ndarray
    laid: np.ndarray  # (stretches, LAID): of each stretch what its steps need, in one place of memory; see `laid_out`
    bias: np.ndarray  # of classes
    node_bias: np.ndarray
    weights: np.ndarray  # (rows, CLASSES)
    cells: np.ndarray

    @property
    def end(self) -> int:
        return len(self.words)

    @property
    def first(self) -> int:
        """The id before the first word of a text."""
        return len(self.words) + 1

    def rare(self, words: pa.Array) -> np.ndarray:
        return len(self.words) + 2 + self.by_suffix[suffixes(words)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(ids of all words, where each text's begin, the words)."""
        flat, offsets = split_words(column)
        coded = flat.dictionary_encode()
        found = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        unknown = np.flatnonzero(found < 0)
        found[unknown] = self.rare(coded.dictionary.take(pa.array(unknown)))
        return found[coded.indices.to_numpy()] if len(flat) else np.zeros(0, dtype=np.int64), offsets, flat


def tree(mass: list[float]) -> tuple[list[list[tuple[int, int]]], list[float]]:
    """Huffman's tree over leaves of these masses: each leaf's path of (node, side) from the root, and for each node the log
    of the odds of side 1."""
    n = len(mass)
    heap = [(x, k) for k, x in enumerate(mass)]
    heapq.heapify(heap)
    parent, side, odds = [0] * (2 * n - 1), [0] * (2 * n - 1), []
    for node in range(n, 2 * n - 1):
        (x, a), (y, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a], parent[b], side[b] = node, node, 1
        odds.append(float(np.log(y / x)))
        heapq.heappush(heap, (x + y, node))
    paths: list[list[tuple[int, int]]] = [[] for _ in range(2 * n - 1)]
    for k in range(2 * n - 3, -1, -1):
        paths[k] = [*paths[parent[k]], (parent[k] - n, side[k])]
    return paths[:n], odds


def laid_out(nodes: np.ndarray, sides: np.ndarray, depth: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Paths by stretches of LEVELS steps: of each step the bias of the side that is not taken, its sign (1 where side 0 is taken,
    -1 where side 1 is) and its place in the block, then a hash of the stretch's first node. Where a path ends before its last
    stretch does, the bias is NO_STEP, the sign 0, and the place 0, a cell that no step has."""
    level = depth % LEVELS
    stretch = np.cumsum(level == 0) - 1
    out = np.zeros((int(np.sum(level == 0)), LAID), dtype=np.int32)
    lean, signs, slots = out[:, :LEVELS].view(np.float32), out[:, LEVELS : 2 * LEVELS].view(np.float32), out[:, 2 * LEVELS : -1]
    lean[:] = NO_STEP
    signs[stretch, level] = 1 - 2 * sides
    lean[stretch, level] = bias[nodes] * signs[stretch, level]
    for k in range(LEVELS):  # a step's place is told by the sides taken before it in its stretch
        slots[:, k] = np.where(signs[:, k] == 0, 0, 2 * slots[:, k - 1] + (signs[:, k - 1] < 0) if k else 1)
    out[:, -1] = (nodes[level == 0].astype(np.uint32) * np.uint32(0xB66859FD)).view(np.int32)
    return out


def fresh_model(n: Counts) -> Model:
    head = len(n.head)
    by_suffix = np.full(65536 + 256, OTHER, dtype=np.int64)
    for k, c in n.keys.items():
        by_suffix[suffix_number(k)] = c
    words = pa.array([w for w, _ in n.head], pa.binary()).cast(pa.string())
    cls = np.concatenate([by_suffix[suffixes(words)], [END_CLASS, END_CLASS], np.arange(CLASSES)])
    rare = [n.rare.get(c, (0, 0)) for c in range(CLASSES)]
    mass = np.array([*[c for _, c in n.head], n.ends + 0.5, 0, *[t + 0.5 * (k + 1) for t, k in rare]], dtype=float)
    mass[head + 2 + END_CLASS] = 0  # no word has this class
    leaves = np.flatnonzero(mass > 0)
    paths: list[list[tuple[int, int]]] = [[] for _ in mass]
    odds: list[float] = []
    for c in range(CLASSES):
        own = leaves[cls[leaves] == c]
        found, more = tree(mass[own].tolist())
        for k, path in zip(own.tolist(), found, strict=True):
            paths[k] = [(node + len(odds), side) for node, side in path]
        odds += more
    size = np.array([len(x) for x in paths], dtype=np.int64)
    steps = np.array([x for path in paths for x in path], dtype=np.int64).reshape(-1, 2)
    depth = np.arange(len(steps)) - np.repeat(np.cumsum(size) - size, size)
    bias, stretches = np.array(odds, dtype=np.float32), -(-size // LEVELS)
    laid = laid_out(steps[:, 0], steps[:, 1], depth, bias)
    of_class = np.bincount(cls, weights=mass, minlength=CLASSES)
    base = np.log((np.array([*[c for _, c in n.head], n.ends]) + 0.5) / n.whole)
    rows, cells = table_sizes(n.tokens)
    return Model(
        words, by_suffix, cls, base, np.cumsum(size) - size, size, steps[:, 0].astype(np.int32), steps[:, 1].astype(np.int8), np.cumsum(stretches) - stretches, stretches, laid,
        np.log(of_class / of_class.sum()).astype(np.float32), bias, np.zeros((rows, CLASSES), dtype=np.float32), np.zeros(cells, dtype=np.float32),
    )


def feature_hashes(ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """(features, tokens): hashes of the features of the histories at `places`."""
    one, two, three = (ids[places - k].astype(np.uint64) for k in (1, 2, 3))
    p, q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    out = np.stack((one * p + np.uint64(1), (one * p) ^ (two * q + np.uint64(2)), two * q + np.uint64(3), three * p * q + np.uint64(4)))
    out ^= out >> np.uint64(29)
    out *= np.uint64(0x165667B19E3779F9)
    return out


def class_rows(hashes: np.ndarray, rows: int) -> np.ndarray:
    return (hashes >> np.uint64(65 - rows.bit_length())).astype(np.int64)


def class_logits(bias: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Logits of the classes, each token's less its largest where that is needed to keep exp() in range."""
    out = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        out += weights.take(r, axis=0)
    out += bias
    if out.max(initial=0) > FAR or out.min(initial=0) < -FAR:
        out -= out.max(axis=1, keepdims=True)
    return out


def cell_of(row: np.ndarray, column: np.ndarray, width: int) -> np.ndarray:
    at = row * width
    at += column
    return at


class Steps:
    """The steps of a tree to the ids `now`, by stretches of LEVELS. A stretch has one block of cells for each feature, so that
    is hashed once."""

    def __init__(self, m: Model, cells: int, hashes: np.ndarray, now: np.ndarray):
        size = m.stretches.take(now)
        self.ends = np.cumsum(size)
        self.token = np.repeat(np.arange(len(now)), size)
        at = (m.first_stretch.take(now) - self.ends + size).take(self.token)
        at += np.arange(len(at))
        self.laid = m.laid.take(at, axis=0)
        mixed = hashes.take(self.token, axis=1)
        mixed ^= self.laid[:, -1].view(np.uint32)
        mixed *= np.uint32(0x9E3779B1)
        mixed >>= np.uint32(33 + LEVELS - cells.bit_length())
        self.block = mixed.astype(np.int64)
        self.block <<= LEVELS

    def some(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the stretches a to b: (features, LEVELS, stretches) cells, (LEVELS, stretches) biases and signs."""
        laid = self.laid[a:b].T
        kinds = laid[:LEVELS].view(np.float32), laid[LEVELS : 2 * LEVELS].view(np.float32)
        return self.block[:, None, a:b] | laid[2 * LEVELS : -1].astype(np.int64, order="C"), *kinds


def tree_scores(m: Model, hashes: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Natural log-probability of each id within its class."""
    steps = Steps(m, len(m.cells), hashes, now)
    loss = np.empty(len(steps.token), dtype=np.float32)
    for a in range(0, len(loss), STRETCHES):
        cell, lean, signs = steps.some(a, a + STRETCHES)
        odds = m.cells.take(cell).sum(axis=0)  # of the side that is not taken
        odds *= signs
        odds += lean
        worst = np.maximum(odds, 0).sum(axis=0)
        np.abs(odds, out=odds)
        np.negative(odds, out=odds)
        np.exp(odds, out=odds)
        odds += 1
        worst += np.log(odds.prod(axis=0))
        loss[a : a + STRETCHES] = worst
    return np.bincount(steps.token, weights=-loss, minlength=len(now))


def train_tree(m: Model, pairs: np.ndarray, hashes: np.ndarray, now: np.ndarray) -> None:
    """A step of Adagrad on the cells for every STEPS tokens, in place. `pairs`: weight and sum of squares as one complex number,
    so that both are in one place."""
    steps = Steps(m, len(pairs), hashes, now)
    a = 0
    for b in [*steps.ends[STEPS - 1 : -1 : STEPS].tolist(), len(steps.token)]:
        cell, lean, signs = steps.some(a, b)
        held = pairs.take(cell)
        odds = held.real.sum(axis=0)  # of the side that is not taken
        odds *= signs
        odds += lean
        np.clip(odds, -FAR, FAR, out=odds)
        np.negative(odds, out=odds)
        np.exp(odds, out=odds)
        odds += 1
        slope = signs / odds
        square = slope * slope
        change = np.empty(held.shape, dtype=np.complex64)
        root = np.sqrt(held.imag + square)
        slope *= -CELL_RATE
        np.divide(slope, root, out=change.real)
        change.imag = square
        np.add.at(pairs, cell.ravel(), change.ravel())
        a = b


def folded(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(16)).astype(np.uint32)


def row_gradients(z: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their summed gradients) of the tokens' gradients z. Rows of one token, which most are, need no sum."""
    flat = rows.ravel().astype(np.uint16)
    order = np.argsort(flat, kind="stable")
    ordered = flat.take(order)
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    n = np.diff(np.r_[first, len(order)])
    alone, several = first[n == 1], first[n > 1]
    order %= len(z)
    grad = np.empty((len(first), z.shape[1]), dtype=z.dtype)
    z.take(order.take(alone), axis=0, out=grad[: len(alone)], mode="clip")
    if len(several):
        more = n[n > 1]
        summed = z.take(order[np.repeat(n > 1, n)], axis=0)
        # two columns are added at once, as one complex number
        grad[len(alone) :] = np.add.reduceat(summed.view(np.complex64), np.cumsum(more) - more, axis=0).view(z.dtype)
    return ordered.take(np.concatenate([alone, several])).astype(np.int64), grad


def token_scores(m: Model, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Natural log-probability of each id at `places` given those before."""
    out = np.empty(len(places))
    for at in range(0, len(places), BATCH):
        here = places[at : at + BATCH]
        hashes, now = feature_hashes(ids, here), ids[here]
        z = class_logits(m.bias, m.weights, class_rows(hashes, len(m.weights)))
        taken = z.ravel().take(cell_of(np.arange(len(here)), m.cls.take(now), CLASSES))
        out[at : at + BATCH] = taken - np.log(np.einsum("ij->i", np.exp(z, out=z))) + tree_scores(m, folded(hashes), now)
    return out


def _gather(first: int, lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Id lists joined, each led by three starts; the places of tokens in them, and the list of each place."""
    lead = np.full(3, first, dtype=np.int32)
    ids = np.concatenate([x for one in lists for x in (lead, one)]) if lists else lead
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    owner = np.repeat(np.arange(len(lists)), sizes)
    return ids, np.arange(len(owner)) + 3 * (owner + 1), owner


def _id_lists(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<i4") for x in column.to_pylist()]


# ------------------------------------------------------------------ training
UPDATE_DDL = "part long, block int, rows binary, row_squares binary, cells binary, cell_squares binary"


def _blocks(n: int) -> list[slice]:
    return [slice(b * n // BLOCKS, (b + 1) * n // BLOCKS) for b in range(BLOCKS)]


def _half(x: np.ndarray) -> bytes:
    return x.astype(np.float16).tobytes()


def train_batch(m: Model, weights: np.ndarray, squares: np.ndarray, pairs: np.ndarray, ids: np.ndarray, here: np.ndarray) -> None:
    """One step of Adagrad on the rows, and one for every STEPS tokens on the cells, in place."""
    hashes, now = feature_hashes(ids, here), ids[here]
    rows = class_rows(hashes, len(weights))
    z = class_logits(m.bias, weights, rows)
    np.maximum(z, -FAR, out=z)
    np.exp(z, out=z)
    z /= np.einsum("ij->i", z)[:, None]
    z.ravel()[cell_of(np.arange(len(here)), m.cls.take(now), CLASSES)] -= 1
    hit, grad = row_gradients(z, rows)
    square = squares.take(hit) + np.einsum("ij,ij->i", grad, grad) / CLASSES
    squares[hit] = square
    grad *= (RATE / np.sqrt(square))[:, None]
    weights[hit] = np.subtract(weights.take(hit, axis=0), grad, out=grad)
    train_tree(m, pairs, folded(hashes), now)


def local_updates(held: Broadcast, turn: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition's gradient updates in its turn: a row for each block of the tables."""
    part = TaskContext.get().partitionId()
    if part % ROUNDS != turn:
        return
    keep_freed_memory()
    m: Model = held.value
    weights, squares = m.weights.copy(), np.full(len(m.weights), FIRST_SQUARE, dtype=np.float32)
    pairs = (m.cells + np.float32(FIRST_CELL) * np.complex64(1j)).astype(np.complex64)
    trained = False
    for batch in batches:
        for at in range(0, batch.num_rows, TRAINED):
            ids, places, _ = _gather(m.first, _id_lists(batch.column("ids")[at : at + TRAINED]))
            for k in range(0, len(places), BATCH):
                train_batch(m, weights, squares, pairs, ids, places[k : k + BATCH])
                trained = True
    if not trained:
        return
    for b, (r, c) in enumerate(zip(_blocks(len(weights)), _blocks(len(pairs)), strict=True)):
        yield pa.RecordBatch.from_pylist(
            [
                {
                    "part": part // ROUNDS, "block": b, "rows": _half(weights[r] - m.weights[r]), "row_squares": _half(np.sqrt(np.maximum(squares[r] - FIRST_SQUARE, 0))),
                    "cells": _half(pairs[c].real - m.cells[c]), "cell_squares": _half(np.sqrt(np.maximum(pairs[c].imag - FIRST_CELL, 0))),
                }
            ],
            schema=pa.schema([("part", pa.int64()), ("block", pa.int32()), *[(k, pa.binary()) for k in ("rows", "row_squares", "cells", "cell_squares")]]),
        )


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    """Averages the changes of up to FAN parts of one block by their sums of squares, which are added up."""
    out = {"part": [int(frame["part"].iloc[0]) // FAN], "block": [int(frame["block"].iloc[0])]}
    for name, squares in (("rows", "row_squares"), ("cells", "cell_squares")):
        total, weight = 0.0, 0.0
        for c, q in zip(frame[name], frame[squares], strict=True):
            w = np.square(np.frombuffer(q, dtype=np.float16).astype(np.float32))
            total = total + np.frombuffer(c, dtype=np.float16).reshape(len(w), -1).astype(np.float32) * w[:, None]
            weight = weight + w
        out[name] = [_half(total / np.maximum(weight, 1e-30)[:, None])]
        out[squares] = [_half(np.minimum(np.sqrt(weight), 60_000))]
    return pd.DataFrame(out)


def round_of_training(scratch: Scratch, texts: DataFrame, model: Model, turn: int) -> None:
    """Trains the weights of `model` in place."""
    held = scratch.spark.sparkContext.broadcast(model)
    parts = scratch.table(texts.mapInArrow(lambda batches: local_updates(held, turn, batches), UPDATE_DDL))
    while (parts.agg(F.max("part")).first()[0] or 0) > 0:
        merged = scratch.table(parts.groupBy("block", F.floor(F.col("part") / FAN).alias("g")).applyInPandas(_merge, UPDATE_DDL))
        scratch.release(parts)
        parts = merged
    rows = sorted(parts.select("block", "rows", "cells").collect(), key=lambda r: r["block"])
    scratch.release(parts)
    held.destroy()
    if rows:
        model.weights += np.concatenate([np.frombuffer(r["rows"], dtype=np.float16) for r in rows]).reshape(model.weights.shape).astype(np.float32)
        model.cells += np.concatenate([np.frombuffer(r["cells"], dtype=np.float16) for r in rows]).astype(np.float32)


# ------------------------------------------------------------------ scoring
ENCODED = "held_out boolean, n_tokens long, head_known long, head_base double, ids binary, rare array<binary>, uses array<bigint>"


def encoded(docs: DataFrame, held: Broadcast, known_ends: bool) -> DataFrame:
    """(id, held_out, n_tokens, known head tokens, their base score, ids, rare words and their uses) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = held.value
        for batch in batches:
            for at, to in byte_slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(at, to - at)
                ids, offsets, flat = m.encode(part.column("text"))
                rows, sizes = part.num_rows, np.diff(offsets)
                owner = np.repeat(np.arange(rows), sizes)
                head = ids < m.end
                base = np.bincount(owner[head], weights=m.base[ids[head]], minlength=rows) + m.base[m.end]
                outside = np.flatnonzero(~head)
                coded = flat.take(pa.array(outside)).dictionary_encode()
                pair, uses = np.unique(owner[outside] * np.int64(len(coded.dictionary) + 1) + coded.indices.to_numpy(), return_counts=True)
                who, what = np.divmod(pair, len(coded.dictionary) + 1)
                cuts = pa.array(np.searchsorted(who, np.arange(rows + 1)).astype(np.int32))
                words = coded.dictionary.cast(pa.binary()).take(pa.array(what))
                ends = np.insert(ids, offsets[1:], m.end).astype("<i4")  # each text's end behind its words
                bounds = (offsets + np.arange(rows + 1)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), part.column("held_out"), pa.array(sizes + 1, pa.int64()), pa.array(np.bincount(owner[head], minlength=rows) + known_ends, pa.int64()),
                        pa.array(base / np.log(10)), pa.array([ends[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(cuts, words), pa.ListArray.from_arrays(cuts, pa.array(uses, pa.int64())),
                    ],
                    names=["id", "held_out", "n_tokens", "head_known", "head_base", "ids", "rare", "uses"],
                )

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, {ENCODED}")


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """Trains on the documents of four fifths of the ids and scores all: id, held_out, n_tokens, n_known,
    train_tokens, base_score, score (log10). `head`: most words that the model knows by themselves."""
    scratch = Scratch(df.sparkSession)
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5
    docs = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), (fold == 1).alias("held_out"))
    n = count(scratch, docs.where(~F.col("held_out")).select("text"), head)
    model = fresh_model(n)
    held = scratch.spark.sparkContext.broadcast(model)
    rows = scratch.table(encoded(docs, held, n.ends > 0).withColumn("uid", F.monotonically_increasing_id()))
    held.destroy()
    training = rows.where(~F.col("held_out")).select("ids").coalesce(TRAINERS)
    for turn in range(ROUNDS):
        round_of_training(scratch, training, model, turn)
    final = scratch.spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        m: Model = final.value
        for batch in batches:
            for at in range(0, batch.num_rows, TRAINED):
                part = batch.slice(at, TRAINED)
                ids, places, owner = _gather(m.first, _id_lists(part.column("ids")))
                sums = np.bincount(owner, weights=token_scores(m, ids, places), minlength=part.num_rows) / np.log(10)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in kept], pa.array(sums)], names=[*kept, "head_score"])

    kept = ["uid", "id", "held_out", "n_tokens", "head_known", "head_base"]
    kind = dict(docs.dtypes)["id"]
    scored = rows.select(*kept, "ids").mapInArrow(run, f"uid long, id {kind}, held_out boolean, n_tokens long, head_known long, head_base double, head_score double")
    scored = scratch.table(scored)
    final.destroy()
    rare = rows.select("uid", F.explode(F.arrays_zip("rare", "uses")).alias("x")).select("uid", F.col("x.rare").alias("word"), F.col("x.uses").alias("tf"))
    totals = F.create_map(*[F.lit(x) for c in range(CLASSES) for x in (c, n.rare.get(c, (0, 0))[0] + 0.5 * (n.rare.get(c, (0, 0))[1] + 1))])
    c = F.coalesce("c", F.lit(0))
    met = rare.join(n.table, "word", "left").select(
        "uid",
        F.when(c > 0, F.col("tf")).otherwise(F.lit(0)).alias("known"),
        (F.col("tf") * F.log10((c + 0.5) / F.lit(float(n.whole)))).alias("base"),
        (F.col("tf") * F.log10((c + 0.5) / F.element_at(totals, suffix_class(F.col("word"), n.keys)))).alias("inner"),
    )
    sums = met.groupBy("uid").agg(*[F.sum(k).alias(k) for k in ("known", "base", "inner")])
    out = scored.join(sums, "uid", "left")
    zero = lambda k: F.coalesce(k, F.lit(0))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens",
        (F.col("head_known") + zero("known")).cast("long").alias("n_known"),
        F.lit(n.tokens).cast("long").alias("train_tokens"),
        (F.col("head_base") + zero("base")).alias("base_score"),
        (F.col("head_score") + zero("inner")).alias("score"),
    )
