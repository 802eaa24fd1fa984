"""Packing by cutting-stock column generation.

Each document becomes token ids and an end id. Its ids are cut into full pieces of the sequence length and one
rest; pieces are graded into length classes of `grain` tokens. Pieces under `SMALL` tokens have a class for each length; as
many of a length as fit `BUNDLE` tokens make a bundle, which is packed like a piece of its length, so that short texts lose next to
nothing to the grain. The numbers of pieces per class, a histogram of at most length/grain + SMALL numbers, are all that
the driver sees. Over it a linear program chooses how often to use
each pattern (a multiset of classes that fits a sequence): the simplex method holds a basis of patterns, and a
knapsack dynamic program over the classes' prices finds the pattern to enter, until none pays or the bound of
Farley shows that the rest is under `gap`. Pattern counts are rounded down, and the few pieces left over are
packed first-fit-decreasing. The plan's size depends on the number of classes alone.

Pieces are ranked within their class and find pattern, sequence and place by their rank. They are numbered where
they are cut, by class and partition; the counts per (class, partition), which are broadcast, make ranks of these
numbers: partitions are merged down to `MAX_PARTS` before, so these are MAX_PARTS * (length/grain + SMALL) numbers at most. So
the only exchange of token ids is that to their sequences, however many pieces a class holds. A
sequence holds as many pieces as tokens at most; offsets are sums within it. Token ids go with their pieces throughout, so
the rows of a sequence in the order of their offsets are the packed sequence.

Defined results: a null or empty text is its end id alone. Repeated rows are packed each for itself. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import itertools
import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkveil.llm.common import Scratch, byte_slices, quoted

LENGTH, GRAIN, END_ID = 4096, 16, 2
#: Pieces of fewer tokens are bundled by their exact length, into about so many tokens.
SMALL, BUNDLE = 128, 512
#: The most partitions that pieces are numbered in.
MAX_PARTS = 4096
#: About so many different strings are kept with their ids; longer ones are not: texts without spaces are one word each.
KEPT, KEPT_LETTERS = 250_000, 64
#: Bytes of text that are encoded at a time.
SLICE_BYTES = 2 << 20
#: Letters that lower-case one by one and take part in no composition, and marks that may stand behind them.
SHAPE = "^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[.,;:!?#*$%&|]*)$"


def runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first, first + 1, .. of all runs, one run behind the other."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Known:
    """Ids of different strings: those that came before are looked up, the others encoded and kept. They lie in Arrow and numpy
    arrays, some 40 bytes each, as two workers of an executor hold them at once and for good."""

    def __init__(self, encode):
        self.encode, self.names = encode, pa.array([], pa.string())
        self.first, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def of(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each string lie in `ids`: the first, and how many."""
        at = pc.index_in(strings, value_set=self.names)
        unknown = pc.is_null(at)
        new = strings.filter(unknown)
        if len(new):
            if len(self.names) + len(new) > KEPT:  # of the others only those stay that are used now
                used = at.drop_null().to_numpy()
                self.names, ids = self.names.take(pa.array(used)), self.ids[runs(self.first[used], self.size[used])]
                self.size, self.ids = self.size[used], ids
                at = pc.index_in(strings, value_set=self.names)
            ids, size = self.encode(new.to_pylist())
            at = np.where(unknown, len(self.names) + np.cumsum(unknown) - 1, pc.fill_null(at, 0))
            self.names = pa.concat_arrays([self.names, new])
            self.size, self.ids = np.r_[self.size, size], np.r_[self.ids, ids]
            self.first = np.cumsum(self.size) - self.size
        at = np.asarray(at)
        return self.first[at], self.size[at]


class WordIds:
    """White-space separated words to ids as little-endian 32-bit numbers. The tokenizer drops white space and never joins
    across it, so a text's ids are those of its words; it lower-cases, and parts letters from other signs, so a
    word of letters with marks behind it has the ids of the letters and those of the marks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.quick = Tokenizer(self.tokenizer.model)  # the same model, not another
        self.quick.normalizer = normalizers.Sequence([])
        self.quick.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.is_end[[k for w, k in vocabulary.items() if suffix and w.endswith(suffix)]] = True
        self.cores, self.tails, self.others = Known(self._encode_letters), Known(self._encode_plain), Known(self._encode_plain)

    def _encode_plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), "<u4", size.sum()), size

    def _encode_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of lower-case letters, which need no preparation, are encoded many at a time; their last ids tell them apart."""
        groups = [" ".join(words[k : k + 200]) for k in range(0, len(words), 200)]
        found = [e.ids for e in self.quick.encode_batch_fast(groups, add_special_tokens=False)]
        ids = np.fromiter(itertools.chain.from_iterable(found), "<u4")
        ends = np.flatnonzero(self.is_end[ids]) + 1
        if len(ends) != len(words):
            return self._encode_plain(words)
        return ids, np.diff(ends, prepend=0)

    def ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of different words: all of them, where each word's begin, and how many they are."""
        short = pc.less_equal(pc.utf8_length(words), KEPT_LETTERS)
        shape = pc.extract_regex(words, SHAPE)
        lettered = pc.and_(short, pc.is_valid(shape))
        shape = shape.filter(lettered)
        long, first, size = Known(self._encode_plain), np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)
        of_letters, base, every = np.flatnonzero(lettered), 0, []
        for known, rows, column, strings in (
            (self.cores, of_letters, 0, pc.utf8_lower(shape.field("core"))),
            (self.tails, of_letters, 1, shape.field("tail")),
            (self.others, np.flatnonzero(pc.and_not(short, lettered)), 0, words.filter(pc.and_not(short, lettered))),
            (long, np.flatnonzero(pc.invert(short)), 0, words.filter(pc.invert(short))),
        ):
            coded = strings.dictionary_encode()
            at, n = known.of(coded.dictionary)
            which = coded.indices.to_numpy()
            first[rows, column], size[rows, column] = at[which] + base, n[which]
            base += len(known.ids)
            every.append(known.ids)
        ids = np.concatenate(every)[runs(first.ravel(), size.ravel())]
        size = size.sum(axis=1)
        return ids, np.cumsum(size) - size, size

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of texts. Only space, newline and tab part words here; other white space stays inside a word, for the
        tokenizer. Each different word is looked up once; its places are filled in numpy."""
        plain = pc.fill_null(texts, "").cast(pa.string())
        for mark in "\n\t":
            plain = pc.replace_substring(plain, mark, " ")
        lists = pc.split_pattern(plain, " ")
        coded = lists.flatten().dictionary_encode()
        found, first, size = self.ids_of(coded.dictionary)
        at = coded.indices.to_numpy()
        ids = found[runs(first[at], size[at])]
        bounds = np.r_[0, np.cumsum(size[at])][lists.offsets.to_numpy()].tolist()
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(
    df: DataFrame, tokenizer: str, length: int = LENGTH, grain: int = GRAIN, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, start, length, doc_tokens, ids, __cls, __part, __at): each document's full pieces and its rest, numbered
    within their class and partition. The class of a small piece is its length, negated."""
    rows = df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")).coalesce(MAX_PARTS)
    small = min(SMALL, length)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, here, seen = word_ids(tokenizer), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for at, to in byte_slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(at, to - at)
                row, start, size, total, ids, cls, place = [], [], [], [], [], [], []
                for k, data in enumerate(words.encode(part.column("text"))):
                    data += end
                    n = len(data) // 4
                    for s in range(0, n, length):
                        piece = data[4 * s : 4 * (s + length)]
                        row.append(k)
                        start.append(s)
                        size.append(len(piece) // 4)
                        total.append(n)
                        ids.append(piece)
                        cls.append(-size[-1] if size[-1] < small else -(-size[-1] // grain))
                        place.append(seen[cls[-1]])
                        seen[cls[-1]] += 1
                columns = [part.column("id").take(pa.array(row, pa.int64()))]
                columns += [pa.array(x, pa.int64()) for x in (start, size, total)]
                columns += [pa.array(ids, pa.binary()), *(pa.array(x, pa.int64()) for x in (cls, [here] * len(cls), place))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "length", "doc_tokens", "ids", "__cls", "__part", "__at"])

    schema = f"id {dict(rows.dtypes)['id']}, start long, length long, doc_tokens long, ids binary, __cls long, __part long, __at long"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def price(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of most value within `room`: an unbounded knapsack by dynamic programming."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    for cap in range(1, room + 1):
        best[cap], last[cap] = best[cap - 1], -1
        fits = np.flatnonzero(sizes <= cap)
        if len(fits):
            worth = best[cap - sizes[fits]] + values[fits]
            k = int(np.argmax(worth))
            if worth[k] > best[cap] + 1e-12:
                best[cap], last[cap] = worth[k], fits[k]
    pattern, cap = np.zeros(len(sizes), dtype=np.int64), room
    while cap > 0:
        if last[cap] < 0:
            cap -= 1
        else:
            pattern[last[cap]] += 1
            cap -= int(sizes[last[cap]])
    return float(best[room]), pattern


def times(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The product of a matrix and a vector, in numpy's own loops. The threads of a linear algebra library may never come
    back in a process that has forked, as the driver of a Spark session has."""
    return (matrix * x).sum(axis=1)


def inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse by Gauss and Jordan's elimination with the largest pivots; in numpy's own loops, as in `times`."""
    m = len(matrix)
    both = np.hstack([matrix.astype(float), np.eye(m)])
    for k in range(m):
        top = k + int(np.argmax(np.abs(both[k:, k])))
        both[[k, top]] = both[[top, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        both -= factor[:, None] * both[k]
    return both[:, m:]


def solve(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 1e-3, most_steps: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """The linear program by column generation: (patterns as columns, how often each). After `most_steps` patterns the best
    basis so far is as good as it gets: rounding and first-fit make a whole plan of any basis."""
    m = len(sizes)
    basis = np.zeros((m, m), dtype=np.int64)
    np.fill_diagonal(basis, room // sizes)
    inverse = np.diag(1.0 / (room // sizes))
    use = times(inverse, demand)
    for step in range(most_steps):
        prices = inverse.sum(axis=0)
        worth, pattern = price(np.maximum(prices, 0), sizes, room)
        if worth <= 1 + 1e-9 or use.sum() <= (use.sum() / worth) * (1 + gap):
            break
        direction = times(inverse, pattern)
        rising = direction > 1e-9
        ratio = np.where(rising, use / np.where(rising, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = pattern
        if step % 200 == 199:  # anew, against rounding errors
            inverse = inverted(basis)
        else:
            row = inverse[out] / direction[out]
            inverse -= np.outer(direction, row)
            inverse[out] = row
        use = np.maximum(times(inverse, demand), 0)
    return basis, use


def plan(demand: dict[int, int], room: int):
    """The rounded plan for `demand` (class: pieces): rows (cls, first, last, each, sequence). Ranks first to last - 1
    of a class go to sequences from `sequence` on, `each` of them to a sequence. No class's ranks are left over."""
    import pandas as pd  # the driver's; the workers that encode do not load it

    classes = sorted(demand)
    sizes, need = np.array(classes, dtype=np.int64), np.array([demand[c] for c in classes], dtype=np.int64)
    uses: list[tuple[np.ndarray, int]] = []
    if len(classes):
        basis, use = solve(sizes, need.astype(float), room)
        left = need.copy()
        for k in np.argsort(-use, kind="stable"):
            n = int(use[k] + 1e-6)
            held = basis[:, k] > 0
            if held.any():
                n = min(n, int((left[held] // basis[held, k]).min()))
            if n > 0:
                uses.append((basis[:, k], n))
                left -= basis[:, k] * n
        while left.any():  # first-fit-decreasing, a pattern at a time and as often as it can be had
            pattern, space = np.zeros(len(sizes), dtype=np.int64), room
            for k in range(len(sizes) - 1, -1, -1):
                pattern[k] = min(left[k], space // sizes[k])
                space -= int(pattern[k] * sizes[k])
            held = pattern > 0
            n = int((left[held] // pattern[held]).min())
            uses.append((pattern, n))
            left -= pattern * n
    rows, taken, sequence = [], np.zeros(len(sizes), dtype=np.int64), 0
    for pattern, n in uses:
        for k in np.flatnonzero(pattern):
            rows.append((classes[k], int(taken[k]), int(taken[k] + pattern[k] * n), int(pattern[k]), sequence))
            taken[k] += pattern[k] * n
        sequence += n
    return pd.DataFrame(rows, columns=["cls", "first", "last", "each", "sequence"])


def bundled(counts: dict[int, int], length: int, grain: int) -> tuple[dict[int, int], list[tuple[int, ...]]]:
    """Numbers of pieces and bundles per class, and for each small length (class, pieces to a bundle, whole bundles, their
    class, their first rank, the class of the last bundle, its rank)."""
    demand, out = Counter({c: n for c, n in counts.items() if c > 0}), []
    for cls in sorted(c for c in counts if c < 0):
        each = max(1, min(BUNDLE, length) // -cls)
        whole, rest = divmod(counts[cls], each)
        full, last = -(each * cls // grain), -(rest * cls // grain)
        first = demand[full]
        demand[full] += whole
        out.append((cls, each, whole, full, first, last, demand[last]))
        demand[last] += rest > 0
    return {c: n for c, n in demand.items() if n}, out


def assign(ranked: DataFrame, layout) -> DataFrame:
    """Adds sequence_id to rows with __cls and __rank. `layout` is bounded by the number of classes. The rows stay in
    the JVM, as they hold token ids."""
    spans = [(int(c), list(zip(*(g.sort_values("first")[k].tolist() for k in ("first", "each", "sequence")), strict=True))) for c, g in layout.groupby("cls")]
    plans = ranked.sparkSession.createDataFrame(spans, "__cls bigint, __spans array<struct<first:bigint,each:bigint,sequence:bigint>>")
    span = F.element_at(F.filter("__spans", lambda x: x["first"] <= F.col("__rank")), -1)
    placed = ranked.join(F.broadcast(plans), "__cls").withColumn("__span", span)
    at = F.floor((F.col("__rank") - F.col("__span.first")) / F.col("__span.each"))
    return placed.withColumn("sequence_id", F.col("__span.sequence") + at).drop("__spans", "__span")


def pack(
    df: DataFrame, tokenizer: str, length: int = LENGTH, grain: int = GRAIN, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian 32-bit
    numbers). The ids of a sequence are those of its rows by offset. The checksum is that of the placed ids."""
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = scratch.table(pieces(df, tokenizer, length, grain, end_id, id_col, text_col))
    counts = scratch.table(rows.groupBy("__cls", "__part").agg(F.count("*").alias("__n")))
    found = {r[0]: r[1] for r in counts.groupBy("__cls").agg(F.sum("__n")).collect()}
    demand, bundles = bundled(found, length, grain)
    layout = plan(demand, length // grain)
    before = Window.partitionBy("__cls").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("__cls", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    ranked = rows.join(F.broadcast(base), ["__cls", "__part"]).withColumn("__rank", F.col("__base") + F.col("__at"))
    names = ("__cls", "__each", "__whole", "__full", "__first", "__last", "__rest")
    small = spark.createDataFrame(bundles, ", ".join(f"{n} bigint" for n in names))
    ranked = ranked.join(F.broadcast(small), "__cls", "left")
    bundle, is_small = F.floor(F.col("__rank") / F.col("__each")), F.col("__cls") < 0
    whole = bundle < F.col("__whole")
    cls = F.when(is_small, F.when(whole, F.col("__full")).otherwise(F.col("__last"))).otherwise(F.col("__cls"))
    rank = F.when(is_small, F.when(whole, F.col("__first") + bundle).otherwise(F.col("__rest"))).otherwise(F.col("__rank"))
    inner = F.when(is_small, F.col("__rank") % F.col("__each")).otherwise(F.lit(0))
    ranked = ranked.select(F.col(quoted(id_col)), "start", "length", "doc_tokens", "ids", cls.alias("__cls"), rank.alias("__rank"), inner.alias("__inner"))
    placed = assign(ranked, layout)
    within = Window.partitionBy("sequence_id").orderBy(F.desc("__cls"), "__rank", "__inner")
    offset = F.coalesce(F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("offset", offset.cast("long"))
    return placed.select(quoted(id_col), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")
