"""Collocations: phrases of two to four words that occur more often than their parts let expect, per language.

Texts are cut into pieces at punctuation and line ends; identical pieces become one with a multiplicity, so that copies are
counted and not read again. Tasks read chunks of pieces as Arrow arrays and number each chunk's words, so that n-grams are numbers and only a
chunk's different ones become strings, with their summed weights. These go, packed, to the partition of their hash, where
duckdb sums them out of core: it aggregates from a stream, under a memory limit, and spills to the task's own temporary folder. What
occurs fewer than `MIN_COUNT` times is no candidate nor part of one and ends there. Words and pairs of words are counted
first; three and four words only where every pair in them is frequent, which a bit map of bounded size tells. It may let too many
pass, never too few.

A candidate asks for the counts of the parts of each of its cuts: requests are shuffled to the part's count by (part, salt),
so a part that very many candidates share is answered in many places. Products are decimals of 38 digits.

Defined results: a null or empty text has no pieces; a null language is `und`, an empty one stays empty. Repeated rows
and equal ids count each for itself. Ties of the score go to the larger count, then the smaller phrase in UTF-8 byte order.
Very long texts and pieces are read whole. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import shutil
import tempfile
import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkveil.llm.common import Scratch, keep_freed_memory, salt, salts, spread, text_or_empty

CUTS = "[.,;:!?\\x0A-\\x0D]"
MIN_COUNT = 30
TOP = 2000
CHUNK_WORDS = 1_000_000
#: The bit map of frequent pairs has at most 2 ** 28 bits, 32 MB.
PAIR_BITS = 28
PART_BYTES = 16 << 20
DUCKDB_MEMORY = "256MB"

PACKED_DDL = "part int, payload binary"
GRAMS_DDL = "lang string, gram string, n_words int, f long"
PACKED = pa.schema([("part", pa.int32()), ("payload", pa.binary())])
PAYLOAD = pa.schema([("lang", pa.dictionary(pa.int32(), pa.string())), ("gram", pa.string()), ("n_words", pa.int32()), ("f", pa.int64())])
GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n_words", pa.int32()), ("f", pa.int64())])


def pieces(df: DataFrame) -> DataFrame:
    """Different pieces with their multiplicity: lang, piece (as written, without the space at its ends), times."""
    cut = F.explode(F.split(text_or_empty("text"), CUTS))
    rows = df.select(F.coalesce("lang", F.lit("und")).alias("lang"), cut.alias("piece"))
    return rows.select("lang", F.btrim("piece", F.lit(" \t")).alias("piece")).where("piece != ''").groupBy("lang", "piece").agg(F.count("*").alias("times"))


def word_hashes(words: list[bytes], seeds: list[int]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words, seeds), np.uint64, len(words))


def seed(lang: str) -> int:
    return zlib.crc32(lang.encode())


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over all 64 (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(columns: list[np.ndarray]) -> np.ndarray:
    """Hashes of n-grams from those of their words, one array for each place."""
    out = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Pieces of about CHUNK_WORDS words together; one piece at least."""
    held, room = [], CHUNK_WORDS
    for batch in batches:
        ends = np.cumsum(pc.count_substring(batch["piece"], " ").to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = before = 0
        while at < batch.num_rows:
            to = min(batch.num_rows, int(np.searchsorted(ends, before + room)) + 1)
            held.append(batch.slice(at, to - at))
            room -= int(ends[to - 1]) - before
            at, before = to, int(ends[to - 1])
            if room <= 0:
                yield pa.Table.from_batches(held)
                held, room = [], CHUNK_WORDS
    if held:
        yield pa.Table.from_batches(held)


def numbered(values: pa.Array | np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of equal values, and the values by number."""
    coded = (pa.array(values) if isinstance(values, np.ndarray) else values).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


class Chunk:
    """Pieces, their words as numbers over all languages: a word of two languages has two."""

    def __init__(self, rows: pa.Table):
        of_piece, self.langs = numbered(rows["lang"].combine_chunks())
        lists = pc.ascii_split_whitespace(pc.ascii_lower(rows["piece"].cast(pa.large_string()).combine_chunks()))
        flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
        real = pc.binary_length(flat).to_numpy() > 0
        if not real.all():
            sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[real], minlength=len(sizes))
            flat = flat.filter(pa.array(real))
        self.codes, words = numbered(flat)
        self.lang_of = np.zeros(len(words), np.int64)
        if len(self.langs) > 1:
            self.codes, both = numbered(self.codes * len(self.langs) + np.repeat(of_piece, sizes))
            word, self.lang_of = np.divmod(both.to_numpy(), len(self.langs))
            words = words.take(pa.array(word))
        self.words = words.cast(pa.large_binary())
        seeds = np.array([seed(x) for x in self.langs.to_pylist()], np.int64)
        self.hashes = word_hashes(self.words.to_pylist(), seeds[self.lang_of].tolist())
        self.left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(self.codes))  # words from each to its piece's end
        self.times = np.repeat(rows["times"].to_numpy(), sizes)

    def packed(self, parts: int, pairs: Pairs | None) -> Iterator[pa.RecordBatch]:
        """The chunk's different n-grams with their weights, a row for each length and partition: words and pairs of words,
        or, of known `pairs`, the longer ones that are made of them."""
        codes, width = self.codes, len(self.words)
        shorter = codes
        known = None
        for n in (1, 2) if pairs is None else (2, 3, 4):
            at = np.flatnonzero(self.left >= n)
            if n == 2 and pairs is not None:
                known = np.zeros(len(codes) + 1, bool)
                known[at] = pairs.may_hold(gram_hashes([self.hashes[codes[at]], self.hashes[codes[at + 1]]]))
                at = np.flatnonzero(known)
                shorter = np.zeros(len(codes), np.int64)
                shorter[at] = numbered(codes[at] * width + codes[at + 1])[0]
                continue
            if known is not None:
                at = at[np.logical_and.reduce([known[at + k] for k in range(n - 1)])]
            if not len(at):
                continue
            number, told = (codes, self.words) if n == 1 else numbered(shorter[at] * width + codes[at + n - 1])
            place = np.zeros(len(told), np.int64)
            place[number] = at  # one of its places tells an n-gram's words
            total = np.zeros(len(told), np.int64)
            np.add.at(total, number, self.times[at])
            yield from self._sent(n, place, total, parts)
            shorter = np.zeros(len(codes), np.int64)
            shorter[at] = number

    def _sent(self, n: int, places: np.ndarray, total: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
        own = [self.codes[places + k] for k in range(n)]
        part = (gram_hashes([self.hashes[c] for c in own]) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
        order = np.argsort(part, kind="stable")
        part, of_lang = part[order].astype(np.int64), pa.array(self.lang_of[own[0]][order].astype(np.int32))
        grams = [self.words.take(pa.array(c[order])) for c in own]
        gram = grams[0] if n == 1 else pc.binary_join_element_wise(*grams, pa.scalar(b" ", pa.large_binary()))
        f = pa.array(total[order])
        edges = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(part)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, PAYLOAD, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                lang = pa.DictionaryArray.from_arrays(of_lang[a:b], self.langs)
                to.write_batch(pa.RecordBatch.from_arrays([lang, gram[a:b].cast(pa.binary()).cast(pa.string()), pa.array(np.full(b - a, n, np.int32)), f[a:b]], schema=PAYLOAD))
            yield pa.RecordBatch.from_arrays([pa.array([part[a]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=PACKED)


class Pairs:
    """Frequent pairs of words as bits at their hashes: what is not held is none, what is held may be one."""

    def __init__(self, bits: np.ndarray, log2: int):
        self.bits, self.log2 = bits, log2

    @staticmethod
    def place(hashes: np.ndarray, log2: int) -> np.ndarray:
        return (hashes >> np.uint64(64 - log2)).astype(np.int64)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        at = self.place(hashes, self.log2)
        return (self.bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def frequent_pairs(grams: DataFrame) -> Pairs:
    """The pairs among counted n-grams. Sixteen bits a pair, up to 2 ** `PAIR_BITS` in all: with more pairs more n-grams are
    sent for nothing, and the counts stay the same."""
    rows = grams.where("n_words = 2").select("lang", "gram")
    log2 = min(PAIR_BITS, max(10, (16 * rows.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = [seed(x) for x in batch["lang"].to_pylist()]
            words = [g.split(b" ") for g in batch["gram"].cast(pa.binary()).to_pylist()]
            hashes = [word_hashes([w[k] for w in words], seeds) for k in range(2)]
            at = Pairs.place(gram_hashes(hashes), log2)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bit"])

    told = rows.mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (log2 - 6), np.uint64)
    bits[told["word"].to_numpy()] = told["bits"].to_numpy().view(np.uint64)
    return Pairs(bits, log2)


def send_grams(parts: int, pairs: Broadcast[Pairs] | None):
    """Arrow batches of pieces to packed n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        known = pairs.value if pairs else None
        for rows in chunks(batches):
            yield from Chunk(rows).packed(parts, known)

    return run


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for payload in batch["payload"]:
            for own in pa.ipc.open_stream(pa.py_buffer(payload.as_py())):
                yield pa.RecordBatch.from_arrays([own["lang"].cast(pa.string()), *own.columns[1:]], schema=GRAMS)


def count_grams(min_count: int):
    """A partition's n-grams, summed out of core: those with `min_count` occurrences or more, and each language's words
    (a row without a gram)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = tempfile.mkdtemp()
        con = duckdb.connect(f"{folder}/counts.db")
        try:
            for setting in (f"memory_limit = '{DUCKDB_MEMORY}'", "threads = 1", f"temp_directory = '{folder}'", "preserve_insertion_order = false"):
                con.execute(f"SET {setting}")
            stream = pa.RecordBatchReader.from_batches(GRAMS, _payloads(batches))
            con.register("stream", stream)
            con.execute("CREATE TABLE counts AS SELECT lang, gram, n_words, sum(f)::BIGINT AS f FROM stream GROUP BY lang, gram, n_words")
            found = con.execute(
                "SELECT lang, gram, n_words, f FROM counts WHERE f >= ? UNION ALL "
                "SELECT lang, NULL, 0::INTEGER, sum(f)::BIGINT FROM counts WHERE n_words = 1 GROUP BY lang",
                [min_count],
            )
            while rows := found.fetchmany(50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), GRAMS, strict=True)], schema=GRAMS)
        finally:
            con.close()
            shutil.rmtree(folder, ignore_errors=True)

    return run


def gram_counts(df: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """lang, gram, n_words, f of all n-grams of up to four words that occur `min_count` times or more in a language;
    in rows without a gram the words of a language that a partition counted."""
    spark = df.sparkSession
    scratch = Scratch(spark)
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(salts(spark), -(-size // PART_BYTES))
    held = scratch.table(pieces(df))

    def counted(pairs: Broadcast[Pairs] | None) -> DataFrame:
        packed = held.mapInArrow(send_grams(parts, pairs), PACKED_DDL)
        return scratch.table(packed.repartitionById(parts, "part").mapInArrow(count_grams(min_count), GRAMS_DDL))

    short = counted(None)
    pairs = spark.sparkContext.broadcast(frequent_pairs(short))
    long = counted(pairs)
    pairs.destroy()
    scratch.release(held)
    return short.unionByName(long)


def _key(gram: Column) -> Column:
    """A phrase of a language as one string: phrases hold no tab."""
    return F.concat(gram, F.lit("\t"), F.col("lang"))


def _joined(words: Column, start: Column | int, length: Column | int) -> Column:
    start, length = (F.lit(x) if isinstance(x, int) else x for x in (start, length))
    return F.array_join(F.slice(words, start, length), " ")


def scored(grams: DataFrame) -> DataFrame:
    """Each phrase with the cut of the lowest score: lang, phrase, n_words, a, l, r, score."""
    spark = grams.sparkSession
    words, n = F.split("gram", " "), F.col("n_words")
    parts = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.array(
        F.struct(k.alias("k"), F.lit(True).alias("first"), _joined(words, 1, k).alias("part")),
        F.struct(k.alias("k"), F.lit(False).alias("first"), _joined(words, k + 1, n - k).alias("part")))))).alias("p")
    asked = grams.where("n_words > 1").select("lang", F.col("gram").alias("phrase"), "n_words", F.col("f").alias("a"), parts)
    asked = asked.select("lang", "phrase", "n_words", "a", "p.k", "p.first", _key(F.col("p.part")).alias("key"))
    answers = grams.select(_key(F.col("gram")).alias("key"), "f")
    told = spread(asked.withColumn("salt", salt(spark, "phrase")), answers, "key", "salt")
    cuts = told.groupBy("lang", "phrase", "n_words", "a", "k").agg(F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
    score = F.expr("CAST(CAST(a AS DECIMAL(20, 0)) * 2000000BD div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0))) AS BIGINT)")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b")
    return cuts.groupBy("lang", "phrase", "n_words", "a").agg(best).select("lang", "phrase", "n_words", "a", "b.l", "b.r", "b.score")


def longest_within(grams: DataFrame) -> DataFrame:
    """For phrases that lie inside longer ones the largest count of these: key, f_longer."""
    words, n = F.split("gram", " "), F.col("n_words")
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda m: F.transform(
        F.sequence(F.lit(1), n - m + 1), lambda s: _joined(words, s, m))))).alias("inner")
    return grams.where("n_words > 2").select("lang", "f", inner).groupBy(_key(F.col("inner")).alias("key")).agg(F.max("f").alias("f_longer"))


def top_phrases(rows: DataFrame, top: int) -> DataFrame:
    """The first `top` of each language with their rank; in two steps, so that no task sorts a whole language."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    dealt = rows.withColumn("salt", salt(rows.sparkSession, "phrase"))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return last.where(F.col("rank") <= top).drop("salt")


def collocations(df: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """Each language's first phrases: lang, rank, phrase, a, l, r, n, score."""
    counted = gram_counts(df, min_count)
    grams = counted.where("gram is not null")
    totals = counted.where("gram is null").groupBy("lang").agg(F.sum("f").alias("n"))
    rows = scored(grams).withColumn("key", _key(F.col("phrase"))).join(longest_within(grams), "key", "left")
    inside = F.expr("CAST(f_longer AS DECIMAL(20, 0)) * 100BD >= CAST(a AS DECIMAL(20, 0)) * 80BD")
    kept = top_phrases(rows.where(~F.coalesce(inside, F.lit(False))), top)
    return kept.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
