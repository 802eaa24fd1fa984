"""Near-duplicate detection by HyperMinHash.

A document's set of word shingles is hashed once for each register (bucket); the least 32-bit hash of a register
is kept as HyperMinHash keeps it: the number of leading zeros (5 bits) and the 11 bits that follow the leading one.
Registers are banded; documents with equal compressed registers in a band become candidates. A candidate pair's
similarity is estimated from equal registers, corrected for the registers that unequal minima share by chance
(`collision_rate`), and pairs that could reach the threshold are verified on their full shingle sets (as 64-bit
hashes). With 48 bands of 6 registers a pair at 0.8 shares 12.6 bands on average and none with probability 5e-7; the
estimate's margin of 4.5 standard deviations adds 3e-6.

No bucket of a band is expanded into all pairs. Equal texts are one vertex. Members of a bucket that are already in
one component need no comparison with one another. A small bucket's other pairs are estimated, then verified. In a
large bucket some members, the centres, meet all others where these lie, chunk by chunk, in numpy: first by sketch; then
those that met one that is near enough bring their full sets, and out come only links that join components not
yet joined in that chunk, so at most one per member and centre, however dense the bucket is. Once the members outside the bucket's largest component are few, all of them are centres,
and a pair is compared only in the first band that it shares; after that no pair of the bucket is left. A bucket in which they stay many is split by the
keys of the later bands: a pair then needs one more shared band (missed with probability 8e-6 at the first
split, 7e-5 at the second), and this goes on until the parts are small. Components come from
label propagation with pointer jumping over verified links; links, labels and buckets stay in tables, which go when
the next round has its own.

Skew: groups of equal texts and large buckets are joined by (key, salt).

Defined results: a text without words (null, empty, white space) has an empty set, is linked with nothing and
is its own component; one with fewer words than a shingle has its whole sequence as its one shingle. Rows
repeated under one id get the same result each; an id with several texts has a row and a component for each. Rows
with a null id have a null component and are kept; they link nothing. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import Scratch, byte_slices, free_names, quoted, salt, spread

BANDS, ROWS = 48, 6
MANTISSA = 11
#: Standard deviations below the threshold at which an estimate still goes to verification.
MARGIN = 4.5
#: Buckets up to this size are compared pair by pair.
SMALL = 24
#: Bands of the first round.
FIRST_BANDS = 8
#: Members, and shingles of members, that are compared with centres at a time; centres of a block likewise.
CHUNK, CHUNK_ITEMS = 512, 1_000_000
#: In rounds 0, 1, 2 and later: how many members outside a bucket's largest component are few.
FEW = (0, 64, 512)
#: Rounds of four centres after which a bucket with more than these is split.
AGED = 3
#: Ids up to this number (some 60 bytes each, 12 MB) are broadcast to find their rows; more are joined by shuffle.
BROADCAST_IDS = 200_000
#: Bytes of text that are hashed at a time.
SLICE_BYTES = 2 << 20


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_LETTERS = np.random.default_rng(70).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of texts whose words are parted by single spaces, and the places at which each text's begin.

    A word's hash is the sum over its bytes of a random number per byte value times a power of an odd number per place."""
    flat = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    ends = np.flatnonzero(flat == 32)
    counts = np.array([t.count(b" ") + 1 if t else 0 for t in texts], dtype=np.int64)
    starts = np.r_[0, ends[:-1] + 1]
    sizes = ends - starts
    real = sizes > 0  # an empty text leaves one word of no bytes
    starts, sizes = starts[real], sizes[real]
    offsets = np.r_[0, np.cumsum(counts)]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), offsets
    powers = np.multiply.accumulate(np.full(int(sizes.max()) + 1, _STEP))
    letters = flat != 32
    bytes_ = flat[letters]
    first = np.cumsum(sizes) - sizes
    values = _LETTERS[bytes_]
    values *= powers[np.arange(len(bytes_)) - np.repeat(first, sizes)]
    return _mixed(np.add.reduceat(values, first) + sizes.astype(np.uint64)), offsets


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text, of words parted by single spaces, the sorted distinct 64-bit hashes of its shingles; of all its words
    together, where there are fewer than `width`."""
    words_, offsets = word_hashes(texts)
    n = max(0, len(words_) - width + 1)
    grams = words_[:n].copy()
    for k in range(1, width):
        grams = _mixed(grams * _STEP + words_[k : k + n])
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            h = words_[a : a + 1]
            for k in range(a + 1, b):
                h = _mixed(h * _STEP + words_[k : k + 1])
            out.append(_mixed(h + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _normal(text: bytes | None) -> bytes:
    """The lower-cased words parted by single spaces. For bytes, `lower` and `split` know ASCII alone: A to Z, and space, tab to return."""
    return b" ".join((text or b"").lower().split())


def multipliers(registers: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(71)
    return rng.integers(0, 1 << 32, registers, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, registers, dtype=np.uint32)


def compress(least: np.ndarray) -> np.ndarray:
    """32-bit minima to 16-bit registers: leading zeros and the mantissa bits after the leading one."""
    wide = least.astype(np.uint64)
    exact = np.frexp(wide.astype(np.float64))[1].astype(np.int64)  # bit length
    zeros = np.minimum(32 - exact, 31)
    shift = np.maximum(exact - 1 - MANTISSA, 0).astype(np.uint64)
    lift = np.maximum(MANTISSA - (exact - 1), 0).astype(np.uint64)
    mantissa = ((wide >> shift) << lift) & np.uint64((1 << MANTISSA) - 1)
    return ((zeros.astype(np.uint64) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


def registers(grams: np.ndarray, mult: np.ndarray, mix: np.ndarray, block: int = 4096) -> np.ndarray:
    """The compressed registers of one set of 64-bit hashes."""
    h = (grams.view(np.uint64) >> np.uint64(32)).astype(np.uint32) ^ grams.view(np.uint64).astype(np.uint32)
    least = np.full(len(mult), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(h), block):
        spread_ = (h[at : at + block, None] ^ mix) * mult
        np.minimum(least, spread_.min(axis=0), out=least)
    return compress(least)


def sketches(docs: DataFrame, width: int, count: int) -> DataFrame:
    """(doc, sha, n, sketch) of rows (doc, text): sha is of the lower-cased words joined by spaces, so that equal word
    sequences share it; n is the size of the set of shingles, sketch its registers as bytes."""
    mult, mix = multipliers(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in byte_slices(batch.column("text"), SLICE_BYTES):
                texts = [_normal(t) for t in batch.column("text")[at:to].to_pylist()]
                sets = shingle_sets(texts, width)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc")[at:to], pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([registers(s, mult, mix).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                    ],
                    names=["doc", "sha", "n", "sketch"],
                )

    return docs.select("doc", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc {dict(docs.dtypes)['doc']}, sha binary, n long, sketch binary")


def sets_of(rows: DataFrame, width: int) -> DataFrame:
    """(v, grams): the set of each row (v, sha, text) whose text has the hash `sha`, as sorted 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in byte_slices(batch.column("text"), SLICE_BYTES):
                texts = [_normal(t) for t in batch.column("text")[at:to].to_pylist()]
                same = [hashlib.sha256(t).digest() == s for t, s in zip(texts, batch.column("sha")[at:to].to_pylist(), strict=True)]
                sets = shingle_sets([t for t, ok in zip(texts, same, strict=True) if ok], width)
                yield pa.RecordBatch.from_arrays([batch.column("v")[at:to].filter(pa.array(same)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["v", "grams"])

    return rows.select("v", "sha", F.col("text").cast("binary").alias("text")).mapInArrow(run, "v long, grams binary")


def band_keys(sketch: str, bands: int, rows: int) -> Column:
    """One 64-bit key per band: a hash of the band's registers."""
    return F.array(*[F.xxhash64(F.lit(b), F.substring(F.col(sketch), 2 * rows * b + 1, 2 * rows)) for b in range(bands)])


def collision_rate(n: float, m: float) -> float:
    """Chance that the registers of two sets of n and m elements with unequal minima are equal all the same: the sum
    over register values of both chances to fall on it, by the leading zeros z and within them evenly."""
    total = 0.0
    for z in range(32):
        lo, hi = 2.0 ** -(z + 1), 2.0**-z
        p = math.exp(n * math.log1p(-lo)) - (math.exp(n * math.log1p(-hi)) if hi < 1 else 0.0)
        q = math.exp(m * math.log1p(-lo)) - (math.exp(m * math.log1p(-hi)) if hi < 1 else 0.0)
        total += p * q / (1 << MANTISSA)
    return total


def estimator(threshold: float, count: int):
    """A function of (shares of equal registers, sizes, sizes): which corrected estimates could reach `threshold`. Sets
    of too unequal sizes cannot."""
    margin = MARGIN * math.sqrt(threshold * (1 - threshold) / count)
    table = np.array([[collision_rate(2.0**i, 2.0**j) for j in range(33)] for i in range(33)])

    def close(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        chance = table[np.log2(n).astype(int), np.log2(m).astype(int)]
        return ((equal - chance) / (1 - chance) >= threshold - margin) & (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9)

    return close


def at_ends(pairs: DataFrame, rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Joins columns of the table `rows` (by vertex v) to both ends of `pairs`; both are tables, see above."""
    for end in "ab":
        pairs = pairs.join(rows.select(F.col("v").alias(end), *[F.col(k).alias(n + end) for k, n in names.items()]), end)
    return pairs


PAIR = "a long, b long, la long, lb long"


def estimate_at_least(pairs: DataFrame, threshold: float, count: int) -> DataFrame:
    """Of the pairs with sizes na, nb and sketches sa, sb those whose corrected estimate could reach `threshold`."""
    close = estimator(threshold, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sa, sb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint16).reshape(-1, count) for k in ("sa", "sb"))
            keep = close((sa == sb).mean(axis=1), batch.column("na").to_numpy(), batch.column("nb").to_numpy())
            yield batch.select(["a", "b", "la", "lb"]).filter(pa.array(keep))

    return pairs.select("a", "b", "la", "lb", "na", "nb", "sa", "sb").mapInArrow(run, PAIR)


def met_in_buckets(members: DataFrame, centres: DataFrame, sketched: DataFrame, threshold: float, bands: int, rows: int) -> DataFrame:
    """Which members and centres of a bucket have an estimate that could reach the threshold with one of the other kind
    and another component: (key, chunk, block, centre, v, label).

    members: (key, band, level, v, label, whole, parts, blocks); centres: (key, c, c_label, block). A chunk of a bucket's
    members meets one block of its centres at a time."""
    count = bands * rows
    held = members.withColumn("chunk", F.pmod(F.xxhash64("v", F.lit(5)), F.col("parts")).cast("int")).join(sketched, "v")
    held = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spans = members.select("key", "parts").distinct()
    stars = centres.join(spans, "key").join(sketched.select(F.col("v").alias("c"), F.col("n").alias("m"), F.col("sketch").alias("mark")), "c")
    stars = stars.select("key", "block", "c", "c_label", "m", "mark", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("chunk"))
    close = estimator(threshold, count)

    def run(group: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=[x.split()[0] for x in MET.split(", ")])
        label, n = left["label"].to_numpy(), left["n"].to_numpy()
        band, level, whole = int(left["band"].iloc[0]), int(left["level"].iloc[0]), bool(left["whole"].iloc[0])
        mine = np.frombuffer(b"".join(left["sketch"]), dtype=np.uint16).reshape(-1, count)
        met, goals = np.zeros(len(n), dtype=bool), np.zeros(len(right), dtype=bool)
        for k, (c_label, m, mark) in enumerate(zip(right["c_label"], right["m"], right["mark"], strict=True)):
            at = np.flatnonzero(label != c_label)
            equal = mine[at] == np.frombuffer(mark, dtype=np.uint16)
            keep = close(equal.mean(axis=1), n[at], np.full(len(at), m))
            if whole:
                keep &= equal[:, : rows * (band + 1)].reshape(len(at), band + 1, rows).all(axis=2).sum(axis=1) == level
            met[at[keep]] = True
            goals[k] = keep.any()
        ids, labels = np.r_[left["v"][met], right["c"][goals]], np.r_[label[met], right["c_label"][goals]]
        return pd.DataFrame({"key": group[0], "chunk": group[1], "block": group[2], "centre": np.arange(len(ids)) >= met.sum(), "v": ids, "label": labels})

    by = ("key", "chunk", "block")
    held = held.select(*by, "band", "level", "whole", "v", "label", "n", "sketch")
    return held.groupBy(*by).cogroup(stars.groupBy(*by)).applyInPandas(run, MET)


MET = "key long, chunk int, block int, centre boolean, v long, label long"


def as_met(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, la, lb) in the form of `met_in_buckets`: a is the centre of its own."""
    place = [F.col("a").alias("key"), F.lit(0).alias("chunk"), F.lit(-1).alias("block")]
    centres = pairs.select(*place, F.lit(True).alias("centre"), F.col("a").alias("v"), F.col("la").alias("label")).distinct()
    return pairs.select(*place, F.lit(False).alias("centre"), F.col("b").alias("v"), F.col("lb").alias("label")).union(centres)


def star_links(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (la, lb) of components, verified on full sets, that join what the links between the centres and the members
    of `met`, a table, join; links within what a chunk has joined are left out. Only the sets that are wanted move."""
    wanted_ids = met.select("v").distinct()
    few = wanted_ids.count() <= BROADCAST_IDS
    sets = sets.join(F.broadcast(wanted_ids) if few else wanted_ids, "v", "left_semi")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 2), dtype=np.int64)]
        side = group["centre"].to_numpy()
        left, right = group[~side], group[side]
        label, c_labels = left["label"].to_numpy(), right["label"].to_numpy()
        n = np.array([len(g) // 8 for g in left["grams"]], dtype=np.int64)
        items, place = np.unique(np.frombuffer(b"".join(left["grams"]), dtype=np.uint64), return_inverse=True)
        first, wanted = np.cumsum(n) - n, np.zeros(len(items), dtype=bool)
        _, root = np.unique(np.r_[label, c_labels], return_inverse=True)
        own, theirs = root[: len(n)], root[len(n) :]
        for k, goal in enumerate(right["grams"]):
            goal = np.frombuffer(goal, dtype=np.uint64)
            spot = np.minimum(np.searchsorted(items, goal), len(items) - 1)
            spot = spot[items[spot] == goal]
            wanted[spot] = True
            shared = np.add.reduceat(wanted[place], first, dtype=np.int64)
            wanted[spot] = False
            at = np.flatnonzero((100 * shared >= percent * (n + len(goal) - shared)) & (own != theirs[k]))
            joined, which = np.unique(own[at], return_index=True)
            if len(joined):
                out.append(np.stack([label[at[which]], np.full(len(which), c_labels[k])], axis=1))
                own[np.isin(own, joined)] = theirs[k]
                theirs[np.isin(theirs, joined)] = theirs[k]
        return pd.DataFrame(np.concatenate(out), columns=["la", "lb"])

    return met.join(sets, "v").groupBy("key", "chunk", "block").applyInPandas(run, "la long, lb long")


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(v, label) for every vertex of the links (a, b): the least vertex that can be reached. Labels pass along links
    and jump to their own label's label, so long chains take a logarithmic number of rounds."""
    arcs = scratch.table(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = scratch.table(arcs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("label")))
    while True:
        heard = arcs.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        near = labels.join(heard.withColumnRenamed("a", "v"), "v").select("v", "label", F.least("label", "m").alias("next"))
        roots = labels.select(F.col("v").alias("next"), F.col("label").alias("root"))
        fresh = scratch.table(near.join(roots, "next").select("v", F.col("label").alias("old"), F.least("next", "root").alias("label")))
        scratch.release(labels)
        labels = fresh
        if fresh.where("label < old").isEmpty():
            scratch.release(arcs)
            return fresh


def shared_keys(scratch: Scratch, every: DataFrame) -> DataFrame:
    """Of the memberships (key, band, level, age, v) those of buckets that hold at least two. The keys are written first:
    Spark then splits the join's large partitions, should a key be frequent."""
    shared = scratch.table(every.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"))
    out = scratch.table(every.join(shared, "key"))
    scratch.release(shared)
    return out


def pick_centres(wide: DataFrame, step: int) -> DataFrame:
    """(key, c, c_label, block): up to four members of each bucket: the first and the last by component, and two by chance."""
    order = F.xxhash64("v", F.lit(step)).alias("o")
    picked = wide.groupBy("key").agg(
        F.min(F.struct("label", order, "v")).alias("p0"), F.max(F.struct("label", order, "v")).alias("p1"),
        F.min(F.struct(order, "v", "label")).alias("p2"), F.max(F.struct(order, "v", "label")).alias("p3"),
    )
    four = F.array(*[F.struct(F.col(f"p{k}.v").alias("c"), F.col(f"p{k}.label").alias("c_label")) for k in range(4)])
    return picked.select("key", F.explode(F.array_distinct(four)).alias("x")).select("key", "x.c", "x.c_label", F.lit(0).alias("block"))


def near_components(scratch: Scratch, vertices: DataFrame, sets_for, percent: int, bands: int, rows: int) -> DataFrame | None:
    """(v, label) of the vertices that share a bucket, or None. vertices: (v, n, sketch); sets_for(ids) gives (v, grams)
    for the rows (v) of a table.

    The first round is over a few bands, and pairs a small bucket's members with one of them only; most members of a family
    are joined there, at few comparisons. Then all bands and all pairs follow. A bucket that has been compared in full leaves; so does one whose members are in one component."""
    every = vertices.select("v", F.posexplode(band_keys("sketch", bands, rows)).alias("band", "key"))
    members = shared_keys(scratch, every.select("key", "band", F.lit(1).alias("level"), F.lit(0).alias("age"), "v"))
    if members.isEmpty():
        return None
    ids = scratch.table(members.select("v").distinct())
    sets = scratch.table(sets_for(ids))
    sketched = scratch.table(vertices.join(ids, "v", "left_semi").select("v", "n", "sketch"))
    labels = scratch.table(ids.select("v", F.col("v").alias("label")))
    state, step = members.where(F.col("band") < FIRST_BANDS), 0
    written: list[DataFrame] = []
    while True:
        few = FEW[min(step, len(FEW) - 1)]
        wide = state.join(labels, "v").join(sketched.select("v", "n"), "v")
        wide = scratch.table(wide)
        parts = wide.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("n").alias("items")).groupBy("key")
        parts = parts.agg(F.sum("c").alias("size"), F.sum("items").alias("items"), F.max(F.struct("c", "label")).alias("top"), F.count("*").alias("labels"))
        parts = parts.where("labels > 1").select("key", "size", "items", F.col("top.label").alias("big"), (F.col("size") - F.col("top.c")).alias("minor"))
        parts = scratch.table(parts)
        open_ = scratch.table(wide.drop("n").join(parts, "key"))
        scratch.release(wide, parts, *written)
        if open_.isEmpty() and step:
            scratch.release(open_, sets, sketched, members, ids)
            return labels
        small = open_.where(F.col("size") <= SMALL).groupBy("key").agg(F.collect_list(F.struct("v", "label")).alias("m"))
        mates = F.filter("m", lambda y: (F.col("x.v") < y["v"]) & (F.col("x.label") != y["label"]))
        if step:
            cross = small.select(F.explode("m").alias("x"), "m").select("x", F.explode(mates).alias("y"))
        else:
            cross = small.select(F.sort_array("m").alias("m")).select(F.get("m", F.lit(0)).alias("x"), F.explode(F.slice("m", 2, SMALL)).alias("y"))
        cross = cross.select(F.col("x.v").alias("a"), F.col("y.v").alias("b"), F.col("x.label").alias("la"), F.col("y.label").alias("lb"))
        cross = scratch.table(cross.distinct())
        near = estimate_at_least(at_ends(cross, sketched, {"n": "n", "sketch": "s"}), percent / 100, bands * rows)
        whole = (F.col("minor") <= few) | (F.col("band") == bands - 1)
        mean = F.col("items") / F.col("size")
        parts_of = lambda n: F.ceil(F.greatest(n / CHUNK, n * mean / CHUNK_ITEMS)).cast("int")
        large = open_.where(F.col("size") > SMALL).withColumn("whole", whole).withColumn("parts", parts_of(F.col("size")))
        large = large.withColumn("blocks", F.when(F.col("whole"), parts_of(F.col("minor"))).otherwise(1))
        going = large.where("not whole")
        block = F.pmod(F.xxhash64("v", F.lit(6)), F.col("blocks")).cast("int")
        centres = large.where("whole and label <> big").select("key", F.col("v").alias("c"), F.col("label").alias("c_label"), block.alias("block"))
        centres = scratch.table(centres.unionByName(pick_centres(going.where(F.col("age") < AGED), step)))
        met = large.where(F.col("whole") | (F.col("age") < AGED))
        met = met_in_buckets(met, centres, sketched, percent / 100, bands, rows)
        near = scratch.table(near)
        met = scratch.table(met.union(as_met(near)))
        found = scratch.table(star_links(met, sets, percent).distinct())
        # Components of the links' labels, a small graph, carry the labels on.
        if not found.isEmpty():
            joined = components(scratch, found.select(F.col("la").alias("a"), F.col("lb").alias("b")))
            fresh = labels.join(joined.select(F.col("v").alias("label"), F.col("label").alias("to")), "label", "left")
            fresh = scratch.table(fresh.select("v", F.coalesce("to", "label").alias("label")))
            scratch.release(joined, labels)
            labels = fresh
        keep = going.where(F.col("age") < AGED).select("key", "band", "level", F.col("age") + 1, "v")
        if not step:
            keep = keep.union(open_.where(F.col("size") <= SMALL).select("key", "band", "level", "age", "v"))
            keep = keep.union(members.where(F.col("band") >= FIRST_BANDS).select("key", "band", "level", "age", "v"))
        split = scratch.table(going.where(F.col("age") >= AGED).select("key", "band", "level", "v"))
        written = [open_, split]
        if step >= AGED and not split.isEmpty():
            finer = split.join(sketched.select("v", "sketch"), "v").select("key", "band", "level", "v", F.posexplode(band_keys("sketch", bands, rows)).alias("later", "also"))
            finer = finer.where("later > band").select(F.xxhash64("key", "also").alias("key"), F.col("later").alias("band"), F.col("level") + 1, F.lit(1).alias("age"), "v")
            finer = shared_keys(scratch, finer.toDF("key", "band", "level", "age", "v"))
            keep, written = keep.union(finer), [*written, finer]
        state, step = keep.toDF("key", "band", "level", "age", "v"), step + 1
        scratch.release(cross, near, centres, met, found)


def near_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per row of `df`: id, n_shingles, component_id, kept (the id is its component's)."""
    spark = df.sparkSession
    scratch = Scratch(spark)
    kind = dict(df.dtypes)[id_col]
    docs = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    sketched = scratch.table(sketches(docs, width, bands * rows).withColumn("v", F.monotonically_increasing_id()))
    light = sketched.select("doc", "sha", "n", "v").withColumn("__salt", salt(spark, "v"))
    first = F.struct(F.col("doc").isNull().alias("no"), "doc", "v")
    partial = light.groupBy("sha", "__salt").agg(F.min(first).alias("f"), F.max("n").alias("n"))
    groups = partial.groupBy("sha").agg(F.min("f").alias("f"), F.max("n").alias("n"))
    groups = scratch.table(groups.select("sha", F.col("f.doc").alias("rep"), "f.v", "n"))
    # Sketches stay where they are, as long as those that are not to be vertices (copies, empty texts) are few.
    chosen = groups.where("n > 0 and rep is not null").select("v")
    others = scratch.table(light.select("v").join(chosen, "v", "left_anti"))
    few_others = others.count() <= BROADCAST_IDS
    vertices = sketched.join(F.broadcast(others), "v", "left_anti") if few_others else sketched.join(chosen, "v", "left_semi")
    vertices = scratch.table(vertices.select("v", "n", "sketch"))

    def sets_for(ids: DataFrame) -> DataFrame:
        wanted = scratch.table(groups.join(ids, "v", "left_semi").select(F.col("rep").alias("doc"), "sha", "v"))
        few = wanted.count() <= BROADCAST_IDS
        once = sets_of(docs.join(F.broadcast(wanted) if few else wanted.hint("merge"), "doc"), width)
        return once.dropDuplicates(["v"]) if repeated else once

    # Ids of several rows: a text may be found more than once.
    repeated = not docs.where("doc is not null").groupBy("doc").count().where("count > 1").isEmpty()
    labels = near_components(scratch, vertices, sets_for, percent, bands, rows)
    scratch.release(vertices, others)
    if labels is None:
        named = groups.select("sha", F.col("rep").alias("component"))
    else:
        # A component's id is the least document id of its groups.
        linked = scratch.table(groups.select("sha", "rep", "v").join(labels, "v"))
        least = scratch.table(linked.groupBy("label").agg(F.min("rep").alias("least")))
        linked = linked.select("sha", "label").join(least, "label").select("sha", "least")
        named = groups.join(linked, "sha", "left").select("sha", F.coalesce("least", "rep").alias("component"))
    out = spread(light, scratch.table(named), "sha", "__salt")
    component = F.when((F.col("n") == 0) | F.col("doc").isNull(), F.col("doc")).otherwise(F.col("component"))
    return out.select(
        F.col("doc").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.cast(kind).alias("component_id"),
        F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"),
    )


def keep_representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `df` but those that are near-duplicates of a row with a smaller id, with their own columns. Rows
    repeated under the id that stays all stay."""
    scratch = Scratch(df.sparkSession)
    (out,) = free_names(df, "__gone")
    told = near_groups(df.select(quoted(id_col), quoted(text_col)), id_col, text_col, width, percent)
    gone = scratch.table(told.where("not kept").select(F.col(quoted(id_col)).alias(out)).distinct())
    return df.join(gone, F.col(quoted(id_col)) == F.col(out), "left_anti")
