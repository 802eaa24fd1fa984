"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix, in DataFrame functions only.

Every partition permutes its rows in place. The driver draws the matrix of partition-to-shard counts: row by row
from the multivariate hypergeometric law over what the shards still lack, which is the law that a uniform
permutation of all rows would give. A permuted partition sends its first rows to shard 0, the next to shard 1,
and so on; each shard then permutes what came in. The result is a uniform random assignment whose shard sizes
are exact: n rows over k shards give n div k or one more.

The only exchange is that of the rows to their places. The second permutation runs in parts: each shard is
divided by the leading bits of a random key into parts of about `part_rows` rows, so no task holds a shard.
The permuted rows are written once to the shared folder; a lost executor cannot draw them anew.

The matrix has one row for each partition and one column for each shard; partitions are merged down to
`max_sources` before, which bounds what the driver holds and what is broadcast (max_sources * shards numbers).

Defined results: null and empty texts have no bytes and are dealt like any other row, as are repeated rows, each
of which gets its own slot. An empty table gives an empty result. Other columns go with their rows.
"""

from __future__ import annotations

import json
import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkveil.llm.common import Scratch, text_or_empty

MAX_SOURCES = 16_384
PART_ROWS = 50_000


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes that differ by one at most."""
    return np.array([rows // shards + (k < rows % shards) for k in range(shards)], dtype=np.int64)


def communication_matrix(sources: list[int], sizes: np.ndarray, seed: int) -> np.ndarray:
    """Random counts (sources x shards) with the given margins: each row is hypergeometric given those before."""
    rng, lacks = random.Random(seed), [int(x) for x in sizes]
    out = np.zeros((len(sources), len(sizes)), dtype=np.int64)
    for i, n in enumerate(sources):
        left, room = n, sum(lacks)
        for j, good in enumerate(lacks):
            room -= good
            take = hypergeometric(rng, good, room, left)
            out[i, j] = take
            lacks[j] -= take
            left -= take
    return out


def _log_factorials(a: int, b: int) -> float:
    """log(a!) - log(b!). For large numbers from the difference alone, so that no digits are lost."""
    if min(a, b) < 1000:
        return math.lgamma(a + 1) - math.lgamma(b + 1)
    tail = lambda x: 1 / (12 * x) - 1 / (360 * x**3)
    return (a - b) * (math.log(b) - 1) + (a + 0.5) * math.log1p((a - b) / b) + tail(a) - tail(b)


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` out of good + bad are good; the same exact law at every size.

    Ratio of uniforms about the mode (Stadlober): a place is proposed and taken by its probability against the mode's."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    n = good + bad
    share = good / n
    mode = (draws + 1) * (good + 1) // (n + 2)
    spread = math.sqrt(draws * share * (bad / n) * ((n - draws) / (n - 1)) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    middle = draws * share + 0.5
    while True:
        u = 1 - rng.random()
        place = middle + width * (rng.random() - 0.5) / u
        if not low <= place < high + 1:
            continue
        k = math.floor(place)
        parts = ((k, mode), (good - k, good - mode), (draws - k, draws - mode), (bad - draws + k, bad - draws + mode))
        if 2 * math.log(u) <= -sum(_log_factorials(x, y) for x, y in parts):
            return k


def uniform_shards(
    df: DataFrame, shards: int, seed: int = 20240229, max_sources: int = MAX_SOURCES, part_rows: int = PART_ROWS
) -> DataFrame:
    """`df` with its columns and shard, slot (which take the place of columns of these names): a uniform shuffle
    into `shards` shards of exact sizes."""
    spark = df.sparkSession
    scratch = Scratch(spark)
    names = [c for c in df.columns if c not in ("shard", "slot")]
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row")
    keyed = df.coalesce(max_sources).select(row, F.monotonically_increasing_id().alias("__uid"))
    keyed = keyed.withColumn("__key", F.xxhash64(F.lit(seed), F.col("__uid"))).sortWithinPartitions("__key", "__uid")
    place = F.monotonically_increasing_id()
    permuted = scratch.table(
        keyed.select("__row", "__uid", place.bitwiseAND(F.lit((1 << 33) - 1)).alias("__rank"), F.shiftright(place, 33).cast("int").alias("__source"))
    )
    counts = {r[0]: r[1] for r in permuted.groupBy("__source").count().collect()}
    sources = sorted(counts)
    sizes = shard_sizes(sum(counts.values()), shards)
    matrix = communication_matrix([counts[s] for s in sources], sizes, seed)
    ends = json.dumps([{"s": s, "e": list(map(int, np.cumsum(m)))} for s, m in zip(sources, matrix, strict=True)])
    plan = spark.range(1).select(F.explode(F.from_json(F.lit(ends), "array<struct<s:int,e:array<bigint>>>")).alias("p"))
    plan = plan.select(F.col("p.s").alias("__source"), F.col("p.e").alias("__ends"))
    sent = permuted.join(F.broadcast(plan), "__source")
    shard = F.size(F.filter("__ends", lambda e: e <= F.col("__rank"))).alias("shard")
    parts = max(16, -(-int(sizes.max(initial=0)) // part_rows))
    again = F.xxhash64(F.lit(seed + 1), F.col("__uid"))
    part = F.pmod(F.shiftrightunsigned(again, 24), F.lit(parts)).cast("int")
    sent = sent.select("__row", "__uid", shard, again.alias("__again"), part.alias("__part"))
    sizes_of_parts = sent.groupBy("shard", "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes_of_parts.select("shard", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("shard", "__part").orderBy("__again", "__uid")
    ranked = sent.withColumn("__at", F.row_number().over(inside).cast("long") - 1)
    out = ranked.join(base, ["shard", "__part"])
    return out.select("__row.*", "shard", (F.col("__base") + F.col("__at")).alias("slot"))


def unsigned_crc32(text: Column) -> Column:
    return F.crc32(text.cast("binary"))


def document_shards(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard. The documents go to their shards
    whole; size and text_crc32 are those of the text that arrived."""
    text = text_or_empty(text_col)
    out = uniform_shards(df, shards)
    return out.select(
        id_col, (F.octet_length(text) + 16).cast("long").alias("size"), unsigned_crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
