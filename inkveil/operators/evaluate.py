"""Evaluation: a corpus without repeats, a stratified sample and its split, shards, results, resuming."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkveil.functions.scalars import page_band
from inkveil.sources.scratch import written


def corpus(files: DataFrame, seed: str) -> DataFrame:
    """Files (path_order, content_sha256, page_count, text_kind): the first of each content, with its evaluation id (the
    start of a seeded hash), its stratum, and the stratum's place of first appearance."""
    first = files.where("page_count >= 1").groupBy("content_sha256").agg(F.min(F.struct("path_order", "page_count", "text_kind")).alias("f"))
    rows = first.select("content_sha256", "f.*")
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("content_sha256")), 256)
    return rows.select("*", F.left(rank, F.lit(16)).alias("evaluation_id"), F.concat(page_band(F.col("page_count")), F.lit(":"), F.col("text_kind")).alias("stratum"))


def allocation(rows: DataFrame, total: int, order: str) -> DataFrame:
    """(stratum, take): `total` over the strata by largest remainder; ties by size, then by first appearance. Strata are
    a handful, so their windows are small."""
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("size"), F.min(order).alias("first"))
    every = Window.partitionBy()
    share = F.lit(total) * F.col("size") / F.sum("size").over(every)
    s = sizes.withColumn("share", share).withColumn("whole", F.least(F.col("size"), F.floor("share")))
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc(F.col("share") - F.floor("share")), F.desc("size"), "first"))
    left = F.lit(total) - F.sum("whole").over(every)
    return s.select("stratum", (F.col("whole") + F.when(rank <= left, 1).otherwise(0)).alias("take"))


def take_first(rows: DataFrame, taken: DataFrame, order: str) -> DataFrame:
    """The first `take` rows of each stratum. Strata are a handful, so the largest `take` is read; by that literal bound
    each partition passes on that many rows of a stratum at most, and no task ranks a whole stratum."""
    most = taken.agg(F.max("take")).first()[0] or 0
    nth = F.row_number().over(Window.partitionBy("stratum").orderBy(order))
    few = rows.withColumn("__nth", nth).where(F.col("__nth") <= int(most))
    return few.join(F.broadcast(taken), "stratum").where("__nth <= take").drop("__nth", "take")


def sample(rows: DataFrame, count: int, tuning: int) -> DataFrame:
    """`count` rows in proportion to their strata, `tuning` of which are for tuning, in proportion too. The rows are read
    once, into a table; the sample, which is small, is a table too before it is split."""
    rows = written(rows)
    chosen = take_first(rows, allocation(rows, count, "path_order"), "evaluation_id")
    places = rows.groupBy("stratum").agg(F.min("path_order").alias("place"))
    chosen = written(chosen.join(F.broadcast(places), "stratum"))
    tuned = take_first(chosen, allocation(chosen, tuning, "place"), "evaluation_id").select("evaluation_id", F.lit("tuning").alias("split"))
    return chosen.drop("place").join(tuned, "evaluation_id", "left").withColumn("split", F.coalesce("split", F.lit("holdout")))


def _places(values: np.ndarray, loads: np.ndarray, step: int) -> np.ndarray:
    """Where the n-th entries of a class go, n counted from 0: entries of `step` pages each, each to the least loaded shard, the
    first of equals. That is the n-th smallest of all (load + k * step, shard), k = 0, 1, .., found by halving."""
    low, high = np.full(len(values), loads.min()), np.full(len(values), loads.max() + step * (values.max() + 1))
    taken = lambda t: np.maximum((t[:, None] - loads) // step + 1, 0)
    while (low < high).any():
        middle = (low + high) // 2
        enough = taken(middle).sum(axis=1) > values
        low, high = np.where(enough, low, middle + 1), np.where(enough, middle, high)
    at_level = (low[:, None] >= loads) & ((low[:, None] - loads) % step == 0)
    nth = values - taken(low - 1).sum(axis=1)
    return np.argmax(np.cumsum(at_level, axis=1) > nth[:, None], axis=1)


def _leveled(loads: np.ndarray, step: int, count: int) -> np.ndarray:
    """Loads after `count` entries of `step` pages."""
    low, high = int(loads.min()), int(loads.max()) + step * (count + 1)
    taken = lambda t: np.maximum((t - loads) // step + 1, 0)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if taken(middle).sum() >= count else (middle + 1, high)
    under = taken(low - 1)
    at_level = (low >= loads) & ((low - loads) % step == 0)
    return loads + step * (under + (at_level & (np.cumsum(at_level) <= count - under.sum())))


def lpt_shards(rows: DataFrame, shards: int) -> DataFrame:
    """(evaluation_id, page_count, shard): largest first, each to the shard with the fewest pages so far, equals by id.

    Entries of equal page counts are a class, and there are few classes (`MAX_PAGES`): the driver levels the loads class by
    class, from the classes' sizes alone. Within its class an entry's shard follows from its number, which it has from a global
    sort and its part's place in it. No task holds a class, however many entries it has."""
    ordered = written(rows.select("evaluation_id", "page_count").orderBy(F.desc("page_count"), "evaluation_id").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    sizes = sorted(map(tuple, ordered.groupBy("page_count", "part").agg(F.count("*"), F.min("at")).collect()), key=lambda r: (-r[0], r[1]))
    loads, starts, before = np.zeros(shards, np.int64), [], {}
    for pages, own in groupby(sizes, key=lambda r: r[0]):
        counted = 0
        before[pages] = loads.copy()
        for _, part, n, first in own:
            starts.append((pages, part, counted - first))
            counted += n
        loads = _leveled(loads, pages, counted)
    kind = dict(rows.dtypes)["page_count"]
    base = rows.sparkSession.createDataFrame(starts, f"page_count {kind}, part int, base long") if starts else None
    if base is None:
        return ordered.select("evaluation_id", "page_count", F.lit(0).alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, number = batch.column("page_count").to_numpy(), batch.column("number").to_numpy()
            shard = np.zeros(len(pages), np.int64)
            for size in np.unique(pages):
                own = np.flatnonzero(pages == size)
                shard[own] = _places(number[own], before[int(size)], int(size))
            yield pa.RecordBatch.from_arrays([batch.column("evaluation_id"), batch.column("page_count"), pa.array(shard, pa.int32())], names=["evaluation_id", "page_count", "shard"])

    numbered = ordered.join(base, ["page_count", "part"]).select("evaluation_id", "page_count", (F.col("at") + F.col("base")).alias("number"))
    return numbered.mapInArrow(run, f"evaluation_id string, page_count {kind}, shard int")


def results(found: DataFrame, residual: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, findings, model_findings, deterministic_findings, residual, passed) for every document."""
    n = found.groupBy("doc_id").agg(
        F.count("*").alias("findings"), F.count_if(F.col("source") == "model").alias("model_findings"), F.count_if(F.col("source") != "model").alias("deterministic_findings")
    )
    out = docs.select("doc_id").join(n, "doc_id", "left").join(residual.select("doc_id", "residual"), "doc_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("findings", "model_findings", "deterministic_findings", "residual")]
    return out.select("doc_id", *zero, (F.coalesce("residual", F.lit(0)) == 0).alias("passed"))


def pending(entries: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Entries that a checkpoint has no result for."""
    return entries.join(done.select(key), key, "left_anti")


def same_run(checkpoint: dict, config: dict) -> bool:
    """A checkpoint belongs to a run only if their configurations are equal."""
    return checkpoint == config
