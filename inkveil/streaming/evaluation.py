"""An evaluation run that can be killed at any time and started again.

The entries of a split are written once, shard by shard, beside the run's configuration, which a later start must equal. A
stream takes a shard a batch; a batch's results overwrite the folder of its number, so a batch that is run again replaces
itself, and Spark's checkpoint says which batch comes next. Counters come from the batch's own plan as it runs. At the end
every entry must have its one result; the summary is written, and the marker last. A run that has its marker does nothing."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from inkveil.operators.evaluate import lpt_shards, same_run
from inkveil.operators.records import checkpoint_error, run_summary
from inkveil.sinks.staged import store_of

#: What an evaluation gives for each entry, besides what it has of its own.
RESULT = ("evaluation_id", "split", "page_count", "elapsed_seconds", "finding_count", "residual_deterministic", "residual_model", "passed", "error_code")


class RunFolder:
    """Small control files of a run; each is there whole or not at all."""

    def __init__(self, path: str):
        self.store, self.root = store_of(path.rstrip("/"))

    def write(self, name: str, value: Any) -> None:
        folder = f"{self.root}/{name}".rpartition("/")[0]
        self.store.create_dir(folder, recursive=True)
        part = f"{folder}/.{name.rpartition('/')[2]}.part"
        with self.store.open_output_stream(part) as to:
            to.write(json.dumps(value, indent=1, sort_keys=True).encode())
        self.store.move(part, f"{self.root}/{name}")

    def read(self, name: str) -> Any:
        if self.store.get_file_info(f"{self.root}/{name}").type != pafs.FileType.File:
            return None
        with self.store.open_input_stream(f"{self.root}/{name}") as of:
            return json.loads(of.read())

    def names(self, folder: str) -> list[str]:
        found = self.store.get_file_info(pafs.FileSelector(f"{self.root}/{folder}", allow_not_found=True))
        return sorted(f.base_name for f in found if not f.base_name.startswith("."))


def stage(entries: DataFrame, path: str, split: str, shards: int, config: dict) -> dict:
    """Writes the split's entries, shard by shard, and then the configuration that says they are there; a folder that has one
    must have the same."""
    folder = RunFolder(path)
    wanted = json.loads(json.dumps(config | {"split": split, "shards": shards}))
    held = folder.read("run.json")
    if held is not None:
        if not same_run(held, wanted):
            raise ValueError("evaluation_checkpoint_invalid: the run was begun with another configuration")
        return wanted
    own = entries.where(F.col("split") == split)
    dealt = own.join(lpt_shards(own, shards).select("evaluation_id", "shard"), "evaluation_id")
    dealt.repartition("shard").sortWithinPartitions("shard", "evaluation_id").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/entries")
    folder.write("run.json", wanted)
    return wanted


def evaluation_run(
    entries: DataFrame, evaluate: Callable[[DataFrame], DataFrame], path: str, split: str, shards: int = 8, config: dict | None = None
) -> DataFrame:
    """The results (`RESULT`) of all entries (evaluation_id, split, page_count, and what `evaluate` needs) of a split."""
    spark: SparkSession = entries.sparkSession
    folder = RunFolder(path)
    stage(entries, path, split, shards, config or {})
    if folder.read("complete.json") is None:
        held = spark.read.parquet(f"{path}/entries")
        stream = spark.readStream.schema(held.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/entries")

        def take(batch: DataFrame, number: int) -> None:
            seen = Observation(f"batch-{number}")
            counters = [F.count("*").alias("documents"), F.sum("page_count").alias("pages"), F.count_if("passed").alias("passed"), F.count_if(F.col("error_code").isNotNull()).alias("failures")]
            rows = evaluate(batch.drop("shard")).select(*RESULT)
            rows.observe(seen, *counters).write.mode("overwrite").parquet(f"{path}/results/batch={number}")
            folder.write(f"progress/{number:08d}.json", {k: v or 0 for k, v in seen.get.items()})

        query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        _finish(spark, folder, held, path, split)
    return spark.read.parquet(f"{path}/results").drop("batch")


def _finish(spark: SparkSession, folder: RunFolder, held: DataFrame, path: str, split: str) -> None:
    if not folder.names("results"):
        raise ValueError("evaluation_checkpoint_invalid: no entries")
    results = spark.read.parquet(f"{path}/results").drop("batch")
    code = checkpoint_error(results, held, split).first()
    if code.error_code is not None or code.results != held.count():
        raise ValueError(f"evaluation_checkpoint_invalid: {code.results} results")
    total = run_summary(results, "split").first().asDict()
    folder.write(f"summary-{split}.json", total)
    folder.write("complete.json", progress(path))


def progress(path: str) -> dict[str, int]:
    """The counters of all batches so far: documents, pages, passed, failures."""
    folder = RunFolder(path)
    told = [folder.read(f"progress/{n}") for n in folder.names("progress")]
    return {k: sum(t[k] for t in told) for k in ("documents", "pages", "passed", "failures")}
