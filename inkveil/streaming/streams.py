"""Streaming twins: daily metrics, visits and the job machine over a folder of event files.

Event times come as zone-less timestamps and are read as UTC. Each stream runs until all files present are read
(availableNow) and hands back its result; `*_stream` give the streaming DataFrames for a service to run on."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkveil.schemas import TERMINAL, TRANSITIONS

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
TRIGGERS = ("submit", "claim", "detected", "finalize", "claim", "complete", "requeue")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parque[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_stream(points: DataFrame, late: str = "1 day") -> DataFrame:
    """(date, name, total, points) per UTC day; points later than `late` are left out."""
    days = points.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "name").agg(F.sum("value").alias("total"), F.count("*").alias("points"))
    return days.select(F.date_format("w.start", "yyyy-MM-dd").alias("date"), "name", "total", "points")


def visit_stream(views: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, views): sessions that a gap of more than `gap` ends."""
    sessions = views.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("views"))
    return sessions.select("user_id", F.col("w.start").alias("start"), "views")


def job_stream(triggers: DataFrame) -> DataFrame:
    """(job, status, version, applied, refused) after each batch, of triggers (job, ord, trigger); state by job."""
    edges = {(t, a): b for t, a, b in TRANSITIONS}

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, version, refused = state.get if state.exists else ("awaiting_upload", 1, 0)
        for trigger in pd.concat(list(frames)).sort_values("ord")["trigger"]:
            to = edges.get((trigger, status))
            if trigger == "delete" and status not in TERMINAL:
                to = "deleted"
            elif trigger == "expire" and status == "deleted":
                to = "expired"
            if to is None:
                refused += 1
            else:
                status, version = to, version + 1
        state.update((status, version, refused))
        yield pd.DataFrame({"job": [key[0]], "status": [status], "version": [version], "applied": [version - 1], "refused": [refused]})

    return triggers.groupBy("job").applyInPandasWithState(
        run, "job long, status string, version int, applied int, refused int", "status string, version int, refused int", "update", GroupStateTimeout.NoTimeout
    )


def stream_root(spark: SparkSession) -> str:
    """A fresh folder below the shared one; without spark.checkpoint.dir one of our own, on a single machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "/tmp/checkpoints/inkveil"
    return f"{root.rstrip('/')}/s-{uuid.uuid4().hex}"


def run_to_end(stream: DataFrame, mode: str, *keys: str) -> DataFrame:
    """Runs a stream over what is there and gives its result, from the rows that each batch writes to the shared folder: of
    mode `complete` the last batch, which holds all; of `update` each key's last row; of `append` every row."""
    spark = stream.sparkSession
    root = stream_root(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/rows/batch={number:08d}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    started = query.lastProgress
    query.stop()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    if not started:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(schema).parquet(f"{root}/rows")
    if mode == "append":
        return rows.drop("batch")
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        return rows.where(F.col("batch") == F.lit(-1 if last is None else last)).drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("r")).select(*[k if k in keys else F.col(f"r.{k}") for k in stream.columns])
