"""Shared pieces of the training-data operators: white space, scratch tables, skew-free group joins."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words everywhere in this package.
WS = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
WS_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder; any file system that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the session's spark.checkpoint.dir. Where that is unset, a folder of
    our own serves on a single machine, as in tests; on a cluster it is an error, since executors do not share it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "/tmp/checkpoints/inkveil"
    return root.rstrip("/")


class Scratch:
    """Intermediate tables, written as Parquet to the shared folder, so that a lost executor costs no
    recomputation of what came before. `release` removes those that no later step reads; what the result still reads
    is removed when the driver's Python ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{scratch_root(spark)}/t-{uuid.uuid4().hex}", {}
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        atexit.register(self.remove)

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.conf).delete(at, True)

    def release(self, *frames: DataFrame) -> None:
        for df in frames:
            self._delete(self.paths.pop(id(df))[0])

    def remove(self) -> None:
        """Removes all tables. At the end of the driver the JVM may have gone before."""
        with contextlib.suppress(Exception):
            self._delete(self.root)


def salts(spark: SparkSession) -> int:
    """Into how many parts a group is split where it is joined: as many as there are shuffle partitions."""
    return max(64, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def salt(spark: SparkSession, *cols: str | Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(salts(spark))).cast("int")


def spread(rows: DataFrame, groups: DataFrame, key: str, salt_col: str) -> DataFrame:
    """Joins one row per `key` of `groups` to all `rows` with that key, however many these are.

    The rows of a key are dealt by (key, salt). Only the distinct (key, salt) pairs meet the group's own
    row, so no task gets more than a salt's share of a large group. Keys must not be null."""
    slots = rows.select(key, salt_col).distinct()
    return rows.join(slots.join(groups, key), [key, salt_col])


def quoted(name: str) -> str:
    """A column's name as an expression, whatever signs it has."""
    return "`" + name.replace("`", "``") + "`"


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, or longer ones where `df` has columns that are called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A to Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The words of a text, in order; an empty array where there are none."""
    inner = F.btrim(text, F.lit(WS_CHARS))
    return F.when(F.length(inner) == 0, F.array().cast("array<string>")).otherwise(F.split(inner, WS))


def byte_slices(column: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `size` bytes of text each; one row at least."""
    ends = np.cumsum(np.array(pc.fill_null(pc.binary_length(column), 0)))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield at, to
        at = to


def keep_freed_memory() -> None:
    """Lets a worker's C library keep up to 16 MB that is freed instead of giving it back to the system at once: loops that
    make and drop arrays of some hundred kB would have each of their pages mapped and cleared anew. Without glibc nothing changes."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD
        libc.mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD
