"""A queue of messages in a shared folder, as a sink and as a streaming source with acknowledgement.

`enqueue` appends messages as files of lines, in two phases. The source gives every file to one batch: what it hands out is
written down in the folder before Spark asks for it, so offsets are the numbers of these lists. A batch's files are deleted, that
is, acknowledged, when Spark commits it, not before: after a crash the same lists give the same rows again, and nothing that
was acknowledged comes back. Bodies that are no messages travel on with their error, for a quarantine table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

from inkveil.sinks.staged import store_of

ROWS = "file string, line int, body string"
ROW_FIELDS = pa.schema([("file", pa.string()), ("line", pa.int32()), ("body", pa.string())])
#: Files that one task of a batch reads, and about how many bytes of them at most.
FILES_PER_TASK, TASK_BYTES = 32, 32 << 20
#: A task's messages go to a new file after so many bytes.
FILE_BYTES = 8 << 20
#: Bytes of a file that are read, and lines that are handed on, at a time.
BLOCK_BYTES = 1 << 20


@dataclass
class Files(InputPartition):
    names: list[str]


@dataclass
class Sent(WriterCommitMessage):
    names: list[str]


class FolderQueue:
    """The folder: messages in `new`, the lists of handed-out files in `batches`."""

    def __init__(self, path: str):
        self.store, root = store_of(path.rstrip("/"))
        self.new, self.lists = f"{root}/new", f"{root}/batches"

    def names(self, folder: str) -> list[str]:
        found = self.store.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == pafs.FileType.File and not f.base_name.startswith("."))

    def put(self, folder: str, name: str, data: bytes) -> None:
        """A file that is there whole or not at all."""
        self.store.create_dir(folder, recursive=True)
        with self.store.open_output_stream(f"{folder}/.{name}") as to:
            to.write(data)
        self.store.move(f"{folder}/.{name}", f"{folder}/{name}")

    def lines(self, path: str) -> Iterator[list[bytes]]:
        """A file's whole lines, some at a time."""
        rest = b""
        with self.store.open_input_stream(path) as of:
            while block := of.read(BLOCK_BYTES):
                *lines, last = block.split(b"\n")
                if lines:
                    lines[0], rest = rest + lines[0], last
                    yield lines
                else:
                    rest += last

    def get(self, path: str) -> bytes:
        with self.store.open_input_stream(path) as of:
            return of.read()

    def drop(self, path: str) -> None:
        if self.store.get_file_info(path).type == pafs.FileType.File:
            self.store.delete_file(path)


class QueueReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def _list(self, queue: FolderQueue, number: int) -> list[str]:
        return json.loads(queue.get(f"{queue.lists}/{number:012d}"))

    def latestOffset(self) -> dict:
        """Writes down what came since the last list, if anything did."""
        queue = FolderQueue(self.path)
        numbers = [int(n) for n in queue.names(queue.lists)]
        given = {n for k in numbers for n in self._list(queue, k)}
        fresh = [n for n in queue.names(queue.new) if n not in given]
        last = max([0, *numbers, getattr(self, "last", 0)])
        if fresh:
            last += 1
            queue.put(queue.lists, f"{last:012d}", json.dumps(fresh).encode())
        self.last = last
        return {"batch": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        queue = FolderQueue(self.path)
        there = set(queue.names(queue.lists))
        names = [n for k in range(start["batch"] + 1, end["batch"] + 1) if f"{k:012d}" in there for n in self._list(queue, k)]
        self.last = max(end["batch"], getattr(self, "last", 0))
        sizes = {f.base_name: f.size or 0 for f in queue.store.get_file_info(pafs.FileSelector(queue.new, allow_not_found=True))}
        parts, room = [], 0
        for name in names:
            size = sizes.get(name, 0)
            if not parts or size > room or len(parts[-1].names) == FILES_PER_TASK:
                parts.append(Files([]))
                room = TASK_BYTES
            parts[-1].names.append(name)
            room -= size
        return parts  # type: ignore[return-value]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        queue = FolderQueue(self.path)
        for name in partition.names:
            first = 0
            for lines in queue.lines(f"{queue.new}/{name}"):
                bodies = pa.array([x.decode(errors="replace") for x in lines], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines)), pa.array(range(first, first + len(lines)), pa.int32()), bodies], schema=ROW_FIELDS)
                first += len(lines)

    def commit(self, end: dict) -> None:
        """Acknowledges: the files of all lists up to `end` go, then the lists but the last, which keeps the count."""
        queue = FolderQueue(self.path)
        numbers = [int(n) for n in queue.names(queue.lists)]
        for number in (k for k in numbers if k <= end["batch"]):
            for name in self._list(queue, number):
                queue.drop(f"{queue.new}/{name}")
            if number < max(numbers):
                queue.drop(f"{queue.lists}/{number:012d}")


class QueueWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Sent:
        """One task's messages as files, which nobody sees before the commit, written as they come. A body's line breaks are blanks."""
        queue, names, to, room = FolderQueue(self.path), [], None, 0
        try:
            for batch in iterator:
                for at in range(0, batch.num_rows, 10_000):
                    bodies = batch.column("body")[at : at + 10_000].to_pylist()
                    lines = "".join(f"{(b or '').replace('\r', ' ').replace('\n', ' ')}\n" for b in bodies).encode()
                    if to is None or room < len(lines):
                        if to is not None:
                            to.close()
                        names.append(f"m-{uuid.uuid4().hex}")
                        queue.store.create_dir(f"{queue.new}-staging", recursive=True)
                        to, room = queue.store.open_output_stream(f"{queue.new}-staging/{names[-1]}"), FILE_BYTES
                    to.write(lines)
                    room -= len(lines)
        except BaseException:
            self.abort([Sent(names)])
            raise
        finally:
            if to is not None:
                to.close()
        return Sent(names)

    def commit(self, messages: list[Sent | None]) -> None:
        queue = FolderQueue(self.path)
        queue.store.create_dir(queue.new, recursive=True)
        for m in messages:
            for name in m.names if m else ():
                queue.store.move(f"{queue.new}-staging/{name}", f"{queue.new}/{name}")

    def abort(self, messages: list[Sent | None]) -> None:
        queue = FolderQueue(self.path)
        for m in messages:
            for name in m.names if m else ():
                queue.drop(f"{queue.new}-staging/{name}")


class QueueSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "message_folder"

    def schema(self) -> str:
        return ROWS

    def streamReader(self, schema) -> QueueReader:
        return QueueReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> QueueWriter:
        return QueueWriter(self.options["path"])


def enqueue(bodies: DataFrame, path: str) -> None:
    """Appends messages (body) to the queue."""
    bodies.sparkSession.dataSource.register(QueueSource)
    bodies.select(F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), "body").write.format("message_folder").mode("append").save(path)


def message_stream(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, body, job_id, task, error_code) of the queue's messages as they come; `message_malformed` ones keep
    their body and have no job."""
    spark.dataSource.register(QueueSource)
    m = F.from_json("body", "schema_version int, job_id string, task string")
    good = F.coalesce((m["schema_version"] == 1) & m["job_id"].isNotNull() & m["task"].isin("detect", "redact"), F.lit(False))
    rows = spark.readStream.format("message_folder").load(path).withColumns({"m": m, "good": good})
    return rows.select(
        "file", "line", "body", F.when(F.col("good"), F.col("m.job_id")).alias("job_id"), F.when(F.col("good"), F.col("m.task")).alias("task"),
        F.when(~F.col("good"), F.lit("message_malformed")).alias("error_code"),
    )
