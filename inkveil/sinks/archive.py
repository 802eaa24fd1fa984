"""Batches of files as ZIP archives, with a list of what is in them."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from inkveil.sinks.staged import StagedWriter, store_of

ROWS = "archive string, position int, name string, content binary, listed string"
#: A plain archive holds no more files, and no more bytes, than these.
MOST_FILES, MOST_BYTES = 65_535, (1 << 32) - 1
INDEX = "index.csv"
#: Entries of an archive that a task reads at least, spans of an archive at most, and bytes of entries that are handed on at a time.
ENTRIES_PER_TASK, MOST_SPANS, BATCH_BYTES = 5_000, 16, 1 << 20


class Archive:
    """A ZIP whose entries are written as they come; the list, if there is one, comes last."""

    def __init__(self, to: BinaryIO):
        self.zip, self.lines = zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED), []

    def add(self, row: dict[str, Any]) -> None:
        self.zip.writestr(zipfile.ZipInfo(row["name"]), row["content"] or b"", zipfile.ZIP_DEFLATED)
        if row["listed"] is not None:
            self.lines.append(row["listed"])

    def finish(self) -> None:
        if self.lines:
            self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(f"{x}\r\n" for x in self.lines), zipfile.ZIP_DEFLATED)
        self.zip.close()


class ArchiveWriter(StagedWriter):
    def begin(self, name: str, to: BinaryIO) -> Archive:
        return Archive(to)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_archive"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        if overwrite:
            raise ValueError("zip_archive appends; choose a new folder")
        return ArchiveWriter(self.options["path"])


def archive_errors(files: DataFrame, listed: bool, wide: bool = False) -> DataFrame:
    """(archive, files, bytes, error_code) of files (archive, name, content): too many, too large, or a name twice. A `wide`
    archive (ZIP64, as which a large one is written) may hold any number of files and bytes."""
    out = files.groupBy("archive").agg(F.count("*").alias("files"), F.sum(F.octet_length("content")).alias("bytes"), F.countDistinct("name").alias("names"))
    many, large, plain = F.col("files") + int(listed) > MOST_FILES, F.col("bytes") > MOST_BYTES, F.lit(not wide)
    error = F.when(plain & many, "too_many_files").when(plain & large, "archive_too_large").when(F.col("names") < F.col("files"), "duplicate_name")
    return out.select("archive", "files", "bytes", error.alias("error_code"))


def archive_entries(stored: DataFrame) -> DataFrame:
    """(path, name, content) of the entries of archives (path). An archive is opened where it lies and read entry by entry, in
    spans that are dealt over the tasks; none holds more than the archive's directory and some entries at a time."""
    listed = pa.schema([("path", pa.string()), ("first", pa.int64()), ("each", pa.int64())])
    fields = pa.schema([("path", pa.string()), ("name", pa.string()), ("content", pa.binary())])

    def opened(path: str) -> tuple[pa.NativeFile, zipfile.ZipFile]:
        store, at = store_of(path)
        of = store.open_input_file(at)
        return of, zipfile.ZipFile(of)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                of, held = opened(path)
                with of, held:
                    n = len(held.infolist())
                each = max(ENTRIES_PER_TASK, -(-n // MOST_SPANS))
                yield pa.RecordBatch.from_pylist([{"path": path, "first": k, "each": each} for k in range(0, n, each)], schema=listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, each in zip(*(batch.column(k).to_pylist() for k in ("path", "first", "each")), strict=True):
                of, held = opened(path)
                rows, size = [], 0
                with of, held:
                    for entry in held.infolist()[first : first + each]:
                        rows.append({"path": path, "name": entry.filename, "content": held.read(entry)})
                        size += entry.file_size
                        if size > BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=fields)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=fields)

    found = stored.select("path").mapInArrow(spans, "path string, first long, each long")
    dealt = found.repartition(4 * stored.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInArrow(run, "path string, name string, content binary")


def write_archives(files: DataFrame, path: str) -> None:
    """Writes an archive for each `archive` of files (archive, position, name, content, listed): `listed` is a file's line of
    the list, null for none. An archive's files go to one task, which its limits bound, and are written as they come."""
    files.sparkSession.dataSource.register(ArchiveSource)
    rows = files.select("archive", F.col("position").cast("int").alias("position"), "name", "content", "listed")
    rows.repartition("archive").sortWithinPartitions("archive", "position").write.format("zip_archive").mode("append").save(path)
