"""WARC archives in Zstandard: a writer with one frame per record, and a reader.

An archive starts with a skippable frame that holds the dictionary (trained on a bounded sample of the archive's
first records; where these are too few, some of their text), then one frame follows per record. The reader
loads the dictionary from that frame, decodes one frame at a time and checks each record: the version line, the
named fields, the block's length, the block digest, and for records with a payload its length and digest.

Pages with equal payloads are written once: the page with the smallest id is the response, the others are revisit
records without a body, whose HTTP head still says the payload's length. Equal payloads are found by SHA-256 over
light rows; a payload that a third of all pages share is spread by salt. The pages themselves move once.

An archive is a row (archive, content) of at most about `archive_bytes` of records, so archives lie in any storage
that Spark writes; `save_files` writes them as files, and the reader takes these back through Spark's binaryFile.

Defined results: null html is an empty payload. Rows repeated under the smallest id are each a response. Null ids come
last among equal payloads. A null URL leaves the target out. An empty table gives no archive. Damage to a record
gives a row with `error` set and, for a broken frame, ends that archive. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import Scratch, salt, spread

DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
ARCHIVE_BYTES, SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 16 << 20, 256, 2 << 20, 32 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC record; a revisit holds the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:x-page:{'' if page_id is None else page_id}>")]
    fields += [("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:x-page:{refers_to}>")]
    fields += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; their own start where there are too few to train one."""
    try:
        if len(samples) >= 16:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        pass
    return b"".join(s[:2048] for s in samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"


class ArchiveWriter:
    """Gathers records; `finish` gives the archive's bytes. Holds a sample of records until there is a dictionary."""

    def __init__(self):
        self.waiting, self.out, self.raw, self.compressor = [], bytearray(), 0, None

    def add(self, data: bytes) -> None:
        self.raw += len(data)
        if self.compressor is not None:
            self.out += self.compressor.compress(data)
            return
        self.waiting.append(data)
        if len(self.waiting) >= SAMPLE_RECORDS or self.raw >= SAMPLE_BYTES:
            self._start()

    def _start(self) -> None:
        data = train(self.waiting)
        self.out += struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data
        self.compressor = zstandard.ZstdCompressor(
            level=3, dict_data=zstandard.ZstdCompressionDict(data), write_checksum=True, write_content_size=True
        )
        for x in self.waiting:
            self.out += self.compressor.compress(x)
        self.waiting = []

    def finish(self) -> bytes:
        if self.compressor is None and self.waiting:
            self._start()
        return bytes(self.out)


def frames(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one per frame."""
    at, dictionary = 0, None
    while at < len(content):
        (magic,) = struct.unpack_from("<I", content, at) if at + 4 <= len(content) else (0,)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            if at + 8 > len(content):
                raise ValueError("skippable frame is cut off")
            (size,) = struct.unpack_from("<I", content, at + 4)
            if at + 8 + size > len(content):
                raise ValueError("skippable frame is cut off")
            if at == 0 and magic == DICTIONARY_MAGIC:
                data = content[8 : 8 + size]
                if data[:4] == FRAME_MAGIC:
                    data = zstandard.ZstdDecompressor().decompress(data)
                dictionary = zstandard.ZstdCompressionDict(data)
            at += 8 + size
            continue
        if content[at : at + 4] != FRAME_MAGIC:
            raise ValueError("no Zstandard frame")
        decoder = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        out = []
        while not decoder.eof:
            chunk = content[at : at + 65536]
            if not chunk:
                raise ValueError("frame is cut off")
            out.append(decoder.decompress(chunk))
            at += len(chunk) - len(decoder.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> dict:
    """The checked record: page_id (text), payload_bytes, payload_digest, record_type, refers_to (text), target."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.1", b"WARC/1.0"):
        raise ValueError("no WARC head")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("field without a colon")
        fields[name.decode().lower()] = value.strip().decode("utf-8", "surrogatepass")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("block length differs")
    block = rest[:size]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    told = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    kind, said = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        if told and told[0] != len(payload):
            raise ValueError("payload length differs")
        if said and said != digest(payload):
            raise ValueError("payload digest differs")
    elif kind == "revisit" and not (told and said):
        raise ValueError("revisit without length or digest")
    own = lambda x: x.removeprefix("<urn:x-page:").removesuffix(">") or None
    return {
        "page_id": own(fields["warc-record-id"]),
        "payload_bytes": told[0] if told else len(payload),
        "payload_digest": said or digest(payload),
        "record_type": kind,
        "refers_to": own(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
        "target": fields.get("warc-target-uri"),
        "payload": payload if kind == "response" else None,
    }


def decisions(df: DataFrame, least_bytes: int) -> DataFrame:
    """(id, sha, first, revisit): one row for each id and payload. df: (id, payload)."""
    light = df.select("id", F.sha2("payload", 256).alias("sha"), F.octet_length("payload").alias("n")).withColumn("__salt", salt(df.sparkSession, "id"))
    order = F.struct(F.col("id").isNull().alias("no"), F.col("id").alias("id"))
    partial = light.groupBy("sha", "__salt").agg(F.min(order).alias("f"))
    groups = partial.groupBy("sha").agg(F.min("f").alias("f")).select("sha", F.col("f.id").alias("first"))
    rows = spread(light.select("id", "sha", "n", "__salt").distinct(), groups, "sha", "__salt")
    again = ~F.col("id").eqNullSafe(F.col("first")) & (F.col("n") >= least_bytes)
    return rows.select("id", "sha", "first", again.alias("revisit"))


def write_archives(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """(archive, records, content): the pages as archives. Payloads of under `least_bytes` are all responses."""
    pages = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    said = decisions(pages, least_bytes).select(F.col("id").alias("__id"), F.col("sha").alias("__sha"), "first", "revisit")
    rows = pages.withColumn("sha", F.sha2("payload", 256))
    rows = rows.join(said, F.col("id").eqNullSafe(F.col("__id")) & (F.col("sha") == F.col("__sha")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, writer, held = TaskContext.get().partitionId(), 0, ArchiveWriter(), 0

        def row() -> pa.RecordBatch:
            name = f"pages-{part:06d}-{number:04d}.warc.zst"
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([held], pa.int64()), pa.array([writer.finish()], pa.binary())],
                names=["archive", "records", "content"],
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                for r in batch.slice(at, 100).to_pylist():
                    writer.add(record(r["id"], r["url"], r["payload"], r["first"], r["revisit"]))
                    held += 1
                    if writer.raw >= archive_bytes:
                        yield row()
                        number, writer, held = number + 1, ArchiveWriter(), 0
        if held:
            yield row()

    return rows.select("id", "url", "payload", "first", "revisit").mapInArrow(run, "archive string, records long, content binary")


def read_archives(archives: DataFrame, content_col: str = "content", with_payload: bool = False) -> DataFrame:
    """The records of archives: page_id, payload_bytes, payload_digest, record_type, refers_to, target[, payload], error.
    Ids are texts. `archives` may come from write_archives or from spark.read.format("binaryFile")."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target", *["payload"] * with_payload, "error"]
    kinds = {"payload_bytes": "long", "payload": "binary"}
    schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(kinds.get(n), pa.string())) for n in names])

    def rows_of(content: bytes) -> Iterator[dict]:
        try:
            for data in frames(content):
                try:
                    yield parse(data)
                except (ValueError, UnicodeDecodeError) as e:
                    yield {"error": str(e)}
        except (ValueError, zstandard.ZstdError) as e:
            yield {"error": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found: list[dict] = []
                for r in rows_of(batch.column("content")[k].as_py() or b""):
                    found.append({n: r.get(n) for n in names})
                    if len(found) >= 500:
                        yield pa.RecordBatch.from_pylist(found, schema=schema)
                        found = []
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=schema)

    ddl = ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names)
    return archives.select(F.col(content_col).alias("content")).mapInArrow(run, ddl)


def save_files(archives: DataFrame, uri: str) -> DataFrame:
    """Writes each archive as a file under `uri`, any store that pyarrow opens from the executors; (archive, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for r in batch.to_pylist():
                name = f"{root}/{r['archive']}"
                with store.open_output_stream(f"{name}.part") as out:
                    out.write(r["content"])
                store.move(f"{name}.part", name)
                yield pa.RecordBatch.from_pydict({"archive": [r["archive"]], "bytes": [len(r["content"])]})

    return archives.select("archive", "content").mapInArrow(run, "archive string, bytes long")


def archived_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the pages to archives, reads these back: one row per page as its record says it."""
    archives = Scratch(df.sparkSession).table(write_archives(df, id_col, url_col, html_col))
    kind = dict(df.dtypes)[id_col]
    out = read_archives(archives)
    return out.select(
        F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"), "error",
    )
