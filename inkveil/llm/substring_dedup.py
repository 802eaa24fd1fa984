"""Substring deduplication by seed and extend: winnowed anchors, matches extended both ways, maximal repeats removed.

A seed is `SEED` consecutive words; the anchor of a window of `WINDOW` words is the seed in it with the smallest hash, the
first of several. Equal windows have equal anchors at equal places, so documents meet on anchors alone: an anchor occurrence
travels once, with one fingerprint for each way in which its seed extends left and right to a whole window. Where two
occurrences of an anchor meet and an extension agrees, the window is a repeat; that of the smallest document stays. Windows
that follow each other grow into maximal repeats of `WINDOW` words or more.

Documents are read in chunks of about `CHUNK_WORDS` words. In a chunk, repeats of a smaller document of the same chunk are
settled on the spot and do not travel: however many documents share a passage, each chunk sends it once. Anchors are dealt
over partitions of a bounded size by their hash, in packed columns. Words are compared by 64-bit hashes, extensions by 48
bits among occurrences whose anchors agree in 40 bits and in the partition's number.

Defined results: a null or empty text has no words and loses none. Fewer than 13 words make no window. A null id counts as
larger than all others; its text still loses what documents with an id have. Rows of equal id are not smaller than one
another and do not touch each other, whatever their texts; an equal text among them gives equal results. Very long texts
are processed whole, in a chunk of their own. An empty table gives an empty result. Other columns are ignored by the query;
`without_repeats` returns the id, the counts and the text that is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import salts, text_or_empty

WINDOW = 13
SEED = 5
CHUNK_WORDS = 1_000_000
CHUNK_CACHE = 500_000
PART_BYTES = 8 << 20
#: Bytes of an anchor and of an extension that travel.
ANCHOR_BYTES, EXTENSION_BYTES = 5, 6
NULL_ID = 2**63 - 1

PACKED = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("anchors", "extensions", "counts", "starts", "ends", "ids", "marks"))])
PACKED_DDL = "part int, anchors binary, extensions binary, counts binary, starts binary, ends binary, ids binary, marks binary"
SPANS_DDL = "id long, mark long, start int, end int"


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over all 64 (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _factors(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(seed)) | np.uint64(1)


class WordHashes(dict):
    """Words to 64-bit hashes, remembered."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CHUNK_CACHE:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def anchored_windows(hashes: np.ndarray, ends: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """All windows of a chunk: their start, document, anchor's hash, anchor's place and extension's fingerprint."""
    begins = np.concatenate([[0], ends[:-1]])
    room = np.maximum(ends - begins - window + 1, 0)
    doc = np.repeat(np.arange(len(ends)), room)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(room) - room, room) + begins[doc]
    if not len(at):
        return at, doc, np.empty(0, np.uint64), at, np.empty(0, np.uint64)
    n = len(hashes)
    seeds = np.zeros(n - seed + 1, np.uint64)
    for t, factor in enumerate(_factors(seed, 0x9E3779B97F4A7C15)):
        seeds += hashes[t : n - seed + 1 + t] * factor
    seeds = _mix(seeds)
    best, place = seeds[: n - window + 1].copy(), np.zeros(n - window + 1, np.int8)
    for t in range(1, window - seed + 1):
        other = seeds[t : n - window + 1 + t]
        better = other < best
        best[better] = other[better]
        place[better] = t
    whole = np.zeros(n - window + 1, np.uint64)
    for t, factor in enumerate(_factors(window, 0xD1B54A32D192ED03)):
        whole += hashes[t : n - window + 1 + t] * factor
    return at, doc, best[at], at + place[at], _mix(whole)[at]


def _groups(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Where groups of equal keys begin in the given order."""
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return np.flatnonzero(new)


def least_of_equal(ids: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For each place the smallest id among places of equal keys."""
    out = np.empty_like(ids)
    if len(ids):
        order = np.lexsort(keys)
        at = _groups(order, *keys)
        out[order] = np.repeat(np.minimum.reduceat(ids[order], at), np.diff(np.append(at, len(order))))
    return out


def _runs(*joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of the runs in which every array keeps its value."""
    first = np.ones(len(joined[0]), bool)
    if len(first) > 1:
        first[1:] = np.logical_or.reduce([a[1:] != a[:-1] for a in joined])
    at = np.flatnonzero(first)
    return at, np.append(at[1:], len(first)) - 1


def _low_bytes(values: np.ndarray, size: int) -> np.ndarray:
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :size]


def _from_low_bytes(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel()


def packed_chunk(hashes: list[np.ndarray], ids: list[int], marks: list[int], parts: int) -> pa.RecordBatch:
    """What a chunk sends: for each partition its anchor occurrences, and spans that the chunk itself settled."""
    flat, ends = np.concatenate(hashes), np.cumsum([len(h) for h in hashes])
    id_of, mark_of, begins = np.array(ids, np.int64), np.array(marks, np.int64), ends - [len(h) for h in hashes]
    at, doc, anchor, place, extension = anchored_windows(flat, ends)
    settled = id_of[doc] > least_of_equal(id_of[doc], extension, anchor)
    columns: dict[str, list] = {c: [] for c in PACKED.names}

    def add(part: int, anchors: bytes, extensions: bytes, counts: bytes, starts: np.ndarray, stops: np.ndarray, docs: np.ndarray) -> None:
        row = (part, anchors, extensions, counts, starts.astype("<i4").tobytes(), stops.astype("<i4").tobytes(),
               id_of[docs].astype("<i8").tobytes(), mark_of[docs].astype("<u4").tobytes())
        for name, value in zip(columns, row, strict=True):
            columns[name].append(value)

    here, there = np.flatnonzero(settled), np.flatnonzero(~settled)
    if len(here):
        first, last = _runs(doc[here], at[here] - np.arange(len(here)))
        first, last = here[first], here[last]
        at_part = (id_of[doc[first]] % parts).astype(np.int64)
        order = np.argsort(at_part, kind="stable")
        for a, b in zip(*_runs(at_part[order]), strict=True):
            own = order[a : b + 1]
            docs = doc[first[own]]
            add(int(at_part[order[a]]), b"", b"", b"", at[first[own]] - begins[docs], at[last[own]] - begins[docs] + WINDOW, docs)
    if len(there):
        first, last = _runs(place[there], at[there] - np.arange(len(there)))
        low = _low_bytes(extension[there], EXTENSION_BYTES)
        at_part = (anchor[there[first]] % np.uint64(parts)).astype(np.int64)
        order = np.argsort(at_part, kind="stable")
        for a, b in zip(*_runs(at_part[order]), strict=True):
            own = order[a : b + 1]
            starts, counts = there[first[own]], last[own] - first[own] + 1
            windows = np.repeat(first[own] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            docs = doc[starts]
            high = anchor[starts] >> np.uint64(64 - 8 * ANCHOR_BYTES)
            add(int(at_part[order[a]]), _low_bytes(high, ANCHOR_BYTES).tobytes(), low[windows].tobytes(), counts.astype(np.uint8).tobytes(),
                at[starts] - begins[docs], np.empty(0), docs)
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in PACKED], schema=PACKED)


def send_anchors(parts: int):
    """Arrow batches of (id, mark, text) to packed anchor occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hashes, ids, marks, total, seen = WordHashes(), [], [], [], 0, set()
        for batch in batches:
            texts = batch["text"].cast(pa.large_binary())
            for i, (key, mark) in enumerate(zip(batch["id"].to_pylist(), batch["mark"].to_pylist(), strict=True)):
                if (key, mark) in seen:
                    continue
                own = words.of(texts[i].as_py().split())
                if len(own) < WINDOW:
                    continue
                if total and total + len(own) > CHUNK_WORDS:
                    yield packed_chunk(hashes, ids, marks, parts)
                    hashes, ids, marks, total, seen = [], [], [], 0, set()
                seen.add((key, mark))
                hashes.append(own)
                ids.append(key)
                marks.append(mark)
                total += len(own)
        if total:
            yield packed_chunk(hashes, ids, marks, parts)

    return run


SPANS = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def _spans(ids, marks, starts, ends) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(v), f.type) for v, f in zip((ids, marks, starts, ends), SPANS, strict=True)], schema=SPANS)


def extend_matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's anchor occurrences meet; extensions that agree with a smaller document's become spans."""
    parts: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        for row in batch.to_pylist():
            ids, marks = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["marks"], "<u4").astype(np.int64)
            starts = np.frombuffer(row["starts"], "<i4")
            if row["ends"]:
                yield _spans(ids, marks, starts, np.frombuffer(row["ends"], "<i4"))
            else:
                counts = np.frombuffer(row["counts"], np.uint8)
                parts.append((ids, marks, starts, counts, _from_low_bytes(row["anchors"], ANCHOR_BYTES), _from_low_bytes(row["extensions"], EXTENSION_BYTES)))
    if not parts:
        return
    ids, marks, starts, counts, anchors, extensions = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    own = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    matched = np.flatnonzero(ids[own] > least_of_equal(ids[own], extensions, anchors[own]))
    if not len(matched):
        return
    offset = np.arange(len(own)) - np.repeat(np.cumsum(counts, dtype=np.int64) - counts, counts)
    first, last = _runs(own[matched], matched - np.arange(len(matched)))
    first, last = matched[first], matched[last]
    where = own[first]
    yield _spans(ids[where], marks[where], starts[where] + offset[first], starts[where] + offset[last] + WINDOW)


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(f"`{text_col}`")
    key: Column = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID))
    return df.select(key.alias("id"), F.crc32(text.cast("binary")).alias("mark"), text.alias("text"), F.col(f"`{id_col}`").alias("own_id"))


def repeated_spans(rows: DataFrame) -> DataFrame:
    """Spans of words (id, mark, start, end) that repeat windows of a smaller document; they may overlap."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(salts(rows.sparkSession), -(-size // PART_BYTES))
    packed = rows.select("id", "mark", "text").mapInArrow(send_anchors(parts), PACKED_DDL)
    return packed.repartitionById(parts, "part").mapInArrow(extend_matches, SPANS_DDL)


def cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes the spans' words out of each text."""
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        texts, spans = batch["text"].cast(pa.large_binary()), batch["spans"]
        for i in range(batch.num_rows):
            words = texts[i].as_py().split()
            n_words.append(len(words))
            if spans[i].is_valid and len(spans[i]):
                own = spans[i].values
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, np.asarray(own.field("start")), 1)
                np.add.at(edge, np.asarray(own.field("end")), -1)
                stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                words = [words[k] for k in stay]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [batch["own_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.large_binary()).cast(pa.large_string()).cast(pa.string())],
            names=["own_id", "n_words", "n_removed", "kept_text"],
        )


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: id, n_words, n_removed and kept_text, the words that no repeated window covers."""
    rows = _keyed(df, id_col, text_col)
    spans = repeated_spans(rows).groupBy("id", "mark").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    met = rows.join(spans, ["id", "mark"], "left").select("own_id", "text", "spans")
    kind = dict(rows.dtypes)["own_id"]
    out = met.mapInArrow(cut_spans, f"own_id {kind}, n_words long, n_removed long, kept_text string")
    return out.withColumnRenamed("own_id", id_col)


def substring_dedup(df: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    return without_repeats(df).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
