"""Finding values again in the words of their page: exact runs, then fragments, then the most similar run.

A page is one row with its words. An item meets its page's text once, in Arrow batches: exact runs first, then fragments, then
similarity over the runs that length and letters leave. `exact_spans` says the first as a column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.scalars import fragments, target
from inkveil.sources.tables import gathered, held, held_word

MOST_WORDS = 12
SIMILAR = 90.0


def page_words(words: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, page_index, .., and the words): pages as anchors want them, plain ones (`plain_pages`) as they are."""
    pages = words if "texts" in words.columns else gathered(words)
    return pages.select("doc_id", "page_index", *keep, *held(pages))


def page_joined(pages: DataFrame) -> Column:
    """A page's words as one string, a line each."""
    if "texts" in pages.columns:
        return F.array_join("texts", "\n")
    return F.array_join(F.transform("words", lambda w: F.replace(F.coalesce(w["text"], F.lit("")), F.lit("\n"), F.lit(""))), "\n")


DROPPED = bytes(k for k in range(128) if chr(k) not in "abcdefghijklmnopqrstuvwxyz0123456789*\n\x01")


def joined_norms(joined: str) -> str:
    """`norm` of each line."""
    if joined.isascii():
        return joined.replace("\x01", "").lower().encode().translate(None, DROPPED).decode()
    signs = joined.lower().replace("\x01", "").replace("•", "\x01").encode("ascii", "ignore")
    return signs.translate(None, DROPPED).decode().replace("\x01", "•")


def exact_runs(value: str, norms: list[str]) -> list[tuple[int, int]]:
    """What `exact_spans` says, for a page whose norms are at hand."""
    found = []
    if len(value) < 2:
        return found
    for i in [i for i, n in enumerate(norms) if n[:1] == value[0] and (value.startswith(n) or n.startswith(value))]:
        run = ""
        for k, n in enumerate(norms[i : i + MOST_WORDS]):
            if n == "":
                break
            run += n
            if run == value or (len(value) >= (8 if k else 4) and run.startswith(value)):
                found.append((i, i + k))
                break
    return found


def exact_spans(value: Column, norms: Column) -> Column:
    """Array of (s, e), places in `norms` where the run of words s to e gives `value` (or, if long, starts with it)."""

    def extra(i: Column) -> Column:
        """How many words follow the first in the match at i; -1 for none."""

        def step(acc: Column, n: Column) -> Column:
            run, stop = F.concat(acc["run"], n), acc["stop"] | (n == "")
            equal = (run == value) | ((F.length(value) >= 8) & run.startswith(value))
            hit = ~stop & (acc["k"] < 0) & (acc["c"] > 0) & equal
            return F.struct(run.alias("run"), (acc["c"] + 1).alias("c"), F.when(hit, acc["c"]).otherwise(acc["k"]).alias("k"), stop.alias("stop"))

        start = F.struct(F.lit("").alias("run"), F.lit(0).alias("c"), F.lit(-1).alias("k"), F.lit(False).alias("stop"))
        many = F.aggregate(F.slice(norms, i + 1, F.lit(MOST_WORDS)), start, step, lambda a: a["k"])
        first = F.get(norms, i)
        one = (first == value) | ((F.length(value) >= 4) & first.startswith(value))
        return F.when(one, F.lit(0)).otherwise(many)

    # whatever begins a match is a beginning of the value, or begins with it
    start = lambda n, i: F.when((n != "") & (F.startswith(value, n) | F.startswith(n, value)), i)
    at = F.filter(F.transform(norms, start), lambda i: i.isNotNull())
    found = F.transform(at, lambda i: F.struct(i.alias("s"), (i + extra(i)).alias("e")))
    none = F.array().cast("array<struct<s:int,e:int>>")
    return F.when((F.length(value) < 2) | (F.size(norms) == 0), none).otherwise(F.filter(found, lambda x: x["e"] >= x["s"]))


def similarity(a: str, b: str) -> float:
    """Indel similarity in percent: 200 * longest common subsequence / both lengths, by bit-parallel rows."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for k, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << k
    rows = mask = (1 << len(a)) - 1
    for ch in b:
        kept = rows & where.get(ch, 0)
        rows = ((rows + kept) | (rows - kept)) & mask
    return 200.0 * (len(a) - rows.bit_count()) / (len(a) + len(b))


def likely_runs(value: str, norms: list[str]) -> list[tuple[int, int]]:
    """The runs of words that could be SIMILAR to `value` by their length and their letters, by start and then end.

    A run holds no empty word and at most two words more than a fifth of the value's letters. From running sums of
    lengths and of letter counts: the similarity is at most twice the letters in common over both lengths."""
    sizes = np.fromiter(map(len, norms), np.int64, len(norms))
    width = min(max(1, min(MOST_WORDS, round(len(value) / 5))) + 2, len(norms))
    ends = np.arange(len(norms))[:, None] + np.arange(1, width + 1)
    inside = ends <= len(norms)
    ends = np.minimum(ends, len(norms))
    long, empty = (np.concatenate([[0], np.cumsum(x)]) for x in (sizes, sizes == 0))
    letters = long[ends] - long[:-1, None]
    fits = inside & (empty[ends] == empty[:-1, None]) & (200.0 * np.minimum(letters, len(value)) >= SIMILAR * (letters + len(value)))
    s, n = np.nonzero(fits)
    if not len(s):
        return []
    signs, goal = np.unique(np.frombuffer(value.encode("utf-32-le"), np.uint32), return_counts=True)
    codes = np.frombuffer("".join(norms).encode("utf-32-le"), np.uint32)
    which = np.minimum(np.searchsorted(signs, codes), len(signs) - 1)
    known = signs[which] == codes
    at = np.repeat(np.arange(len(norms)), sizes)[known] * len(signs) + which[known]
    counts = np.bincount(at, minlength=len(norms) * len(signs)).reshape(len(norms), len(signs))
    total = np.concatenate([np.zeros((1, len(signs)), np.int64), np.cumsum(counts, axis=0)])
    shared = np.minimum(total[s + n + 1] - total[s], goal).sum(axis=1)
    good = 200.0 * shared >= SIMILAR * (letters[s, n] + len(value))
    return [(int(a), int(a + b)) for a, b in zip(s[good], n[good], strict=True)]


def best_span(value: str, norms: list[str]) -> tuple[int, int] | None:
    """The most similar run of words, the first of equals, if it is SIMILAR."""
    scored = [(similarity("".join(norms[s : e + 1]), value), -s, -e) for s, e in likely_runs(value, norms)]
    top, s, e = max(scored, default=(0.0, 0, 0))
    return (-s, -e) if scored and top >= SIMILAR else None


ITEM = ("doc_id", "page_index", "item_ord", "text", "category")


def on_pages(items: DataFrame, pages: DataFrame) -> DataFrame:
    """(item.., value, parts, joined, and what the places of words are told from) of items: their targets, whole and in
    fragments, and their page's words. Items that were made from pages carry them and need no join."""
    rows = items if held(items) else items.select(*ITEM).join(pages.select("doc_id", "page_index", *held(pages)), ["doc_id", "page_index"])
    parts = F.transform(fragments(F.col("text")), target)
    return rows.select(*ITEM, target(F.col("text")).alias("value"), parts.alias("parts"), page_joined(rows).alias("joined"), *_places(rows))


def _places(rows: DataFrame) -> list[str]:
    """The columns that `held_word` needs."""
    return ["first"] if "first" in rows.columns else ["words"]


def _look(value: str, parts: list[str], norms: list[str], modes: tuple[str, ...]) -> tuple[str, list[tuple[int, int]]]:
    """(mode, spans) of a value on a page, by the first of the modes that finds something."""
    if len(value) < 2:
        return "none", []
    if found := exact_runs(value, norms):
        return ("exact", found) if "exact" in modes else ("none", [])
    if "fragments" in modes and len(parts) > 1:
        for p in parts:
            own = exact_runs(p, norms)
            if not own and len(p) >= 2 and "similar" in modes:
                own = [x for x in [best_span(p, norms)] if x]
            found += own
        if found:
            return "fragments", found
    if "similar" in modes and (one := best_span(value, norms)):
        return "similar", [one]
    return "none", []


def anchor(items: DataFrame, pages: DataFrame, modes: tuple[str, ...] = ("exact", "fragments", "similar")) -> DataFrame:
    """(item.., mode, spans, found) of all items: mode exact, fragments, similar or none, the first that finds something;
    `found` holds the words (word_idx, box) of each span."""
    rows = on_pages(items, pages)
    kept = [*ITEM, *_places(rows)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        last, norms = "", [""]
        for batch in batches:
            ways, spans = [], []
            for value, parts, joined in zip(*(batch.column(k).to_pylist() for k in ("value", "parts", "joined")), strict=True):
                if joined != last:
                    last, norms = joined, joined_norms(joined).split("\n")
                mode, found = _look(value or "", parts or [], norms, modes)
                ways.append(mode)
                spans.append([{"s": s, "e": e} for s, e in found])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(ways, pa.string()), pa.array(spans, kind)], names=[*kept, "mode", "spans"])

    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in kept), "mode string", "spans array<struct<s:int,e:int>>"]))
    found = F.transform("spans", lambda x: F.transform(F.sequence(x["s"], x["e"]), lambda i: held_word(out, i)))
    return out.select(*ITEM, "mode", "spans", found.alias("found"))


def anchor_exact(items: DataFrame, pages: DataFrame) -> DataFrame:
    """`anchor` of the items that are found exactly."""
    return anchor(items, pages, ("exact",)).where(F.size("spans") > 0)


def anchor_fragments(items: DataFrame, pages: DataFrame) -> DataFrame:
    """`anchor` of items with two or more fragments that are not found whole but in parts, exactly."""
    return anchor(items, pages, ("fragments",)).where(F.size("spans") > 0)


def anchored_boxes(anchored: DataFrame) -> DataFrame:
    """(item.., mode, word_idx, box): one row for each word of each span."""
    return anchored.select(*ITEM, "mode", F.explode(F.flatten("found")).alias("w")).select(*ITEM, "mode", "w.word_idx", "w.box")
