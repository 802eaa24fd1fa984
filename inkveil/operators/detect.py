"""Detection: item providers, answers, propagation, the identifier net, merging, and the fail-closed rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.scalars import detection_id, fragments, let, once, ssn_like, ssn_possible, ssn_token, target, touches
from inkveil.operators.anchor import SIMILAR, anchor, anchored_boxes, joined_norms, page_joined, page_words
from inkveil.schemas import CATEGORY_OF_ANSWER, PROPAGATED, TAXPAYER_IDS
from inkveil.sources.scratch import written
from inkveil.sources.tables import gathered, held, held_texts, held_word

#: Fixed patterns of the rule provider, by category.
RULES = {
    "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}",
    "phone": "\\+1 \\([0-9]{3}\\) [0-9]{3}-[0-9]{4}",
    "ip_address": "\\b(?:[0-9]{1,3}\\.){3}[0-9]{1,3}\\b",
    "payment_card": "\\b[0-9]{15,16}\\b",
}


class ItemProvider(Protocol):
    """Pages (doc_id, page_index, text) to items (doc_id, page_index, item_ord, text, category)."""

    def items(self, pages: DataFrame) -> DataFrame: ...


class RuleProvider:
    """Items by pattern; in the order of the rules, then of the text."""

    def __init__(self, rules: dict[str, str] = RULES):
        self.rules = rules

    @property
    def categories(self) -> tuple[str, ...]:
        return tuple(self.rules)

    def items(self, pages: DataFrame) -> DataFrame:
        """Keeps the pages' words (`held`), where there are any."""

        def of(category: str, pattern: str) -> Column:
            found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
            return F.transform(found, lambda m: F.struct(m.alias("text"), F.lit(category).alias("category")))

        found = [of(c, p) for c, p in self.rules.items()]
        keep = held(pages)
        rows = pages.select("doc_id", "page_index", F.posexplode(F.concat(*found)).alias("item_ord", "x"), *keep)
        return rows.select("doc_id", "page_index", "item_ord", "x.text", "x.category", *keep)


class TableProvider:
    """Items that are there already."""

    def __init__(self, table: DataFrame):
        self.table = table

    def items(self, pages: DataFrame) -> DataFrame:
        return self.table.join(pages.select("doc_id", "page_index"), ["doc_id", "page_index"], "left_semi")


class CallProvider:
    """Answers of a function of page texts (say, a client of a model's HTTP endpoint), called in the executors."""

    def __init__(self, ask: Callable[[list[str]], list[str]]):
        self.ask = ask

    def answers(self, pages: DataFrame) -> DataFrame:
        ask = self.ask

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame({"doc_id": f["doc_id"], "page_index": f["page_index"], "raw_json": ask(list(f["text"]))})

        rows = pages.where(F.length("text") > 0).select("doc_id", "page_index", "text")
        return rows.mapInPandas(run, "doc_id long, page_index int, raw_json string").withColumn("finish_reason", F.lit("stop"))

    def items(self, pages: DataFrame) -> DataFrame:
        return answer_items(self.answers(pages))


def answer_errors(answers: DataFrame) -> DataFrame:
    """Answers with `error_code`: cut off, or not an object with a list of items."""
    parsed = F.from_json("raw_json", "items array<struct<text:string,category:string>>")
    error = F.when(F.col("finish_reason") == "length", "model_output_truncated").when(parsed.isNull() | parsed["items"].isNull(), "model_output_invalid")
    return answers.withColumn("error_code", error)


def answer_items(answers: DataFrame) -> DataFrame:
    """The items of valid answers: trimmed, mapped to a category, blank and unknown ones dropped."""
    parsed = F.from_json("raw_json", "items array<struct<text:string,category:string>>")
    rows = answer_errors(answers).where("error_code is null").select("doc_id", "page_index", F.posexplode(parsed["items"]).alias("item_ord", "x"))
    names = F.create_map(*[F.lit(v) for kv in CATEGORY_OF_ANSWER.items() for v in kv])
    rows = rows.select("doc_id", "page_index", "item_ord", F.btrim("x.text").alias("text"), F.try_element_at(names, F.col("x.category")).alias("category"))
    return rows.where("length(text) > 0 and category is not null")


def page_texts(words: DataFrame) -> DataFrame:
    pages = page_words(words)
    return pages.select("doc_id", "page_index", F.array_join(held_texts(pages), " ").alias("text"))


def read_pages(words: DataFrame) -> DataFrame:
    """(doc_id, page_index, text, and the words): pages as providers and anchors want them."""
    pages = page_words(words)
    return pages.select("doc_id", "page_index", F.array_join(held_texts(pages), " ").alias("text"), *held(pages))


def detections(boxes: DataFrame, confidence: float, source: str) -> DataFrame:
    """Boxes of words to detections with an id that follows from what they are."""
    made = boxes.withColumn("confidence", F.lit(confidence)).withColumn("source", F.lit(source))
    ident = detection_id("doc_id", "page_index", "category", "box.x1", "box.y1", "box.x2", "box.y2", F.lit(source))
    return made.select("doc_id", ident.alias("id"), "page_index", "word_idx", "category", "box", "confidence", "source")


def anchor_counts(anchored: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Per page: items, found ones, and whether the page is to be read again by OCR: under half of them found, and all of
    its words from the text layer. `sources`: pages or words with their `source`; without it all words are."""
    out = anchored.groupBy("doc_id", "page_index").agg(F.count("*").alias("items"), F.count_if(F.size("spans") > 0).alias("anchored"))
    out = out.withColumn("read_again", (F.col("items") > 0) & (F.col("anchored") * 2 < F.col("items")))
    if sources is None:
        return out
    pages = page_words(sources)
    pdf = (F.col("source") == "pdf") | (F.size("texts") == 0) if "texts" in pages.columns else F.forall("words", lambda w: w["source"] == "pdf")
    from_text = pages.select("doc_id", "page_index", pdf.alias("__pdf"))
    return out.join(from_text, ["doc_id", "page_index"]).withColumn("read_again", F.col("read_again") & F.col("__pdf")).drop("__pdf")


def value_pieces(value: str) -> list[str]:
    """Pieces of a value, one of which stands whole in any run of words that is SIMILAR to it: such a run differs by an edit
    in each 4.5 letters at most, and there is one piece more than edits."""
    edits = int(len(value) * (200 - 2 * SIMILAR) / SIMILAR + 1e-9)
    at = [k * len(value) // (edits + 1) for k in range(edits + 2)]
    return [value[i:j] for i, j in zip(at, at[1:], strict=False) if j > i]


def possible_pages(values: pa.Table, pages: pa.Table) -> pa.Table:
    """A document's values on the pages that could hold them: one pass of an automaton of all values' pieces over each page."""
    automaton, of_piece = ahocorasick.Automaton(), {}
    for k, parts in enumerate(values["parts"].to_pylist()):
        for part in parts:
            for piece in value_pieces(part):
                of_piece.setdefault(piece, set()).add(k)
    for piece, own in of_piece.items():
        automaton.add_word(piece, own)
    automaton.make_automaton()
    at_page, at_value = [], []
    for row, joined in enumerate(pages["joined"]):
        text = joined_norms(joined.as_py()).replace("\n", "")
        hits = set().union(*(own for _, own in automaton.iter(text))) if of_piece else set()
        at_page += [row] * len(hits)
        at_value += sorted(hits)
    where, what = pa.array(at_page, pa.int64()), pa.array(at_value, pa.int64())
    number = pa.array([0] * len(at_page), pa.int32())
    columns = [pages["doc_id"].take(where), pages["page_index"].take(where), number, values["text"].take(what), values["category"].take(what)]
    return pa.table(columns, names=["doc_id", "page_index", "item_ord", "text", "category"])


def propagated_items(items: DataFrame, pages: DataFrame, categories=PROPAGATED) -> DataFrame:
    """Each different value of the spreading categories, as an item of the pages of its document that could hold it. A
    document's pages, of which there are `MAX_PAGES` at most, meet its values once; a page and a value that share no piece
    make no row."""
    values = items.where(F.col("category").isin(*categories)).select("doc_id", "text", "category").distinct()
    parts = F.filter(F.concat(F.array(target(F.col("text"))), F.transform(fragments(F.col("text")), target)), lambda t: F.length(t) > 1)
    values = values.where(F.length(target(F.col("text"))) > 1).withColumn("parts", parts)
    own = pages.select("doc_id", "page_index", page_joined(pages).alias("joined")).join(values.select("doc_id").distinct(), "doc_id", "left_semi")
    kinds = dict(own.dtypes)
    schema = f"doc_id {kinds['doc_id']}, page_index {kinds['page_index']}, item_ord int, text string, category string"
    told = values.select(F.col("doc_id").alias("of_doc"), "text", "category", "parts")
    return told.groupBy("of_doc").cogroup(own.groupBy("doc_id")).applyInArrow(possible_pages, schema)


def ssn_net(words: DataFrame) -> DataFrame:
    """(doc_id, page_index, word_idx, category, box): words of an SSN's shape, alone or with the next word's help."""
    pages = page_words(words)
    pages = pages.where(ssn_possible(F.array_join(held_texts(pages), " ")))
    bound = once(ts=F.transform(held_texts(pages), ssn_token), **{c: F.col(c) for c in held(pages)})
    rows = pages.select("doc_id", "page_index", bound.alias("t")).select("doc_id", "page_index", "t.ts", *[f"t.{c}" for c in held(pages)])
    dash = lambda t: t.contains("-") | t.contains("–")

    def hits(ts: Column) -> Column:
        def at(i: Column) -> Column:
            t, t2 = F.get(ts, i), F.get(ts, i + 1)
            both = (t.endswith("-") | t2.startswith("-")) & ssn_like(F.concat(t, t2))
            return F.when(ssn_like(t), F.array(i)).when(F.coalesce(both, F.lit(False)), F.array(i, i + 1)).otherwise(F.array().cast("array<int>"))

        likely = F.filter(F.transform(ts, lambda t, i: F.when(dash(t) | F.coalesce(F.get(ts, i + 1).startswith("-"), F.lit(False)), i)), lambda i: i.isNotNull())
        return F.flatten(F.transform(likely, at))

    out = rows.select("doc_id", "page_index", F.explode(F.transform(let(F.col("ts"), hits), lambda i: held_word(pages, i))).alias("x"))
    return out.select("doc_id", "page_index", "x.word_idx", F.lit("ssn").alias("category"), "x.box")


def merged(found: DataFrame) -> DataFrame:
    """Boxes of one page and category, merged greedily in the order (y1, x1, x2, y2, confidence, source, id): each joins
    the first cluster whose union it touches, which keeps its first member's id and source."""
    item = F.struct("box.y1", "box.x1", "box.x2", "box.y2", "confidence", "source", "id")
    groups = found.groupBy("doc_id", "page_index", "category").agg(F.sort_array(F.collect_list(item)).alias("ds"))
    cluster = "struct<x1:int,y1:int,x2:int,y2:int,confidence:double,source:string,id:string,members:int>"

    def step(acc: Column, d: Column) -> Column:
        at = F.get(F.filter(F.transform(acc, lambda c, k: F.when(touches(c, d), k).otherwise(-1)), lambda k: k >= 0), F.lit(0))

        def union(c: Column) -> Column:
            return F.struct(
                F.least(c["x1"], d["x1"]).alias("x1"), F.least(c["y1"], d["y1"]).alias("y1"), F.greatest(c["x2"], d["x2"]).alias("x2"),
                F.greatest(c["y2"], d["y2"]).alias("y2"), F.greatest(c["confidence"], d["confidence"]).alias("confidence"),
                c["source"].alias("source"), c["id"].alias("id"), (c["members"] + 1).alias("members"),
            )

        fresh = F.struct(*[d[k].alias(k) for k in ("x1", "y1", "x2", "y2", "confidence", "source", "id")], F.lit(1).alias("members"))
        return F.when(at.isNull(), F.concat(acc, F.array(fresh))).otherwise(F.transform(acc, lambda c, k: F.when(k == at, union(c)).otherwise(c)))

    folded = F.aggregate("ds", F.array().cast(f"array<{cluster}>"), step)
    rows = groups.select("doc_id", "page_index", "category", F.explode(folded).alias("c"))
    return rows.select("doc_id", "c.id", "page_index", "category", F.struct("c.x1", "c.y1", "c.x2", "c.y2").alias("box"), "c.confidence", "c.source", "c.members")


def second_look(pages: DataFrame, provider: ItemProvider, read_again: Callable[[DataFrame], DataFrame]) -> tuple[list[DataFrame], DataFrame]:
    """(pages in two parts, anchored) after pages that hold under half of their items were read again, by OCR say: `read_again`
    makes new pages (doc_id, page_index, words) of those alone, which alone go to the provider once more; what they had is
    replaced."""
    read = read_pages(pages)
    first = written(anchor(provider.items(read), read))
    flagged = written(anchor_counts(first, pages).where("read_again").select("doc_id", "page_index"))
    key = ["doc_id", "page_index"]
    again = written(read_again(gathered(pages.join(flagged, key, "left_semi"))).select(*key, "words"))
    seen = read_pages(again)
    second = written(anchor(provider.items(seen), seen))
    return [pages.join(flagged, key, "left_anti"), again], first.join(flagged, key, "left_anti").unionByName(second)


def detect(words: DataFrame, provider: ItemProvider, read_again: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The whole chain: items, anchors, propagation over the document, the identifier net, merging. `words` may be pages
    (`text_pages`). A provider that names its `categories`, none of which spreads, saves the propagation. With `read_again`,
    pages whose text layer does not hold what was found are looked at once more (`second_look`)."""
    pages = page_words(words)
    spreads = bool(set(getattr(provider, "categories", PROPAGATED)) & set(PROPAGATED))
    if read_again is not None:
        parts, anchored = second_look(pages, provider, read_again)
    else:
        read = read_pages(pages)
        anchored = anchor(provider.items(read), read)
        parts, anchored = [pages], written(anchored) if spreads else anchored
    found = detections(anchored_boxes(anchored), 0.9, "model")
    if spreads:
        one = parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, [gathered(p).select("doc_id", "page_index", "words") for p in parts])
        read = page_words(one)
        spread = anchor(propagated_items(anchored, read), read)
        found = found.unionByName(detections(anchored_boxes(spread), 0.85, "model"))
    return merged(reduce(DataFrame.unionByName, [detections(ssn_net(p), 0.95, "regex") for p in parts], found))


def fail_closed(anchored: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, unanchored, unanchored_ids, error_code): a document with an unanchored taxpayer identifier on a page
    without any such box is not released."""
    lost = anchored.where(F.size("spans") == 0).select("doc_id", "page_index", "category")
    held = found.where(F.col("category").isin(*TAXPAYER_IDS)).select("doc_id", "page_index").distinct().withColumn("held", F.lit(True))
    rows = lost.join(held, ["doc_id", "page_index"], "left")
    bad = F.col("category").isin(*TAXPAYER_IDS) & F.col("held").isNull()
    out = rows.groupBy("doc_id").agg(F.count("*").alias("unanchored"), F.count_if(bad).alias("unanchored_ids"))
    return out.withColumn("error_code", F.when(F.col("unanchored_ids") > 0, F.lit("detection_unanchored")))
