"""Sources: tables, words with page geometry, files, jobs, messages, metric points, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions.scalars import box, let
from inkveil.schemas import MANIFEST

WORDS_PER_ROW, ROWS_PER_PAGE, WORD_HEIGHT = 12, 50, 12
WHITE = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_small(df: DataFrame) -> DataFrame:
    """A table that is read in few parts for the cores (few row groups, say: a part without the start of one is empty) is dealt
    over them, whole rows and once; any larger table stays as it is read, so nothing is shuffled."""
    parts = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def split_words(text: Column) -> Column:
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(F.length(inner) == 0, F.array().cast("array<string>")).otherwise(F.split(inner, "[\\x20\\x09-\\x0D]+"))


def word_box(idx: Column) -> Column:
    """The place of a document's word: rows of 12 words, pages of 50 rows, in thousandths of the page."""
    line = F.floor(idx / WORDS_PER_ROW)
    x1, y1 = 80 * (idx % WORDS_PER_ROW), 20 * (line % ROWS_PER_PAGE)
    return box(x1, y1, x1 + 70, y1 + WORD_HEIGHT)


def text_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", page: Column | None = None) -> DataFrame:
    """Words with geometry. `page` numbers pages that are given (one row each) instead of those counted off."""
    keep = [F.col(id_col).alias("doc_id")] + ([page.cast("int").alias("__page")] if page is not None else [])
    rows = df.select(*keep, F.posexplode(split_words(F.col(text_col))).alias("word_idx", "text"))
    counted = F.floor(F.col("word_idx") / (WORDS_PER_ROW * ROWS_PER_PAGE)).cast("int")
    return rows.select(
        "doc_id",
        (F.col("__page") if page is not None else counted).alias("page_index"),
        "word_idx",
        "text",
        word_box(F.col("word_idx")).alias("box"),
        F.lit("pdf").alias("source"),
    )


def _word(text: Column, idx: Column, source: Column | None = None) -> Column:
    source = F.lit("pdf") if source is None else source
    return F.struct(idx.cast("int").alias("word_idx"), text.alias("text"), word_box(idx).alias("box"), source.alias("source"))


def text_pages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", page: Column | None = None) -> DataFrame:
    """Pages (doc_id, page_index, words) in place of words: a document is cut where it lies, and nothing is shuffled. A text
    without words is one page without words. `page` as for `text_words`."""
    key, most = F.col(id_col).alias("doc_id"), WORDS_PER_ROW * ROWS_PER_PAGE
    if page is not None:
        words = F.transform(split_words(F.col(text_col)), lambda t, i: _word(t, i))
        return df.select(key, page.cast("int").alias("page_index"), F.explode(F.array(words)).alias("words"))

    def pages(ws: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(ws) - 1, F.lit(0)), F.lit(most))
        return F.transform(starts, lambda s: F.transform(F.slice(ws, s + 1, F.lit(most)), lambda t, i: _word(t, s + i)))

    return df.select(key, F.posexplode(let(split_words(F.col(text_col)), pages)).alias("page_index", "words"))


def plain_pages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", page: Column | None = None) -> DataFrame:
    """`text_pages` in short: (doc_id, page_index, first, texts, source), the texts of a page's words, the number of the first,
    and the source of all. Their boxes follow from their numbers (`held_word`) and are made only for words that are found."""
    key, most, source = F.col(id_col).alias("doc_id"), WORDS_PER_ROW * ROWS_PER_PAGE, F.lit("pdf").alias("source")
    if page is not None:
        rows = df.select(key, page.cast("int").alias("page_index"), F.explode(F.array(split_words(F.col(text_col)))).alias("texts"))
        return rows.select("doc_id", "page_index", F.lit(0).alias("first"), "texts", source)

    def pages(ws: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(ws) - 1, F.lit(0)), F.lit(most))
        return F.transform(starts, lambda s: F.slice(ws, s + 1, F.lit(most)))

    rows = df.select(key, F.posexplode(let(split_words(F.col(text_col)), pages)).alias("page_index", "texts"))
    return rows.select("doc_id", "page_index", (F.col("page_index") * most).alias("first"), "texts", source)


PLAIN = ("first", "texts", "source")


def held(pages: DataFrame) -> list[str]:
    """The columns in which pages hold their words: those of `plain_pages`, or `words`; none if there are no words."""
    return list(PLAIN) if "texts" in pages.columns else ["words"] if "words" in pages.columns else []


def held_texts(pages: DataFrame) -> Column:
    return F.col("texts") if "texts" in pages.columns else F.transform("words", lambda w: w["text"])


def held_word(pages: DataFrame, i: Column) -> Column:
    """(word_idx, box) of the word at place i of its page."""
    if "first" in pages.columns:
        return F.struct((F.col("first") + i).cast("int").alias("word_idx"), word_box(F.col("first") + i).alias("box"))
    word = F.get("words", i)
    return F.struct(word["word_idx"].alias("word_idx"), word["box"].alias("box"))


def gathered(rows: DataFrame) -> DataFrame:
    """Pages of words (one row each), or pages as they are; a page's words are in order."""
    if "words" in rows.columns:
        return rows
    if "texts" in rows.columns:
        words = F.transform("texts", lambda t, i: _word(t, F.col("first") + i, F.col("source")))
        return rows.withColumn("words", words).drop(*PLAIN)
    item = F.struct("word_idx", "text", "box", "source")
    return rows.groupBy("doc_id", "page_index").agg(F.sort_array(F.collect_list(item)).alias("words"))


def files(spark: SparkSession, path: str, pattern: str = "*.[pP][dD][fF]", content: bool = False) -> DataFrame:
    """Files below `path`, in the order of their lower-cased paths; their bytes only if asked for."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    columns = ["path", "length", "modificationTime", *["content"] * content]
    return found.select(*columns).orderBy(F.lower("path"), "path")


def small_files(found: DataFrame, together: int = 16) -> DataFrame:
    """Files that are small: Spark plans some thirty to a task however small they are, so that starting tasks is most of the work. A task
    takes `together` such parts, but there stay four parts a core; nothing is shuffled."""
    parts, least = found.rdd.getNumPartitions(), 4 * found.sparkSession.sparkContext.defaultParallelism
    return found.coalesce(max(least, parts // together)) if parts > least else found


def file_heads(found: DataFrame, size: int = 16) -> DataFrame:
    """(path, size_bytes, head): the first bytes of files with content."""
    return found.select("path", F.col("length").alias("size_bytes"), F.substring("content", 1, size).alias("head"))


def file_digests(found: DataFrame) -> DataFrame:
    return found.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("content_sha256"))


def manifests(df: DataFrame, json_col: str) -> DataFrame:
    """Typed manifests of JSON text; `valid` is false for text that is none or has another schema version."""
    m = F.from_json(F.col(json_col), MANIFEST)
    return df.withColumn("manifest", m).withColumn("valid", F.coalesce((m["schema_version"] == 1) & (m["page_count"] >= 1), F.lit(False)))


def _message(body_col: str) -> tuple[Column, Column]:
    m = F.from_json(F.col(body_col), "schema_version int, job_id string, task string")
    good = (m["schema_version"] == 1) & m["job_id"].isNotNull() & m["task"].isin("detect", "redact")
    return m, F.coalesce(good, F.lit(False))


def messages(df: DataFrame, body_col: str) -> DataFrame:
    """Queue messages of JSON text; malformed ones are dropped (`malformed` has them)."""
    m, good = _message(body_col)
    return df.select("*", m.alias("m")).where(good).select(*df.columns, "m.job_id", "m.task")


def malformed(df: DataFrame, body_col: str) -> DataFrame:
    """The messages that `messages` drops, for a quarantine table."""
    return df.where(~_message(body_col)[1])


def orders_as_jobs(orders: DataFrame) -> DataFrame:
    """Jobs for want of a job store: an order is a job; its statuses, times and counts follow from its columns."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    states = [
        "awaiting_upload", "queued_detection", "detecting", "review_required", "queued_redaction", "redacting", "complete", "failed", "deleted", "expired",
    ]
    created = F.timestamp_seconds(F.unix_timestamp(day) + (key * 37) % 86400)
    return orders.select(
        key.alias("job_id"),
        F.col("o_custkey").alias("client"),
        F.get(F.array(*map(F.lit, states)), (key % 10).cast("int")).alias("status"),
        created.alias("created_at"),
        F.timestamp_seconds(F.unix_timestamp(created) + 3300).alias("expires_at"),
        F.timestamp_seconds(F.unix_timestamp(created) + (key * 53) % 3600).alias("updated_at"),
        (key % 7 + 1).cast("int").alias("version"),
    )


def events_as_metrics(events: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Metric points for want of a metric store: (ts, name, value), a name for each event by its number."""
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.get(F.array(*map(F.lit, names)), (F.col("event_id") % len(names)).cast("int")).alias("name"),
        F.col("value"),
    )
