"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is normalised (each run of ASCII white space becomes one space) and cut where its content says so: at
the first of CUTS after `least` characters, at `most` characters where none follows. CUTS are sentence marks before some
letters (with a space, or full-width ones without) and three letters or digits in a row that random text holds every two
thousand characters, so texts without spaces are cut by their content too. Each
chunk is replaced by a 64-bit identifier; the ordered list of identifiers is the text's recipe, and texts are
equal when their recipes are. Long documents are read once where they lie: only recipes travel.

Identifiers are verified: the chunk dictionary groups all chunks by (identifier, SHA-256). An identifier that
stands for two different chunks is ambiguous; documents that hold one get the chunks' SHA-256 beside the
identifiers in their recipes, so a collision cannot join two texts.

Skew: groups are first aggregated per (recipe, salt), and a group's result goes back to its rows by (recipe,
salt), so a group with a third of all rows is spread over as many tasks as there are salts.

Defined results: a null text counts as empty; empty texts are equal to one another (an empty recipe). Among
rows of equal text the one with the smallest id stays (null ids come last); of rows repeated under that id
exactly one stays. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import Scratch, WS, free_names, quoted, salt, spread, text_or_empty

LEAST, MOST = 1024, 8192
CUTS = "(?:[.!?;:,\\u3002\\u061f]\\x20(?=[a-dA-D])|[\\u3001\\u3002\\uff01\\uff0c\\uff1b\\uff1f](?=[\\u4e00-\\u4e7f])|[aeio13][bdfh24][ckCK])"
#: Ids of dropped rows up to this number (some 40 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_IDS = 500_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, WS, " ")


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The chunks of a normalised text, in order; joined, they are the text."""
    pattern = f"(?s).{{{least},{most}}}?{CUTS}|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def recipes(df: DataFrame, id_col: str, text_col: str, least: int = LEAST, most: int = MOST, id_bits: int = 64) -> DataFrame:
    """(id, uid, text_sha256, parts): parts are the structs (h, d, n) of the chunks in order, h the identifier of
    `id_bits` bits, d the chunk's SHA-256 and n its length. `id_bits` under 64 is for tests of collisions."""
    low = F.lit((1 << id_bits) - 1) if id_bits < 64 else F.lit(-1)
    rows = df.select(F.col(id_col).alias("__id"), normalised(text_or_empty(text_col)).alias("__norm"))
    part = F.transform(
        chunks(F.col("__norm"), least, most),
        lambda c: F.struct(F.xxhash64(c).bitwiseAND(low).alias("h"), F.unhex(F.sha2(c, 256)).alias("d")),
    )
    return rows.select(
        "__id", F.monotonically_increasing_id().alias("__uid"), F.sha2("__norm", 256).alias("text_sha256"), part.alias("__parts")
    )


def chunk_dictionary(recipe_rows: DataFrame) -> DataFrame:
    """One row per different chunk: (h, d, uses, variant); variant counts the chunks that share an identifier."""
    found = recipe_rows.select(F.explode("__parts").alias("c")).groupBy("c.h", "c.d").agg(F.count("*").alias("uses"))
    return found


def ambiguous(dictionary: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one chunk."""
    return dictionary.groupBy("h").agg(F.count("*").alias("__n")).where("__n > 1").select("h")


def exact_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, most: int = MOST, id_bits: int = 64
) -> DataFrame:
    """One row per row of `df`: id, keep_id, group_size, kept, text_sha256."""
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = scratch.table(recipes(df, id_col, text_col, least, most, id_bits))
    unsure = scratch.table(ambiguous(chunk_dictionary(rows)))
    plain = F.transform("__parts", lambda c: F.struct(c["h"].alias("h"), F.lit(None).cast("binary").alias("d")))
    if unsure.isEmpty():
        named = rows.select("__id", "__uid", "text_sha256", plain.alias("__recipe"))
    else:
        held = rows.select("__uid", F.explode("__parts.h").alias("h")).join(unsure, "h", "left_semi").select("__uid").distinct()
        marked = rows.join(held.withColumn("__held", F.lit(True)), "__uid", "left")
        named = marked.select(
            "__id", "__uid", "text_sha256", F.when(F.col("__held"), F.col("__parts")).otherwise(plain).alias("__recipe")
        )
    named = named.withColumn("__salt", salt(spark, "__uid"))
    first = F.struct(F.col("__id").isNull().alias("n"), F.col("__id").alias("id"), F.col("__uid").alias("uid"))
    partial = named.groupBy("__recipe", "__salt").agg(F.min(first).alias("f"), F.count("*").alias("c"))
    groups = partial.groupBy("__recipe").agg(F.min("f").alias("__first"), F.sum("c").alias("group_size"))
    out = spread(named, groups, "__recipe", "__salt")
    return out.select(
        F.col("__id").alias(id_col),
        F.col("__first.id").alias("keep_id"),
        "group_size",
        (F.col("__uid") == F.col("__first.uid")).alias("kept"),
        "text_sha256",
    )


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` whose text no row with a smaller id has, with their own columns. A row with a null id
    stays if its text is on no other row; rows repeated under one id come down to one. Texts stay where they are: the
    ids that go are taken out. Only rows whose id is null or on several rows are found by their text as well."""
    scratch = Scratch(df.sparkSession)
    at, again_at, kept, sha, mark = free_names(df, "__at", "__again", "__kept", "__sha", "__mark")
    own = F.col(quoted(id_col))
    told = exact_groups(df.select(quoted(id_col), quoted(text_col)), id_col, text_col)
    groups = scratch.table(told.select(F.col(quoted(id_col)).alias(at), F.col("kept").alias(kept), F.col("text_sha256").alias(sha)))
    again = scratch.table(groups.groupBy(at).count().where(f"count > 1 or {at} is null").select(F.col(at).alias(again_at)))
    gone = scratch.table(groups.where(f"not {kept}").select(at).distinct())
    few = gone.count() <= BROADCAST_IDS
    out = df.join(F.broadcast(gone) if few else gone, own == F.col(at), "left_anti")
    if again.isEmpty():
        return out
    same = own.eqNullSafe(F.col(again_at))
    marked = df.join(again, same, "left_semi").withColumn(mark, F.sha2(normalised(text_or_empty(quoted(text_col))), 256))
    stays = groups.where(kept).join(again, F.col(at).eqNullSafe(F.col(again_at)), "left_semi")
    once = marked.join(stays, own.eqNullSafe(F.col(at)) & (F.col(mark) == F.col(sha)), "left_semi")
    once = once.dropDuplicates([id_col, mark]).select(*map(quoted, df.columns))
    return out.join(again, same, "left_anti").unionByName(once)
