"""Queries over documents: words, gate, grid, anchors, detection, redaction, review. With their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions import scalars as S
from inkveil.operators import anchor as A
from inkveil.operators import detect as D
from inkveil.operators import pages as P
from inkveil.operators import redact as R
from inkveil.sources.scratch import written
from inkveil.sources.tables import gathered, held, held_texts, plain_pages, split_words, spread_small, table, text_pages, text_words

KEY = b"inkveil-test-key"

# ---------------------------------------------------------------- common pieces of the SQL
W = "[^\\x20\\x09-\\x0D]+"
WORDS = rf"""words AS (
    SELECT doc_id, (i // 600)::INT AS page_index, i::INT AS word_idx, ws[i + 1] AS text, (80 * (i % 12))::INT AS x1,
           (20 * ((i // 12) % 50))::INT AS y1, (80 * (i % 12) + 70)::INT AS x2, (20 * ((i // 12) % 50) + 12)::INT AS y2
    FROM (SELECT doc_id, ws, unnest(range(len(ws))) AS i
          FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{W}') AS ws FROM documents)))"""
TEXTS = "texts AS (SELECT doc_id, page_index, string_agg(text, ' ' ORDER BY word_idx) AS t FROM words GROUP BY ALL)"
NORMS = """norms AS (SELECT *, regexp_replace(lower(text), '[^a-z0-9*x•]', '', 'g') AS n FROM words),
    runs AS (SELECT *, list(n) OVER (PARTITION BY doc_id, page_index ORDER BY word_idx ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS f FROM norms)"""


def _rules_sql() -> str:
    lists = [f"list_transform(regexp_extract_all(t, '{p}'), lambda m: {{'text': m, 'category': '{c}'}})" for c, p in D.RULES.items()]
    return (
        f"found AS (SELECT doc_id, page_index, list_concat({lists[0]}, list_concat({lists[1]}, list_concat({lists[2]}, {lists[3]}))) AS xs FROM texts),\n"
        "items AS (SELECT doc_id, page_index, (k - 1)::INT AS item_ord, xs[k].text AS text, xs[k].category AS category\n"
        "          FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS k FROM found))"
    )


ITEMS = _rules_sql()


def _exact_sql(items: str, out: str = "hits") -> str:
    """The spans (s, k): k words after the first."""
    return f"""{out} AS (SELECT * FROM (
        SELECT i.*, r.word_idx AS s, CASE WHEN r.n = v OR (length(v) >= 4 AND starts_with(r.n, v)) THEN 0
               ELSE coalesce(list_min(list_filter(range(1, len(r.f)), lambda k: NOT list_contains(r.f[1:k + 1], '')
                    AND (array_to_string(r.f[1:k + 1], '') = v OR (length(v) >= 8 AND starts_with(array_to_string(r.f[1:k + 1], ''), v))))), -1) END AS k
        FROM (SELECT *, regexp_replace(lower(regexp_replace(text, '\\s', '', 'g')), '[^a-z0-9*x•]', '', 'g') AS v FROM {items}) i
        JOIN runs r ON i.doc_id = r.doc_id AND i.page_index = r.page_index AND length(v) >= 2 AND r.n <> '' AND left(r.n, 1) = left(v, 1)) WHERE k >= 0)"""


def _held(sql: str, *names: str) -> str:
    """The same, with the named tables computed once."""
    for name in names:
        sql = sql.replace(f"{name} AS (", f"{name} AS MATERIALIZED (", 1)
    return sql


BOXES = """boxes AS (SELECT h.doc_id, h.page_index, h.item_ord, h.category, w.word_idx, w.x1, w.y1, w.x2, w.y2
    FROM (SELECT *, unnest(range(s, s + k + 1)) AS pos FROM hits) h JOIN words w ON h.doc_id = w.doc_id AND h.pos = w.word_idx)"""
RULE_BOXES = f"{WORDS}, {TEXTS}, {NORMS}, {ITEMS}, {_exact_sql('items')}, {BOXES}"


def words_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_words(table(spark, sf_dir, "documents"))


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_pages(spread_small(table(spark, sf_dir, "documents").select("doc_id", "text")))


def plain_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_pages(spread_small(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _flat(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, "box.x1", "box.y1", "box.x2", "box.y2")


def q_text_words(spark, sf_dir):
    return _flat(words_of(spark, sf_dir), "doc_id", "page_index", "word_idx", "text")


def q_word_norm(spark, sf_dir):
    return words_of(spark, sf_dir).select("doc_id", "word_idx", S.norm(F.col("text")).alias("norm"))


def q_gate_pages(spark, sf_dir):
    out = P.text_gate(plain_of(spark, sf_dir))
    return out.select("doc_id", "page_index", "chars", "clean_chars", "median_height", F.round("clean_ratio", 6).alias("clean_ratio"), "garbage")


GATE = """gate AS (SELECT doc_id, page_index, sum(length(text))::BIGINT AS chars,
           sum(length(regexp_replace(text, '[^\\x20-\\x7E]', '', 'g')))::BIGINT AS clean_chars, median(y2 - y1) AS median_height FROM words GROUP BY ALL),
    gated AS (SELECT *, CASE WHEN chars = 0 THEN 0.0 ELSE clean_chars / chars END AS ratio FROM gate),
    judged AS (SELECT *, chars < 40 OR ratio < 0.85 OR median_height < 3 AS garbage FROM gated
        UNION ALL SELECT doc_id, 0, 0, 0, NULL, 0.0, true FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '[^\\x20\\x09-\\x0D]'))"""


def q_ocr_word_filter(spark, sf_dir):
    """OCR output with a confidence of (word_idx * 37) mod 100, none for every seventh, and a flat word for every eleventh."""
    w = words_of(spark, sf_dir)
    i = F.col("word_idx")
    conf = F.when(i % 7 == 0, F.lit("n/a")).otherwise(((i * 37) % 100).cast("string"))
    w = w.select("doc_id", "word_idx", "text", conf.alias("conf"), F.lit(70).alias("w"), F.when(i % 11 == 0, 0).otherwise(12).alias("h"))
    return P.keep_ocr_words(w).select("doc_id", "word_idx", "conf_value")


def _annotations(spark, sf_dir):
    kinds = F.array(
        F.array(F.lit("Link")), F.array(F.lit("FreeText"), F.lit("Link")), F.array().cast("array<string>"), F.lit(None).cast("array<string>"),
        F.array(F.lit("Highlight"), F.lit("Widget")),
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.get(kinds, (F.col("doc_id") % 5).cast("int")).alias("annotations"))


def q_annotation_routing(spark, sf_dir):
    return _annotations(spark, sf_dir).select("doc_id", P.paints_text(F.col("annotations")).alias("needs_ocr"))


def q_ocr_routing(spark, sf_dir):
    gate = P.text_gate(plain_of(spark, sf_dir)).select("doc_id", "page_index", "garbage")
    pages = gate.join(q_annotation_routing(spark, sf_dir), "doc_id")
    on = P.route_pages(pages, True).withColumnRenamed("route", "with_ocr")
    return P.route_pages(on, False).select("doc_id", "page_index", "needs_ocr", "garbage", F.col("with_ocr").alias("route"), "error_code")


def _uneven(spark, sf_dir):
    """Words whose rows are not quite level and drift apart."""

    def moved(t, k):
        i = F.col("first") + k
        x, y = 80 * (i % 12), 20 * (F.floor(i / 12) % 50) + (i * 7) % 5 + F.when((F.floor(i / 12) % 4) == 3, 6).otherwise(0)
        return F.struct(i.alias("word_idx"), t.alias("text"), S.box(x, y, x + 70, y + 12).alias("box"), F.col("source").alias("source"))

    return plain_of(spark, sf_dir).select("doc_id", "page_index", F.transform("texts", moved).alias("words"))


def q_grid_rows(spark, sf_dir):
    rows = P.row_sizes(_uneven(spark, sf_dir)).select("doc_id", "page_index", F.posexplode("rows").alias("row", "r"))
    return rows.select("doc_id", "page_index", "row", F.round("r.c", 6).alias("centre"), F.col("r.n").alias("n_words"))


def q_page_grid(spark, sf_dir):
    return P.page_grid(_uneven(spark, sf_dir))


UNEVEN = """uneven AS (SELECT doc_id, page_index, word_idx, text, x1, y1 + ((word_idx * 7) % 5) + CASE WHEN (word_idx // 12) % 4 = 3 THEN 6 ELSE 0 END AS y1,
           y2 + ((word_idx * 7) % 5) + CASE WHEN (word_idx // 12) % 4 = 3 THEN 6 ELSE 0 END AS y2 FROM words),
    tol AS (SELECT doc_id, page_index, greatest(4.0::DOUBLE, 0.6::DOUBLE * list_sort(list(y2 - y1))[(count(*) // 2) + 1]) AS tolerance FROM uneven GROUP BY ALL),
    seq AS (SELECT *, (y1 + y2) / 2.0::DOUBLE AS cy, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY (y1 + y2) / 2.0::DOUBLE, x1, word_idx) AS rn
            FROM uneven JOIN tol USING (doc_id, page_index)),
    fold AS (
        SELECT doc_id, page_index, rn, 0 AS line, cy AS c, 1 AS m FROM seq WHERE rn = 1
        UNION ALL
        SELECT s.doc_id, s.page_index, s.rn, CASE WHEN abs(s.cy - f.c) <= s.tolerance THEN f.line ELSE f.line + 1 END,
               CASE WHEN abs(s.cy - f.c) <= s.tolerance THEN f.c * f.m / (f.m + 1) + s.cy / (f.m + 1) ELSE s.cy END,
               CASE WHEN abs(s.cy - f.c) <= s.tolerance THEN f.m + 1 ELSE 1 END
        FROM fold f JOIN seq s ON s.doc_id = f.doc_id AND s.page_index = f.page_index AND s.rn = f.rn + 1)"""


def _raw_boxes(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        (c("l_partkey") % 600 + F.lit(0.5) * (c("l_linenumber") % 2)).alias("x1"), (c("l_suppkey") % 780).cast("double").alias("y1"),
        (c("l_partkey") % 600 + c("l_quantity")).alias("x2"), (c("l_suppkey") % 780 + c("l_linenumber") * 3.0).alias("y2"),
    )


def _normal_boxes(spark, sf_dir):
    c = F.col
    return _raw_boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", S.normalized_box(c("x1"), c("y1"), c("x2"), c("y2"), F.lit(612.0), F.lit(792.0)).alias("box"))


NORMAL = """raw AS (SELECT l_orderkey, l_linenumber, l_partkey % 600 + 0.5::DOUBLE * (l_linenumber % 2) AS x1, (l_suppkey % 780)::DOUBLE AS y1,
           l_partkey % 600 + l_quantity AS x2, l_suppkey % 780 + l_linenumber * 3.0::DOUBLE AS y2 FROM lineitem),
    rounded AS (SELECT l_orderkey, l_linenumber, round_even(1000 * x1 / 612.0::DOUBLE, 0)::INT AS a, round_even(1000 * y1 / 792.0::DOUBLE, 0)::INT AS b,
           round_even(1000 * x2 / 612.0::DOUBLE, 0)::INT AS c, round_even(1000 * y2 / 792.0::DOUBLE, 0)::INT AS d FROM raw),
    lefts AS (SELECT *, greatest(0, least(999, a)) AS x1, greatest(0, least(999, b)) AS y1 FROM rounded),
    normal AS (SELECT l_orderkey, l_linenumber, x1, y1, greatest(x1 + 1, least(1000, c)) AS x2, greatest(y1 + 1, least(1000, d)) AS y2 FROM lefts)"""


def q_box_normalize(spark, sf_dir):
    return _flat(_normal_boxes(spark, sf_dir), "l_orderkey", "l_linenumber")


def q_box_rotate(spark, sf_dir):
    turn = (F.col("l_orderkey") % 4 * 90).cast("int")
    rows = _normal_boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", turn.alias("rotation"), S.rotated_box(F.col("box"), turn).alias("box"))
    return _flat(rows, "l_orderkey", "l_linenumber", "rotation")


def q_box_pixels(spark, sf_dir):
    rows = _normal_boxes(spark, sf_dir)
    return _flat(rows.select("l_orderkey", "l_linenumber", S.pixel_box(F.col("box"), F.lit(1275), F.lit(1650)).alias("box")), "l_orderkey", "l_linenumber")


def q_box_valid(spark, sf_dir):
    c = F.col
    raw = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        S.box(c("l_partkey") % 1100 - 20, c("l_suppkey") * 7 % 1100, c("l_partkey") % 1100 - 20 + c("l_linenumber") - 2, c("l_suppkey") * 7 % 1100 + c("l_quantity")).alias("box"),
    )
    return raw.select("l_orderkey", "l_linenumber", S.valid_box(c("box")).alias("valid"), S.degenerate_box(c("box")).alias("degenerate"))


def _answers(spark, sf_dir):
    """Detector answers: one item from each document's first word, in the several ways in which answers can be bad."""
    first = F.get(F.split("text", "[\\x20\\x09-\\x0D]+"), 0)
    clean = F.regexp_replace(first, "[^A-Za-z0-9 ]", "")
    kinds = ("client_name", "client_tin", "address_line", "private_id", "email", "phone", "dob", "unheard_of")
    kind = F.get(F.array(*map(F.lit, kinds)), (F.col("doc_id") % 8).cast("int"))
    good = F.concat(F.lit('{"items":[{"text":" '), clean, F.lit(' ","category":"'), kind, F.lit('"},{"text":"  ","category":"email"}]}'))
    way = F.col("doc_id") % 11
    raw = F.when(way == 3, "no json").when(way == 5, '{"other":1}').otherwise(good)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.lit(0).alias("page_index"), raw.alias("raw_json"), F.when(way == 7, "length").otherwise("stop").alias("finish_reason")
    )


def q_category_map(spark, sf_dir):
    return D.answer_items(_answers(spark, sf_dir)).select("doc_id", "item_ord", "text", "category")


def q_answer_errors(spark, sf_dir):
    return D.answer_errors(_answers(spark, sf_dir)).select("doc_id", "error_code")


def rule_items(spark, sf_dir):
    return D.RuleProvider().items(D.page_texts(plain_of(spark, sf_dir)))


def q_rule_items(spark, sf_dir):
    return rule_items(spark, sf_dir)


def _first_words(pages: DataFrame, order: int, least: int, value, category: str) -> DataFrame:
    """An item for each page of `least` words and more: `value` of the texts of its words."""
    rows = A.page_words(pages)
    rows = rows.where(F.size(held_texts(rows)) >= least)
    return rows.select("doc_id", "page_index", F.lit(order).alias("item_ord"), value(held_texts(rows)).alias("text"), F.lit(category).alias("category"), *held(rows))


def _title(ws):
    return F.array_join(F.slice(ws, 1, 3), " ")


def _titles(words: DataFrame) -> DataFrame:
    """An item for each page: its first three words."""
    return _first_words(words, 0, 1, _title, "person_name")


TITLES = """titles AS (SELECT doc_id, page_index, 0 AS item_ord, array_to_string(string_split(t, ' ')[1:3], ' ') AS text, 'person_name' AS category FROM texts)"""


def _spans(rows: DataFrame) -> DataFrame:
    out = rows.select("doc_id", "page_index", "item_ord", F.explode("found").alias("x"))
    return out.select("doc_id", "page_index", "item_ord", F.get("x", F.lit(0))["word_idx"].alias("first_word"), F.size("x").alias("n_words"))


def q_anchor_exact(spark, sf_dir):
    words = plain_of(spark, sf_dir)
    return _spans(A.anchor_exact(_titles(words), A.page_words(words)))


def _parted(ws):
    return F.concat(F.array_join(F.slice(ws, 1, 2), " "), F.lit(",  "), F.array_join(F.slice(ws, 21, 2), " "))


def _scattered(words: DataFrame) -> DataFrame:
    """An item for each page of two runs of words that do not follow one another, parted by a comma and a wide gap."""
    return _first_words(words, 0, 22, _parted, "street_address")


def q_anchor_fragments(spark, sf_dir):
    words = plain_of(spark, sf_dir)
    return _spans(A.anchor_fragments(_scattered(words), A.page_words(words)))


def _wrong_letter(ws):
    return F.overlay(F.array_join(F.slice(ws, 1, 4), " "), F.lit("q"), F.lit(3))


def _misspelt(words: DataFrame) -> DataFrame:
    """An item for each page: its first four words, one letter of which is another."""
    return _first_words(words, 1, 4, _wrong_letter, "person_name")


def q_anchor_fuzzy(spark, sf_dir):
    words = plain_of(spark, sf_dir)
    return _spans(A.anchor(_misspelt(words), A.page_words(words)).where("mode = 'similar'"))


def q_anchor_cascade(spark, sf_dir):
    """Titles, misspelt and scattered items, all made in one pass over the pages."""
    pages = A.page_words(plain_of(spark, sf_dir))
    n, none = F.size("texts"), F.lit(None)
    ways = ((0, 1, _title, "person_name"), (1, 4, _wrong_letter, "person_name"), (2, 22, _parted, "street_address"))
    made = [F.when(n >= least, F.struct(F.lit(o).alias("item_ord"), value(F.col("texts")).alias("text"), F.lit(c).alias("category"))).otherwise(none) for o, least, value, c in ways]
    items = pages.select("doc_id", "page_index", *held(pages), F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("x"))
    items = items.select("doc_id", "page_index", "x.item_ord", "x.text", "x.category", *held(pages))
    return A.anchor(items, pages).select("doc_id", "page_index", "item_ord", "mode", F.size("spans").alias("n_spans"))


def q_reocr_pages(spark, sf_dir):
    """Every third document's words come from OCR already."""
    pages = plain_of(spark, sf_dir).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "ocr").otherwise(F.col("source")))
    items = D.RuleProvider().items(D.read_pages(pages))
    odd = items.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.lit("Zzyzx Qqwert")).otherwise(F.col("text")))
    return D.anchor_counts(A.anchor(odd, D.read_pages(pages)), pages)


def _turns(spark, sf_dir):
    return plain_pages(spread_small(table(spark, sf_dir, "conversations")), "conv_id", "text", page=F.col("turn")).where("size(texts) > 0")


def q_propagate(spark, sf_dir):
    words = _turns(spark, sf_dir)
    pages = A.page_words(words)
    spread = D.propagated_items(_titles(words), pages)
    out = A.anchored_boxes(A.anchor_exact(spread, pages))
    return out.groupBy(F.col("doc_id").alias("conv_id"), F.col("page_index").alias("turn")).agg(F.count("*").alias("boxes"), F.countDistinct("word_idx").alias("n_words"))


def q_detect_spreading(spark, sf_dir):
    """The whole chain over conversations, a page a turn, by a provider of names (each turn's first words), which spread
    over the conversation."""

    class Titles:
        categories = ("person_name",)

        def items(self, pages):
            first = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
            rows = pages.where("size(texts) > 0")
            return rows.select("doc_id", "page_index", F.lit(0).alias("item_ord"), first.alias("text"), F.lit("person_name").alias("category"))

    found = D.detect(_turns(spark, sf_dir), Titles())
    return found.groupBy(F.col("doc_id").alias("conv_id"), "category", "confidence").agg(F.count("*").alias("findings"), F.countDistinct("page_index").alias("turns"))


def q_second_detection(spark, sf_dir):
    """Every third document's text layer says something else than its pages show, where the provider finds its items all the same.
    Such pages are read again; what is found then are the boxes of all documents."""
    true = plain_of(spark, sf_dir)
    rules = D.RuleProvider()
    items = written(rules.items(D.read_pages(true)).select(*A.ITEM))

    class Seen(D.TableProvider):
        categories = rules.categories

    wrong = F.when(F.col("doc_id") % 3 == 0, F.array_repeat(F.lit("zz"), F.size("texts"))).otherwise(F.col("texts"))

    def by_ocr(pages):
        return gathered(true.withColumn("source", F.lit("ocr")).join(pages.select("doc_id", "page_index"), ["doc_id", "page_index"], "left_semi"))

    found = D.detect(true.withColumn("texts", wrong), Seen(items), by_ocr)
    return found.groupBy("doc_id", "category").agg(F.count("*").alias("findings"), F.countDistinct("page_index").alias("pages"))


def _customers(spark, sf_dir):
    return spread_small(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"))


def customer_words(spark, sf_dir):
    """Words with identifiers in all shapes, made of customers' keys."""
    k = F.col("c_custkey")
    a, b, c = (F.lpad((k % m).cast("string"), n, "0") for m, n in ((1000, 3), (100, 2), (10000, 4)))
    dash = F.lit("-")
    shapes = [
        F.array(F.concat(a, dash, b, dash, c)), F.array(F.concat(F.lit("XXX-XX-"), c)), F.array(F.concat(F.lit("***-**-"), c)),
        F.array(F.concat(a, dash, b, dash), c), F.array(F.concat(b, dash, F.lpad((k % 10000000).cast("string"), 7, "0"))),
        F.array(F.concat(F.lit("("), a, dash, b, dash, c, F.lit("),"))),
    ]
    shape = F.get(F.array(*shapes), (k % 6).cast("int"))
    line = F.concat(F.array(F.col("c_name")), shape, F.array(F.col("c_mktsegment")))
    return plain_pages(_customers(spark, sf_dir).select("c_custkey", F.array_join(line, " ").alias("line")), "c_custkey", "line")


CUSTOMER = """shaped AS (SELECT c_custkey AS doc_id, c_name, c_mktsegment, lpad((c_custkey % 1000)::VARCHAR, 3, '0') AS a, lpad((c_custkey % 100)::VARCHAR, 2, '0') AS b,
           lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS c, lpad((c_custkey % 10000000)::VARCHAR, 7, '0') AS e, c_custkey % 6 AS way FROM customer),
    listed AS (SELECT doc_id, list_concat([c_name], list_concat(CASE way WHEN 0 THEN [a || '-' || b || '-' || c] WHEN 1 THEN ['XXX-XX-' || c]
           WHEN 2 THEN ['***-**-' || c] WHEN 3 THEN [a || '-' || b || '-', c] WHEN 4 THEN [b || '-' || e] ELSE ['(' || a || '-' || b || '-' || c || '),'] END,
           [c_mktsegment])) AS ws FROM shaped),
    cwords AS (SELECT doc_id, (i - 1)::INT AS word_idx, ws[i] AS text FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM listed)),
    toks AS (SELECT *, trim(text, '.,;:()') AS t, lead(trim(text, '.,;:()')) OVER (PARTITION BY doc_id ORDER BY word_idx) AS t2 FROM cwords),
    marked AS (SELECT *, regexp_matches(t, '^[\\dxX*•]{3}[-–][\\dxX*•]{2}[-–][\\dxX*•]{4}$') AND regexp_matches(t, '\\d') AS one,
           (t LIKE '%-' OR t2 LIKE '-%') AND regexp_matches(t || t2, '^[\\dxX*•]{3}[-–][\\dxX*•]{2}[-–][\\dxX*•]{4}$') AS two FROM toks),
    net AS (SELECT doc_id, word_idx FROM marked WHERE one UNION ALL SELECT doc_id, word_idx FROM marked WHERE NOT one AND two
            UNION ALL SELECT doc_id, word_idx + 1 FROM marked WHERE NOT one AND two)"""


def q_ssn_net(spark, sf_dir):
    return _flat(D.ssn_net(customer_words(spark, sf_dir)), "doc_id", "page_index", "word_idx", "category")


def _loose_boxes(spark, sf_dir):
    c = F.col
    x, y = c("l_partkey") % 300, c("l_suppkey") * 13 % 200
    rows = table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("doc_id"), (c("l_linenumber") % 2).cast("int").alias("page_index"), c("l_returnflag").alias("category"),
        S.box(x, y, x + 40 + c("l_quantity"), y + 60).alias("box"), (c("l_linenumber") / 10).alias("confidence"), F.lit("model").alias("source"),
    )
    return rows.withColumn("id", F.lit(""))


def q_merge_boxes(spark, sf_dir):
    return _flat(D.merged(_loose_boxes(spark, sf_dir)), "doc_id", "page_index", "category", "confidence", "members")


def q_detect_document(spark, sf_dir):
    """What would be redacted in each document: merged findings per document, category and source."""
    found = D.detect(plain_of(spark, sf_dir), D.RuleProvider())
    return found.groupBy("doc_id", "category", "source").agg(F.count("*").alias("findings"), F.countDistinct("page_index").alias("pages"), F.max("confidence").alias("confidence"))


def rule_detections(spark, sf_dir):
    pages = D.read_pages(plain_of(spark, sf_dir))
    return D.detections(A.anchored_boxes(A.anchor_exact(D.RuleProvider().items(pages), pages)), 0.9, "model").dropDuplicates(["id"])


DETECTED = RULE_BOXES + ", det AS (SELECT DISTINCT doc_id, page_index, word_idx, category, x1, y1, x2, y2 FROM boxes)"


def q_fail_closed_tin(spark, sf_dir):
    """Customers' identifiers as items, some of which are not on the page."""
    words = customer_words(spark, sf_dir)
    k = F.col("c_custkey")
    value = F.when(k % 5 == 0, F.concat(F.lit("999-99-"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("7777"))).otherwise(F.col("c_name"))
    items = _customers(spark, sf_dir).select(
        k.alias("doc_id"), F.lit(0).alias("page_index"), F.lit(0).alias("item_ord"), value.alias("text"),
        F.when(k % 5 == 0, "ssn").otherwise("person_name").alias("category"),
    )
    return D.fail_closed(A.anchor(items, A.page_words(words)), D.ssn_net(words))


def _word_lists(spark, sf_dir):
    """Documents with words, as lists."""
    docs = spread_small(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", split_words(F.col("text")).alias("words")).where("size(words) > 0")


def q_redact_text(spark, sf_dir):
    out = R.masked_text(_word_lists(spark, sf_dir), rule_detections(spark, sf_dir))
    return out.select("doc_id", "masked_words", F.sha2("redacted_text", 256).alias("text_sha256"))


def q_residual_check(spark, sf_dir):
    return R.residual(R.masked_text(_word_lists(spark, sf_dir), rule_detections(spark, sf_dir)), D.RULES, "redacted_text")


def _page_counts(spark, sf_dir):
    return _word_lists(spark, sf_dir).select("doc_id", F.ceil(F.size("words") / 600).cast("int").alias("page_count"))


def q_manifest_json(spark, sf_dir):
    """Manifests written as JSON and read back; every fourth has been approved without its first box."""
    from inkveil.sources.tables import manifests

    draft = R.manifest_of(rule_detections(spark, sf_dir), _page_counts(spark, sf_dir))
    parsed = manifests(draft, "manifest_json")
    kept = parsed.select("job_id", F.to_json(parsed["manifest"].withField("detections", F.slice("manifest.detections", F.lit(2), F.size("manifest.detections")))).alias("manifest_json"))
    approved = kept.where(F.col("job_id").cast("long") % 4 == 0)
    chosen = manifests(R.approved_or_draft(draft, approved, "job_id", "manifest_json"), "manifest_json")
    return chosen.select(
        "job_id", "approved", "valid", F.col("manifest.page_count").alias("page_count"), F.size("manifest.detections").alias("n_detections"),
        R.manifest_errors(F.col("manifest")).alias("error_code"),
    )


def q_review_summary(spark, sf_dir):
    return R.summaries(rule_detections(spark, sf_dir).withColumn("ord", F.col("word_idx")))


def q_page_box_counts(spark, sf_dir):
    return R.page_box_counts(rule_detections(spark, sf_dir), _page_counts(spark, sf_dir))


def q_review_edits(spark, sf_dir):
    """The reviewer removes boxes of phones and adds one box to each page's top."""
    found = rule_detections(spark, sf_dir)
    top = S.box(F.lit(10), F.lit(10), F.lit(200), F.lit(40))
    pages = plain_of(spark, sf_dir).where("size(texts) > 0").select("doc_id", "page_index")
    added = pages.select("doc_id", S.detection_id("doc_id", "page_index", F.lit("user")).alias("id"), "page_index", F.lit("user_added").alias("category"), top.alias("box"), F.lit(1.0).alias("confidence"), F.lit("user").alias("source"))
    out = R.edited(found, found.where("category = 'phone'"), added)
    return out.groupBy("doc_id", "category", "source").agg(F.count("*").alias("boxes"))


def _dims(spark, sf_dir):
    k = F.col("l_partkey")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_index"), (k % 7000).cast("int").alias("width_px"), (F.col("l_suppkey") * 97 % 6000).cast("int").alias("height_px"))
    return rows.groupBy("doc_id", "page_index").agg(F.max("width_px").alias("width_px"), F.max("height_px").alias("height_px"))


def q_pixel_budget(spark, sf_dir):
    return P.pixel_budget(_dims(spark, sf_dir)).select("doc_id", "page_index", "pixels", "running", "error_code")


def q_keyed_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", S.keyed_hash(F.col("c_name"), KEY).alias("hash"))


def q_client_fingerprint(spark, sf_dir):
    k = F.col("c_custkey")
    ip = F.concat_ws(".", F.lit("10"), (k % 256).cast("string"), F.floor(k / 256).cast("string"), F.lit("7"))
    return table(spark, sf_dir, "customer").select("c_custkey", S.client_fingerprint(ip, KEY).alias("fingerprint"))


def q_content_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", S.content_fingerprint(F.concat(F.col("c_name"), F.lit("  \n"), F.col("c_mktsegment"), F.lit(" ")), KEY).alias("fingerprint"))


def _hmac_sql(message: str) -> str:
    block = KEY.ljust(64, b"\0")
    inner, outer = (bytes(x ^ pad for x in block).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


QUERIES = {n[2:]: f for n, f in globals().items() if n.startswith("q_")}

ORACLE_SQL = {
    "text_words": f"WITH {WORDS} SELECT * FROM words",
    "word_norm": f"WITH {WORDS} SELECT doc_id, word_idx, regexp_replace(lower(text), '[^a-z0-9*x•]', '', 'g') AS norm FROM words",
    "gate_pages": f"WITH {WORDS}, {GATE} SELECT doc_id, page_index, chars, clean_chars, median_height, round(ratio, 6) AS clean_ratio, garbage FROM judged",
    "ocr_word_filter": f"""WITH {WORDS} SELECT doc_id, word_idx, ((word_idx * 37) % 100)::DOUBLE AS conf_value FROM words
        WHERE word_idx % 7 <> 0 AND (word_idx * 37) % 100 >= 20 AND word_idx % 11 <> 0""",
    "annotation_routing": "SELECT doc_id, doc_id % 5 IN (1, 3, 4) AS needs_ocr FROM documents",
    "ocr_routing": f"""WITH {WORDS}, {GATE} SELECT doc_id, page_index, doc_id % 5 IN (1, 3, 4) AS needs_ocr, garbage,
        CASE WHEN doc_id % 5 IN (1, 3, 4) OR garbage THEN 'ocr' ELSE 'text' END AS route,
        CASE WHEN doc_id % 5 IN (1, 3, 4) THEN 'ocr_unavailable' END AS error_code FROM judged""",
    "grid_rows": f"""WITH RECURSIVE {WORDS}, {UNEVEN},
        last AS (SELECT doc_id, page_index, line, max_by(c, rn) AS c, count(*) AS m FROM fold GROUP BY ALL)
        SELECT doc_id, page_index, line::INT AS row, round(c, 6) AS centre, m::INT AS n_words FROM last""",
    "page_grid": f"""WITH RECURSIVE {WORDS}, {UNEVEN},
        lines AS (SELECT f.doc_id, f.page_index, f.line, max_by(f.c, f.rn) AS c, list({{'s': s.text, 'c': round_even(s.x1 / 1000.0::DOUBLE * 120, 0)::INT}} ORDER BY s.x1, s.word_idx) AS ws
                  FROM fold f JOIN seq s USING (doc_id, page_index, rn) GROUP BY ALL),
        drawn AS (SELECT doc_id, page_index, line, c, lag(c) OVER (PARTITION BY doc_id, page_index ORDER BY line) AS before,
                  list_reduce(list_prepend({{'s': '', 'c': 0}}, ws), lambda a, b: {{'s': rpad(a.s, greatest(length(a.s) + (length(a.s) > 0)::INT, b.c)::INT, ' ') || b.s, 'c': 0}}).s AS l FROM lines)
        SELECT doc_id, page_index, string_agg(CASE WHEN c - before > 3.5 * tolerance THEN chr(10) ELSE '' END || l, chr(10) ORDER BY line) AS grid FROM drawn JOIN tol USING (doc_id, page_index) GROUP BY ALL
        UNION ALL SELECT doc_id, 0, '' FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '[^\\x20\\x09-\\x0D]')""",
    "reocr_pages": f"""WITH {WORDS}, {TEXTS}, {NORMS}, {ITEMS}, {_exact_sql('items')}, f AS (SELECT DISTINCT doc_id, page_index, item_ord FROM hits WHERE doc_id % 2 = 1)
        SELECT i.doc_id, i.page_index, count(*) AS items, count(f.item_ord) AS anchored, count(f.item_ord) * 2 < count(*) AND min(i.doc_id) % 3 <> 0 AS read_again
        FROM items i LEFT JOIN f USING (doc_id, page_index, item_ord) GROUP BY ALL""",
    "box_normalize": f"WITH {NORMAL} SELECT * FROM normal",
    "box_rotate": f"""WITH {NORMAL}, r AS (SELECT *, (l_orderkey % 4 * 90)::INT AS rotation FROM normal)
        SELECT l_orderkey, l_linenumber, rotation,
            CASE rotation WHEN 90 THEN 1000 - y2 WHEN 180 THEN 1000 - x2 WHEN 270 THEN y1 ELSE x1 END AS x1,
            CASE rotation WHEN 90 THEN x1 WHEN 180 THEN 1000 - y2 WHEN 270 THEN 1000 - x2 ELSE y1 END AS y1,
            CASE rotation WHEN 90 THEN 1000 - y1 WHEN 180 THEN 1000 - x1 WHEN 270 THEN y2 ELSE x2 END AS x2,
            CASE rotation WHEN 90 THEN x2 WHEN 180 THEN 1000 - y1 WHEN 270 THEN 1000 - x1 ELSE y2 END AS y2 FROM r""",
    "box_pixels": f"""WITH {NORMAL} SELECT l_orderkey, l_linenumber, greatest(0, round_even(x1 * 1275 / 1000.0::DOUBLE, 0)::INT - 3) AS x1,
        greatest(0, round_even(y1 * 1650 / 1000.0::DOUBLE, 0)::INT - 3) AS y1, least(1275, round_even(x2 * 1275 / 1000.0::DOUBLE, 0)::INT + 3) AS x2,
        least(1650, round_even(y2 * 1650 / 1000.0::DOUBLE, 0)::INT + 3) AS y2 FROM normal""",
    "box_valid": """WITH b AS (SELECT l_orderkey, l_linenumber, (l_partkey % 1100 - 20)::INT AS x1, (l_suppkey * 7 % 1100)::INT AS y1,
        (l_partkey % 1100 - 20 + l_linenumber - 2)::INT AS x2, (l_suppkey * 7 % 1100 + l_quantity)::INT AS y2 FROM lineitem)
        SELECT l_orderkey, l_linenumber, x1 BETWEEN 0 AND 999 AND y1 BETWEEN 0 AND 999 AND x2 BETWEEN 1 AND 1000 AND y2 BETWEEN 1 AND 1000 AND x2 > x1 AND y2 > y1 AS valid,
        x2 - x1 < 2 OR y2 - y1 < 2 AS degenerate FROM b""",
    "category_map": """WITH a AS (SELECT doc_id, regexp_replace(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+')[1], '[^A-Za-z0-9 ]', '', 'g') AS text,
        ['person_name', 'ssn', 'street_address', 'other_private_id', 'email', 'phone', 'date_of_birth', NULL][doc_id % 8 + 1] AS category FROM documents)
        SELECT doc_id, 0 AS item_ord, text, category FROM a WHERE doc_id % 11 NOT IN (3, 5, 7) AND category IS NOT NULL AND text <> ''""",
    "answer_errors": """SELECT doc_id, CASE doc_id % 11 WHEN 7 THEN 'model_output_truncated' WHEN 3 THEN 'model_output_invalid' WHEN 5 THEN 'model_output_invalid' END AS error_code FROM documents""",
    "rule_items": f"WITH {WORDS}, {TEXTS}, {ITEMS} SELECT doc_id, page_index, item_ord, text, category FROM items",
    "anchor_exact": f"WITH {WORDS}, {TEXTS}, {NORMS}, {TITLES}, {_exact_sql('titles')} SELECT doc_id, page_index, item_ord, s AS first_word, (k + 1)::INT AS n_words FROM hits",
    "anchor_fragments": _held(f"""WITH {WORDS}, {TEXTS}, {NORMS}, ws AS (SELECT doc_id, page_index, string_split(t, ' ') AS l FROM texts),
        whole AS (SELECT doc_id, page_index, 0 AS item_ord, 'street_address' AS category,
                  array_to_string(l[1:2], ' ') || ',  ' || array_to_string(l[21:22], ' ') AS text FROM ws WHERE len(l) >= 22),
        {_exact_sql("whole", "direct")},
        parts AS (SELECT doc_id, page_index, item_ord, category, list_filter(list_transform(regexp_split_to_array(text, '\\s{{2,}}|,|\\n'), lambda x: trim(x)), lambda x: length(x) >= 5) AS ps
                  FROM whole ANTI JOIN direct USING (doc_id, page_index)),
        frags AS (SELECT doc_id, page_index, item_ord, category, unnest(ps) AS text FROM parts WHERE len(ps) > 1), {_exact_sql("frags")}
        SELECT doc_id, page_index, item_ord, s AS first_word, (k + 1)::INT AS n_words FROM hits""", "words", "norms", "runs", "direct", "frags"),
    "propagate": f"""WITH words AS (SELECT doc_id, page_index, i::INT AS word_idx, ws[i + 1] AS text FROM (SELECT conv_id AS doc_id, turn::INT AS page_index, ws, unnest(range(len(ws))) AS i
            FROM (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '{W}') AS ws FROM conversations))),
        {TEXTS}, {NORMS}, {TITLES}, vals AS (SELECT DISTINCT doc_id, text FROM titles), pages AS (SELECT DISTINCT doc_id, page_index FROM words),
        spread AS (SELECT doc_id, page_index, text FROM vals JOIN pages USING (doc_id)), {_exact_sql("spread")},
        each AS (SELECT *, unnest(range(s, s + k + 1)) AS pos FROM hits)
        SELECT doc_id AS conv_id, page_index AS turn, count(*) AS boxes, count(DISTINCT pos) AS n_words FROM each GROUP BY ALL""",
    "ssn_net": f"""WITH {CUSTOMER} SELECT doc_id, 0 AS page_index, word_idx, 'ssn' AS category, 80 * word_idx AS x1, 0 AS y1, 80 * word_idx + 70 AS x2, 12 AS y2 FROM net""",
    "merge_boxes": """WITH RECURSIVE b AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 AS page_index, l_returnflag AS category, (l_partkey % 300)::INT AS x1, (l_suppkey * 13 % 200)::INT AS y1,
            (l_partkey % 300 + 40 + l_quantity)::INT AS x2, (l_suppkey * 13 % 200 + 60)::INT AS y2, l_linenumber / 10 AS confidence FROM lineitem),
        s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index, category ORDER BY y1, x1, x2, y2, confidence) AS rn FROM b),
        f AS (SELECT doc_id, page_index, category, rn, [{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'confidence': confidence, 'members': 1}] AS cs FROM s WHERE rn = 1
            UNION ALL
            SELECT s.doc_id, s.page_index, s.category, s.rn, CASE WHEN pos IS NULL OR pos = 0 THEN list_append(cs, {'x1': s.x1, 'y1': s.y1, 'x2': s.x2, 'y2': s.y2, 'confidence': s.confidence, 'members': 1})
                ELSE list_transform(cs, lambda c, k: CASE WHEN k = pos THEN {'x1': least(c.x1, s.x1), 'y1': least(c.y1, s.y1), 'x2': greatest(c.x2, s.x2), 'y2': greatest(c.y2, s.y2),
                     'confidence': greatest(c.confidence, s.confidence), 'members': c.members + 1} ELSE c END) END
            FROM (SELECT f.cs, s2.*, list_position(list_transform(f.cs, lambda c: c.x1 <= s2.x2 AND s2.x1 <= c.x2 AND c.y1 <= s2.y2 AND s2.y1 <= c.y2), true) AS pos
                  FROM f JOIN s s2 ON f.doc_id = s2.doc_id AND f.page_index = s2.page_index AND f.category = s2.category AND s2.rn = f.rn + 1) s),
        e AS (SELECT doc_id, page_index, category, unnest(cs) AS c FROM (SELECT doc_id, page_index, category, max_by(cs, rn) AS cs FROM f GROUP BY ALL))
        SELECT doc_id, page_index, category, c.confidence AS confidence, c.members AS members, c.x1 AS x1, c.y1 AS y1, c.x2 AS x2, c.y2 AS y2 FROM e""",
    "detect_document": f"""WITH {DETECTED} SELECT doc_id, category, 'model' AS source, count(*) AS findings, count(DISTINCT page_index) AS pages, 0.9::DOUBLE AS confidence FROM det GROUP BY ALL""",
    "second_detection": f"""WITH {DETECTED} SELECT doc_id, category, count(*) AS findings, count(DISTINCT page_index) AS pages FROM det GROUP BY ALL""",
    "fail_closed_tin": f"""WITH {CUSTOMER}, lost AS (SELECT c_custkey AS doc_id FROM customer WHERE c_custkey % 5 = 0)
        SELECT doc_id, 1::BIGINT AS unanchored, CASE WHEN doc_id IN (SELECT doc_id FROM net) THEN 0 ELSE 1 END::BIGINT AS unanchored_ids,
               CASE WHEN doc_id NOT IN (SELECT doc_id FROM net) THEN 'detection_unanchored' END AS error_code FROM lost""",
    "redact_text": f"""WITH {DETECTED}, hit AS (SELECT DISTINCT doc_id, word_idx, 1 AS hit FROM det)
        SELECT doc_id, count(hit) AS masked_words, sha256(string_agg(CASE WHEN hit = 1 THEN repeat('#', length(text)) ELSE text END, ' ' ORDER BY word_idx)) AS text_sha256
        FROM words LEFT JOIN hit USING (doc_id, word_idx) GROUP BY doc_id""",
    "residual_check": f"""WITH {DETECTED}, hit AS (SELECT DISTINCT doc_id, word_idx, 1 AS hit FROM det),
        o AS (SELECT doc_id, string_agg(CASE WHEN hit = 1 THEN repeat('#', length(text)) ELSE text END, ' ' ORDER BY word_idx) AS t FROM words LEFT JOIN hit USING (doc_id, word_idx) GROUP BY doc_id),
        n AS (SELECT doc_id, {' + '.join(f"len(regexp_extract_all(t, '{p}'))" for p in D.RULES.values())} AS residual FROM o)
        SELECT doc_id, residual::BIGINT AS residual, residual = 0 AS passed FROM n""",
    "manifest_json": f"""WITH {DETECTED}, p AS (SELECT doc_id, max(page_index) + 1 AS page_count FROM words GROUP BY doc_id),
        n AS (SELECT doc_id, count(*) AS n FROM det GROUP BY doc_id)
        SELECT doc_id::VARCHAR AS job_id, doc_id % 4 = 0 AS approved, true AS valid, page_count,
               (CASE WHEN doc_id % 4 = 0 THEN greatest(coalesce(n, 0) - 1, 0) ELSE coalesce(n, 0) END)::INT AS n_detections, NULL::VARCHAR AS error_code
        FROM p LEFT JOIN n USING (doc_id)""",
    "review_summary": f"""WITH {DETECTED}, c AS (SELECT doc_id, category, count(*) AS n, min(word_idx) AS first FROM det GROUP BY ALL),
        s AS (SELECT *, n || ' ' || CASE category WHEN 'email' THEN CASE n WHEN 1 THEN 'email' ELSE 'emails' END WHEN 'phone' THEN CASE n WHEN 1 THEN 'phone number' ELSE 'phone numbers' END
              WHEN 'ip_address' THEN CASE n WHEN 1 THEN 'IP address' ELSE 'IP addresses' END ELSE CASE n WHEN 1 THEN 'payment card' ELSE 'payment cards' END END AS said FROM c)
        SELECT doc_id, string_agg(said, ', ' ORDER BY n DESC, first, said) AS summary FROM s GROUP BY doc_id""",
    "page_box_counts": f"""WITH {DETECTED}, p AS (SELECT DISTINCT doc_id, page_index FROM words), n AS (SELECT doc_id, page_index, count(*) AS boxes FROM det GROUP BY ALL)
        SELECT doc_id, page_index, coalesce(boxes, 0) AS boxes FROM p LEFT JOIN n USING (doc_id, page_index)""",
    "review_edits": f"""WITH {DETECTED} SELECT doc_id, category, 'model' AS source, count(*) AS boxes FROM det WHERE category <> 'phone' GROUP BY ALL
        UNION ALL SELECT doc_id, 'user_added', 'user', count(DISTINCT page_index) FROM words GROUP BY doc_id""",
    "pixel_budget": """WITH d AS (SELECT l_orderkey AS doc_id, l_linenumber AS page_index, max(l_partkey % 7000)::BIGINT AS w, max(l_suppkey * 97 % 6000)::BIGINT AS h FROM lineitem GROUP BY ALL),
        r AS (SELECT doc_id, page_index, w * h AS pixels, (sum(w * h) OVER (PARTITION BY doc_id ORDER BY page_index ROWS UNBOUNDED PRECEDING))::BIGINT AS running FROM d)
        SELECT *, CASE WHEN pixels < 1 OR pixels > 24000000 THEN 'page_dimensions_too_large' WHEN running > 1300000000 THEN 'document_dimensions_too_large' END AS error_code FROM r""",
    "keyed_hash": f"SELECT c_custkey, {_hmac_sql('c_name')} AS hash FROM customer",
    "client_fingerprint": f"""SELECT c_custkey, left({_hmac_sql("'client:10.' || (c_custkey % 256) || '.' || (c_custkey // 256) || '.7'")}, 32) AS fingerprint FROM customer""",
    "content_fingerprint": f"""SELECT c_custkey, left({_hmac_sql("'content:' || lower(c_name) || ' ' || lower(c_mktsegment)")}, 16) AS fingerprint FROM customer""",
}
