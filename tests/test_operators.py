import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkveil.functions import scalars as S
from inkveil.operators import anchor as A
from inkveil.operators import detect as D
from inkveil.operators import pages as P
from inkveil.operators import redact as R
from inkveil.operators import usage as U
from inkveil.operators import records as K
from inkveil.sources.tables import file_digests, files, gathered, malformed, manifests, messages, text_pages, text_words


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def words(spark, *pages):
    rows = [(1, p, i, t, (10 * i, 20 * p, 10 * i + 8, 20 * p + 12), "pdf") for p, text in enumerate(pages) for i, t in enumerate(text.split())]
    return spark.createDataFrame(rows, "doc_id long, page_index int, word_idx int, text string, box struct<x1:int,y1:int,x2:int,y2:int>, source string")


def spans(spark, text, value):
    items = spark.createDataFrame([(1, 0, 0, value, "person_name")], "doc_id long, page_index int, item_ord int, text string, category string")
    row = A.anchor(items, A.page_words(words(spark, text))).first()
    return row["mode"], [(x["s"], x["e"]) for x in row["spans"]]


@pytest.mark.parametrize(
    "text, value, mode, found",
    [
        ("ANNA MOSS 12 LAKE RD", "Anna Moss", "exact", [(0, 1)]),
        ("ANNA MOSS and Anna Moss", "anna moss", "exact", [(0, 1), (3, 4)]),
        ("Smithson-Extra here", "Smithson", "exact", [(0, 0)]),
        ("12 LAK E STREET", "12 LAKE STREET", "exact", [(0, 3)]),
        ("Lake Street between Springfield town", "Lake Street,  Springfield", "fragments", [(0, 1), (3, 3)]),
        ("Johnathan Appleseed signs", "Johnathan Applesead", "similar", [(0, 1)]),
        ("nothing of the kind", "Zebra Quartz", "none", []),
    ],
)
def test_anchor(spark, text, value, mode, found):
    assert spans(spark, text, value) == (mode, found)


def test_similarity_is_longest_common_subsequence():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for k, y in enumerate(b):
                last, row[k + 1] = row[k + 1], last + 1 if x == y else max(row[k + 1], row[k])
        return row[-1]

    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(0, 90))) for _ in "ab")
        want = 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0
        assert A.similarity(a, b) == want


def exact(value, norms):
    """By definition: from each word the least number of words whose run gives the value, or begins with it if that is long."""

    def gives(i, k):
        run = "".join(norms[i : i + k])
        return all(norms[i : i + k]) and (run == value or run.startswith(value) and len(value) >= (4 if k == 1 else 8))

    least = {i: min((k for k in range(1, min(12, len(norms) - i) + 1) if gives(i, k)), default=None) for i in range(len(norms))}
    return [(i, i + k - 1) for i, k in least.items() if k and len(value) >= 2]


def similar(value, norms):
    """By definition: of all runs of non-empty words that are not too long the one of the highest share of a longest common
    subsequence, the first and then the shortest of equals; none under 90."""

    def share(x):
        row = [0] * (len(x) + 1)
        for ch in value:
            row = _next_row(row, ch, x)
        return 200.0 * row[-1] / (len(x) + len(value))

    most = max(1, min(12, round(len(value) / 5))) + 2
    runs = [(s, s + k) for s in range(len(norms)) for k in range(1, most + 1) if s + k <= len(norms) and all(norms[s : s + k])]
    scored = [(-share("".join(norms[s:e])), s, e - 1) for s, e in runs]
    best = min(scored, default=(0, 0, 0))
    return (best[1], best[2]) if best[0] <= -90.0 else None


def _next_row(row, ch, x):
    out = [0]
    for j, y in enumerate(x):
        out.append(row[j] + 1 if ch == y else max(out[j], row[j + 1]))
    return out


def test_exact_spans_by_definition(spark):
    """On random words of small alphabets."""
    rng = random.Random(5)
    cases = [("".join(rng.choice("ab") for _ in range(rng.randrange(1, 11))), ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 4))) for _ in range(rng.randrange(1, 16))]) for _ in range(400)]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, value string, norms array<string>")
    got = {r.k: [(x.s, x.e) for x in r.v] for r in df.select("k", A.exact_spans(F.col("value"), F.col("norms")).alias("v")).collect()}
    assert all(got[k] == exact(*c) for k, c in enumerate(cases))


def test_best_span_by_definition():
    """The filter by length and letters loses no run, and of equals the first is taken."""
    rng = random.Random(6)
    for _ in range(300):
        norms = ["".join(rng.choice("abcde") for _ in range(rng.randrange(0, 5))) for _ in range(rng.randrange(1, 14))]
        at = rng.randrange(len(norms))
        value = list("".join(norms[at : at + 4]) or "ab")
        if rng.random() < 0.7:
            value[rng.randrange(len(value))] = rng.choice("abcdez")
        value = "".join(value)
        assert A.best_span(value, norms) == similar(value, norms), (value, norms)


@pytest.mark.parametrize("name", ["anchor_fuzzy", "anchor_cascade"])
def test_anchor_queries_by_definition(spark, data, name):
    """The queries that SQL cannot say, against the definitions on the whole table."""
    from inkveil.plans import documents as Q

    got = {(r.doc_id, r.page_index, r.item_ord): r for r in Q.QUERIES[name](spark, data).collect()}
    pages = Q.pages_of(spark, data).where("size(words) > 0").collect()
    clean = lambda t: "".join(c for c in t.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789*x•")
    seen = 0
    for p in pages:
        ws = [w.text for w in p.words]
        norms, first = [clean(w) for w in ws], " ".join(ws[:4])
        value = clean((first[:2] + "q" + first[3:]).replace(" ", ""))
        if len(ws) < 4 or len(value) < 2 or "," in first:  # with a comma there are fragments, which come first
            continue
        whole, close = exact(value, norms), similar(value, norms)
        mode = "exact" if whole else "similar" if close else "none"
        row = got.get((p.doc_id, p.page_index, 1))
        seen += 1
        if name == "anchor_cascade":
            assert (row.mode, row.n_spans) == (mode, len(whole) if whole else int(close is not None))
        elif mode == "similar":
            assert (row.first_word - p.words[0].word_idx, row.n_words) == (close[0], close[1] - close[0] + 1)
    assert seen > 100


def test_ssn_net(spark):
    found = D.ssn_net(words(spark, "No 123-45-6789 12-3456789 ***-**-4321 987-65- 4321, end")).orderBy("word_idx")
    assert [r.word_idx for r in found.collect()] == [1, 3, 4, 5]


def test_merge_is_greedy(spark):
    boxes = [(10, 50, 0.5), (40, 90, 0.9), (200, 220, 0.1), (85, 205, 0.2)]
    rows = [(1, 0, "ssn", (x1, y, x2, 100), c, "model", "") for y, (x1, x2, c) in enumerate(boxes)]
    df = spark.createDataFrame(rows, "doc_id long, page_index int, category string, box struct<x1:int,y1:int,x2:int,y2:int>, confidence double, source string, id string")
    got = sorted((r.box.x1, r.box.x2, r.confidence) for r in D.merged(df).collect())
    assert got == [(10, 205, 0.9), (200, 220, 0.1)]


def test_grid(spark):
    assert P.page_grid(words(spark, "a b")).first()["grid"] == "a b"
    w = words(spark, "left right").withColumn("box", F.when(F.col("word_idx") == 1, S.box(F.lit(500), F.lit(0), F.lit(600), F.lit(12))).otherwise(F.col("box")))
    assert P.page_grid(w).first()["grid"].index("right") == 60


def test_gate_and_routing(spark):
    good, bad = "plain words that are long enough to be trusted by the gate", "é" * 50
    got = {r.page_index: r.garbage for r in P.text_gate(words(spark, good, bad, "short")).collect()}
    assert got == {0: False, 1: True, 2: True}
    assert one(spark, P.paints_text(F.array(F.lit("Link")))) is False
    assert one(spark, P.paints_text(F.lit(None).cast("array<string>"))) is True


@pytest.mark.parametrize("turn, want", [(0, (100, 200, 300, 400)), (90, (600, 100, 800, 300)), (180, (700, 600, 900, 800)), (270, (200, 700, 400, 900))])
def test_rotation(spark, turn, want):
    b = S.box(*map(F.lit, (100, 200, 300, 400)))
    assert tuple(one(spark, S.rotated_box(b, F.lit(turn)))) == want


def test_keyed_hash_is_hmac(spark):
    import hashlib
    import hmac

    for key in (b"k", b"x" * 100):
        assert one(spark, S.keyed_hash(F.lit("text"), key)) == hmac.new(key, b"text", hashlib.sha256).hexdigest()


def test_paint_and_dark_share():
    image = np.full((40, 40, 3), 255, dtype=np.uint8)
    out = R.paint(image, [(5, 5, 20, 20)])
    assert R.dark_share(out, (5, 5, 20, 20)) == 1.0 and R.dark_share(out, (21, 21, 39, 39)) == 0.0 and (image == 255).all()


def test_sources(spark, tmp_path):
    for name in ("b.pdf", "A.pdf", "c.txt"):
        (tmp_path / name).write_bytes(name.encode())
    found = files(spark, str(tmp_path), content=True)
    assert [r.path.rsplit("/", 1)[1] for r in found.collect()] == ["A.pdf", "b.pdf"]
    assert file_digests(found).count() == 2
    texts = spark.createDataFrame([('{"schema_version":1,"job_id":"j","task":"detect"}',), ("no",), ('{"schema_version":2}',)], "body string")
    assert [r.job_id for r in messages(texts, "body").collect()] == ["j"]
    assert sorted(r.body for r in malformed(texts, "body").collect()) == ["no", '{"schema_version":2}']
    assert [r.valid for r in manifests(texts, "body").collect()].count(True) == 0


def test_empty_and_null_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " a\tb ")], "doc_id long, text string")
    assert [(r.doc_id, r.text) for r in text_words(df).collect()] == [(3, "a"), (3, "b")]
    empty = text_words(df.where("doc_id < 3"))
    assert P.page_grid(empty).count() == 0 and D.detect(empty, D.RuleProvider()).count() == 0


def test_pages_without_words(spark):
    """They have a row: garbage, an empty grid, and first in line for OCR."""
    pages = text_pages(spark.createDataFrame([(1, None), (2, " \n"), (3, "a b " * 700)], "doc_id long, text string"))
    assert sorted((r.doc_id, r.page_index, len(r.words)) for r in pages.collect()) == [(1, 0, 0), (2, 0, 0), (3, 0, 600), (3, 1, 600), (3, 2, 200)]
    gate = P.text_gate(pages)
    assert {r.doc_id for r in gate.where("garbage").collect()} == {1, 2}
    assert {r.doc_id: r.grid for r in P.page_grid(pages.where("doc_id < 3")).collect()} == {1: "", 2: ""}
    routed = P.route_pages(gate.withColumn("needs_ocr", F.lit(False)), True)
    assert {r.doc_id for r in routed.where("route = 'ocr'").collect()} == {1, 2}
    assert D.detect(pages, D.RuleProvider()).count() == 0 and D.ssn_net(pages).count() == 0


def test_pages_are_the_words_gathered(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(40)
    a = {(r.doc_id, r.page_index): [tuple(w) for w in r.words] for r in text_pages(docs).where("size(words) > 0").collect()}
    b = {(r.doc_id, r.page_index): [tuple(w) for w in r.words] for r in gathered(text_words(docs)).collect()}
    assert a == b


def test_read_again_needs_a_text_layer(spark):
    w = words(spark, "alpha beta gamma", "alpha beta gamma").withColumn("source", F.when((F.col("page_index") == 1) & (F.col("word_idx") == 2), "ocr").otherwise("pdf"))
    items = spark.createDataFrame([(1, p, 0, "zebra quartz", "person_name") for p in (0, 1)], "doc_id long, page_index int, item_ord int, text string, category string")
    got = {r.page_index: r.read_again for r in D.anchor_counts(A.anchor(items, A.page_words(w)), w).collect()}
    assert got == {0: True, 1: False}


def test_residual_runs_the_identifier_net(spark):
    df = spark.createDataFrame([(1, "no 123-45-6789, end"), (2, "987-65- 4321"), (3, "12-3456789 ###"), (4, None)], "doc_id long, t string")
    assert {r.doc_id: (r.residual, r.passed) for r in R.residual(df, {}, "t").collect()} == {1: (1, False), 2: (1, False), 3: (0, True), 4: (0, True)}


def test_small_usage(spark):
    assert one(spark, U.minutes_left(F.lit(61))) == "2 min" and one(spark, U.minutes_left(F.lit(7200))) == "2 hr 0 min"
    assert one(spark, U.drag_box(*map(F.lit, (10.5, 5.0, 3.0, 9.0)))).asDict() == {"x1": 3, "y1": 5, "x2": 11, "y2": 9}


def test_call_provider(spark):
    def ask(texts):
        return ['{"items":[{"text":" x ","category":"email"},{"text":"y","category":"who"}]}' if "x" in t else "bad" for t in texts]

    pages = spark.createDataFrame([(1, 0, "has x"), (1, 1, "none")], "doc_id long, page_index int, text string")
    p = D.CallProvider(ask)
    assert [(r.text, r.category) for r in p.items(pages).collect()] == [("x", "email")]
    assert sorted(str(r.error_code) for r in D.answer_errors(p.answers(pages)).collect()) == ["None", "model_output_invalid"]


def test_streams_of_several_batches(spark, data, tmp_path, monkeypatch):
    """Many small files, one a batch: the results are those of one batch."""
    from inkveil.plans import operations as O
    from inkveil.streaming import streams as ST

    spark.read.parquet(f"{data}/events.parquet").repartition(5, "event_id").write.parquet(f"{tmp_path}/events.parquet")

    def one_file(spark, sf_dir):
        rows = spark.readStream.schema(ST.EVENTS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parque[t]")
        return rows.withColumn("ts", F.col("ts").cast("timestamp"))

    whole = {tuple(r) for r in O.QUERIES["stream_daily_metrics"](spark, data).collect()}
    monkeypatch.setattr(ST, "event_stream", one_file)
    days = ST.run_to_end(ST.daily_stream(O.events_as_metrics(one_file(spark, str(tmp_path)), O.NAMES), "3650 days"), "complete")
    assert days.count() == len(whole) and days.select("date", "name").distinct().count() == days.count()
    triggers = O._triggers(one_file(spark, str(tmp_path)))
    jobs = ST.run_to_end(ST.job_stream(triggers), "update", "job")
    assert jobs.count() == jobs.select("job").distinct().count()
    n = {r["job"]: r["n"] for r in O._triggers(spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))).groupBy("job").agg(F.count("*").alias("n")).collect()}
    assert {r["job"]: r["applied"] + r["refused"] for r in jobs.collect()} == n


def test_records(spark):
    assert one(spark, K.csv_line(F.lit(1), F.lit('a "b", c'), F.lit(None).cast("string"), F.lit("x\ny"))) == '1,"a ""b"", c",,"x\ny"'
    assert one(spark, K.batch_name(F.lit(7), F.lit(120))) == "redacted-007-of-120.pdf"
    assert one(spark, K.progress_percent(F.lit(1), F.lit(8))) == 13 and one(spark, K.progress_percent(F.lit(1), F.lit(0))) is None
    assert one(spark, K.valid_prefix(F.lit("/private-evaluation/" + "a" * 32 + "/"))) == "private-evaluation/" + "a" * 32
    assert one(spark, K.valid_prefix(F.lit("private-evaluation/" + "a" * 32 + "\n"))) is None
    assert one(spark, K.same_ids(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(1)))) is True
    u, v = 0.2, 0.7
    for turn in (0, 90, 180, 270):
        b = S.rotated_box(S.box(*map(F.lit, (200, 700, 201, 701))), F.lit(turn))
        p = one(spark, K.unrotated_point(b["x1"] / 1000, b["y1"] / 1000, F.lit(turn)))
        assert abs(p["x"] - u) < 0.002 and abs(p["y"] - v) < 0.002
    kept = K.without_private(spark.createDataFrame([(1, "t", "f", "d")], "a int, access_token string, filename string, document_text string"))
    assert kept.columns == ["a"]


def test_documents_by_adapter(spark):
    """Readers by suffix; errors in place of pages; OCR where the text layer cannot be trusted."""
    from inkveil.sources import documents as L

    class Picture:
        def page_count(self, content):
            if content == b"bad":
                raise L.DocumentError("image_unreadable")
            return len(content)

        def page(self, content, numbers):
            return [L.Page(100, 50 if content != b"w" else 10**9, needs_ocr=True) for _ in numbers]

        def pages(self, content):
            yield from self.page(content, range(len(content)))

    class Ocr:
        def words(self, content, page):
            return [(("seen", 0.0, 0.0, 50.0, 25.0), 50.0)]

    rows = [("a.PNG", b"x"), ("b.png", b"bad"), ("c.png", b"w"), ("e.png", None), ("none", b"x"), ("f.png", b"abc")]
    files_ = spark.createDataFrame(rows, "path string, content binary")
    readers = {".png": Picture()}
    got = {(r.path, r.page_index): r for r in L.load(files_, readers, Ocr(), max_pages=2).collect()}
    errors = {p: r.error_code for (p, k), r in got.items() if k is None}
    assert errors == {"b.png": "image_unreadable", "c.png": "page_dimensions_too_large", "e.png": "document_empty", "none": "unsupported_file_type", "f.png": "too_many_pages"}
    (w,) = got["a.PNG", 0].words
    assert (w.text, w.source, tuple(w.box)) == ("seen", "ocr", (0, 0, 500, 500))
    assert {r.error_code for r in L.load(files_.where("path = 'a.PNG'"), readers).collect()} == {"ocr_unavailable"}
    kinds = {r.path: (r.page_count, r.text_kind) for r in L.probe(files_, readers).collect()}
    assert kinds["a.PNG"] == (1, "scanned") and kinds["b.png"] == (None, "unknown") and kinds["e.png"] == (0, "unknown")
