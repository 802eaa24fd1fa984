"""Detection with a second look, and values that spread over their document by an index of pieces."""

import random
import string
import uuid

import pytest
from pyspark.sql import functions as F

from inkveil.operators import anchor as A
from inkveil.operators import detect as D
from inkveil.plans import documents as P
from tests.compare import check


def test_second_detection_same_as_sql(spark, data):
    check(spark, data, P.QUERIES["second_detection"], P.ORACLE_SQL["second_detection"])


def test_similar_runs_hold_a_piece():
    """Whatever is similar enough to a value holds one of its pieces, however it is edited."""
    rng, met = random.Random(5), 0
    for _ in range(6000):
        value = "".join(rng.choice(string.ascii_lowercase[:6]) for _ in range(rng.randint(2, 40)))
        run = list(value)
        for _ in range(rng.randint(0, 8)):
            k = rng.randrange(len(run) + 1)
            run[k : k + rng.randint(0, 1)] = rng.choice(["", "q", "a"])
        run = "".join(run)
        if A.similarity(run, value) >= A.SIMILAR:
            met += 1
            assert any(p in run for p in D.value_pieces(value)), (value, run)
    assert met > 1000 and all("".join(D.value_pieces(v)) == v for v in ("ab", "abcd", "abcde", "x" * 37))


def test_index_finds_what_all_pairs_find(spark, data):
    """The same spans as when each value is looked for on each page of its document, from fewer rows."""
    words = P._turns(spark, data)
    pages = A.page_words(words)
    titles = P._titles(words)
    values = titles.select("doc_id", "text", "category").distinct()
    every = values.join(pages.select("doc_id", "page_index"), "doc_id").select("doc_id", "page_index", F.lit(0).alias("item_ord"), "text", "category")
    few = D.propagated_items(titles, pages)

    def found(items):
        rows = A.anchor(items, pages).where(F.size("spans") > 0).select("doc_id", "page_index", "text", "mode", F.sort_array("spans").alias("spans"))
        return sorted(map(str, rows.collect()))

    assert found(few) == found(every) and few.count() < every.count()


def test_spreading_values_reach_other_pages(spark, data):
    """Values in parts, values with a letter wrong, and values of no length; a document without values gives nothing."""
    schema = "doc_id long, page_index int, text string"
    rows = [(1, 0, "John Quincy Sample, 45 Lewis Street here"), (1, 1, "so Jon Quincy Sample lives"), (1, 2, "at 45 Lewis Street now"), (1, 3, "nothing"), (2, 0, "John Quincy Sample")]
    from inkveil.sources.tables import text_pages

    pages = A.page_words(text_pages(spark.createDataFrame(rows, schema), page=F.col("page_index")))
    items = spark.createDataFrame(
        [(1, 0, 0, "John Quincy Sample", "person_name"), (1, 0, 1, "John Quincy Sample, 45 Lewis Street", "street_address"), (1, 0, 2, "-", "person_name"), (1, 0, 3, "lives", "email")],
        "doc_id long, page_index int, item_ord int, text string, category string",
    )
    got = {(r.page_index, r.category) for r in A.anchor(D.propagated_items(items, pages), pages).where(F.size("spans") > 0).collect()}
    assert got == {(0, "person_name"), (1, "person_name"), (0, "street_address"), (1, "street_address"), (2, "street_address")}
    assert D.propagated_items(items.where("doc_id = 9"), pages).count() == 0


@pytest.mark.parametrize("reads", [True, False])
def test_provider_is_called_once_a_page_and_once_more_for_flagged(spark, tmp_path, reads):
    schema = "doc_id long, page_index int, words array<struct<word_idx:int,text:string,box:struct<x1:int,y1:int,x2:int,y2:int>,source:string>>"

    def page(doc, number, texts, source="pdf"):
        return (doc, number, [(k, t, (80 * k, 0, 80 * k + 70, 12), source) for k, t in enumerate(texts)])

    true = {(1, 0): ["see", "alpha@x.org"], (1, 1): ["see", "beta@x.org"], (2, 0): ["gamma@x.org"], (2, 1): [], (3, 0): ["delta@x.org"]}
    layer = dict(true)
    layer[1, 1], layer[3, 0] = ["zz", "zz"], ["zz"]
    rows = [page(*k, v, "ocr" if k == (3, 0) else "pdf") for k, v in layer.items()]
    calls, read = tmp_path / "calls", tmp_path / "read"
    calls.mkdir()
    read.mkdir()
    seen = {" ".join(v): " ".join(v) for v in true.values() if v} | {"zz zz": "beta@x.org", "zz": "delta@x.org"}

    def ask(texts):
        out = []
        for t in texts:
            (calls / f"{t.replace(' ', '_')}-{uuid.uuid4().hex}").touch()
            mail = next(w for w in seen[t].split() if "@" in w)
            out.append('{"items": [{"text": "%s", "category": "email"}]}' % mail)
        return out

    def read_again(pages):
        for r in pages.select("doc_id", "page_index").collect():
            (read / f"{r.doc_id}-{r.page_index}").touch()
        return spark.createDataFrame([page(*k, v, "ocr") for k, v in true.items()], schema).join(pages.select("doc_id", "page_index"), ["doc_id", "page_index"], "left_semi")

    provider = D.CallProvider(ask)
    provider.categories = ("email",)
    found = D.detect(spark.createDataFrame(rows, schema), provider, read_again if reads else None)
    boxes = {(r.doc_id, r.page_index, r.box.x1) for r in found.collect()}
    assert boxes == {(1, 0, 80), (2, 0, 0)} | ({(1, 1, 80)} if reads else set())
    if reads:
        asked = sorted(p.name.rsplit("-", 1)[0] for p in calls.iterdir())
        assert asked == sorted(["see_alpha@x.org", "see_beta@x.org", "zz_zz", "gamma@x.org", "zz"]) and [p.name for p in read.iterdir()] == ["1-1"]
