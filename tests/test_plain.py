"""Pages in short: the same words, the same norms and runs, and one pass over the documents."""

import random

import pytest
from pyspark.sql import functions as F

from inkveil.functions import scalars as S
from inkveil.operators import anchor as A
from inkveil.operators import detect as D
from inkveil.plans import documents as P
from inkveil.sources.tables import gathered, plain_pages, text_pages


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


@pytest.mark.parametrize("name, most", [("anchor_cascade", 1), ("anchor_exact", 1), ("anchor_fuzzy", 1), ("ocr_routing", 2)])
def test_documents_are_read_once(spark, data, name, most):
    assert scans(P.QUERIES[name](spark, data)) <= most


def test_plain_pages_are_pages(spark):
    docs = spark.createDataFrame([(1, None), (2, " \n"), (3, "a b " * 700), (4, "x y z")], "doc_id long, text string")
    same = lambda df: sorted(map(str, df.select("doc_id", "page_index", "words").collect()))
    assert same(gathered(plain_pages(docs))) == same(text_pages(docs))


def test_joined_norms_are_norms(spark):
    texts = ["Ab-9", "ΣΑΣ", "•x*", "İK", "\x01a", "é", "", "ß7", "x y", "ÅK•"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", S.norm(F.col("t")).alias("n"))
    want = [r.n for r in df.orderBy("k").collect()]
    assert A.joined_norms("\n".join(texts)).split("\n") == want
    assert [A.joined_norms(t) for t in texts] == want


def test_exact_runs_are_exact_spans(spark):
    rng, cases = random.Random(9), []
    for _ in range(300):
        norms = ["".join(rng.choice("ab•") for _ in range(rng.randrange(0, 4))) for _ in range(rng.randrange(0, 16))]
        at = rng.randrange(len(norms) + 1)
        cases.append(("".join(norms[at : at + rng.randrange(1, 13)])[: rng.randrange(1, 24)], norms))
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, value string, norms array<string>")
    got = {r.k: [(x.s, x.e) for x in r.v] for r in df.select("k", A.exact_spans(F.col("value"), F.col("norms")).alias("v")).collect()}
    assert all(A.exact_runs(*c) == got[k] for k, c in enumerate(cases)) and sum(map(len, got.values())) > 50


def test_identifier_in_two_words_is_kept(spark):
    text = "a 123-45-6789 b (987-65- 4321), 11-22-33 c 123 -45-6789 x ***-**. -4321"
    docs = spark.createDataFrame([(1, text), (2, "no 12-34 here")], "doc_id long, text string")
    assert sorted((r.doc_id, r.word_idx) for r in D.ssn_net(plain_pages(docs)).collect()) == [(1, 1), (1, 3), (1, 4), (1, 7), (1, 8), (1, 10), (1, 11)]


@pytest.mark.parametrize("name", ["page_grid", "prompts", "grid_rows"])
def test_rows_are_folded_once(spark, data, name):
    """A page's rows are made by one Python step, which no filter on its result doubles, and not word by word in a projection."""
    from inkveil.plans.catalogue import QUERIES

    plan = QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan and "aggregate(" not in plan


def test_row_sizes_are_those_of_rows(spark, data):
    words = P._uneven(spark, data)
    from inkveil.operators import pages as G

    few = sorted((r.doc_id, r.page_index, [(x.c, x.n) for x in r.rows]) for r in G.row_sizes(words).collect())
    assert few == sorted((r.doc_id, r.page_index, [(x.c, len(x.ws)) for x in r.rows]) for r in G.page_rows(words).collect()) and len(few) > 100


@pytest.mark.parametrize("name", ["fail_closed_tin", "ssn_net"])
def test_customers_are_dealt_over_the_cores(spark, data, name):
    """A table in one part, as its reader gives it, would be one task's work."""
    assert P.customer_words(spark, data).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert "REPARTITION_BY_NUM" in P.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
