"""Shards of a sample by levelled loads."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkveil.operators import evaluate as E
from inkveil.streaming import evaluation as V


def greedy(entries, shards):
    heap = [(0, k) for k in range(shards)]
    out = {}
    for pages, key in sorted((-p, k) for k, p in entries):
        load, shard = heapq.heappop(heap)
        out[key] = (-pages, shard)
        heapq.heappush(heap, (load - pages, shard))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_lpt_is_the_greedy_one(spark, seed):
    rng = random.Random(seed)
    shards, most = rng.choice([(1, 5), (3, 2), (7, 300), (5, 40)])
    entries = [(f"{rng.randrange(1 << 40):011x}", rng.randint(1, most)) for _ in range(rng.choice([1, 8, 400, 3000]))]
    rows = spark.createDataFrame(entries, "evaluation_id string, page_count int").repartition(5)
    got = {r.evaluation_id: (r.page_count, r.shard) for r in E.lpt_shards(rows, shards).collect()}
    assert got == greedy(entries, shards)


def test_lpt_has_no_limit(spark):
    """Two classes of a hundred and fifty thousand entries: no error, no list of all, equal loads."""
    rows = spark.range(300_000).select(F.sha2(F.col("id").cast("string"), 256).alias("evaluation_id"), F.when(F.col("id") % 2 == 0, 7).otherwise(3).alias("page_count"))
    loads = [r[1] for r in E.lpt_shards(rows, 11).groupBy("shard").agg(F.sum("page_count")).collect()]
    assert sum(loads) == 1_500_000 and max(loads) - min(loads) <= 7 and len(loads) == 11
    assert E.lpt_shards(rows.where("page_count < 0"), 3).count() == 0


def test_levels():
    loads = np.array([10, 3, 3, 0])
    for n in range(30):
        assert E._leveled(loads, 4, n).tolist() == (loads + 4 * np.bincount(E._places(np.arange(n), loads, 4), minlength=4) if n else loads).tolist()


ENTRIES = "evaluation_id string, split string, page_count int"


def entries(spark, n=23):
    return spark.createDataFrame([(f"{k:04d}", "tuning" if k % 5 == 0 else "holdout", k % 4 + 1) for k in range(n)], ENTRIES)


def judged(batch):
    return batch.withColumns({
        "elapsed_seconds": F.lit(0.5), "finding_count": F.col("page_count") * 2, "residual_deterministic": F.lit(0), "residual_model": F.lit(0),
        "passed": F.col("page_count") < 4, "error_code": F.when(F.col("page_count") == 4, "boom"),
    })


def files(path):
    keep = ("run.json", "complete.json", "summary-holdout.json")
    return {p.name: p.read_text() for p in path.iterdir() if p.name in keep} | {p.name: p.read_text() for p in (path / "progress").iterdir()}


@pytest.mark.parametrize("dies_at", [0, 1, 3])
def test_killed_and_restarted_the_outputs_are_the_same(spark, tmp_path, dies_at):
    whole = sorted(map(str, V.evaluation_run(entries(spark), judged, str(tmp_path / "a"), "holdout", 4, {"v": 1}).collect()))
    calls = []

    def dying(batch):
        calls.append(batch.count())
        if len(calls) == dies_at + 1:
            raise RuntimeError("killed")
        return judged(batch)

    with pytest.raises(Exception, match="killed"):
        V.evaluation_run(entries(spark), dying, str(tmp_path / "b"), "holdout", 4, {"v": 1})
    assert not (tmp_path / "b" / "complete.json").exists()
    again = sorted(map(str, V.evaluation_run(entries(spark), dying, str(tmp_path / "b"), "holdout", 4, {"v": 1}).collect()))
    assert again == whole and len(whole) == 18 and len(calls) == 5 and files(tmp_path / "b") == files(tmp_path / "a")
    assert V.progress(str(tmp_path / "b")) == {"documents": 18, "pages": sum(k % 4 + 1 for k in range(23) if k % 5), "passed": 14, "failures": 4}
    V.evaluation_run(entries(spark), dying, str(tmp_path / "b"), "holdout", 4, {"v": 1})
    assert len(calls) == 5
    with pytest.raises(ValueError, match="evaluation_checkpoint_invalid"):
        V.evaluation_run(entries(spark), judged, str(tmp_path / "b"), "holdout", 4, {"v": 2})


def test_a_result_too_few_or_too_many_has_no_marker(spark, tmp_path):
    for name, spoil in (("few", lambda df: df.where("evaluation_id <> '0001'")), ("many", lambda df: df.unionByName(df))):
        with pytest.raises(Exception, match="evaluation_checkpoint_invalid"):
            V.evaluation_run(entries(spark), lambda b, s=spoil: s(judged(b)), str(tmp_path / name), "holdout", 2)
        assert not (tmp_path / name / "complete.json").exists()


def test_evaluation_query_same_as_sql(spark, data):
    from inkveil.plans import streams
    from tests.compare import check

    check(spark, data, streams.QUERIES["evaluation_run"], streams.ORACLE_SQL["evaluation_run"])
