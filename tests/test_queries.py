import pytest

from inkveil.plans.catalogue import ORACLE_SQL, QUERIES
from tests.compare import check

# Some that share no operators with others; the driver compares all.
NAMES = (
    "text_words gate_pages grid_rows box_normalize box_rotate category_map anchor_exact anchor_fragments propagate ssn_net merge_boxes "
    "detect_document fail_closed_tin residual_check manifest_json review_summary pixel_budget upload_validate magic_validate keyed_hash "
    "job_latest job_transitions admission daily_metrics visits sample_split lpt_shards batch_rollup unique_filenames stream_jobs stream_visits"
).split()


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, data, name):
    check(spark, data, QUERIES[name], ORACLE_SQL[name])


def test_long_manifests_are_whole(spark, data, monkeypatch):
    """All detections but the first are in the approved manifest, however many there are."""
    from pyspark.sql import functions as F

    from inkveil.plans import documents

    one = documents.rule_detections(spark, data).limit(1).withColumn("doc_id", F.lit(4).cast("long"))
    many = spark.createDataFrame(one.collect(), one.schema).crossJoin(spark.range(20_005).select(F.col("id").alias("n")))
    monkeypatch.setattr(documents, "rule_detections", lambda *_: many.drop("n"))
    assert {r.job_id: r.n_detections for r in documents.q_manifest_json(spark, data).collect()}["4"] == 20_004


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
