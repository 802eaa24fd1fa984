"""Rows on which queries and their SQL used to part: fractions of seconds, zero values, values that a page break cuts."""

import datetime

import pytest

from inkveil.plans.catalogue import ORACLE_SQL, QUERIES
from tests.compare import TABLES, rows, views


def held(spark, data, tmp_path, name, **tables):
    """A query against its SQL where some tables are others."""
    import os

    for t in TABLES:
        if t in tables:
            tables[t].coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
        else:
            os.symlink(f"{data}/{t}.parquet", tmp_path / f"{t}.parquet")
    df, said = QUERIES[name](spark, str(tmp_path)), views(str(tmp_path)).sql(ORACLE_SQL[name])
    got = rows(df.columns, df.collect())
    assert got == rows(said.columns, said.fetchall())
    return got


def events(spark, made):
    kind = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.createDataFrame([(k, ts, 1, "view", v, "{}") for k, ts, v in made], kind)


def test_alarms_take_the_nearest_second(spark, data, tmp_path):
    at = datetime.datetime(2024, 1, 1, 0, 4, 59, 700_000)
    made = [(3, at, 90.0), (6, at + datetime.timedelta(seconds=300), 90.0), (49 * 50 - 1, at, 1.0)]
    assert any("queue_age" in r for r in held(spark, data, tmp_path, "alarms", events=events(spark, made)))


def test_a_metric_of_zero_is_made_negative(spark, data, tmp_path):
    made = [(k, datetime.datetime(2024, 1, 1), 0.0) for k in range(87, 90)]
    assert held(spark, data, tmp_path, "metric_valid", events=events(spark, made)) == []


@pytest.mark.parametrize("name", ["eval_results", "eval_summary", "evaluation_run"])
def test_an_evaluation_counts_residuals_by_page(spark, data, tmp_path, name):
    """A phone number that a page break cuts is on neither page."""
    text = " ".join(["word"] * 598 + ["+1", "(652)", "555-4544", "a@b.org"])
    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, None, "en", "s", 0), (3, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    held(spark, data, tmp_path, name, documents=docs)


def test_the_whole_text_is_still_checked(spark, data, tmp_path):
    text = " ".join(["word"] * 598 + ["+1", "(652)", "555-4544"])
    docs = spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long")
    assert held(spark, data, tmp_path, "residual_check", documents=docs) == ["1|False|1"]
