"""Stages leave texts where they are when only few keys are joined to them; redaction takes base and discovered spans."""

import pytest

import corpus_pipeline
from riftline.llm import banding, pii
from tests.llm.test_contracts import DOCS, words


@pytest.fixture
def small_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_personal_data_does_not_shuffle_texts(spark, small_broadcasts):
    rows = [(k, f"{words(6, k % 50)} joe{k}@mail{k % 7}.org {words(4, k % 40)} 10.2.3.{k % 256}", "en", "s", 1) for k in range(1500)]
    out = corpus_pipeline.personal_data(spark, spark.createDataFrame(rows, DOCS), "")
    assert "SortMergeJoin" not in plan(out)
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts == {k: t.replace(f"joe{k}@mail{k % 7}.org", "[EMAIL]").replace(f"10.2.3.{k % 256}", "[IP]") for k, t, *_ in rows}


def test_redaction_takes_discovered_spans_as_well(spark):
    """Each document holds an address and a number that only its context gives away; rows repeat and ids are null."""
    number = lambda k: f"+1 (555) 123-4{k:03d}" if k < 12 else f"555-987-4{k:03d}"
    rows = [(k if k % 3 else None, f"{words(9, 60 + k)} ruf hotline {number(k)} {words(5, 90 + k)} a{k}@b.cd") for k in range(18)]
    rows.append(rows[17])
    left = sorted(r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect())
    assert left == sorted(f"{words(9, 60 + k)} ruf hotline [PHONE] {words(5, 90 + k)} [EMAIL]" for k in [*range(18), 17])


def test_near_duplicates_joins_texts_with_few_keys_only(spark, small_broadcasts, monkeypatch):
    joins, whole = [], banding.materialise

    def seen(df, **options):
        if df.columns == ["a", "b"] and "pythonUDF" in plan(df):
            joins.append(plan(df).count("SortMergeJoin"))
        return whole(df, **options)

    monkeypatch.setattr(banding, "materialise", seen)
    rows = [(k, words(60, 400 + k // 2) + " more" * (k % 2), "en", "s", 1) for k in range(600)]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "")
    assert "SortMergeJoin" not in plan(out)
    assert joins
    assert max(joins) <= 1  # the second texts have to meet the first
    assert sorted(r.doc_id for r in out.collect()) == list(range(0, 600, 2))
