"""Repetitive texts in decontamination, and columns of any name in the pipeline's stages."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riftline.llm import decontaminate
from tests.llm.test_contracts import DOCS, words


def leaks(docs, items):
    """Every window of every item at every place of every document."""
    out = {}
    for k, text in docs:
        w, hit, held = (text or "").lower().split(), set(), set()
        for i, body in items:
            x = (body or "").lower().split()
            n = min(len(x), 10)
            for a in range(len(x) - n + 1) if x else ():
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == x[a : a + n]:
                        hit |= set(range(s, s + n))
                        held.add(str(i))
        out[k] = (len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit))
    return out


def test_few_words_in_many_orders(spark):
    """Texts of two words each hold most windows at many places, overlapping themselves."""
    r = random.Random(12)
    text = lambda n: " ".join(r.choice(["a", "B"]) for _ in range(n))
    docs = [(k, text(r.randint(0, 300))) for k in range(40)] + [(40, "a " * 120), (41, None), (42, "a " * 9 + "c")]
    items = [(k, text(r.randint(1, 25))) for k in range(30)] + [(30, "a " * 30), (31, "a " * 30), (32, "b"), (33, None), (34, "")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.query(*frames).collect()}
    assert found == leaks(docs, items)


def test_one_word_repeated_two_hundred_thousand_times(spark):
    docs = spark.createDataFrame([(1, "spam " * 200_000 + "end " + "spam " * 9)], "doc_id long, text string")
    items = spark.createDataFrame([(k, "spam " * 30) for k in range(5)], "item_id long, text string")
    (found,) = decontaminate.query(docs, items).collect()
    assert (found.n_words, found.n_hit, found.n_items) == (200_010, 200_000, 5)


CLASHES = ("_rk", "spans", "found", "hits", "root", "content", "key", "words", "leaves", "keeper", "_text", "places", "win", "__other_0", "a b", "x.y")


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_columns_of_any_name(spark, tmp_path, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    leak = words(40, 50)
    rows = [(k, words(60, 300 + k), "en", "s", 1) for k in range(6)] + [(6, words(60, 300), "en", "s", 1), (7, leak, "en", "s", 1), (8, words(20, 1) + " a@b.cd", "en", "s", 1), (None, None, None, None, None)]
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")) for c in CLASHES})
    found = run(spark, docs, str(tmp_path))
    if stage == corpus_pipeline.STAGES[-1][0]:
        assert "doc_id" in found.columns
        assert found.count() >= len(rows)
        return
    assert found.columns == docs.columns
    left = found.collect()
    assert 0 < len(left) <= len(rows)
    for r in left:
        assert all(r[c] == (None if r.doc_id is None else f"{c} {r.doc_id}") for c in CLASHES)
    ids = {r.doc_id for r in left}
    gone = {"language": {None}, "near_duplicates": {6}, "benchmark_leaks": {7}, "personal_data": set()}[stage]
    assert {k for k, *_ in rows} - ids == gone
