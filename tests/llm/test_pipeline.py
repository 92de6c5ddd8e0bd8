"""The stages on a small corpus with planted cases; clean documents stay."""

import random
from itertools import combinations

from pyspark.sql import functions as F

import corpus_pipeline
from riftline.llm import packing
from tests.llm.test_contracts import DOCS, SF, words


def test_stages_take_effect(spark, tmp_path):
    leak = words(40, 50)
    clean = [(k, words(80, 200 + k), "en", "s", 1) for k in range(20)]
    planted = [
        (100, None, "en", "s", 0), (101, "123 !!", "en", "s", 7), (102, clean[3][1], "en", "s", 1), (103, words(30, 60) + " " + leak[20:180] + " " + words(30, 61), "en", "s", 1),
        (104, words(40, 62) + " a@b.cd " + words(40, 63), "en", "s", 1), (5, clean[5][1], "en", "s", 1), (None, words(70, 64), None, None, None),
    ]
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(clean + planted, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert docs.columns == DOCS.names
    kept = [r.doc_id for r in docs.collect()]
    assert sorted(x for x in kept if x is not None) == [*range(20), 104]
    assert None in kept
    changed = docs.where("doc_id = 104").first()
    assert "[EMAIL]" in changed.text
    assert changed.n_chars == len(changed.text)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.agg(F.sum("length")).first()[0] == packing.query(docs).agg(F.sum("length")).first()[0]


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_near_duplicates_have_a_similarity_of_four_fifths(spark):
    """Pairs with one to six changed words: those at 0.8 or more lose one of them, the others none."""
    r, rows = random.Random(3), []
    for k in range(60):
        w = words(120, 900 + k).split()
        other = list(w)
        for at in r.sample(range(len(w)), 1 + k % 6):
            other[at] = f"changed{at}"
        rows += [(2 * k, " ".join(w), "en", "s", 1), (2 * k + 1, "\n".join(other).replace("ka", "KA"), "en", "s", 1)]
    alike = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) >= 0.8
    close = {y[0] for x, y in combinations(rows, 2) if alike(x[1], y[1])}
    assert 10 < len(close) < 50
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted({x[0] for x in rows} - close)


def test_near_duplicates_tell_rows_by_id_and_text(spark):
    one, two, three, four = (words(80, 700 + k) for k in range(4))
    texts = [(1, one), (2, one), (2, two), (3, two + " x"), (3, three), (None, four), (None, four), (None, four + " x"), (None, "unique " + words(50, 710)), (4, three + " x")]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], DOCS), "").collect()
    found = [(r.doc_id, r.text) for r in kept]
    assert sorted(f for f in found if f[0] is not None) == sorted([(1, one), (2, two), (3, three)])
    assert len([f for f in found if f[0] is None]) == 2
    assert texts[8] in found


def test_language_stage(spark):
    """Gibberish and unseen scripts go, short texts stay, columns that clash with results stay, no label keeps all."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL").withColumns({"score": F.lit(77.0), "lang_pred": F.lit("x"), "bits": F.lit("b")})
    r = random.Random(1)
    odd = [(9001, "".join(r.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(600))), (9002, "\u041f\u0440\u0438\u0432\u0435\u0442 " * 9), (9003, "Re.")]
    more = spark.createDataFrame([(k, t, None, "s", len(t), 77.0, "x", "b") for k, t in odd], docs.schema)
    kept = corpus_pipeline.language(spark, docs.unionByName(more), SF)
    assert kept.columns == docs.columns
    assert kept.select("score", "lang_pred", "bits").distinct().collect() == [(77.0, "x", "b")]
    ids = {x.doc_id for x in kept.collect()}
    assert ids & {9001, 9002, 9003} == {9003}
    assert kept.count() >= docs.count()
    unlabelled = more.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, unlabelled, SF).count() == 3


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
