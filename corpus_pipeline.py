"""The training-corpus pipeline: language, near-duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written and read again as the next one's
``docs``. All but the last keep the columns of ``documents``; their decisions are in the rows and texts.

Defined cases for every stage: columns beside those of ``documents`` pass through unread whatever they are called (the
last stage drops them); rows with a null id are documents like others; an empty table stays empty. A null text is
dropped by the first stage; later ones take it as an empty text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riftline.llm import decontaminate, langid, packing, pii, simhash, similar
from riftline.llm.common import if_few, materialise, read_table, row_keyed, sweep
from riftline.llm.shingles import SHINGLE

#: A text in none of the learned languages costs more than this share of its letters one by one, and some bits besides,
#: since a short text holds few phrases. Documents of sf0.1 cost 0.56 (median) to 0.83 (999 in 1,000); random letters 0.99.
MOST_SHARE, SPARE_BITS = 0.9, 64

OWN = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _sheltered(stage: Stage) -> Stage:
    """``stage`` on documents whose other columns have names that no operator uses; they get theirs back at the end.

    What earlier stages left with the executors goes first.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark)
        return stage(spark, docs.toDF(*[c if c in OWN else f"__other_{k}" for k, c in enumerate(docs.columns)]), sf_dir).toDF(*docs.columns)

    return run


@_sheltered
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters or in none of the languages of the labelled ones; all stay if none is labelled."""
    model = langid.fit(docs, "doc_id", "text", "lang")
    if not model.langs:
        return docs
    names = ("_lang_pred", "_lang_score", "_lang_bits")
    found = langid.identify(docs, "text", model, names=names)
    letters = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\P{L}+", ""))
    known = F.col(names[2]) * letters < MOST_SHARE * model.literal() * letters + SPARE_BITS
    return found.where((F.col(names[0]) != langid.UNKNOWN) & known).select(*docs.columns)


@_sheltered
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group whose shingles of five words have a similarity of 0.8 or more.

    Pairs come from SimHash's fuzzy keys and from MinHash bands, and all are verified on the texts. The row with the
    smallest id, then hash of the text, stays; rows without an id come last. A row is told by both, so an id with two
    texts stands for two documents. Only rows that repeat both are compared as wholes.
    """
    pairs = simhash.candidates(similar.contents(docs, "text"), "content", "body", shingle=SHINGLE)
    sweep(spark)
    found = materialise(similar.group(docs, "doc_id", "text", candidates=pairs))
    sweep(spark)
    place = F.struct(F.col("_rk.k").isNull().alias("last"), "_rk")
    names = materialise(found.groupBy("root").agg(F.min(place)["_rk"].alias("keeper")))
    rows = materialise(found.join(names, "root").groupBy("_rk").agg(F.first(F.col("_rk") != F.col("keeper")).alias("leaves"), F.count(F.lit(1)).alias("n")).where("leaves OR n > 1"))
    keyed = row_keyed(docs, "doc_id", "text")
    once = keyed.join(if_few(rows.select("_rk")), "_rk", "left_anti").select(*docs.columns)
    repeated = keyed.join(if_few(materialise(rows.where("NOT leaves").select("_rk"))), "_rk", "left_semi").dropDuplicates(["_rk"])
    return once.unionByName(repeated.select(*docs.columns))


@_sheltered
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a window of a benchmark item occurs; without items all stay."""
    hits, _ = decontaminate.phrase_matches(docs, read_table(spark, sf_dir, "benchmark"), key="doc_id", text="text", item="item_id", item_text="text")
    return row_keyed(docs, "doc_id", "text").join(if_few(materialise(hits.select("_rk"))), "_rk", "left_anti").select(*docs.columns)


@_sheltered
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by its kind in brackets and set n_chars anew; a null text keeps its n_chars."""
    cut = pii.redact(docs, "doc_id", "text")
    return cut.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into token sequences; a row for each piece, as ``packing.query`` returns them."""
    sweep(spark)
    return packing.query(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("personal_data", personal_data), ("packing", sequences)]

#: Hashes of shingles, cross-parsing and tokenisation are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs)
    return docs
