"""The memo of words: the same ids whatever it holds, and work that follows a round's words, not the memo."""

import random
import re
import time
from array import array
from types import SimpleNamespace

import pandas as pd
import public_tokenizers
from pyspark.sql import functions as F

from riftline.llm import common, langid, packing


class Watched(dict):
    """A memo that counts how often its keys are walked over."""

    walks = 0

    def keys(self):
        Watched.walks += 1
        return super().keys()


def test_a_round_does_not_walk_over_the_memo():
    tokenizer = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.memo = Watched()
    Watched.walks = 0
    list(tokenizer.encode(["some words, and more", "words again! \u00e9t\u00e9"]))
    assert Watched.walks == 0


def test_ids_of_all_letters_that_the_memo_takes():
    tokenizer = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(4)
    letters = [chr(c) for c in [*range(0x21, 0x7F), *range(0xA1, 0x250)]]
    texts = [" ".join("".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(60)) for _ in range(60)] + ["".join(letters), " ".join(letters), *letters]
    texts = [t for t in texts if "<|" not in t]
    assert not any(tokenizer.UNUSUAL.search(t) for t in texts)
    wanted = [array("I", tokenizer.whole.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    assert list(tokenizer.encode(texts)) == wanted


def test_language_lets_go_of_what_a_worker_held(spark, monkeypatch):
    """Telling languages after packing: the worker's memo is gone before the tables of the languages are there."""
    docs = spark.createDataFrame([(k, f"some words number {k} and a few more", "en") for k in range(9)], "doc_id long, text string, lang string").coalesce(1)
    model = langid.fit(docs, "doc_id", "text", "lang")
    inner = []
    monkeypatch.setattr(langid.F, "pandas_udf", lambda kind: lambda f: inner.append(f) or (lambda c: F.struct(*(F.lit(None).alias(x) for x in "abc"))))
    langid.identify(docs, "text", model)
    packing.worker_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert len(common._HELD) == 1
    kept = []
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: SimpleNamespace(release_unused=lambda: kept.append(len(common._HELD))))
    assert [len(x) for x in inner[0](iter([pd.Series(["some words"])]))] == [1]
    assert kept == [0, 0]  # before the batch and after it, when the memo is gone


def test_what_a_worker_holds_is_one_thing_at_a_time():
    common.let_go()
    first = packing.worker_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert packing.worker_tokenizer(public_tokenizers.path("word_bpe_49k.json")) is first
    assert common.held(("other",), list) == []
    assert len(common._HELD) == 1
    assert packing.worker_tokenizer(public_tokenizers.path("word_bpe_49k.json")) is not first
    common.let_go()


def test_a_batch_is_taken_in_parts_and_in_order(spark):
    n = 2 * common.TEXTS + 3
    texts = [None if k % 7 == 3 else f"text {k} " * (k % 5) for k in range(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    tokenizer = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    wanted = {k: len(tokenizer.whole.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in enumerate(texts)}
    found = packing.tokenise(docs, "doc_id", "text", tokenizer_path=public_tokenizers.path("word_bpe_49k.json")).collect()
    assert {r.doc_id: r.length for r in found} == wanted


def test_broadcasts_of_queries_that_are_over_leave_memory(spark):
    def used():
        most, left = map(int, re.search(r"\((\d+),(\d+)\)", spark.sparkContext._jsc.sc().getExecutorMemoryStatus().toString()).groups())
        return most - left

    common.sweep(spark)
    time.sleep(2)
    before = used()
    for k in range(8):
        few = F.broadcast(spark.range(200_000).withColumn("x", F.col("id") + k))
        assert spark.range(10).join(few, "id").select(F.max("x")).first()[0] == 9 + k
    del few
    full = used() - before
    common.sweep(spark)
    for _ in range(20):
        if used() - before <= full / 2:
            break
        time.sleep(0.5)
    assert used() - before <= full / 2, (before, full, used())
    assert full > 8_000_000
