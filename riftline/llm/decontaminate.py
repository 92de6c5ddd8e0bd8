"""Benchmark decontamination with a distributed positional inverted index, in DataFrame functions only.

A window is ``window`` consecutive words of a benchmark item (a shorter item is one window). The terms of the
items are counted over the whole corpus, and each window is anchored at its ``anchors`` rarest places. The index
holds the postings (term, document, place) of the anchor terms. Shifting each posting by the place of its term
in a window gives the start that the window would have there; where the lists of all anchors of a window name
the same start, the window is a candidate, and the words at that start decide.

Defined cases: a null text has no words; an item without words has no window; equal items are each reported;
documents that share a key but not the text are kept apart; rows equal in both get equal results; an empty table
of documents gives an empty result, one of items gives no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riftline.llm.common import lower_ascii, materialise, row_keyed

WINDOW, ANCHORS = 10, 2
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(word: Column) -> Column:
    """A-Z in lower case; only a word with other than ASCII characters takes the slow way."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(lower_ascii(word))


def split_words(text: Column) -> Column:
    """Words as written; the first and the last may be empty, which shifts all places alike."""
    return F.split(F.coalesce(text, F.lit("")), SEPARATORS)


def count_words(words: Column) -> Column:
    n = F.size(words)
    return (n - F.when(words[0] == "", 1).otherwise(0) - F.when((n > 1) & (F.element_at(words, -1) == ""), 1).otherwise(0)).cast("long")


def postings(keyed: DataFrame, text: str) -> DataFrame:
    """The positional index before it is cut to some terms: _rk, place, term."""
    return keyed.select("_rk", F.posexplode(split_words(F.col(text))).alias("place", "word")).select("_rk", "place", lowered(F.col("word")).alias("term"))


def windows(items: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """item, first (place of the window in its item), words: one row a window."""
    words = F.filter(F.transform(split_words(F.col(text)), lowered), lambda w: w != "")
    return (
        items.select(F.col(item).cast("string").alias("item"), words.alias("all")).where(F.size("all") > 0)
        .select("item", "all", F.explode(F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)))).alias("first"))
        .select("item", "first", F.slice("all", F.col("first") + 1, window).alias("words"))
    )


def anchored(keyed: DataFrame, text: str, wins: DataFrame, anchors: int, by: tuple[str, ...] = ("win",)) -> DataFrame:
    """``by`` (which name a window), term, offset, mark (a bit each), need (all bits): the rarest places of each window by the corpus count of their term."""
    places = wins.select(*by, F.posexplode("words").alias("offset", "term"))
    vocabulary = places.select("term").distinct()
    counts = postings(keyed, text).join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    rarest = Window.partitionBy(*by).orderBy(F.coalesce("n", F.lit(0)), "term", "offset")
    return (
        places.join(counts, "term", "left").withColumn("rank", F.row_number().over(rarest)).where(F.col("rank") <= anchors)
        .select(*by, "term", "offset", F.expr("1L << (rank - 1)").alias("mark"), F.expr(f"(1L << count(1) OVER (PARTITION BY {', '.join(by)})) - 1").alias("need"))
    )


def candidates(keyed: DataFrame, text: str, anchors: DataFrame) -> DataFrame:
    """_rk, win, start: the intersection of the shifted posting lists of each window."""
    shifted = postings(keyed, text).join(anchors, "term").select("_rk", "win", (F.col("place") - F.col("offset")).alias("start"), "mark", "need")
    return shifted.groupBy("_rk", "win", "start").agg(F.bit_or("mark").alias("seen"), F.max("need").alias("need")).where("seen = need AND start >= 0").select("_rk", "win", "start")


def distinct_windows(items: DataFrame, item: str, text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(win, words), a row for each different run of words, and (win, item), the items that hold it."""
    wins = materialise(windows(items, item, text, window))
    named = materialise(wins.select("words").distinct().withColumn("win", F.monotonically_increasing_id()))
    return named, materialise(wins.join(named, "words").select("win", "item").distinct())


def phrase_matches(docs: DataFrame, items: DataFrame, *, key: str, text: str, item: str, item_text: str, window: int = WINDOW, anchors: int = ANCHORS) -> tuple[DataFrame, DataFrame]:
    """(_rk, hits), hits an array of (win, size, starts), for each document text in which a window occurs; and (win, item).

    Starts are gathered as numbers, a window's words once a document; a text is split once and its candidates are decided
    on that, so that a text that repeats one word costs no more than another of its length.
    """
    keyed = row_keyed(docs.select(key, text), key, text)
    wins, holders = distinct_windows(items, item, item_text, window)
    picked = materialise(anchored(keyed, text, wins, anchors))
    starts = candidates(keyed, text, picked).groupBy("_rk", "win").agg(F.collect_list("start").alias("starts"))
    found = materialise(starts.join(wins, "win").groupBy("_rk").agg(F.collect_list(F.struct("win", "words", "starts")).alias("found")))
    # a generator stands between the words and their use, else each candidate would split the text again
    words = F.explode(F.array(F.transform(split_words(F.col(text)), lowered)))
    holds = lambda of: F.filter(of["starts"], lambda s: F.slice(F.col("words"), s + 1, F.size(of["words"])) == of["words"])
    kept = F.transform("found", lambda of: F.struct(of["win"].alias("win"), F.size(of["words"]).alias("size"), holds(of).alias("starts")))
    hits = (
        keyed.join(found, "_rk").dropDuplicates(["_rk"]).select("_rk", "found", words.alias("words"))
        .select("_rk", F.filter(kept, lambda h: F.size(h["starts"]) > 0).alias("hits")).where(F.size("hits") > 0)
    )
    return materialise(hits), holders


def covered(hits: Column) -> Column:
    """Number of places that hits cover: their ranges in order, each counted from where the ones before end."""
    ranges = F.array_sort(F.flatten(F.transform(hits, lambda h: F.transform(h["starts"], lambda s: F.struct(s.alias("low"), (s + h["size"]).alias("high"))))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda s, r: F.struct((s["n"] + F.greatest(r["high"] - F.greatest(r["low"], s["end"]), F.lit(0))).alias("n"), F.greatest(s["end"], r["high"]).alias("end"))
    return F.aggregate(ranges, start, step, lambda s: s["n"])


def proximity_matches(docs: DataFrame, items: DataFrame, *, key: str, text: str, item: str, item_text: str, window: int = WINDOW, slop: int = 3) -> DataFrame:
    """_rk, item, first, start, gap: windows whose two rarest terms stand within ``slop`` words of their distance."""
    keyed = row_keyed(docs.select(key, text), key, text)
    picked = materialise(anchored(keyed, text, materialise(windows(items, item, item_text, window)), 2, ("item", "first")))
    at = materialise(postings(keyed, text).join(picked, "term").select("_rk", "item", "first", "offset", (F.col("place") - F.col("offset")).alias("start")))
    other = at.select("_rk", "item", "first", F.col("offset").alias("o"), F.col("start").alias("s"))
    near = at.join(other, ["_rk", "item", "first"]).where((F.col("offset") < F.col("o")) & (F.abs(F.col("start") - F.col("s")) <= slop))
    return near.groupBy("_rk", "item", "first", "start").agg(F.min(F.abs(F.col("start") - F.col("s"))).alias("gap"))


def score(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, anchors: int = ANCHORS) -> DataFrame:
    """_rk, n_words, n_hit, n_items, items (sorted as strings), contaminated: one row for each row of ``docs``."""
    hits, holders = phrase_matches(docs, items, key=key, text=text, item=item, item_text=item_text, window=window, anchors=anchors)
    named = hits.select("_rk", F.explode("hits.win").alias("win")).join(holders, "win").groupBy("_rk").agg(F.array_sort(F.collect_set("item")).alias("items"))
    per_doc = materialise(hits.select("_rk", covered(F.col("hits")).alias("n_hit")).join(named, "_rk"))
    counted = row_keyed(docs.select(key, text), key, text).select("_rk", count_words(split_words(F.col(text))).alias("n_words"))
    return counted.join(per_doc, "_rk", "left").select(
        "_rk", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return score(docs, items).select(F.col("_rk.k").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: Brute force: every run of words of every document against every window.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\x{80}-\x{10FFFF}]+'), lambda x: x <> '') AS w
  FROM documents
), i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\x{80}-\x{10FFFF}]+'), lambda x: x <> '') AS w
  FROM benchmark
), win AS (
  SELECT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM i WHERE len(w) > 0)
), g AS (
  SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (
  SELECT DISTINCT doc_id, item_id, s, n FROM g JOIN win USING (n, p)
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""
