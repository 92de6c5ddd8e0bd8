"""Similar texts by MinHash banding: candidates of the same band, an exact sketch filter, verified Jaccard, components.

Texts that merely share a passage collide in great numbers without being similar. Each text therefore has an odd
sketch: the parity, in 256 bits, of its set of shingles. The sketches of two sets differ in at most as many bits as the
sets in elements, and at a similarity of 0.8 these are at most a ninth of both sizes together: a join condition that
loses no similar pair. Jaccard similarity is verified on the texts of what passes, which Spark reads again for just
these.

In each bucket every text is compared with a few pivots first, the least in several orders; components of the verified
links are found. Texts outside a bucket's commonest component are then looked up among those in it, by their sets of
64-bit shingle hashes within a semi-join that leaves a row a text, and join it where one is similar; so again with the
components that result. What is left, between small components, is joined and verified pair by pair.

Defined cases: equal texts have equal names and are one; a text without words has no bands and is similar to none; an
empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riftline.llm.common import forget, if_few, materialise
from riftline.llm.components import components
from riftline.llm.shingles import LOWER, SHINGLE, SKETCH, banded, shingle_sets, signed

SIMILARITY = 0.8
#: A pivot of a bucket is its least content after such a word is added bit by bit.
ORDERS = (0, 0x5555555555555555, 0x3333333333333333)
#: Times that texts are looked up in the commonest component, at most; the join after that is exact in any case. A lookup
#: that finds less than one in ``HITS`` of the rows it looks up is the last: no more than a few pairs are left to the join.
ROUNDS, HITS = 4, 100


def jaccard(a: Column, b: Column) -> Column:
    """Of the word shingles of two texts."""

    @F.pandas_udf("double")
    def of(left: pd.Series, right: pd.Series) -> pd.Series:
        def shingles(line: str) -> set[tuple]:
            w = line.encode().translate(LOWER).split()
            return {tuple(w[k : k + SHINGLE]) for k in range(max(1, len(w) - SHINGLE + 1))}

        return pd.Series([len(x & y) / len(x | y) for x, y in zip(map(shingles, left), map(shingles, right), strict=True)], dtype="float64")

    return of(a, b)


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of contents that are similar enough, by their texts."""
    pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    # Few pairs meet their first texts where these are; else all texts would be shuffled once more.
    few = if_few(pairs)
    left = few.join(texts, few["a"] == texts["content"]).select("a", "b", F.col("body").alias("left"))
    both = left.join(texts.select(F.col("content").alias("b"), F.col("body").alias("right")), "b")
    found = materialise(both.where(jaccard(F.col("left"), F.col("right")) >= similarity).select("a", "b"))
    forget(pairs)
    return found


def _may_be_similar(x: Column, m: Column, y: Column, n: Column, similarity: float) -> Column:
    """Whether two sketches of sets of these sizes leave room for the similarity."""
    apart = sum((F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(1, SKETCH)), F.bit_count(x[0].bitwiseXOR(y[0])))
    return apart <= F.floor((m + n) * ((1 - similarity) / (1 + similarity)) + 1e-9)


def clusters(bodies: DataFrame, bands: int, rows: int, *, similarity: float = SIMILARITY, more: DataFrame | None = None) -> DataFrame:
    """content, root: for each content that is similar to another, the least content that it reaches.

    bodies: (content, body), a content once or more often. more: further candidate pairs (a, b).
    """
    sign = lambda df: df.mapInArrow(signed(bands, rows), "content long, bands array<bigint>, size int")
    # The aggregation and the join read one shuffle.
    by_band = bodies.mapInArrow(banded(bands, rows), "content long, bands array<bigint>").select("content", F.explode("bands").alias("band")).repartition("band")
    least = [F.min(F.col("content").bitwiseXOR(F.lit(order))).bitwiseXOR(F.lit(order)) for order in ORDERS]
    buckets = by_band.groupBy("band").agg(F.min("content").alias("low"), F.max("content").alias("high"), F.array(*least).alias("pivots")).where("low != high").drop("low", "high")
    shared = materialise(by_band.join(buckets, "band").select("band", "content", F.array_distinct(F.filter("pivots", lambda p: p != F.col("content"))).alias("pivots")).distinct())
    met = shared.select("content")
    if more is not None:
        more = materialise(more.select("a", "b").distinct())
        met = met.unionByName(more.select(F.explode(F.array("a", "b")).alias("content")))
    met = materialise(met.distinct())
    texts = materialise(bodies.join(if_few(met), "content", "left_semi").groupBy("content").agg(F.min("body").alias("body")))
    sketch = materialise(sign(texts).select("content", F.slice("bands", bands + 1, SKETCH).alias("x"), F.col("size").alias("m")))
    forget(met)
    named = lambda name: sketch.select(F.col("content").alias(name), F.col("x").alias("y"), F.col("m").alias("n"))
    close = _may_be_similar(F.col("x"), F.col("m"), F.col("y"), F.col("n"), similarity)
    stars = shared.select("content", F.explode("pivots").alias("pivot")).distinct()
    if more is not None:
        stars = stars.unionByName(more.select(F.col("a").alias("content"), F.col("b").alias("pivot")))
    star = stars.join(sketch, "content").join(named("pivot"), "pivot").where(close).select(F.col("content").alias("a"), F.col("pivot").alias("b"))
    first = components(_verified(star, texts, similarity), "a", "b").withColumnsRenamed({"node": "content", "component": "root"})
    # In a bucket of two a pivot has met the other; in larger ones, contents beside the commonest root meet all.
    wide = materialise(shared.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 2").select("band"))
    many = materialise(shared.join(wide, "band", "left_semi").select("band", "content"))
    forget(shared, wide)
    sets = materialise(texts.join(many.select("content").distinct(), "content", "left_semi").select("content", "body").mapInArrow(shingle_sets, "content long, s array<bigint>").join(sketch, "content"))
    both = F.size(F.array_intersect("s", "t"))
    alike = close & (both >= (F.size("s") + F.size("t") - both) * similarity)
    renamed = {"content": "other", "root": "other_root", "x": "y", "m": "n", "s": "t"}
    edges = first.select(F.col("content").alias("a"), F.col("root").alias("b"))
    open_, few = _open(many.join(first, "content", "left").select("band", "content", F.coalesce("root", "content").alias("root")))
    for _ in range(ROUNDS):
        near = open_.where("root = common").join(sets, "content").select("band", "x", "m", "s")
        hits = materialise(few.join(sets, "content").withColumnsRenamed(renamed).join(near, (few["band"] == near["band"]) & alike, "left_semi").select("other", F.col("other_root").alias("a"), F.col("common").alias("b")).distinct())
        n = hits.count()
        if not n:
            break
        last = n * HITS < few.count()
        # Only roots have to meet; bands of one root have no rows here and stay so.
        met = components(hits, "a", "b")
        edges = edges.unionByName(met.select(F.col("node").alias("a"), F.col("component").alias("b")))
        rooted = open_.join(met, open_["root"] == met["node"], "left").select("band", "content", F.coalesce("component", "root").alias("root"))
        before, (open_, few) = open_, _open(rooted)
        forget(hits, before)
        if last:
            break
    # Both of the few meet twice; the smaller content looks.
    once = (F.col("root") == F.col("common")) | (F.col("content") < F.col("other"))
    rest = few.drop("common").join(sets, "content").withColumnsRenamed(renamed).join(open_.join(sets, "content"), "band").where((F.col("root") != F.col("other_root")) & once & alike).select(F.col("content").alias("a"), F.col("other").alias("b"))
    found = components(edges.unionByName(_verified(rest, texts, similarity)), "a", "b").withColumnsRenamed({"node": "content", "component": "root"})
    forget(texts, sketch, many, sets, open_)
    return found


def _open(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """band, content, root, common (the commonest root of the band) of bands with several roots, of rows (band, content,
    root); and those of other roots."""
    rooted = materialise(rows)
    common = rooted.groupBy("band", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("band").agg(F.max_by("root", F.struct("c", "root")).alias("common"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("band", "common")
    named = materialise(common)
    open_ = materialise(rooted.join(named, "band"))
    forget(rooted, named)
    return open_, open_.where("root != common")
