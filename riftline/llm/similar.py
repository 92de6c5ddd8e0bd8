"""Near-duplicate documents: SimHash groups of the fuzzy keys, widened by MinHash bands, all verified.

Documents are compared as single lines: lower case (A-Z), one blank between words. At a Jaccard similarity of 0.8 two
SimHash fingerprints differ in about ten of 64 bits, which no number of keys finds at a bearable cost (README), so that
SimHash alone links copies with few changes only. Each document gets a MinHash signature in ``BANDS`` bands of ``ROWS``
rows besides; at a similarity of 0.8 all but 8 pairs in 10,000 meet in some band. All candidates are verified on the
texts, and groups are components of what is verified.

Defined cases: equal lines are one from the start; a null text is an empty one; texts of fewer words than a shingle
equal others or are alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riftline.llm.banding import SIMILARITY, clusters
from riftline.llm.common import lower_ascii, materialise, row_keyed

BANDS, ROWS = 10, 3


def line(text: Column) -> Column:
    return F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), r"[ \t\n\x0B\f\r]+", " "))


def contents(docs: DataFrame, text: str) -> DataFrame:
    """content, body: each document as one line, named by its hash; equal ones repeat."""
    bodies = docs.select(line(F.col(text)).alias("body"))
    return bodies.select(F.xxhash64("body").alias("content"), "body")


def group(docs: DataFrame, key: str, text: str, *, similarity: float = SIMILARITY, candidates: DataFrame | None = None) -> DataFrame:
    """_rk, content, root (equal in a group): one row for each row of ``docs``.

    candidates: pairs (a, b) of contents to verify besides those of the bands.
    """
    bodies = contents(docs, text)
    roots = clusters(bodies, BANDS, ROWS, similarity=similarity, more=candidates)
    rows = materialise(row_keyed(docs.select(key, text), key, text).select("_rk", F.xxhash64(line(F.col(text))).alias("content")))
    return rows.join(roots, "content", "left").select("_rk", "content", F.coalesce("root", "content").alias("root"))
