"""Source trees as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riftline.functions.patterns import glob_to_regex

MOST_BYTES, SNIFF = 1 << 20, 1024


def scan_tree(spark: SparkSession, root: str, ignore: Sequence[str] = ()) -> DataFrame:
    """path, text of every text file below ``root``: no file over a megabyte, none with a zero byte at its head.

    The size limit reaches the listing, so that large files are never opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= MOST_BYTES)
    if ignore:
        rel = F.regexp_replace(F.col("path"), r"\A[a-z0-9]+:/*", "/")
        whole = "|".join(f"(?:{glob_to_regex('**/' + g)})" for g in ignore)
        files = files.where(~rel.rlike(whole))
    text = files.where(~F.hex(F.substring("content", 1, SNIFF)).rlike("^(?:[0-9A-F]{2})*00"))
    return text.select("path", F.decode("content", "UTF-8").alias("text"))
