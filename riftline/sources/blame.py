"""Who last changed a line: the output of a line-by-line history listing (porcelain form) as a table.

Each line of a file has a header (commit, line before, line now); what a commit says of itself stands once, behind the
first header of the commit, so that it is carried to the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A header, and the words before what a commit says of itself.
HEADER = r"^([0-9a-f]{7,64}) \d+ (\d+)(?: \d+)?\r?$"
SAYS = {"author": "author", "author_time": "author-time", "summary": "summary"}


def lines(listings: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, line, author, author_time, summary, hash (eight digits): a row for each header. Null texts have none."""
    raw = listings.select(F.col(key).alias("k"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "raw"))
    header = F.regexp_extract("raw", HEADER, 1)
    now = Window.partitionBy("k").orderBy("pos")
    marked = raw.withColumns({"commit": F.when(header != "", header), "line": F.when(header != "", F.regexp_extract("raw", HEADER, 2).cast("int"))})
    carried = marked.withColumn("of", F.last("commit", ignorenulls=True).over(now))
    said = carried.where(~F.col("raw").startswith("\t"))
    first = [F.min(F.when(F.col("raw").startswith(f"{word} "), F.struct("pos", F.substring("raw", len(word) + 2, 1 << 30).alias("v"))))["v"].alias(name) for name, word in SAYS.items()]
    known = said.groupBy("k", "of").agg(*first)
    heads = carried.where("commit IS NOT NULL").select("k", "line", "of")
    return heads.join(known, ["k", "of"]).select(F.col("k").alias(key), "line", *SAYS, F.when(F.length("of") <= 40, F.substring("of", 1, 8)).alias("hash"))


def attach(findings: DataFrame, blamed: DataFrame) -> DataFrame:
    """Findings with author, author_time, summary and hash of their line, null where it is not listed. blamed: with file_id."""
    return findings.join(blamed, ["file_id", "line"], "left")
