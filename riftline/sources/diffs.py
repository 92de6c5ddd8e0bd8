"""Unified diffs: changed lines of hunk headers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADER = r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,([0-9]+))? @@"


def hunk_lines(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """file_id, line: lines of the new side that the hunks mark.

    A header without a length means one line; a pure deletion (length 0) marks the line before it, or line 1.
    """
    rows = diffs.select(F.col(key).alias("file_id"), F.explode(F.split(F.col(text), "\n")).alias("row")).where(F.col("row").rlike(HEADER))
    start = F.regexp_extract("row", HEADER, 1).cast("int")
    given = F.regexp_extract("row", HEADER, 2)
    size = F.when(given == "", 1).otherwise(F.expr(f"try_cast(regexp_extract(row, r'{HEADER}', 2) AS int)"))
    return rows.select("file_id", start.alias("s"), size.alias("n")).select(
        "file_id", F.explode(F.when(F.col("n") == 0, F.array(F.greatest(F.col("s"), F.lit(1)))).otherwise(F.sequence("s", F.col("s") + F.col("n") - 1))).alias("line")
    ).distinct()
