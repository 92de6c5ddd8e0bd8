"""Guideline files that apply to a file: those of its folder and of all folders above."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riftline.functions import text as T


def ancestors(path: Column) -> Column:
    """Folders of a relative path, the nearest first, the root ('') last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def resolve(files: DataFrame, guides: DataFrame, depth: int = 4) -> DataFrame:
    """file_id, dir, name, pos, kept: guides (dir, name, name_ord) of each file, the nearest first.

    Of more than ``depth`` only the nearest ``depth - 1`` and the one nearest to the root are kept.
    """
    above = files.select("file_id", F.posexplode(ancestors(F.col("path"))).alias("up", "dir"))
    nearest = Window.partitionBy("file_id").orderBy("up", "name_ord")
    ranked = above.join(guides, "dir").withColumn("pos", F.row_number().over(nearest)).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("file_id")))
    kept = (F.col("of") <= depth) | (F.col("pos") <= max(1, depth - 1)) | (F.col("pos") == F.col("of"))
    return ranked.select("file_id", "dir", "name", "pos", kept.alias("kept"))


def groups(resolved: DataFrame) -> DataFrame:
    """sources, files: files that share the same kept guides."""
    per_file = resolved.where("kept").groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dir", "name"))), lambda g: F.concat_ws("/", F.when(g["dir"] != "", g["dir"]), g["name"])), " ").alias("sources"))
    return per_file.groupBy("sources").agg(F.count(F.lit(1)).alias("files"))


#: Headings of sections that hold rules, and of those that tell how to run things.
RELEVANT = r"(?i)(style|convention|rule|guideline|standard|security|naming|error|lint|test|do not|don't|avoid|must|never|always|forbidden|require)"
OPERATIONAL = r"(?i)(setup|install|getting started|build command|run|deploy|environment|prerequisite|quick ?start|architecture overview|overview)"
CUT = "\n…[truncated]"


def within_budget(guides: DataFrame, key: str, text: str, budget: int = 8000) -> DataFrame:
    """``key`` and ``text`` (trimmed) of each guide; of one longer than ``budget`` characters only the sections with rules, cut there.

    A section runs from a heading to the next; what stands before the first stays. If no section has rules, all stay. A
    null text stays null.
    """
    short = F.col(text).isNull() | (F.length(text) <= budget)
    rows = guides.where(~short).select(F.col(key).alias("k"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "raw"))
    heading = F.when(F.col("raw").rlike(rf"^#{{1,6}}[{T.WHITE}]"), F.regexp_replace("raw", rf"^#+[{T.WHITE}]*", ""))
    head = Window.partitionBy("k").orderBy("pos")
    rows = rows.withColumn("heading", heading).withColumn("section", F.count("heading").over(head))
    bodies = rows.groupBy("k", "section").agg(F.max("heading").alias("heading"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]), "\n").alias("body"))
    bodies = bodies.withColumn("kept", (F.col("section") == 0) | (F.coalesce("heading", F.lit("")) == "") | (F.col("heading").rlike(RELEVANT) & ~F.col("heading").rlike(OPERATIONAL)))
    joined = lambda flag: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(flag, F.struct("section", "body")))), lambda x: x["body"]), "\n")
    whole = bodies.groupBy("k").agg(F.count_if("kept").alias("n"), joined(F.col("kept")).alias("some"), joined(F.lit(True)).alias("all"))
    cut = T.trim_white(F.when(F.col("n") > 1, F.col("some")).otherwise(F.col("all")))
    long = whole.select(F.col("k").alias(key), F.when(F.length(cut) > budget, F.concat(F.substring(cut, 1, budget), F.lit(CUT))).otherwise(cut).alias(text))
    return guides.where(short).select(key, T.trim_white(F.col(text)).alias(text)).unionByName(long)
