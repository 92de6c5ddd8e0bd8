"""Exported function signatures and their drift between versions, from declarations of one line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECLARATION = r"(?m)^\s*export\s+(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][A-Za-z0-9_$]*)\s*\(([^)]*)\)"


def parameters(text: Column) -> Column:
    """One word a parameter: x, x? (optional), x= (default), ...x (rest), {…} and […] (patterns)."""
    flat = F.regexp_replace(F.regexp_replace(text, r"\{[^}]*\}", "{…}"), r"\[[^\]]*\]", "[…]")
    words = F.filter(F.transform(F.split(flat, ","), lambda p: F.trim(p)), lambda p: p != "")

    def word(p: Column) -> Column:
        name = F.regexp_extract(p, r"^(\.\.\.)?([A-Za-z_$][A-Za-z0-9_$]*|\{…\}|\[…\])(\?)?", 0)
        return F.concat(F.when(name == "", "_").otherwise(name), F.when(p.rlike(r"[^=!<>]=[^=>]"), "=").otherwise(""))

    return F.array_join(F.transform(words, word), ",")


def exported(files: DataFrame, key: str, text: str) -> DataFrame:
    """file_id, name, params: the last declaration of each name wins."""
    found = files.select(F.col(key).alias("file_id"), F.posexplode(F.arrays_zip(F.regexp_extract_all(text, F.lit(DECLARATION), F.lit(1)).alias("name"), F.regexp_extract_all(text, F.lit(DECLARATION), F.lit(2)).alias("raw"))).alias("pos", "d"))
    return found.groupBy("file_id", F.col("d.name").alias("name")).agg(parameters(F.max_by("d.raw", "pos")).alias("params"))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """file_id, name, old_params, params: exported names whose parameters differ between versions."""
    old = before.withColumnRenamed("params", "old_params")
    return after.join(old, ["file_id", "name"]).where("params <> old_params").select("file_id", "name", "old_params", "params")
