"""Rollups of findings: tiers, gates, hotspots, evidence, reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riftline.functions import text as T
from riftline.functions.rules import CONTROLS



def tiers(findings: DataFrame, by: str) -> DataFrame:
    """Counts of each tier, the overall tier and whether anything blocks."""
    rank = T.tier_rank(F.col("tier"))
    return findings.groupBy(by).agg(
        *[F.count_if(F.col("tier") == t).alias(t) for t in T.TIERS], T.tier_name(F.coalesce(F.max(rank), F.lit(0))).alias("tier"), F.coalesce(F.bool_or("blocking"), F.lit(False)).alias("blocking")
    )


def gate(findings: DataFrame, by: str, fail_on: str = "orange") -> DataFrame:
    """Whether anything blocks or reaches the tier; the event and conclusion of a review."""
    tripped = F.bool_or(F.col("blocking") | (T.tier_rank(F.col("tier")) >= T.TIERS.index(fail_on)))
    gated = findings.groupBy(by).agg(F.count(F.lit(1)).alias("findings"), F.coalesce(tripped, F.lit(False)).alias("blocked"))
    return gated.withColumn("event", F.when(F.col("blocked"), "REQUEST_CHANGES").otherwise("COMMENT")).withColumn("conclusion", F.when(F.col("blocked"), "failure").otherwise("success"))


def verdicts(findings: DataFrame, by: str) -> DataFrame:
    """Verdicts of the three modes, from the rungs."""
    block, review = F.bool_or(F.col("rung") == "block"), F.bool_or(F.col("rung").isin("escalate", "autofix"))
    orange = F.count_if(F.col("tier") == "orange")
    return findings.groupBy(by).agg(
        F.when(block, "blocked").when(review, "review").otherwise("pass").alias("advisory"),
        F.when(block | (orange > 0), "blocked").otherwise("pass").alias("gated"), F.lit("pass").alias("off"),
    )


def top_rules(findings: DataFrame, most: int = 10) -> DataFrame:
    return findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule_id").limit(most)


def hotspots(findings: DataFrame, most: int = 10) -> DataFrame:
    """Files with the most orange findings, then the most, then the smallest id."""
    per_file = findings.groupBy("file_id").agg(F.count_if(F.col("tier") == "orange").alias("orange"), F.count(F.lit(1)).alias("total"))
    return per_file.orderBy(F.desc("orange"), F.desc("total"), "file_id").limit(most)


def controls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, c) for r, cs in CONTROLS.items() for c in cs], "rule_id string, control_id string")


def evidence(findings: DataFrame, bridge: DataFrame) -> DataFrame:
    """Rules and findings that give evidence for each control; counts first, so that the join is of rules."""
    per_rule = findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    return per_rule.join(bridge, "rule_id").groupBy("control_id").agg(F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"), F.sum("n").alias("findings"))


def unmapped(findings: DataFrame, bridge: DataFrame) -> DataFrame:
    return findings.select("rule_id").distinct().join(bridge, "rule_id", "left_anti")


def comments(findings: DataFrame, by: str, most: int = 50) -> DataFrame:
    """The ``most`` gravest findings of each review, and how many more there are."""
    order = Window.partitionBy(by).orderBy(F.desc(T.tier_rank(F.col("tier"))), "file_id", "line", "rule_id")
    all_of = Window.partitionBy(by)
    return findings.withColumn("pos", F.row_number().over(order)).withColumn("omitted", F.greatest(F.count(F.lit(1)).over(all_of) - most, F.lit(0))).where(F.col("pos") <= most)


def tier_cube(findings: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts for every prefix of ``by`` (an extension of ours)."""
    return findings.rollup(*by).agg(F.count(F.lit(1)).alias("n"))
