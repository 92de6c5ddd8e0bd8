"""Reviewer verdicts: latest wins, store merges, suppression, signal.

A learning is (id, rule_id, code_hash, verdict, at, ingest_ord).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riftline.functions import text as T


def latest(learnings: DataFrame) -> DataFrame:
    """The newest verdict of each (rule, code); of equal times the later ingested."""
    newest = Window.partitionBy("rule_id", "code_hash").orderBy(F.desc_nulls_last("at"), F.desc("ingest_ord"))
    return learnings.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def merge(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Union by id; theirs only where it is the only one or strictly newer, both times given."""
    o, t = F.struct("ours.*"), F.struct("theirs.*")
    both = ours.alias("ours").join(theirs.alias("theirs"), F.col("ours.id") == F.col("theirs.id"), "full_outer")
    take = F.col("ours.id").isNull() | F.coalesce(F.col("theirs.at") > F.col("ours.at"), F.lit(False))
    return both.select(F.when(take, t).otherwise(o).alias("l")).select("l.*")


def shared_union(local: DataFrame, shared: DataFrame) -> DataFrame:
    """Union of two stores; for each id the local one wins."""
    both = local.withColumn("priority", F.lit(0)).unionByName(shared.withColumn("priority", F.lit(1)))
    first = Window.partitionBy("id").orderBy("priority", "ingest_ord")
    return both.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def suppress(findings: DataFrame, learnings: DataFrame) -> DataFrame:
    """Findings that no reviewer has dismissed; confirming never suppresses."""
    dismissed = learnings.where("verdict = 'dismiss'").select("rule_id", "code_hash").distinct()
    return findings.withColumn("code_hash", T.code_hash(F.col("code"))).join(dismissed, ["rule_id", "code_hash"], "left_anti")


def predicted_signal(findings: DataFrame, by: str) -> DataFrame:
    """Share of orange and yellow findings; 1 without findings."""
    total, high = F.count(F.lit(1)), F.count_if(F.col("tier") != "green")
    return findings.groupBy(by).agg(total.alias("total"), high.alias("signal"), F.when(total == 0, 1.0).otherwise(high / total).alias("ratio"))


def realized_signal(learnings: DataFrame, least: int = 3, rate: float = 0.7) -> DataFrame:
    """For each rule: confirmed, dismissed, dismiss rate, and whether it is chronic noise."""
    confirmed, dismissed = F.count_if(F.col("verdict") == "confirm"), F.count_if(F.col("verdict") == "dismiss")
    per_rule = learnings.groupBy("rule_id").agg(confirmed.alias("confirmed"), dismissed.alias("dismissed"))
    share = F.col("dismissed") / F.greatest(F.col("confirmed") + F.col("dismissed"), F.lit(1))
    return per_rule.withColumn("dismiss_rate", share).withColumn("chronic", (F.col("dismissed") >= least) & (F.col("dismiss_rate") >= rate))


def read_stores(stores: DataFrame, key: str, body: str) -> DataFrame:
    """``key`` and the learnings of each store, whose text is one JSON object; one that is broken or has no list of entries is empty."""
    entry = "id string, rule_id string, code_hash string, verdict string, at timestamp"
    parsed = stores.select(F.col(key), F.from_json(F.col(body), f"version int, entries array<struct<{entry.replace(' string', ': string').replace(' timestamp', ': timestamp')}>>").alias("s"))
    return parsed.select(key, F.posexplode("s.entries").alias("ingest_ord", "e")).where("e IS NOT NULL").select(key, "e.*", "ingest_ord")


def summary(learnings: DataFrame) -> DataFrame:
    """total, dismissed, confirmed, and the pooled signal: the confirmed share of both, 1 without any. One row, also for an empty store."""
    dismissed, confirmed = F.count_if(F.col("verdict") == "dismiss"), F.count_if(F.col("verdict") == "confirm")
    counts = learnings.agg(F.count(F.lit(1)).alias("total"), dismissed.alias("dismissed"), confirmed.alias("confirmed"))
    both = F.col("dismissed") + F.col("confirmed")
    return counts.withColumn("signal", F.when(both == 0, 1.0).otherwise(F.col("confirmed") / F.greatest(both, F.lit(1))))


def noisiest(learnings: DataFrame, most: int = 10) -> DataFrame:
    """rule_id, dismissed, pos: the ``most`` rules that are dismissed most often, ties by name."""
    counts = learnings.where("verdict = 'dismiss'").groupBy("rule_id").agg(F.count(F.lit(1)).alias("dismissed"))
    return counts.orderBy(F.desc("dismissed"), "rule_id").limit(most).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("dismissed"), "rule_id")))
