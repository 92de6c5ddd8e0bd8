"""Callers, taint verdicts, trust and autonomy of findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riftline.functions import text as T
from riftline.functions.rules import CALLER_TIERED, SECURITY


def impact_of(edges: DataFrame, cap: int = 20) -> DataFrame:
    """symbol, caller_count, files, callers (capped, in order): from (symbol, caller_file, caller_line) rows.

    The cap is of the list that is shown; counts are whole. Only the ``cap`` first rows of a symbol are gathered.
    """
    distinct = edges.select("symbol", "caller_file", "caller_line").distinct()
    counts = distinct.groupBy("symbol").agg(F.count(F.lit(1)).alias("caller_count"), F.count_distinct("caller_file").alias("files"))
    order = Window.partitionBy("symbol").orderBy("caller_file", "caller_line")
    first = distinct.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap)
    shown = first.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("caller_file", "caller_line"))).alias("callers"))
    return counts.join(shown, "symbol").withColumn("truncated", F.col("caller_count") > cap)


def top_reviewers(weights: DataFrame, most: int = 3) -> DataFrame:
    """symbol, reviewers: the heaviest different reviewers, by weight, then name."""
    total = weights.groupBy("symbol", "reviewer").agg(F.max("weight").alias("weight"))
    order = Window.partitionBy("symbol").orderBy(F.desc("weight"), "reviewer")
    first = total.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    return first.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "reviewer"))), lambda x: x["reviewer"]).alias("reviewers"))


def attach_impact(findings: DataFrame, impact: DataFrame) -> DataFrame:
    """Left join by symbol, the exact name before the bare one, the smallest stored symbol of several with it.

    impact: symbol, caller_count, files, source (of the counts).
    """
    parts = ("caller_count", "files", "source")
    exact = impact.select(F.col("symbol").alias("_e"), F.struct(*parts).alias("_exact"))
    bare = impact.groupBy(T.bare_symbol(F.col("symbol")).alias("_b")).agg(F.min_by(F.struct(*parts), "symbol").alias("_bare"))
    joined = findings.join(exact, F.col("symbol") == F.col("_e"), "left").join(bare, T.bare_symbol(F.col("symbol")) == F.col("_b"), "left")
    best = F.coalesce("_exact", "_bare")
    return joined.withColumns({"caller_count": best["caller_count"], "caller_files": best["files"], "impact_source": best["source"]}).drop("_e", "_b", "_exact", "_bare")


#: Fixed value: the one source whose word that nothing calls or taints a place may lower a tier.
AUTHORITY = "codegraph"


def impact_tier(findings: DataFrame, threshold: int, pinned: Sequence[str] = ()) -> DataFrame:
    """Tiers of caller-tiered rules that are not pinned: no caller by the code graph lowers, many callers by any source raise."""
    tierable = F.col("rule_id").isin(*CALLER_TIERED) & ~F.col("rule_id").isin(*pinned or [""]) & ~T.is_pinned(findings) & F.col("caller_count").isNotNull()
    low = tierable & (F.col("caller_count") == 0) & (F.col("impact_source") == AUTHORITY)
    high = tierable & (F.col("caller_count") >= threshold) & ~F.coalesce(low, F.lit(False))
    before = F.col("tier_adjusted") if "tier_adjusted" in findings.columns else F.lit(None).cast("string")
    return findings.withColumn("tier_adjusted", F.when(low, "deescalated").when(high, "escalated").otherwise(before)).withColumn("tier", F.when(low, "yellow").when(high, "orange").otherwise(F.col("tier")))


def stale_docs(findings: DataFrame, stale: DataFrame) -> DataFrame:
    """Add stale_doc: whether the symbol, whole or bare, is one whose documentation is out of date."""
    names = stale.where(F.coalesce("symbol", F.lit("")) != "").select(F.explode(F.array("symbol", T.bare_symbol(F.col("symbol")))).alias("_s")).distinct()
    marked = findings.join(names.withColumn("_whole", F.lit(True)), F.col("symbol") == F.col("_s"), "left").drop("_s")
    both = marked.join(names.withColumn("_bare", F.lit(True)), T.bare_symbol(F.col("symbol")) == F.col("_s"), "left").drop("_s")
    return both.withColumn("stale_doc", F.coalesce("_whole", "_bare", F.lit(False))).drop("_whole", "_bare")


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def blast_summary(count: Column, truncated: Column, files: Column, reviewers: Column) -> Column:
    calls = F.concat(F.lit("Blast radius: "), count.cast("string"), F.when(truncated, "+").otherwise(""), F.lit(" call site"), F.when(count == 1, "").otherwise("s"), F.when(files > 0, F.concat(F.lit(" across "), plural(files, "file"))).otherwise(""))
    route = F.when(F.size(reviewers) > 0, F.concat(F.lit("route: "), F.array_join(F.transform(F.slice(reviewers, 1, 3), lambda r: F.concat(F.lit("@"), r)), ", ")))
    return F.concat(F.concat_ws(" · ", calls, route), F.lit("."))


def attach_taint(findings: DataFrame, verdicts: DataFrame, *, lower: bool = False, pinned: Sequence[str] = ()) -> DataFrame:
    """Left join of taint verdicts on (file, rule, line) for security rules; trace of a tainted place.

    verdicts: file_id, rule_id, line, tainted, data_flow (array of names or null), source. A place that the code graph calls
    clean is lowered and stops blocking only where the caller opts in (``lower``) and the rule is not pinned.
    """
    marked = findings.join(verdicts.where(F.col("rule_id").isin(*SECURITY)), ["file_id", "rule_id", "line"], "left")
    clean = ~F.col("tainted") & (F.col("source") == AUTHORITY) & F.lit(lower) & ~F.col("rule_id").isin(*pinned or [""]) & ~T.is_pinned(findings)
    low = F.coalesce(clean, F.lit(False))
    hops = F.array_join(F.slice("data_flow", 1, 6), " → ")
    trace = F.when(F.col("tainted"), F.when(F.size("data_flow") > 0, F.concat(F.lit("Taint path: "), hops, F.lit("."))).otherwise("Taint path confirmed by the code graph."))
    before = F.col("tier_adjusted") if "tier_adjusted" in findings.columns else F.lit(None).cast("string")
    return marked.withColumns({"tier": F.when(low, "yellow").otherwise(F.col("tier")), "blocking": F.col("blocking") & ~low, "tier_adjusted": F.when(low, "deescalated").otherwise(before), "trace": trace}).drop("data_flow", "source")


def trust(findings: DataFrame) -> DataFrame:
    """confirmed, cleared or unconfirmed, by rule and taint verdict."""
    secure = F.when(F.col("tainted"), "confirmed").when(~F.col("tainted"), "cleared").otherwise("unconfirmed")
    return findings.withColumn("trust", F.when(F.col("rule_id") == "guideline", "unconfirmed").when(F.col("rule_id").isin(*SECURITY), secure).otherwise("confirmed"))


def rung(findings: DataFrame, floor: str = "orange") -> DataFrame:
    """The first that holds: block, escalate, autofix, advisory."""
    block = F.col("blocking") | (F.col("rule_id").isin(*SECURITY) & (F.col("trust") == "confirmed"))
    enough = T.tier_rank(F.col("tier")) >= T.TIERS.index(floor)
    return findings.withColumn("rung", F.when(block, "block").when(F.coalesce(F.col("tier_adjusted") == "escalated", F.lit(False)), "escalate").when(enough, "autofix").otherwise("advisory"))


def over_budget(findings: DataFrame, over: DataFrame) -> DataFrame:
    """Autofix and advisory become escalate where the fingerprint is over budget."""
    flagged = findings.join(over.select("fingerprint", F.lit(True).alias("_o")).distinct(), "fingerprint", "left").withColumn("over_budget", F.coalesce("_o", F.lit(False))).drop("_o")
    return flagged.withColumn("rung", F.when(F.col("over_budget") & F.col("rung").isin("autofix", "advisory"), "escalate").otherwise(F.col("rung")))
