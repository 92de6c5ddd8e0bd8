"""Quality of detection against labels, and trial experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riftline.functions.rules import ADVISORY, SECURITY
from riftline.functions.text import wilson


def confusion(found: DataFrame, expected: DataFrame) -> DataFrame:
    """case, rule_id, outcome (tp, fp, fn): full outer join of distinct found and expected rules of labelled cases."""
    f = found.select("case", "rule_id").distinct().withColumn("_f", F.lit(True))
    e = expected.select("case", "rule_id").distinct().withColumn("_e", F.lit(True))
    labelled = e.select("case").distinct()
    both = f.join(labelled, "case", "left_semi").join(e, ["case", "rule_id"], "full_outer")
    return both.select("case", "rule_id", F.when(F.col("_f") & F.col("_e"), "tp").when(F.col("_f"), "fp").otherwise("fn").alias("outcome"))


def precision_recall(outcomes: DataFrame) -> DataFrame:
    """For each rule and pooled (rule_id '*'): counts, precision, recall and F1, to three places."""
    n = {k: F.count_if(F.col("outcome") == k).alias(k) for k in ("tp", "fp", "fn")}
    counts = outcomes.rollup("rule_id").agg(*n.values()).withColumn("rule_id", F.coalesce("rule_id", F.lit("*")))
    share = lambda a, b: F.when(a + b == 0, 1.0).otherwise(a / F.greatest(a + b, F.lit(1)))
    scored = counts.withColumn("p", share(F.col("tp"), F.col("fp"))).withColumn("r", share(F.col("tp"), F.col("fn")))
    f1 = F.when(F.col("p") + F.col("r") == 0, 0.0).otherwise(2 * F.col("p") * F.col("r") / F.when(F.col("p") + F.col("r") == 0, 1.0).otherwise(F.col("p") + F.col("r")))
    return scored.select("rule_id", "tp", "fp", "fn", F.round("p", 3).alias("precision"), F.round("r", 3).alias("recall"), F.round(f1, 3).alias("f1"))


def clean_noise(found: DataFrame, cases: DataFrame, expected: DataFrame) -> DataFrame:
    """False blocks and advisories a clean case; cases without findings count."""
    clean = cases.select("case").distinct().join(expected.select("case").distinct(), "case", "left_anti")
    hard = (F.col("tier") == "orange") | F.col("blocking")
    per = clean.join(found, "case", "left").agg(F.count_distinct("case").alias("clean_cases"), F.count_if(hard).alias("blocks"), F.count_if(F.col("tier").isNotNull() & ~hard).alias("advisories"))
    rate = lambda c: F.round(F.when(F.col("clean_cases") == 0, 0.0).otherwise(F.col(c) / F.greatest(F.col("clean_cases"), F.lit(1))), 3)
    return per.select("clean_cases", "blocks", "advisories", rate("blocks").alias("blocks_per_case"), rate("advisories").alias("advisories_per_case"))


def rates(trials: DataFrame, by: str) -> DataFrame:
    """Defect and advisory rates over scored trials, with the Wilson interval of the defect rate."""
    scored = trials.where("kind <> 'error' AND NOT known_gap")
    n = scored.groupBy(by).agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.col("kind") == "defect").alias("defects"), F.count_if(F.col("kind") == "advisory").alias("advisories"))
    low, high = wilson(F.col("defects"), F.col("scored"))
    d = F.greatest(F.col("scored"), F.lit(1))
    return n.select(by, "scored", "defects", F.round(F.col("defects") / d, 3).alias("defect_rate"), F.round(F.col("advisories") / d, 3).alias("advisory_rate"), F.round(low, 3).alias("low"), F.round(high, 3).alias("high"))


def coverage(trials: DataFrame) -> DataFrame:
    """For each target rule: scenarios that aim at it, and those where some trial caught it; errors catch nothing."""
    aimed = trials.select("scenario", F.explode("target_rules").alias("rule_id")).distinct()
    caught = trials.where("kind <> 'error'").select("scenario", F.explode("fired_rules").alias("rule_id")).distinct().withColumn("_c", F.lit(True))
    return aimed.join(caught, ["scenario", "rule_id"], "left").groupBy("rule_id").agg(F.count(F.lit(1)).alias("targeting"), F.count_if(F.col("_c")).alias("caught"))


def classify_trials(trials: DataFrame, found: DataFrame) -> DataFrame:
    """trial, fired, kind: the distinct risk rules of findings that are orange or block, and what they make of the trial.

    trials: trial, target_rules, failed (no reply). Risk rules are the security rules and all targets of any trial. A
    rule that is not advisory makes a defect, advisory ones alone an advisory, none a clean trial.
    """
    targets = trials.select(F.explode("target_rules").alias("rule_id")).distinct()
    hard = found.where((F.col("tier") == "orange") | F.col("blocking")).select("trial", "rule_id").distinct()
    risky = hard.join(targets.withColumn("_t", F.lit(True)), "rule_id", "left").where(F.col("_t") | F.col("rule_id").isin(*SECURITY))
    fired = risky.groupBy("trial").agg(F.array_sort(F.collect_set("rule_id")).alias("fired"), F.bool_or(~F.col("rule_id").isin(*ADVISORY)).alias("_defect"))
    kind = F.when(F.col("failed"), "error").when(F.col("_defect"), "defect").when(F.col("_defect").isNotNull(), "advisory").otherwise("clean")
    return trials.join(fired, "trial", "left").select("trial", F.coalesce("fired", F.array().cast("array<string>")).alias("fired"), kind.alias("kind"))


def trial_totals(trials: DataFrame) -> DataFrame:
    """mode and what its trials come to: all, errors, scored, catches, defects, advisories, on target, clean gaps, and rates.

    trials: mode, known_gap, target_rules, fired_rules, kind. Trials with a known gap are scored nowhere but in
    ``gap_clean``, errors nowhere at all. A trial is on target if a rule that fired, other than an advisory one, is one of its targets.
    """
    done, scored = F.col("kind") != "error", (F.col("kind") != "error") & ~F.col("known_gap")
    hard = F.filter("fired_rules", lambda r: ~r.isin(*ADVISORY))
    counts = {
        "total": F.count(F.lit(1)), "errors": F.count_if(~done), "scored": F.count_if(scored), "catches": F.count_if(scored & (F.size("fired_rules") > 0)), "defects": F.count_if(scored & (F.col("kind") == "defect")),
        "advisories": F.count_if(scored & (F.col("kind") == "advisory")), "on_target": F.count_if(scored & F.arrays_overlap(hard, "target_rules")), "gap_clean": F.count_if(done & F.col("known_gap") & (F.col("kind") == "clean")),
    }
    found = trials.groupBy("mode").agg(*[c.alias(name) for name, c in counts.items()])
    rate = lambda c: F.round(F.col(c) / F.greatest("scored", F.lit(1)), 3)
    return found.withColumns({"defect_rate": rate("defects"), "advisory_rate": rate("advisories"), "on_target_rate": rate("on_target")})
