"""What configurations make of the rules: packs, layers, overrides, custom patterns, the catalog.

A setting is (project, layer, key, enabled, tier, blocking); ``key`` is a rule or a pack, and each of the last three is
null where the setting does not speak of it. Projects have settings of their own, so that findings of all projects are
settled in one join on (project, rule) instead of a rule set a project.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riftline.functions.patterns import to_java
from riftline.functions.rules import FILE_RULES, RULES, Pattern, Rule

#: Packs of rules.
PACKS = {
    "web-security": ("hardcoded-secret", "permissive-cors", "sql-injection", "nosql-injection", "path-traversal", "prototype-pollution", "xss-sink"),
    "compatibility": ("public-api-change", "signature-drift"),
    "hygiene": ("leftover-debugger", "debug-logging", "todo-marker"),
}


def catalog(spark: SparkSession, custom: Sequence[Rule] = ()) -> DataFrame:
    """rule_id, tier, title, blocking, pack, pos (by id, from 1): the first rule of each id, of lines, files and the configuration."""
    pack = {r: p for p, of in PACKS.items() for r in of}
    listed = [*((r.rule_id, r.tier, r.title, r.blocking) for r in RULES), *((i, t, title, False) for i, t, title in FILE_RULES), *((r.rule_id, r.tier, r.title, r.blocking) for r in custom)]
    first = {row[0]: row for row in reversed(listed)}
    rows = [(*first[i], pack.get(i), k + 1) for k, i in enumerate(sorted(first))]
    return spark.createDataFrame(rows, "rule_id string, tier string, title string, blocking boolean, pack string, pos int")


def with_hits(rules: DataFrame, findings: DataFrame) -> DataFrame:
    """The catalog with the number of findings of each rule, 0 without any."""
    hits = findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    return rules.join(hits, "rule_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def layered(settings: DataFrame) -> DataFrame:
    """One setting for each (project, key): that of the last layer, as a whole. Settings without a key or project are none."""
    last = F.max_by(F.struct("enabled", "tier", "blocking"), "layer").alias("s")
    return settings.where("key IS NOT NULL AND project IS NOT NULL").groupBy("project", "key").agg(last).select("project", "key", "s.*")


def configured(findings: DataFrame, settings: DataFrame) -> DataFrame:
    """Findings (with ``project``) of the rules that are left, with the tiers and gates that the project sets; ``pinned`` if it sets either.

    A rule goes if it is switched off, or if its pack is and the rule has no setting of its own. ``settings`` holds one
    for each (project, key), as ``layered`` returns them.
    """
    own = settings.select("project", F.col("key").alias("rule_id"), F.struct("enabled", "tier", "blocking").alias("_own"))
    packs = F.create_map(*[F.lit(x) for p, of in PACKS.items() for x in (p, ",".join(of))])
    off = settings.where("NOT enabled").select("project", F.explode(F.split(F.try_element_at(packs, F.col("key")), ",")).alias("rule_id"), F.lit(True).alias("_pack_off")).distinct()
    known = own.join(off, ["project", "rule_id"], "full_outer")
    enabled = F.coalesce(F.col("_own.enabled"), F.lit(True)) & (F.col("_own").isNotNull() | F.col("_pack_off").isNull())
    return (
        findings.join(known, ["project", "rule_id"], "left").where(enabled)
        .withColumn("tier", F.coalesce("_own.tier", "tier")).withColumn("blocking", F.coalesce("_own.blocking", "blocking"))
        .withColumn("pinned", F.col("_own.tier").isNotNull() | F.col("_own.blocking").isNotNull()).drop("_own", "_pack_off")
    )


def _pattern(spark: SparkSession, text: str, flags: str) -> Pattern:
    """``text`` as a pattern; as a literal in any case if it is none."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(to_java(text))
    except IllegalArgumentException:
        return Pattern(re.sub(r"[.*+?^${}()|\[\]\\]", r"\\\g<0>", text), True)
    return Pattern(text, "i" in flags)


def custom_rules(spark: SparkSession, settings: Sequence[Mapping]) -> list[Rule]:
    """Rules of a configuration: ``pattern`` or ``patterns``, and optionally id, flags, tier, blocking, title, languages.

    One without a pattern is none, but counts in the numbers of those without an id.
    """
    found = []
    for k, c in enumerate(settings):
        texts = c.get("patterns") or ([c["pattern"]] if c.get("pattern") else [])
        if texts:
            patterns = tuple(_pattern(spark, t, c.get("flags") or "i") for t in texts)
            found.append(Rule(c.get("id") or f"custom-{k + 1}", c.get("tier") or "yellow", c.get("title") or "Custom rule", patterns, bool(c.get("blocking")), tuple(c.get("languages") or ("*",))))
    return found


def high_impact(spark: SparkSession, patterns: Sequence[str]) -> list[Rule]:
    """The one rule of a plain list of patterns."""
    return [Rule("configured-high-impact", "orange", "Configured high-impact pattern", tuple(_pattern(spark, t, "i") for t in patterns))] if patterns else []
