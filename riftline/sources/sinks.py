"""Findings as documents for other tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riftline.functions.text import escape_annotation


def annotations(findings: DataFrame) -> DataFrame:
    """One workflow command a finding."""
    level = F.when(F.col("tier") == "orange", "error").when(F.col("tier") == "yellow", "warning").otherwise("notice")
    line = F.concat(F.lit("::"), level, F.lit(" file="), escape_annotation(F.col("path")), F.lit(",line="), F.col("line").cast("string"), F.lit(",title="), escape_annotation(F.col("title")), F.lit("::"), escape_annotation(F.col("rule_id")))
    return findings.select("file_id", "line", "rule_id", line.alias("command"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """One result a finding, as JSON of the interchange format; columns count from 1."""
    level = F.when(F.col("tier") == "orange", "error").when(F.col("tier") == "yellow", "warning").otherwise("note")
    region = F.struct(F.col("line").alias("startLine"), (F.col("col") + 1).alias("startColumn"), F.col("line").alias("endLine"), (F.col("end_col") + 1).alias("endColumn"))
    where = F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    body = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("title").alias("text")).alias("message"), where.alias("locations"))
    return findings.select("file_id", "line", "rule_id", "col", F.to_json(body).alias("result"))


def rule_titles(findings: DataFrame) -> DataFrame:
    """The first title of each rule."""
    return findings.groupBy("rule_id").agg(F.min_by("title", "rule_ord").alias("title"))


#: Version and schema of the interchange format.
SARIF_VERSION, SARIF_SCHEMA = "2.1.0", "https://schemastore.azurewebsites.net/schemas/json/sarif-2.1.0-rtm.5.json"


def sarif_documents(findings: DataFrame, by: str, version: str = "0.0.0") -> DataFrame:
    """``by`` and document: a whole interchange document for each value of ``by`` (a project, a change), rules in order of their first finding.

    findings: ``by``, path, pos (report order in a file), and the columns of a review; symbol, caller_count, caller_files,
    tainted and trace become properties where they are known. A document holds the findings of one review.
    """
    level = F.when(F.col("tier") == "orange", "error").when(F.col("tier") == "yellow", "warning").otherwise("note")
    region = F.struct(F.col("line").alias("startLine"), (F.col("col") + 1).alias("startColumn"), F.coalesce("end_line", "line").alias("endLine"), (F.coalesce("end_col", "col") + 1).alias("endColumn"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    names = {"symbol": "symbol", "caller_count": "callerCount", "caller_files": "callerFiles", "tainted": "tainted", "trace": "trace"}
    known = [(c, name) for c, name in names.items() if c in findings.columns]
    told = [F.when(F.coalesce(*[F.col(c).cast("string") for c, _ in known]).isNotNull(), F.struct(*[F.col(c).alias(name) for c, name in known])).alias("properties")] if known else []
    result = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), *told)
    rows = findings.select(F.col(by).alias("by"), "rule_id", "title", F.struct("path", "pos").alias("at"), result.alias("result"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(c).alias("v")))), lambda x: x["v"])
    first = rows.groupBy("by", "rule_id").agg(F.min("at").alias("at"), F.min_by("title", "at").alias("title"))
    rule = F.struct(F.col("rule_id").alias("id"), F.struct(F.col("title").alias("text")).alias("shortDescription"))
    rules = first.withColumn("rule", rule).groupBy("by").agg(listed("rule").alias("rules"))
    run = F.struct(F.struct(F.struct(F.lit("riftline").alias("name"), F.lit(version).alias("version"), "rules").alias("driver")).alias("tool"), F.col("results"))
    whole = rows.groupBy("by").agg(listed("result").alias("results")).join(rules, "by")
    body = F.struct(F.lit(SARIF_SCHEMA).alias("$schema"), F.lit(SARIF_VERSION).alias("version"), F.array(run).alias("runs"))
    return whole.select(F.col("by").alias(by), F.to_json(body).alias("document"))
