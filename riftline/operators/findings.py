"""From lines to findings: detection, diff scope, file rules, first-wins, test scope.

Tables: files (file_id, path, diff_known), lines (file_id, line, raw, scan, language), changed (file_id, line).
``scan`` is the line without comments. A file without diff information (``diff_known`` false) is in scope as a
whole; one with diff information and no changed line is out of scope as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riftline.functions import text as T
from riftline.functions.patterns import to_java
from riftline.functions.rules import FILE_RULES, RULES, TEST_EXEMPT, WORDS, Rule
from riftline.operators import perfile


def explode_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """file_id, line (from 1), raw: every line, with a trailing empty one and carriage returns kept."""
    return docs.select(F.col(key).alias("file_id"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "raw")).select("file_id", (F.col("pos") + 1).alias("line"), "raw")


def in_change(lines: DataFrame, files: DataFrame, changed: DataFrame) -> DataFrame:
    """Lines in scope of their file's diff."""
    marked = changed.select("file_id", "line", F.lit(True).alias("_hit")).distinct()
    scoped = lines.join(files.select("file_id", "diff_known"), "file_id").join(marked, ["file_id", "line"], "left")
    return scoped.where(~F.col("diff_known") | F.col("_hit")).drop("_hit", "diff_known")


def masked_lines(files: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """file_id, line (from 1), raw, scan, language: the lines of whole files, their comments masked with the file's state.

    Comments and strings that run over several lines are known only from the file, so it is masked as one text first.
    """
    both = files.select(F.col(key).alias("file_id"), F.col(language).alias("language"), F.split(F.col(text), "\n", -1).alias("raws"), F.split(perfile.mask(F.col(text), F.col(language)), "\n", -1).alias("scans"))
    rows = both.select("file_id", "language", F.posexplode(F.arrays_zip(F.col("raws").alias("raw"), F.col("scans").alias("scan"))).alias("pos", "l"))
    return rows.select("file_id", (F.col("pos") + 1).alias("line"), "l.raw", "l.scan", "language")


def _match(rule: Rule) -> Column:
    """The first accepted pattern's match as struct(match, col), or null; lines without a word of the rule are not tried."""
    text, low = F.col("raw" if rule.raw else "scan"), F.col("_low_raw" if rule.raw else "_low_scan")
    tries = []
    for p in rule.patterns:
        java = to_java(p.text, p.ignore_case)
        found = F.regexp_extract(text, java, 0)
        accepted = (found != "") & T.is_secret(found) if rule.secret else found != ""
        tries.append(F.when(accepted, F.struct(found.alias("match"), (F.regexp_instr(text, F.lit(java)) - 1).alias("col"))))
    applies = reduce(or_, (low.contains(w) for w in WORDS[rule.rule_id])) if rule in RULES and rule.rule_id in WORDS else F.lit(True)
    if "*" not in rule.languages:
        applies = F.col("language").isin(*rule.languages) & applies
    if rule.skip_if_ast:
        applies = ~F.col("language").isin("javascript", "typescript") & applies
    return F.when(applies, F.coalesce(*tries))


def detect(lines: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One finding for each rule and line, in one pass without a shuffle: the rules are unrolled, not joined."""
    hits = F.array(*[
        F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(k).alias("rule_ord"), F.lit(r.tier).alias("tier"), F.lit(r.blocking).alias("blocking"), F.lit(r.title).alias("title"), _match(r).alias("m"))
        for k, r in enumerate(rules)
    ])
    lowered = lines.withColumns({"_low_raw": F.lower("raw"), "_low_scan": F.lower("scan")})
    found = lowered.withColumn("_h", F.explode(F.filter(hits, lambda h: h["m"].isNotNull())))
    return found.select(
        "file_id", "line", "_h.rule_id", "_h.rule_ord", "_h.tier", "_h.blocking", "_h.title", F.col("_h.m.col").alias("col"),
        (F.col("_h.m.col") + F.length("_h.m.match")).alias("end_col"), T.trim_white(F.col("raw")).alias("code"),
    )


def file_findings(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings on whole files, at their first changed line (or line 1 without diff information)."""
    first = changed.groupBy("file_id").agg(F.min("line").alias("first"))
    scoped = files.join(first, "file_id", "left").where(~F.col("diff_known") | F.col("first").isNotNull())
    line = F.when(F.col("diff_known"), F.col("first")).otherwise(1)
    tests = (T.is_migration(F.col("path")), T.is_manifest(F.col("path")))
    rows = F.array(*[F.when(t, F.struct(F.lit(i).alias("rule_id"), F.lit(tier).alias("tier"), F.lit(title).alias("title"))) for t, (i, tier, title) in zip(tests, FILE_RULES, strict=True)])
    return scoped.select("file_id", line.alias("line"), F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("file_id", "line", "r.rule_id", "r.tier", "r.title")


def first_wins(findings: DataFrame) -> DataFrame:
    """One finding for each (file, rule, line, column): the first in rule order."""
    order = Window.partitionBy("file_id", "rule_id", "line", "col").orderBy("rule_ord", "end_col")
    return findings.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def report_order(findings: DataFrame) -> DataFrame:
    """Within a file by line, then the higher tier, then the rule; ``pos`` counts from 1."""
    order = Window.partitionBy("file_id").orderBy("line", F.desc(T.tier_rank(F.col("tier"))), "rule_id", "col")
    return findings.withColumn("pos", F.row_number().over(order))


def test_scope(findings: DataFrame, files: DataFrame, pinned: Sequence[str] = ()) -> DataFrame:
    """In tests, orange becomes yellow and stops blocking, but for exempt and pinned rules; no row is lost.

    Rules are pinned for all files by ``pinned``, and for one finding by its column ``pinned``, if there is one.
    """
    tests = files.select("file_id", T.is_test_path(F.col("path")).alias("_test"))
    lower = F.col("_test") & (F.col("tier") == "orange") & ~F.col("rule_id").isin(*TEST_EXEMPT, *pinned) & ~T.is_pinned(findings)
    return (
        findings.join(tests, "file_id").withColumn("_low", lower)
        .withColumn("tier_adjusted", F.when(F.col("_low"), "deescalated").otherwise(F.col("tier_adjusted") if "tier_adjusted" in findings.columns else None))
        .withColumn("tier", F.when(F.col("_low"), "yellow").otherwise(F.col("tier")))
        .withColumn("blocking", F.col("blocking") & ~F.col("_low")).drop("_low", "_test")
    )


def deprecated_lines(lines: DataFrame, deprecated: DataFrame) -> DataFrame:
    """file_id, line, col, end_col, name, replaced_by, author, pr, own_tier, code: lines of languages without a tree that call a deprecated name.

    A call of ``a.b.c`` is one of ``b.c`` and of ``c``, too. Of several names in a line the first in the alphabet counts.
    """
    names = deprecated.select(F.trim(F.regexp_replace("name", r"\([\s\S]*$", "")).alias("name"), "replaced_by", "author", "pr", F.col("tier").alias("own_tier"))
    calls = F.regexp_extract_all("scan", F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*)\s*\("), F.lit(1))
    parts = F.split("call", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    others = lines.where(~F.col("language").isin("javascript", "typescript"))
    called = others.select("file_id", "line", "raw", "scan", F.explode(F.array_distinct(calls)).alias("call")).select("file_id", "line", "raw", "scan", F.explode(tails).alias("name"))
    first = Window.partitionBy("file_id", "line").orderBy("name")
    found = called.join(names, "name").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    java = F.concat(F.lit(to_java(r"\b")), F.regexp_replace("name", r"([.$])", r"\\$1"), F.lit(to_java(r"\s*\(")))
    col = F.regexp_instr("scan", java) - 1
    length = F.length("name") + F.instr(F.expr("substring(scan, _at + length(name))"), "(")
    found = found.withColumn("_at", col + 1).withColumns({"col": F.col("_at") - 1, "end_col": F.col("_at") - 1 + length, "code": T.trim_white(F.col("raw"))})
    return found.drop("_n", "_at", "raw", "scan")


def deprecated_calls(lines: DataFrame, deprecated: DataFrame) -> DataFrame:
    """file_id, line, name, replaced_by: call sites of deprecated names, by an equi-join on the callee."""
    calls = lines.select("file_id", "line", F.explode(F.array_distinct(F.regexp_extract_all("scan", F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*)\s*\("), F.lit(1)))).alias("name"))
    return calls.join(deprecated, "name")


def references(lines: DataFrame, symbol: str, cap: int = 40, width: int = 200) -> DataFrame:
    """The first ``cap`` lines, by file and line, that hold the whole word, cut to ``width`` characters."""
    quoted = "".join(c if c.isalnum() or c == "_" else "\\" + c for c in symbol)
    found = lines.where(F.col("raw").contains(symbol) & F.col("raw").rlike(to_java(rf"\b{quoted}\b")))
    return found.orderBy("file_id", "line").limit(cap).select("file_id", "line", F.substring(T.trim_white(F.col("raw")), 1, width).alias("text"))


def snippets(lines: DataFrame, changed: DataFrame, radius: int = 1, cap: int = 50) -> DataFrame:
    """file_id, snippet: changed lines and their neighbours, with a mark where lines are left out."""
    near = changed.select("file_id", F.explode(F.sequence(F.col("line") - radius, F.col("line") + radius)).alias("line")).distinct()
    by_line = Window.partitionBy("file_id").orderBy("line")
    kept = lines.join(near, ["file_id", "line"]).withColumn("n", F.row_number().over(by_line)).where(F.col("n") <= cap)
    marked = kept.withColumn("gap", F.col("line") - F.lag("line").over(by_line) > 1).withColumn("part", F.concat(F.when(F.col("gap"), "...\n").otherwise(""), F.col("raw")))
    return marked.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "part"))), lambda x: x["part"]), "\n").alias("snippet"))


def code_around(findings: DataFrame, lines: DataFrame, radius: int = 4) -> DataFrame:
    """file_id, line, around: the lines from ``radius`` before to ``radius`` after each finding's line, within the file."""
    near = findings.select("file_id", "line").distinct().select("file_id", "line", F.explode(F.sequence(F.col("line") - radius, F.col("line") + radius)).alias("at"))
    rows = near.join(lines.select("file_id", F.col("line").alias("at"), "raw"), ["file_id", "at"])
    return rows.groupBy("file_id", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "raw"))), lambda x: x["raw"]), "\n").alias("around"))


def open_first(opened: DataFrame, stored: DataFrame) -> DataFrame:
    """Results (file_id, n) by file: those of an opened document before stored ones; files whose result is empty leave."""
    both = opened.select("file_id", F.col("n").alias("_o")).join(stored.select("file_id", F.col("n").alias("_s")), "file_id", "full_outer")
    return both.select("file_id", F.coalesce("_o", "_s").alias("n"), F.when(F.col("_o").isNotNull(), "opened").otherwise("stored").alias("origin")).where("n > 0")


def left_the_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that were in the change and are no longer."""
    return before.select("file_id").distinct().join(after.select("file_id").distinct(), "file_id", "left_anti")
