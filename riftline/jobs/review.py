"""The review of changes from end to end: file versions and changed lines in, ordered findings and a rollup out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riftline.functions import text as T
from riftline.functions.rules import FILE_RULES, MESSAGES, RULES, TREE_RULES, Rule
from riftline.operators import enrich, findings, learnings, rollup, rulesets, trees
from riftline.operators.fixpoint import settled
from riftline.sources import scripts

COLUMNS = ("file_id", "rule_id", "rule_ord", "tier", "blocking", "title", "line", "col", "end_line", "end_col", "symbol", "message", "tier_adjusted", "fix", "code")
#: Callers from which on a caller-tiered rule rises.
MANY_CALLERS = 5


def _completed(found: DataFrame) -> DataFrame:
    """``found`` with all of ``COLUMNS``; what a finding does not speak of is null, and a message is its rule's."""
    told = F.create_map(*[F.lit(x) for rule, text in MESSAGES.items() for x in (rule, text)])
    missing = {
        "symbol": F.lit(None).cast("string"), "message": F.coalesce(F.try_element_at(told, F.col("rule_id")), F.lit("")), "tier_adjusted": F.lit(None).cast("string"), "fix": F.lit(None).cast(trees.FIX),
        "end_line": F.col("line"), "blocking": F.lit(False),
    }
    return found.withColumns({c: e for c, e in missing.items() if c not in found.columns}).select(*COLUMNS)


def found_in(files: DataFrame, changed: DataFrame, *, deprecated: DataFrame | None = None, previous: DataFrame | None = None, custom: Sequence[Rule] = ()) -> DataFrame:
    """All findings of all kinds of rules in the change, before settings, scope and verdicts, with ``COLUMNS``.

    Files are masked as wholes, then lines out of scope go, then the line rules run. Scripts give a node table, and the tree
    rules run on it; so do changed signatures against the ``previous`` texts (file_id, text). A script that does not
    parse has the line rules only.
    """
    named = files.withColumn("language", T.language(F.col("path")))
    every = settled(findings.masked_lines(named, "file_id", "text", "language"))
    lines = settled(findings.in_change(every, files, changed))
    parts = [findings.detect(lines, (*RULES, *custom))]
    whole = findings.file_findings(files, changed).join(every.select("file_id", "line", "raw"), ["file_id", "line"], "left")
    order = F.create_map(*[F.lit(x) for k, (rule, *_) in enumerate(FILE_RULES) for x in (rule, 100 + k)])
    parts.append(whole.select("file_id", "line", "rule_id", "tier", "title", order[F.col("rule_id")].alias("rule_ord"), F.lit(0).alias("col"), F.coalesce(F.length("raw"), F.lit(0)).alias("end_col"), F.coalesce(T.trim_white(F.col("raw")), F.lit("")).alias("code")))
    if deprecated is not None:
        called = findings.deprecated_lines(lines, deprecated)
        place, (tier, blocking, title) = TREE_RULES["deprecated-api"]
        told = trees.deprecation(F.col("replaced_by"), F.col("author"), F.col("pr"))
        parts.append(called.select("file_id", F.lit("deprecated-api").alias("rule_id"), F.lit(place).alias("rule_ord"), F.coalesce("own_tier", F.lit(tier)).alias("tier"), F.lit(blocking).alias("blocking"), F.lit(title).alias("title"), "line", "col", "end_col", told.alias("message"), "code"))
    nodes = settled(scripts.nodes(named, "file_id", "text", "language"))
    if nodes.take(1):
        grown = trees.detect(nodes, deprecated)
        if previous is not None:
            before = scripts.nodes(previous.join(named.select("file_id", "language"), "file_id"), "file_id", "text", "language")
            grown = grown.unionByName(trees.signature_drift(trees.exported_signatures(before), trees.exported_signatures(nodes)))
        parts.append(trees.with_code(trees.in_change(grown, files, changed), every))
    return reduce(DataFrame.unionByName, map(_completed, parts))


def review(
    files: DataFrame, changed: DataFrame, store: DataFrame | None = None, *, settings: DataFrame | None = None, deprecated: DataFrame | None = None, previous: DataFrame | None = None, custom: Sequence[Rule] = (),
    impact: DataFrame | None = None, verdicts: DataFrame | None = None, stale: DataFrame | None = None, many_callers: int = MANY_CALLERS,
) -> DataFrame:
    """``COLUMNS`` with trust and pos: findings in the change, in report order.

    files: file_id, path, text, diff_known, and project where settings are given. changed: file_id, line. store: verdicts
    (rule_id, code_hash, verdict) of reviewers. settings: as ``rulesets.layered`` returns them. deprecated: name,
    replaced_by, author, pr, tier. impact: symbol, caller_count, files, source. verdicts: file_id, rule_id, line,
    tainted, data_flow, source. stale: symbol.

    Settings come before test scope, test scope before first-wins, and all of them before verdicts; findings are
    settled once before that, so that no rule runs twice.
    """
    found = found_in(files, changed, deprecated=deprecated, previous=previous, custom=custom)
    if settings is not None:
        found = rulesets.configured(found.join(files.select("file_id", "project"), "file_id"), settings)
    found = settled(findings.first_wins(findings.test_scope(found, files)))
    if store is not None:
        found = learnings.suppress(found, store)
    if impact is not None:
        found = enrich.impact_tier(enrich.attach_impact(found, impact), many_callers)
    if stale is not None:
        found = enrich.stale_docs(found, stale)
    found = enrich.attach_taint(found, verdicts) if verdicts is not None else found.withColumn("tainted", F.lit(None).cast("boolean"))
    return findings.report_order(enrich.trust(found)).drop("code_hash", "rule_ord", "project")


def documents(found: DataFrame) -> DataFrame:
    """file_id, review: a JSON document a file, of its tier, whether it blocks, and its findings in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line", "col", "rule_id", "tier", "blocking"))), lambda x: x.dropFields("pos"))
    per_file = found.groupBy("file_id").agg(listed.alias("findings")).join(rollup.tiers(found, "file_id"), "file_id")
    return per_file.select("file_id", F.to_json(F.struct("tier", "blocking", "findings")).alias("review"))
