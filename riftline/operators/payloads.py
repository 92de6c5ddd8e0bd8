"""Payloads of code-graph tools (impact, tests, edit contexts, taint, whole changes): JSON whose keys have several names.

A payload that is no JSON object gives nulls and empty lists; the first name with a value other than null counts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of each key, in the order in which they are tried, and of the objects that may hold them.
NESTED = ("impact", "blast_radius", "blastRadius", "result", "data")
CALLERS = ("callers", "direct_callers", "affected_callers", "affectedCallers", "callsites", "references")
COUNT = ("caller_count", "callerCount", "direct_caller_count", "directCallerCount", "impacted_count")
REVIEWERS = ("suggested_reviewers", "suggestedReviewers", "reviewers", "owners", "codeowners")
REVIEWER = ("author", "name", "login", "reviewer", "owner", "handle")
WEIGHT = ("lines_owned", "linesOwned", "weight", "ownership", "score")
FILE = ("file", "uri", "path", "location", "filepath")
SYMBOL = ("symbol", "name", "function", "caller", "qualified_name", "qualifiedName")
GAPS = ("test_gaps", "testGaps", "untested", "missing_tests", "missingTests", "uncovered")
REACHABLE = ("reachable", "is_reachable", "isReachable", "entrypoint_reachable", "reachable_from_entrypoint")
COMPLEXITY = ("complexity", "cyclomatic", "cyclomatic_complexity", "cyclomaticComplexity")
STALE = ("stale_doc", "staleDoc", "doc_stale", "docStale", "stale_docs")
LINE = ("line", "lineno", "row", "start_line", "startLine")
TESTS = ("tests", "related_tests", "relatedTests", "covering_tests", "coveringTests", "results")
CALLSITES = ("callers", "direct_callers", "references", "callsites")
HISTORY = ("history", "recent_changes", "recentChanges", "commits", "blame")
WHO, WHAT = ("author", "name", "login"), ("message", "subject", "summary", "commit", "sha", "date")
TAINTED = ("tainted", "is_tainted", "vulnerable", "is_vulnerable", "exploitable", "reachable")
FLOW = ("data_flow", "dataFlow", "taint_path", "taintPath", "path", "flow", "trace", "findings", "vulnerabilities")
CLEAN = ("clean", "safe", "no_taint", "noTaint")
DETECTOR = ("detector", "tool", "rule", "check")
CHANGES = ("changed_functions", "changedFunctions", "changes", "symbols", "functions", "results", "items")
NAMED = ("symbol", "name", "function", "qualified_name", "qualifiedName", "id")
DOCS = ("stale_docs", "staleDocs", "stale_documentation", "doc_warnings", "docWarnings")
NOTE = ("note", "message", "reason", "warning")
COMMIT = ("commit_hint", "commitHint", "commit_message", "suggested_commit", "commit_subject")
CAP = 20

_READ = {"allowUnquotedControlChars": "true", "allowNonNumericNumbers": "false", "columnNameOfCorruptRecord": "_broken"}


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """An expression that uses a value several times, for which the value is made once."""
    return F.get(F.transform(F.array(value), of), 0)


def _fields(doc: Column, names: Sequence[str]) -> Column:
    """Fields of a JSON object as JSON or text, all found in one reading; for ``_first``."""
    return F.from_json(doc, ", ".join(f"`{n}` string" for n in dict.fromkeys((*names, "_broken"))), _READ)


def _kinds(doc: Column, names: Sequence[str]) -> Column:
    """Fields of a JSON object as variants, which tell true from "true"."""
    return F.from_json(doc, ", ".join(f"`{n}` variant" for n in names), _READ)


def _first(fields: Column, names: Sequence[str]) -> Column:
    """The first of the fields that is there; JSON that breaks off has none, not those before."""
    return F.when(fields["_broken"].isNull(), F.coalesce(*[fields[n] for n in names]))


def pick(doc: Column, names: Sequence[str]) -> Column:
    return _once(_fields(doc, names), lambda d: _first(d, names))


def _number(kinds: Column, names: Sequence[str]) -> Column:
    """The first of the fields that is a whole JSON number; text that looks like one is none."""
    return F.coalesce(*[F.when(F.schema_of_variant(kinds[n]) == "BIGINT", F.try_variant_get(kinds[n], "$", "int")) for n in names])


def items(value: Column) -> Column:
    """Elements of a JSON array as JSON or text, or of a string that commas or line breaks separate."""
    split = lambda v: F.filter(F.transform(F.split(v, "[,\n]"), lambda x: F.trim(x)), lambda x: x != "")
    return _once(value, lambda v: F.coalesce(F.when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(split(v)), F.array().cast("array<string>")))


def _field(item: Column, names: Sequence[str]) -> Column:
    """A field of an object; of plain text, the text itself."""
    return F.when(item.startswith("{"), pick(item, names)).otherwise(F.trim(item))


def _said(kinds: Column, names: Sequence[str]) -> Column:
    first = F.coalesce(*[F.when(~F.is_variant_null(kinds[n]), kinds[n]) for n in names])
    return F.when(F.schema_of_variant(first) == "BOOLEAN", F.try_variant_get(first, "$", "boolean"))


def flag(doc: Column, names: Sequence[str]) -> Column:
    """The first of the fields, if it is a JSON boolean; text or a number there is no answer."""
    sound = F.when(_fields(doc, ())["_broken"].isNull(), doc)
    return _once(_kinds(sound, names), lambda d: _said(d, names))


def refs(value: Column) -> Column:
    """Elements of a list as (file, line, symbol); those with neither a file nor a symbol are left out."""
    text = lambda r: F.when(~r.startswith("{"), F.nullif(F.trim(r), F.lit("")))
    line = lambda d: F.when(_first(d, LINE).rlike("^[0-9]+$"), _first(d, LINE).try_cast("int"))
    told = lambda d, r: F.struct(F.regexp_replace(_first(d, FILE), "^file://", "").alias("file"), line(d).alias("line"), F.coalesce(_first(d, SYMBOL), text(r)).alias("symbol"))
    made = F.transform(items(value), lambda r: _once(_fields(F.when(r.startswith("{"), r), (*FILE, *LINE, *SYMBOL)), lambda d: told(d, r)))
    return F.filter(made, lambda r: r["file"].isNotNull() | r["symbol"].isNotNull())


def shown(listed: Column) -> Column:
    """References as text: symbol@file:line, of what is known."""
    place = lambda r: F.concat(F.lit("@"), r["file"], F.coalesce(F.concat(F.lit(":"), r["line"].cast("string")), F.lit("")))
    return F.array_join(F.transform(listed, lambda r: F.concat(F.coalesce(r["symbol"], F.lit("")), F.coalesce(place(r), F.lit("")))), " ")


def _tests(doc: Column) -> Column:
    """Tests that a payload names: the payload itself if it is a list."""
    return F.slice(refs(F.when(doc.startswith("["), doc).otherwise(pick(doc, TESTS))), 1, CAP)


def tests(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """key, tests (capped references): none is an answer as well, that of an untested symbol."""
    return payloads.select(key, _tests(F.trim(F.col(payload))).alias("tests"))


def edit_context(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """key, callers, tests, history (who and what of each change), all capped."""
    doc = F.col(payload)
    entry = lambda h: F.when(h.startswith("{"), F.concat_ws(" — ", pick(h, WHO), pick(h, WHAT))).otherwise(F.trim(h))
    history = F.filter(F.transform(items(pick(doc, HISTORY)), entry), lambda h: h != "")
    return payloads.select(key, F.slice(refs(pick(doc, CALLSITES)), 1, CAP).alias("callers"), _tests(F.coalesce(pick(doc, ("tests", "related_tests", "covering_tests")), doc)).alias("tests"), F.slice(history, 1, CAP).alias("history"))


def taint(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """key, tainted (null if the graph is silent), flow (capped references), detector.

    A traced path without a flag means tainted, an explicit all-clear without any path means clean.
    """
    doc = F.col(payload)
    traced = payloads.select(key, flag(doc, TAINTED).alias("said"), refs(pick(doc, FLOW)).alias("all"), (F.size(items(pick(doc, FLOW))) == 0).alias("none"), flag(doc, CLEAN).alias("clean"), pick(doc, DETECTOR).alias("detector"))
    implied = F.when(F.size("all") > 0, True).when(F.col("none") & F.col("clean"), False)
    return traced.select(key, F.coalesce("said", implied).alias("tainted"), F.slice("all", 1, CAP).alias("flow"), "detector")


def _notes(doc: Column) -> dict[str, Column]:
    place = ("file", "path", "uri")
    one = lambda d, r: F.struct(_first(d, NAMED).alias("symbol"), F.regexp_replace(_first(d, place), "^file://", "").alias("file"), F.when(r.startswith("{"), _first(d, NOTE)).otherwise(F.trim(r)).alias("note"))
    stale = F.transform(items(_first(doc, DOCS)), lambda r: _once(_fields(F.when(r.startswith("{"), r), (*NAMED, *place, *NOTE)), lambda d: one(d, r)))
    told = F.filter(stale, lambda d: F.coalesce(d["symbol"], d["file"], d["note"]).isNotNull())
    return {"stale": F.slice(told, 1, CAP), "commit_hint": _first(doc, COMMIT)}


def change_notes(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """key, stale (capped; symbol, file and note of documents out of date), commit_hint: of a whole change."""
    read = payloads.select(key, _fields(F.col(payload), (*DOCS, *COMMIT)).alias("doc"))
    return read.select(key, *[c.alias(n) for n, c in _notes(F.col("doc")).items()])


def changes(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """key, symbol, and the columns of ``impact`` and ``change_notes``: a row for each symbol of a whole change, which is one payload; of equal names the last counts."""
    read = payloads.select(key, _fields(F.col(payload), (*CHANGES, *DOCS, *COMMIT)).alias("doc"))
    objects = F.filter(items(_first(F.col("doc"), CHANGES)), lambda e: e.startswith("{"))
    named = F.transform(objects, lambda e, k: F.struct(pick(e, NAMED).alias("symbol"), k.alias("pos"), e.alias("entry")))
    every = read.select(F.struct(key, *_notes(F.col("doc"))).alias("_of"), F.array_sort(F.filter(named, lambda x: x["symbol"].isNotNull())).alias("all"))
    last = F.filter("all", lambda x, k: ~x["symbol"].eqNullSafe(F.get("all", k + 1)["symbol"]))
    each = every.select("_of", F.explode(last).alias("x")).select(F.struct("_of", "x.symbol").alias("_of"), "x.entry")
    return impact(each, "_of", "entry").select(f"_of._of.{key}", "_of.symbol", "*", "_of._of.stale", "_of._of.commit_hint").drop("_of")


def _notes(doc: Column) -> list[Column]:
    place = ("file", "path", "uri")
    note = lambda d, r: F.when(r.startswith("{"), _first(d, NOTE)).otherwise(F.trim(r))
    one = lambda d, r: F.struct(_first(d, NAMED).alias("symbol"), F.regexp_replace(_first(d, place), "^file://", "").alias("file"), note(d, r).alias("note"))
    stale = F.transform(items(_first(doc, DOCS)), lambda r: _once(_fields(F.when(r.startswith("{"), r), (*NAMED, *place, *NOTE)), lambda d: one(d, r)))
    told = F.filter(stale, lambda d: F.coalesce(d["symbol"], d["file"], d["note"]).isNotNull())
    return [F.slice(told, 1, CAP).alias("stale"), _first(doc, COMMIT).alias("commit_hint")]


def change_notes(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """key, stale (capped; symbol, file and note of documents out of date), commit_hint: of a whole change."""
    return payloads.select(key, _fields(F.col(payload), (*DOCS, *COMMIT)).alias("doc")).select(key, *_notes(F.col("doc")))


def impact(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """key, caller_count, callers (symbols or files, capped), truncated, reviewers (by weight, then as listed; each once),
    test_gaps (capped references), reachable, complexity, stale_doc (null where the payload is silent).
    """
    listed, kinds = (*CALLERS, *REVIEWERS, *GAPS, *COMPLEXITY), (*COUNT, *REACHABLE, *STALE)
    read = payloads.select(F.col(key), F.col(payload).alias("doc"), _fields(F.col(payload), (*NESTED, *listed)).alias("top"))
    inner = _first(F.col("top"), NESTED)
    read = read.select(key, "top", _kinds(F.when(F.col("top._broken").isNull(), F.col("doc")), kinds).alias("top_kinds"), _fields(inner, listed).alias("nested"), _kinds(inner, kinds).alias("nested_kinds"))
    either = lambda names: F.coalesce(_first(F.col("top"), names), _first(F.col("nested"), names))
    told = lambda of, names: F.coalesce(of(F.col("top_kinds"), names), of(F.col("nested_kinds"), names))
    callers = F.filter(F.transform(items(either(CALLERS)), lambda c: F.coalesce(_field(c, SYMBOL), F.regexp_replace(_field(c, FILE), "^file://", ""))), lambda c: c.isNotNull() & (c != ""))
    weight = lambda r: F.when(r.startswith("{"), F.coalesce(pick(r, WEIGHT).try_cast("double"), F.lit(0.0))).otherwise(0.0)
    ranked = F.transform(items(either(REVIEWERS)), lambda r, k: F.struct((-weight(r)).alias("w"), k.alias("k"), _field(r, REVIEWER).alias("name")))
    names = F.array_distinct(F.transform(F.array_sort(F.filter(ranked, lambda r: r["name"].isNotNull() & (r["name"] != ""))), lambda r: r["name"]))
    size = lambda of: F.when(_first(of, COMPLEXITY).rlike(r"^-?[0-9]+(\.[0-9]+)?$"), _first(of, COMPLEXITY).try_cast("double"))
    said = {"reachable": told(_said, REACHABLE), "complexity": F.coalesce(size(F.col("top")), size(F.col("nested"))), "stale_doc": told(_said, STALE)}
    return read.select(key, callers.alias("all"), told(_number, COUNT).alias("given"), names.alias("reviewers"), refs(either(GAPS)).alias("gaps"), *[c.alias(n) for n, c in said.items()]).select(
        key, F.coalesce("given", F.size("all")).alias("caller_count"), F.slice("all", 1, CAP).alias("callers"), ((F.size("all") > CAP) | (F.size("gaps") > CAP)).alias("truncated"), "reviewers", F.slice("gaps", 1, CAP).alias("test_gaps"), *said
    )
