"""Rules on the syntax of script files, as joins on their node table (``sources.scripts``).

What a name stands for is its last binding anywhere in the file. Whether a text is static, comes from a request, goes
through a sanitizer or is guarded is a relation on (file, name) that grows along bindings until nothing changes; a
binding that leads back to itself is never static. A node holds the nodes between its number and ``last``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riftline.functions import text as T
from riftline.functions.patterns import to_java
from riftline.functions.rules import MESSAGES, TREE_RULES
from riftline.operators.fixpoint import reach, resolved, settled

#: What the tree rules look for in names and texts.
REQUEST = to_java(r"\b(req|request|ctx|context)\.(query|body|params|headers|cookies|signedCookies)\b", True)
SQL_WORD = to_java(r"\b(SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|CREATE)\b", True)
QUERY_CALL = to_java(r"\b(query|execute|exec|raw|\$queryRaw)\b", True)
FILE_CALL = to_java(r"\b(fs|fs\/promises)\.(readFile|readFileSync|createReadStream|writeFile|writeFileSync|createWriteStream|open|openSync|rm|rmSync|unlink|unlinkSync)\b")
PATH_CALL = to_java(r"\bpath\.(join|resolve|normalize)\b")
SANITIZER = to_java(r"(?:^|\.)(?:sanitize|sanitizeHtml|escapeHtml|encodeURIComponent|encodeURI|escape|encode)$", True)
KEYS_CALL = to_java(r"^Object\.(keys|entries|getOwnPropertyNames)$")
LITERALS = ("StringLiteral", "NumericLiteral", "BooleanLiteral", "NullLiteral")
FUNCTIONS = ("FunctionDeclaration", "FunctionExpression", "ArrowFunctionExpression")
EXPORTS = ("ExportNamedDeclaration", "ExportDefaultDeclaration", "ExportAllDeclaration")
GUARD_KEYS = ("__proto__", "constructor", "prototype")

_PLACE = ("line", "col", "end_line", "end_col")


def _kids(nodes: DataFrame, slot: str, *columns: str, first: bool = False) -> DataFrame:
    """file_id, node (the parent) and ``columns`` of the children in a slot, with the slot's name before theirs."""
    rows = nodes.where((F.col("slot") == slot) & ((F.col("place") == 0) if first else F.lit(True)))
    return rows.select("file_id", F.col("parent").alias("node"), *[F.col(c).alias(f"{slot}_{c}") for c in columns])


def last_bindings(nodes: DataFrame) -> DataFrame:
    """file_id, name, value, value_last: the node that each name was last bound to; null where that binding has none."""
    bound = nodes.where("kind = 'VariableDeclarator' AND name IS NOT NULL").select("file_id", "node", "name")
    set_ = nodes.where("slot = 'left' AND kind = 'Identifier'").select("file_id", F.col("parent").alias("node"), "name")
    set_ = set_.join(nodes.where("kind = 'AssignmentExpression'").select("file_id", "node"), ["file_id", "node"])
    value = lambda slot: _kids(nodes, slot, "node", "last").withColumnsRenamed({f"{slot}_node": "value", f"{slot}_last": "value_last"})
    both = bound.join(value("init"), ["file_id", "node"], "left").unionByName(set_.join(value("right"), ["file_id", "node"], "left"))
    return both.groupBy("file_id", "name").agg(F.max_by(F.struct("value", "value_last"), "node").alias("b")).select("file_id", "name", "b.value", "b.value_last")


@dataclass
class Names:
    """Relations on (file, name): static texts, texts from a request, guards against keys, and sanitizers (by name)."""

    static: DataFrame
    request: DataFrame
    guard: DataFrame
    sanitizer: DataFrame


def _marked(nodes: DataFrame) -> DataFrame:
    """Nodes with what the rules ask of them alone."""
    return nodes.withColumns({
        "is_sum": F.coalesce((F.col("kind") == "BinaryExpression") & (F.col("operator") == "+"), F.lit(False)),
        "is_literal": F.col("kind").isin(*LITERALS) | ((F.col("kind") == "TemplateLiteral") & (F.col("last") == F.col("node"))),
        "is_request": F.coalesce(F.col("kind").isin("MemberExpression", "Identifier") & F.col("name").rlike(REQUEST), F.lit(False)),
        "is_word": F.coalesce(F.col("kind").isin("StringLiteral", "TemplateLiteral") & F.col("text").rlike(SQL_WORD), F.lit(False)),
    })


def names(nodes: DataFrame, bound: DataFrame) -> Names:
    """The relations of all files, by joins repeated until nothing is new. nodes: as of ``_marked``."""
    valued = bound.where("value IS NOT NULL")
    leaf = nodes.where("NOT is_sum")
    known = valued.select("file_id", F.col("name").alias("dep"))
    # static: every summand is a literal or a static name
    parts = leaf.select("file_id", F.col("plus").alias("value"), "is_literal", F.when(F.col("kind") == "Identifier", F.col("name")).alias("dep"))
    parts = valued.join(parts, ["file_id", "value"]).join(known.withColumn("bound", F.lit(True)), ["file_id", "dep"], "left")
    bad = parts.where("NOT is_literal AND bound IS NULL").select("file_id", "name").distinct()
    hopeful = valued.select("file_id", "name").join(bad, ["file_id", "name"], "left_anti")
    static = resolved(hopeful, parts.where("NOT is_literal AND bound").select("file_id", "name", "dep"), "name", "dep")
    # the others hold as soon as one part does
    pieces = valued.join(leaf.where("kind <> 'TemplateLiteral'").select("file_id", F.col("cat").alias("value"), "is_request", "kind", F.col("name").alias("dep")), ["file_id", "value"])
    inside = (F.col("n.file_id") == F.col("v.file_id")) & F.col("n.node").between(F.col("v.value"), F.col("v.value_last"))
    held = valued.alias("v").join(nodes.where("kind IN ('Identifier', 'StringLiteral')").alias("n"), inside).select("v.file_id", "v.name", "n.kind", F.col("n.name").alias("dep"), F.col("n.text").alias("text"))
    calls = nodes.where("kind = 'CallExpression'").join(_kids(nodes, "callee", "name", first=True), ["file_id", "node"]).where(F.col("callee_name").rlike(SANITIZER)).select("file_id", F.col("node").alias("value"), F.col("callee_name").alias("label"))
    ends = awaited(nodes)
    aimed = valued.select("file_id", "name", "value").join(ends, ["file_id", "value"], "left").select("file_id", "name", F.coalesce("end", "value").alias("value"))
    next_ = aimed.join(nodes.where("kind = 'Identifier'").select("file_id", F.col("node").alias("value"), F.col("name").alias("dep")), ["file_id", "value"])
    plain = lambda df, what: df.select(F.lit(what).alias("what"), F.lit("").alias("label"), "file_id", "name")
    start = [
        plain(pieces.where("is_request"), "request"),
        plain(held.where((F.col("kind") == "StringLiteral") & F.col("text").isin(*GUARD_KEYS)), "guard"),
        aimed.join(calls, ["file_id", "value"]).select(F.lit("sanitizer").alias("what"), "label", "file_id", "name"),
    ]
    edges = [(pieces.where("kind = 'Identifier'"), "request"), (held.where("kind = 'Identifier'"), "guard"), (next_, "sanitizer")]
    edges = reduce(DataFrame.unionByName, [e.select(F.lit(what).alias("what"), "file_id", "name", "dep") for e, what in edges])
    grown = reach(reduce(DataFrame.unionByName, start), edges, "name", "dep")
    of = lambda what: grown.where(F.col("what") == what)
    return Names(static, of("request").select("file_id", "name"), of("guard").select("file_id", "name"), of("sanitizer").select("file_id", "name", "label"))


def awaited(nodes: DataFrame) -> DataFrame:
    """file_id, value, end: for each outermost ``await``, the expression behind all of them."""
    waits = nodes.where("kind = 'AwaitExpression'").select("file_id", "node", "last", "slot", "parent")
    inner = waits.join(waits.select("file_id", F.col("node").alias("parent"), F.lit(True).alias("under")), ["file_id", "parent"], "left")
    outer = inner.where("under IS NULL").select("file_id", F.col("node").alias("value"), F.col("last").alias("value_last"))
    # waits that follow each other have following numbers; the first number that is not one of them ends the run
    run = Window.partitionBy("file_id").orderBy("node")
    runs = waits.withColumn("run", F.col("node") - F.row_number().over(run)).groupBy("file_id", "run").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    within = (F.col("o.file_id") == F.col("r.file_id")) & F.col("o.value").between(F.col("r.low"), F.col("r.high"))
    return outer.alias("o").join(runs.alias("r"), within).select("o.file_id", "o.value", (F.col("r.high") + 1).alias("end"))


def _dynamic(nodes: DataFrame, known: Names) -> DataFrame:
    """Nodes with is_dynamic (not static) and has_word (static text with a word of SQL), each for the sum as a whole."""
    leaf = nodes.join(known.static.withColumn("static_name", F.lit(True)), ["file_id", "name"], "left")
    flagged = leaf.withColumn("leaf_dynamic", ~(F.col("is_sum") | F.col("is_literal") | ((F.col("kind") == "Identifier") & F.coalesce("static_name", F.lit(False)))))
    later = Window.partitionBy("file_id", "plus").orderBy("node").rowsBetween(1, Window.unboundedFollowing)
    next_ = lambda flag: F.min(F.when(F.col(flag), F.col("node"))).over(later) <= F.col("last")
    in_sum = F.col("is_sum") | (F.col("plus") != F.col("node"))
    sums = flagged.where(in_sum).withColumns({"d": F.coalesce(next_("leaf_dynamic"), F.lit(False)), "w": F.coalesce(next_("is_word"), F.lit(False))})
    whole = lambda of, own: F.when(F.col("is_sum"), F.col(of)).otherwise(F.col(own))
    alone = flagged.where(~in_sum).withColumns({"d": F.lit(False), "w": F.lit(False)})
    return sums.unionByName(alone).withColumns({"is_dynamic": whole("d", "leaf_dynamic"), "has_word": whole("w", "is_word")}).drop("leaf_dynamic", "static_name", "d", "w")


def _finding(rows: DataFrame, rule: str, *, tier: Column | None = None, blocking: Column | None = None, symbol: Column | None = None, fix: Column | None = None, message: Column | None = None, adjusted: Column | None = None) -> DataFrame:
    place, (own_tier, own_blocking, title) = TREE_RULES[rule]
    none = F.lit(None).cast("string")
    return rows.select(
        "file_id", F.lit(rule.split("/")[0]).alias("rule_id"), F.lit(place).alias("rule_ord"), (F.lit(own_tier) if tier is None else tier).alias("tier"), (F.lit(own_blocking) if blocking is None else blocking).alias("blocking"),
        F.lit(title).alias("title"), *_PLACE, "node", (none if symbol is None else symbol).alias("symbol"), (F.lit(MESSAGES[rule]) if message is None else message).alias("message"),
        (none if adjusted is None else adjusted).alias("tier_adjusted"), (F.lit(None).cast(FIX) if fix is None else fix.cast(FIX)).alias("fix"),
    )


FIX = "struct<title:string,line:int,col:int,end_line:int,end_col:int,text:string>"


def detect(nodes: DataFrame, deprecated: DataFrame | None = None) -> DataFrame:
    """Findings of the tree rules: file_id, rule_id, tier, blocking, title, place, node, symbol, message, tier_adjusted, fix.

    deprecated: name, replaced_by, and author, pr and tier, which may be null. Of one rule at one place the outermost
    node stays.
    """
    nodes = settled(_marked(nodes))
    bound = settled(last_bindings(nodes))
    known = names(nodes, bound)
    flagged = settled(_dynamic(nodes, known))
    key = ["file_id", "node"]
    calls = nodes.where("kind = 'CallExpression'").join(_kids(nodes, "callee", "kind", "name", *_PLACE, first=True), key)
    named = calls.where(F.col("callee_kind").isin("Identifier", "MemberExpression", "ThisExpression") & F.col("callee_name").isNotNull())
    left = _kids(nodes.where(F.col("kind").isin("Identifier", "MemberExpression", "ThisExpression")), "left", "name", "kind", "computed", first=True)
    writes = nodes.where("kind = 'AssignmentExpression'").join(left, key)
    first_argument = nodes.where("slot = 'argument' AND place = 0").select("file_id", F.col("parent").alias("node"), F.col("is_request").alias("of_request"))

    exports = nodes.where(F.col("kind").isin(*EXPORTS))
    modules = writes.where((F.col("left_name") == "module.exports") | F.col("left_name").startswith("exports."))
    public = [
        _finding(exports, "public-api-change", symbol=F.col("name")),
        _finding(modules, "public-api-change", symbol=F.when(F.col("left_name").startswith("exports."), F.substring("left_name", 9, 1 << 30)).otherwise(F.col("left_name"))),
    ]

    built = flagged.where((F.col("is_sum") | (F.col("kind") == "TemplateLiteral")) & F.col("has_word") & F.col("is_dynamic"))
    passed = named.where(F.col("callee_name").rlike(QUERY_CALL)).join(first_argument.where("of_request"), key)
    sql = [_finding(built, "sql-injection"), _finding(passed, "sql-injection", message=F.lit(MESSAGES["sql-injection/passed"]))]

    # path-traversal: an argument that holds request data
    requested = nodes.where("NOT is_sum AND kind <> 'TemplateLiteral'").join(known.request.withColumn("via", F.lit(True)), ["file_id", "name"], "left")
    requested = requested.where(F.col("is_request") | ((F.col("kind") == "Identifier") & F.coalesce("via", F.lit(False)))).select("file_id", F.col("cat").alias("root")).distinct()
    touched = nodes.where("slot = 'argument'").select("file_id", F.col("parent").alias("node"), F.col("node").alias("root")).join(requested, ["file_id", "root"]).select(*key).distinct()
    opened = named.where(F.col("callee_name").rlike(FILE_CALL) | F.col("callee_name").rlike(PATH_CALL)).join(touched, key)
    path = [_finding(opened, "path-traversal")]

    # xss-sink: the value written, and the sanitizer that it comes from
    html = writes.where("operator = '='").where(F.col("left_name").endswith(".innerHTML") | F.col("left_name").endswith(".outerHTML"))
    into = html.join(_kids(nodes, "right", "node").withColumnRenamed("right_node", "value"), key)
    printed = named.where(F.col("callee_name").isin("document.write", "document.writeln") | F.col("callee_name").endswith(".insertAdjacentHTML"))
    shown = printed.join(nodes.where("slot = 'argument' AND place = 0").select("file_id", F.col("parent").alias("node"), F.col("node").alias("value")), key)
    sinks = into.select(*key, *_PLACE, "value").unionByName(shown.select(*key, *_PLACE, "value"))
    sinks = sinks.join(flagged.where("is_dynamic").select("file_id", F.col("node").alias("value")), ["file_id", "value"])
    aimed = sinks.join(awaited(nodes), ["file_id", "value"], "left").withColumn("end", F.coalesce("end", "value"))
    direct = named.where(F.col("callee_name").rlike(SANITIZER)).select("file_id", F.col("node").alias("end"), F.col("callee_name").alias("direct"))
    through = nodes.where("kind = 'Identifier'").select("file_id", F.col("node").alias("end"), "name").join(known.sanitizer, ["file_id", "name"]).select("file_id", "end", "label")
    cleaned = aimed.join(direct, ["file_id", "end"], "left").join(through, ["file_id", "end"], "left").withColumn("by", F.coalesce("direct", "label"))
    clean = F.col("by").isNotNull()
    xss = [_finding(
        cleaned, "xss-sink", tier=F.when(clean, "yellow").otherwise("orange"), blocking=F.lit(False), adjusted=F.when(clean, "deescalated"),
        message=F.when(clean, F.concat(F.lit("The value passes the sanitizer `"), "by", F.lit("`: probably safe, check that it covers every input."))).otherwise(MESSAGES["xss-sink"]),
    )]

    found = [*public, *sql, *path, *xss, _finding(unguarded_merges(nodes, known), "prototype-pollution/merge", symbol=F.col("bound"))]
    if deprecated is not None:
        found += _deprecated(nodes, named, deprecated)
    every = reduce(DataFrame.unionByName, found)
    outermost = Window.partitionBy("file_id", "rule_id", "line", "col").orderBy("rule_ord", "node")
    return every.withColumn("_n", F.row_number().over(outermost)).where("_n = 1").drop("_n")


def unguarded_merges(nodes: DataFrame, known: Names) -> DataFrame:
    """Functions of two parameters or more that walk over keys, write computed members and call themselves, unguarded."""
    key = ["file_id", "node"]
    made = nodes.where(F.col("kind").isin(*FUNCTIONS)).join(nodes.where("slot = 'param'").groupBy("file_id", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("params")), key).where("params >= 2")
    body = nodes.where("slot = 'body' AND kind = 'BlockStatement'").select("file_id", F.col("parent").alias("node"), F.col("node").alias("low"), F.col("last").alias("high"))
    named = nodes.where("kind = 'VariableDeclarator'").select("file_id", F.col("node").alias("parent"), F.col("name").alias("variable"))
    functions = made.join(body, key).join(named, ["file_id", "parent"], "left").withColumn("bound", F.coalesce("name", F.when(F.col("slot") == "init", F.col("variable")))).where("bound IS NOT NULL")

    callee = _kids(nodes, "callee", "name", "kind", first=True)
    calls = nodes.where("kind = 'CallExpression'").join(callee, key)
    computed = nodes.where("kind = 'MemberExpression' AND computed")
    self_ = calls.where("callee_kind = 'Identifier'").select("file_id", F.col("node").alias("at"), F.lit("call").alias("sign"), F.col("callee_name").alias("what"))
    handed = computed.where("slot = 'argument'").select("file_id", F.col("parent").alias("node")).distinct().join(calls.where("callee_kind = 'Identifier'"), key)
    signs = [
        nodes.where("kind = 'ForInStatement'").select("file_id", F.col("node").alias("at"), F.lit("keys").alias("sign"), F.lit(None).cast("string").alias("what")),
        calls.where(F.col("callee_name").rlike(KEYS_CALL)).select("file_id", F.col("node").alias("at"), F.lit("keys").alias("sign"), F.lit(None).cast("string").alias("what")),
        nodes.where("kind = 'AssignmentExpression'").select(*key).join(computed.where("slot = 'left'").select("file_id", F.col("parent").alias("node")), key).select("file_id", F.col("node").alias("at"), F.lit("write").alias("sign"), F.lit(None).cast("string").alias("what")),
        handed.select("file_id", F.col("node").alias("at"), F.lit("handed").alias("sign"), F.col("callee_name").alias("what")),
        self_,
    ]
    guards = nodes.where((F.col("kind") == "StringLiteral") & F.col("text").isin(*GUARD_KEYS)).select("file_id", F.col("node").alias("at"))
    guards = guards.unionByName(nodes.where("kind = 'Identifier'").join(known.guard, ["file_id", "name"]).select("file_id", F.col("node").alias("at")))
    signs = reduce(DataFrame.unionByName, [*signs, guards.select("file_id", "at", F.lit("guard").alias("sign"), F.lit(None).cast("string").alias("what"))])
    inside = (F.col("f.file_id") == F.col("s.file_id")) & F.col("s.at").between(F.col("f.low"), F.col("f.high"))
    held = functions.alias("f").join(signs.alias("s"), inside)
    sign = lambda *of: F.bool_or(F.col("s.sign").isin(*of))
    to_itself = lambda of: F.bool_or((F.col("s.sign") == of) & (F.col("s.what") == F.col("f.bound")))
    shape = held.groupBy("f.file_id", "f.node").agg(sign("keys").alias("keys"), (sign("write") | to_itself("handed")).alias("writes"), to_itself("call").alias("calls"), sign("guard").alias("guarded"))
    return functions.join(shape.where("keys AND writes AND calls AND NOT guarded").select(*key), key)


def deprecation(replaced_by: Column, author: Column, pr: Column) -> Column:
    return F.concat_ws(" ", F.concat(F.lit("Deprecated: use `"), replaced_by, F.lit("`.")), F.concat(F.lit("Owner: "), author, F.lit(".")), F.concat(F.lit("See "), pr, F.lit(".")))


def _deprecated(nodes: DataFrame, named: DataFrame, deprecated: DataFrame) -> list[DataFrame]:
    """Calls of deprecated names, with a fix, and other mentions of deprecated members."""
    listed = deprecated.withColumn("name", F.trim(F.regexp_replace("name", r"\([\s\S]*$", "")))
    told = deprecation(F.col("replaced_by"), F.col("author"), F.col("pr"))
    tier = F.coalesce("own_tier", F.lit("yellow"))
    listed = listed.select(F.col("name").alias("of"), "replaced_by", "author", "pr", F.col("tier").alias("own_tier"))
    called = named.join(listed, named["callee_name"] == F.col("of"))
    new = F.trim(F.regexp_replace("replaced_by", r"\([\s\S]*$", ""))
    fix = F.when((new != "") & (new != F.col("of")), F.struct(F.concat(F.lit("Replace with "), new), "callee_line", "callee_col", "callee_end_line", "callee_end_col", new))
    members = nodes.where("kind = 'MemberExpression' AND slot <> 'callee'").join(listed, F.col("name") == F.col("of"))
    # the callee of ``new`` is no call
    news = nodes.where("kind = 'MemberExpression' AND slot = 'callee'").join(nodes.where("kind <> 'CallExpression'").select("file_id", F.col("node").alias("parent")), ["file_id", "parent"]).join(listed, F.col("name") == F.col("of"))
    return [
        _finding(called, "deprecated-api", tier=tier, symbol=F.col("of"), fix=fix, message=told),
        *[_finding(m, "deprecated-api", tier=tier, symbol=F.col("of"), message=told) for m in (members, news)],
    ]


def in_change(found: DataFrame, files: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings that begin in a changed line, or in a file without diff information."""
    marked = changed.select("file_id", "line", F.lit(True).alias("_hit")).distinct()
    scoped = found.join(files.select("file_id", "diff_known"), "file_id").join(marked, ["file_id", "line"], "left")
    return scoped.where(~F.col("diff_known") | F.col("_hit")).drop("_hit", "diff_known")


def with_code(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings with the trimmed text of their line as ``code``."""
    return found.join(lines.select("file_id", "line", T.trim_white(F.col("raw")).alias("code")), ["file_id", "line"])


def exported_signatures(nodes: DataFrame) -> DataFrame:
    """file_id, name, params, place: functions exported at the top of a file, over any number of lines; the last of a name."""
    key = ["file_id", "node"]
    exports = nodes.where("parent = 0 AND kind IN ('ExportNamedDeclaration', 'ExportDefaultDeclaration')").select("file_id", F.col("node").alias("export"), F.col("kind").alias("form"), F.col("name").alias("shown"))
    declared = nodes.where("slot = 'declaration'").withColumnRenamed("parent", "export").join(exports, ["file_id", "export"])
    plain = declared.where("kind = 'FunctionDeclaration' OR (form = 'ExportDefaultDeclaration' AND kind IN ('ArrowFunctionExpression', 'FunctionExpression'))")
    plain = plain.select("file_id", "node", F.when(F.col("form") == "ExportDefaultDeclaration", F.coalesce("name", F.lit("default"))).otherwise(F.col("name")).alias("name"), "export", *_PLACE)
    variables = declared.where("kind = 'VariableDeclaration'").select("file_id", F.col("node").alias("parent"), "export")
    declarators = nodes.where("kind = 'VariableDeclarator' AND name IS NOT NULL").join(variables, ["file_id", "parent"]).select("file_id", F.col("node").alias("declarator"), "name", "export", *_PLACE)
    values = nodes.where("slot = 'init' AND kind IN ('ArrowFunctionExpression', 'FunctionExpression')").select("file_id", F.col("parent").alias("declarator"), "node")
    bound = declarators.join(values, ["file_id", "declarator"]).select("file_id", "node", "name", "export", *_PLACE)
    functions = plain.where("name IS NOT NULL").unionByName(bound)
    params = nodes.where("slot = 'param'").groupBy("file_id", F.col("parent").alias("node")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda p: p["text"]), ", ").alias("params"))
    signed = functions.join(params, key, "left").withColumn("params", F.coalesce("params", F.lit("")))
    return signed.groupBy("file_id", "name").agg(F.max_by(F.struct("params", *_PLACE), "node").alias("s")).select("file_id", "name", "s.*")


def signature_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings on exported names whose parameters differ between two node tables' signatures."""
    old = before.select("file_id", "name", F.col("params").alias("old_params"))
    moved = after.join(old, ["file_id", "name"]).where("params <> old_params").withColumn("node", F.lit(0))
    told = F.concat(F.lit("Exported `"), "name", F.lit("` went from ("), "old_params", F.lit(") to ("), "params", F.lit("): callers may break."))
    return _finding(moved, "signature-drift", symbol=F.col("name"), message=told)
