"""Queries on the syntax of scripts: script files from ``events``, a line an event, and their equivalents in SQL.

The lines bind names to each other, so that last bindings, chains of them and circles all occur in every file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riftline.jobs import tables
from riftline.jobs.queries import query
from riftline.operators import trees
from riftline.operators.fixpoint import settled
from riftline.sources import scripts

#: Lines by number of the event; "%a" and "%b" stand for two of seven names.
LINES = (
    "let v%a;", 'const v%a = "text";', "v%a = v%b;", 'v%a = v%b + "x";', "v%a = req.query.p;", "v%a = `t ${v%b}`;", "v%a = DOMPurify.sanitize(v%b);", "v%a = await v%b;", "el.innerHTML = v%a;",
    'document.write(v%a + "!");', 'db.query("SELECT * FROM t WHERE id = " + v%a);', "path.join(root, v%a);", "export function f%a(x, y) { return x; }", "module.exports = v%a;", "old_call(v%a, 1);",
    "function m%a(t, s) { for (const k in s) { t[k] = m%a(t[k], s[k]); } if (v%b) { return t; } }", 'const v%a = ["__proto__", "constructor"];',
)
#: Parameters of exported functions: as written, and as a signature tells them.
PARAMETERS = (("p0", "p0"), ("p1 = g(1, 2)", "p1="), ("{ p2: q }", "{…}"), ("...p3", "...p3"))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id")
    return events.select(
        F.col("user_id").alias("file_id"), "event_id", "event_type", (k % len(LINES)).cast("int").alias("kind"), (F.floor(k / len(LINES)) % 7).cast("int").alias("a"), (F.floor(k / (7 * len(LINES))) % 7).cast("int").alias("b"),
        F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("line"),
    )


def _joined(lines: DataFrame, text: str) -> DataFrame:
    """file_id, text, language: the lines of each file, which is a user's and as large as a source file."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("line", F.col(text).alias("raw")))), lambda x: x["raw"])
    return lines.groupBy("file_id").agg(F.array_join(rows, "\n").alias("text")).withColumn("language", F.lit("javascript"))


def script_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.get(F.array(*map(F.lit, LINES)), F.col("kind"))
    raw = F.replace(F.replace(raw, F.lit("%a"), F.col("a").cast("string")), F.lit("%b"), F.col("b").cast("string"))
    return settled(scripts.nodes(_joined(_numbered(spark, sf_dir).withColumn("raw", raw), "raw"), "file_id", "text", "language"))


_SCRIPTS = f"""
WITH RECURSIVE l AS (
  SELECT user_id AS file_id, event_id, event_type, event_id % {len(LINES)} AS kind, (event_id // {len(LINES)}) % 7 AS a, (event_id // {7 * len(LINES)}) % 7 AS b, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS line
  FROM events
), s AS (
  SELECT *, length(replace(replace(({tables._list(LINES)})[CAST(kind AS INT) + 1], '%a', a::VARCHAR), '%b', b::VARCHAR)) AS len FROM l
), bound AS (
  SELECT file_id, a, kind, b FROM l WHERE kind <= 7 OR kind = 16 QUALIFY row_number() OVER (PARTITION BY file_id, a ORDER BY line DESC) = 1
), walk(what, file_id, start, now_at) AS (
  SELECT what, file_id, a, a FROM bound, (SELECT unnest(['static', 'request', 'clean', 'guard']) AS what)
  UNION
  SELECT what, w.file_id, start, b FROM walk w JOIN bound x ON x.file_id = w.file_id AND x.a = w.now_at
  WHERE (what = 'static' AND kind IN (2, 3)) OR (what = 'request' AND kind IN (2, 3, 5)) OR (what = 'clean' AND kind IN (2, 7)) OR (what = 'guard' AND kind IN (2, 3, 5, 6, 7))
), holds AS (
  SELECT DISTINCT what, w.file_id, start FROM walk w JOIN bound x ON x.file_id = w.file_id AND x.a = w.now_at
  WHERE (what = 'static' AND kind = 1) OR (what = 'request' AND kind = 4) OR (what = 'clean' AND kind = 6) OR (what = 'guard' AND kind = 16)
)"""
_HOLDS = "EXISTS (SELECT 1 FROM holds h WHERE h.what = '{}' AND h.file_id = s.file_id AND h.start = s.{})"


@query(_SCRIPTS + f"""
SELECT file_id, a AS name, {_HOLDS.format("static", "a")} AS static, {_HOLDS.format("request", "a")} AS request, {_HOLDS.format("clean", "a")} AS clean, {_HOLDS.format("guard", "a")} AS guard, kind = 0 AS empty FROM bound s
""")  # fmt: skip
def last_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each name of each script stands for at last, over any chain of bindings."""
    nodes = settled(trees._marked(script_nodes(spark, sf_dir)))
    bound = settled(trees.last_bindings(nodes))
    known = trees.names(nodes, bound)
    rows = bound.where(F.col("name").rlike(r"\Av\d\z"))
    for what in ("static", "request", "sanitizer", "guard"):
        rows = rows.join(getattr(known, what).select("file_id", "name", F.lit(True).alias(what)).distinct(), ["file_id", "name"], "left")
    flag = lambda what: F.coalesce(what, F.lit(False)).alias(what)
    return rows.select("file_id", F.substring("name", 2, 9).cast("long").alias("name"), flag("static"), flag("request"), flag("sanitizer").alias("clean"), flag("guard"), F.col("value").isNull().alias("empty"))


@query(_SCRIPTS + f"""
, found AS (
  SELECT *, {_HOLDS.format("static", "a")} AS static, {_HOLDS.format("clean", "a")} AS clean, {_HOLDS.format("request", "a")} AS request, {_HOLDS.format("guard", "b")} AS guard FROM s
), findings AS (
  SELECT file_id, line, event_type, 'xss-sink' AS rule_id, CASE WHEN kind = 8 AND clean THEN 'yellow' ELSE 'orange' END AS tier, false AS blocking, 0 AS col, len - 1 AS end_col, CAST(NULL AS VARCHAR) AS symbol, CASE WHEN kind = 8 AND clean THEN 'deescalated' END AS tier_adjusted, CAST(NULL AS VARCHAR) AS fix FROM found WHERE kind IN (8, 9) AND NOT static
  UNION ALL SELECT file_id, line, event_type, 'sql-injection', 'orange', true, 9, len - 2, NULL, NULL, NULL FROM found WHERE kind = 10 AND NOT static
  UNION ALL SELECT file_id, line, event_type, 'path-traversal', 'orange', false, 0, len - 1, NULL, NULL, NULL FROM found WHERE kind = 11 AND request
  UNION ALL SELECT file_id, line, event_type, 'public-api-change', 'orange', false, 0, CASE WHEN kind = 12 THEN len ELSE len - 1 END, CASE WHEN kind = 12 THEN 'f' || a ELSE 'module.exports' END, NULL, NULL FROM found WHERE kind IN (12, 13)
  UNION ALL SELECT file_id, line, event_type, 'deprecated-api', 'yellow', false, 0, len - 1, 'old_call', NULL, 'new_call' FROM found WHERE kind = 14
  UNION ALL SELECT file_id, line, event_type, 'prototype-pollution', 'orange', false, 0, len, 'm' || a, NULL, NULL FROM found WHERE kind = 15 AND NOT guard
)
SELECT file_id, rule_id, tier, blocking, line, CAST(col AS INT) AS col, line AS end_line, CAST(end_col AS INT) AS end_col, symbol, tier_adjusted, fix FROM findings
WHERE file_id % 3 = 0 OR (file_id % 9 <> 1 AND event_type IN ('error', 'purchase'))
""")  # fmt: skip
def tree_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the rules on syntax in the changed lines of scripts."""
    deprecated = spark.createDataFrame([(*d, None, None, None) for d in tables.DEPRECATED], "name string, replaced_by string, author string, pr string, tier string")
    rows = _numbered(spark, sf_dir)
    files = rows.select("file_id").distinct().withColumn("diff_known", F.col("file_id") % 3 != 0)
    found = trees.in_change(trees.detect(script_nodes(spark, sf_dir), deprecated), files, tables.changed(rows))
    return found.select("file_id", "rule_id", "tier", "blocking", "line", "col", "end_line", "end_col", "symbol", "tier_adjusted", F.col("fix.text").alias("fix"))


def _signed(spark: SparkSession, sf_dir: str, odd: int) -> DataFrame:
    """Exported functions over three lines each, of every second event."""
    params = F.array_join(F.slice(F.array(*[F.lit(p) for p, _ in PARAMETERS]), F.lit(1), (F.col("event_id") % 5).cast("int")), ", ")
    text = F.concat(F.lit("export function f"), (F.col("event_id") % 11).cast("string"), F.lit("(\n  "), params, F.lit("\n) { return 1; }"))
    rows = _numbered(spark, sf_dir).where(F.floor(F.col("event_id") / 3) % 2 == odd).withColumn("raw", text)
    return trees.exported_signatures(settled(scripts.nodes(_joined(rows, "raw"), "file_id", "text", "language")))


@query(f"""
WITH d AS (
  SELECT user_id AS file_id, 'f' || event_id % 11 AS symbol, (event_id // 3) % 2 AS odd, event_id, array_to_string(({tables._list(tuple(s for _, s in PARAMETERS))})[1:CAST(event_id % 5 AS INT)], ', ') AS params,
    CAST(3 * row_number() OVER (PARTITION BY user_id, (event_id // 3) % 2 ORDER BY event_id) - 2 AS INT) AS line
  FROM events
), last AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY file_id, symbol, odd ORDER BY event_id DESC) = 1)
SELECT n.file_id, n.symbol, n.line, CAST(7 AS INT) AS col, n.line + 2 AS end_line, '(' || o.params || ') to (' || n.params || ')' AS change
FROM last n JOIN last o ON n.file_id = o.file_id AND n.symbol = o.symbol AND n.odd = 1 AND o.odd = 0 WHERE n.params <> o.params
""")  # fmt: skip
def signature_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported functions, declared over several lines, whose parameters differ between two versions of a file."""
    found = trees.signature_drift(_signed(spark, sf_dir, 0), _signed(spark, sf_dir, 1))
    change = F.regexp_extract("message", r"went from (\([\s\S]*\) to \([\s\S]*\)):", 1)
    return found.select("file_id", "symbol", "line", "col", "end_line", change.alias("change"))
