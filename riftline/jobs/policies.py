"""Queries on configuration files, histories of lines, guides, tool output and totals, made of the given tables, and their equivalents in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riftline.functions import text as T
from riftline.functions.rules import ADVISORY, RULES
from riftline.jobs import tables
from riftline.jobs.queries import query
from riftline.operators import guidelines, learnings, payloads, perfile, policies, scoring
from riftline.sources import blame, sinks


def _configs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A file a customer; those of a nation extend one another by number, up to twelve in a row, and some lead astray."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    path = lambda c: F.concat(F.lit("/n/"), c.cast("string"), F.lit(".json"))
    base = F.when(k % 13 != 0, F.format_string('"extends": ["./%d.json"%s],', k - 1, F.when(k % 29 == 0, ', "gone"').otherwise(""))).otherwise(F.when(k % 5 == 0, F.concat(F.lit('"extends": "./'), k.cast("string"), F.lit('.json",'))).otherwise(""))
    body = F.concat(F.lit("{"), base, F.format_string('"ignore": ["i%d", "all"], "gate": {"g%d": %d}, "list": [%d], "last": %d}', k % 3, k % 4, k, k % 7, k))
    configs = rows.select(path(k).alias("path"), F.when(k % 41 == 0, "{").otherwise(body).alias("body"))
    return configs, configs.select("path")


_CONFIGS = """
WITH RECURSIVE c AS (SELECT c_custkey AS k, c_custkey % 41 = 0 AS broken, c_custkey % 13 <> 0 AS extends, c_custkey % 13 = 0 AND c_custkey % 5 = 0 AS itself, c_custkey % 29 = 0 AND c_custkey % 13 <> 0 AS gone FROM customer),
walk AS (
  SELECT k AS root, k AS num, 0 AS level FROM c
  UNION ALL SELECT root, num - 1, level + 1 FROM walk JOIN c ON c.k = num AND c.extends AND NOT c.broken AND level <= 10 WHERE num - 1 IN (SELECT k FROM c)
), errors AS (
  SELECT root, level, 0 AS late, 'chain too deep at /n/' || num || '.json' AS error FROM walk WHERE level = 11
  UNION ALL SELECT root, level, 0, 'no JSON object at /n/' || num || '.json' FROM walk JOIN c ON k = num WHERE broken AND level < 11
  UNION ALL SELECT root, level, 0, 'circle at /n/' || num || '.json' FROM walk JOIN c ON k = num WHERE itself AND NOT broken AND level < 11
  UNION ALL SELECT root, level, 0, 'no file for ./' || (num - 1) || '.json in /n/' || num || '.json' FROM walk JOIN c ON k = num WHERE extends AND NOT broken AND level < 11 AND num - 1 NOT IN (SELECT k FROM c)
  UNION ALL SELECT root, level, 1, 'no file for gone in /n/' || num || '.json' FROM walk JOIN c ON k = num WHERE gone AND NOT broken AND level < 11
), first_error AS (
  SELECT root, first(error ORDER BY late, CASE WHEN late = 0 THEN level ELSE -level END) AS error FROM errors GROUP BY 1
)"""


@query(_CONFIGS + " SELECT '/n/' || root || '.json' AS root, error FROM first_error")
def config_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration files that cannot be put together, each with its first error."""
    return policies.closure(*_configs(spark, sf_dir))[1]


@query(_CONFIGS + """, good AS (SELECT w.* FROM walk w WHERE root NOT IN (SELECT root FROM first_error)),
gates AS (SELECT root, num % 4 AS g, min(num) FILTER (true) AS lo, max(num) AS v FROM good GROUP BY ALL)
SELECT '/n/' || root || '.json' AS root, 'last' AS name, root::VARCHAR AS value FROM good WHERE level = 0
UNION ALL SELECT '/n/' || root || '.json', 'list', '[' || string_agg((num % 7)::VARCHAR, ',' ORDER BY num) || ']' FROM good GROUP BY root
UNION ALL SELECT '/n/' || root || '.json', 'gate', '{' || string_agg('"g' || g || '":' || v, ',' ORDER BY g) || '}' FROM gates GROUP BY root
UNION ALL SELECT '/n/' || root || '.json', 'ignore', '[' || string_agg('"' || what || '"', ',' ORDER BY place) || ']' FROM (
  SELECT root, what, min(2 * num + late) AS place FROM (SELECT root, num, 0 AS late, 'i' || num % 3 AS what FROM good UNION ALL SELECT root, num, 1, 'all' FROM good) GROUP BY ALL) GROUP BY root
""")  # fmt: skip
def merged_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes out of each configuration file and all that it extends."""
    configs, roots = _configs(spark, sf_dir)
    return policies.merged(configs, policies.closure(configs, roots)[0])


@query("SELECT c_custkey AS root, 'failOn must be one of \"green\" | \"yellow\" | \"orange\", got \"' || c_mktsegment || '\"' AS error FROM customer WHERE c_custkey % 3 = 0")
def invalid_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    value = F.to_json(F.struct(F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise("yellow").alias("failOn")))
    return policies.invalid(rows.select(F.col("c_custkey").alias("root"), F.lit("gate").alias("name"), value.alias("value")))


@query("""SELECT o_custkey AS file_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS line, 'clerk ' || o_custkey % 7 || o_orderpriority AS author, (o_custkey * 100 + length(o_orderpriority))::VARCHAR AS author_time,
  nullif('', '') AS summary, substr(sha1(o_custkey || o_orderpriority), 1, 8) AS hash FROM orders""")
def blamed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who last changed each line of files whose lines are a customer's orders, and whose commits are priorities."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    by_file = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    commit = F.sha1(F.concat(F.col("o_custkey").cast("string"), "o_orderpriority"))
    rows = orders.select("o_custkey", "o_orderpriority", commit.alias("commit"), F.row_number().over(by_file).alias("line"))
    rows = rows.withColumn("first", F.row_number().over(Window.partitionBy("o_custkey", "commit").orderBy("line")) == 1)
    told = F.concat(F.format_string("author clerk %d", F.col("o_custkey") % 7), "o_orderpriority", F.format_string("\nauthor-time %d\nsummary\nfilename f\n", F.col("o_custkey") * 100 + F.length("o_orderpriority")))
    text = F.concat("commit", F.format_string(" %d %d\n", F.col("line") + 1, "line"), F.when(F.col("first"), told).otherwise(""), F.format_string("\tauthor of line %d\n", "line"))
    whole = rows.groupBy(F.col("o_custkey").alias("file_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", text.alias("t")))), lambda x: x["t"]), "").alias("out"))
    return blame.lines(whole, "file_id", "out")


@query("""WITH g AS (SELECT doc_id, text, length(text) > 500 AS long, ('## ' || CASE doc_id % 3 WHEN 0 THEN 'Naming rules' WHEN 1 THEN 'Setup' ELSE 'Notes' END) AS head FROM documents WHERE text IS NOT NULL),
whole AS (SELECT doc_id, long, 'intro' || chr(10) || head || chr(10) || text || chr(10) || '# Security' || chr(10) || 'never' AS body, 'intro' || chr(10) || '# Security' || chr(10) || 'never' AS without, doc_id % 3 = 0 AS kept FROM g),
cut AS (SELECT doc_id, CASE WHEN length(body) > 600 AND NOT kept THEN without ELSE body END AS t FROM whole)
SELECT doc_id, sha1(CASE WHEN length(t) > 600 THEN substr(t, 1, 600) || chr(10) || '…[truncated]' ELSE t END) AS sha FROM cut""")
def guides_within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guides cut to their sections with rules."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    head = F.get(F.array(F.lit("Naming rules"), F.lit("Setup"), F.lit("Notes")), (F.col("doc_id") % 3).cast("int"))
    body = F.concat(F.lit("intro\n## "), head, F.lit("\n"), "text", F.lit("\n# Security\nnever"))
    return guidelines.within_budget(docs.select("doc_id", body.alias("t")), "doc_id", "t", 600).select("doc_id", F.sha1("t").alias("sha"))


def _event_payloads(spark: SparkSession, sf_dir: str, *forms: str) -> DataFrame:
    """id, payload: one of the forms an event, with its type for T and its number for N; dealt out while small, as reading payloads takes long."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type").repartition("event_id")
    filled = F.replace(F.replace(F.get(F.array(*map(F.lit, forms)), (F.col("event_id") % len(forms)).cast("int")), F.lit("<T>"), F.col("event_type")), F.lit("<N>"), F.col("event_id").cast("string"))
    return events.select(F.col("event_id").alias("id"), filled.alias("payload"))


@query("""SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 4 THEN false END AS tainted,
  CASE event_id % 6 WHEN 0 THEN event_type || '@a.js:' || event_id || ' sink' WHEN 1 THEN 'from ' || event_type ELSE '' END AS flow, CASE event_id % 6 WHEN 0 THEN event_type WHEN 4 THEN '7' END AS detector FROM events""")
def graph_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts stated, implied by a path or an all-clear, and left open."""
    made = _event_payloads(
        spark, sf_dir, '{"tainted": true, "data_flow": [{"symbol": "<T>", "uri": "file://a.js", "row": "<N>"}, "sink", {"line": 3}], "tool": "<T>"}', '{"taint_path": "from, <T>"}', '{"clean": true}', '{"note": "<T>", "tainted": "true", "safe": "true"}',
        '{"is_tainted": false, "rule": 7}', "not json <T>",
    )
    return payloads.taint(made, "id", "payload").select("id", "tainted", payloads.shown(F.col("flow")).alias("flow"), "detector")


@query("""SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'run@' || event_type || '.js:4' WHEN 1 THEN 'a b' ELSE '' END AS callers, CASE event_id % 4 WHEN 0 THEN 't' || event_id || ' @' || event_type || '.test.js' WHEN 1 THEN 'x' WHEN 2 THEN event_type ELSE '' END AS tests,
  CASE event_id % 4 WHEN 0 THEN event_type || ' — fix ' || event_id || '|late' WHEN 1 THEN 'sha' ELSE '' END AS history FROM events""")
def graph_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers, tests and history of the places of edits; a payload may be a list of tests."""
    made = _event_payloads(
        spark, sf_dir, '{"callers": [{"function": "run", "file": "<T>.js", "line": 4}], "tests": ["t<N>", {"path": "<T>.test.js"}], "commits": [{"login": "<T>", "subject": "fix <N>"}, " late ", {}]}', '{"references": "a,b", "results": ["x"], "blame": [{"sha": "sha"}]}', '["<T>", ""]', "{}",
    )
    found = payloads.edit_context(made, "id", "payload")
    return found.select("id", payloads.shown(F.col("callers")).alias("callers"), payloads.shown(F.col("tests")).alias("tests"), F.array_join("history", "|").alias("history"))


@query("""SELECT event_id AS id, s AS symbol, CASE WHEN s = 'f' THEN 2 ELSE 9 END AS caller_count, CASE WHEN s = 'f' THEN true END AS reachable, CAST(CASE WHEN s = 'f' THEN 3.5 ELSE 12 END AS DOUBLE) AS complexity, CASE WHEN s <> 'f' THEN true END AS stale_doc,
  CASE WHEN s = 'f' THEN 'g1 @' || event_type || ':2' ELSE '' END AS gaps, event_type || '|x.md|old' AS stale, 'fix: ' || event_id AS commit_hint FROM events, (VALUES ('f'), ('k')) AS v(s) WHERE event_id % 2 = 0""")
def graph_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact of each symbol of whole changes, with what they say on documents and the commit."""
    made = _event_payloads(
        spark, sf_dir,
        '{"changes": [{"name": "f", "callers": ["z"]}, {"id": "k", "caller_count": 9, "data": {"cyclomatic": "12", "docStale": true}, "is_reachable": "true"}, {"name": "f", "callers": ["a", {"name": "b"}], "reachable": true, "complexity": 3.5, "untested": ["g1", {"file": "<T>", "line": 2}]}, {"callers": []}], "staleDocs": [{"symbol": "<T>", "path": "file://x.md", "reason": "old"}, {}], "commitHint": "fix: <N>"}',
        '{"changes": []}',
    )
    stale = F.array_join(F.transform("stale", lambda d: F.concat_ws("|", d["symbol"], d["file"], d["note"])), " ")
    found = payloads.changes(made, "id", "payload")
    return found.select("id", "symbol", "caller_count", "reachable", "complexity", "stale_doc", payloads.shown(F.col("test_gaps")).alias("gaps"), stale.alias("stale"), "commit_hint")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN props WHEN 2 THEN '[' || props || ',"]"]' WHEN 3 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS value FROM events""")
def loose_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON values in the output of tools that log around them."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    forms = F.array(F.col("props"), F.concat(F.lit('started: "x" '), "props", F.lit(" } done]")), F.concat(F.lit("  took 3 s\n["), "props", F.lit(',"]"] ')), F.concat(F.lit("failed {"), "props"), F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit("\n")))
    return events.select("event_id", T.loose_json(F.get(forms, (F.col("event_id") % 5).cast("int"))).alias("value"))


@query("""WITH l AS (SELECT user_id AS file_id, event_id, event_type || event_id % 3 AS raw, event_id % 7 <> 0 AS kept, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line FROM events)
SELECT file_id, count(*) AS lines, coalesce(string_agg(CASE WHEN NOT kept THEN line::VARCHAR END, ',' ORDER BY line), '') AS changed FROM l GROUP BY 1""")
def exact_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed lines of files of any size: every seventh line is new, the others stand in both versions."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw = F.concat("event_type", (F.col("event_id") % 3).cast("string"))
    rows = F.array_sort(F.collect_list(F.struct("event_id", raw.alias("raw"))))
    joined = lambda rows: F.array_join(F.transform(rows, lambda x: x["r"]), "\n")
    new = F.transform(rows, lambda x: F.struct(x["event_id"].alias("e"), F.when(x["event_id"] % 7 == 0, F.concat(F.lit("new "), x["event_id"].cast("string"))).otherwise(x["raw"]).alias("r")))
    both = events.groupBy(F.col("user_id").alias("file_id")).agg(F.count(F.lit(1)).alias("lines"), new.alias("rows"))
    both = both.select("file_id", "lines", joined(F.filter("rows", lambda x: x["e"] % 7 != 0)).alias("old"), joined(F.col("rows")).alias("new"))
    return perfile.line_diff(both, "old", "new", None).select("file_id", "lines", F.array_join("changed", ",").alias("changed"))


_LEARNED = f"WITH {tables.SQL}, s AS (SELECT ({tables._list(tuple(r.rule_id for r in RULES))})[CAST(event_id % {len(RULES)} AS INT) + 1] AS rule_id, CASE WHEN value > 8 THEN 'dismiss' ELSE 'confirm' END AS verdict FROM code)"


@query(_LEARNED + " SELECT count(*) AS total, count(*) FILTER (verdict = 'dismiss') AS dismissed, count(*) FILTER (verdict = 'confirm') AS confirmed, count(*) FILTER (verdict = 'confirm') / count(*) AS signal FROM s")
def learnings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learnings.summary(tables.learnings(spark, sf_dir, [r.rule_id for r in RULES]))


@query(_LEARNED + " SELECT rule_id, count(*) AS dismissed, CAST(row_number() OVER (ORDER BY count(*) DESC, rule_id) AS INT) AS pos FROM s WHERE verdict = 'dismiss' GROUP BY 1 ORDER BY dismissed DESC, rule_id LIMIT 10")
def noisiest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learnings.noisiest(tables.learnings(spark, sf_dir, [r.rule_id for r in RULES]))


#: Rules that trials aim at and that fire in them, by number of the event.
_AIMED = ("sql-injection", "auth-crypto", "xss-sink", "path-traversal", "hardcoded-secret")


@query(f"""WITH r AS (SELECT {tables._list(_AIMED)} AS names, {tables._list(ADVISORY)} AS soft),
t AS (SELECT 'm' || user_id % 4 AS mode, event_id % 6 = 0 AS gap, [names[CAST(event_id % 5 AS INT) + 1]] AS targets, CASE WHEN event_id % 3 = 0 THEN [] ELSE [names[CAST(event_id // 5 % 5 AS INT) + 1], names[CAST(event_id // 25 % 5 AS INT) + 1]] END AS fired, event_type = 'error' AS failed, soft FROM events, r),
k AS (SELECT *, list_filter(fired, lambda x: NOT list_contains(soft, x)) AS hard FROM t),
c AS (SELECT mode, count(*) AS total, count(*) FILTER (failed) AS errors, count(*) FILTER (NOT failed AND NOT gap) AS scored, count(*) FILTER (NOT failed AND NOT gap AND len(fired) > 0) AS catches, count(*) FILTER (NOT failed AND NOT gap AND len(hard) > 0) AS defects,
  count(*) FILTER (NOT failed AND NOT gap AND len(hard) = 0 AND len(fired) > 0) AS advisories, count(*) FILTER (NOT failed AND NOT gap AND list_has_any(hard, targets)) AS on_target, count(*) FILTER (NOT failed AND gap AND len(fired) = 0) AS gap_clean FROM k GROUP BY 1)
SELECT *, round(defects / greatest(scored, 1), 3) AS defect_rate, round(advisories / greatest(scored, 1), 3) AS advisory_rate, round(on_target / greatest(scored, 1), 3) AS on_target_rate FROM c""")
def trial_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id")
    names = F.array(*map(F.lit, _AIMED))
    aim = lambda c: F.get(names, c.cast("int"))
    fired = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(aim(F.floor(k / 5) % 5), aim(F.floor(k / 25) % 5)))
    rows = events.select(F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("mode"), (k % 6 == 0).alias("known_gap"), F.array(aim(k % 5)).alias("target_rules"), fired.alias("fired_rules"), (F.col("event_type") == "error").alias("failed"))
    soft = F.size(F.filter("fired_rules", lambda r: ~r.isin(*ADVISORY))) == 0
    kind = F.when(F.col("failed"), "error").when(F.size("fired_rules") == 0, "clean").when(soft, "advisory").otherwise("defect")
    return scoring.trial_totals(rows.withColumn("kind", kind))


@query("""WITH f AS (SELECT user_id AS project, 'f' || event_id % 3 || '.py' AS path, CAST(row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id) AS INT) AS pos, event_id % 100 AS line, event_type AS rule_id, value > 20 AS hot FROM events),
r AS (SELECT project, rule_id, min((path, pos)) AS seen FROM f GROUP BY ALL),
rules AS (SELECT project, string_agg('{"id":"' || rule_id || '","shortDescription":{"text":"About ' || rule_id || '"}}', ',' ORDER BY seen) AS rules FROM r GROUP BY 1)
SELECT project, '{"$schema":"https://schemastore.azurewebsites.net/schemas/json/sarif-2.1.0-rtm.5.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":"riftline","version":"1","rules":[' || any_value(rules) || ']}},"results":[' ||
  string_agg('{"ruleId":"' || rule_id || '","level":"' || CASE WHEN hot THEN 'error' ELSE 'note' END || '","message":{"text":"Look"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || path || '","uriBaseId":"%SRCROOT%"},"region":{"startLine":' || line || ',"startColumn":3,"endLine":' || line || ',"endColumn":6}}}]' ||
    CASE WHEN hot THEN ',"properties":{"symbol":"s' || line || '"}' ELSE '' END || '}', ',' ORDER BY path, pos) || ']}]}' AS document
FROM f JOIN rules USING (project) GROUP BY 1""")
def sarif_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole interchange document a project."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string"), F.lit(".py"))
    hot = F.col("value") > 20
    rows = events.select(
        F.col("user_id").alias("project"), path.alias("path"), F.row_number().over(Window.partitionBy("user_id", F.col("event_id") % 3).orderBy("event_id")).alias("pos"), (F.col("event_id") % 100).alias("line"), F.lit(2).alias("col"), F.lit(5).alias("end_col"),
        F.lit(None).cast("long").alias("end_line"), F.col("event_type").alias("rule_id"), F.concat(F.lit("About "), "event_type").alias("title"), F.when(hot, "orange").otherwise("green").alias("tier"), F.lit("Look").alias("message"),
        F.when(hot, F.concat(F.lit("s"), (F.col("event_id") % 100).cast("string"))).alias("symbol"),
    )
    return sinks.sarif_documents(rows, "project", "1")
