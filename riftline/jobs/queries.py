"""Registered review queries and their equivalents in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riftline.functions import text as T
from riftline.functions.patterns import to_java
from riftline.functions.rules import ADVISORY, AST_LANGUAGES, CONTROLS, MANIFESTS, RULES, SECURITY, TEST_EXEMPT
from riftline.jobs import review as job
from riftline.jobs import tables
from riftline.operators import enrich, findings, guidelines, learnings, payloads, perfile, rollup, rulesets, scoring, signatures
from riftline.sources import diffs, sinks
from riftline.streaming import sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(map(_q, values)) + ")"


def _pattern_rows() -> str:
    rows = []
    for k, r in enumerate(RULES):
        langs = "NULL" if "*" in r.languages else "[" + ", ".join(map(_q, r.languages)) + "]"
        for j, p in enumerate(r.patterns):
            flag = "(?i)" if p.ignore_case else ""
            rows.append(f"({_q(r.rule_id)}, {k}, {j}, {_q(flag + (p.plain or p.text))}, {_q(flag + p.unless) if p.unless else 'NULL'}, {langs}, {r.raw}, {r.skip_if_ast}, {r.secret}, {_q(r.tier)}, {r.blocking}, {_q(r.title)})")
    return "VALUES " + ", ".join(rows)


_ENTROPY = "-list_sum([(len(list_filter(string_split({v}, ''), lambda y: y = x)) / len({v})) * log2(len(list_filter(string_split({v}, ''), lambda y: y = x)) / len({v})) for x in list_distinct(string_split({v}, ''))])"

#: All findings in the lines that stand before, as SQL.
_DETECTED = rf""", pats(rule_id, rule_ord, pattern_ord, pat, unless, langs, raw_text, skip_ast, secret, tier, blocking, title) AS ({_pattern_rows()}),
hits AS (
  SELECT l.file_id, l.line, l.raw, p.*, CASE WHEN raw_text THEN raw ELSE scan END AS t, regexp_extract(CASE WHEN raw_text THEN raw ELSE scan END, pat) AS m
  FROM lines l JOIN pats p ON regexp_matches(CASE WHEN raw_text THEN raw ELSE scan END, pat) AND (langs IS NULL OR list_contains(langs, language)) AND NOT (skip_ast AND language IN {_in(AST_LANGUAGES)})
  WHERE unless IS NULL OR NOT regexp_matches(CASE WHEN raw_text THEN raw ELSE scan END, unless)
), valued AS (
  SELECT *, CASE WHEN regexp_extract(m, {_q(T.QUOTED)}, 1) <> '' THEN regexp_extract(m, {_q(T.QUOTED)}, 1) ELSE m END AS v FROM hits
), accepted AS (
  SELECT * FROM valued WHERE NOT secret OR regexp_matches(m, {_q(T.KNOWN_KEY)}) OR NOT (regexp_matches(m, {_q(T.REFERENCE)}) OR regexp_full_match(v, {_q("(?i)" + T.PLACEHOLDER)}) OR (length(v) < 12 AND {_ENTROPY.format(v="v")} < 3))
), found AS (
  SELECT file_id, line, rule_id, rule_ord, tier, blocking, title, strpos(t, m) - 1 AS col, strpos(t, m) - 1 + length(m) AS end_col, trim(raw) AS code
  FROM accepted QUALIFY row_number() OVER (PARTITION BY file_id, line, rule_id ORDER BY pattern_ord) = 1
), scoped AS (
  SELECT found.* FROM found JOIN files USING (file_id) LEFT JOIN (SELECT DISTINCT file_id, line, true AS hit FROM changed) c USING (file_id, line) WHERE NOT diff_known OR hit
)
"""
FOUND = f"WITH {tables.SQL}" + _DETECTED
RANK = "CASE tier WHEN 'orange' THEN 2 WHEN 'yellow' THEN 1 ELSE 0 END"


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    code = tables.code_lines(spark, sf_dir)
    files = tables.files(spark, sf_dir)
    return code, files, tables.changed(code)


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    code, files, _ = _tables(spark, sf_dir)
    return findings.detect(tables.scanned(code, files))


def _scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only lines in scope are matched: the scope join comes before the patterns."""
    code, files, changed = _tables(spark, sf_dir)
    return findings.detect(findings.in_change(tables.scanned(code, files), files, changed))


@query(FOUND + "SELECT file_id, line, rule_id, tier, blocking, title, col, end_col, code FROM scoped")
def findings_in_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scoped(spark, sf_dir).drop("rule_ord")


@query(FOUND + "SELECT rule_id, count(*) AS n, count(DISTINCT file_id) AS files, sum(col) AS cols FROM found GROUP BY 1")
def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_id").alias("files"), F.sum("col").alias("cols"))


@query("SELECT doc_id AS file_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INT) AS line, sha1(unnest(string_split(text, chr(10)))) AS sha FROM documents")
def lines_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.explode_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text").select("file_id", "line", F.sha1("raw").alias("sha"))


@query(rf"""
WITH pats AS (SELECT unnest([{_q("(?i)" + RULES[0].patterns[-1].text)}]) AS pat), l AS (SELECT doc_id AS file_id, unnest(string_split(text, chr(10))) AS raw FROM documents),
m AS (SELECT file_id, regexp_extract(raw, pat) AS m FROM l, pats WHERE regexp_matches(raw, pat)), v AS (SELECT *, regexp_extract(m, {_q(T.QUOTED)}, 1) AS v FROM m)
SELECT file_id, m AS "match", length(v) AS size, round({_ENTROPY.format(v="v")}, 6) AS bits FROM v WHERE NOT regexp_matches(m, {_q(T.REFERENCE)}) AND NOT regexp_full_match(v, {_q("(?i)" + T.PLACEHOLDER)}) AND NOT (length(v) < 12 AND {_ENTROPY.format(v="v")} < 3)
""")
def secret_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = findings.explode_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    java = to_java(RULES[0].patterns[-1].text, True)
    found = lines.where(F.col("raw").rlike(java)).select("file_id", F.regexp_extract("raw", java, 0).alias("match")).where(T.is_secret(F.col("match")))
    value = F.regexp_extract("match", T.QUOTED, 1)
    return found.select("file_id", "match", F.length(value).alias("size"), F.round(T.entropy(value), 6).alias("bits"))


@query(f"""
WITH {tables.SQL} SELECT file_id, CASE WHEN diff_known THEN first ELSE 1 END AS line, rule_id, tier, title FROM (
  SELECT f.*, (SELECT min(line) FROM changed c WHERE c.file_id = f.file_id) AS first, 'migration-file' AS rule_id, 'orange' AS tier, 'Database migration file' AS title FROM files f WHERE regexp_matches(path, '(^|/)migrations?/')
  UNION ALL SELECT f.*, (SELECT min(line) FROM changed c WHERE c.file_id = f.file_id), 'dependency-manifest', 'yellow', 'Dependency manifest change' FROM files f WHERE parse_filename(path) IN {_in(MANIFESTS)}
) WHERE NOT diff_known OR first IS NOT NULL
""")
def file_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, files, changed = _tables(spark, sf_dir)
    return findings.file_findings(files, changed)


@query(FOUND + f"SELECT file_id, line, rule_id, col, CAST(row_number() OVER (PARTITION BY file_id ORDER BY line, {RANK} DESC, rule_id, col) AS INT) AS pos FROM scoped")
def findings_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.report_order(findings.first_wins(_scoped(spark, sf_dir))).select("file_id", "line", "rule_id", "col", "pos")


_TEST = "(regexp_matches(path, '(^|/)tests?/') OR regexp_matches(path, '\\.test\\.[a-z]+$'))"
_RETIERED = FOUND + f""", tested AS (
  SELECT s.* EXCLUDE (tier, blocking), CASE WHEN low THEN 'yellow' ELSE tier END AS tier, blocking AND NOT low AS blocking, CASE WHEN low THEN 'deescalated' END AS tier_adjusted
  FROM (SELECT scoped.*, {_TEST} AND tier = 'orange' AND rule_id NOT IN {_in(TEST_EXEMPT)} AS low FROM scoped JOIN files USING (file_id)) s
)
"""


def _tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.test_scope(_scoped(spark, sf_dir), tables.files(spark, sf_dir))


@query(_RETIERED + "SELECT file_id, line, rule_id, tier, blocking, tier_adjusted FROM tested")
def test_scope_retier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tested(spark, sf_dir).select("file_id", "line", "rule_id", "tier", "blocking", "tier_adjusted")


@query(_RETIERED + f"""SELECT file_id, count(*) FILTER (tier = 'green') AS green, count(*) FILTER (tier = 'yellow') AS yellow, count(*) FILTER (tier = 'orange') AS orange,
  CASE max({RANK}) WHEN 2 THEN 'orange' WHEN 1 THEN 'yellow' ELSE 'green' END AS tier, bool_or(blocking) AS blocking FROM tested GROUP BY 1""")
def tier_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.tiers(_tested(spark, sf_dir), "file_id")


@query(_RETIERED + f"""SELECT file_id, count(*) AS findings, bool_or(blocking OR {RANK} >= 2) AS blocked, CASE WHEN bool_or(blocking OR {RANK} >= 2) THEN 'REQUEST_CHANGES' ELSE 'COMMENT' END AS event,
  CASE WHEN bool_or(blocking OR {RANK} >= 2) THEN 'failure' ELSE 'success' END AS conclusion FROM tested GROUP BY 1""")
def review_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.gate(_tested(spark, sf_dir), "file_id")


@query(_RETIERED + "SELECT rule_id, count(*) AS n FROM tested GROUP BY 1 ORDER BY n DESC, rule_id LIMIT 10")
def top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.top_rules(_tested(spark, sf_dir))


@query(_RETIERED + "SELECT file_id, count(*) FILTER (tier = 'orange') AS orange, count(*) AS total FROM tested GROUP BY 1 ORDER BY orange DESC, total DESC, file_id LIMIT 10")
def hotspot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.hotspots(_tested(spark, sf_dir))


@query(_RETIERED + "SELECT file_id, count(*) AS total, count(*) FILTER (tier <> 'green') AS signal, count(*) FILTER (tier <> 'green') / count(*) AS ratio FROM tested GROUP BY 1")
def signal_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learnings.predicted_signal(_tested(spark, sf_dir), "file_id")


_BRIDGE = "bridge(rule_id, control_id) AS (VALUES " + ", ".join(f"({_q(r)}, {_q(c)})" for r, cs in CONTROLS.items() for c in cs) + ")"


@query(_RETIERED + f", {_BRIDGE} SELECT control_id, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules, count(*) AS findings FROM tested JOIN bridge USING (rule_id) GROUP BY 1")
def compliance_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.evidence(_tested(spark, sf_dir), rollup.controls(spark))


@query(_RETIERED + f", {_BRIDGE} SELECT DISTINCT rule_id FROM tested WHERE rule_id NOT IN (SELECT rule_id FROM bridge)")
def compliance_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.unmapped(_tested(spark, sf_dir), rollup.controls(spark))


@query(_RETIERED + f"""SELECT file_id // 10 AS review, file_id, line, rule_id, pos, greatest(n - 50, 0) AS omitted FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY file_id // 10 ORDER BY {RANK} DESC, file_id, line, rule_id) AS INT) AS pos, count(*) OVER (PARTITION BY file_id // 10) AS n FROM tested) WHERE pos <= 50""")
def review_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_review = _tested(spark, sf_dir).withColumn("review", F.expr("file_id div 10"))
    return rollup.comments(by_review, "review").select("review", "file_id", "line", "rule_id", "pos", "omitted")


@query(_RETIERED + "SELECT tier, rule_id, count(*) AS n FROM tested GROUP BY ROLLUP (tier, rule_id)")
def tier_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.tier_cube(_tested(spark, sf_dir), ["tier", "rule_id"])


_RULES = [r.rule_id for r in RULES[:6]]
_LEARN = f"""WITH {tables.SQL}, learn AS (
  SELECT rule_id || ':' || code_hash AS id, * FROM (SELECT ([{", ".join(map(_q, _RULES))}])[CAST(event_id % 6 AS INT) + 1] AS rule_id, substr(sha1(CAST(event_id % 40 AS VARCHAR)), 1, 16) AS code_hash,
    CASE WHEN value > 8 THEN 'dismiss' ELSE 'confirm' END AS verdict, date_trunc('day', ts) AS seen, event_id AS ingest_ord FROM code)
)"""


@query(_LEARN + "SELECT rule_id, code_hash, verdict, ingest_ord FROM learn QUALIFY row_number() OVER (PARTITION BY rule_id, code_hash ORDER BY seen DESC, ingest_ord DESC) = 1")
def learnings_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learnings.latest(tables.learnings(spark, sf_dir, _RULES)).select("rule_id", "code_hash", "verdict", "ingest_ord")


_STORES = _LEARN + """, ours AS (SELECT * FROM learn WHERE ingest_ord % 2 = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY seen DESC, ingest_ord DESC) = 1),
theirs AS (SELECT * FROM learn WHERE ingest_ord % 3 = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY seen DESC, ingest_ord DESC) = 1)"""


def _stores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    every = tables.learnings(spark, sf_dir, _RULES)
    return learnings.latest(every.where("ingest_ord % 2 = 0")), learnings.latest(every.where("ingest_ord % 3 = 0"))


@query(_STORES + " SELECT coalesce(o.id, t.id) AS id, CASE WHEN o.id IS NULL OR t.seen > o.seen THEN t.ingest_ord ELSE o.ingest_ord END AS ingest_ord FROM ours o FULL JOIN theirs t ON o.id = t.id")
def learnings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learnings.merge(*_stores(spark, sf_dir)).select("id", "ingest_ord")


@query(_STORES + " SELECT coalesce(o.id, t.id) AS id, coalesce(o.ingest_ord, t.ingest_ord) AS ingest_ord, CASE WHEN o.id IS NULL THEN 1 ELSE 0 END AS priority FROM ours o FULL JOIN theirs t ON o.id = t.id")
def learnings_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learnings.shared_union(*_stores(spark, sf_dir)).select("id", "ingest_ord", "priority")


@query(_LEARN + """SELECT rule_id, count(*) FILTER (verdict = 'confirm') AS confirmed, count(*) FILTER (verdict = 'dismiss') AS dismissed, count(*) FILTER (verdict = 'dismiss') / count(*) AS dismiss_rate,
  count(*) FILTER (verdict = 'dismiss') >= 3 AND count(*) FILTER (verdict = 'dismiss') / count(*) >= 0.7 AS chronic FROM learn GROUP BY 1""")
def signal_realized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learnings.realized_signal(tables.learnings(spark, sf_dir, _RULES))


@query(FOUND + "SELECT file_id, line, rule_id FROM scoped WHERE (rule_id, substr(sha1(code), 1, 16)) NOT IN (SELECT rule_id, substr(sha1(code), 1, 16) FROM scoped WHERE file_id % 4 = 1)")
def suppressed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _scoped(spark, sf_dir)
    store = found.where("file_id % 4 = 1").select("rule_id", T.code_hash(F.col("code")).alias("code_hash"), F.lit("dismiss").alias("verdict"))
    return learnings.suppress(found, store).select("file_id", "line", "rule_id")


_DEPRECATED = "(VALUES " + ", ".join(f"({_q(a)}, {_q(b)})" for a, b in tables.DEPRECATED) + ") AS d(name, replaced_by)"


@query(f"WITH {tables.SQL} SELECT file_id, line, name, replaced_by FROM (SELECT DISTINCT file_id, line, unnest(regexp_extract_all(scan, '([A-Za-z_$][A-Za-z0-9_$]*(?:\\.[A-Za-z_$][A-Za-z0-9_$]*)*)\\s*\\(', 1)) AS name FROM lines) JOIN {_DEPRECATED} USING (name)")
def deprecated_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    code, files, _ = _tables(spark, sf_dir)
    return findings.deprecated_calls(tables.scanned(code, files), spark.createDataFrame(list(tables.DEPRECATED), "name string, replaced_by string"))


@query(f"WITH {tables.SQL} SELECT file_id, line, substr(trim(raw), 1, 200) AS text FROM lines WHERE regexp_matches(raw, '\\beval\\b') ORDER BY file_id, line LIMIT 40")
def find_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    code, _, _ = _tables(spark, sf_dir)
    return findings.references(code, "eval")


_EDGES = "edges AS (SELECT 'mod' || CAST(l_partkey % 7 AS VARCHAR) || '.fn' || CAST(l_partkey AS VARCHAR) AS symbol, 'f' || CAST(l_suppkey AS VARCHAR) AS caller_file, l_linenumber AS caller_line, l_quantity AS weight, 'u' || CAST(l_orderkey % 50 AS VARCHAR) AS reviewer FROM lineitem)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select(F.concat(F.lit("mod"), (F.col("l_partkey") % 7).cast("string"), F.lit(".fn"), F.col("l_partkey").cast("string")).alias("symbol"), F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("caller_file"), F.col("l_linenumber").alias("caller_line"), F.col("l_quantity").alias("weight"), F.concat(F.lit("u"), (F.col("l_orderkey") % 50).cast("string")).alias("reviewer"))


_IMPACT = f"""WITH {_EDGES}, d AS (SELECT DISTINCT symbol, caller_file, caller_line FROM edges), impact AS (SELECT symbol, count(*) AS caller_count, count(DISTINCT caller_file) AS files, count(*) > 20 AS truncated FROM d GROUP BY 1),
shown AS (SELECT symbol, string_agg(caller_file || ':' || CAST(caller_line AS VARCHAR), ' ' ORDER BY caller_file, caller_line) AS callers FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY caller_file, caller_line) AS n FROM d) WHERE n <= 20 GROUP BY 1)"""


@query(_IMPACT + " SELECT symbol, caller_count, files, truncated, callers FROM impact JOIN shown USING (symbol)")
def impact_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.array_join(F.transform("callers", lambda c: F.concat_ws(":", c["caller_file"], c["caller_line"].cast("string"))), " ")
    return enrich.impact_of(_edges(spark, sf_dir)).select("symbol", "caller_count", "files", "truncated", shown.alias("callers"))


_REVIEWERS = ", r AS (SELECT symbol, list(reviewer ORDER BY n) AS reviewers FROM (SELECT symbol, reviewer, row_number() OVER (PARTITION BY symbol ORDER BY max(weight) DESC, reviewer) AS n FROM edges GROUP BY symbol, reviewer) WHERE n <= 3 GROUP BY 1)"


@query(_IMPACT + _REVIEWERS + """ SELECT symbol, 'Blast radius: ' || caller_count || CASE WHEN truncated THEN '+' ELSE '' END || ' call site' || CASE WHEN caller_count = 1 THEN '' ELSE 's' END || ' across ' || files || ' file' || CASE WHEN files = 1 THEN '' ELSE 's' END
  || ' · route: ' || array_to_string(['@' || x for x in reviewers], ', ') || '.' AS summary FROM impact JOIN r USING (symbol)""")
def blast_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    both = enrich.impact_of(edges).join(enrich.top_reviewers(edges), "symbol")
    return both.select("symbol", enrich.blast_summary(F.col("caller_count"), F.col("truncated"), F.col("files"), F.col("reviewers")).alias("summary"))


_GRAPH = """, graph AS (SELECT symbol, caller_count, files, CASE WHEN caller_count % 2 = 0 THEN 'codegraph' ELSE 'search' END AS source FROM impact
  UNION ALL SELECT 'none.z' || p_partkey, 0, 0, CASE WHEN p_partkey % 2 = 0 THEN 'codegraph' ELSE 'search' END FROM part WHERE p_partkey % 11 = 0)"""
_SYMBOLS = """, f AS (SELECT p_partkey AS file_id, CASE WHEN p_partkey % 5 = 0 THEN 'raw-query' WHEN p_partkey % 7 = 0 THEN 'signature-drift' ELSE 'public-api-change' END AS rule_id,
  CASE WHEN p_partkey % 11 = 0 THEN 'none.z' || p_partkey WHEN p_partkey % 2 = 0 THEN 'x.fn' || p_partkey ELSE 'mod' || CAST(p_partkey % 7 AS VARCHAR) || '.fn' || p_partkey END AS symbol, 'orange' AS tier FROM part)"""


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    name = F.when(F.col("p_partkey") % 11 == 0, F.concat(F.lit("none.z"), key)).when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("x.fn"), key)).otherwise(F.concat(F.lit("mod"), (F.col("p_partkey") % 7).cast("string"), F.lit(".fn"), key))
    rule = F.when(F.col("p_partkey") % 5 == 0, "raw-query").when(F.col("p_partkey") % 7 == 0, "signature-drift").otherwise("public-api-change")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("file_id"), rule.alias("rule_id"), name.alias("symbol"), F.lit("orange").alias("tier"))


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact of two sources; some symbols have no caller by one or the other."""
    source = lambda n: F.when(n % 2 == 0, "codegraph").otherwise("search").alias("source")
    counted = enrich.impact_of(_edges(spark, sf_dir)).select("symbol", "caller_count", "files", source(F.col("caller_count")))
    unused = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 11 = 0")
    return counted.unionByName(unused.select(F.concat(F.lit("none.z"), F.col("p_partkey").cast("string")).alias("symbol"), F.lit(0).alias("caller_count"), F.lit(0).alias("files"), source(F.col("p_partkey"))))


@query(_IMPACT + _GRAPH + _SYMBOLS + """,
j AS (SELECT f.*, coalesce(e.caller_count, b.caller_count) AS caller_count, CASE WHEN e.symbol IS NOT NULL THEN e.source ELSE b.source END AS source FROM f LEFT JOIN graph e ON e.symbol = f.symbol
  LEFT JOIN (SELECT string_split(symbol, '.')[2] AS bare, arg_min(caller_count, symbol) AS caller_count, arg_min(source, symbol) AS source FROM graph GROUP BY 1) b ON b.bare = string_split(f.symbol, '.')[2]),
k AS (SELECT *, rule_id <> 'raw-query' AND caller_count = 0 AND source = 'codegraph' AS low, rule_id <> 'raw-query' AND caller_count >= 30 AS high FROM j)
SELECT file_id, rule_id, symbol, caller_count, source AS impact_source, CASE WHEN low THEN 'yellow' ELSE 'orange' END AS tier, CASE WHEN low THEN 'deescalated' WHEN high THEN 'escalated' END AS tier_adjusted FROM k""")
def impact_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = enrich.attach_impact(_symbols(spark, sf_dir), _graph(spark, sf_dir))
    return enrich.impact_tier(found, 30).select("file_id", "rule_id", "symbol", "caller_count", "impact_source", "tier", "tier_adjusted")


@query("WITH p AS (SELECT 1)" + _SYMBOLS + """, stale AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'fn' || p_partkey ELSE 'other.fn' || p_partkey END AS symbol FROM part WHERE p_partkey % 3 = 0)
SELECT file_id, symbol, symbol IN (SELECT symbol FROM stale) OR string_split(symbol, '.')[2] IN (SELECT symbol FROM stale UNION ALL SELECT string_split(symbol, '.')[2] FROM stale WHERE symbol LIKE '%.%') AS stale_doc FROM f""")
def stale_doc_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    stale = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 3 = 0").select(F.concat(F.when(F.col("p_partkey") % 2 == 0, "fn").otherwise("other.fn"), key).alias("symbol"))
    return enrich.stale_docs(_symbols(spark, sf_dir), stale).select("file_id", "symbol", "stale_doc")


_TAINT = _RETIERED + f""", tainted AS (
  SELECT t.* EXCLUDE (tier, blocking, tier_adjusted, source), CASE WHEN lowered THEN 'yellow' ELSE tier END AS tier, blocking AND NOT lowered AS blocking, CASE WHEN lowered THEN 'deescalated' ELSE tier_adjusted END AS tier_adjusted,
    CASE WHEN tainted THEN CASE WHEN line % 2 = 0 THEN 'Taint path: a' || file_id || ' → b.' ELSE 'Taint path confirmed by the code graph.' END END AS trace
  FROM (SELECT *, coalesce(tainted = false AND source = 'codegraph' AND rule_id <> 'dangerous-exec', false) AS lowered FROM (
    SELECT *, CASE WHEN rule_id IN {_in(SECURITY)} AND line % 3 < 2 THEN line % 3 = 0 END AS tainted, CASE WHEN line % 5 < 3 THEN 'codegraph' ELSE 'search' END AS source FROM tested)) t
), trusted AS (SELECT *, CASE WHEN rule_id IN {_in(SECURITY)} THEN CASE WHEN tainted THEN 'confirmed' WHEN NOT tainted THEN 'cleared' ELSE 'unconfirmed' END ELSE 'confirmed' END AS trust FROM tainted),
rungs AS (SELECT *, CASE WHEN blocking OR (rule_id IN {_in(SECURITY)} AND trust = 'confirmed') THEN 'block' WHEN tier_adjusted = 'escalated' THEN 'escalate' WHEN {RANK} >= 2 THEN 'autofix' ELSE 'advisory' END AS rung FROM trusted)
"""


def _rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of two sources; the caller opts in to lowering, but for one pinned rule."""
    code, _, _ = _tables(spark, sf_dir)
    flow = F.when(F.col("line") % 2 == 0, F.array(F.concat(F.lit("a"), F.col("file_id").cast("string")), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    source = F.when(F.col("line") % 5 < 3, "codegraph").otherwise("search")
    verdicts = code.where("line % 3 < 2").select("file_id", "line", F.explode(F.array(*map(F.lit, SECURITY))).alias("rule_id"), (F.col("line") % 3 == 0).alias("tainted"), flow.alias("data_flow"), source.alias("source"))
    return enrich.rung(enrich.trust(enrich.attach_taint(_tested(spark, sf_dir), verdicts, lower=True, pinned=["dangerous-exec"])))


@query(_TAINT + "SELECT file_id, line, rule_id, tier, blocking, tier_adjusted, trace, coalesce(CAST(tainted AS VARCHAR), 'unknown') AS tainted, trust, rung FROM rungs")
def security_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rungs(spark, sf_dir).select("file_id", "line", "rule_id", "tier", "blocking", "tier_adjusted", "trace", F.coalesce(F.col("tainted").cast("string"), F.lit("unknown")).alias("tainted"), "trust", "rung")


@query(_TAINT + """SELECT file_id, CASE WHEN bool_or(rung = 'block') THEN 'blocked' WHEN bool_or(rung IN ('escalate', 'autofix')) THEN 'review' ELSE 'pass' END AS advisory,
  CASE WHEN bool_or(rung = 'block') OR count(*) FILTER (tier = 'orange') > 0 THEN 'blocked' ELSE 'pass' END AS gated, 'pass' AS off FROM rungs GROUP BY 1""")
def agent_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.verdicts(_rungs(spark, sf_dir), "file_id")


@query(_TAINT + """SELECT file_id, line, rule_id, CASE WHEN n > 2 AND rung IN ('autofix', 'advisory') THEN 'escalate' ELSE rung END AS rung, n > 2 AS over_budget
  FROM (SELECT *, count(*) OVER (PARTITION BY file_id, rule_id, code) AS n FROM rungs)""")
def over_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = _rungs(spark, sf_dir).withColumn("fingerprint", T.fingerprint(F.col("file_id"), F.col("rule_id"), F.col("code")))
    over = marked.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    return enrich.over_budget(marked, over).select("file_id", "line", "rule_id", "rung", "over_budget")


_EXPECT = "expected AS (SELECT CAST(event_id AS BIGINT) AS \"case\", e.rule_id FROM code JOIN (VALUES " + ", ".join(f"({k}, {_q(v)})" for k, v in tables.EXPECTED.items()) + ") AS e(template, rule_id) USING (template))"
_CASES = FOUND + f""", {_EXPECT}, cased AS (SELECT c.event_id AS "case", f.rule_id, f.tier, f.blocking FROM found f JOIN code c USING (file_id, line)),
outcomes AS (SELECT coalesce(f."case", e."case") AS "case", coalesce(f.rule_id, e.rule_id) AS rule_id, CASE WHEN f.rule_id IS NOT NULL AND e.rule_id IS NOT NULL THEN 'tp' WHEN f.rule_id IS NOT NULL THEN 'fp' ELSE 'fn' END AS outcome
  FROM (SELECT DISTINCT "case", rule_id FROM cased WHERE "case" IN (SELECT "case" FROM expected)) f FULL JOIN expected e ON e."case" = f."case" AND e.rule_id = f.rule_id)
"""


def _cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    code = tables.code_lines(spark, sf_dir)
    found = _found(spark, sf_dir).join(code.select("file_id", "line", F.col("event_id").alias("case")), ["file_id", "line"])
    known = F.create_map(*[F.lit(x) for k, v in tables.EXPECTED.items() for x in (k, v)])
    cases = code.select(F.col("event_id").alias("case"), known[F.col("template")].alias("rule_id"))
    return found, cases, cases.where("rule_id IS NOT NULL")


@query(_CASES + """, n AS (SELECT rule_id, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn FROM outcomes GROUP BY rule_id
  UNION ALL SELECT '*', count(*) FILTER (outcome = 'tp'), count(*) FILTER (outcome = 'fp'), count(*) FILTER (outcome = 'fn') FROM outcomes),
s AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fn) END AS r FROM n)
SELECT rule_id, tp, fp, fn, round(p, 3) AS "precision", round(r, 3) AS recall, round(CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE 2 * p * r / (p + r) END, 3) AS f1 FROM s""")
def bench_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _, expected = _cases(spark, sf_dir)
    return scoring.precision_recall(scoring.confusion(found, expected))


@query(_CASES + """, clean AS (SELECT event_id AS "case" FROM code WHERE event_id NOT IN (SELECT "case" FROM expected)),
n AS (SELECT count(DISTINCT c."case") AS clean_cases, count(*) FILTER (tier = 'orange' OR blocking) AS blocks, count(*) FILTER (tier IS NOT NULL AND NOT (tier = 'orange' OR blocking)) AS advisories FROM clean c LEFT JOIN cased f ON f."case" = c."case")
SELECT *, round(blocks / clean_cases, 3) AS blocks_per_case, round(advisories / clean_cases, 3) AS advisories_per_case FROM n""")
def bench_clean_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, cases, expected = _cases(spark, sf_dir)
    return scoring.clean_noise(found, cases, expected)


_TRIALS = """WITH trials AS (SELECT event_id % 17 AS scenario, event_type AS mode, CASE WHEN value > 30 THEN 'error' WHEN value > 12 THEN 'defect' WHEN value > 6 THEN 'advisory' ELSE 'clean' END AS kind, event_id % 17 IN (3, 11) AS known_gap,
  ['sql-injection', 'rule' || CAST(event_id % 3 AS VARCHAR)] AS target_rules, CASE WHEN value > 12 THEN ['rule' || CAST(event_id % 5 AS VARCHAR)] ELSE []::VARCHAR[] END AS fired_rules FROM events)"""


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("value") > 30, "error").when(F.col("value") > 12, "defect").when(F.col("value") > 6, "advisory").otherwise("clean")
    name = lambda m: F.concat(F.lit("rule"), (F.col("event_id") % m).cast("string"))
    return e.select((F.col("event_id") % 17).alias("scenario"), F.col("event_type").alias("mode"), kind.alias("kind"), (F.col("event_id") % 17).isin(3, 11).alias("known_gap"), F.array(F.lit("sql-injection"), name(3)).alias("target_rules"), F.when(F.col("value") > 12, F.array(name(5))).otherwise(F.array().cast("array<string>")).alias("fired_rules"))


@query(_TRIALS + """, n AS (SELECT mode, count(*) AS scored, count(*) FILTER (kind = 'defect') AS defects, count(*) FILTER (kind = 'advisory') AS advisories FROM trials WHERE kind <> 'error' AND NOT known_gap GROUP BY 1),
w AS (SELECT *, defects / scored AS p, 1.96 * 1.96 AS zz FROM n)
SELECT mode, scored, defects, round(p, 3) AS defect_rate, round(advisories / scored, 3) AS advisory_rate, round(greatest((p + zz / (2 * scored) - 1.96 * sqrt(p * (1 - p) / scored + zz / (4 * scored * scored))) / (1 + zz / scored), 0), 3) AS low,
  round(least((p + zz / (2 * scored) + 1.96 * sqrt(p * (1 - p) / scored + zz / (4 * scored * scored))) / (1 + zz / scored), 1), 3) AS high FROM w""")
def marginal_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.rates(_trials(spark, sf_dir), "mode")


@query(_TRIALS + """, aimed AS (SELECT DISTINCT scenario, unnest(target_rules) AS rule_id FROM trials), caught AS (SELECT DISTINCT scenario, unnest(fired_rules) AS rule_id, true AS c FROM trials WHERE kind <> 'error')
SELECT rule_id, count(*) AS targeting, count(*) FILTER (c) AS caught FROM aimed LEFT JOIN caught USING (scenario, rule_id) GROUP BY 1""")
def rule_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.coverage(_trials(spark, sf_dir))


@query(f"""WITH {tables.SQL}, near AS (SELECT DISTINCT file_id, unnest([line - 1, line, line + 1]) AS line FROM changed),
k AS (SELECT l.file_id, l.line, l.raw, row_number() OVER (PARTITION BY l.file_id ORDER BY l.line) AS n, lag(l.line) OVER (PARTITION BY l.file_id ORDER BY l.line) AS before FROM code l JOIN near USING (file_id, line))
SELECT file_id, sha1(string_agg(CASE WHEN line - before > 1 THEN '...' || chr(10) ELSE '' END || raw, chr(10) ORDER BY line)) AS sha FROM k WHERE n <= 50 GROUP BY 1""")
def change_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    code, _, changed = _tables(spark, sf_dir)
    return findings.snippets(code.select("file_id", "line", "raw"), changed).select("file_id", F.sha1("snippet").alias("sha"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS file_id, line FROM (SELECT DISTINCT l_orderkey, l_linenumber, CAST(unnest(CASE WHEN n = 0 THEN [greatest(s, 1)] ELSE range(s, s + n) END) AS INT) AS line
  FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 300 AS BIGINT) AS s, CAST(l_quantity AS BIGINT) % 4 AS n FROM lineitem))""")
def hunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    size = F.col("l_quantity").cast("bigint") % 4
    head = F.concat(F.lit("diff --git a/f b/f\n@@ -3,2 +"), (F.col("l_partkey") % 300).cast("string"), F.when(size == 1, "").otherwise(F.concat(F.lit(","), size.cast("string"))), F.lit(" @@ def\n+ x"))
    return diffs.hunk_lines(t.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("file_id"), head.alias("diff")), "file_id", "diff")


@query(_RETIERED + r"""SELECT file_id, line, rule_id, '::' || CASE tier WHEN 'orange' THEN 'error' WHEN 'yellow' THEN 'warning' ELSE 'notice' END || ' file=' || path || ',line=' || line || ',title=' || replace(title, ',', '%2C') || '::' || rule_id AS command FROM tested JOIN files USING (file_id)""")
def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.annotations(_tested(spark, sf_dir).join(tables.files(spark, sf_dir).select("file_id", "path"), "file_id"))


@query(_RETIERED + r"""SELECT file_id, line, rule_id, col, '{"ruleId":"' || rule_id || '","level":"' || CASE tier WHEN 'orange' THEN 'error' WHEN 'yellow' THEN 'warning' ELSE 'note' END || '","message":{"text":"' || title || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || path
  || '"},"region":{"startLine":' || line || ',"startColumn":' || (col + 1) || ',"endLine":' || line || ',"endColumn":' || (end_col + 1) || '}}}]}' AS result FROM tested JOIN files USING (file_id)""")
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.sarif_results(_tested(spark, sf_dir).join(tables.files(spark, sf_dir).select("file_id", "path"), "file_id"))


@query(_RETIERED + "SELECT rule_id, arg_min(title, rule_ord) AS title FROM tested GROUP BY 1")
def rule_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.rule_titles(_tested(spark, sf_dir))


_TURNS = "turns AS (SELECT user_id AS session_id, ts, event_id AS turn_id, event_type AS fingerprint FROM events)"


@query(f"""WITH {_TURNS}, g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY session_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM turns), s AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT session_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS turns, count(DISTINCT fingerprint) AS findings FROM s GROUP BY session_id, k""")
def session_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.windows(_turns(spark, sf_dir), "6 hours")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("session_id"), "ts", F.col("event_id").alias("turn_id"), F.col("event_type").alias("fingerprint"))


@query()
def mask_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files: their lines in order as one text, masked."""
    code, files, _ = _tables(spark, sf_dir)
    text = code.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "raw"))), lambda x: x["raw"]), "\n").alias("text"))
    return text.join(files, "file_id").select("file_id", "language", perfile.mask(F.col("text"), F.col("language")).alias("masked"))


@query()
def lcs_changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = tables.versions(spark, sf_dir)
    return perfile.line_diff(pairs, "old", "new").select("doc_id", F.explode("changed").alias("line"))


@query("""WITH v AS (SELECT doc_id, text, lag(text) OVER (PARTITION BY string_split(text, chr(10))[1] ORDER BY doc_id) AS old FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(list_filter(list_distinct(string_split(text, chr(10))), lambda x: NOT list_contains(string_split(old, chr(10)), x))) AS new_lines FROM v WHERE old IS NOT NULL""")
def new_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the new version that the old one does not have at all."""
    pairs = tables.versions(spark, sf_dir)
    return pairs.select("doc_id", F.size(F.array_except(F.split("new", "\n"), F.split("old", "\n"))).alias("new_lines"))


_GUIDES = "guides(dir, name, name_ord) AS (VALUES ('', 'A.md', 0), ('', 'B.md', 1)" + "".join(f", ('src{k}', 'A.md', 0)" for k in range(0, 20, 2)) + "".join(f", ('src{k}/{g}', 'B.md', 1), ('src{k}/{g}/d1', 'A.md', 0)" for k in range(0, 20, 3) for g in ("en", "fr")) + ")"
_RESOLVED = f"""WITH {_GUIDES}, f AS (SELECT doc_id AS file_id, [source || '/' || lang || '/d' || CAST(doc_id % 3 AS VARCHAR), source || '/' || lang, source, ''] AS dirs FROM documents),
u AS (SELECT file_id, unnest(dirs) AS dir, generate_subscripts(dirs, 1) AS up FROM f),
resolved AS (SELECT file_id, dir, name, CAST(row_number() OVER (PARTITION BY file_id ORDER BY up, name_ord) AS INT) AS pos, count(*) OVER (PARTITION BY file_id) AS n FROM u JOIN guides USING (dir))"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = docs.select(F.col("doc_id").alias("file_id"), F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), (F.col("doc_id") % 3).cast("string")), F.lit("f.py")).alias("path"))
    rows = [("", "A.md", 0), ("", "B.md", 1), *((f"src{k}", "A.md", 0) for k in range(0, 20, 2)), *(r for k in range(0, 20, 3) for g in ("en", "fr") for r in ((f"src{k}/{g}", "B.md", 1), (f"src{k}/{g}/d1", "A.md", 0)))]
    return guidelines.resolve(files, spark.createDataFrame(rows, "dir string, name string, name_ord int"), 3)


@query(_RESOLVED + " SELECT file_id, dir, name, pos, n <= 3 OR pos <= 2 OR pos = n AS kept FROM resolved")
def guideline_depth_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)


@query(_RESOLVED + """ SELECT sources, count(*) AS files FROM (SELECT file_id, string_agg(CASE WHEN dir <> '' THEN dir || '/' ELSE '' END || name, ' ' ORDER BY pos) AS sources FROM resolved WHERE n <= 3 OR pos <= 2 OR pos = n GROUP BY file_id) GROUP BY 1""")
def guideline_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guidelines.groups(_resolved(spark, sf_dir))


#: Old parameters, new parameters, and how both are written.
SIGNATURES = (("a, b", "a, b", "a,b", "a,b"), ("a", "a, b = 1", "a", "a,b="), ("{ x, y }, z", "opts, z", "{…},z", "opts,z"), ("...rest", "first, ...rest", "...rest", "first,...rest"), ("a?: string", "a: string", "a?", "a"), ("", "cb = () => 1", "", "cb="))


@query(f"""SELECT event_id AS file_id, 'run' || CAST(user_id AS VARCHAR) AS name, ([{", ".join(_q(s[2]) for s in SIGNATURES)}])[CAST(event_id % 6 AS INT) + 1] AS old_params, ([{", ".join(_q(s[3]) for s in SIGNATURES)}])[CAST(event_id % 6 AS INT) + 1] AS params
FROM events WHERE event_id % 6 <> 0""")
def signature_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")

    def text(k: int):
        params = F.get(F.array(*[F.lit(s[k]) for s in SIGNATURES]), (F.col("event_id") % 6).cast("int"))
        return F.concat(F.lit("// v\nexport async function run"), F.col("user_id").cast("string"), F.lit("("), params, F.lit(") {\n}\n"))

    files = events.select("event_id", text(0).alias("old"), text(1).alias("new"))
    return signatures.drift(signatures.exported(files, "event_id", "old"), signatures.exported(files, "event_id", "new"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 2 THEN 7 ELSE 2 END AS caller_count, 'f' || o_custkey || ' g' AS callers,
  CASE WHEN o_orderkey % 4 = 3 THEN 'a b' ELSE 'heavy light' END AS reviewers FROM orders""")
def graph_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    f = F.concat(F.lit("f"), F.col("o_custkey").cast("string"))
    people = F.lit('[{"name":"light","weight":1},{"author":"heavy","lines_owned":9},"light"]')
    forms = F.array(
        F.concat(F.lit('{"callers":[{"symbol":"'), f, F.lit('"},"g"],"reviewers":'), people, F.lit("}")),
        F.concat(F.lit('{"impact":{"callsites":[{"file":"file://'), f, F.lit('","line":3},{"name":"g"}],"owners":'), people, F.lit("}}")),
        F.concat(F.lit('{"callerCount":7,"direct_callers":"'), f, F.lit(', g","suggestedReviewers":'), people, F.lit("}")),
        F.concat(F.lit('{"data":{"references":["'), f, F.lit('","g"]},"codeowners":"a, b, a"}')),
    )
    found = payloads.impact(orders.select(F.col("o_orderkey").alias("id"), F.get(forms, (F.col("o_orderkey") % 4).cast("int")).alias("payload")), "id", "payload")
    return found.select("id", "caller_count", F.array_join("callers", " ").alias("callers"), F.array_join("reviewers", " ").alias("reviewers"))


#: Documents as whole files: text without comments, some in test folders, all three states of a diff.
_DOC_FILES = """WITH files AS (SELECT doc_id AS file_id, CASE WHEN doc_id % 4 = 0 THEN 'tests/' ELSE 'src/' END || doc_id || '.txt' AS path, doc_id % 3 <> 0 AS diff_known, 'unknown' AS language FROM documents),
lines AS (SELECT doc_id AS file_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INT) AS line, unnest(string_split(text, chr(10))) AS raw, unnest(string_split(text, chr(10))) AS scan, 'unknown' AS language FROM documents),
changed AS (SELECT file_id, line FROM lines WHERE line % 2 = 1 AND file_id % 9 <> 1)
"""
_REVIEWED = _DOC_FILES + _DETECTED + f""", reviewed AS (
  SELECT s.* EXCLUDE (tier, blocking), CASE WHEN low THEN 'yellow' ELSE tier END AS tier, blocking AND NOT low AS blocking FROM (SELECT scoped.*, path LIKE 'tests/%' AND tier = 'orange' AND rule_id NOT IN {_in(TEST_EXEMPT)} AS low FROM scoped JOIN files USING (file_id)) s
), placed AS (SELECT *, CASE WHEN rule_id IN {_in(SECURITY)} THEN 'unconfirmed' ELSE 'confirmed' END AS trust, CAST(row_number() OVER (PARTITION BY file_id ORDER BY line, {RANK} DESC, rule_id, col) AS INT) AS pos FROM reviewed
  WHERE (rule_id, code) NOT IN (SELECT rule_id, code FROM reviewed WHERE file_id % 10 = 3))
"""


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole review; what a tenth of the files holds has been dismissed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat(F.when(F.col("doc_id") % 4 == 0, "tests/").otherwise("src/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    files = docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text", (F.col("doc_id") % 3 != 0).alias("diff_known"))
    changed = findings.explode_lines(docs, "doc_id", "text").where("line % 2 = 1 AND file_id % 9 <> 1").select("file_id", "line")
    dismissed = job.review(files.where("file_id % 10 = 3"), changed).select("rule_id", T.code_hash(F.col("code")).alias("code_hash"), F.lit("dismiss").alias("verdict"))
    return job.review(files, changed, dismissed).select("file_id", "line", "col", "rule_id", "tier", "blocking", "code", "trust", "pos")


@query(_REVIEWED + "SELECT file_id, line, col, rule_id, tier, blocking, code, trust, pos FROM placed")
def review_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviewed(spark, sf_dir)


@query(_REVIEWED + f"""SELECT file_id, '{{"tier":"' || CASE max({RANK}) WHEN 2 THEN 'orange' WHEN 1 THEN 'yellow' ELSE 'green' END || '","blocking":' || bool_or(blocking) || ',"findings":[' ||
  string_agg('{{"line":' || line || ',"col":' || col || ',"rule_id":"' || rule_id || '","tier":"' || tier || '","blocking":' || blocking || '}}', ',' ORDER BY pos) || ']}}' AS review FROM placed GROUP BY 1""")
def review_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job.documents(_reviewed(spark, sf_dir))


@query(FOUND + "SELECT file_id, line, sha1(string_agg(raw, chr(10) ORDER BY place)) AS sha FROM (SELECT DISTINCT s.file_id, s.line, c.line AS place, c.raw FROM scoped s JOIN code c ON c.file_id = s.file_id AND c.line BETWEEN s.line - 4 AND s.line + 4) GROUP BY ALL")
def code_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    code, _, _ = _tables(spark, sf_dir)
    return findings.code_around(_scoped(spark, sf_dir), code).select("file_id", "line", F.sha1("around").alias("sha"))


@query("""WITH o AS (SELECT user_id AS file_id, count(*) FILTER (value > 20) AS n FROM events WHERE user_id % 3 = 0 GROUP BY 1), s AS (SELECT user_id AS file_id, count(*) FILTER (value > 10) AS n FROM events WHERE user_id % 2 = 0 GROUP BY 1)
SELECT * FROM (SELECT coalesce(o.file_id, s.file_id) AS file_id, coalesce(o.n, s.n) AS n, CASE WHEN o.n IS NOT NULL THEN 'opened' ELSE 'stored' END AS origin FROM o FULL JOIN s ON o.file_id = s.file_id) WHERE n > 0""")
def open_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    part = lambda m, least: events.where(F.col("user_id") % m == 0).groupBy(F.col("user_id").alias("file_id")).agg(F.count_if(F.col("value") > least).alias("n"))
    return findings.open_first(part(3, 20), part(2, 10))


@query("SELECT DISTINCT event_id // 3 AS file_id FROM events WHERE event_type = 'error' AND event_id // 3 NOT IN (SELECT event_id // 3 FROM events WHERE value > 10)")
def left_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("file_id", F.expr("event_id div 3"))
    return findings.left_the_change(rows.where("event_type = 'error'"), rows.where("value > 10"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'yellow' WHEN 'purchase' THEN 'green' ELSE 'yellow' END AS yellow_cap, CASE event_type WHEN 'error' THEN 'orange' WHEN 'purchase' THEN 'green' ELSE 'yellow' END AS orange_cap FROM events""")
def severity_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("event_type") == "purchase", "info").otherwise(F.col("event_type"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", *[T.capped_tier(severity, c).alias(f"{c}_cap") for c in ("yellow", "orange")])


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'likely-safe' WHEN 1 THEN 'confirmed-risk' WHEN 2 THEN 'confirmed-risk' ELSE 'needs-human' END AS verdict, CASE WHEN turn % 2 = 0 THEN 2 ELSE 0 END AS listed FROM conversations""")
def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts and lists of findings in replies of a model, around the given text."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\[\]]", "")
    forms = F.array(F.lit("**Verdict:** Likely-Safe though confirmed-risk"), F.lit("verdict: CONFIRMED-RISK"), F.lit("first confirmed-risk, then likely-safe"), F.lit("unclear"))
    tail = F.when(F.col("turn") % 2 == 0, F.lit(' [{"file":"a","line":"1"},{"file":"b"}] end')).otherwise(F.lit(" [{broken ]"))
    reply = F.concat(plain, F.lit("\n"), F.get(forms, (F.col("turn") % 4).cast("int")), tail)
    return rows.select("conv_id", "turn", T.verdict_class(reply).alias("verdict"), F.size(T.json_list(reply)).alias("listed"))


@query(FOUND + f""", cased AS (SELECT c.event_id AS trial, f.rule_id, f.tier, f.blocking FROM found f JOIN code c USING (file_id, line)), trials AS (SELECT event_id AS trial, CASE WHEN event_id % 2 = 0 THEN ['auth-crypto', 'db-schema-destructive'] ELSE ['hardcoded-secret'] END AS target_rules, value > 30 AS failed FROM code),
risk AS (SELECT DISTINCT unnest(target_rules) AS rule_id FROM trials UNION SELECT unnest([{", ".join(map(_q, SECURITY))}])),
fired AS (SELECT trial, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS fired, bool_or(rule_id NOT IN {_in(ADVISORY)}) AS defect FROM cased WHERE (tier = 'orange' OR blocking) AND rule_id IN (SELECT rule_id FROM risk) GROUP BY 1)
SELECT trial, coalesce(fired, '') AS fired, CASE WHEN failed THEN 'error' WHEN defect THEN 'defect' WHEN defect IS NOT NULL THEN 'advisory' ELSE 'clean' END AS kind FROM trials LEFT JOIN fired USING (trial)""")
def trial_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = tables.code_lines(spark, sf_dir)
    found = _found(spark, sf_dir).join(code.select("file_id", "line", F.col("event_id").alias("trial")), ["file_id", "line"])
    targets = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("auth-crypto"), F.lit("db-schema-destructive"))).otherwise(F.array(F.lit("hardcoded-secret")))
    trials = code.select(F.col("event_id").alias("trial"), targets.alias("target_rules"), (F.col("value") > 30).alias("failed"))
    return scoring.classify_trials(trials, found).select("trial", F.array_join("fired", ",").alias("fired"), "kind")


_PACKED = "CASE " + " ".join(f"WHEN rule_id IN {_in(of)} THEN {_q(p)}" for p, of in rulesets.PACKS.items()) + " END"


@query(FOUND + f""", cat AS (SELECT DISTINCT rule_id, tier, title, blocking FROM pats UNION ALL VALUES ('migration-file', 'orange', 'Database migration file', false), ('dependency-manifest', 'yellow', 'Dependency manifest change', false))
SELECT rule_id, tier, title, blocking, {_PACKED} AS pack, CAST(row_number() OVER (ORDER BY rule_id) AS INT) AS pos, (SELECT count(*) FROM found f WHERE f.rule_id = cat.rule_id) AS n FROM cat""")
def rule_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rulesets.with_hits(rulesets.catalog(spark), _found(spark, sf_dir))


#: What a setting is of: rules and packs, by number of the event; other numbers set nothing.
_KEYS = (*(r.rule_id for r in RULES), *rulesets.PACKS)
_SPREAD = 4 * len(_KEYS)
_SETTINGS = f"""settings AS (
  SELECT file_id AS project, key, last({{'e': CASE event_type WHEN 'error' THEN false WHEN 'view' THEN true END, 't': CASE event_type WHEN 'purchase' THEN 'green' WHEN 'signup' THEN 'orange' END, 'b': CASE event_type WHEN 'click' THEN true WHEN 'signup' THEN false END}} ORDER BY event_id) AS s
  FROM (SELECT *, ([{", ".join(map(_q, _KEYS))}])[CAST(event_id % {_SPREAD} AS INT) + 1] AS key FROM code) WHERE key IS NOT NULL GROUP BY 1, 2)"""


def _settings(code: DataFrame) -> DataFrame:
    """Settings of each file's project, a layer an event."""
    kind = lambda **of: F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in of.items()])
    key = F.get(F.array(*map(F.lit, _KEYS)), (F.col("event_id") % _SPREAD).cast("int"))
    return code.select(F.col("file_id").alias("project"), F.col("event_id").alias("layer"), key.alias("key"), kind(error=False, view=True).alias("enabled"), kind(purchase="green", signup="orange").alias("tier"), kind(click=True, signup=False).alias("blocking"))


@query(FOUND + f""", {_SETTINGS}, packed AS (SELECT *, {_PACKED} AS pack FROM scoped)
SELECT f.file_id, f.line, f.rule_id, f.col, coalesce(own.s.t, f.tier) AS tier, coalesce(own.s.b, f.blocking) AS blocking, own.s.t IS NOT NULL OR own.s.b IS NOT NULL AS pinned
FROM packed f LEFT JOIN settings own ON own.project = f.file_id AND own.key = f.rule_id LEFT JOIN settings p ON p.project = f.file_id AND p.key = f.pack
WHERE coalesce(own.s.e, true) AND (own.key IS NOT NULL OR coalesce(p.s.e, true))""")
def configured_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    code, _, _ = _tables(spark, sf_dir)
    found = rulesets.configured(_scoped(spark, sf_dir).withColumn("project", F.col("file_id")), rulesets.layered(_settings(code)))
    return found.select("file_id", "line", "rule_id", "col", "tier", "blocking", "pinned")


#: Patterns of a configuration; the second is no regular expression, and then a literal.
_CUSTOM = ({"pattern": r"value\d+", "tier": "green"}, {"id": "no-clean", "patterns": ["clean(", "CLEAN"], "blocking": True}, {"title": "nothing"}, {"pattern": "Fetch", "flags": "g", "languages": ["python", "go"]}, {"pattern": "fetch", "title": "Any fetch"})


@query(FOUND + r"""SELECT file_id, line, rule_id, tier, blocking, title FROM (
  SELECT *, 'custom-1' AS rule_id, 'green' AS tier, false AS blocking, 'Custom rule' AS title FROM lines WHERE regexp_matches(scan, '(?i)value[0-9]+')
  UNION ALL SELECT *, 'no-clean', 'yellow', true, 'Custom rule' FROM lines WHERE contains(lower(scan), 'clean')
  UNION ALL SELECT *, 'custom-4', 'yellow', false, 'Custom rule' FROM lines WHERE contains(scan, 'Fetch') AND language IN ('python', 'go')
  UNION ALL SELECT *, 'custom-5', 'yellow', false, 'Any fetch' FROM lines WHERE contains(lower(scan), 'fetch')
  UNION ALL SELECT *, 'configured-high-impact', 'orange', false, 'Configured high-impact pattern' FROM lines WHERE contains(lower(scan), 'users.'))""")
def custom_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    code, files, _ = _tables(spark, sf_dir)
    rules = [*rulesets.custom_rules(spark, _CUSTOM), *rulesets.high_impact(spark, [r"users\."])]
    return findings.detect(tables.scanned(code, files), rules).select("file_id", "line", "rule_id", "tier", "blocking", "title")


@query("""SELECT doc_id, 'd' || doc_id AS id, 'raw-query' AS rule_id, sha1(text) AS code_hash, 'dismiss' AS verdict, CAST(0 AS INT) AS ingest_ord FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL
UNION ALL SELECT doc_id, 'e' || doc_id, NULL, NULL, NULL, CAST(1 AS INT) FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL""")
def stored_learnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores of learnings, of which a third breaks off and a third is no store at all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = F.format_string('{"version": 1, "entries": [{"id": "d%d", "rule_id": "raw-query", "code_hash": "%s", "verdict": "dismiss"}, {"id": "e%d", "other": [1]}]}', "doc_id", F.sha1("text"), "doc_id")
    body = F.when(F.col("text").isNull() | (F.col("doc_id") % 3 == 2), F.col("text")).when(F.col("doc_id") % 3 == 0, whole).otherwise(F.lit('{"version": 1, "entries": [{"id": "d'))
    return learnings.read_stores(docs.withColumn("body", body), "doc_id", "body").drop("at")


from riftline.jobs import policies, scripts  # noqa: E402, F401  (they register their queries)
