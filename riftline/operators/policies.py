"""Configuration files that extend each other: whom each takes in, in which order, what comes out, and whether it is valid.

configs is a table of (path, body): the files of all projects, each body a JSON object. The closure over ``extends``
grows by a join a level, for all files at once; the merge is a ranking of (file, setting) rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riftline.functions import text as T
from riftline.operators.fixpoint import settled

#: Names of configuration files in a folder and in a package.
NAME, PACKAGE_NAMES = ".riftline.json", (".riftline.json", "riftline.json")
#: Levels of extension, and the values that settings may have.
MOST_LEVELS = 10
_TIERS = ("green", "yellow", "orange")
CHECKS = (
    ("gate.mode", "gate", "$.mode", ("staged", "working")), ("failOn", "gate", "$.failOn", _TIERS), ("agent.mode", "gate", "$.agent.mode", ("advisory", "gated", "off")), ("agent.autoFixFloor", "gate", "$.agent.autoFixFloor", _TIERS),
    ("agent.trustSource", "gate", "$.agent.trustSource", ("deterministic", "any")), ("guidelines.evaluator", "guidelines", "$.evaluator", ("auto", "model", "host")), ("guidelines.tier", "guidelines", "$.tier", _TIERS),
    ("graph.mode", "graph", "$.mode", ("cli", "off")), ("graph.provider", "graph", "$.provider", ("codegraph",)), ("graph.enabled", "graph", "$.enabled", (True, False, "auto")), ("graph.security", "graph", "$.security", (True, False, "auto")),
    ("testScope", "testScope", "$", (True, False)),
)
#: Sorts behind all numbers of bases.
_SELF = 2**31 - 1


def normal(path: Column) -> Column:
    """``path`` without ``.``, ``..`` and repeated slashes."""
    step = lambda done, x: F.when((x == "") | (x == "."), done).when((x == "..") & (F.size(done) > 0), F.slice(done, 1, F.size(done) - 1)).when(x == "..", done).otherwise(F.concat(done, F.array(x)))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))


def _folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise("")


def _targets(path: Column, entry: Column) -> Column:
    """The places where a file may be that ``entry`` of the file at ``path`` means, the first that exists counting."""
    folder = F.when(path.contains("/"), F.concat(_folder(path), F.lit("/")))
    inside = lambda *parts: normal(F.concat_ws("/", folder, *parts))
    given = F.when(entry.startswith("/"), normal(entry)).otherwise(inside(entry))
    named = F.array(*[inside(F.lit("node_modules"), entry, F.lit(n)) for n in PACKAGE_NAMES], inside(entry))
    return F.when(entry.startswith(".") | entry.startswith("/"), F.array(given, normal(F.concat_ws("/", given, F.lit(NAME))))).otherwise(named)


def _links(configs: DataFrame) -> DataFrame:
    """path, at (place in the list), entry, target: what each file extends; target is null where no such file is."""
    raw = configs.select("path", F.try_variant_get(F.try_parse_json("body"), "$.extends", "variant").alias("e")).where("e IS NOT NULL")
    several = F.try_variant_get("e", "$", "array<string>")
    one = F.try_variant_get("e", "$", "string")
    entries = raw.select("path", F.posexplode(F.when(several.isNotNull(), several).when(F.coalesce(one, F.lit("")).isin("", "false", "null", "0"), F.array().cast("array<string>")).otherwise(F.array(one))).alias("at", "entry"))
    tries = entries.select("path", "at", "entry", F.posexplode(_targets(F.col("path"), F.col("entry"))).alias("try", "target"))
    known = configs.select(F.col("path").alias("target")).distinct()
    first = tries.join(known, "target").groupBy("path", "at").agg(F.min_by("target", "try").alias("target"))
    return entries.join(first, ["path", "at"], "left")


def closure(configs: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(root, path, place) of every file that a root takes in, place in the order of merging; and (root, error) of those that fail.

    roots: path. A root fails with its first error in reading order: a file that extends itself over others, a chain of
    more than ``MOST_LEVELS`` extensions, an entry without a file, or a body that is no JSON object.
    """
    links = settled(_links(configs))
    bodies = settled(configs.select("path", F.coalesce(F.schema_of_variant(F.try_parse_json("body")).startswith("OBJECT") & (T.loose_json(F.col("body")) == T.trim_white(F.col("body"))), F.lit(False)).alias("good")))
    now = roots.join(bodies, "path").select(F.col("path").alias("root"), "path", F.array().cast("array<int>").alias("key"), F.array("path").alias("chain"), "good")
    taken, failed = [], []
    for level in range(MOST_LEVELS + 2):
        now = settled(now)
        if not now.take(1):
            break
        fail = lambda rows, text: failed.append(rows.select("root", "key", text.alias("error")))
        if level > MOST_LEVELS:
            fail(now, F.concat(F.lit("chain too deep at "), "path"))
            break
        fail(now.where("NOT good"), F.concat(F.lit("no JSON object at "), "path"))
        taken.append(now.where("good").select("root", "path", F.concat("key", F.array(F.lit(_SELF))).alias("place")))
        grown = now.where("good").join(links, "path").withColumn("key", F.concat("key", F.array("at")))
        fail(grown.where("target IS NULL"), F.concat(F.lit("no file for "), "entry", F.lit(" in "), "path"))
        circle = F.array_contains("chain", F.col("target"))
        fail(grown.where("target IS NOT NULL").where(circle), F.concat(F.lit("circle at "), "target"))
        onward = grown.where("target IS NOT NULL").where(~circle).select("root", F.col("target").alias("path"), "key", F.concat("chain", F.array("target")).alias("chain"))
        now = onward.join(bodies, "path").select("root", "path", "key", "chain", "good")
    if not taken:
        empty = roots.select(F.col("path").alias("root")).where("false")
        return empty.withColumns({"path": F.col("root"), "place": F.array().cast("array<int>")}), empty.withColumn("error", F.col("root"))
    errors = reduce(DataFrame.unionByName, failed).groupBy("root").agg(F.min_by("error", F.struct("key", "error")).alias("error"))
    return reduce(DataFrame.unionByName, taken).join(errors, "root", "left_anti"), errors


def _members(rows: DataFrame, value: str) -> DataFrame:
    """A row for each member of the variant ``value``: its columns with at, name (null in lists) and member (a variant).

    An empty list or object has one row of nulls.
    """
    tvf = rows.sparkSession.tvf.variant_explode_outer(F.col(value).outer())
    return rows.lateralJoin(tvf.select(F.col("pos").alias("at"), F.col("key").alias("name"), F.col("value").alias("member")))


def merged(configs: DataFrame, taken: DataFrame) -> DataFrame:
    """root, name, value (JSON text): the settings that come out of the files of ``closure``, in its order.

    Lists follow each other (several of ``ignore`` without repeats), objects are merged by their members, anything else replaces what
    is there, and so does a value of another kind.
    """
    bodies = configs.select("path", F.try_parse_json("body").alias("v"))
    rows = _members(taken.join(bodies, "path"), "v").where("name <> 'extends'").select("root", "place", "name", "member", F.to_json("member").alias("text"))
    rows = rows.withColumn("kind", F.when(F.col("text").startswith("["), "list").when(F.col("text").startswith("{"), "object").otherwise("plain"))
    all_ = Window.partitionBy("root", "name").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = Window.partitionBy("root", "name").orderBy(F.desc("place"))
    rows = settled(rows.withColumn("last", F.last("kind").over(all_)).withColumn("others", F.sum((F.col("kind") != F.col("last")).cast("int")).over(after)).where("others = 0"))
    plain = rows.where("last = 'plain'").groupBy("root", "name").agg(F.max_by("text", "place").alias("value"))
    items = rows.where("last = 'list'").select("root", F.col("name").alias("setting"), "place", F.col("member").alias("of"))
    items = _members(items, "of").select("root", F.col("setting"), "place", "at", F.to_json("member").alias("text"))
    again = Window.partitionBy("root", "setting", "text").orderBy("place", "at")
    of = Window.partitionBy("root", "setting")
    items = items.withColumn("alone", F.min("place").over(of) == F.max("place").over(of)).withColumn("n", F.row_number().over(again))
    items = items.where("setting <> 'ignore' OR alone OR n = 1 OR text IS NULL")
    lists = items.groupBy("root", F.col("setting").alias("name")).agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("place", "at", "text")))).alias("l"))
    lists = lists.select("root", "name", F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["text"]), ","), F.lit("]")).alias("value"))
    members = rows.where("last = 'object'").select("root", F.col("name").alias("setting"), "place", F.col("member").alias("of"))
    members = _members(members, "of").select("root", "setting", "place", "name", F.to_json("member").alias("text")).groupBy("root", "setting", "name").agg(F.max_by("text", "place").alias("text"))
    quoted = members.withColumn("q", F.to_json(F.array("name")))
    pair = F.when(F.col("name").isNotNull(), F.concat(F.expr("substring(q, 2, length(q) - 2)"), F.lit(":"), "text"))
    objects = quoted.withColumn("pair", pair).groupBy("root", F.col("setting").alias("name")).agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list("pair")), ","), F.lit("}")).alias("value"))
    return plain.unionByName(lists).unionByName(objects)


def invalid(settings: DataFrame) -> DataFrame:
    """root, error: the first setting of each root that has none of the values it may have."""
    text = lambda v: str(v).lower() if isinstance(v, bool) else f'"{v}"'
    found = []
    for k, (label, name, place, allowed) in enumerate(CHECKS):
        value = F.to_json(F.try_variant_get(F.parse_json("value"), place, "variant"))
        told = F.concat(F.lit(f"{label} must be one of {' | '.join(map(text, allowed))}, got "), "seen")
        rows = settings.where(F.col("name") == name).select("root", value.alias("seen")).where(F.col("seen").isNotNull() & ~F.col("seen").isin(*map(text, allowed)))
        found.append(rows.select("root", F.lit(k).alias("k"), told.alias("error")))
    return reduce(DataFrame.unionByName, found).groupBy("root").agg(F.min_by("error", "k").alias("error"))
