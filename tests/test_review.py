"""The whole review on small projects: what each kind of rule, setting, scope and verdict does to the others."""

import random

import pytest
from pyspark.sql import functions as F

from riftline.functions import text as T
from riftline.jobs import review as job
from riftline.operators import perfile, rulesets

#: (path, text, changed lines or None for no diff information)
FILES = [
    ("config.js", 'const apiKey = "supersecretvalue123";\n', None),
    ("migrate.js", 'await db.query("ALTER TABLE users DROP COLUMN email");\n', None),
    ("pay.js", "const r = StripeClient.charge(amount, token);\n", None),
    ("pay2.js", "// StripeClient.charge(amount, token) is old\nconst x = 1;\n", None),
    ("api.js", "export function getThing(id) { return id; }\n", None),
    ("math.js", "export function add(a, b, c) {\n  return a + b + c;\n}\n", [1, 2]),
    ("math2.js", "export function add(a, b, c) {\n  return a + b + c;\n}\n", [2]),
    ("x.js", 'const ok = 1;\nconst ok2 = 2;\nconst apiKey = "supersecretvalue123";\n', [1]),
    ("package.json", '{\n  "name": "x",\n  "dependencies": { "left-pad": "^1.0.0" }\n}\n', [3]),
    ("sub/package.json", '{\n  "name": "x"\n}\n', []),
    ("new/package.json", '{\n  "name": "x"\n}\n', None),
    ("tool.py", "import os\nos.system(user_input)\nStripeClient.charge(1)\nmine.StripeClient.charge (2)\n# StripeClient.charge(3)\n", None),
    ("broken.js", 'function ( { const apiKey = "supersecretvalue123"\nel.innerHTML = x\n', None),
    ("tests/a.test.js", "eval(x);\nel.innerHTML = y;\nDROP TABLE a", None),
    ("tests/b.test.js", "eval(x);\nel.innerHTML = y;\n", None),
    ("c.js", "/*\n eval(a)\n debugger\n*/ eval(b) // eval(c)\nconst s = `\n// eval(d)\n`;\n", None),
    ("db/migrations/1.sql", "-- DROP TABLE a\nDROP TABLE b; /* DROP\nTABLE c */\n", [1, 2, 3]),
]
DRIFT = "Exported `add` went from (a, b) to (a, b, c): callers may break."


@pytest.fixture(scope="module")
def given(spark):
    rows = [(k, path, text, lines is not None, k) for k, (path, text, lines) in enumerate(FILES)]
    changed = [(k, n) for k, (*_, lines) in enumerate(FILES) for n in lines or []]
    files = spark.createDataFrame(rows, "file_id long, path string, text string, diff_known boolean, project long")
    old = spark.createDataFrame([(k, "export function add(a, b) {\n  return a + b;\n}\n") for k in (5, 6)], "file_id long, text string")
    deprecated = spark.createDataFrame([("StripeClient.charge", "StripeClient.createPaymentIntent", None, None, None)], "name string, replaced_by string, author string, pr string, tier string")
    return files, spark.createDataFrame(changed, "file_id long, line int"), old, deprecated


def listed(found):
    out = {}
    for r in found.collect():
        out.setdefault(FILES[r.file_id][0], []).append((r.pos, r.line, r.rule_id, r.tier, r.blocking))
    return {k: [f[1:] for f in sorted(v)] for k, v in out.items()}


@pytest.fixture(scope="module")
def plain(given):
    files, changed, old, deprecated = given
    return job.review(files, changed, deprecated=deprecated, previous=old).cache()


def test_review(plain):
    assert listed(plain) == {
        "config.js": [(1, "hardcoded-secret", "orange", True)],
        "migrate.js": [(1, "db-schema-change", "orange", False), (1, "db-schema-destructive", "orange", True), (1, "raw-query", "yellow", False)],
        "pay.js": [(1, "deprecated-api", "yellow", False)],
        "api.js": [(1, "public-api-change", "orange", False)],
        "math.js": [(1, "public-api-change", "orange", False), (1, "signature-drift", "orange", False)],
        "package.json": [(3, "dependency-manifest", "yellow", False)],
        "new/package.json": [(1, "dependency-manifest", "yellow", False)],
        "tool.py": [(2, "dangerous-exec", "orange", False), (3, "deprecated-api", "yellow", False), (4, "deprecated-api", "yellow", False)],
        "broken.js": [(1, "hardcoded-secret", "orange", True)],
        "tests/a.test.js": [(1, "dangerous-exec", "yellow", False), (2, "xss-sink", "yellow", False), (3, "db-schema-destructive", "orange", True)],
        "tests/b.test.js": [(1, "dangerous-exec", "yellow", False), (2, "xss-sink", "yellow", False)],
        "c.js": [(4, "dangerous-exec", "orange", False), (6, "dangerous-exec", "orange", False)],
        "db/migrations/1.sql": [(1, "migration-file", "orange", False), (2, "db-schema-destructive", "orange", True)],
    }


def test_parts(plain):
    by = {(FILES[r.file_id][0], r.rule_id, r.line): r for r in plain.collect()}
    assert by["math.js", "signature-drift", 1].message == DRIFT
    assert (by["math.js", "signature-drift", 1].symbol, by["math.js", "public-api-change", 1].end_line) == ("add", 3)
    assert by["pay.js", "deprecated-api", 1].fix.text == "StripeClient.createPaymentIntent"
    assert (by["tool.py", "deprecated-api", 4].col, by["tool.py", "deprecated-api", 4].end_col) == (5, 26)
    assert (by["package.json", "dependency-manifest", 3].code, by["package.json", "dependency-manifest", 3].end_col) == ('"dependencies": { "left-pad": "^1.0.0" }', 42)
    assert by["tests/b.test.js", "xss-sink", 2].tier_adjusted == "deescalated"
    assert all(r.message for r in by.values())


def test_settings_scope_and_verdicts(spark, given):
    files, changed, old, deprecated = given
    settings = [
        (13, 1, "dangerous-exec", None, "orange", None), (14, 1, "web-security", False, None, None), (14, 1, "dangerous-exec", None, None, True), (1, 1, "raw-query", False, None, None), (3, 1, "hygiene", False, None, None),
        (15, 1, "dangerous-exec", True, None, None), (15, 2, "dangerous-exec", None, "green", None), (0, 1, "hardcoded-secret", None, None, False), (4, 1, "public-api-change", None, "orange", None),
    ]
    layers = spark.createDataFrame(settings, "project long, layer int, key string, enabled boolean, tier string, blocking boolean")
    impact = spark.createDataFrame([("add", 0, 0, "codegraph"), ("getThing", 0, 0, "codegraph"), ("other", 9, 3, "search")], "symbol string, caller_count long, files long, source string")
    store = spark.createDataFrame([("db-schema-change", 'await db.query("ALTER TABLE users DROP COLUMN email");')], "rule_id string, code string").select("rule_id", T.code_hash(F.col("code")).alias("code_hash"), F.lit("dismiss").alias("verdict"))
    verdicts = spark.createDataFrame([(11, "dangerous-exec", 2, True, ["user_input"], "codegraph")], "file_id long, rule_id string, line int, tainted boolean, data_flow array<string>, source string")
    found = job.review(files, changed, store, settings=rulesets.layered(layers), deprecated=deprecated, previous=old, impact=impact, verdicts=verdicts)
    got = listed(found)
    assert got["tests/a.test.js"] == [(1, "dangerous-exec", "orange", False), (2, "xss-sink", "yellow", False), (3, "db-schema-destructive", "orange", True)]  # a tier that a project sets is not lowered in tests
    assert got["tests/b.test.js"] == [(1, "dangerous-exec", "orange", True)]  # nor a gate that it sets; its pack is off
    assert got["migrate.js"] == [(1, "db-schema-destructive", "orange", True)]
    assert got["c.js"] == [(4, "dangerous-exec", "green", False), (6, "dangerous-exec", "green", False)]
    assert got["config.js"] == [(1, "hardcoded-secret", "orange", False)]
    assert got["math.js"] == [(1, "public-api-change", "yellow", False), (1, "signature-drift", "yellow", False)]  # nothing calls it
    assert got["api.js"] == [(1, "public-api-change", "orange", False)]  # pinned
    by = {(r.file_id, r.rule_id, r.line): r for r in found.collect()}
    assert (by[11, "dangerous-exec", 2].trust, by[11, "dangerous-exec", 2].trace) == ("confirmed", "Taint path: user_input.")
    assert by[5, "signature-drift", 1].caller_count == 0


def test_review_of_nothing(spark, given):
    files, changed, *_ = given
    assert job.review(files.where("false"), changed).count() == 0
    assert job.review(files.where("path = 'pay2.js'"), changed).count() == 0


# whole files: masks and diffs


def masked_by_place(text, line_marks, blocks, strings):
    """The same as the library's mask, from the definition: one state walks over the characters."""
    out, k, state = [], 0, None
    while k < len(text):
        if state is None:
            for kind, marks in (("s", strings), ("b", blocks), ("l", [(m, "\n", False) for m in line_marks])):
                if m := next((m for m in marks if text.startswith(m[0], k)), None):
                    state, end = kind, m
                    piece = m[0]
                    break
            else:
                piece = text[k]
            out.append(piece if state in (None, "s") else " " * len(piece))
            k += len(piece)
            continue
        kind, (_, close, carries) = state, end
        if text.startswith(close, k) and close != "\n":
            out.append(close if kind == "s" else " " * len(close))
            k, state = k + len(close), None
        elif text[k] == "\n" and (kind == "l" or (kind == "s" and not carries)):
            out.append("\n")
            k, state = k + 1, None
        elif kind == "s" and not carries and text[k] == "\\" and k + 1 < len(text) and text[k + 1] != "\n":
            out.append(text[k : k + 2])
            k += 2
        else:
            out.append(text[k] if kind == "s" or text[k] in "\t\n" else " ")
            k += 1
    return "".join(out)


@pytest.mark.parametrize("language", ["javascript", "go", "python", "ruby", "sql", "html", "shell"])
def test_mask_by_definition(language):
    line_marks, blocks, strings = perfile.FAMILIES[language]
    r = random.Random(language)
    bits = ["a", "\n", "\n", "\t", " ", "'", '"', "`", "//", "/*", "*/", "#", "--", "\\", "=begin", "=end", '"""', "'''", "<!--", "-->", "é"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 25)))
        assert perfile.mask_text(text, language) == masked_by_place(text, line_marks, [(a, b, True) for a, b in blocks], [(m, m, c) for m, c, _ in strings])


def changed_by_table(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while j < len(b):
        if i < len(a) and a[i] == b[j]:
            i, j = i + 1, j + 1
        elif i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            out.append(j + 1)
            j += 1
    return out


def test_exact_diff_by_definition():
    r = random.Random(2)
    for _ in range(2000):
        few = "abcdef"[: r.choice([1, 2, 3, 6])]
        a, b = ([r.choice(few) for _ in range(r.randint(1, 15))] for _ in range(2))
        assert perfile.changed_lines("\n".join(a), "\n".join(b), None) == changed_by_table(a, b)


def test_exact_diff_of_large_files(spark):
    r = random.Random(3)
    old = [str(r.randrange(3000)) for _ in range(6000)]
    new = list(old)
    places = sorted(r.sample(range(6000), 40))
    for k in places:
        new[k] = f"new {k}"
    rows = spark.createDataFrame([("\n".join(old), "\n".join(new)), (None, "a"), ("", "")], "old string, new string")
    exact = [x.changed for x in perfile.line_diff(rows, "old", "new", None).collect()]
    assert exact == [[k + 1 for k in places], None, []]
    assert len(perfile.line_diff(rows, "old", "new").collect()[0].changed) == 6000  # beyond the bound of a quick diff
