"""The reader of scripts on many forms of syntax, and the tree rules on cases that name what must and must not be found."""

import random

import pytest
from pyspark.sql import functions as F

from riftline.operators import fixpoint, trees
from riftline.sources import scripts

#: Forms that must parse, in both languages.
PLAIN = (
    "", "a\n", "#!/usr/bin/env node\nf();", "x = /[/'\"]\\/+/g.test(s) ? a / b / c : d;", "`a ${`b ${c}`} d`;", "for (const [a, b] of Object.entries(o)) { if (a in b) continue; }", "for (let i = 0, n = 3; i < n; i++) ;",
    "for await (const x of y) z(x)", "label: while (true) { break label; }", "do { x++ } while (x < 3)\ny()", "switch (x) { case 1: case 'a': f(); break; default: g() }", "try { f() } catch { g() } finally { h() }",
    "class A extends B.C { #p = 1; static { f(); } static async *g() {} get x() { return this.#p } [k + 1] = 2; constructor(a, b = 2) { super(a) } }", "const { a, b: { c = 1 }, ...rest } = o, [x, , y = 2] = z;",
    "async (x) => { await x }", "a => b => ({ c: a, [b]: 1, d() {}, get e() { return 1 }, async *f() {}, 'g-h': 2, 3: 4, i })", "new Foo", "new Foo.Bar(1)(2)", "a?.b?.[c]?.(d) ?? e", "import a, { b as c } from 'x'; import * as d from \"y\"; import 'z'",
    "import('x').then(m => m.default)", "export * from 'x'; export * as ns from 'y'; export { a, b as c } from 'z'; export default class {}", "x = function* g() { yield; yield* h(); const y = yield 1 }", "if (a) b; else if (c) d; else e",
    "return 5", "var a = 1, b\nlet c\n;[1, 2].map(f)", "let async = 1; async = 2; async()", "x = <div a='b' {...p} c={d + 1}>it's {f(g)} <br/> <>x</></div>;", "a ||= b; c &&= d; e ??= f; g **= 2; h >>>= 1", "tag`x ${y}`", "delete a[b], void 0, typeof c",
    "const of = 1, get = 2, set = 3, type = 4; type = of + get", "if (a) /x/.test(b)", "a = b\n/c/g", "1..toString(); .5 + 0x1F + 1e3 + 10n + 1_000", "'a\\'b' + \"c\\\"d\\\n\"", "// c\n/* d */ e /* f */ ;", "@dec class A { @b.c(1) m() {} }",
)
TYPED = (
    "function f<T extends U<V[]>>(a: T, b?: { c: string; d(e: number): void }, ...g: Array<[x: string, y?: number]>): asserts a is T & W { return a as unknown as T; }", "const x: Map<string, () => void> = new Map<string, () => void>();",
    "interface A<B> extends C { d: string; (e: number): void; readonly [k: string]: unknown }", "type T = { a: 1 } | [b, c] | `x${string}`\nconst after = 1;", "enum E { A = 1, B = 'x' }\nexport const enum F { G }", "declare module 'm' { export function f(): void; }",
    "export abstract class A<T> implements B, C { private readonly x!: number; constructor(private y: string, public z?: T) { super() } abstract m(): void; static n?(): void }", "let v = <T,>(x: T): x is T => x!; f<string>(a!.b, c satisfies D)", "export type { A } from 'x'; import type { B } from 'y'",
    "a < b && c > d; f(a < b, c > d)", "const g = async <T>(x: T): Promise<T> => { return x }", "export = foo", "namespace N.M { export const a = 1 }", "function over(a: string): void;\nfunction over(a: any) {}", "let x = y as const, z = w as A | B[];", "export default interface I { a: 1 }",
)
BROKEN = ("function ( { const a = 'x'", "a(b", "x = [1, 2", "}", "f() )", "'open", "`open ${a}", "/* open", "const a = ;", "a ? b", "if (x { y }")


@pytest.mark.parametrize("text", PLAIN)
def test_reads(text):
    assert scripts.rows(text, False)
    assert scripts.rows(text, True) or "<div" in text


@pytest.mark.parametrize("text", TYPED)
def test_reads_types(text):
    assert scripts.rows(text, True)


@pytest.mark.parametrize("text", BROKEN)
def test_gives_up(text):
    assert scripts.rows(text, False) == []
    assert scripts.rows(text + "\n" * 3, True) == []


def test_gives_up_on_deep_nests():
    assert scripts.rows("(" * 100_000 + ")" * 100_000, False) == []
    assert len(scripts.rows(" + ".join(["a"] * 50_000), False)) > 100_000


def shape(text, typed=False):
    return {(r[5], r[6], r[12:16]) for r in scripts.rows(text, typed)}


def test_spans_and_names():
    found = shape("x =\n  (a) + b.c;\nfoo(  );")
    assert ("BinaryExpression", None, (2, 2, 2, 11)) in found
    assert ("AssignmentExpression", None, (1, 0, 2, 11)) in found
    assert ("MemberExpression", "b.c", (2, 8, 2, 11)) in found
    assert ("CallExpression", None, (3, 0, 3, 7)) in found


def test_nodes_nest():
    rows = scripts.rows("\n".join(PLAIN[5:15]), False)
    for me, last, parent, *_ in rows:
        assert me <= last < len(rows)
        if parent >= 0:
            assert parent < me
            assert last <= rows[parent][1]


#: (file, text, rules that must be found with line and tier); a file ".ts" is typed. The rest must not be found.
CASES = [
    ("api.js", "export function getThing(id) { return id; }\n", [("public-api-change", 1, "orange", "getThing")]),
    ("m.js", "exports.a = 1;\nmodule.exports = { b };\nmodule.exports.c = 2;\nother.exports = 3;", [("public-api-change", 1, "orange", "a"), ("public-api-change", 2, "orange", "module.exports")]),
    ("e.ts", "export default () => 1;\nexport const [p] = q, r = 1;\nexport interface I { a: 1 }\nexport { x as y };\nexport * from 'z';", [("public-api-change", 1, "orange", "default"), ("public-api-change", 2, "orange", None), ("public-api-change", 3, "orange", "I"), ("public-api-change", 4, "orange", "y"), ("public-api-change", 5, "orange", "*")]),
    ("r.js", "db.query(`SELECT * FROM users WHERE id = ${req.query.id}`);\n", [("sql-injection", 1, "orange", None)]),
    ("r2.js", 'db.query("SELECT * FROM users WHERE id = ?", [id]);\n', []),
    ("r3.js", "const t = 'users';\ndb.query('SELECT * FROM ' + t);\ndb.query('SELECT * FROM ' + t + u);\npool.execute(req.body.q);\nrun('select' + 'x');\nlog('selected ' + x);", [("sql-injection", 3, "orange", None), ("sql-injection", 4, "orange", None)]),
    ("r4.js", "let q = 'SELECT 1';\nq = q + ' FROM t';\ndb.query('DELETE ' + q);\nlet w = 'a';\nf('DROP ' + w);\nw = v;", [("sql-injection", 3, "orange", None), ("sql-injection", 5, "orange", None)]),
    ("u.js", "el.innerHTML = userInput;\n", [("xss-sink", 1, "orange", None)]),
    ("u2.js", "el.textContent = userInput;\nel.innerHTML = '<b>x</b>';\nel.innerHTML += x;\nel['innerHTML'] = x;\nx?.innerHTML", []),
    ("v.js", "el.innerHTML = DOMPurify.sanitize(req.query.name);\n", [("xss-sink", 1, "yellow", None)]),
    ("v2.js", "el.innerHTML = escapeHtml(userInput);\nel.outerHTML = await (await he.encode(x));", [("xss-sink", 1, "yellow", None), ("xss-sink", 2, "yellow", None)]),
    ("v3.js", "const clean = DOMPurify.sanitize(dirty);\nel.innerHTML = clean;\n", [("xss-sink", 2, "yellow", None)]),
    ("v4.js", "el.innerHTML = renderTemplate(req.query.name);\ndocument.write(a + b);\nx.insertAdjacentHTML('beforeend', y);\nx.insertAdjacentHTML(y, 'z');", [("xss-sink", 1, "orange", None), ("xss-sink", 2, "orange", None), ("xss-sink", 4, "orange", None)]),
    ("v5.js", "let a = b, b = a;\nel.innerHTML = a;\nlet c = await c;\nel.innerHTML = c;", [("xss-sink", 2, "orange", None), ("xss-sink", 4, "orange", None)]),
    ("f.js", "const fp = path.join(__dirname, req.params.filename);\n", [("path-traversal", 1, "orange", None)]),
    ("f2.js", "const fp = path.join(__dirname, 'static', 'index.html');\nfs.readFile(req.url);\npath.parse(req.query.x);", []),
    ("f3.js", "fs.readFile(path.join(__dirname, req.cookies.file));\n", [("path-traversal", 1, "orange", None)]),
    ("f4.js", "const n = `a/${req.body.n}`;\nconst m = 'x' + n;\nfs.unlink(m);\nfs.unlink(f(m));\nfs.unlink(k);\nk = k;", [("path-traversal", 3, "orange", None)]),
    ("p.js", "function deepMerge(target, source) {\n  for (const key in source) {\n    if (typeof source[key] === 'object') deepMerge(target[key], source[key]);\n    else target[key] = source[key];\n  }\n}", [("prototype-pollution", 1, "orange", "deepMerge")]),
    ("p2.js", "function deepMerge(target, source) {\n  for (const key in source) {\n    if (key === '__proto__') continue;\n    target[key] = deepMerge(target[key], source[key]);\n  }\n}", []),
    ("p3.js", "const BLOCKED = ['__proto__', 'constructor'];\nconst merge = (a, b) => {\n  Object.keys(b).forEach((k) => { if (BLOCKED.includes(k)) return; a[k] = merge(a[k], b[k]); });\n};", []),
    ("p4.js", "const keys = LIST;\nconst merge = (a, b) => {\n  Object.keys(b).forEach((k) => { if (keys.includes(k)) return; a[k] = merge(a[k], b[k]); });\n};\nLIST = ['prototype'];", []),
    ("p5.js", "const merge = (a, b) => {\n  for (k in b) { if (!Object.prototype.hasOwnProperty.call(b, k)) continue; a[k] = merge(a[k], b[k]); }\n};", [("prototype-pollution", 1, "orange", "merge")]),
    ("p6.js", "function copy(a, b) { for (const k in b) { a[k] = b[k]; } }\nfunction one(a) { for (k in a) a[k] = one(a[k]); }\nconst pick = (a, b) => b.map(k => pick(a[k], k));\nx.y = function (a, b) { for (k in b) a[k] = y(a[k], b[k]); }", []),
    ("d.js", "const r = StripeClient.charge(amount, token);\nconst s = StripeClient.charge;\nold(1);\nold;\nnew StripeClient.charge();", [("deprecated-api", 1, "yellow", "StripeClient.charge"), ("deprecated-api", 2, "yellow", "StripeClient.charge"), ("deprecated-api", 3, "orange", "old"), ("deprecated-api", 5, "yellow", "StripeClient.charge")]),
    ("d2.js", "// StripeClient.charge(amount, token) is old\nconst x = 1; /* old(1) */ 'old(1)';\n", []),
    ("broken.js", "function ( { el.innerHTML = x\n", []),
    ("other.py", "el.innerHTML = x\n", []),
    ("none.js", None, []),
]
DEPRECATED = [("StripeClient.charge()", "StripeClient.createPaymentIntent()", "ann", "#7", None), ("old", "old", None, None, "orange")]


@pytest.fixture(scope="module")
def files(spark):
    rows = [(k, path, text, {"js": "javascript", "ts": "typescript"}.get(path.split(".")[-1], "python")) for k, (path, text, _) in enumerate(CASES)]
    return spark.createDataFrame(rows, "file_id long, path string, text string, language string")


@pytest.fixture(scope="module")
def found(spark, files):
    deprecated = spark.createDataFrame(DEPRECATED, "name string, replaced_by string, author string, pr string, tier string")
    return trees.detect(scripts.nodes(files, "file_id", "text", "language"), deprecated).collect()


@pytest.mark.parametrize("k", range(len(CASES)), ids=[c[0] for c in CASES])
def test_tree_rules(found, k):
    wanted = sorted(map(str, CASES[k][2]))
    assert sorted(str((r.rule_id, r.line, r.tier, r.symbol)) for r in found if r.file_id == k) == wanted


def test_finding_parts(found):
    by = {(CASES[r.file_id][0], r.rule_id, r.line): r for r in found}
    fix = by["d.js", "deprecated-api", 1]
    assert tuple(fix.fix) == ("Replace with StripeClient.createPaymentIntent", 1, 10, 1, 29, "StripeClient.createPaymentIntent")
    assert fix.message == "Deprecated: use `StripeClient.createPaymentIntent()`. Owner: ann. See #7."
    assert by["d.js", "deprecated-api", 2].fix is None
    assert by["d.js", "deprecated-api", 3].fix is None
    assert by["r.js", "sql-injection", 1].blocking
    assert (by["p.js", "prototype-pollution", 1].end_line, by["p.js", "prototype-pollution", 1].end_col) == (6, 1)
    clean = by["v3.js", "xss-sink", 2]
    assert (clean.tier_adjusted, clean.blocking, "DOMPurify.sanitize" in clean.message) == ("deescalated", False, True)


def test_in_change(spark, found, files):
    frame = spark.createDataFrame([(r.file_id, r.rule_id, r.line) for r in found], "file_id long, rule_id string, line int")
    scope = files.select("file_id", (F.col("path") != "e.ts").alias("diff_known"))
    kept = trees.in_change(frame, scope, spark.createDataFrame([(1, 2), (1, 2), (1, 9)], "file_id long, line int")).collect()
    assert sorted((r.file_id, r.line) for r in kept) == [(1, 2), *[(2, n) for n in range(1, 6)]]


def test_signatures(spark):
    texts = [
        (1, "export function add(\n  a,\n  b = f(1, (2)),\n  { c },\n  [d] = [],\n  ...rest\n) {}\nexport const g = async (x) => x, h = function (y, z) {}, i = 3;\nexport default (q) => q;\nfunction hidden(a) {}\nexport { hidden };\nexport function add2() {}\nexport function add2(k) {}\nif (x) { export function inner(a) {} }"),
        (2, "export function add(a: string, b?: number): void {}\nexport default function named(this: X, private: string) {}"),
    ]
    rows = spark.createDataFrame(texts, "id long, text string").withColumn("language", F.when(F.col("id") == 2, "typescript").otherwise("javascript"))
    signed = trees.exported_signatures(scripts.nodes(rows, "id", "text", "language"))
    assert sorted((r.file_id, r.name, r.params, r.line) for r in signed.collect()) == [(1, "add", "a, b=, {…}, […]=, ...rest", 1), (1, "add2", "k", 13), (1, "default", "q", 9), (1, "g", "x", 8), (1, "h", "y, z", 8), (2, "add", "a, b?", 1), (2, "named", "this, private", 2)]
    before = spark.createDataFrame([(1, "add", "a, b"), (1, "g", "x"), (1, "gone", "")], "file_id long, name string, params string")
    drift = trees.signature_drift(before, signed).collect()
    assert [(r.file_id, r.rule_id, r.symbol, r.line, r.end_line, "(a, b) to (a, b=, {…}" in r.message) for r in drift] == [(1, "signature-drift", "add", 1, 7, True)]


def test_reach_and_resolved(spark):
    r = random.Random(4)
    edges = {(r.randrange(30), r.randrange(30)) for _ in range(28)} | {(40, 41), (41, 40), (42, 40), (50, 51), (51, 52)}
    nodes = range(60)
    start = {k for k in nodes if k % 7 == 0} | {52}
    frame = lambda rows, schema: spark.createDataFrame(sorted(rows), schema).withColumn("file", F.lit(1))
    wanted = set(start)
    while more := {a for a, b in edges if b in wanted} - wanted:
        wanted |= more
    got = fixpoint.reach(frame([(k,) for k in start], "name int").select("file", "name"), frame(edges, "name int, dep int"), "name", "dep")
    assert sorted(x.name for x in got.collect()) == sorted(wanted)
    done: set[int] = set()
    while more := {k for k in nodes if all(b in done for a, b in edges if a == k)} - done:
        done |= more
    got = fixpoint.resolved(frame([(k,) for k in nodes], "name int").select("file", "name"), frame(edges, "name int, dep int"), "name", "dep")
    assert sorted(x.name for x in got.collect()) == sorted(done)
    assert {40, 41, 42}.isdisjoint(done)


def names_of(k, r):
    """A script whose names are bound to sums of several names, and what each name is, by following bindings one by one."""
    lines, last = [], {}
    for _ in range(40):
        name, parts = f"n{r.randrange(8)}", [r.choice(["'x'", "7", f"n{r.randrange(10)}", f"n{r.randrange(8)}", "req.body.z", "f()"]) for _ in range(r.randint(1, 3))]
        lines.append(f"{r.choice(['let ', ''])}{name} = {' + '.join(parts)};")
        last[name] = parts

    def static(part, seen):
        return part in ("'x'", "7") or (part in last and part not in seen and all(static(p, seen | {part}) for p in last[part]))

    def request(part, seen):
        return part == "req.body.z" or (part in last and part not in seen and any(request(p, seen | {part}) for p in last[part]))

    return "\n".join(lines), {(k, n, static(n, frozenset()), request(n, frozenset())) for n in last}


def test_relations_against_following_bindings(spark):
    r = random.Random(8)
    made = [names_of(k, r) for k in range(60)]
    frame = spark.createDataFrame([(k, t, "javascript") for k, (t, _) in enumerate(made)], "id long, text string, language string")
    nodes = fixpoint.settled(trees._marked(scripts.nodes(frame, "id", "text", "language")))
    known = trees.names(nodes, trees.last_bindings(nodes))
    static, request = ({(x.file_id, x.name) for x in df.collect()} for df in (known.static, known.request))
    wanted = {w for _, rows in made for w in rows}
    assert {(k, n, (k, n) in static, (k, n) in request) for k, n, *_ in wanted} == wanted
    assert 0 < len(static) < len(wanted)
