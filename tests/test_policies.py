"""Configuration files, histories of lines, sections of guides and JSON among other text, against plain models."""

import json
import posixpath
import random

from pyspark.sql import functions as F

from riftline.functions import text as T
from riftline.operators import guidelines, policies
from riftline.sources import blame


class Fails(Exception):
    pass


def target(files, path, entry):
    folder = posixpath.dirname(path)
    norm = lambda *p: posixpath.normpath(posixpath.join(*p))
    if entry.startswith((".", "/")):
        tries = [norm(folder, entry), norm(folder, entry, policies.NAME)]
    else:
        tries = [norm(folder, "node_modules", entry, n) for n in policies.PACKAGE_NAMES] + [norm(folder, entry)]
    return next((t for t in tries if t in files), None)


def merge(base, over):
    out = dict(base)
    for k, v in over.items():
        if k == "extends":
            continue
        if isinstance(v, list) and isinstance(out.get(k), list):
            both = out[k] + v
            out[k] = [x for n, x in enumerate(both) if x not in both[:n]] if k == "ignore" else both
        elif isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = {**out[k], **v}
        else:
            out[k] = v
    return out


def load(files, path, seen=()):
    if path in seen:
        raise Fails("circle")
    if len(seen) > 10:
        raise Fails("deep")
    try:
        own = json.loads(files[path])
    except ValueError:
        raise Fails("JSON") from None
    if not isinstance(own, dict):
        raise Fails("JSON")
    entries = own.get("extends") or []
    out = {}
    for entry in entries if isinstance(entries, list) else [entries]:
        if not (found := target(files, path, str(entry))):
            raise Fails("no file")
        out = merge(out, load(files, found, (*seen, path)))
    return merge(out, own)


def settled_by(spark, files):
    configs = spark.createDataFrame(sorted(files.items()), "path string, body string")
    taken, errors = policies.closure(configs, configs.select("path"))
    out = {p: {} for p in files}
    for r in policies.merged(configs, taken).collect():
        out[r.root][r.name] = json.loads(r.value)
    return out, {r.root: r.error for r in errors.collect()}


def test_extends(spark):
    files = {
        "/a/.riftline.json": '{"extends": ["./base.json", "pack"], "ignore": ["x", "z"], "gate": {"failOn": "yellow"}, "testScope": false, "list": [3], "odd": {"a": 1}}',
        "/a/base.json": '{"ignore": ["x", "y"], "gate": {"mode": "staged", "failOn": "orange"}, "list": [1, {"q": "\\u00e9\\""}], "odd": [1], "extends": "../shared"}',
        "/a/node_modules/pack/riftline.json": '{"list": [2], "gate": {"failOn": "green"}, "ignore": [], "k\\"y": null}',
        "/shared/.riftline.json": '{"testScope": true, "list": [0, 0], "ignore": ["w", "w"], "rules": {}, "deep": {"a": {"b": 1}}}',
        "/b/one.json": '{"extends": "./two.json"}', "/b/two.json": '{"extends": ["./one.json"]}', "/b/self.json": '{"extends": "./self.json"}',
        "/c/missing.json": '{"extends": ["../shared", "nowhere"], "a": 1}', "/c/broken.json": '{"a": ', "/c/list.json": "[1]", "/c/takes.json": '{"extends": ["./broken.json", "./none.json"]}',
        "/d/twice.json": '{"extends": ["../shared", "../shared"], "x": 1}', "/d/none.json": '{"extends": "", "x": 2}', "/d/plain.json": "{}",
        **{f"/e/{k}.json": json.dumps({"n": k, **({"extends": f"./{k + 1}.json"} if k < 13 else {})}) for k in range(14)},
    }
    found, errors = settled_by(spark, files)
    for path in files:
        try:
            wanted = load(files, path)
        except Fails as e:
            assert str(e) in errors[path], path
            assert found[path] == {}
        else:
            assert path not in errors
            assert found[path] == wanted, path
    assert errors["/e/0.json"] == "chain too deep at /e/11.json"
    assert found["/e/3.json"] == {"n": 3}
    assert found["/a/.riftline.json"]["list"] == [0, 0, 1, {"q": 'é"'}, 2, 3]


def test_extends_at_random(spark):
    r = random.Random(5)
    files = {}
    for k in range(40):
        body = {n: r.choice([1, "s", ["a", r.randrange(3)], ["a"], {"x": r.randrange(3)}, {"y": [1]}, None, True]) if n == "mixed" else {"list": [r.randrange(4)], "ignore": [r.choice("ab")], "object": {r.choice("pq"): k}, "plain": k}[n] for n in ("list", "ignore", "object", "plain") if r.random() < 0.6}
        if k and r.random() < 0.8:
            body["extends"] = [f"./{r.randrange(k)}.json" for _ in range(r.randint(1, 3))]
        files[f"{k}.json"] = json.dumps(body)
    found, errors = settled_by(spark, files)
    assert not errors
    for path in files:
        assert found[path] == load(files, path)


def test_invalid_settings(spark):
    rows = [("a", "gate", '{"mode": "staged", "failOn": "orange", "agent": {"mode": "off", "autoFixFloor": "green", "trustSource": "any"}}'), ("a", "graph", '{"enabled": "auto", "security": false, "mode": "cli"}'), ("b", "gate", '{"failOn": "red", "agent": {"mode": "gated2"}}'), ("c", "testScope", '"yes"'), ("d", "graph", '{"enabled": "true"}'), ("e", "gate", '{"mode": 3}'), ("f", "guidelines", '{"tier": null}'), ("g", "other", "1")]
    found = {r.root: r.error for r in policies.invalid(spark.createDataFrame(rows, "root string, name string, value string")).collect()}
    assert found == {
        "b": 'failOn must be one of "green" | "yellow" | "orange", got "red"', "c": 'testScope must be one of true | false, got "yes"', "d": 'graph.enabled must be one of true | false | "auto", got "true"',
        "e": 'gate.mode must be one of "staged" | "working", got 3', "f": 'guidelines.tier must be one of "green" | "yellow" | "orange", got null',
    }


def test_blame(spark):
    one, two = "a" * 40, "0" * 40
    listing = f"{one} 1 1 2\nauthor Ann B\nauthor-time 12\nsummary first\nfilename x\n\tauthor Not This\n{one} 2 2\n\tsummary nor this\n{two} 3 3 1\nauthor Not Committed Yet\nauthor-time 99\nsummary\nfilename x\n\t\n{one} 5 4 1\n\tend"
    rows = spark.createDataFrame([(1, listing), (2, None), (3, ""), (4, "no header")], "file_id long, out string")
    blamed = blame.lines(rows, "file_id", "out")
    assert sorted(tuple(r) for r in blamed.collect()) == [(1, 1, "Ann B", "12", "first", "a" * 8), (1, 2, "Ann B", "12", "first", "a" * 8), (1, 3, "Not Committed Yet", "99", None, "0" * 8), (1, 4, "Ann B", "12", "first", "a" * 8)]
    found = spark.createDataFrame([(1, 2, "x"), (1, 9, "y"), (7, 1, "z")], "file_id long, line int, rule_id string")
    assert sorted((r.rule_id, r.author) for r in blame.attach(found, blamed).collect()) == [("x", "Ann B"), ("y", None), ("z", None)]


def test_sections_within_budget(spark):
    long = "intro\n# Setup\ninstall it\n## Naming rules\nuse names\n# Run tests\nno\n###### Security\nnever\n#NoHeading\n"
    rows = [(1, long + "x" * 10), (2, "# A\nb\n# C\nd" + " " * 60), (3, "  short \n"), (4, None), (5, "# Style\n" + "y" * 100), (6, "# Do not\na\n#\t\nb" + "\n" * 80)]
    got = {r.id: r.t for r in guidelines.within_budget(spark.createDataFrame(rows, "id long, t string"), "id", "t", 60).collect()}
    assert got == {1: ("intro\n## Naming rules\nuse names\n###### Security\nnever\n#NoHeading\nxxxxxxxxxx")[:60] + guidelines.CUT, 2: "# A\nb\n# C\nd", 3: "short", 4: None, 5: ("# Style\n" + "y" * 100)[:60] + guidelines.CUT, 6: "# Do not\na\n#\t\nb"}


def loose(text):
    t = text.strip()
    if not t:
        return None
    try:
        return json.loads(t)
    except ValueError:
        start = min((k for k in (t.find("{"), t.find("[")) if k >= 0), default=-1)
        for end in range(len(t), start, -1) if start >= 0 else ():
            try:
                return json.loads(t[start:end])
            except ValueError:
                continue
    return None


def test_loose_json(spark):
    r = random.Random(6)
    given = ['{"a": 1}', "log line\n{\"a\": [1, {\"b\": \"}]\\\"\"}]} trailing", "[info] x", "a [1, 2] b [3]", "x {broken [1]} y", "no", "", "  ", "5", '"s"', 'w "quote { {"a":1}', '{"a": "open', "[[[]]", 'q [{"k": "\\\\"}] "', "null"]
    bits = ["{", "}", "[", "]", '"', "\\", ",", ":", "1", '"a"', " ", "x", '"a":1', "\n"]
    given += ["".join(r.choice(bits) for _ in range(r.randint(1, 12))) for _ in range(1500)]
    given = [g for g in given if "NaN" not in g]
    rows = spark.createDataFrame([(k, g) for k, g in enumerate(given)], "id long, t string").select("id", "t", T.loose_json(F.col("t")).alias("j")).collect()
    for x in rows:
        assert (json.loads(x.j) if x.j is not None else None) == loose(x.t), x.t
