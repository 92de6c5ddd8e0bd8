"""Payloads of code-graph tools: odd shapes beside those that the queries hold against SQL."""

from riftline.operators import payloads as P


def _rows(spark, of, *bodies):
    return [r for r in of(spark.createDataFrame(list(enumerate(bodies)), "id long, p string"), "id", "p").orderBy("id").collect()]


def test_taint_is_said_implied_or_open(spark):
    found = _rows(spark, P.taint, '{"vulnerable": false, "path": ["a"]}', '{"tainted": null, "exploitable": true}', '{"tainted": 1, "flow": ["a", "b"]}', '{"safe": true, "flow": [{}]}', '{"no_taint": false}', "[]", None)
    assert [r.tainted for r in found] == [False, True, True, None, None, None, None]
    assert [len(r.flow) for r in found] == [1, 0, 2, 0, 0, 0, 0]


def test_lists_are_capped_and_counts_are_not(spark):
    many = ",".join(f"f{k}" for k in range(30))
    one, two = _rows(spark, P.impact, f'{{"callers": "{many}", "untested": ["x"]}}', f'{{"callers": ["a"], "testGaps": "{many}", "result": {{"isReachable": false}}}}')
    assert (one.caller_count, len(one.callers), one.truncated, len(one.test_gaps), one.reachable) == (30, 20, True, 1, None)
    assert (two.caller_count, two.truncated, len(two.test_gaps), two.reachable, two.stale_doc) == (1, True, 20, False, None)


def test_tests_may_be_the_whole_payload(spark):
    found = _rows(spark, P.tests, '["a", {"file": "file:///t/b.py", "line": "12"}]', '{"coveringTests": "c\\nd"}', '{"tests": []}', None)
    assert [[(t.file, t.line, t.symbol) for t in r.tests] for r in found] == [[(None, None, "a"), ("/t/b.py", 12, None)], [(None, None, "c"), (None, None, "d")], [], []]


def test_of_equal_symbols_the_last_counts(spark):
    found = P.changes(spark.createDataFrame([(1, '{"items": [{"name": "f", "callers": ["a"]}, "f", {"id": 3}, {"name": "f", "callers": []}]}'), (2, "nothing")], "id long, p string"), "id", "p").collect()
    assert {(r.id, r.symbol, r.caller_count) for r in found} == {(1, "f", 0), (1, "3", 0)}


def _named(spark, *rows):
    return P.changes(spark.createDataFrame(list(rows), "id long, p string"), "id", "p")


def test_whole_changes_are_read_in_place_and_once(spark):
    plan = _named(spark, (1, "{}"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("get_json_object") + plan.count("from_json") < 20


def test_a_payload_is_a_change_of_its_own(spark):
    found = _named(spark, (1, '{"items": [{"name": "f", "callers": ["a"]}, {"name": "g"}], "commitHint": "x"}'), (1, '{"items": [{"name": "f"}], "docWarnings": ["d", {}, {"id": 4}]}'))
    told = [(r.symbol, r.caller_count, r.commit_hint, [(d.symbol, d.file, d.note) for d in r.stale]) for r in found.collect()]
    assert sorted(told, key=str) == [("f", 0, None, [(None, None, "d"), ("4", None, None)]), ("f", 1, "x", []), ("g", 0, "x", [])]


def test_numbers_and_flags_are_told_from_text_inside(spark):
    one, two = _rows(spark, P.impact, '{"caller_count": 7, "data": {"caller_count": "8", "reachable": true}}', '{"caller_count": "7", "data": {"caller_count": 8, "complexity": 1e2}, "reachable": "true", "stale_doc": null, "docStale": false}')
    assert (one.caller_count, one.reachable, two.caller_count, two.reachable, two.complexity, two.stale_doc) == (7, True, 8, None, 100.0, False)


def test_payloads_that_break_off_say_nothing(spark):
    body = '{"commit_hint": "x", "is_tainted": true, "caller_count": 3, "changes": [{"name": "f"}], "stale_docs": [{"symbol"'
    assert _named(spark, (1, body)).count() == 0
    assert [(r.stale, r.commit_hint) for r in _rows(spark, P.change_notes, body)] == [([], None)]
    assert [(r.caller_count, r.truncated) for r in _rows(spark, P.impact, body)] == [(0, False)]
    assert _rows(spark, P.taint, body)[0].tainted is None
