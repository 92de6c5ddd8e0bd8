"""Totals of stores and trials, and whole interchange documents, in the cases that the given tables do not hold."""

import json

from pyspark.sql import functions as F

from riftline.operators import learnings, scoring
from riftline.sources import sinks

STORE = "id string, rule_id string, code_hash string, verdict string"
TRIALS = "mode string, known_gap boolean, target_rules array<string>, fired_rules array<string>, kind string"


def test_store_totals(spark):
    rows = [(str(k), rule, "h", verdict) for k, (rule, verdict) in enumerate([("b", "dismiss"), ("a", "dismiss"), ("b", "confirm"), ("c", "other"), ("c", None)])]
    store = spark.createDataFrame(rows, STORE)
    assert [tuple(r) for r in learnings.summary(store).collect()] == [(5, 2, 1, 1 / 3)]
    assert [tuple(r) for r in learnings.summary(store.where("false")).collect()] == [(0, 0, 0, 1.0)]
    assert [tuple(r) for r in learnings.noisiest(store, 5).orderBy("pos").collect()] == [("a", 1, 1), ("b", 1, 2)]
    assert [tuple(r) for r in learnings.noisiest(store, 1).collect()] == [("a", 1, 1)]


def test_trial_totals(spark):
    rows = [
        ("m", False, ["sql-injection"], ["sql-injection", "auth-crypto"], "defect"), ("m", False, ["auth-crypto"], ["auth-crypto"], "advisory"), ("m", False, ["xss-sink"], ["sql-injection"], "defect"), ("m", False, ["xss-sink"], [], "clean"),
        ("m", True, ["xss-sink"], [], "clean"), ("m", True, ["xss-sink"], ["xss-sink"], "defect"), ("m", False, ["xss-sink"], [], "error"), ("n", True, ["a"], [], "error"),
    ]
    found = {r["mode"]: r.asDict() for r in scoring.trial_totals(spark.createDataFrame(rows, TRIALS)).collect()}
    assert found["m"] == {"mode": "m", "total": 7, "errors": 1, "scored": 4, "catches": 3, "defects": 2, "advisories": 1, "on_target": 1, "gap_clean": 1, "defect_rate": 0.5, "advisory_rate": 0.25, "on_target_rate": 0.25}
    assert (found["n"]["scored"], found["n"]["defect_rate"], found["n"]["gap_clean"]) == (0, 0.0, 0)


def test_interchange_documents(spark):
    rows = [("p", "b.js", 1, 4, 0, 6, 5, "r1", "One", "orange", 'say "x"\n', "f", 3), ("p", "a.js", 2, 9, 1, None, None, "r2", "Two", "yellow", "m", None, None), ("p", "a.js", 1, 2, 0, 2, 3, "r1", "Other", "green", "m", None, None), ("q", "c.js", 1, 1, 0, 1, 0, "r1", "One", "green", "m", None, None)]
    frame = spark.createDataFrame(rows, "project string, path string, pos int, line int, col int, end_line int, end_col int, rule_id string, title string, tier string, message string, symbol string, caller_count int")
    found = {r.project: json.loads(r.document) for r in sinks.sarif_documents(frame, "project", "2").collect()}
    run = found["p"]["runs"][0]
    assert [(r["id"], r["shortDescription"]["text"]) for r in run["tool"]["driver"]["rules"]] == [("r1", "Other"), ("r2", "Two")]
    assert [(r["ruleId"], r["level"], r["message"]["text"], r.get("properties")) for r in run["results"]] == [("r1", "note", "m", None), ("r2", "warning", "m", None), ("r1", "error", 'say "x"\n', {"symbol": "f", "callerCount": 3})]
    assert [r["locations"][0]["physicalLocation"]["region"] for r in run["results"]][1:] == [{"startLine": 9, "startColumn": 2, "endLine": 9, "endColumn": 2}, {"startLine": 4, "startColumn": 1, "endLine": 6, "endColumn": 6}]
    assert len(found["q"]["runs"][0]["results"]) == 1
    assert sinks.sarif_documents(frame.where(F.lit(False)), "project").count() == 0
