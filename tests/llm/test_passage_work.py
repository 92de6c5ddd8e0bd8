"""What copies of one text cost op10, and what is said of each of them."""

import pytest

from riftline.llm import substrings
from tests.llm.test_contracts import words


def _shuffled(spark):
    """Rows that all stages so far have shuffled."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_copies_are_worked_through_once(spark):
    """Each copy has some 50 repeats; it may add a few rows to the work, not a few for each repeat."""
    text, took = words(400, 1), []
    for n in (20, 220):
        docs = spark.createDataFrame([(k, text) for k in range(n)] + [(1000 + k, words(90, 2 + k)) for k in range(20)], "doc_id long, text string")
        before = _shuffled(spark)
        found = substrings.query(docs).collect()
        took.append(_shuffled(spark) - before)
        assert {(x.doc_id, x.start, x.end, x.words, x.kept_doc_id, x.removed) for x in found} == {(k, 0, len(text), 400, 0, k > 0) for k in range(n)}
    assert took[1] - took[0] < 200 * 25


@pytest.mark.parametrize("key", ["long", "string"])
def test_copies_beside_other_passages(spark, key):
    """Copies follow the first of them, also where that begins with a passage of an earlier document; a key may be null, repeated or a text."""
    a, b, c = words(40, 31), words(60, 32), words(30, 33)
    texts = [(3, f"{a} {words(50, 34)}"), (5, f"{a} {b}"), (7, f"{a} {b}"), (9, f"{a} {b}"), (9, f"{a} {b}"), (7, c), (None, c), (8, words(80, 35))]
    rows = [(k if k is None or key == "long" else str(k), t) for k, t in texts]
    found = substrings.query(spark.createDataFrame(rows, f"doc_id {key}, text string")).collect()
    name = (lambda k: k if k is None else int(k)) if key == "string" else (lambda k: k)
    got = sorted(((name(x.doc_id), x.start, x.end, name(x.kept_doc_id), x.removed) for x in found), key=str)
    whole = len(a) + 1 + len(b)
    # Of the copies' first, what an earlier document has is to be removed and the rest stays; whole grams only, so ends are looser.
    copies = [(k, 0, whole, 3, True) for k in (7, 9)]
    assert [x for x in got if x[0] in (7, 9) and x[2] == whole] == copies
    assert [x for x in got if x[0] in (3, 8)] == [(3, 0, len(a), 3, False)]
    assert [x for x in got if x[0] is None] == [(None, 0, len(c), None, False)]
    assert [x for x in got if x[0] == 7 and x[2] == len(c)] == [(7, 0, len(c), None, True)]
    first = [x for x in got if x[0] == 5]
    assert [(x[1], x[3], x[4]) for x in first if x[4]] == [(0, 3, True)]
    assert max(x[2] for x in first) == whole
