"""Identifiers that contexts give away: all four kinds against planted truth, and chains of contexts to their end."""

import random

from riftline.llm import pii
from tests.llm.test_contracts import words


def _found(spark, rows):
    return {r.doc_id: {tuple(x.split(":")) for x in r.spans.split(",") if x} for r in pii.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def _card(r, good):
    while True:
        d = "4" + "".join(r.choice("0123456789") for _ in range(15))
        if pii.luhn(d) == good:
            return d


def test_each_kind_is_discovered_and_nothing_else(spark):
    """Per kind 12 known and 6 unseen ones in one context, which also stands alone at times; 30 look-alikes elsewhere."""
    r = random.Random(3)
    known = {"email": lambda k: f"joe{k}@mail{k}.example.org", "ip": lambda k: f"10.{k}.3.4", "card": lambda k: _card(r, True), "phone": lambda k: f"+1 (555) 123-4{k:03d}"}
    unseen = {"email": lambda k: f"ann{k} [at] mail{k}.example.org", "ip": lambda k: f"310.{k}.3.4", "card": lambda k: _card(r, False), "phone": lambda k: f"555-987-4{k:03d}"}
    before = {"email": "schreib an", "ip": "rechner adresse", "card": "konto karte", "phone": "ruf hotline"}
    rows, wanted, decoys = [], {}, set()

    def add(text, kind, what):
        d = len(rows)
        head = f"{words(r.randint(5, 40), 10 * d)} {text} "
        rows.append((d, f"{head}{what} {words(r.randint(5, 40), 10 * d + 1)}"))
        wanted[d] = {(kind, str(len(head)), str(len(head) + len(what)))} if kind else set()
        return d

    for kind, context in before.items():
        for k in range(12):
            add(context, kind, known[kind](k))
        for k in range(6):
            add(context, kind, unseen[kind](500 + k if kind != "ip" else 50 + k))
        for _ in range(4):
            add(context, None, "niemand")
        for k in range(30):
            decoys.add(add(words(2, 77_000 + len(rows)), None, unseen[kind](800 + k if kind != "ip" else 80 + k)))
    found = _found(spark, rows)
    assert {d: found[d] for d in wanted if d not in decoys} == {d: w for d, w in wanted.items() if d not in decoys}
    assert not [d for d in decoys if found[d]]


def test_rounds_go_on_until_nothing_is_new(spark):
    """Six contexts in a row, each holding the identifiers of the one before and as many new ones less one."""
    rows, names, number = [], [f"+1 (555) 123-4{k:03d}" for k in range(9)], 0
    levels = []
    for level in range(6):
        fresh = [f"555-98{level}-4{k:03d}" for k in range(8 - level // 2)]
        for what in names + fresh:
            rows.append((number, f"{words(9, 50 + 2 * number)} ruf hotline{level} {what} {words(9, 51 + 2 * number)}"))
            number += 1
        levels.append(fresh)
        names = fresh
    texts = dict(rows)
    found = {texts[d][int(a) : int(b)] for d, spans in _found(spark, rows).items() for _, a, b in spans}
    assert [len(set(fresh) - found) for fresh in levels] == [0] * 6
