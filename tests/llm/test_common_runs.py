"""Passages inside other text, against all common runs of words found by brute force."""

import random
from collections import defaultdict

import pytest

from riftline.llm import substrings


def _texts():
    r = random.Random(12)
    vocabulary = [f"w{k}" for k in range(4000)]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    docs = []
    for size in (14, 20, 24, 25, 26, 30, 51, 90):
        for _ in range(12):
            passage = some(size)
            docs += [some(r.randint(0, 70)) + passage + some(r.randint(0, 70)) for _ in range(r.choice([2, 2, 3]))]
    # Chains: one document shares different runs, overlapping, with two others.
    for _ in range(10):
        a = some(80)
        docs += [some(30) + a + some(30), some(9) + a[:45] + some(20), some(20) + a[30:] + some(11)]
    spam = ["buy", "now", "at", "shop"] * 40
    docs += [some(40) + spam + some(40), some(3) + spam[:90] + some(50), some(30) + ["one"] * 70 + some(9), some(8) + ["one"] * 50 + some(20)]
    # Texts of one word between two spaces, of a run at either end, of other characters and cases.
    end = some(33)
    docs += [end + some(40), some(40) + end, [x.upper() + "é" for x in end] + some(5), some(5) + [x + "é" for x in end]]
    return [" \n"[r.randint(0, 20) == 0].join(x) if r.random() < 0.5 else " ".join(x) for x in docs]


def _repeated(texts, size):
    """For each text its words with a flag: whether in a run of ``size`` words that another text has."""
    split = [t.lower().split() for t in texts]
    owners = defaultdict(set)
    for d, w in enumerate(split):
        for k in range(len(w) - size + 1):
            owners[tuple(w[k : k + size])].add(d)
    flags = [[False] * len(w) for w in split]
    for d, w in enumerate(split):
        for k in range(len(w) - size + 1):
            if len(owners[tuple(w[k : k + size])]) > 1:
                flags[d][k : k + size] = [True] * size
    return flags


def _covered(texts, found):
    flags = []
    for d, t in enumerate(texts):
        spans, at, row = [(x.start, x.end) for x in found if x.doc_id == d], 0, []
        for w in t.split():
            at = t.index(w, at)
            row.append(any(a <= at and at + len(w) <= b for a, b in spans))
            at += len(w)
        flags.append(row)
    return flags


@pytest.mark.parametrize("least", [25, 9])
def test_every_common_run_is_found_to_the_word(spark, least):
    texts = _texts()
    found = substrings.query(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), least=least).collect()
    got, wanted = _covered(texts, found), _repeated(texts, least)
    loose = _repeated(texts, substrings.sizes(least)[0])
    for d in range(len(texts)):
        assert not [k for k, (g, w) in enumerate(zip(got[d], wanted[d], strict=True)) if w and not g], d
        assert not [k for k, (g, w) in enumerate(zip(got[d], loose[d], strict=True)) if g and not w], d
        # What is kept and what is removed of one passage are spans of their own; together they are long enough.
        lengths = [len(x) for x in "".join("x" if g else " " for g in got[d]).split()]
        assert all(n >= least for n in lengths), d
    for x in found:
        assert x.words == len(texts[x.doc_id][x.start : x.end].split())
        assert x.start == 0 or texts[x.doc_id][x.start - 1].isspace()
