"""Components and lookups do no work that moves nothing."""

import random

import pytest
from pyspark.sql import functions as F

from riftline.llm import banding, components


@pytest.fixture
def written(monkeypatch):
    """Rows of the tables that components write."""
    rows, whole = [], components.materialise

    def seen(df, **options):
        out = whole(df, **options)
        rows.append(out.count())
        return out

    monkeypatch.setattr(components, "materialise", seen)
    return rows


def least_reached(pairs):
    root = {x: x for p in pairs for x in p}
    while any(root[a] != root[b] for a, b in pairs):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def found(spark, pairs):
    rows = components.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()
    assert len({r["node"] for r in rows}) == len(rows)
    return {r["node"]: r["component"] for r in rows}


def test_stars_are_not_gone_through_again(spark, written):
    pairs = [(10 * k, 10 * k + j) for k in range(8) for j in range(1, 9)]
    assert found(spark, pairs) == least_reached(pairs)
    assert len(written) == 2  # the edges, and the least neighbour of each node


@pytest.mark.parametrize(
    "pairs",
    [
        [(k, k + 1) for k in range(40)],  # a path
        [(k, 100 + (k * 7 + j) % 20) for k in range(20) for j in range(2)],  # no node is between others, many have several smaller ones
        [(0, k) for k in range(1, 30)] + [(k, 30 + k) for k in range(1, 30)],
    ],
)
def test_components_of_shapes(spark, pairs):
    assert found(spark, pairs) == least_reached(pairs)


def test_components_of_chance(spark):
    r = random.Random(3)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(230)]
    pairs = [p for p in pairs if p[0] != p[1]]
    assert found(spark, pairs) == least_reached(pairs)


def _lines(n, seed):
    """Families of lines that lose a few words from step to step, so that their ends are similar by way of others only."""
    r, out = random.Random(seed), []
    for _ in range(n):
        words = [f"w{r.randrange(10**6)}" for _ in range(40)]
        for _ in range(12):
            out.append(" ".join(words))
            words = words[:]
            words[r.randrange(40)] = f"w{r.randrange(10**6)}"
    return out


def test_lookups_end_and_lose_no_link(spark, monkeypatch):
    """Whatever lookups leave is joined; a second one with nothing new is not prepared."""
    opened, whole = [], banding._open

    def seen(*of):
        opened.append(len(opened))
        return whole(*of)

    monkeypatch.setattr(banding, "_open", seen)
    lines = spark.createDataFrame([(t,) for t in _lines(6, 4)], "body string").select(F.xxhash64("body").alias("content"), "body")
    text = {r["content"]: r["body"] for r in lines.collect()}

    def shingles(t):
        w = t.split()
        return {tuple(w[k : k + banding.SHINGLE]) for k in range(len(w) - banding.SHINGLE + 1)}

    sets = {c: shingles(t) for c, t in text.items()}
    met = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    want = least_reached(met)
    # At 0 the first lookup with hits is the last; at the other they go on until nothing is found.
    for hits in (0, 10**9):
        opened.clear()
        monkeypatch.setattr(banding, "HITS", hits, raising=False)
        assert {r["content"]: r["root"] for r in banding.clusters(lines, 20, 2).collect()} == want
        assert len(opened) <= banding.ROUNDS + 1


def test_tables_of_a_lookup_without_hits_are_read_again(spark, monkeypatch):
    opened, whole = [], banding._open
    monkeypatch.setattr(banding, "_open", lambda *of: opened.append(1) or whole(*of))
    # Lines that share a few words and are not similar.
    lines = spark.createDataFrame([(f"a b c d e x{k} " + " ".join(f"y{k}z{j}" for j in range(4)),) for k in range(60)], "body string").select(F.xxhash64("body").alias("content"), "body")
    assert banding.clusters(lines, 20, 1).count() == 0
    assert len(opened) == 1
