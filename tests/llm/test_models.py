"""Whitening, hard negatives and toxicity against plain models of their contracts, on small tables with awkward rows."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riftline.llm import hardneg, toxicity, whitening
from riftline.llm.registry import queries
from tests.compare import connect, same
from tests.llm.test_contracts import CLASHES, DOCS, frame, words

SF = "/root/testdata/sf0.001"
VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def vectors(spark, rows):
    made = spark.createDataFrame(rows, VECTORS)
    return made.withColumns({c: F.lit("clash") for c in (*CLASHES, "x", "row", "anchor", "windows", "component", "width", "rank")})


def some(n, size, seed, *, spread=1.0):
    r = random.Random(seed)
    return [[r.gauss(0, 1) * spread / (k + 1) for k in range(size)] for _ in range(n)]


# whitening


@pytest.mark.parametrize("size", [1, 2, 3, 7, 40])
@pytest.mark.parametrize("kind", ["random", "same", "steps", "falling", "near"])
def test_spectral(size, kind):
    r = np.random.default_rng(size)
    q = np.linalg.qr(r.standard_normal((size, size)))[0]
    values = {"random": r.standard_normal(size), "same": np.ones(size), "steps": 1.0 + np.arange(size) // 3, "falling": 10.0 ** -np.arange(size), "near": 1 + 1e-13 * np.arange(size)}[kind]
    a = (q * values) @ q.T
    for top in (None, 4):
        e, v = whitening.spectral(a, top)
        assert len(e) == v.shape[1] == min(size, top or size)
        scale = np.linalg.norm(a)
        assert np.abs(e - np.sort(values)[::-1][: len(e)]).max() < 1e-13 * scale
        assert np.linalg.norm((a + a.T) / 2 @ v - v * e) < 1e-12 * scale
        assert np.linalg.norm(v.T @ v - np.eye(len(e))) < 1e-12


def test_polar():
    r = np.random.default_rng(1)
    q = np.linalg.qr(r.standard_normal((9, 9)))[0]
    u = whitening.polar((q * np.array([5, 4, 1e-9, 1, -1e-9, -1, -2, -3, -4])) @ q.T)
    assert np.abs(u - (q * np.array([1, 1, 1, 1, -1, -1, -1, -1, -1])) @ q.T).max() < 1e-6
    assert not whitening.polar(np.zeros((3, 3))).any()


def whitened(rows):
    """The contract in numpy: (vec_id, component) to its values, as lists."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v, _ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    width = 6
    kept = [(i, x) for i, x in kept if len(x) == width]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    c = (fit * n - sums).astype(float) / n
    e, w = np.linalg.eigh(c.T @ c / n)
    out = {}
    for i, x in kept:
        d = [n * a - s for a, s in zip(x, sums, strict=True)]
        for k in range(4):
            out.setdefault((i, k + 1), []).append((n, sum(a * a for a in d), abs(np.dot([a / n for a in d], w[:, -1 - k]) / math.sqrt(e[-1 - k])), e[-1 - k] / e.sum()))
    return {k: sorted(v) for k, v in out.items()}


def test_whitening(spark):
    base = some(60, 6, 3)
    rows = [(k, v, 0) for k, v in enumerate(base)]
    rows += [(100, None, 0), (101, [None] * 6, 0), (102, [float("nan")] * 6, 0), (103, [float("inf")] + [0.0] * 5, 0), (104, [], 0), (105, [1.0] * 5, 0), (106, [3e30] * 6, 0)]
    rows += [(5, base[5], 0), (7, base[8], 1), (107, base[0], 0), (None, base[1], None), (108, [0.0] * 6, 0), (109, [-0.0] * 6, 0), (110, [300.25] + [0.0] * 5, 0)]
    found = whitening.query(vectors(spark, rows)).collect()
    wanted = whitened([r for r in rows if r[0] != 106])
    got = {}
    for r in found:
        got.setdefault((r.vec_id, r.component), []).append((r.n, r.deviation, abs(r.whitened), r.explained))
        assert r.identity_error < 1e-9
    assert got.keys() == wanted.keys()
    for k, v in got.items():
        assert len(v) == len(wanted[k])
        for a, b in zip(sorted(v), wanted[k], strict=True):
            assert a[:2] == b[:2]
            assert a[2:] == pytest.approx(b[2:], rel=1e-6, abs=1e-9)
    one_sign = {}
    for r in found:
        one_sign.setdefault((r.component, r.vec_id), set()).add(r.whitened)
    assert len(one_sign[1, 5]) == 1


def test_whitening_of_little(spark):
    assert whitening.query(vectors(spark, [])).count() == 0
    assert whitening.query(vectors(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (3, None, 0)])).count() == 0
    line = whitening.query(vectors(spark, [(1, [0.0, 0.0], 0), (2, [1.0, 0.0], 0)])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in line) == [(1, 1, 2, 65536, 1.0, 1.0), (2, 1, 2, 65536, 1.0, 1.0)]
    huge = whitening.query(vectors(spark, [(1, [0.0], 0), (2, [1e15], 0)])).collect()
    assert [r.deviation for r in huge] == [None, None]


# hard negatives


def negatives(rows):
    used = [(r, i, (y + 1) % 10 if i is not None and i % 7 == 0 else y, [math.floor(256 * float(np.float32(c))) for c in v]) for r, (i, v, y) in enumerate(rows) if y is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    order = lambda s: (-s[0], s[1] is None, s[1] or 0, s[2])
    out = []
    for r, i, y, x in used:
        if i is None or i % 50:
            continue
        scores = [(sum(a * b for a, b in zip(x, z, strict=True)), j, q, w) for q, j, w, z in used if q != r and len(z) == len(x)]
        for p in sorted((s for s in scores if s[3] == y), key=order)[:5]:
            inside = sorted((s for s in scores if s[3] != y and 50 * p[0] <= 100 * s[0] <= 95 * p[0]), key=order)[:3]
            out += [(i, p[1], k + 1, s[1], p[0], s[0]) for k, s in enumerate(inside)]
    return sorted(map(str, out))


@pytest.mark.parametrize("sizes", [(2000, 8000, 1000), (4, 30, 7)])
def test_negatives(spark, monkeypatch, sizes):
    for name, n in zip(("ANCHORS", "CANDIDATES", "CHUNK"), sizes, strict=True):
        monkeypatch.setattr(hardneg, name, n)
    base = some(400, 5, 9)
    rows = [(k, [c + 0.4 for c in v], k % 3) for k, v in enumerate(base)]
    rows += [(50, rows[50][1], 50 % 3), (50, rows[51][1], 1), (401, rows[0][1], 2), (402, rows[0][1], 0), (403, rows[0][1], 2), (None, rows[0][1], 0), (None, rows[3][1], 1)]
    rows += [(450, None, 1), (500, [1.0] * 5, None), (550, [float("nan")] * 5, 1), (600, [None] * 5, 1), (650, [], 1), (700, [1.0, 0.0], 1), (701, [1.0, 0.5], 2), (702, [0.5, 0.5], 3), (750, [0.0] * 5, 1), (800, [-1.0] * 5, 2), (850, [0.3] * 5, 99)]
    found = hardneg.query(vectors(spark, rows)).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    wanted = negatives(rows)
    assert len(wanted) > 60
    assert sorted(str(tuple(r)) for r in found) == wanted
    assert hardneg.query(vectors(spark, [])).count() == 0


def test_negatives_beyond_doubles(spark):
    rows = [(0, [3e5, 1.0], 0), (1, [3e5, 2.0], 2), (2, [3e5, 3.0], 1), (3, [2e5, 1.0], 2), (4, [2e5, 1.0 + 2**-8], 3), (5, [2e9, 1.0], 3)]
    found = hardneg.query(vectors(spark, rows)).collect()
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for _, v, _ in rows]
    dot = lambda a, b: sum(p * q for p, q in zip(x[a], x[b], strict=True))
    assert [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in sorted(found, key=lambda r: r["rank"])] == [(0, 2, 1, 4, dot(0, 2), dot(0, 4)), (0, 2, 2, 3, dot(0, 2), dot(0, 3))]


def test_negatives_as_sql(spark):
    assert same(queries()["op13_negatives"](spark, SF), hardneg.ORACLE_SQL, connect(SF))


def test_tree_bounds_prune():
    """The bounds let a cell score only a part of its candidates where anchors are close."""
    r = np.random.default_rng(0)
    anchors = np.floor(256 * (r.standard_normal((1, 8)) + 0.01 * r.standard_normal((50, 8)))).astype(np.int64)
    candidates = np.floor(256 * r.standard_normal((500, 8))).astype(np.int64)
    scored = []

    class Seen(np.ndarray):
        def __matmul__(self, other):
            scored.append(len(self))
            return np.asarray(self) @ np.asarray(other)

    exact = anchors @ candidates.T
    windows = [[(int(np.sort(s)[-20]), int(np.sort(s)[-3]))] for s in exact]
    allowed = lambda a, part: np.ones(len(range(*part.indices(500))), dtype=bool)
    whole = candidates.view(Seen)
    found = hardneg.scan(anchors, windows, whole, [(False, k, k) for k in range(500)], allowed, 3)
    for s, (window,), (best,) in zip(exact, windows, found, strict=True):
        assert [(b[0], b[2]) for b in best] == sorted(((int(v), k) for k, v in enumerate(s) if window[0] <= v <= window[1]), key=lambda p: (-p[0], p[1]))[:3]
    assert sum(scored) < 0.25 * 50 * 500


# toxicity


def test_gradients():
    net, reader, r = toxicity.Network.new(), toxicity.Reader(), np.random.default_rng(0)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    read = reader.read(["alpha beta gamma", "one two three four five six", "é"])
    start, size, _ = toxicity.windows(read.begin)
    ids, mask = toxicity._padded(read, start, size)
    x, y = 5 * net.inputs(read).astype(np.float64), np.array([1.0, 0.0, 1.0])
    _, g = net.backward(x, ids, mask, y)
    for name, slope in g.items():
        of = x if name == "x" else net.w[name]
        for _ in range(4):
            at = tuple(r.integers(0, s) for s in of.shape)
            old, step, losses = of[at], 1e-2, []
            for moved in (old + step, old - step):
                of[at] = moved
                losses.append(net.backward(x, ids, mask, y)[0])
            of[at] = old
            assert (losses[0] - losses[1]) / (2 * step) == pytest.approx(slope[at], abs=5e-6)


def test_windows_cover_and_overlap():
    for n in (0, 1, 31, 32, 33, 48, 49, 100, 1000):
        start, size, of = toxicity.windows(np.array([0, n]))
        seen = sorted({p for a, b in zip(start, size, strict=True) for p in range(a, a + b)})
        assert seen == list(range(n))
        assert (np.diff(start) <= toxicity.STRIDE).all()
        assert not of.any()


def test_words_are_those_of_a_pattern():
    texts = ["", "Ab, ab! ÀB x9", " \n", "𝔘x ab", "ab"]
    read = toxicity.Reader().read(texts)
    assert np.diff(read.begin).tolist() == [0, 4, 0, 2, 1]
    ids = read.id.tolist()
    assert ids[0] == ids[1] == ids[5] == ids[6]
    assert len(set(ids)) == 4


def test_parts_hold_every_window(monkeypatch):
    monkeypatch.setattr(toxicity, "PART", 700)
    text = " ".join(f"w{k}" for k in range(900)) + " " + "x" * 2000 + " tail"
    parts = list(toxicity._parts(text))
    assert len(parts) > 5
    held = [p.split() for p in parts]
    whole = text.split()
    for k in range(len(whole) - toxicity.STRIDE):
        run = whole[k : k + toxicity.STRIDE]
        assert any(run == h[j : j + len(run)] for h in held for j in range(len(h) - len(run) + 1))


def rude(k, toxic):
    r = random.Random(k)
    said = words(r.randint(20, 200), k).split()
    if toxic:
        for _ in range(3):
            said.insert(r.randrange(len(said)), r.choice(["nitwit", "Dolt", "oaf!"]))
    return " ".join(said)


def test_toxicity(spark):
    rows = [(k, rude(k, k % 4 == 0), "en", "s", 1) for k in range(400)]
    more = [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (1002, "?! -", "en", "s", 0), (1003, words(30_000, 5) + " nitwit, you oaf. Dolt " + words(30_000, 6), "en", "s", 0), (1004, words(30_000, 7), "en", "s", 0), (None, rows[0][1], None, None, None), (0, rows[0][1], "fr", "t", 2)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)] + [(8, 1, 1), (9, 0, None), (None, 1, 1), (5000, 1, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash")).withColumn("score", F.lit(2))
    found = toxicity.query(frame(spark, rows + more), labels).collect()
    assert len(found) == len(rows) + len(more)
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        assert r.predicted == (r.score >= 0.3)
    held = [k for k in range(400) if by_id[k][0].held_out]
    right = sum(by_id[k][0].predicted == (k % 4 == 0) for k in held)
    assert right >= 0.97 * len(held)
    assert [by_id[k][0].score for k in (1000, 1001, 1002)] == [0, 0, 0]
    assert (by_id[1003][0].predicted, by_id[1004][0].predicted) == (1, 0)
    assert {r.score for r in by_id[0]} == {by_id[None][0].score}


def test_toxicity_without_lessons(spark):
    docs = frame(spark, [(1, "a b", "en", "s", 3), (2, None, "en", "s", 3)])
    for marks in ([], [(1, 1, 1)], [(2, 1, 1), (1, 1, 0)]):
        found = toxicity.query(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
        assert sorted((r.doc_id, r.score, r.predicted) for r in found) == [(1, 0.0, 0), (2, 0.0, 0)]
    assert toxicity.query(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
