"""Large groups of near copies: exact links, by work that grows with the group and not with its square."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riftline.llm import simhash
from riftline.llm.components import components


def near_copies(n, seed):
    """Prints none to eight bits from one, so that most are further than four bits apart."""
    r, found = np.random.default_rng(seed), set()
    while len(found) < n:
        found.add(sum(1 << int(k) for k in r.choice(63, r.integers(0, 9), replace=False)))
    return sorted(found)


def by_all_pairs(prints, distance):
    p, root = np.array(prints), np.array(prints)
    close = np.bitwise_count(p[:, None] ^ p) <= distance
    while True:
        least = np.where(close, root, root.max()).min(axis=1)
        if (least == root).all():
            return {x: y for x, y, many in zip(prints, root.tolist(), (close.sum(axis=1) > 1).tolist(), strict=True) if many}
        root = least


@pytest.mark.parametrize(("small", "distance"), [(2, 4), (2, 3), (simhash.SMALL, 4)])
def test_links_of_near_copies_are_those_of_all_pairs(spark, monkeypatch, small, distance):
    monkeypatch.setattr(simhash, "SMALL", small)
    prints = near_copies(400, 5)
    found = simhash.link(spark.createDataFrame([(p,) for p in prints], "print long"), distance=distance).collect()
    assert {r["print"]: r["root"] for r in found} == by_all_pairs(prints, distance)


def test_prints_that_share_a_point_are_those_within_the_distance():
    import pyarrow as pa

    p = np.array(near_copies(60, 6))
    for distance in (1, 2, 3, 4):
        (batch,) = simhash._points([pa.RecordBatch.from_arrays([pa.array(p), pa.array(p)], names=["print", "root"])], distance=distance)
        own = {}
        for point, bit, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own.setdefault(root, set()).add((point, bit))
        for a in own:
            for b in own:
                assert bool(own[a] & own[b]) == ((a ^ b).bit_count() <= distance)


def test_rows_of_joins_grow_as_the_group(spark, monkeypatch):
    """A bucket's rows are never joined with each other: joins on its key add no row to what they read."""
    most = []
    whole = simhash.materialise

    def counted(df, **options):
        out = whole(df, **options)
        if "key" in out.columns:
            most.append(out.groupBy("key", "print").count().agg(F.max("count")).first()[0] if "print" in out.columns else 1)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.splitlines() if "Join Inner" in x and "key#" in x and "other" in x]
        return out

    monkeypatch.setattr(simhash, "materialise", counted)
    edges = simhash.edges(spark.createDataFrame([(p,) for p in near_copies(400, 7)], "print long"))
    assert components(edges, "a", "b").count()
    assert set(most) == {1}
