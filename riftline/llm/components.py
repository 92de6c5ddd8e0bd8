"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Before each step the least neighbour of every node is found, and, while that is written, whether either step would still
move an edge: a step that would not is left out, and edges that are stars around their least nodes are not gone through
again. A step is an aggregation and a join on node ids, written to the shared folder; nothing but a few numbers a step
comes to the driver. Minima are aggregated before they are shuffled and joined back as tables of their own, so that Spark
can split the partition of a node with very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from riftline.llm.common import forget, materialise


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _nearest(edges: DataFrame) -> tuple[DataFrame, int, int]:
    """u, m (the least of a node and its neighbours); how many nodes have smaller and larger neighbours, and how many
    several smaller ones. If none have either, ``m`` is the component."""
    of = _both(edges).groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count_if(F.col("v") < F.col("u")).alias("smaller"))
    seen = Observation()
    between = (F.col("low") < F.col("u")) & (F.col("high") > F.col("u"))
    nearest = materialise(of.observe(seen, F.count_if(between).alias("between"), F.count_if(F.col("smaller") > 1).alias("several")).select("u", F.least("u", "low").alias("m")))
    return nearest, seen.get["between"], seen.get["several"]


def _large_star(edges: DataFrame, nearest: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the least of its neighbourhood; no edge moves if no node is between others."""
    return _both(edges).where("v > u").join(nearest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, nearest: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of these, as edges run from larger to smaller; no edge moves if
    no node has several."""
    moved = edges.join(nearest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(nearest.where("m < u").select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str, *, rounds: int = 60) -> DataFrame:
    """node, component (the least node that it reaches): one row for each node that has an edge to another.

    Defined cases: an edge with a null end or from a node to itself is none; repeated edges count once; no edges give no
    rows; other columns are ignored.
    """
    now = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    small = False
    for _ in range(2 * rounds):
        nearest, between, several = _nearest(now)
        if not between and not several:
            forget(now)
            return nearest.select(F.col("u").alias("node"), F.col("m").alias("component"))
        small = bool(several) and (small or not between)
        moved = materialise((_small_star if small else _large_star)(now, nearest))
        forget(now, nearest)
        now, small = moved, not small
    raise RuntimeError(f"components did not settle in {rounds} rounds")
