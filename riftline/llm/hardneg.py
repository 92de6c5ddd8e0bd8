"""Hard negatives by spanning-tree bounds.

Vectors become whole numbers (256 parts of a unit) and a score is their inner product. Anchors stand in blocks, and the
anchors of a block form a minimum spanning tree. A candidate's score with a child lies within the edge's distance times
the candidate's norm of its score with the parent; only candidates whose bounds overlap a window of wanted scores are
scored with the child, and for the others the bounds go further down the tree. Windows of positives reach from the
last score of the best so far; windows of negatives are shares of each positive's score, and rise with the best so far.

Anchors by candidates are cells: blocks of at most about ``ANCHORS`` anchors by ``CANDIDATES`` rows, dealt by hashes of
row numbers, so that no label or vector makes a cell larger. Positives are sought in the cells of a label. A cell keeps
the few best rows of each window, and a ranking over all cells of an anchor, limited before the shuffle, gives the rest.
The work grows with anchors times rows, as the task does; the bounds save scoring, not the look at a bound.

Defined cases: rows with a null label or vector, or with a null or non-finite component, take no part, nor do vectors
whose whole-number norm is 2^31 or more (scores would not fit in a long). Rows of a null key take part but are no
anchors and come last of ties. Rows that repeat are rows of their own, so that a copy of an anchor is a positive of it;
an anchor that repeats gets its results once for each. Vectors of different sizes, and empty ones, are never compared.
An anchor without positives, or without rows in a window, has no rows. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riftline.llm.common import materialise

PARTS, ANCHORS, CANDIDATES, CHUNK = 256, 2000, 8000, 1000
POSITIVES, NEGATIVES, LEAST, MOST = 5, 3, 50, 95


def tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """order (parents before children), parent (-1: none) and edge length of a minimum spanning tree."""
    n = len(points)
    order, parent, edge = np.zeros(n, dtype=np.int64), np.full(n, -1), np.zeros(n)
    square = (points * points).sum(axis=1)
    far, near = np.full(n, np.inf), np.full(n, -1)
    at, open_ = 0, np.ones(n, dtype=bool)
    for k in range(n):
        order[k], parent[at], open_[at] = at, near[at], False
        away = square + square[at] - 2 * (points @ points[at])
        closer = open_ & (away < far)
        far[closer], near[closer] = away[closer], at
        if k + 1 < n:
            at = int(np.where(open_, far, np.inf).argmin())
    has = parent >= 0
    edge[has] = np.sqrt(((points[has] - points[parent[has]]) ** 2).sum(axis=1))
    return order, parent, edge


def _last(best: list[tuple], k: int) -> float:
    return best[-1][0] if len(best) == k else -np.inf


def scan(anchors: np.ndarray, windows: list[list[tuple[float, float]]], candidates: np.ndarray, names: list[tuple], allowed: Callable[[int, slice], np.ndarray], k: int) -> list[list[list[tuple]]]:
    """The ``k`` best candidates of each anchor and window, as (score, *name); smaller names win ties.

    anchors, candidates: whole numbers (rows by entries). windows: (least, most) scores, a list an anchor. allowed: which
    candidates of a slice an anchor may take.
    """
    wide = np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1))
    order, parent, edge = tree(anchors.astype(np.float64))
    best: list[list[list[tuple]]] = [[[] for _ in w] for w in windows]
    for start in range(0, len(candidates), CHUNK):
        part = slice(start, min(start + CHUNK, len(candidates)))
        norm = np.sqrt((candidates[part].astype(np.float64) ** 2).sum(axis=1))
        exact = np.float64 if wide.max() * norm.max(initial=0) < 2**52 else np.int64  # sums of products stay below that
        rows, of = candidates[part].astype(exact), anchors.astype(exact)
        slack = 1e-14 * wide.max() * norm + 1e-6
        low, high = np.empty((len(anchors), len(norm))), np.empty((len(anchors), len(norm)))
        for a in order:
            up = parent[a]
            if up < 0:
                low[a], high[a] = -np.inf, np.inf
            else:
                reach = edge[a] * norm * (1 + 1e-9) + slack
                np.subtract(low[up], reach, out=low[a])
                np.add(high[up], reach, out=high[a])
            if not windows[a]:
                continue
            wanted = np.zeros(len(norm), dtype=bool)
            for (least, most), found in zip(windows[a], best[a], strict=True):
                wanted |= (high[a] >= max(least, _last(found, k))) & (low[a] <= most)
            at = np.flatnonzero(wanted & allowed(a, part))
            if not len(at):
                continue
            score = rows[at] @ of[a]
            low[a, at] = high[a, at] = score
            for (least, most), found in zip(windows[a], best[a], strict=True):
                inside = np.flatnonzero((score >= max(least, _last(found, k))) & (score <= most))
                if len(inside) > 4 * k:  # the k-th score of these, and what ties with it
                    inside = inside[score[inside] >= np.partition(score[inside], -k)[-k]]
                if len(inside):
                    found += [(int(score[i]), *names[start + at[i]]) for i in inside]
                    found.sort(key=lambda f: (-f[0], f[1:]))
                    del found[k:]
    return best


def _cells(asks: DataFrame, rows: DataFrame, group: list[str]) -> DataFrame:
    """Blocks of ``asks`` by blocks of ``rows`` with equal ``group`` columns; asks: those in front of each cell."""
    counts = asks.groupBy(*group).agg(F.count(F.lit(1)).alias("a")).join(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")), group)
    sizes = materialise(counts.select(*group, F.ceil(F.col("a") / ANCHORS).cast("int").alias("across"), F.ceil(F.col("n") / CANDIDATES).cast("int").alias("down")))
    own = lambda c, salt: F.pmod(F.xxhash64(F.col("row"), F.lit(salt)), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    names = [*dict.fromkeys([*group, "i", "j", "asks", "row", "key", "label", "x", "windows"])]
    left = asks.join(sizes, group).withColumns({"i": own("across", 1), "j": every("down"), "asks": F.lit(True)}).select(names)
    right = rows.join(sizes, group).withColumns({"j": own("down", 2), "i": every("across"), "asks": F.lit(False), "windows": F.lit(None).cast("array<struct<low:long,high:long>>")}).select(names)
    return left.unionByName(right).repartition(*group, "i", "j").sortWithinPartitions(*group, "i", "j", F.desc("asks"))


def _best(cells: DataFrame, group: list[str], k: int, allowed: Callable[[dict, dict], Callable[[int, slice], np.ndarray]]) -> DataFrame:
    """anchor (its row), window (from 0), row, key, score: the ``k`` best of each window, of all cells."""
    names = [*group, "i", "j"]

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        asks = table.column("asks").to_numpy()
        front, back = table.slice(0, int(asks.sum())), table.slice(int(asks.sum()))
        if not len(front) or not len(back):
            return
        columns = lambda t: {c: t.column(c).to_numpy() for c in ("row", "label")} | {"x": t.column("x").combine_chunks().flatten().to_numpy().reshape(len(t), -1)}
        a, c = columns(front), columns(back)
        keys = [(key is None, key or 0, row) for key, row in zip(back.column("key").to_pylist(), c["row"].tolist(), strict=True)]
        windows = [[(w["low"], w["high"]) for w in ws] for ws in front.column("windows").to_pylist()]
        found = scan(a["x"], windows, c["x"], keys, allowed(a, c), k)
        flat = [(int(a["row"][i]), w, f[3], None if f[1] else f[2], f[0]) for i, of in enumerate(found) for w, best in enumerate(of) for f in best]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(zip(*flat, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["anchor", "window", "row", "key", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([carry, table]) if carry is not None else table
            cells_of = np.stack([table.column(c).to_numpy() for c in names])
            cut = [0, *(np.flatnonzero((cells_of[:, 1:] != cells_of[:, :-1]).any(axis=0)) + 1)]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                yield from solve(table.slice(lo, hi - lo))
            carry = table.slice(cut[-1])
        if carry is not None:
            yield from solve(carry)

    each = cells.mapInArrow(run, "anchor long, window int, row long, key long, score long")
    place = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("key"), "row"))
    return each.withColumn("rank", place).where(F.col("rank") <= k)


def _not_itself(a: dict, c: dict) -> Callable[[int, slice], np.ndarray]:
    return lambda k, part: c["row"][part] != a["row"][k]


def _other_label(a: dict, c: dict) -> Callable[[int, slice], np.ndarray]:
    return lambda k, part: c["label"][part] != a["label"][k]


def _whole(vector: Column) -> Column:
    """Entries as whole numbers; null if the vector takes no part."""
    good = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float(2**31)), F.lit(False)))
    x = F.transform(vector, lambda c: F.floor(F.lit(float(PARTS)) * c.cast("double")).cast("long"))
    fits = F.aggregate(x, F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")) < float(2**62)
    return F.when(vector.isNotNull() & good, F.when(fits & (F.size(vector) > 0), x))


def mine(
    vectors: DataFrame, key: str, label: str, vector: str, anchors: Column, *, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; keys and labels are whole numbers.

    anchors: a condition on the columns of ``vectors``. Negatives of a positive score between ``least`` and ``most``
    hundredths of it.
    """
    used = vectors.select(F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), _whole(F.col(vector)).alias("x"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    rows = materialise(used.where("label IS NOT NULL AND x IS NOT NULL").withColumns({"row": F.monotonically_increasing_id(), "width": F.size("x")}))
    one = F.array(F.struct(F.lit(-(2**63)).alias("low"), F.lit(2**63 - 1).alias("high")))
    asks = rows.where("anchor AND key IS NOT NULL")
    near = materialise(_best(_cells(asks.withColumn("windows", one), rows, ["label", "width"]), ["label", "width"], positives, _not_itself))
    low, high = (F.lit(least) * F.col("score") + 99).cast("decimal(38,0)"), (F.lit(most) * F.col("score")).cast("decimal(38,0)")
    bounds = F.struct("rank", F.floor(low / 100).cast("long").alias("low"), F.floor(high / 100).cast("long").alias("high"))
    listed = near.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(bounds)), lambda b: b.dropFields("rank")).alias("windows"))
    again = asks.drop("anchor").join(listed.withColumnRenamed("anchor", "row"), "row")
    found = _best(_cells(materialise(again), rows, ["width"]), ["width"], negatives, _other_label)
    first = near.select("anchor", (F.col("rank") - 1).alias("window"), F.col("key").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = asks.select(F.col("row").alias("anchor"), F.col("key").alias("anchor_id"))
    return found.join(first, ["anchor", "window"]).join(ids, "anchor").select("anchor_id", "positive_id", "rank", F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(vectors: DataFrame) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", "embedding", moved.alias("label")), "vec_id", "label", "embedding", F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH whole AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r AS other, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM whole a JOIN whole b ON a.r <> b.r AND len(a.x) = len(b.x)
  WHERE a.vec_id % 50 = 0
), near AS (
  SELECT anchor, anchor_id, other AS positive, other_id AS positive_id, score AS positive_score
  FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id, other) <= 5
)
SELECT n.anchor_id, n.positive_id, CAST(row_number() OVER (PARTITION BY n.anchor, n.positive ORDER BY s.score DESC, s.other_id, s.other) AS INT) AS rank, s.other_id AS negative_id, n.positive_score, s.score AS negative_score
FROM near n JOIN scored s ON s.anchor = n.anchor AND NOT s.same AND 50 * n.positive_score <= 100 * s.score AND 100 * s.score <= 95 * n.positive_score
QUALIFY row_number() OVER (PARTITION BY n.anchor, n.positive ORDER BY s.score DESC, s.other_id, s.other) <= 3
"""
