"""Near-duplicate vectors by cross-polytope hashing.

A vector is rotated (three rounds of random signs and a fast Hadamard transform) and hashed to the nearest
vertex of the cross-polytope: the coordinate of the largest size, with its sign. ``HASHES`` such hashes make a
bucket in each of ``TABLES`` tables. A vector is stored in its own bucket of each table and looks into that one
and into ``HASHES`` more, where one hash takes the runner-up coordinate (multiprobe). Vectors that meet in a
bucket are compared exactly, in double precision. At the threshold of 0.95 one table finds about two pairs in
five, all tables 98 in a hundred, and closer pairs more surely.

Equal vectors are one class from the start. Only buckets where different classes meet get the vectors
themselves; large buckets are cut into blocks of ``BLOCK`` stored by ``BLOCK`` looking rows. A block returns
counts and a spanning forest, a row a vector at most, never its pairs: a pair that meets in several buckets is
counted in the first table where it does, which the block tells from the hashes of both.

Defined cases: vectors that are null, empty or zero, or that hold null or non-finite components, link with
nothing; a row with a null id links and counts like any other, but names no component; vectors of different sizes are never compared; equal rows count as other
vectors; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riftline.llm.common import materialise
from riftline.llm.components import components

TABLES, HASHES, BLOCK, SEED, COSINE = 8, 3, 2000, 11, 0.95
#: Buckets with more pairs than MATRIX are multiplied as matrices; the pairs of others go together, PAIRS at a time.
MATRIX, PAIRS = 20_000, 50_000


@lru_cache(8)
def _signs(size: int, tables: int, hashes: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (tables, hashes, 3, size))


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, d = x.shape
    h = 1
    while h < d:
        pair = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


def codes(vectors: np.ndarray, tables: int = TABLES, hashes: int = HASHES, seed: int = SEED) -> np.ndarray:
    """[vector, table, 1 + hashes]: the own bucket, then the probed ones."""
    n, d = vectors.shape
    size = 1 << max(1, (d - 1).bit_length())
    x = np.zeros((n, size))
    x[:, :d] = vectors
    out = np.empty((n, tables, 1 + hashes), dtype=np.int64)
    rows = np.arange(n)
    for t, of_table in enumerate(_signs(size, tables, hashes, seed)):
        best, second = np.empty((hashes, n), dtype=np.int64), np.empty((hashes, n), dtype=np.int64)
        for k, signs in enumerate(of_table):
            y = x
            for s in signs:
                y = _hadamard(y * s)
            a = np.abs(y)
            for into in (best, second):
                at = a.argmax(axis=1)
                into[k] = 2 * at + (y[rows, at] < 0)
                a[rows, at] = -1.0
        weight = (2 * size) ** np.arange(hashes)
        own = weight @ best
        out[:, t, 0] = own
        for k in range(hashes):
            out[:, t, 1 + k] = own + weight[k] * (second[k] - best[k])
    return out


def _valid(v: Column) -> Column:
    """Finite, without nulls, and not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def buckets(classes: DataFrame) -> DataFrame:
    """bucket, node, looks: where each class is stored (looks false) and where it looks (true)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, vectors = batch.column(0).to_numpy(), batch.column(1)
            sizes = vectors.value_lengths().to_numpy()
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                for k in range(0, len(rows), 5000):
                    part = rows[k : k + 5000]
                    found = codes(_matrix(vectors.take(pa.array(part))))
                    name = (np.arange(TABLES) << 14 | int(d) & 0x3FFF)[None, :, None] << 44 | found
                    looks = np.broadcast_to(np.arange(HASHES + 2)[None, None, :] > 0, (*name.shape[:2], HASHES + 2))
                    both = np.concatenate([name[:, :, :1], name], axis=2)
                    owner = np.broadcast_to(node[part][:, None, None], both.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(both.ravel()), pa.array(owner.ravel()), pa.array(looks.ravel())], names=["bucket", "node", "looks"])

    return classes.select("node", "embedding").mapInArrow(run, "bucket long, node long, looks boolean")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the least place that the pairs connect it with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _close(vectors: np.ndarray, looks: np.ndarray, bounds: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(looking row, stored row) of the pairs in the same bucket that are close; bounds: where buckets begin, and the end."""
    norm = np.sqrt((vectors * vectors).sum(axis=1))
    group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((looks, group))  # in each bucket the stored rows come first
    stored = np.bincount(group[~looks], minlength=len(bounds) - 1)
    lookers = np.diff(bounds) - stored
    large = stored * lookers > MATRIX
    left, right = [], []
    for g in np.flatnonzero(large):
        rows = order[bounds[g] : bounds[g + 1]]
        s, q = rows[: stored[g]], rows[stored[g] :]
        for k in range(0, len(q), 500):
            at = q[k : k + 500]
            i, j = np.nonzero((vectors[at] @ vectors[s].T) / np.outer(norm[at], norm[s]) >= cosine)
            left.append(at[i])
            right.append(s[j])
    q = order[looks[order] & ~large[group[order]]]
    times = stored[group[q]]
    cut = [*np.searchsorted(np.cumsum(times), np.arange(0, int(times.sum()), PAIRS)), len(q)]  # the end alone if no small bucket has pairs
    for lo, hi in pairwise(cut):
        of, n = q[lo:hi], times[lo:hi]
        a = np.repeat(of, n)
        b = order[np.repeat(bounds[group[of]], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
        near = np.einsum("ij,ij->i", vectors[a], vectors[b]) / (norm[a] * norm[b]) >= cosine
        left.append(a[near])
        right.append(b[near])
    return np.concatenate([np.zeros(0, dtype=np.int64), *left]), np.concatenate([np.zeros(0, dtype=np.int64), *right])


def compare(bucket: np.ndarray, place: np.ndarray, node: np.ndarray, looks: np.ndarray, count: np.ndarray, vectors: np.ndarray, cosine: float) -> pa.RecordBatch:
    """node, links (rows of classes linked for the first time here), root (a linked node): of whole buckets, in order.

    place: the block of a large bucket.
    """
    starts = np.flatnonzero((np.diff(bucket, prepend=bucket[0] - 1) != 0) | (np.diff(place, prepend=place[0] - 1) != 0))
    a, b = _close(vectors, looks, np.append(starts, len(bucket)), cosine)
    other = node[a] != node[b]
    a, b = a[other], b[other]
    links, root = np.zeros(len(bucket), dtype=np.int64), np.arange(len(bucket))
    if len(a):
        used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        code, x_of, y_of = codes(vectors[used]), at[: len(a)], at[len(a) :]
        table = bucket[a] >> 58
        for k in range(0, len(a), 100_000):
            x, y, t = x_of[k : k + 100_000], y_of[k : k + 100_000], table[k : k + 100_000]
            sees = (code[x] == code[y][:, :, :1]).any(axis=2)  # x looks where y is stored
            seen = (code[y] == code[x][:, :, :1]).any(axis=2)
            first = (sees | seen).argmax(axis=1) == t
            left, right = a[k : k + 100_000], b[k : k + 100_000]
            mine = first & ((node[left] < node[right]) | ~seen[np.arange(len(t)), t])  # of both directions the smaller node looks
            np.add.at(links, left[mine], count[right[mine]])
            np.add.at(links, right[mine], count[left[mine]])
        root = _forest(len(bucket), a, b)
    keep = (links > 0) | (node[root] != node)
    return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(links[keep]), pa.array(node[root][keep])], names=["node", "links", "root"])


def _compare_sorted(cosine: float):
    """Over rows sorted by bucket and block: as many whole buckets at a time as a batch holds."""

    def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
        vectors = table.column("embedding").combine_chunks()
        sizes = vectors.value_lengths().to_numpy()
        column = lambda name, rows: table.column(name).to_numpy()[rows]
        for d in np.unique(sizes):
            rows = np.flatnonzero(sizes == d)
            place = column("i", rows).astype(np.int64) << 32 | column("j", rows)
            yield compare(column("bucket", rows), place, column("node", rows), column("looks", rows), column("n", rows), _matrix(vectors.take(pa.array(rows))), cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([carry, table]).combine_chunks() if carry is not None else table
            if not table.num_rows:
                continue
            keys = [table.column(c).to_numpy() for c in ("bucket", "i", "j")]
            open_ = int(np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys]))[-1]) + 1 if any((k != k[-1]).any() for k in keys) else 0
            if open_:
                yield from whole(table.slice(0, open_))
            carry = table.slice(open_)
        if carry is not None and carry.num_rows:
            yield from whole(carry)

    return run


def link(vectors: DataFrame, key: str, vector: str, *, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """key, n_links, component (the smallest key reachable): one row for each row of ``vectors``."""
    usable = _valid(F.col(vector))
    rows = vectors.select(F.col(key).alias("key"), F.when(usable, F.xxhash64(vector)).alias("h1"), F.when(usable, F.hash(F.lit(7), F.col(vector))).alias("h2"), F.when(usable, F.col(vector)).alias("embedding"))
    narrow = materialise(rows.select("key", "h1", "h2"))
    classes = materialise(rows.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding")).withColumn("node", F.monotonically_increasing_id()))
    placed = materialise(buckets(classes))
    sizes = placed.groupBy("bucket").agg(F.count_if("looks").alias("lookers"), F.count_if(~F.col("looks")).alias("stored")).where("stored > 0 AND lookers > 1")
    chunks = lambda c: F.ceil(F.col(c) / block).cast("int")
    sized = sizes.select("bucket", chunks("lookers").alias("across"), chunks("stored").alias("down"))
    own = lambda c: F.pmod(F.xxhash64("node", "bucket"), F.col(c)).cast("int")
    dealt = (
        placed.join(materialise(sized), "bucket")
        .withColumn("i", F.when(F.col("looks"), F.array(own("across"))).otherwise(F.sequence(F.lit(0), F.col("across") - 1)))
        .withColumn("j", F.when(~F.col("looks"), F.array(own("down"))).otherwise(F.sequence(F.lit(0), F.col("down") - 1)))
        .select("bucket", "node", "looks", F.explode("i").alias("i"), "j").select("bucket", "node", "looks", "i", F.explode("j").alias("j"))
    )
    with_vectors = dealt.join(classes.select("node", "n", "embedding"), "node")
    dealt_out = with_vectors.select("bucket", "i", "j", "node", "looks", "n", "embedding").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = materialise(dealt_out.mapInArrow(_compare_sorted(cosine), "node long, links long, root long"))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = materialise(components(found.where("root != node"), "node", "root").withColumnsRenamed({"component": "root"}))
    rooted = materialise(classes.select("node", "h1", "h2", "least", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    names = rooted.groupBy("root").agg(F.min("least").alias("component"))
    known = materialise(rooted.join(names, "root").join(linked, "node", "left").select("h1", "h2", "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    return narrow.join(known, ["h1", "h2"], "left").select("key", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "key").alias("component"))


def query(vectors: DataFrame) -> DataFrame:
    found = link(vectors, "vec_id", "embedding")
    return found.select(F.col("key").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("key").eqNullSafe(F.col("component")).alias("kept"))
