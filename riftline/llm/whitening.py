"""Embedding whitening by QDWH spectral divide and conquer.

Vectors become whole numbers (256 parts of a unit). Each distinct vector counts once: sums and the centred covariance
are added up in tasks, a matrix a task, and only the covariance (as many rows as a vector has entries) comes to the
driver. There its polar factor U is found by QDWH, QR-based Halley steps with dynamic weights (Nakatsukasa and Higham,
2013): for a shift s inside the spectrum, (U(V - s I) + I) / 2 projects on the subspace of the eigenvalues above s. An
orthogonal basis of that subspace and of its complement splits the matrix in two, until blocks are diagonal. Subspaces
that hold none of the wanted components are not split further. The components, a few numbers for each entry of a
vector, go to the tasks with the function that whitens.

Defined cases: vectors that are null, hold null or non-finite entries, or entries of 2^54 or more (which have no long)
are dropped. All vectors fitted have one number of entries: the one that most distinct vectors have, the larger of
equals; vectors of another are dropped. Rows that repeat, in id or vector, each get their rows. Components whose
eigenvalue is zero to rounding have no whitening and no rows, so that a single distinct vector, empty vectors and an
empty table give an empty result; fewer entries than ``top`` give fewer components. A deviation beyond a long is null.
A null id stays. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riftline.llm.common import empty_like, materialise

PARTS, TOP = 256, 4
EPS = float(np.finfo(np.float64).eps)


def polar(a: np.ndarray, *, steps: int = 30) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix; eigenvalues within rounding of zero may stay between -1 and 1."""
    size = np.linalg.norm(a)
    if not size:
        return np.zeros_like(a)
    one, x, low = np.eye(len(a)), a / size, EPS
    for _ in range(steps):
        d = np.cbrt(4 * (1 - low * low) / low**4)
        wa = np.sqrt(1 + d) + np.sqrt(8 - 4 * d + 8 * (2 - low * low) / (low * low * np.sqrt(1 + d))) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, one]))[0]
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[: len(a)] @ q[len(a) :].T)
        new = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * low * low) / (1 + wc * low * low))
        moved, x = np.linalg.norm(new - x), new
        if low > 0.99 and moved < 1e-10 * np.sqrt(len(a)):  # the first steps hardly move eigenvalues of equal size
            break
    return x


def _split(a: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two invariant subspaces, the one with the larger eigenvalues first; None if none is found."""
    d = np.sort(np.diag(a))
    spread = max(d[-1] - d[0], np.abs(a - np.diag(np.diag(a))).max())
    mixed = np.random.default_rng(5).standard_normal(a.shape)
    for shift in (np.median(d), d.mean(), *(d.mean() + spread * f for f in (0.05, -0.05, 0.21, -0.21, 0.47, -0.47))):
        p = (polar(a - shift * np.eye(len(a))) + np.eye(len(a))) / 2
        k = round(np.trace(p))
        if not 0 < k < len(a) or np.linalg.norm(p @ p - p) > 1e-9:
            continue
        q = np.linalg.qr(p @ mixed)[0]
        for _ in range(2):
            q = np.linalg.qr(np.hstack([p @ q[:, :k], q[:, k:] - p @ q[:, k:]]))[0]
        upper, lower = q[:, :k], q[:, k:]
        if np.linalg.norm(lower.T @ a @ upper) <= 1e3 * EPS * size:
            return upper, lower
    return None


def spectral(a: np.ndarray, top: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` largest eigenvalues (all if None), falling, and their unit eigenvectors as columns."""
    a = (a + a.T) / 2
    size, top = float(np.linalg.norm(a)), len(a) if top is None else min(top, len(a))
    values, vectors, open_ = [], [], [(np.eye(len(a)), top)] if top else []
    while open_:
        basis, wanted = open_.pop()
        block = basis.T @ a @ basis
        block = (block + block.T) / 2
        off = np.linalg.norm(block - np.diag(np.diag(block)))
        halves = _split(block, size) if len(block) > 1 and off > 2 * EPS * size else None
        if halves is None:  # diagonal up to rounding, or eigenvalues that rounding does not tell apart
            values.extend(np.diag(block))
            vectors.extend(basis.T)
            continue
        upper, lower = (basis @ h for h in halves)
        open_.append((upper, wanted))
        if wanted > upper.shape[1]:
            open_.append((lower, wanted - upper.shape[1]))
    order = np.argsort(-np.array(values), kind="stable")[:top]
    found = np.array(vectors).reshape(-1, len(a))[order].T
    return np.array(values)[order], found * np.where(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])] < 0, -1.0, 1.0) if len(order) else found


def _whole(vector: Column) -> Column:
    """Entries as whole numbers; null if the vector takes no part."""
    good = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float(2**54)), F.lit(False)))
    return F.when(vector.isNotNull() & good, F.transform(vector, lambda c: F.floor(F.lit(float(PARTS)) * c.cast("double")).cast("long")))


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, dtype=np.int64), np.zeros(width, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                n += len(x)
                high += (x >> 31).sum(axis=0)
                low += (x & 0x7FFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(np.full(width, n)), pa.array(high), pa.array(low)], names=["k", "n", "high", "low"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    parts = fit.select("x").mapInArrow(run, "k long, n long, high long, low long")
    rows = sorted(parts.groupBy("k").agg(F.sum("n").alias("n"), wide("high"), wide("low")).collect(), key=lambda r: r["k"])
    return (rows[0]["n"], [(int(r["high"]) << 31) + int(r["low"]) for r in rows]) if rows else (0, [0] * width)


def _centred(n: int, sums: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """x - S / n as doubles; the whole part of S / n is taken off in whole numbers."""
    near = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([float(Fraction(s - n * (s // n), n)) for s in sums])
    return lambda x: (x - near).astype(np.float64) - rest


def _covariance(fit: DataFrame, n: int, width: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Covariance (divisor n) of ``of`` over the fit list; ``of`` gives centred rows of ``width`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros((width, width)), False
        for batch in batches:
            if batch.num_rows:
                y, any_ = of(_matrix(batch.column(0))), True
                total += y.T @ y
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(list(total), type=pa.list_(pa.float64()))], names=["i", "row"])

    parts = fit.select("x").mapInArrow(run, "i long, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    out = np.zeros((width, width))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"] / n
    return (out + out.T) / 2


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over entries of (n x - S)^2, exact; null beyond a long."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    exact = np.int64 if most * most * max(1, x.shape[1]) < 2**63 else object
    d = x.astype(exact) * n - np.array(sums, dtype=exact)
    return pa.array([v if v < 2**63 else None for v in (d * d).sum(axis=1).tolist()], type=pa.int64())


def whiten(vectors: DataFrame, key: str, vector: str, *, top: int = TOP) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    spark = vectors.sparkSession
    schema = T.StructType([T.StructField("key", vectors.schema[key].dataType)])
    for name, kind in (("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())):
        schema.add(name, kind)
    rows = materialise(vectors.select(F.col(key).alias("key"), _whole(F.col(vector)).alias("x")).where("x IS NOT NULL"))
    fit = materialise(rows.select("x").distinct())
    sizes = fit.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "width"))["width"].alias("width")).first()
    width = sizes["width"] or 0
    if not width:
        return empty_like(spark, schema)
    fit, rows = fit.where(F.size("x") == width), rows.where(F.size("x") == width)
    n, sums = _sums(fit, width)
    centred = _centred(n, sums)
    v = _covariance(fit, n, width, centred)
    values, axes = spectral(v, top)
    usable = values > width * EPS * np.trace(v)
    values, axes = values[usable], axes[:, usable]
    if not len(values):
        return empty_like(spark, schema)
    turn = axes / np.sqrt(values)
    error = float(np.abs(_covariance(fit, n, len(values), lambda x: centred(x) @ turn) - np.eye(len(values))).max())
    explained, k = values / np.trace(v), len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if m:
                x = _matrix(batch.column(1))
                each = pa.array(np.repeat(np.arange(m), k))
                columns = [np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, n), _deviation(x, n, sums).take(each), (centred(x) @ turn).ravel(), np.tile(explained, m), np.full(m * k, error)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(each), *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns)], names=schema.names)

    return rows.select("key", "x").mapInArrow(run, schema)


def query(vectors: DataFrame) -> DataFrame:
    return whiten(vectors, "vec_id", "embedding").withColumnRenamed("key", "vec_id")
