"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X are never gathered and their product X'X is never formed. Step ``j`` sends one vector
``v_j`` to the tasks and gets back, summed over all rows, what the alternating products need:

* ``p = X v_j - b u_(j-1)`` and its products with all earlier ``u``, so that ``u_j`` is ``p``
  orthogonalised again in full, of length 1, with ``a = |p|``;
* ``X' u_j``, which, orthogonalised in full against all ``v`` (twice, on the driver: vectors of one row's
  length), gives the next ``v`` and ``b``.

The long vectors ``u`` are not stored: a row's entries of them follow from the row and the numbers that
the driver keeps, so a task makes them anew in each pass, and a lost executor costs its own blocks only.
The bidiagonal matrix B of the ``a`` and ``b`` is small; its singular values over the root of ``n`` are the
deviations along the components, its right singular vectors, turned back by the ``v``, the components.

A run that ends early (``b = 0``, or the leading values have converged) may have missed the further
directions of a repeated value. So a new ``v``, orthogonal to all, is then started, and the components count
as found only when such a fresh run has converged below them or all directions are spent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import stow
from rillwork.llm.vectors import whole_vectors

#: Components asked for, and entries of the vectors in a stored block.
TOP, BLOCK = 4, 1 << 18
#: Share of the greatest value that an error may have to count as none.
SMALL = 1e-14
#: Components whose variance is below this share of the greatest are no direction of the data.
RANK = 1e-13
_EXACT = 1 << 62


@dataclass
class Bidiagonal:
    """What the steps so far have given: directions, diagonal, and how ``u`` follows from a row."""

    mean: np.ndarray
    v: list[np.ndarray] = field(default_factory=list)
    a: list[float] = field(default_factory=list)
    b: list[float] = field(default_factory=list)  # b[j] leads to v[j]; 0 where a run starts
    h: list[np.ndarray] = field(default_factory=list)  # products of p_j with u_0 .. u_(j-1)
    xu: list[np.ndarray] = field(default_factory=list)  # X' u_j

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Entries of all ``u`` so far for a block of rows."""
        xv = (x - self.mean) @ np.array(self.v).T
        u = np.zeros((len(x), len(self.a)))
        for j, a in enumerate(self.a):
            if a:
                p = xv[:, j] - (self.b[j] * u[:, j - 1] if j else 0)
                u[:, j] = (p - u[:, :j] @ self.h[j]) / a
        return u

    def matrix(self) -> np.ndarray:
        return np.diag(self.a) + np.diag(self.b[1:], 1)

    def components(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Singular values, components and their last left entries (how far they are from converged)."""
        left, s, right = np.linalg.svd(self.matrix())
        return s, right @ np.array(self.v), np.abs(left[-1])


def _blocks(dim: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of a batch as blocks of bytes."""
    most = max(1, BLOCK // max(1, dim))
    for batch in batches:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, dim)
        for at in range(0, len(x), most):
            yield pa.record_batch([pa.array([x[at : at + most].tobytes()], pa.binary())], names=["block"])


def _read(column: pa.Array, dim: int) -> Iterator[np.ndarray]:
    for value in column:
        yield np.frombuffer(value.as_buffer(), np.int64).reshape(-1, dim)


def _summed(blocks: DataFrame, dim: int, fn, size: int) -> np.ndarray:
    """The sum over all blocks of ``fn(block)``, an array of ``size`` doubles; a task gives one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x in _read(batch.column(0), dim):
                total += fn(x)
        yield pa.record_batch([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["i", "v"])

    parts = blocks.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(size)
    for row in parts.collect():
        out[row["i"]] = row["v"]
    return out


def _step(state: Bidiagonal, x: np.ndarray) -> np.ndarray:
    """Sums of a block: products of ``p`` with every ``u``, ``|p| ** 2`` and ``X' p``."""
    u = state.rows(x)
    c = x - state.mean
    j = len(state.a)
    p = c @ state.v[j] - (state.b[j] * u[:, j - 1] if j else 0)
    return np.concatenate([u.T @ p, [p @ p], c.T @ p])


def _orthogonal(w: np.ndarray, v: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for q in v:
            w = w - (q @ w) * q
    return w


def bidiagonalise(blocks: DataFrame, dim: int, mean: np.ndarray, top: int = TOP) -> Bidiagonal:
    """Steps until the ``top`` components have converged and a fresh run adds none, or none are left."""
    rng = np.random.default_rng(7)
    state = Bidiagonal(mean)
    v, b = rng.standard_normal(dim), 0.0
    v /= np.linalg.norm(v)
    start, settled, scale = 0, None, 0.0
    while len(state.v) < dim:
        state.v.append(v)
        state.b.append(b)
        j = len(state.a)
        got = _summed(blocks, dim, partial(_step, state), j + 1 + dim)
        h, square, xp = got[:j], got[j], got[j + 1 :]
        a = float(np.sqrt(max(0.0, square - float(h @ h))))
        scale = max(scale, a, b)
        if a <= SMALL * scale or not scale:
            a, xu = 0.0, np.zeros(dim)
        else:
            xu = (xp - sum((c * w for c, w in zip(h, state.xu)), np.zeros(dim))) / a
        state.a.append(a)
        state.h.append(h)
        state.xu.append(xu)
        w = _orthogonal(xu - a * v, state.v) if a else np.zeros(dim)
        b = float(np.linalg.norm(w))
        s, _, last = state.components()
        # what a component's value can still change by; a run has to hold more steps than components
        waits = j + 1 - start <= top or (b * last[:top]).max() > SMALL * s[0]
        if b > SMALL * scale and waits:
            v = w / b
            continue
        leading = np.pad(s, (0, top))[:top]
        if settled is not None and np.allclose(settled, leading, rtol=1e-12, atol=SMALL * s[0]):
            break
        settled, start, b = leading, j + 1, 0.0
        w = _orthogonal(rng.standard_normal(dim), state.v)
        if np.linalg.norm(w) < 1e-9:
            break
        v = _orthogonal(w / np.linalg.norm(w), state.v)
        v /= np.linalg.norm(v)
    return state


def whiten(table: DataFrame, top: int = TOP) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable row of ``table``.

    A row has one line for each of up to ``top`` components, fewer where the data have fewer directions
    (none for one vector or equal ones). The components are fitted on every distinct vector once, as whole
    numbers (``vectors.scaled``); repeated rows and rows with a null id are whitened like all others.
    ``deviation`` is exact, null where it is beyond a long. Vectors of one length make one space: each length
    that occurs is fitted for itself. Rows whose vector is null or holds a null or an entry that is not
    finite are left out, and so are vectors without entries. An empty table gives an empty result. Other
    columns of ``table``, whatever their names, are ignored. The sign of a component is that of its entry of
    greatest size, made positive.
    """
    source = whole_vectors(table)
    lengths = [r[0] for r in source.select(F.size("x").alias("d")).where("d > 0").distinct().orderBy("d").collect()]
    parts = [_whiten_length(source.where(F.size("x") == d), d, top) for d in lengths]
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return table.sparkSession.createDataFrame([], SCHEMA) if out is None else out


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whiten_length(source: DataFrame, dim: int, top: int) -> DataFrame:
    distinct = source.select("x").distinct()
    blocks = stow(distinct.mapInArrow(partial(_blocks, dim), "block binary"), "blocks")
    sums = blocks.mapInArrow(partial(_whole_sums, dim), "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v"))
    whole = {r["i"]: int(r["v"]) for r in sums.collect()}
    n, total = whole[dim], [whole[i] for i in range(dim)]
    mean = np.array([s / n for s in total])
    spread = _summed(blocks, dim, lambda x: np.array([np.square(x - mean).sum()]), 1)[0] / n
    if not spread:
        return source.sparkSession.createDataFrame([], SCHEMA)
    state = bidiagonalise(blocks, dim, mean, top)
    s, found, _ = state.components()
    e = s**2 / n
    m = min(top, int((e > RANK * e[0]).sum()))
    found, e = found[:m], e[:m]
    found *= np.where(found[np.arange(m), np.abs(found).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    turn = (found / np.sqrt(e)[:, None]).T
    moments = _summed(blocks, dim, partial(_moments, mean, turn), m + m * m) / n
    cov = moments[m:].reshape(m, m) - np.outer(moments[:m], moments[:m])
    error = float(np.abs(cov - np.eye(m)).max())
    explained = e / spread
    return source.mapInArrow(partial(_project, dim, n, total, mean, turn, explained, error), SCHEMA)


def _whole_sums(dim: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = [0] * dim, 0  # in two halves of 32 bits, so that no sum leaves a long
    for batch in batches:
        for x in _read(batch.column(0), dim):
            low, high = x & 0xFFFFFFFF, x >> 32
            total = [t + int(a) + (int(b) << 32) for t, a, b in zip(total, low.sum(axis=0), high.sum(axis=0))]
            n += len(x)
    yield pa.record_batch([pa.array(range(dim + 1), pa.int32()), pa.array([*total, n], pa.decimal128(38, 0))], names=["i", "v"])


def _moments(mean: np.ndarray, turn: np.ndarray, x: np.ndarray) -> np.ndarray:
    w = (x - mean) @ turn
    return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])


def _deviation(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sum over the entries of ``(n x - S) ** 2``, exact."""
    reach = n * int(np.abs(x).max(initial=0)) + max(map(abs, total))
    if reach * reach * x.shape[1] < _EXACT:
        away = n * x - np.array(total, np.int64)
        return (away * away).sum(axis=1).tolist()
    whole = [sum((n * c - s) ** 2 for c, s in zip(row, total)) for row in x.tolist()]
    return [w if w < 1 << 63 else None for w in whole]


def _project(dim: int, n: int, total: list[int], mean: np.ndarray, turn: np.ndarray, explained: np.ndarray, error: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m = len(explained)
    for batch in batches:
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, dim)
        rows = np.repeat(np.arange(len(x)), m)
        columns = [
            batch.column(0).take(pa.array(rows)),
            pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))),
            pa.array(np.full(len(rows), n, np.int64)),
            pa.array(_deviation(x, n, total), pa.int64()).take(pa.array(rows)),
            pa.array(((x - mean) @ turn).ravel()),
            pa.array(np.tile(explained, len(x))),
            pa.array(np.full(len(rows), error)),
        ]
        yield pa.record_batch(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
