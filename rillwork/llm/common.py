"""Helpers of the operators: words, stored intermediate tables, hashed shingles, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.session import ensure_checkpoint_dir

#: What separates words: space and the ASCII controls from tab to carriage return.
GAP = "[\\x20\\x09-\\x0D]+"
#: Words in a shingle and the least similarity of near duplicates, unless a contract says otherwise.
WIDTH, NEAR = 5, 0.75


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def row_key() -> Column:
    """64 bits of id and text, never null: rows that repeat both share it, rows with a null id are told apart by their texts."""
    return F.xxhash64("doc_id", "text")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` with underscores behind them until no column of ``df``, and no earlier one of them, is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def own(df: DataFrame, *but: str) -> list[Column]:
    """The columns of ``df`` but those named, whatever characters their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c not in but]


def stow(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    Smaller than ``checkpoint()`` for wide intermediate tables, and as safe: a lost executor costs
    a re-read.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# ------------------------------------------------------------------ hashed shingles of a batch

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_POS = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_IS_GAP = np.zeros(256, bool)
_IS_GAP[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that are hashed at once, which bounds a task's memory; a longer text is hashed alone.
SLICE = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_KEPT: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if n > len(_KEPT.get(base, ())):
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        out = np.multiply.accumulate(out)
        if n > 2 * SLICE:
            return out
        _KEPT[base] = out
    return _KEPT[base][:n]


def word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word; text ``k`` is ``data[cuts[k]:cuts[k + 1]]``, A-Z lower-cased."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = _LOWER[data]
    solid = ~_IS_GAP[data]
    edge = np.zeros(n + 1, bool)
    edge[cuts] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, n), out=sums[1:])
    h = mix((sums[stop] - sums[start]) * _powers(_BASE_INV, n)[start])
    return h, np.searchsorted(cuts, start, side="right") - 1


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct 64-bit shingle hashes of every text of a column.

    A text with fewer than ``width`` words has its whole word sequence as one shingle; one without
    words, or null, has none.
    """
    column = pc.fill_null(column, "").cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    whole = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SLICE, side="right")) - 1)
        j = min(j, len(column))
        h, doc = word_hashes(whole[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        count = np.bincount(doc, minlength=j - i)[: j - i]
        begin = np.concatenate([[0], np.cumsum(count)])
        m = max(0, len(h) - width + 1)
        grams = np.zeros(m, np.uint64)
        for k in range(width):
            grams += h[k : k + m] * _POS[k]
        grams = mix(grams)
        for k in range(j - i):
            c, b = int(count[k]), int(begin[k])
            if c >= width:
                yield i + k, np.unique(grams[b : b + c - width + 1])
            elif c:
                yield i + k, mix(np.array([np.sum(h[b : b + c] * _POS[8 : 8 + c]) + _U(c)], np.uint64))
            else:
                yield i + k, np.zeros(0, np.uint64)
        i = j


def set_key(tokens: np.ndarray) -> np.uint64:
    """One value for a set, the same in any order; 0 only for the empty set."""
    if not len(tokens):
        return _U(0)
    return mix(np.add.reduce(mix(tokens ^ _U(0x5851F42D4C957F2D)), keepdims=True))[0] | _U(1)


# ------------------------------------------------------------------ connected components


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the undirected ``edges`` (``a``, ``b``); equal root, same component.

    Every round points each node at its smallest neighbour, follows the pointers twice and contracts
    the edges; finished components leave the edges. Nothing but one emptiness flag reaches the driver.
    Self-loops, nulls and repeated edges are ignored; without edges the result is empty. Rounds are kept as
    stored tables: a checkpointed plan would carry the inferred constraints of all rounds before it.
    """
    live = stow(edges.select("a", "b").where("a <> b").distinct(), "edges")
    steps = []
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        up = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("p"))
        up = stow(up, "pointers")
        for _ in range(2):
            over = up.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            up = up.join(over, "p").select("u", F.col("pp").alias("p"))
        up = stow(up, "pointers")
        steps.append(up)
        pa_, pb = up.toDF("a", "pa"), up.toDF("b", "pb")
        live = live.join(pa_, "a").join(pb, "b").where("pa <> pb")
        live = stow(live.select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "edges")
    if not steps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[0].toDF("node", "root")
    for up in steps[1:]:
        out = out.join(up.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out
