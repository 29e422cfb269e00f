"""Road distances between many sources and every node, by nested pieces of the map.

A piece keeps only its gates, the nodes with a road out of it, and the distances between them inside the piece. Pieces
are joined ``FAN`` at a time until one is left; on the way back down each piece learns how far its gates are from every
source, and the smallest pieces measure their nodes. Rounds grow with the logarithm of the pieces, whatever the length
of the roads. A task holds the gates of ``FAN`` pieces, or one smallest piece, against at most ``CHUNK`` sources.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.session import cut

#: Pieces joined at a time, and sources that one task looks at.
FAN, CHUNK = 8, 1024
#: No way; the sum of two fits an int32.
FAR = np.int32(1 << 29)

_PIECE = "piece long, gates array<long>, depth array<int>, dist binary, src array<long>, own binary"
_SEEN = "piece long, chunk long, gates array<long>, x binary"


def _ints(raw: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(raw, np.int32).reshape(shape)


def _walk(n: int, src: np.ndarray, dst: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hops from each of ``starts`` to each of ``n`` nodes along the given roads, as nodes x starts."""
    out = np.full((n, len(starts)), FAR, np.int32)
    front = np.zeros((n, len(starts)), bool)
    front[starts, np.arange(len(starts))] = True
    out[front] = 0
    order = np.argsort(dst, kind="stable")
    src, into = src[order], dst[order]
    ends, cuts = np.unique(into, return_index=True)
    level = 0
    while len(src) and front.any():
        level += 1
        nxt = np.zeros_like(front)
        nxt[ends] = np.logical_or.reduceat(front[src], cuts, axis=0)
        nxt &= out == FAR
        out[nxt] = level
        front = nxt
    return out


def _leaf(rows: pd.DataFrame):
    """Nodes, gates with their depth, sources, and hops from gates and sources inside one smallest piece."""
    kind, a, b = rows["kind"].to_numpy(), rows["a"].to_numpy(), rows["b"].to_numpy()
    road, gate, spot = kind == 0, kind == 1, kind == 2
    nodes = np.unique(np.concatenate([a, b[road]]))
    gates, at = np.unique(a[gate], return_index=True)
    depth, src = b[gate][at].astype(np.int32), np.unique(a[spot])
    hops = _walk(len(nodes), np.searchsorted(nodes, a[road]), np.searchsorted(nodes, b[road]), np.searchsorted(nodes, np.concatenate([gates, src])))
    return nodes, gates, depth, src, hops[:, : len(gates)], hops[:, len(gates) :]


def _settle(y: np.ndarray, parts: list, left: np.ndarray, right: np.ndarray) -> None:
    """Lower ``y`` (gates x sources) along ways inside the parts and the roads ``left`` -> ``right`` between them."""
    dirty = np.ones(len(y), bool)
    while dirty.any():
        for lo, hi, dist in parts:
            for g in np.flatnonzero(dirty[lo:hi]):
                np.minimum(y[lo:hi], dist[g][:, None] + y[lo + g][None, :], out=y[lo:hi])
        dirty[:] = False
        for i, j in zip(left.tolist(), right.tolist()):
            new = y[i] + 1
            if (new < y[j]).any():
                np.minimum(y[j], new, out=y[j])
                dirty[j] = True


def _open(rows: pd.DataFrame):
    """The parts of a piece: their gates, distances, sources and the roads between them."""
    inner = rows[rows["piece"] >= 0].sort_values("piece")
    between = rows[rows["piece"] < 0]
    ids, gates, depth, parts, lo = [], [], [], [], 0
    for r in inner.itertuples():
        n = len(r.gates)
        ids.append(r.piece)
        gates.append(np.asarray(r.gates, np.int64))
        depth.append(np.asarray(r.depth, np.int32))
        parts.append((lo, lo + n, _ints(r.dist, n, n)))
        lo += n
    every = np.concatenate(gates) if gates else np.zeros(0, np.int64)
    order = np.argsort(every)
    place = lambda v: order[np.searchsorted(every[order], v)]
    pick = lambda c: np.concatenate([np.asarray(v, np.int64) for v in between[c]]) if len(between) else np.zeros(0, np.int64)
    return inner, ids, every, np.concatenate(depth) if depth else np.zeros(0, np.int32), parts, place, place(pick("gates")), place(pick("src"))


def _join_up(level: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        inner, _, every, depth, parts, _, left, right = _open(rows)
        out = np.flatnonzero(depth > level)
        src = np.concatenate([np.asarray(r.src, np.int64) for r in inner.itertuples()])
        y = np.full((len(every), len(out) + len(src)), FAR, np.int32)
        y[out, np.arange(len(out))] = 0
        k = len(out)
        for (lo, hi, _), r in zip(parts, inner.itertuples()):
            y[lo:hi, k : k + len(r.src)] = _ints(r.own, hi - lo, len(r.src))
            k += len(r.src)
        _settle(y, parts, left, right)
        # rows are the gate a way starts from
        dist, own = np.ascontiguousarray(y[out, : len(out)].T), np.ascontiguousarray(y[out, len(out) :])
        return pd.DataFrame([(int(rows["parent"].iloc[0]), every[out].tolist(), depth[out].tolist(), dist.tobytes(), src.tolist(), own.tobytes())],
                            columns=["piece", "gates", "depth", "dist", "src", "own"])

    return run


def _hand_down(rows: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
    names = ["piece", "chunk", "gates", "x"]
    if not len(rows) or not len(seen):
        return pd.DataFrame([], columns=names)
    inner, ids, every, _, parts, place, left, right = _open(rows)
    one = seen.iloc[0]
    src = np.asarray(one["src"], np.int64)  # in order
    y = np.full((len(every), len(src)), FAR, np.int32)
    if len(one["gates"]):  # distances as they are on the whole map
        y[place(np.asarray(one["gates"], np.int64))] = _ints(one["x"], len(one["gates"]), len(src))
    for (lo, hi, _), r in zip(parts, inner.itertuples()):
        mine = np.asarray(r.src, np.int64)
        at = np.minimum(np.searchsorted(src, mine), len(src) - 1)
        ok = src[at] == mine
        own = _ints(r.own, hi - lo, len(mine))[:, ok]
        y[lo:hi, at[ok]] = np.minimum(y[lo:hi, at[ok]], own)
    _settle(y, parts, left, right)
    told = [(int(p), int(one["chunk"]), every[lo:hi].tolist(), y[lo:hi].tobytes()) for p, (lo, hi, _) in zip(ids, parts)]
    return pd.DataFrame(told, columns=names)


def fold_distances(
    sources: DataFrame, edges: DataFrame, piece: Callable[[Column], Column], fold: Callable, schema: str, fan: int = FAN, chunk: int = CHUNK,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """What ``fold(nodes, sources, weights, hops)`` returns for every smallest piece and set of sources.

    ``sources(node, weight)``, distinct; ``edges(src, dst)`` as ways from ``src``; ``piece`` gives the number of a node's
    smallest piece, from 0; few roads should join pieces. ``hops`` is nodes x sources, ``FAR`` without a way. With
    ``pairs(source, node)``, only pieces and sets of sources with such a pair are measured, sets are made of sources that
    lie together, and ``fold`` also gets the row and column of each pair in ``hops``.
    """

    def at(c: str) -> Column:
        return piece(F.col(c)).cast("long")

    e = cut(edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), at("src").alias("_p"), at("dst").alias("_q")).distinct())
    spots = cut(sources.select(F.col("node").cast("long").alias("node"), F.col("weight").cast("long").alias("weight"), at("node").alias("_p")))
    span = e.agg(F.max(F.greatest("_p", "_q"))).first()[0] or 0
    span = max(span, spots.agg(F.max("_p")).first()[0] or 0)
    if pairs is not None:
        pairs = cut(pairs.select(F.col("source").cast("long").alias("b"), F.col("node").cast("long").alias("a"), at("node").alias("_p")).distinct())
        span = max(span, pairs.agg(F.max("_p")).first()[0] or 0)
    levels = 0
    while fan**levels <= span:
        levels += 1
    # a road ends inside the first level at which both its ends lie in one piece
    apart = F.lit(0)
    for k in range(levels):
        apart = apart + (F.floor(F.col("_p") / fan**k) != F.floor(F.col("_q") / fan**k)).cast("int")
    cross = cut(e.filter("_p <> _q").withColumn("depth", apart))
    gates = cross.select("_p", F.col("src").alias("a"), "depth").union(cross.select("_q", F.col("dst"), "depth"))
    gates = gates.groupBy("_p", "a").agg(F.max("depth").cast("long").alias("b"))
    facts = e.filter("_p = _q").select("_p", F.lit(0).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"))
    facts = facts.unionByName(gates.select("_p", F.lit(1).alias("kind"), "a", "b"))
    facts = facts.unionByName(spots.select("_p", F.lit(2).alias("kind"), F.col("node").alias("a"), F.col("weight").alias("b")))
    if pairs is not None:
        facts = facts.unionByName(pairs.select("_p", F.lit(3).alias("kind"), "a", "b"))
    facts = cut(facts.withColumnRenamed("_p", "leaf").repartition("leaf"))

    def small(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, g, depth, src, inner, own = _leaf(rows)
        where = np.searchsorted(nodes, g)
        dist = np.ascontiguousarray(inner[where].T)
        return pd.DataFrame([(int(rows["leaf"].iloc[0]), g.tolist(), depth.tolist(), dist.tobytes(), src.tolist(), np.ascontiguousarray(own[where]).tobytes())],
                            columns=["piece", "gates", "depth", "dist", "src", "own"])

    def inside(level: int, pieces: DataFrame) -> DataFrame:
        """Pieces of the level below with their parent, and the roads between them as a row without a number."""
        parent = F.floor(F.col("piece") / fan).alias("parent")
        roads = cross.filter(F.col("depth") == level).select(F.floor(F.col("_p") / fan**level).alias("parent"), "src", "dst")
        none = [F.lit(None).cast(t).alias(n) for n, t in (("depth", "array<int>"), ("dist", "binary"))]
        roads = roads.groupBy("parent").agg(F.collect_list(F.struct("src", "dst")).alias("r")).select(
            "parent", F.lit(-1).cast("long").alias("piece"), F.col("r.src").alias("gates"), *none, F.col("r.dst").alias("src"), F.lit(None).cast("binary").alias("own")
        )
        return cut(pieces.select(parent, "*").unionByName(roads))

    below = [facts.groupBy("leaf").applyInPandas(small, _PIECE)]
    for level in range(1, levels + 1):
        below[-1] = inside(level, below[-1])
        if level < levels:
            below.append(below[-1].groupBy("parent").applyInPandas(_join_up(level), _PIECE))
    if pairs is None:
        parts = max(1, -(-spots.count() // chunk))
        dealt = spots.withColumn("chunk", F.pmod(F.xxhash64("node"), F.lit(parts)))
    else:
        parts = max(1, -(-(spots.groupBy("_p").count().agg(F.max("count")).first()[0] or 0) // chunk))
        dealt = spots.withColumn("chunk", F.col("_p") * parts + F.pmod(F.xxhash64("node"), F.lit(parts)))
    sets = dealt.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("node", "weight"))).alias("_s"))
    sets = cut(sets.select("chunk", F.col("_s.node").alias("src"), F.col("_s.weight").alias("weight")))
    if pairs is not None:
        asked = cut(pairs.join(dealt.select(F.col("node").alias("b"), "chunk"), "b").select("_p", "chunk").distinct())
    seen = sets.select(F.lit(0).cast("long").alias("piece"), "chunk", F.array().cast("array<long>").alias("gates"), F.lit(b"").alias("x"))
    for level in range(levels, 0, -1):
        if pairs is None:
            both = below[level - 1].crossJoin(sets.select("chunk"))
        else:
            both = below[level - 1].join(asked.select(F.floor(F.col("_p") / fan**level).alias("parent"), "chunk").distinct(), "parent")
        told = seen.withColumnRenamed("piece", "up").join(sets.select("chunk", "src"), "chunk").withColumnRenamed("chunk", "set")
        told = told.select("up", F.col("set").alias("chunk_up"), F.col("set").alias("chunk"), "gates", "x", "src")
        seen = both.groupBy("parent", "chunk").cogroup(told.groupBy("up", "chunk_up")).applyInPandas(_hand_down, _SEEN)
        if pairs is not None:
            seen = seen.join(asked.select(F.floor(F.col("_p") / fan ** (level - 1)).alias("piece"), "chunk").distinct(), ["piece", "chunk"], "left_semi")
        seen = cut(seen)

    pairs_too = pairs is not None

    def measure(rows: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        made = []
        if len(rows):
            nodes, order, _, src, inner, own = _leaf(rows)
            for one in seen.itertuples():
                every = np.asarray(one.src, np.int64)
                hops = np.full((len(nodes), len(every)), FAR, np.int32)
                if len(one.gates):
                    x = _ints(one.x, len(one.gates), len(every))
                    x = x[np.searchsorted(np.asarray(one.gates, np.int64), order)] if len(order) else x
                    for g in range(len(order)):
                        near = x[g] < FAR
                        if near.any():
                            np.minimum(hops, inner[:, g][:, None] + x[g][None, :], out=hops)
                at = np.minimum(np.searchsorted(every, src), len(every) - 1)
                ok = every[at] == src
                hops[:, at[ok]] = np.minimum(hops[:, at[ok]], own[:, ok])
                told = [nodes, every, np.asarray(one.weight, np.int64), hops]
                if pairs_too:
                    ask = rows[rows["kind"] == 3]
                    col = np.minimum(np.searchsorted(every, ask["b"].to_numpy()), len(every) - 1)
                    mine = every[col] == ask["b"].to_numpy()
                    told += [np.searchsorted(nodes, ask["a"].to_numpy()[mine]), col[mine]]
                made.append(fold(*told))
        return pd.concat(made) if made else pd.DataFrame([], columns=[f.strip().split(" ")[0] for f in schema.split(",")])

    told = seen.join(sets, "chunk").withColumnRenamed("piece", "_leaf")
    return facts.groupBy("leaf").cogroup(told.groupBy("_leaf")).applyInPandas(measure, schema)


def pair_distances(pairs: DataFrame, edges: DataFrame, piece: Callable[[Column], Column], fan: int = FAN, chunk: int = CHUNK) -> DataFrame:
    """Hops from ``source`` to ``node`` for each of ``pairs(source, node)`` that has a way: ``source, node, hops``."""

    def fold(nodes, src, _weight, hops, i, j):
        told = hops[i, j]
        way = told < FAR
        return pd.DataFrame({"source": src[j[way]], "node": nodes[i[way]], "hops": told[way]})

    spots = pairs.select(F.col("source").alias("node"), F.lit(1).alias("weight")).distinct()
    return fold_distances(spots, edges, piece, fold, "source long, node long, hops int", fan, chunk, pairs)
