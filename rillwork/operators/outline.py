"""Outlines of labelled cells as closed rings, whatever their length.

Every cell side whose other side has another label, or none, is a directed edge with its own cell on the right.
An edge's successor starts where it ends; where two cells touch by a corner only, the right turn is taken, so that
cells joined by a corner alone have rings of their own. A ring never crosses itself; it touches itself where its
cells meet both by a corner and by another way. Each tile follows the ways inside it, so that a way through a tile counts as one step;
what crosses tiles is told apart, ordered and closed by doubled jumps, log2(steps) joins for a ring of any length.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.session import cut

#: Corners along the side of a tile.
TILE = 128

#: Sides of a cell in the order of the ring: neighbour, start corner and end corner as steps from (row, col).
_SIDES = (((-1, 0), (0, 0), (0, 1)), ((0, 1), (0, 1), (1, 1)), ((1, 0), (1, 1), (1, 0)), ((0, -1), (1, 0), (0, 0)))


def outline_edges(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``<keys>, edge, next, dir, row, col``: directed edges from corner (row, col) and the edge that follows.

    ``cells(<keys>, row, col)``, distinct; ``keys`` end with the label. ``dir`` is 0 to the right, 1 down, 2 left, 3 up.
    """
    keys = list(keys)
    sides = F.array(
        *[
            F.struct(
                F.lit(d).alias("dir"), (F.col("row") + n[0]).alias("_nr"), (F.col("col") + n[1]).alias("_nc"),
                (F.col("row") + s[0]).cast("long").alias("_r"), (F.col("col") + s[1]).cast("long").alias("_c"),
                (F.col("row") + e[0]).cast("long").alias("_er"), (F.col("col") + e[1]).cast("long").alias("_ec"),
            )
            for d, (n, s, e) in enumerate(_SIDES)
        ]
    )
    every = cells.select(*keys, F.inline(sides))
    there = cells.select(*keys, F.col("row").alias("_nr"), F.col("col").alias("_nc"))
    # an edge is named by its start and direction: one number, as corners of a raster fit 31 bits each way
    name = F.shiftleft(F.shiftleft(F.col("_r"), 31) + F.col("_c"), 2) + F.col("dir")
    edges = every.join(there, [*keys, "_nr", "_nc"], "left_anti").withColumn("edge", name).drop("_nr", "_nc")
    edges = cut(edges)
    out = edges.select(*keys, F.col("_r").alias("_er"), F.col("_c").alias("_ec"), F.col("edge").alias("_n"), F.col("dir").alias("_d"))
    turn = (F.col("_d") - F.col("dir") + 4) % 4  # 1 right, 0 straight, 3 left
    wish = F.when(turn == 1, 0).when(turn == 0, 1).otherwise(2)
    follow = edges.join(out, [*keys, "_er", "_ec"]).filter(turn != 2)
    return follow.groupBy(*keys, "edge").agg(
        F.min_by("_n", wish).alias("next"), F.first("dir").alias("dir"), F.first("_r").alias("row"), F.first("_c").alias("col")
    )


def _heads(before: np.ndarray):
    """Where the way to each edge begins, the steps from there, and which ways are closed; those begin at their smallest edge.

    ``before`` is each edge's predecessor, or -1 where the way enters the tile.
    """
    every = np.arange(len(before))
    rounds = max(1, int(len(before) - 1).bit_length() + 1)
    jump, least = np.where(before < 0, every, before), every
    for _ in range(rounds):
        least, jump = np.minimum(least, least[jump]), jump[jump]
    closed = before[jump] >= 0
    first = (before < 0) | (closed & (least == every))
    jump, steps = np.where(first, every, before), (~first).astype(np.int64)
    for _ in range(rounds):
        steps, jump = steps + steps[jump], jump[jump]
    return jump, steps, closed


def _follow(keys: Sequence[str], out: Sequence[str]):
    """Edges of a tile with the head of their way; a head's row has the way's length, exit and smallest edge."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([keys[-1], "edge"], ignore_index=True)
        label, edge = pd.factorize(rows[keys[-1]])[0], rows["edge"].to_numpy()
        after = pd.MultiIndex.from_arrays([label, edge]).get_indexer(pd.MultiIndex.from_arrays([label, rows["next"].to_numpy()]))
        n = len(rows)
        before = np.full(n, -1)
        inside = np.flatnonzero(after >= 0)
        before[after[inside]] = inside
        head, steps, closed = _heads(before)
        length = np.bincount(head, minlength=n)
        least = np.full(n, n)
        np.minimum.at(least, head, np.arange(n))
        least = np.where(least < n, least, 0)
        to = pd.array(np.zeros(n, np.int64), dtype="Int64")
        to[:] = pd.NA
        last = np.flatnonzero(after < 0)
        to[head[last]] = rows["next"].to_numpy()[last]
        return rows.assign(head=edge[head], off=steps, closed=closed, to=to, length=length, least=edge[least], least_off=steps[least])[list(out)]

    return run


def outline_rings(cells: DataFrame, keys: Sequence[str], max_rounds: int = 64, tile: int = TILE) -> DataFrame:
    """``<keys>, ring, pos, dir, row, col``: the edges of every ring in order; ``ring`` is its smallest edge."""
    keys = list(keys)
    edges = outline_edges(cells, keys).withColumns({"_tr": F.floor(F.col("row") / tile), "_tc": F.floor(F.col("col") / tile)})
    names = [*keys, "edge", "dir", "row", "col"]
    types = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    extra = {"head": "long", "off": "long", "closed": "boolean", "to": "long", "length": "long", "least": "long", "least_off": "long"}
    schema = ", ".join([*(f"{n} {types[n]}" for n in names), *(f"{n} {t}" for n, t in extra.items())])
    ways = cut(edges.groupBy(*keys[:-1], "_tr", "_tc").applyInPandas(_follow(keys, [*names, *extra]), schema))

    crossing = cut(ways.filter("edge = head and not closed").select(*keys, "head", "to", "length", "least", "least_off"))
    state = crossing.select(*keys, "head", F.col("to").alias("_p"), F.col("least").alias("_m"))
    for _ in range(max_rounds):
        far = state.select(*keys, F.col("head").alias("_p"), F.col("_p").alias("_pp"), F.col("_m").alias("_mm"))
        met = cut(state.join(far, [*keys, "_p"]).select(*keys, "head", F.col("_pp").alias("_p"), "_m", "_mm"))
        if met.filter("_mm <> _m").isEmpty():
            break
        state = met.select(*keys, "head", "_p", F.least("_m", "_mm").alias("_m"))
    else:
        raise RuntimeError("rings did not settle; raise max_rounds")
    crossing = cut(crossing.join(met.select(*keys, "head", F.col("_m").alias("ring")), [*keys, "head"]))
    # edges from each way's head to the head of the way that holds the ring's first edge
    first = F.col("least") == F.col("ring")
    state = crossing.select(*keys, "head", F.when(~first, F.col("to")).alias("_p"), F.when(first, 0).otherwise(F.col("length")).alias("_d"))
    for _ in range(max_rounds):
        state = cut(state)
        todo = state.filter("_p is not null")
        if todo.isEmpty():
            break
        far = state.select(*keys, F.col("head").alias("_p"), F.col("_p").alias("_pp"), F.col("_d").alias("_dd"))
        moved = todo.join(far, [*keys, "_p"]).select(*keys, "head", F.col("_pp").alias("_p"), (F.col("_d") + F.col("_dd")).alias("_d"))
        state = state.filter("_p is null").unionByName(moved)
    else:
        raise RuntimeError("rings did not settle; raise max_rounds")
    size = crossing.groupBy(*keys, "ring").agg(F.sum("length").alias("_n"), F.max(F.when(first, F.col("least_off"))).alias("_o"))
    told = crossing.select(*keys, "head", "ring").join(state.select(*keys, "head", "_d"), [*keys, "head"]).join(size, [*keys, "ring"])
    placed = ways.join(told, [*keys, "head"], "left")
    pos = F.when(F.col("closed"), F.col("off")).otherwise(F.pmod(F.col("off") - F.col("_d") - F.col("_o"), F.col("_n")))
    ring = F.when(F.col("closed"), F.col("head")).otherwise(F.col("ring"))
    return placed.select(*keys, ring.alias("ring"), pos.alias("pos"), "dir", "row", "col")


def ring_facts(rings: DataFrame, keys: Sequence[str], cell_size: float) -> DataFrame:
    """Edges, corners, length and signed area per ring: outer rings count positive, ``hole`` rings negative.

    Areas of a label's rings add up to the area of its cells.
    """
    keys = list(keys)
    size = float(cell_size)
    along = F.when(F.col("dir") == 1, F.col("col")).when(F.col("dir") == 3, -F.col("col")).otherwise(0)
    facts = rings.groupBy(*keys, "ring").agg(F.count(F.lit(1)).alias("edges"), (F.sum(along) * F.lit(size * size)).alias("area_m2"))
    turns = ring_vertices(rings, keys).groupBy(*keys, "ring").agg(F.count(F.lit(1)).alias("corners"))
    out = facts.join(turns, [*keys, "ring"])
    return out.select(*keys, "ring", "edges", "corners", (F.col("edges") * F.lit(size)).alias("length_m"), "area_m2", (F.col("area_m2") < 0).alias("hole"))


def ring_vertices(rings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``<keys>, ring, pos, row, col``: the corners of every ring, without points on straight stretches."""
    keys = list(keys)
    size = rings.groupBy(*keys, "ring").agg(F.count(F.lit(1)).alias("_n"))
    before = rings.join(size, [*keys, "ring"]).select(*keys, "ring", ((F.col("pos") + 1) % F.col("_n")).alias("pos"), F.col("dir").alias("_d"))
    return rings.join(before, [*keys, "ring", "pos"]).filter("dir <> _d").select(*keys, "ring", "pos", "row", "col")
