"""Exact top-k search by distributed histogram selection.

All queries are scored against all rows, in cells: rows and queries are dealt by hash into bounded parts,
and each cell multiplies one part of the rows with one of the queries. No cell holds more vectors than
``CELL`` entries allow, whatever the size of the table.

A round scores every cell and counts each query's scores by bin. The first round's bins span all scores
that the longest vector allows; the counts of all cells, added up, tell in which bin the k-th greatest
score lies, and the next round cuts that bin into ``2 ** BITS`` bins again, until a bin is one score wide:
the k-th value, exactly. A cell reports a query's bins from the top down until it alone holds as many
scores as are asked for; the k-th value cannot lie below. The last pass keeps the scores above the k-th
value, and of those equal to it the smallest ids that are needed.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rillwork.llm.common import stow
from rillwork.llm.vectors import whole_vectors

#: Scores asked for, and the step of the ids that are queries.
TOP, EVERY = 5, 50
#: Entries of the vectors of a cell, rows and queries alike.
CELL = 1 << 21
#: Entries under which a cell is not cut further for the sake of idle cores.
LEAST_CELL = 1 << 17
#: Bits of the score range that a round resolves.
BITS = 10
#: Scores that a task holds at once.
SHEET = 1 << 21

_EXACT = float(1 << 53)
_LONG = (-(1 << 63), (1 << 63) - 1)


def inner(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of whole-number vectors as longs, exact; what a long cannot hold becomes its limit."""
    if not q.shape[1]:
        return np.zeros((len(q), len(c)), np.int64)
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    most = math.sqrt((qf * qf).sum(axis=1).max(initial=0) * (cf * cf).sum(axis=1).max(initial=0))
    if most < _EXACT / 2:
        return (qf @ cf.T).astype(np.int64)
    return np.clip(q.astype(object) @ c.astype(object).T, *_LONG).astype(np.int64)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    got = column.combine_chunks()
    got = got.chunk(0) if isinstance(got, pa.ChunkedArray) else got
    return got.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dim)


def _ids(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(0).to_numpy().astype(np.int64), column.is_null().to_numpy()


def _sheets(rows: pa.Table, asked: pa.Table, dim: int):
    """Blocks of queries with their scores against the cell's rows; the own rows of a query are masked out."""
    c, (ids, gone) = _matrix(rows["x"], dim), _ids(rows["vec_id"])
    q, (own, _) = _matrix(asked["x"], dim), _ids(asked["vec_id"])
    step = max(1, min(SHEET // max(1, len(c)), SHEET >> BITS))
    for at in range(0, len(q), step):
        part = slice(at, at + step)
        yield part, inner(q[part], c), (own[part, None] != ids[None, :]) | gone[None, :], ids, gone


def _unsigned(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(np.uint64)


def _count(shift: int, width: int, dim: int, rows: pa.Table, asked: pa.Table) -> pa.Table:
    """Bins of width ``2 ** shift`` inside each query's open range of ``2 ** width`` scores, from the top down."""
    lo, need = _unsigned(asked["lo"]), asked["need"].to_numpy()
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for part, scores, free, _, _ in _sheets(rows, asked, dim):
        away = scores.view(np.uint64) - lo[part, None]
        if width < 64:
            free &= away < np.uint64(1 << width)
        bins = 1 << (width - shift)
        n = scores.shape[0]
        spot = np.nonzero(free)
        place = spot[0] * bins + (away[spot] >> np.uint64(shift)).astype(np.int64)
        counts = np.bincount(place, minlength=n * bins).reshape(n, bins)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        row, b = np.nonzero((counts > 0) & (above < need[part, None]))
        out.append((row + part.start, b, counts[row, b]))
    return _table(asked, out, lambda row, b, n: {"bin": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})


def _table(asked: pa.Table, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rest) -> pa.Table:
    row, a, b = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
    at = pa.array(row, pa.int64())
    return pa.table({"query_id": asked["vec_id"].take(at), "q": asked["q"].take(at), **rest(row, a, b)})


def _pick(k: int, dim: int, rows: pa.Table, asked: pa.Table) -> pa.Table:
    """Scores from each query's k-th value on; no more than ``k`` of a cell are needed, ties by id."""
    lo = asked["lo"].to_numpy().astype(np.int64)
    out = []
    for part, scores, free, ids, gone in _sheets(rows, asked, dim):
        row, col = np.nonzero(free & (scores >= lo[part, None]))
        s = scores[row, col]
        order = np.lexsort((ids[col], gone[col], ~s, row))
        row, col, s = row[order], col[order], s[order]
        first = np.searchsorted(row, row, side="left")
        kept = np.arange(len(row)) - first < k
        out.append((row[kept] + part.start, col[kept], s[kept]))
    return _table(asked, out, lambda row, col, s: {"vec_id": rows["vec_id"].take(pa.array(col, pa.int64())), "score": pa.array(s, pa.int64())})


def _cells(rows: DataFrame, asked: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(dim, rows, asked)`` of every cell; each side is copied once for every part of the other."""
    left = rows.withColumn("g", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).groupBy("dim", "s", "g")
    right = asked.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("s") - 1))).groupBy("dim", "s", "g")

    def run(key, a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({f.split()[0]: pa.array([], pa.int64()) for f in schema.split(", ")})
        return fn(key[0].as_py(), a, b)

    return left.cogroup(right).applyInArrow(run, schema)


def top_scores(table: DataFrame, k: int = TOP, every: int = EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of greatest inner product with every query.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but those with the
    query's id. Entries are first made whole (``vectors.scaled``). Rows whose vector is null or holds a null
    or an entry that is not finite take no part. Equal scores are ranked by id, a null id last. Fewer
    candidates than ``k`` are all returned. A row with a null id is a candidate and never a query. Repeated
    rows are candidates as often as they occur; as queries, rows that repeat id and vector are one, and rows
    with one id and several vectors are ranked each for itself. A query meets vectors of its own length
    only. Scores beyond a long become its limit. An empty table gives an empty result; other columns of
    ``table``, whatever their names, are ignored.
    """
    if k < 1 or every < 1:
        raise ValueError("k and every must be 1 or more")
    spark = table.sparkSession
    source = whole_vectors(table).withColumn("dim", F.size("x"))
    is_query = F.col("vec_id") % every == 0
    norm = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    # one row for each length of vector: lengths that differ add up, so there are at most sqrt(2 * entries)
    facts = stow(source.groupBy("dim").agg(F.count("*").alias("rows"), F.count_if(is_query).alias("asked"), F.max(norm).alias("norm")), "lengths")
    top = facts.agg(F.max("norm").alias("norm"), F.sum("asked").alias("asked")).first()
    empty = "query_id long, rank int, vec_id long, score long"
    if not top["asked"]:
        return spark.createDataFrame([], empty)
    bound = min(int(top["norm"] * (1 + 1e-9)) + 2, -_LONG[0])
    bits = min(64, (2 * bound).bit_length())
    least = max(-bound, _LONG[0])
    entries = F.greatest(F.col("dim"), F.lit(1))
    cores = spark.sparkContext.defaultParallelism
    need_parts = F.ceil(F.col("rows") * entries / F.lit(CELL))
    more = F.least(F.lit(cores).cast("long"), F.ceil(F.col("rows") * entries / F.lit(LEAST_CELL)))
    parts = facts.where("asked > 0").select("dim", F.greatest(need_parts, more).cast("int").alias("s"), F.ceil(F.col("asked") * entries / F.lit(CELL)).cast("int").alias("g"))
    dealt = source.join(F.broadcast(parts), "dim")
    # dealt by number, so that copies of a row do not meet in one cell; the table is written before it is read
    number = F.monotonically_increasing_id()
    rows = stow(dealt.select("dim", "vec_id", "x", F.pmod(number, "s").cast("int").alias("s"), "g"), "rows")
    distinct = dealt.where(is_query).dropDuplicates(["vec_id", "x"])
    queries = stow(distinct.select(F.xxhash64("x").alias("q"), "dim", "vec_id", "x", "s", F.pmod(number, "g").cast("int").alias("g")), "queries")
    key = ["query_id", "q"]
    state = queries.select(F.col("vec_id").alias("query_id"), "q", F.lit(least).cast("long").alias("lo"), F.lit(k).cast("long").alias("need"))
    width = bits
    while width > 0:
        shift = max(0, width - BITS)
        counted = _cells(rows, _asked(queries, state), partial(_count, shift, width), "query_id long, q long, bin long, n long")
        counts = counted.groupBy(*key, "bin").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(W.partitionBy(*key).orderBy(F.desc("bin")))
        hit = counts.withColumn("upto", upto).join(state.select(*key, "need"), key).where("upto - n < need")
        hit = hit.groupBy(*key).agg(F.min("bin").alias("bin"), F.max("upto").alias("upto"), F.max(F.col("upto") - F.col("n")).alias("above"))
        # where all scores are fewer than asked for, the range keeps its lower end and all of them pass
        short = F.coalesce("upto", F.lit(0)) < F.col("need")
        step = F.col("lo").cast("decimal(38,0)") + F.col("bin") * F.lit(1 << shift).cast("decimal(20,0)")
        state = state.join(hit, key, "left").select(
            *key,
            F.when(short, F.col("lo")).otherwise(step.cast("long")).alias("lo"),
            F.when(short, F.col("need")).otherwise(F.col("need") - F.col("above")).alias("need"),
        )
        state = stow(state, "state")
        width = shift
    picked = _cells(rows, _asked(queries, state), partial(_pick, k), "query_id long, q long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    ranked = picked.select("query_id", rank.alias("rank"), "vec_id", "score", "q").where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _asked(queries: DataFrame, state: DataFrame) -> DataFrame:
    """The queries with the lower end of their open range and the number of scores to find in it."""
    open_ = state.withColumnRenamed("query_id", "vec_id")
    return queries.join(open_, ["vec_id", "q"]).select("dim", "s", "g", "vec_id", "q", "x", "lo", "need")
