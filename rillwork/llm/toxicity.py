"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and the first ``LEADS`` letters of longer ones, so that inflected forms meet. All terms of
all training texts count, and a text's other terms count in its norm. A term weighs its inverse document
frequency times one plus the (shrunk) evidence that it marks toxic examples: labels raise weights, no term
is left out. Examples are cut into blocks of alike ones; the index keeps, for each term, its examples by
block and its greatest weight in each. A text's nearest examples come from the blocks with the greatest
bounds first, then from all whose bound still reaches the ``NEIGHBOURS``-th cosine: exact. Votes are weighted
by the square of the cosine, and calibrated on the training rows with each left out of its own vote.
"""

from __future__ import annotations

import math
import re

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import fresh, own, row_key

#: Bound of the labelled rows that the index is fitted on.
TRAIN_ROWS = 2048
#: Letters at the front of a word that are a term too.
LEADS = (5,)
#: Rows that chance is taken to add to those that hold a term, which shrinks the evidence of rare ones.
SHRINK = 8.0
#: Examples in a block, blocks read first, nearest examples that vote, weight of the prior in a vote.
BLOCK, FIRST, NEIGHBOURS, PRIOR_WEIGHT = 64, 4, 15, 0.5
#: Score from which a text is called toxic.
TOXIC = 0.3

_WORD = re.compile(r"[^\W\d_]+")
_KEPT = 1 << 18


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def word_terms(word: str) -> list[str]:
    return [word, *[f"^{word[:k]}" for k in LEADS if len(word) > k]]


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the ranges that begin at ``start`` and have ``size`` places each."""
    end = np.cumsum(size)
    out = np.repeat(start - end + size, size)
    out += np.arange(len(out), dtype=out.dtype)
    return out


def kth(s: np.ndarray, k: int) -> float:
    """The ``k``-th greatest value, 0 where there are fewer."""
    return float(np.partition(s, -k)[-k]) if len(s) >= k else 0.0


class TermCounter:
    """Counts of a text's terms: by number for those of the index, by spelling for others. What a word holds is looked up once."""

    def __init__(self, terms: dict[str, int]):
        self.terms, self.known = terms, {}

    def count(self, text: str) -> dict[int | str, int]:
        out: dict[int | str, int] = {}
        known = self.known
        for word, n in Counter(_WORD.findall(text.lower())).items():
            got = known.get(word)
            if got is None:
                if len(known) > _KEPT:
                    known.clear()
                got = known[word] = tuple(self.terms.get(t, t) for t in word_terms(word))
            for t in got:
                out[t] = out.get(t, 0) + n
        return out


class Index:
    """The fitted index: plain arrays over the training rows, so that tasks can hold it.

    ``rows`` are examples as (id, label, terms, counts); those without a term only set the ``blank`` rate.
    """

    def __init__(self, rows: list[tuple[int, int, list[str], list[int]]]):
        rows = sorted(rows)
        held, blank = [r for r in rows if r[2]], [r[1] for r in rows if not r[2]]
        n, p = len(rows), sum(r[1] for r in rows)
        self.prior = p / n if n else 0.0  # rate of toxic labels
        self.blank = (sum(blank) + self.prior) / (len(blank) + 1)  # the same among examples without a term
        self.terms = {t: i for i, t in enumerate(sorted({t for r in held for t in r[2]}))}
        size = np.array([len(r[2]) for r in held], np.int64)
        term = np.fromiter((self.terms[t] for r in held for t in r[2]), np.int64, int(size.sum()))
        count = np.fromiter((c for r in held for c in r[3]), float, len(term))
        label = np.array([r[1] for r in held], float)
        row = np.repeat(np.arange(len(held)), size)
        df = np.bincount(term, minlength=len(self.terms))
        over = np.maximum(np.bincount(term, label[row], minlength=len(self.terms)) - df * self.prior, 0)
        self.unseen = math.log(1 + n) + 1
        chance = max(self.prior * (1 - self.prior), 1e-9)
        self.weight = (np.log((1 + n) / (1 + df)) + 1) * (1 + over**2 / ((df + SHRINK) * chance))

        value = (1 + np.log(count)) * self.weight[term]
        value /= np.sqrt(np.bincount(row, value**2, minlength=len(held)))[row]
        order = alike(row, term, value, len(held))
        place = np.empty(len(held), np.int64)
        place[order] = np.arange(len(held))
        self.toxic, self.ids = label[order], np.array([held[i][0] for i in order], np.int64)
        at = np.lexsort((place[row], term))
        term, self.example, self.value = term[at], place[row][at].astype(np.int32), value[at]
        self.blocks = -(-len(held) // BLOCK)
        cell = term * max(self.blocks, 1) + self.example // BLOCK
        begin = np.flatnonzero(np.diff(cell, prepend=-1))
        self.begin = np.append(begin, len(term)).astype(np.int32 if len(term) < 1 << 31 else np.int64)  # postings of a term in a block
        self.block = self.example[begin] // BLOCK
        self.top = np.maximum.reduceat(self.value, begin) if len(begin) else np.zeros(0)
        self.of_term = np.searchsorted(term[begin], np.arange(len(self.terms) + 1)).astype(self.begin.dtype)
        self.knots = monotone(np.zeros(0), np.zeros(0))
        if 0 < p < n:
            own = [self.vote(*self.nearest(*self.vector({self.terms[t]: c for t, c in zip(held[i][2], held[i][3])}), skip=j)) for j, i in enumerate(order)]
            self.knots = monotone(np.array(own), self.toxic)

    def vector(self, counts: dict[int | str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Terms of the index in a text and their weights, of a vector of unit length over all its terms."""
        at = np.array([t if type(t) is int else -1 for t in counts], np.int64)
        w = 1 + np.log(np.fromiter(counts.values(), float, len(counts)))
        # sorted, so that the order of a text's words cannot move the last bit
        rest = np.sort(w[at < 0] * self.unseen)
        order = np.argsort(at)[len(rest) :]
        at, w = at[order], w[order] * self.weight[at[order]]
        return at, w / math.sqrt(float(w @ w) + float(rest @ rest))

    def nearest(self, at: np.ndarray, w: np.ndarray, skip: int = -1, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of greatest cosine (ties: lower place first) and their cosines; those with none are left out."""
        size = self.of_term[at + 1] - self.of_term[at]
        cells, w = spans(self.of_term[at], size), np.repeat(w, size)
        block = self.block[cells]
        bound = np.bincount(block, self.top[cells] * w, minlength=self.blocks)

        def read(wanted: np.ndarray) -> np.ndarray:
            on = np.flatnonzero(wanted[block])
            some = cells[on]
            start = self.begin[some]
            n = self.begin[some + 1] - start
            posts = spans(start, n)
            s = np.bincount(self.example[posts], self.value[posts] * np.repeat(w[on], n), minlength=len(self.ids))
            if skip >= 0:
                s[skip] = 0
            return s

        wanted = np.zeros(self.blocks, bool)
        wanted[np.argsort(-bound, kind="stable")[:FIRST]] = True
        s = read(wanted)
        more = ~wanted & (bound > 0) & (bound >= kth(s, k) - 1e-12)
        if more.any():
            s += read(more)
        found = np.flatnonzero((s > 0) & (s >= kth(s, k)))
        best = found[np.argsort(-s[found], kind="stable")[:k]]
        return best, s[best]

    def vote(self, near: np.ndarray, cosines: np.ndarray) -> float:
        w = cosines**2
        return float((w @ self.toxic[near] + PRIOR_WEIGHT * self.prior) / (w.sum() + PRIOR_WEIGHT))

    def score(self, counts: dict[int | str, int]) -> tuple[float, list[int], list[float]]:
        """Calibrated score of a text and its three nearest examples with their cosines."""
        if not 0 < self.prior < 1 or not len(self.ids):
            return self.prior, [], []
        if not counts:
            return self.blank, [], []
        near, cosines = self.nearest(*self.vector(counts))
        score = float(np.interp(self.vote(near, cosines), *self.knots))
        return score, self.ids[near[:3]].tolist(), np.round(cosines[:3], 6).tolist()


def alike(row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Rows of a sparse matrix in an order that puts alike ones together, so that blocks have low bounds for other texts.

    Parts are halved along their main direction until they fit a block. The order only affects the work.
    """
    out, todo = [], [(np.arange(n), row, term, value)]
    while todo:
        rows, r, t, v = todo.pop()
        if len(rows) <= BLOCK:
            out.append(rows)
            continue
        _, r = np.unique(r, return_inverse=True)
        _, t = np.unique(t, return_inverse=True)
        mean = np.bincount(t, v) / len(rows)
        x = np.cos(np.arange(len(rows)) * 2.399963)
        for _ in range(8):
            y = np.bincount(t, v * x[r]) - mean * x.sum()
            x = np.bincount(r, v * y[t]) - mean @ y
            x /= np.linalg.norm(x) or 1.0
        half = -(-len(rows) // (2 * BLOCK)) * BLOCK
        low = np.zeros(len(rows), bool)
        low[np.argsort(x, kind="stable")[:half]] = True
        todo += [(rows[m], rows[r[m[r]]], t[m[r]], v[m[r]]) for m in (~low, low)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def monotone(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares rising curve through ``y`` at ``x`` (pooling neighbours)."""
    groups: list[list[float]] = []
    for value, hit in sorted(zip(x.tolist(), y.tolist())):
        groups.append([hit, 1.0, value, value])
        while len(groups) > 1 and groups[-2][0] / groups[-2][1] >= groups[-1][0] / groups[-1][1]:
            h, n, _, hi = groups.pop()
            groups[-1] = [groups[-1][0] + h, groups[-1][1] + n, groups[-1][2], hi]
    at, rate = [], []
    for h, n, lo, hi in groups:
        level = (h + 0.5 * (h / n)) / (n + 0.5)
        for v in (lo, hi) if hi > lo else (lo,):
            at.append(v)
            rate.append(level)
    return np.array(at or [0.0]), np.array(rate or [0.0])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Index:
    """Fit the index on at most ``rows`` labelled documents, chosen by a hash of their id.

    Held-out ids, null ids and null labels are left out; of repeated labels of an id the largest counts, of
    repeated documents the greatest text. The driver gets the distinct terms of those ``rows`` texts, no more.
    """
    usable = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = chosen.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TermCounter({})
        for batch in batches:
            found = [counter.count(t) for t in batch.column(2).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([list(f) for f in found], pa.list_(pa.string())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))],
                names=["doc_id", "toxic", "t", "c"],
            )

    got = texts.mapInArrow(listed, "doc_id long, toxic int, t array<string>, c array<int>").toArrow()
    return Index(list(zip(*(got.column(i).to_pylist() for i in range(4)))))


def score(docs: DataFrame, labels: DataFrame, toxic_from: float = TOXIC, asked: DataFrame | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted, near_ids, near_cosines`` of every row of ``docs``.

    ``near_ids`` are the nearest labelled examples, the evidence. A text without a term (empty and null
    ones too) gets the rate of toxic labels among such examples. Without labels, or with labels of one kind, every score is the rate of toxic labels (0 without any). Each row
    is scored for itself, so repeated rows agree; other columns are ignored. The score depends on the text
    alone. With ``asked``, its rows are scored in place of ``docs``, which then only has the labelled texts.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        counter = TermCounter(index.terms)
        for batch in batches:
            rows = [index.score(counter.count(batch.column(1)[i].as_py() or "")) for i in range(batch.num_rows)]
            s, ids, cosines = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch(
                [batch.column(0), batch.column(2), pa.array(list(s), pa.float64()), pa.array(list(ids), pa.list_(pa.int64())), pa.array(list(cosines), pa.list_(pa.float64()))],
                names=["doc_id", "held_out", "score", "near_ids", "near_cosines"],
            )

    rows = (docs if asked is None else asked).select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double, near_ids array<long>, near_cosines array<double>")
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= toxic_from, 1).otherwise(0).cast("int").alias("predicted"), "near_ids", "near_cosines")


def without_toxic(docs: DataFrame, labels: DataFrame, toxic_from: float = TOXIC, by_row: bool = False) -> DataFrame:
    """``docs`` without the documents called toxic; rows with a null id stay.

    With ``by_row`` every row is judged by its own text, whether its id is null or repeated or not.
    """
    if by_row:
        bad = score(docs, labels, toxic_from, docs.select(row_key().alias("doc_id"), "text"))
        (key,) = fresh(docs, "_key")
        bad = bad.where("predicted = 1").select(F.col("doc_id").alias(key)).distinct()
        return docs.withColumn(key, row_key()).join(bad, key, "left_anti").select(*own(docs))
    bad = score(docs, labels, toxic_from).where("predicted = 1 and doc_id is not null").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti")
