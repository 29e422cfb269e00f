"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

Every window of a document that shares a word shingle with the benchmark, laid over an item's place and
as long as the item, gets a 64-bit SimHash of its shingles. (A window that shares none has similarity 0.)
Fingerprints are cut into ``BLOCKS`` blocks: two that differ in at most ``RADIUS`` bits agree in some
block up to ``RADIUS // BLOCKS`` bits, so the item side is listed under all block values that near, and
an equi-join on block and value finds every window within the radius. Those are verified by the exact
weighted Jaccard similarity of their shingles, weights being multiplicities.

The radius is generous: at similarity 0.75 the expected distance is 11 bits with a deviation of 3.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import NEAR, WIDTH, fresh, own, row_key, stow, words
from rillwork.llm.fingerprints import BITS, signed, votes

RADIUS, BLOCKS = 23, 8


def _norm(text: Column) -> Column:
    return words(F.lower(text))


def _shingle(w: str, i: str) -> Column:
    return F.xxhash64(*[F.expr(f"get({w}, {i} + {k})") for k in range(WIDTH)])


def _shingles(rows: DataFrame, by: list[str], w: str) -> DataFrame:
    """``by, at, sh`` for every shingle of the word list ``w``; shorter lists have none."""
    spot = rows.where(F.size(w) >= WIDTH).select(*by, w, F.explode(F.sequence(F.lit(0), F.size(w) - WIDTH)).alias("at"))
    return spot.select(*by, "at", _shingle(w, "at").alias("sh"))


def _simhash(shingles: DataFrame, by: list[str]) -> DataFrame:
    one = F.lit(1).cast("long")
    return shingles.groupBy(*by).agg(F.sum(one).alias("_all"), *votes([F.col("sh")], one)).select(*by, F.col("_all").alias("sh_all"), signed(F.col("_all")).alias("fp"))


def _blocks(fp: Column) -> Column:
    width = BITS // BLOCKS
    return F.array(*[F.struct(F.lit(b).alias("b"), F.shiftrightunsigned(fp, b * width).bitwiseAND(F.lit((1 << width) - 1)).alias("v")) for b in range(BLOCKS)])


def _near_masks() -> Column:
    """Differences of a block within the reach that every pair within the radius has in some block."""
    width = BITS // BLOCKS
    masks = [sum(1 << i for i in c) for k in range(RADIUS // BLOCKS + 1) for c in combinations(range(width), k)]
    return F.array(*[F.lit(m).cast("long") for m in masks])


def leaks(docs: DataFrame, benchmark: DataFrame, near: float = NEAR) -> DataFrame:
    """``doc_id, item_id, start_word, n_words, similarity, distance``: benchmark passages in documents.

    One row per document and item: the most similar window (the first of equals), at word ``start_word``
    (from 0), whose similarity is at least ``near``; ``distance`` is the Hamming distance of the
    fingerprints. Words are lower-cased. A window is as long as the item, or the whole document where
    that is shorter. Null and empty texts match nothing; items and documents of fewer than five words
    have no shingle and are no evidence. Rows that repeat an id and a text are one document; a null
    ``doc_id`` or ``item_id`` is reported as null. Other columns are ignored.
    """
    items = benchmark.select("item_id", _norm(F.col("text")).alias("w")).where(F.size("w") >= WIDTH)
    items = items.select("item_id", F.xxhash64("item_id", "w").alias("item"), F.size("w").alias("n"), "w").dropDuplicates(["item_id", "item"])
    listed = stow(_shingles(items, ["item_id", "item", "n"], "w"), "item-shingles")
    marks = listed.select("sh", "n", F.col("at").alias("off")).distinct()

    # windows: where a document shares a shingle with an item, at the place the item would begin; only keys
    # and places are joined, whether the engine shuffles or broadcasts, and the few windows read their words afterwards
    listed_docs = docs.select("doc_id", F.xxhash64("text").alias("key"), _norm(F.col("text")).alias("w")).where(F.size("w") >= WIDTH)
    spots = listed_docs.select("doc_id", "key", F.size("w").alias("len"), "w", F.explode(F.sequence(F.lit(0), F.size("w") - WIDTH)).alias("at"))
    spots = spots.select("doc_id", "key", "len", "at", _shingle("w", "at").alias("sh"))
    begin = F.greatest(F.lit(0), F.least(F.col("at") - F.col("off"), F.col("len") - F.col("n")))
    found = stow(spots.join(marks, "sh").select("doc_id", "key", "n", begin.alias("start")).distinct(), "places")
    asked = found.select(F.col("doc_id").alias("id"), F.col("key").alias("k"), "n", "start")
    windows = listed_docs.join(asked, F.expr("doc_id <=> id and key = k")).select("doc_id", "key", "n", "start", F.slice("w", F.col("start") + 1, F.col("n")).alias("w"))
    windows = stow(windows.dropDuplicates(["doc_id", "key", "n", "start"]), "windows")
    by = ["doc_id", "key", "n", "start"]
    shingles = _shingles(windows, by, "w")
    prints = stow(_simhash(shingles, by), "window-prints")
    item_prints = _simhash(listed, ["item_id", "item", "n"])

    block = F.explode(_blocks(F.col("fp"))).alias("k")
    asks = item_prints.select("item_id", "item", "n", F.col("fp").alias("item_fp"), F.col("sh_all").alias("item_all"), block)
    asks = asks.select("*", F.explode(_near_masks()).alias("mask")).select("item_id", "item", "n", "item_fp", "item_all", "k.b", F.col("k.v").bitwiseXOR(F.col("mask")).alias("v"))
    have = prints.select(*by, "fp", "sh_all", block).select(*by, "fp", "sh_all", "k.b", "k.v")
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    pairs = have.join(asks, ["n", "b", "v"]).where(apart <= RADIUS).select(*by, "item_id", "item", "sh_all", "item_all", apart.alias("distance")).distinct()

    # exact similarity: shared shingles with multiplicity over all of both
    a = shingles.groupBy(*by, "sh").agg(F.count("*").alias("ca"))
    b = listed.groupBy("item", "sh").agg(F.count("*").alias("cb"))
    same = F.expr("x.doc_id <=> y.doc_id and x.key = y.key and x.n = y.n and x.start = y.start")
    shared = pairs.alias("x").join(a.alias("y"), same).select("x.*", "y.sh", "y.ca").join(b, ["item", "sh"])
    both = F.sum(F.least("ca", "cb"))
    scored = shared.groupBy(*by, "item_id", "item", "sh_all", "item_all", "distance").agg(both.alias("both"))
    scored = scored.withColumn("similarity", F.col("both") / (F.col("sh_all") + F.col("item_all") - F.col("both"))).where(F.col("similarity") >= near)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n", "distance")).alias("best")
    return scored.groupBy("doc_id", "key", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("best.back")).alias("start_word"), F.col("best.n").alias("n_words"),
        F.round("best.similarity", 6).alias("similarity"), F.col("best.distance").alias("distance"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, near: float = NEAR, by_row: bool = False) -> DataFrame:
    """``docs`` without the documents that :func:`leaks` reports; rows with a null id stay.

    With ``by_row`` every row is judged by its own text, whether its id is null or repeated or not.
    """
    if by_row:
        (key,) = fresh(docs, "_key")
        found = leaks(docs.select(row_key().alias("doc_id"), "text"), benchmark, near).select(F.col("doc_id").alias(key)).distinct()
        return docs.withColumn(key, row_key()).join(found, key, "left_anti").select(*own(docs))
    found = leaks(docs, benchmark, near).select("doc_id").where("doc_id is not null").distinct()
    return docs.join(found, "doc_id", "left_anti")
