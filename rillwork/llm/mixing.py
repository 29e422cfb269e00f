"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rillwork.llm.common import fresh, own, row_key, stow, words

#: Rows of a source that one window task orders at the cut.
CUT_ROWS = 1 << 11


def source_targets(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row per source.

    Sources in code point order (null last) take the weights in turn and share the sum of all sizes.
    A target stops at ``most`` times its source's size; what is over goes to the others by weight. With
    sources sorted by the level at which each is full, the final level is the first that fits.
    """
    one, n = F.lit(0), len(weights)
    turn = F.row_number().over(W.partitionBy(one).orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn % n + 1).cast("int")).cast("long")
    rows = sizes.withColumn("w", weight).withColumn("full", most * F.col("source_size"))
    order = W.partitionBy(one).orderBy(F.col("full") / F.col("w"), F.col("source").asc_nulls_last())
    rows = (
        rows.withColumn("at", F.row_number().over(order))
        .withColumn("left", F.sum("source_size").over(W.partitionBy(one)) - F.sum("full").over(order.rowsBetween(W.unboundedPreceding, 0)) + F.col("full"))
        .withColumn("share", F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)))
    )
    fits = F.col("left") * F.col("w") <= F.col("full") * F.col("share")
    level = F.min(F.when(fits, F.struct("at", "left", "share"))).over(W.partitionBy(one))
    target = F.when(F.col("at") < F.col("level.at"), F.col("full").cast("double")).otherwise(
        (F.col("level.left") * F.col("w")).cast("double") / F.col("level.share")
    )
    return rows.withColumn("level", level).select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: str = "", keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of every row of ``docs``.

    ``size`` counts the words of the text (null or empty: 0). The documents of a source stand in the
    order of a hash of ``seed`` and ``doc_id``; whole epochs are taken while the target allows, and the
    rest is cut from the front of that order, inside the document where the sum meets it. ``taken``
    counts words with repeats. A null source is a source of its own, the last. Null ids share one place
    in the order; rows that repeat an id follow each other by size, so equal rows may be cut unequally
    but the result is the same each time. Columns of ``keep`` are passed on and order such rows after
    their size; others are ignored; an empty table gives an empty
    result. Sources are one row each in the sharing step; documents never meet in one task: only those
    of the bucket that holds a source's cut, about ``CUT_ROWS``, are ordered.
    """
    if most < 1 or min(weights) < 1:
        raise ValueError("weights and most must be at least 1")
    key = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    slim = stow(docs.select("doc_id", "source", *keep, F.size(words(F.col("text"))).cast("long").alias("size"), key.alias("key")), "sizes")
    bits = max(0, (slim.count() // CUT_ROWS).bit_length())
    slim = slim.withColumn("bucket", F.shiftright("key", 60 - bits))
    sums = slim.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("s").alias("source_size")), weights, most)
    targets = targets.withColumn("budget", F.floor("target").cast("long")).select(
        "*",
        F.expr("if(source_size > 0, budget div source_size, 0L)").alias("epochs"),
        F.expr("if(source_size > 0, budget % source_size, 0L)").alias("rest"),
    )
    before = F.sum("s").over(W.partitionBy("source").orderBy("bucket")) - F.col("s")
    spans = sums.withColumn("before", before)
    t, c = targets.alias("t"), spans.alias("c")
    inside = (F.col("c.before") <= F.col("t.rest")) & (F.col("t.rest") < F.col("c.before") + F.col("c.s"))
    plan = t.join(c, F.col("t.source").eqNullSafe(F.col("c.source")) & inside, "left").select(
        F.col("t.source").alias("of"), "source_size", "target", "epochs", "rest", F.col("c.bucket").alias("cut_at"), "before"
    )
    rows = slim.join(plan, F.col("source").eqNullSafe(F.col("of")))
    order = W.partitionBy("source").orderBy("key", "doc_id", "size", *keep).rowsBetween(W.unboundedPreceding, -1)
    at = rows.where("bucket = cut_at").withColumn("first", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    at = at.withColumn("extra", F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("first")))).drop("first")
    off = rows.where("cut_at is null or bucket <> cut_at").withColumn("extra", F.when(F.col("bucket") < F.col("cut_at"), F.col("size")).otherwise(F.lit(0)))
    return at.unionByName(off).select(
        "doc_id", "source", *keep, "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("extra")).cast("long").alias("taken")
    )


def mixture(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: str = "") -> DataFrame:
    """The mix itself: the rows of ``docs`` once per epoch, with ``epoch`` (from 1) and ``epoch_words``.

    ``epoch_words`` is the words to take from the front of the text in that epoch: all of them except in
    the document that a source's budget cuts. Documents without words, and those that the mix leaves
    out, are not in it. Every row counts for itself, also with a null or repeated id: rows get stored
    numbers of their own, by which they meet what is taken of them. Other columns pass through, whatever
    their names, but for ``epoch`` and ``epoch_words``, which are replaced.
    """
    docs = docs.drop("epoch", "epoch_words")
    tie, row, size, take = fresh(docs, "_tie", "_row", "_size", "_take")
    rows = stow(docs.withColumn(tie, row_key()).withColumn(row, F.monotonically_increasing_id()), "rows")
    taken = mix_sources(rows, weights, most, seed, [tie, row]).where("taken > 0")
    taken = taken.select(row, F.col("size").alias(size), F.col("taken").alias(take))
    epoch = F.explode(F.sequence(F.lit(1), F.ceil(F.col(take) / F.col(size)).cast("int")))
    return (
        rows.join(taken, row)
        .withColumn("epoch", epoch)
        .withColumn("epoch_words", F.least(F.col(size), F.col(take) - (F.col("epoch") - 1) * F.col(size)))
        .select(*own(docs), "epoch", "epoch_words")
    )
