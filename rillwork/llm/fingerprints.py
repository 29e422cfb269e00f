"""SimHash fingerprints of whole texts, their likeness, and permuted block tables to search them."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rillwork.llm.common import stow, words

BITS = 64
#: Counters are summed two to a long: bit ``j`` in the low half, bit ``j + 32`` in the high half.
_HALF = BITS // 2
_LOW = (1 << 32) - 1


def votes(term: Column, weight: Column) -> list[Column]:
    """The 32 sums whose halves count the weight of terms that have a bit set."""
    h = F.xxhash64(term) if not isinstance(term, list) else F.xxhash64(*term)
    out = []
    for j in range(_HALF):
        pair = F.shiftrightunsigned(h, j).bitwiseAND(F.lit((1 << 32) | 1))
        out.append(F.sum(pair * weight).alias(f"_v{j}"))
    return out


def signed(total: Column) -> Column:
    """The fingerprint: a bit is set where more than half of the weight votes for it."""
    out = F.lit(0).cast("long")
    for j in range(_HALF):
        v = F.col(f"_v{j}")
        out = out.bitwiseOR(F.when(2 * v.bitwiseAND(F.lit(_LOW)) > total, F.lit(1 << j)).otherwise(F.lit(0)))
        high = (1 << (j + 32)) if j < 31 else -(1 << 63)
        out = out.bitwiseOR(F.when(2 * F.shiftrightunsigned(v, 32) > total, F.lit(high)).otherwise(F.lit(0)))
    return out


def fingerprint(rows: DataFrame, by: list[str], text: str) -> DataFrame:
    """``by`` and ``fp``: the SimHash of column ``text``, one row per group of ``by``.

    Terms are pairs of neighbouring words (a single word: itself), each with the number of its bytes in
    fours as weight, at most 9, so that longer and rarer pairs count for more; repeats vote again. No
    words, or null: 0. A group's votes are summed where its rows are, before any exchange.
    """
    listed = rows.select(*by, words(F.col(text)).alias("_w"))
    at = F.explode_outer(F.sequence(F.lit(0), F.greatest(F.size("_w") - 2, F.lit(0)))).alias("_i")
    placed = listed.select(*by, "_w", at)
    a, b = F.expr("get(_w, _i)"), F.expr("get(_w, _i + 1)")
    weight = F.when(a.isNull(), 0).otherwise(1 + F.least(F.lit(8), F.floor((F.octet_length(a) + F.coalesce(F.octet_length(b), F.lit(0))) / 4)))
    weight = weight.cast("long")
    sums = placed.groupBy(*by).agg(F.sum(weight).alias("_all"), *votes([a, b], weight))
    return sums.select(*by, signed(F.col("_all")).alias("fp"))


def as_text(fp: Column) -> Column:
    """A fingerprint as 16 hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the two vote vectors as estimated from the differing bits; 0 where half or more differ."""
    apart = F.bit_count(a.bitwiseXOR(b))
    return F.round(F.greatest(F.lit(0.0), F.cos(apart * F.lit(3.141592653589793 / BITS))), 6)


def block_keys(fp: Column, radius: int, blocks: int) -> Column:
    """Keys of a fingerprint in the permuted tables: one table per choice of ``blocks - radius`` blocks.

    At most ``radius`` differing bits leave that many blocks untouched, so fingerprints within the radius
    meet in a table.
    """
    bounds = [BITS * k // blocks for k in range(blocks + 1)]
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << bounds[k + 1]) - 1) ^ ((1 << bounds[k]) - 1) for k in chosen)
        mask -= (1 << 64) if mask >> 63 else 0
        keys.append(F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(mask)).alias("k")))
    return F.array(*keys)


def within_radius(queries: DataFrame, index: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """All pairs ``q, fp, apart`` of distinct fingerprints of both tables (column ``fp``) within ``radius``.

    Exact: nothing within the radius is missed. Copies meet once, as one fingerprint. Null fingerprints
    are skipped. ``blocks`` must exceed ``radius``.
    """
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("radius must be below blocks")

    def tables(df: DataFrame, name: str) -> DataFrame:
        fps = df.select(F.col("fp").alias(name)).where(F.col(name).isNotNull()).distinct()
        return fps.select(name, F.explode(block_keys(F.col(name), radius, blocks)).alias("_k")).select(name, "_k.t", "_k.k")

    apart = F.bit_count(F.col("q").bitwiseXOR(F.col("fp")))
    met = tables(queries, "q").join(tables(index, "fp"), ["t", "k"]).where(apart <= radius)
    return met.select("q", "fp", apart.alias("apart")).distinct()


def next_keys(keys: DataFrame) -> DataFrame:
    """``key, next`` for distinct ``key`` in ascending order, the last followed by the first.

    Keys are cut into ranges; inside a range a window finds the next key, and the first key of each range
    (one row per partition) closes the gaps.
    """
    ranged = keys.select("key").repartitionByRange("key").withColumn("part", F.spark_partition_id())
    ranged = stow(ranged, "ranges")
    inner = ranged.withColumn("next", F.lead("key").over(W.partitionBy("part").orderBy("key")))
    firsts = ranged.groupBy("part").agg(F.min("key").alias("first"))
    one = W.partitionBy(F.lit(0))
    after = firsts.select("part", F.coalesce(F.lead("first").over(one.orderBy("part")), F.min("first").over(one)).alias("after"))
    return inner.join(after, "part").select("key", F.coalesce("next", "after").alias("next"))


def edited_fingerprints(docs: DataFrame, radius: int = 3) -> DataFrame:
    """Fingerprints of all texts and of their edited versions, with likenesses and near neighbours.

    The edited text has its last ``n_chars div 4`` code points replaced by the first as many (or all) of
    the next document by ``doc_id``, after the last the first. Returns ``doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next`` and ``n_near``: for ids divisible by 50, the
    number of other rows whose fingerprint is within ``radius`` bits, found through permuted block
    tables (null for other rows). Null texts are empty. A null id comes before all others; where an id is
    repeated its next document is still that of the next larger id, and the text with the least hash stands
    for an id as somebody's next. Other columns are ignored.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), key.alias("key")).repartition("key")
    quarter = F.expr("char_length(text) div 4").cast("int")
    takes = stow(docs.select(key.alias("key"), F.expr("char_length(coalesce(text, '')) div 4").alias("take")).groupBy("key").agg(F.max("take").alias("take")), "takes")
    nexts = stow(next_keys(takes).join(takes, "key"), "nexts")
    firsts = rows.groupBy("key").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    back = nexts.select(F.col("next").alias("key"), F.col("key").alias("prev"), "take")
    heads = firsts.join(back, "key").select(F.col("prev").alias("key"), F.expr("substring(text, 1, cast(take as int))").alias("head"))
    both = rows.join(heads, "key").select(
        "key",
        F.monotonically_increasing_id().alias("row"),
        "text",
        F.concat(F.expr("substring(text, 1, char_length(text) - cast(char_length(text) div 4 as int))"), F.substring("head", F.lit(1), quarter)).alias("edited"),
    )
    named = both.select(
        "key", "row", F.xxhash64("text").alias("h"), F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("t")))).alias("_t"),
    )
    by = ["key", "row", "h", "n_chars", "edited_sha256"]
    fps = fingerprint(named.select(*by, F.col("_t.v").alias("v"), F.col("_t.t").alias("t")), [*by, "v"], "t")
    pair = fps.groupBy(*by).agg(F.max(F.when(F.col("v") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("v") == 1, F.col("fp"))).alias("edited_fp"), F.lit(0).alias("_"))
    own_id = F.when(F.col("key") != F.lit(-(1 << 63)), F.col("key"))
    pair = stow(pair.drop("_").withColumn("doc_id", own_id), "fingerprints")
    heads_fp = pair.groupBy("key").agg(F.min_by("fp", "h").alias("next_fp")).withColumnRenamed("key", "next")
    asks = pair.where("doc_id % 50 = 0").select("fp")
    counts = pair.groupBy("fp").agg(F.count("*").alias("held"))
    near = within_radius(asks, pair, radius).join(counts, "fp").groupBy("q").agg(F.sum("held").alias("n")).select(F.col("q").alias("fp"), (F.col("n") - 1).alias("n_near"))
    out = pair.join(nexts.select("key", "next"), "key").join(heads_fp, "next").join(near, "fp", "left")
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(F.col("doc_id") % 50 == 0, F.col("n_near")).alias("n_near"),
    )
