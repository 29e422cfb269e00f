"""N-gram Jaccard self-join with several global token orders, and the groups its links make.

Two texts are linked when the Jaccard similarity of their word-shingle sets is at least ``near``.
Candidates have to pass prefix filters under several global orders:

1. *Hash order.* Of each set only the ``KEEP`` share with the smallest hashes is indexed. If two sets
   are similar enough, those two samples share at least ``(KEEP - (1 - near)) * n`` tokens, ``n`` being
   the size of either set (whichever sample ends first lies wholly inside the other's range).
2. *Rare first.* Inside the samples tokens are ordered by the number of sets that hold them, so the
   needed overlap makes the first ``sample - needed + 1`` tokens a prefix that similar sets must share.
   Tokens of one set fill the prefix of a text that is like no other, and index nothing. For two given
   sizes more overlap is needed than for a size alone, so a pair also has to meet at a place early
   enough for both sizes.

3. *Rare first on whole sets*, among the sets that are still open after the pivots (below): the same
   filter without the loss that sampling brings.

A pair is verified only if the filters hold together. Verification is exact on the whole sets.

Equal sets become one class first, and large groups of near copies are not expanded into pairs: every
set is compared with the pivot it shares most tokens with. Sets that are still apart get a *home*, the set
whose tokens are commonest among those they may meet, and are compared with it. Two sets ``x``, ``y`` of
one home ``h`` share at most ``min(|x & h|, |y & h|)`` tokens inside it, so a pair with too few of them must
share the rest outside: such pairs meet at tokens that their home lacks, which few copies hold, and not at
those it has. No link between two components is lost, since each pair that the filters let through is
either verified, already joined or ruled out by these counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rillwork.llm.common import NEAR, WIDTH, components, fresh, own, row_key, set_key, shingle_sets, stow
from rillwork.session import cut

#: Share of each set that is indexed, in twentieths; must exceed the share a similar set may lack.
KEEP_20 = 8
#: Counts of a token are exact up to here; commoner tokens all rank last, in the order of their hashes.
COUNT_TOP = 4096
#: Sets of a token among which each of its sets finds the one that it is compared with first.
PIVOTS = 4

_POSTING = pa.schema([("tok", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("doc", pa.int64()), ("own", pa.bool_())])
_SHARED = pa.schema([("tok", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("c", pa.int32()), ("doc", pa.int64()), ("own", pa.bool_())])
_SIGNED = "tok long, cls long, n int, doc long, own boolean"


def _emit(toks, keys, sizes, docs, own) -> pa.RecordBatch:
    return pa.record_batch(
        [
            pa.array(np.concatenate(toks).view(np.int64) if toks else [], pa.int64()),
            pa.array(np.concatenate(keys).view(np.int64) if keys else [], pa.int64()),
            pa.array(np.concatenate(sizes) if sizes else [], pa.int32()),
            pa.array(docs, pa.int64()),
            pa.array(own, pa.bool_()),
        ],
        schema=_POSTING,
    )


def _postings(width: int):
    """Per text one row of its own (``own``: document, class, size); per class and task its indexed tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        done = 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            toks, keys, sizes, held = [], [], [], 0
            mine: list[tuple[int, np.uint64, int]] = []
            for row, tokens in shingle_sets(batch.column(1), width):
                key, n = set_key(tokens), len(tokens)
                mine.append((ids[row], key, n))
                if n and int(key) not in seen:
                    seen.add(int(key))
                    kept = tokens[: (KEEP_20 * n + 19) // 20]
                    toks.append(kept)
                    keys.append(np.full(len(kept), key))
                    sizes.append(np.full(len(kept), n, np.int32))
                    held += len(kept)
                if held > 200_000:
                    yield _emit(toks, keys, sizes, [None] * held, [False] * held)
                    toks, keys, sizes, held = [], [], [], 0
            if held:
                yield _emit(toks, keys, sizes, [None] * held, [False] * held)
            if mine:
                spread = np.arange(done, done + len(mine), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                done += len(mine)
                key = np.array([m[1] for m in mine], np.uint64)
                size = np.array([m[2] for m in mine], np.int32)
                yield _emit([spread ^ key], [key], [size], [m[0] for m in mine], [True] * len(mine))

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings sorted by token and class, those of tokens that several classes hold, with their number.

    Works through a run of any length with at most ``COUNT_TOP`` rows in memory besides the batch.
    """

    def out(t, k, n, c):
        none = np.zeros(len(t), bool)
        return pa.record_batch([pa.array(t), pa.array(k), pa.array(n), pa.array(c.astype(np.int32)), pa.nulls(len(t), pa.int64()), pa.array(none)], schema=_SHARED)

    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
    rest, common, last = empty, None, None
    for batch in batches:
        own = batch.column(4).to_numpy(zero_copy_only=False)
        if own.any():
            part = batch.filter(pa.array(own))
            c = pa.array(np.zeros(part.num_rows, np.int32))
            yield pa.record_batch([part.column(0), part.column(1), part.column(2), c, part.column(3), part.column(4)], schema=_SHARED)
        new = [batch.column(i).to_numpy()[~own] for i in range(3)]
        t, k, n = (np.concatenate([a, b]) for a, b in zip(rest, new))
        if not len(t):
            continue
        fresh = np.ones(len(t), bool)
        fresh[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
        if last is not None and not len(rest[0]):
            fresh[0] = (t[0], k[0]) != last
        last = (t[-1], k[-1])
        t, k, n = t[fresh], k[fresh], n[fresh]
        if common is not None:  # rows that go on with a token already known to be common
            more = int(np.searchsorted(t != common, True)) if len(t) and t[0] == common else 0
            if more:
                yield out(t[:more], k[:more], n[:more], np.full(more, COUNT_TOP))
            if more < len(t):
                common = None
            t, k, n = t[more:], k[more:], n[more:]
        if not len(t):
            rest = empty
            continue
        begin = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        length = np.diff(np.concatenate([begin, [len(t)]]))
        if length[-1] >= COUNT_TOP:
            common, held = t[-1], len(t)
        else:
            held = int(begin[-1])
        count = np.repeat(np.minimum(length, COUNT_TOP), length)[:held]
        keep = count > 1
        if keep.any():
            yield out(t[:held][keep], k[:held][keep], n[:held][keep], count[keep])
        rest = (t[held:], k[held:], n[held:])
    if len(rest[0]) > 1:
        yield out(*rest, np.full(len(rest[0]), len(rest[0])))


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = [], []
            for _, tokens in shingle_sets(batch.column(0), width):
                keys.append(set_key(tokens))
                lists.append(tokens.view(np.int64))
                if len(keys) >= 512:
                    yield pa.record_batch([pa.array(np.array(keys).view(np.int64)), pa.array(lists, pa.list_(pa.int64()))], names=["cls", "toks"])
                    keys, lists = [], []
            if keys:
                yield pa.record_batch([pa.array(np.array(keys).view(np.int64)), pa.array(lists, pa.list_(pa.int64()))], names=["cls", "toks"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, near_100: int) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    a, b = sets.toDF("a", "ta"), sets.toDF("b", "tb")
    both = F.size(F.array_intersect("ta", "tb"))
    return (
        pairs.join(a, "a")
        .join(b, "b")
        .where(100 * both >= near_100 * (F.size("ta") + F.size("tb") - both))
        .select("a", "b")
    )


def _overlap(x: str, y: str, near_100: int) -> str:
    """Tokens that sets of two sizes must share to be similar enough."""
    return f"(({near_100} * ({x} + {y}) + {99 + near_100}) div {100 + near_100})"


def _at_home(late: DataFrame, open_: DataFrame, sets: DataFrame, near_100: int) -> DataFrame:
    """``cls, home, n, root, within, rest, linked, label`` of the sets that share a token of ``late`` with another component.

    ``within`` counts the tokens that home has too, ``rest`` lists the others; equal ``label``, same component.
    """
    roots = [F.min("root").alias("r0"), F.max("root").alias("r1")]
    top = late.groupBy("tok").agg(F.max_by("cls", F.struct("usual", "cls")).alias("home"), F.count("*").alias("held"), *roots)
    votes = late.join(top.where("r0 <> r1").select("tok", "home", "held"), "tok").groupBy("cls", "home").agg(F.sum("held").alias("votes"))
    homes = votes.groupBy("cls").agg(F.max_by("home", F.struct("votes", "home")).alias("home"))
    placed = open_.select("cls", "n", "root")
    met = homes.join(placed.join(sets, "cls"), "cls").join(placed.join(sets, "cls").toDF("home", "home_n", "home_root", "theirs"), "home")
    met = met.withColumn("within", F.size(F.array_intersect("toks", "theirs")))
    met = met.withColumn("linked", F.expr(f"100 * within >= {near_100} * (n + home_n - within)"))
    label = F.when(F.col("linked"), F.col("home_root")).otherwise(F.col("root")).alias("label")
    return met.select("cls", "home", "n", "root", "within", F.array_except("toks", "theirs").alias("rest"), "linked", label)


def _apart(late: DataFrame, known: DataFrame, near_100: int, meets: F.Column) -> DataFrame:
    """``a, b``: the pairs from different components that may be similar enough for all that is known of their homes."""
    either = [F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")]
    need = _overlap("x.n", "y.n", near_100)
    others = F.col("x.label") != F.col("y.label")
    rows = late.select("tok", "cls", "n", "place").join(known.select("cls", "home", "label", "within", "linked"), "cls")

    # of different homes: each token's sets against those that are not of its commonest home
    per_home = rows.groupBy("tok", "home").agg(F.count("*").alias("held"))
    mixed = per_home.groupBy("tok").agg(F.max_by("home", F.struct("held", "home")).alias("usual_home"), F.count("*").alias("homes")).where("homes > 1")
    mixed = rows.join(mixed, "tok")
    few, all_ = mixed.where("home <> usual_home").alias("x"), mixed.alias("y")
    found = few.join(all_, (F.col("x.tok") == F.col("y.tok")) & (F.col("x.home") != F.col("y.home")) & others & meets).select(*either)

    # of one home, and so much alike inside it that nothing else is needed: one of the two is not linked with it,
    # and the other is smaller than home. `reach` is the largest set that the tokens inside are enough for
    kin = known.where("cls <> home").withColumn("reach", F.expr(f"{100 + near_100} * within div {near_100} - n"))
    sizes = [F.min("n").alias("least"), F.max(F.when(~F.col("linked"), F.col("reach"))).alias("most")]
    kin = kin.join(kin.groupBy("home").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), *sizes).where("l0 <> l1"), "home")
    inside = late.select("tok", "cls", "place").join(kin.drop("rest"), "cls")
    loose, all_ = inside.where("not linked and reach >= least").alias("x"), inside.where("n <= most").alias("y")
    alike = F.expr("x.home = y.home and x.tok = y.tok and x.reach >= y.n and y.reach >= x.n")
    found = found.union(loose.join(all_, alike & others & meets).select(*either))

    # of one home, and alike outside it: by all tokens that home lacks, so that the shared ones can be counted
    outside = kin.select("home", "cls", "n", "label", "within", "reach", "least", F.explode("rest").alias("tok"))
    split = outside.groupBy("home", "tok").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("home", "tok")
    outside = outside.join(split, ["home", "tok"])
    enough = outside.groupBy("cls", "n", "within", "least").agg(F.count("*").alias("most"))
    enough = enough.where(f"within + most >= {_overlap('n', 'least', near_100)}").select("cls")
    outside = stow(outside.drop("reach", "least").join(enough, "cls"), "outside")
    x, y = outside.alias("x"), outside.alias("y")
    met = x.join(y, F.expr("x.home = y.home and x.tok = y.tok and x.cls < y.cls") & others)
    met = met.groupBy(*either).agg(F.count("*").alias("both"), F.first(F.least("x.within", "y.within")).alias("most"), F.first(F.expr(need)).alias("need"))
    return found.union(met.where("most + both >= need").select("a", "b")).distinct()


def link_groups(docs: DataFrame, width: int = WIDTH, near: float = NEAR) -> DataFrame:
    """``doc_id, n_shingles, component_id, is_first`` of every row of ``docs`` (``doc_id``, ``text``).

    ``component_id`` is the smallest ``doc_id`` that links lead to; ``is_first`` marks one row of each
    group, the one with that id. Null or empty texts have no shingles and are linked with nothing. A
    null ``doc_id`` keeps its row; its component is the smallest id that is not null, or null. Repeated
    rows are rows of their own and link like other copies (``is_first`` is true for each row with the
    id of its group). Other columns are ignored. An empty table gives an empty result.

    Classes are keyed by 64 bits of their set. ``near`` is taken in hundredths.
    """
    near_100 = round(100 * near)
    if not 100 - 5 * KEEP_20 < near_100 <= 100:
        raise ValueError(f"near must lie above {1 - KEEP_20 / 20} and not above 1")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.mapInArrow(_postings(width), _SIGNED).repartition("tok").sortWithinPartitions("tok", "cls")
    index = stow(rows.mapInArrow(_shared, "tok long, cls long, n int, c int, doc long, own boolean"), "postings")
    members = index.where("own").select(F.col("doc").alias("doc_id"), "cls", "n")
    reps = members.groupBy("cls").agg(F.min("doc_id").alias("rep"))

    # rare-first prefixes inside the samples: tokens of one class come first and index nothing
    per = W.partitionBy("cls")
    need = F.greatest(F.lit(1), F.ceil(F.expr(f"({5 * KEEP_20} - {100 - near_100}) * n / 100D")))
    sample = F.floor((KEEP_20 * F.col("n") + 19) / 20).cast("int")
    ranked = (
        index.where("not own")
        .withColumn("alone", sample - F.count("*").over(per))
        .withColumn("usual", F.sum(F.log2("c")).over(per) / F.col("n"))
        .where(F.col("alone") <= sample - need)
        .withColumn("place", F.col("alone") + F.row_number().over(per.orderBy("c", "tok")))
        .where(F.col("place") <= sample - need + 1)
    )
    lists = stow(ranked.select("tok", "cls", "n", "c", F.col("place").cast("int").alias("place"), "usual"), "prefixes")

    def meets(x: str, y: str, keep: int) -> F.Column:
        """Whether two sets that share a token at their places may still be similar enough."""
        overlap = _overlap(f"{x}n", f"{y}n", near_100)
        outside = f"greatest({x}n * {20 - keep} div 20, {y}n * {20 - keep} div 20)"
        late = " and ".join(f"{k}place <= ({keep} * {k}n + 19) div 20 - ({overlap} - {outside}) + 1" for k in (x, y))
        return F.expr(f"100 * least({x}n, {y}n) >= {near_100} * greatest({x}n, {y}n) and {late}")

    # each token's pivots: the class with the commonest tokens, and some at random. Rare tokens of near copies
    # have pivots of their own, so a class meets only the one it shares most tokens with
    who = F.struct("cls", "n", "place")
    picks = [F.max_by(who, F.struct("usual", "cls")), *[F.min_by(who, F.xxhash64("cls", F.lit(k))) for k in range(PIVOTS - 1)]]
    pivots = lists.groupBy("tok").agg(F.array_distinct(F.array(*picks)).alias("pivots"), F.count("*").alias("held")).where("held > 1")
    to_pivots = lists.join(pivots.select("tok", F.explode("pivots").alias("pivot")), "tok")
    to_pivots = to_pivots.where((F.col("cls") != F.col("pivot.cls")) & meets("", "pivot.", KEEP_20))
    common = to_pivots.groupBy("cls", F.col("pivot.cls").alias("pivot")).agg(F.count("*").alias("common"))
    best = common.groupBy("cls").agg(F.max_by("pivot", F.struct("common", "pivot")).alias("pivot"))
    stars = cut(best.select(F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b")).distinct())
    shared = lists.join(lists.groupBy("tok").agg(F.count("*").alias("held")).where("held > 1"), "tok", "left_semi")
    wanted = shared.select("cls").distinct().join(reps, "cls")
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    chosen = texts.withColumn("key", key).join(wanted.select(F.coalesce("rep", F.lit(-(1 << 63))).alias("key")).distinct(), "key", "left_semi")
    found = chosen.select("text").mapInArrow(_sets(width), "cls long, toks array<long>")
    sets = stow(found.join(wanted.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]), "sets")
    links = cut(_verified(stars, sets, near_100))

    # what is left: pairs of a token whose classes are still in different components. Their whole sets
    # are ordered by how many of these classes hold a token, so one more prefix must be shared
    found = components(links).withColumnRenamed("node", "cls")
    placed = shared.join(found, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    torn = placed.groupBy("tok").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    open_ = stow(placed.join(torn.select("tok"), "tok", "left_semi").groupBy("cls", "n", "root").agg(F.collect_list("tok").alias("pre")), "open")
    tokens = open_.join(sets, "cls").select("cls", "n", "root", F.explode("toks").alias("tok"))
    several = tokens.groupBy("tok").agg(F.count("*").alias("c"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("c > 1")
    ordered = (
        tokens.join(several, "tok")
        .withColumn("alone", F.col("n") - F.count("*").over(per))
        .withColumn("usual", F.sum(F.log2("c")).over(per))
        .withColumn("place", F.col("alone") + F.row_number().over(per.orderBy("c", "tok")))
        .where((F.col("r0") != F.col("r1")) & (100 * (F.col("n") - F.col("place") + 1) >= near_100 * F.col("n")))
    )
    late = stow(ordered.select("tok", "cls", "n", "root", F.col("place").cast("int").alias("place"), "usual"), "late")
    known = stow(_at_home(late, open_, sets, near_100), "homes")
    home = known.where("cls <> home").select(F.least("cls", "home").alias("a"), F.greatest("cls", "home").alias("b"), "linked")
    more = _apart(late, known, near_100, meets("x.", "y.", 20))
    pre = open_.select("cls", "pre")
    more = more.join(pre.toDF("a", "pa"), "a").join(pre.toDF("b", "pb"), "b").where(F.arrays_overlap("pa", "pb")).select("a", "b")
    met = stars.union(home.select("a", "b"))
    more = _verified(cut(more.join(met, ["a", "b"], "left_anti")), sets, near_100)
    last = components(links.union(home.where("linked").select("a", "b")).union(more))

    classed = members.join(last.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    firsts = reps.join(last.withColumnRenamed("node", "cls"), "cls", "left").groupBy(F.coalesce("root", "cls").alias("root")).agg(F.min("rep").alias("first"))
    # an empty set is a class for the index only: its texts stay alone
    group = F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("doc_id"))
    return classed.join(firsts, "root").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        group.alias("component_id"),
        F.coalesce(F.col("doc_id") == group, F.isnull("doc_id") & F.isnull(group)).alias("is_first"),
    )


def keep_first(docs: DataFrame, width: int = WIDTH, near: float = NEAR, by_row: bool = False) -> DataFrame:
    """``docs`` with one document of each group of :func:`link_groups`: the one with the smallest id.

    Rows with a null id, and with texts without words, stay; so do all rows that repeat the id kept.
    With ``by_row`` no id is special: rows are told apart by id and text, one row of each group stays (null
    ids come last), and one of those that repeat both.
    """
    if by_row:
        key, at = fresh(docs, "_key", "_at")
        keyed = docs.withColumn(key, row_key())
        rows = keyed.select(F.col(key).alias("row"), "doc_id", "text")
        placed = link_groups(rows.select(F.col("row").alias("doc_id"), "text"), width, near).select(F.col("doc_id").alias("row"), "component_id")
        placed = placed.distinct().join(rows.select("row", "doc_id").distinct(), "row")
        first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row")).alias("first")
        kept = placed.groupBy("component_id").agg(first).select(F.col("first.row").alias(key)).distinct()
        alike = W.partitionBy(key).orderBy(F.xxhash64(*own(docs)))
        return keyed.join(kept, key, "left_semi").withColumn(at, F.row_number().over(alike)).where(F.col(at) == 1).select(*own(docs))
    groups = link_groups(docs, width, near)
    gone = groups.where("doc_id is not null and not is_first").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
