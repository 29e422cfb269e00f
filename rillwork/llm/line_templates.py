"""Line dedup by a log-template tree: fixed-depth leaves, generalised lines, recurring templates dropped.

The tree has a fixed depth: a line goes to the leaf of its word count and its first ``LEAD`` words, with
every word that holds a digit generalised to ``<*>``. Inside a leaf, a word stays part of the template at
its place only if enough lines of the leaf have it there; other places become variable. All of this is
grouping and joining of hashes; the words themselves are only read for leaves that hold several forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import fresh, own, stow, words

#: Leading words that choose a leaf below the word count.
LEAD = 3
#: Least number of documents that make a template recurring, and of words that make a line a candidate.
MIN_DOCS, MIN_WORDS = 3, 5
#: Least share of fixed words in a template that generalises several forms.
FIXED = 0.5

_NUMBERED = r"[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*"


def general(line: Column) -> Column:
    """A line with every word that holds a digit replaced by ``<*>``."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, _NUMBERED, "<*>")).otherwise(line)


def form(line: Column) -> Column:
    """Hash of a line's words after generalising: lines of one form differ in numbers and spaces only."""
    return F.xxhash64(F.array_join(words(general(line)), " "))


def _lines(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per line of at least ``MIN_WORDS`` words: kept columns, words, leaf and form."""
    listed = F.transform(F.split("text", "\n"), lambda line: words(general(line)))
    # a filter on the words would be pushed below and split each line twice, and so would one that explode implies
    split = docs.select(*keep, F.explode_outer(F.filter(listed, lambda w: F.size(w) >= MIN_WORDS)).alias("w")).where("w is not null")
    lead = [F.expr(f"get(w, {i})") for i in range(LEAD)]
    return split.select(*keep, "w", F.xxhash64(F.size("w"), *lead).alias("leaf"), F.xxhash64(F.array_join("w", " ")).alias("form"))


def dedupe_lines(docs: DataFrame, min_docs: int = MIN_DOCS, fixed: float = FIXED) -> DataFrame:
    """``docs`` with recurring template lines dropped, plus ``n_lines`` and ``n_dropped``.

    A template recurs if lines of at least ``min_docs`` different documents have it. The document with
    the smallest id keeps its lines; all others lose theirs, so that no content leaves the corpus for
    good. A document is an id and a text, keyed by 64 bits of both: rows that repeat both count once and are treated alike; null
    ids come last. Lines of fewer than ``MIN_WORDS`` words always stay. A null text stays null with no
    lines; an empty one has one, empty line. Other columns pass through, whatever their names, but for
    ``n_lines`` and ``n_dropped``, which are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")  # of an earlier pass
    key, dropped, stay = fresh(docs, "_key", "_drops", "_stay")
    slim = docs.select("doc_id", "text").select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    narrow = stow(_lines(slim, "doc_id", "key").select("doc_id", "key", "leaf", "form").distinct(), "lines")
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "key"))
    forms = narrow.groupBy("leaf", "form").agg(F.count("*").alias("m"), first.alias("first"))
    leaves = forms.groupBy("leaf").agg(F.sum("m").alias("held"), F.count("*").alias("n_forms"))
    live = stow(forms.join(leaves.where(F.col("held") >= min_docs), "leaf"), "leaves")

    # leaves with several forms: read the words of one line of each form, find the fixed places
    mixed = live.where("n_forms > 1")
    wanted = mixed.select("first.doc_id", "first.key", "leaf", "form", "m")
    asked = wanted.groupBy("key").agg(F.collect_list("form").alias("asked"))
    # dealt by key on purpose: the join and nothing else then moves the texts, at any size
    read = slim.repartition("key").join(asked, "key").select("text", "asked")
    told = _lines(read, "asked").where(F.array_contains("asked", F.col("form"))).select("leaf", "form", "w").dropDuplicates(["leaf", "form"])
    placed = told.join(mixed.select("leaf", "form", "m"), ["leaf", "form"]).select("leaf", "form", "m", F.posexplode("w").alias("at", "word"))
    placed = stow(placed.select("leaf", "form", "m", "at", F.xxhash64("word").alias("word")), "words")
    common = placed.groupBy("leaf", "at", "word").agg(F.sum("m").alias("c")).where(F.col("c") >= min_docs).drop("c")
    kept = common.withColumn("is_fixed", F.lit(True))
    marks = placed.join(kept, ["leaf", "at", "word"], "left").groupBy("leaf", "form").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_fixed"), F.struct("at", "word")))).alias("fixed"), F.count("*").alias("n")
    )
    template = F.when(F.size("fixed") >= fixed * F.col("n"), F.xxhash64("fixed")).otherwise(F.col("form"))
    assigned = live.where("n_forms = 1").select("leaf", "form", F.col("form").alias("template"))
    assigned = assigned.unionByName(marks.select("leaf", "form", template.alias("template")))

    lines = stow(narrow.join(assigned, ["leaf", "form"]), "templates")
    owners = lines.select("leaf", "template", "doc_id", "key").distinct()
    recurring = owners.groupBy("leaf", "template").agg(F.count("*").alias("held"), first.alias("first")).where(F.col("held") >= min_docs)
    gone = lines.join(recurring, ["leaf", "template"]).where(~(F.col("first.key").eqNullSafe(F.col("key")) & F.col("first.doc_id").eqNullSafe(F.col("doc_id"))))
    drops = gone.groupBy(F.col("key").alias(key)).agg(F.collect_set("form").alias(dropped))

    joined = docs.withColumn(key, F.xxhash64("doc_id", "text")).repartition(key).join(drops, key, "left")
    lines_of = F.split("text", "\n")
    left = F.filter(lines_of, lambda line: ~F.array_contains(dropped, form(line)))
    joined = joined.withColumn(stay, F.when(F.isnotnull(dropped), left))
    out = joined.withColumn("n_lines", F.coalesce(F.size(lines_of), F.lit(0)).cast("long"))
    out = out.withColumn("n_lines", F.when(F.isnull("text"), 0).otherwise(F.col("n_lines")).cast("long"))
    out = out.withColumn("n_dropped", F.when(F.isnotnull(stay), F.col("n_lines") - F.size(stay)).otherwise(0).cast("long"))
    out = out.withColumn("text", F.when(F.isnotnull(stay), F.array_join(stay, "\n")).otherwise(F.col("text")))
    return out.select(*own(docs), "n_lines", "n_dropped")
