"""URL filters: dated list entries become validity intervals, and an as-of join judges every capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Days in a bucket of the interval join; an interval is listed once for every bucket that it touches.
SPAN_DAYS = 32
#: End of an interval that is still open.
FOREVER = "9999-12-31"


def url_host(url: Column) -> Column:
    """Host of a URL in lower case, without user, port or a closing dot; null where there is none."""
    host = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\[\]]+)", 1)
    host = F.regexp_replace(F.lower(host), r"\.+$", "")
    return F.when(host != "", host)


def suffixes(host: Column) -> Column:
    """The host and its parent domains of at least two labels (a single label: itself)."""
    parts = F.split(host, "\\.")
    n = F.size(parts)
    cut = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    return F.transform(cut, lambda i: F.array_join(F.slice(parts, i, n), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """``list, domain, valid_from, valid_to`` (end exclusive) from dated entries ``list, domain, day, action``.

    ``add`` opens an interval and ``remove`` closes it; repeated actions change nothing; of several
    actions on a day the removal counts. Entries with a null or another action are ignored.
    """
    known = entries.where(F.col("action").isin("add", "remove") & F.col("day").isNotNull() & F.col("domain").isNotNull())
    daily = known.groupBy("list", F.lower("domain").alias("domain"), "day").agg(F.max("action").alias("action"))
    w = W.partitionBy("list", "domain").orderBy("day")
    turns = daily.withColumn("was", F.lag("action").over(w)).where("was is null or was <> action")
    turns = turns.withColumn("valid_to", F.coalesce(F.lead("day").over(w), F.lit(FOREVER).cast("date")))
    return turns.where("action = 'add'").select("list", "domain", F.col("day").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``page_id, url, fetched, host, verdict, list, domain, since`` of every capture.

    ``captures`` has ``page_id, url, fetched`` (a date). Entries of the list ``block`` reject a host and
    all below it, those of ``allow`` accept it; the entry of the longest domain that is active at the
    fetch date decides, and on equal length ``allow``. Without one, or without a host or a date, the
    verdict is ``keep``. Every row gives one row; repeated rows agree. The join meets on domain and
    time bucket: an interval is listed under each bucket it touches up to the last fetch, so a busy host
    is spread over its dates and adaptive execution splits what is still large. Nulls: a null URL has no
    host; other columns are ignored.
    """
    bucket = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / SPAN_DAYS)
    rows = captures.select("page_id", "url", "fetched", url_host(F.col("url")).alias("host"))
    asked = rows.where("host is not null and fetched is not null").select("host", "fetched").distinct()
    asked = asked.withColumn("domain", F.explode(suffixes(F.col("host")))).withColumn("b", bucket(F.col("fetched")))
    last = F.lit(captures.agg(F.max("fetched").alias("last")).first()["last"]).cast("date")
    spans = intervals(entries.where(F.col("list").isin("allow", "block"))).where(F.col("valid_from") <= last)
    to = F.least(F.date_sub("valid_to", 1), last)
    spans = spans.withColumn("b", F.explode(F.sequence(bucket(F.col("valid_from")), bucket(to))))
    active = (F.col("valid_from") <= F.col("fetched")) & (F.col("fetched") < F.col("valid_to"))
    hits = asked.join(spans, ["domain", "b"]).where(active)
    rank = F.struct(F.length("domain").alias("n"), (F.col("list") == "allow").alias("a"), "list", "domain", "valid_from")
    best = hits.groupBy("host", "fetched").agg(F.max(rank).alias("hit"))
    verdict = F.when(F.col("hit.list") == "block", "drop").otherwise("keep")
    return rows.join(best, ["host", "fetched"], "left").select(
        "page_id", "url", "fetched", "host", verdict.alias("verdict"), F.col("hit.list").alias("list"), F.col("hit.domain").alias("domain"), F.col("hit.valid_from").alias("since")
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures of the page table, which has no dates: a date of 2023 or 2024 from a hash of the id."""
    day = F.conv(F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), 1, 7), 16, 10).cast("int") % 731
    return pages.select("page_id", "url", F.date_add(F.lit("2023-01-01").cast("date"), day.cast("int")).alias("fetched"))


def lists_of(pages: DataFrame) -> DataFrame:
    """Dated entries derived from the hosts that occur: a third of the hosts is blocked for a while, some
    parent domains are blocked and some hosts allowed, with dates from a hash of the name."""
    hosts = pages.select(url_host(F.col("url")).alias("host")).where("host is not null").distinct()
    names = hosts.select(F.explode(suffixes(F.col("host"))).alias("domain")).distinct()
    part = lambda at, mod: F.conv(F.substring(F.md5("domain"), at, 7), 16, 10).cast("int") % mod
    day = lambda n: F.date_add(F.lit("2023-01-01").cast("date"), n.cast("int"))
    kinds = F.when(part(1, 6) < 2, "block").when(part(1, 6) == 2, "allow")
    listed = names.select("domain", kinds.alias("list"), part(8, 500).alias("a"), (1 + part(15, 400)).alias("b")).where("list is not null")
    turns = F.explode(F.array(
        F.struct(day(F.col("a")).alias("day"), F.lit("add").alias("action")),
        F.struct(day(F.col("a") + F.col("b")).alias("day"), F.lit("remove").alias("action")),
        F.struct(day(F.col("a") + 2 * F.col("b")).alias("day"), F.lit("add").alias("action")),
    )).alias("t")
    return listed.select("list", "domain", turns).select("list", "domain", "t.day", "t.action")
