"""Message log: idempotent append, room sequences, pages, audits, and the planning tables.

``messages(id, room, seq, sender, ts, kind, text, env, via, stored_at, extra)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rillwork.operators.ordered import split_row_number
from rillwork.session import attach

#: Milliseconds per bucket when numbering a room's messages.
BUCKET_MS = 3_600_000


def first_arrivals(incoming: DataFrame, key: str = "id", order: Sequence[str] = ("stored_at", "via")) -> DataFrame:
    """One row per key, the earliest; aggregated map-side so a storm of retries shrinks at once."""
    rest = [c for c in incoming.columns if c != key]
    one = F.min_by(F.struct(*rest), F.struct(*order))
    return incoming.groupBy(key).agg(one.alias("_m")).select(key, "_m.*").select(*incoming.columns)


def append(store: DataFrame | None, incoming: DataFrame, bucket_ms: int = BUCKET_MS) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)`` of a batch: an id is stored once, by its first arrival.

    Accepted rows get the next gap-free ``seq`` of their room; every other copy is rejected, and so is every
    message without an id, which no later batch could tell from a new one.
    A retried id may have any number of copies, alike or not: as many are rejected as were sent, less the
    one that is accepted.
    """
    first = first_arrivals(incoming.filter(F.col("id").isNotNull()))
    if store is not None:
        known = store.select("id")
        first = first.join(known, "id", "left_anti")
    numbered = split_row_number(first, ["room"], F.floor(F.col("stored_at") / bucket_ms), ["stored_at", "id"], "seq")
    if store is not None:
        last = store.groupBy("room").agg(F.max("seq").alias("_last"))
        numbered = attach(numbered, last, ["room"], "left").withColumn(
            "seq", F.col("seq") + F.coalesce("_last", F.lit(0))
        ).drop("_last")
    # every copy but the accepted one is audited, also where several are alike
    copy = ["id", "room", "via", "stored_at"]
    sent = incoming.groupBy(*copy).agg(F.count(F.lit(1)).alias("_n"))
    taken = first.select(*[F.col(c).alias(f"_{c}") for c in copy], F.lit(1).alias("_one"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in copy])
    extra = sent.join(taken, same, "left").withColumn("_n", F.col("_n") - F.coalesce("_one", F.lit(0))).filter("_n > 0")
    rejected = extra.select("id", "room", "via", F.col("stored_at").alias("at"), F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).drop("col")
    return numbered, rejected


def newest(messages: DataFrame, cursors: DataFrame) -> DataFrame:
    """Per cursor ``(room, since, limit)``: the newest ``limit`` messages after ``since``, ascending ``pos``.

    Sequences have no gaps, so the answer is a range of them: no window, whatever the limit.
    """
    last = messages.groupBy("room").agg(F.max("seq").alias("_last"))
    low = F.greatest(F.col("since"), F.col("_last") - F.col("limit"))
    spans = cursors.join(last, "room").select("cursor", "room", low.alias("_low"))
    rows = messages.join(spans, "room").filter(F.col("seq") > F.col("_low"))
    return rows.withColumn("pos", (F.col("seq") - F.col("_low")).cast("int")).drop("_low")


def page(messages: DataFrame, cursors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forward pages after ``since`` and, per cursor, ``next_since`` (null once a page is short).

    As in :func:`newest`, a page is the range ``since < seq <= since + limit``.
    """
    spans = cursors.select("cursor", "room", F.col("since").alias("_low"), (F.col("since") + F.col("limit")).alias("_high"))
    rows = messages.join(spans, "room").filter((F.col("seq") > F.col("_low")) & (F.col("seq") <= F.col("_high")))
    rows = rows.withColumn("pos", (F.col("seq") - F.col("_low")).cast("int")).drop("_low", "_high")
    last = messages.groupBy("room").agg(F.max("seq").alias("_last"))
    count = F.greatest(F.lit(0), F.least(F.col("limit"), F.coalesce("_last", F.lit(0)) - F.col("since"))).cast("long")
    heads = cursors.join(last, "room", "left").withColumn("count", count)
    full = F.when((F.col("count") == F.col("limit")) & (F.col("count") > 0), F.col("since") + F.col("limit"))
    return rows, heads.select("cursor", "room", "count", full.alias("next_since"))


def bounded_read(messages: DataFrame, page_max: int) -> tuple[DataFrame, DataFrame]:
    """Whole rooms in pages: every row with its ``page`` (0 is the newest), and a head per room.

    Over ``page_max`` rows the head is ``truncated``: page 0 is what one read gives, and ``since`` is the
    sequence before it. No row is left out of the pages.
    """
    sizes = messages.groupBy("room").agg(F.count(F.lit(1)).alias("total"), F.max("seq").alias("_last"))
    rows = messages.join(sizes.select("room", "_last"), "room")
    rows = rows.withColumn("page", F.floor((F.col("_last") - F.col("seq")) / page_max).cast("int")).drop("_last")
    over = F.col("total") > page_max
    heads = sizes.select(
        "room", "total", F.least(F.col("total"), F.lit(page_max)).alias("count"), over.alias("truncated"),
        F.when(over, F.col("_last") - page_max).alias("since"),
    )
    return rows, heads


def listing(rows: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """One offset page of a listing; ordered top-k, so no full sort is kept."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_total(rows: DataFrame) -> DataFrame:
    """Row count behind a listing."""
    return rows.groupBy().agg(F.count(F.lit(1)).alias("total"))


def name_search(rows: DataFrame, column: str, term: str) -> DataFrame:
    """Case-insensitive substring match."""
    safe = term.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
    return rows.filter(F.col(column).ilike(f"%{safe}%"))


def room_counts(messages: DataFrame) -> DataFrame:
    """Rows and last sequence per room."""
    return messages.groupBy("room").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("seq"), F.lit(0)).alias("last"))


def stored_twice(messages: DataFrame) -> DataFrame:
    """Ids stored more than once; empty for a sound store."""
    return messages.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def sequence_gaps(messages: DataFrame) -> DataFrame:
    """Rooms whose sequence has holes or repeats; empty for a sound store."""
    g = messages.groupBy("room").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.sum("seq").alias("s")
    )
    return g.filter((F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("s") != F.col("n") * (F.col("n") + 1) / 2))


def commit_stats(messages: DataFrame, batch: str = "batch") -> DataFrame:
    """Commits, appends, biggest batch and appends per commit."""
    b = messages.groupBy(batch).agg(F.count(F.lit(1)).alias("_n"))
    return b.groupBy().agg(
        F.count(F.lit(1)).alias("batches"), F.sum("_n").alias("appended"), F.max("_n").alias("biggest"),
        F.round(F.sum("_n") / F.count(F.lit(1)), 2).alias("appends_per_commit"),
    )


def upsert(store: DataFrame, changes: DataFrame, key: Sequence[str], version: str, keep: Sequence[str] = ()) -> DataFrame:
    """Latest row per key; columns in ``keep`` stay as first written (``ON CONFLICT … DO UPDATE``)."""
    key = list(key)
    rows = store.select(*changes.columns).unionByName(changes)
    fresh = [c for c in rows.columns if c not in key and c not in keep]
    aggs = [F.max_by(F.struct(*fresh), F.col(version)).alias("_new")]
    if keep:
        aggs.append(F.min_by(F.struct(*keep), F.col(version)).alias("_old"))
    got = rows.groupBy(*key).agg(*aggs)
    return got.select(*key, "_new.*", *(["_old.*"] if keep else [])).select(*rows.columns)


def fan_out(accepted: DataFrame, chunk: int = 1000) -> DataFrame:
    """One event per room and ``chunk`` consecutive messages, entries in order.

    A busy room gives several events, so no event grows with the batch.
    """
    e = accepted.withColumn("part", F.floor((F.col("seq") - 1) / chunk))
    return e.groupBy("room", "part").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("n"),
        F.sort_array(F.collect_list(F.struct("seq", "id", "sender", "text"))).alias("entries"),
    )


def unexpired(sessions: DataFrame, now: Column) -> DataFrame:
    """Sessions that have not run out."""
    return sessions.filter(F.col("expires") >= now)


def pending(outbox: DataFrame) -> DataFrame:
    """Unprocessed events, oldest first."""
    return outbox.filter(F.col("processed_at").isNull()).orderBy("created_at", "id")


#: Allowed moves of a recommendation, the role each needs, and role ranks.
TRANSITIONS = (
    ("draft", "submitted", "planner"),
    ("submitted", "approved", "officer"),
    ("submitted", "rejected", "officer"),
    ("rejected", "draft", "planner"),
)
ROLE_RANK = {"viewer": 0, "planner": 1, "officer": 2}


def check_transitions(moves: DataFrame) -> DataFrame:
    """Add ``legal`` and ``allowed`` to ``moves(from, to, role)``."""
    pair = F.concat_ws(">", "from", "to")
    need = F.create_map(*[x for a, b, r in TRANSITIONS for x in (F.lit(f"{a}>{b}"), F.lit(ROLE_RANK[r]))])
    rank = F.create_map(*[x for r, k in ROLE_RANK.items() for x in (F.lit(r), F.lit(k))])
    legal = F.try_element_at(need, pair).isNotNull()
    has = F.coalesce(F.try_element_at(rank, F.col("role")), F.lit(-1))
    return moves.withColumn("legal", legal).withColumn(
        "allowed", legal & (has >= F.coalesce(F.try_element_at(need, pair), F.lit(99)))
    )


def assemble_recommendations(jobs: DataFrame, villages: DataFrame, designs: DataFrame) -> DataFrame:
    """Finished jobs with their village and design, payload fields picked out."""
    done = jobs.filter(F.col("status") == "done")
    j = done.join(villages, "village_id").join(designs, "job_id")
    return j.select(
        "job_id", "village_id", "village_name", "status",
        F.col("payload.depth").alias("depth_m"), F.col("payload.cost").alias("cost"), F.col("payload.storage").alias("storage_m3"),
    )


def audit_trail(audit: DataFrame, outbox: DataFrame) -> DataFrame:
    """Per entity: audited events, and events still waiting in the outbox."""
    a = audit.groupBy("entity").agg(F.count(F.lit(1)).alias("audited"))
    p = outbox.join(audit.select("id"), "id", "left_anti").groupBy("entity").agg(F.count(F.lit(1)).alias("waiting"))
    return a.join(p, "entity", "full_outer").select(
        "entity", F.coalesce("audited", F.lit(0)).alias("audited"), F.coalesce("waiting", F.lit(0)).alias("waiting")
    )


def village_cards(villages: DataFrame, assets: DataFrame) -> DataFrame:
    """Village with its elevation quantities; the relief band is √2 of the elevation's."""
    from rillwork.functions.units import quantity

    j = villages.join(assets, "village_id")
    rel = F.col("rel_m")
    bare = F.lit(None).cast("double")

    def elev(name: str, factor: float = 1.0) -> Column:
        v = F.col(name)
        return quantity(v, "m", F.when(v != 0, 100.0 * factor * rel / v).otherwise(bare))

    return j.select(
        "village_id", "area_ha", elev("z_min").alias("minimum"), elev("z_max").alias("maximum"), elev("z_mean").alias("mean"),
        elev("relief", 2**0.5).alias("relief"), quantity(F.col("slope_deg"), "deg", 15.0).alias("mean_slope"), "source",
    )


def first_by_key(jobs: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Submitted jobs with repeated idempotency keys dropped; jobs without a key all stay."""
    keyed = first_arrivals(jobs.filter(F.col(key).isNotNull()), key, order)
    return keyed.unionByName(jobs.filter(F.col(key).isNull()))


