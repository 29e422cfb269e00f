"""Message log over ``conversations`` and ``events``, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwork.catalog.base import micros, query, table
from rillwork.functions import text as X
from rillwork.functions import units as U
from rillwork.operators import messages as M
from rillwork.session import cut


def incoming(spark, d):
    """Every turn is sent once, the assistant's again half a second later, some twice more and alike."""
    c = table(spark, d, "conversations")
    at = F.col("conv_id") * 60_000 + F.col("turn") * 1000

    def send(df, late, via):
        return df.select(
            F.concat(F.lit("msg-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
            F.concat(F.lit("room"), (F.col("conv_id") % 9).cast("string")).alias("room"),
            F.col("role").alias("sender"), at.alias("ts"), F.lit("plain").alias("kind"), "text",
            F.lit(via).alias("via"), (at + late).alias("stored_at"),
        )

    late = send(c.filter("role = 'assistant'"), 500, "sys3")
    alike = send(c.filter("turn % 4 = 2"), 700, "sys3")
    return send(c, 0, "sys2").unionByName(late).unionByName(alike).unionByName(alike)


INC = """c AS (SELECT 'msg-'||conv_id||'-'||turn AS id, 'room'||(conv_id%9) AS room, role AS sender, conv_id*60000+turn*1000 AS ts, 'plain' AS kind, text FROM conversations),
    inc AS (SELECT *, 'sys2' AS via, ts AS stored_at FROM c UNION ALL SELECT *, 'sys3', ts+500 FROM c WHERE sender='assistant'
      UNION ALL SELECT c.*, 'sys3', ts+700 FROM c, (VALUES (1),(2)) v(k) WHERE split_part(id,'-',3)::INTEGER%4=2),
    rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY stored_at, via) AS k FROM inc),
    st AS (SELECT id, room, sender, ts, kind, text, via, stored_at, row_number() OVER (PARTITION BY room ORDER BY stored_at, id) AS seq FROM rk WHERE k=1)"""


def store(spark, d):
    return M.append(None, incoming(spark, d))[0]


@query("idempotent_append", f"WITH {INC} SELECT * FROM st")
def idempotent_append(spark, d):
    return store(spark, d)


@query("rejected_copies", f"WITH {INC} SELECT id, room, via, stored_at AS at FROM rk WHERE k>1")
def rejected_copies(spark, d):
    return M.append(None, incoming(spark, d))[1]


@query("append_onto_store", f"WITH {INC} SELECT * FROM st")
def append_onto_store(spark, d):
    """A second batch after the first: the same sequence as one append of everything."""
    every = incoming(spark, d)
    mid = table(spark, d, "conversations").agg(F.max("conv_id")).first()[0] // 2
    one = cut(M.append(None, every.filter(F.col("ts") < mid * 60_000))[0])
    two, _ = M.append(one, every)
    return one.unionByName(two)


def _cursors(messages, limit=5):
    return messages.groupBy("room").agg((F.max("seq") / 2).cast("long").alias("since")).select(
        F.concat(F.lit("c-"), "room").alias("cursor"), "room", "since", F.lit(limit).alias("limit")
    )


_CUR = "cu AS (SELECT 'c-'||room AS cursor, room, max(seq)//2 AS since, 5 AS lim FROM st GROUP BY room)"


@query(
    "newest_messages",
    f"""WITH {INC}, {_CUR}, r AS (SELECT cursor, st.id, st.seq, row_number() OVER (PARTITION BY cursor ORDER BY seq DESC) AS b FROM st JOIN cu USING (room) WHERE seq>since)
    SELECT cursor, id, seq, CAST(row_number() OVER (PARTITION BY cursor ORDER BY seq) AS INTEGER) AS pos FROM r WHERE b<=5""",
)
def newest_messages(spark, d):
    m = store(spark, d)
    return M.newest(m, _cursors(m)).select("cursor", "id", "seq", "pos")


_PAGE = f"WITH {INC}, {_CUR}, r AS (SELECT cursor, st.id, st.seq, CAST(row_number() OVER (PARTITION BY cursor ORDER BY seq) AS INTEGER) AS pos FROM st JOIN cu USING (room) WHERE seq>since)"


@query("forward_page", f"{_PAGE} SELECT cursor, id, seq, pos FROM r WHERE pos<=5")
def forward_page(spark, d):
    m = store(spark, d)
    return M.page(m, _cursors(m))[0].select("cursor", "id", "seq", "pos")


@query(
    "forward_page_heads",
    f"{_PAGE} SELECT cu.cursor, cu.room, count(r.id) AS count, CASE WHEN count(r.id)=5 THEN max(r.seq) END AS next_since FROM cu LEFT JOIN r ON r.cursor=cu.cursor AND pos<=5 GROUP BY 1,2",
)
def forward_page_heads(spark, d):
    m = store(spark, d)
    return M.page(m, _cursors(m))[1]


@query(
    "bounded_room_read",
    f"""WITH {INC}, n AS (SELECT room, count(*) AS total FROM st GROUP BY 1)
    SELECT room, total, least(total,60) AS count, total>60 AS truncated, CASE WHEN total>60 THEN total-60 END AS since FROM n""",
)
def bounded_room_read(spark, d):
    return M.bounded_read(store(spark, d), 60)[1]


@query("bounded_room_pages", f"WITH {INC} SELECT room, id, seq, CAST((max(seq) OVER (PARTITION BY room)-seq)//60 AS INTEGER) AS page FROM st")
def bounded_room_pages(spark, d):
    return M.bounded_read(store(spark, d), 60)[0].select("room", "id", "seq", "page")


@query("room_counts", f"WITH {INC} SELECT room, count(*) AS n, max(seq) AS last FROM st GROUP BY 1")
def room_counts(spark, d):
    return M.room_counts(store(spark, d))


@query("duplicate_audit", f"WITH {INC} SELECT id, count(*) AS n FROM inc GROUP BY 1 HAVING count(*)>1")
def duplicate_audit(spark, d):
    return M.stored_twice(incoming(spark, d))


@query("sequence_gaps", f"WITH {INC} SELECT room, count(*) AS n, min(seq) AS lo, max(seq) AS hi, CAST(sum(seq) AS BIGINT) AS s FROM st WHERE seq%7<>3 GROUP BY 1 HAVING min(seq)<>1 OR max(seq)<>count(*)")
def sequence_gaps(spark, d):
    """A broken store: every seventh message of a room is gone."""
    return M.sequence_gaps(store(spark, d).filter("seq % 7 <> 3"))


@query(
    "commit_batches",
    f"""WITH {INC}, b AS (SELECT stored_at//3600000 AS batch, count(*) AS n FROM st GROUP BY 1)
    SELECT count(*) AS batches, CAST(sum(n) AS BIGINT) AS appended, max(n) AS biggest, round(sum(n)::DOUBLE/count(*),2) AS appends_per_commit FROM b""",
)
def commit_batches(spark, d):
    return M.commit_stats(store(spark, d).withColumn("batch", F.floor(F.col("stored_at") / 3_600_000)))


@query(
    "fan_out_events",
    f"""WITH {INC} SELECT room, (seq-1)//50 AS part, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n, string_agg(id, ',' ORDER BY seq) AS ids FROM st GROUP BY 1,2""",
)
def fan_out_events(spark, d):
    e = M.fan_out(store(spark, d), 50)
    return e.withColumn("ids", F.concat_ws(",", F.col("entries.id"))).drop("entries")


@query(
    "recent_rejections",
    f"WITH {INC} SELECT id, room, via, stored_at AS at FROM rk WHERE k>1 ORDER BY stored_at DESC, id LIMIT 20",
)
def recent_rejections(spark, d):
    return M.listing(rejected_copies(spark, d), [F.col("at").desc(), F.col("id")], 0, 20)


@query("offset_page", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50")
def offset_page(spark, d):
    order = [F.col("c_acctbal").desc(), F.col("c_custkey")]
    return M.listing(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), order, 50, 25).drop("c_acctbal")


@query("page_total", "SELECT count(*) AS total FROM customer WHERE c_name ILIKE '%mer#00000001%'")
def page_total(spark, d):
    return M.page_total(M.name_search(table(spark, d, "customer"), "c_name", "MER#00000001"))


@query("name_search", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%ring%'")
def name_search(spark, d):
    return M.name_search(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "RING")


@query(
    "upsert_users",
    """SELECT o_custkey AS username, max_by(o_orderstatus,o_orderkey) AS display, max(o_orderkey) AS version, min_by(o_orderdate,o_orderkey) AS created FROM orders GROUP BY 1""",
)
def upsert_users(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("username"), F.col("o_orderstatus").alias("display"), F.col("o_orderkey").alias("version"),
        F.col("o_orderdate").alias("created"),
    )
    return M.upsert(o.filter("display = 'F'"), o.filter("display <> 'F'"), ["username"], "version", keep=["created"])


@query(
    "idempotent_jobs",
    """WITH j AS (SELECT event_id AS job, CASE WHEN event_type<>'view' THEN user_id||':'||event_type END AS idem, epoch_us(ts) AS t_at FROM events)
    SELECT job, idem, t_at AS "at" FROM (SELECT *, row_number() OVER (PARTITION BY idem ORDER BY t_at, job) AS k FROM j) WHERE idem IS NULL OR k=1""",
)
def idempotent_jobs(spark, d):
    key = F.when(F.col("event_type") != "view", F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type"))
    j = table(spark, d, "events").select(F.col("event_id").alias("job"), key.alias("idem"), micros(F.col("ts")).alias("at"))
    return M.first_by_key(j, "idem", ["at", "job"])


@query(
    "accepted_ids",
    "SELECT DISTINCT user_id, event_type FROM events WHERE event_type<>'error'",
)
def accepted_ids(spark, d):
    return table(spark, d, "events").filter("event_type <> 'error'").select("user_id", "event_type").distinct()


@query(
    "live_sessions",
    "SELECT user_id, max(epoch_us(ts)) AS expires FROM events GROUP BY 1 HAVING max(epoch_us(ts)) >= 1706600000000000",
)
def live_sessions(spark, d):
    s = table(spark, d, "events").groupBy("user_id").agg(F.max(micros(F.col("ts"))).alias("expires"))
    return M.unexpired(s, F.lit(1_706_600_000_000_000))


@query(
    "pending_events",
    "SELECT event_id AS id, user_id AS entity FROM events WHERE event_type IN ('error','signup')",
)
def pending_events(spark, d):
    return M.pending(outbox(spark, d)).select("id", "entity")


def outbox(spark, d):
    done = ~F.col("event_type").isin("error", "signup")
    at = micros(F.col("ts"))
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("entity"), F.col("event_type").alias("action"),
        at.alias("created_at"), F.when(done, at).alias("processed_at"),
    )


@query(
    "audit_trail",
    """SELECT user_id AS entity, count(*) FILTER (event_type NOT IN ('error','signup')) AS audited, count(*) FILTER (event_type IN ('error','signup')) AS waiting FROM events GROUP BY 1""",
)
def audit_trail(spark, d):
    o = outbox(spark, d)
    return M.audit_trail(o.filter("processed_at IS NOT NULL"), o)


@query(
    "status_transitions",
    """WITH s AS (SELECT o_orderkey, CASE lag(o_orderstatus) OVER w WHEN 'O' THEN 'draft' WHEN 'P' THEN 'submitted' ELSE 'rejected' END AS f, lag(o_orderkey) OVER w AS p,
      CASE o_orderstatus WHEN 'O' THEN 'draft' WHEN 'P' THEN 'submitted' ELSE 'approved' END AS t, CASE WHEN o_orderpriority LIKE '1%' THEN 'officer' WHEN o_orderpriority LIKE '2%' THEN 'planner' ELSE 'viewer' END AS role
      FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
    k AS (SELECT *, CASE WHEN f='draft' AND t='submitted' OR f='rejected' AND t='draft' THEN 1 WHEN f='submitted' AND t='approved' THEN 2 END AS need FROM s WHERE p IS NOT NULL)
    SELECT o_orderkey, f AS "from", t AS "to", role, need IS NOT NULL AS legal, need IS NOT NULL AND (CASE role WHEN 'officer' THEN 2 WHEN 'planner' THEN 1 ELSE 0 END)>=need AS allowed FROM k""",
)
def status_transitions(spark, d):
    from rillwork.operators.ordered import split_lag

    o = table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", (micros(F.col("o_orderdate")) / 86_400_000_000).cast("long").alias("day")
    )
    lagged = split_lag(o, ["o_custkey"], F.floor(F.col("day") / 365), ["day", "o_orderkey"], {"prev": "o_orderstatus"})
    name = {"O": "draft", "P": "submitted"}

    def label(c, other):
        out = F.lit(other)
        for k, v in name.items():
            out = F.when(F.col(c) == k, v).otherwise(out)
        return out

    role = F.when(F.col("o_orderpriority").startswith("1"), "officer").when(
        F.col("o_orderpriority").startswith("2"), "planner"
    ).otherwise("viewer")
    moves = lagged.filter("prev IS NOT NULL").select(
        "o_orderkey", label("prev", "rejected").alias("from"), label("o_orderstatus", "approved").alias("to"), role.alias("role")
    )
    return M.check_transitions(moves)


@query(
    "recommendation_assembly",
    """SELECT o_orderkey AS job_id, o_custkey AS village_id, c_name AS village_name, 'done' AS status, any_value(l.depth) AS depth_m, any_value(l.cost) AS cost, any_value(l.storage) AS storage_m3
    FROM orders JOIN customer ON c_custkey=o_custkey JOIN (SELECT l_orderkey, max(l_quantity) AS depth, max(l_extendedprice) AS cost, max(l_tax) AS storage FROM lineitem GROUP BY 1) l ON l_orderkey=o_orderkey
    WHERE o_orderstatus='F' GROUP BY 1,2,3""",
)
def recommendation_assembly(spark, d):
    o = table(spark, d, "orders")
    jobs = o.select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("village_id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("status")
    )
    v = table(spark, d, "customer").select(F.col("c_custkey").alias("village_id"), F.col("c_name").alias("village_name"))
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(
        F.struct(
            F.max("l_quantity").alias("depth"), F.max("l_extendedprice").alias("cost"), F.max("l_tax").alias("storage")
        ).alias("payload")
    )
    return M.assemble_recommendations(jobs, v, li)


@query(
    "village_cards",
    """WITH a AS (SELECT p_brand AS v, min(p_retailprice) AS lo, max(p_retailprice) AS hi, avg(p_retailprice) AS m, max(p_retailprice)-min(p_retailprice) AS r, count(*)*0.01::DOUBLE AS ha FROM part GROUP BY 1)
    SELECT v AS village_id, round(ha,6) AS area_ha, lo AS minimum, round(lo*(1-6/lo),6) AS minimum_low, round(r,6) AS relief, round(100*sqrt(2.0::DOUBLE)*6/r,6) AS relief_pct, printf('%.2f', r)||' m' AS shown FROM a""",
)
def village_cards(spark, d):
    p = table(spark, d, "part").groupBy(F.col("p_brand").alias("village_id")).agg(
        F.min("p_retailprice").alias("z_min"), F.max("p_retailprice").alias("z_max"), F.avg("p_retailprice").alias("z_mean"),
        (F.max("p_retailprice") - F.min("p_retailprice")).alias("relief"), (F.count(F.lit(1)) * 0.01).alias("area_ha"),
    )
    assets = p.drop("area_ha").select("*", F.lit(6.0).alias("rel_m"), F.lit(2.0).alias("slope_deg"), F.lit("grid").alias("source"))
    c = M.village_cards(p.select("village_id", "area_ha"), assets)
    return c.select(
        "village_id", F.round("area_ha", 6).alias("area_ha"), F.col("minimum.value").alias("minimum"),
        F.round(U.low(F.col("minimum")), 6).alias("minimum_low"), F.round("relief.value", 6).alias("relief"),
        F.round("relief.unc_pct", 6).alias("relief_pct"),
        U.display(U.quantity(F.col("relief.value"), "m")).alias("shown"),
    )


@query(
    "unit_conversions",
    """SELECT s_suppkey, round(s_acctbal*1e-4,9) AS ha, round(s_acctbal*1e-6,9) AS km2, round(s_acctbal*1e-4*0.85,9) AS low, round(s_acctbal*1e-4*1.15,9) AS high FROM supplier""",
)
def unit_conversions(spark, d):
    q = U.quantity(F.col("s_acctbal"), "m2", 15.0)
    ha = U.convert(q, "ha")
    return table(spark, d, "supplier").select(
        "s_suppkey", F.round(ha["value"], 9).alias("ha"), F.round(U.convert(q, "km2")["value"], 9).alias("km2"),
        F.round(U.low(ha), 9).alias("low"), F.round(U.high(ha), 9).alias("high"),
    )


@query(
    "rule_warnings",
    """WITH o AS (SELECT o_custkey, count(*) AS n, min(o_totalprice) AS lo, count(DISTINCT o_orderstatus) AS k FROM orders GROUP BY 1)
    SELECT o_custkey, array_to_string(list_filter([CASE WHEN n<8 THEN 'short_record' END, CASE WHEN k<3 THEN 'soil_assumed' END, CASE WHEN lo<20000 THEN 'stale_data' END], lambda x: x IS NOT NULL),',') AS codes,
      CASE WHEN k<3 OR n>14 THEN 'low' ELSE 'moderate' END AS confidence FROM o""",
)
def rule_warnings(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("lo"), F.count_distinct("o_orderstatus").alias("k")
    )
    w = U.warnings(
        (F.col("n") < 8, U.warning("short_record", "few years on record", "caution")),
        (F.col("k") < 3, U.warning("soil_assumed", "soil group assumed", "caution")),
        (F.col("lo") < 20000, U.warning("stale_data", "cached record used", "caution")),
    )
    o = o.withColumn("w", w)
    unc = F.when(F.col("n") > 14, 30.0).otherwise(15.0)
    return o.select("o_custkey", F.concat_ws(",", "w.code").alias("codes"), U.confidence(F.col("w.code"), unc).alias("confidence"))


@query(
    "normalised_ids",
    """SELECT conv_id, turn, CASE WHEN regexp_full_match(r,'[A-Za-z0-9._:-]{8,80}') THEN r ELSE 'cid-'||substr(sha256(r),1,40) END AS id
    FROM (SELECT conv_id, turn, CASE WHEN role='user' THEN 'conv:'||conv_id||':'||turn ELSE text END AS r FROM conversations) WHERE r<>''""",
)
def normalised_ids(spark, d):
    raw = F.when(
        F.col("role") == "user", F.concat(F.lit("conv:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    ).otherwise(F.col("text"))
    return table(spark, d, "conversations").filter(raw != "").select("conv_id", "turn", X.normalise_id(raw).alias("id"))


@query(
    "cleaned_senders",
    r"""SELECT doc_id, coalesce(nullif(substr(regexp_replace(text,'[\x00-\x1f\x7f]','','g'),1,64),''),'anonymous') AS sender FROM documents""",
)
def cleaned_senders(spark, d):
    return table(spark, d, "documents").select("doc_id", X.clean_name(F.col("text"), 64).alias("sender"))


@query(
    "aliased_fields",
    """SELECT event_id, CASE WHEN event_type IN ('click','view') THEN 'u'||user_id ELSE event_type END AS sender, CASE WHEN user_id>50 THEN 'v'||user_id END AS body, '{"k":"'||json_extract_string(props,'$.k')||'"}' AS extra FROM events""",
)
def aliased_fields(spark, d):
    named = F.col("event_type").isin("click", "view")
    u = F.col("user_id").cast("string")
    fields = F.create_map(
        F.lit("client_name"), F.when(named, F.concat(F.lit("u"), u)).otherwise(""),
        F.lit("from"), F.col("event_type"),
        F.lit("body"), F.when(F.col("user_id") > 50, F.concat(F.lit("v"), u)).otherwise(""),
    )
    entry = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("id"), u))
    return table(spark, d, "events").select(
        "event_id", X.first_of(fields, X.NAME_KEYS).alias("sender"), X.first_of(fields, X.TEXT_KEYS).alias("body"),
        X.extra_fields(entry).alias("extra"),
    )


@query(
    "shaped_entries",
    """SELECT event_id, CASE WHEN event_type<>'error' THEN event_type END AS text, CASE WHEN event_type='error' THEN json_extract_string(props,'$.k') END AS env_k FROM events""",
)
def shaped_entries(spark, d):
    kind = F.when(F.col("event_type") == "error", "enc").otherwise("plain")
    s = X.shape_entry(kind, F.col("event_type"), F.col("props"), F.lit(None).cast("string"))
    return table(spark, d, "events").select("event_id", s.alias("s")).select(
        "event_id", "s.text", F.col("s.env")["k"].alias("env_k")
    )
