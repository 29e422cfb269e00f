from rillwork.operators import messages as M

COLS = "id string, room string, sender string, ts long, kind string, text string, via string, stored_at long"


def rows(spark, items):
    return spark.createDataFrame([(i, r, "s", t, "plain", "x", via, t) for i, r, t, via in items], COLS)


def test_storm_of_retries_is_stored_once(spark):
    storm = rows(spark, [("same-id-1", "a", 100 + k, f"sys{k % 3}") for k in range(20)])
    ok, dup = M.append(None, storm)
    assert [(r["seq"], r["stored_at"]) for r in ok.collect()] == [(1, 100)] and dup.count() == 19


def test_distinct_messages_all_stay_and_sequences_go_on(spark):
    first, _ = M.append(None, rows(spark, [(f"m{k:03d}", "a" if k % 3 else "b", 10 * k, "x") for k in range(20)]), bucket_ms=50)
    first = first.cache()
    again = rows(spark, [("m001", "a", 900, "y"), ("n001", "a", 901, "y"), ("n002", "c", 902, "y")])
    ok, dup = M.append(first, again)
    assert {(r["id"], r["room"], r["seq"]) for r in ok.collect()} == {("n001", "a", 14), ("n002", "c", 1)}
    assert [r["id"] for r in dup.collect()] == ["m001"]
    every = first.unionByName(ok)
    assert M.stored_twice(every).count() == 0 and M.sequence_gaps(every).count() == 0


def test_pages(spark):
    store, _ = M.append(None, rows(spark, [(f"m{k}", "a", k, "x") for k in range(12)]))
    cur = spark.createDataFrame([("c", "a", 4, 5), ("d", "a", 10, 5)], "cursor string, room string, since long, limit int")
    body, heads = M.page(store, cur)
    assert {r["cursor"]: (r["count"], r["next_since"]) for r in heads.collect()} == {"c": (5, 9), "d": (2, None)}
    assert sorted(r["seq"] for r in body.filter("cursor = 'c'").collect()) == [5, 6, 7, 8, 9]
    new = M.newest(store, cur.filter("cursor = 'c'")).orderBy("pos").collect()
    assert [r["seq"] for r in new] == [8, 9, 10, 11, 12]
    cut_, head = M.bounded_read(store, 10)
    assert cut_.filter("page = 0").count() == 10 and cut_.count() == 12 and head.first()["since"] == 2 and head.first()["truncated"]


def test_reads_have_no_cap_but_the_limit(spark):
    store = spark.range(1, 9001).selectExpr("'a' AS room", "id AS seq", "concat('m', id) AS id")
    cur = spark.createDataFrame([("c", "a", 0, 8000), ("d", "a", 8500, 1000)], "cursor string, room string, since long, limit int")
    body, heads = M.page(store, cur)
    assert body.filter("cursor = 'c'").count() == 8000
    assert {r["cursor"]: (r["count"], r["next_since"]) for r in heads.collect()} == {"c": (8000, 8000), "d": (500, None)}
    assert M.newest(store, cur.filter("cursor = 'c'")).count() == 8000


def test_every_copy_is_audited(spark):
    sent = rows(spark, [("m1", "a", 1, "x")] * 3 + [("m1", "a", 5, "x"), ("m2", "a", 2, "x")])
    ok, dup = M.append(None, sent)
    assert ok.count() == 2 and sorted(r["at"] for r in dup.collect()) == sorted(sent.filter("id = 'm1'").collect()[i]["stored_at"] for i in (1, 2, 3))
    again, dup = M.append(ok, sent)
    assert again.count() == 0 and dup.count() == 5


def test_messages_without_id_are_rejected(spark):
    sent = rows(spark, [("m1", "a", 1, "x"), (None, "a", 2, "x"), (None, "a", 3, "y")])
    ok, dup = M.append(None, sent)
    assert [r["id"] for r in ok.collect()] == ["m1"] and sorted(r["at"] for r in dup.collect()) == sorted(r["stored_at"] for r in sent.filter("id is null").collect())
    again, dup = M.append(ok, sent)
    assert again.count() == 0 and dup.count() == 3


def test_transitions(spark):
    m = spark.createDataFrame(
        [("draft", "submitted", "planner"), ("draft", "approved", "officer"), ("submitted", "approved", "planner"), ("submitted", "rejected", "officer")],
        "from string, to string, role string",
    )
    got = [(r["legal"], r["allowed"]) for r in M.check_transitions(m).collect()]
    assert got == [(True, True), (False, False), (True, False), (True, True)]


def test_upsert_keeps_first_creation(spark):
    old = spark.createDataFrame([(1, "a", 10, 1)], "k long, v string, created long, ver long")
    new = spark.createDataFrame([(1, "b", 20, 2), (2, "c", 30, 2)], "k long, v string, created long, ver long")
    got = {r["k"]: (r["v"], r["created"]) for r in M.upsert(old, new, ["k"], "ver", keep=["created"]).collect()}
    assert got == {1: ("b", 10), 2: ("c", 30)}
