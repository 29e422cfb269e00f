"""Readers and writers over text that Spark makes from the driver tables, some lines of it broken on purpose."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rillwork.catalog.base import query, records, records_sql, table
from rillwork.catalog.climate import rnd
from rillwork.session import ensure_checkpoint_dir
from rillwork.sources import climate as SC
from rillwork.sources import rejects, sinks
from rillwork.sources import runs as SR


def folder(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _text(spark, df, line, name):
    """Lines written as text files; the folder."""
    path = folder(spark, name)
    df.select(line.alias("value")).write.text(path)
    return path


@query(
    "combined_log_lines",
    """WITH e AS (SELECT *, CASE WHEN event_id%17=0 THEN 'shape' WHEN event_id%19=0 THEN 'time' ELSE 'accepted' END AS outcome FROM events)
    SELECT outcome, CASE WHEN event_id%17=0 THEN NULL WHEN event_type='error' THEN 500 ELSE 200 END AS status, count(*) AS n,
      sum(CASE WHEN event_id%17=0 OR event_id%5=0 THEN NULL ELSE event_id END)::BIGINT AS bytes, count(DISTINCT CASE WHEN event_id%17<>0 THEN user_id END) AS users FROM e GROUP BY 1,2""",
)
def combined_log_lines(spark, d):
    """A web log of the events: lines by outcome and status, bytes and users."""
    e = table(spark, d, "events")
    k = F.col("event_id")
    day = F.when(k % 19 == 0, "99/Foo/2024:10:00:00 +0000").otherwise(F.date_format(F.col("ts").cast("timestamp_ntz"), "dd/MMM/yyyy:HH:mm:ss '+0000'"))
    size = F.when(k % 5 == 0, "-").otherwise(k.cast("string"))
    status = F.when(F.col("event_type") == "error", "500").otherwise("200")
    good = F.concat(
        F.lit("10.0.0.1 - u"), F.col("user_id").cast("string"), F.lit(" ["), day, F.lit('] "GET /'), F.col("event_type"),
        F.lit(' HTTP/1.1" '), status, F.lit(" "), size, F.lit(' "-" "agent"'),
    )
    path = _text(spark, e, F.when(k % 17 == 0, F.concat(F.lit("broken "), k.cast("string"))).otherwise(good), "weblog")
    got = SR.checked_combined_log(spark, path)
    return got.groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome"), "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.count_distinct("user").alias("users")
    )


@query(
    "message_lines",
    """SELECT CASE WHEN event_id%23=0 THEN 'malformed' WHEN event_id%29=0 THEN 'no_id' WHEN event_id%2=0 AND value>100 THEN 'known' ELSE 'accepted' END AS outcome,
      count(*) AS n, count(DISTINCT CASE WHEN event_id%23<>0 THEN 'r'||(user_id%7) END) AS rooms, sum(CASE WHEN event_id%23<>0 THEN event_id END)::BIGINT AS ts FROM events GROUP BY 1""",
)
def message_lines(spark, d):
    """An export of messages with broken lines, lines without id and messages that are stored already."""
    e = table(spark, d, "events")
    k = F.col("event_id")
    name = F.when(k % 29 != 0, F.concat(F.lit("m"), k.cast("string")))
    js = F.to_json(F.struct(name.alias("id"), F.concat(F.lit("r"), (F.col("user_id") % 7).cast("string")).alias("room"), k.alias("ts")))
    path = _text(spark, e, F.when(k % 23 == 0, F.concat(F.lit('{"id": "x'), k.cast("string"))).otherwise(js), "messages")
    stored = e.filter((k % 2 == 0) & (F.col("value") > 100)).select(F.concat(F.lit("m"), k.cast("string")).alias("id"))
    got = SR.checked_messages(spark, path, stored)
    return got.groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("room").alias("rooms"), F.sum("ts").alias("ts")
    )


@query(
    "access_log_lines",
    """SELECT CASE WHEN event_id%31=0 THEN 'malformed' WHEN event_id%37=0 THEN 'status' ELSE 'accepted' END AS outcome, count(*) AS n FROM events GROUP BY 1""",
)
def access_log_lines(spark, d):
    """The balancer's log of the events, by outcome."""
    e = table(spark, d, "events")
    k = F.col("event_id")
    status = F.when(k % 37 == 0, "999").otherwise("200")
    cells = [F.lit("2024-01-01"), F.lit("c"), F.lit("GET"), F.lit("/x"), F.lit("sys2"), F.col("value").cast("string"), status, k.cast("string"), F.lit("3"), F.lit("0.5")]
    line = F.when(k % 31 == 0, F.concat(F.lit("2024,c,GET,/x,sys2,fast,two,"), k.cast("string"))).otherwise(F.concat_ws(",", *cells))
    return rejects.account(SR.checked_access_log(spark, _text(spark, e, line, "access")))


@query(
    "run_document_tables",
    f"""WITH {records_sql()}, r AS (SELECT *, CASE WHEN run_id LIKE '%rep3' THEN 'smoke_'||run_id ELSE run_id END AS run FROM rec)
    SELECT 'summary' AS part, run AS run_id, count(*) AS n, round(avg(ms),6) AS ms FROM r WHERE run NOT LIKE 'smoke%' GROUP BY 2
    UNION ALL SELECT 'records', run, count(*), round(avg(ms),6) FROM r WHERE run NOT LIKE 'smoke%' GROUP BY 2
    UNION ALL SELECT 'seconds', run, count(*), NULL FROM (SELECT DISTINCT run, CAST(floor(t/3600) AS INTEGER) AS h FROM r WHERE run NOT LIKE 'smoke%') GROUP BY 2
    UNION ALL SELECT 'trial', NULL, count(DISTINCT run), NULL FROM r WHERE run LIKE 'smoke%'""",
)
def run_document_tables(spark, d):
    """Run documents, one file each, read back as summaries, records and seconds; trial runs are counted and left out."""
    r = records(spark, d)
    r = r.withColumn("run_id", F.when(F.col("run_id").endswith("rep3"), F.concat(F.lit("smoke_"), "run_id")).otherwise(F.col("run_id")))
    fields = ("t", "ms", "status", "backend", "err", "active", "dup", "attempts", "kind")
    # a document holds its whole run, as the format has it
    whole = r.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ms").alias("mean"), F.collect_list(F.struct(*fields)).alias("records"),
        F.collect_set(F.floor(F.col("t") / 3600).cast("int")).alias("hours"),
    )
    summary = F.struct("run_id", F.col("n").alias("total_requests"), F.struct("mean").alias("latency_ms"))
    doc = F.to_json(F.struct(summary.alias("summary"), F.transform("hours", lambda h: F.struct(h.alias("t"))).alias("timeseries_1s"), "records"))
    path = folder(spark, "runs")
    whole.select(doc.alias("value"), F.col("run_id").alias("run")).repartition("run").write.partitionBy("run").text(path)
    docs = SR.run_documents(spark, f"{path}/run=*/")
    none = F.lit(None)
    s = SR.run_summaries(docs).select(F.lit("summary").alias("part"), "run_id", F.col("total_requests").alias("n"), F.col("mean").alias("ms"))
    rec = SR.run_records(docs).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.avg("ms").alias("ms"))
    sec = SR.run_seconds(docs).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    out = SR.checked_documents(docs).filter("reason = 'trial'").agg(F.count(F.lit(1)).alias("n"))
    parts = s.unionByName(rec.withColumn("part", F.lit("records"))).unionByName(sec.withColumns({"part": F.lit("seconds"), "ms": none.cast("double")}))
    return rnd(parts.unionByName(out.withColumns({"part": F.lit("trial"), "run_id": none.cast("string"), "ms": none.cast("double")})), 6)


@query(
    "contour_placemarks",
    """WITH s AS (SELECT s_suppkey%5 AS v, round(s_acctbal) AS z FROM supplier)
    SELECT CASE v WHEN 0 THEN 'z' WHEN 1 THEN 'extended_data' WHEN 2 THEN 'name' ELSE 'skipped' END AS source, count(*) AS n, CASE WHEN v<3 THEN sum(z::DOUBLE) END AS elevation
    FROM (SELECT least(v,3) AS v, z FROM s) GROUP BY v""",
)
def contour_placemarks(spark, d):
    """Contours of a map file by the place their height is read from; those without one are counted."""
    s = table(spark, d, "supplier")
    k, z = F.col("s_suppkey"), F.round("s_acctbal").cast("long").cast("string")
    way = k % 5
    flat, at = F.lit("1,2 1.1,2.1"), F.concat(F.lit("1,2,"), z, F.lit(" 1.1,2.1,"), z)
    data = F.when(way == 1, F.concat(F.lit('<ExtendedData><Data name="Elevation"><value>'), z, F.lit("</value></Data></ExtendedData>"))).otherwise("")
    name = F.when(way == 2, z).otherwise("line")
    spots = F.when(way == 0, at).when(way == 4, F.lit("1,2")).otherwise(flat)
    line = F.concat(F.lit("<Placemark><name>"), name, F.lit("</name>"), data, F.lit("<LineString><coordinates>"), spots, F.lit("</coordinates></LineString></Placemark>"))
    # one map per nation, each a file of its own
    body = F.concat(F.lit("<kml><Document>"), F.concat_ws("", F.collect_list(line)), F.lit("</Document></kml>"))
    path = folder(spark, "contours")
    s.groupBy(F.col("s_nationkey").alias("map")).agg(body.alias("value")).repartition("map").write.partitionBy("map").text(path)
    lines, facts = SC.contour_lines(SC.read_placemarks(spark, f"{path}/map=*/"))
    got = lines.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("elevation").alias("elevation"))
    return got.unionByName(facts.agg(F.lit("skipped").alias("source"), F.sum("skipped").cast("long").alias("n"), F.lit(None).cast("double").alias("elevation")))


@query(
    "table_sinks",
    """WITH s AS (SELECT n_nationkey AS nation, count(s_suppkey) AS n, round(avg(s_acctbal),2) AS mean FROM nation LEFT JOIN supplier ON s_nationkey=n_nationkey GROUP BY 1)
    SELECT 'csv' AS sink, nation, n, mean, '{"n":'||n||'}' AS facts FROM s UNION ALL SELECT 'series', nation, n, mean, NULL FROM s UNION ALL SELECT 'features', nation, n, NULL, 'Point' FROM s""",
)
def table_sinks(spark, d):
    """A table with nested columns written as CSV, plot series and GeoJSON, and read back."""
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s_acctbal"), 2).alias("mean"))
    t = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation")).join(s, "nation", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    a, b, c = (folder(spark, n) for n in ("csv", "series", "features"))
    sinks.write_csv(t.withColumn("facts", F.struct("n")), a)
    sinks.write_series(t.select("nation", "n", "mean"), b)
    sinks.write_features(t.select(sinks.feature(sinks.point(F.lit(1.0), F.lit(2.0)), {"nation": F.col("nation"), "n": F.col("n")}).alias("f")), "f", c)
    kinds = "nation {0}, n long, mean double".format(dict(t.dtypes)["nation"])
    csv = spark.read.schema(f"{kinds}, facts string").option("header", True).option("escape", "\\").csv(a)
    series = spark.read.schema(kinds).option("header", True).option("sep", " ").option("nullValue", "nan").csv(b).withColumn("facts", F.lit(None).cast("string"))
    made = spark.read.schema(f"geometry struct<type:string>, properties struct<nation:{dict(t.dtypes)['nation']},n:long>").json(c)
    made = made.select("properties.*", F.lit(None).cast("double").alias("mean"), F.col("geometry.type").alias("facts"))
    named = [x.withColumn("sink", F.lit(n)) for n, x in (("csv", csv), ("series", series), ("features", made))]
    return named[0].unionByName(named[1]).unionByName(named[2])
