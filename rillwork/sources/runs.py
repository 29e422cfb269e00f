"""Readers for run documents, utilisation traces, storage benchmarks, logs and road files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.functions import load as L
from rillwork.sources import rejects

RECORD = "struct<t:double,ms:double,status:int,backend:string,err:string,active:int,dup:boolean,attempts:int,kind:string>"
SECOND = (
    "struct<t:int,requests:bigint,ok:bigint,errors:bigint,dups:bigint,p50:double,p95:double,mean:double,"
    "by_backend:map<string,bigint>,active_backends:int,states:map<string,string>,in_flight:map<string,int>,"
    "scores:map<string,double>,cpu:map<string,double>,users:int>"
)
LATENCY = "struct<mean:double,stddev:double,min:double,p50:double,p90:double,p95:double,p99:double,max:double>"
SUMMARY = (
    "struct<run_id:string,concurrency:int,duration_s:double,warmup_s:double,mode:string,rate:double,total_requests:bigint,"
    "success:bigint,errors:bigint,error_rate_pct:double,errors_by_class:map<string,bigint>,dropped_arrivals:bigint,"
    f"throughput_rps:double,sends_retried:bigint,duplicates_suppressed:bigint,latency_ms:{LATENCY},"
    "backend_distribution:map<string,bigint>,active_backends_min:int,active_backends_max:int,"
    "events:array<struct<t:double,label:string>>>"
)
RUN_DOC = f"summary {SUMMARY}, timeseries_1s array<{SECOND}>, records array<{RECORD}>"


def run_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per run document."""
    return spark.read.schema(RUN_DOC).option("multiLine", True).json(path)


def run_summaries(docs: DataFrame) -> DataFrame:
    """Summary rows, without trial runs; latency fields flat."""
    s = checked_documents(docs).filter("reason is null").select("summary.*")
    return s.select("*", "latency_ms.*").drop("latency_ms")


def checked_documents(docs: DataFrame) -> DataFrame:
    """Documents with the ``reason`` why a report leaves them out: no run id (broken ones too), or a trial run."""
    run = F.col("summary.run_id")
    return rejects.tag(docs, {"no_run": run.isNull(), "trial": L.ignored_run(run)})


def run_records(docs: DataFrame) -> DataFrame:
    """Request records, without trial runs."""
    return checked_documents(docs).filter("reason is null").select("summary.run_id", F.inline("records"))


def run_seconds(docs: DataFrame) -> DataFrame:
    """Per-second rows with their maps, without trial runs."""
    return checked_documents(docs).filter("reason is null").select("summary.run_id", F.inline("timeseries_1s"))


def utilisation_csv(spark: SparkSession, path: str) -> DataFrame:
    """Utilisation traces; the run id is the file name."""
    schema = "t double, system string, cpu_pct double, mem_mb double, mem_pct double, quota_cores double"
    return spark.read.schema(schema).option("header", True).csv(path).withColumn(
        "run_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)
    )


def counter_files(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ``epoch busy total rss`` files; the run comes from the file name."""
    name = F.col("_metadata.file_name")
    pattern = r"^(.+)_c(\d+)_rep(\d+)_sys(\d+)\.txt$"
    return spark.read.schema("t double, busy double, total double, rss double").option("sep", " ").csv(path).select(
        "*", F.regexp_extract(name, pattern, 1).alias("config"), F.regexp_extract(name, pattern, 2).cast("int").alias("concurrency"),
        F.regexp_extract(name, pattern, 3).cast("int").alias("rep"), F.concat(F.lit("sys"), F.regexp_extract(name, pattern, 4)).alias("system"),
        F.regexp_extract(name, r"^(.+)_sys\d+\.txt$", 1).alias("run_id"),
    )


_NS = "struct<mean:double,max:double,percentile:map<string,double>>"
_DIR = f"struct<total_ios:bigint,iops:double,bw_bytes:double,lat_ns:{_NS},slat_ns:{_NS},clat_ns:{_NS}>"
IO_DOC = (
    f"jobs array<struct<error:int,read:{_DIR},write:{_DIR},sync:struct<lat_ns:{_NS}>,iodepth_level:map<string,double>,"
    "usr_cpu:double,sys_cpu:double,job_runtime:double>>, disk_util array<struct<util:double>>"
)


def io_documents(spark: SparkSession, path: str, skip_failed: bool = True) -> DataFrame:
    """Storage-benchmark documents: one row per run and direction with IOs, times in µs."""
    name = F.col("_metadata.file_name")
    pattern = r"^(.+)_qd(\d+)_r(\d+)\.json$"
    d = spark.read.schema(IO_DOC).option("multiLine", True).json(path).select(
        name.alias("file"), F.col("jobs")[0].alias("j"), F.get("disk_util", F.lit(0))["util"].alias("util")
    )
    if skip_failed:
        d = d.filter(F.coalesce(F.col("j.error"), F.lit(0)) == 0)

    def side(kind: str):
        x = F.col(f"j.{kind}")
        pct = x["clat_ns"]["percentile"]
        return F.struct(
            F.lit(kind).alias("direction"), x["total_ios"].alias("ios"), x["iops"].alias("iops"),
            (x["bw_bytes"] / 1048576).alias("bw_mib"), (x["lat_ns"]["mean"] / 1000).alias("lat_us"),
            (x["slat_ns"]["mean"] / 1000).alias("slat_us"), (x["clat_ns"]["mean"] / 1000).alias("clat_us"),
            *[(F.try_element_at(pct, F.lit(f"{p:.6f}")) / 1000).alias(n) for n, p in (("p50", 50), ("p95", 95), ("p99", 99), ("p999", 99.9))],
            (x["lat_ns"]["max"] / 1000).alias("max_us"),
        )

    return d.select(
        F.regexp_extract("file", pattern, 1).alias("case"), F.regexp_extract("file", pattern, 2).try_cast("int").alias("depth"),
        F.regexp_extract("file", pattern, 3).try_cast("int").alias("rep"), "file", "util",
        (F.col("j.usr_cpu") + F.col("j.sys_cpu")).alias("cpu"), (F.col("j.job_runtime") / 1000).alias("runtime_s"),
        F.col("j.iodepth_level").alias("levels"), (F.col("j.sync.lat_ns.mean") / 1000).alias("sync_mean"),
        (F.try_element_at(F.col("j.sync.lat_ns.percentile"), F.lit("99.000000")) / 1000).alias("sync_p99"),
        F.inline(F.array(side("read"), side("write"))),
    ).filter(F.col("ios") > 0)


ACCESS = "ts string, client string, method string, path string, backend string, ms double, status int, bytes bigint, active int, queue_ms double"


def access_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Balancer access log, as a table or as a stream of new files."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(ACCESS).csv(path)


COMBINED = r'^(\S+) \S+ (\S+) \[([^\]]+)\] "(\S+) (\S+) ([^"]*)" (\d{3}) (\d+|-) "([^"]*)" "([^"]*)"'


def checked_combined_log(spark: SparkSession, path: str) -> DataFrame:
    """Every line of a combined-format web log: its fields, or the ``reason`` (``shape``, ``time``) that it has none."""
    v = F.col("value")
    names = ("client", "user", "time", "method", "path", "protocol", "status", "bytes", "referer", "agent")
    cols = {n: F.regexp_extract(v, COMBINED, i) for i, n in enumerate(names, 1)}
    t = spark.read.text(path).select("value", *[F.when(v.rlike(COMBINED), c).alias(n) for n, c in cols.items()])
    t = t.withColumns(
        {
            "status": F.col("status").try_cast("int"),
            "bytes": F.col("bytes").try_cast("bigint"),
            "time": F.try_to_timestamp("time", F.lit("dd/MMM/yyyy:HH:mm:ss Z")),
        }
    )
    return rejects.tag(t, {"shape": F.col("client").isNull(), "time": F.col("time").isNull()})


def checked_access_log(spark: SparkSession, path: str) -> DataFrame:
    """Every line of the balancer's log: its fields, or the ``reason``: ``malformed`` or ``status``."""
    t = spark.read.schema(f"{ACCESS}, line string").option("columnNameOfCorruptRecord", "line").csv(path)
    return rejects.tag(t, {"malformed": F.col("line").isNotNull(), "status": ~F.col("status").between(100, 599) | F.col("status").isNull()})


def combined_log(spark: SparkSession, path: str) -> DataFrame:
    """Combined-format web log; lines of another shape are left out (see ``checked_combined_log``)."""
    return checked_combined_log(spark, path).filter("client is not null").drop("value", "reason")


MESSAGE = "id string, room string, sender string, ts bigint, kind string, text string, env string, via string, extra string"


def checked_messages(spark: SparkSession, path: str, stored: DataFrame | None = None) -> DataFrame:
    """Every line of a JSON-lines export: its fields, or the ``reason``: ``malformed``, ``no_id`` or ``known``."""
    m = spark.read.text(path).withColumn("m", F.from_json("value", MESSAGE)).select("value", "m.*")
    # a broken line gives nulls only; so does an empty object, which has no id either
    whole = F.get_json_object("value", "$").isNotNull()
    if stored is None:
        m = m.withColumn("_known", F.lit(False))
    else:
        known = stored.select(F.col("id").alias("_id")).distinct()
        m = m.join(known, F.col("id") == F.col("_id"), "left").withColumn("_known", F.col("_id").isNotNull()).drop("_id")
    tagged = rejects.tag(m, {"malformed": ~whole, "no_id": F.col("id").isNull(), "known": F.col("_known")})
    return tagged.drop("_known")


def legacy_messages(spark: SparkSession, path: str, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(new, skipped)`` of a JSON-lines export: broken lines drop out, known ids are counted."""
    checked = checked_messages(spark, path, stored)
    new, _ = rejects.split(checked, "value")
    return new, checked.filter("reason = 'known'").groupBy().agg(F.count(F.lit(1)).alias("skipped"))


#: Fixed value: how far a coordinate may lie from its grid node.
TOLERANCE = 1e-4


def _grid_index(value: str, n: int):
    i = F.rint(F.col(value) * (n - 1))
    ok = i.between(0, n - 1) & (F.abs(i / (n - 1) - F.col(value)) <= TOLERANCE)
    return F.when(ok, i.cast("long"))


def read_locations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, int]:
    """``(nodes, rejects, n)`` of a locations file on an ``n × n`` unit grid.

    Rejects are off the grid or share a node with another row; a row count that is no square is
    an error.
    """
    raw = spark.read.schema("ID long, Latitude double, Longitude double, Category string").option("header", True).csv(path)
    total = raw.count()
    n = int(total**0.5 + 0.5)
    if n * n != total or n < 2:
        raise ValueError(f"{total} locations do not fill a square grid")
    r = raw.select(
        F.col("ID").alias("id"), F.col("Latitude").alias("lat"), F.col("Longitude").alias("lon"),
        F.lower(F.trim("Category")).alias("category"), (_grid_index("Latitude", n) * n + _grid_index("Longitude", n)).alias("node"),
    )
    twice = r.groupBy("node").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1 OR node IS NULL").select("node")
    bad = F.col("node").isNull()
    rejects = r.join(twice, "node", "left_semi").unionByName(r.filter(bad))
    return r.filter(~bad).join(twice, "node", "left_anti"), rejects, n


def read_links(spark: SparkSession, path: str, n: int) -> tuple[DataFrame, DataFrame]:
    """``(edges, rejects)`` of a link file ``lon lat lon lat``; only grid neighbours are roads."""
    parts = F.split(F.trim("value"), r"\s+")
    raw = spark.read.text(path).filter(F.trim("value") != "")
    t = raw.select("value", *[F.try_element_at(parts, F.lit(i + 1)).try_cast("double").alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])
    t = t.select(
        "value", (_grid_index("y0", n) * n + _grid_index("x0", n)).alias("src"), (_grid_index("y1", n) * n + _grid_index("x1", n)).alias("dst")
    )
    step = F.abs(F.floor(F.col("src") / n) - F.floor(F.col("dst") / n)) + F.abs(F.col("src") % n - F.col("dst") % n)
    ok = F.coalesce(step == 1, F.lit(False))
    good = t.filter(ok)
    edges = good.select("src", "dst").union(good.select(F.col("dst"), F.col("src"))).distinct()
    return edges, t.filter(~ok).select("value")
