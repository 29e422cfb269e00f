import json

from pyspark.sql import functions as F

from rillwork.sources import climate as SC
from rillwork.sources import runs as SR
from rillwork.sources import sinks

KML = """<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>
<Placemark><name>x</name><LineString><coordinates>1,2,50 1.1,2.1,50 1.2,2.2,50</coordinates></LineString></Placemark>
<Placemark><name>n</name><ExtendedData><Data name="ID"><value>7</value></Data><Data name="Elevation"><value>40</value></Data></ExtendedData><LineString><coordinates>1,2 1.1,2.1</coordinates></LineString></Placemark>
<Placemark><name>30.5</name><LineString><coordinates>1,2 1.1,2.1</coordinates></LineString></Placemark>
<Placemark><name>no</name><ExtendedData><Data name="ID"><value>9</value></Data></ExtendedData><LineString><coordinates>1,2 1.1,2.1</coordinates></LineString></Placemark>
<Placemark><name>short</name><LineString><coordinates>1,2,3</coordinates></LineString></Placemark>
<Placemark><name>aoi</name><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 1,0 1,1 0,0</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>
<Placemark><name>p</name><Point><coordinates>1,1</coordinates></Point></Placemark>
</Document></kml>"""


def test_contours_from_kml(spark, tmp_path):
    (tmp_path / "a.kml").write_text(KML)
    lines, facts = SC.contour_lines(SC.read_placemarks(spark, str(tmp_path / "a.kml")))
    got = sorted((r["elevation"], r["source"], len(r["vertices"])) for r in lines.collect())
    assert got == [(30.5, "name", 2), (40.0, "extended_data", 2), (50.0, "z", 3)]
    f = facts.first()
    assert f["skipped"] == 2 and len(f["aoi"]) == 4


def test_rain_documents(spark):
    a = json.dumps({"daily": {"time": ["2020-01-01", "2020-01-02"], "precipitation_sum": [1.5, None]}})
    b = json.dumps({"properties": {"parameter": {"PRECTOTCORR": {"20200101": 2.0, "20200102": -999.0}}}})
    df = spark.createDataFrame([(1, a, b)], "site long, a string, b string")
    assert [r["mm"] for r in SC.archive_rain(df.select("site", "a"), "a").orderBy("day").collect()] == [1.5, None]
    assert [r["mm"] for r in SC.keyed_rain(df.select("site", "b"), "b").orderBy("day").collect()] == [2.0, None]


def test_run_documents(spark, tmp_path):
    doc = {
        "summary": {"run_id": "L1_c25_rep1", "latency_ms": {"p50": 3.0}, "backend_distribution": {"sys2": 5}},
        "timeseries_1s": [{"t": 0, "ok": 1, "by_backend": {"sys2": 1}}],
        "records": [{"t": 0.5, "ms": 3.0, "status": 200, "backend": "sys2", "err": "", "active": 1, "dup": False, "attempts": 1, "kind": "send"}],
    }
    (tmp_path / "L1_c25_rep1.json").write_text(json.dumps(doc))
    (tmp_path / "smoke_1.json").write_text(json.dumps({**doc, "summary": {"run_id": "smoke_1"}}))
    d = SR.run_documents(spark, str(tmp_path))
    s = SR.run_summaries(d).collect()
    assert len(s) == 1 and s[0]["p50"] == 3.0
    assert SR.run_records(d).count() == 1  # trial runs are left out everywhere
    assert [r["reason"] for r in SR.checked_documents(d).orderBy("summary.run_id").collect()] == [None, "trial"]
    assert SR.run_seconds(d).filter("run_id = 'L1_c25_rep1'").first()["by_backend"] == {"sys2": 1}


def test_traces_and_counters(spark, tmp_path):
    (tmp_path / "r1.csv").write_text("t,system,cpu_pct,mem_mb,mem_pct,quota_cores\n1,sys1,5.5,100,20,1\n")
    assert SR.utilisation_csv(spark, str(tmp_path / "r1.csv")).first()["run_id"] == "r1"
    (tmp_path / "C_c100_rep1_sys2.txt").write_text("1700000000 10 20 300\n1700000001 15 30 300\n")
    r = SR.counter_files(spark, str(tmp_path / "C_c100_rep1_sys2.txt")).first()
    assert (r["config"], r["concurrency"], r["rep"], r["system"], r["run_id"]) == ("C", 100, 1, "sys2", "C_c100_rep1")


def test_io_documents(spark, tmp_path):
    side = {"total_ios": 10, "iops": 100.0, "bw_bytes": 2097152, "lat_ns": {"mean": 5000.0, "max": 9000.0}, "slat_ns": {"mean": 1.0}, "clat_ns": {"mean": 4000.0, "percentile": {"99.000000": 8000}}}
    none = {"total_ios": 0, "iops": 0.0}
    job = {"error": 0, "read": side, "write": none, "iodepth_level": {"1": 90.0, "2": 10.0}, "usr_cpu": 1.0, "sys_cpu": 2.0, "job_runtime": 1000}
    (tmp_path / "A_rand_qd8_r2.json").write_text(json.dumps({"jobs": [job], "disk_util": [{"util": 50.0}]}))
    (tmp_path / "A_rand_qd8_r3.json").write_text(json.dumps({"jobs": [{**job, "error": 5}]}))
    rows = SR.io_documents(spark, str(tmp_path)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["case"], r["depth"], r["rep"], r["direction"], r["bw_mib"], r["p99"], r["lat_us"]) == ("A_rand", 8, 2, "read", 2.0, 8.0, 5.0)


def test_logs(spark, tmp_path):
    (tmp_path / "web.log").write_text('1.2.3.4 - bob [10/Oct/2025:13:55:36 +0000] "GET /x HTTP/1.1" 200 512 "-" "agent"\nbroken\n')
    r = SR.combined_log(spark, str(tmp_path / "web.log")).collect()
    assert len(r) == 1 and r[0]["status"] == 200 and r[0]["path"] == "/x" and r[0]["bytes"] == 512
    (tmp_path / "acc.csv").write_text("1,c,GET,/m,sys2,3.5,200,10,1,0.1\n")
    assert SR.access_log(spark, str(tmp_path / "acc.csv")).first()["ms"] == 3.5


def test_legacy_messages(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"id":"aaaaaaaa","room":"r","text":"x"}\n{broken\n{"id":"bbbbbbbb","room":"r","text":"y"}\n')
    stored = spark.createDataFrame([("aaaaaaaa",)], "id string")
    new, skipped = SR.legacy_messages(spark, str(tmp_path / "m.jsonl"), stored)
    assert [r["id"] for r in new.collect()] == ["bbbbbbbb"] and skipped.first()["skipped"] == 1


def test_road_files(spark, tmp_path):
    rows = "".join(f"{v + 1},{v // 3 / 2},{v % 3 / 2}, Shop \n" for v in range(9))
    (tmp_path / "loc.csv").write_text("ID,Latitude,Longitude,Category\n" + rows)
    nodes, rejects, n = SR.read_locations(spark, str(tmp_path / "loc.csv"))
    assert n == 3 and nodes.count() == 9 and rejects.count() == 0 and nodes.first()["category"] == "shop"
    (tmp_path / "link.txt").write_text("0 0 0.5 0\n0.5 0 0 0\n0 0 0.5 0.5\n0 0 0.3 0\n")
    edges, bad = SR.read_links(spark, str(tmp_path / "link.txt"), 3)
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {(0, 1), (1, 0)} and bad.count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, {"a": 2}, None)], "k long, m map<string,int>, x double")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).count() == 1
    sinks.write_series(df.select("k", "x"), str(tmp_path / "dat"))
    assert "1 nan" in "".join(p.read_text() for p in (tmp_path / "dat").glob("*.csv"))
    f = df.select(sinks.feature(sinks.point(F.lit(1.0), F.lit(2.0)), {"k": F.col("k")}).alias("f"))
    sinks.write_features(f, "f", str(tmp_path / "geo"))
    doc = json.loads("".join(p.read_text() for p in (tmp_path / "geo").glob("*.txt")))
    assert doc["geometry"]["coordinates"] == [1.0, 2.0] and doc["properties"] == {"k": 1}
