"""File sinks write to the session's shared folder and read back whole."""
import datetime as dt
import json
import uuid

from pyspark.sql import functions as F

from veilscan.operators import findings as FN
from veilscan.session import ensure_checkpoint_dir
from veilscan.sources import sinks

REPORT = ('{"dark_patterns_found": [{"pattern": "Nagging", "level": "meso", "high_level_strategy": "Forced Action", '
          '"severity": "LOW", "evidence": "popup", "location": "home", "gdpr_risk": false, "legal_reference": "DSA", '
          '"recommendation": "Avoid interruptions"}], "overall_risk": "LOW", "overall_summary": "One finding.", '
          '"gdpr_concerns": false, "pattern_count": 1, "language_detected": "en"}')


def test_write_reports_partitioned_by_risk(spark):
    df = spark.createDataFrame([("a", REPORT), ("b", "not json")], "site string, raw string")
    rep = FN.parse_reports(df).withColumn("url", F.concat(F.lit("https://"), "site", F.lit(".example"))) \
        .withColumn("report_ts", F.lit(dt.datetime(2024, 5, 6, 7, 8, 9)))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/reports_{uuid.uuid4().hex}"
    sinks.write_reports(rep, path)
    back = {r.risk: json.loads(r.value) for r in spark.read.text(path).collect()}
    assert set(back) == {"LOW", "UNKNOWN"}
    doc = back["LOW"]
    assert list(doc) == sinks.REPORT_KEY_ORDER and doc["dark_patterns_found"][0]["pattern"] == "Nagging"
    assert doc["url"] == "https://a.example" and doc["timestamp"] == "20240506_070809"
    assert rep.filter("site = 'a'").select(sinks.report_key("url", "report_ts")).first()[0] == "https___a_example_20240506_070809"
    assert back["UNKNOWN"]["dark_patterns_found"] == []
    assert spark.read.json(path).filter("overall_risk = 'LOW'").first().pattern_count == 1


def test_write_log_appends(spark):
    rows = [("s", dt.datetime(2024, 1, 1, 10), 1, "agent", "x", ""), ("s", dt.datetime(2024, 1, 2, 10), 2, "agent", "y", "")]
    log = spark.createDataFrame(rows, "site string, ts timestamp, seq long, tool string, summary string, evidence string")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/log_{uuid.uuid4().hex}"
    sinks.write_log(log, path)
    sinks.write_log(log, path)
    back = spark.read.parquet(path)
    assert back.count() == 4
    assert sorted(str(r.day) for r in back.select("day").distinct().collect()) == ["2024-01-01", "2024-01-02"]


def test_one_file_per_report_key(spark):
    df = spark.createDataFrame([(f"site{i}", REPORT) for i in range(12)], "site string, raw string").repartition(5)
    rep = FN.parse_reports(df).withColumn("url", F.concat(F.lit("https://"), "site", F.lit(".example"))) \
        .withColumn("report_ts", F.lit(dt.datetime(2024, 5, 6, 7, 8, 9)))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/reports_{uuid.uuid4().hex}"
    for _ in range(2):
        sinks.write_report_files(rep, path)
    back = {r.report_key: json.loads(r.value)["url"] for r in sinks.read_report_files(spark, path).collect()}
    assert back == {f"https___site{i}_example_20240506_070809": f"https://site{i}.example" for i in range(12)}
    files = spark.read.text(path).select(F.input_file_name().alias("f")).distinct().count()
    assert files == 12
