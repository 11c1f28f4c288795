"""Reports: parsing, validation, enrichment, risk, JSON sink and file keys."""
import datetime as dt
import json

from pyspark.sql import functions as F

from veilscan.operators import findings as FN
from veilscan.operators import report as R
from veilscan.sources import sinks

F1 = ('{"pattern": "Countdown Timer", "level": "low", "high_level_strategy": "Social Engineering", '
      '"severity": "HIGH", "evidence": "Offer ends in 09:59", "location": "homepage", "gdpr_risk": false, '
      '"legal_reference": "Consumer Protection", "recommendation": "Remove fake countdown"}')
F2 = ('{"pattern": "Bad Defaults", "level": "meso", "high_level_strategy": "Interface Interference", '
      '"severity": "HIGH", "evidence": "Newsletter pre-checked by default", "location": "registration form", '
      '"gdpr_risk": true, "legal_reference": null, "recommendation": "Require explicit opt-in"}')
F2_NO_LEGAL = F2.replace(', "legal_reference": null', "")


def _report(findings, count=2, extra=""):
    return ('{"dark_patterns_found": [' + ", ".join(findings) + '], "overall_risk": "HIGH", '
            '"overall_summary": "Two findings.", "gdpr_concerns": true, "pattern_count": ' + str(count) +
            ', "language_detected": "en"' + extra + '}')


def test_parse_reports(spark):
    lax = _report([F1.replace('"gdpr_risk": false', '"gdpr_risk": "no"')]).replace('"pattern_count": 2', '"pattern_count": "2"')
    rows = [("ok", _report([F1, F2])), ("clean", _report([], 0).replace("HIGH", "CLEAN")), ("lax", lax),
            ("missing_key", _report([F1, F2_NO_LEGAL])), ("wrong_count", _report([F1], 5)),
            ("empty", ""), ("structure", '{"overall_risk": "LOW"}')]
    df = spark.createDataFrame(rows, "site string, raw string")
    got = {r.site: r for r in FN.parse_reports(df).collect()}
    assert got["ok"].analysis_success and len(got["ok"].dark_patterns_found) == 2
    assert got["ok"].dark_patterns_found[1].legal_reference is None
    assert got["clean"].overall_risk == "CLEAN" and got["clean"].pattern_count == 0
    assert got["missing_key"].analysis_error == FN.ERR_CONSTRUCT and got["missing_key"].overall_risk == "UNKNOWN"
    assert got["missing_key"].error_detail == "dark_patterns_found[1].legal_reference" and got["ok"].error_detail is None
    assert got["ok"].n_out_of_domain == 0
    assert got["wrong_count"].pattern_count == 5            # the model's count is kept
    assert got["wrong_count"].count_mismatch and got["wrong_count"].computed_pattern_count == 1
    assert got["lax"].analysis_success and got["lax"].pattern_count == 2
    assert got["lax"].dark_patterns_found[0].gdpr_risk is False
    assert got["empty"].analysis_error == FN.ERR_NO_REPLY
    assert got["structure"].analysis_error == FN.ERR_STRUCTURE
    salvaged = {r.site: r for r in FN.parse_reports(df, salvage=True).collect()}
    assert salvaged["missing_key"].analysis_success and len(salvaged["missing_key"].dark_patterns_found) == 1


def test_enrich_and_risk(spark):
    f = spark.createDataFrame([("s", "Hidden Costs", "HIGH"), ("s", "Nagging", "LOW"), ("t", "Urgency", "LOW")],
                              "site string, pattern string, severity string")
    e = FN.enrich_legal(FN.enrich_taxonomy(f)).collect()
    by = {r.pattern: r for r in e}
    assert by["Hidden Costs"].canonical_pattern == "Drip Pricing" and by["Hidden Costs"].tax_level == "low"
    assert sorted(by["Hidden Costs"].laws) == ["Consumer Protection", "DMA"]
    assert by["Nagging"].laws == ["DSA"] and by["Urgency"].laws == []
    fe = FN.enrich_legal(FN.enrich_taxonomy(f)).withColumn("gdpr_risk", F.col("gdpr_by_law"))
    risk = {r.site: (r.overall_risk, r.gdpr_concerns) for r in FN.overall_risk(fe).collect()}
    assert risk == {"s": ("HIGH", False), "t": ("LOW", False)}
    gate = R.risk_gate(FN.overall_risk(fe)).collect()[0].exit_code
    assert gate == 2


def test_classify_inline_equals_join(spark):
    ev = spark.createDataFrame([("a", ["only", "left", "free trial"], ["urgency", "subscription"], True, False),
                                ("b", ["hurry"], ["urgency"], False, True), ("c", [], [], False, False)],
                               "site string, phrases array<string>, categories array<string>, "
                               "has_preselected boolean, popup_detected boolean")
    joined = sorted((r.site, r.pattern, r.evidence, r.severity) for r in FN.classify(ev).collect())
    inline = sorted((r.site, f.pattern, f.evidence, f.severity)
                    for r in FN.classify_inline(ev).collect() for f in r.findings)
    assert joined == inline
    assert ("a", "Low Stock Message", "left", "MEDIUM") in inline      # low beats meso Urgency
    assert not any(p == "Urgency" and s == "a" for s, p, *_ in inline)


def test_report_json_and_key(spark):
    df = spark.createDataFrame([("ok", _report([F1, F2]))], "site string, raw string")
    rep = FN.parse_reports(df).withColumn("url", F.lit("https://example.com")) \
        .withColumn("report_ts", F.lit(dt.datetime(2024, 1, 2, 3, 4, 5)))
    doc = json.loads(rep.select(sinks.report_json(rep)).collect()[0][0])
    assert list(doc) == sinks.REPORT_KEY_ORDER
    assert doc["dark_patterns_found"][1]["legal_reference"] is None
    key = rep.select(sinks.report_key("url", "report_ts")).collect()[0][0]
    assert key == "https___example_com_20240102_030405"
    shot = rep.select(sinks.report_key("url", "report_ts", strip_scheme=True)).collect()[0][0]
    assert shot == "example_com_20240102_030405"
