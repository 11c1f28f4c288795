"""Accumulator semantics (the audited tool's memory tests, as DataFrames)."""
import datetime as dt

from pyspark.sql import functions as F

from veilscan.operators import evidence as E

T0 = dt.datetime(2024, 1, 1)


def _features(spark, rows):
    schema = ("site string, ts timestamp, seq long, url string, scrape_success boolean, scrape_error string, "
              "prices array<string>, preselected_checkboxes array<struct<name:string,type:string>>, "
              "hidden_inputs array<struct<name:string>>, popup_detected boolean, small_print array<string>, "
              "visible_text string")
    return spark.createDataFrame(rows, schema)


def _signals(spark, rows):
    schema = ("site string, ts timestamp, seq long, urgency_texts array<string>, subscription_keywords array<string>, "
              "consent_accept array<string>, consent_reject array<string>, dark_pattern_hints array<string>, "
              "extraction_method string, language_detected string")
    return spark.createDataFrame(rows, schema)


def test_reject_missing_is_sticky(spark):
    sig = _signals(spark, [
        ("s", T0, 1, [], [], ["accept all"], [], [], "fallback", "unknown"),
        ("s", T0 + dt.timedelta(seconds=1), 2, [], [], ["accept all"], ["reject all"], [], "fallback", "unknown")])
    ev = E.site_evidence(E.extract_log(sig)).collect()[0]
    assert ev.reject_button_missing is True


def test_failed_scrape_is_a_step_not_a_visit(spark):
    f = _features(spark, [("s", T0, 1, "u1", False, "Timeout", [], [], [], False, [], ""),
                          ("s", T0 + dt.timedelta(seconds=1), 2, "u2", True, None, ["$1"], [], [], True, [], "t")])
    lg = E.scrape_log(f)
    ev = E.site_evidence(lg).collect()[0]
    assert ev.step_count == 2 and ev.pages_visited == 1 and ev.popup_detected is True
    rows = {r.seq: r.summary for r in lg.collect()}
    assert rows[1] == "Scrape failed: Timeout"
    assert rows[2] == "Scraped u2 — popup detected, prices found: ['$1']"


def _log_with_steps(spark, n_steps, signals=True):
    shots = spark.createDataFrame([("s", T0, 0, True, "p.png", 1280, 900, None)],
                                  "site string, ts timestamp, seq long, success boolean, path string, "
                                  "width int, height int, error string")
    f = _features(spark, [("s", T0 + dt.timedelta(seconds=i), i, f"u{i}", True, None, ["$1"], [], [],
                           False, [], "t") for i in range(1, n_steps)])
    sig = _signals(spark, [("s", T0 + dt.timedelta(seconds=100), 100, ["only"] if signals else [], [], [], [], [],
                            "fallback", "unknown")])
    return E.build_log(E.screenshot_log(shots), E.scrape_log(f), E.extract_log(sig))


def test_enough_needs_six_steps_and_a_signal(spark):
    five = E.site_evidence(_log_with_steps(spark, 4))
    six = E.site_evidence(_log_with_steps(spark, 5))
    prices_only = E.site_evidence(_log_with_steps(spark, 6, signals=False))
    assert five.select(E.enough_evidence(five)).collect()[0][0] is False
    assert six.select(E.enough_evidence(six)).collect()[0][0] is True
    assert prices_only.select(E.enough_evidence(prices_only)).collect()[0][0] is False


def test_stop_step_and_cap(spark):
    lg = E.number_steps(_log_with_steps(spark, 12))
    run = E.running_evidence(lg)
    assert E.stop_steps(run).collect()[0].stop_step == 13  # signal arrives last
    inv = E.investigation(lg, cap=10)
    assert inv.agg(F.max("step")).collect()[0][0] == 10


def test_summary_lists_steps(spark):
    inv = E.investigation(E.number_steps(_log_with_steps(spark, 5)), cap=10)
    s = E.evidence_summary(inv).collect()[0].evidence_summary
    assert s.startswith("Investigation of: s\nSteps taken: 6\n")
    assert "[1] SCREENSHOT: Screenshot saved — 1280x900px" in s
    assert "Urgency texts: ['only']" in s


def test_investigation_takes_the_whole_log_by_default(spark):
    log = E.number_steps(_log_with_steps(spark, 14))
    assert E.cap_steps(log).count() == log.count() > 10
    stops = {r.site: r.stop_step for r in E.stop_steps(E.running_evidence(log)).collect()}
    want = sum(1 for r in log.collect() if stops[r.site] is None or r.step <= stops[r.site])
    assert E.investigation(log).count() == want
    quiet = log.withColumn("shot_path", F.lit(None).cast("string"))
    assert E.investigation(quiet).count() == quiet.count()
    assert E.investigation(quiet, cap=10).agg(F.max("step")).first()[0] == 10


def test_summary_in_parts(spark):
    """A hot site's lines fill many bounded parts, in order; no line is lost or in two parts."""
    rows = [("hot" if i % 4 else f"s{i % 7}", i // 5, i % 3, "text %d " % i * (1 + i % 3)) for i in range(900)]
    lines = spark.createDataFrame([(s, 10, n, str(k) + t, t) for s, n, k, t in rows], "site string, section int, n long, v string, text string")
    parts = E.summary_parts(lines, limit=200, num_partitions=5).collect()
    whole = {}
    for r in sorted(parts, key=lambda r: (r.site, r.part)):
        assert len(r.text) < 200 + 60 and r.n_lines == r.text.count("\n") + 1
        whole.setdefault(r.site, []).append(r.text)
    want = {}
    for s, n, k, t in sorted(rows, key=lambda r: (r[0], r[1], str(r[2]) + r[3])):
        want.setdefault(s, []).append(t)
    assert {s: "\n".join(x) for s, x in whole.items()} == {s: "\n".join(x) for s, x in want.items()}
    assert sum(r.site == "hot" for r in parts) > 20
