"""Evidence-log queries over the G3 log built from events (2.A log sink, 2.D-2.H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators.findings import classify
from ..session import ensure_checkpoint_dir
from ..sources.scratch import written
from ..sources.sinks import write_log
from ..sources.tables import existing_shots, screenshot_files
from . import fixtures as G
from .prompts import analyst_prompts
from .registry import L, query

# ---------------------------------------------------------------------------
# DuckDB: the log with summary and evidence text per row
# ---------------------------------------------------------------------------
_R = "''"  # a quote inside SQL text


def _repr1(x):
    return f"'[{_R}' || {x} || '{_R}]'"


SQL_SUMMARY = f"""CASE tool
  WHEN 'scraper' THEN CASE WHEN scrape_ok THEN 'Scraped ' || url || ' — ' || coalesce(nullif(concat_ws(', ',
      CASE WHEN k % 11 = 0 THEN '1 preselected checkboxes' END, CASE WHEN k % 7 = 0 THEN 'popup detected' END,
      CASE WHEN k % 3 = 0 THEN 'prices found: ' || {_repr1("'$' || k || '.99'")} END,
      CASE WHEN k % 6 = 0 THEN '1 small print elements' END), ''), 'no red flags')
    ELSE 'Scrape failed: Timeout after 30.0s' END
  WHEN 'extractor' THEN 'Extraction (' || CASE WHEN k % 2 = 0 THEN 'hybrid' ELSE 'fallback' END || ') — ' ||
    coalesce(nullif(concat_ws(', ',
      CASE WHEN k % 4 = 0 THEN 'urgency: [{_R}only{_R}, {_R}left{_R}]' WHEN k % 4 = 1 THEN 'urgency: [{_R}hurry{_R}]' END,
      CASE WHEN k % 6 = 0 THEN 'subscription: [{_R}free trial{_R}]' END,
      CASE WHEN k % 9 = 0 THEN 'hints: [{_R}must register{_R}]' END), ''), 'no signals found')
  WHEN 'screenshot' THEN CASE WHEN k % 9 <> 0 THEN 'Screenshot saved — 1280x' || (800 + k) || 'px'
    ELSE 'Screenshot failed: Timeout after 30.0s' END
  WHEN 'navigator' THEN CASE WHEN k % 2 = 0 THEN 'click' ELSE 'scroll' END || ' on {_R}button ' || (k % 3) ||
    '{_R} — landed on ' || url
  ELSE 'Plan: navigate — step ' || k END"""


def _lrepr(col):
    return f"'[' || array_to_string(list_transform({col}, lambda x: '{_R}' || x || '{_R}'), ', ') || ']'"


SQL_EVIDENCE = f"""(CASE tool
  WHEN 'scraper' THEN CASE WHEN scrape_ok THEN 'Page ' || k || ' of ' || site ELSE '' END
  WHEN 'extractor' THEN '{{{_R}urgency_texts{_R}: ' || {_lrepr('urgency_texts')} || ', {_R}subscription_keywords{_R}: ' ||
    {_lrepr('subscription_keywords')} || ', {_R}consent_accept{_R}: ' || {_lrepr('consent_accept')} ||
    ', {_R}consent_reject{_R}: ' || {_lrepr('consent_reject')} || ', {_R}dark_pattern_hints{_R}: ' ||
    {_lrepr('dark_pattern_hints')} || ', {_R}extraction_method{_R}: {_R}' || CASE WHEN k % 2 = 0 THEN 'hybrid' ELSE 'fallback' END ||
    '{_R}, {_R}language_detected{_R}: {_R}' || CASE WHEN k % 2 = 0 THEN 'en' ELSE 'unknown' END || '{_R}}}'
  WHEN 'screenshot' THEN coalesce(shot_path, '')
  WHEN 'navigator' THEN 'Landing ' || k
  ELSE '' END)"""

SQL_LOG = f"(SELECT *, {SQL_SUMMARY} AS summary, {SQL_EVIDENCE} AS evidence FROM {G.SQL_G3})"

SQL_SIGNAL = ("(len(urgency_texts) > 0 OR len(subscription_keywords) > 0 OR len(dark_pattern_hints) > 0 "
              "OR n_pre > 0 OR popup OR reject_missing)")

SQL_RUNNING = f"""(SELECT *,
  CAST(sum(CASE WHEN shot_path IS NOT NULL THEN 1 ELSE 0 END) OVER w AS BIGINT) AS shots_so_far,
  CAST(sum(CASE WHEN visited IS NOT NULL AND step = fv THEN 1 ELSE 0 END) OVER w AS BIGINT) AS visited_so_far,
  bool_or({SQL_SIGNAL}) OVER w AS signals_so_far,
  bool_or(popup) OVER w AS popup_so_far,
  bool_or(reject_missing) OVER w AS reject_missing_so_far
  FROM (SELECT *, min(step) OVER (PARTITION BY site, visited) AS fv FROM {SQL_LOG})
  WINDOW w AS (PARTITION BY site ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

SQL_RUN_ENOUGH = f"""(SELECT *, (shots_so_far > 0 AND visited_so_far > 0 AND step >= 6 AND signals_so_far) AS enough
  FROM {SQL_RUNNING})"""

SQL_INV = f"""(SELECT r.* FROM {SQL_RUN_ENOUGH} r JOIN (SELECT site, min(CASE WHEN enough THEN step END) AS stop_step
   FROM {SQL_RUN_ENOUGH} GROUP BY site) s USING (site) WHERE r.step <= least(coalesce(s.stop_step, 10), 10))"""

SQL_INV_ALL = f"""(SELECT r.* FROM {SQL_RUN_ENOUGH} r JOIN (SELECT site, min(CASE WHEN enough THEN step END) AS stop_step
   FROM {SQL_RUN_ENOUGH} GROUP BY site) s USING (site) WHERE r.step <= coalesce(s.stop_step, r.step))"""


def _log(spark, d):
    return G.g3_log(spark, d)


def _raw_log(spark, d):
    """The log without step numbers (for order-free aggregates)."""
    return G.g3_log(spark, d, numbered=False)


def _out_log(df):
    return df.select("site", L("seq").alias("seq"), "tool", "summary", "evidence")


# --- records ---------------------------------------------------------------------
@query("set_log_union", f"SELECT site, seq, tool, summary, evidence FROM {SQL_LOG}")
def q_set_log_union(spark, d):
    return _out_log(G.g3_log(spark, d, numbered=False))


def _rec(name, tool, fn, idx):
    """One producer's log records (rec_* queries): producer table -> log rows."""
    def q(spark, d):
        parts = G.g3_parts(G.g3_events(spark, d))
        return _out_log(fn(parts[idx]))
    query(name, f"SELECT site, seq, tool, summary, evidence FROM {SQL_LOG} WHERE tool = '{tool}'")(q)


_rec("rec_scrape_log", "scraper", E.scrape_log, 0)
_rec("rec_extract_log", "extractor", E.extract_log, 1)
_rec("rec_screenshot_log", "screenshot", E.screenshot_log, 2)
_rec("rec_navigation_log", "navigator", E.navigation_log, 3)
_rec("rec_agent_log", "agent", E.agent_log, 4)


@query("sink_findings_log", f"SELECT site, seq, tool, CAST(step AS BIGINT) AS step FROM {SQL_LOG}")
def q_sink_findings_log(spark, d):
    """Append the numbered log to a day-partitioned table in the shared folder, read it back."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    import uuid
    path = f"{base}/evidence_log_{uuid.uuid4().hex}"
    write_log(_log(spark, d), path)
    return spark.read.parquet(path).select("site", L("seq").alias("seq"), "tool", L("step").alias("step"))


# --- steps and running state -----------------------------------------------------------
@query("win_step_number", f"SELECT site, seq, CAST(step AS BIGINT) AS step FROM {SQL_LOG}")
def q_win_step_number(spark, d):
    return _log(spark, d).select("site", L("seq").alias("seq"), L("step").alias("step"))


@query("win_running_evidence", f"""SELECT site, CAST(step AS BIGINT) AS step, shots_so_far, visited_so_far, signals_so_far,
  popup_so_far, reject_missing_so_far, enough FROM {SQL_RUN_ENOUGH}""")
def q_win_running_evidence(spark, d):
    r = E.running_evidence(_raw_log(spark, d))
    return r.select("site", L("step").alias("step"), L("shots_so_far").alias("shots_so_far"),
                    L("visited_so_far").alias("visited_so_far"), "signals_so_far", "popup_so_far",
                    "reject_missing_so_far", "enough")


@query("win_stop_step", f"""SELECT site, CAST(min(CASE WHEN enough THEN step END) AS BIGINT) AS stop_step
  FROM {SQL_RUN_ENOUGH} GROUP BY site""")
def q_win_stop_step(spark, d):
    return E.stop_steps(E.running_evidence(_raw_log(spark, d))).select("site", L("stop_step").alias("stop_step"))


@query("win_step_cap", f"SELECT site, CAST(step AS BIGINT) AS step, tool FROM {SQL_INV}")
def q_win_step_cap(spark, d):
    return E.investigation(_log(spark, d), cap=10).select("site", L("step").alias("step"), "tool")


@query("win_last_scrape_text", f"""SELECT site, CAST(step AS BIGINT) AS step, coalesce(last_value(CASE WHEN tool = 'scraper'
    THEN evidence END IGNORE NULLS) OVER (PARTITION BY site ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')
    AS last_scrape_text FROM {SQL_LOG} QUALIFY tool <> 'scraper'""")
def q_win_last_scrape_text(spark, d):
    t = E.last_scrape_text(_log(spark, d))
    return t.filter(F.col("tool") != "scraper").select("site", L("step").alias("step"), "last_scrape_text")


# --- aggregates -------------------------------------------------------------------------
@query("agg_step_count", f"SELECT site, CAST(count(*) AS BIGINT) AS step_count FROM {SQL_LOG} GROUP BY site")
def q_agg_step_count(spark, d):
    return E.site_evidence(_raw_log(spark, d)).select("site", L("step_count").alias("step_count"))


@query("agg_popup", f"SELECT site, bool_or(popup) AS popup_detected FROM {SQL_LOG} GROUP BY site")
def q_agg_popup(spark, d):
    return E.site_evidence(_raw_log(spark, d)).select("site", "popup_detected")


@query("agg_reject_missing", f"SELECT site, bool_or(reject_missing) AS reject_button_missing FROM {SQL_LOG} GROUP BY site")
def q_agg_reject_missing(spark, d):
    return E.site_evidence(_raw_log(spark, d)).select("site", "reject_button_missing")


_SQL_SITE_EV = f"""(SELECT site, CAST(count(*) AS BIGINT) AS step_count, CAST(count(shot_path) AS BIGINT) AS screenshots_taken,
  CAST(count(DISTINCT visited) AS BIGINT) AS pages_visited, bool_or(popup) AS popup_detected,
  bool_or(reject_missing) AS reject_button_missing,
  CAST(sum(len(urgency_texts)) AS BIGINT) AS n_urgency_texts, CAST(sum(len(subscription_keywords)) AS BIGINT) AS n_subscription_keywords,
  CAST(sum(len(consent_accept)) AS BIGINT) AS n_consent_accept, CAST(sum(len(consent_reject)) AS BIGINT) AS n_consent_reject,
  CAST(sum(len(dark_pattern_hints)) AS BIGINT) AS n_dark_pattern_hints, CAST(sum(len(prices)) AS BIGINT) AS n_prices,
  CAST(sum(n_pre) AS BIGINT) AS n_preselected, CAST(sum(n_hid) AS BIGINT) AS n_hidden,
  CAST(sum(n_small) AS BIGINT) AS n_small_print FROM {SQL_LOG} GROUP BY site)"""


@query("agg_site_evidence", f"SELECT * FROM {_SQL_SITE_EV}")
def q_agg_site_evidence(spark, d):
    ev = E.site_evidence(_raw_log(spark, d))
    return ev.select("site", *[L(c).alias(c) if c not in ("popup_detected", "reject_button_missing") else c
                               for c in ev.columns if c != "site"])


@query("flt_enough_evidence", f"""SELECT site FROM {_SQL_SITE_EV} WHERE screenshots_taken > 0 AND pages_visited > 0
  AND step_count >= 6 AND (n_urgency_texts > 0 OR n_subscription_keywords > 0 OR n_dark_pattern_hints > 0
  OR n_preselected > 0 OR popup_detected OR reject_button_missing)""")
def q_flt_enough_evidence(spark, d):
    ev = E.site_evidence(_raw_log(spark, d))
    return ev.filter(E.enough_evidence(ev)).select("site")


_ACC_COLS = {"urgency": "urgency_texts", "subscription": "subscription_keywords", "accept": "consent_accept",
             "reject": "consent_reject", "hints": "dark_pattern_hints", "prices": "prices"}
_SQL_ACC = " UNION ALL ".join(
    f"SELECT site, '{cat}' AS category, CAST(step AS BIGINT) AS step, CAST(generate_subscripts({c}, 1) AS BIGINT) AS pos, "
    f"unnest({c}) AS value FROM {SQL_LOG}" for cat, c in _ACC_COLS.items())


@query("agg_accumulate", _SQL_ACC)
def q_agg_accumulate(spark, d):
    a = E.accumulate(_log(spark, d))
    return a.select("site", "category", L("step").alias("step"), L("pos").alias("pos"), "value")


@query("agg_distinct_signals", f"""SELECT site, category, value, min(step) AS first_step FROM ({_SQL_ACC}) GROUP BY ALL""")
def q_agg_distinct_signals(spark, d):
    a = E.distinct_signals(_log(spark, d))
    return a.select("site", "category", "value", L("first_step").alias("first_step"))


@query("agg_visited", f"""SELECT site, url, first_step, CAST(row_number() OVER (PARTITION BY site ORDER BY first_step, url) AS BIGINT)
  AS visit_order FROM (SELECT site, visited AS url, CAST(min(step) AS BIGINT) AS first_step FROM {SQL_LOG}
  WHERE visited IS NOT NULL GROUP BY ALL)""")
def q_agg_visited(spark, d):
    v = E.visited(_log(spark, d))
    return v.select("site", "url", L("first_step").alias("first_step"), L("visit_order").alias("visit_order"))


@query("agg_screenshots", f"SELECT site, CAST(step AS BIGINT) AS step, shot_path AS path FROM {SQL_LOG} WHERE shot_path IS NOT NULL")
def q_agg_screenshots(spark, d):
    return E.screenshots(_log(spark, d)).select("site", L("step").alias("step"), "path")


@query("top_screenshots", f"""SELECT site, step, path, shot_rank FROM (SELECT site, CAST(step AS BIGINT) AS step, shot_path AS path,
  CAST(row_number() OVER (PARTITION BY site ORDER BY step) AS BIGINT) AS shot_rank FROM {SQL_LOG} WHERE shot_path IS NOT NULL)
  WHERE shot_rank <= 3""")
def q_top_screenshots(spark, d):
    t = E.top_screenshots(_log(spark, d), 3)
    return t.select("site", L("step").alias("step"), "path", L("shot_rank").alias("shot_rank"))


@query("top_log_samples", f"""SELECT site, seq, summary FROM {SQL_LOG} WHERE tool IN ('scraper', 'extractor')
  AND (contains(summary, 'prices found') OR contains(summary, 'urgency:'))""")
def q_top_log_samples(spark, d):
    lg = G.g3_log(spark, d, numbered=False)
    return lg.filter(F.col("tool").isin("scraper", "extractor")
                     & (F.col("summary").contains("prices found") | F.col("summary").contains("urgency:"))) \
        .select("site", L("seq").alias("seq"), "summary")


# --- joins over the log -------------------------------------------------------------------
@query("jn_new_urls", f"""SELECT n.site, n.seq, n.url FROM {SQL_LOG} n WHERE n.tool = 'navigator' AND NOT EXISTS (
  SELECT 1 FROM {SQL_LOG} v WHERE v.site = n.site AND v.visited = n.url AND v.step < n.step)""")
def q_jn_new_urls(spark, d):
    return E.frontier(_log(spark, d)).select("site", L("seq").alias("seq"), "url")


@query("jn_flow_pages", f"""SELECT n.site, n.seq, n.url, (SELECT s.seq FROM {SQL_LOG} s WHERE s.site = n.site AND s.tool = 'scraper'
    AND s.scrape_ok AND s.url = n.url AND s.step > n.step ORDER BY s.step LIMIT 1) AS landing_seq
  FROM {SQL_LOG} n WHERE n.tool = 'navigator'""")
def q_jn_flow_pages(spark, d):
    return E.landing_scrapes(_log(spark, d)).select("site", L("seq").alias("seq"), "url",
                                                    L("landing_seq").alias("landing_seq"))


# --- summary, classification, stats ----------------------------------------------------------
_SQL_LINES = f"""WITH inv AS MATERIALIZED (SELECT * FROM {SQL_INV_ALL}),
  h AS (SELECT site, count(*) AS steps, count(shot_path) AS shots, bool_or(reject_missing) AS missing, bool_or(popup) AS popup FROM inv GROUP BY site),
  l AS (SELECT site, 0 AS section, 1 AS n, '' AS v, 'Investigation of: ' || site AS text FROM h
    UNION ALL SELECT site, 0, 2, '', 'Steps taken: ' || steps FROM h
    UNION ALL SELECT site, 0, 3, '', 'Screenshots taken: ' || shots FROM h
    UNION ALL SELECT site, 0, 4, '', 'Reject button missing: ' || CASE WHEN missing THEN 'True' ELSE 'False' END FROM h
    UNION ALL SELECT site, 0, 5, '', 'Popup detected: ' || CASE WHEN popup THEN 'True' ELSE 'False' END FROM h
    UNION ALL SELECT site, 1, min(step), visited, 'Visited: ' || visited FROM inv WHERE visited IS NOT NULL GROUP BY site, visited
    UNION ALL {" UNION ALL ".join(f"SELECT DISTINCT site, {i}, 0, x, '{label}' || x FROM (SELECT site, unnest({_ACC_COLS[c]}) AS x FROM inv)"
                                  for i, (c, label) in enumerate(E.SUMMARY_SECTIONS.items(), 2))}
    UNION ALL SELECT DISTINCT site, 8, 0, 'newsletter checkbox', 'Preselected: newsletter checkbox' FROM inv WHERE n_pre > 0
    UNION ALL SELECT DISTINCT site, 9, 0, 'token', 'Hidden input: token' FROM inv WHERE n_hid > 0
    UNION ALL SELECT site, 10, step, '', '[' || step || '] ' || upper(tool) || ': ' || summary FROM inv),
  p AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY site ORDER BY section, n, v
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 4000 AS part FROM l)"""

SQL_SUMMARY_PARTS = f"""{_SQL_LINES} SELECT site, CAST(part AS BIGINT) AS part, count(*) AS n_lines,
  string_agg(text, chr(10) ORDER BY section, n, v) AS text FROM p GROUP BY site, part"""


def _summary_parts(spark, d):
    inv = written(E.investigation(_log(spark, d)), "investigation")
    return inv, E.summary_parts(E.summary_lines(inv))


@query("agg_summary_text", SQL_SUMMARY_PARTS)
def q_agg_summary_text(spark, d):
    """The whole log of every site up to its stop step, as numbered texts of bounded size."""
    return _summary_parts(spark, d)[1].select("site", L("part").alias("part"), L("n_lines").alias("n_lines"), "text")


def _site_findings(spark, d):
    """Classify the evidence of every site's whole log (rules table)."""
    lg = _raw_log(spark, d)
    # phrases: exploded first, so the per-site set holds strings of the lexicon only
    phrases = (lg.select("site", F.explode(F.array_distinct(F.concat(
        "urgency_texts", "subscription_keywords", "consent_accept", "consent_reject"))).alias("p"))
        .groupBy("site").agg(F.array_sort(F.collect_set("p")).alias("phrases")))
    ev = lg.groupBy("site").agg(
        F.array_compact(F.array(F.when(F.max(F.size("subscription_keywords")) > 0, F.lit("subscription"))))
        .alias("categories"),
        F.bool_or(F.size("preselected") > 0).alias("has_preselected"),
        F.bool_or("reject_missing").alias("reject_button_missing"),
        F.bool_or("popup").alias("popup_detected"),
        F.bool_or(F.col("n_small_print") > 0).alias("has_small_print"))
    # one row per site on every side: no key can be hot in these joins
    ev = ev.join(phrases, "site", "left").join(E.price_changed(lg), "site", "left") \
        .withColumn("price_changed", F.coalesce("price_changed", F.lit(False)))
    return classify(ev, key="site")


_SQL_CLASSIFY = f"""WITH ph AS (SELECT DISTINCT site, unnest(list_concat(urgency_texts, subscription_keywords, consent_accept, consent_reject)) AS p FROM {SQL_LOG}),
  fl AS (SELECT site, bool_or(n_pre > 0) AS pre, bool_or(reject_missing) AS rm, bool_or(popup) AS pop, bool_or(n_small > 0) AS sm,
         bool_or(len(subscription_keywords) > 0) AS sub FROM {SQL_LOG} GROUP BY site),
  pc AS (SELECT site, list_sort(arg_min(prices, (ts, seq))) <> list_sort(arg_max(prices, (ts, seq))) AS changed
         FROM {SQL_LOG} WHERE len(prices) > 0 GROUP BY site),
  sig AS (SELECT site, 'phrase' AS kind, p AS signal FROM ph
    UNION ALL SELECT site, 'category', 'subscription' FROM fl WHERE sub
    UNION ALL SELECT site, 'flag', 'has_preselected' FROM fl WHERE pre
    UNION ALL SELECT site, 'flag', 'reject_button_missing' FROM fl WHERE rm
    UNION ALL SELECT site, 'flag', 'popup_detected' FROM fl WHERE pop
    UNION ALL SELECT site, 'flag', 'has_small_print' FROM fl WHERE sm
    UNION ALL SELECT site, 'flag', 'price_changed' FROM pc WHERE changed),
  fp AS (SELECT s.site, r.pattern, any_value(r.severity) AS severity,
      any_value(CASE WHEN r.kind = 'phrase' THEN 'urgency' ELSE r.signal END) AS instance,
      array_to_string(list_sort(list(DISTINCT s.signal)), ', ') AS evidence
    FROM sig s JOIN {G.sql_rules()} r ON r.kind = s.kind AND r.signal = s.signal GROUP BY s.site, r.pattern),
  ft AS (SELECT fp.*, tx.level, tx.strategy, CASE tx.level WHEN 'low' THEN 1 WHEN 'meso' THEN 2 ELSE 3 END AS lr
    FROM fp JOIN {G.sql_taxonomy()} tx ON tx.pattern = fp.pattern)
  SELECT site, pattern, level, strategy AS high_level_strategy, severity, evidence,
    pattern IN ('Bad Defaults', 'Privacy Zuckering', 'Forced Registration', 'Immortal Accounts') AS gdpr_risk
  FROM (SELECT ft.*, min(lr) OVER (PARTITION BY site, instance) AS mlr FROM ft) WHERE lr = mlr"""


@query("fnd_classify", lambda: _SQL_CLASSIFY)
def q_fnd_classify(spark, d):
    return _site_findings(spark, d).select("site", "pattern", "level", "high_level_strategy", "severity",
                                           "evidence", "gdpr_risk")


@query("agg_completion_counts", lambda: f"""SELECT s.site, CAST(s.step_count AS BIGINT) AS step_count,
  s.step_count || ' steps · ' || s.shots || ' screenshots · ' || coalesce(c.n, 0) || ' pattern' ||
  CASE WHEN coalesce(c.n, 0) <> 1 THEN 's' ELSE '' END || ' found' AS stats
  FROM (SELECT site, count(*) AS step_count, count(shot_path) AS shots FROM {SQL_LOG} GROUP BY site) s
  LEFT JOIN (SELECT site, count(*) AS n FROM ({_SQL_CLASSIFY}) GROUP BY site) c USING (site)""")
def q_agg_completion_counts(spark, d):
    """Steps, screenshots and findings of every site's whole log."""
    s = _raw_log(spark, d).groupBy("site").agg(F.count(F.lit(1)).alias("step_count"), F.count("shot_path").alias("shots"))
    n = _site_findings(spark, d).groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    j = s.join(n, "site", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.select("site", L("step_count").alias("step_count"),
                    E.run_stats("step_count", "shots", "n").alias("stats"))


def _sql_prompt():
    from .prompts import template
    fixed = template().replace("'", "''")
    filled = f"replace(replace('{fixed}', '{{evidence_summary}}', t.text), '{{screenshot_count}}', CAST(h.shots AS VARCHAR))"
    return f"""{_SQL_LINES} SELECT t.site, CAST(t.part AS BIGINT) AS part, CAST(length({filled}) AS BIGINT) AS prompt_chars, md5({filled}) AS prompt_md5
  FROM (SELECT site, part, string_agg(text, chr(10) ORDER BY section, n, v) AS text FROM p GROUP BY site, part) t JOIN h USING (site)"""


@query("rec_prompt", _sql_prompt)
def q_rec_prompt(spark, d):
    """Analyst prompt per part of each site's investigation summary, whole log, compared by digest."""
    inv, parts = _summary_parts(spark, d)
    shots = inv.groupBy("site").agg(F.count("shot_path").alias("screenshot_count"))
    p = analyst_prompts(parts.join(shots, "site"), "text")
    return p.select("site", L("part").alias("part"), L(F.length("prompt")).alias("prompt_chars"), F.md5("prompt").alias("prompt_md5"))


# --- screenshot files ---------------------------------------------------------------------------
SHOT_NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
              "documents", "embeddings", "pages", "benchmark", "labels", "conversations", "missing"]
_SQL_SHOT_FILE = f"list_extract({SHOT_NAMES}, step % {len(SHOT_NAMES)} + 1) || '.parquet'"


def _manifest(spark, d):
    """The logged shots; each one's file is a table of the data folder, picked by its step, or missing."""
    pick = F.element_at(F.array(*[F.lit(n) for n in SHOT_NAMES]), (F.col("step") % len(SHOT_NAMES) + 1).cast("int"))
    return E.screenshots(_log(spark, d)).select("site", "step", F.concat(F.lit(d.rstrip("/") + "/"), pick, F.lit(".parquet")).alias("path"))


def _file_name(path="path"):
    return F.element_at(F.split(path, "/"), -1)


@query("src_screenshots", f"""SELECT {_SQL_SHOT_FILE} AS file, CAST(count(*) AS BIGINT) AS n_shots, CAST(count(DISTINCT site) AS BIGINT) AS n_sites
  FROM {SQL_LOG} WHERE shot_path IS NOT NULL AND step % {len(SHOT_NAMES)} <> {len(SHOT_NAMES) - 1} GROUP BY 1""")
def q_src_screenshots(spark, d):
    """The files of the folder (no content read) with the logged shots that name them."""
    files = screenshot_files(spark, d, glob="*.parquet").select(_file_name().alias("file"))
    shots = _manifest(spark, d).groupBy(_file_name().alias("file")).agg(
        L(F.count("*")).alias("n_shots"), L(F.countDistinct("site")).alias("n_sites"))
    return files.join(shots, "file")


@query("jn_existing_shots", f"""SELECT site, CAST(step AS BIGINT) AS step, {_SQL_SHOT_FILE} AS file
  FROM {SQL_LOG} WHERE shot_path IS NOT NULL AND step % {len(SHOT_NAMES)} <> {len(SHOT_NAMES) - 1}""")
def q_jn_existing_shots(spark, d):
    """Logged shots whose file exists."""
    found = existing_shots(_manifest(spark, d), screenshot_files(spark, d, glob="*.parquet"))
    return found.select("site", L("step").alias("step"), _file_name().alias("file"))


@query("flt_scrape_ok", f"SELECT site, seq, url FROM {SQL_LOG} WHERE tool = 'scraper' AND scrape_ok")
def q_flt_scrape_ok(spark, d):
    from ..operators.dom import scraped_ok
    view = G.g3_parts(G.g3_events(spark, d))[0]
    return scraped_ok(view).select("site", L("seq").alias("seq"), "url")
