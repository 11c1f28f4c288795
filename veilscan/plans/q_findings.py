"""Findings and report queries over G6 findings from lineitem (2.A dims/sinks, 2.E, 2.F, 2.G, 2.I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import findings as FN
from ..operators import report as R
from ..operators.scan import Agg, ordered_scan
from ..session import ensure_checkpoint_dir
from ..sources import dims
from ..sources.sinks import read_report_files, report_json, write_report_files
from ..operators.signals import is_object
from ..sources.tables import read_responses, read_table
from . import fixtures as G
from .registry import L, query

_SEV = "CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"
_LR = "CASE level WHEN 'low' THEN 1 WHEN 'meso' THEN 2 ELSE 3 END"


def _enriched(spark, d):
    return G.g6_enriched(spark, d)


def _E():
    return G.sql_findings_enriched()


# --- dimensions with their use ---------------------------------------------------
@query("src_taxonomy", lambda: f"""SELECT CAST(t.ord AS BIGINT) AS ord, t.strategy, t.level, t.pattern, t.definition,
  CAST(count(f.site) AS BIGINT) AS n_findings FROM {G.sql_taxonomy()} t LEFT JOIN {_E()} f ON f.canonical_pattern = t.pattern
  GROUP BY ALL""")
def q_src_taxonomy(spark, d):
    tax = dims.taxonomy(spark)
    n = _enriched(spark, d).groupBy("canonical_pattern").agg(F.count(F.lit(1)).alias("n"))
    return (tax.join(n, tax["pattern"] == n["canonical_pattern"], "left")
            .select(L("ord").alias("ord"), "strategy", "level", "pattern", "definition",
                    L(F.coalesce("n", F.lit(0))).alias("n_findings")))


@query("src_legal_map", lambda: f"""SELECT l.legal_reference, l.legal_short, l.legal_name, l.pattern,
  CAST(count(f.site) AS BIGINT) AS n_findings FROM {G.sql_legal()} l LEFT JOIN {_E()} f ON f.canonical_pattern = l.pattern
  GROUP BY ALL""")
def q_src_legal_map(spark, d):
    lm = dims.legal_map(spark)
    n = _enriched(spark, d).groupBy("canonical_pattern").agg(F.count(F.lit(1)).alias("n"))
    return (lm.join(n, lm["pattern"] == n["canonical_pattern"], "left")
            .select("legal_reference", "legal_short", "legal_name", "pattern",
                    L(F.coalesce("n", F.lit(0))).alias("n_findings")))


@query("src_responses", "SELECT o_orderkey AS site, o_orderkey % 5 <> 4 AS is_object FROM orders")
def q_src_responses(spark, d):
    """Replies written as JSON lines to the shared folder, read back as a reply table."""
    import uuid
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/responses_{uuid.uuid4().hex}"
    G.g5_analyst_replies(spark, d).select("site", "raw").write.mode("overwrite").json(path)
    r = read_responses(spark, path, fmt="json", schema="site long, raw string")
    v = FN.response_json("raw")
    return r.select("site", is_object(v).alias("is_object"))


# --- joins with dimensions ----------------------------------------------------------
@query("jn_taxonomy", lambda: f"""SELECT l_orderkey, l_linenumber, canonical_pattern, level, high_level_strategy FROM {_E()}""")
def q_jn_taxonomy(spark, d):
    return _enriched(spark, d).select("l_orderkey", "l_linenumber", "canonical_pattern", "level", "high_level_strategy")


@query("jn_legal", lambda: f"SELECT l_orderkey, l_linenumber, array_to_string(laws, '|') AS laws, gdpr_risk FROM {_E()}")
def q_jn_legal(spark, d):
    return _enriched(spark, d).select("l_orderkey", "l_linenumber", F.array_join("laws", "|").alias("laws"), "gdpr_risk")


@query("jn_display", lambda: f"""SELECT l_orderkey, l_linenumber,
  CASE severity WHEN 'HIGH' THEN 'red' WHEN 'MEDIUM' THEN 'yellow' WHEN 'LOW' THEN 'cyan' ELSE 'white' END AS severity_color,
  CASE high_level_strategy WHEN 'Sneaking' THEN '🎭' WHEN 'Obstruction' THEN '🚧' WHEN 'Interface Interference' THEN '🎨'
    WHEN 'Forced Action' THEN '⛓️' WHEN 'Social Engineering' THEN '🧠' ELSE '•' END AS strategy_icon FROM {_E()}""")
def q_jn_display(spark, d):
    return FN.with_display(_enriched(spark, d)).select("l_orderkey", "l_linenumber", "severity_color", "strategy_icon")


# --- per-instance and per-site --------------------------------------------------------
@query("win_most_specific", lambda: f"""SELECT site, l_orderkey, l_linenumber, canonical_pattern AS pattern, level FROM
  (SELECT *, {_LR} AS lr, min({_LR}) OVER (PARTITION BY site, evidence, high_level_strategy) AS mlr FROM {_E()}) WHERE lr = mlr""")
def q_win_most_specific(spark, d):
    f = _enriched(spark, d)
    m = FN.most_specific(f, keys=("site", "evidence", "high_level_strategy"))
    return m.select("site", "l_orderkey", "l_linenumber", F.col("canonical_pattern").alias("pattern"), "level")


@query("fnd_dedupe", lambda: f"SELECT DISTINCT site, canonical_pattern AS pattern, evidence FROM {_E()}")
def q_fnd_dedupe(spark, d):
    f = FN.dedupe(_enriched(spark, d), keys=("site", "canonical_pattern", "evidence"))
    return f.select("site", F.col("canonical_pattern").alias("pattern"), "evidence")


# (l_orderkey, l_linenumber) repeats in the driver's lineitem: number in a total order
ORDER = ["l_orderkey", "l_linenumber", "pattern", "evidence", "severity", "location"]
_SQL_ORDER = ", ".join(ORDER)


def _numbered(spark, d):
    """Finding i of n per site: ordered scan for i, aggregate + join for n."""
    f = _enriched(spark, d)
    num = ordered_scan(f, "site", ORDER, [Agg("finding_no", "count")])
    tot = f.groupBy("site").agg(F.count(F.lit(1)).alias("finding_total"))
    return num.join(tot, "site")


@query("win_finding_number", lambda: f"""SELECT site, l_orderkey, l_linenumber,
  CAST(row_number() OVER (PARTITION BY site ORDER BY {_SQL_ORDER}) AS BIGINT) AS finding_no,
  CAST(count(*) OVER (PARTITION BY site) AS BIGINT) AS finding_total,
  'Finding ' || row_number() OVER (PARTITION BY site ORDER BY {_SQL_ORDER}) || ' of ' || count(*) OVER (PARTITION BY site) AS title
  FROM {_E()}""")
def q_win_finding_number(spark, d):
    n = _numbered(spark, d)
    return n.select("site", "l_orderkey", "l_linenumber", L("finding_no").alias("finding_no"),
                    L("finding_total").alias("finding_total"),
                    F.format_string("Finding %d of %d", "finding_no", "finding_total").alias("title"))


_SQL_RISK = f"""(SELECT s.site, CAST(coalesce(a.n, 0) AS BIGINT) AS pattern_count, coalesce(a.g, false) AS gdpr_concerns,
  CASE a.r WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' ELSE 'CLEAN' END AS overall_risk
  FROM (SELECT 'supplier-' || s_suppkey AS site FROM supplier) s LEFT JOIN
  (SELECT site, count(*) AS n, bool_or(gdpr_risk) AS g, max({_SEV}) AS r FROM {{E}} GROUP BY site) a USING (site))"""


def _risk(spark, d):
    sites = read_table(spark, d, "supplier").select(F.concat(F.lit("supplier-"), F.col("s_suppkey")).alias("site"))
    return FN.overall_risk(_enriched(spark, d), sites=sites)


@query("agg_overall_risk", lambda: "SELECT * FROM " + _SQL_RISK.replace("{E}", _E()))
def q_agg_overall_risk(spark, d):
    return _risk(spark, d).select("site", L("pattern_count").alias("pattern_count"), "gdpr_concerns", "overall_risk")


@query("agg_pattern_count", lambda: f"""SELECT site, CAST(count(*) AS BIGINT) AS pattern_count,
  CAST(count(DISTINCT canonical_pattern) AS BIGINT) AS distinct_patterns FROM {_E()} GROUP BY site""")
def q_agg_pattern_count(spark, d):
    f = _enriched(spark, d)
    return f.groupBy("site").agg(L(F.count(F.lit(1))).alias("pattern_count"),
                                 L(F.count_distinct("canonical_pattern")).alias("distinct_patterns"))


@query("agg_gdpr", lambda: f"SELECT site, bool_or(gdpr_risk) AS gdpr_concerns FROM {_E()} GROUP BY site")
def q_agg_gdpr(spark, d):
    return FN.overall_risk(_enriched(spark, d)).select("site", "gdpr_concerns")


# --- report columns ---------------------------------------------------------------------
@query("rpt_table", lambda: f"""SELECT l_orderkey, l_linenumber, canonical_pattern AS pattern, level,
  CASE high_level_strategy WHEN 'Sneaking' THEN '🎭' WHEN 'Obstruction' THEN '🚧' WHEN 'Interface Interference' THEN '🎨'
    WHEN 'Forced Action' THEN '⛓️' WHEN 'Social Engineering' THEN '🧠' ELSE '•' END || ' ' || high_level_strategy AS strategy_label,
  severity, left(location, 30) AS location_short, CASE WHEN gdpr_risk THEN '⚠️' ELSE '—' END AS gdpr_mark FROM {_E()}""")
def q_rpt_table(spark, d):
    f = _enriched(spark, d).withColumn("pattern", F.col("canonical_pattern"))
    t = R.findings_table(f, location_chars=30)
    return t.select("l_orderkey", "l_linenumber", "pattern", "level", "strategy_label", "severity",
                    "location_short", "gdpr_mark")


@query("rpt_details", lambda: f"""SELECT l_orderkey, l_linenumber, 'Finding ' || finding_no || ' of ' || finding_total AS title,
  concat_ws(chr(10), 'Pattern:    ' || canonical_pattern, 'Level:      ' || level,
    'Strategy:   ' || CASE high_level_strategy WHEN 'Sneaking' THEN '🎭' WHEN 'Obstruction' THEN '🚧' WHEN 'Interface Interference' THEN '🎨'
      WHEN 'Forced Action' THEN '⛓️' WHEN 'Social Engineering' THEN '🧠' ELSE '•' END || ' ' || high_level_strategy,
    'Severity:   ' || severity, 'Location:   ' || location, 'Evidence:   ' || evidence,
    CASE WHEN coalesce(legal_reference, '') <> '' THEN 'Legal ref:  ' || legal_reference END,
    'Fix:        Review ' || canonical_pattern) AS detail
  FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY {_SQL_ORDER}) AS finding_no,
    count(*) OVER (PARTITION BY site) AS finding_total FROM {_E()})""")
def q_rpt_details(spark, d):
    n = _numbered(spark, d).withColumn("pattern", F.col("canonical_pattern")) \
        .withColumn("recommendation", F.concat(F.lit("Review "), F.col("canonical_pattern")))
    return R.finding_details(n).select("l_orderkey", "l_linenumber", "title", "detail")


@query("rpt_panel", lambda: f"""SELECT site, CASE WHEN overall_risk = 'CLEAN' THEN '✅' ELSE '⚠️' END || ' Overall risk: ' || overall_risk
  || chr(10) || chr(10) || pattern_count || ' findings' || CASE WHEN gdpr_concerns THEN chr(10) || chr(10) || '⚖️  GDPR concerns detected' ELSE '' END
  AS headline, CASE overall_risk WHEN 'HIGH' THEN 'red' WHEN 'MEDIUM' THEN 'yellow' WHEN 'LOW' THEN 'cyan' WHEN 'CLEAN' THEN 'green'
  ELSE 'white' END AS border_color FROM {_SQL_RISK.replace('{E}', _E())}""")
def q_rpt_panel(spark, d):
    r = _risk(spark, d).withColumn("overall_summary", F.concat(F.col("pattern_count").cast("string"), F.lit(" findings")))
    return R.risk_headline(r).select("site", "headline", "border_color")


@query("rpt_risk_gate", lambda: f"""SELECT CAST(max(CASE overall_risk WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 1 ELSE 0 END)
  AS BIGINT) AS exit_code FROM {_SQL_RISK.replace('{E}', _E())}""")
def q_rpt_risk_gate(spark, d):
    return R.risk_gate(_risk(spark, d)).select(L("exit_code").alias("exit_code"))


# --- JSON report sink ------------------------------------------------------------------
def _site_reports(spark, d):
    """One report per site from its deduplicated findings (bounded: patterns x evidence values)."""
    f = _enriched(spark, d)
    per = f.groupBy("site", "canonical_pattern", "evidence").agg(
        F.first("level").alias("level"), F.first("high_level_strategy").alias("high_level_strategy"),
        F.max(FN.severity_rank("severity")).alias("sr"), F.min("l_linenumber").alias("line"),
        F.first("gdpr_risk").alias("gdpr_risk"), F.first("legal_reference").alias("legal_reference"))
    sev = F.when(F.col("sr") == 3, "HIGH").when(F.col("sr") == 2, "MEDIUM").otherwise("LOW")
    item = F.struct(F.col("canonical_pattern").alias("pattern"), "level", "high_level_strategy",
                    sev.alias("severity"), "evidence", F.concat(F.lit("line "), F.col("line")).alias("location"),
                    "gdpr_risk", "legal_reference",
                    F.concat(F.lit("Review "), F.col("canonical_pattern")).alias("recommendation"))
    keyed = F.struct(F.col("canonical_pattern").alias("k1"), F.col("evidence").alias("k2"), item.alias("v"))
    rep = per.groupBy("site").agg(
        F.transform(F.array_sort(F.collect_list(keyed)), lambda x: x["v"]).alias("dark_patterns_found"),
        F.max("sr").alias("r"), F.bool_or("gdpr_risk").alias("gdpr_concerns"))
    ts = read_table(spark, d, "lineitem").groupBy(F.concat(F.lit("supplier-"), F.col("l_suppkey")).alias("site")) \
        .agg(F.max("l_shipdate").alias("report_ts"))
    risk = F.when(F.col("r") == 3, "HIGH").when(F.col("r") == 2, "MEDIUM").otherwise("LOW")
    return rep.join(ts, "site").select(
        "site", F.concat(F.lit("https://"), F.col("site"), F.lit(".example")).alias("url"), "report_ts",
        risk.alias("overall_risk"), F.concat(F.size("dark_patterns_found").cast("string"), F.lit(" patterns")).alias("overall_summary"),
        "gdpr_concerns", F.size("dark_patterns_found").alias("pattern_count"), F.lit("en").alias("language_detected"),
        "dark_patterns_found")


_SQL_REPORTS = f"""WITH per AS (SELECT site, canonical_pattern, evidence, any_value(level) AS level,
    any_value(high_level_strategy) AS high_level_strategy, max({_SEV}) AS sr, min(l_linenumber) AS line,
    any_value(gdpr_risk) AS gdpr_risk, any_value(legal_reference) AS legal_reference FROM {G.sql_findings_enriched()} GROUP BY ALL),
  rep AS (SELECT site, list(struct_pack(pattern := canonical_pattern, level := level, high_level_strategy := high_level_strategy,
      severity := CASE sr WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END, evidence := evidence,
      location := 'line ' || line, gdpr_risk := gdpr_risk, legal_reference := legal_reference,
      recommendation := 'Review ' || canonical_pattern) ORDER BY canonical_pattern, evidence) AS f, max(sr) AS r, bool_or(gdpr_risk) AS g
    FROM per GROUP BY site),
  ts AS (SELECT 'supplier-' || l_suppkey AS site, max(l_shipdate) AS t FROM lineitem GROUP BY ALL)
  SELECT site, CAST(to_json(struct_pack(url := 'https://' || site || '.example', timestamp := strftime(t, '%Y%m%d_%H%M%S'),
    overall_risk := CASE r WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END, overall_summary := len(f) || ' patterns',
    gdpr_concerns := g, pattern_count := CAST(len(f) AS INTEGER), language_detected := 'en', dark_patterns_found := f)) AS VARCHAR) AS report
  FROM rep JOIN ts USING (site)"""


@query("sink_report_json", lambda: _SQL_REPORTS)
def q_sink_report_json(spark, d):
    rep = _site_reports(spark, d)
    return rep.select("site", report_json(rep).alias("report"))


@query("sink_report_files", lambda: _SQL_REPORTS.replace("SELECT site, CAST(to_json(", "SELECT 'https___' || replace(site, '-', '_') || '_example_' || "
       "strftime(t, '%Y%m%d_%H%M%S') AS report_key, CAST(to_json("))
def q_sink_report_files(spark, d):
    """One file per site's report under its key, written to the shared folder and read back by key."""
    import uuid
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/reports_{uuid.uuid4().hex}"
    write_report_files(_site_reports(spark, d), path)
    return read_report_files(spark, path).select("report_key", F.col("value").alias("report"))
