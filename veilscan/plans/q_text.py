"""Queries over texts and model replies (2.A lexicon, 2.C signals, 2.D, 2.H, 2.K)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions.text import cap, distinct_list, join_nonempty, left, lower_text, strip, union_signals
from ..operators import signals as S
from ..operators.findings import _finding_ok, parse_reports, report_status
from ..operators.scoring import rule_scorer, score_in_turn, score_texts
from ..sources import dims
from ..sources.tables import read_table
from . import fixtures as G
from .registry import SQL_WS, J, L, query

CATS = dims.CATEGORY_COLUMNS  # category -> output column


def _lexarr(category: str, languages=None) -> str:
    ph = [p for c, _, _, p in dims.lexicon_rows(languages, [category])]
    return "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in ph) + "]::VARCHAR[]"


def _sql_scan(t: str, languages=None) -> str:
    """Sorted joined phrase lists per category, like ``rule_signals`` (DuckDB)."""
    return ", ".join(
        f"array_to_string(list_sort(list_filter({_lexarr(cat, languages)}, lambda p: contains({t}, p))), '|') AS {out}"
        for cat, out in CATS.items())


def _docs(spark, d):
    return read_table(spark, d, "documents")


def _signals_out(df, key):
    return df.select(key, *[J(c).alias(c) for c in CATS.values()])


# --- lexicon sources ---------------------------------------------------------
@query("src_lexicon", lambda: f"""SELECT l.category, l.lang, CAST(l.ord AS BIGINT) AS ord, l.pattern,
  CAST(count(d.doc_id) AS BIGINT) AS n_docs
  FROM {G.sql_lexicon()} l LEFT JOIN documents d ON contains(lower(d.text), l.pattern)
  GROUP BY ALL""")
def q_src_lexicon(spark, d):
    lex = dims.lexicon(spark)
    hits = S.lexicon_hits(_docs(spark, d), "doc_id", "text", lex)
    counts = hits.groupBy("category", "pattern").agg(F.count(F.lit(1)).alias("n"))
    return (lex.join(counts, ["category", "pattern"], "left")
            .select("category", "lang", L("ord").alias("ord"), "pattern",
                    L(F.coalesce("n", F.lit(0))).alias("n_docs")))


def _bench_lexicon(spark, d):
    """User lexicon from a table: the first three words of every benchmark item."""
    b = read_table(spark, d, "benchmark")
    words = F.lower(F.regexp_extract("text", r"^(\S+\s+\S+\s+\S+)", 1))
    return b.select(F.lit("benchmark").alias("category"), F.lit("xx").alias("lang"),
                    F.col("item_id").cast("int").alias("ord"), words.alias("pattern")).filter(F.col("pattern") != "")


@query("udf_lexicon_config", """SELECT d.doc_id, b.pattern, CAST(b.ord AS BIGINT) AS ord FROM documents d
  JOIN (SELECT CAST(item_id AS INTEGER) AS ord, lower(regexp_extract(text, '^(\\S+\\s+\\S+\\s+\\S+)', 1)) AS pattern
        FROM benchmark) b ON b.pattern <> '' AND contains(lower(d.text), b.pattern)""")
def q_udf_lexicon_config(spark, d):
    lex = _bench_lexicon(spark, d)
    hits = S.lexicon_hits(_docs(spark, d), "doc_id", "text", lex)
    return hits.select("doc_id", "pattern", L("ord").alias("ord"))


# --- scans -------------------------------------------------------------------
@query("lex_scan", f"SELECT doc_id, {_sql_scan('lower(text)')} FROM documents")
def q_lex_scan(spark, d):
    return _signals_out(S.lexicon_scan(_docs(spark, d), "text"), "doc_id")


@query("lex_hits", lambda: f"""SELECT c.conv_id, c.turn, l.category, l.lang, CAST(l.ord AS BIGINT) AS ord, l.pattern
  FROM conversations c JOIN {G.sql_lexicon()} l ON contains(lower(c.text), l.pattern)""")
def q_lex_hits(spark, d):
    c = read_table(spark, d, "conversations")
    return S.lexicon_hits(c, ["conv_id", "turn"], "text").select(
        "conv_id", "turn", "category", "lang", L("ord").alias("ord"), "pattern")


@query("jn_lexicon", lambda: f"""SELECT d.doc_id, l.category, CAST(count(*) AS BIGINT) AS n_hits
  FROM documents d JOIN {G.sql_lexicon()} l ON contains(lower(d.text), l.pattern) GROUP BY ALL""")
def q_jn_lexicon(spark, d):
    out = S.lexicon_hit_counts(_docs(spark, d), "doc_id", "text", dims.lexicon(spark))
    return out.select("doc_id", "category", L("n_hits").alias("n_hits"))


@query("lex_categories", f"""SELECT conv_id, turn, {_sql_scan('lower(text)')}, '' AS dark_pattern_hints,
  'unknown' AS language_detected FROM conversations""")
def q_lex_categories(spark, d):
    c = read_table(spark, d, "conversations")
    s = c.select("conv_id", "turn", S.rule_signals("text").alias("s")).select("conv_id", "turn", "s.*")
    return s.select("conv_id", "turn", *[J(c).alias(c) for c in CATS.values()],
                    J("dark_pattern_hints").alias("dark_pattern_hints"), "language_detected")


@query("lex_caps", lambda: f"""SELECT text_id, CAST(len(u) AS BIGINT) AS n_urgency, array_to_string(u, '|') AS urgency_texts FROM
  (SELECT text_id, list_slice(list_filter({_lexarr('urgency')}, lambda p: contains(lower(text), p)), 1, 10) AS u
   FROM {G.sql_g4()})""")
def q_lex_caps(spark, d):
    t = G.g4_texts(spark, d).select("text_id", cap(S.scan_column("text", "urgency"), 10).alias("u"))
    return t.select("text_id", L(F.size("u")).alias("n_urgency"), F.array_join("u", "|").alias("urgency_texts"))


@query("sig_union_language", lambda: f"SELECT text_id, {_sql_scan('lower(text)', ['tr'])} FROM {G.sql_g4()}")
def q_sig_union_language(spark, d):
    t = G.g4_texts(spark, d)
    lex = dims.lexicon_rows(["tr"])
    s = t.select("text_id", S.rule_signals("text", lex).alias("s")).select("text_id", "s.*")
    return _signals_out(s, "text_id")


# --- scalar text functions -------------------------------------------------------
@query("txt_truncate", "SELECT doc_id, CAST(length(left(text, 6000)) AS BIGINT) AS n6000, "
                       "CAST(length(left(text, 500)) AS BIGINT) AS n500, left(text, 30) AS head30, "
                       "left(text, 50) AS head50 FROM documents")
def q_txt_truncate(spark, d):
    t = _docs(spark, d)
    return t.select("doc_id", L(F.length(left("text", 6000))).alias("n6000"),
                    L(F.length(left("text", 500))).alias("n500"), left("text", 30).alias("head30"),
                    left("text", 50).alias("head50"))


@query("fn_lower", "SELECT doc_id, md5(lower(text)) AS lower_md5, "
                   "CAST(length(lower(text)) AS BIGINT) AS n FROM documents")
def q_fn_lower(spark, d):
    t = _docs(spark, d)
    return t.select("doc_id", F.md5(lower_text("text")).alias("lower_md5"),
                    L(F.length(lower_text("text"))).alias("n"))


@query("fn_strip", f"SELECT conv_id, turn, CAST(length(trim(text, {SQL_WS})) AS BIGINT) AS n_stripped, "
                   f"md5(trim(text, {SQL_WS})) AS stripped_md5 FROM conversations")
def q_fn_strip(spark, d):
    c = read_table(spark, d, "conversations")
    return c.select("conv_id", "turn", L(F.length(strip("text"))).alias("n_stripped"),
                    F.md5(strip("text")).alias("stripped_md5"))


@query("fn_join_nonempty", """SELECT c_custkey, coalesce(nullif(concat_ws(', ',
    CASE WHEN c_acctbal < 0 THEN 'negative balance' END, CASE WHEN c_nationkey % 3 = 0 THEN 'popup detected' END),
    ''), 'no red flags') AS summary FROM customer""")
def q_fn_join_nonempty(spark, d):
    c = read_table(spark, d, "customer")
    parts = [F.when(F.col("c_acctbal") < 0, F.lit("negative balance")),
             F.when(F.col("c_nationkey") % 3 == 0, F.lit("popup detected"))]
    return c.select("c_custkey", join_nonempty(parts, "no red flags").alias("summary"))


@query("set_distinct", "SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), '|') AS words, "
                       "CAST(len(list_distinct(string_split(p_name, ' '))) AS BIGINT) AS n_words FROM part")
def q_set_distinct(spark, d):
    p = read_table(spark, d, "part").select("p_partkey", distinct_list(F.split("p_name", " ")).alias("w"))
    return p.select("p_partkey", J("w").alias("words"), L(F.size("w")).alias("n_words"))


# --- model replies (G5) ------------------------------------------------------
@query("rsp_extract_json", """SELECT o_orderkey AS text_id, (o_orderkey % 6 <> 5) AS parsed,
  CASE WHEN o_orderkey % 6 IN (0, 1, 2, 3) THEN o_orderpriority END AS first_urgency,
  CASE WHEN o_orderkey % 6 IN (0, 1, 2, 4) THEN 'en' END AS language FROM orders""")
def q_rsp_extract_json(spark, d):
    r = G.g5_signal_replies(spark, d).withColumn("v", S.response_json("raw"))
    return r.select("text_id", F.col("v").isNotNull().alias("parsed"),
                    F.try_variant_get("v", "$.urgency_texts[0]", "string").alias("first_urgency"),
                    F.try_variant_get("v", "$.language_detected", "string").alias("language"))


@query("rsp_planner_json", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 IN (0, 1) THEN 'scrape' END AS tool,
  CASE WHEN o_orderkey % 3 IN (0, 1) THEN 'order ' || o_orderkey END AS reason FROM orders""")
def q_rsp_planner_json(spark, d):
    r = G.g5_planner_replies(spark, d).withColumn("v", S.response_json("raw", mode="prefix"))
    return r.select("o_orderkey", F.try_variant_get("v", "$.tool", "string").alias("tool"),
                    F.try_variant_get("v", "$.reason", "string").alias("reason"))


@query("rsp_validate_signals", "SELECT o_orderkey AS text_id, (o_orderkey % 6 IN (0, 1, 2)) AS valid FROM orders")
def q_rsp_validate_signals(spark, d):
    r = G.g5_signal_replies(spark, d)
    return r.select("text_id", F.coalesce(S.valid_signals(S.response_json("raw")), F.lit(False)).alias("valid"))


def _g4_model(spark, d):
    """G4 texts with the G5 reply of the same key (left join: texts without reply stay)."""
    t = G.g4_texts(spark, d)
    r = G.g5_signal_replies(spark, d).select("text_id", "raw")
    return t, r


_SQL_MODEL = """(SELECT o_orderkey AS text_id, o_orderkey % 6 IN (0, 1, 2) AS valid,
   [o_orderpriority] AS m_urgency, CASE WHEN o_orderstatus = 'O' THEN ['accept all'] ELSE []::VARCHAR[] END AS m_accept,
   ['order ' || o_orderkey] AS m_hints FROM orders)"""


def _sql_rule(cat, t="lower(g.text)"):
    return f"list_filter({_lexarr(cat)}, lambda p: contains({t}, p))"


@query("sig_merge", lambda: f"""SELECT g.text_id,
  array_to_string(list_sort(list_distinct(list_concat(m.m_urgency, {_sql_rule('urgency')}))), '|') AS urgency_texts,
  array_to_string(list_sort(list_distinct(list_concat(m.m_accept, {_sql_rule('consent_accept')}))), '|') AS consent_accept,
  array_to_string(list_sort(m.m_hints), '|') AS dark_pattern_hints
  FROM {G.sql_g4()} g JOIN {_SQL_MODEL} m ON m.text_id = g.text_id WHERE m.valid""")
def q_sig_merge(spark, d):
    t, r = _g4_model(spark, d)
    j = t.join(r, "text_id").withColumn("v", S.response_json("raw")).filter(S.valid_signals("v"))
    m = j.select("text_id", S.merge_signals(S.model_signals("v"), S.rule_signals("text")).alias("s"))
    return m.select("text_id", J("s.urgency_texts").alias("urgency_texts"),
                    J("s.consent_accept").alias("consent_accept"), J("s.dark_pattern_hints").alias("dark_pattern_hints"))


@query("set_union_signals", lambda: f"""SELECT g.text_id,
  array_to_string(list_sort(list_distinct(list_concat(m.m_urgency, {_sql_rule('urgency')}))), '|') AS urgency_union
  FROM {G.sql_g4()} g JOIN {_SQL_MODEL} m ON m.text_id = g.text_id""")
def q_set_union_signals(spark, d):
    t, r = _g4_model(spark, d)
    j = t.join(r, "text_id").withColumn("v", S.response_json("raw"))
    model_u = F.coalesce(F.try_variant_get("v", "$.urgency_texts", "array<string>"), F.array().cast("array<string>"))
    # a string-valued list is one element for the union (the raw value, unvalidated)
    model_u = F.when(F.schema_of_variant(F.try_variant_get("v", "$.urgency_texts", "variant")) == "STRING",
                     F.array(F.try_variant_get("v", "$.urgency_texts", "string"))).otherwise(model_u)
    model_u = F.when(F.col("v").isNull(), F.array(F.split_part(F.col("raw"), F.lit('"'), F.lit(4)))).otherwise(model_u)
    return j.select("text_id", J(union_signals(model_u, S.scan_column("text", "urgency"))).alias("urgency_union"))


def _sql_union(model, rule):
    return f"list_concat({model}, list_filter({rule}, lambda p: NOT list_contains({model}, p)))"


@query("sig_extract", lambda: f"""SELECT g.text_id,
  array_to_string(list_sort(CASE WHEN m.valid THEN {_sql_union('m.m_urgency', _sql_rule('urgency'))} ELSE {_sql_rule('urgency')} END), '|') AS urgency_texts,
  array_to_string(list_sort({_sql_rule('subscription')}), '|') AS subscription_keywords,
  array_to_string(list_sort(CASE WHEN m.valid THEN {_sql_union('m.m_accept', _sql_rule('consent_accept'))} ELSE {_sql_rule('consent_accept')} END), '|') AS consent_accept,
  array_to_string(list_sort({_sql_rule('consent_reject')}), '|') AS consent_reject,
  CASE WHEN m.valid THEN array_to_string(m.m_hints, '|') ELSE '' END AS dark_pattern_hints,
  CASE WHEN m.valid THEN 'hybrid' ELSE 'fallback' END AS extraction_method,
  CASE WHEN m.valid THEN 'en' ELSE 'unknown' END AS language_detected
  FROM {G.sql_g4()} g LEFT JOIN {_SQL_MODEL} m ON m.text_id = g.text_id""")
def q_sig_extract(spark, d):
    t, r = _g4_model(spark, d)
    out = S.extract_signals(t.select("text_id", "text"), "text", "text_id", responses=r)
    return out.select("text_id", *[J(c).alias(c) for c in dims.SIGNAL_COLUMNS], "extraction_method",
                      "language_detected")


@query("jn_signals_pages", lambda: f"""SELECT g.text_id, m.text_id IS NOT NULL AS has_reply,
  coalesce(m.valid, false) AS valid FROM {G.sql_g4()} g LEFT JOIN {_SQL_MODEL} m ON m.text_id = g.text_id""")
def q_jn_signals_pages(spark, d):
    t, r = _g4_model(spark, d)
    j = t.select("text_id").join(r, "text_id", "left")
    return j.select("text_id", F.col("raw").isNotNull().alias("has_reply"),
                    F.coalesce(S.valid_signals(S.response_json("raw")), F.lit(False)).alias("valid"))


@query("flt_reject_missing", lambda: f"""SELECT text_id FROM {G.sql_g4()} g
  WHERE len({_sql_rule('consent_accept', 'lower(text)')}) > 0 AND len({_sql_rule('consent_reject', 'lower(text)')}) = 0""")
def q_flt_reject_missing(spark, d):
    t = G.g4_texts(spark, d)
    s = t.select("text_id", S.rule_signals("text").alias("s")).select("text_id", "s.*")
    return s.filter(S.reject_missing_flag()).select("text_id")


# --- analyst replies (G5) ------------------------------------------------------
@query("fnd_parse", """SELECT o_orderkey AS site,
  CASE o_orderkey % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'CLEAN' ELSE 'UNKNOWN' END AS overall_risk,
  CASE WHEN o_orderkey % 5 IN (0, 1) THEN 'Order ' || o_orderkey || ' audit' ELSE 'Analysis failed.' END AS overall_summary,
  o_orderkey % 5 = 0 AS gdpr_concerns,
  CAST(CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 0 END AS BIGINT) AS pattern_count,
  o_orderkey % 5 IN (0, 1) AS analysis_success,
  CASE o_orderkey % 5 WHEN 2 THEN 'Invalid response structure from LLM' WHEN 3 THEN 'Report construction failed'
    WHEN 4 THEN 'All backends failed' END AS analysis_error,
  CAST(CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 0 END AS BIGINT) AS n_findings,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Bad Defaults|Countdown Timer' ELSE '' END AS patterns,
  CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderstatus = 'F' THEN 'HIGH|HIGH' ELSE 'HIGH|MEDIUM' END ELSE '' END AS severities
  FROM orders""")
def q_fnd_parse(spark, d):
    rep = parse_reports(G.g5_analyst_replies(spark, d), "site")
    f = F.col("dark_patterns_found")
    return rep.select("site", "overall_risk", "overall_summary", "gdpr_concerns", L("pattern_count").alias("pattern_count"),
                      "analysis_success", "analysis_error", L(F.size(f)).alias("n_findings"),
                      J(F.transform(f, lambda x: x["pattern"])).alias("patterns"),
                      J(F.transform(f, lambda x: x["severity"])).alias("severities"))


@query("fnd_failure", """SELECT o_orderkey AS site, CASE o_orderkey % 5 WHEN 2 THEN 'Invalid response structure from LLM'
    WHEN 3 THEN 'Report construction failed' ELSE 'All backends failed' END AS analysis_error,
  'UNKNOWN' AS overall_risk FROM orders WHERE o_orderkey % 5 IN (2, 3, 4)""")
def q_fnd_failure(spark, d):
    rep = parse_reports(G.g5_analyst_replies(spark, d), "site")
    return rep.filter(~F.col("analysis_success")).select("site", "analysis_error", "overall_risk")


@query("flt_finding_valid", """SELECT o_orderkey AS site, CAST(n AS BIGINT) AS finding_no,
  NOT (o_orderkey % 5 = 3 AND n = 2) AS valid
  FROM orders, (VALUES (1), (2)) AS t(n) WHERE o_orderkey % 5 IN (0, 2, 3)""")
def q_flt_finding_valid(spark, d):
    r = G.g5_analyst_replies(spark, d).select("site", report_status("raw").alias("s"))
    items = F.try_variant_get("s.v", "$.dark_patterns_found", "array<variant>")
    return r.select("site", F.posexplode(items).alias("i", "f")).select(
        "site", L(F.col("i") + 1).alias("finding_no"), _finding_ok(F.col("f")).alias("valid"))


# --- extension surface -----------------------------------------------------------
def _sql_scorer():
    arr = _lexarr("urgency")
    return f"""SELECT doc_id, true AS valid,
  array_to_string(list_filter({arr}, lambda p: contains(lower(text), p)), '|') AS urgency FROM documents"""


def _sql_chain():
    arr = _lexarr("urgency")
    n = "length(coalesce(text, ''))"
    return f"""SELECT doc_id, CASE WHEN {n} % 3 = 0 OR {n} % 4 = 1 THEN 'rules' ELSE 'first' END AS backend,
  CASE WHEN {n} % 3 = 0 THEN 'first: refused ' || {n} WHEN {n} % 4 = 1 THEN 'first: no valid reply' END AS error,
  CASE WHEN {n} % 3 = 0 OR {n} % 4 = 1 THEN array_to_string(list_filter({arr}, lambda p: contains(lower(coalesce(text, '')), p)), '|')
       ELSE 'n' || {n} END AS urgency FROM documents"""


def _picky(texts):
    """A scorer that refuses some texts and answers others with prose."""
    out = []
    for t in texts.fillna(""):
        if len(t) % 3 == 0:
            raise ValueError(f"refused {len(t)}")
        out.append("no idea" if len(t) % 4 == 1 else f'{{"urgency_texts": ["n{len(t)}"]}}')
    return pd.Series(out, index=texts.index)


@query("udf_scorer_chain", _sql_chain)
def q_udf_scorer_chain(spark, d):
    """Two scorers in turn: the second only for texts that the first refuses or answers without an object."""
    raw = score_in_turn(_docs(spark, d), "doc_id", [("first", _picky), ("rules", rule_scorer())], "text")
    v = S.response_json("raw")
    return raw.select("doc_id", "backend", "error", F.array_join(F.try_variant_get(v, "$.urgency_texts", "array<string>"), "|").alias("urgency"))


@query("udf_scorer", _sql_scorer)
def q_udf_scorer(spark, d):
    """Default scorer over all documents (Arrow batches), replies parsed and validated."""
    raw = score_texts(_docs(spark, d), "doc_id", "text")
    v = S.response_json("raw")
    return raw.select("doc_id", S.valid_signals(v).alias("valid"),
                      F.array_join(F.try_variant_get(v, "$.urgency_texts", "array<string>"), "|").alias("urgency"))

