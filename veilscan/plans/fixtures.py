"""Generated fixtures: page HTML, texts, logs and replies built from the driver tables.

Each ``g*`` function builds the input with Spark from whole driver tables
(so the work grows with them); each ``sql_g*`` string builds the same rows in
DuckDB for the oracles, which then compute the expected answer from the
columns, never from the HTML or JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import dims
from ..sources.tables import read_table


def _k(props="props"):
    return F.get_json_object(F.col(props), "$.k").cast("int")


SQL_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


def sql_values(rows, cols) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return str(v)
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(lit(x) for x in v) + "]"
        return "'" + str(v).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(cols)}))"


def sql_lexicon(languages=None, categories=None) -> str:
    return sql_values(dims.lexicon_rows(languages, categories), ["category", "lang", "ord", "pattern"])


# ---------------------------------------------------------------------------
# G1: shop pages from part
# ---------------------------------------------------------------------------
def g1_shop_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    html = F.concat(
        F.lit("<!DOCTYPE html><html><head><title> "), F.col("p_name"),
        F.lit(" </title><style>.p{}</style></head><body><h1>"), F.col("p_name"),
        F.lit("</h1><span class=\"price\">$"), price,
        F.lit("</span><button type=\"button\"> Buy <b>"), F.col("p_brand"),
        F.lit("</b></button><button> </button><small>Terms apply to "), F.col("p_type"),
        F.lit("</small><a href=\"/p/"), F.col("p_partkey").cast("string"), F.lit("\">more</a></body></html>"))
    return p.select(F.col("p_partkey").alias("page_id"),
                    F.concat(F.lit("https://shop.example/p/"), F.col("p_partkey")).alias("url"),
                    html.alias("html"), "p_name", "p_brand", "p_type", "p_retailprice")


SQL_G1 = """(SELECT p_partkey AS page_id, 'https://shop.example/p/' || p_partkey AS url,
  p_name, p_brand, p_type, p_retailprice,
  '$' || CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS price_text FROM part)"""


# ---------------------------------------------------------------------------
# G2: form pages from customer
# ---------------------------------------------------------------------------
def g2_form_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    nk = F.col("c_nationkey")
    html = F.concat(
        F.lit("<html><head><meta charset=\"utf-8\"><meta name=\"description\" content=\""),
        F.col("c_mktsegment"), F.lit("\"><title>Account</title></head><body>"),
        F.when(nk % 3 == 0, F.lit("<div class=\"my-modal\" id=\"dlg\">Join now</div>")).otherwise(F.lit("")),
        F.lit("<form action=\"/signup\" method=\"post\"><input type=\"checkbox\" name=\""), F.col("c_name"),
        F.lit("\""), F.when(F.col("c_acctbal") < 0, F.lit(" checked")).otherwise(F.lit("")),
        F.lit("><input type=\"hidden\" name=\"key\" value=\""), F.col("c_custkey").cast("string"),
        F.lit("\"><input name=\"email\" value=\"checked\"></form><input checked name=\"stray\">"),
        F.lit("<div style=\"position: "), F.when(nk % 2 == 0, F.lit("fixed")).otherwise(F.lit("static")),
        F.lit("; top: 0\">Offer for <b>"), F.col("c_name"), F.lit("</b></div>"),
        F.lit("<p style=\"font-size:"), (F.lit(8) + nk % 6).cast("string"),
        F.lit("px\">Fine print for customer "), F.col("c_custkey").cast("string"),
        F.lit("</p></body></html>"))
    return c.select(F.col("c_custkey").alias("page_id"),
                    F.concat(F.lit("https://bank.example/u/"), F.col("c_custkey")).alias("url"),
                    html.alias("html"), "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


# ---------------------------------------------------------------------------
# G3: evidence log from events
# ---------------------------------------------------------------------------
def g3_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Five producers filter this one table: spreading it first would put each
    # filter below its own round-robin exchange (five shuffles of one file).
    # The log's own exchanges (range partitioning, per-site aggregates) spread it.
    e = read_table(spark, sf_dir, "events", balance=False)
    return e.select("event_id", "ts", "user_id", "event_type", _k().alias("k"),
                    F.concat(F.lit("https://site"), F.col("user_id"), F.lit(".example")).alias("site"))


def g3_parts(ev: DataFrame):
    """The five producer tables (features, signals, shots, navigations, agent notes)."""
    k = F.col("k")
    empty = F.array().cast("array<string>")
    view = ev.filter(F.col("event_type") == "view").select(
        "site", "ts", F.col("event_id").alias("seq"),
        F.concat(F.col("site"), F.lit("/p"), (k % 5).cast("string")).alias("url"),
        (k % 13 != 0).alias("scrape_success"),
        F.when(k % 13 == 0, F.lit("Timeout after 30.0s")).alias("scrape_error"),
        F.when(k % 3 == 0, F.array(F.concat(F.lit("$"), k.cast("string"), F.lit(".99")))).otherwise(empty).alias("prices"),
        F.when(k % 11 == 0, F.array(F.struct(F.lit("newsletter").alias("name"), F.lit("checkbox").alias("type"))))
        .otherwise(F.array().cast("array<struct<name:string,type:string>>")).alias("preselected_checkboxes"),
        F.when(k % 4 == 0, F.array(F.struct(F.lit("token").alias("name"))))
        .otherwise(F.array().cast("array<struct<name:string>>")).alias("hidden_inputs"),
        (k % 7 == 0).alias("popup_detected"),
        F.when(k % 6 == 0, F.array(F.lit("Terms and conditions apply"))).otherwise(empty).alias("small_print"),
        F.concat(F.lit("Page "), k.cast("string"), F.lit(" of "), F.col("site")).alias("visible_text"))
    purchase = ev.filter(F.col("event_type") == "purchase").select(
        "site", "ts", F.col("event_id").alias("seq"),
        F.when(k % 4 == 0, F.array(F.lit("only"), F.lit("left"))).when(k % 4 == 1, F.array(F.lit("hurry")))
        .otherwise(empty).alias("urgency_texts"),
        F.when(k % 6 == 0, F.array(F.lit("free trial"))).otherwise(empty).alias("subscription_keywords"),
        F.when(k % 5 == 0, F.array(F.lit("accept all"))).otherwise(empty).alias("consent_accept"),
        F.when(k % 10 == 0, F.array(F.lit("reject all"))).otherwise(empty).alias("consent_reject"),
        F.when(k % 9 == 0, F.array(F.lit("must register"))).otherwise(empty).alias("dark_pattern_hints"),
        F.when(k % 2 == 0, F.lit("hybrid")).otherwise(F.lit("fallback")).alias("extraction_method"),
        F.when(k % 2 == 0, F.lit("en")).otherwise(F.lit("unknown")).alias("language_detected"))
    signup = ev.filter(F.col("event_type") == "signup").select(
        "site", "ts", F.col("event_id").alias("seq"), (k % 9 != 0).alias("success"),
        F.concat(F.lit("shots/"), F.col("user_id"), F.lit("_"), F.col("event_id"), F.lit(".png")).alias("path"),
        F.lit(1280).alias("width"), (F.lit(800) + k).alias("height"),
        F.when(k % 9 == 0, F.lit("Timeout after 30.0s")).alias("error"))
    click = ev.filter(F.col("event_type") == "click").select(
        "site", "ts", F.col("event_id").alias("seq"),
        F.concat(F.col("site"), F.lit("/p"), (k % 5 + 1).cast("string")).alias("url_after"),
        F.when(k % 2 == 0, F.lit("click")).otherwise(F.lit("scroll")).alias("action"),
        F.concat(F.lit("button "), (k % 3).cast("string")).alias("action_target"),
        F.concat(F.lit("Landing "), k.cast("string")).alias("visible_text_after"),
        F.lit(True).alias("success"))
    error = ev.filter(F.col("event_type") == "error").select(
        "site", "ts", F.col("event_id").alias("seq"),
        F.concat(F.lit("Plan: navigate — step "), k.cast("string")).alias("summary"),
        F.lit("").alias("evidence"))
    return view, purchase, signup, click, error


def g3_log(spark: SparkSession, sf_dir: str, numbered: bool = True) -> DataFrame:
    from ..operators import evidence as E
    view, purchase, signup, click, error = g3_parts(g3_events(spark, sf_dir))
    log = E.build_log(E.scrape_log(view), E.extract_log(purchase), E.screenshot_log(signup),
                      E.navigation_log(click), E.agent_log(error))
    return E.number_steps(log) if numbered else log


# DuckDB form of the G3 log: one row per event with the structured fields.
SQL_G3 = f"""(SELECT event_id AS seq, ts, user_id, event_type, k,
    'https://site' || user_id || '.example' AS site,
    CASE event_type WHEN 'view' THEN 'scraper' WHEN 'purchase' THEN 'extractor'
      WHEN 'signup' THEN 'screenshot' WHEN 'click' THEN 'navigator' ELSE 'agent' END AS tool,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS step,
    CASE WHEN event_type = 'view' THEN 'https://site' || user_id || '.example/p' || (k % 5)
         WHEN event_type = 'click' THEN 'https://site' || user_id || '.example/p' || (k % 5 + 1) END AS url,
    CASE WHEN event_type = 'view' AND k % 13 <> 0 THEN 'https://site' || user_id || '.example/p' || (k % 5)
         WHEN event_type = 'click' THEN 'https://site' || user_id || '.example/p' || (k % 5 + 1) END AS visited,
    (event_type = 'view' AND k % 13 <> 0) AS scrape_ok,
    (event_type = 'view' AND k % 13 <> 0 AND k % 7 = 0) AS popup,
    CASE WHEN event_type = 'view' AND k % 13 <> 0 AND k % 3 = 0 THEN ['$' || k || '.99'] ELSE []::VARCHAR[] END AS prices,
    CASE WHEN event_type = 'view' AND k % 13 <> 0 AND k % 11 = 0 THEN 1 ELSE 0 END AS n_pre,
    CASE WHEN event_type = 'view' AND k % 13 <> 0 AND k % 4 = 0 THEN 1 ELSE 0 END AS n_hid,
    CASE WHEN event_type = 'view' AND k % 13 <> 0 AND k % 6 = 0 THEN 1 ELSE 0 END AS n_small,
    CASE WHEN event_type <> 'purchase' THEN []::VARCHAR[] WHEN k % 4 = 0 THEN ['only', 'left']
         WHEN k % 4 = 1 THEN ['hurry'] ELSE []::VARCHAR[] END AS urgency_texts,
    CASE WHEN event_type = 'purchase' AND k % 6 = 0 THEN ['free trial'] ELSE []::VARCHAR[] END AS subscription_keywords,
    CASE WHEN event_type = 'purchase' AND k % 5 = 0 THEN ['accept all'] ELSE []::VARCHAR[] END AS consent_accept,
    CASE WHEN event_type = 'purchase' AND k % 10 = 0 THEN ['reject all'] ELSE []::VARCHAR[] END AS consent_reject,
    CASE WHEN event_type = 'purchase' AND k % 9 = 0 THEN ['must register'] ELSE []::VARCHAR[] END AS dark_pattern_hints,
    (event_type = 'purchase' AND k % 5 = 0 AND k % 10 <> 0) AS reject_missing,
    CASE WHEN event_type = 'signup' AND k % 9 <> 0 THEN 'shots/' || user_id || '_' || event_id || '.png' END AS shot_path
  FROM (SELECT *, {SQL_K} AS k FROM events))"""


# ---------------------------------------------------------------------------
# G4: phrase texts from part
# ---------------------------------------------------------------------------
def g4_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dims.lexicon_rows()
    lex = dims.local_table(spark, [(i, c, lg, p) for i, (c, lg, _, p) in enumerate(rows)],
                           "phrase_no int, category string, lang string, phrase string")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand",
                                                 (F.col("p_partkey") % len(rows)).cast("int").alias("phrase_no"))
    j = p.join(F.broadcast(lex), "phrase_no")
    phrase = F.when((F.col("p_partkey") % 2 == 0) & (F.col("lang") == "en"), F.upper("phrase")) \
        .otherwise(F.col("phrase"))
    all_urgency = " / ".join(p for c, _, _, p in rows if c == "urgency")
    extra = F.when(F.col("p_partkey") % 7 == 0, F.lit(" — " + all_urgency)).otherwise(F.lit(""))
    text = F.concat(F.lit("Item "), F.col("p_partkey").cast("string"), F.lit(": "), phrase,
                    F.lit(" for "), F.col("p_brand"), extra)
    return j.select(F.col("p_partkey").alias("text_id"), text.alias("text"), "phrase_no", "category", "lang",
                    "phrase")


def sql_g4() -> str:
    rows = dims.lexicon_rows()
    vals = sql_values([(i, c, lg, p) for i, (c, lg, _, p) in enumerate(rows)],
                      ["phrase_no", "category", "lang", "phrase"])
    all_urgency = " / ".join(p for c, _, _, p in rows if c == "urgency").replace("'", "''")
    return f"""(SELECT p.p_partkey AS text_id, l.phrase_no, l.category, l.lang, l.phrase,
      (p.p_partkey % 7 = 0) AS has_all,
      'Item ' || p.p_partkey || ': ' ||
        CASE WHEN p.p_partkey % 2 = 0 AND l.lang = 'en' THEN upper(l.phrase) ELSE l.phrase END ||
        ' for ' || p.p_brand || CASE WHEN p.p_partkey % 7 = 0 THEN ' — {all_urgency}' ELSE '' END AS text
      FROM part p JOIN {vals} l ON l.phrase_no = p.p_partkey % {len(rows)})"""


# ---------------------------------------------------------------------------
# G5: model replies from orders
# ---------------------------------------------------------------------------
def _signal_json():
    return F.concat(
        F.lit('{"urgency_texts": ["'), F.col("o_orderpriority"), F.lit('"], "subscription_keywords": [], '),
        F.lit('"consent_accept": '),
        F.when(F.col("o_orderstatus") == "O", F.lit('["accept all"]')).otherwise(F.lit("[]")),
        F.lit(', "consent_reject": [], "dark_pattern_hints": ["order '), F.col("o_orderkey").cast("string"),
        F.lit('"]'))


def g5_signal_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    j = F.concat(_signal_json(), F.lit(', "language_detected": "en"}'))
    m = F.col("o_orderkey") % 6
    raw = (F.when(m == 0, F.concat(F.lit("```json\n"), j, F.lit("\n```")))
           .when(m == 1, F.concat(F.lit("Here is the analysis: "), j))
           .when(m == 2, F.concat(j, F.lit("\nLet me know if you need more.")))
           .when(m == 3, F.concat(_signal_json(), F.lit("}")))
           .when(m == 4, F.regexp_replace(j, r'"urgency_texts": \["([^"]*)"\]', '"urgency_texts": "$1"'))
           .otherwise(F.substring(j, 1, 60)))
    return o.select(F.col("o_orderkey").alias("text_id"), raw.alias("raw"), "o_orderkey", "o_orderstatus",
                    "o_orderpriority")


def g5_planner_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    j = F.concat(F.lit('{"tool": "scrape", "args": {"url": "https://shop.example/o/'),
                 F.col("o_orderkey").cast("string"), F.lit('"}, "reason": "order '),
                 F.col("o_orderkey").cast("string"), F.lit('"}'))
    m = F.col("o_orderkey") % 3
    raw = (F.when(m == 0, F.concat(F.lit("```json\n"), j, F.lit("\n```")))
           .when(m == 1, F.concat(F.lit("```\n"), j, F.lit("\n```")))
           .otherwise(F.concat(F.lit("Sure: "), j)))
    return o.select("o_orderkey", raw.alias("raw"))


def _finding_json(pattern, level, strategy, severity, evidence, location, gdpr, legal, rec, drop_location=False):
    parts = [F.lit('{"pattern": "'), pattern, F.lit('", "level": "'), level,
             F.lit('", "high_level_strategy": "'), strategy, F.lit('", "severity": "'), severity,
             F.lit('", "evidence": "'), evidence, F.lit('"')]
    if not drop_location:
        parts += [F.lit(', "location": "'), location, F.lit('"')]
    parts += [F.lit(', "gdpr_risk": '), gdpr, F.lit(', "legal_reference": '), legal,
              F.lit(', "recommendation": "'), rec, F.lit('"}')]
    return F.concat(*parts)


def g5_analyst_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    sev2 = F.when(F.col("o_orderstatus") == "F", F.lit("HIGH")).otherwise(F.lit("MEDIUM"))
    f1 = _finding_json(F.lit("Countdown Timer"), F.lit("low"), F.lit("Social Engineering"), F.lit("HIGH"),
                       F.concat(F.lit("order "), key), F.lit("checkout"), F.lit("false"),
                       F.lit('"Consumer Protection"'), F.lit("Remove fake countdown"))
    f2 = _finding_json(F.lit("Bad Defaults"), F.lit("meso"), F.lit("Interface Interference"), sev2,
                       F.concat(F.lit("status "), F.col("o_orderstatus")), F.lit("registration form"),
                       F.lit("true"), F.lit("null"), F.lit("Require explicit opt-in"))
    f2_bad = _finding_json(F.lit("Bad Defaults"), F.lit("meso"), F.lit("Interface Interference"), sev2,
                           F.concat(F.lit("status "), F.col("o_orderstatus")), F.lit("registration form"),
                           F.lit("true"), F.lit("null"), F.lit("Require explicit opt-in"), drop_location=True)

    def report(findings, risk, count, with_summary=True):
        summary = F.concat(F.lit('"overall_summary": "Order '), key, F.lit(' audit", ')) if with_summary \
            else F.lit("")
        return F.concat(F.lit('{"dark_patterns_found": ['), findings, F.lit('], "overall_risk": "'), F.lit(risk),
                        F.lit('", '), summary,
                        F.lit('"gdpr_concerns": '), F.lit("true" if count else "false"),
                        F.lit(', "pattern_count": '), F.lit(str(count)), F.lit(', "language_detected": "en"}'))

    m = F.col("o_orderkey") % 5
    raw = (F.when(m == 0, F.concat(F.lit("```json\n"), report(F.concat(f1, F.lit(", "), f2), "HIGH", 2), F.lit("\n```")))
           .when(m == 1, report(F.lit(""), "CLEAN", 0))
           .when(m == 2, report(F.concat(f1, F.lit(", "), f2), "HIGH", 2, with_summary=False))
           .when(m == 3, report(F.concat(f1, F.lit(", "), f2_bad), "HIGH", 2))
           .otherwise(F.lit("I could not analyse this page.")))
    return o.select(F.col("o_orderkey").alias("site"), raw.alias("raw"), "o_orderkey", "o_orderstatus")


# ---------------------------------------------------------------------------
# G6: findings from lineitem
# ---------------------------------------------------------------------------
SEVERITY_BY_LINE = "CASE l_linenumber % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END"


def g6_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = dims.taxonomy_names_rows()
    nm = dims.local_table(spark, [(i, n) for i, (n, _) in enumerate(names)], "name_no int, pattern string")
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag",
        (F.col("l_partkey") % len(names)).cast("int").alias("name_no"))
    sev = F.when(F.col("l_linenumber") % 3 == 0, "HIGH").when(F.col("l_linenumber") % 3 == 1, "MEDIUM") \
        .otherwise("LOW")
    return li.join(F.broadcast(nm), "name_no").select(
        F.concat(F.lit("supplier-"), F.col("l_suppkey")).alias("site"), "l_orderkey", "l_linenumber",
        "pattern", sev.alias("severity"), F.col("l_returnflag").alias("evidence"),
        F.concat(F.lit("line "), F.col("l_linenumber")).alias("location"))


def sql_g6() -> str:
    names = dims.taxonomy_names_rows()
    vals = sql_values([(i, n) for i, (n, _) in enumerate(names)], ["name_no", "pattern"])
    return f"""(SELECT 'supplier-' || l_suppkey AS site, l_orderkey, l_linenumber, n.pattern,
       {SEVERITY_BY_LINE} AS severity, l_returnflag AS evidence, 'line ' || l_linenumber AS location
     FROM lineitem JOIN {vals} n ON n.name_no = l_partkey % {len(names)})"""


def sql_taxonomy() -> str:
    rows = [(o, s, lv, p, d) for o, s, lv, p, d, _ in dims.taxonomy_rows()]
    return sql_values(rows, ["ord", "strategy", "level", "pattern", "definition"])


def sql_taxonomy_names() -> str:
    return sql_values(dims.taxonomy_names_rows(), ["name", "canon"])


def sql_legal() -> str:
    return sql_values(dims.legal_rows(), ["legal_reference", "legal_short", "legal_name", "pattern"])


def sql_rules() -> str:
    return sql_values(dims.RULES, ["kind", "signal", "pattern", "severity", "recommendation"])


def sql_findings_enriched() -> str:
    """G6 findings with canonical pattern, taxonomy level/strategy and legal info (DuckDB)."""
    return f"""(SELECT f.*, nm.canon AS canonical_pattern, tx.level, tx.strategy AS high_level_strategy,
        coalesce(lg.laws, []) AS laws, coalesce(list_contains(lg.laws, 'GDPR'), false) AS gdpr_risk,
        lg.laws[1] AS legal_reference
      FROM {sql_g6()} f
      LEFT JOIN {sql_taxonomy_names()} nm ON nm.name = f.pattern
      LEFT JOIN {sql_taxonomy()} tx ON tx.pattern = nm.canon
      LEFT JOIN (SELECT pattern, list_sort(list(DISTINCT legal_short)) AS laws FROM {sql_legal()} GROUP BY pattern) lg
        ON lg.pattern = nm.canon)"""


def g6_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.findings import enrich_legal, enrich_taxonomy
    f = enrich_legal(enrich_taxonomy(g6_findings(spark, sf_dir)))
    return f.select("site", "l_orderkey", "l_linenumber", "pattern", "severity", "evidence", "location",
                    "canonical_pattern", F.col("tax_level").alias("level"),
                    F.col("tax_strategy").alias("high_level_strategy"), "laws",
                    F.col("gdpr_by_law").alias("gdpr_risk"),
                    F.try_element_at(F.col("laws"), F.lit(1)).alias("legal_reference"))
