"""Queries over crawl pages and generated shop/form pages (2.A sources, 2.B DOM)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..operators import dom
from ..sources.tables import read_table
from ..sources.sinks import report_key
from ..sources.tables import read_table
from . import fixtures as G
from .registry import SQL_WS, J, L, query, sql_clean, sql_unescape, sql_visible


def _pages(spark, d):
    return read_table(spark, d, "pages")


# --- sources ---------------------------------------------------------------
@query("src_pages", "SELECT page_id, url, CAST(length(html) AS BIGINT) AS n_chars, "
                    "regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages")
def q_src_pages(spark, d):
    p = _pages(spark, d)
    return p.select("page_id", "url", L(F.length("html")).alias("n_chars"),
                    F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"))


_SQL_FAILED = "(SELECT *, page_id % 7 = 0 OR page_id % 11 = 0 OR html IS NULL OR length(html) = 0 AS empty, page_id % 13 = 0 AS late FROM pages)"


@query("src_failed_pages", f"""SELECT page_id, NOT (empty OR late) AS scrape_success, CASE WHEN late THEN 'Timeout after 30.0s'
    WHEN empty THEN 'Empty page: no HTML captured' END AS scrape_error, CASE WHEN empty OR late THEN '' ELSE md5(html) END AS html_md5 FROM {_SQL_FAILED}""")
def q_src_failed_pages(spark, d):
    """A crawl in which some pages have no HTML, some an empty one and some the crawler's own error."""
    n = F.col("page_id")
    html = F.when(n % 7 == 0, F.lit(None)).when(n % 11 == 0, F.lit("")).otherwise(F.col("html"))
    crawl = _pages(spark, d).select("page_id", html.alias("html"), F.when(n % 13 == 0, F.lit("Timeout after 30.0s")).alias("crawl_error"))
    p = dom.with_status(crawl, error_col="crawl_error")
    return p.select("page_id", "scrape_success", "scrape_error", F.when(F.col("scrape_success"), F.md5("html")).otherwise(F.lit("")).alias("html_md5"))


@query("sink_report_key",
       "SELECT page_id, left(regexp_replace(url, '[^\\p{L}\\p{N}]', '_', 'g'), 50) || '_' || "
       "strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id * 3600), '%Y%m%d_%H%M%S') AS report_key, "
       "left(regexp_replace(replace(replace(url, 'https://', ''), 'http://', ''), '[^\\p{L}\\p{N}]', '_', 'g'), 50) || '_' || "
       "strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id * 3600), '%Y%m%d_%H%M%S') AS shot_key FROM pages")
def q_sink_report_key(spark, d):
    # a time-zone-free timestamp: the key does not depend on the session's zone
    base = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    p = _pages(spark, d).withColumn("ts", base + F.make_dt_interval(secs=(F.col("page_id") * 3600).cast("decimal(18,6)")))
    return p.select("page_id", report_key("url", "ts", width=50).alias("report_key"),
                    report_key("url", "ts", strip_scheme=True, width=50).alias("shot_key"))


# --- DOM over crawl pages --------------------------------------------------
@query("dom_clean", f"SELECT page_id, {sql_clean('html')} AS cleaned FROM pages")
def q_dom_clean(spark, d):
    return _pages(spark, d).select("page_id", H.clean_html("html").alias("cleaned"))


@query("dom_visible_text", f"SELECT page_id, {sql_visible('html')} AS visible_text FROM pages")
def q_dom_visible_text(spark, d):
    return _pages(spark, d).select("page_id", H.visible_text("html").alias("visible_text"))


@query("dom_html_prefix", "SELECT page_id, left(html, 5000) AS html_prefix, "
                          "CAST(length(left(html, 5000)) AS BIGINT) AS n FROM pages")
def q_dom_html_prefix(spark, d):
    return _pages(spark, d).select("page_id", F.substring("html", 1, 5000).alias("html_prefix"),
                                   L(F.length(F.substring("html", 1, 5000))).alias("n"))


_HREF = """regexp_extract_all({c}, '(?i)<a\\s[^>]*?href\\s*=\\s*"([^"]*)"', 1)"""


@query("dom_links", f"""SELECT page_id, CAST(len(l) AS BIGINT) AS n_links, array_to_string(l, ' ') AS links
  FROM (SELECT page_id, list_transform({_HREF.format(c=sql_clean('html'))}, lambda x: {sql_unescape('x')}) AS l FROM pages)""")
def q_dom_links(spark, d):
    p = _pages(spark, d).select("page_id", H.links("html").alias("l"))
    return p.select("page_id", L(F.size("l")).alias("n_links"), F.array_join("l", " ").alias("links"))


@query("fn_unescape", f"""SELECT page_id, {sql_unescape("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)")} AS title_text FROM pages""")
def q_fn_unescape(spark, d):
    p = _pages(spark, d).withColumn("raw_title", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title", 1))
    return p.select("page_id", H.unescape_text("raw_title").alias("title_text"))


@query("fn_regex_all", "SELECT page_id, array_to_string(regexp_extract_all(url, '[0-9]+', 0), ',') AS numbers, "
                       "CAST(len(regexp_extract_all(html, '<p[ >]', 0)) AS BIGINT) AS n_paragraphs FROM pages")
def q_fn_regex_all(spark, d):
    from ..functions.text import regex_all
    p = _pages(spark, d)
    return p.select("page_id", F.array_join(regex_all("url", "[0-9]+"), ",").alias("numbers"),
                    L(F.size(regex_all("html", "<p[ >]"))).alias("n_paragraphs"))


@query("fn_regex_first", "SELECT page_id, CASE WHEN regexp_matches(url, '/(en|fr|de|es)/') "
                         "THEN regexp_extract(url, '/(en|fr|de|es)/', 1) END AS lang, "
                         "TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS path_no FROM pages")
def q_fn_regex_first(spark, d):
    from ..functions.text import regex_first
    p = _pages(spark, d)
    return p.select("page_id", regex_first("url", "/(en|fr|de|es)/", 1).alias("lang"),
                    regex_first("url", "/([0-9]+)", 1).try_cast("long").alias("path_no"))


@query("udf_limits", f"""SELECT page_id, {sql_visible('html', 100)} AS visible_text,
  CAST(least(len(regexp_extract_all({sql_clean('html')}, '(?i)<a\\s[^>]*href', 0)), 2) AS BIGINT) AS n_links FROM pages""")
def q_udf_limits(spark, d):
    f = dom.page_features(_pages(spark, d), max_visible_text=100, max_links=2)
    return f.select("page_id", "visible_text", L(F.size("links")).alias("n_links"))


# --- G1 shop pages ---------------------------------------------------------
@query("dom_title", f"SELECT page_id, trim(p_name, {SQL_WS}) AS title FROM {G.SQL_G1}")
def q_dom_title(spark, d):
    return G.g1_shop_pages(spark, d).select("page_id", H.title("html").alias("title"))


@query("dom_prices", f"SELECT page_id, price_text AS prices FROM {G.SQL_G1}")
def q_dom_prices(spark, d):
    return G.g1_shop_pages(spark, d).select("page_id", J(H.prices("html")).alias("prices"))


@query("dom_buttons", f"SELECT page_id, 'Buy' || p_brand AS buttons, CAST(1 AS BIGINT) AS n_buttons FROM {G.SQL_G1}")
def q_dom_buttons(spark, d):
    p = G.g1_shop_pages(spark, d).select("page_id", H.buttons("html").alias("b"))
    return p.select("page_id", F.array_join("b", "|").alias("buttons"), L(F.size("b")).alias("n_buttons"))


@query("dom_page_features", f"""SELECT page_id, url, trim(p_name, {SQL_WS}) AS title,
  p_name || ' $' || CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) || ' Buy ' || p_brand || ' Terms apply to ' || p_type || ' more' AS visible_text,
  price_text AS prices, 'Buy' || p_brand AS buttons, '/p/' || page_id AS links,
  'Terms apply to ' || p_type AS small_print, false AS popup_detected, CAST(0 AS BIGINT) AS n_forms,
  '' AS meta_description, true AS scrape_success FROM {G.SQL_G1}""")
def q_dom_page_features(spark, d):
    f = dom.page_features(G.g1_shop_pages(spark, d))
    return f.select("page_id", "url", "title", "visible_text", J("prices").alias("prices"),
                    J("buttons").alias("buttons"), J("links").alias("links"), J("small_print").alias("small_print"),
                    "popup_detected", L(F.size("forms")).alias("n_forms"), "meta_description", "scrape_success")


@query("dom_small_print", f"""SELECT page_id, array_to_string(list_sort(list_filter(['Terms apply to ' || p_type,
    CASE WHEN false THEN '' END], lambda x: x IS NOT NULL)), '|') AS small_print FROM {G.SQL_G1}
  UNION ALL SELECT -c_custkey AS page_id, CASE WHEN 8 + c_nationkey % 6 <= 11 THEN 'Fine print for customer ' || c_custkey ELSE '' END
  FROM customer""")
def q_dom_small_print(spark, d):
    a = G.g1_shop_pages(spark, d).select("page_id", J(H.small_print("html")).alias("small_print"))
    b = G.g2_form_pages(spark, d).select((-F.col("page_id")).alias("page_id"),
                                         J(H.small_print("html")).alias("small_print"))
    return a.unionByName(b)


@query("ord_caps", f"""SELECT page_id, CAST(least(len(regexp_extract_all(html_words, '[a-z]+', 0)), 5) AS BIGINT) AS n5 FROM
  (SELECT page_id, p_name AS html_words FROM {G.SQL_G1})""")
def q_ord_caps(spark, d):
    from ..functions.text import cap
    p = G.g1_shop_pages(spark, d)
    return p.select("page_id", L(F.size(cap(F.regexp_extract_all("p_name", F.lit("[a-z]+"), F.lit(0)), 5))).alias("n5"))


# --- G2 form pages ---------------------------------------------------------
_G2 = "(SELECT c_custkey AS page_id, * FROM customer)"


@query("dom_forms", f"""SELECT page_id, CAST(1 AS BIGINT) AS n_forms, '/signup' AS action, 'post' AS method,
  CAST(3 AS BIGINT) AS n_fields, c_acctbal < 0 AS has_preselected,
  'checkbox:' || c_name || ':' || CAST(c_acctbal < 0 AS VARCHAR) || '|hidden:key:false|text:email:false' AS fields FROM {_G2}""")
def q_dom_forms(spark, d):
    f = G.g2_form_pages(spark, d).select("page_id", H.forms("html").alias("fm"))
    one = F.element_at("fm", 1)
    fields = F.array_join(F.transform(one["fields"], lambda x: F.concat_ws(
        ":", x["field_type"], x["name"], F.lower(x["preselected"].cast("string")))), "|")
    return f.select("page_id", L(F.size("fm")).alias("n_forms"), one["action"].alias("action"),
                    one["method"].alias("method"), L(F.size(one["fields"])).alias("n_fields"),
                    one["has_preselected"].alias("has_preselected"), fields.alias("fields"))


@query("dom_preselected", f"""SELECT page_id, CASE WHEN c_acctbal < 0 THEN c_name || ':checkbox' ELSE '' END AS preselected
  FROM {_G2}""")
def q_dom_preselected(spark, d):
    f = dom.page_features(G.g2_form_pages(spark, d))
    return f.select("page_id", F.array_join(F.transform("preselected_checkboxes", lambda x: F.concat_ws(
        ":", x["name"], x["type"])), "|").alias("preselected"))


@query("dom_hidden_inputs", f"SELECT page_id, 'key' AS hidden_inputs, CAST(1 AS BIGINT) AS n_hidden FROM {_G2}")
def q_dom_hidden_inputs(spark, d):
    f = dom.page_features(G.g2_form_pages(spark, d))
    return f.select("page_id", F.array_join(F.transform("hidden_inputs", lambda x: x["name"]), "|").alias("hidden_inputs"),
                    L(F.size("hidden_inputs")).alias("n_hidden"))


@query("dom_popup", f"SELECT page_id, c_nationkey % 3 = 0 AS popup_detected FROM {_G2} "
                    "UNION ALL SELECT -page_id, false FROM pages")
def q_dom_popup(spark, d):
    a = G.g2_form_pages(spark, d).select("page_id", H.popup_detected("html").alias("popup_detected"))
    b = _pages(spark, d).select((-F.col("page_id")).alias("page_id"), H.popup_detected("html").alias("popup_detected"))
    return a.unionByName(b)


@query("dom_sticky", f"""SELECT page_id, CASE WHEN c_nationkey % 2 = 0 THEN 'Offer for' || c_name ELSE '' END AS sticky
  FROM {_G2}""")
def q_dom_sticky(spark, d):
    return G.g2_form_pages(spark, d).select("page_id", J(H.sticky_elements("html")).alias("sticky"))


@query("dom_meta_description", f"SELECT page_id, c_mktsegment AS meta_description FROM {_G2} "
                               "UNION ALL SELECT -page_id, '' FROM pages")
def q_dom_meta_description(spark, d):
    a = G.g2_form_pages(spark, d).select("page_id", H.meta_description("html").alias("meta_description"))
    b = _pages(spark, d).select((-F.col("page_id")).alias("page_id"),
                                H.meta_description("html").alias("meta_description"))
    return a.unionByName(b)


# Tokens of one G2 page body: fixed shape apart from the optional pop-up div.
@query("dom_tokens", f"""SELECT page_id, CAST(CASE WHEN c_nationkey % 3 = 0 THEN 3 ELSE 2 END + 7 + 1 AS BIGINT) AS n_start,
  CAST(CASE WHEN c_nationkey % 3 = 0 THEN 1 ELSE 0 END + 6 AS BIGINT) AS n_end,
  CAST(CASE WHEN c_nationkey % 3 = 0 THEN 1 ELSE 0 END + 3 AS BIGINT) AS n_text FROM {_G2}""")
def q_dom_tokens(spark, d):
    t = dom.dom_tokens(G.g2_form_pages(spark, d))
    return t.groupBy("page_id").agg(
        L(F.sum((F.col("kind") == "start").cast("int"))).alias("n_start"),
        L(F.sum((F.col("kind") == "end").cast("int"))).alias("n_end"),
        L(F.sum((F.col("kind") == "text").cast("int"))).alias("n_text"))


@query("jn_subtree", f"""SELECT page_id, CAST(1 AS BIGINT) AS ord, 'Offer for' || c_name AS text FROM {_G2}
  UNION ALL SELECT page_id, CAST(2 AS BIGINT), 'Fine print for customer ' || c_custkey FROM {_G2}""")
def q_jn_subtree(spark, d):
    pred = lambda tag, name: f"({name} IN ('div', 'p') AND {tag} rlike 'style=')"
    return dom.subtree_texts(G.g2_form_pages(spark, d), pred).select("page_id", L("ord").alias("ord"), "text")



def _unclosed_pages(spark, d):
    """Pages of parts whose small print, list items and table cells are never closed."""
    part = read_table(spark, d, "part")
    html = F.concat(
        F.lit("<body><div><p>"), F.col("p_name"), F.lit("<small>Made by "), F.col("p_brand"), F.lit(" for us</div><ul><li>"), F.col("p_type"),
        F.lit("<li style='font-size:9px'>Packed as "), F.col("p_partkey").cast("string"), F.lit("<li>plain</ul><table><tr><td style='position:fixed'>Size "),
        F.col("p_partkey").cast("string"), F.lit("<td>other</table><p>rest"))
    return part.select(F.col("p_partkey").alias("page_id"), html.alias("html"))


@query("dom_unclosed", """SELECT p_partkey AS page_id, 'Made by ' || p_brand || ' for us|Packed as ' || p_partkey || 'plain' AS small_print,
  'Size ' || p_partkey || 'other' AS sticky FROM part""")
def q_dom_unclosed(spark, d):
    """Elements that are never closed end with their parent."""
    return _unclosed_pages(spark, d).select("page_id", F.array_join(H.small_print("html"), "|").alias("small_print"),
                                            J(H.sticky_elements("html")).alias("sticky"))
