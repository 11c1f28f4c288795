"""Page-feature operators: one narrow projection over a crawl table.

``page_features`` is a single ``select``: every feature is a JVM expression of
the row's own HTML, so the stage is a scan plus a projection (no exchange) and
``html`` itself never reaches a shuffle. A page with null or empty HTML still
yields a row, marked ``scrape_success = false``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import sqlgen as S
from ..functions.entities import with_entity_maps

#: Every list and text is whole unless a limit is given (None: no limit).
DEFAULT_LIMITS = dict.fromkeys(["max_visible_text", "max_links", "max_buttons", "max_prices", "max_html", "max_meta",
                                "max_sticky", "max_small_print", "sticky_chars", "small_print_chars"])
#: The limits of the audited tool, to pass as arguments where its exact records are wanted.
AUDIT_LIMITS = {
    "max_visible_text": 8000,
    "max_links": 50,
    "max_buttons": 30,
    "max_prices": 20,
    "max_html": 5000,
    "max_meta": 300,
    "max_sticky": 5,
    "max_small_print": 10,
    "sticky_chars": 100,
    "small_print_chars": 200,
}

EMPTY_PAGE_ERROR = "Empty page: no HTML captured"


def page_ok(html_col="html"):
    h = F.col(html_col) if isinstance(html_col, str) else html_col
    return h.isNotNull() & (F.length(h) > 0)


def _status(pages: DataFrame, html_col: str, error_col: str | None):
    ok = page_ok(html_col)
    if error_col is None or error_col not in pages.columns:
        return ok, F.when(~ok, F.lit(EMPTY_PAGE_ERROR))
    ok = ok & F.col(error_col).isNull()
    return ok, F.when(~ok, F.coalesce(F.col(error_col), F.lit(EMPTY_PAGE_ERROR)))


def with_status(pages: DataFrame, html_col: str = "html", error_col: str | None = None) -> DataFrame:
    """``scrape_success``/``scrape_error`` per page; failed rows are kept, never dropped.

    ``error_col`` names a column with the crawler's own error text, if any.
    """
    ok, err = _status(pages, html_col, error_col)
    return pages.withColumn("scrape_success", ok).withColumn("scrape_error", err)


ALL_FIELDS = ("title", "meta_description", "html", "popup_detected", "visible_text", "forms",
              "preselected_checkboxes", "hidden_inputs", "links", "buttons", "prices", "sticky_elements",
              "small_print")


def features_struct_sql(html: str = "html", fields=None, **limits) -> str:
    """One struct holding every feature of a page, as Spark SQL text.

    The cleaned HTML, its text nodes and the forms are each bound once per
    row; the entity tables are bound once per row as a literal.
    """
    lim = {**DEFAULT_LIMITS, **limits}
    want = set(fields or ALL_FIELDS)

    def vis(text):
        n = lim["max_visible_text"]
        return f"substr({text}, 1, {n})" if n else text

    def with_maps(m):
        def on_clean(c):
            def on_nodes(nodes):
                def on_forms(fm):
                    parts = {
                        "visible_text": lambda: vis(f"array_join({H.stripped_sql(nodes)}, ' ')"),
                        "forms": lambda: fm,
                        "preselected_checkboxes": lambda: H.preselected_sql(fm),
                        "hidden_inputs": lambda: H.hidden_inputs_sql(fm),
                        "links": lambda: H.links_sql(c, m, lim["max_links"]),
                        "buttons": lambda: H.buttons_sql(c, m, lim["max_buttons"]),
                        "prices": lambda: H.prices_sql(f"array_join({nodes}, ' ')", lim["max_prices"]),
                        "sticky_elements": lambda: H.sticky_sql(c, m, lim["max_sticky"], lim["sticky_chars"]),
                        "small_print": lambda: H.small_print_sql(c, m, lim["max_small_print"], lim["small_print_chars"]),
                    }
                    return "named_struct(" + ", ".join(f"'{k}', {v()}" for k, v in parts.items() if k in want) + ")"
                if want & {"forms", "preselected_checkboxes", "hidden_inputs"}:
                    return S.bind(H.forms_sql(c, m), on_forms)
                return on_forms("NULL")
            if want & {"visible_text", "prices"}:
                return S.bind(H.text_nodes_sql(c, m), on_nodes)
            return on_nodes("NULL")

        raw = {
            "title": lambda: H.title_sql(html, m),
            "meta_description": lambda: H.meta_description_sql(html, m, lim["max_meta"]),
            "html": lambda: f"substr({html}, 1, {lim['max_html']})" if lim["max_html"] else html,
            "popup_detected": lambda: H.popup_sql(html, m),
        }
        body = [f"'{k}', {v()}" for k, v in raw.items() if k in want]
        if want - set(raw):
            body.append(f"'f', {S.bind(H.clean_sql(html), on_clean)}")
        return "named_struct(" + ", ".join(body) + ")"

    return with_entity_maps(with_maps)


def page_features(pages: DataFrame, keep: list[str] | None = None, html_col: str = "html",
                  url_col: str = "url", fields=None, error_col: str | None = None, **limits) -> DataFrame:
    """Whole feature record per page (``keep`` = extra key columns such as ``page_id``).

    Two projections: the first computes every feature once into one struct
    per page, the second only unpacks it (Catalyst keeps them apart because
    the struct is referenced many times). No exchange: a scan plus projections.
    """
    keep = [c for c in (keep or ["page_id"]) if c in pages.columns and c != url_col]
    ok, err = _status(pages, html_col, error_col)
    want = list(fields or ALL_FIELDS)
    feats = F.expr(features_struct_sql(f"`{html_col}`", fields=want, **limits))
    step1 = pages.select(*keep, F.col(url_col).alias("url"), ok.alias("scrape_success"), err.alias("scrape_error"),
                         F.when(ok, feats).alias("_r"))
    empty = F.array().cast("array<string>")

    def g(c, default):
        return F.coalesce(F.col(c), default)

    defaults = {
        "title": ("_r.title", F.lit("")), "meta_description": ("_r.meta_description", F.lit("")),
        "visible_text": ("_r.f.visible_text", F.lit("")), "html": ("_r.html", F.lit("")),
        "forms": ("_r.f.forms", F.array().cast(H.FORMS_TYPE)), "links": ("_r.f.links", empty),
        "buttons": ("_r.f.buttons", empty), "prices": ("_r.f.prices", empty),
        "preselected_checkboxes": ("_r.f.preselected_checkboxes",
                                   F.array().cast("array<struct<name:string,type:string>>")),
        "hidden_inputs": ("_r.f.hidden_inputs", F.array().cast("array<struct<name:string>>")),
        "popup_detected": ("_r.popup_detected", F.lit(False)),
        "sticky_elements": ("_r.f.sticky_elements", empty), "small_print": ("_r.f.small_print", empty),
    }
    return step1.select(
        *keep, "url",
        *[g(defaults[k][0], defaults[k][1]).alias(k) for k in ALL_FIELDS if k in want],
        "scrape_success", "scrape_error",
    )


def dom_tokens(pages: DataFrame, html_col: str = "html", key: str = "page_id") -> DataFrame:
    """Long table of tokens: (key, pos, kind, tag, token) for cleaned HTML.

    Every page with HTML is tokenised.
    """
    toks = pages.select(
        key, F.posexplode(H.tokens(html_col)).alias("pos", "token"))
    kind = (F.when(F.col("token").startswith("</") & F.col("token").rlike(r"^</[a-zA-Z]"), "end")
            .when(F.col("token").rlike(r"^<[a-zA-Z]"), "start").otherwise("text"))
    return toks.select(key, (F.col("pos") + 1).alias("pos"), kind.alias("kind"),
                       F.when(kind != "text", H.tag_name("token")).alias("tag"),
                       F.col("token"))


def subtree_texts(pages: DataFrame, predicate, html_col: str = "html", key: str = "page_id") -> DataFrame:
    """(key, ord, text): subtree text of every element matching ``predicate(tag, name)``.

    ``predicate`` maps SQL operands (start tag, lower-case name) to SQL text.

    The interval "tokens between an element's start and its end" is resolved
    inside each page's own row, so no pair of rows is ever formed.
    """
    texts = F.expr(with_entity_maps(lambda m: S.bind(
        H.tokens_sql(H.clean_sql(html_col)), lambda t: H.element_texts_sql(t, m, predicate))))
    return pages.select(key, F.posexplode(texts).alias("ord", "text")).withColumn(
        "ord", F.col("ord") + 1)


def scraped_ok(features: DataFrame) -> DataFrame:
    """Pages whose scrape succeeded (extraction input); failed ones stay in the log."""
    return features.filter(F.col("scrape_success"))
