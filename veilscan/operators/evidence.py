"""Evidence log and per-site accumulator.

The audited tool keeps one in-memory log per site and updates counters after
every tool call. Here the log is a table with one row per tool call, built by
``unionByName`` of five producer projections, and every counter is a
DataFrame aggregate or a running value:

* step numbers and running evidence use ``ordered_scan`` (range partitioned,
  no site ever lands whole in one task);
* scalar accumulators (counts, flags) are one ``groupBy(site)`` with map-side
  partial aggregation, so a hot site costs one row per task in the shuffle;
* list accumulators stay long-form tables (site, category, step, value); the
  distinct form is deduplicated on (site, category, value) first, which splits
  a hot site over many reducers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, join_nonempty, py_list_repr
from ..sources.scratch import written
from .scan import Agg, ordered_scan

SIGNALS = ["urgency_texts", "subscription_keywords", "consent_accept", "consent_reject",
           "dark_pattern_hints"]
LOG_COLUMNS = ["site", "ts", "seq", "tool", "summary", "evidence", "url", "visited", "scrape_ok",
               "popup", "prices", "preselected", "hidden", *SIGNALS, "reject_missing",
               "shot_path", "n_small_print"]


def _empty(kind: str = "string") -> Column:
    """Typed empty arrays (built on use: no session is needed at import)."""
    types = {"string": "array<string>", "pre": "array<struct<name:string,type:string>>",
             "hid": "array<struct<name:string>>"}
    return F.array().cast(types[kind])


MIN_STEPS = 6


def _py_str_repr(c) -> Column:
    return F.concat(F.lit("'"), col(c), F.lit("'"))


def _base(df, site, ts, seq, tool, summary, evidence, **kw) -> DataFrame:
    vals = {
        "url": F.lit(None).cast("string"), "visited": F.lit(None).cast("string"),
        "scrape_ok": F.lit(None).cast("boolean"), "popup": F.lit(False), "prices": _empty(),
        "preselected": _empty("pre"), "hidden": _empty("hid"),
        **{s: _empty() for s in SIGNALS}, "reject_missing": F.lit(False),
        "shot_path": F.lit(None).cast("string"), "n_small_print": F.lit(0),
    }
    vals.update(kw)
    return df.select(col(site).cast("string").alias("site"), col(ts).alias("ts"),
                     col(seq).cast("long").alias("seq"), F.lit(tool).alias("tool"),
                     summary.alias("summary"),
                     F.coalesce(evidence, F.lit("")).alias("evidence"),
                     *[v.alias(k) for k, v in vals.items()])


def scrape_log(features: DataFrame, site="site", ts="ts", seq="seq") -> DataFrame:
    """Log rows for scraped pages (failed pages log the error, add nothing else)."""
    ok = F.col("scrape_success")
    n_pre = F.size("preselected_checkboxes")
    parts = F.array_compact(F.array(
        F.when(n_pre > 0, F.concat(n_pre.cast("string"), F.lit(" preselected checkboxes"))),
        F.when(F.col("popup_detected"), F.lit("popup detected")),
        F.when(F.size("prices") > 0, F.concat(F.lit("prices found: "), py_list_repr(F.slice("prices", 1, 3)))),
        F.when(F.size("small_print") > 0,
               F.concat(F.size("small_print").cast("string"), F.lit(" small print elements")))))
    summary = F.when(ok, F.concat(F.lit("Scraped "), F.col("url"), F.lit(" — "),
                                  join_nonempty(parts, "no red flags"))) \
        .otherwise(F.concat(F.lit("Scrape failed: "), F.coalesce(F.col("scrape_error"), F.lit("None"))))
    return _base(features, site, ts, seq, "scraper", summary,
                 F.when(ok, F.col("visible_text")).otherwise(F.lit("")),
                 url=F.col("url"), visited=F.when(ok, F.col("url")), scrape_ok=ok,
                 popup=F.when(ok, F.col("popup_detected")).otherwise(F.lit(False)),
                 prices=F.when(ok, F.col("prices")).otherwise(_empty()),
                 preselected=F.when(ok, F.col("preselected_checkboxes")).otherwise(_empty("pre")),
                 hidden=F.when(ok, F.col("hidden_inputs")).otherwise(_empty("hid")),
                 n_small_print=F.when(ok, F.size("small_print")).otherwise(F.lit(0)))


def _dict_repr(sig_cols) -> Column:
    items = [F.concat(F.lit(f"'{c}': "), py_list_repr(c)) for c in SIGNALS]
    items += [F.concat(F.lit("'extraction_method': "), _py_str_repr("extraction_method")),
              F.concat(F.lit("'language_detected': "), _py_str_repr("language_detected"))]
    return F.concat(F.lit("{"), F.concat_ws(", ", *items), F.lit("}"))


def extract_log(signals: DataFrame, site="site", ts="ts", seq="seq") -> DataFrame:
    """Log rows for extractions; the reject-missing flag is per extraction."""
    parts = F.array_compact(F.array(
        F.when(F.size("urgency_texts") > 0, F.concat(F.lit("urgency: "), py_list_repr(F.slice("urgency_texts", 1, 2)))),
        F.when(F.size("subscription_keywords") > 0,
               F.concat(F.lit("subscription: "), py_list_repr(F.slice("subscription_keywords", 1, 2)))),
        F.when(F.size("dark_pattern_hints") > 0,
               F.concat(F.lit("hints: "), py_list_repr(F.slice("dark_pattern_hints", 1, 2))))))
    summary = F.concat(F.lit("Extraction ("), F.col("extraction_method"), F.lit(") — "),
                       join_nonempty(parts, "no signals found"))
    return _base(signals, site, ts, seq, "extractor", summary, _dict_repr(SIGNALS),
                 **{s: F.col(s) for s in SIGNALS},
                 reject_missing=(F.size("consent_accept") > 0) & (F.size("consent_reject") == 0))


def screenshot_log(shots: DataFrame, site="site", ts="ts", seq="seq") -> DataFrame:
    ok = F.col("success")
    summary = F.when(ok, F.format_string("Screenshot saved — %dx%dpx", F.col("width"), F.col("height"))) \
        .otherwise(F.concat(F.lit("Screenshot failed: "), F.coalesce(F.col("error"), F.lit("None"))))
    return _base(shots, site, ts, seq, "screenshot", summary,
                 F.when(ok, F.col("path")).otherwise(F.lit("")),
                 shot_path=F.when(ok, F.col("path")))


def navigation_log(nav: DataFrame, site="site", ts="ts", seq="seq") -> DataFrame:
    """Navigations; the landing URL counts as visited even when the action failed."""
    summary = F.concat(F.col("action"), F.lit(" on "), _py_str_repr("action_target"),
                       F.lit(" — landed on "), F.col("url_after"))
    return _base(nav, site, ts, seq, "navigator", summary, F.col("visible_text_after"),
                 url=F.col("url_after"), visited=F.col("url_after"))


def agent_log(df: DataFrame, site="site", ts="ts", seq="seq", summary="summary",
              evidence="evidence") -> DataFrame:
    ev = col(evidence) if evidence in df.columns else F.lit("")
    return _base(df, site, ts, seq, "agent", col(summary), ev)


def build_log(*logs: DataFrame) -> DataFrame:
    """One log from the five producers."""
    out = logs[0]
    for lg in logs[1:]:
        out = out.unionByName(lg)
    return out


# ---------------------------------------------------------------------------
# steps and running state
# ---------------------------------------------------------------------------
def number_steps(log: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """``step`` = 1, 2, ... per site in (ts, seq) order (skew-safe ordered scan)."""
    return ordered_scan(log, "site", ["ts", "seq"], [Agg("step", "count")], num_partitions) \
        .withColumn("step", F.col("step").cast("int"))


def _signal_flag() -> Column:
    return ((F.size("urgency_texts") > 0) | (F.size("subscription_keywords") > 0)
            | (F.size("dark_pattern_hints") > 0) | (F.size("preselected") > 0)
            | F.col("popup") | F.col("reject_missing"))


def first_visits(log: DataFrame) -> DataFrame:
    """(site, url, first_step) for every visited URL (distinct per site)."""
    return (log.filter(F.col("visited").isNotNull())
            .groupBy("site", F.col("visited").alias("url")).agg(F.min("step").alias("first_step")))


def running_evidence(log: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """Accumulator state after each step, plus ``enough``; one ordered scan.

    enough = a screenshot so far, a visited page so far, step >= 6 and any of
    urgency, subscription, hints, preselected input, popup or reject-missing.
    An unnumbered log (no ``step``) is numbered in the same scan, ordered by
    (ts, seq). Only the columns the state needs are written and scanned.
    """
    numbered = "step" in log.columns
    order = ["step"] if numbered else ["ts", "seq"]
    pos = F.struct(*[F.col(c) for c in order])
    slim = log.select("site", *order, *([] if numbered else []), "tool", "visited",
                      F.col("shot_path").isNotNull().cast("long").alias("_shot_n"),
                      _signal_flag().alias("_sig"), "popup", "reject_missing", pos.alias("_pos"))
    # read three times below, computed once
    slim = written(slim, "evidence")
    first = (slim.filter(F.col("visited").isNotNull()).groupBy("site", "visited")
             .agg(F.min("_pos").alias("_first")))
    # rows without a URL visit nothing: they bypass the join, whose key would be hot
    landed = (slim.filter(F.col("visited").isNotNull()).join(first, ["site", "visited"])
              .withColumn("_visit_n", (F.col("_pos") == F.col("_first")).cast("long")).drop("_first", "_pos"))
    flagged = landed.unionByName(slim.filter(F.col("visited").isNull()).drop("_pos").withColumn("_visit_n", F.lit(0).cast("long")))
    aggs = [Agg("shots_so_far", "sum", "_shot_n"), Agg("visited_so_far", "sum", "_visit_n"),
            Agg("signals_so_far", "any", "_sig"), Agg("popup_so_far", "any", "popup"),
            Agg("reject_missing_so_far", "any", "reject_missing")]
    if not numbered:
        aggs = [Agg("step", "count")] + aggs
    run = ordered_scan(flagged, "site", order, aggs, num_partitions)
    if not numbered:
        run = run.withColumn("step", F.col("step").cast("int"))
    enough = ((F.col("shots_so_far") > 0) & (F.col("visited_so_far") > 0)
              & (F.col("step") >= MIN_STEPS) & F.col("signals_so_far"))
    return run.withColumn("enough", enough).drop("_sig", "_shot_n", "_visit_n")


def stop_steps(running: DataFrame) -> DataFrame:
    """(site, stop_step): first step at which the evidence suffices (null: never)."""
    return running.groupBy("site").agg(F.min(F.when(F.col("enough"), F.col("step"))).alias("stop_step"))


def investigation(log: DataFrame, cap: int | None = None, num_partitions: int | None = None) -> DataFrame:
    """Steps actually taken: the whole log up to the stop step, and at most ``cap`` steps if it is given."""
    numbered = log if "step" in log.columns else number_steps(log, num_partitions)
    # the state of a step depends on earlier steps only, so a cap may come first:
    # at most ``cap`` rows of a site enter the scan and the join
    early = cap_steps(numbered, cap)
    stops = stop_steps(running_evidence(early, num_partitions))
    return (early.join(stops, "site").filter(F.col("stop_step").isNull() | (F.col("step") <= F.col("stop_step")))
            .drop("stop_step"))


def cap_steps(log: DataFrame, n: int | None = None) -> DataFrame:
    return log if n is None else log.filter(F.col("step") <= n)


def last_scrape_text(log: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """For every step: evidence of the latest scraper entry before it ('' if none).

    A non-scraper row carries no scraper evidence itself, so the running last
    value up to that row equals the one strictly before it.
    """
    w = log.withColumn("_scr", F.when(F.col("tool") == "scraper", F.col("evidence")))
    out = ordered_scan(w, "site", ["step"], [Agg("_last", "last", "_scr")], num_partitions)
    return out.withColumn("last_scrape_text", F.when(F.col("tool") == "scraper", F.lit(None))
                          .otherwise(F.coalesce(F.col("_last"), F.lit("")))).drop("_scr", "_last")


# ---------------------------------------------------------------------------
# per-site accumulators
# ---------------------------------------------------------------------------
def site_evidence(log: DataFrame) -> DataFrame:
    """Scalar accumulator per site in one aggregate (partial + final by Catalyst)."""
    return log.groupBy("site").agg(
        F.count(F.lit(1)).alias("step_count"),
        F.count("shot_path").alias("screenshots_taken"),
        F.count_distinct("visited").alias("pages_visited"),
        F.coalesce(F.bool_or("popup"), F.lit(False)).alias("popup_detected"),
        F.coalesce(F.bool_or("reject_missing"), F.lit(False)).alias("reject_button_missing"),
        *[F.sum(F.size(s)).alias("n_" + s) for s in SIGNALS],
        F.sum(F.size("prices")).alias("n_prices"),
        F.sum(F.size("preselected")).alias("n_preselected"),
        F.sum(F.size("hidden")).alias("n_hidden"),
        F.sum("n_small_print").alias("n_small_print"),
    )


def enough_evidence(ev: DataFrame) -> Column:
    has_signals = ((F.col("n_urgency_texts") > 0) | (F.col("n_subscription_keywords") > 0)
                   | (F.col("n_dark_pattern_hints") > 0) | (F.col("n_preselected") > 0)
                   | F.col("popup_detected") | F.col("reject_button_missing"))
    return ((F.col("screenshots_taken") > 0) & (F.col("pages_visited") > 0)
            & (F.col("step_count") >= MIN_STEPS) & has_signals)


LIST_COLUMNS = {"urgency": "urgency_texts", "subscription": "subscription_keywords",
                "accept": "consent_accept", "reject": "consent_reject", "hints": "dark_pattern_hints",
                "prices": "prices"}


def accumulate(log: DataFrame) -> DataFrame:
    """Concatenated lists as a long table: (site, category, step, pos, value)."""
    parts = [log.select("site", "step", F.lit(cat).alias("category"),
                        F.posexplode(c).alias("pos", "value"))
             for cat, c in LIST_COLUMNS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("pos", F.col("pos") + 1)


def distinct_signals(log: DataFrame) -> DataFrame:
    """(site, category, value, first_step): distinct accumulated strings."""
    return (accumulate(log).groupBy("site", "category", "value")
            .agg(F.min("step").alias("first_step")))


def visited(log: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """(site, url, first_step, visit_order): URLs in first-seen order."""
    fv = first_visits(log)
    return ordered_scan(fv, "site", ["first_step", "url"], [Agg("visit_order", "count")], num_partitions)


def screenshots(log: DataFrame) -> DataFrame:
    return log.filter(F.col("shot_path").isNotNull()).select("site", "step", F.col("shot_path").alias("path"))


def top_screenshots(log: DataFrame, k: int = 3, num_partitions: int | None = None) -> DataFrame:
    shots = screenshots(log)
    ranked = ordered_scan(shots, "site", ["step"], [Agg("shot_rank", "count")], num_partitions)
    return ranked.filter(F.col("shot_rank") <= k)


# ---------------------------------------------------------------------------
# summary text (over the investigation log)
# ---------------------------------------------------------------------------
def _py_repr_sorted(arr) -> Column:
    return py_list_repr(F.array_sort(F.array_distinct(arr)))


def _dict_list_repr(arr, keys) -> Column:
    items = F.transform(col(arr), lambda s: F.concat(
        F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f"'{k}': '"), s[k], F.lit("'")) for k in keys]),
        F.lit("}")))
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def evidence_summary(inv: DataFrame, start_url: str = "site") -> DataFrame:
    """Multi-line evidence summary per site (the analyst's input text).

    ``inv`` is a numbered log. A summary is one text per site and holds all of
    its steps: where a site's log may not fit into one row, use ``summary_lines``
    and ``summary_parts``. The labels are fixed values. Sets are printed sorted (the audited tool prints them in arbitrary set order).
    """
    entry = F.struct("step", "tool", "summary", "visited", "shot_path", "prices", "preselected",
                     "hidden", *SIGNALS, "popup", "reject_missing")
    agg = inv.groupBy("site").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    e = F.col("e")

    def flat(field):
        return F.flatten(F.transform(e, lambda x: x[field]))

    visited_list = F.array_distinct(F.filter(F.transform(e, lambda x: x["visited"]), lambda v: v.isNotNull()))
    shots = F.filter(F.transform(e, lambda x: x["shot_path"]), lambda v: v.isNotNull())
    # fixed values: the labels of the lines
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("Investigation of: "), F.col(start_url)),
        F.concat(F.lit("Steps taken: "), F.size(e).cast("string")),
        F.concat(F.lit("Pages visited: "), py_list_repr(visited_list)),
        F.concat(F.lit("Screenshots taken: "), F.size(shots).cast("string")),
        F.lit(""),
        F.lit("=== Accumulated signals ==="),
        F.concat(F.lit("Urgency texts: "), _py_repr_sorted(flat("urgency_texts"))),
        F.concat(F.lit("Subscription keywords: "), _py_repr_sorted(flat("subscription_keywords"))),
        F.concat(F.lit("Prices found: "), _py_repr_sorted(flat("prices"))),
        F.concat(F.lit("Preselected checkboxes: "), _dict_list_repr(flat("preselected"), ["name", "type"])),
        F.concat(F.lit("Hidden inputs: "), _dict_list_repr(flat("hidden"), ["name"])),
        F.concat(F.lit("Consent accept buttons: "), _py_repr_sorted(flat("consent_accept"))),
        F.concat(F.lit("Consent reject buttons: "), _py_repr_sorted(flat("consent_reject"))),
        F.concat(F.lit("Reject button missing: "),
                 F.when(F.exists(e, lambda x: x["reject_missing"]), "True").otherwise("False")),
        F.concat(F.lit("Popup detected: "), F.when(F.exists(e, lambda x: x["popup"]), "True").otherwise("False")),
        F.concat(F.lit("Dark pattern hints: "), _py_repr_sorted(flat("dark_pattern_hints"))),
        F.lit(""),
        F.lit("=== Investigation steps ==="),
        F.array_join(F.transform(e, lambda x: F.concat(F.lit("["), x["step"].cast("string"), F.lit("] "),
                                                       F.upper(x["tool"]), F.lit(": "), x["summary"])), "\n"),
    )
    return agg.select("site", F.size(e).alias("step_count"), F.size(shots).alias("screenshot_count"),
                      lines.alias("evidence_summary"))


#: The label of each section of a summary, in order.
SUMMARY_SECTIONS = {"urgency": "Urgency text: ", "subscription": "Subscription keyword: ", "prices": "Price found: ",
                    "accept": "Consent accept button: ", "reject": "Consent reject button: ", "hints": "Dark pattern hint: "}


def summary_lines(inv: DataFrame) -> DataFrame:
    """The evidence of every site as lines: (site, section, n, v, text), in the order of the middle three.

    Section 0 counts steps and screenshots and names the flags, 1 has the pages
    in the order of their first visit, 2 to 7 the distinct signals by category
    and value, 8 and 9 the preselected and hidden inputs, 10 the steps. Each
    line is a row, so no site is gathered in one place. ``inv`` is a numbered log.
    """
    def lines(df, section, n, v, text):
        return df.select("site", F.lit(section).alias("section"), F.lit(n).cast("long").alias("n") if isinstance(n, int) else n.cast("long").alias("n"),
                         v.alias("v"), text.alias("text"))

    head = inv.groupBy("site").agg(
        F.count("*").alias("steps"), F.count("shot_path").alias("shots"), F.bool_or("reject_missing").alias("missing"), F.bool_or("popup").alias("popup"))
    yes = {c: F.when(F.col(c), "True").otherwise("False") for c in ("missing", "popup")}
    counted = [F.concat(F.lit("Investigation of: "), F.col("site")), F.concat(F.lit("Steps taken: "), F.col("steps").cast("string")),
               F.concat(F.lit("Screenshots taken: "), F.col("shots").cast("string")),
               F.concat(F.lit("Reject button missing: "), yes["missing"]), F.concat(F.lit("Popup detected: "), yes["popup"])]
    out = [lines(head, 0, i, F.lit(""), text) for i, text in enumerate(counted, 1)]
    out.append(lines(first_visits(inv), 1, F.col("first_step"), F.col("url"), F.concat(F.lit("Visited: "), F.col("url"))))
    signals = distinct_signals(inv)
    for section, (category, label) in enumerate(SUMMARY_SECTIONS.items(), 2):
        out.append(lines(signals.filter(F.col("category") == category), section, 0, F.col("value"), F.concat(F.lit(label), F.col("value"))))
    for section, (column, label, keys) in enumerate((("preselected", "Preselected: ", ["name", "type"]), ("hidden", "Hidden input: ", ["name"])), 8):
        each = inv.select("site", F.explode(column).alias("e")).select("site", F.concat_ws(" ", *[F.col(f"e.{k}") for k in keys]).alias("v")).distinct()
        out.append(lines(each, section, 0, F.col("v"), F.concat(F.lit(label), F.col("v"))))
    step = F.concat(F.lit("["), F.col("step").cast("string"), F.lit("] "), F.upper("tool"), F.lit(": "), F.col("summary"))
    out.append(lines(inv, 10, F.col("step"), F.lit(""), step))
    return build_log(*out)


def summary_parts(lines: DataFrame, limit: int = 4000, num_partitions: int | None = None) -> DataFrame:
    """(site, part, n_lines, text): a site's lines joined to numbered texts.

    A line belongs to the part of ``limit`` characters in which it starts, so a
    part is bounded by ``limit`` and one line, whatever the site's size; where
    it starts is a running sum of the ordered scan.
    """
    sized = lines.withColumn("size", (F.length("text") + 1).cast("long"))
    placed = ordered_scan(sized, "site", ["section", "n", "v"], [Agg("line", "count"), Agg("before", "sum", "size", frame="before")], num_partitions)
    part = F.floor(F.coalesce("before", F.lit(0)) / limit)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return placed.groupBy("site", part.alias("part")).agg(F.count("*").alias("n_lines"), text.alias("text"))


def run_stats(step_count, screenshot_count, pattern_count) -> Column:
    """``"N steps · N screenshots · N pattern(s) found"``."""
    n = col(pattern_count)
    return F.format_string("%d steps · %d screenshots · %d pattern%s found", col(step_count),
                           col(screenshot_count), n, F.when(n != 1, "s").otherwise(""))


def frontier(log: DataFrame) -> DataFrame:
    """Navigations to a URL that their site had not visited before: (site, seq, url, step).

    The first visit of each (site, url) is an aggregate, joined once and
    compared by step: no pair of rows per earlier visit. Expects the numbered log.
    """
    nav = log.filter(F.col("tool") == "navigator").select("site", "seq", "url", "step")
    first = first_visits(log)
    known = nav.filter(F.col("url").isNotNull()).join(first, ["site", "url"], "left")
    fresh = known.filter(F.col("first_step").isNull() | (F.col("first_step") >= F.col("step"))).drop("first_step")
    return fresh.select("site", "seq", "url", "step").unionByName(nav.filter(F.col("url").isNull()))


def landing_scrapes(log: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """For every navigation: the first successful scrape of its landing URL after it.

    An as-of lookup without pairing rows: navigations and scrapes of one
    (site, url) are scanned in descending step order and each navigation
    takes the last scrape seen so far (the nearest later one).
    """
    nav = log.filter(F.col("tool") == "navigator").select(
        "site", "url", "step", "seq", F.lit(None).cast("long").alias("_scr"))
    scr = log.filter((F.col("tool") == "scraper") & F.col("scrape_ok")).select(
        "site", "url", "step", "seq", F.col("seq").alias("_scr"))
    both = nav.unionByName(scr).withColumn("_k", F.concat_ws("\u0001", "site", "url")) \
        .withColumn("_neg", -F.col("step")).withColumn("_is_nav", F.col("_scr").isNull())
    out = ordered_scan(both, "_k", ["_neg"], [Agg("landing_seq", "last", "_scr")], num_partitions)
    return out.filter(F.col("_is_nav")).select("site", "url", "step", "seq", "landing_seq")


def price_changed(log: DataFrame) -> DataFrame:
    """(site, price_changed): the prices of the first and the last priced step differ.

    ``min_by``/``max_by`` over (ts, seq) are aggregates (partial aggregation),
    so no ordering of a whole site is needed.
    """
    priced = log.filter(F.size("prices") > 0)
    pos = F.struct("ts", "seq")
    return priced.groupBy("site").agg(
        (F.array_sort(F.min_by("prices", pos)) != F.array_sort(F.max_by("prices", pos))).alias("price_changed"))
