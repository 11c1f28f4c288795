"""Streaming jobs: each result must equal the batch result (2.J)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..session import ensure_checkpoint_dir
from ..streaming import jobs
from . import fixtures as G
from .fixtures import sql_lexicon
from .q_log import SQL_LOG, SQL_SIGNAL
from .registry import J, L, query, sql_visible

EVENTS_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def _out(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}_{uuid.uuid4().hex}"


def streaming_log(spark: SparkSession, in_dir: str) -> DataFrame:
    """The G3 evidence log over a stream of event files (no step numbers: unordered input)."""
    ev = jobs.read_stream(spark, in_dir, EVENTS_SCHEMA, "events.parquet")
    ev = ev.select("event_id", "ts", "user_id", "event_type",
                   F.get_json_object("props", "$.k").cast("int").alias("k"),
                   F.concat(F.lit("https://site"), F.col("user_id"), F.lit(".example")).alias("site"))
    view, purchase, signup, click, error = G.g3_parts(ev)
    return E.build_log(E.scrape_log(view), E.extract_log(purchase), E.screenshot_log(signup),
                       E.navigation_log(click), E.agent_log(error))


@query("st_page_signals", lambda: f"""SELECT page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host,
  coalesce(array_to_string(list_sort(list(l.pattern) FILTER (WHERE l.category = 'urgency')), '|'), '') AS urgency_texts
  FROM (SELECT page_id, url, lower({sql_visible('html', None)}) AS t FROM pages) p
  LEFT JOIN {sql_lexicon()} l ON contains(p.t, l.pattern) GROUP BY ALL""")
def q_st_page_signals(spark, d):
    out = jobs.stream_signals(spark, d, _out(spark, "page_signals"))
    return spark.read.parquet(out).select("page_id", "host", J("urgency_texts").alias("urgency_texts"))


@query("st_site_evidence", f"""SELECT site, CAST(count(*) AS BIGINT) AS step_count, CAST(count(shot_path) AS BIGINT) AS screenshots_taken,
  bool_or(popup) AS popup_detected, bool_or(reject_missing) AS reject_button_missing,
  CAST(sum(len(urgency_texts)) AS BIGINT) AS n_urgency_texts,
  (count(shot_path) > 0 AND count(visited) > 0 AND count(*) >= 6 AND bool_or({SQL_SIGNAL})) AS enough
  FROM {SQL_LOG} GROUP BY site""")
def q_st_site_evidence(spark, d):
    out = jobs.stream_site_evidence(spark, streaming_log(spark, d), _out(spark, "site_evidence"))
    r = jobs.current_state(spark, out)
    return r.select("site", L("step_count").alias("step_count"), L("screenshots_taken").alias("screenshots_taken"),
                    "popup_detected", "reject_button_missing", L("n_urgency_texts").alias("n_urgency_texts"),
                    "enough")


@query("st_visited_dedupe", f"SELECT DISTINCT site, visited AS url FROM {SQL_LOG} WHERE visited IS NOT NULL")
def q_st_visited_dedupe(spark, d):
    log = streaming_log(spark, d)
    visits = log.filter(F.col("visited").isNotNull()).select("site", F.col("visited").alias("url"), "ts")
    out = jobs.stream_dedupe(spark, visits, _out(spark, "visited"), delay="3650 days")
    return spark.read.parquet(out).select("site", "url")
