"""Flagship audit over the crawl table, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.audit import audit_hosts
from ..sources.tables import read_table
from .fixtures import sql_lexicon, sql_rules, sql_taxonomy
from .registry import sql_visible


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_hosts(read_table(spark, sf_dir, "pages"))


def flagship_sql() -> str:
    return f"""WITH v AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host,
      lower({sql_visible('html', None)}) AS t,
      regexp_matches(html, 'class="[^"]*(modal|overlay|popup)|id="[^"]*modal') AS popup FROM pages),
  lex AS (SELECT * FROM {sql_lexicon()}),
  hits AS (SELECT DISTINCT v.page_id, v.host, l.category, l.pattern FROM v JOIN lex l ON contains(v.t, l.pattern)),
  pf AS (SELECT v.page_id, v.host, v.popup,
      EXISTS (SELECT 1 FROM hits h WHERE h.page_id = v.page_id AND h.category = 'consent_accept')
      AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.page_id = v.page_id AND h.category = 'consent_reject') AS rm FROM v),
  sig AS (SELECT DISTINCT host, 'phrase' AS kind, pattern AS signal FROM hits
      UNION SELECT DISTINCT host, 'category', category FROM hits
      UNION SELECT DISTINCT host, 'flag', 'reject_button_missing' FROM pf WHERE rm
      UNION SELECT DISTINCT host, 'flag', 'popup_detected' FROM pf WHERE popup),
  rules AS (SELECT * FROM {sql_rules()}),
  tax AS (SELECT * FROM {sql_taxonomy()}),
  fp AS (SELECT DISTINCT s.host, r.pattern, r.severity,
      CASE WHEN r.kind = 'phrase' THEN 'urgency' ELSE r.signal END AS instance
      FROM sig s JOIN rules r ON r.kind = s.kind AND r.signal = s.signal),
  ft AS (SELECT fp.*, tx.level, tx.strategy, CASE tx.level WHEN 'low' THEN 1 WHEN 'meso' THEN 2 ELSE 3 END AS lr
      FROM fp JOIN tax tx ON tx.pattern = fp.pattern),
  best AS (SELECT * FROM (SELECT ft.*, min(lr) OVER (PARTITION BY host, instance) AS mlr FROM ft) WHERE lr = mlr),
  agg AS (SELECT host, count(*) AS n, max(CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 END) AS r,
      bool_or(pattern IN ('Bad Defaults', 'Privacy Zuckering', 'Forced Registration', 'Immortal Accounts')) AS g,
      array_to_string(list_sort(list(pattern)), '|') AS pats FROM best GROUP BY host),
  hosts AS (SELECT host, count(*) AS n_pages FROM v GROUP BY host)
SELECT h.host, CAST(h.n_pages AS BIGINT) AS n_pages, CAST(coalesce(a.n, 0) AS BIGINT) AS pattern_count,
  CASE a.r WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' ELSE 'CLEAN' END AS overall_risk,
  coalesce(a.g, false) AS gdpr_concerns, coalesce(a.pats, '') AS patterns
FROM hosts h LEFT JOIN agg a USING (host)"""
