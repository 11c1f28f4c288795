"""DuckDB SQL giving the rows of the queries, written from the contracts and not from the Spark code."""

EXACT_DEDUP = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DEDUP = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_n >= 85 * (x.n + y.n - both_n)),
r(id, c) AS (SELECT a, a FROM (SELECT DISTINCT a FROM l) UNION SELECT b, c FROM r JOIN l ON id = a)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(g.c, documents.doc_id) AS component_id,
       coalesce(g.c, documents.doc_id) = documents.doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id AS doc_id, min(c) AS c FROM r GROUP BY 1) g USING (doc_id)
"""

_TOKENS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = rf"""
WITH iw AS (SELECT item_id, {_TOKENS} AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(ws) >= 10 THEN list_transform(range(1, len(ws) - 8), lambda i: array_to_string(ws[i:i + 9], ' '))
                                       WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM iw),
win2 AS (SELECT item_id, g, len(string_split(g, ' ')) AS k FROM win),
dw AS (SELECT doc_id, {_TOKENS} AS ws FROM documents),
ks AS (SELECT DISTINCT k FROM win2),
grams AS (
  SELECT doc_id, k, unnest(range(0, greatest(len(ws) - k + 1, 0))) AS p,
         unnest(list_transform(range(1, greatest(len(ws) - k + 2, 1)), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS g
  FROM dw, ks),
m AS (SELECT doc_id, p, grams.k, g FROM grams WHERE (g, grams.k) IN (SELECT g, k FROM win2)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM m) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m JOIN win2 USING (g)) GROUP BY 1)
SELECT dw.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""


#: Segments that the SQL of the template tree follows; the operator follows all.
LEVELS = 12


def url_filter() -> str:
    """The template tree of `url_filter`, level by level as common table expressions: all paths of up to ``LEVELS`` segments."""
    ctes = [r"""u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                             regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
lab AS (SELECT page_id, sum((quality = 0)::INT) AS bad, count(quality) AS labelled
        FROM u JOIN labels ON labels.doc_id = try_cast(regexp_extract(path, '/([0-9]{1,18})', 1) AS BIGINT)
        WHERE quality IS NOT NULL GROUP BY 1),
r0 AS (SELECT host, path, count(*) AS n, sum(coalesce(bad, 0)) AS bad, sum(coalesce(labelled, 0)) AS labelled,
              list_filter(string_split(path, '/'), lambda s: s <> '') AS segs, '' AS t
       FROM u LEFT JOIN lab USING (page_id) GROUP BY host, path)"""]
    for i in range(LEVELS):
        seg = f"segs[{i + 1}]"
        ctes.append(rf"""s{i} AS (SELECT *, {seg} AS seg FROM r{i}),
k{i} AS (SELECT host, t, seg, sum(n) AS c FROM s{i} WHERE seg IS NOT NULL GROUP BY ALL),
v{i} AS (SELECT host, t, seg FROM (SELECT *, sum(c) OVER w AS total, count(*) OVER w AS kids FROM k{i} WINDOW w AS (PARTITION BY host, t))
         WHERE kids > 20 AND c * 50 < total),
r{i + 1} AS (SELECT s.host, s.path, s.n, s.bad, s.labelled, s.segs,
             s.t || CASE WHEN s.seg IS NULL THEN '' WHEN v.seg IS NOT NULL OR regexp_matches(s.seg, '^[0-9]+(\.[a-z0-9]+)?$') THEN '/*' ELSE '/' || s.seg END AS t
             FROM s{i} s LEFT JOIN v{i} v ON v.host = s.host AND v.t = s.t AND v.seg = s.seg)""")
    ctes.append(f"""stats AS (SELECT host, t, sum(bad) AS bad, sum(labelled) AS labelled FROM r{LEVELS} GROUP BY ALL),
m0 AS (SELECT *, t AS m FROM stats)""")
    for i in range(1, LEVELS + 1):
        ctes.append(f"""h{i} AS (SELECT *, CASE WHEN len(string_split(m, '/')) > {i} AND string_split(m, '/')[{i + 1}] <> '*'
  THEN array_to_string(list_transform(string_split(m, '/'), lambda p, k: CASE WHEN k = {i + 1} THEN '*' ELSE p END), '/') ELSE m END AS shape FROM m{i - 1}),
o{i} AS (SELECT host, shape, m, sum(bad)::DOUBLE AS b, sum(labelled)::DOUBLE AS k FROM h{i} GROUP BY ALL),
p{i} AS (SELECT host, shape, sum(b) AS pb, sum(k) AS pk FROM o{i} GROUP BY ALL),
a{i} AS (SELECT host, m, shape FROM o{i} JOIN p{i} USING (host, shape)
         WHERE (b * pk - k * pb) * (b * pk - k * pb) <= 3.84::DOUBLE * k * pb * (pk - pb)),
m{i} AS (SELECT h.host, h.t, h.bad, h.labelled, coalesce(a.shape, h.m) AS m FROM h{i} h LEFT JOIN a{i} a ON a.host = h.host AND a.m = h.m)""")
    ctes.append(f"mlast AS (SELECT * FROM m{LEVELS}),\nrlast AS (SELECT * FROM r{LEVELS})")
    ctes.append("""g AS (SELECT sum(bad) AS b, sum(labelled) AS k FROM stats),
hs AS (SELECT host, sum(bad) AS hb, sum(labelled) AS hk FROM stats GROUP BY 1),
j AS (SELECT host, m, (x.b + 20.0::DOUBLE * (hb + 20.0::DOUBLE * CASE WHEN g.k > 0 THEN g.b::DOUBLE / g.k ELSE 0 END) / (hk + 20.0::DOUBLE)) / (x.k + 20.0::DOUBLE) AS rate
      FROM (SELECT host, m, sum(bad) AS b, sum(labelled) AS k FROM mlast GROUP BY ALL) x JOIN hs USING (host), g),
rules(kind, rule, dom, pre) AS (VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
  ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
fit AS (SELECT DISTINCT ON (host, path) host, path, kind, rule FROM (SELECT DISTINCT host, path FROM u) JOIN rules
        ON (host = dom OR ends_with(host, '.' || dom)) AND starts_with(path, pre) ORDER BY host, path, len(rule) DESC, rule)""")
    return "WITH " + ",\n".join(c.replace(" AS (SELECT", " AS MATERIALIZED (SELECT") for c in ctes) + """
SELECT page_id, u.host, u.path, rule, coalesce(kind, CASE WHEN rate >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       mlast.m AS template, round(rate, 6) AS bad_rate
FROM u JOIN rlast USING (host, path) JOIN mlast ON mlast.host = rlast.host AND mlast.t = rlast.t JOIN j ON j.host = mlast.host AND j.m = mlast.m
LEFT JOIN fit ON fit.host = u.host AND fit.path = u.path
"""

SUFFIX_DEDUP = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
g AS (SELECT doc_id, p, hash(substr(h, 2 * p + 1, 400)) AS k
      FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 199, 0))) AS p FROM d)),
r AS (SELECT doc_id, p FROM g WHERE k IN (SELECT k FROM g GROUP BY k HAVING count(*) > 1)),
i AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run
      FROM (SELECT doc_id, p, coalesce((p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200)::INT, 1) AS fresh FROM r)),
s AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS b FROM i GROUP BY doc_id, run),
k AS (SELECT doc_id, string_agg(substr(h, 2 * from_b + 1, 2 * (a - from_b)), '' ORDER BY a) AS head, max(b) AS last_b, sum(b - a) AS gone, count(*) AS c
      FROM (SELECT s.*, h, coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0) AS from_b FROM s JOIN d USING (doc_id)) GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(c, 0) AS n_spans,
       sha256(unhex(CASE WHEN c IS NULL THEN h ELSE head || substr(h, 2 * last_b + 1) END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
