"""op4: secrets of each document."""

from .common import table
from .secrets import secret_scan


def QUERY(spark, sf_dir):
    return secret_scan(table(spark, sf_dir, "documents"))


def _spans(kind, pattern):
    return f"""
  SELECT doc_id, source, '{kind}' AS kind, m AS match, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS st
  FROM (SELECT doc_id, source, ms, string_split_regex(t, {pattern}) AS p, unnest(ms) AS m, generate_subscripts(ms, 1) AS i
        FROM (SELECT doc_id, source, t, regexp_extract_all(t, {pattern}) AS ms FROM d))"""


ASSIGN = r"""'(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'"""
HEAD = r"""'^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?'"""
ORACLE = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
a AS ({_spans("assign", ASSIGN)} UNION ALL {_spans("access", "'AKIA[A-Z0-9]+'")} UNION ALL {_spans("hex", "'[0-9a-f]{32,}'")} UNION ALL {_spans("live", "'[A-Za-z0-9+/_-]{20,}'")}),
v AS (SELECT *, st + length(match) AS en, kind <> 'live' AS base, CASE WHEN kind = 'assign' THEN regexp_replace(match, {HEAD}, '') ELSE match END AS value FROM a),
k AS (SELECT * FROM v WHERE CASE kind WHEN 'assign' THEN length(value) >= 8 WHEN 'access' THEN length(match) >= 16 WHEN 'hex' THEN true
  ELSE regexp_matches(match, '[A-Z]') AND regexp_matches(match, '[a-z]') AND regexp_matches(match, '[0-9]') AND len(list_distinct(string_split(match, ''))) >= 10 END),
n AS (SELECT * FROM k x WHERE base OR NOT EXISTS (SELECT 1 FROM k b WHERE b.doc_id = x.doc_id AND b.base AND b.st < x.en AND b.en > x.st)),
o AS (SELECT value, count(DISTINCT source) < 2 AND count(DISTINCT doc_id) < 5 AS live FROM n GROUP BY 1),
f AS (SELECT n.*, live, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 WHEN 'hex' THEN 2 ELSE 3 END AS ord, concat(kind, ':', st, ':', en) AS s FROM n JOIN o USING (value) WHERE base OR live)
SELECT d.doc_id, count(s) FILTER (kind = 'assign') AS n_assign, count(s) FILTER (kind = 'access') AS n_access, count(s) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(s, ',' ORDER BY st, ord) FILTER (base), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY st, ord), '') AS spans,
  count(s) FILTER (base AND live) AS n_live, count(s) FILTER (base AND NOT live) AS n_example
FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id
"""
