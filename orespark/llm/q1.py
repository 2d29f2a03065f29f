"""op1: near-duplicate classes of documents."""

from .common import table
from .ngram_join import ngram_jaccard_join


def QUERY(spark, sf_dir):
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh
  FROM d),
n AS (SELECT doc_id, len(sh) AS n FROM s),
t AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x AS doc_id, x AS top FROM (SELECT DISTINCT x FROM e) UNION SELECT e.y, r.top FROM r JOIN e ON e.x = r.doc_id WHERE r.top < e.y),
c AS (SELECT doc_id, min(top) AS top FROM r GROUP BY 1),
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY CASE WHEN n = 0 THEN doc_id::VARCHAR ELSE list_sort(sh)::VARCHAR END) AS class_id FROM s JOIN n USING (doc_id))
SELECT doc_id, n AS n_shingles, class_id, least(doc_id, coalesce(top, doc_id)) AS component_id FROM n JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)
"""
