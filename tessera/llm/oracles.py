"""SQL for DuckDB of the queries that SQL can express: by direct comparison of everything with everything."""

from __future__ import annotations

from tessera.llm.lexical_blocks import RANKED_SQL
from tessera.llm.simhash_decontam import LEAKS_SQL

OP4_SUFFIX_BUCKETS = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
h AS (SELECT doc_id, i, md5(b[i + 1 : i + 400]) AS window_md5 FROM (SELECT doc_id, b, unnest(range(n - 399)) AS i FROM d WHERE n >= 400)),
k AS (SELECT window_md5 FROM h GROUP BY window_md5 HAVING count(*) > 1),
r AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS new FROM h JOIN k USING (window_md5)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r) GROUP BY doc_id, run),
t AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id),
g AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM s UNION ALL SELECT s.doc_id, max(z), any_value(n) FROM s JOIN d USING (doc_id) GROUP BY s.doc_id),
q AS (SELECT g.doc_id, string_agg(hex(b[x + 1 : y]), '' ORDER BY x) AS kept FROM g JOIN d USING (doc_id) GROUP BY g.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN t.doc_id IS NULL THEN b ELSE unhex(kept) END) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN q ON d.doc_id = q.doc_id
"""

OP5_RLZ_SPANS = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, words, i FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)),
h AS (SELECT doc_id, i, md5(array_to_string(words[i : i + 49], ' ')) AS window_md5 FROM p),
f AS (SELECT window_md5, min(doc_id) AS first FROM h GROUP BY window_md5),
d AS (SELECT h.doc_id, h.i FROM h JOIN f USING (window_md5) WHERE f.first < h.doc_id),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i, unnest(range(50)) AS k FROM d)),
r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda z: NOT list_contains(gone, z[2])), lambda z: z[1]) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""

OP8_SIGNATURE_TREE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 3], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM b JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * shared >= 85 * (nx.n + ny.n - shared)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce((SELECT min(y) FROM r WHERE r.x = w.doc_id), w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id)
"""

ORACLES = {"op4_suffix_buckets": OP4_SUFFIX_BUCKETS, "op5_rlz_spans": OP5_RLZ_SPANS, "op8_signature_tree": OP8_SIGNATURE_TREE, "op10_simhash_decontam": LEAKS_SQL, "op12_lexical_blocks": RANKED_SQL}
