"""The same results in DuckDB SQL, for the operators that SQL can express."""

OP1 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
), first_doc AS (
  SELECT win, min(doc_id) AS d0 FROM g GROUP BY win
), hit AS (
  SELECT g.doc_id, g.i FROM g JOIN first_doc USING (win) WHERE first_doc.d0 < g.doc_id
), covered AS (
  SELECT DISTINCT doc_id, i + k AS pos FROM hit, (SELECT unnest(range(0, 13)) AS k)
), each_word AS (
  SELECT w.doc_id, pos, ws[pos] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM w) w
), kept AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.pos) AS t, count(*) AS n
  FROM each_word e ANTI JOIN covered c ON e.doc_id = c.doc_id AND e.pos = c.pos GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

OP7 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
  UNION ALL
  SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) IN (1, 2)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), link AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)
), e AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT doc_id AS v, doc_id AS r FROM documents
  UNION
  SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.v
), smallest AS (
  SELECT v, min(r) AS component_id FROM reach GROUP BY v
), sets AS (
  SELECT doc_id, list_sort(list(sh)) AS shs FROM s GROUP BY doc_id
), classes AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY shs) AS class_id FROM sets
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, c.class_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN smallest m ON m.v = d.doc_id LEFT JOIN classes c USING (doc_id)
"""

OP2 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS x, vec_id AS r FROM v
  UNION
  SELECT link.b, reach.r FROM reach JOIN link ON link.a = reach.x
), smallest AS (
  SELECT x, min(r) AS component_id FROM reach GROUP BY x
)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, s.component_id, v.vec_id = s.component_id AS kept
FROM v JOIN smallest s ON s.x = v.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) n ON n.a = v.vec_id
"""

SQL = {"op1_substring_dedup": OP1, "op2_embedding_dedup": OP2, "op7_jaccard_join": OP7}
