"""SQL for those operators that SQL can express, by plain means: whole windows, self joins, recursion."""

WORD = r"[^\x20\x09-\x0D]+"

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
  d AS (SELECT page_id, h, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS holder FROM p)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(x, CAST(j // 4 AS INTEGER) * 5 + 1, 5))::BIGINT >> CAST(15 - 5 * (j % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> holder THEN holder END AS refers_to FROM d"""

NEARDUP = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
  r AS (SELECT vec_id AS n, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.n),
  k AS (SELECT n, min(c) AS c FROM r GROUP BY n), m AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT k.n AS vec_id, coalesce(m.n, 0) AS n_links, c AS component_id, k.n = c AS kept FROM k LEFT JOIN m ON m.a = k.n"""

JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS ws FROM documents),
  e AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0),
  s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM e),
  z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
  l AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k)),
  r AS (SELECT doc_id AS n, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.n),
  m AS (SELECT a, count(*) AS n FROM l GROUP BY a), k AS (SELECT n, min(c) AS c FROM r GROUP BY n)
SELECT k.n AS doc_id, coalesce(m.n, 0) AS n_links, c AS class_id FROM k LEFT JOIN m ON m.a = k.n"""

RULES = f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
  g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
  h AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
  rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM h, range(3) t(k) GROUP BY doc_id),
  li AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
  ln AS (SELECT doc_id, source, t, line, len(regexp_extract_all(line, '{WORD}')) AS n, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS norm FROM li),
  f AS (SELECT source, norm, count(DISTINCT doc_id) AS docs FROM ln WHERE n > 0 GROUP BY source, norm),
  c AS (SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS dup, count(*) FILTER (n > 0 AND docs > 50) AS gone, coalesce(sum(n) FILTER (docs > 50), 0) AS gone_words FROM ln LEFT JOIN f ON f.source IS NOT DISTINCT FROM ln.source AND f.norm = ln.norm AND n > 0 GROUP BY doc_id),
  b AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, dup AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, gone AS n_removed_lines, (len(ws) - gone_words)::BIGINT AS n_words_left FROM d JOIN c USING (doc_id) LEFT JOIN rep USING (doc_id)),
  x AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND n_words_left >= 0.5 * n_words AS kept FROM x"""

LINES = """WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
  e AS (SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l)),
  c AS (SELECT k, max(doc_id) AS last FROM e WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
  m AS (SELECT doc_id, i, line, c.k IS NOT NULL AND doc_id <> last AS gone FROM e LEFT JOIN c USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SEARCH = f"""WITH low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL),
  d AS (SELECT doc_id, unnest(regexp_extract_all(t, '{TERM}')) AS term FROM low),
  p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL), n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
  g AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM n),
  q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM benchmark),
  w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), g),
  s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN n USING (doc_id), g GROUP BY ALL),
  r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10"""

NEGATIVES = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
    WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
  p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5"""

ORACLE_SQL = {"op11_lines": LINES, "op12_search": SEARCH, "op13_negatives": NEGATIVES, "op3_neardup": NEARDUP, "op5_warc": WARC, "op8_ngram_join": JOIN, "op9_rules": RULES}
