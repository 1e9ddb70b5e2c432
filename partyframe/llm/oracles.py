"""DuckDB twins of the queries that SQL can state over whole tables."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Links of one label by double-precision cosine, and what is reachable by them.
EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
   AND list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
reach AS (
  SELECT vec_id AS n, vec_id AS r FROM embeddings
  UNION SELECT reach.n, l.b FROM reach JOIN l ON l.a = reach.r),
c AS (SELECT n, min(r) AS component_id FROM reach GROUP BY n),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.n = vec_id LEFT JOIN k ON k.a = vec_id
"""

#: Links by the Jaccard similarity of five-word shingle sets, counted through shared shingles.
JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS x
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
      WHERE common * 10 >= 8 * (na.size + nb.size - common)),
reach AS (
  SELECT doc_id AS n, doc_id AS r FROM documents
  UNION SELECT reach.n, l.b FROM reach JOIN l ON l.a = reach.r),
c AS (SELECT n, min(r) AS class_id FROM reach GROUP BY n),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, doc_id = class_id AS kept
FROM documents JOIN c ON c.n = doc_id LEFT JOIN k ON k.a = doc_id
"""

#: Words covered by a window of 20 whose words also start earlier.
SUBSTRING = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
k AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 19], ' ')) AS key
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w)),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY key ORDER BY doc_id, s) AS place FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS at FROM f WHERE place > 1),
a AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS at, unnest(ws) AS word FROM w),
r AS (SELECT a.doc_id, count(*) AS n_words, count(g.at) AS n_removed,
             string_agg(word, ' ' ORDER BY a.at) FILTER (WHERE g.at IS NULL) AS kept
      FROM a LEFT JOIN g ON g.doc_id = a.doc_id AND g.at = a.at GROUP BY a.doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id
"""

#: The 20 documents of the highest integer score per item.
LEXICAL = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
i AS (
  SELECT item_id, term, count(*) AS r FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term),
l AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
c AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM l),
p AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM i) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM p, c GROUP BY term),
s AS (SELECT item_id, p.doc_id,
             sum(r * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score
      FROM i JOIN p USING (term) JOIN w USING (term) JOIN l ON l.doc_id = p.doc_id, c GROUP BY item_id, p.doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
WHERE rank <= 20
"""

#: Phrases of two and three words with 10 occurrences or more, by their lowest cut.
COLLOCATIONS = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k))),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS a, string_split(phrase, ' ') AS ws FROM g
      GROUP BY lang, k, phrase HAVING count(*) >= 10),
c AS (SELECT lang, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS head, array_to_string(ws[cut + 1:k], ' ') AS tail
      FROM (SELECT *, unnest(range(1, k)) AS cut FROM f WHERE k > 1)),
s AS (SELECT c.lang, c.phrase, c.a, cut, l.a AS l, r.a AS r, (1000000::HUGEINT * c.a * c.a) // (l.a * r.a) AS score
      FROM c JOIN f l ON l.lang = c.lang AND l.phrase = c.head JOIN f r ON r.lang = c.lang AND r.phrase = c.tail),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
b AS (SELECT lang, phrase, max(a) AS around FROM (
        SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM f WHERE k = 3
        UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM f WHERE k = 3) GROUP BY lang, phrase),
o AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, m.phrase) AS rank
      FROM m LEFT JOIN b ON b.lang = m.lang AND b.phrase = m.phrase
      WHERE around IS NULL OR 100 * around < 50 * a)
SELECT o.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n.n, score::BIGINT AS score
FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""
