"""DuckDB twins of the corpus queries that SQL can express."""

ORACLE = {
    "op2_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)""",
    "op8_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                                      lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
low AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p
                                         FROM win JOIN low USING (s) WHERE m < doc_id)),
words AS (SELECT doc_id, p, w[p] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT words.doc_id, count(*) AS n_words, count(gone.p) AS n_removed,
                string_agg(x, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL) AS k
         FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY words.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op11_decontaminate": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
items AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
        FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT n FROM win),
own AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, s FROM own WHERE s IN (SELECT s FROM win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits JOIN win USING (s, n)
                WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
           FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5""",
    "op13_spelling": r"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k:
         CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r
         FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents)),
own AS (SELECT doc_id, r, count(*) AS c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)) AS x
        FROM runs GROUP BY doc_id, r),
hashed AS (SELECT r, c, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
             list_transform(range(1, len(x)::BIGINT, 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
             lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1]))) AS h FROM own, crc),
slipped AS (SELECT c, CASE WHEN h % 97 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS w
            FROM hashed),
words AS (SELECT w, sum(c)::BIGINT AS n FROM slipped WHERE length(w) >= 5 GROUP BY w HAVING sum(c) >= 3),
cut AS (SELECT w, n, i, substr(w, 1, i - 1) AS a, substr(w, i + 1) AS z
        FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM words)),
pairs AS (SELECT DISTINCT p.w AS w, p.n AS n, q.w AS v, q.n AS m FROM cut p JOIN cut q USING (i, a, z) WHERE p.w <> q.w
          UNION SELECT p.w, p.n, q.w, q.n FROM cut p JOIN words q ON p.a || p.z = q.w
          UNION SELECT q.w, q.n, p.w, p.n FROM cut p JOIN words q ON p.a || p.z = q.w),
near AS (SELECT w, n, count(*) AS n_near, max(m) AS m FROM pairs GROUP BY w, n),
best AS (SELECT near.w, n_near, near.m, min(v) AS v FROM near JOIN pairs ON pairs.w = near.w AND pairs.m = near.m
         GROUP BY near.w, n_near, near.m),
forms AS (SELECT words.w, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN v END AS form,
                 CASE WHEN m >= 2 * n THEN m END AS form_n FROM words LEFT JOIN best USING (w)),
walk AS (SELECT w, w AS at FROM forms
         UNION SELECT walk.w, forms.form FROM walk JOIN forms ON forms.w = walk.at WHERE forms.form IS NOT NULL),
ends AS (SELECT walk.w, walk.at AS root FROM walk JOIN forms ON forms.w = walk.at WHERE forms.form IS NULL)
SELECT forms.w AS word, form, root, n, n_near, form_n FROM forms JOIN ends USING (w)""",
}
