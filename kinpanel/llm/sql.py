"""DuckDB SQL of the queries that SQL can express."""

MIX = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM {docs}
), items AS (
  SELECT *, greatest(1, 20 - length(bin(size))) AS preference FROM sized
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS weight,
         row_number() OVER (ORDER BY encode(source) NULLS LAST) AS place
  FROM items GROUP BY source
), levels AS (
  SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS full_at,
    CAST((SELECT sum(size) FROM items) - coalesce(sum(3 * source_size) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, place
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, place
         ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lev
  FROM per
), targets AS (
  SELECT source, source_size, coalesce(least(weight * (SELECT max(lev) FROM levels WHERE lev <= full_at),
         CAST(3 * source_size AS DOUBLE)), CAST(3 * source_size AS DOUBLE)) AS target FROM levels
), classes AS (
  SELECT i.source, preference, CAST(sum(size) AS BIGINT) AS words, any_value(target) AS target
  FROM items i JOIN targets t ON i.source IS NOT DISTINCT FROM t.source GROUP BY i.source, preference HAVING sum(size) > 0
), steps AS (
  SELECT *, CAST(3 * words AS DOUBLE) / CAST(words * preference AS DOUBLE) AS full_at,
    (target - coalesce(sum(3 * words) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / CAST(sum(words * preference) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lev
  FROM classes
  WINDOW w AS (PARTITION BY source ORDER BY CAST(3 * words AS DOUBLE) / CAST(words * preference AS DOUBLE), preference)
), shares AS (
  SELECT *, max(lev) FILTER (WHERE lev <= full_at) OVER (PARTITION BY source) AS level_ FROM steps
), expected AS (
  SELECT source, preference, words, target, least(3.0::DOUBLE, coalesce(least((words * preference) * level_,
         CAST(3 * words AS DOUBLE)), CAST(3 * words AS DOUBLE)) / words) AS e FROM shares
), sure AS (
  SELECT *, CAST(floor(e) AS BIGINT) AS copies0, e - floor(e) AS p,
         target - sum(CAST(floor(e) AS BIGINT) * words) OVER (PARTITION BY source) AS left_ FROM expected
), drawn AS (
  SELECT i.doc_id, i.source, i.size, s.copies0, s.p, s.left_,
    (CAST(('0x' || substr(md5(coalesce(CAST(i.doc_id AS VARCHAR), '') || ':' || i.size || ':mix'), 1, 13)) AS BIGINT) + 0.5::DOUBLE)
      / 4503599627370496::DOUBLE AS u
  FROM items i LEFT JOIN sure s ON i.source IS NOT DISTINCT FROM s.source AND i.preference = s.preference
), ranked AS (
  SELECT *, CASE WHEN p > 0 THEN ((u / (1 - u)) / (p / (1 - p))) / (1 + (u / (1 - u)) / (p / (1 - p))) ELSE 1 + u END AS t,
         coalesce(size > 0 AND copies0 < 3, false) AS open_ FROM drawn
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source, open_ ORDER BY t, doc_id NULLS FIRST, size
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM ranked
), taken AS (
  SELECT doc_id, source, size, coalesce(copies0, 0) + CASE WHEN open_ AND 2 * before_ + size <= 2 * left_ THEN 1 ELSE 0 END AS copies
  FROM placed
)
SELECT k.doc_id, k.source, k.size, coalesce(t.source_size, 0) AS source_size, coalesce(t.target, 0) AS target,
       CAST(k.copies AS BIGINT) AS copies, CAST(k.copies * k.size AS BIGINT) AS taken
FROM taken k LEFT JOIN targets t ON k.source IS NOT DISTINCT FROM t.source
"""

CONTAMINATION = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM {docs}
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS width, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)
), widths AS (
  SELECT DISTINCT width FROM bw
), spots AS (
  SELECT rid, width, i, array_to_string(w[i:i + width - 1], ' ') AS win
  FROM (SELECT rid, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM d, widths WHERE len(w) >= width)
), hits AS (
  SELECT rid, i, s.width, item_id FROM spots s JOIN bw ON s.win = bw.win AND s.width = bw.width
), n AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + width)) AS p FROM hits) GROUP BY rid
), ids AS (
  SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN ids USING (rid)
"""

_DIGITS = " || ".join(
    f"'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + (CAST(('0x' || substr(h, {1 + 5 * (k // 4)}, 5)) AS BIGINT) >> {15 - 5 * (k % 4)}) % 32]"
    for k in range(32))

#: 32 digits of base 32, four from each five hexadecimal digits
WARC = f"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS h FROM pages
), first AS (
  SELECT h, min(page_id) AS first_id, count(*) AS n FROM p GROUP BY h
)
SELECT page_id, payload_bytes, {_DIGITS} AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id OR first_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id OR first_id IS NULL THEN NULL ELSE first_id END AS refers_to
FROM p JOIN first USING (h)
"""

NEAR = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM {docs}
), s AS (
  SELECT DISTINCT rid, doc_id, array_to_string(w[i:i + {width} - 1], ' ') AS g
  FROM (SELECT rid, doc_id, w, unnest(range(1, greatest(1, len(w) - {width} + 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT rid, doc_id, count(*) AS n FROM s GROUP BY ALL
), common AS (
  SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL
), link AS (
  SELECT x, y FROM common JOIN n p ON p.rid = x JOIN n q ON q.rid = y WHERE 100 * c >= {percent} * (p.n + q.n - c)
), reach(rid, top, step) AS (
  SELECT rid, rid, 0 FROM n
  UNION SELECT l.y, r.top, 1 FROM reach r JOIN link l ON l.x = r.rid
), least AS (
  SELECT r.rid, min(d.doc_id) AS component_id FROM (SELECT DISTINCT rid, top FROM reach) r JOIN d ON d.rid = r.top GROUP BY r.rid
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
       coalesce(d.doc_id = coalesce(component_id, d.doc_id), false) AS kept
FROM d LEFT JOIN n USING (rid) LEFT JOIN least USING (rid)
"""


def crc32_of(codes: str) -> str:
    """CRC-32 of a list of bytes, bit by bit."""
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"list_reduce(range(0, 8), lambda c, k: {bit}, xor(s, b))"
    return f"xor(list_reduce({codes}, lambda s, b: {byte}, 4294967295::BIGINT), 4294967295)"


_DECIMAL = "list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))"

TRIE = f"""
WITH t AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST,
         sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT *, conv_id - conv_id % 5 AS base, {crc32_of(_DECIMAL)} % 9 AS h FROM t
), c AS (
  SELECT h.conv_id, list_concat(coalesce(b.own, [])[:h], h.own[h + 1:]) AS turns FROM h LEFT JOIN t b ON b.conv_id = base
), m AS (
  SELECT conv_id, len(turns) AS length, d AS depth, turns[:d] AS path
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM c)
), n AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(length) = depth AS leaf,
    (count(*) - 1) * CASE WHEN depth > 0 THEN strlen(path[depth].t) ELSE 0 END AS own,
    string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE length = depth) AS ends
  FROM m GROUP BY depth, path
), below AS (
  SELECT path[:d] AS path, sum(CAST(leaf AS BIGINT)) AS n_leaves, sum(own) AS saved
  FROM (SELECT path, leaf, own, unnest(range(0, depth + 1)) AS d FROM n) GROUP BY ALL
), children AS (
  SELECT path[:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN below b ON b.path = n.path LEFT JOIN children k ON k.path = n.path
LEFT JOIN n p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = n.path[:n.depth - 1]
"""

_UTF8 = """flatten(list_transform(string_split(doc || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128
  THEN [CAST(unicode(x) AS BIGINT)] ELSE [192 + CAST(unicode(x) >> 6 AS BIGINT), 128 + CAST(unicode(x) & 63 AS BIGINT)] END))"""

SPELLING = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents
), hashed AS (
  SELECT run, count(*) AS n, {crc32_of(_UTF8)} AS h FROM runs GROUP BY doc, run
), slipped AS (
  SELECT n, CASE WHEN h % 97 = 0 THEN substring(run, 1, CAST(h % length(run) AS INT)) || substring(run, CAST(h % length(run) AS INT) + 2)
            ELSE run END AS word FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), rests AS (
  SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest
  FROM (SELECT *, CAST(unnest(range(1, length(word) + 1)) AS INT) AS i FROM words)
), near AS (
  SELECT DISTINCT a.word AS a, b.word AS b, b.n FROM rests a JOIN rests b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT r.word, w.word, w.n FROM rests r JOIN words w ON w.word = r.rest
  UNION SELECT w.word, r.word, r.n FROM rests r JOIN words w ON w.word = r.rest
), best AS (
  SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, encode(b)) AS near, max(n) AS near_n FROM near GROUP BY a
), told AS (
  SELECT word, CASE WHEN near_n >= 2 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near,
         CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM words LEFT JOIN best ON a = word
), chain(word, root, step) AS (
  SELECT word, word, 0 FROM told
  UNION ALL SELECT c.word, t.form, step + 1 FROM chain c JOIN told t ON t.word = c.root WHERE t.form IS NOT NULL
), ends AS (
  SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM told JOIN ends USING (word)
"""
