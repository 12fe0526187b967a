"""DuckDB statements for the corpus queries that SQL can express, over the whole tables."""

ORACLES = {
    "op2_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh
  FROM w
), n AS (SELECT doc_id, len(sh) AS n FROM sets),
s AS (SELECT doc_id, unnest(sh) AS sh FROM sets),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(reach.b) AS component_id, n.doc_id = min(reach.b) AS kept
FROM n JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n.n
""",
    "op5_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), r AS (
  SELECT conv_id, turn, role, text, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    length('<s>[INST]' || replace(replace(replace(replace(replace(role, '\', '\\'), '</s>', '\</s>'), '<s>', '\<s>'), '[/INST]', '\[/INST]'), '[INST]', '\[INST]') || '[/INST]' || replace(replace(replace(replace(replace(text, '\', '\\'), '</s>', '\</s>'), '<s>', '\<s>'), '[/INST]', '\[/INST]'), '[INST]', '\[INST]') || '</s>') AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM r)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR i = n)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
""",
    "op8_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), a AS (SELECT *, (size * 1024) // (size + 100) AS g FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(g * size)::DOUBLE / sum(size)::DOUBLE / 1024 AS mean FROM a GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
v AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (SELECT min_by(level, cap / weight) AS level FROM v WHERE level <= cap / weight),
g AS (SELECT source, source_size, mean, least(cap, coalesce((SELECT level FROM l) * weight, cap)) AS target FROM w),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM g),
n AS (SELECT *, greatest(0.0, target - whole * source_size) AS need FROM q),
x AS (
  SELECT a.doc_id, a.size, a.u, a.g, n.*, a.size > 0 AND n.need > 0 AS live, CASE WHEN n.source_size > 0 THEN n.need / n.source_size END AS f
  FROM a JOIN n ON a.source IS NOT DISTINCT FROM n.source
), p AS (SELECT *, f + f * (1 - f) * (g / 1024.0::DOUBLE - mean) AS p FROM x),
o AS (SELECT *, CASE WHEN live THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM p),
c AS (
  SELECT *, sum(size) OVER (PARTITION BY source, live, odds, size) AS tied,
    sum(size) FILTER (live) OVER (PARTITION BY source ORDER BY odds NULLS LAST, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM o
)
SELECT doc_id, size, source_size, target,
  (CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN live AND upto - tied / 2.0 <= need THEN 1 ELSE 0 END END * size)::BIGINT AS taken
FROM c
""",
    "op10_exact_top_k": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.x, d.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id
), ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs)
SELECT * FROM ranked WHERE rank <= 5
""",
    "op9_pii": r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
hits AS (
  SELECT r, doc_id, 1 AS o, 'email' AS kind, regexp_extract_all(x, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS h, regexp_split_to_array(x, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS g FROM t UNION ALL
  SELECT r, doc_id, 2 AS o, 'ip' AS kind, regexp_extract_all(x, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AS h, regexp_split_to_array(x, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AS g FROM t UNION ALL
  SELECT r, doc_id, 3 AS o, 'card' AS kind, regexp_extract_all(x, '[0-9](?:[\x20-]?[0-9])+') AS h, regexp_split_to_array(x, '[0-9](?:[\x20-]?[0-9])+') AS g FROM t UNION ALL
  SELECT r, doc_id, 4 AS o, 'phone' AS kind, regexp_extract_all(x, '\+[0-9][\x20().0-9-]+[0-9]') AS h, regexp_split_to_array(x, '\+[0-9][\x20().0-9-]+[0-9]') AS g FROM t UNION ALL
  SELECT r, doc_id, 5 AS o, 'iban' AS kind, regexp_extract_all(x, '\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b') AS h, regexp_split_to_array(x, '\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b') AS g FROM t
), placed AS (
  SELECT r, o, kind, unnest(list_transform(range(1, len(h) + 1), lambda i: struct_pack(
    hit := h[i], s := list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda y: length(y))), 0)))) AS z
  FROM hits WHERE len(h) > 0
), cleaned AS (
  SELECT r, o, kind, z.hit AS hit, z.s::BIGINT AS s, CASE kind WHEN 'card' THEN regexp_replace(z.hit, '[\x20-]', '', 'g') WHEN 'phone' THEN regexp_replace(z.hit, '[^0-9]', '', 'g') ELSE replace(z.hit, ' ', '') END AS d
  FROM placed
), spans AS (
  SELECT r, o, kind, s, kind || ':' || s || ':' || (s + length(hit)) AS span FROM cleaned
  WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN regexp_full_match(hit, '0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2}|)(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2}|)){3}')
    WHEN 'phone' THEN length(d) BETWEEN 9 AND 15
    WHEN 'card' THEN length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i:
      CASE WHEN i % 2 = 1 THEN d[length(d) + 1 - i]::INTEGER ELSE (2 * d[length(d) + 1 - i]::INTEGER) // 10 + (2 * d[length(d) + 1 - i]::INTEGER) % 10 END)) % 10 = 0
    ELSE length(d) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split(d[5:] || d[:4], ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END)),
      lambda a, v: (a * CASE WHEN v >= 10 THEN 100 ELSE 10 END + v) % 97) = 1 END
)
SELECT t.doc_id, count(*) FILTER (kind = 'email')::BIGINT AS n_email, count(*) FILTER (kind = 'ip')::BIGINT AS n_ip, count(*) FILTER (kind = 'card')::BIGINT AS n_card, count(*) FILTER (kind = 'phone')::BIGINT AS n_phone,
  sha256(coalesce(string_agg(span, ',' ORDER BY o, s) FILTER (o <= 4), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY o, s), '') AS spans
FROM t LEFT JOIN spans USING (r) GROUP BY t.r, t.doc_id
""",
    "op11_phrases": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (
  SELECT lang, 1 AS size, unnest(ws) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w
), f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, count(*) AS n FROM g WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE size > 1),
k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
s AS (
  SELECT k.lang, k.phrase, k.size, k.a, k.k, l.f AS l, r.f AS r, (1000000::HUGEINT * k.a * k.a) // (l.f::HUGEINT * r.f) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.ws[:k.k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.ws[k.k + 1:], ' ')
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS over FROM (
    SELECT lang, a, ws[1] || ' ' || ws[2] AS phrase FROM c WHERE size = 3 UNION ALL SELECT lang, a, ws[2] || ' ' || ws[3] FROM c WHERE size = 3)
  GROUP BY ALL
), kept AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM b LEFT JOIN inside USING (lang, phrase) WHERE b.size = 3 OR over IS NULL OR 100 * over < 50 * b.a
)
SELECT kept.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN n ON n.lang = kept.lang WHERE rank <= 2000
""",
    "op13_first_seen_lines": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines,
    -- CRC-32 of the digits, a bit at a time: 8 steps a byte.
    (xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 64) // 8 AS batch
  FROM documents
), l AS (
  SELECT r, batch, i, lines[i] AS line, translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, batch, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)
), h AS (SELECT key, batch, count(DISTINCT r) AS docs FROM l WHERE length(key) >= 10 GROUP BY ALL),
e AS (SELECT key, batch, coalesce(sum(docs) OVER (PARTITION BY key ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 5 AS gone, sum(docs) OVER (PARTITION BY key) AS n FROM h),
m AS (SELECT l.*, e.n, coalesce(e.gone, false) AS gone FROM l LEFT JOIN e USING (key, batch))
SELECT 'doc' AS row_kind, d.doc_id::VARCHAR AS row_id, d.batch::INTEGER AS batch, count(*)::BIGINT AS n_all, count(*) FILTER (gone)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM d JOIN m USING (r) GROUP BY d.r, d.doc_id, d.batch
UNION ALL
SELECT 'line', sha256(key), min(batch)::INTEGER, any_value(n)::BIGINT, count(*)::BIGINT, NULL FROM m WHERE gone GROUP BY key
""",
}
