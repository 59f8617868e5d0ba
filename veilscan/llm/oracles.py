"""DuckDB counterparts of the queries that SQL can express; the others are compared with brute-force versions in tests/llm."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op2_benchmark_decontamination"] = f"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
phrase AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
size AS (SELECT DISTINCT n FROM phrase),
place AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, size WHERE len(w) >= n)),
hit AS (SELECT rid, n, i, item_id FROM place JOIN phrase USING (n, p)),
word AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS j FROM hit) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (rid) LEFT JOIN items USING (rid)
"""

# the checksum of zlib and gzip: reflected polynomial 0xEDB88320, a table of the 256 byte values, then one step per byte
_CRC32 = """
bits AS (SELECT b, CAST(b AS BIGINT) AS c0 FROM range(256) t(b)),
crc_table AS (
  SELECT list(list_reduce([c0, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS steps FROM bits)"""
_CRC32_OF = """CASE WHEN octet_length(encode(coalesce(text, ''))) = 0 THEN 0 ELSE xor(list_reduce(
  list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST(('0x' || x) AS BIGINT))),
  lambda c, b: xor(c >> 8, steps[xor(c, b) % 256 + 1])), 4294967295) END"""

ORACLES["op3_sharding"] = f"""
WITH {_CRC32},
sized AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) + 16 AS BIGINT) AS size, CAST({_CRC32_OF} AS BIGINT) AS text_crc32 FROM documents, crc_table),
line AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) AS bytes_to, sum(size) OVER () AS all_bytes,
    row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) AS place
  FROM sized),
placed AS (SELECT *, CAST(least((40 * (2 * bytes_to - size)) // (2 * all_bytes), 39) AS INTEGER) AS shard FROM line)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(place - min(place) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""

ORACLES["op5_mix_sources"] = r"""
WITH sized AS (SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM src),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER before, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
opened AS (SELECT *, CASE WHEN 2.0::DOUBLE * source_size > level * weight THEN level END AS open_level FROM levels),
targets AS (
  SELECT source, source_size, CASE WHEN open_level IS NULL THEN 2.0::DOUBLE * source_size ELSE max(open_level) OVER () * weight END AS target FROM opened),
ranked AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
    CAST(('0x' || substr(md5('17:' || coalesce('s' || s.source, 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS start,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id NULLS FIRST) AS place
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(start + rate * place) - floor(start + rate * (place - 1))) AS BIGINT) AS taken FROM ranked
"""

_CRC32_OF_KEY = _CRC32_OF.replace("text", "key")

# a dynamic program over the rows of each conversation: per state the least (cost, audit, repaired text); states 0 to 3 as START, SYSTEM, USER, ASSISTANT
ORACLES["op11_conversation_repair"] = rf"""
WITH RECURSIVE {_CRC32},
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations),
kinds AS (SELECT conv_id, turn, role, text, CAST({_CRC32_OF_KEY} AS BIGINT) % 20 AS kind FROM keyed, crc_table),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM hurt),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS seen, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS before FROM ordered),
marked AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (place > 1 AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM marked GROUP BY conv_id),
never AS (SELECT {{'cost': 1000000000, 'audit': '', 'done': ''}} AS x),
steps AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS place, {{'cost': 0, 'audit': '', 'done': ''}} AS s0, x AS s1, x AS s2, x AS s3 FROM stats, never
  UNION ALL
  SELECT conv_id, place, {{'cost': s0.cost + 3, 'audit': s0.audit || 'D', 'done': s0.done}},
    list_sort([{{'cost': s1.cost + 3, 'audit': s1.audit || 'D', 'done': s1.done}},
      {{'cost': s0.cost + CASE WHEN lost OR left(role, 1) <> 's' THEN 1000000000 ELSE more END, 'audit': s0.audit || 'K', 'done': s0.done || chr(10) || role || ':' || text}}])[1],
    list_sort([{{'cost': s2.cost + 3, 'audit': s2.audit || 'D', 'done': s2.done}},
      {{'cost': u.cost + CASE WHEN lost THEN 1000000000 WHEN left(role, 1) = 'u' THEN more ELSE more + 2 END, 'audit': u.audit || CASE WHEN left(role, 1) = 'u' THEN 'K' ELSE 'R' END,
        'done': u.done || chr(10) || CASE WHEN left(role, 1) = 'u' THEN role ELSE 'user' END || ':' || text}}])[1],
    list_sort([{{'cost': s3.cost + 3, 'audit': s3.audit || 'D', 'done': s3.done}},
      {{'cost': s2.cost + CASE WHEN lost THEN 1000000000 WHEN left(role, 1) = 'a' THEN more ELSE more + 2 END, 'audit': s2.audit || CASE WHEN left(role, 1) = 'a' THEN 'K' ELSE 'R' END,
        'done': s2.done || chr(10) || CASE WHEN left(role, 1) = 'a' THEN role ELSE 'assistant' END || ':' || text}}])[1]
  FROM (
    SELECT *, list_sort([s0, s1, s3])[1] AS u FROM (
      SELECT k.conv_id, k.place, k.role, k.text, k.fault IN ('blank', 'duplicate') AS lost, CASE WHEN k.fault = 'truncated' THEN 1 ELSE 0 END AS more, s0, s1,
        list_sort([s2, {{'cost': s0.cost + 2, 'audit': s0.audit || 'I', 'done': s0.done || chr(10) || 'user:'}}, {{'cost': s1.cost + 2, 'audit': s1.audit || 'I', 'done': s1.done || chr(10) || 'user:'}},
          {{'cost': s3.cost + 2, 'audit': s3.audit || 'I', 'done': s3.done || chr(10) || 'user:'}}])[1] AS s2,
        list_sort([s3, {{'cost': s2.cost + 2, 'audit': s2.audit || 'I', 'done': s2.done || chr(10) || 'assistant:'}},
          {{'cost': s0.cost + 4, 'audit': s0.audit || 'II', 'done': s0.done || chr(10) || 'user:' || chr(10) || 'assistant:'}},
          {{'cost': s1.cost + 4, 'audit': s1.audit || 'II', 'done': s1.done || chr(10) || 'user:' || chr(10) || 'assistant:'}}])[1] AS s3
      FROM steps JOIN marked k ON k.conv_id IS NOT DISTINCT FROM steps.conv_id AND k.place = steps.place + 1))),
ends AS (
  SELECT s.conv_id, list_sort([s0, s3, {{'cost': s2.cost + 2, 'audit': s2.audit || 'I', 'done': s2.done || chr(10) || 'assistant:'}},
    {{'cost': s1.cost + 4, 'audit': s1.audit || 'II', 'done': s1.done || chr(10) || 'user:' || chr(10) || 'assistant:'}}])[1] AS best
  FROM steps s JOIN stats t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND s.place = t.n)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(substr(best.done, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN stats t ON t.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""

ORACLES["op12_phrase_collocations"] = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
gram AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS p FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM piece, (VALUES (1), (2), (3), (4)) t(m) WHERE len(w) >= m)),
f AS (SELECT lang, m, p, count(*) AS a FROM gram GROUP BY ALL),
total AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT *, string_split(p, ' ') AS w FROM f WHERE m > 1 AND a >= 30),
covered AS (
  SELECT DISTINCT c.lang, c.p FROM cand c JOIN (
    SELECT lang, a, array_to_string(w[i:i + k - 1], ' ') AS p FROM (SELECT *, unnest(range(1, m - k + 2)) AS i FROM cand, (VALUES (2), (3)) t(k) WHERE k < m)) g
  ON c.lang = g.lang AND c.p = g.p WHERE 100 * CAST(g.a AS HUGEINT) >= 80 * CAST(c.a AS HUGEINT)),
cut AS (SELECT lang, p, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:m], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)),
scored AS (
  SELECT c.lang, c.p, c.a, fx.a AS l, fy.a AS r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (CAST(fx.a AS HUGEINT) + fy.a) AS BIGINT) AS score,
    row_number() OVER (PARTITION BY c.lang, c.p ORDER BY (CAST(2000000 AS HUGEINT) * c.a) // (CAST(fx.a AS HUGEINT) + fy.a), k) AS weakest
  FROM cut c JOIN f fx ON fx.lang = c.lang AND fx.p = c.x JOIN f fy ON fy.lang = c.lang AND fy.p = c.y),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM scored s WHERE weakest = 1 AND NOT EXISTS (FROM covered v WHERE v.lang = s.lang AND v.p = s.p))
SELECT lang, CAST(rank AS BIGINT) AS rank, p AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
