"""SQL counterparts of the training-data queries that SQL can express (DuckDB)."""

from __future__ import annotations

from docdelta.llm.quality_rules import COMMON, PROSE

_ESC = lambda x: rf"regexp_replace(regexp_replace(replace({x}, '\', '\\'), '(<)(/?s>)', '\1\\\2', 'g'), '(\[)(/?(?:ROLE|INST)\])', '\1\\\2', 'g')"

OP1 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
  o AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(length({_ESC('role')}) + length({_ESC('text')}) + 20 + CASE WHEN role = 'assistant' THEN 0 ELSE 13 END) OVER w AS chars
    FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) FILTER (WHERE role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars, count(*) FILTER (WHERE role = 'assistant' OR k = n) AS n_examples
FROM o GROUP BY conv_id"""

_DIGITS = "'0123456789ABCDEF'"
OP3 = f"""
WITH tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
  d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST((strpos({_DIGITS}, h[1]) - 1) * 16 + strpos({_DIGITS}, h[2]) - 1 AS BIGINT)) AS bytes FROM documents),
  c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) AS text_crc32 FROM d, tab),
  p AS (SELECT *, sum(size) OVER w AS upto, row_number() OVER w AS idx, sum(size) OVER () AS total FROM c WINDOW w AS (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)),
  s AS (SELECT *, CAST(least(23, ((2 * upto - size) * 24) // (2 * total)) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, idx - min(idx) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s"""

_LISTS = ", ".join(f"('{k}', {list(v)})" for k, v in COMMON.items())
_GONE = lambda p: f"(length(text) - length(regexp_replace(text, '{p}', '', 'g')))"
_CLASSES = [
    f"({_GONE(chr(92) + 'p{L}')} - {_GONE(chr(92) + 'p{Lu}')})", _GONE(r"[\x20\x09-\x0D]"), _GONE(r"\p{Lu}"), _GONE("[0-9]"), _GONE(r"[#*$%&|<>=+~^_@\\{}\[\]/!]"), _GONE("[.,;:?\"()-]|''"),
]
_JS = lambda p, q: f"round(sqrt(greatest(0.0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: CASE WHEN {p}[i] > 0 THEN {p}[i] * log2({p}[i] / (({p}[i] + {q}[i]) / 2)) ELSE 0.0 END + CASE WHEN {q}[i] > 0 THEN {q}[i] * log2({q}[i] / (({p}[i] + {q}[i]) / 2)) ELSE 0.0 END)) / 2)), 9)"
_MEANS = lambda x, fit: f"(SELECT code, list(m ORDER BY i) AS ref FROM (SELECT code, i, avg(v) AS m, count(*) AS n FROM (SELECT code, unnest({x}) AS v, unnest(range(len({x}))) AS i FROM {fit}) GROUP BY 1, 2) GROUP BY 1 HAVING min(n) >= 50)"
OP6 = rf"""
WITH lists(ref, ws) AS (VALUES {_LISTS}),
  d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS code FROM documents),
  w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
  win AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS x FROM w),
  hit AS (SELECT doc_id, unnest(g) AS i FROM (SELECT doc_id, list(i) AS g FROM win GROUP BY doc_id, x HAVING count(*) > 1)),
  rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM hit, (SELECT unnest(range(3)) AS j) GROUP BY 1),
  m AS (SELECT doc_id, text, code, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST({_GONE('[#*$%&|<>]')} AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, [{", ".join(_CLASSES)}] AS cls FROM w LEFT JOIN rep USING (doc_id)),
  said AS (SELECT doc_id, lower(unnest(ws)) AS word FROM w),
  cnt AS (SELECT doc_id, word, count(*) AS n FROM said GROUP BY 1, 2),
  want AS (SELECT doc_id, n_words, unnest(lists.ws) AS word, unnest(range(len(lists.ws))) AS i FROM m JOIN lists ON ref = code),
  shares AS (SELECT doc_id, list(coalesce(n, 0) / greatest(n_words, 1) ORDER BY i) AS h FROM want LEFT JOIN cnt USING (doc_id, word) GROUP BY 1),
  h AS (SELECT m.*, list_transform(list_append(cls, length(text) - list_sum(cls)), lambda c: c / greatest(length(text), 1)) AS p, CASE WHEN h IS NOT NULL THEN list_append(h, greatest(0.0, 1 - list_sum(h))) END AS q,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, word_chars >= 200 AS judged_c, n_words >= 100 AND h IS NOT NULL AS judged_w FROM m LEFT JOIN shares USING (doc_id)),
  fit_c AS (SELECT * FROM h WHERE NOT base_failed AND judged_c), fit_w AS (SELECT * FROM h WHERE NOT base_failed AND judged_w),
  own_c AS {_MEANS('p', 'fit_c')}, own_w AS {_MEANS('q', 'fit_w')},
  star AS (SELECT list((coalesce(s, 0) + 50 * v) / (coalesce(n, 0) + 50) ORDER BY i) AS ref FROM (SELECT unnest({PROSE}) AS v, unnest(range({len(PROSE)})) AS i)
    LEFT JOIN (SELECT i, sum(v) AS s, count(*) AS n FROM (SELECT unnest(p) AS v, unnest(range(len(p))) AS i FROM fit_c) GROUP BY 1) USING (i)),
  ranks AS (SELECT list(m ORDER BY i) AS ref FROM (SELECT i, avg(v) AS m FROM (SELECT unnest(q) AS v, unnest(range(len(q))) AS i FROM fit_w WHERE code IN (SELECT code FROM own_w)) GROUP BY 1)),
  r AS (SELECT h.*, coalesce(own_c.ref, star.ref) AS rp, coalesce(own_w.ref, ranks.ref) AS rq FROM h LEFT JOIN own_c USING (code) LEFT JOIN own_w USING (code), star, ranks),
  j AS (SELECT *, {_JS('p', 'rp')} AS char_distance, CASE WHEN q IS NOT NULL AND rq IS NOT NULL THEN {_JS('q', 'rq')} END AS word_distance FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ((judged_c AND char_distance > 0.22) OR coalesce(judged_w AND word_distance > 0.3, FALSE)) AS kept, char_distance, word_distance FROM j"""

OP9 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
  h AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, upper(sha1(body)) AS x FROM p),
  f AS (SELECT *, min(page_id) OVER (PARTITION BY x, payload_bytes) AS first FROM h)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((CAST(list_sum(list_transform(range(5), lambda n: CAST((strpos('0123456789ABCDEF', substr(x, CAST((k // 4) * 5 + n + 1 AS BIGINT), 1)) - 1) << (4 * (4 - n)) AS BIGINT))) AS BIGINT) >> (5 * (3 - k % 4))) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

ORACLES = {"op1_chat_format": OP1, "op3_shards": OP3, "op6_quality_rules": OP6, "op9_warc": OP9}
