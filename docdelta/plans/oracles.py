"""SQL counterparts of the registered queries, for DuckDB over the same tables.

RE2 has no look-around, so matches are captured and put back; the dialect's
patterns are otherwise those of docdelta.functions.patterns.
"""

from __future__ import annotations

_W = r"[\p{L}\p{N}_]"
_S = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_IN_LINE = r"[\t\x{0b}\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PREFIX = rf"^{_S}*(?:#{{1,6}}{_S}+|[•▪◦‣*–—-]{_S}+|\p{{Nd}}+(?:\.\p{{Nd}}+)*[.)]{_S}+|[A-Za-zА-Яа-яЁё][.)]{_S}+)"
_NUMBERING = rf"^{_S}*\p{{Nd}}+(?:\.\p{{Nd}}+)*[.)]{_S}*$"


def _re(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def _strip(x: str) -> str:
    return _re(x, rf"^{_S}+|{_S}+$")


def _squeeze(x: str) -> str:
    return _strip(_re(x, rf"{_S}+", " "))


def _layout_free(x: str) -> str:
    t = f"replace(replace(coalesce({x}, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    for _ in range(2):  # neighbouring matches share a letter
        t = _re(t, rf"({_W})\x{{ad}}[ \t]*\n[ \t]*({_W})", r"\1\2")
    t = f"replace({t}, chr(173), '')"
    for _ in range(2):
        t = _re(t, rf"({_W})-[ \t]*\n[ \t]*({_W})", r"\1\2")
    t = _re(t, r"[ \t]+", " ")
    t = _re(t, rf"(^|\n){_IN_LINE}+", r"\1")
    t = _re(t, rf"{_IN_LINE}+(\n|$)", r"\1")
    return _strip(_re(t, r"\n{3,}", r"\n\n").replace(r"'\n\n'", "chr(10) || chr(10)"))


def _literal_key(x: str) -> str:
    return _squeeze(_layout_free(x))


def _line_key(x: str) -> str:
    t = f"regexp_replace({_strip(x)}, '{_PREFIX}', '')"
    t = f"regexp_replace({t}, '^{_S}*(?:\\*\\*|__|\\*)+', '')"
    t = f"regexp_replace({t}, '(?:\\*\\*|__|\\*)+{_S}*$', '')"
    t = f"replace(replace({t}, '**', ''), '__', '')"
    return _strip(f"regexp_replace({t}, '{_PREFIX}', '')")


_DASH = "translate({x}, '‐‑‒–—−', '------')"
_PAIRS = """
  versions AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY substring(text, 1, 40)) AS base FROM documents),
  pairs AS (SELECT CAST(v.doc_id AS VARCHAR) AS job_id, b.text AS text1, v.text AS text2 FROM versions v JOIN documents b ON b.doc_id = v.base WHERE v.doc_id <> v.base)"""
_SIDES = f"""{_PAIRS},
  sides AS (SELECT job_id, 1 AS side, string_split(text1, chr(10)) AS lines FROM pairs UNION ALL SELECT job_id, 2, string_split(text2, chr(10)) FROM pairs),
  pages_ AS (SELECT job_id, side, p + 1 AS page, array_to_string(lines[p * 5 + 1 : p * 5 + 5], chr(10)) AS text
             FROM (SELECT job_id, side, lines, unnest(range(0, CAST(floor((len(lines) - 1) / 5.0) AS BIGINT) + 1)) AS p FROM sides))"""
_LINE_PAIRS = f"""{_PAIRS},
  ab AS (SELECT job_id, string_split(text1, chr(10)) AS l1, string_split(text2, chr(10)) AS l2 FROM pairs),
  zipped AS (SELECT job_id, i AS line_no, coalesce(l1[i + 1], '') AS a, coalesce(l2[i + 1], '') AS b
             FROM (SELECT job_id, l1, l2, unnest(range(0, greatest(len(l1), len(l2)))) AS i FROM ab)),
  line_pairs AS (SELECT * FROM zipped WHERE a <> b)"""


def _blocks(src: str, keys: str) -> str:
    """CTEs up to blk(keys, i, sub, part, cut, kind, text): the blocks of the texts of ``src`` (keys, text), in order."""
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    of = lambda a: ", ".join(f"{a}.{k}" for k in keys.split(", "))
    longer = lambda open_, x: f"CASE WHEN {open_} = '' THEN {x} ELSE {open_} || ' ' || {x} END"
    after = lambda open_, x: f"CASE WHEN {x}.l = '' OR {x}.kind IS NOT NULL OR {x}.stop OR length({longer(open_, x + '.l')}) >= 4000 THEN '' ELSE {longer(open_, x + '.l')} END"
    pack = lambda open_, x: f"CASE WHEN length({x}) > 4000 THEN '' WHEN {open_} <> '' AND length({open_} || ' ' || {x}) > 4000 THEN {x} ELSE {longer(open_, x)} END"
    return rf"""
  parts_ AS (SELECT {keys}, string_split({_layout_free('text')}, chr(10)) AS p FROM {src}),
  raw_ AS (SELECT {keys}, unnest(p) AS l, unnest(range(len(p))) AS i, len(p) AS n FROM parts_),
  ln AS (SELECT *, {_KIND} AS kind, regexp_matches(l, '[.!?…;:]$') AS stop FROM raw_),
  fold AS (SELECT {keys}, i, n, l, kind, stop, '' AS before, {after("''", 'ln')} AS after FROM ln WHERE i = 0
    UNION ALL SELECT {of('x')}, x.i, x.n, x.l, x.kind, x.stop, f.after, {after('f.after', 'x')} FROM fold f JOIN ln x ON {on('x', 'f')} AND x.i = f.i + 1),
  emitted AS (SELECT {keys}, i, 0 AS sub, 'paragraph' AS kind, before AS text FROM fold WHERE (l = '' OR kind IS NOT NULL) AND before <> ''
    UNION ALL SELECT {keys}, i, 1, kind, l FROM ln WHERE kind IS NOT NULL
    UNION ALL SELECT {keys}, i, 1, 'paragraph', {longer('before', 'l')} FROM fold WHERE l <> '' AND kind IS NULL AND (stop OR length({longer('before', 'l')}) >= 4000)
    UNION ALL SELECT {keys}, i, 2, 'paragraph', after FROM fold WHERE i = n - 1 AND after <> ''),
  wide AS (SELECT {keys}, i, sub, string_split({_re('text', rf'([.!?…;:]){_S}+', r'\1' + chr(1))}, chr(1)) AS p FROM emitted WHERE kind = 'paragraph' AND length(text) > 4000),
  sn AS (SELECT {keys}, i, sub, unnest(p) AS s, unnest(range(len(p))) AS j, len(p) AS n FROM wide),
  pk AS (SELECT {keys}, i, sub, j, n, s, '' AS before, {pack("''", 's')} AS after FROM sn WHERE j = 0
    UNION ALL SELECT {of('x')}, x.i, x.sub, x.j, x.n, x.s, f.after, {pack('f.after', 'x.s')} FROM pk f JOIN sn x ON {on('x', 'f')} AND x.i = f.i AND x.sub = f.sub AND x.j = f.j + 1),
  blk AS (SELECT {keys}, i, sub, 0 AS part, 0 AS cut, kind, text FROM emitted WHERE kind <> 'paragraph' OR length(text) <= 4000
    UNION ALL SELECT {keys}, i, sub, j, -1, 'paragraph', before FROM pk WHERE before <> '' AND (length(s) > 4000 OR length(before || ' ' || s) > 4000)
    UNION ALL SELECT {keys}, i, sub, j, c, 'paragraph', substring(s, c * 4000 + 1, 4000) FROM (SELECT *, unnest(range((length(s) - 1) // 4000 + 1)) AS c FROM pk WHERE length(s) > 4000)
    UNION ALL SELECT {keys}, i, sub, n, 0, 'paragraph', after FROM pk WHERE j = n - 1 AND after <> '')"""


_CONV = """
  conv AS (SELECT CAST(conv_id AS VARCHAR) AS job_id, CAST(floor(turn / 2) + 1 AS INTEGER) AS page_number, CAST(turn % 2 + 1 AS INTEGER) AS side, text FROM conversations)"""
_LOG = """
  log AS (SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'preparing' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'ocr_ready' ELSE 'failed' END AS status,
            event_id % 7 AS total_chunks, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS message,
            CASE WHEN event_id % 3 = 0 THEN 'a' || event_id ELSE '' END AS file1_name FROM events)"""
_JOBS = """
  counted AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1),
  jobs_ AS (SELECT o_orderkey AS job_id, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'comparing' ELSE 'ocr_ready' END AS status, o_orderdate AS created_at,
              coalesce(n, 0) AS processed_chunks, o_orderkey % 5 = 0 AS comparison_claimed, CASE o_orderkey % 3 WHEN 0 THEN 'w1' WHEN 1 THEN 'w2' END AS lease_owner
            FROM orders LEFT JOIN counted ON l_orderkey = o_orderkey)"""
_TRANSITIONS = """
  moves(f, t) AS (VALUES ('queued','preparing'),('queued','processing'),('queued','failed'),('preparing','queued'),('preparing','processing'),('preparing','failed'),
    ('processing','ocr_ready'),('processing','failed'),('ocr_ready','failed'))"""
_FRAGMENTS = """
  frag AS (SELECT CAST(user_id * 20 + event_id % 13 AS VARCHAR) AS job_id, CAST(floor(event_id / 13.0) AS BIGINT) % 3 AS chunk_index, event_id,
             CASE event_type WHEN 'view' THEN NULL WHEN 'error' THEN 'different' WHEN 'click' THEN 'content_equal' ELSE 'identical' END AS verdict,
             event_type IN ('purchase', 'signup') AS identical, CASE WHEN event_type IN ('purchase', 'signup') THEN NULL ELSE CAST(event_id AS VARCHAR) END AS difference FROM events),
  once AS (SELECT * FROM frag QUALIFY row_number() OVER (PARTITION BY job_id, chunk_index ORDER BY event_id) = 1),
  merged AS (SELECT job_id, bool_and(identical) AS same, bool_or(coalesce(verdict, 'different') = 'different') AS diff, bool_or(coalesce(verdict = 'content_equal', FALSE)) AS eq,
               count(difference) AS nd, coalesce(string_agg(difference, ',' ORDER BY chunk_index), '') AS differences FROM once GROUP BY 1 HAVING count(*) >= 3)"""
_VERDICT = "CASE WHEN same AND nd = 0 THEN 'identical' WHEN diff THEN 'different' WHEN eq THEN 'content_equal' ELSE 'different' END"
_TAGS = lambda *pairs: "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for t, n in pairs) + "], lambda x: x IS NOT NULL)), ',')"
_FOLD = lambda x: f"replace(lower({_literal_key(x)}), ' ', '')"
_WORDS = lambda x: f"regexp_extract_all({x}, '[A-Za-zА-Яа-яЁё]+')"
_LOWER = lambda x: f"list_transform({_WORDS(x)}, lambda w: lower(w))"
_B = rf"(?:^|$|{_W})"
_PROTECTION = _TAGS(
    ("(list_contains(lw, 'не') <> list_contains(rw, 'не')) OR (list_contains(lw, 'без') <> list_contains(rw, 'без'))", "negation"),
    ("wa <> wb", "word_change"),
    (rf"regexp_matches(c, '[\p{{Nd}}²³¹]') AND NOT regexp_matches(a, '{_NUMBERING}') AND NOT regexp_matches(b, '{_NUMBERING}')", "body_number"),
    (r"regexp_matches(c, '(^|[^\p{L}\p{N}_])(\p{Nd}{1,2}[./-]\p{Nd}{1,2}[./-]\p{Nd}{2,4}|\p{Nd}{4}[./-]\p{Nd}{1,2}[./-]\p{Nd}{1,2})([^\p{L}\p{N}_]|$)')", "date"),
    (r"regexp_matches(c, '(?i)(^|[^\p{L}\p{N}_])\p{Nd}[\p{Nd}\s\x{a0}]*([.,]\p{Nd}+)?\s*(руб(лей)?|коп(еек)?|USD|EUR)([^\p{L}\p{N}_]|$)')", "amount"),
    (r"regexp_matches(c, '(^|[^\p{L}\p{N}_])[A-ZА-ЯЁ]{2,8}([^\p{L}\p{N}_]|$)')", "abbreviation"),
    ("len(wa) > 1 OR len(wb) > 1", "phrase"),
)
_PROTECTED = f"""{_LINE_PAIRS},
  worded AS (SELECT *, a || ' ' || b AS c, {_WORDS('a')} AS wa, {_WORDS('b')} AS wb, {_LOWER('a')} AS lw, {_LOWER('b')} AS rw FROM line_pairs),
  tagged AS (SELECT job_id, line_no, {_PROTECTION} AS tags FROM worded)"""
_KIND = rf"""CASE WHEN contains(l, '|') THEN 'table_row'
  WHEN regexp_matches(l, '^{_S}*(?:[•*–—-]|\p{{Nd}}+[.)]|[A-Za-zА-Яа-яЁё][.)]){_S}+[^\s]') THEN 'list_item'
  WHEN length(l) <= 120 AND (regexp_matches(l, '^\p{{Nd}}+(?:\.\p{{Nd}}+)*\.?{_S}+[^\s]') OR (length({_re('l', r'[^\p{L}]')}) > 0
    AND length({_re('l', r'[^\p{Lu}]')}) / length({_re('l', r'[^\p{L}]')}) >= 0.7 AND NOT regexp_matches(l, '[.!?…;:]$'))) THEN 'heading' END"""
_TECH = f"""CASE WHEN a <> b AND {_DASH.format(x='a')} = {_DASH.format(x='b')} THEN 'dash' WHEN contains(a || b, '**') OR contains(a || b, '#') THEN 'markdown'
  WHEN regexp_matches(a, '{_NUMBERING}') OR regexp_matches(b, '{_NUMBERING}') THEN 'numbering' WHEN {_literal_key('a')} = {_literal_key('b')} THEN 'line_wrap' ELSE 'numbering' END"""
_AS_OF = "TIMESTAMP '2024-01-20 00:00:00'"
_CLIP = "CASE WHEN length(t) > 200 THEN " + _re("substring(t, 1, 199)", rf"{_S}+$") + " || '…' ELSE t END"

_SAME = lambda a, b: rf"CASE WHEN {a} = '' OR {b} = '' THEN ({a} = '') = ({b} = '') ELSE {a} = {b} OR (NOT regexp_matches(CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END, '^[\p{{Nd}}²³¹]{{1,4}}$') AND contains(CASE WHEN length({a}) <= length({b}) THEN {b} ELSE {a} END, CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END)) END"
_TYPE = lambda a, b: f"""CASE WHEN {a} <> {b} AND {_DASH.format(x=a)} = {_DASH.format(x=b)} THEN 'dash' WHEN contains({a} || {b}, '**') OR contains({a} || {b}, '#') THEN 'markdown'
  WHEN regexp_matches({a}, '{_NUMBERING}') OR regexp_matches({b}, '{_NUMBERING}') THEN 'numbering' WHEN {_literal_key(a)} = {_literal_key(b)} THEN 'line_wrap' ELSE 'numbering' END"""  # noqa: E731
_DECORATED = r"""
  words AS (SELECT doc_id, regexp_extract(text, '([A-Za-z]+)', 1) AS w, doc_id % 10 AS k FROM documents),
  made AS (SELECT doc_id, CAST(floor(doc_id / 20.0) AS BIGINT) AS job_id, CAST(floor(doc_id / 2.0) AS INTEGER) AS alignment_id,
    CASE k WHEN 0 THEN w || ' – x' WHEN 1 THEN '4.1.' WHEN 2 THEN '•' WHEN 3 THEN '##' WHEN 4 THEN '12' WHEN 5 THEN upper(w) WHEN 6 THEN '**' || w || '**' WHEN 7 THEN w WHEN 8 THEN '1) ' || w ELSE '—' END AS c1,
    CASE k WHEN 0 THEN w || ' - x' WHEN 6 THEN w WHEN 7 THEN w || 'x' WHEN 8 THEN w ELSE '' END AS c2,
    CASE WHEN k IN (1, 2, 8) THEN 'start' WHEN k IN (4, 5, 9) THEN 'whole_block' ELSE 'middle' END AS position,
    CASE k WHEN 5 THEN upper(w) || ' ' || upper(w) WHEN 9 THEN '—' ELSE '' END AS near FROM words WHERE w <> ''),
  cand AS (SELECT *, CASE WHEN near <> '' THEN near ELSE c1 END AS e1, c2 AS e2, CASE WHEN c1 <> '' THEN c1 ELSE c2 END AS chg FROM made)"""
_RULE = rf"""CASE WHEN c1 <> c2 AND {_DASH.format(x='c1')} = {_DASH.format(x='c2')} THEN 'dash'
  WHEN regexp_matches(c1, '{_NUMBERING}') OR regexp_matches(c2, '{_NUMBERING}') THEN 'numbering'
  WHEN position = 'start' AND regexp_matches(chg, '^[•▪◦‣*–—-]$') THEN 'list_marker' WHEN regexp_matches(chg, '^(?:#{{1,6}}|\*+|_+|`+)$') THEN 'markdown'
  WHEN position = 'whole_block' AND regexp_matches(chg, '^\p{{Nd}}+$') AND regexp_matches(e1 || e2, '^\p{{Nd}}+$') THEN 'page_number'
  WHEN position = 'whole_block' AND length(chg) <= 80 AND (NOT regexp_matches(chg, '[\p{{L}}\p{{N}}]') OR (length({_re('chg', r'[^\p{Lu}]')}) >= 0.8 * length({_re('chg', r'[^\p{L}]')}) AND len(string_split(lower(e1 || ' ' || e2), lower(chg))) > 2)) THEN 'header_footer'
  WHEN c1 <> '' AND c2 <> '' AND {_squeeze(_line_key(_DASH.format(x='c1')))} = {_squeeze(_line_key(_DASH.format(x='c2')))} THEN {_TYPE('c1', 'c2')} END"""
_DECIDED = """
  kinds AS (SELECT *, CASE WHEN event_type IN ('signup', 'view') THEN 'technical' WHEN event_type = 'click' THEN 'ocr_uncertain' WHEN event_type = 'error' THEN 'alignment_error' ELSE 'substantive' END AS category FROM events),
  decided AS (SELECT CAST(user_id AS VARCHAR) AS job_id, category, CASE event_type WHEN 'signup' THEN 'deterministic' WHEN 'view' THEN 'llm' WHEN 'click' THEN 'fallback' ELSE 'alignment_retry' END AS decider,
    event_id % 3 > 0 AND (user_id % 5 > 0 OR category = 'technical') AND user_id % 7 > 0 AS shown FROM kinds)"""

ORACLES: dict[str, str] = {
    "normalize_technical_docs": f"SELECT doc_id, length(t) AS n, sha256(t) AS sha FROM (SELECT doc_id, {_layout_free('text')} AS t FROM documents)",
    "collapse_whitespace_docs": f"SELECT doc_id, length(t) AS n, sha256(t) AS sha FROM (SELECT doc_id, {_literal_key('text')} AS t FROM documents)",
    "alignment_key_docs": f"""WITH n AS (SELECT doc_id, {_DASH.format(x=_layout_free('text'))} AS t FROM documents),
      l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(0, len(string_split(t, chr(10))))) AS i FROM n),
      k AS (SELECT doc_id, {_squeeze("coalesce(string_agg(" + _line_key('line') + ", ' ' ORDER BY i) FILTER (WHERE " + _strip('line') + " <> ''), '')")} AS t FROM l GROUP BY doc_id)
      SELECT doc_id, length(t) AS n, sha256(t) AS sha FROM k""",
    "clip_docs": f"SELECT doc_id, {_CLIP} AS clipped FROM (SELECT doc_id, {_squeeze('text')} AS t FROM documents)",
    "token_counts": rf"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_types FROM (SELECT doc_id, regexp_extract_all(text, '{_W}+|[^\p{{L}}\p{{N}}_\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]') AS t FROM documents)",
    "line_kind_counts": f"SELECT coalesce({_KIND}, 'text') AS kind, count(*) AS n FROM (SELECT {_strip('line')} AS l FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY 1",
    "change_tags_pairs": f"WITH {_LINE_PAIRS}, f AS (SELECT *, a || b AS c, {_FOLD('a')} AS l, {_FOLD('b')} AS r FROM line_pairs) SELECT job_id, line_no, "
    + _TAGS(
        ("TRUE", "literal"), (r"regexp_matches(c, '\p{L}')", "word"), (r"regexp_matches(c, '[\p{Nd}²³¹]')", "digit"), (r"regexp_matches(c, '[^\p{L}\p{N}\s\x{a0}]')", "punctuation"),
        ("a <> b AND lower(a) = lower(b)", "case"), ("('не' || r = l) OR ('не' || l = r)", "prefix_ne"), ("('без' || r = l) OR ('без' || l = r)", "prefix_bez"),
    )
    + " AS tags FROM f",
    "protection_tags_pairs": f"WITH {_PROTECTED} SELECT job_id, line_no, tags FROM tagged",
    "safety_gate": f"""WITH {_PROTECTED} SELECT job_id, line_no, CASE WHEN tags <> '' THEN 'substantive' ELSE 'ocr_uncertain' END AS category, CAST(NULL AS VARCHAR) AS technical_type,
      'safety_override' AS classified_by, CASE WHEN tags <> '' THEN 'protected_content' ELSE 'unproven_technical' END AS reason FROM tagged""",
    "technical_type_pairs": f"WITH {_LINE_PAIRS} SELECT job_id, line_no, a <> b AND {_DASH.format(x='a')} = {_DASH.format(x='b')} AS dash, {_TECH} AS technical_type FROM line_pairs",
    "numbering_words": f"SELECT w, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \\n]')) AS w FROM documents) WHERE regexp_matches(w, '{_NUMBERING}') GROUP BY 1",
    "model_answers": "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(1 AS BIGINT) END AS n, CASE WHEN event_type = 'error' THEN NULL ELSE 'e' || event_id END AS candidate_id FROM events",
    "block_segments": f"WITH RECURSIVE src AS (SELECT doc_id, text FROM documents), {_blocks('src', 'doc_id')} SELECT doc_id, kind, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM blk GROUP BY 1, 2",
    "block_neighbours": f"""WITH RECURSIVE {_SIDES}, {_blocks('pages_', 'job_id, side, page')},
      o AS (SELECT job_id, side, page, text, row_number() OVER d - 1 AS idx, row_number() OVER (PARTITION BY job_id, side, page ORDER BY i, sub, part, cut) AS block, lag(text, 1, '') OVER d AS previous, lead(text, 1, '') OVER d AS next
        FROM blk WINDOW d AS (PARTITION BY job_id, side ORDER BY page, i, sub, part, cut))
      SELECT job_id, side, idx AS index, page, block, sha256(previous || '|' || text || '|' || next) AS sha FROM o""",
    "alignment_texts": f"""WITH RECURSIVE {_SIDES}, {_blocks('pages_', 'job_id, side, page')}, t AS (SELECT job_id, side, string_agg(text, ' ' ORDER BY page, i, sub, part, cut) AS t FROM blk GROUP BY 1, 2)
      SELECT job_id, side, length(t) AS n, sha256(t) AS sha FROM t""",
    "dedupe_lines": rf"""WITH RECURSIVE {_LINE_PAIRS}, o AS (SELECT job_id, format('{{}}:{{:05d}}', job_id, line_no) AS id, row_number() OVER (PARTITION BY job_id ORDER BY line_no) AS k, lower({_literal_key('a')}) AS k1, lower({_literal_key('b')}) AS k2 FROM line_pairs),
      r AS (SELECT job_id, id, k, CAST(NULL AS VARCHAR) AS duplicate_of, [struct_pack(id := id, k1 := k1, k2 := k2)] AS kept FROM o WHERE k = 1 UNION ALL
        SELECT job_id, id, k, hit, CASE WHEN hit IS NULL THEN list_append(kept, struct_pack(id := id, k1 := k1, k2 := k2)) ELSE kept END
        FROM (SELECT o.*, r.kept, list_filter(r.kept, lambda q: {_SAME('q.k1', 'o.k1')} AND {_SAME('q.k2', 'o.k2')})[1].id AS hit FROM r JOIN o ON o.job_id = r.job_id AND o.k = r.k + 1))
      SELECT job_id, id AS candidate_id, duplicate_of FROM r""",
    "batch_packing_lines": f"""WITH RECURSIVE {_LINE_PAIRS}, o AS (SELECT job_id, format('{{}}:{{:05d}}', job_id, line_no) AS id, row_number() OVER (PARTITION BY job_id ORDER BY line_no) AS k, length(a) + length(b) + 300 AS size FROM line_pairs),
      r AS (SELECT job_id, id, k, CAST(1 AS BIGINT) AS batch, 1 AS n, size AS chars FROM o WHERE k = 1 UNION ALL
        SELECT o.job_id, o.id, o.k, r.batch + CASE WHEN r.n >= 6 OR r.chars + o.size > 10000 THEN 1 ELSE 0 END, CASE WHEN r.n >= 6 OR r.chars + o.size > 10000 THEN 1 ELSE r.n + 1 END,
          CASE WHEN r.n >= 6 OR r.chars + o.size > 10000 THEN o.size ELSE r.chars + o.size END FROM r JOIN o ON o.job_id = r.job_id AND o.k = r.k + 1)
      SELECT job_id, id AS candidate_id, batch AS batch_index FROM r""",
    "technical_rules": f"WITH {_DECORATED} SELECT doc_id, {_RULE} AS technical_type FROM cand",
    "group_technical": f"""WITH {_DECORATED}, g AS (SELECT *, row_number() OVER w AS pos, first(e1) OVER w AS g1, first(e2) OVER w AS g2 FROM cand WINDOW w AS (PARTITION BY job_id, alignment_id ORDER BY doc_id)),
      m AS (SELECT alignment_id, min(doc_id) AS sort_order, any_value(g1) AS g1, any_value(g2) AS g2, coalesce(string_agg(c1, ' ' ORDER BY doc_id) FILTER (WHERE c1 <> ''), '') AS changed1, coalesce(string_agg(c2, ' ' ORDER BY doc_id) FILTER (WHERE c2 <> ''), '') AS changed2 FROM g GROUP BY job_id, alignment_id)
      SELECT alignment_id, sort_order, {_TYPE('g1', 'g2')} AS group_type, changed1, changed2 FROM m WHERE g1 <> '' AND g2 <> '' AND {_squeeze(_line_key(_DASH.format(x='g1')))} = {_squeeze(_line_key(_DASH.format(x='g2')))}""",
    "fallback_decisions": """WITH b AS (SELECT event_id, max(event_type) OVER (PARTITION BY CAST(floor(event_id / 4.0) AS BIGINT)) AS t FROM events)
      SELECT CAST(event_id AS VARCHAR) AS candidate_id, 'ocr_uncertain' AS category, CAST(NULL AS VARCHAR) AS technical_type, CASE WHEN t = 'view' THEN 'model_unavailable' ELSE 'invalid_response' END AS reason,
        0.0::DOUBLE AS confidence, 'fallback' AS classified_by, FALSE AS parse_ok FROM b""",
    "candidate_ids": """WITH o AS (SELECT CAST(l_orderkey AS VARCHAR) AS job_id, CAST(l_linenumber AS BIGINT) AS ord, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 3, l_linenumber) AS sort_order FROM lineitem)
      SELECT *, format('{}:c{:05d}', job_id, sort_order) AS candidate_id FROM o""",
    "shown_counts": f"""WITH {_DECIDED} SELECT job_id, count(*) FILTER (WHERE category = 'technical' AND decider = 'deterministic') AS deterministic_technical, count(*) FILTER (WHERE decider IN ('llm', 'alignment_retry')) AS llm_classified,
        {", ".join(f"count(*) FILTER (WHERE category = '{c}') AS n_{c}" for c in ("substantive", "technical", "alignment_error", "ocr_uncertain"))} FROM decided WHERE shown GROUP BY 1""",
    "event_verdicts": f"""WITH {_DECIDED} SELECT job_id, CASE WHEN count(*) FILTER (WHERE shown) = 0 THEN 'identical' WHEN bool_and(category = 'technical') FILTER (WHERE shown) THEN 'content_equal' ELSE 'different' END AS verdict,
        count(*) FILTER (WHERE shown) AS n_differences FROM decided GROUP BY 1""",
    "special_blocks": f"""WITH l AS (SELECT doc_id, unnest(string_split({_layout_free('text')}, chr(10))) AS l FROM documents), k AS (SELECT doc_id, {_KIND} AS kind FROM l)
      SELECT doc_id, kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY 1, 2""",
    "pair_verdict_literal": f"WITH {_PAIRS} SELECT CASE WHEN {_literal_key('text1')} = {_literal_key('text2')} THEN 'identical' ELSE 'different' END AS verdict, count(*) AS n FROM pairs GROUP BY 1",
    "identity_short_circuit": f"""WITH {_SIDES}, d AS (SELECT job_id, side, string_agg(text, chr(10) || chr(10) ORDER BY page) AS t FROM pages_ GROUP BY 1, 2)
      SELECT x.job_id, {_literal_key('x.t')} = {_literal_key('y.t')} AS identical FROM d x JOIN d y ON x.job_id = y.job_id AND x.side = 1 AND y.side = 2""",
    "validate_batch": """WITH b AS (SELECT event_id, CAST(floor(event_id / 6.0) AS BIGINT) AS k, event_type FROM events), g AS (SELECT k, bool_and(event_type <> 'error') AS ok, count(*) AS n FROM b GROUP BY 1)
      SELECT CASE WHEN ok THEN 'substantive' ELSE 'ocr_uncertain' END AS category, CASE WHEN ok THEN 'r' ELSE 'invalid_response' END AS reason, CASE WHEN ok THEN 'llm' ELSE 'fallback' END AS classified_by,
        ok AS parse_ok, CAST(sum(n) AS BIGINT) AS n, max(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS confidence FROM g GROUP BY ok""",
    "chunk_completeness": f"WITH {_CONV} SELECT job_id, count(*) AS stored_chunks FROM (SELECT job_id, page_number FROM conv GROUP BY 1, 2 HAVING count(DISTINCT side) = 2) GROUP BY 1",
    "document_assembly": f"""WITH {_CONV}, p AS (SELECT *, CASE WHEN page_number % 2 = 0 THEN 'n' || page_number ELSE '' END AS filename FROM conv)
      SELECT job_id, side, coalesce(min_by(filename, page_number) FILTER (WHERE filename <> ''), 'file' || side) AS filename, count(*) FILTER (WHERE page_number <> 3) AS n_pages,
        sha256(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY page_number) FILTER (WHERE page_number <> 3 AND text <> ''), '')) AS sha FROM p GROUP BY 1, 2""",
    "page_upserts": """SELECT l_orderkey AS job_id, l_linenumber AS page_number, CAST(l_partkey % 2 + 1 AS INTEGER) AS side, l_partkey FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey % 2 ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, CAST(l_quantity AS BIGINT) DESC) = 1""",
    "terminal_skip": f"WITH {_JOBS} SELECT l_orderkey AS job_id, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT job_id FROM jobs_ WHERE status = 'completed') GROUP BY 1",
    "ready_jobs": f"WITH {_JOBS} SELECT job_id, user_id FROM jobs_ WHERE status = 'ocr_ready' AND NOT comparison_claimed AND processed_chunks >= 4",
    "total_chunks_max": f"WITH {_LOG} SELECT job_id, max(total_chunks) AS total_chunks, min_by(ts, seq) AS created_at, max_by(ts, seq) AS updated_at FROM log GROUP BY 1",
    "list_jobs_by_owner": "SELECT o_custkey AS user_id, o_orderkey AS job_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS position FROM orders",
    "latest_result": "SELECT o_custkey AS job_id, o_orderkey AS result_id, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "events_after": f"WITH {_LOG}, s AS (SELECT job_id, seq AS event_id, row_number() OVER (PARTITION BY job_id ORDER BY ts, seq) AS seq FROM log) SELECT * FROM s WHERE seq > 50",
    "run_numbers": f"WITH {_LOG} SELECT job_id, count(*) AS runs FROM log WHERE status = 'ocr_ready' GROUP BY 1",
    "state_transitions": f"""WITH {_LOG}, {_TRANSITIONS}, s AS (SELECT lag(status) OVER (PARTITION BY job_id ORDER BY ts, seq) AS from_status, status AS to_status FROM log)
      SELECT from_status, to_status, count(*) AS n, CASE WHEN from_status = to_status THEN from_status <> 'failed' ELSE bool_or(f IS NOT NULL) END AS legal
      FROM s LEFT JOIN moves ON f = from_status AND t = to_status WHERE from_status IS NOT NULL GROUP BY 1, 2""",
    "upsert_job_current": f"""WITH RECURSIVE {_LOG}, o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS k, count(*) OVER (PARTITION BY job_id) AS n FROM log),
      r AS (SELECT job_id, k, n, status, greatest(total_chunks, 0) AS total_chunks, message, file1_name FROM o WHERE k = 1 UNION ALL
        SELECT o.job_id, o.k, o.n, CASE WHEN o.status = 'failed' THEN 'failed' WHEN r.status IN ('ocr_ready', 'failed') AND o.status IN ('queued', 'preparing', 'processing') THEN r.status ELSE o.status END,
          CASE WHEN o.total_chunks > 0 THEN greatest(r.total_chunks, o.total_chunks) ELSE r.total_chunks END, CASE WHEN o.message <> '' THEN o.message ELSE r.message END,
          CASE WHEN o.file1_name <> '' THEN o.file1_name ELSE r.file1_name END FROM r JOIN o ON o.job_id = r.job_id AND o.k = r.k + 1)
      SELECT job_id, status, CAST(total_chunks AS INTEGER) AS total_chunks, message, file1_name, '' AS file2_name, n AS n_writes FROM r WHERE k = n""",
    "state_replay": f"""WITH RECURSIVE {_LOG}, {_TRANSITIONS}, o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, seq) AS k, count(*) OVER (PARTITION BY job_id) AS n FROM log),
      r AS (SELECT job_id, k, n, status, CAST(0 AS BIGINT) AS moves, CAST(0 AS BIGINT) AS illegal FROM o WHERE k = 1 UNION ALL
        SELECT o.job_id, o.k, o.n, CASE WHEN ok THEN o.status ELSE r.status END, r.moves + CAST(ok AS BIGINT), r.illegal + CAST(NOT ok AS BIGINT)
        FROM r JOIN o ON o.job_id = r.job_id AND o.k = r.k + 1, LATERAL (SELECT CASE WHEN r.status = o.status THEN r.status <> 'failed' ELSE (r.status || '>' || o.status) IN (SELECT f || '>' || t FROM moves) END AS ok))
      SELECT job_id, status, moves, illegal FROM r WHERE k = n""",
    "recover_leases": f"""WITH {_JOBS} SELECT job_id, CASE WHEN dead THEN 'failed' ELSE 'running' END AS run_status, CASE WHEN dead THEN 'restarted' END AS error_message,
        CASE WHEN dead THEN 'ocr_ready' ELSE status END AS job_status, CASE WHEN dead THEN FALSE ELSE comparison_claimed END AS comparison_claimed
      FROM (SELECT *, coalesce(lease_owner = 'w1' OR lease_owner IS NULL OR created_at < TIMESTAMP '1997-01-01 00:00:00', TRUE) AS dead FROM jobs_) WHERE status = 'comparing'""",
    "job_progress": "SELECT l_orderkey AS job_id, count(DISTINCT l_linenumber) AS done, count(DISTINCT l_linenumber) >= 4 AS complete, count(DISTINCT l_linenumber) || '/4' AS progress_text FROM lineitem GROUP BY 1",
    "guarded_status": f"""WITH {_JOBS}, h AS (SELECT *, job_id % 2 = 0 AS hit, status = 'completed' AS sticky FROM jobs_)
      SELECT job_id, CASE WHEN hit AND NOT sticky THEN 'failed' ELSE status END AS status, CASE WHEN hit AND NOT sticky THEN 'x' ELSE 'm' END AS message, CASE WHEN hit THEN 'pipeline_error' END AS failure_code,
        CASE WHEN hit AND NOT sticky THEN {_AS_OF} END AS failed_at, CASE WHEN hit THEN FALSE ELSE comparison_claimed END AS comparison_claimed, CASE WHEN NOT hit THEN lease_owner END AS lease_owner, CAST(1 + CAST(hit AS INTEGER) AS INTEGER) AS state_version FROM h""",
    "claim_winners": f"""WITH {_JOBS}, bids AS (SELECT l_orderkey AS job_id, 'w' || l_suppkey AS owner, l_shipdate AS stamp FROM lineitem), winner AS (SELECT job_id, owner FROM bids QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY stamp, owner) = 1)
      SELECT job_id, 'comparing' AS status, owner AS lease_owner, CAST(1 AS BIGINT) AS lease_epoch, {_AS_OF} + INTERVAL 900 SECOND AS lease_expires_at FROM jobs_ JOIN winner USING (job_id)
      WHERE NOT comparison_claimed AND status <> 'completed' AND job_id % 11 <> 0 AND processed_chunks >= 4""",
    "run_numbers_continued": f"""WITH {_LOG}, last AS (SELECT job_id, count(*) AS n FROM log WHERE status = 'ocr_ready' GROUP BY 1)
      SELECT seq AS event_id, coalesce(n, 0) + row_number() OVER (PARTITION BY log.job_id ORDER BY ts, seq) AS run_number FROM log LEFT JOIN last ON last.job_id = log.job_id WHERE status = 'failed'""",
    "event_append": "SELECT o_orderkey AS job_id, CAST(o_orderkey % 4 + count(l_orderkey) AS BIGINT) AS last_event_seq FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "transition_moves": f"""WITH {_JOBS}, m AS (SELECT job_id, status, job_id % 3 AS version, CASE WHEN job_id % 2 = 0 THEN created_at END AS completed_at, CASE WHEN job_id % 2 = 0 THEN 'completed' WHEN job_id % 5 = 0 THEN 'failed' ELSE 'comparing' END AS to_status,
          CASE job_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 END AS want, CASE WHEN job_id % 4 < 2 THEN 'comparing' END AS from_status FROM jobs_),
        ok AS (SELECT *, coalesce((want IS NULL OR want = version) AND (from_status IS NULL OR (from_status = status)) AND (to_status IN ('completed', 'failed') OR status NOT IN ('completed', 'failed')), FALSE) AS moved FROM m)
      SELECT job_id, CASE WHEN moved THEN to_status ELSE status END AS status, CASE WHEN moved AND job_id % 6 = 0 THEN 'done' ELSE 'm' END AS message, CASE WHEN moved AND job_id % 5 = 0 THEN 'x' END AS failure_code, CAST(version + CAST(moved AS INTEGER) AS BIGINT) AS state_version,
        CASE WHEN moved AND to_status = 'failed' THEN {_AS_OF} END AS failed_at, CASE WHEN moved AND to_status = 'completed' THEN coalesce(completed_at, {_AS_OF}) ELSE completed_at END AS completed_at, moved FROM ok""",
    "progress_states": """WITH RECURSIVE o AS (SELECT CAST(user_id AS VARCHAR) AS job_id, event_type AS t, event_id % 4 AS total, event_id % 6 AS chunk, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
      r AS (SELECT DISTINCT job_id, CAST(0 AS BIGINT) AS k, n, FALSE AS known, '' AS status, CAST(0 AS BIGINT) AS total, CAST([] AS BIGINT[]) AS done, CAST(0 AS BIGINT) AS fires FROM o UNION ALL
        SELECT job_id, k, n, known OR t IN ('signup', 'view', 'error'),
          CASE t WHEN 'signup' THEN CASE WHEN NOT known OR status IN ('queued', 'preparing') THEN 'queued' ELSE status END WHEN 'view' THEN CASE WHEN NOT known OR status IN ('queued', 'preparing') THEN 'processing' ELSE status END
            WHEN 'click' THEN CASE WHEN full_ THEN 'ocr_ready' ELSE status END WHEN 'purchase' THEN CASE WHEN known THEN 'comparing' ELSE status END ELSE 'failed' END,
          CASE WHEN t IN ('signup', 'view') AND (NOT known OR told > 0) THEN told ELSE total END, CASE WHEN fresh THEN list_append(done, chunk) ELSE done END, fires + CAST(full_ AS BIGINT)
        FROM (SELECT *, fresh AND len(done) + 1 >= total AND status <> 'ocr_ready' AS full_ FROM (SELECT r.job_id, o.k, o.n, r.known, r.status, r.total, r.done, r.fires, o.t, o.total AS told, o.chunk,
          o.t = 'click' AND r.known AND NOT list_contains(r.done, o.chunk) AS fresh FROM r JOIN o ON o.job_id = r.job_id AND o.k = r.k + 1)))
      SELECT job_id, status, total AS total_chunks, CAST(len(done) AS BIGINT) AS processed_chunks, fires AS completions FROM r WHERE k = n AND known""",
    "page_pair_save": f"""WITH {_CONV}, both_ AS (SELECT job_id, count(*) AS stored FROM (SELECT job_id, page_number FROM conv GROUP BY 1, 2 HAVING count(DISTINCT side) = 2) GROUP BY 1), j AS (SELECT job_id, CAST(job_id AS INTEGER) % 5 AS k, max(page_number) AS total FROM conv GROUP BY 1),
      s AS (SELECT *, ['queued', 'processing', 'cancel_requested', 'completed', 'failed'][k + 1] AS status FROM j LEFT JOIN both_ USING (job_id))
      SELECT job_id, CASE WHEN stored IS NOT NULL AND k < 2 THEN CASE WHEN stored >= total THEN 'ocr_ready' ELSE 'processing' END ELSE status END AS status, CAST(greatest(k * 2, coalesce(stored, 0)) AS BIGINT) AS processed_chunks,
        CAST(CASE WHEN stored IS NOT NULL THEN total ELSE 0 END AS BIGINT) AS total_chunks, coalesce(stored >= total, FALSE) AS ready FROM s""",
    "status_relay": "SELECT CAST(event_id AS VARCHAR) AS job_id, event_type AS status, CAST(1 AS BIGINT) AS processed_chunks FROM events WHERE event_type NOT IN ('error', 'signup')",
    "outbox_claim_marked": f"""WITH o AS (SELECT event_id, event_type, ts, CASE WHEN event_id % 5 = 0 THEN ts END AS held FROM events), due AS (SELECT event_id FROM o WHERE event_type <> 'purchase' AND (held IS NULL OR held < {_AS_OF} - INTERVAL 30 SECOND) ORDER BY ts, event_id LIMIT 20)
      SELECT event_id, event_id IN (SELECT event_id FROM due) AS claimed, CASE WHEN event_id IN (SELECT event_id FROM due) THEN {_AS_OF} ELSE held END AS claimed_at FROM o""",
    "inbox_dedupe": "SELECT event_type AS consumer_group, user_id % 40 AS event_id, arg_min(e.event_id, (ts, e.event_id)) AS first_event FROM events e GROUP BY 1, 2",
    "lease_next": f"""WITH w AS (SELECT event_id AS task_id, event_type AS stage, ts, event_id % 9 AS attempt, CASE WHEN event_id % 4 = 0 THEN 'leased' WHEN event_id % 11 = 0 THEN 'completed' ELSE 'pending' END AS status FROM events)
      SELECT stage, task_id, 'leased' AS status, attempt + 1 AS attempt, {_AS_OF} + INTERVAL 900 SECOND AS lease_expires_at FROM w
      WHERE ts <= {_AS_OF} AND (status = 'pending' OR (status = 'leased' AND ts < {_AS_OF})) QUALIFY row_number() OVER (PARTITION BY stage ORDER BY ts, task_id) = 1""",
    "retry_backoff": "SELECT event_id AS task_id, CASE WHEN event_id % 9 >= 8 THEN 'failed' ELSE 'pending' END AS status, CAST(least(60, pow(2, event_id % 9)) AS BIGINT) AS delay FROM events",
    "outbox_claim": f"""SELECT event_id, CAST(user_id AS VARCHAR) AS job_id FROM events WHERE event_type <> 'purchase' AND (event_id % 5 <> 0 OR ts < {_AS_OF} - INTERVAL 30 SECOND) ORDER BY ts, event_id LIMIT 20""",
    "outbox_lag": f"SELECT CAST(coalesce(epoch({_AS_OF}) - floor(epoch(min(ts) FILTER (WHERE event_type <> 'purchase'))), 0) AS BIGINT) AS lag_seconds FROM events",
    "dead_letters": f"""WITH {_CONV} SELECT job_id, page_number AS chunk_index, CASE WHEN max(text) FILTER (WHERE side = 1) IS NOT NULL THEN '[omitted]' END AS content1, length(max(text) FILTER (WHERE side = 1)) AS chars1,
        length(max(text) FILTER (WHERE side = 2)) AS chars2, CAST(500 AS BIGINT) AS error_chars FROM conv GROUP BY 1, 2""",
    "object_digest": "SELECT page_id, sha256(html) AS sha256, octet_length(encode(html)) AS size_bytes FROM pages",
    "merge_fragments": f"WITH {_FRAGMENTS} SELECT job_id, same AND nd = 0 AS identical, {_VERDICT} AS verdict, differences FROM merged",
    "stream_results": f"WITH {_FRAGMENTS} SELECT job_id, same AND nd = 0 AS identical, {_VERDICT} AS verdict, nd AS n_differences FROM merged",
    "legacy_verdict": f"WITH {_FRAGMENTS} SELECT identical, coalesce(verdict, CASE WHEN identical THEN 'identical' ELSE 'different' END) AS verdict, count(*) AS n FROM frag GROUP BY 1, 2",
    "stream_completeness": f"""WITH {_CONV}, c AS (SELECT job_id, page_number, count(DISTINCT side) AS s FROM conv GROUP BY 1, 2)
      SELECT job_id, count(*) FILTER (WHERE s = 2) AS stored_chunks, count(*) FILTER (WHERE s = 2) >= max(page_number) AS ready FROM c GROUP BY 1""",
    "stream_dedupe": "SELECT DISTINCT event_type AS consumer_group, user_id % 40 AS event_id FROM events",
}
