"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

OP1 = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (
  SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d
)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN f.first_id IS NULL OR f.first_id = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first_id IS NULL OR f.first_id = p.page_id THEN NULL ELSE f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""

# The thresholds and phrases are those of line_rules.LineRules.
OP4 = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), lines AS (
  SELECT doc_id, u.i AS line_no, u.line AS line,
         len(regexp_extract_all(u.line, '[^\x20\x09-\x0D]+')) AS words,
         len(regexp_replace(u.line, '[^!-/:-@\[-`{-~]', '', 'g')) AS noise,
         len(list_filter(regexp_extract_all(u.line, '[^\x20\x09-\x0D]+'), lambda x: x IN ('|', '>', '/'))) AS bare,
         regexp_matches(lower(u.line), 'all rights reserved|click here|cookie policy|licensed under|privacy policy|sign up for our newsletter|subscribe to our|terms of service|terms of use') AS site
  FROM docs, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i) u
), judged AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) > 1 AS again,
         noise > 0.6 * words + 4 OR (bare >= 2 AND bare >= 0.25 * words) OR site AS failed
  FROM lines WHERE words > 0
), per_line AS (
  SELECT doc_id, count_if(again) AS n_dup_lines, sum(CASE WHEN failed THEN words ELSE 0 END) AS lost FROM judged GROUP BY doc_id
), words AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs
), grams AS (
  SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT doc_id, count(*) AS n_repeat_words
  FROM (SELECT DISTINCT doc_id, i + o.k AS at FROM twice, (SELECT unnest(range(0, 5)) AS k) o) GROUP BY doc_id
), figures AS (
  SELECT d.doc_id, CAST(len(w.w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(p.n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         coalesce(p.lost, 0) AS lost
  FROM docs d JOIN words w USING (doc_id) LEFT JOIN per_line p USING (doc_id) LEFT JOIN covered c USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost <= 0.4 * n_words AS kept
FROM figures
"""

OP5 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(role) + length(text) + len(regexp_replace(role || text, '[^\\<>]', '', 'g')) + 6 + 2 + 8 AS size FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP9 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM g) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, i + o.k AS pos FROM again, (SELECT unnest(range(0, 20)) AS k) o
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w
), kept AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY pos) AS kept
  FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)
"""

OP7 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT u, v FROM common c JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c.c >= 90 * (a.n + b.n - c.c)
), reach AS (
  SELECT u AS doc_id, v AS other FROM links
  UNION
  SELECT r.doc_id, l.v FROM reach r JOIN links l ON r.other = l.u
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles,
       least(d.doc_id, coalesce((SELECT min(other) FROM reach r WHERE r.doc_id = d.doc_id), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)
"""

OP12 = OP7.replace("w[i : i + 2]", "w[i : i + 1]").replace("greatest(len(w) - 1, 2)", "greatest(len(w), 2)").replace(">= 90 *", ">= 80 *")
OP12 = f"SELECT *, doc_id = component_id AS kept FROM ({OP12})"

#: crc32 bit by bit, as there is no such function.
OP13 = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, source,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ord(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
           lambda x, y: list_reduce(list_prepend(xor(x, y), CAST(range(8) AS BIGINT[])), lambda p, q: CASE WHEN p & 1 = 1 THEN xor(p >> 1, CAST(3988292384 AS BIGINT)) ELSE p >> 1 END)), CAST(4294967295 AS BIGINT)) % 5 = 0 AS bad
  FROM documents
), d AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(CASE WHEN bad THEN low ELSE text END) || ':' || CASE WHEN bad THEN low ELSE text END, '-')) AS tried,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
  FROM f
), t AS (
  SELECT source, 0 AS l, i, n, leaf AS h FROM d
  UNION ALL
  SELECT source, l + 1, i // 16, max(n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY source, l, i // 16
), s AS (
  SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1
), u AS (
  SELECT 0 AS l, i, n, h FROM s
  UNION ALL
  SELECT l + 1, i // 16, max(n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY l, i // 16
), runs AS (
  SELECT coalesce('of ' || source, '') AS tree, l, i // 16 AS r, list(h ORDER BY i) AS hs FROM t WHERE n > 1 GROUP BY source, l, i // 16
  UNION ALL
  SELECT 'all', l, i // 16, list(h ORDER BY i) FROM u WHERE n > 1 GROUP BY l, i // 16
), height AS (
  SELECT source, max(l) AS top FROM t GROUP BY source
), path AS (
  SELECT d.doc_id, 0 AS k, coalesce('of ' || d.source, '') AS tree, CASE WHEN h.top = 0 THEN s.i ELSE d.i END AS i, '' AS proof, d.tried AS acc, h.top, s.i AS si
  FROM d JOIN height h ON d.source IS NOT DISTINCT FROM h.source JOIN s ON d.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT p.doc_id, p.k + 1, p.tree, CASE WHEN p.k + 1 = p.top THEN p.si ELSE p.i // 16 END,
         p.proof || array_to_string(x.hs[: p.i % 16], '') || array_to_string(x.hs[p.i % 16 + 2 :], ''),
         sha256(array_to_string(x.hs[: p.i % 16], '') || p.acc || array_to_string(x.hs[p.i % 16 + 2 :], '')), p.top, p.si
  FROM path p JOIN runs x ON x.tree = CASE WHEN p.k < p.top THEN p.tree ELSE 'all' END AND x.l = CASE WHEN p.k < p.top THEN p.k ELSE p.k - p.top END AND x.r = p.i // 16
), last AS (
  SELECT doc_id, arg_max(proof, k) AS proof, arg_max(acc, k) AS acc FROM path GROUP BY doc_id
), root AS (
  SELECT h AS root FROM u WHERE n = 1
)
SELECT d.doc_id, d.leaf, s.h AS subroot, root.root, sha256(last.proof) AS proof_sha256, last.acc AS folded_root, last.acc = root.root AS verified
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source JOIN last USING (doc_id), root
"""

ORACLES = {
    "op1_warc": OP1,
    "op4_line_rules": OP4,
    "op5_chat": OP5,
    "op7_parity_join": OP7,
    "op9_substring": OP9,
    "op12_minhash": OP12,
    "op13_merkle": OP13,
}
