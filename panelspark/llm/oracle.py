"""DuckDB SQL for the operators that SQL can express."""

WORDS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Sources by code point with weights 5, 2, 1; after k rounds of resharing every source
#: above three times its size has stopped there.
OP1 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS total,
         [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3) + 1] AS w
  FROM d GROUP BY source),
level(step, lam) AS (
  SELECT 0, (SELECT sum(total) FROM s)::DOUBLE / (SELECT sum(w) FROM s)
  UNION ALL
  SELECT step + 1, (
    SELECT ((SELECT sum(total) FROM s)::DOUBLE - coalesce(sum(3.0 * total) FILTER (3.0 * total < lam * w), 0))
           / nullif(sum(w) FILTER (NOT 3.0 * total < lam * w), 0) FROM s)
  FROM level WHERE step < 100 AND lam IS NOT NULL),
goal AS (
  SELECT source, total, least(3.0 * total, w * (SELECT max(lam) FROM level)) AS target FROM s),
p AS (
  SELECT d.doc_id, d.size, g.total, g.target, floor(g.target + 1e-6)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source),
t AS (
  SELECT *, CASE WHEN total > 0 THEN budget // total ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, total AS source_size, round(target, 6) AS target,
       (epochs * size + least(size, greatest(0, budget - epochs * total - before)))::BIGINT AS taken,
       (CASE WHEN size = 0 THEN 0
             ELSE epochs + CASE WHEN budget - epochs * total - before > 0 THEN 1 ELSE 0 END END)::BIGINT AS copies
FROM t
"""

OP2 = rf"""
WITH l AS (
  SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      '{UPPER}', '{LOWER}') AS key FROM l),
shared AS (
  SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (
  SELECT k.*, coalesce(k.doc_id <> s.first_id, false) AS dropped FROM k LEFT JOIN shared s USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP8 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS i,
         unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS k
  FROM d WHERE len(w) >= 5),
r AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) > 1 AS again FROM g),
c AS (
  SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS n FROM r WHERE again),
rep AS (SELECT doc_id, sum(n)::BIGINT AS n_repeat_words FROM c GROUP BY doc_id),
dup AS (
  SELECT doc_id, sum(n - 1)::BIGINT AS n_dup_lines FROM (
    SELECT doc_id, line, count(*) AS n FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) GROUP BY doc_id),
s AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(string_split(text, chr(10))) AS n_lines, len(list_distinct(w)) AS n_kinds,
         len(list_distinct(regexp_extract_all(text, '(?s).'))) AS n_letters,
         len(list_filter(string_split(text, chr(10)),
             lambda x: regexp_matches(x, '(?:\.\.\.|\x{2026})[\x20\x09-\x0D]*\z'))) AS n_open_lines
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR word_chars < 2 * n_words
            OR word_chars > 15 * n_words OR 10 * n_symbols > n_words
            OR (10 * n_dup_lines > 3 * n_lines AND n_dup_lines > 1)
            OR 10 * n_kinds < least(n_words, 1000) OR n_letters < 8
            OR (10 * n_open_lines > 3 * n_lines AND n_open_lines > 1)) AS kept
FROM s
"""

OP10 = rf"""
WITH i AS (
  SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1),
         lambda p: array_to_string(w[p:p + 9], ' '))) AS k, least(10, len(w)) AS n
  FROM i WHERE len(w) > 0),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p,
         unnest(list_transform(range(1, len(w) - n + 2), lambda p: array_to_string(w[p:p + n - 1], ' '))) AS k
  FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n),
hit AS (SELECT DISTINCT doc_id, n, p, k FROM dw WHERE k IN (SELECT k FROM iw)),
cov AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM hit JOIN iw USING (k, n) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP9 = r"""
WITH r AS (
  SELECT conv_id, coalesce(nullif(role, ''), 'unknown') AS role, coalesce(role, '') <> '' AS named,
         coalesce(text, '') || '<|end|>' || chr(10) AS body,
         row_number() OVER (PARTITION BY conv_id
                            ORDER BY turn NULLS FIRST, coalesce(nullif(role, ''), 'unknown'), coalesce(text, '')) AS pos
  FROM conversations),
v AS (SELECT DISTINCT conv_id, role AS speaker FROM r WHERE named AND role <> 'system'),
m AS (
  SELECT r.conv_id, speaker, (pos - 1) // 256 AS part, pos, role = speaker AS own, body,
         '<|' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system'
                      ELSE 'user name=' || role END || '|>' || chr(10) AS head
  FROM r JOIN v ON r.conv_id IS NOT DISTINCT FROM v.conv_id),
o AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, part ORDER BY pos) AS stop FROM m)
SELECT conv_id, speaker, part::BIGINT AS part, count(*)::BIGINT AS n_turns, (count(*) FILTER (own))::BIGINT AS n_own,
       string_agg(head || body, '' ORDER BY pos) AS text,
       coalesce(string_agg((stop - length(body))::BIGINT || '-' || (stop - 1)::BIGINT, ',' ORDER BY pos)
                FILTER (own), '') AS mask
FROM o GROUP BY conv_id, speaker, part
"""

OP11 = rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents),
f AS (
  SELECT doc_id, part,
         CASE WHEN len(ws) < 200 THEN 16 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 8 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 2 ELSE 0 END
         + CASE WHEN CASE WHEN doc_id IS NULL THEN first_id IS NOT NULL ELSE doc_id > first_id END THEN 1 ELSE 0 END AS fails
  FROM t),
lab AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
cell AS (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM f LEFT JOIN lab ON f.doc_id = lab.doc_id GROUP BY part, fails),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([16, 8, 4, 2, 1]) AS bit),
ord(filter_order, used) AS (
  SELECT '', 0
  UNION ALL
  SELECT filter_order || l, used + bit FROM ord, letter WHERE length(filter_order) < 5 AND used & bit = 0),
step AS (
  SELECT filter_order, step::INTEGER AS step,
         (SELECT bit FROM letter WHERE l = substr(filter_order, step, 1)) AS own,
         (SELECT coalesce(sum(bit), 0)::INTEGER FROM letter
          WHERE position(l IN substr(filter_order, 1, step - 1)) > 0) AS before
  FROM ord, range(1, 6) r(step) WHERE length(filter_order) = 5),
counted AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN fails & (before + own) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN fails & before = 0 AND fails & own > 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN fails & before > 0 AND fails & own > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN fails & before = 0 AND fails & own > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN fails & before = 0 AND fails & own > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM cell, step GROUP BY part, filter_order, step, own)
SELECT * EXCLUDE (own), sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM counted
"""

ORACLE = {"op1_mix": OP1, "op2_line_dedup": OP2, "op8_quality_rules": OP8, "op9_chat_perspectives": OP9,
          "op10_decontaminate": OP10, "op11_filter_audit": OP11}
