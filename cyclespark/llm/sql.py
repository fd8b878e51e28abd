"""DuckDB SQL for those training-data queries that SQL can express on whole tables.

Search, tokenisation, packing, the license rules' own labels and the bootstrapped
extraction have none; their tests compare with brute-force versions.
"""

from __future__ import annotations

LINES = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM d),
w AS (SELECT doc_id, i, n, array_to_string(ls[i + 1:i + n], chr(10)) AS k FROM (SELECT *, unnest([1, 2, 3]) AS n FROM l) WHERE i + n <= len(ls)),
q AS (SELECT *, min((doc_id, i)) OVER (PARTITION BY n, k) AS first FROM w WHERE n = 3 OR length(k) - length(replace(k, ' ', '')) + n >= 50),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM q WHERE first <> (doc_id, i)),
marked AS (SELECT l.doc_id, l.i, l.ls[l.i + 1] AS line, g.i IS NOT NULL AS gone, coalesce(lag(g.i IS NOT NULL) OVER (PARTITION BY l.doc_id ORDER BY l.i), false) AS before
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i)
SELECT doc_id, count(*) AS n_lines, count_if(gone) AS n_removed, count_if(gone AND NOT before) AS n_spans,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

NEAR = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
linked AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS doc_id, a AS reach FROM linked UNION SELECT r.doc_id, linked.b FROM r JOIN linked ON r.reach = linked.a),
m AS (SELECT doc_id, min(reach) AS c FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""

QUALITY = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 8], ' ') AS k FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 7, 0))) AS i FROM d)),
rep AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(nx - i, 8))) AS r FROM rep GROUP BY 1),
f AS (SELECT d.doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id),
g AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_symbols > CAST(0.1 AS DOUBLE) * n_words AS s1, n_dup_lines > CAST(0.3 AS DOUBLE) * n_lines AS s2,
    word_chars / greatest(n_words, 1) < 2 OR word_chars / greatest(n_words, 1) > 12 AS s3 FROM f),
h AS (SELECT source, count(*) AS n, unnest([1, 2, 3]) AS r, unnest([count_if(s1), count_if(s2), count_if(s3)]) AS x FROM g GROUP BY 1),
m AS (SELECT r, sum(x) / sum(n) AS m, var_pop(x / n) AS v, avg(1 / n) AS inv FROM h GROUP BY 1),
p AS (SELECT h.source, h.r, n, x, m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * inv, 1e-9) - 1, 1), 1e6) AS k FROM h JOIN m ON m.r = h.r),
bad AS (SELECT source, bool_or(r = 1) AS b1, bool_or(r = 2) AS b2, bool_or(r = 3) AS b3 FROM p WHERE (x + m * k) / (n + k) >= 0.5 GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ((s1 AND coalesce(b1, false)) OR (s2 AND coalesce(b2, false)) OR (s3 AND coalesce(b3, false))) AS kept
FROM g LEFT JOIN bad ON bad.source IS NOT DISTINCT FROM g.source
"""

CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(replace(text, '\', '\\'), '(<<SYS>>|<</SYS>>|<s>|</s>|\[INST\]|\[/INST\]|\[ROLE\]|\[/ROLE\]|\[TEXT\])', '\1#', 'g')) AS chars,
    CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 ELSE 20 + length(role) END AS frame FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(chars + frame) AS BIGINT) AS formatted_chars, string_agg(role, ',' ORDER BY turn, role, text) || ',' AS roles FROM e GROUP BY 1)
SELECT * EXCLUDE (roles), regexp_full_match(roles, '(system,)?(user,assistant,)*(user,)?') AS valid, regexp_full_match(roles, '(system,)?(user,assistant,)+') AS complete FROM g
"""

SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(greatest(len(h) // 2 - 49, 0))) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS f FROM w GROUP BY s),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w JOIN m ON m.s = w.s WHERE f < doc_id),
isl AS (SELECT *, sum(CASE WHEN p IS NULL OR i - p > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM hit),
sp AS (SELECT doc_id, g, min(i) AS a, max(i) + 50 AS z FROM isl GROUP BY 1, 2),
gap AS (SELECT doc_id, g, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY g), 0) AS pz FROM sp),
k AS (SELECT d.doc_id, string_agg(substr(h, 2 * pz + 1, 2 * (a - pz)), '' ORDER BY g) || substr(any_value(h), 2 * max(z) + 1) AS kept, sum(z - a) AS r, count(*) AS c
  FROM gap JOIN d ON d.doc_id = gap.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, coalesce(c, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
first AS (SELECT text, min(doc_id) AS f FROM d GROUP BY text),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(d.text, '[A-Z]')) > 5 * length(d.text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN f < d.doc_id THEN 'E' ELSE '' END AS fails
  FROM d JOIN first ON first.text = d.text LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM m GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e
  WHERE a.f <> b.f AND a.f <> c.f AND a.f <> d.f AND a.f <> e.f AND b.f <> c.f AND b.f <> d.f AND b.f <> e.f AND c.f <> d.f AND c.f <> e.f AND d.f <> e.f),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before FROM (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o)),
r AS (SELECT *, contains(fails, f) AS fails_f, before <> '' AND regexp_matches(fails, '[' || before || 'x]') AS gone FROM c, s),
g AS (SELECT part, filter_order, step, f,
    sum(CASE WHEN NOT fails_f AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails_f AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails_f AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails_f AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails_f AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM r GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM g
"""

ORACLES: dict[str, str] = {
    "op1_line_dedup": LINES,
    "op6_near_dedup": NEAR,
    "op7_quality_rules": QUALITY,
    "op8_chat_format": CHAT,
    "op9_suffix_dedup": SUBSTRINGS,
    "op12_filter_audit": AUDIT,
}
