"""DuckDB SQL of the queries that SQL can express; the others are tested against brute force."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

WARC = """
WITH h AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hx FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY hx) AS least_id FROM h)
SELECT page_id, strlen(body) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(hx, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)
    FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM least_id AND least_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM least_id THEN least_id END AS refers_to
FROM g
"""

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bi AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bi),
ns AS (SELECT DISTINCT n FROM bw),
di AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM di),
hits AS (SELECT rid, n, i, item_id FROM dw JOIN bw USING (n, g)),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS lst
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(lst, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN it USING (rid)
"""

CHAT = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(i)),
e AS (SELECT *, CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9
    ELSE 1 + length(url_encode(role)) END AS header,
  replace(replace(replace(text, '\', '\\'), '#', '\#'), '</', '<\/') AS escaped,
  row_number() OVER o - 1 AS place, lag(role, 1, '') OVER o || '>' || role AS step,
  last_value(role) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_role FROM t
  WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + header + 2 + length(escaped) + 8) AS BIGINT) AS formatted_chars,
  count(*) FILTER (step NOT IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user')) = 0
    AND min(last_role) = 'assistant' AS valid,
  coalesce(min(place) FILTER (step NOT IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user')), -1) AS bad_turn
FROM e GROUP BY conv_id
"""

_BLANKS = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"
LINES = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
l AS (SELECT rid, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM d WHERE text IS NOT NULL),
k AS (SELECT *, trim(line, {_BLANKS}) AS bare FROM l),
total AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
boiler AS (SELECT k.source, bare FROM k JOIN total ON k.source IS NOT DISTINCT FROM total.source WHERE bare <> ''
  GROUP BY k.source, bare, pages HAVING count(DISTINCT rid) >= 3 AND count(DISTINCT rid) > 0.1 * pages),
marked AS (SELECT k.*, EXISTS (SELECT 1 FROM boiler b WHERE b.bare = k.bare AND b.source IS NOT DISTINCT FROM k.source) AS drop_it FROM k),
doc AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (drop_it) AS hit,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT drop_it), '') AS rest,
  bool_or(NOT drop_it AND bare <> '') AS any_left FROM marked GROUP BY rid)
SELECT doc_id, CASE WHEN hit > 0 AND any_left THEN rest ELSE text END AS text, coalesce(n_lines, 0) AS n_lines,
  CASE WHEN any_left THEN hit ELSE 0 END AS n_dropped
FROM d LEFT JOIN doc USING (rid)
"""

SUBSTRINGS = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
g AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM s),
late AS (SELECT rid, i FROM (SELECT rid, i, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, i) AS k FROM g) WHERE k > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 20)) AS p FROM late),
per AS (SELECT rid, count(*) AS n_removed, list(p) AS ps FROM gone GROUP BY rid),
kept AS (SELECT d.rid, string_agg(x.word, ' ' ORDER BY x.p) AS k
  FROM (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) x JOIN d ON d.rid = x.rid
  WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.rid = x.rid AND gone.p = x.p) GROUP BY d.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN per USING (rid) LEFT JOIN kept USING (rid)
"""

PHRASES = f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, {_LOWER} AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^ \x09]+') AS w FROM d),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p WHERE len(w) > 0),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS k FROM s)),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k AS size, g AS phrase, f AS a, string_split(g, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
inner_parts AS (SELECT lang, a, array_to_string(w[j:j + m - 1], ' ') AS part
  FROM (SELECT lang, a, w, m, unnest(range(1, size - m + 2)) AS j FROM (SELECT *, unnest(range(2, size)) AS m FROM c))),
longest AS (SELECT lang, part, max(a) AS most FROM inner_parts GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN longest l ON l.lang = c.lang AND l.part = c.phrase WHERE l.most IS NULL OR 100 * l.most < 100 * c.a),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS h, array_to_string(w[k + 1:], ' ') AS t
  FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)),
scored AS (SELECT u.lang, phrase, a, u.k, fl.f AS l, fr.f AS r, n,
    CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(fl.f AS HUGEINT) * fr.f) AS BIGINT) AS score
  FROM cuts u JOIN f fl ON fl.lang = u.lang AND fl.g = h JOIN f fr ON fr.lang = u.lang AND fr.g = t JOIN total ON total.lang = u.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

ORACLE = {
    "op1_warc": WARC,
    "op4_decontamination": DECONTAMINATION,
    "op6_chat_formatting": CHAT,
    "op7_line_dedup": LINES,
    "op12_substring_dedup": SUBSTRINGS,
    "op13_phrase_collocations": PHRASES,
}
