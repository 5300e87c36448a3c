"""DuckDB SQL of the text queries that SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS k FROM d, unnest(range(1, len(ws) - 11)) t(i)),
early AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM early WHERE first < doc_id),
w AS (SELECT doc_id, p, ws[p] AS word FROM d, unnest(range(1, len(ws) + 1)) t(p)),
kept AS (SELECT w.doc_id, count(g.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY w.p) FILTER (g.p IS NULL), '') AS t FROM w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.p = g.p GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

OP4 = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) END) AS k FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.m AS component_id, r.m = d.doc_id AS kept FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT a, min(b) AS m FROM reach GROUP BY 1) r ON d.doc_id = r.a
"""

OP10 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, {_WORDS} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM d, unnest(range(1, len(ws) - 1)) t(i)),
dup AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup WHERE c > 1) GROUP BY 1),
f AS (SELECT d.doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(array_to_string(ws, '')) - length(regexp_replace(array_to_string(ws, ''), '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS soft FROM f),
h AS (SELECT host, count(*) AS n, count(*) FILTER (soft OR base_failed) AS k, count(*) FILTER (soft OR base_failed) / count(*) AS r FROM j GROUP BY 1),
p AS (SELECT sum(k) / sum(n) AS m, coalesce(var_samp(r), 0) - avg(r * (1 - r) / n) AS s FROM h),
q AS (SELECT host, (k + w * m) / (n + w) <= 0.5 AS trusted FROM h, (SELECT m, least(10000, greatest(1, CASE WHEN s > 0 THEN m * (1 - m) / s - 1 ELSE 100 END)) AS w FROM p))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * n_symbols <= 30 * n_words AND (trusted OR NOT (soft OR base_failed)) AS kept FROM j JOIN q ON j.host = q.host
"""

#: CRC-32 of the ASCII text ``k``, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""
_WAYS = ", ".join(f"({q}, '{i}', '{letters}', {cost}, {after}, {turns})" for q, i, letters, cost, after, turns in (
    # (state, initial kept or '-', letters, cost, state after, roles written): inserts before the row, then keep or rerole
    (q, initial, "I" * n + letter, 3 * n + (3 if letter == "R" else 0), after, [("", "", "user", "assistant")[x] for x in states])
    for q in range(4)
    for n in range(3)
    for states, last in [([2, 3, 2][:n] if q != 2 else [3, 2, 3][:n], q)]
    for s in [states[-1] if states else last]
    for letter, initial, after in [("R", "-", (2, 2, 3, 2)[s]), *(("K", i, t) for (f, i), t in {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.items() if f == s)]
))
OP11 = rf"""
WITH RECURSIVE h AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, CAST({_CRC} AS BIGINT) % 20 AS x FROM h),
d AS (SELECT conv_id, turn, CASE WHEN x = 4 THEN 'user' ELSE role END AS role, CASE x WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM c, unnest(range(CASE x WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) t(copy)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d),
f AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS two FROM o),
ways(q, initial, letters, cost, after, turns) AS (VALUES {_WAYS}),
step AS (SELECT conv_id, i, ways.q, initial, letters, cost + CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS cost, after, array_to_string(list_transform(turns, lambda r: r || ':' || chr(10)), '')
      || CASE WHEN initial = '-' THEN CASE after WHEN 2 THEN 'user' ELSE 'assistant' END ELSE role END || ':' || text || chr(10) AS written
    FROM f, ways WHERE (fault IS NULL OR fault = 'truncated') AND initial IN ('-', substr(role, 1, 1))
  UNION ALL SELECT conv_id, i, q, '', repeat('I', n) || 'D', 3 * n + 4, CASE WHEN n = 0 THEN q WHEN (q = 2) = (n % 2 = 1) THEN 3 ELSE 2 END, array_to_string(list_transform(range(n), lambda m: CASE WHEN (q = 2) = (m % 2 = 0) THEN 'assistant:' ELSE 'user:' END || chr(10)), '')
    FROM f, (VALUES (0), (1), (2), (3)) a(q), (VALUES (0), (1), (2)) b(n)),
best AS (SELECT conv_id, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit, '' AS written FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, i, q, m.cost, m.audit, m.written FROM (SELECT s.conv_id, s.i, s.after AS q, min({{'cost': b.cost + s.cost, 'audit': b.audit || s.letters, 'written': b.written || s.written}}) AS m
    FROM best b JOIN step s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.i = b.i + 1 AND s.q = b.q GROUP BY ALL)),
n AS (SELECT u.conv_id, coalesce(max(i), 0) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) u LEFT JOIN f ON u.conv_id IS NOT DISTINCT FROM f.conv_id GROUP BY ALL),
last AS (SELECT n.conv_id, min({{'cost': b.cost + CASE b.q WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END, 'audit': b.audit || CASE b.q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END, 'written': b.written || CASE b.q WHEN 1 THEN 'user:' || chr(10) || 'assistant:' || chr(10) WHEN 2 THEN 'assistant:' || chr(10) ELSE '' END}}) AS m FROM n JOIN best b ON n.conv_id IS NOT DISTINCT FROM b.conv_id AND n.rows = b.i GROUP BY 1)
SELECT n.conv_id, CAST(gaps AS BIGINT) AS gaps, blank, duplicate, truncated, illegal, CAST(m.cost AS BIGINT) AS cost, m.audit AS audit, sha256(left(m.written, greatest(length(m.written) - 1, 0))) AS repaired_sha256 FROM n JOIN last ON n.conv_id IS NOT DISTINCT FROM last.conv_id
"""

SQL = {"op2_substring_dedup": OP2, "op4_near_dedup": OP4, "op10_quality_rules": OP10, "op11_conversation_repair": OP11}
