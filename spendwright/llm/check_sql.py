"""DuckDB equivalents of the queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP3 = rf"""
WITH parsed AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parsed),
q AS (SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path FROM p),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule FROM q)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

_CONTROL = r"([<\[])(\\*)(/?s>|/?ROLE\]|TURN\]|/?INST\])"

OP5 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    length(regexp_replace(text, '{_CONTROL}', '\1\2\\\3', 'g')) AS escaped,
    length(regexp_replace(role, '{_CONTROL}', '\1\2\\\3', 'g')) AS escaped_role FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(escaped + CASE WHEN before IS NULL OR before <> role
    THEN length('<s>[ROLE][/ROLE]</s>') + escaped_role ELSE length('[TURN]') END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS p
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, i, n, item FROM dw JOIN bw USING (n, p)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS p FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d)),
f AS (SELECT p, min(doc_id) AS first FROM x GROUP BY p),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS k FROM x JOIN f USING (p) WHERE first < doc_id),
g AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id),
e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.k) AS body FROM e LEFT JOIN gone ON e.doc_id = gone.doc_id AND e.k = gone.k
  WHERE gone.k IS NULL GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_BASE32 = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, 1 + 5 * (k // 4), 5) AS INTEGER) >> (15 - 5 * (k % 4))) & 31), 1)"

OP10 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS response FROM p),
digits AS (SELECT page_id, string_agg({_BASE32}, '' ORDER BY k) AS payload_digest
  FROM (SELECT page_id, hex, unnest(generate_series(0, 31)) AS k FROM h) GROUP BY page_id)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to
FROM h JOIN digits USING (page_id)
"""

# crc32 of the decimal id: eight shifts for each digit
_BIT = "lambda c, b: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
_CRC = f"""xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
  lambda c, x: list_reduce([1, 2, 3, 4, 5, 6, 7, 8], {_BIT}, xor(c, x)), CAST(4294967295 AS BIGINT)), 4294967295)"""

OP12 = rf"""
WITH d AS (SELECT doc_id, {_CRC} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
a AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
x AS (SELECT doc_id, n, h, g, a, p, w, unnest(generate_series(0, n - 1)) AS i FROM p WHERE n > 0),
e AS (SELECT doc_id, n, i, w[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM x),
same AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM e l JOIN e r ON l.doc_id = r.doc_id AND l.word = r.word AND r.i > l.i AND r.i - l.i <= l.n // 4),
marks AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same),
found AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM marks GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM found o WHERE o.doc_id = f.doc_id AND o.q < f.q AND o.s <= f.s AND o.s + o.len >= f.s + f.len)),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
  max(struct_pack(l := len, s := -s, q := -q)) AS best FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s + q, s + len - 1)) AS i FROM runs),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS body FROM e ANTI JOIN gone ON e.doc_id = gone.doc_id AND e.i = gone.i GROUP BY e.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(-best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length, CAST(-best.q AS BIGINT) AS period,
  CAST(1000 * best.l // -best.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP13 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, x, unnest(generate_series(0, len(x) // 2 - 50)) AS i FROM d WHERE len(x) >= 100)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE first < doc_id),
marks AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM gone),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM marks) GROUP BY doc_id, island),
cut AS (SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next FROM spans),
parts AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, min(a) AS head FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * b + 1, 2 * (coalesce(next, len(x) // 2) - b)), '' ORDER BY a) AS body FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN head IS NULL THEN x ELSE substr(x, 1, 2 * head) || body END)) AS kept_sha256
FROM d LEFT JOIN parts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

SQL = {"op12_periodic_runs": OP12, "op13_suffix_dedup": OP13, "op3_url_filter": OP3, "op5_chat_format": OP5, "op8_decontamination": OP8, "op9_substring_dedup": OP9, "op10_warc": OP10}
