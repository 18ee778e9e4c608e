"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from sensorthread.llm.url_rules import PATTERN_RULES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT x.a, x.b FROM (
    SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS shared
    FROM s p JOIN s q ON p.shingle = q.shingle AND p.doc_id <> q.doc_id GROUP BY 1, 2) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b
  WHERE 100 * x.shared >= 85 * (na.n + nb.n - x.shared)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least.component_id, d.doc_id = least.component_id AS kept
FROM d JOIN least ON least.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP2 = rf"""
WITH d AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, text, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY 1),
w AS (
  SELECT source, total, 3 * total AS most, rank, [5, 2, 1][rank % 3 + 1]::BIGINT AS weight
  FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s)),
l AS (
  SELECT *, sum(total) OVER () - coalesce(sum(most) OVER (
      ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words,
    sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM w),
f AS (
  SELECT *, max(words) FILTER (most * weights > words * weight) OVER () AS free_words,
    max(weights) FILTER (most * weights > words * weight) OVER () AS free_weights FROM l),
t AS (
  SELECT source, total, rank, CASE WHEN most * weights <= words * weight THEN most::DOUBLE
    ELSE (free_words * weight)::DOUBLE / free_weights::DOUBLE END AS target FROM f),
p AS (
  SELECT d.doc_id, d.size, t.total, t.target, t.rank, round(t.target)::BIGINT AS goal,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (
  SELECT *, CASE WHEN total > 0 THEN goal // total ELSE 0 END AS reads FROM p),
k AS (
  SELECT *, (reads * size + greatest(0, least(size, goal - reads * total - begins)))::BIGINT AS taken FROM g),
h AS (SELECT *, (begins + least(size, taken) / 2) / target AS share FROM k)
SELECT doc_id, size, total AS source_size, target, taken,
  CASE WHEN taken > 0 THEN round(least(1.0::DOUBLE, CASE rank % 3
    WHEN 0 THEN 1.5 - sqrt(2.25 - 2 * share)
    WHEN 1 THEN share
    ELSE CASE WHEN share * 0.875 <= 0.25 THEN share * 0.875 / 0.5
      ELSE 0.5 + 0.5 * (sqrt(0.25 + 3 * (share * 0.875 - 0.25) / 0.5) - 0.5) / 1.5 END END), 9) END AS position
FROM h
"""

OP3 = rf"""
WITH b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw))),
hits AS (SELECT dw.doc_id, dw.i, dw.m, bw.item FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win),
words AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM hits) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_PATTERNS = ", ".join("('{}', '{}')".format(r.name, r.pattern.replace("'", "''")) for r in PATTERN_RULES)

OP5 = rf"""
WITH p AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
r AS (
  SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/')) t(verdict, rule_host, rule_path)),
v AS (SELECT * FROM (VALUES {_PATTERNS}) t(name, pattern)),
sites AS (SELECT DISTINCT host, path FROM p),
best AS (
  SELECT host, path, arg_max(rule_host || rule_path, len(rule_host || rule_path)) AS rule,
    arg_max(verdict, len(rule_host || rule_path)) AS verdict
  FROM sites JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY 1, 2),
seen AS (
  SELECT host, path, max({{'n': len(name), 'name': name}}).name AS pattern
  FROM sites JOIN v ON regexp_matches(host || path, pattern) GROUP BY 1, 2)
SELECT p.page_id, p.host, p.path, best.rule,
  coalesce(best.verdict, CASE WHEN seen.pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
  CASE WHEN best.rule IS NULL THEN seen.pattern END AS pattern
FROM p LEFT JOIN best ON best.host = p.host AND best.path = p.path LEFT JOIN seen ON seen.host = p.host AND seen.path = p.path
"""

OP8 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
twice AS (SELECT doc_id, x FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (
  SELECT doc_id, count(DISTINCT pos) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS pos FROM win JOIN twice USING (doc_id, x)) GROUP BY 1),
c AS (
  SELECT doc_id, w, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words
    OR 100 * n_dup_lines > 60 * n_lines
    OR 10 * len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) < 7 * n_words
    OR 20 * len(list_distinct(w)) < least(n_words, 1000)) AS kept
FROM j
"""

OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
win AS (
  SELECT k, i, array_to_string(w[i:i + 34], ' ') AS x
  FROM (SELECT k, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT x FROM win GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT DISTINCT k, unnest(range(i, i + 35)) AS pos FROM win JOIN twice USING (x)),
cut AS (SELECT k, count(*) AS n, list(pos) AS places FROM gone GROUP BY 1),
words AS (SELECT k, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (
  SELECT k, string_agg(word, ' ' ORDER BY pos) AS text FROM words ANTI JOIN gone USING (k, pos) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(cut.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN cut USING (k) LEFT JOIN kept USING (k)
"""

OP11 = rf"""
WITH p AS (
  SELECT row_number() OVER () AS i, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (
  SELECT lang, w[s:s + k - 1] AS words FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s
    FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, words, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(words) = 1 GROUP BY 1),
often AS (SELECT * FROM f WHERE f >= 100),
longer AS (
  SELECT lang, words[s:s + m - 1] AS words, max(f) AS f
  FROM (SELECT lang, words, f, m, unnest(range(1, len(words) - m + 2)) AS s
        FROM often, (SELECT unnest([2, 3, 4]) AS m) WHERE len(words) > m) GROUP BY ALL),
cand AS (
  SELECT o.* FROM often o LEFT JOIN longer USING (lang, words)
  WHERE len(o.words) > 1 AND (longer.f IS NULL OR 100 * longer.f < 100 * o.f)),
cut AS (SELECT lang, words, f, unnest(range(1, len(words))) AS k FROM cand),
scored AS (
  SELECT c.lang, c.words, c.f AS a, c.k, l.f AS l, r.f AS r, n.n,
    ((1000::HUGEINT * c.f * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cut c JOIN often l ON l.lang = c.lang AND l.words = c.words[1:c.k]
  JOIN often r ON r.lang = c.lang AND r.words = c.words[c.k + 1:] JOIN n ON n.lang = c.lang),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
ranked AS (
  SELECT *, array_to_string(words, ' ') AS phrase FROM least)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score
FROM ranked QUALIFY rank <= 2000
"""

OP13 = r"""
WITH t AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 8 AS size,
    xor(4294967295, list_reduce(
      [4294967295] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))::BIGINT AS text_crc32,
    coalesce(substring(md5(text), 1, 16), '----------------') AS h, md5(coalesce(doc_id::VARCHAR, '')) AS g
  FROM documents, t),
a AS (SELECT *, sum(size) OVER (ORDER BY h, g ROWS UNBOUNDED PRECEDING) - size AS place, sum(size) OVER () AS total FROM d),
p AS (SELECT *, min(place) OVER (PARTITION BY h) AS head, sum(size) OVER (PARTITION BY h) AS copies FROM a),
s AS (SELECT *, ((CASE WHEN copies * 2400 <= total THEN head ELSE place END * 24) // total)::INTEGER AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY h, g) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""
