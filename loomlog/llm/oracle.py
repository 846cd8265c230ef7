"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from loomlog.llm.url_filter import BOUND_SDS, FLOOR, RULES, SUFFIXES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def low(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"


SPACED = r"[^\x20\x09-\x0D]+"
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({low("text")}, '{LETTERS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({low("text")}, '{LETTERS}') AS w FROM benchmark),
pat AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS p FROM b, unnest(generate_series(1, greatest(1, len(w) - 9))) t(i) WHERE len(w) > 0),
win AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS p FROM d, (SELECT DISTINCT n FROM pat) s, unnest(generate_series(1, len(w) - n + 1)) t(i) WHERE len(w) >= n),
hit AS (SELECT win.doc_id, win.i, win.n, CAST(pat.item_id AS VARCHAR) AS item FROM win JOIN pat ON win.p = pat.p AND win.n = pat.n),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({low("text")}, '{SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS shingle FROM d, unnest(generate_series(1, greatest(1, len(w) - 4))) t(i) WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN size a ON a.doc_id = x JOIN size b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, l.y FROM reach r JOIN both_ways l ON l.x = r.y),
least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(least_of.y, d.doc_id)) AS component_id
FROM d LEFT JOIN size USING (doc_id) LEFT JOIN least_of ON least_of.x = d.doc_id"""

WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest, coalesce(html, '') AS body FROM pages),
last AS (SELECT body, max(page_id) AS id FROM p WHERE n >= 1000 GROUP BY body)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN id <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN id <> page_id THEN id END AS refers_to
FROM p LEFT JOIN last USING (body)"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + 19], ' ')) AS h FROM d, unnest(generate_series(1, len(w) - 19)) t(i) WHERE len(w) >= 20),
placed AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS place FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS j FROM placed WHERE place > 1),
word AS (SELECT doc_id, j, w[j] AS word FROM d, unnest(generate_series(1, len(w))) t(j)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


def _rule(what: int) -> str:
    """CASE over the rules, longest first; what: 0 the rule, 1 its verdict."""
    cases = []
    for rule in sorted(RULES, key=lambda r: -len(r[0])):
        host, _, path = rule[0].partition("/")
        cases.append(f"WHEN (u.host = '{host}' OR ends_with(u.host, '.{host}')) AND starts_with(path, '/{path}') THEN '{rule[what]}'")
    return f"CASE {' '.join(cases)} END"


def _shrunk(name: str, units: str) -> str:
    """Units (with mu) and their posterior, by the strength that their spread asks for."""
    return f"""{name}_mu AS ({units}),
{name}_s AS (SELECT 1 / greatest(1e-4, least(0.999, CASE WHEN coalesce(room, 0) = 0 THEN 0.5 ELSE (seen - own) / room END)) - 1 AS strength FROM (SELECT sum(n * power(good / n - mu, 2)) AS seen, sum(mu * (1 - mu)) AS own, sum((n - 1) * mu * (1 - mu)) AS room FROM {name}_mu)),
{name} AS (SELECT m.*, (good + strength * mu) / (n + strength) AS mean, n + strength AS strength FROM {name}_mu m, {name}_s)"""


TWO = "array_to_string(string_split(host, '.')[-2:], '.')"
LISTED = ", ".join(f"'{x}'" for x in SUFFIXES)
URLS = f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN split_part(split_part(substr(url, strpos(url, '://') + 3), '#', 1), '?', 1) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(split_part(rest, '/', 1), '{UPPER}', '{LOWER}') AS host, substr(rest, length(split_part(rest, '/', 1)) + 1) AS path FROM cut),
outcome AS (SELECT host, CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1.0 ELSE 0.0 END AS good FROM u JOIN labels ON labels.doc_id = u.page_id WHERE quality IS NOT NULL),
named AS (SELECT DISTINCT host, CASE WHEN {TWO} IN ({LISTED}) THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE {TWO} END AS domain, CASE WHEN {TWO} IN ({LISTED}) THEN {TWO} ELSE string_split(host, '.')[-1] END AS suffix FROM u),
counted AS (SELECT host, domain, suffix, count(*) AS n, sum(good) AS good FROM outcome JOIN named USING (host) GROUP BY ALL),
rate AS (SELECT coalesce(sum(good) / sum(n), 1) AS rate FROM counted),
{_shrunk("suffixes", "SELECT suffix, sum(n) AS n, sum(good) AS good, any_value(rate) AS mu FROM counted, rate GROUP BY suffix")},
{_shrunk("domains", "SELECT c.domain, c.suffix, sum(c.n) AS n, sum(c.good) AS good, any_value(s.mean) AS mu FROM counted c JOIN suffixes s ON s.suffix = c.suffix GROUP BY c.domain, c.suffix")},
{_shrunk("hosts", "SELECT c.host, c.n, c.good, d.mean AS mu FROM counted c JOIN domains d ON d.domain = c.domain")},
known AS (SELECT named.host, coalesce(h.mean, d.mean, s.mean, rate) AS mean, coalesce(h.strength, d.strength, s.strength, 1) AS strength FROM rate, named LEFT JOIN hosts h ON h.host = named.host LEFT JOIN domains d ON d.domain = named.domain LEFT JOIN suffixes s ON s.suffix = named.suffix)
SELECT page_id, u.host, path, {_rule(0)} AS rule, coalesce({_rule(1)}, CASE WHEN mean + {BOUND_SDS} * sqrt(mean * (1 - mean) / (strength + 1)) < {FLOOR} THEN 'block' ELSE 'allow' END) AS verdict
FROM u JOIN known ON known.host = u.host"""

ORACLE = {"op4_decontaminate": DECONTAMINATE, "op5_jaccard_join": JACCARD, "op6_warc": WARC, "op9_substring_dedup": SUBSTRINGS, "op10_url_filter": URLS}
