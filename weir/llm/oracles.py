"""The SQL of the operators that SQL can express, by brute force rather than by the operators' methods."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Every window of words, by content; a word is removed if a repeated window started at most 34 words before it.
SUBSTRING_WORDS = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {WORDS} AS ws FROM documents),
w AS (SELECT rid, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS i FROM d),
s AS (SELECT rid, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM d WHERE len(ws) >= 35)),
r AS (SELECT rid, i FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
m AS (SELECT w.rid, w.word, w.i, max(r.i) OVER (PARTITION BY w.rid ORDER BY w.i) AS last_start FROM w LEFT JOIN r ON w.rid = r.rid AND w.i = r.i),
k AS (SELECT rid, count(*) FILTER (WHERE last_start > i - 35) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE last_start IS NULL OR last_start <= i - 35) AS kept FROM m GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.rid = k.rid"""

#: All pairs of a label.
EMBEDDING_PAIRS = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND list_dot_product(e, e) > 0 AND isfinite(list_dot_product(e, e))),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
k AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT c.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN k ON c.vec_id = k.vec_id"""

#: Every window of bytes, by content, as hexadecimal digits.
SUBSTRING_BYTES = """
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, hex(encode(coalesce(text, ''))) AS hx FROM documents),
s AS (SELECT rid, i, md5(substr(hx, 2 * i - 1, 800)) AS h FROM (SELECT rid, hx, unnest(generate_series(1, length(hx) // 2 - 399)) AS i FROM d WHERE length(hx) >= 800)),
r AS (SELECT rid, i FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
g AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM r),
p AS (SELECT rid, min(i) AS a, max(i) + 400 AS b FROM (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS span FROM g) GROUP BY rid, span),
e AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 1) AS before, lead(a) OVER (PARTITION BY rid ORDER BY a) AS after FROM p),
k AS (SELECT e.rid, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(hx, 2 * before - 1, 2 * (a - before)) || CASE WHEN after IS NULL THEN substr(hx, 2 * b - 1) ELSE '' END, '' ORDER BY a) AS kept
FROM e JOIN d ON e.rid = d.rid GROUP BY e.rid)
SELECT doc_id, CAST(length(hx) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, hx))) AS kept_sha256
FROM d LEFT JOIN k ON d.rid = k.rid"""

_GENERATED = r"^(.*[0-9].*|[0-9a-f]{16,}|.*%[0-9a-fA-F]{2}.*|.{64,})$"

#: The rules, then a recursion over the nodes of all hosts: a shape goes on to the node of its branch until that is a leaf.
URL_TEMPLATES = rf"""
WITH RECURSIVE u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/' WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule,
[CASE WHEN regexp_matches(s, '{_GENERATED}') THEN '*' ELSE s END for s in string_split(path, '/') if s <> ''] AS shape FROM u),
l AS (SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS label, shape FROM r),
s AS (SELECT host, shape, count(label) AS seen, count(*) FILTER (WHERE label = 'block') AS bad FROM l GROUP BY 1, 2),
tree AS (SELECT host, shape, seen, bad, shape AS rest, '' AS template, (sum(bad) OVER w + 1.0::DOUBLE) / (sum(seen) OVER w + 2.0::DOUBLE) AS purity, false AS leaf FROM s WINDOW w AS (PARTITION BY host)
UNION ALL SELECT host, shape, seen, bad, rest, template, purity, leaf FROM (
SELECT * REPLACE (CASE WHEN is_leaf THEN rest ELSE rest[2:] END AS rest, is_leaf AS leaf, CASE WHEN is_leaf THEN below || CASE WHEN low <> high THEN '/~' ELSE '' END ELSE below || '/' || name END AS template,
CASE WHEN is_leaf OR count(*) OVER b = count(*) OVER n THEN purity ELSE (sum(bad) OVER b + 2.0::DOUBLE * purity) / (sum(seen) OVER b + 2.0::DOUBLE) END AS purity) FROM (
SELECT *, CASE WHEN alike AND count(DISTINCT CASE WHEN alike THEN segment END) OVER n > 1 THEN '~' ELSE segment END AS name FROM (
SELECT *, (b_bad - b_seen * p) * (b_bad - b_seen * p) <= b_seen * p * (1 - p) * (1.96::DOUBLE * 1.96::DOUBLE) AS alike FROM (
SELECT *, sum(bad) OVER g AS b_bad, sum(seen) OVER g AS b_seen, (n_bad + 0.5::DOUBLE) / (n_seen + 1.0::DOUBLE) AS p FROM (
SELECT * REPLACE (rest[share + 1:] AS rest), coalesce(rest[share + 1], '') AS segment, template || array_to_string(['/' || x for x in low[:share]], '') AS below FROM (
SELECT *, n_bad = 0 OR n_bad = n_seen OR low = high AS is_leaf, CASE WHEN low = high THEN len(low) ELSE list_position([low[i] IS NOT DISTINCT FROM high[i] for i in generate_series(1, len(high))], false) - 1 END AS share FROM (
SELECT *, sum(bad) OVER n AS n_bad, sum(seen) OVER n AS n_seen, min(rest) OVER n AS low, max(rest) OVER n AS high FROM tree WHERE NOT leaf
WINDOW n AS (PARTITION BY host, template)))) WINDOW g AS (PARTITION BY host, template, segment))) WINDOW n AS (PARTITION BY host, template)) WINDOW n AS (PARTITION BY host, template), b AS (PARTITION BY host, template, name)))
SELECT page_id, l.host, path, rule, coalesce(label, CASE WHEN purity >= 0.8::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, tree.template, purity
FROM l JOIN tree ON l.host = tree.host AND l.shape = tree.shape AND tree.leaf"""


def _fill(i: int) -> str:
    """One round: each source takes documents that fit from the front of its order until its room is full."""
    last = f"f{i - 1}"
    return f"""
room{i} AS (SELECT sid, rest, floor(rest - sum(CASE WHEN extra THEN size ELSE 0 END) + 0.5) AS room FROM {last} GROUP BY sid, rest),
asked{i} AS (SELECT rid, sum(f.size) OVER (PARTITION BY f.sid ORDER BY f.p, f.size, f.doc_id ROWS UNBOUNDED PRECEDING) <= room AS takes FROM {last} f JOIN room{i} r ON f.sid = r.sid WHERE NOT extra AND size > 0 AND size <= room AND room > 0),
f{i} AS (SELECT f.* REPLACE (extra OR coalesce(takes, false) AS extra) FROM {last} f LEFT JOIN asked{i} a ON f.rid = a.rid)"""


#: Targets by filling up sources in order, then Pareto's order source by source.
PARETO_MIX = rf"""
WITH d AS (SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS mark, row_number() OVER () AS rid, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid, CAST(sum(source_size) OVER () AS DOUBLE) AS all_size, source_size * 2.0::DOUBLE AS limit_words,
CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
v AS (SELECT *, (all_size * 1.5::DOUBLE - coalesce(sum(limit_words) OVER (ORDER BY limit_words / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
/ sum(weight) OVER (ORDER BY limit_words / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, CASE WHEN level > limit_words / weight THEN limit_words ELSE least(max(CASE WHEN level <= limit_words / weight THEN level END) OVER () * weight, limit_words) END AS target FROM v),
c AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS certain FROM t),
q AS (SELECT *, target - certain * source_size AS rest FROM c),
u AS (SELECT d.doc_id, d.rid, d.size, q.source, sid, source_size, target, certain, rest,
(CAST('0x' || substr(md5('17|order|' || mark), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS x,
CASE WHEN size > 0 AND rest > 0 THEN least(rest / source_size, rest / size, 1 - 1e-9::DOUBLE) END AS chance FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
o AS (SELECT *, (x / (1 - x)) / (chance / (1 - chance)) AS odds FROM u),
f0 AS (SELECT *, coalesce(least(odds / (1 + odds), 1 - 1e-12::DOUBLE), 0) AS p, false AS extra FROM o),
{",".join(_fill(i) for i in range(1, 4))}
SELECT doc_id, size, source_size, target, CAST(size * (certain + CAST(extra AS INT)) AS BIGINT) AS taken, source FROM f3"""
